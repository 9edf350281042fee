"""Exact dedup, clustering and resampling against brute force."""

import hashlib
import itertools
import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatecast.llm import hilbert_kmeans as H
from gatecast.llm import importance as I
from gatecast.llm import radix_dedup as R



@pytest.fixture
def small_partitions(spark):
    """Shuffle partitions stay apart, as with much data."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


# Tries


def strings(seed, n=600):
    random.seed(seed)
    return [bytes(random.choices(b"abc", k=random.choice([0, 1, 2, 3, 8, 40]))) * random.choice([1, 1, 5]) for _ in range(n)]


def weight(node):
    return len(node.label) + R.NODE + sum(weight(c) for c in node.children.values() if c is not None)


def test_trie_holds_each_string_once_with_its_owner():
    for better, pick in ((R.larger, max), (R.smaller, min)):
        trie, want = R.Trie(better), {}
        for k, s in enumerate(strings(1)):
            assert trie.insert(s, [k if k % 5 else None, 1, len(s), 0])
            want.setdefault(s, []).append(k if k % 5 else None)
        got = {s: e[:2] for s, e in trie.entries()}
        assert got == {s: [pick((k for k in ks if k is not None), default=None), len(ks)] for s, ks in want.items()}
        assert trie.size == weight(trie.root)


def test_spilled_subtrees_and_what_stays_are_all_strings():
    trie, given, out = R.Trie(), strings(2), Counter()
    for s in given:
        if not trie.insert(s, [1, 1, len(s), 0]):
            out[s] += 1
        while trie.size > 6 * R.NODE and (cut := trie.spill()):
            for t, entry in cut:
                out[t] += entry[1]
            assert trie.size == weight(trie.root)
    kept = {s: e[1] for s, e in trie.entries()}
    assert kept and out and not set(kept) & set(out)
    assert Counter(given) == out + Counter(kept)


DOCS = "doc_id long, text string, length string, hash int, body string, `a.b` int, owner double"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2, 0.5) for i, t in rows], DOCS)


def check_groups(got, rows, keep):
    lower = [("" if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)) for _, t in rows]
    ids = {}
    for (i, _), body in zip(rows, lower):
        ids.setdefault(body, []).append(i)
    pick = {"largest": max, "smallest": min}[keep]
    owner = {body: pick((i for i in group if i is not None), default=None) for body, group in ids.items()}
    want = sorted((str(i), str(owner[b]), len(ids[b]), hashlib.sha256(b.encode()).hexdigest()) for (i, _), b in zip(rows, lower))
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter({hashlib.sha256(b.encode()).hexdigest(): 1 for b in ids})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def copies(seed):
    random.seed(seed)
    texts = ["word " * k + random.choice(["É", "é", "A", "a"]) for k in range(30)] + ["long " * 30_000, "", "Ａ"]
    rows = [(k, random.choice(texts)) for k in range(150)]
    return rows + [(7, rows[7][1]), (7, rows[7][1]), (149, rows[149][1]), (None, "Only nulls"), (None, "only nulls"), (None, rows[3][1]), (900, None), (901, ""), (-5, None)]


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_groups(spark, keep):
    rows = copies(3)
    got = R.exact_groups(documents(spark, rows).repartition(5), F.col("text"), keep)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    check_groups(got.collect(), rows, keep)


def test_exact_groups_with_equal_hashes_and_spilled_subtrees(spark):
    rows = copies(4)
    docs = documents(spark, rows).repartition(4)
    check_groups(R.exact_groups(docs, F.col("text"), hashed=lambda body: 5).collect(), rows, "largest")
    check_groups(R.exact_groups(docs, F.col("text"), memory=4 * R.NODE).collect(), rows, "largest")
    check_groups(R.exact_groups(docs, F.col("text"), memory=4 * R.NODE, hashed=lambda body: len(body) % 2).collect(), rows, "largest")


def test_exact_groups_of_no_rows(spark):
    assert R.exact_groups(documents(spark, [(1, "a")]).where("doc_id > 1"), F.col("text")).count() == 0


# Curves and zone maps


def test_neighbours_on_the_curve_are_neighbours_in_space():
    for size, bits in ((2, 4), (3, 3), (5, 2), (4, 1)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=size)))
        places = [row.tobytes() for row in H.hilbert_places(cells, bits)]
        assert len(set(places)) == len(cells)
        ordered = cells[np.argsort(np.array(places, dtype=object))]
        assert (np.abs(np.diff(ordered, axis=0)).sum(1) == 1).all()


def test_the_nearest_centroid_is_a_candidate():
    rng = np.random.default_rng(5)
    pruned = 0
    for spread in (3, 40, 1 << 22):
        for _ in range(30):
            centroids = rng.integers(-spread * 9, spread * 9, (12, 6))
            centroids[5] = centroids[2]
            vectors = rng.integers(-spread, spread, (20, 6)) + rng.integers(-spread * 9, spread * 9, 6)
            low, high = vectors.min(0), vectors.max(0)
            chosen, distance = H.nearest(vectors, low, high, centroids)
            every = ((vectors[:, None, :] - centroids[None]) ** 2).sum(2)
            assert (chosen == every.argmin(1)).all() and (distance == every.min(1)).all()
            pruned += len(H.candidates(low, high, centroids)) < 12
    assert pruned > 20


def brute_clusters(rows, count, rounds, size, scale, seed):
    kept = [(i, tuple(math.floor(scale * x) for x in v)) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", np.array(r[1], "<i4").tobytes()))
    centroids = [list(v) for _, v in first[:count]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        chosen = assign()
        for k in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, chosen) if c == k]
            if mine:
                centroids[k] = [sum(xs) // len(mine) for xs in zip(*mine)]
    chosen = assign()
    inertia = Counter()
    for d, k in chosen:
        inertia[k] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), k, d, inertia[k], sum(inertia.values()), digest[k]) for (i, _), (d, k) in zip(kept, chosen))


def vector_rows(seed, n, size, spread):
    random.seed(seed)
    middles = [[random.uniform(-spread, spread) for _ in range(size)] for _ in range(5)]
    rows = [(k, [random.gauss(m, spread / 9) for m in random.choice(middles)]) for k in range(n)]
    rows += [(5000 + k, rows[0][1]) for k in range(n // 2)]  # one very frequent vector
    rows += [(3, rows[9][1]), (3, rows[9][1]), (None, rows[4][1]), (6000, None), (6001, [1.0]), (6002, [None, *rows[0][1][1:]]), (6003, [math.nan, *rows[0][1][1:]])]
    return rows + [(6004, [math.inf, *rows[0][1][1:]]), (6005, []), (6006, [*rows[0][1], 1.0])]


@pytest.mark.parametrize("spread", [1.0, 900_000.0])
def test_clusters(spark, spread):
    rows = vector_rows(6, 160, 6, spread)
    table = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, id string, `a.b` int").repartition(4)
    got = H.clusters(table, "vec_id", "embedding", 7, 3, 6, 64.0, "1", block=16)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == brute_clusters(rows, 7, 3, 6, 64.0, "1")


def test_few_and_no_vectors(spark):
    rows = [(1, [0.5, 0.25]), (2, [0.5, 0.25]), (3, [-1.0, 2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = H.clusters(table, "vec_id", "embedding", 16, 3, 2)
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == brute_clusters(rows, 16, 3, 2, 64.0, "1")
    none = H.clusters(table.where("vec_id > 3"), "vec_id", "embedding", 16, 3, 2)
    assert none.dtypes == got.dtypes and none.count() == 0
    with pytest.raises(Exception, match="beyond"):
        H.clusters(spark.createDataFrame([(1, [1e30, 0.0])], table.schema), "vec_id", "embedding", 16, 3, 2)


def test_equal_vectors_spread_over_blocks_of_several_partitions(spark, small_partitions):
    table = spark.range(4000).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("vector"))
    _, blocks = H.zone_maps(table, 2, 64.0, 100)
    parts = blocks.select(F.input_file_name().alias("file"), F.size("ids").alias("n")).groupBy("file").agg(F.sum("n").alias("n")).collect()
    assert len(parts) > 1 and max(r.n for r in parts) < 3000


# Resampling


def brute_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if "0" <= c <= "9" or "a" <= c <= "z" or ord(c) > 127:
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def brute_features(text, grams):
    found = brute_words(text)
    return [" ".join(found[k : k + n]) for n in range(1, grams + 1) for k in range(len(found) - n + 1)]


def test_states_are_the_crc_of_every_run():
    random.seed(7)
    text = "".join(random.choices("aB1é \n-日_.", k=900))
    found = I.words(text)
    assert [w.decode() for w in found] == brute_words(text)
    some = random.sample(sorted(set(found)), 5)
    for head in (I.head_of([]), I.head_of(some, [(a, b) for a, b in zip(found[:50], found[1:])])):
        for grams in (1, 2, 3):
            assert Counter(I.feature_states(found, head, grams)) == Counter(crc32(f.encode()) for f in brute_features(text, grams))


def brute_resampled(docs, targets, grams, percent, least):
    s, t = (Counter(crc32(f.encode()) % I.BUCKETS for text in texts for f in brute_features(text, grams)) for texts in ([d[1] for d in docs], targets))
    big_s, big_t = sum(s.values()) + I.BUCKETS, sum(t.values()) + I.BUCKETS
    rows = []
    for i, text in docs:
        features = [crc32(f.encode()) % I.BUCKETS for f in brute_features(text, grams)]
        gain = [math.floor(1000 * math.log(((t[b] + 1.0) * big_s) / ((s[b] + 1.0) * big_t))) for b in features]
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain) // len(gain) if gain else 0
        rows.append([i, len(features), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r, (_, text) in zip(rows, docs) if len(brute_words(text)) >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return sorted(str((*r, ranks.get(id(r)))) for r in rows)


def test_resampled(spark):
    random.seed(8)
    vocabulary = [f"W{k}é" if k % 3 else f"w{k}" for k in range(80)]
    docs = [(k, " ".join(random.choices(vocabulary, k=random.randint(15, 60)))) for k in range(200)]
    docs += [docs[5], docs[5], (None, docs[6][1]), (None, docs[6][1]), (300, None), (301, ""), (302, "a,b " * 20_000)]
    targets = [" ".join(random.choices(vocabulary[:20], k=40)) for _ in range(10)] + [None, ""]
    table = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], "doc_id long, text string, score int, row string, `a.b` int").repartition(5)
    wanted = spark.createDataFrame([(t,) for t in targets], "text string")
    for grams, head in ((1, 10), (1, I.HEAD), (2, 30), (2, I.HEAD)):
        got = I.resampled(table, wanted, grams, 10, 20, head=head)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(str(tuple(r)) for r in got.collect()) == brute_resampled(docs, targets, grams, 10, 20)
    no_targets = I.resampled(table, wanted.where("text IS NULL"), 1, 10, 20)
    assert sorted(str(tuple(r)) for r in no_targets.collect()) == brute_resampled(docs, [], 1, 10, 20)
    assert I.resampled(table.where("doc_id < 0"), wanted).count() == 0


def test_rows_that_repeat_one_id_have_different_ranks_in_several_partitions(spark, small_partitions):
    table = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("one two " * 15).alias("text"))
    got = I.resampled(table, table.limit(3), percent=50).where("rank IS NOT NULL").select("rank").collect()
    assert sorted(r.rank for r in got) == list(range(1, 1501))
