"""Fingerprints, links, components and classes against brute force."""

import itertools
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from gatecast.llm import simhash as S

WORDS = [f"w{k}" for k in range(400)]


def brute_fingerprint(text, words):
    parts = [p for p in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ").split(" ") if p]
    if not parts:
        return 0
    shingles = [" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, close):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(nodes, 2):
        if close(a, b):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_fingerprint_is_the_majority_of_all_shingles():
    random.seed(4)
    for n in (0, 1, 3, 4, 5, 300):
        text = " ".join(random.choices(["A", "É", "b\tc", "d"], k=n))
        assert S.majority(S.shingle_hashes(text, 4)) == brute_fingerprint(text, 4)


def test_links_are_exactly_the_close_pairs(spark):
    random.seed(5)
    prints = {random.getrandbits(64) for _ in range(150)}
    for p in list(prints)[:60]:
        for bits in (1, 3, 4, 5, 8):
            q = p
            for b in random.sample(range(64), bits):
                q ^= 1 << b
            prints.add(q)
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    table = spark.createDataFrame([(p,) for p in signed], "fp long")
    want = {(a, b) for a, b in itertools.combinations(signed, 2) if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4}
    for blocks in (5, 6, 8):
        got = [tuple(r) for r in S.links(table, 4, blocks).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    with pytest.raises(ValueError):
        S.links(table, 4, 4)


def test_components_of_chains_stars_and_random_graphs(spark):
    random.seed(6)
    chain = [(k, k + 1) for k in range(100, 160)]
    star = [(200, k) for k in range(201, 240)] + [(0, 200)]
    loose = [(random.randint(300, 400), random.randint(300, 400)) for _ in range(70)]
    edges = {(min(e), max(e)) for e in chain + star + loose}
    nodes = sorted({n for a, b in edges if a != b for n in (a, b)})
    want = brute_components(nodes, lambda a, b: (a, b) in edges)
    got = {r.node: r.root for r in S.components(spark.createDataFrame(list(edges), "a long, b long")).collect()}
    assert got == want
    assert S.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_documents(spark):
    random.seed(7)
    texts = [" ".join(random.choices(WORDS, k=80)) for _ in range(12)]
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(100 + k, t) for k, t in enumerate(texts[:5])]  # copies
    rows += [(200 + k, t + " tail") for k, t in enumerate(texts)]  # close
    rows += [(300, None), (301, ""), (302, " \n"), (303, "one two"), (303, "one two"), (None, texts[0]), (None, "lonely words here only now")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, root int")
    got = S.simhash_components(docs).collect()
    prints = [(i, brute_fingerprint(t or "", 4)) for i, t in rows]
    root = brute_components(sorted({p for _, p in prints}), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    want = sorted(((i, f"{p:016x}", least.get(root[p])) for i, p in prints), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want
    assert S.simhash_components(docs.where("doc_id < -5")).count() == 0


def brute_kept(rows, close_bits=4):
    """Ids of the rows that stay: of every component the smallest id, null last."""
    prints = [(i, brute_fingerprint(t or "", 4)) for i, t in rows]
    root = brute_components(sorted({p for _, p in prints}), lambda a, b: (a ^ b).bit_count() <= close_bits)
    kept = {}
    for i, p in prints:
        kept[root[p]] = min(kept.get(root[p], (True, 0)), (i is None, i or 0))
    return sorted(str(None if missing else i) for missing, i in kept.values())


def test_one_of_each_component_stays(spark):
    random.seed(8)
    rows, number = [], 0
    for _ in range(25):
        words = random.choices(WORDS, k=random.choice([3, 40, 120, 400]))
        for copy in range(random.randint(1, 6)):
            changed = list(words)
            if copy:
                changed[random.randrange(len(changed))] = "edited"
            rows.append((number, " ".join(changed)))
            number += 1
    rows += [rows[0], (None, rows[3][1]), (None, "only nulls have this text here"), (None, "only nulls have this text here"), (900, None), (901, "")]
    random.shuffle(rows)
    names = ["doc_id", "text", "source", "near_row", "near_print", "a.b", "fp"]
    docs = spark.createDataFrame([(i, t, "s", 5, True, 1.5, "x") for i, t in rows], "doc_id long, text string, c string, d int, e boolean, f double, g string").toDF(*names)
    got = S.without_near_copies(docs)
    assert got.columns == docs.columns and got.schema == docs.schema
    assert sorted(str(r.doc_id) for r in got.collect()) == brute_kept(rows)
    assert S.without_near_copies(docs.where("doc_id < 0")).count() == 0


def test_a_large_group_of_edited_copies(spark):
    random.seed(11)
    base = [f"g{k}" for k in range(600)]
    rows = [(0, " ".join(base))]
    for number in range(1, 401):
        changed = list(base)
        changed[random.randrange(600)] = f"edit{random.randrange(10**6)}"
        rows.append((number, " ".join(changed)))
    random.shuffle(rows)
    kept = S.without_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in kept) == brute_kept(rows)


def test_more_prints_get_longer_keys():
    chosen = [S.blocks_for(10**k) for k in range(11)]
    assert chosen == sorted(chosen) and chosen[5] == 6 and chosen[10] >= 8
