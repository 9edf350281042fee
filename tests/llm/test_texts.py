"""Quality rules, personal data, licences, fingerprints by weighted sampling: against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gatecast.llm import license_scan as L
from gatecast.llm import pii as P
from gatecast.llm import quality as Q
from gatecast.llm import weighted_sampling as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# Quality rules


def brute_statistics(text):
    words = WORD.findall(text)
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] >= 2 for d in range(3)}
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            duplicates += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), duplicates, len(covered), failed


def test_base_statistics_equal_brute_force():
    random.seed(1)
    for _ in range(400):
        text = "".join(random.choice(["a", "b", "ab", " ", " ", "\n", "\t", "\x1c", " ", "é", "#", "<|>", "\r"]) for _ in range(random.randint(0, 300)))
        assert Q.base_statistics(text) == brute_statistics(text)


def test_threshold_is_the_middle_of_the_best_range():
    assert Q.threshold([(-300, 0, 5), (-100, 0, 1), (10, 1, 7)]) == pytest.approx(-0.445)
    assert Q.threshold([(0, 1, 5)]) == Q.NO_LABELS and Q.threshold([]) == Q.NO_LABELS
    bins = [(k, int(k > 3), 1) for k in range(8)] + [(0, 1, 1)]

    def errors(least):
        return sum(n for b, good, n in bins if (good and b < least) or (not good and b >= least))

    assert errors(Q.threshold(bins) / Q.STEP) == min(errors(k) for k in range(-1, 9))


def corpus(seed=2):
    random.seed(seed)
    rows, labels = [], []
    for k in range(120):
        bad = k % 4 == 0
        words = ["".join(random.choices("etao", k=random.randint(2, 9))) for _ in range(random.randint(60, 120))]
        text = " ".join(w + random.choice(["%%%", "###"]) for w in words) if bad else " ".join(words)
        rows.append((k, text))
        if k % 2 == 0:
            labels.append((k, int(not bad)))
    return rows, labels


def test_rules_equal_brute_force_and_keep_clean_documents(spark):
    rows, labels = corpus()
    rows += [(None, None), (500, ""), (501, "short text"), (3, rows[3][1])]
    labels += [(None, 1), (7, None), (9, 1), (9, 0)]
    docs = spark.createDataFrame([(i, t, "x", 0.5) for i, t in rows], "doc_id long, text string, kept string, score double").repartition(3)
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    rules = Q.fit(docs, table)
    known = {}
    for i, q in labels:
        if i is not None and q is not None:
            known[i] = min(q, known.get(i, 1))
    raw, trusted = np.zeros(Q.SLOTS), np.zeros(Q.SLOTS)
    for i, t in rows:
        for slot in Q.slots(t or ""):
            raw[slot] += 1
            trusted[slot] += known.get(i) == 1
    ratio = np.log((trusted + 1) / (trusted.sum() + Q.SLOTS)) - np.log((raw + 1) / (raw.sum() + Q.SLOTS))
    assert np.allclose(rules.ratio, ratio)
    got = docs.select("doc_id", "text", Q.judged(F.col("text"), rules).alias("r")).select("doc_id", "text", "r.*").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_statistics(r.text or "")
        assert r.kept == (not r.base_failed and r.score >= rules.threshold)
        if r.doc_id is not None and r.doc_id < 120:
            assert r.kept == (r.doc_id % 4 != 0)


def test_trusted_counts_use_all_labels_beyond_the_sample(spark, monkeypatch):
    rows, labels = corpus()
    rows += [(2, rows[2][1]), (None, rows[3][1])]
    docs, table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels + [(6, 0), (None, 1)], "doc_id long, quality int")
    monkeypatch.setattr(Q, "LABELLED", 10)
    rules = Q.fit(docs, table)
    good = {i for i, q in labels if q} - {6}
    raw, trusted = (sum(np.bincount(Q.slots(t), minlength=Q.SLOTS) for i, t in rows if i in ids) for ids in ({i for i, _ in rows}, good))
    counted = np.exp(rules.ratio + np.log((raw + 1) / (raw.sum() + Q.SLOTS)))  # (trusted + 1) / (all trusted + SLOTS)
    print("trusted trigrams", round(1 / counted.min()) - Q.SLOTS, "of", trusted.sum())
    assert np.allclose(counted, (trusted + 1) / (trusted.sum() + Q.SLOTS))


def test_threshold_uses_all_labels(spark):
    """The documents' ids are those that a sample of the 100,000 labelled ids of least MD5 leaves out."""
    rows, labels = corpus()
    far = sorted(range(100_000 + len(rows)), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())[100_000:]
    docs = spark.createDataFrame([(far[i], t) for i, t in rows], "doc_id long, text string").repartition(3)
    own = spark.createDataFrame([(far[i], q) for i, q in labels], "doc_id long, quality int")
    others = spark.range(100_000 + len(rows)).where(~F.col("id").isin(far)).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    few = Q.fit(docs, own)
    rules = Q.fit(docs, own.unionByName(others))
    assert few.threshold != Q.NO_LABELS and rules.threshold == few.threshold


def test_rules_without_labels_or_documents(spark):
    docs = spark.createDataFrame(corpus()[0], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    rules = Q.fit(docs, none)
    assert rules.threshold == Q.NO_LABELS and not rules.ratio.any()
    assert Q.fit(docs.where("doc_id < 0"), none).threshold == Q.NO_LABELS


# Personal data

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def brute_spans(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for match in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", match[0])
            if kind == 1 and any(int(p) > 255 for p in match[0].split(".")):
                continue
            if kind == 2 and not (13 <= len(digits) <= 19 and P.luhn(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *match.span()))
    return out


def test_base_spans_equal_the_plain_patterns():
    random.seed(3)
    bits = ["1", "2", "0", "4539578763621486", ".", ".", "@", "@", "a", "b.c", " ", "-", "+", "(", ")", "é", "255", "256", "+1 (988) 555-2485", "x@y.z", ":"]
    for _ in range(15_000):
        text = "".join(random.choice(bits) for _ in range(random.randint(0, 14)))
        assert P.base_spans(text) == brute_spans(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "@" * 100_000, "a" * 200_000 + "@", "1 " * 100_000, "+1" + " " * 100_000, "1." * 100_000, "a@a " * 30_000):
        P.examined(text)


def test_patterns_find_their_words_however_far():
    text = "please call" + " " * 90 + "555-123-4567" + "." * 500 + " today"
    assert P.patterns(text, 101, 113) == ["call _", "please call _", "call _ today"]
    assert P.patterns("555-1234", 0, 8) == ["^ _", "^ ^ _", "^ _ $"]
    word = "w" * 3000
    assert P.patterns(f"{word} 555-1234 {word}é!", 3001, 3009) == [f"{word} _", f"^ {word} _", f"{word} _ {word}é"]


@pytest.mark.parametrize(
    "text,want",
    [
        ("555-123-4567 555-987-6543", [("phone", "555-123-4567"), ("phone", "555-987-6543")]),
        ("2025 555-123-4567", [("phone", "555-123-4567")]),
        ("call 988 555-2485, (988) 555-2485.", [("phone", "988 555-2485"), ("phone", "(988) 555-2485")]),
        ("555 123 4567 555 987 6543 555 111 2222", [("phone", "555 123 4567"), ("phone", "555 987 6543"), ("phone", "555 111 2222")]),
        ("4111 1111 1111 1112", [("card", "4111 1111 1111 1112")]),
        ("42.1.2.3 555-123-4567", [("phone", "555-123-4567")]),
        ("+1 (988) 555-2485 then 300.1.2.3 and 12 34", [("ip", "300.1.2.3")]),
        ("555-1234)- 12", [("phone", "555-1234")]),
        ("name@" + "host" * 100, [("email", "name@" + "host" * 100)]),
        ("1 2 3", []),
    ],
)
def test_candidates_are_whole_numbers(text, want):
    assert [(P.KINDS[k], text[a:b]) for k, a, b in P.candidates(text, P.base_spans(text))] == want


def test_candidates_touch_no_base_span_and_each_other():
    random.seed(13)
    bits = ["1", "23", "555-1234", " ", " ", "-", ".", "(", ")", "+1 (988) 555-2485", "4539578763621486", "42.1.2.3", "2024", "x", "a@b.c", "q@r"]
    for _ in range(8000):
        text = "".join(random.choice(bits) for _ in range(random.randint(1, 14)))
        base = P.base_spans(text)
        more = P.candidates(text, base)
        spans = sorted((a, b) for _, a, b in more)
        assert all(a >= d or b <= c for a, b in spans for _, c, d in base), text
        numbers = sorted((a, b) for k, a, b in more if k != P.EMAIL)
        assert all(b <= c for (_, b), (c, _) in zip(numbers, numbers[1:])), text
        for k, a, b in more:
            assert a < b and (k == P.EMAIL or (text[a] in "(0123456789" and text[b - 1].isdigit())), text


def test_numbers_beside_others_are_found_by_context(spark):
    rows = [(k, f"w{k} please call +1 ({200 + k}) 555-{1000 + k} now") for k in range(12)]
    rows += [(50, "v please call   555-123-4567 555-987-6543"), (51, "u please call" + " " * 200 + "555-1234567")]
    got = {r.doc_id: r for r in P.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50].spans == "phone:16:28" and got[51].spans == "phone:213:224"


def test_contexts_discover_identifiers_and_leave_the_rest(spark):
    rows = [(k, f"{w} please call +1 ({200 + k}) 555-{1000 + k} now") for k, w in enumerate("abcdefghijkl")]
    rows += [(50, "dear all please call 555-2345 now"), (51, "the lot number 555-2346 is sold"), (52, None), (53, ""), (None, "call 7"), (50, "dear all please call 555-2345 now")]
    docs = spark.createDataFrame([(i, t, 1, "u") for i, t in rows], "doc_id long, text string, n_added int, uid string").repartition(3)
    got = P.personal_data(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t in rows if i == r.doc_id) or ""
        spans = brute_spans(text)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == s[0] for s in spans) for k in range(4))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert r.spans == ("phone:21:29" if r.doc_id == 50 else ",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b in spans))
        assert r.n_added == (r.doc_id == 50)
    masked = P.mask(docs)
    assert masked.columns == docs.columns
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert texts[50] == "dear all please call <PHONE> now" and texts[51] == rows[13][1] and texts[52] is None and texts[0] == "a please call <PHONE> now"
    assert P.personal_data(docs.where("doc_id < 0")).count() == 0 and P.mask(docs.where("doc_id < 0")).count() == 0


def test_rounds_equal_a_brute_force_graph(spark):
    random.seed(4)
    edges = set()
    for _ in range(260):
        edges.add((random.choice("pqrstu"), random.randrange(3), f"i{random.randrange(60)}"))
    kinds = {i: k for _, k, i in sorted(edges)}
    edges = sorted({(p, kinds[i], i) for p, _, i in edges})
    seed = {i: int(i[1:]) % 6 != 0 for _, _, i in edges}
    marks = [{"k": k, "s": n, "e": n + 1, "seed": seed[i], "instance": i, "patterns": [p]} for n, (p, k, i) in enumerate(edges)]
    rows = spark.createDataFrame([(0, marks)], "uid long, marks array<struct<k:int,s:int,e:int,seed:boolean,instance:string,patterns:array<string>>>")
    got = P.discovered(rows).collect()
    sure = {(k, i): float(seed[i]) for _, k, i in edges}
    for _ in range(P.ROUNDS):
        strong = {}
        for p in "pqrstu":
            own = [(k, i) for q, k, i in edges if q == p]
            for kind in range(3):
                good = [(k, i) for k, i in own if k == kind]
                confidence = sum(sure[x] for x in good) / len(own) if own else 0
                if confidence >= P.CONFIDENT and sum(seed[i] for _, i in good) >= P.LEAST_SEEDS:
                    strong[p, kind] = confidence
        for key in sure:
            if not seed[key[1]]:
                doubt = [1 - strong[p, k] for p, k, i in edges if (k, i) == key and (p, k) in strong]
                sure[key] = 1 - float(np.prod(doubt)) if doubt else 0.0
    want = {(k, n, n + 1) for n, (p, k, i) in enumerate(edges) if not seed[i] and (p, k) in strong}
    assert {tuple(x) for r in got for x in r.more} == want


def test_found_identifiers_make_patterns_count_and_are_marked_everywhere(spark):
    rows = [(k, f"w{k} please call +1 ({200 + k}) 555-{1000 + k} now") for k in range(60)]
    rows += [(100 + k, f"x{k} please call 555-{3000 + k} now") for k in range(8)]
    rows += [(200 + k, f"y{k} kindly reach me at 555-{3000 + k} tonight") for k in range(8)]
    rows += [(300, "z kindly reach me at 555-4444 tonight"), (301, "lot 555-3000 here"), (302, "lot 555-9999 here")]
    got = {r.doc_id: r for r in P.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    print("added", sum(r.n_added for r in got.values()))
    assert all(got[k].n_added == 1 for k in [*range(100, 108), *range(200, 208), 300, 301]) and got[302].n_added == 0
    assert got[301].spans == "phone:4:12"


# Licences


def brute_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hits, labels = [], set()
    for phrase, label in L.PHRASES.items():
        parts = phrase.split()
        here = [i for i in range(len(words) - len(parts) + 1) if words[i : i + len(parts)] == parts]
        hits += here
        labels |= {label} if here else set()
    return len(words), len(hits), min(hits, default=None), max(hits, default=None), ",".join(sorted(labels))


def brute_labels(text):
    """Templates whose key phrases stand at their relative places."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    labels = set()
    for label, template, keys in L.TEMPLATES:
        line = template.split()
        for start in range(-len(line), len(words)):
            good = True
            for key in keys:
                parts = key.split()
                at = start + next(k for k in range(len(line)) if line[k : k + len(parts)] == parts)
                good = good and at >= 0 and words[at : at + len(parts)] == parts
            if good:
                labels.add(label)
    return labels


def test_scan_equals_brute_force(spark):
    random.seed(6)
    bits = [t for _, t, _ in L.TEMPLATES] + ["cc by", "all rights reserved", "All rights-reserved.", "general public", "license", "é", "4.0", "x y z", "mit", "Apache License", "version 2.0"]
    rows = [(k, " ".join(random.choices(bits, k=random.randint(0, 5)))) for k in range(150)]
    rows += [(200, None), (201, ""), (None, "CC BY-NC 4.0"), (202, "license " * 5000), (3, rows[3][1])]
    docs = spark.createDataFrame([(i, t, "l", 1) for i, t in rows], "doc_id long, text string, line string, row int").repartition(3)
    texts = dict(rows)
    got = L.scanned(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_scan(texts[r.doc_id])
        labels = set(r.labels.split(",")) - {""}
        assert labels == brute_labels(texts[r.doc_id]) | (set(r.base_labels.split(",")) - {""})
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(labels) and r.labels == ",".join(sorted(labels))
    assert L.scanned(docs.where("doc_id < 0")).count() == 0


def test_key_phrases_alone_are_found_whatever_words_are_rarest(spark):
    header = "Unauthorized copying of this file via any medium is strictly prohibited. Proprietary and confidential"
    rows = [(0, header), (1, "The universal dedication of one public domain. CC0 1.0 holds")]
    rows += [(k, "proprietary or confidential, cc0 or not") for k in range(2, 30)]
    got = {r.doc_id: (r.labels, r.score) for r in L.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    print("labels", got[0], got[1])
    assert got[0][0] == "proprietary" and 0 < got[0][1] < 1
    assert got[1][0] == "cc0-1.0" and 0 < got[1][1] < 1
    assert not any(got[k][0] for k in range(2, 30))


# Weighted sampling


def test_equal_draws_estimate_generalised_jaccard():
    random.seed(2)
    errors = []
    for _ in range(80):
        a = collections.Counter({b"w%d" % k: random.randint(1, 9) for k in random.sample(range(200), 80)})
        b = collections.Counter(a)
        for k in random.sample(range(200), random.randint(0, 80)):
            b[b"w%d" % k] = random.randint(1, 9)
        truth = sum(min(a[k], b[k]) for k in a | b) / sum(max(a[k], b[k]) for k in a | b)
        errors.append(W.likeness(*W.signatures([a, b])) - truth)
    assert abs(np.mean(errors)) < 0.03 and np.sqrt(np.mean(np.square(errors))) < 0.08


def test_fingerprints_equal_brute_force(spark):
    random.seed(5)
    rows = [(k * 3, " ".join(random.choices(["a", "b", "C", "d", "é", "f"], k=random.randint(0, 40)))) for k in range(90)]
    rows += [(1, None), (4, ""), (None, "no id"), (7, rows[5][1]), (7, "twice")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, part int").repartition(4)
    got = W.fingerprints(docs).collect()
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] is not None, (r[1] or "").encode())), reverse=True)
    want = []
    for k, (i, t) in enumerate(ordered):
        text, following = t or "", ordered[(k + 1) % len(ordered)][1] or ""
        third = len(text) // 3
        changed = text[: len(text) - third] + following[:third]
        a, b, c = W.signatures([W.weights(x) for x in (text, changed, following)])
        digest = hashlib.sha256(changed.encode()).hexdigest()
        want.append((i, len(text), digest, W.hexed(a), W.hexed(b), W.likeness(a, b), W.likeness(a, c)))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)
    by_text = collections.defaultdict(set)
    for r in want:
        by_text[next(t for i, t in rows if i == r[0]) if r[0] != 7 else r[3]].add(r[3])
    assert all(len(v) == 1 for v in by_text.values())
    one = W.fingerprints(docs.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert W.fingerprints(docs.where("doc_id < 0")).count() == 0
