"""Document fingerprints by consistent weighted sampling.

A text is its words (A-Z in lower case) with their counts as weights. For each of ``SAMPLES`` draws
every term gets two Gamma(2, 1) and one uniform number from a hash of the term and the draw:
    t = floor(log(w) / r + b),   log a = log c - r * (t - b) - r,
and the draw is the (term, t) of least a. Two weighted sets give the same draw with a probability
of sum(min) / sum(max), their generalised Jaccard similarity. 16 bits of each draw are kept, so the
share of equal draws estimates it (standard error at most 0.06, chance matches 1 in 65,536).

Neighbours: documents are range partitioned by descending id (null last, then by descending text)
and sorted, so each partition streams its own documents with one document held back. The first and
the last document of each partition, one row each, are stored and joined afterwards.

Nulls: a null text is empty. Texts without words share one fingerprint that is like no other. Equal
texts have equal fingerprints. Repeated ids and rows are documents of their own. With one document
the next is itself. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gatecast.session import materialize

SAMPLES = 64
AT_ONCE = 60_000  # distinct (term, weight) pairs whose draws are in memory together, about 25 MB; more documents start a new group
EMPTY = "0" * (4 * SAMPLES)

# The increment and multipliers of the public SplitMix64 generator.
STEP = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def remix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's output function."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def weights(text: str) -> Counter:
    return Counter(text.encode("utf-8", "replace").lower().split())


def draws(terms: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log a, 16 bits of the draw) for each term with its weight, one column per draw."""
    hashes = np.fromiter((xxhash.xxh64_intdigest(t, 7) for t in terms), np.uint64, len(terms))
    logs = np.log(counts.astype(np.float32))
    log_a, token = np.empty((len(terms), SAMPLES), np.float32), np.empty((len(terms), SAMPLES), np.uint16)
    for at in range(0, len(terms), 512):  # small enough for the processor's cache
        here = slice(at, at + 512)
        first = remix(hashes[here, None] + STEP * DRAWS)
        second = remix(first + STEP)
        r = -np.log(unit(first, 40) * unit(first, 16))
        c = unit(second, 40) * unit(second, 16)
        b = ((first & np.uint64(0xFFFF)).astype(np.float32) + HALF) * np.float32(2.0**-16)
        t = np.floor(logs[here, None] / r + b)
        log_a[here] = np.log(-np.log(c)) - r * (t - b + np.float32(1))
        token[here] = remix(hashes[here, None] ^ (STEP * (t.astype(np.int64).astype(np.uint64) + np.uint64(1)))) >> np.uint64(48)
    return log_a, token


DRAWS = np.arange(1, SAMPLES + 1, dtype=np.uint64)[None, :] * np.uint64(2)
HALF = np.float32(0.5)


def unit(bits: np.ndarray, low: int) -> np.ndarray:
    """24 bits from bit ``low`` on as a number in (0, 1)."""
    return (((bits >> np.uint64(low)) & np.uint64(0xFFFFFF)).astype(np.float32) + HALF) * np.float32(2.0**-24)


def signatures(bags: list[Counter]) -> list[np.ndarray]:
    """The draws of each bag of terms; an empty bag has none. Terms of several bags are drawn once."""
    out: list[np.ndarray] = []
    group: list[np.ndarray] = []
    number: defaultdict[tuple[bytes, int], int] = defaultdict(lambda: len(number))

    def finish() -> None:
        if not number:
            out.extend(np.empty(0, np.uint16) for _ in group)
        else:
            log_a, token = draws([t for t, _ in number], np.fromiter((w for _, w in number), np.int64, len(number)))
            for places in group:
                if len(places):
                    best = log_a[places].argmin(axis=0)
                    out.append(token[places[best], np.arange(SAMPLES)])
                else:
                    out.append(np.empty(0, np.uint16))
        group.clear()
        number.clear()

    for bag in bags:
        group.append(np.fromiter(map(number.__getitem__, bag.items()), np.int64, len(bag)))
        if len(number) > AT_ONCE:
            finish()
    finish()
    return out


def hexed(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex() if len(signature) else EMPTY


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal draws; two texts without words are alike, one without words is like no other."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the next document."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
AT_A_TIME = 256  # documents of a batch that are held together with their edited texts


def compared(pairs: list[tuple]) -> pd.DataFrame:
    """Result rows of (doc_id, text, text of the next document)."""
    rows = []
    for at in range(0, len(pairs), AT_A_TIME):
        part = pairs[at : at + AT_A_TIME]
        changed = [edited(text, following) for _, text, following in part]
        # The next document's fingerprint is the following row's own, but for the last row of a part.
        ahead = [following for _, _, following in part]
        texts = [text for _, text, _ in part]
        follows = [k + 1 < len(part) and part[k + 1][1] == ahead[k] for k in range(len(part))]
        extra = [k for k, f in enumerate(follows) if not f]
        found = signatures([weights(t) for t in [*texts, *changed, *(ahead[k] for k in extra)]])
        own, new = found[: len(part)], found[len(part) : 2 * len(part)]
        late = dict(zip(extra, found[2 * len(part) :]))
        for k, (doc_id, text, _) in enumerate(part):
            digest = hashlib.sha256(changed[k].encode("utf-8", "replace")).hexdigest()
            after = own[k + 1] if follows[k] else late[k]
            rows.append((doc_id, len(text), digest, hexed(own[k]), hexed(new[k]), likeness(own[k], new[k]), likeness(own[k], after)))
    made = pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])
    return made.astype({"doc_id": "Int64"})


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: doc_id and the columns of ``RESULT``."""

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held = None
        for batch in batches:
            rows = [(None if missing else int(i), "" if t is None else t) for i, missing, t in zip(batch["id"], batch["missing"], batch["text"])]
            if held is None and rows:
                yield edge(part, "head", *rows[0])
            if held is not None:
                rows = [held, *rows]
            if len(rows) > 1:
                made = compared([(i, t, rows[k + 1][1]) for k, (i, t) in enumerate(rows[:-1])])
                yield made.assign(part=part, edge=None, text=None)
            held = rows[-1] if rows else held
        if held is not None:
            yield edge(part, "tail", *held)

    def edge(part: int, kind: str, doc_id: int | None, text: str) -> pd.DataFrame:
        made = compared([]).reindex([0]).assign(part=part, edge=kind, text=text)
        made["doc_id"] = pd.array([doc_id], "Int64")
        return made.astype({"n_chars": "Int64"})

    rows = docs.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("missing"), "text")
    order = [F.asc("missing"), F.desc("id")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order, F.desc_nulls_last("text"))
    done = materialize(ranged.mapInPandas(stream, f"{RESULT}, part int, edge string, text string"), "sampled")
    names = [c.split()[0] for c in RESULT.split(", ")]
    # Two rows per partition: each tail is followed by the next partition's head, the last one by the first.
    heads = done.where("edge = 'head'").select("part", F.col("text").alias("head"))
    following = F.coalesce(F.lead("head").over(Window.orderBy("part")), F.first("head").over(Window.orderBy("part")))
    tails = done.where("edge = 'tail'").select("part", "doc_id", "text").join(heads.select("part", following.alias("following")), "part")

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield compared([(None if missing else int(i), t, f) for i, missing, t, f in zip(batch["id"], batch["missing"], batch["text"], batch["following"])])

    ends = tails.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("missing"), "text", "following")
    return done.where("edge IS NULL").select(*names).unionByName(ends.mapInPandas(last, RESULT))
