"""Target-distribution importance resampling over hashed n-grams, with a head-tail vocabulary.

A text's features are all runs of 1 to ``grams`` words, joined by one space; a feature's bucket is the CRC-32 of its bytes
modulo ``BUCKETS``. Bucket totals are counted over all documents (S features, s in the bucket) and all target texts (T, t).
A bucket's gain is floor(1000 * ln((t + 1)(S + B) / ((s + 1)(T + B)))), a document's weight the floored mean of the
gains of its features. A document's score is its weight plus Gumbel noise from a digest of its id; the documents of the
highest scores are the sample, drawn without replacement in proportion to exp(weight / 1000).

Head and tail: up to ``HEAD`` most frequent words of all documents, and up to ``HEAD`` most frequent pairs where runs have more
than one word, are broadcast with the CRC state after them (a few MB, whatever the corpus). A run's CRC goes on from the
state of its words before, so a run of head words costs one look-up. All others take the CRC of their bytes from
there. Both give the same number for the same bytes; the head only saves time, and no feature is left out.

Exchanged: word counts of the tasks, bucket totals of the tasks, and one row of numbers per document for the order of
scores. That order is a range partitioning by (score, id, row number), so no score or id can fill one task; ranks are
places inside a partition plus the rows of the partitions before.

Nulls: a null text has no words, weight 0. A null id is digested as the word null and comes last among equal scores.
Equal scores go by smaller id, rows that repeat an id by their row number. Repeated rows are counted and ranked each. Without
documents the result is empty; without target texts T is 0. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatecast.llm.common import per_text
from gatecast.session import materialize

BUCKETS = 10_000
HEAD = 50_000
HELD = 400_000  # different features that a task counts before it hands them on

# A-Z in lower case; digits, a-z and bytes above ASCII belong to words.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(LETTERS).split()


class States(dict):
    """CRC state after a head word; any other word's is computed."""

    def __missing__(self, word: bytes) -> int:
        return crc32(word)


@dataclass(frozen=True)
class Head:
    """CRC states after the frequent words and after the frequent pairs."""

    words: States
    pairs: dict[tuple[bytes, bytes], int]


def head_of(frequent: Iterable[bytes], pairs: Iterable[tuple[bytes, bytes]] = ()) -> Head:
    return Head(States((w, crc32(w)) for w in frequent), {(a, b): crc32(a + b" " + b) for a, b in pairs})


def feature_states(found: list[bytes], head: Head, grams: int) -> list[int]:
    """CRC-32 of every run of 1 to ``grams`` words."""
    before = list(map(head.words.__getitem__, found))
    states = list(before)
    for n in range(2, grams + 1):
        after = found[n - 1 :]
        if n == 2:
            known = map(head.pairs.get, zip(found, after))
            before = [crc32(b" " + word, state) if pair is None else pair for state, word, pair in zip(before, after, known)]
        else:
            before = [crc32(b" " + word, state) for state, word in zip(before, after)]
        states += before
    return states


def frequent_runs(texts: DataFrame, length: int, most: int = HEAD) -> list[tuple[bytes, ...]]:
    """Up to ``most`` most frequent runs of ``length`` words of all texts, counted exactly.

    Runs of about one frequency (within a twelfth part of a doubling) come together or not at all, so the driver
    gets ``most`` rows at most, and a row per frequency before that.
    """

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter[tuple[bytes, ...] | bytes] = Counter()
        for batch in batches:
            for text in batch["text"]:
                if text:
                    found = words(text)
                    seen.update(found if length == 1 else zip(*(found[k:] for k in range(length))))
                    if len(seen) > HELD:
                        yield framed(seen)
                        seen.clear()
        yield framed(seen)

    def framed(seen: Counter) -> pd.DataFrame:
        joined = seen if length == 1 else (b" ".join(run) for run in seen)
        return pd.DataFrame({"run": list(joined), "n": list(seen.values())}, columns=["run", "n"])

    summed = texts.select("text").mapInPandas(counts, "run binary, n long").groupBy("run").agg(F.sum("n").alias("n"))
    stored = materialize(summed.withColumn("level", F.floor(12 * F.log2("n")).cast("int")), "resample-runs")
    least, held = None, 0
    for row in sorted(stored.groupBy("level").count().collect(), reverse=True):  # some hundreds of levels
        held += row["count"]
        if held > most:
            break
        least = row["level"]
    frequent = stored.where(F.col("level") >= least) if least is not None else stored.limit(0)
    return [tuple(bytes(row["run"]).split(b" ")) for row in frequent.select("run").collect()]


def bucket_totals(texts: DataFrame, head: Head, grams: int, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts per bucket."""

    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch["text"]:
                if text:
                    states = feature_states(words(text), head, grams)
                    totals += np.bincount(np.array(states, np.int64) % buckets, minlength=buckets)
        used = np.flatnonzero(totals)
        yield pd.DataFrame({"bucket": used, "n": totals[used]})

    summed = texts.select("text").mapInPandas(counts, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    totals = np.zeros(buckets, np.int64)
    for row in summed:  # at most one row per bucket
        totals[row["bucket"]] = row["n"]
    return totals


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of every bucket."""
    size, all_raw, all_target = len(raw), float(raw.sum() + len(raw)), float(target.sum() + len(raw))
    return np.array([math.floor(1000 * math.log((t + 1.0) * all_raw / ((s + 1.0) * all_target))) for s, t in zip(raw.tolist(), target.tolist())], np.int64).reshape(size)


def weighed(text: Column, gain: np.ndarray, head: Head, grams: int) -> Column:
    """A struct of n_words, n_features and weight for each text."""
    buckets = len(gain)

    def one(whole: str) -> tuple[int, int, int]:
        found = words(whole)
        states = feature_states(found, head, grams)
        total = int(gain[np.array(states, np.int64) % buckets].sum()) if states else 0
        return len(found), len(states), total // len(states) if states else 0

    return per_text(one, "n_words long, n_features long, weight long")(text)


def noise(doc_id: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln u)) of a number u between 0 and 1 from a digest of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u)))


def resampled(docs: DataFrame, targets: DataFrame, grams: int = 1, percent: int = 10, least_words: int = 20, seed: str = "2024", head: int = HEAD) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank (1, 2, … for the documents drawn, null for the others)."""
    known = head_of((run[0] for run in frequent_runs(docs, 1, head)), frequent_runs(docs, 2, head) if grams > 1 else ())
    gain = gains(bucket_totals(docs, known, grams), bucket_totals(targets, known, grams))
    rows = docs.select("doc_id", weighed(F.col("text"), gain, known, grams).alias("w")).select("doc_id", "w.*")
    scored = rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("row", F.monotonically_increasing_id())
    stored = materialize(scored, "resample-scores")
    able = F.col("n_words") >= least_words
    # Places in the order of scores: the high bits of the number that Spark gives a row are its partition.
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    ordered = stored.where(able).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    ordered = materialize(ordered, "resample-order").withColumn("part", F.shiftright("place", 33))
    parts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    # One row per partition in these windows.
    everything, before = Window.partitionBy(), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.floor(F.sum("n").over(everything) * F.lit(percent) / 100).alias("drawn"))
    rank = F.col("start") + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    names = ["doc_id", "n_features", "weight", "score"]
    ranked = ordered.join(starts, "part").select(*names, F.when(rank <= F.col("drawn"), rank).cast("long").alias("rank"))
    return ranked.unionByName(stored.where(~able).select(*names, F.lit(None).cast("long").alias("rank")))
