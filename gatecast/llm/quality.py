"""Quality rules: hashed n-gram log-likelihood ratio between trusted texts and the raw corpus.

Two multinomials over ``SLOTS`` hashed byte trigrams: one counts every document of the corpus, one
the documents labelled good. A document's score is the mean over its trigrams of
log(trusted / raw), so length does not matter. Shapes that the corpus has and trusted texts do not
(symbol noise, lists of cells, shouting) score far below zero whatever their words are.

Base rules come first (``base_statistics``): fewer than 50 words, or more than half of the words in
three-word windows that occur twice or more, fail a document. Then a document is kept if its score
reaches the threshold. The threshold is read off all labelled documents: the middle of the range
that separates good from bad with the fewest errors, in steps of ``STEP``; if one of the classes
has no scored document, it is ``NO_LABELS``.

Bounds: all labels take part in the trusted counts and in the threshold. Only texts that can have a good label move: a Bloom
filter of the labelled ids drops the others where they are read, an exact semi join by shuffle decides the rest, at every
size. For the threshold no text moves: documents that pass a filter of the labelled ids (of up to ``LABELLED``; beyond, all
documents) are scored where they are read, and (id, bin) is joined with the labels by shuffle. Ids that repeat in the documents
are split by AQE. Through the driver pass ``SLOTS`` counts and the score histogram, no labels. Corpus counts and decisions cover every document and every whole text. ``SLOTS`` is the size of the
hashed model: no trigram is left out, those that share a slot are counted together.

Nulls: a null text is empty (no words, base rules fail, score 0). A null id cannot be trusted and is
judged like any other. Labels with a null id or value are ignored; an id labelled both good and
bad is bad. Repeated rows are counted and judged each. Empty tables give empty results. Extra
columns stay; a column named like the new one gets a numbered neighbour.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatecast.llm.common import per_text
from gatecast.operators.joins import KEYS_PER_WORD, key_filter, keyed_lookup_large, may_match
from gatecast.session import materialize

SLOTS = 1 << 15
PIECES = 32  # of the counts of a task
GRAM = 3
LABELLED = 1 << 22  # labelled ids whose key filter is broadcast
STEP = 0.01
NO_LABELS = -0.5
LEAST_SCORE, MOST_SCORE = -20.0, 20.0  # of the histogram; scores beyond fall into the outer bins

# Fixed values of the base rules.
SPACES = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50

STATISTICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


@dataclass(frozen=True)
class Rules:
    """A fitted ratio: log(trusted / raw) per slot, and the least score of a kept document."""

    ratio: np.ndarray
    threshold: float


def slots(text: str) -> np.ndarray:
    """The slot of every byte trigram of a text (shorter texts are padded with zero bytes; an empty one has none)."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if not len(raw):
        return raw
    raw = np.append(raw, np.zeros(max(0, GRAM - len(raw)), np.uint32))
    places = len(raw) - GRAM + 1
    code = np.zeros(places, np.uint32)
    for k in range(GRAM):
        code = (code << np.uint32(8)) | raw[k : k + places]
    code = (code ^ (code >> np.uint32(15))) * np.uint32(0x9E3779B1)  # Fibonacci hashing; the high bits are the slot
    return code >> np.uint32(32 - SLOTS.bit_length() + 1)


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    numbers: defaultdict[bytes, int] = defaultdict(count().__next__)
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, n)
    size = len(numbers)
    if size > 2_000_000:  # the code of two words no longer leaves room for a third; number the pairs first
        pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1] * size + ids[2:]
    else:
        windows = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[inverse] >= 2
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= again
    return int(covered.sum())


def base_statistics(text: str) -> tuple[int, int, int, int, int, bool]:
    """The values of ``STATISTICS`` for one text."""
    words = text.encode("utf-8", "replace").split()  # bytes split at ASCII white space only
    spaces = sum(map(text.count, SPACES))
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    repeats = repeated_words(words)
    failed = len(words) < LEAST_WORDS or 100 * repeats > MOST_REPEATED_PERCENT * len(words)
    return len(words), len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, failed


def one_label(labels: DataFrame) -> DataFrame:
    """(doc_id, quality), one row per labelled id: the least value."""
    return labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))


def fit(docs: DataFrame, labels: DataFrame) -> Rules:
    """Count both multinomials over all documents, then place the threshold by the labelled ones."""
    # A task's counts travel in packed pieces, and the pieces of a place are added where they meet: few rows for many tasks.
    def counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for text in batch["text"]:
                if text:
                    seen += np.bincount(slots(text), minlength=SLOTS)
        pieces = [(k, piece.tobytes()) for k, piece in enumerate(seen.reshape(PIECES, -1)) if piece.any()]
        yield pd.DataFrame(pieces, columns=["piece", "counts"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, packed in zip(batch["piece"], batch["counts"]):
                sums[piece] = sums.get(piece, 0) + np.frombuffer(packed, np.int64)
        yield pd.DataFrame([(k, found.tobytes()) for k, found in sums.items()], columns=["piece", "counts"])

    def counted(texts: DataFrame) -> np.ndarray:
        packed = texts.select("text").mapInPandas(counts, "piece int, counts binary").repartition("piece")
        out = np.zeros((PIECES, SLOTS // PIECES))
        for row in packed.mapInPandas(add, "piece int, counts binary").collect():
            out[row["piece"]] = np.frombuffer(row["counts"], np.int64)
        return out.reshape(-1)

    good = one_label(labels).where("quality = 1")
    raw, trusted = counted(docs), counted(keyed_lookup_large(docs.select("doc_id", "text"), good, "doc_id", "doc_id"))
    if not trusted.any():
        return Rules(np.zeros(SLOTS), NO_LABELS)
    ratio = np.log((trusted + 1) / (trusted.sum() + SLOTS)) - np.log((raw + 1) / (raw.sum() + SLOTS))

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bins = [
                (i, math.floor(min(max(score(text, ratio), LEAST_SCORE), MOST_SCORE) / STEP))
                for i, text in zip(batch["id"], batch["text"])
                if text and not base_statistics(text)[-1]
            ]
            yield pd.DataFrame(bins, columns=["id", "bin"])

    known = one_label(labels).where("quality >= 0").select(F.col("doc_id").cast("long").alias("id"), (F.col("quality") != 0).cast("int").alias("good"))
    known = materialize(known, "quality-labels")
    many = known.count()
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").where("id IS NOT NULL")
    asked = may_match(rows, key_filter(known, F.col("id"), many, LABELLED // KEYS_PER_WORD), F.col("id"), many)
    scored = asked.mapInPandas(binned, "id long, bin int").join(known.hint("shuffle_hash"), "id")
    bins = scored.groupBy("bin", "good").agg(F.count(F.lit(1)).alias("n"))
    return Rules(ratio, threshold([tuple(r) for r in bins.collect()]))


def threshold(bins: list[tuple[int, int, int]]) -> float:
    """The middle of the longest range of thresholds with the fewest errors, from (bin, good, rows)."""
    if len({good for _, good, _ in bins}) < 2:
        return NO_LABELS
    first, last = min(b for b, _, _ in bins), max(b for b, _, _ in bins)
    good, bad = np.zeros(last - first + 2), np.zeros(last - first + 2)
    for b, is_good, n in bins:
        (good if is_good else bad)[b - first] += n
    # With the threshold at the lower border of bin k: good rows below are lost, bad rows from it on are kept.
    errors = np.append(0, np.cumsum(good))[:-1] + bad[::-1].cumsum()[::-1]
    best = np.flatnonzero(errors == errors.min())
    runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
    run = max(runs, key=len)
    return round((first + (run[0] + run[-1]) / 2) * STEP, 6)


def score(text: str, ratio: np.ndarray) -> float:
    """Mean log ratio of a text's trigrams, 0 for an empty text."""
    at = slots(text)
    return float(ratio[at].mean()) if len(at) else 0.0


def judged(text: Column, rules: Rules) -> Column:
    """A struct of ``STATISTICS``, kept and score for each text."""
    ratio, least = rules.ratio, rules.threshold

    def one(whole: str) -> tuple:
        statistics = base_statistics(whole)
        value = score(whole, ratio)
        return (*statistics, not statistics[-1] and value >= least, value)

    return per_text(one, STATISTICS + ", kept boolean, score double")(text)
