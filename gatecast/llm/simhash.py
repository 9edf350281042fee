"""SimHash near-dedup: fingerprints, pigeonhole blocks, Hamming check, classes.

A text becomes its lower-cased words (A-Z only), its word shingles, and their XXH64
values. A bit of the fingerprint is 1 if it is set in more than half of the values.

Exact links (``links``): fingerprints at ``max_bits`` or fewer differing bits. The 64 bits
are cut into ``blocks`` runs; a close pair differs in at most ``max_bits`` of them, so it
agrees in ``blocks - max_bits`` at least. Every choice of that many runs is a join key.
Rows are distinct fingerprints, not documents, so copies never meet each other, and a pair
is given out only under the first key it shares. More blocks mean longer keys (fewer chance
meetings) and more rows per fingerprint: 6 blocks give 15 keys of about 21 bits, 8 give 70
of 32 bits. ``blocks_for`` picks the number with the least expected work from the count of
distinct fingerprints; the links are the same for all.

Nulls and empty texts have the fingerprint zero and link like any other. Texts with fewer
words than a shingle have one shingle of all their words. Rows with a null id take part;
their component has the smallest id that is not null, or null if there is none. Repeated
rows and ids are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatecast.llm.common import free_name, per_text, quoted
from gatecast.operators.joins import without_keys
from gatecast.session import made_paths, materialize, remove_since

ROUNDS = 60  # of label spreading; every round at least squares the reach, so no table gets near it


def shingle_hashes(text: str, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every word shingle of a text, in order, repeats included."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII case and white space only
    if not parts:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([digest(joined, seed)], np.uint64)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1)[words - 1 :].tolist()
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, stops)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits set in over half of the hashes, as an unsigned number; zero for no hash."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):  # counts of 255 rows fit a byte
        rows = hashes[at : at + 255]
        bits = np.unpackbits(rows.astype(">u8").view(np.uint8).reshape(len(rows), -1), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(hashes)).view(">u8")[0])


def fingerprint(text: Column, words: int) -> Column:
    """The 64-bit fingerprint of each text, as a signed long."""

    def one(whole: str) -> tuple[int]:
        value = majority(shingle_hashes(whole, words))
        return (value - (value >> 63 << 64),)

    return per_text(one, "fp long")(text)["fp"]


def block_bounds(bits: int, blocks: int) -> list[tuple[int, int]]:
    """(first bit, width) of ``blocks`` runs that cover ``bits``, as even as can be."""
    ends = [bits * k // blocks for k in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def blocks_for(prints: int, max_bits: int = 4) -> int:
    """The blocks with the least expected work for so many distinct fingerprints: key rows, and the chance members of a key that each meets."""

    def work(blocks: int) -> float:
        return math.comb(blocks, max_bits) * (1 + prints / 2.0 ** (1 + 64 * (blocks - max_bits) / blocks))

    return min(range(max_bits + 2, max_bits + 9), key=work)


def links(prints: DataFrame, max_bits: int = 4, blocks: int = 6) -> DataFrame:
    """All pairs (a, b), a < b, of the distinct longs ``fp`` at ``max_bits`` or fewer differing bits, each once."""
    if blocks <= max_bits:
        raise ValueError("blocks must be more than max_bits")
    masks = [((1 << width) - 1) << first for first, width in block_bounds(64, blocks)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    shared = list(combinations(range(blocks), blocks - max_bits))
    unions = [reduce(lambda x, y: x | y, (masks[k] for k in group)) for group in shared]
    unions = [m - (1 << 64) if m >> 63 else m for m in unions]

    def keyed(name: str) -> DataFrame:
        keys = F.array(*[F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(unions)])
        return prints.select("fp", F.inline(keys)).withColumnRenamed("fp", name)

    a, b = keyed("a"), keyed("b")
    differ = F.col("a").bitwiseXOR(F.col("b"))
    # Blocks that agree, as a bit set; the first shared key is the one of the lowest agreeing blocks.
    same = [differ.bitwiseAND(F.lit(m)) == 0 for m in signed]
    first = F.lit(None).cast("int")
    for k, group in reversed(list(enumerate(shared))):
        first = F.when(reduce(lambda x, y: x & y, (same[g] for g in group)), F.lit(k)).otherwise(first)
    met = a.join(b, ["part", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(differ) <= max_bits) & (first == F.col("part")))
    return met.select("a", "b")


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b): root is the smallest node it reaches.

    Large-star and small-star rounds: every node hands its larger neighbours to its smallest
    one, then every node points at its smallest neighbour. Rows never exceed the edges, hubs
    are only ever met by aggregates with map-side combine and equi-joins that AQE splits, and
    each round is written to the shared folder, so a lost executor costs one round.
    """
    spark = edges.sparkSession
    mark = len(made_paths(spark))
    now = materialize(edges.select("a", "b").where("a != b").distinct(), label)
    before = None
    for _ in range(ROUNDS):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = materialize(large, label)
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u")
        moved = small.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        kept = lowest.select(F.col("u").alias("a"), F.col("m").alias("b"))
        now = materialize(moved.unionByName(kept).distinct(), label)
        remove_since(spark, mark, keep=1)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle within {ROUNDS} rounds")
    pairs = now.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    return pairs.unionByName(pairs.select(F.col("root").alias("node"), "root")).groupBy("node").agg(F.min("root").alias("root"))


def simhash_components(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per document: the id, its fingerprint (16 hex digits) and the smallest id of its component."""
    rows = materialize(docs.select(F.col(id_column).alias("id"), fingerprint(F.col(text), words).alias("fp")), "simhash")
    prints = materialize(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    found = components(links(prints.select("fp"), max_bits, blocks_for(prints.count(), max_bits)), "simhash-components")
    # The smallest fingerprint names a component; its smallest id is an aggregate over fingerprints.
    named = prints.join(found, prints["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    label = materialize(named.join(best, "root").select("fp", "component_id"), "simhash-labels")
    hexed = F.lower(F.lpad(F.hex(F.col("fp")), 16, "0"))
    return rows.join(label, "fp").select(F.col("id").alias(id_column), hexed.alias("fingerprint"), "component_id")


def without_near_copies(docs: DataFrame, text: str = "text", words: int = 4, max_bits: int = 4) -> DataFrame:
    """``docs`` with one row of each component: the one of smallest ``doc_id`` (null last, then any), same columns.

    Ids, fingerprints and row numbers are exchanged, and the rows that go, with the few that a filter of their numbers
    cannot tell from them; all others stay where they are stored.
    """
    names = [free_name(docs.columns, "near_row"), free_name(docs.columns, "near_print")]
    stored = materialize(docs.withColumns({names[0]: F.monotonically_increasing_id(), names[1]: fingerprint(quoted(text), words)}), "near-docs")
    rows = stored.select(F.col(names[0]).alias("row"), F.col("doc_id").alias("id"), F.col(names[1]).alias("fp"))
    place = F.struct(F.col("id").isNull().alias("missing"), "id", "row")
    prints = materialize(rows.groupBy("fp").agg(F.min(place).alias("place")), "near-distinct")
    found = components(links(prints.select("fp"), max_bits, blocks_for(prints.count(), max_bits)), "near-components")
    named = prints.join(found, prints["fp"] == found["node"], "left").select("fp", "place", F.coalesce("root", "fp").alias("root"))
    kept = named.groupBy("root").agg(F.min("place").alias("place")).select(F.col("place.row").alias("kept"))
    gone = rows.join(kept, rows["row"] == kept["kept"], "left_anti").select(F.col("row").alias(names[0]))
    return without_keys(stored, materialize(gone, "near-gone"), names[0]).select(*map(quoted, docs.columns))
