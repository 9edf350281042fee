"""Mixing sources to target weights by systematic sampling.

Targets: the mix takes ``share`` times all words. Sources, in code point order with null last,
weigh ``weights`` in turn. A target stops at ``most`` times its source's size and the excess goes
to the others by weight until none is above. That water level has a closed form: order sources by
(cap / weight); if the first k are full, the level is (budget - their caps) / (weights of the rest),
and k is the number of sources whose own ratio lies below the level reached with the ones before.

Sampling: every document of a source has the same expected copies, target / size of its source. With
documents in a fixed order, copies so far are rank * expected + offset; a document is emitted once
per integer this passes. The order is by size, then by a digest of the id, so at every size the
copies are less than one off and the words taken differ from the target by less than one largest
document of the source. The offset is drawn per source from a digest of the seed, so reruns agree.

Ranks need no task that holds a source: counts per (source, size) give the documents of smaller
size, a size with n documents is cut by digest into about sqrt(n) / 4 slots of 4 * sqrt(n) rows, and
only inside a slot are rows numbered, so neither the slots of a size nor the rows of a slot pile up.
Equal digests (repeated ids) stay in one slot.

Nulls: a null text has size 0, a null source is a source of its own, a null id is digested as
such. Ties (equal size and digest) are the same document repeated; which of them is numbered first
does not change the words taken. Sources without words have the target 0. An empty table gives an
empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gatecast.llm.common import free_name, quoted, word_count
from gatecast.session import materialize

WEIGHTS = (3, 1, 2)


def unit(text: Column) -> Column:
    """A number in [0, 1) from the MD5 of a text, the same in any engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source of (source, size): source_size, target. Windows here see one row per source."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    turn = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    everything = Window.partitionBy()
    listed = sizes.select("source", "source_size", weight.alias("weight")).withColumns(
        {"cap": F.col("source_size") * F.lit(float(most)), "budget": F.sum("source_size").over(everything) * F.lit(float(share))}
    )
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    leveled = listed.withColumn("level", level).withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    # The level that holds is the one at the first source that is not full.
    final = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.col("final") * F.col("weight"))
    return leveled.withColumn("final", final).select("source", "source_size", target.alias("target"))


def copies(sized: DataFrame, seed: str = "mix", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sized`` (doc_id, source, size and any others, stored) with source_size, target and copies."""
    hashed = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = sized.withColumns({"mix_digest": hashed, "mix_source": F.coalesce("source", F.lit("")), "mix_null": F.col("source").isNull()})
    key = ["mix_source", "mix_null", "size"]
    by_size = Window.partitionBy("mix_source", "mix_null").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    groups = rows.groupBy(*key).agg(F.count("*").alias("mix_rows"))
    groups = groups.select(*key, F.ceil(F.sqrt(F.col("mix_rows") / 16)).alias("mix_slots"), F.coalesce(F.sum("mix_rows").over(by_size), F.lit(0)).alias("mix_below"))
    targets = source_targets(sized, weights, share, most).select(
        F.coalesce("source", F.lit("")).alias("mix_source"), F.col("source").isNull().alias("mix_null"), "source_size", "target"
    )
    groups = materialize(groups.join(targets, ["mix_source", "mix_null"]), "mix-groups")
    share_of = F.conv(F.substring("mix_digest", 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    slotted = rows.join(groups, key).withColumn("mix_slot", F.floor(share_of * F.col("mix_slots")))
    cells = groups.where("mix_slots > 1").select(*key, "mix_slots").join(rows, key).groupBy(*key, F.floor(share_of * F.col("mix_slots")).alias("mix_slot"))
    earlier = Window.partitionBy(*key).orderBy("mix_slot").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.agg(F.count("*").alias("n")).select(*key, "mix_slot", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("mix_earlier"))
    inside = Window.partitionBy(*key, "mix_slot").orderBy("mix_digest")
    ranked = slotted.join(cells, [*key, "mix_slot"], "left").withColumn(
        "mix_rank", F.col("mix_below") + F.coalesce("mix_earlier", F.lit(0)) + F.row_number().over(inside)
    )
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = unit(F.concat(F.lit(f"{seed}|offset|"), F.when(F.col("mix_null"), F.lit("n")).otherwise(F.lit("s")), F.col("mix_source")))
    passed = F.floor(F.col("mix_rank") * expected + offset) - F.floor((F.col("mix_rank") - 1) * expected + offset)
    return ranked.select(*sized.columns, "source_size", "target", passed.cast("long").alias("copies"))


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words the mix takes from it, repeats counted)."""
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    return copies(sized, seed).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with the same columns.

    Rows are stored once with a number of their own, so copies find their row whatever the ids are.
    """
    number = free_name(docs.columns, "row_number")
    stored = materialize(docs.withColumn(number, F.monotonically_increasing_id()), "mix-rows")
    sized = stored.select(F.col(number).alias("mix_row"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    taken = copies(materialize(sized, "mix-sizes"), seed).where("copies > 0").select("mix_row", F.sequence(F.lit(1), F.col("copies").cast("int")).alias("mix_times"))
    names = [quoted(c) for c in docs.columns]
    rows = stored.select(F.col(number).alias("mix_number"), F.struct(*names).alias("mix_whole"))  # columns of any name travel in one struct
    each = rows.join(taken, rows["mix_number"] == taken["mix_row"]).select("mix_whole", F.explode("mix_times"))
    return each.select(*[F.col("mix_whole")[c].alias(c) for c in docs.columns])
