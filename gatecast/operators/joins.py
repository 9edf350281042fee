"""Left joins that enrich matches. Sizes are left to AQE: it broadcasts a side it
has measured to be small and splits skewed partitions of the rest."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatecast.functions.dates import floor_hour
from gatecast.session import materialize


def one_per_key(right: DataFrame, keys: Sequence[str], expect: str) -> DataFrame:
    """Make sure a lookup side cannot multiply rows.

    ``many`` leaves it as it is (a plain SQL join), ``one`` fails the job on a
    repeated key, ``first`` keeps the smallest row per key.
    """
    if expect == "many":
        return right
    if expect not in ("one", "first"):
        raise ValueError("expect must be 'many', 'one' or 'first'")
    rest = [c for c in right.columns if c not in keys]
    grouped = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*rest)).alias("_r"))
    if expect == "one":
        filled = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        repeated = F.concat_ws(" ", F.lit("repeated key:"), *[F.col(k).cast("string") for k in keys])
        # The check sits in the kept value, so it cannot be pruned away.
        ok = F.when(~filled | (F.col("_n") == 1), F.col("_r")).otherwise(
            F.raise_error(repeated).cast(right.select(F.struct(*rest)).schema[0].dataType)
        )
        grouped = grouped.withColumn("_r", ok)
    return grouped.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def left_join(
    left: DataFrame, right: DataFrame, on: dict[str, str], picks: Sequence[str], expect: str = "many"
) -> DataFrame:
    """All rows and columns of ``left`` plus ``picks`` of ``right``.

    ``on`` maps left columns to right columns; a null key matches nothing.
    """
    keys = list(on.values())
    side = one_per_key(right.select(*dict.fromkeys([*keys, *picks])), keys, expect)
    renamed = side.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(c) for c in picks]
    )
    condition: Column = reduce(
        lambda a, b: a & b, [left[l] == renamed[f"_k{i}"] for i, l in enumerate(on)]
    )
    return left.join(renamed, condition, "left").select(
        *[left[c] for c in left.columns], *[renamed[c] for c in picks]
    )


def left_join_timestamp(matches, observations, key, observed, picks, expect="many") -> DataFrame:
    """Matches with the observation of the same time key."""
    return left_join(matches, observations, {key: observed}, picks, expect)


def left_join_date(matches, days, key, day, picks, expect="many") -> DataFrame:
    """Matches with the calendar entry of the same date; two entries on one date give two rows."""
    return left_join(matches, days, {key: day}, picks, expect)


def left_join_compound(matches, sales, on, picks, expect="many") -> DataFrame:
    """Matches with the row that agrees in all of several keys, e.g. year and round."""
    return left_join(matches, sales, on, picks, expect)


def enrich_star(matches: DataFrame, *sides: tuple, where: Column | None = None) -> DataFrame:
    """Chained left joins ``(right, on, picks[, expect])``, filtered last.

    The filter names columns of ``matches`` only, so Catalyst moves it below the joins.
    """
    out = matches
    for right, on, picks, *expect in sides:
        out = left_join(out, right, on, picks, *expect)
    return out.where(where) if where is not None else out


def hour_aligned_join(matches, observations, time, observed, picks, expect="many") -> DataFrame:
    """Matches with the observation of the full hour they start in."""
    keyed = matches.withColumn("_hour", floor_hour(F.col(time)))
    return left_join(keyed, observations, {"_hour": observed}, picks, expect).drop("_hour")


def keyed_lookup(observations: DataFrame, wanted: DataFrame, key: str, wanted_key: str) -> DataFrame:
    """Only the observations whose key occurs in ``wanted``.

    Wanted keys are made distinct before they move, so a key wanted often costs nothing.
    """
    keys = wanted.select(F.col(wanted_key).alias("_key")).distinct()
    return observations.join(keys, observations[key] == keys["_key"], "left_semi")


KEYS_PER_WORD = 4  # of a key filter: 16 bits and four set bits a key, about 2 of 100 other keys pass
MOST_WORDS = 1 << 20  # of a filter that is broadcast: 16 MB of words, for some four million keys


def _word_and_bits(key: Column, words: int) -> tuple[Column, Column]:
    """The word of a key, and its four bits in that word."""
    spread = F.xxhash64(key, F.lit(1))
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(spread, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(4)]
    return F.pmod(F.xxhash64(key), F.lit(words)), reduce(lambda a, b: a.bitwiseOR(b), bits)


def key_filter(keys: DataFrame, key: Column, count: int, most_words: int = MOST_WORDS) -> DataFrame | None:
    """A Bloom filter of ``count`` keys as rows (word, mask), or None where it would need more than ``most_words``.

    All bits of a key stand in one 64-bit word, so masks merge by a bitwise or per word, with map-side combine,
    and a look-up reads one row. The number of words grows with the keys.
    """
    words = 1 << max(0, (count - 1) // KEYS_PER_WORD).bit_length()
    if words > most_words:
        return None
    word, bits = _word_and_bits(key, words)
    return keys.select(word.alias("word"), bits.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("mask"))


def may_match(rows: DataFrame, filtered: DataFrame | None, key: Column, count: int, how: str = "left_semi") -> DataFrame:
    """The rows whose key may be one of the ``count`` keys of ``key_filter``: all that are, and few others. Nothing is exchanged.

    With ``how="left_anti"`` the rows whose key is none of them for sure.
    """
    if filtered is None:
        return rows if how == "left_semi" else rows.limit(0)
    word, bits = _word_and_bits(key, 1 << max(0, (count - 1) // KEYS_PER_WORD).bit_length())
    small = F.broadcast(filtered)
    return rows.join(small, (word == small["word"]) & (small["mask"].bitwiseAND(bits) == bits), how)


def keyed_lookup_large(observations: DataFrame, wanted: DataFrame, key: str, wanted_key: str, most_words: int = MOST_WORDS) -> DataFrame:
    """``keyed_lookup`` where neither side can be broadcast: the same rows, and only rows that can match are exchanged.

    A Bloom filter of the wanted keys (at most ``most_words`` words of 16 bytes, else there is none) drops observations
    before the exchange; an exact semi join decides the rest. It hashes the keys, so no observation is sorted, and the
    strategy is the same at every size. Exchanged: the distinct wanted keys, the observations wanted, and some
    2 in 100 of the others. AQE splits a key that many observations share. A null key matches nothing.
    """
    kind = observations.select(key).union(wanted.select(wanted_key)).schema[0].dataType  # both sides must hash the same type
    keys = materialize(wanted.select(F.col(wanted_key).cast(kind).alias("_key")).where("_key IS NOT NULL").distinct(), "wanted-keys")
    count = keys.count()
    asked = observations[key].cast(kind)
    near = may_match(observations.where(asked.isNotNull()), key_filter(keys, F.col("_key"), count, most_words), asked, count)
    return near.join(keys.hint("shuffle_hash"), asked == keys["_key"], "left_semi")


def without_keys(rows: DataFrame, unwanted: DataFrame, key: str, most_words: int = MOST_WORDS) -> DataFrame:
    """The rows whose ``key`` (of the same type and name on both sides, not null) is not in ``unwanted``, which holds each key once and is stored.

    Rows that the filter clears stay where they are; the few others are exchanged for an exact anti join, at every size.
    """
    count = unwanted.count()
    filtered = key_filter(unwanted, F.col(key), count, most_words)
    asked = may_match(rows, filtered, rows[key], count)
    left = asked.join(unwanted.select(F.col(key).alias("_key")).hint("shuffle_hash"), asked[key] == F.col("_key"), "left_anti")
    return left if filtered is None else may_match(rows, filtered, rows[key], count, "left_anti").unionByName(left)
