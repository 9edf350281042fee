"""Matches to the model frame: features, side inputs, cleaning, calendar fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatecast.functions import cases, dates
from gatecast.functions.labels import FIRST_MEETING, NO_HOLIDAY, NOT_PLAYED, RARE_OPPONENTS
from gatecast.functions.text import split_lenient, split_strict
from gatecast.operators.categorical import lump_rare
from gatecast.operators.columns import copy_column
from gatecast.operators.filters import like_any_case, played
from gatecast.operators.hotgroups import HOT_ROWS
from gatecast.operators.impute import impute_group_mean
from gatecast.operators.joins import enrich_star
from gatecast.operators.reshape import pivot_wider
from gatecast.operators.windows import Lag, RollingSum, RunningSum, add_history
from gatecast.session import materialize

# The columns of the side inputs.
WEATHER = ("precip_past1h", "temp_dry", "wind_speed")
SALES = ("d10_tilskuere", "d7_tilskuere", "d3_tilskuere")


def team_history(
    matches: DataFrame, order: Sequence[str], compat: str = "number", hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """Score, result, points and look-back features for every team.

    Each match becomes two rows, one per side, so all teams are worked at once and
    spread by team. ``order`` is the ingest order within a team.
    """
    split = split_lenient(matches, "resultat", ["hjemme_mål", "ude_mål"])
    split = split_strict(copy_column(split, "kamp", "_sides"), "_sides", ["hjemme", "ude"])
    sides = split.withColumn("_side", F.explode(F.array(F.lit(True), F.lit(False)))).withColumnRenamed("_side", "er_hjemme")
    home = F.col("er_hjemme")
    rows = (
        sides.withColumn("hold", F.when(home, F.col("hjemme")).otherwise(F.col("ude")))
        .withColumn("modstander", cases.opponent(F.col("hjemme"), F.col("ude"), F.col("hold")))
        .withColumn("mål", cases.side_pick(home, F.col("hjemme_mål"), F.col("ude_mål")).try_cast("double"))
        .withColumn("holdets_resultat", cases.result_class(F.col("hjemme_mål"), F.col("ude_mål"), home, compat))
        .withColumn("point_kamp", cases.points(F.col("holdets_resultat")))
    )
    return add_history(
        rows,
        {
            "mål_sidste_kamp": Lag("mål"),
            "mål_sidste3_lagged": RollingSum("mål", shift=1),
            "resultat_lagged": Lag("holdets_resultat"),
            "point_sidste3_lagged": RollingSum("point_kamp", shift=1),
            "point_sæson": RunningSum("point_kamp", ("sæson_år",)),
            "sidste_møde_tilskuere": Lag("tilskuere", within=("kamp",)),
            "sidste_møde_resultat": Lag("holdets_resultat", within=("modstander",)),
        },
        {"point_sæson_lagged": Lag("point_sæson")},
        team="hold",
        order=order,
        hot_rows=hot_rows,
    )


def add_times(df: DataFrame, zone: str = dates.ZONE) -> DataFrame:
    """Calendar year, local and UTC time, part of day, and the hour key of the observations."""
    df = df.withColumn("real_år", dates.season_to_year(F.col("sæson_år"), F.col("dato_tid")))
    df = df.withColumn("datotid", dates.parse_local_ts(F.col("real_år"), F.col("dato_tid")))
    hour = dates.floor_hour(dates.to_utc(F.col("datotid"), zone))
    return df.withColumns(
        {
            "tidspunkt": dates.day_part(F.col("datotid")),
            "time_key": dates.iso_key(hour),
            "day_key": dates.day_key(hour),
        }
    )


def weather_wide(observations: DataFrame) -> DataFrame:
    """One row per observation time with a column per wanted parameter."""
    return pivot_wider(observations, ["observed"], "parameterId", "value", WEATHER)


def enrich(history: DataFrame, weather: DataFrame, holidays: DataFrame, sales: DataFrame, team: str, expect: str = "many") -> DataFrame:
    """Home matches of one team with weather, holiday and advance sales."""
    return enrich_star(
        history.where((F.col("hold") == team) & F.col("er_hjemme")),
        (weather, {"time_key": "observed"}, ["temp_dry", "wind_speed", "precip_past1h"], expect),
        (holidays, {"day_key": "dato"}, ["helligdag"], expect),
        (sales, {"real_år": "år", "runde_nr": "runde"}, list(SALES), expect),
        where=like_any_case(F.col("kamp"), f"%{team}-%"),
    )


def clean(enriched: DataFrame) -> DataFrame:
    """Played matches with imputed last meetings, calendar fields and flags.

    Season, flags and other categories are text, so the model reads them as levels.
    """
    df = enriched.where(played(F.col("resultat"), NOT_PLAYED))
    df = impute_group_mean(df, "sidste_møde_tilskuere", "tilskuere")
    df = df.withColumns(
        {
            "sidste_møde_resultat": cases.null_to_label(F.col("sidste_møde_resultat"), FIRST_MEETING),
            "helligdag": cases.null_to_label(F.col("helligdag"), NO_HOLIDAY),
        }
    ).where(F.col("precip_past1h").isNotNull())
    df = df.withColumns(
        {
            "sommerferie": dates.holiday_season_flag(F.col("datotid")).cast("string"),
            "måned": dates.month(F.col("datotid")),
            "uge_nr": dates.week_of_year_simple(F.col("datotid")),
            "er_helligdag": cases.binary_flag(F.col("helligdag")).cast("string"),
        }
    )
    return lump_rare(df.drop("helligdag"), "modstander", 2, RARE_OPPONENTS)


# Predictors of the model frame, text ones first.
CATEGORIES = (
    "ugedag", "resultat_lagged", "sæson_år", "tidspunkt", "modstander", "sidste_møde_resultat", "sommerferie",
    "er_helligdag",
)
NUMBERS = (
    "mål_sidste_kamp", "runde_nr", "mål_sidste3_lagged", "point_sidste3_lagged", "point_sæson_lagged",
    "sidste_møde_tilskuere", "temp_dry", "wind_speed", "precip_past1h", "måned", "uge_nr",
)
TARGET = "tilskuere"


def model_frame(
    matches: DataFrame,
    observations: DataFrame,
    holidays: DataFrame,
    sales: DataFrame,
    team: str,
    order: Sequence[str],
    first_season: int = 2003,
    compat: str = "number",
    expect: str = "many",
) -> DataFrame:
    """The whole way from matches and side inputs to predictors and target of one team's home matches.

    The season bound comes after the look-backs, so that earlier seasons still feed them.
    """
    history = team_history(matches, order, compat)
    history = history.where(F.col("sæson_år").try_cast("int") >= first_season)
    enriched = enrich(add_times(history), weather_wide(observations), holidays, sales, team, expect)
    # Cleaning reads the rows several times (band means, level counts): stored once before.
    done = clean(materialize(enriched, "enriched"))
    return done.select("kamp", "datotid", *CATEGORIES, *NUMBERS, *SALES, TARGET)
