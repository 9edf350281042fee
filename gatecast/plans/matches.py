"""Stored schedule pages to one row per match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gatecast.functions.text import parse_grouped_number, parse_number
from gatecast.sources.pages import html_rows

# The columns of a schedule table, by position.
COLUMNS = ("ugedag", "dato_tid", "kamp", "resultat", "tilskuere", "dommer", "tv")
KEYS = ("sæson_år", "runde_nr")
ORDER = ("sæson_år", "page", "table_no", "row_no")


def matches_from_pages(
    pages: DataFrame, season: str = "season", within: str = "#content", grouped: bool = False, page: str | None = None
) -> DataFrame:
    """One row per match of every schedule table, with season, round and ingest order.

    ``pages`` holds (season, html) and, where a season has several pages, a column ``page``
    that tells them apart and orders them; without it a digest of the page does (so a page
    stored twice counts once). The round is the number in a table's first header cell, and
    only rows of header cells are left out. Attendance is printed in thousands and scaled
    up; ``grouped`` reads the mark as a thousands mark instead, which keeps numbers printed
    without one.
    """
    keyed = pages.select(season, "html", (F.col(page) if page else F.md5("html")).alias("page"))
    cells = html_rows(keyed, keep=[season, "page"], within=within)
    rows = cells.groupBy(season, "page", "table_no", "row_no").agg(
        *[F.max(F.when(F.col("col_no") == i, F.col("cell"))).alias(c) for i, c in enumerate(COLUMNS, 1)],
        F.max("head").alias("_head"),
        F.max(F.col("tag") != "th").alias("_body"),
    )
    text: dict[str, Column] = {c: F.nullif(F.col(c), F.lit("")) for c in COLUMNS}
    number = parse_grouped_number(text["tilskuere"]) if grouped else text["tilskuere"].try_cast("double") * 1000
    return rows.where("_body").select(
        *[(number if c == "tilskuere" else text[c]).alias(c) for c in COLUMNS],
        F.col(season).cast("string").alias("sæson_år"),
        parse_number(F.col("_head")).alias("runde_nr"),
        "page",
        "table_no",
        "row_no",
    )
