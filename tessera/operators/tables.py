"""Markdown pipe tables of section contents, as rows of frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def _cells(line: Column) -> Column:
    clean = lambda c: F.btrim(F.regexp_replace(c, r"(?i)<br\s*/?>", " "), F.lit(" `"))
    return F.transform(F.split(F.btrim(line, F.lit("|")), r"\|"), clean)


def _collapsed(names: Column, cells: Column) -> Column:
    """Array of (k, v) by header: a name that stands twice keeps its first place and its last value."""
    pairs = F.transform(names, lambda n, i: F.struct(n.alias("k"), F.coalesce(F.get(cells, i), F.lit("")).alias("v")))
    return F.transform(F.array_distinct(names), lambda n: F.struct(n.alias("k"), F.try_element_at(F.filter(pairs, lambda e: e["k"] == n), F.lit(-1))["v"].alias("v")))


def table_runs(lines: Column, bar: Callable[[Column], Column], dash: Callable[[Column], Column]) -> Column:
    """Of an array of lines (none holds a line feed): an array of (head, dashes, body) of the runs of neighbouring lines
    with a bar in which a line of dashes follows another line; the body is the rest of the run, as an array."""
    marked = F.array_join(F.transform(lines, lambda x: F.when(bar(x), x).otherwise("")), "\n")
    runs = F.transform(F.split(marked, "\n{2,}"), lambda r: F.filter(F.split(r, "\n"), lambda x: x != ""))
    placed = F.transform(runs, lambda r: F.struct(r.alias("x"), F.array_position(F.transform(r, lambda x, k: (k > 0) & dash(x)), True).cast("int").alias("sep")))
    return F.transform(
        F.filter(placed, lambda r: r["sep"] > 0),
        lambda r: F.struct(
            F.get(r["x"], r["sep"] - 2).alias("head"),
            F.get(r["x"], r["sep"] - 1).alias("dashes"),
            F.slice(r["x"], r["sep"] + 1, F.size(r["x"]) - r["sep"]).alias("body"),
        ),
    )


def markdown_tables(sections: DataFrame) -> DataFrame:
    """Of sections (graph_id, i, content, ...): a row per table row, with t (number of the table in the section),
    headers, content (of the table), n_rows, r, row (array of k, v) and row_text.

    A table is a header line, a line of dashes and at least one row with text, all in one run of lines that
    begin and end with a bar; what follows the dashes belongs to the table up to the end of the run. A section is
    read in its row, without a shuffle."""
    bar = lambda x: x.startswith("|") & x.endswith("|") & (F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2)
    dash = lambda x: F.forall(F.split(F.btrim(x, F.lit("|")), r"\|"), lambda c: F.rlike(T.strip(c), F.lit("^:?-{3,}:?$")))
    runs = table_runs(F.transform(T.split_lines(F.col("content")), T.strip), bar, dash)
    full = lambda body: F.filter(F.transform(body, lambda x: F.struct(x.alias("line"), _cells(x).alias("cells"))), lambda e: F.exists(e["cells"], lambda c: c != ""))
    found = F.filter(F.transform(runs, lambda r: F.struct(r["head"].alias("head"), r["dashes"].alias("dashes"), full(r["body"]).alias("body"))), lambda t: F.size(t["body"]) > 0)
    tabs = sections.select("graph_id", "i", F.posexplode(found).alias("t", "tab"))
    whole = F.concat_ws("\n", F.col("tab.head"), F.col("tab.dashes"), F.col("tab.body.line"))
    tabs = tabs.select("graph_id", "i", "t", _cells(F.col("tab.head")).alias("headers"), whole.alias("table_content"), F.size("tab.body").alias("n_rows"), "tab.body")
    rows = tabs.select("*", F.posexplode("body.cells").alias("r", "cells"))
    names = F.transform("headers", lambda h, k: F.when(h == "", F.concat(F.lit("column_"), k + 1)).otherwise(h))
    rows = rows.withColumn("row", _collapsed(names, F.col("cells")))
    text = F.array_join(F.transform(F.filter("row", lambda e: e["v"] != ""), lambda e: F.concat(e["k"], F.lit(": "), e["v"])), " | ")
    return rows.select("graph_id", "i", "t", "headers", F.col("table_content").alias("content"), F.col("n_rows").cast("long").alias("n_rows"), "r", "row", text.alias("row_text"))


def is_evidence(row_text: Column) -> Column:
    """A digit, a per cent sign or a cue."""
    return F.rlike(row_text, F.lit(r"(?U)\d|%")) | T.has_cue(row_text, T.EVIDENCE_CUES)
