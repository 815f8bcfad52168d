"""Schema graphs: tables described in Markdown, their columns and foreign keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .graph_frames import Graph, edge_row, first_wins, node_row
from .outline import section_rows

_NAME = "column|field|name|col".split("|")
_TYPE = "type|datatype|data type|dtype".split("|")
_NOTE = "notes|note|description|desc|constraints|comment".split("|")
_SQL_TYPES = "|".join(sorted("INT INTEGER BIGINT SMALLINT SERIAL DECIMAL NUMERIC FLOAT DOUBLE CHAR VARCHAR TEXT BLOB UUID JSON BOOL BOOLEAN DATE DATETIME TIMESTAMP".split(), reverse=True))
_SQL_TYPE = rf"(?iU)\b(?:{_SQL_TYPES})[\w(,)]*\b"
_BULLET = r"^[•*-]\s*[`]?(\w+)[`]?\s*(?:\s|:)\s*(.+)$"


def _find(header: Column, names: list[str]) -> Column:
    """Place of the first name that some header cell holds, in the order of the names; null if none."""
    place = lambda n: F.nullif(F.array_position(F.transform(header, lambda h: F.contains(h, F.lit(n))), True), F.lit(0)) - 1
    return reduce(lambda a, b: F.coalesce(a, b), (place(n) for n in names))


def table_columns(sections: DataFrame) -> DataFrame:
    """Columns of the first pipe table of each section: (graph_id, source, i, title, c, def)."""
    lines = sections.select("graph_id", "source", "i", "title", F.posexplode(F.transform(T.split_lines(F.col("content")), T.strip)).alias("p", "line"))
    w = Window.partitionBy("graph_id", "i").orderBy("p")
    bar = F.rlike("line", F.lit(r"(?d)^\|.+\|$"))
    lines = lines.withColumn("bar", bar).withColumn("off", F.sum((~F.col("bar")).cast("int")).over(w)).where("bar")
    first = F.min("off").over(Window.partitionBy("graph_id", "i"))
    lines = lines.withColumn("first", first).where((F.col("off") == F.col("first")) & ~F.rlike("line", F.lit(r"(?U)^\|[\s:|-]+\|$")))
    cells = F.transform(F.split(F.btrim("line", F.lit("|")), r"\|"), T.strip)
    n = F.row_number().over(w)
    head = F.first(F.transform(cells, lambda c: F.lower(c))).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = lines.withColumns({"cells": cells, "c": n - 2, "head": head}).where("c >= 0")
    rows = rows.withColumns({"ni": F.coalesce(_find(F.col("head"), _NAME), F.lit(0)), "ti": F.coalesce(_find(F.col("head"), _TYPE), F.when(F.size("head") > 1, 1)), "oi": _find(F.col("head"), _NOTE)})
    at = lambda k: F.get("cells", F.col(k).cast("int"))
    name, kind, note = F.btrim(at("ni"), F.lit("` ")), F.nullif(at("ti"), F.lit("")), at("oi")
    low = F.lower(note)
    ref = F.nullif(F.regexp_extract(note, r"(?iU)\breferences?\s+(\w+)", 1), F.lit(""))
    pk = F.when(F.contains(low, F.lit("primary key")) | F.contains(low, F.lit(" pk")), "PK")
    full = F.when(F.contains(low, F.lit("not null")) | F.contains(low, F.lit("required")), "NOT NULL")
    made = F.concat_ws(" ", name, kind, pk, full, F.concat(F.lit("references "), ref))
    return rows.withColumn("def", made).where((name != "") & ~name.startswith("-")).select("graph_id", "source", "i", "title", "c", "def")


def bullet_columns(sections: DataFrame) -> DataFrame:
    """The same from bullets ``- name: TYPE, flags``."""
    lines = sections.select("graph_id", "source", "i", "title", F.posexplode(F.split("content", "\n")).alias("c", "line"))
    desc = F.regexp_replace(T.strip(F.regexp_extract("line", r"(?U)" + _BULLET, 2)), ",+$", "")
    name = F.regexp_extract("line", r"(?U)" + _BULLET, 1)
    kind = F.nullif(F.regexp_extract(desc, _SQL_TYPE, 0), F.lit(""))
    pk = F.when(F.rlike(desc, F.lit(r"(?iU)\bpk\b|\bprimary\s+key\b")), "PK")
    full = F.when(F.rlike(desc, F.lit(r"(?iU)\brequired\b|\bnot\s+null\b")), "NOT NULL")
    return lines.where(name != "").select("graph_id", "source", "i", "title", "c", F.concat_ws(" ", name, kind, pk, full).alias("def"))


def foreign_keys(tables: DataFrame) -> DataFrame:
    """(graph_id, src, dst) of tables (graph_id, id, label, content): explicit references, then columns named after
    a table (as it is, with s, without)."""
    names = tables.groupBy("graph_id", F.lower("label").alias("name")).agg(F.max_by("id", "pos").alias("dst"))
    said = tables.select("graph_id", F.col("id").alias("src"), F.explode(F.regexp_extract_all("content", F.lit(r"(?iU)\breferences?\s+(\w+)"), F.lit(1))).alias("x"))
    said = said.select("graph_id", "src", F.lower("x").alias("name"), F.lit(0).alias("rank"), F.lit("").alias("col"))
    first = F.get(F.split(T.strip(F.col("d")), r"(?U)\s+"), F.lit(0))
    base = F.lower(F.regexp_extract(first, r"(?i)^(.+)_id$", 1))
    cols = tables.select("graph_id", F.col("id").alias("src"), F.posexplode(F.split("content", ",")).alias("k", "d")).withColumn("b", base).where("b <> ''")
    guess = cols.select("graph_id", "src", F.col("k").cast("string").alias("col"), F.posexplode(F.array(F.col("b"), F.concat("b", F.lit("s")), F.rtrim(F.col("b"), F.lit("s")))).alias("rank", "name"))
    found = guess.join(names, ["graph_id", "name"]).groupBy("graph_id", "src", "col").agg(F.min_by("dst", "rank").alias("dst")).select("graph_id", "src", "dst")
    return said.join(names, ["graph_id", "name"]).select("graph_id", "src", "dst").union(found).where("src <> dst").distinct()


def schema_graph(docs: DataFrame) -> Graph:
    """Tables of docs (graph_id, source, text): pipe tables, or bullets in documents without any."""
    s = section_rows(docs, before=None).where("level IS NOT NULL")
    s = s.join(docs.where(F.rlike("text", F.lit(r"(?dm)^#{1,6}\s+.+$"))).select("graph_id"), "graph_id", "left_semi")
    a = table_columns(s)
    b = bullet_columns(s).join(a.select("graph_id").distinct(), "graph_id", "left_anti")
    cols = a.unionByName(b)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "def"))), lambda e: e["def"]), ", ")
    t = cols.groupBy("graph_id", "source", "i", "title").agg(text.alias("content"))
    t = t.withColumn("id", T.schema_table_id(F.col("title"), F.col("source")))
    nodes = first_wins(t.select(*node_row(F.col("graph_id"), F.col("id"), F.col("title"), F.col("content"), {"type": F.lit("table"), "source": F.nullif(F.coalesce("source", F.lit("")), F.lit(""))}, [F.col("i")])), ["graph_id", "node_id"])
    fk = foreign_keys(nodes.select("graph_id", F.col("node_id").alias("id"), "label", "content", "pos"))
    return Graph(nodes, fk.select(*edge_row(F.col("graph_id"), F.col("src"), F.col("dst"), "foreign_key", [F.lit(0)])))
