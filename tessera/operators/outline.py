"""Section and paragraph graphs of a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .graph_frames import Graph, edge_row, first_wins, node_row


def section_rows(docs: DataFrame, before: str | None = "Preface", alone: str = "Document") -> DataFrame:
    """docs (graph_id, source, text) to (graph_id, source, i, title, level, content), i counting sections from 0."""
    parts = T.sections(F.coalesce("text", F.lit("")), before, alone)
    return docs.select("graph_id", "source", F.posexplode(parts).alias("i", "s")).select("graph_id", "source", "i", "s.title", "s.level", "s.content")


def with_parents(sections: DataFrame) -> DataFrame:
    """Adds parent: the i of the nearest earlier heading of a smaller level."""
    w = Window.partitionBy("graph_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == k, F.col("i")), ignorenulls=True).over(w) for k in range(1, 7)]
    return sections.withColumn("_l", F.array(*last)).withColumn(
        "parent", F.array_max(F.filter(F.slice("_l", F.lit(1), F.greatest(F.col("level") - 1, F.lit(0))), lambda x: x.isNotNull()))
    ).drop("_l")


def heading_mentions(sections: DataFrame) -> DataFrame:
    """(graph_id, i, j): the content of section i holds the title of section j, in any case. Of equal titles the
    last section stands for all."""
    t = sections.groupBy("graph_id", F.lower("title").alias("t")).agg(F.max("i").alias("j")).where("t <> ''")
    return sections.join(t, "graph_id").where(F.contains(F.lower("content"), F.col("t")) & (F.col("i") != F.col("j"))).select("graph_id", "i", "j")


def section_graph(docs: DataFrame) -> Graph:
    """A node per heading, references edges by titles in contents, contains edges by level. Text before the first
    heading is lost; a text without headings is one node."""
    s = with_parents(section_rows(docs, before=None))
    nid = F.concat(T.word_slug(F.col("title"), 40), F.lit("_"), F.col("i"))
    s = s.withColumn("id", nid)
    nodes = s.select(*node_row(F.col("graph_id"), F.col("id"), F.col("title"), F.col("content"), {"level": F.col("level"), "source": F.col("source")}, [F.col("i")]))
    names = s.select("graph_id", F.col("i").alias("_i"), F.col("id").alias("_id"))
    refs = heading_mentions(s).join(s.select("graph_id", "i", "id"), ["graph_id", "i"]).join(names, (F.col("_i") == F.col("j")) & (names.graph_id == s.graph_id)).select(s.graph_id, "id", "_id", "i", "j")
    refs = refs.select(*edge_row(F.col("graph_id"), F.col("id"), F.col("_id"), "references", [F.lit(0), F.col("i"), F.col("j")]))
    held = s.where("parent IS NOT NULL").join(names, (names.graph_id == s.graph_id) & (F.col("_i") == F.col("parent")))
    held = held.select(*edge_row(s.graph_id, F.col("_id"), F.col("id"), "contains", [F.lit(1), F.col("i"), F.lit(0)]))
    return Graph(nodes, refs.unionByName(held))


def paragraph_graph(docs: DataFrame) -> Graph:
    """A node per paragraph, followed_by edges between neighbours."""
    p = docs.select("graph_id", "source", F.posexplode(T.paragraphs(F.coalesce("text", F.lit("")))).alias("i", "body"))
    first = F.get(F.split("body", r"(?<=[?!.])\s+"), F.lit(0))
    name = F.coalesce(F.nullif(T.strip(T.cut(first, 80)), F.lit("")), F.concat(F.lit("Paragraph "), F.col("i") + 1))
    p = p.withColumns({"id": F.concat(T.word_slug(F.coalesce("source", F.lit("")), 40), F.lit("_"), F.col("i")), "name": name})
    nodes = p.select(*node_row(F.col("graph_id"), F.col("id"), F.col("name"), F.col("body"), {"index": F.col("i"), "source": F.col("source")}, [F.col("i")]))
    after = F.lead("id").over(Window.partitionBy("graph_id").orderBy("i"))
    edges = p.withColumn("after", after).where("after IS NOT NULL").select(*edge_row(F.col("graph_id"), F.col("id"), F.col("after"), "followed_by", [F.col("i")]))
    return Graph(nodes, edges)


__all__ = ["first_wins", "heading_mentions", "paragraph_graph", "section_graph", "section_rows", "with_parents"]
