"""Graphs as frames: nodes, edges, roots; union with first-wins merge, health, snapshots."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NODES = "graph_id string, node_id string, label string, content string, type string, source string, attr_str map<string,string>, attrs_json string, pos array<long>"
EDGES = "graph_id string, src string, dst string, label string, pos array<long>"


@dataclass
class Graph:
    """Nodes and edges of any number of graphs, with the root of each."""

    nodes: DataFrame
    edges: DataFrame
    roots: DataFrame | None = None


def node_row(graph: Column, node: Column, label: Column, content: Column | None, attrs: dict[str, Column], pos: list[Column]) -> list[Column]:
    """The columns of NODES. String attributes go to attr_str too: only they can match a query."""
    none = F.lit(None).cast("string")
    strings = {k: v for k, v in attrs.items() if k in _STRINGS}
    entries = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in strings.items())), lambda e: e["value"].isNotNull()) if strings else None
    return [
        graph.alias("graph_id"),
        node.alias("node_id"),
        label.alias("label"),
        (none if content is None else content).alias("content"),
        attrs.get("type", none).cast("string").alias("type"),
        attrs.get("source", none).cast("string").alias("source"),
        (F.map_from_entries(entries) if entries is not None else F.create_map().cast("map<string,string>")).alias("attr_str"),
        F.to_json(F.struct(*(v.alias(k) for k, v in attrs.items()))).alias("attrs_json"),
        F.array(*(p.cast("long") for p in pos)).alias("pos"),
    ]


_STRINGS = frozenset(
    "type source document_id section extraction_method key term normalized_term evidence_kind decision_status confidence_value suffix status format mode image_format chart_signal reason".split()
)


def edge_row(graph: Column, src: Column, dst: Column, label: str | Column, pos: list[Column]) -> list[Column]:
    return [graph.alias("graph_id"), src.alias("src"), dst.alias("dst"), (F.lit(label) if isinstance(label, str) else label).alias("label"), F.array(*(p.cast("long") for p in pos)).alias("pos")]


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def first_wins(df: DataFrame, key: list[str]) -> DataFrame:
    """One row per key, the one with the smallest pos. The minimum is combined before the shuffle."""
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("pos", *(c for c in rest if c not in ("pos", "attr_str")))).alias("_b"))
    return best.select(*key, *(F.col(f"_b.{c}").alias(c) for c in rest)).select(*df.columns)


def merged(graph: Graph) -> Graph:
    """Nodes once per id, edges once per ends and label; nodes without an id go."""
    nodes = first_wins(graph.nodes.where(F.col("node_id").isNotNull() & (F.col("node_id") != "")), ["graph_id", "node_id"])
    return Graph(nodes, first_wins(graph.edges, ["graph_id", "src", "dst", "label"]), graph.roots)


def merge_graphs(graphs: list[Graph], graph_id: str | None = None) -> Graph:
    """Union in the order given, first wins; with ``graph_id``, all become one graph. The first root stays."""

    def placed(df: DataFrame, k: int) -> DataFrame:
        df = df.withColumn("pos", F.concat(F.array(F.lit(k).cast("long")), "pos"))
        return df.withColumn("graph_id", F.lit(graph_id)) if graph_id is not None else df

    out = merged(Graph(union_all(placed(g.nodes, k) for k, g in enumerate(graphs)), union_all(placed(g.edges, k) for k, g in enumerate(graphs))))
    out.roots = next((g.roots for g in graphs if g.roots is not None), None)
    return out


def health(graph: Graph) -> DataFrame:
    """One row per graph: counts, dangling edges, isolated nodes, histograms by type, label and source (sorted)."""
    n = graph.nodes.select("graph_id", F.col("node_id"), F.coalesce("type", F.lit("unknown")).alias("type"), "source")
    counts = n.groupBy("graph_id").agg(F.count(F.lit(1)).alias("node_count"))
    e = graph.edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edge_count"))
    dangling = dangling_edges(graph).groupBy("graph_id").agg(F.count(F.lit(1)).alias("dangling_edges"))
    alone = isolated_nodes(graph).groupBy("graph_id").agg(F.count(F.lit(1)).alias("isolated_nodes"))
    out = counts.join(e, "graph_id", "left").join(dangling, "graph_id", "left").join(alone, "graph_id", "left")
    for name, frame, key in (("types", n, "type"), ("sources", n.where("source IS NOT NULL AND source <> ''"), "source"), ("labels", graph.edges, "label")):
        hist = frame.groupBy("graph_id", key).agg(F.count(F.lit(1)).alias("n"))
        if key == "source":  # the eight largest
            w = Window.partitionBy("graph_id").orderBy(F.desc("n"), key)
            hist = hist.withColumn("k", F.row_number().over(w)).where("k <= 8")
        hist = hist.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("name"), "n"))).alias(name))
        out = out.join(hist, "graph_id", "left")
    return out.fillna(0, ["edge_count", "dangling_edges", "isolated_nodes"])


def dangling_edges(graph: Graph) -> DataFrame:
    """Edges of which an end isn't a node."""
    ids = graph.nodes.select("graph_id", F.col("node_id").alias("_n")).distinct()
    e = graph.edges
    for end in ("src", "dst"):
        e = e.join(ids.select("graph_id", F.col("_n").alias(end), F.lit(True).alias(f"_{end}")), ["graph_id", end], "left")
    return e.where("_src IS NULL OR _dst IS NULL").select(*graph.edges.columns)


def isolated_nodes(graph: Graph) -> DataFrame:
    """Nodes that no edge touches, but for the root."""
    ends = graph.edges.select("graph_id", F.col("src").alias("node_id")).union(graph.edges.select("graph_id", "dst")).distinct()
    out = graph.nodes.join(ends, ["graph_id", "node_id"], "left_anti")
    if graph.roots is not None:
        out = out.join(graph.roots.select("graph_id", F.col("current_node_id").alias("node_id")), ["graph_id", "node_id"], "left_anti")
    return out


def snapshot_delta(counts: DataFrame) -> DataFrame:
    """Of (target, snapshot, node_count, edge_count): the change since the snapshot before, by name."""
    w = Window.partitionBy("target").orderBy("snapshot")
    return counts.select(
        "*",
        F.lag("snapshot").over(w).alias("previous"),
        (F.col("node_count") - F.lag("node_count").over(w)).alias("node_delta"),
        (F.col("edge_count") - F.lag("edge_count").over(w)).alias("edge_delta"),
    )
