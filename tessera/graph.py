"""DocumentGraph: a facade over nodes and edges as DataFrames."""

from __future__ import annotations

import json
import re
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import graph_frames as G
from .operators import links, rank
from .operators.corpus import corpus_graph, local
from .operators.decision import decision_graph
from .operators.knowledge import knowledge_graph
from .operators.media import media_graph
from .operators.outline import paragraph_graph, section_graph
from .operators.schema_docs import schema_graph
from .sources import loaders

#: Of these, the media graph is part of the graph ``all``.
IMAGES = ".bmp .gif .jpeg .jpg .png .tif .tiff .webp".split()


def _media(docs: DataFrame) -> G.Graph:
    """Media graphs of documents; only those with a length (image files) get file metadata."""
    return media_graph(docs if "length" in docs.columns else docs.withColumn("length", F.lit(None).cast("long")))


BUILDERS = {"media": _media, "knowledge": knowledge_graph, "decision": decision_graph, "schema": schema_graph, "section": section_graph, "paragraph": paragraph_graph}


def register_extractor(name: str, build) -> None:
    """Makes ``build`` (documents to Graph) available as a graph type."""
    BUILDERS[name] = build


def build_graph(docs: DataFrame, kind: str = "knowledge") -> G.Graph:
    """Documents (graph_id, source, text) to graphs of a type; ``all`` merges knowledge, decision and schema, and
    media for images."""
    if kind == "all":
        images = docs.where(loaders.suffix_of(F.col("source")).isin(IMAGES))
        return G.merge_graphs([*(BUILDERS[k](docs) for k in ("knowledge", "decision", "schema")), BUILDERS["media"](images)])
    return BUILDERS[kind](docs)


class DocumentGraph:
    """One graph (all rows share graph_id). Frames are immutable: adding returns the same object with new frames."""

    def __init__(self, spark: SparkSession, nodes: DataFrame, edges: DataFrame):
        self.spark, self.nodes, self.edges = spark, nodes, edges

    @classmethod
    def from_dict(cls, spark: SparkSession, graph: dict) -> DocumentGraph:
        def text(a: dict) -> dict:
            return {k: v for k, v in a.items() if isinstance(v, str)}

        rows = []
        for i, n in enumerate(graph.get("nodes", [])):
            a = n.get("attributes") or {}
            rows.append(("g", n.get("id"), n.get("label"), n.get("content"), a.get("type"), a.get("source"), text(a), json.dumps(a, sort_keys=True), [i]))
        edges = [("g", e["from"], e["to"], e["label"], [i]) for i, e in enumerate(graph.get("edges", []))]
        return cls(spark, spark.createDataFrame(rows, G.NODES), spark.createDataFrame(edges, G.EDGES))

    @classmethod
    def from_texts(cls, spark: SparkSession, docs: list[dict]) -> DocumentGraph:
        """Documents with title and content, linked where one names another's title. Equal ids raise ValueError."""
        df = spark.createDataFrame([(i, d["title"], d["content"]) for i, d in enumerate(docs)], "i int, title string, content string")
        none = F.lit(None).cast("string")
        nodes = df.select(F.lit("g").alias("graph_id"), T.word_slug(F.col("title")).alias("node_id"), F.col("title").alias("label"), "content", none.alias("type"), none.alias("source"), F.create_map().cast("map<string,string>").alias("attr_str"), F.lit("{}").alias("attrs_json"), F.array(F.col("i").cast("long")).alias("pos"))
        twice = nodes.groupBy("node_id").count().where("count > 1").first()
        if twice:
            raise ValueError(f"duplicate node id {twice.node_id!r}")
        e = links.title_links(nodes).select(F.lit("g").alias("graph_id"), "src", "dst", "label", F.array(F.lit(0).cast("long")).alias("pos"))
        return cls(spark, nodes, e)

    @classmethod
    def from_document(cls, spark: SparkSession, path: str, kind: str = "knowledge") -> DocumentGraph:
        """A file's graph, or that of a folder: its files' graphs below nodes of folders and files, with links across."""
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            raise FileNotFoundError(path)
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        if fs.getFileStatus(at).isDirectory():
            root = re.sub("^file:/*", "/", fs.makeQualified(at).toString())
            g = corpus_graph(spark, files, root, lambda docs: build_graph(docs, kind))
            return cls(spark, g.nodes, g.edges)
        read = loaders.load(files)
        lost = read.where("error IS NOT NULL").first()
        if lost:
            raise ValueError(f"{path}: {lost.error}")
        g = G.merged(build_graph(read.select(F.lit("g").alias("graph_id"), local(F.col("path")).alias("source"), "text"), kind))
        return cls(spark, g.nodes, g.edges)

    from_directory = from_document

    def add_node(self, node_id: str, label: str, *, content: str | None = None, attributes: dict | None = None) -> DocumentGraph:
        if self.nodes.where(F.col("node_id") == node_id).limit(1).count():
            raise ValueError(f"duplicate node id {node_id!r}")
        new = self.from_dict(self.spark, {"nodes": [{"id": node_id, "label": label, "content": content, "attributes": attributes}]}).nodes
        self.nodes = self.nodes.unionByName(new.withColumn("pos", F.array(F.lit(2**62).cast("long"))))
        return self

    def add_edge(self, src: str, dst: str, label: str) -> DocumentGraph:
        self.edges = self.edges.unionByName(self.from_dict(self.spark, {"edges": [{"from": src, "to": dst, "label": label}]}).edges)
        return self

    def rank(self, query: str, *, k: int = 5, alpha: float = 0.85) -> dict:
        """The k best nodes for the query, their neighbours and the edges among them, as plain data."""
        nodes = G.first_wins(self.nodes, ["graph_id", "node_id"])
        top = rank.top_k(rank.personalized_page_rank(query, nodes, self.edges, alpha=alpha), nodes, k)
        kept, inner = rank.context(top, nodes, self.edges)
        found = kept.orderBy("pos").collect()
        name = {r.node_id: r.label for r in found}
        out = []
        for r in found:
            n = {"label": r.label, "content": r.content, "attributes": json.loads(r.attrs_json or "{}")}
            out.append(n | ({"score": r.score} if r.score is not None else {}))
        return {"nodes": out, "edges": [{"label": e.label, "from": name[e.src], "to": name[e.dst]} for e in inner.orderBy("pos").collect()]}

    def to_dict(self) -> dict:
        nodes = []
        for r in self.nodes.orderBy("pos").collect():
            n = {"id": r.node_id, "label": r.label} | ({"content": r.content} if r.content is not None else {})
            a = json.loads(r.attrs_json or "{}") or {}
            nodes.append(n | ({"attributes": a} if a else {}))
        return {"nodes": nodes, "edges": [{"from": e.src, "to": e.dst, "label": e.label} for e in self.edges.orderBy("pos").collect()]}

    def to_json(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.to_dict(), f, indent=2, sort_keys=True, ensure_ascii=False)

    def to_graphml(self, path: str) -> None:
        g = self.to_dict()
        with open(path, mode="w", encoding="utf8") as f:
            f.write('<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<key id="l" for="all" attr.name="label" attr.type="string"/>\n<graph edgedefault="directed">\n')
            for n in g["nodes"]:
                f.write(f'<node id={quoteattr(n["id"])}><data key="l">{escape(n["label"] or "")}</data></node>\n')
            for e in g["edges"]:
                f.write(f'<edge source={quoteattr(e["from"])} target={quoteattr(e["to"])}><data key="l">{escape(e["label"])}</data></edge>\n')
            f.write("</graph>\n</graphml>\n")

    def health(self) -> DataFrame:
        return G.health(G.Graph(self.nodes, self.edges))

    def __len__(self) -> int:
        return self.nodes.count()
