"""The graph of a folder: corpus, manifest, folder and file nodes around the graphs of its files, and the links between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import loaders, scan
from . import links
from .graph_frames import Graph, edge_row, merged, node_row, union_all
from .lineage import cut_lineage


def local(path: Column) -> Column:
    """A path of this machine without its scheme; others as they are."""
    return F.regexp_replace(path, "^file:/*", "/")


def _name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def corpus_graph(spark: SparkSession, files: DataFrame, root: str, extract) -> Graph:
    """files (path, length, content) of the binaryFile source below ``root`` to one graph, ``extract`` making the
    graphs (graph_id: the source) of docs (graph_id, source, text).

    Every file of a supported suffix has a node, below nodes of its folders; what can't be read has status failed and
    a load_error node, the rest an extracted_as edge to the root of its graph, if it has one. Files of other suffixes
    have a skipped_file node. Nodes of the corpus come before those of files, which come in depth-first order;
    of equal ids the first stays. Then come links to files and mentions across files.
    """
    g, static = F.lit("g"), F.lit("static")
    rel = F.substring(local(F.col("path")), F.lit(len(root.rstrip("/")) + 2), F.length("path"))
    listed = scan.select_files(files.select("path", F.col("length").alias("size"), rel.alias("rel")), loaders.SUPPORTED)
    listed = cut_lineage(listed.withColumn("source", local(F.col("path"))))
    chosen = cut_lineage(scan.numbered(listed.where("reason IS NULL"), "seq", "n").withColumn("n", F.col("n") - 1))
    loaded = cut_lineage(loaders.load(files.where(loaders.suffix_of(F.col("path")).isin(loaders.SUPPORTED))))

    own = chosen.join(loaded.select("path", "error"), "path")
    kind = F.regexp_extract("error", r"^(\w+): ", 1)
    told = F.when(kind != "", F.substring(F.col("error"), F.length(kind) + 3, F.length("error"))).otherwise(F.col("error"))
    own = own.withColumns({"file": T.corpus_id("file", F.col("rel")), "type": F.when(F.col("error").isNotNull(), F.when(kind != "", kind).otherwise("ImportError")), "told": told})
    own = cut_lineage(own.withColumn("status", F.when(F.col("error").isNull(), "extracted").otherwise("failed")))
    lost, skipped = own.where("error IS NOT NULL"), listed.where("reason IS NOT NULL")
    top, manifest = T.corpus_id("corpus", F.lit(root)), T.corpus_id("corpus_manifest", F.lit(root))

    depth = F.explode(F.sequence(F.lit(1), F.size("parts") - 1))
    folders = own.select("n", F.split("rel", "/").alias("parts")).where("size(parts) > 1").select("n", "parts", depth.alias("k"))
    folders = folders.select("n", "k", F.array_join(F.slice("parts", F.lit(1), F.col("k")), "/").alias("rel")).groupBy("rel", "k").agg(F.min("n").alias("n"))

    def inside(rel: Column) -> Column:
        """The id of the folder that holds rel."""
        parent = F.regexp_extract(rel, r"^(.*)/[^/]*$", 1)
        return F.when(parent == "", top).otherwise(T.corpus_id("folder", parent))

    base = {"source": F.col("source"), "relative_path": F.col("rel"), "suffix": F.col("suffix")}
    place, error = [F.lit(0), F.col("n"), F.lit(1_000_000)], T.corpus_id("load_error", F.concat_ws(":", "rel", "type", "told"))
    skip = T.corpus_id("skipped_file", F.concat_ws(":", "reason", "rel"))
    of_file = {"type": F.lit("file"), **base, "extraction_order": F.col("n"), "size_bytes": F.col("size"), "status": F.col("status"), "cache_status": F.lit("disabled"), "error_type": F.col("type"), "error_message": F.col("told"), "extraction_method": static}
    of_folder = {"type": F.lit("folder"), "source": F.concat(F.lit(root.rstrip("/") + "/"), "rel"), "relative_path": F.col("rel"), "extraction_method": static}
    of_error = {"type": F.lit("load_error"), **base, "size_bytes": F.col("size"), "error_type": F.col("type"), "extraction_method": static}
    of_skip = {"type": F.lit("skipped_file"), **base, "path_type": F.lit("file"), "reason": F.col("reason"), "extraction_method": static}
    nodes = [
        folders.select(*node_row(g, T.corpus_id("folder", F.col("rel")), _name(F.col("rel")), None, of_folder, [F.lit(0), F.col("n"), F.col("k")])),
        own.select(*node_row(g, F.col("file"), _name(F.col("rel")), None, of_file, place)),
        lost.select(*node_row(g, error, F.concat_ws(": ", "type", _name(F.col("rel"))), F.col("told"), of_error, [*place, F.lit(1)])),
        skipped.select(*node_row(g, skip, F.concat(F.lit("Skipped "), "rel"), None, of_skip, [F.lit(-1), F.col("seq")])),
    ]
    edges = [
        folders.select(*edge_row(g, inside(F.col("rel")), T.corpus_id("folder", F.col("rel")), "contains", [F.lit(0), F.col("n"), F.col("k")])),
        own.select(*edge_row(g, inside(F.col("rel")), F.col("file"), "contains", place)),
        lost.select(*edge_row(g, F.col("file"), error, "failed_to_extract", [*place, F.lit(1)])),
        skipped.select(*edge_row(g, manifest, skip, "skipped", [F.lit(-1), F.col("seq")])),
        spark.range(1).select(*edge_row(g, top, manifest, "contains", [F.lit(-2)])),
    ]

    texts = own.where("error IS NULL").join(loaded.select("path", "text"), "path")
    made = extract(texts.select(F.col("source").alias("graph_id"), "source", "text"))
    order = own.select(F.col("source").alias("graph_id"), "n", "file")

    def placed(df: DataFrame) -> DataFrame:
        spot = F.concat(F.array(F.lit(1).cast("long"), F.col("n").cast("long")), "pos")
        return df.join(order, "graph_id").withColumns({"pos": spot, "graph_id": g}).select(*df.columns)

    nodes.append(placed(made.nodes))
    edges.append(placed(made.edges))
    if made.roots is not None:
        edges.append(order.join(made.roots, "graph_id").select(*edge_row(g, F.col("file"), F.col("current_node_id"), "extracted_as", [*place, F.lit(2)])))
    whole = merged(Graph(union_all(nodes), union_all(edges)))
    all_nodes = cut_lineage(whole.nodes)

    near = all_nodes.withColumn("source", F.substring(F.col("source"), F.lit(len(root.rstrip("/")) + 2), F.length("source")))
    counts = {}
    for k, (name, found) in enumerate((("file_reference_link_count", links.file_reference_links(near, chosen.select("rel"), loaders.SUPPORTED)[0]), ("cross_document_link_count", links.corpus_mentions(all_nodes)[0]))):
        added = found.join(whole.edges.select("src", "dst", "label"), ["src", "dst", "label"], "left_anti")
        added = cut_lineage(added.select(*edge_row(g, F.col("src"), F.col("dst"), F.col("label"), [F.lit(2 + k)])))
        counts[name] = F.lit(added.count())
        whole.edges = whole.edges.unionByName(added)

    n = own.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("extracted", "failed")), F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col("size"))), F.lit(0)).alias("read"))
    n = n.join(scan.manifest_digest(chosen)).join(skipped.agg(F.count(F.lit(1)).alias("skipped")))
    both = {"source": F.lit(root), "skipped_file_count": F.col("skipped") + F.col("failed"), "extracted_file_count": F.col("extracted"), "failed_file_count": F.col("failed"), "extracted_total_bytes": F.col("read"), "extraction_method": static}
    listing = {"selected_file_count": F.col("files"), "selected_total_bytes": F.coalesce("bytes", F.lit(0)), "selected_file_paths_sha256": F.col("digest"), **counts}
    heads = [
        n.select(*node_row(g, top, F.lit(root.rstrip("/").rpartition("/")[2] or root), None, {"type": F.lit("corpus"), "file_count": F.col("files"), **both}, [F.lit(-3)])),
        n.select(*node_row(g, manifest, F.lit("Corpus extraction manifest"), None, {"type": F.lit("corpus_manifest"), **both, **listing}, [F.lit(-2)])),
    ]
    return Graph(union_all([*heads, all_nodes]), cut_lineage(whole.edges), spark.range(1).select(g.alias("graph_id"), top.alias("current_node_id")))
