"""Media graphs: a document node, file metadata, recognised text and chart signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .graph_frames import Graph, edge_row, node_row, union_all

MEDIA_SUFFIXES = sorted(".png .jpg .jpeg .tif .tiff .bmp .gif .webp .pdf".split())


def media_graph(files: DataFrame) -> Graph:
    """files (graph_id, source, text, length): a media_document for each, with metadata where the file exists
    (length not null), its text, and one node per chart signal."""
    g, src = F.col("graph_id"), F.col("source")
    suffix = F.lower(F.regexp_extract(src, r"[.]([^./]+)$", 1))
    f = files.withColumns({"doc": T.media_id("media", src), "fmt": suffix, "body": F.coalesce("text", F.lit(""))})
    static = {"source": src, "extraction_method": F.lit("static")}
    name = F.regexp_extract(src, r"([^/]*)/*$", 1)
    nodes = [f.select(*node_row(g, F.col("doc"), name, F.nullif(T.cut(F.col("body"), 2000), F.lit("")), {"type": F.lit("media_document"), "format": F.col("fmt"), **static}, [F.lit(0)]))]
    edges = []

    def part(df: DataFrame, kind: str, suffix: str, label, content, how: str, k: int, **more) -> None:
        d = df.withColumn("id", F.concat("doc", F.lit(f":{suffix}") if "sig" not in df.columns else F.concat(F.lit(f":{suffix}:"), F.col("sig"))))
        nodes.append(d.select(*node_row(g, F.col("id"), label, content, {"type": F.lit(kind), **more, **static}, [F.lit(k)])))
        edges.append(d.select(*edge_row(g, F.col("doc"), F.col("id"), how, [F.lit(k)])))

    part(f.where("length IS NOT NULL"), "image_metadata", "metadata", F.lit("Image metadata"), None, "has_metadata", 1, size_bytes=F.col("length"))
    part(f.where("body <> ''"), "ocr_text", "ocr", F.lit("OCR text"), F.col("body"), "has_ocr_text", 2)
    sig = f.select("*", F.explode(T.chart_cues(F.col("body"))).alias("sig"))
    part(sig, "chart_signal", "signal", F.col("sig"), None, "has_visual_signal", 3, chart_signal=F.col("sig"))
    return Graph(union_all(nodes), union_all(edges), f.select("graph_id", F.col("doc").alias("current_node_id")))
