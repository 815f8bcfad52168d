"""Line dedup: explode normalised lines, hash, count documents per hash, drop the frequent, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, stored

#: The hashes held by most documents, which are decided where the lines are read; any other hash has at most one in
#: HOT_KEYS of all lines.
HOT_KEYS = 256


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Drops lines whose key has ``min_chars`` code points and stands in ``min_docs`` documents, except in the
    document with the largest id that holds it. Adds kept_text, n_lines and n_dropped to the columns of docs.

    1. Each text is split and hashed once: ids, positions and 16-byte hashes of its long lines are written to the
       shared folder, a row for each document.
    2. Distinct ids are counted for each hash; pairs of hash and id are dealt out by both, so a line of every
       third document burdens no task. Hashes of ``min_docs`` documents are written too.
    3. The HOT_KEYS most frequent of them are broadcast (a bounded table) and mark their lines where these are
       read; other lines meet the rest by a shuffle of hashes and positions.
    4. The text is shuffled once, to meet the positions that it loses, in a sort-merge join, which can spill.

    A document is a doc_id: rows with one id count once, and all rows with the largest id keep the line; each row
    keeps its own text. Null ids are one document, smaller than any other. Null or empty text is one empty line
    (kept_text ''). Equal rows get equal results. A text of which every line goes becomes ''. An empty table
    gives an empty result. Input columns named kept_text, n_lines or n_dropped are replaced; others pass through.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.withColumns({"__ld_id": F.col(id_col), "__ld_text": text, "__ld_row": F.xxhash64(text)})
    # positions and keys of long lines; shorter ones never leave the document
    marked = F.filter(
        F.transform(F.split("__ld_text", "\n", -1), lambda x, i: F.struct(i.alias("p"), line_key(x).alias("k"))),
        lambda s: F.char_length(s["k"]) >= min_chars,
    )
    hashed = base.select("__ld_id", "__ld_row", F.transform(marked, lambda s: F.struct(s["p"].alias("p"), F.unhex(F.md5(s["k"])).alias("h"))).alias("__ld_lines"))
    hashed = stored(hashed.where(F.size("__ld_lines") > 0), "lines")
    frequent = stored(
        hashed.select("__ld_id", F.explode(F.array_distinct(F.col("__ld_lines.h"))).alias("_h"))
        .groupBy("_h")
        .agg(F.count_distinct(F.struct("__ld_id")).alias("_n"), F.max("__ld_id").alias("_keeper"))
        .where(F.col("_n") >= min_docs),
        "frequent-lines",
    )
    hot = frequent.orderBy(F.desc("_n"), "_h").limit(HOT_KEYS).select("_h", F.col("_keeper").alias("_hot_keeper"), F.lit(True).alias("_hot"))
    lines = hashed.select("__ld_id", "__ld_row", F.explode("__ld_lines").alias("_l")).select("__ld_id", "__ld_row", F.col("_l.p").alias("_p"), F.col("_l.h").alias("_h"))
    lines = lines.join(F.broadcast(hot), "_h", "left")
    others = lines.where(F.col("_hot").isNull()).drop("_hot", "_hot_keeper").join(frequent.join(F.broadcast(hot), "_h", "left_anti"), "_h")
    drops = (
        lines.where(F.col("_hot") & ~F.col("__ld_id").eqNullSafe(F.col("_hot_keeper"))).select("__ld_id", "__ld_row", "_p")
        .union(others.where(~F.col("__ld_id").eqNullSafe(F.col("_keeper"))).select("__ld_id", "__ld_row", "_p"))
        .groupBy(F.col("__ld_id").alias("__ld_did"), F.col("__ld_row").alias("__ld_drow"))
        .agg(F.array_sort(F.collect_set("_p")).alias("__ld_drop"))
    )
    met = base.join(drops, F.col("__ld_id").eqNullSafe(F.col("__ld_did")) & (F.col("__ld_row") == F.col("__ld_drow")), "left")
    split = F.split("__ld_text", "\n", -1)
    # the runs of lines between dropped positions
    runs = F.zip_with(
        F.concat(F.array(F.lit(0)), F.transform("__ld_drop", lambda p: p + 1)),
        F.concat(F.col("__ld_drop"), F.array(F.size("__ld_all"))),
        lambda a, b: F.slice(F.col("__ld_all"), a + 1, b - a),
    )
    out = met.withColumn("__ld_all", split)
    kept = F.when(F.col("__ld_drop").isNull(), F.col("__ld_text")).otherwise(F.array_join(F.flatten(runs), "\n"))
    out = out.withColumns(
        {
            "kept_text": kept,
            "n_lines": F.size("__ld_all").cast("long"),
            "n_dropped": F.coalesce(F.size("__ld_drop"), F.lit(0)).cast("long"),
        }
    )
    return out.drop("__ld_id", "__ld_text", "__ld_row", "__ld_did", "__ld_drow", "__ld_drop", "__ld_all")
