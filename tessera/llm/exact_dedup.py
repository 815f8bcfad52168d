"""Exact dedup: Misra-Gries finds frequent digests; their verified winners are broadcast, the rest is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = 0.001) -> DataFrame:
    """Groups rows with identical text and keeps the one with the largest id.

    0. Each text is read and hashed once; ids and digests are written to the shared folder.
    1. ``freqItems`` (the Misra-Gries counters of Karp, Schenker and Papadimitriou) yields at most
       1 / support digests; every digest held by more than that share of the rows is among them.
    2. A second scan of the digests counts those candidates exactly and finds their winners (partial aggregates: at most
       1 / support rows leave a task). This table cannot exceed 1 / support rows, so it is broadcast and its
       rows are decided on the map side.
    3. The digests left, each on at most a ``support`` share of the rows, are grouped by an ordinary shuffle
       of digests and ids; texts never travel.

    Returns one row per input row: id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. A row repeated with the same id and text gets the same decision each time
    (group_size counts every row). Null ids never win unless the whole group has none; then keep_id is null
    and kept is true. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("_d"))
    rows = stored(rows, "digests")
    hexes = rows.select(F.hex("_d").alias("_hex"))
    candidates = hexes.stat.freqItems(["_hex"], support).select(F.explode("_hex_freqItems").alias("_hex")).select(F.unhex("_hex").alias("_d"))
    heavy = (
        rows.join(F.broadcast(candidates), "_d", "left_semi")
        .groupBy("_d")
        .agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    )
    marked = rows.join(F.broadcast(heavy), "_d", "left")
    light = marked.where(F.col("_n").isNull()).select("_id", "_d")
    winners = light.groupBy("_d").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    decided = marked.where(F.col("_n").isNotNull()).unionByName(light.join(winners, "_d"))
    return decided.select(
        F.col("_id").alias(id_col),
        F.col("_keep").alias("keep_id"),
        F.col("_n").alias("group_size"),
        F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.lower(F.hex("_d")).alias("text_sha256"),
    )
