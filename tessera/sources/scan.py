"""Corpus scan: selection of files, byte budget, skip reasons, manifest digests, cache hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.lineage import cut_lineage


def glob_regex(pattern: str) -> str:
    """The regular expression of a glob in which * also crosses slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[" and "]" in pattern[i + 2 :]:
            end = pattern.index("]", i + 2)
            inner = pattern[i + 1 : end].replace("\\", r"\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]", end + 1
            continue
        out += ".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() and c != "_" else c
        i += 1
    return f"(?s)^{out}$"


def matches(rel: Column, patterns: list[str]) -> Column:
    """Whether a pattern is a part of the path, or fits the whole path or its name."""
    name = F.substring_index(rel, "/", -1)
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.array_contains(F.split(rel, "/"), p) | F.rlike(rel, F.lit(glob_regex(p))) | F.rlike(name, F.lit(glob_regex(p)))
    return hit


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """Adds the place of each row in the order, from 1: rows are dealt out by range and numbered where they are;
    the driver learns only how many rows each range has."""
    spark = df.sparkSession
    d = cut_lineage(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).withColumn("_p", F.spark_partition_id()))
    counts, before, rows = d.groupBy("_p").count().orderBy("_p").collect(), 0, []
    for r in counts:
        rows.append((r[0], before))
        before += r[1]
    base = spark.createDataFrame(rows, "_p int, _b long")
    d = d.join(F.broadcast(base), "_p")
    return d.withColumn(name, F.col("_b") + F.row_number().over(Window.partitionBy("_p").orderBy(order))).drop("_p", "_b")


def select_files(files: DataFrame, supported: list[str], extensions: list[str] | None = None, include: list[str] | None = None, exclude: list[str] | None = None, max_depth: int | None = None, max_files: int | None = None) -> DataFrame:
    """files (rel, size) with suffix, seq (place in depth-first order of names) and reason (null: selected)."""
    from .loaders import suffix_of

    rel = F.col("rel")
    f = files.withColumns({"suffix": suffix_of(rel), "parts": F.split(rel, "/")})
    wanted = [e if e.startswith(".") else f".{e}" for e in (x.strip().lower() for x in extensions or [])]
    reason = F.when(matches(rel, exclude or []), "exclude_filter_match")
    if max_depth is not None:
        reason = reason.when(F.size("parts") - 1 > max_depth, "max_depth_exceeded")
    reason = reason.when(~F.col("suffix").isin(supported), "unsupported_extension")
    if wanted:
        reason = reason.when(~F.col("suffix").isin(wanted), "extension_filter_mismatch")
    if include:
        reason = reason.when(~matches(rel, include), "include_filter_mismatch")
    f = f.withColumn("reason", reason)
    f = numbered(f, "parts", "seq")
    if max_files is not None:
        kept = numbered(f.where("reason IS NULL"), "seq", "_n")
        kept = kept.withColumn("reason", F.when(F.col("_n") > max_files, "max_files_exceeded")).drop("_n")
        f = f.where("reason IS NOT NULL").unionByName(kept)
    return f.drop("parts")


def byte_budget(selected: DataFrame, max_file_bytes: int | None = None, max_total_bytes: int | None = None, by: list[str] | None = None) -> DataFrame:
    """Adds reason to (seq, size): too large files consume nothing; from the first that would break the budget on,
    all are left out."""
    big = F.col("size") > max_file_bytes if max_file_bytes is not None else F.lit(False)
    if max_total_bytes is None:
        return selected.withColumn("reason", F.when(big, "file_too_large"))
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("seq")
    total = F.sum(F.when(big, 0).otherwise(F.col("size"))).over(w)
    broken = F.max(F.when(~big & (total > max_total_bytes), 1).otherwise(0)).over(w)
    breach = F.when(big, False).otherwise(total > max_total_bytes)
    earlier = F.coalesce(F.max(breach.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return selected.withColumns({"_b": broken}).withColumn("reason", F.when(earlier == 1, "max_total_bytes_exceeded").when(big, "file_too_large").when(breach, "max_total_bytes_exceeded")).drop("_b")


def skip_histogram(scan: DataFrame) -> DataFrame:
    """(reason, suffix, n, bytes) of what was skipped."""
    return scan.where("reason IS NOT NULL").groupBy("reason", F.coalesce(F.nullif("suffix", F.lit("")), F.lit("<none>")).alias("suffix")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"))


def manifest_digest(selected: DataFrame) -> DataFrame:
    """One row: count, bytes and SHA-256 over the selected paths in their order, each ended by a NUL."""
    paths = F.transform(F.array_sort(F.collect_list(F.struct("seq", "rel"))), lambda e: F.concat(e["rel"], F.lit(T.NUL)))
    return selected.agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.sha2(F.array_join(paths, ""), 256).alias("digest"))


def cache_status(files: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Adds status to files (rel, digest, ...): hit if the cache has the same keys, updated if it has the path,
    miss otherwise; entries of the cache without a file are stale."""
    known = cache.select("rel", F.struct(*keys).alias("_was"))
    met = files.withColumn("_now", F.struct(*keys)).join(known, "rel", "full")
    status = F.when(F.col("_now").isNull(), "stale").when(F.col("_was").isNull(), "miss").when(F.col("_was") == F.col("_now"), "hit").otherwise("updated")
    return met.withColumn("status", status).drop("_was", "_now")
