"""URL filters: host-suffix and path-prefix expressions, equi-join on short hash prefixes, full digests, precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Bytes of the digest that the equi-join compares before the full digest does.
PREFIX_BYTES = 4
#: Rules up to this number are broadcast (each is a digest, a string of bounded use and two numbers); more are shuffled.
BROADCAST_RULES = 100_000
#: Up to this number of shapes, each shape of broadcast rules has a join of its own, and pages don't move.
MAP_SHAPES = 32


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; '' for null or no ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; '' for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_filter(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """Adds host, path, rule and verdict to pages. ``rules`` has host, path and verdict (allow or block).

    A rule fits its host and all subdomains, where the url's path starts with the rule's path. Of several that
    fit, the longest (host and path together) wins, then the longer host, then block before allow. Without a
    rule, rule is null and the verdict is ``default``.

    A url yields one expression for each shape (number of host labels, characters of path) that occurs among
    the rules, so the expansion is bounded by the rules, not by the url. Expressions join rules on the first
    4 bytes of SHA-256 and are confirmed on all 32.

    Rules that may be broadcast are met where the pages are read: one join for each shape, no shuffle, and so no
    hot host. Otherwise (more rules or shapes) each distinct (host, path) is judged once, and pages that have a
    host meet the verdicts on it.

    Null and empty urls, and those without ``://``, have empty host and path and fit no rule. Rules repeated
    count once. Columns of pages named host, path, rule or verdict are replaced; others pass through.
    """
    spark = pages.sparkSession
    made = rules.select(
        ascii_lower(F.col("host")).alias("_rhost"), F.coalesce(F.col("path"), F.lit("")).alias("_rpath"), F.col("verdict").alias("_verdict")
    ).where(F.col("_rhost").isNotNull() & F.col("_verdict").isNotNull()).distinct()
    shapes = [
        (r[0], r[1])
        for r in made.select(F.size(F.split("_rhost", r"\.", -1)).alias("l"), F.char_length("_rpath").alias("p")).distinct().collect()
    ]
    few = made.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES
    made = made.select(
        F.concat("_rhost", "_rpath").alias("_rule"),
        F.unhex(F.sha2(F.concat_ws("\0", "_rhost", "_rpath"), 256)).alias("_rd"),
        F.struct(
            F.char_length("_rhost") + F.char_length("_rpath"),
            F.char_length("_rhost"),
            F.when(F.col("_verdict") == "block", 1).otherwise(0),
        ).alias("_rank"),
        "_verdict",
        F.struct(F.size(F.split("_rhost", r"\.", -1)).alias("l"), F.char_length("_rpath").alias("p")).alias("_shape"),
    ).withColumn("_rp", F.substring("_rd", 1, PREFIX_BYTES))
    # of rules with one host and path the one that wins
    made = made.groupBy("_rd", "_rp", "_rule", "_shape").agg(F.max(F.struct("_rank", "_verdict")).alias("_w")).select("_rd", "_rp", "_rule", "_shape", "_w._rank", "_w._verdict")
    base = pages.withColumns({"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))})
    labels = F.split("host", r"\.", -1)
    none = F.lit(None).cast("binary")
    shaped = [
        F.when(
            (F.size("__uf_labels") >= n) & (F.char_length("path") >= p) & (F.col("host") != ""),
            F.unhex(F.sha2(F.concat_ws("\0", F.array_join(F.slice(F.col("__uf_labels"), -n, n), "."), F.substring("path", 1, p)), 256)),
        ).otherwise(none)
        for n, p in shapes
    ]
    if few and len(shapes) <= MAP_SHAPES:
        met, hits = base.withColumn("__uf_labels", labels), []
        for k, ((n, p), digest) in enumerate(zip(shapes, shaped)):
            own = made.where((F.col("_shape.l") == n) & (F.col("_shape.p") == p)).select(
                F.col("_rp").alias(f"__uf_p{k}"), F.col("_rd").alias(f"__uf_r{k}"), F.struct("_rank", "_rule", "_verdict").alias(f"__uf_b{k}")
            )
            met = met.withColumn(f"__uf_d{k}", digest)
            same = (F.substring(f"__uf_d{k}", 1, PREFIX_BYTES) == F.col(f"__uf_p{k}")) & (F.col(f"__uf_d{k}") == F.col(f"__uf_r{k}"))
            met = met.join(F.broadcast(own), same, "left").drop(f"__uf_d{k}", f"__uf_p{k}", f"__uf_r{k}")
            hits.append(f"__uf_b{k}")
        best = F.array_max(F.array(*hits)) if hits else F.lit(None).cast("struct<_rule:string,_verdict:string>")
        met = met.withColumn("__uf_best", best)
        return met.withColumns({"rule": F.col("__uf_best._rule"), "verdict": F.coalesce(F.col("__uf_best._verdict"), F.lit(default))}).drop("__uf_labels", "__uf_best", *hits)
    urls = base.where("host <> ''").select("host", "path").distinct()
    expressions = urls.select("host", "path", labels.alias("__uf_labels")).select(
        "host", "path", F.explode(F.array_compact(F.array(*shaped) if shaped else F.array(none))).alias("_d")
    )
    expressions = expressions.withColumn("_rp", F.substring("_d", 1, PREFIX_BYTES))
    hits = expressions.join(F.broadcast(made) if few else made, "_rp").where(F.col("_d") == F.col("_rd"))
    best = hits.groupBy(F.col("host").alias("__uf_h"), F.col("path").alias("__uf_p")).agg(F.max(F.struct("_rank", "_rule", "_verdict")).alias("__uf_best"))
    met = base.join(best, (F.col("host") == F.col("__uf_h")) & (F.col("path") == F.col("__uf_p")), "left")
    return met.withColumns({"rule": F.col("__uf_best._rule"), "verdict": F.coalesce(F.col("__uf_best._verdict"), F.lit(default))}).drop("__uf_h", "__uf_p", "__uf_best")
