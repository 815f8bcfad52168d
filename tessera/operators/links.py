"""Links between documents: titles mentioned as whole words, aliases across sources, relative file links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

LINK_TARGETS = sorted(
    "document decision_document media_document section problem context option tradeoff decision consequence confidence definition table".split()
)
LINK_SOURCES = sorted({*LINK_TARGETS, "pros", "cons", "claim", "evidence", "ocr_text"} - {"table"})
FILE_LINK_SOURCES = sorted({*LINK_SOURCES} - {"document", "decision_document", "media_document"})


def _word_runs(c: Column) -> Column:
    """Maximal runs of word characters (underscore included), lower-cased."""
    return F.filter(F.split(F.lower(c), r"(?U)\W+"), lambda t: t != "")


def _word_grams(n: int) -> Column:
    """All runs of n words of the column _runs, joined by spaces."""
    if n == 1:
        return F.col("_runs")
    starts = F.when(F.size("_runs") >= n, F.sequence(F.lit(1), F.size("_runs") - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(F.col("_runs"), i, F.lit(n)), " "))


def mentions(sources: DataFrame, targets: DataFrame, extra: Column | None = None) -> DataFrame:
    """Pairs (src columns, tgt columns) where the content holds the literal as a whole word, in any case.

    ``sources`` has content, ``targets`` has literal. A whole-word match implies that the literal's words stand
    in a row in the content, so candidates come from an equi-join of word n-grams, one n for each number of
    words that literals have; they are verified on the text. Literals without a word character are sought in
    all contents, as a block of their own.
    """
    t = targets.withColumn("_words", _word_runs(F.col("literal")))
    sizes = [r[0] for r in t.select(F.size("_words").alias("n")).distinct().orderBy("n").collect()]
    match = T.whole_word(F.col("content"), F.col("literal"))
    if extra is not None:
        match = match & extra
    s = sources.withColumn("_runs", _word_runs(F.col("content")))
    longs, key = [n for n in sizes if n], sources.columns[0]
    out = None
    if longs:
        # hashes of word n-grams travel without the text; a text meets its candidates once
        digest = lambda a: F.transform(a, lambda g: F.xxhash64(g))
        grams = F.array_distinct(digest(F.flatten(F.array(*map(_word_grams, longs)))))
        left = s.select(key, F.explode(grams).alias("_gram"))
        right = t.where(F.size("_words") > 0).select(F.xxhash64(F.array_join("_words", " ")).alias("_gram"), "literal").distinct()
        near = left.join(right, "_gram").groupBy(key).agg(F.collect_set("literal").alias("_near"))
        held = sources.join(near, key)
        held = held.withColumn("literal", F.explode(F.filter("_near", lambda x: T.whole_word(F.col("content"), x)))).drop("_near")
        out = held.join(t.where(F.size("_words") > 0).drop("_words"), "literal")
        out = out if extra is None else out.where(extra)
    if 0 in sizes or out is None:
        few = t.where(F.size("_words") == 0).drop("_words")
        odd = s.drop("_runs").join(few, match)
        out = odd if out is None else out.unionByName(odd)
    return out


def title_links(nodes: DataFrame) -> DataFrame:
    """mentions edges (src, dst) between nodes (node_id, label, content) of one graph: src's content holds dst's label."""
    sources = nodes.where(F.coalesce("content", F.lit("")) != "").select(F.col("node_id").alias("src"), "content")
    targets = nodes.where(F.coalesce("label", F.lit("")) != "").select(F.col("node_id").alias("dst"), F.col("label").alias("literal"))
    return mentions(sources, targets, F.col("src") != F.col("dst")).select("src", "dst").distinct().withColumn("label", F.lit("mentions"))


def titles_held(nodes: DataFrame) -> DataFrame:
    """title_links without the pairs: (src, literal) where src's content holds a title, each title standing for all
    nodes (node_id, label, content) that bear it."""
    sources = nodes.where(F.coalesce("content", F.lit("")) != "").select(F.col("node_id").alias("src"), "content")
    targets = nodes.where(F.coalesce("label", F.lit("")) != "").select(F.col("label").alias("literal")).distinct()
    return mentions(sources, targets).select("src", "literal").distinct()


def node_aliases(nodes: DataFrame) -> DataFrame:
    """(node_id, source, alias): the label, and for documents the file's name with and without its ending."""
    name = F.regexp_extract("source", r"([^/]*)/*$", 1)
    stem = F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")
    isdoc = F.col("type").isin("document", "decision_document", "media_document") & (F.coalesce("source", F.lit("")) != "")
    values = F.concat(F.array(F.coalesce("label", F.lit(""))), F.when(isdoc, F.array(name, stem, F.translate(stem, "-_", "  "))).otherwise(F.array().cast("array<string>")))
    return nodes.select("node_id", "source", F.explode(F.array_distinct(F.transform(values, T.alias))).alias("alias")).where("alias <> ''")


def corpus_mentions(nodes: DataFrame, max_links: int | None = None) -> tuple[DataFrame, DataFrame]:
    """mentions edges between nodes of different sources, by alias; the second frame has (added, limit_reached)."""
    sources = nodes.where(F.col("type").isin(LINK_SOURCES) & (F.coalesce("content", F.lit("")) != "") & (F.coalesce("source", F.lit("")) != ""))
    sources = sources.select(F.col("node_id").alias("src"), F.col("source").alias("src_source"), "content")
    targets = node_aliases(nodes.where(F.col("type").isin(LINK_TARGETS) & (F.coalesce("source", F.lit("")) != "")))
    targets = targets.select(F.col("node_id").alias("dst"), F.col("source").alias("dst_source"), F.col("alias").alias("literal"))
    pairs = mentions(sources, targets, F.col("src_source") != F.col("dst_source")).select("src", "dst").distinct()
    return _capped(pairs.withColumn("label", F.lit("mentions")), max_links)


def _capped(edges: DataFrame, most: int | None) -> tuple[DataFrame, DataFrame]:
    if most is None:
        return edges, edges.agg(F.count(F.lit(1)).alias("added"), F.lit(False).alias("limit_reached"))
    report = edges.agg(F.least(F.count(F.lit(1)), F.lit(most).cast("long")).alias("added"), (F.count(F.lit(1)) > most).alias("limit_reached"))
    return edges.orderBy("src", "dst").limit(most), report


def file_reference_links(nodes: DataFrame, files: DataFrame, suffixes: list[str], max_links: int | None = None) -> tuple[DataFrame, DataFrame]:
    """links_to edges from nodes (node_id, type, source as relative path, content) to the files (rel) that their
    Markdown, HTML or wiki links mean."""
    src = nodes.where(F.col("type").isin(FILE_LINK_SOURCES)).join(files.select(F.col("rel").alias("source")), "source", "left_semi")
    parent = F.regexp_extract("source", r"^(.*)/[^/]*$", 1)
    found = src.select("node_id", "source", parent.alias("parent"), F.explode(T.link_targets(F.col("content"))).alias("t"))
    found = found.select("node_id", "source", T.resolve_path(F.col("parent"), F.col("t"), suffixes).alias("rel")).where("rel <> source")
    edges = found.join(files.select("rel"), "rel").select(F.col("node_id").alias("src"), T.corpus_id("file", F.col("rel")).alias("dst"), F.lit("links_to").alias("label")).distinct()
    return _capped(edges, max_links)


def top_per(df: DataFrame, by: str, order: list, n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_k") <= n).drop("_k")
