"""The queries of the operators, as their contracts fix them, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .language_id import identify, learn_profiles
from .line_dedup import line_dedup
from .near_dedup import near_duplicates
from .packing import pack
from .quality import learn, rate
from .substring_dedup import substring_dedup
from .token_files import read_token_files, token_folder, write_token_files
from .url_filter import url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Rules of op7: host, path, verdict.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query(
    "op5_line_dedup",
    r"""
WITH lines AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), frequent AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM (SELECT l.doc_id, l.pos, l.line, f.k IS NOT NULL AND l.doc_id <> f.keeper AS gone FROM lines l LEFT JOIN frequent f ON l.k = f.k)
GROUP BY doc_id
""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(
    "op7_url_filter",
    r"""
WITH rules(rhost, rpath, rverdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fits AS (SELECT p.page_id, r.rhost || r.rpath AS rule, rverdict,
                row_number() OVER (PARTITION BY p.page_id ORDER BY length(rhost) + length(rpath) DESC, length(rhost) DESC, rverdict DESC) AS k
         FROM parts p JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.rverdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id AND f.k = 1
""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    out = url_filter(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), rules)
    return out.select("page_id", "host", "path", "rule", "verdict")


@query(
    "op10_exact_dedup",
    """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir))


def vocabulary(name: str) -> str:
    """The installed file of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op8_best_two_fit_packing")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), pieces="words", end_id=0, capacity=2048)


@query("op9_token_files")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_folder(spark)
    manifest = write_token_files(_documents(spark, sf_dir), folder, vocabulary("byte_bpe_50k.json"), pieces="spaced", end_id=2)
    return read_token_files(manifest, folder)


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).withColumn("part", F.crc32(F.col("doc_id").cast("string")) % 3)
    profiles = learn_profiles(docs.where("part <> 1"))
    out = identify(docs.select("doc_id", F.coalesce(F.col("part") == 1, F.lit(True)).alias("held_out"), "text"), profiles)
    return out.select("doc_id", "held_out", "lang_pred", "score")


@query("op3_substring_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(_documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op4_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), percent=85).drop("text_key")


@query("op2_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(_documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "contaminated", "item_id", "overlap")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of labelled documents: 0 toxic, 1 of low quality, 2 good."""
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select(
        "doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade")
    )


@query("op6_ordinal_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = learn(docs, ratings(spark, sf_dir), grades=3)
    out = rate(docs.select("doc_id", "text"), model)
    return out.select("doc_id", "expected_grade", F.col("tails")[0].alias("p_not_toxic"), F.col("tails")[1].alias("p_good"), "keep")
