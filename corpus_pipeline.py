"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents.

Rows with null text pass line dedup as empty lines; language ID rejects them beforehand. Repeated rows are
treated alike in every stage, and rows of one id or of none each by their own text. Empty tables give empty results. Columns beyond those of documents pass through
until packing, which returns pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import dropped, noted, stored
from tessera.llm.decontaminate import decontaminate
from tessera.llm.language_id import UNKNOWN, identify, learn_profiles
from tessera.llm.line_dedup import line_dedup
from tessera.llm.near_dedup import BROADCAST_ROWS, near_duplicates, text_key
from tessera.llm.packing import pack
from tessera.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns profiles from all labelled rows and drops documents of no language: null text, no letter in it, or
    no n-gram of any profile. Where no row is labelled there are no profiles, and all texts with a letter stay."""
    out = identify(docs, learn_profiles(docs), strict=True)
    return out.where(F.col("lang_pred") != UNKNOWN).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines of at least 20 characters that 3 documents hold, but for the largest doc_id; n_chars follows.

    A document keeps its row when it loses every line; its text is then empty."""
    out = line_dedup(docs)
    return out.withColumns({"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group of documents linked at a Jaccard similarity of 0.8 on 5-word shingles.

    Rows go by id and text together: of one id, a row whose text has no near copy stays when another goes. Rows with
    a null id go where their group has an id, else those of one text stay. A row repeated as it is stays twice."""
    gone = near_duplicates(docs.select("doc_id", "text"), percent=80).where(~F.col("kept"))
    gone = stored(gone.select(F.col("doc_id").alias("__np_id"), F.col("text_key").alias("__np_key")).distinct(), "near-gone")
    few = gone.count() <= BROADCAST_ROWS
    same = F.col("doc_id").eqNullSafe(F.col("__np_id")) & (text_key(F.col("text")) == F.col("__np_key"))
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark, substituted words included."""
    out = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.where(~F.col("contaminated")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens: a row per piece."""
    return pack(docs, vocabulary("word_bpe_49k.json"), pieces="words", end_id=0, capacity=2048)


STAGES = [("language_id", language), ("line_dedup", lines), ("near_dedup", near), ("decontamination", benchmark), ("packing", packing)]

#: SQL can express neither the language profiles, the linked components nor the packing; tests hold them
#: against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents. What a stage stored is deleted once its result is, and with it the one before."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        with noted() as paths:
            docs = stored(stage(spark, docs, sf_dir), name)
        dropped(spark, [*last, *paths[:-1]])
        last = paths[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
