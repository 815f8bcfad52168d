import os

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_and_run(spark):
    import corpus_pipeline as p

    from tessera.llm import near_dedup as near
    from tessera.llm.common import stored

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in p.STAGES[:-1]:
        before = docs
        docs = stored(stage(spark, docs, SF), name)
        assert docs.columns == columns
        seen[name] = (before, docs)
    before, after = seen["near_dedup"]
    want = {d for d, _, _, kept in near.brute_force([(r.doc_id, r.text) for r in before.collect()], 80) if kept}
    assert {r.doc_id for r in after.collect()} == want
    last = p.STAGES[-1][1](spark, docs, SF)
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, p.run(spark, SF).select(key).collect())) == sorted(map(tuple, last.select(key).collect()))


def test_no_text_is_lost_with_a_shared_or_null_id(spark):
    import corpus_pipeline as p

    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    rows = [(1, b), (5, a), (5, b), (None, b), (None, "no copy of it"), (6, "short"), (6, "short too")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, p.near(spark, docs, SF).collect()), key=str) == sorted([(1, b), (5, a), (None, "no copy of it"), (6, "short"), (6, "short too")], key=str)
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs.withColumn("lang", docs["text"]), SF) if stage is p.language else stage(spark, docs, SF)


def test_run_leaves_two_tables(spark, tmp_path):
    import corpus_pipeline as p

    from tessera.llm.common import shared_folder

    root = shared_folder(spark).removeprefix("file:")
    before = set(os.listdir(root))
    p.run(spark, SF).count()
    assert len(set(os.listdir(root)) - before) == 2  # the last stage's documents and its pieces


def test_empty_and_odd_rows_pass_every_stage(spark, odd_docs):
    import corpus_pipeline as p

    for docs in (odd_docs, odd_docs.where("false")):
        for _, stage in p.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == odd_docs.columns
        p.STAGES[-1][1](spark, docs, SF).count()


def test_language_stage_rejects_only_what_no_profile_meets(spark):
    import corpus_pipeline as p

    rows = [(1, "the and of", "en"), (2, "der die das", "de"), (3, "日本 語", None), (4, "of das", None), (5, "12 !", "en"), (6, None, "en"), (7, "Ωμέγα", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = lambda d: sorted(r.doc_id for r in p.language(spark, d, SF).collect())
    assert kept(docs) == [1, 2, 4]
    assert kept(docs.withColumn("lang", F.lit(None).cast("string"))) == [1, 2, 3, 4, 7]
    assert kept(docs.where("false")) == []
