from __future__ import annotations

import corpus_pipeline
from hotelspark.llm import queries
from hotelspark.llm.packing import LENGTH
from tests.conftest import SF_DIR
from tests.llm import cases

import __spark_entry__ as driver


def test_queries_are_registered():
    assert set(queries.QUERIES) | {"pipeline"} <= set(driver.queries())
    assert [name.split("_")[0] for name in queries.QUERIES] == [f"op{n}" for n in range(1, 14)]


def test_stages_keep_columns_and_work_on_what_is_left(spark, tmp_path):
    """Each stage against what its own rule says of its input."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / name))
        found = spark.read.parquet(str(tmp_path / name))
        assert found.columns == docs.columns
        counts.append(found.count())
        if name == "simhash":
            assert found.select("text").distinct().count() == found.count()
        docs = found
    assert counts[0] > counts[1] > counts[2] == counts[3]
    packed = corpus_pipeline.packed(spark, docs, SF_DIR)
    assert packed.groupBy("sequence_id").agg({"length": "sum"}).filter(f"`sum(length)` > {LENGTH}").count() == 0
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_hard_cases_and_empty_tables(spark):
    labels_dir = SF_DIR
    for docs in (cases.clashing(cases.documents(spark)), cases.empty(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, docs, labels_dir)
            assert found.columns == docs.columns
            found.count()
        corpus_pipeline.packed(spark, docs, labels_dir).count()


def test_run(spark):
    assert corpus_pipeline.run(spark, SF_DIR).count() > 0
