"""The pipeline's stages against plain versions of their decisions."""

import re

import corpus_pipeline
from eventide.llm import decontaminate, entropy_mix, pu_quality
from eventide.llm.common import n_words, table, written
from pyspark.sql import functions as F

from test_simhash_similar import joined, shingle_set

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminated", "mixed", "token_ids"]
    quality, near, clean, mixed, ids = (stage for _, stage in corpus_pipeline.STAGES)

    good = written(quality(spark, docs, SF), "test-quality")
    wanted = {r.doc_id for r in pu_quality.scored(docs, table(spark, SF, "labels")).where("predicted = 1").collect()}
    assert good.columns == columns and {r.doc_id for r in good.collect()} == wanted

    single = written(near(spark, good, SF), "test-near")
    rows = sorted((r.doc_id, r.text) for r in good.collect())
    labels = joined([shingle_set(text) for _, text in rows])
    first = {label: doc_id for (doc_id, _), label in reversed(list(zip(rows, labels)))}
    assert single.columns == columns and {r.doc_id for r in single.collect()} == set(first.values())

    fresh = written(clean(spark, single, SF), "test-clean")
    hits = {r.doc_id: r.n_hit for r in decontaminate.contamination(single, table(spark, SF, "benchmark")).collect()}
    assert fresh.columns == columns and {r.doc_id for r in fresh.collect()} == {d for d, n in hits.items() if n == 0}

    repeated = written(mixed(spark, fresh, SF), "test-mixed")
    copies = {r.doc_id: r.copies for r in entropy_mix.mixed(fresh, n_words(F.col("text"))).collect()}
    got = {}
    for r in repeated.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert repeated.columns == columns and got == {d: n for d, n in copies.items() if n}

    rows = ids(spark, repeated, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in repeated.collect())
    whole = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows)


def test_stages_take_odd_rows(spark, tables):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "word"), (3, "word"), (3, "another text"), (4, "a b c " * 500)]
    folder = tables.documents("pipeline-odd", rows, labels=[(3, 1, 0), (4, 1, 0)], benchmark=[(1, None), (2, "word")])
    docs = table(spark, folder, "documents").withColumn("size", F.lit(1)).withColumn("copies", F.lit("x")).withColumn("key", F.lit(2))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, folder), f"odd-{name}")
        assert docs.columns[-3:] == ["size", "copies", "key"]
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).collect() == []
    assert all(re.fullmatch(r"\d+", str(r.ids_crc32)) for r in corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect())
