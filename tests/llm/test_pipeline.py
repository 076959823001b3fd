"""The pipeline's stages on a small table: columns, effects and the order of decisions."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from quarryline.llm import decontaminate, mixing, nearcopies
from quarryline.llm.common import stored


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(6)
    words = {"en": "the of and with this that water house tree".split(), "fr": "le la et avec eau maison été arbre".split()}
    item = " ".join(rng.choice(words["en"]) + str(i) for i in range(20))
    rows = []
    for i in range(200):
        lang = "en" if i % 3 else "fr"
        rows.append((i, " ".join(rng.choice(words[lang]) for _ in range(60)), lang, f"s{i % 3}", 1))
    rows += [(500, rows[7][1].upper(), "en", "s1", 1), (501, item, "en", "s1", 1), (502, "12 34", None, "s1", 1), (503, None, "en", None, None), (504, "", "en", "s2", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clash = {c: F.lit(c) for c in ("copy", "c0", "rid", "key", "order", "shard", "place", "ids", "fp")}
    spark.createDataFrame(rows, schema).withColumns(clash).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([("1", item)], "item_id string, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs, sf_dir = spark.read.parquet(f"file://{tmp_path}/documents.parquet"), f"file://{tmp_path}"
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stored(stage(spark, docs, sf_dir), f"t{k}")
        kept.append([r.doc_id for r in docs.select("doc_id").collect()])
        if k < 4:
            assert docs.columns == columns
            assert set(kept[-1]) <= {r.doc_id for r in before.select("doc_id").collect()}
    assert sorted(set(range(200)) | {500, 501}) == sorted(kept[0])
    assert 500 not in kept[1] and 7 in kept[1] and 501 in kept[1] and 501 not in kept[2]
    assert max(kept[3].count(i) for i in kept[3]) <= 3
    assert sorted(kept[4]) == sorted(kept[3]) and docs.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_stage_functions_are_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None
    assert nearcopies.first_of_each and decontaminate.clean and mixing.repeated
