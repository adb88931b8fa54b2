"""The pipeline against its operators' own brute force, stage by stage."""

import corpus_pipeline
from pyspark.sql import functions as F
from quillspark.llm.common import materialize
from llm_rows import documents, prose


def test_stages_take_effect(spark, tmp_path):
    benchmark = " ".join(prose(77, 40).split()[:20])
    rows = [(i, prose(i, 120), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100 + i, prose(200 + i, 60) + ". you are a vileterm person.", "en", "s0") for i in range(40)]
    rows += [(200, rows[1][1], "en", "s1"), (201, rows[2][1] + " end", "en", "s1"), (202, prose(300, 30) + " " + benchmark, "en", "s2"), (203, prose(301, 60) + " write to joe@mail.example", "en", "s2"), (204, None, None, None), (205, "", "en", "s1")]
    documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(100 <= i < 200)) for i, *_ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, benchmark)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        assert docs.columns[:5] == list(corpus_pipeline.COLUMNS)
    clean = set(range(60)) | {200, 201, 202, 203, 204, 205}
    assert set(seen["toxicity"]) == clean
    assert set(seen["near_dedup"]) == clean - {200, 201}
    assert set(seen["decontamination"]) == clean - {200, 201, 202}
    assert set(seen["personal_data"]) == clean - {200, 201, 202}
    assert "[email]" in seen["personal_data"][203].text and seen["personal_data"][5].text == rows[5][1] and seen["personal_data"][204].text is None
    assert all(1 <= r.copies <= 3 for r in seen["mixing"].values()) and set(seen["mixing"]) <= clean
    assert sorted((r.doc_id, r.copies) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((r.doc_id, r.copies) for r in seen["mixing"].values())


def tables(spark, path, rows, extra=""):
    """Tables whose documents have the columns listed in extra besides."""
    docs = documents(spark, rows).select("doc_id", "text", "lang", "source", "n_chars")
    for i, name in enumerate(extra.split()):
        docs = docs.withColumn(name, F.lit(i))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "no such words")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [])).count() == 0


def test_rows_are_told_apart_and_names_may_clash(spark, tmp_path):
    same = prose(1, 90)
    rows = [(None, same, "en", "a"), (None, same, "en", "b"), (None, prose(2, 90), None, None), (3, prose(3, 90), "en", "a"), (3, prose(4, 90) + " x@y.example", "en", "b"), (4, prose(5, 90), "en", "b"), (4, prose(5, 90), "en", "b"), (5, None, "en", "a")]
    extra = "size target copies _id _row _new _size _gone _hits row_number new_text hits toxicity key row first"
    at = tables(spark, tmp_path, rows, extra)
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, at), name)
        assert docs.columns == [*corpus_pipeline.COLUMNS, *extra.split()], name
    kept = sorted(str((r.doc_id, (r.text or "")[:12])) for r in docs.collect())
    # one row of each text stays, whatever its id
    assert kept == sorted(str((i, (t or "")[:12])) for i, t in [(None, same), (None, rows[2][1]), (3, rows[3][1]), (3, rows[4][1]), (4, rows[5][1]), (5, None)])
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, at)
    assert mixed.columns == [*docs.columns, "size_", "target_", "copies_"] and mixed.where("copies_ > 0").count() == mixed.count() > 0


def test_texts_are_not_shuffled(spark, tmp_path):
    """However large the tables of row numbers are, what a stage found is joined to its documents without a shuffle of their texts."""
    import random

    letters = [chr(0x4E00 + i) for i in range(20_000)]
    rows = [(i, " ".join("".join(random.Random(1000 * i + j).choices(letters, k=6)) for j in range(600)), "en", f"s{i % 3}") for i in range(150)]
    rows += [(1000 + i, rows[i][1], "en", "s0") for i in range(5)] + [(2000, rows[9][1] + " x@y.example", "en", "s1"), rows[7]]
    at = tables(spark, tmp_path, rows)
    texts = sum(len(r[1].encode()) for r in rows)
    store = spark.sparkContext._jsc.sc().statusStore()

    def shuffled():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{at}/documents.parquet").cache()
    docs.count()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("near_dedup", "personal_data", "mixing"):
            passed = stages[name](spark, docs, at)
            done = set(shuffled())
            materialize(passed, name)
            wrote = sum(n for k, n in shuffled().items() if k not in done)
            assert wrote < texts / 4, (name, wrote, texts)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        docs.unpersist()
