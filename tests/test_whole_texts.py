"""Catalogue queries read texts to their end."""

from quillspark.plans import registry


def test_proper_nouns_after_a_long_start(spark, tmp_path):
    spark.createDataFrame([(1, "plain words and more of them. " * 30 + "then Ada Lovelace spoke.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert "Ada Lovelace" in registry.queries()["proper_nouns"](spark, str(tmp_path)).first().nouns
