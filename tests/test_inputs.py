"""What the queries read of the records: text endings for whole texts, and the columns that they use."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions.dialect import apply
from lodestone.operators import blocking
from lodestone.plans import adapter, blocks


def test_endings_give_the_records_of_whole_texts(spark, tmp_path):
    long, odd = "word " * 200, "ß\x01æ" * 90
    texts = [None, "", " \t ", "one", "a b c d", "a b c d e", long, long + "Ende\n\n", long + " " * 300, long + "x" * 300, "x" * 300 + " a b c d", "x" * 256 + "a b c d",
             "x" * 250 + " a b c", f"{long}{odd} {odd} zäh é œ", f"{long} 𝔸𝔹   tools of 12 -", "\n".join(["u v"] * 200), long + "last\x0bfour\x0cwords here"]
    d = str(tmp_path)
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{d}/documents.parquet")
    raw = spark.read.parquet(f"{d}/documents.parquet")
    rows = lambda df: sorted(map(repr, df.select(*adapter.ENTITY_COLUMNS).collect()))
    assert rows(adapter.entities(spark, d)) == rows(apply(raw, adapter.ENTITIES))
    assert raw.filter("length(text) > 256").select(F.max(F.length(adapter.ending(F.col("text"))))).first()[0] > adapter.TAIL
    assert raw.filter("doc_id = 6").select(F.length(adapter.ending(F.col("text")))).first()[0] == adapter.TAIL


@pytest.mark.parametrize("name", ["tfidf_knn", "tfidf_dense_knn", "tfidf_cosine_pairs", "block_quality"])
def test_only_what_is_used_is_made(name, monkeypatch):
    class Asked(Exception):
        pass

    def stored(spark, d, *columns):
        raise Asked(columns)

    monkeypatch.setattr(blocks, "stored", stored)
    with pytest.raises(Asked) as asked:
        getattr(blocks, name)(None, "")
    (columns,) = asked.value.args
    assert columns and "name_tokens" not in columns and ("addr_city" in columns) == (name == "block_quality")


def test_inputs_suffice(spark):
    for config in (blocking.BlockingConfig(), blocking.BlockingConfig.production(), blocks.TOKENS, blocks.BOTH):
        rows = spark.createDataFrame([], ", ".join(f"{c} string" for c in blocking.inputs(config)))
        assert blocking.key_rows(rows, config).columns == [*blocking.KEY, "weight", "entity_id"]


def test_one_python_step_below_all_keys(spark):
    rows = spark.createDataFrame([], ", ".join(f"{c} string" for c in blocking.inputs(blocks.BOTH)))
    plan = blocking.key_rows(rows, blocks.BOTH)._jdf.queryExecution().analyzed().toString().splitlines()
    assert len([x for x in plan if "_transliterate_udf(" in x]) == 1
