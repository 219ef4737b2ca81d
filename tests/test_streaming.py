from lodestone.operators.blocking import BlockingConfig
from lodestone.streaming import blocking


def test_key_rows_follow_the_stream(spark, tmp_path):
    rows = [("S2-1", "Apex Tools LLC", "5 Oak St, Rome", "US"), ("S2-2", None, None, None)]
    spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string").write.parquet(str(tmp_path / "in"))
    config = BlockingConfig(enable_tfidf=False, enable_address=False, enable_phonetic=False)
    q = blocking.append_keys(blocking.read(spark, str(tmp_path / "in")), str(tmp_path / "index"), str(tmp_path / "ckpt"), config)
    assert q.awaitTermination(120)
    assert "TOK:apex" in {r.key for r in spark.read.parquet(str(tmp_path / "index" / "keys")).select("key").collect()}
