"""The corpus pipeline: language identification, quality, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``.  Between stages rows are written as Parquet and read again.

* ``language``: drops documents whose language isn't accepted (no letters, or no language with half of the
  posterior).  A document's source stands for the host, its ``lang`` for the declared language.
* ``quality``: drops documents with a score below 0.5.  Labelled rows that aren't held out train the model.
* ``near_duplicates``: one document of each group stays, the one of the smallest id; documents of a similarity of
  0.8 or more are linked, and rows that repeat an id are one document: the one of the smallest text (then language,
  source, length) stands for it.  Documents without id stay.
* ``packing``: the pieces of the documents in sequences of at most 2048 tokens.

Null texts have no letters and go in the first stage; an empty table passes as one.  The last stage has no SQL
form (token ids), nor have the trained ones: their tests hold them against brute force.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import language, near_dedup, packing, quality
from lodestone.llm.common import ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(docs)
    found = language.identify(docs.select(*COLUMNS), model, text=F.col("text"), host=F.col("source"), suffix=F.lit(""), declared=F.col("lang"))
    return found.filter("lang_accepted").select(*COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select(*COLUMNS), model, out_col="quality_score").filter("quality_score >= 0.5").select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(*COLUMNS)
    kept = near_dedup.near_duplicates(docs).filter("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_rows"))
    rows = docs.join(kept, "doc_id").select("n_rows", *COLUMNS)
    least = F.min(F.struct(*COLUMNS[1:])).alias("x")
    repeated = rows.filter("n_rows > 1").groupBy("doc_id").agg(least).select("doc_id", "x.*")
    return rows.filter("n_rows = 1").drop("n_rows").unionByName(repeated).unionByName(docs.filter("doc_id is null"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    # Fewer words are remembered than where packing runs alone: other stages use the same executors.
    return packing.pack(packing.token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), cache_words=250_000))


STAGES = [("language", keep_identified), ("quality", keep_good), ("near_duplicates", keep_one_of_each_group), ("packing", pack)]

#: SQL can express neither the trained models nor the token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, in a folder of its own under the checkpoint folder; a failed run leaves none behind."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    path, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()

    def gone(at: str) -> None:
        path(at).getFileSystem(conf).delete(path(at), True)

    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    try:
        for k, (name, stage) in enumerate(STAGES):
            at = f"{folder}/{k}-{name}"
            stage(spark, docs, sf_dir).write.parquet(at)
            docs = spark.read.parquet(at)
            if before:  # its rows are no longer needed
                gone(before)
            before = at
    except BaseException:
        gone(folder)
        raise
    return docs
