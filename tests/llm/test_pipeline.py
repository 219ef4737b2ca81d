import __spark_entry__
import corpus_pipeline
from lodestone.llm import catalog


def write(spark, tmp_path, words):
    """Clean texts in three languages of invented words, junk, exact and near copies."""
    docs, labels = [], []
    for i in range(300):
        lang = ("en", "fr", "de")[i % 3]
        mark = {"en": "the", "fr": "les", "de": "und"}[lang]
        w = [x for w in words(60, i) for x in (w, mark)]
        if i % 10 == 9:
            w = [x.upper() + "!!" for x in w]
        docs.append((i, " ".join(w), lang, f"s{i % 4}", 0))
        labels.append((i, int(i % 10 != 9), 0))
    copy = dict((d[0], d[1]) for d in docs)
    docs += [(1000 + i, copy[i], "en", "s0", 0) for i in (0, 3, 6)] + [(2000 + i, copy[i] + " one", "en", "s0", 0) for i in (0, 12)]
    docs += [(3000, None, "en", "s", 0), (3001, "", None, None, None), (3002, "12 34", "fr", "s1", 0), (12, copy[12], "en", "s0", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, tmp_path, words):
    d = write(spark, tmp_path, words)
    docs, kept = spark.read.parquet(f"{d}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        if name != "packing":
            assert out.columns == corpus_pipeline.COLUMNS
            out.write.parquet(f"{d}/{name}")
            docs = spark.read.parquet(f"{d}/{name}")
            kept[name] = sorted(r[0] for r in docs.select("doc_id").collect())
    everything = {*range(300), 1000, 1003, 1006, 2000, 2012}
    assert set(kept["language"]) == everything
    assert set(kept["quality"]) == {i for i in everything if i >= 300 or i % 10 != 9}
    assert kept["near_duplicates"] == [i for i in range(300) if i % 10 != 9]
    assert sorted({r.doc_id for r in out.collect()}) == kept["near_duplicates"]
    assert sorted({r.doc_id for r in corpus_pipeline.run(spark, d).collect()}) == kept["near_duplicates"]


def test_near_duplicates_from_four_fifths(spark, words):
    """One word in the middle is another: of n shingles n - 5 stay equal, of n + 5."""
    docs, gone = [], set()
    for k, n in enumerate([44, 45, 46, 50, 54, 56] * 5):
        w = words(n + 4, 500 + k)
        docs += [(2 * k, " ".join(w)), (2 * k + 1, " ".join([*w[: n // 2], f"changed{k}", *w[n // 2 + 1 :]]))]
        gone |= {2 * k + 1} if n >= 45 else set()
    rows = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, rows, "").collect()}
    assert kept == set(range(60)) - gone


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = __spark_entry__.queries()
    assert {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in catalog.queries()}
    assert set(catalog.queries()) < set(names) and names["pipeline"] is corpus_pipeline.run
