from pyspark.sql import functions as F

from lodestone.operators import submission
from lodestone.sources import readers, writers


def test_submission_file(spark, tmp_path):
    scored = spark.createDataFrame(
        [("S1-01", "S3-01", 0.85), ("S1-01", "S2-01", 0.95), ("S1-01", "S2-09", 0.5), ("S1-02", "S2-02", 0.79), ("S1-03", "S2-03", 0.8)],
        "source1_entity_id string, candidate_entity_id string, prob double",
    )
    ids = spark.createDataFrame([(i, f"S1-0{4 - i}") for i in range(4)], "position int, source1_entity_id string")
    out = submission.submission(ids, submission.match_lists(scored, 0.80), "matched")
    writers.one_file(out, str(tmp_path / "matching.tsv"))
    text = (tmp_path / "matching.tsv").read_text()
    assert text == "source1_entity_id\tmatched_entity_ids\nS1-04\t\nS1-03\tS2-03\nS1-02\t\nS1-01\tS2-01,S3-01\n"
    first, lines = readers.lines(spark, str(tmp_path / "matching.tsv"))
    assert submission.header_findings(spark, first, submission.MATCH_HEADER) == []
    parsed = submission.parse_lists(lines)
    required = ids.select("source1_entity_id")
    known = spark.createDataFrame([("S2-01",), ("S3-01",), ("S2-03",)], "entity_id string")
    findings = submission.validate_lists(parsed, required, known)
    assert submission.ok(findings), findings.filter("n > 0").collect()
    assert sorted(r[0] for r in readers.ids(spark, str(tmp_path / "matching.tsv")).collect()) == ["S1-01", "S1-02", "S1-03", "S1-04"]


def test_findings(spark):
    rows = ["S1-1\tS2-1,S2-1", "S1-2\tS1-2", "S1-3\tX-1", "S1-4", "S1-5\tS2-1\textra", "S1-2\tS3-8", "", "S1-9\t"]
    parsed = submission.parse_lists(spark.createDataFrame([(r,) for r in rows], "value string"))
    required = spark.createDataFrame([(f"S1-{i}",) for i in range(1, 8)], "source1_entity_id string")
    got = {r.rule: (r.n, list(r.examples)) for r in submission.validate_lists(parsed, required, spark.createDataFrame([("S2-1",)], "entity_id string")).collect()}
    assert got["malformed_row"][0] == 2 and got["duplicate_row"] == (1, ["S1-2"]) and got["duplicate_in_list"] == (1, ["S1-1"])
    assert got["self_match"] == (1, ["S1-2"]) and got["wrong_prefix"] == (1, ["X-1"]) and got["unknown_id"] == (1, ["S3-8"])
    assert got["missing_entity"] == (4, ["S1-4", "S1-5", "S1-6", "S1-7"]) and got["extra_entity"] == (1, ["S1-9"])
    assert submission.header_findings(spark, "source1_entity_id,matched_entity_ids", submission.MATCH_HEADER)[0][0] == "comma_separated"
    assert submission.header_findings(spark, "x", submission.MATCH_HEADER)[0][0] == "wrong_header"
    assert submission.not_candidates(parsed, parsed.filter("source1_entity_id <> 'S1-3'")).first().examples == ["S1-3>X-1"]


def test_sources(spark, tmp_path):
    d = tmp_path / "train"
    d.mkdir()
    for n in (1, 2, 3):
        (d / f"train_source{n}.tsv").write_text(f"entity_id\tbusiness_name\tbusiness_address\tcountry\nS{n}-1\tA \"B\tNULL\tUS\nS{n}-2\t\tx\tIndia\n")
    (d / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S3-1,S2-1\nS1-2\t\n")
    directory = readers.data_dir(spark, [str(tmp_path / "none"), str(tmp_path)])
    assert directory == str(tmp_path)
    s = readers.all_sources(spark, "train", directory)
    assert [tuple(r) for r in s["source1"].orderBy("entity_id").collect()] == [("S1-1", 'A "B', None, "US"), ("S1-2", None, "x", "India")]
    assert readers.corpus(s["source2"], s["source3"]).count() == 4 and readers.corpus(s["source2"], s["source3"], 3).count() == 3
    lists = readers.truth_lists(s["ground_truth"]).orderBy("source1_entity_id").collect()
    assert [list(r.matched) for r in lists] == [["S2-1", "S3-1"], []]
    split = spark.createDataFrame([("S1-1", "train"), ("S1-2", "val")], "entity_id string, split string")
    writers.split_file(split, str(tmp_path / "split.json"), {"seed": 42})
    back = readers.split_file(spark, str(tmp_path / "split.json"))
    assert sorted(map(tuple, back.collect())) == [("S1-1", "train"), ("S1-2", "val")]
    assert [r[0] for r in readers.queries(s["source1"], back, "val").select("entity_id").collect()] == ["S1-2"]


def test_replace_in_place(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(5).write.parquet(path)
    writers.replace(spark.read.parquet(path).withColumn("x", F.col("id") + 1), path)
    assert spark.read.parquet(path).agg(F.sum("x")).first()[0] == 15
    assert "| id |" in writers.markdown(spark.range(2), "T")


def test_lines_keeps_a_repeated_header(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("a\tb\nx\ty\na\tb\n")
    first, rest = readers.lines(spark, str(tmp_path / "m.tsv"))
    assert first == "a\tb" and [r[0] for r in rest.collect()] == ["x\ty", "a\tb"]


def test_replace_puts_back_what_a_run_left_aside(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path + ".old")  # a run that ended between its renames
    writers.replace(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and not (tmp_path / "t.old").exists()
