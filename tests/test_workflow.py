import random

from lodestone import __main__ as cli
from lodestone import workflow
from lodestone.operators import matcher
from lodestone.sources import readers

WORDS = "apex zenith oak river stone harbor maple cedar summit valley prairie canyon meadow lagoon timber falcon".split()


def write(tmp_path):
    rng = random.Random(5)
    rows, truth = {n: [] for n in (1, 2, 3)}, []
    for e in range(60):
        name = " ".join(rng.sample(WORDS, 3))
        street, zip_ = f"{rng.randint(10, 999)} {rng.choice(WORDS)} St", f"{rng.randint(10000, 99999)}"
        rows[1].append((f"S1-{e}", f"{name} LLC", f"{street}, Iowa City, IA {zip_}", "US"))
        ids = []
        for n in (2, 3):
            if e % 5:
                ids.append(f"S{n}-{e}")
                rows[n].append((f"S{n}-{e}", f"{name.upper()} Inc.", f"{street}, Iowa City, Iowa {zip_}", "US"))
            rows[n].append((f"S{n}-{e + 500}", " ".join(rng.sample(WORDS, 3)), f"{rng.randint(10, 999)} Oak Rd, Rome, NY", "US"))
        truth.append((f"S1-{e}", ",".join(ids)))
    for split in ("train", "test"):
        (tmp_path / split).mkdir()
        for n in (1, 2, 3):
            lines = ["entity_id\tbusiness_name\tbusiness_address\tcountry", *("\t".join(r) for r in rows[n])]
            (tmp_path / split / f"{split}_source{n}.tsv").write_text("\n".join(lines) + "\n")
    (tmp_path / "train" / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"{a}\t{b}\n" for a, b in truth))


def test_end_to_end(spark, tmp_path, monkeypatch):
    write(tmp_path)
    raw, data = str(tmp_path), str(tmp_path / "data")
    workflow.normalize(spark, raw, data)
    workflow.renormalize_names(spark, f"{data}/test_source1.parquet")
    assert workflow.before_and_after(spark.read.parquet(f"{data}/train_source1.parquet"), 3).count() == 3
    truth = readers.truth_pairs(readers.truth_lists(readers.truth(spark, raw)))
    for split in ("train", "test"):
        workflow.candidates(spark, data, split, f"{data}/pairs_{split}.parquet")
        workflow.feature_matrix(spark, data, split, f"{data}/pairs_{split}.parquet", f"{data}/matrix_{split}.parquet", truth if split == "train" else None)
    entities = spark.read.parquet(f"{data}/train_source1.parquet")
    model = workflow.train(spark, f"{data}/matrix_train.parquet", entities, truth, f"{data}/model", matcher.MatcherParams(max_iter=5, max_depth=3, min_rows=2, row_share=1.0))
    assert model.report["val_macro_f05"] > 0.8
    found = workflow.evaluate(spark, f"{data}/model", f"{data}/matrix_train.parquet", entities, truth)
    assert found["best"].first().macro_f05 == model.report["val_macro_f05"]
    source1 = readers.source(spark, "test", 1, raw)
    rate = workflow.infer(spark, f"{data}/model", f"{data}/matrix_test.parquet", f"{data}/pairs_test.parquet", source1, f"{data}/out").first()
    assert rate.entities == 60 and 5 <= rate.singletons <= 25
    fused = workflow.run(spark, data, "test", f"{data}/model", f"{data}/fused").first()
    assert fused == rate

    def lists(path):
        return sorted((tmp_path / "data" / path).read_text().splitlines()[1:])

    assert lists("fused/matching_results.tsv") == lists("out/matching_results.tsv")
    table = workflow.create_split(spark, data, truth, f"{data}/split.json").collect()
    assert sum(r.total for r in table) == 60 and readers.split_file(spark, f"{data}/split.json").filter("split = 'val'").count() == sum(r.val for r in table)
    blocks = workflow.evaluate_blocking(spark, data, truth)
    best = blocks["by_country"].filter("country IS NULL").first()
    assert best.pair_recall > 95 and best.f05_ceiling > 0.95 and blocks["by_strategy"].count() >= 3
    monkeypatch.setattr(spark, "stop", lambda: None)
    d = f"{raw}/test/test_source"
    args = ["validate", "--matching", f"{data}/out/matching_results.tsv", "--source1", f"{d}1.tsv", "--candidate", f"{data}/out/candidate_pairs.tsv", "--corpus", f"{d}2.tsv", f"{d}3.tsv"]
    assert cli.main(args) == 0
    (tmp_path / "bad.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-0\tS1-0\n")
    assert cli.main(["validate", "--matching", str(tmp_path / "bad.tsv"), "--source1", f"{d}1.tsv"]) == 1
    assert cli.main(["validate", "--matching", str(tmp_path / "none.tsv"), "--source1", f"{d}1.tsv"]) == 2
    assert "countries" in workflow.report(spark, raw)
