"""Command line: python -m lodestone STEP ..., each step over paths."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone import workflow
from lodestone.operators import metrics
from lodestone.operators.blocking import BlockingConfig
from lodestone.sources import readers, writers


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone", description="Record linkage on Spark")
    s = p.add_subparsers(dest="step", required=True)

    def step(name: str, *flags: tuple[str, dict]) -> None:
        q = s.add_parser(name)
        for flag, kw in flags:
            q.add_argument(flag, **kw)

    need, split = {"required": True}, ("--split", {"default": "train", "choices": ["train", "test"]})
    raw, data, out = ("--raw-dir", need), ("--data-dir", need), ("--out", need)
    sweep = (("--min-thresh", {"type": float, "default": 0.5}), ("--max-thresh", {"type": float, "default": 0.95}), ("--step-thresh", {"type": float, "default": 0.05}))
    step("normalize", raw, out)
    step("renormalize", ("--table", need))
    step("split", data, out, ("--ground-truth", need), ("--share", {"type": float, "default": 0.2}), ("--seed", {"type": int, "default": 42}))
    step("blocking", data, ("--ground-truth", need), ("--sample", {"type": int, "default": 0}), ("--max-candidates", {"type": int, "default": 200}), ("--max-block-size", {"type": int, "default": 1200}))
    step("run", data, split, ("--model", need), out, ("--threshold", {"type": float}))
    step("candidates", data, split, out, ("--max-candidates", {"type": int, "default": 25}), ("--max-block-size", {"type": int, "default": 1200}), ("--sample", {"type": int, "default": 0}))
    step("features", data, split, out, ("--candidate-pairs", need), ("--ground-truth", {}))
    step("train", data, out, ("--features", need), ("--ground-truth", need), *sweep)
    step("evaluate", data, ("--features", need), ("--model", need), ("--ground-truth", need), *sweep)
    step("infer", ("--model", need), ("--features", need), ("--candidate-pairs", need), ("--source1", need), out, ("--threshold", {"type": float}))
    step("validate", ("--matching", need), ("--source1", need), ("--candidate", {}), ("--corpus", {"nargs": "*", "default": []}))
    step("profile", raw, split)
    return p


def main(args: list[str] | None = None) -> int:
    """The exit status: 0, 1 for findings, 2 for tables that can't be read or written."""
    try:
        return _main(args)
    except (OSError, UnicodeDecodeError, AnalysisException) as e:
        print(f"lodestone: {e}", file=sys.stderr)
        return 2


def _main(args: list[str] | None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName(f"lodestone {a.step}").getOrCreate()
    truth = readers.truth_pairs(readers.truth_lists(readers.tsv(spark, a.ground_truth, readers.TRUTH, missing_as_null=False))) if getattr(a, "ground_truth", None) else None
    grid = metrics.grid(a.min_thresh, a.max_thresh, a.step_thresh) if hasattr(a, "min_thresh") else None
    entities = spark.read.parquet(f"{a.data_dir}/train_source1.parquet") if a.step in ("train", "evaluate") else None
    if a.step == "normalize":
        print(*workflow.normalize(spark, a.raw_dir, a.out).values(), sep="\n")
    elif a.step == "renormalize":
        workflow.renormalize_names(spark, a.table)
    elif a.step == "split":
        print(writers.markdown(workflow.create_split(spark, a.data_dir, truth, a.out, a.share, a.seed), "Split"))
    elif a.step == "blocking":
        config = BlockingConfig(enable_tfidf=False, max_candidates_per_query=a.max_candidates, max_block_size=a.max_block_size)
        for name, df in workflow.evaluate_blocking(spark, a.data_dir, truth, config, sample=a.sample).items():
            print(writers.markdown(df, name))
    elif a.step == "run":
        print(writers.markdown(workflow.run(spark, a.data_dir, a.split, a.model, a.out, threshold=a.threshold), "Singletons"))
    elif a.step == "candidates":
        config = BlockingConfig(enable_tfidf=False, max_candidates_per_query=a.max_candidates, max_block_size=a.max_block_size)
        workflow.candidates(spark, a.data_dir, a.split, a.out, config, sample=a.sample)
    elif a.step == "features":
        print(writers.markdown(workflow.feature_matrix(spark, a.data_dir, a.split, a.candidate_pairs, a.out, truth), "Feature matrix"))
    elif a.step == "train":
        print(workflow.train(spark, a.features, entities, truth, a.out, thresholds=grid).report)
    elif a.step == "evaluate":
        for name, df in workflow.evaluate(spark, a.model, a.features, entities, truth, grid).items():
            print(writers.markdown(df, name))
    elif a.step == "infer":
        source1 = readers.tsv(spark, a.source1, readers.SOURCE)
        print(writers.markdown(workflow.infer(spark, a.model, a.features, a.candidate_pairs, source1, a.out, a.threshold), "Singletons"))
    elif a.step == "validate":
        required = readers.ids(spark, a.source1).select(F.col("id").alias("source1_entity_id"))
        known = None
        for path in a.corpus:
            own = readers.ids(spark, path).select(F.col("id").alias("entity_id"))
            known = own if known is None else known.unionByName(own)
        good, findings = workflow.validate(spark, a.matching, required, known, a.candidate)
        print(writers.markdown(findings.filter("n > 0"), "Findings"))
        return 0 if good else 1
    elif a.step == "profile":
        print(workflow.report(spark, a.raw_dir, a.split))
    return 0


if __name__ == "__main__":
    sys.exit(main())
