"""The gradient-boosted matcher: training, scoring, persistence."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import boosting, metrics
from lodestone.operators.features import FEATURES, PAIR

DEFAULT_THRESHOLD = 0.90


@dataclass(frozen=True)
class MatcherParams:
    """Boosting with row and column samples, weighted positives and a validation part that stops it early."""

    max_iter: int = 100
    max_depth: int = 6
    step: float = 0.05
    min_rows: int = 50
    row_share: float = 0.8
    column_share: str = "0.85"
    tolerance: float = 0.001
    seed: int = 42


@dataclass
class Matcher:
    model: boosting.Trees
    columns: list[str]
    report: dict

    def score(self, matrix: DataFrame) -> DataFrame:
        """``matrix`` with ``prob``, the float probability of a match."""
        return self.model.score(matrix, self.columns)

    def importance(self) -> list[tuple[str, float, float]]:
        """(feature, importance, per cent), largest first."""
        raw = self.model.importances()
        total = raw.sum() or 1.0
        return sorted(((c, float(v), 100 * float(v) / total) for c, v in zip(self.columns, raw)), key=lambda x: (-x[1], x[0]))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        for name, x in (("model", {"nodes": self.model.nodes, "shares": self.model.shares}), ("report", {"columns": self.columns, "report": self.report})):
            spark.createDataFrame([(json.dumps(x),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str) -> Matcher:
        model, own = (json.loads(spark.read.text(f"{path}/{name}").first()[0]) for name in ("model", "report"))
        return cls(boosting.Trees(model["nodes"], model["shares"], len(own["columns"])), own["columns"], own["report"])

    def threshold(self, explicit: float | None = None) -> float:
        """An explicit threshold, else the tuned one, else the default."""
        return explicit if explicit is not None else self.report.get("optimal_threshold", DEFAULT_THRESHOLD)


def train(matrix: DataFrame, split: DataFrame | None, params: MatcherParams = MatcherParams()) -> Matcher:
    """``matrix`` has ``label``; ``split``: (entity_id, split) of the source-1 entities, or None where ``matrix`` has ``is_val``; ``val`` rows stop the boosting."""
    columns = [c for c in FEATURES if c in matrix.columns]
    rows = matrix
    if split is not None:
        own = split.select(F.col("entity_id").alias(PAIR[0]), (F.col("split") == "val").alias("is_val"))
        rows = matrix.join(own, PAIR[0]).select(*columns, "label", "is_val").persist(StorageLevel.DISK_ONLY)
    balance = metrics.class_balance(rows.filter("not is_val")).first()
    weight = float(balance["scale_pos_weight"])
    model = boosting.train(rows, columns, "label", "is_val", weight, params, boosting.slots(rows, (balance["positives"] or 0) + (balance["negatives"] or 0)))[0]
    out = Matcher(model, columns, {"scale_pos_weight": weight, "iterations": len(model.nodes)})
    val = out.score(rows.filter("is_val").select(*columns, "label")).select("label", "prob").persist(StorageLevel.DISK_ONLY)
    out.report |= {"average_precision": metrics.average_precision(val, "prob").first()[0], "roc_auc": metrics.roc_auc(val, "prob").first()[0], **{k: float(v) for k, v in metrics.confusion(val, "prob").first().asDict().items()}}
    val.unpersist()
    if split is not None:
        rows.unpersist()
    return out


def tune(matcher: Matcher, scored_val: DataFrame, ids: DataFrame, truth: DataFrame, thresholds: list[float] | None = None) -> float:
    """The threshold of the best macro F0.5; kept in the report."""
    best = metrics.best_threshold(metrics.sweep(ids, truth, scored_val, thresholds or metrics.grid(0.5, 0.95, 0.05))).first()
    matcher.report |= {"optimal_threshold": best["threshold"], "val_macro_f05": best["macro_f05"]}
    return best["threshold"]


def three_way(df: DataFrame, id_col: str, strata: list[str], val: float = 0.2, test: float = 0.2, seed: int = 42) -> DataFrame:
    """A split with a ``test`` part that neither stops the boosting nor chooses the threshold."""
    from lodestone.operators import sampling

    outer = sampling.split(df, id_col, strata, test, seed).withColumnRenamed("split", "outer")
    inner = sampling.split(outer.filter("outer = 'train'"), id_col, strata, val / (1 - test), seed + 1)
    return inner.drop("outer").unionByName(outer.filter("outer = 'val'").drop("outer").withColumn("split", F.lit("test")))
