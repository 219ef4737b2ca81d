"""Sinks: Parquet tables, tab separated files, split files, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NORMALIZED = [
    "entity_id", "country", "business_name", "business_address", "norm_name", "norm_name_no_legal", "legal_type", "credential",
    "norm_address", "addr_street_number", "addr_street_name", "addr_unit", "addr_landmark", "addr_city", "addr_state", "addr_postal_code",
]


def _fs(df: DataFrame, path: str):
    sc = df.sparkSession.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path
    return p, p(path).getFileSystem(sc._jsc.hadoopConfiguration())


def normalized(df: DataFrame, path: str) -> None:
    """The 16 columns of normalised entities, as strings."""
    df.select(*(F.col(c).cast("string").alias(c) for c in NORMALIZED)).write.mode("overwrite").parquet(path, compression="snappy")


def parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path, compression="snappy")


def replace(df: DataFrame, path: str) -> None:
    """Puts ``df``, which may read from ``path``, in its place: written beside it, then renamed.

    The old table is deleted only when the new one stands in its place; if that fails, it is put back.
    """
    p, fs = _fs(df, path)
    new, old = f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    if fs.exists(p(old)):
        if fs.exists(p(path)):
            fs.delete(p(old), True)
        elif not fs.rename(p(old), p(path)):  # an earlier run ended between its renames
            raise OSError(f"can't put {old} back")
    df.write.mode("overwrite").parquet(new)
    was = fs.exists(p(path))
    if was and not fs.rename(p(path), p(old)):
        raise OSError(f"can't move {path} aside")
    if not fs.rename(p(new), p(path)):
        if was and not fs.rename(p(old), p(path)):
            raise OSError(f"can't put {new} in place; the old table is in {old}")
        raise OSError(f"can't put {new} in place; the old table stays")
    fs.delete(p(old), True)


def tsv(df: DataFrame, path: str) -> None:
    """A directory of tab separated part files, each with a header, rows in the order of ``df``."""
    df.write.mode("overwrite").csv(path, sep="\t", header=True, quote="", emptyValue="")


def one_file(df: DataFrame, path: str) -> None:
    """One tab separated file with one header, rows in the order of ``df``: sorted parts are joined one after the other.

    A single file is written by a single writer: all its bytes pass through the driver.
    """
    parts = f"{path}.parts"
    text = df.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)).alias("value"))
    text.write.mode("overwrite").text(parts)
    p, fs = _fs(df, path)
    out = fs.create(p(path), True)
    out.write(bytearray(("\t".join(df.columns) + "\n").encode()))
    jvm = df.sparkSession.sparkContext._jvm
    for part in sorted(f.getPath().toString() for f in fs.listStatus(p(parts)) if f.getPath().getName().startswith("part-")):
        src = fs.open(p(part))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(src, out, 1 << 20, False)
        src.close()
    out.close()
    fs.delete(p(parts), True)


def candidate_pairs(pairs: DataFrame, path: str) -> None:
    """(source1_entity_id, candidate_entity_id) as Parquet."""
    parquet(pairs.select("source1_entity_id", "candidate_entity_id"), path)


def pairs_of_lists(lists: DataFrame, col: str = "candidates") -> DataFrame:
    """A row per candidate of (source1_entity_id, list)."""
    return lists.select("source1_entity_id", F.explode(col).alias("candidate_entity_id"))


def lists_as_text(lists: DataFrame, col: str = "candidates", out: str = "candidate_entity_ids") -> DataFrame:
    return lists.select("source1_entity_id", F.array_join(col, ",").alias(out))


def split_file(split: DataFrame, path: str, metadata: dict | None = None) -> None:
    """A JSON document of train_entity_ids and val_entity_ids, written by one task."""
    part = lambda s: F.sort_array(F.collect_list(F.when(F.col("split") == s, F.col("entity_id"))))
    row = split.agg(part("train").alias("train_entity_ids"), part("val").alias("val_entity_ids"))
    row.withColumn("metadata", F.lit(json.dumps(metadata or {}))).write.mode("overwrite").json(path)


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A report table of a small result (at most ``most`` rows)."""
    rows = df.limit(most).collect()
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v)
    body = ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]
    return "\n".join([f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns), *body, ""])
