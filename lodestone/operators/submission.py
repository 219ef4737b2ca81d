"""Match lists and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATCH_HEADER = "source1_entity_id\tmatched_entity_ids"
CANDIDATE_HEADER = "source1_entity_id\tcandidate_entity_ids"
PAIR = ["source1_entity_id", "candidate_entity_id"]


def matches(scored: DataFrame, threshold: float) -> DataFrame:
    """Pairs at or over the threshold; both sides compare as float."""
    return scored.filter(F.col("prob").cast("float") >= F.lit(threshold).cast("float"))


def ordered_lists(pairs: DataFrame, order: Column, out: str) -> DataFrame:
    """(source1_entity_id, out): each id's candidates by ``order``, then id; each once, at its first place."""
    row = F.struct(order.alias("o"), F.col(PAIR[1]).alias("c"))
    return pairs.groupBy(PAIR[0]).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["c"])).alias(out))


def match_lists(scored: DataFrame, threshold: float) -> DataFrame:
    """Matches of each id, the most probable first."""
    return ordered_lists(matches(scored, threshold), -F.col("prob"), "matched")


def submission(ids: DataFrame, lists: DataFrame, col: str, out: str = "matched_entity_ids", by: str = "position") -> DataFrame:
    """A row for each of ``ids`` (source1_entity_id, position), in order of position; ids without a list get an empty text."""
    joined = ids.join(lists, PAIR[0], "left").select(by, PAIR[0], F.coalesce(F.array_join(col, ","), F.lit("")).alias(out))
    return joined.orderBy(by).select(PAIR[0], out)


def parse_lists(lines: DataFrame) -> DataFrame:
    """(line, fields, source1_entity_id, ids) of the text lines (``value``) after the header; blank lines are left out."""
    f = F.split("value", "\t")
    ids = F.filter(F.transform(F.split(F.coalesce(F.try_element_at(f, F.lit(2)), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return lines.filter(F.trim("value") != "").select(F.col("value").alias("line"), F.size(f).alias("fields"), F.trim(f[0]).alias("source1_entity_id"), ids.alias("ids"))


def _finding(rows: DataFrame, rule: str, severity: str, value: Column) -> DataFrame:
    """A row: how many hits, and the first five in order."""
    hits = rows.select(value.cast("string").alias("v"))
    first = hits.distinct().orderBy("v").limit(5).agg(F.array_sort(F.collect_list("v")).alias("examples"))
    return hits.agg(F.count(F.lit(1)).alias("n")).join(first).select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), "n", "examples")


def header_findings(spark, header: str | None, expected: str) -> list[tuple[str, str, int, list[str]]]:
    """What is wrong with a file's first line."""
    if header is None:
        return [("empty_file", "error", 1, [])]
    if header.rstrip("\r\n") == expected:
        return []
    return [("comma_separated" if header.replace(",", "\t").rstrip("\r\n") == expected else "wrong_header", "error", 1, [header[:80]])]


def validate_lists(parsed: DataFrame, required: DataFrame, known: DataFrame | None = None, prefixes: tuple[str, ...] = ("S2-", "S3-"), own: str = "S1-") -> DataFrame:
    """(rule, severity, n, examples) of a file of lists: malformed and repeated rows, repeated ids in a row, matches of the own
    source, other prefixes, ids that ``known`` (entity_id) hasn't, ids of ``required`` (source1_entity_id) without row and rows beyond it."""
    good = parsed.filter("fields = 2")
    ids = good.select("source1_entity_id", F.explode("ids").alias("id"))
    right = F.lit(False)
    for p in prefixes:
        right = right | F.col("id").startswith(p)
    key = F.col("source1_entity_id")
    rows = [
        _finding(parsed.filter("fields <> 2"), "malformed_row", "error", F.col("line")),
        _finding(good.groupBy("source1_entity_id").count().filter("count > 1"), "duplicate_row", "error", key),
        _finding(good.filter(F.size("ids") > F.size(F.array_distinct("ids"))), "duplicate_in_list", "error", key),
        _finding(ids.filter(F.col("id").startswith(own)), "self_match", "error", F.col("id")),
        _finding(ids.filter(~right & ~F.col("id").startswith(own)), "wrong_prefix", "error", F.col("id")),
        _finding(required.join(good, "source1_entity_id", "left_anti"), "missing_entity", "error", key),
        _finding(good.join(required, "source1_entity_id", "left_anti"), "extra_entity", "error", key),
    ]
    if known is not None:
        rows.append(_finding(ids.filter(right).join(known.select(F.col("entity_id").alias("id")), "id", "left_anti"), "unknown_id", "error", F.col("id")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def not_candidates(matched: DataFrame, candidates: DataFrame) -> DataFrame:
    """A warning for matched ids that are no candidates of their entity (both parsed lists)."""
    m, c = (x.filter("fields = 2").select("source1_entity_id", F.explode("ids").alias("id")) for x in (matched, candidates))
    return _finding(m.distinct().join(c.distinct(), ["source1_entity_id", "id"], "left_anti"), "match_not_candidate", "warning", F.concat_ws(">", "source1_entity_id", "id"))


def ok(findings: DataFrame) -> bool:
    """Whether no error was found: an exit status of 0."""
    return findings.filter("severity = 'error' and n > 0").isEmpty()
