"""Profiles of record tables and notes on matched pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.dialect import SPARK

# Patterns of noise in names.
LEADING_LEGAL = r"(?i)^(?:pvt|private|llc|inc|corp|ltd|m/s|shri)(?:[^\p{L}\p{N}_]|$)"
TRAILING_LEGAL = r"(?i)(?:^|[^\p{L}\p{N}_])(?:llc|inc|corp|corporation|ltd|limited|llp|co)\.?$"
PUNCTUATION_FIRST = r"^[\s<>\-+#*]+"
NON_ASCII = r"[^\x00-\x7F]"


def inspect(df: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """A row per column: type, rows, nulls, distinct values, and whether it could be a key."""
    kinds = dict(df.dtypes)
    row = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(F.when(F.col(c).isNull(), 1)).alias(f"null_{i}") for i, c in enumerate(df.columns)), *(F.countDistinct(c).alias(f"dist_{i}") for i, c in enumerate(df.columns)))
    parts = [F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.col("n").alias("rows"), F.col(f"null_{i}").alias("nulls"), F.col(f"dist_{i}").alias("distinct"), (F.col("n") == F.col(f"dist_{i}")).alias("unique")) for i, c in enumerate(df.columns)]
    return row.select(F.explode(F.array(*parts)).alias("r")).select("r.*")


def prefixes(df: DataFrame, id_col: str = "entity_id") -> DataFrame:
    """Counts of what stands before the first hyphen of ids."""
    return df.groupBy(F.regexp_extract(id_col, r"^([A-Za-z0-9]+-)", 1).alias("prefix")).agg(F.count(F.lit(1)).alias("n"))


def countries(df: DataFrame, col: str = "country") -> DataFrame:
    """Count and share (per cent) of each value, nulls among them."""
    total = df.agg(F.count(F.lit(1)).alias("total"))
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(total)).select(col, "n", (100.0 * F.col("n") / F.col("total")).alias("pct"))


def missing(df: DataFrame, cols: list[str]) -> DataFrame:
    """Null and empty counts of each column."""
    row = df.agg(*(F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in cols), *(F.count_if(F.trim(c) == "").alias(f"e_{c}") for c in cols))
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("nulls"), F.col(f"e_{c}").alias("empty")) for c in cols))).alias("r")).select("r.*")


def lengths(df: DataFrame, col: str) -> DataFrame:
    """(what, value): characters and words of a text column."""
    c = F.coalesce(F.col(col), F.lit(""))
    words = F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))
    return df.select(F.explode(F.array(F.struct(F.lit("chars").alias("what"), F.length(c).alias("value")), F.struct(F.lit("words").alias("what"), words.alias("value")))).alias("r")).select("r.*")


QUANTILES = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def describe(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quantiles (linear between values)."""
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).cast("double").alias("min"),
        *(F.percentile(value, F.lit(q)).alias(n) for n, q in QUANTILES.items()), F.max(value).cast("double").alias("max"),
    )


def top_tokens(df: DataFrame, col: str, by: str, n: int = 40) -> DataFrame:
    """The ``n`` commonest words of each group; ties in order of the word."""
    words = df.select(by, F.explode(F.expr(f"regexp_extract_all(lower({col}), {SPARK.text(chr(92) + 'b([a-z0-9_' + chr(39) + '-]+)' + chr(92) + 'b')}, 1)")).alias("token"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), "token")
    return words.groupBy(by, "token").agg(F.count(F.lit(1)).alias("n")).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def _share(c: Column) -> Column:
    return 100.0 * F.avg(F.coalesce(c, F.lit(False)).cast("int"))


def noise(df: DataFrame, name: str, address: str, by: list[str]) -> DataFrame:
    """Shares (per cent) of noise patterns in names and addresses."""
    caps = lambda c: (F.upper(c) == F.col(c)) & (F.lower(c) != F.col(c))
    return df.groupBy(*by).agg(
        _share(F.col(name).rlike(NON_ASCII)).alias("name_non_ascii"), _share(F.col(address).rlike(NON_ASCII)).alias("address_non_ascii"),
        _share(F.col(name).rlike(LEADING_LEGAL)).alias("leading_legal"), _share(F.col(name).rlike(TRAILING_LEGAL)).alias("trailing_legal"),
        _share(F.col(name).rlike(PUNCTUATION_FIRST)).alias("punctuation_prefix"), _share(caps(name)).alias("name_all_caps"), _share(caps(address)).alias("address_all_caps"),
    )


def note_parts(df: DataFrame, name: str, address: str, prefix: str) -> DataFrame:
    """``df`` with what ``notes`` compares of a record, as columns that start with ``prefix``."""
    words = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != "")))
    n, a = (F.trim(F.coalesce(F.col(c), F.lit(""))) for c in (name, address))
    out = df.withColumns({f"{prefix}n": n, f"{prefix}a": a})
    out = out.withColumns({f"{prefix}ln": F.lower(f"{prefix}n"), f"{prefix}la": F.lower(f"{prefix}a")})
    n, ln, a, la = (F.col(f"{prefix}{c}") for c in ("n", "ln", "a", "la"))
    parts = F.filter(F.transform(F.split(la, ","), lambda w: F.trim(w)), lambda w: w != "")
    return out.withColumns({
        f"{prefix}words": words(ln), f"{prefix}foreign": n.rlike(NON_ASCII), f"{prefix}web": ln.contains("www.") | ln.contains(".com"), f"{prefix}gone": la.isin("", "nan", "none", "null"),
        f"{prefix}near": la.contains("near") | la.contains("opp"), f"{prefix}numbered": F.filter(words(a), lambda w: w.rlike("[0-9]")), f"{prefix}parts": parts, f"{prefix}set": F.array_sort(F.array_distinct(parts)),
    })


def notes(s1: str, t: str) -> Column:
    """How the target (columns of ``note_parts`` with prefix ``t``) differs from the source."""
    l, r = (lambda c: F.col(f"{s1}{c}")), (lambda c: F.col(f"{t}{c}"))
    inside = lambda p, q: F.size(F.array_except(p, q)) == 0
    other, gone = l("ln") != r("ln"), r("gone")
    moved = ~gone & (l("la") != r("la"))
    some = inside(l("words"), r("words")) | inside(r("words"), l("words"))
    found = [
        (~other & (l("n") != r("n")), "Case variation only"),
        (l("n") == r("n"), "Exact name match"),
        (other & r("foreign"), "Non-Latin/Indic script or accent in name"),
        (other & r("web"), "URL / Domain appended to name"),
        (other & (l("words") == r("words")), "Name word transposition/reordering"),
        (other & (l("words") != r("words")) & some, "Legal suffix/prefix addition or omission"),
        (other & ~some, "Lexical variation / typo / alias"),
        (gone, "Target address MISSING (Null)"),
        (~gone & (l("la") == r("la")) & (l("a") != r("a")), "Address case variation"),
        (~gone & (l("a") == r("a")), "Exact address match"),
        (moved & (l("near") | r("near")), "Landmark addition/omission"),
        (moved & (l("numbered") != r("numbered")), "Street/Door number variation (range or unit)"),
        (moved & (l("set") == r("set")) & (l("parts") != r("parts")), "Address component inversion/reordering"),
    ]
    text = F.concat_ws("; ", *(F.when(c, F.lit(n)) for c, n in found))
    return F.when(text == "", "Minor lexical variation").otherwise(text)


def change_notes(pairs: DataFrame, s1_name: str, t_name: str, s1_addr: str, t_addr: str) -> DataFrame:
    """``pairs`` with ``notes`` on how the target differs from the source."""
    both = note_parts(note_parts(pairs, s1_name, s1_addr, "_s_"), t_name, t_addr, "_t_")
    return both.select(*pairs.columns, notes("_s_", "_t_").alias("notes"))


def class_notes(sources: DataFrame, targets: DataFrame, name: str, address: str, by: str) -> DataFrame:
    """Notes on all pairs of equal ``by`` without listing copies: (kind, source1_entity_id, candidate_entity_id, representative, notes).

    Records of a side with the same ``by``, name and address are a class, its smallest id their representative.  A row of
    kind ``pair`` has the representatives of two classes and notes; a ``member`` row has a record's id, on its side, and its
    representative.  The pairs of all records are the pair rows with either id replaced by each of its members.
    """
    pair = ["source1_entity_id", "candidate_entity_id"]
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    members, sides = [], []
    for df, id_, p in ((sources, pair[0], "_s_"), (targets, pair[1], "_t_")):
        own = df.select(F.col("entity_id"), F.col(by).alias("by"), text(name), text(address))
        classes = own.groupBy("by", name, address).agg(F.min("entity_id").alias(id_))
        sides.append(note_parts(classes, name, address, p).drop(name, address))
        rows = own.distinct().join(classes.withColumnRenamed(id_, "representative"), ["by", name, address])
        both = [(F.col("entity_id") if c == id_ else F.lit(None).cast("string")).alias(c) for c in pair]
        members.append(rows.select(F.lit("member").alias("kind"), *both, "representative", F.lit(None).cast("string").alias("notes")))
    found = sides[0].join(sides[1], "by").select(F.lit("pair").alias("kind"), *pair, F.lit(None).cast("string").alias("representative"), notes("_s_", "_t_").alias("notes"))
    return found.unionByName(members[0]).unionByName(members[1])
