"""The steps of a record-linkage project over tables at rest; each reads and writes paths that Spark knows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import names, records, text
from lodestone.operators import blocking, features, matcher, metrics, profile, sampling, submission
from lodestone.sources import readers, writers
from lodestone.sources.staging import staged

PAIR = features.PAIR
#: The table of word costs beside the normalised sources (50,000 words at most).
WORD_COSTS = "word_costs.parquet"


def normalize(spark: SparkSession, directory: str, out: str, splits: tuple[str, ...] = ("train", "test")) -> dict[str, str]:
    """Normalises the three sources of each split; the paths written, by name.

    Glued web names are cut into words by the words of all names; the costs are kept beside the tables for later runs.
    """
    given = {(split, n): readers.source(spark, split, n, directory, missing_as_null=False) for split in splits for n in (1, 2, 3)}
    every = [df.select("business_name") for df in given.values()]
    costs = text.word_costs(reduce(DataFrame.unionByName, every), "business_name")
    writers.parquet(spark.createDataFrame(sorted(costs.items()), "word string, cost double"), f"{out}/{WORD_COSTS}")
    done = {}
    for (split, n), df in given.items():
        done[f"{split}_source{n}"] = path = f"{out}/{split}_source{n}.parquet"
        writers.normalized(records.normalized(df, costs=costs), path)
    return done


def renormalize_names(spark: SparkSession, path: str) -> None:
    """Names of a normalised table anew, in its place; all other columns as they are.

    Word costs are those kept beside the table; without them, those of the table's own names.
    """
    df = spark.read.parquet(path)
    kept = f"{path.rstrip('/').rpartition('/')[0]}/{WORD_COSTS}"
    costs = {r[0]: r[1] for r in spark.read.parquet(kept).collect()} if readers.exists(spark, kept) else text.word_costs(df, "business_name")
    new = names.normalized(df, costs=costs).select(*(c for c in df.columns))
    writers.replace(new, path)


def before_and_after(normalized: DataFrame, n: int = 20, seed: int = 42) -> DataFrame:
    """A sample of records as given and as normalised."""
    return sampling.uniform(normalized, "entity_id", n, seed).select("entity_id", "country", "business_name", "norm_name", "business_address", "norm_address")


def sources(spark: SparkSession, data: str, split: str) -> tuple[DataFrame, DataFrame]:
    """(queries, corpus): source 1, and sources 2 and 3, normalised."""
    s = [spark.read.parquet(f"{data}/{split}_source{n}.parquet") for n in (1, 2, 3)]
    return s[0], readers.corpus(s[1], s[2])


def candidates(spark: SparkSession, data: str, split: str, out: str, config: blocking.BlockingConfig | None = None, *, part: DataFrame | None = None, part_name: str | None = None, sample: int = 0) -> None:
    """Candidate pairs of a split's queries, or of those in a part of it, or of a sample by country."""
    q, c = sources(spark, data, split)
    q = readers.queries(q, part, part_name)
    if sample:
        q = sampling.stratified(q, "entity_id", "country", sample)
    writers.candidate_pairs(blocking.MultiStrategyBlocker(config or blocking.BlockingConfig.production()).fit(c).block_pairs(q), out)


def feature_matrix(spark: SparkSession, data: str, split: str, pairs: str, out: str, truth: DataFrame | None = None) -> DataFrame:
    """Writes the matrix of candidate pairs; with ``truth`` the result counts its classes.

    The idf comes from the training queries' names where there are any, so that both splits share one model.
    """
    q, c = sources(spark, data, split)
    path = f"{data}/train_source1.parquet"
    fit_on = spark.read.parquet(path) if readers.exists(spark, path) else q
    fx = features.FeatureExtractor().fit(fit_on.select("norm_name"))
    writers.parquet(fx.matrix(spark.read.parquet(pairs), features.lookup(q), features.lookup(c), truth), out)
    done = spark.read.parquet(out)
    return features.summary(done) if truth is not None else done.agg(F.count(F.lit(1)).alias("pairs"))


def split_entities(entities: DataFrame, truth: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    return sampling.split(sampling.strata(entities, truth), "entity_id", ["stratum"], share, seed)


def create_split(spark: SparkSession, data: str, truth: DataFrame, out: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Writes the split of the training queries as JSON; its counts by stratum."""
    entities = spark.read.parquet(f"{data}/train_source1.parquet")
    rows = staged(split_entities(entities, truth, share, seed))
    writers.split_file(rows, out, {"share": share, "seed": seed})
    return sampling.strata_table(rows).orderBy("stratum")


def evaluate_blocking(spark: SparkSession, data: str, truth: DataFrame, config: blocking.BlockingConfig | None = None, *, part: DataFrame | None = None, part_name: str | None = None, sample: int = 0) -> dict[str, DataFrame]:
    """Recall, reduction and the ceiling of F0.5 by country, and what each strategy alone finds, over the training queries or a part or sample of them."""
    q, c = sources(spark, data, "train")
    q = readers.queries(q, part, part_name)
    if sample:
        q = sampling.stratified(q, "entity_id", "country", sample)
    q = staged(q)
    own = truth.join(q.select(F.col("entity_id").alias(PAIR[0])), PAIR[0], "left_semi")
    blocker = blocking.MultiStrategyBlocker(config or blocking.BlockingConfig()).fit(c)
    found = blocking.quality(q, staged(blocker.block_pairs(q)), own, c)
    r = F.col("pair_recall") / 100
    return {"by_country": found.withColumn("f05_ceiling", F.round(125.0 * r / (0.25 + r), 4)).orderBy("country"), "by_strategy": blocking.ablation(blocker, q, own)}


def run(spark: SparkSession, data: str, split: str, model: str, out: str, config: blocking.BlockingConfig | None = None, threshold: float | None = None) -> DataFrame:
    """Blocks, scores and writes both lists of a normalised split in one go; the singleton rate.

    Only the scored pairs are kept between blocking and the lists; no matrix is written.  Records are in the order of their ids.
    """
    q, c = sources(spark, data, split)
    path = f"{data}/train_source1.parquet"
    fx = features.FeatureExtractor().fit((spark.read.parquet(path) if readers.exists(spark, path) else q).select("norm_name"))
    pairs = staged(blocking.MultiStrategyBlocker(config or blocking.BlockingConfig.production()).fit(c).block_pairs(q).select(*PAIR))
    found = matcher.Matcher.load(spark, model)
    scored = staged(found.score(fx.matrix(pairs, features.lookup(q), features.lookup(c))).select(*PAIR, "prob"))
    ids = q.select(F.col("entity_id").alias("position"), F.col("entity_id").alias(PAIR[0]))
    return write_lists(ids, scored, pairs, found.threshold(threshold), out)


def write_lists(ids: DataFrame, scored: DataFrame, pairs: DataFrame, threshold: float, out: str) -> DataFrame:
    """Writes matching_results.tsv and candidate_pairs.tsv, a row for each of ``ids`` in order of ``position``; the singleton rate."""
    lists = submission.match_lists(scored, threshold)
    given = submission.ordered_lists(pairs, F.lit(0), "candidates")
    writers.one_file(submission.submission(ids, lists, "matched"), f"{out}/matching_results.tsv")
    writers.one_file(submission.submission(ids, given, "candidates", "candidate_entity_ids"), f"{out}/candidate_pairs.tsv")
    empty = F.array().cast("array<string>")
    return metrics.singleton_rates(ids.join(lists, PAIR[0], "left").select(F.coalesce("matched", empty).alias("matched")))


def train(spark: SparkSession, matrix: str, entities: DataFrame, truth: DataFrame, out: str, params: matcher.MatcherParams = matcher.MatcherParams(), thresholds: list[float] | None = None) -> matcher.Matcher:
    """Trains on a split of the entities, tunes the threshold on its validation part, saves model and report."""
    m = spark.read.parquet(matrix)
    split = split_entities(entities, truth)
    model = matcher.train(m, split, params)
    ids = split.filter("split = 'val'").select(F.col("entity_id").alias(PAIR[0]))
    matcher.tune(model, model.score(m.join(ids, PAIR[0], "left_semi")), ids, truth.join(ids, PAIR[0], "left_semi"), thresholds)
    model.save(out)
    return model


def evaluate(spark: SparkSession, model: str, matrix: str, entities: DataFrame, truth: DataFrame, thresholds: list[float] | None = None) -> dict[str, DataFrame]:
    """The sweep, the best threshold and metrics by country on the validation part."""
    m, found = spark.read.parquet(matrix), matcher.Matcher.load(spark, model)
    val = split_entities(entities, truth).filter("split = 'val'")
    ids = val.select(F.col("entity_id").alias(PAIR[0]))
    scored, true = found.score(m.join(ids, PAIR[0], "left_semi")), truth.join(ids, PAIR[0], "left_semi")
    swept = metrics.sweep(ids, true, scored, thresholds or metrics.grid(0.5, 0.95, 0.05))
    at = found.threshold()
    per = metrics.entity_f05(metrics.entity_counts(ids, true, submission.matches(scored, at)))
    return {"sweep": swept.orderBy("threshold"), "best": metrics.best_threshold(swept), "by_country": metrics.macro_by_country(per, entities), "failures": metrics.failures(scored, true, at)}


def infer(spark: SparkSession, model: str, matrix: str, pairs: str, source1: DataFrame, out: str, threshold: float | None = None) -> DataFrame:
    """Writes matching_results.tsv and candidate_pairs.tsv, a row for each record of ``source1`` in its order (one file's); the singleton rate."""
    found = matcher.Matcher.load(spark, model)
    ids = source1.select(F.monotonically_increasing_id().alias("position"), F.col("entity_id").alias(PAIR[0]))
    return write_lists(ids, found.score(spark.read.parquet(matrix)), spark.read.parquet(pairs), found.threshold(threshold), out)


def validate(spark: SparkSession, matching: str, required: DataFrame, known: DataFrame | None = None, candidates_path: str | None = None) -> tuple[bool, DataFrame]:
    """Whether a match list (and its candidate list) is right, and all findings."""
    header, lines = readers.lines(spark, matching)
    wrong = submission.header_findings(spark, header, submission.MATCH_HEADER)
    parsed = submission.parse_lists(lines)
    out = submission.validate_lists(parsed, required, known)
    if candidates_path:
        header2, lines2 = readers.lines(spark, candidates_path)
        wrong += submission.header_findings(spark, header2, submission.CANDIDATE_HEADER)
        given = submission.parse_lists(lines2)
        out = out.unionByName(submission.validate_lists(given, required, known).withColumn("rule", F.concat(F.lit("candidates_"), "rule"))).unionByName(submission.not_candidates(parsed, given))
    if wrong:
        out = out.unionByName(spark.createDataFrame(wrong, "rule string, severity string, n long, examples array<string>"))
    out = out.persist()
    return submission.ok(out), out


def report(spark: SparkSession, directory: str, split: str = "train") -> str:
    """A profile of the three sources as Markdown."""
    parts = []
    for name, df in readers.all_sources(spark, split, directory).items():
        parts.append(writers.markdown(profile.inspect(df), f"{name}: columns"))
        if name == "ground_truth":
            continue
        parts.append(writers.markdown(profile.prefixes(df), f"{name}: id prefixes"))
        parts.append(writers.markdown(profile.countries(df).orderBy(F.desc("n")), f"{name}: countries"))
        parts.append(writers.markdown(profile.missing(df, ["business_name", "business_address", "country"]), f"{name}: missing values"))
        for col in ("business_name", "business_address"):
            parts.append(writers.markdown(profile.describe(profile.lengths(df, col).withColumn("value", F.col("value").cast("double")), "value", ["what"]), f"{name}: lengths of {col}"))
        parts.append(writers.markdown(profile.noise(df, "business_name", "business_address", ["country"]), f"{name}: noise"))
    return "\n".join(parts)
