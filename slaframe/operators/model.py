"""Breach-risk model, evaluation and permutation importance.

* The split is an exact stratified 80/20 split by a seeded md5 order, built
  on ``exact_stratified_flag`` (radix descent to one cut a label class).
* The classifier is MLlib's ``GBTClassifier`` inside a ``Pipeline``
  (StringIndexer + OneHotEncoder + VectorAssembler). It is distributed; its
  ``checkpointInterval`` cuts lineage through the session's checkpoint folder. Beyond
  ``MLLIB_ROWS`` rows, where MLlib's fit depends on the order in which a shuffle delivers them,
  ``gbt.fit`` builds the same kind of model over bundled histograms.
* AUC is exact (mid-rank / Mann-Whitney form) and distributed: labels are
  pre-aggregated per distinct score, negatives below each score come from a
  per-bucket prefix sum (at most ``AUC_BUCKETS`` rows) plus a prefix sum
  inside each score bucket. Buckets are cut at quantiles of the distinct
  scores, so they stay even wherever the scores lie. It supports extra grouping keys, which the
  permutation importance uses to score all (feature, repeat) variants in one
  job.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import dbl
from ..functions.strata import exact_stratified_flag, hash_order
from ..session import ensure_checkpoint_dir
from . import gbt

CAT_COLS = ["district", "ward", "dept", "category", "reported_via"]
NUM_COLS = ["severity", "citizen_sentiment", "vulnerable_population", "historical_backlog",
            "resource_availability", "weather_rain_mm", "traffic_index", "festival_season",
            "created_hour", "is_business_hours", "is_weekend"]
FEATURES = CAT_COLS + NUM_COLS  # escalation columns are left out: they leak the label
LABEL = "sla_breach"
AUC_BUCKETS = 1024
MLLIB_ROWS = 50_000  # training rows that MLlib's own fit takes
PERMUTATION_DIGITS = 3  # leading hex digits that deal rows into rank buckets


def features(df: DataFrame, keep: tuple[str, ...] = ("ticket_id", LABEL)) -> DataFrame:
    """The 16 model features plus id and label."""
    return df.select(*keep, *FEATURES)


def standardize(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Z-score with the population standard deviation (like sklearn's
    StandardScaler; MLlib's uses the sample one). The means and deviations are
    scalar subqueries, which Catalyst merges into one extra aggregate scan."""
    cols = cols or NUM_COLS
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])
    out = {}
    for c in cols:
        mean = stats.select(f"m_{c}").scalar()
        sd = stats.select(f"s_{c}").scalar()
        out[f"{c}_z"] = F.when(sd == 0, dbl(0.0)).otherwise((F.col(c) - mean) / sd)
    return df.withColumns(out)


def stratified_split(df: DataFrame, label: str = LABEL, test_fraction: float = 0.2, seed: str = "42") -> DataFrame:
    """Add ``is_test``; per label class ceil(fraction * n) rows go to
    test, chosen by md5(ticket_id || seed)."""
    return exact_stratified_flag(df, label, lambda n: F.ceil(dbl(test_fraction) * n), hash_order(F.col("ticket_id"), seed), "is_test")


def encoding_stages() -> list:
    """Categories indexed by frequency in the training rows (ties by name),
    then one-hot with a place for unseen ones; one pass for all five columns."""
    idx = StringIndexer(inputCols=CAT_COLS, outputCols=[f"{c}_idx" for c in CAT_COLS], handleInvalid="keep",
                        stringOrderType="frequencyDesc")
    ohe = OneHotEncoder(inputCols=[f"{c}_idx" for c in CAT_COLS], outputCols=[f"{c}_ohe" for c in CAT_COLS],
                        dropLast=True, handleInvalid="keep")
    asm = VectorAssembler(inputCols=[f"{c}_ohe" for c in CAT_COLS] + NUM_COLS, outputCol="features",
                          handleInvalid="keep")
    return [idx, ohe, asm]


def gbt_pipeline(max_iter: int = 200, max_depth: int = 5, step_size: float = 0.1, subsample: float = 0.8,
                 min_instances: int = 10, seed: int = 42, label: str = LABEL) -> Pipeline:
    """M02 + M05: one-hot categoricals (unseen -> all zeros), numerics as is
    (tree splits do not need scaling), gradient-boosted trees."""
    trees = GBTClassifier(labelCol=label, featuresCol="features", maxIter=max_iter, maxDepth=max_depth,
                          stepSize=step_size, subsamplingRate=subsample, minInstancesPerNode=min_instances,
                          seed=seed, checkpointInterval=10)
    return Pipeline(stages=[*encoding_stages(), trees])


def train_gbt(train: DataFrame, rows: int | None = None, **params) -> PipelineModel:
    """Fit on the training rows (driver coordinates, executors work). ``rows``
    is their number, if it is known."""
    pipeline = gbt_pipeline(**params)
    *encoders, trees = pipeline.getStages()
    n = train.count() if rows is None else rows
    if n <= MLLIB_ROWS or trees.getMaxDepth() > gbt.MAX_DEPTH:
        return pipeline.fit(train)
    return gbt.fit(train, n, Pipeline(stages=encoders).fit(train), trees)


def score(model: PipelineModel, df: DataFrame, out: str = "pred_sla_breach_prob") -> DataFrame:
    """P(breach) for every row; a narrow map, no shuffle. The trees get
    dense vectors: a split then finds its feature by place, not by search."""
    *encoders, trees = model.stages
    col = trees.getFeaturesCol()
    encoded = PipelineModel(encoders).transform(df)
    scored = trees.transform(encoded.withColumn(col, array_to_vector(vector_to_array(col))))
    keep = [c for c in df.columns if c != out]
    return scored.select(*keep, vector_to_array("probability")[1].alias(out))


def score_counts(df: DataFrame, score_col: str, label: str = LABEL, by: list[str] | None = None) -> DataFrame:
    """Positives and negatives per distinct score (and group): the map-side
    pre-aggregation every AUC starts from."""
    by = list(by or [])
    return (df.groupBy(*by, score_col)
            .agg(F.sum(F.col(label).cast("long")).alias("_pos"),
                 F.sum((1 - F.col(label)).cast("long")).alias("_neg")))


def score_cuts(per_score: DataFrame, score_col: str, buckets: int = AUC_BUCKETS) -> list[float]:
    """Bounds of score buckets: quantiles of the distinct scores."""
    cuts = per_score.approxQuantile(score_col, [i / buckets for i in range(1, buckets)], 0.25 / buckets)
    return [float("-inf"), *sorted(set(cuts)), float("inf")]


def auc_from_counts(per_score: DataFrame, score_col: str, by: list[str] | None = None,
                    buckets: int = AUC_BUCKETS, cuts: list[float] | None = None) -> DataFrame:
    """Exact AUC from ``score_counts`` output; null where one class is missing.
    ``per_score`` is read twice, so it should be stored; with ``cuts`` (any bounds
    give the same result) it is read once, in one exchange by group and bucket."""
    by = list(by or [])
    splits = score_cuts(per_score, score_col, buckets) if cuts is None else cuts
    per_score = Bucketizer(splits=splits, inputCol=score_col, outputCol="_b", handleInvalid="skip").transform(per_score)
    inside = Window.partitionBy(*by, "_b").orderBy(score_col).rowsBetween(Window.unboundedPreceding, -1)
    ranked = per_score.withColumn("_below", F.coalesce(F.sum("_neg").over(inside), F.lit(0)))
    # At most ``buckets`` rows per group: the only window not keyed by score bucket.
    per_bucket = ranked.groupBy(*by, "_b").agg(
        F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") * dbl(0.5))).alias("_bu"),
        F.sum("_pos").alias("_bp"), F.sum("_neg").alias("_bneg"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.withColumn("_off", F.coalesce(F.sum("_bneg").over(before), F.lit(0)))
    out = per_bucket.groupBy(*by).agg(
        F.sum(F.col("_bu") + F.col("_bp") * F.col("_off")).alias("_u"),
        F.sum("_bp").alias("_p"), F.sum("_bneg").alias("_n"))
    return out.select(*by, F.try_divide(F.col("_u"), F.col("_p") * F.col("_n")).alias("auc"))


def auc(df: DataFrame, score_col: str, label: str = LABEL, by: list[str] | None = None,
        buckets: int = AUC_BUCKETS) -> DataFrame:
    """Exact ROC AUC (ties count one half), per group of ``by``.

    Rows without a score are left out. Output: ``by`` + ``auc``.
    """
    ensure_checkpoint_dir(df.sparkSession)
    counts = score_counts(df, score_col, label, by).checkpoint()
    return auc_from_counts(counts, score_col, by, buckets)


def brier(df: DataFrame, score_col: str, label: str = LABEL) -> DataFrame:
    """Mean squared error of the probability."""
    e = F.col(score_col) - F.col(label)
    return df.agg(F.avg(e * e).alias("brier"))


def split_rates(split: DataFrame, label: str = LABEL) -> DataFrame:
    """Label mean in train and in test."""
    return split.groupBy("is_test").agg(F.count(F.lit(1)).alias("rows"), F.avg(label).alias("breach_rate"))


def risk_calibration(df: DataFrame, score_col: str, label: str = LABEL) -> DataFrame:
    """Breach rate where the score is above 0.7 and below 0.3 (0 if none)."""
    p = F.col(score_col)
    return df.agg(F.coalesce(F.avg(F.when(p > 0.7, F.col(label))), dbl(0.0)).alias("high_risk_breach_rate"),
                  F.coalesce(F.avg(F.when(p < 0.3, F.col(label))), dbl(0.0)).alias("low_risk_breach_rate"))


def _ranked(rows: DataFrame, salt: str) -> DataFrame:
    """Add ``_rank``: the place (from 1) of each row in the order of a salted
    md5 of its id. The leading hex digits give a bucket; a place is the rows of
    earlier buckets (at most 16**PERMUTATION_DIGITS sums) plus the place inside."""
    keyed = rows.withColumn("_h", hash_order(F.col("ticket_id"), salt))
    keyed = keyed.withColumn("_bk", F.substring("_h", 1, PERMUTATION_DIGITS))
    before = Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (keyed.groupBy("_bk").agg(F.count(F.lit(1)).alias("_n"))
               .select("_bk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off")))
    inside = F.row_number().over(Window.partitionBy("_bk").orderBy("_h", "ticket_id"))
    return keyed.join(offsets, "_bk").withColumn("_rank", F.col("_off") + inside).drop("_bk", "_h", "_off")


def _pairing(test: DataFrame, repeats: int, seed: int) -> DataFrame:
    """Random permutations of the whole test set, one a repeat: the row at
    some place of one hash order is paired with the row at the same place of
    another. The scheme is the same at every size; the first order is stored."""
    left = _ranked(test, f"left{seed}").checkpoint()
    out = None
    for r in range(repeats):
        right = _ranked(test, f"right{seed}-{r}").select("_rank", *[F.col(c).alias(f"_p_{c}") for c in FEATURES])
        part = left.join(right, "_rank").drop("_rank").withColumn("repeat", F.lit(r))
        out = part if out is None else out.unionByName(part)
    return out


def permutation_importance(model: PipelineModel | Callable[[DataFrame], DataFrame], test: DataFrame, repeats: int = 5,
                           seed: int = 42) -> DataFrame:
    """AUC drop when one feature's values are shuffled across test rows;
    mean and population std over ``repeats``. ``model`` is a fitted pipeline or a
    function that adds ``pred_sla_breach_prob``. All 16 x repeats variants are
    scored and evaluated in one pass: exploded rows, or for a fitted pipeline the
    leaf masks of its trees (``gbt``), then grouped AUC."""
    ensure_checkpoint_dir(test.sparkSession)
    p = "pred_sla_breach_prob"
    test = test.select("ticket_id", LABEL, *FEATURES)
    masks = None if callable(model) else gbt.masks(model)
    if masks and masks.layout.names != FEATURES:
        masks = None
    if masks:
        test = masks.coded(test).checkpoint()
    scorer = model if callable(model) else (lambda df: masks.score(df, p)) if masks else (lambda df: score(model, df, p))
    known = score_counts(scorer(test), p).checkpoint()
    cuts = score_cuts(known, p)
    base = auc_from_counts(known, p, cuts=cuts)
    pairs = _pairing(test, repeats, seed)
    if masks:
        scored = masks.score_variants(pairs, LABEL, p)
    else:
        variants = F.explode(F.array(*[F.lit(i) for i in range(len(FEATURES))])).alias("_variant")
        exploded = pairs.select("*", variants)
        scored = scorer(exploded.select("ticket_id", LABEL, "repeat", "_variant", *[
            F.when(F.col("_variant") == i, F.col(f"_p_{c}")).otherwise(F.col(c)).alias(c) for i, c in enumerate(FEATURES)]))
    # Scored variants are reduced to label counts per distinct score before the
    # shuffle. The base scores' cuts serve all variants, so the counts are
    # read once and not stored.
    counts = score_counts(scored, p, by=["_variant", "repeat"])
    per = auc_from_counts(counts, p, by=["_variant", "repeat"], cuts=cuts)
    name = F.element_at(F.array(*[F.lit(f) for f in FEATURES]), F.col("_variant") + 1)
    drops = per.select(name.alias("feature"), "repeat", (base.select("auc").scalar() - F.col("auc")).alias("drop"))
    return drops.groupBy("feature").agg(F.avg("drop").alias("importance_mean"),
                                        F.stddev_pop("drop").alias("importance_std"))


def top_features(importance: DataFrame, k: int = 10) -> DataFrame:
    """The k most important features (name breaks ties)."""
    return importance.orderBy(F.col("importance_mean").desc(), F.col("feature")).limit(k)
