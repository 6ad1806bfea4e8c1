"""Rare-event and delay models: preprocessing and linear models on Spark MLlib, boosted trees with a stop set, contributions.

Everything learned (medians, levels, rates, coefficients, trees) comes from an explicit fit frame.
"""

from __future__ import annotations

import itertools
import random
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from itertools import chain

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.operators.attach import attach_row, pair_rows
from skyledger.operators.baselines import apply_rate, rate_table
from skyledger.operators.boosting import Forest, block_rows, cut_points, grow, probabilities
from skyledger.operators.metrics import binary_metrics
from skyledger.operators.ordering import running_totals
from skyledger.operators.schema import MISSING_LEVEL, checked_predictors, enforce
from skyledger.session import stage, unstage


@dataclass(frozen=True)
class Features:
    """Columns of a model: numbers, low-cardinality categories, and many-level keys encoded by smoothed fit-row rates."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...]
    encoded: tuple[str, ...] = ()


@dataclass(frozen=True)
class TreeSettings:
    """Boosted-tree settings; the defaults are for real runs, queries pass smaller ones."""

    iterations: int = 100
    depth: int = 5
    step: float = 0.1
    min_rows: int = 100
    subsample: float = 1.0
    seed: int = 42
    tolerance: float = 0.001


@dataclass(frozen=True)
class FittedTrees:
    stages: list
    forest: Forest
    features: Features
    rates: dict[str, DataFrame] = field(default_factory=dict)
    overall: float = 0.0
    trees: int = 0
    medians: dict[str, float] = field(default_factory=dict)


def clean(df: DataFrame, features: Features) -> DataFrame:
    """Doubles for numbers, an explicit level for missing categories. Every fit passes here, so no outcome can be a predictor."""
    checked_predictors((*features.numeric, *features.categorical, *features.encoded))
    return df.withColumns({**{c: F.col(c).cast("double") for c in features.numeric},
                           **{c: F.coalesce(F.col(c).cast("string"), F.lit(MISSING_LEVEL)) for c in (*features.categorical, *features.encoded)}})


def preprocessor(features: Features) -> list:
    """Median fill, standardise, one-hot (an unseen level gets its own slot, dropped as the all-zero level)."""
    numeric, categorical = list(features.numeric), list(features.categorical)
    stages = [
        Imputer(strategy="median", inputCols=numeric, outputCols=[f"{c}__filled" for c in numeric]),
        VectorAssembler(inputCols=[f"{c}__filled" for c in numeric], outputCol="_numbers"),
        StandardScaler(inputCol="_numbers", outputCol="_scaled", withMean=True, withStd=True),
    ]
    if categorical:
        stages += [
            StringIndexer(inputCols=categorical, outputCols=[f"{c}__index" for c in categorical], handleInvalid="keep", stringOrderType="frequencyDesc"),
            OneHotEncoder(inputCols=[f"{c}__index" for c in categorical], outputCols=[f"{c}__hot" for c in categorical], dropLast=True, handleInvalid="keep"),
        ]
    return [*stages, VectorAssembler(inputCols=["_scaled", *[f"{c}__hot" for c in categorical]], outputCol="features")]


@dataclass(frozen=True)
class PreparedLinear:
    """Vectors and labels of fit rows, staged, and the stages that made them. Fits of the same rows share them."""

    rows: DataFrame
    stages: list


def prepare_linear(fit: DataFrame, features: Features, label: str) -> PreparedLinear:
    """Fit the preprocessing on the fit rows and write their vectors once, so that iterations read nothing else."""
    work = clean(fit, features).select(*features.numeric, *features.categorical, F.col(label).cast("double").alias("_label"))
    model = Pipeline(stages=preprocessor(features)).fit(work)
    return PreparedLinear(stage(model.transform(work).select("features", "_label"), rows_per_file=ROWS_PER_FILE), model.stages)


def fit_logistic(fit: DataFrame | PreparedLinear, features: Features, label: str, balanced: bool = False, inverse_penalty: float = 1.0, iterations: int = 150) -> PipelineModel:
    """L2 logistic regression; ``balanced`` weights each class by rows / (2 * class rows)."""
    rows = fit.rows if isinstance(fit, PreparedLinear) else fit.select(F.col(label).cast("double").alias("_label"))
    counts = rows.agg(F.count("*").alias("n"), F.sum("_label").alias("e")).first()
    n, events = counts["n"], counts["e"]
    if not events or events == n:
        raise ValueError("the fit rows contain only one class")
    prepared = fit if isinstance(fit, PreparedLinear) else prepare_linear(fit, features, label)
    weight = F.when(F.col("_label") == 1, n / (2.0 * events)).otherwise(n / (2.0 * (n - events))) if balanced else F.lit(1.0)
    model = LogisticRegression(featuresCol="features", labelCol="_label", weightCol="_weight", regParam=1.0 / (inverse_penalty * n), elasticNetParam=0.0,
                               standardization=False, maxIter=iterations, tol=1e-8)
    with _small_splits(prepared.rows):
        return PipelineModel([*prepared.stages, model.fit(prepared.rows.withColumn("_weight", weight))])


def fit_linear(fit: DataFrame | PreparedLinear, features: Features, target: str, penalty: float = 0.0, l1_share: float = 0.0, per_row_loss: bool = False) -> PipelineModel:
    """Least squares with an optional penalty. A ridge penalty is on the summed loss, so it is divided by the rows;
    ``per_row_loss`` marks a penalty already stated on the mean loss (elastic net)."""
    prepared = fit if isinstance(fit, PreparedLinear) else prepare_linear(fit, features, target)
    strength = penalty if per_row_loss else penalty / prepared.rows.count()
    model = LinearRegression(featuresCol="features", labelCol="_label", regParam=strength, elasticNetParam=l1_share, standardization=False, maxIter=200, tol=1e-8)
    with _small_splits(prepared.rows):
        return PipelineModel([*prepared.stages, model.fit(prepared.rows)])


def score_linear(model: PipelineModel, df: DataFrame, features: Features, out: str = "score") -> DataFrame:
    """Event probability of a classifier, or the prediction of a regression."""
    scored = model.transform(clean(df, features))
    value = vector_to_array("probability")[1] if "probability" in scored.columns else F.col("prediction")
    return scored.select(*df.columns, value.alias(out))


@dataclass(frozen=True)
class PreparedTrees:
    """Vectors, labels and stop marks, staged, and all that was learned from the fit rows to make them."""

    rows: DataFrame
    stages: list
    features: Features
    rates: dict[str, DataFrame]
    medians: dict[str, float]
    overall: float
    levels: int


def _tree_numbers(features: Features) -> list[str]:
    return [*features.numeric, *[f"{c}__rate" for c in features.encoded]]


def _encode(df: DataFrame, learned: PreparedTrees | FittedTrees) -> DataFrame:
    """Rates of many-level keys, and numbers with the median where they are missing."""
    out = clean(df, learned.features)
    for c in learned.features.encoded:
        out = apply_rate(out, learned.rates[c], c, f"{c}__rate", F.lit(learned.overall))
    return out.withColumns({f"{c}__filled": F.coalesce(F.nanvl(F.col(c), F.lit(None)), F.lit(learned.medians[c])) for c in _tree_numbers(learned.features)})


def lower_medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact median of each column, the lower one of two; null and NaN take no part. Only one row a column is collected."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in columns]))
    counts = df.select(pairs.alias("p")).select("p.*").where("value is not null and not isnan(value)").groupBy("name", "value").agg(F.count("*").alias("_n"))
    upto = running_totals(counts, ["name"], ["value"], {"_upto": "_n"})
    middle = F.ceil(F.col("_upto_total") / 2)
    found = {r["name"]: r["value"] for r in upto.where((F.col("_upto") - F.col("_n") < middle) & (middle <= F.col("_upto"))).select("name", "value").collect()}
    if len(found) < len(columns):
        raise ValueError(f"columns without a value: {sorted(set(columns) - set(found))}")
    return found


def _levels(df: DataFrame, columns: list[str]) -> list[list[str]]:
    """Levels of each column, most frequent first, ties by name: what an indexer holds on the driver."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("level")) for c in columns]))
    counts = df.select(pairs.alias("p")).groupBy("p.name", "p.level").agg(F.count("*").alias("n")).collect()  # one row per level
    return [[r["level"] for r in sorted((r for r in counts if r["name"] == c), key=lambda r: (-r["n"], r["level"]))] for c in columns]


def prepare_trees(fit: DataFrame, stop: DataFrame, features: Features, label: str) -> PreparedTrees:
    """Learn rates, medians and levels from the fit rows and write the vectors of fit and stop rows once.

    Category levels come from the fit rows; unseen ones share the extra level. Many-level keys enter as smoothed event
    rates of the fit rows. Everything learned is exact and the rate tables are small staged tables that leave the rows
    where they are, so the same rows give the same vectors in the same order.
    """
    seen = fit.agg(F.avg(label).alias("p"), F.count("*").alias("n")).first()
    if not 0 < (seen["p"] or 0) < 1:
        raise ValueError("the fit rows contain only one class")
    overall = float(seen["p"])
    cleaned = clean(fit, features)
    rates = {c: stage(rate_table(cleaned, c, label).select(c, "rate")) for c in features.encoded}
    numeric, categorical = _tree_numbers(features), list(features.categorical)
    rated = cleaned
    for c in features.encoded:
        rated = apply_rate(rated, rates[c], c, f"{c}__rate", F.lit(overall))
    medians = lower_medians(rated, numeric)
    stages, levels = [], 0
    if categorical:
        labels = _levels(cleaned, categorical)
        levels = max(map(len, labels))
        stages += [StringIndexerModel.from_labels(found, inputCol=c, outputCol=f"{c}__index", handleInvalid="keep") for c, found in zip(categorical, labels)]
    stages.append(VectorAssembler(inputCols=[*[f"{c}__filled" for c in numeric], *[f"{c}__index" for c in categorical]], outputCol="features"))
    learned = PreparedTrees(fit, stages, features, rates, medians, overall, levels)
    needed = [*features.numeric, *features.categorical, *features.encoded]
    marked = fit.select(*needed, F.col(label).cast("double").alias("_label"), F.lit(False).alias("_stop")).unionByName(
        stop.select(*needed, F.col(label).cast("double").alias("_label"), F.lit(True).alias("_stop")))
    return replace(learned, rows=stage(PipelineModel(stages).transform(_encode(marked, learned)).select("features", "_label", "_stop"), rows_per_file=ROWS_PER_FILE))


#: Rows of a staged vector file and bytes of a reading task: a fit holds its partitions in memory, so they stay small.
ROWS_PER_FILE, SPLIT_BYTES = 500_000, "16m"


@contextmanager
def _small_splits(df: DataFrame):
    """Read staged vectors in small partitions while a fit runs."""
    conf, name = df.sparkSession.conf, "spark.sql.files.maxPartitionBytes"
    before = conf.get(name)
    conf.set(name, SPLIT_BYTES)
    try:
        yield
    finally:
        conf.set(name, before)


def fit_sets(sets: list[tuple[PreparedTrees, list[TreeSettings]]]) -> list[list[FittedTrees]]:
    """Boosted trees for each preparation and its settings, with early stopping on the stop rows, which never choose a split.

    All fits share the passes, and those of one preparation and seed the binned rows.
    """
    binned, places = [], []
    with _small_splits(sets[0][0].rows):
        for i, (prepared, settings) in enumerate(sets):
            numeric = len(_tree_numbers(prepared.features))
            categories = [len(s.labels) + 1 for s in prepared.stages if isinstance(s, StringIndexerModel)]
            for seed in dict.fromkeys(s.seed for s in settings):
                cuts = cut_points(prepared.rows.where(~F.col("_stop")), numeric, categories, max(32, prepared.levels + 2), seed)
                alike = [k for k, s in enumerate(settings) if s.seed == seed]
                binned.append((block_rows(prepared.rows, cuts), cuts, [settings[k] for k in alike]))
                places.append([(i, k) for k in alike])
        grown = grow(binned)
    for blocks, _, _ in binned:
        unstage(blocks)
    forests = {place: forest for at, found in zip(places, grown) for place, forest in zip(at, found)}
    return [[FittedTrees(p.stages, f, p.features, p.rates, p.overall, len(f.trees), p.medians) for f in (forests[i, k] for k in range(len(settings)))]
            for i, (p, settings) in enumerate(sets)]


def fit_settings(prepared: PreparedTrees, settings: list[TreeSettings]) -> list[FittedTrees]:
    """Boosted trees for each of the settings, of the same rows."""
    return fit_sets([(prepared, settings)])[0]


def fit_prepared(prepared: PreparedTrees, settings: TreeSettings = TreeSettings()) -> FittedTrees:
    """Boosted trees of one of the settings."""
    return fit_settings(prepared, [settings])[0]


def fit_trees(fit: DataFrame, stop: DataFrame, features: Features, label: str, settings: TreeSettings = TreeSettings()) -> FittedTrees:
    """Boosted trees of the fit rows, prepared for this fit alone."""
    return fit_prepared(prepare_trees(fit, stop, features, label), settings)


def score_trees(fitted: FittedTrees, df: DataFrame, out: str = "score") -> DataFrame:
    scored = PipelineModel(fitted.stages).transform(_encode(df, fitted))
    return scored.select(*df.columns, _probabilities([fitted])[0].alias(out))


def _probabilities(fitted: list[FittedTrees]) -> Column:
    return probabilities([f.forest for f in fitted], vector_to_array("features"), len(fitted[0].forest.cuts.widths))


def tree_vectors(prepared: PreparedTrees, df: DataFrame, *keep) -> DataFrame:
    """``keep`` and the vectors of rows that several fits of the same preparation score."""
    encoded = _encode(df.select("*", *[k.alias(f"_keep_{i}") for i, k in enumerate(F.col(k) if isinstance(k, str) else k for k in keep)]), prepared)
    names = df.select(*keep).columns
    return PipelineModel(prepared.stages).transform(encoded).select(*[F.col(f"_keep_{i}").alias(n) for i, n in enumerate(names)], "features")


def score_vectors(fitted: FittedTrees, vectors: DataFrame, out: str = "score") -> DataFrame:
    return vectors.select(*[c for c in vectors.columns if c != "features"], _probabilities([fitted])[0].alias(out))


def melt_vectors(fitted: dict, vectors: DataFrame, name: str, out: str = "score") -> DataFrame:
    """A row for each fit and vector, named by the fit's key. The fits are of one preparation; the vectors are read once."""
    pairs = F.explode(F.arrays_zip(F.array(*[F.lit(k) for k in fitted]).alias("k"), _probabilities([*fitted.values()]).alias("v")))
    kept = [c for c in vectors.columns if c != "features"]
    return vectors.select(*kept, pairs.alias("_f")).select(*kept, F.col("_f.k").alias(name), F.col("_f.v").alias(out))


def sample_settings(base: TreeSettings, space: dict[str, list], draws: int, seed: int) -> list[TreeSettings]:
    """The base settings, then distinct other cells of the grid that the space spans, in a seeded order."""
    cells = [replace(base, **dict(zip(space, values))) for values in itertools.product(*space.values())]
    others = [c for c in dict.fromkeys(cells) if c != base]
    if draws > len(others):
        raise ValueError("more draws than settings")
    return [base, *(others[i] for i in random.Random(seed).sample(range(len(others)), draws))]


def reproduction(stored: DataFrame, refit: DataFrame, identity: str = "flight_id") -> DataFrame:
    """One row: how far the scores of a refit are from stored scores of the same rows, and the difference of their average precision."""
    a, b = stored.select(identity, F.col("score").alias("_a")), refit.select(identity, F.col("score").alias("_b"))
    joined = a.join(b, identity, "full_outer")
    gap = F.abs(F.col("_a") - F.col("_b"))
    scores = joined.agg(F.count("*").alias("rows"), F.sum((F.col("_a").isNull() | F.col("_b").isNull()).cast("long")).alias("unmatched"),
                        F.max(gap).alias("largest_difference"), F.avg(gap).alias("mean_difference"))
    both = stored.select("score", "label", F.lit("stored").alias("of")).unionByName(refit.select("score", "label", F.lit("refit").alias("of")))
    area = binary_metrics(both, ["of"]).agg(F.abs(F.max(F.when(F.col("of") == "stored", F.col("pr_auc"))) - F.max(F.when(F.col("of") == "refit", F.col("pr_auc")))).alias("pr_auc_difference"))
    return attach_row(scores, area)


def require_reproduction(report: DataFrame, tolerance: float) -> DataFrame:
    """The report, unless rows are missing or the average precision is off by more than the tolerance."""
    return enforce(report, {"the same rows": F.col("unmatched") == 0, "the stored average precision": F.col("pr_auc_difference") <= tolerance})


# Families of features for contribution summaries.
FAMILIES = {"carrier_id": "carrier", "origin": "airport", "destination": "airport", "route": "route", "distance": "distance and duration", "sched_elapsed": "distance and duration"}


def family_of(feature: str) -> str:
    return FAMILIES.get(feature, "history" if feature.startswith("prior_") else "calendar and clock")


def linear_contributions(model: PipelineModel, df: DataFrame, fit: DataFrame, features: Features) -> DataFrame:
    """Exact contribution of every feature to the log-odds of a logistic model: coefficient times distance from the fit mean.

    Adds ``c_<feature>``, ``expected`` (the log-odds at the fit mean) and ``raw`` (the model's own log-odds). Level
    coefficients travel as a literal map per category, as large as the vocabulary of a one-hot feature.
    """
    scaler = next(s for s in model.stages if s.__class__.__name__ == "StandardScalerModel")
    imputer = next(s for s in model.stages if s.__class__.__name__ == "ImputerModel")
    regression = model.stages[-1]
    weights, position = regression.coefficients.toArray(), len(features.numeric)
    medians = imputer.surrogateDF.first().asDict()
    out = clean(df, features)
    contributions = {}
    for i, c in enumerate(features.numeric):
        spread = float(scaler.std[i]) or 1.0
        filled = F.coalesce(F.col(c), F.lit(float(medians[c])))
        contributions[c] = (filled - F.lit(float(scaler.mean[i]))) / F.lit(spread) * F.lit(float(weights[i]))
    expected = float(regression.intercept)
    indexer = next((s for s in model.stages if s.__class__.__name__ == "StringIndexerModel"), None)
    base = clean(fit, features)
    sizes = base.count()
    for c, labels in zip(features.categorical, indexer.labelsArray if indexer else []):
        level_weights = dict(zip(labels, (float(w) for w in weights[position:position + len(labels)])))
        position += len(labels) + 1
        shares = {r[c]: r["n"] / sizes for r in base.groupBy(c).agg(F.count("*").alias("n")).where(F.col(c).isin(list(labels))).collect()}  # one row per level
        mean = sum(level_weights[k] * v for k, v in shares.items())
        lookup = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in level_weights.items()))
        contributions[c] = F.coalesce(lookup[F.col(c)], F.lit(0.0)) - F.lit(mean)
        expected += mean
    named = [*[v.alias(f"c_{n}") for n, v in contributions.items()], F.lit(expected).alias("expected")]
    scored = model.transform(out).select(*df.columns, *named, vector_to_array("rawPrediction")[1].alias("raw"))
    return pair_rows(scored, scored, [*[c for c in scored.columns if c not in ("flight_id", "raw")]], ["raw"])


def additivity_gap(contributions: DataFrame, features: Features) -> DataFrame:
    """One row: the largest gap between the summed contributions and the model's log-odds."""
    total = F.col("expected")
    for c in (*features.numeric, *features.categorical):
        total = total + F.col(f"c_{c}")
    return contributions.agg(F.count("*").alias("rows"), F.max(F.abs(total - F.col("raw"))).alias("largest_gap"))


def long_contributions(contributions: DataFrame, features: Features) -> DataFrame:
    """Rows ``(flight_id, feature, family, value, level, contribution)``."""
    nothing_number, nothing_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    rows = [F.struct(F.lit(c).alias("feature"), F.lit(family_of(c)).alias("family"), F.col(c).cast("double").alias("value"), nothing_text.alias("level"), F.col(f"c_{c}").alias("contribution"))
            for c in features.numeric]
    rows += [F.struct(F.lit(c).alias("feature"), F.lit(family_of(c)).alias("family"), nothing_number.alias("value"), F.col(c).alias("level"), F.col(f"c_{c}").alias("contribution"))
             for c in features.categorical]
    return contributions.select("flight_id", F.explode(F.array(*rows)).alias("r")).select("flight_id", "r.*")


def group_ablation(fit: DataFrame, stop: DataFrame, evaluate: DataFrame, features: Features, groups: dict[str, tuple[str, ...]], label: str, settings: TreeSettings) -> DataFrame:
    """What a group of features is worth to a tree model: average precision without it, next to the full model."""
    from skyledger.operators.metrics import binary_metrics

    named = {"full": (), **groups}
    kept = [Features(*(tuple(c for c in part if c not in dropped) for part in (features.numeric, features.categorical, features.encoded))) for dropped in named.values()]
    fitted = fit_sets([(prepare_trees(fit, stop, k, label), [settings]) for k in kept])
    out = None
    for name, (trees,) in zip(named, fitted):
        scores = score_trees(trees, evaluate).withColumn("label", F.col(label))
        row = binary_metrics(scores.withColumn("dropped", F.lit(name)), ["dropped"])
        out = row if out is None else out.unionByName(row)
    full = out.where(F.col("dropped") == "full").select(F.col("pr_auc").alias("_full"))
    return attach_row(out, full).withColumn("loss_without", F.col("_full") - F.col("pr_auc")).drop("_full")
