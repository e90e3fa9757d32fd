"""Predictions against ground truth: joins, resume, upsert, scores, block rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.spans import score_spans
from .ratios import score_by_ratio
from .sampling import cell


def attack_allowed(pii: list[str] | None = None, context: list[str] | None = None) -> Column:
    """A row without attack is kept; else no named attack may be outside the lists."""
    lit = lambda xs: F.array(*map(F.lit, xs))
    none = F.array().cast("array<string>")
    outside = F.size(F.array_except(F.coalesce("attack_target.pii", none), lit(L.ALLOWED_PII if pii is None else pii))) + F.size(F.array_except(F.coalesce("attack_target.context", none), lit(L.ALLOWED_CONTEXT if context is None else context)))
    return F.col("attack_target").isNull() | (outside == 0)


def evaluate(predictions: DataFrame, dataset: DataFrame, models: list[str] | None = None, level: str = "both", method: str = "subsequence", threshold: float = 0.8) -> DataFrame:
    """uid, model, prediction, spans_score. A prediction without dataset row scores against no spans, but not as null."""
    if models is not None:
        predictions = predictions.where(F.col("model").isin(models))
    truth = dataset.select("uid", "pii_spans", "category", "attack_target", F.lit(True).alias("__matched"))
    both = predictions.join(truth, "uid", "left").where(attack_allowed())
    if method in ("difflib", "rapidfuzz"):
        both = score_by_ratio(both, "pii_spans", "prediction", "__score", level, method, threshold)
    else:
        both = both.withColumn("__score", score_spans(F.col("pii_spans"), F.col("prediction"), level, method))
    score = F.col("__score")
    zero = F.struct(F.lit(True).alias("exact_match"), *[F.lit(0).alias(n) for n in ("true_positive", "false_positive", "false_negative")], *[F.lit(0.0).alias(n) for n in ("precision", "recall", "f1")])
    return both.select("uid", "model", "prediction", F.when(F.col("__matched").isNull() & score.isNull(), zero).otherwise(score).alias("spans_score"), "category", "attack_target")


def remaining(dataset: DataFrame, predictions: DataFrame, model: str) -> DataFrame:
    """Rows that the model has not predicted."""
    return dataset.join(predictions.where(F.col("model") == model).select("uid"), "uid", "left_anti")


def upsert_by_model(existing: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of the models in `new` are replaced."""
    return existing.join(new.select("model").distinct(), "model", "left_anti").unionByName(new)


def completeness_gap(dataset: DataFrame, predictions: DataFrame, reference: str = "presidio") -> DataFrame:
    """model, n_missing: uids of the reference model (of the dataset if it has none) that a model lacks."""
    own = predictions.select("uid", "model").distinct()
    has = own.where(F.col("model") == reference).select("uid")
    wanted = has.union(dataset.select("uid").distinct().where(has.agg(F.count("*")).scalar() == 0))
    have = own.join(wanted, "uid", "left_semi").groupBy("model").agg(F.count("*").alias("n"))
    total = wanted.agg(F.count("*")).scalar()
    return predictions.select("model").distinct().join(have, "model", "left").select("model", (total - F.coalesce("n", F.lit(0))).alias("n_missing"))


def block_rates(predictions: DataFrame, dataset: DataFrame) -> DataFrame:
    """model, attack, n, blocked: a row is blocked if anything was predicted."""
    rows = predictions.join(dataset.select("uid", "attack_target", "category"), "uid").where("category = 'positive'")
    blocked = F.coalesce(F.size("prediction"), F.lit(0)) > 0
    return rows.groupBy("model", cell().alias("attack")).agg(F.count("*").alias("n"), F.sum(blocked.cast("long")).alias("blocked"), F.round(F.avg(blocked.cast("double")), 6).alias("rate"))


def worst(rates: DataFrame, n: int = 5) -> DataFrame:
    """The n attacks with the lowest block rate of each model."""
    rank = F.row_number().over(Window.partitionBy("model").orderBy("rate", "attack"))
    return rates.withColumn("rank", rank).where(F.col("rank") <= n)
