"""Detection buckets and reproducible quota samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L


def bucket() -> Column:
    """Bucket of a dataset row; null for a row of another category."""
    pii, context = F.coalesce(F.size("attack_target.pii"), F.lit(0)), F.coalesce(F.size("attack_target.context"), F.lit(0))
    return (
        F.when(F.col("category") == "negative", F.lit("negatives"))
        .when(F.col("category") == "hard_negative", F.lit("hard_negatives"))
        .when(F.col("category") != "positive", F.lit(None).cast("string"))
        .when((pii == 0) & (context == 0), F.lit("positives"))
        .when(context == 0, F.lit("adv_positives_direct"))
        .otherwise(F.lit("adv_positives_direct_indirect"))
    )


def cell() -> Column:
    """The attack configuration as one text."""
    part = lambda c: F.array_join(F.coalesce(F.col(c), F.array().cast("array<string>")), "+")
    return F.concat_ws("/", part("attack_target.pii"), part("attack_target.context"))


def order_key(seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.col("uid").cast("string"), F.lit(str(seed))))


def bucket_counts(dataset: DataFrame) -> DataFrame:
    return dataset.select(bucket().alias("bucket")).where("bucket is not null").groupBy("bucket").agg(F.count("*").alias("n"))


def quota_sample(dataset: DataFrame, quotas: dict[str, int | None], seed: int = 42, stratified: tuple[str, ...] = ("adv_positives_direct", "adv_positives_direct_indirect")) -> DataFrame:
    """At most a quota of rows a bucket, by a hash of uid and seed; None keeps all, 0 or less none.

    Stratified buckets give each attack cell max(1, quota / cells) rows and fill what is left by the same hash; with
    more cells than the quota each still gets its one. A bucket without a quota is an error.
    """
    missing = [b for b in L.QUOTAS if b not in quotas]
    if missing:
        raise KeyError(missing[0])
    capped = {b: q for b, q in quotas.items() if q is not None and q > 0}
    rows = dataset.withColumn("__b", bucket())
    whole = rows.where(F.col("__b").isin([b for b, q in quotas.items() if q is None])).drop("__b")
    if not capped:
        return whole
    quota = F.element_at(F.create_map(*[F.lit(x) for kv in capped.items() for x in kv]), F.col("__b"))
    rows = rows.where(F.col("__b").isin(list(capped))).withColumns({"__c": F.when(F.col("__b").isin(list(stratified)), cell()).otherwise(F.lit("")), "__k": order_key(seed), "__q": quota})

    # One row a cell: what each gives, and what its bucket still lacks then.
    bucket_of = Window.partitionBy("__b")
    cells = rows.groupBy("__b", "__c", "__q").agg(F.count("*").alias("__n"))
    cells = cells.withColumn("__per", F.greatest(F.lit(1), F.floor(F.col("__q") / F.count("*").over(bucket_of))))
    cells = cells.withColumn("__left", F.col("__q") - F.sum(F.least("__n", "__per")).over(bucket_of)).select("__b", "__c", "__per", "__left")

    # No cell gives more than the largest quota: tasks keep so many rows of each before the shuffle.
    rank = F.row_number().over(Window.partitionBy("__b", "__c").orderBy("__k", "uid"))
    ranked = rows.withColumn("__r", rank).where(F.col("__r") <= max(capped.values())).join(cells, ["__b", "__c"]).withColumn("__first", F.col("__r") <= F.col("__per"))
    spare = F.row_number().over(Window.partitionBy("__b", "__first").orderBy("__k", "uid"))
    picked = ranked.withColumn("__s", spare).where(F.col("__first") | (F.col("__s") <= F.col("__left")))
    return whole.unionByName(picked.select(*dataset.columns))


def sample_report(dataset: DataFrame, quotas: dict[str, int | None], **how) -> DataFrame:
    """bucket, pool, cap (null: none), sampled."""
    pools = bucket_counts(dataset).withColumnRenamed("n", "pool")
    taken = bucket_counts(quota_sample(dataset, quotas, **how)).withColumnRenamed("n", "sampled")
    caps = F.create_map(*[x for b, q in quotas.items() for x in (F.lit(b), F.lit(q).cast("long"))])
    return pools.join(taken, "bucket", "left").select("bucket", "pool", F.try_element_at(caps, F.col("bucket")).alias("cap"), F.coalesce("sampled", F.lit(0)).alias("sampled"))
