"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Targets: sources in code-point order (null last) carry the weights in turn and share `budget` times all words; a target
stops at `most` times its source's words and the excess is shared again by weight (water filling, in closed form).
Sampling: a source with target/size = k + p gives k certain whole copies of each document. The rest, p of its words, is a
fixed-size sample without replacement with unequal odds: a document is included with probability pi = min(1, c w), w the power of two
at or below its size, and c such that the expected words are those due; where pi reaches 1 the further copy is certain as well. Pareto order:
ratio = (u / (1 - u)) / (pi / (1 - pi)), with u from a hash of the identifier, so reruns agree; documents are taken from the lowest
ratio up to the cut whose words come nearest to what is due. One further unsampled document is taken where its size brings the sum
nearer still. Ranks are kept as ratio / (1 + ratio), which has the same order and lies below 1.

A source may hold most rows: words are summed per (source, size class) and (source, rank bucket) map-side, and only the one bucket that
straddles the cut is sorted. Source-level tables have one row a source; they are never collected.

Defined cases: null or empty text has size 0 and is taken 0 words; a null source is a source, ordered last; rows that share a
doc_id share u, and go in or out together within their source and size class, as do null ids; target of a source without words is 0;
extra columns are ignored by `plan` and kept by `mix`; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, documents, stash

BUCKETS = 4096  # of ranks; only one of them is sorted for each source


def _draw(id_col: str) -> Column:
    """An integer below 2**48 from the identifier's md5; the same in any engine."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), 1, 12), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, s (words), n -> the same with target. One row a source."""
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.col("nth") - 1) % len(weights) + 1).cast("int"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cap = sizes.withColumn("nth", F.row_number().over(order)).withColumn("w", w).withColumn("cap", F.lit(most) * F.col("s"))
    every, level = Window.partitionBy(), Window.orderBy(F.col("cap") / F.col("w"), "nth").rowsBetween(Window.unboundedPreceding, -1)
    cap = cap.withColumns({"all_s": F.sum("s").over(every), "all_w": F.sum("w").over(every), "cap_below": F.coalesce(F.sum("cap").over(level), F.lit(0.0)), "w_below": F.coalesce(F.sum("w").over(level), F.lit(0))})
    # With those below stopped at their caps, the others would get `share` a unit of weight; the first that this suits fixes the level.
    share = (F.lit(budget) * F.col("all_s") - F.col("cap_below")) / (F.col("all_w") - F.col("w_below"))
    cap = cap.withColumn("share", share)
    fixed = F.min_by(F.when(F.col("share") * F.col("w") <= F.col("cap"), F.col("share")), F.when(F.col("share") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), "nth"))).over(every)
    return cap.select("source", "s", F.coalesce(F.least(fixed * F.col("w"), "cap"), "cap").alias("target"))


def _key(source: str) -> Column:
    """A text that is never null, so that joins by source stay equi-joins."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("null"))


def _class(size: Column) -> Column:
    """Size class: the exponent of the power of two at or below the size (0 for 0)."""
    return F.length(F.bin(size)) - 1


def _weight(size: Column, by_size: bool) -> Column:
    return F.pow(F.lit(2.0), _class(size)) if by_size else F.lit(1.0)


def _rank(x: Column, w: Column, c: Column) -> Column:
    """Pareto rank, 0 for a certain document, null where nothing is due; u lies in the middle of its 2**-48 cell, so it is never 0 or 1."""
    u = (x + F.lit(0.5)) / F.lit(2.0**48)
    odds = (c * w) / (F.lit(1.0) - c * w)
    ratio = (u / (F.lit(1.0) - u)) / odds
    return F.when(c * w >= 1, F.lit(0.0)).when(c > 0, ratio / (F.lit(1.0) + ratio))


def _copies(x: Column, rank: Column) -> Column:
    """Whole copies of a document by its draw, its rank and the columns of its source's row."""
    drawn = F.coalesce(rank <= F.col("cut"), F.lit(False)) | F.coalesce(x == F.col("fill"), F.lit(False))
    return F.col("k") + drawn.cast("long")


def _size(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", by_size: bool = True, **share) -> tuple[DataFrame, DataFrame]:
    """(id, source, size, x, key) of every document, and for every source its target and the cut that its documents obey.

    A document's copies follow from its own draw and size and its source's row. The second table has one row a source and is stored,
    so Spark knows its size and broadcasts it where it is small. by_size=False gives all documents of a source equal odds.
    """
    rows = stash(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), _size(text_col).alias("size"), _draw(id_col).alias("x"), _key(source_col).alias("key")), "sizes")
    weight = _weight(F.col("size"), by_size)

    # At most some 60 size classes a source.
    classes = stash(rows.groupBy("source", "key", weight.alias("w")).agg(F.sum("size").alias("words")), "classes")
    aims = targets(classes.groupBy("source").agg(F.sum("words").alias("s")), **share)
    ratio = F.when(F.col("s") > 0, F.col("target") / F.col("s")).otherwise(F.lit(0.0))
    aims = aims.withColumn("k", F.floor(ratio).cast("long")).withColumn("due", F.col("target") - F.col("k") * F.col("s")).withColumn("key", _key("source"))
    aims = stash(aims, "aims")

    # c: with the classes above certain, the others share what is left by size; the first class that this suits fixes it.
    larger = Window.partitionBy("key").orderBy(F.desc("w"))
    at = classes.where("words > 0").join(aims.select("key", "due"), "key")
    above = F.coalesce(F.sum("words").over(larger.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("w") * F.col("words")).over(larger.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    at = at.withColumn("c", (F.col("due") - above) / rest).where("c * w <= 1")
    odds = at.groupBy("key").agg(F.max_by("c", "w").alias("c"))
    aims = stash(aims.join(odds, "key", "left").withColumn("c", F.greatest(F.coalesce("c", F.lit(0.0)), F.lit(0.0))), "odds")

    ranked = rows.join(aims.select("key", "c", "due"), "key").withColumn("rank", _rank(F.col("x"), weight, F.col("c"))).where("rank is not null")
    ranked = ranked.withColumn("bucket", F.floor(F.col("rank") * BUCKETS).cast("int"))
    sums = stash(ranked.groupBy("key", "bucket").agg(F.sum("size").alias("words"), F.max("rank").alias("top"), F.first("due").alias("due")), "sums")
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = sums.withColumn("base", F.coalesce(F.sum("words").over(before), F.lit(0))).withColumn("below", F.coalesce(F.max("top").over(before), F.lit(-1.0)))
    edge = edge.where("due > base AND due <= base + words").select("key", "bucket", "base", "below")

    close = ranked.join(edge, ["key", "bucket"])
    upto = Window.partitionBy("key").orderBy("rank").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    cum = close.withColumn("cum", F.col("base") + F.sum("size").over(upto))
    # The last rank of the nearest cut; before the bucket's first row is a cut as well.
    cuts = cum.groupBy("key").agg(F.min(F.struct(F.abs(F.col("cum") - F.col("due")).alias("off"), "cum", "rank")).alias("best"), F.first("below").alias("below"), F.first("base").alias("base"), F.first("due").alias("due"))
    none = F.abs(F.col("base") - F.col("due")) <= F.col("best.off")
    cuts = cuts.select("key", F.when(none, F.col("below")).otherwise(F.col("best.rank")).alias("cut"), F.when(none, F.col("base")).otherwise(F.col("best.cum")).alias("got"))
    aims = stash(aims.join(cuts, "key", "left").withColumn("cut", F.coalesce("cut", F.lit(-1.0))).withColumn("gap", F.col("due") - F.coalesce("got", F.lit(0))), "cuts")

    # One document that was not drawn may fill the gap.
    spare = rows.join(aims.where("gap > 0").select("key", "c", "cut", "gap"), "key").where((_rank(F.col("x"), weight, F.col("c")) > F.col("cut")) & F.expr("size > 0 AND size < 2 * gap"))
    fill = spare.groupBy("key", "gap", "x").agg(F.sum("size").alias("size")).groupBy("key").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")), "x"))["x"].alias("fill"), F.first("gap").alias("g"), F.min(F.abs(F.col("size") - F.col("gap"))).alias("off"))
    aims = aims.join(fill.where("off < g").select("key", "fill"), "key", "left")
    return rows, stash(aims.select("key", F.col("s").alias("source_size"), "target", "k", "c", "cut", "fill"), "decided")


def plan(docs: DataFrame, id_col: str = "doc_id", by_size: bool = True, **how) -> DataFrame:
    """One row per document: id, source, size, source_size, target, copies (whole copies), taken (words)."""
    rows, aims = decide(docs, id_col, by_size=by_size, **how)
    copies = _copies(F.col("x"), _rank(F.col("x"), _weight(F.col("size"), by_size), F.col("c")))
    return rows.join(aims, "key").select(F.col("id").alias(id_col), "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", by_size: bool = True, **how) -> DataFrame:
    """The mixed documents, all columns of docs: a document with two copies comes twice, one with none not at all.

    The draw comes from the row's own identifier and size and the cut from its source's row, so texts are joined by source alone and
    not moved while that table is small enough to broadcast.
    """
    aims = decide(docs, id_col, text_col, source_col, by_size, **how)[1]
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), _draw(id_col).alias("x"), _weight(_size(text_col), by_size).alias("w"), _key(source_col).alias("key"))
    both = rows.join(aims, "key").withColumn("copies", _copies(F.col("x"), _rank(F.col("x"), F.col("w"), F.col("c")))).where("copies > 0")
    # No document is taken more than twice under the default cap; sequence() holds for any.
    return both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op2_source_mixing(spark, sf_dir: str) -> DataFrame:
    return plan(documents(spark, sf_dir)).drop("source", "copies")


SQL = """
WITH d AS (
  SELECT doc_id, coalesce('s' || source, 'null') AS key, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
    CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12)) AS BIGINT) AS x
  FROM documents
), s AS (
  SELECT source, key, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS nth FROM d GROUP BY source, key
), w AS (
  SELECT *, [5, 2, 1][CAST((nth - 1) % 3 + 1 AS INTEGER)] AS w, 2.0::DOUBLE * s AS cap FROM s
), v AS (
  SELECT *, 1.5::DOUBLE * sum(s) OVER () AS total, sum(w) OVER () AS all_w,
    coalesce(sum(cap) OVER l, 0::DOUBLE) AS cap_below, coalesce(sum(w) OVER l, 0) AS w_below
  FROM w WINDOW l AS (ORDER BY cap / w, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), sh AS (
  SELECT *, CAST(total - cap_below AS DOUBLE) / CAST(all_w - w_below AS DOUBLE) AS share FROM v
), lv AS (SELECT min_by(share, (cap / w, nth)) AS level FROM sh WHERE share * w <= cap
), a AS (
  SELECT key, s, coalesce(least(level * w, cap), cap) AS target FROM sh, lv
), r AS (
  SELECT *, CAST(floor(CASE WHEN s > 0 THEN target / s ELSE 0 END) AS BIGINT) AS k FROM a
), aims0 AS (
  SELECT *, target - k * s AS due FROM r
), e AS (
  SELECT *, 2.0::DOUBLE ** (length(bin(size)) - 1) AS w FROM d
), cl AS (
  SELECT e.key, w, any_value(due) AS due, CAST(sum(size) AS BIGINT) AS words FROM e JOIN aims0 USING (key) WHERE size > 0 GROUP BY e.key, w
), lc AS (
  SELECT key, w, (due - coalesce(sum(words) OVER (PARTITION BY key ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(w * words) OVER (PARTITION BY key ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c FROM cl
), od AS (
  SELECT key, max_by(c, w) AS c FROM lc WHERE c * w <= 1 GROUP BY key
), aims AS (
  SELECT aims0.*, greatest(coalesce(c, 0::DOUBLE), 0::DOUBLE) AS c FROM aims0 LEFT JOIN od USING (key)
), q AS (
  SELECT e.*, s, target, k, due, c, (x + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u, c * w AS pi FROM e JOIN aims USING (key)
), o AS (
  SELECT *, CASE WHEN pi >= 1 OR pi <= 0 THEN NULL ELSE (u / (1.0::DOUBLE - u)) / (pi / (1.0::DOUBLE - pi)) END AS ratio FROM q
), k AS (
  SELECT *, CASE WHEN pi >= 1 THEN 0::DOUBLE WHEN c > 0 THEN ratio / (1.0::DOUBLE + ratio) END AS rank FROM o
), cm AS (
  SELECT key, rank, due, sum(size) OVER (PARTITION BY key ORDER BY rank) AS cum FROM k WHERE rank IS NOT NULL
), cut AS (
  SELECT key, arg_min(rank, (off, cum, rank)) AS cut, arg_min(cum, (off, cum, rank)) AS got FROM (
    SELECT key, -1::DOUBLE AS rank, 0 AS cum, due AS off FROM aims
    UNION ALL SELECT key, rank, cum, abs(cum - due) AS off FROM cm) GROUP BY key
), gap AS (
  SELECT key, cut, due - got AS gap FROM aims JOIN cut USING (key)
), f AS (
  SELECT key, gap, x, sum(size) AS size FROM k JOIN gap USING (key) WHERE gap > 0 AND rank > cut AND size > 0 AND size < 2 * gap GROUP BY ALL
), fill AS (
  SELECT key, arg_min(x, (abs(size - gap), x)) AS fill FROM f GROUP BY key HAVING min(abs(size - gap)) < min(gap)
)
SELECT doc_id, size, k.s AS source_size, target,
  CAST((k.k + CASE WHEN coalesce(rank <= cut, false) OR coalesce(x = fill, false) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM k JOIN gap USING (key) LEFT JOIN fill USING (key)
"""
