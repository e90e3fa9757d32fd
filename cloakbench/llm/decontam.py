"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Canonical tokens: words without surrounding punctuation, lower-cased; a word with a digit becomes <num>, a unit after one
<unit>, a capitalised word inside a sentence <name>. Windows of `width` canonical tokens are hash-joined with the
benchmark's, so a question with other numbers, names or units still meets its template; windows that meet by hash are compared token by
token. An item of fewer tokens, but at least `shortest`, has one window of its own length. Only windows with at least half their tokens
as plain words are templates; an item without any is matched by its literal tokens (lower-cased, without surrounding punctuation) instead.

For each alignment of a document with an item (difference of window positions) the values in matching slots are compared: an
item value that stands in several slots must always meet the same document value, or the alignment is dropped. Where the
alignments left contradict each other, only the one that covers most of the item counts. A document is contaminated by an item
if consistent alignments cover at least `coverage` of the item's windows.

If the benchmark has at most `listed_windows` distinct windows, their hashes form the build side as a set inside the scan, and no
text or document window is shuffled; beyond that windows meet in a shuffled join and texts are read again for documents with a match. The
texts' matches are the same.

Defined cases: null or empty text has no windows; items under `shortest` tokens say too little and match nothing; rows that
share id and text are one document; a null id is reported as null; rows with equal results come once; extra columns are
ignored by `matches` and kept by `decontaminate`; an empty table on either side gives no matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, documents, stash

#: Units that are placeholders after a number.
UNITS = (
    "mm cm m km in ft yd mi mile miles inch inches foot feet meter meters metre metres g kg mg lb lbs oz pound pounds gram grams "
    "kilogram kilograms ton tons l ml liter liters litre litres gallon gallons cup cups s sec secs second seconds min mins minute "
    "minutes h hr hrs hour hours day days week weeks month months year years percent dollar dollars cent cents euro euros usd eur "
    "degree degrees kmh mph w kw v a hz"
).split()


def _edge_stripped(w: Column) -> Column:
    return F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def tokens(text: Column) -> Column:
    """Words that have a letter or digit, as they stand."""
    return F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0)), lambda w: w.rlike(r"[\p{L}\p{N}]"))


def canonical(raw: Column) -> Column:
    """Placeholders and lower-case words for the array of raw tokens."""

    def one(w: Column, i: Column) -> Column:
        before = F.when(i > 0, F.element_at(raw, i)).otherwise(F.lit("."))  # element_at counts from 1: the one before
        plain = F.lower(_edge_stripped(w))
        return (
            F.when(w.rlike(r"\p{Nd}"), F.lit("<num>"))
            .when(w.rlike(r"^[^\p{L}\p{N}]*\p{Lu}\p{Ll}") & ~before.rlike(r"[.!?][^\p{L}\p{N}]*$"), F.lit("<name>"))
            .when(before.rlike(r"\p{Nd}") & plain.isin(UNITS), F.lit("<unit>"))
            .otherwise(plain)
        )

    return F.transform(raw, one)


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: inside a lambda a copied expression would run once a window."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal(raw: Column) -> Column:
    """Lower-case words without surrounding punctuation."""
    return F.transform(raw, lambda w: F.lower(_edge_stripped(w)))


def _hashed(line: Column, width: int, kind: str) -> Column:
    """struct<at,h> of each window; none for a text under width tokens. The kind is hashed along: one list serves all kinds."""
    last = F.size(line) - width
    none = F.array().cast("array<struct<at:int,h:bigint>>")
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice(line, i + 1, width), F.lit(f"{kind}{width}")).alias("h")))).otherwise(none)


def _slots(raw: Column, canon: Column, start: Column, width: Column) -> Column:
    """(offset, value) of the placeholders in a window."""
    part, kind = F.slice(raw, start + 1, width), F.slice(canon, start + 1, width)
    marked = F.transform(part, lambda w, i: F.struct(i.alias("i"), F.lower(_edge_stripped(w)).alias("v"), F.element_at(kind, i + 1).alias("k")))
    return F.filter(marked, lambda s: s["k"].isin(*HOLDERS))


HOLDERS = ("<num>", "<name>", "<unit>")


def _templates(bench: DataFrame, item_col: str, item_text: str, width: int, shortest: int) -> DataFrame:
    """item, b_at, kind (t: template, l: literal), w (tokens), h, b_line (the window's tokens), b_slots."""
    items = bench.select(F.col(item_col).alias("item"), tokens(F.col(item_text)).alias("raw")).withColumn("canon", canonical(F.col("raw")))
    items = items.where(F.size("raw") >= shortest).withColumn("w", F.least(F.lit(width), F.size("raw")))
    items = items.withColumn("b_at", F.explode(F.sequence(F.lit(0), F.size("raw") - F.col("w"))))
    window = F.slice("canon", F.col("b_at") + 1, F.col("w"))
    plain = F.size(F.filter(window, lambda x: ~x.isin(*HOLDERS))) * 2 >= F.col("w")
    items = items.select("item", "b_at", "w", window.alias("t_line"), F.slice(literal(F.col("raw")), F.col("b_at") + 1, F.col("w")).alias("l_line"), _slots(F.col("raw"), F.col("canon"), F.col("b_at"), F.col("w")).alias("b_slots"), plain.alias("plain"))
    any_plain = items.groupBy("item").agg(F.max("plain").alias("has"))
    items = items.join(any_plain, items["item"].eqNullSafe(any_plain["item"])).drop(any_plain["item"]).where("plain OR NOT has")
    kind = F.when(F.col("has"), F.lit("t")).otherwise(F.lit("l"))
    line = F.when(F.col("has"), F.col("t_line")).otherwise(F.col("l_line"))
    named = F.xxhash64(line, F.concat(kind, F.col("w").cast("string")))
    # Literal windows agree in every value: there is nothing to compare.
    slots = F.when(F.col("has"), F.col("b_slots")).otherwise(F.filter("b_slots", lambda s: F.lit(False)))
    return stash(items.select("item", "b_at", kind.alias("kind"), "w", named.alias("h"), line.alias("b_line"), slots.alias("b_slots")).dropDuplicates(["item", "b_at"]), "templates")


def matches(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 8, coverage: float = 0.5, shortest: int = 3, listed_windows: int = 20_000) -> DataFrame:
    """(key, id, item, matched, item_windows, slots, changed): one row for each contaminated document and item.

    matched: windows of the item that consistent alignments cover; slots: the item's values compared; changed: how many of them
    the document replaces by another value. key names the document: its id and a hash of its text.
    """
    rows = docs.select(F.col(id_col).alias("id"), _key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    templates = _templates(bench, item_col, item_text, width, shortest)
    sizes = templates.groupBy("item").agg(F.countDistinct("b_at").alias("item_windows"))
    shapes = sorted((r.kind, r.w) for r in templates.select("kind", "w").distinct().collect())  # at most two kinds of width - shortest + 1 lengths

    known = [r.h for r in templates.select("h").distinct().limit(listed_windows + 1).collect()]
    if len(known) <= listed_windows:
        found = _found_by_list(rows, known, shapes)
    else:
        found = _found_by_join(rows, templates, shapes)
    found = stash(found, "found")

    # Equal hashes are only candidates: the tokens decide. Of the documents left, those with enough of an item's windows.
    hits = found.join(templates, "h").where(F.col("d_line") == F.col("b_line"))
    hits = hits.select("key", "id", "item", "b_at", (F.col("at") - F.col("b_at")).alias("shift"), "b_slots", "d_slots")
    many = hits.groupBy("key", "item").agg(F.countDistinct("b_at").alias("n")).join(sizes, "item").where(F.col("n") >= coverage * F.col("item_windows"))
    both = stash(hits.join(many.select("key", "item"), ["key", "item"], "left_semi"), "aligned")
    pairs = both.select("key", "item", "shift", F.explode(F.arrays_zip("b_slots", "d_slots")).alias("s"))
    values = pairs.groupBy("key", "item", "shift", F.col("s.b_slots.v").alias("b")).agg(F.min("s.d_slots.v").alias("lo"), F.max("s.d_slots.v").alias("hi"))
    torn = values.where("lo <> hi").select("key", "item", "shift").distinct()
    values = stash(values.join(torn, ["key", "item", "shift"], "left_anti"), "values")
    held = both.select("key", "id", "item", "shift", "b_at").join(torn, ["key", "item", "shift"], "left_anti")

    # Alignments that give one value of the item different values contradict each other: then the one that covers most counts.
    clash = values.groupBy("key", "item", "b").agg((F.min("lo") != F.max("hi")).alias("differs")).groupBy("key", "item").agg(F.max("differs").alias("clash"))
    each = held.groupBy("key", "id", "item", "shift").agg(F.countDistinct("b_at").alias("n"))
    best = each.groupBy("key", "item").agg(F.max(F.struct("n", -F.col("shift"))).alias("b")).select("key", "item", (-F.col("b")["col2"]).alias("best"))
    held = held.join(best, ["key", "item"]).join(clash, ["key", "item"], "left").where("NOT coalesce(clash, false) OR shift = best")
    covered = held.groupBy("key", "id", "item").agg(F.countDistinct("b_at").alias("matched"))
    counted = values.join(best, ["key", "item"]).where("shift = best").groupBy("key", "item").agg(F.count("*").alias("slots"), F.sum((F.col("lo") != F.col("b")).cast("int")).alias("changed"))
    out = covered.join(sizes, "item").where(F.col("matched") >= coverage * F.col("item_windows")).join(counted, ["key", "item"], "left")
    return out.select("key", "id", "item", "matched", "item_windows", F.coalesce("slots", F.lit(0)).alias("slots"), F.coalesce("changed", F.lit(0)).alias("changed"))


def _windows(raw: Column, canon: Column, shapes: list[tuple[str, int]], keep) -> Column:
    """array<struct<at,h,d_line,d_slots>> of the windows of those kinds and lengths whose struct<at,h> passes keep."""

    def of(kind: str, width: int) -> Column:
        line = canon if kind == "t" else literal(raw)
        slots = lambda x: _slots(raw, canon, x["at"], F.lit(width)) if kind == "t" else F.filter(_slots(raw, canon, x["at"], F.lit(width)), lambda s: F.lit(False))
        hit = lambda x: F.struct(x["at"].alias("at"), x["h"].alias("h"), F.slice(line, x["at"] + 1, width).alias("d_line"), slots(x).alias("d_slots"))
        return F.transform(F.filter(_hashed(line, width, kind), keep), hit)

    return F.concat(*[of(*s) for s in shapes]) if shapes else F.array().cast("array<struct<at:int,h:bigint,d_line:array<string>,d_slots:array<struct<i:int,v:string,k:string>>>>")


def _found_by_list(rows: DataFrame, known: list[int], shapes: list[tuple[str, int]]) -> DataFrame:
    """(key, id, at, h, d_line, d_slots) of windows whose hash is one of a bounded list: one scan, no shuffle."""
    return _exploded(rows, lambda raw, canon: _windows(raw, canon, shapes, lambda x: x["h"].isin(known)))


def _found_by_join(rows: DataFrame, templates: DataFrame, shapes: list[tuple[str, int]]) -> DataFrame:
    """The same for any size of benchmark: windows meet by shuffle, then texts with a match are read again."""
    every = _let(tokens(F.col("text")), lambda raw: _let(canonical(raw), lambda canon: F.concat(*[_hashed(canon if k == "t" else literal(raw), w, k) for k, w in shapes])))
    seen = rows.select("key", F.explode_outer(every).alias("w")).select("key", "w.at", "w.h")
    hits = stash(seen.join(templates.select("h").distinct().hint("merge"), "h").distinct(), "hits")
    again = hits.groupBy("key").agg(F.collect_set(F.struct("at", "h")).alias("hit"))
    both = rows.hint("merge").join(again, "key")
    return _exploded(both, lambda raw, canon: _windows(raw, canon, shapes, lambda x: F.array_contains("hit", F.struct(x["at"].alias("at"), x["h"].alias("h")))))


def _exploded(rows: DataFrame, windows) -> DataFrame:
    """One row for each element. explode_outer: for explode the optimiser would compute the array again in a filter."""
    every = _let(tokens(F.col("text")), lambda raw: _let(canonical(raw), lambda canon: windows(raw, canon)))
    return rows.select("key", "id", F.explode_outer(every).alias("w")).where("w is not null").select("key", "id", "w.at", "w.h", "w.d_line", "w.d_slots").distinct()


def _key(id_col: str, text_col: str) -> Column:
    """A document by its id and a hash of its text: texts of other ids never share it."""
    return F.concat(F.coalesce(F.concat(F.lit("i"), F.col(id_col).cast("string")), F.lit("null")), F.lit(":"), F.coalesce(F.xxhash64(text_col), F.lit(0)).cast("string"))


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents that no item contaminates, all columns."""
    bad = stash(matches(docs, bench, id_col, text_col, **how).select("key").distinct(), "contaminated")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), _key(id_col, text_col).alias("key"))
    return rows.join(bad, "key", "left_anti").select("row.*")


def op4_template_decontamination(spark, sf_dir: str) -> DataFrame:
    found = matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.col("matched").alias("n_matched"), F.col("item_windows").alias("n_windows"), F.col("slots").cast("long").alias("n_slots"), F.col("changed").cast("long").alias("n_changed")).distinct()
