"""Labelled prompt corpora as DataFrames: clean rows, character attacks, context attacks, dense ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import attacks as A
from ..functions import lexicon as L
from ..functions.checks import choose, pick
from ..functions.spans import SPAN, span

TARGET = "struct<pii:array<string>,context:array<string>>"

#: Sentences around a value, by type.
SENTENCES = {
    "credit_card_number": ("The payment failed, my credit card is ", ", please check the account."),
    "ssn": ("Please update my social security number to ", " before the payroll run."),
    "iban": ("Send the refund to my IBAN ", " today."),
    "phone_number": ("Call me on my phone number ", " after work."),
    "email": ("My email address is ", ", send the message there."),
}


def _luhn_digit(body: Column) -> Column:
    """Check digit for 15 digits."""
    digit = lambda i: F.substr(body, i, F.lit(1)).cast("int")
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, doubled(digit(i))).otherwise(digit(i)))
    return ((10 - total % 10) % 10).cast("string")


def value_of(kind: str, k: Column, name: Column) -> Column:
    """A valid value of the type from an integer key; all arithmetic, so any engine can make it."""
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    if kind == "ssn":
        return F.concat_ws("-", pad(100 + k % 500, 3), pad(1 + k % 99, 2), pad(1 + (k * 7) % 9999, 4))
    if kind == "credit_card_number":
        body = F.concat(F.lit("4"), pad((k * 7919 + 13) % 100_000_000_000_000, 14))
        return F.concat(body, _luhn_digit(body))
    if kind == "iban":
        bban = pad((k * 104729) % 100_000_000_000_000, 14)
        # W, E, S, T, G, B are 32, 14, 28, 29, 16, 11.
        rest = F.concat(F.lit("32142829"), bban, F.lit("161100")).cast("decimal(38,0)") % 97
        return F.concat(F.lit("GB"), pad(98 - rest.cast("int"), 2), F.lit("WEST"), bban)
    if kind == "phone_number":
        return F.concat(F.lit("212-555-"), pad(k % 10000, 4))
    return F.concat(F.lower(F.replace(name, F.lit("#"), F.lit("."))), F.lit("@example.com"))


def positives(customer: DataFrame) -> DataFrame:
    """uid, llm_input, pii_spans: one value a row, every fourth row a second one (an e-mail)."""
    k, name = F.col("c_custkey"), F.col("c_name")
    kind = choose(L.TYPES, k, "type")
    made = {t: value_of(t, k, name) for t in L.TYPES}
    by = lambda f: F.coalesce(*[F.when(kind == t, f(t)) for t in L.TYPES])
    rows = customer.select(k.alias("uid"), kind.alias("kind"), by(lambda t: made[t]).alias("v"), by(lambda t: F.lit(SENTENCES[t][0])).alias("a"), by(lambda t: F.lit(SENTENCES[t][1])).alias("z"), F.when(k % 4 == 0, made["email"]).alias("w"))
    one = F.concat("a", "v", "z")
    start, second = F.length("a"), F.length(one) + F.length(F.lit(" Also write to "))
    text = F.when(F.col("w").isNull(), one).otherwise(F.concat(one, F.lit(" Also write to "), "w", F.lit(".")))
    first = span(F.col("v"), start, start + F.length("v"), F.col("kind"))
    more = span(F.col("w"), second, second + F.length("w"), F.lit("email"))
    spans = F.when(F.col("w").isNull(), F.array(first)).otherwise(F.array(first, more)).cast(f"array<{SPAN}>")
    return rows.select("uid", text.alias("llm_input"), spans.alias("pii_spans"))


def hard_negative(k: Column) -> Column:
    """A sentence with a lookalike: hash, UUID, MAC or serial made from md5."""
    h = F.md5(k.cast("string"))
    part = lambda a, n: F.substring(h, a, n)
    looks = [
        F.concat(F.lit("The build artefact has the checksum "), h, F.lit(".")),
        F.concat(F.lit("Trace id "), F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)), F.lit(" was slow.")),
        F.concat(F.lit("The switch with address "), F.concat_ws(":", *[part(i, 2) for i in (1, 3, 5, 7, 9, 11)]), F.lit(" is down.")),
        F.concat(F.lit("Part SN-"), F.upper(part(1, 10)), F.lit(" arrived.")),
    ]
    n = pick(k, "look", len(looks))
    return F.coalesce(*[F.when(n == i, x) for i, x in enumerate(looks)])


def bulk(customer: DataFrame, documents: DataFrame, weights: tuple[float, float, float] = (0.90, 0.05, 0.05)) -> DataFrame:
    """Baseline dataset: a weighted category a customer key; negatives take the text of a document.

    weights: shares of negative, positive, hard_negative; they must add up to 1.
    """
    if len(weights) != 3 or abs(sum(weights) - 1) > 1e-6:
        raise ValueError("three weights that add up to 1 are needed")
    low, mid = round(weights[0] * 10_000), round((weights[0] + weights[1]) * 10_000)
    u = pick(F.col("uid"), "category", 10_000)
    pos = positives(customer).withColumn("category", F.when(u < low, "negative").when(u < mid, "positive").otherwise("hard_negative"))
    texts = documents.select(F.col("doc_id").alias("uid"), F.col("text").alias("doc_text"))
    rows = pos.join(texts, "uid", "left")
    none = F.array().cast(f"array<{SPAN}>")
    text = F.when(F.col("category") == "positive", F.col("llm_input")).when(F.col("category") == "hard_negative", hard_negative(F.col("uid"))).otherwise(F.coalesce("doc_text", F.lit("How do I reverse a linked list in Python?")))
    return rows.select("uid", F.col("uid").alias("input_id"), "category", F.lit(None).cast(TARGET).alias("attack_target"), text.alias("llm_input"), F.when(F.col("category") == "positive", F.col("pii_spans")).otherwise(none).alias("pii_spans"))


def bulk_rest(existing: DataFrame, customer: DataFrame, documents: DataFrame, **how) -> DataFrame:
    """The rows of the bulk dataset that do not exist yet: a stopped run goes on where it ended."""
    return bulk(customer, documents, **how).join(existing.select("uid"), "uid", "left_anti")


def bernoulli(customer: DataFrame, documents: DataFrame, pii_proba: float) -> DataFrame:
    """The older dataset: each row is positive by a coin of `pii_proba`, else a hard negative one time in ten; values first, ids dense from 0."""
    if not 0 <= pii_proba <= 1:
        raise ValueError("a probability is needed")
    k = F.col("uid")
    kind = F.when(pick(k, "bernoulli", 10_000) < round(pii_proba * 10_000), "positive").when(pick(k, "hard", 10) == 0, "hard_negative").otherwise("negative")
    rows = positives(customer).withColumn("category", kind).join(documents.select(F.col("doc_id").alias("uid"), F.col("text").alias("doc_text")), "uid", "left")
    text = F.when(F.col("category") == "positive", F.col("llm_input")).when(F.col("category") == "hard_negative", hard_negative(k)).otherwise(F.coalesce("doc_text", F.lit("How do I reverse a linked list in Python?")))
    spans = F.when(F.col("category") == "positive", F.col("pii_spans")).otherwise(F.array().cast(f"array<{SPAN}>"))
    return pii_first(rows.select("uid", k.alias("input_id"), "category", F.lit(None).cast(TARGET).alias("attack_target"), text.alias("llm_input"), spans.alias("pii_spans")))


def pii_first(dataset: DataFrame) -> DataFrame:
    """Rows with values before those without, each side by uid; ids dense from 0 in that order."""
    rows = dataset.withColumns({"step": (F.size("pii_spans") == 0).cast("int"), "__uid": F.col("uid")}).drop("uid")
    return dense_ids(rows, 0, ["step", "__uid"]).drop("step", "__uid")


def baseline_categories(dataset: DataFrame) -> DataFrame:
    return dataset.where(F.col("category").isin(L.CATEGORIES))


def baseline_positives(dataset: DataFrame) -> DataFrame:
    return dataset.where((F.col("category") == "positive") & (F.col("uid") == F.col("input_id")))


def derived_positives(dataset: DataFrame) -> DataFrame:
    return dataset.where((F.col("category") == "positive") & (F.col("uid") != F.col("input_id")))


def strip_derived(dataset: DataFrame) -> DataFrame:
    return dataset.where((F.col("category") != "positive") | (F.col("uid") == F.col("input_id")))


def dense_ids(rows: DataFrame, first: int, order: list[str], within: int = 1_000_000) -> DataFrame:
    """uid = first, first + 1, ... in the order of two integer columns.

    Rows are numbered in ranges of at most about `within` keys, and a table of one row a range carries the sums before it, so
    no task gets all rows.
    """
    a, b = order
    ranged = rows.withColumns({"__a": F.col(a) if a == "step" else F.floor(F.col(a) / within), "__b": F.floor(F.col(b) / within) if a == "step" else F.lit(0)})
    counts = ranged.groupBy("__a", "__b").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__a", "__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    number = F.row_number().over(Window.partitionBy("__a", "__b").orderBy(*order))
    out = ranged.withColumn("__r", number).join(counts.select("__a", "__b", before.alias("__before")), ["__a", "__b"])
    return out.withColumn("uid", (F.col("__before") + F.col("__r") - 1 + first).cast("long")).drop("__a", "__b", "__n", "__r", "__before")


def fuzzy_rows(dataset: DataFrame, techniques: list[str] | None = None) -> DataFrame:
    """Baseline positives under each character attack; `step` orders technique-major; ids are not set."""
    techniques = techniques or L.FUZZY_TECHNIQUES
    source = baseline_positives(dataset)
    crossed = source.withColumn("__t", F.explode(F.array(*map(F.lit, techniques))))
    fuzzed = {t: A.fuzz_spans(F.col("llm_input"), F.col("pii_spans"), t, F.col("uid")) for t in techniques}
    new = F.coalesce(*[F.when(F.col("__t") == t, x) for t, x in fuzzed.items()])
    rank = F.array_position(F.array(*map(F.lit, techniques)), F.col("__t"))
    target = F.struct(F.array("__t").alias("pii"), F.lit(None).cast("array<string>").alias("context")).cast(TARGET)
    return crossed.withColumn("__new", new).select(rank.alias("step"), F.col("uid").alias("input_id"), "category", target.alias("attack_target"), F.col("__new.text").alias("llm_input"), F.col("__new.spans").alias("pii_spans"))


def content_rows(derived: DataFrame, lists: list[list[str]] | None = None) -> DataFrame:
    """Fuzzy positives (uid set) under each list of context attacks, applied in list order; row-major order is (uid, step).

    What all lists begin with is done once a row; then a row is copied for each list and goes on through its own attacks.
    """
    lists = lists or L.CONTENT_TECHNIQUES
    shared = 0
    while all(len(x) > shared for x in lists) and len({x[shared] for x in lists}) == 1:
        shared += 1

    def through(rows: DataFrame, attacked: Column) -> DataFrame:
        return rows.withColumn("__x", attacked).withColumns({"__text": F.col("__x.text"), "__spans": F.col("__x.spans")}).drop("__x")

    text, spans, by = F.col("__text"), F.col("__spans"), F.col("uid")
    rows = derived.withColumns({"__text": F.col("llm_input"), "__spans": F.col("pii_spans")})
    for t in lists[0][:shared]:
        rows = through(rows, A.content_attack(text, spans, t, by))
    rows = rows.withColumn("__l", F.explode(F.array(*[F.struct(F.lit(n + 1).alias("step"), F.array(*map(F.lit, x)).alias("names")) for n, x in enumerate(lists)])))
    for k in range(shared, max(map(len, lists))):
        out = F.struct(text.alias("text"), spans.cast(f"array<{SPAN}>").alias("spans"))
        for t in sorted({x[k] for x in lists if len(x) > k}):
            out = F.when(F.get("__l.names", F.lit(k)) == t, A.content_attack(text, spans, t, by)).otherwise(out)
        rows = through(rows, out)
    target = F.struct(F.col("attack_target.pii").alias("pii"), F.col("__l.names").alias("context")).cast(TARGET)
    return rows.select(F.col("uid").alias("source_uid"), F.col("__l.step").alias("step"), "input_id", "category", target.alias("attack_target"), text.alias("llm_input"), spans.alias("pii_spans"))


def with_fuzzy(dataset: DataFrame) -> DataFrame:
    """The dataset and its character attacks, ids dense after the greatest, technique-major."""
    top = dataset.agg(F.max("uid")).first()[0]
    new = dense_ids(fuzzy_rows(dataset), (top or 0) + 1, ["step", "input_id"]).drop("step")
    return dataset.unionByName(new.select(*dataset.columns))


def with_content(dataset: DataFrame) -> DataFrame:
    """The dataset and the context attacks on its fuzzy rows, ids dense after the greatest, row-major."""
    top = dataset.agg(F.max("uid")).first()[0]
    source = derived_positives(dataset).where(F.coalesce(F.size("attack_target.pii"), F.lit(0)) > 0)
    new = dense_ids(content_rows(source), (top or 0) + 1, ["source_uid", "step"])
    return dataset.unionByName(new.select(*dataset.columns))


def category_mix(dataset: DataFrame) -> DataFrame:
    """category, n, pct for the three categories, zero counts included."""
    got = dataset.groupBy("category").agg(F.count("*").alias("n"))
    every = dataset.sparkSession.createDataFrame([(c,) for c in L.CATEGORIES], "category string")
    total = F.sum("n").over(Window.partitionBy())
    return every.join(got, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n")).withColumn("pct", F.when(total > 0, F.round(F.col("n") * 100.0 / total, 6)).otherwise(F.lit(0.0)))
