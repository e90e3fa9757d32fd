"""The span type, rule recognisers with exact offsets, overlap resolution and span scoring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .checks import card_valid, has_subsequence, iban_valid, let, normalize, ssn_valid

SPAN = "struct<value:string,start:int,end:int,type:string,value_fuzzy:string,score:double,recognizer:string>"
SCORE = "struct<exact_match:boolean,true_positive:int,false_positive:int,false_negative:int,precision:double,recall:double,f1:double>"

#: Recognisers of our own: pattern, score, validator (null: none). Plain enough to mean the same in other regex engines.
RECOGNIZERS = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 1.0, None),
    "credit_card_number": (r"\b[0-9](?:[ -]?[0-9]){11,18}\b", 1.0, card_valid),
    "iban": (r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", 1.0, iban_valid),
    "ssn": (r"\b[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}\b", 0.85, ssn_valid),
    "phone_number": (r"(?:\+[0-9]{1,2} )?(?:\([0-9]{3}\) ?|\b[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}\b|\b[0-9]{10}\b", 0.75, None),
}
THRESHOLD = 0.3


def span(value, start, end, kind, fuzzy=None, score=None, recognizer=None) -> Column:
    null = lambda c, t: (F.lit(None) if c is None else c).cast(t)
    return F.struct(
        null(value, "string").alias("value"), null(start, "int").alias("start"), null(end, "int").alias("end"), null(kind, "string").alias("type"),
        null(fuzzy, "string").alias("value_fuzzy"), null(score, "double").alias("score"), null(recognizer, "string").alias("recognizer"),
    )


def above(spans: Column, least: float = THRESHOLD) -> Column:
    """Spans whose score is at least `least`."""
    return F.filter(spans, lambda s: s["score"] >= least)


def verdict(flag: Column) -> Column:
    """What a message-level guard predicts: one span without place, or none."""
    none = F.array().cast(f"array<{SPAN}>")
    return F.when(flag, F.array(span(None, None, None, F.lit("pii")))).otherwise(none)


def find_all(text: Column, pattern: str) -> Column:
    """array<struct<value,start,end>> of all matches; offsets are sums of the lengths of pieces and matches."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<value:string,start:int,end:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["p"])
        end = (begin + F.length(x["h"])).cast("int")
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(x["h"].alias("value"), begin.cast("int").alias("start"), end.alias("end"))).alias("out"))

    pairs = F.filter(F.arrays_zip(pieces.alias("p"), hits.alias("h")), lambda x: x["h"].isNotNull())
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def detect_type(text: Column, kind: str) -> Column:
    """array<SPAN> of one recogniser; null text gives none."""
    pattern, score, valid = RECOGNIZERS[kind]
    hits = find_all(F.coalesce(text, F.lit("")), pattern)
    if valid is not None:
        hits = F.filter(hits, lambda h: valid(h["value"]))
    return F.transform(hits, lambda h: span(h["value"], h["start"], h["end"], F.lit(kind), None, F.lit(score), F.lit(f"{kind}_rule")))


def detect(text: Column) -> Column:
    """All recognisers at or above the threshold; overlaps stay, as a text with no digit or @ stays unscanned."""
    none = F.array().cast(f"array<{SPAN}>")
    return F.when(text.rlike("[0-9@]"), above(F.concat(*(detect_type(text, k) for k in RECOGNIZERS)))).otherwise(none)


def resolve_overlaps(spans: Column) -> Column:
    """By score, then start: keep a span if it neither overlaps nor touches a kept one; in that order."""
    order = F.array_sort(spans, lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    free = lambda kept, s: ~F.exists(kept, lambda k: (s["start"] <= k["end"]) & (k["start"] <= s["end"]))
    return F.aggregate(order, F.array().cast(f"array<{SPAN}>"), lambda kept, s: F.when(free(kept, s), F.array_append(kept, s)).otherwise(kept))


def project_entities(spans: Column, entities: dict[str, str]) -> Column:
    """Known analyzer entity types, renamed; other types go."""
    table = F.create_map(*[F.lit(x) for kv in entities.items() for x in kv])
    renamed = F.transform(spans, lambda s: s.withField("type", F.try_element_at(table, s["type"])))
    return F.filter(renamed, lambda s: s["type"].isNotNull())


def deny_values(spans: Column, parts: list[str]) -> Column:
    return F.filter(spans, lambda s: ~F.coalesce(F.lower(s["value"]).rlike("|".join(parts)), F.lit(False)))


def distinct_spans(nested: Column) -> Column:
    return F.array_distinct(F.flatten(nested))


def safe_divide(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b).otherwise(F.lit(0.0))


def value_matches(pred: Column, true: Column, method: str) -> Column:
    """By the native methods; values come as they are to be compared."""
    if method == "exact":
        return pred == true
    if method == "subsequence":
        return has_subsequence(pred, true)
    raise ValueError(f"unknown method {method!r}: exact or subsequence here, ratios in operators.ratios")


def score_spans(true: Column, pred: Column, level: str = "both", method: str = "subsequence", normalized: bool = True, hits: Column | None = None) -> Column:
    """SCORE of predicted against true spans; null where both are empty or null.

    Each true span takes the first predicted one that matches; one prediction may match several. normalized=False compares values as
    they stand. hits, an array of booleans for each true span and in it each predicted one, takes the place of a method
    (operators.ratios.score_by_ratio makes it).
    """
    if level not in ("value", "type", "both"):
        raise ValueError(f"unknown match level {level!r}")
    empty = F.array().cast("array<struct<v:string,t:string>>")
    value = normalize if normalized else lambda v: F.coalesce(v, F.lit(""))
    clean = lambda spans: F.coalesce(F.transform(spans, lambda s: F.struct(value(s["value"]).alias("v"), s["type"].alias("t"))), empty)

    def fits(a: Column, b: Column, i: Column, j: Column) -> Column:
        # hits is named twice so that the optimiser leaves the column that holds it alone.
        by_value = value_matches(b["v"], a["v"], method) if hits is None else hits.isNotNull() & F.get(F.get(hits, i), j)
        by_type = F.coalesce(a["t"] == b["t"], F.lit(False))
        return {"value": by_value, "type": by_type, "both": by_value & by_type}[level]

    def counted(x: Column) -> Column:
        """1-based number of the first fitting prediction of each true span that has one, beside the two sides."""
        first = F.transform(x["t"], lambda a, i: F.coalesce(F.array_position(F.transform(x["p"], lambda b, j: fits(a, b, i, j)), True), F.lit(0)))
        lone = F.get(x["p"], F.lit(0))
        binary = (F.size(x["p"]) == 1) & (F.coalesce(lone["t"], F.lit("")) == "pii") & (lone["v"] == "")
        return F.struct(F.size(x["t"]).alias("nt"), F.size(x["p"]).alias("np"), binary.alias("binary"), F.filter(first, lambda j: j > 0).alias("hit"))

    def tallied(x: Column) -> Column:
        tp = F.when(x["binary"], x["nt"]).otherwise(F.size(x["hit"]))
        fp = F.when(x["binary"], F.when(x["nt"] > 0, 0).otherwise(1)).otherwise(x["np"] - F.size(F.array_distinct(x["hit"])))
        fn = F.when(x["binary"], 0).otherwise(x["nt"] - F.size(x["hit"]))
        return F.struct(x["nt"].alias("nt"), x["np"].alias("np"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), safe_divide(tp, tp + fp).alias("precision"), safe_divide(tp, tp + fn).alias("recall"))

    def scored(x: Column) -> Column:
        f1 = safe_divide(2 * x["precision"] * x["recall"], x["precision"] + x["recall"])
        exact = (x["tp"] - x["fp"] - x["fn"]) == x["nt"]
        score = F.struct(exact.alias("exact_match"), x["tp"].cast("int").alias("true_positive"), x["fp"].cast("int").alias("false_positive"), x["fn"].cast("int").alias("false_negative"), x["precision"].alias("precision"), x["recall"].alias("recall"), f1.alias("f1"))
        return F.when((x["nt"] > 0) | (x["np"] > 0), score)

    sides = F.struct(clean(true).alias("t"), clean(pred).alias("p"))
    return let(let(let(sides, counted), tallied), scored)
