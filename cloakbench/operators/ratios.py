"""Similarity ratios and tolerant recognisers that no built-in expresses: Arrow-batched pandas UDFs."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon as L
from ..functions.checks import normalize
from ..functions.spans import SPAN, score_spans


def _ratio(a: str, b: str) -> float:
    return round(SequenceMatcher(None, a, b).ratio(), 2)


def _partial(a: str, b: str) -> float:
    """Best ratio of the shorter text against windows of the longer one, windows that overhang its ends included."""
    short, long_ = sorted((a, b), key=len)
    if not short:
        return 1.0 if not long_ else 0.0
    n, best = len(short), 0.0
    for k in range(1 - n, len(long_)):
        window = long_[max(0, k) : k + n]
        best = max(best, 2 * _common(short, window) / (n + len(window)))
    return round(best, 2)


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b, 1):
            last, row[k] = row[k], last + 1 if x == y else max(row[k], row[k - 1])
    return row[-1]


@F.pandas_udf(T.DoubleType())
def difflib_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching blocks ratio to two decimals; null counts as empty."""
    return pd.Series([_ratio(x or "", y or "") for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def partial_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_partial(x or "", y or "") for x, y in zip(a, b)])


#: Plain patterns that the edit budgets loosen.
LOOSE = {
    "iban": (r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b", 0.5),
    "ssn": (r"\b[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}\b", 0.85),
    "email": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z]{2,}\b", 0.5),
    "credit_card_number": (r"\b[3-6][0-9]{3}(?:[- ]?[0-9]{4}){2}[- ]?[0-9]{3,4}\b", 0.3),
}


def budget_specs(budgets: dict[str, list[tuple[int, ...]]] | None = None) -> list[tuple[str, str, float]]:
    """(type, tolerant pattern, score): the score falls with the square of the edits allowed.

    budgets: for each type pairs of (deletions, substitutions). A type without a budget, and insertions (a third number), are errors.
    """
    out = []
    for kind, pairs in (L.BUDGETS if budgets is None else budgets).items():
        if not pairs:
            raise ValueError(f"no edit budget for {kind}")
        for pair in pairs:
            if len(pair) > 2 and pair[2]:
                raise ValueError("insertions are not supported")
            d, s = pair[:2]
            out.append((kind, f"(?:{LOOSE[kind][0]}){{s<={s},d<={d}}}", round(LOOSE[kind][1] / (s + d + 1) ** 2, 2)))
    return out


def budget_table(spark: SparkSession) -> DataFrame:
    """type, deletions, substitutions, score of the tolerant recognisers."""
    rows = [(k, d, s, round(LOOSE[k][1] / (s + d + 1) ** 2, 2)) for k, pairs in L.BUDGETS.items() for d, s in pairs]
    return spark.createDataFrame(rows, "type string, deletions int, substitutions int, score double")


@F.pandas_udf(T.ArrayType(T.ArrayType(T.BooleanType())))
def _ratio_hits(true: pd.Series, pred: pd.Series, method: pd.Series, threshold: pd.Series) -> pd.Series:
    by = {"difflib": _ratio, "rapidfuzz": _partial}
    return pd.Series([[[by[m](p, t) >= least for p in (ps if ps is not None else [])] for t in (ts if ts is not None else [])] for ts, ps, m, least in zip(true, pred, method, threshold)])


def score_by_ratio(rows: DataFrame, true: str, pred: str, out: str, level: str = "both", method: str = "rapidfuzz", threshold: float = 0.8, normalized: bool = True) -> DataFrame:
    """rows with score_spans as column `out`, values matched by a ratio (difflib or rapidfuzz) of at least `threshold`, rounded to two places."""
    if method not in ("difflib", "rapidfuzz"):
        raise ValueError(f"unknown method {method!r}")
    value = normalize if normalized else lambda v: F.coalesce(v, F.lit(""))
    side = lambda spans: F.transform(F.coalesce(spans, F.array().cast(f"array<{SPAN}>")), lambda s: value(s["value"]))
    # A column of its own first: lambdas cannot hold Python functions.
    matched = rows.withColumn("__hits", _ratio_hits(side(F.col(true)), side(F.col(pred)), F.lit(method), F.lit(threshold)))
    return matched.withColumn(out, score_spans(F.col(true), F.col(pred), level, normalized=normalized, hits=F.col("__hits"))).drop("__hits")


FUZZY = T.ArrayType(T.StructType([T.StructField("value", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("score", T.DoubleType())]))


@F.pandas_udf(FUZZY)
def fuzzy_hits(texts: pd.Series) -> pd.Series:
    """Hits of the tolerant recognisers, best first, without overlaps; values with fewer than six characters are no hits."""
    import regex

    specs = [(k, regex.compile(p, regex.BESTMATCH | regex.IGNORECASE), s) for k, p, s in budget_specs()]

    def one(text: str | None) -> list[dict]:
        if not text or not regex.search("[0-9@]", text):
            return []
        found = [{"value": m[0], "start": m.start(), "end": m.end(), "type": k, "score": s} for k, p, s in specs for m in p.finditer(text) if len(m[0]) >= 6 and regex.search("[0-9@]", m[0])]
        kept: list[dict] = []
        for h in sorted(found, key=lambda h: (-h["score"], h["start"])):
            if not any(h["start"] <= k["end"] and k["start"] <= h["end"] for k in kept):
                kept.append(h)
        return kept

    return texts.map(one)
