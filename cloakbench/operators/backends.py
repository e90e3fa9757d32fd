"""Model detectors as mapInPandas backends: one load a worker, batches of 32, errors as a column.

The default backends are offline stand-ins: a rule on the text decides, in the output format of each family, so the parsers and
the pipeline run without models or network. A real backend is any function load() -> (list of texts -> list of outputs); an output is
a text, or a text and the log-probabilities of its tokens.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from ..functions import lexicon as L
from ..functions import verdicts as V
from ..functions.checks import iban_valid, let
from ..functions.spans import SPAN, deny_values, detect, resolve_overlaps, span, verdict
from .prompts import RESPONSE
from .ratios import fuzzy_hits

BATCH = 32
LOOKS = r"[0-9]{3}[- ]?[0-9]{2}[- ]?[0-9]{4}|@[a-z0-9.-]+\.[a-z]{2}|[0-9]{4}[- ]?[0-9]{4}"
_looks = re.compile(LOOKS, re.I)
#: What the offline entity models find: addresses, then runs of digits.
MAILS, RUNS = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[a-z]{2,}", r"[0-9][0-9-]{7,}[0-9]"
_entities = re.compile(f"({MAILS})|({RUNS})")
OFFLINE_LOGPROBS = [-0.1, -0.2, -0.3, -0.4, -0.5, -0.6]
UNSAFE_IDS = [0, 2]  # first tokens of the small model that mean unsafe

#: Output of each guard family for an unsafe and a safe text, the parser of its output, and the token that carries the verdict.
FAMILIES: dict[str, tuple[str, str, Callable[[Column], Column], int]] = {
    "llama-guard": ("\n\nunsafe\nS7", "\n\nsafe", V.llama_unsafe, 1),
    "nemotron": ("Prompt harm: harmful\n", "Prompt harm: unharmful\n", V.nemotron_harmful, 3),
    "qwen-guard": ("Safety: Unsafe\nCategories: PII", "Safety: Safe\nCategories: None", V.qwen_pii, 2),
    "granite": ("<score>yes</score>", "<score>no</score>", V.granite_yes, 0),
    "wildguard": ("H arm ful ▁request : ▁yes", "H arm ful ▁request : ▁no", V.wildguard_yes, 5),
}
NER, PRIVACY, SLM, LLM = ("gliner", "gliner-nvidia"), "openai-privacy-filter", "llama-3.2-1b", "gpt-4o-mini"
GLINER = "array<struct<text:string,label:string,start:int,end:int,score:double>>"
LOADER = Callable[[], Callable[[list[str]], list]]


def offline(model: str) -> LOADER:
    """The stand-in of a model, in its output format."""

    def entities(text: str, make: Callable[[re.Match], dict]) -> str:
        return json.dumps([make(m) for m in _entities.finditer(text)], ensure_ascii=False)

    if model in NER:
        return lambda: lambda texts: [entities(t, lambda m: {"text": m[0], "label": "email" if m[1] else "phone_number", "start": m.start(), "end": m.end(), "score": 0.9}) for t in texts]
    if model == PRIVACY:
        return lambda: lambda texts: [entities(t, lambda m: {"entity_group": "private_email" if m[1] else "account_number", "start": m.start(), "end": m.end(), "score": 0.9}) for t in texts]
    if model == SLM:
        return lambda: lambda texts: [json.dumps([2.0, 0.5, 0.1] if _looks.search(t) else [0.5, 2.0, 0.1]) for t in texts]
    if model == LLM:

        def answer(t: str) -> str:
            found = [{"value": m[0], "start": m.start(), "end": m.end(), "type": "email" if m[1] else "phone_number"} for m in _entities.finditer(t)]
            return json.dumps({"result": {"pii_detected": bool(found), "predicted_proba": 0.9 if found else 0.0}, "spans": found, "perplexity": 1.25}, ensure_ascii=False)

        return lambda: lambda texts: [answer(t) for t in texts]
    bad, good, _, _ = FAMILIES[family_of(model)]
    return lambda: lambda texts: [(bad if _looks.search(t) else good, OFFLINE_LOGPROBS) for t in texts]


def family_of(model: str) -> str:
    found = [f for f in FAMILIES if model.startswith(f)]
    if not found:
        raise ValueError(f"unknown model {model!r}")
    return found[0]


def run_model(rows: DataFrame, load: LOADER, keep_text: bool = False) -> DataFrame:
    """uid, output, logprobs, error, latency_ms of llm_input, and that with keep_text; null texts give null outputs; a failing batch gives its error, 80 characters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for whole in batches:
            for at in range(0, len(whole), BATCH):
                b = whole.iloc[at : at + BATCH]
                has = [k for k, t in enumerate(b["llm_input"]) if t is not None]
                out, logprobs, error, began = [None] * len(b), [None] * len(b), None, time.perf_counter()
                try:
                    for k, x in zip(has, model([b["llm_input"].iloc[k] for k in has]) if has else []):
                        out[k], logprobs[k] = x if isinstance(x, tuple) else (x, None)
                except Exception as e:  # a model's failure is a result here
                    error = str(e)[:80]
                text = {"llm_input": b["llm_input"]} if keep_text else {}
                yield pd.DataFrame(text | {"uid": b["uid"], "output": out, "logprobs": logprobs, "error": error, "latency_ms": round((time.perf_counter() - began) / len(b) * 1000, 1)})

    return rows.select("uid", "llm_input").mapInPandas(run, "llm_input string, " * keep_text + "uid long, output string, logprobs array<double>, error string, latency_ms double")


def gliner_spans(output: Column) -> Column:
    """array<SPAN> of an entity model's JSON; values that name the kind of value alone are dropped."""
    found = F.coalesce(F.from_json(output, _parse_datatype_string(GLINER)), F.array().cast(GLINER))
    made = F.transform(found, lambda e: span(e["text"], e["start"], e["end"], e["label"], None, e["score"]))
    return deny_values(made, L.DENIED_PARTS)


def privacy_spans(output: Column, text: Column) -> Column:
    """array<SPAN> of a token classifier's JSON: pieces that touch are joined, classes become types."""
    kind = f"array<{V.ENTITY}>"
    found = F.coalesce(F.from_json(output, _parse_datatype_string(kind)), F.array().cast(kind))
    return V.project_classes(V.merge_adjacent(found), text)


def _parsed(got: DataFrame, model: str, use_logprobs: bool) -> tuple[Column, Column]:
    """(prediction, perplexity) from the output of a model."""
    out, none = F.col("output"), F.array().cast(f"array<{SPAN}>")
    null = F.lit(None).cast("double")
    if model in NER:
        return gliner_spans(out), null
    if model == PRIVACY:
        return privacy_spans(out, F.col("llm_input")), null
    if model == SLM:
        logits = F.coalesce(F.from_json(out, _parse_datatype_string("array<double>")), F.array(F.lit(0.0)))
        gate = V.slm_gate(logits, UNSAFE_IDS)
        return F.when(out.isNull(), none).otherwise(verdict(gate["flag"])), F.when(out.isNotNull(), gate["perplexity"]) if use_logprobs else null
    if model == LLM:
        answer = F.from_json(out, _parse_datatype_string(RESPONSE))
        return F.coalesce(answer["spans"], none), answer["perplexity"] if use_logprobs else null
    _, _, parse, token = FAMILIES[family_of(model)]
    perplexity = F.when(out.isNotNull(), V.token_perplexity(F.coalesce("logprobs", F.array().cast("array<double>")), token))
    return verdict(parse(out)), perplexity if use_logprobs else null


def detect_with(dataset: DataFrame, model: str, load: LOADER | None = None, use_logprobs: bool = True, keep_errors: bool = False) -> DataFrame:
    """predictions rows: uid, model, prediction, perplexity, latency_ms; with keep_errors also `error`, and rows of failed batches."""
    null = lambda t: F.lit(None).cast(t)
    if model not in L.MODELS:
        raise ValueError(f"unknown model {model!r}")
    if model in ("presidio", "presidio-fuzzy"):
        prediction = detect(F.col("llm_input"))
        if model == "presidio-fuzzy":
            loose = F.transform(fuzzy_hits(F.col("llm_input")), lambda h: span(h["value"], h["start"], h["end"], h["type"], None, h["score"], F.lit("fuzzy")))
            dataset = dataset.select("uid", "llm_input", loose.cast(f"array<{SPAN}>").alias("fuzzy"))
            both = let(resolve_overlaps(F.concat(F.coalesce(prediction, F.array().cast(f"array<{SPAN}>")), F.col("fuzzy"))), lambda s: s)
            prediction = F.filter(both, lambda s: (s["type"] != "iban") | iban_valid(s["value"]))
        out = dataset.select("uid", F.lit(model).alias("model"), F.coalesce(prediction, F.array()).cast(f"array<{SPAN}>").alias("prediction"), null("double").alias("perplexity"), null("double").alias("latency_ms"))
        return out.withColumn("error", null("string")) if keep_errors else out
    got = run_model(dataset, load or offline(model), keep_text=model == PRIVACY)
    prediction, perplexity = _parsed(got, model, use_logprobs)
    out = got.select("uid", F.lit(model).alias("model"), prediction.cast(f"array<{SPAN}>").alias("prediction"), perplexity.alias("perplexity"), "latency_ms", "error")
    return out if keep_errors else out.where("error is null").drop("error")


def skipped_models(predictions: DataFrame) -> DataFrame:
    """model, reason: models with a failed batch, and the first of their errors."""
    return predictions.where("error is not null").groupBy("model").agg(F.min("error").alias("reason"))


def left_padded(batches: DataFrame, pad_id: int = 0) -> DataFrame:
    """batch, uid, ids (array<int>) -> ids padded on the left to the batch's longest, and the mask of what is no padding."""
    longest = batches.groupBy("batch").agg(F.max(F.size("ids")).alias("__n"))
    rows = batches.join(longest, "batch")
    short = F.col("__n") - F.size("ids")
    ids = F.concat(F.array_repeat(F.lit(pad_id), short), F.col("ids"))
    mask = F.concat(F.array_repeat(F.lit(0), short), F.array_repeat(F.lit(1), F.size("ids")))
    return rows.select("batch", "uid", ids.alias("ids"), mask.alias("mask"))


def batches_of(rows: DataFrame, size: int = BATCH, key: str = "uid") -> DataFrame:
    """rows with `batch`: the key's range of `size` keys, so a batch is found without numbering all rows in one task."""
    return rows.withColumn("batch", F.floor(F.col(key) / size).cast("long"))
