"""Parsers of model verdicts, token probabilities and post-processing of token classifications."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .checks import account_class
from .spans import SPAN, span

ENTITY = "struct<entity_group:string,start:int,end:int,score:double>"


def llama_unsafe(output: Column) -> Column:
    trimmed = F.regexp_replace(output, r"^\s+", "")
    return F.coalesce(trimmed.startswith("unsafe") & F.array_contains(F.regexp_extract_all(output, F.lit(r"S[0-9]+"), F.lit(0)), "S7"), F.lit(False))


def nemotron_harmful(output: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(output, r"(?i)prompt harm: (harmful|unharmful)", 1)) == "harmful", F.lit(False))


def qwen_pii(output: Column) -> Column:
    return F.coalesce(output.contains("PII"), F.lit(False))


def granite_yes(output: Column) -> Column:
    tag = F.lower(F.regexp_extract(output, r"(?i)<score>\s*(yes|no)\s*</score>", 1))
    return F.coalesce(F.when(tag != "", tag == "yes").otherwise(F.lower(output).contains("yes")), F.lit(False))


def wildguard_yes(output: Column) -> Column:
    joined = F.replace(F.replace(F.replace(output, F.lit(" "), F.lit("")), F.lit("<0x0A>"), F.lit("\n")), F.lit("▁"), F.lit(" "))
    text = F.when(output.contains("▁") | output.contains("<0x0A>"), joined).otherwise(output)
    return F.coalesce(F.lower(F.regexp_extract(text, r"(?i)harmful request:\s*(yes|no)", 1)) == "yes", F.lit(False))


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    return F.transform(logits, lambda x: F.exp(x - top) / total)


def slm_gate(logits: Column, unsafe: list[int], least: float = 0.5) -> Column:
    """struct<flag,perplexity>: the likeliest first token is an unsafe one at probability `least` or more."""
    p = F.array_max(softmax(logits))
    best = (F.array_position(logits, F.array_max(logits)) - 1).cast("int")
    return F.struct((best.isin(unsafe) & (p >= least)).alias("flag"), (F.lit(1.0) / F.greatest(p, F.lit(1e-12))).alias("perplexity"))


def perplexity(logprobs: Column) -> Column:
    """exp of the negative mean; null where there are none."""
    mean = F.aggregate(logprobs, F.lit(0.0), lambda a, x: a + x) / F.size(logprobs)
    return F.when(F.size(logprobs) > 0, F.exp(-mean))


def token_perplexity(logprobs: Column, index: int) -> Column:
    """1 / p of the token at `index` (from 0); 1 where it is missing."""
    return F.coalesce(F.exp(-F.try_element_at(logprobs, F.lit(index + 1))), F.lit(1.0))


def verdict_logprob(tokens: Column) -> Column:
    """Log-probability of the true or false that follows the tokens pi, i, _detect, ed, \\":; null if there is none."""
    run = F.array(*map(F.lit, ["pi", "i", "_detect", "ed", '":']))
    names = F.transform(tokens, lambda t: t["token"])
    places = F.filter(F.sequence(F.lit(1), F.greatest(F.size(tokens) - 5, F.lit(1))), lambda i: F.slice(names, i, 5) == run)
    found = F.try_element_at(tokens, F.try_element_at(places, F.lit(1)) + 5)
    return F.when(F.lower(F.trim(found["token"])).isin("true", "false"), found["logprob"])


def merge_adjacent(entities: Column) -> Column:
    """Entities of one group that touch become one, at the lower score."""

    def step(acc: Column, e: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = last.withField("end", e["end"]).withField("score", F.least(last["score"], e["score"]))
        touch = F.coalesce((last["entity_group"] == e["entity_group"]) & (last["end"] == e["start"]), F.lit(False))
        return F.when(touch, F.array_append(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), joined.cast(ENTITY))).otherwise(F.array_append(acc, e.cast(ENTITY)))

    return F.aggregate(entities, F.array().cast(f"array<{ENTITY}>"), step)


def project_classes(entities: Column, text: Column) -> Column:
    """array<SPAN>: private e-mails and phones, account numbers by their validators; others go."""

    def one(e: Column) -> Column:
        v = F.substr(text, e["start"] + 1, e["end"] - e["start"])
        kind = F.when(e["entity_group"] == "private_email", F.lit("email")).when(e["entity_group"] == "private_phone", F.lit("phone_number")).when(e["entity_group"] == "account_number", F.coalesce(account_class(v), F.lit("account_number")))
        return span(v, e["start"], e["end"], kind, None, e["score"])

    return F.filter(F.transform(entities, one), lambda s: s["type"].isNotNull()).cast(f"array<{SPAN}>")
