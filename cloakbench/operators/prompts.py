"""Generated prompts: drawn attributes, templates with placeholders, filled values, lookalike values, offline answers.

Every draw is an md5 pick of a key and a salt, so a row's prompt follows from its key alone and any engine draws the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import pools as P
from ..functions.checks import choose, let, pick, template_error
from ..functions.spans import SPAN, detect, span
from .corpus import _luhn_digit, value_of

PARTS = 10_000
#: Sentences of the offline generator.
SUBJECTS = "the form that my {} team sent me yesterday"
CONNECTORS = ["Please use {} for this.", "The details on file are {}.", "My record shows {}.", "They asked me for {}."]
CLOSINGS = ["Thanks!", "What should I do next?", "Please keep it short.", ""]
PLAIN = ["How do I plan my week better?", "What makes a good summary?", "Explain how tides work.", "Which books on this would you recommend?"]
SCHEMAS = ["llm_input_schema", "hard_negative_schema", "llm_pii_detector_schema", "pii_fuzzer_schema", "pii_comparison", "pii_exists_validation"]


def weighted(options: dict, key: Column, salt: str) -> Column:
    """An option by its share; shares add up to 1 and are taken to four places."""
    u, names, low = pick(key, salt, PARTS), list(options), 0.0
    out = None
    for name in names[:-1]:
        low += options[name]
        hit = u < round(low * PARTS)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return F.lit(names[-1]) if out is None else out.otherwise(F.lit(names[-1]))


def drawn(pool: list[str], n: Column, key: Column, salt: str) -> Column:
    """n distinct items of the pool, in drawn order."""
    order = F.array_sort(F.transform(F.array(*map(F.lit, pool)), lambda x: F.struct(F.md5(F.concat_ws("|", key.cast("string"), F.lit(salt), x)).alias("h"), x.alias("v"))))
    return F.slice(F.transform(order, lambda s: s["v"]), 1, n)


def attributes(key: Column) -> dict[str, Column]:
    """topics (1 or 2), tone, length, opener (half of them lower-case), scenario."""
    topics = drawn(P.TOPICS, (pick(key, "n_topics", 2) + 1).cast("int"), key, "topic")
    opener = F.when(pick(key, "pool", 2) == 0, choose(P.LOWERCASE_OPENERS, key, "opener")).otherwise(choose(P.TITLECASE_OPENERS, key, "opener"))
    return {"topics": topics, "tone": choose(P.TONES, key, "tone"), "length": weighted(P.LENGTHS, key, "length"), "opener": opener, "scenario": choose(P.SCENARIOS, key, "scenario")}


def pii_mix(key: Column) -> Column:
    """struct<bucket,types>: one type; one type two or three times; two or three types; four or five types (both sorted)."""
    more = lambda low: F.array_sort(drawn(L.TYPES, (pick(key, "n_types", 2) + low).cast("int"), key, "types"))
    one = choose(L.TYPES, key, "one")

    def made(b: Column) -> Column:
        types = F.when(b == "single", F.array(one)).when(b == "cluster", F.array_repeat(one, (pick(key, "n_same", 2) + 2).cast("int"))).when(b == "multi", more(2)).otherwise(more(4))
        return F.struct(b.alias("bucket"), types.alias("types"))

    return let(weighted(P.PII_MIX, key, "bucket"), made)


def lookalikes(key: Column) -> Column:
    """One to four kinds of lookalike values, sorted; mostly one."""
    return F.array_sort(drawn(P.LOOKALIKES, weighted(P.LOOKALIKE_COUNTS, key, "n_lookalikes").cast("int"), key, "lookalike"))


def input_template(key: Column, positive: Column) -> Column:
    """A message with a placeholder for each value of the mix, or a plain one."""
    a = attributes(key)
    names = F.array_join(F.transform(pii_mix(key)["types"], lambda t: F.concat(F.lit("{{"), t, F.lit("}}"))), ", ")
    about = F.concat(a["opener"], F.lit(" "), F.format_string(SUBJECTS.replace("{}", "%s"), a["topics"][0]), F.lit("."))
    asked = F.replace(choose(CONNECTORS, key, "connector"), F.lit("{}"), names)
    full = F.concat_ws(" ", about, asked, F.nullif(choose(CLOSINGS, key, "closing"), F.lit("")))
    return F.when(positive, full).otherwise(choose(PLAIN, key, "plain"))


def generated_inputs(keys: DataFrame, key: str = "uid", positive: str = "positive") -> DataFrame:
    """uid, positive, template, error: error is null for a template that passes the check."""
    rows = keys.select(key, positive, input_template(F.col(key), F.col(positive)).alias("template"))
    return rows.withColumn("error", template_error(F.col("template"), F.col(positive), F.size(detect(F.col("template")))))


def fill(template: Column, key: Column) -> Column:
    """struct<text,spans>: the n-th placeholder becomes a valid value of its type, made from key * 10 + n."""
    mark = r"\{\{[a-z_]+\}\}"
    pieces, names = F.split(template, mark, -1), F.regexp_extract_all(template, F.lit(r"\{\{([a-z_]+)\}\}"), F.lit(1))

    def value(kind: Column, k: Column) -> Column:
        return F.coalesce(*[F.when(kind == t, value_of(t, k, F.concat(F.lit("user#"), k.cast("string")))) for t in L.TYPES])

    start = F.struct(F.lit("").alias("text"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        at = F.length(acc["text"]) + F.length(x["p"])
        put = F.array_append(acc["spans"], span(x["v"], at, at + F.length(x["v"]), x["n"]))
        return F.struct(F.concat(acc["text"], x["p"], F.coalesce(x["v"], F.lit(""))).alias("text"), F.when(x["v"].isNull(), acc["spans"]).otherwise(put).alias("spans"))

    values = F.transform(names, lambda n, i: F.struct(n.alias("n"), value(n, key * 10 + i).alias("v")))
    zipped = F.transform(F.arrays_zip(pieces.alias("p"), values.alias("x")), lambda z: F.struct(z["p"].alias("p"), z["x"]["n"].alias("n"), z["x"]["v"].alias("v")))
    return F.aggregate(zipped, start, step)


def mock_values(key: Column) -> dict[str, Column]:
    """Values that look like personal ones and are none; the card always fails its checksum."""
    k = key.cast("string")
    h, s = F.md5(k), F.sha2(k, 256)
    body = F.concat(F.lit("4"), F.lpad(((key * 7919 + 13) % 100_000_000_000_000).cast("string"), 14, "0"))
    wrong = ((_luhn_digit(body).cast("int") + 1 + pick(key, "card", 9)) % 10).cast("string")
    part = lambda a, n: F.substring(h, a, n)
    return {
        "invalid_card": F.concat(body, wrong),
        "uuid": F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12)),
        "sha256": s,
        "md5": h,
        "mac": F.concat_ws(":", *[part(i, 2) for i in (1, 3, 5, 7, 9, 11)]),
        "serial": F.concat(F.lit("SN-"), F.upper(part(1, 10))),
        "tracking": F.concat(F.lit("1Z"), F.upper(part(3, 16))),
        "api_key": F.concat(F.lit("sk-"), F.substring(s, 1, 32)),
    }


def mock_response(schema: str, text: Column, key: Column) -> Column:
    """The offline answer to a request of that schema, as JSON text; an unknown schema is an error."""
    if schema not in SCHEMAS:
        raise ValueError(f"no offline answer for the schema {schema!r}")
    if schema == "llm_input_schema":
        return F.to_json(F.struct(input_template(key, F.lit(True)).alias("llm_input")))
    if schema == "hard_negative_schema":
        return F.to_json(F.struct(F.concat(F.lit("The build "), mock_values(key)["sha256"], F.lit(" failed.")).alias("llm_input")))
    if schema == "llm_pii_detector_schema":
        found = detect(text)
        proba = F.when(F.size(found) > 0, (pick(key, "proba", 31) + 70) / 100.0).otherwise(F.lit(0.0))
        return F.to_json(F.struct(F.struct((F.size(found) > 0).alias("pii_detected"), proba.alias("predicted_proba")).alias("result"), found.alias("spans")))
    if schema == "pii_fuzzer_schema":
        n = pick(key, "perturb", 4)
        new = F.when(n == 0, F.concat_ws("  ", F.element_at(F.split(text, " ", 2), 1), F.try_element_at(F.split(text, " ", 2), F.lit(2)))).when(n == 1, F.concat(text, F.lit(" [end]"))).when(n == 2, F.concat(F.lower(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))).otherwise(text)
        return F.to_json(F.struct(new.alias("fuzzy_text"), F.array().cast("array<string>").alias("pii_spans")))
    if schema == "pii_comparison":
        return F.to_json(F.struct(((pick(key, "score", 71) + 30) / 100.0).alias("score")))
    return F.to_json(F.struct((pick(key, "exists", 10) < 8).alias("result")))


RESPONSE = f"struct<result:struct<pii_detected:boolean,predicted_proba:double>,spans:array<{SPAN}>,perplexity:double>"


def flatten_responses(rows: DataFrame, response: str = "response") -> DataFrame:
    """The columns of rows with the answer's fields as columns; a malformed answer gives nulls."""
    from pyspark.sql.types import _parse_datatype_string

    parsed = rows.withColumn("__r", F.from_json(response, _parse_datatype_string(RESPONSE)))
    return parsed.withColumns({"pii_detected": F.col("__r.result.pii_detected"), "predicted_proba": F.col("__r.result.predicted_proba"), "spans": F.col("__r.spans"), "perplexity": F.col("__r.perplexity")}).drop("__r", response)
