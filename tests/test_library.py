import io
import json
import urllib.error

import pytest
from pyspark.sql import functions as F

from cloakbench.functions import lexicon as L
from cloakbench.functions import spans as S
from cloakbench.operators import backends, prompts, ratios, sampling
from cloakbench.plans import QUERIES, SQL, runner
from cloakbench.plans import queries as P
from cloakbench.sources import api, tables
from cloakbench.sources.prompt_files import load_prompts

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in ("customer", "documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


NAMES = [
    "prompt_attributes", "pii_mix", "generate_inputs", "inject_values", "mock_values", "mock_responses", "corpus_bulk", "corpus_adversarial", "pii_first", "eval_join", "ctx_supportive",
    "detect_openai_privacy_filter", "detect_gliner", "detect_llama_3_2_1b", "detect_gpt_4o_mini", "detect_granite_guardian_8b", "skip_on_error", "atk_partial", "atk_rewrite_options",
    "fuzz_invisible_chars", "hard_negative_cases", "sample_report", "csv_round_trip", "model_folders", "damaged_files", "detection_resume",
]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    frame = QUERIES[name](spark, D)
    columns = sorted(frame.columns)
    want = duck.sql(SQL[name]).select(*[f'"{c}"' for c in columns]).fetchall()
    assert sorted(map(repr, map(tuple, frame.select(columns).collect()))) == sorted(map(repr, want))


def spans(*pairs):
    return F.array(*[S.span(F.lit(v), None, None, F.lit(t)) for v, t in pairs])


@pytest.mark.parametrize(
    "method, threshold, hit",
    [("difflib", 0.9, 1), ("difflib", 0.91, 0), ("rapidfuzz", 0.78, 1), ("rapidfuzz", 0.79, 0)],
)
def test_ratio_scores(spark, method, threshold, hit):
    rows = spark.range(1).select(spans(("123-45-6789", "ssn")).alias("t"), spans(("123456789", "ssn")).alias("p"))
    got = ratios.score_by_ratio(rows, "t", "p", "x", "both", method, threshold, normalized=False).first().x
    assert (got.true_positive, got.false_positive, got.false_negative) == (hit, 1 - hit, 1 - hit)


def test_scores_of_plain_values(spark):
    frame = spark.range(1)
    score = lambda **how: frame.select(S.score_spans(spans(("123-45-6789", "ssn")), spans(("123 45 6789", "ssn")), method="exact", **how).alias("x")).first().x.true_positive
    assert score() == 1 and score(normalized=False) == 0
    with pytest.raises(ValueError):
        ratios.score_by_ratio(frame, "t", "p", "x", method="judge")


def test_edit_budgets():
    assert len(ratios.budget_specs()) == 13
    for bad in ({"ssn": []}, {"ssn": [(1, 0, 1)]}):
        with pytest.raises(ValueError):
            ratios.budget_specs(bad)


def test_every_model(spark):
    rows = spark.createDataFrame([(1, "mail me at ann@example.com or 4111-1111-1111-1111"), (2, "nothing here"), (3, None)], "uid long, llm_input string")
    for model in L.MODELS:
        got = {r.uid: r for r in backends.detect_with(rows, model).collect()}
        assert len(got) == 3 and len(got[1].prediction) and not got[2].prediction and not got[3].prediction, model
    with pytest.raises(ValueError):
        backends.detect_with(rows, "gliner-xl")


def test_fuzzy_ibans_need_their_check(spark):
    rows = spark.createDataFrame([(1, "GB82WEST12345698765432 is mine"), (2, "GB00WEST12345698765432 is not")], "uid long, llm_input string")
    got = {r.uid: [s.value for s in r.prediction if s.type == "iban"] for r in backends.detect_with(rows, "presidio-fuzzy").collect()}
    assert got == {1: ["GB82WEST12345698765432"], 2: []}


def test_unknown_schema():
    with pytest.raises(ValueError):
        prompts.mock_response("other_schema", F.lit(""), F.lit(1))


def test_templates_are_filled_exactly(spark):
    rows = spark.range(200).select(F.col("id").alias("uid"), prompts.fill(prompts.input_template(F.col("id"), F.lit(True)), F.col("id")).alias("x"))
    for r in rows.collect():
        assert r.x.spans and "{{" not in r.x.text
        assert all(r.x.text[s.start : s.end] == s.value for s in r.x.spans)


def test_shares_of_drawn_mixes(spark):
    got = {r.b: r["count"] for r in spark.range(20_000).select(prompts.pii_mix(F.col("id"))["bucket"].alias("b")).groupBy("b").count().collect()}
    for name, share in (("single", 0.70), ("cluster", 0.15), ("multi", 0.13), ("many", 0.02)):
        assert got[name] / 20_000 == pytest.approx(share, abs=0.01)


def test_sample_without_caps(spark):
    rows = P.dataset(spark, D)
    everything = dict.fromkeys(L.QUOTAS)
    assert sampling.quota_sample(rows, everything).count() == rows.count()
    assert sampling.quota_sample(rows, dict.fromkeys(L.QUOTAS, 0)).count() == 0


def test_run_in_stages(spark, tmp_path):
    folder, progress = str(tmp_path / "run"), str(tmp_path / "progress.json")
    inputs = {n: spark.read.parquet(f"{D}/{n}.parquet") for n in ("customer", "documents")}
    models = ["presidio", "llama-3.2-1b"]
    m = runner.run(spark, folder, **inputs, models=models, progress=progress)
    data = spark.read.parquet(f"{folder}/dataset")
    n = data.count()
    derived = data.where("uid <> input_id")
    assert data.select("uid").distinct().count() == data.count() and derived.where("size(attack_target.context) > 0").count() == 10 * derived.where("attack_target.context is null").count()
    assert spark.read.parquet(f"{folder}/evaluations").groupBy("model").count().count() == 2
    # The rows that are predicted are not predicted again.
    assert m.state["stage"] == 4
    before = spark.read.parquet(f"{folder}/predictions").count()
    runner.run(spark, folder, models=models, stage=3, progress=progress)
    assert spark.read.parquet(f"{folder}/predictions").count() == before == 2 * n
    states = {r.name: r.state for r in runner.status(spark, folder, progress).collect()}
    assert states["baseline"] == "done"
    to = tables.archive(spark, folder, tables.Manifest(progress))
    assert spark.read.parquet(f"{to}/dataset").count() == n and tables.Manifest(progress).state["stage"] == -1
    with pytest.raises(FileNotFoundError):
        runner.run(spark, folder, skip_generation=True, progress=progress)


def test_older_progress_files(tmp_path):
    path = tmp_path / "p.json"
    path.write_text(json.dumps({"stage": 2, "detection": {"completed": [], "skipped": {}, "in_progress": {"model": "presidio", "processed_uids": [1, 2, 3]}}}))
    assert tables.Manifest(str(path)).state["detection"]["in_progress"] == {"model": "presidio", "processed_count": 3}


def test_retries():
    calls = []

    @api.retry(times=3, delay=0, grow="temperature", by=0.5)
    def f(data):
        calls.append(data["temperature"])
        raise ValueError("again")

    with pytest.raises(ValueError):
        f(data={"temperature": 1.4, "model": "m"})
    assert calls == [1.4, 1.9, 2.0]

    @api.retry(times=3, delay=0)
    def g():
        calls.append("g")
        raise api.AuthenticationError

    with pytest.raises(api.AuthenticationError):
        g()
    assert calls.count("g") == 1


def test_http_source(monkeypatch):
    monkeypatch.setenv("OPENROUTER_API_KEY", "k")
    assert api.provider("m")[2] == "openai/m" and api.provider("a/m")[2] == "a/m"
    sent = []

    def send(request):
        sent.append(json.loads(request.data))
        return io.BytesIO(json.dumps({"choices": [{"message": {"content": '{"spans": []}'}, "logprobs": {"content": [{"token": "x", "logprob": -1}]}}]}).encode())

    got = api.post(data={"model": "m"}, send=send)
    assert got == {"spans": [], "tokens": [{"token": "x", "logprob": -1}]} and sent == [{"model": "openai/m"}]

    def refuse(request):
        raise urllib.error.HTTPError("u", 401, "no", None, None)

    with pytest.raises(api.AuthenticationError):
        api.post(data={"model": "m"}, send=refuse)
    monkeypatch.delenv("OPENROUTER_API_KEY")
    monkeypatch.delenv("OPENAI_API_KEY", raising=False)
    with pytest.raises(api.AuthenticationError):
        api.post(data={"model": "m"})


def test_prompts():
    assert "JSON" in load_prompts("detector")["system"] and {"input", "hard_negative"} <= set(load_prompts("generator"))
