import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cloakbench.operators import adaptive, corpus, evaluation, ratios, sampling
from cloakbench.plans import queries as P
from cloakbench.sources import tables
from cloakbench.streaming.detection import detect_new

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("customer", "documents", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ["luhn_valid", "detect_email", "atk_chunking", "atk_span_rewrite", "ctx_affix_postfix", "quota_sample", "corpus_fuzzy", "span_score_both", "worst_five", "completeness_gap"])
def test_query_equals_sql(spark, duck, name):
    frame = P.QUERIES[name](spark, D)
    columns = sorted(frame.columns)
    want = duck.sql(P.SQL[name]).select(*[f'"{c}"' for c in columns]).fetchall()
    assert sorted(map(repr, map(tuple, frame.select(columns).collect()))) == sorted(map(repr, want))


def test_every_sql_has_its_query():
    assert set(P.SQL) <= set(P.QUERIES)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_quota_errors(spark):
    with pytest.raises(KeyError):
        sampling.quota_sample(P.dataset(spark, D), {"positives": 1})
    with pytest.raises(ValueError):
        corpus.bulk(None, None, (0.5, 0.2, 0.2))


def test_content_offsets(spark):
    rows = P._clean_positives(spark, D).limit(3).withColumn("attack_target", F.struct(F.array(F.lit("homoglyph")).alias("pii"), F.lit(None).cast("array<string>").alias("context")).cast(corpus.TARGET))
    for r in corpus.content_rows(rows).collect():
        for s in r.pii_spans:
            assert r.llm_input[s.start : s.end] == s.value


def test_csv_round_trip(spark, tmp_path):
    rows = P.dataset(spark, D).limit(5).withColumn("llm_input", F.concat(F.lit('line "one"\n'), "llm_input"))
    tables.write_csv(rows, str(tmp_path / "x"))
    back = tables.read_csv(spark, str(tmp_path / "x"), tables.DATASET_CSV)
    key = lambda d: sorted(map(repr, d.select("uid", "llm_input", "pii_spans", "attack_target").collect()))
    assert key(back) == key(rows)


def test_models_are_replaced(spark, tmp_path):
    p, path = P.predictions(spark, D), str(tmp_path / "p")
    tables.append_predictions(p, path)
    tables.replace_models(p.where("model = 'presidio' AND uid < 10"), path)
    got = tables.read_predictions(spark, path)
    assert got.where("model = 'presidio'").count() == p.where("model = 'presidio' AND uid < 10").count()
    assert got.where("model = 'wildguard-7b'").count() == p.where("model = 'wildguard-7b'").count()


def test_manifest(tmp_path):
    m = tables.Manifest(str(tmp_path / "m.json"))
    m.finish_model("a")
    m.skip_model("b", "x" * 200)
    again = tables.Manifest(m.path)
    assert again.all_done(["a", "b"]) and len(again.state["detection"]["skipped"]["b"]) == 80
    again.finish_stage(3)
    assert not again.all_done(["a"])


def test_stream(spark, tmp_path):
    rows = P.dataset(spark, D)
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        detect_new(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c"), rows.schema)
    assert spark.read.parquet(str(tmp_path / "out")).count() == rows.count()


def test_ratios():
    assert ratios._ratio("123-45-6789", "123456789") == 0.9
    assert ratios._partial("123-45-6789", "123456789") == 0.78


def test_memory():
    m = adaptive.Memory(2)
    for k in range(3):
        m.add(str(k), k % 2)
    assert m.summary() == "1. [DETECTED] 1\n2. [EVADED] 2"


def test_adaptive_loop_covers_all(spark):
    got = P.QUERIES["adaptive_loop"](spark, D).select("attack_id", "pii_type", "attacker_awareness").distinct()
    values = P.values(spark, D).select("uid", "kind")
    want = {(r.uid, r.kind, a) for r in values.collect() for a in ("none", "attacks")}
    assert {tuple(r) for r in got.collect()} == want and len({k for _, k, _ in want}) > 1


def test_evaluate_without_truth(spark):
    p = P.predictions(spark, D).limit(1).withColumn("uid", F.lit(-5).cast("long")).withColumn("prediction", F.array().cast(P.predictions(spark, D).schema["prediction"].dataType))
    x = evaluation.evaluate(p, P.dataset(spark, D)).first().spans_score
    assert x.exact_match and x.true_positive == 0
