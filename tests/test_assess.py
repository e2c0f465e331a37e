import random

import pytest

from flatewise.operators import encoders
from flatewise.plans import analyse, assess
from flatewise.plans import evaluation as E
from flatewise.plans import model as M
from flatewise.sources import containers, corpus


@pytest.fixture(scope="module")
def rows(spark):
    sources = corpus.synthetic(spark, kinds=("text", "xml", "json", "csv"), sizes=(6000, 12000), per=3)
    made, errors = corpus.build(sources, [("zlib", "1"), ("zlib", "9"), ("own", "lazy"), ("zlib-strategies", "huff")])
    assert errors.count() == 0
    return E.cut(made.withColumn("synthetic", made["profile"] == "none"))  # our own encoder stands for a real one here


def test_evaluation(rows):
    tables = {name: found.collect() for name, found in assess.evaluate(rows, trees=15).items()}
    assert {r["profile"] for r in tables["profiles"]} == {"zlib", "own", "zlib-strategies"} and tables["closed set"][0]["accuracy"] > 0.9
    assert {(r["profile"], r["program"]) for r in tables["profile info"]} == {("zlib", "zlib"), ("own", "own"), ("zlib-strategies", "zlib-strategies")}
    assert next(r["accuracy"] for r in tables["settings"] if r["label"] == "zlib") > 0.7 and tables["overlap"][0][0] == 0
    assert {r["method"]: r["correct"] for r in tables["methods"]}["forced"] > 0 and "rejected_by_either" in tables["novelty, known"][0]


def test_experiments_on_archives(spark, rows, tmp_path):
    model = M.fit(rows, trees=10)
    model.min_bytes = 256  # the few held-out rows here cannot tell
    model.save(f"{tmp_path}/models/one")
    assert [(r["name"], sorted(r["profiles"])) for r in assess.stored_models(spark, f"{tmp_path}/models").collect()] == [("one", ["own", "zlib", "zlib-strategies"])]
    archives = assess.build_archives(corpus.synthetic(spark, kinds=("xml",), sizes=(12000,), per=6, seed=5))
    got = {(r["writer"], r["variant"]): r for r in assess.experiments(archives, model).collect()}
    assert set(got) == {(w, v) for w in assess.WRITERS for v in assess.VARIANTS}
    rates = {k: (r["right_profile"], r["flagged"], r["localised"]) for k, r in got.items()}
    assert rates["python-zipfile", "genuine"][:2] == (1.0, 0.0), rates
    assert all(rates[w, "genuine"][0] == rates[w, "impersonated"][0] for w in assess.WRITERS), rates  # headers change no attribution


def test_metadata_features_of_two_writers(spark):
    rng = random.Random(2)
    parts = [("a.xml", rng.randbytes(300)), ("b.xml", b"x" * 500)]
    files = spark.createDataFrame([(w, bytearray(write(parts))) for w, (_, write) in assess.WRITERS.items()], "path string, content binary")
    rows = {r["path"]: r.asDict() for r in analyse.metadata_features(containers.scan_table(files)).collect()}
    assert len(rows["own"]) == 26 and rows["own"]["date_1980"] == 1.0 and rows["python-zipfile"]["date_1980"] == 0.0 and rows["python-zipfile"]["unix_attributes"] == 1.0
    assert assess.pick_editor("zlib") == "own" and assess.pick_editor("go-flate") == "zlib" and encoders.reference_for("own").available
