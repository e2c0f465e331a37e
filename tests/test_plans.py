import math

import pytest
from pyspark.sql import functions as F

from flatewise.functions import features
from flatewise.functions import stats as S
from flatewise.operators import inflate, streams
from flatewise.plans import catalogue
from flatewise.plans import evaluation as E
from flatewise.plans import verdict as V

SF = "/root/testdata/sf0.001"


def entries(spark, rows):
    return spark.createDataFrame(rows, "path string, name string, size long, label string, status string, confidence double, setting string, proof string, ending string, n_matches int, zlib_hits int")


def test_vote_goes_by_bytes_and_unknown_needs_a_majority(spark):
    rows = [("x", "1", 100, "a", "attributed"), ("x", "2", 100, "a", "attributed"), ("x", "3", 1000, "b", "attributed"), ("y", "1", 10, "a", "attributed"), ("y", "2", 30, "", "unknown"), ("z", "1", 5, "a", "insufficient")]
    e = entries(spark, [(*r, 0.9, "6", None, "data", 9, None) for r in rows])
    got = {r["path"]: (r["profile"], r["share"]) for r in V.weighted_vote(e).collect()}
    assert got == {"x": ("b", pytest.approx(1000 / 1200)), "y": ("unknown", pytest.approx(0.75))}


def test_endings_name_the_minority_and_ties_none(spark):
    rows = [("x", "data")] * 3 + [("x", "flush")] + [("y", "data"), ("y", "stored")] + [("z", "data")]
    e = entries(spark, [(p, str(i), 10, "a", "attributed", 0.9, "6", None, k, 9, None) for i, (p, k) in enumerate(rows)])
    got = {(r["path"], r["ending"]): r["odd"] for r in V.odd_endings(e).collect()}
    assert got == {("x", "data"): False, ("x", "flush"): True, ("y", "data"): False, ("y", "stored"): False}


def test_producers(spark):
    names = ["openpyxl", "Compatible / Openpyxl", "LibreOffice/24.2", "Microsoft Office Word", "Microsoft Macintosh Word", "Microsoft Wordpad", "21.0.10 (Ubuntu)", None]
    got = {r["claim"]: r["producer_key"] for r in V.match_producer(spark.createDataFrame([(n,) for n in names], "claim string")).collect()}
    assert [got[n] for n in names] == ["openpyxl", "openpyxl", "libreoffice", "microsoft-word", "microsoft-word", None, "jdk-jar", None]


def test_size_bands_and_least_evidence(spark):
    rows = [(size, i < share * 100, True) for size, share in ((100, 0.7), (500, 0.97), (2000, 0.95), (8000, 1.0), (30000, 0.99), (90000, 0.85)) for i in range(100)]
    banded = E.size_bands(spark.createDataFrame(rows, "size long, correct boolean, answered boolean"))
    assert E.least_evidence(banded).first()[0] == 256


def test_families_and_split(spark):
    nodes = spark.createDataFrame([(i,) for i in range(8)], "id long")
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (5, 6)], "a long, b long")
    got = {r["id"]: r["family"] for r in E.components(nodes, pairs, "id").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 5, 6: 5, 7: 7}
    families = spark.createDataFrame([("real", i, 1 + i % 3) for i in range(30)], "kind string, family long, n long")
    split = E.family_split(families).collect()
    test = sum(r["n"] for r in split if r["split"] == "test")
    assert 0.3 * sum(r["n"] for r in split) <= test + 0.5 and len(split) == 30


def test_similar_sketches_are_all_pairs_in_large_families(spark):
    import random

    rng = random.Random(4)
    template = [f"t{i:03d}" for i in range(24)]
    sets = {i: sorted([*rng.sample(template, 18), *(f"x{rng.randrange(40):03d}" for _ in range(4))])[:16] for i in range(90)}
    sets |= {100 + i: sorted(template)[:16] for i in range(70)} | {200 + i: [f"y{i:03d}"] for i in range(5)} | {300: []}
    sets = {i: sorted(set(s)) for i, s in sets.items()}

    def near(a, b):
        u = sorted({*a, *b})[:16]
        return u and len({*u} & {*a} & {*b}) / len(u) >= 0.5

    want = {(i, j) for i in sets for j in sets if i < j and near(sets[i], sets[j])}
    got = E.similar_sketches(spark.createDataFrame(list(sets.items()), "id long, sketch array<string>"), "id", 0.5, 16).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_near_copies_among_documents_match_brute_force(spark, tmp_path):
    import hashlib
    import random

    rng = random.Random(7)
    base = [[f"w{rng.randrange(900)}" for _ in range(rng.choice([2, 40, 300]))] for _ in range(12)]
    texts = {}
    for i in range(72):
        words = list(base[i % 12])
        for _ in range(rng.randint(0, len(words) // 12)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(900)}"
        texts[i] = " ".join(words)
    spark.createDataFrame([*texts.items(), (900, None), (901, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def sketch(text):
        w = text.lower().split()
        return sorted({hashlib.md5(" ".join(w[i : i + 3]).encode()).hexdigest() for i in range(max(1, len(w) - 2))})[:128]

    s = {i: sketch(t) for i, t in texts.items()}
    got = {r["id"]: (r["n"], r["least"]) for r in catalogue.queries()["content_sketch"](spark, str(tmp_path)).collect()}
    assert got == {i: (len(x), x[0]) for i, x in s.items()} and max(len(x) for x in s.values()) == 128
    u = lambda a, b: sorted({*s[a], *s[b]})[:128]
    want = {(a, b) for a in s for b in s if a < b and len({*u(a, b)} & {*s[a]} & {*s[b]}) / len(u(a, b)) >= 0.5}
    found = catalogue.queries()["near_duplicates"](spark, str(tmp_path)).collect()
    assert len(found) == len(want) > 50 and {tuple(r) for r in found} == want


def test_statistics(spark):
    row = spark.createDataFrame([([3, 1, 2, 2],), ([],), ([5],)], "a array<int>")
    got = row.select(S.mean(F.col("a")), S.median(F.col("a")), S.stdev(F.col("a")), S.entropy(F.col("a")), S.gini(F.col("a")), S.first_top(F.col("a"))).collect()
    assert got[0][0] == 2 and got[0][1] == 2 and got[0][2] == pytest.approx(math.sqrt(2 / 3)) and got[0][5] == 0
    assert got[0][3] == pytest.approx(-sum(c / 8 * math.log2(c / 8) for c in (3, 1, 2, 2))) and got[0][4] == pytest.approx(1 - 18 / 64)
    assert list(got[1]) == [0, 0, 0, 0, 0, 0] and got[2][2] == 0


def test_features_against_the_record(spark):
    data = b"".join(b"<row id='%d'><v>%d</v></row>" % (i, i * 7919 % 1000) for i in range(2000))
    made = streams.compress(spark.createDataFrame([(1, bytearray(data))], "id int, content binary"), [("zlib", "6"), ("zlib", "1f")])
    rows = {r["setting"]: dict(zip(features.names(), r["f"])) for r in features.stream_features(made).select("setting", "f").collect()}
    assert len(features.names()) == 213 == len(set(features.names()))
    from flatewise.operators import encoders

    for setting, f in rows.items():
        r = inflate.parse(encoders.zlib_setting(data, setting))
        blocks = [b for b in r.blocks if b.out_size]
        assert f["blk_count"] == len(blocks) and f["tok_count"] == r.n_tokens
        assert f["tok_match_len_mean"] == pytest.approx(sum(b.len_sum for b in r.blocks) / r.n_matches)
        assert f["tok_run1_frac"] == pytest.approx(sum(b.run1 for b in r.blocks) / sum(b.runs for b in r.blocks))
        assert f["str_ratio"] == pytest.approx(r.compressed_bytes / r.out_size)
        assert sum(f[f"len_code_{i}"] for i in range(29)) == pytest.approx(1) and sum(f[f"lit_shape_{i}"] for i in range(1, 16)) == pytest.approx(1)
    assert rows["1f"]["blk_flush_markers"] == 1 and rows["1f"]["blk_term_empty_coded"] == 1 and rows["6"]["blk_flush_markers"] == 0


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import os

    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("documents", "labels", "lineitem", "part", "pages", "embeddings", "conversations", "events", "benchmark", "customer", "nation", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    want = con.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = catalogue.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_near_copies_are_found_without_making_words_again_for_each_shingle(spark, tmp_path):
    """The filter on sketches went below the exchange, so that a text was split anew for every word of it."""
    text = " ".join(f"w{i % 4999}" for i in range(30_000))
    spark.createDataFrame([(1, text), (2, text + " end"), (3, " \tShort  TEXT\n"), (4, "\tshort\ntext "), (5, ""), (6, " "), (7, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = catalogue.queries()["near_duplicates"](spark, str(tmp_path))
    assert {tuple(r) for r in found.collect()} == {(1, 2), (3, 4)}
    assert "split(" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_sketch_words_are_those_of_the_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    texts = [(0, ""), (1, " "), (2, "a"), (3, " a b"), (4, "a b \n"), (5, "a\x0bb\fc d e f g"), (6, "Ä İ x Ä İ x y"), (7, "a b c d " * 9)]
    spark_rows = E.sketch(spark.createDataFrame(texts, "id int, text string"), "id", k=4).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id INT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", texts[:6] + texts[7:])
    want = dict(con.execute(f"WITH {catalogue.SKETCHES.replace('128', '4')} SELECT id, sketch FROM k").fetchall())
    assert {r["id"]: r["sketch"] for r in spark_rows if r["id"] != 6} == want


def test_decoding_for_the_output_alone_describes_no_blocks(spark, monkeypatch):
    made = streams.compress(spark.createDataFrame([(1, bytearray(b"abcd" * 900))], "id int, content binary"), [("zlib", "6"), ("own", "lazy"), ("zlib-strategies", "huff")])
    rows = streams.decode(made, output=True, blocks=False).select("blocks", "output", "error").collect()
    assert len(rows) == 3 and all(r["blocks"] is None and r["output"] == b"abcd" * 900 and r["error"] is None for r in rows)
    assert all(r["blocks"] for r in streams.decode(made).collect())
