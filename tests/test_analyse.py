import io
import random
import zipfile

from flatewise.operators import encoders, rewrite
from flatewise.plans import analyse, report
from flatewise.sources import containers, corpus


def archive(app, seed=1):
    rng, out = random.Random(seed), io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("docProps/app.xml", f"<Properties><Application>{app}</Application></Properties>")
        for k in range(3):
            z.writestr(f"word/p{k}.xml", "".join(f"<p id='{rng.randint(1, 999)}'>{rng.choice(['alpha', 'beta', 'gamma'])} {rng.random():.3f}</p>" for _ in range(200)))
    return out.getvalue()


def test_verdicts(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    office = archive("LibreOffice")
    edited = rewrite.edit(office, "word/p1.xml", lambda d: encoders.zlib_setting(d, "6f"))
    files = [("lo.docx", office), ("word.docx", archive("Microsoft Office Word")), ("ed.docx", edited), ("bad.zip", b"PK\x05\x06")]
    rows = {r["path"]: r for r in analyse.analyse(spark.createDataFrame([(p, bytearray(d)) for p, d in files], "path string, content binary")).collect()}
    assert rows["lo.docx"]["status"] == "consistent" and rows["lo.docx"]["profile"] == "zlib"
    assert rows["word.docx"]["status"] == "inconsistent" and rows["bad.zip"]["status"] == "error"
    mixed = [f for f in rows["ed.docx"]["findings"] if f["check"] == "mixed-encoders"]
    assert rows["ed.docx"]["status"] == "inconsistent" and "flush" in mixed[0]["text"]
    assert "<html>" in report.verdict_html(rows["lo.docx"].asDict(recursive=True), [])


def test_headers_do_not_touch_features(spark):
    data = archive("LibreOffice", 2)
    scan = lambda d: containers.scan_table(spark.createDataFrame([("a.docx", bytearray(d))], "path string, content binary"))
    assert {r["change"] for r in analyse.metadata_robustness(scan(data), scan(rewrite.normalise(data))).collect()} == {0.0}


def test_sources(spark):
    made = corpus.synthetic(spark, sizes=(300, 1500)).collect()
    assert len({r["source_id"] for r in made}) == 16 and all(len(r["content"]) in (300, 1500) for r in made)
    assert corpus.generate("xml", 500, 1) == corpus.generate("xml", 500, 1) != corpus.generate("xml", 500, 2)
    files = spark.createDataFrame([("a", bytearray(b"x" * 300)), ("b", bytearray(b"x" * 300)), ("c", bytearray(b"PK\x03\x04" + b"y" * 300)), ("d", bytearray(b"z"))], "path string, content binary")
    assert corpus.directory(files).count() == 1
    import gzip

    packed = spark.createDataFrame([("t.gz", bytearray(gzip.compress(b"plain text " * 50))), ("bad.gz", bytearray(b"\x1f\x8b" + b"z" * 300))], "path string, content binary")
    assert [bytes(r["content"]) for r in corpus.directory(packed).collect()] == [b"plain text " * 50]
    high = corpus.generate("binary", 6000, 0)
    assert max(high) > 0x7F and len(encoders.zlib_raw(corpus.generate("random", 6000, 0))) > 6000


def test_streams_without_data_blocks_have_features(spark):
    payloads = [b"", None, bytes([3, 0]), bytes([7, 0, 0, 0]), encoders.zlib_raw(b"abc" * 90)[:4], encoders.zlib_raw(b""), bytes([1, 0, 0, 255, 255])]
    df = spark.createDataFrame([(i, None if p is None else bytearray(p)) for i, p in enumerate(payloads)], "id int, payload binary")
    from flatewise.functions import features

    rows = {r["id"]: r for r in features.stream_features(df).collect()}
    assert len(rows) == len(payloads) and all(len(r["f"]) == 213 and all(v == v for v in r["f"]) for r in rows.values())
    assert all(rows[i]["error"] for i in (0, 1, 3, 4)) and all(rows[i]["error"] is None for i in (2, 5, 6))


def test_proof_steps(spark):
    from flatewise.plans import proofs
    from flatewise.plans import verdict as V

    schema = "path string, name string, index int, size long, label string, status string, confidence double, setting string, proof string, ending string, n_matches int, zlib_hits int, provable boolean, proba map<string,double>, reproduced map<string,string>"

    def row(path, i, label, status="attributed", proof=None, found=(), size=2000, proba=None, matches=99):
        return (path, f"e{i}", i, size, label, status, 1.0 if proof else 0.5, None, proof, "data", matches, None, size >= 1024, proba or {}, dict(found))

    rows = [row("lead", 0, "a", found={"a": "1"}, size=9000), row("lead", 1, "b", found={"a": "1"}), row("lead", 2, "x", "unknown", found={"a": "2"})]
    rows += [row("rescue", 0, "x", "unknown", found={"b": "9"}, proba={"a": 0.5, "b": 0.2, "c": 0.04}), row("rescue", 1, "x", "unknown", found={"c": "9"}, proba={"c": 0.04})]
    rows += [row("misses", i, "a", found={"a": "1"} if i == 5 else {}, size=9000 - i) for i in range(6)]
    rows += [row("moved", 0, "a", found={"a": "1"}, size=9000), row("moved", 1, "zlib", proof="zlib", found={"zlib": "6"}, size=20_000), row("moved", 2, "b", found={"a": "1"})]
    got = {(r["path"], r["index"]): (r["label"], r["proof"], r["status"]) for r in proofs.proven(spark.createDataFrame(rows, schema)).collect()}
    assert got["lead", 1] == ("a", "a", "attributed") and got["lead", 2] == ("a", "a", "attributed") and got["lead", 0][1] == "a"
    assert got["rescue", 0] == ("b", "b", "attributed") and got["rescue", 1][2] == "unknown"
    assert got["misses", 5][1] is None and got["moved", 2] == ("a", "a", "attributed")

    rows = [row("two", i, "zlib", proof="zlib", found={"zlib": "6"}) for i in range(3)] + [row("two", 3, "a", proof="a", found={"a": "1"}), row("two", 4, "?", "insufficient", found={"a": "1"}, size=300)]
    rows += [row("both", 0, "zlib", proof="zlib", found={"zlib": "6", "a": "1"}), row("both", 1, "a", proof="a", found={"a": "1"})]
    rows += [row("tie", 0, "zlib", proof="zlib", found={"zlib": "6"}), row("tie", 1, "a", proof="a", found={"a": "1"}), row("one", 0, "zlib", proof="zlib", found={"zlib": "6"}), row("one", 1, "zlib-strategies", proof="zlib-strategies", found={"zlib-strategies": "rle"})]
    e = spark.createDataFrame(rows, schema)
    sides = {r["path"]: (r["side_odd"], r["side_tied"], r["side_named"]) for r in proofs.sides(e).collect()}
    assert sides == {"two": (["a"], False, ["e3", "e4"]), "tie": ([], True, [])}
    a = e.select("path").distinct().selectExpr("path", "'zip' kind", "cast(null as string) claim", "cast(array() as array<int>) option_bits_seen", "cast(array() as array<string>) duplicate_names", "0 encrypted", "0 backslash_names")
    found = {r["path"]: r for r in V.verdicts(e, a, ["zlib", "a"], proofs.sides(e)).collect()}
    assert found["two"]["status"] == "inconsistent" == found["tie"]["status"] and found["two"]["named"] == ["e3", "e4"] and found["one"]["status"] == "inconclusive"


def test_streaming_ingest(spark, tmp_path):
    import gzip

    from flatewise.streaming import ingest

    for k in range(3):
        (tmp_path / f"f{k}.gz").write_bytes(gzip.compress(b"stream data %d " % k * 50))
    rows = ingest.stream_rows(ingest.files(spark, str(tmp_path)))
    query = rows.writeStream.format("memory").queryName("ingested").outputMode("append").start()
    query.processAllAvailable()
    (tmp_path / "late.gz").write_bytes(gzip.compress(b"late " * 90))
    query.processAllAvailable()
    query.stop()
    got = spark.table("ingested").collect()
    assert len(got) == 4 and all(r["error"] is None and r["ending"] == "data" for r in got) and max(r["out_size"] for r in got) == 700
