import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flatewise.llm import bpe, common, html, lattice, lcp, lines, packing, quality, shingles, simhash, suffix, urlfilter

public_tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, __key string"
ODD = [(None, None, "x", "k"), (1, "", None, None), (2, "   \n\t ", "en", None), (3, "word", "en", "z"), (3, "word", "en", "z"), (4, "x" * 30_000, "en", "z"), (5, "a b c\n" * 3000, "de", "y"), (6, None, None, None)]


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def prose(rng, n):
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    shared = [prose(rng, rng.randint(10, 60)) for _ in range(6)]
    rows = []
    for i in range(120):
        parts = [rng.choice([prose(rng, rng.randint(0, 30)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 40) :]]) for _ in range(rng.randint(0, 5))]
        rows.append((i, rng.choice(["", "\n", " "]).join(parts), "en", None))
    return rows + [(900, "x" * 450, "en", None), (901, "y" * 99, "en", None), (902, "y" * 100, "en", None), (903, "y" * 100, "en", None)]


# ---- 1 suffix arrays


def brute_repeats(rows, kept_texts=None):
    seen, out, kept_texts = {}, {}, {} if kept_texts is None else kept_texts
    for i, t in sorted(rows, key=lambda r: r[0]):
        d = (t or "").encode()
        mark = bytearray(len(d))
        for s in range(len(d) - 99):
            w = d[s : s + 100]
            if w in seen:
                mark[s : s + 100] = b"\1" * 100
            else:
                seen[w] = (i, s)
        kept = bytes(b for b, m in zip(d, mark) if not m)
        kept_texts[i] = kept.decode("utf-8", "ignore")
        out[i] = (len(d), sum(mark), sum(1 for k in range(len(d)) if mark[k] and (k == 0 or not mark[k - 1])), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats_match_brute_force(spark, texts):
    got = {r[0]: tuple(r)[1:] for r in suffix.digests(suffix.repeats(docs(spark, texts))).collect()}
    assert got == brute_repeats([r[:2] for r in texts])


def test_repeats_with_hot_anchors(spark, texts, monkeypatch):
    monkeypatch.setattr(suffix, "HOT_FRAGMENTS", 2)
    monkeypatch.setattr(suffix, "SAMPLE_SHARE", 1)
    got = {r[0]: tuple(r)[1:] for r in suffix.digests(suffix.repeats(docs(spark, texts))).collect()}
    assert got == brute_repeats([r[:2] for r in texts])


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(0)
    parts = [bytes(rng.integers(1, 4, rng.integers(1, 150)).astype(np.uint8)) for _ in range(5)]
    parts += [parts[0], parts[1][3:]]
    codes, begin = [], []
    for p in parts:
        begin.append(len(codes))
        codes += [*p, 0]
    c = np.array(codes, np.uint8)
    order, place = suffix.suffix_array(c)
    tails = [bytes(codes[i : i + 100]) for i in order]
    assert tails == sorted(tails)
    prefix = suffix.common_prefixes(c, order, place, np.array(begin), np.array(list(map(len, parts))))
    for r in range(1, len(order)):
        a, b, n = order[r], order[r - 1], 0
        while n < 100 and a + n < len(codes) and b + n < len(codes) and codes[a + n] == codes[b + n] != 0:
            n += 1
        assert codes[a] == 0 or prefix[a] == n


def test_shards_split_large_anchors(monkeypatch):
    monkeypatch.setattr(suffix, "SHARD_BYTES", 1000)
    pieces = np.zeros(30, suffix.PIECE)
    pieces["anchor"], pieces["size"] = [7] * 20 + list(range(10)), 120
    parts = list(suffix.shards(pieces))
    assert sum(len(p) for p, _ in parts) == 30 and any(spread for _, spread in parts) and all(len(p) <= 9 for p, _ in parts)


def test_repeats_in_odd_rows(spark):
    rows = suffix.repeats(docs(spark, ODD)).collect()
    assert len(rows) == len(ODD)
    by = {r["doc_id"]: r for r in rows}
    assert by[None]["n_bytes"] == 0 and len(by[4]["kept"]) == 1 and len(by[3]["kept"]) == 4
    assert suffix.repeats(docs(spark, ODD).where("false")).count() == 0
    kept = suffix.remove_repeats(docs(spark, ODD))
    assert kept.columns == [c.split()[0] for c in DOCS.split(", ")] and kept.count() == len(ODD) and {r["__key"] for r in kept.collect()} == {r[3] for r in ODD}


# ---- 2 quality


def test_quality_learns_and_scores_everything(spark):
    rng = random.Random(1)
    good = lambda: "\n".join(prose(rng, 20).capitalize() + "." for _ in range(5))
    bad = lambda: "\n".join(" ".join(w.upper() + "!!" for w in prose(rng, 20).split()) for _ in range(5))
    rows = [(i, bad() if i % 3 == 0 else good(), "en", None) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), None) for i in range(200)] + [(None, 1, None), (5000, None, None)], "doc_id long, quality int, text string")
    got = quality.quality(docs(spark, rows + ODD), labels)
    assert got.count() == 200 + len(ODD) and got.where("score is null or score < 0 or score > 1").count() == 0
    held = {r["doc_id"]: r["predicted"] for r in got.where("held_out and doc_id >= 10").collect()}
    assert sum(p == int(i % 3 != 0) for i, p in held.items()) >= 0.95 * len(held)
    assert quality.quality(docs(spark, ODD), labels.where("false")).where("score = 0.5").count() == len(ODD)
    model = quality.train(docs(spark, rows), labels)
    assert quality.keep_good(docs(spark, rows), labels).columns == docs(spark, rows).columns and model["theta"].shape[0] == 3 * quality.BASE + 5


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(3)
    counts = np.array([1, 4, 3])
    unary, stay = rng.normal(size=8), rng.normal(size=(2, 2))
    marginal, pairs, log_z = quality.forward_backward(unary, stay, counts)
    want, at, total = [], 0, 0.0
    for n in counts:
        paths = [[k >> i & 1 for i in range(n)] for k in range(2**n)]
        weight = np.array([np.exp(sum(unary[at + i] * p[i] for i in range(n)) + sum(stay[p[i], p[i + 1]] for i in range(n - 1))) for p in paths])
        want += [float(sum(w for w, p in zip(weight, paths) if p[i]) / weight.sum()) for i in range(n)]
        total += np.log(weight.sum())
        at += n
    assert np.allclose(marginal, want) and np.isclose(log_z, total) and np.isclose(pairs.sum(), (counts - 1).sum())


# ---- 3 and 8 tokenizers

SAMPLES = ["", "  ", "Hello <|endoftext|> wÖrld</w>  don't 12ab é́ ½ <|startoftext|>x", "a\x1cb", "İstanbul ΑΣ ΑΣΑ", "日本語" * 60, "x" * 3000, "it's we'll'll 'D", "<|endoftext|><|endoftext|> a", "a  b   c \n d\n\n  e ", "a ", "\n"]


def test_encoding_matches_the_library(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, ours, rng = Tokenizer.from_file(path), bpe.load(path), random.Random(2)
    samples = SAMPLES + ["".join(rng.choice("abé ñ.,'!1²Ⅷ\n\t\xa0漢") for _ in range(200)) for _ in range(100)] + ["".join(rng.choice("abcdefgh") for _ in range(2000))]
    for s in samples:
        ids = t.encode(s, add_special_tokens=False).ids
        text, decoded = ours.encode_text(s)
        assert text == " ".join(map(str, ids)) and decoded == t.decode(ids, skip_special_tokens=False) == ours.decode(ids)
    rows = bpe.encode_documents(docs(spark, ODD), path)
    assert rows.count() == len(ODD) and rows.where("doc_id = 1").first()["ids_sha256"] == hashlib.sha256(b"").hexdigest()


def test_long_texts_are_encoded_as_rows(spark, monkeypatch):
    from tokenizers import Tokenizer

    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(41)
    t = Tokenizer.from_file(path)
    piece = lambda n: "".join(rng.choice("abcdefghijklmnop") for _ in range(n))
    texts = [" ".join(piece(rng.choice([3, 8, 900])) for _ in range(60)), piece(5000), piece(64 * 16), piece(640) + "<|endoftext|>" + "é" * 700 + " 12 x\u0558 " + "日" * 300, " " * 900, piece(5000) + " end", "short", None]
    texts.append(texts[1])
    monkeypatch.setattr(bpe, "LONG_TEXT", 500)
    monkeypatch.setattr(bpe, "PART", 64)
    got = {r["doc_id"]: tuple(r)[1:] for r in bpe.encode_documents(docs(spark, [(i, x, "en", None) for i, x in enumerate(texts)]), path).collect()}
    for i, x in enumerate(texts):
        ids = t.encode(x or "", add_special_tokens=False).ids
        sha = lambda v: hashlib.sha256(v.encode()).hexdigest()
        assert got[i] == (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))), i


def test_every_code_point_is_encoded_as_by_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, ours = Tokenizer.from_file(path), bpe.load(path)
    points = [chr(n) for n in [*range(1, 0x3400), *range(0xA000, 0xAC10), *range(0xD7A0, 0xD800), *range(0xF900, 0x20000), *range(0x3400, 0x110000, 1009), *range(0xE0000, 0xE0200)] if not 0xD800 <= n < 0xE000]
    for at in range(0, len(points), 200):
        text = "\n".join(f"a{c}b1{c} {c}{c} e{c}\u0301{c}" for c in points[at : at + 200])
        assert ours.encode(text) == t.encode(text, add_special_tokens=False).ids, hex(ord(points[at]))


def test_packing_covers_every_id_once(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    from tokenizers import Tokenizer

    t, ours = Tokenizer.from_file(path), packing.load(path)
    for s in SAMPLES:
        assert ours.encode(s) == np.array(t.encode(s, add_special_tokens=False).ids, "<u4").tobytes()
    rows = [r for r in texts] + [(5000 + i, prose(random.Random(i), 900), "en", None) for i in range(30)] + [(7000, None, None, None)]
    got = packing.pack_documents(docs(spark, rows), path).collect()
    sequences, pieces = {}, {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    for spans in pieces.values():
        at = 0
        for start, n, total in sorted(spans):
            assert start == at and n > 0
            at += n
        assert at == total
    for spans in sequences.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= packing.WINDOW
    assert set(pieces) == {r[0] for r in rows}
    assert packing.pack_documents(docs(spark, rows).where("false"), path).count() == 0


def test_cuts_are_optimal():
    rng = random.Random(4)
    for _ in range(50):
        at = sorted(rng.sample(range(1, 60), 12))
        positions, penalties = [0, *at, 60], [0.0, *(rng.choice([0.0, 2.0, 5.0]) for _ in at), 0.0]
        window = max(b - a for a, b in zip(positions, positions[1:])) + 8
        window += window % 4 and 4 - window % 4
        cost = [0.0] + [1e9] * (len(positions) - 1)
        for i in range(1, len(positions)):
            for j in range(i):
                n = positions[i] - positions[j]
                if n <= window:
                    pad = 0 if n in (window // 2, window // 4) else window - n
                    cost[i] = min(cost[i], cost[j] + pad + penalties[i])
        cuts = packing.best_cuts(positions, penalties, window)
        total = sum((0 if positions[b] - positions[a] in (window // 2, window // 4) else window - positions[b] + positions[a]) + penalties[b] for a, b in zip(cuts, cuts[1:]))
        assert cuts[0] == 0 and cuts[-1] == len(positions) - 1 and np.isclose(total, cost[-1])


# ---- 4 pages, 9 urls

PAGE = "<html><head><title>t</title></head><body><nav><li>menu</nav><div class=ad>buy</div>{}<div id=comments><p>me too</div><aside>side</aside><form>f</form><script>x</script><footer>f</footer></body></html>"


def test_extraction(spark):
    story = "<div class='post-17'><h2>T &amp; U</h2><p>One <b>bold</b>&nbsp;word<br>more<p>Two</div>"
    pages = [(1, "http://a.com/1", PAGE.format(story)), (2, "http://a.com/2", PAGE.format(story.replace("17", "3"))), (3, None, None), (4, "x", ""), (5, "http://b.com", "plain &lt;text&gt;"), (5, "http://b.com", "plain &lt;text&gt;")]
    df = spark.createDataFrame([(*p, "k") for p in pages], "page_id long, url string, html string, host string")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html.extract_pages(df).orderBy("page_id").collect()]
    want = "T & U\nOne bold word more\nTwo"
    assert got == [(1, want, len(want)), (2, want, len(want)), (3, "", 0), (4, "", 0), (5, "plain <text>", 12), (5, "plain <text>", 12)]
    assert html.extract_pages(df.where("false")).count() == 0


@pytest.mark.parametrize("tag", ["article", "main", "div role=main"])
def test_nested_content_keeps_the_whole_article(spark, tag):
    body = "".join(f"<p>{'long body text ' * 20}{i}</p>" for i in range(3))
    flat = f"<{tag}><h1>Title</h1><p>Lead</p><div class=content>{body}</div><section class=more><p>Rest</p></section><div class=share>tweet</div></{tag.split()[0]}>"
    deep = f"<{tag}><h1>Title</h1><div class=outer><div class=inner>{body}</div></div><div class=other><p>Rest</p></div></{tag.split()[0]}>"
    df = spark.createDataFrame([(i, f"http://{'ab'[i % 2]}.com/{i}", PAGE.format([flat, deep][i % 2])) for i in range(4)], "page_id long, url string, html string")
    lines = [f"{'long body text ' * 20}{i}" for i in range(3)]
    got = {r["page_id"]: r["text"].split("\n") for r in html.extract_pages(df).collect()}
    assert got[0] == got[2] == ["Title", "Lead", *lines, "Rest"] and got[1] == got[3] == ["Title", *lines, "Rest"]


def test_text_beside_the_article_and_paragraphs_named_like_site_parts_stay(spark):
    long = "long body text of the story " * 15
    page = PAGE.format(f"<div class=a1><h1>Title</h1></div><div class=b2><p>{long}</p><p id='related-work'>Related work</p><p class='advert'>buy</p><p class='social-history ad'>gone</p></div><div class=c3><p>The end</p></div><div><a href=x>only links</a></div>")
    df = spark.createDataFrame([(i, f"http://a.com/{i}", page) for i in range(3)], "page_id long, url string, html string")
    assert {r["text"] for r in html.extract_pages(df).collect()} == {"\n".join(["Title", long.strip(), "Related work", "The end"])}


def brute_extract(pages, path_of=lambda page: page.path):
    """The consensus by definition, over one page at a time and plain sums."""
    parsed = [(url.split("://", 1)[1].split("/")[0] if url and "://" in url else "", html.Page(source or "")) for url, source in pages]
    votes = {}
    for host, page in parsed:
        found = page.scores()
        for path, value in found.items():
            votes.setdefault(host, {}).setdefault(path, []).append(value / sum(found.values()))
    out = []
    for host, page in parsed:
        total = {p: round(sum(v), 6) for p, v in votes.get(host, {}).items()}
        ranked = sorted((p for p in total if total[p] >= 0.01 * sum(total.values())), key=lambda p: (-total[p], p))
        out.append(next((t for t in (page.text(p) for p in [*ranked, page.best()]) if t is not None), ""))
    return out


def test_the_hosts_vote_changes_a_page(spark):
    story = lambda n: f"<div class=story><p>{'the text of the story ' * n}</p></div>"
    aside = lambda n: f"<section><div class=extra><p>{'something else altogether ' * n}</p></div></section>"
    rows = [(i, f"http://h.com/{i}", f"<html><body><section>{story(20)}</section>{aside(2)}</body></html>") for i in range(8)] + [(9, "http://h.com/9", f"<html><body><section>{story(5)}</section>{aside(30)}</body></html>"), (10, "http://other.com/", f"<html><body><section>{story(5)}</section>{aside(30)}</body></html>")]
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9].startswith("the text") and "something" not in got[9] and got[10].startswith("something")
    assert [got[i] for i, *_ in rows] == brute_extract([r[1:] for r in rows])


@pytest.mark.parametrize("source", ["<b" * 1_000_000, '<a "' * 500_000, '<a ">" ' * 100_000, "<div class=x>" * 20_000 + "t" + "</div>" * 20_000, "<i x>" + "<b x>" * 30_000 + "</i>" * 30_000, "<!--" * 100_000, "<script>" * 50_000])
def test_long_and_broken_pages_take_linear_time(source):
    import time

    start = time.time()
    html.extract(source, None)
    assert time.time() - start < 10


def test_salted_path_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"http://h{i % 3}.com/{i}", PAGE.format(f"<article><p>text {i}</article>")) for i in range(9)], "page_id long, url string, html string")
    plain = sorted(map(tuple, html.extract_pages(df).collect()))
    monkeypatch.setattr(html, "BROADCAST_HOSTS", 0)
    assert sorted(map(tuple, html.extract_pages(df).collect())) == plain


def test_urls(spark):
    urls = ["http://x.NET/a", "https://www.example.net/en/1", "https://example.net/de/1", "http://a.example.com/de/?q", "http://a.example.com/en/", "http://w.org/fr/x#t", "http://w.org/en", None, "no scheme", "http://net"]
    df = spark.createDataFrame([(i, u, None, "h") for i, u in enumerate(urls)], "page_id long, url string, html string, host string")
    got = {r["page_id"]: tuple(r)[1:] for r in urlfilter.judge_urls(df).collect()}
    assert got[0] == ("x.net", "/a", "net/", "block") and got[1] == ("www.example.net", "/en/1", "example.net/en/", "allow") and got[2][2:] == ("net/", "block")
    assert got[3] == ("a.example.com", "/de/", "example.com/de/", "block") and got[4][2:] == (None, "allow") and got[5][2:] == ("org/fr/", "allow")
    assert got[7] == ("", "", None, "allow") == got[8] and got[9] == ("net", "", None, "block")


def test_link_graph_matches_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    link = lambda *hosts: "".join(f"<a href='http://{h}/x'>l</a>" for h in hosts)
    rows = [(1, "http://bad.net/1", link("mid.com")), (2, "http://spam.com/1", link("bad.net")), (3, "http://good.org/fr/1", link("mid.com", "fine.com")), (4, "http://mid.com/1", ""), (5, "http://fine.com/", link("good.org")), (6, "http://far.com/", link("spam.com", "spam.com"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(tuple, urlfilter.judge_urls(df).select("page_id", "host", "path", "rule", "verdict").collect()))
    assert {r[0]: r[4] for r in got}[2] == "block" and {r[0]: r[4] for r in got}[4] == "allow"
    con = duckdb.connect()
    con.register("pages", pa.Table.from_pylist([dict(zip(("page_id", "url", "html"), r)) for r in rows]))
    assert sorted(con.execute(urlfilter.judge_sql()).fetchall()) == got


def hrefs(*urls):
    return "".join(f"<a href='http://{u}'>l</a>" for u in urls)


def verdicts(spark, rows):
    return {r["page_id"]: r["verdict"] for r in urlfilter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_distrust_runs_down_long_chains(spark):
    rows = [(0, "http://bad.net/", "")] + [(k, f"http://h{k}.com/", hrefs("bad.net/" if k == 1 else f"h{k - 1}.com/")) for k in range(1, 31)]
    got = verdicts(spark, rows)
    assert [k for k in range(1, 31) if got[k] == "block"] == [k for k in range(1, 31) if 0.85**k >= 0.02]


def test_link_targets_and_blocked_paths_are_seeds(spark):
    rows = [(1, "http://one.com/", hrefs("unseen.net/x")), (2, "http://two.com/", hrefs("example.com/de/7")), (3, "http://example.com/", ""), (4, "http://example.com/en/", hrefs("example.com/de/7")),
            (5, "http://four.com/", hrefs("example.com/en/")), (6, "http://five.com/", hrefs("UNSEEN.net?q=/fr/"))]
    assert verdicts(spark, rows) == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block"}


def test_links_decide_among_subdomains_with_mixed_pages(spark):
    """Hosts like the tables': subdomains of a few domains, some with pages that rules allow and pages that rules block."""
    two = lambda *u: "".join(f"<a href='//{x}'>l</a><a href='/the'>own</a>" for x in u)
    rows = [(1, "http://m.mixed.example.net/en/1", ""), (2, "http://m.mixed.example.net/de/1", ""), (3, "http://www.spam.example.com/en/1", two("m.mixed.example.net/de/1")), (4, "http://www.spam.example.com/de/2", ""),
            (5, "http://blog.farm.example.org/de/1", two("www.spam.example.com/en/1", "www.spam.example.com/fr/2")), (6, "http://good.example.org/fr/1", two("friend.example.com/en/1")), (7, "http://friend.example.com/en/1", two("m.mixed.example.net/en/1")),
            (8, "http://plain.example.com/en/1", two("nobody.example.com/en/1")), (9, "http://plain.example.com/de/1", "")]
    assert verdicts(spark, rows) == {1: "allow", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "allow", 8: "allow", 9: "block"}
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.register("pages", pa.Table.from_pylist([dict(zip(("page_id", "url", "html"), r)) for r in rows]))
    assert {r[0]: r[4] for r in con.execute(urlfilter.judge_sql()).fetchall()} == verdicts(spark, rows)


# ---- 5 embeddings, 6 SimHash


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 8))
    near = lattice.nearest_e8(x)
    assert np.allclose((near * 2) % 1, 0) and len(lattice.NEIGHBOURS) == 240 and np.allclose((lattice.NEIGHBOURS**2).sum(1), 2)
    own = ((x - near) ** 2).sum(1)
    assert all(own[k] <= ((x[k] - (near[k] + lattice.NEIGHBOURS)) ** 2).sum(1).min() + 1e-9 for k in range(200))


@pytest.mark.parametrize("dimension", [2, 4, 8, 16, 64, 384, 1024])
def test_lattice_recall_at_every_dimension(dimension):
    rng = np.random.default_rng(dimension)
    for cosine in (0.9, 0.92):
        x, g = rng.normal(size=(2, 400, dimension))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        g -= (g * x).sum(1, keepdims=True) * x
        y = cosine * x + np.sqrt(1 - cosine**2) * g / np.linalg.norm(g, axis=1, keepdims=True)
        assert np.mean([len(np.intersect1d(a, b)) > 0 for a, b in zip(lattice.cells(x), lattice.cells(y))]) >= 0.9


def test_embedding_links(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 64))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(base)] + [(100 + i, (v + 0.15 * rng.normal(size=64)).tolist(), 0) for i, v in enumerate(base)] + [(200, base[0].tolist(), 0), (201, (2 * base[0]).tolist(), 0)]
    odd = [(300, None, 0), (301, [], 0), (302, [0.0] * 64, 0), (303, [float("nan")] * 64, 0), (304, [None] * 64, 0), (305, [1.0, 2.0], 0), (306, [1.0, 2.0], 0), (306, [1.0, 2.0], 0)]
    got = lattice.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")).collect()
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = ((x @ x.T) >= 0.9).sum(1) - 1
    found = {r["vec_id"]: r for r in got}
    assert len(got) == len(rows) + len(odd) and all(found[r[0]]["n_links"] <= t for r, t in zip(rows, true))
    assert sum(found[r[0]]["n_links"] for r in rows) >= 0.9 * true.sum()
    assert found[200]["component_id"] == 0 and not found[200]["kept"] and found[305]["n_links"] == 2 and found[302]["kept"] and found[300]["n_links"] == 0


def test_simhash_fingerprint_by_definition():
    xxhash = pytest.importorskip("xxhash")
    text = "The QUICK brown\tfox jumps\nover the quick brown fox"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text) == want and simhash.fingerprint(None) == 0 == simhash.fingerprint(" \n")
    assert simhash.fingerprint("Two words") == xxhash.xxh64_intdigest("two words", 42)


def test_bit_sliced_links_are_all_links():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (1500, 2)).astype(np.uint64)
    fp = np.unique(np.concatenate([base[rng.integers(0, 30, 1500)] ^ flips[:, 0] ^ flips[:, 1], base]))
    want = {(i, int(j)) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp ^ fp[i]) <= 2) if j > i}
    got = set()
    for blocks in simhash.TABLES:
        key = fp & np.uint64(simhash.key_mask(blocks))
        order = np.lexsort((fp, key))
        rest = ((fp[order] >> np.uint64(8 * blocks[0])) & np.uint64(255)) | (((fp[order] >> np.uint64(8 * blocks[1])) & np.uint64(255)) << np.uint64(8))
        for a, b in simhash.bucket_links(key[order], lambda rows, rest=rest: simhash.bit_planes(rest[rows].astype(np.uint16), 16)):
            got |= {(min(x, y), max(x, y)) for x, y in zip(order[a].tolist(), order[b].tolist())}
    assert got == want


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 7, 34])
def test_carry_save_counters_count(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 2, dtype=np.uint64)
    records = np.zeros(150, simhash.WIDE)
    for k in range(150):
        flips = np.packbits(rng.random(128) < rng.choice([0, 0.02, 0.1, 0.2])).view("<u8")
        records["low"][k], records["high"][k] = base[0] ^ flips[0], base[1] ^ flips[1]
    apart = lambda i, j: sum(int(records[n][i] ^ records[n][j]).bit_count() for n in ("low", "high"))
    key = np.repeat(np.arange(3, dtype=np.uint64), [1, 100, 49])
    got = {(int(i), int(j)) for a, b in simhash.bucket_links(key, lambda rows: simhash.wide_planes(records[rows]), radius) for i, j in zip(a, b)}
    assert got == {(i, j) for i in range(150) for j in range(i + 1, 150) if key[i] == key[j] and apart(i, j) <= radius}


def test_simhash_classes(spark):
    rng = random.Random(9)
    texts = [prose(rng, 80) for _ in range(20)]
    rows = [(50 + i, t, "en", None) for i, t in enumerate(texts)] + [(100 + i, t.upper(), "en", None) for i, t in enumerate(texts)] + [(200 + i, t + " end", "en", None) for i, t in enumerate(texts)]
    got = simhash.near_duplicates(docs(spark, rows + ODD)).collect()
    prints = {r["doc_id"]: int(r["fingerprint"], 16) for r in got if r["doc_id"] is not None}
    parent = {i: i for i in prints}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    assert len(got) == len(rows) + len(ODD) and all(r["component_id"] == find(r["doc_id"]) for r in got if r["doc_id"] is not None)


def test_null_and_repeated_ids_lose_no_other_text(spark):
    rng = random.Random(21)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80)) for _ in range(6)]
    rows = [(None, texts[0], "en", None), (None, texts[1], "en", None), (7, texts[2], "en", None), (7, texts[3], "en", None), (7, texts[3], "en", None), (8, texts[4], "en", None), (None, texts[4], "en", None)]
    got = [(r["doc_id"], r["text"]) for r in simhash.keep_first(docs(spark, rows)).collect()]
    want = [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[4])]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def shingle_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("waves", [False, True])
def test_near_stage_keeps_one_of_each_class_at_eight_tenths(spark, monkeypatch, waves):
    import corpus_pipeline

    if waves:
        monkeypatch.setattr(shingles, "WAVE_PAIRS", 100)
    rng = random.Random(15)
    word = lambda: "w%d" % rng.randrange(5000)
    passage, rows, planted = " ".join(word() for _ in range(60)), [], 0
    for i in range(40):
        words = [word() for _ in range(rng.choice([60, 150, 400]))] + (passage.split() if i % 3 == 0 else [])
        rows.append((i, " ".join(words), "en", None))
        for k in range(5):
            copy = list(words)
            for _ in range(rng.randint(1, max(1, len(words) // 45))):
                copy[rng.randrange(len(copy))] = word()
            rows.append((1000 + 10 * i + k, " ".join(copy), "en", None))
    rows += ODD
    keys = sorted({(i is None, i or 0, t or "") for i, t, *_ in rows})
    sets = [shingle_set(t) for *_, t in keys]
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(keys)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                planted += 0.8 <= len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) < 0.95
                root[y] = x
    assert planted >= 50
    got = corpus_pipeline.near_stage(spark, docs(spark, rows), "")
    assert got.columns == docs(spark, rows).columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in got.collect()) == [keys[i] for i in sorted({find(i) for i in range(len(keys))})]


# ---- 7 lines


def brute_lines(rows):
    seen, out = [], {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        gone = []
        for n, line in enumerate((t or "").split("\n")):
            s = set(line.encode().split())
            if s:
                if any(5 * len(s & o) >= 4 * len(s | o) for o in seen):
                    gone.append(n)
                seen.append(s)
        out[i] = gone
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_line_join_matches_brute_force(spark, monkeypatch, hot):
    if hot:
        monkeypatch.setattr(lines, "SAMPLE_SHARE", 1)
        monkeypatch.setattr(lines, "BLOCK", 10)
        monkeypatch.setattr(lines, "BATCH_BYTES", 3000)
        monkeypatch.setattr(lines, "WAVE_PAIRS", 10)
    rng = random.Random(3)
    vocabulary = ["w%d" % int(rng.paretovariate(0.7)) for _ in range(2000)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 40))) for _ in range(25)]

    def edit(line):
        words = line.split()
        for _ in range(rng.randint(0, max(1, len(words) // 6))):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        return " ".join(words)

    rows = [(i, "\n".join(rng.choice([edit(rng.choice(base)), rng.choice(base), " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 8))), ""]) for _ in range(rng.randint(1, 6))), "en", None) for i in range(250)]
    rows += [(1000, None, None, None), (1001, "", None, None)]
    got = {r["doc_id"]: list(r["removed"]) for r in lines.line_counts(docs(spark, rows)).collect()}
    assert got == brute_lines([r[:2] for r in rows])
    if not hot:
        cleaned = {r["doc_id"]: r["text"] for r in lines.remove_lines(docs(spark, rows)).collect()}
        assert all(cleaned[i] == "\n".join(s for n, s in enumerate(t.split("\n")) if n not in got[i]) for i, t, *_ in rows if t and got[i])


def test_words_have_one_hash_wherever_they_stand():
    rng = random.Random(5)
    words = list({bytes(rng.choice(b"ab\0\xc3\xa9") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 63, 64, 65, 72, 300]))) for _ in range(600)})
    words += [b"a" * n for n in range(1, 90)] + [b"a\0" * n for n in range(1, 45)] + [b"\0", b"\0\0", b"\0" * 8, b"\0" * 9]
    words = sorted(set(words))
    texts = []
    for _ in range(20):
        rng.shuffle(words)
        texts.append(rng.choice([b"", b" \t", b"\n"]) + b"".join(w + rng.choice([b" ", b"\t\x0b", b"\r\n", b"\n\n"]) for w in words))
    text_of, line_no, line, word = lines.line_words(texts)
    want = [(k, n, w) for k, t in enumerate(texts) for n, part in enumerate(t.split(b"\n")) for w in part.split()]
    assert [(text_of[i], line_no[i]) for i in line] == [w[:2] for w in want]
    known = {}
    assert all(known.setdefault(w[2], h) == h for w, h in zip(want, word.tolist())) and len(set(known.values())) == len(words)


def test_workers_collect_what_they_loaded_once(spark):
    def run(batches):
        import gc

        for _ in batches:
            common.trim()
        yield pa.RecordBatch.from_arrays([pa.array([gc.get_freeze_count()])], names=["id"])

    assert spark.range(0, 1, 1, 1).mapInArrow(run, "id long").agg(F.max("id")).first()[0] > 10_000
    assert common.SETTLED is False  # the driver's own objects are collected as ever


def test_only_texts_with_candidates_are_dealt(spark):
    rows = docs(spark, [(i, f"text {i}", "en", None) for i in range(2000)]).selectExpr("doc_id __key", "text")
    pairs = np.zeros(3, lines.PAIR)
    pairs["doc"], pairs["to_doc"] = [700, 701, 1999], [0, 700, 5]
    blobs = spark.createDataFrame([(0, bytearray(lines.pack(pairs[:2]))), (1, bytearray(lines.pack(pairs[2:])))], lines.BLOBS)
    dealt = lines.beside(blobs, rows, lines.asked_documents(blobs)).where("kind = 1").collect()
    got = {k for r in dealt for k in pa.ipc.open_stream(r["blob"]).read_all().column(0).to_pylist()}
    assert got >= {0, 5, 700, 701, 1999} and len(got) < 20


def test_line_join_in_odd_rows(spark):
    got = lines.line_counts(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and {r["doc_id"]: r["n_removed"] for r in got}[5] == 2999
    assert lines.line_counts(docs(spark, ODD).where("false")).count() == 0


# ---- 10 fingerprints


def test_parsing_is_local_and_independent_of_the_batch():
    rng = random.Random(8)
    texts = [prose(rng, 200) for _ in range(8)] + ["", "a", "aaaa" * 50, "ab" * 200]
    together = lcp.parse(texts)
    assert all(np.array_equal(t, lcp.parse([s])[0]) for t, s in zip(together, texts))
    moved = lcp.parse(["some other start " + texts[0][40:]])[0]
    assert len(np.intersect1d(moved, together[0])) > 0.7 * len(together[0])


def test_fingerprints_match_the_definition(spark, texts):
    rows = texts + [(10_000, None, None, None), (10_001, "é" * 50, "fr", None)]
    got = {r["doc_id"]: r for r in lcp.fingerprint_documents(docs(spark, rows)).collect()}
    order = sorted((r[0] for r in rows), reverse=True)
    text = {r[0]: r[1] or "" for r in rows}
    for k, i in enumerate(order):
        following = text[order[(k + 1) % len(order)]]
        edited = lcp.edited(text[i], following)
        r = got[i]
        assert r["n_chars"] == len(text[i]) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == lcp.sketch(lcp.parse([text[i]])[0]) and r["edited_fingerprint"] == lcp.sketch(lcp.parse([edited])[0])
        assert 0 <= r["near_edited"] <= 1 and r["near_next"] == lcp.likeness(r["fingerprint"], lcp.sketch(lcp.parse([following])[0]))
    assert lcp.fingerprint_documents(docs(spark, ODD)).count() == len(ODD)
    assert lcp.fingerprint_documents(docs(spark, ODD).where("false")).count() == 0


M64 = (1 << 64) - 1


def plain_mix(x):
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & M64
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & M64
    return x ^ x >> 33


def plain_level(names):
    """One level of locally consistent parsing, name by name."""
    runs = []
    for x in names:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    names = [x if n == 1 else plain_mix((x + plain_mix(n)) & M64) for x, n in runs]
    labels, bits = names, 64
    while bits > 3:
        new = []
        for i, x in enumerate(labels):
            left = labels[i - 1] if i else x ^ 1
            place = ((x ^ left) & -(x ^ left)).bit_length() - 1 if x != left else 64
            new.append(place << 1 | (x >> place & 1 if place < 64 else 0))
        labels, bits = new, max(3, (2 * bits - 1).bit_length())
    starts = [0]
    tops = [0 < i < len(names) - 1 and labels[i] > labels[i - 1] and labels[i] >= labels[i + 1] for i in range(len(names))]
    marked = [i == 0 or t for i, t in enumerate(tops)]
    starts += [i for i in range(1, len(names)) if marked[i] and not marked[i - 1]]
    out = []
    for a, b in zip(starts, [*starts[1:], len(names)]):
        total = sum(plain_mix((x + k * 0x9E3779B97F4A7C15) & M64) for k, x in enumerate(names[a:b]))
        out.append(plain_mix(total & M64))
    return out


def plain_print(text):
    if not text:
        return ""
    names, found, level, short = [plain_mix(ord(c) + 1) for c in text], set(), 0, False
    while level == 0 or len(names) > 1:
        names = plain_level(names)
        level += 1
        short = len(names) < 64 if level == 1 else short
        if level >= 2 or short:
            found |= {plain_mix(x ^ level) >> 20 for x in names}
    return "".join(f"{x:011x}" for x in sorted(found)[:64])


def test_fingerprints_match_a_plain_parser():
    rng = random.Random(31)
    texts = ["", "a", "ab", "aaaa" * 50, "ab" * 200, "é\U0001F600x", "x" * 5000] + [prose(rng, n) for n in (1, 3, 20, 90, 400, 1500)]
    assert [lcp.sketch(x) for x in lcp.parse(texts)] == [plain_print(t) for t in texts]


def test_fingerprints_of_many_empty_texts():
    assert lcp.sketch(lcp.parse([""] * (2**20 + 1) + ["some text"])[-1]) == plain_print("some text")


# ---- shared pieces


def test_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(50)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r["node"]: r["component"] for r in common.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {i: i for p in pairs for i in p}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got == {i: find(i) for p in pairs if p[0] != p[1] for i in p}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_slots_meet_their_partition(spark):
    assert common.hash_of_int(np.arange(200)).tolist() == [r[0] for r in spark.range(200).select(F.hash(F.col("id").cast("int"))).collect()]
    rows = common.deal_slots(spark.range(20).select(F.col("id").cast("int").alias("slot"))).select("slot", F.spark_partition_id().alias("p")).collect()
    assert all(r["p"] == r["slot"] % common.shuffle_width(spark) for r in rows)
    records = np.arange(12, dtype=np.int64)
    assert common.unpack(common.pack(records)) == records.tobytes()


def test_pipeline(spark, texts, tmp_path):
    import corpus_pipeline

    rng = random.Random(12)
    rows = [(i, "\n".join(prose(rng, 25).capitalize() + "." for _ in range(6)), "en", "s", 0) for i in range(80)]
    rows += [(100 + i, rows[i][1], "en", "s", 0) for i in range(20)] + [(200 + i, " ".join(w.upper() + "!!" for w in prose(rng, 120).split()), "en", "s", 0) for i in range(40)] + [(None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(80)] + [(200 + i, 0, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs_now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs_now, str(tmp_path))
        assert name == "packing" or out.columns == docs_now.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs_now = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"] for r in docs_now.select("doc_id").collect()}
    assert {i for i in range(80)} <= seen["quality"] and not seen["quality"] & set(range(200, 240))
    assert {i for i in range(80)} <= seen["near_dedup"] and len(seen["near_dedup"] & set(range(100, 120))) <= 1
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs_now.count()


def test_pipeline_matches_brute_force_stage_by_stage(spark, tmp_path):
    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(77)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    line = lambda n: (" ".join(rng.choice(vocabulary) for _ in range(n)) + ".").capitalize()
    passage = line(70)
    texts = ["\n".join([line(rng.randint(8, 40)) for _ in range(rng.randint(1, 6))] + ([passage + " " + line(9)] if i % 9 == 0 else [])) for i in range(70)]
    texts += [t.replace("\n", " ").replace(t.split()[3], "other", 1) for t in texts[:12]] + [t.split("\n")[0] + "\n" + line(20) for t in texts[12:20]] + texts[20:24]
    texts += [" ".join(w.upper() + "!!" for w in line(100).split()) for _ in range(30)] + ["", None, "  \n ", "short"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    good = {i: int(not (t or "").isupper() and "!!" not in (t or "")) for i, t in enumerate(texts)}
    spark.createDataFrame([(i, good[i], 0) for i in range(0, 120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    model = quality.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    now = {i: t for i, t in enumerate(texts) if quality.score_texts(model, [t or ""])[0] >= 0.7}
    assert 80 <= len(now) < len(texts)
    want = {"quality": dict(now)}
    gone = brute_lines(list(now.items()))
    now = {i: t if not gone[i] else "\n".join(s for n, s in enumerate(t.split("\n")) if n not in gone[i]) for i, t in now.items()}
    want["line_dedup"] = dict(now)
    keys, sets = sorted(now), {i: shingle_set(t) for i, t in now.items()}
    root = {i: i for i in keys}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in keys:
        for b in keys:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    now = {i: now[i] for i in keys if find(i) == i}
    want["near_dedup"] = dict(now)
    kept = {}
    found = brute_repeats(list(now.items()), kept)
    want["suffix_dedup"] = {i: kept[i] if found[i][1] else t for i, t in now.items()}
    assert len(want["near_dedup"]) < len(want["line_dedup"]) and any(want["line_dedup"][i] != texts[i] for i in want["line_dedup"]) and any(found[i][1] for i in found)

    docs_now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs_now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs_now = spark.read.parquet(f"{tmp_path}/{name}")
        got = docs_now.collect()
        assert {r["doc_id"]: r["text"] for r in got} == want[name] and len(got) == len(want[name]), name
        assert all(r["n_chars"] == len(r["text"] or "") and r["lang"] == "en" for r in got)
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    packed = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["length"]
    assert packed == {i: len(t.encode(x or "", add_special_tokens=False).ids) + 1 for i, x in want["suffix_dedup"].items()}


def test_line_records_meet_as_in_a_plain_search():
    import random

    import numpy as np

    from flatewise.llm import lines

    rng = random.Random(21)
    words = [f"w{k}" for k in range(60)]
    base = [rng.sample(words, 12) for _ in range(8)]
    line = lambda: " ".join([*rng.choice(base)[rng.randint(0, 1) :], rng.choice(words)])
    for far in (1, 1 << 40):  # with and without room for item, document and line in one number
        texts = [(k * far - 9, 0, "\n".join(line() for _ in range(6)).encode()) for k in range(40)]
        raw = lines.Sets(texts, np.zeros(lines.BUCKETS, np.uint8)).prefixes()
        records, place, size = lines.distinct_records(raw[np.random.default_rng(1).permutation(len(raw))])
        item = np.repeat(np.arange(len(size)), size)
        assert (lines.by_line(item, records["doc"], records["line"]) == np.arange(len(records))).all() and size.min() > 1
        want = []
        for y in range(len(records)):
            for x in range(y - place[y], y):
                a, b = (int(records["size"][k]) for k in (x, y))
                apart = sum(int(records[n][x] ^ records[n][y]).bit_count() for n in ("even", "odd"))
                if 4 * max(a, b) <= 5 * min(a, b) and min(a - int(records["place"][x]), b - int(records["place"][y])) >= lines.need(a, b) and apart <= a + b - 2 * lines.need(a, b):
                    want.append((y, x))
        got, _ = lines.offers(records, place, np.ones(len(records), bool))
        key = lambda k: (int(records["doc"][k]), int(records["line"][k]))
        assert want and sorted((int(r["doc"]), int(r["line"]), int(r["to_doc"]), int(r["to_line"])) for r in got) == sorted((*key(y), *key(x)) for y, x in want)
