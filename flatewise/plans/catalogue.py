"""The engine's queries over the driver's tables, each with its SQL equivalent where SQL can express it.

Stand-ins: `documents` are source files (bytes of text, kind lang), `lineitem` by order are archives with entries (size
l_extendedprice, label l_returnflag with N as unknown), `embeddings` are feature vectors, `labels` the truth,
`conversations` token sequences, `events` an analysis stream.  Doubles are rounded so that engines agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flatewise.functions import features, rules, udtf
from flatewise.functions import stats as S
from flatewise.operators import covert, decisions, encoders, inflate, rewrite, streams
from flatewise.plans import assess as A
from flatewise.plans import evaluation as E
from flatewise.plans import proofs
from flatewise.plans import verdict as V
from flatewise.sources import containers

REGISTRY: dict[str, tuple] = {}


def query(sql: str | None = None):
    def add(function):
        REGISTRY[function.__name__] = (function, sql)
        return function

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def sources(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang", "source", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal rows over the cores before a Python kernel: a single file gives one or two splits."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, key)


def compressed(spark, sf, *settings) -> DataFrame:
    return streams.compress(spread(sources(spark, sf), "doc_id"), list(settings) or [("zlib", "6")])


def archives(spark, sf) -> DataFrame:
    """Entries of stand-in archives."""
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").cast("string").alias("name"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("size"), F.col("l_returnflag").alias("label"),
                     F.when(F.col("l_returnflag") == "N", "unknown").otherwise("attributed").alias("status"), (F.lit(1) - F.col("l_discount")).alias("confidence"), F.col("l_linestatus").alias("setting"),
                     F.when(F.col("l_quantity") > 45, "stored").when(F.col("l_quantity") > 40, "flush").otherwise("data").alias("ending"), F.lit(8).alias("n_matches"), F.col("l_quantity").alias("quantity"))


ARCHIVES = """e AS (SELECT l_orderkey AS path, l_linenumber::VARCHAR AS name, round(l_extendedprice * 100)::BIGINT AS size, l_returnflag AS label,
  CASE WHEN l_returnflag = 'N' THEN 'unknown' ELSE 'attributed' END AS status, 1 - l_discount AS confidence, l_linestatus AS setting,
  CASE WHEN l_quantity > 45 THEN 'stored' WHEN l_quantity > 40 THEN 'flush' ELSE 'data' END AS ending FROM lineitem)"""
VOTES = ARCHIVES + """,
v AS (SELECT path, CASE WHEN status = 'attributed' THEN label ELSE 'unknown' END AS vote, count(*) AS n, sum(size) AS b FROM e GROUP BY ALL),
s AS (SELECT path, vote, b / sum(b) OVER (PARTITION BY path) AS share, n / sum(n) OVER (PARTITION BY path) AS cshare FROM v),
k AS (SELECT path, vote, share, row_number() OVER (PARTITION BY path ORDER BY share DESC, vote) AS r FROM s WHERE vote <> 'unknown'),
u AS (SELECT path, coalesce(max(CASE WHEN vote = 'unknown' THEN share END), 0) AS us, coalesce(max(CASE WHEN vote = 'unknown' THEN cshare END), 0) AS uc FROM s GROUP BY path),
w AS (SELECT u.path, CASE WHEN k.vote IS NOT NULL AND us <= 0.5 AND uc <= 0.5 THEN k.vote ELSE 'unknown' END AS profile,
  CASE WHEN k.vote IS NOT NULL AND us <= 0.5 AND uc <= 0.5 THEN k.share ELSE us END AS share FROM u LEFT JOIN k ON u.path = k.path AND k.r = 1)"""


# ---- decoding, encoding, containers -------------------------------------------------------------------------------


@query("SELECT doc_id, lang, sha256(coalesce(text, '')) AS sha, strlen(coalesce(text, '')) AS n_bytes, true AS complete FROM documents")
def stream_roundtrip(spark, sf):
    """Every document compressed and decoded by our own parser; the digest is of what the parser put out."""
    out = streams.decode(compressed(spark, sf), output=True)
    return out.select("doc_id", "lang", F.sha2("output", 256).alias("sha"), F.octet_length("output").cast("long").alias("n_bytes"), (F.col("error").isNull() & (F.col("trailing_bytes") == 0)).alias("complete"))


@query("SELECT s.setting, count(*) AS ok, count(*) AS n FROM documents, (SELECT unnest(['1','2','3','4','5','6','7','8','9','1f','6f','9f','greedy','lazy']) AS setting) s GROUP BY s.setting")
def roundtrip_levels(spark, sf):
    """All settings of the encoders at hand give back their input; equal streams of a document are decoded once."""
    settings = [("zlib", s) for s in encoders.ZLIB_SETTINGS] + [("own", "greedy"), ("own", "lazy")]
    rows = sources(spark, sf).withColumn("sha", F.sha2("content", 256))
    out = streams.decode(streams.compress_once(spread(rows, "doc_id"), settings), output=True, blocks=False)
    back = out.select(F.explode("settings").alias("setting"), (F.sha2("output", 256) == F.col("sha")).alias("same"))
    return back.groupBy("setting").agg(F.count_if("same").alias("ok"), F.count("*").alias("n"))


def _literals(spark, sf):
    """Literal counts: histograms are added up element by element in each stream, then over streams as 256 sums."""
    out = streams.decode(compressed(spark, sf, ("zlib-strategies", "huff")))
    h = out.select(features.summed(F.col("blocks"), "lit_hist", 256).alias("h"))
    total = h.agg(F.array(*[F.sum(F.get("h", F.lit(i))) for i in range(256)]).alias("h"))
    return total.select(F.posexplode("h").alias("byte", "n")).select("byte", F.col("n").cast("long").alias("n")).where("n > 0")


BYTES = "b AS (SELECT substr(h, (2 * i + 1)::BIGINT, 2) AS x FROM (SELECT hex(encode(text)) AS h, unnest(range(strlen(text))) AS i FROM documents WHERE text IS NOT NULL)), c AS (SELECT ('0x' || x)::INTEGER AS byte, count(*) AS n FROM b GROUP BY x)"


@query(f"WITH {BYTES} SELECT byte, n FROM c")
def literal_histogram(spark, sf):
    return _literals(spark, sf)


@query(f"WITH {BYTES}, t AS (SELECT sum(n) AS t FROM c) SELECT round(-sum(n / t * log2(n / t)), 6) AS entropy, sum(n)::BIGINT AS total FROM c, t")
def literal_entropy(spark, sf):
    one = _literals(spark, sf).agg(F.sort_array(F.collect_list("n")).alias("h"))
    return one.select(F.round(S.entropy(F.col("h")), 6).alias("entropy"), S.total(F.col("h")).cast("long").alias("total"))


def _make(df: DataFrame, column: str, make, kind, source: str = "content") -> DataFrame:
    """A column that a kernel makes of another; a kernel with several results gives a struct at once."""
    import pandas as pd

    if kind.startswith("struct<"):
        names = [f.split(":")[0] for f in kind[7:-1].split(",")]
        udf = F.pandas_udf(lambda s: pd.DataFrame([make(x) for x in s], columns=names), kind, F.PandasUDFType.SCALAR)
    else:
        udf = F.pandas_udf(lambda s: s.map(make), kind, F.PandasUDFType.SCALAR)
    return df.withColumn(column, udf(source))


@query("SELECT doc_id, (30 + 5 + strlen(coalesce(text, '')) + 46 + 5 + 22)::BIGINT AS n FROM documents")
def stored_zip_size(spark, sf):
    made = _make(spread(sources(spark, sf), "doc_id"), "zip", lambda d: rewrite.write_zip([rewrite.stored("a.txt", bytes(d))]), "binary")
    return made.select("doc_id", F.octet_length("zip").cast("long").alias("n"))


@query("SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n, true AS stored FROM documents")
def stored_level0_size(spark, sf):
    """Level 0 stores: every block is a stored one, and their sizes add up to the text's."""
    made = _make(spread(sources(spark, sf), "doc_id"), "raw", lambda d: encoders.zlib_raw(bytes(d), 0), "binary")
    out = streams.decode(made.select("doc_id", F.col("raw").alias("payload"))).where("error is null")
    return out.select("doc_id", F.aggregate("blocks", F.lit(0).cast("long"), lambda s, b: s + b["stored_len"]).alias("n"), F.forall("blocks", lambda b: b["kind"] == 0).alias("stored"))


def _wrap(kind: int, data: bytes) -> bytes:
    import gzip
    import struct
    import zlib

    if kind == 0:
        return rewrite.write_zip([rewrite.deflated("a.txt", data, encoders.zlib_raw(data))])
    if kind == 1:
        return gzip.compress(data, 6, mtime=0)
    if kind == 2:
        return zlib.compress(data)
    if kind == 4:
        body = zlib.compress(data)
        chunk = lambda t, b: struct.pack(">I", len(b)) + t + b + struct.pack(">I", zlib.crc32(t + b))
        return containers.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b"")
    if kind == 5:
        body = zlib.compress(data)
        return b"%PDF-1.4\n1 0 obj\n<< /Filter /FlateDecode /Length " + str(len(body)).encode() + b" >>\nstream\n" + body + b"\nendstream\nendobj\n"
    return data


def wrapped_files(spark, sf) -> DataFrame:
    """(path, content) of documents wrapped in turn as zip, gzip, zlib, plain, png and pdf."""
    rows = spread(sources(spark, sf), "doc_id").select("doc_id", (F.col("doc_id") % 6).cast("int").alias("k"), "content")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            made = [_wrap(k, d) for k, d in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([f"doc{i}" for i in b.column(0).to_pylist()]), pa.array(made, pa.binary())], names=["path", "content"])

    return rows.mapInArrow(run, "path string, content binary")


KINDS = "CASE doc_id % 6 WHEN 0 THEN 'zip' WHEN 1 THEN 'gzip' WHEN 2 THEN 'zlib' WHEN 3 THEN 'raw' WHEN 4 THEN 'png' ELSE 'pdf' END"


@query(f"SELECT {KINDS} AS kind, count(*) AS n FROM documents GROUP BY 1")
def container_detect(spark, sf):
    return wrapped_files(spark, sf).select(containers.kind_column().alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"SELECT {KINDS} AS kind, count(*) AS files, count(*) AS streams, sum(CASE WHEN doc_id % 6 = 3 THEN 0 ELSE strlen(text) END)::BIGINT AS decoded FROM documents GROUP BY 1")
def container_streams(spark, sf):
    """Files scanned, their streams decoded: bytes put out by kind (plain text is no stream)."""
    found = containers.stream_rows(containers.scan_table(wrapped_files(spark, sf)))
    out = streams.decode(found.select("path", "kind", "payload"))
    size = F.when(F.col("kind") == "raw", 0).otherwise(F.col("out_size"))
    return out.groupBy("kind").agg(F.count_distinct("path").alias("files"), F.count("*").alias("streams"), F.sum(size).cast("long").alias("decoded"))


@query("SELECT source, count(*) AS members, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY source")
def gzip_members(spark, sf):
    """GZIP files of up to 64 members (documents of a source with neighbouring ids), scanned and added up by source."""
    def join(batches):
        import gzip

        import pyarrow as pa

        for b in batches:
            made = [b"".join(gzip.compress(d, 6, mtime=0) for d in docs) for docs in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.binary())], names=["path", "content"])

    groups = sources(spark, sf).groupBy(F.concat_ws("/", "source", F.floor(F.col("doc_id") / 64)).alias("p")).agg(F.collect_list("content").alias("c"))
    found = containers.stream_rows(containers.scan_table(groups.mapInArrow(join, "path string, content binary")))
    return found.groupBy(F.split_part("path", F.lit("/"), F.lit(1)).alias("source")).agg(F.count("*").alias("members"), F.sum("declared_usize").cast("long").alias("bytes"))


@query("SELECT md5(text) AS name, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def duplicate_names(spark, sf):
    rows = table(spark, sf, "documents").where("text is not null").select(F.lit(0).alias("path"), F.md5(F.col("text").cast("binary")).alias("name"))
    return V.duplicate_names(rows).select("name", "copies")


@query("SELECT coalesce(nullif(regexp_extract(lower(split_part(split_part(url, '?', 1), '#', 1)), '(\\.[^./]+)$', 1), ''), '') AS suffix, count(*) AS n FROM pages GROUP BY 1")
def suffix_kind(spark, sf):
    path = F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    return table(spark, sf, "pages").groupBy(containers.suffix_column(path).alias("suffix")).agg(F.count("*").alias("n"))


@query("SELECT (['normal','maximum','fast','super fast'])[((l_orderkey >> 1) & 3) + 1] AS option, ((l_orderkey & 65) <> 0 OR l_partkey % 100 = 99) AS encrypted, count(*) AS n FROM lineitem GROUP BY 1, 2")
def option_bits(spark, sf):
    flags = F.col("l_orderkey").cast("long")
    name = rules.option_name(flags.cast("int"))
    return table(spark, sf, "lineitem").groupBy(name.alias("option"), rules.encrypted(flags, F.col("l_partkey") % 100).alias("encrypted")).agg(F.count("*").alias("n"))


@query("SELECT page_id, CASE WHEN regexp_matches(html, '<(\\w+:)?title[^>]*>[^<]{0,300}</') THEN trim(regexp_extract(html, '<(\\w+:)?title[^>]*>([^<]{0,300})</', 2)) END AS claim FROM pages")
def xml_claim(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("content"))
    return _make(pages, "claim", lambda d: containers.xml_text(bytes(d), "title"), "string").select("page_id", "claim")


CLAIMS = "CASE p_partkey % 7 WHEN 0 THEN 'openpyxl' WHEN 1 THEN 'LibreOffice/24.2' WHEN 2 THEN 'Microsoft Office Word' WHEN 3 THEN 'Microsoft Excel' WHEN 4 THEN '21.0.10 (Ubuntu)' WHEN 5 THEN 'Compatible / Openpyxl' ELSE p_name END"


@query(f"""WITH c AS (SELECT p_partkey, {CLAIMS} AS claim FROM part) SELECT p_partkey, claim,
 CASE WHEN claim ILIKE '%openpyxl%' THEN 'openpyxl' WHEN claim ILIKE '%LibreOffice%' THEN 'libreoffice' WHEN regexp_matches(claim, '^Microsoft (Office )?Word$') THEN 'microsoft-word'
 WHEN regexp_matches(claim, '^Microsoft (Office )?Excel$') THEN 'microsoft-excel' WHEN regexp_matches(claim, '^\\d+(\\.\\d+)*\\S*\\s*\\([^)]*\\)$') THEN 'jdk-jar' END AS producer_key FROM c""")
def producer_match(spark, sf):
    claims = table(spark, sf, "part").select("p_partkey", F.expr(CLAIMS).alias("claim"))
    return V.match_producer(claims).select("p_partkey", "claim", "producer_key")


# ---- votes and verdicts -------------------------------------------------------------------------------------------


@query(f"WITH {VOTES} SELECT path, profile, round(share, 6) AS share FROM w")
def weighted_vote(spark, sf):
    return V.weighted_vote(archives(spark, sf)).select("path", "profile", F.round("share", 6).alias("share"))


@query(f"WITH {VOTES} SELECT path, vote, round(share, 6) AS share FROM s")
def vote_shares(spark, sf):
    return V.vote_shares(archives(spark, sf)).select("path", "vote", F.round("share", 6).alias("share"))


@query(f"WITH {VOTES} SELECT e.path, round(sum(CASE WHEN label = profile THEN confidence * size ELSE 0 END) / sum(size), 6) AS confidence FROM e JOIN w ON e.path = w.path GROUP BY e.path")
def archive_confidence(spark, sf):
    e = archives(spark, sf)
    return V.archive_confidence(e, V.weighted_vote(e)).select("path", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {VOTES}, x AS (SELECT e.path, setting, sum(size) AS b FROM e JOIN w ON e.path = w.path WHERE status = 'attributed' AND label = profile GROUP BY ALL)
SELECT path, setting FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY b DESC, setting) AS r FROM x) WHERE r = 1""")
def setting_vote(spark, sf):
    e = archives(spark, sf)
    return V.setting_vote(e, V.weighted_vote(e))


@query(f"WITH {ARCHIVES}, x AS (SELECT path, label, sum(size) AS b FROM e WHERE status = 'attributed' GROUP BY ALL) SELECT path, label AS closest FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY b DESC, label) AS r FROM x) WHERE r = 1")
def top_attributed(spark, sf):
    return V.top_attributed(archives(spark, sf))


@query(f"""WITH {ARCHIVES}, x AS (SELECT path, ending, count(*) AS n FROM e GROUP BY ALL)
SELECT path, ending, n, odd FROM (SELECT path, ending, n, n < max(n) OVER (PARTITION BY path) AS odd, count(*) OVER (PARTITION BY path) AS kinds FROM x) WHERE kinds > 1""")
def odd_endings(spark, sf):
    return V.odd_endings(archives(spark, sf))


@query(f"WITH {ARCHIVES} SELECT path, name, size, rank FROM (SELECT path, name, size, row_number() OVER (PARTITION BY path ORDER BY size DESC, name)::INTEGER AS rank FROM e) WHERE rank <= 3")
def entry_topk(spark, sf):
    return V.largest_entries(archives(spark, sf), 3).select("path", "name", "size", "rank")


@query(f"""WITH {ARCHIVES} SELECT path, label, min(confidence) >= 0.95 AND sum(size) >= 1024 AS established FROM e WHERE status = 'attributed' GROUP BY ALL""")
def established(spark, sf):
    e = archives(spark, sf).withColumns({"proof": F.lit(None).cast("string"), "zlib_hits": F.lit(None).cast("int")})
    return V.established(e, 0.95)


@query(f"""WITH {VOTES.replace("l_returnflag AS label", "CASE l_returnflag WHEN 'A' THEN 'zlib' ELSE 'go-flate' END AS label").replace("l_quantity > 45", "l_quantity > 99").replace("l_quantity > 40", "l_quantity >= 49")},
x AS (SELECT path, ending, count(*) AS n FROM e GROUP BY ALL), y AS (SELECT path, count(*) AS kinds, min(ending) AS least, max(n) AS most FROM x GROUP BY path),
odd AS (SELECT x.path, sum(n)::INTEGER AS named FROM x JOIN y ON x.path = y.path WHERE kinds > 1 AND n < most GROUP BY x.path),
g AS (SELECT path, count(DISTINCT CASE WHEN status = 'attributed' THEN label END) AS groups FROM e GROUP BY path),
sure AS (SELECT path, label, min(confidence) >= 0.9 AND sum(size) >= 1024 AS established FROM e WHERE status = 'attributed' GROUP BY ALL)
SELECT w.path, profile, coalesce(named, 0) AS named,
 CASE WHEN kinds > 1 THEN 'inconsistent' WHEN w.path % 3 = 0 AND (least <> 'data' OR profile = 'go-flate' AND established) THEN 'inconsistent'
 WHEN profile = 'unknown' OR groups > 1 OR w.path % 3 = 2 OR w.path % 3 = 0 AND profile = 'go-flate' THEN 'inconclusive' ELSE 'consistent' END AS status
FROM w JOIN y ON w.path = y.path JOIN g ON g.path = w.path LEFT JOIN odd ON odd.path = w.path LEFT JOIN sure ON sure.path = w.path AND sure.label = profile""")
def verdict_status(spark, sf):
    """Whole verdicts of the stand-in archives; in turn they claim openpyxl, nothing, and a producer that no table knows."""
    e = archives(spark, sf).withColumns({"label": F.when(F.col("label") == "A", "zlib").otherwise("go-flate"), "proof": F.lit(None).cast("string"), "zlib_hits": F.lit(None).cast("int")})
    e = e.withColumn("ending", F.when(F.col("quantity") >= 49, "flush").otherwise("data"))
    claim = F.when(F.col("path") % 3 == 0, "openpyxl").when(F.col("path") % 3 == 2, "some writer")
    a = e.groupBy("path").agg(F.lit("zip").alias("kind"), claim.alias("claim"), F.array().cast("array<int>").alias("option_bits_seen"), F.array().cast("array<string>").alias("duplicate_names"), F.lit(0).alias("encrypted"), F.lit(0).alias("backslash_names"))
    return V.verdicts(e, a, ["zlib", "go-flate"]).select("path", "profile", F.size("named").alias("named"), "status")


@query("SELECT l_shipmode_like AS status, count(*) AS n FROM (SELECT CASE WHEN l_tax > 0.07 THEN 'error' WHEN l_quantity < 5 THEN 'insufficient' WHEN l_discount > 0.08 THEN 'unknown' ELSE 'attributed' END AS l_shipmode_like FROM lineitem) GROUP BY 1")
def entry_status(spark, sf):
    li = table(spark, sf, "lineitem")
    status = V.entry_status(F.when(F.col("l_tax") > 0.07, "damaged"), F.lit(1), F.col("l_quantity"), F.col("l_discount") > 0.08, 5)
    return li.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT l_orderkey AS path, l_returnflag AS feature, sum(l_extendedprice * (l_discount - 0.05)) AS m FROM lineitem GROUP BY ALL), t AS (SELECT l_orderkey AS path, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1),
y AS (SELECT x.path, feature, m / total AS c FROM x JOIN t ON x.path = t.path)
SELECT path, feature, round(c, 5) AS contribution FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY abs(c) DESC, feature) AS r FROM y) WHERE r <= 1 AND abs(c) > 1e-4""")
def weighted_explanation(spark, sf):
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("name"), F.col("l_extendedprice").alias("size"), F.col("l_returnflag").alias("feature"), (F.col("l_discount") - 0.05).alias("contribution"))
    return V.weighted_explanation(items, 1).where(F.abs("contribution") > 1e-4).select("path", "feature", F.round("contribution", 5).alias("contribution"))


# ---- corpus, families, splits -------------------------------------------------------------------------------------


@query("SELECT sha256(text) AS digest, list_sort(list(DISTINCT lang)) AS labels, list_sort(list(DISTINCT source)) AS profiles, CASE WHEN count(DISTINCT source) = 1 THEN min(source) END AS profile FROM documents WHERE text IS NOT NULL GROUP BY text")
def identical_outputs(spark, sf):
    rows = table(spark, sf, "documents").where("text is not null").select(F.lit(0).alias("source"), F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.col("lang").alias("label"), F.col("source").alias("profile"))
    return E.identical_outputs(rows).select("digest", "labels", "profiles", "profile")


@query("""WITH r AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_linenumber = 1), o AS (SELECT 'p' || l_linenumber AS program, r.l_partkey IS NOT NULL AS same FROM lineitem l LEFT JOIN r ON l.l_partkey = r.l_partkey WHERE l_linenumber > 1)
SELECT program, round(avg(same::INT), 6) AS rate, avg(same::INT) >= 0.95 AS merges FROM o GROUP BY program""")
def profile_sharing(spark, sf):
    li = table(spark, sf, "lineitem")
    rows = li.select(F.lit(0).alias("source"), F.col("l_partkey").alias("digest"), F.concat(F.lit("p"), F.col("l_linenumber")).alias("program"), F.lit("p1").alias("library"))
    return E.profile_sharing(rows).select("program", F.round("rate", 6).alias("rate"), "merges")


@query("SELECT doc_id, CASE WHEN ('0x' || substr(sha256(text), 1, 2))::INTEGER % 2 = 0 THEN 'train' ELSE 'holdout' END AS split FROM documents WHERE text IS NOT NULL")
def app_split(spark, sf):
    return table(spark, sf, "documents").where("text is not null").select("doc_id", E.hash_parity(F.sha2(F.col("text").cast("binary"), 256)).alias("split"))


@query("""WITH f AS (SELECT lang AS kind, source AS family, count(*) AS n FROM documents GROUP BY ALL),
o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY kind ORDER BY md5(family), family ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, round(sum(n) OVER (PARTITION BY kind) * 0.3) AS want FROM f)
SELECT kind, family, n, CASE WHEN before < want THEN 'test' ELSE 'train' END AS split FROM o""")
def family_split(spark, sf):
    return E.family_split(table(spark, sf, "documents").groupBy(F.col("lang").alias("kind"), F.col("source").alias("family")).agg(F.count("*").alias("n")))


def _sketches(spark, sf, short=False):
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    few = texts.rdd.getNumPartitions() < spark.sparkContext.defaultParallelism  # else texts need not be moved
    return E.sketch(spread(texts, "id") if few else texts, "id", short=short)


SKETCHES = """w AS (SELECT doc_id AS id, regexp_split_to_array(lower(text), '\\s+') AS w FROM documents WHERE text IS NOT NULL),
t AS (SELECT id, unnest(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: md5(array_to_string(w[i:i+2], ' ')))) AS t FROM w),
r AS (SELECT id, t, row_number() OVER (PARTITION BY id ORDER BY t) AS r FROM (SELECT DISTINCT id, t FROM t)),
k AS (SELECT id, list(t ORDER BY t) AS sketch FROM r WHERE r <= 128 GROUP BY id)"""


@query(f"WITH {SKETCHES} SELECT id, len(sketch)::INTEGER AS n, sketch[1] AS least FROM k")
def content_sketch(spark, sf):
    s = _sketches(spark, sf)
    return s.select("id", F.size("sketch").alias("n"), F.col("sketch")[0].alias("least"))


@query(f"""WITH {SKETCHES}, v AS (SELECT id, unnest(sketch) AS v FROM k), c AS (SELECT DISTINCT a.id AS a, b.id AS b FROM v a JOIN v b ON a.v = b.v AND a.id < b.id),
p AS (SELECT a, b, list_sort(list_distinct(list_concat(x.sketch, y.sketch)))[1:128] AS u, x.sketch AS x, y.sketch AS y FROM c JOIN k x ON x.id = a JOIN k y ON y.id = b)
SELECT a, b FROM p WHERE len(list_intersect(list_intersect(u, x), y)) / len(u) >= 0.5""")
def near_duplicates(spark, sf):
    return E.similar_sketches(_sketches(spark, sf, short=True), "id")


def _part_names(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("folder"), F.col("p_name").alias("stem"))


@query("SELECT a, b FROM (SELECT min(p_partkey) OVER (PARTITION BY p_brand, substr(p_name, 1, 6)) AS a, p_partkey AS b FROM part WHERE length(p_name) >= 6) WHERE a <> b")
def name_families(spark, sf):
    return E.name_pairs(_part_names(spark, sf), "id", "folder", "stem")


@query("SELECT p_partkey AS id, min(CASE WHEN length(p_name) >= 6 THEN p_partkey END) OVER (PARTITION BY p_brand, CASE WHEN length(p_name) >= 6 THEN substr(p_name, 1, 6) ELSE p_partkey::VARCHAR END) AS family FROM part WHERE length(p_name) >= 6")
def families_cc(spark, sf):
    names = _part_names(spark, sf).where("length(stem) >= 6")
    return E.components(names, E.name_pairs(names, "id", "folder", "stem"), "id")


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def second_set_anti(spark, sf):
    return E.unseen(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id")


@query("SELECT d.doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)")
def train_overlap_semi(spark, sf):
    return E.overlaps(table(spark, sf, "documents"), table(spark, sf, "labels").where("toxic = 1"), "doc_id").select("doc_id", "lang")


# ---- metrics and calibration --------------------------------------------------------------------------------------

TRUTH = "t AS (SELECT l.doc_id, n_chars AS size, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS truth, CASE WHEN d.doc_id % 5 = 0 THEN 'bad' ELSE 'good' END AS top, d.doc_id % 7 <> 0 AS answered, (d.doc_id % 97) / 97.0 * 0.6 + 0.4 AS confidence FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"


def _truth(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    t = d.select("doc_id", F.col("n_chars").alias("size"), F.when(F.col("quality") == 1, "good").otherwise("bad").alias("truth"), F.when(F.col("doc_id") % 5 == 0, "bad").otherwise("good").alias("top"), (F.col("doc_id") % 7 != 0).alias("answered"), ((F.col("doc_id") % 97) / 97.0 * 0.6 + 0.4).alias("confidence"))
    return t.withColumns({"correct": F.col("truth") == F.col("top"), "predicted": F.when(F.col("answered"), F.col("top"))})


@query(f"WITH {TRUTH} SELECT count(*) AS n, round(avg((truth = top)::INT), 6) AS accuracy, round(avg((truth = top AND answered)::INT), 6) AS end_to_end_accuracy, round(avg(answered::INT), 6) AS coverage, round(avg(CASE WHEN answered THEN (truth = top)::INT END), 6) AS accuracy_answered FROM t")
def closed_set_metrics(spark, sf):
    m = E.closed_set(_truth(spark, sf))
    return m.select("n", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


@query(f"""WITH {TRUTH}, p AS (SELECT truth AS profile, count(*) AS support, count_if(answered AND truth = top) AS tp FROM t GROUP BY 1), s AS (SELECT top AS profile, count(*) AS said FROM t WHERE answered GROUP BY 1),
j AS (SELECT p.profile, support, tp / said AS pr, tp / support AS re FROM p JOIN s ON p.profile = s.profile) SELECT profile, support, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1 FROM j""")
def class_metrics(spark, sf):
    return E.class_metrics(_truth(spark, sf)).select("profile", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {TRUTH} SELECT truth, count_if(answered AND top = 'bad')::BIGINT AS bad, count_if(answered AND top = 'good')::BIGINT AS good, count_if(NOT answered)::BIGINT AS none FROM t GROUP BY truth")
def confusion_pivot(spark, sf):
    return E.confusion(_truth(spark, sf).withColumn("predicted_or_none", F.coalesce("predicted", F.lit("none"))), ["bad", "good"])


BANDS = f"""{TRUTH}, b AS (SELECT * FROM (VALUES (0, 256), (256, 1024), (1024, 4096), (4096, 16384), (16384, 65536), (65536, NULL)) x(lo, hi)),
g AS (SELECT lo, count(*) AS n, count_if(answered) AS answered, avg((truth = top)::INT) AS accuracy, count_if(answered AND truth = top) AS hits FROM t JOIN b ON size >= lo AND (hi IS NULL OR size < hi) GROUP BY lo),
z AS (SELECT lo, n, answered, accuracy, CASE WHEN answered = 0 THEN 0 ELSE hits / answered END AS accuracy_answered,
  coalesce(sum(hits) OVER (ORDER BY lo ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / nullif(sum(answered) OVER (ORDER BY lo ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 0), 0) AS pooled FROM g)"""


@query(f"WITH {BANDS} SELECT lo::BIGINT AS lo, n, answered::BIGINT AS answered, round(accuracy, 6) AS accuracy, round(accuracy_answered, 6) AS accuracy_answered, round(pooled, 6) AS pooled FROM z")
def size_bands(spark, sf):
    return E.size_bands(_truth(spark, sf)).select("lo", "n", "answered", *[F.round(c, 6).alias(c) for c in ("accuracy", "accuracy_answered", "pooled")])


@query(f"WITH {BANDS} SELECT coalesce(min(CASE WHEN answered >= 10 AND accuracy_answered >= 0.6 AND pooled >= 0.6 THEN lo END), 65536)::BIGINT AS least_size FROM z")
def min_evidence(spark, sf):
    return E.least_evidence(E.size_bands(_truth(spark, sf)), 0.6)


@query(f"""WITH {TRUTH}, c AS (SELECT floor((confidence - 0.4) / 0.01 + 1e-9) AS cell, (truth = top) AS correct FROM t), g AS (SELECT i, 0.4 + i * 0.01 AS th FROM range(60) r(i)),
k AS (SELECT th, count(*) AS kept, count_if(correct) AS good FROM g JOIN c ON i <= cell GROUP BY th), n AS (SELECT count(*) AS n FROM t)
SELECT round(coalesce(min(th), 0.99), 3)::DOUBLE AS threshold FROM k, n WHERE kept >= greatest(5, floor(n * 0.05)) AND good / kept >= 0.7""")
def threshold_pick(spark, sf):
    return E.threshold_pick(_truth(spark, sf), 0.7)


PROBA = "p AS (SELECT vec_id, label, list_transform(embedding[1:10]::DOUBLE[], lambda x: exp(4 * x)) AS e FROM embeddings), q AS (SELECT vec_id, label, list_transform(e, lambda x: x / list_sum(e)) AS proba FROM p)"


@query(f"""WITH {PROBA}, g AS (SELECT 0.25 + i * (3.75 / 60) AS t FROM range(61) r(i)), l AS (SELECT t, label, list_transform(proba, lambda p: exp(ln(least(greatest(p, 1e-9), 1.0)) / t)) AS z FROM q, g)
SELECT round(t, 4)::DOUBLE AS t, round(avg(-ln(greatest(z[label + 1] / list_sum(z), 1e-9))), 5) AS nll FROM l GROUP BY t""")
def temperature_grid(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.transform(F.slice("embedding", 1, 10), lambda x: F.exp(4 * x.cast("double"))).alias("e"))
    rows = e.select((F.col("label") + 1).alias("truth"), F.transform("e", lambda x: x / S.total(F.col("e"))).alias("proba"))
    return E.temperatures(rows).select(F.round("t", 4).alias("t"), F.round("nll", 5).alias("nll"))


@query("""WITH m AS (SELECT avg(l_quantity) AS ma, stddev_pop(l_quantity) AS sa, avg(l_extendedprice) AS mb, stddev_pop(l_extendedprice) AS sb FROM lineitem)
SELECT l_orderkey, l_linenumber, round(greatest(least((l_quantity - ma) / sa, 1.5), -1.5), 5) AS l_quantity, round(greatest(least((l_extendedprice - mb) / sb, 1.5), -1.5), 5) AS l_extendedprice FROM lineitem, m""")
def standardise_clip(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    out = E.standardise(rows, ["l_quantity", "l_extendedprice"], 1.5)
    return out.select("l_orderkey", "l_linenumber", F.round("l_quantity", 5).alias("l_quantity"), F.round("l_extendedprice", 5).alias("l_extendedprice"))


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


REFS = "z AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings), r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(id::VARCHAR), id) AS k FROM z) WHERE k <= 20)"
SCALES = REFS + ", n AS (SELECT a.label, a.id, min(list_distance(a.v, b.v)) AS d FROM r a JOIN r b ON a.label = b.label AND a.id <> b.id GROUP BY ALL), sc AS (SELECT label, greatest(coalesce(quantile_cont(d, 0.5), 1), 0.05) AS scale FROM n WHERE d > 1e-9 GROUP BY label)"
NOVEL = SCALES + ", nv AS (SELECT z.id, min(list_distance(z.v, r.v) / scale) AS novelty FROM z, r JOIN sc ON r.label = sc.label GROUP BY z.id)"


def _novelty(spark, sf):
    v = _vectors(spark, sf)
    refs = E.reference_rows(v, 20)
    return E.novelty(v, refs, E.class_scales(refs))


@query(f"WITH {SCALES} SELECT label, round(scale, 5) AS scale FROM sc")
def novelty_scale(spark, sf):
    return E.class_scales(E.reference_rows(_vectors(spark, sf), 20)).select("label", F.round("scale", 5).alias("scale"))


@query(f"WITH {NOVEL} SELECT id, round(novelty, 5) AS novelty FROM nv")
def novelty_nn(spark, sf):
    return _novelty(spark, sf).select("id", F.round("novelty", 5).alias("novelty"))


@query(f"WITH {NOVEL} SELECT round(quantile_cont(novelty, 0.99), 5) AS threshold FROM nv")
def novelty_threshold(spark, sf):
    return _novelty(spark, sf).agg(F.round(F.expr("percentile(novelty, 0.99)"), 5).alias("threshold"))


@query("WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label, n, round((SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n), 6) AS weight FROM c")
def balanced_weights(spark, sf):
    return E.balanced_weights(table(spark, sf, "embeddings")).select("label", "n", F.round("weight", 6).alias("weight"))


@query("SELECT label, id FROM (SELECT label, vec_id AS id, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id::VARCHAR), vec_id) AS r FROM embeddings) WHERE r <= 5")
def stratified_sample(spark, sf):
    return E.stratified(table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("id")), "label", "id", 5).select("label", "id")


@query("SELECT lang, source, round(avg((quality = 1)::INT), 6) AS rate, count(*) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id GROUP BY ROLLUP (lang, source)")
def rollup_rates(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return E.rates(d, F.col("quality") == 1, "lang", "source").withColumn("rate", F.round("rate", 6))


# ---- assessment ---------------------------------------------------------------------------------------------------

JUDGED = """j AS (SELECT l_returnflag AS label, l_discount > 0.09 AS abstained, CASE WHEN l_partkey % 3 = 0 THEN ['A', 'N'] ELSE [l_returnflag] END AS profiles,
 CASE WHEN l_suppkey % 5 = 0 THEN NULL ELSE l_linestatus END AS setting, CASE WHEN l_linenumber % 2 = 0 THEN ['O'] ELSE ['F', 'O'] END AS known FROM lineitem)"""


@query(f"WITH {JUDGED} SELECT label, count(*) AS n, round(avg(list_contains(known, setting)::INT), 6) AS accuracy FROM j WHERE NOT abstained AND list_contains(profiles, label) AND setting IS NOT NULL GROUP BY label")
def setting_metrics(spark, sf):
    known = F.when(F.col("l_linenumber") % 2 == 0, F.array(F.lit("O"))).otherwise(F.array(F.lit("F"), F.lit("O")))
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("label"), (F.col("l_discount") > 0.09).alias("abstained"), F.when(F.col("l_partkey") % 3 == 0, F.array(F.lit("A"), F.lit("N"))).otherwise(F.array("l_returnflag")).alias("profiles"),
                                               F.when(F.col("l_suppkey") % 5 != 0, F.col("l_linestatus")).alias("setting"), F.create_map("l_returnflag", known).alias("settings"))
    return A.setting_metrics(rows).withColumn("accuracy", F.round("accuracy", 6))


@query("""WITH s AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ['go:' || p_size, '9', '10', 'fast'] WHEN 1 THEN ['go:10', 'java:' || p_size] WHEN 2 THEN ['smallest', 'optimal'] ELSE [p_size::VARCHAR || 'f', '6', 'x:1'] END AS settings FROM part),
u AS (SELECT p_partkey, unnest(settings) AS s FROM s), k AS (SELECT *, regexp_replace(split_part(s, ':', -1), '[^0-9]', '', 'g') AS d, contains(s, ':') AS foreign_name FROM u)
SELECT p_partkey, s AS setting FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY foreign_name, d = '', coalesce(nullif(d, '')::BIGINT, 0), s) AS r FROM k) WHERE r = 1""")
def canonical_setting(spark, sf):
    size = F.col("p_size").cast("string")
    settings = (
        F.when(F.col("p_partkey") % 4 == 0, F.array(F.concat(F.lit("go:"), size), F.lit("9"), F.lit("10"), F.lit("fast"))).when(F.col("p_partkey") % 4 == 1, F.array(F.lit("go:10"), F.concat(F.lit("java:"), size)))
        .when(F.col("p_partkey") % 4 == 2, F.array(F.lit("smallest"), F.lit("optimal"))).otherwise(F.array(F.concat(size, F.lit("f")), F.lit("6"), F.lit("x:1")))
    )
    return table(spark, sf, "part").select("p_partkey", A.canonical_setting(settings).alias("setting"))


@query("""WITH d AS (SELECT doc_id, lang, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE lang END AS profile, doc_id % 11 = 0 AS synthetic, CASE WHEN doc_id % 5 = 0 THEN 'app' ELSE 'corpus' END AS origin, CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'holdout' END AS own, source FROM documents),
s AS (SELECT source, CASE WHEN md5(source) < '8' THEN 'train' ELSE 'test' END AS split FROM (SELECT DISTINCT source FROM documents)),
p AS (SELECT d.*, CASE WHEN origin = 'app' THEN CASE WHEN own = 'holdout' THEN 'test' ELSE own END ELSE s.split END AS part FROM d LEFT JOIN s ON s.source = d.source)
SELECT doc_id, coalesce(part = 'train' AND profile IS NOT NULL AND NOT synthetic AND coalesce(profile <> 'de', true), false) AS in_train, coalesce(part = 'test' AND NOT synthetic, false) AS in_test FROM p""")
def selection_masks(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("source_id"), F.when(F.col("doc_id") % 4 != 3, F.col("lang")).alias("profile"), (F.col("doc_id") % 11 == 0).alias("synthetic"),
                                             F.when(F.col("doc_id") % 5 == 0, "app").otherwise("corpus").alias("origin"), F.when(F.col("doc_id") % 2 == 0, "train").otherwise("holdout").alias("split"))
    split = d.select("source_id").distinct().select("source_id", F.when(F.md5(F.col("source_id").cast("binary")) < "8", "train").otherwise("test").alias("split"))
    return A.selection(d, split, ["de"]).select("doc_id", "in_train", "in_test")


@query("""WITH r AS (SELECT doc_id, lang, md5(doc_id::VARCHAR) AS m, CASE WHEN doc_id % 3 = 0 THEN ['zlib', lang] ELSE [lang] END AS profiles, CASE WHEN doc_id % 2 = 0 THEN 'zlib' ELSE 'unknown' END AS a, CASE WHEN doc_id % 7 > 0 THEN lang END AS b FROM documents),
s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY m, doc_id) AS k FROM r) WHERE k <= 40), e AS (SELECT 'a' AS method, profiles, a AS said FROM s UNION ALL SELECT 'b', profiles, b FROM s)
SELECT method, count(*) AS n, count_if(said IS NOT NULL AND said <> 'unknown' AND list_contains(profiles, said))::BIGINT AS correct, count_if(said IS NOT NULL AND said <> 'unknown' AND NOT list_contains(profiles, said))::BIGINT AS wrong, count_if(said IS NULL OR said = 'unknown')::BIGINT AS none,
 count_if(list_contains(profiles, 'zlib') AND coalesce(said = 'zlib', false))::BIGINT AS zlib_hits, count_if(NOT list_contains(profiles, 'zlib') AND coalesce(said = 'zlib', false))::BIGINT AS zlib_false, count_if(list_contains(profiles, 'zlib') AND NOT coalesce(said = 'zlib', false))::BIGINT AS zlib_missed FROM e GROUP BY method""")
def baseline_comparison(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("hash"), F.col("lang").alias("profile"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("zlib"), "lang")).otherwise(F.array("lang")).alias("profiles"), F.when(F.col("doc_id") % 2 == 0, "zlib").otherwise("unknown").alias("a"), F.when(F.col("doc_id") % 7 > 0, F.col("lang")).alias("b"))
    return A.comparison(rows, ["a", "b"])


@query("""WITH r AS (SELECT o_orderkey, o_orderpriority AS app, o_custkey AS hash, o_totalprice AS size, o_orderkey % 50 < CASE WHEN o_orderpriority < '3' THEN 49 ELSE 30 END AS reproduced, sha256(o_clerk_like) AS f FROM (SELECT *, (o_orderkey // 4)::VARCHAR AS o_clerk_like FROM orders)),
o AS (SELECT *, CASE WHEN ('0x' || substr(f, 1, 2))::INTEGER % 2 = 0 THEN 'train' ELSE 'holdout' END AS own FROM r), seen AS (SELECT hash, max((own = 'train')::INT) AS t FROM o GROUP BY hash),
share AS (SELECT app, avg(reproduced::INT) AS share FROM (SELECT *, row_number() OVER (PARTITION BY app ORDER BY size DESC, hash) AS k FROM r) WHERE k <= 200 GROUP BY app)
SELECT o.o_orderkey, CASE WHEN share >= 0.95 THEN 'zlib' ELSE o.app END AS profile, CASE WHEN t = 1 THEN 'train' ELSE 'holdout' END AS split FROM o JOIN seen ON seen.hash = o.hash JOIN share ON share.app = o.app""")
def application_rows(spark, sf):
    """Orders as streams of applications (their priority), customers as stream hashes, four orders a file."""
    share = F.when(F.col("o_orderpriority") < "3", 49).otherwise(30)
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("app"), F.col("o_custkey").alias("hash"), F.col("o_totalprice").alias("size"), (F.col("o_orderkey") % 50 < share).alias("reproduced"), F.sha2(F.floor(F.col("o_orderkey") / 4).cast("string").cast("binary"), 256).alias("file_hash"))
    return A.add_application(rows, "zlib").select("o_orderkey", "profile", "split")


@query("SELECT count(*) AS streams, count(DISTINCT sha256(coalesce(text, ''))) AS sources, 1::BIGINT AS missing FROM documents")
def regenerated_streams(spark, sf):
    """Corpus rows made anew from their sources; one row that nothing makes is reported."""
    docs = spread(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("source_id"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("content")), "source_id")
    rows = streams.compress(docs, [("zlib", "9")]).select("source_id", F.sha2("payload", 256).alias("hash"))
    made, missing = A.regenerate(rows.union(spark.createDataFrame([("0", "none")], "source_id string, hash string")), docs, [("zlib", "9"), ("zlib", "1")])
    out = streams.decode(made.select("source_id", F.col("payload").alias("p")), "p", output=True)
    return out.agg(F.count("*").alias("streams"), F.count_distinct(F.sha2("output", 256)).alias("sources")).crossJoin(missing.agg(F.count("*").alias("missing")))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'python-zipfile' ELSE 'own' END AS writer FROM documents")
def metadata_baseline(spark, sf):
    """Writers told apart by headers alone: archives of every document by two writers in turn."""
    def make(data):
        d, content = int(data[0]), bytes(data[1] or b"")[:300]
        return A.WRITERS["own" if d % 2 else "python-zipfile"][1]([("a.xml", content), ("b.xml", content[:50])])

    docs = spread(table(spark, sf, "documents"), "doc_id").select("doc_id", F.struct(F.col("doc_id").alias("d"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("c")).alias("s"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([str(i) for i in b.column(0).to_pylist()]), pa.array([make((s["d"], s["c"])) for s in b.column(1).to_pylist()], pa.binary())], names=["path", "content"])

    reports = E.cut(containers.scan_table(docs.mapInArrow(run, "path string, content binary")))
    labelled = reports.withColumn("writer", F.when(F.col("path").cast("long") % 2 == 0, "python-zipfile").otherwise("own"))
    said = A.metadata_predictions(A.metadata_model(labelled, "writer"), reports)
    return said.select(F.col("path").cast("long").alias("doc_id"), "writer")


@query("SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS literals, 0::BIGINT AS matches FROM documents")
def sql_table_function(spark, sf):
    """Blocks of streams without matches, read by a table function in SQL."""
    udtf.register(spark)
    compressed(spark, sf, ("zlib-strategies", "huff")).select("doc_id", "payload").createOrReplaceTempView("flatewise_streams")
    return spark.sql("SELECT doc_id, sum(b.literals) AS literals, sum(b.matches) AS matches FROM flatewise_streams, LATERAL deflate_blocks(payload) b GROUP BY doc_id")


# ---- statistics over sequences ------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT l_orderkey AS id, list(l_quantity) AS q FROM lineitem GROUP BY 1)
SELECT id, round(list_avg(q), 6) AS mean, round(list_aggregate(q, 'median'), 6) AS median, round(CASE WHEN len(q) < 2 THEN 0 ELSE list_aggregate(q, 'stddev_samp') / list_avg(q) END, 5) AS cv,
 round(list_aggregate(list_transform(q, lambda x: -x / list_sum(q) * log2(x / list_sum(q))), 'sum'), 5) AS entropy, round(1 - list_sum(list_transform(q, lambda x: (x / list_sum(q)) ** 2)) + 1e-9, 6) AS gini FROM a""")
def feature_stats(spark, sf):
    a = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_quantity").alias("q"))
    q = F.col("q")
    return a.select("id", F.round(S.mean(q), 6).alias("mean"), F.round(S.median(q), 6).alias("median"), F.round(S.variation(q), 5).alias("cv"), F.round(S.entropy(q), 5).alias("entropy"), F.round(S.gini(q) + 1e-9, 6).alias("gini"))


@query("""WITH a AS (SELECT l_orderkey AS id, l_quantity / 10 AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT id, n AS blocks, CASE WHEN count_if(i < n) > 0 AND coalesce(stddev_samp(CASE WHEN i < n THEN q END), 0) < 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS uniform FROM a GROUP BY id, n""")
def interior_uniform(spark, sf):
    """The feature that tells blocks of one size (all but the last) from others, over the entries of stand-in archives."""
    li = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("s"))
    inner = li.select("id", F.size("s").cast("long").alias("blocks"), F.transform(F.slice("s", 1, F.size("s") - 1), lambda x: x["l_quantity"] / 10).alias("_inner"))
    return inner.select("id", "blocks", features.columns()["blk_interior_uniform"].alias("uniform"))


@query("""WITH a AS (SELECT conv_id, length(text) // 50 AS v, min(turn) AS f, count(*) AS n FROM conversations GROUP BY ALL)
SELECT conv_id, v::BIGINT AS mode FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, f) AS r FROM a) WHERE r = 1""")
def block_mode(spark, sf):
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.floor(F.length("text") / 50).cast("long").alias("v")))).alias("s"))
    return rows.select("conv_id", S.mode_first(F.col("s.v")).alias("mode"))


def _conversations(spark, sf, value) -> DataFrame:
    """conv_id and one value a turn, in order."""
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", value.alias("v")))).alias("s"))
    return rows.select("conv_id", F.col("s.turn").alias("turns"), F.col("s.v").alias("content"))


@query("SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at, length(text) AS n, coalesce(lead(length(text)) OVER (PARTITION BY conv_id ORDER BY turn), 0) AS next_n FROM conversations")
def lazy_lead(spark, sf):
    """Positions, lengths and following lengths of tokens: the turns of a conversation as the matches of a block."""
    def kernel(lengths):
        block = inflate.Block(tokens=[(int(n), 1) for n in lengths], out_size=int(sum(lengths)))
        return [[int(at), int(n), int(later)] for at, n, _, later in decisions.positions(inflate.Stream([block]))]

    made = _make(_conversations(spark, sf, F.length("text").cast("long")), "t", kernel, "array<array<bigint>>")
    rows = made.select("conv_id", F.explode(F.arrays_zip("turns", "t")).alias("x"))
    return rows.select("conv_id", F.col("x.turns").alias("turn"), *[F.col("x.t")[i].alias(n) for i, n in enumerate(("at", "n", "next_n"))])


@query("""WITH a AS (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, role = 'user' ORDER BY turn) AS g FROM conversations),
r AS (SELECT conv_id, g, count(*) AS n FROM a WHERE role = 'user' GROUP BY ALL),
p AS (SELECT conv_id, count_if(role <> 'user' AND before <> 'user') AS pairs FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) GROUP BY conv_id)
SELECT p.conv_id, count(n) AS runs, coalesce(max(n), 0) AS longest, count_if(n = 1)::BIGINT AS run1, pairs::BIGINT AS pairs FROM p LEFT JOIN r ON r.conv_id = p.conv_id GROUP BY p.conv_id, pairs""")
def literal_runs(spark, sf):
    """Literal runs and matches after matches of a block: a user's turns as literals, all others as matches."""
    def kernel(roles):
        tokens = inflate.Tokens()
        tokens.symbol = [0 if r == "user" else 256 for r in roles]
        tokens.length = tokens.distance = [3] * sum(r != "user" for r in roles)
        block = inflate.Block()
        tokens.describe(block)
        return block.runs, block.run_max, block.run1, block.match_after_match

    made = _make(_conversations(spark, sf, F.col("role")), "b", kernel, "struct<runs:bigint,longest:bigint,run1:bigint,pairs:bigint>")
    return made.select("conv_id", "b.*")


@query("""WITH h AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL), d AS (SELECT day, sum(n) AS t, -sum(n * log2(n / tt)) AS bits FROM (SELECT *, sum(n) OVER (PARTITION BY day) AS tt FROM h) GROUP BY day),
o AS (SELECT day, t, bits, lag(day) OVER (ORDER BY day) AS prev, lag(bits) OVER (ORDER BY day) AS pbits FROM d),
m AS (SELECT o.day, event_type, sum(n) AS n FROM o JOIN h ON h.day = o.day OR h.day = o.prev WHERE prev IS NOT NULL GROUP BY ALL), mb AS (SELECT day, -sum(n * log2(n / tt)) AS merged FROM (SELECT *, sum(n) OVER (PARTITION BY day) AS tt FROM m) GROUP BY day)
SELECT o.day::VARCHAR AS day, round(merged - bits - pbits, 3) AS gain FROM o JOIN mb ON o.day = mb.day""")
def boundary_gain(spark, sf):
    """What a block border saves, in bits: neighbouring days' event histograms as the tables of two blocks."""
    kinds = sorted(r[0] for r in table(spark, sf, "events").select("event_type").distinct().collect())
    h = table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(F.array(*[F.count_if(F.col("event_type") == k) for k in kinds]).alias("h"))
    own = Window.orderBy("day")  # one row a day
    pairs = h.select("day", F.array("h", F.lag("h").over(own)).alias("content")).where("content[1] is not null")
    made = _make(pairs, "gain", lambda c: float(decisions.merging_cost([list(map(int, c[0]))], [list(map(int, c[1]))])), "double")
    return made.select(F.col("day").cast("string").alias("day"), F.round("gain", 3).alias("gain"))


@query("""WITH a AS (SELECT l_orderkey AS id, l_linenumber AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem)
SELECT a.id, a.i FROM a WHERE a.n <= 4 OR EXISTS (SELECT 1 FROM range(4) r(j) WHERE j * (a.n - 1) // 3 = a.i)""")
def even_sampling(spark, sf):
    """Evenly spaced items of a sequence: the entries of stand-in archives, four of each."""
    sizes = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("content"))
    picked = _make(sizes, "i", lambda n: decisions.evenly(int(n), 4), "array<bigint>")
    return picked.select("id", F.explode("i").alias("i"))


@query("SELECT c_custkey, sum(CASE WHEN l > 0 THEN 1 << (15 - l) ELSE 0 END)::BIGINT AS kraft, sum(CASE WHEN l > 0 THEN 1 << (15 - l) ELSE 0 END) <= 32768 AS ok, sum(l * i)::BIGINT AS cost FROM (SELECT c_custkey, i, ((c_custkey * i) % 6)::INTEGER AS l FROM customer, range(1, 9) r(i)) GROUP BY c_custkey")
def kraft_check(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: ((F.col("c_custkey") * i) % 6).cast("int")).alias("l"))
    k = S.kraft(F.col("l"))
    return c.select("c_custkey", k.alias("kraft"), (k <= 32768).alias("ok"), S.cost(F.col("l"), F.sequence(F.lit(1), F.lit(8))).alias("cost"))


@query("SELECT n_nationkey, n_name AS back, 8 * strlen(n_name) AS n_bits FROM nation")
def bits_roundtrip(spark, sf):
    """Bytes to message bits and back."""
    names = table(spark, sf, "nation").select("n_nationkey", F.encode("n_name", "utf-8").alias("content"))

    def kernel(data):
        bits = covert.to_bits(bytes(data))
        return covert.to_bytes(bits).decode(), len(bits)

    return _make(names, "m", kernel, "struct<back:string,n_bits:bigint>").select("n_nationkey", "m.*")


@query("""WITH o AS (SELECT doc_id, n_chars % 8 AS cap, coalesce(sum(n_chars % 8) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents)
SELECT doc_id, greatest(0, least(cap, 64 - before))::BIGINT AS bits, least(before, 64)::BIGINT AS start FROM o""")
def message_spread(spark, sf):
    """Where a 64-bit message lies over the paddings of each source's streams."""
    d = table(spark, sf, "documents").groupBy("source").agg(F.sort_array(F.collect_list(F.struct("doc_id", (F.col("n_chars") % 8).cast("int").alias("cap")))).alias("s"))
    made = _make(d.select(F.col("s.doc_id").alias("ids"), F.col("s.cap").alias("content")), "m", lambda rooms: [[int(a), int(n)] for a, n in covert.shares([int(r) for r in rooms], 64)], "array<array<bigint>>")
    return made.select(F.explode(F.arrays_zip("ids", "m")).alias("x")).select(F.col("x.ids").alias("doc_id"), F.col("x.m")[1].alias("bits"), F.col("x.m")[0].alias("start"))


# ---- kernels whose results depend on the encoder build: invariants in SQL ------------------------------------------


@query("SELECT doc_id, true AS proven FROM documents WHERE strlen(coalesce(text, '')) >= 0")
def proof_zlib(spark, sf):
    """Streams made by zlib are proven by exact re-encoding."""
    made = compressed(spark, sf, ("zlib", "9"))
    out = streams.decode(made.withColumn("raw", F.col("payload")), output=True)
    return streams.proofs(out, "raw", "output").select("doc_id", F.col("zlib_proof").isNotNull().alias("proven"))


EDITED = "SELECT doc_id AS path, ['p' || (doc_id % 4)] AS named, 'inconsistent' AS status, CASE WHEN doc_id % 2 = 0 THEN 'own' ELSE 'zlib-api' END AS rarer FROM documents"


def edited_archives(spark, sf) -> DataFrame:
    """Entries of an archive a document: four parts of markup seeded by the document, three by one encoder, one by another."""
    docs = spread(table(spark, sf, "documents").select("doc_id"), "doc_id")

    def run(batches):
        import hashlib

        import pyarrow as pa

        for b in batches:
            out = []
            for d in b.column(0).to_pylist():
                for part in range(4):
                    digests = [hashlib.md5(f"{d}:{part}:{i // 3}".encode()).hexdigest() for i in range(150)]
                    data = "".join(f"<row id='{i}'><v>{h[: 8 + i % 24]}</v></row>" for i, h in enumerate(digests)).encode()
                    own = (part == d % 4) == (d % 2 == 0)
                    out.append((d, f"p{part}", part, encoders.own_raw(data, "lazy") if own else encoders.zlib_raw(data)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int32(), pa.binary()))] if out else [], names=["path", "name", "index", "payload"])

    made = docs.mapInArrow(run, "path long, name string, index int, payload binary")
    out = streams.decode(made, blocks=False, prove=["own"])
    return out.select("path", "name", "index", "error", "capped", "ending", F.col("compressed_bytes").alias("size"), "n_matches", "zlib_proof", "reproduced")


@query(EDITED)
def edited_parts(spark, sf):
    """The part that another encoder made is proven and named, though the model takes every part for zlib's or for unknown."""
    rows = edited_archives(spark, sf)
    provable = (F.col("size") >= V.PROOF_BYTES) & (F.col("n_matches") >= V.PROOF_MATCHES)
    proven = F.col("zlib_proof").isNotNull() & provable
    unknown = ~proven & (F.col("index") == 0)
    rows = rows.select("*", provable.alias("provable"), F.when(proven, "zlib").alias("proof"), F.col("zlib_proof").alias("setting"), F.col("zlib_proof").isNotNull().cast("int").alias("zlib_hits"), F.when(unknown, V.UNKNOWN).otherwise(V.ATTRIBUTED).alias("status"),
                       F.when(proven, "zlib").otherwise("own").alias("label"), F.when(proven, 1.0).otherwise(0.6).alias("confidence"), F.create_map(F.lit("own"), F.lit(0.4), F.lit("zlib"), F.lit(0.6)).alias("proba"))
    done = E.cut(proofs.proven(E.cut(rows)))
    a = done.groupBy("path").agg(F.lit("zip").alias("kind"), F.lit(None).cast("string").alias("claim"), F.array().cast("array<int>").alias("option_bits_seen"), F.array().cast("array<string>").alias("duplicate_names"), F.lit(0).alias("encrypted"), F.lit(0).alias("backslash_names"))
    sides = proofs.sides(done)
    found = V.verdicts(done, a, ["zlib", "own"], sides)
    return found.join(sides.select("path", V.family(F.col("side_odd")[0]).alias("rarer")), "path", "left").select("path", "named", "status", "rarer")


@query("SELECT doc_id, 'flush' AS ending, 'data' AS plain FROM documents WHERE strlen(text) > 0")
def stream_endings(spark, sf):
    made = streams.compress(spread(sources(spark, sf).where(F.octet_length("content") > 0), "doc_id"), [("zlib", "6"), ("zlib", "6f")])
    ends = streams.decode(made).select("doc_id", "setting", rules.ending().alias("e"))
    return ends.groupBy("doc_id").agg(F.max(F.when(F.col("setting") == "6f", F.col("e"))).alias("ending"), F.max(F.when(F.col("setting") == "6", F.col("e"))).alias("plain"))


@query("SELECT doc_id, 'no-lz77-matches' AS rule FROM documents WHERE strlen(text) > 64")
def signature_rules(spark, sf):
    """Huffman-only streams hit the rule for streams without matches."""
    made = streams.compress(spread(sources(spark, sf).where(F.octet_length("content") > 64), "doc_id"), [("zlib-strategies", "huff")])
    return streams.decode(made).select("doc_id", F.explode(rules.signatures()).alias("h")).where("h.rule = 'no-lz77-matches'").select("doc_id", F.col("h.rule").alias("rule"))


@query("SELECT doc_id, true AS same, true AS readable FROM documents")
def rewrite_zip(spark, sf):
    """Writing what was read gives the same bytes; a normalised archive keeps its content."""
    def check(d):
        data = bytes(d)
        made = rewrite.write_zip([rewrite.deflated("a.xml", data, encoders.zlib_raw(data)), rewrite.stored("b.txt", data[:50])], b"note")
        same = rewrite.write_zip(*rewrite.read_zip(made)) == made
        return same, rewrite.content(rewrite.read_zip(rewrite.normalise(made))[0][0]) == data

    return _make(spread(sources(spark, sf), "doc_id"), "m", check, "struct<same:boolean,readable:boolean>").select("doc_id", "m.*")


@query("SELECT doc_id, true AS content_kept FROM documents")
def covert_padding(spark, sf):
    """Bits hidden in the padding leave the content as it was, and are found again."""
    def check(d):
        import zlib

        data, bits = bytes(d), [1, 0, 1, 1, 0, 1, 1]
        raw = encoders.zlib_raw(data)
        hidden = covert.embed(raw, bits)
        room = inflate.parse(raw).pad_bits
        return zlib.decompress(hidden, -15) == data and covert.extract(hidden, 7) == bits[:room]

    return _make(spread(sources(spark, sf), "doc_id"), "content_kept", check, "boolean").select("doc_id", "content_kept")


@query("""WITH d AS (SELECT doc_id, strlen(coalesce(text, ''))::DOUBLE AS n FROM documents)
SELECT doc_id, true AS finite, 213 AS features, n AS tok_count, (n > 0)::INT::DOUBLE AS tok_literal_ratio, 0.0::DOUBLE AS tok_match_ratio, (n > 0)::INT::DOUBLE AS tok_per_out_byte, 0.0::DOUBLE AS tok_coverage_by_matches,
 0.0::DOUBLE AS len_entropy, 0.0::DOUBLE AS dis_gini, round(log10(n + 1), 6) AS str_out_size_log, 0.0::DOUBLE AS str_has_error, 0.0::DOUBLE AS dec_match_longest_frac FROM d""")
def feature_vectors(spark, sf):
    """The whole feature vector of every document's stream without matches, and the features that its size decides."""
    made = streams.compress(spread(sources(spark, sf), "doc_id"), [("zlib-strategies", "huff")])
    f = features.stream_features(made, max_bytes=None)
    chosen = ["tok_count", "tok_literal_ratio", "tok_match_ratio", "tok_per_out_byte", "tok_coverage_by_matches", "len_entropy", "dis_gini", "str_out_size_log", "str_has_error", "dec_match_longest_frac"]
    at = {n: F.get("f", F.lit(i)) for i, n in enumerate(features.names())}
    values = [(F.round(at[n], 6) if n.endswith("log") else at[n]).alias(n) for n in chosen]
    return f.select("doc_id", F.forall("f", lambda x: ~F.isnan(x) & (F.abs(x) < 1e300)).alias("finite"), F.size("f").alias("features"), *values)


def described(spark, sf) -> DataFrame:
    """Corpus rows of every document at three settings of two profiles."""
    made = compressed(spark, sf, ("zlib", "1"), ("zlib", "6"), ("zlib-strategies", "huff"))
    rows = features.stream_features(made.withColumnRenamed("doc_id", "id"))
    return rows.select("id", "setting", F.col("id").cast("string").alias("source_id"), F.col("encoder").alias("profile"), F.lit(False).alias("synthetic"), "compressed_bytes", "f")


def _fitted(spark, sf):
    from flatewise.plans import model

    rows = E.cut(described(spark, sf))
    return rows, model.fit(rows, trees=10, depth=6)


SETTINGS = "(SELECT unnest(['1', '6', 'huff']) AS setting)"


@query(f"SELECT doc_id AS id, setting, true AS adds_up, true AS named FROM documents, {SETTINGS}")
def rf_explanations(spark, sf):
    """A forest fitted on every document's streams; for each stream the contributions and the bias add up to the forest's
    probability of the top profile, and every contribution has a meaning."""
    rows, model = _fitted(spark, sf)
    out = model.explain(rows)
    top = F.element_at("raw", F.array_position(F.array(*map(F.lit, model.classes)), F.col("top")).cast("int"))
    return out.select("id", "setting", (F.abs(F.col("total") - top) < 1e-9).alias("adds_up"), F.forall("explanation", lambda e: e["meaning"] != e["feature"]).alias("named"))


@query(f"SELECT setting, count(*) AS n, true AS consistent FROM documents, {SETTINGS} GROUP BY setting")
def rf_predict(spark, sf):
    """Open-set prediction of every stream: a label is a class or unknown, unknown exactly where the model abstains."""
    rows, model = _fitted(spark, sf)
    out = model.predict(rows)
    fine = (F.col("abstained") == (F.col("label") == "unknown")) & (F.col("label").isin("unknown", *model.classes)) & F.col("confidence").between(0.0, 1.0)
    return out.groupBy("setting").agg(F.count("*").alias("n"), F.bool_and(fine).alias("consistent"))


@query("SELECT doc_id, true AS found FROM documents")
def reencode_panel(spark, sf):
    """Every available encoder and setting is tried on a stream: the one that made it is among those that reproduce it."""
    def check(d):
        data = bytes(d)
        return ("zlib", "1") in encoders.panel(encoders.zlib_raw(data, 1), data)

    short = sources(spark, sf)
    return _make(spread(short, "doc_id"), "found", check, "boolean").select("doc_id", "found")


def queries() -> dict:
    return {name: function for name, (function, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
