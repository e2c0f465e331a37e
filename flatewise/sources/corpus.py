"""Sources of a training corpus and the corpus itself: generated content, files, every encoder setting, features.

`build` crosses sources with settings, drops failures to a table of their own, collapses identical outputs and describes
each stream.  All splits and samples go by digest, so results do not depend on partitioning.
"""

from __future__ import annotations

import hashlib
import random
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flatewise.functions import features
from flatewise.operators import encoders, inflate, streams
from flatewise.plans import evaluation
from flatewise.sources import containers

# fixed values: sizes and bounds of corpus files
SIZES = (300, 1500, 6000, 24000, 90000, 300000)
KINDS = ("text", "xml", "source", "json", "csv", "binary", "random", "rle")
LEAST_BYTES, MOST_BYTES = 200, 256_000
PACKED = ("504B0304", "1F8B", "89504E47", "25504446", "FFD8FF", "377ABCAF", "425A68", "FD377A58", "28B52FFD")
WORDS = "stream block token length distance window table code symbol literal match header value index offset entry archive report order record".split()


def generate(kind: str, size: int, k: int, seed: int = 0) -> bytes:
    """Deterministic content of one kind and at least the given size, cut to it."""
    rng = random.Random(hashlib.sha256(f"{seed}:{kind}:{size}:{k}".encode()).digest())
    word = lambda: rng.choice(WORDS)
    makers = {
        "text": lambda: (" ".join(word() for _ in range(rng.randint(6, 16))).capitalize() + ". ").encode(),
        "xml": lambda: f'<row id="{rng.randint(1, 9999)}"><{word()}>{rng.random():.4f}</{word()}><v>{word()}</v></row>\n'.encode(),
        "source": lambda: f"def {word()}_{rng.randint(0, 99)}({word()}, {word()}):\n    return {word()} + {rng.randint(0, 999)}\n\n".encode(),
        "json": lambda: f'{{"id": {rng.randint(0, 10**6)}, "{word()}": "{word()} {word()}", "ok": {rng.choice(("true", "false"))}}},\n'.encode(),
        "csv": lambda: f"{rng.randint(0, 10**6)},{word()},{rng.random():.3f},{rng.randint(2000, 2030)}-{rng.randint(1, 12):02d}\n".encode(),
        "binary": lambda: rng.choice([rng.randbytes(rng.randint(20, 400)), struct.pack("<IHhd", rng.randrange(1 << 32), rng.randrange(300), rng.randint(-9, 9), rng.random()) * rng.randint(1, 4), bytes(rng.randint(1, 40))]),
        "random": lambda: rng.randbytes(512),
        "rle": lambda: bytes([rng.randint(32, 90)]) * rng.randint(3, 400),
    }
    make, parts, n = makers[kind], [], 0
    while n < size:
        parts.append(make())
        n += len(parts[-1])
    return b"".join(parts)[:size]


def synthetic(spark: SparkSession, kinds=KINDS, sizes=SIZES, per: int = 1, seed: int = 0) -> DataFrame:
    """source_id, content_type, content, origin of generated sources."""
    ids = [(f"syn:{kind}:{size}:{k}", kind, size, k) for kind in kinds for size in sizes for k in range(per)]

    def run(batches):
        for b in batches:
            made = [generate(kind, size, k, seed) for kind, size, k in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary()), pa.array(["synthetic"] * len(made))], names=["source_id", "content_type", "content", "origin"])

    plan = spark.createDataFrame(ids, "source_id string, content_type string, size int, k int").repartition(spark.sparkContext.defaultParallelism)
    return plan.mapInArrow(run, "source_id string, content_type string, content binary, origin string")


def directory(files: DataFrame, limit: int | None = None, label: str = "file") -> DataFrame:
    """Sources from (path, content) rows: unpacked formats of a size, cut, one a digest, in the order of their path's digest.

    A file that is one GZIP member and nothing else (a packed text) is taken unpacked.
    """
    files = unpacked(files)
    head = F.hex(F.substring("content", 1, 4))
    plain = files.where(F.octet_length("content") >= LEAST_BYTES).where(~F.exists(F.array(*map(F.lit, PACKED)), lambda p: head.startswith(p)))
    cut = plain.withColumn("content", F.expr(f"substring(content, 1, {MOST_BYTES})")).withColumns({"digest": F.sha2("content", 256), "order": F.sha2(F.col("path").cast("binary"), 256)})
    first = cut.withColumn("r", F.row_number().over(Window.partitionBy("digest").orderBy("order"))).where("r = 1").drop("r")
    rows = first.orderBy("order").limit(limit) if limit else first
    return rows.select(F.concat(F.lit(f"{label}:"), "path").alias("source_id"), F.lit(label).alias("content_type"), "content", F.col("path").alias("origin"))


def unpacked(files: DataFrame) -> DataFrame:
    """(path, content) with the content of whole GZIP files in place of the files; what does not decode stays as it is."""

    def gunzip(content):
        def one(data):
            try:
                found = containers.scan_gzip(bytes(data), "")["streams"] if data is not None else []
            except containers.ContainerError:
                found = []
            record = inflate.parse(found[0]["payload"], max_out=16 * MOST_BYTES) if len(found) == 1 else None
            return data if record is None or record.error else record.output

        return content.map(one)

    packed = F.hex(F.substring("content", 1, 2)) == "1F8B"
    rows = files.select("path", "content")
    return rows.where(~F.coalesce(packed, F.lit(False))).union(rows.where(packed).select("path", F.pandas_udf(gunzip, "binary", F.PandasUDFType.SCALAR)("content").alias("content")))


def documents_in(spark: SparkSession, path: str, suffixes=(".docx", ".xlsx", ".pptx", ".odt", ".ods", ".odp", ".zip", ".jar", ".epub", ".apk")) -> DataFrame:
    """Files below a path that have one of the suffixes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.where(containers.suffix_column(F.col("path")).isin(*suffixes))


def settings(synthetic_too: bool = True) -> list[tuple[str, str]]:
    return [(e.name, s) for e in encoders.list_encoders(True, synthetic_too) for s in e.settings]


def build(sources: DataFrame, pairs: list[tuple[str, str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): described streams with their label sets, and settings that did not give back their source.

    Identical outputs of one source are decoded and described once.
    """
    made = streams.compress(sources.withColumn("sha", F.sha2("content", 256)), pairs or settings())
    made = made.withColumns({"hash": F.sha2("payload", 256), "profile": library_of(F.col("encoder")), "label": F.concat_ws(":", "encoder", "setting")}).checkpoint()
    groups = made.groupBy("source_id", "hash").agg(
        F.sort_array(F.collect_set("label")).alias("labels"), F.sort_array(F.collect_set("profile")).alias("profiles"), F.first("payload").alias("payload"), F.first("sha").alias("sha"), F.first("content_type").alias("content_type"),
        F.bool_and(F.col("encoder").isin(*[e.name for e in encoders.REGISTRY.values() if e.synthetic])).alias("synthetic"))
    checked = streams.decode(groups, output=True, keep=["source_id", "hash", "labels", "sha"])
    bad = checked.where(F.col("error").isNotNull() | (F.sha2("output", 256) != F.col("sha"))).select("source_id", "hash", "labels", "error")
    good = groups.join(bad.select("source_id", "hash"), ["source_id", "hash"], "left_anti").withColumn("profile", F.when(F.size("profiles") == 1, F.col("profiles")[0]))
    keep = ["source_id", "content_type", "hash", "labels", "profiles", "profile", "synthetic"]
    return features.stream_features(good.select("payload", *keep)), bad


def library_of(encoder):
    """Profile of an encoder: its library."""
    names = F.create_map(*[F.lit(x) for e in encoders.REGISTRY.values() for x in (e.name, e.library)])
    return F.element_at(names, encoder)


def save(rows: DataFrame, path: str) -> None:
    """Corpus as Parquet, with the feature names beside it."""
    rows.write.mode("overwrite").parquet(f"{path}/rows")
    rows.sparkSession.createDataFrame([(i, n) for i, n in enumerate(features.names())], "i int, name string").coalesce(1).write.mode("overwrite").parquet(f"{path}/names")


def load(spark: SparkSession, path: str) -> DataFrame:
    """A saved corpus; one made with other features is refused."""
    names = [r["name"] for r in spark.read.parquet(f"{path}/names").orderBy("i").collect()]
    if names != features.names():
        raise ValueError("the corpus was made with other features")
    return spark.read.parquet(f"{path}/rows")


def sharing(made: DataFrame) -> DataFrame:
    """Which programs share their library's profile, by identical outputs (source_id, hash, encoder)."""
    rows = made.select(F.col("source_id").alias("source"), F.col("hash").alias("digest"), F.col("encoder").alias("program"), library_of(F.col("encoder")).alias("library"))
    return evaluation.profile_sharing(rows)
