"""Corpus hygiene and evaluation as relational plans: families, splits, calibration grids, novelty, metrics."""

from __future__ import annotations

import hashlib
import math
import re
import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flatewise.functions import stats as S

# fixed values: size bands, family thresholds
EDGES = [0, 256, 1024, 4096, 16384, 65536]
FAMILY_JACCARD, FAMILY_PREFIX, SKETCH = 0.5, 6, 128
BUCKETS = 1 << 18  # of values, for their order by rarity


def identical_outputs(rows: DataFrame) -> DataFrame:
    """Collapse (source, digest) groups: sorted label and profile sets; profile is null where several made it."""
    sets = rows.groupBy("source", "digest").agg(F.sort_array(F.collect_set("label")).alias("labels"), F.sort_array(F.collect_set("profile")).alias("profiles"))
    return sets.withColumn("profile", F.when(F.size("profiles") == 1, F.col("profiles")[0]))


def profile_sharing(rows: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Share of a program's outputs that its library's reference program makes too, and whether it merges."""
    reference = rows.where("program = library").select("source", "library", "digest").distinct().withColumn("same", F.lit(1))
    others = rows.where("program <> library").join(reference, ["source", "library", "digest"], "left")
    rate = others.groupBy("program", "library").agg(F.avg(F.coalesce("same", F.lit(0)).cast("double")).alias("rate"))
    return rate.withColumn("merges", F.col("rate") >= threshold)


def hash_parity(digest: Column) -> Column:
    """Split by the parity of a digest's first byte."""
    return F.when(F.conv(F.substring(digest, 1, 2), 16, 10).cast("int") % 2 == 0, "train").otherwise("holdout")


def sketch(texts: DataFrame, key: str, text: str = "text", width: int = 3, k: int = SKETCH, short: bool = False) -> DataFrame:
    """Bottom-k of md5 over a text's distinct shingles of `width` words (the whole of shorter texts): key, sketch (sorted).

    One pass over bytes in Arrow batches: digests are compared as bytes and only those kept are spelled out.  With
    `short` the values are the digests' first 64 bits as numbers of the same order.
    """
    schema = T.StructType([texts.schema[key], T.StructField("sketch", T.ArrayType(T.LongType() if short else T.StringType()))])

    space = re.compile(rb"[ \t\n\f\r]+")

    def made(t: bytes) -> list:
        # at an end of the text white space leaves an empty word; the SQL's \s has no vertical tab
        words = space.split(t) if b"\x0b" in t else [*[b""] * t[:1].isspace(), *t.split(), *[b""] * t[-1:].isspace()] or [b""]
        shingles = map(b" ".join, zip(*(words[i:] for i in range(width)))) if len(words) > width else [b" ".join(words)]
        least = sorted({hashlib.md5(s).digest() for s in shingles})[:k]
        return [int.from_bytes(d[:8]) - 2**63 for d in least] if short else [d.hex() for d in least]

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [made(t) for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64() if short else pa.string()))], names=[key, "sketch"])

    return texts.where(F.col(text).isNotNull()).select(key, F.lower(text)).mapInArrow(run, schema)


def sketch_jaccard(a: Column, b: Column, k: int = SKETCH) -> Column:
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    return S.ratio(F.size(F.array_intersect(F.array_intersect(union, a), b)), F.size(union))


def similar_sketches(sketches: DataFrame, key: str, threshold: float = FAMILY_JACCARD, k: int = SKETCH) -> DataFrame:
    """All pairs (a < b) whose sketch similarity reaches the threshold.

    Equal sketches are one class.  A similar pair has at least ceil(threshold * n) of either's n values in common, so the
    classes share a value among the first n - ceil(threshold * n) + 1 of each, in whatever order all keep to: an equi-join
    on those loses no candidate.  The order is by how often values of the same bucket occur, rare ones first; the table of
    bucket counts has a fixed size.  Similar classes give the pairs of their members.  Sketches are cut off first: they are
    read several times, and the filter would go below an exchange and make them anew for each word.
    """
    spark = sketches.sparkSession
    members = cut(sketches.select(F.col(key).alias("id"), F.xxhash64("sketch").alias("c"), "sketch")).where(F.size("sketch") > 0)
    classes = members.groupBy("c").agg(F.first("sketch").alias("sketch"))
    hashed = F.transform("sketch", lambda v: F.xxhash64(v))
    counts = members.select(F.explode(hashed).alias("h")).groupBy(F.pmod("h", F.lit(BUCKETS)).alias("k")).agg(F.count("*").alias("seen")).toArrow()
    seen = np.zeros(BUCKETS, np.int64)
    seen[counts["k"].to_numpy()] = counts["seen"].to_numpy()
    table = spark.sparkContext.broadcast(seen)

    def rarest(values):
        def first(v):
            take = len(v) - math.ceil(len(v) * threshold - 1e-9) + 1
            return v[np.lexsort((v, table.value[v % BUCKETS]))[:take]]

        return values.map(first)

    prefix = classes.select("c", F.explode(F.pandas_udf(rarest, "array<long>", F.PandasUDFType.SCALAR)(hashed)).alias("v"))
    x, y = prefix.select("v", F.col("c").alias("c")), prefix.select("v", F.col("c").alias("d"))
    near = x.join(y, "v").where("c < d").select("c", "d").distinct()
    full = near.join(classes.select("c", F.col("sketch").alias("x")), "c").join(classes.select(F.col("c").alias("d"), F.col("sketch").alias("y")), "d")
    linked = full.where(sketch_jaccard(F.col("x"), F.col("y"), k) >= threshold).select("c", "d")
    left, right = members.select("c", F.col("id").alias("i")), members.select(F.col("c").alias("d"), F.col("id").alias("j"))
    across = linked.join(left, "c").join(right, "d").select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
    within = left.join(right.withColumnRenamed("d", "c"), "c").where("i < j").select(F.col("i").alias("a"), F.col("j").alias("b"))
    return across.union(within)


def name_pairs(files: DataFrame, key: str, folder: str, stem: str, prefix: int = FAMILY_PREFIX) -> DataFrame:
    """Links between files of one folder whose names share a prefix: each to the group's least key (a star, not all pairs)."""
    named = files.where(F.length(stem) >= prefix).select(key, folder, F.substring(stem, 1, prefix).alias("_p"))
    w = Window.partitionBy(folder, "_p")
    return named.withColumn("a", F.min(key).over(w)).where(F.col("a") != F.col(key)).select("a", F.col(key).alias("b"))


def components(nodes: DataFrame, pairs: DataFrame, key: str, rounds: int = 60) -> DataFrame:
    """key, family: the least key reachable over pairs, by label propagation with pointer jumping until nothing changes.

    The session needs a checkpoint folder.  Labels that have not settled after `rounds` (2^60 steps) are an error.
    """
    both = pairs.select("a", "b").union(pairs.select("b", "a")).distinct()
    labels = nodes.select(F.col(key).alias("node"), F.col(key).alias("label"))
    for _ in range(rounds):
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("m"))
        stepped = labels.join(near, labels["node"] == near["a"], "left").select("node", "label", F.least("label", F.coalesce("m", "label")).alias("next"))
        hop = stepped.select(F.col("node").alias("h"), F.col("next").alias("n2"))
        after = cut(stepped.join(hop, stepped["next"] == hop["h"]).select("node", "label", F.least("next", "n2").alias("next")))
        labels = after.select("node", F.col("next").alias("label"))
        if not after.where("next <> label").limit(1).take(1):
            return labels.select(F.col("node").alias(key), F.col("label").alias("family"))
    raise RuntimeError(f"families did not settle in {rounds} rounds")


def cut(rows: DataFrame) -> DataFrame:
    """`rows` checkpointed in the session's folder; only a local session without one gets a folder of its own."""
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="flatewise-"))
    return rows.checkpoint()


def families(files: DataFrame, key: str, similar: DataFrame, named: DataFrame) -> DataFrame:
    """key, family over both kinds of links: similar content and similar names."""
    return components(files.select(key), similar.select("a", "b").union(named.select("a", "b")), key)


def unseen(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """`rows` whose key is not among the known ones: a second, independent test set."""
    return rows.join(known.select(key).distinct(), key, "left_anti")


def overlaps(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """`rows` whose key is among the known ones: what a leakage check reports."""
    return rows.join(known.select(key).distinct(), key, "left_semi")


def rates(rows: DataFrame, test: Column, *keys: str) -> DataFrame:
    """rate of a condition and n by every prefix of the keys, the whole included."""
    return rows.rollup(*keys).agg(F.avg(test.cast("double")).alias("rate"), F.count("*").alias("n"))


def family_split(families: DataFrame, fraction: float = 0.3) -> DataFrame:
    """kind, family, n, split: families in hash order go to test until the fraction of sources is reached.

    `families` has kind, family and n (its number of sources).  The order is by digest, so it needs no random state.
    """
    order = Window.partitionBy("kind").orderBy(F.md5(F.col("family").cast("string").cast("binary")), "family")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    want = F.round(F.sum("n").over(Window.partitionBy("kind")) * fraction)
    return families.select("kind", "family", "n", F.when(before < want, "test").otherwise("train").alias("split"))


def bands(spark) -> DataFrame:
    edges = [*EDGES, None]
    return spark.createDataFrame(list(zip(edges[:-1], edges[1:])), "lo long, hi long")


def size_bands(rows: DataFrame, size: str = "size") -> DataFrame:
    """lo, n, answered, accuracy, accuracy_answered and pooled accuracy of the band and all larger ones."""
    in_band = (F.col(size) >= F.col("lo")) & (F.col("hi").isNull() | (F.col(size) < F.col("hi")))
    each = rows.join(F.broadcast(bands(rows.sparkSession)), in_band).groupBy("lo").agg(
        F.count("*").alias("n"), F.count_if("answered").alias("answered"), F.avg(F.col("correct").cast("double")).alias("accuracy"), F.count_if(F.col("answered") & F.col("correct")).alias("right"))
    up = Window.orderBy("lo").rowsBetween(Window.currentRow, Window.unboundedFollowing)  # six rows
    pooled = S.ratio(F.sum("right").over(up), F.sum("answered").over(up))
    return each.select("lo", "n", "answered", "accuracy", S.ratio(F.col("right"), F.col("answered")).alias("accuracy_answered"), pooled.alias("pooled"))


def least_evidence(banded: DataFrame, target: float = 0.9, least: int = 10) -> DataFrame:
    """least_size: the first band that reaches the target by itself and with all larger ones."""
    ok = (F.col("answered") >= least) & (F.col("accuracy_answered") >= target) & (F.col("pooled") >= target)
    return banded.agg(F.coalesce(F.min(F.when(ok, F.col("lo"))), F.lit(EDGES[-1]).cast("long")).alias("least_size"))


def threshold_pick(rows: DataFrame, target: float, never: float = 0.99) -> DataFrame:
    """threshold: the least of 60 grid values whose kept rows (enough of them) reach the target precision.

    A grid step only needs counts of the rows by confidence cell, so the rows are grouped once and the grid meets cells.
    """
    grid = rows.sparkSession.range(60).select((F.lit(0.4) + F.col("id") * 0.01).alias("t"))
    cells = rows.groupBy(F.floor((F.col("confidence") - 0.4) / 0.01 + 1e-9).alias("cell")).agg(F.count("*").alias("n"), F.count_if("correct").alias("right"))
    total = cells.agg(F.sum("n").alias("total"))
    kept = grid.join(cells, F.round((F.col("t") - 0.4) / 0.01) <= F.col("cell")).groupBy("t").agg(F.sum("n").alias("kept"), F.sum("right").alias("right"))
    ok = kept.join(F.broadcast(total)).where((F.col("kept") >= F.greatest(F.lit(5), F.floor(F.col("total") * 0.05))) & (F.col("right") / F.col("kept") >= target))
    return ok.agg(F.round(F.coalesce(F.min("t"), F.lit(never)), 3).alias("threshold"))


def let(value: Column, body) -> Column:
    """body(value), with `value` computed once a row however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def log_scores(proba: Column) -> Column:
    """Logarithms of probabilities, taken as 1e-9 at least."""
    return F.transform(proba, lambda p: F.log(F.least(F.greatest(p, F.lit(1e-9)), F.lit(1.0))))


def temperatures(rows: DataFrame, proba: str = "proba", truth: str = "truth") -> DataFrame:
    """t, nll of 61 temperatures on held-out rows: proba is an array, truth its 1-based index.

    The loss only needs the true class's logarithm and the logarithm of the sum, so a row costs one pass a temperature.
    """
    grid = F.broadcast(rows.sparkSession.range(61).select((F.lit(0.25) + F.col("id") * (3.75 / 60)).alias("t")))
    logs = rows.select(log_scores(F.col(proba)).alias("logs"), truth).select("logs", F.array_max("logs").alias("top"), F.element_at("logs", F.col(truth)).alias("own"))
    total = F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp((x - F.col("top")) / F.col("t")))
    loss = F.least(F.log(total) - (F.col("own") - F.col("top")) / F.col("t"), F.lit(-math.log(1e-9)))
    return logs.crossJoin(grid).groupBy("t").agg(F.avg(loss).alias("nll"))


def calibrated(proba: Column, t: Column) -> Column:
    """softmax(log p / t) with p at least 1e-9."""
    scaled = lambda s: F.transform(s["logs"], lambda x: F.exp((x - s["top"]) / t))
    powers = let(let(log_scores(proba), lambda logs: F.struct(logs.alias("logs"), F.array_max(logs).alias("top"))), scaled)
    return let(let(powers, lambda x: F.struct(x.alias("x"), S.total(x).alias("sum"))), lambda s: F.transform(s["x"], lambda x: x / s["sum"]))


def standardise(rows: DataFrame, columns: list[str], clip: float = 10.0) -> DataFrame:
    """Columns scaled by mean and population deviation of all rows, clipped; constant columns become 0."""
    moments = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    joined = rows.join(F.broadcast(moments))
    scaled = lambda c: F.greatest(F.least((F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") < 1e-9, 1.0).otherwise(F.col(f"s_{c}")), F.lit(clip)), F.lit(-clip))
    return joined.select(*[c for c in rows.columns if c not in columns], *[scaled(c).alias(c) for c in columns])


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def reference_rows(vectors: DataFrame, per_class: int = 400) -> DataFrame:
    """A bounded number of reference vectors for each class, in hash order."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy(F.md5(F.col("id").cast("string").cast("binary")), "id"))
    return vectors.withColumn("_r", rank).where(F.col("_r") <= per_class).drop("_r")


def class_scales(refs: DataFrame, floor: float = 0.05) -> DataFrame:
    """label, scale: median non-zero distance of a reference to its nearest fellow (references are bounded by class)."""
    a, b = refs.select("label", F.col("id").alias("i"), F.col("v").alias("x")), refs.select("label", F.col("id").alias("j"), F.col("v").alias("y"))
    near = a.join(b, "label").where("i <> j").groupBy("label", "i").agg(F.min(distance(F.col("x"), F.col("y"))).alias("d"))
    found = near.where("d > 1e-9").groupBy("label").agg(F.expr("percentile(d, 0.5)").alias("d"))
    return refs.select("label").distinct().join(found, "label", "left").select("label", F.greatest(F.coalesce("d", F.lit(1.0)), F.lit(floor)).alias("scale"))


def nearest_reference(vector: Column, references: list[tuple[float, list[float]]], columns: list[int] | None = None) -> Column:
    """Least scaled distance of a vector (or of some of its columns) to (scale, reference) pairs, in Arrow batches.

    References are at most 400 a class, so they travel with the function.
    """
    if not references:
        return F.lit(float("inf"))
    scales, known = np.array([s for s, _ in references]), np.array([v for _, v in references], float)
    lengths = (known**2).sum(1)

    def nearest(vectors):
        import pandas as pd

        x = np.array(vectors.tolist(), float).reshape(len(vectors), -1)
        x = x if columns is None else x[:, columns]
        squares = (x**2).sum(1)[:, None] + lengths[None, :] - 2 * x @ known.T
        return pd.Series((np.sqrt(np.maximum(squares, 0)) / scales[None, :]).min(axis=1))

    return F.pandas_udf(nearest, "double", F.PandasUDFType.SCALAR)(vector)


def novelty(rows: DataFrame, refs: DataFrame, scales: DataFrame) -> DataFrame:
    """id, novelty: least scaled distance to any class's references (a bounded number a class)."""
    known = [(r["scale"], list(r["v"])) for r in refs.join(scales, "label").select("scale", "v").collect()]
    return rows.select("id", nearest_reference(F.col("v"), known).alias("novelty"))


def balanced_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """label, n, weight n_total / (classes * n)."""
    each = rows.groupBy(label).agg(F.count("*").alias("n"))
    whole = each.agg(F.sum("n").alias("total"), F.count("*").alias("classes"))
    return each.join(F.broadcast(whole)).select(label, "n", (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight"))


def class_metrics(rows: DataFrame) -> DataFrame:
    """profile, support, precision, recall, f1, from truth and predicted (null: no answer, a miss for recall)."""
    seen = rows.groupBy("truth").agg(F.count("*").alias("support"), F.count_if(F.col("truth") == F.col("predicted")).alias("tp")).withColumnRenamed("truth", "profile")
    said = rows.where("predicted is not null").groupBy("predicted").agg(F.count("*").alias("said")).withColumnRenamed("predicted", "profile")
    both = seen.join(said, "profile", "full").na.fill(0, ["support", "tp", "said"])
    p, r = S.ratio(F.col("tp"), F.col("said")), S.ratio(F.col("tp"), F.col("support"))
    return both.select("profile", "support", p.alias("precision"), r.alias("recall"), S.ratio(2 * p * r, p + r).alias("f1"))


def closed_set(rows: DataFrame) -> DataFrame:
    """n, forced accuracy, end-to-end accuracy, coverage, accuracy where answered: rows have truth, top, answered."""
    right = F.col("truth") == F.col("top")
    return rows.agg(F.count("*").alias("n"), F.avg(right.cast("double")).alias("accuracy"), F.avg((right & F.col("answered")).cast("double")).alias("end_to_end_accuracy"), F.avg(F.col("answered").cast("double")).alias("coverage"),
                    F.coalesce(F.avg(F.when(F.col("answered"), right.cast("double"))), F.lit(0.0)).alias("accuracy_answered"))


def confusion(rows: DataFrame, labels: list[str]) -> DataFrame:
    """truth by predicted counts; `none` counts rows without an answer."""
    return rows.groupBy("truth").pivot("predicted_or_none", [*labels, "none"]).count().na.fill(0)


def stratified(rows: DataFrame, label: str, key: str, k: int) -> DataFrame:
    """At most k rows a label, in hash order."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy(F.md5(F.col(key).cast("string").cast("binary")), key))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)
