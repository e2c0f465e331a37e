"""Helpers shared by the corpus operators.

Two shuffle idioms recur.  *Row shuffles* go through ordinary DataFrame exchanges.  *Blob shuffles* are for tens of
millions of tiny fixed-width records: a map task sorts its records by target slot with numpy and emits one binary
row for each slot, so Spark moves few large rows instead of many small ones; the reduce side concatenates the blobs
of its slots.  Slots are a pure function of the record, so recomputed tasks write the same rows.
"""

from __future__ import annotations

import ctypes
import gc
import tempfile

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
try:
    LIBC = ctypes.CDLL("libc.so.6")
    LIBC.malloc_trim  # noqa: B018  other C libraries lack it
except (OSError, AttributeError):
    LIBC = None
MIX_STEP = 0x9E3779B97F4A7C15


def shuffle_width(spark: SparkSession) -> int:
    """Number of reduce slots: the session's shuffle partitions, which the cluster sizes to the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; only a local session without one (tests) gets a private one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="flatewise-checkpoint-"))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep the Arrow batches of text rows small: ten thousand long documents at once would fill a Python worker."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


SETTLED = False


def settle() -> None:
    """Once in a Python worker: leave what it has loaded out of later collections.  Workers collect garbage after every task,
    which takes 35 ms for the modules alone."""
    global SETTLED
    if not SETTLED and TaskContext.get() is not None:
        SETTLED = True
        gc.collect()
        gc.freeze()


def trim() -> None:
    """Give freed memory of a Python worker back to the system; workers outlive their tasks."""
    settle()
    pa.default_memory_pool().release_unused()
    if LIBC is not None:
        LIBC.malloc_trim(0)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise `df` in the shared checkpoint folder and cut its lineage; what earlier steps shuffled may go first."""
    with_checkpoint_dir(df.sparkSession)
    release(df.sparkSession)
    return df.checkpoint(eager=True)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, vectorised (uint64 in, uint64 out)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(33)
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def texts_of(column: pa.ChunkedArray | pa.Array) -> list[str]:
    """Strings of an Arrow column, null as the empty string."""
    return [t or "" for t in column.to_pylist()]


def slices(sizes: list[int], limit: int):
    """Half-open index ranges of consecutive items whose sizes add up to about `limit` (one item may exceed it)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def segments(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of the given lengths laid end to end: the run number and the offset inside it of every item."""
    run = np.repeat(np.arange(len(lengths)), lengths)
    first = np.cumsum(lengths) - lengths
    return run, np.arange(len(run)) - first[run]


def hash_of_int(values: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's hash of 32-bit integers (Murmur3 of one word), as it deals rows out by an integer column."""
    u32 = np.uint32

    def rotate(x, r):
        return (x << u32(r)) | (x >> u32(32 - r))

    k = rotate(values.astype(u32) * u32(0xCC9E2D51), 15) * u32(0x1B873593)
    h = rotate(np.full(len(values), seed, u32) ^ k, 13) * u32(5) + u32(0xE6546B64)
    h ^= u32(4)
    h = (h ^ (h >> u32(16))) * u32(0x85EBCA6B)
    h = (h ^ (h >> u32(13))) * u32(0xC2B2AE35)
    return (h ^ (h >> u32(16))).view(np.int32)


def partition_keys(n: int) -> list[int]:
    """For every partition of n the smallest integer that Spark's hash partitioning sends there."""
    keys, start = np.full(n, -1, np.int64), 0
    while (keys < 0).any():
        values = np.arange(start, start + 16 * n)
        target = hash_of_int(values).astype(np.int64) % n
        new, first = np.unique(target, return_index=True)
        new, first = new[keys[new] < 0], first[keys[new] < 0]
        keys[new] = values[first]
        start += 16 * n
    return keys.tolist()


def deal_slots(df: DataFrame, *order: str) -> DataFrame:
    """Slot s goes to partition s modulo the shuffle width: one slot a partition, none empty by chance of hashing."""
    n = shuffle_width(df.sparkSession)
    keys = F.lit(np.array(partition_keys(n), dtype=np.int32))
    return df.repartition(n, F.element_at(keys, F.col("slot") % n + 1)).sortWithinPartitions("slot", *order)


def pack(records: np.ndarray) -> bytes:
    """Records as bytes, byte plane by byte plane (so that high zero bytes compress), after their width."""
    width = records.dtype.itemsize
    flat = np.ascontiguousarray(records).view(np.uint8).reshape(-1, width)
    return width.to_bytes(2, "little") + np.ascontiguousarray(flat.T).tobytes()


def unpack(blob: bytes) -> bytes:
    """The records' bytes in row order."""
    width = int.from_bytes(blob[:2], "little")
    return np.frombuffer(blob, np.uint8, offset=2).reshape(width, -1).T.tobytes()


def to_blobs(slot: np.ndarray, records: np.ndarray) -> pa.RecordBatch:
    """One row (slot, blob) for each slot that has records; `records` is a structured or plain array."""
    order = np.argsort(slot, kind="stable")
    slot, records = slot[order], records[order]
    cut = np.flatnonzero(np.diff(slot)) + 1
    first = np.concatenate([[0], cut]).astype(np.int64)
    last = np.concatenate([cut, [len(slot)]]).astype(np.int64)
    blobs = [pack(records[a:b]) for a, b in zip(first, last)]
    return pa.RecordBatch.from_arrays(
        [pa.array(slot[first].astype(np.int32), pa.int32()), pa.array(blobs, pa.binary())], names=["slot", "blob"]
    )


def exchange_blobs(df: DataFrame) -> DataFrame:
    """Bring the blobs of a slot together, sorted by slot in each partition so slots can be processed one by one."""
    return deal_slots(df)


def read_slots(batches, dtype):
    """Group an iterator of (slot, blob) batches that come sorted by slot: yields (slot, records)."""
    current, parts = None, []
    for batch in batches:
        for slot, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if slot != current and parts:
                yield current, np.frombuffer(b"".join(parts), dtype=dtype)
                parts = []
            current = slot
            parts.append(unpack(blob))
    if parts:
        yield current, np.frombuffer(b"".join(parts), dtype=dtype)
    del parts
    trim()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """`docs` with a first column __key, unique for different documents and in their order.

    The key is doc_id where that is unique and never null.  Otherwise documents are numbered: nulls first, then by
    doc_id, rows of one doc_id by the MD5 of their text; rows that agree in both are one document.  Numbers come from a
    sort by ranges and a count of each range, so no id, however often it occurs, has its rows in one task.
    """
    key = F.col("doc_id").cast("long")
    if not docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").limit(1).take(1):
        return docs.select(key.alias("__key"), "*")
    digest = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    n = shuffle_width(docs.sparkSession)
    distinct = docs.select(key.alias("__id"), digest.alias("__digest")).distinct()
    ranged = checkpoint(distinct.repartitionByRange(n, "__id", "__digest").withColumn("__range", F.spark_partition_id()))
    counts = {r[0]: r[1] for r in ranged.groupBy("__range").count().collect()}
    before = [sum(c for p, c in counts.items() if p < k) for k in range(n)]

    def numbered(batches):
        at = None
        for batch in batches:
            if batch.num_rows:
                at = before[batch.column(2)[0].as_py()] if at is None else at
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.arange(at, at + batch.num_rows))], names=["__id", "__digest", "__key"])
                at += batch.num_rows

    ordered = ranged.repartition(n, F.element_at(F.lit(np.array(partition_keys(n), dtype=np.int32)), F.col("__range") + 1)).sortWithinPartitions("__id", "__digest")
    keys = checkpoint(ordered.mapInArrow(numbered, "__id long, __digest string, __key long"))
    rows = docs.withColumns({"__id": key, "__digest": digest})
    same = rows["__id"].eqNullSafe(keys["__id"]) & (rows["__digest"] == keys["__digest"])
    return checkpoint(rows.join(keys, same).select("__key", *[docs[c] for c in docs.columns]))


def plain_names(df: DataFrame) -> DataFrame:
    """`df` with all columns but doc_id, text and n_chars renamed, so that none clashes with a working column."""
    return df.toDF(*[n if n in ("doc_id", "text", "n_chars") else f"c{i}_" for i, n in enumerate(df.columns)])


def with_minimum(both: DataFrame, low: DataFrame, most: int) -> DataFrame:
    """`both` (a, b) with the row of `low` (a, m, n) of its a; nodes of over `most` neighbours travel as a broadcast, so a
    hub's edges stay where they are, and there are at most 2 * edges / most of them."""
    hubs = F.broadcast(low.where(F.col("n") > most).drop("n"))
    rest = both.join(hubs.select("a"), "a", "left_anti").join(low.where(F.col("n") <= most).drop("n"), "a")
    return both.join(hubs, "a").unionByName(rest)


HUBS = 20_000


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an edge list (a, b): rows (node, component) with the smallest node id as component.

    Alternates the large-star and small-star steps, whose shuffles carry each edge once and never build
    neighbour lists; nodes with a large share of all edges are joined by broadcast, at most 2 * `HUBS` of them.  Every
    round is written to the shared checkpoint folder, so that a lost executor costs a re-read and not the whole
    history.  Only nodes with an edge appear.
    """
    spark = edges.sparkSession

    def directed(e):
        return e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    now = checkpoint(directed(edges))
    if not now.take(1):
        return spark.createDataFrame([], "node long, component long")
    before, size = None, now.count()
    for _ in range(max_rounds):
        most = max(1000, size // HUBS)
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m"))
        joined = with_minimum(both, low, most) if size > most else both.join(low.drop("n"), "a")
        large = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = checkpoint(directed(small.select("e.a", "e.b")))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == tuple(state):
            break
        before, size = tuple(state), state[0]
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
