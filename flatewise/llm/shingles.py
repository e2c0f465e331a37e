"""Sets of 5-word shingles of texts, the exact Jaccard check of candidate pairs, and keeping one row of a class.

Shingles are 48-bit codes (top bits of XXH64); a set is its distinct codes.  Candidates are found elsewhere (`simhash`).

Defined cases: null and blank texts have the empty set and are one class; a text of fewer than five words is one shingle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flatewise.llm.common import checkpoint

SHINGLE = 5
SEED = 42
OVER, UNDER = 4, 5  # least Jaccard as a fraction
CODE_BYTES = 6
WAVE_PAIRS = 200_000


def codes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Distinct codes of the `width`-word shingles of a text, ascending."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= width:
        return np.array([digest(joined, SEED) >> 16], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    begins = (ends - lengths)[: n - width + 1].tolist()
    stops = ends[width - 1 :].tolist()
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(begins, stops)], np.uint64) >> np.uint64(16))


def to_bytes(found: np.ndarray) -> bytes:
    return found.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :CODE_BYTES].tobytes()


def from_bytes(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // CODE_BYTES, 8), np.uint8)
    wide[:, :CODE_BYTES] = np.frombuffer(blob, np.uint8).reshape(-1, CODE_BYTES)
    return wide.reshape(-1).view("<u8")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if UNDER * min(len(a), len(b)) < OVER * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return UNDER * common >= OVER * (len(a) + len(b) - common)


def text_digest(text: F.Column) -> F.Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The checkpointed pairs (a, b) whose sets (node, codes; each node once) are similar; in waves, so that the copies of
    sets that one wave moves are released before the next."""

    def check(batches):
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = pa.array([similar(from_bytes(p), from_bytes(q)) for p, q in zip(x, y)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(good)

    def wave(part):
        full = part.join(sets.select(F.col("node").alias("a"), F.col("codes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("codes").alias("y")), "b")
        return checkpoint(full.select("a", "b", "x", "y").mapInArrow(check, "a long, b long"))

    waves = 1 + pairs.count() // WAVE_PAIRS
    links = None
    for w in range(waves):
        found = wave(pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(waves)) == w))
        links = found if links is None else links.union(found)
    return links


def keep_one(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Of `rows` (doc_id, digest of the text, class) the first by doc_id, then text, of each class, as rows of `docs`; null ids come last."""
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest")
    first = checkpoint(rows.groupBy("class").agg(F.min(order).alias("k")).select(F.col("k.doc_id").alias("__id"), F.col("k.digest").alias("__digest")))
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__id")) & (text_digest(docs["text"]) == F.col("__digest"))
    kept = docs.join(first, same, "left_semi")
    if rows.groupBy("doc_id", "digest").count().where("count > 1").limit(1).take(1):  # rows with equal id and text
        kept = kept.withColumn("__digest", text_digest(F.col("text"))).dropDuplicates(["doc_id", "__digest"]).drop("__digest")
    return kept
