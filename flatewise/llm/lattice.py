"""Operator 5: embedding near-duplicates by E8 lattice hashing.

In each of `TABLES` tables a unit vector is projected by random directions onto `BLOCKS` blocks of eight coordinates,
scaled, and every block is decoded to its nearest point of the E8 lattice.  A cell is the tuple of lattice points.
Besides its own cell a vector probes the cells that differ in one block by the lattice's minimal vectors, the nearest
`PROBES` of them.  Vectors that share a cell are compared by cosine in double precision.

Equal vectors are one class with a multiplicity from the start.  Cells with a single class are dropped before any
vector moves.  A crowded cell is dealt into blocks of at most `BLOCK_ROWS`, and pairs of blocks are separate work
items, so a hot cell is no single task.  Work items emit counts and one spanning link for each class, never pairs; a
pair that meets in several cells counts in the least of them only.

Candidates come from hashing, so a link can be missed: the README states measured recall.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are
their own component; vectors of different dimension do not link; repeated rows are vectors of their own; a null
vec_id counts as a partner and takes the component's least id; other columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

import hashlib
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flatewise.llm.common import MIX_STEP, checkpoint, connected_components, deal_slots, mix64, shuffle_width, to_blobs, unpack

COSINE = 0.9
TABLES = 13
BLOCKS = 3
PROBES = 4
SCALE = 1.3
BLOCK_ROWS = 1024
MAX_CELLS = TABLES * (1 + PROBES)
U = np.uint64


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two coordinates +-1, or all +-1/2 with an even number of minus signs."""
    rows = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            rows.append(v)
    rows += [np.array(s) / 2 for s in product((1, -1), repeat=8) if s.count(-1) % 2 == 0]
    return np.array(rows)


NEIGHBOURS = minimal_vectors()


def nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer vectors with even sum: round, and where the sum is odd move the worst coordinate the other way."""
    near = np.rint(x)
    odd = near.sum(axis=1) % 2 != 0
    error = x - near
    worst = np.abs(error).argmax(axis=1)
    rows = np.flatnonzero(odd)
    at = worst[rows]
    near[rows, at] += np.where(error[rows, at] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 shifted by one half."""
    whole, half = nearest_d8(x), nearest_d8(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    whole[closer] = half[closer]
    return whole


def directions(dimension: int, table: int) -> np.ndarray:
    """BLOCKS * 8 random directions, scaled so that a unit vector's projection on a block is `SCALE` long on average.

    All are orthonormal where the dimension allows, else those of each block are; below eight dimensions a block's
    eight directions are a tight frame, which keeps lengths exactly.
    """
    rng = np.random.default_rng([dimension, table, 5])
    blocks = [rng.standard_normal((BLOCKS * 8, dimension))] if dimension >= BLOCKS * 8 else [rng.standard_normal((8, dimension)) for _ in range(BLOCKS)]
    rows = [np.linalg.qr(b.T)[0].T if dimension >= len(b) else np.linalg.qr(b)[0] for b in blocks]
    return np.concatenate(rows) * SCALE * np.sqrt(max(1.0, dimension / 8.0))


def point_hash(points: np.ndarray) -> np.ndarray:
    """Hash of lattice points, from their doubled (integer) coordinates."""
    ints = np.rint(points * 2).astype(np.int64).view(U)
    h = np.zeros(len(points), U)
    for k in range(8):
        h = mix64(h + ints[:, k] * U(MIX_STEP) + U(k + 1))
    return h


def cells(unit: np.ndarray) -> np.ndarray:
    """Cell ids (n x MAX_CELLS) of unit vectors: in each table the own cell, then probed ones."""
    n, dimension = unit.shape
    out = np.empty((n, MAX_CELLS), U)
    for t in range(TABLES):
        projected = unit @ directions(dimension, t).T
        points = [nearest_e8(projected[:, 8 * b : 8 * b + 8]) for b in range(BLOCKS)]
        hashes = [point_hash(p) for p in points]
        gain = np.concatenate([(projected[:, 8 * b : 8 * b + 8] - points[b]) @ NEIGHBOURS.T for b in range(BLOCKS)], axis=1)
        base = t * (1 + PROBES)

        def cell(parts):
            h = np.full(n, (t + 1) * MIX_STEP % 2**64, U) + U(dimension)
            for part in parts:
                h = mix64(h ^ part)
            return h

        out[:, base] = cell(hashes)
        best = np.argpartition(-gain, PROBES, axis=1)[:, :PROBES]
        for p in range(PROBES):
            block, which = np.divmod(best[:, p], len(NEIGHBOURS))
            changed = list(hashes)
            for b in range(BLOCKS):
                rows = np.flatnonzero(block == b)
                moved = hashes[b].copy()
                moved[rows] = point_hash(points[b][rows] + NEIGHBOURS[which[rows]])
                changed[b] = moved
            out[:, base + 1 + p] = cell(changed)
    return out


def unit_rows(blobs: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def canonical(vector: list | None, kind: str) -> bytes | None:
    """A usable vector's components, scaled by a power of two against overflow; else None."""
    if not vector or any(v is None for v in vector):
        return None
    x = np.array(vector, "<f8")
    top = np.abs(x).max()
    if not np.isfinite(top) or np.isnan(x).any() or top == 0:
        return None
    if not 1e-100 < top < 1e100:
        x = x * 2.0 ** -int(np.frexp(top)[1])
    return (x + 0.0).astype(kind).tobytes()


def vector_batches(kind: str):
    """(vec_id, class, vector) rows; class is null for unusable vectors."""

    def run(batches):
        for batch in batches:
            blobs = [canonical(v, kind) for v in batch.column(1).to_pylist()]
            ids = [None if b is None else int.from_bytes(hashlib.blake2b(b, digest_size=8).digest(), "little", signed=True) for b in blobs]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], names=["vec_id", "class", "vector"])

    return run


def by_dimension(blobs: list[bytes]):
    sizes = np.array([len(b) for b in blobs])
    for size in np.unique(sizes):
        yield np.flatnonzero(sizes == size)


def cell_batches(kind: str):
    """(class, cell) rows, each cell once."""

    def run(batches):
        for batch in batches:
            ids, blobs = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for rows in by_dimension(blobs):
                found = np.sort(cells(unit_rows([blobs[i] for i in rows], kind)), axis=1)
                fresh = np.ones(found.shape, bool)
                fresh[:, 1:] = found[:, 1:] != found[:, :-1]
                owner = np.repeat(ids[rows], MAX_CELLS)[fresh.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(found.ravel()[fresh.ravel()].view(np.int64))], names=["class", "cell"])

    return run


def item_type(dimension: int, kind: str) -> np.dtype:
    return np.dtype([("cell", "<u8"), ("i", "<i4"), ("j", "<i4"), ("right", "u1"), ("class", "<i8"), ("count", "<i8"), ("cells", "<u8", (MAX_CELLS,)), ("vector", kind, (dimension,))])


def item_batches(kind: str, slots: int):
    """Work items: a class goes to every pair of blocks that its block takes part in, in each of its shared cells."""

    def run(batches):
        for batch in batches:
            ids, counts, blobs, shared, blocks, totals = (c.to_pylist() for c in batch.columns)
            for rows in by_dimension(blobs):
                dimension = len(blobs[rows[0]]) // np.dtype(kind).itemsize
                out = []
                for k in rows.tolist():
                    own = np.zeros(MAX_CELLS, U)
                    mine = np.array(shared[k], np.int64).view(U)
                    own[: len(mine)] = mine
                    item = np.zeros(sum(totals[k]), item_type(dimension, kind))
                    item["class"], item["count"], item["cells"], item["vector"] = ids[k], counts[k], own, np.frombuffer(blobs[k], kind)
                    item["cell"] = np.repeat(mine, totals[k])
                    block = np.repeat(np.array(blocks[k]), totals[k])
                    other = np.concatenate([np.arange(n) for n in totals[k]])
                    item["i"], item["j"], item["right"] = np.minimum(block, other), np.maximum(block, other), block > other
                    out.append(item)
                items = np.concatenate(out)
                key = mix64(items["cell"] + items["i"].astype(U) * U(MIX_STEP) + items["j"].astype(U) * U(0xC4CEB9FE1A85EC53))
                slot = (key % U(slots)).astype(np.int32)
                blobs_out = to_blobs(slot, items)
                yield pa.RecordBatch.from_arrays([blobs_out.column(0), pa.array([dimension] * blobs_out.num_rows, pa.int32()), blobs_out.column(1)], names=["slot", "dimension", "blob"])

    return run


def earlier_meeting(cell: np.uint64, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Boolean matrix: the pair shares a cell less than `cell`."""

    def listed(cells_of):
        row, col = np.nonzero((cells_of < cell) & (cells_of != 0))
        return row, cells_of[row, col]

    (row_a, cell_a), (row_b, cell_b) = listed(left), listed(right)
    common = np.intersect1d(cell_a, cell_b)
    if not len(common):
        return np.zeros((len(left), len(right)), bool)

    def membership(n, row, values):
        m = np.zeros((n, len(common)), np.float32)
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        ok = common[at] == values
        m[row[ok], at[ok]] = 1
        return m

    return (membership(len(left), row_a, cell_a) @ membership(len(right), row_b, cell_b).T) > 0


def link_items(items: np.ndarray):
    """(class, links counted here, root class) of the classes with links in one work item."""
    same = items["i"][0] == items["j"][0]
    a = items if same else items[items["right"] == 0]
    b = items if same else items[items["right"] == 1]
    if not len(a) or not len(b):
        return
    unit_a, unit_b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a["vector"].astype(np.float64), b["vector"].astype(np.float64)))
    near = unit_a @ unit_b.T >= COSINE
    if same:
        np.fill_diagonal(near, False)
    if not near.any():
        return
    fresh = near & ~earlier_meeting(items["cell"][0], a["cells"], b["cells"])
    sides = [(a, fresh @ b["count"])] if same else [(a, fresh @ b["count"]), (b, fresh.T @ a["count"])]
    # label propagation over the item's dense link matrix
    label_a, label_b = a["class"].copy(), b["class"].copy()
    while True:
        big = np.iinfo(np.int64).max
        new_b = np.minimum(label_b, np.where(near, label_a[:, None], big).min(axis=0))
        new_a = np.minimum(label_a, np.where(near, new_b[None, :], big).min(axis=1))
        if same:
            new_a = new_b = np.minimum(new_a, new_b)
        if np.array_equal(new_a, label_a) and np.array_equal(new_b, label_b):
            break
        label_a, label_b = new_a, new_b
    for (side, count), label, linked in zip(sides, (label_a, label_b), (near.any(axis=1), near.any(axis=0))):
        yield side["class"][linked], count[linked], label[linked]


def link_batches(kind: str):
    """(class, links counted, root) rows of all work items of a slot."""

    def work(parts):
        for dimension, blobs in parts:
            items = np.frombuffer(b"".join(blobs), item_type(dimension, kind))
            items = items[np.lexsort((items["class"], items["j"], items["i"], items["cell"]))]
            key = np.stack([items["cell"], items["i"].astype(U), items["j"].astype(U)], axis=1)
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            out = [x for group in np.split(items, cut) if len(group) > 1 for x in link_items(group)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[c] for x in out]).astype(np.int64)) for c in range(3)], names=["class", "n", "root"])

    def run(batches):
        current, parts = None, []
        for batch in batches:
            for slot, dimension, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if slot != current:
                    yield from work(parts)
                    current, parts = slot, []
                if not parts or parts[-1][0] != dimension:
                    parts.append((dimension, []))
                parts[-1][1].append(unpack(blob))
        yield from work(parts)

    return run


def near_duplicates(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of (vec_id, embedding)."""
    spark = embeddings.sparkSession
    width = shuffle_width(spark)
    element = embeddings.schema["embedding"].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(vector_batches(kind), "vec_id long, class long, vector binary")
    members = checkpoint(rows)
    classes = checkpoint(members.where("class is not null").groupBy("class").agg(F.count("*").alias("count"), F.min("vec_id").alias("least"), F.first("vector").alias("vector")))
    placed = classes.select("class", "vector").mapInArrow(cell_batches(kind), "class long, cell long")
    crowd = placed.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")
    shared = placed.join(crowd, "cell").select("class", "cell", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("total"))
    shared = shared.withColumn("block", F.pmod(F.xxhash64("class", "cell"), F.col("total")).cast("int"))
    lists = shared.groupBy("class").agg(F.sort_array(F.collect_list(F.struct("cell", "block", "total"))).alias("s"))
    carried = classes.join(lists, "class").select("class", "count", "vector", F.col("s.cell").alias("cell"), F.col("s.block").alias("block"), F.col("s.total").alias("total"))
    items = carried.mapInArrow(item_batches(kind, width), "slot int, dimension int, blob binary")
    together = deal_slots(items, "dimension")
    links = checkpoint(together.mapInArrow(link_batches(kind), "class long, n long, root long"))
    counts = links.groupBy("class").agg(F.sum("n").alias("n"))
    parts = connected_components(links.select(F.col("class").alias("a"), F.col("root").alias("b")).where("a <> b"))
    known = classes.select("class", "count", "least").join(counts, "class", "left").join(parts.withColumnRenamed("node", "class"), "class", "left")
    known = known.withColumn("component", F.coalesce("component", "class"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select("class", (F.coalesce("n", F.lit(0)) + F.col("count") - 1).alias("n_links"), "component_id")
    found = members.select("vec_id", "class").join(known, "class", "left")
    component = F.coalesce("component_id", "vec_id")
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
