"""Operator 10: document fingerprints by locally consistent parsing.

Level 0 is the sequence of code points.  At every level, runs of one symbol become one symbol; deterministic coin
tossing (the position and value of the lowest bit in which a name differs from its left neighbour's, repeated until
labels are below 8) leaves no two neighbours alike; label maxima begin phrases of bounded length; a phrase's name is
a hash of the names inside it.  Where a phrase begins depends on a few neighbouring names only, so equal substrings
have the same names inside, whatever their offset.  Levels are built until a text is one phrase.  A fingerprint is the
bottom-k sketch of the distinct phrase names of the levels from `LOWEST` up (of all levels where the first has fewer
than `SHORT` phrases), each level's names salted by it; the likeness of two is the share of common names (Dice) that the
union's bottom-k estimates.

Texts of a batch are parsed together with numpy; document borders are phrase borders, and labels start afresh there.

Neighbours (the next document in descending doc_id) are found without a global sort in one task: exact doc_id
quantiles cut the table into ranges, rows go to their range, and the border document of a range is sent to both.

Defined cases: null text is empty; the empty text's fingerprint is the empty string, like itself only (likeness 1);
rows with the same doc_id are ordered by the MD5 of their text, equal rows too take one another as next; a null doc_id
sorts as the smallest; with a single row the next document is itself; other columns are ignored; an empty table gives an empty
table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flatewise.llm.common import deal_slots, keyed, mix64, shuffle_width, slices

LOWEST = 2
SHORT = 64
NAME_BITS = 44
SKETCH = 64
BATCH_CHARS = 400_000
U = np.uint64
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def coin_labels(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below 8, different for neighbours, of a sequence whose neighbours differ; `first` marks text starts."""
    labels = names
    bits = 64
    for _ in range(6):
        if bits <= 3:
            break
        left = np.empty_like(labels)
        left[1:] = labels[:-1]
        left[0] = ~labels[0]
        left[first] = labels[first] ^ U(1)
        difference = labels ^ left
        low = difference & (~difference + U(1))
        place = np.bitwise_count(low - U(1)).astype(U)
        labels = (place << U(1)) | ((labels >> place) & U(1))
        bits = max(3, int(2 * bits - 1).bit_length())
    return labels


def collapse_runs(names: np.ndarray, first: np.ndarray, owner: np.ndarray):
    """Replace runs of one name inside a text by one name."""
    keep = np.ones(len(names), bool)
    keep[1:] = names[1:] != names[:-1]
    keep |= first
    if keep.all():
        return names, first, owner
    at = np.flatnonzero(keep)
    length = np.diff(np.concatenate([at, [len(names)]]))
    out = names[at]
    long = length > 1
    out[long] = mix64(out[long] + mix64(length[long].astype(U)))
    return out, first[at], owner[at]


def phrases(names: np.ndarray, first: np.ndarray, owner: np.ndarray):
    """One level of parsing: (names, text starts, owners) of the phrases."""
    names, first, owner = collapse_runs(names, first, owner)
    n = len(names)
    # a collapsed run's new name may equal its neighbour's by chance only: the label is then still defined
    label = coin_labels(names, first).astype(np.int8)
    top = np.zeros(n, bool)
    if n > 2:
        top[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] >= label[2:]) & ~first[2:]  # a text's last name begins nothing
    start = top | first
    start[1:] &= ~(start[:-1] & ~first[1:])
    at = np.flatnonzero(start)
    place = np.arange(n) - np.repeat(at, np.diff(np.concatenate([at, [n]])))
    weight = mix64(names + place.astype(U) * U(0x9E3779B97F4A7C15))
    return mix64(np.add.reduceat(weight, at)), first[at], owner[at]


def parse(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct phrase names of each text, from the fingerprint's levels."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    filled = np.flatnonzero(sizes)
    found = [np.empty(0, U)] * len(texts)
    if not len(filled):
        return found
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    names = mix64(points.astype(U) + U(1))
    owner = np.repeat(np.arange(len(texts)), sizes)
    first = np.zeros(len(names), bool)
    first[(np.cumsum(sizes) - sizes)[filled]] = True
    kept_names, kept_owner = [], []
    short, level = None, 0
    while len(names):  # a level about halves the names of a text
        names, first, owner = phrases(names, first, owner)
        level += 1
        if short is None:
            short = np.bincount(owner, minlength=len(texts)) < SHORT
        use = slice(None) if level >= LOWEST else short[owner]
        kept_names.append(mix64(names[use] ^ U(level)) >> U(64 - NAME_BITS))
        kept_owner.append(owner[use])
        more = np.bincount(owner, minlength=len(texts))[owner] > 1
        names, first, owner = names[more], first[more], owner[more]
    names, owner = np.concatenate(kept_names), np.concatenate(kept_owner)
    order = np.lexsort((names, owner))
    names, owner = names[order], owner[order]
    fresh = np.ones(len(names), bool)
    fresh[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
    names, owner = names[fresh], owner[fresh]
    cut = np.searchsorted(owner, np.arange(len(texts) + 1))
    for k in filled:
        found[k] = names[cut[k] : cut[k + 1]]
    return found


def sketch(names: np.ndarray) -> str:
    """Bottom-k names as one string of 11 hex digits each; the number of names is known only below k."""
    return "".join(f"{x:011x}" for x in names[:SKETCH].tolist())


def likeness(a: str, b: str) -> float:
    """Estimated share of common names: 2 |A and B| / (|A| + |B|)."""
    if a == b:
        return 1.0
    x, y = ({s[i : i + 11] for i in range(0, len(s), 11)} for s in (a, b))
    k = SKETCH if max(len(x), len(y)) >= SKETCH else len(x | y)
    union = sorted(x | y)[:k]
    common = sum(1 for v in union if v in x and v in y)
    if not union:
        return 0.0
    jaccard = common / len(union)
    return 2 * jaccard / (1 + jaccard)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_rows(rows: list[tuple[int | None, str, str]]):
    """Output columns of (doc_id, text, next text) rows."""
    ids = [r[0] for r in rows]
    texts, following = [r[1] for r in rows], [r[2] for r in rows]
    changed = [edited(t, f) for t, f in zip(texts, following)]
    prints = []
    for group in (texts, following[-1:], changed):
        out = []
        for a, b in slices([len(t) + 1 for t in group], BATCH_CHARS):
            out += [sketch(s) for s in parse(group[a:b])]
        prints.append(out)
    own, last, new = prints
    # inside a run the next document's fingerprint is the next row's own
    after = [own[i + 1] if i + 1 < len(own) and following[i] is texts[i + 1] else None for i in range(len(own))]
    if len(after):
        after[-1] = last[0]
    after = [p if p is not None else sketch(parse([f])[0]) for p, f in zip(after, following)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "replace")).hexdigest() for t in changed], pa.string()),
            pa.array(own, pa.string()), pa.array(new, pa.string()),
            pa.array([likeness(a, b) for a, b in zip(own, new)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, after)], pa.float64()),
        ],
        names=[c.split()[0] for c in SCHEMA.split(", ")],
    )


def range_batches(bounds: np.ndarray):
    """Rows (key, doc_id, text) by range; bounds are existing keys, the greatest of their ranges, which also go to the
    range above as donors.  The greatest key of all is the donor of the lowest range."""

    def run(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            part = np.searchsorted(bounds, keys, side="left")
            border = part < len(bounds)
            border[border] = bounds[part[border]] == keys[border]
            donor = np.flatnonzero(border)
            target = (part[donor] + 1) % len(bounds)
            take = pa.array(np.concatenate([np.arange(len(keys)), donor]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([part, target]).astype(np.int32)), batch.column(0).take(take), batch.column(1).take(take), pa.array(np.concatenate([np.zeros(len(keys), bool), np.ones(len(donor), bool)])), batch.column(2).take(take)],
                names=["slot", "down", "doc_id", "donor", "text"],
            )

    return run


def neighbour_batches(batches):
    """Rows come sorted by slot, then descending key (donors last): each takes the next row's text."""
    flush = 2_000_000
    rows: list[tuple[int | None, str, str]] = []
    held, total = None, 0
    for batch in batches:
        for slot, doc, donor, text in zip(*(batch.column(n).to_pylist() for n in ("slot", "doc_id", "donor", "text"))):
            text = text or ""
            if held is not None and held[0] == slot:
                rows.append((held[1], held[2], text))
                total += len(text) + 100
            held = None if donor else (slot, doc, text)
            if total >= flush:
                yield fingerprint_rows(rows)
                rows, total = [], 0
    if rows:
        yield fingerprint_rows(rows)


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row of SCHEMA for every document."""
    spark = docs.sparkSession
    n = shuffle_width(spark)
    rows = keyed(docs.selectExpr("cast(doc_id as long) doc_id", "text"))
    parts = [k / n for k in range(1, n)]
    quantiles = rows.agg(F.max("__key").alias("top"), F.percentile_approx("__key", parts or [0.5], 10_000).alias("cuts")).first()
    if quantiles["top"] is None:
        return spark.createDataFrame([], SCHEMA)
    bounds = np.unique(np.array([*(quantiles["cuts"] if n > 1 else []), quantiles["top"]], dtype=np.int64))
    sent = rows.mapInArrow(range_batches(bounds), "slot int, down long, doc_id long, donor boolean, text string")
    return deal_slots(sent.withColumn("down", -F.col("down")), "donor", "down").mapInArrow(neighbour_batches, SCHEMA)
