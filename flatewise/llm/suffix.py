"""Operator 1: removal of repeated byte strings by suffix arrays.

Every byte covered by a 100-byte string that also starts earlier in the corpus (smaller doc_id, or earlier in the same
document) goes.  Strings are judged on the input.

1. *Anchors.*  Of the k-grams inside a 100-byte window the one of least hash (leftmost among equals) is its anchor.
   Windows of a text with one anchor are consecutive and make up a fragment.  Equal windows have equal anchors, so
   equal windows always lie in fragments of the same anchor hash, and every window lies in exactly one fragment.
2. *Equal fragments.*  Fragments meet by anchor hash.  Of equal ones all but the first are repeats.  If an anchor has
   different fragments, one of each kind goes on: its windows may still partly agree.
3. *Suffix arrays.*  The remaining fragments are dealt into shards.  A shard's suffix array is built with numpy by
   Larsson-Sadakane refinement (prefix doubling that re-sorts unsettled groups only), common prefixes by Kasai's
   scheme run in step over all fragments, and neighbours that share 100 bytes are equal windows.
4. *Merging.*  The fragments of one anchor share a shard unless they are too many; then each shard sorts the digests
   of its distinct windows, and a merge finds equal ones across shards by binary search.
5. *Removal.*  Spans meet their texts and are cut out.

Groups are bounded: a map task sends equal fragments once however often it has them, and anchors with very many
different fragments (found on a sample of documents; it steers the dealing, never the result) are dealt by fragment
instead of by anchor.  Texts travel twice, zstd-compressed; fragments as packed records.

Defined cases: null text is empty; texts under 100 bytes keep everything; rows with one doc_id are ordered by the MD5
of their text and equal ones among them are the same document (none removes bytes of the other); a null doc_id sorts before all;
columns other than doc_id and text are passed on by `remove_repeats` and ignored otherwise; an empty table gives an
empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flatewise.llm.common import MIX_STEP, checkpoint, deal_slots, exchange_blobs, keyed, mix64, plain_names, read_slots, release, shuffle_width, slices, small_batches, to_blobs, trim, unpack

LENGTH = 100
GRAM = 24
BATCH_BYTES = 1_000_000
FLUSH_FRAGMENTS = 400_000
FLUSH_TEXT = 16_000_000
SHARD_BYTES = 1_200_000
SAMPLE_SHARE = 64
HOT_FRAGMENTS = 200
MAX_HOT = 4096
U = np.uint64

FRAGMENT = np.dtype([("anchor", "<u8"), ("low", "<u4"), ("high", "<u2"), ("size", "u1"), ("start", "<u4"), ("doc", "<i8")])
SPAN = np.dtype([("doc", "<i8"), ("start", "<u4"), ("stop", "<u4"), ("anchor", "<u8"), ("kind", "u1")])
WINDOW = np.dtype([("digest", "<u8"), ("doc", "<i8"), ("start", "<u4")])
REPEAT, VARIANT, HOT_VARIANT = 0, 1, 2

BYTE_HASH = mix64(np.arange(1, 257, dtype=U) * U(MIX_STEP))
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.ones(n, U)
    if n > 1:
        out[1:] = U(base)
        np.multiply.accumulate(out, out=out)
    return out


_POWERS: dict[int, np.ndarray] = {}


def power_table(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = _POWERS[base] = powers(base, max(n, BATCH_BYTES * 2))
    return have


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from every position that has them (24 = 16 + 8, by doubling)."""
    h = BYTE_HASH[data]
    at_eight = None
    for k in range(4):
        step = 1 << k
        h = h[:-step] * U(pow(BASE, step, 1 << 64)) + h[step:]
        if step == 4:
            at_eight = h
    h = h[: len(data) - GRAM + 1] * U(pow(BASE, 8, 1 << 64)) + at_eight[16 : 16 + len(data) - GRAM + 1]
    return mix64(h)


def fragments(texts: list[bytes], keys: list[int]) -> np.ndarray:
    """FRAGMENT records of some texts."""
    use = [k for k, t in enumerate(texts) if len(t) >= LENGTH]
    if not use:
        return np.empty(0, FRAGMENT)
    sizes = np.array([len(texts[k]) for k in use], dtype=np.int64)
    data = np.frombuffer(b"".join([texts[k] for k in use]), dtype=np.uint8)
    begin = np.cumsum(sizes) - sizes
    grams = gram_hashes(data)
    n = len(data) - LENGTH + 1
    bits = max(1, int(len(grams)).bit_length())
    least = (grams & ~U((1 << bits) - 1)) | np.arange(len(grams)).astype(U)
    span, width = LENGTH - GRAM + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (span - width)], least[span - width :])[:n]
    anchor = (least & U((1 << bits) - 1)).astype(np.int64)
    valid = np.ones(n, bool)
    for b, s in zip(begin[1:].tolist(), sizes[:-1].tolist()):
        valid[b - LENGTH + 1 : b] = False
    fresh = np.ones(n, bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | ~valid[:-1]
    first = np.flatnonzero(fresh & valid)
    ends = np.ones(n, bool)
    ends[:-1] = fresh[1:] | ~valid[1:]
    last = np.flatnonzero(ends & valid)
    prefix = np.concatenate([np.zeros(1, U), np.cumsum(BYTE_HASH[data] * power_table(BASE, len(data))[: len(data)], dtype=U)])
    size = last - first + LENGTH
    content = (prefix[last + LENGTH] - prefix[first]) * power_table(INVERSE, len(data))[first]
    content = mix64(content + (size * 256 + (anchor[first] - first)).astype(U) * U(MIX_STEP))
    owner = np.searchsorted(begin, first, side="right") - 1
    out = np.empty(len(first), FRAGMENT)
    out["anchor"] = grams[anchor[first]]
    out["low"], out["high"], out["size"] = content & U(0xFFFFFFFF), (content >> U(32)) & U(0xFFFF), size
    out["start"] = first - begin[owner]
    out["doc"] = np.array([keys[k] for k in use], dtype=np.int64)[owner]
    return out


def content_of(records: np.ndarray) -> np.ndarray:
    return records["low"].astype(U) | (records["high"].astype(U) << U(32))


def fragment_order(records: np.ndarray) -> np.ndarray:
    return np.lexsort((records["start"], records["doc"], content_of(records), records["anchor"]))


def spans_of(records: np.ndarray, kind) -> np.ndarray:
    out = np.empty(len(records), SPAN)
    out["doc"], out["start"], out["anchor"], out["kind"] = records["doc"], records["start"], records["anchor"], kind
    out["stop"] = records["start"] + records["size"].astype(np.uint32)
    return out


def merged(spans: np.ndarray) -> np.ndarray:
    """Repeat spans with overlapping and touching ones of a document united."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["start"], spans["doc"]))]
    reach = spans["stop"].astype(np.int64)
    doc_first = np.concatenate([[True], spans["doc"][1:] != spans["doc"][:-1]])
    group = np.cumsum(doc_first) - 1
    lifted = reach + group * (1 << 33)
    reach = np.maximum.accumulate(lifted) - group * (1 << 33)
    fresh = doc_first.copy()
    fresh[1:] |= spans["start"][1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    out = spans[at].copy()
    out["stop"] = reach[np.concatenate([at[1:], [len(spans)]]) - 1]
    return out


def doc_slot(doc: np.ndarray, slots: int) -> np.ndarray:
    return (mix64(doc.astype(np.int64).view(U) * U(MIX_STEP)) % U(slots)).astype(np.int32)


def route(anchor: np.ndarray, content: np.ndarray, hot: np.ndarray, slots: int) -> np.ndarray:
    value = anchor.copy()
    if len(hot):
        at = np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)
        spread = hot[at] == anchor
        value[spread] ^= mix64(content[spread])
    return (mix64(value) % U(slots)).astype(np.int32)


def encoded(batch: pa.RecordBatch) -> tuple[list[int], list[bytes]]:
    return batch.column(0).to_pylist(), [(t or "").encode("utf-8", "replace") for t in batch.column(1).to_pylist()]


def anchored(batches):
    """Fragments of (key, text) batches, some batches at a time."""
    held, total = [], 0
    for batch in batches:
        keys, texts = encoded(batch)
        for a, b in slices([len(t) for t in texts], BATCH_BYTES):
            held.append(fragments(texts[a:b], keys[a:b]))
            total += len(held[-1])
            if total >= FLUSH_FRAGMENTS:
                yield np.concatenate(held)
                held, total = [], 0
    if total:
        yield np.concatenate(held)
    trim()


def hot_batches(batches):
    """Anchors with several different fragments in the sample, with their number."""
    for records in anchored(batches):
        pairs = np.unique(np.stack([records["anchor"], content_of(records)], axis=1), axis=0)
        anchor, count = np.unique(pairs[:, 0], return_counts=True)
        some = count > 4
        yield pa.RecordBatch.from_arrays([pa.array(anchor[some].view(np.int64)), pa.array(count[some].astype(np.int64))], names=["anchor", "n"])


def anchor_batches(hot: np.ndarray, slots: int):
    """Fragments by anchor (slots from 0) and the repeats a task finds by itself by document (slots from `slots`)."""

    def run(batches):
        for records in anchored(batches):
            content = content_of(records)
            order = fragment_order(records)
            records, content = records[order], content[order]
            again = np.zeros(len(records), bool)
            again[1:] = (records["anchor"][1:] == records["anchor"][:-1]) & (content[1:] == content[:-1])
            own = merged(spans_of(records[again], REPEAT))
            yield to_blobs(route(records["anchor"][~again], content[~again], hot, slots), records[~again])
            if len(own):
                yield to_blobs(doc_slot(own["doc"], slots) + np.int32(slots), own)

    return run


def equal_batches(hot: np.ndarray, slots: int):
    """Repeats among equal fragments, and one fragment of each kind where an anchor has several: spans by document."""

    def emit(spans):
        return to_blobs(doc_slot(spans["doc"], slots), spans)

    def run(batches):
        held, total = [], 0
        for slot, raw in read_slots(batches, np.uint8):
            if slot >= slots:
                held.append(raw.view(SPAN))
            else:
                records = raw.view(FRAGMENT)
                records = records[fragment_order(records)]
                content = content_of(records)
                new_anchor = np.ones(len(records), bool)
                new_anchor[1:] = records["anchor"][1:] != records["anchor"][:-1]
                fresh = new_anchor.copy()
                fresh[1:] |= content[1:] != content[:-1]
                held.append(merged(spans_of(records[~fresh], REPEAT)))
                group = np.cumsum(new_anchor) - 1
                kinds = np.bincount(group, weights=fresh)
                firsts = records[fresh]
                many = kinds[group[fresh]] > 1
                spread = np.isin(firsts["anchor"], hot) if len(hot) else np.zeros(len(firsts), bool)
                held.append(spans_of(firsts[many & ~spread], VARIANT))
                held.append(spans_of(firsts[spread], HOT_VARIANT))
            total += sum(map(len, held[-3:]))
            if total >= FLUSH_FRAGMENTS:
                yield emit(np.concatenate(held))
                held, total = [], 0
        spans = np.concatenate(held) if held else np.empty(0, SPAN)
        if len(spans):
            yield emit(spans)

    return run


def text_blobs(slots: int):
    """Whole rows by document slot, each blob a compressed Arrow stream; the first column is the document key."""

    def run(batches):
        held, total = [], 0

        def emit():
            rows = pa.Table.from_batches(held).combine_chunks()
            slot = doc_slot(rows.column(0).to_numpy(), slots)
            order = np.argsort(slot, kind="stable")
            cut = np.flatnonzero(np.diff(slot[order])) + 1
            blobs, at = [], []
            for part in np.split(order, cut):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_table(rows.take(pa.array(part)))
                blobs.append(sink.getvalue().to_pybytes())
                at.append(slot[part[0]])
            return pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([1] * len(at), pa.int8()), pa.array(blobs, pa.binary())], names=["slot", "kind", "blob"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                total += batch.nbytes
            if total >= FLUSH_TEXT:
                yield emit()
                held, total = [], 0
        if held:
            yield emit()

    return run


def with_spans(batches):
    """For batches sorted by (slot, kind): (rows of a text blob, spans of its documents sorted by document)."""
    current, parts, spans = None, [], None
    for batch in batches:
        for slot, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if slot != current:
                current, parts, spans = slot, [], None
            if not kind:
                parts.append(unpack(blob))
                continue
            if spans is None:
                spans = np.frombuffer(b"".join(parts), SPAN)
                spans = spans[np.argsort(spans["doc"], kind="stable")]
                parts = []
            yield pa.ipc.open_stream(blob).read_all(), spans
    trim()


PIECE = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("size", "u1"), ("hot", "u1"), ("bytes", "S177")])


def piece_batches(slots: int):
    """The bytes of the fragments that suffix arrays must compare, by anchor (hot ones by fragment)."""

    def run(batches):
        held, total = [], 0

        def emit():
            records = np.concatenate(held)
            where = records["anchor"].copy()
            hot = records["hot"] == 1
            where[hot] ^= mix64(records["doc"][hot].view(U) * U(MIX_STEP) + records["start"][hot].astype(U))
            return to_blobs((mix64(where ^ U(77)) % U(slots)).astype(np.int32), records)

        for rows, spans in with_spans(batches):
            wanted = spans[spans["kind"] != REPEAT]
            if not len(wanted):
                continue
            for key, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                a, b = np.searchsorted(wanted["doc"], [key, key + 1])
                if a == b:
                    continue
                data = (text or "").encode("utf-8", "replace")
                own = wanted[a:b]
                shifted = (np.frombuffer(data, np.uint8) + np.uint8(1)).tobytes()  # no zero bytes: UTF-8 stays below 255
                records = np.empty(len(own), PIECE)
                records["anchor"], records["doc"], records["start"] = own["anchor"], key, own["start"]
                records["size"] = own["stop"] - own["start"]
                records["hot"] = own["kind"] == HOT_VARIANT
                records["bytes"] = [shifted[s:e] for s, e in zip(own["start"].tolist(), own["stop"].tolist())]
                held.append(records)
                total += len(records)
            if total >= 100_000:
                yield emit()
                held, total = [], 0
        if total:
            yield emit()

    return run


def suffix_array(codes: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank) of a code sequence, ordered by the first `depth` codes at least; below 2^21 codes.

    Larsson-Sadakane refinement: ranks after sorting by h codes serve as keys to sort by 2h; a group of equal rank has
    as rank the position of its last member, and settled (single) suffixes are left alone.  Keys hold the group, the
    rank h further on and the position in one integer, so a plain sort of integers does it.
    """
    n = len(codes)
    bits = U(21)
    at = np.arange(n).astype(U)
    padded = np.zeros(n + 3, U)
    padded[:n] = codes
    key = np.sort((((padded[:n] << U(18)) | (padded[1 : n + 1] << U(9)) | padded[2 : n + 2]) << bits) | at)
    order = (key & U((1 << 21) - 1)).astype(np.int64)
    value = key >> bits

    def last_of_group(differs):  # index of the last member of each member's group
        ends = np.flatnonzero(np.concatenate([differs, [True]]))
        return np.repeat(ends, np.diff(np.concatenate([[-1], ends])))

    rank = np.zeros(n + 1, np.int64)
    rank[order] = last_of_group(value[1:] != value[:-1]) + 1
    h = 3
    groups = rank[order] - 1
    open_ = np.flatnonzero(np.concatenate([[False], groups[1:] == groups[:-1]]) | np.concatenate([groups[1:] == groups[:-1], [False]]))
    while len(open_) and h < depth:
        suffix = order[open_]
        following = rank[np.minimum(suffix + h, n)]
        key = np.sort((rank[suffix].astype(U) << U(42)) | (following.astype(U) << bits) | suffix.astype(U))
        suffix = (key & U((1 << 21) - 1)).astype(np.int64)
        order[open_] = suffix
        value = key >> bits
        ends = last_of_group(value[1:] != value[:-1])
        rank[suffix] = open_[ends] + 1
        groups = rank[suffix]
        same = groups[1:] == groups[:-1]
        open_ = open_[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        h *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return order, place


def common_prefixes(codes: np.ndarray, order: np.ndarray, place: np.ndarray, begin: np.ndarray, size: np.ndarray, cap: int = LENGTH) -> np.ndarray:
    """Kasai's scheme: common prefix (up to `cap`) of each suffix with its predecessor in the suffix array.

    Suffix i + 1 shares at least one code less with its predecessor than suffix i did, so a text is swept with one
    running length.  All fragments are swept in step, one lane each.
    """
    n = len(codes)
    out = np.zeros(n, np.int64)
    padded = np.concatenate([codes, np.zeros(cap + 1, codes.dtype)])
    lane = np.argsort(-size, kind="stable")
    begin, size = begin[lane], size[lane]
    running = np.zeros(len(begin), np.int64)
    for t in range(int(size[0]) if len(size) else 0):
        lanes = np.searchsorted(-size, -t, side="left")
        i = begin[:lanes] + t
        j = order[np.maximum(place[i] - 1, 0)]
        length = running[:lanes]
        go = np.flatnonzero(place[i] > 0)
        length[place[i] == 0] = 0
        while len(go):
            more = (padded[i[go] + length[go]] == padded[j[go] + length[go]]) & (padded[i[go] + length[go]] != 0) & (length[go] < cap)
            go = go[more]
            length[go] += 1
        out[i] = length
        running[:lanes] = np.maximum(length - 1, 0)
    return out


def shard_repeats(pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For PIECE records sorted by (doc, start): piece and offset of every window, whether it repeats an earlier one of
    the shard, and a digest of it."""
    size = pieces["size"].astype(np.int64)
    codes = np.zeros(int(size.sum()) + len(size), np.uint8)
    begin = np.cumsum(size + 1) - size - 1
    owner = np.repeat(np.arange(len(size)), size)
    offset = np.arange(len(owner)) - (np.cumsum(size) - size)[owner]
    place_of = begin[owner] + offset
    codes[place_of] = np.frombuffer(b"".join(pieces["bytes"].tolist()), np.uint8)
    order, place = suffix_array(codes)
    prefix = common_prefixes(codes, order, place, begin, size)[order]
    window = size[owner] - offset >= LENGTH
    first = np.concatenate([[True], prefix[1:] < LENGTH])
    group = np.cumsum(first) - 1
    least = np.minimum.reduceat(order, np.flatnonzero(first))
    earliest = np.empty(len(codes), np.int64)
    earliest[order] = least[group]
    repeat = earliest[place_of] != place_of
    weights = np.concatenate([np.zeros(1, U), np.cumsum(BYTE_HASH[codes] * power_table(BASE, len(codes))[: len(codes)], dtype=U)])
    at = place_of[window]
    digest = mix64((weights[at + LENGTH] - weights[at]) * power_table(INVERSE, len(codes))[at])
    return owner[window], offset[window], repeat[window], digest


def window_spans(doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    out = np.zeros(len(doc), SPAN)
    out["doc"], out["start"], out["stop"] = doc, start, start + LENGTH
    return merged(out)


def shards(pieces: np.ndarray):
    """Cut a slot's pieces into shards: whole anchors where they fit; True where an anchor spreads over shards."""
    if not len(pieces):
        return
    pieces = pieces[np.argsort(pieces["anchor"], kind="stable")]
    cost = np.cumsum(pieces["size"].astype(np.int64) + 1)
    edges = np.flatnonzero(np.concatenate([[True], pieces["anchor"][1:] != pieces["anchor"][:-1], [True]]))
    start, spread = 0, False
    for a, b in zip(edges[:-1], edges[1:]):
        if cost[b - 1] - (cost[start - 1] if start else 0) > SHARD_BYTES:
            if a > start:
                yield pieces[start:a], False
            start = a
            if cost[b - 1] - (cost[a - 1] if a else 0) > SHARD_BYTES:
                for i, j in slices((pieces["size"][a:b].astype(np.int64) + 1).tolist(), SHARD_BYTES):
                    yield pieces[a + i : a + j], True
                start = b
    if start < len(pieces):
        yield pieces[start:], False


def shard_batches(slots: int):
    """Repeats inside shards as spans by document; windows of spread anchors by digest (slots from `slots`)."""

    def run(batches):
        for _, records in read_slots(batches, PIECE):
            hot = records["hot"] == 1
            work = [*shards(records[~hot]), *((p, True) for p, _ in shards(records[hot]))]
            for pieces, spread in work:
                pieces = pieces[np.lexsort((pieces["start"], pieces["doc"]))]
                owner, offset, repeat, digest = shard_repeats(pieces)
                doc, start = pieces["doc"][owner], pieces["start"][owner] + offset
                spans = window_spans(doc[repeat], start[repeat])
                if len(spans):
                    yield to_blobs(doc_slot(spans["doc"], slots), spans)
                if spread:
                    windows = np.empty(int((~repeat).sum()), WINDOW)
                    windows["digest"], windows["doc"], windows["start"] = digest[~repeat], doc[~repeat], start[~repeat]
                    windows = windows[np.argsort(windows["digest"], kind="stable")]
                    yield to_blobs((windows["digest"] % U(slots)).astype(np.int32) + np.int32(slots), windows)

    return run


def merge_batches(slots: int):
    """Spans pass through; sorted window digests of several shards are merged by binary search."""

    def run(batches):
        for slot, raw in read_slots(batches, np.uint8):
            if slot < slots:
                yield to_blobs(np.full(len(raw) // SPAN.itemsize, slot, np.int32), raw.view(SPAN))
                continue
            windows = raw.view(WINDOW)
            windows = windows[np.lexsort((windows["start"], windows["doc"]))]
            distinct = np.unique(windows["digest"])
            at = np.searchsorted(distinct, windows["digest"])
            first = np.full(len(distinct), len(windows))
            np.minimum.at(first, at, np.arange(len(windows)))
            again = first[at] != np.arange(len(windows))
            spans = window_spans(windows["doc"][again], windows["start"][again].astype(np.int64))
            if len(spans):
                yield to_blobs(doc_slot(spans["doc"], slots), spans)

    return run


def repeat_spans(rows: DataFrame, slots: int) -> DataFrame:
    """(slot, kind 0, blob) spans to remove, for rows (__key, text)."""
    spark = rows.sparkSession
    small_batches(spark)
    sample = rows.where(F.pmod(F.xxhash64("__key"), F.lit(SAMPLE_SHARE)) == 0).mapInArrow(hot_batches, "anchor long, n long")
    found = sample.groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_FRAGMENTS).orderBy(F.desc("n"), "anchor").limit(MAX_HOT).collect()
    hot = np.sort(np.array([r["anchor"] for r in found], dtype=np.int64).view(U))
    anchors = exchange_blobs(rows.mapInArrow(anchor_batches(hot, slots), "slot int, blob binary"))
    spans = checkpoint(anchors.mapInArrow(equal_batches(hot, slots), "slot int, blob binary"))
    del anchors  # its exchange is not needed again
    together = beside(spans, rows, slots)
    pieces = exchange_blobs(together.mapInArrow(piece_batches(slots), "slot int, blob binary"))
    inner = exchange_blobs(pieces.mapInArrow(shard_batches(slots), "slot int, blob binary"))
    more = checkpoint(inner.mapInArrow(merge_batches(slots), "slot int, blob binary"))
    del together, pieces, inner
    release(spark)
    return spans.union(more)


def beside(spans: DataFrame, rows: DataFrame, slots: int) -> DataFrame:
    """Spans and texts of a slot in one partition, spans first."""
    texts = rows.mapInArrow(text_blobs(slots), "slot int, kind byte, blob binary")
    both = spans.selectExpr("slot", "cast(0 as byte) kind", "blob").union(texts)
    return deal_slots(both, "kind")


def cut(data: bytes, spans: np.ndarray) -> tuple[bytes, list[tuple[int, int]]]:
    """Kept bytes and the maximal removed runs."""
    united = merged(spans)
    runs = list(zip(united["start"].tolist(), united["stop"].tolist()))
    if not runs:
        return data, runs
    edges = [0, *[e for r in runs for e in r], len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2])), runs


def cut_batches(schema: pa.Schema, text_at: int, results):
    """Cut every row; `results(rows, kept bytes, runs)` makes the output columns."""

    def run(batches):
        for rows, spans in with_spans(batches):
            spans = spans[spans["kind"] == REPEAT]
            kept, all_runs = [], []
            for key, text in zip(rows.column(0).to_pylist(), rows.column(text_at).to_pylist()):
                a, b = np.searchsorted(spans["doc"], [key, key + 1])
                left, runs = cut((text or "").encode("utf-8", "replace"), spans[a:b])
                kept.append(left)
                all_runs.append(runs)
            yield pa.RecordBatch.from_arrays(results(rows, kept, all_runs), schema=schema)

    return run


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, kept (binary: the remaining bytes) and removed (array of start, stop) of every document."""
    slots = shuffle_width(docs.sparkSession)
    rows = keyed(docs.select("doc_id", "text")).select("__key", "text", F.col("doc_id").cast("long").alias("doc_id"))
    spans = repeat_spans(rows.select("__key", "text"), slots)
    span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("kept", pa.binary()), ("removed", pa.list_(span))])

    def results(rows, kept, runs):
        sizes = [len(k) + sum(b - a for a, b in r) for k, r in zip(kept, runs)]
        listed = [[{"start": a, "stop": b} for a, b in r] for r in runs]
        return [rows.column(2).combine_chunks(), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()), pa.array(listed, schema.field("removed").type)]

    out = "doc_id long, n_bytes long, kept binary, removed array<struct<start:long,stop:long>>"
    return beside(spans, rows, slots).mapInArrow(cut_batches(schema, 1, results), out)


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns of `repeats`."""
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def remove_repeats(docs: DataFrame) -> DataFrame:
    """`docs` with repeated strings cut out of text (a character cut in part goes whole) and n_chars to match."""
    slots = shuffle_width(docs.sparkSession)
    original = docs.columns
    rows = keyed(plain_names(docs))
    names = rows.columns
    text_at = names.index("text")
    spans = repeat_spans(rows.select("__key", "text"), slots)
    kept_fields = T.StructType([f for f in rows.schema.fields if f.name != "__key"])
    schema = to_arrow_schema(kept_fields)

    def results(rows, kept, runs):
        texts = [k.decode("utf-8", "ignore") if r else t for k, r, t in zip(kept, runs, rows.column(text_at).to_pylist())]
        changed = {"text": pa.array(texts, schema.field("text").type)}
        if "n_chars" in names:
            n = [len(t) if r else c for t, r, c in zip(texts, runs, rows.column(names.index("n_chars")).to_pylist())]
            changed["n_chars"] = pa.array(n, schema.field("n_chars").type)
        return [changed[f.name] if f.name in changed else rows.column(names.index(f.name)).combine_chunks().cast(f.type) for f in schema]

    return beside(spans, rows, slots).mapInArrow(cut_batches(schema, text_at, results), kept_fields).toDF(*original)
