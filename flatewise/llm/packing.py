"""Operator 8: order-preserving sequence packing by dynamic programming.

Documents are taken in doc_id order inside each input partition; their ids (byte-level BPE, then the end id) form one
stream, which is cut into windows of at most 2048 ids.  Candidate cuts are document ends (free), sentence ends
(small penalty) and, inside long sentences, a grid of positions (larger penalty), so any text can be cut.  With
f(c) the least cost of the stream up to candidate c,

    f(c) = penalty(c) + min over c' with c - c' <= 2048 of f(c') + (2048 - (c - c'))

and since the padding is linear in c', the minimum of f(c') + c' over the sliding window comes from a monotone queue.
Windows whose length is a power of two are not padded; the two long ones are extra transitions, and the last window
of a run is cut into powers of two where that costs less than its padding.

There is no shuffle: a partition is packed on its own, in runs of bounded size, so tasks are independent and a
recomputed task writes the same rows.  A document is never split over partitions.

Defined cases: null text is empty (one piece holding the end id); repeated rows are packed separately; rows with a
null doc_id come first; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from flatewise.llm.bpe import byte_symbols
from flatewise.llm.common import small_batches

WINDOW = 2048
SENTENCE_CUT = 6.0
GRID_CUT = 20.0
GRID = 64
RUN_TOKENS = 2_000_000
END_ID = 1
CACHE_ENTRIES = 500_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_RUNS = re.compile(r"\s (?:\s|$)")


def ranked(vocab: dict[str, int], special: set[str]):
    """The same vocabulary for the faster library: there a token's id is its merge rank, as it is in this file."""
    import tiktoken
    from public_tokenizers import PATTERN

    byte = {s: i for i, s in enumerate(byte_symbols())}
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class ByteBpe:
    """Ids of a byte-level vocabulary as packed little-endian 32-bit integers.

    Pre-tokenisation never joins characters across a single space, so a text is split at spaces and the ids of each
    space-led word come from a bounded cache; texts with runs of white space or special strings go whole through
    the tokenizers library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        size = max(vocab.values()) + 1
        self.ends, self.starts = np.zeros(size, bool), np.zeros(size, bool)
        for token, i in vocab.items():
            self.ends[i] = token[-1] in ".!?Ċ"
            self.starts[i] = token[0] in "ĠĊ"
        self.special = [t for t in ("<|endoftext|>",) if t in vocab]
        self.cache: dict[str, bytes] = {}
        self.fast = ranked(vocab, {t for t in vocab if t in self.special})

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def fill(self, words: list[str]) -> None:
        missing = list({w for w in words if w not in self.cache})
        if len(self.cache) + len(missing) > CACHE_ENTRIES:
            self.cache.clear()
            missing = list(set(words))
        for word in missing:
            self.cache[word] = np.array(self.fast(word), dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if _RUNS.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        words = text.replace(" ", "\x00 ").split("\x00") if "\x00" not in text else [text]
        try:
            return b"".join([self.cache[w] for w in words])
        except KeyError:
            self.fill(words)
            return b"".join([self.cache[w] for w in words])


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def best_cuts(positions: list[int], penalties: list[float], window: int = WINDOW) -> list[int]:
    """Indices of the chosen cuts, first (0) and last included; consecutive positions differ by at most `window`."""
    m = len(positions)
    cost, back = [0.0] * m, [0] * m
    index = {0: 0}
    queue: deque[tuple[float, int, int]] = deque([(0.0, 0, 0)])  # cost + position, position, index
    half, quarter = window // 2, window // 4
    find = index.get
    for i in range(1, m):
        c = positions[i]
        while queue[0][1] < c - window:
            queue.popleft()
        key, _, j = queue[0]
        best = key + window - c
        k = find(c - half)
        if k is not None and cost[k] < best:
            best, j = cost[k], k
        k = find(c - quarter)
        if k is not None and cost[k] < best:
            best, j = cost[k], k
        best += penalties[i]
        cost[i], back[i] = best, j
        index[c] = i
        key = best + c
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, c, i))
    cuts, i = [m - 1], m - 1
    while i:
        i = back[i]
        cuts.append(i)
    return cuts[::-1]


def candidates(ids: np.ndarray, ends: np.ndarray, bpe: ByteBpe) -> tuple[np.ndarray, np.ndarray]:
    """Cut positions of a run (0 and its length included) and their penalties; `ends` are the document ends."""
    n = len(ids)
    sentence = np.flatnonzero(bpe.ends[ids[:-1]] & bpe.starts[ids[1:]]) + 1 if n > 1 else np.empty(0, np.int64)
    firm = np.unique(np.concatenate([[0], sentence, ends]))
    gaps = np.diff(firm)
    extra = np.maximum(0, -(-gaps // GRID) - 1)
    run = np.repeat(np.arange(len(gaps)), extra)
    step = np.arange(len(run)) - (np.cumsum(extra) - extra)[run] + 1
    grid = firm[run] + step * GRID
    at = np.concatenate([firm, grid])
    penalty = np.concatenate([np.full(len(firm), SENTENCE_CUT), np.full(len(grid), GRID_CUT)])
    penalty[: len(firm)][np.isin(firm, ends)] = 0
    penalty[0] = 0
    order = np.argsort(at, kind="stable")
    return at[order], penalty[order]


def windows(ids: np.ndarray, ends: np.ndarray, bpe: ByteBpe) -> list[int]:
    """Window borders of a run, from 0 to its length."""
    at, penalty = candidates(ids, ends, bpe)
    at_list = at.tolist()
    borders = [at_list[i] for i in best_cuts(at_list, penalty.tolist())]
    if len(borders) > 1:  # the last window, in powers of two where that is cheaper than padding it
        last = borders[-1] - borders[-2]
        if (last.bit_count() - 1) * GRID_CUT < WINDOW - last:
            left, stop = borders[-2], borders.pop()
            for bit in range(11, -1, -1):
                if last >> bit & 1:
                    left += 1 << bit
                    borders.append(left)
            assert borders[-1] == stop
    return borders


def pack_run(documents: list[tuple[int | None, bytes]], bpe: ByteBpe, sequence: int) -> tuple[list[tuple], int]:
    """Pieces of one run; `sequence` is the first free sequence id."""
    sizes = np.array([len(b) // 4 for _, b in documents], dtype=np.int64)
    ends = np.cumsum(sizes)
    ids = np.frombuffer(b"".join(b for _, b in documents), dtype="<u4")
    borders = windows(ids, ends, bpe)
    out, d, begin = [], 0, 0
    for left, right in zip(borders[:-1], borders[1:]):
        offset, at = 0, left
        while at < right:
            while ends[d] <= at:
                begin = int(ends[d])
                d += 1
            stop = min(right, int(ends[d]))
            doc_id, data = documents[d]
            crc = zlib.crc32(data[4 * (at - begin) : 4 * (stop - begin)])
            out.append((doc_id, at - begin, stop - at, crc, int(sizes[d]), sequence, offset))
            offset += stop - at
            at = stop
        sequence += 1
    return out, sequence


def pack_batches(path: str):
    def run(batches):
        bpe = load(path)
        end = np.array([END_ID], dtype="<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 36
        held, total = [], 0

        def emit(rows):
            columns = list(zip(*rows))
            arrays = [pa.array(list(c), pa.int64()) for c in columns]
            return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = bpe.encode(text or "") + end
                held.append((doc_id, data))
                total += len(data) // 4
                if total >= RUN_TOKENS:
                    rows, sequence = pack_run(held, bpe, sequence)
                    held, total = [], 0
                    yield emit(rows)
        if held:
            rows, sequence = pack_run(held, bpe, sequence)
            yield emit(rows)

    return run


def pack_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Rows of pieces (see SCHEMA) for all documents."""
    small_batches(docs.sparkSession)
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text").sortWithinPartitions("doc_id")
    return rows.mapInArrow(pack_batches(vocabulary), SCHEMA)
