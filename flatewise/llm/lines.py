"""Operator 7: near-duplicate lines by an exact set-similarity join.

A line is the set of its words (runs of bytes other than ASCII white space).  A line goes if an earlier line of the
corpus (smaller doc_id, or earlier in the same document) has Jaccard similarity of at least 0.8 with it; lines are
judged on the input.  Lines without words stay.

1. *Rarity.*  Word frequencies are counted over all lines in a table of fixed size (`BUCKETS`).  The words of a line
   are ordered by quantised frequency, then by 64-bit hash, so the order is the same everywhere.
2. *Equal sets* meet by a 128-bit hash of the set; all but the first go.
3. *Prefixes.*  Sets that overlap enough share one of their rarest |s| - ceil(0.8 |s|) + 1 words.  Records of the
   prefix words meet by word; pairs must pass the length filter, the positional filter and a bound on the symmetric
   difference by 128 parity bits.  A record looks through its word's earlier lines from the first on and stops at
   its second fitting candidate.  Words whose records are many (by a table of counts over a sample of documents, which
   steers the dealing only) are dealt into blocks, and pairs of blocks are separate work items.
4. *Verification.*  Of a line's candidates the `TESTED` best supported are verified first: both lines are fetched from
   their texts and their words are compared.  Lines that this does not settle are then compared with all their other
   candidates, in waves over the lines fetched for them once.  Only texts of documents with such lines are dealt (by a table
   of 2^24 bits, which steers the dealing only).

Hashes decide nothing but equality of whole sets (128 bits) and of a word within one line (64 bits).

Defined cases: null and empty texts are one line without words; rows with one doc_id are ordered by the MD5 of their
text and equal ones are the same document; a null doc_id sorts before all; columns other than doc_id and text are
passed on by `remove_lines`; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flatewise.llm.common import MIX_STEP, checkpoint, deal_slots, exchange_blobs, keyed, mix64, pack, plain_names, read_slots, segments, shuffle_width, small_batches, to_blobs, trim, unpack
from flatewise.llm.suffix import BASE, BYTE_HASH, INVERSE, doc_slot, power_table, text_blobs

NUMERATOR, DENOMINATOR = 4, 5  # similarity 0.8
BUCKETS = 1 << 18
CHUNK = 1 << 12
CODE_BITS = 36
BATCH_BYTES = 1_000_000
FLUSH = 250_000
TESTED = 2
WAVE_PAIRS = 30_000
SAMPLE_SHARE = 64
BLOCK = 8192
DOC_BITS = 24
BIT_CHUNK = 1 << 18
LONG = 64
U = np.uint64
FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], U)

LINE = np.dtype([("set", "<u8"), ("set2", "<u8"), ("doc", "<i8"), ("line", "<u4")])
PREFIX = np.dtype([("word", "<u8"), ("i", "<u4"), ("j", "<u4"), ("side", "u1"), ("set", "<u8"), ("even", "<u8"), ("odd", "<u8"), ("size", "<u4"), ("place", "<u4"), ("doc", "<i8"), ("line", "<u4")])
OFFER = np.dtype([("doc", "<i8"), ("line", "<u4"), ("to_doc", "<i8"), ("to_line", "<u4"), ("apart", "u1")])
PAIR = np.dtype([("doc", "<i8"), ("line", "<u4"), ("to_doc", "<i8"), ("to_line", "<u4")])
REQUEST = np.dtype([("doc", "<i8"), ("line", "<u4"), ("slot", "<i4")])


def need(a, b):
    """Least overlap of sets of sizes a and b for the similarity: ceil(t (a + b) / (1 + t))."""
    return -(-(NUMERATOR * (a + b)) // (NUMERATOR + DENOMINATOR))


def pieces(batch: pa.RecordBatch):
    """Lists of (key, number of the first line, bytes) of about `BATCH_BYTES`; a longer text is cut between lines."""
    held, total = [], 0
    for key, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
        data, at, line = data or b"", 0, 0
        while True:
            stop = len(data)
            if stop - at > BATCH_BYTES:
                cut = data.rfind(b"\n", at, at + BATCH_BYTES)
                stop = cut if cut >= 0 else data.find(b"\n", at + BATCH_BYTES)
                stop = stop if stop >= 0 else len(data)
            part = data[at:stop]
            if total + len(part) > BATCH_BYTES and held:
                yield held
                held, total = [], 0
            held.append((key, line, part))
            total += len(part) + 1
            if stop == len(data):
                break
            line += part.count(b"\n") + 1
            at = stop + 1
    if held:
        yield held


def word_hashes(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the words data[begin : begin + size]: of eight bytes at a time, of longer words than `LONG` by powers."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from every position
    word = mix64((eight[begin] & FIRST_BYTES[np.minimum(size, 8)]) + size.astype(U) * U(MIX_STEP))
    at, left = 8, np.flatnonzero((size > 8) & (size <= LONG))
    while len(left):
        rest = eight[begin[left] + at] & FIRST_BYTES[np.minimum(size[left] - at, 8)]
        word[left] = mix64(word[left] * U(BASE) + mix64(rest))
        at += 8
        left = left[size[left] > at]
    large = np.flatnonzero(size > LONG)
    if len(large):
        run, offset = segments(size[large])
        values = BYTE_HASH[data[begin[large][run] + offset]] * power_table(BASE, len(run))[: len(run)]
        prefix = np.concatenate([np.zeros(1, U), np.cumsum(values, dtype=U)])
        last = np.cumsum(size[large])
        first = last - size[large]
        word[large] = mix64((prefix[last] - prefix[first]) * power_table(INVERSE, len(run))[first] + size[large].astype(U) * U(MIX_STEP))
    return word


def line_words(texts: list[bytes]):
    """Lines of some texts: (text number, line number in it) of every line, and (line, word hash) of every word."""
    counts = np.array([t.count(b"\n") + 1 for t in texts], dtype=np.int64)
    text_of, line_no = segments(counts)
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    end = np.flatnonzero(data == 10)
    space = (data == 32) | (data - np.uint8(9) <= 4)
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    edge = edge if space[0] else np.concatenate([[0], edge])
    begin, stop = edge[::2], edge[1::2]  # the last byte is white space
    word = word_hashes(data, begin, stop - begin)
    before = np.searchsorted(begin, end)  # words up to the end of each line
    return text_of, line_no, np.repeat(np.arange(len(end)), np.diff(before, prepend=0)), word


def bucket_of(word: np.ndarray) -> np.ndarray:
    return (word >> U(CODE_BITS)).astype(np.int64) % BUCKETS


def counted(batches, words_of):
    """Counts by bucket of the words of all pieces, as one blob for each chunk of buckets and task."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for part in pieces(batch):
            total += np.bincount(bucket_of(words_of(part)), minlength=BUCKETS)
    trim()
    if total.any():
        parts = total.reshape(-1, CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([pack(p) for p in parts], pa.binary())], names=["slot", "blob"])


def chunk_sums(batches):
    for slot, values in read_slots(batches, np.int64):
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([values.reshape(-1, CHUNK).sum(axis=0).tobytes()], pa.binary())], names=["slot", "blob"])


def count_table(rows: DataFrame, words_of) -> np.ndarray:
    """Word counts of rows (__key, text) by bucket; a table of fixed size."""
    blobs = rows.mapInArrow(lambda batches: counted(batches, words_of), "slot int, blob binary")
    total = np.zeros(BUCKETS, np.int64)
    for slot, blob in exchange_blobs(blobs).mapInArrow(chunk_sums, "slot int, blob binary").collect():
        total[slot * CHUNK : (slot + 1) * CHUNK] = np.frombuffer(blob, np.int64)
    return total


def rarity(rows: DataFrame) -> np.ndarray:
    """Quantised frequency (one byte) of every bucket."""
    total = count_table(rows, lambda part: line_words([t for *_, t in part])[3])
    return np.minimum(255, np.floor(8 * np.log2(total + 1))).astype(np.uint8)


def block_table(rows: DataFrame, frequency: np.ndarray) -> np.ndarray:
    """Number of blocks into which the prefix records of every bucket's words are dealt, from a sample of documents."""
    sample = rows.where(F.pmod(F.xxhash64("__key"), F.lit(SAMPLE_SHARE)) == 0)
    total = count_table(sample, lambda part: Sets(part, frequency).prefixes()["word"])
    return np.maximum(1, -(-total * SAMPLE_SHARE // BLOCK)).astype(np.uint32)


class Sets:
    """Word sets of the lines of some pieces: words of line k are words[first[k] : first[k] + size[k]], rare first."""

    def __init__(self, part: list[tuple[int, int, bytes]], frequency: np.ndarray):
        text_of, line_no, line, word = line_words([t for *_, t in part])
        code = (line.astype(U) << U(CODE_BITS + 8)) | (frequency[bucket_of(word)].astype(U) << U(CODE_BITS)) | (word & U((1 << CODE_BITS) - 1))
        order = np.argsort(code)
        code, word = code[order], word[order]
        fresh = np.ones(len(code), bool)
        fresh[1:] = word[1:] != word[:-1]
        same = np.zeros(len(code), bool)
        same[1:] = code[1:] == code[:-1]
        if (same & fresh).any():  # different words with one code: order them by the whole hash
            order = np.lexsort((word, code))
            code, word = code[order], word[order]
            fresh[1:] = word[1:] != word[:-1]
        fresh[1:] |= code[1:] != code[:-1]
        self.words = word[fresh]
        line = (code[fresh] >> U(CODE_BITS + 8)).astype(np.int64)
        self.size = np.bincount(line, minlength=len(text_of))
        self.first = np.cumsum(self.size) - self.size
        self.doc = np.array([k for k, *_ in part], np.int64)[text_of]
        self.line = line_no + np.array([n for _, n, _ in part], np.int64)[text_of]
        self.filled = np.flatnonzero(self.size)
        self.set, self.set2 = (self.folded(np.add, mix64(self.words ^ U(salt))) for salt in (MIX_STEP, 0xD6E8FEB86659FD93))

    def folded(self, ufunc, values: np.ndarray) -> np.ndarray:
        """`values` of the words of each line combined, as 64-bit numbers."""
        out = np.zeros(len(self.size), U)
        if len(self.filled):
            out[self.filled] = ufunc.reduceat(values, self.first[self.filled])
        return out

    def lines(self) -> np.ndarray:
        some = self.filled
        out = np.empty(len(some), LINE)
        out["set"], out["set2"], out["doc"], out["line"] = self.set[some], self.set2[some], self.doc[some], self.line[some]
        return out

    def prefixes(self) -> np.ndarray:
        """Prefix records of the lines of 4 words or more (smaller sets only match equal ones), each set once."""
        some = np.flatnonzero(self.size >= NUMERATOR)
        order = some[np.lexsort((self.line[some], self.doc[some], self.set2[some], self.set[some]))]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (self.set[order][1:] != self.set[order][:-1]) | (self.set2[order][1:] != self.set2[order][:-1])
        some = order[fresh]
        size = self.size[some]
        length = size - -(-NUMERATOR * size // DENOMINATOR) + 1
        run, place = segments(length)
        bit = self.words >> U(7) & U(127)
        flag = U(1) << (bit & U(63))
        even, odd = (self.folded(np.bitwise_xor, np.where(bit >> U(6) == U(half), flag, U(0))) for half in (0, 1))
        out = np.zeros(len(run), PREFIX)
        owner = some[run]
        out["word"] = self.words[self.first[owner] + place]
        out["set"], out["even"], out["odd"], out["size"], out["place"] = self.set[owner], even[owner], odd[owner], self.size[owner], place
        out["doc"], out["line"] = self.doc[owner], self.line[owner]
        return out


def sets_of(batches, frequency: np.ndarray):
    for batch in batches:
        for part in pieces(batch):
            yield Sets(part, frequency)
    trim()


def spread(records: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Records of words dealt into blocks, once for each pair of blocks that their block takes part in."""
    n = blocks[bucket_of(records["word"])].astype(np.int64)
    hot = n > 1
    if not hot.any():
        return records
    rows, other = segments(n[hot])
    more = records[hot][rows]
    block = (mix64(more["set"]) % n[hot][rows].astype(U)).astype(np.int64)
    more["i"], more["j"], more["side"] = np.minimum(block, other), np.maximum(block, other), block > other
    return np.concatenate([records[~hot], more])


def record_batches(frequency: np.ndarray, blocks: np.ndarray, slots: int):
    """Lines by set (slots from `slots`) and prefix records by word (slots from 0)."""

    def run(batches):
        lines, prefixes, total = [], [], 0

        def emit():
            found = np.concatenate(lines)
            yield to_blobs((found["set"] % U(slots)).astype(np.int32) + np.int32(slots), found)
            records = np.concatenate(prefixes)
            if len(records):
                records = spread(records, blocks)
                yield to_blobs((item_key(records) % U(slots)).astype(np.int32), records)

        for sets in sets_of(batches, frequency):
            lines.append(sets.lines())
            prefixes.append(sets.prefixes())
            total += len(prefixes[-1]) + len(lines[-1])
            if total >= FLUSH:
                yield from emit()
                lines, prefixes, total = [], [], 0
        if total:
            yield from emit()

    return run


def item_key(records: np.ndarray) -> np.ndarray:
    return mix64(records["word"] + records["i"].astype(U) * U(MIX_STEP) + records["j"].astype(U) * U(0xC4CEB9FE1A85EC53))


def pair_rows(records: np.ndarray, y: np.ndarray, x: np.ndarray, apart: np.ndarray) -> np.ndarray:
    out = np.empty(len(y), OFFER)
    out["doc"], out["line"], out["to_doc"], out["to_line"] = records["doc"][y], records["line"][y], records["doc"][x], records["line"][x]
    out["apart"] = np.minimum(apart, 255)
    return out


class Columns:
    """The compared columns of records, each by itself for fast access."""

    def __init__(self, records: np.ndarray):
        self.size = records["size"].astype(np.int64)
        self.rest = self.size - records["place"]
        self.both = self.size << 32 | self.rest  # read at once
        self.even, self.odd = records["even"].copy(), records["odd"].copy()
        self.blocks = None if not records["j"].any() else (records["i"] == records["j"], records["side"].copy())


class Seekers:
    """Records that look through the earlier ones of their item, deepest first, with what they compare beside them."""

    NAMES = ("y", "begin", "depth", "size", "rest", "low", "high")

    def __init__(self, columns: Columns, y: np.ndarray, place: np.ndarray):
        self.y = y[np.argsort(-place[y], kind="stable")]
        self.depth, self.size, self.rest = place[self.y], columns.size[self.y], columns.rest[self.y]
        self.begin = self.y - self.depth
        self.low, self.high = -(-NUMERATOR * self.size // DENOMINATOR), DENOMINATOR * self.size // NUMERATOR
        self.columns = columns

    def only(self, which) -> None:
        for name in self.NAMES:
            setattr(self, name, getattr(self, name)[which])

    def deeper(self, step: int) -> None:
        """Leave those that have a record `step` places after the first of their item."""
        self.only(slice(0, int(np.searchsorted(-self.depth, -step))))

    def fitting(self, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (y, x) with the record at `step` of each item whose lengths, positions and parities allow the similarity,
        and how far their parities are apart."""
        c, x = self.columns, self.begin + step
        both = c.both[x]
        a = both >> 32
        at = np.flatnonzero((a >= self.low) & (a <= self.high))
        total = a[at] + self.size[at]
        least = need(total, 0)
        good = np.minimum(both[at] & 0xFFFFFFFF, self.rest[at]) >= least
        at, most = at[good], (total - 2 * least)[good]
        x, y = x[at], self.y[at]
        if c.blocks is not None:
            good = c.blocks[0][x] | (c.blocks[1][x] != c.blocks[1][y])
            x, y, most = x[good], y[good], most[good]
        apart = np.bitwise_count(c.even[x] ^ c.even[y]).astype(np.int64) + np.bitwise_count(c.odd[x] ^ c.odd[y])
        good = apart <= most
        return y[good], x[good], apart[good]


def distinct_records(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records of items that hold more than one set, each set once an item (its first line), sorted by item and line;
    the place of each in its item; and the item sizes."""
    key = item_key(raw)
    order = np.argsort(key)
    fresh = np.ones(len(order), bool)
    fresh[1:] = key[order[1:]] != key[order[:-1]]
    item = np.cumsum(fresh) - 1
    several = np.bincount(item)[item] > 1
    order, item = order[several], item[several]
    order = order[by_line(item, raw["doc"][order], raw["line"][order])]  # items keep their places
    own = mix64(item.astype(U) * U(MIX_STEP) ^ raw["set"][order])
    by_own = np.argsort(own)
    new = np.ones(len(own), bool)
    new[1:] = own[by_own[1:]] != own[by_own[:-1]]
    once = np.zeros(len(own), bool)
    if len(own):
        once[np.minimum.reduceat(by_own, np.flatnonzero(new))] = True
    order, item = order[once], item[once]
    size = np.bincount(item, minlength=1)
    keep = size[item] > 1
    size = size[size > 1]
    return raw[order[keep]], segments(size)[1], size


def by_line(item: np.ndarray, doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Order by item, document and line: of one number each where that has room for all three."""
    if not len(item):
        return np.empty(0, np.int64)
    low = int(doc.min())
    widths = [int(v).bit_length() for v in (int(item.max()), int(doc.max()) - low, int(line.max()))]
    if sum(widths) > 63:
        return np.lexsort((line, doc, item))
    return np.argsort((item << widths[1] | (doc - low)) << widths[2] | line)


def offers(records: np.ndarray, place: np.ndarray, asking: np.ndarray | None = None):
    """Candidates of records among the earlier ones of their item, and a mask of the records that have yet more.

    A record stops looking at its second candidate; those of `asking`, where given, look through all.
    """
    seen, more, out = np.zeros(len(records), np.int8), np.zeros(len(records), bool), []
    step, open_ = 0, Seekers(Columns(records), np.flatnonzero(place > 0 if asking is None else (place > 0) & asking), place)
    while len(open_.y):
        y, x, apart = open_.fitting(step)
        if len(y):
            if asking is None:
                third = seen[y] >= TESTED
                more[y[third]] = True
                seen[y] += 1
                out.append(pair_rows(records, y[~third], x[~third], apart[~third]))
                if third.any():
                    open_.only(~more[open_.y])
            else:
                out.append(pair_rows(records, y, x, apart))
        step += 1
        open_.deeper(step)
    return np.concatenate(out) if out else np.empty(0, OFFER), more


GONE, OFFERED, MORE, GROUP = 0, 1, 2, 3
TEST, RESERVE = 0, 1


def tagged(kind: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array([kind] * batch.num_rows, pa.int8()), batch.column(1)], names=["slot", "kind", "blob"])


def meet_batches(slots: int):
    """Equal sets: later lines, by document.  Prefix records: candidate pairs by document of the later line; lines that have
    more candidates than they were given (with this slot), likewise; and the records of their items, by this slot."""

    def run(batches):
        for slot, raw in read_slots(batches, np.uint8):
            if slot >= slots:
                lines = raw.view(LINE)
                lines = lines[np.lexsort((lines["line"], lines["doc"], lines["set2"], lines["set"]))]
                again = np.zeros(len(lines), bool)
                again[1:] = (lines["set"][1:] == lines["set"][:-1]) & (lines["set2"][1:] == lines["set2"][:-1])
                gone = np.zeros(int(again.sum()), PAIR)
                gone["doc"], gone["line"] = lines["doc"][again], lines["line"][again]
                if len(gone):
                    yield tagged(GONE, to_blobs(doc_slot(gone["doc"], slots), gone))
                continue
            records, place, size = distinct_records(raw.view(PREFIX))
            if not len(records):
                continue
            offered, more = offers(records, place)
            if len(offered):
                yield tagged(OFFERED, to_blobs(doc_slot(offered["doc"], slots), offered))
            if more.any():
                item = np.repeat(np.arange(len(size)), size)
                kept = records[np.isin(item, item[more])]
                lines = np.empty(int(more.sum()), REQUEST)
                lines["doc"], lines["line"], lines["slot"] = records["doc"][more], records["line"][more], slot
                lines = np.unique(lines)
                yield tagged(MORE, to_blobs(doc_slot(lines["doc"], slots), lines))
                yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([GROUP], pa.int8()), pa.array([zstandard.compress(pack(kept), 3)], pa.binary())], names=["slot", "kind", "blob"])

    return run


def choose_batches(batches):
    """Of a line's offers the two best supported go to the test, the others into reserve."""
    for slot, offered in read_slots(batches, OFFER):
        order = np.lexsort((offered["to_line"], offered["to_doc"], offered["line"], offered["doc"]))
        offered = offered[order]
        fresh = np.ones(len(offered), bool)
        fresh[1:] = False
        for name in PAIR.names:
            fresh[1:] |= offered[name][1:] != offered[name][:-1]
        at = np.flatnonzero(fresh)
        support = np.diff(np.concatenate([at, [len(offered)]]))
        pairs, apart = offered[at], offered["apart"][at]
        order = np.lexsort((pairs["to_line"], pairs["to_doc"], apart, -support, pairs["line"], pairs["doc"]))
        pairs = pairs[order]
        new = np.ones(len(pairs), bool)
        new[1:] = (pairs["doc"][1:] != pairs["doc"][:-1]) | (pairs["line"][1:] != pairs["line"][:-1])
        at = np.flatnonzero(new)
        rank = np.arange(len(pairs)) - np.repeat(at, np.diff(np.concatenate([at, [len(pairs)]])))
        for kind, part in ((TEST, pairs[rank < TESTED]), (RESERVE, pairs[rank >= TESTED])):
            if len(part):
                yield tagged(kind, to_blobs(np.full(len(part), slot, np.int32), as_pairs(part)))


def as_pairs(records: np.ndarray) -> np.ndarray:
    out = np.empty(len(records), PAIR)
    for name in PAIR.names:
        out[name] = records[name]
    return out


def pairs_in(batches, wave: int = 0, waves: int = 1):
    """Distinct pairs of each batch whose later line belongs to the wave."""
    for batch in batches:
        blobs = [unpack(b) for b in batch.column(1).to_pylist()]
        pairs = np.unique(np.frombuffer(b"".join(blobs), PAIR))
        pairs = pairs[line_ids(pairs) % U(waves) == U(wave)]
        if len(pairs):
            yield pairs


def line_ids(records: np.ndarray) -> np.ndarray:
    return mix64(np.ascontiguousarray(records["doc"]).view(U) * U(MIX_STEP) + records["line"].astype(U))


def test_slot(pairs: np.ndarray, slots: int) -> np.ndarray:
    return (line_ids(pairs) // U(64) % U(slots)).astype(np.int32)


def request_batches(slots: int, wave: int = 0, waves: int = 1):
    """Requests to the documents of both lines of a pair to send these to the slot where the pair is tested."""

    def run(batches):
        for pairs in pairs_in(batches, wave, waves):
            both = np.empty(2 * len(pairs), REQUEST)
            both["doc"], both["line"] = np.concatenate([pairs["doc"], pairs["to_doc"]]), np.concatenate([pairs["line"], pairs["to_line"]])
            both["slot"] = np.tile(test_slot(pairs, slots), 2)
            both = np.unique(both)
            yield to_blobs(doc_slot(both["doc"], slots), both)

    return run


def tested_batches(slots: int, wave: int = 0, waves: int = 1):
    """Pairs by the slot where they are tested."""

    def run(batches):
        for pairs in pairs_in(batches, wave, waves):
            yield to_blobs(test_slot(pairs, slots), pairs)

    return run


LINES = pa.schema([("doc", pa.int64()), ("line", pa.int64()), ("text", pa.large_binary())])


def lines_blob(columns: list) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, LINES, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, LINES)], schema=LINES))
    return sink.getvalue().to_pybytes()


def wanted_lines(rows: pa.Table, asked: np.ndarray):
    """(lines, texts, requests by line) of the documents of a blob of texts, or of a blob of fetched lines."""
    mine = asked[np.isin(asked["doc"], rows.column(0).to_numpy())]
    if not len(mine):
        return
    if "line" in rows.column_names:
        have = {(d, n): t for d, n, t in zip(*(c.to_pylist() for c in rows.columns))}
        for r in mine.tolist():
            text = have.get(r[:2])
            if text is not None:
                yield *r, text
        return
    order = np.argsort(mine["doc"], kind="stable")
    mine = mine[order]
    for key, text in dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())).items():
        a, b = np.searchsorted(mine["doc"], [key, key + 1])
        if a < b:
            split = (text or "").encode("utf-8", "replace").split(b"\n")
            for doc, line, slot in mine[a:b].tolist():
                yield doc, line, slot, split[line]


def fetch_batches(kind: int):
    """Requested lines, to the slots that asked for them."""

    def run(batches):
        held, total = {}, 0

        def emit():
            out = [(slot, kind, lines_blob(columns)) for slot, columns in sorted(held.items())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int8(), pa.binary()))], names=["slot", "kind", "blob"])

        for rows, requests in requests_beside(batches, REQUEST):
            for doc, line, slot, text in wanted_lines(rows, requests):
                columns = held.setdefault(slot, ([], [], []))
                for c, v in zip(columns, (doc, line, text)):
                    c.append(v)
                total += len(text) + 50
                if total >= 8 * BATCH_BYTES:
                    yield emit()
                    held, total = {}, 0
        if held:
            yield emit()

    return run


def requests_beside(batches, dtype: np.dtype = PAIR):
    """For batches sorted by (slot, kind): (rows of an Arrow blob, requests of the slot)."""
    current, parts, requests = None, [], None
    for batch in batches:
        for slot, kind, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            if slot != current:
                current, parts, requests = slot, [], None
            if not kind:
                parts.append(unpack(blob))
                continue
            if requests is None:
                requests = np.unique(np.frombuffer(b"".join(parts), dtype))
                parts = []
            yield pa.ipc.open_stream(blob).read_all(), requests
    trim()


def similar(a: set, b: set) -> bool:
    common = len(a & b)
    return DENOMINATOR * common >= NUMERATOR * (len(a) + len(b) - common)


def verify_batches(slots: int):
    """Later lines of the pairs of a slot that are similar, by document, from batches sorted by (slot, kind)."""

    def run(batches):
        current, pairs, texts = None, [], {}

        def work():
            sets: dict = {}

            def words(line):
                found = sets.get(line)
                if found is None:
                    found = sets[line] = frozenset(texts[line].split())
                return found

            gone, last = [], None
            for doc, line, to_doc, to_line in np.unique(np.frombuffer(b"".join(pairs), PAIR)).tolist() if pairs else []:
                if (doc, line) != last and similar(words((doc, line)), words((to_doc, to_line))):
                    last = (doc, line)
                    gone.append((doc, line, 0, 0))
            if gone:
                found = np.array(gone, PAIR)
                yield to_blobs(doc_slot(found["doc"], slots), found)

        for batch in batches:
            for slot, kind, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if slot != current:
                    yield from work()
                    current, pairs, texts = slot, [], {}
                if kind == 0:
                    pairs.append(unpack(blob))
                else:
                    rows = pa.ipc.open_stream(blob).read_all()
                    texts.update(zip(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()), rows.column(2).to_pylist()))
        yield from work()
        trim()

    return run


def member(lines: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which of `lines` (doc, line) occur in `of`."""
    doc, line = np.concatenate([of["doc"], lines["doc"]]), np.concatenate([of["line"], lines["line"]])
    asked = np.arange(len(doc)) >= len(of)
    order = np.lexsort((asked, line, doc))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (doc[order][1:] != doc[order][:-1]) | (line[order][1:] != line[order][:-1])
    known = ~asked[order][np.flatnonzero(fresh)]
    out = np.empty(len(order), bool)
    out[order] = known[np.cumsum(fresh) - 1]
    return out[len(of) :]


def kinds_of_slots(batches):
    """For batches sorted by slot: the blobs of each slot by kind."""
    current, held = None, {}
    for batch in batches:
        for slot, kind, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if slot != current:
                if held:
                    yield current, held
                current, held = slot, {}
            held.setdefault(kind, []).append(blob)
    if held:
        yield current, held


def records_of(blobs: list[bytes], dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(map(unpack, blobs)), dtype)


def open_batches(batches):
    """Reserve pairs, and lines with more candidates (by the slot that holds them), of lines that are not gone yet."""
    for slot, held in kinds_of_slots(batches):
        gone = records_of(held.get(GONE, []), PAIR)
        for kind, dtype in ((RESERVE, PAIR), (MORE, REQUEST)):
            left = records_of(held.get(kind, []), dtype)
            left = left[~member(left, gone)]
            if len(left):
                yield tagged(kind, to_blobs(left["slot"] if kind == MORE else np.full(len(left), slot, np.int32), left))


def leftover_batches(slots: int):
    """All candidates of the lines still open, from the records of their items."""

    def run(batches):
        for _, held in kinds_of_slots(batches):
            if MORE not in held or GROUP not in held:
                continue
            records, place, _ = distinct_records(records_of([zstandard.decompress(b) for b in held[GROUP]], PREFIX))
            found, _ = offers(records, place, member(records, records_of(held[MORE], REQUEST)))
            if len(found):
                pairs = np.unique(as_pairs(found))
                yield to_blobs(doc_slot(pairs["doc"], slots), pairs)

    return run


BLOBS = "slot int, blob binary"
KINDS = "slot int, kind byte, blob binary"


def of_kind(blobs: DataFrame, kind: int) -> DataFrame:
    return blobs.selectExpr("slot", f"cast({kind} as byte) kind", "blob")


def beside(requests: DataFrame, rows: DataFrame, bits: np.ndarray | None = None) -> DataFrame:
    """Requests and texts of a slot in one partition, requests first; with `bits`, texts of `asked_documents` only."""
    blobs = text_blobs(shuffle_width(rows.sparkSession))
    texts = rows.mapInArrow(blobs if bits is None else lambda batches: blobs(of_documents(batches, bits)), KINDS)
    return deal_slots(of_kind(requests, 0).union(texts), "kind")


def doc_bit(doc: np.ndarray) -> np.ndarray:
    return (mix64(doc.astype(np.int64).view(U) * U(MIX_STEP)) >> U(64 - DOC_BITS)).astype(np.int64)


def marked_batches(batches):
    """Bits of the documents of both lines of pairs, by chunk of bits."""
    found = [np.unique(doc_bit(np.concatenate([p["doc"], p["to_doc"]]))) for p in pairs_in(batches)]
    if found:
        bits = np.unique(np.concatenate(found))
        yield to_blobs((bits // BIT_CHUNK).astype(np.int32), bits.astype(np.uint32))


def united_bits(batches):
    for slot, bits in read_slots(batches, np.uint32):
        flags = np.zeros(BIT_CHUNK, bool)
        flags[bits % BIT_CHUNK] = True
        yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([np.packbits(flags).tobytes()], pa.binary())], names=["slot", "blob"])


def asked_documents(pairs: DataFrame) -> np.ndarray:
    """A table of fixed size with a bit for the hash of each document that takes part in `pairs`: other texts need not travel,
    those that share a bit do so in vain."""
    table = np.zeros((1 << DOC_BITS) // 8, np.uint8)
    width = BIT_CHUNK // 8
    for slot, blob in exchange_blobs(pairs.mapInArrow(marked_batches, BLOBS)).mapInArrow(united_bits, BLOBS).collect():
        table[slot * width : (slot + 1) * width] = np.frombuffer(blob, np.uint8)
    return table


def of_documents(batches, bits: np.ndarray):
    """Rows whose document's bit is set."""
    for batch in batches:
        at = doc_bit(batch.column(0).to_numpy())
        kept = batch.filter(pa.array(bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & np.uint8(1) == 1))
        if kept.num_rows:
            yield kept


def fetched(pairs: DataFrame, rows: DataFrame, slots: int) -> DataFrame:
    """Blobs of all lines that take part in `pairs`, each once, by document."""

    def own_slot(batches):
        for found in pairs_in(batches):
            both = np.empty(2 * len(found), REQUEST)
            both["doc"], both["line"] = np.concatenate([found["doc"], found["to_doc"]]), np.concatenate([found["line"], found["to_line"]])
            both["slot"] = doc_slot(both["doc"], slots)
            both = np.unique(both)
            yield to_blobs(both["slot"], both)

    return checkpoint(beside(pairs.mapInArrow(own_slot, BLOBS), rows, asked_documents(pairs)).mapInArrow(fetch_batches(1), KINDS))


def verified(pairs: DataFrame, source: DataFrame, slots: int, wave: int = 0, waves: int = 1) -> DataFrame:
    """(slot, blob) of the lines that verification removes, from candidate pairs by document; `source` are the rows
    (__key, text) or what `fetched` took from them."""
    requests = pairs.mapInArrow(request_batches(slots, wave, waves), BLOBS)
    both = deal_slots(of_kind(requests, 0).union(source), "kind") if "blob" in source.columns else beside(requests, source, asked_documents(pairs))
    lines = both.mapInArrow(fetch_batches(1), KINDS)
    tested = of_kind(pairs.mapInArrow(tested_batches(slots, wave, waves), BLOBS), 0)
    return checkpoint(deal_slots(tested.union(lines), "kind").mapInArrow(verify_batches(slots), BLOBS))


def gone_rows(batches):
    """(doc, line) rows of blobs."""
    for batch in batches:
        for blob in batch.column(1).to_pylist():
            found = np.frombuffer(unpack(blob), PAIR)
            yield pa.RecordBatch.from_arrays([pa.array(found["doc"]), pa.array(found["line"].astype(np.int64))], names=["doc", "line"])


def removed_lines(rows: DataFrame, slots: int) -> DataFrame:
    """(slot, blob) of all lines to remove, by document, for rows (__key, text)."""
    small_batches(rows.sparkSession)
    frequency = rarity(rows)
    blocks = block_table(rows, frequency)
    records = exchange_blobs(rows.mapInArrow(record_batches(frequency, blocks, slots), BLOBS))
    met = checkpoint(records.mapInArrow(meet_batches(slots), KINDS))
    del records  # its exchange is not needed again

    def part(df, kind):
        return df.where(F.col("kind") == kind).select("slot", "blob")

    chosen = checkpoint(exchange_blobs(part(met, OFFERED)).mapInArrow(choose_batches, KINDS))
    near = verified(part(chosen, TEST), rows, slots)
    found = part(met, GONE).union(near)
    waiting = of_kind(part(chosen, RESERVE), RESERVE).union(of_kind(part(met, MORE), MORE))
    open_ = checkpoint(deal_slots(of_kind(found, GONE).union(waiting), "kind").mapInArrow(open_batches, KINDS))
    if not open_.take(1):
        return found
    asked = part(open_, MORE)
    items = part(met, GROUP).join(F.broadcast(asked.select("slot").distinct()), "slot", "left_semi")  # slots: a bounded number
    again = deal_slots(of_kind(asked, MORE).union(of_kind(items, GROUP))).mapInArrow(leftover_batches(slots), BLOBS)
    left = checkpoint(part(open_, RESERVE).union(again))
    pairs = (left.agg(F.sum(F.length("blob"))).first()[0] or 0) // PAIR.itemsize
    if not pairs:
        return found
    lines = fetched(left, rows, slots)
    waves = 1 + pairs // (WAVE_PAIRS * slots)  # each line is in one wave; a wave's copies of lines are gone before the next
    for wave in range(waves):
        found = found.union(verified(left, lines, slots, wave, waves))
    return found


def line_counts(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed and the numbers of the removed lines of every document."""
    slots = shuffle_width(docs.sparkSession)
    rows = keyed(docs.select("doc_id", "text"))
    gone = removed_lines(rows.select("__key", "text"), slots).mapInArrow(gone_rows, "doc long, line long")
    lists = gone.distinct().groupBy("doc").agg(F.sort_array(F.collect_list("line")).alias("removed"))
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    counted = rows.select(F.col("__key").alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), n.cast("long").alias("n_lines"))
    found = counted.join(lists, "doc", "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<long>")))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def remove_lines(docs: DataFrame) -> DataFrame:
    """`docs` without the removed lines in text, n_chars to match; other columns as they are."""
    slots = shuffle_width(docs.sparkSession)
    original = docs.columns
    rows = keyed(plain_names(docs))
    names = rows.columns
    text_at = names.index("text")
    gone = removed_lines(rows.select("__key", "text"), slots)
    kept_fields = T.StructType([f for f in rows.schema.fields if f.name != "__key"])
    schema = to_arrow_schema(kept_fields)

    def run(batches):
        for part, requests in requests_beside(batches):
            keys, texts = part.column(0).to_pylist(), part.column(text_at).to_pylist()
            chars = part.column(names.index("n_chars")).to_pylist() if "n_chars" in names else None
            for k, (key, text) in enumerate(zip(keys, texts)):
                a, b = np.searchsorted(requests["doc"], [key, key + 1])
                if a != b:
                    drop = set(requests["line"][a:b].tolist())
                    texts[k] = "\n".join(s for i, s in enumerate((text or "").split("\n")) if i not in drop)
                    if chars is not None:
                        chars[k] = len(texts[k])
            changed = {"text": texts, "n_chars": chars}
            yield pa.RecordBatch.from_arrays(
                [pa.array(changed[f.name], f.type) if f.name in ("text", "n_chars") else part.column(names.index(f.name)).combine_chunks().cast(f.type) for f in schema], schema=schema
            )

    return beside(gone, rows).mapInArrow(run, kept_fields).toDF(*original)
