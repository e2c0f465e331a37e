"""DEFLATE encoders available to the engine, exact re-encoding, and an encoder of our own.

`zlib` (CPython's) is a reference encoder: reproducing a stream byte for byte proves its setting.  `own` is written
from RFC 1951 with greedy and lazy parsing; it is synthetic, so models never train on it.  Encoders of other
programs are not on this platform; their profiles are listed as unavailable and nothing is made up for them.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, zip_longest

import numpy as np

from flatewise.operators import inflate
from flatewise.operators.huffman import canonical_codes, limited_lengths

CHUNK = 65536
FLUSH_TAIL = b"\x00\x00\xff\xff\x03\x00"
BLOCK_SPAN = 32768
CHAIN = 128
MADLER = zlib.ZLIB_RUNTIME_VERSION.replace(".", "").isdigit()  # not one of its successors, which search otherwise


def zlib_raw(data: bytes, level: int = 6, mem_level: int = 8, strategy: int = zlib.Z_DEFAULT_STRATEGY, flush: bool = False) -> bytes:
    """Raw DEFLATE of CPython's zlib; with `flush`, a sync flush before the end."""
    c = zlib.compressobj(level, zlib.DEFLATED, -15, mem_level, strategy)
    return c.compress(data) + (c.flush(zlib.Z_SYNC_FLUSH) if flush else b"") + c.flush()


STRATEGIES = {"filt": zlib.Z_FILTERED, "huff": zlib.Z_HUFFMAN_ONLY, "rle": zlib.Z_RLE, "fixed": zlib.Z_FIXED}
ZLIB_SETTINGS = [*map(str, range(1, 10)), "1f", "6f", "9f"]


def zlib_setting(data: bytes, setting: str) -> bytes:
    if setting in STRATEGIES:
        return zlib_raw(data, 6, strategy=STRATEGIES[setting])
    return zlib_raw(data, int(setting.rstrip("f")), flush=setting.endswith("f"))


class BitWriter:
    def __init__(self):
        self.bits, self.n, self.out = 0, 0, bytearray()

    def put(self, value: int, width: int) -> None:
        self.bits |= value << self.n
        self.n += width
        if self.n >= 64:
            whole = self.n // 8
            self.out += (self.bits & ((1 << 8 * whole) - 1)).to_bytes(whole, "little")
            self.bits >>= 8 * whole
            self.n -= 8 * whole

    def done(self) -> bytes:
        whole = -(-self.n // 8)
        return bytes(self.out) + self.bits.to_bytes(whole, "little")


def indexed(data: bytes) -> tuple[array, array, array, array]:
    """The eight bytes from each position on (zeros beyond the end); positions by their first three bytes, then in order;
    where in that order each position is, and where those with its three bytes begin."""
    words = np.ndarray(len(data), "<u8", data + bytes(8), strides=(1,)).astype(np.uint64)
    number = np.arange(max(0, len(data) - 2))
    keys = np.sort((words[: len(number)] & np.uint64(0xFFFFFF)).astype(np.int64) << 36 | number)
    order, threes = keys & (1 << 36) - 1, keys >> 36
    place, first = np.empty_like(order), np.empty_like(order)
    place[order] = number
    first[order] = np.maximum.accumulate(np.where(np.diff(threes, prepend=-1) != 0, number, 0))
    return array("Q", words.tobytes()), *(array("q", x.tobytes()) for x in (order, place, first))


def tokenize(data: bytes, lazy: bool, steer: Callable | None = None) -> Iterator[tuple[int, int]]:
    """LZ77 tokens.  Lazy parsing emits a literal where the next position has a longer match.  `steer(position, length,
    distance)` may return another match to emit, or None for a literal."""
    at, n, grab = 0, len(data), int.from_bytes
    words, order, place, first = indexed(data)

    def common(q, p, limit):
        if differ := words[q] ^ words[p]:
            k = (differ & -differ).bit_length() - 1 >> 3
            return k if k < limit else limit
        for size in (min(limit, 24), limit):
            if differ := grab(data[q : q + size], "little") ^ grab(data[p : p + size], "little"):
                return (differ & -differ).bit_length() - 1 >> 3
        return limit

    def longest(p):
        """The longest match among the nearest `CHAIN` candidates in the window, the nearest of that length."""
        if p > n - 3:
            return 0, 0
        i, begin = place[p], first[p]
        if i == begin or p - (q := order[i - 1]) > inflate.WINDOW:
            return 0, 0
        limit = min(inflate.MAX_MATCH, n - p)
        best, last = common(q, p, limit), max(i - CHAIN, begin)
        where, low = p - q, max(p - inflate.WINDOW, order[last])
        if q - low > 60 * (i - last):  # few candidates far apart: one by one
            for q in reversed(order[last : i - 1]):
                if q < low or best == limit:
                    break
                if data[q + best] == data[p + best] and (k := common(q, p, limit)) > best:
                    best, where = k, p - q
            return best, where
        while best < limit and low < q and (q := data.rfind(data[p : p + best + 1], low, q + best)) >= 0:
            best, where = common(q, p, limit), p - q
        return best, where

    ahead = None  # what is known of the next position
    while at < n:
        (length, distance), ahead = ahead or longest(at), None
        if lazy and 3 <= length < inflate.MAX_MATCH:
            ahead = longest(at + 1)
            if ahead[0] > length:
                length = 0
        if length and steer is not None:
            length, distance = steer(at, length, distance) or (0, 0)
        if length >= 3:
            yield length, distance
            at, ahead = at + length, None
        else:
            yield data[at], -1
            at += 1


def run_lengths(lengths: list[int]) -> list[tuple[int, int, int]]:
    """Code-length symbols (symbol, extra value, extra bits) of a length list."""
    out, i = [], 0
    while i < len(lengths):
        value, j = lengths[i], i
        while j < len(lengths) and lengths[j] == value:
            j += 1
        n = j - i
        i = j
        if value:
            out.append((value, 0, 0))
            n -= 1
        while n:
            if not value and n >= 11:
                step = min(n, 138)
                out.append((18, step - 11, 7))
            elif not value and n >= 3:
                step = n
                out.append((17, step - 3, 3))
            elif value and n >= 3:
                step = min(n, 6)
                out.append((16, step - 3, 2))
            else:
                step = 1
                out.append((value, 0, 0))
            n -= step
    return out


LENGTH_BASE, LENGTH_EXTRA, DIST_BASE, DIST_EXTRA = (np.array(x, np.int64) for x in (inflate.LENGTH_BASE, inflate.LENGTH_EXTRA, inflate.DIST_BASE, inflate.DIST_EXTRA))
LENGTH_CODE = np.searchsorted(LENGTH_BASE, np.arange(inflate.MAX_MATCH + 1), "right") - 1
DIST_CODE = np.searchsorted(DIST_BASE, np.arange(inflate.WINDOW + 1), "right") - 1


def joined(value: np.ndarray, width: np.ndarray) -> tuple[int, int]:
    """Values of at most 48 bits one after another, the first lowest, and how many bits they have."""
    ends = np.cumsum(width)
    at, total = ends - width, int(ends[-1]) if len(ends) else 0
    words, word, shift = np.zeros(total // 64 + 2, np.uint64), (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    np.bitwise_or.at(words, word, value << shift)
    np.bitwise_or.at(words, word + 1, value >> np.uint64(1) >> (np.uint64(63) - shift))
    return int.from_bytes(words.astype("<u8").tobytes(), "little"), total


def write_block(w: BitWriter, tokens: list[tuple[int, int]], final: bool) -> None:
    """A dynamic block."""
    length, distance = np.fromiter(chain.from_iterable(tokens), np.int64, 2 * len(tokens)).reshape(-1, 2).T
    copy = distance > 0
    far = distance[copy]
    k, d = LENGTH_CODE[length[copy]], DIST_CODE[far]
    symbols = length.copy()
    symbols[copy] = 257 + k
    lit, dist = np.bincount(symbols, minlength=286).tolist(), np.bincount(d, minlength=30).tolist()
    lit[256] = 1
    lit_lengths, dist_lengths = limited_lengths(lit, 15), limited_lengths(dist, 15)
    if not any(dist_lengths):
        dist_lengths[0] = 1
    hlit = max(257, max(i for i, n in enumerate(lit_lengths) if n) + 1)
    hdist = max(i for i, n in enumerate(dist_lengths) if n) + 1
    described = run_lengths(lit_lengths[:hlit] + dist_lengths[:hdist])
    freq = [0] * 19
    for s, _, _ in described:
        freq[s] += 1
    cl = limited_lengths(freq, 7)
    if sum(1 for n in cl if n) == 1:  # a complete code needs two
        cl[0 if not cl[0] else 1] = 1
    sent = [cl[s] for s in inflate.CODE_LENGTH_ORDER]
    hclen = max(4, max(i for i, n in enumerate(sent) if n) + 1)
    w.put(final, 1)
    w.put(inflate.DYNAMIC, 2)
    w.put(hlit - 257, 5)
    w.put(hdist - 1, 5)
    w.put(hclen - 4, 4)
    for n in sent[:hclen]:
        w.put(n, 3)
    codes = canonical_codes(cl)
    for s, extra, width in described:
        w.put(codes[s], cl[s])
        w.put(extra, width)
    lit_codes, dist_codes = canonical_codes(lit_lengths), canonical_codes(dist_lengths)
    value, width = np.array(lit_codes, np.uint64)[symbols], np.array(lit_lengths, np.uint64)[symbols]
    at, bits = width[copy], value[copy]  # a match is its length's code and rest, its distance's code and rest
    for part, size in ((length[copy] - LENGTH_BASE[k], LENGTH_EXTRA[k]), (np.array(dist_codes)[d], np.array(dist_lengths)[d]), (far - DIST_BASE[d], DIST_EXTRA[d])):
        bits |= part.astype(np.uint64) << at
        at += size.astype(np.uint64)
    value[copy], width[copy] = bits, at
    w.put(*joined(value, width))
    w.put(lit_codes[256], lit_lengths[256])


def own_stream(tokens: Iterable[tuple[int, int]]) -> bytes:
    """Dynamic blocks of about `BLOCK_SPAN` bytes."""
    w, part, size, blocks = BitWriter(), [], 0, []
    for token in tokens:
        part.append(token)
        size += token[0] if token[1] >= 0 else 1
        if size >= BLOCK_SPAN:
            blocks.append(part)
            part, size = [], 0
    if part or not blocks:
        blocks.append(part)
    for k, block in enumerate(blocks):
        write_block(w, block, k == len(blocks) - 1)
    return w.done()


def own_raw(data: bytes, setting: str = "lazy", steer: Callable | None = None) -> bytes:
    """Raw DEFLATE of our own encoder."""
    return own_stream(tokenize(data, setting == "lazy", steer))


def own_setting(raw: bytes, output: bytes, made: inflate.Stream | None = None) -> str | None:
    """Setting of our own encoder that makes exactly `raw` (`made`: parsed, with tokens): parsing stops at the first token
    that differs."""
    made = made or inflate.parse(raw, keep_tokens=True, keep_output=False, describe=False)
    if made.error or any(b.kind != inflate.DYNAMIC for b in made.blocks):
        return None
    tokens = [t for b in made.blocks for t in b.tokens]
    for setting in REGISTRY["own"].settings:
        if all(a == b for a, b in zip_longest(tokens, tokenize(output, setting == "lazy"))):
            return setting if own_stream(tokens) == raw else None
    return None


@dataclass(frozen=True)
class Encoder:
    name: str
    library: str
    settings: tuple[str, ...]
    compress: Callable[[bytes, str], bytes] | None  # None: not on this platform
    reference: bool = False
    synthetic: bool = False

    @property
    def available(self) -> bool:
        return self.compress is not None


REGISTRY: dict[str, Encoder] = {}


def register(encoder: Encoder) -> Encoder:
    REGISTRY[encoder.name] = encoder
    return encoder


register(Encoder("zlib", "zlib", tuple(ZLIB_SETTINGS), zlib_setting, reference=True))
register(Encoder("zlib-strategies", "zlib-strategies", tuple(STRATEGIES), zlib_setting, reference=True))
register(Encoder("own", "own", ("greedy", "lazy"), own_raw, reference=True, synthetic=True))
for _name, _library, _settings, _reference in [
    ("java", "zlib", "1 2 3 4 5 6 7 8 9", False), ("zlib-ng", "zlib-ng", "1 3 6 9 1f 6f 9f", True), ("libdeflate", "libdeflate", "1 6 9 12", True),
    ("zopfli", "zopfli", "i5 i15", True), ("node", "chromium-zlib", "1 3 6 9", True), ("go-flate", "go-flate", "1 3 6 9", True),
    ("dotnet", "zlib-ng", "fastest optimal smallest", False), ("7zip", "7zip", "mx1 mx5 mx9", True), ("libarchive", "zlib", "1 6 9", False),
]:
    register(Encoder(_name, _library, tuple(_settings.split()), None, _reference))


def list_encoders(only_available: bool = True, synthetic: bool = True) -> list[Encoder]:
    return [e for e in REGISTRY.values() if (e.available or not only_available) and (synthetic or not e.synthetic)]


def reference_for(library: str) -> Encoder | None:
    return next((e for e in REGISTRY.values() if e.reference and e.library == library), None)


def reproduces(raw: bytes, output: bytes, level: int, mem_level: int, flush: bool = False) -> bool:
    """zlib makes exactly `raw` from `output`; compared chunk by chunk, stopping at the first difference."""
    c, at = zlib.compressobj(level, zlib.DEFLATED, -15, mem_level), 0
    for i in range(0, len(output), CHUNK):
        part = c.compress(output[i : i + CHUNK])
        if raw[at : at + len(part)] != part:
            return False
        at += len(part)
    tail = (c.flush(zlib.Z_SYNC_FLUSH) if flush else b"") + c.flush()
    return raw[at:] == tail


def zlib_matches(raw: bytes, output: bytes | None) -> list[tuple[int, int, bool]]:
    """All (level, memLevel, sync flush) settings of zlib that reproduce a stream."""
    if output is None:
        return []
    grid = [(level, mem) for level in range(1, 10) for mem in range(1, 10)]
    found = [(*s, False) for s in grid if reproduces(raw, output, *s)]
    if not found and raw.endswith(FLUSH_TAIL):
        found = [(*s, True) for s in grid if reproduces(raw, output, *s, True)]
    return found


def zlib_buffers(made: inflate.Stream) -> range:
    """The memLevels with which zlib can have made a parsed stream (with tokens).

    zlib's chains end at position 0, so it never copies from there; and a block ends when one token less than
    2 ** (memLevel + 6) is in the buffer.
    """
    if not MADLER:
        return range(1, 10)
    at, most = 0, 0
    for block in made.blocks:
        if block.kind == inflate.STORED:
            at += block.out_size
            continue
        most = max(most, len(block.tokens))
        for length, distance in block.tokens:
            if distance == at and at:
                return range(0)
            at += length if distance > 0 else 1
    return range(next((mem for mem in range(1, 10) if most < 1 << mem + 6), 10), 10)


def zlib_proof(raw: bytes, output: bytes | None, made: inflate.Stream | None = None) -> str | None:
    """`zlib_label` of all matches: settings are tried in its order, so the first match is the one.  Where the usual
    memLevel fails, or the stream is at hand parsed (`made`, with tokens), only memLevels that can have made it are tried."""
    if output is None:
        return None
    grid = sorted(((level, mem) for level in range(1, 10) for mem in range(1, 10)), key=lambda m: (m[1] != 8, *m))
    fits = made and zlib_buffers(made)
    for flush in (False, True)[: 1 + raw.endswith(FLUSH_TAIL)]:
        for level, mem in grid:
            if fits is None and mem != 8:
                fits = zlib_buffers(inflate.parse(raw, keep_tokens=True, keep_output=False, describe=False))
            if (fits is None or mem in fits) and reproduces(raw, output, level, mem, flush):
                return zlib_label([(level, mem, flush)])
    return None


def zlib_label(matches: list[tuple[int, int, bool]]) -> str | None:
    """Setting name of a match list: memLevel 8 first, then the lowest level."""
    if not matches:
        return None
    level, _, flush = min(matches, key=lambda m: (m[1] != 8, m[0], m[1]))
    return f"{level}{'f' * flush}"


def reproducing_setting(profile: str, raw: bytes, output: bytes, made: inflate.Stream | None = None) -> str | None:
    """Setting of a profile's reference encoder that reproduces a stream (`made`: parsed, with tokens)."""
    if profile == "zlib":
        return zlib_proof(raw, output, made)
    if profile == "own":
        return own_setting(raw, output, made)
    encoder = reference_for(profile)
    if encoder is None or not encoder.available:
        return None
    return next((s for s in encoder.settings if encoder.compress(output, s) == raw), None)


def panel(raw: bytes, output: bytes) -> list[tuple[str, str]]:
    """(encoder, setting) of every available encoder that reproduces a stream."""
    return [(e.name, s) for e in list_encoders() for s in e.settings if e.compress(output, s) == raw]
