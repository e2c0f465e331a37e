"""Operator 3: BPE encoding and decoding by tree concatenation.

A text is normalised and pre-tokenised as the vocabulary file says (composed form, one space for white space, lower
case; then words, single digits, punctuation runs).  Short pieces are merged directly.  A long unsplit piece is cut
into leaves; the leaves are encoded independently, and neighbours are joined level by level up a binary tree.  A
join re-encodes a window of tokens around the seam and doubles it until the window's first token is the left side's
token there and its last token the right side's: a token sequence is the encoding of its text exactly when every
adjacent pair is, so both agreements make the joined sequence exact.  Nothing is ever cut to a prefix.

Texts of up to `LONG_TEXT` characters are encoded in one go, documents side by side.  A longer one becomes rows: bundles
of whole pieces, and the leaves of pieces of over `PART` symbols.  All rows are encoded in parallel, and the leaves of a
piece are joined level by level, every join of a level in parallel, until each piece is one row.

Defined cases: null text is the empty text; empty text has 0 tokens and the digests of the empty string; repeated
rows each give a row; null doc_id is kept; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flatewise.llm.common import checkpoint, shuffle_width

LEAF = 48
CACHE_ENTRIES = 400_000
LONG_TEXT = 1 << 18
PART = 1 << 15
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte value in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, spare = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in names:
            names[b] = chr(spare)
            spare += 1
    return [names[b] for b in range(256)]


class WordBpe:
    """Encoder of one vocabulary file with word-end symbols."""

    def __init__(self, path: str, unlike: str | None = None):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.vocab = model["vocab"]
        self.rank = {tuple(m) if isinstance(m, list) else tuple(m.split(" ")): i for i, m in enumerate(model["merges"])}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        splits = [p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self.pieces = regex.compile(splits[0]["pattern"]["Regex"]).findall
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.symbols = byte_symbols()
        self.cache: dict[str, tuple[str, str]] = {}
        self.unlike_class = unlike or self.unlike_characters()
        self.unlike_at = re.compile(self.unlike_class).search
        near = "".join(r for r in re.findall(r"\\U0000....-\\U........", self.unlike_class))
        self.suspect_at = re.compile(f"[{near}\\U00010000-\\U0010ffff]").search  # one range beyond the first plane: many make a class slow

    def merge(self, parts: list[str]) -> list[str]:
        """Apply the merges to a symbol list: always the lowest rank, the leftmost pair among equals."""
        get, none = self.rank.get, len(self.rank)
        parts = list(parts)
        ranks = [get(pair, none) for pair in zip(parts, parts[1:])]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)
        return parts

    def spell(self, tokens: list[str]) -> list[str]:
        """The symbols a token list was merged from; the word end stays on the last."""
        text = "".join(tokens)
        if self.suffix and text.endswith(self.suffix):
            body = text[: -len(self.suffix)]
            return [*body[:-1], body[-1:] + self.suffix]
        return list(text)

    def join(self, left: list[str], right: list[str]) -> list[str]:
        """Encoding of the concatenation of two encoded halves."""
        width = 2
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            window = self.merge(self.spell(left[i:] + right[:j]))
            left_agrees = i == 0 or window[0] == left[i]
            right_agrees = j == len(right) or window[-1] == right[j - 1]
            if left_agrees and right_agrees:
                return left[:i] + window + right[j:]
            width *= 2

    def encode_symbols(self, symbols: list[str], leaf: int = LEAF) -> list[str]:
        """Tree concatenation: encode leaves, then join neighbours level by level."""
        if len(symbols) <= 2 * leaf:
            return self.merge(symbols)
        level = [self.merge(symbols[i : i + leaf]) for i in range(0, len(symbols), leaf)]
        while len(level) > 1:
            joined = [self.join(level[i], level[i + 1]) for i in range(0, len(level) - 1, 2)]
            level = joined + level[len(joined) * 2 :]
        return level[0]

    def encode_word(self, word: str) -> list[str]:
        """Tokens of a string without white space."""
        out: list[str] = []
        for piece in self.pieces(word):
            out += self.encode_piece([self.symbols[b] for b in piece.encode("utf-8", "replace")])
        return out

    def encode_piece(self, symbols: list[str]) -> list[str]:
        return self.encode_symbols([*symbols[:-1], symbols[-1] + self.suffix])

    def lookup(self, word: str, spelled: bool = False) -> tuple[str, str]:
        """(decimal ids, tokens) of a word, or of a piece spelled in byte symbols, each joined by spaces."""
        found = None if spelled else self.cache.get(word)
        if found is None:
            tokens = self.encode_piece(list(word)) if spelled else self.encode_word(word)
            found = " ".join(str(self.vocab[t]) for t in tokens), " ".join(tokens)
            if len(word) <= 64 and not spelled:
                if len(self.cache) >= CACHE_ENTRIES:
                    self.cache.clear()
                self.cache[word] = found
        return found

    def words(self, text: str) -> list[str]:
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()  # character by character, no final sigma
        if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:  # white space to str.split only
            return [w for w in regex.split(r"[\t-\r \x85\xa0  -     　]+", text) if w]
        return text.split()

    @functools.cached_property
    def library(self):
        """The tokenizers library on the same file, for its character tables only."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def library_pieces(self, text: str) -> list[str]:
        """Pieces in byte symbols as the library's normaliser and pre-tokeniser cut them."""
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def own_pieces(self, text: str) -> list[str]:
        return ["".join(self.symbols[b] for b in piece.encode("utf-8", "replace")) for word in self.words(text) for piece in self.pieces(word)]

    def unlike_characters(self) -> str:
        """A character class of all code points that the library's tables and Python's treat differently, or that Python's
        do not know: texts that hold one take `library_pieces`."""

        def alike(points):
            text = "\n".join(f"a{c}1{c}{c} {c}a{c}\u0323 a\u0301{c}" if unicodedata.category(c)[0] == "M" else f"a{c}1{c}{c}" for c in points)
            return self.own_pieces(text) == self.library_pieces(text)

        known = [c for c in map(chr, range(0x80, 0x110000)) if unicodedata.category(c) not in ("Cn", "Cs", "Co")]

        def unlike(points):
            if not points or alike(points):
                return []
            half = len(points) // 2
            return unlike(points[:half]) + unlike(points[half:]) if half else points

        bad = {c for at in range(0, len(known), 500) for c in unlike(known[at : at + 500])}
        odd = [n for n in range(0x80, 0x110000) if unicodedata.category(chr(n)) == "Cn" or chr(n) in bad]
        edges = [0, *(i for i in range(1, len(odd)) if odd[i] != odd[i - 1] + 1), len(odd)]
        return "[" + "".join(f"\\U{odd[a]:08x}-\\U{odd[b - 1]:08x}" for a, b in zip(edges, edges[1:])) + "]" if odd else "(?!)"

    def encode_text(self, text: str) -> tuple[str, str]:
        """(decimal ids, decoded text) of a whole text."""
        if "<|" in text and self.specials.search(text):
            ids, decoded = [], []
            for part in self.specials.split(text):
                if part in self.special:
                    ids.append(str(self.special[part]))
                    decoded.append(part)
                elif part:
                    a, b = self.encode_text(part)
                    if a:
                        ids.append(a)
                        decoded.append(b)
            return " ".join(ids), " ".join(decoded)
        if self.unlike(text):
            words = self.library_pieces(text)
            found = [self.lookup(w, True) for w in words]
            return " ".join([a for a, _ in found]), " ".join([b for _, b in found])
        words = self.words(text)
        try:
            found = [self.cache[w] for w in words]
        except KeyError:
            found = [self.lookup(w) for w in words]
        return " ".join([a for a, _ in found if a]), " ".join([b for _, b in found if b])

    def unlike(self, text: str) -> bool:
        """Does a text hold a character of the class?  The first tests are fast and settle nearly all texts."""
        if text.isascii():
            return False
        try:
            text.encode("latin-1")
            return self.western
        except UnicodeEncodeError:
            found = self.suspect_at(text)
            return found is not None and (found[0] < "\U00010000" or self.unlike_at(text) is not None)

    @functools.cached_property
    def western(self) -> bool:
        """Is any Latin-1 character in the class (none is, in the tables at hand)?  Then every text takes the slow way."""
        return self.unlike_at("".join(map(chr, range(128, 256)))) is not None

    def items(self, text: str):
        """(piece in byte symbols or special token, is it special) of a text, in order."""
        for part in self.specials.split(text) if "<|" in text else [text]:
            if part in self.special:
                yield part, True
            elif part:
                pieces = self.library_pieces(part) if self.unlike(part) else self.own_pieces(part)
                yield from ((p, False) for p in pieces)

    def ids(self, tokens: list[str]) -> str:
        return " ".join(str(self.special.get(t, self.vocab.get(t))) for t in tokens)

    def encode(self, text: str) -> list[int]:
        ids, _ = self.encode_text(text)
        return [int(i) for i in ids.split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.token[i] for i in ids)


@functools.lru_cache(maxsize=2)
def load(path: str, unlike: str | None = None) -> WordBpe:
    return WordBpe(path, unlike)


def encode_batches(path: str, unlike: str):
    def run(batches):
        bpe = load(path, unlike)
        for batch in batches:
            counts, ids_digests, text_digests = [], [], []
            for text in batch.column(1).to_pylist():
                ids, decoded = bpe.encode_text(text or "")
                counts.append(ids.count(" ") + 1 if ids else 0)
                ids_digests.append(hashlib.sha256(ids.encode()).hexdigest())
                text_digests.append(hashlib.sha256(decoded.encode("utf-8", "replace")).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(text_digests, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


ROWS = "digest string, item long, place long, ends boolean, leaf boolean, pieces array<string>, special array<boolean>"
TOKENS = "digest string, item long, place long, leaf boolean, tokens array<string>"


def cut_batches(path: str, unlike: str):
    """Long texts (digest, text) as rows: bundles of pieces, and leaves of long pieces (the last one `ends`)."""

    def run(batches):
        bpe = load(path, unlike)
        for batch in batches:
            for digest, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, bundle, size = [], [], 0

                def flush():
                    if bundle:
                        rows.append((digest, rows[-1][1] + 1 if rows else 0, 0, True, False, [p for p, _ in bundle], [s for _, s in bundle]))
                        bundle.clear()

                for piece, special in bpe.items(text):
                    if len(piece) <= PART or special:
                        bundle.append((piece, special))
                        size += len(piece)
                        if size >= PART:
                            flush()
                            size = 0
                        continue
                    flush()
                    size, item = 0, rows[-1][1] + 1 if rows else 0
                    rows += [(digest, item, k // PART, k + PART >= len(piece), True, [piece[k : k + PART]], [False]) for k in range(0, len(piece), PART)]
                flush()
                if rows:
                    types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.bool_()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[f.split()[0] for f in ROWS.split(", ")])

    return run


def row_batches(path: str, unlike: str):
    """Tokens of every row, each by itself."""

    def run(batches):
        bpe = load(path, unlike)
        for batch in batches:
            out = []
            for ends, leaf, pieces, special in zip(*(batch.column(n).to_pylist() for n in ("ends", "leaf", "pieces", "special"))):
                if leaf:
                    symbols = list(pieces[0])
                    out.append(bpe.encode_symbols([*symbols[:-1], symbols[-1] + bpe.suffix] if ends else symbols))
                else:
                    out.append([t for p, s in zip(pieces, special) for t in ([p] if s else bpe.encode_piece(list(p)))])
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("digest", "item", "place", "leaf")), pa.array(out, pa.list_(pa.string()))], names=[f.split()[0] for f in TOKENS.split(", ")])

    return run


def join_batches(path: str, unlike: str):
    """Neighbouring halves (one or two rows of tokens) as one row."""

    def run(batches):
        bpe = load(path, unlike)
        for batch in batches:
            halves = [[h["tokens"] for h in pair] for pair in batch.column(3).to_pylist()]
            joined = [bpe.join(*h) if len(h) == 2 else h[0] for h in halves]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([True] * len(joined)), pa.array(joined, pa.list_(pa.string()))], names=[f.split()[0] for f in TOKENS.split(", ")])

    return run


def digest_batches(path: str, unlike: str):
    def run(batches):
        bpe = load(path, unlike)
        for batch in batches:
            tokens = [[t for item in items for t in item["tokens"]] for items in batch.column(1).to_pylist()]
            sha = lambda x: hashlib.sha256(x.encode("utf-8", "replace")).hexdigest()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in tokens], pa.int64()), pa.array([sha(bpe.ids(t)) for t in tokens]), pa.array([sha(" ".join(t)) for t in tokens])],
                names=["digest", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return run


def encode_long(docs: DataFrame, vocabulary: str, unlike: str) -> DataFrame:
    """The same for long texts, whose pieces and leaves are rows; equal texts are encoded once."""
    keyed = docs.withColumn("digest", F.sha2("text", 256))
    rows = keyed.groupBy("digest").agg(F.first("text").alias("text")).mapInArrow(cut_batches(vocabulary, unlike), ROWS)
    spread = rows.repartition(shuffle_width(docs.sparkSession), "digest", "item", "place")
    tokens = checkpoint(spread.mapInArrow(row_batches(vocabulary, unlike), TOKENS))
    whole, leaves = tokens.where("not leaf"), tokens.where("leaf")
    while (leaves.agg(F.max("place")).first()[0] or 0) > 0:
        pairs = leaves.groupBy("digest", "item", F.floor(F.col("place") / 2).alias("place")).agg(F.sort_array(F.collect_list(F.struct("place", "tokens"))).alias("halves"))
        leaves = checkpoint(pairs.mapInArrow(join_batches(vocabulary, unlike), TOKENS))
    items = whole.union(leaves).groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("item", "tokens"))).alias("items"))
    found = items.mapInArrow(digest_batches(vocabulary, unlike), "digest string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    empty = F.lit(hashlib.sha256(b"").hexdigest())  # a long text of white space has no items
    joined = keyed.select("doc_id", "digest").join(found, "digest", "left")
    return joined.select("doc_id", F.coalesce("n_tokens", F.lit(0).cast("long")).alias("n_tokens"), F.coalesce("ids_sha256", empty).alias("ids_sha256"), F.coalesce("decoded_sha256", empty).alias("decoded_sha256"))


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Token count and digests of ids and decoded text for every row; whole texts.  Only long texts are shuffled."""
    unlike = load(vocabulary).unlike_class
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    long = F.coalesce(F.length("text") > LONG_TEXT, F.lit(False))
    short = docs.where(~long).mapInArrow(encode_batches(vocabulary, unlike), SCHEMA)
    if not docs.where(long).limit(1).take(1):
        return short
    return short.union(encode_long(docs.where(long), vocabulary, unlike))
