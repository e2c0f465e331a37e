"""Operator 2: document quality by a linear-chain conditional random field over lines.

Every line gets surface features (shares of character classes, word lengths, repetition of words and of lines) and the
same features of the line before and after it.  A two-state chain labels lines good or bad; it is fitted to lines
that carry their document's label.  A document's score is the length-weighted mean of its lines' marginal
probability of "good" from the forward-backward algorithm, passed through a two-parameter logistic calibration.

The model is fitted on a bounded sample: at most `SAMPLE_DOCS` labelled documents, those with the smallest hash of
doc_id; of a longer one the `SAMPLE_LINES` lines in its middle count.  So the sample is 72 MB at most.  Scoring covers every whole text.  Inputs of a score are the text's
bytes alone.

Defined cases: null and empty texts are one empty line; labels that are null or neither 0 nor 1 are ignored; with
several labels for a document the greatest counts; with no usable label every score is 0.5; repeated rows each give a
row; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flatewise.llm.common import mix64, segments, slices, small_batches, trim

SAMPLE_DOCS = 4000
SAMPLE_LINES = 250
THRESHOLD = 0.7
BATCH_BYTES = 1_500_000
RIDGE = 1e-3
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def class_table() -> np.ndarray:
    """Character class of each byte value."""
    kind = np.full(256, 9, np.uint8)  # other punctuation and control
    kind[[9, 10, 11, 12, 13, 32]] = 0
    kind[65:91] = 1
    kind[97:123] = 2
    kind[48:58] = 3
    kind[ord("!")] = 4
    kind[[ord(c) for c in "#$%&*"]] = 5
    kind[ord("|")] = 6
    kind[[ord("."), ord(",")]] = 7
    kind[128:192] = 8
    kind[192:256] = 10
    return kind


KIND = class_table()
MIXED = mix64(np.arange(1, 257, dtype=np.uint64))
POWERS = np.multiply.accumulate(np.concatenate([[1], np.full(4095, 0x9E3779B97F4A7C15, dtype=np.uint64)]).astype(np.uint64))
BASE = 16


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base features of all lines of some texts, byte length of every line, number of lines of every text."""
    encoded = [t.encode("utf-8", "replace") for t in texts]
    counts = np.array([e.count(b"\n") + 1 for e in encoded], dtype=np.int64)
    data = np.frombuffer(b"\n".join(encoded) + b"\n", dtype=np.uint8)
    end = np.flatnonzero(data == 10)
    start = np.concatenate([[0], end[:-1] + 1])
    length = (end - start).astype(np.float64)
    kind = KIND[data]

    def per_line(values):
        return np.add.reduceat(values, start, dtype=np.float64)

    space = kind == 0
    head = ~space
    head[1:] &= space[:-1]
    words = per_line(head)
    share = {c: per_line(kind == c) for c in (1, 2, 3, 4, 5, 6, 7, 9, 10)}
    letters = share[1] + share[2] + share[10]
    some_words, some_letters, some_bytes = np.maximum(words, 1), np.maximum(letters, 1), np.maximum(length, 1)

    begin = np.flatnonzero(head)
    distinct = np.zeros(len(start))
    short = np.zeros(len(start))
    if len(begin):
        stop = np.flatnonzero(~space[:-1] & space[1:]) + 1
        size = stop - begin
        place = np.arange(len(data)) - np.repeat(np.concatenate([[0], begin]), np.diff(np.concatenate([[0], begin, [len(data)]])))
        weight = MIXED[data] * POWERS[place & 4095]
        weight[space] = 0
        word_hash = np.add.reduceat(weight, begin)
        line_of = np.searchsorted(end, begin)
        # one entry for each distinct word of a line: hash in the low bits, line number above
        keys = np.sort((line_of.astype(np.uint64) << np.uint64(40)) | (mix64(word_hash) >> np.uint64(24)))
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        distinct += np.bincount((keys[fresh] >> np.uint64(40)).astype(np.int64), minlength=len(start))
        short += np.bincount(line_of[size <= 3], minlength=len(start))
        line_hash = np.bincount(line_of, weights=(mix64(word_hash + np.uint64(1)) >> np.uint64(40)).astype(np.float64), minlength=len(start))
    else:
        line_hash = np.zeros(len(start))
    doc_of, _ = segments(counts)
    same = np.lexsort((line_hash, doc_of))
    equal = (line_hash[same][1:] == line_hash[same][:-1]) & (doc_of[same][1:] == doc_of[same][:-1])
    copies = np.zeros(len(start))
    copies[same[1:][equal]] = 1
    copies[same[:-1][equal]] = 1

    columns = [
        np.log1p(length), np.log1p(words), share[1] / some_letters, share[3] / some_bytes, share[4] / some_words,
        share[5] / some_words, share[6] / some_words, share[7] / some_words, share[9] / some_words, share[10] / some_bytes,
        np.minimum(length / some_words, 40) / 10, distinct / some_words, short / some_words, copies, (words == 0) * 1.0,
        ((distinct < 0.7 * words) & (words >= 10)) * 1.0,
    ]
    return np.stack(columns, axis=1).astype(np.float32), length + 1, counts


def with_neighbours(base: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A line's own features, those of its neighbours in the document (zero beyond an edge), and a constant."""
    n = len(base)
    last = np.cumsum(counts) - 1
    first = last - counts + 1
    before, after = np.zeros_like(base), np.zeros_like(base)
    before[1:], after[:-1] = base[:-1], base[1:]
    before[first], after[last] = 0, 0
    return np.concatenate([base, before, after, np.ones((n, 1), base.dtype)], axis=1)


def chain_layout(counts: np.ndarray):
    """Order of chains by falling length, and for step t the number of chains that have a line t."""
    order = np.argsort(-counts, kind="stable")
    sizes = counts[order]
    first = (np.cumsum(counts) - counts)[order]
    active = np.searchsorted(-sizes, -np.arange(sizes[0] if len(sizes) else 0), side="left")
    return first, active


def forward_backward(unary: np.ndarray, stay: np.ndarray, counts: np.ndarray):
    """Marginals of "good", summed pair marginals (2 x 2) and the log-partition of two-state chains.

    unary: score of good minus bad by line.  stay: 2 x 2 transition scores.
    """
    n = len(unary)
    emit = np.empty((n, 2))
    shift = np.maximum(unary, 0)
    emit[:, 1], emit[:, 0] = np.exp(unary - shift), np.exp(-shift)
    move = np.exp(stay)
    first, active = chain_layout(counts)
    alpha, beta, scale = np.empty((n, 2)), np.ones((n, 2)), np.ones(n)
    for t, a in enumerate(active):
        at = first[:a] + t
        p = emit[at] if t == 0 else emit[at] * (alpha[at - 1] @ move)
        s = p.sum(axis=1)
        alpha[at], scale[at] = p / s[:, None], s
    pairs = np.zeros((2, 2))
    for t in range(len(active) - 1, 0, -1):
        at = first[: active[t]] + t
        message = emit[at] * beta[at] / scale[at][:, None]
        beta[at - 1] = message @ move.T
        pairs += (alpha[at - 1].T @ message) * move
    marginal = alpha * beta
    marginal /= marginal.sum(axis=1, keepdims=True)
    return marginal[:, 1], pairs, float(np.log(scale).sum() + shift.sum())


def fit(documents: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], rounds: int = 120) -> dict | None:
    """Model from (label, base features, line lengths, line count) of each sample document."""
    if not documents:
        return None
    labels = np.array([d[0] for d in documents])
    counts = np.array([len(d[1]) for d in documents])
    base = np.concatenate([d[1] for d in documents]).astype(np.float64)
    lengths = np.concatenate([d[2] for d in documents])
    mean, scale = base.mean(axis=0), np.maximum(base.std(axis=0), 1e-6)
    x = with_neighbours(np.clip((base - mean) / scale, -8, 8), counts)
    line_label = np.repeat(labels, counts)
    same = float((counts - 1).sum())
    seen = np.array([[float((counts - 1)[labels == 0].sum()), 0.0], [0.0, float((counts - 1)[labels == 1].sum())]])
    theta = np.zeros(x.shape[1] + 4)
    first_moment, second_moment = np.zeros_like(theta), np.zeros_like(theta)
    total = max(1.0, len(x))
    for r in range(1, rounds + 1):
        weight, stay = theta[:-4], theta[-4:].reshape(2, 2)
        marginal, pairs, _ = forward_backward(x @ weight, stay, counts)
        gradient = np.concatenate([x.T @ (line_label - marginal), ((seen - pairs) if same else np.zeros((2, 2))).ravel()]) / total
        gradient -= RIDGE * theta
        first_moment = 0.9 * first_moment + 0.1 * gradient
        second_moment = 0.99 * second_moment + 0.01 * gradient**2
        theta = theta + 0.1 * (first_moment / (1 - 0.9**r)) / (np.sqrt(second_moment / (1 - 0.99**r)) + 1e-9)
    model = {"mean": mean, "scale": scale, "theta": theta, "a": 1.0, "b": 0.0}
    raw = log_odds(model, base, lengths, counts)
    a, b = 1.0, 0.0
    for _ in range(400):  # logistic calibration of the document's log-odds
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        a += 0.02 * float(((labels - p) * raw).mean()) - 1e-4 * a
        b += 0.2 * float((labels - p).mean())
    return model | {"a": max(a, 1e-3), "b": b}


def log_odds(model: dict, base: np.ndarray, lengths: np.ndarray, counts: np.ndarray) -> np.ndarray:
    x = with_neighbours(np.clip((base - model["mean"]) / model["scale"], -8, 8), counts)
    marginal, _, _ = forward_backward(x @ model["theta"][:-4], model["theta"][-4:].reshape(2, 2), counts)
    first = np.cumsum(counts) - counts
    mean = np.add.reduceat(marginal * lengths, first) / np.add.reduceat(lengths, first)
    mean = np.clip(mean, 1e-7, 1 - 1e-7)
    return np.log(mean / (1 - mean))


def score_texts(model: dict | None, texts: list[str]) -> np.ndarray:
    if model is None or not texts:
        return np.full(len(texts), 0.5)
    out = []
    for a, b in slices([len(t) for t in texts], BATCH_BYTES):
        base, lengths, counts = line_features(texts[a:b])
        z = model["a"] * log_odds(model, base.astype(np.float64), lengths, counts) + model["b"]
        out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
    return np.concatenate(out)


def sample_batches(batches):
    """(label, features, line lengths) of sample documents as packed arrays."""
    for batch in batches:
        rows = [(q, line_features([t or ""])) for q, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        rows = [(q, [part[max(0, len(part) - SAMPLE_LINES) // 2 :][:SAMPLE_LINES] for part in f[:2]]) for q, f in rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array([q for q, _ in rows], pa.int32()), pa.array([f[0].tobytes() for _, f in rows], pa.binary()), pa.array([f[1].astype("<f8").tobytes() for _, f in rows], pa.binary())],
            names=["quality", "features", "lengths"],
        )


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> dict | None:
    """Fit on the bounded sample of labelled documents that are not held out."""
    small_batches(docs.sparkSession)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text").join(F.broadcast(sample), "doc_id").select("quality", "text", "doc_id")
    packed = rows.select("quality", "text").mapInArrow(sample_batches, "quality int, features binary, lengths binary").collect()
    documents = [(r[0], np.frombuffer(r[1], np.float32).reshape(-1, BASE), np.frombuffer(r[2], "<f8")) for r in packed]
    documents.sort(key=lambda d: (d[0], len(d[1]), d[1].tobytes()))
    return fit(documents)


def score_batches(model: dict | None):
    def run(batches):
        for batch in batches:
            scores = score_texts(model, [t or "" for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array((scores >= THRESHOLD).astype(np.int32), pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return run


def score_documents(docs: DataFrame, model: dict | None) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), "text")
    return rows.mapInArrow(score_batches(model), SCHEMA)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the labels and score every document."""
    return score_documents(docs, train(docs, labels))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier accepts, with their own columns."""
    model = train(docs, labels)
    names, schema = docs.columns, docs.schema
    at = names.index("text")

    def run(batches):
        for batch in batches:
            scores = score_texts(model, [t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(scores >= THRESHOLD))
        trim()

    return docs.mapInArrow(run, schema)
