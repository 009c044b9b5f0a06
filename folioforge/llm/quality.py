"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is encoded: counts of word shapes and
of hashed words, and a few ratios, go through one tanh layer. Gated attention weighs the passages
(learned from labels of whole documents only), and the score is a logistic function of the
weighted passage representation.

The model is fitted on the driver with numpy on a bounded sample of labelled rows:
``SAMPLE_PER_LABEL`` documents for each label, of at most about ``SAMPLE_WORDS`` words, chosen by
a hash of their ids. Scoring covers every passage of every text, in tasks, in blocks of bounded
size: of a text of more than a block, attention is pooled as a running sum.

Defined results: a null or empty text is a bag with one passage without words, and gets the score
the model gives that. Rows that repeat get equal scores. Labels that are neither 0 nor 1 are not
learned from. Without labels of both kinds every score is 0.5, and :func:`keep_good` keeps every
row, as there is nothing to reject by. An empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.util import Memo, bound_batches, in_hash_sample, map_batches, release_memory, strings

PASSAGE_WORDS = 64
SAMPLE_PER_LABEL, SAMPLE_WORDS = 1500, 4096
SHAPES, LEXICON, RATIOS = 256, 256, 6
WIDTH = SHAPES + LEXICON + RATIOS
HIDDEN, GATE = 24, 12
EPOCHS, RATE, DECAY = 20, 0.01, 1e-4
CUT = 0.7
#: Passages that are encoded at once.
BLOCK_PASSAGES = 2048
#: Texts of the sample that are encoded at once.
FIT_TEXTS = 64

_SPACE = re.compile(r"\s")
_RUNS = ((re.compile(r"[^\W\d_]+"), lambda m: "A" if m[0].isupper() else "Aa" if m[0][0].isupper() else "a"), (re.compile(r"\d+"), lambda m: "9"))


def _code(word: str) -> int:
    """Shape bucket, word bucket, counts of letters in upper case, of marks and of characters, and a hash, in one integer."""
    shape = word
    for pattern, name in _RUNS:
        shape = pattern.sub(name, shape)
    shape = re.sub(r"(.)\1{3,}", r"\1\1\1", shape)[:24]
    stem = "".join(c for c in word.lower() if c.isalpha())
    upper = min(sum(c.isupper() for c in word), 63)
    marks = min(sum(not c.isalnum() for c in word), 63)
    own = xxhash.xxh3_64_intdigest(word) & 0xFFFF
    return xxhash.xxh3_64_intdigest(shape) % SHAPES | xxhash.xxh3_64_intdigest(stem) % LEXICON << 8 | upper << 16 | marks << 22 | min(len(word), 63) << 28 | own << 34


_codes = Memo(_code, 100_000)


def pieces(text: str, chars: int) -> Iterator[list[str]]:
    """The words of a text, a part of about ``chars`` characters at a time; no word is cut."""
    at = 0
    while at < len(text):
        gap = _SPACE.search(text, min(len(text), at + chars))
        end = gap.start() if gap else len(text)
        yield text[at:end].split()
        at = end


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features, first): one row for each passage; first[i] is where document i starts."""
    words = [t.split() for t in texts]
    return _passages(words, np.array([len(w) for w in words]))


def _passages(texts: list[list[str]], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The passages of lists of words; ``whole`` says how many words the document of each has."""
    codes = [np.fromiter(map(_codes.__getitem__, words), np.int64, len(words)) for words in texts]
    n = np.array([len(words) for words in texts])
    bags = np.maximum(1, -(-n // PASSAGE_WORDS))
    first = np.concatenate([[0], np.cumsum(bags)])
    code = np.concatenate(codes) if codes else np.empty(0, np.int64)
    inside = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
    row = np.repeat(first[:-1], n) + inside // PASSAGE_WORDS
    rows = int(first[-1])
    x = np.zeros((rows, WIDTH), np.float32)
    size = np.maximum(1, np.bincount(row, minlength=rows))
    add = lambda at, wide: np.bincount(row * wide + at, minlength=rows * wide).reshape(rows, wide) / size[:, None]
    x[:, :SHAPES] = add(code & 255, SHAPES)
    x[:, SHAPES : SHAPES + LEXICON] = add(code >> 8 & 255, LEXICON)
    total = lambda v: np.bincount(row, weights=v, minlength=rows)
    chars = np.maximum(1, total(code >> 28 & 63))
    distinct = np.unique(row << 16 | code >> 34)
    x[:, -6] = total(code >> 16 & 63) / chars
    x[:, -5] = total(code >> 22 & 63) / chars
    x[:, -4] = chars / size / 10
    x[:, -3] = np.bincount(distinct >> 16, minlength=rows) / size
    x[:, -2] = np.log1p(np.repeat(whole, bags)) / 10
    x[:, -1] = np.bincount(row, minlength=rows) == 0
    return x, first


def _sample_passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """:func:`passages` of many texts, FIT_TEXTS at a time: besides the features only one part's words and counts are held."""
    bags = [max(1, -(-len(t.split()) // PASSAGE_WORDS)) for t in texts]
    first = np.concatenate([[0], np.cumsum(bags, dtype=np.int64)])
    x = np.empty((int(first[-1]), WIDTH), np.float32)
    for i in range(0, len(texts), FIT_TEXTS):
        part = texts[i : i + FIT_TEXTS]
        x[first[i] : first[i + len(part)]] = passages(part)[0]
    return x, first


@dataclass
class Model:
    """Weights of the encoder (w, b), of the gated attention (v, u, a) and of the classifier (c, d)."""

    p: dict[str, np.ndarray]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(representation, attention logit) of each passage."""
        p = self.p
        h = np.tanh(x @ p["w"] + p["b"])
        gate = np.tanh(h @ p["v"]) / (1 + np.exp(-(h @ p["u"])))
        return h, gate @ p["a"]

    def scores(self, texts: list[str]) -> np.ndarray:
        """A score between 0 and 1 for each text."""
        out = np.empty(len(texts))
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size < BLOCK_PASSAGES):
                size += len(texts[end]) // (5 * PASSAGE_WORDS) + 1
                end += 1
            if size > BLOCK_PASSAGES and end == at + 1:
                out[at] = self._long(texts[at])
                at = end
                continue
            x, first = passages(texts[at:end])
            parts = [self.encode(x[i : i + BLOCK_PASSAGES]) for i in range(0, len(x), BLOCK_PASSAGES)]
            h, e = (np.concatenate(z) for z in zip(*parts, strict=True))
            out[at:end] = self._pool(h, e, first)[1]
            at = end
        return out

    def _long(self, text: str) -> float:
        """The score of one text, a block of passages at a time."""
        chars = 5 * PASSAGE_WORDS * BLOCK_PASSAGES
        whole = np.array([sum(len(words) for words in pieces(text, chars))])
        most, weight, z = -np.inf, 0.0, np.zeros(HIDDEN)
        left: list[str] = []

        def add(words: list[str]) -> None:
            nonlocal most, weight, z
            h, e = self.encode(_passages([words], whole)[0])
            top = max(most, float(e.max()))
            w = np.exp(e - top)
            old = np.exp(most - top)
            most, weight, z = top, weight * old + float(w.sum()), z * old + w @ h

        for words in pieces(text, chars):
            left += words
            full = len(left) // PASSAGE_WORDS * PASSAGE_WORDS
            for i in range(0, full, PASSAGE_WORDS * BLOCK_PASSAGES):
                add(left[i : min(full, i + PASSAGE_WORDS * BLOCK_PASSAGES)])
            left = left[full:]
        if left or weight == 0.0:
            add(left)
        return float(1 / (1 + np.exp(-(z / weight @ self.p["c"] + self.p["d"]))))

    def _pool(self, h: np.ndarray, e: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, bags = first[:-1], np.diff(first)
        weight = np.exp(e - np.repeat(np.maximum.reduceat(e, start), bags))
        weight /= np.repeat(np.add.reduceat(weight, start), bags)
        z = np.add.reduceat(weight[:, None] * h, start)
        return weight, 1 / (1 + np.exp(-(z @ self.p["c"] + self.p["d"])))


def fit(texts: list[str], labels: np.ndarray, prior: float, seed: int = 0) -> Model:
    """Fit by Adam on the cross entropy of whole documents, both labels weighing the same; then
    move the threshold to ``prior``, the share of label 1 among all labels."""
    rng = np.random.default_rng(seed)
    shape = {"w": (WIDTH, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "d": ()}
    p = {k: rng.normal(0, 0.3, s).astype(np.float32) if k not in "bd" else np.zeros(s, np.float32) for k, s in shape.items()}
    model, m1, m2, step = Model(p), {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
    x, first = _sample_passages(texts)
    y = labels.astype(np.float32)
    share = y.mean()
    cost = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for i in range(0, len(y), 128):
            docs = np.sort(order[i : i + 128])
            rows = np.concatenate([np.arange(first[j], first[j + 1]) for j in docs])
            bags = np.diff(first)[docs]
            local = np.concatenate([[0], np.cumsum(bags)])
            xs = x[rows]
            h = np.tanh(xs @ p["w"] + p["b"])
            t, s = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
            weight, score = model._pool(h, (t * s) @ p["a"], local)
            z = np.add.reduceat(weight[:, None] * h, local[:-1])
            delta = cost[docs] * (score - y[docs]) / len(docs)
            g = {"c": z.T @ delta, "d": delta.sum()}
            dz = np.repeat(delta[:, None] * p["c"], bags, axis=0)
            dw = (dz * h).sum(1)
            de = weight * (dw - np.repeat(np.add.reduceat(weight * dw, local[:-1]), bags))
            dt, ds = de[:, None] * p["a"] * s * (1 - t * t), de[:, None] * p["a"] * t * s * (1 - s)
            g["a"], g["v"], g["u"] = (t * s).T @ de, h.T @ dt, h.T @ ds
            dh = (weight[:, None] * dz + dt @ p["v"].T + ds @ p["u"].T) * (1 - h * h)
            g["w"], g["b"] = xs.T @ dh, dh.sum(0)
            step += 1
            for k in p:
                grad = g[k] + DECAY * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * grad
                m2[k] = 0.999 * m2[k] + 0.001 * grad * grad
                p[k] = p[k] - RATE * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    p["d"] = p["d"] + np.log(prior / (1 - prior))
    model.p = {k: v.astype(np.float32) for k, v in p.items()}
    return model


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", per_label: int = SAMPLE_PER_LABEL) -> Model | None:
    """Fit a model on a sample of the labelled rows that may be learned from; None without both labels."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)").filter(~held_out(F.col("doc_id")))
    share = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if len(share) < 2:
        return None
    # about 2 * per_label rows of each label; never more than twice that, should many rows share an id
    picked = [known.filter((F.col("label") == v) & in_hash_sample(F.col("doc_id"), per_label, share[v])).limit(4 * per_label).coalesce(1).collect() for v in (0, 1)]
    ids = docs.sparkSession.createDataFrame([tuple(r) for part in picked for r in part], known.schema)
    short = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.length("text") <= 8 * SAMPLE_WORDS)
    rows = short.join(F.broadcast(ids), "doc_id").limit(16 * per_label).coalesce(1).collect()  # about 4 * per_label rows of bounded length
    rows.sort(key=lambda r: (xxhash.xxh3_64_intdigest(str(r["doc_id"])), r["text"]))
    sample = [r for v in (0, 1) for r in [r for r in rows if r["label"] == v][:per_label]]
    if len({r["label"] for r in sample}) < 2:
        return None
    texts, wanted = [r["text"] for r in sample], np.array([r["label"] for r in sample])
    del rows, sample
    try:
        return fit(texts, wanted, share[1] / (share[0] + share[1]))
    finally:  # the driver has other work to do
        del texts
        Memo.keep_only()
        release_memory()


def score_documents(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        Memo.keep_only(_codes)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = strings(batch.column(1))
            scores = m.scores(texts) if m else np.full(len(texts), 0.5)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

        return run

    kind = dict(docs.dtypes)[id_col]
    out = map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col)), make, f"doc_id {kind}, score double")
    return out.withColumnRenamed("doc_id", id_col)


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    out = score_documents(docs, train(docs, labels, id_col, text_col), id_col, text_col)
    return out.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; columns stay as they are.

    Scores are made where the rows are: nothing is shuffled.
    """
    model = train(docs, labels, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)
    bound_batches(docs.sparkSession)

    def run(batches):
        m = shared.value
        Memo.keep_only(_codes)
        for batch in batches:
            texts = strings(batch.column(place))
            scores = m.scores(texts) if m else np.full(len(texts), 1.0)
            yield batch.filter(pa.array(scores >= cut))

    return docs.mapInArrow(run, docs.schema)
