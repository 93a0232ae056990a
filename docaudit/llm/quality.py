"""Line quality by a linear-chain conditional random field.

Every line is labelled good or bad from its own and its neighbours' features; the forward-backward marginals,
weighted by line length, give the document's quality. Labels are of documents, so a document's label stands for all
its lines in training; a logistic link on the aggregated marginal is fitted on the same rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.llm import batches, words
from docaudit.llm.crf import Chain
from docaudit.llm.language import bucket

#: At most so many labelled rows are learned from, those with the smallest hash of their id.
TRAINING_ROWS = 3000
#: Documents of more bytes are not learned from, so that the sample is bounded whatever the texts.
TRAINING_BYTES = 32_768
#: In training, a longer document is several sequences of so many lines.
TRAINING_LINES = 64

#: Byte classes whose shares are features: lower case and non-ASCII, upper case, digits, spaces, marks, rare marks.
CLASSES = np.zeros((6, 256), bool)
for _b in range(256):
    _c = chr(_b)
    CLASSES[0, _b] = _b >= 0x80 or "a" <= _c <= "z"
    CLASSES[1, _b] = "A" <= _c <= "Z"
    CLASSES[2, _b] = "0" <= _c <= "9"
    CLASSES[3, _b] = words.SPACES[_b]
    CLASSES[4, _b] = _c in ".,;:!?'\"()-"
    CLASSES[5, _b] = 0x21 <= _b < 0x7F and not _c.isalnum() and _c not in ".,;:?'\"()-"
FEATURES = 13


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of every text, the texts' first lines (one more at the end), and lengths in bytes."""
    breaks = np.flatnonzero(data == 0x0A)
    n_texts = len(offsets) - 1
    owner = np.searchsorted(offsets, breaks, "right") - 1
    per = np.bincount(owner, minlength=n_texts) + 1
    first = np.r_[0, np.cumsum(per)]
    starts = np.empty(first[-1], np.int64)
    ends = np.empty(first[-1], np.int64)
    heads = np.zeros(first[-1], bool)
    heads[first[:-1]] = True
    starts[first[:-1]] = offsets[:-1]
    starts[~heads] = breaks + 1
    tails = np.zeros(first[-1], bool)
    tails[first[1:] - 1] = True
    ends[first[1:] - 1] = offsets[1:]
    ends[~tails] = breaks
    size = np.maximum(ends - starts, 1)
    x = np.zeros((len(starts), FEATURES))
    for k in range(6):
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(CLASSES[k][data], out=sums[1:])
        x[:, k] = (sums[ends] - sums[starts]) / size
    low = words.LOWER[data] if len(data) else data
    at, to, _ = words.word_spans(data, offsets, ~words.SPACES)
    line = np.searchsorted(starts, at, "right") - 1
    h = words.hash_spans(words.padded(low), at, to)
    count = np.bincount(line, minlength=len(starts))
    same = np.zeros(len(at), bool)
    same[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
    key = _distinct(line, h)
    some = np.maximum(count, 1)
    x[:, 6] = np.bincount(line, weights=same, minlength=len(starts)) / some
    x[:, 7] = np.where(count > 0, np.bincount(key, minlength=len(starts)) / some, 1)
    x[:, 8] = np.log1p(count) / 4
    x[:, 9] = np.bincount(line, weights=np.minimum(to - at, 40), minlength=len(starts)) / some / 8
    x[:, 10] = np.bincount(line, weights=(to - at) == 1, minlength=len(starts)) / some
    x[:, 11] = count == 0
    x[:, 12] = 1
    return x, first, ends - starts


def _distinct(line: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The lines of the distinct words of each line."""
    order = np.lexsort((h, line))
    line, h = line[order], h[order]
    new = np.ones(len(line), bool)
    new[1:] = (line[1:] != line[:-1]) | (h[1:] != h[:-1])
    return line[new]


def with_neighbours(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Own features, then the line before's and the line after's (zeros at a text's border)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    if len(x):
        before[1:], after[:-1] = x[:-1], x[1:]
        before[first[:-1]] = 0
        after[first[1:] - 1] = 0
    return np.hstack([x, before, after])


def aggregate(good: np.ndarray, length: np.ndarray, first: np.ndarray) -> np.ndarray:
    weight = length + 1.0
    return np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])


class Model:
    def __init__(self, texts: list[str], labels: list[int]):
        raw = [t.encode("utf-8", "replace") for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        offsets = np.r_[0, np.cumsum([len(r) for r in raw])].astype(np.int64)
        x, first, length = line_features(data, offsets)
        x = with_neighbours(x, first)
        y = np.asarray(labels, np.int64)
        lines = np.diff(first)
        cuts = np.unique(np.concatenate([first, *(np.arange(a, b, TRAINING_LINES) for a, b in zip(first[:-1], first[1:]) if b - a > TRAINING_LINES)])) if len(texts) else first
        sequence_doc = np.searchsorted(first, cuts[:-1], "right") - 1
        balance = np.where(y == 1, len(y) / max(1, 2 * (y == 1).sum()), len(y) / max(1, 2 * (y == 0).sum()))
        self.chain = Chain(x.shape[1], 2).fit(x, np.repeat(y, lines), cuts, share=(balance / np.maximum(lines, 1))[sequence_doc])
        self.link = np.array([1.0, 0.0])
        q = self.aggregated(data, offsets)
        for step in range(400):  # logistic link of two numbers, by gradient
            z = (q - 0.5) * 8
            p = 1 / (1 + np.exp(-(self.link[0] * z + self.link[1])))
            self.link += 0.5 * np.array([((y - p) * z).mean(), (y - p).mean()])

    def aggregated(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x, first, length = line_features(data, offsets)
        p, _ = self.chain.marginals(with_neighbours(x, first) @ self.chain.weights, first)
        return aggregate(p[:, 1], length, first)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z = (self.aggregated(data, offsets) - 0.5) * 8
        return 1 / (1 + np.exp(-(self.link[0] * z + self.link[1])))


def train(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = TRAINING_ROWS) -> Model | None:
    """A model of labels.quality from at most `rows` documents for which `learn` holds; None without both classes.

    Null texts count as empty; of rows with one id the least text counts, of repeated labels the lower one.
    """
    marked = labels.where(learn & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = {r.doc_id: r.quality for r in marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).collect()}
    if len(set(chosen.values())) < 2:
        return None
    own = docs.where(F.col("doc_id").isin(list(chosen))).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = own.where(F.octet_length("text") <= TRAINING_BYTES).groupBy("doc_id").agg(F.min("text").alias("text")).toPandas().sort_values("doc_id")
    classes = [chosen[d] for d in found.doc_id]
    return Model(found.text.tolist(), classes) if len(set(classes)) == 2 else None


def score(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """Adds `score` to the kept columns, in place of one of that name: the model's P(good); 0.5 for all without a model. Null text counts as empty."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(part, data, offsets):
        own = shared.value
        got = np.full(len(offsets) - 1, 0.5) if own is None else own.scores(data, offsets)
        return pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), pa.array(got)], names=[*keep, "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return batches.map_slices(docs.select(*dict.fromkeys([*keep, "text"])), run, ", ".join(x for x in (schema, "score double") if x))


def held_out(doc_id: Column) -> Column:
    return bucket(doc_id, 3) == 1
