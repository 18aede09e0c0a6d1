"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage of the whole text is described by counts of its words and characters, encoded by one
hidden layer, and weighted by a gated attention, softmax(w . (tanh(V h) * sigmoid(U h))); the weighted mean of the encodings is scored.
All weights are learned together from document labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwise.llm.common import bounded_sample
from pickwise.llm.words import per_text

PASSAGE_WORDS = 64
HASHED = 32  # buckets of the hashed short words of a passage
# classes of bytes: upper case, lower case, digit, sentence end, comma-like, bracket-like, other ASCII sign, beyond ASCII
_CLASS = np.full(256, 6, dtype=np.int64)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 7
for _c, _set in ((3, b".!?"), (4, b",;:"), (5, b"()[]{}<>|\"'")):
    _CLASS[list(_set)] = _c
_CLASSES = 8
WIDTH = 16 + HASHED


@dataclass(frozen=True)
class Fit:
    """Bounds and effort of the fit: at most ``rows`` labelled texts with about ``chars`` characters."""

    rows: int = 6000
    chars: int = 24_000_000
    hidden: int = 24
    gate: int = 12
    epochs: int = 30
    batch: int = 128
    rate: float = 0.01
    ridge: float = 1e-4
    seed: int = 3


@dataclass
class Model:
    center: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]


def describe(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(one row per passage, passages of each text). A passage has up to PASSAGE_WORDS words; a text without words is one passage."""
    rows, sizes = [], []
    for i, h, start, end in per_text(texts):
        n = len(h)
        if not n:
            blank = np.zeros((1, WIDTH))
            blank[0, 15] = 1.0
            rows.append(blank)
            sizes.append(1)
            continue
        raw = np.frombuffer((texts[i] or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        first = np.arange(0, n, PASSAGE_WORDS)
        of = np.arange(n) // PASSAGE_WORDS
        k = len(first)
        words = np.bincount(of, minlength=k).astype(float)
        last = np.minimum(first + PASSAGE_WORDS, n) - 1
        kind = _CLASS[raw]
        begin, stop = start[first], end[last]
        # characters of a passage by class; the gaps between words count as none
        counts = np.stack([_between(kind == c, begin, stop) for c in range(_CLASSES)], axis=1).astype(float)
        gaps = stop - begin - np.add.reduceat(end - start, first)
        counts[:, 6] -= gaps
        letters = np.maximum(counts[:, 0] + counts[:, 1] + counts[:, 7], 1.0)
        length = (end - start).astype(float)
        x = np.zeros((k, WIDTH))
        x[:, 0] = np.log1p(words)
        x[:, 1] = np.add.reduceat(length, first) / words
        x[:, 2] = counts[:, 0] / letters
        for c in range(2, 7):
            x[:, 1 + c] = np.log1p(counts[:, c]) - np.log1p(words)
        x[:, 8] = counts[:, 7] / letters
        same = np.r_[False, h[1:] == h[:-1]]
        x[:, 9] = np.add.reduceat(same.astype(float), first) / words
        order = np.lexsort((h, of))
        fresh = np.r_[True, (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])]
        x[:, 10] = np.bincount(of[order], weights=fresh, minlength=k) / words
        x[:, 11] = np.log1p(k)
        x[:, 12] = np.add.reduceat((length > 14).astype(float), first) / words
        x[:, 13] = np.add.reduceat((length <= 2).astype(float), first) / words
        x[:, 14] = (raw[np.minimum(end - 1, len(raw) - 1)] == 33)[last].astype(float)
        bucket = (h >> np.uint64(40)).astype(np.int64) % HASHED
        short = length <= 4
        mix = np.bincount(of[short] * HASHED + bucket[short], minlength=k * HASHED).reshape(k, HASHED)
        x[:, 16:] = mix / words[:, None]
        rows.append(x)
        sizes.append(k)
    return (np.concatenate(rows) if rows else np.zeros((0, WIDTH))), np.array(sizes, dtype=np.int64)


def _between(mask: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask)))
    return total[stop] - total[begin]


def forward(w: dict[str, np.ndarray], x: np.ndarray, sizes: np.ndarray):
    """Scores of bags whose passages lie one after another, and what the gradient needs."""
    first = np.cumsum(sizes) - sizes
    bag = np.repeat(np.arange(len(sizes)), sizes)
    h = np.tanh(x @ w["W"] + w["b"])
    t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-np.clip(h @ w["U"], -30, 30)))
    e = (t * s) @ w["a"]
    e = np.exp(e - np.maximum.reduceat(e, first)[bag])
    att = e / np.add.reduceat(e, first)[bag]
    z = np.add.reduceat(att[:, None] * h, first, axis=0)
    p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))
    return p, (first, bag, h, t, s, att, z)


def _slopes(w, x, y, p, saved):
    first, bag, h, t, s, att, z = saved
    dp = (p - y) / len(y)
    g = {"c": z.T @ dp, "d": np.array([dp.sum()])}
    dz = dp[:, None] * w["c"]
    datt = (h * dz[bag]).sum(1)
    de = att * (datt - np.add.reduceat(att * datt, first)[bag])
    dts = de[:, None] * w["a"]
    g["a"] = (t * s).T @ de
    dt, ds = dts * s * (1 - t * t), dts * t * s * (1 - s)
    g["V"], g["U"] = h.T @ dt, h.T @ ds
    dh = (att[:, None] * dz[bag] + dt @ w["V"].T + ds @ w["U"].T) * (1 - h * h)
    g["W"], g["b"] = x.T @ dh, dh.sum(0)
    return g


def train(texts: list[str | None], labels: list[int], p: Fit = Fit()) -> Model:
    """Adam on the log loss; features are centred and scaled first. Without labels every score is 0.5."""
    return learn(*describe(texts), labels, p)


def learn(x: np.ndarray, sizes: np.ndarray, labels: list[int], p: Fit = Fit()) -> Model:
    """``train`` on texts that are described already."""
    rng = np.random.default_rng(p.seed)
    center = x.mean(0) if len(x) else np.zeros(WIDTH)
    scale = x.std(0) + 1e-3 if len(x) else np.ones(WIDTH)
    x = np.clip((x - center) / scale, -8, 8)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
    w = {"W": draw(WIDTH, p.hidden), "b": np.zeros(p.hidden), "V": draw(p.hidden, p.gate), "U": draw(p.hidden, p.gate), "a": draw(p.gate), "c": np.zeros(p.hidden), "d": np.zeros(1)}
    y = np.array(labels, dtype=float)
    if len(y):
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        w["d"][0] = np.log(share / (1 - share))
    first = np.cumsum(sizes) - sizes
    m, v = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}
    step = 0
    for epoch in range(p.epochs if len(y) else 0):
        order = rng.permutation(len(y))
        for at in range(0, len(order), p.batch):
            pick = order[at : at + p.batch]
            rows = np.concatenate([np.arange(first[i], first[i] + sizes[i]) for i in pick])
            score, saved = forward(w, x[rows], sizes[pick])
            g = _slopes(w, x[rows], y[pick], score, saved)
            step += 1
            for k in w:
                g[k] = g[k] + p.ridge * w[k]
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.001 * (g[k] ** 2 - v[k])
                w[k] -= p.rate / (1 + epoch / 10) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(center, scale, w)


def score(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, passages, largest attention weight of a passage) of each text."""
    x, sizes = describe(texts)
    if not len(sizes):
        return np.zeros(0), sizes, np.zeros(0)
    p, saved = forward(model.weights, np.clip((x - model.center) / model.scale, -8, 8), sizes)
    return p, sizes, np.maximum.reduceat(saved[5], saved[0])


def fit(labelled: DataFrame, p: Fit = Fit()) -> Model:
    """A model from ``labelled`` (text, label 0 or 1); rows with a NULL label are left out, NULL text counts as empty.

    The sample's texts are described in tasks; only their passages' figures come to the driver, ``WIDTH`` numbers each.
    """
    known = labelled.filter(F.col("label").isin(0, 1)).select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"))
    rows = bounded_sample(known, ["text", "label"], F.length("text"), p.rows, p.chars).mapInArrow(_described, "label int, passages long, x binary").toArrow()
    x = np.concatenate([np.zeros((0, WIDTH)), *(np.frombuffer(v.as_buffer()).reshape(-1, WIDTH) for v in rows["x"])])
    return learn(x, rows["passages"].to_numpy().astype(np.int64), rows["label"].to_pylist(), p)


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            x, sizes = describe(part["text"].to_pylist())
            each = [v.tobytes() for v in np.split(x, np.cumsum(sizes)[:-1])]
            yield pa.RecordBatch.from_arrays([part["label"], pa.array(sizes, pa.int64()), pa.array(each, pa.binary())], names=["label", "passages", "x"])


_OUT = "doc_id long, score double, passages long, top_attention double"


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, passages, top_attention) for every row of ``docs`` (doc_id, text); a map-only job.

    NULL text counts as empty; an empty text has one blank passage and gets a score as any other. Repeated rows and NULL ids are kept,
    other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [score(shared.value, batch["text"].slice(at, 1000).to_pylist()) for at in range(0, batch.num_rows, 1000)]
            found, size, top = (np.concatenate(x) for x in zip(*parts)) if parts else score(shared.value, [])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(found), pa.array(size, pa.int64()), pa.array(top)],
                names=["doc_id", "score", "passages", "top_attention"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _OUT)

