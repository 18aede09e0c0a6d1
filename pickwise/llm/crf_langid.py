"""Language of every word, and of the text, by a linear-chain conditional random field.

A word's features are its affixes, character n-grams and its place in learned lexicons; transitions between neighbouring labels are
learned as well, so a switch inside a text costs what it costs in the training data. Posteriors come from forward-backward over the
whole text. The text's language is the one with the largest mean posterior over its words.

Fitting takes a bounded sample of labelled texts. Training chains join stretches of one to three of them, so switches occur.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pickwise.llm.common import bounded_sample, slices
from pickwise.llm.words import mix

BUCKETS = 1 << 16
CACHE_WORDS = 150_000
TEXTS = 500  # texts tagged at a time
UNKNOWN = "und"


@dataclass(frozen=True)
class Fit:
    """Bounds and effort of the fit: at most ``rows`` different texts with at most ``chars`` characters, shared by the languages, ``chains`` training chains of one to three
    stretches of ``stretch`` words, ``lexicon`` words a language."""

    rows: int = 3000
    chars: int = 8_000_000
    chains: int = 2500
    stretch: int = 18
    lexicon: int = 2000
    epochs: int = 30
    rate: float = 0.05
    ridge: float = 1e-6
    seed: int = 7


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (buckets, labels)
    transition: np.ndarray  # (labels, labels), from row to column
    start: np.ndarray
    lexicon: dict[str, int] = field(default_factory=dict)  # word -> label


_OTHER = re.compile(r"[^\w\n]+|[\d_]+")
_EDGE = 1  # code of the mark before and behind a word


def letters(words: list[str]) -> list[str]:
    """The words in lower case without what is not a letter; a word without letters is empty. Words hold no white space."""
    clean = _OTHER.sub("", "\n".join(words).lower()).split("\n") if words else []
    return [w if w.isalpha() else "".join(c for c in w if c.isalpha()) for w in clean]


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of non-empty words, and where each word's begin: marked 2- and 3-grams, which hold the affixes of one
    and two letters, affixes of three letters, and the lexicon."""
    code = np.frombuffer("".join(f"\x01{w}\x01" for w in words).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    size = np.array([len(w) + 2 for w in words], dtype=np.int64)
    first = np.cumsum(size) - size
    two = code[:-1] * np.uint64(0x9E3779B1) + code[1:] * np.uint64(0x85EBCA77)
    three = two[:-1] * np.uint64(0xC2B2AE3D) + code[2:] * np.uint64(0x27D4EB2F)
    four = three[:-1] * np.uint64(0x165667B1) + code[3:] * np.uint64(0x9E3779B1) if len(code) > 3 else three[:0]
    word = np.repeat(np.arange(len(words)), size)
    inside2 = word[:-1] == word[1:]
    inside3 = word[:-2] == word[2:]
    end = first + size
    long = size >= 5
    known = np.array([lexicon.get(w, -1) for w in words], dtype=np.int64)
    parts = [
        (two[inside2] + np.uint64(2), word[:-1][inside2]), (three[inside3] + np.uint64(3), word[:-2][inside3]),
        (four[first[long]] + np.uint64(5), np.flatnonzero(long)), (four[end[long] - 4] + np.uint64(7), np.flatnonzero(long)),
        (known[known >= 0].astype(np.uint64) + np.uint64(11), np.flatnonzero(known >= 0)),
    ]
    bucket, owner = mix(np.concatenate([x for x, _ in parts])) & np.uint64(BUCKETS - 1), np.concatenate([o for _, o in parts])
    order = np.argsort(owner, kind="stable")
    return bucket[order].astype(np.int64), np.searchsorted(owner[order], np.arange(len(words)))


def forward_backward(emit: np.ndarray, lengths: np.ndarray, transition: np.ndarray, start: np.ndarray, edges: bool = False):
    """Posteriors of chains that lie side by side, longest first.

    ``emit`` is (time, chain, label), above zero, and scaled per word as one likes. Returns posteriors of the same shape (zero behind a
    chain's end) and, with ``edges``, the expected number of each transition.
    """
    steps, chains, k = emit.shape
    active = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")  # chains longer than t
    alpha = np.zeros_like(emit)
    a = start * emit[0]
    alpha[0] = a / a.sum(1, keepdims=True)
    for t in range(1, steps):
        n = active[t]
        a = (alpha[t - 1, :n] @ transition) * emit[t, :n]
        a /= a.sum(1, keepdims=True)
        alpha[t, :n] = a
    beta = np.ones((chains, k), dtype=emit.dtype)
    expected = np.zeros((k, k)) if edges else None
    back = transition.T.copy()
    for t in range(steps - 2, -1, -1):
        n = active[t + 1]
        ahead = emit[t + 1, :n] * beta[:n]
        if edges:
            joint = alpha[t, :n, :, None] * transition * ahead[:, None, :]
            expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        alpha[t + 1, :n] *= beta[:n]
        b = ahead @ back
        beta[:n] = b / b.sum(1, keepdims=True)
    alpha[0] *= beta
    total = alpha.sum(2, keepdims=True)
    np.divide(alpha, total, out=alpha, where=total > 0)
    return alpha, expected


def train(texts: list[str], langs: list[str], p: Fit = Fit()) -> Model:
    """Maximum likelihood of the labels of the training chains, by Adam."""
    labels = sorted(set(langs))
    k = len(labels)
    place = {x: i for i, x in enumerate(labels)}
    words = [[w for w in letters(t.split()) if w] for t in texts]
    lexicon = _lexicon(words, [place[x] for x in langs], k, p.lexicon)
    rng = np.random.default_rng(p.seed)
    by_label = [[i for i, x in enumerate(langs) if place[x] == c and words[i]] for c in range(k)]
    usable = [c for c in range(k) if by_label[c]]
    if not usable:
        return Model(labels, np.zeros((BUCKETS, k), np.float32), np.zeros((k, k)), np.zeros(k), lexicon)
    chains: list[tuple[list[str], list[int]]] = []
    for _ in range(p.chains):
        seq, tags = [], []
        for _ in range(rng.choice([1, 2, 3], p=[0.7, 0.2, 0.1])):
            c = usable[rng.integers(len(usable))]
            w = words[by_label[c][rng.integers(len(by_label[c]))]]
            at = int(rng.integers(max(1, len(w) - p.stretch + 1)))
            part = w[at : at + p.stretch]
            seq += part
            tags += [c] * len(part)
        chains.append((seq, tags))
    chains.sort(key=lambda x: -len(x[0]))
    lengths = np.array([len(s) for s, _ in chains])
    vocabulary = sorted({w for s, _ in chains for w in s})
    index = {w: i for i, w in enumerate(vocabulary)}
    bucket, starts = features(vocabulary, lexicon)
    owner = np.repeat(np.arange(len(vocabulary)), np.diff(np.r_[starts, len(bucket)]))
    used, flat = np.unique(bucket, return_inverse=True)
    steps = int(lengths[0])
    at = np.full((steps, len(chains)), -1)
    gold = np.zeros((steps, len(chains)), dtype=int)
    for j, (s, tags) in enumerate(chains):
        at[: len(s), j] = [index[w] for w in s]
        gold[: len(s), j] = tags
    there = at >= 0
    weight, move, first = np.zeros((len(used), k)), np.zeros((k, k)), np.zeros(k)
    true_move = np.zeros((k, k))
    both = there[1:]
    np.add.at(true_move, (gold[:-1][both], gold[1:][both]), 1)
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (weight, move, first)]
    n_words = there.sum()
    for step in range(1, p.epochs + 1):
        score = np.add.reduceat(weight[flat], starts, axis=0)
        potential = np.exp(score - score.max(1, keepdims=True)) + 1e-12
        emit = np.where(there[:, :, None], potential[at], 1.0)
        post, expected = forward_backward(emit, lengths, np.exp(move), np.exp(first), edges=True)
        diff = -post
        diff[np.arange(steps)[:, None], np.arange(len(chains))[None, :], gold] += 1
        diff[~there] = 0
        per_word = np.stack([np.bincount(at[there], weights=diff[there][:, c], minlength=len(vocabulary)) for c in range(k)], axis=1)
        slope = np.stack([np.bincount(flat, weights=per_word[owner, c], minlength=len(used)) for c in range(k)], axis=1)
        slopes = (slope / n_words - p.ridge * weight, (true_move - expected) / n_words, diff[0].sum(0) / n_words)
        for x, g, m in zip((weight, move, first), slopes, moments):
            m[0] += 0.1 * (g - m[0])
            m[1] += 0.01 * (g * g - m[1])
            x += 3 * p.rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-9) / np.sqrt(step)
    full = np.zeros((BUCKETS, k), dtype=np.float32)
    full[used] = weight
    return Model(labels, full, move, first, lexicon)


def _lexicon(words: list[list[str]], langs: list[int], k: int, most: int) -> dict[str, int]:
    """The most frequent words, up to ``most`` a language, of which nine in ten occurrences are in texts of one language."""
    counts = [Counter() for _ in range(k)]
    for w, c in zip(words, langs):
        counts[c].update(w)
    total = Counter()
    for c in counts:
        total += c
    out = {}
    for c in range(k):
        own = sorted((w for w, n in counts[c].items() if n >= 3 and n >= 0.9 * total[w]), key=lambda w: (-counts[c][w], w))
        out |= {w: c for w in own[:most]}
    return out


def fit(docs: DataFrame, p: Fit = Fit()) -> Model:
    """A model from ``docs`` (text, lang); rows without text or lang are left out. No rows give a model without labels."""
    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang")
    rows = bounded_sample(known, ["text", "lang"], F.length("text"), p.rows, p.chars, "lang").toArrow()
    return train(rows["text"].to_pylist(), rows["lang"].to_pylist(), p)


class Tagger:
    """A model at work in one task; the emissions of words met before are remembered."""

    def __init__(self, model: Model):
        self.model, self.k = model, len(model.labels)
        self.transition, self.start = np.exp(model.transition).astype(np.float32), np.exp(model.start).astype(np.float32)
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.ones((1024, self.k), dtype=np.float32)
        self.spelt = np.zeros(1024, dtype=bool)  # has letters

    def _add(self, fresh: list[str]) -> None:
        first = len(self.place)
        need = first + len(fresh)
        if need > len(self.rows):
            grown = max(need, 2 * len(self.rows))
            self.rows = np.concatenate([self.rows, np.ones((grown - len(self.rows), self.k), dtype=np.float32)])
            self.spelt = np.concatenate([self.spelt, np.zeros(grown - len(self.spelt), dtype=bool)])
        self.place.update(zip(fresh, range(first, need)))
        clean = letters(fresh)
        owner = [i for i, w in enumerate(clean, first) if w]
        if owner:
            bucket, starts = features([w for w in clean if w], self.model.lexicon)
            score = np.add.reduceat(self.model.weights[bucket], starts, axis=0)
            score -= score.max(1, keepdims=True)
            self.rows[owner] = np.exp(np.maximum(score, -60.0)) + 1e-12
            self.spelt[owner] = True

    def __call__(self, texts: list[str | None]):
        """(mean posterior per label, words with letters, label switches) for every text."""
        parts = [(t or "").split() for t in texts]
        if len(self.place) > CACHE_WORDS:
            self._clear()
        fresh = set()
        for p in parts:
            fresh.update(p)
        self._add(list(fresh.difference(self.place)))
        get = self.place.__getitem__
        mean = np.zeros((len(texts), self.k))
        count, switches = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
        lengths = np.array([len(p) for p in parts], dtype=np.int64)
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] > 0]
        i = 0
        while i < len(order):
            n = int(min(512, max(1, 300_000 // lengths[order[i]])))
            group = order[i : i + n]
            i += n
            own = lengths[group]
            at = np.full((int(own[0]), len(group)), -1, dtype=np.int64)
            for j, g in enumerate(group):
                at[: own[j], j] = np.fromiter(map(get, parts[g]), dtype=np.int64, count=own[j])
            post, _ = forward_backward(self.rows[at], own, self.transition, self.start)
            spelt = (at >= 0) & self.spelt[at]
            n_spelt = spelt.sum(0)
            mean[group] = (post * spelt[:, :, None]).sum(0, dtype=np.float64) / np.maximum(n_spelt, 1)[:, None]
            count[group] = n_spelt
            top = post.argmax(2)
            inside = np.arange(1, len(top))[:, None] < own[None, :]
            switches[group] = ((top[1:] != top[:-1]) & inside).sum(0)
        return mean, count, switches

    def words(self, text: str | None) -> list[tuple[str, str]]:
        """Each word of one text with its most probable language; ``und`` for words without letters."""
        parts = (text or "").split()
        if not parts or not self.k:
            return [(w, UNKNOWN) for w in parts]
        self._add([w for w in dict.fromkeys(parts) if w not in self.place])
        at = np.array([self.place[w] for w in parts])
        post, _ = forward_backward(self.rows[at][:, None, :], np.array([len(parts)]), self.transition, self.start)
        return [(w, self.model.labels[c] if self.spelt[i] else UNKNOWN) for w, i, c in zip(parts, at, post[:, 0].argmax(1))]


_OUT = "doc_id long, lang_pred string, score double, words long, switches long"


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score, words, switches) for every row of ``docs`` (doc_id, text); a map-only job.

    lang_pred is ``und`` with score 0 if the text is NULL or has no letter, or the model has no label. Ties go to the first label in
    alphabetical order. Other columns, among them lang and source, are not read; repeated rows and NULL ids are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in batches:
            names, score, words, turns = [], [], [], []
            for start in range(0, batch.num_rows, TEXTS):
                part = batch.slice(start, TEXTS)
                n = part.num_rows
                if tagger.k:
                    mean, count, switches = tagger(part["text"].to_pylist())
                else:
                    mean, count, switches = np.zeros((n, 1)), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
                best = mean.argmax(1)
                known = count > 0
                names += [tagger.model.labels[b] if ok else UNKNOWN for b, ok in zip(best, known)]
                score.append(np.where(known, np.clip(mean[np.arange(n), best], 0, 1), 0.0))
                words.append(count)
                turns.append(switches)
            join = lambda x, kind: pa.array(np.concatenate(x) if x else np.empty(0), kind)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], pa.array(names, pa.string()), join(score, pa.float64()), join(words, pa.int64()), join(turns, pa.int64())],
                names=["doc_id", "lang_pred", "score", "words", "switches"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _OUT)


def known_only(docs: DataFrame, model: Model, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is known with a score of at least ``least``; a map-only job."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for batch in slices(batches, TEXTS):
            if tagger.k:
                mean, count, _ = tagger(batch[text_col].to_pylist())
                yield batch.filter(pa.array((count > 0) & (mean.max(1) >= least)))

    return docs.mapInArrow(run, docs.schema)
