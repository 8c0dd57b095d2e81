"""A convolutional text classifier in numpy: hashed word embeddings, several filter widths, max pooling.

A word's embedding is the sum of two hashed ones, of the word and of its first ``STEM`` letters, so that inflected and
compound forms that the sample lacks share what is known of their stem.

Scores depend on the text alone. Training uses a bounded sample of labelled rows (``per_class`` rows of each label, least by a
hash of their id), weighted back to the label shares of all labelled rows, with whole texts. A quarter of
the sample is set aside to calibrate the scores (logistic scaling) and the decision threshold of each language.

Because a convolution over embeddings is a sum of one term per word and place, scoring uses tables of those terms per hash
bucket: a document's features are gathers, additions and a maximum, in pieces of bounded length.

Defined cases: null or empty text has no words and gets the score of an empty text; a text of any length is scored whole, piece by
piece; repeated rows get equal scores; a null or rare language uses the threshold of all; with no labelled rows, or one class only, every
score is the share of toxic labels (0 without any); labels of unknown documents are ignored; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import CACHES, claim, give_back

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 15, 16, 24, (1, 2, 3)
PAD, STEM = 0, 5
EDGE = re.compile(r"^\W+|\W+$")
PIECE = 1 << 20  # characters of a text that are split at once
WORDS = 1 << 16  # words whose features are in memory at once


class Buckets(dict):
    """Hash buckets of word and stem (16 bits each) by word, as written; forgotten as a whole when it has grown to ``most`` words."""

    most = 300_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        bare = EDGE.sub("", word) or word
        whole, stem = (1 + zlib.crc32(x.encode("utf-8", "surrogatepass")) % (BUCKETS - 1) for x in (bare, "^" + bare[:STEM]))
        self[word] = n = whole << 16 | stem
        return n


SEEN = Buckets()
CACHES.append(SEEN)


def word_ids(text: str) -> np.ndarray:
    pieces, at = [], 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and not text[end].isspace() and end - at < 2 * PIECE:
            end += 1
        words = text[at:end].lower().split()
        pieces.append(np.fromiter(map(SEEN.__getitem__, words), np.int32, len(words)))
        at = end
    return np.concatenate(pieces) if pieces else np.empty(0, np.int32)


@dataclass
class Model:
    embedding: np.ndarray
    filters: dict[int, np.ndarray]  # width -> (width, DIM, FILTERS)
    bias: dict[int, np.ndarray]
    out: np.ndarray
    offset: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str | None, float] = field(default_factory=lambda: {None: 0.5})
    share: float | None = None  # set where nothing could be learned

    def terms(self) -> dict[int, list[np.ndarray]]:
        return {w: [np.ascontiguousarray(self.embedding @ f[k]) for k in range(w)] for w, f in self.filters.items()}


def pooled(ids: np.ndarray, starts: np.ndarray, terms: dict[int, list[np.ndarray]]) -> np.ndarray:
    """Largest response of each filter between each two starts. ``ids`` has padding after every document; a window that would
    run into the next one counts as padding alone, whose response is 0."""
    n, out = len(ids), []
    ends = np.append(starts[1:], n)
    ids = np.stack([ids >> 16, ids & 0xFFFF])
    shown = [ids, np.concatenate([ids[:, 1:], [[PAD]] * 2], axis=1), np.concatenate([ids[:, 2:], [[PAD] * 2] * 2], axis=1)[:, :n]]
    for w, t in terms.items():
        total = t[0][shown[0][0]]
        total += t[0][shown[0][1]]
        for k in range(1, w):
            total += t[k][shown[k][0]]
            total += t[k][shown[k][1]]
        for k in range(1, w):
            total[np.maximum(ends - k, starts)] = 0
        out.append(np.maximum.reduceat(total, starts, axis=0))
    return np.concatenate(out, axis=1)


def features(texts: list[str], model: Model, terms: dict[int, list[np.ndarray]]) -> np.ndarray:
    """One row of pooled responses per text; long texts are taken in overlapping pieces."""
    out = np.full((len(texts), FILTERS * len(WIDTHS)), -np.inf, np.float32)
    held: list[np.ndarray] = []
    owners: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal held, owners, size
        if held:
            starts = np.cumsum([0, *[len(x) for x in held[:-1]]])
            got = pooled(np.concatenate(held), starts, terms)
            np.maximum.at(out, owners, got)
        held, owners, size = [], [], 0

    for i, text in enumerate(texts):
        ids = np.append(word_ids(text), np.full(2, PAD, np.int32))
        for a in range(0, len(ids), WORDS):
            held.append(ids[a : a + WORDS + 2])
            owners.append(i)
            size += len(held[-1])
            if size >= WORDS:
                flush()
    flush()
    bias = np.concatenate([model.bias[w] for w in WIDTHS])
    return np.maximum(out + bias, 0)


def response(rows: np.ndarray, model: Model) -> np.ndarray:
    """Raw scores, each summed over its own row, so that other rows do not change its rounding."""
    return (rows * model.out).sum(axis=1) + model.offset


def scores(texts: list[str], model: Model, terms: dict[int, list[np.ndarray]]) -> np.ndarray:
    if model.share is not None:
        return np.full(len(texts), model.share)
    raw = response(features(texts, model, terms), model)
    return 1 / (1 + np.exp(-np.clip(model.scale[0] * raw.astype(np.float64) + model.scale[1], -30, 30)))


def train(documents: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, epochs: int = 6, batch: int = 48, rate: float = 0.01, seed: int = 7) -> Model:
    """Adam on the weighted logistic loss; gradients flow only through each filter's winning window."""
    rng = np.random.default_rng(seed)
    p = {"e": rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), "o": rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), "c": np.zeros(1, np.float32)}
    p["e"][PAD] = 0
    for w in WIDTHS:
        p[f"f{w}"] = rng.normal(0, (1 / (w * DIM)) ** 0.5, (w, DIM, FILTERS)).astype(np.float32)
        p[f"b{w}"] = np.zeros(FILTERS, np.float32)
    mean = float(np.average(labels, weights=weights))
    p["c"][0] = np.log(mean / (1 - mean))
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(documents))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            # Padding as long as the widest filter: one window of padding alone, as in scoring, and none that reaches the next text.
            ids = np.concatenate([np.append(documents[i], [PAD] * max(WIDTHS)) for i in rows]).astype(np.int32)
            lengths = np.array([len(documents[i]) + max(WIDTHS) for i in rows])
            starts = np.cumsum(np.append(0, lengths[:-1]))
            ends = starts + lengths
            ids = (ids >> 16, ids & 0xFFFF)
            x = p["e"][ids[0]] + p["e"][ids[1]]
            hidden, wins = [], []
            for w in WIDTHS:
                f = p[f"f{w}"]
                total = x @ f[0]
                for k in range(1, w):
                    total[:-k] += x[k:] @ f[k]
                    total[ends - k] = -np.inf
                top = np.maximum.reduceat(total, starts, axis=0)
                owner = np.repeat(np.arange(len(rows)), lengths)
                win = np.zeros((len(rows), FILTERS), np.int64)
                at, which = np.nonzero(total == top[owner])
                win[owner[at], which] = at
                hidden.append(top + p[f"b{w}"])
                wins.append(win)
            raw = np.concatenate(hidden, axis=1)
            h = np.maximum(raw, 0)
            keep = (rng.random(h.shape) < 0.7).astype(np.float32) / 0.7
            h = h * keep
            z = h @ p["o"] + p["c"][0]
            y = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            d = ((y - labels[rows]) * weights[rows] / len(rows)).astype(np.float32)
            g = {k: np.zeros_like(v) for k, v in p.items()}
            g["o"], g["c"] = h.T @ d, np.array([d.sum()], np.float32)
            dh = d[:, None] * p["o"] * keep * (raw > 0)
            for j, w in enumerate(WIDTHS):
                part, win = dh[:, j * FILTERS : (j + 1) * FILTERS], wins[j]
                g[f"b{w}"] = part.sum(0)
                for k in range(w):
                    at = win + k
                    e = x[at]  # rows, filters, dim
                    g[f"f{w}"][k] = np.einsum("rf,rfd->df", part, e)
                    for i in ids:
                        np.add.at(g["e"], i[at], part[:, :, None] * p[f"f{w}"][k].T[None])
            g["e"][PAD] = 0
            step += 1
            for k in p:
                m1[k] += 0.1 * (g[k] - m1[k])
                m2[k] += 0.001 * (g[k] ** 2 - m2[k])
                p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
            p["e"][PAD] = 0
    return Model(p["e"], {w: p[f"f{w}"] for w in WIDTHS}, {w: p[f"b{w}"] for w in WIDTHS}, p["o"], float(p["c"][0]))


def calibrate(model: Model, texts_ids: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, langs: list[str | None]) -> None:
    """Logistic scaling of the raw scores, then per language the threshold of the best F1; rare languages use that of all."""
    terms = model.terms()
    bias = np.concatenate([model.bias[w] for w in WIDTHS])
    rows = [np.append(x, [PAD, PAD]).astype(np.int32) for x in texts_ids]
    raw = response(np.array([np.maximum(pooled(x, np.array([0]), terms)[0] + bias, 0) for x in rows]), model).astype(np.float64)
    a, b = 1.0, 0.0
    for _ in range(200):
        y = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        d = (y - labels) * weights
        s = weights * y * (1 - y) + 1e-9
        h = np.array([[np.sum(s * raw * raw) + 1, np.sum(s * raw)], [np.sum(s * raw), np.sum(s) + 1e-3]])
        step = np.linalg.solve(h, [np.sum(d * raw) + (a - 1), np.sum(d)])
        a, b = a - 0.5 * step[0], b - 0.5 * step[1]
    model.scale = (float(a), float(b)) if np.isfinite([a, b]).all() and a > 0 else (1.0, 0.0)
    y = 1 / (1 + np.exp(-np.clip(model.scale[0] * raw + model.scale[1], -30, 30)))

    def best(mask: np.ndarray) -> float:
        marks = np.linspace(0.2, 0.8, 25)
        f1 = []
        for t in marks:
            hit = np.sum(weights[mask] * ((y[mask] >= t) & (labels[mask] == 1)))
            f1.append(2 * hit / max(1e-9, np.sum(weights[mask] * (y[mask] >= t)) + np.sum(weights[mask] * labels[mask])))
        good = marks[np.array(f1) >= max(f1) - 1e-9]
        return float(good[np.argmin(abs(good - 0.5))])

    every = np.ones(len(labels), bool)
    model.thresholds = {None: best(every)}
    names = np.array([x or "" for x in langs])
    for lang in sorted(set(names)):
        mask = names == lang
        if labels[mask].sum() >= 20 and (labels[mask] == 0).sum() >= 20:
            model.thresholds[lang] = best(mask)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 2000, epochs: int = 6) -> Model:
    """Train on at most ``per_class`` labelled rows of each label that are not held out."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)").where(~held_out())
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in usable.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    picked = [usable.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    picked = picked[0].union(picked[1])

    def to_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [word_ids(x or "").tobytes() for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(ids, pa.binary())], names=["doc_id", "toxic", "lang", "ids"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.join(F.broadcast(picked), "doc_id").select("doc_id", "toxic", "lang", "text")  # at most 2 x per_class ids
    rows = rows.mapInArrow(to_ids, "doc_id long, toxic int, lang string, ids binary").collect()
    rows = sorted({r["doc_id"]: r for r in rows}.values(), key=lambda r: zlib.crc32(str(r["doc_id"]).encode()[::-1]))
    y = np.array([r["toxic"] for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        share = counts.get(1, 0) / total if total else 0.0
        return Model(np.zeros((BUCKETS, DIM), np.float32), {w: np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS}, {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, np.zeros(FILTERS * len(WIDTHS), np.float32), 0.0, share=share)
    weight = np.where(y == 1, counts[1] / max(1, y.sum()), counts[0] / max(1, (y == 0).sum()))
    weight *= len(y) / weight.sum()
    ids = [np.frombuffer(r["ids"], np.int32) for r in rows]
    cut = max(1, len(rows) * 3 // 4)
    model = train(ids[:cut], y[:cut], weight[:cut], epochs)
    rest = slice(cut, None) if len(rows) > cut and 0 < y[cut:].sum() < len(y[cut:]) else slice(None)
    calibrate(model, ids[rest], y[rest], weight[rest], [r["lang"] for r in rows][rest])
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with its columns and ``tox_score``; only the text reaches the model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: 2 MB of embeddings
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", tox_score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(SEEN)
        m = shared.value
        terms = m.terms()
        for b in batches:
            at = b.schema.get_field_index(text)
            out = []
            for k in range(0, b.num_rows, 512):
                out.append(scores([x or "" for x in b.column(at).slice(k, 512).to_pylist()], m, terms))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out) if out else [], pa.float64())], names=[*b.schema.names, "tox_score"])
        give_back()

    return docs.mapInArrow(run, schema)


def decided(scored: DataFrame, model: Model, lang: str = "lang") -> Column:
    """Whether a row's score reaches its language's calibrated threshold."""
    limit = F.lit(model.thresholds[None])
    for name, t in sorted((k, t) for k, t in model.thresholds.items() if k is not None):
        limit = F.when(F.col(lang) == name, F.lit(t)).otherwise(limit)
    return F.col("tox_score") >= limit


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, columns unchanged."""
    model = fit(docs, labels)
    names = docs.columns
    scored = score(docs.select(F.struct(*names).alias("doc"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), model)
    return scored.where(~decided(scored, model)).select("doc.*")
