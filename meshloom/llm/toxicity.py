"""Toxicity: a convolutional text classifier over hashed word embeddings.

A word is embedded as the sum of hashed rows for itself and for its prefixes of
4, 5 and 6 bytes.  Filters one, two and three words wide slide over the whole
text; the largest response of each filter goes through a logistic unit.  The
network is trained in numpy on the driver from a bounded sample of labelled
texts (``PER_CLASS`` texts of each label, the first in the order of a hash).
Thresholds are calibrated by language: the score is shifted so that 0.5 is the
best threshold among calibration texts of the language, which is recognised from
the letters of the text itself.  Label, language, source and id are no inputs.

Defined results: null, empty and wordless texts are scored from the bias alone;
a document with several labels is toxic if one of them says so; null labels are
ignored; without labels of both kinds every score is 0; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize
from .textops import IS_LETTER, U, released, slices, text_buffer, words

PER_CLASS = 3000
BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 8, 6, (1, 2, 3)
PREFIXES = (4, 5, 6)
EPOCHS, BATCH, RATE, SEED, PRIOR, CLEAN = 6, 32, 0.1, 11, 8.0, 10.0
FOLD, CALIBRATION = 5, 5
# Letters that mark a language; as second bytes after 0xC3.  Fixed values.
MARKS = {"de": "äöüßÄÖÜ", "fr": "èêçàâîûëïÈÊÇ", "es": "ñóíáÑÓÍ"}
LANGUAGES = ("en", *MARKS)


def held_out(doc_id: Column, of: int = FOLD, rest: int = 0) -> Column:
    """Whether crc32(doc_id as text) mod ``of`` is ``rest``; False for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % of == rest, F.lit(False))


def languages(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Index into LANGUAGES per text, by counts of marking letters."""
    table = np.zeros(256, np.int64)
    for k, letters in enumerate(MARKS.values(), 1):
        for byte in {x.encode()[1] for x in letters}:
            table[byte] = k
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    counts = np.zeros((len(at) - 1, len(LANGUAGES)), np.int64)
    kind = table[data[second]]
    np.add.at(counts, (np.searchsorted(at, second, "right") - 1, kind), 1)
    counts[:, 0] = np.diff(at) // 400  # fewer marks than one in 400 bytes: the first language
    return counts.argmax(1)


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket rows of the distinct words, the row of each word in order, and word offsets."""
    _, _, h, offsets = words(data, at, IS_LETTER, PREFIXES)
    _, first, row = np.unique(h[:, 0] if len(h) else np.zeros(0, U), return_index=True, return_inverse=True)
    salt = np.arange(1, h.shape[1] + 1, dtype=U) * U(0x9E3779B97F4A7C15) if h.ndim == 2 else U(0)
    return ((h[first] + salt) >> U(64 - 16)).astype(np.int32), row, offsets


@dataclass
class Model:
    embedding: np.ndarray  # (BUCKETS, DIM)
    filters: list[np.ndarray]  # per width (width, DIM, FILTERS)
    filter_bias: np.ndarray  # (widths * FILTERS,)
    weight: np.ndarray
    bias: float
    shift: np.ndarray  # per language

    def responses(self, rows: np.ndarray, seq: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """Per width the responses of all positions; -inf where a filter leaves its text."""
        e = self.embedding[rows].sum(1)
        out = []
        for k, filters in zip(WIDTHS, self.filters, strict=True):
            z = np.zeros((len(seq), FILTERS), np.float32)
            for j in range(k):
                z[: len(seq) - j] += (e @ filters[j])[seq[j:]]
            for j in range(1, k):
                cut = offsets[1:] - j
                z[cut[(cut >= offsets[:-1])]] = -np.inf
            out.append(z)
        return out

    def pooled(self, z: list[np.ndarray], offsets: np.ndarray) -> np.ndarray:
        """max(0, bias + largest response) per text and filter."""
        n = len(offsets) - 1
        out = np.full((n, len(z) * FILTERS), -np.inf, np.float32)
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        if len(full):
            for k, x in enumerate(z):
                out[full, k * FILTERS : (k + 1) * FILTERS] = np.maximum.reduceat(x, offsets[full], axis=0)
        return np.maximum(out + self.filter_bias, 0)

    def logits(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        rows, seq, offsets = features(data, at)
        return self.pooled(self.responses(rows, seq, offsets), offsets) @ self.weight + self.bias

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        z = self.logits(data, at) - self.shift[languages(data, at)]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -60, 60)))


def runs(texts: pa.Array, size: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of consecutive texts, about ``size`` bytes at a time."""
    for part in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text", size):
        yield text_buffer(part.column(0))


def gathered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``features`` of all texts, made a run at a time so that memory holds a run and the words' numbers."""
    names, rows, seqs, sizes = [], [], [], []
    for data, at in runs(texts):
        _, _, h, offsets = words(data, at, IS_LETTER, (1,))
        own, seq = np.unique(h[:, 0], return_inverse=True)
        found, _, _ = features(data, at)
        names.append(own)
        rows.append(found)
        seqs.append(seq.astype(np.int32))
        sizes.append(np.diff(offsets))
    if not names:
        return np.zeros((0, 1 + len(PREFIXES)), np.int32), np.zeros(0, np.int32), np.zeros(1, np.int64)
    every, first = np.unique(np.concatenate(names), return_index=True)
    seq = np.concatenate([np.searchsorted(every, own).astype(np.int32)[x] for own, x in zip(names, seqs, strict=True)])
    return np.concatenate(rows)[first], seq, np.concatenate(([0], np.cumsum(np.concatenate(sizes))))


def train(texts: pa.Array, toxic: np.ndarray, calibration: np.ndarray, informed: bool = True) -> Model:
    """Fits the network; texts marked ``calibration`` only set thresholds.

    ``informed``: whether the first dimension starts from the buckets' evidence, or at random like the others."""
    rng = np.random.default_rng(SEED)
    rows, seq, offsets = gathered(texts)
    lang = np.concatenate([languages(*run) for run in runs(texts)])
    fit = np.flatnonzero(~calibration)
    # the first dimension starts from the evidence of each bucket's presence
    seen = np.zeros((2, BUCKETS))
    for i in fit:
        seen[int(toxic[i])][np.unique(rows[np.unique(seq[offsets[i] : offsets[i + 1]])])] += 1
    n = np.maximum(np.bincount(toxic[fit].astype(int), minlength=2), 1)
    share = PRIOR * n / n.sum()  # pseudo-texts of the sample's mixture keep rare buckets near no evidence
    evidence = np.log((seen[1] + share[1]) / share[1]) - np.log((seen[0] + share[0]) / share[0])
    known = seen.sum(0) >= 3
    embedding = np.zeros((BUCKETS, DIM), np.float32)
    embedding[known] = rng.normal(0, 0.02, (int(known.sum()), DIM))
    if informed:
        embedding[known, 0] = np.clip(evidence[known] - 1, 0, 4) / 4
    filters = [rng.normal(0, 0.2, (k, DIM, FILTERS)).astype(np.float32) for k in WIDTHS]
    for f in filters if informed else ():
        f[:, 0, : FILTERS // 2] = np.abs(f[:, 0, : FILTERS // 2]) + 0.5
        f[:, 1:, : FILTERS // 2] *= 0.1
    model = Model(embedding, filters, np.full(len(WIDTHS) * FILTERS, -0.4, np.float32), np.full(len(WIDTHS) * FILTERS, 0.3, np.float32), -1.0, np.zeros(len(LANGUAGES)))
    squares = [np.full_like(embedding, 1e-3), [np.full_like(f, 1e-3) for f in filters], np.full_like(model.filter_bias, 1e-3), np.full_like(model.weight, 1e-3), 1e-3]
    balance = np.where(toxic, len(fit) / (2 * n[1]), len(fit) / (2 * n[0]))
    for epoch in range(max(EPOCHS, min(24, EPOCHS * 2 * PER_CLASS // max(len(fit), 1)))):
        order = rng.permutation(fit)
        for b in range(0, len(order), BATCH):
            _step(model, squares, rows, seq, offsets, order[b : b + BATCH], toxic, balance, RATE / (1 + 0.25 * epoch))
    _calibrate(model, rows, seq, offsets, lang, toxic, np.flatnonzero(calibration) if calibration.any() else fit)
    return model


def _adagrad(value: np.ndarray, square: np.ndarray, grad: np.ndarray, rate: float) -> None:
    square += grad * grad
    value -= rate * grad / np.sqrt(square)


def _step(model: Model, squares: list, rows: np.ndarray, seq: np.ndarray, offsets: np.ndarray, batch: np.ndarray, toxic: np.ndarray, balance: np.ndarray, rate: float) -> None:
    own = np.concatenate([seq[offsets[i] : offsets[i + 1]] for i in batch])
    cut = np.concatenate(([0], np.cumsum(offsets[batch + 1] - offsets[batch])))
    if not len(own):
        return
    used, own = np.unique(own, return_inverse=True)
    feats = rows[used]
    z = model.responses(feats, own, cut)
    pooled = model.pooled(z, cut)
    p = 1 / (1 + np.exp(-np.clip(pooled @ model.weight + model.bias, -30, 30)))
    g = ((p - toxic[batch]) * balance[batch] / len(batch)).astype(np.float32)
    g_pool = g[:, None] * model.weight * (pooled > 0)
    e = model.embedding[feats].sum(1)
    grad_e = np.zeros_like(e)
    for k, width in enumerate(WIDTHS):
        gk = g_pool[:, k * FILTERS : (k + 1) * FILTERS]
        grad_f = np.zeros_like(model.filters[k])
        for i in range(len(batch)):
            if cut[i + 1] - cut[i] < width:
                continue
            best = z[k][cut[i] : cut[i + 1]].argmax(0) + cut[i]
            for j in range(width):
                word = own[best + j]
                grad_f[j] += e[word].T * gk[i]
                np.add.at(grad_e, word, (model.filters[k][j] * gk[i]).T)
        _adagrad(model.filters[k], squares[1][k], grad_f, rate)
    _adagrad(model.weight, squares[3], pooled.T @ g, rate)
    _adagrad(model.filter_bias, squares[2], g_pool.sum(0), rate * 0.3)
    grad_b = float(g.sum())
    squares[4] += grad_b * grad_b
    model.bias -= rate * grad_b / squares[4] ** 0.5
    on = np.flatnonzero(np.abs(grad_e).sum(1) > 0)
    buckets, back = np.unique(feats[on].reshape(-1), return_inverse=True)
    grad = np.zeros((len(buckets), DIM), np.float32)
    np.add.at(grad, back, np.repeat(grad_e[on], feats.shape[1], 0))
    live = model.embedding[buckets].any(1)  # buckets too rare to count stay zero
    buckets, grad = buckets[live], grad[live]
    squares[0][buckets] += grad * grad
    model.embedding[buckets] -= rate * 0.3 * grad / np.sqrt(squares[0][buckets])


def best_threshold(z: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the widest gap among the best thresholds; rejecting a clean text costs CLEAN times as much as missing a toxic one, rate for rate."""
    order = np.argsort(z, kind="stable")
    z, toxic = z[order], toxic[order].astype(float)
    miss = np.concatenate(([0], np.cumsum(toxic))) / max(toxic.sum(), 1)
    false = 1 - np.concatenate(([0], np.cumsum(1 - toxic))) / max((1 - toxic).sum(), 1)
    edge = np.concatenate(([z[0] - 1], z, [z[-1] + 1]))
    loss, gap = miss + CLEAN * false, edge[1:] - edge[:-1]
    best = np.flatnonzero(loss <= loss.min() + 1e-12)
    k = int(best[np.argmax(gap[best])])
    return float((edge[k] + edge[k + 1]) / 2)


def _calibrate(model: Model, rows: np.ndarray, seq: np.ndarray, offsets: np.ndarray, lang: np.ndarray, toxic: np.ndarray, chosen: np.ndarray) -> None:
    parts = []
    for k in range(0, len(chosen), BATCH):
        own = chosen[k : k + BATCH]
        cut = np.concatenate(([0], np.cumsum(offsets[own + 1] - offsets[own])))
        used, at = np.unique(np.concatenate([seq[offsets[i] : offsets[i + 1]] for i in own]), return_inverse=True)
        parts.append(model.pooled(model.responses(rows[used], at, cut), cut) @ model.weight + model.bias)
    z, lang, toxic = np.concatenate(parts), lang[chosen], toxic[chosen]
    common = best_threshold(z, toxic)
    for k in range(len(LANGUAGES)):
        own = lang == k
        few = min(int((own & toxic).sum()), int((own & ~toxic).sum()))
        model.shift[k] = best_threshold(z[own], toxic[own]) if few >= 10 else common


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, text, label, fold of at most ``per_class`` labelled texts of each kind, held-out rows excluded."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("label"))
    place = F.xxhash64(F.lit(3), F.col("doc_id"))
    chosen = known.where("label = 1").orderBy(place, "doc_id").limit(per_class).union(known.where("label = 0").orderBy(place, "doc_id").limit(per_class))
    chosen = materialize(chosen.withColumn("fold", F.crc32(F.col("doc_id").cast("string").cast("binary")) % (FOLD * CALIBRATION)), "labelled")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 2 * per_class rows at most


def fitted(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model | None:
    rows = sample(docs, labels, "toxic", per_class).dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow().combine_chunks()
    toxic = rows.column("label").to_numpy() == 1
    if toxic.all() or not toxic.any():
        return None
    model = train(rows.column("text").combine_chunks(), toxic, rows.column("fold").to_numpy() % FOLD == 1)
    del rows
    pa.default_memory_pool().release_unused()  # the sample's texts aren't needed any more
    return model


def scored(docs: DataFrame, model: Model | None, columns: list[str], names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``columns`` of ``docs`` with a score and a prediction under ``names``."""
    if model is None:
        return docs.select(*columns, F.lit(0.0).alias(names[0]), F.lit(0).alias(names[1]))
    held = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select(*columns).schema.add(names[0], "double").add(names[1], "integer")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                score = held.value.scores(*text_buffer(part.column("text")))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*columns, *names])

    return docs.select(*dict.fromkeys([*columns, "text"])).mapInArrow(run, out)


def score(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted per row of ``docs``."""
    marked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return scored(marked, fitted(docs, labels, per_class), ["doc_id", "held_out"])
