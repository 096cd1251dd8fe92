"""Quality: document evidence and site posteriors by hierarchical empirical Bayes.

A small network over shape statistics of the whole text gives each document's
evidence.  Sites are hosts with paths below them.  A host's rate of good
documents is a Beta posterior around the global rate and a path's is one around
its host's; the strengths of both priors are estimated from the spread of the
groups themselves, so sparse sites shrink towards what stands above them.  Labels
count fully, unlabelled documents by ``SOFT`` of their evidence.  A document's
score adds the site's log odds, relative to the global ones, to its evidence.

Site figures are grouped sums over all documents.  The network is fitted on a
bounded sample (``PER_CLASS`` labelled texts of each kind).

Defined results: null and empty texts have the evidence of a text without words;
null hosts and paths are sites of their own; without labels of both kinds the
evidence is even; labels of a document that disagree count as good; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize
from .textops import IS_WORD, slices, text_buffer, words
from .toxicity import held_out, runs, sample

PER_CLASS, HIDDEN, EPOCHS, BATCH, SEED = 3000, 16, 60, 64, 3
SOFT, LEAST, MOST = 0.25, 2.0, 1e4
IS_LINE = np.ones(256, bool)
IS_LINE[[10, 13]] = False
_UPPER, _DIGIT, _MARK = np.zeros(256), np.zeros(256), np.zeros(256)
_UPPER[65:91] = 1
_DIGIT[48:58] = 1
_MARK[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,;:'\"-()?"]] = 1


def _share(on: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(on)))
    return (total[at[1:]] - total[at[:-1]]) / np.maximum(np.diff(at), 1)


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, 12) shape statistics."""
    start, end, h, offsets = words(data, at)
    n = np.diff(offsets)
    size = (end - start).astype(float)
    again = np.zeros(len(h))
    if len(h) > 1:
        again[1:] = h[1:] == h[:-1]
    _, _, lines, line_at = words(data, at, IS_LINE)
    out = np.zeros((len(n), 12))
    out[:, 0] = np.log1p(n)
    out[:, 1] = _share(size, offsets)
    out[:, 2] = _share((size <= 3).astype(float), offsets)
    out[:, 3] = _share(again, offsets)
    for k, table in enumerate((_UPPER, _DIGIT, _MARK), 4):
        out[:, k] = _share(table[data], at)
    out[:, 7] = _share((data == 10).astype(float), at) * 100
    out[:, 8] = _share((~IS_WORD[data]).astype(float), at)
    for i, (a, b, c, d) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), line_at[:-1].tolist(), line_at[1:].tolist(), strict=True)):
        if b > a:
            _, k = np.unique(h[a:b], return_counts=True)
            out[i, 9], out[i, 10] = len(k) / (b - a), k.max() / (b - a)
        if d > c:
            out[i, 11] = len(np.unique(lines[c:d])) / (d - c)
    return out


@dataclass
class Network:
    mean: np.ndarray
    spread: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    bias: float

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log odds of a good text."""
        return np.tanh((x - self.mean) / self.spread @ self.inner + self.inner_bias) @ self.outer + self.bias


def train(x: np.ndarray, good: np.ndarray, prior: float) -> Network:
    """Adam on the log loss; the bias is then moved from the sample's mixture to ``prior``."""
    rng = np.random.default_rng(SEED)
    net = Network(x.mean(0), x.std(0) + 1e-6, rng.normal(0, 0.3, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), 0.0)
    z = (x - net.mean) / net.spread
    values = [net.inner, net.inner_bias, net.outer, np.zeros(1)]
    first, second, t = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for b in range(0, len(x), BATCH):
            k = order[b : b + BATCH]
            hidden = np.tanh(z[k] @ values[0] + values[1])
            p = 1 / (1 + np.exp(-(hidden @ values[2] + values[3])))
            g = (p - good[k]) / len(k)
            back = np.outer(g, values[2]) * (1 - hidden**2)
            grads = [z[k].T @ back + 1e-4 * values[0], back.sum(0), hidden.T @ g + 1e-4 * values[2], np.array([g.sum()])]
            t += 1
            for v, a, s, grad in zip(values, first, second, grads, strict=True):
                a += 0.1 * (grad - a)
                s += 0.001 * (grad * grad - s)
                v -= 0.01 * (a / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    share = good.mean()
    net.bias = float(values[3][0]) + np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return net


def fitted(docs: DataFrame, labels: DataFrame) -> Network | None:
    rows = sample(docs, labels, "quality", PER_CLASS).dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow()
    good = (rows.column("label").to_numpy() == 1).astype(float)
    if not 0 < good.sum() < len(good):
        return None
    usable = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id")))
    prior = usable.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    x = np.concatenate([statistics(*run) for run in runs(rows.column("text").combine_chunks())])
    return train(x, good, min(max(prior, 1e-4), 1 - 1e-4))


def document_evidence(docs: DataFrame, net: Network | None, host: Column, path: Column) -> DataFrame:
    """doc_id, host, path, evidence."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                net = sent.value
                found = net.evidence(statistics(*text_buffer(part.column("text")))) if net else np.zeros(part.num_rows)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "host", "path")), pa.array(found)], ["doc_id", "host", "path", "evidence"])

    return docs.select("doc_id", host.cast("string").alias("host"), path.cast("string").alias("path"), "text").mapInArrow(run, "doc_id long, host string, path string, evidence double")


def strength(groups: DataFrame, n: str, good: str, mean: Column) -> Column:
    """Prior strength from the spread of group rates around ``mean``, by moments: an aggregate expression."""
    rate = F.col(good) / F.col(n)
    spread = F.sum(F.col(n) * (rate - mean) ** 2) / F.sum(n)
    noise = F.sum(mean * (1 - mean)) / F.sum(n)
    between = F.greatest(spread - noise, F.lit(1e-9))
    return F.least(F.lit(MOST), F.greatest(F.lit(LEAST), F.avg(mean * (1 - mean)) / between - 1))


def sites(found: DataFrame) -> DataFrame:
    """host, path, global_rate, host_rate, path_rate from rows with host, path, evidence and label (0, 1 or null)."""
    p = 1 / (1 + F.exp(-F.col("evidence")))
    weight = F.when(F.col("label").isNull(), SOFT).otherwise(1.0)
    paths = found.groupBy("host", "path").agg(F.sum(weight).alias("n"), F.sum(weight * F.coalesce(F.col("label").cast("double"), p)).alias("good"))
    paths = materialize(paths, "quality-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("good").alias("hgood"))
    total = hosts.agg((F.sum("hgood") / F.sum("hn")).alias("global_rate"))
    with_mean = hosts.crossJoin(F.broadcast(total))  # one row
    k_host = with_mean.agg(strength(with_mean, "hn", "hgood", F.col("global_rate")).alias("k_host"))
    rated = with_mean.crossJoin(F.broadcast(k_host)).select("host", "global_rate", ((F.col("hgood") + F.col("k_host") * F.col("global_rate")) / (F.col("hn") + F.col("k_host"))).alias("host_rate"))
    rated = materialize(rated, "quality-hosts")
    a, b = paths.alias("a"), rated.alias("b")
    joined = a.join(b, F.col("a.host").eqNullSafe(F.col("b.host"))).select("a.*", "b.global_rate", "b.host_rate")
    k_path = joined.agg(strength(joined, "n", "good", F.col("host_rate")).alias("k_path"))
    return materialize(
        joined.crossJoin(F.broadcast(k_path)).select("host", "path", "global_rate", "host_rate", ((F.col("good") + F.col("k_path") * F.col("host_rate")) / (F.col("n") + F.col("k_path"))).alias("path_rate")), "quality-sites"
    )


def score(docs: DataFrame, labels: DataFrame, host: Column, path: Column) -> DataFrame:
    """doc_id, held_out, host, path, evidence, host_rate, path_rate, score, keep per row of ``docs``."""
    own = materialize(document_evidence(docs, fitted(docs, labels), host, path), "quality-evidence")
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("label"))
    rated = sites(own.join(known, "doc_id", "left"))
    odds = lambda c: F.log(F.col(c)) - F.log(1 - F.col(c))
    a, b = own.alias("a"), rated.alias("b")
    joined = a.join(b, F.col("a.host").eqNullSafe(F.col("b.host")) & F.col("a.path").eqNullSafe(F.col("b.path"))).select("a.*", "b.global_rate", "b.host_rate", "b.path_rate")
    final = F.when(F.col("path_rate").between(1e-9, 1 - 1e-9) & F.col("global_rate").between(1e-9, 1 - 1e-9), F.col("evidence") + odds("path_rate") - odds("global_rate")).otherwise(F.col("evidence"))
    chance = 1 / (1 + F.exp(-final))
    return joined.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "host", "path", "evidence", "host_rate", "path_rate", chance.alias("score"), (chance >= 0.5).alias("keep"))
