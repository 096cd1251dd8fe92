"""Scores and marks against loops that follow their definitions."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshloom.llm import brown, quality, simhash, textops, toxicity
from test_operators import SCHEMA, corpus, docs, key, labelled, none, word_list  # noqa: F401  fixtures


def text_words(text, member=textops.IS_WORD, prefixes=()):
    """Hashes of one text's words, in order."""
    return textops.words(*textops.text_buffer(pa.array([text], pa.string())), member, prefixes)[2]


def test_toxicity_scores_are_the_network_word_by_word(labelled):
    rows, labels = labelled
    model = toxicity.fitted(rows, labels)
    got = {r.doc_id: r.score for r in toxicity.score(rows, labels).collect()}
    for r in rows.where("doc_id < 40 or doc_id >= 1000").collect():
        data, at = textops.text_buffer(pa.array([r.text], pa.string()))
        found, seq, _ = toxicity.features(data, at)
        vectors = [model.embedding[found[w]].sum(0) for w in seq]
        pooled = []
        for k, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                windows = [sum(float(vectors[p + j] @ model.filters[k][j][:, f]) for j in range(width)) for p in range(len(vectors) - width + 1)]
                pooled.append(max(0.0, max(windows, default=-math.inf) + float(model.filter_bias[k * toxicity.FILTERS + f])))
        z = sum(a * float(b) for a, b in zip(pooled, model.weight, strict=True)) + model.bias - model.shift[toxicity.languages(data, at)[0]]
        assert got[r.doc_id] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-4), r.doc_id


def test_toxicity_of_repeated_and_long_rows(labelled, spark):
    """Equal texts have equal scores whatever stands beside them; a long text is read to its end."""
    rows, labels = labelled
    model = toxicity.fitted(rows, labels)
    quiet = "the of and to in " * 60_000
    more = [(1, quiet, 5), (2, quiet + " moron scum idiotic! scum moron", 5), (2, quiet, 6), (None, quiet, 7), (2, quiet, 6)]
    got = toxicity.scored(spark.createDataFrame(more, "doc_id long, text string, _toxic int"), model, ["doc_id", "_toxic"]).collect()
    same = {r.score for r in got if not (r.doc_id == 2 and r["_toxic"] == 5)}
    assert len(got) == 5 and len(same) == 1 and max(same) < 0.5 < next(r.score for r in got if r.doc_id == 2 and r["_toxic"] == 5)


def test_language_model_scores_token_by_token(spark, docs):
    marked = docs.select("doc_id", brown.held_out(F.col("doc_id")).alias("held_out"), "text")
    training = marked.where("not held_out")
    counts = brown.word_counts(training).persist()
    core = brown.fit(training, counts, 12, 4, 40)
    others = brown.assigned(training, core).persist()
    model = brown.classed(training, others, core)
    m = len(model.norm)
    emission = {int(w): float(e) for w, e in zip(model.listed.view("int64")[:12], model.emission[:12], strict=True)}
    own = {int(w): int(c) for w, c in zip(model.listed.view("int64")[:12], model.classes[:12], strict=True)}
    for r in others.collect():
        own[r.word] = r["class"]
        emission[r.word] = math.log10(r.c - model.discount) + model.norm[r["class"]]
    got = sorted((r.doc_id or -1, round(r.score, 5)) for r in brown.score(docs, 12, 4, 40).collect())
    want = []
    for r in marked.collect():
        total, before = 0.0, m
        for h in text_words(r.text).view("int64").tolist():
            here = own.get(h, m + 1)
            total += model.transition[before, here] + emission.get(h, 0.0)
            before = here
        want.append((r.doc_id or -1, round(total + model.transition[before, m], 5)))
    for (a, x), (b, y) in zip(got, sorted(want), strict=True):
        assert a == b and x == pytest.approx(y, abs=1e-4)


def mark(text):
    """The fingerprint by votes, a bit at a time."""
    h = [int(x) for x in text_words(text)]
    if not h:
        return bytes(simhash.BITS // 8)
    one = lambda x: int(textops.mixed(np.array([x & (2**64 - 1)], np.uint64))[0])
    a, b = (int(x) for x in simhash._PAIR)
    terms = [one(x * a + y * b) for x, y in zip(h, h[1:], strict=False)] if len(h) > 1 else h
    votes = [0] * simhash.BITS
    for term, count in collections.Counter(terms).items():
        weight = int(math.log2(count)) + 1
        for lane, salt in enumerate(simhash._LANES):
            for byte, x in enumerate(one(term + int(salt)).to_bytes(8, "little")):
                for bit in range(8):
                    votes[64 * lane + 8 * byte + bit] += weight if x >> (7 - bit) & 1 else -weight
    return bytes(sum((votes[8 * k + bit] > 0) << (7 - bit) for bit in range(8)) for k in range(simhash.BITS // 8))


def test_fingerprints_and_likenesses_by_votes(docs):
    order = sorted([r for r in corpus() if len(r[1] or "") < 5000], key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [r[1] or "" for r in order]
    alike = lambda x, y: 1 - sum((a ^ b).bit_count() for a, b in zip(x, y, strict=True)) / simhash.BITS
    want = []
    for r, t, n in zip(order, texts, texts[1:] + texts[:1], strict=True):
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        mine, changed = mark(t), mark(edited)
        want.append((r[0], len(t), hashlib.sha256(edited.encode()).hexdigest(), mine.hex(), changed.hex(), alike(mine, changed), alike(mine, mark(n))))
    got = simhash.with_edits(docs.where(F.coalesce(F.length("text"), F.lit(0)) < 5000)).collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_posteriors_by_hand(spark):
    rng = np.random.default_rng(8)
    rows = [(f"h{h}" if h else None, f"p{p}", float(rng.normal(h - 2, 2)), [None, 0, 1][int(rng.integers(0, 3))]) for h in range(5) for p in range(3) for _ in range(int(rng.integers(1, 30)))]
    got = {(r.host, r.path): r for r in quality.sites(spark.createDataFrame(rows, "host string, path string, evidence double, label int")).collect()}
    n, good = collections.Counter(), collections.Counter()
    for host, path, z, label in rows:
        w = 1.0 if label is not None else quality.SOFT
        n[host, path] += w
        good[host, path] += w * (label if label is not None else 1 / (1 + math.exp(-z)))
    hn, hgood = collections.Counter(), collections.Counter()
    for (host, path), x in n.items():
        hn[host] += x
        hgood[host] += good[host, path]
    overall = sum(hgood.values()) / sum(hn.values())

    def strength(groups, mean):
        total = sum(groups.values())
        spread = sum(x * (rates[g] - mean(g)) ** 2 for g, x in groups.items()) / total
        noise = sum(mean(g) * (1 - mean(g)) for g in groups) / total
        inner = sum(mean(g) * (1 - mean(g)) for g in groups) / len(groups)
        return min(quality.MOST, max(quality.LEAST, inner / max(spread - noise, 1e-9) - 1))

    rates = {h: hgood[h] / hn[h] for h in hn}
    k_host = strength(hn, lambda _: overall)
    host_rate = {h: (hgood[h] + k_host * overall) / (hn[h] + k_host) for h in hn}
    rates = {g: good[g] / n[g] for g in n}
    k_path = strength(n, lambda g: host_rate[g[0]])
    assert set(got) == set(n)
    for g, r in got.items():
        assert r.global_rate == pytest.approx(overall) and r.host_rate == pytest.approx(host_rate[g[0]])
        assert r.path_rate == pytest.approx((good[g] + k_path * host_rate[g[0]]) / (n[g] + k_path))


def test_quality_scores_by_hand(labelled):
    """A document's log odds are its evidence, moved by those of its path against the global rate."""
    rows, labels = labelled
    logit = lambda p: math.log(p / (1 - p))
    found = quality.score(rows, labels, F.col("source"), F.col("lang")).collect()
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % quality_fold() != 0}
    n, good = collections.Counter(), collections.Counter()
    for r in found:
        label = known.get(r.doc_id)
        w = 1.0 if label is not None else quality.SOFT
        n[0] += w
        good[0] += w * (label if label is not None else 1 / (1 + math.exp(-r.evidence)))
    overall = good[0] / n[0]
    for r in found:
        assert r.score == pytest.approx(1 / (1 + math.exp(-(r.evidence + logit(r.path_rate) - logit(overall)))), abs=1e-6)
        assert r.keep == (r.score >= 0.5)


def quality_fold():
    return toxicity.FOLD
