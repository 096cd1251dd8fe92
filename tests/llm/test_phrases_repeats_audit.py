"""Collocations, repeated passages and the filter audit against brute force; links of hot keys across files."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.llm import collocations, filter_audit, jaccard, suffixes
from meshloom.llm.queries import QUERIES
from test_operators import SCHEMA, corpus, key


def folded(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute_collocations(rows, least, longest, top, covered):
    """rows: (lang, text)."""
    count, total = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for n in range(1, longest + 1):
                count[lang].update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    out = []
    for lang, f in count.items():
        cands = {}
        for g, a in f.items():
            if len(g) > 1 and a >= least:
                cuts = [(2000000 * a // (f[g[:k]] + f[g[k:]]), k) for k in range(1, len(g))]
                score, k = min(cuts)
                cands[g] = (score, a, f[g[:k]], f[g[k:]])
        inside = collections.Counter()
        for g in cands:
            for n in range(2, len(g)):
                for i in range(len(g) - n + 1):
                    inside[g[i : i + n]] = max(inside[g[i : i + n]], cands[g][1])
        kept = [(-s, -a, " ".join(g).encode(), left, r) for g, (s, a, left, r) in cands.items() if 100 * inside[g] < covered * a]
        out += [(lang, i + 1, p.decode(), -a, left, r, total[lang], -s) for i, (s, a, p, left, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(3)
    vocabulary = ["The", "the", "of", "New", "York", "é", "Ünï", "x.y", "in,", "state!", "a\tb", "end\r\n", "über", "?!", "no"]
    rows = [(i, " ".join(rng.choice(vocabulary) + (" City of New York" if rng.random() < 0.1 else "") for _ in range(rng.randrange(0, 60))), rng.choice(["en", "en", "de", None, "und"])) for i in range(300)]
    return [*rows, (1, None, "en"), (None, "", None), (7, "word " * 40_000, "en"), (8, " \t\n.", "fr"), (9, "z" * 200_000, "en")]


@pytest.mark.parametrize(("least", "top", "covered"), [(30, 2000, 80), (3, 7, 50), (300, 100, 100)])
def test_collocations_equal_brute_force(spark, prose, least, top, covered):
    df = spark.createDataFrame([(*r, 1, "n") for r in prose], "doc_id long, text string, lang string, k long, phrase string").repartition(3)
    got = collocations.collocations(df, least=least, top=top, covered=covered).collect()
    assert sorted(map(tuple, got)) == brute_collocations([(r[2], r[1]) for r in prose], least, 4, top, covered)
    assert got and collocations.collocations(df.limit(0)).count() == 0


def test_a_full_sketch_loses_nothing(spark, prose, monkeypatch):
    """With far too few counters nearly all n-grams are counted exactly, with the same result."""
    monkeypatch.setattr(collocations, "MOST_CELLS", 1 << 4)
    df = spark.createDataFrame(prose, "doc_id long, text string, lang string").repartition(2)
    got = collocations.collocations(df, least=5).collect()
    assert sorted(map(tuple, got)) == brute_collocations([(r[2], r[1]) for r in prose], 5, 4, 2000, 80)


def test_sketches_never_undercount(spark, prose):
    texts = spark.createDataFrame(prose, "doc_id long, text string, lang string").select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").repartition(4)
    seen = collocations.Seen([collocations.sketched(texts, [1, 2], 12, 30, [])])
    exact = collections.Counter()
    names = {}
    import pyarrow as pa

    grams = collocations.Grams(pa.RecordBatch.from_pylist([{"lang": r[2] or "und", "text": r[1]} for r in prose], pa.schema([("lang", pa.string()), ("text", pa.string())])))
    for n in (1, 2):
        _, h = grams.names(n)
        exact.update(h.tolist())
        names[n] = h
    for n in (1, 2):
        passed = set(names[n][seen._may(names[n], n)].tolist())
        assert all(h in passed for h in names[n].tolist() if exact[h] >= 30)


def brute_repeats(texts, length):
    held = [(t or "").encode() for t in texts]
    count = collections.Counter(x[i : i + length] for x in held for i in range(len(x) - length + 1))
    out = []
    for x in held:
        gone = np.zeros(len(x), bool)
        for i in range(len(x) - length + 1):
            if count[x[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(x) else 0
        kept = np.frombuffer(x, np.uint8)[~gone].tobytes()
        out.append((len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize(("length", "kind"), [(8, 0), (40, 1), (120, 2), (400, 0), (400, 1)])
def test_repeats_equal_brute_force(spark, length, kind):
    """Passages cut at any place, low entropy, multi-byte characters, copies, null and repeated ids, nulls, empty texts."""
    r = random.Random(length + kind)
    syllables = [["é", "a", "b", "cc", "d ", "\n"], [f"{i} " for i in range(300)], ["ab", "ab", "ab", "ba"]][kind]
    some = lambda n: "".join(r.choice(syllables) for _ in range(n))
    passages = [some(r.randrange(length // 2, 2 * length)) for _ in range(6)]
    texts = ["".join(r.choice(passages)[: r.randrange(1, 3 * length)] if r.random() < 0.5 else some(r.randrange(1, length)) for _ in range(r.randrange(1, 7))) for _ in range(60)]
    texts += [None, "", None, "x" * (3 * length), texts[0], texts[0], texts[1] + "q", "ab" * (2 * length), texts[3][:-5]]
    df = spark.createDataFrame([(i if i % 7 else None, t, "clash", 5) for i, t in enumerate(texts)], "doc_id long, text string, lo string, at1 int").repartition(3)
    got = suffixes.without_repeats(df, length=length, kinds_of_core=1 if length == 40 else suffixes.KINDS)
    rows = sorted(((x.doc_id, x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got.collect()), key=key)
    assert rows == sorted(((i if i % 7 else None, *x) for i, x in enumerate(brute_repeats(texts, length))), key=key)
    assert all(sum(b - a for a, b in zip(x.starts, x.ends, strict=True)) == x.n_removed for x in got.collect())


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 300)
    r = random.Random(1)
    some = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    shared = some(700)
    texts = [some(900) + shared + some(200), some(333) + shared, some(2000), shared[:399], shared[100:500]]
    assert [len(list(suffixes.Sampler(100).pieces(np.zeros(n, np.uint8), np.array([0, n])))) for n in (99, 100, 300, 301)] == [0, 1, 1, 1]
    assert len(list(suffixes.Sampler(100).pieces(np.zeros(1000, np.uint8), np.array([0, 1000])))) == 4
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for kinds in (suffixes.KINDS, 1):  # many kinds of cells with one core are ranked string by string
        got = [tuple(x)[1:5] for x in suffixes.without_repeats(df, length=100, kinds_of_core=kinds).orderBy("doc_id").collect()]
        assert got == brute_repeats(texts, 100)


def test_repeats_of_hard_rows_and_empty_tables(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((tuple(x)[:5] for x in suffixes.without_repeats(df).collect()), key=key)
    assert got == sorted(((r[0], *x) for r, x in zip(rows, brute_repeats([r[1] for r in rows], 400), strict=True)), key=key)
    assert suffixes.without_repeats(df.limit(0)).count() == 0


def test_the_query_over_whole_documents_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    got = sorted(tuple(x) for x in QUERIES["op12_suffix_dedup"](spark, folder).collect())
    assert got == sorted((r.doc_id, *x) for r, x in zip(docs, brute_repeats([r.text for r in docs], 400), strict=True))
    assert any(x[2] for x in got)


def brute_audit(docs, labels):
    good, toxic = {i for i, q, _ in labels if i is not None and q == 1}, {i for i, _, t in labels if i is not None and t == 1}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    parts = collections.defaultdict(list)
    for i, text, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        parts[source or ""].append(({k for k, v in fails.items() if v}, i in good, i in toxic))
    out, shapley = [], collections.Counter()
    for part, rows in parts.items():
        for order in map("".join, itertools.permutations("ABCDE")):
            left = rows
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[0]]
                left = [r for r in left if f not in r[0]]
                shapley[part, f] += len(gone)
                total = sum(f in r[0] for r in rows)
                out.append((part, order, step, len(left), len(gone), total - len(gone), sum(r[0] == {f} for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone)))
    return sorted((*x, shapley[x[0], x[1][x[2] - 1]]) for x in out)


def test_audit_equals_running_every_order(spark):
    rng = random.Random(5)
    texts = ["", None, "word " * 250, "Word# " * 3, " ".join(f"w{i}" for i in range(300)), " ".join(f"W{i}" for i in range(300)), "é $ " * 250, "A\u000bB\u001cC", " ".join(f"w{i}" for i in range(300)) + " |", "x" * 50_000]
    docs = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice(["web", "web", None, "", "books"])) for _ in range(120)]
    labels = [(rng.choice([None, *range(50)]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)]
    d = spark.createDataFrame([(*x, 1, "clash", 9) for x in docs], "doc_id long, text string, source string, good int, part string, n long").repartition(3)
    known = spark.createDataFrame([(*x, 4) for x in labels], "doc_id long, quality int, toxic int, mask int")
    got = filter_audit.audit(d, known)
    assert sorted(map(tuple, got.collect())) == brute_audit(docs, labels)
    assert filter_audit.audit(d.limit(0), known).count() == 0
    assert filter_audit.audit(d, known.limit(0)).where("good_lost > 0 or toxic_lost > 0").count() == 0


@pytest.mark.parametrize("files", [1, 2])
def test_links_of_hot_keys_cross_runs(spark, tmp_path, files):
    """Templates of two kinds in one file, a lone text of the first kind in the other: the kind's block is posted by a set of the other kind."""
    first, second, want = [], [], {}
    for t in (0, 1, 4, 7, 11):
        r = random.Random(t)
        new = lambda n, r=r: [f"w{r.randrange(10**9)}" for _ in range(n)]
        p = r.choice([40, 60, 84, 110, 140])
        head, q, s = new(p), new(204 - p), new(204 - p)
        for kind, tail in ((0, q), (1, s)):
            for k in range(300):
                i = 10_000 * t + 1000 * kind + k
                first.append((i, " ".join(head + tail + new(2))))
                want[i] = 10_000 * t + 1000 * kind
        second.append((10_000 * t + 5000, " ".join(head + q + new(2))))
        want[10_000 * t + 5000] = 10_000 * t
        second.append((10_000 * t + 6000, " ".join(new(80))))
        want[10_000 * t + 6000] = 10_000 * t + 6000
    tables = [first, second] if files == 2 else [first + second]
    for k, rows in enumerate(tables):
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/{k}")
    docs = spark.read.parquet(*[f"{tmp_path}/{k}" for k in range(len(tables))])
    assert docs.rdd.getNumPartitions() == files
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()}
    assert got == want


def test_marked_sets_make_their_keys_blocks():
    keys = np.array([5, 5, 5, 9, 9], np.uint64) << np.uint64(30)
    k, s, blocks = jaccard._shared(keys, np.array([1, 2, 3, 1, 4]), 2)
    assert (s < 0).sum() == 1 and [sorted(b.tolist()) for b in blocks] == [[1, 2, 3]]
    import pyarrow as pa

    other = jaccard._pack(keys[:1], np.array([8]), 0)
    met = jaccard._meet(pa.table({"payload": [jaccard._pack(k, s, 0), other, *map(jaccard._pack_block, blocks)]})).to_pylist()
    rooted = {(r["sig"], r["root"]) for r in met if r["root"] is not None}
    assert {1, 2, 3, 8} == {a for a, _ in rooted} and {r["sig"] for r in met if r["root"] is None} == {1, 4}
