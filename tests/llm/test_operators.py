"""Every operator over small tables: hard rows, empty tables and brute force."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from meshloom.llm import brown, components, decontam, jaccard, mixing, quality, sharding, simhash, textops, tokens, toxicity, warc
from meshloom.llm.queries import word_vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, row string, part int"
WORDS = "the of and to in that it is was for on are with as his they be at one have this from".split()


def sentence(rng, n):
    return " ".join(WORDS[i] + str(rng.integers(0, 60)) for i in rng.integers(0, len(WORDS), n))


def corpus():
    """Nulls in every column, empty and long texts, ties, repeated rows, near copies; extra columns have clashing names."""
    rng = np.random.default_rng(7)
    texts = [sentence(rng, int(n)) for n in rng.integers(1, 120, 40)]
    rows = [(i, t, "en", f"src{i % 3}") for i, t in enumerate(texts)]
    long = sentence(rng, 30_000)
    rows += [(40, None, None, None), (41, "", "en", None), (42, "  \n\t ", "fr", "src1"), (None, texts[3], "en", "src0"), (43, long, "en", "src0"), (44, long + " end", "en", "src2")]
    rows += [(45, texts[5], "en", "src1"), (46, texts[5], "en", "src1"), (47, texts[6] + " more", "de", "src2"), (7, texts[7], "en", "src1"), (7, texts[7], "en", "src1")]
    rows += [(50, "One two three four", "en", "src0"), (51, "one TWO three four", "en", "src0"), (52, "x" * 100_000, "en", "src1")]
    return [(a, b, c, d, None if b is None else len(b), -1, 0.5, "clash", 3) for a, b, c, d in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


def word_list(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower() if (text or "").isascii() else (text or "").encode())


def shingles(text):
    w = word_list(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def linked_groups(rows):
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = [shingles(r[1]) for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return sets, [find(i) for i in range(len(rows))]


@pytest.mark.parametrize(("chunk", "group", "shared"), [(jaccard.CHUNK, jaccard.GROUP, jaccard.SHARED), (2, jaccard.GROUP, jaccard.SHARED), (jaccard.CHUNK, 2, jaccard.SHARED), (3, 2, 2)])
def test_jaccard_equals_brute_force(spark, chunk, group, shared):
    """With chunks, groups and runs of two sets the ways of large blocks, crowded groups and hot keys are taken."""
    rng = np.random.default_rng(3)
    rows = corpus()
    for base in range(3):
        words = sentence(rng, 80).split()
        for k in range(6):
            changed = list(words)
            for _ in range(k):
                changed[int(rng.integers(0, 80))] = f"new{rng.integers(0, 999)}"
            rows.append((100 + 10 * base + k, " ".join(changed), "en", "s", 1, 0, 0.0, "", 0))
    tail = sentence(rng, 12)
    rows += [(200 + k, sentence(rng, 4) + " " + tail, "en", "s", 1, 0, 0.0, "", 0) for k in range(8)]  # a passage that unlike texts share
    bridge = sentence(rng, 100).split()  # rows without an id: one joins two others, two are near each other only
    rows += [(300, " ".join(bridge), "en", "s", 1, 0, 0.0, "", 0), (301, " ".join(bridge[:88]), "en", "s", 1, 0, 0.0, "", 0), (302, " ".join(bridge[12:]), "en", "s", 1, 0, 0.0, "", 0), (None, " ".join(bridge[6:94]), "en", "s", 1, 0, 0.0, "", 0)]
    alone = sentence(rng, 60)
    rows += [(None, alone, "en", "s", 1, 0, 0.0, "", 0), (None, alone + " end", "en", "s", 1, 0, 0.0, "", 0), (None, alone, "en", "s", 1, 0, 0.0, "", 0)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA), chunk=chunk, group=group, shared=shared).select("doc_id", "n_shingles", "component_id").collect()
    sets, group = linked_groups(rows)
    least = {}
    for r, g in zip(rows, group, strict=True):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    want = [(r[0], len(s), least.get(g) if s else r[0]) for r, s, g in zip(rows, sets, group, strict=True)]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def bench_words(text):
    folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def test_decontamination_equals_brute_force(spark, docs, none):
    rng = np.random.default_rng(5)
    passage = "Alpha beta gamma Él señor delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    items = [(1, passage), (2, "short one here"), (10, None), (3, ""), (4, "ÉL Señor"), (5, sentence(rng, 20).replace("1", "q")), (2, "short one here")]
    more = [
        (200, "x " + passage.upper().replace("É", "É").replace("SEÑOR", "señor") + " y", "en", "s", 1, 0, 0.0, "", 0), (201, passage.lower(), "en", "s", 1, 0, 0.0, "", 0), (202, "SHORT, one: here! short one here " * 3, "en", "s", 1, 0, 0.0, "", 0),
        (203, "ÉL Señor él señor", "en", "s", 1, 0, 0.0, "", 0), (204, " ".join(passage.split()[2:]) + " tail" * 900, "en", "s", 1, 0, 0.0, "", 0), (202, "short one here", "en", "s", 1, 0, 0.0, "", 0),
    ]
    every = docs.union(spark.createDataFrame(more, SCHEMA))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(every, bench).drop("row").collect()
    windows = collections.defaultdict(set)
    for item, text in items:
        w = bench_words(text)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(item)
    want = []
    for r in [*corpus(), *more]:
        w = bench_words(r[1])
        hit, found = set(), set()
        for win, its in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found |= its
        names = ",".join(sorted(map(str, found)))
        want.append((r[0], len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert decontam.contamination(none, bench).count() == 0
    assert decontam.contamination(docs, bench.limit(0)).where("n_hit > 0 or contaminated").count() == 0


def test_proximity(spark):
    rows = [(1, "alpha x x beta", None, None, 0, 0, 0.0, "", 0), (2, "beta " + "x " * 9 + "alpha", None, None, 0, 0, 0.0, "", 0)]
    pairs = spark.createDataFrame([(5, "alpha", "beta")], "item_id long, term1 string, term2 string")
    d = decontam.numbered(spark.createDataFrame(rows, SCHEMA))
    assert [tuple(r) for r in decontam.proximity_matches(d, pairs, 3).select("doc_id", "pos1", "pos2").collect()] == [(1, 0, 3)]
    assert decontam.proximity_matches(d, pairs, 10).count() == 2


def test_mixing_meets_targets(docs, none):
    got = mixing.mix(docs, block_words=4, shard_words=500).collect()
    rows = corpus()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(word_list(r[1]))
    order = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, open_, target = sum(sizes.values()), set(order), {}
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * sizes[s]
        open_ -= set(over)
    assert len(got) == len(rows)
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 4 * 80 + 4
    again = mixing.mix(docs.repartition(5), block_words=4, shard_words=500).collect()
    view = lambda rs: sorted(((r.doc_id, r["size"], r.taken) for r in rs), key=key)
    assert view(again) == view(got)
    assert mixing.mix(none).count() == 0


def sainte_lague(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        i = max(range(len(votes)), key=lambda k: (votes[k] / (2 * won[k] + 1), -k))
        won[i] += 1
    return won


@pytest.mark.parametrize("seats", [0, 1, 3, 17, 200])
def test_apportionment_equals_the_rule(spark, seats):
    votes = [53, 24, 23, 0, 7, 7, 1, 190]
    df = spark.createDataFrame([(i, float(v), seats) for i, v in enumerate(votes)], "p int, v double, s long")
    got = {r.p: r.n for r in mixing.sainte_lague(df, "v", "s", ["p"], [], "n").collect()}
    assert [got[i] for i in range(len(votes))] == sainte_lague(votes, seats)


def test_sharding(docs, none):
    got = sharding.shard(docs).collect()
    rows = corpus()
    want = [(r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows]
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=key) == sorted(want, key=key)
    slots = collections.defaultdict(list)
    for r in got:
        assert 0 <= r.shard < 24 and r.law == "bytes" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard(none).count() == 0


def test_sharding_splits_only_what_fits_no_shard(spark):
    rows = [(i, "same text " * 40) for i in range(600)] + [(1000 + i, f"other {i} " * 40) for i in range(900)] + [(3000 + i, f"pair {i // 2} " * 40) for i in range(300)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("slot").alias("m")).collect()
    loads = [r.b for r in got]
    assert len(got) == 24 and max(loads) < 1.05 * min(loads) and all(r.m == r.n - 1 for r in got)
    pairs = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id >= 3000").groupBy("text_crc32").agg(F.countDistinct("shard").alias("k"))
    assert pairs.where("k > 1").count() == 0


def test_token_files(docs, none, spark):
    path, n = word_vocabulary()
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    got = [tuple(r) for r in tokens.round_trip(docs, path, n).collect()]
    want, start = [], 0
    for r in sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert tokens.round_trip(none, path, n).count() == 0


PAGES = "page_id long, url string, html string, refers_to long"


def test_warc(spark):
    rows = [(1, "http://a", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "v\nw", "é" * 50_000), (6, "w", "<p>x</p>"), (6, "w", "<p>x</p>"), (None, "n", "null id"), (8, "z", "a\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame([(*r, 77) for r in rows], PAGES)
    got = sorted((tuple(r) for r in warc.round_trip(df).collect()), key=key)
    keep = {}
    for p, _, h in rows:
        if p is not None:
            keep[h or ""] = max(keep.get(h or "", p), p)
    want = []
    for p, _, h in rows:
        b = (h or "").encode()
        again = p is not None and keep[h or ""] != p
        want.append((p, len(b), warc.digest(b), "revisit" if again else "response", keep[h or ""] if again else None))
    assert got == sorted(want, key=key)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_simhash_edits(docs, none, spark):
    got = [tuple(r)[:3] for r in simhash.with_edits(docs).collect()]
    order = sorted(corpus(), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    texts = [r[1] or "" for r in order]
    want = [(r[0], len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + n[: len(t) // 2]).encode()).hexdigest()) for r, t, n in zip(order, texts, texts[1:] + texts[:1], strict=True)]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert simhash.with_edits(none).count() == 0
    one = simhash.with_edits(docs.where("doc_id = 3")).first()
    assert one.near_next == 1.0
    all_rows = simhash.with_edits(docs).collect()
    assert len({r.fingerprint for r in all_rows if r.doc_id in (45, 46, 5)}) == 1


def test_block_tables_find_all_pairs(spark):
    rng = np.random.default_rng(2)
    marks = [rng.bytes(32) for _ in range(30)]
    for m in marks[:20]:
        x = bytearray(m)
        for bit in rng.choice(256, int(rng.integers(1, 6)), replace=False):
            x[bit // 8] ^= 1 << (bit % 8)
        marks.append(bytes(x))
    marks.append(marks[0])
    df = spark.createDataFrame([(m.hex(),) for m in marks] + [(None,)], "fingerprint string")
    got = {(r.a, r.b): r.distance for r in simhash.near_pairs(df, 3).collect()}
    hexes = sorted({m.hex() for m in marks})
    want = {(a, b): d for i, a in enumerate(hexes) for b in hexes[i + 1 :] if (d := (int(a, 16) ^ int(b, 16)).bit_count()) <= 3}
    assert got == want and want


def test_language_model_base_and_total(docs, none):
    got = brown.score(docs, clustered=12, classes=4, listed=40).collect()
    rows = corpus()
    train = [r for r in rows if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2]
    tokens_of = lambda r: [*word_list(r[1]), b" END"]
    c = collections.Counter(t for r in train for t in tokens_of(r))
    n, v = sum(c.values()), len(c)
    want = sorted(((r[0], len(tokens_of(r)), sum(c[t] > 0 for t in tokens_of(r)), round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in tokens_of(r)), 6)) for r in rows), key=key)
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got), key=key) == want
    assert {r.train_tokens for r in got} == {n} and all(r.score < 0 for r in got)
    by_text = collections.defaultdict(set)
    for r in got:
        by_text[r.n_tokens, round(r.base_score, 6)].add(round(r.score, 6))
    assert brown.score(none).count() == 0


def test_class_model_probabilities_sum_to_one(spark, docs):
    marked = docs.select("doc_id", brown.held_out(F.col("doc_id")).alias("held_out"), "text").where("not held_out")
    counts = brown.word_counts(marked).persist()
    m = brown.fit(marked, counts, 12, 4, 1 << 18)
    rare = 10 ** m.rare(m.counts[m.clustered :].astype(float))
    classes, ends = len(m.transition) - 1, len(m.transition)
    for row in m.transition:
        p = 10**row
        words = sum(p[c] * 10**e for c, e in zip(m.classes, m.emission, strict=True))
        assert words + p[classes] * (rare.sum() + 10**m.unknown) + p[ends] == pytest.approx(1, abs=1e-6)


def test_every_word_has_a_class_and_probabilities_sum_to_one(spark, docs):
    marked = docs.select("doc_id", brown.held_out(F.col("doc_id")).alias("held_out"), "text").where("not held_out")
    counts = brown.word_counts(marked).persist()
    core = brown.fit(marked, counts, 12, 4, 40)
    others = brown.assigned(marked, core).persist()
    want = {r.word: r.c for r in counts.collect()}
    listed = {int(w): int(c) for w, c in zip(core.listed.view("int64"), core.counts, strict=True)}
    top = set(list(listed)[:12])
    assert {r.word: r.c for r in others.collect()} == {w: c for w, c in want.items() if w not in top}
    model = brown.classed(marked, others, core)
    m = len(model.norm)
    word = np.zeros(m)
    np.add.at(word, model.classes[:12], 10 ** model.emission[:12])
    for r in others.collect():
        word[r["class"]] += 10 ** (math.log10(r.c - model.discount) + model.norm[r["class"]])
    for row in 10**model.transition:
        assert row[:m] @ word + row[m] + row[m + 1] == pytest.approx(1, abs=1e-6)
    by_word = {r.word: r["class"] for r in others.collect()}
    assert all(by_word[w] == c for w, c in zip(core.listed.view("int64")[12:].tolist(), model.classes[12:].tolist(), strict=True))
    own = by_word | dict(zip(core.listed.view("int64")[:12].tolist(), core.classes.tolist(), strict=True))
    seen = np.zeros((m + 1, m + 1))
    for r in marked.collect():
        data, at = textops.text_buffer(pa.array([r.text], pa.string()))
        chain = [m, *[own[int(h)] for h in textops.words(data, at)[2].view("int64")], m]
        np.add.at(seen, (chain[:-1], chain[1:]), 1)
    assert (brown.class_transitions(marked, others, core.listed, model.classes, m) == seen).all()


def test_scores_do_not_depend_on_what_is_listed(docs):
    few, all_ = (sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.score, 6)) for r in brown.score(docs, 12, 4, listed).collect()) for listed in (40, 1 << 18))
    assert few == all_


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 300), (7, 7), (400, 300)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {k: 100 for k in (100, 200, 300, 400)}
    stars = [(1000, k) for k in range(300, 400)] + [(500 + k, 450) for k in range(100)] + [(599, 1000)]  # centres hold far more than a partition's share
    got = {r.node: r.root for r in components.components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert set(got.values()) == {300} and len(got) == 202
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(9)
    rows, labels = [], []
    for i in range(700):
        words = sentence(rng, int(rng.integers(20, 60))).split()
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words[int(rng.integers(0, len(words)))] = ("moron", "Idiotic!", "scum")[int(rng.integers(0, 3))]
        if i % 5 == 0:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words), "en", f"s{i % 6}", 0, 0, 0.0, "", 0))
        labels.append((i, int(i % 5 != 0), int(toxic)))
    rows += [(1000, None, None, None, None, None, None, None, None), (1001, "", "en", "s0", 0, 0, 0.0, "", 0)]
    labels += [(3, None, None), (None, 1, 1), (5, 1, 0), (99_999, 0, 1)]
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(labelled, none):
    docs, labels = labelled
    got = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert len(got) == 702
    held = [r for i, r in got.items() if r.held_out and i < 700]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values()) and got[1000].predicted == 0
    assert toxicity.score(none, labels).count() == 0
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.0}


def test_quality_on_held_out_rows(labelled, none):
    docs, labels = labelled
    got = quality.score(docs, labels, F.col("source"), F.col("lang")).collect()
    assert len(got) == 702
    held = [r for r in got if r.held_out and r.doc_id < 700]
    assert np.mean([r.keep == (r.doc_id % 5 != 0) for r in held]) > 0.95
    assert quality.score(none, labels, F.col("source"), F.col("lang")).count() == 0
    assert quality.score(docs, labels.limit(0), F.col("source"), F.col("lang")).count() == 702


def test_sparse_sites_shrink(spark):
    rows = [("big", "p", 0.0, int(i % 10 != 0)) for i in range(400)] + [("bad", "p", 0.0, int(i % 10 == 0)) for i in range(400)] + [("tiny", "p", 0.0, 0), (None, None, 0.0, None)]
    got = {r.host: r for r in quality.sites(spark.createDataFrame(rows, "host string, path string, evidence double, label int")).collect()}
    assert got["bad"].path_rate < 0.2 < 0.8 < got["big"].path_rate
    assert got["bad"].path_rate < got["tiny"].path_rate < got["tiny"].global_rate and None in got
