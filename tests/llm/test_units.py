"""Parts of the operators without Spark."""

import io
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from meshloom.llm import bloom, brown, jaccard, sharding, signature_tree, simhash, textops, tokens, toxicity, warc

TEXTS = ["", "a", "The  cat\tsat", "Ünï çödé wörds é", "x" * 3000, " lead and trail ", "a b c d e f g", None, "one\ntwo\r\nthree\x0bfour"]


def spans(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


@pytest.mark.parametrize("segment", [8, 64, 1 << 20])
def test_words_are_those_of_the_pattern(monkeypatch, segment):
    monkeypatch.setattr(textops, "SEGMENT", segment)
    data, at = textops.text_buffer(pa.array(TEXTS))
    start, end, h, offsets = textops.words(data, at)
    raw = data.tobytes()
    for i, text in enumerate(TEXTS):
        assert [raw[start[k] : end[k]] for k in range(offsets[i], offsets[i + 1])] == spans(text)
    names = {}
    for k in range(len(start)):
        word = bytes(c + 32 if 65 <= c <= 90 else c for c in raw[start[k] : end[k]])
        assert names.setdefault(word, h[k]) == h[k]
    assert len(set(names.values())) == len(names)


def test_prefix_hashes_are_hashes_of_prefixes():
    data, at = textops.text_buffer(pa.array(["stupidity stup stupid"]))
    _, _, h, _ = textops.words(data, at, textops.IS_LETTER, (4, 6))
    assert len({*h[:, 1]}) == 1 and h[1, 0] == h[0, 1] and h[2, 0] == h[0, 2] == h[2, 2]


def brute(sets, percent):
    up = list(range(len(sets)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(set(sets[i].tolist()) & set(sets[j].tolist()))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def family(rng, sizes, copies, change):
    out = []
    for n in sizes:
        base = rng.integers(0, 1 << 63, n, dtype=np.int64).view(np.uint64)
        for _ in range(copies):
            x = base.copy()
            k = rng.integers(0, max(1, int(n * change)) + 1)
            if k:
                x[rng.choice(n, k, replace=False)] = rng.integers(0, 1 << 63, k, dtype=np.int64).view(np.uint64)
            out.append(np.unique(x[rng.permutation(n)[: max(1, n - rng.integers(0, max(1, n // 10) + 1))]]))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_signature_tree_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    sets = family(rng, [3, 8, 20, 60, 300], 7, 0.2)
    assert signature_tree.self_join(sets, 80).tolist() == brute(sets, 80)
    half = len(sets) // 2
    known = np.arange(len(sets))
    for part, shift in ((sets[:half], 0), (sets[half:], half)):
        known[shift : shift + len(part)] = signature_tree.self_join(part, 80) + shift
    links = signature_tree.cross_join(sets[:half], sets[half:], known, 80)
    up = known.tolist()

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(sets))] == brute(sets, 80)


@pytest.mark.parametrize("seed", range(4))
def test_linked_sets_share_a_key_and_pass_the_sketch(seed):
    rng = np.random.default_rng(100 + seed)
    windows = jaccard.Windows(80)
    for n in (1, 2, 3, 4, 5, 6, 7, 9, 11, 16, 25, 60, 130, 500, 1500):
        for _ in range(12):
            x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.int64).view(np.uint64) * np.uint64(2))
            drop = int(rng.integers(0, n // 5 + 1))
            add = int(rng.integers(0, n // 4 + 1))
            y = np.unique(np.concatenate((x[rng.permutation(n)[drop:]], rng.integers(0, 1 << 63, add, dtype=np.int64).view(np.uint64))))
            if signature_tree.linked(x, y, 80):
                assert set(jaccard.set_keys(x, windows).tolist()) & set(jaccard.set_keys(y, windows).tolist())
                maps = jaccard._folded([jaccard.sketch(x), jaccard.sketch(y)])
                assert jaccard.possible(np.array([len(x)]), maps[:1], np.array([len(y)]), maps[1:], 80).all()


def test_postings_round_trip():
    rng = np.random.default_rng(0)
    keys = np.sort(rng.integers(0, 1 << 57, 100, dtype=np.int64).view(np.uint64))
    sigs = rng.integers(0, 1 << 62, 100)
    got, names = jaccard._unpack(jaccard._pack(keys, sigs, 6))
    assert (got == (keys << np.uint64(6)) >> np.uint64(24)).all() and (names == sigs).all()


@pytest.mark.parametrize("n", [0, 1, 7, 1024, 1025, 70_000])
def test_rans_round_trip_and_damage(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 4999).astype(np.uint32)
    coder = tokens.Coder(tokens.quantized(np.bincount(ids, minlength=5000)))
    block = coder.encode(ids)
    assert (coder.decode(block) == ids).all()
    if n == 70_000:
        assert len(block) < 2 * n
        part = coder.decode(block, 1, 2)  # from a checkpoint alone
        lo = tokens.CHECKPOINT_STEPS * tokens.LANES
        assert (part == ids[lo:]).all()
        bad = bytearray(block)
        bad[-3] ^= 1
        with pytest.raises(ValueError):
            coder.decode(bytes(bad))


def test_frequencies_fill_the_scale():
    for counts in (np.zeros(10, int), np.array([10**12, 1, 0, 0]), np.arange(1000)):
        f = tokens.quantized(counts)
        assert f.sum() == 1 << tokens.SCALE_BITS and f.min() >= 1


def test_word_tokenizer_equals_the_library():
    P = pytest.importorskip("public_tokenizers")
    path = P.path("word_bpe_49k.json")
    own = tokens.WordTokenizer(path)
    texts = [*TEXTS, "it's O'Neil's <|endoftext|> 12,345 \x01mark \x01 x", " nbsp em", "İstanbul ΣΑΣ ǅ", "\x1c\x1d odd", "é café CAFÉ"]
    ids, at = own.encode(pa.array(texts))
    for i, text in enumerate(texts):
        want = [*own.library.encode(text or "", add_special_tokens=False).ids, 1]
        assert ids[at[i] : at[i + 1]].tolist() == want, text


def test_word_cache_merges_and_resets(monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    monkeypatch.setattr(tokens, "MERGE_WORDS", 7)
    monkeypatch.setattr(tokens, "CACHE_WORDS", 60)
    own = tokens.WordTokenizer(P.path("word_bpe_49k.json"))
    rng = random.Random(1)
    for _ in range(30):
        text = " ".join(f"word{rng.randrange(90)}" for _ in range(12))
        assert own.encode(pa.array([text]))[0].tolist() == [*own.library.encode(text, add_special_tokens=False).ids, 1]


def test_packing_balances_and_keeps_all():
    rng = np.random.default_rng(1)
    demand = rng.lognormal(0, 1, (2000, 3)).round(3) + 1
    where = sharding.pack(demand, 24)
    load = np.bincount(where, demand[:, 0], 24)
    assert set(where.tolist()) == set(range(24)) and load.max() / load.min() < 1.001
    assert sharding.pack(np.ones((3, 3)), 24).tolist() and len(sharding.pack(np.zeros((0, 3)), 24)) == 0


def test_normaliser_makes_a_member_per_record():
    rows = [(1, "http://a", b"", None, False), (None, None, "é".encode() * 5000, None, False), (3, "x\r\ny", b"a\r\n\r\nb", 9, True)]
    raw = b"".join(warc.record(*r) for r in rows)
    for stream in (zlib.compress(raw, 6, 31), b"".join(zlib.compress(warc.record(*r), 6, 31) for r in rows)):
        out = io.BytesIO()
        index = list(warc.normalise_file(io.BytesIO(stream), out))
        got = [warc.parsed(out.getvalue()[e["offset"] : e["offset"] + e["length"]]) for e in index]
        assert [(g[0], g[1], g[3], g[4]) for g in got] == [(1, 0, "response", None), (None, 10000, "response", None), (3, 6, "revisit", 9)]
        assert [g[2] for g in got] == [warc.digest(r[2]) for r in rows]
    with pytest.raises(ValueError):
        list(warc.normalise_file(io.BytesIO(zlib.compress(raw, 6, 31)[:-20]), io.BytesIO()))
    assert list(warc.normalise_file(io.BytesIO(b""), io.BytesIO())) == []


def test_fingerprints_follow_likeness():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    a = " ".join(rng.choices(words, k=400))
    b = " ".join(a.split()[:380]) + " " + " ".join(rng.choices(words, k=20))
    c = " ".join(rng.choices(words, k=400))
    f = simhash.fingerprints(pa.array([a, a.upper(), b, c, "", None]))
    near = simhash.likeness(f[[0, 0, 0]], f[[1, 2, 3]])
    assert near[0] == 1 and near[1] > 0.85 > 0.65 > near[2]
    assert not f[4].any() and not f[5].any()


def test_events_know_start_end_and_last_clustered_word():
    history, outcome, doc = brown.events(np.array([0, -1, 1, -1]), np.array([0, 3, 3, 4]), 2)
    assert history.tolist() == [2, 0, 0, 1, 2, 2, 2]
    assert outcome.tolist() == [0, 2, 1, 3, 3, 2, 3] and doc.tolist() == [0, 0, 0, 0, 1, 2, 2]


def test_exchange_finds_planted_classes():
    rng = np.random.default_rng(0)
    kind = np.repeat([0, 1, 2], 20)
    p = np.array([[0.05, 0.9, 0.05], [0.05, 0.05, 0.9], [0.9, 0.05, 0.05]])
    counts = rng.poisson(30 * p[kind][:, kind])
    own = brown.exchange(counts.astype(float), 3, 20)
    assert len({(a, b) for a, b in zip(kind.tolist(), own.tolist(), strict=True)}) == 3


def test_languages_from_letters():
    texts = ["plain words only", "größe über straße", "él mañana señor", "être élève à côté français", ""]
    data, at = textops.text_buffer(pa.array(texts))
    assert [toxicity.LANGUAGES[k] for k in toxicity.languages(data, at)] == ["en", "de", "es", "fr", "en"]


def test_released_yields_all_and_trims_when_a_reader_stops_early():
    batch = pa.RecordBatch.from_pydict({"x": [1, 2]})
    twice = textops.released(lambda batches: (b for b in batches for _ in range(2)))
    assert sum(b.num_rows for b in twice(iter([batch, batch]))) == 8
    assert next(twice(iter([batch]))).num_rows == 2


def test_bloom_tells_apart(spark):
    rows = spark.createDataFrame([(k,) for k in range(200)] + [(None,)], "key long")
    wanted = spark.createDataFrame([(3,), (150,), (None,)], "key long")
    got = {r.key: r.maybe for r in bloom.told(rows, wanted, "key", "maybe").collect()}
    assert len(got) == 201 and got[3] and got[150] and got[None] and sum(got.values()) < 10
    assert not any(r.maybe for r in bloom.told(rows, wanted.limit(0), "key", "maybe").collect())
    assert {3, 150, None} <= {r.key for r in bloom.possible(rows, wanted, "key").collect()}
