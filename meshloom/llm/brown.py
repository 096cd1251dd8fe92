"""LM scoring: Brown class-based n-grams.

Exchange clustering assigns the ``CLUSTERED`` most frequent words, the core, to
classes so that the class bigrams explain the text best.  Every other word of the
training texts then joins the class with the best exchange gain against the core's
class bigrams, given its nearest core words on either side.  A token's probability is

    P(class | class of the token before it) * P(word | class)

with transitions counted over all tokens of all training texts.  An absolute
discount moves part of the words beyond the core to the unknown ones, which count
as a single type, as in the base model; after an unknown word the classes'
general frequencies hold.  The end of a text is a token.

Frequent words' counts and classes, at most ``LISTED`` rows, are sent to every
task; those of all other words are met by joins on the word's hash, in which no
key is frequent.  Words are named by 64-bit hashes.

Defined results: null, empty and wordless texts consist of the end token; rows
with a null doc_id are training rows; rows are scored one by one, so repeated
rows get equal results; other columns are ignored; with no training text, N and
V are 0 and every token is unknown; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize
from .textops import U, slices, text_buffer, words

CLUSTERED, CLASSES, LISTED = 2048, 64, 1 << 18
ROUNDS, SEED, SMOOTH = 8, 5, 8.0
FOLD, REST = 7, 2
FLUSH = 1 << 20


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 7 is 2; False for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLD == REST, F.lit(False))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    size = 0

    def counted() -> pa.RecordBatch:
        names, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n)], ["word", "k"])

    for batch in batches:
        for part in slices(batch):
            h = words(*text_buffer(part.column("text")))[2]
            held.append(h)
            size += len(h)
            if size > 4 * FLUSH:
                yield counted()
                held, size = [], 0
    if size:
        yield counted()


def word_counts(training: DataFrame) -> DataFrame:
    """(word, c): the count of every word of the training texts, without their ends."""
    return training.select("text").mapInArrow(_word_counts, "word long, k long").groupBy("word").agg(F.sum("k").alias("c"))


class Lookup:
    """Position of a hash among ``names``, -1 for others."""

    def __init__(self, names: np.ndarray) -> None:
        self.order = np.argsort(names)
        self.names = names[self.order]

    def __call__(self, h: np.ndarray) -> np.ndarray:
        if not len(self.names):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.names, h), len(self.names) - 1)
        return np.where(self.names[at] == h, self.order[at], -1)


def events(ids: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """History, outcome and text of every token.

    ``ids`` are word ids, -1 outside the ``n`` clustered ones.  Histories are word
    ids or n for the start; outcomes are word ids, n for another word, n + 1 for
    the end."""
    docs = len(offsets) - 1
    length = np.diff(offsets)
    start = offsets[:-1] + 2 * np.arange(docs)  # each text gets a start and an end
    total = len(ids) + 2 * docs
    token = np.empty(total, np.int64)
    doc = np.repeat(np.arange(docs), length + 2)
    inner = np.arange(len(ids)) + 2 * np.repeat(np.arange(docs), length) + 1
    token[inner] = np.where(ids < 0, n, ids)
    ends = start + length + 1
    token[ends] = n + 1
    token[start] = -1
    place = np.zeros(total, np.int64)
    is_history = (token >= 0) & (token < n)
    is_history[start] = True
    place[is_history] = np.flatnonzero(is_history)
    last = np.maximum.accumulate(place) if total else place
    outcome = np.flatnonzero(token != -1)
    history = token[last[outcome - 1]]
    return np.where(history == -1, n, history), token[outcome], doc[outcome]


def transition_counts(training: DataFrame, names: np.ndarray) -> np.ndarray:
    """(n + 1, n + 2) counts of outcomes after histories; at most that many rows reach the driver."""
    n = len(names)
    sent = training.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(sent.value)
        total = np.zeros((n + 1) * (n + 2), np.int32)
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for part in slices(batch):
                _, _, h, offsets = words(*text_buffer(part.column("text")))
                a, b, _ = events(lookup(h), offsets, n)
                held.append(a * (n + 2) + b)
                size += len(a)
                if size > 2 * FLUSH:
                    key, k = np.unique(np.concatenate(held), return_counts=True)
                    total[key] += k.astype(np.int32)
                    held, size = [], 0
        if size:
            key, k = np.unique(np.concatenate(held), return_counts=True)
            total[key] += k.astype(np.int32)
        on = np.flatnonzero(total)
        for x in range(0, len(on), FLUSH):
            own = on[x : x + FLUSH]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], ["key", "k"])

    found = training.select("text").mapInArrow(run, "key int, k int").groupBy("key").agg(F.sum("k").alias("k")).toArrow()
    out = np.zeros((n + 1) * (n + 2), np.int64)
    out[found.column("key").to_numpy()] = found.column("k").to_numpy()
    return out.reshape(n + 1, n + 2)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(counts: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each word from its bigram counts, by the exchange algorithm.

    Words, the most frequent first, move one at a time to the class that raises
    sum n(a,b) log n(a,b) - sum n(a,.) log n(a,.) - sum n(.,b) log n(.,b) most."""
    n = len(counts)
    classes = min(classes, max(n, 1))
    own = np.arange(n) % classes
    table = np.zeros((classes, classes))
    np.add.at(table, (own[:, None], own[None, :]), counts)
    out_by = np.zeros((n, classes))  # word -> class
    in_by = np.zeros((n, classes))  # class -> word
    np.add.at(out_by.T, own, counts.T.astype(float))
    np.add.at(in_by.T, own, counts.astype(float))
    order = np.argsort(-(counts.sum(0) + counts.sum(1)), kind="stable")
    for _ in range(rounds):
        moved = 0
        for w in order:
            a, loop = own[w], float(counts[w, w])
            out, inn = out_by[w].copy(), in_by[w].copy()
            out[a] -= loop
            inn[a] -= loop
            table[a] -= out
            table[:, a] -= inn
            table[a, a] -= loop
            # gain of adding w to each class b
            rows, cols = table.sum(1) + inn, table.sum(0) + out  # what the others hold whatever b is
            gain = (_xlogx(table + out) - _xlogx(table)).sum(1) + (_xlogx(table + inn[:, None]) - _xlogx(table)).sum(0)
            d = np.diag(table)
            gain += _xlogx(d + out + inn + loop) - _xlogx(d + out) - _xlogx(d + inn) + _xlogx(d)
            gain -= _xlogx(rows + out.sum() + loop) - _xlogx(rows) + _xlogx(cols + inn.sum() + loop) - _xlogx(cols)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            table[b] += out
            table[:, b] += inn
            table[b, b] += loop
            if b != a:
                own[w] = b
                moved += 1
                out_by[:, a] -= counts[:, w]
                out_by[:, b] += counts[:, w]
                in_by[:, a] -= counts[w]
                in_by[:, b] += counts[w]
        if not moved:
            break
    return own


@dataclass
class Model:
    listed: np.ndarray  # hashes, most frequent first
    counts: np.ndarray  # theirs
    clustered: int
    classes: np.ndarray  # of the clustered words
    transition: np.ndarray  # log10 P(outcome class | history class); last row: start; last columns: other word, end
    emission: np.ndarray  # log10 P(word | class) of the clustered words
    train_tokens: int
    vocabulary: int
    ends: int
    discount: float
    rare_tokens: float  # N_rare - discount * V_rare
    known: float  # log10 of the shares of known and unknown among other words
    unknown: float
    seen: np.ndarray  # counts of outcome classes after history classes, as in transition

    def rare(self, c: np.ndarray) -> np.ndarray:
        return np.log10(np.maximum(c - self.discount, 1e-9) / max(self.rare_tokens, 1e-9)) + self.known


def fit(training: DataFrame, counts: DataFrame, clustered: int = CLUSTERED, classes: int = CLASSES, listed: int = LISTED) -> Model:
    """The core's model of materialised word ``counts``: words beyond the core form one class and are no histories."""
    ends = training.count()
    n, v, ones, twos = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum((F.col("c") == 1).cast("long")), F.lit(0)), F.coalesce(F.sum((F.col("c") == 2).cast("long")), F.lit(0))).first()
    top = counts.orderBy(F.desc("c"), "word").limit(listed).toArrow()  # a bounded number of rows
    names, c = top.column("word").to_numpy().view(U), top.column("c").to_numpy()
    order = np.lexsort((names, -c))
    names, c = names[order], c[order]
    k = min(clustered, len(names))
    seen = transition_counts(training, names[:k])
    own = exchange(seen[:k, :k].astype(np.float64), classes)
    m = min(classes, max(k, 1))
    into = np.concatenate((own, [m, m + 1]))
    by_class = np.zeros((m + 1, m + 2))
    np.add.at(by_class, (np.concatenate((own, [m]))[:, None], into[None, :]), seen)
    general = by_class.sum(0) + 0.1
    general /= general.sum()
    transition = np.log10((by_class + SMOOTH * general) / (by_class.sum(1, keepdims=True) + SMOOTH))
    total = np.zeros(m)
    np.add.at(total, own, c[:k].astype(float))
    emission = np.log10(c[:k] / total[own]) if k else np.zeros(0)
    rare_n, rare_v = float(n - c[:k].sum()), float(v - k)
    discount = ones / (ones + 2 * twos) if ones and twos else 0.5
    mass = discount * rare_v / rare_n if rare_n else 0.5
    mass = min(max(mass, 1e-6), 0.999999)
    return Model(names, c, k, own, transition, emission, int(n + ends), int(v + (ends > 0)), ends, discount, rare_n - discount * rare_v, float(np.log10(1 - mass)), float(np.log10(mass)), by_class)


def contexts(ids: np.ndarray, offsets: np.ndarray, classes: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place of every word outside the core, and the classes of the nearest core words before and after it; m for start or end."""
    docs = len(offsets) - 1
    inner = np.arange(len(ids)) + 2 * np.repeat(np.arange(docs), np.diff(offsets)) + 1
    own = np.full(len(ids) + 2 * docs, m)  # each text gets a start and an end
    own[inner] = np.where(ids < 0, -1, np.append(classes, -1)[ids])
    at = np.arange(len(own))
    left = np.maximum.accumulate(np.where(own >= 0, at, 0)) if len(own) else at
    right = np.minimum.accumulate(np.where(own >= 0, at, len(own))[::-1])[::-1] if len(own) else at
    where = np.flatnonzero(ids < 0)
    return where, own[left[inner[where]]], own[right[inner[where]]]


def _runs(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of ``columns``, sorted, and how often each occurs."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    first = np.ones(len(order), bool)
    if len(order):
        first[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    at = np.flatnonzero(first)
    return [c[at] for c in columns], np.diff(np.append(at, len(order)))


def best_classes(word: np.ndarray, context: np.ndarray, k: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, their counts and the classes of best exchange gain.

    Rows are sorted by word; ``context`` is left * (m + 1) + right of a word's k
    occurrences; ``seen`` has the core's counts, start as last row, end as last column."""
    m = len(seen) - 1
    first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    n = len(first)
    own = np.repeat(np.arange(n), np.diff(np.append(first, len(word))))
    held = lambda side: np.bincount(own * (m + 1) + side, k, n * (m + 1)).reshape(n, m + 1)
    before, after = held(context // (m + 1)), held(context % (m + 1))
    c = np.add.reduceat(k, first)
    gain = np.zeros((n, m))
    for counts, table in ((before, seen[:, :m]), (after, seen[:m].T)):
        w, x = np.nonzero(counts)
        part = _xlogx(table[x] + counts[w, x][:, None]) - _xlogx(table)[x]
        gain += np.add.reduceat(part, np.searchsorted(w, np.arange(n)))
    w, x = np.nonzero((before[:, :m] > 0) & (after[:, :m] > 0))  # both sides meet in one cell
    d, i, o = np.diag(seen)[x], before[w, x], after[w, x]
    gain[w, x] += _xlogx(d + i + o) - _xlogx(d + i) - _xlogx(d + o) + _xlogx(d)
    for total in (seen[:m].sum(1) + before[:, :m], seen[:, :m].sum(0) + after[:, :m]):
        gain -= _xlogx(total + c[:, None]) - _xlogx(total)
    return word[first], c, gain.argmax(1)


def assigned(training: DataFrame, core: Model) -> DataFrame:
    """(word, c, class) of every training word outside the core."""
    names, classes, m = core.listed[: core.clustered], core.classes, len(core.transition) - 1
    seen = core.seen[:, [*range(m), m + 1]]
    sent = training.sparkSession.sparkContext.broadcast((names, classes, seen))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, classes, _ = sent.value
        lookup = Lookup(names)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def counted() -> pa.RecordBatch:
            (word, context), k = _runs(*(np.concatenate(x) for x in zip(*held, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(context.astype(np.int32)), pa.array(k.astype(np.int32))], ["word", "context", "k"])

        for batch in batches:
            for part in slices(batch):
                _, _, h, offsets = words(*text_buffer(part.column("text")))
                where, left, right = contexts(lookup(h), offsets, classes, m)
                held.append((h[where], left * (m + 1) + right))
                size += len(where)
                if size > FLUSH:
                    yield counted()
                    held, size = [], 0
        if size:
            yield counted()

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = sent.value[2]
        held: list[list[np.ndarray]] = []
        size = 0

        def chosen(*columns: np.ndarray) -> pa.RecordBatch:
            word, c, own = best_classes(*columns, seen)
            return pa.RecordBatch.from_arrays([pa.array(word), pa.array(c.astype(np.int64)), pa.array(own.astype(np.int32))], ["word", "c", "class"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            size += batch.num_rows
            if size < 1 << 14:
                continue
            rows = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last word may go on in the next batch
            if cut:
                yield chosen(*(x[:cut] for x in rows))
            held, size = [[x[cut:] for x in rows]], len(rows[0]) - cut
        if size:
            yield chosen(*(np.concatenate(x) for x in zip(*held, strict=True)))

    rows = training.select("text").mapInArrow(found, "word long, context int, k int")
    return rows.repartition("word").sortWithinPartitions("word").mapInArrow(best, "word long, c long, class int")


def pairs(at: np.ndarray, h: np.ndarray, offsets: np.ndarray, classes: np.ndarray, m: int) -> tuple[np.ndarray, ...]:
    """Text, classes (a, b) and words (x, y) of every token and the one before it.

    ``at`` are places in ``classes``, -1 outside; these have class -1 and the
    word's hash, all others the hash 0.  The start, as a, and the end, as b, have class m."""
    docs = len(offsets) - 1
    length = np.diff(offsets)
    doc = np.repeat(np.arange(docs), length + 1)
    inner = np.arange(len(at)) + np.repeat(np.arange(docs), length)
    b, y = np.full(len(doc), m), np.zeros(len(doc), U)
    b[inner] = np.where(at < 0, -1, np.append(classes, -1)[at])
    y[inner] = np.where(at < 0, h, U(0))
    a, x = np.roll(b, 1), np.roll(y, 1)  # the end of a text lies where the next one's start is
    return doc, a, b, x, y


JOINED = "tag long, a int, b int, x long, y long, k long"


def _joined_batch(doc: np.ndarray, a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> list[pa.Array]:
    (doc, a, b, x, y), k = _runs(doc, a, b, x, y)
    return [pa.array(doc), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(x.view(np.int64)), pa.array(y.view(np.int64)), pa.array(k)]


def joined(rows: DataFrame, others: DataFrame, unknown: int) -> DataFrame:
    """``rows`` of JOINED with the classes of unlisted words filled in, and c, the count of an unlisted y that is known."""
    found = others.select(F.col("word").alias("_word"), F.col("c").alias("_c"), F.col("class").alias("_class"))
    cls = F.coalesce("_class", F.lit(unknown))
    left = rows.where("a < 0").join(found, F.col("x") == F.col("_word"), "left").withColumn("a", cls).select("tag", "a", "b", "y", "k")
    both = left.union(rows.where("a >= 0").select("tag", "a", "b", "y", "k"))
    right = both.where("b < 0").join(found, F.col("y") == F.col("_word"), "left").select("tag", "a", cls.alias("b"), "k", F.col("_c").alias("c"))
    return right.union(both.where("b >= 0").select("tag", "a", "b", "k", F.lit(None).cast("long")))


def class_transitions(training: DataFrame, others: DataFrame, listed: np.ndarray, classes: np.ndarray, m: int) -> np.ndarray:
    """(m + 1, m + 1) counts of classes after classes over all tokens; the last row is the start, the last column the end."""
    sent = training.sparkSession.sparkContext.broadcast((listed, classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, classes = sent.value
        lookup = Lookup(listed)
        names = [x.split()[0] for x in JOINED.split(", ")]
        total = np.zeros((m + 1) ** 2, np.int64)
        for batch in batches:
            for part in slices(batch):
                _, _, h, offsets = words(*text_buffer(part.column("text")))
                doc, a, b, x, y = pairs(lookup(h), h, offsets, classes, m)
                here = (a >= 0) & (b >= 0)
                total += np.bincount(a[here] * (m + 1) + b[here], minlength=len(total))
                if not here.all():
                    yield pa.RecordBatch.from_arrays(_joined_batch(np.zeros_like(doc)[~here], a[~here], b[~here], x[~here], y[~here]), names)
        on = np.flatnonzero(total)
        zero = np.zeros(len(on), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(zero), pa.array((on // (m + 1)).astype(np.int32)), pa.array((on % (m + 1)).astype(np.int32)), pa.array(zero), pa.array(zero), pa.array(total[on])], names)

    rows = materialize(training.select("text").mapInArrow(run, JOINED), "lm-pairs")
    found = joined(rows, others, -1).groupBy("a", "b").agg(F.sum("k").alias("k")).toArrow()  # classes by classes
    out = np.zeros((m + 1, m + 1))
    out[found.column("a").to_numpy(), found.column("b").to_numpy()] = found.column("k").to_numpy()
    return out


@dataclass
class Classed:
    """All words in classes.  Class m is the start as history and the end as outcome, m + 1 an unknown word."""

    listed: np.ndarray  # hashes of the core, then of other frequent words
    counts: np.ndarray  # theirs
    classes: np.ndarray
    emission: np.ndarray  # log10 P(word | class)
    transition: np.ndarray  # log10 P(outcome | history)
    norm: np.ndarray  # log10 P(word | class) of a word beyond the core less log10(c - discount)
    discount: float
    train_tokens: int
    vocabulary: int
    ends: int


def classed(training: DataFrame, others: DataFrame, core: Model) -> Classed:
    """The model over the core and the materialised ``assigned`` words."""
    k, m = core.clustered, len(core.transition) - 1
    top = others.orderBy(F.desc("c"), "word").limit(len(core.listed) - k).toArrow()  # a bounded number of rows
    place = Lookup(top.column("word").to_numpy().view(U))(core.listed[k:])
    classes = np.concatenate((core.classes, top.column("class").to_numpy()[place])).astype(np.int64)
    total, kinds = np.bincount(core.classes, core.counts[:k], m).astype(float), np.zeros(m)
    for r in others.groupBy("class").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect():  # a row per class
        total[r["class"]] += r.c
        kinds[r["class"]] = r.n
    freed = np.divide(core.discount * kinds, total, out=np.ones(m), where=total > 0)
    unknown = np.where(total > 0, np.maximum(freed, 1e-6), 1.0)
    norm = np.log10(np.divide((1 - unknown) / np.where(freed < 1, 1 - freed, 1), total, out=np.ones(m), where=total > 0))
    less = np.concatenate((np.zeros(k), np.full(len(classes) - k, core.discount)))
    seen = class_transitions(training, others, core.listed, classes, m)
    general = seen.sum(0) + 0.1
    general /= general.sum()
    p = np.concatenate(((seen + SMOOTH * general) / (seen.sum(1, keepdims=True) + SMOOTH), general[None, :]))
    transition = np.log10(np.concatenate((p, p[:, :m] @ unknown[:, None]), 1))
    return Classed(core.listed, core.counts, classes, np.log10(core.counts - less) + norm[classes], transition, norm, core.discount, core.train_tokens, core.vocabulary, core.ends)


SCORED = "tag long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double, a int, b int, x long, y long, k long"


def _score(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model: Classed = sent.value
        lookup, tag, m = Lookup(model.listed), TaskContext.get().partitionId() << 40, len(model.norm)
        base_norm = np.log10(model.train_tokens + model.vocabulary + 1)
        log_count = np.log10(model.counts + 1.0)
        for batch in batches:
            for part in slices(batch):
                docs = part.num_rows
                _, _, h, offsets = words(*text_buffer(part.column("text")))
                doc = np.repeat(np.arange(docs), np.diff(offsets))
                at = lookup(h)
                known = at >= 0
                sums = lambda w: np.bincount(doc[known], w[at[known]], docs)
                base = sums(log_count) + (np.log10(model.ends + 1) - (np.diff(offsets) + 1) * base_norm)
                d, a, b, x, y = pairs(at, h, offsets, model.classes, m)
                here = (a >= 0) & (b >= 0)
                score = sums(model.emission) + np.bincount(d[here], model.transition[a[here], b[here]], docs)
                tags = tag + np.arange(docs)
                yield _batch(tags, part.column("doc_id"), part.column("held_out"), np.diff(offsets) + 1, np.bincount(doc[known], minlength=docs) + (model.ends > 0), base, score, *[None] * 5)
                if not here.all():
                    own, *rest = _joined_batch(d[~here], a[~here], b[~here], x[~here], y[~here])
                    yield _batch(tags[own.to_numpy()], *[None] * 6, *rest)
                tag += docs

    return run


_TYPES = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]


def _batch(tags: np.ndarray, *columns: object) -> pa.RecordBatch:
    arrays = [pa.array(tags)] + [pa.nulls(len(tags), t) if c is None else c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c), t) for c, t in zip(columns, _TYPES[1:], strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in SCORED.split(", ")])


def score(docs: DataFrame, clustered: int = CLUSTERED, classes: int = CLASSES, listed: int = LISTED) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row of ``docs``."""
    spark = docs.sparkSession
    marked = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    training = marked.where(~F.col("held_out"))
    counts = materialize(word_counts(training), "lm-counts")
    core = fit(training, counts, clustered, classes, listed)
    others = materialize(assigned(training, core), "lm-classes")
    model = classed(training, others, core)
    m = len(model.norm)
    parts = materialize(marked.mapInArrow(_score(spark.sparkContext.broadcast(model)), SCORED), "lm-scored")
    table = spark.createDataFrame([(a, b, float(model.transition[a, b]), float(model.norm[b]) if b < m else 0.0) for a in range(m + 2) for b in range(m + 2)], "a int, b int, p double, norm double")
    rest = joined(parts.where("a is not null").select("tag", "a", "b", "x", "y", "k"), others, m + 1).join(F.broadcast(table), ["a", "b"])
    c, k = F.col("c"), F.col("k")
    added = rest.groupBy("tag").agg(
        F.sum(F.when(c.isNotNull(), k).otherwise(0)).alias("more_known"),
        F.sum(k * F.when(c.isNotNull(), F.log10(c + 1)).otherwise(0.0)).alias("more_base"),
        F.sum(k * (F.col("p") + F.when(c.isNotNull(), F.log10(c - model.discount) + F.col("norm")).otherwise(0.0))).alias("more_model"),
    )
    base = parts.where("a is null").select("tag", "doc_id", "held_out", "n_tokens", "n_known", "base", "model").join(added, "tag", "left")
    return base.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), (F.col("model") + F.coalesce("more_model", F.lit(0.0))).alias("score"),
    )
