"""Token ids of whole texts in a compressed binary format, and the way back.

Ids are coded with a static range asymmetric numeral system.  One frequency
table, counted over all documents, is shared by every block.  A block holds
whole documents in ascending order and can be decoded alone: its symbols are
dealt over interleaved lanes with a 64-bit state each that emit 32-bit words,
the states are kept at checkpoints so that parts of a block decode in parallel,
and CRC-32 sums guard the payload and the decoded ids.

A file is a Parquet part whose rows are blocks (any store that Spark can write
is enough, and Spark's commit makes a lost task's files disappear).

Defined results: null and empty texts have the end id alone; rows with equal
doc_id follow each other in order of their text; a null doc_id comes first;
other columns are ignored; an empty table gives an empty file.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .storage import materialize, new_path, remove
from .textops import released, slices, text_buffer, words

SCALE_BITS = 20
LANES = 1024
LOW = np.uint64(1 << 31)
SHIFT = np.uint64(32)
CHECKPOINT_STEPS = 64
BLOCK_IDS = 1 << 18
MAGIC = b"RAN1"
END_ID = 1
CACHE_WORDS, MERGE_WORDS = 1 << 20, 1 << 15
MARK = "\x01"


class WordTokenizer:
    """Encodes texts by their distinct words.

    For a vocabulary that folds case, drops white space and never joins across it, a
    text's ids are the ids of its runs between ASCII white space, one after the
    other.  Runs are named by the hash of their bytes, A-Z as a-z; new ones are
    encoded by the library, many to a call, and kept in a cache of bounded size."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.mark = self.library.encode(MARK, add_special_tokens=False).ids
        self.reset()

    def reset(self) -> None:
        # two sorted levels of (hash, row), the small one merged into the large: numbers only, so a million words take 40 MB
        self.levels = [(np.zeros(0, np.uint64), np.zeros(0, np.int32)) for _ in range(2)]
        self.start, self.size, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _find(self, names: np.ndarray) -> np.ndarray:
        """Cache row of each of the sorted ``names``, -1 for new ones."""
        row = np.full(len(names), -1, np.int64)
        for held, rows in self.levels:
            if len(held):
                at = np.minimum(np.searchsorted(held, names), len(held) - 1)
                row = np.where(held[at] == names, rows[at], row)
        return row

    def _keep(self, names: np.ndarray, rows: np.ndarray) -> None:
        (large, large_rows), (small, small_rows) = self.levels
        small, small_rows = _merged(small, small_rows, names, rows.astype(np.int32))
        if len(small) > MERGE_WORDS:
            large, large_rows = _merged(large, large_rows, small, small_rows)
            small, small_rows = small[:0], small_rows[:0]
        self.levels = [(large, large_rows), (small, small_rows)]

    def library_ids(self, runs: list[str]) -> list[np.ndarray]:
        """Ids of each run.  Runs are joined around a mark that is a token of its own there."""
        single = [i for i, r in enumerate(runs) if MARK in r or len(self.mark) != 1]
        alone = set(single)
        joined = [i for i in range(len(runs)) if i not in alone]
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(runs)
        for i, found in zip(single, self.library.encode_batch_fast([runs[i] for i in single], add_special_tokens=False), strict=True):
            out[i] = np.array(found.ids, np.uint32)
        packs = [joined[k : k + 256] for k in range(0, len(joined), 256)]
        texts = [f" {MARK} ".join(runs[i] for i in pack) for pack in packs]
        for pack, found in zip(packs, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, np.uint32)
            parts = np.split(ids, np.flatnonzero(ids == self.mark[0]))
            if len(parts) != len(pack):  # a run held the mark's own id
                for i in pack:
                    out[i] = np.array(self.library.encode(runs[i], add_special_tokens=False).ids, np.uint32)
                continue
            for k, (i, part) in enumerate(zip(pack, parts, strict=True)):
                out[i] = part[1:] if k else part
        return out

    def rows(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cache row of each distinct word, and the word of each run."""
        if len(self.size) > CACHE_WORDS:
            self.reset()
        names, first, word = np.unique(names, return_index=True, return_inverse=True)
        row = self._find(names)
        new = np.flatnonzero(row < 0)
        if len(new):
            raw = data.tobytes()
            found = self.library_ids([raw[start[i] : end[i]].decode() for i in first[new].tolist()])
            row[new] = np.arange(len(new)) + len(self.size)
            self._keep(names[new], row[new])
            size = np.array([len(x) for x in found], np.int64)
            self.size = np.concatenate((self.size, size))
            self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(size)))
            self.flat = np.concatenate((self.flat, *found))
        return row, word

    def ids_of(self, row: np.ndarray) -> np.ndarray:
        """The ids of the cached ``row`` entries, one after the other."""
        size = self.size[row]
        shift = np.repeat(self.start[row] - (np.cumsum(size) - size), size)
        return self.flat[np.arange(len(shift)) + shift]

    def encode(self, texts: pa.Array, end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, each text followed by ``end``, and the n + 1 offsets of the texts."""
        data, at = text_buffer(texts)
        start, stop, names, offsets = words(data, at)
        row, word = self.rows(data, start, stop, names)
        size = np.concatenate(([0], np.cumsum(self.size[row][word] if len(row) else np.zeros(0, np.int64))))
        ends = size[offsets[1:]] + np.arange(len(offsets) - 1)
        out = np.empty(size[-1] + len(ends), np.uint32)
        inner = np.ones(len(out), bool)
        inner[ends] = False
        out[ends] = end
        out[inner] = self.ids_of(row[word]) if len(row) else 0
        return out, np.concatenate(([0], ends + 1))


def _merged(a: np.ndarray, a_rows: np.ndarray, b: np.ndarray, b_rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted (name, row) lists as one."""
    at = np.searchsorted(a, b)
    return np.insert(a, at, b), np.insert(a_rows, at, b_rows)


_TOKENIZERS: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per worker, so that its cache outlives a task."""
    if path not in _TOKENIZERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism; a pool per worker would only wait
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def quantized(counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies that sum to 2**bits; every id keeps at least 1, so that any text can be coded."""
    total = 1 << bits
    if len(counts) > total // 2:
        raise ValueError("more ids than the scale can hold")
    room = total - len(counts)
    weight = counts.astype(np.float64) + 1e-9
    exact = weight / weight.sum() * room
    freq = np.floor(exact).astype(np.int64)
    short = room - int(freq.sum())
    freq[np.argsort(freq - exact, kind="stable")[:short]] += 1
    return (freq + 1).astype(np.uint64)


class Coder:
    """Encodes and decodes blocks with one shared table."""

    def __init__(self, freq: np.ndarray, bits: int = SCALE_BITS) -> None:
        self.freq, self.bits = freq, np.uint64(bits)
        self.start = np.concatenate(([0], np.cumsum(freq)[:-1])).astype(np.uint64)
        self.mask = np.uint64((1 << bits) - 1)
        self.top = np.uint64(63 - bits)
        self._slots: np.ndarray | None = None

    @property
    def slots(self) -> np.ndarray:
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._slots

    def encode(self, ids: np.ndarray) -> bytes:
        """Steps are coded last to first, so that decoding reads the words forward."""
        lanes = min(LANES, max(1, len(ids)))
        steps = -(-len(ids) // lanes)
        state = np.full(lanes, LOW, np.uint64)
        words: list[np.ndarray] = []
        marks: list[tuple[int, np.ndarray]] = []
        for step in range(steps - 1, -1, -1):
            part = ids[step * lanes : (step + 1) * lanes]
            live = state[: len(part)]
            f, s = self.freq[part], self.start[part]
            over = live >= (f << self.top)
            words.append(live[over].astype(np.uint32))
            live = np.where(over, live >> SHIFT, live)
            q = live // f
            state[: len(part)] = (q << self.bits) + (live - q * f) + s
            if step % CHECKPOINT_STEPS == 0:
                marks.append((step, state.copy()))
        words.reverse()
        counts = np.array([len(w) for w in words], np.int64)
        at = np.concatenate(([0], np.cumsum(counts)))
        marks.reverse()
        body = b"".join([np.array([at[step] for step, _ in marks], "<i8").tobytes(), *(s.astype("<u8").tobytes() for _, s in marks), *(w.astype("<u4").tobytes() for w in words)])
        return MAGIC + struct.pack("<IIIQII", lanes, steps, len(marks), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body

    def decode(self, block: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of the checkpoints first..last (all: the sums are verified)."""
        head = struct.calcsize("<IIIQII")
        lanes, steps, n_marks, n, ids_sum, body_sum = struct.unpack("<IIIQII", block[4 : 4 + head])
        body = memoryview(block)[4 + head :]
        if bytes(block[:4]) != MAGIC or zlib.crc32(body) != body_sum:
            raise ValueError("a damaged block")
        whole = first == 0 and last is None
        last = n_marks if last is None else min(last, n_marks)
        if first >= last:
            return np.zeros(0, np.uint32)
        at = np.frombuffer(body, "<i8", n_marks)
        states = np.frombuffer(body, "<u8", n_marks * lanes, 8 * n_marks).reshape(n_marks, lanes)
        words = np.frombuffer(body, "<u4", -1, 8 * n_marks * (1 + lanes))
        lo, hi = first * CHECKPOINT_STEPS, min(last * CHECKPOINT_STEPS, steps)
        out = np.empty(min(hi * lanes, n) - lo * lanes, np.uint32)
        state, pos = states[first].astype(np.uint64), int(at[first])
        for step in range(lo, hi):
            width = min(lanes, n - step * lanes)
            live = state[:width]
            slot = live & self.mask
            symbol = self.slots[slot]
            out[(step - lo) * lanes : (step - lo) * lanes + width] = symbol
            live = self.freq[symbol] * (live >> self.bits) + slot - self.start[symbol]
            low = live < LOW
            need = int(np.count_nonzero(low))
            live[low] = (live[low] << SHIFT) | words[pos : pos + need]
            pos += need
            state[:width] = live
        if whole and zlib.crc32(out.tobytes()) != ids_sum:
            raise ValueError("decoded ids don't match their sum")
        return out


BLOCKS = "shard int, block int, n_docs long, n_ids long, doc_ids binary, lengths binary, payload binary"
_NAMES = [x.split()[0] for x in BLOCKS.split(", ")]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def _plain_blocks(path: str, width: str):
    """Blocks of plain ids, ``width`` a number, from rows in ascending order."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block = TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def row() -> pa.RecordBatch:
            # a null doc_id is told apart by a leading byte
            names = b"".join(struct.pack("<?q", d is None, d or 0) for d in docs)
            lengths = np.array([len(x) for x in held], "<i8").tobytes()
            values = [shard, block, len(docs), size, names, lengths, np.concatenate(held).astype(width).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, _TYPES, strict=True)], _NAMES)

        for batch in batches:
            for part in slices(batch):
                ids, at = tokenizer(path).encode(part.column("text"))
                for doc_id, a, b in zip(part.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    docs.append(doc_id)
                    held.append(ids[a:b])
                    size += b - a
                    if size >= BLOCK_IDS:
                        yield row()
                        docs, held, size, block = [], [], 0, block + 1
        if docs:
            yield row()

    return run


def id_counts(blocks: DataFrame, vocabulary: int, width: str) -> np.ndarray:
    """How often each id occurs in all plain blocks; at most a row per id reaches the driver."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for payload in batch.column("payload"):
                total += np.bincount(np.frombuffer(payload.as_buffer(), width), minlength=vocabulary)
        on = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(on), pa.array(total[on])], ["id", "k"])

    counted = blocks.select("payload").mapInArrow(run, "id long, k long").groupBy("id").agg(F.sum("k").alias("k")).toPandas()
    out = np.zeros(vocabulary, np.int64)
    out[counted["id"].to_numpy(np.int64)] = counted["k"].to_numpy(np.int64)
    return out


def _coded(freq: np.ndarray, width: str):
    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for batch in batches:
            coded = [coder.encode(np.frombuffer(x.as_buffer(), width).astype(np.uint32)) for x in batch.column("payload")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(coded, pa.binary())], _NAMES)

    return run


def write(docs: DataFrame, path: str, tokenizer_path: str, vocabulary: int, shards: int | None = None) -> np.ndarray:
    """Writes all documents in ascending doc_id order and returns the shared table.

    Texts are encoded once, into blocks of plain ids; the counts over these make
    the table with which every block is then coded on its own."""
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"
    ordered = docs.select("doc_id", "text").repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    plain_path = new_path(spark, "token-blocks")
    ordered.mapInArrow(_plain_blocks(tokenizer_path, width), BLOCKS).write.option("compression", "zstd").parquet(plain_path)
    plain = spark.read.schema(BLOCKS).parquet(plain_path)
    freq = quantized(id_counts(plain, vocabulary, width))
    plain.mapInArrow(_coded(freq, width), BLOCKS).write.option("compression", "uncompressed").parquet(path)
    remove(spark, plain_path)
    return freq


def blocks_ids(doc_ids: bytes, lengths: bytes) -> tuple[list[int | None], np.ndarray]:
    return [None if null else d for null, d in struct.iter_unpack("<?q", doc_ids)], np.frombuffer(lengths, "<i8")


def read(spark: SparkSession, path: str, freq: np.ndarray) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files at ``path``.

    The offsets of the shards are a few numbers per file; each block is decoded by
    itself, so no block waits for another."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    sizes = blocks.select("shard", "block", "n_ids")
    per_shard = sizes.groupBy("shard").agg(F.sum("n_ids").alias("k"))
    shard_start = per_shard.select("shard", (F.sum("k").over(W.orderBy("shard")) - F.col("k")).alias("shard_start"))
    within = W.partitionBy("shard").orderBy("block")
    starts = sizes.join(shard_start, "shard").select(
        "shard", "block", (F.col("shard_start") + F.sum("n_ids").over(within) - F.col("n_ids")).alias("block_start")
    )
    starts = materialize(starts, "token-starts")

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for batch in batches:
            for doc_ids, lengths, payload, start in zip(*(batch.column(c).to_pylist() for c in ("doc_ids", "lengths", "payload", "block_start")), strict=True):
                names, sizes = blocks_ids(doc_ids, lengths)
                ids = coder.decode(payload)
                ends = np.cumsum(sizes)
                sums = [zlib.crc32(memoryview(ids[e - k : e]).cast("B")) for e, k in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, pa.int64()), pa.array(start + ends - sizes), pa.array(sizes), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
                )

    return blocks.join(starts, ["shard", "block"]).select("doc_ids", "lengths", "payload", "block_start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer_path: str, vocabulary: int) -> DataFrame:
    """Writes the files of ``docs`` and reads them back."""
    spark = docs.sparkSession
    path = new_path(spark, "token-files")
    return read(spark, path, write(docs, path, tokenizer_path, vocabulary))
