"""WARC archives, and the normaliser of monolithic gzip files.

``write`` makes one gzip stream per archive, the form that can't be entered in
the middle.  ``normalise`` inflates such a stream once, front to back in bounded
memory, rewrites every record as a gzip member of its own and writes a sidecar
index of offsets and lengths.  ``read`` then fetches single members by index.

Files are written through Arrow's file systems below the shared folder, under a
temporary name that is moved into place, so a repeated task replaces its file.

Defined results: null html is an empty payload; a null url becomes
``about:blank``; rows that repeat the page_id of a response are responses too; a
null page_id is kept; other columns are ignored; no rows make no archive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialize, new_path

DATE = "2000-01-01T00:00:00Z"
ARCHIVE_BYTES = 256 << 20
CHUNK = 1 << 20
LEVEL = 6
MIN_BYTES = 0


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head of the full payload and no body."""
    name = "null" if page_id is None else page_id
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields and raw bytes of each record of an uncompressed stream."""
    held, done = bytearray(), False
    while True:
        while (end := held.find(b"\r\n\r\n")) < 0 and not done:
            piece = next(chunks, None)
            done = piece is None
            held += piece or b""
        if end < 0:
            if held.strip():
                raise ValueError("a record's head is cut off")
            return
        head = fields(bytes(held[:end]))
        size = end + 4 + int(head["content-length"]) + 4
        while len(held) < size and not done:
            piece = next(chunks, None)
            done = piece is None
            held += piece or b""
        if len(held) < size:
            raise ValueError("a record is cut off")
        yield head, bytes(held[:size])
        del held[:size]


def inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members, in pieces."""
    engine, started = zlib.decompressobj(31), False
    while data := source.read(CHUNK):
        while data:
            started = True
            piece = engine.decompress(data, CHUNK)
            if piece:
                yield piece
            if engine.eof:
                data, engine, started = engine.unused_data, zlib.decompressobj(31), False
            else:
                data = engine.unconsumed_tail
    if started:
        while not engine.eof:  # what the engine still holds
            piece = engine.decompress(b"", CHUNK)
            if not piece:
                raise ValueError("a gzip stream is cut off")
            yield piece


def normalise_file(source, target, level: int = LEVEL) -> Iterator[dict]:
    """Rewrites ``source`` member by member and yields the index entries."""
    offset = 0
    for head, raw in records(inflated(source)):
        engine = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = engine.compress(raw) + engine.flush()
        target.write(member)
        yield {"offset": offset, "length": len(member), "id": head.get("warc-record-id", ""), "type": head.get("warc-type", ""), "uri": head.get("warc-target-uri", "")}
        offset += len(member)


def with_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, html, refers_to: the largest page_id of equal payloads, where that is another page."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("html"))
    keyed = pages.select("page_id", F.sha1(payload).alias("sha"), F.octet_length(payload).alias("size")).where(F.col("size") >= min_bytes)
    keyed = materialize(keyed.drop("size"), "warc-digests")
    kept = keyed.groupBy("sha").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    again = keyed.join(kept, "sha").where("page_id <> keep").groupBy("page_id", "sha").agg(F.max("keep").alias("refers_to"))
    again = materialize(again, "warc-revisits")
    r, a = rows.withColumn("sha", F.sha1("html")).alias("r"), again.alias("a")
    return r.join(a, (F.col("r.page_id") == F.col("a.page_id")) & (F.col("r.sha") == F.col("a.sha")), "left").select("r.page_id", "r.url", "r.html", "a.refers_to")


def write(rows: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Writes monolithic archives of ``with_revisits`` rows; returns their paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, out = TaskContext.get().partitionId(), 0, None
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        done: list[str] = []

        def close() -> None:
            out.write(engine.flush())
            out.close()
            fs.move(temp, final)
            done.append(final)

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    final = f"{root}/part-{task:06d}-{number:04d}.warc.gz"
                    temp = f"{final}.{uuid.uuid4().hex}.tmp"
                    out, engine, size, number = fs.open_output_stream(temp, compression=None), zlib.compressobj(level, zlib.DEFLATED, 31), 0, number + 1
                raw = record(row["page_id"], row["url"], row["html"].encode(), row["refers_to"], row["refers_to"] is not None)
                out.write(engine.compress(raw))
                size += len(raw)
                if size >= ARCHIVE_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.string())], ["path"])

    return materialize(rows.mapInArrow(run, "path string"), "warc-archives")


def normalise(archives: DataFrame, folder: str, level: int = LEVEL) -> DataFrame:
    """Rewrites every archive; returns path, index, records of the new files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                final = f"{root}/{path.rsplit('/', 1)[1].removesuffix('.warc.gz')}.normal.warc.gz"
                index, mark, n = f"{final}.idx", uuid.uuid4().hex, 0
                with fs.open_input_stream(path, compression=None) as source, fs.open_output_stream(f"{final}.{mark}.tmp", compression=None) as target, fs.open_output_stream(f"{index}.{mark}.tmp", compression=None) as side:
                    for entry in normalise_file(source, target, level):
                        side.write(json.dumps(entry).encode() + b"\n")
                        n += 1
                fs.move(f"{final}.{mark}.tmp", final)
                fs.move(f"{index}.{mark}.tmp", index)
                yield pa.RecordBatch.from_arrays([pa.array([final]), pa.array([index]), pa.array([n])], ["path", "index", "records"])

    spread = archives.repartition(max(1, int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return materialize(spread.mapInArrow(run, "path string, index string, records long"), "warc-normal")


RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _named(value: str) -> int | None:
    name = value.strip("<>").removeprefix("urn:page:")
    return None if name == "null" else int(name)


def parsed(member: bytes) -> tuple[int | None, int, str, str, int | None]:
    """A record's row; digests and lengths are checked against what it holds."""
    (head, raw), *more = records(iter([zlib.decompress(member, 31)]))
    if more:
        raise ValueError("a member holds more than one record")
    block = raw[raw.index(b"\r\n\r\n") + 4 : -4]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).split(":")[1])
    said = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "response" and (len(payload) != size or digest(payload) != said):
        raise ValueError("a payload doesn't match its digest")
    refers = head.get("warc-refers-to")
    return _named(head["warc-record-id"]), size, said, head["warc-type"], _named(refers) if refers else None


def read(normal: DataFrame, folder: str) -> DataFrame:
    """One row per record, each member fetched by its index entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(folder)
        for batch in batches:
            for path, index in zip(batch.column("path").to_pylist(), batch.column("index").to_pylist(), strict=True):
                with fs.open_input_file(path) as source, fs.open_input_stream(index, compression=None) as side:
                    rows = []
                    for line in side.read().splitlines():
                        entry = json.loads(line)
                        source.seek(entry["offset"])
                        rows.append(parsed(source.read(entry["length"])))
                        if len(rows) == 5000:
                            yield _batch(rows)
                            rows = []
                    if rows:
                        yield _batch(rows)

    spread = normal.repartition(max(1, int(normal.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return spread.mapInArrow(run, RESULT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [x.split()[0] for x in RESULT.split(", ")])


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes archives of ``pages``, normalises them and reads them back."""
    folder = new_path(pages.sparkSession, "warc")
    return read(normalise(write(with_revisits(pages), f"{folder}/whole"), f"{folder}/whole"), f"{folder}/whole")
