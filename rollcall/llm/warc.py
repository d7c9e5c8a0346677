"""WARC archives written from, and read back as, a chunked record table.

A payload travels as rows (record, chunk number, data) of at most ``CHUNK`` bytes, in order, with digests that grow
chunk by chunk, so no Python task ever holds a whole record. Writing takes two passes: one computes length and digests
of every payload without a shuffle and finds, for each payload, the record that carries it; the other deals the chunk
rows, each record's headed by a row of its header fields, over the archives and writes them as they come. Records are
gzip members of their own. Reading streams an archive per task, recomputes each payload's digest, and hands on chunk
rows or one row a record.

A task names its files at random and only reports those it finished; the stored report is the archive's table of
contents. A lost or repeated task therefore leaves files nobody reads, never half an archive or a record twice. Files
are opened through ``pyarrow.fs``, so the folder may be local to all, on HDFS or in an object store.

Defined cases: a null payload is empty; a null key has no header and never wins a tie against another key; of rows
equal in key and payload the first carries it; a null URI has no header, white space and control characters in one are
percent-encoded; an empty table gives no archive and no rows; other columns are not read, whatever their names. A
string cell is in memory as a whole in Spark itself (2 GB at most), its chunks from there on are not.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlparse
from uuid import UUID, uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.llm.storage import numbered, settle, shared_folder
from rollcall.llm.streams import tidy

CHUNK = 1 << 20
# A file is closed after this many bytes, at the end of a record.
ARCHIVE_BYTES = 1 << 30
# Longest line of a header, and longest HTTP head looked for in a record's block.
LINE = 1 << 20
HTTP_HEAD = 1 << 16
# Rows and bytes of chunk rows handed on together.
ROWS = 1000
BYTES = 4 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

RECORDS = "record_id string, key string, target_uri string, record_type string, refers_to_id string, refers_to string, payload_bytes long, payload_digest string, digest_matches boolean"


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def chunked(df: DataFrame, payload: str = "payload", size: int = CHUNK) -> DataFrame:
    """``df`` without ``payload``, one row per chunk of it: ``chunk`` from 0, in order, and ``data``. An empty or null
    payload has one empty chunk."""
    others = [c for c in df.columns if c != payload]
    raw = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    last = F.floor((F.greatest(F.octet_length(raw), F.lit(1)) - 1) / size).cast("int")
    parts = df.withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    return parts.select(*others, "chunk", F.substring(raw, F.col("chunk") * size + 1, F.lit(size)).alias("data"))


def digests(chunks: DataFrame) -> DataFrame:
    """``row``, ``key`` and ``uri`` of each record, with payload_bytes, sha1 and sha256 over its chunks, which follow
    one another in a partition."""

    def run(batches):
        held = None
        for batch in batches:
            done = {n: [] for n in ("row", "key", "uri", "payload_bytes", "sha1", "sha256")}

            def close(record):
                for n, v in zip(done, [*record[:4], record[4].digest(), record[5].digest()], strict=True):
                    done[n].append(v)

            rows, keys, uris, numbers = (batch.column(n).to_pylist() for n in ("row", "key", "uri", "chunk"))
            data = batch.column("data")
            for i, number in enumerate(numbers):
                if not number:
                    if held:
                        close(held)
                    held = [rows[i], keys[i], uris[i], 0, hashlib.sha1(usedforsecurity=False), hashlib.sha256()]
                piece = data[i].as_buffer()
                held[3] += piece.size
                held[4].update(piece)
                held[5].update(piece)
            yield _batch(done, DIGESTS)
        if held:
            yield _batch({n: [v] for n, v in zip(DIGESTS.names, [*held[:4], held[4].digest(), held[5].digest()], strict=True)}, DIGESTS)

    return chunks.select("row", "key", "uri", "chunk", "data").mapInArrow(tidy(run), "row long, key string, uri string, payload_bytes long, sha1 binary, sha256 binary")


DIGESTS = pa.schema({"row": pa.int64(), "key": pa.string(), "uri": pa.string(), "payload_bytes": pa.int64(), "sha1": pa.binary(), "sha256": pa.binary()})


def _batch(columns: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def write(df: DataFrame, key: str, uri: str, payload: str, folder: str | None = None, revisit_from: int = 0, date: str = DATE, level: int = 6, chunk: int = CHUNK, archive: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes one record per row of ``df``; returns the table of contents (path, records, bytes).

    Of records with equal payloads of at least ``revisit_from`` bytes, the one with the largest ``key`` is a response,
    the others are revisits of it; smaller ones are all responses. ``df`` is read twice, so pass a stored table.
    """
    folder = folder or f"{shared_folder(df.sparkSession)}/warc-{uuid4().hex}"
    source = numbered(df.select(F.col(key).alias("order"), F.col(uri).cast("string").alias("uri"), F.col(payload).alias("payload")), "row")
    chunks = chunked(source, size=chunk)
    found = settle(digests(chunks.withColumn("key", F.col("order").cast("string"))).withColumn("order", F.col("key").cast(df.schema[key].dataType)))
    same = ["sha256", "payload_bytes"]
    # Equal payloads agree in length and SHA-256. Only those that occur more than once have a carrier to look up.
    carriers = found.where(F.col("payload_bytes") >= revisit_from).groupBy(*same).agg(F.max(F.struct("order", -F.col("row"))).alias("best"), F.count("*").alias("n"))
    carriers = settle(carriers.where("n > 1").select(*same, F.col("best.order").cast("string").alias("refers_to"), (-F.col("best.col2")).alias("refers_row")))
    heads = found.join(carriers, same, "left").select(
        "row",
        F.lit(-1).alias("chunk"),
        "key",
        "uri",
        "payload_bytes",
        "sha1",
        F.when(F.col("refers_row") != F.col("row"), F.col("refers_row")).alias("refers_row"),
        "refers_to",
    )
    together = heads.unionByName(chunks.select("row", "chunk", "data"), allowMissingColumns=True)

    def run(batches):
        out = _Archives(folder, date, level, archive)
        for batch in batches:
            numbers, data = batch.column("chunk").to_pylist(), batch.column("data")
            for i, number in enumerate(numbers):
                if number < 0:
                    out.begin({n: batch.column(n)[i].as_py() for n in ("row", "key", "uri", "payload_bytes", "sha1", "refers_row", "refers_to")})
                elif out.carries:
                    out.add(data[i].as_buffer())
        done = out.close()
        yield pa.RecordBatch.from_pydict({"path": [d[0] for d in done], "records": [d[1] for d in done], "bytes": [d[2] for d in done]}, pa.schema({"path": pa.string(), "records": pa.int64(), "bytes": pa.int64()}))

    dealt = together.repartition("row").sortWithinPartitions("row", "chunk")
    return settle(dealt.mapInArrow(tidy(run), "path string, records long, bytes long"))


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or local path, and the path on it."""
    scheme = urlparse(uri).scheme
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(urlparse(uri).path) if scheme else uri
    return fs.FileSystem.from_uri(uri)


def _line(name: str, value) -> bytes:
    return b"" if value is None else f"{name}: {value}\r\n".encode()


def _one_line(uri: str | None) -> str | None:
    """``uri`` with white space and control characters percent-encoded."""
    return uri and "".join(quote(c) if c.isspace() or c < " " or c == "\x7f" else c for c in uri)


def _quoted(key: str | None) -> str | None:
    return key and quote(key)


def record_urn(row: int) -> str:
    return f"<{UUID(int=row).urn}>"


class _Archives:
    """The files one task writes, a new one once the last is long enough."""

    def __init__(self, folder: str, date: str, level: int, most: int):
        self.folder, self.date, self.level, self.most = folder, date, level, most
        self.done: list[tuple[str, int, int]] = []
        self.stream = self.member = None
        self.carries = False

    def _put(self, data) -> None:
        packed = self.member.compress(data)
        self.bytes += len(packed)
        self.stream.write(packed)

    def _begin_member(self) -> None:
        self.member = zlib.compressobj(self.level, wbits=31)

    def _end_member(self) -> None:
        self._put(b"\r\n\r\n")
        packed = self.member.flush()
        self.bytes += len(packed)
        self.stream.write(packed)
        self.member = None

    def _open(self) -> None:
        store, path = filesystem(self.folder)
        store.create_dir(path, recursive=True)
        self.name = f"{uuid4().hex}.warc.gz"
        self.stream = store.open_output_stream(f"{path}/{self.name}", compression=None)
        self.bytes = self.records = 0
        info = b"format: WARC File Format 1.1\r\n"
        self._begin_member()
        self._put(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n" + _line("WARC-Record-ID", f"<{uuid4().urn}>") + _line("WARC-Date", self.date) + _line("WARC-Filename", self.name) + b"Content-Type: application/warc-fields\r\n" + _line("Content-Length", len(info)) + b"\r\n" + info)
        self._end_member()

    def _finish(self) -> None:
        if self.stream:
            if self.member:
                self._end_member()
            self.stream.close()
            self.done.append((f"{self.folder}/{self.name}", self.records, self.bytes))
            self.stream = None

    def begin(self, head: dict) -> None:
        if self.member:
            self._end_member()
        if self.stream and self.bytes >= self.most:
            self._finish()
        if not self.stream:
            self._open()
        self.records += 1
        self.carries = head["refers_row"] is None
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {head['payload_bytes']}\r\n\r\n".encode()
        fields = b"WARC/1.1\r\n" + _line("WARC-Type", "response" if self.carries else "revisit")
        fields += _line("WARC-Record-ID", record_urn(head["row"])) + _line("WARC-Date", self.date) + _line("WARC-Target-URI", _one_line(head["uri"]))
        fields += _line("WARC-Payload-Digest", f"sha1:{base32(head['sha1'])}") + _line("X-Key", _quoted(head["key"]))
        if not self.carries:
            fields += _line("WARC-Profile", REVISIT) + _line("WARC-Refers-To", record_urn(head["refers_row"])) + _line("X-Refers-To-Key", _quoted(head["refers_to"]))
        fields += b"Content-Type: application/http; msgtype=response\r\n"
        self._begin_member()
        self._put(fields + _line("Content-Length", len(http) + (head["payload_bytes"] if self.carries else 0)) + b"\r\n" + http)

    def add(self, piece) -> None:
        self._put(piece)

    def close(self) -> list[tuple[str, int, int]]:
        self._finish()
        return self.done


class _Bytes:
    """A stream of blocks read by line or by length."""

    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.held, self.at = blocks, b"", 0

    def _more(self) -> bool:
        block = next(self.blocks, None)
        if block is None:
            return False
        self.held, self.at = self.held[self.at :] + block, 0
        return True

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the stream."""
        while (end := self.held.find(b"\n", self.at)) < 0:
            if len(self.held) - self.at > LINE:
                raise ValueError("a header line is too long")
            if not self._more():
                if self.at < len(self.held):
                    raise ValueError("the archive ends within a line")
                return None
        found, self.at = self.held[self.at : end], end + 1
        return found.rstrip(b"\r")

    def peek(self, n: int) -> bytes:
        while len(self.held) - self.at < n and self._more():
            pass
        return self.held[self.at : self.at + n]

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in pieces of at most ``CHUNK``."""
        while n:
            if self.at == len(self.held) and not self._more():
                raise ValueError("the archive ends within a record")
            piece = self.held[self.at : self.at + min(n, CHUNK)]
            self.at += len(piece)
            n -= len(piece)
            yield piece


def _blocks(stream) -> Iterator[bytes]:
    """A file's bytes, gzip members or plain, in blocks of at most ``CHUNK``."""
    block = stream.read(CHUNK >> 2)
    if block[:2] != b"\x1f\x8b":
        while block:
            yield block
            block = stream.read(CHUNK >> 2)
        return
    member = zlib.decompressobj(31)
    while block:
        if member.eof:
            member = zlib.decompressobj(31)
        out = member.decompress(block, CHUNK)
        if out:
            yield out
        block = member.unused_data if member.eof else member.unconsumed_tail
        block = block or stream.read(CHUNK >> 2)
    if not member.eof:
        raise ValueError("the archive ends within a gzip member")


def _fields(source: _Bytes) -> dict[str, str]:
    out = {}
    while line := source.line():
        name, _, value = line.partition(b":")
        out[name.decode().strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def _records(source: _Bytes) -> Iterator[tuple[dict, Iterator[bytes]]]:
    """Header fields of each record (with ``http`` fields under ``http:``) and its payload in pieces, to be read
    before the next record is asked for."""
    while (line := source.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = _fields(source)
        left = int(fields["content-length"])
        if fields.get("content-type", "").startswith("application/http"):
            head = source.peek(min(left, HTTP_HEAD))
            if (end := head.find(b"\r\n\r\n")) >= 0:
                left -= end + 4
                source.line()
                fields |= {f"http:{n}": v for n, v in _fields(source).items()}
        yield fields, source.take(left)


def _read(contents: DataFrame, rows_of, schema: pa.Schema, ddl: str) -> DataFrame:
    n = contents.count()
    paths = contents.select("path").repartitionByRange(max(1, n), "path")

    def run(batches):
        held, size = {n: [] for n in schema.names}, 0
        for batch in batches:
            for uri in batch.column("path").to_pylist():
                store, path = filesystem(uri)
                with store.open_input_stream(path, compression=None) as stream:
                    for row in rows_of(_records(_Bytes(_blocks(stream)))):
                        for name, value in zip(held, row, strict=True):
                            held[name].append(value)
                        size += len(row[-1] or b"") if schema.names[-1] == "data" else 0
                        if len(held["record_id"]) >= ROWS or size > BYTES:
                            yield _batch(held, schema)
                            held, size = {n: [] for n in schema.names}, 0
        yield _batch(held, schema)

    return paths.mapInArrow(tidy(run), ddl)


def _described(fields: dict) -> tuple:
    return fields.get("warc-record-id"), _unquoted(fields.get("x-key")), fields.get("warc-target-uri"), fields.get("warc-type"), fields.get("warc-refers-to"), _unquoted(fields.get("x-refers-to-key"))


def _unquoted(value: str | None) -> str | None:
    return value and unquote(value)


def _stated(fields: dict) -> str | None:
    kind, _, value = fields.get("warc-payload-digest", "").partition(":")
    return value if kind.lower() == "sha1" else None


def _whole(records) -> Iterator[tuple]:
    for fields, pieces in records:
        sha1, n = hashlib.sha1(usedforsecurity=False), 0
        for piece in pieces:
            sha1.update(piece)
            n += len(piece)
        if fields.get("warc-type") == "revisit":
            length = fields.get("http:content-length")
            yield *_described(fields), int(length) if length else None, _stated(fields), None
        elif fields.get("warc-type") != "warcinfo":
            found = base32(sha1.digest())
            yield *_described(fields), n, found, None if _stated(fields) is None else _stated(fields) == found


def _in_chunks(records, size: int) -> Iterator[tuple]:
    for fields, pieces in records:
        if fields.get("warc-type") == "warcinfo":
            for _ in pieces:
                pass
            continue
        sha1, number, waiting, name = hashlib.sha1(usedforsecurity=False), 0, b"", fields.get("warc-record-id")
        for piece in pieces:
            waiting += piece
            while len(waiting) > size:
                sha1.update(waiting[:size])
                yield name, number, False, base32(sha1.digest()), waiting[:size]
                waiting, number = waiting[size:], number + 1
        sha1.update(waiting)
        yield name, number, True, base32(sha1.digest()), waiting


_RECORDS = pa.schema(
    {
        **{n: pa.string() for n in ("record_id", "key", "target_uri", "record_type", "refers_to_id", "refers_to")},
        "payload_bytes": pa.int64(),
        "payload_digest": pa.string(),
        "digest_matches": pa.bool_(),
    }
)
_CHUNKS = pa.schema({"record_id": pa.string(), "chunk": pa.int32(), "last": pa.bool_(), "digest_so_far": pa.string(), "data": pa.binary()})


def read_records(contents: DataFrame) -> DataFrame:
    """One row per record of the archives named in ``contents`` (path): ids, type, length and SHA-1 of the payload.

    Length and digest of a response are those of the bytes read; ``digest_matches`` compares with the header's, null
    where it has none. A revisit's are those its header states. A damaged archive fails the job.
    """
    return _read(contents, _whole, _RECORDS, RECORDS)


def read_chunks(contents: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """The chunk rows of all records: record_id, chunk, data, the payload's digest up to and with this chunk, and
    whether it is the last. A revisit has one empty chunk."""
    return _read(contents, lambda records: _in_chunks(records, chunk), _CHUNKS, "record_id string, chunk int, last boolean, digest_so_far string, data binary")
