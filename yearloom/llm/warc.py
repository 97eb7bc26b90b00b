"""WARC archives as a chunked record table: payloads pass as numbered chunks with running digests, never as whole records."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import bounded, new_path, tidied, write_table

CHUNK = 1 << 20
#: Bytes after which a task begins another archive.
ARCHIVE = 1 << 30
_END = b"\r\n\r\n"

ARCHIVES = "path string, records long, bytes long"
CHUNKS = "record_id string, url string, record_type string, refers_to string, declared string, full_length long, chunk long, length long, payload binary, running string, last boolean"


class Archive:
    """One archive being written: a gzip member a record, fed chunk by chunk; it gets its name when it is complete."""

    def __init__(self, folder: str, name: str, level: int):
        self.fs, path = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(path, recursive=True)
        self.part, self.path, self.uri = f"{path}/.{name}.part", f"{path}/{name}.warc.gz", f"{folder}/{name}.warc.gz"
        self.out, self.level, self.size, self.records = self.fs.open_output_stream(self.part, compression=None), level, 0, 0

    def begin(self, fields: list[tuple[str, str]]) -> None:
        self.member = zlib.compressobj(self.level, zlib.DEFLATED, 31)
        self.feed(("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode())

    def feed(self, data: bytes) -> None:
        if packed := self.member.compress(data):
            self.out.write(packed)
            self.size += len(packed)

    def finish(self) -> None:
        self.feed(_END)
        packed = self.member.flush()
        self.out.write(packed)
        self.size += len(packed)
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        self.fs.move(self.part, self.path)
        return self.uri, self.records, self.size


def _line(text: str | None) -> str:
    return " ".join((text or "").split())


def _write(folder: str, level: int, limit: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (record, chunk, chunks, payload, ...) with the chunks of a record one after another."""
    archive, done = None, []
    for batch in batches:
        cols = {c: batch.column(c) for c in batch.schema.names}
        meta = {c: cols[c].to_pylist() for c in cols if c != "payload"}
        for i in range(batch.num_rows):
            if meta["chunk"][i] == 0:
                if archive and archive.size >= limit:
                    done.append(archive.close())
                    archive = None
                archive = archive or Archive(folder, uuid.uuid4().hex, level)
                revisit = meta["refers_to"][i] is not None
                fields = [
                    ("WARC-Type", "revisit" if revisit else "response"),
                    ("WARC-Record-ID", f"<urn:page:{meta['page_id'][i]}>"),
                    ("WARC-Target-URI", _line(meta["url"][i])),
                    ("WARC-Date", "1970-01-01T00:00:00Z"),
                    ("WARC-Payload-Digest", f"sha256:{meta['digest'][i]}"),
                ]
                if revisit:
                    fields += [("WARC-Refers-To", f"<urn:page:{meta['refers_to'][i]}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
                fields += [("X-Payload-Length", str(meta["size"][i])), ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(0 if revisit else meta["size"][i]))]
                archive.begin(fields)
            if meta["refers_to"][i] is None:
                archive.feed(memoryview(cols["payload"][i].as_buffer()))
            if meta["chunk"][i] == meta["chunks"][i] - 1:
                archive.finish()
    if archive:
        done.append(archive.close())
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["path", "records", "bytes"])


def write_archives(pages: DataFrame, folder: str, level: int = 1, chunk: int = CHUNK, archive: int = ARCHIVE, least: int = 100, broadcast_rows: int = 500_000) -> DataFrame:
    """Write a record for every row of pages (page_id long, url string, html string); the archives as (path, records, bytes).

    Payloads are the html in UTF-8, null as empty. Of equal payloads of at least least bytes, the one with the
    smallest page_id (and any row that repeats this id and payload) is a response, the others revisits without payload.
    Only digests and ids are shuffled; the pages that revisit come back to the html by a broadcast if they are
    at most broadcast_rows, else by a shuffle. Payloads longer than chunk bytes are cut before they reach Python.
    Archives hold about archive bytes. A task that is run again writes new names, and only archives that its
    last run reports are listed.
    """
    pages = bounded(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("html"))
    pages = pages.withColumn("size", F.octet_length("html").cast("long"))
    ids = write_table(pages.select("page_id", "size", F.sha2("html", 256).alias("digest")), "digests")
    long = ids.where(F.col("size") >= least)
    first = long.groupBy("digest", "size").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("other")).where("refers_to <> other")
    again = write_table(long.join(first.drop("other"), ["digest", "size"]).where("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct(), "revisits")
    again = F.broadcast(again) if again.count() <= broadcast_rows else again
    # the digest is part of the key: rows with the same id may have other payloads
    rows = pages.withColumn("digest", F.sha2("html", 256)).join(again, ["page_id", "digest"], "left")
    revisit = F.col("refers_to").isNotNull()
    rows = rows.withColumn("chunks", F.when(revisit, F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("size") / chunk))).cast("long"))
    rows = rows.withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1L)")))
    payload = F.when(revisit, F.lit(b"")).when(F.col("chunks") == 1, F.col("html")).otherwise(F.expr(f"substring(html, cast(chunk * {chunk} + 1 as int), {chunk})"))
    rows = rows.select("page_id", "url", "digest", "size", "refers_to", "chunks", "chunk", payload.alias("payload"))
    return write_table(rows.mapInArrow(tidied(partial(_write, folder, level, archive)), ARCHIVES), "archives")


class _Bytes:
    """The decompressed bytes of one archive, in pieces of at most block bytes."""

    def __init__(self, stream, block: int):
        self.stream, self.block, self.held, self.member, self.rest = stream, block, b"", None, b""

    def more(self) -> bool:
        while True:
            if not self.rest:
                self.rest = self.stream.read(self.block)
                if not self.rest:
                    return False
            self.member = self.member or zlib.decompressobj(31)
            got = self.member.decompress(self.rest, self.block)
            self.rest = self.member.unconsumed_tail
            if self.member.eof:
                self.rest, self.member = self.member.unused_data, None
            if got:
                self.held += got
                return True

    def head(self) -> bytes | None:
        while (at := self.held.find(_END)) < 0:
            if not self.more():
                if self.held:
                    raise ValueError("an archive ends within a record")
                return None
        out, self.held = self.held[:at], self.held[at + 4 :]
        return out

    def take(self, n: int) -> bytes:
        """Between 1 and n bytes that come next."""
        if not self.held and not self.more():
            raise ValueError("an archive ends within a record")
        out, self.held = self.held[:n], self.held[n:]
        return out

    def exactly(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            out += self.take(n - len(out))
        return out


def _read(block: int, payloads: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    kinds = [pa.string()] * 5 + [pa.int64()] * 3 + [pa.binary(), pa.string(), pa.bool_()]
    rows: list[tuple] = []
    weight = 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        for uri in batch.column("path").to_pylist():
            files, path = fs.FileSystem.from_uri(uri)
            with files.open_input_stream(path, compression=None) as stream:
                data = _Bytes(stream, block)
                while (head := data.head()) is not None:
                    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
                    refers = fields.get("WARC-Refers-To")
                    fixed = (fields["WARC-Record-ID"], fields["WARC-Target-URI"], fields["WARC-Type"], refers, fields["WARC-Payload-Digest"].removeprefix("sha256:"), int(fields["X-Payload-Length"]))
                    left, number, digest = int(fields["Content-Length"]), 0, hashlib.sha256()
                    while left or not number:
                        piece = data.take(min(left, block)) if left else b""
                        left -= len(piece)
                        digest.update(piece)
                        running = digest.copy().hexdigest()
                        if not left and fixed[2] == "response" and running != fixed[4]:
                            raise ValueError(f"{fixed[0]} in {uri}: the payload doesn't have the digest declared")
                        rows.append((*fixed, number, len(piece), piece if payloads else None, running, not left))
                        weight += len(piece) * payloads + 400
                        number += 1
                        if weight >= 8 << 20:
                            yield flush()
                            rows.clear()
                            weight = 0
                    if data.exactly(4) != _END:
                        raise ValueError(f"{fixed[0]} in {uri}: no end of record")
    if rows:
        yield flush()


def read_archives(archives: DataFrame, block: int = CHUNK, payloads: bool = True) -> DataFrame:
    """The records of archives (path string) as rows of chunks: ids, declared digest and length, chunk number, bytes, digest so far.

    A chunk holds at most block bytes; an empty payload is one empty chunk. With payloads off the bytes are
    read and digested but not returned. A payload whose digest isn't the one declared fails the read.
    """
    n = max(1, min(archives.count(), 100_000))
    paths = archives.select("path").repartition(n, "path")
    return paths.mapInArrow(tidied(partial(_read, block, payloads)), CHUNKS)


def round_trip(spark: SparkSession, pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of all pages, read back from archives in the shared folder.

    See write_archives. Length and digest of a response are those of the bytes read; those of a revisit are declared
    in its record, as its full payload isn't there. A row with a null page_id keeps it; an empty table gives no rows.
    """
    archives = write_archives(pages, new_path(spark, "warc"), least=least)
    chunks = read_archives(archives, payloads=False)
    whole = chunks.where("last").select(
        F.regexp_extract("record_id", r"^<urn:page:(-?\d+)>$", 1).try_cast("long").alias("page_id"),
        F.col("full_length").alias("payload_bytes"),
        F.when(F.col("record_type") == "response", F.col("running")).otherwise(F.col("declared")).alias("payload_digest"),
        "record_type",
        F.regexp_extract("refers_to", r"^<urn:page:(-?\d+)>$", 1).try_cast("long").alias("refers_to"),
    )
    return whole
