"""WARC: archives written as one gzip stream each, normalised to one member per record, with an offset index.

write_archives puts records into WARC 1.1 files of about FILE_BYTES, each a single gzip stream (as some
crawlers leave them). normalise inflates such a file once, from start to end in bounded pieces, and
rewrites every record as a gzip member of its own beside a sidecar index (JSON lines: record id, type,
target, offset, length); afterwards one record can be read by a seek. read_archives reads normalised
files by their indexes. Files live in a folder that all executors share, reached through the file
systems of Arrow. Every attempt of a task writes files of its own names, and only the names that Spark
takes from the attempt that counts are read on: what another attempt has left is never looked at, so a task
may be run again or twice, with its rows in any order.

Payloads that occur more than once and have REVISIT_BYTES or more are stored once: the page with the
largest id is the response, the others are revisit records that refer to it.

Cases: null payload is empty; null ids are below all others; pages that agree in id and payload are all
responses where that id is the largest. A payload is one value of a row, so it has to fit in a task's memory
once; it is compressed, inflated and hashed in pieces. Columns other than the three named are not used. No
pages, no files.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from io import BytesIO

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

REVISIT_BYTES, FILE_BYTES, PIECE = 1000, 32 << 20, 1 << 18
DATE = "1970-01-01T00:00:00Z"
_SPACE = uuid.UUID("8d3f8b9e-6f0e-5c1c-9a53-0c5d5c1a7a11")


def record_id(page: str | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, 'no id' if page is None else 'id ' + page)}>"


def record(page: str | None, url: str | None, payload: bytes, digest: str, size: int, refers: str | None) -> Iterator[bytes]:
    """Pieces of a response record, or of a revisit record if it refers to another page."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    own = b"" if refers is not None else payload
    fields = [("WARC-Type", "response" if refers is None else "revisit"), ("WARC-Record-ID", record_id(page)), ("WARC-Date", DATE)]
    if url:
        fields.append(("WARC-Target-URI", " ".join(url.split())))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(size))]
    if page is not None:
        fields.append(("X-Page-Id", page))
    if refers is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers)), ("X-Refers-To-Page", refers)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(head) + len(own)))]
    yield b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + head
    for at in range(0, len(own), PIECE):
        yield own[at : at + PIECE]
    yield b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def inflate(stream: object) -> Iterator[bytes]:
    """Pieces of what a gzip file of one or more members holds."""
    machine = zlib.decompressobj(31)
    while raw := stream.read(PIECE):
        while raw:
            yield machine.decompress(raw)
            raw = machine.unused_data
            if machine.eof:
                machine = zlib.decompressobj(31)
    if tail := machine.flush():
        yield tail


def normalise(source: object, target: object) -> Iterator[dict]:
    """Rewrite each record of a gzip stream as its own member; yields the index's entries.

    The whole stream is inflated once. No more than a piece of input and one record's header are held;
    a record's block goes through in pieces.
    """
    pieces, held = inflate(source), bytearray()

    def more() -> bool:
        for piece in pieces:
            if piece:
                held.extend(piece)
                return True
        return False

    at = 0
    while True:
        while (end := held.find(b"\r\n\r\n")) < 0 and more():
            pass
        if end < 0:
            if held.strip():
                raise ValueError("the archive ends within a record")
            return
        head = bytes(held[: end + 4])
        fields = parse_head(head)
        left = int(fields["content-length"]) + 4
        del held[: end + 4]
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        out = packer.compress(head)
        size = len(out)
        target.write(out)
        while left:
            if not held and not more():
                raise ValueError("the archive ends within a record")
            out = packer.compress(bytes(held[:left]))
            target.write(out)
            size += len(out)
            taken = min(left, len(held))
            del held[:taken]
            left -= taken
        out = packer.flush()
        target.write(out)
        size += len(out)
        yield {"id": fields["warc-record-id"], "type": fields["warc-type"], "target": fields.get("warc-target-uri"), "offset": at, "length": size}
        at += size


def read_member(raw: bytes) -> tuple[dict[str, str], Iterator[bytes]]:
    """Fields of a record that is a member of its own, and pieces of its payload."""
    pieces, held = inflate(BytesIO(raw)), b""
    while b"\r\n\r\n" not in held:
        held += next(pieces)
    head, _, rest = held.partition(b"\r\n\r\n")
    fields = parse_head(head)

    def payload() -> Iterator[bytes]:
        left, block = int(fields["content-length"]), rest
        while b"\r\n\r\n" not in block:
            block += next(pieces)
        http, _, body = block.partition(b"\r\n\r\n")
        left -= len(http) + 4
        while True:
            yield body[:left]
            left -= len(body[:left])
            if not left:
                return
            body = next(pieces)

    return fields, payload()


def open_fs(folder: str) -> tuple[pa.fs.FileSystem, str]:
    """An Arrow file system and the path in it; local paths are taken as they are."""
    return pa.fs.FileSystem.from_uri(folder if "://" in folder else "file://" + (folder[5:] if folder.startswith("file:") else folder))


def with_revisits(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = REVISIT_BYTES) -> DataFrame:
    """page (id as string, or null), url, payload, digest (SHA-1), size, refers (page of the response, for revisits)."""
    rows = pages.select(F.col(page_id).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    top = rows.where(F.col("size") >= least).groupBy("digest").agg(F.max("id").alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("d"), "top")
    found = rows.join(top, rows["digest"] == top["d"], "left")
    name = lambda c: F.col(c).cast("string")
    return found.select(name("id").alias("page"), "url", "payload", "digest", F.col("size").cast("long").alias("size"), F.when(F.col("d").isNotNull() & ~F.col("id").eqNullSafe(F.col("top")), name("top")).alias("refers"))


def write_archives(records: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write records (page, url, payload, digest, size, refers) as gzip streams; one row (file, records) for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        files: list[tuple[str, int]] = []
        out = packer = None
        written = count = 0

        def named() -> str:
            return f"{base}/part-{part:06d}-{attempt}-{len(files):04d}.mono.warc.gz"

        def close() -> None:
            nonlocal out
            out.write(packer.flush())
            out.close()
            files.append((named(), count))
            out = None

        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    out = fs.open_output_stream(named(), compression=None)
                    packer, written, count = zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                for piece in record(r["page"], r["url"], r["payload"], r["digest"], r["size"], r["refers"]):
                    data = packer.compress(piece)
                    out.write(data)
                    written += len(data)
                count += 1
                if written >= file_bytes:
                    close()
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in files], pa.string()), pa.array([n for _, n in files], pa.int64())], names=["file", "records"])

    return records.select("page", "url", "payload", "digest", "size", "refers").mapInArrow(run, "file string, records long")


def normalise_archives(files: DataFrame, folder: str) -> DataFrame:
    """Normalise each file (column file); rows (file, index, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(folder)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            rows = []
            for name in common.column(batch, "file").to_pylist():
                target = f"{name.removesuffix('.gz').removesuffix('.warc').removesuffix('.mono')}-{attempt}.warc.gz"
                index, n = target + ".idx", 0
                with fs.open_input_stream(name, compression=None) as source, fs.open_output_stream(target, compression=None) as out, fs.open_output_stream(index, compression=None) as entries:
                    for entry in normalise(source, out):
                        entries.write(json.dumps(entry).encode() + b"\n")
                        n += 1
                rows.append((target, index, n))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["file", "index", "records"])

    return files.select("file").mapInArrow(run, "file string, index string, records long")


def read_archives(files: DataFrame, folder: str) -> DataFrame:
    """Every record of normalised archives, read by the offsets of their indexes: page, type, digest, size, refers, and the payload's own digest and size."""
    schema = "page string, record_type string, digest string, size long, refers string, own_digest string, own_size long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(folder)
        kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = ["page", "record_type", "digest", "size", "refers", "own_digest", "own_size"]
        for batch in batches:
            for name, index in zip(common.column(batch, "file").to_pylist(), common.column(batch, "index").to_pylist(), strict=True):
                rows = []
                with fs.open_input_stream(index, compression=None) as f:
                    entries = f.read()
                with fs.open_input_file(name) as data:
                    for line in BytesIO(entries):
                        entry = json.loads(line)
                        data.seek(entry["offset"])
                        fields, payload = read_member(data.read(entry["length"]))
                        own, size = hashlib.sha1(), 0
                        for piece in payload:
                            own.update(piece)
                            size += len(piece)
                        whole = fields["warc-type"] == "response"
                        rows.append((fields.get("x-page-id"), fields["warc-type"], fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"]), fields.get("x-refers-to-page"), own.hexdigest() if whole else None, size if whole else None))
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], names=names)
                            rows = []
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], names=names)

    return files.select("file", "index").mapInArrow(run, schema)


def archive(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write pages to normalised archives in folder; rows (file, index, records), of files that are there when this returns."""
    spark = pages.sparkSession
    common.bound_batches(spark)
    make_folder(spark, folder)
    mono, names = common.materialize(write_archives(with_revisits(pages, page_id, url, html), folder, file_bytes), "warc-files")
    made = common.materialize(normalise_archives(_spread(mono), folder), "warc-index")[0]
    _spread(mono).mapInArrow(_delete(folder), "file string").write.format("noop").mode("overwrite").save()
    common.remove(spark, names)
    return made


def _delete(folder: str):
    """Remove files that are no longer needed; those that are gone already are no error, as a task may run twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(folder)
        for batch in batches:
            for name in common.column(batch, "file").to_pylist():
                if fs.get_file_info(name).type != pa.fs.FileType.NotFound:
                    fs.delete_file(name)
        yield pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["file"])

    return run


def _spread(files: DataFrame) -> DataFrame:
    """A task for every few files: the rows are names only."""
    spark = files.sparkSession
    return files.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "file")


def make_folder(spark: SparkSession, folder: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)


def read_back(files: DataFrame, folder: str) -> DataFrame:
    return read_archives(_spread(files), folder)
