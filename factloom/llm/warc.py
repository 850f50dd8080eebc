"""WARC archives of zstd frames with an embedded dictionary, written and read by executors.

Every archive begins with a skippable frame that holds a Zstandard dictionary,
built from the archive's own first records; each record then is a frame of its
own, so that it can be read alone. Of records with equal payloads, the one with
the smallest page_id is a response and the others are revisits without payload.

Archives go to a folder that executors share (by default under
spark.checkpoint.dir); a file has its final name only once it is whole, and a
task that runs again writes the same names.
"""

from __future__ import annotations

import base64
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import checkpointed, shared_dir

#: The frame that holds a dictionary, the revisit profile, and the date that all records bear.
DICTIONARY_FRAME = 0x184D2A5D
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
#: Dictionary size, bytes of records that it is built from, and bytes of records of an archive.
DICTIONARY, SAMPLE, ARCHIVE = 32_768, 2 << 20, 256 << 20
LEVEL = 3
#: Rows that a task turns into records at once. It bounds memory only.
ROWS = 64
MANIFEST = "archive string, records long, bytes long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def dictionary(samples: list[bytes], size: int = DICTIONARY) -> zstandard.ZstdCompressionDict | None:
    """Trained on the records, or their last bytes as they are where there are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples)
    except (zstandard.ZstdError, ValueError):
        raw = b"".join(samples)[-size:]
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(raw) >= 8 else None


class Archive:
    """One archive in writing. The first records wait until there are enough for a dictionary."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.fs, self.path, self.part = fs, path, f"{path}.{uuid.uuid4().hex}.part"
        self.waiting, self.size, self.records, self.packer = [], 0, 0, None
        self.out = fs.open_output_stream(self.part)

    def start(self) -> None:
        found = dictionary(self.waiting)
        if found:
            raw = found.as_bytes()
            self.out.write(struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=found) if found else zstandard.ZstdCompressor(level=LEVEL)
        for x in self.waiting:
            self.out.write(self.packer.compress(x))
        self.waiting = []

    def add(self, x: bytes) -> None:
        self.size += len(x)
        self.records += 1
        if self.packer:
            self.out.write(self.packer.compress(x))
        else:
            self.waiting.append(x)
            if self.size >= SAMPLE:
                self.start()

    def close(self) -> tuple[str, int, int]:
        if not self.packer:
            self.start()
        self.out.close()
        if self.fs.get_file_info(self.path).type != pafs.FileType.NotFound:
            self.fs.delete_file(self.path)
        self.fs.move(self.part, self.path)
        return self.path, self.records, self.fs.get_file_info(self.path).size


def write_archives(pages: DataFrame, folder: str | None = None, payload: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Writes a record for each row of pages (page_id, url, payload); returns archive, records and bytes of each file.

    The payload is the column in UTF-8; null is empty. Payloads of fewer than min_bytes are never revisits. Rows
    with equal page_id and payload are all responses or revisit the same one; a null page_id comes after all others.
    Pages are shuffled once, by the join that tells revisits; each task of it writes its own archives. Other columns
    are not read, whatever their names; pages of any length are written whole; an empty table makes no archive.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)
    rows = pages.select("page_id", "url", F.coalesce(payload, F.lit("")).alias("html")).withColumn("sha1", F.unhex(F.sha1(F.encode("html", "UTF-8"))))
    small = rows.where(F.octet_length("html") >= min_bytes).select("page_id", "sha1")
    firsts = small.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisits = small.join(firsts, "sha1").where(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("p"), F.col("sha1").alias("s"), "first").distinct()
    joined = rows.join(revisits.hint("shuffle_hash"), F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha1") == F.col("s")), "left").select("page_id", "url", "html", "sha1", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        task, made, archive = TaskContext.get().partitionId(), [], None
        for batch in batches:
            for row in (r for at in range(0, batch.num_rows, ROWS) for r in batch.slice(at, ROWS).to_pylist()):
                if archive is None:
                    archive = Archive(fs, f"{root}/part-{task:05d}-{len(made):03d}.warc.zst")
                archive.add(record(row["page_id"], row["url"], row["html"].encode("utf-8"), base64.b32encode(row["sha1"]).decode(), row["first"]))
                if archive.size >= archive_bytes:
                    made.append(archive.close())
                    archive = None
        if archive:
            made.append(archive.close())
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], names=["archive", "records", "bytes"])

    return checkpointed(joined.mapInArrow(run, MANIFEST)).withColumn("archive", F.concat(F.lit(folder), F.regexp_replace("archive", "^.*/", "/")))


def read_records(stream: io.RawIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    head = stream.read(8)
    given = {}
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_FRAME:
        given["dict_data"] = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<I", head[4:])[0]))
    else:
        stream.seek(0)
    plain = io.BufferedReader(zstandard.ZstdDecompressor(**given).stream_reader(stream, read_across_frames=True), 1 << 20)
    while line := plain.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers = {}
        while (line := plain.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode("utf-8").partition(": ")
            headers[name] = value
        block = plain.read(int(headers["Content-Length"]))
        if plain.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {headers.get('WARC-Record-ID')} has a wrong length")
        yield headers, block


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of the files named in column archive: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null for revisits)."""
    import hashlib

    page = lambda s: int(s[10:-1]) if s and s[10:-1] else None  # noqa: E731  <urn:page:N>

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for path in batch.column("archive").to_pylist():
                fs, own = pafs.FileSystem.from_uri(path)
                rows: list[tuple] = []
                with fs.open_input_file(own) as file:
                    for headers, block in read_records(file):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        digest, kind = headers["WARC-Payload-Digest"].removeprefix("sha1:"), headers["WARC-Type"]
                        if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"{path}: payload of {headers['WARC-Record-ID']} does not have its digest")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        rows.append((page(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), kind, page(headers.get("WARC-Refers-To")), size, digest, payload if kind == "response" else None))
                        if len(rows) == 500:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    spark = archives.sparkSession
    return archives.select("archive").repartition(max(1, archives.count()), "archive").mapInArrow(run, RECORD) if archives.count() else spark.createDataFrame([], RECORD)
