"""Operator 8: dictionary-compressed WARC archives (.warc.zst).

Each task writes its rows to archives of its own. An archive starts with a
skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary trained
on a bounded sample of the archive's own first records; every record follows
as a frame of its own, compressed with that dictionary, so single records can
be read and an archive needs nothing beside itself.

Of records with equal payloads the one with the smallest page id is a
response, the others are revisits that refer to it. Equality is by the
payload's SHA-1 digest, as WARC readers judge it, and its length.

Archives lie in a shared folder (any file system that pyarrow can open from a
URI). File names carry the task attempt, so a task that runs twice never
writes over a finished file; the manifest lists the files of the attempts
that count.

Defined results: null html is an empty payload, null urls have no target URI;
a null page id sorts after all others (a group of null ids only is all
responses); repeated rows that share the smallest id are all responses; an
empty table gives no archives and no records; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from odonto.llm.common import scratch_path, ship_by_value, stage

ship_by_value(__name__)

#: Fixed by the WARC and Zstandard formats.
DICTIONARY_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICTIONARY_BYTES = 1 << 16
SAMPLE_BYTES = 1 << 21
ARCHIVE_BYTES = 1 << 28          # record bytes after which a new archive begins
READ_BYTES = 1 << 18
MIN_SHARED_BYTES = 0             # payloads shorter than this are always responses
LEVEL = 6

MANIFEST_SCHEMA = "file string, records long, bytes long"
RECORD_SCHEMA = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
                 "url string, file string, position long")


def file_system(uri: str):
    """(pyarrow file system, path) of a URI as Spark writes them."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if ":" in uri else "file://" + uri)


def clean_header(text: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {clean_header(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train_dictionary(sample: list[bytes], size: int):
    """A dictionary from records, or None where they are too few or too alike
    for the trainer."""
    import zstandard
    try:
        return zstandard.train_dictionary(size, sample, k=256, d=8) if len(sample) >= 8 else None
    except zstandard.ZstdError:
        return None


class Archive:
    """One archive being written: records wait until the sample is full."""

    def __init__(self, uri: str, dictionary_bytes: int, sample_bytes: int, level: int):
        self.uri, self.size, self.room, self.level = uri, dictionary_bytes, sample_bytes, level
        self.waiting: list[bytes] = []
        self.out = self.compressor = None
        self.records = self.bytes = 0

    def add(self, data: bytes) -> None:
        self.records += 1
        self.bytes += len(data)
        if self.out is None:
            self.waiting.append(data)
            self.room -= len(data)
            if self.room <= 0:
                self._begin()
        else:
            self.out.write(self.compressor.compress(data))

    def _begin(self) -> None:
        import zstandard
        system, path = file_system(self.uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = system.open_output_stream(path, compression=None)
        words = train_dictionary([x[:1 << 17] for x in self.waiting], self.size)
        frame = words.as_bytes() if words else b""
        self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(frame)) + frame)
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=words) if words else zstandard.ZstdCompressor(level=self.level)
        for x in self.waiting:
            self.out.write(self.compressor.compress(x))
        self.waiting = []

    def close(self) -> tuple[str, int, int]:
        if self.out is None:
            self._begin()
        self.out.close()
        return self.uri, self.records, self.bytes


def read_records(uri: str) -> Iterator[tuple[int, bytes]]:
    """(number, record) of an archive, frame by frame in bounded memory."""
    import zstandard
    system, path = file_system(uri)
    with system.open_input_stream(path, compression=None) as source:
        magic, size = struct.unpack("<II", source.read(8))
        if magic != DICTIONARY_MAGIC:
            raise ValueError(f"{uri}: no dictionary frame")
        frame = source.read(size)
        d = (zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(frame)) if frame
             else zstandard.ZstdDecompressor())
        one, parts, n, inside = d.decompressobj(), [], 0, False
        while data := source.read(READ_BYTES):
            while data:
                parts.append(one.decompress(data))
                data, inside = b"", True
                if one.eof:
                    yield n, b"".join(parts)
                    data = one.unused_data
                    one, parts, n, inside = d.decompressobj(), [], n + 1, False
        if inside:
            raise ValueError(f"{uri}: ends inside a record")


def parse(data: bytes) -> dict[str, str | bytes]:
    """Headers of a record, its HTTP header fields (as http-...) and payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    out = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:])}
    block = rest[:int(out["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    out |= {f"http-{k.lower()}": v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}
    out["payload"] = payload
    return out


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
                 min_shared_bytes: int = MIN_SHARED_BYTES) -> DataFrame:
    """(page_id, url, payload, sha1, refers_to): which rows are revisits.

    The first page of each digest is a grouped minimum over (digest, length,
    id) rows, combined before the shuffle; the pages then meet one row per
    digest, so a digest that a third of all pages share splits like any
    skewed join.
    """
    payload = F.coalesce(F.col(body_col), F.lit("")).cast("binary")
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"),
                     F.sha1(payload).alias("sha1"), F.octet_length(payload).alias("n"))
    first = p.groupBy("sha1", "n").agg(F.min("page_id").alias("first"))
    shared = (F.col("n") >= min_shared_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return p.join(first, ["sha1", "n"]).select("page_id", "url", "payload", "sha1", F.when(shared, F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, date: datetime | None = None, dictionary_bytes: int = DICTIONARY_BYTES,
                   sample_bytes: int = SAMPLE_BYTES, archive_bytes: int = ARCHIVE_BYTES, level: int = LEVEL) -> DataFrame:
    """Write planned records below ``folder``; returns the manifest (file,
    records, bytes), staged so that writing happens once."""
    when = (date or datetime(2024, 1, 15, tzinfo=timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        task = TaskContext.get()
        stem = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        now, done = None, []
        for pdf in batches:
            for page_id, url, payload, sha1, refers in zip(*(pdf[c] for c in ("page_id", "url", "payload", "sha1", "refers_to")), strict=True):
                if now is None:
                    now = Archive(f"{stem}-{len(done):04d}.warc.zst", dictionary_bytes, sample_bytes, level)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                now.add(record(None if pd.isna(page_id) else int(page_id), url, bytes(payload), digest,
                               None if pd.isna(refers) else int(refers), when))
                if now.bytes >= archive_bytes:
                    done.append(now.close())
                    now = None
        if now is not None:
            done.append(now.close())
        yield pd.DataFrame(done, columns=["file", "records", "bytes"])

    # Ids travel as text: pandas would turn nullable 64-bit ids into floats.
    r = records.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "sha1", F.col("refers_to").cast("string").alias("refers_to"))
    return stage(r.mapInPandas(run, MANIFEST_SCHEMA), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every record of the archives in a manifest. Responses are digested
    anew and must match their header."""

    def page(urn: str | None) -> int | None:
        body = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(body) if body not in ("", "none") else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for uri in pdf["file"]:
                out: list[tuple] = []
                for n, data in read_records(uri):
                    x = parse(data)
                    kind, digest = x["warc-type"], x["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and (base32_sha1(x["payload"]) != digest or len(x["payload"]) != int(x["http-content-length"])):
                        raise ValueError(f"{uri}: record {n} doesn't match its digest")
                    out.append((page(x["warc-record-id"]), int(x["http-content-length"]), digest, kind,
                                page(x.get("warc-refers-to")), x.get("warc-target-uri"), uri, n))
                    if len(out) == 4096:
                        yield frame(out)
                        out = []
                yield frame(out)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        f = pd.DataFrame(rows, columns=[x.split()[0] for x in RECORD_SCHEMA.split(", ")])
        return f.assign(page_id=f["page_id"].astype("Int64"), refers_to=f["refers_to"].astype("Int64"))

    return manifest.select("file").repartition(max(manifest.count(), 1)).mapInPandas(run, RECORD_SCHEMA)


def archive_pages(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back."""
    return read_archives(write_archives(plan_records(pages), scratch_path(spark, "warc")))
