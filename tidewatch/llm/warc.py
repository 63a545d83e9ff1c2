"""Seekable Zstandard WARC bundles.

Each task packs its pages' WARC records into frames that can be read alone, and frames into bundles: ``.warc.zst`` files
in the shared folder, which end with the seek table of the seekable format (a skippable frame of compressed and plain
sizes, and a footer). An index table maps each record identifier to bundle, frame, offset inside the plain frame, and
length. Readers fetch the footer, the seek table and the frames they need by ranged reads. Every attempt of a task
writes names of its own and the committed index names the winners' files, so a lost or repeated task leaves at most
files that nothing names. The folder may be on any store that pyarrow.fs opens by URI.

Of records with equal payloads the one with the smallest page_id is the response; the others are revisit records with
an empty body that name it. Defined results: null html is an empty payload, and empty payloads are equal to each other;
a null url is written as empty; repeated rows with the smallest page_id are all responses; a null page_id is a revisit
unless no equal payload has an id; extra columns aren't read; an empty table makes no bundle and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, scratch_path

# Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES, BUNDLE_BYTES = 256 << 10, 16 << 20
BUNDLES = "bundle string, n_records long, n_bytes long, index array<struct<page_id:long,frame:int,offset:long,length:long>>"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, frame int, offset long"
DATE = "2024-01-01T00:00:00Z"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """Names page and payload, so that only equal records share an identifier."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, n_bytes: int, refers_to: int | None, kind: str) -> bytes:
    """A record; ``payload`` is the body of a response and unused in a revisit."""
    body = payload if kind == "response" else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + " ".join((url or "").split()), f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {n_bytes}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The store of a folder's URI or absolute path, and the folder inside it."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path)


class Bundle:
    """One archive being written; a frame goes out as soon as it is full, so a task holds one frame."""

    def __init__(self, sink) -> None:
        import zstandard

        self.sink, self.pack, self.sizes, self.index = sink, zstandard.ZstdCompressor(level=3), [], []
        self.plain, self.size, self.bytes = [], 0, 0

    def add(self, page_id: int | None, data: bytes) -> None:
        self.index.append((page_id, len(self.sizes), self.size, len(data)))
        self.plain.append(data)
        self.size += len(data)
        if self.size >= FRAME_BYTES:
            self.close_frame()

    def close_frame(self) -> None:
        if self.plain:
            packed = self.pack.compress(b"".join(self.plain))
            self.sink.write(packed)
            self.sizes.append((len(packed), self.size))
            self.bytes += len(packed)
            self.plain, self.size = [], 0

    def finish(self) -> int:
        """Write what is open and the seek table; the file's size."""
        self.close_frame()
        table = b"".join(struct.pack("<II", *x) for x in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.sink.close()
        return self.bytes + 8 + len(table)


def seek_table(source) -> list[tuple[int, int, int]]:
    """(start, compressed size, plain size) of each frame, by two ranged reads at the end of an open bundle."""
    end = source.size()
    n, _, magic = struct.unpack("<IBI", source.read_at(9, end - 9))
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    table, at, out = source.read_at(8 * n, end - 9 - 8 * n), 0, []
    for packed, plain in struct.iter_unpack("<II", table):
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(source, frame: tuple[int, int, int]) -> bytes:
    """The plain bytes of one frame, by one ranged read."""
    import zstandard

    start, packed, plain = frame
    return zstandard.ZstdDecompressor().decompress(source.read_at(packed, start), max_output_size=plain)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of the one record in data."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
    return fields, rest[: int(fields["Content-Length"])]


def _write(path: str):
    def write(batches):
        from pyspark import TaskContext

        store, folder = opened(path)
        store.create_dir(folder)
        task, attempt, n, name, bundle = TaskContext.get().partitionId(), uuid.uuid4().hex, 0, None, None

        def done():
            size = bundle.finish()
            rows = [{"page_id": p, "frame": f, "offset": o, "length": z} for p, f, o, z in bundle.index]
            kind = pa.list_(pa.struct([("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
            columns = [pa.array([name]), pa.array([len(rows)], pa.int64()), pa.array([size], pa.int64()), pa.array([rows], kind)]
            return pa.RecordBatch.from_arrays(columns, ["bundle", "n_records", "n_bytes", "index"])

        for batch in batches:
            for page_id, url, html, digest, n_bytes, first in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "n_bytes", "first")), strict=True):
                if bundle is None:
                    name = f"part-{task:05d}-{n:05d}-{attempt}.warc.zst"
                    bundle = Bundle(store.open_output_stream(f"{folder}/{name}", compression=None))
                digest, first, kind = base64.b32encode(bytes.fromhex(digest.as_py())).decode(), first.as_py(), "response" if html.is_valid else "revisit"
                bundle.add(page_id.as_py(), record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), digest, n_bytes.as_py(), first, kind))
                if bundle.bytes >= BUNDLE_BYTES:
                    yield done()
                    n, bundle = n + 1, None
        if bundle is not None:
            yield done()

    return write


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Write all pages as bundles under ``path``/archives and return the index table, kept under ``path``/index.

    Which pages are revisits is found on ids and digests alone. The pages then meet their responses by id and digest
    together, so a payload that very many pages share is spread over tasks.
    """
    spark, html = pages.sparkSession, F.coalesce(F.col("html"), F.lit(""))
    bounded_batches(spark)
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("n_bytes"))
    copies = keyed.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("of"), "first")
    ids = keyed.select("page_id", "digest").distinct()
    others = ids.join(copies, F.col("digest") == F.col("of")).where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("id"), "of", "first")
    joined = keyed.join(others, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")), "left")
    rows = joined.select("page_id", "url", F.when(F.col("of").isNull(), F.col("html")).alias("html"), "digest", "n_bytes", "first")
    rows.mapInArrow(_write(f"{path}/archives"), BUNDLES).write.parquet(f"{path}/index")
    return spark.read.schema(BUNDLES).parquet(f"{path}/index")


def _page(text: str | None) -> int | None:
    number = text.split(":")[2] if text else ""
    return int(number) if number else None


def _read(path: str):
    def read(batches):
        store, folder = opened(path)
        for batch in batches:
            for name, index in zip(batch.column("bundle"), batch.column("index"), strict=True):
                rows, held, now = [], b"", -1
                with store.open_input_file(f"{folder}/{name}") as source:
                    frames = seek_table(source)
                    for x in index.as_py():
                        if x["frame"] != now:
                            held, now = read_frame(source, frames[x["frame"]]), x["frame"]
                        fields, body = parse(held[x["offset"] : x["offset"] + x["length"]])
                        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and sha1_base32(body) != digest or fields["WARC-Record-ID"] != record_id(x["page_id"], digest):
                            raise ValueError(f"{name}: record {x['page_id']} doesn't read back")
                        rows.append((x["page_id"], int(fields["X-Payload-Length"]), digest, kind, _page(fields.get("WARC-Refers-To")), name.as_py(), now, x["offset"]))
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in RECORDS.split(", ")])

    return read


def read_archives(path: str, bundles: DataFrame) -> DataFrame:
    """A row per record of the bundles under ``path``, each taken through the index and the seek table, and checked against its digest."""
    n = max(1, min(bundles.count(), 20_000))
    return bundles.select("bundle", "index").repartition(n, "bundle").mapInArrow(_read(f"{path}/archives"), RECORDS)


def find_records(path: str, bundles: DataFrame, page_ids: list[int]) -> list[tuple[int, dict[str, str], bytes]]:
    """(page_id, headers, body) of a few pages: only the frames that hold them are fetched."""
    rows = bundles.select("bundle", F.explode("index").alias("x")).where(F.col("x.page_id").isin(page_ids)).select("bundle", "x.*").collect()
    (store, folder), out = opened(f"{path}/archives"), []
    for r in rows:
        with store.open_input_file(f"{folder}/{r['bundle']}") as source:
            plain = read_frame(source, seek_table(source)[r["frame"]])
        out.append((r["page_id"], *parse(plain[r["offset"] : r["offset"] + r["length"]])))
    return out


def archive_pages(pages: DataFrame) -> DataFrame:
    """Write all pages, read all archives back."""
    path = scratch_path(pages.sparkSession, "warc")
    return read_archives(path, write_archives(pages, path))


SQL = """
WITH d AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
b AS (SELECT page_id, payload_bytes, min(page_id) OVER (PARTITION BY x) AS first,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(x, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), '') AS payload_digest FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM b
"""
