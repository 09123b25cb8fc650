"""WARC archives as seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames, each with whole WARC/1.1 records, and a last skippable frame with
the seek table (the public seekable format: compressed and decompressed size of each frame, number of frames, magic).
Any Zstandard tool unpacks a bundle to a plain WARC file. The manifest maps each record to file, frame and its offset
in the frame, so that one record is read by one seek and one frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm.common import file_system, fresh_path, materialise

#: Fixed values of the seekable format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
FRAME_BYTES = 1 << 18
REVISIT_BYTES = 1000
#: Packed bytes that a task reads back, about.
READ_BYTES = 8 << 20
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, frame int, frame_at long, frame_bytes int, offset int, length int, page_id long"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(urn: str) -> int | None:
    found = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(found) if found else None


def warc_record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, is_revisit: bool) -> bytes:
    """One record; a revisit has the HTTP head only. Control characters and spaces of the url are percent-encoded."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"revisit" if is_revisit else b"response"),
        b"WARC-Record-ID: " + record_id(page_id).encode(),
        b"WARC-Date: 1970-01-01T00:00:00Z",
        b"WARC-Payload-Digest: sha1:" + base64.b32encode(digest),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    if url is not None:
        head.insert(3, b"WARC-Target-URI: " + b"".join(b"%%%02X" % c if c <= 32 or c == 127 else bytes([c]) for c in url.encode()))
    if is_revisit:
        head += [b"WARC-Refers-To: " + record_id(refers_to).encode(), b"WARC-Profile: " + PROFILE.encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at a place."""
    split = raw.index(b"\r\n\r\n", at)
    lines = raw[at:split].split(b"\r\n")
    if lines[0] != b"WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    headers = {k.decode(): v.decode() for k, v in (line.split(b": ", 1) for line in lines[1:])}
    end = split + 4 + int(headers["Content-Length"])
    return headers, raw[split + 4 : end], end + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The last, skippable frame of a bundle; sizes: compressed and decompressed bytes of each frame."""
    body = b"".join(struct.pack("<II", c, d) for c, d in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(source, size: int) -> list[tuple[int, int, int]]:
    """(place, compressed, decompressed) of each frame of an open bundle."""
    source.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE or flags & 0x80:
        raise ValueError("no seek table without checksums at the end of the file")
    source.seek(size - 9 - 8 * n)
    pairs = np.frombuffer(source.read(8 * n), "<u4").reshape(-1, 2).astype(np.int64)
    places = np.cumsum(pairs[:, 0]) - pairs[:, 0]
    return [(int(p), int(c), int(d)) for p, (c, d) in zip(places, pairs)]


def mark_revisits(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest (hex), refers_to, is_revisit of each page.

    Of equal payloads (SHA-1 and size) of REVISIT_BYTES or more, rows with the largest page_id are responses, so are
    shorter ones. If no copy has a page_id, all are responses.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    pages = pages.withColumn("digest", F.sha1("payload"))
    large = pages.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("digest")
    copies = large.agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    copies = materialise(spark, copies, "copies")
    # one plan at every size: payloads that may have copies meet their digest's verdict by a merge join of two exchanges, which
    # adaptive execution can split at a digest with very many copies; shorter payloads move nowhere
    is_large = F.octet_length("payload") >= REVISIT_BYTES
    marked = pages.where(is_large).join(copies.hint("merge"), "digest", "left")
    marked = marked.unionByName(pages.where(~is_large).withColumn("refers_to", F.lit(None).cast("long")))
    is_revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return marked.select("page_id", "url", "payload", "digest", F.when(is_revisit, F.col("refers_to")).alias("refers_to"), is_revisit.alias("is_revisit"))


def write_bundles(spark: SparkSession, marked: DataFrame, frame_bytes: int = FRAME_BYTES) -> tuple[str, DataFrame]:
    """A bundle for each partition, named for its task attempt; returns the folder and the manifest of those committed."""
    folder = fresh_path(spark, "warc")

    def run(batches):
        import zstandard

        fs, root = file_system(folder)
        packer = zstandard.ZstdCompressor(level=LEVEL)
        name, out, sizes, at = f"{uuid.uuid4().hex}.warc.zst", None, [], 0
        records: list[bytes] = []
        ids: list[int | None] = []

        def flush():
            nonlocal at
            raw = b"".join(records)
            frame = packer.compress(raw)
            out.write(frame)
            lengths = np.array([len(r) for r in records], dtype=np.int32)
            n = len(records)
            rows = pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * n), pa.array(np.full(n, len(sizes), dtype=np.int32)), pa.array(np.full(n, at)),
                    pa.array(np.full(n, len(frame), dtype=np.int32)), pa.array(np.cumsum(lengths, dtype=np.int32) - lengths), pa.array(lengths),
                    pa.array(ids, pa.int64()),
                ],
                names=["file", "frame", "frame_at", "frame_bytes", "offset", "length", "page_id"],
            )
            sizes.append((len(frame), len(raw)))
            at += len(frame)
            records.clear()
            ids.clear()
            return rows

        held = 0
        for batch in batches:
            for page, url, payload, digest, refers, is_revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                records.append(warc_record(page, url, payload, bytes.fromhex(digest), refers, is_revisit))
                ids.append(page)
                held += len(records[-1])
                if held >= frame_bytes:
                    yield flush()
                    held = 0
        if out is not None:
            if records:
                yield flush()
            out.write(seek_table(sizes))
            out.close()

    return folder, materialise(spark, marked.mapInArrow(run, MANIFEST), "manifest")


def _described(headers: dict[str, str], block: bytes) -> tuple:
    """page_id, url, payload bytes, digest, type, refers_to, payload of a parsed record."""
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n")[0])
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    is_revisit = headers["WARC-Type"] == "revisit"
    if not is_revisit and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"payload of {headers['WARC-Record-ID']} is damaged")
    refers = _page_of(headers["WARC-Refers-To"]) if is_revisit else None
    return _page_of(headers["WARC-Record-ID"]), headers.get("WARC-Target-URI"), size, digest, headers["WARC-Type"], refers, None if is_revisit else payload


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_bundles(spark: SparkSession, folder: str, manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Every record of the committed bundles, read frame by frame by their seek tables; payloads are verified."""
    frames = manifest.select("file", "frame", "frame_at", "frame_bytes").distinct()
    total = frames.agg(F.sum(F.col("frame_bytes").cast("long"))).first()[0] or 0
    # by bytes to read, not by the size of these rows
    parts = max(1, -(-total // READ_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")))
    files = frames.repartition(parts, F.col("file"), F.floor(F.col("frame_at") / READ_BYTES)).select("file", "frame").sortWithinPartitions("file", "frame")
    schema = RECORD + ", payload binary" * with_payload

    def run(batches):
        import zstandard

        fs, root = file_system(folder)
        name, source, frames, unpacker = None, None, [], zstandard.ZstdDecompressor()
        for batch in batches:
            for file, frame in zip(*(c.to_pylist() for c in batch.columns)):
                if file != name:
                    name, source = file, fs.open_input_file(f"{root}/{file}")
                    frames = read_seek_table(source, source.size())
                place, packed, size = frames[frame]
                source.seek(place)
                raw, at, rows = unpacker.decompress(source.read(packed), max_output_size=size), 0, []
                while at < len(raw):
                    headers, block, at = parse_record(raw, at)
                    rows.append(_described(headers, block))
                yield _batch(rows, with_payload)

    return files.mapInArrow(run, schema)


def _batch(rows: list[tuple], with_payload: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * with_payload
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * with_payload
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def lookup(spark: SparkSession, folder: str, manifest: DataFrame, ids: DataFrame) -> DataFrame:
    """The records (with payloads) of the page_ids asked for: a seek and a frame for each."""
    asked = manifest.join(ids.select("page_id").distinct(), "page_id", "left_semi").select("file", "frame_at", "frame_bytes", "offset", "length")

    def run(batches):
        import zstandard

        fs, root = file_system(folder)
        for batch in batches:
            rows = []
            for file, at, packed, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                with fs.open_input_file(f"{root}/{file}") as source:
                    source.seek(at)
                    raw = zstandard.ZstdDecompressor().decompress(source.read(packed))
                headers, block, _ = parse_record(raw[offset : offset + length])
                rows.append(_described(headers, block))
            if rows:
                yield _batch(rows, True)

    return asked.mapInArrow(run, RECORD + ", payload binary")


def archive_digest(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page, archived and read back.

    pages(page_id, url, html); a null html is an empty payload, a null url a record without target. Rows that repeat a
    page_id give a record each: of equal copies with the largest id all are responses. Records of a null page_id
    have an id without number. An empty table gives none. Other columns are ignored.
    """
    folder, manifest = write_bundles(spark, mark_revisits(spark, pages))
    return read_bundles(spark, folder, manifest).drop("url")
