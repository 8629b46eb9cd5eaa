"""WARC archives with one Zstandard frame per record and the dictionary in a leading skippable frame.

Layout: an optional skippable frame (magic 0x184D2A5D) holds the dictionary, plain or itself a Zstandard frame; then
each record is one frame, compressed with it. The reader decodes frame after frame and checks the version line, the
header lines, that Content-Length equals the block, and the payload digest; a record that fails raises, or with
`strict=False` comes back with `error` set. Archives roll at `archive_bytes` compressed bytes, so files stay small
enough to be read whole by one task; each is written under a temporary name and renamed, so retried and speculative
tasks leave complete files, and only files named by the tasks that Spark accepted are read.

Contract. Null html is an empty payload. Payloads of at least 1000 bytes that occur under several page_ids are stored
once, by the largest page_id; the others are revisits that refer to it. Rows with a null page_id are responses and
never referred to. Repeated rows of the largest page_id are all responses. No pages make no archive, and no archives no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.common import fresh_path, lookup, staged, table

MAGIC = 0x184D2A5D
ARCHIVE_BYTES = 8 << 20
DICTIONARY_BYTES, DICTIONARY_SAMPLE = 32 << 10, 200
#: Records wait for a dictionary until there are DICTIONARY_SAMPLE or these many bytes of them.
WAITING_BYTES = 8 << 20
LEAST_REVISIT = 1000


def _digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, length: int, refers_to: int | None) -> bytes:
    """One WARC record; a revisit's block is the HTTP head alone, whose Content-Length is the full payload's."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{digest}")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or '').encode('ascii', 'backslashreplace').decode().translate({10: None, 13: None})}",
        f"WARC-Payload-Digest: {digest}",
        *([f"WARC-Page-ID: {page_id}"] if page_id is not None else []),
        *([f"WARC-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers_to is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes]) -> bytes:
    """A dictionary from an archive's first records, empty where there are too few to learn from."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes() if len(samples) >= 20 else b""
    except zstandard.ZstdError:
        return b""


def archive_start(dictionary: bytes) -> bytes:
    if not dictionary:
        return b""
    packed = zstandard.ZstdCompressor().compress(dictionary)
    return struct.pack("<II", MAGIC, len(packed)) + packed


def parse(raw: bytes) -> dict:
    """The parts of one decoded record; raises ValueError where headers, lengths or digest don't hold."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line or header end")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ValueError(f"malformed header line: {line[:80]}")
        headers[name.lower()] = value.strip()
    if missing := {"warc-type", "warc-record-id", "content-length"} - headers.keys():
        raise ValueError(f"missing header: {sorted(missing)}")
    if not headers["content-length"].isdigit() or int(headers["content-length"]) + 4 != len(rest) or rest[-4:] != b"\r\n\r\n":
        raise ValueError("Content-Length differs from the block")
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    if headers["warc-type"] == "response" and "warc-payload-digest" in headers:
        if headers["warc-payload-digest"] != _digest(payload) or (length is not None and length != len(payload)):
            raise ValueError("payload differs from its digest or length")
    return {"headers": headers, "payload": payload, "payload_bytes": length if length is not None else len(payload)}


def read_archive(content: bytes) -> Iterator[bytes]:
    """The decoded records of one archive, frame by frame."""
    view, at, dictionary = memoryview(content), 0, None
    while at < len(view):
        (magic,) = struct.unpack_from("<I", view, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            (size,) = struct.unpack_from("<I", view, at + 4)
            if at == 0 and magic == MAGIC:
                held = bytes(view[8 : 8 + size])
                if held[:4] == b"\x28\xb5\x2f\xfd":
                    held = zstandard.ZstdDecompressor().decompressobj().decompress(held)
                dictionary = zstandard.ZstdCompressionDict(held)
            at += 8 + size
            continue
        frame = zstandard.ZstdDecompressor(dict_data=dictionary).decompressobj() if dictionary else zstandard.ZstdDecompressor().decompressobj()
        out, given = io.BytesIO(), at
        while not frame.eof:
            if given >= len(view):
                raise ValueError("the last frame is cut off")
            piece = view[given : given + (1 << 16)]
            out.write(frame.decompress(piece))
            given += len(piece)
        at = given - len(frame.unused_data)
        yield out.getvalue()


def write_warc(rows: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write (page_id, url, html, digest, payload_bytes, refers_to) rows; returns (path, records) per archive."""
    folder = fresh_path(rows.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)

        def close(parts: list[bytes], n: int) -> pa.RecordBatch:
            name = f"{base}/{uuid.uuid4().hex}"
            with store.open_output_stream(name + ".part") as out:
                out.write(b"".join(parts))
            store.move(name + ".part", name + ".warc.zst")
            return pa.RecordBatch.from_pydict({"path": [folder + name[len(base) :] + ".warc.zst"], "records": pa.array([n], pa.int64())})

        waiting: list[bytes] = []
        packer, parts, size, n, held = None, [], 0, 0, 0

        def start() -> None:
            nonlocal packer, parts, size, n
            dictionary = train([w for w in waiting if len(w) < 1 << 20])
            packer = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
            parts, size, n = [archive_start(dictionary)], 0, 0

        def drain() -> Iterator[pa.RecordBatch]:
            nonlocal packer, size, n
            for raw in waiting:
                if packer is None:
                    start()
                parts.append(packer.compress(raw))
                size += len(parts[-1])
                n += 1
                if size >= archive_bytes:
                    yield close(parts, n)
                    packer = None
            waiting.clear()

        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "html", "digest", "payload_bytes", "refers_to"))):
                page_id, url, html, digest, length, refers = (x.as_py() for x in row)
                payload = (html or "").encode("utf-8", "surrogatepass")
                waiting.append(record(page_id, url, payload, "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(), length, refers))
                held += len(waiting[-1])
                if len(waiting) >= DICTIONARY_SAMPLE or held > WAITING_BYTES:
                    yield from drain()
                    held = 0
        yield from drain()
        if packer is not None:
            yield close(parts, n)

    columns = ["page_id", "url", "html", "digest", "payload_bytes", "refers_to"]
    return staged(rows.select(*columns).mapInArrow(run, "path string, records long"), "manifest")


def read_warc(spark: SparkSession, paths: DataFrame | list[str], strict: bool = True) -> DataFrame:
    """Read archives, given as a table with their `path` or as a list. One row per record: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload, error."""
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload", "error"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name, compression=None) as file:
                    content = file.read()
                for raw in read_archive(content):
                    try:
                        r = parse(raw)
                    except (ValueError, UnicodeDecodeError) as why:
                        if strict:
                            raise
                        rows.append((None,) * 7 + (str(why),))
                        continue
                    h = r["headers"]
                    digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex() if "warc-payload-digest" in h else None
                    ids = [int(h[k]) if k in h else None for k in ("warc-page-id", "warc-refers-to-page-id")]
                    rows.append((ids[0], h.get("warc-target-uri"), h["warc-type"], r["payload_bytes"], digest, ids[1], r["payload"], None))
                    size += len(r["payload"])
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    if not isinstance(paths, DataFrame):
        paths = spark.createDataFrame([(p,) for p in paths], "path string")
    # a path per row, dealt out whole: about four archives a task, at any number of them
    dealt = paths.select("path").repartition(max(1, -(-paths.count() // 4)), "path")
    return dealt.mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, error string")


def revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """`pages` with digest, payload_bytes and refers_to (null for responses) added; the html moves once, by page_id."""
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "utf-8")
    full = pages.select(F.col("page_id").cast("long"), "url", "html", F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    slim = staged(full.where(F.col("payload_bytes") >= least).where("page_id IS NOT NULL").groupBy("page_id", "digest").agg(F.lit(1).alias("one")).drop("one"), "digests")
    groups = slim.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n_key")).where("n_key > 1")
    known = lookup(slim, staged(groups, "groups"), "digest", F.col("page_id")).where("refers_to IS NOT NULL AND refers_to <> page_id")
    return full.join(known, ["page_id", "digest"], "left")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive all pages, read the archives back, and return what the records say."""
    manifest = write_warc(revisits(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return read_warc(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
g AS (SELECT payload_digest AS d, max(page_id) AS m FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m <> page_id THEN m END AS refers_to
FROM p LEFT JOIN g ON payload_digest = d AND payload_bytes >= 1000
"""
