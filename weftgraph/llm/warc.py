"""WARC archives of zstandard frames: a dictionary in front, one frame per record.

Writing. A page's payload is its html in UTF-8. Pages with equal payloads of at least ``min_revisit`` bytes are found by
an aggregate on the SHA-1 (partial before the shuffle, so a payload shared by a third of the pages costs no more); the
one with the largest page id is the response, the others are revisits that name it and carry no payload. A payload on
more than 1/1000 of the pages is looked up by a broadcast join (there are fewer than 1000 such payloads, whatever the
input), the others by a shuffled join on the digest. Then each partition writes archives of
about ``archive_bytes`` (ARCHIVE_BYTES) of records each: a skippable frame with a
zstandard dictionary trained on a bounded sample of its first records, and a frame per record.

Reading. A reader takes the dictionary from the leading skippable frame, decodes one frame at a time, and validates what
it finds: the version line, the required headers, that Content-Length is the block's length, the two line ends after
it, and block and payload digests. A damaged archive raises ValueError.

Edge cases. Null html is an empty payload; small payloads are all responses. A null page id sorts below all others; rows
that repeat the winning page id are all responses. A null url is left out of the headers. An empty table gives no
archives. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, file_system, kept, pieces, shared_path, text_or_empty, write_file, written

DICT_FRAME, ZSTD_FRAME, ZSTD_DICT = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
DICT_BYTES, SAMPLE_BYTES, SAMPLE_RECORDS = 32 << 10, 4 << 20, 1000
MIN_REVISIT, ARCHIVE_BYTES = 1000, 1 << 30
_DATE = "1970-01-01T00:00:00Z"


def record(kind: str, headers: dict[str, str], block: bytes) -> bytes:
    head = {"WARC-Type": kind, "WARC-Date": _DATE, **headers, "WARC-Block-Digest": f"sha1:{hashlib.sha1(block).hexdigest()}", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers with lower-case names, block) of a whole record; ValueError if it isn't a valid one."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError("no WARC version line or no end of headers")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise ValueError(f"bad header line {line!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ValueError(f"no {name} header")
    if not re.fullmatch("[0-9]+", headers["content-length"]) or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("the block's length is not Content-Length")
    block = rest[:-4]
    if (want := headers.get("warc-block-digest")) and want != f"sha1:{hashlib.sha1(block).hexdigest()}":
        raise ValueError("the block digest doesn't match")
    return headers, block


def archive(records: Iterator[bytes], level: int = 3) -> Iterator[bytes]:
    """The bytes of an archive. The dictionary is trained on the first records (bounded in number and bytes); with too
    few to train one, there is none."""
    first, held = [], 0
    for r in records:
        first.append(r)
        held += len(r)
        if held >= SAMPLE_BYTES or len(first) >= SAMPLE_RECORDS:
            break
    dictionary = None
    try:
        dictionary = zstandard.train_dictionary(DICT_BYTES, first) if len(first) >= 16 and held >= 8 * DICT_BYTES else None
    except zstandard.ZstdError:  # samples that have nothing in common
        dictionary = None
    if dictionary:
        packed = zstandard.ZstdCompressor(level=19).compress(dictionary.as_bytes())
        yield struct.pack("<II", DICT_FRAME, len(packed)) + packed
    compressor = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True)
    for r in first:
        yield compressor.compress(r)
    for r in records:
        yield compressor.compress(r)


def frames(stream, chunk: int = 1 << 16) -> Iterator[bytes]:
    """Decodes an archive frame by frame from a binary stream."""
    data = stream.read(chunk)
    dictionary = None
    if len(data) >= 8 and struct.unpack("<I", data[:4])[0] == DICT_FRAME:
        size = struct.unpack("<I", data[4:8])[0]
        while len(data) < 8 + size:
            more = stream.read(chunk)
            if not more:
                raise ValueError("the dictionary frame is cut short")
            data += more
        raw, data = data[8 : 8 + size], data[8 + size :]
        if raw[:4] == struct.pack("<I", ZSTD_FRAME):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        if raw[:4] != struct.pack("<I", ZSTD_DICT):
            raise ValueError("the leading skippable frame holds no zstandard dictionary")
        dictionary = zstandard.ZstdCompressionDict(raw)
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    while data or (data := stream.read(chunk)):
        one, out = reader.decompressobj(), []
        while not one.eof:
            if not data and not (data := stream.read(chunk)):
                raise ValueError("the last frame is cut short")
            try:
                out.append(one.decompress(data))
            except zstandard.ZstdError as e:
                raise ValueError(f"a damaged frame: {e}") from e
            data = one.unused_data
        yield b"".join(out)


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?[0-9]+|null)>", urn)
    if not m:
        raise ValueError(f"not a page's record id: {urn!r}")
    return None if m[1] == "null" else int(m[1])


def _page_record(page_id, url, html: bytes, size: int, digest: str, refers_to, revisit: bool) -> bytes:
    headers = {"WARC-Record-ID": _urn(page_id)}
    if url is not None:
        headers["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    headers |= {"WARC-Payload-Digest": f"sha1:{digest}", "X-Payload-Length": str(size), "Content-Type": "application/http; msgtype=response"}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(size).encode() + b"\r\n\r\n"
    if revisit:
        headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _urn(refers_to)}
        return record("revisit", headers, http)
    return record("response", headers, http + html)


def _write(root: str, archive_bytes: int):
    def run(batches):
        from pyspark import TaskContext

        kept("warc")
        stream = (_page_record(page_id, url, html, size, digest.hex(), refers_to, revisit) for b in pieces(batches) for page_id, url, html, size, digest, refers_to, revisit in zip(*(c.to_pylist() for c in b.columns)))
        row, part = next(stream, None), 0
        while row is not None:
            count = held = 0

            def records():
                nonlocal row, count, held
                while row is not None and held < archive_bytes:
                    count, held = count + 1, held + len(row)
                    yield row
                    row = next(stream, None)

            path = f"{root}/pages-{TaskContext.get().partitionId():05d}-{part:05d}.warc.zst"
            size = write_file(path, archive(records()))
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [count], "n_bytes": [size]}, schema=pa.schema([("path", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64())]))
            part += 1

    return run


def write_archives(pages: DataFrame, out: str | None = None, min_revisit: int = MIN_REVISIT, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives below ``out``; returns the manifest (path, n_records, n_bytes)."""
    spark = bounded(pages.sparkSession)
    out = out or shared_path(spark, "warc")
    html = F.encode(text_or_empty(html_col), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.select("*", F.octet_length("html").cast("long").alias("size"), F.unhex(F.sha1("html")).alias("digest"))
    n = pages.count()
    large = rows.filter(F.col("size") >= min_revisit)
    shared = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    shared = written(shared, "shared-payloads")
    hot = shared.filter(F.col("copies") * 1000 > n).select("digest", F.col("refers_to").alias("hot_ref"), F.lit(True).alias("hot"))
    cold = shared.filter(F.col("copies") * 1000 <= n).select("digest", F.col("refers_to").alias("cold_ref"), F.lit(True).alias("cold"))
    rows = rows.join(F.broadcast(hot), "digest", "left")
    known = F.col("size") >= min_revisit
    asked, plain = rows.filter(F.col("hot").isNull() & known), rows.filter(F.col("hot").isNotNull() | ~known)
    rows = plain.withColumns({"cold_ref": F.lit(None).cast("long"), "cold": F.lit(None).cast("boolean")}).unionByName(asked.join(cold, "digest", "left"))
    ref = F.when(known, F.coalesce("hot_ref", "cold_ref"))
    grouped = known & (F.col("hot").isNotNull() | F.col("cold").isNotNull())
    rows = rows.select("page_id", "url", "html", "size", "digest", ref.alias("refers_to"), F.coalesce(grouped & ~F.col("page_id").eqNullSafe(ref), F.lit(False)).alias("revisit"))
    rows = rows.withColumn("html", F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("html")))
    return written(rows.mapInArrow(_write(out, archive_bytes), "path string, n_records long, n_bytes long"), "archives")


def page_rows(uri: str) -> Iterator[tuple]:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload or None) of each record of an archive."""
    fs, path = file_system(uri)
    with fs.open_input_file(path) as stream:
        for data in frames(stream):
            headers, block = parse(data)
            http, gap, payload = block.partition(b"\r\n\r\n")
            digest, size = headers["warc-payload-digest"].removeprefix("sha1:"), int(headers["x-payload-length"])
            kind, refers_to = headers["warc-type"], None
            if not gap or not http.startswith(b"HTTP/"):
                raise ValueError("the block holds no HTTP headers")
            if kind == "revisit":
                refers_to = _page(headers["warc-refers-to"])
                if payload:
                    raise ValueError("a revisit with a payload")
            elif kind != "response" or len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError("a payload that doesn't match its digest or length")
            yield _page(headers["warc-record-id"]), size, digest, kind, refers_to, payload if kind == "response" else None


def _read(batches):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    for b in batches:
        for path in b.column(0).to_pylist():
            rows = []
            for row in page_rows(path):
                rows.append(row[:5])
                if len(rows) == 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read_archives(manifest: DataFrame) -> DataFrame:
    """A row per record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(max(parts, 1), "path").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
g AS (SELECT payload_digest, max(page_id) AS last FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN g.last IS NULL OR g.last = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN g.last IS NULL OR g.last = page_id THEN NULL ELSE g.last END AS refers_to
FROM d LEFT JOIN g USING (payload_digest)
"""
