"""Token ids in files of independent zstandard frames with a trailing seek table.

A file holds, in ascending id order, one zstandard frame per document (its ids as little-endian unsigned integers of
``width`` bytes), a skippable frame with the index (width, and per document its id and number of ids), and last the seek
table of the public seekable format: a skippable frame with, per frame, its compressed and decompressed size and the low
32 bits of the XXH64 of its content, and a footer with the number of frames. A reader seeks to the footer, reads the
table, and decompresses only the frames it wants, each checked against its checksum. ``zstd -d`` reads the file too.

Documents are encoded where they are read; their frames, about a third of the text, are shuffled once to shards. Shards
are ranges of doc_id at approximate quantiles, so they are even for any spacing of ids, and no document is ever held with
more than its batch. A shard is sorted and written as files of at most ``docs_per_file`` documents, so a file and its
tables stay small however many rows there are. A file is written under a name of the attempt and renamed, so a repeated
task replaces it whole.

Edge cases. Null text counts as empty. A null id sorts before all others; equal ids are ordered by checksum, then by
length. An empty table gives no files and an empty result. Other columns are never read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, file_system, pieces, shared_path, shares, text_or_empty, write_file, written
from .tokens import encoder

SKIPPABLE, INDEX, FOOTER = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
DOCS_PER_FILE, MAX_SHARDS, LEVEL = 2048, 1 << 16, 3


def frame(compressor: zstandard.ZstdCompressor, ids: np.ndarray, width: int) -> tuple[bytes, int, int]:
    """(compressed frame, size of its content, checksum of its content)."""
    data = ids.astype(f"<u{width}").tobytes()
    return compressor.compress(data), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


def trailer(frames: list[tuple[int, int, int]], doc_ids: list, counts: list[int], width: int) -> bytes:
    """The index and the seek table. frames: (compressed size, size, checksum)."""
    null = np.array([d is None for d in doc_ids], dtype="u1")
    index = struct.pack("<BQ", width, len(doc_ids)) + np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + null.tobytes() + np.array(counts, dtype="<u8").tobytes()
    framed = struct.pack("<II", INDEX, len(index)) + index
    table = np.array(frames, dtype="<u4").reshape(-1, 3).tobytes() + struct.pack("<IBI", len(frames), 0x80, FOOTER)
    return framed + struct.pack("<II", SKIPPABLE, len(table)) + table


class TokenFile:
    """Random access to one file: len() documents, doc_id(i), n_tokens(i), ids(i)."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self._in, self._unpack = fs.open_input_file(path), zstandard.ZstdDecompressor()
        size = self._in.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER or not flags & 0x80:
            raise ValueError(f"{uri}: no seek table with checksums at the end")
        at = size - 9 - 12 * n - 8
        if struct.unpack("<II", self._at(at, 8)) != (SKIPPABLE, 12 * n + 9):
            raise ValueError(f"{uri}: the seek table's length is wrong")
        self.table = np.frombuffer(self._at(at + 8, 12 * n), dtype="<u4").reshape(n, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype="i8")])
        first = int(self.offsets[-1])
        magic, length = struct.unpack("<II", self._at(first, 8))
        if magic != INDEX or first + 8 + length != at:
            raise ValueError(f"{uri}: the index is not where the frames end")
        index = self._at(first + 8, length)
        self.width, docs = struct.unpack("<BQ", index[:9])
        if docs != n:
            raise ValueError(f"{uri}: {n} frames, {docs} documents")
        self._ids = np.frombuffer(index, "<i8", n, 9)
        self._null = np.frombuffer(index, "u1", n, 9 + 8 * n)
        self.counts = np.frombuffer(index, "<u8", n, 9 + 9 * n).astype("i8")

    def _at(self, at: int, n: int) -> bytes:
        if at < 0:
            raise ValueError("the file is too short")
        self._in.seek(at)
        return self._in.read(n)

    def __len__(self) -> int:
        return len(self.table)

    def doc_id(self, i: int) -> int | None:
        return None if self._null[i] else int(self._ids[i])

    def ids(self, i: int) -> np.ndarray:
        """The ids of document i; only its frame is read and decompressed."""
        packed, size, check = (int(x) for x in self.table[i])
        data = self._unpack.decompress(self._at(int(self.offsets[i]), packed), max_output_size=size) if size else b""
        if len(data) != size or size != self.width * self.counts[i] or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        return np.frombuffer(data, f"<u{self.width}").astype("<u4")

    def close(self) -> None:
        self._in.close()


def _encoded(path: str, end_id: int, bounds: list[int]):
    """For mapInArrow: (doc_id, text) to the document's shard and frame."""
    edges = np.array(bounds, dtype="i8")

    def run(batches):
        enc, compressor = encoder(path), zstandard.ZstdCompressor(level=LEVEL)
        for batch in pieces(batches):
            out = []
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                ids = np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id))
                packed, size, check = frame(compressor, ids, enc.width)
                out.append((0 if doc is None else int(np.searchsorted(edges, doc, "right")), doc, len(ids), enc.width, size, check, packed))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], ["shard", "doc_id", "n_tokens", "width", "size", "check", "frame"])

    return run


def _writer(root: str, docs_per_file: int):
    """For mapInArrow over rows sorted by shard and doc_id: writes the files of each shard, returns their lines of the
    manifest."""

    def rows(batches) -> Iterator[tuple]:
        for batch in pieces(batches):
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def run(batches):
        stream = rows(batches)
        row, shard, part = next(stream, None), None, 0
        while row is not None:
            part = part + 1 if row[0] == shard else 0
            shard, frames, docs, counts, width = row[0], [], [], [], row[3]

            def chunks():
                nonlocal row
                while row is not None and row[0] == shard and len(docs) < docs_per_file:
                    frames.append((len(row[6]), row[4], row[5]))
                    docs.append(row[1])
                    counts.append(row[2])
                    yield row[6]
                    row = next(stream, None)
                yield trailer(frames, docs, counts, width)

            name = f"{root}/tokens-{shard:05d}-{part:06d}.zst"
            size = write_file(name, chunks())
            yield pa.RecordBatch.from_pydict({"shard": [shard], "part": [part], "path": [name], "n_docs": [len(docs)], "n_tokens": [sum(counts)], "n_bytes": [size]}, schema=pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

    return run


MANIFEST = "shard int, part int, path string, n_docs long, n_tokens long, n_bytes long"


def write_tokens(docs: DataFrame, tokenizer: str, out: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", docs_per_file: int = DOCS_PER_FILE, max_shards: int = MAX_SHARDS) -> DataFrame:
    """Writes the files below ``out`` (by default a new folder in the shared one). Returns the manifest: a row per file
    (shard, part, path, n_docs, n_tokens, n_bytes); the order of shards and parts is the order of ids."""
    spark = bounded(docs.sparkSession)
    out = out or shared_path(spark, "tokens")
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    n = ids.count()
    shards = max(1, min(max_shards, -(-n // docs_per_file)))
    cuts = [i / shards for i in range(1, shards)]
    bounds = sorted(set(ids.agg(F.percentile_approx("doc_id", cuts, 20 * shards)).first()[0] or [])) if cuts else []
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(_encoded(tokenizer, end_id, bounds), "shard int, doc_id long, n_tokens long, width int, size long, check long, frame binary")
    dealt = rows.repartition(max(shares(docs), 1), "shard").sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "check", "n_tokens")
    return written(dealt.mapInArrow(_writer(out, docs_per_file), MANIFEST), "manifest")


def _read(batches):
    for batch in batches:
        for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            f = TokenFile(path)
            n, starts = len(f), base + np.concatenate([[0], np.cumsum(f.counts)])[:-1]
            for a in range(0, n, 4096):
                span = range(a, min(n, a + 4096))
                yield pa.RecordBatch.from_arrays([pa.array([f.doc_id(i) for i in span], pa.int64()), pa.array(starts[span.start : span.stop], pa.int64()), pa.array(f.counts[span.start : span.stop], pa.int64()), pa.array([zlib.crc32(f.ids(i).tobytes()) for i in span], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])
            f.close()


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Reads every file of a manifest back: doc_id, start, n_tokens, ids_crc32. The running total goes over one row per
    shard, at most ``max_shards``, and within each shard over its files."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(shards, "shard")
    return files.repartition(max(shares(manifest), 1), "path").select("path", F.col("first") + F.col("base")).mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
