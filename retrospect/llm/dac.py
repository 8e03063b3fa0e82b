"""Token ids in directly addressable codes: written in document order, read back at any place."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, table
from .encode import batches_of, encoder

MAGIC = b"DAC1"
#: Bits between two entries of a rank directory, and tokens after which a segment ends.
BLOCK, SEGMENT = 512, 1 << 19
#: Parts that a worker's encoder remembers here.
REMEMBERED = 300_000
#: How files are stored: no compression around the codes, no dictionary, a row group a row.
STORED = {"compression": "none", "parquet.enable.dictionary": "false", "parquet.block.size": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}


def encode_levels(ids: np.ndarray) -> bytes:
    """A segment: MAGIC, number of levels and of ids, then for each level the low 8 bits that are
    left of each id, a bitmap telling which ids go on to the next level, and a directory with the
    number of such ids before each block of 512. All integers are little-endian."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bitmap = np.packbits(np.pad(more, (0, -len(more) % BLOCK)), bitorder="little")
        ones = np.bitwise_count(bitmap.reshape(-1, BLOCK // 8)).sum(axis=1, dtype=np.uint32)
        directory = np.concatenate([[0], np.cumsum(ones, dtype=np.uint32)]).astype("<u4")
        levels.append(b"".join([np.array([len(rest)], "<u8").tobytes(), directory.tobytes(), bitmap.tobytes(), (rest & 0xFF).astype(np.uint8).tobytes()]))
        if not more.any():
            return MAGIC + np.array([len(levels), len(ids)], "<u4").tobytes() + b"".join(levels)
        rest = rest[more] >> 8


class Segment:
    """Random access to a segment's ids, without decoding what lies around them. ``source`` is the
    segment's bytes, or a function (place, number of bytes) that fetches some of them: one id takes a
    byte and a bit a level and at most one directory entry and 64 bytes of bitmap."""

    def __init__(self, source):
        self.fetch = source if callable(source) else lambda at, n: memoryview(source)[at : at + n]
        head = bytes(self.fetch(0, 12))
        if head[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        n_levels, self.n = np.frombuffer(head, "<u4", 2, 4).tolist()
        #: Of each level: how many ids it holds, and where its directory, bitmap and codes begin.
        self.levels, at = [], 12
        for _ in range(n_levels):
            n = int(np.frombuffer(self.fetch(at, 8), "<u8")[0])
            blocks = -(-n // BLOCK)
            bitmap = at + 8 + 4 * (blocks + 1)
            self.levels.append((n, at + 8, bitmap, bitmap + blocks * BLOCK // 8))
            at = bitmap + blocks * BLOCK // 8 + n

    def _rank(self, level: int, i: int) -> int:
        """Bits set before place i: the directory's entry and at most 64 bytes of bitmap."""
        _, directory, bitmap, _ = self.levels[level]
        block, within = divmod(i, BLOCK)
        before = int(np.frombuffer(self.fetch(directory + 4 * block, 4), "<u4")[0])
        if not within:
            return before
        own = np.frombuffer(self.fetch(bitmap + block * BLOCK // 8, (within + 7) // 8), np.uint8).copy()
        if within % 8:
            own[-1] &= (1 << within % 8) - 1
        return before + int(np.bitwise_count(own).sum())

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level, (_, _, bitmap, chunk) in enumerate(self.levels):
            value |= self.fetch(chunk + i, 1)[0] << 8 * level
            if not self.fetch(bitmap + i // 8, 1)[0] >> (i % 8) & 1:
                break
            i = self._rank(level, i)
        return value

    def read(self, start: int, end: int) -> np.ndarray:
        """The ids at places start to end, from these places' bytes at each level only."""
        out = np.zeros(end - start, np.uint32)
        at = np.arange(end - start)
        for level, (_, _, bitmap, chunk) in enumerate(self.levels):
            if end <= start:
                break
            out[at] |= np.frombuffer(self.fetch(chunk + start, end - start), np.uint8).astype(np.uint32) << np.uint32(8 * level)
            raw = np.frombuffer(self.fetch(bitmap + start // 8, -(-end // 8) - start // 8), np.uint8)
            bits = np.unpackbits(raw, bitorder="little")[start % 8 :][: end - start]
            at = at[bits.astype(bool)]
            start, end = self._rank(level, start), self._rank(level, end)
        return out


def file_segments(file) -> list[Segment]:
    """The segments of one file of ``write_token_ids``, in order, over an open binary file that can
    seek. The footer tells where each row group, one segment, has its codes, which are stored as
    they are; from there on an id is fetched by its place, and no page is read or decoded."""
    import pyarrow.parquet as pq

    meta, out = pq.ParquetFile(file).metadata, []

    def at(base):
        def fetch(place, n):
            file.seek(base + place)
            return file.read(n)

        return fetch

    for group in range(meta.num_row_groups):
        column = next(c for c in (meta.row_group(group).column(k) for k in range(meta.num_columns)) if c.path_in_schema == "codes")
        file.seek(column.data_page_offset)
        head = file.read(256)
        if meta.row_group(group).num_rows != 1 or column.compression != "UNCOMPRESSED" or MAGIC not in head:
            raise ValueError("not a file of directly addressable codes")
        out.append(Segment(at(column.data_page_offset + head.index(MAGIC))))
    return out


def _segments(batches, path: str, mode: str, end: int, segment: int):
    """Batches of (doc_id, text) of one shard, in order, as its segments in order."""
    enc, shard = encoder(path, mode, REMEMBERED), TaskContext.get().partitionId()
    ids, docs, starts, n, number, before = [], [], [0], 0, 0, 0

    def flush():
        nonlocal ids, docs, starts, n, number, before
        raw = encode_levels(np.concatenate(ids))
        out = pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int32()), pa.array([number], pa.int32()), pa.array([before], pa.int64()), pa.array([n], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([starts], pa.list_(pa.int64())), pa.array([raw], pa.binary())],
            ["shard", "segment", "before", "n_tokens", "doc_ids", "starts", "codes"],
        )
        ids, docs, starts, number, before, n = [], [], [0], number + 1, before + n, 0
        return out

    for batch in (x.slice(k, 2048) for x in batches for k in range(0, x.num_rows, 2048)):
        names, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        for a, b in batches_of(texts):
            for doc, own in zip(names[a:b], enc.encode_many(texts[a:b])):
                ids.append(np.append(own, np.uint32(end)))
                n += len(own) + 1
                docs.append(doc)
                starts.append(n)
                if n >= segment:
                    yield flush()
    if docs:
        yield flush()


def write_token_ids(df: DataFrame, out: str, path: str, id_col: str = "doc_id", text_col: str = "text", mode: str = "blanks", end: int = 2, segment: int = SEGMENT) -> None:
    """Writes the ids of every whole text, ``end`` after each, in ascending order of the id.

    Texts are dealt out by ranges of the id and sorted; each task writes its shard as segments of
    about ``segment`` ids, a row and row group of a Parquet file each: shard, segment, before (ids of
    the shard before it), n_tokens, doc_ids, starts (each document's place in the segment, and the
    end) and codes (see ``encode_levels``), which are stored uncompressed, so that ``file_segments``
    reads any id at its place. Spark's committer publishes a shard's file once, so a lost
    executor leaves no half of one. A document is never split, nor held with others beyond a segment.

    Defined cases: null text counts as empty; a null id comes first; rows with equal ids are ordered
    by text and written each; other columns are not read; an empty table writes files without rows."""
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    schema = "shard int, segment int, before long, n_tokens long, doc_ids array<long>, starts array<long>, codes binary"
    ordered.mapInArrow(lambda it: _segments(it, path, mode, end, segment), schema).write.options(**STORED).parquet(out)


def _documents(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            shard, before, docs, starts, raw = (batch.column(n)[row].as_py() for n in ("shard", "before", "doc_ids", "starts", "codes"))
            codes = Segment(raw)
            crc = [zlib.crc32(codes.read(a, b).astype("<u4").tobytes()) for a, b in zip(starts, starts[1:])]
            n = len(docs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * n, pa.int32()), pa.array(docs, pa.int64()), pa.array([before + s for s in starts[:-1]], pa.int64()), pa.array([b - a for a, b in zip(starts, starts[1:])], pa.int64()), pa.array(crc, pa.int64())],
                ["shard", "doc_id", "within", "n_tokens", "ids_crc32"],
            )


def read_token_ids(spark: SparkSession, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in the files: start counts the ids of
    all documents before it. Each document's ids are read at their own place in the codes. The sum
    over shards before a shard is over one narrow row a shard."""
    files = spark.read.parquet(out)
    totals = files.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = totals.select("shard", before.alias("base"))
    docs = files.select("shard", "before", "doc_ids", "starts", "codes").mapInArrow(_documents, "shard int, doc_id long, within long, n_tokens long, ids_crc32 long")
    return docs.join(base, "shard").select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def op3_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = new_path(spark, "token-ids")
    write_token_ids(table(spark, sf_dir, "documents"), out, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_ids(spark, out)
