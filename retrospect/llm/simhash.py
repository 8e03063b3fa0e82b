"""SimHash near-duplicates: fingerprints, blocked bit-sliced comparison, components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitslice import BITS, least_reached, shifted_pairs, spanning_links
from .common import connected_components, schema_plus, table, written

SEED = 42
#: Rows of one key that one task compares; a key with more is dealt out in tiles.
TILE = 1024
#: Groups of one key up to this size are compared many at a time, larger ones on their own.
SMALL = 48


def fingerprint(text: bytes, width: int, chunk: int = 1 << 15) -> int:
    """SimHash of the XXH64 of all word shingles of ``width`` words, repeats included."""
    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_digest
    for k in range(0, n, chunk):
        raw = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + chunk], ends[k : k + chunk])])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1)
        for at in range(0, len(bits), 255):  # sums of at most 255 bits fit a byte
            ones += bits[at : at + 255].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _fingerprints(batches, text_at: int, width: int):
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            prints = [_signed(fingerprint(t.as_py() or b"", width)) for t in part.column(text_at).cast(pa.binary())]
            names = [n for k, n in enumerate(part.schema.names) if k != text_at]
            yield pa.RecordBatch.from_arrays([*(c for k, c in enumerate(part.columns) if k != text_at), pa.array(prints, pa.int64())], [*names, "print"])


def with_fingerprints(df: DataFrame, text_col: str = "text", width: int = 4) -> DataFrame:
    """``df`` with its text column replaced by print (the 64 bits as a signed long)."""
    at = df.columns.index(text_col)
    return df.mapInArrow(lambda it: _fingerprints(it, at, width), schema_plus(df.drop(text_col), "print long"))


def masks(radius: int, blocks: int) -> list[int]:
    """Bit masks such that any two fingerprints within the radius agree under one of them: of
    ``blocks`` blocks at most ``radius`` can differ, so some ``blocks - radius`` of them agree."""
    cuts = [round(k * BITS / blocks) for k in range(blocks + 1)]
    part = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(part, blocks - radius)]


def _groups(batches, sort_by: int):
    """Arrow batches, sorted by key, cut where the key changes: yields whole groups, as many as a
    batch has. Only the last group of a batch waits for the next one, and groups are bounded."""
    wait: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(sort_by)])
        change = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        if wait and any(wait[-1].column(k)[-1] != batch.column(k)[0] for k in range(sort_by)):
            yield pa.Table.from_batches(wait).combine_chunks()
            wait = []
        if len(change):
            yield pa.Table.from_batches([*wait, batch.slice(0, change[-1])]).combine_chunks()
            wait = [batch.slice(change[-1])]
        else:
            wait.append(batch)
    if wait:
        yield pa.Table.from_batches(wait).combine_chunks()


def _links(batches, radius: int):
    """(a, b) links that span what is linked within each (mask, key, tile)."""
    for rows in _groups(batches, 3):
        keys = np.stack([rows.column(k).to_numpy() for k in range(3)])
        prints = rows.column(3).to_numpy().view(np.uint64)
        new = np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.concatenate([starts, [len(prints)]]))
        a, b = [], []
        small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
        if small.any():
            last = np.repeat(starts + sizes - 1, sizes)
            at = np.flatnonzero(small)
            ends = np.searchsorted(at, last[at])
            i, j = shifted_pairs(prints[at], ends, radius)
            if len(i):
                label = least_reached(len(at), i, j)
                moved = np.flatnonzero(label != np.arange(len(at)))
                a.append(prints[at][moved])
                b.append(prints[at][label[moved]])
        for k in np.flatnonzero(sizes > SMALL):
            own = prints[starts[k] : starts[k] + sizes[k]]
            i, j = spanning_links(own, radius)
            a.append(own[i])
            b.append(own[j])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])


def link_prints(prints: DataFrame, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """Links (a, b) between different fingerprints of the column print (distinct, not null) that
    span every component of the graph "at most ``radius`` differing bits"; not all its pairs.

    Candidates: the bits are cut into ``blocks`` (radius + 2) blocks, and fingerprints meet under
    each choice of blocks - radius of them, so none within the radius is missed. Rows that meet
    are compared bit-sliced. A key that many fingerprints share is dealt out to tiles: each of its
    s = ceil(n / TILE) parts meets every part in one tile, so that a task compares 2 TILE rows at
    most and each pair still meets. More blocks mean more copies of the rows and smaller groups,
    for inputs of 10^9 different fingerprints and more."""
    blocks = blocks or radius + 2
    keys = [F.struct(F.lit(k).alias("mask"), F.col("print").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks(radius, blocks))]
    rows = prints.select("print", F.explode(F.array(*keys)).alias("k")).select("k.mask", "k.key", "print")
    hot = written(rows.groupBy("mask", "key").count().where(f"count > {TILE}").select("mask", "key", F.ceil(F.col("count") / TILE).cast("int").alias("parts")), "hot")
    if hot.isEmpty():
        rows = rows.withColumn("tile", F.lit(0))
    else:
        part = F.pmod(F.xxhash64("print", F.lit(7)), F.col("parts")).cast("int")
        tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.least(F.col("part"), q) * F.col("parts") + F.greatest(F.col("part"), q))
        rows = rows.join(hot, ["mask", "key"], "left").withColumn("part", part)
        rows = rows.withColumn("tile", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(tiles)))
    rows = rows.select(F.col("mask").cast("long"), "key", F.col("tile").cast("long"), "print")
    sorted_ = rows.repartition("mask", "key", "tile").sortWithinPartitions("mask", "key", "tile")
    return sorted_.mapInArrow(lambda it: _links(it, radius), "a long, b long")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """(id, print, component_id) for each row of ``df``: documents whose fingerprints differ in at
    most ``radius`` bits are linked, and component_id is the smallest id reachable.

    Whole texts are read. Equal fingerprints are one node, so copies never make pairs.

    Defined cases: a null or empty text, or one of white space only, has the fingerprint 0 and is
    linked like any other; fewer than ``width`` words are one shingle; null ids stay null and are
    never the smallest unless all of a component are; rows that repeat give rows that repeat;
    columns of ``df`` other than id and text are not read."""
    prints = written(with_fingerprints(df.select(F.col(id_col).alias(id_col), F.col(text_col).alias("__text")), "__text", width), "prints")
    nodes = written(prints.groupBy("print").agg(F.min(id_col).alias("least")), "nodes")
    parts = written(connected_components(link_prints(nodes.select("print"), radius)), "parts")
    classes = nodes.join(parts, nodes["print"] == parts["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    firsts = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    named = classes.join(firsts, "root").select("print", "component_id")
    return prints.join(named, "print").select(id_col, "print", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
