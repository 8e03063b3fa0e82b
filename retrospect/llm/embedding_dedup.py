"""Embedding near-duplicates: random-hyperplane signs in several tables, exact cosine, components."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .bitslice import least_reached
from .common import connected_components, schema_plus, table, written
from .simhash import _groups

#: Vectors that a bucket should hold, and those of one bucket that one task compares; a larger bucket is dealt out in tiles.
BUCKET, TILE = 1024, 2048
#: Signs of a sketch at least, and rows and pairs that are compared at once.
SKETCH, ROWS, PAIRS = 192, 256, 1 << 15
SEED = 20_240_501


def plan_tables(n: int, cosine: float, miss: float = 1e-3) -> tuple[int, int]:
    """(bits, tables): bits so that a bucket holds about BUCKET of n vectors, and as many tables as
    leave a pair at exactly the threshold a chance of ``miss`` of meeting in none."""
    bits = max(4, min(30, round(math.log2(max(n, 2) / BUCKET))))
    meet = (1 - math.acos(min(1.0, cosine)) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log(1 - meet)) if meet < 1 else 1)


def plan_radius(signs: int, cosine: float, miss: float = 1e-4) -> int:
    """In how many of ``signs`` signs a pair at the threshold differs at most, but for a chance of ``miss``."""
    p = math.acos(min(1.0, cosine)) / math.pi
    chance, over = (1 - p) ** signs, 1.0
    for radius in range(signs + 1):
        over -= chance
        if over <= miss:
            return radius
        chance *= (signs - radius) / (radius + 1) * p / (1 - p)
    return signs


@cache
def hyperplanes(dims: int, signs: int) -> np.ndarray:
    return np.random.default_rng([SEED, dims]).standard_normal((dims, signs))


def unit(v: np.ndarray) -> np.ndarray:
    """Rows of length 1. Each is divided by its largest component first, so that no square of a very
    large or very small component is lost."""
    v = v / np.abs(v).max(axis=1)[:, None]
    return v / np.sqrt((v * v).sum(axis=1))[:, None]


def _sketches(batches, kind: str, bits: int, tables: int, signs: int):
    """Adds digest, vector (bytes), sketch (signs as bytes) and keys (the first signs by tables) in
    place of the column vector, the last; null where a vector is unsound."""
    weight = 1 << np.arange(bits, dtype=np.int64)
    for batch in batches:
        lists = batch.column(batch.num_columns - 1)
        sizes = np.array([0 if n is None else n for n in lists.value_lengths().to_pylist()], np.int64)
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64) + 0.0  # -0.0 and 0.0 are one value, null is nan
        starts = np.cumsum(sizes) - sizes
        out: list[list] = [[None] * len(sizes) for _ in range(4)]
        for n in np.unique(sizes[sizes > 0]).tolist():
            at = np.flatnonzero(sizes == n)
            v = flat[starts[at][:, None] + np.arange(n)]
            sound = np.isfinite(v).all(axis=1) & (v != 0).any(axis=1)
            at, v = at[sound], v[sound]
            if not len(at):
                continue
            sign = unit(v) @ hyperplanes(n, signs) > 0
            sketch = np.packbits(sign, axis=1, bitorder="little")
            keys = (sign[:, : bits * tables].reshape(-1, tables, bits) @ weight).tolist()
            raw = v.astype(kind)
            for k, x, y, z in zip(at.tolist(), raw, sketch, keys):
                b = x.tobytes()
                out[0][k], out[1][k], out[2][k], out[3][k] = xxhash.xxh3_128_digest(b), b, y.tobytes(), z
        kinds = [pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x, t) for x, t in zip(out, kinds))], [*batch.schema.names[:-1], "digest", "vector", "sketch", "keys"])


def _buckets(batches):
    """(rows, table, parts p and q) of each (tab, key, tile, size) of two rows and more."""
    for rows in _groups(batches, 4):
        keys = np.stack([rows.column(k).to_numpy() for k in range(4)])
        starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
        ends = np.append(starts[1:], keys.shape[1])
        for s, e in zip(starts.tolist(), ends.tolist()):
            if e - s > 1:
                yield rows.slice(s, e - s), int(keys[0, s]), int(keys[2, s]) >> 20, int(keys[2, s]) & 0xFFFFF


def _matrix(column, kind) -> np.ndarray:
    """Values of equal length, one a row, without a copy of each."""
    array = column.combine_chunks()
    ends = np.frombuffer(array.buffers()[1], np.int32, len(array) + 1, 4 * array.offset)
    raw = np.frombuffer(array.buffers()[2], np.uint8, ends[-1] - ends[0], ends[0])
    return raw.view(kind).reshape(len(array), -1)


def _first_here(sketch: np.ndarray, i: np.ndarray, j: np.ndarray, tab: int, bits: int) -> np.ndarray:
    """Whether pairs meet in no table before ``tab``: in each of these some sign differs."""
    out = np.ones(len(i), bool)
    for a in range(0, len(i) if tab else 0, PAIRS):
        differ = np.unpackbits(sketch[i[a : a + PAIRS]] ^ sketch[j[a : a + PAIRS]], axis=1, bitorder="little", count=tab * bits)
        out[a : a + PAIRS] = differ.reshape(-1, tab, bits).any(axis=2).all(axis=1)
    return out


def _of_other_parts(part: np.ndarray, i: np.ndarray, j: np.ndarray, p: int, q: int):
    """Pairs of a tile of two parts: those within a part meet in that part's own tile."""
    return part[i] != part[j] if p != q else i != j


def _candidates(batches, bits: int, radius: int):
    """(tab, key, tile, size, part, node) of each vector that has a partner whose sketch lies within the
    radius, and that it meets here and in no earlier table."""
    for rows, tab, p, q in _buckets(batches):
        raw = _matrix(rows.column("sketch"), np.uint8)
        wide, part = np.ascontiguousarray(raw).view(np.uint64), rows.column("part").to_numpy()
        some = np.zeros(len(wide), bool)
        for a in range(0, len(wide), ROWS):
            far = np.bitwise_count(wide[a : a + ROWS, None, :] ^ wide[None, a:, :]).sum(axis=2, dtype=np.int32)
            i, j = np.nonzero(far <= radius)
            i, j = i + a, j + a
            ok = (i < j) & _of_other_parts(part, i, j, p, q)
            i, j = i[ok], j[ok]
            ok = _first_here(raw, i, j, tab, bits)
            some[i[ok]] = some[j[ok]] = True
        if some.any():
            yield rows.filter(pa.array(some)).drop_columns(["sketch"]).combine_chunks().to_batches()[0]


def _compare(batches, bits: int, cosine: float, kind: str):
    """Per vector: partners linked here and in no earlier table (their copies counted), and one link
    towards the smallest node reached."""
    for rows, tab, p, q in _buckets(batches):
        node, copies, part = (rows.column(c).to_numpy() for c in ("node", "copies", "part"))
        v, sketch = unit(_matrix(rows.column("vector"), kind).astype(np.float64)), _matrix(rows.column("sketch"), np.uint8)
        n, label = np.zeros(len(v), np.int64), np.arange(len(v))
        for a in range(0, len(v), ROWS):
            i, j = np.nonzero(v[a : a + ROWS] @ v[a:].T >= cosine)
            i, j = i + a, j + a
            ok = (i < j) & _of_other_parts(part, i, j, p, q)
            i, j = i[ok], j[ok]
            ok = _first_here(sketch, i, j, tab, bits)
            i, j = i[ok], j[ok]
            np.add.at(n, i, copies[j])
            np.add.at(n, j, copies[i])
            label = least_reached(len(v), np.concatenate([i, np.arange(len(v))]), np.concatenate([j, label]))
        some = np.flatnonzero(n)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.array(n[some]), pa.array(node[label[some]])], ["node", "n", "other"])


def embedding_links(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, miss: float = 1e-3) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of ``df``.

    Vectors of equal length are linked if their cosine, in double precision, is at least
    ``cosine`` and they meet in a bucket: signs of ``bits`` random hyperplanes make a bucket's key,
    and there are as many tables as leave a pair at the threshold a chance of ``miss`` to meet in
    none (closer pairs meet more surely). n_links counts the other rows linked directly,
    component_id is the smallest id reachable, kept tells whether that is the row's own.

    Rows with the same vector (by 128 bits of a hash) are one class with a count, so copies make no
    pairs. To the buckets of all tables travel sketches of SKETCH signs or more, not vectors; a vector
    goes only where a partner's sketch differs in no more signs than a pair at the threshold does
    (but for a chance of 0.0001), and where they meet first: a pair that meets in several tables
    counts in the first only, which the sketches tell without a shuffle of pairs. Buckets above
    TILE are dealt out: each of their parts meets every part in one task of at most 2 TILE rows. Only
    counts and one link a vector and bucket leave a task, never pairs.

    Defined cases: a vector that is null, empty, all zero, or holds a null or a non-finite
    component links with nothing, its own copies included, and is kept; finite vectors of any magnitude
    link by direction; vectors of different lengths never link; null ids are never the smallest id unless all of a
    component are; an id's rows that repeat are rows of their own; other columns of ``df`` are not read."""
    bits, tables = plan_tables(df.count(), cosine, miss)
    signs = -(-max(SKETCH, bits * tables) // 64) * 64
    kind = "<f4" if isinstance(df.schema[vector_col].dataType.elementType, FloatType) else "<f8"
    read = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    made = read.mapInArrow(lambda it: _sketches(it, kind, bits, tables, signs), schema_plus(read.select("id"), "digest binary, vector binary, sketch binary, keys array<int>"))
    made = written(made.withColumn("row", F.monotonically_increasing_id()), "vectors")
    sound = made.where("digest is not null")
    first = F.min(F.struct("row", "sketch", "keys", F.octet_length("vector").cast("long").alias("size"))).alias("f")
    nodes = written(sound.groupBy("digest").agg(F.count("*").alias("copies"), F.min("id").alias("least"), first).select("digest", "copies", "least", F.col("f.row").alias("node"), "f.sketch", "f.keys", "f.size"), "nodes")

    spread = nodes.select(F.posexplode("keys").alias("tab", "key"), "size", "node", "sketch")
    hot = written(spread.groupBy("tab", "key", "size").count().where(f"count > {TILE}").select("tab", "key", "size", F.ceil(F.col("count") / TILE).cast("long").alias("parts")), "hot")
    if hot.isEmpty():
        spread = spread.withColumns({"part": F.lit(0).cast("long"), "tile": F.lit(0).cast("long")})
    else:
        spread = spread.join(hot, ["tab", "key", "size"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("node", F.lit(7)), "parts"), F.lit(0)))
        pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1), lambda q: F.least(F.col("part"), q) * (1 << 20) + F.greatest(F.col("part"), q))
        spread = spread.withColumn("tile", F.explode(pairs))
    order, radius = ["tab", "key", "tile", "size"], plan_radius(signs, cosine)
    spread = spread.select(F.col("tab").cast("long"), F.col("key").cast("long"), "tile", "size", "part", "node", "sketch")
    some = spread.repartition(*order).sortWithinPartitions(*order).mapInArrow(lambda it: _candidates(it, bits, radius), "tab long, key long, tile long, size long, part long, node long")
    vectors = nodes.select("node", "copies", "sketch").join(made.select(F.col("row").alias("node"), "vector"), "node")
    some = some.join(vectors, "node").select(*order, "part", "node", "copies", "sketch", "vector")
    met = some.repartition(*order).sortWithinPartitions(*order).mapInArrow(lambda it: _compare(it, bits, cosine, kind), "node long, n long, other long")
    met = written(met, "met")

    counts = met.groupBy("node").agg(F.sum("n").alias("n"))
    parts = written(connected_components(met, "node", "other"), "parts")
    named = nodes.select("node", "digest", "copies", "least").join(counts, "node", "left").join(parts, "node", "left")
    named = named.select("digest", "least", F.coalesce("root", "node").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    firsts = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(firsts, "root").select("digest", "n_links", "component_id")
    linked = sound.select("id", "digest").join(named, "digest").select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
    alone = made.where("digest is null").select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return linked.unionByName(alone)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(table(spark, sf_dir, "embeddings"))
