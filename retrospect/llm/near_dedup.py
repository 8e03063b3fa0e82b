"""SimHash near-duplicates of a stated similarity: fingerprints of shingle sets are compared bit-sliced
within a radius that the similarity asks for, the Jaccard similarity of whole sets decides,
components.

At a Jaccard similarity of 0.8 two fingerprints of 64 bits differ in about 10 bits, so that no few
blocks of bits are sure to agree (op 7 finds its 4 bits that way). Documents meet in bands of minimum
hashes instead; who meets is compared by fingerprint as in op 7."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitslice import BITS, least_reached, shifted_pairs, spanning_links
from .common import connected_components, schema_plus, written
from .encode import batches_of
from .simhash import SMALL, _groups

SEED = 42
#: Minimum hashes that make up a band's key.
ROWS = 4
#: Sets and shingles of one bucket that one task compares at once; a larger bucket is dealt out in tiles.
TILE, TILE_SHINGLES = 4096, 1 << 20
_CONSTANTS = np.random.default_rng(20_240_502).integers(1, 1 << 63, (3, 4096), np.uint64) | np.uint64(1)


def plan_bands(similarity: float, rows: int = ROWS, miss: float = 1e-3) -> int:
    """As many bands as leave a pair at exactly the similarity a chance of ``miss`` to meet in none."""
    meet = similarity**rows
    return 1 if meet >= 1 else math.ceil(math.log(miss) / math.log(1 - meet))


def _differ(shared: int, one: int, two: int) -> float:
    """The chance that a bit of two sets' fingerprints differs: ``shared`` common hashes, ``one`` and
    ``two`` of their own. Ties, which count as 0, make it larger for small sets of even size."""
    chance = lambda n: [math.comb(n, k) / 2**n for k in range(n + 1)]
    total = 0.0
    for k, p in enumerate(chance(shared)):
        a = sum(q for x, q in enumerate(chance(one)) if 2 * (k + x) > shared + one)
        b = sum(q for x, q in enumerate(chance(two)) if 2 * (k + x) > shared + two)
        total += p * (a * (1 - b) + b * (1 - a))
    return total


def plan_radius(similarity: float, miss: float = 1e-3) -> int:
    """The radius that a pair at the similarity passes with a chance of ``miss`` at most. Sets of
    Jaccard similarity J have a cosine of at least 2 J / (1 + J); a bit differs with the chance of
    the angle over pi, or for sets of a few hashes with that of ``_differ``."""
    p = math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi
    for shared in range(1, 33):
        own = math.floor(shared * (1 - similarity) / similarity + 1e-9)
        p = max([p, *(_differ(shared, x, y) for x in range(own + 1) for y in range(x, own + 1 - x))])
    over = 1.0
    for radius in range(BITS + 1):
        over -= math.comb(BITS, radius) * p**radius * (1 - p) ** (BITS - radius)
        if over <= miss:
            return radius
    return BITS


def set_fingerprint(hashes: np.ndarray) -> int:
    """SimHash of a set of 64-bit hashes: a bit is 1 if set in over half of them."""
    ones = np.zeros(BITS, np.int64)
    raw = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for at in range(0, len(raw), 255):  # sums of at most 255 bits fit a byte
        ones += np.unpackbits(raw[at : at + 255], axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > len(raw), bitorder="little").tobytes(), "little", signed=True)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes, width: int) -> np.ndarray:
    """The set of a text's shingles of ``width`` words as sorted 64-bit hashes; words as in op 7.
    Fewer words are one shingle, no word is a shingle of its own."""
    words = text.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return np.zeros(1, np.uint64)
    digest = xxhash.xxh64_digest
    each = np.frombuffer(b"".join([digest(w, SEED) for w in words]), np.uint64)
    n, width = max(1, len(words) - width + 1), min(width, len(words))
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out += _mixed(each[k : k + n] + _CONSTANTS[0, k]) * _CONSTANTS[1, k]
    return np.unique(_mixed(out))


def band_keys(sets: list[np.ndarray], bands: int, rows: int = ROWS) -> np.ndarray:
    """Per set the keys of its ``bands`` bands, each of ``rows`` minimum hashes."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    keys = np.zeros((len(sets), bands), np.uint64)
    for k in range(bands * rows):
        least = np.minimum.reduceat((flat ^ _CONSTANTS[1, k]) * _CONSTANTS[2, k], starts)
        keys[:, k // rows] = _mixed(keys[:, k // rows] + least * _CONSTANTS[0, k])
    return keys


def _sketches(batches, text_at: int, width: int, bands: int):
    for batch in (x.slice(k, 1024) for x in batches for k in range(0, x.num_rows, 1024)):
        texts = [t or "" for t in batch.column(text_at).to_pylist()]
        for a, b in batches_of(texts, 1 << 19):
            sets = [shingles(t.encode("utf-8", "replace"), width) for t in texts[a:b]]
            keys = band_keys(sets, bands).view(np.int64)
            part = batch.slice(a, b - a)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.ravel()))
            prints = pa.array([set_fingerprint(s) for s in sets], pa.int64())
            made = [pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()), listed, pa.array(list(map(len, sets)), pa.int64()), prints]
            yield pa.RecordBatch.from_arrays([*part.columns, *made], [*part.schema.names, "digest", "keys", "size", "print"])


def spanning_pairs(sets: list[np.ndarray], similarity: Fraction) -> list[tuple[int, int]]:
    """A spanning forest of the graph "Jaccard similarity of at least ``similarity``", exact: a
    search in which each set is held once against those not reached yet. Those reached leave, so
    a dense group of n costs near n comparisons and gives n - 1 pairs, never all of them."""
    num, both = similarity.numerator, similarity.numerator + similarity.denominator
    if len(sets) == 2:
        a, b = sets
        shared = len(np.intersect1d(a, b, assume_unique=True))
        return [(0, 1)] if shared * both >= num * (len(a) + len(b)) else []
    sizes = np.array(list(map(len, sets)))
    kinds, flat = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    own = [flat[s : s + n] for s, n in zip(starts, sizes)]
    left, held, out, frontier = np.arange(len(sets)), np.zeros(len(kinds), bool), [], []
    while len(left) or frontier:
        if not frontier:
            frontier, left = [int(left[0])], left[1:]
        if not len(left):
            break
        now = frontier.pop()
        # only sizes that allow the similarity at all
        fit = (sizes[left] * num <= sizes[now] * (both - num)) & (sizes[now] * num <= sizes[left] * (both - num))
        some = left[fit]
        if not len(some):
            continue
        held[own[now]] = True
        at = np.cumsum(sizes[some]) - sizes[some]
        shared = np.add.reduceat(held[np.concatenate([own[k] for k in some])], at, dtype=np.int64)
        held[own[now]] = False
        hit = some[shared * both >= num * (sizes[now] + sizes[some])]
        out += [(now, int(k)) for k in hit]
        frontier += hit.tolist()
        left = left[~np.isin(left, hit)]
    return out


def _candidates(batches, radius: int):
    """(g1, g2, node): within each (key, tile), the nodes that links "fingerprints within the radius"
    hold together, g1 and g2 naming a group by its members. Nodes without a link are left out."""
    for rows in _groups(batches, 2):
        keys = np.stack([rows.column(k).to_numpy() for k in range(2)])
        node, prints = rows.column(2).to_numpy().view(np.uint64), rows.column(3).to_numpy().view(np.uint64)
        starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
        sizes = np.diff(np.append(starts, len(node)))
        one, two = [], []
        at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL), sizes))
        if len(at):
            last = np.repeat(starts + sizes - 1, sizes)[at]
            i, j = shifted_pairs(prints[at], np.searchsorted(at, last), radius)
            one.append(at[i])
            two.append(at[j])
        for k in np.flatnonzero(sizes > SMALL).tolist():
            i, j = spanning_links(prints[starts[k] : starts[k] + sizes[k]], radius)
            one.append(starts[k] + i)
            two.append(starts[k] + j)
        i, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (one, two))
        if not len(i):
            continue
        label = least_reached(len(node), i, j)
        some = np.unique(np.concatenate([i, j]))
        names = []
        for c in _CONSTANTS[2, :2]:
            name = np.zeros(len(node), np.uint64)
            np.bitwise_xor.at(name, label[some], _mixed(node[some] ^ c))
            names.append(pa.array(name[label[some]].view(np.int64)))
        yield pa.RecordBatch.from_arrays([*names, pa.array(node[some].view(np.int64))], ["g1", "g2", "node"])


def _compare(batches, width: int, similarity: Fraction):
    """(a, b) pairs of nodes that span what is similar within each group."""
    for rows in _groups(batches, 2):
        keys = np.stack([rows.column(k).to_numpy() for k in range(2)])
        starts = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
        ends = np.append(starts[1:], keys.shape[1])
        node, texts, a, b = rows.column("node").to_numpy(), rows.column("__text"), [], []
        for s, e in zip(starts.tolist(), ends.tolist()):
            if e - s > 1:
                found = spanning_pairs([shingles((x.as_py() or "").encode("utf-8", "replace"), width) for x in texts.slice(s, e - s)], similarity)
                a += [s + i for i, _ in found]
                b += [s + j for _, j in found]
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: Fraction = Fraction(4, 5), miss: float = 1e-3) -> DataFrame:
    """(id, component_id) for each row of ``df``: documents whose sets of ``width``-word shingles
    have a Jaccard similarity of at least ``similarity`` are linked, and component_id is the
    smallest id reachable.

    Whole texts are read. Equal sets are one node. Nodes meet in a band of ROWS minimum hashes; there
    are as many bands as leave a pair at the threshold a chance of ``miss`` to meet in none (closer
    pairs meet more surely). Those that meet are compared by SimHash, bit-sliced, within the radius
    that such a pair passes with the chance 1 - ``miss``. The sets themselves, of 64-bit hashes, decide,
    so a link is never below the threshold: texts travel to the groups that fingerprints hold
    together, and only there. Buckets, and groups, with the same members are compared once; a large
    bucket is dealt out to tiles in which each of its parts meets every part. Only spanning pairs
    leave a task.

    Defined cases: a null or empty text, or one of white space only, equals any other such text and
    no text with a word; fewer than ``width`` words are one shingle; null ids stay null and are
    never the smallest unless all of a component are; rows that repeat give rows that repeat;
    columns of ``df`` other than id and text are not read."""
    docs = df.select(F.col(id_col).alias(id_col), F.col(text_col).alias("__text"))
    bands = plan_bands(float(similarity), miss=miss)
    made = docs.mapInArrow(lambda it: _sketches(it, 1, width, bands), schema_plus(docs, "digest binary, keys array<long>, size long, print long"))
    made = written(made.withColumn("row", F.monotonically_increasing_id()), "sketches")
    nodes = written(made.groupBy("digest").agg(F.min("row").alias("node"), F.min(id_col).alias("least"), F.first("keys").alias("keys"), F.first("size").alias("size"), F.first("print").alias("print")), "nodes")

    spread = nodes.select("node", "size", "print", F.explode("keys").alias("key"))
    members = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"m{k}") for k in (1, 2)]
    buckets = spread.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"), *members).where("n > 1")
    parts = F.ceil(F.greatest(F.col("n") / TILE, F.col("shingles") / TILE_SHINGLES)).cast("int").alias("parts")
    buckets = written(buckets.groupBy("n", "shingles", "m1", "m2").agg(F.min("key").alias("key")).select("key", parts), "buckets")
    met = spread.join(buckets, "key").withColumn("part", F.pmod(F.xxhash64("node", F.lit(7)), F.col("parts")).cast("int"))
    tiles = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.least(F.col("part"), q).cast("long") * F.col("parts") + F.greatest(F.col("part"), q))
    met = met.select("key", F.explode(tiles).alias("tile"), "node", "print")
    radius = plan_radius(float(similarity), miss)
    groups = met.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(lambda it: _candidates(it, radius), "g1 long, g2 long, node long")
    # one shuffle by node serves both the repeats and the texts
    groups = groups.repartition("node").distinct().join(made.select(F.col("row").alias("node"), "__text"), "node").select("g1", "g2", "node", "__text")
    links = groups.repartition("g1", "g2").sortWithinPartitions("g1", "g2").mapInArrow(lambda it: _compare(it, width, similarity), "a long, b long")

    roots = written(connected_components(links), "parts").withColumnRenamed("node", "__node")
    named = nodes.join(roots, nodes["node"] == roots["__node"], "left").select("digest", "least", F.coalesce("root", "node").alias("root"))
    firsts = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(firsts, "root").select("digest", "component_id")
    return made.select(id_col, "digest").join(named, "digest").select(id_col, "component_id")
