"""Best-fit packing of token pieces into sequences, with a swap-based local search."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import Counter
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import schema_plus, table, unused, written
from .encode import batches_of, encoder

END = 1
CAPACITY = 4096


def _pieces(batches, text_at: int, path: str, mode: str, end: int, capacity: int, with_ids: bool):
    enc = encoder(path, mode)
    for batch in (x.slice(k, 2048) for x in batches for k in range(0, x.num_rows, 2048)):
        texts = [t or "" for t in batch.column(text_at).to_pylist()]
        for a, b in batches_of(texts, 1 << 20):
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for k, own in enumerate(enc.encode_many(texts[a:b])):
                own = np.append(own, np.uint32(end)).astype("<u4")
                for n, at in enumerate(range(0, len(own), capacity)):
                    part = own[at : at + capacity]
                    row.append(k)
                    piece.append(n)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part.tobytes()))
                    if with_ids:
                        ids.append(part.tobytes())
            rest = batch.slice(a, b - a).take(pa.array(row, pa.int64()))
            columns = [c for k, c in enumerate(rest.columns) if k != text_at]
            names = [n for k, n in enumerate(rest.schema.names) if k != text_at]
            columns += [pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names += ["piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)


def token_pieces(df: DataFrame, path: str, text_col: str = "text", mode: str = "words", end: int = END, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row a piece: the columns of ``df`` but the text, then piece, start, length, ids_crc32 (and
    ids, little-endian unsigned 32 bits each). A document is its ids and ``end``; only one longer
    than ``capacity`` is cut. Null text counts as empty."""
    df = df.drop("piece", "start", "length", "ids_crc32", "ids")
    at = df.columns.index(text_col)
    schema = schema_plus(df.drop(text_col), "piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)
    return df.mapInArrow(lambda it: _pieces(it, at, path, mode, end, capacity, with_ids), schema)


# -- the packing plan, over lengths and how often each occurs ------------------------------------


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Best fit, longest first, over lengths with multiplicities: one bin is filled with the longest
    lengths that still fit, and as many equal bins are taken as the counts allow. Returns
    {sorted lengths of a bin: number of such bins}."""
    left = {n: c for n, c in counts.items() if c}
    order = sorted(left)
    bins: Counter = Counter()
    while order:
        use: Counter = Counter()
        free = capacity
        at = len(order)
        while at and (at := bisect_right(order, free, 0, at)):
            n = order[at - 1]
            take = min(free // n, left[n])
            use[n] += take
            free -= take * n
            at -= 1
        times = min(left[n] // k for n, k in use.items())
        bins[tuple(sorted(use.elements()))] += times
        for n, k in use.items():
            left[n] -= times * k
            if not left[n]:
                del left[n]
                order.remove(n)
    return bins


def _exchange(low: tuple, high: tuple, slack: int):
    """The move or exchange that raises the fill of ``high`` most without passing ``slack``: one
    document moved, one for one, one for two or two for one. Returns (out of low, out of high)."""
    best, pick = 0, None
    lows, highs = sorted(set(low)), sorted(set(high))
    at = bisect_right(lows, slack) - 1
    if at >= 0:
        best, pick = lows[at], ((lows[at],), ())
    twos = sorted({(a + b, a, b) for i, a in enumerate(lows) for b in lows[i:] if a != b or low.count(a) > 1})
    for y in highs:
        if best == slack:
            return pick
        at = bisect_right(lows, y + slack) - 1
        if at >= 0 and lows[at] - y > best:
            best, pick = lows[at] - y, ((lows[at],), (y,))
        at = bisect_right(twos, (y + slack, 1 << 60)) - 1
        if at >= 0 and twos[at][0] - y > best:
            best, pick = twos[at][0] - y, (twos[at][1:], (y,))
    for i, a in enumerate(highs):
        for b in highs[i:]:
            if best == slack:
                return pick
            if a == b and high.count(a) < 2:
                continue
            at = bisect_right(lows, a + b + slack) - 1
            if at >= 0 and lows[at] - a - b > best:
                best, pick = lows[at] - a - b, ((lows[at],), (a, b))
    return pick



def _without(have: tuple, out: tuple, into: tuple) -> tuple:
    new = list(have)
    for x in out:
        new.remove(x)
    for x in into:
        insort(new, x)
    return tuple(new)


def improve(bins: Counter, capacity: int) -> Counter:
    """Local search: documents move from emptier bins into fuller ones, alone or in exchange for one
    or two shorter ones, each step raising the sum of squared fills, until the bound (all tokens over
    the capacity) is met or no two bins have a step left. Equal bins take a step together.

    Whether two kinds of bins have a step depends on them alone, so a pair without one is not looked
    at again; a kind that appears later is held against all others."""
    total = sum(sum(b) * n for b, n in bins.items())
    least, number = -(-total // capacity), sum(bins.values())
    full = Counter({b: n for b, n in bins.items() if sum(b) == capacity})
    open_ = Counter({b: n for b, n in bins.items() if sum(b) < capacity})
    fill = {b: sum(b) for b in open_}
    seen = sorted(open_, key=lambda b: (-fill[b], b))  # kinds in the order in which they appear
    upto, stuck = dict.fromkeys(seen, 0), {b: set() for b in seen}
    waiting = [(fill[b], b) for b in seen]
    heapify(waiting)
    done: list = []  # kinds held against all of ``seen``
    while number > least:
        if not waiting:
            waiting = [(fill[b], b) for b in done if b in open_ and upto[b] < len(seen)]
            heapify(waiting)
            done = [b for b in done if b in open_ and upto[b] == len(seen)]
            if not waiting:
                break
        low = waiting[0][1]
        if low not in open_:
            heappop(waiting)
            continue
        end = len(seen)
        fresh = sorted({b for b in seen[upto[low] : end] if b in open_ and fill[b] >= fill[low] and b not in stuck[low]}, key=lambda b: (-fill[b], b))
        if low not in stuck[low] and open_[low] > 1 and low not in fresh:
            fresh.append(low)
        for high in fresh:
            if high == low and open_[low] < 2:
                continue
            pick = _exchange(low, high, capacity - fill[high])
            if pick is None:
                stuck[low].add(high)
                continue
            times = open_[low] // 2 if high == low else min(open_[low], open_[high])
            for b in (low, high):
                open_[b] -= times
                if not open_[b]:
                    del open_[b]
            for b in (_without(low, pick[0], pick[1]), _without(high, pick[1], pick[0])):
                if not b:
                    number -= times
                elif sum(b) == capacity:
                    full[b] += times
                else:
                    if b not in open_:
                        fill[b] = sum(b)
                        seen.append(b)
                        if b not in upto:
                            upto[b], stuck[b] = 0, set()
                        heappush(waiting, (fill[b], b))
                    elif upto[b] == len(seen) and open_[b] == 1:  # it can be held against itself now
                        heappush(waiting, (fill[b], b))
                    open_[b] += times
            break
        else:
            heappop(waiting)
            upto[low] = end
            done.append(low)
    return full + open_


def plan_slots(counts: dict[int, int], capacity: int) -> list[tuple]:
    """(length, first rank, end of ranks, copies a bin, first sequence, offset): the pieces of one
    length, numbered from 0, in the order in which the plan's bins take them."""
    used: Counter = Counter()
    slots, sequence = [], 0
    for b, times in sorted(improve(best_fit(counts, capacity), capacity).items(), reverse=True):
        offset = 0
        for n, copies in sorted(Counter(b).items(), reverse=True):
            slots.append((n, used[n], used[n] + copies * times, copies, sequence, offset))
            used[n] += copies * times
            offset += copies * n
        sequence += times
    return slots


def pack_pieces(pieces: DataFrame, row: str, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to each row of ``pieces`` (column length, 1 to ``capacity``; ``row``
    names a column that numbers the rows, no two alike).

    How pieces fit depends on their lengths alone, so the driver plans over the histogram of
    lengths (at most ``capacity`` rows, whatever the input's size): best fit, then the local search
    of ``improve``. The plan names, for each length, ranges of ranks and where they go; pieces of a
    length are ranked by counting them in salted parts, so a length that a third of all pieces have
    is ranked by many tasks. Only the narrow rows of ``pieces`` shuffle, once.

    ``pieces`` is read twice and must give the same rows both times: pass a written table. Rows
    that repeat are pieces of their own. An empty table gives an empty result."""
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    salts = max(64, -(-max(counts.values(), default=0) // 100_000))
    salt, base, rank, own = unused(pieces, "salt", "base", "rank", "own")
    salted = pieces.withColumn(salt, F.pmod(F.xxhash64(row), F.lit(salts)))
    sizes = salted.groupBy("length", salt).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1))
    bases = sizes.select("length", salt, F.coalesce(before, F.lit(0)).alias(base))
    ranked = salted.withColumn(rank, F.row_number().over(Window.partitionBy("length", salt).orderBy(row)) - 1).join(bases, ["length", salt]).withColumn(rank, F.col(rank) + F.col(base))
    schema = "length long, first long, until long, copies long, sequence long, place long"
    names = unused(pieces, "first", "until", "copies", "sequence", "place")
    slots = pieces.sparkSession.createDataFrame(plan_slots(counts, capacity), schema).toDF("length", *names)
    first, until, copies, sequence, place = map(F.col, names)
    placed = ranked.join(F.broadcast(slots), "length").where((F.col(rank) >= first) & (F.col(rank) < until)).withColumn(own, F.col(rank) - first)
    sequence = sequence + F.floor(F.col(own) / copies)
    offset = place + (F.col(own) % copies) * F.col("length")
    return placed.select(*pieces.columns, sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def packed_sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the sequences themselves, from placed pieces with their ids. A
    group is one sequence, so its size is bounded by the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    return placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), joined.alias("ids"))


def pack_documents(df: DataFrame, path: str, text_col: str = "text", with_ids: bool = False, capacity: int = CAPACITY) -> DataFrame:
    """Cuts, encodes and packs whole documents: the pieces of ``token_pieces`` with sequence_id and
    offset.

    Defined cases: null or empty texts are the end id alone; null ids and repeated rows are packed like
    any other; columns of ``df`` that bear a result's name are replaced, others, whatever their
    names, stay; an empty table gives an empty result. Which of several pieces of one length goes where
    depends on the order of rows; the number of sequences does not."""
    made = token_pieces(df.drop("sequence_id", "offset"), path, text_col, with_ids=with_ids, capacity=capacity)
    (row,) = unused(made, "row")
    pieces = written(made.withColumn(row, F.monotonically_increasing_id()), "pieces")
    return pack_pieces(pieces, row, capacity).drop(row)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns from ``pack_documents`` over all documents."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
