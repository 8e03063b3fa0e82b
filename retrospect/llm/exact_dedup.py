"""Exact deduplication: two passes over a Bloom filter, only possible repeats shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import counted_join, table, written

#: Bits of one slice of the filter (what bitmap_construct_agg makes), and the most slices of a filter (32 MB).
SLICE_BITS, MOST_SLICES = 32768, 8192
BITS_A_HASH = 16
#: Rows of a group from which its result may be broadcast (see ``counted_join``).
LARGE = 200


def normalised(text):
    """Null as empty; each run of blanks, tabs, line ends and the like as one blank."""
    run = "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+"
    return F.regexp_replace(F.coalesce(text, F.lit("")), run, " ")


def _slots(hash_, slices: int) -> list:
    """Two slots of the filter, of independent bits of the hash."""
    bits = slices * SLICE_BITS
    return [F.pmod(F.xxhash64(hash_, F.lit(seed)), F.lit(bits)) for seed in (1, 2)]


def repeated_filter(hashes: DataFrame, column: str) -> tuple[DataFrame, int]:
    """First pass: the 64-bit hashes that come more than once, as a Bloom filter of 16 bits each, in
    bitmaps of 32,768 bits. Returns (slice, bits) and the number of slices, at most MOST_SLICES,
    which bounds what is broadcast.

    Hashes are counted on the map side before the shuffle, so one that a third of all rows share
    arrives as one count a task; 8 bytes a different hash shuffle, and nothing else of a row. A
    bitmap of all slots from each task instead would be as large as the filter for all rows, times
    the tasks. The filter holds repeats only, so how well it tells them from others does not
    depend on how many rows there are."""
    repeats = written(hashes.groupBy(F.col(column).alias("hash")).agg(F.count("*").alias("n")).where("n > 1").select("hash"), "repeats")
    slices = min(MOST_SLICES, max(1, -(-repeats.count() * BITS_A_HASH // SLICE_BITS)))
    slots = repeats.select(F.explode(F.array(*_slots(F.col("hash"), slices))).alias("slot"))
    bits = slots.groupBy(F.expr(f"slot div {SLICE_BITS}").alias("slice")).agg(F.bitmap_construct_agg(F.col("slot") % SLICE_BITS).alias("bits"))
    return bits, slices


def tag_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """Adds text_sha256 (of the normalised text), keep_id, group_size and kept to every row of
    ``df``. Equal normalised texts form a group; the row with the smallest id stays. ``columns`` are
    those of ``df`` that the result has (all by default; the id always).

    Each row's digest is worked out once and written with the row. A row shuffles only if its hash
    passes the filter of repeated hashes; the others are groups of one and go straight through.
    Those that shuffle are counted by digest and id on the map side. The results of large groups, of
    which there are few whatever the input, are broadcast to their rows, and only rows of smaller groups
    go through the join that hands results back, so a hot group is no task's burden. A filter too small for its input lets more rows through to the shuffle and changes no
    result.

    Defined cases: null text counts as empty; a null id is larger than any other; of rows that
    repeat id and text, one is kept (they cannot be told apart). Columns of ``df`` that bear a
    result's name are replaced; other columns, whatever their names, stay. An empty table gives an
    empty result."""
    results = ["text_sha256", "keep_id", "group_size", "kept"]
    names = [c for c in df.columns if c not in results and (columns is None or c in (*columns, id_col))]
    # the row's own columns travel as one, so that no name of theirs can meet a helper's
    rows = df.select(F.struct(*names).alias("row"), F.col(id_col).alias("id"), F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)).alias("sha"))
    rows = written(rows.select("row", "id", "sha", F.xxhash64("sha").alias("hash")), "digests")
    bits, slices = repeated_filter(rows, "hash")

    def look(frame, n, slot):
        side = F.broadcast(bits.select(F.col("slice").alias(f"slice{n}"), F.col("bits").alias(f"bits{n}")))
        byte = F.conv(F.hex(F.expr(f"substring(bits{n}, int(slot{n} % {SLICE_BITS} div 8) + 1, 1)")), 16, 10).cast("int")
        frame = frame.withColumn(f"slot{n}", slot).join(side, F.expr(f"slot{n} div {SLICE_BITS} = slice{n}"), "left")
        held = F.pmod(F.floor(byte / F.pow(F.lit(2), F.col(f"slot{n}") % 8)), F.lit(2)) == 1
        return frame.withColumn(f"held{n}", F.coalesce(held, F.lit(False))).drop(f"slice{n}", f"bits{n}", f"slot{n}")

    a, b = _slots(F.col("hash"), slices)
    tagged = look(look(rows, 1, a), 2, b).withColumn("maybe", F.col("held1") & F.col("held2")).drop("held1", "held2", "hash")
    out = ["row", "sha", "keep_id", "group_size", "kept"]
    alone = tagged.where("not maybe").withColumns({"keep_id": F.col("id"), "group_size": F.lit(1).cast("long"), "kept": F.lit(True)}).select(*out)

    some = tagged.where("maybe").drop("maybe")
    ids = some.groupBy("sha", "id").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "n"))
    groups = ids.groupBy("sha").agg(first.alias("f"), F.sum("n").alias("group_size"))
    groups = written(groups.select("sha", F.col("f.id").alias("keep_id"), F.col("f.n").alias("firsts"), "group_size").where("group_size > 1"), "groups")
    joined = counted_join(some, groups, ["sha"], "left", "group_size", LARGE)
    joined = joined.withColumns({
        "kept": F.when(F.col("group_size").isNull(), F.lit(True)).otherwise(F.col("keep_id").eqNullSafe(F.col("id"))),
        "keep_id": F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")),
        "group_size": F.coalesce("group_size", F.lit(1).cast("long")),
    })
    if not groups.where("firsts > 1").isEmpty():  # rows that repeat the smallest id: one of them
        ties = F.col("kept") & (F.coalesce("firsts", F.lit(1)) > 1)
        joined = written(joined.select(*out, "firsts").withColumn("place", F.monotonically_increasing_id()), "joined")
        one = joined.where(ties).groupBy("sha").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("only"))
        joined = joined.join(one, "place", "left").withColumn("kept", F.col("kept") & (~ties | F.coalesce("only", F.lit(False))))
    found = alone.unionByName(joined.select(*out))
    return found.select("row.*", F.lower(F.hex("sha")).alias("text_sha256"), "keep_id", "group_size", "kept")


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns from ``tag_copies`` over all documents; texts are left behind once hashed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tag_copies(docs, columns=["doc_id"]).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id) = 1 AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256)
"""
