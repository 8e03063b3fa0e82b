"""Line deduplication: hash the lines, count documents a line, drop repeats, put the rest together."""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, counted_join, schema_plus, table, written

_SPACE = SPACE.encode()
#: Rows of a line from which its verdict may be broadcast (see ``counted_join``).
COMMON = 200


def line_key(line: bytes) -> bytes:
    """White space stripped at both ends, A-Z lower-cased."""
    return line.strip(_SPACE).lower()


def text_id(text: bytes) -> int:
    """What stands for the id of a row that has none."""
    return int.from_bytes(xxhash.xxh64_digest(text, 42), "big", signed=True)


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def _hashes(batches, least: int):
    """(has, id, two halves of the 128-bit hash) for each different key of a row. A row without id is
    known by its text: has is 0 and id a hash of it."""
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            text = text.as_py() or b""
            has, own = (1, i) if i is not None else (0, text_id(text))
            for key in {line_key(x) for x in text.split(b"\n")}:
                if _long_enough(key, least):
                    h = xxhash.xxh3_128_intdigest(key)
                    for column, x in zip(out, (has, own, (h >> 64) - (1 << 63), (h & 0xFFFFFFFFFFFFFFFF) - (1 << 63))):
                        column.append(x)
            if len(out[0]) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["has", "id", "h1", "h2"])
                out = [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], ["has", "id", "h1", "h2"])


def _cut(batches, text_at: int, drop_at: int, least: int):
    """Each batch without its drop column and with kept_text, n_lines, n_dropped."""
    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            kept, lines, dropped = [], [], []
            for text, drop in zip(part.column(text_at).cast(pa.binary()), part.column(drop_at)):
                text, drop = text.as_py() or b"", drop.as_py()
                own = text.split(b"\n")
                stay = own
                if drop:
                    gone = {(x["h1"], x["h2"]) for x in drop}
                    stay = []
                    for x in own:
                        key = line_key(x)
                        if _long_enough(key, least):
                            h = xxhash.xxh3_128_intdigest(key)
                            if ((h >> 64) - (1 << 63), (h & 0xFFFFFFFFFFFFFFFF) - (1 << 63)) in gone:
                                continue
                        stay.append(x)
                kept.append(b"\n".join(stay))
                lines.append(len(own))
                dropped.append(len(own) - len(stay))
            rest = [c for k, c in enumerate(part.columns) if k != drop_at]
            names = [n for k, n in enumerate(part.schema.names) if k != drop_at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(kept, pa.binary()).cast(pa.string()), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*names, "kept_text", "n_lines", "n_dropped"])


def drop_repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 10, documents: int = 2) -> DataFrame:
    """Adds kept_text, n_lines (before) and n_dropped to each row of ``df``.

    Texts are split at ``\\n``. A line's key is the line stripped of white space at both ends with
    A-Z in lower case. Keys of at least ``least`` code points that at least ``documents`` documents hold
    lose all their lines but for those in the document with the smallest id. Other lines stay, in
    their order.

    Lines are hashed once, to 128 bits, and written; they travel as hashes, once a document. The count of documents a key is combined on the
    map side (for two documents the smallest and the largest id tell), so a line that a third of the
    documents hold arrives as a row a task. Verdicts on lines of very many documents,
    of which there are few whatever the input, are broadcast to the lines; the others are joined. What a document has to drop
    is gathered by document and is at most its own lines.

    Defined cases: a null or empty text is one empty line; a null id comes before all others, and rows
    without id are one document if their texts are equal, else each its own, in the order of a
    hash; rows that share an id are one document, and each of them loses the same lines; an empty
    table gives an empty result; columns of ``df`` that bear a result's name are replaced, others,
    whatever their names, stay."""
    names = [c for c in df.columns if c not in ("kept_text", "n_lines", "n_dropped")]
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    lines = written(docs.mapInArrow(lambda it: _hashes(it, least), "has int, id long, h1 long, h2 long"), "lines")
    place = F.struct("has", "id")
    if documents == 2:
        held = lines.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).where("first < last")
    else:
        held = lines.distinct().groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where(F.col("n") >= documents)
    repeated = written(held.select("h1", "h2", "first", "n"), "repeated")
    gone = counted_join(lines, repeated, ["h1", "h2"], "inner", "n", COMMON)
    drops = gone.where(place > F.col("first")).groupBy("has", "id").agg(F.collect_set(F.struct("h1", "h2")).alias("drop"))
    # the row's own columns travel as one, so that no name of theirs can meet a helper's
    text_key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))  # as text_id
    both = df.select(F.struct(*names).alias("row"), F.col(text_col).alias("text"), F.col(id_col).isNotNull().cast("int").alias("has"), F.coalesce(F.col(id_col).cast("long"), text_key).alias("id"))
    both = both.join(drops, ["has", "id"], "left").select("row", "text", "drop")
    cut = both.mapInArrow(lambda it: _cut(it, 1, 2, least), schema_plus(both.drop("drop"), "kept_text string, n_lines long, n_dropped long"))
    return cut.select("row.*", "kept_text", "n_lines", "n_dropped")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns from ``drop_repeated_lines`` over all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) <> max(doc_id)),
d AS (SELECT k.*, g.first IS NOT NULL AND doc_id <> g.first AS gone FROM k LEFT JOIN g USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d GROUP BY doc_id
"""
