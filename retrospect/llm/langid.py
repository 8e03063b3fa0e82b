"""Language identification with bit-sliced Bloom filters of byte n-grams."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import schema_plus, table

UNKNOWN = "und"
WIDTHS = (3, 4)
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _fold_table() -> np.ndarray:
    """Bytes as they count: ASCII letters in lower case, bytes of longer characters as they are,
    everything else a blank."""
    fold = np.full(256, 0x20, np.uint8)
    fold[0x80:] = np.arange(0x80, 0x100)
    fold[0x61:0x7B] = fold[0x41:0x5B] = np.arange(0x61, 0x7B)
    return fold


FOLD = _fold_table()


def folded(raw: np.ndarray) -> np.ndarray:
    """UTF-8 bytes folded: also U+00C0 to U+00DE in lower case. Other scripts keep their case."""
    out = FOLD[raw]
    capital = np.flatnonzero((out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97) & (out[:-1] == 0xC3)) + 1
    out[capital] += 0x20
    return out


def blanks(width: int) -> np.uint64:
    """The n-gram of blanks alone."""
    return np.uint64(int.from_bytes(b" " * width, "big") | width << 56)


def grams(raw: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of ``width`` bytes within each text, as integers that also hold the width, and
    how many each text has. Texts lie one after the other in ``raw`` with a blank before each and one at the end.
    Where one would reach into the next text there is one of blanks alone, which is no evidence."""
    if len(raw) < width:
        return np.empty(0, np.uint64), np.zeros(len(starts), np.int64)
    value = np.zeros(len(raw) - width + 1, np.uint64)
    for k in range(width):
        value = (value << np.uint64(8)) | raw[k : len(raw) - width + 1 + k]
    value |= np.uint64(width << 56)
    ends = np.append(starts[1:], len(raw) - 1)
    for k in range(1, width - 1):
        over = ends - k
        value[over[(over >= 0) & (over < len(value))]] = blanks(width)
    return value, np.diff(np.append(starts, len(value)).clip(max=len(value)))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts in one array, a blank before each and one at the end, and where each begins."""
    raw = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    return raw, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]]).astype(np.int64)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def _counts(batches):
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            own = [(t or "").encode() for t, x in zip(texts, langs) if x == lang]
            for k in range(0, len(own), 512):
                raw, starts = joined(own[k : k + 512])
                raw = folded(raw)
                for width in WIDTHS:
                    value = grams(raw, starts, width)[0]
                    value, n = np.unique(value[value != blanks(width)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(value), pa.string()), pa.array(value.view(np.int64)), pa.array(n, pa.int64())], ["lang", "gram", "n"])


@dataclass(frozen=True)
class Model:
    """Slot s of ``masks`` has bit l set if some n-gram of language l is hashed there."""

    langs: tuple
    masks: np.ndarray
    hashes: int
    default: str

    def languages(self, value: np.ndarray) -> np.ndarray:
        """The bitmask of languages that (may) contain each n-gram: one look-up a hash answers for
        all languages."""
        shift, found = np.uint64(64 - int(len(self.masks)).bit_length() + 1), None
        for m in MULTIPLIERS[: self.hashes]:
            own = self.masks[(value * np.uint64(m)) >> shift]
            found = own if found is None else found & own
        return found

    def false_positive(self) -> np.ndarray:
        """Per language the chance that an n-gram it lacks passes all hashes."""
        fill = np.array([np.count_nonzero(self.masks >> np.uint64(k) & np.uint64(1)) / len(self.masks) for k in range(len(self.langs))])
        return fill**self.hashes

    def judge(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """(language, score, evidence) of each whole text: the language's share of what all have, and
        the share of the text's n-grams that the language has, both less false positives. N-grams of
        blanks alone, which stand for digits and the like, are no evidence."""
        raw, starts = joined([t.encode() for t in texts])
        raw = folded(raw)
        hit, total = np.zeros((len(self.langs), len(texts))), np.zeros(len(texts))
        for width in WIDTHS:
            value, n = grams(raw, starts, width)
            if not len(value):
                continue
            blank = np.concatenate([[0], np.cumsum(value == blanks(width))])
            found, ends = self.languages(value), np.concatenate([[0], np.cumsum(n)])
            found[np.diff(blank).astype(bool)] = 0
            n = n - (blank[ends[1:]] - blank[ends[:-1]])
            for k in range(len(self.langs)):
                bits = np.concatenate([[0], np.cumsum(found >> np.uint64(k) & np.uint64(1), dtype=np.int64)])
                hit[k] += bits[ends[1:]] - bits[ends[:-1]]
            total += n
        wrong = self.false_positive()[:, None]
        sure = ((hit - total * wrong) / np.maximum(1 - wrong, 1e-9)).clip(min=0)
        best, sums = sure.argmax(axis=0), sure.sum(axis=0)
        score = np.where(sums > 0, sure.max(axis=0, initial=0) / np.where(sums > 0, sums, 1), 0.0)
        share = sure.max(axis=0, initial=0) / np.maximum(total, 1)
        langs = [(self.langs[b] if s > 0 else self.default) if has_letter(t) else UNKNOWN for b, s, t in zip(best, sums, texts)]
        return langs, *([float(s) if x != UNKNOWN else 0.0 for s, x in zip(y, langs)] for y in (score, share))


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", sample: int = 8_000, ratio: float = 0.5, hashes: int = 3) -> Model:
    """Fits the filters on a bounded sample of the labelled rows of ``df``: about ``sample`` different
    texts a language, chosen by a hash of the text, whole texts; a text that repeats is taken once,
    however often it does. All n-grams of the sample count. One enters the filter of each language in which it is at least ``ratio`` times as
    frequent as where it is most frequent. A slot holds up to 64 languages; more are refused. There
    are at least 8 slots for each n-gram of the largest language.

    Defined cases: rows with a null language teach nothing, null texts count as empty; of languages
    that are equally frequent the last in order is the default; no labelled rows give a model that
    knows no language."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    known = df.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"), F.xxhash64(text).alias("key"))
    sizes = {r["lang"]: r for r in known.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("key").alias("texts")).limit(65).collect()}
    if len(sizes) > 64:
        raise ValueError("a filter slot holds at most 64 languages")
    if not sizes:
        return Model((), np.zeros(2, np.uint64), hashes, UNKNOWN)
    share = F.create_map(*[x for k, r in sizes.items() for x in (F.lit(k), F.lit(min(1.0, sample / max(r["texts"], 1))))])
    drawn = known.where(F.pmod("key", F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * (1 << 20))
    drawn = drawn.groupBy("lang", "key").agg(F.first("text").alias("text")).select("lang", "text")
    counts = drawn.mapInArrow(_counts, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rate = counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    kept = rate.withColumn("top", F.max("p").over(Window.partitionBy("gram"))).where(F.col("p") >= ratio * F.col("top"))
    rows = kept.select("lang", "gram").toArrow()

    langs = tuple(sorted(sizes))
    value = rows.column("gram").to_numpy().view(np.uint64)
    at = np.array([langs.index(x) for x in rows.column("lang").to_pylist()], np.uint64)
    slots = 1 << max(10, int(8 * np.bincount(at.astype(np.int64), minlength=1).max() - 1).bit_length())
    masks = np.zeros(slots, np.uint64)
    for m in MULTIPLIERS[:hashes]:
        np.bitwise_or.at(masks, (value * np.uint64(m)) >> np.uint64(64 - slots.bit_length() + 1), np.uint64(1) << at)
    return Model(langs, masks, hashes, max(sizes, key=lambda k: (sizes[k]["n"], k)))


def _judge(batches, text_at: int, model):
    for batch in (x.slice(k, 1024) for x in batches for k in range(0, x.num_rows, 1024)):
        texts = batch.column(text_at).to_pylist()
        start = size = 0
        for k in range(len(texts) + 1):
            if k == len(texts) or (size and size + len(texts[k] or "") > 1 << 18):
                langs, scores, shares = model.value.judge([t or "" for t in texts[start:k]])
                part = batch.slice(start, k - start)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(shares, pa.float64())], [*part.schema.names, "lang_pred", "score", "evidence"])
                start, size = k, 0
            if k < len(texts):
                size += len(texts[k] or "")


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score (0 to 1: the language's share of what all languages have of the text) and
    evidence (0 to 1: the share of the text's n-grams that the language has) to each row.

    All n-grams of the whole text are looked up; per language the hits are counted and corrected by
    the filter's false-positive rate; the largest count decides, the first in order on a tie.

    Defined cases: null, or no letter: ``und``, score 0; letters but no evidence: the language most
    frequent in training, score 0; a model of no labelled rows says ``und`` to all. Columns of
    ``df`` that bear a result's name are replaced, others stay."""
    df = df.drop("lang_pred", "score", "evidence")
    if not model.langs:
        return df.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0), "evidence": F.lit(0.0)})
    sent, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text_col)
    return df.mapInArrow(lambda it: _judge(it, at, sent), schema_plus(df, "lang_pred string, score double, evidence double"))


def held_out(id_col):
    """The quarter of the documents that teaches nothing."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and evidence, over all documents; taught by those not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = train(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "evidence")
