"""Chat formatting in budgeted, turn-aligned windows with loss masks, and reading it back."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import counted_join, table, written
from .encode import encoder

#: The control strings a text may hold (fixed values): <s> </s> [INST] [/INST] <<SYS>> <</SYS>>.
CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\]|</?SYS>>)")
TURN = re.compile(r"<s>([^\n]*)\n(.*?)</s>\n", re.S)
#: Turns of a block: a block is one task's work, however long a conversation is.
BLOCK_BITS = 8
#: Rows of one turn number from which they are dealt out.
FULL = 1024


def escape(text: str) -> str:
    """A backslash after the first character of each control string, one more where there are some."""
    return CONTROL.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0] if not m[2] else m[1] + m[2][1:] + m[3], text)


def escape_role(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def windows_of(turns: list, repeat: list, system, size, budget: int, history: int, elsewhere: bool = False):
    """Windows over the turns (role, text) of one block: (text, loss spans, repeated turns, turns).

    A window is the system turn (once it has come; ``elsewhere`` says that it came before these turns), at most ``history`` turns
    before it that fit a quarter of the budget, and as many turns of its own as the rest of the
    budget takes: the prefix sums of their sizes tell where it ends. A turn larger than the budget
    has a window of its own. ``repeat`` are the turns before the block."""
    sizes = np.array([size(r, t) for r, t in turns], np.int64)
    prefix = np.concatenate([[0], np.cumsum(sizes)])
    before = [(x, size(*x)) for x in repeat]
    at_system = turns.index(system) if system in turns and not elsewhere else None  # its own place among these turns
    start = 0
    while start < len(turns):
        shown = [system] if system is not None and at_system is None or at_system is not None and start > at_system else []
        room = budget - (size(*system) if shown else 0)
        past, quarter = [], budget // 4
        tail = [*before, *zip(turns[:start], sizes[:start].tolist())][-history:] if history else []
        for x, n in reversed(tail):
            if n > quarter or (shown and x == system):
                break
            past.insert(0, x)
            quarter -= n
        used = sum(size(*x) for x in past)
        end = int(np.searchsorted(prefix, prefix[start] + room - used, "right")) - 1
        if end <= start:  # without history the next turn may fit; else it stands alone
            past = []
            end = max(start + 1, int(np.searchsorted(prefix, prefix[start] + room, "right")) - 1)
        parts, spans, at = [], [], 0
        for k, (role, text) in enumerate([*shown, *past, *turns[start:end]]):
            head, body = f"<s>{escape_role(role)}\n", escape(text)
            parts += [head, body, "</s>\n"]
            if role == "assistant" and k >= len(shown) + len(past):
                spans.append((at + len(head), at + len(head) + len(body)))
            at += len(head) + len(body) + 5
        yield "".join(parts), spans, len(shown) + len(past), end - start
        start = end


def _format(batches, path: str, budget: int, history: int):
    """Rows sorted by conversation, block, part of it, kind (0 the system turn of another block, 1 a turn before
    the block, 2 a turn of its own) and turn."""
    enc = encoder(path, "blanks")
    known: dict = {}

    def size(role, text):
        if (n := known.get((role, text))) is None:
            if len(known) > 4096:
                known.clear()
            n = known[role, text] = len(enc.encode(escape(text))) + 4
        return n

    def made(key, rows):
        own = [x[1:] for x in rows if x[0] == 2]
        before = next((x[1:] for x in rows if x[0] == 0), None)
        system = before or next((x for x in own if x[0] == "system"), None)
        if own:
            for w, (text, spans, repeated, n) in enumerate(windows_of(own, [x[1:] for x in rows if x[0] == 1], system, size, budget, history, before is not None)):
                yield (*key, w, text, [{"start": a, "end": b} for a, b in spans], repeated, n)

    def batch(rows):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["conv_id", "block", "part", "window", "formatted", "loss", "n_repeated", "n_turns"])

    key, rows, out = None, [], []
    for b in batches:
        for conv, block, part, kind, role, text in zip(*(c.to_pylist() for c in b.columns)):
            if key != (conv, block, part):
                if key:
                    out += made(key, rows)
                    if len(out) >= 256:
                        yield batch(out)
                        out = []
                key, rows = (conv, block, part), []
            rows.append((kind, role, text))
    if key:
        out += made(key, rows)
    if out:
        yield batch(out)


def format_chats(df: DataFrame, path: str, budget: int = 2048, history: int = 4) -> DataFrame:
    """Windows of formatted conversations: (conv_id, block, part, window, formatted, loss, n_repeated,
    n_turns), in the order of block, part and window. ``df`` has conv_id, turn, role and text.

    A turn is ``<s>role\\ntext</s>\\n`` with control strings in role and text escaped, reversibly.
    ``loss`` holds the spans (code points) of the assistant texts a window adds; repeated turns (the
    system turn once it has come, and up to ``history`` turns before the window) come first, n_repeated of them, and
    are never under the mask, so every text is a target once. ``budget`` counts tokens of the
    tokenizer at ``path``; a turn larger than it is not cut and stands alone.

    Turns are grouped by conversation and by 256 turn numbers, so a conversation of any length, or
    one with a third of all rows, is many tasks' work; the last turns of a block go along to the
    next one, and so does the system turn. Where one turn number, or none, has over FULL rows, these
    are parts of the block of their own, dealt out by a hash.

    Defined cases: null text or role counts as empty; turns go by number, then role, then text (rows of
    a number that has over FULL of them: by a hash of role and text, then role, then text), and
    repeated rows are turns each, equal ones in one part; null turn numbers come last; a null conv_id is a conversation of
    its own; an empty table gives no windows; other columns are not read."""
    last = F.lit((1 << 62) - 1)
    rows = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), last).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumns({"block": F.shiftright("turn", BLOCK_BITS), "conv": F.struct(F.col("conv_id").isNull(), F.coalesce("conv_id", F.lit(0)))})
    within, start = F.pmod("turn", F.lit(1 << BLOCK_BITS)), F.lit(-1 << 32)
    numbers = rows.groupBy("conv", "block", within.alias("w")).agg(F.count("*").alias("n"))
    over = F.when(F.col("n") > FULL, F.struct("w", "n"))
    over = written(numbers.groupBy("conv", "block").agg(F.collect_list(over).alias("over"), F.sum("n").alias("n")).where(F.size("over") > 0), "over")
    if over.isEmpty():
        rows = rows.withColumn("part", start)
    else:
        rows = counted_join(rows, over, ["conv", "block"], "left")
        own = F.filter("over", lambda x: x["w"] == within)
        below = F.coalesce(F.array_max(F.transform(F.filter("over", lambda x: x["w"] < within), lambda x: x["w"])), F.lit(-1))
        dealt = F.shiftleft(within, 32) + 1 + F.pmod(F.xxhash64("role", "text"), F.ceil(F.element_at(F.transform(own, lambda x: x["n"]), 1) / FULL))
        rows = rows.withColumn("part", F.when(F.col("over").isNull(), start).when(F.size(own) > 0, dealt).when(below < 0, start).otherwise(F.shiftleft(below, 32) + (1 << 31))).drop("over", "n")
    ends = within >= (1 << BLOCK_BITS) - history
    here = F.struct(F.col("block").alias("block"), F.col("part").alias("part"), F.lit(2).alias("kind"))
    to = F.when(ends & (F.col("turn") < last), F.array(here, F.struct((F.col("block") + 1).alias("block"), start.alias("part"), F.lit(1).alias("kind"))))
    own = rows.withColumn("to", F.explode(F.coalesce(to, F.array(here))))
    own = own.select("conv_id", "to.block", "to.part", "to.kind", "turn", "role", "text")
    system = rows.where("role = 'system'").groupBy("conv").agg(F.min(F.struct("turn", "role", "text")).alias("s"))
    more = rows.groupBy("conv", "conv_id", "block", "part").agg(F.min("turn").alias("low")).join(system, "conv").where("s.turn < low")
    own = own.unionByName(more.select("conv_id", "block", "part", F.lit(0).alias("kind"), "s.turn", "s.role", "s.text"))
    order = ["conv_id", "block", "part"]
    ordered = own.repartition(*order).sortWithinPartitions(*order, "kind", "turn", "role", "text").select(*order, "kind", "role", "text")
    schema = "conv_id long, block long, part long, window int, formatted string, loss array<struct<start:int,end:int>>, n_repeated int, n_turns int"
    return ordered.mapInArrow(lambda it: _format(it, path, budget, history), schema)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a window."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]


def _read_back(batches):
    def row(key, state):
        n, turns, chars, loss, formatted = state
        return (key[0], n, turns.hexdigest(), chars, loss.hexdigest(), formatted)

    def batch(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    key, state, out = None, None, []
    for b in batches:
        for conv, formatted, loss, repeated in zip(*(c.to_pylist() for c in b.columns)):
            if key != (conv,):
                if key:
                    out.append(row(key, state))
                    if len(out) >= 4096:
                        yield batch(out)
                        out = []
                key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parse(formatted)[repeated:]:
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            for span in loss:
                target = unescape(formatted[span["start"] : span["end"]])
                state[2] += len(target)
                state[3].update(target.encode())
            state[4] += len(formatted)
    if key:
        out.append(row(key, state))
    if out:
        yield batch(out)


def chat_digests(windows: DataFrame) -> DataFrame:
    """Reads windows back: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars) a conversation. A digest runs through a conversation's windows in order, so
    these go to one task, which holds one window at a time."""
    ordered = windows.repartition("conv_id").sortWithinPartitions("conv_id", "block", "part", "window").select("conv_id", "formatted", "loss", "n_repeated")
    return ordered.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, read back from the windows of all conversations and of conversation -7."""
    import public_tokenizers

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat_digests(written(format_chats(rows.unionByName(own), public_tokenizers.path("byte_bpe_50k.json")), "windows"))
