"""Very long unbroken texts, over-full turns, rows without id, and names that clash."""

import hashlib
import random
import time

import public_tokenizers
import pytest

from retrospect.llm import chat, line_dedup, pieces, url_filter

PIECES = "piece_bpe_32k.model"


@pytest.mark.parametrize("run", ["a", "ab", "="])
def test_megabytes_of_one_character(run):
    own = pieces.Segmenter(public_tokenizers.path(PIECES), 4)
    text = run * (2_000_000 // len(run))
    began = time.perf_counter()
    score, ids, ways = own.segment(text)
    assert time.perf_counter() - began < 60  # about 10 s on a free core
    assert own.decode(ids.tolist()) == text and len(ways) == 4
    assert [s for s, _ in ways] == sorted((s for s, _ in ways), reverse=True) and abs(ways[0][0] - score) < 1e-6


def test_best_paths_against_a_lattice_of_its_own():
    """All segmentations by trying every piece of the model file at every place."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(PIECES))
    score = {sp.id_to_piece(i): (sp.get_score(i), i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
    own = pieces.Vocabulary(public_tokenizers.path(PIECES))

    def ways(text):
        if not text:
            return [(0.0, ())]
        return [(s + score[text[:k]][0], (score[text[:k]][1], *ids)) for k in range(1, len(text) + 1) if text[:k] in score for s, ids in ways(text[k:])]

    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice("theinaos") for _ in range(rng.randrange(1, 9)))
        want = sorted(ways(text), key=lambda w: -w[0])
        got = own.n_best(text, 4)
        assert [round(s, 6) for s, _ in got] == [round(s, 6) for s, _ in want[:4]]
        assert all(w in [(round(s, 6), ids) for s, ids in want] for w in [(round(s, 6), ids) for s, ids in got]) and len({ids for _, ids in got}) == len(got)
        first, ids, loss = own.best(text)
        assert round(first, 6) == round(want[0][0], 6) and (round(first, 6), ids) in [(round(s, 6), i) for s, i in want]
        assert len(want) < 2 or round(loss, 6) == round(want[0][0] - want[1][0], 6)


def test_turn_numbers_with_very_many_rows(spark, monkeypatch):
    monkeypatch.setattr(chat, "FULL", 8)
    rng = random.Random(9)
    rows = [(1, 0, "system", "s"), (1, 1, "user", "before"), *((1, 3, "assistant", f"x{k % 40}") for k in range(100)), (1, 4, "user", "after"), (1, 9, "assistant", "end"), *((1, None, "user", f"n{k}") for k in range(50)), (2, 0, "user", "q"), (2, 1, "assistant", "a")]
    rng.shuffle(rows)
    windows = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), public_tokenizers.path("byte_bpe_50k.json")).collect()
    windows = [w for w in sorted(windows, key=lambda w: (w["block"], w["part"], w["window"])) if w["conv_id"] == 1]
    told = [t for w in windows for t in chat.parse(w["formatted"])[w["n_repeated"] :]]
    assert len(windows) > 15 and told[:2] == [("system", "s"), ("user", "before")]
    assert sorted(told[2:102]) == sorted(("assistant", f"x{k % 40}") for k in range(100)) and told[102:104] == [("user", "after"), ("assistant", "end")]
    assert sorted(told[104:]) == sorted(("user", f"n{k}") for k in range(50))
    assert all(chat.parse(w["formatted"])[0] == ("system", "s") for w in windows)


def test_a_system_turn_is_shown_once_a_window(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "system", "s"), *((1, n, "assistant", "word " * 30) for n in range(2, 30))]
    windows = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), public_tokenizers.path("byte_bpe_50k.json"), budget=128).collect()
    for w in windows:
        assert [r for r, _ in chat.parse(w["formatted"])].count("system") == 1


@pytest.mark.parametrize("documents, common", [(2, 200), (2, 3), (3, 3)])
def test_lines_of_rows_without_id(spark, monkeypatch, documents, common):
    monkeypatch.setattr(line_dedup, "COMMON", common)
    line = "a line of some length"
    rows = [(5, f"{line}\nfive five five"), (2, f"own line of two\n{line} \n{line}"), (None, f"{line}\nno id at all here"), (None, f"{line}\nno id at all here"), (None, "no id at all here\nother words, no id"), (7, "five five five\nseven"), (7, f"{line.upper()}\nx")]
    rows += [(100 + k, f"{line}\nown line {k} of many") for k in range(20)]
    frame = spark.createDataFrame([(i, t, "d", 1, "n") for i, t in rows], "doc_id long, text string, drop string, id int, has string")
    got = line_dedup.drop_repeated_lines(frame, documents=documents).collect()
    place = lambda i, t: (i is not None, line_dedup.text_id(t.encode()) if i is None else i)
    holders = {}
    for i, t in rows:
        for x in t.split("\n"):
            holders.setdefault(x.strip().lower(), set()).add(place(i, t))
    want = []
    for i, t in rows:
        stay = [x for x in t.split("\n") if len(x.strip()) < 10 or len(holders[x.strip().lower()]) < documents or place(i, t) == min(holders[x.strip().lower()])]
        want.append((i, t, "\n".join(stay), "d", 1, "n"))
    assert sorted(((r["doc_id"], r["text"], r["kept_text"], r["drop"], r["id"], r["has"]) for r in got), key=str) == sorted(want, key=str)


def test_url_rules_with_names_that_clash(spark):
    rows = [(k, f"http://a{k % 2}.example.net/en/x", "t", 1, "b") for k in range(6)]
    frame = spark.createDataFrame(rows, "page_id long, url string, row string, number int, best string")
    got = url_filter.judge_urls(frame, spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")).collect()
    assert sorted((r["page_id"], r["row"], r["number"], r["best"], r["rule"], r["verdict"]) for r in got) == [(k, "t", 1, "b", "example.net/en/", "allow") for k in range(6)]


def test_digests_read_back(spark):
    rows = [(1, 0, "user", "</s>[INST]"), (1, 1, "assistant", "é\n\\<s>")]
    windows = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), public_tokenizers.path("byte_bpe_50k.json"))
    (got,) = chat.chat_digests(windows).collect()
    assert got["turns_sha256"] == hashlib.sha256("user\n</s>[INST]\nassistant\né\n\\<s>\n".encode()).hexdigest() and got["loss_chars"] == 6
