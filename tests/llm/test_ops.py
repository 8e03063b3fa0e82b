"""The corpus operators on small tables with nulls, empty and long texts, ties and repeats, against
plain versions of the same rules."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from retrospect.llm import bitslice, chat, dac, embedding_dedup, exact_dedup, langid, line_dedup, packing, pieces, simhash, url_filter
from retrospect.llm.encode import CachedEncoder

RUN = re.compile(r"[\x20\x09-\x0D]+")
LONG = " ".join(f"word{n % 977}" for n in range(30_000))
TEXTS = [
    None, "", " ", "\t\n\x0b", "plain text here now", "plain  text\there now", "Plain text here now", "plain text here now", LONG, LONG + " end", "one", "two words",
    "ONE", "a line of some length\nshort\na line of some length\n", "  A Line of some LENGTH \nother line of length\n\n", "other line of length", "été à la plage\ndeuxième ligne ici", "Été à LA plage", "日本語のテキスト", "\u2003x\u00a0y",
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, ids string, print string, node int"


@pytest.fixture(scope="module")
def docs(spark):
    """Texts with extra columns whose names clash with those the operators use; rows that repeat."""
    rows = [(n * 3 % 41, t, "fr" if t and "é" in t else None if n % 5 == 0 else "en", "s", 1, None, "x", "y", 7) for n, t in enumerate(TEXTS)]
    rows += [(None, "plain text here now", "en", "s", 1, None, "x", "y", 7), (50, "one", "en", "s", 1, None, "x", "y", 7), (50, "one", "en", "s", 1, None, "x", "y", 7)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def components(n, linked):
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            low = min([label[i], *(label[j] for j in linked[i])])
            changed |= low != label[i]
            label[i] = low
    return label


# -- op5 -----------------------------------------------------------------------------------------


def test_exact_dedup(docs, empty):
    rows = exact_dedup.tag_copies(docs).collect()
    assert len(rows) == docs.count()
    groups = {}
    for r in rows:
        groups.setdefault(RUN.sub(" ", r["text"] or ""), []).append(r)
    for text, own in groups.items():
        ids = [r["doc_id"] for r in own if r["doc_id"] is not None]
        assert {r["keep_id"] for r in own} == {min(ids) if ids else None}
        assert {r["group_size"] for r in own} == {len(own)}
        assert sum(r["kept"] for r in own) == 1 and next(r for r in own if r["kept"])["doc_id"] == (min(ids) if ids else None)
        assert {r["text_sha256"] for r in own} == {hashlib.sha256(text.encode()).hexdigest()}
    assert rows[0]["source"] == "s"
    assert exact_dedup.tag_copies(empty).collect() == []


def test_exact_dedup_with_a_filter_too_small(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MOST_SLICES", 1)
    monkeypatch.setattr(exact_dedup, "SLICE_BITS", 64)
    docs = spark.createDataFrame([(n, f"t{n % 900}") for n in range(1000)], "doc_id bigint, text string")
    got = exact_dedup.tag_copies(docs).collect()
    assert sum(r["kept"] for r in got) == 900 and len(got) == 1000


def test_exact_dedup_of_large_groups_and_names_that_clash(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "LARGE", 20)
    rows = [(n if n % 50 else None, ("hot" if n % 3 else f"t{n // 9}"), "r", "m", 1, "s") for n in range(400)] + [(1, "hot", "r", "m", 1, "s")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, maybe string, slot1 int, sha string")
    got = exact_dedup.tag_copies(docs).collect()
    assert len(got) == len(rows) and all((r["row"], r["maybe"], r["slot1"], r["sha"]) == ("r", "m", 1, "s") for r in got)
    for text in {r[1] for r in rows}:
        own = [r for r in got if r["text"] == text]
        ids = [r[0] for r in rows if r[1] == text and r[0] is not None]
        assert {(r["keep_id"], r["group_size"]) for r in own} == {(min(ids), len(own))} and [r["doc_id"] for r in own if r["kept"]] == [min(ids)]
    narrow = exact_dedup.tag_copies(docs, columns=["sha"])
    assert sorted(narrow.columns) == ["doc_id", "group_size", "keep_id", "kept", "sha", "text_sha256"] and narrow.count() == len(rows)


# -- op6 -----------------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = [None, "", "no scheme", "http://", "http://NET/", "https://a.net/x?y", "http://a.net", "http://example.net/en/1#t", "http://m.example.net/en", "http://x.example.com/de/?q", "http://xexample.com/de/", "http://w.org/fr/a", "http://w.org/fr", "http://org/fr/#", "http://a.net:80/", "x://y://z.net/", "http://u@a.net/\nq", "http://a.net/" + "p" * 5000]
    rows = spark.createDataFrame([(n, u, "kept") for n, u in enumerate(urls)] + [(None, urls[4], None)], "page_id bigint, url string, rule string")
    rules = spark.createDataFrame([*url_filter.RULES, (None, "/", "block"), ("", "/", "block"), ("net", "/", "block")], "host string, path string, verdict string")

    def plain(url):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        return host, path, best and best[3], best[4] if best else "allow"

    got = url_filter.judge_urls(rows, rules).collect()
    assert len(got) == len(urls) + 1
    assert all(tuple(r[2:] if len(r) == 6 else r[-4:]) == plain(r["url"]) for r in got)
    none = url_filter.judge_urls(rows, rules.where("false")).collect()
    assert {r["verdict"] for r in none} == {"allow"}
    assert url_filter.judge_urls(rows.where("false"), rules).collect() == []


def test_url_rules_shuffled(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", 0)
    rows = spark.createDataFrame([(1, "http://a.net/x")], "page_id bigint, url string")
    assert url_filter.judge_urls(rows, spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")).first()["rule"] == "net/"


# -- op7 -----------------------------------------------------------------------------------------


def slow_print(text, width=4):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text or "")) if w]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + width]), 42) for k in range(max(1, len(words) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, empty):
    rows = simhash.simhash_components(docs).collect()
    texts = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    assert len(rows) == sum(texts.values())
    everything = sorted(texts.elements(), key=str)
    prints = [slow_print(t) for _, t in everything]
    linked = [[j for j in range(len(prints)) if (prints[i] ^ prints[j]).bit_count() <= 4] for i in range(len(prints))]
    label = components(len(prints), linked)
    least = {c: min((everything[i][0] for i in range(len(label)) if label[i] == c and everything[i][0] is not None), default=None) for c in set(label)}
    want = Counter((everything[i][0], simhash._signed(prints[i]), least[label[i]]) for i in range(len(label)))
    assert Counter(map(tuple, rows)) == want
    assert simhash.simhash_components(empty).collect() == []


@pytest.mark.parametrize("radius", [0, 3, 4, 7])
def test_bit_sliced_comparison(radius):
    rng = np.random.default_rng(radius)
    seeds = rng.integers(0, 2**63, 12, dtype=np.uint64)
    prints = np.unique(np.concatenate([seeds, *[seeds ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 64, (25, 2))]]))
    rng.shuffle(prints)
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= radius
    i, j = bitslice.shifted_pairs(prints, np.full(len(prints), len(prints) - 1), radius)
    assert set(zip(i.tolist(), j.tolist())) == {(a, b) for a, b in zip(*np.nonzero(np.triu(near, 1)))}
    a, b = bitslice.spanning_links(prints, radius)
    assert len(a) < len(prints) and near[a, b].all()
    assert (bitslice.least_reached(len(prints), a, b) == components(len(prints), [np.flatnonzero(n).tolist() for n in near])).all()


def test_hot_buckets_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 40)
    rng = np.random.default_rng(5)
    prints = np.unique(np.concatenate([np.uint64(0xABCDEF) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)), rng.integers(0, 2**63, 50, dtype=np.uint64)]))
    links = simhash.link_prints(spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "print bigint")).collect()
    at = {int(x): k for k, x in enumerate(prints.view(np.int64))}
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 4
    i, j = np.array([at[r["a"]] for r in links]), np.array([at[r["b"]] for r in links])
    assert near[i, j].all()
    assert (bitslice.least_reached(len(prints), i, j) == components(len(prints), [np.flatnonzero(n).tolist() for n in near])).all()


def test_five_word_shingles_link_near_copies(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(5000)}" for _ in range(1500)]
    near = base[:]
    near[700] = "changed"
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(rng.sample(base, 1500)))], "doc_id bigint, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(docs, width=5).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


# -- op8 -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("tile", [512, 16])
def test_embeddings(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    rng = np.random.default_rng(3)
    near = rng.standard_normal(8)
    rows = [(n, (near + 0.05 * rng.standard_normal(8)).tolist()) for n in range(60)]
    rows += [(100 + n, rng.standard_normal(8).tolist()) for n in range(60)]
    rows += [(200, rows[70][1]), (201, rows[70][1]), (202, [2 * x for x in rows[70][1]]), (203, None), (204, [0.0] * 8), (205, [1.0, None]), (206, [float("nan")] * 8), (207, [float("inf")] * 8), (208, []), (209, [0.0] * 8), (210, near.tolist()[:7])]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<double>, label int, node string")
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_links(df).collect()}
    assert len(got) == len(rows)
    ok = [(i, np.array(v)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    link = [[b for b, (_, w) in enumerate(ok) if a != b and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.95] for a, (_, v) in enumerate(ok)]
    label = components(len(ok), link)
    found = sum(got[i]["n_links"] for i, _ in ok)
    assert found >= 0.99 * sum(map(len, link)) and all(got[i]["n_links"] <= len(x) for (i, _), x in zip(ok, link))
    low = {c: min(ok[k][0] for k in range(len(ok)) if label[k] == c) for c in set(label)}
    assert all(got[i]["component_id"] == low[label[k]] for k, (i, _) in enumerate(ok))
    for i in set(got) - {i for i, _ in ok}:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert embedding_dedup.embedding_links(df.where("false")).collect() == []


# -- op9 -----------------------------------------------------------------------------------------


def test_line_dedup(docs, empty):
    rows = docs.collect()
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    place = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)
    holders = {}
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            holders.setdefault(key(line), set()).add(place(r))
    want = Counter()
    for r in rows:
        own = (r["text"] or "").split("\n")
        stay = [x for x in own if not (len(key(x)) >= 10 and len(holders[key(x)]) > 1 and place(r) != min(holders[key(x)]))]
        want[(r["doc_id"], r["text"], "\n".join(stay), len(own), len(own) - len(stay))] += 1
    got = line_dedup.drop_repeated_lines(docs)
    assert Counter((r["doc_id"], r["text"], r["kept_text"], r["n_lines"], r["n_dropped"]) for r in got.collect()) == want
    assert "source" in got.columns and line_dedup.drop_repeated_lines(empty).collect() == []


# -- op1, op3 ------------------------------------------------------------------------------------


@pytest.mark.parametrize("name, mode", [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "blanks")])
def test_encoder_equals_library(name, mode):
    rng = random.Random(7)
    letters = list(" \n\t  \x0b\x0c\r\x1c\x85\xa0 aAéÉÑ'sS'tdçß.,!?0129²½_-<|>ΣσİIıfíe\u030a中文한ก\U0001f600\0")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(1500)] + ["<|endoftext|> a<|startoftext|>", LONG, ""]
    own = CachedEncoder(public_tokenizers.path(name), mode)
    want = [e.ids for e in own.lib.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in own.encode_many(texts)] == want


def test_packing(spark, docs, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = CachedEncoder(path, "words").lib
    placed = packing.pack_documents(docs.select("doc_id", "text", "source"), path, with_ids=True)
    rows = placed.collect()
    whole = {}
    for r in rows:
        assert r["length"] <= 4096 and zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and r["start"] == 4096 * r["piece"]
        whole.setdefault(r["sequence_id"], []).append(r)
    for own in whole.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    want = Counter()
    for r in docs.collect():
        ids = np.array([*lib.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 4096):
            want[(r["doc_id"], k // 4096, ids[k : k + 4096].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], bytes(r["ids"])) for r in rows) == want
    sequences = packing.packed_sequences(placed).collect()
    assert len(sequences) == len(whole) and all(len(s["ids"]) == 4 * s["n_tokens"] for s in sequences)
    assert packing.pack_documents(empty.select("doc_id", "text"), path).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_local_search_keeps_all_and_never_adds_bins(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choice([rng.randrange(1, 101), 37, 64]) for _ in range(rng.choice([5, 60, 3000])))
    first = packing.best_fit(dict(counts), 100)
    better = packing.improve(first, 100)
    for bins in (first, better):
        held = Counter()
        for b, n in bins.items():
            assert sum(b) <= 100
            for x in b:
                held[x] += n
        assert held == counts
    assert -(-sum(n * c for n, c in counts.items()) // 100) <= sum(better.values()) <= sum(first.values())


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=25), st.sampled_from([60, 61, 100, 128]))
@settings(max_examples=80, deadline=None)
def test_no_step_is_left_after_the_search(counts, capacity):
    once = packing.improve(packing.best_fit(counts, capacity), capacity)
    assert sum(packing.improve(once, capacity).values()) == sum(once.values())
    tokens = sum(n * c for n, c in counts.items())
    if sum(once.values()) > -(-tokens // capacity):
        for low in once:
            for high in once:
                if sum(low) <= sum(high) < capacity and (low != high or once[low] > 1):
                    assert packing._exchange(low, high, capacity - sum(high)) is None


def test_few_bins_reach_the_optimum():
    """Small cases against the least number of bins, by trying all ways."""
    rng = random.Random(4)
    for _ in range(60):
        sizes = [rng.randrange(1, 11) for _ in range(rng.randrange(1, 8))]

        def least(k, bins):
            if k == len(sizes):
                return len(bins)
            ways = [least(k + 1, bins[:i] + [b + sizes[k]] + bins[i + 1 :]) for i, b in enumerate(bins) if b + sizes[k] <= 10]
            return min([*ways, least(k + 1, [*bins, sizes[k]])])

        got = sum(packing.improve(packing.best_fit(Counter(sizes), 10), 10).values())
        assert least(0, []) <= got <= least(0, []) + 1


def test_local_search_empties_bins():
    # best fit leaves 60+30 twice and 50; exchanging frees the room
    bins = packing.improve(Counter({(40, 45): 1, (30, 60): 1, (10, 15): 1}), 100)
    assert sum(bins.values()) == 2
    assert sum(packing.improve(Counter({(50, 49): 1, (51, 48): 1, (1, 1): 1}), 100).values()) == 2


@pytest.mark.parametrize("n, top", [(0, 1), (1, 300), (511, 255), (5000, 70000), (4096, 1 << 31)])
def test_addressable_codes(n, top):
    rng = np.random.default_rng(n)
    ids = (rng.random(n) ** 4 * top).astype(np.uint32)
    codes = dac.Segment(dac.encode_levels(ids))
    assert (codes.read(0, n) == ids).all()
    for k in rng.integers(0, n, 50) if n else []:
        assert codes[int(k)] == ids[k]
        end = min(n, int(k) + 700)
        assert (codes.read(int(k), end) == ids[k:end]).all()
    with pytest.raises(IndexError):
        codes[n]


def test_token_id_files(spark, docs, empty, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = CachedEncoder(path, "blanks").lib
    dac.write_token_ids(docs, f"{tmp_path}/ids", path, segment=64)
    start, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text"] is not None, r["text"] or "")):
        ids = np.array([*lib.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, dac.read_token_ids(spark, f"{tmp_path}/ids").collect()), key=lambda r: r[1]) == want
    dac.write_token_ids(empty, f"{tmp_path}/none", path)
    assert dac.read_token_ids(spark, f"{tmp_path}/none").collect() == []


# -- op2 -----------------------------------------------------------------------------------------


def test_language_id(spark, docs, empty):
    words = {"aa": "kalo mir tano vesh dulin".split(), "bb": "prez ghoti wumba snik yarrow".split(), "cc": "été ôvré çalme ñusté".split()}
    rng = random.Random(1)
    rows = [(n, " ".join(rng.choices(words[k], k=60)), k) for n, k in enumerate(list(words) * 40)] + [(999, "no label", None)]
    model = langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.langs == ("aa", "bb", "cc")
    tests = [(n, " ".join(rng.choices(words[k], k=15)), k) for n, k in enumerate(list(words) * 20)]
    got = langid.identify(spark.createDataFrame(tests, "doc_id bigint, text string, lang string"), model).collect()
    assert all(r["lang_pred"] == r["lang"] and 0 < r["score"] <= 1 for r in got)
    odd = {r["text"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, model).collect()}
    assert odd[None] == odd[""] == odd[" "] == (langid.UNKNOWN, 0.0) and odd["日本語のテキスト"] == (model.default, 0.0)
    assert langid.identify(empty, model).collect() == []
    assert {r["lang_pred"] for r in langid.identify(docs, langid.train(empty)).collect()} == {langid.UNKNOWN}


def test_filters_answer_for_all_languages():
    value = np.arange(1, 2000, dtype=np.uint64) * np.uint64(7919)
    masks = np.zeros(1 << 14, np.uint64)
    bit = np.uint64(1) << (value % np.uint64(3))
    for m in langid.MULTIPLIERS:
        np.bitwise_or.at(masks, (value * np.uint64(m)) >> np.uint64(50), bit)
    model = langid.Model(("a", "b", "c"), masks, 3, "a")
    assert (model.languages(value) & bit == bit).all()
    lacking = model.languages(np.arange(10**6, 10**6 + 20000, dtype=np.uint64) * np.uint64(104729))
    rate = [float(((lacking >> np.uint64(k)) & np.uint64(1)).mean()) for k in range(3)]
    assert np.allclose(rate, model.false_positive(), atol=0.01)


# -- op4 -----------------------------------------------------------------------------------------


def test_escaping_is_reversible():
    rng = random.Random(4)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<", "[", "\\", "\\\\", "/s>", "s>", "a", "\n", "]", ">"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randrange(8)))
        assert chat.unescape(chat.escape(text)) == text and "</s>" not in chat.escape(text)
        assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_chat_windows(spark):
    rng = random.Random(6)
    rows = [(1, 0, "system", "be kind"), *((1, n, ("user", "assistant")[n % 2 == 0], f"turn {n} </s>[INST]" * rng.randrange(1, 9)) for n in range(1, 700))]
    rows += [(2, 0, "user", None), (2, 1, "assistant", ""), (2, None, None, "last"), (2, 1, "assistant", ""), (3, 5, "assistant", "x" * 9000), (3, 2, "system", "s"), (None, 0, "user", "q"), (None, 1, "assistant", "a"), (4, -3, "user", "<s>"), (4, 300, "assistant", "\\<s>")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    windows = chat.format_chats(df, public_tokenizers.path("byte_bpe_50k.json"), budget=256)
    got = {r["conv_id"]: r for r in chat.chat_digests(windows).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    enc = CachedEncoder(public_tokenizers.path("byte_bpe_50k.json"), "blanks")
    long = [w for w in windows.collect() if w["conv_id"] == 1]
    assert len(long) > 20 and all(chat.parse(w["formatted"])[0] == ("system", "be kind") for w in long)
    for w in long:
        assert w["n_repeated"] <= 5 and sum(len(enc.encode(chat.escape(t))) + 4 for _, t in chat.parse(w["formatted"])) <= 256
    assert chat.chat_digests(chat.format_chats(df.where("false"), public_tokenizers.path("byte_bpe_50k.json"))).collect() == []


# -- op10 ----------------------------------------------------------------------------------------

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_n_best_equals_all_paths():
    own = pieces.Segmenter(MODEL, 4)
    rng = random.Random(3)

    def all_paths(text):
        text = pieces.BLANK + text.replace(" ", pieces.BLANK)
        ends, out = own.vocabulary.lattice(text), []

        def go(j, s):
            if not j:
                out.append(s)
            for i, score, _ in ends[j] if j else ():
                go(i, s + score)

        go(len(text), 0.0)
        return sorted(out, reverse=True)[:4]

    for _ in range(250):
        text = "".join(rng.choice("the anoé日. \n☃a") for _ in range(rng.randrange(1, 9)))
        _, ids, ways = own.segment(text)
        assert [s for s, _ in ways] == pytest.approx(all_paths(text))
        seen = set()
        for score, changes in ways:
            new = ids.tolist()
            for at, n, put in sorted(changes, reverse=True):
                new[at : at + n] = put
            seen.add(tuple(new))
            assert own.decode(new) == text
        assert len(seen) == len(ways)


def test_segment_and_decode(docs, empty):
    out = pieces.decode(pieces.segment(docs, MODEL), MODEL)
    rows = out.collect()
    assert len(rows) == docs.count() and all(r["decoded"] == (r["text"] or "") for r in rows)
    assert all(len(r["ids"]) == 0 and r["n_best"][0]["score"] == 0 for r in rows if not r["text"])
    assert all(a["score"] >= b["score"] for r in rows for a, b in zip(r["n_best"], r["n_best"][1:]))
    assert pieces.segment(empty, MODEL).collect() == []


def test_chunks_side_by_side_equal_one_by_one(monkeypatch):
    own, rng = pieces.Vocabulary(MODEL), random.Random(4)
    words = ["".join(rng.choice("aehlnorstu▁,.1é") for _ in range(rng.randint(1, pieces.SHORT + 4))) for _ in range(2_000)]
    words += ["▁the", "▁", "▁日本", "\U0001f600x", "a\0b"]
    kinds, easy = own.together(words)
    some = [w for w, e in zip(words, easy) if e]
    assert 1_000 < len(some) < len(words)
    score, ids, sizes, loss = own.best_many(kinds[np.repeat(easy, [len(w) for w in words])], np.array([len(w) for w in some]))
    ends = np.cumsum(sizes)
    got = [(s, tuple(ids[e - n : e].tolist()), x) for s, n, e, x in zip(score, sizes, ends, loss)]
    assert got == [own.best(w) for w in some]
    # many texts at once, one by one, and with a memory that forgets: the same
    texts = ["", " ".join(words[:40]), "日本 語 \U0001f600", *(" ".join(rng.choices(words, k=20)) for _ in range(60))]
    shown = lambda segmented: [(s, b.tolist(), w) for s, b, w in segmented]
    alike = shown(pieces.Segmenter(MODEL, 4).segment_many(texts))
    monkeypatch.setattr(pieces, "REMEMBERED", 100)
    forgets = pieces.Segmenter(MODEL, 4)
    assert alike == shown(forgets.segment(t) for t in texts)
