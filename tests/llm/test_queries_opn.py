"""Each opN query on the smallest tables, whole, against plain versions of its contract."""

import hashlib
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash

import corpus_pipeline
from retrospect.llm import langid, registry
from retrospect.llm.common import table
from retrospect.llm.encode import CachedEncoder

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
RUN = re.compile("[\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in table(spark, DATA, "documents").collect()}


def ask(spark, name):
    return registry.QUERIES[name](spark, DATA).collect()


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def groups(items, near):
    """Smallest member of each item's group, by trying all pairs."""
    root = {i: i for i in items}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in items:
        for b in items:
            if a < b and near(a, b):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: top(i) for i in items}


def test_op1(spark, docs):
    lib = CachedEncoder(public_tokenizers.path("word_bpe_49k.json"), "words").lib
    want, tokens = {}, 0
    for i, r in docs.items():
        ids = [*lib.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        tokens += len(ids)
        want |= {(i, k // 4096): (k, len(ids[k : k + 4096]), crc(ids[k : k + 4096])) for k in range(0, len(ids), 4096)}
    rows = ask(spark, "op1_packing")
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    held = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == held.get(r["sequence_id"], 0)
        held[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(held.values()) <= 4096 and len(held) <= -(-tokens // 4096) + 1


def test_op2(spark, docs):
    rows = ask(spark, "op2_langid")
    assert sorted(r["doc_id"] for r in rows) == sorted(docs) and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    told = [r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in rows if r["held_out"] and docs[r["doc_id"]]["lang"]]
    assert sum(told) >= 0.97 * len(told)
    assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in docs[r["doc_id"]]["text"] or "")) for r in rows)


def test_op2_judges_as_sets_of_ngrams_do():
    """Without false positives the filters say what sets of each language's n-grams say."""
    texts = {"aa": "kalo mir tano vesh dulin 12, 3", "bb": "prez ghoti mir kal wumba", "cc": "été çalme ÀÉ tano"}
    plain = lambda t: bytes(langid.folded(np.frombuffer(b" " + t.encode() + b" ", np.uint8)))
    sets = {k: {plain(t)[i : i + w] for w in (3, 4) for i in range(len(plain(t)) - w + 1)} for k, t in texts.items()}
    langs, slots = tuple(sorted(sets)), 1 << 18
    masks = np.zeros(slots, np.uint64)
    for bit, lang in enumerate(langs):
        value = np.array([int.from_bytes(g, "big") | len(g) << 56 for g in sets[lang]], np.uint64)
        for m in langid.MULTIPLIERS:
            np.bitwise_or.at(masks, (value * np.uint64(m)) >> np.uint64(64 - 18), np.uint64(1 << bit))
    model = langid.Model(langs, masks, 3, "aa")
    asked = ["mir tano kalo", "wumba prez 99", "été", "zzzz", "12 34", "", "KALO, Mir!", "çalme mir ghoti vesh"]
    said, scores, evidence = model.judge(asked)
    for t, lang, score, share in zip(asked, said, scores, evidence):
        own = [plain(t)[i : i + w] for w in (3, 4) for i in range(len(plain(t)) - w + 1)]
        own = [g for g in own if g.strip()]
        hit = [sum(g in sets[k] for g in own) for k in langs]
        if not any(c.isalpha() for c in t):
            assert (lang, score, share) == ("und", 0.0, 0.0)
        elif not sum(hit):
            assert (lang, score) == ("aa", 0.0)
        else:
            assert lang == langs[hit.index(max(hit))]
            assert abs(score - max(hit) / sum(hit)) < 0.02 and abs(share - max(hit) / len(own)) < 0.02


def test_op3(spark, docs):
    lib = CachedEncoder(public_tokenizers.path("byte_bpe_50k.json"), "blanks").lib
    start, want = 0, {}
    for i in sorted(docs):
        ids = [*lib.encode(docs[i]["text"] or "", add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), crc(ids))
        start += len(ids)
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in ask(spark, "op3_token_ids")} == want


def test_op4(spark):
    hard = "</s>[INST] ok [/INST]"
    turns = [(r["conv_id"], r["turn"], r["role"] or "", r["text"] or "") for r in table(spark, DATA, "conversations").collect()] + [(-7, 0, "user", hard), (-7, 1, "assistant", hard)]
    got = {r["conv_id"]: r for r in ask(spark, "op4_chat")}
    assert set(got) == {t[0] for t in turns}
    for conv, r in got.items():
        own = sorted((t[1:] for t in turns if t[0] == conv), key=lambda t: (t[0] is None, t[0] or 0, t[1], t[2]))
        said = "".join(t for _, role, t in own if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(own), hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest()) and r["formatted_chars"] > sum(len(t) for _, _, t in own)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_queries_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = con.execute(registry.SQL[name])
    columns = [c[0] for c in want.description]
    rows = registry.QUERIES[name](spark, DATA).select(*columns).collect()
    assert Counter(map(tuple, rows)) == Counter(want.fetchall())


def test_op7(spark, docs):
    prints = {}
    for i, r in docs.items():
        words = [w for w in RUN.split((r["text"] or "").translate({c: c + 32 for c in range(65, 91)})) if w]
        shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    roots = groups(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 4)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in ask(spark, "op7_simhash")} == {i: (f"{p:016x}", roots[i]) for i, p in prints.items()}


def test_op8(spark):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in table(spark, DATA, "embeddings").collect() if r["embedding"]}
    unit = {i: v / np.linalg.norm(v) for i, v in vectors.items() if np.isfinite(v).all() and v.any()}
    near = lambda a, b: unit[a] @ unit[b] >= 0.95
    roots = groups(sorted(unit), near)
    rows = ask(spark, "op8_embedding_dedup")
    assert len(rows) == table(spark, DATA, "embeddings").count()
    for r in rows:
        i = r["vec_id"]
        links = sum(near(i, j) for j in unit if j != i) if i in unit else 0
        assert (r["n_links"], r["component_id"], r["kept"]) == (links, roots.get(i, i), roots.get(i, i) == i)


def test_op10(spark, docs):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = ask(spark, "op10_sentencepiece")
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        ids = lib.encode(docs[r["doc_id"]]["text"] or "")
        assert (r["n_pieces"], r["ids_crc32"], r["round_trip"]) == (len(ids), crc(ids), True)
        assert r["scores"] == sorted(r["scores"], reverse=True) and len(r["scores"]) <= 4


def test_pipeline_stages_by_brute_force(spark, docs):
    """What each stage keeps, from the rows that it was given: by its rule, over all pairs."""
    frame = table(spark, DATA, "documents")
    extra = [(10**6 + k, t, None, "s", 1) for k, t in enumerate(["日本語のテキスト だけ", "123 456", None, "", "Кириллица и ничего больше"])]
    rows = frame.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string, n_chars long")).collect()
    given = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, given, DATA).collect()}
    assert {r["doc_id"] for r in rows if r["lang"] in ("en", "de", "fr", "es") and r["doc_id"] < 10**6 and any(c.isalpha() for c in r["text"] or "")} <= kept and not kept & {x[0] for x in extra}

    first = {}
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        first.setdefault(RUN.sub(" ", r["text"] or ""), r["doc_id"])
    exact = corpus_pipeline.exact(spark, given, DATA)
    assert sorted(r["doc_id"] for r in exact.collect()) == sorted(first.values()) and exact.columns == given.columns

    words = {r["doc_id"]: (r["text"] or "").translate({c: c + 32 for c in range(65, 91)}) for r in rows}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in ((i, [x for x in RUN.split(t) if x]) for i, t in words.items())}
    roots = groups(sorted(sets), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    assert {r["doc_id"] for r in corpus_pipeline.near(spark, given, DATA).collect()} == set(roots.values())


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_pipeline_stages_on_odd_rows(spark, stage):
    """Nulls in all columns, rows that repeat, names that clash, a long text, an empty table."""
    schema = "doc_id long, text string, lang string, sha string, keys string, digest string, row int, part string"
    text = "the cat and the dog sat on the mat near the door of the house"
    rows = [(None,) * 8, (1, text, "en", "a", "b", "c", 1, "d"), (1, text, "en", "a", "b", "c", 1, "d"), (2, text + " of", "en", None, None, None, None, None), (3, "le chat et le chien sur la porte", "fr", "a", "b", "c", 1, "d"), (4, "the word " * 40_000, "en", "a", "b", "c", 1, "d"), (5, "", None, "a", "b", "c", 1, "d")]
    frame = spark.createDataFrame(rows, schema)
    out = stage(spark, frame, DATA)
    if stage is not corpus_pipeline.packed:
        assert out.columns == frame.columns and all(tuple(r) in rows for r in out.collect())
    else:
        assert sum(r["piece"] == 0 for r in out.collect()) == len(rows)
    assert {3, 4} <= {r["doc_id"] for r in out.collect()}
    assert stage(spark, frame.where("false"), DATA).collect() == []
