"""Ids by place in token id files, and the encoder's ways of cutting texts."""

import glob
import random

import public_tokenizers
import pytest

from retrospect.llm import dac, encode


class Counted:
    """An open file that counts the bytes read."""

    def __init__(self, file):
        self.file, self.n = file, 0

    def read(self, n=-1):
        got = self.file.read(n)
        self.n += len(got)
        return got

    def __getattr__(self, name):
        return getattr(self.file, name)


def test_one_id_is_read_at_its_place(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = encode.CachedEncoder(path, "blanks").lib
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["alpha", "Über", "x9!", "\n\n", "naïve", "zzyzx"]) for _ in range(900)) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    dac.write_token_ids(df, f"{tmp_path}/ids", path, segment=3000)
    want = [i for t in texts for i in [*lib.encode(t, add_special_tokens=False).ids, 2]]
    got = []
    for name in sorted(glob.glob(f"{tmp_path}/ids/*.parquet")):
        with open(name, "rb") as f:
            file = Counted(f)
            for segment in dac.file_segments(file):
                file.n = 0
                for k in rng.sample(range(segment.n), 20):
                    before = file.n
                    assert segment[k] == segment.read(k, k + 1)[0]
                    assert segment[k] is not None and file.n - before < 1000
                got += segment.read(0, segment.n).tolist()
    assert got == want


@pytest.mark.parametrize("name, mode", [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "blanks")])
@pytest.mark.parametrize("few", [-1, 1 << 30])
def test_cut_at_once_or_one_by_one(name, mode, few, monkeypatch):
    """Blanks behind white space, chunks of other characters, and parts forgotten between batches."""
    monkeypatch.setattr(encode, "FEW", few)
    rng = random.Random(11)
    letters = list("ab cdEFé'sS \n\t  .,!?09 \xa0　\x85\x1c中ßİ̇¼ª\0") + ["'s", " '", "  ", "\n\n", " \n", "</s>", "[INST]", "ÿ", "ſ"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(40))) for _ in range(3000)] + ["", " ", "  ", "\n", " a", "a ", " \n a"]
    own = encode.CachedEncoder(public_tokenizers.path(name), mode, remembered=500)
    for k in range(0, len(texts), 250):
        part = texts[k : k + 250]
        want = [e.ids for e in own.lib.encode_batch(part, add_special_tokens=False)]
        assert [x.tolist() for x in own.encode_many(part)] == want
