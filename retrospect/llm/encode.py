"""Exact encoding with a cache: a text is cut where the tokenizer can never join, and each
different piece is encoded once."""

from __future__ import annotations

import os
import re
from collections import defaultdict
from functools import cache, partial
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks a worker remembers, unless told. When there are more it forgets those that came in one batch only (or
#: the least frequent quarter), which costs time and changes no result.
REMEMBERED = 200_000
#: Characters below which texts are cut one by one.
FEW = 4096
#: Characters that no normaliser here changes but by lower-casing one for one.
PLAIN = re.compile("[\t-\r\x20-\x7e\xa1-\u012f\u0131-\u017f]*")
_L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_ENDS = "'s|'t|'re|'ve|'m|'ll|'d"
#: The two files' own patterns, over plain characters (fixed values).
PATTERN = {
    "words": re.compile(f"{_ENDS}|[{_L}]+|[{_N}]|[^\t-\r {_L}{_N}]+"),
    "blanks": re.compile(f"{_ENDS}| ?[{_L}]+| ?[{_N}]+| ?[^\t-\r {_L}{_N}]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"),
}
#: Byte-level alphabets write printable bytes as themselves and the others, in order, from U+0100 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_LETTER = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in _SHOWN)}
_LETTERS = np.array([ord(BYTE_LETTER[b]) for b in range(256)], "<u4")
_WHITE = re.compile("[\t-\r ]+")
_BEFORE_BLANK = re.compile(r"(?<=\S)(?= )")
_SPLIT = partial(pc.split_pattern, pattern=" ")
#: Chunks that are not cut at once: empty, white space at an end, or other characters.
_ODD = "^$|^[\t-\r ]|[\t-\r ]$|[^\t-\r\x20-\x7e\xa1-\u012f\u0131-\u017f]"


class _Numbers(defaultdict):
    """Numbers keys in the order in which they are first asked for."""

    def __init__(self, keys=()):
        super().__init__(count().__next__)
        for key in keys:
            self[key]

    def last(self, n: int) -> list:
        """The n keys numbered last, in order."""
        return list(islice(reversed(self), n))[::-1]


class CachedEncoder:
    """Encodes whole texts with a ``tokenizers`` file, special strings as ordinary text.

    A text is cut into chunks where tokens cannot join: mode "words", for tokenizers that drop white
    space and lower-case, cuts at white space; mode "blanks", for byte-level tokenizers whose tokens
    may begin with one blank, before each blank that follows something other than white space. The
    chunks of a batch are told apart in Arrow. Each different one of plain characters is cut by the
    file's own pattern once a batch, and each different part goes to the library's model once; a
    chunk with other characters goes to the library whole. The ids of parts and chunks, one after
    the other, are the text's."""

    def __init__(self, path: str, mode: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.encode_special_tokens = True
        self.words = mode == "words"
        self.remembered = remembered
        self.pattern = PATTERN[mode]
        #: What stands between chunks that are cut at once: a part of its own, or the blank that a chunk's first part begins with.
        self.between, self.cut_all = ("\n", re.compile(self.pattern.pattern + "|\n").findall) if self.words else (" ", self.pattern.findall)
        self.number = _Numbers(["\n"] if self.words else [])
        n = len(self.number)
        self.sizes, self.starts, self.hits = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        #: Whether a part begins a chunk where chunks are cut at once.
        self.opens = np.zeros(1 << 12, bool)
        self.opens[:n] = True
        self.ids = np.zeros(1 << 14, np.uint32)
        self.used = 0

    def _forget(self) -> None:
        hits = self.hits[: len(self.number)]
        keep = np.flatnonzero(hits > 1)
        if len(keep) > self.remembered * 3 // 4:
            keep = np.sort(np.argsort(-hits, kind="stable")[: self.remembered * 3 // 4])
        if self.words:
            keep = np.union1d(keep, [0])
        names = list(self.number)
        self.number = _Numbers(names[k] for k in keep.tolist())
        sizes = self.sizes[keep]
        ends = np.cumsum(sizes, dtype=np.int64)
        self.used = int(ends[-1]) if len(ends) else 0
        self.ids = self.ids[np.repeat(self.starts[keep] - (ends - sizes), sizes) + np.arange(self.used)]
        self.sizes, self.starts, self.hits, self.opens = sizes, ends - sizes, hits[keep] // 2 + 1, self.opens[keep]

    def _numbers(self, keys: list[str]) -> np.ndarray:
        """The numbers of parts and of chunks with other characters; those not known yet are looked up."""
        n = len(self.number)
        numbers = np.fromiter(map(self.number.__getitem__, keys), np.int64, len(keys))
        if len(self.number) > n:
            new = self.number.last(len(self.number) - n)
            found = self._look_up(new)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum()))
            if (room := n + len(found)) > len(self.sizes):
                self.sizes, self.starts, self.hits, self.opens = (np.concatenate([x, np.zeros(room + room // 4 - len(x), x.dtype)]) for x in (self.sizes, self.starts, self.hits, self.opens))
            if (room := self.used + len(flat)) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(room + room // 4 - len(self.ids), np.uint32)])
            self.ids[self.used : self.used + len(flat)] = flat
            self.sizes[n : n + len(found)] = sizes
            self.starts[n : n + len(found)] = self.used + np.cumsum(sizes) - sizes
            if not self.words:
                self.opens[n : n + len(found)] = [x[0] == " " for x in new]
            self.used += len(flat)
        return numbers

    def _look_up(self, keys: list[str]) -> list:
        tokenize, plain = self.lib.model.tokenize, PLAIN.fullmatch
        if plain("".join(keys)):
            some, odd = keys, []
        else:
            some, odd = [k for k in keys if plain(k)], [k for k in keys if not plain(k)]
        # all parts in the byte-level alphabet, parted by byte 0, which no plain part holds
        shown = _LETTERS[np.frombuffer("\0".join(some).encode(), np.uint8)].tobytes().decode("utf-32-le").split(BYTE_LETTER[0]) if some else []
        out = [[x.id for x in tokenize(k)] for k in shown]
        if not odd:
            return out
        found = dict(zip(odd, self.lib.encode_batch_fast(odd, add_special_tokens=False)))
        own = iter(out)
        return [found[k].ids if k in found else next(own) for k in keys]

    def _keys(self, text: str) -> list[str]:
        """A text's parts of plain chunks, and other chunks as they are."""
        cut, plain, words = self.pattern.findall, PLAIN.fullmatch, self.words
        if plain(text):
            return cut(text.lower() if words else text)
        keys: list[str] = []
        for chunk in (_WHITE if words else _BEFORE_BLANK).split(text):
            if plain(chunk):
                keys += cut(chunk.lower() if words else chunk)
            elif chunk:
                keys.append(chunk)
        return keys

    def _chunks(self, names: list[str], odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of parts, where each chunk's begin, how many it has). In mode "blanks" a blank
        stands before each chunk. Those marked ``odd`` are cut one by one, the others at once."""
        some, rest = np.flatnonzero(~odd), np.flatnonzero(odd).tolist()
        own = [names[k] for k in some.tolist()] if rest else names
        joined = self.between.join(own)
        numbers = self._numbers(self.cut_all(joined.lower() + "\n" if self.words else " " + joined)) if own else np.empty(0, np.int64)
        starts, n = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
        marks = np.flatnonzero(self.opens[numbers])
        if self.words:
            starts[some], n[some] = np.concatenate([[0], marks + 1])[: len(some)], np.diff(marks, prepend=-1) - 1
        else:
            starts[some], n[some] = marks, np.diff(marks, append=len(numbers))
        if rest:
            more = [self._keys(names[k] if self.words else " " + names[k]) for k in rest]
            n[rest] = [len(x) for x in more]
            starts[rest] = len(numbers) + np.cumsum(n[rest]) - n[rest]
            numbers = np.concatenate([numbers, self._numbers(list(chain.from_iterable(more)))])
        return numbers, starts, n

    def _cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all parts, ends of each text's): for many texts at once, in Arrow."""
        lists = (pc.ascii_split_whitespace if self.words else _SPLIT)(pa.array(texts, pa.string()))
        ends = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.values.dictionary_encode()
        odd = pc.match_substring_regex(coded.dictionary, _ODD).to_numpy(zero_copy_only=False)
        names, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy().astype(np.int64)
        flat, starts, n = self._chunks(names, odd)
        if not self.words:  # a text's first chunk has no blank before it; a blank behind white space is no place to cut
            firsts, lasts = ends[:-1], ends[1:] - 1
            white = np.zeros(len(names), bool)
            white[[k for k in np.flatnonzero(odd).tolist() if not names[k] or names[k][-1].isspace()]] = True
            behind = white[at]
            behind[lasts] = False
            behind[[k for k, x in zip(firsts.tolist(), at[firsts].tolist()) if not names[x]]] = False  # the blank that a text begins with
            apart = [self._keys(names[x]) for x in at[firsts].tolist()]
            for k in np.unique(np.searchsorted(ends, np.flatnonzero(behind), "right") - 1).tolist():
                apart[k] = self._keys(texts[k])
                at[ends[k] : ends[k + 1]] = len(names) + len(texts)  # nothing
            at[firsts] = len(names) + np.arange(len(texts))
            size = np.array([*map(len, apart), 0])
            starts, n = np.concatenate([starts, len(flat) + np.cumsum(size) - size]), np.concatenate([n, size])
            flat = np.concatenate([flat, self._numbers(list(chain.from_iterable(apart)))])
        size = n[at]
        total = np.concatenate([[0], np.cumsum(size)])
        return flat[np.repeat(starts[at] - total[:-1], size) + np.arange(total[-1])], total[ends]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each whole text."""
        if len(self.number) > self.remembered:
            self._forget()
        if sum(map(len, texts)) > FEW:
            numbers, sizes = self._cut(texts)
        else:
            keys = [self._keys(t) for t in texts]
            sizes = np.cumsum([0, *map(len, keys)])
            numbers = self._numbers(list(chain.from_iterable(keys)))
        self.hits[numbers] += 1  # once a batch
        own = self.sizes[numbers]
        ends = np.concatenate([[0], np.cumsum(own, dtype=np.int64)])
        ids = self.ids[np.repeat(self.starts[numbers] - ends[:-1], own) + np.arange(ends[-1])]
        cuts = ends[sizes]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


@cache
def encoder(path: str, mode: str, remembered: int = REMEMBERED) -> CachedEncoder:
    """One encoder a worker process."""
    return CachedEncoder(path, mode, remembered)


def batches_of(texts: list, most: int = 1 << 22):
    """Slices of a list of texts of about ``most`` characters at most, or one text."""
    start = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, k
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)
