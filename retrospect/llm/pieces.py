"""A SentencePiece model's own encoding, N-best segmentation into its pieces, and decoding.

Forward Viterbi gives, for each place of a text, the best score of what lies before it. Used as the
heuristic of a backward A-star search over the same lattice, it is exact, so that hypotheses leave
the agenda from the best one on."""

from __future__ import annotations

import zlib
from array import array
from bisect import insort
from functools import cache
from itertools import chain, combinations, count, product
from math import prod

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import schema_plus, table
from .encode import _Numbers, batches_of

BLANK = "▁"
#: What a character without a piece (written as its bytes) costs below the lowest score of a piece.
FALLBACK = 10.0
#: Chunks a worker remembers. When there are more it forgets those that came in one text only (or
#: the less frequent half), which costs time and changes no result.
REMEMBERED = 300_000
#: Chunks up to this length are worked out together, and so many at a time.
SHORT, TOGETHER = 24, 8192
#: Characters of a part from which its forward scores are kept for the search that may follow.
LONG = 4096


class Vocabulary:
    """Pieces, scores and byte pieces of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text, self.score, self.byte = [], [], {}
        self.number: dict[str, int] = {}
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            self.text.append(piece)
            self.score.append(float(sp.get_score(i)))
            if sp.is_byte(i):
                self.byte[int(piece[3:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.number[piece] = i
        #: The last long part whose best path was found, and its forward scores.
        self.last: tuple = ("", [])
        self.low = min(s for s in (self.score[i] for i in self.number.values()) if s > -1e8) - FALLBACK
        self.inside = {p[k : k + 2] for p in self.number for k in range(len(p) - 1)}
        self.value = {i: b for b, i in self.byte.items()}
        #: Every end of a piece, with the piece's score and id where it is one itself.
        self.ending = {p[k:]: None for p in self.number for k in range(len(p))}
        self.ending |= {p: (self.score[i], i) for p, i in self.number.items()}
        self._number_prefixes()
        self.shown = [bytes([self.value[i]]) if i in self.value else t.replace(BLANK, " ").encode() for i, t in enumerate(self.text)]

    def _number_prefixes(self) -> None:
        """Numbers for the beginnings of pieces, and tables that lead from one to the next."""
        alone = sorted(c for c in self.number if len(c) == 1)
        #: A character's kind: 0 where it is no piece by itself.
        self.kind = np.zeros(0x110000, np.int32)
        self.kind[[ord(c) for c in alone]] = np.arange(1, len(alone) + 1)
        kind, self.kinds = {c: k for k, c in enumerate(alone, 1)}, len(alone) + 1
        node, steps = {"": 0}, {}
        for piece in self.number:
            if all(c in kind for c in piece):
                for k in range(1, len(piece) + 1):
                    if (own := node.setdefault(piece[:k], len(node))) == len(node) - 1:
                        steps[node[piece[: k - 1]] * self.kinds + kind[piece[k - 1]]] = own
        keys = sorted(steps)
        self.step = np.array([*keys, np.iinfo(np.int64).max])
        self.reached = np.array([*(steps[k] for k in keys), 0])
        self.whole = np.array([self.number.get(p, -1) for p in node], np.int32)
        self.scores = np.array(self.score)

    def together(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Kinds of all characters, and which texts ``best_many`` takes: short ones whose
        characters are pieces themselves."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        kinds = self.kind[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        return kinds, (sizes <= SHORT) & ~np.logical_or.reduceat(kinds == 0, np.cumsum(sizes) - sizes)

    def best_many(self, kinds: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What ``best`` gives, for texts of ``sizes`` characters one behind the other: (scores, all
        ids, number of ids of each, losses). Texts advance side by side, from each place along
        all pieces that start there; among equal scores the shorter last piece stays."""
        n, most = len(sizes), int(sizes.max())
        order = np.argsort(-sizes, kind="stable")
        long = sizes[order]
        grid = np.zeros((most + 1, n), np.int64)
        place = np.arange(len(kinds)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        back = np.empty(n, np.int64)
        back[order] = np.arange(n)
        grid[place, np.repeat(back, sizes)] = kinds
        first, second = np.full((most + 1, n), -np.inf), np.full((most + 1, n), -np.inf)
        came, by = np.zeros((most + 1, n), np.int8), np.full((most + 1, n), -1, np.int32)
        first[0] = 0
        for i in range(most):
            at = np.arange(int(np.searchsorted(-long, -i)))
            node, j = np.zeros(len(at), np.int64), i
            while len(at):
                key = node * self.kinds + grid[j, at]
                k = np.searchsorted(self.step, key)
                on = self.step[k] == key
                at, node, j = at[on], self.reached[k[on]], j + 1
                piece = self.whole[node]
                a, piece = at[piece >= 0], piece[piece >= 0]
                score = self.scores[piece]
                c, one = first[i, a] + score, first[j, a]
                second[j, a] = np.maximum(np.maximum(second[j, a], np.minimum(one, c)), second[i, a] + score)
                first[j, a] = np.maximum(one, c)
                b = a[c >= one]
                came[j, b], by[j, b] = i, piece[c >= one]
                if j == most:
                    break
        every, at, ids = np.arange(n), long.copy(), []
        while at.any():
            ids.append(by[at, every])
            at = came[at, every].astype(np.int64)
        rows = np.array(ids[::-1])[:, back].T
        score = first[long, every]
        return score[back], rows[rows >= 0].astype(np.uint32), (rows >= 0).sum(axis=1), (score - second[long, every])[back]

    def parts(self, text: str) -> list[str]:
        """``text`` cut between characters that no piece holds next to each other: no path crosses
        such a place, so what is best on each side is best for the whole."""
        cuts = [k for k in range(1, len(text)) if text[k - 1 : k + 1] not in self.inside]
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]

    def edges(self, text: str, j: int) -> list[tuple]:
        """The edges of the lattice that end at place j, shortest first: (start, score, ids)."""
        number, here = self.number, []
        if text[j - 1] not in number:
            raw = text[j - 1].encode("utf-8", "replace")
            here.append((j - 1, self.low, tuple(self.byte[b] for b in raw)))
        for i in range(j - 1, -1, -1):
            piece = text[i:j]
            if piece not in self.ending:  # no longer one ends here either
                break
            if (n := number.get(piece)) is not None:
                here.append((i, self.score[n], (n,)))
        return here

    def lattice(self, text: str) -> list[list[tuple]]:
        """For each place the edges that end there."""
        return [[], *(self.edges(text, j) for j in range(1, len(text) + 1))]

    def forward(self, text: str) -> array:
        """The best score of what lies before each place."""
        get, low, absent, out = self.ending.get, self.low, self, array("d", [0.0])
        for j in range(1, len(text) + 1):
            best, i = float("-inf"), j - 1
            while i >= 0:
                found = get(text[i:j], absent)
                if found is absent:
                    if i == j - 1:
                        best = out[i] + low
                    break
                if found is not None:
                    if (c := out[i] + found[0]) > best:
                        best = c
                elif i == j - 1:
                    best = out[i] + low
                i -= 1
            out.append(best)
        return out

    def best(self, text: str) -> tuple[float, tuple, float]:
        """(score, ids) of the best path of one part, and what the second best one loses: forward
        Viterbi that keeps the two best scores of each place."""
        get, low, absent = self.ending.get, float("-inf"), self
        first, second, by = [0.0], [low], [None]
        for j in range(1, len(text) + 1):
            one = two = low
            edge = None
            i = j - 1
            while i >= 0:
                found = get(text[i:j], absent)
                if found is absent:  # no longer piece ends here either
                    if i == j - 1:
                        one, two = first[i] + self.low, second[i] + self.low
                        edge = (i, tuple([self.byte[b] for b in text[i].encode("utf-8", "replace")]))
                    break
                if found is not None:
                    s = found[0]
                    c = first[i] + s
                    if c > one:
                        one, two = c, one
                        edge = (i, (found[1],))
                    elif c > two:
                        two = c
                    c = second[i] + s
                    if c > two:
                        two = c
                elif i == j - 1:
                    one, two = first[i] + self.low, second[i] + self.low
                    edge = (i, tuple([self.byte[b] for b in text[i].encode("utf-8", "replace")]))
                i -= 1
            first.append(one)
            second.append(two)
            by.append(edge)
        if len(text) >= LONG:
            self.last = text, first
        place, back = len(text), []
        while place:
            place, own = by[place]
            back.append(own)
        return one, tuple(chain.from_iterable(reversed(back))), one - two

    def n_best(self, text: str, n: int) -> list[tuple[float, tuple]]:
        """The ``n`` best paths (score, ids) of one part, best first.

        Hypotheses on the agenda stand for sets of paths that have none in common, and the heuristic is
        exact, so each is sure of one path of its value: only as many of the best as are still asked
        for are kept, whatever the text's length. Edges are worked out where the search comes by."""
        if len(text) == 1:
            ((_, s, ids),) = self.edges(text, 1)
            return [(s, ids)]
        forward = self.last[1] if self.last[0] == text else self.forward(text)
        order = count()  # among equal scores the newest hypothesis first: straight to the start
        agenda = [(-forward[-1], 0, len(text), 0.0, None)]
        out: list[tuple[float, tuple]] = []
        while agenda and len(out) < n:
            _, _, place, behind, path = agenda.pop(0)
            if not place:
                ids: list[int] = []
                while path is not None:
                    ids += path[0]
                    path = path[1]
                out.append((behind, tuple(ids)))
                continue
            for i, s, ids in self.edges(text, place):
                insort(agenda, (-(forward[i] + s + behind), -next(order), i, s + behind, (ids, path)), key=lambda x: x[:2])
            del agenda[n - len(out) :]
        return out


def merged(parts: list[list[tuple]], n: int) -> list[tuple[float, list[int]]]:
    """The ``n`` best ways to take one of each part's alternatives: (loss, choice of each part that
    is not its best as (part, rank)). Only the n - 1 parts whose second choice costs least can be
    changed in them: any other change is no better than n - 1 single ones and no change at all. Nor
    can ways be among them that n others precede by lower ranks alone."""
    loss = sorted((p[0][0] - p[1][0], k) for k, p in enumerate(parts) if len(p) > 1)[: n - 1]
    some = [k for _, k in loss]
    ways = []
    for size in range(len(some) + 1):
        for chosen in combinations(sorted(some), size):
            for ranks in product(*(range(1, len(parts[k])) for k in chosen)) if 2**size <= n else ():
                if prod(r + 1 for r in ranks) > n:
                    continue
                ways.append((sum(parts[k][0][0] - parts[k][r][0] for k, r in zip(chosen, ranks)), size, list(zip(chosen, ranks))))
    ways.sort(key=lambda w: (w[0], w[1], w[2]))
    return [(w[0], w[2]) for w in ways[:n]]


class Segmenter:
    """N-best segmentation of whole texts; what is best for a chunk is worked out once a worker."""

    def __init__(self, path: str, n: int):
        self.vocabulary, self.n = Vocabulary(path), n
        if any(BLANK in p.lstrip(BLANK) for p in self.vocabulary.number):
            raise ValueError("a piece holds a blank behind another character")
        self.known: dict[str, tuple] = {}
        self.searched: dict[str, list] = {}
        self.chunks, self.ids, self.used = _Numbers(), np.zeros(0, np.uint32), 0
        self.sizes, self.starts, self.hits = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.score, self.second = np.zeros(0), np.zeros(0)
        #: Chunks by number, and the model's own ids of them, one behind the other, with their ends.
        self.names: list[str] = []
        self.own, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _forget(self) -> None:
        n = len(self.chunks)
        hits = self.hits[:n]
        keep = np.flatnonzero(hits > 1)
        if len(keep) > REMEMBERED // 2:
            keep = np.sort(np.argsort(-hits, kind="stable")[: REMEMBERED // 2])
        self.own, self.ends = self._own(keep), np.concatenate([[0], np.cumsum(np.diff(self.ends)[keep])])
        self.names = [self.names[k] for k in keep.tolist()]
        self.chunks = _Numbers(self.names)
        self.ids = self._ids(keep)
        self.used = len(self.ids)
        self.sizes, self.score, self.second = self.sizes[keep], self.score[keep], self.second[keep]
        self.starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        self.hits = np.ones(len(keep), np.int32)

    def part(self, text: str) -> tuple[float, tuple, float]:
        if (got := self.known.get(text)) is None:
            if len(self.known) > REMEMBERED // 4:
                self.known.clear()
            got = self.known[text] = self.vocabulary.best(text)
        return got

    def chunk(self, text: str) -> tuple[float, tuple, float]:
        """The best score and ids of a chunk, and what its second best segmentation loses."""
        names = self.vocabulary.parts(text)
        if len(names) == 1:
            return self.vocabulary.best(text) if len(text) < LONG else self.part(text)  # kept as a chunk
        parts = [self.part(x) for x in names]
        return sum([p[0] for p in parts]), tuple(chain.from_iterable([p[1] for p in parts])), min([p[2] for p in parts])

    def search(self, text: str) -> list[tuple[float, tuple]]:
        """The n best (score, ids) of a chunk, from the search over those of its parts that the n
        best ones can differ in; the first is ``chunk``'s."""
        if (out := self.searched.get(text)) is None:
            if len(self.searched) > REMEMBERED // 16:
                self.searched.clear()
            names = self.vocabulary.parts(text)
            best = [self.part(x) for x in names]
            some = sorted(sorted(range(len(names)), key=lambda k: (best[k][2], k))[: self.n - 1])
            ways = []
            for k in some:
                own = [w for w in self.vocabulary.n_best(names[k], self.n) if w[1] != best[k][1]]
                ways.append([best[k][:2], *own][: self.n])
            score, out = sum(p[0] for p in best), []
            for loss, changes in merged(ways, self.n):
                choice = {some[k]: ways[k][r][1] for k, r in changes}
                out.append((score - loss, tuple(chain.from_iterable(choice.get(k, p[1]) for k, p in enumerate(best)))))
            self.searched[text] = out
        return out

    @staticmethod
    def cut(text: str) -> list[str]:
        """The chunks of a text: pieces hold blanks at their beginning only, so none crosses a
        place before a blank that follows something else. A blank is put before the text."""
        if not text:
            return []
        if "  " not in text and text[0] != " ":
            return [BLANK + x for x in text.replace(BLANK, " ").split(" ")] if BLANK not in text else Segmenter._careful(text)
        return Segmenter._careful(text)

    @staticmethod
    def _careful(text: str) -> list[str]:
        text = BLANK + text.replace(" ", BLANK)
        cuts = [0, *(k for k in range(1, len(text)) if text[k] == BLANK and text[k - 1] != BLANK), len(text)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:])]

    def _ids(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of chunks, one behind the other."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes, dtype=np.int64)
        return self.ids[np.repeat(self.starts[numbers] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]

    def _own(self, numbers: np.ndarray) -> np.ndarray:
        """The model's own ids of chunks, one behind the other."""
        sizes = self.ends[numbers + 1] - self.ends[numbers]
        after = np.cumsum(sizes)
        return self.own[np.repeat(self.ends[numbers] - (after - sizes), sizes) + np.arange(int(after[-1]) if len(after) else 0)]

    def _learn(self, new: list[str], was: int) -> None:
        """The model's encoding and the best segmentations of the chunks numbered from ``was`` on. Merges,
        like paths, never cross from one chunk to the next; the library puts a blank before each."""
        self.names += new
        found = self.vocabulary.library.encode([x[1:].replace(BLANK, " ") for x in new], num_threads=1)
        blank = self.vocabulary.number.get(BLANK)  # a chunk that is a blank alone has no text to give to the library
        alone = [blank] if blank is not None else [self.vocabulary.byte[b] for b in BLANK.encode()]
        found = [alone if x == BLANK else ids for x, ids in zip(new, found, strict=True)]
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))])
        self.own = np.concatenate([self.own, np.fromiter(chain.from_iterable(found), np.uint32)])
        for a in range(0, len(new), TOGETHER):
            names = new[a : a + TOGETHER]
            n, at = len(names), was + a
            kinds, easy = self.vocabulary.together(names)
            sizes, score, second, own = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), []
            if easy.any():
                length = np.fromiter(map(len, names), np.int64, n)
                score[easy], ids, sizes[easy], second[easy] = self.vocabulary.best_many(kinds[np.repeat(easy, length)], length[easy])
                own.append(ids)
            hard = np.flatnonzero(~easy)
            found = [self.chunk(names[k]) for k in hard.tolist()]
            score[hard], sizes[hard], second[hard] = [f[0] for f in found], [len(f[1]) for f in found], [f[2] for f in found]
            own.append(np.fromiter(chain.from_iterable(f[1] for f in found), np.uint32))
            if at + n > len(self.sizes):
                self.sizes, self.starts, self.hits, self.score, self.second = (
                    np.concatenate([x[:at], np.zeros(max(4096, (at + n) // 4) + n, x.dtype)]) for x in (self.sizes, self.starts, self.hits, self.score, self.second)
                )
            ids = np.concatenate(own)
            if self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used // 4 + 4096 + len(ids), np.uint32)])
            self.ids[self.used : self.used + len(ids)] = ids
            placed = np.concatenate([np.flatnonzero(easy), hard])
            self.starts[at + placed] = self.used + np.cumsum(sizes[placed]) - sizes[placed]
            self.sizes[at : at + n], self.score[at : at + n], self.second[at : at + n] = sizes, score, second
            self.used += len(ids)

    def segment(self, text: str) -> tuple[float, np.ndarray, list[tuple[float, list[tuple]]]]:
        return next(self.segment_many([text]))

    def segment_many(self, texts: list[str]):
        """For each text (score, ids of the best segmentation, the n best as (score, changes)); a
        change is (place in the best ids, ids it takes the place of, new ids)."""
        for own in self._cut_many(texts):
            yield self._ways(own) if len(own) else (0.0, np.empty(0, np.uint32), [(0.0, [])])

    def _cut_many(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's chunks; those not known yet are worked out. Chunks of texts with no
        two blanks side by side are told apart in Arrow, many texts at once."""
        if len(self.chunks) > REMEMBERED:
            self._forget()
        was, number = len(self.chunks), self.chunks.__getitem__
        easy = [k for k, t in enumerate(texts) if t and "  " not in t and t[0] != " " and BLANK not in t]
        out: list = [None] * len(texts)
        if easy:
            lists = pc.split_pattern(pa.array([texts[k] for k in easy], pa.string()), " ")
            coded = lists.values.dictionary_encode()
            names = coded.dictionary.to_numpy(zero_copy_only=False)
            numbers = np.fromiter((number(BLANK + x) for x in names), np.int64, len(names))[coded.indices.to_numpy()]
            ends = lists.offsets.to_numpy()
            for k, a, b in zip(easy, ends.tolist(), ends[1:].tolist()):
                out[k] = numbers[a:b]
        for k, t in enumerate(texts):
            if out[k] is None:
                cut = self.cut(t)
                out[k] = np.fromiter(map(number, cut), np.int64, len(cut))
        if len(self.chunks) > was:
            self._learn(self.chunks.last(len(self.chunks) - was), was)
        return out

    def work(self, texts: list[str], ways: bool = True):
        """For each text its chunks' numbers taken once: (the model's own ids, what ``segment_many`` gives or None)."""
        for own in self._cut_many(texts):
            found = None if not ways else self._ways(own) if len(own) else (0.0, np.empty(0, np.uint32), [(0.0, [])])
            yield self._own(own), found

    def _ways(self, numbers: np.ndarray):
        self.hits[numbers] += 1  # once a text
        score, second, sizes = float(self.score[numbers].sum()), self.second[numbers], self.sizes[numbers]
        few = min(self.n - 1, len(second))
        if few:
            # the least losses, the first places among equal ones
            bar = np.partition(second, few - 1)[few - 1]
            below, at = np.flatnonzero(second < bar), np.flatnonzero(second == bar)
            some = np.sort(np.concatenate([below, at[: few - len(below)]]))
        else:
            some = np.empty(0, np.int64)
        some = some[np.isfinite(second[some])]
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        ways, out = [self.search(self.names[numbers[k]]) for k in some], []
        for loss, changes in merged(ways, self.n):
            out.append((score - loss, [(int(starts[some[p]]), int(sizes[some[p]]), list(ways[p][r][1])) for p, r in changes]))
        return score, self._ids(numbers), out

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """The model's own encoding of each whole text, by the library: merges for a BPE model."""
        return [ids for ids, _ in self.work(texts, False)]

    def decode(self, ids) -> str:
        """The text of ids: blanks for their sign, the blank in front taken off, bytes joined."""
        shown = self.vocabulary.shown
        return b"".join([shown[i] for i in ids]).decode("utf-8", "replace")[1:]


@cache
def segmenter(path: str, n: int) -> Segmenter:
    return Segmenter(path, n)


CHANGE = pa.struct([("at", pa.int64()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])
#: What ``segment`` can add: type in Arrow and in Spark.
COLUMNS = {
    "ids": (pa.list_(pa.int32()), "array<int>"),
    "best_ids": (pa.list_(pa.int32()), "array<int>"),
    "n_best": (pa.list_(pa.struct([("score", pa.float64()), ("changes", pa.list_(CHANGE))])), "array<struct<score:double,changes:array<struct<at:bigint,n:int,ids:array<int>>>>>"),
    "scores": (pa.list_(pa.float64()), "array<double>"),
    "n_pieces": (pa.int64(), "bigint"),
    "ids_crc32": (pa.int64(), "bigint"),
    "decoded": (pa.string(), "string"),
}


def _segment(batches, text_at: int, path: str, n: int, add: tuple):
    own = segmenter(path, n)
    make = {
        "ids": lambda ids, best, ways: ids.astype(np.int32),
        "best_ids": lambda ids, best, ways: best.astype(np.int32),
        "n_best": lambda ids, best, ways: [{"score": s, "changes": [{"at": x, "n": y, "ids": z} for x, y, z in c]} for s, c in ways],
        "scores": lambda ids, best, ways: [s for s, _ in ways],
        "n_pieces": lambda ids, best, ways: len(ids),
        "ids_crc32": lambda ids, best, ways: zlib.crc32(ids.astype("<u4").tobytes()),
        "decoded": lambda ids, best, ways: own.decode(ids.tolist()),
    }
    searched = bool({"best_ids", "n_best", "scores"} & set(add))
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            texts = [t or "" for t in batch.column(text_at).slice(a, 1024).to_pylist()]
            for b, c in batches_of(texts, 1 << 21):
                out: dict[str, list] = {x: [] for x in add}
                for ids, found in own.work(texts[b:c], searched):
                    _, best, ways = found or (0.0, None, None)
                    for x in add:
                        out[x].append(make[x](ids, best, ways))
                part = batch.slice(a + b, c - b)
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(out[x], COLUMNS[x][0]) for x in add)], [*part.schema.names, *add])


def segment(df: DataFrame, path: str, text_col: str = "text", n: int = 4, add: tuple = ("ids", "best_ids", "n_best")) -> DataFrame:
    """Adds to each row what ``add`` names: ids (array, the model's own encoding by the library),
    n_pieces, ids_crc32 (of the ids as little-endian unsigned 32 bits) and decoded (the text the
    ids stand for); beside them best_ids (the segmentation of the highest score), n_best (the ``n``
    best ones, best first: score, and how they differ from best_ids) and scores (of the n best).
    A BPE model encodes by merges, whose ranks its scores are: there, the segmentation of the
    highest sum is seldom the encoding; for a unigram model it is. A score is the sum of the pieces' scores in the model file; a character without
    a piece is written as its bytes, at the lowest score less FALLBACK. A blank is put before a
    text, and blanks become U+2581.

    Texts are segmented whole. They are cut where no piece can cross, which changes no path and no
    order; each different chunk's best path is worked out once a worker, and the search for more
    runs over the chunks that the n best segmentations can differ in.

    Defined cases: null or empty text: no ids in either, one way of score 0; fewer than ``n`` ways where the
    lattice has fewer; a text's own U+2581 decodes as a blank; columns of ``df`` that bear a
    result's name are replaced, others stay; rows that repeat give rows that repeat."""
    df = df.drop(*add)
    at = df.columns.index(text_col)
    return df.mapInArrow(lambda it: _segment(it, at, path, n, add), schema_plus(df, ", ".join(f"{x} {COLUMNS[x][1]}" for x in add)))


def _decode(batches, ids_at: int, path: str, n: int):
    own = segmenter(path, n)
    for batch in batches:
        texts = [own.decode(x.as_py() or []) for x in batch.column(ids_at)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])


def decode(df: DataFrame, path: str, ids_col: str = "ids", n: int = 4) -> DataFrame:
    """Adds decoded, the text of the column of ids (null or empty: empty)."""
    df = df.drop("decoded")
    at = df.columns.index(ids_col)
    return df.mapInArrow(lambda it: _decode(it, at, path, n), schema_plus(df, "decoded string"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: pieces and crc32 of the model's own encoding, whether decoding it gives the text
    back, and the scores of the four segmentations with the highest sums."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = segment(docs, public_tokenizers.path("piece_bpe_32k.model"), add=("n_pieces", "ids_crc32", "scores", "decoded"))
    back = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), BLANK, " ")
    return out.select("doc_id", "n_pieces", "ids_crc32", "scores", back.alias("round_trip"))
