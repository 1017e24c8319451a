"""SentencePiece encoding and decoding with exact N-best segmentation.

The lattice of a text has an edge for every piece of the model that stands somewhere in it; a
character without a piece of its own is one edge of byte pieces. A segmentation's score is the
sum of its pieces' scores in the model file. N-best search runs forward Viterbi and then A-star
backward from the end: the forward scores are the exact best scores of what is left, so
segmentations leave the queue best first.

No piece holds a word mark after another character, so every path passes each place where a word
starts; the lattice falls into segments there (checked on the model: else a text is one segment).
Forward and backward scores of all new segments of some texts are found together, position by
position in arrays, and remembered (``room`` segments for good, a quarter as many for a while). The
second best path of a segment follows from both scores; only the N - 1 segments where deviating
costs least can take part in the N best of a text, and A-star runs on those alone.

Texts are read as the model's identity normalizer does: spaces become word marks, one is put in
front. ``decode`` gives the text back exactly, unless it holds the word mark itself.

Defined cases: null and empty texts have one empty segmentation of score 0; very long texts are
encoded whole, and a word of any length in time proportional to it; of equally good best
segmentations the one with the earliest start of its last pieces is first, other ties are ordered
by pieces from the end; repeated rows stay; an empty table gives no rows; the input's columns
travel in one struct, so names never clash.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orweave.llm import common

MARK = "▁"
INF = float("inf")
#: Segments up to so many characters are solved in arrays, longer ones where they can't be cut one by one.
LONG = 32
_models: dict[str, "Pieces"] = {}


@dataclass
class Coded:
    """A text's best segmentation, the scores of its n best and the ids of each as bytes."""

    ids: np.ndarray
    scores: list[float]
    variants: list[bytes]


class Trie:
    """The pieces by character as arrays: a step is a look-up of (node, character) in an open hash table."""

    def __init__(self, pieces: dict[str, tuple[int, float]]):
        chars = sorted({c for p in pieces for c in p})
        self.alphabet = np.array([ord(c) for c in chars], np.int64)
        classes, children = {c: k + 1 for k, c in enumerate(chars)}, {}
        node_of = {"": 0}
        for p in pieces:
            for k in range(1, len(p) + 1):
                if p[:k] not in node_of:
                    children[node_of[p[: k - 1]] * (len(chars) + 1) + classes[p[k - 1]]] = node_of[p[:k]] = len(node_of)
        self.width = len(chars) + 1
        self.piece, self.score = np.full(len(node_of), -1, np.int32), np.full(len(node_of), -INF)
        for p, (i, s) in pieces.items():
            self.piece[node_of[p]], self.score[node_of[p]] = i, s
        self.bits = max(4, (4 * len(children)).bit_length())
        self.keys, self.child = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        for slot, key, child in zip(self._slot(np.array(list(children), np.int64)).tolist(), children, children.values(), strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) % len(self.keys)
            self.keys[slot], self.child[slot] = key, child

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def classes(self, points: np.ndarray) -> np.ndarray:
        """Numbers of code points; 0 for one that no piece holds."""
        at = np.minimum(np.searchsorted(self.alphabet, points), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == points, at + 1, 0)

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """The child of each node; -1 where there is none."""
        key = node * self.width + char
        slot = self._slot(key)
        there = self.keys[slot]
        out = np.where(there == key, self.child[slot], -1)
        open_ = np.flatnonzero((there != key) & (there >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.keys)
            there = self.keys[slot[open_]]
            hit = there == key[open_]
            out[open_[hit]] = self.child[slot[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out


class _Known(dict):
    """Looks in ``late`` for what it lacks."""

    def __init__(self, late: dict):
        self.late = late

    def __missing__(self, key) -> int:
        return self.late[key]


class Pieces:
    def __init__(self, path: str, room: int = 800_000):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        self.bytes = {int(m.id_to_piece(i)[3:5], 16): (i, m.get_score(i)) for i in range(size) if m.is_byte(i)}
        self.scores = {m.id_to_piece(i): (i, m.get_score(i)) for i in range(size) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}
        self.longest = max(map(len, self.scores))
        self.trie = Trie(self.scores)
        self.pairs = {p[k : k + 2] for p in self.scores for k in range(len(p) - 1)}
        self.parted = not any(MARK in p.lstrip(MARK) for p in self.scores)
        texts = [m.id_to_piece(i).replace(MARK, " ").encode() for i in range(size)]
        for b, (i, _) in self.bytes.items():
            texts[i] = bytes([b])
        for i in range(size):
            if m.is_control(i) or m.is_unknown(i):
                texts[i] = b""
        self.texts = pa.array(texts, pa.large_binary())
        self.width = "<u2" if size <= 1 << 16 else "<u4"
        self.room = room
        #: Numbers of segments (without the mark in front) and, as tuples, of parts of long ones: the first ``room``, and later ones.
        self.late: dict = {}
        self.known = _Known(self.late)
        self.base: int | None = None
        self.ids, self.starts = array("H" if self.width == "<u2" else "I"), array("q", [0])
        self.score, self.gap = array("d"), array("d")
        self.several: dict[str, list] = {}

    # Segments

    def segments(self, text: str) -> list[str]:
        """The text cut where a word starts, each segment without the mark in front of it."""
        if not text:
            return []
        if not self.parted:
            return [text.replace(" ", MARK)]
        words = text.split(" ")
        if "" in words or MARK in text:
            return [s[1:] for s in re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", MARK + MARK.join(words))]
        return words

    def _store(self, ids: np.ndarray, counts: np.ndarray, score: np.ndarray, gap: np.ndarray) -> int:
        """Append solved segments; the number of the first."""
        first = len(self.score)
        self.ids.frombytes(ids.astype(self.width).tobytes())
        self.starts.frombytes((self.starts[-1] + np.cumsum(counts)).astype(np.int64).tobytes())
        self.score.frombytes(np.asarray(score, np.float64).tobytes())
        self.gap.frombytes(np.asarray(gap, np.float64).tobytes())
        return first

    def _forget(self) -> None:
        if len(self.late) > self.room // 4:
            self.late.clear()
            del self.ids[self.starts[self.base] :], self.starts[self.base + 1 :], self.score[self.base :], self.gap[self.base :]
        if len(self.several) > self.room // 10:
            self.several.clear()

    def _remember(self, keys: list, first: int) -> None:
        (self.known if self.base is None else self.late).update(zip(keys, range(first, first + len(keys)), strict=True))
        if self.base is None and len(self.score) >= self.room:
            self.base = len(self.score)

    def learn(self, texts: list[list[str]]) -> None:
        """Solve the segments of these texts that aren't remembered. Numbers hold until the next call."""
        self._forget()
        new = list(set().union(*texts).difference(self.known).difference(self.late))
        short = [s for s in new if len(s) < LONG]
        for at in range(0, len(short), 20_000):
            part = short[at : at + 20_000]
            self._remember(part, self._solve([MARK + s for s in part]))
        if len(short) < len(new):
            self._join([s for s in new if len(s) >= LONG])

    def _join(self, long: list[str]) -> None:
        """Solve long segments by parts: where no piece holds two neighbouring characters, every path passes between them."""
        cut = {}
        for s in long:
            whole = MARK + s
            at = [0, *(k for k in range(1, len(whole)) if whole[k - 1 : k + 1] not in self.pairs), len(whole)]
            cut[s] = [whole[a:b] for a, b in zip(at, at[1:], strict=False)]
        parts = [p for p in {p for x in cut.values() for p in x} if (p,) not in self.known and (p,) not in self.late]
        small = [p for p in parts if len(p) <= LONG]
        for at in range(0, len(small), 20_000):
            part = small[at : at + 20_000]
            self._remember([(p,) for p in part], self._solve(part))
        for p in parts:
            if len(p) > LONG:
                self._remember([(p,)], self._store(*self._solve_one(p)))
        for s, x in cut.items():
            at = [self.known[p,] for p in x]
            ids = np.concatenate([np.array(self.ids[self.starts[i] : self.starts[i + 1]], self.width) for i in at])
            self._remember([s], self._store(ids, np.array([len(ids)]), [sum(self.score[i] for i in at)], [min(self.gap[i] for i in at)]))

    # Forward and backward scores

    def _solve(self, segments: list[str]) -> int:
        """Solve segments in arrays and store them: ids of the best path, its score, by how much the second best is lower."""
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        starts = np.cumsum(lengths + 1) - lengths - 1
        # One place for each character and one for the end of each segment; ends hold no character.
        points = np.frombuffer("\0".join([*segments, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        ends = starts + lengths
        chars = self.trie.classes(points)
        chars[ends] = 0
        most = int(min(lengths.max(), self.longest))
        score, piece = np.full((most + 1, len(points)), -INF), np.full((most + 1, len(points)), -1, np.int32)
        at, node = np.flatnonzero(chars), np.zeros(len(points), np.int64)
        node = node[at]
        for size in range(1, most + 1):
            node = self.trie.step(node, chars[at + size - 1])
            alive = node >= 0
            at, node = at[alive], node[alive]
            if not len(at):
                most = max(1, size - 1)
                break
            score[size, at], piece[size, at] = self.trie.score[node], self.trie.piece[node]
        spelled = np.flatnonzero(piece[1] < 0)
        spelled = spelled[~np.isin(spelled, ends)]
        words = {p: self._spelled(chr(p)) for p in np.unique(points[spelled]).tolist()}
        score[1, spelled] = [words[p][1] for p in points[spelled].tolist()]
        # Forward: the first of the best edges into a place, from the earliest start on, is kept.
        fore, into = np.full(len(points), -INF), np.zeros(len(points), np.int64)
        fore[starts] = 0.0
        back = np.full(len(points), -INF)
        back[ends] = 0.0
        order = np.argsort(-lengths, kind="stable")
        counts = np.searchsorted(-lengths[order], -np.arange(lengths.max() + 1), "right")
        for j in range(1, int(lengths.max()) + 1):
            there = starts[order[: counts[j]]] + j
            best, size_of = np.full(len(there), -INF), np.zeros(len(there), np.int64)
            for size in range(min(j, most), 0, -1):
                value = fore[there - size] + score[size, there - size]
                better = value > best
                best[better], size_of[better] = value[better], size
            fore[there], into[there] = best, size_of
            there = ends[order[: counts[j]]] - j
            best = np.full(len(there), -INF)
            for size in range(1, min(j, most) + 1):
                np.maximum(best, score[size, there] + back[there + size], out=best)
            back[there] = best
        used, here, left = np.zeros(len(points), np.int64), ends.copy(), np.flatnonzero(lengths)
        while len(left):
            size = into[here[left]]
            here[left] -= size
            used[here[left]] = size
            left = left[here[left] > starts[left]]
        second = np.full(len(points), -INF)
        for size in range(1, most + 1):
            value = fore[: len(points) - size] + score[size, : len(points) - size] + back[size:]
            value[used[: len(points) - size] == size] = -INF
            np.maximum(second[: len(points) - size], value, out=second[: len(points) - size])
        gap = fore[ends] - np.maximum.reduceat(second, starts)
        steps = np.flatnonzero(used)
        ids, many = piece[used[steps], steps], np.ones(len(steps), np.int64)
        odd = np.flatnonzero(ids < 0)
        if len(odd):
            spellings = [words[p][0] for p in points[steps[odd]].tolist()]
            many[odd] = [len(x) for x in spellings]
            flat = np.repeat(ids, many)
            flat[np.repeat(ids < 0, many)] = [i for x in spellings for i in x]
            ids = flat
        upto = np.concatenate([[0], np.cumsum(many)])
        edge = np.searchsorted(steps, np.append(starts, len(points)))
        return self._store(ids, np.diff(upto[edge]), fore[ends], gap)

    def _solve_one(self, segment: str) -> tuple[np.ndarray, np.ndarray, list[float], list[float]]:
        """As ``_solve``, for one segment of any length."""
        edges = self.edges(segment)
        fore, last = self.forward(edges)
        path, used, at = [], set(), len(edges)
        while at:
            start, (to, ids, _) = last[at]
            path.append(ids)
            used.add((start, to))
            at = start
        back, second = [-INF] * len(edges) + [0.0], -INF
        for at in range(len(edges) - 1, -1, -1):
            for to, _, score in edges[at]:
                back[at] = max(back[at], score + back[to])
                if (at, to) not in used:
                    second = max(second, fore[at] + score + back[to])
        flat = np.array([i for ids in reversed(path) for i in ids], self.width)
        return flat, np.array([len(flat)]), [fore[-1]], [fore[-1] - second]

    def edges(self, segment: str) -> list[list[tuple[int, tuple[int, ...], float]]]:
        """For each start: (end, ids, score) of the edges that leave it."""
        out = []
        for at in range(len(segment)):
            here = [(at + k, (p[0],), p[1]) for k in range(1, min(self.longest, len(segment) - at) + 1) if (p := self.scores.get(segment[at : at + k]))]
            if not here or here[0][0] != at + 1:
                here.insert(0, (at + 1, *self._spelled(segment[at])))
            out.append(here)
        return out

    def _spelled(self, char: str) -> tuple[tuple[int, ...], float]:
        """(ids, score) of the byte pieces of a character."""
        found = [self.bytes[b] for b in char.encode("utf-8", "replace")]
        return tuple(i for i, _ in found), sum(s for _, s in found)

    @staticmethod
    def forward(edges: list) -> tuple[list[float], list[tuple]]:
        """Best score of the paths to each place and the last edge (start, edge) of one."""
        best, last = [-INF] * (len(edges) + 1), [None] * (len(edges) + 1)
        best[0] = 0.0
        for at, here in enumerate(edges):
            base = best[at]
            for edge in here:
                if base + edge[2] > best[edge[0]]:
                    best[edge[0]], last[edge[0]] = base + edge[2], (at, edge)
        return best, last

    # The n best

    def nbest(self, segment: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best paths by backward A-star with forward Viterbi scores: (score, ids), best first."""
        edges = self.edges(segment)
        fore, _ = self.forward(edges)
        into: list[list] = [[] for _ in range(len(edges) + 1)]
        for at, here in enumerate(edges):
            for to, ids, score in here:
                into[to].append((at, ids, score))
        queue, found = [(-fore[-1], (), len(edges), 0.0)], []
        while queue and len(found) < n:
            f, tail, at, score = heapq.heappop(queue)
            if at == 0:
                found.append((-f, tail[::-1]))
                continue
            for start, ids, s in into[at]:
                heapq.heappush(queue, (-(fore[start] + s + score), tail + ids[::-1], start, score + s))
        return found

    def ranked(self, segment: str, best: tuple[int, ...], n: int) -> list[tuple[float, tuple[int, ...]]]:
        """``nbest`` with the Viterbi path in front: where several are best, it may stand anywhere among them, or behind the n."""
        found = self.nbest(segment, n)
        return [(found[0][0], best), *[x for x in found if x[1] != best][: n - 1]]

    def _ways(self, parts: list[str], where: np.ndarray, gaps: np.ndarray, n: int) -> list[tuple[float, tuple[tuple[int, int], ...]]]:
        """(loss, deviations (segment, rank)) of the n best segmentations of a text."""
        open_ = np.flatnonzero(gaps < INF)
        if len(open_) > n - 1:
            limit = np.partition(gaps[open_], n - 2)[n - 2] if n > 1 else -INF
            below, same = open_[gaps[open_] < limit], open_[gaps[open_] == limit]
            open_ = np.sort(np.concatenate([below, same[: n - 1 - len(below)]]))
        ways: list[tuple[float, tuple]] = [(0.0, ())]
        for i in open_.tolist():
            if (parts[i], n) not in self.several:
                k = where[i]
                self.several[parts[i], n] = self.ranked(MARK + parts[i], tuple(self.ids[self.starts[k] : self.starts[k + 1]]), n)
            ranks = self.several[parts[i], n]
            costs = [(ranks[0][0] - s, ((i, k),) if k else ()) for k, (s, _) in enumerate(ranks)]
            ways = heapq.nsmallest(n, ((c + d, w + x) for c, w in ways for d, x in costs))
        return ways

    def batch(self, texts: list[str], n: int) -> list[Coded]:
        """The n best segmentations of each text."""
        split = list(map(self.segments, texts))
        self.learn(split)
        where = np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        bound = np.cumsum([0, *map(len, split)]).tolist()
        # Copies: an array can't grow while numpy looks at it.
        starts, flat = np.array(self.starts), np.array(self.ids, self.width)
        scores, gaps = np.array(self.score)[where], np.array(self.gap)[where]
        sizes = starts[where + 1] - starts[where]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[np.repeat(starts[where] - upto[:-1], sizes) + np.arange(upto[-1])]
        out = []
        for parts, a, b in zip(split, bound, bound[1:], strict=False):
            if a == b:
                out.append(Coded(ids[:0], [0.0], [b""]))
                continue
            best, total = ids[upto[a] : upto[b]], float(scores[a:b].sum())
            ways = self._ways(parts, where[a:b], gaps[a:b], n)
            whole, size, variants = best.tobytes(), best.itemsize, []
            for _, way in ways:
                pieces, at = [], 0
                for i, k in way:
                    begin, end = (int(upto[a + j] - upto[a]) * size for j in (i, i + 1))
                    pieces += [whole[at:begin], np.array(self.several[parts[i], n][k][1], self.width).tobytes()]
                    at = end
                variants.append(b"".join([*pieces, whole[at:]]) if way else whole)
            out.append(Coded(best, [total - c for c, _ in ways], variants))
        return out

    def decode_bytes(self, lists: list[np.ndarray]) -> list[bytes]:
        """The texts of lists of ids; the mark in front is taken off."""
        joined = self.texts.take(pa.array(np.concatenate(lists) if lists else np.empty(0, self.width)))
        offsets = np.frombuffer(joined.buffers()[1], np.int64)[: len(joined) + 1]
        data = joined.buffers()[2].to_pybytes() if len(joined) and joined.buffers()[2] else b""
        ends = offsets[np.cumsum([0, *map(len, lists)])].tolist() if len(joined) else [0] * (len(lists) + 1)
        return [data[a + (data[a : a + 1] == b" " and b > a) : b] for a, b in zip(ends, ends[1:], strict=False)]

    def decode(self, ids) -> str:
        return self.decode_bytes([np.asarray(ids, self.width)])[0].decode("utf-8", "replace")


def model(path: str) -> Pieces:
    """The model of a worker process, kept from task to task."""
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode(docs: DataFrame, path: str, n: int = 4, text_col: str = "text") -> DataFrame:
    """doc (struct of the input's columns but the text), ids, n_pieces, scores (n best), variants_crc32 (of each of the
    n best as little-endian ids of the model's width), round_trip (decoding gives the text)."""
    common.ship(docs.sparkSession)
    rest = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("doc"), F.col(text_col).cast("binary").alias("text"))
    none = F.lit(0).cast("long")
    schema = rows.select("doc", F.array(F.lit(0)).alias("ids"), none.alias("n_pieces"), F.array(F.lit(0.0)).alias("scores"), F.array(none).alias("variants_crc32"), F.lit(True).alias("round_trip")).schema

    def run(batches):
        m = model(path)
        for batch in batches:
            for some in common.slices(batch, 1):
                texts = [(x or b"").decode("utf-8", "replace") for x in some.column(1).to_pylist()]
                found = m.batch(texts, n)
                ids = [c.ids for c in found]
                trips = [x == t.encode("utf-8", "replace") for x, t in zip(m.decode_bytes(ids), texts, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), lists, pa.array(list(map(len, ids)), pa.int64()), pa.array([c.scores for c in found], pa.list_(pa.float64())), pa.array([[zlib.crc32(v) for v in c.variants] for c in found], pa.list_(pa.int64())), pa.array(trips)],
                    names=["doc", "ids", "n_pieces", "scores", "variants_crc32", "round_trip"],
                )

    return rows.mapInArrow(run, schema)
