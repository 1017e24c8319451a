"""Benchmark decontamination with a distributed positional inverted index.

``index`` stores the postings of every training token: the corpus is parted into segments of about
``SEGMENT_WORDS`` words of whole documents, and a segment is one row of a written table: its terms, how
often each stands, and its positions, by term and ascending, over the segment's documents laid end to
end. The index knows nothing of any test set and serves all.

``hits`` answers phrases from the stored lists alone. A window's candidates are the postings of its
rarest term in the segment, shifted by the term's offset; they are intersected with the shifted
postings of its other terms, from rare to frequent, until the window's exact occurrences remain.
``nearby`` asks the same lists for proximity: all distinct terms of an item within so many words, so
that inserted and swapped words hide nothing.

Terms are the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased. The
test set travels to the segments in blocks of about ``block_words`` words (an item that is longer is a
block), however large it is: a pass over the index for each block, hits of all blocks joined per document.

Defined cases: a null or empty text has no words and no hits; very long texts are indexed whole, a
segment holds one at least; items without words match nothing; items shorter than a window are one
window; equal item ids count once per id, equal items once per item; windows of an item with a null id
are hits that name no item; repeated documents are rows of their own; an empty corpus gives no rows
and an empty test set no hits; the documents' columns travel in one struct, so names never clash.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orweave.llm import common

#: Bytes that part words; a byte above 0x7F belongs to a letter of a word.
_PARTS = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
SEGMENT_WORDS = 400_000


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(_PARTS).split()


class Windows:
    """The distinct windows of some test items, as rows of term numbers."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], size: int):
        self.size, terms = size, {}
        of: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            ids = [terms.setdefault(w, len(terms)) for w in words(text)]
            for at in range(max(1, len(ids) - size + 1) if ids else 0):
                of.setdefault(tuple(ids[at : at + size]), set()).add(item)
        self.terms = pa.array(list(terms), pa.binary())
        self.items = [sorted(x - {None}) for x in of.values()]
        self.lengths = np.fromiter(map(len, of), np.int64, len(of))
        self.padded = np.full((len(of), size), -1, np.int64)
        for i, w in enumerate(of):
            self.padded[i, : len(w)] = w


class Segment:
    """Postings over documents laid end to end, a free place after each, so that no phrase spans two.

    ``keys`` are number of the term and position of every posting as one integer each, ascending.
    """

    def __init__(self, starts: np.ndarray, terms: pa.Array, counts: np.ndarray, positions: np.ndarray):
        self.starts, self.terms = starts, terms
        self.lengths = np.diff(starts) - 1
        self.bounds = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        self.positions = positions.astype(np.int64)
        self.keys = (np.repeat(np.arange(len(counts), dtype=np.int64), counts) << 32) + self.positions

    @staticmethod
    def of(docs: list[list[bytes]]) -> Segment:
        lengths = np.array([len(d) for d in docs], np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        coded = pa.array([w for d in docs for w in d], pa.binary()).dictionary_encode()
        codes = coded.indices.to_numpy()
        order = np.argsort(codes, kind="stable")
        where = np.arange(len(codes)) + np.repeat(np.arange(len(docs)), lengths)
        return Segment(starts, coded.dictionary, np.bincount(codes, minlength=len(coded.dictionary)), where[order])

    def pack(self) -> tuple[bytes, bytes, bytes, bytes]:
        """starts, terms, counts and positions; the bytes of positions by their weight, so that they compress."""
        planes = self.positions.astype("<u4").view(np.uint8).reshape(-1, 4).T
        return self.starts.astype("<i8").tobytes(), b" ".join(self.terms.to_pylist()), np.diff(self.bounds).astype("<u4").tobytes(), planes.tobytes()

    @staticmethod
    def unpack(starts: bytes, terms: bytes, counts: bytes, positions: bytes) -> Segment:
        planes = np.ascontiguousarray(np.frombuffer(positions, np.uint8).reshape(4, -1).T)
        return Segment(np.frombuffer(starts, "<i8"), pa.array(terms.split(), pa.binary()), np.frombuffer(counts, "<u4"), planes.view("<u4").reshape(-1))

    def find(self, terms: pa.Array) -> np.ndarray:
        """Numbers in this segment of terms; -1 for those that don't stand in it."""
        return pc.fill_null(pc.index_in(terms, value_set=self.terms), -1).to_numpy().astype(np.int64)

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.bounds[term] : self.bounds[term + 1]]

    def phrases(self, w: Windows) -> tuple[np.ndarray, np.ndarray]:
        """(window number, position of its first word) of every occurrence of every window."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        if not len(w.lengths) or not len(self.positions):
            return none
        found = np.append(self.find(w.terms), -2)  # the last is the pad
        local = found[w.padded]
        alive = np.flatnonzero((local != -1).all(axis=1))  # windows all of whose terms are here
        if not len(alive):
            return none
        local = local[alive]
        counts = np.append(np.diff(self.bounds), [0, np.iinfo(np.int64).max])  # -2, the pad, sorts behind all
        counts[-2], counts[-1] = counts[-1], 0
        order = np.argsort(counts[local], axis=1, kind="stable")
        rarest = np.take_along_axis(local, order[:, :1], 1)[:, 0]
        n = counts[rarest]
        which = np.repeat(np.arange(len(n)), n)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        at = self.positions[self.bounds[rarest][which] + inner] - order[which, 0]
        for k in range(1, w.size):
            if not len(which):
                break
            offset = order[which, k]
            term = local[which, offset]
            asked = (term << 32) + at + offset
            there = self.keys[np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)] == asked
            ok = (term < 0) | (at >= 0) & there
            which, at = which[ok], at[ok]
        return alive[which], at

    def near(self, terms: list[int], within: int) -> list[tuple[int, int]]:
        """The least spans (first, last position) of at most ``within`` words of one document that hold all terms."""
        lists = [self.postings(t) for t in set(terms) if t >= 0]
        if len(lists) < len(set(terms)) or not lists:
            return []
        rare = min(lists, key=len)
        last = np.unique(np.concatenate(lists))
        i = np.searchsorted(rare, last, "right") - 1
        last = last[(i >= 0) & (last - rare[i] < within)]  # a span holds the rarest term
        first = last
        for p in lists:
            i = np.searchsorted(p, last, "right") - 1
            first = np.minimum(first, np.where(i >= 0, p[i], -1))
        same = np.searchsorted(self.starts, first, "right") == np.searchsorted(self.starts, last, "right")
        ok = (first >= 0) & same & (last - first < within)
        out = list(zip(first[ok].tolist(), last[ok].tolist(), strict=True))
        return [s for i, s in enumerate(out) if not any(s[0] <= x <= y <= s[1] and (x, y) != s for x, y in out[max(0, i - 1) : i + 2])]


def search(s: Segment, w: Windows) -> list[tuple[int, list[int], list[int], list[str]]]:
    """For each document: number of words, starts and ends of merged hit spans, and items that occur."""
    which, at = s.phrases(w)
    doc = np.searchsorted(s.starts, at, "right") - 1
    out: list = [(int(n), [], [], []) for n in s.lengths]
    order = np.lexsort((at, doc))
    found: dict[int, set[str]] = {}
    for d, k, a in zip(doc[order].tolist(), which[order].tolist(), at[order].tolist(), strict=True):
        _, firsts, ends, _ = out[d]
        a -= int(s.starts[d])
        b = a + int(w.lengths[k])
        if firsts and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            firsts.append(a)
            ends.append(b)
        found.setdefault(d, set()).update(w.items[k])
    for d, items in found.items():
        out[d][3].extend(sorted(items))
    return out


def _blocks(items: DataFrame, item_col: str, text_col: str, block_words: int):
    """The test set in blocks of bounded size, one at a time on the driver; an item beyond it is a block of its own."""
    rows = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text")).where("text is not null")
    size, block = 0, []
    for r in rows.toLocalIterator():
        n = len(r.text) // 2 + 1
        if block and size + n > block_words:
            yield block
            size, block = 0, []
        size += n
        block.append((r.item, bytes(r.text)))
    yield block


def _segments(texts):
    """(first, end) of the documents of each segment of a batch."""
    at = 0
    while at < len(texts):
        to, room = at, SEGMENT_WORDS * 6
        while to < len(texts) and (room > 0 or to == at):
            room -= len(texts[to].as_py() or b"")
            to += 1
        yield at, to
        at = to


PACKED = ["starts", "terms", "counts", "positions"]


def index(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The stored index of a corpus: segment, docs (structs of the input's columns but the text, in order) and the packed lists."""
    spark = docs.sparkSession
    common.ship(spark)
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col])
    rows = docs.select(rest.alias("doc"), F.col(text_col).cast("binary").alias("text"))
    schema = rows.select(F.lit(0).cast("long").alias("segment"), F.array("doc").alias("docs"), *[F.lit(b"").alias(c) for c in PACKED]).schema

    def run(batches):
        made = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at, to in _segments(batch.column(1)):
                packed = Segment.of([words(t) for t in batch.column(1).slice(at, to - at).to_pylist()]).pack()
                some = pa.ListArray.from_arrays(pa.array([0, to - at], pa.int32()), batch.column(0).slice(at, to - at))
                yield pa.RecordBatch.from_arrays([pa.array([made], pa.int64()), some, *(pa.array([x], pa.binary()) for x in packed)], names=["segment", "docs", *PACKED])
                made += 1

    return common.table(rows.mapInArrow(run, schema), "postings", few=3)


def hits(docs: DataFrame, items: DataFrame, size: int = 10, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_words: int = 250_000, postings: DataFrame | None = None) -> DataFrame:
    """doc (struct of the input's columns but the text), n_words, firsts, ends (spans of hit words), items (ids as strings).

    ``postings``: the index of docs, if it is there already.
    """
    spark = docs.sparkSession
    postings = index(docs, text_col) if postings is None else postings
    doc = postings.select(F.get("docs", F.lit(0)).alias("doc")).schema["doc"]
    out = T.StructType([T.StructField("segment", T.LongType()), T.StructField("nth", T.IntegerType()), doc]).add("n_words", "long").add("firsts", T.ArrayType(T.IntegerType())).add("ends", T.ArrayType(T.IntegerType())).add("items", T.ArrayType(T.StringType()))

    def one(block) -> DataFrame:
        shared = spark.sparkContext.broadcast(Windows(block, size))

        def run(batches):
            w = shared.value
            for batch in batches:
                packed = [c.to_pylist() for c in batch.columns[2:]]
                for i, segment in enumerate(batch.column(0).to_pylist()):
                    found = search(Segment.unpack(*(c[i] for c in packed)), w)
                    cols, n = list(zip(*found, strict=True)), len(found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([segment] * n, pa.int64()), pa.array(range(n), pa.int32()), batch.column(1).slice(i, 1).flatten(), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.list_(pa.int32())), pa.array(cols[2], pa.list_(pa.int32())), pa.array(cols[3], pa.list_(pa.string()))],
                        names=out.names,
                    )

        return postings.select("segment", "docs", *PACKED).mapInArrow(run, out)

    parts = [one(b) for b in _blocks(items, item_col, item_text, block_words)]
    if len(parts) == 1:
        return parts[0].drop("segment", "nth")
    # Several blocks: only documents with hits meet, by their place in the index; all rows come from the first pass.
    more = reduce(DataFrame.unionByName, [p.where("size(firsts) > 0").select("segment", "nth", "firsts", "ends", "items") for p in parts])
    spans = F.flatten(F.transform("all", lambda x: F.arrays_zip(x["firsts"].alias("a"), x["ends"].alias("b"))))
    none = F.array().cast("array<struct<a:int,b:int>>")

    def absorb(spans, x):
        last = F.try_element_at(spans, F.lit(-1))
        longer = F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))
        start = F.slice(spans, F.lit(1), F.greatest(F.size(spans) - 1, F.lit(0)))
        return F.when((F.size(spans) > 0) & (last["b"] >= x["a"]), F.concat(start, F.array(longer))).otherwise(F.concat(spans, F.array(x)))

    merged = F.aggregate(F.sort_array(spans), none, absorb)
    joined = more.groupBy("segment", "nth").agg(F.collect_list(F.struct("firsts", "ends", "items")).alias("all"))
    joined = joined.select("segment", "nth", merged.alias("spans"), F.array_sort(F.array_distinct(F.flatten("all.items"))).alias("items"))
    none = F.array().cast("array<int>")
    return (
        parts[0].select("segment", "nth", "doc", "n_words").join(joined, ["segment", "nth"], "left")
        .select("doc", "n_words", F.coalesce("spans.a", none).alias("firsts"), F.coalesce("spans.b", none).alias("ends"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    )


def nearby(docs: DataFrame, items: DataFrame, within: int, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_words: int = 250_000, postings: DataFrame | None = None) -> DataFrame:
    """doc (struct of the input's columns but the text), item (id as a string), first, last: the least spans of at most
    ``within`` words of a document that hold all distinct words of an item, as positions of their first and last word.

    Items without words match nothing; equal ids give the spans of each of their texts; spans of an item without an id
    have a null ``item``; repeated documents have rows of their own. ``postings`` as for ``hits``.
    """
    spark = docs.sparkSession
    postings = index(docs, text_col) if postings is None else postings
    out = T.StructType([postings.select(F.get("docs", F.lit(0)).alias("doc")).schema["doc"]]).add("item", "string").add("first", "long").add("last", "long")

    def one(block) -> DataFrame:
        terms: dict[bytes, int] = {}
        asked = {(item, frozenset(terms.setdefault(w, len(terms)) for w in words(text))) for item, text in block}
        shared = spark.sparkContext.broadcast((list(terms), [(item, list(t)) for item, t in asked if t]))

        def run(batches):
            terms, asked = pa.array(shared.value[0], pa.binary()), shared.value[1]
            for batch in batches:
                packed = [c.to_pylist() for c in batch.columns[2:]]
                for i in range(batch.num_rows):
                    segment, rows = Segment.unpack(*(c[i] for c in packed)), batch.column(1).slice(i, 1).flatten()
                    here = segment.find(terms)
                    for item, ids in asked:
                        if (here[ids] >= 0).all() and (spans := segment.near(here[ids].tolist(), within)):
                            first, last = np.array(spans, np.int64).T
                            doc = np.searchsorted(segment.starts, first, "right") - 1
                            base = segment.starts[doc]
                            yield pa.RecordBatch.from_arrays([rows.take(pa.array(doc)), pa.array([item] * len(doc), pa.string()), pa.array(first - base), pa.array(last - base)], names=["doc", "item", "first", "last"])

        return postings.select("segment", "docs", *PACKED).mapInArrow(run, out)

    return reduce(DataFrame.unionByName, [one(b) for b in _blocks(items, item_col, item_text, block_words)])


def n_hit(firsts: str = "firsts", ends: str = "ends"):
    """Number of words in the hit spans."""
    return F.aggregate(F.zip_with(ends, firsts, lambda b, a: (b - a).cast("long")), F.lit(0).cast("long"), lambda x, y: x + y)
