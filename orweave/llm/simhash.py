"""SimHash near-dedup with sharded BK-trees.

Fingerprints: the words of a text (runs of anything but ASCII white space, A-Z lower-cased)
form shingles, repeats included; a fingerprint bit is 1 if it is set in over half of the
shingles' hashes. 64 bits are XXH64 itself (seed 42); wider fingerprints mix that hash further.

Linking: equal fingerprints meet in an aggregation, so copies cost one row. Every fingerprint
enters one shard for each block of its bits (the value of that block is the shard's key). A
shard builds a BK-tree, whose children are keyed by their integer Hamming distance to the
parent, and each member follows only edges within the radius. With disjoint blocks, more of
them than the radius, any two fingerprints within the radius agree on a block: no link is lost.
Shards that hold more than ``room`` members are dealt out as tiles, each pair of chunks a tree
and its queries, so no task holds more than two chunks. A tile reports a spanning forest of its
links, never its pairs, and the components of all forests are the groups.

``groups`` with ``bands`` links by MinHash besides, for Jaccard similarity of shingle sets: a band is the hash of ``ROWS``
minima, texts that agree on a band are linked, and fingerprints then count every distinct shingle once. A pair of
similarity s agrees on none of b bands with chance (1 - s**ROWS)**b, whatever the length of its texts.

``verified`` makes such groups exact: members of a group with a wide radius are compared by the
Jaccard similarity of their shingle sets, again by tiles that report forests.

Defined cases: a null text and one without words have the zero fingerprint, linked like any
other; texts shorter than a shingle are one shingle; very long texts are hashed whole, some thousand
shingles at a time; repeated rows and ids share a component; rows with a null id link others and are
grouped like any other, but never name a group (a group without ids has a null name); ties are broken
by the least fingerprint or id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orweave.llm import common
from orweave.llm.components import components

SEED = 42
#: Minima in each MinHash band.
ROWS = 5


def _mixed(h: np.ndarray, round_: int) -> np.ndarray:
    """An independent 64-bit hash of h: a multiply-xorshift finaliser over a shifted start."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * round_) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: bytes | None, k: int) -> np.ndarray:
    """XXH64 of each shingle of k words, in order, repeats included."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    return np.array([digest(joined[a:b], SEED) for a, b in zip((ends - lengths).tolist(), ends[k - 1 :].tolist(), strict=False)], np.uint64)


def fingerprint(text: bytes | None, k: int, bits: int = 64) -> bytes:
    """The fingerprint, big-endian."""
    return fingerprint_of(shingle_hashes(text, k), bits)


def fingerprint_of(hashes: np.ndarray, bits: int) -> bytes:
    ones = np.zeros(bits, np.int64)
    for at in range(0, len(hashes), 16384):
        h = hashes[at : at + 16384]
        wide = np.stack([h] + [_mixed(h, i) for i in range(1, bits // 64)], axis=1).astype(">u8")
        ones += np.unpackbits(wide.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def band_keys(shingles: np.ndarray, bands: int) -> list[int]:
    """The MinHash bands of a shingle set; none of an empty set."""
    if not len(shingles):
        return []
    rng = np.random.default_rng(SEED)
    factors, shifts = rng.integers(0, 2**63, (2, bands * ROWS, 1)).astype(np.uint64)
    least = np.full(bands * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        # Mixed first, and the high bits last, so that minima of different rows are independent.
        h = _mixed(shingles[at : at + 4096], 1) * (2 * factors + np.uint64(1)) + shifts
        least = np.minimum(least, (h ^ (h >> np.uint64(32))).min(axis=1))
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for row in least.reshape(bands, ROWS).T:
        out = _mixed(out ^ row, 2)
    return out.view(np.int64).tolist()


def row_key(id_col: str, text_col: str) -> list:
    return [F.xxhash64(id_col, text_col).alias("k1"), F.xxhash64(F.lit(1), text_col, id_col).alias("k2")]


def fingerprints(docs: DataFrame, k: int, bits: int = 64, id_col: str = "doc_id", text_col: str = "text", bands: int = 0) -> DataFrame:
    """doc_id, k1 and k2 (a 128-bit hash of id and text), fp (binary) of every row; with ``bands`` its band keys too."""
    common.ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                if bands:
                    sets = [np.unique(shingle_hashes(t.as_py(), k)) for t in some.column(3)]
                    fps, more = [fingerprint_of(x, bits) for x in sets], [pa.array([band_keys(x, bands) for x in sets], pa.list_(pa.int64()))]
                else:
                    fps, more = [fingerprint(t.as_py(), k, bits) for t in some.column(3)], []
                yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(fps, pa.binary()), *more], names=["doc_id", "k1", "k2", "fp", *["bands"] * len(more)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_key(id_col, text_col), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, k1 long, k2 long, fp binary" + (", bands array<long>" if bands else ""))


class BKTree:
    """Members under a root; a child's key is its distance to its parent."""

    def __init__(self):
        self.root: tuple[int, int, dict] | None = None

    def add(self, value: int, name: int) -> None:
        node = (value, name, {})
        if self.root is None:
            self.root = node
            return
        at = self.root
        while True:
            d = (at[0] ^ value).bit_count()
            if (child := at[2].get(d)) is None:
                at[2][d] = node
                return
            at = child

    def within(self, value: int, radius: int):
        """Names of the members within the radius; only edges within it are followed."""
        stack = [self.root] if self.root else []
        while stack:
            v, name, children = stack.pop()
            d = (v ^ value).bit_count()
            if d <= radius:
                yield name
            if children:
                low, high = d - radius, d + radius
                if len(children) <= 2 * radius:
                    stack += [c for e, c in children.items() if low <= e <= high]
                else:
                    stack += [children[e] for e in range(max(0, low), high + 1) if e in children]


def tile_links(tree: list[tuple[int, int]], asked: list[tuple[int, int]] | None, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``tree``, or between ``tree`` and ``asked``; members are (fp, name)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    links, bk = [], BKTree()
    if asked is not None:
        for value, name in tree:
            bk.add(value, name)
    for value, name in tree if asked is None else asked:
        for other in bk.within(value, radius):
            a, b = find(name), find(other)
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((name, other))
        if asked is None:
            bk.add(value, name)
    return links


def blocks(bits: int, radius: int, tables: int | None, block_bits: int) -> list[list[int]]:
    """Bit positions of each block. None: disjoint blocks, more than the radius, so that no link can be lost.

    Else ``tables`` blocks of ``block_bits``, cut from seeded shuffles of the bits.
    """
    if tables is None:
        return [x.tolist() for x in np.array_split(np.arange(bits), radius + 1)]
    rng, out = np.random.default_rng(SEED), []
    while len(out) < tables:
        order = rng.permutation(bits)
        out += [sorted(order[i : i + block_bits].tolist()) for i in range(0, bits - block_bits + 1, block_bits)]
    return out[:tables]


def links(members: DataFrame, bits: int, radius: int, tables: int | None = None, block_bits: int = 16, room: int = 1024) -> DataFrame:
    """(a, b): a spanning forest, for each tile, of the links among members (rep, their name, a long or binary; fp binary, distinct)."""
    spark = members.sparkSession
    common.ship(spark)
    kind = members.schema["rep"].dataType.simpleString()
    arrow = pa.int64() if kind == "bigint" else pa.binary()
    positions = blocks(bits, radius, tables, block_bits)

    def keys(batches):
        picks = np.array([p[:64] + [p[-1]] * (64 - len(p)) for p in positions])  # padded to 64 columns; the pad is masked out
        used = np.array([[1] * len(p[:64]) + [0] * (64 - len(p)) for p in positions], np.uint8)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                fps = np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint8).reshape(-1, bits // 8)
                flat = np.unpackbits(fps, axis=1)
                for t in range(len(positions)):
                    # Blocks of more than 64 bits are keyed by their first 64: a coarser shard holds no fewer links.
                    key = np.ascontiguousarray(np.packbits(flat[:, picks[t]] * used[t], axis=1)).view(">i8").reshape(-1).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), t, np.int32)), pa.array(key), some.column(0), some.column(1)], names=["t", "key", "rep", "fp"])

    entries = members.select("rep", "fp").mapInArrow(keys, f"t int, key long, rep {kind}, fp binary")
    hot = common.table(entries.groupBy("t", "key").count().where(F.col("count") > room), "hot-shards", few=1)
    k = F.ceil(F.col("count") / room).cast("int")
    mine = F.pmod(F.xxhash64("fp"), k.cast("long")).cast("int")
    dealt = entries.join(hot, ["t", "key"], "left").withColumn("other", F.explode(F.when(F.col("count").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), k - 1))))
    mine = F.coalesce(mine, F.lit(0))
    dealt = dealt.select("t", "key", F.least(mine, "other").alias("i"), F.greatest(mine, "other").alias("j"), (mine > F.col("other")).alias("asks"), "rep", "fp")

    def solve(batches):
        now, tree, asked = None, [], []
        found: list[tuple[int, int]] = []

        def close():
            if now is not None and len(tree) + len(asked) > 1:
                found.extend(tile_links(tree, None if now[2] == now[3] else asked, radius))

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], arrow), pa.array([x[1] for x in found], arrow)], names=["a", "b"])
            found.clear()
            return batch

        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            for t, key, i, j, asks, rep, fp in zip(*cols, strict=True):
                if (t, key, i, j) != now:
                    close()
                    now, tree, asked = (t, key, i, j), [], []
                (asked if asks else tree).append((int.from_bytes(fp), rep))
            if len(found) > 10_000:
                yield out()
        close()
        yield out()

    tiles = dealt.repartition("t", "key", "i", "j").sortWithinPartitions("t", "key", "i", "j")
    return tiles.mapInArrow(solve, f"a {kind}, b {kind}").distinct()


def radius_of(similarity: float, bits: int) -> int:
    """The Hamming distance that shingle sets of this Jaccard similarity are expected at."""
    return round(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def groups(docs: DataFrame, k: int, bits: int, radius: int, tables: int | None = None, block_bits: int = 16, id_col: str = "doc_id", text_col: str = "text", bands: int = 0) -> DataFrame:
    """doc_id, k1, k2, fp, grp (the least fingerprint of the group), component_id (its smallest id) of every row.

    Fingerprints are linked, whatever the ids of their rows: a row without an id links others as well.
    """
    rows = common.table(fingerprints(docs, k, bits, id_col, text_col, bands), "fingerprints", few=3)
    node = F.conv(F.hex("fp"), 16, -10).cast("long") if bits == 64 else F.col("fp")
    members = common.table(rows.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("rep", node), "members", few=1)
    edges = links(members, bits, radius, tables, block_bits)
    if bands:
        # Equal fingerprints are one member, whatever their sets: the bands of all its texts count.
        banded = common.table(rows.select(node.alias("rep"), "bands").distinct().select("rep", F.explode("bands").alias("band")), "bands", few=3)
        stars = banded.groupBy("band").agg(F.min("rep").alias("b"), F.max("rep").alias("most")).where("b != most").select("band", "b")
        stars = common.table(stars, "shared-bands", few=1)
        edges = edges.unionByName(banded.join(stars, "band").where("rep != b").select(F.col("rep").alias("a"), "b").distinct())
    found = components(edges)
    grouped = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "least", F.coalesce("component", "rep").alias("grp"))
    grouped = common.table(grouped, "grouped", few=1)
    ids = common.table(grouped.groupBy("grp").agg(F.min("least").alias("component_id")), "names", few=1)  # a table: a large group's rows can be split
    named = common.table(grouped.join(ids, "grp").select("fp", "grp", "component_id"), "named", few=1)
    return rows.join(named, "fp").select("doc_id", "k1", "k2", "fp", "grp", "component_id")


def verify_tile(tree: list[tuple], asked: list[tuple] | None, radius: int, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of all members whose sets are similar; members are (name, fp, sorted set).

    Fingerprints only order the work: pairs within the radius are compared first, and what these leave unconnected by
    the numbers of shared shingles, from postings of the tile.
    """
    every = tree + (asked or [])
    parent = list(range(len(every)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    bits = np.frombuffer(b"".join(m[1] for m in every), np.uint64).reshape(len(every), -1)
    sizes = np.array([len(m[2]) for m in every])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    links, index = [], None

    def link(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            links.append((every[i][0], every[j][0]))

    def postings():
        _, ids = np.unique(np.concatenate([m[2] for m in every]), return_inverse=True)
        order = np.argsort(ids, kind="stable")
        return ids, np.repeat(np.arange(len(every)), sizes)[order], np.concatenate([[0], np.cumsum(np.bincount(ids))])

    for i in range(1 if asked is None else len(tree), len(every)):
        upto = i if asked is None else len(tree)
        fits = np.minimum(sizes[:upto], sizes[i]) >= similarity * np.maximum(sizes[:upto], sizes[i])
        far = np.bitwise_count(bits[:upto] ^ bits[i]).sum(axis=1)
        near = np.flatnonzero(fits & (far <= radius))
        for j in near[np.argsort(far[near], kind="stable")].tolist():
            if find(i) != find(j):
                both = len(np.intersect1d(every[i][2], every[j][2], assume_unique=True))
                if both >= similarity * (sizes[i] + sizes[j] - both):
                    link(i, j)
        rest = [j for j in np.flatnonzero(fits & (far > radius)).tolist() if find(i) != find(j)]
        if rest:
            index = index or postings()
            mine = index[0][starts[i] : starts[i + 1]]
            n = index[2][mine + 1] - index[2][mine]
            at = np.repeat(index[2][mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.bincount(index[1][at], minlength=len(every))[rest]
            for j in np.array(rest)[both >= similarity * (sizes[i] + sizes[rest] - both)].tolist():
                link(i, j)
    return links


def verified(docs: DataFrame, grouped: DataFrame, k: int, radius: int, similarity: float, id_col: str = "doc_id", text_col: str = "text", room: int = 512) -> DataFrame:
    """``groups`` of a wide radius made exact: doc_id, k1, k2, fp, grp, component_id by links of at least this similarity.

    Only documents in groups of several texts are read again, equal texts once.
    """
    spark = docs.sparkSession
    crowds = grouped.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select("grp")
    some = common.table(grouped.join(crowds, "grp").select("k1", "k2", "fp", F.xxhash64("grp").alias("g")), "candidates", few=1)
    keyed = docs.select(*row_key(id_col, text_col), F.col(text_col).cast("binary").alias("text"))
    rows = keyed.join(some.dropDuplicates(["k1", "k2"]), ["k1", "k2"]).select("g", "k1", "k2", F.xxhash64("text").alias("t"), "fp", "text")

    def cut(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [np.unique(shingle_hashes(t.as_py(), k)).tobytes() for t in part.column(5)]
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(sets, pa.binary())], names=["g", "k1", "k2", "t", "fp", "shingles"])

    sets = common.table(rows.mapInArrow(cut, "g long, k1 long, k2 long, t long, fp binary, shingles binary"), "shingle-sets", few=3)
    members = sets.dropDuplicates(["g", "t"])
    crowded = members.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / room).cast("int")
    mine = F.pmod(F.xxhash64("t"), chunks.cast("long")).cast("int")
    dealt = members.join(crowded, "g").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    dealt = dealt.select("g", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).alias("asks"), "t", "fp", "shingles")

    def solve(batches):
        now, tree, asked = None, [], []

        def close():
            found = tile_found(now, tree, asked)
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])

        def tile_found(key, tree, asked):
            if key is None or len(tree) + len(asked) < 2 or key[1] != key[2] and not (tree and asked):
                return []
            return verify_tile(tree, None if key[1] == key[2] else asked, radius, similarity)

        for batch in batches:
            for g, i, j, asks, t, fp, shingles in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (g, i, j) != now:
                    yield close()
                    now, tree, asked = (g, i, j), [], []
                (asked if asks else tree).append((t, fp, np.frombuffer(shingles, np.uint64)))
        yield close()

    tiles = dealt.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")
    found = components(tiles.mapInArrow(solve, "a long, b long")).withColumnRenamed("node", "t")
    # Texts that nothing is similar to are groups of their own, and so are those that no candidate group holds.
    texts = sets.select("k1", "k2", F.col("t").alias("own")).join(found.withColumnRenamed("t", "own"), "own", "left").select("k1", "k2", F.coalesce("component", "own").alias("c"))
    named = grouped.join(texts.distinct(), ["k1", "k2"], "left").select("doc_id", "k1", "k2", "fp", F.coalesce(F.concat(F.lit("c"), "c"), F.concat(F.lit("f"), F.hex("fp"))).alias("grp"))
    named = common.table(named, "verified", few=3)
    ids = common.table(named.groupBy("grp").agg(F.min("doc_id").alias("component_id")), "names", few=1)
    return named.join(ids, "grp").select("doc_id", "k1", "k2", "fp", "grp", "component_id")


def representatives(docs: DataFrame, grouped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs for each group of ``verified``: that with the smallest id, of equal rows any one."""
    firsts = grouped.groupBy("grp").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2")).alias("first")).select("first.k1", "first.k2")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *row_key(id_col, text_col))
    return keyed.join(firsts, ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"]).select("doc.*")
