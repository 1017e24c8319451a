"""Near-duplicate embeddings by a random-projection tree forest with spill overlap.

Trees: at each level a tree projects vectors on one random direction and splits every node at
the median of a sample (at most ``sample`` vectors, those with the least hash; below its reach
at 0). Their depth follows from the largest label, so that leaves stay small however many vectors there are. A vector whose projection is within ``spill`` of the split goes to both sides, so close
vectors are rarely parted, and the other trees catch those that were: a projection of a distance d
is d / sqrt(dimension) wide, so the spill is half of that at the threshold, and as more levels part
more pairs, there are more trees the deeper they are. Every vector is indexed. A node that spills nearly everything stays a leaf.

Leaves: all vectors of one leaf and one label are compared in double precision. What is shuffled
are not leaves but cells, nodes a few levels above them: a vector goes once to each cell it falls in, and the
task of a cell grows the rest of the tree. Cells over ``cell_rows`` are dealt out leaf by leaf, and of these leaves over
``room`` vectors as tiles, each pair of chunks one tile, so no task holds more than a cell and no pair is left out.
Two vectors that share several leaves are counted in the first of them. Only vectors with a link have to know their other
leaves for that; a task finds them anew, which gives the same leaves everywhere as projections are exact
(see ``project``). A cell or tile returns sums and stars of its links, never its pairs.

Equal vectors of a label are one member with a number of copies. Defined cases: vectors that are
null, empty, zero or hold null or non-finite values, and null labels, link with nothing; vectors
of unlike lengths don't link; repeated rows are copies; rows with a null id are linked and counted like
any other but name no component (one without any id has none); long vectors are compared whole; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orweave.llm import common
from orweave.llm.components import components

SEED = 7
GRID = float(1 << 26)
#: Rows and bytes of vectors (as doubles) of a cell.
CELL_ROWS, CELL_BYTES = 8192, 16 << 20
#: Pairs that are looked at together, about.
PAIRS = 1 << 20


@lru_cache(64)
def directions(dim: int, trees: int, depth: int) -> np.ndarray:
    """Unit directions: trees x dim x depth; that of a tree's level is the same however many trees and levels there are."""
    draw = lambda t, level: np.random.default_rng([SEED, dim, t, level]).standard_normal(dim)
    each = [[draw(t, level) for level in range(max(1, depth))] for t in range(trees)]
    return np.stack([np.stack([r / np.linalg.norm(r) for r in levels], axis=1) for levels in each])


def project(x: np.ndarray, r: np.ndarray) -> np.ndarray:
    """x @ r for unit vectors, rounded to multiples of 2^-26: all sums are exact then, the same in batches of any shape."""
    return np.rint(x * GRID) @ np.rint(r * GRID) / GRID**2


def shape(most: int, leaf: int) -> tuple[int, int]:
    """(trees, depth) for that many vectors of a label."""
    depth = max(0, math.ceil(math.log(max(1, most) / leaf) / math.log(1 / 0.6)))
    return 3 + math.ceil(0.3 * depth), depth


def spill_of(threshold: float, dim: int) -> float:
    """Half of the expected size of the projection of the distance at the threshold."""
    return 0.5 * math.sqrt((2 - 2 * threshold) / max(1, dim))


def units(raw: list[bytes], dtype: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype).reshape(len(raw), -1).astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit(sample: np.ndarray, dim: int, trees: int, depth: int, spill: float, least: int = 16) -> np.ndarray:
    """Split points of the first levels, trees x nodes in heap order (root 1); NaN where a node is a leaf.

    As many levels as the sample can fit; what lies deeper, and a node of less than ``least`` of the sample, splits at 0.
    """
    levels = min(depth, max(1, len(sample) // least).bit_length())
    splits = np.zeros((trees, 1 << levels))
    for t in range(trees):
        p = sample @ directions(dim, trees, depth)[t] if len(sample) else np.zeros((0, max(1, depth)))
        nodes = {1: np.arange(len(sample))}
        for level in range(levels):
            below = {}
            for node, rows in nodes.items():
                if len(rows) < least:
                    continue
                x = p[rows, level]
                cut = float(np.median(x))
                left, right = rows[x <= cut + spill], rows[x >= cut - spill]
                if min(len(left), len(right)) > 0.9 * len(rows):
                    splits[t, node] = np.nan
                    continue
                splits[t, node] = cut
                below[2 * node], below[2 * node + 1] = left, right
            nodes = below
    return splits


def leaves(x: np.ndarray, splits: np.ndarray, depth: int | np.ndarray, spill: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf code) of every leaf of every tree that a vector falls in, by row, codes ascending. ``depth``: of all or of each."""
    trees, depths = len(splits), np.broadcast_to(np.asarray(depth), len(x))
    r = directions(x.shape[1], trees, int(depths.max(initial=0)))
    found = [descend(project(x, r[t]), splits[t], depths, spill) for t in range(trees)]
    row = np.concatenate([rows for rows, _ in found])
    code = np.concatenate([(np.int64(t) << 48) + nodes for t, (_, nodes) in enumerate(found)])
    order = np.lexsort((code, row))
    return row[order], code[order]


def descend(p: np.ndarray, cuts: np.ndarray, depths: np.ndarray, spill: float, root: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of the leaves of one tree below ``root``, where all rows are; ``p``: projections by level."""
    rows_out, nodes_out = [], []
    row, node = np.arange(len(p)), np.full(len(p), root, np.int64)
    for level in range(root.bit_length() - 1, int(depths.max(initial=0)) + 1):
        fitted = node < len(cuts)
        cut = np.where(fitted, cuts[np.where(fitted, node, 0)], 0.0)
        ended = np.isnan(cut) | (level == depths[row])
        rows_out.append(row[ended])
        nodes_out.append(node[ended])
        row, node, cut = row[~ended], node[~ended], cut[~ended]
        if not len(row):
            break
        at = p[row, level]
        left, right = at <= cut + spill, at >= cut - spill
        row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
    return np.concatenate(rows_out), np.concatenate(nodes_out)


def linked_pairs(x: np.ndarray, groups, threshold: float, room: int):
    """(a, b, node) of the pairs of rows at the threshold; ``groups``: (node, rows, others), others None: rows among themselves."""
    for node, rows, others in groups:
        for i in range(0, len(rows), room):
            one = rows[i : i + room]
            for j in range(i if others is None else 0, len(rows if others is None else others), room):
                two = (rows if others is None else others)[j : j + room]
                a, b = np.divmod(np.flatnonzero(x[one] @ x[two].T >= threshold), len(two))
                if others is None and i == j:
                    a, b = a[a < b], b[a < b]
                if len(a):
                    yield one[a], two[b], np.full(len(a), node, np.int64)


def first_met(x: np.ndarray, a: np.ndarray, b: np.ndarray, node: np.ndarray, t: int, splits: np.ndarray, depth: int, spill: float) -> np.ndarray:
    """Numbers of the pairs (a, b) that share no leaf before ``node`` of tree t."""
    r = directions(x.shape[1], len(splits), depth)
    left = np.arange(len(a))
    for s in range(t + 1):
        if not len(left):
            break
        linked = np.zeros(len(x), bool)
        linked[a[left]] = linked[b[left]] = True
        rows, place = np.flatnonzero(linked), np.cumsum(linked) - 1
        row, leaf = descend(project(x[rows], r[s]), splits[s], np.full(len(rows), depth), spill)
        names, column = np.unique(leaf, return_inverse=True)
        words = (len(names) + 63) // 64
        sets = np.zeros(words * len(rows), np.uint64)  # each row's leaves as bits
        np.bitwise_or.at(sets, (column >> 6) * len(rows) + row, np.uint64(1) << (column & 63).astype(np.uint64))
        one, two, first = place[a[left]], place[b[left]], []
        for w, some in enumerate(sets.reshape(words, -1)):
            both = some[one] & some[two]
            met = both != 0
            if s == t and met.any():  # the first leaf they share in this tree
                low = both[met] & (~both[met] + np.uint64(1))
                first.append(left[met][names[64 * w + np.frexp(low.astype(np.float64))[1] - 1] == node[left[met]]])
            if met.any():
                left, one, two = left[~met], one[~met], two[~met]
        if s == t:
            left = np.concatenate([left[:0], *first])
    return left


def join_up(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that each row is linked with, after the pairs (a, b) are added to what ``root`` says."""
    while True:
        one, two = root[a], root[b]
        apart = one != two
        if not apart.any():
            return root
        a, b, one, two = a[apart], b[apart], one[apart], two[apart]
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while (root != root[root]).any():
            root = root[root]


def compared(x: np.ndarray, copies: np.ndarray, groups, t: int, splits: np.ndarray, depth: int, spill: float, threshold: float, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(linked copies of each row, least row it is linked with) by the pairs that meet first in these leaves of tree t."""
    sums, root, held = np.zeros(len(x), np.int64), np.arange(len(x)), []

    def settle():
        nonlocal root
        a, b, node = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        first = first_met(x, a, b, node, t, splits, depth, spill)
        a, b = a[first], b[first]
        np.add.at(sums, a, copies[b])
        np.add.at(sums, b, copies[a])
        root = join_up(root, a, b)

    n = 0
    for pairs in linked_pairs(x, groups, threshold, room):
        held.append(pairs)
        n += len(pairs[0])
        if n >= PAIRS:
            settle()
            n = 0
    if held:
        settle()
    return sums, root


def by_key(*keys: np.ndarray):
    """(order, bounds) of the runs of equal keys after sorting by them."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    return order, [0, *np.flatnonzero(new).tolist(), len(order)] if len(order) else [0]


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, trees: int | None = None, leaf: int = 128, room: int = 512, sample: int = 32_768, spill: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row. ``trees`` and ``spill``: by default as ``shape`` and ``spill_of`` say."""
    spark = vectors.sparkSession
    common.ship(spark)
    wide = lambda dim: spill_of(threshold, dim) if spill is None else spill
    single = isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType)
    dtype, kind, width = ("<f4", "float", 4) if single else ("<f8", "double", 8)
    v = F.col(vector_col).cast(f"array<{kind}>")
    usable = F.col(label_col).isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    usable = F.coalesce(usable, F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"), usable.alias("usable"))
    rows = rows.select("*", F.when(F.col("usable"), F.xxhash64("label", "v")).alias("h1"), F.when(F.col("usable"), F.xxhash64(F.lit(1), "v", "label")).alias("h2"))

    def pack(batches):
        for batch in batches:
            column = batch.column(4)
            off, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(dtype).tobytes()
            raw = [flat[a * width : b * width] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(raw, pa.binary())], names=["h1", "h2", "rep", "copies", "raw"])

    # Equal vectors of a label are one member, named by their 128-bit hash: ids name components alone.
    groups = rows.where("usable").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v"), F.first("label").alias("label"))
    groups = groups.select("*", F.unhex(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in ("h1", "h2")])).alias("rep"), F.xxhash64("label", F.size("v")).alias("space"))
    members = common.table(groups.select("h1", "space", "rep", "copies", "v").mapInArrow(pack, "h1 long, h2 long, rep binary, copies long, raw binary").withColumnRenamed("h2", "space"), "vectors", few=3)

    # Each label's trees are as deep as its vectors call for; they share their splits.
    sizes = common.table(members.groupBy("space").agg(F.count("*").alias("of"), F.max(F.octet_length("raw")).alias("bytes")), "label-sizes", few=1)
    most, widest = (x or 0 for x in sizes.agg(F.max("of"), F.max("bytes")).first())
    by_depth, depth = shape(most, leaf)
    trees = trees or by_depth
    members = members.join(sizes, "space").select("h1", "space", "rep", "copies", "raw", "of")
    chosen: dict[int, list[bytes]] = {}
    for raw in members.orderBy("h1").limit(sample).select("raw").toArrow()["raw"].to_pylist():
        chosen.setdefault(len(raw) // width, []).append(raw)
    splits = {dim: fit(units(raw, dtype), dim, trees, depth, wide(dim)) for dim, raw in chosen.items()}
    plain = fit(np.zeros((0, 1)), 1, trees, depth, wide(1))
    shared = spark.sparkContext.broadcast((splits, plain))

    # Cells lie so far above the leaves that one of them should have a quarter of the rows that it may.
    cell_rows = lambda dim: max(room, min(CELL_ROWS, CELL_BYTES // (8 * dim)))
    above = lambda dim: max(0, int(math.log(max(1, cell_rows(dim) / (4 * leaf))) / math.log(1 / 0.6)))
    column = lambda batch, name: batch.column(name).to_numpy(zero_copy_only=False)

    def parts(batches):
        """Rows of one length, with their vectors and the cells they fall in."""
        known, other = shared.value
        for batch in batches:
            sizes = pc.binary_length(batch.column("raw")).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                some, dim = np.flatnonzero(sizes == size), size // width
                for at in range(0, len(some), 1024):
                    part = batch.take(pa.array(some[at : at + 1024]))
                    deep = {n: shape(n, leaf)[1] for n in set(part.column("of").to_pylist())}
                    deep = np.array([deep[n] for n in part.column("of").to_pylist()])
                    row, code = leaves(units(part.column("raw").to_pylist(), dtype), known.get(dim, other), np.maximum(0, deep - above(dim)), wide(dim))
                    real = (deep[row] > 0) | (code >> 48 == 0)  # all trees of a label that is one leaf are the same
                    yield part, dim, deep, row[real], code[real]

    def count(batches):
        for part, dim, _, row, code in parts(batches):
            space = column(part, "space")[row]
            order, ends = by_key(space, code)
            at = order[ends[:-1]]
            yield pa.RecordBatch.from_arrays([pa.array(space[at]), pa.array(code[at]), pa.array(np.diff(ends), pa.int64()), pa.array(np.full(len(at), cell_rows(dim)))], names=["space", "code", "n", "most"])

    def index(batches):
        for part, _, deep, row, code in parts(batches):
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in ("space", "rep", "copies", "raw")), pa.array(code), pa.array(deep[row], pa.int32())], names=["space", "rep", "copies", "raw", "code", "deep"])

    def deepen(batches):
        known, other = shared.value
        for batch in batches:
            order, ends = by_key(column(batch, "space"), column(batch, "code"))
            for i, j in zip(ends, ends[1:], strict=False):
                part = batch.take(pa.array(order[i:j]))
                x, code, deep = units(part.column("raw").to_pylist(), dtype), part.column("code")[0].as_py(), column(part, "deep")
                t, splits = code >> 48, known.get(x.shape[1], other)
                row, node = descend(project(x, directions(x.shape[1], len(splits), int(deep[0]))[t]), splits[t], deep, wide(x.shape[1]), code & (1 << 48) - 1)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in ("space", "rep", "copies", "raw")), pa.array((np.int64(t) << 48) + node), pa.array(deep[row], pa.int32())], names=["space", "rep", "copies", "raw", "code", "deep"])

    kind_of_entry = "space long, rep binary, copies long, raw binary, code long, deep int"
    entries = members.mapInArrow(index, kind_of_entry)
    flat = [F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(False).alias("second"), F.lit(False).alias("leaf")]
    tiles = entries.select("*", *flat)
    if most and most > cell_rows(widest // width):
        full = common.table(members.mapInArrow(count, "space long, code long, n long, most long").groupBy("space", "code").agg(F.sum("n").alias("n"), F.max("most").alias("most")).where("n > most").select("space", "code"), "crowded-cells", few=1)
        if not full.isEmpty():
            inner = entries.join(full, ["space", "code"], "left_semi").select(*entries.columns).mapInArrow(deepen, kind_of_entry)
            crowded = common.table(inner.groupBy("space", "code").count().where(F.col("count") > room), "crowded-leaves", few=1)
            chunks = F.ceil(F.col("count") / room).cast("int")
            mine = F.coalesce(F.pmod(F.xxhash64("rep"), chunks.cast("long")).cast("int"), F.lit(0))
            dealt = inner.join(crowded, ["space", "code"], "left").withColumn("other", F.explode(F.when(F.col("count").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), chunks - 1))))
            dealt = dealt.select(*entries.columns, F.least(mine, "other").alias("i"), F.greatest(mine, "other").alias("j"), (mine > F.col("other")).alias("second"), F.lit(True).alias("leaf"))
            tiles = entries.join(full, ["space", "code"], "left_anti").select(*entries.columns, *flat).unionByName(dealt)

    def compare(batches):
        known, other = shared.value
        out, now, held = [], None, []

        def close():
            rows = pa.Table.from_batches(held).combine_chunks()
            if rows.num_rows < 2:
                return
            x, copies, second = units(rows.column("raw").to_pylist(), dtype), column(rows, "copies"), column(rows, "second")
            _, code, i, j = now
            t, node, depth, splits, spill_here = code >> 48, code & (1 << 48) - 1, rows.column("deep")[0].as_py(), known.get(x.shape[1], other), wide(x.shape[1])
            if i != j:
                groups = [(node, np.flatnonzero(~second), np.flatnonzero(second))]
            elif rows.column("leaf")[0].as_py():
                groups = [(node, np.arange(len(x)), None)]
            else:
                row, found = descend(project(x, directions(x.shape[1], len(splits), depth)[t]), splits[t], np.full(len(x), depth), spill_here, node)
                order, ends = by_key(found)
                groups = ((int(found[order[a]]), row[order[a:b]], None) for a, b in zip(ends, ends[1:], strict=False) if b - a > 1)
            sums, root = compared(x, copies, groups, t, splits, depth, spill_here, threshold, room)
            some, hung = np.flatnonzero(sums), np.flatnonzero(root != np.arange(len(x)))
            if len(some):
                reps = rows.column("rep").combine_chunks()
                a = pa.concat_arrays([reps.take(pa.array(some)), reps.take(pa.array(hung))])
                b = pa.concat_arrays([pa.nulls(len(some), pa.binary()), reps.take(pa.array(root[hung]))])
                out.append(pa.RecordBatch.from_arrays([a, b, pa.array(np.concatenate([sums[some], np.zeros(len(hung), np.int64)]))], names=["a", "b", "n"]))

        for batch in batches:
            keys = [column(batch, c) for c in ("space", "code", "i", "j")]
            new = np.zeros(max(0, batch.num_rows - 1), bool)
            for k in keys:
                new |= k[1:] != k[:-1]
            ends = [0, *(np.flatnonzero(new) + 1).tolist(), batch.num_rows]
            for a, b in zip(ends, ends[1:], strict=False):
                if a == b:
                    continue
                key = tuple(int(k[a]) for k in keys)
                if key != now:
                    if held:
                        close()
                    now, held = key, []
                held.append(batch.slice(a, b - a))
            if sum(o.num_rows for o in out) > 10_000:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out.clear()
        if held:
            close()
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    tiles = tiles.repartition("space", "code", "i", "j").sortWithinPartitions("space", "code", "i", "j")
    found = common.table(tiles.mapInArrow(compare, "a binary, b binary, n long"), "links", few=3)
    linked = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    joined = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "rep")
    classes = reduce(lambda x, y: x.join(y, "rep", "left"), [groups.select("h1", "h2", "rep", "least", "copies"), linked, joined])
    classes = common.table(classes.select("h1", "h2", "least", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("grp")), "classes", few=1)
    names = common.table(classes.groupBy("grp").agg(F.min("least").alias("component")), "names", few=1)  # a table: a large group's rows can be split
    classes = classes.join(names, "grp").select("h1", "h2", "n", "component")
    met = rows.select("vec_id", "h1", "h2").join(classes, ["h1", "h2"], "left")
    component = F.coalesce("component", "vec_id")
    return met.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
