import math

import numpy as np
import pyarrow as pa
import pytest
from orweave.llm import common, queries, rp_forest


def brute(rows, threshold=0.93):
    """vec_id -> (links, component)."""
    ok = [(i, np.array(v, float), lab) for i, v, lab in rows if v and lab is not None and all(x is not None for x in v) and np.isfinite(np.array(v, float)).all() and any(v)]
    u = {i: v / np.linalg.norm(v) for i, v, _ in ok}
    lab = {i: (x, len(v)) for i, v, x in ok}
    near = {i: [] for i, *_ in rows}
    for a in u:
        for b in u:
            if a != b and lab[a] == lab[b] and u[a] @ u[b] >= threshold:
                near[a].append(b)
    out = {}
    for i in near:
        seen, stack = {i}, [i]
        while stack:
            for y in near[stack.pop()]:
                if y not in seen:
                    seen.add(y)
                    stack.append(y)
        out[i] = len(near[i]), min(seen)
    return out


def clouds(n=600, dim=24):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        base = rng.standard_normal(dim)
        rows.append((3 * i, base.tolist(), int(rng.integers(3)) if i % 50 else None))
        if i % 4 == 0:
            rows.append((3 * i + 1, (base + rng.standard_normal(dim) * rng.choice([0, 0.1, 0.25])).tolist(), rows[-1][2]))
    hub = rng.standard_normal(dim)
    rows += [(10_000 + i, (hub + 0.1 * rng.standard_normal(dim)).tolist(), 1) for i in range(120)]
    return rows


@pytest.mark.parametrize("kind", ["float", "double"])
def test_against_brute_force(spark, kind):
    rows = clouds()
    if kind == "float":
        rows = [(i, np.float32(v).astype(float).tolist(), lab) for i, v, lab in rows]
    odd = [(-1, None, 1), (-2, [], 1), (-3, [0.0] * 24, 1), (-4, [float("nan")] * 24, 1), (-5, [None] + [1.0] * 23, 1), (-6, [1.0, 2.0], 1), (-7, [2.0, 4.0], 1), (-8, [float("inf")] * 24, 1)]
    frame = spark.createDataFrame([(*r, "x") for r in rows + odd], f"vec_id long, embedding array<{kind}>, label int, n_links string")
    found = {r.vec_id: (r.n_links, r.component_id) for r in rp_forest.near_duplicates(frame, leaf=32, room=40).collect()}
    want = brute(rows + odd)
    assert len(found) == len(want) and all(found[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in found.values()) >= 0.99 * sum(n for n, _ in want.values())
    assert np.mean([found[i] == want[i] for i in want]) >= 0.98


def test_the_query_finds_what_brute_force_finds(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label) for r in common.read(spark, sf, "embeddings").collect()]
    found = {r.vec_id: (r.n_links, r.component_id) for r in queries.op7_embedding_dedup(spark, sf).collect()}
    assert found == brute(rows)


def test_copies_ties_and_empty_table(spark):
    schema = "vec_id long, embedding array<float>, label int"
    frame = spark.createDataFrame([(5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (4, [1.0, 0.0], 1), (3, [1.0, 0.0], 2), (None, [0.0, 1.0], 1), (9, [0.1, 1.0], 1)], schema)
    found = sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in rp_forest.near_duplicates(frame).collect())
    assert found == [(0, 1, 9, True), (3, 0, 3, True), (4, 2, 4, True), (5, 2, 4, False), (5, 2, 4, False), (9, 1, 9, True)]
    assert rp_forest.near_duplicates(frame.limit(0)).count() == 0


def test_rows_without_an_id_link_others(spark):
    at = lambda *degrees: [[math.cos(math.radians(d)), math.sin(math.radians(d))] for d in degrees]
    rows = [(i, v, 1) for i, v in zip([1, None, 2, None, None, None], at(0, 20, 40, 90, 90, 91), strict=True)]
    found = rp_forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in found if r.component_id) == [(0, 2, 1), (1, 1, 1), (2, 1, 1)]
    assert [r.n_links for r in found if r.component_id is None] == [2, 2, 2] and all(r.kept for r in found if r.vec_id is None)


def planted(n, dim, seed=11):
    """Vectors of one hot label and others, some pairs at cosine 0.93 and above, and a chain of copies."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    rows = unit(rng.standard_normal((n, dim)))
    pick = rng.choice(n, n // 20, replace=False)
    side = rng.standard_normal((len(pick), dim))
    side = unit(side - (side * rows[pick]).sum(1)[:, None] * rows[pick])
    cosine = rng.uniform(0.931, 0.96, len(pick))[:, None]
    rows = np.concatenate([rows, cosine * rows[pick] + np.sqrt(1 - cosine**2) * side])
    label = np.where(np.arange(n) % 3 == 0, 0, np.arange(n) % 7)
    return rows, np.concatenate([label, label[pick]])


def test_the_query_links_planted_pairs_across_trees(spark, tmp_path):
    """50,000 vectors: labels of several thousand, so that production settings grow trees; all pairs by brute force."""
    rows, label = planted(47_620, 64)
    spark.createDataFrame(pa.table({"vec_id": np.arange(len(rows)), "embedding": pa.array(list(rows.astype(np.float32))), "label": label.astype(np.int32)})).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = {r.vec_id: (r.n_links, r.component_id) for r in queries.op7_embedding_dedup(spark, str(tmp_path)).collect()}
    rows = rows.astype(np.float32).astype(np.float64)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    links, mates = np.zeros(len(rows), int), []
    for x in range(7):
        at = np.flatnonzero(label == x)
        for some in np.array_split(at, max(1, len(at) // 2000)):
            i, j = np.nonzero(rows[some] @ rows[at].T >= 0.93)
            real = some[i] != at[j]
            np.add.at(links, some[i[real]], 1)
            mates += list(zip(some[i[real]].tolist(), at[j[real]].tolist(), strict=True))
    got = np.array([found[i][0] for i in range(len(rows))])
    assert rp_forest.shape(int(np.bincount(label).max()), 128)[1] >= 8 and links.sum() > 4000
    assert (got <= links).all() and got.sum() >= 0.99 * links.sum()
    assert np.mean([found[a][1] == found[b][1] for a, b in mates]) >= 0.99


def test_a_vector_is_shuffled_once_a_cell(spark):
    """Not once a leaf with the list of its leaves (some 4 KB a vector here): the job's time went there."""
    rows, label = planted(9_524, 64)
    frame = spark.createDataFrame(pa.table({"vec_id": np.arange(len(rows)), "embedding": pa.array(list(rows.astype(np.float32))), "label": np.zeros(len(rows), np.int32)}))
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    found = rp_forest.near_duplicates(frame).where("n_links > 0").count()
    print("bytes shuffled a vector", (written() - before) / len(rows))
    assert found >= 0.99 * 2 * 476 and written() - before < 3_000 * len(rows)


def test_crowded_cells_give_the_same_links(spark, monkeypatch):
    """Cells dealt out leaf by leaf, and crowded leaves as tiles, against whole cells; pairs are settled a few at a time."""
    rows = clouds()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    links = lambda leaf: sorted(map(tuple, rp_forest.near_duplicates(frame, leaf=leaf, room=40).collect()))
    for leaf, most in ((32, 50), (4, 100)):  # cells that are leaves, and cells three levels above them
        with monkeypatch.context() as patched:
            whole = links(leaf)
            patched.setattr(rp_forest, "CELL_ROWS", most)
            assert links(leaf) == whole and sum(n for _, n, *_ in whole) > 10_000
    x = rp_forest.units([np.array(v).tobytes() for _, v, label in rows if label == 1], "<f8")
    splits = rp_forest.fit(x, 24, 4, 3, 0.05)
    want = x @ x.T >= 0.93
    np.fill_diagonal(want, False)
    for few in (1, 1 << 20):
        monkeypatch.setattr(rp_forest, "PAIRS", few)
        sums = np.zeros(len(x), int)
        for t in range(4):
            row, leaf = rp_forest.descend(rp_forest.project(x, rp_forest.directions(24, 4, 3)[t]), splits[t], np.full(len(x), 3), 0.05)
            groups = [(node, row[leaf == node], None) for node in np.unique(leaf).tolist()]
            sums += rp_forest.compared(x, np.ones(len(x), int), groups, t, splits, 3, 0.05, 0.93, 40)[0]
        row, code = rp_forest.leaves(x, splits, 3, 0.05)
        shares = np.zeros((len(x), len(x)), bool)
        for c in np.unique(code):
            shares[np.ix_(row[code == c], row[code == c])] = True
        assert (sums == (want & shares).sum(1)).all() and sums.sum() > 10_000


def test_projections_do_not_depend_on_the_batch():
    x = np.random.default_rng(4).standard_normal((700, 63))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    r = rp_forest.directions(63, 2, 9)[1]
    whole = rp_forest.project(x, r)
    assert all((rp_forest.project(x[i : i + 1], r[:, :k]) == whole[i, :k]).all() for i in range(0, 700, 50) for k in (1, 5, 9)) and np.abs(whole - x @ r).max() < 1e-6


@pytest.mark.parametrize("dim", [16, 64])
@pytest.mark.parametrize("n", [60_000, 300_000])
def test_recall_of_the_production_forest(n, dim):
    """Pairs of cosine 0.93 to 0.95 (by construction, as brute force has them) that share a leaf; a third of the rows are one hot group."""
    rng, threshold, m = np.random.default_rng(5), 0.93, 4000
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    rows, hot = unit(rng.standard_normal((n, dim))), n // 3
    rows[:hot] = unit(0.85 * unit(rng.standard_normal(dim)) + np.sqrt(1 - 0.85**2) * rows[:hot])
    pick = np.concatenate([rng.choice(hot, m // 2, replace=False), hot + rng.choice(n - hot, m // 2, replace=False)])
    side = rng.standard_normal((m, dim))
    side = unit(side - (side * rows[pick]).sum(1)[:, None] * rows[pick])
    cosine = rng.uniform(threshold, threshold + 0.02, m)[:, None]
    mates = cosine * rows[pick] + np.sqrt(1 - cosine**2) * side
    trees, depth = rp_forest.shape(n, 128)
    spill = rp_forest.spill_of(threshold, dim)
    splits = rp_forest.fit(rows[rng.choice(n, 32_768, replace=False)], dim, trees, depth, spill)
    ours, theirs = (set(zip(*(x.tolist() for x in rp_forest.leaves(v, splits, depth, spill)), strict=True)) for v in (rows[pick], mates))
    met = {i for i, _ in ours & theirs}
    recall = [sum(i < m // 2 for i in met) / (m // 2), sum(i >= m // 2 for i in met) / (m // 2)]
    print(n, dim, trees, depth, "recall hot, others", recall)
    assert min(recall) >= 0.998
