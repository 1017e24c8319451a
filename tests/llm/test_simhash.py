import random
import re

import numpy as np
import xxhash
from orweave.llm import simhash
from orweave.llm.components import components


def union(nodes, pairs):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def texts():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgÉ ", k=4)) for _ in range(300)]
    out = [" ".join(rng.choices(words, k=rng.choice([1, 2, 3, 40, 200]))) for _ in range(60)]
    for t in out[:30]:
        w = t.split(" ")
        w[rng.randrange(len(w))] = "NEW"
        out.append("\n".join(w))
    return out + out[:5] + [None, "", " \t\n", "one", "ONE", "a b", "a b c", "a\x0bb\x1cc d"]


def test_fingerprint_is_the_plain_one():
    for t in texts():
        assert int.from_bytes(simhash.fingerprint(None if t is None else t.encode(), 3)) == plain(t)


def test_groups_are_those_of_all_pairs(spark):
    every = [(1000 - i, t, 0) for i, t in enumerate(texts())]
    fps = {i: plain(t) for i, t, _ in every}
    want = union(fps, [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 3])
    found = simhash.groups(spark.createDataFrame(every + every[:3], "doc_id long, text string, fp int"), 3, 64, 3).collect()
    assert {(r.doc_id, r.fp.hex(), r.component_id) for r in found} == {(i, f"{fps[i]:016x}", want[i]) for i in fps}
    assert len(found) == len(every) + 3


def test_tiles_lose_no_link(spark):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    fps = sorted({base ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(7))) & (1 << 64) - 1 for _ in range(400)} | {rng.getrandbits(64) for _ in range(50)})
    rows = [(i, f.to_bytes(8)) for i, f in enumerate(fps)]
    pairs = [(a, b) for a in range(len(fps)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 3]
    want = {n: c for n, c in union(range(len(fps)), pairs).items() if any(n in p for p in pairs)}
    links = simhash.links(spark.createDataFrame(rows, "rep long, fp binary"), 64, 3, room=20)
    assert {r.node: r.component for r in components(links).collect()} == want


def test_components_of_a_path_a_hub_and_loops(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5), (3, 2), (2, 3), (-4, 3)]
    rng.shuffle(edges)
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert found == {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(200, 260)]} | {-4: -4, 2: -4, 3: -4}


def test_null_ids_and_empty_table(spark):
    schema = "doc_id long, text string"
    found = simhash.groups(spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (None, "x y z")], schema), 3, 64, 3).collect()
    assert {(r.doc_id, r.component_id) for r in found} == {(None, 4), (4, 4), (None, None)}
    assert simhash.groups(spark.createDataFrame([], schema), 3, 64, 3).count() == 0


def test_rows_without_an_id_link_others(spark):
    """1 and 2 are linked by a text between them, whose row may lack an id."""
    base = [f"w{k}" for k in range(400)]
    texts = [" ".join([*base[:i], "changed", *base[i + 1 :]]) for i in range(0, 400, 2)]
    fps = {int.from_bytes(simhash.fingerprint(t.encode(), 3)): t for t in texts}
    near = lambda x, y: (x ^ y).bit_count() <= 3
    middle, a, b = next((m, x, y) for m in fps for x in fps for y in fps if m not in (x, y) and near(m, x) and near(m, y) and not near(x, y))
    for between in (5, None):
        docs = spark.createDataFrame([(1, fps[a]), (2, fps[b]), (between, fps[middle])], "doc_id long, text string")
        assert {r.doc_id: r.component_id for r in simhash.groups(docs, 3, 64, 3).collect()} == {1: 1, 2: 1, between: 1}


def test_very_long_texts(spark):
    """Beyond the number of shingles that are hashed at a time: every bit by its count over all shingles."""
    words = [f"w{i % 7919}" for i in range(60_000)]
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "\n".join(words) + "\t"), (3, "short")], "doc_id long, text string")
    found = {r.doc_id: (int.from_bytes(r.fp), r.component_id) for r in simhash.groups(docs, 3, 64, 3).collect()}
    assert found[1] == found[2] == (want, 1) and found[3][1] == 3


def test_blocks_wider_than_a_key(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(512) for _ in range(30)]
    rows = [(i, b.to_bytes(64)) for i, b in enumerate(base)] + [(100 + i, (b ^ (7 << rng.randrange(500))).to_bytes(64)) for i, b in enumerate(base)]
    found = {tuple(sorted((r.a, r.b))) for r in simhash.links(spark.createDataFrame(rows, "rep long, fp binary"), 512, 3).collect()}
    assert found == {(i, 100 + i) for i in range(30)}


def test_wide_fingerprints_catch_edited_copies(spark):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(5000)]
    bases = [rng.choices(words, k=400) for _ in range(40)]
    rows = [(i, " ".join(b)) for i, b in enumerate(bases)]
    for i, b in enumerate(bases):
        b = list(b)
        for at in rng.sample(range(400), 4):
            b[at] = "changed"
        rows.append((100 + i, " ".join(b)))
    found = {r.doc_id: r.component_id for r in simhash.groups(spark.createDataFrame(rows, "doc_id long, text string"), 5, 256, simhash.radius_of(0.8, 256), 32).collect()}
    assert all(found[i] == i for i in range(40)) and sum(found[100 + i] == i for i in range(40)) >= 39


def test_verified_groups_are_those_of_exact_similarity(spark):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]
    rows, n = [], 0
    for _ in range(25):
        base = rng.choices(words, k=200)
        for _ in range(rng.choice([1, 2, 6])):
            b = list(base)
            for at in rng.sample(range(200), rng.choice([0, 1, 3, 5, 8])):
                b[at] = rng.choice(words)
            rows.append((n, " ".join(b), 0))
            n += 1
    rows += [(3, rows[9][1], 0), (None, rows[0][1], 0), (None, "alone and short", 0), (7000, "", 0), (7001, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    wide = simhash.groups(docs, 5, 256, 70, 48)
    sets = {}
    for i, (_, t, _) in enumerate(rows):
        w = (t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    same = lambda a, b: (rows[a][1] or "") == (rows[b][1] or "") or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) > 0
    group = union(range(len(rows)), [(a, b) for a in range(len(rows)) for b in range(a) if same(a, b)])
    want = {}
    for i, g in group.items():
        ids = [rows[j][0] for j in group if group[j] == g and rows[j][0] is not None]
        want.setdefault((rows[i][0], rows[i][1]), min(ids, default=None))
    for room in (512, 3):
        found = simhash.verified(docs, wide, 5, 70, 0.8, room=room)
        got = {(r.doc_id, r.k1): r.component_id for r in found.collect()}
        by = {(r.doc_id, r.text): got[r.doc_id, r.k1] for r in docs.select("*", *simhash.row_key("doc_id", "text")).collect()}
        assert by == want and found.count() == len(rows)
    kept = simhash.representatives(docs, found).collect()
    assert len(kept) == len(set(group.values()))


def test_a_tile_links_similar_sets_whatever_their_fingerprints():
    rng = np.random.default_rng(11)
    members = []
    for g in range(12):
        base = rng.choice(2**62, 50, replace=False).astype(np.uint64)
        for n in (50, 45, 41, 40, 30):
            members.append((len(members), rng.bytes(32), np.sort(base[:n])))
    members += [(len(members) + i, rng.bytes(32), np.empty(0, np.uint64)) for i in range(2)]
    sets = [set(m[2].tolist()) for m in members]
    similar = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if similar(a, b)]
    assert union(range(len(sets)), simhash.verify_tile(members, None, 50, 0.8)) == union(range(len(sets)), pairs)
    tree, asked = members[::2], members[1::2]
    across = [(a, b) for a, b in pairs if a % 2 != b % 2]
    assert union(range(len(sets)), simhash.verify_tile(tree, asked, 50, 0.8)) == union(range(len(sets)), across)
