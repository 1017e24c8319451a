import random
import re

import pytest
from orweave.llm import decontaminate as dec
from pyspark.sql import functions as F

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, size):
    d, hit, found = split(text), set(), set()
    for item, t in items:
        w = split(t)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            win = w[i : i + size]
            for at in range(len(d) - len(win) + 1):
                if d[at : at + len(win)] == win:
                    hit |= set(range(at, at + len(win)))
                    found.add(str(item))
    return len(d), hit, sorted(found)


def case():
    rng = random.Random(5)
    items = [(i, " ".join(rng.choices("a b c É1".split(), k=rng.choice([0, 1, 3, 4, 5, 9])))) for i in range(12)] + [(3, "z Z z"), (50, "z z z"), (51, None), (52, "?!")]
    texts = ["-".join(rng.choices("a b c É1 d".split(), k=rng.choice([1, 5, 60]))) for _ in range(40)] + [None, "", "!", "z,z z\nz", items[5][1], "Z Z" + items[4][1] * 50]
    return items, texts


@pytest.mark.parametrize("block", [250_000, 6])
def test_same_as_brute_force(spark, block):
    items, texts = case()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts + texts[:2])], "doc_id long, text string, n_words int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    rows = dec.hits(docs, bench, size=4, block_words=block)
    found = {r.doc.doc_id: r for r in rows.select("*", dec.n_hit().alias("n_hit")).collect()}
    assert len(found) == len(texts) + 2
    for i, t in enumerate(texts + texts[:2]):
        n, hit, names = brute(t, items, 4)
        r = found[i]
        assert (r.n_words, r.n_hit, sorted(r["items"])) == (n, len(hit), names)
        assert {x for a, b in zip(r.firsts, r.ends) for x in range(a, b)} == hit


def test_proximity():
    s = dec.Segment.unpack(*dec.Segment.of([b"a x b x x a b".split(), b"b".split(), b"a c b".split(), []]).pack())
    a, b, c, d = s.find(dec.pa.array([b"a", b"b", b"c", b"d"], dec.pa.binary())).tolist()
    assert s.near([a, b], 3) == [(0, 2), (5, 6), (10, 12)] and d == -1
    assert s.near([a, b, c], 3) == [(10, 12)] and s.near([a, b], 1) == [] and s.near([a, d], 3) == []


def test_the_index_stores_every_token_and_serves_many_test_sets(spark):
    """Lists read back from the stored table are the positions of every word of every document."""
    items, texts = case()
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, docs int").repartition(3)
    stored = dec.index(docs)
    found = {}
    for row in stored.collect():
        s = dec.Segment.unpack(*(bytes(row[c]) for c in dec.PACKED))
        for k, term in enumerate(s.terms.to_pylist()):
            for p in s.postings(k).tolist():
                d = int(dec.np.searchsorted(s.starts, p, "right")) - 1
                found.setdefault(row.docs[d].doc_id, {})[p - int(s.starts[d])] = term.decode()
    assert {i: [w for _, w in sorted(x.items())] for i, x in found.items()} == {i: split(t) for i, t in enumerate(texts) if split(t)}
    for some in (items, items[:5]):
        bench = spark.createDataFrame(some, "item_id long, text string")
        rows = dec.hits(docs, bench, size=4, postings=stored).select("doc.doc_id", "items").collect()
        assert {r.doc_id: sorted(r["items"]) for r in rows} == {i: brute(t, some, 4)[2] for i, t in enumerate(texts)}


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "x " * 900_000 + "a b c d"), (2, "a b c"), (3, "d")], "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(7, "a b c d")], "item_id long, text string")
    assert {r.doc.doc_id: (r.n_words, r.firsts, r.ends) for r in dec.hits(docs, bench, size=4).collect()} == {1: (900_004, [900_000], [900_004]), 2: (3, [], []), 3: (1, [], [])}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.firsts) for r in dec.hits(docs, none).collect()] == [(2, [])]
    assert dec.hits(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("block", [250_000, 6])
def test_nearby_finds_inserted_and_swapped_words(spark, block):
    items, texts = case()
    items, within = [*items, (60, "b d a")], 4
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts + texts[:2] + ["x a y b d", "d c a b"])], "doc_id long, text string, first int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    want = set()
    for r in docs.collect():
        d = split(r.text)
        for item, t in items:
            if need := set(split(t)):
                spans = {(a, b) for b in range(len(d)) for a in range(max(0, b - within + 1), b + 1) if need <= set(d[a : b + 1])}
                want |= {(r.doc_id, str(item), a, b) for a, b in spans if not any((x, y) != (a, b) and a <= x and y <= b for x, y in spans)}
    found = {(r.doc.doc_id, r.item, r.first, r.last) for r in dec.nearby(docs, bench, within, block_words=block).select("doc", "item", F.col("first"), F.col("last")).collect()}
    assert found == want and any(i == len(texts) + 3 and item == "60" for i, item, _, _ in found)


@pytest.mark.parametrize("block", [250_000, 6])
def test_items_without_an_id_hit_and_are_not_named(spark, block):
    docs = spark.createDataFrame([(1, "x a b c d y"), (2, "e f g h"), (3, "a b")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, "a b c d"), (7, "e f g h"), (None, "e f g h")], "item_id long, text string").coalesce(1)
    found = {r.doc.doc_id: (r.firsts, r.ends, r["items"]) for r in dec.hits(docs, bench, size=4, block_words=block).collect()}
    assert found == {1: ([1], [5], []), 2: ([0], [4], ["7"]), 3: ([], [], [])}
