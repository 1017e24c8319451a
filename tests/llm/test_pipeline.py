"""Each stage against brute force, on its own input."""

import random
from collections import Counter

import corpus_pipeline
import pytest
import test_decontaminate
import test_line_runs
from orweave.llm import common
from test_simhash import union

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def states(spark):
    docs, out = common.read(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        out.append(docs)
        docs = common.table(stage(spark, docs, SF), "stage")
    return [*out, docs]


def ascii_words(text):
    return text.encode().lower().split()


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_stay_until_the_last(states):
    assert all(s.columns == states[0].columns for s in states[:-1])
    assert {"doc_id", "ids", "n_pieces"} <= set(states[-1].columns)


def test_quality_keeps_the_good(spark, states):
    kept = texts(states[1])
    labels = {r.doc_id: r.quality for r in common.read(spark, SF, "labels").collect()}
    good = [i for i, q in labels.items() if q]
    assert sum(i in kept for i in good) >= 0.98 * len(good) and sum(i in kept for i, q in labels.items() if not q) <= 1


def test_lines(states):
    before, after = texts(states[1]), texts(states[2])
    assert Counter(after.values()) == Counter(t for (_, _, t), n in test_line_runs.brute(before.values(), 10).items() for _ in range(n))
    assert all(r.n_chars == len(r.text) for r in states[2].collect())


def test_near_copies(states):
    before, after = texts(states[2]), texts(states[3])
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in before.items() for w in [ascii_words(t)]}
    similar = [(a, b) for a in sets for b in sets if a < b and (before[a] == before[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    group = union(sets, similar)
    assert set(group.values()) <= set(after)  # one of each group, nothing that stands alone is lost
    assert len(after) - len(set(group.values())) <= 0.01 * len(before)


def test_leaks(spark, states):
    before, after = texts(states[3]), texts(states[4])
    items = [(r.item_id, r.text) for r in common.read(spark, SF, "benchmark").collect()]
    assert set(after) == {i for i, t in before.items() if not test_decontaminate.brute(t, items, 10)[1]}


def test_encoding(spark, states):
    last = states[5].collect()
    assert {r.doc_id for r in last} == set(texts(states[4])) and all(r.round_trip and len(r.ids) == r.n_pieces for r in last)
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == {r.doc_id for r in last}


ODD = "doc_id long, text string, lang string, source string, ids string, kept int, k1 string, doc string, scores int"
LONG = " ".join(f"word{i}" for i in range(60_000))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_nulls_long_texts_repeats_and_clashing_names(spark, name, stage):
    """Columns named like the operators' own come back as they were; each stage's defined cases."""
    rows = [(1, "a fine sentence of words.", "en", "s", "i", 1, "k", "d", 7), (2, None, None, None, None, None, None, None, None), (None, "", "en", "s", "i", 2, "k", "d", 7)]
    rows += [(3, LONG, "en", "s", "i", 3, "k", "d", 7), (3, LONG, "en", "s", "i", 3, "k", "d", 7), (None, "Another one of some words.", None, "s", "i", 5, None, "d", 7)]
    docs = common.table(spark.createDataFrame(rows, ODD), "odd")
    out = common.table(stage(spark, docs, SF), "stage")
    found = out.collect()
    last = name == corpus_pipeline.STAGES[-1][0]
    assert out.columns == ([c for c in docs.columns if c not in ("text", "ids", "scores")] + ["ids", "n_pieces", "scores", "round_trip"] if last else docs.columns)
    want = {"quality classifier": None, "line dedup": 6, "SimHash near-dedup": 4}.get(name, 6)
    if want == 6:
        assert sorted(str((r.doc_id, r.lang, r.kept, r.k1, r.doc)) for r in found) == sorted(str((r[0], r[2], *r[5:8])) for r in rows)
    if want == 4:  # the null and the empty text are copies, and so are the long ones; the smallest id stays
        assert sorted((r.doc_id or 0, len(r.text or "")) for r in found) == [(0, 26), (1, 25), (2, 0), (3, len(LONG))]
    if last:
        assert all(r.round_trip and len(r.ids) == r.n_pieces for r in found) and sum(not r.ids for r in found) == 2
    empty = stage(spark, docs.limit(0), SF)
    assert empty.count() == 0 and empty.columns == out.columns


def test_lines_of_repeated_rows(spark):
    rows = [(i, f"Shared line\nown {i}") for i in range(9)] + [(9, "shared LINE ")] * 1
    some = lambda n: {r.text for r in corpus_pipeline.drop_repeated_lines(spark, spark.createDataFrame(rows[:n], "doc_id long, text string"), SF).collect()}
    assert some(9) == {t for _, t in rows[:9]} and some(10) == {f"own {i}" for i in range(9)} | {""}


def test_pairs_at_the_limit_are_found_at_the_production_constants(spark):
    """Joint recall of candidates and verification at Jaccard 0.8, for short and long texts and for repeated passages."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijkl", k=7)) for _ in range(60_000)]
    rows, pairs = [], 0
    for n, times in ((5, 300), (40, 150), (200, 60), (900, 15)):  # shingles
        for _ in range(times):
            w = rng.choices(words, k=n + 4)
            rows += [" ".join(w), " ".join(w[: len(w) - n // 5])]
            pairs += 1
    for _ in range(40):
        w = rng.choices(words, k=304)
        rows += [" ".join(w), " ".join(w[:100] + w[100:130] * 6 + w[130:])]
        pairs += 1
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    kept = corpus_pipeline.keep_one_of_each_group(spark, docs, SF).collect()
    assert len(kept) == pairs and {r.doc_id for r in kept} == set(range(0, 2 * pairs, 2))
