import math
import random

import numpy as np
import pytest
from orweave.llm import common, quality
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    docs, labels = common.read(spark, SF, "documents"), common.read(spark, SF, "labels")
    train = F.crc32(F.col("doc_id").cast("string")) % 4 != 2
    rows = quality.classify(docs.join(labels.select("doc_id"), "doc_id"), labels, training=train).select("doc_id", "accepted").where(~train).join(labels, "doc_id").collect()
    good, bad = [r.accepted for r in rows if r.quality], [r.accepted for r in rows if not r.quality]
    assert len(rows) > 800 and np.mean(good) >= 0.98 and np.mean(bad) <= 0.06


def plain(rows):
    """Hierarchical empirical Bayes by loops over (id, site, path, evidence, label): id -> (site prior, path prior, posterior)."""
    own = [label if label is not None else e for _, _, _, e, label in rows]
    sites, paths = {}, {}
    for (_, site, path, _, _), x in zip(rows, own):
        sites.setdefault(site, []).append(x)
        paths.setdefault((site, path), []).append(x)
    mean = min(max(sum(own) / len(own), 1e-3), 1 - 1e-3)

    def strength(groups, centre):
        some = {g: xs for g, xs in groups.items() if len(xs) > 1}
        if not some:
            return 10.0
        average = {g: sum(xs) / len(xs) for g, xs in some.items()}
        within = {g: sum((x - average[g]) ** 2 for x in xs) / (len(xs) - 1) for g, xs in some.items()}
        pooled = sum(within[g] * len(xs) for g, xs in some.items()) / sum(map(len, some.values()))
        between = sum((average[g] - centre(g)) ** 2 - within[g] / len(xs) for g, xs in some.items()) / len(some)
        return min(1e6, max(1.0, pooled / max(between, 1e-9)))

    k_site = strength(sites, lambda g: mean)
    k_path = strength(paths, lambda g: sum(sites[g[0]]) / len(sites[g[0]]))
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    out = []
    for (i, site, path, e, _), x in zip(rows, own):
        s, p = sites[site], paths[site, path]
        site_prior = (k_site * mean + sum(s) - x) / (k_site + len(s) - 1)
        path_prior = (k_path * site_prior + sum(p) - x) / (k_path + len(p) - 1)
        out.append((i, site_prior, path_prior, 1 / (1 + math.exp(-(logit(e) + logit(path_prior) - logit(mean))))))
    return out, k_site, k_path


@pytest.mark.parametrize("seed", range(3))
def test_posteriors_are_those_of_plain_loops(spark, seed):
    """Several sites and paths, dense, sparse and null ones, repeated and missing labels; to 1e-9."""
    rng = random.Random(seed)
    texts = ["good words here.", "BAD!! BAD!!", "some words, fine ones, in a row.", "x | y | z 12 34", "Mixed WORDS of a kind! And more"]
    rows = []
    for i in range(400):
        site = rng.choice(["a", "a", "a", "b", "c", None])
        good = rng.random() < {"a": 0.9, "b": 0.2, "c": 0.5, None: 0.6}[site]
        rows.append((i, texts[0 if good and rng.random() < 0.8 else rng.randrange(5)], site, rng.choice(["en", "fr", None])))
    rows += [(900, texts[0], "lone", "en"), (901, None, None, None), (902, "w " * 150_000, "b", "fr"), (903, "", "lone two", "xx")]
    docs = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id long, text string, source string, lang string, evidence double, y string").repartition(3)
    marks = [(i, int(t == texts[0]) if rng.random() < 0.95 else rng.randrange(2)) for i, t, *_ in rows[:200]]
    marks += [(5, 1), (5, 0), (5, 0), (None, 1), (7, None), (99_999, 1)]
    found = quality.classify(docs, spark.createDataFrame(marks, "doc_id long, quality int")).collect()
    labels = {}
    for i, y in marks:
        if i is not None and y is not None:
            labels.setdefault(i, []).append(y)
    assert len(found) == len(rows)
    want, k_site, k_path = plain([(r.doc_id, r.site, r.path, r.evidence, sum(labels[r.doc_id]) / len(labels[r.doc_id]) if r.doc_id in labels else None) for r in found])
    assert 1 < k_site < 1e6 and 1 <= k_path <= 1e6
    for r, (i, site_prior, path_prior, posterior) in zip(found, want, strict=True):
        assert r.doc_id == i and (r.site_prior, r.path_prior) == pytest.approx((site_prior, path_prior), abs=1e-9)
        assert r.posterior == pytest.approx(posterior, abs=1e-9) and r.accepted == (r.posterior >= 0.5)


def test_the_fit_is_the_ridge_optimum():
    """The gradient of the penalised likelihood is zero, and evidence is the logistic of the binned features."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, len(quality.FEATURES)))
    y = (x[:, 0] + 0.3 * rng.standard_normal(500) > 0).astype(float)
    m = quality.fit(x, y)
    at = np.cumsum([0] + [len(e) + 1 for e in m.edges])
    cells = np.array([[at[j] + sum(v > e for e in m.edges[j]) for j, v in enumerate(row)] for row in x])
    z = np.array([sum(m.weights[c] for c in row) + m.weights[-1] for row in cells])
    p = 1 / (1 + np.exp(-z))
    assert m.probabilities(x) == pytest.approx(p)
    for c in range(at[-1]):
        assert sum((y - p)[(cells == c).any(axis=1)]) == pytest.approx(m.weights[c], abs=1e-4)
    assert np.mean((p > 0.5) == (y > 0.5)) > 0.9


def test_features_count_what_their_names_say():
    text = "Good WORDS here, 12 of of them!\nA | b."
    n, letters = 10, sum(c.isalpha() for c in text)
    want = dict(words=math.log1p(n), capitals=7 / letters, shouted=2 / n, odd=1 / len(text), exclaimed=1 / n, distinct=9 / n**0.8, stuttered=1 / n)
    want |= {"word length": letters / n, "digits": 2 / len(text), "sentence length": math.log1p(n / 2), "line length": math.log1p(n / 2), "bars": 1 / n}
    found = dict(zip(quality.FEATURES, quality.features(text.encode()), strict=True))
    assert found == pytest.approx(want)
    assert all(map(math.isfinite, quality.features(None) + quality.features(b" \n") + quality.features("é漢".encode())))


def test_keep_drops_the_rejected_rows_alone(spark):
    docs = spark.createDataFrame([(1, "a", 7), (1, "b", 7), (None, "b", 7), (1, "a", 8)], "doc_id long, text string, k1 int")
    judged = docs.select(*quality.row_key("doc_id", "text"), (F.col("text") == "b").alias("accepted"))
    assert sorted(map(tuple, quality.keep(docs, judged).collect()), key=str) == [(1, "b", 7), (None, "b", 7)]


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", "s", "en"), (2, "B!!", "s", "en")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert [r.accepted for r in quality.classify(docs, labels).collect()] == [True, True]
    assert [r.accepted for r in quality.classify(docs, labels.limit(0)).collect()] == [True, True]
    assert quality.classify(docs.limit(0), labels).count() == 0
