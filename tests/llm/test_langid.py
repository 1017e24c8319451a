import math
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from orweave.llm import common, langid, queries
from pyspark.sql import functions as F


def plain(texts, order):
    """Interpolated Kneser-Ney as the textbook has it: word -> log probability."""
    raw = Counter()
    for t in texts:
        for w in filter(None, map(langid.letters, t.split())):
            p = "\x02" + w + "\x03"
            for i in range(1, len(p)):
                for k in range(1, order + 1):
                    if i - k + 1 >= 0:
                        raw[p[i - k + 1 : i + 1]] += 1
    left = Counter(g[1:] for g in raw if len(g) > 1)
    n = {g: c if len(g) == order or g[0] == "\x02" else left[g] for g, c in raw.items()}
    d = {}
    for k in range(1, order + 1):
        n1, n2 = (sum(c == x for g, c in n.items() if len(g) == k) for x in (1, 2))
        d[k] = max(0.1, min(0.95, n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5))
    total, kinds = defaultdict(int), defaultdict(int)
    for g, c in n.items():
        total[len(g), g[:-1]] += c
        kinds[len(g), g[:-1]] += 1
    size = sum(len(g) == 1 for g in n) + 1

    def score(word):
        p, out = "\x02" + word + "\x03", 0.0
        for i in range(1, len(p)):
            prob = 1 / size
            for k in range(1, order + 1):
                if i - k + 1 < 0:
                    continue
                g = p[i - k + 1 : i + 1]
                if c := total[k, g[:-1]]:
                    prob = d[k] * kinds[k, g[:-1]] / c * prob + (n[g] - d[k] if g in n else 0) / c
            out += math.log(prob)
        return out

    return score


def test_model_is_the_textbook_one(spark):
    rng = random.Random(1)
    texts = {x: [" ".join("".join(rng.choices(a, k=rng.randrange(1, 7))) for _ in range(80)) for _ in range(3)] for x, a in (("p", "aabcÉ"), ("q", "abbd"))}
    model = langid.train(spark.createDataFrame([(x, t) for x, ts in texts.items() for t in ts], "lang string, text string"), order=3, hash_bits=32)
    words = ["abc", "a", "É", "ddd", "zz", "bbbbab"]
    logs, symbols = model.log_probabilities([langid.letters(w) for w in words])
    assert symbols.tolist() == [len(w) + 1 for w in words] and model.langs == ["p", "q"]
    sizes = {x: plain(ts, 3) for x, ts in texts.items()}
    for x in texts:
        if model.symbols == len({c for t in texts[x] for c in langid.letters(t)}) + 2:
            for w, row in zip(words, logs, strict=True):
                assert row[model.langs.index(x)] == pytest.approx(sizes[x](langid.letters(w)), rel=1e-9)


def test_held_out_accuracy_and_und(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op4_language(spark, sf).join(common.read(spark, sf, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert len(rows) == 1000 and sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert sum(r.rejected for r in rows) <= 20


def test_odd_texts(spark):
    rows = [(1, "en", "the then that", "x"), (2, "fr", "été élan", "x"), (3, None, "", "x"), (4, "en", None, "x"), (5, "fr", "12 !?", "x"), (6, None, "THE that", "x"), (6, None, "THE that", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, score string")
    found = {r.doc.doc_id: r for r in langid.identify(docs, F.lit(True)).collect()}
    assert [found[i].lang_pred for i in range(1, 7)] == ["en", "fr", "und", "und", "und", "en"] and found[6].doc.score == "x"
    none = langid.identify(docs, F.lit(False)).collect()
    assert {(r.lang_pred, r.score, r.rejected) for r in none} == {("und", 0.0, False)} and len(none) == 7
    assert langid.identify(docs.limit(0), F.lit(True)).count() == 0


def test_scorer_forgets_without_changing_scores(spark):
    model = langid.train(spark.createDataFrame([("a", "ab abc"), ("b", "bd bde")], "lang string, text string"))
    few, many = langid.Scorer(model, room=4), langid.Scorer(model)
    rng = random.Random(2)
    for _ in range(30):
        texts = [" ".join("".join(rng.choices("abde!", k=3)) for _ in range(20)) for _ in range(3)] + [""]
        (x, n), (y, m) = few.batch(pa.array(texts)), many.batch(pa.array(texts))
        assert n.tolist() == m.tolist() and x == pytest.approx(y)
        want = [model.log_probabilities([w for t in [text] for w in map(langid.letters, t.split()) if w]) for text in texts]
        assert y == pytest.approx(np.array([logs.sum(axis=0) for logs, _ in want])) and m.tolist() == [n.sum() for _, n in want]


def test_keys_of_the_default_model_stay_apart(spark):
    """Production setting: as many n-grams as there are distinct ones, and unseen ones find nothing."""
    rng = random.Random(3)
    signs = [chr(0x4E00 + i) for i in range(3000)]
    texts = [" ".join("".join(rng.choices(signs, k=6)) for _ in range(4000)) for _ in range(12)]
    model = langid.train(spark.createDataFrame([("zh", t) for t in texts], "lang string, text string"))
    distinct = {w[i : i + 4] for t in texts for x in t.split() for w in ["\x02" + x + "\x03"] for i in range(len(w) - 3)}
    keys = model.tables["zh", 4][0]
    assert len(keys) == len(distinct)
    unseen = ["".join(rng.choices(signs, k=4)) for _ in range(3000)]
    asked = langid.grams([w for w in unseen if w not in distinct], 4)[3][0]
    assert not langid._find(keys, asked)[0].any()


def test_a_model_too_large_to_broadcast_predicts_the_same(spark):
    sf = "/root/testdata/sf0.001"
    docs = common.read(spark, sf, "documents").select("doc_id", "lang", "text")
    odd = spark.createDataFrame([(-1, None, None), (-2, "en", ""), (-3, None, "12 ?"), (-4, "en", "a I 漢字 É'É"), (-4, "en", "a I 漢字 É'É")], docs.schema)
    docs = docs.unionByName(odd)
    by = lambda most: sorted(langid.identify(docs, F.col("doc_id") % 4 != 2, most=most).select("doc.doc_id", "lang_pred", "score", "entropy", "rejected").collect(), key=lambda r: r.doc_id)
    few, many = by(1), by(8_000_000)
    assert len(few) == len(many) == docs.count()
    for a, b in zip(few, many, strict=True):
        assert (a.doc_id, a.lang_pred, a.rejected) == (b.doc_id, b.lang_pred, b.rejected)
        assert a.score == pytest.approx(b.score, rel=1e-6) and a.entropy == (b.entropy and pytest.approx(b.entropy))
