import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from orweave.llm import sentence_pieces as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["a the  in", "in", "théé\nx 12", " lead", "tail ", "   ", "\n", "ﬁ👍", "on one"]


def every_path(m, text):
    """All segmentations of a whole text, without cutting it: (score, ids)."""
    edges = m.edges(sp.MARK + text.replace(" ", sp.MARK)) if text else []

    def walk(at):
        if at == len(edges):
            yield 0.0, ()
            return
        for to, ids, score in edges[at]:
            for s, rest in walk(to):
                yield s + score, ids + rest

    return sorted(walk(0), key=lambda x: -x[0])


def listed(m, text, n):
    """(ids of each of the n best, their scores)."""
    c = m.batch([text], n)[0]
    found = [tuple(np.frombuffer(v, m.width).tolist()) for v in c.variants]
    assert found[0] == tuple(c.ids.tolist())
    return found, c.scores


@pytest.mark.parametrize("text", [*TEXTS, ""])
@pytest.mark.parametrize("n", [1, 2, 5])
def test_n_best_are_the_best_of_all(text, n):
    m = sp.Pieces(PATH)
    want = every_path(m, text)
    found, scores = listed(m, text, n)
    assert scores == pytest.approx([s for s, _ in want[:n]]) and len(set(found)) == len(found)
    by = {ids: s for s, ids in want}
    assert [by[f] for f in found] == pytest.approx(scores)
    assert [s for s, _ in m.nbest(sp.MARK + text.replace(" ", sp.MARK), n)] == pytest.approx(scores) or not text


def test_decoding_is_the_librarys():
    m, library = sp.Pieces(PATH, room=3), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for text in TEXTS * 3 + ["word words " * 500, "x" * 5000]:
        ids = m.batch([text], 3)[0].ids
        assert m.decode(ids) == text == library.decode(ids.tolist())
        assert m.decode(library.encode(text)) == text


def test_segments_in_arrays_and_one_by_one_are_the_same():
    """Long, short and spelled segments: paths, scores and losses of the second best as from plain edges."""
    rng = random.Random(4)
    some = ["".join(rng.choices("aeinrst.漢👍\x02", k=rng.randrange(1, 60))) for _ in range(300)] + ["e" * 90, "thethethe" * 12, "."]
    m = sp.Pieces(PATH)
    m.learn([some])
    for s in some:
        k = m.known[s]
        flat, _, (score,), (gap,) = m._solve_one(sp.MARK + s)
        assert list(m.ids[m.starts[k] : m.starts[k + 1]]) == flat.tolist()
        assert m.score[k] == pytest.approx(score) and m.gap[k] == pytest.approx(gap)


def test_little_room_changes_nothing():
    """What is forgotten between texts is solved again: same segmentations, whatever the room."""
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abeinrst.", k=rng.choice([2, 5, 9, 45]))) for _ in range(12)) for _ in range(1000)]
    small, large = sp.Pieces(PATH, room=100), sp.Pieces(PATH)
    for at in range(0, len(texts), 7):
        for a, b in zip(small.batch(texts[at : at + 7], 4), large.batch(texts[at : at + 7], 4), strict=True):
            assert a.ids.tolist() == b.ids.tolist() and a.variants == b.variants and a.scores == b.scores
    assert small.base is not None and len(small.score) < 1000 < len(large.score)


def test_very_long_text():
    m = sp.Pieces(PATH)
    text = "one two, three\n" * 40_000 + "y" * 20_000
    found = m.batch(["", text, "one"], 2)
    assert m.decode(found[1].ids) == text and m.decode(found[2].ids) == "one" and len(found[1].variants) == 2


def test_frame(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS + [None, "", "a▁b", "in", "in"])]
    found = {r.doc.doc_id: r for r in sp.encode(spark.createDataFrame(rows, "doc_id long, text string, ids int"), PATH, 3).collect()}
    assert len(found) == len(rows) and all(r.doc.ids == 1 for r in found.values())
    for i, t, _ in rows:
        r = found[i]
        assert r.round_trip == ("▁" not in (t or "")) and r.n_pieces == len(r.ids)
        assert r.variants_crc32[0] == zlib.crc32(np.array(r.ids, "<u2").tobytes()) and len(r.scores) == len(r.variants_crc32)
    assert found[9].ids == [] and found[9].scores == [0.0]
    assert sp.encode(spark.createDataFrame([], "text string"), PATH).count() == 0


@pytest.mark.parametrize("n", [2, 4])
@pytest.mark.parametrize("text", ["ingered", "lingered", "a ingered, ingered"])
def test_variants_of_tied_words_are_distinct_and_the_best(text, n):
    m = sp.Pieces(PATH)
    want = every_path(m, text)
    found, scores = listed(m, text, n)
    assert len(set(found)) == len(found) == min(n, len(want))
    by = {ids: s for s, ids in want}
    assert [by[f] for f in found] == pytest.approx([s for s, _ in want[:n]]) == scores


def test_segments_tied_in_two_orders_keep_both_best():
    """[297, 1097, 286] and [297, 490, 893] of 'ingered' are equally good."""
    m = sp.Pieces(PATH)
    best = tuple(m.batch(["ingered"], 1)[0].ids.tolist())
    ranked = m.ranked(sp.MARK + "ingered", best, 4)
    assert ranked[0][1] == best and len({ids for _, ids in ranked}) == 4
    assert {ids for s, ids in ranked if s == pytest.approx(ranked[0][0])} >= {(297, 1097, 286), (297, 490, 893)}
