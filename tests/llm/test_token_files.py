import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from orweave.llm import common, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["Two words.", "", None, "a  b", " lead", "tail ", "x\n y", "it's we'll don't", "é ü z", "<|endoftext|> end", "12 34,5", "word " * 3000, "　a 　b", "a​ b́ c"]


def test_words_are_encoded_as_the_library_encodes_texts():
    from tokenizers import Tokenizer

    library, ours = Tokenizer.from_file(PATH), token_files.WordEncoder(PATH, "<u2", room=5)
    rng = random.Random(3)
    odd = ["".join(rng.choices([*"ab éß'sx1２\n\t.,#'-_…漢 ", "\n\n", "  ", "don't", " '", "<|endoftext|>"], k=rng.randrange(30))) for _ in range(5000)]
    for some in ([*TEXTS, *odd], TEXTS, [], [None], ["a" * 100_000 + "漢 " + "1." * 50_000]):
        found = ours.encode(pa.array(some, pa.string()))
        assert [np.frombuffer(f, "<u2").tolist() for f in found] == [library.encode(t or "", add_special_tokens=False).ids for t in some]


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    library, ours = Tokenizer.from_file(path), token_files.WordEncoder(path, "<u2")
    texts = ["Two  Words.", "don't STOP 12", ""]
    assert not ours.plain and [np.frombuffer(f, "<u2").tolist() for f in ours.encode(pa.array(texts))] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_hold_every_document_in_order(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    rows = [(7 * i % 20 if i else None, t, 1) for i, t in enumerate(TEXTS)] + [(3, "again", 2), (3, "again", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    found = token_files.write(docs, common.scratch(spark, "t"), PATH, end_id=2).documents(spark).orderBy("start").collect()
    assert [r.start for r in found] == [sum(x.n_tokens for x in found[:i]) for i in range(len(found))]
    assert [r.doc_id for r in found] == sorted((r[0] for r in rows), key=lambda x: -1 if x is None else x)
    want = sorted((-1 if i is None else i, zlib.crc32(np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes())) for i, t, _ in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32) for r in found) == want


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.write(docs, common.scratch(spark, "t"), PATH, end_id=2).documents(spark).count() == 0
