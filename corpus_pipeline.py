"""The stages that turn raw documents into a training corpus.

Each stage takes (spark, docs, sf_dir) and returns the documents it keeps, with their columns;
the last returns encoded documents. ``run`` writes each stage's result to the shared folder and
reads it back, so a lost executor costs at most the stage that is running.

Defined cases, in every stage: a null text counts as empty; very long texts are read whole; repeated
rows are documents of their own, except that near-dedup keeps one of them; null ids are ids like any
other but never win a tie; an empty table gives an empty table of the same columns; the documents' own
columns travel in one struct, whatever their names, and come back as they were.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orweave.llm import common, decontaminate, line_runs, quality, sentence_pieces, simhash
from orweave.llm.queries import PIECE_FILE, _tokenizer

#: Near copies: five-word shingles, Jaccard similarity 0.8. Candidates: 256-bit fingerprints within RADIUS that agree on one
#: of TABLES blocks of 16 bits, and texts that agree on one of BANDS MinHash bands, which a pair at 0.8 does but for a chance of 7e-6.
SIMILARITY, SHINGLE, BITS, RADIUS, TABLES, BANDS = 0.8, 5, 256, 50, 40, 30


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts.

    Equal rows (id and text) share a verdict; without labels of both kinds all stay.
    """
    return common.few_files(quality.keep(docs, quality.classify(docs, common.read(spark, sf_dir, "labels"))))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten documents or more share; ``n_chars``, if there, follows the text.

    Repeated rows count as documents of their own; a text that loses all its lines, or is null, is empty.
    """
    rows = line_runs.drop_lines(docs, min_docs=10)
    new = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    rows = common.few_files(rows)
    return rows.select(*[new[c].alias(c) if c in new else F.col("doc").getField(c).alias(c) for c in docs.columns])


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the smallest id, of equal ids the least hash of the text.

    Texts without words are copies of each other.
    """
    wide = common.table(simhash.groups(docs, SHINGLE, BITS, RADIUS, TABLES, bands=BANDS), "wide-groups", few=3)
    return common.few_files(simhash.representatives(docs, simhash.verified(docs, wide, SHINGLE, RADIUS, SIMILARITY)))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no ten-word window of the benchmark occurs.

    Items without an id count like any other; an empty benchmark drops nothing.
    """
    keyed = docs.select(*quality.row_key("doc_id", "text"), "text")
    found = decontaminate.hits(keyed, common.read(spark, sf_dir, "benchmark"), size=10).where(F.size("firsts") > 0)
    return common.few_files(quality.without(docs, found.select("doc.k1", "doc.k2")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as piece ids, with the scores of their four best segmentations.

    The text gives way to ids, n_pieces, scores and round_trip; columns of these names give way, too.
    """
    rows = common.few_files(sentence_pieces.encode(docs, _tokenizer(PIECE_FILE), n=4))
    made = ["ids", "n_pieces", "scores", "round_trip"]
    return rows.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns if c not in {"text", *made}], *made)


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", encode),
]

#: Fingerprints, a fitted classifier and piece lattices are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, since = common.read(spark, sf_dir, "documents"), common.mark()
    for name, stage in STAGES:
        docs, path = common.table_at(stage(spark, docs, sf_dir), name.replace(" ", "-"), few=3)
        common.sweep(since, keep=path)  # what the stage has written besides, and the stage before it
    return docs
