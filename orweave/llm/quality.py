"""Quality classifier with hierarchical empirical Bayes.

Evidence of a document: style features of its whole text, cut into bins, in a logistic
regression. It is fitted on at most ``sample`` labelled documents, those with the least hash of
their id, so the fit has a fixed cost; everything else covers all documents.

Sites: each document adds its label, or else its evidence, to its path (site and language) and
site. A grouped aggregation sums them; the strength of the priors comes from the spread of site
means around the global mean and of path means around their site (method of moments), so sparse
sites shrink towards the global mean and sparse paths towards their site. A document's own part
is taken out of its path and site before they serve as its prior. The posterior shifts the
document's log odds by the log odds of its path against the global ones.

Defined cases: a null text counts as empty; very long texts are read whole; null sites and languages
are sites and languages of their own; equal rows share a verdict; repeated labels of an id are averaged; without labels of both kinds every document gets the
share of good labels (0.5 if there are none) and is kept; an empty table gives no rows; other
columns are ignored. Judging moves no texts; ``keep`` moves them only if the rejected rows, by
the hash of their id and text, are too many to be sent to the documents.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orweave.llm import common

LETTERS = bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
CAPITALS = bytes(range(65, 91))
PLAIN = LETTERS + b"0123456789 \n\t\r.,;:'\"()-?!"
FEATURES = ("words", "capitals", "shouted", "odd", "exclaimed", "distinct", "stuttered", "word length", "digits", "sentence length", "line length", "bars")


def features(text: bytes | None) -> list[float]:
    text = text or b""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    letters = max(1, size - len(text.translate(None, LETTERS)))
    return [
        np.log1p(len(words)),
        (len(text) - len(text.translate(None, CAPITALS))) / letters,
        sum(map(bytes.isupper, words)) / n,
        len(text.translate(None, PLAIN)) / size,
        text.count(b"!") / n,
        len(set(words)) / n**0.8,
        sum(map(operator.eq, words, words[1:])) / n,
        letters / n,
        (len(text) - len(text.translate(None, b"0123456789"))) / size,
        np.log1p(n / (1 + text.count(b"."))),
        np.log1p(n / (1 + text.count(b"\n"))),
        text.count(b"|") / n,
    ]


@dataclass
class Classifier:
    """Bin edges and weights by feature; weights[-1] is the intercept."""

    edges: list[np.ndarray]
    weights: np.ndarray
    base: float

    def _design(self, x: np.ndarray) -> np.ndarray:
        starts = np.cumsum([0] + [len(e) + 1 for e in self.edges])
        out = np.zeros((len(x), starts[-1] + 1))
        for j, e in enumerate(self.edges):
            out[np.arange(len(x)), starts[j] + np.searchsorted(e, x[:, j])] = 1
        out[:, -1] = 1
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        if not len(self.edges):
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-np.clip(self._design(x) @ self.weights, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, bins: int = 16, ridge: float = 1.0) -> Classifier:
    """Ridge logistic regression on binned features by Newton steps."""
    if not len(y) or y.min() >= 0.5 or y.max() < 0.5:
        return Classifier([], np.zeros(0), float(y.mean()) if len(y) else 0.5)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    model = Classifier(edges, np.zeros(sum(len(e) + 1 for e in edges) + 1), float(y.mean()))
    d = model._design(x)
    penalty = np.full(d.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ model.weights, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + np.diag(penalty), d.T @ (y - p) - penalty * model.weights)
        model.weights = model.weights + step
        if np.abs(step).max() < 1e-6:
            break
    return model


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def classify(
    docs: DataFrame, labels: DataFrame, label: str = "quality", site_col: str = "source", path_col: str = "lang", id_col: str = "doc_id", text_col: str = "text", sample: int = 20_000, threshold: float = 0.5, training: Column | None = None
) -> DataFrame:
    """doc_id, site, path, k1 and k2 (a 128-bit hash of id and text), evidence, site_prior, path_prior, posterior, accepted.

    ``training`` may restrict the labels that are used (a condition on ``doc_id``).
    """
    spark = docs.sparkSession
    common.ship(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y")).where("doc_id is not null and y is not null")
    known = (known.where(training) if training is not None else known).groupBy("doc_id").agg(F.avg("y").alias("y"))

    def measure(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                values = [features(t) for t in some.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(values, pa.list_(pa.float64()))], names=["doc", "x"])

    skinny = docs.select(F.struct(F.col(id_col).cast("long").alias("id"), F.col(site_col).cast("string").alias("site"), F.col(path_col).cast("string").alias("path"), *row_key(id_col, text_col)).alias("doc"), F.col(text_col).cast("binary").alias("text"))
    seen = common.table(skinny.mapInArrow(measure, skinny.select("doc", F.array(F.lit(0.0)).alias("x")).schema), "features", few=3).select("doc.*", "x")
    seen = seen.join(known, F.col("id") == known["doc_id"], "left").drop("doc_id")

    chosen = seen.where("y is not null").orderBy(F.xxhash64("id"), "id").limit(sample).select("x", "y").toArrow()
    model = fit(np.array(chosen["x"].to_pylist(), float).reshape(-1, len(FEATURES)), (chosen["y"].to_numpy() >= 0.5).astype(float))
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(x):
        import pandas as pd

        return pd.Series(shared.value.probabilities(np.array(x.tolist(), float).reshape(-1, len(FEATURES))))

    part = F.coalesce("y", score("x"))
    paths = common.table(seen.select("site", "path", part.alias("e")).groupBy("site", "path").agg(F.sum("e").alias("s"), F.count("*").alias("n"), F.sum(F.col("e") * F.col("e")).alias("q")), "paths", few=1)
    sites = paths.groupBy("site").agg(F.sum("s").alias("site_s"), F.sum("n").alias("site_n"), F.sum("q").alias("site_q"))
    mean = sites.agg(F.coalesce(F.sum("site_s") / F.sum("site_n"), F.lit(0.5))).first()[0]
    mean = min(max(mean, 1e-3), 1 - 1e-3)

    def strength(frame: DataFrame, s: str, n: str, q: str, centre: Column) -> float:
        """Number of documents that the prior is worth: variance within groups over variance between their means."""
        one = frame.where(F.col(n) > 1).select((F.col(s) / F.col(n)).alias("m"), ((F.col(q) - F.col(s) * F.col(s) / F.col(n)) / (F.col(n) - 1)).alias("v"), F.col(n).alias("n"), centre.alias("c"))
        got = one.agg(F.sum(F.col("v") * F.col("n")) / F.sum("n"), F.avg((F.col("m") - F.col("c")) ** 2 - F.col("v") / F.col("n"))).first()
        if got[0] is None:
            return 10.0
        return float(min(1e6, max(1.0, got[0] / max(got[1], 1e-9))))

    k_site = strength(sites, "site_s", "site_n", "site_q", F.lit(mean))
    named = sites.withColumnRenamed("site", "of")
    both = paths.join(named, F.col("site").eqNullSafe(F.col("of")))
    both = both.select("site", "path", "s", "n", "q", "site_s", "site_n")
    k_path = strength(both, "s", "n", "q", F.col("site_s") / F.col("site_n"))

    scored = seen.select("id", "site", "path", "k1", "k2", score("x").alias("evidence"), "y").withColumn("own", F.coalesce("y", "evidence"))
    known_paths = both.select(F.col("site").alias("of_site"), F.col("path").alias("of_path"), "s", "n", "site_s", "site_n")
    met = scored.join(known_paths, F.col("site").eqNullSafe(F.col("of_site")) & F.col("path").eqNullSafe(F.col("of_path")))
    site_prior = (k_site * mean + F.col("site_s") - F.col("own")) / (k_site + F.col("site_n") - 1)
    path_prior = (k_path * site_prior + F.col("s") - F.col("own")) / (k_path + F.col("n") - 1)
    odds = _logit(F.col("evidence")) + _logit(F.col("path_prior")) - _logit(F.lit(mean))
    out = met.select(F.col("id").alias("doc_id"), "site", "path", "k1", "k2", "evidence", site_prior.alias("site_prior"), path_prior.alias("path_prior"))
    out = out.withColumn("posterior", 1 / (1 + F.exp(-odds)))
    keep = F.col("posterior") >= threshold if len(model.edges) else F.lit(True)
    return out.withColumn("accepted", keep)


def row_key(id_col: str, text_col: str) -> list[Column]:
    return [F.xxhash64(id_col, text_col).alias("k1"), F.xxhash64(F.lit(1), text_col, id_col).alias("k2")]


def keep(docs: DataFrame, judged: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that ``judged``, what ``classify`` says of them, doesn't reject."""
    return without(docs, judged.where(~F.col("accepted")).select("k1", "k2"), id_col, text_col)


def without(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose ``row_key`` isn't among ``keys`` (k1, k2)."""
    keys = common.table(keys.distinct(), "rejected", few=1)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *row_key(id_col, text_col))
    return keyed.join(keys, ["k1", "k2"], "left_anti").select("doc.*")
