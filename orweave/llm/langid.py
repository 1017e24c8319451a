"""Language identification with interpolated Kneser-Ney character models.

A text is read as its white-space words, lower-cased and reduced to letters. A model predicts
each letter and the word's end from up to ``order`` - 1 symbols before it in the word. Training
counts n-grams of all training texts (words first, so equal words are cut once per task), in
Spark: raw counts for the highest order and for n-grams at a word's start, numbers of distinct
left neighbours for the others. The model of a language is, for each order, two sorted arrays of
hashes (n-grams and contexts) with their discounted probabilities and back-off weights.

Hashes have 64 bits, so that distinct n-grams stay apart, and a model grows with the n-grams of
its corpus, 16 bytes each. Up to ``most`` entries are collected and broadcast. A larger model stays
a table: a symbol's probability depends on nothing but the ``order`` symbols that end with it, its
window, so the distinct windows of the texts are joined with the model and the texts with the
windows. Both ways give the same.

A text gets the language with the lowest cross-entropy per symbol; ``score`` is that language's
posterior. Calibrated rejection: an eighth of the training texts, by their hash, is set aside and
scored by models of the others; a language's limit is the cross-entropy that all but a thousandth of
its texts set aside stay under. Above it ``rejected`` is true. The models that predict learn from all.

Defined cases: a null text, and one without letters, is ``und`` with score 0 and not rejected;
training skips null languages; without training texts all are ``und``; ties go to the language
first in order; repeated rows count as often as they occur; very long texts are read whole, in one
slice each; a language without texts set aside rejects nothing; an empty table gives no rows; the
caller's columns travel in one struct.
"""

from __future__ import annotations

import uuid
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orweave.llm import common

BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
OPEN, CLOSE = "\x02", "\x03"
UNKNOWN = "und"
#: One in so many training texts is left out of the models that the rejection limits are measured with.
ASIDE = 8


def letters(word: str) -> str:
    word = word.lower()
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


@dataclass
class Symbols:
    """The symbols of some words laid end to end: rolling hashes of the last 0 to ``order`` symbols up to each place."""

    hashes: list[np.ndarray]
    word: np.ndarray
    inner: np.ndarray

    @staticmethod
    def of(words: list[str], order: int) -> Symbols:
        text = np.frombuffer("".join([OPEN + w + CLOSE for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
        inner = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        last, power, hashes = np.zeros(len(text), np.uint64), np.uint64(1), []
        for k in range(order + 1):
            hashes.append(last)
            if k < order:
                last = last.copy()
                last[k:] += (text[: max(0, len(text) - k)] + np.uint64(1)) * power
                power = np.uint64(int(power) * int(BASE) % 2**64)
        return Symbols(hashes, np.repeat(np.arange(len(words)), lengths), inner)

    def key(self, k: int, at: np.ndarray, hash_bits: int = 64) -> np.ndarray:
        """Keys of the k symbols that end at these places."""
        h = self.hashes[k][at]
        return ((h ^ (h >> np.uint64(29))) * (MIX + np.uint64(2 * k))) >> np.uint64(64 - hash_bits)


def grams(words: list[str], order: int, hash_bits: int = 64) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each order k: keys of the k-grams, of their suffixes (k - 1) and contexts (k - 1), and the index of their word.

    One k-gram for each predicted symbol that has k - 1 symbols before it in its word; words have letters only.
    """
    s, out = Symbols.of(words, order), []
    for k in range(1, order + 1):
        at = np.flatnonzero(s.inner >= max(1, k - 1))
        out.append((s.key(k, at, hash_bits), s.key(k - 1, at, hash_bits), s.key(k - 1, at - 1, hash_bits), s.word[at]))
    return out


def tokens(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct space-parted tokens of some texts, the number of the token at each place, and where each text begins and all end."""
    split = pc.split_pattern(pc.fill_null(texts, ""), " ")
    bounds = split.offsets.to_numpy()
    coded = split.values[bounds[0] : bounds[-1]].dictionary_encode()
    return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), (bounds - bounds[0]).astype(np.int64)


def count_grams(docs: DataFrame, order: int, hash_bits: int, room: int = 200_000) -> DataFrame:
    """(lang, aside, k, gram, suffix, context, head, n): n-grams of training rows (lang, aside, text); head: at a word's start."""
    common.ship(docs.sparkSession)

    def run(batches):
        seen: dict[tuple[str, bool], Counter] = {}

        def out():
            for (lang, aside), words in seen.items():
                clean: Counter = Counter()
                for token, n in words.items():
                    for w in token.split():
                        clean[letters(w)] += n
                clean.pop("", None)
                if not clean:
                    continue
                names, weight = list(clean), np.fromiter(clean.values(), np.float64, len(clean))
                for k, (g, s, c, w) in enumerate(grams(names, order, hash_bits), 1):
                    first = np.concatenate([[True], w[1:] != w[:-1]]) if k > 1 else np.zeros(len(w), bool)
                    _, at, which = np.unique((g * MIX + s) * MIX + c, return_index=True, return_inverse=True)
                    n = np.bincount(which, weight[w])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(at)), pa.array([aside] * len(at)), pa.array(np.full(len(at), k, np.int32)), *(pa.array(x[at].astype(np.int64)) for x in (g, s, c)), pa.array(first[at]), pa.array(n.astype(np.int64))],
                        names=["lang", "aside", "k", "gram", "suffix", "context", "head", "n"],
                    )
            seen.clear()

        for batch in batches:
            for some in common.slices(batch, 2):
                texts = common.strings(some.column(2))
                for lang, aside in set(zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True)):
                    names, codes, _ = tokens(texts.filter(pc.and_(pc.equal(some.column(0), lang), pc.equal(some.column(1), aside))))
                    count = seen.setdefault((lang, aside), Counter())
                    for name, n in zip(names, np.bincount(codes, minlength=len(names)).tolist(), strict=True):
                        count[name] += n
                if sum(map(len, seen.values())) > room:
                    yield from out()
        yield from out()

    schema = "lang string, aside boolean, k int, gram long, suffix long, context long, head boolean, n long"
    rows = docs.select("lang", "aside", F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)
    return rows.groupBy("lang", "aside", "k", "gram", "suffix", "context", "head").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Per language and order: sorted n-gram keys with discounted probabilities, sorted context keys with back-off weights."""

    langs: list[str]
    order: int
    hash_bits: int
    symbols: int
    tables: dict[tuple[str, int], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    #: lang, k (negative: contexts), key, value of a model too large to collect; ``tables`` is empty then.
    stored: DataFrame | None = None

    def log_probabilities(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(sum of log probabilities by word and language, number of predicted symbols by word)."""
        s = Symbols.of(words, self.order)
        at = np.flatnonzero(s.inner)
        logs = self.logs(s, at)
        return np.stack([np.bincount(s.word[at], x, minlength=len(words)) for x in logs.T], axis=1), np.bincount(s.word[at], minlength=len(words))

    def logs(self, s: Symbols, at: np.ndarray) -> np.ndarray:
        """Log probabilities of the symbols at these places, by language."""
        p = np.full((len(at), len(self.langs)), 1.0 / self.symbols)
        for k in range(1, self.order + 1):
            rows = np.flatnonzero(s.inner[at] >= max(1, k - 1))
            grams_, contexts_ = s.key(k, at[rows], self.hash_bits), s.key(k - 1, at[rows] - 1, self.hash_bits)
            for i, lang in enumerate(self.langs):
                keys, probs, contexts, weights = self.tables[lang, k]
                seen, j = _find(contexts, contexts_)
                low = p[rows, i] * np.where(seen, weights[j], 1.0)
                seen, j = _find(keys, grams_)
                p[rows, i] = low + np.where(seen, probs[j], 0.0)
        return np.log(p)


def _find(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    asked = asked.view(np.int64)
    j = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return keys[j] == asked, j


def train(docs: DataFrame, order: int = 4, hash_bits: int = 64, most: int = 8_000_000) -> Model | None:
    """Models of every language among the rows (lang, text); None without any letter. Over ``most`` entries: a table."""
    return fit(common.table(count_grams(docs.withColumn("aside", F.lit(False)), order, hash_bits), "grams", few=1), order, hash_bits, most)


def fit(counted: DataFrame, order: int, hash_bits: int = 64, most: int = 8_000_000) -> Model | None:
    """The models of counted n-grams, as ``count_grams`` has them."""
    seen = counted.groupBy("lang", "k", "gram", "suffix", "context", "head").agg(F.sum("n").alias("n"))
    # The count of an n-gram: raw at the highest order and at a word's start, else distinct left neighbours.
    left = seen.groupBy("lang", (F.col("k") - 1).alias("k"), F.col("suffix").alias("gram")).agg(F.count("*").alias("left"))
    raw = seen.groupBy("lang", "k", "gram", "context", "head").agg(F.sum("n").alias("n"))
    counts = raw.join(left, ["lang", "k", "gram"], "left")
    counts = counts.select("lang", "k", "gram", "context", F.when((F.col("k") == order) | F.col("head"), F.col("n")).otherwise(F.coalesce("left", F.col("n"))).alias("n"))
    counts = counts.groupBy("lang", "k", "gram", "context").agg(F.sum("n").alias("n"))
    # One absolute discount for each language and order, n1 / (n1 + 2 n2).
    n1, n2 = F.sum((F.col("n") == 1).cast("double")), F.sum((F.col("n") == 2).cast("double"))
    discount = counts.groupBy("lang", "k").agg(F.greatest(F.lit(0.1), F.least(F.lit(0.95), F.coalesce(F.try_divide(n1, n1 + 2 * n2), F.lit(0.5)))).alias("d"))
    counts = counts.join(F.broadcast(discount), ["lang", "k"])  # one row for each language and order
    contexts = counts.groupBy("lang", "k", "context").agg(F.sum("n").alias("all"), F.sum("d").alias("mass"))
    probs = counts.join(contexts, ["lang", "k", "context"]).groupBy("lang", "k", F.col("gram").alias("key")).agg(F.max((F.col("n") - F.col("d")) / F.col("all")).alias("value"))
    weights = contexts.select("lang", (-F.col("k")).alias("k"), F.col("context").alias("key"), F.col("mass") / F.col("all"))
    stored = common.table(probs.unionByName(weights.toDF("lang", "k", "key", "value")), "language-models", few=1)
    sizes = {(r.lang, r.k): r["count"] for r in stored.groupBy("lang", "k").count().collect()}
    if not sizes:
        return None
    langs = sorted({x for x, _ in sizes})
    symbols = max(sizes.get((x, 1), 1) for x in langs) + 1
    if sum(sizes.values()) > most:
        return Model(langs, order, hash_bits, symbols, {}, stored)
    got = stored.toArrow()
    got = got.sort_by([("lang", "ascending"), ("k", "ascending"), ("key", "ascending")])
    lang, k = pc.index_in(got["lang"], pa.array(langs)).to_numpy(), got["k"].to_numpy()
    key, value = got["key"].to_numpy(), got["value"].to_numpy().astype(np.float64)
    part = lambda name, n: (key[m := (lang == langs.index(name)) & (k == n)], value[m])
    blank = (np.zeros(1, np.int64), np.zeros(1)), (np.zeros(1, np.int64), np.ones(1))
    tables = {(x, n): (*(part(x, n) if len(part(x, n)[0]) else blank[0]), *(part(x, -n) if len(part(x, -n)[0]) else blank[1])) for x in langs for n in range(1, order + 1)}
    return Model(langs, order, hash_bits, symbols, tables)


class Scorer:
    """Scores texts token by token.

    A symbol's log probabilities depend on its window, the up to ``order`` symbols that end with it: windows are scored
    once, in sorted arrays of their keys, and tokens are sums over their windows. Remembers ``room`` tokens for good and a
    quarter as many for a while, and four windows for each token.
    """

    def __init__(self, model: Model, room: int = 400_000):
        self.model, self.room, self.late = model, room, {}
        self.known: dict[str, int] = {}
        self.rows, self.symbols = np.zeros((1024, len(model.langs))), np.zeros(1024, np.int64)
        self.windows, self.logs = np.empty(0, np.uint64), np.empty((0, len(model.langs)))

    def _symbol_logs(self, s: Symbols, at: np.ndarray) -> np.ndarray:
        order = self.model.order
        key, length = s.key(order, at), np.minimum(s.inner[at] + 1, order)
        for k in range(2, order):
            some = np.flatnonzero(length == k)
            key[some] = s.key(k, at[some])
        found = np.minimum(np.searchsorted(self.windows, key), max(0, len(self.windows) - 1))
        new = np.flatnonzero(self.windows[found] != key) if len(self.windows) else np.arange(len(key))
        if len(new):
            fresh, first = np.unique(key[new], return_index=True)
            logs = self.model.logs(s, at[new[first]])
            if len(self.windows) > 4 * self.room:
                self.windows, self.logs = self.windows[:0], self.logs[:0]
                fresh, first = np.unique(key, return_index=True)
                logs = self.model.logs(s, at[first])
            where = np.searchsorted(self.windows, fresh)
            self.windows, self.logs = np.insert(self.windows, where, fresh), np.insert(self.logs, where, logs, axis=0)
            found = np.searchsorted(self.windows, key)
        return self.logs[found]

    def _learn(self, new: list[str]) -> None:
        at = len(self.known) + len(self.late)
        if at + len(new) > len(self.rows):
            size = max(2 * len(self.rows), at + len(new))
            self.rows = np.concatenate([self.rows, np.zeros((size - len(self.rows), self.rows.shape[1]))])
            self.symbols = np.concatenate([self.symbols, np.zeros(size - len(self.symbols), np.int64)])
        self.rows[at : at + len(new)], self.symbols[at : at + len(new)] = 0, 0
        for part in range(0, len(new), 20_000):
            words, owner = [], []
            for i, token in enumerate(new[part : part + 20_000], at + part):
                for w in (token,) if token.isalpha() else token.split():
                    if w := letters(w):
                        words.append(w)
                        owner.append(i)
            if words:
                s = Symbols.of(words, self.model.order)
                here = np.flatnonzero(s.inner)
                of = np.array(owner)[s.word[here]]
                starts = np.flatnonzero(np.diff(of, prepend=-1))
                self.rows[of[starts]] = np.add.reduceat(self._symbol_logs(s, here), starts)
                self.symbols[of[starts]] = np.diff(np.append(starts, len(of)))
        room = max(0, self.room - len(self.known)) if not self.late else 0
        self.known.update(zip(new[:room], range(at, at + room), strict=False))
        self.late.update(zip(new[room:], range(at + room, at + len(new)), strict=True))

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(log probabilities by text and language, number of symbols of each text)."""
        if not len(texts):
            return np.empty((0, len(self.model.langs))), np.empty(0, np.int64)
        names, codes, bounds = tokens(texts)
        if len(self.late) > self.room // 4:
            self.late.clear()
        known, late = self.known, self.late
        if new := [n for n in names if n not in known and n not in late]:
            self._learn(new)
        where = np.fromiter((late[n] if (i := known.get(n)) is None else i for n in names), np.int64, len(names))[codes]
        return np.add.reduceat(self.rows[where], bounds[:-1]), np.add.reduceat(self.symbols[where], bounds[:-1])


_scorers: dict[str, Scorer] = {}


def _scorer(token: str, model: Model) -> Scorer:
    """The scorer of a worker process, kept from task to task for as long as the model is the same."""
    if token not in _scorers:
        _scorers.clear()
        _scorers[token] = Scorer(model)
    return _scorers[token]


def _judge(langs: list[str], logs: np.ndarray, n: int) -> tuple[str, float, float]:
    best = int(np.argmax(logs))
    return langs[best], float(1 / np.exp(logs - logs[best]).sum()), float(-logs[best] / n)


def windows(text: str, order: int) -> Counter:
    """The windows of a text's symbols, each up to ``order`` symbols of one word, with their numbers."""
    out: Counter = Counter()
    for word, times in Counter(map(letters, text.split())).items():
        if word:
            p = OPEN + word + CLOSE
            for end in range(2, len(p) + 1):
                out[p[max(0, end - order) : end]] += times
    return out


def _keys(window: str, order: int, hash_bits: int) -> list[tuple[int, int]]:
    """(k, key) of the n-grams that end a window and (-k, key) of their contexts, as ``grams`` has them."""
    inner = window.strip(OPEN + CLOSE)
    # A window without a start symbol, read as a word, has one in front, which only longer n-grams reach.
    parts = grams([inner], order, hash_bits)
    at = len(inner) - (not window.endswith(CLOSE))
    out = []
    for k, (g, _, c, _) in enumerate(parts[: len(window)], 1):
        i = at - max(0, k - 2)
        out += [(k, int(g.view(np.int64)[i])), (-k, int(c.view(np.int64)[i]))]
    return out


def _predict_stored(rows: DataFrame, model: Model, schema) -> DataFrame:
    """``predict`` by joins; rows are (doc, text)."""
    langs, order, hash_bits, symbols = model.langs, model.order, model.hash_bits, model.symbols
    rows = common.table(rows.withColumn("row", F.monotonically_increasing_id()), "language-rows")

    def cut(batches):
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if found := windows((text or b"").decode("utf-8", "replace"), order):
                    # Surrogates can't occur: the text was decoded with replacement.
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(found)), pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["row", "win", "n"])

    bags = common.table(rows.select("row", "text").mapInArrow(cut, "row long, win string, n long"), "language-windows")

    def slots(batches):
        for batch in batches:
            wins = batch.column(0).to_pylist()
            found = [(w, k, key) for w in wins for k, key in _keys(w, order, hash_bits)]
            cols = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())], names=["win", "k", "key"])

    asked = bags.select("win").distinct().mapInArrow(slots, "win string, k int, key long")
    met = asked.join(model.stored, ["k", "key"], "left").groupBy("win").agg(F.collect_list(F.when(F.col("lang").isNotNull(), F.struct("lang", "k", "value"))).alias("met"))
    number = {x: i for i, x in enumerate(langs)}

    def weigh(batches):
        for batch in batches:
            out = []
            for found in batch.column(1).to_pylist():
                add, keep = np.zeros((order + 1, len(langs))), np.ones((order + 1, len(langs)))
                for x in found:
                    (add if x["k"] > 0 else keep)[abs(x["k"]), number[x["lang"]]] = x["value"]
                p = np.full(len(langs), 1.0 / symbols)
                for k in range(1, order + 1):
                    p = p * keep[k] + add[k]
                out.append(np.log(p).tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["win", "logs"])

    priced = common.table(met.mapInArrow(weigh, "win string, logs array<double>"), "window-prices")
    sums = [F.sum(F.col("n") * F.col("logs")[i]).alias(f"s{i}") for i in range(len(langs))]
    totals = bags.join(priced, "win").groupBy("row").agg(F.sum("n").alias("n"), *sums).select("row", "n", F.array(*[f"s{i}" for i in range(len(langs))]).alias("logs"))

    def judge(batches):
        for batch in batches:
            found = [(UNKNOWN, 0.0, None) if not n else _judge(langs, np.array(logs), n) for n, logs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            cols = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64())], names=["doc", "lang_pred", "score", "entropy"])

    return rows.select("doc", "row").join(totals, "row", "left").select("doc", "n", "logs").mapInArrow(judge, schema)


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """doc (struct of the input's columns but the text), lang_pred, score, entropy (nats per symbol; null for und)."""
    spark = docs.sparkSession
    common.ship(spark)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("doc"), F.col(text_col).cast("binary").alias("text"))
    schema = rows.select("doc").schema.add("lang_pred", "string").add("score", "double").add("entropy", "double")
    if model and model.stored is not None:
        return _predict_stored(rows, model, schema)
    shared, token = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches):
        scorer = _scorer(token, shared.value) if shared.value else None
        for batch in batches:
            for some in common.slices(batch, 1):
                if scorer:
                    logs, counts = scorer.batch(common.strings(some.column(1)))
                    found = [_judge(scorer.model.langs, x, n) if n else (UNKNOWN, 0.0, None) for x, n in zip(logs, counts.tolist(), strict=True)]
                else:
                    found = [(UNKNOWN, 0.0, None)] * some.num_rows
                cols = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64())], names=["doc", "lang_pred", "score", "entropy"])

    return rows.mapInArrow(run, schema)


def identify(docs: DataFrame, training: Column, lang_col: str = "lang", text_col: str = "text", order: int = 4, quantile: float = 0.999, most: int = 8_000_000) -> DataFrame:
    """Learn from the rows where ``training`` holds and predict all rows: doc, lang_pred, score, entropy, rejected."""
    learn = F.coalesce(training & F.col(lang_col).isNotNull(), F.lit(False))
    aside = F.pmod(F.xxhash64(text_col), F.lit(ASIDE)) == 0
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("doc"), F.when(learn, F.col(lang_col).cast("string")).alias("lang"), (learn & aside).alias("aside"), F.col(text_col).alias("text"))
    counted = common.table(count_grams(marked.where("lang is not null").select("lang", "aside", "text"), order, 64), "grams", few=1)
    trial, model = fit(counted.where("not aside"), order, most=most), fit(counted, order, most=most)
    tried = predict(marked.where("aside").select("lang", "text"), trial)
    limit = tried.where("doc.lang = lang_pred").groupBy(F.col("lang_pred").alias("l")).agg(F.percentile_approx("entropy", quantile, 10_000).alias("limit"))
    limit = F.broadcast(common.table(limit, "limits", few=1))  # one row for each language of the model
    rows = predict(marked.select("doc", "text"), model).select("doc.doc", "lang_pred", "score", "entropy")
    return rows.join(limit, F.col("lang_pred") == F.col("l"), "left").select("doc", "lang_pred", "score", "entropy", F.coalesce(F.col("entropy") > F.col("limit"), F.lit(False)).alias("rejected"))
