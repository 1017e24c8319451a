"""Line dedup with levelled sorted runs of line hashes. DataFrame operations only.

A line's key is the line without white space at both ends, A-Z lower-cased; it is held as a
128-bit hash. A run is a batch's rows (h1, h2, n) of keys and the documents they were found in. All runs
are one table, partitioned by run and bucketed and sorted by key, so that merging runs and joining a batch
with them moves no run: a bucket of every run and the batch's share of it meet in one task. ``add`` merge-anti-joins
a batch with the keys that the runs already know to be frequent (their fate is sealed, so a hot line is not
stored again and again), writes the rest as a run of level 0 and, whenever ``fanout`` runs stand at a level,
merges them into one run of the next level. A manifest beside the runs says which count; it is replaced
after each step, so that runs can be reopened by any session and a failed step leaves no trace in it.

Each row of the input is one document. Defined cases: null and empty texts are one empty line; very long
texts are split whole; empty keys are never dropped; repeated rows count as documents of their own and lose
the same lines; an empty table gives an empty result; the input's columns travel in one struct, so their
names never clash with the operator's.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orweave.llm import common

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "h1 long, h2 long, n long"


def key(line: Column) -> Column:
    return common.ascii_lower(F.btrim(line, F.lit(WHITE)))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashes(k: Column) -> list[Column]:
    return [F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2")]


class LineRuns:
    """The runs under a folder, by level. Opens what is there; the settings are those the folder was begun with."""

    def __init__(self, spark: SparkSession, path: str, frequent: int = 10, fanout: int = 4, buckets: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        text = common.read_text(spark, f"{self.path}/manifest.json")
        buckets = buckets or 2 * spark.sparkContext.defaultParallelism
        state = json.loads(text) if text else {"frequent": frequent, "fanout": fanout, "buckets": buckets, "levels": [], "made": 0}
        self.frequent, self.fanout, self.buckets, self.levels, self.made = (state[k] for k in ("frequent", "fanout", "buckets", "levels", "made"))
        self.table = f"orweave_runs_{uuid.uuid4().hex}"
        where = f"{self.path}/runs".replace("'", "\\'")
        spark.sql(f"create table {self.table} ({SCHEMA}, run string) using parquet partitioned by (run) clustered by (h1, h2) sorted by (h1, h2) into {self.buckets} buckets location '{where}'")
        if self.names():
            spark.catalog.recoverPartitions(self.table)

    def close(self) -> None:
        """Forget the table's name; the runs stay."""
        self.spark.sql(f"drop table if exists {self.table}")

    def _save(self) -> None:
        state = {"frequent": self.frequent, "fanout": self.fanout, "buckets": self.buckets, "levels": self.levels, "made": self.made}
        common.write_text(self.spark, f"{self.path}/manifest.json", json.dumps(state))

    def _write(self, run: DataFrame, level: int) -> None:
        """Write rows that are dealt out by buckets as a run."""
        name = f"level{level}-{self.made:06d}"
        self.made += 1
        run.select("h1", "h2", "n", F.lit(name).alias("run")).write.insertInto(self.table)
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(name)
        if len(old := self.levels[level]) < self.fanout:
            self._save()
            return
        merged = self.merged(old)
        self.levels[level] = []
        self._write(merged, level + 1)
        for name in old:
            common.remove(self.spark, f"{self.path}/runs/run={name}")
        self.spark.catalog.refreshTable(self.table)

    def rows(self, names: list[str]) -> DataFrame:
        return self.spark.table(self.table).where(F.col("run").isin(names)).select("h1", "h2", "n")

    def merged(self, names: list[str]) -> DataFrame:
        """Runs as one, bucket by bucket."""
        return self.rows(names).groupBy("h1", "h2").agg(F.sum("n").alias("n"))

    def names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def unsealed(self, counts: DataFrame) -> DataFrame:
        """The rows of a batch (h1, h2, n; one per key) whose key isn't known to be frequent, dealt out by buckets."""
        # As many partitions as buckets, so that each writes one file; keys are distinct, so none of them is large.
        counts = counts.select("h1", "h2", "n").hint("repartition", self.buckets, "h1", "h2")
        if not self.names():
            return counts
        return counts.hint("merge").join(self.rows(self.names()).where(F.col("n") >= self.frequent).select("h1", "h2"), ["h1", "h2"], "left_anti")

    def add(self, counts: DataFrame) -> None:
        """Add a batch: one row (h1, h2, n) per key."""
        self._write(self.unsealed(counts), 0)

    def found(self) -> DataFrame:
        """The keys (h1, h2) found in at least ``frequent`` documents of all batches."""
        return self.merged(self.names()).where(F.col("n") >= self.frequent).select("h1", "h2")


def count_lines(docs: DataFrame, text: Column, batch: Column) -> DataFrame:
    """(batch, h1, h2, n): in how many documents of the batch each non-empty key is."""
    keys = docs.select(batch.alias("batch"), F.explode(F.array_distinct(F.transform(lines(text), key))).alias("key"))
    return keys.where("key != ''").select("batch", *_hashes(F.col("key"))).groupBy("batch", "h1", "h2").agg(F.count(F.lit(1)).alias("n"))


def drop_lines(docs: DataFrame, text_col: str = "text", min_docs: int = 10, batches: int = 4, fanout: int = 4, runs: LineRuns | None = None) -> DataFrame:
    """Drop the lines whose key is in ``min_docs`` documents or more, in every document.

    Returns doc (a struct of the input's columns), n_lines, n_dropped, kept (the new text).
    The text is read once to count and once to drop; the first pass moves hashes and counts,
    the second hashes and positions, and a document moves once, to meet its positions.
    ``runs``: runs to which these documents are added, so that those of earlier calls count as well
    (their ``frequent`` is what counts then); by default new ones that don't outlive the call.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    counts = count_lines(docs, text, F.pmod(F.xxhash64(text), F.lit(batches)))
    path = common.scratch(spark, "line-counts")
    common.few_files(counts).write.partitionBy("batch").parquet(path)
    own = runs is None
    buckets = max(2 * spark.sparkContext.defaultParallelism, common.size_of(docs) >> 30)
    runs = LineRuns(spark, common.scratch(spark, "line-runs"), min_docs, fanout, buckets) if own else runs
    for b in range(batches):
        runs.add(spark.read.schema(SCHEMA + ", batch int").parquet(path).where(F.col("batch") == b))
    common.remove(spark, path)
    found = common.table(runs.found(), "frequent-lines", few=1)  # a table: its size is known, and a hot line's rows can be split
    if own:
        runs.close()
        common.remove(spark, runs.path)

    # What a text loses depends on the text alone: texts meet their dropped positions by a 128-bit hash.
    key_of = [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]
    placed = docs.select(*key_of, F.posexplode(lines(text)).alias("pos", "line")).select("k1", "k2", "pos", *_hashes(key(F.col("line"))))
    drops = placed.join(found, ["h1", "h2"], "left_semi").groupBy("k1", "k2").agg(F.collect_set("pos").alias("drop"))
    drops = common.table(drops, "dropped-lines", few=1)  # a table again: many copies of one text are a skewed join that can be split
    met = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *key_of).join(drops, ["k1", "k2"], "left")
    text = F.col("doc").getField(text_col)
    met = met.select("doc", "drop", F.when(F.col("drop").isNotNull(), lines(text)).alias("lines"))
    keep = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    kept = F.when(F.col("drop").isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.transform(keep, lambda i: F.get("lines", i)), "\n"))
    n = F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1
    return met.select("doc", F.coalesce(n, F.lit(1)).cast("long").alias("n_lines"), F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"), kept.alias("kept"))
