"""What the operators of this subpackage share: shared folders, written tables, shipped code."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
_scratch: list[tuple[SparkSession, str]] = []
#: The driver's own folders, for code that it ships.
_local: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where the setting is empty, a local session gets a temporary folder and any other
    session a folder in its warehouse.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        local = master == "local" or master.startswith("local[")
        path = "file://" + tempfile.mkdtemp(prefix="orweave-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_orweave"
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/orweave-{name}-{uuid.uuid4().hex}"
    _scratch.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None if there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(where):
        return None
    file = system.open(where)
    try:
        return bytes(file.readAllBytes()).decode()
    finally:
        file.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file and put it in the place of an older one."""
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    new, where = Path(f"{path}.new"), Path(path)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    file = system.create(new, True)
    file.write(bytearray(text.encode()))
    file.close()
    system.delete(where, False)
    system.rename(new, where)


def table(df: DataFrame, name: str, few: int = 0) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    ``few``: at least so many files a core, more as its size calls for (see ``few_files``): 1 where df ends with a light step
    after a shuffle, 3 otherwise; 0, a file for each partition, where each is a piece of the result.
    """
    return table_at(df, name, few)[0]


def size_of(df: DataFrame) -> int:
    """Bytes that the optimizer expects of df, 0 where it has no idea (it multiplies the sides of joins)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 52 else 0


def few_files(df: DataFrame, each: int = 3) -> DataFrame:
    """df in no more partitions than its size calls for: ``each`` a core, or one for each 8 MB expected; for writing."""
    size = size_of(df)
    return df.coalesce(min(1 << 20, max(each * df.sparkSession.sparkContext.defaultParallelism, size // (8 << 20)))) if size else df


def table_at(df: DataFrame, name: str, few: int = 0) -> tuple[DataFrame, str]:
    """As ``table``, with the path, so that the caller can remove what nothing reads any more."""
    path = scratch(df.sparkSession, name)
    (few_files(df, few) if few else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def mark() -> int:
    """How many scratch paths there are; ``sweep`` can remove those that come after."""
    return len(_scratch)


def sweep(since: int, keep: str = "") -> None:
    """Remove what was written to scratch paths since that mark, but for ``keep``, while their session lives."""
    for spark, path in _scratch[since:]:
        if path != keep:
            remove(spark, path)
    _scratch[since:] = [x for x in _scratch[since:] if x[1] == keep]


@atexit.register
def _sweep() -> None:
    for folder in _local:
        shutil.rmtree(folder, ignore_errors=True)
    try:
        sweep(0)
    except Exception:  # the session has ended before: nothing can be removed through it
        return


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, wherever they start.

    Rows go to them in Arrow batches of ``BATCH_BYTES``, unless the session says otherwise: 10,000 rows of long texts
    are hundreds of MB on both sides.
    """
    sc = spark.sparkContext
    if not spark.conf._jconf.contains(BATCH):
        spark.conf.set(BATCH, BATCH_BYTES)
    if getattr(sc, "_orweave_shipped", False):
        return
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    _local.append(tempfile.mkdtemp())
    path = os.path.join(_local[-1], "orweave_code.zip")
    with zipfile.ZipFile(path, "w") as out:
        for base, _, names in os.walk(os.path.join(top, "orweave")):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(base, n)
                    out.write(full, os.path.relpath(full, top))
    sc.addPyFile(path)
    sc._orweave_shipped = True


def slices(batch, text: int, most: int = 4_000_000):
    """Parts of an Arrow batch whose texts (the column of that number, binary or string) take ``most`` bytes or are one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    upto, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, to - at)
        at = to


def strings(column: pa.Array) -> pa.Array:
    """A binary column as strings; what isn't UTF-8 is replaced."""
    try:
        return column.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if x is None else x.decode("utf-8", "replace") for x in column.to_pylist()], pa.string())


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c):
    """Lower-case A-Z alone; other letters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
