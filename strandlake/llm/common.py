"""What the operators of this subpackage share: words, hashes, shared folders, Arrow batches."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: the six ASCII white-space characters and nothing else.
WORD = r"[^\x20\x09-\x0D]+"
_SHIPPED, _FOLDER = "strandlake.shipped", "strandlake.folder"
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def n_words(col) -> F.Column:
    """Number of words of a text column, 0 for null; JVM-side."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; bytes.split() parts at just the six ASCII white-space characters."""
    return text.encode("utf-8").split() if text else []


class Recent(dict):
    """Values of compute(key), kept in two generations: when the young one holds `most` keys it becomes the old one, so
    memory is bounded and keys in use stay. Keys longer than 64 are not kept."""

    def __init__(self, compute: Callable, most: int = 150_000):
        super().__init__()
        self.compute, self.most, self.old = compute, most, {}

    def __missing__(self, key):
        v = self.old.get(key)
        if v is None:
            v = self.compute(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = v
        return v


class WordHashes(Recent):
    """64-bit hashes of words."""

    def __init__(self, seed: int = 0):
        super().__init__(lambda w: xxhash.xxh3_64_intdigest(w, seed))

    def of(self, ws: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit mixing hash, by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def window_hashes(h: np.ndarray, k: int, base: int) -> np.ndarray:
    """Polynomial hashes modulo 2**64, mixed at the end, of each k consecutive entries of h, by doubling: a window of 2m
    is the window of m at its start times base**m plus that of m after it."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, done, power, step, unit = np.zeros(len(h), np.uint64), 0, h.astype(np.uint64), 1, base & (2**64 - 1)
    bits = k
    while bits:
        if bits & 1:  # out: of the first `done` entries; add the next `step`
            m = len(h) - done - step + 1
            out = out[:m] * np.uint64(unit) + power[done : done + m]
            done += step
        bits >>= 1
        if bits:
            m = len(power) - step
            power = power[:m] * np.uint64(unit) + power[step : step + m]
            step, unit = step * 2, unit * unit & (2**64 - 1)
    return mix64(out[:n])


def sliding_min(a: np.ndarray, k: int) -> np.ndarray:
    """Least of each k consecutive entries, by doubling."""
    n, out, w = len(a) - k + 1, a, 1
    if n <= 0:
        return a[:0]
    while 2 * w <= k:
        out = np.minimum(out[:-w], out[w:])
        w *= 2
    return np.minimum(out[:n], out[k - w : k - w + n])


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def ship(spark: SparkSession) -> None:
    """Makes this package importable on executors; does nothing where PYTHONPATH has it already."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or spark.conf.get(_SHIPPED, "") == root:
        return
    path = os.path.join(tempfile.mkdtemp(), "strandlake_package.zip")
    with zipfile.ZipFile(path, "w") as z:
        for d, _, names in os.walk(os.path.join(root, "strandlake")):
            for x in names:
                if x.endswith(".py"):
                    z.write(os.path.join(d, x), os.path.relpath(os.path.join(d, x), root))
    spark.sparkContext.addPyFile(path)
    spark.conf.set(_SHIPPED, root)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where that is unset, a local session, as in tests, gets one of
    its own; on a cluster, whose machines share no temporary folder, it is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(_FOLDER, None)
    if not d:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = f"{tempfile.gettempdir()}/checkpoints/strandlake-{uuid.uuid4().hex}"
        spark.conf.set(_FOLDER, d)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(d)
    return d


def new_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used."""
    return f"{shared_dir(spark).rstrip('/')}/strandlake/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df as a Parquet table in the shared folder, read again: lineage ends there and lost executors cost nothing. Spark is
    told to delete the shuffle files of the job as soon as it ends, which it otherwise does when the driver collects its
    garbage."""
    path = new_path(spark, name)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that are not needed again."""
    jvm = spark._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def free(spark: SparkSession) -> None:
    """Lets Spark delete shuffle files of phases whose results have been written: they go when the driver collects its
    garbage, which a driver with a roomy heap may put off for hours."""
    gc.collect()
    spark._jvm.System.gc()


def checkpointed(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder; Spark removes the files once nothing refers to them."""
    shared_dir(spark)
    return df.checkpoint(True)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def hashed(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """id, text, h1 and h2 (128 bits that tell texts apart), and more columns."""
    t = F.col(text_col)
    return df.select(F.col(id_col).alias("id"), t.alias("text"), F.xxhash64(F.lit(1), t).alias("h1"), F.xxhash64(F.lit(2), t).alias("h2"), *more)


def two_longs(x: int) -> tuple[int, int]:
    """128 bits as two signed longs."""
    return tuple(v - (1 << 64) if v >> 63 else v for v in (x >> 64, x & (1 << 64) - 1))
