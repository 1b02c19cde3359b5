"""Session helpers shared by all operators: tables, lineage cuts and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side may be broadcast after it was counted, and bytes that these may have.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20
_WRITTEN: list[str] = []


class Cached:
    """A function of one value with a bounded memory. Unlike the library's caches it travels to workers by value, with an empty memory."""

    def __init__(self, function: Callable, size: int) -> None:
        self.function, self.size, self.known = function, size, {}

    def __call__(self, value):
        found = self.known.get(value)
        if found is None:
            if len(self.known) >= self.size:
                self.known.clear()
            found = self.known[value] = self.function(value)
        return found

    def __reduce__(self):
        return Cached, (self.function, self.size)


def cached(size: int) -> Callable[[Callable], Cached]:
    return lambda function: Cached(function, size)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; a temporary one only where none is set (local tests)."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="folioforge-")
    atexit.register(shutil.rmtree, made, True)
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and the sizes of the result are known."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove the tables that cut() has written in this process; for when no frame built on them is needed any more."""
    jvm = spark.sparkContext._jvm
    for path in _WRITTEN:
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _WRITTEN.clear()


def join_small(df: DataFrame, side: DataFrame, on: str | list[str], how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join a side, broadcast if its rows and their bytes, counted first, are within the bounds, else by shuffle."""
    size = F.coalesce(F.sum(sum((_bytes(F.col(f"`{n}`"), t) for n, t in side.dtypes), F.lit(0))), F.lit(0))
    n, held = side.select(F.count("*"), size).first()
    return df.join(F.broadcast(side) if n <= rows and held <= BROADCAST_BYTES else side, on, how)


def _bytes(column: Column, kind: str) -> Column:
    if kind in ("string", "binary"):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long") + 16
    if kind.startswith(("array", "map", "struct")):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)).cast("long")
    return F.lit(16).cast("long")
