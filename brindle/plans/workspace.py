"""Tables that cut a lineage, dense ids, and small files beside them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Rows and bytes of one Arrow batch handed to Python: texts can be long, so the bytes bound a worker's memory.
BATCH_ROWS, BATCH_BYTES = "8192", "4m"


def small_batches(spark: SparkSession) -> None:
    """Plans run from now on hand Python at most BATCH_ROWS rows and about BATCH_BYTES at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share, or a folder of our own where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written once as Parquet and read from there on."""
    spark = df.sparkSession
    path = f"{folder(spark)}/brindle/{uuid.uuid4().hex}/{label}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dense_ids(df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """df with name = 0, 1, 2 ... in the order given.

    A distributed sort numbers the rows of each partition; only one count a partition goes to the driver, and no window holds all rows.
    """
    row = F.monotonically_increasing_id()
    ranked = written(df.drop(name).orderBy(*order).withColumn("_row", row), "ranked")
    part = F.shiftright("_row", 33)
    counts = sorted((r["part"], r["n"]) for r in ranked.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    spark = df.sparkSession
    before = F.broadcast(spark.createDataFrame(offsets, "_part long, _before long"))  # a row for each partition
    return ranked.withColumn("_part", part).join(before, "_part").withColumn(name, F.col("_before") + F.col("_row").bitwiseAND((1 << 33) - 1)).drop("_part", "_before", "_row")


def first_ids(sizes: DataFrame, name: str, size: str, *order: str | Column) -> DataFrame:
    """sizes with name = the sum of the sizes before each row in the order given: where a row's own numbers begin.

    Narrow rows are sorted; inside a range a window adds up, and only one sum a range goes to the driver.
    """
    spark = sizes.sparkSession
    ranked = written(sizes.orderBy(*order).withColumn("_row", F.monotonically_increasing_id()), "ranked").withColumn("_part", F.shiftright("_row", 33))
    total, offsets = 0, []
    for p, n in sorted((r["_part"], r["n"]) for r in ranked.groupBy("_part").agg(F.sum(size).alias("n")).collect()):
        offsets.append((p, total))
        total += n
    before = F.broadcast(spark.createDataFrame(offsets, "_part long, _before long"))  # a row for each range
    inside = F.sum(size).over(Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1))
    return ranked.join(before, "_part").withColumn(name, F.col("_before") + F.coalesce(inside, F.lit(0))).drop("_part", "_before", "_row")


class Store:
    """Small files through Hadoop's file systems, so paths mean the same everywhere."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        path = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path, path.getFileSystem(self._conf)

    def exists(self, name: str) -> bool:
        path, fs = self._path(name)
        return fs.exists(path)

    def read(self, name: str) -> bytes:
        path, fs = self._path(name)
        stream = fs.open(path)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def replace(self, name: str, content: bytes) -> None:
        """Write beside the file, then rename over it."""
        path, fs = self._path(name)
        tmp, _ = self._path(f"{name}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(tmp, True)
        stream.write(bytearray(content))
        stream.close()
        if fs.exists(path):
            fs.delete(path, False)
        if not fs.rename(tmp, path):
            raise OSError(f"cannot rename to {path}")

    def delete(self, name: str) -> None:
        path, fs = self._path(name)
        fs.delete(path, True)

    def files(self, name: str = "") -> list[tuple[str, int]]:
        """(path, bytes) of all regular files below, at any depth, hidden ones too."""
        path, fs = self._path(name)
        found, it = [], fs.listFiles(path, True)
        while it.hasNext():
            s = it.next()
            found.append((s.getPath().toString(), s.getLen()))
        return found
