"""What the operators share: reading tables, folds of rows, and tables written in the shared folder."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this library to the executors once per application, as ``--py-files`` would, so that tasks can import it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="ship-")) / f"{package.name}.zip"  # read by the driver's file server alone
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def give_back() -> None:
    """Returns memory that a finished task no longer uses, since Python workers live on and serve the next stage too."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def named(df: DataFrame, name: str) -> Column:
    """A column by its name, whatever characters that has."""
    return df["`" + name.replace("`", "``") + "`"]


def whole_row(df: DataFrame) -> Column:
    """The whole row as one column ``row``; its own names can't clash with those of an operator."""
    return F.struct(*(named(df, c).alias(c) for c in df.columns)).alias("row")


def schema_with_row(after: str, read: DataFrame, before: str) -> T.StructType:
    """A schema with the column ``row`` of ``read``, where there is one, between others; no name needs to be quoted."""
    fields = [*T.StructType.fromDDL(before).fields, *(f for f in read.schema.fields if f.name == "row")]
    return T.StructType([*fields, *(T.StructType.fromDDL(after).fields if after else [])])


def unpacked(df: DataFrame, names: list[str], **instead: Column) -> DataFrame:
    """The columns of ``row`` again, some with other values."""
    return df.select(*(instead.get(c, F.col("row").getField(c)).alias(c) for c in names))


def fold(key: Column, parts: int) -> Column:
    """crc32 of the key's text, modulo ``parts``; null for a null key."""
    return F.crc32(key.cast("string")) % parts


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: dict[int, int]) -> DataFrame:
    """``doc_id, text, <label>`` of at most ``most[v]`` labelled documents for each label value v.

    Those with the smallest hash of their id are taken, so the choice doesn't depend on the order of rows. The ids alone are
    sorted and sent to the tasks; the bound makes that safe, and the texts are not shuffled.
    """
    chosen = None
    for value, bound in most.items():
        ids = (
            labels.where((F.col(label) == value) & F.col("doc_id").isNotNull())
            .select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias(label)).distinct()
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        )
        chosen = ids if chosen is None else chosen.union(ids)
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names. Only a local session may do without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


class Scratch:
    """Tables written as Parquet in the shared folder: they cut lineage and survive a lost executor."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
        self.count = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Deletes a table made by ``write`` that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
