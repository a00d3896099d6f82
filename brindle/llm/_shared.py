"""What the operators share: table access, cutting lineage, Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

#: Bytes of text that a kernel works on at once (a longer text is a chunk alone).
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, opened by Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    A folder of our own is made only where the setting is missing and the
    session is local, as in tests; on a cluster the setting is required.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Spark deletes the shuffle files of each query that ends in here; nothing reads them again."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.unset(setting) if before is None else spark.conf.set(setting, before)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there.

    The written files survive a lost executor, so later stages never recompute
    what came before.  They go when :func:`forget` is told so, else with the driver.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/brindle/{label}-{uuid.uuid4().hex}"
    with shuffles_deleted(spark):
        df.write.parquet(path)
    _folder(spark, path, lambda files, at: files.deleteOnExit(at))
    return spark.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str, act: Callable) -> None:
    """Do something with a folder of the shared file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    act(at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at)


def forget(*frames: DataFrame) -> None:
    """Delete the files of cut frames that nothing reads any more."""
    for df in frames:
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            if "/brindle/" in folder:
                _folder(df.sparkSession, folder, lambda files, at: files.delete(at, True))


def as_bytes(column: str | Column) -> Column:
    """UTF-8 bytes of a text column; a null text is an empty one."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch with at most ``limit`` bytes of ``column`` each."""
    data = batch.column(batch.schema.get_field_index(column))
    sizes = np.asarray(pc.binary_length(data).fill_null(0))
    first, total = 0, 0
    for row, size in enumerate(sizes):
        if row > first and total + size > limit:
            yield first, row
            first, total = row, 0
        total += int(size)
    if first < len(sizes):
        yield first, len(sizes)


def slim(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A kernel whose worker gives its free memory back at the end; workers live on between tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from kernel(batches)
        finally:
            release()

    return run


def release() -> None:
    """Give free memory of this process back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def schemas(fields: list[StructField], ddl: str) -> tuple[StructType, pa.Schema]:
    """Spark's and Arrow's schema of carried fields followed by those of a DDL string."""
    spark = StructType([*fields, *StructType.fromDDL(ddl).fields])
    return spark, to_arrow_schema(spark)


def record(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    """A record batch of arrays or sequences in the schema's order."""
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, type=field.type) for c, field in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether crc32 of the id as text falls in ``part`` modulo ``parts``."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % F.lit(parts) == F.lit(part), F.lit(False))
