"""What several operators share: the shared folder, bounded broadcasts, 64-bit mixing and Arrow text access."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only after its rows were counted and are at most this many (a few long columns: below 32 MB).
BROADCAST_ROWS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A folder of this session in the one that spark.checkpoint.dir names; local sessions without that setting get a temporary one."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not base:
            if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        _own[app] = f"{base.rstrip('/')}/marlstone-{uuid.uuid4().hex}"
        atexit.register(_remove_own, spark, _own[app])
    return _own[app]


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _remove_own(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the JVM may be gone at exit
        return


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._marlstone_path = path
    return out


#: Texts go to Python in batches of at most so many rows, where the session doesn't set another number than Spark's.
BATCH_ROWS = 1000


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with batches that suit texts: a task holds a batch in the JVM and in Python, and 10,000 long texts are a lot of memory."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(key, "10000") == "10000":
        conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def read_written(tables: list[DataFrame]) -> DataFrame:
    """The rows of several tables of written() with one schema, in one scan."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*(df._marlstone_path for df in tables))


def drop(*tables: DataFrame) -> None:
    """Removes tables of written() that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_marlstone_path", None):
            remove(df.sparkSession, path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows; larger ones are left to a shuffled join. df is counted: pass a written table.

    weight says for how many rows one counts (1 or more), where rows hold arrays or texts without a bound.
    """
    head = df.limit(rows + 1)
    total = head.count() if weight is None else head.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= rows else df


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def utf8_view(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of an Arrow string column without copying texts; nulls are empty."""
    import pyarrow as pa

    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:  # a null may cover bytes: leave them out
        length = np.diff(offsets)
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        if (length[~valid] > 0).any():
            return utf8_view(pa.array(column.fill_null("")))
    return bytes_, offsets
