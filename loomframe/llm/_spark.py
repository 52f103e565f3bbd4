"""Session helpers shared by the operators: shared storage, batch size, workers' memory, table access."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._tokens import Encoder

#: Rows and bytes handed to a Python worker at once (one row at least); the workers cut these again (`_text.slices`).
ARROW_ROWS, ARROW_BYTES = 1000, 4 << 20


_sent: set[str] = set()


def send_code(spark: SparkSession) -> None:
    """Give the executors this package, whatever their path, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    _sent.add(sc.applicationId)
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="loomframe-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/{package.name}.zip", "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(f"{folder}/{package.name}.zip")


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches for the rest of the session: long documents make the default of 10,000 rows too much for
    a worker. By rows to ARROW_ROWS, if the setting isn't lower already, and by bytes to ARROW_BYTES."""
    send_code(spark)
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= ARROW_ROWS:
        spark.conf.set(rows, str(ARROW_ROWS))
    spark.conf.set(size, str(ARROW_BYTES))


Work = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def give_back() -> None:
    """Return what the allocators hold of freed memory to the system (C's own where it can)."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def lean(work: Work, *, encodes: bool = False) -> Work:
    """A worker's function that leaves the worker small. Workers live on beside the executor's JVM, so what one stage
    freed, or remembers, would count in all stages after it: freed memory goes back when a task ends, and a task that
    doesn't encode forgets the pieces that encoders remember."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not encodes:
            Encoder.forget()
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one where that is unset and Spark is local."""
    sc = spark.sparkContext
    if found := sc.getConf().get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if found := sc._jsc.sc().getCheckpointDir():
        if found.isDefined():
            return str(found.get()).rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="loomframe-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    sc.setCheckpointDir(f"file://{own}")
    return shared_dir(spark)


_folders: dict[str, str] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A path in this application's folder of the shared storage; the folder goes when the driver ends."""
    sc = spark.sparkContext
    if sc.applicationId not in _folders:
        folder = f"{shared_dir(spark)}/loomframe-{sc.applicationId}"
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _folders[sc.applicationId] = folder
    return f"{_folders[sc.applicationId]}/{name}-{uuid.uuid4().hex[:12]}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
