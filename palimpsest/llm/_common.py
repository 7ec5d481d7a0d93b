"""Session helpers of the operators: the shared folder, materialised tables, Arrow batches of texts."""

from __future__ import annotations

import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: Words are runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Text that one step of a Python worker holds at a time, unless a single text is longer.
BLOCK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Set here only where it is unset and the master is local."""
    ship(spark)
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Parquet tables in the shared folder that cut lineage; ``drop`` removes them once nothing reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.paths.append(path := new_path(self.spark, name))
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self, *names: str, last: int = 0) -> None:
        """Removes kept tables of these names, of each but the ``last`` ones, that nothing reads any more."""
        for name in names:
            found = [p for p in self.paths if re.fullmatch(re.escape(name) + "-[0-9a-f]{32}", p.rsplit("/", 1)[-1])]
            self._delete(gone := found[: len(found) - last])
            self.paths = [p for p in self.paths if p not in gone]

    def free_shuffles(self) -> None:
        """Lets go of the shuffle files of steps that are done: Spark removes them when the driver collects its garbage, which large inputs don't make it do any sooner."""
        import gc

        gc.collect()
        self.spark._jvm.System.gc()

    def _delete(self, paths: list[str]) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in paths:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)

    def drop(self) -> None:
        self._delete(self.paths)
        self.paths = []


def local_path(uri: str) -> str:
    """The mounted path of a file: URI, for memory maps; other stores can't be mapped."""
    if "://" in uri and not uri.startswith("file:"):
        raise ValueError(f"memory-mapped files need a mounted shared folder, not {uri}")
    return uri.removeprefix("file://").removeprefix("file:") if uri.startswith("file:") else uri


def remove(uri: str) -> None:
    shutil.rmtree(local_path(uri), ignore_errors=True)


def crc32_text(column: Column) -> Column:
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")))


def _give_back() -> None:
    """Returns freed memory to the system: a worker that waits for its next task holds no more than it needs."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def text_blocks(batches: Iterator, limit: int = BLOCK_BYTES) -> Iterator:
    """Slices of record batches with a column ``text`` of ``limit`` bytes or a single row."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    try:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False)
            total, at = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(total, total[at] + limit, "right")) - 1)
                yield pa.RecordBatch.from_arrays([x.slice(at, to - at) for x in batch.columns], schema=batch.schema)
                at = to
    finally:
        _give_back()
