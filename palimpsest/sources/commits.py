"""Numbered commits in a folder of any file system that Spark reaches: what a store or an index consists of, one small JSON file for each change."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import Conflict


class Commits:
    """Commit n is a file that can be created once, so of two writers who build on n - 1 one gets n and the other a Conflict.

    Data is written before it is committed, into folders that no reader knows until a commit names them.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _file(self, n: int) -> str:
        return f"{self.path}/commits/{n:020d}.json"

    def latest(self) -> int:
        """The last number given, 0 for none."""
        fs, at = self._fs(f"{self.path}/commits")
        if not fs.exists(at):
            return 0
        names = (f.getPath().getName() for f in fs.listStatus(at))
        return max((int(x[:-5]) for x in names if x.endswith(".json") and x[:-5].isdigit()), default=0)

    def read(self, n: int) -> dict:
        """Commit ``n``; commit 0 is empty."""
        if n == 0:
            return {}
        return json.loads("".join(r[0] for r in self.spark.read.text(self._file(n), wholetext=True).collect()))

    def write(self, n: int, body: dict) -> int:
        fs, at = self._fs(self._file(n))
        try:
            out = fs.create(at, False)
        except Exception as e:  # what the file system says of a file that is there
            if fs.exists(at):
                raise Conflict(f"version {n} was written by another") from e
            raise
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        return n

    def put(self, df: DataFrame, kind: str, by: tuple[str, ...] = (), compression: str = "snappy") -> str:
        """Writes rows into a new folder of a ``kind``; its name, to be committed."""
        name = uuid.uuid4().hex
        df.write.option("compression", compression).partitionBy(*by).parquet(f"{self.path}/{kind}/part={name}")
        return name

    def get(self, kind: str, versions: dict[str, int], schema: StructType | str) -> DataFrame:
        """The rows of the named folders, with the version of each in ``_v``; the parts and partition columns of others aren't listed or read."""
        if not versions:
            return self.spark.createDataFrame([], schema).withColumn("_v", F.lit(None).cast("int"))
        at = f"{self.path}/{kind}"
        with_part = f"{schema}, part string" if isinstance(schema, str) else StructType(schema.fields).add("part", "string")
        rows = self.spark.read.schema(with_part).option("basePath", at).parquet(*(f"{at}/part={x}" for x in versions))
        numbers = F.create_map(*(F.lit(x) for kv in versions.items() for x in kv))
        return rows.withColumn("_v", F.element_at(numbers, F.col("part"))).drop("part")
