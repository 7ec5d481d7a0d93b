"""Records in a SQL database: created where they are missing, read in bounded parts, and changed through a staging table in one transaction."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Config, DimensionMismatch, NotFound
from .snapshots import load_text_layout

#: Parts that ids are hashed into, by which a table is read.
BUCKETS = 1024
_COLUMNS = ("bucket", "vector", "payload")


def upsert_sql(dialect: str, table: str, staged: str) -> list[str]:
    """The statements that take ``staged`` rows over: what any database has, or ON CONFLICT."""
    every = ", ".join(f'"{c}"' for c in ("id", *_COLUMNS))
    if dialect == "replace":
        return [f'DELETE FROM {table} WHERE "id" IN (SELECT "id" FROM {staged})', f"INSERT INTO {table} ({every}) SELECT {every} FROM {staged}"]
    if dialect == "conflict":
        sets = ", ".join(f'"{c}" = excluded."{c}"' for c in _COLUMNS)
        return [f'INSERT INTO {table} ({every}) SELECT {every} FROM {staged} WHERE true ON CONFLICT ("id") DO UPDATE SET {sets}']
    raise Config("a dialect is replace or conflict")


class SqlStore:
    """A table of id, bucket (a hash of the id), and vector and payload as JSON texts, at a JDBC ``url``.

    Spark writes rows to a staging table over at most ``connections`` connections; the driver then takes them over, so readers see all of a
    change or nothing, and a repeated task can't store a row twice. ``text`` is the database's type for long texts.
    """

    def __init__(self, spark: SparkSession, url: str, table: str, dimension: int, dialect: str = "replace", text: str = "CLOB", connections: int = 8, properties: dict[str, str] | None = None):
        if not table.replace("_", "").isalnum() or table[0].isdigit():
            raise Config("a table's name has letters, digits and underlines")
        self.spark, self.url, self.table, self.dimension = spark, url, table, dimension
        self.dialect, self.text, self.connections, self.properties = dialect, text, connections, properties or {}
        upsert_sql(dialect, table, table)

    def _connected(self, use: Callable) -> object:
        """What ``use`` makes of a connection, in one transaction."""
        props = self.spark._jvm.java.util.Properties()
        for k, v in self.properties.items():
            props.setProperty(k, v)
        link = self.spark._jvm.java.sql.DriverManager.getConnection(self.url, props)
        try:
            link.setAutoCommit(False)
            out = use(link)
            link.commit()
            return out
        except BaseException:
            link.rollback()
            raise
        finally:
            link.close()

    @staticmethod
    def _run(link, sql: str) -> int:
        statement = link.createStatement()
        try:
            return statement.executeUpdate(sql)
        finally:
            statement.close()

    def _has(self, link, table: str) -> bool:
        names = link.getMetaData().getTables(None, None, None, None)
        found = False
        while names.next():
            found = found or names.getString("TABLE_NAME").lower() == table.lower()
        return found

    def create(self) -> None:
        """The table and an index of its buckets, unless they are there."""

        def make(link) -> None:
            if not self._has(link, self.table):
                self._run(link, f'CREATE TABLE {self.table} ("id" VARCHAR(512) NOT NULL PRIMARY KEY, "bucket" INTEGER NOT NULL, "vector" {self.text} NOT NULL, "payload" {self.text} NOT NULL)')
                self._run(link, f'CREATE INDEX {self.table}_buckets ON {self.table} ("bucket")')

        self._connected(make)

    def load(self, parts: int = 16) -> DataFrame:
        """All memories, in ``parts`` reads of a range of buckets each."""
        edges = [BUCKETS * i // parts for i in range(parts + 1)]
        ranges = [f'"bucket" >= {a} AND "bucket" < {b}' for a, b in zip(edges, edges[1:], strict=False)]
        return load_text_layout(self.spark.read.jdbc(self.url, self.table, predicates=ranges, properties={"fetchsize": "1000", **self.properties}))

    def get(self, id_: str) -> DataFrame:
        """One memory; the database looks it up."""
        quoted = id_.replace("'", "''")
        return load_text_layout(self.spark.read.jdbc(self.url, self.table, predicates=[f"\"id\" = '{quoted}'"], properties=self.properties))

    def _staged(self, rows: DataFrame, use: Callable) -> object:
        """``use(link, staging table)`` over ``rows`` with an id, in the transaction that drops the table at its end."""
        staged = f"staged_{uuid.uuid4().hex[:16]}"
        try:
            rows.coalesce(self.connections).write.format("jdbc").options(url=self.url, dbtable=staged, batchsize=1000, createTableColumnTypes="id VARCHAR(512)", **self.properties).save()
            return self._connected(lambda link: use(link, staged))
        finally:
            self._connected(lambda link: self._has(link, staged) and self._run(link, f"DROP TABLE {staged}"))

    def insert(self, records: DataFrame) -> int:
        """Stores ``records`` (id, vector, payload) in place of those of their ids; how many rows. Of records that share an id the last by payload counts."""
        wrong = records.where(F.coalesce(F.size("vector"), F.lit(-1)) != self.dimension).select(F.size("vector").alias("n")).first()
        if wrong is not None:
            raise DimensionMismatch(self.dimension, wrong["n"])
        one = records.groupBy("id").agg(F.max_by(F.struct("vector", "payload"), F.coalesce(F.to_json("payload"), F.lit(""))).alias("r"))
        rows = one.select("id", F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int").alias("bucket"), F.to_json("r.vector").alias("vector"), F.coalesce(F.to_json("r.payload"), F.lit("{}")).alias("payload"))
        return self._staged(rows, lambda link, staged: [self._run(link, x) for x in upsert_sql(self.dialect, self.table, staged)][-1])

    def update(self, records: DataFrame) -> int:
        """``insert`` of known ids; one that isn't known is an error, and nothing changes."""
        unknown = records.select("id").join(self.load().select("id"), "id", "left_anti").first()
        if unknown is not None:
            raise NotFound(unknown["id"])
        return self.insert(records)

    def delete(self, ids: DataFrame) -> int:
        """Without the records of ``ids`` (id); how many went."""
        return self._staged(ids.select("id").distinct(), lambda link, staged: self._run(link, f'DELETE FROM {self.table} WHERE "id" IN (SELECT "id" FROM {staged})'))

    def reset(self) -> int:
        return self._connected(lambda link: self._run(link, f"DELETE FROM {self.table}"))
