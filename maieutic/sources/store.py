"""The episode store: JSON Lines and Parquet tables that are only ever appended to, and views on their newest rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from maieutic.operators.batches import newest_per_key, tail


class Store:
    """Tables below one folder. Appending never rewrites what is there; bounded buffers are views."""

    def __init__(self, spark: SparkSession, root: str, kind: str = "parquet"):
        if kind not in ("parquet", "json"):
            raise ValueError("kind is parquet or json")
        self.spark, self.root, self.kind = spark, root.rstrip("/"), kind

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def append(self, table: str, rows: DataFrame) -> None:
        """One file a partition more; JSON keeps non-ASCII letters and null fields."""
        writer = rows.write.mode("append")
        (writer.option("ignoreNullFields", "false").json if self.kind == "json" else writer.parquet)(self._path(table))

    def read(self, table: str, schema: StructType) -> DataFrame:
        """All rows; none where the table is missing. Lines break only at line feeds and carriage returns, not inside texts."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(table))
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read.schema(schema)
        return reader.json(self._path(table)) if self.kind == "json" else reader.parquet(self._path(table))

    def count(self, table: str, schema: StructType) -> int:
        return self.read(table, schema).count()

    def last(self, table: str, schema: StructType, seq: str, n: int) -> DataFrame:
        """The n newest rows; none for 0."""
        return tail(self.read(table, schema), [seq], n)

    def buffer(self, table: str, schema: StructType, seq: str, most: int = 2048) -> DataFrame:
        """A bounded buffer: a view on the newest rows of a table that keeps all."""
        return self.last(table, schema, seq, most)

    def _versions(self, name: str) -> list[int]:
        """The complete versions of a state table, oldest first."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(name))
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        found = [f.getPath().getName() for f in fs.listStatus(at)]
        return sorted(int(v) for v in found if v.isdigit() and fs.exists(path(f"{self._path(name)}/{v}/_SUCCESS")))

    def save_state(self, name: str, state: DataFrame) -> None:
        """Replaces a small state table: writes a new version beside the last, which stays whole until the new one is, and drops older ones."""
        known = self._versions(name)
        state.coalesce(1).write.mode("overwrite").parquet(f"{self._path(name)}/{(known[-1] if known else 0) + 1:012d}")
        for v in known[:-1]:
            at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self._path(name)}/{v:012d}")
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def load_state(self, name: str, schema: StructType) -> DataFrame:
        """The last complete version; no rows where there is none."""
        known = self._versions(name)
        return self.spark.read.schema(schema).parquet(f"{self._path(name)}/{known[-1]:012d}") if known else self.spark.createDataFrame([], schema)

    def set_pointer(self, table: str, schema: StructType, name: str, value: str | None) -> None:
        """Sets the value of a name, null too: one row more, with the next seq."""
        last = self.read(table, schema).agg({"seq": "max"}).first()[0] or 0
        self.append(table, self.spark.createDataFrame([(name, value, last + 1)], "name string, value string, seq long"))

    def pointers(self, table: str, schema: StructType) -> DataFrame:
        """The newest value of each name."""
        return newest_per_key(self.read(table, schema), "name", "value", "seq")
