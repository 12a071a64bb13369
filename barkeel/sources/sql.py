"""Ad-hoc SQL over files and frames, with parameters; views end with the engine."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class QueryEngine:
    """Registers views and runs SQL; results stay lazy.

    With a ``database`` folder, each table in it (a Parquet folder) is a view, and
    ``save`` adds one, unless the engine is read-only; without it nothing outlives
    the engine.
    """

    def __init__(self, spark: SparkSession, database: str | None = None, read_only: bool = False) -> None:
        self.spark: SparkSession | None = spark
        self.views: list[str] = []
        self.database, self.read_only = database and database.rstrip("/"), read_only
        if database is None and read_only:
            raise ValueError("a read-only engine needs a database")
        if database is not None:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(database)
            files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            if read_only and not files.exists(where):
                raise FileNotFoundError(database)
            for f in files.listStatus(where) if files.exists(where) else []:
                self.register_parquet(f.getPath().getName(), f.getPath().toString())

    def save(self, table: str, frame: DataFrame) -> None:
        """Write a frame as a table of the database and register it."""
        self._open()
        if self.database is None or self.read_only:
            raise PermissionError("the engine has no database that it may write")
        path = f"{self.database}/{self._name(table)}"
        frame.write.mode("overwrite").parquet(path)
        self.register_parquet(table, path)

    def _open(self) -> SparkSession:
        if self.spark is None:
            raise RuntimeError("the engine is closed")
        return self.spark

    def _name(self, view: str) -> str:
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", view):
            raise ValueError(f"not an identifier: {view!r}")
        return view

    def register_parquet(self, view: str, path: str, base: str | None = None) -> None:
        """Files or a glob as a view: partition columns from paths, columns united by name."""
        reader = self._open().read.option("mergeSchema", True)
        if base is not None:
            reader = reader.option("basePath", base)
        self.register_frame(view, reader.parquet(path))

    def register_frame(self, view: str, frame: DataFrame) -> None:
        self._open()
        frame.createOrReplaceTempView(self._name(view))
        self.views.append(view)

    def query(self, sql: str, parameters: Sequence[Any] | Mapping[str, Any] | None = None) -> DataFrame:
        """Run SQL with ? or :name parameters."""
        spark = self._open()
        if not parameters:
            return spark.sql(sql)
        return spark.sql(sql, args=dict(parameters) if isinstance(parameters, Mapping) else list(parameters))

    def close(self) -> None:
        if self.spark is not None:
            for v in self.views:
                self.spark.catalog.dropTempView(v)
            self.spark = None

    def __enter__(self) -> QueryEngine:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
