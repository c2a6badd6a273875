"""The way in: tables of a folder, guarded Oracle-flavoured SQL, pages and counts."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

from .plans.lexer import is_read_only
from .plans.rewrite import NotUnderstood, to_spark

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


class Workbench:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def translated(self, text: str, empty_is_null: bool = False) -> str:
        """The query in Spark SQL; {name} stands for a table of the folder. Anything but a query that locks nothing is refused."""
        dates: set[str] = set()
        for name in TABLES:
            if f"{{{name}}}" in text:
                view = f"wb_{name}_{zlib.crc32(self.folder.encode()):08x}"
                df = self.table(name)
                df.createOrReplaceTempView(view)
                dates.update(f.name for f in df.schema if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)))
                text = text.replace(f"{{{name}}}", view)
        if not is_read_only(text):
            raise PermissionError("only queries that lock no rows are run")
        return to_spark(text, dates, empty_is_null)

    def sql(self, text: str, empty_is_null: bool = False, **args) -> DataFrame:
        """Runs a query; binds (:name) are given by name."""
        return self.spark.sql(self.translated(text, empty_is_null), args=args or None)

    def first_rows(self, text: str, most: int = 500, **args) -> tuple[list[Row], bool]:
        """(at most `most` rows, whether there are more): one row more is asked for, and not shown."""
        got = self.sql(text, **args).limit(most + 1).collect()
        return got[:most], len(got) > most

    def count(self, text: str, **args) -> int:
        """How many rows a query gives."""
        return self.sql(text, **args).count()

    def load(self, text: str, most: int, group: str = "load", **args) -> tuple[list[Row], bool]:
        """(up to `most` rows, whether there are more) under a job group, which `cancel` ends from another thread."""
        context = self.spark.sparkContext
        context.setJobGroup(group, text[:200], interruptOnCancel=True)
        try:
            return self.first_rows(text, most, **args)
        finally:
            context.setLocalProperty("spark.jobGroup.id", None)

    def cancel(self, group: str = "load") -> None:
        self.spark.sparkContext.cancelJobGroup(group)

    def stream(self, text: str, **args) -> Iterator[Row]:
        """All rows, a partition at a time, beside whatever else runs."""
        return self.sql(text, **args).toLocalIterator(prefetchPartitions=True)

    def beside(self, folder: str) -> Workbench:
        """A workbench over another folder; its queries are as read-only as these."""
        return Workbench(self.spark, folder)

    def attach(self, name: str, df: DataFrame) -> None:
        """Gives a table from elsewhere (a link, another catalog) a name that queries can use."""
        if not name.isidentifier():
            raise ValueError(f"not a name: {name}")
        df.createOrReplaceTempView(name)

    def use(self, database: str) -> None:
        """The current schema, for names without one."""
        self.spark.catalog.setCurrentDatabase(database)

    def explain(self, text: str, **args) -> str:
        """The plan of a query, as text; nothing runs."""
        return self.sql(text, **args)._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))

    def problem(self, text: str, **args) -> str | None:
        """What is wrong with a query before it runs: unknown names, syntax, types; None if it can run."""
        try:
            self.sql(text, **args).schema  # noqa: B018
        except (PermissionError, NotUnderstood, PySparkException) as e:
            return str(e).strip().split("\n")[0]
        return None
