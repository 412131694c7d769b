"""Indices by name: registration, wildcards, aliases, columns."""

from __future__ import annotations

import fnmatch
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracelode.functions.series import metric_name, tag_entries
from tracelode.lang.lex import QueryError


class Catalog:
    """Index name -> DataFrame, with its time column and the columns that break ties of time."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._tables: dict[str, tuple[DataFrame | Callable[[], DataFrame], str | None, list[str]]] = {}
        self._aliases: dict[str, set[str]] = {}

    def register(self, name: str, df: DataFrame | Callable[[], DataFrame], time: str | None = None, tie: list[str] | None = None) -> None:
        """``df`` may be a function: its source is opened when a query first names the index."""
        self._tables[name] = (df, time, tie or [])

    def names(self) -> list[str]:
        return sorted(self._tables)

    def table(self, name: str) -> DataFrame:
        df, time, tie = self._tables[name]
        if not isinstance(df, DataFrame):
            df = df()
            self._tables[name] = (df, time, tie)
        return df

    def drop(self, name: str) -> None:
        self._tables.pop(name, None)
        for s in self._aliases.values():
            s.discard(name)

    def put(self, name: str, rows: DataFrame, key: str) -> None:
        """Indexes or updates rows: those with an equal ``key`` are replaced.  The index becomes a plan over
        what it was and the rows, so many small changes belong into a table first."""
        _, time, tie = self._tables[name]
        old = self.table(name).join(rows.select(F.col(key).alias("__key")), F.col(key) == F.col("__key"), "left_anti")
        self._tables[name] = (old.unionByName(rows, allowMissingColumns=True), time, tie)

    def delete(self, name: str, key: str, *values: object) -> None:
        """Takes out the rows whose ``key`` is one of the values."""
        _, time, tie = self._tables[name]
        self._tables[name] = (self.table(name).where(~F.coalesce(F.col(key).isin(*values), F.lit(False))), time, tie)

    def alias(self, alias: str, *names: str) -> None:
        self._aliases.setdefault(alias, set()).update(names)

    def indices(self) -> list[tuple[str, DataFrame]]:
        return [(n, self.table(n)) for n in self.names()]

    def columns(self, name: str) -> list[str]:
        return self.resolve(name)[0].columns

    def resolve(self, pattern: str) -> tuple[DataFrame, str | None, list[str]]:
        """Names, wildcards and comma lists; several indices are united by column name."""
        names: list[str] = []
        for p in pattern.split(","):
            for a in [n for n in [*self._aliases, *self._tables] if fnmatch.fnmatchcase(n, p.strip())]:
                names += [n for n in (sorted(self._aliases[a]) if a in self._aliases else [a]) if n not in names]
        if not names:
            raise QueryError(f"no index {pattern!r}")
        _, time, tie = self._tables[names[0]]
        df = self.table(names[0])
        for n in names[1:]:
            df = df.unionByName(self.table(n), allowMissingColumns=True)
        return df, time, tie

    def show_tables(self) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in self.names()], "name string")

    def show_columns(self, name: str) -> DataFrame:
        return self.spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in self.resolve(name)[0].schema.fields], "name string, type string")


# Names and tags are listed in the spelling that tells series apart: other characters than letters, digits
# and _ stand for _, a tag with an empty value is no tag, and client ids are cleaned.


def metric_names(metrics: DataFrame) -> DataFrame:
    return metrics.select(metric_name(F.col("metric")).alias("metric")).distinct()


def _tags(metrics: DataFrame) -> DataFrame:
    return metrics.where("tags is not null").select(F.explode(tag_entries(F.col("tags"))).alias("t")).select("t.key", "t.value")


def tag_keys(metrics: DataFrame) -> DataFrame:
    return _tags(metrics).select("key").distinct()


def tag_values(metrics: DataFrame, key: str) -> DataFrame:
    return _tags(metrics).where(F.col("key") == key).select("value").distinct()


def series(metrics: DataFrame) -> DataFrame:
    return metrics.select(metric_name(F.col("metric")).alias("metric"), tag_entries(F.col("tags")).alias("tags")).distinct()


def cardinality(metrics: DataFrame) -> DataFrame:
    return series(metrics).agg(F.count("*").alias("series"))


def tag_keys_with_most_series(metrics: DataFrame, limit: int = 10) -> DataFrame:
    s = series(metrics).select(F.explode("tags").alias("t"))
    return s.groupBy(F.col("t.key").alias("key")).agg(F.count("*").alias("series")).orderBy(F.desc("series"), "key").limit(limit)


def tag_pairs_with_most_series(metrics: DataFrame, limit: int = 10) -> DataFrame:
    s = series(metrics).select(F.explode("tags").alias("t"))
    return s.groupBy(F.col("t.key").alias("key"), F.col("t.value").alias("value")).agg(F.count("*").alias("series")).orderBy(F.desc("series"), "key", "value").limit(limit)


def tag_keys_with_most_values(metrics: DataFrame, limit: int = 10) -> DataFrame:
    t = _tags(metrics).distinct()
    return t.groupBy("key").agg(F.count("*").alias("values")).orderBy(F.desc("values"), "key").limit(limit)
