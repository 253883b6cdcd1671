"""SQL text of a chain of steps, for views that outlive their session.

A catalog view is kept as SQL, while the jobs are written as Columns.
:class:`SqlSteps` takes the same Columns: it resolves them against an empty
DataFrame with a step's columns and writes them as Spark prints resolved
expressions, so a rule has one definition. Each step becomes one named query.
No step runs a job; the relations' schemas are all that is read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from devicelens.sources.schema import typed


class SqlSteps:
    """Named queries, each over stored relations or earlier steps."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._bodies: dict[str, str] = {}
        self._frames: dict[str, DataFrame] = {}

    def stored(self, name: str, relation: str, logical: str, trim: bool = True) -> None:
        """A stored table (any relation SQL can name), typed as its logical table is declared."""
        read = typed(self._empty(self.spark.table(relation)), logical, trim=trim)
        self._add(name, f"SELECT {self._list(read, 'projectList')} FROM {relation}", read)

    def select(self, name: str, source: str, columns: Sequence, where: Column | None = None, distinct: bool = False) -> None:
        frame = self._frames[source]
        rows = frame.select(*columns)
        kept = "" if where is None else " WHERE " + self._plan(frame.where(where)).condition().sql()
        self._add(name, f"SELECT {'DISTINCT ' if distinct else ''}{self._list(rows, 'projectList')} FROM {self._step(source)}{kept}", rows)

    def union(self, name: str, first: str, second: str) -> None:
        """All rows of two steps with the same columns."""
        self._add(name, f"SELECT * FROM {self._step(first)} UNION ALL SELECT * FROM {self._step(second)}",
                  self._frames[first].union(self._frames[second]))

    def aggregate(self, name: str, source: str, keys: Sequence[str], columns: Sequence[Column]) -> None:
        rows = self._frames[source].groupBy(*keys).agg(*columns)
        by = ", ".join(f"`{k}`" for k in keys)
        self._add(name, f"SELECT {self._list(rows, 'aggregateExpressions')} FROM {self._step(source)} GROUP BY {by}", rows)

    def attach(self, name: str, source: str, key: str, dimension: str, dim_key: str, columns: Mapping[str, str],
               how: str = "LEFT") -> None:
        """``source`` joined to ``dimension``, with the dimension's ``columns`` (column -> new name)."""
        left, right = self._frames[source], self._frames[dimension]
        more = [F.lit(None).cast(right.schema[c].dataType).alias(n) for c, n in columns.items()]
        added = "".join(f", d.`{c}` AS `{n}`" for c, n in columns.items())
        self._add(name, f"SELECT s.*{added} FROM {self._step(source)} AS s "
                        f"{how} JOIN {self._step(dimension)} AS d ON s.`{key}` = d.`{dim_key}`",
                  left.select("*", *more))

    def repeat(self, name: str, source: str, key: str, dimension: str, dim_key: str, where: Column | None = None) -> None:
        """The row effect of a left join alone (see ``joins.repeat_rows``)."""
        self.select(f"{name}_keys", dimension, [dim_key], where)
        counts = (f"SELECT `{dim_key}` AS k, count(*) AS n FROM {self._step(name)}_keys WHERE `{dim_key}` IS NOT NULL "
                  f"GROUP BY `{dim_key}` HAVING count(*) > 1")
        self._add(f"{name}_repeats", f"SELECT k, explode(sequence(1, CAST(n AS INT))) AS copy FROM ({counts})",
                  self._frames[f"{name}_keys"])
        self._add(name, f"SELECT s.* FROM {self._step(source)} AS s "
                        f"LEFT JOIN {self._step(name)}_repeats AS d ON s.`{key}` = d.k", self._frames[source])

    def deal(self, name: str, source: str, keys: Sequence[str]) -> None:
        """``source`` dealt by keys that later groupings contain."""
        by = ", ".join(f"`{k}`" for k in keys)
        self._add(name, f"SELECT /*+ REPARTITION({by}) */ * FROM {self._step(source)}", self._frames[source])

    def spread(self, name: str, source: str, column: str, as_name: str) -> None:
        """A row for each element of an array ``column``, one with NULL where it has none; the element comes last."""
        frame = self._frames[source]
        kept = [c for c in frame.columns if c != column]
        self._add(name, f"SELECT {', '.join(f'`{c}`' for c in kept)}, explode_outer(`{column}`) AS `{as_name}` FROM {self._step(source)}",
                  frame.select(*kept, F.explode_outer(column).alias(as_name)))

    def columns(self, name: str) -> list[str]:
        return self._frames[name].columns

    def text(self, name: str) -> str:
        """One statement that returns the step's rows."""
        return "WITH " + ",\n".join(f"{self._step(n)} AS (\n  {body}\n)" for n, body in self._bodies.items()) + f"\nSELECT * FROM {self._step(name)}"

    def _empty(self, df: DataFrame) -> DataFrame:
        return self.spark.createDataFrame([], df.schema)

    def _add(self, name: str, body: str, rows: DataFrame) -> None:
        if name in self._bodies:
            raise ValueError(f"there is a step {name} already")
        self._bodies[name], self._frames[name] = body, self._empty(rows)

    @staticmethod
    def _step(name: str) -> str:
        """The query's name in the statement, which no relation should have."""
        return f"step_{name}"

    @staticmethod
    def _plan(df: DataFrame):
        return df._jdf.queryExecution().analyzed()

    def _list(self, df: DataFrame, of: str) -> str:
        named = getattr(self._plan(df), of)()
        return ", ".join(named.apply(i).sql() for i in range(named.size()))


def create_view(spark: SparkSession, name: str, body: str) -> DataFrame:
    """Create or replace a persistent view; every session reads its relations as they are then."""
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS\n{body}")
    return spark.table(name)
