"""Join-key audits.

Several sales joins use keys whose uniqueness is not declared; a repeated
key multiplies fact rows before they are summed. The audit reports every
key value that occurs more than once, per table, so fan-out is visible
instead of silently "fixed".
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def key_multiplicity(df: DataFrame, keys, table: str) -> DataFrame:
    """(table, key_value, row_count) for keys present more than once.

    One aggregation with map-side partial counts, so a hot key costs one
    counter per map task, never one task holding the key's rows.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    key_text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("<null>"))
                                  for k in keys])
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
            .where(F.col("row_count") > 1)
            .select(F.lit(table).alias("table_name"), key_text.alias("key_value"),
                    F.col("row_count")))


def key_multiplicities(audits: list[tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """:func:`key_multiplicity` of many keys in one aggregation and one scan a table.

    Each entry is a table with its audited columns, as ``column -> name``. A
    row gives one (name, key) pair per audited column, and all pairs of all
    tables are counted together: partial counts stand before the only shuffle,
    which pairs of (name, key) spread whatever the tables' sizes. A NULL key
    is counted apart from the text it prints as.
    """
    pairs = [df.select(F.explode(F.array(*[
        F.struct(F.lit(name).alias("table_name"), F.col(column).cast("string").alias("key_value"))
        for column, name in names.items()])).alias("pair")).select("pair.*") for df, names in audits]
    return (reduce(DataFrame.unionByName, pairs).groupBy("table_name", "key_value")
            .agg(F.count(F.lit(1)).alias("row_count")).where(F.col("row_count") > 1)
            .select("table_name", F.coalesce("key_value", F.lit("<null>")).alias("key_value"), "row_count"))
