"""CSV and Parquet tables: read, full-refresh write, load, count."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dealerscope.sources.schemas import INPUT, TableSet

Rules = Callable[[str, Sequence[str]], Mapping[str, Column]]


def read_csv_table(spark: SparkSession, name: str, folder: str, tables: TableSet = INPUT) -> DataFrame:
    """``{folder}/{name}.csv`` with its declared types; a bad value or header fails the read."""
    return (
        spark.read.schema(tables.schema(name))
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(f"{folder.rstrip('/')}/{name}.csv")
    )


def read_table(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """The Parquet table ``{folder}/{name}`` as written by :func:`write_replace`."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}")


def clustered(df: DataFrame, by: Iterable[str] = ()) -> DataFrame:
    """``df`` range-partitioned and sorted by some columns, or as it is without any.

    A later filter on the leading column then skips files and row groups by their min/max
    statistics. Ending the list with a unique key lets a hot leading value spread over several files.
    """
    keys = list(by)
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df


def write_replace(df: DataFrame, path: str, cluster_by: Iterable[str] = ()) -> None:
    """Replace the contents of the Parquet table at ``path``, see :func:`clustered`."""
    clustered(df, cluster_by).write.mode("overwrite").parquet(path)


def write_result(df: DataFrame, schema_ddl: str, path: str) -> None:
    """Cast to the declared result types, in the declared column order, and replace."""
    fields = StructType.fromDDL(schema_ddl).fields
    write_replace(df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in fields)), path)


@dataclass(frozen=True)
class Loaded:
    """Stored tables, and what was counted while their rows were written."""

    tables: dict[str, DataFrame]
    counts: dict[str, int]  # rows of each table
    failures: dict[str, int]  # failing rows of each rule


def load_table(
    spark: SparkSession, name: str, csv_folder: str, out_folder: str, rules: Mapping[str, Column] | None = None, tables: TableSet = INPUT
) -> Loaded:
    """Full refresh of one table from its CSV.

    Rows and failing rows are counted as the rows pass on their way to the files, so that
    no count and no rule about single rows reads the table again.
    """
    rules = dict(rules or {})
    frame = clustered(read_csv_table(spark, name, csv_folder, tables), tables.clustering.get(name, ()))
    seen = Observation(f"load {name}")
    failing = (F.count_if(F.coalesce(rule, F.lit(False))).alias(f"rule_{i}") for i, rule in enumerate(rules.values()))
    observed = frame.observe(seen, F.count(F.lit(1)).alias("rows"), *failing)
    write_replace(observed, f"{out_folder.rstrip('/')}/{name}")
    found = seen.get
    failures = {rule: found[f"rule_{i}"] for i, rule in enumerate(rules)}
    return Loaded({name: read_table(spark, name, out_folder)}, {name: found["rows"]}, failures)


def load_tables(
    spark: SparkSession, csv_folder: str, out_folder: str, rules: Rules | None = None, tables: TableSet = INPUT
) -> Loaded:
    """Full refresh: every CSV is read with its schema and replaces its Parquet table.

    All inputs are resolved before the first write, so a missing file changes nothing.
    ``rules`` gives the rules about the rows of a table from its name and columns.
    """
    columns = {name: read_csv_table(spark, name, csv_folder, tables).columns for name in tables.ddl}
    out = Loaded({}, {}, {})
    for name in tables.ddl:
        one = load_table(spark, name, csv_folder, out_folder, rules(name, columns[name]) if rules else None, tables)
        out.tables.update(one.tables)
        out.counts.update(one.counts)
        out.failures.update(one.failures)
    return out


def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One row per table: ``table_name``, ``row_count``."""
    counts = [
        df.groupBy().agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


# Fixed value: the status text of a finished load.
REFRESH_STATUS = "ETL completed; standard views require no refresh"


def refresh_status(orders: DataFrame) -> DataFrame:
    """What a finished load reports: a status text and the number of orders."""
    return orders.groupBy().agg(
        F.lit(REFRESH_STATUS).alias("status"),
        F.count(F.lit(1)).alias("order_count"),
    )
