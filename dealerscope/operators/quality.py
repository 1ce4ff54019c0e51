"""Integrity checks. Each yields ``(check_name, failures)``; a suite is their union."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealerscope.operators.rollups import contradicts_receipts, receipts_by_order
from dealerscope.sources.schemas import INPUT, TableSet
from dealerscope.sources.tables import Loaded


class QualityError(ValueError):
    """Raised by a load whose integrity checks found failures."""


def is_missing(columns: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns))


def is_negative(columns: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.col(c) < 0 for c in columns))


def outside_domain(column: str, allowed: Iterable[str]) -> Column:
    return ~F.col(column).isin(list(allowed))


def outside_range(column: str, lo: int, hi: int) -> Column:
    return ~F.col(column).between(lo, hi)


def row_checks(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Failing rows per predicate, all predicates in a single scan of ``df``."""
    counts = df.agg(*(F.count_if(F.coalesce(p, F.lit(False))).alias(f"c{i}") for i, p in enumerate(checks.values())))
    rows = [
        F.struct(F.lit(name).alias("check_name"), F.col(f"c{i}").alias("failures")) for i, name in enumerate(checks)
    ]
    return counts.select(F.inline(F.array(*rows)))


def orphans(child: DataFrame, parents: Mapping[str, DataFrame], name: str) -> DataFrame:
    """Child rows for which any of the foreign keys (null included) has no parent row.

    Rows are counted per key combination first, so what is joined to the parents is one
    row per combination, however many rows a popular key has. Each parent's distinct keys are
    joined to the combinations once, and a combination counts once if it lacks any of them.
    """
    combinations = child.groupBy(*parents).agg(F.count(F.lit(1)).alias("_rows")).withColumn("_whole", F.lit(True))
    for key, parent in parents.items():
        known = parent.select(key).distinct().withColumn("_known", F.lit(True))
        whole = F.col("_whole") & F.coalesce("_known", F.lit(False))
        combinations = combinations.join(known, key, "left").withColumn("_whole", whole).drop(key, "_known")
    broken = F.coalesce(F.sum(F.when(~F.col("_whole"), F.col("_rows"))), F.lit(0)).alias("failures")
    return combinations.agg(broken).select(F.lit(name).alias("check_name"), "failures")


def reconciliation(orders: DataFrame, payments: DataFrame, name: str) -> DataFrame:
    """Orders whose status contradicts their receipts, see :func:`contradicts_receipts`."""
    received = F.coalesce(F.col("received"), F.lit(0).cast("decimal(38,2)"))
    wrong = contradicts_receipts(F.col("payment_status"), F.col("total_amount"), received)
    joined = orders.select("order_id", "payment_status", "total_amount").join(
        receipts_by_order(payments), "order_id", "left"
    )
    return row_checks(joined, {name: wrong})


def balance_reconciliation(balance: DataFrame, name: str) -> DataFrame:
    """:func:`reconciliation` from a stored order balance."""
    failures = F.coalesce(F.sum("contradictions"), F.lit(0)).alias("failures")
    return balance.agg(failures).select(F.lit(name).alias("check_name"), "failures")


def duplicate_keys(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Key values that occur more than once."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > 1)
    return repeated.agg(F.count(F.lit(1)).alias("failures")).select(F.lit(name).alias("check_name"), "failures")


def count_between(df: DataFrame, lo: int, hi: int, name: str) -> DataFrame:
    """One failure if the number of rows is outside the inclusive bounds."""
    count = F.count(F.lit(1))
    return df.agg(F.when(count.between(lo, hi), 0).otherwise(1).cast("bigint").alias("failures")).select(
        F.lit(name).alias("check_name"), "failures"
    )


def presence(df: DataFrame, condition: Column, name: str) -> DataFrame:
    """``(check_name, present)``: is there any such row? Reading stops at the first one."""
    hit = df.filter(condition).select(F.lit(1)).limit(1)
    return hit.agg((F.count(F.lit(1)) > 0).alias("present")).select(F.lit(name).alias("check_name"), "present")


def low_stock_present(inventory_status: DataFrame) -> DataFrame:
    return presence(inventory_status, F.col("is_below_reorder"), "some product is below its reorder level")


def old_overdue_present(orders: DataFrame, as_of: Column) -> DataFrame:
    old = (F.col("payment_status") == "Overdue") & (F.col("order_date") < F.date_sub(as_of, 90))
    return presence(orders, old, "some overdue order is older than 90 days")


def union_checks(checks: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def row_rules(table: str, columns: Sequence[str], source: TableSet = INPUT) -> dict[str, Column]:
    """What every row of an input table must not be, by name of the check."""
    optional = source.nullable.get(table, ())
    rules = {f"{table}: missing required value": is_missing([c for c in columns if c not in optional])}
    if table in source.strict:
        rules[f"{table}: missing relationship key"] = is_missing(source.foreign_keys[table])
    if table in source.amounts:
        rules[f"{table}: negative amount"] = is_negative(source.amounts[table])
    for (owner, column), allowed in source.domains.items():
        if owner == table:
            rules[f"{table}.{column}: unknown value"] = outside_domain(column, allowed)
    for (owner, column), (lo, hi) in source.ranges.items():
        if owner == table:
            rules[f"{table}.{column}: out of range"] = outside_range(column, lo, hi)
    return rules


def reference_check(tables: Mapping[str, DataFrame], table: str, source: TableSet = INPUT) -> DataFrame:
    """Orphans of one table. Strict tables need their references; others may lack them."""
    references = source.foreign_keys[table]
    rows = tables[table]
    if table not in source.strict:
        rows = rows.filter(~is_missing(references))
    parents = {key: tables[parent].select(F.col(source.primary_keys[parent][0]).alias(key)) for key, parent in references.items()}
    return orphans(rows, parents, f"{table}: orphan foreign key")


def key_checks(tables: Mapping[str, DataFrame], source: TableSet = INPUT) -> list[DataFrame]:
    """Duplicate keys and orphans: the checks that compare rows with other rows."""
    checks = [duplicate_keys(tables[n], keys, f"{n}: duplicate key") for n, keys in source.primary_keys.items()]
    return checks + [reference_check(tables, name, source) for name in source.foreign_keys]


_CONTRADICTION = "sales_orders: status contradicts receipts"


def run_suite(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Every check on the nine tables; they are clean if all failures are zero.

    All row rules of a table share one scan.
    """
    checks = [row_checks(df, row_rules(name, df.columns)) for name, df in tables.items()]
    checks += key_checks(tables)
    checks.append(reconciliation(tables["sales_orders"], tables["payments"], _CONTRADICTION))
    return union_checks(checks)


def suite_after_load(loaded: Loaded, balance: DataFrame | None = None, source: TableSet = INPUT) -> DataFrame:
    """The checks of a load: the row rules as counted while it wrote, keys and references from
    the stored tables, and the reconciliation from the stored balance, if there is one."""
    spark = next(iter(loaded.tables.values())).sparkSession
    counted = spark.createDataFrame(list(loaded.failures.items()), "check_name STRING, failures BIGINT")
    checks = [counted, *key_checks(loaded.tables, source)]
    if balance is not None:
        checks.append(balance_reconciliation(balance, _CONTRADICTION))
    return union_checks(checks)


def require_clean(results: DataFrame) -> None:
    """Raise if any check failed. ``results`` has one row per check."""
    failed = results.filter(F.col("failures") > 0).orderBy("check_name").collect()
    if failed:
        raise QualityError("; ".join(f"{r.check_name} ({r.failures} rows)" for r in failed))
