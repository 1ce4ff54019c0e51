"""Column types, keys and rules of the nine input tables, the star tables and the two result tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql.types import StructType

# Names, order and types of the input columns.
INPUT_DDL = {
    "dealers": (
        "dealer_id INT, dealer_name STRING, dealer_type STRING, region STRING, district STRING, "
        "credit_limit DECIMAL(12,2), onboarding_date DATE"
    ),
    "products": (
        "product_id INT, product_name STRING, category STRING, target_crop STRING, pack_size STRING, "
        "mrp DECIMAL(10,2), dealer_price DECIMAL(10,2), shelf_life_months INT"
    ),
    "suppliers": "supplier_id INT, supplier_name STRING, region STRING, lead_time_days INT",
    "raw_materials": (
        "material_id INT, material_name STRING, supplier_id INT, unit_cost DECIMAL(10,2), "
        "current_stock DECIMAL(12,2)"
    ),
    "crop_calendar": "crop STRING, region STRING, sowing_month INT, peak_demand_month INT",
    "production_batches": (
        "batch_id INT, product_id INT, production_date DATE, quantity_produced DECIMAL(12,2), qc_status STRING"
    ),
    "inventory": (
        "inventory_id INT, product_id INT, batch_no STRING, mfg_date DATE, expiry_date DATE, "
        "quantity_available DECIMAL(12,2), reorder_level DECIMAL(12,2)"
    ),
    "sales_orders": (
        "order_id INT, order_date DATE, dealer_id INT, product_id INT, quantity INT, unit_price DECIMAL(10,2), "
        "discount_pct DECIMAL(5,2), total_amount DECIMAL(12,2), dispatch_date DATE, payment_status STRING"
    ),
    "payments": (
        "payment_id INT, order_id INT, amount_received DECIMAL(12,2), payment_date DATE, payment_mode STRING"
    ),
}

# Columns of the stored results; the backtest's are our own.
RESULT_DDL = {
    "demand_forecast_results": (
        "product_id INT, model_used STRING, mape DECIMAL(10,4), rmse DECIMAL(12,4), seasonal_mape DECIMAL(10,4), "
        "boosted_mape DECIMAL(10,4), forecast_week DATE, predicted_qty DECIMAL(12,2), actual_qty DECIMAL(12,2)"
    ),
    "backtest_results": (
        "product_id BIGINT, fold INT, model_used STRING, mape DECIMAL(10,4), rmse DECIMAL(12,4), last_mape DECIMAL(10,4), "
        "mean_mape DECIMAL(10,4), forecast_week DATE, predicted_qty DECIMAL(12,2), actual_qty DECIMAL(12,2)"
    ),
    "dealer_segments": (
        "dealer_id INT, recency INT, frequency INT, monetary DECIMAL(14,2), cluster_id INT, segment_label STRING"
    ),
}

# Keys.
PRIMARY_KEYS = {
    "dealers": ("dealer_id",),
    "products": ("product_id",),
    "suppliers": ("supplier_id",),
    "raw_materials": ("material_id",),
    "crop_calendar": ("crop", "region"),
    "production_batches": ("batch_id",),
    "inventory": ("inventory_id",),
    "sales_orders": ("order_id",),
    "payments": ("payment_id",),
}

# Child table -> {foreign key column: parent table}
FOREIGN_KEYS = {
    "raw_materials": {"supplier_id": "suppliers"},
    "production_batches": {"product_id": "products"},
    "inventory": {"product_id": "products"},
    "sales_orders": {"dealer_id": "dealers", "product_id": "products"},
    "payments": {"order_id": "sales_orders"},
}

# Fixed values: (table, column) -> permitted values
DOMAINS = {
    ("dealers", "dealer_type"): ("Distributor", "Retailer"),
    ("production_batches", "qc_status"): ("Passed", "Failed", "Pending"),
    ("sales_orders", "payment_status"): ("Paid", "Partial", "Overdue"),
}

# Fixed values: (table, column) -> inclusive range
RANGES = {
    ("crop_calendar", "sowing_month"): (1, 12),
    ("crop_calendar", "peak_demand_month"): (1, 12),
}

# Columns that may be empty; every other column of an input table is required.
NULLABLE = {
    "raw_materials": ("supplier_id",),
    "production_batches": ("product_id",),
    "inventory": ("product_id",),
    "sales_orders": ("dealer_id", "product_id", "dispatch_date"),
    "payments": ("order_id", "payment_date", "payment_mode"),
}


# Column types of the star tables, declared so that no read infers them.
STAR_DDL = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": (
        "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE"
    ),
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
        "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
        "l_shipdate TIMESTAMP_NTZ"
    ),
}


@dataclass(frozen=True)
class TableSet:
    """The tables of one source and what their rows must be. Columns that are not nullable are required."""

    ddl: Mapping[str, str]
    primary_keys: Mapping[str, tuple[str, ...]]
    foreign_keys: Mapping[str, Mapping[str, str]]
    domains: Mapping[tuple[str, str], tuple[str, ...]] = field(default_factory=dict)
    ranges: Mapping[tuple[str, str], tuple[int, int]] = field(default_factory=dict)
    nullable: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    amounts: Mapping[str, tuple[str, ...]] = field(default_factory=dict)  # columns that may not be negative
    strict: tuple[str, ...] = ()  # tables whose foreign keys may not be missing
    clustering: Mapping[str, tuple[str, ...]] = field(default_factory=dict)  # sort order of the stored rows

    def schema(self, table: str) -> StructType:
        return StructType.fromDDL(self.ddl[table])


# Orders and stock are clustered by the date that panels filter on. Payments are clustered
# by order, so that the receipts of an order are summed before the shuffle.
INPUT = TableSet(
    INPUT_DDL,
    PRIMARY_KEYS,
    FOREIGN_KEYS,
    DOMAINS,
    RANGES,
    NULLABLE,
    amounts={
        "sales_orders": ("quantity", "unit_price", "total_amount"),
        "inventory": ("quantity_available", "reorder_level"),
        "payments": ("amount_received",),
    },
    strict=("sales_orders", "payments"),
    clustering={
        "sales_orders": ("order_date", "order_id"),
        "inventory": ("expiry_date", "inventory_id"),
        "payments": ("order_id", "payment_id"),
    },
)

# Keys and domains of the star tables.
STAR = TableSet(
    STAR_DDL,
    primary_keys={
        "region": ("r_regionkey",),
        "nation": ("n_nationkey",),
        "customer": ("c_custkey",),
        "supplier": ("s_suppkey",),
        "part": ("p_partkey",),
        "orders": ("o_orderkey",),
        "lineitem": ("l_orderkey", "l_linenumber"),
    },
    foreign_keys={
        "nation": {"n_regionkey": "region"},
        "customer": {"c_nationkey": "nation"},
        "supplier": {"s_nationkey": "nation"},
        "orders": {"o_custkey": "customer"},
        "lineitem": {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"},
    },
    domains={
        ("orders", "o_orderstatus"): ("F", "O", "P"),
        ("lineitem", "l_linestatus"): ("F", "O"),
        ("customer", "c_mktsegment"): ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"),
    },
    ranges={("part", "p_size"): (1, 50)},
    amounts={
        "orders": ("o_totalprice",),
        "lineitem": ("l_quantity", "l_extendedprice", "l_discount", "l_tax"),
        "part": ("p_retailprice",),
        "customer": ("c_acctbal",),
    },
    strict=("orders", "lineitem"),
    clustering={"orders": ("o_orderdate", "o_orderkey")},
)


def input_schema(table: str) -> StructType:
    return StructType.fromDDL(INPUT_DDL[table])


def result_schema(table: str) -> StructType:
    return StructType.fromDDL(RESULT_DDL[table])
