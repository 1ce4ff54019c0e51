"""The sales panels from a stored cube: additive measures by day, region, dealer type and crop."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dealerscope.functions.dates import month_start
from dealerscope.functions.money import TOTAL, ratio, total
from dealerscope.operators.filters import in_date_range, in_regions
from dealerscope.plans.reports import Day, Regions, extreme
from dealerscope.sources.durable import fresh_path
from dealerscope.sources.roles import Roles

SHARED = ("order_date", "region", "dealer_type")  # dimensions of every grain
# The grains of the cube, and the dimensions that each has beyond the shared ones.
GRAINS = {"region": (), "dealer": ("dealer_id",), "crop": ("crop",), "product": ("crop", "product_id")}


# The measures of the order grains and of the line grains, and how they add up.
OF_ORDERS = {"revenue": "amount", "orders": "count"}
OF_LINES = {"revenue": "amount", "quantity": "count"}
CELL = (
    "order_date DATE, region STRING, dealer_type STRING, dealer_id BIGINT, crop STRING, product_id BIGINT, "
    "revenue DECIMAL(38,2), orders BIGINT, quantity BIGINT"
)


def _cells(rows: DataFrame, grain: str, measures: dict[str, str]) -> DataFrame:
    """The cells of one grain, from rows or from the cells of a finer one."""
    sums = [(total if kind == "amount" else F.sum)(name).alias(name) for name, kind in measures.items()]
    return rows.groupBy(*SHARED, *GRAINS[grain]).agg(*sums)


def _order_cells(roles: Roles) -> DataFrame:
    """The dealer grain."""
    dealers = roles.dealers.select("dealer_id", "region", "dealer_type")
    by_day = roles.orders.groupBy("dealer_id", "order_date").agg(total("total_amount").alias("revenue"), F.count(F.lit(1)).alias("orders"))
    return _cells(by_day.join(dealers, "dealer_id"), "dealer", OF_ORDERS)


def _line_cells(roles: Roles) -> DataFrame:
    """The product grain.

    It has nearly as many cells as there are lines, so sums before a shuffle would save nothing.
    The lines are dealt by the dimensions of the crop grain instead, once for their sums and
    their files: a hot product, day or dealer lies in the cells of many others, and few tasks
    have the cells of one crop and day.
    """
    dealers = roles.dealers.select("dealer_id", "region", "dealer_type")
    products = roles.products.select("product_id", F.col("target_crop").alias("crop"))
    lines = roles.lines_with(dealers).select(
        *SHARED, "product_id", F.col("total_amount").alias("revenue"), F.col("quantity").cast("bigint").alias("quantity")
    )
    dealt = lines.join(products, "product_id").repartition(*SHARED, *GRAINS["crop"])
    return _cells(dealt, "product", OF_LINES)


def _write_cells(cells: DataFrame, path: str, grain: str) -> DataFrame:
    """One folder of the cube; what a grain lacks is null."""
    fields = StructType.fromDDL(CELL).fields
    full = [(F.col(f.name) if f.name in cells.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    folder = f"{path}/grain={grain}"
    cells.select(full).sortWithinPartitions("order_date").write.parquet(folder)
    return cells.sparkSession.read.schema(CELL).parquet(folder)


def store_cube(roles: Roles) -> DataFrame:
    """The cube written with a folder for each grain, sorted by day, so a panel reads its cells only.

    One row per cell of each grain: ``grain``, the dimensions (null where a grain lacks one) and the
    measures. Order grains (region, dealer) hold revenue and orders of order headers, line grains
    (crop, product) revenue and quantity of order lines. Orders without a known dealer and lines
    without a known product are in no panel and in no cell. Dealers are no measure: they are counted
    from the cells of the dealer grain. A coarse grain is summed from the stored cells of its fine one.
    """
    spark = roles.dealers.sparkSession
    path = fresh_path(spark)
    for coarse, fine, cells, measures in (
        ("region", "dealer", _order_cells(roles), OF_ORDERS),
        ("crop", "product", _line_cells(roles), OF_LINES),
    ):
        stored = _write_cells(cells, path, fine)
        _write_cells(_cells(stored, coarse, measures), path, coarse)
    return spark.read.schema(f"{CELL}, grain STRING").parquet(path)


def chosen(cube: DataFrame, grain: str, regions: Regions = None, lo: Day = None, hi: Day = None, types: Iterable[str] | None = None) -> DataFrame:
    """The cells of a grain that the global filter leaves."""
    cells = in_date_range(in_regions(cube.filter(F.col("grain") == grain), regions), lo, hi)
    return cells if types is None else cells.filter(F.col("dealer_type").isin(list(types)))


def kpi_summary(cube: DataFrame, regions: Regions = None, lo: Day = None, hi: Day = None, types: Iterable[str] | None = None) -> DataFrame:
    """One row: revenue, orders, active dealers, average order value; zeros if nothing matches."""
    per_dealer = chosen(cube, "dealer", regions, lo, hi, types).groupBy("dealer_id").agg(total("revenue").alias("revenue"), F.sum("orders").alias("orders"))
    sums = per_dealer.agg(
        F.coalesce(total("revenue"), F.lit(0).cast(TOTAL)).alias("revenue"),
        F.coalesce(F.sum("orders"), F.lit(0)).alias("orders"),
        F.count(F.lit(1)).alias("dealers"),
    )
    return sums.withColumn("aov", F.coalesce(ratio(F.col("revenue"), F.col("orders")), F.lit(0.0)))


def monthly_revenue(cube: DataFrame, regions: Regions = None, lo: Day = None, hi: Day = None, types: Iterable[str] | None = None) -> DataFrame:
    cells = chosen(cube, "region", regions, lo, hi, types)
    return cells.groupBy(month_start("order_date").alias("month_start")).agg(total("revenue").alias("revenue")).orderBy("month_start")


def top_regions(cube: DataFrame, regions: Regions = None, lo: Day = None, hi: Day = None, n: int = 5) -> DataFrame:
    per_region = chosen(cube, "region", regions, lo, hi).groupBy("region").agg(total("revenue").alias("revenue"))
    return extreme(per_region, "revenue", "region", n)


def top_dealers(cube: DataFrame, dealers: DataFrame, regions: Regions = None, lo: Day = None, hi: Day = None, n: int = 5) -> DataFrame:
    """Dealers by revenue; names are looked up for the few that are shown."""
    per_dealer = chosen(cube, "dealer", regions, lo, hi).groupBy("dealer_id").agg(total("revenue").alias("revenue"))
    best = extreme(per_dealer, "revenue", "dealer_id", n)
    named = best.join(dealers.select("dealer_id", "dealer_name"), "dealer_id").select("dealer_id", "dealer_name", "revenue")
    return extreme(named, "revenue", "dealer_id", n)


def product_revenue(cube: DataFrame, products: DataFrame, regions: Regions = None, lo: Day = None, hi: Day = None) -> DataFrame:
    """Revenue of every product with sales in the chosen regions and dates."""
    per_product = chosen(cube, "product", regions, lo, hi).groupBy("product_id").agg(total("revenue").alias("revenue"))
    return per_product.join(products.select("product_id", "product_name", "target_crop"), "product_id")


def crop_list(cube: DataFrame, regions: Regions = None, lo: Day = None, hi: Day = None) -> DataFrame:
    """Crops with sales."""
    return chosen(cube, "crop", regions, lo, hi).select(F.col("crop").alias("target_crop")).distinct().orderBy("target_crop")


def crop_demand_curve(cube: DataFrame, crop: str, regions: Regions = None, lo: Day = None, hi: Day = None) -> DataFrame:
    """Monthly quantity sold of one crop's products."""
    cells = chosen(cube, "crop", regions, lo, hi).filter(F.col("crop") == crop)
    return cells.groupBy(month_start("order_date").alias("month_start")).agg(F.sum("quantity").alias("quantity")).orderBy("month_start")
