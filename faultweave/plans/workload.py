"""TPC-H-shaped workload queries.

Lines that are only asked for sums per order are summed before they meet orders:
the join reuses the shuffle of the sums, sees one row per order instead of one
per line, and a hot order collapses on the map side. Lines that also carry a
supplier, part or mode hardly shrink by that and would shuffle twice, so they
join as they are; a hot key is then split by adaptive skew joins, which the
group-by on other keys behind them allows. Small tables are joined to each other
first, so that the final group-by, whose map side sums each partition to a few
rows, is the only one behind the lines. Money is summed as the expression stands.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultweave.functions.scalars import charge, revenue
from faultweave.operators.sizing import broadcast_if_small

# Priorities that count as high.
HIGH_PRIORITIES = ("1-URGENT", "2-HIGH")


def _price() -> Column:
    return F.col("l_extendedprice")


def _quantity() -> Column:
    return F.col("l_quantity")


def _revenue() -> Column:
    return revenue(F.col("l_extendedprice"), F.col("l_discount"))


def _one() -> Column:
    return F.lit(1).cast("bigint")


def _sum_by(df: DataFrame, keys: list[str], *sums: str) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def _lines(lineitem: DataFrame, *keys: str, **values: Column) -> DataFrame:
    return lineitem.select(*keys, *[v.alias(name) for name, v in values.items()])


def _order_lines(lineitem: DataFrame, **values: Column) -> DataFrame:
    """The values of the lines summed by order."""
    return _sum_by(_lines(lineitem, "l_orderkey", **values), ["l_orderkey"], *values)


def _top(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def _in_window(column: str, start: str, end: str) -> Column:
    """Half-open date window; the text bounds suit date text and timestamps alike."""
    return (F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(end))


def _of_order() -> Column:
    return F.col("l_orderkey") == F.col("o_orderkey")


def _of_customer() -> Column:
    return F.col("o_custkey") == F.col("c_custkey")


def _of_supplier() -> Column:
    return F.col("l_suppkey") == F.col("s_suppkey")


# ---------------------------------------------------------------- reports


def shipping_priority(
    customer: DataFrame,
    orders: DataFrame,
    lineitem: DataFrame,
    cutoff: str = "1995-03-15",
    segment: str = "BUILDING",
    extra_keys: tuple[str, ...] = ("o_shippriority",),
    k: int = 100,
) -> DataFrame:
    """Revenue of unshipped orders of one market segment, best first."""
    unshipped = lineitem.filter(F.col("l_shipdate") > F.lit(cutoff))
    lines = _order_lines(unshipped, revenue=_revenue())
    buyers = customer.filter(F.col("c_mktsegment") == segment).select("c_custkey")
    open_orders = orders.filter(F.col("o_orderdate") < F.lit(cutoff)).join(buyers, _of_customer())
    keys = ["l_orderkey", "o_orderdate", *extra_keys]
    totals = _sum_by(lines.join(open_orders, _of_order()), keys, "revenue")
    return _top(totals, k, F.col("revenue").desc(), F.col("o_orderdate"), F.col("l_orderkey"))


def order_priority(
    orders: DataFrame,
    lineitem: DataFrame,
    start: str = "1993-07-01",
    end: str = "1993-10-01",
    late: Column | None = None,
) -> DataFrame:
    """Orders of a quarter with at least one late line, by priority.

    Late order keys are made distinct before the shuffle, so an order with very
    many lines weighs no more than any other.
    """
    late = F.col("l_commitdate") < F.col("l_receiptdate") if late is None else late
    late_orders = lineitem.filter(late).select("l_orderkey").distinct()
    return (
        orders.filter(_in_window("o_orderdate", start, end))
        .join(late_orders, _of_order(), "left_semi")
        .groupBy("o_orderpriority")
        .agg(F.count("*").alias("order_count"))
        .orderBy("o_orderpriority")
    )


def returned_items(
    customer: DataFrame,
    orders: DataFrame,
    lineitem: DataFrame,
    nation: DataFrame,
    start: str = "1993-10-01",
    end: str = "1994-01-01",
    by_customer_only: bool = False,
    k: int = 50,
    name_form: Callable[[Column], Column] = F.lower,
) -> DataFrame:
    """Revenue lost to returns per customer, highest first.

    `by_customer_only` groups by key and name alone and adds the name in another
    form.
    """
    returned = lineitem.filter(F.col("l_returnflag") == "R")
    lines = _order_lines(returned, revenue=_revenue())
    in_window = orders.filter(_in_window("o_orderdate", start, end)).select(
        "o_orderkey", "o_custkey"
    )
    per_customer = _sum_by(lines.join(in_window, _of_order()), ["o_custkey"], "revenue")
    keys = ["c_custkey", "c_name"]
    if not by_customer_only:
        keys += ["c_acctbal", "n_name"]
    joined = per_customer.join(customer, _of_customer()).join(
        broadcast_if_small(nation), F.col("c_nationkey") == F.col("n_nationkey")
    )
    totals = _sum_by(joined, keys, "revenue")
    top = _top(totals, k, F.col("revenue").desc(), *[F.col(c) for c in keys])
    return top.withColumn("c_name_mod", name_form(F.col("c_name"))) if by_customer_only else top


def ship_mode(
    lineitem: DataFrame,
    orders: DataFrame,
    mode_col: str = "l_shipmode",
    modes: tuple[str, ...] = ("MAIL", "SHIP"),
    line_filter: Column | None = None,
    joined_filter: Column | None = None,
    joined_cols: tuple[str, ...] = (),
) -> DataFrame:
    """High- and low-priority line counts per ship mode.

    `joined_filter` may compare the `joined_cols` of a line with its order.
    """
    if line_filter is None:
        line_filter = (
            (F.col("l_commitdate") < F.col("l_receiptdate"))
            & (F.col("l_shipdate") < F.col("l_commitdate"))
            & _in_window("l_receiptdate", "1994-01-01", "1995-01-01")
        )
    wanted = lineitem.filter(F.col(mode_col).isin(*modes) & line_filter)
    joined = _lines(wanted, "l_orderkey", mode_col, *joined_cols).join(orders, _of_order())
    if joined_filter is not None:
        joined = joined.filter(joined_filter)
    high = F.col("o_orderpriority").isin(*HIGH_PRIORITIES)
    return (
        joined.groupBy(mode_col)
        .agg(
            F.sum(F.when(high, _one()).otherwise(0)).alias("high_line_count"),
            F.sum(F.when(~high, _one()).otherwise(0)).alias("low_line_count"),
        )
        .orderBy(mode_col)
    )


def pricing_summary(
    lineitem: DataFrame, cutoff: str = "1998-09-02", with_double_qty: bool = False
) -> DataFrame:
    """Totals per return flag and line status of lines shipped up to a date."""
    price, discount, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    values = {
        "sum_qty": _quantity(),
        "sum_base_price": _price(),
        "sum_disc_price": _revenue(),
        "sum_charge": charge(price, discount, tax),
    }
    if with_double_qty:
        values["sum_slow_qty"] = _quantity() * 2
    return (
        lineitem.filter(F.col("l_shipdate") <= F.lit(cutoff))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            *[F.sum(v).alias(name) for name, v in values.items()],
            F.count("*").alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


# ---------------------------------------------------------------- hinted joins


def part_profit(
    part: DataFrame,
    lineitem: DataFrame,
    supplier: DataFrame,
    orders: DataFrame,
    nation: DataFrame,
    name_part: str = "green",
) -> DataFrame:
    """Price total per supplier nation of parts whose name holds a word.

    The filtered parts are the side to broadcast, and only while small.
    """
    parts = part.filter(F.col("p_name").contains(name_part)).select("p_partkey")
    lines = lineitem.join(broadcast_if_small(parts), F.col("l_partkey") == F.col("p_partkey"))
    return _nation_totals(lines, orders, supplier, nation, "total")


def orders_by_nation(
    lineitem: DataFrame, orders: DataFrame, supplier: DataFrame, nation: DataFrame
) -> DataFrame:
    """Price total per supplier nation of all lines with an order."""
    return _nation_totals(lineitem, orders, supplier, nation, "total_price")


def _nation_totals(
    lineitem: DataFrame, orders: DataFrame, supplier: DataFrame, nation: DataFrame, name: str
) -> DataFrame:
    order_keys = broadcast_if_small(orders.select("o_orderkey"))
    lines = _lines(lineitem, "l_orderkey", "l_suppkey", total=_price())
    per_supplier = _sum_by(lines.join(order_keys, _of_order()), ["l_suppkey"], "total")
    joined = per_supplier.join(broadcast_if_small(supplier), _of_supplier()).join(
        broadcast_if_small(nation), F.col("s_nationkey") == F.col("n_nationkey")
    )
    totals = joined.groupBy("n_name").agg(F.sum("total").alias(name))
    return totals.orderBy(F.col(name).desc(), "n_name")


def partsupp_status(lineitem: DataFrame, partsupp: DataFrame, orders: DataFrame) -> DataFrame:
    """Lines with a part-supplier record, counted by order status."""
    pair = (F.col("l_partkey") == F.col("ps_partkey")) & (F.col("l_suppkey") == F.col("ps_suppkey"))
    pairs = broadcast_if_small(partsupp.select("ps_partkey", "ps_suppkey"))
    lines = _lines(lineitem, "l_partkey", "l_suppkey", "l_orderkey", lines=_one())
    per_order = _sum_by(lines.join(pairs, pair), ["l_orderkey"], "lines")
    return (
        per_order.join(orders.select("o_orderkey", "o_orderstatus"), _of_order())
        .groupBy("o_orderstatus")
        .agg(F.sum("lines").alias("cnt"))
        .orderBy(F.col("cnt").desc(), "o_orderstatus")
    )


# ---------------------------------------------------------------- skew


def skewed_rows(template: DataFrame, source: DataFrame, values: dict[str, Column]) -> DataFrame:
    """One synthetic row per `source` row: the given constants, NULL elsewhere."""
    fields = {f.name: f.dataType for f in template.schema.fields}
    return source.select(
        *[values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields.items()]
    )


def with_skewed_rows(table: DataFrame, extra: DataFrame) -> DataFrame:
    """UNION ALL with columns lined up by name."""
    return table.unionByName(extra.select(*table.columns))


def large_volume(
    customer: DataFrame,
    orders: DataFrame,
    lineitem: DataFrame,
    threshold: int = 200,
    k: int = 100,
) -> DataFrame:
    """Orders above a total quantity, dearest first.

    The per-order total found for the threshold is the total asked for, so
    lines are read and shuffled once.
    """
    totals = lineitem.groupBy("l_orderkey").agg(F.sum(_quantity()).alias("sum_qty"))
    large = totals.filter(F.col("sum_qty") > threshold)
    keys = ["c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice"]
    joined = large.join(orders, _of_order()).join(customer, _of_customer())
    return _top(
        _sum_by(joined, keys, "sum_qty"),
        k,
        F.col("o_totalprice").desc(),
        F.col("o_orderdate"),
        F.col("o_orderkey"),
        F.col("c_custkey"),
    )


def join_key_skew(df: DataFrame, key: str) -> DataFrame:
    """How much of the table its most frequent join key holds."""
    per_key = df.groupBy(key).agg(F.count("*").alias("n"))
    return per_key.agg(
        F.sum("n").alias("total_rows"),
        F.count("*").alias("distinct_keys"),
        F.max("n").alias("hottest_rows"),
        F.try_divide(F.max("n"), F.sum("n")).alias("hottest_share"),
    )


# ---------------------------------------------------------------- heavy aggregates


def segment_priority(
    lineitem: DataFrame, orders: DataFrame, customer: DataFrame, k: int = 200
) -> DataFrame:
    """Totals per market segment and order priority."""
    values = {
        "price": _price(),
        "qty": _quantity(),
        "disc": F.col("l_discount"),
        "tax": F.col("l_tax"),
        "discounts": F.when(F.col("l_discount").isNotNull(), _one()).otherwise(0),
    }
    owned = orders.select("o_orderkey", "o_custkey", "o_orderpriority").join(
        customer.select("c_custkey", "c_mktsegment"), _of_customer()
    )
    totals = (
        _order_lines(lineitem, **values)
        .join(owned.drop("o_custkey", "c_custkey"), _of_order())
        .groupBy("c_mktsegment", "o_orderpriority")
        .agg(
            F.sum("price").alias("total_price"),
            F.sum("qty").alias("total_qty"),
            F.try_divide(F.sum("disc"), F.sum("discounts")).alias("avg_disc"),
            F.sum("tax").alias("total_tax"),
        )
    )
    return _top(
        totals,
        k,
        F.col("total_price").desc(),
        F.col("c_mktsegment"),
        F.col("o_orderpriority"),
    )


def nation_status(
    lineitem: DataFrame, orders: DataFrame, supplier: DataFrame, nation: DataFrame, k: int = 100
) -> DataFrame:
    """Revenue and lines per supplier nation and order status."""
    lines = _lines(lineitem, "l_orderkey", "l_suppkey", revenue=_revenue(), cnt=_one())
    places = supplier.select("s_suppkey", "s_nationkey").join(
        broadcast_if_small(nation), F.col("s_nationkey") == F.col("n_nationkey")
    )
    joined = lines.join(orders.select("o_orderkey", "o_orderstatus"), _of_order()).join(
        broadcast_if_small(places.select("s_suppkey", "n_name")), _of_supplier()
    )
    totals = _sum_by(joined, ["n_name", "o_orderstatus"], "revenue", "cnt")
    return _top(totals, k, F.col("revenue").desc(), F.col("n_name"), F.col("o_orderstatus"))


def _customer_lines(orders: DataFrame, lineitem: DataFrame, **values: Column) -> DataFrame:
    """The values summed per customer key."""
    lines = _order_lines(lineitem, **values)
    owners = orders.select("o_orderkey", "o_custkey")
    return _sum_by(lines.join(owners, _of_order()), ["o_custkey"], *values)


def customer_spend(
    customer: DataFrame, orders: DataFrame, lineitem: DataFrame, k: int = 150
) -> DataFrame:
    """Customers by total spent."""
    values = {"total_spent": _price(), "line_count": _one(), "total_qty": _quantity()}
    keys = ["c_custkey", "c_name", "c_mktsegment"]
    joined = _customer_lines(orders, lineitem, **values).join(
        customer.select(*keys), _of_customer()
    )
    totals = _sum_by(joined, keys, *values)
    return _top(totals, k, F.col("total_spent").desc(), F.col("c_custkey"))


def customer_totals(
    orders: DataFrame, lineitem: DataFrame, customer: DataFrame, k: int = 100
) -> DataFrame:
    """Customers by total price, with their line count."""
    values = {"total_price": _price(), "order_count": _one()}
    keys = ["c_name", "c_custkey"]
    joined = _customer_lines(orders, lineitem, **values).join(
        customer.select(*keys), _of_customer()
    )
    totals = _sum_by(joined, keys, *values)
    return _top(totals, k, F.col("total_price").desc(), F.col("c_custkey"))


def customer_supplier(
    orders: DataFrame,
    lineitem: DataFrame,
    customer: DataFrame,
    supplier: DataFrame,
    k: int = 50,
) -> DataFrame:
    """Customer and supplier name pairs by total price."""
    lines = _lines(lineitem, "l_orderkey", "l_suppkey", total_price=_price())
    owned = orders.select("o_orderkey", "o_custkey").join(
        customer.select("c_custkey", "c_name"), _of_customer()
    )
    joined = lines.join(owned.select("o_orderkey", "c_name"), _of_order()).join(
        broadcast_if_small(supplier.select("s_suppkey", "s_name")), _of_supplier()
    )
    totals = _sum_by(joined, ["c_name", "s_name"], "total_price")
    return _top(totals, k, F.col("total_price").desc(), F.col("c_name"), F.col("s_name"))


def supplier_listing(
    part: DataFrame,
    partsupp: DataFrame,
    supplier: DataFrame,
    nation: DataFrame,
    region: DataFrame,
    size: int = 15,
    type_end: str = "BRASS",
    region_name: str = "EUROPE",
    part_cols: tuple[str, ...] = ("p_mfgr",),
    k: int = 100,
    name_form: Callable[[Column], Column] = F.upper,
) -> DataFrame:
    """Suppliers of one region for parts of one size and type, by balance.

    The name is added in another form after the limit, so on `k` rows only.
    """
    parts = part.filter((F.col("p_size") == size) & F.col("p_type").endswith(type_end))
    places = broadcast_if_small(nation).join(
        broadcast_if_small(region.filter(F.col("r_name") == region_name)),
        F.col("n_regionkey") == F.col("r_regionkey"),
    )
    local = supplier.join(places, F.col("s_nationkey") == F.col("n_nationkey"))
    offers = partsupp.select("ps_partkey", "ps_suppkey").join(
        broadcast_if_small(parts), F.col("ps_partkey") == F.col("p_partkey")
    )
    listing = offers.join(local, F.col("ps_suppkey") == F.col("s_suppkey")).select(
        "s_acctbal", "s_name", "n_name", "p_partkey", *part_cols
    )
    order = [F.col("s_acctbal").desc(), F.col("s_name"), F.col("n_name"), F.col("p_partkey")]
    return _top(listing, k, *order).withColumn("s_name_upper", name_form(F.col("s_name")))


# ---------------------------------------------------------------- range and cross joins


def range_rows(spark: SparkSession, start: int, end: int, **columns: Column) -> DataFrame:
    """`start <= id < end` plus the given columns."""
    return spark.range(start, end).withColumns(columns) if columns else spark.range(start, end)


def category_totals(df: DataFrame, key: str, value: Column, categories: int) -> DataFrame:
    """Sum of `value` per `key % categories`, the category as text."""
    category = (F.col(key) % categories).cast("string").alias("category")
    return df.groupBy(category).agg(F.sum(value).alias("total"))


def cross_totals(
    left: DataFrame,
    right: DataFrame,
    money: str,
    row_limit: int | None = None,
    limit_key: str | None = None,
) -> DataFrame:
    """Row count and sum of a left money column over `left CROSS JOIN right`.

    Every left row meets every right row, so the pairs number |left| * |right|
    and each left value counts |right| times: two counts and a sum, no pair is
    ever made. The count is decimal(38,0), as it outgrows a bigint. `row_limit`
    first keeps the left rows with the lowest `limit_key`.
    """
    if row_limit is not None:
        left = left.orderBy(limit_key).limit(row_limit)
    count = F.count("*").cast("decimal(19,0)")
    a = left.agg(count.alias("n"), F.sum(money).alias("s"))
    b = right.agg(count.alias("m"))
    sizes = a.unionByName(b, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in "nsm"])
    price = F.when(F.col("m") > 0, F.col("s") * F.col("m"))
    return sizes.select(
        (F.col("n") * F.col("m")).cast("decimal(38,0)").alias("total_rows"),
        price.alias("total_price"),
    )
