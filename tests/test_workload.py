"""Workload queries in their default form, on tables with all columns, against SQL."""

from __future__ import annotations

import random

import duckdb
import pytest
from oracle_check import rows_of
from pyspark.sql import functions as F

from faultweave.functions.scalars import charge, revenue, with_port
from faultweave.operators import sizing
from faultweave.plans import workload
from faultweave.sources.schemas import TABLES, columns

REVENUE = "sum(l_extendedprice * (1 - l_discount))"
PRICE = "sum(l_extendedprice)"


def make_rows():
    """Small tables; order 1 and customer 1 hold about a third of their rows."""
    rng = random.Random(2)

    def day(lo=0, hi=1000):
        n = rng.randint(lo, hi)
        return f"{1993 + n // 336}-{n % 336 // 28 + 1:02d}-{n % 28 + 1:02d}"

    def money():
        return rng.randint(1000, 100_000_000) / 1000  # finer than a cent

    def hot(n):
        return 1 if rng.random() < 0.33 else rng.randint(1, n)

    t = {}
    t["region"] = [(i, n, "") for i, n in enumerate(["ASIA", "EUROPE"])]
    t["nation"] = [(i, f"N{i}", i % 2, "") for i in range(6)]
    t["customer"] = [
        (i, f"Cust {i}", "", i % 6, "", money(), rng.choice(["BUILDING", "OTHER"]), "")
        for i in range(1, 41)
    ]
    t["supplier"] = [(i, f"Supp {i}", "", i % 6, "", money(), "") for i in range(1, 11)]
    t["part"] = [
        (i, rng.choice(["green nut", "red nut"]), f"M{i % 3}", "B", rng.choice(["X BRASS", "Y TIN"]),
         rng.choice([15, 7]), "", money(), "")
        for i in range(1, 61)
    ]
    t["partsupp"] = [(p, s, 1, 1.0, "") for p in range(1, 61) for s in rng.sample(range(1, 11), 3)]
    t["orders"] = [
        (i, hot(40), rng.choice("OFP"), money(), day(),
         rng.choice(["1-URGENT", "2-HIGH", "3-MEDIUM"]), "", i % 2, "")
        for i in range(1, 201)
    ]
    t["lineitem"] = [
        (hot(210), rng.randint(1, 60), rng.randint(1, 10), rng.randint(1, 7),
         float(rng.randint(1, 50)), money(), rng.randint(0, 100) / 1000, rng.randint(0, 80) / 1000,
         rng.choice("RAN"), rng.choice("OF"), day(), day(), day(), "",
         rng.choice(["MAIL", "SHIP", "AIR"]), "")
        for _ in range(3000)
    ]
    return t


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def tables(spark, rows, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    for name, data in rows.items():
        spark.createDataFrame(data, TABLES[name]).write.parquet(f"{base}/{name}")
    return {name: spark.read.parquet(f"{base}/{name}") for name in rows}


@pytest.fixture(scope="module")
def duck(rows):
    con = duckdb.connect()
    for name, data in rows.items():
        kinds = TABLES[name].replace("string", "VARCHAR")
        con.execute(f"CREATE TABLE {name} ({kinds})")
        marks = ",".join("?" * len(columns(TABLES[name])))
        con.executemany(f"INSERT INTO {name} VALUES ({marks})", data)
    return con


CASES = {
    "shipping_priority": (
        "customer orders lineitem",
        f"""SELECT l_orderkey, o_orderdate, o_shippriority, {REVENUE} AS revenue
        FROM customer, orders, lineitem WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey
        AND c_mktsegment = 'BUILDING' AND o_orderdate < '1995-03-15' AND l_shipdate > '1995-03-15'
        GROUP BY 1, 2, 3 ORDER BY revenue DESC, 2, 1 LIMIT 100""",
    ),
    "order_priority": (
        "orders lineitem",
        """SELECT o_orderpriority, count(*) AS order_count FROM orders
        WHERE o_orderdate >= '1993-07-01' AND o_orderdate < '1993-10-01' AND o_orderkey IN
        (SELECT l_orderkey FROM lineitem WHERE l_commitdate < l_receiptdate) GROUP BY 1""",
    ),
    "returned_items": (
        "customer orders lineitem nation",
        f"""SELECT c_custkey, c_name, c_acctbal, n_name, {REVENUE} AS revenue
        FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey
        AND o_orderkey = l_orderkey AND c_nationkey = n_nationkey AND l_returnflag = 'R'
        AND o_orderdate >= '1993-10-01' AND o_orderdate < '1994-01-01'
        GROUP BY 1, 2, 3, 4 ORDER BY revenue DESC, 1 LIMIT 50""",
    ),
    "ship_mode": (
        "lineitem orders",
        """SELECT l_shipmode, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH'))
        AS high_line_count, count(*) FILTER (o_orderpriority NOT IN ('1-URGENT', '2-HIGH'))
        AS low_line_count FROM lineitem, orders WHERE l_orderkey = o_orderkey
        AND l_shipmode IN ('MAIL', 'SHIP') AND l_commitdate < l_receiptdate
        AND l_shipdate < l_commitdate AND l_receiptdate >= '1994-01-01'
        AND l_receiptdate < '1995-01-01' GROUP BY 1""",
    ),
    "part_profit": (
        "part lineitem supplier orders nation",
        f"""SELECT n_name, {PRICE} AS total FROM part, lineitem, supplier, orders, nation
        WHERE p_partkey = l_partkey AND l_suppkey = s_suppkey AND l_orderkey = o_orderkey
        AND s_nationkey = n_nationkey AND p_name LIKE '%green%' GROUP BY 1""",
    ),
    "partsupp_status": (
        "lineitem partsupp orders",
        """SELECT o_orderstatus, count(*) AS cnt FROM lineitem, partsupp, orders
        WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_orderkey = o_orderkey
        GROUP BY 1""",
    ),
    "large_volume": (
        "customer orders lineitem",
        """SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice,
        sum(l_quantity) AS sum_qty FROM customer, orders, lineitem
        WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey AND o_orderkey IN
        (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 200)
        GROUP BY 1, 2, 3, 4, 5 ORDER BY o_totalprice DESC, o_orderdate, 3, 2 LIMIT 100""",
    ),
    "customer_spend": (
        "customer orders lineitem",
        f"""SELECT c_custkey, c_name, c_mktsegment, {PRICE} AS total_spent,
        count(*) AS line_count, sum(l_quantity) AS total_qty FROM customer, orders, lineitem
        WHERE c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY 1, 2, 3
        ORDER BY total_spent DESC, 1 LIMIT 150""",
    ),
    "customer_supplier": (
        "orders lineitem customer supplier",
        f"""SELECT c_name, s_name, {PRICE} AS total_price
        FROM orders, lineitem, customer, supplier WHERE c_custkey = o_custkey
        AND o_orderkey = l_orderkey AND l_suppkey = s_suppkey GROUP BY 1, 2
        ORDER BY total_price DESC, 1, 2 LIMIT 50""",
    ),
    "supplier_listing": (
        "part partsupp supplier nation region",
        """SELECT s_acctbal, s_name, n_name, p_partkey, p_mfgr, upper(s_name) AS s_name_upper
        FROM part, partsupp, supplier, nation, region WHERE p_partkey = ps_partkey
        AND ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey
        AND p_size = 15 AND p_type LIKE '%BRASS' AND r_name = 'EUROPE'
        ORDER BY s_acctbal DESC, s_name, n_name, p_partkey LIMIT 100""",
    ),
}


def check(df, con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = rows_of(names, [rounded(r) for r in result.fetchall()])
    assert want, "the case has no rows"
    assert rows_of(df.columns, [rounded(r) for r in df.collect()]) == want


def rounded(row):
    return tuple(round(v, 4) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(CASES))
def test_default_form(tables, duck, name):
    inputs, sql = CASES[name]
    check(getattr(workload, name)(*[tables[t] for t in inputs.split()]), duck, sql)


@pytest.mark.parametrize("name", sorted(CASES))
def test_default_form_with_shuffle_joins(tables, duck, no_broadcast, name):
    inputs, sql = CASES[name]
    check(getattr(workload, name)(*[tables[t] for t in inputs.split()]), duck, sql)


def test_repeated_keys_multiply(spark, tables, duck, no_broadcast):
    """Two rows of one order count its lines twice, pre-aggregated or not."""
    twice = tables["orders"].unionByName(tables["orders"].filter("o_orderkey = 1"))
    sql = f"""SELECT n_name, {PRICE} AS total_price
        FROM lineitem, supplier, nation,
             (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey = 1) o
        WHERE l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND s_nationkey = n_nationkey
        GROUP BY 1"""
    got = workload.orders_by_nation(tables["lineitem"], twice, tables["supplier"], tables["nation"])
    check(got, duck, sql)


def test_lines_are_summed_before_the_shuffle_join(tables, no_broadcast):
    plan = workload.customer_totals(tables["orders"], tables["lineitem"], tables["customer"])
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Aggregate [") == 3


def test_money_is_summed_as_it_is(spark):
    """Four rows of a price and a rate that no hundredth holds."""
    lines = spark.range(4).select(
        F.lit(10.005).alias("p"), F.lit(0.055).alias("d"), F.lit(0.0125).alias("t")
    )
    row = lines.agg(
        F.sum(revenue(F.col("p"), F.col("d"))), F.sum(charge(F.col("p"), F.col("d"), F.col("t")))
    ).first()
    assert row[0] == pytest.approx(4 * 10.005 * 0.945)
    assert row[1] == pytest.approx(4 * 10.005 * 0.945 * 1.0125)


@pytest.mark.parametrize(
    ("name", "inputs", "most"),
    [
        ("segment_priority", "lineitem orders customer", 5),
        ("customer_supplier", "orders lineitem customer supplier", 7),
        ("nation_status", "lineitem orders supplier nation", 7),
    ],
)
def test_exchanges_behind_the_lines(tables, no_broadcast, name, inputs, most):
    df = getattr(workload, name)(*[tables[t] for t in inputs.split()])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= most


def test_hot_keys_of_direct_joins_are_split(spark, tables, duck, no_broadcast):
    """With thresholds small enough for the fixture, the skewed side is split."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1000",
        "spark.sql.files.maxPartitionBytes": "2000",
        "spark.sql.files.openCostInBytes": "0",
    }
    before = {k: spark.conf.get(k) for k in settings}
    lines = tables["lineitem"].repartition(8)
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        df = workload.orders_by_nation(
            lines, tables["orders"], tables["supplier"], tables["nation"]
        )
        df.collect()
        assert "skewed" in df._jdf.queryExecution().executedPlan().toString()
        sql = f"""SELECT n_name, {PRICE} AS total_price FROM lineitem, orders, supplier, nation
            WHERE l_orderkey = o_orderkey AND l_suppkey = s_suppkey
            AND s_nationkey = n_nationkey GROUP BY 1"""
        check(df, duck, sql)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_filters_and_columns_reach_the_scan(tables):
    df = workload.order_priority(tables["orders"], tables["lineitem"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate,1993-07-01)" in plan
    assert "l_comment" not in plan and "o_clerk" not in plan


def test_broadcast_only_within_the_limit(spark, tables, monkeypatch):
    assert sizing.fits_broadcast(tables["nation"], tables["orders"])
    monkeypatch.setattr(sizing, "BROADCAST_LIMIT_BYTES", 10)
    assert not sizing.fits_broadcast(tables["nation"])
    assert sizing.broadcast_if_small(tables["nation"]) is tables["nation"]


def test_no_broadcast_where_the_session_forbids_it(tables, no_broadcast):
    assert not sizing.fits_broadcast(tables["nation"])


def test_cross_totals_equal_a_cross_join(tables, duck):
    got = workload.cross_totals(tables["customer"], tables["supplier"], "c_acctbal").first()
    n, total = duck.execute(
        "SELECT count(*), sum(c_acctbal) FROM customer CROSS JOIN supplier"
    ).fetchone()
    assert (int(got.total_rows), got.total_price) == (n, pytest.approx(total))


def test_cross_totals_of_nothing(tables):
    none = tables["supplier"].filter("s_suppkey < 0")
    got = workload.cross_totals(tables["customer"], none, "c_acctbal").first()
    assert (int(got.total_rows), got.total_price) == (0, None)
    got = workload.cross_totals(none, tables["customer"], "s_acctbal").first()
    assert (int(got.total_rows), got.total_price) == (0, None)


def test_cross_totals_with_a_row_limit(tables):
    got = workload.cross_totals(
        tables["customer"], tables["supplier"], "c_acctbal", row_limit=3, limit_key="c_custkey"
    ).first()
    first = [r.c_acctbal for r in tables["customer"].orderBy("c_custkey").limit(3).collect()]
    assert int(got.total_rows) == 30
    assert got.total_price == pytest.approx(10 * sum(first))


def test_name_forms(tables):
    inputs = [tables[t] for t in ("customer", "orders", "lineitem", "nation")]
    got = workload.returned_items(
        *inputs, by_customer_only=True, k=3, name_form=lambda name: with_port(name, 80)
    )
    assert [r.c_name_mod for r in got.collect()] == [f"{r.c_name}:80" for r in got.collect()]


def test_union_lines_columns_up(spark, tables):
    extra = workload.skewed_rows(
        tables["lineitem"], tables["orders"], {"l_orderkey": F.lit(1), "l_quantity": F.lit(50.0)}
    )
    both = workload.with_skewed_rows(tables["lineitem"], extra)
    assert both.count() == 3200 and both.columns == tables["lineitem"].columns
    skew = workload.join_key_skew(both, "l_orderkey").first()
    assert skew.total_rows == 3200 and skew.hottest_rows > 1000
    assert skew.hottest_share == pytest.approx(skew.hottest_rows / 3200)


def test_range_rows(spark):
    df = workload.range_rows(spark, 1, 100, value=F.rand(7))
    again = workload.range_rows(spark, 1, 100, value=F.rand(7))
    assert df.collect() == again.collect()
    rows = workload.category_totals(df, "id", F.lit(1), 5).collect()
    totals = {r.category: r.total for r in rows}
    assert totals == {"0": 19, "1": 20, "2": 20, "3": 20, "4": 20}
