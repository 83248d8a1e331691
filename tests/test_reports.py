import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shopledger.operators import filters as FL
from shopledger.operators.dimensions import build_dim_time
from shopledger.plans import bank_reports as B
from shopledger.plans import kpi
from shopledger.plans import product_cost as P
from shopledger.plans import profit_loss as L

SALES = "order_key long, order_id long, customer_key long, product_key long, sku string, sale_date_key int, item_total decimal(15,2), discount_amount decimal(15,2), item_price decimal(15,2)"


def D_(x):
    return None if x is None else Decimal(str(x))


@pytest.fixture(scope="module")
def dim_time(spark):
    return build_dim_time(spark, "2025-01-01", "2025-12-31").cache()


@pytest.fixture(scope="module")
def sales(spark):
    rows = [
        (1, 1, 10, 1, "A", 20250105, 100, 10, 60),
        (1, 1, 10, 2, "B", 20250105, 50, None, 40),
        (2, 2, 10, 1, "A", 20250210, 30, 0, 30),
        (3, 3, 11, 2, "B", 20250131, 80, 5, 80),
        (4, 4, None, 1, "A", 20250120, 7, 0, 0),  # no customer
        (None, None, 12, 1, "A", 20250121, 9, 0, 5),  # no order
        (5, 5, 13, 1, "A", 19990101, 1000, 0, 1),  # outside the calendar
    ]
    return spark.createDataFrame([tuple(D_(v) if i > 5 else v for i, v in enumerate(r)) for r in rows], SALES)


@pytest.fixture(scope="module")
def fin(spark):
    rows = [
        (20250105, 1, "Sale", "Order payment", 150, None),
        (20250106, 1, "Refund", "r", -30, None),
        (20250106, 1, "Fee", "Transaction fee", None, -10),
        (20250107, 3, "Marketing", "ads", None, -4),
        (20250107, 3, "Marketing", "ads credit", None, 1),
        (20250108, None, "VAT", "VAT: listing credit", None, -2),
        (20240108, None, "Fee", "Transaction fee", None, -99),
    ]
    kind = "transaction_date_key int, order_id long, transaction_type string, transaction_title string, amount decimal(15,2), fees_and_taxes decimal(15,2)"
    return spark.createDataFrame([tuple(D_(v) if i > 3 else v for i, v in enumerate(r)) for r in rows], kind)


@pytest.fixture(scope="module")
def bank(spark):
    rows = [
        (1, 7, 20250110, "N1", "6211", "A", "01", None, 50, 10, "a_A_01 6211"),
        (2, 7, 20250112, "N1", "6411", "A", "01", None, 20, 99, "x"),
        (3, 8, 20250301, "N2", None, None, None, 500, None, 5, "rent 50%"),
        (4, 8, 20250302, "N2", "6221", "B", "02", None, 30, 7, "y"),
    ]
    kind = "bank_transaction_key long, bank_account_key long, transaction_date_key int, account_number string, pl_account_number string, parsed_product_id string, parsed_variant_id string, credit_amount decimal(15,2), debit_amount decimal(15,2), balance_after_transaction decimal(15,2), transaction_description string"
    df = spark.createDataFrame([tuple(D_(v) if i in (7, 8, 9) else v for i, v in enumerate(r)) for r in rows], kind)
    return df.withColumns({"reference_number": F.concat(F.lit("R"), "bank_transaction_key"), "parsed_product_line_id": F.when(F.col("parsed_product_id").isNotNull(), "L"), "product_catalog_key": F.lit(None).cast("long"), "is_business_related": F.lit(True)})


def val(df):
    return df.first()[0]


def test_null_customers_and_unknown_dates(sales, dim_time):
    assert val(kpi.total_revenue(sales, dim_time)) == Decimal("261.00")  # null discount is 0, 1999 is no calendar day
    assert val(kpi.total_revenue(sales, dim_time, customer_type="new")) == Decimal("75.00")
    split = {r.customer_type: float(r.revenue) for r in kpi.new_vs_returning_sales(sales, dim_time).collect()}
    # without a known order a customer counts as returning here, as in a CASE ... ELSE; null customers drop out
    assert split == {"New Customers": 75.0, "Returning Customers": 179.0}
    assert val(kpi.total_orders(sales, dim_time)) == 4 and val(kpi.total_customers(sales, dim_time)) == 3


def test_class_is_judged_over_all_time(sales, dim_time):
    # customer 10 orders once in January but again in February
    january = ("2025-01-01", "2025-01-31")
    assert val(kpi.total_revenue(sales, dim_time, *january, customer_type="return")) == Decimal("140.00")
    assert val(kpi.retention_rate(sales, dim_time, *january)) == Decimal("33.33")


def test_sum_of_months_is_total(sales, dim_time):
    months = kpi.revenue_by_month(sales, dim_time)
    assert months.agg(F.sum("revenue")).first()[0] == val(kpi.total_revenue(sales, dim_time))
    assert [r.month for r in months.collect()] == ["2025-01", "2025-02"]


def test_average_order_value_without_orders_is_null(sales, dim_time):
    assert val(kpi.average_order_value(sales, dim_time, "2025-03-01", "2025-03-31")) is None
    assert val(kpi.average_order_value(sales, dim_time)) == Decimal("65.25")


def test_malformed_bound_does_not_filter(sales, dim_time):
    assert val(kpi.total_revenue(sales, dim_time, "2025-2-1", None)) == Decimal("261.00")
    assert FL.resolve_dates("2025-03-01", "2025-01-01") == ("2025-01-01", "2025-03-01")
    assert FL.resolve_dates("2025-02-01", "2025-02-01") == ("2025-02-01", "2025-02-28")
    assert FL.resolve_dates(year=2024, month=2) == ("2024-02-01", "2024-02-29")
    assert FL.resolve_dates(year=2024) == ("2024-01-01", "2024-12-31")


def test_new_customers_all_means_new(sales, dim_time):
    rows = kpi.new_customers_over_time(sales, dim_time).collect()
    assert [(r.full_date, r.customers) for r in rows] == [(dt.date(2025, 1, 31), 1)]
    assert len(kpi.new_customers_over_time(sales, dim_time, customer_type="return").collect()) == 2


def test_acquisition_cost_nets_before_abs(sales, fin, dim_time):
    assert val(kpi.customer_acquisition_cost(sales, fin, dim_time)) == Decimal("3.00")
    fees = L.revenue_and_fees(fin, dim_time, "year").first()
    assert fees.marketing_fee == Decimal("5.00")  # the statement adds absolute values


def test_lifetime_value_window_and_no_discount(sales, dim_time):
    # 30 days before Jan 31 and that day: 31 days
    r = kpi.customer_lifetime_value(sales, dim_time, "2025-01-31", period_days=30).first()
    assert (r.average_order_value, r.lifetime_value) == (Decimal("82.00"), Decimal("82.00"))
    assert kpi.customer_lifetime_value(sales, dim_time, "2025-02-04", period_days=30).first().lifetime_value == Decimal("82.00")
    assert kpi.customer_lifetime_value(sales, dim_time, "2025-02-04", period_days=29).first().lifetime_value == Decimal("48.00")


def test_cac_ltv_by_month(sales, fin, dim_time):
    rows = {r.month: r for r in kpi.cac_ltv_by_month(sales, fin, dim_time).collect()}
    assert rows["2025-01"].cac == Decimal("3.00") and rows["2025-01"].ltv_30d == Decimal("82.00")
    assert rows["2025-02"].cac is None and rows["2025-02"].ltv_30d_to_cac is None
    assert rows["2025-02"].ltv_30d == Decimal("55.00")  # exactly 30 days: from Jan 30
    # a range inside January still counts the whole month
    cut = kpi.cac_ltv_by_month(sales, fin, dim_time, "2025-01-05", "2025-01-05").collect()
    assert [r.month for r in cut] == ["2025-01"] and cut[0].cac == Decimal("3.00")


def test_titles_merge_when_shortened(spark, sales, dim_time):
    long = "x" * 27
    products = spark.createDataFrame([(1, long + "aaaa", True), (2, long + "bbbb", True), (2, "old", False)], "product_key long, title string, is_current boolean")
    rows = kpi.sales_by_product(sales, products, dim_time).collect()
    assert [(r["product"], float(r.revenue)) for r in rows] == [(long + "...", 261.0)]


def test_comparison_of_a_month_with_itself(sales, dim_time):
    rows = kpi.revenue_comparison(sales, dim_time, "2025-01", "2025-01").collect()
    assert len(rows) == 8 and rows[0].month_label == "Month 1" and rows[-1].month_label == "Month 2"
    assert float(kpi.revenue_by_month(sales, dim_time, currency="VND").first().revenue) == round(231 * 24708.655)


def test_profit_golden_value(spark):
    amounts = spark.createDataFrame([(1000, 100, 200, 50, 30)], "revenue int, refund_cost int, cost_of_goods int, total_platform_fees int, general_production_cost int")
    assert L.net_profit(amounts).first().net_profit == 620
    assert L.net_profit(amounts, ["refund_cost", "nope"]).first().net_profit == 900
    assert L.net_profit(amounts, None, use_default=False).first().net_profit == 0
    assert L.net_profit(amounts, []).first().net_profit == 0
    assert L.profit_formula_text().startswith("Profit = Revenue − (Refund Cost + ")


def test_statement_counts_listing_credit_twice(fin, bank, dim_time):
    amounts = L.pl_assemble(fin, bank, dim_time, "month_year")
    rows = {r.month: r for r in amounts.collect()}
    assert rows[1].total_vat_fees == Decimal("4.00") and rows[1].total_platform_fees == Decimal("19.00")
    assert rows[3].revenue == 0 and rows[3].cost_of_goods == Decimal("30.00")  # a month with bank rows only
    periods = [tuple(r) for r in L.pl_periods(fin, bank, dim_time, "month_year").collect()]
    assert periods == [(2025, 1, "January"), (2025, 3, "March")]
    wide = L.pl_statement(fin, bank, dim_time, "month").collect()
    assert wide[0]["Full Year"] is None and wide[1]["January"] == Decimal("150.00") and len(wide) == 36
    assert wide[-1]["Full Year"] == Decimal("150.00") - 30 - 19 - 80 - 20


def test_bank_rate_converts_costs(fin, bank, dim_time):
    r = L.pl_assemble(fin, bank, dim_time, "year", bank_rate=F.lit(Decimal("0.5"))).first()
    assert r.cost_of_goods == Decimal("40.00")


def test_allocation_adds_up(sales, fin):
    by_product = {r.product_id: r for r in P.allocate(sales, fin).collect()}
    assert float(by_product["A"].refund) == 18.0 and float(by_product["B"].refund) == 12.0
    assert float(by_product["A"].platform_fee) == 6.0 and float(by_product["B"].platform_fee) == 4.0 + 5.0
    alone = {r.product_id: r for r in P.allocate(sales, fin, ratio_scope="product").collect()}
    assert float(alone["A"].refund) == 30.0 and float(alone["B"].refund) == 30.0  # one product takes the whole order
    ratios = P.order_ratio(sales).groupBy("order_id").agg(F.sum("ratio").alias("r"), F.max("order_sales").alias("s")).collect()
    assert all(abs(float(x.r) - 1) < 1e-6 for x in ratios if x.s and x.s > 0)
    assert all(x.r == 0 for x in ratios if not x.s or x.s <= 0)


def test_shared_shuffle(sales, fin):
    df = P.allocate(sales, fin)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


def test_product_reports(spark, sales, fin, bank):
    catalog = spark.createDataFrame(
        [(1, "L", "A", "01", "red hat", "One"), (2, "L", "A", "02", "red hat", "Two"), (3, "K", "B", "02", None, "Two"), (4, "K", "C", "01", "new", "One"), (5, "K", "D", "01", "none", None)],
        "product_catalog_key long, product_line_id string, product_id string, variant_id string, product_name string, variant_name string",
    )
    rows = {(r.product_id, r.variant_name): r for r in P.product_profitability(sales, fin, bank, catalog).collect()}
    assert len(rows) == 4 and float(rows[("A", "One")].cogs) == 50.0 and float(rows[("A", "Two")].cogs) == 0.0
    assert rows[("A", "One")].sales == rows[("A", "Two")].sales == Decimal("96.00")  # product amounts repeat
    assert rows[("A", "One")].unit == 5 and rows[("C", "One")].sales == 0 and rows[("C", "One")].order_ids == ""
    assert rows[("A", "One")].order_ids == "1, 2, 4, 5"
    variants = P.variant_profitability(sales, fin, bank, catalog)
    assert {r.product_id for r in P.variant_profitability(sales, fin, bank, catalog, "A").collect()} == {"A"}
    total = {r.product_id: r for r in P.product_totals(variants).collect()}
    assert total["A"].sales == Decimal("192.00")  # sums over variants count the product twice
    listed = P.product_list(P.product_profitability(sales, fin, bank, catalog), "RED")
    assert [(r.product_id, r.variant_name) for r in listed.collect()] == [("A", "One")]
    margin = {(r.product_id, r.order_id): r for r in P.margin_breakdown(sales, fin, bank).collect()}
    assert margin[("A", "1")].cogs == Decimal("50.00") and float(margin[("A", "1")].sales_percent) == 100.0
    assert [r.fee_type for r in P.fee_breakdown(sales, fin, "B").collect()] == ["Transaction Fee", "Marketing"]
    assert [(r.pl_account_number, r.label) for r in P.cogs_breakdown(bank, "A").collect()] == [("6211", "Material cost (Yarn)"), ("6411", "Selling staff cost")]


def test_order_ids_of_a_large_product_come_in_parts(spark):
    rows = spark.range(1000).select(F.col("id").alias("order_id"), F.lit("A").alias("sku"), F.lit(1).cast("decimal(15,2)").alias("item_price"))
    parts = P.sku_order_ids(P.product_order_sales(rows), per_part=100).collect()
    ids = [int(i) for r in parts for i in r.order_ids.split(", ")]
    assert sorted(ids) == list(range(1000)) and len(parts) > 5
    assert P.sales_by_sku(rows).first().order_ids.startswith("0, 1, 2, ")


@pytest.fixture(scope="module")
def accounts(spark):
    return spark.createDataFrame([(7, "N1", "Main", None, None, None, "VND"), (8, "N2", None, None, None, None, None), (9, "", "blank", None, None, None, "USD")], "bank_account_key long, account_number string, account_name string, cif_number string, customer_address string, opening_date date, currency_code string")


def test_bank_reports(spark, bank, accounts, dim_time):
    rows = B.bank_account_summary(bank, accounts, dim_time).collect()
    assert [(r.account_number, r.current_balance) for r in rows] == [("N2", Decimal("7.00")), ("N1", Decimal("99.00"))]  # the largest balance
    assert val(B.bank_account_count(accounts)) == 2
    info = B.bank_account_info(accounts, "N2").first()
    assert (info.account_name, info.currency_code) == ("N/A", "VND")
    st = B.account_statement(bank, accounts, dim_time, "N1", "2025-01-11", "2025-1").collect()
    assert [(r.reference_number, r.credit_amount) for r in st] == [("R2", 0)]
    assert val(B.bank_transaction_count(bank, "50%")) == 1 and val(B.bank_transaction_count(bank, account_number="N1")) == 2
    catalog = spark.createDataFrame([(1, "L", "A", "01", "line", "hat", "One")], "product_catalog_key long, product_line_id string, product_id string, variant_id string, product_line_name string, product_name string, variant_name string")
    page = B.browse_bank_transactions(bank, accounts, catalog, dim_time, limit=2, offset=1).collect()
    assert [r.bank_transaction_key for r in page] == [3, 2]
    full = B.browse_bank_transactions(bank, accounts, catalog, dim_time, sort_by="debit_amount", sort_order="asc").collect()
    assert [r.bank_transaction_key for r in full] == [2, 4, 1, 3] and full[0].product_name == "hat"
    assert [r.value for r in B.distinct_values(accounts, "currency_code").collect()] == ["USD", "VND"]
    assert B.filter_any_column(accounts, "MAIN").count() == 1 and B.filter_accounts(accounts, "n", "VND").count() == 1


def test_a_large_product_stays_one_row_with_all_order_ids(spark, fin, bank):
    sales = spark.range(1000).select(F.col("id").alias("order_id"), F.lit("A").alias("sku"), F.lit(1).cast("decimal(15,2)").alias("item_price"))
    catalog = spark.createDataFrame(
        [(1, "L", "A", "01", "red hat", "One"), (2, "L", "A", "02", "red hat", "Two"), (3, "K", "C", "01", "new", "One")],
        "product_catalog_key long, product_line_id string, product_id string, variant_id string, product_name string, variant_name string",
    )
    every = ", ".join(str(i) for i in range(1000))
    assert [(r.product_id, r.sales, r.order_ids) for r in P.sales_by_sku(sales, per_part=100).collect()] == [("A", Decimal("1000.00"), every)]
    report = P.product_profitability(sales, fin, bank, catalog, per_part=100)
    assert [(r.product_id, r.variant_name, r.order_ids) for r in report.collect()] == [("C", "One", ""), ("A", "One", every), ("A", "Two", every)]
    assert [(r.variant_name, r.order_ids) for r in P.product_list(report, "red").collect()] == [("One", every)]


def test_totals_beyond_ten_to_the_twelfth(spark, bank):
    big = Decimal("9000000000000.01")
    rows = [(1, "A", big)] * 3 + [(1, "B", Decimal("0.02")), (1, "B", Decimal("9000000000000.00")), (2, "A", Decimal("-5.00")), (2, "B", Decimal("12.00"))]
    sales = spark.createDataFrame(rows, "order_id long, sku string, item_price decimal(15,2)")
    kind = "transaction_type string, transaction_title string, order_id long, amount decimal(15,2), fees_and_taxes decimal(15,2)"
    fin = spark.createDataFrame([("Refund", "r", 1, -big, None), ("Refund", "r", 1, -big, None), ("Fee", "Transaction fee", 1, None, -big), ("Refund", "r", 2, Decimal("-1.00"), None)], kind)
    catalog = spark.createDataFrame([(1, "L", "A", "01", "red", "One"), (2, "L", "B", "02", "red", "One")], "product_catalog_key long, product_line_id string, product_id string, variant_id string, product_name string, variant_name string")

    def half_up(top, bottom, digits):
        n, d = (top * 10**digits).as_integer_ratio(), bottom.as_integer_ratio()
        num, den = n[0] * d[1], n[1] * d[0]
        size = (2 * abs(num) + den) // (2 * den)
        return Decimal(size if num >= 0 else -size).scaleb(-digits)

    own = {(1, "A"): Decimal("27000000000000.03"), (1, "B"): Decimal("9000000000000.02"), (2, "A"): Decimal("-5.00"), (2, "B"): Decimal("12.00")}
    whole = {1: Decimal("36000000000000.05"), 2: Decimal("7.00")}
    refund, fee = {1: 2 * big, 2: Decimal("1.00")}, {1: big, 2: Decimal("0.00")}
    got = {(r.order_id, r.product_id): r for r in P.order_ratio(sales).collect()}
    assert {k: r.ratio for k, r in got.items()} == {k: half_up(v, whole[k[0]], 8) for k, v in own.items()}

    from fractions import Fraction

    part = {k: half_up(Fraction(refund[k[0]]) * Fraction(v), Fraction(whole[k[0]]), 8) for k, v in own.items()}
    charge = {k: half_up(Fraction(fee[k[0]]) * Fraction(v), Fraction(whole[k[0]]), 8) for k, v in own.items()}
    for r in P.product_profitability(sales, fin, bank.limit(0), catalog).collect():
        assert r.refund == part[(1, r.product_id)] + part[(2, r.product_id)]
        assert r.platform_fee == charge[(1, r.product_id)] + charge[(2, r.product_id)]
        assert r.profit == r.sales - r.refund - r.platform_fee and r.sales > 10**12 / 2
    variants = P.variant_profitability(sales, fin, bank.limit(0), catalog, ratio_scope="order")
    for r in [*variants.collect(), *P.product_totals(variants).collect()]:
        assert r.margin == half_up(Fraction(r.profit) * 100, Fraction(r.sales), 4)
    for r in P.margin_breakdown(sales, fin, bank.limit(0), ratio_scope="order").collect():
        key = (int(r.order_id), r.product_id)
        assert r.sales_percent == half_up(Fraction(own[key]) * 100, Fraction(whole[key[0]]), 4)
    fees = {r.product_id: r.amount for r in P.fee_breakdown(sales, fin, ratio_scope="order").collect()}
    assert fees == {p: charge[(1, p)] for p in "AB"}


def test_quotients_are_exact_on_both_paths(spark):
    from fractions import Fraction

    cases = [("0.05", "0.10", "0.03"), ("-1.00", "2.00", "3.00"), ("99999999.99", "99999999.99", "0.01"), ("0.01", "0.01", "70000000000.00"), ("5000000000000.01", "3.00", "7.00"), ("1.00", "1.00", "0.00"), ("999999999999.99", "0.07", "13.00")]
    rows = [tuple(map(Decimal, c)) for c in cases]
    df = spark.createDataFrame(rows, "a decimal(20,2), b decimal(20,2), w decimal(20,2)")
    got = df.select("a", "b", "w", P._quotient([(F.col("a"), 2), (F.col("b"), 2)], (F.col("w"), 2), 6, 8).alias("q")).collect()
    for r in got:
        if r.w == 0:
            assert r.q is None
            continue
        exact = Fraction(r.a) * Fraction(r.b) / Fraction(r.w) * 10**8
        size = (2 * abs(exact.numerator) + exact.denominator) // (2 * exact.denominator)
        assert r.q == Decimal(size if exact >= 0 else -size).scaleb(-8)


def _sorts(spark, n=230):
    rows = [(i, None if i % 7 == 0 else (i * 37) % 20, f"t{i % 5}") for i in range(n)]
    return spark.createDataFrame(rows, "bank_transaction_key long, debit_amount long, text string").repartition(4)


@pytest.mark.parametrize("down", [False, True])
def test_pages_by_seek_and_by_offset_are_the_same(spark, down):
    rows = _sorts(spark)
    order = [("debit_amount", down), ("bank_transaction_key", not down)]
    everything = [tuple(r) for r in rows.orderBy(*B.sort_columns(order)).collect()]
    last = None
    for n in range(6):
        want = everything[50 * n : 50 * n + 50]
        assert [tuple(r) for r in B.page(rows, order, 50, offset=50 * n).collect()] == want
        if last is not None:
            assert [tuple(r) for r in B.page(rows, order, 50, after=last).collect()] == want
        last = (want[-1][1], want[-1][0]) if want else last
    assert [tuple(r) for r in B.page(rows, order, None, offset=200).collect()] == everything[200:]
    assert B.page(rows.limit(0), order, 10, offset=5).count() == 0
    plan = B.page(rows, order, 50, offset=100)._jdf.queryExecution().executedPlan().toString()
    assert "GlobalLimit" not in plan and "CollectLimit" not in plan


def test_latest_balance_is_of_the_last_row(spark, dim_time):
    bank = spark.createDataFrame(
        [(1, 1, 20250110, 5, None, Decimal("90.00")), (2, 1, 20250111, None, 5, Decimal("40.00")), (3, 1, 20250111, 1, None, Decimal("41.00")), (4, 1, 20250112, 1, None, None)],
        "bank_transaction_key long, bank_account_key long, transaction_date_key int, credit_amount int, debit_amount int, balance_after_transaction decimal(15,2)",
    )
    accounts = spark.createDataFrame([(1, "N1", "Main", None, None, None, "VND")], "bank_account_key long, account_number string, account_name string, cif_number string, customer_address string, opening_date date, currency_code string")
    (row,) = B.bank_account_summary(bank, accounts, dim_time, latest=True).collect()
    assert (row.current_balance, row.latest_balance) == (Decimal("90.00"), Decimal("41.00"))


def test_trailing_customers_against_counting(spark):
    import datetime as dt
    import random

    rng = random.Random(3)
    start = dt.date(2025, 1, 1)
    rows = [(rng.choice([None, 1, 2, 3, 4, 5, 6]), start + dt.timedelta(rng.randrange(200)), k) for k in range(150)]
    key = lambda d: d.year * 10000 + d.month * 100 + d.day
    sales = spark.createDataFrame([(c, key(d), k, Decimal(1)) for c, d, k in rows], "customer_key long, sale_date_key int, order_key long, item_total decimal(15,2)")
    ends = [dt.date(2025, m, 28) for m in range(1, 8)]
    purchases = kpi.purchase_days(sales, build_dim_time(spark, "2025-01-01", "2025-12-31"))
    got = {r["last"]: tuple(r)[1:] for r in kpi.trailing_customers(purchases, spark.createDataFrame([(d,) for d in ends], "last date"), (1, 30, 90)).collect()}
    for last in ends:
        assert got[last] == tuple(len({c for c, d, _ in rows if c and last - dt.timedelta(h - 1) <= d <= last}) for h in (1, 30, 90))


def test_estimated_counts_are_close(spark):
    days = build_dim_time(spark, "2025-01-01", "2025-12-31")
    sales = spark.range(40_000).select(
        F.col("id").alias("order_key"), (F.col("id") % 9000).alias("customer_key"), (F.lit(20250100) + F.col("id") % 28 + 1).cast("int").alias("sale_date_key")
    )
    sketches = kpi.daily_sketches(sales, days)
    assert sketches.count() <= 56
    for start, end in ((None, None), ("2025-01-05", "2025-01-20")):
        for kind in ("all", "return", "new"):
            got = kpi.approximate_counts(sketches, start, end, kind).first()
            assert got.total_orders == pytest.approx(val(kpi.total_orders(sales, days, start, end, kind)), rel=0.06, abs=1)
            assert got.total_customers == pytest.approx(val(kpi.total_customers(sales, days, start, end, kind)), rel=0.06, abs=1)


def test_ids_of_a_hot_product_are_put_in_order_not_sorted_again(spark):
    rows = spark.range(5000).select(((F.col("id") * 7919) % 5003).alias("order_id"), F.when(F.col("id") % 50 == 0, "B").otherwise("A").alias("sku"), F.lit(1).cast("decimal(15,2)").alias("item_price"))
    pos = P.product_order_sales(rows)
    parts = P._ordered_id_parts(pos, per_part=100).collect()
    hot = sorted((r.part, r.ids) for r in parts if r.product_id == "A")
    assert len(hot) == P.ORDER_ID_PARTS and max(len(ids) for _, ids in hot) < 200
    assert [i for _, ids in hot for i in ids] == sorted(i for _, ids in hot for i in ids)
    listed = {r.product_id: r.order_ids for r in P.sales_by_sku(rows, per_part=100).collect()}
    for product, text in listed.items():
        ids = [int(i) for i in text.split(", ")]
        assert ids == sorted(r.order_id for r in rows.filter(F.col("sku") == product).collect())
