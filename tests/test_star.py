import datetime as dt

import pytest
from pyspark.sql import functions as F

from shopledger.operators import dimensions as D
from shopledger.operators import facts as FB
from shopledger.operators import merge as M
from shopledger.operators.keys import assign_keys, keep_first


def test_calendar(spark):
    days = {r.full_date: r for r in D.build_dim_time(spark, "2020-12-30", "2025-01-02", dt.date(2025, 1, 1)).collect()}
    assert days[dt.date(2021, 1, 3)].week_of_year == 53 and days[dt.date(2021, 1, 3)].day_of_week == 7
    assert days[dt.date(2024, 2, 29)].day_of_year == 60 and days[dt.date(2024, 2, 29)].retail_season == "Winter/Valentine"
    assert days[dt.date(2025, 1, 1)].is_current_day and days[dt.date(2024, 12, 30)].is_current_week
    assert D.build_dim_time(spark).count() == 4018


def test_keys_are_dense_and_stable(spark):
    df = spark.range(1000).select(F.concat(F.lit("k"), "id").alias("k"))
    first = {r.k: r.sk for r in assign_keys(df, "k", "sk").collect()}
    again = {r.k: r.sk for r in assign_keys(df.repartition(7), "k", "sk").collect()}
    assert sorted(first.values()) == list(range(1, 1001)) and first == again
    assert assign_keys(df, "k", "sk", after=F.lit(10)).agg(F.min("sk")).first()[0] == 11


def test_keep_first_needs_an_order(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1)], "k string, v int")
    with pytest.raises(ValueError, match="No order"):
        keep_first(df, ["k"], [])
    assert keep_first(df.select("k"), ["k"], []).count() == 1


def test_keep_first_orders_explicitly(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, None)], "k string, o int, v string")
    assert sorted(tuple(r) for r in keep_first(df, ["k"], ["o"]).collect()) == [("a", 1, "y"), ("b", 3, None)]


ORDERS = "order_id string, full_name string, ship_country string, ship_state string, ship_city string, ship_zipcode string, payment_method string, coupon_code string, discount_amount double"


@pytest.fixture(scope="module")
def orders(spark):
    return spark.createDataFrame(
        [
            ("2", "Second", "United States", "NY", "A", "2", "paypal", "X%", 1.0),
            ("1", None, "Japan", None, "B", "9", None, None, None),
            ("3", "Third", "United States", "NY", "A", "1", "Credit", "FLAT", 0.0),
            ("4", "Fourth", None, "NY", "A", "1", None, None, 0.0),
        ],
        ORDERS,
    )


@pytest.fixture(scope="module")
def checkout(spark):
    return spark.createDataFrame(
        [("1", "bob", "S1", "online"), ("2", "bob", "S2", "online"), ("9", "eve", None, "inperson"), ("9", "eve", None, "inperson"), ("3", None, "x", None)],
        "order_id string, buyer_username string, buyer string, payment_type string",
    )


def test_geography_null_state_and_postal_codes(spark, orders):
    rows = {r.country_name: r for r in D.build_dim_geography(orders).collect()}
    assert len(rows) == 2 and rows["United States"].postal_code == "1"  # one row per hash, smallest code
    items = spark.createDataFrame([("1", "Japan", None, "B"), ("2", "United States", "NY", "A")], "order_id string, ship_country string, ship_state string, ship_city string")
    fact = FB.build_fact_sales(items, dims={"dim_geography": D.build_dim_geography(orders)}).orderBy("order_id").collect()
    assert fact[0].geography_key is None and fact[1].geography_key is not None  # a null part never matches


def test_customer_takes_first_non_null_by_order(spark, orders, checkout):
    rows = {r.buyer_user_name: r for r in D.build_dim_customer(orders, checkout).collect()}
    assert set(rows) == {"bob", "eve"}
    assert rows["bob"].full_name == "Second" and rows["bob"].country == "Japan" and rows["bob"].ship_name == "S1"
    assert rows["bob"].is_current and str(rows["bob"].expiry_date).startswith("2262-04-11")
    by_name = {r.buyer_user_name for r in D.build_dim_customer(orders, None).collect()}
    assert by_name == {"Second", "Third", "Fourth"}


def test_order_dimension(spark, orders, checkout):
    rows = {r.order_id: r for r in D.build_dim_order(orders, checkout).collect()}
    assert set(rows) == {1, 2, 3, 4, 9}  # repeated payments do not fan out
    assert [rows[i].discount_type for i in (1, 2, 3)] == [None, "Percentage", "Fixed"]  # no coupon, no type
    assert [rows[i].is_international for i in (1, 2, 9)] == [True, False, None]
    assert [rows[i].has_discount for i in (1, 2, 3)] == [False, True, False]


def test_payment_dimension(spark, orders, checkout):
    rows = {r.payment_method: r for r in D.build_dim_payment({"sold_orders": orders, "direct_checkout": checkout}).collect()}
    assert rows["inperson"].payment_type == "In-person" and rows["paypal"].payment_provider == "PayPal"
    only = D.build_dim_payment({"sold_orders": orders.select("order_id")}).collect()
    assert [r.payment_method for r in only] == ["Unknown"]


def test_product_dimension(spark):
    listing = spark.createDataFrame([(" Red HAT ", "1,250.50", "5", "a,b", "red"), (None, "1", "1", None, None), ("Alone", "3", "2", None, None)], "title string, price string, quantity string, tags string, color string")
    items = spark.createDataFrame([("10.0", "red hat", 9.0, 2, "S"), ("11", "other", 7.0, 3, "T"), ("11", "other", 8.0, 3, "T"), ("12", None, 1.0, 1, None)], "listing_id string, item_name string, price double, quantity int, sku string")
    rows = {(r.listing_id, r.title): r for r in D.build_dim_product(listing, items).collect()}
    hat = rows[(10, "Red HAT")]
    assert (float(hat.price), hat.quantity, hat.tags_list, hat.sku_list, hat.color) == (1250.5, 5, ["a", "b"], ["S"], "red")
    assert (11, "other") in rows and (None, "Alone") in rows
    assert rows[(12, None)].tags_list == []  # a null name matches no null title
    assert float(rows[(11, "other")].price) == 7.0


def test_bank_account_dimension(spark):
    raw = spark.createDataFrame([("1", None, "20200131"), ("2", "x", "31/12/2019"), (None, "y", None)], "Account_Number string, Account_Name string, Opening_Date string")
    rows = {r.account_number: r for r in D.build_dim_bank_account(raw).collect()}
    assert rows["1"].account_name == "1" and rows["1"].opening_date == dt.date(2020, 1, 31) and rows["1"].currency_code == "VND"
    assert rows["2"].opening_date == dt.date(2019, 12, 31) and len(rows) == 2


def test_financial_fact_gets_order_keys(spark, orders, checkout):
    dims = {"dim_order": D.build_dim_order(orders, checkout), "dim_customer": D.build_dim_customer(orders, checkout)}
    st = spark.createDataFrame([(dt.date(2025, 1, 2), "1", "order_id"), (None, "7", "listing_id"), (None, "8", "transaction_id")], "date date, extracted_id string, id_type string")
    rows = {r.extracted_id: r for r in FB.build_fact_financial(st, checkout, None, dims).collect()}
    assert rows["1"].order_id == 1 and rows["1"].order_key is not None and rows["1"].customer_key is not None
    assert rows["7"].order_id is None and rows["8"].transaction_id == 8 and rows["8"].order_key is None


def test_deposit_with_bad_date_keeps_null_key(spark):
    d = spark.createDataFrame([(None, 5.0, "paid", "0012")], "date date, amount double, status string, bank_account_ending_digits string")
    r = FB.build_fact_deposits(d, "b1").first()
    assert r.deposit_date_key is None and r.bank_account_ending_digits == 12 and r.batch_id == "b1"


def test_bank_fact_keys(spark):
    bank = spark.createDataFrame(
        [(dt.date(2025, 1, 1), "R1", "A", "t", "6211", "L", "P", "V"), (None, "R2", "B", "t", None, None, None, None)],
        "transaction_date date, reference_number string, account_number string, transaction_description string, pl_account_number string, parsed_product_line_id string, parsed_product_id string, parsed_variant_id string",
    )
    accounts = spark.createDataFrame([("A ", 7)], "account_number string, bank_account_key long")
    catalog = spark.createDataFrame([("L", "P", "V", 3)], "product_line_id string, product_id string, variant_id string, product_catalog_key long")
    fact = FB.build_fact_bank(bank, accounts, catalog)
    rows = {r.reference_number: r for r in fact.collect()}
    assert (rows["R1"].bank_account_key, rows["R1"].product_catalog_key, rows["R1"].is_business_related) == (7, 3, True)
    assert (rows["R2"].bank_account_key, rows["R2"].product_catalog_key, rows["R2"].transaction_date_key) == (None, None, None)
    stats = FB.bank_match_stats(fact).first()
    assert (stats.row_count, stats.product_rows, float(stats.product_percent)) == (2, 1, 50.0)


def test_merge_twice_is_idempotent(spark):
    stored = spark.createDataFrame([(5, "a", "old")], "k long, b string, v string")
    incoming = spark.createDataFrame([(1, "a", "new"), (2, "c", "n1"), (3, "c", "n0"), (4, None, "x")], "k long, b string, v string")
    once = M.upsert_dimension(stored, incoming, "b", "k", ["v"])
    twice = M.upsert_dimension(once, incoming, "b", "k", ["v"])
    assert sorted(map(tuple, once.collect())) == [(5, "a", "old"), (6, "c", "n0")] == sorted(map(tuple, twice.collect()))
    mapping = M.key_mapping(incoming, once, "b", "k")
    fact = spark.createDataFrame([(1,), (3,), (99,), (None,)], "k long")
    assert sorted((r.k for r in M.remap_keys(fact, "k", mapping).collect()), key=str) == sorted([5, 6, 99, None], key=str)


def test_merge_star_remaps_facts(spark):
    stored = {"dim_customer": spark.createDataFrame([(40, "bob", True)], "customer_key long, buyer_user_name string, is_current boolean")}
    built = {
        "dim_customer": spark.createDataFrame([(1, "bob", True), (2, "eve", True)], "customer_key long, buyer_user_name string, is_current boolean"),
        "fact_sales": spark.createDataFrame([(1, 10), (2, 20)], "customer_key long, item_total int"),
    }
    out = M.merge_star(stored, built)
    assert sorted(map(tuple, out["fact_sales"].select("customer_key", "item_total").collect())) == [(40, 10), (41, 20)]
