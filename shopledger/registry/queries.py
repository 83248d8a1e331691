"""Every operator as a query over the driver tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import bank as bank_text
from ..functions import listing as listing_text
from ..functions.lookups import country_columns, is_peak_season, retail_season, selling_season
from ..functions.money import clean_statement_currency, parse_currency, vnd_to_usd
from ..functions.statement import categorize_fee_type, categorize_revenue_type, extract_id_from_info
from ..functions.text import clean_text, coerce_star_types, null_tokens, parse_list, sku_to_list
from ..functions.dates import parse_date
from ..operators import cleaners as C
from ..operators import delete as X
from ..operators import dimensions as D
from ..operators import facts as FB
from ..operators import filters as FL
from ..operators import merge as M
from ..operators import versions as V
from ..operators.keys import assign_keys
from ..plans import bank_reports as B
from ..plans import kpi
from ..plans import product_cost as P
from ..plans import profit_loss as L
from ..session import delete_path, scratch_path, shuffles_dropped, through_table
from ..sources import bank_export, files, sinks, validate
from ..streaming import ingest
from . import adapter as A

QUERIES: dict = {}


def comparable(df: DataFrame) -> DataFrame:
    """Types that both engines print alike: integers as bigint, decimals as double, dates as text. Nothing is rounded."""
    out = []
    for f in df.schema.fields:
        c, kind = F.col(f"`{f.name}`"), f.dataType
        if isinstance(kind, T.DecimalType):
            c = c.cast("double")
        elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(kind, T.DateType):
            c = c.cast("string")
        elif isinstance(kind, T.ArrayType):
            c = F.array_join(c, "|")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(fn):
    QUERIES[fn.__name__] = lambda spark, sf: comparable(fn(spark, sf))
    return fn


# ---- key figures --------------------------------------------------------------------------------------------------

RANGE = ("1996-03-15", "1998-10-04")


@query
def date_filter(spark, sf):
    rows = FL.date_filter(A.sales(spark, sf), A.dim_time(spark), "sale_date_key", *RANGE, ["full_date"])
    return rows.groupBy("full_date").agg(F.count("*").alias("line_count"))


@query
def customer_classes(spark, sf):
    return FL.customer_classes(A.sales(spark, sf))


@query
def customer_filter(spark, sf):
    sales = A.sales(spark, sf)
    rows = FL.customer_filter(sales, sales, "return")
    return rows.groupBy("customer_key").agg(F.count("*").alias("line_count"), F.sum("item_total").alias("item_total"))


def _kpi(name, fn, *args, **kwargs):
    def run(spark, sf):
        return fn(A.sales(spark, sf), A.dim_time(spark), *args, **kwargs)

    QUERIES[name] = lambda spark, sf: comparable(run(spark, sf))


_kpi("total_revenue", kpi.total_revenue)
_kpi("total_revenue_new", kpi.total_revenue, customer_type="new")
_kpi("total_orders", kpi.total_orders)
_kpi("total_orders_return", kpi.total_orders, customer_type="return")
_kpi("total_customers", kpi.total_customers)
_kpi("average_order_value", kpi.average_order_value)
_kpi("aov_over_time", kpi.aov_over_time)
_kpi("revenue_by_month", kpi.revenue_by_month)
_kpi("revenue_by_month_range_return", kpi.revenue_by_month, *RANGE, customer_type="return")
_kpi("orders_by_month", kpi.orders_by_month)
_kpi("new_vs_returning_sales", kpi.new_vs_returning_sales)
_kpi("new_customers_over_time", kpi.new_customers_over_time)
_kpi("retention_rate", kpi.retention_rate)
_kpi("retention_rate_range", kpi.retention_rate, *RANGE)
_kpi("customer_lifetime_value", kpi.customer_lifetime_value)
_kpi("customer_lifetime_value_90d_new", kpi.customer_lifetime_value, "2001-06-30", customer_type="new", period_days=90)
_kpi("revenue_comparison", kpi.revenue_comparison, "1997-02", "1998-02")
_kpi("currency_view", kpi.revenue_by_month, currency="VND")


@query
def profit_by_month(spark, sf):
    return kpi.profit_by_month(A.payments(spark, sf), A.dim_time(spark))


@query
def customers_by_location(spark, sf):
    return kpi.customers_by_location(A.sales(spark, sf, geography=True), A.dim_geography(spark, sf), A.dim_time(spark))


@query
def sales_by_product(spark, sf):
    return kpi.sales_by_product(A.sales(spark, sf), A.dim_product(spark, sf), A.dim_time(spark))


@query
def customer_acquisition_cost(spark, sf):
    start = "1990-01-01"
    return kpi.customer_acquisition_cost(A.sales(spark, sf), A.financial(spark, sf), A.dim_time(spark), start)


@query
def cac_ltv_by_month(spark, sf):
    return kpi.cac_ltv_by_month(A.sales(spark, sf), A.financial(spark, sf), A.dim_time(spark))


@query
def approximate_counts(spark, sf):
    """Exact orders and customers per class of a range, and whether the estimates from daily sketches are within 5 percent."""
    sales, days = A.sales(spark, sf), A.dim_time(spark)
    sketches = through_table(kpi.daily_sketches(sales, days), "sketches")

    def both(kind):
        exact = kpi.total_orders(sales, days, *RANGE, kind), kpi.total_customers(sales, days, *RANGE, kind)
        estimate = kpi.approximate_counts(sketches, *RANGE, kind).select(F.struct("*").alias("e")).scalar()
        row = spark.range(1).select(F.lit(kind).alias("customer_type"), exact[0].scalar().alias("orders"), exact[1].scalar().alias("customers"), estimate.alias("e"))
        close = [(F.abs(F.col(f"e.total_{c}") - F.col(c)) <= 0.05 * F.col(c) + 1).alias(f"{c}_close") for c in ("orders", "customers")]
        return row.select("customer_type", "orders", "customers", *close)

    return both("all").union(both("new")).union(both("return"))


@query
def month_aggregates(spark, sf):
    return kpi.month_aggregates(A.sales(spark, sf), A.payments(spark, sf), A.dim_time(spark), "1995-01-01", "2001-12-31")


@query
def comparison_percentages(spark, sf):
    return kpi.comparison_percentages(A.sales(spark, sf), A.payments(spark, sf), A.dim_time(spark), "1997-02", "1998-02")


# ---- profit and loss ----------------------------------------------------------------------------------------------


@query
def pl_periods(spark, sf):
    return L.pl_periods(A.financial(spark, sf), A.bank(spark, sf), A.dim_time(spark), "month_year")


@query
def pl_revenue_fees(spark, sf):
    return L.revenue_and_fees(A.financial(spark, sf), A.dim_time(spark), "month_year")


@query
def pl_cogs(spark, sf):
    return L.cost_of_goods(A.bank(spark, sf), A.dim_time(spark), "month_year")


@query
def pl_operating_costs(spark, sf):
    return L.operating_costs(A.bank(spark, sf), A.dim_time(spark), "month_year")


def _amounts(spark, sf, view):
    return L.pl_assemble(A.financial(spark, sf), A.bank(spark, sf), A.dim_time(spark), view)


@query
def pl_assemble(spark, sf):
    return _amounts(spark, sf, "month")


@query
def net_profit(spark, sf):
    by_default = L.net_profit(_amounts(spark, sf, "month_year"))
    chosen = L.net_profit(by_default.withColumnRenamed("net_profit", "default_profit"), ["refund_cost", "no_such", "listing_fee"])
    return chosen.select("year", "month", "revenue", "default_profit", F.col("net_profit").alias("chosen_profit"))


@query
def pl_statement_long(spark, sf):
    return L.pl_statement_long(L.net_profit(_amounts(spark, sf, "month")), "month")


@query
def pl_statement(spark, sf):
    return L.pl_statement(A.financial(spark, sf), A.bank(spark, sf), A.dim_time(spark), "year")


# ---- product cost -------------------------------------------------------------------------------------------------


def _sf(spark, sf):
    return A.sales(spark, sf, price=True), A.financial(spark, sf)


@query
def sales_by_sku(spark, sf):
    return P.sales_by_sku(A.sales(spark, sf, price=True))


@query
def sku_order_ids(spark, sf):
    parts = P.sku_order_ids(P.product_order_sales(A.sales(spark, sf, price=True)), per_part=10)
    ids = parts.select("product_id", "parts", F.explode(F.split("order_ids", ", ")).alias("order_id"))
    return ids.select("product_id", "parts", F.col("order_id").cast("bigint").alias("order_id"))


@query
def order_ratio(spark, sf):
    return P.order_ratio(A.sales(spark, sf, price=True))


@query
def order_refunds(spark, sf):
    return P.order_refunds(A.financial(spark, sf))


@query
def order_fees(spark, sf):
    return P.order_fees(A.financial(spark, sf))


@query
def allocate(spark, sf):
    return P.allocate(*_sf(spark, sf))


@query
def allocate_product_scope(spark, sf):
    return P.allocate(*_sf(spark, sf), ratio_scope="product")


@query
def cogs_by_product_variant(spark, sf):
    return P.cogs_by_product_variant(A.bank(spark, sf))


@query
def product_profitability(spark, sf):
    return P.product_profitability(*_sf(spark, sf), A.bank(spark, sf), A.dim_product_catalog(spark, sf))


def _variants(spark, sf):
    return P.variant_profitability(*_sf(spark, sf), A.bank(spark, sf), A.dim_product_catalog(spark, sf))


@query
def variant_profitability(spark, sf):
    return _variants(spark, sf)


@query
def cogs_breakdown(spark, sf):
    return P.cogs_breakdown(A.bank(spark, sf))


@query
def fee_breakdown(spark, sf):
    return P.fee_breakdown(*_sf(spark, sf))


@query
def fee_breakdown_order_scope(spark, sf):
    return P.fee_breakdown(*_sf(spark, sf), ratio_scope="order")


@query
def margin_breakdown(spark, sf):
    return P.margin_breakdown(*_sf(spark, sf), A.bank(spark, sf))


@query
def product_list(spark, sf):
    rows = P.product_profitability(*_sf(spark, sf), A.bank(spark, sf), A.dim_product_catalog(spark, sf))
    return P.product_list(rows, "red").drop("order_ids")


@query
def product_totals(spark, sf):
    return P.product_totals(_variants(spark, sf))


# ---- bank and catalog reports -------------------------------------------------------------------------------------


@query
def bank_account_summary(spark, sf):
    return B.bank_account_summary(A.bank(spark, sf), A.accounts(spark, sf), A.dim_time(spark), limit=None)


@query
def bank_account_page(spark, sf):
    return B.bank_account_summary(A.bank(spark, sf), A.accounts(spark, sf), A.dim_time(spark), limit=5, offset=3)


@query
def bank_account_latest_balance(spark, sf):
    """The balance after the last row of each account, beside the largest one."""
    rows = B.bank_account_summary(A.bank(spark, sf), A.accounts(spark, sf), A.dim_time(spark), None, latest=True)
    return rows.select("account_number", "current_balance", "latest_balance", "last_transaction_date")


@query
def bank_rows_by_seek(spark, sf):
    """The third page of bank rows by debit, found behind the last row of the second one, which was found at its offset."""
    args = (A.bank(spark, sf, texts=True), A.accounts(spark, sf), A.dim_product_catalog(spark, sf), A.dim_time(spark))
    kind = dict(sort_by="debit_amount", sort_order="asc", limit=250)
    rows = A.bank(spark, sf)
    order = B.bank_order("debit_amount", "asc")
    last = B.page(rows, order, 250, offset=250).select(*[c for c, _ in order]).collect()[-1]
    return B.browse_bank_transactions(*args, **kind, after=list(last)).select("bank_transaction_key", "transaction_date", "account_name", "debit_amount")


@query
def bank_account_count(spark, sf):
    return B.bank_account_count(A.accounts(spark, sf))


@query
def bank_account_info(spark, sf):
    return B.bank_account_info(A.accounts(spark, sf))


@query
def account_statement(spark, sf):
    return B.account_statement(A.bank(spark, sf, texts=True), A.accounts(spark, sf), A.dim_time(spark), start="1996-01-01", end="bad")


@query
def browse_catalog(spark, sf):
    return B.browse_catalog(A.dim_product_catalog(spark, sf), "red", "product_name", "desc", limit=50, offset=20)


@query
def catalog_count(spark, sf):
    return B.catalog_count(A.dim_product_catalog(spark, sf), "ECONOMY")


@query
def browse_bank_transactions(spark, sf):
    return B.browse_bank_transactions(
        A.bank(spark, sf, texts=True),
        A.accounts(spark, sf),
        A.dim_product_catalog(spark, sf),
        A.dim_time(spark),
        search="economy",
        limit=200,
        offset=100,
    )


@query
def browse_all_bank_transactions(spark, sf):
    return B.browse_bank_transactions(
        A.bank(spark, sf, texts=True),
        A.accounts(spark, sf),
        A.dim_product_catalog(spark, sf),
        A.dim_time(spark),
        sort_by="debit_amount",
        limit=None,
    )


@query
def bank_transaction_count(spark, sf):
    return B.bank_transaction_count(A.bank(spark, sf, texts=True), "r%9")


@query
def filter_accounts(spark, sf):
    summary = B.bank_account_summary(A.bank(spark, sf), A.accounts(spark, sf), A.dim_time(spark), limit=None)
    return B.filter_accounts(summary, "s1", "VND").select("account_number", "currency_code", "total_credit")


@query
def filter_any_column(spark, sf):
    return B.filter_any_column(A.dim_product_catalog(spark, sf), "WIDGET").select("product_code", "product_name")


@query
def distinct_values(spark, sf):
    catalog = B.distinct_values(A.dim_product_catalog(spark, sf), "product_line_id").withColumn("list", F.lit("line"))
    return catalog.union(B.distinct_values(A.accounts(spark, sf), "currency_code").withColumn("list", F.lit("currency")))


# ---- cleaners -----------------------------------------------------------------------------------------------------


@query
def null_tokens_query(spark, sf):
    raw = null_tokens(A.raw_statement(spark, sf).select("Title", "Amount", "Net", F.col("Tax Details").alias("tax")))
    return raw.groupBy("Title").agg(
        F.count("*").alias("line_count"), F.count("Amount").alias("amounts"), F.count("Net").alias("nets"), F.count("tax").alias("taxes")
    )


@query
def clean_text_query(spark, sf):
    text = F.concat(F.lit(" \t"), F.replace("c_name", F.lit("#"), F.lit("  \n #")), F.lit("  "))
    null_word = F.when(F.col("c_mktsegment") == "BUILDING", " NaN ").otherwise(F.col("c_mktsegment"))
    return A.table(spark, sf, "customer").select(
        "c_custkey", clean_text(text, 15).alias("name"), clean_text(null_word).alias("segment")
    )


@query
def parse_currency_query(spark, sf):
    raw = A.raw_sold_order_items(spark, sf)
    values = raw.select(
        F.col("Transaction ID").cast("bigint").alias("id"),
        parse_currency("Item Total").alias("item_total"),
        parse_currency(F.concat(F.lit("about "), F.col("Price"), F.lit(" each"))).alias("price"),
        parse_currency(F.concat(F.lit("("), F.col("Item Total"), F.lit(")"))).alias("negative"),
        parse_currency(F.lit(" ")).alias("blank"),
    )
    return values


@query
def parse_date_query(spark, sf):
    raw = A.raw_sold_order_items(spark, sf)
    return raw.select(
        F.col("Transaction ID").cast("bigint").alias("id"),
        parse_date("Sale Date", K.SHORT_DATE).alias("sale_date"),
        parse_date("Date Shipped", K.LONG_DATE).alias("ship_date"),
        parse_date("Date Shipped", K.STATEMENT_DATE).alias("wrong_format"),
    )


@query
def vnd_to_usd_query(spark, sf):
    amount = A.dec("l_extendedprice")
    return A.table(spark, sf, "lineitem").select(
        A.bank_key().alias("id"),
        vnd_to_usd(amount, A.statement_currency()).alias("usd"),
        vnd_to_usd(amount, A.statement_currency(), 100).alias("usd_from_hundredths"),
    )


@query
def clean_statement_currency_query(spark, sf):
    raw = A.raw_statement(spark, sf)
    text = clean_statement_currency(F.nullif("Net", F.lit("--")))
    return raw.select(text.alias("net")).groupBy("net").agg(F.count("*").alias("line_count"))


@query
def extract_id_from_info_query(spark, sf):
    rows = A.table(spark, sf, "lineitem").select(A.bank_key().alias("id"), extract_id_from_info(A.line_info()).alias("x"))
    return rows.select("id", "x.*")


@query
def categorize_types(spark, sf):
    kind = F.when(F.col("event_type") == "view", None).otherwise(
        F.concat(F.element_at(F.array(*[F.lit(w) for w in TYPE_WORDS]), (F.col("user_id") % len(TYPE_WORDS) + 1).cast("int")), F.lit(" "), F.col("event_type"))
    )
    return A.table(spark, sf, "events").select(
        "event_id", categorize_revenue_type(kind).alias("revenue_type"), categorize_fee_type(kind).alias("fee_type")
    )


# type words that reach every branch of both cascades
TYPE_WORDS = ("Sale", "Payout", "Return of order", "Returned", "Service charge", "Tax", "Listing fee", "payment", "Advertising", "regulatory", "Other")


@query
def clean_statement(spark, sf):
    return C.clean_statement(A.raw_statement(spark, sf))


@query
def clean_sold_orders(spark, sf):
    return C.clean_sold_orders(A.raw_sold_orders(spark, sf))


@query
def clean_sold_order_items(spark, sf):
    return C.clean_sold_order_items(A.raw_sold_order_items(spark, sf)).select(
        "transaction_id",
        "sale_date",
        "date_paid",
        "date_shipped",
        "item_name",
        "quantity",
        "price",
        "item_total",
        "listing_id",
        "payment_type",
        "ship_state",
        "size",
        "style",
        "color",
        "material",
        "personalization",
    )


@query
def extract_variations(spark, sf):
    raw = A.raw_sold_order_items(spark, sf)
    text = F.concat("Variations", F.lit(";Style:a:b, MATERIAL : "), F.col("SKU"), F.lit(",size:"), F.col("Quantity"))
    rows = raw.select(F.col("Transaction ID").cast("bigint").alias("id"), listing_text.extract_variations(text).alias("v"))
    return rows.select("id", "v.*")


@query
def clean_direct_checkout(spark, sf):
    return C.clean_direct_checkout(A.raw_direct_checkout(spark, sf))


@query
def clean_deposits(spark, sf):
    return C.clean_deposits(A.raw_deposits(spark, sf))


@query
def clean_listing(spark, sf):
    return C.clean_listing(A.raw_listing(spark, sf))


@query
def clean_description(spark, sf):
    """Over whole documents: trimmed, non-blank lines without boilerplate."""
    docs = A.table(spark, sf, "documents")
    text = F.concat(F.lit("If you need any else, ask\n "), F.col("text"), F.lit("\n\n Made In Viet Nam"))
    return docs.select("doc_id", F.md5(listing_text.clean_description(text).cast("binary")).alias("digest"))


@query
def parse_listing_description(spark, sf):
    raw = A.raw_listing(spark, sf)
    text = listing_text.clean_description("DESCRIPTION")
    rows = raw.select("SKU", text.alias("text")).select("SKU", listing_text.parse_listing_description("text").alias("s"))
    return rows.select(F.col("SKU").alias("sku"), "s.*")


BANK_COLUMNS = (
    "transaction_date",
    "reference_number",
    "account_number",
    "account_name",
    "opening_date",
    "credit_amount",
    "debit_amount",
    "balance_after_transaction",
    "transaction_description",
    "pl_account_number",
    "parsed_product_line_id",
    "parsed_product_id",
    "parsed_variant_id",
    "is_business_related",
)


@query
def clean_bank_transactions(spark, sf):
    return C.clean_bank_transactions(A.raw_bank(spark, sf)).select(*BANK_COLUMNS)


@query
def rejected_bank_rows(spark, sf):
    return C.rejected_bank_rows(A.raw_bank(spark, sf)).select("reference_number", "balance_after_transaction", "message")


@query
def rejected_amounts(spark, sf):
    """Reasons of rejected bank rows where every fifth supplier states amounts beyond the type; accepted rows beside them."""
    raw, credit = A.raw_bank(spark, sf), A.BANK_RAW_HEADERS[5]
    large = F.col(f"`{A.BANK_RAW_HEADERS[2]}`").rlike("[38] *$")
    raw = raw.withColumn(credit, F.when(large, "99,999,999,999,999.5").otherwise(F.col(f"`{credit}`")))
    accepted, rejected = C.split_bank_rows(raw)
    count = F.count("*").alias("row_count")
    return rejected.groupBy("message").agg(count).union(accepted.agg(F.lit("accepted").alias("message"), count))


@query
def bank_parse_stats(spark, sf):
    raw = A.raw_bank(spark, sf).withColumn(
        A.BANK_RAW_HEADERS[8],
        F.when(F.col(f"`{A.BANK_RAW_HEADERS[8]}`").contains("_01 "), "rent").otherwise(F.col(f"`{A.BANK_RAW_HEADERS[8]}`")),
    )
    return C.bank_parse_stats(C.clean_bank_transactions(raw))


@query
def parse_bank_description(spark, sf):
    rows = A.table(spark, sf, "lineitem").join(A.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.select(A.bank_key().alias("id"), bank_text.parse_bank_description(A.bank_description()).alias("x"))
    return rows.select("id", "x.*")


@query
def simple_token_ids(spark, sf):
    """Ids with dashes fail the main pattern and are read from the first word."""
    text = F.concat(F.lit(" a-"), F.lower("p_type"), F.lit("_b-"), F.col("p_partkey").cast("string"), F.lit("_c- 6221"))
    parsed = bank_text.parse_bank_description(text, first_token_fallback=True)
    return A.table(spark, sf, "part").select("p_partkey", parsed.alias("x")).select("p_partkey", "x.*")


@query
def clean_product_catalog(spark, sf):
    return C.clean_product_catalog(A.raw_catalog(spark, sf))


@query
def parse_list_query(spark, sf):
    rows = A.raw_listing(spark, sf)
    return rows.select(F.col("SKU").alias("sku"), parse_list("TAGS").alias("tags"), parse_list("MATERIALS").alias("materials"))


@query
def sku_to_list_query(spark, sf):
    text = F.when(F.col("p_size") > 25, F.concat(F.lit('["A","'), F.col("p_type"), F.lit('"]'))).when(
        F.col("p_size") > 10, F.concat(F.col("p_type"), F.lit(",B"))
    ).otherwise("")
    return A.table(spark, sf, "part").select("p_partkey", sku_to_list(text).alias("skus"))


@query
def null_strings_query(spark, sf):
    """Text spellings of null, and text keys and prices to numbers."""
    raw = A.table(spark, sf, "supplier").select(
        F.concat(F.col("s_suppkey").cast("string"), F.lit(".0")).alias("supplier_key"),
        F.when(F.col("s_nationkey") < 5, "None").when(F.col("s_nationkey") < 10, "NaN").otherwise(F.col("s_name")).alias("name"),
        F.when(F.col("s_nationkey") < 15, "n.a.").otherwise(A.dec("s_acctbal").cast("string")).alias("price"),
    )
    return coerce_star_types(raw)


@query
def clean_all(spark, sf):
    """Row and column counts of every cleaned dataset."""
    cleaned = C.clean_all(A.raw_all(spark, sf))
    parts = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(k).alias("dataset"), "row_count", F.lit(len(df.columns)).alias("column_count"))
        for k, df in cleaned.items()
    ]
    return files.concat_tables(parts)


# ---- dimensions ---------------------------------------------------------------------------------------------------


@query
def dim_time(spark, sf):
    """Calendar rows of all days on which something was ordered or shipped."""
    days = A.table(spark, sf, "orders").select(A.day("o_orderdate").alias("day")).union(
        A.table(spark, sf, "lineitem").select(A.day("l_shipdate").alias("day"))
    )
    columns = D.calendar_columns(F.col("day"), F.lit(dt.date(1998, 6, 17)))
    return days.distinct().select(*[c.alias(n) for n, c in columns.items()])


@query
def seasons(spark, sf):
    month = F.month("o_orderdate")
    return A.table(spark, sf, "orders").groupBy(month.alias("month")).agg(F.count("*").alias("orders")).select(
        "month",
        "orders",
        retail_season("month").alias("retail_season"),
        selling_season("month").alias("selling_season"),
        is_peak_season("month").alias("is_peak_season"),
    )


@query
def country_lookup(spark, sf):
    rows = A.table(spark, sf, "customer").join(A.nations(spark, sf), F.col("c_nationkey") == F.col("n_nationkey"))
    counted = rows.groupBy(A.country().alias("country")).agg(F.count("*").alias("customers"))
    return counted.withColumns(country_columns("country"))


def _clean(spark, sf, *names):
    raw = {
        "statement": A.raw_statement,
        "direct_checkout": A.raw_direct_checkout,
        "listing": A.raw_listing,
        "sold_order_items": A.raw_sold_order_items,
        "sold_orders": A.raw_sold_orders,
        "deposits": A.raw_deposits,
        "bank_transactions": A.raw_bank,
        "product_catalog": A.raw_catalog,
    }
    return {n: C.CLEANERS[n](raw[n](spark, sf)) for n in names}


def _stored(spark, sf, *names):
    """Cleaned tables written once, as in the pipeline: several dimensions and facts read them."""
    return {n: through_table(df, n) for n, df in _clean(spark, sf, *names).items()}


def _dims(cleaned, *names):
    """Dimensions built from cleaned tables, written once."""
    orders, checkout = cleaned.get("sold_orders"), cleaned.get("direct_checkout")
    makers = {
        "dim_product": lambda: D.build_dim_product(cleaned["listing"], cleaned["sold_order_items"]),
        "dim_customer": lambda: D.build_dim_customer(orders, checkout),
        "dim_order": lambda: D.build_dim_order(orders, checkout),
        "dim_geography": lambda: D.build_dim_geography(orders),
        "dim_payment": lambda: D.build_dim_payment(cleaned),
    }
    return {n: through_table(makers[n](), n) for n in names}


AUDIT = ("created_date", "updated_date", "created_timestamp", "updated_timestamp", "effective_date", "batch_id")


def _stable(df):
    """Without the load times; the end of validity as text."""
    out = df.drop(*AUDIT)
    return out.withColumn("expiry_date", F.col("expiry_date").cast("string")) if "expiry_date" in out.columns else out


def _dim_geography(spark, sf):
    return D.build_dim_geography(_clean(spark, sf, "sold_orders")["sold_orders"])


def _dim_customer(spark, sf):
    c = _clean(spark, sf, "sold_orders", "direct_checkout")
    return D.build_dim_customer(c["sold_orders"], c["direct_checkout"])


def _dim_order(spark, sf):
    c = _clean(spark, sf, "sold_orders", "direct_checkout")
    return D.build_dim_order(c["sold_orders"], c["direct_checkout"])


def _dim_payment(spark, sf):
    return D.build_dim_payment(_clean(spark, sf, "sold_orders", "direct_checkout"))


def _dim_product(spark, sf):
    c = _clean(spark, sf, "listing", "sold_order_items")
    return D.build_dim_product(c["listing"], c["sold_order_items"])


def _dim_bank_account(spark, sf):
    return D.build_dim_bank_account(D.derive_bank_accounts(_clean(spark, sf, "bank_transactions")["bank_transactions"]))


def _dim_product_catalog(spark, sf):
    return D.build_dim_product_catalog(_clean(spark, sf, "product_catalog")["product_catalog"])


@query
def dim_geography(spark, sf):
    return _stable(_dim_geography(spark, sf))


@query
def dim_customer(spark, sf):
    return _stable(_dim_customer(spark, sf))


@query
def dim_order(spark, sf):
    return _stable(_dim_order(spark, sf))


@query
def dim_payment(spark, sf):
    return _stable(_dim_payment(spark, sf))


@query
def dim_product(spark, sf):
    return _stable(_dim_product(spark, sf)).drop("category", "subcategory", "product_type")


@query
def dim_bank_account(spark, sf):
    return _stable(_dim_bank_account(spark, sf))


@query
def derive_bank_accounts(spark, sf):
    return D.derive_bank_accounts(_clean(spark, sf, "bank_transactions")["bank_transactions"])


@query
def dim_product_catalog(spark, sf):
    return _stable(_dim_product_catalog(spark, sf))


@query
def surrogate_keys(spark, sf):
    return assign_keys(A.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", "order_key")


@query
def scd_columns(spark, sf):
    rows = A.table(spark, sf, "customer").select("c_custkey").withColumns(D.scd_columns())
    open_rows = F.col("effective_date") <= F.current_timestamp()
    return rows.select("c_custkey", F.col("expiry_date").cast("string").alias("expiry_date"), "is_current", open_rows.alias("in_effect"))


# ---- facts --------------------------------------------------------------------------------------------------------


@query
def fact_sales(spark, sf):
    c = _stored(spark, sf, "sold_order_items", "direct_checkout", "sold_orders", "listing")
    dims = _dims(c, "dim_product", "dim_customer", "dim_order", "dim_geography", "dim_payment")
    return _stable(FB.build_fact_sales(c["sold_order_items"], c["direct_checkout"], dims))


@query
def fact_financial(spark, sf):
    c = _stored(spark, sf, "statement", "sold_order_items", "direct_checkout", "sold_orders", "listing")
    dims = _dims(c, "dim_product", "dim_customer", "dim_order")
    return _stable(FB.build_fact_financial(c["statement"], c["direct_checkout"], c["sold_order_items"], dims))


@query
def fact_deposits(spark, sf):
    return _stable(FB.build_fact_deposits(_clean(spark, sf, "deposits")["deposits"]))


@query
def fact_payments(spark, sf):
    c = _stored(spark, sf, "direct_checkout", "sold_orders")
    dims = _dims(c, "dim_customer", "dim_order", "dim_payment")
    out = _stable(FB.build_fact_payments(c["direct_checkout"], dims))
    return out.withColumn("order_date", F.to_date("order_date")).select(
        "payment_id",
        "order_id",
        "payment_date_key",
        "order_key",
        "customer_key",
        "payment_method_key",
        "gross_amount",
        "fees",
        "net_amount",
        "posted_gross",
        "adjusted_net",
        "vat_amount",
        "currency",
        "listing_currency",
        "exchange_rate",
        "order_date",
        "buyer",
        "status",
        "payment_type",
        "data_source",
    )


def _fact_bank(spark, sf):
    c = _stored(spark, sf, "bank_transactions", "product_catalog")
    accounts = through_table(D.build_dim_bank_account(D.derive_bank_accounts(c["bank_transactions"])), "dim_bank_account")
    catalog = through_table(D.build_dim_product_catalog(c["product_catalog"]), "dim_product_catalog")
    return FB.build_fact_bank(c["bank_transactions"], accounts, catalog)


@query
def fact_bank(spark, sf):
    return _stable(_fact_bank(spark, sf))


@query
def bank_match_stats(spark, sf):
    return FB.bank_match_stats(_fact_bank(spark, sf))


@query
def build_star(spark, sf):
    """Row counts of all star tables built from all raw files."""
    from ..plans.star import build_star as build

    cleaned = {k: through_table(df, k) for k, df in C.clean_all(A.raw_all(spark, sf)).items()}
    star = build(spark, cleaned, *A.CALENDAR, store=lambda name, df: through_table(df, name))
    counts = [df.agg(F.count("*").alias("row_count")).select(F.lit(k).alias("star_table"), "row_count") for k, df in star.items()]
    return files.concat_tables(counts)


# ---- sources, sinks, merges, deletes ------------------------------------------------------------------------------


def _order_text(spark, sf):
    return A.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("Order ID"),
        A.day("o_orderdate").cast("string").alias("Sale Date"),
        A.dec("o_totalprice").cast("string").alias("Order Value"),
        F.concat(F.lit('say "'), F.col("o_orderpriority"), F.lit('",\nnext line')).alias("Note"),
    )


@query
def scan_csv(spark, sf):
    path = scratch_path(spark, "orders-csv")
    sinks.export_csv(_order_text(spark, sf), path)
    return files.scan_csv(spark, path)


def _write_periods(spark, sf):
    """Raw orders and deposits as files of two periods; the second period holds extra columns."""
    root = scratch_path(spark, "raw")
    orders, deposits = _order_text(spark, sf), A.raw_deposits(spark, sf)
    sinks.export_csv(orders, f"{root}/2025-01/EtsySoldOrders2025-1.csv")
    sinks.export_csv(orders.drop("Note").withColumn("Extra", F.lit("x")), f"{root}/2025-02/EtsySoldOrders2025-2.csv")
    sinks.export_csv(deposits, f"{root}/2025-01/EtsyDeposits2025-1.csv")
    return root


@query
def load_period(spark, sf):
    loaded = files.load_period(spark, _write_periods(spark, sf), "2025-01")
    counts = [df.agg(F.count("*").alias("row_count")).select(F.lit(k).alias("dataset"), "row_count") for k, df in loaded.items()]
    return files.concat_tables(counts)


@query
def load_dataset(spark, sf):
    return files.load_dataset(spark, _write_periods(spark, sf), "2025-01", "deposits")


@query
def concat_tables(spark, sf):
    root = _write_periods(spark, sf)
    return files.concat_tables([files.load_dataset(spark, root, p, "sold_orders") for p in ("2025-01", "2025-02")])


@query
def header_row_detection(spark, sf):
    """One bank export per ship month: two preamble rows, the header row, then the data."""
    raw = A.raw_bank(spark, sf)
    month = F.substring(F.col(f"`{A.BANK_RAW_HEADERS[0]}`"), 4, 7)
    cells = [F.concat(F.lit('"'), F.coalesce(F.col(f"`{h}`"), F.lit("")), F.lit('"')) for h in A.BANK_RAW_HEADERS]
    data = raw.select(F.replace(month, F.lit("/"), F.lit("-")).alias("file"), F.lit(3).alias("at"), F.concat_ws(",", *cells).alias("line"))
    top = ["Saving Bank,Branch 7", "Statement", ",".join(f'"{h}"' for h in A.BANK_RAW_HEADERS)]
    heads = data.select("file").distinct().select(
        "file", F.posexplode(F.array(*[F.lit(t) for t in top])).alias("at", "line")
    )
    path = scratch_path(spark, "bank-export")
    lines = data.unionByName(heads).repartition("file").sortWithinPartitions("file", "at")
    with shuffles_dropped(spark):
        lines.select("file", "line").write.partitionBy("file").text(path, compression="gzip")
    read = bank_export.read_bank_export(spark, f"{path}/file=*")
    delete_path(spark, path)  # the records are stored, nothing reads the files again
    return C.clean_bank_transactions(read).select(*BANK_COLUMNS)


@query
def bank_export_layouts(spark, sf):
    """Exports in two layouts, one of 70 columns, with a preamble and quoted line breaks: each file under its own header."""
    wide = ["Amount", *[f"X{i}" for i in range(1, 68)], "Description", "Ref"]
    text = F.concat(F.lit('say ""'), F.col("o_orderpriority"), F.lit('"",\nline two'))
    cells = {"Ref": F.col("o_orderkey").cast("string"), "Description": text, "Amount": A.dec("o_totalprice").cast("string"), "X67": F.concat(F.lit("x"), F.col("o_orderkey").cast("string"))}

    def line(names):
        return F.concat_ws(",", *[F.concat(F.lit('"'), cells[n], F.lit('"')) if n in cells else F.lit("") for n in names])

    narrow = ["Ref", "Description", "Amount"]
    orders = A.table(spark, sf, "orders")
    open_orders = F.col("o_orderstatus") == "O"
    data = orders.select(F.col("o_orderstatus").alias("file"), F.lit(2).alias("at"), F.when(open_orders, line(wide)).otherwise(line(narrow)).alias("line"))
    tops = F.when(F.col("file") == "O", F.array(F.lit("Bank,Branch"), F.lit(",".join(wide)))).otherwise(F.array(F.lit('"Bank, main\noffice"'), F.lit(",".join(narrow))))
    heads = data.select("file").distinct().select("file", F.posexplode(tops).alias("at", "line"))
    path = scratch_path(spark, "bank-layouts")
    data.unionByName(heads).repartition("file").sortWithinPartitions("file", "at").select("file", "line").write.partitionBy("file").text(path)
    read = bank_export.read_bank_export(spark, f"{path}/file=*")
    return read.select(F.col("Ref").cast("bigint").alias("ref"), F.col("Description").alias("description"), F.col("Amount").cast("decimal(15,2)").alias("amount"), F.col("X67").alias("filler"))


@query
def first_rows(spark, sf):
    """Of rows that repeat a key the first in the file counts, here never the smallest: products, catalog, bank accounts."""
    root, twice = scratch_path(spark, "first-rows"), F.explode(F.array(F.lit("zz"), F.lit("aa")))

    def export(rows, key, name):
        # both rows of a key lie in one part file, in this order
        marked = rows.withColumn("__n", F.monotonically_increasing_id()).repartition(4, key).sortWithinPartitions(key, "__n")
        sinks.export_csv(marked.drop("__n"), f"{root}/2025-01/{name}")

    part = A.table(spark, sf, "part").select("*", twice.alias("mark"))
    name, product = F.concat("mark", F.lit(" "), "p_name"), F.concat(F.lit("MG"), F.col("p_partkey").cast("string"))
    export(part.select(F.col("p_partkey").alias("Listing ID"), name.alias("Item Name"), F.lit("1.00").alias("Price")), "Listing ID", "EtsySoldOrderItems2025-1.csv")
    catalog = {"Product line ID": F.lit("L"), "Product line": F.col("mark"), "Product ID": product, "Product": name, "Variant ID": F.lit("01"), "Variants": F.col("mark")}
    export(part.select(*[c.alias(n) for n, c in catalog.items()]), "Product ID", "product_catalog.csv")
    supplier = A.table(spark, sf, "supplier").select("*", twice.alias("mark"))
    number = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))
    bank = {"Account Number": number, "Account Name": F.concat("mark", F.lit(" "), "s_name"), "Description": F.lit("x"), "Transaction Date": F.lit("01/02/2025")}
    export(supplier.select(*[c.alias(n) for n, c in bank.items()]), "Account Number", "fact_bank_transactions.csv")
    raw = files.load_period(spark, root, "2025-01", positions=True)
    clean = {k: through_table(df, f"clean-{k}") for k, df in C.clean_all(raw).items()}
    accounts = clean["bank_transactions"].select("account_number", "account_name", "opening_date", "_input")
    stored = D.build_dim_bank_account(accounts.withColumn("account_name", F.lit("old")))
    found = [
        ("product", D.build_dim_product(None, clean["sold_order_items"]), F.col("listing_id").cast("string"), "title"),
        ("catalog", D.build_dim_product_catalog(clean["product_catalog"]), F.col("product_id"), "product_name"),
        ("account", D.derive_bank_accounts(clean["bank_transactions"]), F.col("account_number"), "account_name"),
        ("feed", M.upsert_bank_accounts(stored, accounts), F.col("account_number"), "account_name"),
    ]
    return reduce(lambda a, b: a.union(b), [df.select(F.lit(kind).alias("kind"), key.alias("id"), F.col(label).alias("name")) for kind, df, key, label in found])


@query
def ingest_stream(spark, sf):
    """A file stream run twice: the second run reads only the file that came in between."""
    root, target, marks = (scratch_path(spark, n) for n in ("stream-raw", "stream-out", "stream-checkpoint"))
    orders = _order_text(spark, sf)
    columns = orders.columns

    def shape(df):
        return df.select(
            F.col("Order ID").cast("bigint").alias("order_id"),
            F.col("Sale Date").cast("date").alias("sale_date"),
            F.col("Order Value").cast("decimal(15,2)").alias("order_value"),
            "period",
        )

    for period in ("2025-01", "2025-02"):
        sinks.export_csv(orders, f"{root}/{period}/EtsySoldOrders{period}.csv")
        ingest.ingest_files(spark, root, "sold_orders", columns, target, marks, shape)
    return spark.read.parquet(target).drop("batch")


@query
def changed_files(spark, sf):
    """Per period: do its files differ from the log of the last load? The log misses the second period."""
    root = _write_periods(spark, sf)
    listing = files.list_files(spark, root)
    log = listing.filter(F.col("period") == "2025-01")
    return ingest.changed_files(listing, log).select("period", "name")


@query
def append_fact(spark, sf):
    path = scratch_path(spark, "fact-sales")
    sinks.append_fact(A.sales(spark, sf), path, "fact_sales")
    sinks.append_fact(A.sales(spark, sf), path, "fact_sales")
    stored = spark.read.parquet(path)
    return stored.groupBy("year", "month").agg(F.count("*").alias("row_count"), F.sum("item_total").alias("item_total"))


@query
def reload_period(spark, sf):
    """Loading the same period twice leaves one copy."""
    path = scratch_path(spark, "fact-payments")
    for _ in range(2):
        sinks.write_fact_period(A.payments(spark, sf), path, "fact_payments", "2025-01")
    stored = spark.read.parquet(path)
    return stored.groupBy("period", "year", "month").agg(F.count("*").alias("row_count"), F.sum("net_amount").alias("net_amount"))


@query
def parquet_sink(spark, sf):
    path = scratch_path(spark, "catalog")
    sinks.write_table(A.dim_product_catalog(spark, sf), path)
    return spark.read.parquet(path)


@query
def export_csv(spark, sf):
    path = scratch_path(spark, "catalog-csv")
    rows = A.dim_product_catalog(spark, sf).withColumn("remark", F.concat(F.lit('a "b", '), F.col("product_code")))
    sinks.export_csv(rows.select("product_catalog_key", "product_code", "remark"), path)
    return files.scan_csv(spark, path).withColumn("product_catalog_key", F.col("product_catalog_key").cast("bigint"))


def _customer_rows(spark, sf):
    rows = A.table(spark, sf, "customer").select(F.col("c_name").alias("buyer_user_name"), F.col("c_mktsegment").alias("city"), "c_acctbal")
    return rows


def _stored_and_incoming(spark, sf):
    """Stored: customers with a positive balance. Incoming: all customers twice, with builder keys of their own."""
    rows = _customer_rows(spark, sf)
    stored = assign_keys(rows.filter("c_acctbal > 0").drop("c_acctbal"), "buyer_user_name", "customer_key")
    incoming = assign_keys(rows.drop("c_acctbal"), "buyer_user_name", "customer_key")
    again = incoming.withColumn("city", F.lit("ZZZ"))
    return stored, incoming, incoming.union(again)


@query
def upsert_dimension(spark, sf):
    stored, _, twice = _stored_and_incoming(spark, sf)
    return M.upsert_dimension(stored, twice, "buyer_user_name", "customer_key", ["city"])


@query
def remap_keys(spark, sf):
    stored, incoming, twice = _stored_and_incoming(spark, sf)
    merged = M.upsert_dimension(stored, twice, "buyer_user_name", "customer_key", ["city"])
    mapping = M.key_mapping(incoming, merged, "buyer_user_name", "customer_key")
    names = A.table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("buyer_user_name"))
    fact = A.table(spark, sf, "orders").join(names, F.col("o_custkey") == F.col("c_custkey"))
    fact = fact.join(incoming.select("buyer_user_name", "customer_key"), "buyer_user_name").select("o_orderkey", "customer_key")
    return M.remap_keys(fact, "customer_key", mapping)


@query
def versioned_customers(spark, sf):
    """Two loads of customers; a third of the segments change in between, a tenth of the customers come later. Each order
    finds the segment of its day. Loading the second state twice changes nothing."""
    rows = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("segment"))
    before = rows.filter("o_custkey % 10 <> 0")
    after = rows.withColumn("segment", F.when(F.col("o_custkey") % 3 == 0, F.lit("MOVED")).otherwise(F.col("segment")))
    names = ("o_custkey", "version_key", ["segment"])
    versions = through_table(V.first_versions(before, *names), "versions")
    for _ in range(2):
        versions = through_table(V.merge_versions(versions, after, *names, "1997-06-01"), "versions")
    orders = A.table(spark, sf, "orders").select("o_orderkey", "o_custkey", A.day("o_orderdate").alias("order_date"))
    found = V.version_of(orders, versions, "o_custkey", "order_date", ["version_key", "segment", "is_current"])
    counted = versions.groupBy("o_custkey").agg(F.count("*").alias("versions"))
    return found.join(counted, "o_custkey").select("o_orderkey", "segment", "is_current", "versions")


def _days(spark, sf, name, column):
    days = A.table(spark, sf, name).select(A.day(column).alias("day")).distinct()
    columns = D.calendar_columns(F.col("day"), F.lit(dt.date(1998, 6, 17)))
    return days.select(*[columns[c].alias(c) for c in ("time_key", "full_date", "year", "month", "day_name")])


@query
def upsert_dim_time(spark, sf):
    return M.upsert_dim_time(_days(spark, sf, "orders", "o_orderdate"), _days(spark, sf, "lineitem", "l_shipdate"))


@query
def ensure_dates(spark, sf):
    return M.ensure_dates(_days(spark, sf, "orders", "o_orderdate"), A.bank(spark, sf))


@query
def upsert_dim_geography(spark, sf):
    """Stored: places of the BUILDING segment; incoming: all places."""
    orders = _clean(spark, sf, "sold_orders")["sold_orders"]
    stored = D.build_dim_geography(orders.filter(F.col("ship_city") == "BUILDING"))
    merged = M.upsert_dimension(stored, D.build_dim_geography(orders), "location_hash", "geography_key")
    return merged.select("geography_key", "location_hash", "country_name", "state_name", "city_name")


def _account_feed(spark, sf):
    """Stored: accounts of suppliers with a positive balance. Incoming: all, renamed, some with an opening date."""
    rows = A.table(spark, sf, "supplier")
    stored = A.accounts(spark, sf).join(rows.filter("s_acctbal > 0").select(F.col("s_suppkey").alias("bank_account_key")), "bank_account_key", "left_semi")
    stored = stored.withColumn("opening_date", F.lit(dt.date(2000, 1, 1)))
    incoming = rows.select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("account_number"),
        F.when(F.col("s_nationkey") > 4, F.concat(F.lit("New "), F.col("s_name"))).alias("account_name"),
        F.when(F.col("s_nationkey") > 12, F.lit(dt.date(2021, 5, 6))).alias("opening_date"),
    )
    return stored, incoming


def _account_columns(df):
    return df.select("bank_account_key", "account_number", "account_name", "opening_date", "currency_code")


@query
def upsert_bank_accounts(spark, sf):
    return _account_columns(M.upsert_bank_accounts(*_account_feed(spark, sf)))


@query
def ensure_bank_accounts(spark, sf):
    return _account_columns(M.ensure_bank_accounts(*_account_feed(spark, sf)))


def _catalog_feed(spark, sf):
    """Stored: catalog variants 01. Incoming: the raw catalog file, cleaned."""
    stored = A.dim_product_catalog(spark, sf).filter("variant_id = '01'").withColumns(D.audit_columns())
    return stored, C.clean_product_catalog(A.raw_catalog(spark, sf))


def _catalog_columns(df):
    return df.select("product_catalog_key", "product_code", "product_line_name", "product_name", "variant_name")


@query
def insert_catalog(spark, sf):
    return _catalog_columns(M.insert_catalog(*_catalog_feed(spark, sf)))


@query
def insert_catalog_counts(spark, sf):
    return M.insert_catalog_counts(*_catalog_feed(spark, sf))


@query
def upsert_catalog(spark, sf):
    return _catalog_columns(M.upsert_catalog(*_catalog_feed(spark, sf)))


@query
def duplicate_keys(spark, sf):
    return validate.duplicate_keys(A.raw_catalog(spark, sf))


@query
def delete_bank_period(spark, sf):
    kept = X.delete_bank_period(A.bank(spark, sf), A.dim_time(spark), "1997-05")
    month = F.floor(F.col("transaction_date_key") / 100)
    return kept.groupBy(month.alias("month_key")).agg(F.count("*").alias("row_count"))


@query
def delete_bank_by_accounts(spark, sf):
    kept = X.delete_bank_by_accounts(A.bank(spark, sf), A.dim_time(spark), "1996-01-01", "1998-12-31", ["6221", "6411"], "S7")
    return kept.groupBy("account_number", "pl_account_number").agg(F.count("*").alias("row_count"), F.sum("debit_amount").alias("debit"))


@query
def rewrite_months(spark, sf):
    """The stored bank fact after deleting account 6221 from the months of 1997."""
    path = scratch_path(spark, "fact-bank")
    sinks.append_fact(A.bank(spark, sf).drop("bank_transaction_key"), path, "fact_bank_transactions")
    doomed = F.coalesce(F.col("pl_account_number") == "6221", F.lit(False))
    sinks.rewrite_months(spark, path, "1997-01", "1997-12", lambda rows: rows.filter(~doomed))
    stored = spark.read.parquet(path)
    return stored.groupBy("year", "pl_account_number").agg(F.count("*").alias("row_count"))


@query
def delete_by_ids(spark, sf):
    """Bank rows left after deleting those listed in a table of keys (all credits)."""
    rows = A.bank(spark, sf)
    credits = rows.filter(F.col("credit_amount").isNotNull()).select("bank_transaction_key")
    return X.delete_by_ids(rows, "bank_transaction_key", credits).select("bank_transaction_key", "debit_amount")


def queries():
    return {name.removesuffix("_query"): fn for name, fn in QUERIES.items()}


__all__ = ["queries", "comparable"]
