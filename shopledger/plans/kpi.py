"""Shop key figures over fact_sales, fact_payments and fact_financial_transactions.

Common arguments: inclusive ``start``/``end`` dates, ``customer_type`` ('all', 'new', 'return'; judged over all time) and
the display ``currency``. Revenue is item total minus discount. Rows whose date is not in dim_time do not count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import HOME_COUNTRY
from ..functions.dates import date_key, month_label
from ..functions.money import in_currency, ratio
from ..operators.filters import customer_classes, customer_filter, date_filter, month_bounds, order_class, valid_date
from ..session import through_table

CENTS = "decimal(20,2)"


def net_revenue() -> Column:
    zero = F.lit(0).cast("decimal(15,2)")
    return F.coalesce("item_total", zero) - F.coalesce("discount_amount", zero)


def revenue_sum() -> Column:
    return F.sum(net_revenue()).cast(CENTS)


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast(CENTS))


def sales_rows(sales, dim_time, start, end, customer_type, attributes=()) -> DataFrame:
    """Sales in the range of the chosen customers, with calendar attributes."""
    return customer_filter(date_filter(sales, dim_time, "sale_date_key", start, end, attributes), sales, customer_type)


def total_revenue(sales, dim_time, start=None, end=None, customer_type="all", currency="USD") -> DataFrame:
    rows = sales_rows(sales, dim_time, start, end, customer_type)
    return rows.agg(in_currency(_or_zero(revenue_sum()), currency).alias("total_revenue"))


def total_orders(sales, dim_time, start=None, end=None, customer_type="all") -> DataFrame:
    rows = sales_rows(sales, dim_time, start, end, customer_type)
    return rows.agg(F.count_distinct("order_key").alias("total_orders"))


def total_customers(sales, dim_time, start=None, end=None, customer_type="all") -> DataFrame:
    rows = sales_rows(sales, dim_time, start, end, customer_type)
    return rows.agg(F.count_distinct("customer_key").alias("total_customers"))


#: log2 of the registers of a count sketch: 4,096 of them, a standard error of about 1.6 percent.
SKETCH_BITS = 12


def daily_sketches(sales, dim_time) -> DataFrame:
    """(full_date, customer_class, orders, customers): HyperLogLog sketches per day and class, judged over all time.

    A few kilobytes a row. Stored once, they answer any range and class by union, without reading the fact again.
    """
    known = date_filter(sales, dim_time, "sale_date_key", attributes=["full_date"])
    classed = known.join(customer_classes(sales), "customer_key", "left")
    return classed.groupBy("full_date", "customer_class").agg(
        F.hll_sketch_agg("order_key", SKETCH_BITS).alias("orders"), F.hll_sketch_agg("customer_key", SKETCH_BITS).alias("customers")
    )


def approximate_counts(sketches, start=None, end=None, customer_type="all") -> DataFrame:
    """(total_orders, total_customers) of a range from its daily sketches: estimates, opt-in beside the exact counts."""
    rows = sketches
    for bound, above in ((valid_date(start), True), (valid_date(end), False)):
        if bound is not None:
            day = F.lit(bound).cast("date")
            rows = rows.filter(F.col("full_date") >= day if above else F.col("full_date") <= day)
    if customer_type in ("new", "return"):
        rows = rows.filter(F.col("customer_class") == customer_type)
    estimate = lambda c: F.coalesce(F.hll_sketch_estimate(F.hll_union_agg(c)), F.lit(0))
    return rows.agg(estimate("orders").alias("total_orders"), estimate("customers").alias("total_customers"))


def average_order_value(sales, dim_time, start=None, end=None, customer_type="all", currency="USD") -> DataFrame:
    rows = sales_rows(sales, dim_time, start, end, customer_type)
    aov = ratio(revenue_sum(), F.count_distinct("order_key"))
    return rows.agg(in_currency(aov, currency).alias("average_order_value"))


def aov_over_time(sales, dim_time, start=None, end=None, customer_type="all", currency="USD") -> DataFrame:
    rows = sales_rows(sales, dim_time, start, end, customer_type, ["full_date"])
    aov = ratio(revenue_sum(), F.count_distinct("order_key"))
    daily = rows.groupBy("full_date").agg(in_currency(aov, currency).alias("average_order_value"))
    return daily.orderBy("full_date")


def _by_month(rows: DataFrame, *aggregates: Column) -> DataFrame:
    monthly = rows.groupBy("year", "month").agg(*aggregates).orderBy("year", "month")
    values = [c for c in monthly.columns if c not in ("year", "month")]
    return monthly.select(month_label("year", "month").alias("month"), *values)


def revenue_by_month(sales, dim_time, start=None, end=None, customer_type="all", currency="USD") -> DataFrame:
    rows = sales_rows(sales, dim_time, start, end, customer_type, ["year", "month"])
    return _by_month(rows, in_currency(_or_zero(revenue_sum()), currency).alias("revenue"))


def orders_by_month(sales, dim_time, start=None, end=None, customer_type="all") -> DataFrame:
    rows = sales_rows(sales, dim_time, start, end, customer_type, ["year", "month"])
    return _by_month(rows, F.count_distinct("order_key").alias("orders"))


def profit_by_month(payments, dim_time, start=None, end=None, currency="USD") -> DataFrame:
    """Net payments by month; the customer type plays no part."""
    rows = date_filter(payments, dim_time, "payment_date_key", start, end, ["year", "month"])
    return _by_month(rows, in_currency(_or_zero(F.sum("net_amount").cast(CENTS)), currency).alias("profit"))


def _customer_totals(sales, dim_time, start, end, customer_type) -> DataFrame:
    """One row per customer with sales in the range: class over all time and revenue in the range.

    A single pass over the fact and one shuffle on the customer; joining the fact to its own order counts would take both
    sides through a shuffle.
    """
    marked = date_filter(sales.filter(F.col("customer_key").isNotNull()), dim_time, "sale_date_key", start, end, ["full_date"], "left")
    inside = F.col("full_date").isNotNull()
    per = marked.groupBy("customer_key").agg(
        F.min("order_key").alias("lo"),
        F.max("order_key").alias("hi"),
        F.sum(F.when(inside, net_revenue())).cast(CENTS).alias("revenue"),
        F.bool_or(inside).alias("active"),
    )
    per = per.filter("active").withColumn("customer_class", order_class("lo", "hi"))
    return per.filter(F.col("customer_class") == customer_type) if customer_type in ("new", "return") else per


def new_vs_returning_sales(sales, dim_time, start=None, end=None, customer_type="all", currency="USD") -> DataFrame:
    """Revenue of customers with exactly one order against all others."""
    per = _customer_totals(sales, dim_time, start, end, customer_type)
    label = F.when(F.col("customer_class") == "new", "New Customers").otherwise("Returning Customers")
    split = per.groupBy(label.alias("customer_type")).agg(F.sum("revenue").cast(CENTS).alias("revenue"))
    ranked = split.orderBy(F.col("revenue").desc(), "customer_type")
    return ranked.select("customer_type", in_currency(F.col("revenue"), currency).alias("revenue"))


def retention_rate(sales, dim_time, start=None, end=None, customer_type="all") -> DataFrame:
    """Share of the range's customers that ever placed more than one order, in percent."""
    per = _customer_totals(sales, dim_time, start, end, customer_type)
    share = ratio(F.count_if(F.col("customer_class") == "return") * 100, F.count("*"))
    return per.agg(share.alias("retention_rate"))


def new_customers_over_time(sales, dim_time, start=None, end=None, customer_type="all") -> DataFrame:
    """Customers per day: new ones, or returning ones for 'return'; 'all' means 'new'."""
    kind = "return" if customer_type == "return" else "new"
    rows = date_filter(sales, dim_time, "sale_date_key", start, end, ["full_date"])
    pairs = rows.select("customer_key", "full_date").distinct()
    chosen = customer_filter(pairs, sales, kind)
    return chosen.groupBy("full_date").agg(F.count("customer_key").alias("customers")).orderBy("full_date")


def customers_by_location(
    sales, dim_geography, dim_time, start=None, end=None, customer_type="all", currency="USD", top: int = 12
) -> DataFrame:
    """Home-country states with most customers."""
    states = dim_geography.filter(F.col("country_name") == HOME_COUNTRY).select("geography_key", "state_name")
    rows = sales_rows(sales, dim_time, start, end, customer_type).join(states, "geography_key")
    by_state = rows.groupBy("state_name").agg(
        F.count_distinct("customer_key").alias("customers"),
        in_currency(_or_zero(revenue_sum()), currency).alias("revenue"),
    )
    return by_state.orderBy(F.col("customers").desc(), "state_name").limit(top)


def short_title(title: Column) -> Column:
    """Titles above 30 characters are cut to 27 and dots."""
    return F.when(F.length(title) > 30, F.concat(F.left(title, F.lit(27)), F.lit("..."))).otherwise(title)


def sales_by_product(
    sales, dim_product, dim_time, start=None, end=None, customer_type="all", currency="USD", top: int = 10
) -> DataFrame:
    """Best-selling titles. Titles that look the same when shortened count together."""
    rows = sales_rows(sales, dim_time, start, end, customer_type)
    # reduce to one row per product before the join with the dimension
    per_product = rows.groupBy("product_key").agg(revenue_sum().alias("revenue"))
    titles = dim_product.filter("is_current").select("product_key", short_title(F.col("title")).alias("product"))
    by_title = per_product.join(titles, "product_key").groupBy("product").agg(F.sum("revenue").cast(CENTS).alias("revenue"))
    best = by_title.orderBy(F.col("revenue").desc(), "product").limit(top)
    return best.select("product", in_currency(F.col("revenue"), currency).alias("revenue"))


def marketing_fees(financial: DataFrame) -> DataFrame:
    return financial.filter(F.col("transaction_type") == "Marketing")


def _one_row(df: DataFrame) -> DataFrame:
    return df.sparkSession.range(1)


def customer_acquisition_cost(
    sales, financial, dim_time, start="2000-01-01", end="2099-12-31", currency="USD"
) -> DataFrame:
    """Absolute marketing fees per new customer of the range; null without new customers."""
    start, end = start or "2000-01-01", end or "2099-12-31"
    fees = date_filter(marketing_fees(financial), dim_time, "transaction_date_key", start, end)
    fees = fees.agg(F.abs(_or_zero(F.sum("fees_and_taxes").cast(CENTS))))
    customers = sales_rows(sales, dim_time, start, end, "new").agg(F.count_distinct("customer_key"))
    # two one-value subqueries in one row; no join
    cac = ratio(fees.scalar(), customers.scalar())
    return _one_row(sales).select(in_currency(cac, currency).alias("customer_acquisition_cost"))


def _customer_order_totals(rows: DataFrame) -> DataFrame:
    """Item totals per (order, customer): the distinct counts that follow work on these fewer rows."""
    return rows.groupBy("order_key", "customer_key").agg(F.sum("item_total").cast(CENTS).alias("total"))


def customer_lifetime_value(
    sales, dim_time, end=None, customer_type="all", period_days: int = 30, currency="USD"
) -> DataFrame:
    """Order value, orders per customer and their product over the ``period_days`` days before ``end`` and ``end`` itself.

    ``end`` defaults to the last sale date. Totals are before discount.
    """
    if valid_date(end):
        last = F.lit(end).cast("date")
    else:
        known = sales.join(dim_time.select(F.col("time_key").alias("sale_date_key"), "full_date"), "sale_date_key")
        last = known.select(F.max("full_date")).scalar()
    first = F.date_sub(last, period_days)
    rows = sales.filter(F.col("sale_date_key").between(date_key(first), date_key(last)))
    rows = rows.join(dim_time.select(F.col("time_key").alias("sale_date_key")), "sale_date_key")
    totals = _customer_order_totals(customer_filter(rows, sales, customer_type))
    total = _or_zero(F.sum("total").cast(CENTS))
    one = totals.agg(
        total.alias("total"),
        F.count_distinct("order_key").alias("orders"),
        F.count_distinct("customer_key").alias("customers"),
    )
    # order value x frequency = total / customers; null without orders
    value = F.when(F.col("orders") > 0, ratio(F.col("total"), F.col("customers")))
    return one.select(
        in_currency(ratio(F.col("total"), F.col("orders")), currency).alias("average_order_value"),
        ratio(F.col("orders"), F.col("customers")).alias("purchase_frequency"),
        in_currency(value, currency).alias("lifetime_value"),
    )


HORIZONS = (30, 60, 90)


def purchase_days(sales, dim_time) -> DataFrame:
    """One row per customer and day of the fact, from one aggregate over it; written once.

    With the calendar's date (null outside it), the customer's next day with a purchase, the class over all time, and whether
    the row is the customer's first in its month. Rows of no customer are kept for their totals.
    """
    daily = sales.groupBy("sale_date_key", "customer_key").agg(
        F.sum("item_total").cast(CENTS).alias("total"),
        F.max(F.col("order_key").isNotNull()).alias("has_order"),
        F.min("order_key").alias("lo"),
        F.max("order_key").alias("hi"),
    )
    calendar = dim_time.select(F.col("time_key").alias("sale_date_key"), "full_date", "year", "month")
    own = Window.partitionBy("customer_key")
    in_order = own.orderBy("full_date", "sale_date_key")
    label = month_label("year", "month")
    marked = daily.join(calendar, "sale_date_key", "left").select(
        "sale_date_key",
        "customer_key",
        "full_date",
        label.alias("label"),
        "total",
        "has_order",
        F.lead("full_date").over(in_order).alias("next_date"),
        F.min("lo").over(own).alias("lo"),
        F.max("hi").over(own).alias("hi"),
        (~F.lag(label).over(in_order).eqNullSafe(label)).alias("opens_month"),
    )
    kept = ["sale_date_key", "customer_key", "full_date", "label", "total", "has_order", "next_date", "opens_month"]
    return through_table(marked.select(*kept, order_class("lo", "hi").alias("customer_class")), "purchase-days")


def trailing_customers(purchases, ends, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """(last, customers_<h>d, ...): customers with a purchase in the ``h`` days up to each day of ``ends`` (last).

    A customer is counted by the latest purchase: one on day d counts for all ends from d up to the day before the next one,
    d + h - 1 at most. Each purchase adds 1 at d and takes it away behind that day; sums of these steps per day, added up
    along the calendar, are the distinct counts of every window at once. No purchase is listed under the windows it lies in,
    and nothing is counted distinct. The running sum has a row per day.
    """
    names = [f"customers_{h}d" for h in horizons]

    def step(day: Column, values) -> Column:
        return F.struct(day.alias("last"), *[F.lit(v).cast("bigint").alias(n) for v, n in zip(values, names, strict=True)])

    known = purchases.filter(F.col("customer_key").isNotNull() & F.col("full_date").isNotNull())
    behind = [F.least(F.coalesce("next_date", F.date_add("full_date", h)), F.date_add("full_date", h)) for h in horizons]
    steps = [step(F.col("full_date"), [1] * len(names))]
    steps += [step(day, [-(i == k) for i in range(len(names))]) for k, day in enumerate(behind)]
    moved = known.select(F.inline(F.array(*steps)))
    asked = ends.select(F.inline(F.array(step(F.col("last"), [0] * len(names)))))
    per_day = moved.union(asked).groupBy("last").agg(*[F.sum(n).alias(n) for n in names])
    so_far = Window.orderBy("last").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row per day
    return per_day.select("last", *[F.sum(n).over(so_far).alias(n) for n in names]).join(ends.select("last").distinct(), "last")


def cac_ltv_by_month(sales, financial, dim_time, start=None, end=None, currency="USD") -> DataFrame:
    """Per month: acquisition cost, lifetime value over the last 30, 60 and 90 days up to the month end, and their ratios.

    Months are those with sales or statement lines in the range; a month counts as a whole even if the range cuts it, and
    the trailing windows look back before the range. The sales are aggregated once, to (customer, day).
    """
    purchases = purchase_days(sales, dim_time)

    def months_of(fact: DataFrame, key: str) -> DataFrame:
        days = fact.select(key).distinct()
        return date_filter(days, dim_time, key, start, end, ["year", "month"]).select("year", "month")

    months = months_of(purchases, "sale_date_key").union(months_of(financial, "transaction_date_key")).distinct()
    spans = (
        months.join(dim_time.select("full_date", "year", "month"), ["year", "month"])
        .groupBy("year", "month")
        .agg(F.max("full_date").alias("last"))
        .select(month_label("year", "month").alias("label"), "last")
    )
    spans = through_table(spans, "months")  # a row per month, used by each figure

    # totals of the windows: a row per day meets the few windows that hold it
    days = purchases.filter(F.col("full_date").isNotNull()).groupBy("full_date").agg(F.sum("total").cast(CENTS).alias("total"), F.max("has_order").alias("has_order"))
    windows = [F.struct(F.lit(h).alias("horizon"), F.sequence(F.date_sub("last", h - 1), F.col("last")).alias("days")) for h in HORIZONS]
    held = spans.select("label", F.inline(F.array(*windows))).select("label", "horizon", F.explode("days").alias("full_date")).join(days, "full_date")
    totals = held.groupBy("label").agg(
        *[F.sum(F.when(F.col("horizon") == h, F.col("total"))).cast(CENTS).alias(f"total_{h}d") for h in HORIZONS],
        *[F.bool_or(F.when(F.col("horizon") == h, F.col("has_order"))).alias(f"ordered_{h}d") for h in HORIZONS],
    )
    customers = trailing_customers(purchases, spans)

    in_month = dim_time.select(F.col("time_key").alias("transaction_date_key"), month_label("year", "month").alias("label"))
    fees = marketing_fees(financial).groupBy("transaction_date_key").agg(F.sum("fees_and_taxes").cast(CENTS).alias("fees"))
    fees = fees.join(in_month, "transaction_date_key").groupBy("label").agg(F.sum("fees").cast(CENTS).alias("fees"))
    fresh = F.col("opens_month") & (F.col("customer_class") == "new") & F.col("customer_key").isNotNull()
    newcomers = purchases.filter(fresh).groupBy("label").agg(F.count("*").alias("new_customers"))

    out = spans.join(fees, "label", "left").join(newcomers, "label", "left").join(totals, "label", "left").join(customers, "last", "left")
    out = out.withColumn("cac", ratio(F.abs(_or_zero(F.col("fees"))), F.col("new_customers")))
    values = {f"ltv_{h}d": F.when(F.col(f"ordered_{h}d"), ratio(_or_zero(F.col(f"total_{h}d")), F.col(f"customers_{h}d"))) for h in HORIZONS}
    out = out.withColumns(values)
    shown = [in_currency(F.col(c), currency).alias(c) for c in ("cac", *values)]
    ratios = [ratio(F.col(c), F.col("cac")).alias(f"{c}_to_cac") for c in values]
    return out.select(F.col("label").alias("month"), *shown, *ratios).orderBy("month")


def _bounds(month: str) -> tuple[str, str]:
    year, number = month.split("-")
    return month_bounds(int(year), int(number))


def revenue_comparison(sales, dim_time, month1: str, month2: str, currency="USD") -> DataFrame:
    """Daily revenue of two months ``YYYY-MM``, labelled; the same month twice gives its days twice."""
    spans = [_bounds(m) for m in (month1, month2)]
    labels = []
    wanted = F.lit(False)
    for i, (low, high) in enumerate(spans, start=1):
        inside = F.col("sale_date_key").between(int(low.replace("-", "")), int(high.replace("-", "")))
        wanted = wanted | inside
        labels.append(F.when(inside, F.lit(f"Month {i}")))
    rows = date_filter(sales.filter(wanted), dim_time, "sale_date_key", attributes=["full_date", "day_of_month"])
    daily = rows.groupBy("sale_date_key", "full_date", "day_of_month").agg(_or_zero(revenue_sum()).alias("revenue"))
    return daily.select(
        F.col("full_date").alias("date"),
        in_currency(F.col("revenue"), currency).alias("revenue"),
        F.explode(F.array_compact(F.array(*labels))).alias("month_label"),
        F.col("day_of_month").alias("day"),
    ).orderBy("month_label", "day")


def month_aggregates(sales, payments, dim_time, start, end) -> DataFrame:
    """Distinct orders of the sales, gross and net of the payments."""
    orders = date_filter(sales, dim_time, "sale_date_key", start, end).agg(F.count_distinct("order_key"))
    paid = date_filter(payments, dim_time, "payment_date_key", start, end)
    paid = paid.agg(
        _or_zero(F.sum("gross_amount").cast(CENTS)).alias("revenue"), _or_zero(F.sum("net_amount").cast(CENTS)).alias("profit")
    )
    return paid.select(orders.scalar().alias("orders_count"), "revenue", "profit")


def comparison_percentages(sales, payments, dim_time, month1: str, month2: str, digits: int = 4) -> DataFrame:
    """Orders, revenue and profit of month 1 as a percentage of month 2; null where month 2 has 0."""
    first, second = (month_aggregates(sales, payments, dim_time, *_bounds(m)) for m in (month1, month2))
    labelled = first.withColumn("m", F.lit(1)).unionByName(second.withColumn("m", F.lit(2)))
    values = [(i, c) for i in (1, 2) for c in first.columns]
    both = labelled.agg(*[F.max(F.when(F.col("m") == i, F.col(c))).alias(f"m{i}_{c}") for i, c in values])
    parts = {"orders_count": "orders_pct", "revenue": "revenue_pct", "profit": "profit_pct"}
    percent = [ratio(F.col(f"m1_{c}") * 100, F.col(f"m2_{c}"), digits).alias(name) for c, name in parts.items()]
    return both.select(*percent, *both.columns)


def usd_to_display(df: DataFrame, columns, currency: str = "USD") -> DataFrame:
    """Money columns of a finished report in the display currency."""
    return df.withColumns({c: in_currency(F.col(c), currency) for c in columns})


# Display names of the report columns.
DISPLAY_NAMES = {
    "total_revenue": "Total Revenue (USD)",
    "total_orders": "Total Orders",
    "total_customers": "Total Customers",
    "average_order_value": "AOV (USD)",
    "full_date": "Date",
    "month": "Month",
    "revenue": "Revenue (USD)",
    "orders": "Orders",
    "profit": "Profit (USD)",
    "customer_type": "Customer Type",
    "customers": "Customers",
    "state_name": "State",
    "retention_rate": "Retention Rate (%)",
    "product": "Product",
    "customer_acquisition_cost": "CAC (USD)",
    "purchase_frequency": "Avg Purchase Frequency",
    "lifetime_value": "LTV (USD)",
    "cac": "CAC (USD)",
    "ltv_30d": "LTV 30d (USD)",
    "ltv_60d": "LTV 60d (USD)",
    "ltv_90d": "LTV 90d (USD)",
    "ltv_30d_to_cac": "LTV(30d)/CAC",
    "ltv_60d_to_cac": "LTV(60d)/CAC",
    "ltv_90d_to_cac": "LTV(90d)/CAC",
    "date": "Date",
    "month_label": "Month",
    "day": "Day",
}


def with_display_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[DISPLAY_NAMES.get(c, c) for c in df.columns])
