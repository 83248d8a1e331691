"""The driver tables shaped as a shop's star tables and as its raw text files.

Nothing is filtered: every row of the driver tables becomes a row here. Columns that need another join are built only when a
query asks for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import date_key
from ..operators.dimensions import build_dim_time
from ..session import by_key

# The driver tables span 1995-2001; the calendar of the reports must cover them.
CALENDAR = ("1995-01-01", "2002-12-31")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, read as it lies."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """The same rows, dealt over the cores: a table that lies in few row groups is read by as few tasks, however many cores
    there are, and all that is computed from it would run in these."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, key)


def dec(c: str, kind: str = "decimal(15,2)") -> Column:
    return F.col(c).cast(kind)


def day(c: str) -> Column:
    return F.to_date(c)


def dim_time(spark: SparkSession) -> DataFrame:
    return build_dim_time(spark, *CALENDAR)


def buyer_key() -> Column:
    """A buyer is a customer in one calendar year: some buyers order once, others again."""
    return F.col("o_custkey") * 100 + F.year("o_orderdate") - 1990


def discount() -> Column:
    return F.round(dec("l_extendedprice") * dec("l_discount", "decimal(4,2)"), 2).cast("decimal(15,2)")


def sales(spark: SparkSession, sf_dir: str, price: bool = False, geography: bool = False) -> DataFrame:
    """fact_sales: one row per order line."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    if price:
        # the product reports group these rows by order: prices come first, then one shuffle serves the join and the groups
        lines = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        lines, orders = by_key(lines, "l_orderkey"), by_key(orders, "o_orderkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    columns = [
        F.col("l_orderkey").alias("order_key"),
        F.col("l_orderkey").alias("order_id"),
        buyer_key().alias("customer_key"),
        F.col("l_partkey").alias("product_key"),
        F.concat(F.lit("MG"), F.col("l_partkey").cast("string")).alias("sku"),
        date_key(day("o_orderdate")).alias("sale_date_key"),
        date_key(day("l_shipdate")).alias("ship_date_key"),
        dec("l_extendedprice").alias("item_total"),
        discount().alias("discount_amount"),
        F.col("l_quantity").cast("int").alias("quantity_sold"),
    ]
    if price:
        columns.append(dec("p_retailprice").alias("item_price"))
    if geography:
        rows = rows.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        columns.append(F.col("c_nationkey").cast("bigint").alias("geography_key"))
    return rows.select(*columns)


def country() -> Column:
    return (
        F.when(F.col("r_name") == "AMERICA", "United States")
        .when(F.col("r_name") == "EUROPE", "Germany")
        .when(F.col("r_name") == "ASIA", "Japan")
        .otherwise(F.initcap("r_name"))
    )


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )


def dim_geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nations(spark, sf_dir).select(
        F.col("n_nationkey").cast("bigint").alias("geography_key"),
        country().alias("country_name"),
        F.col("n_name").alias("state_name"),
    )


def dim_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    edition = F.when(F.col("p_partkey") % 2 == 0, " handmade edition").otherwise("")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_key"),
        F.concat("p_name", F.lit(" "), "p_type", F.lit(" "), "p_brand", edition).alias("title"),
        F.lit(True).alias("is_current"),
    )


def dim_product_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    variants = table(spark, sf_dir, "part").withColumn("v", F.explode(F.array(F.lit(1), F.lit(2))))
    line, product = F.upper("p_type"), F.concat(F.lit("MG"), F.col("p_partkey").cast("string"))
    variant = F.concat(F.lit("0"), F.col("v").cast("string"))
    return variants.select(
        (F.col("p_partkey") * 2 + F.col("v")).alias("product_catalog_key"),
        line.alias("product_line_id"),
        product.alias("product_id"),
        variant.alias("variant_id"),
        F.col("p_type").alias("product_line_name"),
        F.col("p_name").alias("product_name"),
        F.concat(F.lit("Variant "), variant).alias("variant_name"),
        F.concat_ws("_", line, product, variant).alias("product_code"),
    )


def line_type() -> Column:
    n = F.col("l_linenumber")
    return (
        F.when(n == 1, "Sale").when(n <= 4, "Fee").when(n == 5, "Marketing").when(n == 6, "VAT").otherwise("Refund")
    )


# fixed values: one title per rule of the statement's VAT lines
VAT_TITLES = (
    "VAT: auto-renew sold",
    "VAT: shipping_transaction",
    "VAT: Processing Fee",
    "VAT: transaction credit",
    "VAT: listing credit",
    "VAT: listing",
    "VAT: Etsy Plus subscription",
    "VAT: other",
)


def line_title() -> Column:
    n, part = F.col("l_linenumber"), F.col("l_partkey")
    vat = F.element_at(F.array(*[F.lit(t) for t in VAT_TITLES]), (part % 8 + 1).cast("int"))
    return (
        F.when(n == 2, "Transaction fee")
        .when(n == 3, "Processing fee: card")
        .when((n == 4) & (part % 2 == 0), "LISTING FEE")
        .when(n == 4, "Regulatory Operating fee")
        .when(n == 6, vat)
        .otherwise("Order payment")
    )


def names_order() -> Column:
    """Statement lines whose info text names an order."""
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    return (n <= 5) | ((n == 6) & (s % 2 == 0)) | ((n == 7) & (s % 3 != 0))


def line_info() -> Column:
    order, part = F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")
    n = F.col("l_linenumber")
    named = F.when(n <= 5, F.concat(F.lit("Order #"), order)).otherwise(F.concat(F.lit("for order: "), order))
    other = F.when(n == 6, F.concat(F.lit("Listing #"), part)).otherwise(F.concat(F.lit("transaction: "), part))
    return F.when(names_order(), named).otherwise(other)


def line_fee() -> Column:
    fee = -F.round(dec("l_extendedprice") * dec("l_tax", "decimal(4,2)"), 2)
    return F.when(F.col("l_linenumber").between(2, 6), fee).cast("decimal(15,2)")


def line_amount() -> Column:
    price = dec("l_extendedprice")
    kind = line_type()
    return F.when(kind == "Sale", price).when(kind == "Refund", -price).cast("decimal(15,2)")


def financial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fact_financial_transactions: one statement line per order line."""
    return table(spark, sf_dir, "lineitem").select(
        date_key(day("l_shipdate")).alias("transaction_date_key"),
        F.when(names_order(), F.col("l_orderkey")).alias("order_id"),
        line_type().alias("transaction_type"),
        line_title().alias("transaction_title"),
        line_amount().alias("amount"),
        line_fee().alias("fees_and_taxes"),
    )


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fact_payments: one payment per order."""
    gross = dec("o_totalprice")
    fees = F.round(gross * F.lit(0.03).cast("decimal(3,2)"), 2).cast("decimal(15,2)")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("order_key"),
        date_key(day("o_orderdate")).alias("payment_date_key"),
        gross.alias("gross_amount"),
        fees.alias("fees"),
        (gross - fees).cast("decimal(15,2)").alias("net_amount"),
    )


# account of a bank row by quantity mod 14; 9999 is no known account
BANK_ACCOUNTS = (
    "6211",
    "6221",
    "6222",
    "6223",
    "6224",
    "6225",
    "6273",
    "6411",
    "6412",
    "6413",
    "6414",
    "6421",
    "6428",
    "9999",
)


def bank_account_code() -> Column:
    codes = F.array(*[F.lit(c) for c in BANK_ACCOUNTS])
    return F.element_at(codes, (F.col("l_quantity").cast("int") % 14 + 1).cast("int"))


def bank_key() -> Column:
    return (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000000 + F.col("l_partkey")


def variant_id() -> Column:
    return F.concat(F.lit("0"), (F.col("l_linenumber") % 2 + 1).cast("string"))


def debit() -> Column:
    return F.when(F.col("l_linenumber") > 1, F.round(dec("l_extendedprice") * F.lit(0.1).cast("decimal(2,1)"), 2)).cast("decimal(15,2)")


def credit() -> Column:
    return F.when(F.col("l_linenumber") == 1, dec("l_extendedprice"))


def bank(spark: SparkSession, sf_dir: str, texts: bool = False) -> DataFrame:
    """fact_bank_transactions: one bank row per order line."""
    rows = table(spark, sf_dir, "lineitem")
    code = bank_account_code()
    columns = [
        bank_key().alias("bank_transaction_key"),
        F.col("l_suppkey").alias("bank_account_key"),
        date_key(day("l_shipdate")).alias("transaction_date_key"),
        F.concat(F.lit("R"), bank_key().cast("string")).alias("reference_number"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("account_number"),
        F.when(code != "9999", code).alias("pl_account_number"),
        F.concat(F.lit("MG"), F.col("l_partkey").cast("string")).alias("parsed_product_id"),
        variant_id().alias("parsed_variant_id"),
        credit().alias("credit_amount"),
        debit().alias("debit_amount"),
        dec("l_extendedprice").alias("balance_after_transaction"),
        F.lit(True).alias("is_business_related"),
    ]
    if texts:
        rows = rows.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        key = F.col("l_partkey") * 2 + F.col("l_linenumber") % 2 + 1
        columns += [
            F.upper("p_type").alias("parsed_product_line_id"),
            bank_description().alias("transaction_description"),
            F.when(F.col("l_linenumber") % 3 == 0, key).alias("product_catalog_key"),
        ]
    return rows.select(*columns)


def bank_description() -> Column:
    ids = F.concat_ws("_", F.lower("p_type"), F.concat(F.lit("MG"), F.col("l_partkey").cast("string")), variant_id())
    return F.concat(ids, F.lit(" "), bank_account_code(), F.lit(" ck"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("bank_account_key"),
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("account_number"),
        F.col("s_name").alias("account_name"),
        none.alias("cif_number"),
        none.alias("customer_address"),
        F.lit(None).cast("date").alias("opening_date"),
        F.lit(True).alias("is_active"),
        F.when(F.col("s_suppkey") % 4 == 0, F.lit("USD")).otherwise("VND").alias("currency_code"),
        F.current_timestamp().alias("created_date"),
        F.current_timestamp().alias("updated_date"),
    )


# ---- raw text files -----------------------------------------------------------------------------------------------


def cents_text(amount: Column) -> Column:
    """``1,234.50`` of an amount with two decimals. Up to six digits before the point the comma is put into the number's own
    text; only larger numbers need the formatter, which takes several times as long."""
    text, size = amount.cast("string"), F.abs(amount)
    grouped = F.concat(F.substr(text, F.lit(1), F.length(text) - 6), F.lit(","), F.substr(text, F.length(text) - 5))
    return F.when(size < 1000, text).when(size < 1000000, grouped).otherwise(F.format_number(amount, 2))


def money_text(amount: Column, sign: Column) -> Column:
    """``-$1,234.50`` style text; null becomes the file's ``--``."""
    text = F.concat(F.when(amount < 0, "-").otherwise(""), sign, cents_text(F.abs(amount)))
    return F.coalesce(text, F.lit("--"))


def statement_currency() -> Column:
    s = F.col("l_suppkey")
    return F.when(s % 6 == 0, "vnd").when(s % 3 == 0, "VND").otherwise("USD")


def raw_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.when(F.col("l_suppkey") % 3 == 0, "₫").otherwise("$")
    net = F.coalesce(line_amount(), line_fee())
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_quantity") == 50, "no date").otherwise(F.date_format("l_shipdate", "MMMM d, yyyy")).alias("Date"),
        line_type().alias("Type"),
        line_title().alias("Title"),
        line_info().alias("Info"),
        statement_currency().alias("Currency"),
        money_text(line_amount(), sign).alias("Amount"),
        money_text(line_fee(), sign).alias("Fees & Taxes"),
        money_text(net, sign).alias("Net"),
        F.lit("--").alias("Tax Details"),
    )


def payment_method() -> Column:
    p = F.substring("o_orderpriority", 1, 1)
    return (
        F.when(p == "1", "Credit card online").when(p == "2", "PayPal").when(p == "3", "Inperson cash").when(p == "4", "--").otherwise("Credit card")
    )


def _shop_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").join(nations(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    return table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))


def ship_columns() -> list[Column]:
    return [
        F.col("c_mktsegment").alias("Ship City"),
        F.when(F.col("c_nationkey") % 5 == 0, "").otherwise(F.col("n_name")).alias("Ship State"),
        F.lpad((F.col("c_custkey") % 90).cast("string"), 5, "0").alias("Ship Zipcode"),
        country().alias("Ship Country"),
    ]


def raw_sold_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("o_orderkey") % 4
    value = dec("o_totalprice")
    return spread(_shop_orders(spark, sf_dir), "o_orderkey").select(
        F.date_format("o_orderdate", "MM/dd/yy").alias("Sale Date"),
        F.col("o_orderkey").cast("string").alias("Order ID"),
        F.concat(F.lit("  "), F.replace("c_name", F.lit("#"), F.lit("   ")), F.lit(" ")).alias("Full Name"),
        F.lit("Customer").alias("First Name"),
        F.substring_index("c_name", "#", -1).alias("Last Name"),
        F.lit("2").alias("Number of Items"),
        payment_method().alias("Payment Method"),
        F.date_format(F.date_add(day("o_orderdate"), 3), "MM/dd/yy").alias("Date Shipped"),
        F.concat(F.col("o_custkey").cast("string"), F.lit(" Main St")).alias("Street 1"),
        F.lit("").alias("Street 2"),
        *ship_columns(),
        F.lit("USD").alias("Currency"),
        money_text(value, F.lit("$")).alias("Order Value"),
        F.when(kind == 0, "SAVE10%").when(kind == 1, "FLAT5").otherwise("--").alias("Coupon Code"),
        F.when(kind == 0, "$10.00").when(kind == 1, "(5.00)").otherwise("").alias("Discount Amount"),
        F.lit("1.50").alias("Shipping"),
        money_text(value, F.lit("USD ")).alias("Order Total"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "shipped").otherwise("On hold").alias("Order Status"),
        money_text(F.round(value / 10, 2), F.lit("₫")).alias("Card Processing Fees"),
        money_text(value, F.lit("₫")).alias("Order Net"),
        F.lit("online").alias("Order Type"),
        F.lit("online_cc").alias("Payment Type"),
        F.concat(F.lit("MG"), F.col("o_custkey").cast("string"), F.lit(",MG"), F.col("o_orderkey").cast("string")).alias("SKU"),
    )


def item_name(prefix: str = "p_") -> Column:
    return F.concat("p_name", F.lit(" "), "p_type", F.lit(" no "), F.col("p_partkey").cast("string"))


def raw_sold_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(_shop_orders(spark, sf_dir), F.col("l_orderkey") == F.col("o_orderkey"))
    lines = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    color = F.substring_index("p_name", " ", 1)
    return lines.select(
        F.date_format("o_orderdate", "MM/dd/yy").alias("Sale Date"),
        item_name().alias("Item Name"),
        F.col("l_quantity").cast("int").cast("string").alias("Quantity"),
        money_text(dec("p_retailprice"), F.lit("$")).alias("Price"),
        discount().cast("string").alias("Discount Amount"),
        F.lit("3.50").alias("Order Shipping"),
        money_text(dec("l_extendedprice"), F.lit("$")).alias("Item Total"),
        bank_key().cast("string").alias("Transaction ID"),
        F.concat(F.col("l_partkey").cast("string"), F.when(F.col("l_linenumber") == 1, ".0").otherwise("")).alias("Listing ID"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("Date Paid"),
        F.when(F.col("l_linestatus") == "O", "N/A").otherwise(F.date_format("l_shipdate", "MM/dd/yyyy")).alias("Date Shipped"),
        *ship_columns(),
        F.col("l_orderkey").cast("string").alias("Order ID"),
        F.concat(F.lit("Size: "), F.col("p_size").cast("string"), F.lit(", Primary colour: "), color, F.lit("; note")).alias("Variations"),
        F.when(F.col("l_linenumber") == 2, "--").otherwise("online_cc").alias("Payment Type"),
        F.concat(F.lit("MG"), F.col("l_partkey").cast("string")).alias("SKU"),
    )


def buyer_name() -> Column:
    return F.concat(F.lit("buyer"), F.col("o_custkey").cast("string"), F.lit("_"), F.year("o_orderdate").cast("string"))


def raw_direct_checkout(spark: SparkSession, sf_dir: str) -> DataFrame:
    gross = dec("o_totalprice")
    vnd = F.col("o_orderkey") % 3 == 0
    sign = F.when(vnd, "₫").otherwise("$")
    fees = F.round(gross * F.lit(0.03).cast("decimal(3,2)"), 2)
    return spread(table(spark, sf_dir, "orders"), "o_orderkey").select(
        (F.col("o_orderkey") + 1000000).cast("string").alias("Payment ID"),
        buyer_name().alias("Buyer Username"),
        F.concat(F.lit("Buyer "), F.col("o_custkey").cast("string")).alias("Buyer Name"),
        F.col("o_orderkey").cast("string").alias("Order ID"),
        money_text(gross, sign).alias("Gross Amount"),
        money_text(fees, sign).alias("Fees"),
        money_text(gross - fees, sign).alias("Net Amount"),
        F.lit("").alias("Posted Gross"),
        F.when(vnd, "VND").otherwise("USD").alias("Currency"),
        F.lit(" usd ").alias("Listing Currency"),
        F.lit("1.25").alias("Exchange Rate"),
        F.lit("--").alias("VAT Amount"),
        F.col("o_orderstatus").alias("Status"),
        F.date_format("o_orderdate", "MM/dd/yyyy").alias("Order Date"),
        F.concat(F.lit("Ship "), F.col("o_custkey").cast("string")).alias("Buyer"),
        F.when(F.col("o_orderstatus") == "P", "inperson").otherwise("online_cc").alias("Payment Type"),
    )


def raw_deposits(spark: SparkSession, sf_dir: str) -> DataFrame:
    vnd = F.col("o_orderkey") % 3 == 0
    return spread(table(spark, sf_dir, "orders"), "o_orderkey").select(
        F.date_format("o_orderdate", "MMMM d, yyyy").alias("Date"),
        money_text(dec("o_totalprice"), F.when(vnd, "₫").otherwise("$")).alias("Amount"),
        F.when(vnd, "VND").otherwise("USD").alias("Currency"),
        F.col("o_orderstatus").alias("Status"),
        F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0").alias("Bank Account Ending Digits"),
    )


def raw_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, brand = F.col("p_size").cast("string"), F.col("p_brand")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("  A fine "), F.col("p_name")),
        F.lit("   "),
        F.lit("Thank you. Come again"),
        F.concat(F.lit("- Material: "), F.col("p_type"), F.lit(" yarn")),
        F.lit("  and cotton"),
        F.concat(F.lit("- Dimension: "), size, F.lit(" cm")),
        F.concat(F.lit("- Color: "), F.substring_index("p_name", " ", 1)),
        F.concat(F.lit("How it was made: by "), brand),
        F.lit("Proudly made in Vietnam."),
    )
    return spread(table(spark, sf_dir, "part"), "p_partkey").select(
        F.concat(F.lit(" "), F.upper(item_name())).alias("TITLE"),
        text.alias("DESCRIPTION"),
        dec("p_retailprice").cast("string").alias("PRICE"),
        F.lit("USD").alias("CURRENCY_CODE"),
        size.alias("QUANTITY"),
        F.concat(brand, F.lit(",gift, ,"), F.col("p_type")).alias("TAGS"),
        F.when(F.col("p_size") > 25, F.concat(F.lit('["'), F.col("p_type"), F.lit('", " wool "]'))).alias("MATERIALS"),
        F.concat(F.lit("https://img.example/"), F.col("p_partkey").cast("string")).alias("IMAGE1"),
        F.concat(F.lit("MG"), F.col("p_partkey").cast("string")).alias("SKU"),
    )


# fixed values: headers of a bank export
BANK_RAW_HEADERS = (
    "Ngày GD (Transaction Date)",
    "Mã giao dịch (Reference No.)",
    "Số tài khoản truy vấn (Account Number)",
    "Tên tài khoản truy vấn (Account Name)",
    "Ngày mở tài khoản (Opening Date)",
    "Phát sinh có (Credit Amount)",
    "Phát sinh nợ (Debit Amount)",
    "Số dư (Balance)",
    "Diễn giải (Description)",
)


def raw_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    missing = F.col("l_suppkey") % 10 == 9
    values = (
        F.date_format("l_shipdate", "dd/MM/yyyy"),
        F.concat(F.lit("R"), bank_key().cast("string")),
        F.when(missing, F.lit("  ")).otherwise(F.concat(F.lit(" S"), F.col("l_suppkey").cast("string"))),
        F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("Acc "), F.col("l_suppkey").cast("string"))),
        F.lit("01/02/2020"),
        cents_text(credit()),
        F.replace(cents_text(debit()), F.lit(","), F.lit(", ")),
        cents_text(dec("l_extendedprice")),
        bank_description(),
    )
    return lines.select(*[v.alias(h) for v, h in zip(values, BANK_RAW_HEADERS)])


def raw_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalog file with old headers; some keys come twice, some rows lack a key."""
    rows = spread(table(spark, sf_dir, "part"), "p_partkey").withColumn("v", F.explode(F.array(*[F.lit(i) for i in (1, 2, 2, 3)])))
    return rows.select(
        F.upper("p_type").alias("Product line ID "),
        F.concat(F.lit(" "), F.col("p_type"), F.lit("  line ")).alias("Product line"),
        F.concat(F.lit("MG"), F.col("p_partkey").cast("string"), F.lit(" ")).alias("product id"),
        F.col("p_name").alias("Product"),
        F.when(F.col("v") == 3, "nan").otherwise(F.concat(F.lit("0"), F.col("v").cast("string"))).alias("Variant ID"),
        F.concat(F.lit("Variant 0"), F.col("v").cast("string")).alias("Variants"),
    )


def raw_all(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    makers = {
        "statement": raw_statement,
        "direct_checkout": raw_direct_checkout,
        "listing": raw_listing,
        "sold_order_items": raw_sold_order_items,
        "sold_orders": raw_sold_orders,
        "deposits": raw_deposits,
        "bank_transactions": raw_bank,
        "product_catalog": raw_catalog,
    }
    return {k: make(spark, sf_dir) for k, make in makers.items()}
