"""Dimension builders."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CALENDAR_END, CALENDAR_START, CATALOG_KEY, CATALOG_NAMES, HOME_COUNTRY, INPUT_POSITION, OPEN_END, STAR_MONEY
from ..functions.dates import date_key, day_first_date
from ..functions.lookups import country_columns, is_peak_season, retail_season, selling_season
from ..functions.money import fitting
from ..functions.text import MONEY, as_col, clean_text, parse_list, sku_to_list, snake_name, strip, whole_number
from .keys import assign_keys, first_row, keep_first, position, row_order


def null_text() -> Column:
    return F.lit(None).cast("string")


def audit_columns() -> dict[str, Column]:
    return {"created_date": F.current_timestamp(), "updated_date": F.current_timestamp()}


def scd_columns() -> dict[str, Column]:
    """Validity of a current row. Rows are never closed: merges only insert unseen business keys."""
    return {
        "effective_date": F.current_timestamp(),
        "expiry_date": F.lit(OPEN_END).cast("timestamp"),
        "is_current": F.lit(True),
    }


def calendar_columns(day: Column, today: Column | None = None) -> dict[str, Column]:
    """All calendar attributes of a date."""
    today = F.current_date() if today is None else today
    week_start = F.date_sub(today, F.weekday(today))
    month, workday = F.month(day), F.weekday(day) < 5
    return {
        "time_key": date_key(day),
        "full_date": day,
        "year": F.year(day),
        "quarter": F.quarter(day),
        "month": month,
        "week_of_year": F.weekofyear(day),
        "day_of_month": F.dayofmonth(day),
        "day_of_week": F.weekday(day) + 1,
        "day_of_year": F.dayofyear(day),
        "month_name": F.date_format(day, "MMMM"),
        "day_name": F.date_format(day, "EEEE"),
        "quarter_name": F.concat(F.lit("Q"), F.quarter(day).cast("string")),
        "is_weekend": ~workday,
        "is_holiday": F.lit(False),
        "is_business_day": workday,
        "retail_season": retail_season(month),
        "is_peak_season": is_peak_season(month),
        "selling_season": selling_season(month),
        "is_current_day": day == today,
        "is_current_week": (day >= week_start) & (day < F.date_add(week_start, 7)),
        "is_current_month": (F.year(day) == F.year(today)) & (month == F.month(today)),
        "is_current_quarter": (F.year(day) == F.year(today)) & (F.quarter(day) == F.quarter(today)),
        "is_current_year": F.year(day) == F.year(today),
    }


def build_dim_time(
    spark: SparkSession, start: str = CALENDAR_START, end: str = CALENDAR_END, today: dt.date | None = None
) -> DataFrame:
    """One row per day from ``start`` to ``end``."""
    days = spark.range(1).select(
        F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("day")
    )
    return days.select(*[c.alias(n) for n, c in calendar_columns(F.col("day"), None if today is None else F.lit(today)).items()])


def location_hash(country: Column | str, state: Column | str, city: Column | str, null_text: str | None = "nan") -> Column:
    """First 16 hex digits of md5(country|state|city). With ``null_text`` None, a null part gives a null hash."""
    parts = [as_col(p) if null_text is None else F.coalesce(as_col(p), F.lit(null_text)) for p in (country, state, city)]
    joined = F.concat(parts[0], F.lit("|"), parts[1], F.lit("|"), parts[2])
    return F.substring(F.md5(joined.cast("binary")), 1, 16)


def build_dim_geography(orders: DataFrame) -> DataFrame:
    """One row per location hash, with the smallest postal code; places without a country are dropped."""
    places = (
        orders.filter(F.col("ship_country").isNotNull())
        .groupBy(
            F.col("ship_country").alias("country_name"),
            F.col("ship_state").alias("state_name"),
            F.col("ship_city").alias("city_name"),
        )
        .agg(F.min("ship_zipcode").alias("postal_code"), *[F.min(c).alias(INPUT_POSITION) for c in position(orders)])
        .withColumn("location_hash", location_hash("country_name", "state_name", "city_name"))
    )
    keyed = assign_keys(first_row(places, ["location_hash"]), "location_hash", "geography_key")
    return keyed.withColumns(country_columns("country_name") | audit_columns())


def first_by(column: str, order: str) -> Column:
    """The non-null value of ``column`` in the row with the smallest ``order``."""
    return F.min_by(as_col(column), F.when(as_col(column).isNotNull(), as_col(order))).alias(column)


CUSTOMER_COLUMNS = {
    "full_name": "full_name",
    "first_name": "first_name",
    "last_name": "last_name",
    "ship_country": "country",
    "ship_state": "state",
    "ship_city": "city",
    "ship_zipcode": "zipcode",
    "payment_method": "payment_method",
    "date_shipped": "ship_date",
    "street_1": "street_1",
    "street_2": "street_2",
    "ship_name": "ship_name",
}


def _pick(df: DataFrame, columns) -> DataFrame:
    return df.select(*[(as_col(c) if c in df.columns else null_text()).alias(c) for c in columns])


def build_dim_customer(orders: DataFrame, checkout: DataFrame | None) -> DataFrame:
    """One row per buyer: for each attribute the first non-null value in order-id order.

    Buyers come from the payments; without payments the full name stands in for the user name.
    """
    from_orders = [c for c in CUSTOMER_COLUMNS if c != "ship_name"]
    mine = _pick(orders, ["order_id", *from_orders])
    if checkout is None:
        buyers = mine.withColumns({"buyer_user_name": F.col("full_name"), "ship_name": null_text()})
        buyers = buyers.filter(F.col("buyer_user_name").isNotNull())
    else:
        # only rows with a buyer make a customer, so a left join from the payments holds all that a full join would
        pays = _pick(checkout, ["order_id", "buyer_username", "buyer"]).toDF("order_id", "buyer_user_name", "ship_name")
        buyers = pays.filter(F.col("buyer_user_name").isNotNull()).join(mine, "order_id", "left")
    buyers = buyers.withColumn("__order", whole_number("order_id"))
    one = buyers.groupBy("buyer_user_name").agg(*[first_by(c, "__order") for c in CUSTOMER_COLUMNS])
    one = one.withColumnsRenamed(CUSTOMER_COLUMNS)
    return assign_keys(one, "buyer_user_name", "customer_key").withColumns(scd_columns() | audit_columns())


ORDER_MONEY = STAR_MONEY["dim_order"]
ORDER_TEXT = ("order_type", "payment_method", "payment_type", "coupon_code", "coupon_details")


def build_dim_order(orders: DataFrame, checkout: DataFrame | None) -> DataFrame:
    """One row per order id of the orders or the payments."""
    wanted = ["order_id", *ORDER_TEXT, "number_of_items", *ORDER_MONEY, "ship_country", "ship_state", "ship_city", "inperson_location"]
    wanted += [INPUT_POSITION] if INPUT_POSITION in orders.columns else []
    mine = first_row(_pick(orders, wanted).withColumn("order_id", whole_number("order_id")), ["order_id"])
    if checkout is not None:
        paid = checkout.select(whole_number("order_id").alias("order_id")).distinct()
        mine = mine.join(paid, "order_id", "full_outer")
    mine = mine.filter(F.col("order_id").isNotNull())
    money = {c: fitting(F.col(c)) for c in ORDER_MONEY}
    coupon = F.col("coupon_code")
    derived = {
        "number_of_items": F.col("number_of_items").try_cast("int"),
        "has_discount": F.coalesce(F.col("discount_amount").try_cast(MONEY) > 0, F.lit(False)),
        "discount_type": F.when(coupon.contains("%"), "Percentage").when(coupon.isNotNull(), "Fixed"),
        "shipping_method": null_text(),
        "is_international": F.col("shipping_country") != HOME_COUNTRY,
        "is_gift": F.lit(False),
        "has_personalization": F.lit(False),
    }
    renamed = mine.withColumnsRenamed(
        {
            "ship_country": "shipping_country",
            "ship_state": "shipping_state",
            "ship_city": "shipping_city",
            "inperson_location": "in_person_location",
        }
    )
    return assign_keys(renamed.withColumns(money | derived), "order_id", "order_key").withColumns(audit_columns())


def build_dim_payment(datasets: dict[str, DataFrame], spark: SparkSession | None = None) -> DataFrame:
    """Distinct payment methods of the orders and payment types of the payments; 'Unknown' if there is none."""
    parts = []
    for name, column in (("sold_orders", "payment_method"), ("direct_checkout", "payment_type")):
        if name in datasets and column in datasets[name].columns:
            parts.append(datasets[name].select(as_col(column).alias("payment_method")))
    spark = spark or next(iter(datasets.values())).sparkSession
    unknown = spark.range(1).select(F.lit("Unknown").alias("payment_method"))
    if parts:
        found = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
        found = found.filter(F.col("payment_method").isNotNull()).distinct()
        # the fallback row survives only if no method was found
        unknown = unknown.filter(found.select(F.count("*")).scalar() == 0)
        methods = found.union(unknown)
    else:
        methods = unknown
    low = F.lower("payment_method")
    kind = F.when(low.contains("online"), "Online").when(low.contains("inperson"), "In-person").otherwise("Online")
    provider = (
        F.when(low.contains("credit"), "Etsy Payments").when(low.contains("paypal"), "PayPal").otherwise("Other")
    )
    keyed = assign_keys(methods, "payment_method", "payment_key")
    return keyed.withColumns({"payment_type": kind, "payment_provider": provider} | audit_columns())


LISTING_TEXT = (
    "color",
    "material",
    "dimensions",
    "how_made",
    "story",
    "instructions",
    "how_use",
    "fit_for",
    "country_origin",
    "variation_1_type",
    "variation_1_name",
    "variation_1_values",
    "variation_2_type",
    "variation_2_name",
    "variation_2_values",
)
IMAGES = tuple(f"image{i}" for i in range(1, 11))


def _title_key(c: str) -> Column:
    return F.lower(strip(c))


def _sku_items(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("array<string>")
    if df.schema[name].dataType.typeName() == "array":
        return F.when(F.array_join(as_col(name), "") != "", as_col(name))
    return F.when(as_col(name).isNotNull(), sku_to_list(name))


def build_dim_product(listing: DataFrame | None, items: DataFrame | None) -> DataFrame:
    """Listings and sold listings, matched by title; a listing's value wins over an item's.

    One row per listing id, or per title where no item gives the id. Null titles match nothing, and a row with neither
    could not be stored: the merge goes by listing id.
    """
    if listing is None and items is None:
        raise ValueError("neither listings nor order items are given")
    left = right = None
    if listing is not None:
        plain = ["title", "description", "price", "currency_code", "quantity", "tags", "materials", *LISTING_TEXT, *IMAGES]
        shown = listing.select(
            *[(as_col(c) if c in listing.columns else null_text()).cast("string").alias(c) for c in plain],
            _sku_items(listing, "sku").alias("sku"),
            *position(listing),
        )
        # one listing per title: the result has one row per listing id, so pairs of equal titles are never formed
        shown = shown.withColumn("__title", _title_key("title"))
        left = keep_first(shown, ["__title"], row_order(shown, ["__title"])).withColumnRenamed(INPUT_POSITION, "__at")
    if items is not None:
        sold = items.select(
            whole_number("listing_id").alias("listing_id"),
            as_col("item_name").alias("item_name"),
            (as_col("price") if "price" in items.columns else null_text()).cast(MONEY).alias("item_price"),
            (as_col("quantity") if "quantity" in items.columns else null_text()).try_cast("int").alias("item_quantity"),
            _sku_items(items, "sku").alias("item_sku"),
            *position(items),
        )
        right = first_row(sold.filter(F.col("listing_id").isNotNull()), ["listing_id"])
        right = right.withColumn("__title", _title_key("item_name"))
    if left is not None and right is not None:
        # a left join plus the unmatched listings instead of a full join: the runtime can split a hot title on the left
        matched = right.join(left, "__title", "left")
        unmatched = left.join(right.select("__title"), "__title", "left_anti")
        joined = matched.unionByName(unmatched, allowMissingColumns=True)
    else:
        joined = left if left is not None else right
    for name, kind in (
        ("listing_id", "bigint"),
        ("item_name", "string"),
        ("item_price", MONEY),
        ("item_quantity", "int"),
        ("item_sku", "array<string>"),
        *[(c, "string") for c in ("title", "description", "price", "currency_code", "quantity", "tags", "materials")],
        *[(c, "string") for c in (*LISTING_TEXT, *IMAGES)],
        ("sku", "array<string>"),
    ):
        if name not in joined.columns:
            joined = joined.withColumn(name, F.lit(None).cast(kind))
    empty = F.array().cast("array<string>")
    shaped = joined.select(
        "listing_id",
        clean_text(F.coalesce("title", "item_name")).alias("title"),
        clean_text("description").alias("description"),
        F.coalesce(fitting(F.regexp_replace("price", ",", "")), F.col("item_price")).alias("price"),
        F.coalesce("currency_code", F.lit("USD")).alias("currency_code"),
        F.coalesce(F.col("quantity").try_cast("int"), F.col("item_quantity")).alias("quantity"),
        *[null_text().alias(c) for c in ("category", "subcategory", "product_type")],
        parse_list("materials").alias("materials_list"),
        parse_list("tags").alias("tags_list"),
        *[F.col(c) for c in LISTING_TEXT],
        F.array_compact(F.array(*IMAGES)).alias("image_urls"),
        F.col("image1").alias("primary_image_url"),
        F.coalesce("sku", "item_sku", empty).alias("sku_list"),
        F.lit(0).cast("decimal(3,2)").alias("completeness_score"),
        *[F.col(c).alias(INPUT_POSITION) for c in joined.columns if c == "__at"],
    )
    key = F.coalesce(F.lpad(F.col("listing_id").cast("string"), 19, "0"), F.concat(F.lit("t:"), F.lower("title")))
    keyed = shaped.withColumn("__key", key).filter(F.col("__key").isNotNull())
    unique = first_row(keyed, ["__key"])
    return assign_keys(unique, "__key", "product_key").drop("__key").withColumns(scd_columns() | audit_columns())


def derive_bank_accounts(bank: DataFrame) -> DataFrame:
    """Accounts named by bank rows; the name defaults to the number and the currency to VND."""

    def find(*words: str) -> str | None:
        return next((c for c in bank.columns if all(w in c.lower() for w in words)), None)

    number, name, address = find("account_number"), find("account_name"), find("address")
    currency, opened = find("currency"), find("opening", "date") or find("mo_tai_khoan")
    rows = bank.select(
        as_col(number).alias("account_number"),
        F.coalesce(as_col(name), as_col(number)).alias("account_name") if name else as_col(number).alias("account_name"),
        (as_col(address) if address else null_text()).alias("customer_address"),
        (F.coalesce(as_col(currency), F.lit("VND")) if currency else F.lit("VND")).alias("currency_code"),
        (as_col(opened) if opened else F.lit(None).cast("date")).alias("opening_date"),
        *position(bank),
    )
    return first_row(rows.filter(F.col("account_number").isNotNull()), ["account_number"])


def opening_date(df: DataFrame) -> Column:
    """Opening date given as a date, as ``yyyymmdd`` or as text."""
    if "opening_date" not in df.columns:
        return F.lit(None).cast("date")
    if df.schema["opening_date"].dataType.typeName() in ("date", "timestamp"):
        return F.to_date("opening_date")
    text = F.regexp_replace(F.col("opening_date").cast("string"), r"\.0$", "")
    return F.coalesce(F.when(text.rlike(r"^\d{8}$"), F.try_to_date(text, "yyyyMMdd")), day_first_date(text))


def build_dim_bank_account(accounts: DataFrame) -> DataFrame:
    """One row per account number."""
    df = accounts.toDF(*[snake_name(c) for c in accounts.columns])

    def text(name: str) -> Column:
        return clean_text(name, 200) if name in df.columns else null_text()

    active = F.coalesce(F.col("is_active").try_cast("boolean"), F.lit(True)) if "is_active" in df.columns else F.lit(True)
    rows = df.select(
        text("account_number").alias("account_number"),
        F.coalesce(text("account_name"), text("account_number")).alias("account_name"),
        opening_date(df).alias("opening_date"),
        text("cif_number").alias("cif_number"),
        text("customer_address").alias("customer_address"),
        active.alias("is_active"),
        (F.coalesce(text("currency_code"), F.lit("VND"))).alias("currency_code"),
        *position(df),
    ).filter(F.col("account_number").isNotNull())
    one = first_row(rows, ["account_number"])
    return assign_keys(one, "account_number", "bank_account_key").withColumns(audit_columns())


def product_code() -> Column:
    return F.concat_ws("_", *CATALOG_KEY)


def build_dim_product_catalog(catalog: DataFrame) -> DataFrame:
    """Catalog rows with key and product code."""
    tidy = catalog.select(
        *[clean_text(c, 50).alias(c) for c in CATALOG_KEY],
        *[clean_text(c, 200).alias(c) for c in CATALOG_NAMES],
        *position(catalog),
    )
    rows = first_row(tidy.dropna(subset=list(CATALOG_KEY)), CATALOG_KEY).withColumn("product_code", product_code())
    natural = F.to_json(F.array(*CATALOG_KEY))  # unlike the code, never equal for two different keys
    keyed = assign_keys(rows.withColumn("__key", natural), "__key", "product_catalog_key")
    return keyed.drop("__key").withColumns(audit_columns())
