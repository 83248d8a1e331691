"""Product cost and margin: refunds and platform fees of an order are allocated to its products by their sales share.

``sales`` of a product is the sum of item prices (not times quantity), ``unit`` its row count. Amounts are allocated with
eight decimals, half up, so sums do not depend on the order of rows.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import COGS_ACCOUNTS, PL_ACCOUNTS
from ..functions.lookups import account_label
from ..functions.statement import fee_name, fee_rank, is_platform_fee
from ..functions.text import as_col
from ..operators.keys import keep_first
from ..session import by_key

CENTS = "decimal(20,2)"
SHARE = "decimal(28,8)"
RATIO = "decimal(28,8)"
PERCENT = "decimal(28,4)"
_WHOLE = "decimal(38,0)"
# order ids collected at once; longer lists are sorted in parts of about this size
ORDER_IDS_PER_PART = 10_000
# parts of a longer list, of about equal size
ORDER_ID_PARTS = 64


def _zero(kind: str) -> Column:
    return F.lit(0).cast(kind)


def _units(amount: Column, digits: int) -> Column:
    """An amount of at most ``digits`` decimals as a whole number of its smallest units."""
    return (amount * F.lit(10**digits).cast(f"decimal({digits + 1},0)")).cast(_WHOLE)


def _scaled(units: Column, digits: int) -> Column:
    # 29 + 8 + 1 digits: Spark would take scale away from a wider product
    return units.cast("decimal(29,0)") * F.lit(Decimal(1).scaleb(-digits)).cast(f"decimal({digits},{digits})")


def _whole_quotient(top: Column, bottom: Column, digits: int) -> Column:
    """top x 10^digits / bottom of whole numbers of one type, rounded half away from zero; null where the divisor is 0.

    Whole quotient and remainder are taken apart, so that nothing is lost to Spark's scale of a decimal quotient.
    """

    def div(a: Column, b: Column) -> Column:
        return F.call_function("div", a, b)

    size, by = F.abs(top), F.nullif(F.abs(bottom), F.lit(0))
    left = size % by
    total = div(size, by) * F.lit(10**digits) + div(left * F.lit(2 * 10**digits) + by, by * F.lit(2))
    return F.when((top < 0) != (bottom < 0), -total).otherwise(total)


def _quotient(factors: list[tuple[Column, int]], bottom: tuple[Column, int], digits: int, places: int) -> Column:
    """Product of amounts / an amount, exact and rounded half away from zero; null where the divisor is 0.

    Amounts come with their decimals; ``digits`` are added to the quotient of their smallest units, and the result has
    ``places`` decimals. Rows whose units are exact as doubles and whose steps fit 64 bits are computed in them, which takes
    a tenth of the time of wide decimals; the others are exact as long as the product fits 38 digits. An overflow beyond
    that is an error under ANSI, as for any sum.
    """
    amounts = [*factors, bottom]
    sizes = [F.abs(c.cast("double")) * float(10**d) for c, d in amounts]
    product = reduce(lambda x, y: x * y, sizes[:-1])
    fits = (product < 4e18) & (sizes[-1] * float(2 * 10**digits) < 4e18) & (product * float(10**digits) < sizes[-1] * 4e18)
    small = reduce(lambda x, y: x & y, [n < 1e15 for n in sizes], fits)
    short = [F.rint(c.cast("double") * float(10**d)).cast("bigint") for c, d in amounts]
    wide = [_units(c, d) for c, d in amounts]
    quick = _whole_quotient(reduce(lambda x, y: x * y, short[:-1]), short[-1], digits)
    top = reduce(lambda x, y: (x * y).cast(_WHOLE), wide[:-1])
    size, by = F.abs(top), F.nullif(F.abs(wide[-1]), F.lit(0).cast(_WHOLE))
    left = size % by
    doubled, twice = left * F.lit(2 * 10**digits) + by, by * 2
    total = ((size - left) / by).cast(_WHOLE) * F.lit(10**digits) + ((doubled - doubled % twice) / twice).cast(_WHOLE)
    exact = F.when((top < 0) != (wide[-1] < 0), -total).otherwise(total)
    return _scaled(F.when(small, quick.cast(_WHOLE)).otherwise(exact.cast(_WHOLE)), places)


def product_order_sales(sales: DataFrame, product: str | None = None) -> DataFrame:
    """(order_id, product_id, sales, unit): the one aggregate of the fact that all reports here start from."""
    rows = sales.filter(F.col("sku").isNotNull())
    if product is not None:
        rows = rows.filter(F.col("sku") == product)
    return rows.groupBy("order_id", F.col("sku").alias("product_id")).agg(
        F.coalesce(F.sum("item_price").cast(CENTS), _zero(CENTS)).alias("sales"), F.count("*").alias("unit")
    )


def _order_id_parts(pos: DataFrame, per_part: int) -> DataFrame:
    """(product_id, parts, part, ids): distinct order ids of each product as ascending arrays, cut by a hash of the id."""
    ids = by_key(pos.select("product_id", "order_id").filter(F.col("order_id").isNotNull()), "product_id")
    parts = ids.groupBy("product_id").agg(F.ceil(F.count("*") / per_part).cast("int").alias("parts"))
    cut = ids.join(parts, "product_id")
    cut = cut.withColumn("part", F.pmod(F.xxhash64("order_id"), "parts").cast("int"))
    return cut.groupBy("product_id", "parts", "part").agg(F.sort_array(F.collect_list("order_id")).alias("ids"))


def _id_text(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), ", ")


def sku_order_ids(pos: DataFrame, per_part: int = ORDER_IDS_PER_PART) -> DataFrame:
    """(product_id, parts, part, order_ids): distinct order ids of each product, comma-joined in ascending order.

    A product with many orders gets several parts, cut by a hash of the order id: every id is listed once, and no text or
    task grows with the size of a product.
    """
    return _order_id_parts(pos, per_part).select("product_id", "parts", "part", _id_text(F.col("ids")).alias("order_ids"))


def sales_by_sku(sales: DataFrame, per_part: int = ORDER_IDS_PER_PART) -> DataFrame:
    """One row per product: sales, units and all its order ids in one text, ascending. ``per_part`` only says how many ids
    are collected at once; the result does not depend on it."""
    pos = product_order_sales(sales)
    totals = pos.groupBy("product_id").agg(
        F.sum("sales").cast(CENTS).alias("sales"),
        F.sum("unit").alias("unit"),
        F.count("order_id").alias("order_count"),
    )
    return _with_order_ids(totals, pos, per_part)


def _ordered_id_parts(pos: DataFrame, per_part: int) -> DataFrame:
    """(product_id, part, ids): order ids of each product as ascending arrays; all ids of a part are below those of the next.

    A product with more than ``per_part`` ids is cut at quantiles of its own ids, which come from a sketch per product.
    """
    ids = by_key(pos.select("product_id", "order_id").filter(F.col("order_id").isNotNull()), "product_id")
    large = ids.groupBy("product_id").agg(F.count("*").alias("n")).filter(F.col("n") > per_part).select("product_id")
    fractions = F.array(*[F.lit(k / ORDER_ID_PARTS) for k in range(1, ORDER_ID_PARTS)])
    edges = ids.join(large, "product_id").groupBy("product_id").agg(F.percentile_approx("order_id", fractions).alias("edges"))
    below = F.size(F.filter("edges", lambda e: e < F.col("order_id")))
    cut = ids.join(edges, "product_id", "left").withColumn("part", F.when(F.col("edges").isNull(), 0).otherwise(below))
    return cut.groupBy("product_id", "part").agg(F.sort_array(F.collect_list("order_id")).alias("ids"))


def _with_order_ids(totals: DataFrame, pos: DataFrame, per_part: int) -> DataFrame:
    # a hot product reaches its one row as a few sorted arrays that only have to be put in order
    parts = _ordered_id_parts(pos, per_part).groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("part", _id_text(F.col("ids")).alias("text")))).alias("parts"))
    listed = parts.select("product_id", F.array_join(F.transform("parts", lambda p: p["text"]), ", ").alias("order_ids"))
    joined = totals.join(listed, "product_id", "left")
    empty = F.when(F.coalesce("order_count", F.lit(0)) == 0, F.lit(""))
    return joined.withColumn("order_ids", F.coalesce("order_ids", empty))


def _order_ref() -> Column:
    """Order id as a join key; -1 stands for "no order", which no id is.

    A key that cannot be null keeps the optimizer from filtering nulls on one side only, see ``with_order_totals``.
    """
    return F.coalesce(F.col("order_id"), F.lit(-1)).alias("order_ref")


def with_order_totals(pos: DataFrame) -> DataFrame:
    """Product sales per order with the order's total; rows of no order have none.

    Totals are joined back rather than taken by a window, which would hold a hot order in memory. The row counts are compared (always true) so that both sides need the same columns of ``pos``: then
    they share one shuffle instead of aggregating the fact twice.
    """
    rows = by_key(pos.withColumn("order_ref", _order_ref()), "order_ref")
    totals = rows.groupBy("order_ref").agg(F.sum("sales").cast(CENTS).alias("order_sales"), F.sum("unit").alias("order_unit"))
    joined = rows.join(totals, "order_ref")
    whole = F.when(F.col("order_id").isNotNull(), F.col("order_sales"))
    return joined.filter(F.col("order_unit") >= F.col("unit")).drop("order_unit").withColumn("order_sales", whole)


def order_ratio(sales: DataFrame) -> DataFrame:
    """(order_id, product_id, sales, order_sales, ratio): the share of each product in its order; 0 if nothing was sold."""
    joined = with_order_totals(product_order_sales(sales))
    share = _quotient([(F.col("sales"), 2)], (F.col("order_sales"), 2), 8, 8)
    ratio = F.when(F.col("order_sales") > 0, share).otherwise(F.lit(0)).cast(RATIO)
    return joined.select("order_id", "product_id", "sales", "order_sales", ratio.alias("ratio"))


def order_refunds(financial: DataFrame) -> DataFrame:
    return _charges(financial.filter(F.col("transaction_type") == "Refund")).select("order_id", "refund_amount")


def order_fees(financial: DataFrame) -> DataFrame:
    rows = financial.filter(is_platform_fee() & F.col("fees_and_taxes").isNotNull())
    return _charges(rows).select("order_id", "fee_amount")


def _charges(rows: DataFrame) -> DataFrame:
    """Amounts per order of ``rows``, all of which are refunds or platform fees."""
    known = rows.filter(F.col("order_id").isNotNull())  # lines of no order are the one hot group, and match nothing
    is_refund = F.col("transaction_type") == "Refund"
    refund = F.when(is_refund, F.abs(F.coalesce("amount", _zero(CENTS))))
    fee = F.when(~is_refund, F.abs("fees_and_taxes"))
    return known.groupBy("order_id").agg(
        F.sum(refund).cast(CENTS).alias("refund_amount"), F.sum(fee).cast(CENTS).alias("fee_amount")
    )


def order_charges(financial: DataFrame) -> DataFrame:
    """(order_id, refund_amount, fee_amount) in one pass over the statement lines."""
    return _charges(financial.filter((F.col("transaction_type") == "Refund") | is_platform_fee()))


def share_of(amount: Column, part: Column, whole: Column) -> Column:
    """amount x part / whole, 0 where the whole is not positive."""
    # cents x cents / cents, to 10^-8: six digits beyond cents
    exact = _quotient([(F.coalesce(amount, _zero(CENTS)), 2), (part, 2)], (whole, 2), 6, 8)
    return F.when(whole > 0, exact).otherwise(F.lit(0)).cast(SHARE)


def _with_charges(pos: DataFrame, charges: DataFrame, ratio_scope: str) -> DataFrame:
    """Product sales per order with the order's refund and fee shares.

    Scope 'order' divides by the order's sales; scope 'product' looks at one product alone, so that its share is 1.
    """
    if ratio_scope == "order":
        joined, whole = with_order_totals(pos), F.col("order_sales")
    elif ratio_scope == "product":
        joined, whole = pos.withColumn("order_ref", _order_ref()), F.col("sales")
    else:
        raise ValueError(f"unknown ratio scope {ratio_scope!r}")
    joined = joined.join(charges.withColumnRenamed("order_id", "order_ref"), "order_ref", "left")
    return joined.withColumns(
        {
            "refund": share_of(F.col("refund_amount"), F.col("sales"), whole),
            "platform_fee": share_of(F.col("fee_amount"), F.col("sales"), whole),
        }
    )


def allocate(sales: DataFrame, financial: DataFrame, ratio_scope: str = "order") -> DataFrame:
    """(product_id, refund, platform_fee): order amounts allocated to products."""
    shares = _with_charges(product_order_sales(sales), order_charges(financial), ratio_scope)
    return shares.groupBy("product_id").agg(
        F.sum("refund").cast(SHARE).alias("refund"), F.sum("platform_fee").cast(SHARE).alias("platform_fee")
    )


def _goods_rows(bank: DataFrame, accounts, product: str | None = None) -> DataFrame:
    rows = bank.filter(
        F.col("pl_account_number").isin(*accounts)
        & F.col("debit_amount").isNotNull()
        & F.col("parsed_product_id").isNotNull()
    )
    return rows if product is None else rows.filter(F.col("parsed_product_id") == product)


def cogs_by_product_variant(bank: DataFrame, product: str | None = None) -> DataFrame:
    return (
        _goods_rows(bank, COGS_ACCOUNTS, product)
        .groupBy(F.col("parsed_product_id").alias("product_id"), F.col("parsed_variant_id").alias("variant_id"))
        .agg(F.sum("debit_amount").cast(CENTS).alias("cogs"))
    )


def _product_metrics(pos: DataFrame, financial: DataFrame, ratio_scope: str) -> DataFrame:
    """Sales, units, refund and fee per product: one aggregate over the shared (order, product) rows."""
    shares = _with_charges(pos, order_charges(financial), ratio_scope)
    return shares.groupBy("product_id").agg(
        F.sum("sales").cast(CENTS).alias("sales"),
        F.sum("unit").alias("unit"),
        F.count("order_id").alias("order_count"),
        F.sum("refund").cast(SHARE).alias("refund"),
        F.sum("platform_fee").cast(SHARE).alias("platform_fee"),
    )


def _money_defaults(df: DataFrame) -> DataFrame:
    kinds = {"sales": CENTS, "cogs": CENTS, "refund": SHARE, "platform_fee": SHARE, "unit": "bigint"}
    return df.withColumns({c: F.coalesce(c, F.lit(0)).cast(k) for c, k in kinds.items()})


def _profit() -> Column:
    return (F.col("sales") - F.col("refund") - F.col("cogs") - F.col("platform_fee")).cast(SHARE)


def _margin(profit: Column) -> Column:
    """Profit in percent of the sales, 0 without sales."""
    # 10^-8 units over cents are 10^-4 of a percent
    percent = _quotient([(profit, 8)], (F.col("sales"), 2), 0, 4)
    return F.when(F.col("sales") != 0, percent).otherwise(F.lit(0)).cast(PERCENT)


def product_profitability(
    sales: DataFrame, financial: DataFrame, bank: DataFrame, catalog: DataFrame, per_part: int = ORDER_IDS_PER_PART
) -> DataFrame:
    """One row per catalog variant. Sales, refund and fee are those of the whole product on each variant; only the goods
    cost is the variant's own. ``order_ids`` as in ``sales_by_sku``."""
    pos = product_order_sales(sales)
    metrics = _with_order_ids(_product_metrics(pos, financial, "order"), pos, per_part)
    variants = catalog.filter(F.col("product_id").isNotNull() & F.col("variant_name").isNotNull())
    variants = variants.select("product_line_id", "product_name", "product_id", "variant_id", "variant_name")
    out = variants.join(metrics, "product_id", "left").join(
        cogs_by_product_variant(bank), ["product_id", "variant_id"], "left"
    )
    out = _money_defaults(out).withColumns(
        {
            "profit": _profit(),
            "order_ids": F.coalesce("order_ids", F.when(F.coalesce("order_count", F.lit(0)) == 0, "")),
            "order_count": F.coalesce("order_count", F.lit(0)),
        }
    )
    return out.select(
        "product_line_id",
        "product_name",
        "product_id",
        "variant_name",
        "sales",
        "order_count",
        "order_ids",
        "refund",
        "unit",
        "cogs",
        "platform_fee",
        "profit",
    ).orderBy("product_line_id", F.col("product_name").asc_nulls_last(), "product_id", "variant_name")


def variant_profitability(
    sales: DataFrame,
    financial: DataFrame,
    bank: DataFrame,
    catalog: DataFrame,
    product: str | None = None,
    ratio_scope: str = "product",
) -> DataFrame:
    """Distinct variants of one product, or of all products, with profit and margin."""
    # in scope 'order' the other products of the order are needed for the shares
    pos = product_order_sales(sales, product if ratio_scope == "product" else None)
    metrics = _product_metrics(pos, financial, ratio_scope)
    variants = catalog.filter(F.col("variant_name").isNotNull() & F.col("product_id").isNotNull())
    if product is not None:
        variants = variants.filter(F.col("product_id") == product)
    variants = variants.select("product_id", "variant_id", F.col("variant_name").alias("variant"))
    out = variants.join(metrics, "product_id", "left").join(
        cogs_by_product_variant(bank, product), ["product_id", "variant_id"], "left"
    )
    measures = ["product_id", "variant", "sales", "unit", "refund", "cogs", "platform_fee"]
    rows = _money_defaults(out).select(*measures).distinct().withColumn("profit", _profit())
    return rows.withColumn("margin", _margin(F.col("profit"))).orderBy("product_id", "variant")


def cogs_breakdown(bank: DataFrame, product: str | None = None) -> DataFrame:
    """Debits per product and profit-and-loss account, labelled."""
    out = (
        _goods_rows(bank, PL_ACCOUNTS, product)
        .groupBy(F.col("parsed_product_id").alias("product_id"), "pl_account_number")
        .agg(F.sum("debit_amount").cast(CENTS).alias("amount"))
    )
    out = out.withColumn("label", account_label("pl_account_number"))
    return out.select("product_id", "pl_account_number", "label", "amount").orderBy("product_id", "pl_account_number")


def fee_breakdown(
    sales: DataFrame, financial: DataFrame, product: str | None = None, ratio_scope: str = "product"
) -> DataFrame:
    """Platform fees per product and fee name, each statement line under the first name that fits; positive sums only."""
    pos = product_order_sales(sales, product if ratio_scope == "product" else None)
    pos = pos.filter(F.col("order_id").isNotNull())
    key = "order_id"
    if ratio_scope == "order":
        # joined by the key that the rows are dealt by; without rows of no order it is the order id
        pos, whole, key = with_order_totals(pos), F.col("order_sales"), "order_ref"
    else:
        whole = F.col("sales")
    if product is not None:
        pos = pos.filter(F.col("product_id") == product)
    lines = financial.filter(F.col("order_id").isNotNull() & F.col("fees_and_taxes").isNotNull())
    lines = lines.withColumn("fee_type", fee_name()).filter(F.col("fee_type").isNotNull())
    fees = lines.groupBy("order_id", "fee_type").agg(F.sum(F.abs("fees_and_taxes")).cast(CENTS).alias("fee_amount"))
    shares = pos.join(fees.withColumnRenamed("order_id", key), key).withColumn("amount", share_of(F.col("fee_amount"), F.col("sales"), whole))
    out = shares.groupBy("product_id", "fee_type").agg(F.sum("amount").cast(SHARE).alias("amount")).filter("amount > 0")
    out = out.withColumn("fee_rank", fee_rank("fee_type"))
    return out.select("product_id", "fee_type", "amount", "fee_rank").orderBy("product_id", "fee_rank")


def margin_breakdown(
    sales: DataFrame, financial: DataFrame, bank: DataFrame, product: str | None = None, ratio_scope: str = "product"
) -> DataFrame:
    """Per product and order: sales, share, refund, goods cost, fee, profit, margin.

    The goods cost of an order is the product's whole goods cost times the order's row count; it is multiplied, not
    joined row by row.
    """
    pos = product_order_sales(sales, product if ratio_scope == "product" else None)
    rows = _with_charges(pos, order_charges(financial), ratio_scope)
    if product is not None:
        rows = rows.filter(F.col("product_id") == product)
    goods = cogs_by_product_variant(bank, product).groupBy("product_id").agg(F.sum("cogs").cast(CENTS).alias("goods"))
    whole = F.col("order_sales") if ratio_scope == "order" else F.col("sales")
    percent = _quotient([(F.col("sales"), 2)], (whole, 2), 6, 4)
    out = rows.join(goods, "product_id", "left").select(
        "product_id",
        F.col("order_id").cast("string").alias("order_id"),
        "sales",
        F.when(whole > 0, percent).otherwise(F.lit(0)).cast(PERCENT).alias("sales_percent"),
        "refund",
        F.coalesce(F.col("goods") * F.col("unit"), F.lit(0)).cast(CENTS).alias("cogs"),
        "platform_fee",
    )
    out = out.withColumn("profit", _profit())
    margin = F.when(F.col("sales") > 0, _margin(F.col("profit"))).otherwise(F.lit(0).cast(PERCENT))
    return out.withColumn("margin_percent", margin)


def product_list(profitability: DataFrame, search: str | None = None) -> DataFrame:
    """The first variant row of each product in report order, optionally those whose name, id or line contains a text."""
    # null names sort last in the report
    ranked = profitability.withColumn("__name", F.struct(F.col("product_name").isNull(), F.col("product_name")))
    rows = keep_first(ranked, ["product_id"], ["product_line_id", "__name", "variant_name"]).drop("__name")
    if search and search.strip():
        text = search.strip().lower()
        fields = [F.lower(F.coalesce(as_col(c), F.lit(""))) for c in ("product_name", "product_id", "product_line_id")]
        rows = rows.filter(fields[0].contains(text) | fields[1].contains(text) | fields[2].contains(text))
    return rows


def product_totals(variants: DataFrame) -> DataFrame:
    """Sums over the variants of each product. Product-level amounts repeat on each variant, so they add up repeatedly."""
    sums = {"sales": CENTS, "unit": "bigint", "refund": SHARE, "cogs": CENTS, "platform_fee": SHARE, "profit": SHARE}
    total = variants.groupBy("product_id").agg(*[F.sum(c).cast(k).alias(c) for c, k in sums.items()])
    return total.withColumn("margin", _margin(F.col("profit")))
