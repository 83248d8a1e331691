"""SQL twins of the registered queries, for DuckDB over the same tables.

Money is computed in whole cents (or 1e-8 units for allocated amounts) with integer arithmetic, so that rounding half up is
exact on this side too.
"""

from __future__ import annotations

from .. import constants as K
from .adapter import BANK_ACCOUNTS, VAT_TITLES
from .queries import RANGE, TYPE_WORDS

ORACLE: dict[str, str] = {}

# ---- building blocks ----------------------------------------------------------------------------------------------


def rdiv(n: str, d: str) -> str:
    """Integer quotient rounded half away from zero; null where the divisor is 0 or null."""
    return (
        f"(CASE WHEN ({d}) = 0 THEN NULL WHEN ({n}) < 0 THEN -((2 * -CAST({n} AS HUGEINT) + ({d})) // (2 * ({d})))"
        f" ELSE (2 * CAST({n} AS HUGEINT) + ({d})) // (2 * ({d})) END)"
    )


def cents(c: str) -> str:
    return f"CAST(round({c} * 100) AS BIGINT)"


_KINDS = {
    "i": "CAST({} AS BIGINT)",
    "m": "CAST({} AS DOUBLE) / 100",  # cents
    "f4": "CAST({} AS DOUBLE) / 10000",
    "f1": "CAST({} AS DOUBLE) / 10",
    "f8": "CAST({} AS DOUBLE) / 100000000",
    "u": "CAST({} AS DOUBLE) / 100000000",  # allocated amounts
    "s": "CAST({} AS VARCHAR)",
    "d": "CAST(CAST({} AS DATE) AS VARCHAR)",
    "b": "CAST({} AS BOOLEAN)",
}


def add(name: str, body: str, /, **columns: str) -> None:
    """Register ``body`` (one select, may start with WITH) with typed output columns."""
    shown = []
    for column, kind in columns.items():
        column = column.replace("__", " ")
        quoted = f'"{column}"'
        shown.append(f'{_KINDS[kind].format(quoted)} AS {quoted}')
    ORACLE[name] = f"SELECT {', '.join(shown)} FROM ({body}) result"


def key(d: str) -> str:
    return f"CAST(strftime({d}, '%Y%m%d') AS INTEGER)"


def names_case(index: str, values) -> str:
    return "list_extract([" + ", ".join(f"'{v}'" for v in values) + f"], {index})"


SALES = f"""sales AS (
  SELECT l_orderkey AS order_key, l_orderkey AS order_id, o_custkey * 100 + year(o_orderdate) - 1990 AS customer_key,
    l_partkey AS product_key, 'MG' || l_partkey AS sku, CAST(o_orderdate AS DATE) AS sale_date,
    {cents('l_extendedprice')} AS total_c,
    (2 * {cents('l_extendedprice')} * {cents('l_discount')} + 100) // 200 AS disc_c,
    {cents('l_extendedprice')} - (2 * {cents('l_extendedprice')} * {cents('l_discount')} + 100) // 200 AS net_c,
    {cents('p_retailprice')} AS price_c, c_nationkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey)"""

LIFE = "life AS (SELECT customer_key, count(DISTINCT order_key) AS n FROM sales GROUP BY 1)"

LINE_TYPE = (
    "CASE l_linenumber WHEN 1 THEN 'Sale' WHEN 2 THEN 'Fee' WHEN 3 THEN 'Fee' WHEN 4 THEN 'Fee' WHEN 5 THEN 'Marketing'"
    " WHEN 6 THEN 'VAT' ELSE 'Refund' END"
)
LINE_TITLE = (
    "CASE WHEN l_linenumber = 2 THEN 'Transaction fee' WHEN l_linenumber = 3 THEN 'Processing fee: card'"
    " WHEN l_linenumber = 4 AND l_partkey % 2 = 0 THEN 'LISTING FEE' WHEN l_linenumber = 4 THEN 'Regulatory Operating fee'"
    f" WHEN l_linenumber = 6 THEN {names_case('l_partkey % 8 + 1', VAT_TITLES)} ELSE 'Order payment' END"
)
NAMES_ORDER = "(l_linenumber <= 5 OR (l_linenumber = 6 AND l_suppkey % 2 = 0) OR (l_linenumber > 6 AND l_suppkey % 3 <> 0))"
LINE_INFO = (
    f"CASE WHEN NOT {NAMES_ORDER} THEN CASE WHEN l_linenumber = 6 THEN 'Listing #' || l_partkey ELSE 'transaction: ' || l_partkey END"
    " WHEN l_linenumber <= 5 THEN 'Order #' || l_orderkey ELSE 'for order: ' || l_orderkey END"
)
LINE_AMOUNT = f"CASE WHEN l_linenumber = 1 THEN {cents('l_extendedprice')} WHEN l_linenumber > 6 THEN -{cents('l_extendedprice')} END"
LINE_FEE = f"CASE WHEN l_linenumber BETWEEN 2 AND 6 THEN -((2 * {cents('l_extendedprice')} * {cents('l_tax')} + 100) // 200) END"

FIN = f"""fin AS (
  SELECT CAST(l_shipdate AS DATE) AS tx_date, CASE WHEN {NAMES_ORDER} THEN l_orderkey END AS order_id, {LINE_TYPE} AS kind,
    {LINE_TITLE} AS title, {LINE_AMOUNT} AS amount_c, {LINE_FEE} AS fee_c FROM lineitem)"""

PAY = f"""pay AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS pay_date, {cents('o_totalprice')} AS gross_c,
    {cents('o_totalprice')} - ({cents('o_totalprice')} * 3 * 2 + 100) // 200 AS net_c FROM orders)"""

BANK_KEY = "((l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey)"
ACCOUNT_CODE = names_case("CAST(l_quantity AS INTEGER) % 14 + 1", BANK_ACCOUNTS)
VARIANT = "'0' || (l_linenumber % 2 + 1)"
DEBIT = f"CASE WHEN l_linenumber > 1 THEN (2 * {cents('l_extendedprice')} + 10) // 20 END"
CREDIT = f"CASE WHEN l_linenumber = 1 THEN {cents('l_extendedprice')} END"
DESCRIPTION = f"lower(p_type) || '_MG' || l_partkey || '_' || {VARIANT} || ' ' || {ACCOUNT_CODE} || ' ck'"

BANK = f"""bank AS (
  SELECT {BANK_KEY} AS bank_key, l_suppkey, CAST(l_shipdate AS DATE) AS tx_date, 'S' || l_suppkey AS account_number,
    nullif({ACCOUNT_CODE}, '9999') AS code, 'MG' || l_partkey AS product_id, {VARIANT} AS variant_id,
    upper(p_type) AS line_id, {DESCRIPTION} AS description, {CREDIT} AS credit_c, {DEBIT} AS debit_c,
    {cents('l_extendedprice')} AS balance_c, l_linenumber, l_partkey
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""

CATALOG = """catalog AS (
  SELECT p_partkey * 2 + v AS catalog_key, upper(p_type) AS line_id, 'MG' || p_partkey AS product_id, '0' || v AS variant_id,
    p_type AS line_name, p_name AS product_name, 'Variant 0' || v AS variant_name,
    upper(p_type) || '_MG' || p_partkey || '_0' || v AS code
  FROM part, (VALUES (1), (2)) t(v))"""

COUNTRY = "CASE r_name WHEN 'AMERICA' THEN 'United States' WHEN 'EUROPE' THEN 'Germany' WHEN 'ASIA' THEN 'Japan' WHEN 'AFRICA' THEN 'Africa' ELSE 'Middle East' END"
GOODS = "('" + "', '".join(K.COGS_ACCOUNTS) + "')"
MONTH = "strftime({}, '%Y-%m')"


def in_range(c: str) -> str:
    return f"{c} BETWEEN DATE '{RANGE[0]}' AND DATE '{RANGE[1]}'"


# ---- key figures --------------------------------------------------------------------------------------------------

add("date_filter", f"WITH {SALES} SELECT sale_date AS full_date, count(*) AS line_count FROM sales WHERE {in_range('sale_date')} GROUP BY 1", full_date="d", line_count="i")
add("customer_classes", f"WITH {SALES}, {LIFE} SELECT customer_key, CASE WHEN n = 1 THEN 'new' ELSE 'return' END AS customer_class FROM life", customer_key="i", customer_class="s")
add("customer_filter", f"WITH {SALES}, {LIFE} SELECT customer_key, count(*) AS line_count, sum(total_c) AS item_total FROM sales WHERE customer_key IN (SELECT customer_key FROM life WHERE n > 1) GROUP BY 1", customer_key="i", line_count="i", item_total="m")
add("total_revenue", f"WITH {SALES} SELECT coalesce(sum(net_c), 0) AS total_revenue FROM sales", total_revenue="m")
add("total_revenue_new", f"WITH {SALES}, {LIFE} SELECT coalesce(sum(net_c), 0) AS total_revenue FROM sales WHERE customer_key IN (SELECT customer_key FROM life WHERE n = 1)", total_revenue="m")
add("total_orders", f"WITH {SALES} SELECT count(DISTINCT order_key) AS total_orders FROM sales", total_orders="i")
add("total_orders_return", f"WITH {SALES}, {LIFE} SELECT count(DISTINCT order_key) AS total_orders FROM sales WHERE customer_key IN (SELECT customer_key FROM life WHERE n > 1)", total_orders="i")
add("total_customers", f"WITH {SALES} SELECT count(DISTINCT customer_key) AS total_customers FROM sales", total_customers="i")
add("average_order_value", f"WITH {SALES} SELECT {rdiv('sum(net_c)', 'count(DISTINCT order_key)')} AS average_order_value FROM sales", average_order_value="m")
add("aov_over_time", f"WITH {SALES} SELECT sale_date AS full_date, {rdiv('sum(net_c)', 'count(DISTINCT order_key)')} AS average_order_value FROM sales GROUP BY 1", full_date="d", average_order_value="m")
add("revenue_by_month", f"WITH {SALES} SELECT {MONTH.format('sale_date')} AS month, sum(net_c) AS revenue FROM sales GROUP BY 1", month="s", revenue="m")
add("revenue_by_month_range_return", f"WITH {SALES}, {LIFE} SELECT {MONTH.format('sale_date')} AS month, sum(net_c) AS revenue FROM sales JOIN life USING (customer_key) WHERE n > 1 AND {in_range('sale_date')} GROUP BY 1", month="s", revenue="m")
add("orders_by_month", f"WITH {SALES} SELECT {MONTH.format('sale_date')} AS month, count(DISTINCT order_key) AS orders FROM sales GROUP BY 1", month="s", orders="i")
add("currency_view", f"WITH {SALES} SELECT {MONTH.format('sale_date')} AS month, {rdiv('sum(net_c) * 24708655', '100000')} * 100 AS revenue FROM sales GROUP BY 1", month="s", revenue="m")
add("new_vs_returning_sales", f"WITH {SALES}, {LIFE} SELECT CASE WHEN n = 1 THEN 'New Customers' ELSE 'Returning Customers' END AS customer_type, sum(net_c) AS revenue FROM sales JOIN life USING (customer_key) GROUP BY 1", customer_type="s", revenue="m")
add("new_customers_over_time", f"WITH {SALES}, {LIFE} SELECT sale_date AS full_date, count(DISTINCT customer_key) AS customers FROM sales JOIN life USING (customer_key) WHERE n = 1 GROUP BY 1", full_date="d", customers="i")
_RETENTION = rdiv("count(DISTINCT CASE WHEN n > 1 THEN customer_key END) * 10000", "count(DISTINCT customer_key)")
add("retention_rate", f"WITH {SALES}, {LIFE} SELECT {_RETENTION} AS retention_rate FROM sales JOIN life USING (customer_key)", retention_rate="m")
add("retention_rate_range", f"WITH {SALES}, {LIFE} SELECT {_RETENTION} AS retention_rate FROM sales JOIN life USING (customer_key) WHERE {in_range('sale_date')}", retention_rate="m")

_CLV = f"""SELECT {rdiv('sum(total_c)', 'count(DISTINCT order_key)')} AS average_order_value,
  {rdiv('count(DISTINCT order_key) * 100', 'count(DISTINCT customer_key)')} AS purchase_frequency,
  {rdiv('sum(total_c)', 'count(DISTINCT customer_key)')} AS lifetime_value FROM sales"""
_CLV_COLUMNS = {"average_order_value": "m", "purchase_frequency": "m", "lifetime_value": "m"}
add("customer_lifetime_value", f"WITH {SALES}, e AS (SELECT max(sale_date) AS last FROM sales) {_CLV}, e WHERE sale_date BETWEEN last - 30 AND last", **_CLV_COLUMNS)
add("customer_lifetime_value_90d_new", f"WITH {SALES}, {LIFE} {_CLV} JOIN life USING (customer_key) WHERE n = 1 AND sale_date BETWEEN DATE '2001-06-30' - 90 AND DATE '2001-06-30'", **_CLV_COLUMNS)
add("revenue_comparison", f"""WITH {SALES} SELECT sale_date AS date, sum(net_c) AS revenue,
  CASE WHEN year(sale_date) = 1997 THEN 'Month 1' ELSE 'Month 2' END AS month_label, day(sale_date) AS day
  FROM sales WHERE month(sale_date) = 2 AND year(sale_date) IN (1997, 1998) GROUP BY 1, 3, 4""", date="d", revenue="m", month_label="s", day="i")
add("profit_by_month", f"WITH {PAY} SELECT {MONTH.format('pay_date')} AS month, sum(net_c) AS profit FROM pay GROUP BY 1", month="s", profit="m")
add("customers_by_location", f"""WITH {SALES} SELECT n_name AS state_name, count(DISTINCT customer_key) AS customers, sum(net_c) AS revenue
  FROM sales JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AMERICA'
  GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12""", state_name="s", customers="i", revenue="m")
add("sales_by_product", f"""WITH {SALES}, titled AS (SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand ||
    CASE WHEN p_partkey % 2 = 0 THEN ' handmade edition' ELSE '' END AS title FROM part)
  SELECT CASE WHEN length(title) > 30 THEN substr(title, 1, 27) || '...' ELSE title END AS product, sum(net_c) AS revenue
  FROM sales JOIN titled ON product_key = p_partkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""", product="s", revenue="m")
add("customer_acquisition_cost", f"""WITH {SALES}, {LIFE}, {FIN} SELECT {rdiv("abs((SELECT sum(fee_c) FROM fin WHERE kind = 'Marketing'))",
  "(SELECT count(*) FROM life WHERE n = 1)")} AS customer_acquisition_cost""", customer_acquisition_cost="m")

add("cac_ltv_by_month", f"""WITH {SALES}, {LIFE}, {FIN},
  months AS (SELECT DISTINCT date_trunc('month', d) AS first, last_day(d) AS last FROM (SELECT sale_date AS d FROM sales UNION SELECT tx_date FROM fin) x),
  fees AS (SELECT last_day(tx_date) AS last, abs(sum(fee_c)) AS fee FROM fin WHERE kind = 'Marketing' GROUP BY 1),
  fresh AS (SELECT last_day(sale_date) AS last, count(DISTINCT customer_key) AS n FROM sales JOIN life USING (customer_key) WHERE life.n = 1 GROUP BY 1),
  {', '.join(f'ltv{h} AS (SELECT last, {rdiv("sum(total_c)", "count(DISTINCT customer_key)")} AS v FROM months JOIN sales ON sale_date BETWEEN last - {h - 1} AND last GROUP BY 1)' for h in (30, 60, 90))},
  one AS (SELECT strftime(first, '%Y-%m') AS month, CASE WHEN fresh.n IS NOT NULL THEN {rdiv('coalesce(fee, 0)', 'fresh.n')} END AS cac,
    ltv30.v AS ltv_30d, ltv60.v AS ltv_60d, ltv90.v AS ltv_90d
    FROM months LEFT JOIN fees USING (last) LEFT JOIN fresh USING (last) LEFT JOIN ltv30 USING (last) LEFT JOIN ltv60 USING (last) LEFT JOIN ltv90 USING (last))
  SELECT *, {', '.join(f'{rdiv(f"ltv_{h}d * 100", "cac")} AS ltv_{h}d_to_cac' for h in (30, 60, 90))} FROM one""",
    month="s", cac="m", ltv_30d="m", ltv_60d="m", ltv_90d="m", ltv_30d_to_cac="m", ltv_60d_to_cac="m", ltv_90d_to_cac="m")
add("month_aggregates", f"""WITH {SALES}, {PAY} SELECT (SELECT count(DISTINCT order_key) FROM sales WHERE sale_date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31') AS orders_count,
  sum(gross_c) AS revenue, sum(net_c) AS profit FROM pay WHERE pay_date BETWEEN DATE '1995-01-01' AND DATE '2001-12-31'""", orders_count="i", revenue="m", profit="m")
add("comparison_percentages", f"""WITH {SALES}, {PAY},
  o AS (SELECT year(sale_date) AS y, count(DISTINCT order_key) AS n FROM sales WHERE month(sale_date) = 2 GROUP BY 1),
  p AS (SELECT year(pay_date) AS y, sum(gross_c) AS g, sum(net_c) AS t FROM pay WHERE month(pay_date) = 2 GROUP BY 1),
  m AS (SELECT y, n, g, t FROM o JOIN p USING (y))
  SELECT {rdiv('a.n * 1000000', 'b.n')} AS orders_pct, {rdiv('a.g * 1000000', 'b.g')} AS revenue_pct, {rdiv('a.t * 1000000', 'b.t')} AS profit_pct,
  a.n AS m1_orders_count, a.g AS m1_revenue, a.t AS m1_profit, b.n AS m2_orders_count, b.g AS m2_revenue, b.t AS m2_profit
  FROM m a, m b WHERE a.y = 1997 AND b.y = 1998""", orders_pct="f4", revenue_pct="f4", profit_pct="f4", m1_orders_count="i", m1_revenue="m", m1_profit="m", m2_orders_count="i", m2_revenue="m", m2_profit="m")

# ---- profit and loss ----------------------------------------------------------------------------------------------

_SUM = "coalesce(sum(CASE WHEN {} THEN {} END), 0) AS {}"
_FEE_SUMS = {"revenue": ("kind = 'Sale'", "amount_c"), "refund_cost": ("kind = 'Refund'", "abs(amount_c)")}
for _name, _kind, _part, _ in K.FEE_LINES:
    _test = f"kind = '{_kind}'" + (f" AND title ILIKE '%{_part}%'" if _part else "")
    _FEE_SUMS[_name] = (_test, "abs(fee_c)")
_COGS_SUMS = {n: (f"code = '{a}'", "debit_c") for a, (n, _) in K.COGS_ACCOUNTS.items()} | {"cost_of_goods": (f"code IN {GOODS}", "debit_c")}
_OPERATING_SUMS = {n: (f"code = '{a}'", "debit_c") for a, (n, _) in K.OPERATING_ACCOUNTS.items()}
_OPERATING = "('" + "', '".join(K.OPERATING_ACCOUNTS) + "')"


def sums(of: dict) -> str:
    return ", ".join(_SUM.format(test, value, name) for name, (test, value) in of.items())


_YM = "year(tx_date) AS year, month(tx_date) AS month, monthname(tx_date) AS month_name"
_YM_COLUMNS = {"year": "i", "month": "i", "month_name": "s"}
add("pl_periods", f"WITH {FIN}, {BANK} SELECT {_YM} FROM fin UNION SELECT {_YM} FROM bank", **_YM_COLUMNS)
add("pl_revenue_fees", f"WITH {FIN} SELECT {_YM}, {sums(_FEE_SUMS)} FROM fin GROUP BY 1, 2, 3", **_YM_COLUMNS, **dict.fromkeys(_FEE_SUMS, "m"))
add("pl_cogs", f"WITH {BANK} SELECT {_YM}, {sums(_COGS_SUMS)} FROM bank WHERE code IN {GOODS} GROUP BY 1, 2, 3", **_YM_COLUMNS, **dict.fromkeys(_COGS_SUMS, "m"))
add("pl_operating_costs", f"WITH {BANK} SELECT {_YM}, {sums(_OPERATING_SUMS)} FROM bank WHERE code IN {_OPERATING} GROUP BY 1, 2, 3", **_YM_COLUMNS, **dict.fromkeys(_OPERATING_SUMS, "m"))

_BANK_SUMS = _COGS_SUMS | _OPERATING_SUMS
_VAT = " + ".join(n for n, kind, *_ in K.FEE_LINES if kind == "VAT")
_FEES = " + ".join(n for n, kind, *_ in K.FEE_LINES if kind != "VAT")
_NET = "revenue - (" + " + ".join(K.PROFIT_ITEMS) + ")"


def assembled(keys: dict[str, str]) -> str:
    """CTEs ending in ``pl``: one row per period with all amounts."""
    select, names = ", ".join(f"{e} AS {n}" for n, e in keys.items()), ", ".join(keys)
    group = ", ".join(str(i + 1) for i in range(len(keys)))
    filled = ", ".join(f"coalesce({c}, 0) AS {c}" for c in [*_FEE_SUMS, *_BANK_SUMS])
    return f"""{FIN}, {BANK}, f AS (SELECT {select}, {sums(_FEE_SUMS)} FROM fin GROUP BY {group}),
      b AS (SELECT {select}, {sums(_BANK_SUMS)} FROM bank GROUP BY {group}),
      filled AS (SELECT {names}, {filled} FROM f FULL JOIN b USING ({names})),
      vat AS (SELECT *, {_VAT} AS total_vat_fees FROM filled),
      pl AS (SELECT *, {_FEES} + total_vat_fees AS total_platform_fees FROM vat)"""


_BY_MONTH = {"month": "month(tx_date)", "month_name": "monthname(tx_date)"}
_ALL_SUMS = dict.fromkeys([*_FEE_SUMS, *_BANK_SUMS, "total_vat_fees", "total_platform_fees"], "m")
add("pl_assemble", f"WITH {assembled(_BY_MONTH)} SELECT * FROM pl", month="i", month_name="s", **_ALL_SUMS)
add("net_profit", f"WITH {assembled({'year': 'year(tx_date)', 'month': 'month(tx_date)'})} SELECT year, month, revenue, {_NET} AS default_profit, revenue - refund_cost - listing_fee AS chosen_profit FROM pl",
    year="i", month="i", revenue="m", default_profit="m", chosen_profit="m")


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _lines(source: str) -> str:
    """The statement lines of one table of amounts, as a union with line number and label."""
    rows = [
        f"SELECT {i} AS line_no, {_quote(label)} AS line_item, period, period_no, {column or 'CAST(NULL AS BIGINT)'} AS amount FROM {source}"
        for i, (label, column) in enumerate(K.STATEMENT_LINES, start=1)
    ]
    return " UNION ALL ".join(rows)


_LINE_COLUMNS = list(dict.fromkeys(c for _, c in K.STATEMENT_LINES if c))
_TOTALS = ", ".join(f"sum({c}) AS {c}" for c in _LINE_COLUMNS)


def _long(keys: dict[str, str], label: str, number: str) -> str:
    return f"""{assembled(keys)}, named AS (SELECT {label} AS period, {number} AS period_no, *, {_NET} AS net_profit FROM pl),
      whole AS (SELECT '{K.FULL_YEAR}' AS period, CAST(NULL AS BIGINT) AS period_no, {_TOTALS} FROM named),
      lines AS ({_lines('named')} UNION ALL {_lines('whole')})"""


add("pl_statement_long", f"WITH {_long(_BY_MONTH, 'month_name', 'month')} SELECT * FROM lines", line_no="i", line_item="s", period="s", period_no="i", amount="m")
_YEARS = [str(y) for y in range(1995, 2002)] + [K.FULL_YEAR]
_WIDE = ", ".join(f"""max(CASE WHEN period = '{y}' THEN amount END) AS "{y}" """ for y in _YEARS)
add("pl_statement", f"""WITH {_long({'year': 'year(tx_date)'}, 'CAST(year AS VARCHAR)', 'year')} SELECT line_item AS "Line Item", {_WIDE} FROM lines GROUP BY line_no, line_item""",
    Line__Item="s", **{y.replace(" ", "__"): "m" for y in _YEARS})

# ---- product cost -------------------------------------------------------------------------------------------------

_FEE_TEST = " OR ".join(f"(kind = '{k}'" + (f" AND title ILIKE '%{p}%')" if p else ")") for _, k, p, _ in K.FEE_LINES)
_FEE_NAME = "CASE " + " ".join(
    f"WHEN kind = '{k}'" + (f" AND title ILIKE '%{p}%'" if p else "") + f" THEN '{n}'" for _, k, p, n in K.FEE_LINES
) + " END"
_FEE_RANK = "CASE fee_type " + " ".join(f"WHEN '{n}' THEN {i}" for i, (*_, n) in enumerate(K.FEE_LINES, start=1)) + " END"
POS = f"""{SALES}, pos AS (SELECT order_id, sku AS product_id, sum(price_c) AS sales, count(*) AS unit FROM sales GROUP BY 1, 2),
  tot AS (SELECT order_id, sum(sales) AS order_sales FROM pos GROUP BY 1)"""
CHARGES = f"""{FIN}, refunds AS (SELECT order_id, sum(abs(amount_c)) AS refund_amount FROM fin WHERE kind = 'Refund' AND order_id IS NOT NULL GROUP BY 1),
  fees AS (SELECT order_id, sum(abs(fee_c)) AS fee_amount FROM fin WHERE fee_c IS NOT NULL AND order_id IS NOT NULL AND ({_FEE_TEST}) GROUP BY 1)"""


def share(amount: str, whole: str) -> str:
    """Allocated amount in 1e-8 units."""
    return f"CASE WHEN {whole} > 0 THEN {rdiv(f'coalesce({amount}, 0) * CAST(sales AS HUGEINT) * 1000000', whole)} ELSE 0 END"


def shares(whole: str) -> str:
    return f"""{POS}, {CHARGES}, shares AS (SELECT pos.*, order_sales, {share('refund_amount', whole)} AS refund, {share('fee_amount', whole)} AS platform_fee
      FROM pos LEFT JOIN tot USING (order_id) LEFT JOIN refunds USING (order_id) LEFT JOIN fees USING (order_id))"""


_IDS = "string_agg(CAST(order_id AS VARCHAR), ', ' ORDER BY order_id)"
add("sales_by_sku", f"WITH {POS} SELECT product_id, sum(sales) AS sales, sum(unit) AS unit, count(*) AS order_count, {_IDS} AS order_ids FROM pos GROUP BY 1",
    product_id="s", sales="m", unit="i", order_count="i", order_ids="s")
add("sku_order_ids", f"WITH {POS}, n AS (SELECT product_id, (count(*) + 9) // 10 AS parts FROM pos GROUP BY 1) SELECT product_id, parts, order_id FROM pos JOIN n USING (product_id)",
    product_id="s", parts="i", order_id="i")
add("order_ratio", f"WITH {POS} SELECT order_id, product_id, sales, order_sales, CASE WHEN order_sales > 0 THEN {rdiv('sales * 100000000', 'order_sales')} ELSE 0 END AS ratio FROM pos JOIN tot USING (order_id)",
    order_id="i", product_id="s", sales="m", order_sales="m", ratio="f8")
add("order_refunds", f"WITH {CHARGES} SELECT * FROM refunds", order_id="i", refund_amount="m")
add("order_fees", f"WITH {CHARGES} SELECT * FROM fees", order_id="i", fee_amount="m")
_ALLOCATED = "SELECT product_id, sum(refund) AS refund, sum(platform_fee) AS platform_fee FROM shares GROUP BY 1"
add("allocate", f"WITH {shares('order_sales')} {_ALLOCATED}", product_id="s", refund="u", platform_fee="u")
add("allocate_product_scope", f"WITH {shares('sales')} {_ALLOCATED}", product_id="s", refund="u", platform_fee="u")
_COGS_CTE = f"cogs AS (SELECT product_id, variant_id, sum(debit_c) AS cogs FROM bank WHERE code IN {GOODS} AND debit_c IS NOT NULL GROUP BY 1, 2)"
add("cogs_by_product_variant", f"WITH {BANK}, {_COGS_CTE} SELECT * FROM cogs", product_id="s", variant_id="s", cogs="m")


def metrics(whole: str) -> str:
    return f"""{shares(whole)}, metrics AS (SELECT product_id, sum(sales) AS sales, sum(unit) AS unit, count(*) AS order_count, {_IDS} AS order_ids,
      sum(refund) AS refund, sum(platform_fee) AS platform_fee FROM shares GROUP BY 1), {BANK}, {_COGS_CTE}, {CATALOG},
      measured AS (SELECT c.*, coalesce(sales, 0) AS sales, coalesce(unit, 0) AS unit, coalesce(order_count, 0) AS order_count,
        coalesce(order_ids, '') AS order_ids, coalesce(refund, 0) AS refund, coalesce(platform_fee, 0) AS platform_fee, coalesce(cogs, 0) AS cogs
        FROM catalog c LEFT JOIN metrics USING (product_id) LEFT JOIN cogs USING (product_id, variant_id)),
      profits AS (SELECT *, (sales - cogs) * CAST(1000000 AS HUGEINT) - refund - platform_fee AS profit FROM measured)"""


_PROFIT_COLUMNS = {"sales": "m", "order_count": "i", "refund": "u", "unit": "i", "cogs": "m", "platform_fee": "u", "profit": "u"}
add("product_profitability", f"WITH {metrics('order_sales')} SELECT line_id AS product_line_id, product_name, product_id, variant_name, order_ids, sales, order_count, refund, unit, cogs, platform_fee, profit FROM profits",
    product_line_id="s", product_name="s", product_id="s", variant_name="s", order_ids="s", **_PROFIT_COLUMNS)
_MARGIN = f"CASE WHEN sales <> 0 THEN {rdiv('profit', 'sales')} ELSE 0 END AS margin"
add("variant_profitability", f"WITH {metrics('sales')} SELECT DISTINCT product_id, variant_name AS variant, sales, unit, refund, cogs, platform_fee, profit, {_MARGIN} FROM profits",
    product_id="s", variant="s", sales="m", unit="i", refund="u", cogs="m", platform_fee="u", profit="u", margin="f4")
add("product_totals", f"""WITH {metrics('sales')}, v AS (SELECT DISTINCT product_id, variant_name, sales, unit, refund, cogs, platform_fee, profit FROM profits),
  t AS (SELECT product_id, sum(sales) AS sales, sum(unit) AS unit, sum(refund) AS refund, sum(cogs) AS cogs, sum(platform_fee) AS platform_fee, sum(profit) AS profit FROM v GROUP BY 1)
  SELECT *, {_MARGIN} FROM t""", product_id="s", sales="m", unit="i", refund="u", cogs="m", platform_fee="u", profit="u", margin="f4")
add("product_list", f"""WITH {metrics('order_sales')}, ranked AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY line_id, product_name, variant_name) AS r FROM profits)
  SELECT line_id AS product_line_id, product_name, product_id, variant_name, sales, order_count, refund, unit, cogs, platform_fee, profit FROM ranked
  WHERE r = 1 AND (product_name ILIKE '%red%' OR product_id ILIKE '%red%' OR line_id ILIKE '%red%')""",
    product_line_id="s", product_name="s", product_id="s", variant_name="s", **_PROFIT_COLUMNS)
_LABELS = "CASE code " + " ".join(f"WHEN '{a}' THEN {_quote(label)}" for a, (_, label) in K.PL_ACCOUNTS.items()) + " END"
add("cogs_breakdown", f"WITH {BANK} SELECT product_id, code AS pl_account_number, {_LABELS} AS label, sum(debit_c) AS amount FROM bank WHERE code IS NOT NULL AND debit_c IS NOT NULL GROUP BY 1, 2, 3",
    product_id="s", pl_account_number="s", label="s", amount="m")
for _query, _whole in (("fee_breakdown", "sales"), ("fee_breakdown_order_scope", "order_sales")):
    add(_query, f"""WITH {POS}, {FIN}, typed AS (SELECT order_id, {_FEE_NAME} AS fee_type, fee_c FROM fin WHERE fee_c IS NOT NULL AND order_id IS NOT NULL),
      byt AS (SELECT order_id, fee_type, sum(abs(fee_c)) AS fee_amount FROM typed WHERE fee_type IS NOT NULL GROUP BY 1, 2),
      one AS (SELECT product_id, fee_type, sum({share('fee_amount', _whole)}) AS amount FROM pos JOIN tot USING (order_id) JOIN byt USING (order_id) GROUP BY 1, 2)
      SELECT product_id, fee_type, amount, {_FEE_RANK} AS fee_rank FROM one WHERE amount > 0""",
        product_id="s", fee_type="s", amount="u", fee_rank="i")
add("margin_breakdown", f"""WITH {shares('sales')}, {BANK}, goods AS (SELECT product_id, sum(debit_c) AS goods FROM bank WHERE code IN {GOODS} GROUP BY 1),
  m AS (SELECT product_id, order_id, sales, CASE WHEN sales > 0 THEN 1000000 ELSE 0 END AS sales_percent, refund, coalesce(goods * unit, 0) AS cogs, platform_fee FROM shares LEFT JOIN goods USING (product_id)),
  p AS (SELECT *, (sales - cogs) * CAST(1000000 AS HUGEINT) - refund - platform_fee AS profit FROM m)
  SELECT *, CASE WHEN sales > 0 THEN {rdiv('profit', 'sales')} ELSE 0 END AS margin_percent FROM p""",
    product_id="s", order_id="s", sales="m", sales_percent="f4", refund="u", cogs="m", platform_fee="u", profit="u", margin_percent="f4")

# ---- bank and catalog reports -------------------------------------------------------------------------------------

_ACCOUNTS = "accounts AS (SELECT s_suppkey, 'S' || s_suppkey AS account_number, s_name AS account_name, CASE WHEN s_suppkey % 4 = 0 THEN 'USD' ELSE 'VND' END AS currency_code FROM supplier)"
_SUMMARY = f"""{BANK}, {_ACCOUNTS}, summary AS (SELECT accounts.account_number, account_name, NULL AS cif_number, NULL AS customer_address, NULL AS opening_date, currency_code,
    count(*) AS total_transactions, sum(coalesce(credit_c, 0)) AS total_credit, sum(coalesce(debit_c, 0)) AS total_debit, max(balance_c) AS current_balance,
    min(tx_date) AS first_transaction_date, max(tx_date) AS last_transaction_date FROM bank JOIN accounts ON l_suppkey = s_suppkey GROUP BY 1, 2, 6)"""
_SUMMARY_COLUMNS = {
    "account_number": "s", "account_name": "s", "cif_number": "s", "customer_address": "s", "opening_date": "s", "currency_code": "s",
    "total_transactions": "i", "total_credit": "m", "total_debit": "m", "current_balance": "m", "first_transaction_date": "d", "last_transaction_date": "d",
}
add("bank_account_summary", f"WITH {_SUMMARY} SELECT * FROM summary", **_SUMMARY_COLUMNS)
add("bank_account_page", f"WITH {_SUMMARY} SELECT * FROM summary ORDER BY total_credit DESC, account_number LIMIT 5 OFFSET 3", **_SUMMARY_COLUMNS)
add("bank_account_count", "SELECT count(DISTINCT s_suppkey) AS total FROM supplier", total="i")
add("bank_account_info", f"WITH {_ACCOUNTS} SELECT account_name, account_number, 'N/A' AS cif_number, 'N/A' AS customer_address, 'N/A' AS opening_date, currency_code FROM accounts",
    account_name="s", account_number="s", cif_number="s", customer_address="s", opening_date="s", currency_code="s")
add("account_statement", f"""WITH {BANK} SELECT tx_date AS transaction_date, 'R' || bank_key AS reference_number, account_number, s_name AS account_name, NULL AS opening_date,
  coalesce(credit_c, 0) AS credit_amount, coalesce(debit_c, 0) AS debit_amount, balance_c AS balance, description
  FROM bank JOIN supplier ON bank.l_suppkey = s_suppkey WHERE tx_date >= DATE '1996-01-01'""",
    transaction_date="d", reference_number="s", account_number="s", account_name="s", opening_date="s", credit_amount="m", debit_amount="m", balance="m", description="s")
_CATALOG_SELECT = "catalog_key AS product_catalog_key, line_id AS product_line_id, product_id, variant_id, line_name AS product_line_name, product_name, variant_name, code AS product_code"
_CATALOG_COLUMNS = {"product_catalog_key": "i"} | dict.fromkeys(["product_line_id", "product_id", "variant_id", "product_line_name", "product_name", "variant_name", "product_code"], "s")
_CATALOG_LIKE = "concat_ws(chr(1), line_id, product_id, variant_id, line_name, product_name, variant_name, code) ILIKE '%{}%'"
add("browse_catalog", f"WITH {CATALOG} SELECT {_CATALOG_SELECT} FROM catalog WHERE {_CATALOG_LIKE.format('red')} ORDER BY product_name DESC, catalog_key LIMIT 50 OFFSET 20", **_CATALOG_COLUMNS)
add("catalog_count", f"WITH {CATALOG} SELECT count(*) AS total FROM catalog WHERE {_CATALOG_LIKE.format('economy')}", total="i")
_BROWSE = f"""{BANK}, {CATALOG}, rows AS (SELECT bank_key AS bank_transaction_key, tx_date AS transaction_date, 'R' || bank_key AS reference_number, bank.account_number, s_name AS account_name,
    description AS transaction_description, code AS pl_account_number, bank.line_id AS parsed_product_line_id, bank.product_id AS parsed_product_id, bank.variant_id AS parsed_variant_id,
    coalesce(credit_c, 0) AS credit_amount, coalesce(debit_c, 0) AS debit_amount, balance_c AS balance_after_transaction, true AS is_business_related
    FROM bank JOIN supplier ON bank.l_suppkey = s_suppkey),
  named AS (SELECT rows.*, c.line_name AS product_line_name, c.product_name, c.variant_name FROM rows LEFT JOIN catalog c
    ON c.line_id = parsed_product_line_id AND c.product_id = parsed_product_id AND c.variant_id = parsed_variant_id)"""
_BROWSE_COLUMNS = {
    "bank_transaction_key": "i", "transaction_date": "d", "reference_number": "s", "account_number": "s", "account_name": "s", "transaction_description": "s",
    "pl_account_number": "s", "parsed_product_line_id": "s", "parsed_product_id": "s", "parsed_variant_id": "s", "product_line_name": "s", "product_name": "s",
    "variant_name": "s", "credit_amount": "m", "debit_amount": "m", "balance_after_transaction": "m", "is_business_related": "b",
}
add("browse_bank_transactions", f"WITH {_BROWSE} SELECT * FROM named WHERE transaction_description ILIKE '%economy%' ORDER BY transaction_date DESC, bank_transaction_key DESC LIMIT 200 OFFSET 100", **_BROWSE_COLUMNS)
add("browse_all_bank_transactions", f"WITH {_BROWSE} SELECT * FROM named", **_BROWSE_COLUMNS)
add("bank_transaction_count", f"WITH {BANK} SELECT count(*) AS total FROM bank WHERE description ILIKE '%r%9%' OR 'R' || bank_key ILIKE '%r%9%' OR account_number ILIKE '%r%9%'", total="i")
add("filter_accounts", f"WITH {_SUMMARY} SELECT * FROM summary WHERE (account_number ILIKE '%s1%' OR account_name ILIKE '%s1%') AND currency_code = 'VND'", account_number="s", currency_code="s", total_credit="m")
add("filter_any_column", f"WITH {CATALOG} SELECT code AS product_code, product_name FROM catalog WHERE {_CATALOG_LIKE.format('widget')}", product_code="s", product_name="s")
add("distinct_values", f"WITH {_ACCOUNTS} SELECT DISTINCT upper(p_type) AS value, 'line' AS list FROM part UNION SELECT DISTINCT currency_code, 'currency' FROM accounts", value="s", list="s")

# ---- cleaners -----------------------------------------------------------------------------------------------------

add("null_tokens", f"SELECT {LINE_TITLE} AS Title, count(*) AS line_count, count({LINE_AMOUNT}) AS amounts, count(coalesce({LINE_AMOUNT}, {LINE_FEE})) AS nets, 0 AS taxes FROM lineitem GROUP BY 1",
    Title="s", line_count="i", amounts="i", nets="i", taxes="i")
add("clean_text", "SELECT c_custkey, substr(replace(c_name, '#', ' #'), 1, 15) AS name, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS segment FROM customer",
    c_custkey="i", name="s", segment="s")
_ITEMS = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
add("parse_currency", f"SELECT {BANK_KEY} AS id, {cents('l_extendedprice')} AS item_total, {cents('p_retailprice')} AS price, -{cents('l_extendedprice')} AS negative, 0 AS blank {_ITEMS}",
    id="i", item_total="m", price="m", negative="m", blank="m")
add("parse_date", f"SELECT {BANK_KEY} AS id, CAST(o_orderdate AS DATE) AS sale_date, CASE WHEN l_linestatus <> 'O' THEN CAST(l_shipdate AS DATE) END AS ship_date, NULL AS wrong_format {_ITEMS}",
    id="i", sale_date="d", ship_date="d", wrong_format="d")


def usd(c: str, vnd: str, scale: int = 1) -> str:
    """Cents of a text amount, converted where ``vnd`` holds."""
    return f"(CASE WHEN {vnd} THEN {rdiv(f'({c}) * {1000 * scale}', '24708655')} ELSE ({c}) END)"


_VND = "l_suppkey % 3 = 0"
add("vnd_to_usd", f"SELECT {BANK_KEY} AS id, {usd(cents('l_extendedprice'), _VND)} AS usd, {usd(cents('l_extendedprice'), _VND, 100)} AS usd_from_hundredths FROM lineitem",
    id="i", usd="m", usd_from_hundredths="m")
add("clean_statement_currency", f"""WITH n AS (SELECT coalesce({LINE_AMOUNT}, {LINE_FEE}) AS c FROM lineitem)
  SELECT CASE WHEN c < 0 THEN '-' ELSE '' END || CAST(CAST(abs(c) AS BIGINT) // 100 AS VARCHAR) || '.' || lpad(CAST(abs(c) % 100 AS VARCHAR), 2, '0') AS net, count(*) AS line_count FROM n GROUP BY 1""", net="s", line_count="i")
_ID_KIND = f"CASE WHEN {NAMES_ORDER} THEN 'order_id' WHEN l_linenumber = 6 THEN 'listing_id' ELSE 'transaction_id' END"
_ID = f"CASE WHEN {NAMES_ORDER} THEN l_orderkey ELSE l_partkey END"
add("extract_id_from_info", f"SELECT {BANK_KEY} AS id, {_ID} AS extracted_id, {_ID_KIND} AS id_type, {LINE_INFO} AS info_description FROM lineitem",
    id="i", extracted_id="s", id_type="s", info_description="s")
_REVENUE = "CASE " + " ".join(f"WHEN regexp_matches(t, '{'|'.join(words)}') THEN '{label}'" for label, words in K.REVENUE_WORDS) + " WHEN t IS NULL THEN 'Unknown' ELSE 'Other' END"
_FEE_FAMILY = "CASE " + " ".join(f"WHEN contains(t, '{word}') THEN '{label}'" for label, word in K.FEE_WORDS) + " END"
add("categorize_types", f"""WITH e AS (SELECT event_id, CASE WHEN event_type <> 'view' THEN lower({names_case(f'user_id % {len(TYPE_WORDS)} + 1', TYPE_WORDS)} || ' ' || event_type) END AS t FROM events)
  SELECT event_id, {_REVENUE} AS revenue_type, {_FEE_FAMILY} AS fee_type FROM e""", event_id="i", revenue_type="s", fee_type="s")
_STATEMENT = f"""SELECT CASE WHEN l_quantity <> 50 THEN CAST(l_shipdate AS DATE) END AS date, {LINE_TYPE} AS type, {LINE_TITLE} AS title, {LINE_INFO} AS info, 'USD' AS currency,
  {usd(LINE_AMOUNT, _VND)} AS amount, {usd(LINE_FEE, _VND)} AS fees_taxes, {usd(f'coalesce({LINE_AMOUNT}, {LINE_FEE})', _VND)} AS net, NULL AS tax_details,
  CASE l_linenumber WHEN 1 THEN 'Sale' WHEN 2 THEN 'Fee' WHEN 3 THEN 'Fee' WHEN 4 THEN 'Fee' WHEN 5 THEN 'Other' WHEN 6 THEN 'Other' ELSE 'Refund' END AS revenue_type, NULL AS fee_type,
  CAST({_ID} AS VARCHAR) AS extracted_id, {_ID_KIND} AS id_type, {LINE_INFO} AS info_description, l_orderkey FROM lineitem"""
add("clean_statement", _STATEMENT, date="d", type="s", title="s", info="s", currency="s", amount="m", fees_taxes="m", net="m", tax_details="m", revenue_type="s", fee_type="s", extracted_id="s", id_type="s", info_description="s")
_METHOD = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Credit card online' WHEN '2' THEN 'PayPal' WHEN '3' THEN 'Inperson cash' WHEN '4' THEN NULL ELSE 'Credit card' END"
_SHIP = f"c_mktsegment AS ship_city, CASE WHEN c_nationkey % 5 <> 0 THEN n_name END AS ship_state, lpad(CAST(c_custkey % 90 AS VARCHAR), 5, '0') AS ship_zipcode, {COUNTRY} AS ship_country"
_SHIP_COLUMNS = dict.fromkeys(["ship_city", "ship_state", "ship_zipcode", "ship_country"], "s")
_ORDERS = "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_VALUE = cents("o_totalprice")
SOLD_ORDERS = f"""SELECT CAST(o_orderdate AS DATE) AS sale_date, o_orderkey AS order_id, replace(c_name, '#', ' ') AS full_name, 'Customer' AS first_name, split_part(c_name, '#', 2) AS last_name,
  200 AS number_of_items, {_METHOD} AS payment_method, CAST(o_orderdate AS DATE) + 3 AS date_shipped, o_custkey || ' Main St' AS street_1, NULL AS street_2, {_SHIP}, 'USD' AS currency,
  {_VALUE} AS order_value, CASE o_orderkey % 4 WHEN 0 THEN 'SAVE10%' WHEN 1 THEN 'FLAT5' END AS coupon_code, CASE o_orderkey % 4 WHEN 0 THEN 1000 WHEN 1 THEN -500 ELSE 0 END AS discount_amount,
  '1.50' AS shipping, {_VALUE} AS order_total, CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Shipped' ELSE 'On hold' END AS order_status,
  {rdiv(f'(({_VALUE} * 2 + 10) // 20) * 100000', '24708655')} AS card_processing_fees, {rdiv(f'{_VALUE} * 100000', '24708655')} AS order_net, 'online' AS order_type, 'online_cc' AS payment_type,
  'MG' || o_custkey || '|MG' || o_orderkey AS sku, o_custkey, year(o_orderdate) AS y, o_orderstatus {_ORDERS}"""
add("clean_sold_orders", SOLD_ORDERS, sale_date="d", order_id="s", full_name="s", first_name="s", last_name="s", number_of_items="m", payment_method="s", date_shipped="d", street_1="s", street_2="s",
    **_SHIP_COLUMNS, currency="s", order_value="m", coupon_code="s", discount_amount="m", shipping="s", order_total="m", order_status="s", card_processing_fees="m", order_net="m", order_type="s", payment_type="s", sku="s")
ITEMS = f"""SELECT {BANK_KEY} AS transaction_id, CAST(o_orderdate AS DATE) AS sale_date, CAST(o_orderdate AS DATE) AS date_paid, CASE WHEN l_linestatus <> 'O' THEN CAST(l_shipdate AS DATE) END AS date_shipped,
  p_name || ' ' || p_type || ' no ' || p_partkey AS item_name, CAST(l_quantity AS BIGINT) AS quantity, {cents('p_retailprice')} AS price_c, {cents('l_extendedprice')} AS total_c,
  l_partkey || CASE WHEN l_linenumber = 1 THEN '.0' ELSE '' END AS listing_text, l_partkey, l_orderkey, CASE WHEN l_linenumber <> 2 THEN 'online_cc' END AS payment_type, {_SHIP}, c_nationkey,
  (2 * {cents('l_extendedprice')} * {cents('l_discount')} + 100) // 200 AS disc_c, p_size, split_part(p_name, ' ', 1) AS color, o_custkey, year(o_orderdate) AS y, 'MG' || l_partkey AS sku,
  'Size: ' || p_size || ', Primary colour: ' || split_part(p_name, ' ', 1) || '; note' AS variations {_ITEMS}"""
add("clean_sold_order_items", f"WITH items AS ({ITEMS}) SELECT *, quantity * 100 AS q, price_c AS price, total_c AS item_total, listing_text AS listing_id, p_size AS size, NULL AS style, NULL AS material, NULL AS personalization FROM items".replace("SELECT *, quantity * 100 AS q", "SELECT * REPLACE (quantity * 100 AS quantity)"),
    transaction_id="s", sale_date="d", date_paid="d", date_shipped="d", item_name="s", quantity="m", price="m", item_total="m", listing_id="s", payment_type="s", ship_state="s", size="s", style="s", color="s", material="s", personalization="s")
add("extract_variations", f"WITH items AS ({ITEMS}) SELECT transaction_id AS id, quantity AS size, 'a:b' AS style, color, sku AS material FROM items", id="i", size="s", style="s", color="s", material="s")
_PAID = "o_orderkey % 3 = 0"
_FEE3 = f"(({_VALUE} * 3 * 2 + 100) // 200)"
CHECKOUT = f"""SELECT o_orderkey + 1000000 AS payment_id, 'buyer' || o_custkey || '_' || year(o_orderdate) AS buyer_username, 'Buyer ' || o_custkey AS buyer_name, o_orderkey AS order_id,
  {usd(_VALUE, _PAID, 100)} AS gross_amount, {usd(_FEE3, _PAID, 100)} AS fees, {usd(f'{_VALUE} - {_FEE3}', _PAID, 100)} AS net_amount, 0 AS posted_gross, 'USD' AS currency, ' usd ' AS listing_currency,
  '1.25' AS exchange_rate, NULL AS vat_amount, o_orderstatus AS status, CAST(o_orderdate AS DATE) AS order_date, 'Ship ' || o_custkey AS buyer, CASE WHEN o_orderstatus = 'P' THEN 'inperson' ELSE 'online_cc' END AS payment_type FROM orders"""
add("clean_direct_checkout", CHECKOUT, payment_id="s", buyer_username="s", buyer_name="s", order_id="s", gross_amount="m", fees="m", net_amount="m", posted_gross="m", currency="s", listing_currency="s",
    exchange_rate="s", vat_amount="s", status="s", order_date="d", buyer="s", payment_type="s")
DEPOSITS = f"SELECT CAST(o_orderdate AS DATE) AS date, {usd(_VALUE, _PAID)} AS amount, 'USD' AS currency, o_orderstatus AS status, lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS bank_account_ending_digits FROM orders"
add("clean_deposits", DEPOSITS, date="d", amount="m", currency="s", status="s", bank_account_ending_digits="s")
_COLOR = "split_part(p_name, ' ', 1)"
_LISTING_PARTS = f"""'A fine ' || p_name AS story, p_type || ' yarn' AS material, p_size || ' cm' AS dimensions, {_COLOR} AS color, 'by ' || p_brand AS how_made, '' AS package, '' AS instructions, '' AS how_use, '' AS fit_for, '' AS note"""
_LISTING_CLEAN = f"'A fine ' || p_name || chr(10) || '- Material: ' || p_type || ' yarn' || chr(10) || 'and cotton' || chr(10) || '- Dimension: ' || p_size || ' cm' || chr(10) || '- Color: ' || {_COLOR} || chr(10) || 'How it was made: by ' || p_brand"
_LISTING_RAW = f"'  A fine ' || p_name || chr(10) || '   ' || chr(10) || 'Thank you. Come again' || chr(10) || '- Material: ' || p_type || ' yarn' || chr(10) || '  and cotton' || chr(10) || '- Dimension: ' || p_size || ' cm' || chr(10) || '- Color: ' || {_COLOR} || chr(10) || 'How it was made: by ' || p_brand || chr(10) || 'Proudly made in Vietnam.'"
_PARTS_COLUMNS = dict.fromkeys(["story", "material", "dimensions", "color", "how_made", "package", "instructions", "how_use", "fit_for", "note"], "s")
_MATERIALS_RAW = """CASE WHEN p_size > 25 THEN '["' || p_type || '", " wool "]' END"""
_RETAIL_TEXT = f"({cents('p_retailprice')} // 100) || '.' || lpad(CAST({cents('p_retailprice')} % 100 AS VARCHAR), 2, '0')"
add("clean_listing", f"""SELECT ' ' || upper(p_name || ' ' || p_type || ' no ' || p_partkey) AS title, {_LISTING_RAW} AS description, {_RETAIL_TEXT} AS price, 'USD' AS currency_code, p_size AS quantity,
  p_brand || ',gift, ,' || p_type AS tags, {_MATERIALS_RAW} AS materials, 'https://img.example/' || p_partkey AS image1, 'MG' || p_partkey AS sku, p_brand || '|gift| |' || p_type AS tags_list,
  CASE WHEN p_size > 25 THEN '["' || p_type || '"| " wool "]' ELSE '' END AS materials_list, {_LISTING_CLEAN} AS description_clean, {_LISTING_PARTS}, 'Vietnam' AS country_origin FROM part""",
    title="s", description="s", price="s", currency_code="s", quantity="s", tags="s", materials="s", image1="s", sku="s", tags_list="s", materials_list="s", description_clean="s", **_PARTS_COLUMNS, country_origin="s")
add("parse_listing_description", f"SELECT 'MG' || p_partkey AS sku, {_LISTING_PARTS}, 'Vietnam' AS country FROM part", sku="s", **_PARTS_COLUMNS, country="s")
_PHRASES = " AND ".join(f"NOT contains(l, {_quote(p)})" for p in K.DESCRIPTION_BOILERPLATE)
_WS = "[\\s\\x0B\\x1C-\\x1F\\x{85}\\p{Z}]"
add("clean_description", f"""WITH t AS (SELECT doc_id, list_transform(string_split('If you need any else, ask' || chr(10) || ' ' || text || chr(10) || chr(10) || ' Made In Viet Nam', chr(10)),
    lambda l: regexp_replace(l, '^{_WS}+|{_WS}+$', '', 'g')) AS ls FROM documents)
  SELECT doc_id, md5(array_to_string(list_filter(ls, lambda l: l <> '' AND {_PHRASES}), chr(10))) AS digest FROM t""", doc_id="i", digest="s")

BANK_ROWS = f"""SELECT CAST(l_shipdate AS DATE) AS transaction_date, 'R' || {BANK_KEY} AS reference_number, CASE WHEN l_suppkey % 10 <> 9 THEN 'S' || l_suppkey END AS account_number,
  CASE WHEN l_suppkey % 2 = 0 THEN 'Acc ' || l_suppkey WHEN l_suppkey % 10 <> 9 THEN 'S' || l_suppkey END AS account_name, DATE '2020-02-01' AS opening_date, {CREDIT} AS credit_amount, {DEBIT} AS debit_amount,
  {cents('l_extendedprice')} AS balance_after_transaction, {DESCRIPTION} AS transaction_description, nullif({ACCOUNT_CODE}, '9999') AS pl_account_number, upper(p_type) AS parsed_product_line_id,
  'MG' || l_partkey AS parsed_product_id, {VARIANT} AS parsed_variant_id, true AS is_business_related, p_name, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey"""
_BANK_ROW_COLUMNS = {
    "transaction_date": "d", "reference_number": "s", "account_number": "s", "account_name": "s", "opening_date": "d", "credit_amount": "m", "debit_amount": "m", "balance_after_transaction": "m",
    "transaction_description": "s", "pl_account_number": "s", "parsed_product_line_id": "s", "parsed_product_id": "s", "parsed_variant_id": "s", "is_business_related": "b",
}
for _query in ("clean_bank_transactions", "header_row_detection"):
    add(_query, f"WITH r AS ({BANK_ROWS}) SELECT * FROM r WHERE account_number IS NOT NULL", **_BANK_ROW_COLUMNS)
add("rejected_bank_rows", f"WITH r AS ({BANK_ROWS}) SELECT reference_number, balance_after_transaction, 'missing account_number' AS message FROM r WHERE account_number IS NULL",
    reference_number="s", balance_after_transaction="m", message="s")
add("bank_parse_stats", f"WITH r AS ({BANK_ROWS}) SELECT count(*) AS row_count, count(*) FILTER (l_linenumber % 2 = 1) AS parsed_rows, {rdiv('count(*) FILTER (l_linenumber % 2 = 1) * 1000', 'count(*)')} AS parsed_percent FROM r WHERE account_number IS NOT NULL",
    row_count="i", parsed_rows="i", parsed_percent="f1")
add("parse_bank_description", f"SELECT {BANK_KEY} AS id, nullif({ACCOUNT_CODE}, '9999') AS pl_account_number, upper(p_type) AS parsed_product_line_id, 'MG' || l_partkey AS parsed_product_id, {VARIANT} AS parsed_variant_id FROM lineitem JOIN part ON l_partkey = p_partkey",
    id="i", pl_account_number="s", parsed_product_line_id="s", parsed_product_id="s", parsed_variant_id="s")
add("simple_token_ids", "SELECT p_partkey, NULL AS pl_account_number, 'A-' || p_type AS parsed_product_line_id, 'B-' || p_partkey AS parsed_product_id, 'C-' AS parsed_variant_id FROM part",
    p_partkey="i", pl_account_number="s", parsed_product_line_id="s", parsed_product_id="s", parsed_variant_id="s")
RAW_CATALOG = """SELECT upper(p_type) AS product_line_id, p_type || ' line' AS product_line_name, 'MG' || p_partkey AS product_id, p_name AS product_name, '0' || v AS variant_id, 'Variant 0' || v AS variant_name,
  upper(p_type) || '_MG' || p_partkey || '_0' || v AS product_code, p_partkey, v FROM part, (VALUES (1), (2)) t(v)"""
_RAW_CATALOG_COLUMNS = dict.fromkeys(["product_line_id", "product_line_name", "product_id", "product_name", "variant_id", "variant_name"], "s")
add("clean_product_catalog", RAW_CATALOG, **_RAW_CATALOG_COLUMNS)
add("parse_list", "SELECT 'MG' || p_partkey AS sku, p_brand || '|gift|' || p_type AS tags, CASE WHEN p_size > 25 THEN p_type || '|wool' ELSE '' END AS materials FROM part", sku="s", tags="s", materials="s")
add("sku_to_list", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'A|' || p_type WHEN p_size > 10 THEN p_type || ',B' ELSE '' END AS skus FROM part", p_partkey="i", skus="s")
add("null_strings", f"SELECT s_suppkey AS supplier_key, CASE WHEN s_nationkey >= 10 THEN s_name END AS name, CASE WHEN s_nationkey >= 15 THEN {cents('s_acctbal')} END AS price FROM supplier", supplier_key="i", name="s", price="m")
_N = {t: f"(SELECT count(*) FROM {t})" for t in ("lineitem", "orders", "part", "supplier")}
_KEPT_BANK = "(SELECT count(*) FROM lineitem WHERE l_suppkey % 10 <> 9)"
_CLEANED = [("statement", _N["lineitem"], 14), ("direct_checkout", _N["orders"], 16), ("listing", _N["part"], 23), ("sold_order_items", _N["lineitem"], 24),
            ("sold_orders", _N["orders"], 26), ("deposits", _N["orders"], 5), ("bank_transactions", _KEPT_BANK, 14), ("product_catalog", f"2 * {_N['part']}", 6)]
add("clean_all", " UNION ALL ".join(f"SELECT '{k}' AS dataset, {n} AS row_count, {c} AS column_count" for k, n, c in _CLEANED), dataset="s", row_count="i", column_count="i")

# ---- dimensions ---------------------------------------------------------------------------------------------------

_SEASON = "CASE month(d) " + " ".join(f"WHEN {m} THEN '{s}'" for m, s in K.RETAIL_SEASONS.items()) + " END"
_SELLING = "CASE " + " ".join(f"WHEN month(d) IN {months} THEN '{s}'" for s, months in K.SELLING_SEASONS) + " ELSE 'Regular' END"
add("dim_time", f"""WITH days AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem)
  SELECT {key('d')} AS time_key, d AS full_date, year(d) AS year, quarter(d) AS quarter, month(d) AS month, weekofyear(d) AS week_of_year, day(d) AS day_of_month, isodow(d) AS day_of_week, dayofyear(d) AS day_of_year,
  monthname(d) AS month_name, dayname(d) AS day_name, 'Q' || quarter(d) AS quarter_name, isodow(d) > 5 AS is_weekend, false AS is_holiday, isodow(d) < 6 AS is_business_day, {_SEASON} AS retail_season,
  month(d) IN {K.PEAK_MONTHS} AS is_peak_season, {_SELLING} AS selling_season, d = DATE '1998-06-17' AS is_current_day, d BETWEEN DATE '1998-06-15' AND DATE '1998-06-21' AS is_current_week,
  year(d) = 1998 AND month(d) = 6 AS is_current_month, year(d) = 1998 AND quarter(d) = 2 AS is_current_quarter, year(d) = 1998 AS is_current_year FROM days""",
    time_key="i", full_date="d", year="i", quarter="i", month="i", week_of_year="i", day_of_month="i", day_of_week="i", day_of_year="i", month_name="s", day_name="s", quarter_name="s", is_weekend="b", is_holiday="b",
    is_business_day="b", retail_season="s", is_peak_season="b", selling_season="s", is_current_day="b", is_current_week="b", is_current_month="b", is_current_quarter="b", is_current_year="b")
add("seasons", f"WITH x AS (SELECT month(o_orderdate) AS month, any_value(o_orderdate) AS d, count(*) AS orders FROM orders GROUP BY 1) SELECT month, orders, {_SEASON} AS retail_season, {_SELLING} AS selling_season, month IN {K.PEAK_MONTHS} AS is_peak_season FROM x",
    month="i", orders="i", retail_season="s", selling_season="s", is_peak_season="b")


def lookup(table, column: str) -> str:
    values, default = table
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + f" ELSE '{default}' END"


def country_attributes(c: str) -> str:
    zone = f"CASE WHEN {c} = 'United States' THEN 'Domestic' ELSE 'International' END"
    return (
        f"{lookup(K.CONTINENTS, c)} AS continent, {lookup(K.REGIONS, c)} AS region, {lookup(K.MARKETS, c)} AS market, {zone} AS shipping_zone,"
        f" {lookup(K.CURRENCIES, c)} AS currency_code, {lookup(K.TIME_ZONES, c)} AS timezone"
    )


_COUNTRY_COLUMNS = dict.fromkeys(["continent", "region", "market", "shipping_zone", "currency_code", "timezone"], "s")
add("country_lookup", f"WITH x AS (SELECT {COUNTRY} AS country, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1) SELECT country, customers, {country_attributes('country')} FROM x",
    country="s", customers="i", **_COUNTRY_COLUMNS)


def numbered(business: str, start: str = "0") -> str:
    """Dense keys in (md5 prefix, business key) order."""
    return f"{start} + row_number() OVER (ORDER BY substr(md5(CAST({business} AS VARCHAR)), 1, 3), {business})"


def geo_hash(country: str, state: str, city: str) -> str:
    return f"substr(md5({country} || '|' || {state} || '|' || {city}), 1, 16)"


GEO = f"""geo AS (SELECT ship_country AS country_name, ship_state AS state_name, ship_city AS city_name, min(ship_zipcode) AS postal_code, {geo_hash('ship_country', "coalesce(ship_state, 'nan')", 'ship_city')} AS location_hash
    FROM sold GROUP BY 1, 2, 3),
  dim_geography AS (SELECT {numbered('location_hash')} AS geography_key, *, {country_attributes('country_name')} FROM geo)"""
SOLD = f"sold AS ({SOLD_ORDERS}), paid AS ({CHECKOUT})"
_GEO_COLUMNS = {"geography_key": "i"} | dict.fromkeys(["country_name", "state_name", "city_name", "postal_code", "location_hash"], "s")
add("dim_geography", f"WITH {SOLD}, {GEO} SELECT * FROM dim_geography", **_GEO_COLUMNS, **_COUNTRY_COLUMNS)
_FIRST = ", ".join(f"arg_min({c}, order_id) FILTER (WHERE {c} IS NOT NULL) AS {n}" for c, n in (
    ("full_name", "full_name"), ("first_name", "first_name"), ("last_name", "last_name"), ("ship_country", "country"), ("ship_state", "state"), ("ship_city", "city"), ("ship_zipcode", "zipcode"),
    ("sold.payment_method", "payment_method"), ("date_shipped", "ship_date"), ("street_1", "street_1"), ("buyer", "ship_name")))
CUSTOMERS = f"""buyers AS (SELECT buyer_username AS buyer_user_name, {_FIRST} FROM paid LEFT JOIN sold USING (order_id) GROUP BY 1),
  dim_customer AS (SELECT {numbered('buyer_user_name')} AS customer_key, *, NULL AS street_2, '2262-04-11 00:00:00' AS expiry_date, true AS is_current FROM buyers)"""
add("dim_customer", f"WITH {SOLD}, {CUSTOMERS} SELECT * FROM dim_customer", customer_key="i", **dict.fromkeys(["buyer_user_name", "full_name", "first_name", "last_name", "country", "state", "city", "zipcode", "payment_method"], "s"),
    ship_date="d", street_1="s", street_2="s", ship_name="s", expiry_date="s", is_current="b")
ORDERS = f"dim_order AS (SELECT {numbered('order_id')} AS order_key, * FROM sold)"
_NULL_MONEY = ["shipping_discount", "sales_tax", "adjusted_order_total", "adjusted_card_processing_fees", "adjusted_net_order_amount"]
add("dim_order", f"""WITH {SOLD}, {ORDERS} SELECT * REPLACE (2 AS number_of_items, 150 AS shipping), {', '.join(f'NULL AS {c}' for c in _NULL_MONEY)}, NULL AS coupon_details, NULL AS shipping_method, ship_country AS shipping_country,
  ship_state AS shipping_state, ship_city AS shipping_city, discount_amount > 0 AS has_discount, CASE WHEN coupon_code LIKE '%\\%%' ESCAPE '\\' THEN 'Percentage' WHEN coupon_code IS NOT NULL THEN 'Fixed' END AS discount_type,
  ship_country <> 'United States' AS is_international, false AS is_gift, false AS has_personalization, NULL AS in_person_location FROM dim_order""",
    order_key="i", order_id="i", order_type="s", payment_method="s", payment_type="s", number_of_items="i", order_value="m", discount_amount="m", shipping="m", order_total="m", card_processing_fees="m", order_net="m",
    **dict.fromkeys(_NULL_MONEY, "m"), coupon_code="s", coupon_details="s", has_discount="b", discount_type="s", shipping_method="s", shipping_country="s", shipping_state="s", shipping_city="s", is_international="b",
    is_gift="b", has_personalization="b", in_person_location="s")
PAYMENTS = f"""methods AS (SELECT payment_method FROM sold WHERE payment_method IS NOT NULL UNION SELECT payment_type FROM paid),
  dim_payment AS (SELECT {numbered('payment_method')} AS payment_key, payment_method, CASE WHEN payment_method ILIKE '%online%' THEN 'Online' WHEN payment_method ILIKE '%inperson%' THEN 'In-person' ELSE 'Online' END AS payment_type,
    CASE WHEN payment_method ILIKE '%credit%' THEN 'Etsy Payments' WHEN payment_method ILIKE '%paypal%' THEN 'PayPal' ELSE 'Other' END AS payment_provider FROM methods)"""
add("dim_payment", f"WITH {SOLD}, {PAYMENTS} SELECT * FROM dim_payment", payment_key="i", payment_method="s", payment_type="s", payment_provider="s")
_SOLD_PART = "p_partkey IN (SELECT l_partkey FROM lineitem)"
_PRODUCT_KEY = f"CASE WHEN {_SOLD_PART} THEN lpad(CAST(p_partkey AS VARCHAR), 19, '0') ELSE 't:' || lower(p_name || ' ' || p_type || ' no ' || p_partkey) END"
PRODUCTS = f"""listed AS (SELECT *, {_PRODUCT_KEY} AS k, CASE WHEN {_SOLD_PART} THEN p_partkey END AS listing_id FROM part), dim_product AS (SELECT {numbered('k')} AS product_key, * FROM listed)"""
_NO_VARIATION = [f"variation_{i}_{w}" for i in (1, 2) for w in ("type", "name", "values")]
_SECTIONS = {c: k for c, k in _PARTS_COLUMNS.items() if c not in ("package", "note")}
add("dim_product", f"""WITH {PRODUCTS} SELECT product_key, listing_id, upper(p_name || ' ' || p_type || ' no ' || p_partkey) AS title, replace(replace(replace({_LISTING_RAW}, chr(10) || '   ' || chr(10), ' '), chr(10), ' '), '   ', ' ') AS d0,
  regexp_replace(trim({_LISTING_RAW}), '\\s+', ' ', 'g') AS description, {cents('p_retailprice')} AS price, 'USD' AS currency_code, p_size AS quantity, CASE WHEN p_size > 25 THEN p_type || '|wool' ELSE '' END AS materials_list,
  p_brand || '|gift|' || p_type AS tags_list, {_LISTING_PARTS}, 'Vietnam' AS country_origin, {', '.join(f'NULL AS {c}' for c in _NO_VARIATION)}, 'https://img.example/' || p_partkey AS image_urls,
  'https://img.example/' || p_partkey AS primary_image_url, 'MG' || p_partkey AS sku_list, 0 AS completeness_score, '2262-04-11 00:00:00' AS expiry_date, true AS is_current FROM dim_product""",
    product_key="i", listing_id="i", title="s", description="s", price="m", currency_code="s", quantity="i", materials_list="s", tags_list="s", **_SECTIONS, country_origin="s", **dict.fromkeys(_NO_VARIATION, "s"),
    image_urls="s", primary_image_url="s", sku_list="s", completeness_score="m", expiry_date="s", is_current="b")
DERIVED = f"""rows AS ({BANK_ROWS}), derived AS (SELECT account_number, min(account_name) AS account_name, NULL AS customer_address, 'VND' AS currency_code, min(opening_date) AS opening_date FROM rows WHERE account_number IS NOT NULL GROUP BY 1)"""
add("derive_bank_accounts", f"WITH {DERIVED} SELECT * FROM derived", account_number="s", account_name="s", customer_address="s", currency_code="s", opening_date="d")
DIM_ACCOUNTS = f"{DERIVED}, dim_bank_account AS (SELECT {numbered('account_number')} AS bank_account_key, *, NULL AS cif_number, true AS is_active FROM derived)"
add("dim_bank_account", f"WITH {DIM_ACCOUNTS} SELECT * FROM dim_bank_account", bank_account_key="i", account_number="s", account_name="s", opening_date="d", cif_number="s", customer_address="s", is_active="b", currency_code="s")
_NATURAL = """'["' || product_line_id || '","' || product_id || '","' || variant_id || '"]'"""
DIM_CATALOG = f"raw_catalog AS ({RAW_CATALOG}), dim_product_catalog AS (SELECT {numbered('n')} AS product_catalog_key, * FROM (SELECT *, {_NATURAL} AS n FROM raw_catalog) x)"
add("dim_product_catalog", f"WITH {DIM_CATALOG} SELECT * FROM dim_product_catalog", product_catalog_key="i", **_RAW_CATALOG_COLUMNS, product_code="s")
add("surrogate_keys", f"SELECT {numbered('o_orderkey')} AS order_key, o_orderkey FROM orders", order_key="i", o_orderkey="i")
add("scd_columns", "SELECT c_custkey, '2262-04-11 00:00:00' AS expiry_date, true AS is_current, true AS in_effect FROM customer", c_custkey="i", expiry_date="s", is_current="b", in_effect="b")

# ---- facts --------------------------------------------------------------------------------------------------------

_KEYS = f"{SOLD}, {CUSTOMERS}, {ORDERS}, {PAYMENTS}, {GEO}, {PRODUCTS}"
add("fact_sales", f"""WITH {_KEYS}, items AS ({ITEMS}) SELECT transaction_id, l_orderkey AS order_id, {key('items.sale_date')} AS sale_date_key, {key('items.date_shipped')} AS ship_date_key, {key('date_paid')} AS paid_date_key, items.sku,
  quantity AS quantity_sold, price_c AS item_price, total_c AS item_total, disc_c AS discount_amount, 350 AS shipping_amount, NULL AS shipping_discount, NULL AS order_sales_tax, items.sale_date AS conversion_date, variations,
  items.p_size AS size, NULL AS style, items.color, NULL AS material, NULL AS personalization, NULL AS vat_paid_by_buyer, order_key, customer_key, product_key, geography_key, payment_key, 'sold_order_items' AS data_source
  FROM items LEFT JOIN dim_order o ON o.order_id = l_orderkey LEFT JOIN dim_customer ON buyer_user_name = 'buyer' || items.o_custkey || '_' || items.y LEFT JOIN dim_product ON listing_id = l_partkey
  LEFT JOIN dim_geography g ON g.location_hash = {geo_hash('items.ship_country', 'items.ship_state', 'items.ship_city')} LEFT JOIN dim_payment m ON m.payment_method = items.payment_type""",
    transaction_id="i", order_id="i", sale_date_key="i", ship_date_key="i", paid_date_key="i", sku="s", quantity_sold="i", item_price="m", item_total="m", discount_amount="m", shipping_amount="m", shipping_discount="m",
    order_sales_tax="m", conversion_date="d", variations="s", size="s", style="s", color="s", material="s", personalization="s", vat_paid_by_buyer="m", order_key="i", customer_key="i", product_key="i", geography_key="i", payment_key="i", data_source="s")
add("fact_financial", f"""WITH {_KEYS}, st AS ({_STATEMENT}), f AS (SELECT *, CASE WHEN id_type = 'order_id' THEN l_orderkey END AS oid FROM st),
  firsts AS (SELECT l_orderkey AS oid, min(l_partkey) AS part FROM lineitem GROUP BY 1)
  SELECT {key('f.date')} AS transaction_date_key, extracted_id, oid AS order_id, CASE WHEN id_type = 'transaction_id' THEN extracted_id END AS transaction_id, f.type AS transaction_type, f.title AS transaction_title, revenue_type,
  NULL AS fee_type, id_type, info_description, amount, fees_taxes AS fees_and_taxes, net, NULL AS tax_details, info AS original_info, order_key, customer_key, product_key, 'statement' AS data_source
  FROM f LEFT JOIN dim_order o ON o.order_id = oid LEFT JOIN paid p ON p.order_id = oid LEFT JOIN dim_customer ON buyer_user_name = buyer_username LEFT JOIN firsts USING (oid) LEFT JOIN dim_product ON listing_id = firsts.part""",
    transaction_date_key="i", extracted_id="s", order_id="i", transaction_id="i", transaction_type="s", transaction_title="s", revenue_type="s", fee_type="s", id_type="s", info_description="s", amount="m", fees_and_taxes="m", net="m",
    tax_details="m", original_info="s", order_key="i", customer_key="i", product_key="i", data_source="s")
add("fact_deposits", f"WITH x AS ({DEPOSITS}) SELECT {key('date')} AS deposit_date_key, amount AS deposit_amount, status AS deposit_status, CAST(bank_account_ending_digits AS INTEGER) AS bank_account_ending_digits, 'deposits' AS data_source FROM x",
    deposit_date_key="i", deposit_amount="m", deposit_status="s", bank_account_ending_digits="i", data_source="s")
add("fact_payments", f"""WITH {_KEYS} SELECT payment_id, paid.order_id, {key('order_date')} AS payment_date_key, order_key, customer_key, payment_key AS payment_method_key, gross_amount, fees, net_amount, posted_gross, NULL AS adjusted_net,
  NULL AS vat_amount, paid.currency, 'USD' AS listing_currency, 125000000 AS exchange_rate, order_date, buyer, status, paid.payment_type, 'direct_checkout' AS data_source
  FROM paid LEFT JOIN dim_order o ON o.order_id = paid.order_id LEFT JOIN dim_customer ON buyer_user_name = buyer_username LEFT JOIN dim_payment m ON m.payment_method = paid.payment_type""",
    payment_id="i", order_id="i", payment_date_key="i", order_key="i", customer_key="i", payment_method_key="i", gross_amount="m", fees="m", net_amount="m", posted_gross="m", adjusted_net="m", vat_amount="m", currency="s",
    listing_currency="s", exchange_rate="f8", order_date="d", buyer="s", status="s", payment_type="s", data_source="s")
_FACT_BANK = f"""{DIM_ACCOUNTS}, {DIM_CATALOG}, fact AS (SELECT {key('transaction_date')} AS transaction_date_key, reference_number, rows.account_number, transaction_description, pl_account_number, parsed_product_line_id, parsed_product_id,
  parsed_variant_id, credit_amount, debit_amount, balance_after_transaction, is_business_related, bank_account_key, product_catalog_key, 'bank_statement' AS data_source
  FROM rows LEFT JOIN dim_bank_account a ON a.account_number = rows.account_number LEFT JOIN dim_product_catalog c ON c.product_line_id = parsed_product_line_id AND c.product_id = parsed_product_id AND c.variant_id = parsed_variant_id
  WHERE rows.account_number IS NOT NULL)"""
add("fact_bank", f"WITH {_FACT_BANK} SELECT * FROM fact", transaction_date_key="i", reference_number="s", account_number="s", transaction_description="s", pl_account_number="s", parsed_product_line_id="s", parsed_product_id="s",
    parsed_variant_id="s", credit_amount="m", debit_amount="m", balance_after_transaction="m", is_business_related="b", bank_account_key="i", product_catalog_key="i", data_source="s")
_HITS = {"business": "is_business_related", "account": "bank_account_key IS NOT NULL", "product": "product_catalog_key IS NOT NULL", "parsed": "parsed_product_line_id IS NOT NULL"}
add("bank_match_stats", f"WITH {_FACT_BANK} SELECT count(*) AS row_count, " + ", ".join(f"count(*) FILTER ({t}) AS {n}_rows, {rdiv(f'count(*) FILTER ({t}) * 1000', 'count(*)')} AS {n}_percent" for n, t in _HITS.items()) + " FROM fact",
    row_count="i", **{f"{n}_rows": "i" for n in _HITS}, **{f"{n}_percent": "f1" for n in _HITS})
_STAR = {
    "dim_time": "(SELECT date_diff('day', DATE '1995-01-01', DATE '2002-12-31') + 1)", "dim_product": _N["part"], "dim_customer": "(SELECT count(*) FROM dim_customer)", "dim_order": _N["orders"],
    "dim_geography": "(SELECT count(*) FROM dim_geography)", "dim_payment": "(SELECT count(*) FROM dim_payment)", "dim_bank_account": "(SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_suppkey % 10 <> 9)",
    "dim_product_catalog": f"2 * {_N['part']}", "fact_sales": _N["lineitem"], "fact_financial_transactions": _N["lineitem"], "fact_deposits": _N["orders"], "fact_payments": _N["orders"], "fact_bank_transactions": _KEPT_BANK,
}
add("build_star", f"WITH {_KEYS} " + " UNION ALL ".join(f"SELECT '{t}' AS star_table, {n} AS row_count" for t, n in _STAR.items()), star_table="s", row_count="i")

# ---- sources, sinks, merges, deletes ------------------------------------------------------------------------------

_TEXT = f"""SELECT o_orderkey AS "Order ID", CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS "Sale Date", ({_VALUE} // 100) || '.' || lpad(CAST({_VALUE} % 100 AS VARCHAR), 2, '0') AS "Order Value",
  'say "' || o_orderpriority || '",' || chr(10) || 'next line' AS "Note" FROM orders"""
_TEXT_COLUMNS = {"Order__ID": "s", "Sale__Date": "s", "Order__Value": "s", "Note": "s"}
add("scan_csv", _TEXT, **_TEXT_COLUMNS)
add("bank_export_layouts", f"""SELECT o_orderkey AS ref, 'say "' || o_orderpriority || '",' || chr(10) || 'line two' AS description, {cents('o_totalprice')} AS amount, CASE WHEN o_orderstatus = 'O' THEN 'x' || o_orderkey END AS filler FROM orders""",
    ref="i", description="s", amount="m", filler="s")
add("bank_account_latest_balance", f"""WITH {BANK} SELECT account_number, max(balance_c) AS current_balance, arg_max(balance_c, (tx_date, bank_key)) AS latest_balance, max(tx_date) AS last_transaction_date FROM bank GROUP BY 1""",
    account_number="s", current_balance="m", latest_balance="m", last_transaction_date="d")
add("bank_rows_by_seek", f"""WITH {BANK} SELECT bank_key AS bank_transaction_key, tx_date AS transaction_date, s_name AS account_name, coalesce(debit_c, 0) AS debit_amount FROM bank JOIN supplier ON l_suppkey = s_suppkey
  ORDER BY debit_c ASC NULLS LAST, bank_key LIMIT 250 OFFSET 500""", bank_transaction_key="i", transaction_date="d", account_name="s", debit_amount="m")
add("approximate_counts", f"WITH {SALES}, {LIFE}, inside AS (SELECT * FROM sales JOIN life USING (customer_key) WHERE {in_range('sale_date')}) " + " UNION ALL ".join(
    f"SELECT '{kind}' AS customer_type, count(DISTINCT order_key) AS orders, count(DISTINCT customer_key) AS customers, true AS orders_close, true AS customers_close FROM inside WHERE {test}"
    for kind, test in (("all", "true"), ("new", "n = 1"), ("return", "n > 1"))), customer_type="s", orders="i", customers="i", orders_close="b", customers_close="b")
add("rejected_amounts", """SELECT CASE l_suppkey % 10 WHEN 9 THEN 'missing account_number' WHEN 3 THEN 'credit_amount out of range' WHEN 8 THEN 'credit_amount out of range' ELSE 'accepted' END AS message,
  count(*) AS row_count FROM lineitem GROUP BY 1""", message="s", row_count="i")
add("versioned_customers", """WITH o AS (SELECT o_orderkey, c_mktsegment AS s, CAST(o_orderdate AS DATE) >= DATE '1997-06-01' AS later, c_custkey % 3 = 0 AS moves, c_custkey % 10 = 0 AS fresh FROM orders JOIN customer ON o_custkey = c_custkey)
  SELECT o_orderkey, CASE WHEN fresh AND NOT later THEN NULL WHEN moves AND later THEN 'MOVED' ELSE s END AS segment, CASE WHEN fresh AND NOT later THEN NULL WHEN moves THEN later ELSE true END AS is_current,
    CASE WHEN moves AND NOT fresh THEN 2 ELSE 1 END AS versions FROM o""", o_orderkey="i", segment="s", is_current="b", versions="i")
add("first_rows", """SELECT 'product' AS kind, CAST(p_partkey AS VARCHAR) AS id, 'zz ' || p_name AS name FROM part UNION ALL SELECT 'catalog', 'MG' || p_partkey, 'zz ' || p_name FROM part
  UNION ALL SELECT k, 'S' || s_suppkey, 'zz ' || s_name FROM supplier, (VALUES ('account'), ('feed')) v(k)""", kind="s", id="s", name="s")
add("load_period", f"SELECT 'sold_orders' AS dataset, {_N['orders']} AS row_count UNION ALL SELECT 'deposits', {_N['orders']}", dataset="s", row_count="i")
_THOUSANDS = f"CASE WHEN {_VALUE} >= 100000000 THEN ({_VALUE} // 100000000) || ',' || lpad(CAST({_VALUE} // 100000 % 1000 AS VARCHAR), 3, '0') || ',' || lpad(CAST({_VALUE} // 100 % 1000 AS VARCHAR), 3, '0') WHEN {_VALUE} >= 100000 THEN ({_VALUE} // 100000) || ',' || lpad(CAST({_VALUE} // 100 % 1000 AS VARCHAR), 3, '0') ELSE CAST({_VALUE} // 100 AS VARCHAR) END || '.' || lpad(CAST({_VALUE} % 100 AS VARCHAR), 2, '0')"
add("load_dataset", f"""SELECT strftime(o_orderdate, '%B %-d, %Y') AS "Date", CASE WHEN {_PAID} THEN '₫' ELSE '$' END || {_THOUSANDS} AS "Amount", CASE WHEN {_PAID} THEN 'VND' ELSE 'USD' END AS "Currency", o_orderstatus AS "Status",
  lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') AS "Bank Account Ending Digits" FROM orders""", Date="s", Amount="s", Currency="s", Status="s", Bank__Account__Ending__Digits="s")
add("concat_tables", f"""WITH t AS ({_TEXT}) SELECT *, NULL AS "Extra" FROM t UNION ALL SELECT "Order ID", "Sale Date", "Order Value", NULL, 'x' FROM t""", **_TEXT_COLUMNS, Extra="s")
add("ingest_stream", f"SELECT o_orderkey AS order_id, o_orderdate AS sale_date, {_VALUE} AS order_value, p AS period FROM orders, (VALUES ('2025-01'), ('2025-02')) t(p)", order_id="i", sale_date="d", order_value="m", period="s")
add("changed_files", "SELECT '2025-02' AS period, 'EtsySoldOrders2025-2.csv' AS name FROM orders GROUP BY 1, 2", period="s", name="s")
add("append_fact", f"WITH {SALES} SELECT year(sale_date) AS year, month(sale_date) AS month, 2 * count(*) AS row_count, 2 * sum(total_c) AS item_total FROM sales GROUP BY 1, 2", year="i", month="i", row_count="i", item_total="m")
add("reload_period", f"WITH {PAY} SELECT '2025-01' AS period, year(pay_date) AS year, month(pay_date) AS month, count(*) AS row_count, sum(net_c) AS net_amount FROM pay GROUP BY 2, 3", period="s", year="i", month="i", row_count="i", net_amount="m")
add("parquet_sink", f"WITH {CATALOG} SELECT {_CATALOG_SELECT} FROM catalog", **_CATALOG_COLUMNS)
add("export_csv", f"""WITH {CATALOG} SELECT catalog_key AS product_catalog_key, code AS product_code, 'a "b", ' || code AS remark FROM catalog""", product_catalog_key="i", product_code="s", remark="s")
MERGED = f"""stored AS (SELECT {numbered('c_name')} AS customer_key, c_name AS name, c_mktsegment AS city FROM customer WHERE c_acctbal > 0),
  merged AS (SELECT * FROM stored UNION ALL SELECT {numbered('c_name', '(SELECT coalesce(max(customer_key), 0) FROM stored)')}, c_name, c_mktsegment FROM customer WHERE NOT c_acctbal > 0)"""
add("upsert_dimension", f"WITH {MERGED} SELECT customer_key, name AS buyer_user_name, city FROM merged", customer_key="i", buyer_user_name="s", city="s")
add("remap_keys", f"WITH {MERGED} SELECT o_orderkey, customer_key FROM orders JOIN customer ON o_custkey = c_custkey JOIN merged ON name = c_name", o_orderkey="i", customer_key="i")
for _query in ("upsert_dim_time", "ensure_dates"):
    add(_query, f"WITH days AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem) SELECT {key('d')} AS time_key, d AS full_date, year(d) AS year, month(d) AS month, dayname(d) AS day_name FROM days",
        time_key="i", full_date="d", year="i", month="i", day_name="s")
_PLACES = f"""{SOLD}, places AS (SELECT DISTINCT ship_country AS country_name, ship_state AS state_name, ship_city AS city_name, {geo_hash('ship_country', "coalesce(ship_state, 'nan')", 'ship_city')} AS location_hash FROM sold)"""
add("upsert_dim_geography", f"""WITH {_PLACES}, stored AS (SELECT {numbered('location_hash')} AS geography_key, * FROM places WHERE city_name = 'BUILDING')
  SELECT * FROM stored UNION ALL SELECT {numbered('location_hash', '(SELECT coalesce(max(geography_key), 0) FROM stored)')}, * FROM places WHERE city_name <> 'BUILDING'""",
    geography_key="i", location_hash="s", country_name="s", state_name="s", city_name="s")
_FEED = """feed AS (SELECT s_suppkey, 'S' || s_suppkey AS account_number, s_acctbal > 0 AS is_stored, s_name, CASE WHEN s_nationkey > 4 THEN 'New ' || s_name END AS new_name, CASE WHEN s_nationkey > 12 THEN DATE '2021-05-06' END AS new_date,
    CASE WHEN s_suppkey % 4 = 0 THEN 'USD' ELSE 'VND' END AS currency FROM supplier),
  fresh AS (SELECT *, {} AS bank_account_key FROM feed WHERE NOT is_stored)""".format(numbered("account_number", "(SELECT coalesce(max(s_suppkey), 0) FROM feed WHERE is_stored)"))
_FRESH = "SELECT bank_account_key, account_number, coalesce(new_name, account_number), new_date, 'VND' FROM fresh"
_ACCOUNT_COLUMNS = {"bank_account_key": "i", "account_number": "s", "account_name": "s", "opening_date": "d", "currency_code": "s"}
add("upsert_bank_accounts", f"WITH {_FEED} SELECT s_suppkey AS bank_account_key, account_number, coalesce(new_name, account_number) AS account_name, coalesce(new_date, DATE '2000-01-01') AS opening_date, currency AS currency_code FROM feed WHERE is_stored UNION ALL {_FRESH}", **_ACCOUNT_COLUMNS)
add("ensure_bank_accounts", f"WITH {_FEED} SELECT s_suppkey AS bank_account_key, account_number, s_name AS account_name, DATE '2000-01-01' AS opening_date, currency AS currency_code FROM feed WHERE is_stored UNION ALL {_FRESH}", **_ACCOUNT_COLUMNS)
_MAX_CATALOG = "(SELECT coalesce(max(p_partkey * 2 + 1), 0) FROM part)"
_NEW_CATALOG = f"SELECT {numbered('n', _MAX_CATALOG)} AS product_catalog_key, product_code, product_line_name, product_name, variant_name FROM (SELECT *, {_NATURAL} AS n FROM raw_catalog WHERE v = 2) x"
_CATALOG_FEED_COLUMNS = {"product_catalog_key": "i"} | dict.fromkeys(["product_code", "product_line_name", "product_name", "variant_name"], "s")
for _query, _line in (("insert_catalog", "p_type"), ("upsert_catalog", "p_type || ' line'")):
    add(_query, f"WITH raw_catalog AS ({RAW_CATALOG}) SELECT p_partkey * 2 + 1 AS product_catalog_key, upper(p_type) || '_MG' || p_partkey || '_01' AS product_code, {_line} AS product_line_name, p_name AS product_name, 'Variant 01' AS variant_name FROM part UNION ALL {_NEW_CATALOG}",
        **_CATALOG_FEED_COLUMNS)
add("insert_catalog_counts", f"SELECT {_N['part']} AS inserted, {_N['part']} AS skipped, 2 * {_N['part']} AS total", inserted="i", skipped="i", total="i")
add("duplicate_keys", "SELECT upper(p_type) AS product_line_id, 'MG' || p_partkey AS product_id, '02' AS variant_id, 2 AS row_count FROM part", product_line_id="s", product_id="s", variant_id="s", row_count="i")
add("delete_bank_period", f"WITH {BANK} SELECT year(tx_date) * 100 + month(tx_date) AS month_key, count(*) AS row_count FROM bank WHERE NOT (year(tx_date) = 1997 AND month(tx_date) = 5) GROUP BY 1", month_key="i", row_count="i")
add("delete_bank_by_accounts", f"""WITH {BANK} SELECT account_number, code AS pl_account_number, count(*) AS row_count, sum(debit_c) AS debit FROM bank
  WHERE NOT coalesce(tx_date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND code IN ('6221', '6411') AND account_number = 'S7', false) GROUP BY 1, 2""", account_number="s", pl_account_number="s", row_count="i", debit="m")
add("rewrite_months", f"WITH {BANK} SELECT year(tx_date) AS year, code AS pl_account_number, count(*) AS row_count FROM bank WHERE NOT coalesce(year(tx_date) = 1997 AND code = '6221', false) GROUP BY 1, 2", year="i", pl_account_number="s", row_count="i")
add("delete_by_ids", f"WITH {BANK} SELECT bank_key AS bank_transaction_key, debit_c AS debit_amount FROM bank WHERE bank_key NOT IN (SELECT bank_key FROM bank WHERE credit_c IS NOT NULL)", bank_transaction_key="i", debit_amount="m")


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
