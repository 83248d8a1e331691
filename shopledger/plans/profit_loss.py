"""Profit and loss: conditional sums per period, assembled into a statement.

Views: 'month' (the same month of all years together), 'year', 'month_year'.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import COGS_ACCOUNTS, FEE_LINES, FULL_YEAR, OPERATING_ACCOUNTS, PL_ACCOUNTS, PROFIT_ITEMS, STATEMENT_LINES
from ..functions.statement import fee_line
from ..operators.filters import date_filter
from ..session import through_table

CENTS = "decimal(20,2)"
VIEW_KEYS = {"month": ["month", "month_name"], "year": ["year"], "month_year": ["year", "month", "month_name"]}
VAT_COLUMNS = [c for c, kind, *_ in FEE_LINES if kind == "VAT"]
FEE_COLUMNS = [c for c, kind, *_ in FEE_LINES if kind != "VAT"]
STATEMENT_COLUMNS = ["revenue", "refund_cost", *[c for c, *_ in FEE_LINES]]
COGS_COLUMNS = [c for c, _ in COGS_ACCOUNTS.values()]
OPERATING_COLUMNS = [c for c, _ in OPERATING_ACCOUNTS.values()]


def period_keys(view: str = "month") -> list[str]:
    return VIEW_KEYS.get(view, VIEW_KEYS["month"])


def _sum_if(condition: Column, amount: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, amount)).cast(CENTS), F.lit(0).cast(CENTS))


def _dated(fact, dim_time, view, start, end) -> DataFrame:
    return date_filter(fact, dim_time, "transaction_date_key", start, end, period_keys(view))


def pl_periods(financial, bank, dim_time, view="month", start=None, end=None) -> DataFrame:
    """Periods with a statement line or a bank row."""
    keys = period_keys(view)
    # distinct days first: the join and the union see at most one row per day and fact
    days = [f.select("transaction_date_key").distinct() for f in (financial, bank)]
    found = [_dated(d, dim_time, view, start, end).select(*keys) for d in days]
    return found[0].union(found[1]).distinct().orderBy(*keys)


def revenue_and_fees(financial, dim_time, view="month", start=None, end=None) -> DataFrame:
    """Revenue, refunds and twelve fee lines per period. A title may count in several lines ('listing credit')."""
    fee = F.abs("fees_and_taxes")
    sums = {
        "revenue": _sum_if(F.col("transaction_type") == "Sale", F.col("amount")),
        "refund_cost": _sum_if(F.col("transaction_type") == "Refund", F.abs("amount")),
    }
    sums |= {name: _sum_if(fee_line(kind, part), fee) for name, kind, part, _ in FEE_LINES}
    rows = _dated(financial, dim_time, view, start, end)
    return rows.groupBy(*period_keys(view)).agg(*[c.alias(n) for n, c in sums.items()])


def _account_sums(accounts: dict) -> dict[str, Column]:
    debit = F.abs("debit_amount")
    return {name: _sum_if(F.col("pl_account_number") == code, debit) for code, (name, _) in accounts.items()}


def _total_of(accounts: dict) -> Column:
    return _sum_if(F.col("pl_account_number").isin(*accounts), F.abs("debit_amount"))


def cost_of_goods(bank, dim_time, view="month", start=None, end=None) -> DataFrame:
    """Debits of the six goods accounts and their total; only periods that have such rows."""
    rows = _dated(bank.filter(F.col("pl_account_number").isin(*COGS_ACCOUNTS)), dim_time, view, start, end)
    sums = _account_sums(COGS_ACCOUNTS) | {"cost_of_goods": _total_of(COGS_ACCOUNTS)}
    return rows.groupBy(*period_keys(view)).agg(*[c.alias(n) for n, c in sums.items()])


def operating_costs(bank, dim_time, view="month", start=None, end=None) -> DataFrame:
    """Debits of the seven operating accounts; only periods that have such rows."""
    rows = _dated(bank.filter(F.col("pl_account_number").isin(*OPERATING_ACCOUNTS)), dim_time, view, start, end)
    return rows.groupBy(*period_keys(view)).agg(*[c.alias(n) for n, c in _account_sums(OPERATING_ACCOUNTS).items()])


def _bank_costs(bank, dim_time, view, start, end, rate: Column | None) -> DataFrame:
    """All thirteen accounts per period in one scan; every period with a bank row appears."""
    if rate is not None:
        bank = bank.withColumn("debit_amount", (F.col("debit_amount") * rate).cast("decimal(15,2)"))
    sums = _account_sums(PL_ACCOUNTS) | {"cost_of_goods": _total_of(COGS_ACCOUNTS)}
    rows = _dated(bank, dim_time, view, start, end)
    return rows.groupBy(*period_keys(view)).agg(*[c.alias(n) for n, c in sums.items()])


def pl_assemble(financial, bank, dim_time, view="month", start=None, end=None, bank_rate: Column | None = None) -> DataFrame:
    """One row per period with all amounts, fee totals included; a period without rows in one fact has 0 there.

    Each fact is scanned once; the join is between two tables of one row per period. Bank debits are taken as stored
    unless ``bank_rate`` converts them.
    """
    keys = period_keys(view)
    both = revenue_and_fees(financial, dim_time, view, start, end).join(
        _bank_costs(bank, dim_time, view, start, end, bank_rate), keys, "full_outer"
    )
    amounts = [c for c in both.columns if c not in keys]
    filled = both.select(*keys, *[F.coalesce(c, F.lit(0).cast(CENTS)).alias(c) for c in amounts])
    vat = sum((F.col(c) for c in VAT_COLUMNS), F.lit(0).cast(CENTS)).cast(CENTS)
    filled = filled.withColumn("total_vat_fees", vat)
    fees = sum((F.col(c) for c in [*FEE_COLUMNS, "total_vat_fees"]), F.lit(0).cast(CENTS)).cast(CENTS)
    return filled.withColumn("total_platform_fees", fees)


def net_profit(amounts: DataFrame, selected_items: Sequence[str] | None = None, use_default: bool = True) -> DataFrame:
    """Add ``net_profit``: revenue minus the chosen columns; unknown names are skipped; nothing chosen gives 0."""
    items = selected_items
    if items is None and use_default:
        items = list(PROFIT_ITEMS)
    if not items:
        return amounts.withColumn("net_profit", F.lit(0).cast(CENTS))
    spent = sum((F.col(c) for c in items if c in amounts.columns), F.lit(0).cast(CENTS))
    return amounts.withColumn("net_profit", (F.col("revenue") - spent).cast(CENTS))


def _period_label(view: str) -> Column:
    if view == "year":
        return F.col("year").cast("string")
    if view == "month_year":
        return F.concat_ws(" ", F.col("year").cast("string"), F.col("month_name"))
    return F.col("month_name")


def _period_order(view: str) -> Column:
    return {"year": F.col("year"), "month_year": F.col("year") * 100 + F.col("month")}.get(view, F.col("month"))


def pl_statement_long(amounts: DataFrame, view: str = "month") -> DataFrame:
    """(line_no, line_item, period, period_no, amount): every statement line for every period and for the full year.

    Headings have null amounts. The full year has period_no null.
    """
    lines = [
        F.struct(
            F.lit(i).alias("line_no"),
            F.lit(label).alias("line_item"),
            (F.col(c).cast(CENTS) if c else F.lit(None).cast(CENTS)).alias("amount"),
        )
        for i, (label, c) in enumerate(STATEMENT_LINES, start=1)
    ]
    rows = amounts.select(
        _period_label(view).alias("period"), _period_order(view).alias("period_no"), F.inline(F.array(*lines))
    )
    total = rows.groupBy("line_no", "line_item").agg(F.sum("amount").cast(CENTS).alias("amount"))
    total = total.withColumns({"period": F.lit(FULL_YEAR), "period_no": F.lit(None).cast("int")})
    return rows.unionByName(total).select("line_no", "line_item", "period", "period_no", "amount")


def pl_statement(
    financial,
    bank,
    dim_time,
    view="month",
    start=None,
    end=None,
    selected_items: Sequence[str] | None = None,
    use_default: bool = True,
) -> DataFrame:
    """The wide statement: one row per line, one column per period and 'Full Year'.

    The period names (at most one per month of the range) are read first, as a result's columns must be known.
    """
    amounts = net_profit(pl_assemble(financial, bank, dim_time, view, start, end), selected_items, use_default)
    # one row per period; written so that the period names and the statement need one computation
    amounts = through_table(amounts, "periods")
    names = amounts.select(_period_label(view).alias("p"), _period_order(view).alias("n")).orderBy("n").collect()
    values = [r.p for r in names] + [FULL_YEAR]
    wide = pl_statement_long(amounts, view).groupBy("line_no", "line_item").pivot("period", values).agg(F.first("amount"))
    return wide.orderBy("line_no").withColumnRenamed("line_item", "Line Item").drop("line_no")


def account_mapping(spark: SparkSession) -> DataFrame:
    """(account, column, label) of the profit-and-loss accounts."""
    rows = [(code, name, label) for code, (name, label) in PL_ACCOUNTS.items()]
    return spark.createDataFrame(rows, "account string, column string, label string")


def profit_formula_text() -> str:
    return "Profit = Revenue − (" + " + ".join(PROFIT_ITEMS.values()) + ")"
