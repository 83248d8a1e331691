"""What keeps tasks short and small: each test fails on the code before the change it names."""

import datetime as dt
import os
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shopledger.functions.dates import parse_date
from shopledger.functions.listing import extract_variations
from shopledger.functions.money import parse_currency, plain_amount
from shopledger.functions.statement import fee_name, is_platform_fee
from shopledger.functions.text import clean_text, squash, strip, _UNTIDY
from shopledger.operators import cleaners as C
from shopledger.plans import bank_reports as B
from shopledger.plans import product_cost as P
from shopledger.registry import adapter as A
from shopledger.registry import queries
from shopledger.session import delete_path, drop_table, through_table
from shopledger.sources import bank_export


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_variations_are_split_once(spark):
    """four fields, one split."""
    rows = spark.createDataFrame([("Size: L, Colour: red;STYLE: a:b,size: M ",), ("none",), (None,)], "t string")
    found = rows.select(extract_variations("t").alias("v"))
    assert plan_of(found).count("split(") == 1
    assert [tuple(r.v) for r in found.collect()] == [("M", "a:b", "red", None), (None,) * 4, (None,) * 4]
    items = C.clean_sold_order_items(rows.withColumnRenamed("t", "Variations"))
    assert plan_of(items).count("split(") == 1


@pytest.mark.parametrize("t", ["a b", "", " ", " a", "a ", "a  b", "a\tb", "a\xa0b", " é x\n", "a\n", "-\x7f-", "NaN", " none ", None])
def test_tidy_text_takes_the_short_way(spark, t):
    """the same text with and without the test for what may be untidy; made once per value."""
    row = spark.createDataFrame([(t,)], "t string")
    slow = F.regexp_replace(strip("t"), _UNTIDY, " ")
    got = row.select(squash("t").alias("a"), slow.alias("b"), clean_text("t").alias("c"), F.when(~F.lower(slow).isin("", "nan", "none", "null"), slow).alias("d")).first()
    assert got.a == got.b and got.c == got.d
    assert plan_of(row.select(clean_text("t").alias("x"))).count("regexp_replace") <= 1


def test_catalog_rows_are_dealt_over_the_cores(spark, tmp_path):
    """a table of one row group is not cleaned by one task."""
    columns = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
    spark.createDataFrame([(i, "n", "b", "t", 1, 1.0) for i in range(50)], columns).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    raw = A.raw_catalog(spark, str(tmp_path))
    assert raw.rdd.getNumPartitions() == 2 * spark.sparkContext.defaultParallelism and raw.count() == 200


def test_header_rows_sort_no_cells(spark):
    """the aggregate compares places; cells come by a join."""
    place = "struct<file: int, part: string, start: bigint, row: bigint>"
    rows = [("f", (0, "f", s, r), c) for s, r, c in [(0, 1, ["x"]), (0, 2, ["Date", "Description"]), (9, 0, ["description"])]]
    rows += [("g", (0, "g", 0, 7), ["A"]), ("g", (0, "g", 0, 8), ["1"])]
    heads = bank_export.header_rows(spark.createDataFrame(rows, f"file string, place {place}, cells array<string>"))
    assert sorted((r.file, r.head_place.row, r.names) for r in heads.collect()) == [("f", 2, ["Date", "Description"]), ("g", 7, ["A"])]
    assert not any("min(" in line and "struct(place" in line for line in plan_of(heads).splitlines())


def test_order_shares_keep_the_named_task_count(spark):
    """Rows of orders and products are dealt to all shuffle partitions."""
    sales = spark.createDataFrame([(1, "A", 3.0), (1, "B", 1.0), (None, "A", 2.0)], "order_id bigint, sku string, item_price double")
    sales = sales.withColumn("item_price", F.col("item_price").cast("decimal(15,2)"))
    ratio = P.order_ratio(sales)
    assert "RepartitionByExpression" in plan_of(ratio)
    assert "RepartitionByExpression" in plan_of(P.sku_order_ids(P.product_order_sales(sales)))
    assert sorted((r.order_id or 0, r.product_id, float(r.ratio)) for r in ratio.collect()) == [(0, "A", 0.0), (1, "A", 0.75), (1, "B", 0.25)]


def test_platform_fee_is_a_named_fee(spark):
    titles = ["Transaction fee: x", "PROCESSING\nFEE processing fee", "VAT: shipping-transaction", "shipping\ntransaction", "listing", "other", None]
    rows = spark.createDataFrame([(k, t) for k in ("Fee", "Marketing", "VAT", "Refund", None) for t in titles], "transaction_type string, transaction_title string")
    assert rows.filter(is_platform_fee() != fee_name().isNotNull()).count() == 0


DATES = ["01/02/69", "1/2/68", "02/29/00", "02/29/72", "02/29/70", "13/01/20", "1/2/2020", "01/02/2020", "29/02/2021", "31/1/2025", "1/2/20 ", " 1/2/2020\xa0", "001/2/2020", "1/2/0000", "1/2/9999",
         "1/2/99999", "+1/2/2020", "1 /2/2020", "1/2/2020\n", "1/2", "1/2/3/4", "//", "", "--", "١/2/2020", "1-2-2020", "2020-1-2", "2020-01-02T10:00", "1/2/2020 10:00", None]


def test_plain_dates_are_cast(spark):
    """Three numbers between slashes take no pattern parser; the dates are those of the parser."""
    from shopledger.functions.dates import day_first_date, parse_date

    rows = spark.createDataFrame([(t,) for t in DATES], "t string")
    old = F.try_to_date(strip("t"), "M/d/yy")
    text = F.substring_index(F.substring_index(strip("t"), " ", 1), "T", 1)
    day_first = F.when(text.contains("/"), F.try_to_date(text, "d/M/yyyy")).when(text.rlike(r"^\d{4}-"), F.try_to_date(text, "yyyy-M-d")).when(text.contains("-"), F.try_to_date(text, "d-M-yyyy"))
    pairs = {
        "short": (parse_date("t", "M/d/yy"), F.when(F.year(old) >= 2069, F.add_months(old, -1200)).otherwise(old)),
        "long": (parse_date("t", "M/d/yyyy"), F.try_to_date(strip("t"), "M/d/yyyy")),
        "bank": (day_first_date("t"), day_first),
    }
    for r in rows.select("t", *[F.struct(a.cast("string").alias("a"), b.cast("string").alias("b")).alias(n) for n, (a, b) in pairs.items()]).collect():
        assert all(r[n].a == r[n].b for n in pairs), r
    assert "RLIKE" in plan_of(rows.select(parse_date("t", "M/d/yy").alias("d")))


AMOUNTS = ["$1,234.50", "-$1,234.50", "₫12", "(5.00)", "($1,234.5)", "USD 7.25", "1$2", "$ 5", "5 €", "1e3", "+5", "1.23456", "\x015", "\xa05", "1, 234.50", "nan", "--", "", " ", ".", "-", "12.0", "12.50", "00", " 12 ", " 7", "12345678901234", None]


def test_plain_amounts_take_the_short_way(spark):
    """the same numbers as by translating every text; no lambda over the bank amounts."""
    from shopledger.constants import MONEY_SYMBOLS
    from shopledger.functions.money import AMOUNT, parse_currency, statement_amount
    from shopledger.functions.text import MONEY, NULL_WORDS, WHITESPACE, whole_number

    text = strip("t")
    bare = F.translate(text, "(," + MONEY_SYMBOLS + ")", "-")
    first = F.regexp_extract(bare, r"-?\d+(\.\d+)?", 0)
    number = F.coalesce(bare.try_cast(AMOUNT), F.when(first == "", F.lit(0).cast(AMOUNT)).otherwise(first.try_cast(AMOUNT)))
    pairs = {
        "currency": (parse_currency("t"), F.when(F.lower(text).isin("", "--", *NULL_WORDS) | text.isNull(), F.lit(0).cast(AMOUNT)).otherwise(number)),
        "statement": (statement_amount("t"), strip(F.translate("t", "," + MONEY_SYMBOLS, "")).try_cast(AMOUNT)),
        "bank": (C._bank_amount(F.col("t"))["value"], F.translate("t", "," + WHITESPACE, "").try_cast(MONEY)),
        "id": (whole_number("t"), F.when(text.contains("."), F.regexp_replace(text, r"\.0+$", "")).otherwise(text).try_cast("bigint")),
    }
    rows = spark.createDataFrame([(t,) for t in AMOUNTS], "t string")
    for r in rows.select("t", *[F.struct(a.alias("a"), b.alias("b")).alias(n) for n, (a, b) in pairs.items()]).collect():
        assert all(r[n].a == r[n].b for n in pairs), r
    bank = rows.select(F.lit("S1").alias("Account Number"), F.col("t").alias("Credit Amount"), F.col("t").alias("Description"))
    plan = plan_of(C.clean_bank_transactions(bank))
    assert not any("transform(array(" in line and "credit" in line.lower().split("transform(array(")[1][:60] for line in plan.splitlines())


def test_text_without_a_rule_s_word_is_not_searched(spark):
    """the same ids; a pattern runs only on texts that hold its word."""
    from shopledger.functions.statement import extract_id_from_info

    texts = {"ORDER ID: 5": ("5", "order_id"), "order x listing #7": ("7", "listing_id"), "Transaction:8": ("8", "transaction_id"), "# 9": ("9", "order_id"), "listing, order": None, "no": None}
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", extract_id_from_info("t").alias("x"))
    assert {r.t: r.x and (r.x.extracted_id, r.x.id_type) for r in rows.collect()} == texts | {None: None}
    assert "Contains" in plan_of(rows)


def test_a_key_of_two_kinds_is_of_the_first(spark):
    """a kind that the text does not name is not looked for; which kind wins stays."""
    texts = ["Size/style: a, Style colour: b:c", "MATERIAL color: x; material: y ;color:", "style no colon, sİze: q", ": size, size: \xa0z"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r.v) for r in rows.select(extract_variations("t").alias("v")).collect()]
    assert got == [("a", "b:c", None, None), (None, None, "", "y"), (None,) * 4, ("z", None, None, None)]


def test_stored_tables_are_written_by_compiled_code(spark):
    """While a table is written, no generated method is larger than the JVM compiles."""
    from shopledger.session import METHOD_LIMIT, compiled_rows

    before = spark.conf.get(METHOD_LIMIT)
    with compiled_rows(spark):
        assert int(spark.conf.get(METHOD_LIMIT)) == 8000
    assert spark.conf.get(METHOD_LIMIT) == before
    with pytest.raises(ValueError), compiled_rows(spark):
        raise ValueError
    assert spark.conf.get(METHOD_LIMIT) == before


def test_cents_are_grouped_without_a_formatter(spark):
    """The formatter's text, which only large numbers need."""
    values = ["0", "0.05", "-0.05", "999.99", "-999.99", "1000", "-1000.5", "12345.67", "999999.99", "-999999.99", "1000000", "1234567890123.45", "-1234567.8", None]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(F.col("v").cast("decimal(15,2)").alias("v"))
    assert all(r.a == r.b for r in rows.select(A.cents_text(F.col("v")).alias("a"), F.format_number("v", 2).alias("b")).collect())


@pytest.mark.parametrize("n", [None, 3])
def test_tidy_text_needs_no_lambda(spark, n):
    """the text as it stands where it is tidy; the same result as before for all others."""
    texts = ["S1", "a b", " a", "a ", "a  b", "NaN", "none", "nones", "nul", "nulls", "", " ", "-", "é", "a\tb", "ab c", "ab  c", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    tidy = F.regexp_replace(strip("t"), _UNTIDY, " ")
    tidy = tidy if n is None else F.substring(tidy, 1, n)
    got = rows.select(clean_text("t", n).alias("a"), F.when(~F.lower(tidy).isin("", "nan", "none", "null"), tidy).alias("b"))
    assert all(r.a == r.b for r in got.collect())
    assert "CASE WHEN isnull(t" in plan_of(got)


def test_blank_records_are_told_without_their_cells(spark):
    """a record that is plainly filled is never blank; cells are made once for it."""
    texts = ["a", '"a"', ',,"a b",', '",",', ",,", '"",""', '""""', '"x', '",,""', '"a""', '"a,b""', '""x', ',"",x', '"', ' ', '"\n",', '"",",b', '"ab"cd,', '","",""', None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = rows.select("t", F.col("t").rlike(bank_export._PLAINLY_FILLED).alias("plain"), F.exists(bank_export.record_cells(F.col("t")), lambda c: c.isNotNull()).alias("filled")).collect()
    assert all(r.filled for r in plain if r.plain) and sum(bool(r.plain) for r in plain) >= 5


def test_row_width_is_compared_first(spark, tmp_path):
    """the cells behind a header's last column are only looked at where there are any; a filled one is an error."""
    (tmp_path / "a.csv").write_text('Bank,x\nDate,Description\n1,"a"\n,\n2,b,,\n')
    got = bank_export.read_bank_export(spark, f"{tmp_path}/a.csv")
    assert "(size(cells" in plan_of(got) and sorted(map(tuple, got.collect())) == [("1", "a"), ("2", "b")]
    (tmp_path / "b.csv").write_text("Date,Description\n1,a,,c\n")
    with pytest.raises(Exception, match="more cells"):
        bank_export.read_bank_export(spark, f"{tmp_path}/b.csv").collect()


def test_a_rejection_s_filter_stays_above_the_cleaning(spark):
    """Round 4 F3, F4: the filter compares the finished reason; moved below, all that it comes from would be computed twice."""
    columns = ["transaction_date", "reference_number", "account_number", "credit_amount", "debit_amount", "balance_after_transaction", "transaction_description"]
    rows = spark.createDataFrame([("01/02/2020", "R", " S1 ", "1,000.5", None, "2", "x"), ("bad", "R", "none", "1", "9" * 14, "2", "x")], columns)
    kept = C.clean_bank_transactions(rows)
    tests = [line for line in plan_of(kept).splitlines() if "Filter" in line]
    assert len(tests) == 1 and "__rejection" in tests[0] and "account_number" not in tests[0]
    assert [(r.account_number, r.credit_amount) for r in kept.collect()] == [("S1", Decimal("1000.50"))]
    assert [r.message for r in C.rejected_bank_rows(rows).collect()] == ["missing account_number; debit_amount out of range"]


@pytest.mark.parametrize("t, value", [("USD 1,234.50", "1234.5"), ("(5.00)", "-5"), ("-$1.5", "-1.5"), ("₫7", "7"), ("nan", "0"), ("Infinity", "0"), ("e5", "5"), (" $ 3 ", "3"), ("A-2B", "-2"), ("{4", "4"), ("", "0"), (None, "0")])
def test_text_that_begins_with_a_word_is_not_cast(spark, t, value):
    """Round 4 F1, F2, F3: a cast that fails raises inside; text of a currency word or in parentheses is not tried."""
    row = spark.createDataFrame([(t,)], "t string")
    assert row.select(parse_currency("t").alias("x")).first().x == Decimal(value)
    assert row.select(plain_amount(F.col("t")).alias("x")).first().x in (None, Decimal(value))
    assert "< A)" in plan_of(row.select(parse_currency("t").alias("x")))


@pytest.mark.parametrize("t", ["March 5, 2020", "March 05, 2020", "march 5, 2020", " March 5, 2020", "February 30, 2020", "May 1, 0000", "May 1, 12020", "no date", "", "Mar 5, 2020", "June  5, 2020", "March 5,2020", "March 5, 2020\n", None])
def test_written_months_are_cast(spark, t):
    """Round 4 F1, F3: the same dates as a parse by the pattern."""
    row = spark.createDataFrame([(t,)], "t string").select(parse_date("t", "MMMM d, yyyy").cast("string").alias("a"), F.try_to_date(strip("t"), "MMMM d, yyyy").cast("string").alias("b"))
    got = row.first()
    assert got.a == got.b and "THEN -12-" in plan_of(row)


def test_plain_variations_need_no_lambda(spark):
    """Round 4 F2, F3: one pattern per kind finds what the list of pairs holds, which stays for other texts."""
    texts = ["size:1, SIZE : 2 ;style: a:b, Color:", "Style size: x, color style: q, Colour: b", "Size:,size", "col:or, color", "size;:3,size:", "color: a\nb;  material : c ", ": size", "material:,", ""]
    rows = spark.createDataFrame([(t, f"{t};é") for t in texts], "plain string, other string")
    found = rows.select(extract_variations("plain").alias("a"), extract_variations("other").alias("b"))
    assert all(r.a == r.b for r in found.collect()) and "regexp_extract_all" in plan_of(found)


def test_written_tables_leave_no_shuffle_files(spark):
    """Round 4 F4, F5: shuffle files go with the write they were made for, not when the driver's JVM collects its plan."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = disk.getAllFiles().size()
    rows = through_table(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "few", "zstd")
    assert disk.getAllFiles().size() <= before and rows.count() == 7
    drop_table(rows)
    assert not os.path.exists(rows.inputFiles()[0].removeprefix("file:"))


def test_bank_exports_are_packed_and_go_once_read(spark, tmp_path, monkeypatch):
    """Round 4 F4: the export is compressed and deleted when its records are stored."""
    lines = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_shipdate date"
    spark.createDataFrame([(i, 1, i % 20, 1 + i % 2, 3.0, 1234.5, dt.date(1997, 1 + i % 12, 1)) for i in range(60)], lines).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, "red", "WIDGET")], "p_partkey bigint, p_name string, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    seen = []
    monkeypatch.setattr(queries, "delete_path", lambda s, path: (seen.extend(Path(path).glob("*/part-*")), delete_path(s, path)))
    rows = queries.QUERIES["header_row_detection"](spark, str(tmp_path))
    assert seen and all(p.name.endswith(".gz") for p in seen) and not any(p.exists() for p in seen)
    assert rows.count() == 54  # of 60 rows 6 name no account


def test_all_bank_rows_are_named_before_the_sort(spark):
    """Round 4 F5: without a limit the returned frame sorts stored rows; null keys, null ids and repeated lookups count as before."""
    kind = "bank_transaction_key long, bank_account_key long, product_catalog_key long, transaction_date_key int, debit_amount decimal(15,2), parsed_product_line_id string, parsed_product_id string, parsed_variant_id string"
    bank = spark.createDataFrame([(1, 1, 1, 20200101, Decimal(3), "L", "A", "01"), (2, 9, None, None, None, "L", "A", "01"), (3, 1, None, 20200102, Decimal(7), None, "A", "01"), (4, None, 2, 20200101, Decimal(3), "L", "B", "01"), (5, 1, 5, 20200101, Decimal(1), "L", "C", "01")], kind)
    more = {c: F.lit(None).cast("string") for c in ("reference_number", "account_number", "transaction_description", "pl_account_number")}
    bank = bank.withColumns(more | {c: F.lit(None).cast("decimal(15,2)") for c in ("credit_amount", "balance_after_transaction")} | {"is_business_related": F.lit(True)})
    accounts = spark.createDataFrame([(1, "acc")], "bank_account_key long, account_name string")
    names = "product_catalog_key long, product_line_id string, product_id string, variant_id string, product_line_name string, product_name string, variant_name string"
    catalog = spark.createDataFrame([(1, "L", "A", "01", "line", "hat", None), (2, "L", "A", "01", "twice", "cap", "v"), (3, None, "A", "01", "n", "n", "n")], names)
    days = spark.createDataFrame([(20200101, dt.date(2020, 1, 1)), (20200102, dt.date(2020, 1, 2))], "time_key int, full_date date")
    found = B.browse_bank_transactions(bank, accounts, catalog, days, sort_by="debit_amount", limit=None)
    assert "Join" not in plan_of(found)
    rows = [(r.bank_transaction_key, r.transaction_date and r.transaction_date.day, r.account_name, r.product_line_name, r.product_name, r.variant_name, r.debit_amount) for r in found.collect()]
    assert [r[0] for r in rows] == [2, 2, 3, 1, 1, 4, 5]
    assert set(rows) == {
        (2, None, None, "line", "hat", None, 0),
        (2, None, None, "twice", "cap", "v", 0),
        (3, 2, "acc", None, None, None, 7),
        (1, 1, "acc", "line", "hat", None, 3),
        (1, 1, "acc", "line", "hat", "v", 3),
        (4, 1, None, "twice", "cap", "v", 3),
        (5, 1, "acc", None, None, None, 1),
    }
    behind = B.browse_bank_transactions(bank, accounts, catalog, days, sort_by="debit_amount", limit=None, after=(Decimal(3), 1))
    assert [r.bank_transaction_key for r in behind.collect()] == [4, 5]
