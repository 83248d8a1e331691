import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shopledger.functions import bank, dates, listing, lookups, money, statement, text
from shopledger.operators import cleaners as C


def one(spark, value, fn, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}").select(fn(F.col("v")).alias("r"))
    return df.first().r


@pytest.mark.parametrize(
    "value, expected",
    [("₫1,234", 1234), ("-$5.50", -5.5), ("(7.25)", -7.25), ("about 3.5 each", 3.5), ("", 0), (None, 0), ("--", 0), ("none", 0), ("x", 0)],
)
def test_parse_currency_blank_is_zero(spark, value, expected):
    assert one(spark, value, money.parse_currency) == Decimal(str(expected))


def test_statement_amount_blank_is_null_and_dollar_is_read(spark):
    assert one(spark, None, money.statement_amount) is None
    assert one(spark, "-₫1,234", money.statement_amount) == -1234
    assert one(spark, "-$2.50", money.statement_amount) == Decimal("-2.5")  # text with a dollar sign stays a number
    assert one(spark, "n.a.", money.statement_amount) is None


def test_vnd_is_converted_and_usd_is_rounded(spark):
    df = spark.createDataFrame([("2470865.5", "vnd"), ("1.005", "USD"), ("7", None)], "a string, c string")
    rows = df.select(money.vnd_to_usd(F.col("a").cast(money.AMOUNT), "c").alias("r"), money.usd_currency("c").alias("c")).collect()
    assert [(r.r, r.c) for r in rows] == [(Decimal("100.00"), "USD"), (Decimal("1.01"), "USD"), (Decimal("7.00"), None)]


def test_ratio_is_half_up_and_null_for_zero(spark):
    assert one(spark, Decimal("201.00"), lambda c: money.ratio(c, F.lit(200)), "decimal(20,2)") == Decimal("1.01")
    assert one(spark, Decimal("1.00"), lambda c: money.ratio(c, F.lit(0)), "decimal(20,2)") is None


def test_dates(spark):
    assert one(spark, "01/31/95", lambda c: dates.parse_date(c, "M/d/yy")) == dt.date(1995, 1, 31)
    assert one(spark, "2/29/68", lambda c: dates.parse_date(c, "M/d/yy")) == dt.date(2068, 2, 29)
    assert one(spark, "January 31, 2025", lambda c: dates.parse_date(c, "MMMM d, yyyy")) == dt.date(2025, 1, 31)
    assert one(spark, "2025-01-31", lambda c: dates.parse_date(c, "M/d/yyyy")) is None
    for raw in ("31/01/2025", "31-1-2025", "2025-01-31", "2025-01-31T10:00:00", "31/01/2025 08:15"):
        assert one(spark, raw, dates.day_first_date) == dt.date(2025, 1, 31)
    assert one(spark, 20250230, dates.key_date, "int") is None


@pytest.mark.parametrize(
    "info, expected",
    [
        ("Order #123", ("123", "order_id")),
        ("order id: 5", ("5", "order_id")),
        ("Listing #77", ("77", "listing_id")),  # the word before the number wins over the bare sign
        ("transaction: 9", ("9", "transaction_id")),
        ("paid #4", ("4", "order_id")),
        ("nothing", None),
        (None, None),
    ],
)
def test_extract_id(spark, info, expected):
    got = one(spark, info, statement.extract_id_from_info)
    assert (got and (got.extracted_id, got.id_type)) == expected


def test_extract_id_bare_sign_first(spark):
    got = one(spark, "Listing #77", lambda c: statement.extract_id_from_info(c, bare_hash_first=True))
    assert got.id_type == "order_id"


def test_categories(spark):
    cases = {"Refund of item": "Sale", "payout": "Deposit", "Return": "Refund", "charge": "Fee", "Tax": "Tax", "x": "Other", None: "Unknown"}
    for value, label in cases.items():
        assert one(spark, value, statement.categorize_revenue_type) == label
    assert one(spark, "Listing payment", statement.categorize_fee_type) == "Listing Fee"
    assert one(spark, None, statement.categorize_fee_type) is None


def test_fee_name_is_first_match_and_underscore_is_a_wildcard(spark):
    rows = spark.createDataFrame(
        [("VAT", "listing credit"), ("VAT", "Listing"), ("VAT", "shipping transaction"), ("VAT", "else"), ("Marketing", None)],
        "transaction_type string, transaction_title string",
    )
    got = [r.n for r in rows.select(statement.fee_name().alias("n")).collect()]
    assert got == ["VAT - listing credit", "VAT - listing", "VAT - shipping_transaction", None, "Marketing"]


@pytest.mark.parametrize(
    "description, expected",
    [
        ("DEF_MG01107417_03 6221 Ck yarn", ("6221", "DEF", "MG01107417", "03")),
        ("tbl_blo_to01_6222 chart", ("6222", "TBL", "BLO", "to01")),  # the variant keeps its case
        ("A_B_C 9999 x", (None, "A", "B", "C")),  # unknown account, ids stay
        ("1_1_1", (None, "1", "1", "1")),
        ("rent", (None, None, None, None)),
        (None, (None, None, None, None)),
    ],
)
def test_bank_description(spark, description, expected):
    assert tuple(one(spark, description, bank.parse_bank_description)) == expected


def test_first_token_fallback(spark):
    got = one(spark, " a-b_c-d_e-f more", lambda c: bank.parse_bank_description(c, first_token_fallback=True))
    assert tuple(got) == (None, "A-B", "C-D", "E-F")


def test_variations_last_part_wins(spark):
    got = one(spark, "Size: S, Hair colour: red; SIZE:L, fabric material: a:b, plain", listing.extract_variations)
    assert got.asDict() == {"size": "L", "style": None, "color": "red", "material": "a:b"}


def test_listing_description(spark):
    raw = "A story\n\nThank you. Bye\n- Material: wool\n- Dimension: 3 cm\nColor: red\nPackage: box\n* Instructions for use and care: wash\nHow to use: fold"
    cleaned = one(spark, raw, listing.clean_description)
    assert "Thank you." not in cleaned and "\n\n" not in cleaned
    got = one(spark, cleaned, listing.parse_listing_description)
    assert (got.story, got.material, got.dimensions, got.color, got.package) == ("A story", "wool", "3 cm", "red", "box")
    assert (got.instructions, got.how_use, got.note, got.country) == ("wash", "fold", "", "Vietnam")


def test_text_lists_and_names(spark):
    assert one(spark, ' ["a", " b ", ""] ', text.parse_list) == ["a", "b"]
    assert one(spark, "a, ,b", text.parse_list) == ["a", "b"]
    assert one(spark, "[not json", text.parse_list) == ["[not json"]
    assert one(spark, "NaN", text.parse_list) == []
    assert one(spark, "a,b", text.sku_to_list) == ["a,b"]
    assert one(spark, "  a \t b\n", text.clean_text) == "a b"
    assert one(spark, " NULL ", text.clean_text) is None
    assert one(spark, "abcdef", lambda c: text.clean_text(c, 3)) == "abc"
    assert one(spark, "12.0", text.whole_number) == 12
    assert text.snake_name("Ngày GD (Transaction Date)") == "ngày_gd_transaction_date"
    assert text.snake_name("Fees & Taxes") == "fees_taxes"


def test_lookups(spark):
    row = spark.createDataFrame([("Canada",), ("Peru",)], "c string").select(
        *[v.alias(k) for k, v in lookups.country_columns("c").items()]
    ).collect()
    assert row[0].timezone == "America/Toronto" and row[0].market == "International"
    assert (row[1].continent, row[1].region, row[1].currency_code, row[1].timezone) == ("Unknown", "Other", "USD", "UTC")


def test_statement_cleaner_mixed_currencies(spark):
    raw = spark.createDataFrame(
        [("January 31, 2025", "Sale", "t", "Order #1", "VND", "₫2,470,865.5", "--", "--", "--"), ("bad", "Fee", "t", "x", "USD", "--", "-$1.239", "$2", "--")],
        ["Date", "Type", "Title", "Info", "Currency", "Amount", "Fees & Taxes", "Net", "Tax Details"],
    )
    a, b = C.clean_statement(raw).orderBy("type", ascending=False).collect()
    assert (a.amount, a.currency, a.extracted_id, a.date) == (Decimal("100.00"), "USD", "1", dt.date(2025, 1, 31))
    assert (b.fees_taxes, b.net, b.date, b.id_type) == (Decimal("-1.24"), Decimal("2.00"), None, None)


def test_statement_cleaner_dollars_only(spark):
    raw = spark.createDataFrame([("USD", "$1.005")], ["Currency", "Amount"])
    assert C.clean_statement(raw).first().amount == Decimal("1.01")  # typed and rounded without a VND row too


def test_sold_orders_cleaner(spark):
    raw = spark.createDataFrame([("1/2/25", "7", "A,B", "REFUNDED", " a  b ", "247086.55")], ["Sale Date", "Order ID", "SKU", "Order Status", "Buyer", "Order Net"])
    r = C.clean_sold_orders(raw).first()
    assert (r.sale_date, r.sku, r.order_status, r.buyer, r.order_net) == (dt.date(2025, 1, 2), ["A", "B"], "Refunded", "a b", Decimal("1000.00"))


def test_items_cleaner_has_no_personalization(spark):
    raw = spark.createDataFrame([("1/2/25", "01/03/2025", "Personalization: Bob, Size: M")], ["Sale Date", "Date Paid", "Variations"])
    r = C.clean_sold_order_items(raw).first()
    assert (r.personalization, r.size, r.date_paid) == (None, "M", dt.date(2025, 1, 3))


def test_bank_headers_in_both_languages(spark):
    names = ["Ngay GD", "Mã giao dịch", "Account Number (truy van)", "Phat sinh co", "Phát sinh nợ", "So du", "Dien giai"]
    raw = spark.createDataFrame([("31/01/2025", "R", " 12 ", "1,000", "2 000", "5", "A_B_C 6211")], names)
    r = C.clean_bank_transactions(raw).first()
    assert (r.transaction_date, r.account_number, r.account_name) == (dt.date(2025, 1, 31), "12", "12")
    assert (r.credit_amount, r.debit_amount, r.balance_after_transaction, r.pl_account_number) == (1000, 2000, 5, "6211")


def test_catalog_first_row_by_input_order(spark):
    raw = spark.createDataFrame([("L", "n", "P", "z", "1", "v", 1), ("L", "n", "P", "a", "1", "v", 2)], ["Product Line ID", "Product line", "Product ID", "Product", "Variant ID", "Variants", "_line"])
    assert C.clean_product_catalog(raw, order_by=["_line"]).first().product_name == "z"
    assert C.clean_product_catalog(raw.drop("_line")).first().product_name == "a"


def test_a_readable_amount_that_does_not_fit_is_not_lost(spark):
    from shopledger.functions.money import fitting, parse_currency, statement_amount

    def read(expr, text):
        return spark.createDataFrame([(text,)], "a string").select(expr("a")).first()[0]

    money = lambda c: fitting(F.col(c))
    for expr in (parse_currency, statement_amount, money):
        with pytest.raises(Exception, match="out of range"):
            read(expr, "123456789012345678901")
    assert read(parse_currency, "$9,999,999,999,999,999.99") == Decimal("9999999999999999.9900")
    assert read(parse_currency, "n/a 5") == 5 and read(parse_currency, "none at all") == 0 and read(parse_currency, None) == 0
    assert read(statement_amount, "abc") is None and read(statement_amount, None) is None
    assert read(money, "abc") is None and read(money, None) is None and read(money, " 12.345") == Decimal("12.35")
    with pytest.raises(Exception, match="out of range"):
        read(money, "10000000000000")


def test_bank_rows_with_oversized_amounts_are_rejected_with_a_reason(spark):
    from shopledger.operators import cleaners

    head = "`Account Number` string, `Transaction Date` string, `Credit Amount` string, `Debit Amount` string, Balance string, Description string"
    rows = [("N1", "01/02/2025", "5", "", "1", "a"), ("N1", "01/02/2025", "99999999999999", "x", "1", "b"), ("", "01/02/2025", "12,345,678,901,234.5", None, "123456789012345", "c"), (" ", "01/02/2025", "1", "2", "3", "d")]
    raw = spark.createDataFrame(rows, head)
    accepted, rejected = cleaners.split_bank_rows(raw)
    for part, whole in ((accepted, cleaners.clean_bank_transactions(raw)), (rejected, cleaners.rejected_bank_rows(raw))):
        assert part.columns == whole.columns and sorted(map(repr, part.collect())) == sorted(map(repr, whole.collect()))
    assert [(r.transaction_description, r.credit_amount, r.debit_amount) for r in accepted.collect()] == [("a", 5, None)]
    assert {r.transaction_description: r.message for r in rejected.collect()} == {
        "b": "credit_amount out of range",
        "c": "missing account_number; credit_amount out of range; balance_after_transaction out of range",
        "d": "missing account_number",
    }
