import csv

import pytest
from pyspark.sql import functions as F

from shopledger.constants import STAR_MONEY
from shopledger.operators import delete as X
from shopledger.operators.dimensions import build_dim_time
from shopledger.plans.pipeline import load_star, run_period
from shopledger.plans.product_cost import allocate
from shopledger.session import shared_dir
from shopledger.operators.cleaners import clean_product_catalog
from shopledger.sources import bank_export, files, sinks, swap, validate
from shopledger.streaming import ingest


def write(path, header, rows, preamble=()):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f)
        w.writerows([*preamble, header, *rows])


STATEMENT = ["Date", "Type", "Title", "Info", "Currency", "Amount", "Fees & Taxes", "Net", "Tax Details"]
ITEMS = ["Sale Date", "Item Name", "Quantity", "Price", "Discount Amount", "Item Total", "Transaction ID", "Listing ID", "Date Paid", "Date Shipped", "Ship City", "Ship State", "Ship Country", "Order ID", "Variations", "Payment Type", "SKU"]
ORDERS = ["Sale Date", "Order ID", "Full Name", "Payment Method", "Ship City", "Ship State", "Ship Zipcode", "Ship Country", "Order Value", "Coupon Code", "Discount Amount", "Order Total"]
CHECKOUT = ["Payment ID", "Buyer Username", "Order ID", "Gross Amount", "Net Amount", "Currency", "Order Date", "Payment Type"]
BANK = ["Ngày GD (Transaction Date)", "Mã giao dịch (Reference No.)", "Số tài khoản truy vấn (Account Number)", "Phát sinh nợ (Debit Amount)", "Diễn giải (Description)"]


def make_period(root, month):
    d = root / f"2025-{month:02d}"
    m = f"2025-{month}"
    write(d / f"etsy_statement_2025_{month}.csv", STATEMENT, [[f"January {month}, 2025", "Fee", "Transaction fee", f"Order #{month}1", "USD", "--", "-$2.00", "-$2.00", "--"], [f"January {month}, 2025", "Refund", "r", f"Order #{month}1", "USD", "-$6.00", "--", "--", "--"]])
    write(d / f"EtsySoldOrderItems{m}.csv", ITEMS, [[f"{month:02d}/05/25", "Red hat", "1", "10", "1", "10", f"{month}00", "555", f"{month:02d}/05/2025", "N/A", "A", "NY", "United States", f"{month}1", "Size: L", "online", "P1"], [f"{month:02d}/05/25", "Blue\nhat", "1", "20", "0", "20", f"{month}01", "556", "", "", "A", "NY", "United States", f"{month}1", "", "online", "P2"]])
    write(d / f"EtsySoldOrders{m}.csv", ORDERS, [[f"{month:02d}/05/25", f"{month}1", "Bob B", "Credit card", "A", "NY", "1", "United States", "$30.00", "--", "", "$30.00"]])
    write(d / f"EtsyDirectCheckoutPayments{m}.csv", CHECKOUT, [[f"9{month}", "bob", f"{month}1", "30", "28", "USD", f"{month:02d}/05/2025", "online"]])
    write(d / f"EtsyDeposits{m}.csv", ["Date", "Amount", "Currency", "Status"], [["January 31, 2025", "₫2,470,865.5", "VND", "paid"]])
    write(d / "EtsyListingsDownload.csv", ["TITLE", "DESCRIPTION", "PRICE", "SKU"], [["RED HAT", "Nice\n- Material: wool", "12", "P1"]])
    write(d / "fact_bank_transactions.csv", BANK, [[f"10/{month:02d}/2025", f"R{month}", "N1", "5.5", "L_P1_01 6211 x"]])
    write(d / "product_catalog.csv", ["Product line ID", "Product line", "Product ID", "Product", "Variant ID", "Variants"], [["L", "Line", "P1", "Hat", "01", "One"]])
    return d


def test_load_clean_build_twice(spark, tmp_path):
    raw, house = tmp_path / "raw", str(tmp_path / "house")
    make_period(raw, 1)
    make_period(raw, 2)
    assert files.discover_periods(spark, str(raw)) == ["2025-01", "2025-02"] and files.latest_period(spark, str(raw)) == "2025-02"
    for period in ("2025-01", "2025-02", "2025-02"):
        run_period(spark, str(raw), period, house)
    star = load_star(spark, house)
    counts = {t: df.count() for t, df in star.items()}
    assert counts["fact_sales"] == 4 and counts["fact_bank_transactions"] == 2 and counts["fact_payments"] == 2
    assert counts["dim_product"] == 2 and counts["dim_customer"] == 1 and counts["dim_order"] == 2 and counts["dim_time"] == 4018
    assert counts["dim_product_catalog"] == 1 and counts["dim_geography"] == 1 and counts["fact_deposits"] == 2
    sales = star["fact_sales"]
    assert sales.filter("order_key is null or customer_key is null or product_key is null or geography_key is null").count() == 0
    assert star["fact_bank_transactions"].filter("product_catalog_key is null or bank_account_key is null").count() == 0
    assert float(star["fact_deposits"].first().deposit_amount) == 100.0
    for name, df in star.items():
        money = {f.name for f in df.schema if f.dataType.simpleString() == "decimal(15,2)"}
        assert money == set(STAR_MONEY.get(name, ())), name
    shares = {r.product_id: float(r.refund) for r in allocate(sales, star["fact_financial_transactions"]).collect()}
    assert shares == {"P1": 4.0, "P2": 8.0}


def test_unchanged_period_is_skipped(spark, tmp_path):
    raw, house, log = tmp_path / "raw", str(tmp_path / "house"), str(tmp_path / "log")
    folder = make_period(raw, 1)
    run = lambda **kw: ingest.run_period_if_changed(spark, str(raw), "2025-01", house, log, **kw)
    assert run() and not run() and run(force=True)
    with (folder / "EtsyDeposits2025-1.csv").open("a") as f:
        f.write('"January 30, 2025","$5","USD","paid"\r\n')
    assert run() and not run()
    assert load_star(spark, house, ["fact_deposits"])["fact_deposits"].count() == 2


def test_missing_header_stops_the_load(spark, tmp_path):
    write(tmp_path / "raw" / "2025-01" / "EtsyDeposits2025-1.csv", ["Date", "Sum"], [["x", "1"]])
    with pytest.raises(ValueError, match="Amount"):
        run_period(spark, str(tmp_path / "raw"), "2025-01", str(tmp_path / "house"))


def test_manifest_wins_and_files_are_concatenated(spark, tmp_path):
    d = tmp_path / "2025-03"
    write(d / "EtsyDeposits2025-3.csv", ["Date", "Amount"], [["a", "1"]])
    write(d / "one.csv", ["Date", "Amount"], [["b", "2"]])
    write(d / "two.csv", ["Amount", "Status"], [["3", "s"]])
    assert files.load_dataset(spark, str(tmp_path), "2025-03", "deposits").first().Amount == "1"
    (d / "manifest.json").write_text('{"deposits": [{"filename": "one.csv"}, {"filename": "two.csv"}, {"filename": "gone.csv"}]}')
    rows = files.load_period(spark, str(tmp_path), "2025-03")["deposits"].orderBy("Amount").collect()
    assert [(r.Date, r.Amount, r.Status) for r in rows] == [("b", "2", None), (None, "3", "s")]
    assert files.load_dataset(spark, str(tmp_path), "2025-03", "nothing") is None
    assert files.scan_csv(spark, str(d / "gone.csv")) is None


def test_bank_export_preamble(spark, tmp_path):
    write(tmp_path / "b1.csv", BANK, [["10/01/2025", "R1", "N1", "5", "x"], [None] * 5], preamble=[["Bank", "of"], ["page 1"]])
    write(tmp_path / "b2.csv", ["A", "B"], [["1", "2"]])
    rows = bank_export.read_bank_export(spark, str(tmp_path / "b1.csv")).collect()
    assert len(rows) == 1 and rows[0][BANK[4]] == "x"
    assert bank_export.read_bank_export(spark, str(tmp_path / "b2.csv")).first().asDict() == {"A": "1", "B": "2"}


def test_bank_exports_of_two_layouts(spark, tmp_path):
    """Line breaks in cells, blank cells between, 70 columns, and rows in the order of the file."""
    filler = [f"h{i}" for i in range(69)]
    (tmp_path / "a.csv").write_text('Bank,"Main\noffice"\n\nDate,Description,Amount\n1,"line one\nline two, ""q""",5\n2,,\n,,\n3,x,7,,\n')
    (tmp_path / "b.csv").write_text("\n".join([",".join(["Diễn giải", *filler]), ",".join(["z", *["" if i % 2 else str(i) for i in range(69)]])]) + "\n")
    read = bank_export.read_bank_export(spark, str(tmp_path / "*.csv"), positions=True)
    rows = sorted(read.collect(), key=lambda r: r._input)
    assert [(r.Date, r.Description, r.Amount) for r in rows[:3]] == [("1", 'line one\nline two, "q"', "5"), ("2", None, None), ("3", "x", "7")]
    assert (rows[3]["Diễn giải"], rows[3].h67, rows[3].h68) == ("z", None, "68") and len(read.columns) == 74
    assert rows[0].h0 is None
    plan = read._jdf.queryExecution().toString()
    assert "FileScan csv" not in plan  # parsed once, before
    by_line = bank_export.read_bank_export(spark, str(tmp_path / "b.csv"), multi_line=False)
    assert by_line.first().h68 == "68"


def test_bank_export_wider_than_its_header(spark, tmp_path):
    (tmp_path / "wide.csv").write_text("Date,Description\n1,2,,4\n")
    with pytest.raises(Exception, match="more cells than the header"):
        bank_export.read_bank_export(spark, str(tmp_path / "wide.csv")).collect()
    (tmp_path / "bare.csv").write_text("Date,Description\n")
    assert bank_export.read_bank_export(spark, str(tmp_path / "bare.csv")).count() == 0


def test_first_row_of_a_key_is_the_first_in_the_files(spark, tmp_path):
    d = tmp_path / "2025-03"
    head = ["Product line ID", "Product line", "Product ID", "Product", "Variant ID", "Variants"]
    write(d / "b_product_catalog.csv", head, [["L", "l", "P", "zeta", "01", "v"], ["L", "l", "P", "alpha", "01", "v"], ["L", "l", "Q", "omega", "01", "v"]])
    write(d / "a_product_catalog.csv", head, [["L", "l", "Q", "mid", "01", "v"], ["L", "l", "Q", "beta", "01", "v"]])
    raw = files.load_period(spark, str(tmp_path), "2025-03", positions=True)["product_catalog"]
    cleaned = clean_product_catalog(raw)
    assert {r.product_id: r.product_name for r in cleaned.collect()} == {"P": "zeta", "Q": "mid"}
    (d / "manifest.json").write_text('{"product_catalog": [{"filename": "b_product_catalog.csv"}, {"filename": "a_product_catalog.csv"}]}')
    raw = files.load_period(spark, str(tmp_path), "2025-03", positions=True, single_line=["product_catalog"])["product_catalog"]
    assert {r.product_id: r.product_name for r in clean_product_catalog(raw).collect()} == {"P": "zeta", "Q": "omega"}
    assert "_input" not in files.load_period(spark, str(tmp_path), "2025-03")["product_catalog"].columns


def test_header_rules():
    assert validate.validate_columns("statement", [" date", "TYPE ", "Currency", "net"]) == []
    assert len(validate.validate_columns("statement", ["Date"])) == 3
    assert validate.validate_columns("bank_transactions", ["Diễn giải"]) == []
    assert validate.validate_columns("bank_transactions", ["x"]) != []
    assert validate.validate_columns("product_catalog", ["Product line ID", "Product line", "Product ID", "Product", "Variant ID"]) == ["missing one of: Variant Name, Variants"]
    assert validate.validate_columns("unknown", []) == []


def test_stream_reads_new_files_only(spark, tmp_path):
    raw, target, marks = tmp_path / "raw", str(tmp_path / "out"), str(tmp_path / "marks")
    columns = ["Date", "Amount"]

    def run():
        ingest.ingest_files(spark, str(raw), "deposits", columns, target, marks)
        return spark.read.parquet(target)

    write(raw / "2025-01" / "EtsyDeposits2025-1.csv", columns, [["a", "1"], ["b", "2"]])
    assert run().count() == 2 and run().count() == 2
    write(raw / "2025-02" / "EtsyDeposits2025-2.csv", columns, [["c", "3"]])
    assert sorted((r.period, r.Amount) for r in run().collect()) == [("2025-01", "1"), ("2025-01", "2"), ("2025-02", "3")]
    assert {r.batch for r in run().select("batch").distinct().collect()} == {0, 1}


def _rows(star):
    """Every stored table as sorted rows, without load times and batch names."""
    stamps = {"created_date", "updated_date", "created_timestamp", "updated_timestamp", "effective_date"}
    return {t: sorted(map(repr, df.select(*sorted(set(df.columns) - stamps)).collect())) for t, df in star.items()}


def test_streamed_files_give_the_star_of_the_batch_load(spark, tmp_path, monkeypatch):
    raw, batch, streamed = tmp_path / "raw", str(tmp_path / "batch"), str(tmp_path / "streamed")
    marks, ledger = str(tmp_path / "marks"), str(tmp_path / "ledger")
    run = lambda: ingest.stream_star(spark, str(raw), streamed, marks, ledger)
    make_period(raw, 1)
    run_period(spark, str(raw), "2025-01", batch)
    run()
    assert _rows(load_star(spark, streamed)) == _rows(load_star(spark, batch))
    make_period(raw, 2)
    run_period(spark, str(raw), "2025-02", batch)
    # the driver stops in the middle of the second batch: after some tables, before the ledger
    real, calls = ingest.run_period, []

    def stop(*args):
        calls.append(args[2])
        real(*args)
        raise RuntimeError("stopped")

    monkeypatch.setattr(ingest, "run_period", stop)
    with pytest.raises(Exception, match="stopped"):
        run()
    monkeypatch.setattr(ingest, "run_period", real)
    run()  # the same batch again
    want = _rows(load_star(spark, batch))
    assert calls == ["2025-02"] and _rows(load_star(spark, streamed)) == want
    entries = spark.read.parquet(ledger)
    assert sorted({(r.batch, r.period) for r in entries.collect()}) == [(0, "2025-01"), (1, "2025-02")] and entries.count() == 16
    run()  # nothing new
    files_of = entries.filter("batch = 1").drop("batch")
    assert ingest.load_batch(spark, str(raw), files_of, 1, streamed, ledger) == []
    assert ingest.load_batch(spark, str(raw), files_of, 2, streamed, ledger) == ["2025-02"]
    assert _rows(load_star(spark, streamed)) == want


def test_deletes(spark):
    days = build_dim_time(spark, "2025-01-01", "2025-12-31")
    fact = spark.createDataFrame([(1, 20250131, "6211", "N1"), (2, 20250201, "6211", "N2"), (3, None, None, None), (4, 20990101, "6211", "N1")], "bank_transaction_key long, transaction_date_key int, pl_account_number string, account_number string")
    keys = lambda df: sorted(r.bank_transaction_key for r in df.collect())
    assert keys(X.delete_bank_period(fact, days, "2025-01")) == [2, 3, 4]
    assert keys(X.delete_bank_by_accounts(fact, days, "2025-01-01", "2025-12-31", ["6211"])) == [3, 4]
    assert keys(X.delete_bank_by_accounts(fact, days, "2025-01-01", "2025-12-31", ["6211"], "N2")) == [1, 3, 4]
    assert keys(X.delete_by_ids(fact, "bank_transaction_key", [1, 2])) == [3, 4] and keys(X.delete_by_ids(fact, "bank_transaction_key", [])) == [1, 2, 3, 4]


def test_rewrite_reads_and_overwrites_one_path(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_table(spark.range(10), path)
    sinks.rewrite_table(spark.read.parquet(path).filter("id < 3"), path)
    assert spark.read.parquet(path).count() == 3


@pytest.mark.parametrize("stop", ["before commit", 0, 1, 2, "after"])
def test_a_stopped_rewrite_reads_as_old_or_new(spark, tmp_path, monkeypatch, stop):
    """Months 1 to 3 lose their odd rows, month 2 all; month 4 is not touched. The driver stops at each step in turn."""
    path = str(tmp_path / "fact_deposits")
    days = [(20250100 + 100 * (i % 4) + 1 + i // 4, i) for i in range(40)]
    rows = spark.createDataFrame(days, "deposit_date_key int, n int")
    sinks.append_fact(rows, path, "fact_deposits")
    read = lambda: sorted(r.n for r in swap.read_table(spark, path).collect())
    old = list(range(40))
    new = [n for n in old if n % 4 == 3 or (n % 4 != 1 and n % 2 == 0)]

    class Stop(Exception):
        pass

    real_move, moved = swap._move, []

    def move(*args):
        if len(moved) == stop:
            raise Stop
        moved.append(args)
        real_move(*args)

    def no_commit(*args):
        raise Stop

    monkeypatch.setattr(swap, "_move", move)
    if stop == "before commit":
        monkeypatch.setattr(swap, "commit", no_commit)
    try:
        sinks.rewrite_months(spark, path, "2025-01", "2025-03", lambda r: r.filter("month <> 2 and n % 2 = 0"))
    except Stop:
        pass
    assert read() == (old if stop == "before commit" else new)
    monkeypatch.undo()
    swap.finish(spark, path)
    assert read() == (old if stop == "before commit" else new)
    assert swap.pending(spark, path) is None
    if stop == "after":
        assert sorted(r.n for r in spark.read.parquet(path).collect()) == new


@pytest.mark.parametrize("moves", [0, 1])
def test_a_stopped_table_or_period_reads_whole(spark, tmp_path, monkeypatch, moves):
    table, fact = str(tmp_path / "dim"), str(tmp_path / "fact_deposits")
    sinks.write_table(spark.range(10), table)
    rows = lambda n: spark.createDataFrame([(20250101 + i, i + 100 * n) for i in range(3)], "deposit_date_key int, n int")
    for period in (1, 2):
        sinks.write_fact_period(rows(period), fact, "fact_deposits", f"2025-0{period}")
    real = swap._move
    left = [moves, moves]

    def move(spark_, source, target):
        k = target != table
        if not left[k]:
            raise OSError("stopped")
        left[k] -= 1
        real(spark_, source, target)

    monkeypatch.setattr(swap, "_move", move)
    for work in (lambda: sinks.rewrite_table(spark.range(3), table), lambda: sinks.write_fact_period(rows(7), fact, "fact_deposits", "2025-02")):
        try:
            work()
        except OSError:
            pass
    monkeypatch.undo()
    for _ in range(2):
        assert sorted(r.id for r in swap.read_table(spark, table).collect()) == [0, 1, 2]
        assert sorted(r.n for r in swap.read_table(spark, fact).collect()) == [100, 101, 102, 700, 701, 702]
        assert set(swap.read_table(spark, fact).columns) == {"deposit_date_key", "n", "period", "year", "month"}
        swap.finish(spark, table)
        swap.finish(spark, fact)
    sinks.write_fact_period(rows(1).limit(0), fact, "fact_deposits", "2025-02")
    assert sorted(r.n for r in swap.read_table(spark, fact).collect()) == [100, 101, 102]
    swap.commit(spark, table, str(tmp_path / "x"), [""])
    with pytest.raises(OSError, match="pending"):
        swap.commit(spark, table, str(tmp_path / "y"), [""])


def test_csv_export_quotes(spark, tmp_path):
    path = str(tmp_path / "c")
    sinks.export_csv(spark.createDataFrame([('a "b", c', None)], "x string, y string"), path)
    assert files.scan_csv(spark, path).first().x == 'a "b", c'


def test_shared_dir_is_the_one_the_session_names(spark):
    class Named:
        class conf:  # noqa: N801
            @staticmethod
            def get(name, default=None):
                return "/shared/folder" if name == "spark.checkpoint.dir" else default

    assert shared_dir(Named()) == "/shared/folder"
    assert shared_dir(spark) == shared_dir(spark)
