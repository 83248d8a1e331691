import datetime as dt

import pytest

from shopledger.operators import versions as V

KEYS = ("code", "version_key", ["city", "zip"])


def table(spark, rows):
    return spark.createDataFrame(rows, "code string, city string, zip string, note string")


def state(df):
    return sorted((r.code, r.city, r.zip, str(r.effective_date), str(r.expiry_date), r.is_current) for r in df.collect())


def test_changed_keys_are_closed_and_opened(spark):
    first = V.first_versions(table(spark, [("a", "X", None, "n"), ("b", "Y", "1", "n"), ("c", "Z", "2", "n"), (None, "?", None, "n")]), *KEYS)
    second = table(spark, [("a", "X", None, "other note"), ("b", "Y2", "1", "n"), ("d", "W", None, "n"), (None, "?", None, "n")])
    merged = V.merge_versions(first, second, *KEYS, "2025-03-01")
    end = "2262-04-11"
    want = [
        ("a", "X", None, "1900-01-01", end, True),
        ("b", "Y", "1", "1900-01-01", "2025-03-01", False),
        ("b", "Y2", "1", "2025-03-01", end, True),
        ("c", "Z", "2", "1900-01-01", end, True),
        ("d", "W", None, "2025-03-01", end, True),
    ]
    assert state(merged) == sorted(want, key=repr) or state(merged) == sorted(want, key=lambda r: (r[0], r[1]))
    keys = [r.version_key for r in merged.collect()]
    assert sorted(keys) == [1, 2, 3, 4, 5]
    again = V.merge_versions(merged, second, *KEYS, "2025-04-01")
    assert state(again) == state(merged) and sorted(r.version_key for r in again.collect()) == sorted(keys)
    back = V.merge_versions(merged, table(spark, [("b", "Y", "1", "n")]), *KEYS, "2025-05-01")
    assert [r[3:] for r in state(back) if r[0] == "b" and r[1] == "Y"] == [("1900-01-01", "2025-03-01", False), ("2025-05-01", end, True)]


def test_null_and_text_null_differ(spark):
    first = V.first_versions(table(spark, [("a", None, "1", "n")]), *KEYS)
    assert V.merge_versions(first, table(spark, [("a", "null", "1", "n")]), *KEYS, "2025-01-01").count() == 2
    assert V.merge_versions(first, table(spark, []), *KEYS, "2025-01-01").count() == 1


def test_facts_find_the_version_of_their_day(spark):
    first = V.first_versions(table(spark, [("a", "X", None, "n")]), *KEYS, since="2025-01-01")
    merged = V.merge_versions(first, table(spark, [("a", "Y", None, "n"), ("b", "W", None, "n")]), *KEYS, "2025-03-01")
    days = [("a", dt.date(2024, 12, 31)), ("a", dt.date(2025, 1, 1)), ("a", dt.date(2025, 2, 28)), ("a", dt.date(2025, 3, 1)), ("b", dt.date(2025, 2, 1)), ("b", dt.date(2025, 3, 2)), (None, dt.date(2025, 3, 2)), ("a", None)]
    fact = spark.createDataFrame(days, "code string, day date")
    found = V.version_of(fact, merged, "code", "day", ["city"])
    assert found.columns == ["code", "day", "city"]
    got = {(r.code, r.day): r.city for r in found.collect()}
    assert list(map(got.get, days)) == [None, "X", "X", "Y", None, "W", None, None] and found.count() == len(days)


@pytest.mark.parametrize("day", ["2025-01-01"])
def test_two_changes_on_one_day_keep_the_last_state(spark, day):
    first = V.first_versions(table(spark, [("a", "X", None, "n")]), *KEYS)
    once = V.merge_versions(first, table(spark, [("a", "Y", None, "n")]), *KEYS, day)
    twice = V.merge_versions(once, table(spark, [("a", "Z", None, "n")]), *KEYS, day)
    fact = spark.createDataFrame([("a", dt.date(2025, 1, 1))], "code string, day date")
    assert [r.city for r in V.version_of(fact, twice, "code", "day", ["city"]).collect()] == ["Z"]
