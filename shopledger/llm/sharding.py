"""Minimax contiguous sharding: the smallest shard capacity that lets ordered, unsplittable groups fall into N shards.

Groups (rows with equal text) are ordered by their smallest id. The binary search for the capacity, with a greedy check per
step, needs only the places where one group ends (boundaries, as running sums of bytes). All boundaries do not fit on the
driver, so they are read at growing detail:

1. The running sum is cut into ``CELLS`` equal cells; each gives its first and last boundary. Cutting only at these is
   feasible at an upper capacity; letting cuts fall anywhere in a cell gives a lower one.
2. The greedy cuts of the true optimum lie between those of the two. Boundaries in these short intervals are read next, again
   by cells if there are more than ``CELLS`` of them, until all are known and both capacities meet.

What is collected is bounded by the cells and the shard count. Everything on rows is DataFrame work.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import through_table
from .common import read_table

SHARDS = 40
ROW_BYTES = 16
CELLS = 16_384
#: Sub-buckets of a shard in which rows are numbered.
SLOT_BUCKETS = 64


def greedy_cuts(known: list[int], capacity: int, shards: int, upper: list[int] | None = None) -> list[int]:
    """Furthest cuts with at most ``capacity`` between neighbours, until the end or ``shards`` cuts.

    ``upper`` (same length): how far a cut at or below a known boundary may lie at most; used for the lower capacity.
    """
    cuts, at, end = [], 0, known[-1]
    while at < end and len(cuts) < shards:
        i = bisect_right(known, at + capacity) - 1
        reach = known[i]
        if upper is not None:
            reach = max(reach, min(upper[i], at + capacity))
        if reach <= at:
            break
        cuts.append(reach)
        at = reach
    return cuts


def smallest_capacity(known: list[int], shards: int, low: int, upper: list[int] | None = None) -> int:
    """Binary search for the smallest capacity whose greedy cuts reach the end."""
    high = known[-1]
    while low < high:
        mid = (low + high) // 2
        cuts = greedy_cuts(known, mid, shards, upper)
        if cuts and cuts[-1] == known[-1]:
            high = mid
        else:
            low = mid + 1
    return low


def balanced_cuts(known: list[int], capacity: int, shards: int) -> list[int]:
    """Cuts within ``capacity`` near equal shares of what is left; the greedy cuts show that it can be done."""
    latest = [known[-1]]  # latest[-k]: first place from which k - 1 shards reach the end
    for _ in range(shards - 1):
        i = bisect_right(known, latest[-1] - capacity - 1)
        latest.append(known[min(i, len(known) - 1)])
    latest.reverse()
    cuts, at = [], 0
    for shard in range(shards - 1):
        aim = at + (known[-1] - at) / (shards - shard)
        i = bisect_right(known, aim)
        near = [known[j] for j in (i - 1, i) if 0 <= j < len(known)]
        best = min(near, key=lambda b: abs(b - aim))
        most = known[bisect_right(known, at + capacity) - 1]
        at = min(max(best, latest[shard], at), max(most, at))
        cuts.append(at)
    return [*cuts, known[-1]]


def ordered_groups(rows: DataFrame) -> DataFrame:
    """(group_key, first_id, bytes, upto): groups in the order of their smallest id with the running sum of bytes. Stored."""
    spark = rows.sparkSession
    groups = rows.groupBy("group_key").agg(F.min("doc_id").alias("first_id"), F.sum("size").alias("bytes"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # ranges of the order, fixed by writing them
    ranged = through_table(groups.repartitionByRange(parts, "first_id", "group_key").withColumn("part", F.spark_partition_id()), "groups")
    sums = ranged.groupBy("part").agg(F.sum("bytes").alias("bytes")).collect()  # a row per partition
    before, total = [], 0
    for part, n in sorted((r["part"], r["bytes"]) for r in sums):
        before.append((part, total))
        total += n
    shift = F.broadcast(spark.createDataFrame(before, "part int, before long"))
    order = Window.partitionBy("part").orderBy("first_id", "group_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return through_table(ranged.join(shift, "part").select("group_key", "first_id", "bytes", (F.col("before") + F.sum("bytes").over(order)).alias("upto")), "ordered")


def shard_cuts(groups: DataFrame, shards: int, cells: int = CELLS) -> tuple[int, list[int]]:
    """(smallest capacity, ends of the shards as running sums) for stored ``groups`` (bytes, upto)."""
    total, largest = groups.agg(F.max("upto"), F.max("bytes")).first()
    if total is None:
        return 0, [0] * shards

    def summary(intervals: list[tuple[int, int]], width: int) -> list[tuple[int, int, int]]:
        """(first, last, number) of boundaries per cell of ``width`` inside the intervals."""
        inside = F.lit(False)
        for a, b in intervals:
            inside = inside | F.col("upto").between(a, b)
        found = groups.filter(inside).groupBy(F.floor(F.col("upto") / width).alias("cell"))
        return sorted(tuple(r)[1:] for r in found.agg(F.min("upto"), F.max("upto"), F.count("*")).collect())

    known, spans = {0, total}, []
    intervals, width = [(1, total)], 2 * total
    least = max(largest, -(-total // shards))
    while True:
        # finer each time: the intervals shared out over the cells, half the width before at most
        width = max(1, min(width // 2, -(-sum(b - a + 1 for a, b in intervals) // cells)))
        cells_read = summary(intervals, width)
        spans = [s for s in spans if not any(a <= s[0] and s[1] <= b for a, b in intervals)] + [(f, e) for f, e, n in cells_read if n > 2]
        known |= {b for f, e, _ in cells_read for b in (f, e)}
        places = sorted(known)
        upper = {f: e for f, e in spans}  # between f and e there may be boundaries not known yet
        reach = [upper.get(b, b) for b in places]
        high = smallest_capacity(places, shards, least)
        low = smallest_capacity(places, shards, least, reach)
        if low == high or not spans:
            return high, balanced_cuts(places, high, shards)
        # cut j of the optimum is no less than that of the lower capacity at known places, no more than that of the upper anywhere
        near, far = greedy_cuts(places, low, shards), greedy_cuts(places, high, shards, reach)
        near += [near[-1] if near else 0] * (len(far) - len(near))
        intervals = [s for s in spans if any(a <= s[1] and s[0] <= b for a, b in zip(near, far, strict=False))]
        if not intervals:
            return high, balanced_cuts(places, high, shards)
        intervals = _merged(intervals)


def _merged(intervals: list[tuple[int, int]], most: int = 64) -> list[tuple[int, int]]:
    """Sorted intervals, the closest joined until at most ``most`` are left."""
    out = sorted(intervals)
    while len(out) > most:
        i = min(range(len(out) - 1), key=lambda k: out[k + 1][0] - out[k][1])
        out[i : i + 2] = [(out[i][0], out[i + 1][1])]
    return out


def shard_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row of ``docs``, law ``bytes``.

    Rows with equal texts share a shard; a null text counts as an empty one. Null ids are ordered before all others, repeated
    rows are rows of their own. ``slot`` numbers a shard's rows without gaps; which row of equal ids comes first does not
    matter. Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = through_table(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.sha2(text, 256).alias("group_key"),
        ),
        "rows",
    )
    groups = ordered_groups(rows)
    _, ends = shard_cuts(groups, shards)
    # the shard of a group is the number of shard ends before its own end
    shard = sum([(F.col("upto") > e).cast("int") for e in ends[:-1]], F.lit(0))
    placed = rows.join(groups.select("group_key", shard.alias("shard")), "group_key")
    placed = through_table(placed.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "group_key"), F.lit(SLOT_BUCKETS)).cast("int")).drop("group_key"), "placed")
    counts = placed.groupBy("shard", "bucket").count().collect()  # shards x buckets rows
    before, filled = [], {}
    for s, b, n in sorted(tuple(c) for c in counts):
        before.append((s, b, filled.get(s, 0)))
        filled[s] = filled.get(s, 0) + n
    shift = F.broadcast(spark.createDataFrame(before, "shard int, bucket int, before long"))
    number = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32"))
    return placed.join(shift, ["shard", "bucket"]).select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + number - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))


QUERIES = {"op7_sharding": op7_sharding}
ORACLE_SQL: dict[str, str] = {}
