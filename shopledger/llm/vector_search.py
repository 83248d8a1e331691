"""Exact top-k search by inner product, with segment statistics as bounds.

A vector is cut into segments; of each, the mean and the deviation (root of the summed squares around the mean) are kept. For a
segment of length n, the inner product is n * mean * mean' plus that of the residuals, which is at most the product of the
deviations. Summed over segments this bounds the score from above (the distance from below). Few long segments are coarse
and cheap, many short ones fine.

Vectors are packed into blocks and read where they lie, once per batch of queries; a batch has a bounded size and is sent to
every task with its statistics. A task walks through its blocks and holds, per query of the batch, the k-th best exact score
so far: the floor. In a block the coarse bounds of all pairs are compared with the floors; pairs that stay are thinned out by
the finer bounds, level by level, and scored exactly. What reaches the floor is emitted, and raises it. The emitted scores
are ranked per query at the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import through_table
from .common import read_table, ship_package

K = 5
SCALE = 256
EVERY = 50
LEVELS = (4, 16, 32)
BLOCK = 2048
#: Queries of a batch: what is collected and sent to every task, 8 bytes a component and as much for the statistics.
BATCH = 16_384
QUERY_BLOCK = 1024
#: Share of pairs that the coarse bounds leave, from which on a block is scored as a whole.
WEAK = 0.25
#: Sums of products up to this size are exact as doubles.
EXACT = 2.0**53
#: Scores are ranked up to this size; larger ones are ties.
WIDEST = 10**38 - 1


def pack_blocks(vectors: DataFrame, id_col: str, vector_col: str, scale: int, size: int) -> DataFrame:
    """(dim, n, ids, data): usable vectors as packed doubles that are whole numbers, ``size`` at most in a block."""
    ship_package(vectors.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[list, list]] = {}

        def block(dim: int) -> pa.RecordBatch:
            ids, rows = waiting.pop(dim)
            data = np.array(rows, np.float64)
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "n": pa.array([len(ids)], pa.int32()), "ids": pa.array([np.array(ids, np.int64).tobytes()]), "data": pa.array([data.tobytes()])})

        for batch in batches:
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if key is None or not vector or None in vector:
                    continue
                given = np.array(vector, np.float64)
                if not np.isfinite(given).all():
                    continue
                ids, rows = waiting.setdefault(len(vector), ([], []))
                ids.append(key)
                rows.append(np.floor(given * scale))
                if len(ids) >= size:
                    yield block(len(vector))
        for dim in list(waiting):
            yield block(dim)

    packed = vectors.select(F.col(id_col).cast("long"), F.col(vector_col)).mapInArrow(pack, "dim int, n int, ids binary, data binary")
    return packed


def segment_features(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Per segment sqrt(n) * mean, and the deviation; a last, shorter segment is filled with its own mean (nothing changes)."""
    cuts = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    means, deviations = [], []
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = x[:, a:b].astype(np.float64)
        mean = part.mean(axis=1)
        means.append(mean * np.sqrt(b - a))
        deviations.append(np.sqrt(((part - mean[:, None]) ** 2).sum(axis=1)))
    return np.stack(means, 1), np.stack(deviations, 1)


class Block:
    """Vectors with their statistics at every level: means and deviations side by side, so that one product bounds a score."""

    def __init__(self, ids: bytes, data: bytes, dim: int):
        self.ids, self.x = np.frombuffer(ids, np.int64), np.frombuffer(data, np.float64).reshape(-1, dim)
        self.largest = float(np.abs(self.x).max(initial=0))
        with np.errstate(over="ignore", invalid="ignore"):
            self.levels = [np.concatenate(segment_features(self.x, n), axis=1) for n in LEVELS if n < dim or n == LEVELS[0]]


def _slack(q: np.ndarray, x: np.ndarray, dim: int) -> float:
    """More than rounding can take from a bound: the sums have 2 * dim products at most."""
    return 1e-12 * dim * float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1] + 1


def exact_scores(q: Block, x: Block, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Inner products of pairs: doubles where they are exact, else Python integers."""
    if q.largest * x.largest * q.x.shape[1] < EXACT:
        return np.einsum("pd,pd->p", q.x[rows], x.x[columns])
    whole = [[int(v) for v in r] for r in q.x], [[int(v) for v in r] for r in x.x]
    return np.array([sum(a * b for a, b in zip(whole[0][i], whole[1][j], strict=True)) for i, j in zip(rows.tolist(), columns.tolist(), strict=True)], object)


def surviving_pairs(q: Block, x: Block, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of the pairs that no bound and no score puts below the query's floor.

    Each level is computed for the pairs left. Where a level leaves nearly all of them (vectors without structure), finer ones
    would not pay: then the scores are taken as one product of the blocks, which is how many pairs are scored cheapest.
    """
    dim = q.x.shape[1]
    with np.errstate(over="ignore", invalid="ignore"):
        bounds = q.levels[0] @ x.levels[0].T
        bounds += _slack(q.levels[0], x.levels[0], dim)
        alive = ~(bounds < floors[:, None])  # not below: a bound that overflowed decides nothing
        if alive.mean() > WEAK and q.largest * x.largest * dim < EXACT:
            scores = q.x @ x.x.T
            alive &= scores >= floors[:, None]
            rows, columns = np.nonzero(alive)
            other = q.ids[rows] != x.ids[columns]
            rows, columns = rows[other], columns[other]
            return rows, columns, scores[rows, columns]
        rows, columns = np.nonzero(alive & (q.ids[:, None] != x.ids[None, :]))
        for q_level, x_level in zip(q.levels[1:], x.levels[1:], strict=True):
            slack = _slack(q_level, x_level, dim)
            stay = np.concatenate([~(np.einsum("pd,pd->p", q_level[r], x_level[c]) + slack < floors[r]) for r, c in _parts(rows, columns)] or [np.empty(0, bool)])
            rows, columns = rows[stay], columns[stay]
    scores = np.concatenate([exact_scores(q, x, r, c) for r, c in _parts(rows, columns)] or [np.empty(0)])
    high = np.array(scores >= floors[rows], bool)
    return rows[high], columns[high], scores[high]


def _parts(rows: np.ndarray, columns: np.ndarray, size: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for at in range(0, len(rows), size):
        yield rows[at : at + size], columns[at : at + size]


class Search:
    """The best ``k`` of one block of queries over the blocks that a task has seen."""

    def __init__(self, queries: Block, k: int):
        self.queries, self.k = queries, k
        self.best: list[list] = [[] for _ in queries.ids]  # ascending scores, k at most
        self.floors = np.full(len(queries.ids), -np.inf)

    def seed(self, x: Block) -> None:
        """Floors from one block: the best by the coarse bound are scored first."""
        take = min(self.k + 1, len(x.ids))
        with np.errstate(over="ignore", invalid="ignore"):
            bounds = np.nan_to_num(self.queries.levels[0] @ x.levels[0].T, nan=np.inf)
        bounds[self.queries.ids[:, None] == x.ids[None, :]] = -np.inf
        probe = np.argpartition(-bounds, take - 1, axis=1)[:, :take]
        rows, columns = np.repeat(np.arange(len(probe)), take), probe.ravel()
        scores = np.concatenate([exact_scores(self.queries, x, r, c) for r, c in _parts(rows, columns)]).reshape(len(probe), take)
        for i, (found, at) in enumerate(zip(scores.tolist(), probe.tolist(), strict=True)):
            others = sorted(s for s, j in zip(found, at, strict=True) if self.queries.ids[i] != x.ids[j])
            if len(others) >= self.k:  # a lower limit only: the block itself is searched next
                self.floors[i] = max(self.floors[i], np.nextafter(float(others[-self.k]), -np.inf))

    def add(self, x: Block) -> Iterator[tuple[int, int, int]]:
        """(query, vector, score) of what may be among the best."""
        if not np.isfinite(self.floors).all():
            self.seed(x)
        rows, columns, scores = surviving_pairs(self.queries, x, self.floors)
        if not len(rows):
            return
        order = np.lexsort((x.ids[columns], -scores, rows))
        rows, columns, scores = rows[order], columns[order], scores[order]
        starts = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        for at, upto in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], strict=True):
            i, upto = int(rows[at]), min(upto, at + self.k)
            for j, score in zip(columns[at:upto].tolist(), scores[at:upto].tolist(), strict=True):
                yield int(self.queries.ids[i]), int(x.ids[j]), int(score)
            self.best[i] = sorted([*self.best[i], *scores[at:upto].tolist()])[-self.k :]
            if len(self.best[i]) == self.k:  # equal scores stay in: the smaller id wins
                self.floors[i] = max(self.floors[i], np.nextafter(float(self.best[i][0]), -np.inf))


def top_k(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = SCALE, block: int = BLOCK, query_block: int = QUERY_BLOCK, batch: int = BATCH) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` largest inner products, ties to the smaller id.

    Components are floor(scale * x). A vector that is null, empty, or has a null or non-finite component takes no part; nor do
    null ids. Vectors of another length are not candidates. A query is never its own candidate, also if its row is repeated;
    a repeated candidate row is listed as often as it occurs. Components of any size are scored exactly; a score that does not
    fit 64 bits keeps its rank and is given as null. Other columns are not read. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    data = through_table(pack_blocks(vectors, id_col, vector_col, scale, block), "vectors")
    asks = through_table(pack_blocks(queries.dropDuplicates([id_col]), id_col, vector_col, scale, query_block).withColumn("number", F.monotonically_increasing_id()), "queries")
    sizes = asks.select("number", "n").orderBy("number").collect()  # a row per block of queries
    batches, waiting = [], batch
    for r in sizes:
        if waiting + r["n"] > batch:
            batches.append([])
            waiting = 0
        batches[-1].append(r["number"])
        waiting += r["n"]
    found = []
    for numbers in batches:
        sent = spark.sparkContext.broadcast([(r["dim"], r["ids"], r["data"]) for r in asks.filter(F.col("number").isin(numbers)).collect()])

        def search(parts: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            searches = [(dim, Search(Block(ids, data_, dim), k)) for dim, ids, data_ in sent.value]
            for part in parts:
                for dim, ids, data_ in zip(*(part.column(c).to_pylist() for c in ("dim", "ids", "data")), strict=True):
                    x = Block(ids, data_, dim)
                    rows = [r for d, one in searches if d == dim for r in one.add(x)]
                    if rows:
                        query, vector, score = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_pydict({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(vector, pa.int64()), "score": pa.array([Decimal(s) if abs(s) < WIDEST else Decimal(WIDEST if s > 0 else -WIDEST) for s in score], pa.decimal128(38, 0))})

        scored = data.select("dim", "ids", "data").mapInArrow(search, "query_id long, vec_id long, score decimal(38,0)")
        found.append(through_table(scored, "scores"))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = reduce(DataFrame.union, found).withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.col("score").try_cast("long").alias("score"))


def op3_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


QUERIES = {"op3_vector_search": op3_vector_search}
ORACLE_SQL = {
    "op3_vector_search": """
        with v as (
            select vec_id, [floor(256 * cast(x as double)) for x in embedding] as e from embeddings
            where vec_id is not null and embedding is not null and len(embedding) > 0
              and len([x for x in embedding if x is null or not isfinite(x)]) = 0
        ),
        s as (
            select q.vec_id as query_id, c.vec_id as vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
            from v q join v c on c.vec_id <> q.vec_id and len(c.e) = len(q.e)
            where q.vec_id % 50 = 0
        ),
        r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
        select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 5
    """,
}
