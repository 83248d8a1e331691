"""A Merkle manifest of a dataset: every row gets its leaf, the root, and a proof, by butterfly exchange.

Order. Rows are range-partitioned by (language, id, leaf) and numbered inside each range, shifted by the ranges before: a
language that holds a third of all rows is spread like any other. Only digests travel, never texts.

Blocks. A tree's leaves are cut into aligned blocks of ``FANOUT ** BLOCK_LEVELS`` leaves. Each block hashes its own subtree.

Butterfly. Blocks then swap subtree roots round by round. In round r a block needs the roots of its aligned group of
``FANOUT`` nodes; it gets each from the partner whose block number differs from its own in digit r alone (at the ragged right
edge: from the last block that holds the node). It hashes the common parent itself, as all its partners do redundantly, and
keeps what stands left and right of its own node as the next step of its proof. After log(blocks) rounds every block knows the
tree's root and its own whole upper proof: nothing has to be sent down again. The trees' roots, in order, are the leaves of
the top tree, which goes through the same steps.

Proofs. A step of a path is the digests left and right of the own node, as text. A row's path is the steps inside its block, the
block's upper steps, and the steps from its tree's root to the top. Paths inside a block are rebuilt from the block's leaves
where they are used, so no table ever holds a path per row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, read_table, ship_package
from .line_dedup import numbered_keys

FANOUT = 8
#: Levels that a block hashes on its own: at most FANOUT ** BLOCK_LEVELS rows meet in one group.
BLOCK_LEVELS = 4
#: The fields of a leaf, in order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_EVERY = 3

_STEPS = "array<struct<left:string,right:string>>"


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def tree_key(lang: Column) -> Column:
    """A key that is never null and sorts like the language: null first, then by UTF-8 bytes."""
    return F.when(lang.isNull(), F.lit("")).otherwise(F.concat(F.lit("+"), lang))


def numbered_leaves(leaves: DataFrame, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """Leaves with (tree, pos, n): the number of the tree, the place in it and its size. Also the table of trees.

    ``leaves`` (key, doc_id, leaf, ...) is a stored table. Equal ids are ordered by their leaves; a null id comes first.
    """
    parts = int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = space.table(leaves.repartitionByRange(parts, "key", "doc_id", "leaf").withColumn("part", F.spark_partition_id()), "ranged")
    # one row for each range and each tree in it: the trees number themselves over the table of keys
    runs = space.table(ranged.groupBy("key", "part").agg(F.count("*").alias("rows")), "runs")
    trees = numbered_keys(runs.groupBy("key").agg(F.sum("rows").alias("n")), ["key"], parts, space)
    trees = space.table(trees.withColumnRenamed("rank", "tree"), "trees")
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0))).join(trees, "key").select("key", "part", "tree", "n", "start")
    inside = F.row_number().over(Window.partitionBy("key", "part").orderBy("doc_id", "leaf")) - 1
    placed = ranged.withColumn("inside", inside).join(starts, ["key", "part"])
    return placed.withColumn("pos", F.col("start") + F.col("inside")).drop("key", "part", "start", "inside"), trees


def block_levels(nodes: list[str], height: int) -> list[list[str]]:
    """The levels of a subtree, from its leaves up to the one node ``height`` levels above them."""
    levels = [nodes]
    for _ in range(height):
        below = levels[-1]
        levels.append([sha256_hex("".join(below[k : k + FANOUT])) for k in range(0, len(below), FANOUT)])
    return levels


def block_height(n: int, block_levels_: int) -> int:
    """Levels that a block of a tree of ``n`` leaves hashes: all of a small tree, else those of a whole block."""
    height = 0
    while height < block_levels_ and FANOUT**height < n:
        height += 1
    return height


def path_in_block(levels: list[list[str]], at: int) -> list[tuple[str, str]]:
    """(left, right) of leaf ``at`` at each level below the block's root."""
    path = []
    for nodes in levels[:-1]:
        first = at - at % FANOUT
        path.append(("".join(nodes[first:at]), "".join(nodes[at + 1 : first + FANOUT])))
        at //= FANOUT
    return path


def fold(leaf: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf and a path lead to."""
    for left, right in path:
        leaf = sha256_hex(left + leaf + right)
    return leaf


def block_roots(leaves: DataFrame, levels: int) -> DataFrame:
    """(tree, block, n, node): the root of each block's subtree. ``leaves`` (tree, block, pos, n, leaf)."""

    def root(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        n = group["n"][0].as_py()
        top = block_levels(group["leaf"].to_pylist(), block_height(n, levels))[-1][0]
        return pa.table({"tree": [group["tree"][0].as_py()], "block": [group["block"][0].as_py()], "n": [n], "node": [top]})

    return leaves.select("tree", "block", "pos", "n", "leaf").groupBy("tree", "block").applyInArrow(root, "tree long, block long, n long, node string")


def butterfly(roots: DataFrame, levels: int, space: Workspace) -> DataFrame:
    """(tree, block, node, steps): after the exchange every block has the tree's root and its upper steps. Stored."""
    leaves_of_block = FANOUT**levels
    # n becomes the number of blocks, then of nodes a level further up each round; a tree is done at one node
    state = roots.select("tree", "block", "node", F.array().cast(_STEPS).alias("steps"), F.ceil(F.col("n") / leaves_of_block).cast("long").alias("blocks"))
    state = space.table(state.withColumn("width", F.col("blocks")), "exchange")
    reach = 1  # blocks below one node of this round
    while not state.filter("width > 1").isEmpty():
        own = F.floor(F.col("block") / reach)
        first = own - own % FANOUT
        digits = F.sequence(F.lit(0), F.least(F.lit(FANOUT - 1), F.col("width") - 1 - first).cast("int"))
        wants = state.filter("width > 1").select("tree", "block", (own % FANOUT).alias("own"), F.explode(digits).alias("digit"), first.alias("first"), "blocks")
        partner = F.least((F.col("first") + F.col("digit")) * reach + F.col("block") % reach, F.col("blocks") - 1)
        sent = state.select("tree", F.col("block").alias("partner"), F.col("node").alias("got"))
        swapped = wants.withColumn("partner", partner).join(sent, ["tree", "partner"])
        nodes = F.array_sort(F.collect_list(F.struct("digit", "got")))  # at most FANOUT
        groups = swapped.groupBy("tree", "block", "own").agg(nodes.alias("nodes"))

        def side(keep) -> Column:
            return F.array_join(F.transform(F.filter("nodes", keep), lambda x: x["got"]), "")

        step = F.struct(side(lambda x: x["digit"] < F.col("own")).alias("left"), side(lambda x: x["digit"] > F.col("own")).alias("right"))
        parents = groups.select("tree", "block", F.sha2(side(lambda x: F.lit(True)), 256).alias("parent"), step.alias("step"))
        joined = state.join(parents, ["tree", "block"], "left")
        state = joined.select(
            "tree",
            "block",
            F.coalesce("parent", "node").alias("node"),
            F.when(F.col("parent").isNull(), F.col("steps")).otherwise(F.concat("steps", F.array("step"))).alias("steps"),
            "blocks",
            F.ceil(F.col("width") / FANOUT).cast("long").alias("width"),
        )
        state = space.table(state, "exchange")
        reach *= FANOUT
    return state


def with_paths(leaves: DataFrame, upper: DataFrame, levels: int, work: Callable[..., pa.Table], schema: str) -> DataFrame:
    """``work(columns of a block, sorted by place; path of a place; the upper row)`` for every block, with its upper steps.

    ``leaves`` (tree, block, pos, n, leaf, ...); ``upper`` (tree, block, steps, ...), one row per block.
    """
    ship_package(leaves.sparkSession)

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, above = left.sort_by("pos").to_pydict(), {name: right[name][0].as_py() for name in right.column_names}
        tree = block_levels(rows["leaf"], block_height(rows["n"][0], levels))
        steps = [(s["left"], s["right"]) for s in above["steps"]]
        return work(rows, lambda k: path_in_block(tree, k) + steps, above)

    return leaves.groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInArrow(one, schema)


def merkle_paths(leaves: DataFrame, levels: int, space: Workspace) -> tuple[DataFrame, DataFrame]:
    """``leaves`` (tree, pos, n, leaf, ...) cut into blocks, stored; and each block's (tree, block, node, steps)."""
    blocks = space.table(leaves.withColumn("block", F.floor(F.col("pos") / FANOUT**levels)), "leaves")
    return blocks, butterfly(block_roots(blocks, levels), levels, space)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, levels: int = BLOCK_LEVELS, tamper_every: int = TAMPER_EVERY) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): a row per row of ``docs``.

    ``fields`` names id, source, language, length and text, in the order in which a leaf takes them. Leaves ascend by id within
    their language; languages ascend by UTF-8 bytes, null first. ``proof_sha256`` digests the siblings from the leaf up to the
    root. ``folded_root`` is what the leaf as received leads to with the original siblings: of rows whose id's CRC-32 is
    divisible by ``tamper_every``, the letters A-Z of the text are received in lower case (a null text stays). Null in any field
    is marked as such in the leaf. Rows with a null id come first in their language and are not tampered with. Rows that
    repeat an id are leaves of their own, ordered by digest; equal rows are equal leaves next to each other. An empty table has
    no root and gives no rows. Other columns are not read.
    """
    ship_package(docs.sparkSession)
    space = Workspace(docs.sparkSession)
    columns = [F.col(f"`{c}`") for c in fields]
    identity, lang, text = columns[0], columns[2], columns[-1]
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(identity.cast("string").cast("binary")) % tamper_every == 0
    received = F.when(hit, leaf_digest([*columns[:-1], lower]))
    named = docs.select(tree_key(lang).alias("key"), identity.alias("doc_id"), leaf_digest(columns).alias("leaf"), received.alias("received"))
    numbered, trees = numbered_leaves(space.table(named, "digests"), space)
    leaves, upper = merkle_paths(numbered, levels, space)
    space.keep(leaves, upper, trees)
    # the trees' roots are the leaves of the top tree: every block has its tree's root, the first one hands it in
    many = F.lit(trees.count())
    first = upper.filter("block = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), many.alias("n"), F.col("node").alias("leaf"))
    tops, summit = merkle_paths(first, levels, space)

    def climb(rows: dict, path, above: dict) -> pa.Table:
        steps = [[{"left": a, "right": b} for a, b in path(k)] for k in range(len(rows["pos"]))]
        kinds = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        return pa.table({"tree": pa.array(rows["pos"], pa.int64()), "root": [above["node"]] * len(steps), "further": pa.array(steps, kinds)})

    roots = space.table(with_paths(tops, summit, levels, climb, f"tree long, root string, further {_STEPS}"), "roots")
    whole = upper.join(roots, "tree").select("tree", "block", F.col("node").alias("subroot"), "root", F.concat("steps", "further").alias("steps"))
    whole = space.table(whole, "proofs")
    space.keep(leaves, whole)

    def prove(rows: dict, path, above: dict) -> pa.Table:
        proofs, folded = [], []
        for k, (leaf, got) in enumerate(zip(rows["leaf"], rows["received"], strict=True)):
            steps = path(k)
            proofs.append(sha256_hex("".join(left + right for left, right in steps)))
            folded.append(fold(leaf if got is None else got, steps))
        same = len(folded)
        return pa.table(
            {
                "doc_id": pa.array(rows["doc_id"], pa.int64()),
                "leaf": rows["leaf"],
                "subroot": [above["subroot"]] * same,
                "root": [above["root"]] * same,
                "proof_sha256": proofs,
                "folded_root": folded,
                "verified": [f == above["root"] for f in folded],
            }
        )

    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return with_paths(leaves, whole, levels, prove, schema)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its leaf, the roots above it, the digest of its proof, and whether the received row verifies."""
    return manifest(read_table(spark, sf_dir, "documents"))


QUERIES = {"op12_merkle_manifest": op12_merkle_manifest}
ORACLE_SQL = {
    "op12_merkle_manifest": """
        with recursive given as (
            select doc_id, text, coalesce('+' || lang, '') as key,
                   concat_ws('', coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'),
                       coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-')) as head,
                   xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)),
                       lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda d, k: case when d & 1 = 1 then xor(d >> 1, 3988292384) else d >> 1 end))) as crc
            from documents
        ),
        received as (select *, case when crc % 3 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as got from given),
        digests as (
            select doc_id, key, sha256(head || coalesce(strlen(text) || ':' || text, '-')) as leaf, sha256(head || coalesce(strlen(got) || ':' || got, '-')) as start
            from received
        ),
        leaves as (select *, row_number() over (partition by key order by doc_id nulls first, leaf) - 1 as pos from digests),
        nodes as (
            select key, 0 as level, pos as idx, leaf as h from leaves
            union all
            select key, level + 1, idx // 8, sha256(string_agg(h, '' order by idx)) from (select *, count(*) over (partition by key) as n from nodes) where n > 1
            group by key, level, idx // 8
        ),
        subroots as (select key, arg_max(h, level) as subroot, max(level) as height from nodes group by key),
        tops as (
            select 0 as level, row_number() over (order by key) - 1 as idx, subroot as h from subroots
            union all
            select level + 1, idx // 8, sha256(string_agg(h, '' order by idx)) from (select *, count(*) over () as n from tops) where n > 1 group by level, idx // 8
        ),
        summit as (select arg_max(h, level) as root, max(level) as top_height from tops),
        below as (
            select key, level, idx, coalesce(string_agg(h, '') over (partition by key, level, idx // 8 order by idx rows between unbounded preceding and 1 preceding), '') as lefts,
                   coalesce(string_agg(h, '') over (partition by key, level, idx // 8 order by idx rows between 1 following and unbounded following), '') as rights from nodes
        ),
        above as (
            select level, idx, coalesce(string_agg(h, '') over (partition by level, idx // 8 order by idx rows between unbounded preceding and 1 preceding), '') as lefts,
                   coalesce(string_agg(h, '') over (partition by level, idx // 8 order by idx rows between 1 following and unbounded following), '') as rights from tops
        ),
        steps as (
            select l.key, l.pos, b.level as step, b.lefts, b.rights from leaves l join subroots s on s.key = l.key
            join below b on b.key = l.key and b.idx = l.pos // (8 ** b.level)::bigint and b.level < s.height
            union all
            select l.key, l.pos, s.height + a.level, a.lefts, a.rights from leaves l
            join (select *, row_number() over (order by key) - 1 as place from subroots) s on s.key = l.key
            join above a on a.idx = s.place // (8 ** a.level)::bigint join summit t on a.level < t.top_height
        ),
        proofs as (select key, pos, string_agg(lefts || rights, '' order by step) as proof from steps group by key, pos),
        folded as (
            select key, pos, 0 as step, start as h from leaves
            union all
            select f.key, f.pos, f.step + 1, sha256(s.lefts || f.h || s.rights) from folded f join steps s on s.key = f.key and s.pos = f.pos and s.step = f.step
        ),
        ends as (select key, pos, arg_max(h, step) as folded_root from folded group by key, pos)
        select l.doc_id, l.leaf, s.subroot, t.root, sha256(coalesce(p.proof, '')) as proof_sha256, e.folded_root, e.folded_root = t.root as verified
        from leaves l join subroots s on s.key = l.key join ends e on e.key = l.key and e.pos = l.pos join summit t on true
        left join proofs p on p.key = l.key and p.pos = l.pos
    """
}
