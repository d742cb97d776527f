"""Merkle dataset manifest by cogrouped subtree exchange (operator 13).

Every row is a leaf, the hash of its fields. Leaves of a group, in order, are hashed eight
by eight, level by level, to the group's root; the groups' roots, in order, likewise to the
root of the whole. All trees are cut into superblocks of three levels (512 nodes). Going
up, each superblock becomes one node of the next tier, until a tier has one node a tree.
Going down, every superblock is cogrouped with the outer nodes that it needs: the siblings
of its own node at all higher levels. There the local levels are hashed once more, joined
to the outer siblings as proofs, and folded from leaf to root. No task sees more than a
superblock and its outer nodes, about seven for each higher level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.joins import broadcast_if_small
from ..plans.lineage import cut, stored

#: Children of a node, levels of a superblock, its leaves.
ARITY, LEVELS = 8, 3
BLOCK = ARITY**LEVELS

NODES = "g long, i long, n long, h string"
PATHS = "g long, i long, steps array<struct<pos:int,siblings:array<string>>>, subroot string, root string"


def leaf(fields: Sequence[Column]) -> Column:
    """sha256 in hex of the fields, one after the other: `-` for null, else UTF-8 length, `:`, value."""
    parts = []
    for f in fields:
        s = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def node(children: Sequence[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def levels(nodes: list[str], count: int, depth: int) -> list[list[str]]:
    """The nodes and each level above them in their superblock of depth levels; count: nodes of the whole tree at this tier.

    A tree of several superblocks has all levels in each; otherwise levels end with one node.
    """
    out = [nodes]
    while len(out) <= depth if count > ARITY**depth else len(out[-1]) > 1:
        out.append([node(out[-1][k : k + ARITY]) for k in range(0, len(out[-1]), ARITY)])
    return out


def siblings(tree: list[list[str]], i: int) -> list[tuple[int, list[str]]]:
    """(place in the run, the run's others) of leaf i at every level of a superblock but its top."""
    out = []
    for level in tree[:-1]:
        lo = i // ARITY * ARITY
        run = level[lo : lo + ARITY]
        out.append((i - lo, run[: i - lo] + run[i - lo + 1 :]))
        i //= ARITY
    return out


def folded(h: str, steps: list[tuple[int, list[str]]]) -> str:
    """The root above h by its siblings."""
    for pos, others in steps:
        h = node([*others[:pos], h, *others[pos:]])
    return h


def ranked(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """rows (stored) with i, the place from 0 in the group by order, and n, the group's size.

    Rows are dealt by ranges of group and order, written with their range's number, and
    numbered within it; the sizes of the ranges before are added. A range has a bounded
    part of a large group.
    """
    spark = rows.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = stored(rows.repartitionByRange(parts, *keys).withColumn("_part", F.spark_partition_id()))
    sizes = cut(dealt.groupBy(group, "_part").agg(F.count("*").alias("_n")))  # as many rows as ranges and groups at most
    w = Window.partitionBy(group)
    before = F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = cut(sizes.select(group, "_part", before.alias("_before"), F.sum("_n").over(w).alias("n")))
    within = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    d = dealt.withColumn("_within", within).join(broadcast_if_small(sizes), [group, "_part"])
    return d.withColumn("i", F.col("_before") + F.col("_within") - 1).drop("_part", "_before", "_within")


def _up(nodes: DataFrame) -> DataFrame:
    """The next tier: a node for each superblock. nodes: g, i, n, h."""

    def run(one: pd.DataFrame) -> pd.DataFrame:
        top = levels(one.sort_values("i")["h"].tolist(), int(one["n"][0]), LEVELS)[-1]
        return pd.DataFrame({"g": [one["g"][0]], "i": [one["i"][0] // BLOCK], "n": [-(-one["n"][0] // BLOCK)], "h": top})

    return stored(nodes.groupBy("g", F.floor(F.col("i") / BLOCK).alias("b")).applyInPandas(run, NODES))


def _down(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths of nodes: their siblings within the superblock, then the superblock's own. paths: those of the tier above."""

    def run(one: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("i")
        tree = levels(one["h"].tolist(), int(one["n"].iloc[0]), LEVELS)
        above = [{"pos": s["pos"], "siblings": list(s["siblings"])} for s in outer["steps"][0]]
        steps = [[{"pos": p, "siblings": s} for p, s in siblings(tree, k)] + above for k in range(len(one))]
        return pd.DataFrame({"g": one["g"].tolist(), "i": one["i"].tolist(), "steps": steps, "subroot": outer["subroot"][0], "root": outer["root"][0]})

    left, right = nodes.groupBy("g", F.floor(F.col("i") / BLOCK).cast("long").alias("b")), paths.groupBy("g", F.col("i").alias("b"))
    return stored(left.cogroup(right).applyInPandas(run, PATHS))


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """nodes and all tiers above, up to one node a tree."""
    out = [nodes]
    while out[-1].agg(F.max("n")).first()[0] > 1:
        out.append(_up(out[-1]))
    return out


def prove(rows: DataFrame, group_col: str, id_col: str, leaf_col: str, claimed_col: str) -> DataFrame:
    """id, leaf, subroot, root, proof_sha256, folded_root, verified of each row.

    leaf_col is the hash of the recorded row, claimed_col that of the row as it is now. A
    group's leaves ascend by id (null first, equal ids by leaf); groups go null first, then
    by their UTF-8. proof_sha256 is the hash of all siblings from leaf to root. folded_root
    is what the claimed leaf and the recorded siblings give, verified whether that is root.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    made = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    d = stored(rows.select(F.col(group_col).alias("_group"), F.col(id_col).alias("id"), F.col(leaf_col).alias("h"), F.col(claimed_col).alias("claimed")))
    groups = stored(d.select("_group").distinct().withColumn("_all", F.lit(0)))
    groups = stored(ranked(groups, "_all", ["_group"]).select(F.col("_group").alias("_name"), F.col("i").alias("g")))
    d = d.join(broadcast_if_small(groups), F.col("_group").eqNullSafe(F.col("_name"))).select("g", "id", "h", "claimed")
    # ids are text from here on: pandas has no nullable long
    leaves = stored(ranked(d, "g", ["id", "h", "claimed"]).withColumn("id", F.col("id").cast("string")))
    if leaves.isEmpty():
        return rows.sparkSession.createDataFrame([], made).withColumn("id", F.col("id").cast(kind))
    tiers = _tiers(leaves.select("g", "i", "n", "h"))
    whole = F.lit(-1).cast("long")  # the tree of subroots
    tops = stored(tiers[-1].select(whole.alias("g"), F.col("g").alias("i"), F.lit(groups.count()).cast("long").alias("n"), "h"))
    above = _tiers(tops)
    none = F.array().cast("array<struct<pos:int,siblings:array<string>>>")
    paths = above[-1].select("g", "i", none.alias("steps"), F.lit(None).cast("string").alias("subroot"), F.col("h").alias("root"))
    for tier in above[-2::-1]:
        paths = _down(tier, paths)
    # from the tree of subroots to the trees below: place i there is group i here
    paths = paths.drop("subroot").join(tops.select("i", F.col("h").alias("subroot")), "i").select(F.col("i").alias("g"), F.lit(0).cast("long").alias("i"), "steps", "subroot", "root")
    for tier in tiers[-2:0:-1]:
        paths = _down(tier, paths)
    return _digests(leaves, paths, made).withColumn("id", F.col("id").cast(kind))


def _digests(leaves: DataFrame, paths: DataFrame, made: str) -> DataFrame:
    """The last exchange: leaves with the outer nodes of their superblocks."""

    def run(one: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        one = one.sort_values("i")
        tree = levels(one["h"].tolist(), int(one["n"].iloc[0]), LEVELS)
        above = [(int(s["pos"]), list(s["siblings"])) for s in outer["steps"][0]]
        outside, root = "".join(x for _, s in above for x in s), outer["root"][0]
        proofs, roots = [], []
        for k, claimed in enumerate(one["claimed"]):
            steps = siblings(tree, k)
            proofs.append(node([*(x for _, s in steps for x in s), outside]))
            roots.append(folded(claimed, steps + above))
        return pd.DataFrame({"id": one["id"].tolist(), "leaf": one["h"].tolist(), "subroot": outer["subroot"][0], "root": root, "proof_sha256": proofs, "folded_root": roots, "verified": [r == root for r in roots]})

    left, right = leaves.groupBy("g", F.floor(F.col("i") / BLOCK).cast("long").alias("b")), paths.groupBy("g", F.col("i").alias("b"))
    return left.cogroup(right).applyInPandas(run, made)


def manifest(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "lang", id_col: str = "doc_id", tampered: dict[str, Column] | None = None) -> DataFrame:
    """A proof for each row of docs; see prove(). tampered: what some fields are now, instead of what was recorded.

    Every row is a leaf, also repeated ones, those of a null id (first in their group) and
    of empty or null texts; a null group is a group. One group with a lone row has that
    leaf as its root and a proof of nothing. Other columns are not read. No rows give no rows.
    """
    now = {c: F.col(c) for c in fields} | (tampered or {})
    d = docs.select(F.col(group_col).alias("_group"), F.col(id_col).alias("_id"), leaf([F.col(c) for c in fields]).alias("_leaf"), leaf([now[c] for c in fields]).alias("_claimed"))
    return prove(d, "_group", "_id", "_leaf", "_claimed").withColumnRenamed("id", id_col)
