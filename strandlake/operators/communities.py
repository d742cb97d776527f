"""Communities of weighted graphs by partition-local moving, for many resolutions and seeds at once.

The objective is w_inside / m - resolution * sum (strength / 2m)^2. Nodes are dealt to
blocks with all their edges and the communities of the neighbours. In a round each block
moves its own nodes again and again, seeing the nodes of other blocks where they stood at
the round's start; then communities and their strengths are exchanged. Neighbouring nodes
of two blocks could swap for ever, so in a round of a graph of several blocks half of them
move. When nothing is gained any more, communities become the nodes of the next level. A
graph that fits one block is led through all its levels there.

Nodes with more edges than a block holds are moved by an aggregate over their neighbours'
communities instead, after the blocks.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.joins import broadcast_if_small
from ..plans.lineage import cut, release, stored
from .graph import strength

#: Directed edges of a block, about, and of a node that is dealt to one.
BLOCK_EDGES = 1 << 20
#: Nodes whose communities go to all tasks in a round; beyond that they are joined.
SMALL = 500_000
#: A level ends after two rounds that raise the objective by less than this share of it.
LEAST_GAIN = 1e-4
#: Gains up to this share of a node's strength are rounding.
EPSILON = 1e-12


def moved(starts: np.ndarray, ends: np.ndarray, to: np.ndarray, w: np.ndarray, k: np.ndarray, label: np.ndarray, total: np.ndarray, scale: float, rng: np.random.Generator) -> np.ndarray:
    """Labels of the first len(starts) nodes after moving them one by one until none gains.

    to holds neighbours' numbers: own nodes first, then those that stand still. total is
    each label's strength, scale resolution / 2m. A node goes to the neighbouring label of
    the greatest gain, of equal ones to the least, and only if it gains.
    """
    label, total, n = label.copy(), total.copy(), len(starts)
    waiting = deque(rng.permutation(n).tolist())
    queued = np.ones(n, bool)
    lists = [None] * n
    while waiting:
        i = waiting.popleft()
        queued[i] = False
        lo, hi = starts[i], ends[i]
        now, ki = int(label[i]), k[i]
        near = label[to[lo:hi]]
        if hi - lo > 48:
            names, place = np.unique(near, return_inverse=True)
            inside = dict(zip(names.tolist(), np.bincount(place, w[lo:hi]).tolist()))
        else:
            if lists[i] is None:
                lists[i] = w[lo:hi].tolist()
            inside = {}
            for c, x in zip(near.tolist(), lists[i]):
                inside[c] = inside.get(c, 0.0) + x
        stay = inside.get(now, 0.0) - scale * ki * (total[now] - ki)
        best, to_label = stay + EPSILON * ki, now
        for c, x in inside.items():
            if c != now:
                gain = x - scale * ki * total[c]
                if gain > best or gain == best and to_label != now and c < to_label:
                    best, to_label = gain, c
        if to_label != now:
            total[now] -= ki
            total[to_label] += ki
            label[i] = to_label
            for j in to[lo:hi].tolist():
                if j < n and label[j] != to_label and not queued[j]:
                    queued[j] = True
                    waiting.append(j)
    return label[:n]


def _packed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the edges of 0, 1, ... begin and end in a (sorted), and b."""
    n = int(a[-1]) + 1 if len(a) else 0
    bounds = np.searchsorted(a, np.arange(n + 1))
    return bounds[:-1], bounds[1:], b


def settled(a: np.ndarray, b: np.ndarray, w: np.ndarray, k: np.ndarray, scale: float, rng: np.random.Generator) -> np.ndarray:
    """Communities of a whole graph: moving and contracting until a level joins nothing. a (sorted) and b number the nodes, both directions of each edge are there."""
    community = np.arange(len(k))
    while len(a):
        starts, ends, to = _packed(a, b)
        n = len(k)
        starts, ends = (np.concatenate([x, np.full(n - len(x), len(a))]) for x in (starts, ends))
        found = moved(starts, ends, to, w, k, np.arange(n), k, scale, rng)
        names, label = np.unique(found, return_inverse=True)
        community = label[community]
        if len(names) == n:
            break
        k = np.bincount(label, k)
        pair = label[a] * len(names) + label[b]
        apart = label[a] != label[b]
        pair, place = np.unique(pair[apart], return_inverse=True)
        w = np.bincount(place, w[apart])
        a, b = pair // len(names), pair % len(names)
    return community


def communities(edges: DataFrame, runs: Sequence[tuple[float, int]] = ((1.0, 0),)) -> DataFrame:
    """resolution, seed, node, community of every node with an edge, for each (resolution, seed).

    edges: a, b, w; self pairs and weights that aren't positive go, other edges should
    stand once. Labels are least members. No edges give no rows.
    """
    spark = edges.sparkSession
    e = stored(edges.filter("a <> b and w > 0").select("a", "b", F.col("w").cast("double").alias("w")))
    m2 = e.agg(F.sum("w")).first()[0]
    names = spark.createDataFrame([(i, float(r), s) for i, (r, s) in enumerate(runs)], "run int, resolution double, seed int")
    if not m2:
        return names.join(strength(e), F.lit(True)).select("resolution", "seed", "node", F.col("node").alias("community"))
    m2 *= 2
    every = F.explode(F.sequence(F.lit(0), F.lit(len(runs) - 1))).alias("run")
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    links = both.select(every, "a", "b", "w")
    own = stored(strength(e).select(every, "node", F.col("strength").alias("k"), F.col("node").alias("community")))
    named = own.select("run", "node", "community")
    level, n_links = 0, 2 * e.count()
    while True:
        blocks = -(-n_links // BLOCK_EDGES)
        if blocks <= 1:
            found = _whole(links, own, m2, runs, level)
        else:
            found = _rounds(stored(links), own, m2, runs, level, blocks)
        least = found.groupBy("run", "community").agg(F.min("node").alias("name"))
        found = stored(found.join(least, ["run", "community"]).select("run", "node", F.col("name").alias("community")))
        old, named = named, stored(named.join(found.select("run", F.col("node").alias("community"), F.col("community").alias("_c")), ["run", "community"]).select("run", "node", F.col("_c").alias("community")))
        release(old)
        if blocks <= 1 or found.filter("node <> community").isEmpty():
            break
        label = broadcast_if_small(found, SMALL)
        ends = links.join(label.select("run", F.col("node").alias("a"), F.col("community").alias("ca")), ["run", "a"]).join(label.select("run", F.col("node").alias("b"), F.col("community").alias("cb")), ["run", "b"])
        links = stored(ends.filter("ca <> cb").groupBy("run", F.col("ca").alias("a"), F.col("cb").alias("b")).agg(F.sum("w").alias("w")))
        own = stored(own.select("run", "node", "k").join(found, ["run", "node"]).groupBy("run", F.col("community").alias("node")).agg(F.sum("k").alias("k")).withColumn("community", F.col("node")))
        level, n_links = level + 1, links.groupBy("run").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    return named.join(F.broadcast(names), "run").select("resolution", "seed", "node", "community")


def _whole(links: DataFrame, own: DataFrame, m2: float, runs: Sequence[tuple[float, int]], level: int) -> DataFrame:
    """run, node, community: each run's graph, a block at most, in one task."""
    runs = list(runs)

    def run(key: tuple, e: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        resolution, seed = runs[key[0]]
        nodes, e = nodes.sort_values("node"), e.sort_values(["a", "b"])
        ids = nodes["node"].to_numpy()
        a, b = (np.searchsorted(ids, e[c].to_numpy()) for c in "ab")
        label = settled(a, b, e["w"].to_numpy(), nodes["k"].to_numpy(), resolution / m2, np.random.default_rng([seed, level]))
        return pd.DataFrame({"run": key[0], "node": ids, "community": ids[np.unique(label, return_index=True)[1]][label]})

    kind = own.schema["node"].dataType.simpleString()
    return links.groupBy("run").cogroup(own.groupBy("run")).applyInPandas(run, f"run int, node {kind}, community {kind}")


def _rounds(links: DataFrame, own: DataFrame, m2: float, runs: Sequence[tuple[float, int]], level: int, blocks: int) -> DataFrame:
    """run, node, community after rounds of moving in blocks, until two of them gain next to nothing."""
    runs, kind = list(runs), own.schema["node"].dataType.simpleString()
    hubs = cut(links.groupBy("run", "a").count().filter(F.col("count") > BLOCK_EDGES).select("run", F.col("a").alias("node")))
    large = broadcast_if_small(hubs, SMALL)
    plain = links.join(large.withColumnRenamed("node", "a"), ["run", "a"], "left_anti")
    resolution = F.element_at(F.array(*[F.lit(float(r)) for r, _ in runs]), F.col("run") + 1)
    best, kept, poor, turn, lab = None, None, 0, 0, own
    while True:
        tot = lab.groupBy("run", "community").agg(F.sum("k").alias("tot"))
        state = stored(lab.join(broadcast_if_small(stored(tot), SMALL), ["run", "community"]))
        seen = broadcast_if_small(state, SMALL)
        block = lambda c: F.pmod(F.xxhash64(c, F.lit(level)), F.lit(blocks)).cast("int")
        moving = F.pmod(F.xxhash64("block", F.lit(turn // 2)) + turn, F.lit(2)) == 0
        d = plain.withColumn("block", block("a")).filter(moving)
        d = d.join(seen.select("run", F.col("node").alias("b"), F.col("community").alias("cb"), F.col("tot").alias("tb")), ["run", "b"])
        mine = state.withColumn("block", block("node")).filter(moving)

        def run(key: tuple, e: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
            r, seed = runs[key[0]]
            nodes, e = nodes.sort_values("node"), e.sort_values(["a", "b"])
            ids = nodes["node"].to_numpy()
            if not len(e):
                return pd.DataFrame({"run": key[0], "node": ids, "community": nodes["community"].to_numpy()})
            a, b = e["a"].to_numpy(), e["b"].to_numpy()
            far, at = np.unique(b, return_index=True)
            away = ~np.isin(far, ids)
            every = np.concatenate([ids, far[away]])
            stands = np.concatenate([nodes["community"].to_numpy(), e["cb"].to_numpy()[at][away]])
            sums = np.concatenate([nodes["tot"].to_numpy(), e["tb"].to_numpy()[at][away]])
            names, first, label = np.unique(stands, return_index=True, return_inverse=True)
            order = np.argsort(every, kind="stable")
            to = order[np.searchsorted(every, b, sorter=order)]
            starts = np.searchsorted(a, ids, "left")
            ends = np.searchsorted(a, ids, "right")
            out = moved(starts, ends, to, e["w"].to_numpy(), nodes["k"].to_numpy(), label, sums[first], r / m2, np.random.default_rng([seed, level, turn, key[1]]))
            return pd.DataFrame({"run": key[0], "node": ids, "community": names[out]})

        out = d.groupBy("run", "block").cogroup(mine.groupBy("run", "block")).applyInPandas(run, f"run int, node {kind}, community {kind}")
        new = state.select("run", "node", "k", F.col("community").alias("_old")).join(out, ["run", "node"], "left").select("run", "node", "k", F.coalesce("community", "_old").alias("community"))
        new = stored(new)
        if not hubs.isEmpty():
            plain_moved, new = new, stored(_hubs_moved(links, new, hubs, resolution, m2))
            release(plain_moved)
        release(state)
        value = stored(_objective(links, new, resolution, m2))
        if best is None:
            best, kept = value, new
            gained = True
        else:
            better = cut(value.join(best.withColumnRenamed("q", "old"), "run").select("run", "q", "old", (F.col("q") > F.col("old")).alias("up")))
            gained = better.filter(F.col("q") > F.col("old") + F.abs("old") * LEAST_GAIN).count() > 0
            won = F.broadcast(better.filter("up").select("run"))
            old, kept = kept, stored(new.join(won, "run", "left_semi").unionByName(kept.join(won, "run", "left_anti")))
            if old is not lab:  # the round's start is read until its end
                release(old)
            best = cut(better.select("run", F.greatest("q", "old").alias("q")))
        poor = 0 if gained else poor + 1
        if poor >= 2:
            return kept.select("run", "node", "community")
        lab, turn = new, turn + 1


def _hubs_moved(links: DataFrame, lab: DataFrame, hubs: DataFrame, resolution, m2: float) -> DataFrame:
    """lab after each hub went to the neighbouring community of its greatest gain; all hubs at once."""
    mine = lab.join(hubs, ["run", "node"], "left_semi").select("run", F.col("node").alias("a"), "k", F.col("community").alias("now"))
    tot = lab.groupBy("run", "community").agg(F.sum("k").alias("tot"))
    to = links.join(hubs.withColumnRenamed("node", "a"), ["run", "a"], "left_semi").join(lab.select("run", F.col("node").alias("b"), "community"), ["run", "b"]).groupBy("run", "a", "community").agg(F.sum("w").alias("x"))
    to = to.unionByName(mine.select("run", "a", F.col("now").alias("community"), F.lit(0.0).alias("x"))).groupBy("run", "a", "community").agg(F.sum("x").alias("x"))
    to = to.join(mine, ["run", "a"]).join(tot, ["run", "community"])
    stays = F.col("community") == F.col("now")
    gain = F.col("x") - resolution * F.col("k") * (F.col("tot") - F.when(stays, F.col("k")).otherwise(0.0)) / m2
    pick = to.groupBy("run", "a").agg(F.min(F.struct((-gain).alias("g"), F.when(stays, 0).otherwise(1).alias("s"), F.col("community").alias("c"))).alias("x"))
    pick = pick.select("run", F.col("a").alias("node"), F.col("x.c").alias("_new"))
    return lab.join(pick, ["run", "node"], "left").select("run", "node", "k", F.coalesce("_new", "community").alias("community"))


def _objective(links: DataFrame, lab: DataFrame, resolution, m2: float) -> DataFrame:
    """run, q of a labelling, without the weight inside the nodes of this level."""
    label = broadcast_if_small(lab, SMALL)
    inside = links.join(label.select("run", F.col("node").alias("a"), F.col("community").alias("ca")), ["run", "a"]).join(label.select("run", F.col("node").alias("b"), F.col("community").alias("cb")), ["run", "b"])
    inside = inside.groupBy("run").agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("x"))
    tot = lab.groupBy("run", "community").agg((F.sum("k") / m2).alias("t")).groupBy("run").agg(F.sum(F.col("t") * F.col("t")).alias("t2"))
    return inside.join(tot, "run").select("run", (F.col("x") / m2 - resolution * F.col("t2")).alias("q"))


def modularities(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """resolution, seed, q of each labelling (resolution, seed, node, community) of the nodes with an edge."""
    keys, e = ["resolution", "seed"], edges.filter("a <> b and w > 0")
    label = broadcast_if_small(labels.select(*keys, "node", "community"), SMALL)
    d = e.join(label.withColumnsRenamed({"node": "a", "community": "ca"}), "a").join(label.withColumnsRenamed({"node": "b", "community": "cb"}), [*keys, "b"])
    m = F.broadcast(e.agg(F.sum("w").alias("m")))
    inside = d.groupBy(*keys).agg(F.sum(F.when(F.col("ca") == F.col("cb"), F.col("w")).otherwise(0.0)).alias("inside"))
    s = strength(e).join(label, "node").groupBy(*keys, "community").agg(F.sum("strength").alias("s")).groupBy(*keys).agg(F.sum(F.col("s") * F.col("s")).alias("s2"))
    return inside.join(s, keys).crossJoin(m).select(*keys, (F.col("inside") / F.col("m") - F.col("resolution") * F.col("s2") / (4 * F.col("m") * F.col("m"))).alias("q"))


def community_runs(edges: DataFrame, nodes: DataFrame, resolutions: list[float], seeds: int, least_size: int) -> DataFrame:
    """resolution, seed, node, community, q of every run, and chosen: the run of the best q of its resolution (of equal ones the least seed).

    Communities below least_size and nodes without an edge are noise: null.
    """
    e = stored(edges)
    lab = stored(communities(e, [(r, s) for r in resolutions for s in range(seeds)]))
    q = cut(modularities(e, lab))
    keys = ["resolution", "seed"]
    size = lab.groupBy(*keys, "community").agg(F.count("*").alias("n")).filter(F.col("n") >= least_size).drop("n")
    lab = lab.join(size, [*keys, "community"], "left_semi")
    first = F.row_number().over(Window.partitionBy("resolution").orderBy(F.desc(F.round("q", 9)), "seed"))  # a row a seed
    q = q.withColumn("chosen", first == 1)
    return nodes.select("node").distinct().crossJoin(F.broadcast(q)).join(lab, [*keys, "node"], "left").select(*keys, "node", "community", "q", "chosen")


def signatures(runs: DataFrame, *keys: str) -> DataFrame:
    """node, keys, labels, class, size: nodes of one community in every run (and of equal keys) are of one class, named by its least node.

    runs: run, node, community (null: none) and keys, which don't change within a node.
    """
    label = F.when(F.col("community").isNotNull(), F.struct("run", "community"))  # so that equal names of two runs don't meet
    d = runs.groupBy("node", *keys).agg(F.array_sort(F.collect_list(label)).alias("labels"))
    classes = d.groupBy("labels", *keys).agg(F.min("node").alias("class"), F.count("*").alias("size"))
    return d.join(classes, ["labels", *keys])


def co_assignment(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): how often two nodes share a community, over classes of nodes that no run parts.

    pairs: class_a <= class_b, frequency > 0, size_a, size_b; a class of one node has no
    pair with itself. members: node, class. runs: run, node, community (null: none). Every
    two nodes of one class (two) have its frequency.
    """
    total = runs.agg(F.countDistinct("run").alias("t"))
    s = stored(signatures(runs))
    members = s.select("node", "class")
    c = stored(s.select("class", "size", "labels").dropDuplicates(["class"]))
    one = c.select("class", "size", F.explode("labels").alias("l"))
    a, b = one.select("l", F.col("class").alias("class_a"), F.col("size").alias("size_a")), one.select("l", F.col("class").alias("class_b"), F.col("size").alias("size_b"))
    pairs = a.join(b, "l").filter("class_a < class_b or class_a = class_b and size_a > 1")
    pairs = pairs.groupBy("class_a", "class_b", "size_a", "size_b").agg(F.count("*").alias("n"))
    return pairs.crossJoin(F.broadcast(total)).select("class_a", "class_b", (F.col("n") / F.col("t")).alias("frequency"), "size_a", "size_b"), members


def assignment_confidence(runs: DataFrame, chosen: DataFrame) -> DataFrame:
    """node, community, confidence: the median, over the other members of its chosen community, of how often runs put both together; null for a lone member.

    runs: run, node, community (null: noise). chosen: node, community. Medians are taken
    over classes of nodes that no run parts, weighted by their sizes.
    """
    total = F.broadcast(runs.agg(F.countDistinct("run").alias("t")))
    own = chosen.filter("community is not null").select("node", F.col("community").alias("own"))
    s = stored(signatures(runs.join(own, "node"), "own"))
    c = s.select("own", "class", "size", "labels").dropDuplicates(["class"])
    x, y = c, c.select("own", F.col("class").alias("other"), F.col("size").alias("n"), F.col("labels").alias("theirs"))
    d = x.join(y, "own").withColumn("n", F.col("n") - F.when(F.col("class") == F.col("other"), 1).otherwise(0)).filter("n > 0")
    d = d.crossJoin(total).withColumn("f", F.size(F.array_intersect("labels", "theirs")) / F.col("t"))
    found = d.groupBy("class").agg(F.expr("percentile(f, 0.5D, n)").alias("confidence"))
    return s.join(found, "class", "left").select("node", F.col("own").alias("community"), "confidence")
