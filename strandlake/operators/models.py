"""Model operators on feature tables, by MLlib; fitting sees training folds only."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.joins import broadcast_if_small
from ..plans.lineage import cut, release, stored
from .stats import mann_whitney, poisson_weight

#: Neighbours that vote; rows of a block of queries and of a stripe of references that meet in one task.
NEIGHBOURS, QUERIES, REFERENCES = 5, 4096, 1 << 16
#: References of a box of space, about; rows that planes are drawn from, about; rough distances that a task holds at once.
LEAF, SAMPLE, CELLS = 4096, 1 << 16, 1 << 21


def _vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol="_x", handleInvalid="skip").transform(df)


def scores(train: DataFrame, test: DataFrame, columns: list[str], label: str, model: str, seed: int = 0) -> DataFrame:
    """test with p, the probability of label 1, by a model fitted to train (scaled by train's moments).

    Models: logistic, forest, knn (the share of the NEIGHBOURS nearest training rows).
    """
    a, b = (_vectors(d.withColumn("_y", F.col(label).cast("double")), columns) for d in (train, test))
    scaler = StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True).fit(a)
    if model == "knn":
        z = lambda d, *c: scaler.transform(d).select(*c, vector_to_array("_z").alias("_v"))
        b = stored(z(b.withColumn("_q", F.monotonically_increasing_id()), *test.columns, "_q"))
        votes = nearest(b.select("_q", "_v"), z(a.withColumn("_r", F.xxhash64(*train.columns)), "_r", "_y"), "_q", "_r", "_v", NEIGHBOURS, "_y")
        return b.join(votes.groupBy("_q").agg(F.avg("_y").alias("p")), "_q").select(*test.columns, "p")
    kinds = {"logistic": LogisticRegression(featuresCol="_z", labelCol="_y", regParam=0.01), "forest": RandomForestClassifier(featuresCol="_z", labelCol="_y", numTrees=20, maxDepth=4, seed=seed)}
    fitted = kinds[model].fit(scaler.transform(a))
    out = fitted.transform(scaler.transform(b))
    return out.select(*test.columns, F.get(vector_to_array("probability"), F.lit(1)).alias("p"))


def _leaves(rows: DataFrame, vector: str, leaves: int) -> list[tuple[list, list]]:
    """(lowest, highest) corner of each box of a k-d tree that covers all of space, its planes at medians of a sample of rows. The planes only deal the work; any would do."""
    share = min(1.0, SAMPLE / max(1, rows.count()))
    sample = [r[0] for r in rows.sample(share, seed=0).select(F.col(vector).cast("array<double>")).limit(4 * SAMPLE).collect()] if leaves > 1 else []
    if not sample:
        return [([], [])]
    boxes = [(np.array(sample), np.full(len(sample[0]), -np.inf), np.full(len(sample[0]), np.inf))]
    while len(boxes) < leaves:
        halves = []
        for points, low, high in boxes:
            at = int(np.argmax(np.ptp(points, axis=0))) if len(points) > 1 else 0
            plane = float(np.median(points[:, at])) if len(points) > 1 else 0.0
            below = points[:, at] < plane
            if not below.any() or below.all():
                halves.append((points, low, high))
                continue
            left, right = high.copy(), low.copy()
            left[at] = right[at] = plane
            halves += [(points[below], low, left), (points[~below], right, high)]
        if len(halves) == len(boxes):  # only copies are left
            break
        boxes = halves
    return [(low.tolist(), high.tolist()) for _, low, high in boxes]


def nearest(queries: DataFrame, references: DataFrame, query: str, reference: str, vector: str, k: int, *carried: str) -> DataFrame:
    """query, reference, distance, rank, carried: the k nearest references (Euclidean) of each query, exactly; equal distances by reference.

    Space is cut into boxes of about LEAF references. A query's box bounds the distance of
    its k-th neighbour; it then visits those boxes only that reach within. In a box, queries
    are dealt to blocks and references to stripes; each block meets each stripe in one task,
    which keeps k rows a query at most. Those of all are then ranked. Rows with a null
    vector are left out; fewer than k references give fewer rows. In many dimensions most
    boxes are visited.
    """
    q, r = (d.filter(F.col(vector).isNotNull()) for d in (queries, references))
    q, r = stored(q.select(query, vector)), stored(r.select(reference, vector, *carried))
    boxes = _leaves(r, vector, -(-r.count() // LEAF))
    lows, highs = (np.array([b[i] for b in boxes], float) for i in (0, 1))

    @F.pandas_udf("int")
    def home(vectors: pd.Series) -> pd.Series:
        x = np.stack(vectors.to_numpy()).astype(float)
        found = np.zeros(len(x), int)
        for i in range(len(lows) if lows.shape[1] else 0):
            found[((x >= lows[i]) & (x < highs[i])).all(1)] = i
        return pd.Series(found)

    @F.pandas_udf("array<int>")
    def visited(vectors: pd.Series, own: pd.Series, reach: pd.Series) -> pd.Series:
        if not lows.shape[1]:
            return pd.Series([[] for _ in own])
        x, out = np.stack(vectors.to_numpy()).astype(float), []
        near = reach.to_numpy(float) * (1 + 1e-9) + 1e-12  # rounding may not lose a neighbour at the same distance
        for v, box, most in zip(x, own, near):
            away = np.maximum(np.maximum(lows - v, v - highs), 0)
            reached = np.flatnonzero((away**2).sum(1) <= (np.inf if np.isnan(most) else most * most))
            out.append(reached[reached != box].tolist())
        return pd.Series(out)

    q, r = stored(q.withColumn("_box", home(vector))), stored(r.withColumn("_box", home(vector)))
    first = stored(_met(q, r, query, reference, vector, k, carried))
    if len(boxes) > 1:
        bound = first.groupBy(query).agg(F.count("*").alias("n"), F.max("distance").alias("d"))  # k rows a stripe: the greatest of them bounds the k-th
        far = q.join(bound, query, "left").withColumn("_box", F.explode(visited(vector, "_box", F.when(F.col("n") >= k, F.col("d")))))
        first = first.unionByName(_met(stored(far.select(query, vector, "_box")), r, query, reference, vector, k, carried))
    rank = F.row_number().over(Window.partitionBy(query).orderBy("distance", reference))  # k rows a stripe
    return first.withColumn("rank", rank).filter(F.col("rank") <= k).select(query, reference, "distance", "rank", *carried)


def _met(q: DataFrame, r: DataFrame, query: str, reference: str, vector: str, k: int, carried: Sequence[str]) -> DataFrame:
    """query, reference, carried, distance: the k nearest references of each query in each stripe of its box (_box); a query may be in several boxes."""
    parts = lambda d, name, size: F.broadcast(d.groupBy("_box").agg(F.ceil(F.count("*") / size).cast("int").alias(name)))
    sizes = parts(q, "_blocks", QUERIES).join(parts(r, "_stripes", REFERENCES), "_box")
    sizes = F.broadcast(stored(sizes))  # a row a box
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    q, r = q.join(sizes, "_box"), r.join(sizes, "_box")
    q = q.withColumns({"_block": dealt(query, "_blocks")}).withColumn("_stripe", every("_stripes")).drop("_blocks", "_stripes")
    r = r.withColumns({"_stripe": dealt(reference, "_stripes")}).withColumn("_block", every("_blocks")).drop("_blocks", "_stripes")
    kinds = {f.name: f.dataType.simpleString() for f in (*q.schema.fields, *r.schema.fields)}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (query, reference, *carried)) + ", distance double"

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({c: [] for c in (query, reference, *carried, "distance")})
        b = b.sort_values(reference, kind="stable")
        x, y = (np.stack(d[vector].to_numpy()).astype(float) for d in (a, b))
        most, step, size = min(k, len(b)), max(1, CELLS // len(b)), (y**2).sum(1)
        whose, which, how_far = [], [], []
        for lo in range(0, len(x), step):
            part = x[lo : lo + step]
            own = (part**2).sum(1)
            rough = np.maximum(own[:, None] + size - 2 * part @ y.T, 0)
            edge = np.partition(rough, most - 1, 1)[:, most - 1] + 1e-9 * (own + size.max() + 1)
            i, near = np.nonzero(rough <= edge[:, None])  # the rough distances may swap neighbours that are all but equal
            d = np.sqrt(((y[near] - part[i]) ** 2).sum(1))
            order = np.lexsort((near, d, i))  # b stands in order of reference
            i, near, d = i[order], near[order], d[order]
            start = np.searchsorted(i, np.arange(len(part)))
            top = np.arange(len(i)) - start[i] < most
            whose.append(lo + i[top]), which.append(near[top]), how_far.append(d[top])
        out = b.iloc[np.concatenate(which)][[reference, *carried]].reset_index(drop=True)
        out[query] = a[query].to_numpy()[np.concatenate(whose)]
        return out.assign(distance=np.concatenate(how_far))[[query, reference, *carried, "distance"]]

    return q.groupBy("_box", "_block", "_stripe").cogroup(r.groupBy("_box", "_block", "_stripe")).applyInPandas(run, schema)


def class_metrics(scored: DataFrame, label: str, keys: list[str]) -> DataFrame:
    """n, sensitivity, specificity and balanced accuracy at p >= 0.5, by key."""
    y, hit = F.col(label).cast("boolean"), F.col("p") >= 0.5
    d = scored.groupBy(*keys).agg(F.count("*").alias("n"), F.try_divide(F.count_if(y & hit), F.count_if(y)).alias("sensitivity"), F.try_divide(F.count_if(~y & ~hit), F.count_if(~y)).alias("specificity"))
    return d.withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2)


def leave_fold_out(people: DataFrame, columns: list[str], label: str, model: str) -> DataFrame:
    """people with p from the model fitted without their own fold. There are few folds; each fit is a Spark job over all rows."""
    people = cut(people)
    out = None
    for (fold,) in people.select("fold").distinct().orderBy("fold").collect():
        part = scores(people.filter(F.col("fold") != fold), people.filter(F.col("fold") == fold), columns, label, model)
        out = part if out is None else out.unionByName(part)
    return out


def frozen_test(people: DataFrame, split: str, columns: list[str], label: str, model: str) -> DataFrame:
    """One row: n and metrics on TEST of a model fitted to TRAIN, with its AUC."""
    s = cut(scores(people.filter(F.col(split) == "TRAIN"), people.filter(F.col(split) == "TEST"), columns, label, model).withColumn("_y", F.col(label).cast("boolean")))
    return class_metrics(s, "_y", []).crossJoin(mann_whitney(s, "p", "_y").select("auc"))


def score_deltas(scored: DataFrame, label: str, base: str, other: str, group: str, replicates: int, threshold: float = 0.5, seed: int = 0) -> DataFrame:
    """One row: base, other (balanced accuracies of two probabilities on the same rows), delta = other - base, and the percentile interval of the delta over replicates that resample groups.

    Groups are summed first; a replicate weighs them by hashed Poisson counts. Replicates
    without a row of either label don't count. group may be the row's id.
    """
    y = F.col(label).cast("boolean")
    hits = {f"{m}{s}": F.count_if((y if s == "1" else ~y) & ((F.col(c) >= threshold) == (s == "1"))) for m, c in (("a", base), ("b", other)) for s in "10"}
    g = scored.groupBy(F.col(group).alias("_g")).agg(F.count_if(y).alias("n1"), F.count_if(~y).alias("n0"), *[v.alias(c) for c, v in hits.items()])
    g = cut(g)
    share = lambda m: (F.try_divide(F.sum(F.col("w") * F.col(f"{m}1")), F.sum(F.col("w") * F.col("n1"))) + F.try_divide(F.sum(F.col("w") * F.col(f"{m}0")), F.sum(F.col("w") * F.col("n0")))) / 2
    point = g.withColumn("w", F.lit(1)).agg(share("a").alias("base"), share("b").alias("other"))
    d = g.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", poisson_weight(F.xxhash64("_g", "r", F.lit(seed))))
    d = d.groupBy("r").agg((share("b") - share("a")).alias("d")).agg(F.percentile("d", F.lit(0.025)).alias("low"), F.percentile("d", F.lit(0.975)).alias("high"))
    return point.crossJoin(d).select("base", "other", (F.col("other") - F.col("base")).alias("delta"), "low", "high")


def frozen_deltas(people: DataFrame, split: str, base: Sequence[str], other: Sequence[str], label: str, model: str, key: str, group: str, replicates: int) -> DataFrame:
    """score_deltas() on TEST of one model fitted to TRAIN with the columns base and with the columns other; by rows (unit `row`) and by groups (unit `group`)."""
    train, test = (cut(people.filter(F.col(split) == x)) for x in ("TRAIN", "TEST"))
    a, b = (scores(train, test, list(c), label, model).select(key, F.col("p").alias(name)) for c, name in ((base, "_pa"), (other, "_pb")))
    s = cut(test.select(key, label, group).join(a, key).join(b, key))
    out = [score_deltas(s, label, "_pa", "_pb", c, replicates).select(F.lit(unit).alias("unit"), "*") for unit, c in (("row", key), ("group", group))]
    return out[0].unionByName(out[1])


def permute_edges(edges: DataFrame, rounds: int, seed: int = 0) -> DataFrame:
    """A degree-preserving random graph: in each round edges pair up by hash and swap ends where that gives new, proper edges.

    Two edges (a, b), (c, d) become (a, d), (c, b). A swap stands if neither new edge exists or is made twice.
    """
    have = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    for turn in range(rounds):
        h = have.withColumn("_h", F.xxhash64("a", "b", F.lit(seed), F.lit(turn)))
        n = have.count()
        cells = max(1, n // 2)
        pair = h.groupBy(F.pmod("_h", F.lit(cells)).alias("_cell")).agg(F.slice(F.array_sort(F.collect_list(F.struct("_h", "a", "b"))), 1, 2).alias("e")).filter(F.size("e") == 2)
        x, y = F.get("e", F.lit(0)), F.get("e", F.lit(1))
        cand = pair.select("_cell", x["a"].alias("a"), x["b"].alias("b"), y["a"].alias("c"), y["b"].alias("d"))
        cand = cand.filter("a <> d and c <> b and a <> c and b <> d")
        new = cand.select("_cell", F.explode(F.array(F.struct(F.least("a", "d").alias("a"), F.greatest("a", "d").alias("b")), F.struct(F.least("c", "b").alias("a"), F.greatest("c", "b").alias("b")))).alias("n")).select("_cell", "n.a", "n.b")
        twice = new.groupBy("a", "b").agg(F.count("*").alias("k")).filter("k > 1").select("a", "b")
        bad = new.join(have.unionByName(twice).distinct(), ["a", "b"], "left_semi").select("_cell").distinct()
        good = cut(cand.join(bad, "_cell", "left_anti"))
        old = good.select("a", "b").unionByName(good.select(F.col("c").alias("a"), F.col("d").alias("b")))
        made = new.join(good.select("_cell"), "_cell", "left_semi").select("a", "b")
        have = cut(have.join(old, ["a", "b"], "left_anti").unionByName(made))
    return have


def permute_carriers(carriers: DataFrame, missing: DataFrame, rounds: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(carriers after swaps, mixing) of carriers (sample_id, event, dosage, stratum, once a sample and event).

    In each round the carriers of a stratum and dosage pair up by hash; two of different
    people and events swap events where both crossed cells are called (not in missing:
    sample_id, event), carried by nobody, and made once. So every event keeps its carriers'
    number, dosages and strata, every person its number of events and dosages, and missing
    cells stay as they are. mixing: stratum, dosage, n, swaps (over all rounds), moved
    (carriers that are where none was), moved_share. Groups never fall back on wider strata.
    """
    cell, group = ["sample_id", "event"], ["stratum", "dosage"]
    first = have = stored(carriers.select(*cell, *group))
    closed = stored(missing.select(*cell).distinct())
    sizes = cut(have.groupBy(*group).agg(F.count("*").alias("n")))
    small, swaps = broadcast_if_small(sizes), None
    for turn in range(rounds):
        h = F.xxhash64(*cell, F.lit(seed), F.lit(turn))
        d = have.join(small, group).withColumn("_cell", F.pmod(h, F.greatest(F.lit(1), F.floor(F.col("n") / 2)))).select(*group, "_cell", *cell)
        hashed = lambda x: F.struct(F.xxhash64(*[x[c] for c in cell], F.lit(seed), F.lit(turn)).alias("_h"), *[x[c].alias(c) for c in cell])  # noqa: B023,E731  taken behind the shuffle
        two = d.groupBy(*group, "_cell").agg(F.slice(F.array_sort(F.transform(F.collect_list(F.struct(*cell)), hashed)), 1, 2).alias("e")).filter(F.size("e") == 2)  # few share a cell
        x, y = F.get("e", F.lit(0)), F.get("e", F.lit(1))
        c = two.select(*group, "_cell", x["sample_id"].alias("s1"), x["event"].alias("e1"), y["sample_id"].alias("s2"), y["event"].alias("e2")).filter("s1 <> s2 and e1 <> e2")
        c = stored(c)  # read three times, shuffled once
        made = c.select(*group, "_cell", F.explode(F.array(F.struct(F.col("s1").alias("sample_id"), F.col("e2").alias("event")), F.struct(F.col("s2").alias("sample_id"), F.col("e1").alias("event")))).alias("x")).select(*group, "_cell", "x.*")
        twice = made.withColumn("_k", F.count("*").over(Window.partitionBy(*cell))).filter("_k > 1")
        bad = made.join(have.select(*cell).unionByName(closed), cell, "left_semi").unionByName(twice.drop("_k")).select(*group, "_cell").distinct()
        good = stored(c.join(bad, [*group, "_cell"], "left_anti"))
        gone = good.select(F.col("s1").alias("sample_id"), F.col("e1").alias("event")).unionByName(good.select(F.col("s2").alias("sample_id"), F.col("e2").alias("event")))
        come = made.join(good.select(*group, "_cell"), [*group, "_cell"], "left_semi").select(*cell, *group)
        old, have = have, stored(have.join(gone, cell, "left_anti").unionByName(come))
        release(c, *([old] if turn else []))
        n = good.groupBy(*group).agg(F.count("*").alias("swaps"))
        swaps = n if swaps is None else swaps.unionByName(n)
    moved = have.join(first.select(*cell), cell, "left_anti").groupBy(*group).agg(F.count("*").alias("moved"))
    mixing = sizes.join(moved, group, "left")
    if swaps is None:
        mixing = mixing.withColumn("swaps", F.lit(0).cast("long"))
    else:
        mixing = mixing.join(swaps.groupBy(*group).agg(F.sum("swaps").alias("swaps")), group, "left")
    mixing = mixing.na.fill(0, ["moved", "swaps"])
    return have, mixing.select(*group, "n", "swaps", "moved", (F.col("moved") / F.col("n")).alias("moved_share"))
