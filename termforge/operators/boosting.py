"""Second-order gradient boosting of trees by histograms, for all contexts and candidates of a grid at once.

Rows are binned once: a feature's cut points are its distinct training values, or as many quantiles as `most_bins` allows.
A round looks at one depth of one tree: every row finds its node in the trees so far, and one aggregate sums gradients,
hessians and rows by context, candidate, node, feature and bin, only of bins above the lowest (the node's totals give that
one). Suffix sums over a feature's bins then give the gain of every cut and the best one of a node. What comes to the driver
is the model, nodes of a grid's trees, whose number depends on parameters alone; rows are never gathered in one task.

Sums are exact: gradients and hessians are whole multiples of 2^-30, so a split doesn't depend on the order in which
rows were added up, nor on lost executors. Ties go to the earlier feature, then to the lower cut.

Two ways to grow: `depth` splits every node down to max_depth (all distinct values are cut points as long as they fit);
`leaf` always splits the leaf of the largest gain until there are num_leaves. A leaf-wise tree is also grown depth by depth:
the children of a split are evaluated once the splits known so far would choose it, since nodes still unknown can only
push a split back in that order.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termforge.operators import evaluate as E
from termforge.operators import ranges
from termforge.operators.tables import drop, written

# The grids of the two boosters that this stands for.
LEAF_GRID = {"n_estimators": [20, 30, 50, 100, 200, 300, 500], "num_leaves": [7, 15, 31, 63, 127, 200, 500], "max_depth": [-1, 1, 3, 5, 7, 10], "learning_rate": [0.05, 0.1, 0.2, 0.3, 0.4, 0.5]}
DEPTH_GRID = {"n_estimators": [50, 100, 200, 300, 500, 1000], "max_depth": [2, 3, 6, 9, 12, 15, 20], "learning_rate": [0.05, 0.1, 0.2, 0.3, 0.4, 0.5], "min_child_weight": [0, 1, 3, 5, 7, 9]}

#: Gradients and hessians are multiples of its inverse.
UNIT = 1 << 30
#: Trees since which the state was last written.
REFRESH = 10
CONTEXT = ["outer_fold", "inner_fold"]
#: Depth that a tree without max_depth may reach; node numbers double with each.
DEEPEST = 60
Key = tuple[int, int, int]


@dataclass(frozen=True)
class Series:
    """What determines a candidate's trees, whatever their number."""

    grow: str
    max_depth: int
    num_leaves: int
    learning_rate: float
    min_child_weight: float


@dataclass
class Node:
    """A node that could be split, with its best cut: rows with bin below `cut` of `feature` go to 2 * id."""

    gain: float
    feature: int
    cut: int
    values: tuple[float, float]


@dataclass
class Tree:
    """The known nodes of one tree by number (the root is 1), and the value of the root."""

    value: float = 0.0
    nodes: dict[int, Node] = field(default_factory=dict)


def grid(spark: SparkSession, values: dict[str, list], grow: str) -> DataFrame:
    """All combinations in grid order: candidate_index, param_label, grow, n_estimators, max_depth (-1: none), num_leaves, learning_rate, min_child_weight."""
    names = list(values)
    rows = []
    for i, combo in enumerate(product(*values.values())):
        own = dict(zip(names, combo, strict=True))
        label = ", ".join(f"{n}={v:g}" for n, v in own.items())
        rows.append((i, label, grow, int(own["n_estimators"]), int(own.get("max_depth", -1)), int(own.get("num_leaves", 31)), float(own.get("learning_rate", 0.1)), float(own.get("min_child_weight", 0.0))))
    return spark.createDataFrame(rows, "candidate_index int, param_label string, grow string, n_estimators int, max_depth int, num_leaves int, learning_rate double, min_child_weight double")


def cut_points(rows: DataFrame, most_bins: int = 255) -> DataFrame:
    """CONTEXT, edges: of each feature in order the training values above the least that start a bin, ascending.

    Values are counted and numbered by ranges, so one value that most rows share, or one feature, is no hot group.
    """
    train = rows.filter("role = 'train'").select(*CONTEXT, F.posexplode("features").alias("feature", "v"))
    group = [*CONTEXT, "feature"]
    counted = train.groupBy(*group, "v").agg(F.count(F.lit(1)).alias("c"))
    upto = ranges.running(counted.withColumn("one", F.lit(1)), [F.col(c) for c in (*group, "v")], {"rows": "c", "values": "one"})
    sizes = upto.groupBy(*group).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"), F.min(F.col("rows") - F.col("c")).alias("first"), F.min("values").alias("least"))
    at = upto.join(sizes, group)
    share = lambda x: F.floor((x - F.col("first")) * most_bins / F.col("n"))  # noqa: E731  of the rows up to there
    starts = F.when(F.col("k") <= most_bins, F.lit(True)).otherwise(share(F.col("rows") - 1) != share(F.col("rows") - F.col("c") - 1))
    cuts = at.filter((F.col("values") > F.col("least")) & starts).groupBy(*group).agg(F.sort_array(F.collect_list("v")).alias("own"))
    whole = sizes.select(*group).join(cuts, group, "left").select(*group, F.coalesce("own", F.array().cast("array<double>")).alias("own"))
    return whole.groupBy(*CONTEXT).agg(F.transform(F.sort_array(F.collect_list(F.struct("feature", "own"))), lambda x: x["own"]).alias("edges"))


def binned(rows: DataFrame, most_bins: int = 255) -> DataFrame:
    """CONTEXT, doc_id, role, label, weight, bins: features as numbers of bins, classes weighted alike on each context's
    training rows. Cut points of a context are broadcast; their number depends on features and bins alone."""
    sizes = rows.filter("role = 'train'").groupBy(*CONTEXT).agg(F.count_if(F.col("label") == 1).alias("k1"), F.count_if(F.col("label") == 0).alias("k0"))
    own = cut_points(rows, most_bins).join(sizes, CONTEXT)
    bins = F.zip_with("features", "edges", lambda v, e: F.size(F.filter(e, lambda x: x <= v)).cast("int"))
    return rows.join(F.broadcast(own), CONTEXT).select(*CONTEXT, "doc_id", "role", "label", "k1", "k0", bins.alias("bins"))


def weight(grow: str) -> Column:
    """Leaf-wise: both classes weigh half of all rows; depth-wise: label 1 weighs as much as label 0 in all."""
    some = (F.col("k1") > 0) & (F.col("k0") > 0)
    n = F.col("k1") + F.col("k0")
    if grow == "leaf":
        return F.when(some, n / (2 * F.when(F.col("label") == 1, F.col("k1")).otherwise(F.col("k0")))).otherwise(F.lit(1.0))
    return F.when(some & (F.col("label") == 1), F.col("k0") / F.col("k1")).otherwise(F.lit(1.0))


def chosen(tree: Tree, series: Series) -> list[int]:
    """The nodes of a tree that are split, as far as they are known."""
    deepest = DEEPEST if series.max_depth < 0 else series.max_depth
    fits = lambda n: n in tree.nodes and n.bit_length() <= deepest
    most = series.num_leaves - 1 if series.grow == "leaf" else None
    out: list[int] = []
    ahead = [(-tree.nodes[1].gain, 1)] if fits(1) else []
    while ahead and (most is None or len(out) < most):
        _, n = heapq.heappop(ahead)
        out.append(n)
        for child in (2 * n, 2 * n + 1):
            if fits(child):
                heapq.heappush(ahead, (-tree.nodes[child].gain, child))
    return out


def leaves(tree: Tree, split: Iterable[int]) -> dict[int, float]:
    """Value of each leaf of a tree that is split at those nodes."""
    out = {1: tree.value}
    for n in sorted(split):
        del out[n]
        out[2 * n], out[2 * n + 1] = tree.nodes[n].values
    return out


_SPLIT = "struct<feature:int,cut:int>"
_TREE = f"struct<splits:map<bigint,{_SPLIT}>,leaves:map<bigint,double>,depth:int>"


def _packed(tree: Tree, split: list[int]) -> tuple:
    return ({n: (tree.nodes[n].feature, tree.nodes[n].cut) for n in split}, leaves(tree, split), max((n.bit_length() for n in split), default=0))


def _walk(tree: Column, bins: Column) -> Column:
    """The number of the node that a row ends in."""

    def step(n: Column, _: Column) -> Column:
        at = F.try_element_at(tree["splits"], n)
        return F.when(at.isNull(), n).otherwise(2 * n + F.when(F.get(bins, at["feature"]) >= at["cut"], F.lit(1)).otherwise(F.lit(0)))

    # a step for each depth that the tree has; the number of the step isn't used
    return F.aggregate(F.filter(F.sequence(F.lit(1), F.greatest(tree["depth"], F.lit(1))), lambda d: d <= tree["depth"]), F.lit(1).cast("long"), lambda n, d: step(n, d))


def _score(trees: Column, bins: Column, start: Column) -> Column:
    return F.aggregate(trees, start, lambda s, t: s + F.try_element_at(t["leaves"], _walk(t, bins)))


def _best(state: DataFrame, model: DataFrame, least_rows: int, reg_lambda: float) -> DataFrame:
    """Of each node asked for: CONTEXT, series, node, gain, feature, cut, value, left, right. No row: it has no rows.

    state: CONTEXT, series, label, weight, bins, score; model: CONTEXT, series, trees since the state, tree (the one that
    grows), asked (nodes), mcw, rate. gain is null where no cut is allowed.
    """
    by = [*CONTEXT, "series", "node"]
    at = state.join(F.broadcast(model), [*CONTEXT, "series"]).withColumn("node", _walk(F.col("tree"), F.col("bins"))).filter(F.array_contains("asked", F.col("node")))
    p = 1 / (1 + F.exp(-_score(F.col("trees"), F.col("bins"), F.col("score"))))
    unit = lambda x: F.round(x * F.col("weight") * UNIT).cast("long")
    sums = at.select(*by, "mcw", "rate", "bins", unit(p - F.col("label")).alias("g"), unit(p * (1 - p)).alias("h"))
    cells = F.concat(F.array(F.struct(F.lit(-1).alias("feature"), F.lit(0).alias("bin"))), F.filter(F.transform("bins", lambda b, j: F.struct(j.alias("feature"), b.alias("bin"))), lambda x: x["bin"] > 0))
    counted = sums.select(*by, "mcw", "rate", "g", "h", F.explode(cells).alias("x")).groupBy(*by, "mcw", "rate", "x.feature", "x.bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count(F.lit(1)).alias("n"))
    total = lambda c: F.max(F.when(F.col("feature") == -1, F.col(c))).over(W.partitionBy(*by))
    above = W.partitionBy(*by, "feature").orderBy(F.col("bin").desc())
    both = counted.withColumns({f"all_{c}": total(c) for c in "ghn"})  # one exchange by node serves both windows and the choice
    both = both.withColumns({f"r{c}": F.sum(c).over(above) for c in "ghn"})
    real = lambda c: F.col(c) / F.lit(float(UNIT))
    gt, ht = real("all_g"), real("all_h")
    gr, hr = real("rg"), real("rh")
    gl, hl = (F.col("all_g") - F.col("rg")) / float(UNIT), (F.col("all_h") - F.col("rh")) / float(UNIT)
    square = lambda g, h: F.when(h + reg_lambda > 0, g * g / (h + reg_lambda)).otherwise(F.lit(0.0))
    value = lambda g, h: F.when(h + reg_lambda > 0, -F.col("rate") * g / (h + reg_lambda)).otherwise(F.lit(0.0))
    gain = F.round(square(gl, hl) + square(gr, hr) - square(gt, ht), 9)
    allowed = (F.col("feature") >= 0) & (F.col("rn") >= least_rows) & (F.col("all_n") - F.col("rn") >= least_rows) & (hl >= F.col("mcw")) & (hr >= F.col("mcw")) & (gain > 0)
    cut = F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"), value(gl, hl).alias("left"), value(gr, hr).alias("right"))
    found = both.groupBy(*by).agg(F.max(F.when(F.col("feature") == -1, value(gt, ht))).alias("value"), F.max(F.when(allowed, cut)).alias("s"))
    return found.select(*by, "value", "s.gain", (-F.col("s.f")).alias("feature"), (-F.col("s.b")).alias("cut"), "s.left", "s.right")


def fit(rows: DataFrame, series: list[Series], trees: int, most_bins: int = 255, least_rows: int = 1, reg_lambda: float = 0.0) -> tuple[dict[Key, list[tuple[Tree, list[int]]]], DataFrame]:
    """(trees with the nodes that are split, by context and number of the series; the binned rows).

    Boosting starts from score 0, the log odds of classes that weigh alike. A context whose training rows have one class,
    or none, has no trees.
    """
    spark = rows.sparkSession
    table = written(binned(rows, most_bins))
    train = table.filter("role = 'train' AND k1 > 0 AND k0 > 0")
    contexts = [(r[0], r[1]) for r in train.select(*CONTEXT).distinct().collect()]  # of splits, not of rows
    known: dict[Key, list[tuple[Tree, list[int]]]] = {(*c, s): [] for c in contexts for s in range(len(series))}
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("series"), weight(s.grow).alias("weight")) for i, s in enumerate(series)]))
    first = train.select(*CONTEXT, "label", "k1", "k0", "bins").select(*CONTEXT, "label", "bins", "k1", "k0", each.alias("x")).select(*CONTEXT, "x.series", "label", "x.weight", "bins", F.lit(0.0).alias("score"))
    state, since = first, 0
    tree_of = f"outer_fold int, inner_fold int, series int, trees array<{_TREE}>, tree {_TREE}, asked array<bigint>, mcw double, rate double"
    for t in range(trees):
        growing = {key: Tree() for key in known}
        asked: dict[Key, set[int]] = {key: {1} for key in known}
        while asked:
            model = [(*key, [_packed(*x) for x in known[key][since:]], _packed(growing[key], chosen(growing[key], series[key[2]])), sorted(nodes), series[key[2]].min_child_weight, series[key[2]].learning_rate) for key, nodes in asked.items()]
            for r in _best(state, spark.createDataFrame(model, tree_of), least_rows, reg_lambda).collect():
                tree = growing[r["outer_fold"], r["inner_fold"], r["series"]]
                if r["node"] == 1:
                    tree.value = r["value"]
                if r["gain"] is not None:
                    tree.nodes[r["node"]] = Node(r["gain"], r["feature"], r["cut"], (r["left"], r["right"]))
            ahead = {}
            for key, nodes in asked.items():
                own = series[key[2]]
                deepest = DEEPEST if own.max_depth < 0 else own.max_depth
                split = set(chosen(growing[key], own))
                if children := {c for n in nodes & split for c in (2 * n, 2 * n + 1) if c.bit_length() <= deepest}:
                    ahead[key] = children
            asked = ahead
        for key, tree in growing.items():
            known[key].append((tree, chosen(tree, series[key[2]])))
        if t + 1 - since >= REFRESH and t + 1 < trees:
            done = spark.createDataFrame([(*key, [_packed(*x) for x in own[since:]]) for key, own in known.items()], f"outer_fold int, inner_fold int, series int, trees array<{_TREE}>")
            before, state = state, written(state.join(F.broadcast(done), [*CONTEXT, "series"]).withColumn("score", _score(F.col("trees"), F.col("bins"), F.col("score"))).drop("trees"))
            drop(before)
            since = t + 1
    if state is not first:
        drop(state)
    return known, table


def evaluate(rows: DataFrame, candidates: DataFrame, margin: float | None, most_bins: int = 255) -> DataFrame:
    """rows: outer_fold, inner_fold, doc_id, role, label, features. One row a test document of a context and
    candidate, with its status, decision (raw score) and prediction, as models.evaluate gives them.

    Candidates that differ in n_estimators alone share their trees. Status: one_class, invalid_margin (a training
    row's signed raw score is below the gate) or ok.
    """
    spark = rows.sparkSession
    known = [r.asDict() for r in candidates.orderBy("candidate_index").collect()]  # a grid, of fixed size
    if not known:
        return spark.createDataFrame([], "outer_fold int, inner_fold int, candidate_index int, param_label string, doc_id long, label int, status string, decision double, predicted int")
    of = [Series(g["grow"], g["max_depth"], g["num_leaves"], g["learning_rate"], g["min_child_weight"]) for g in known]
    series = list(dict.fromkeys(of))
    found, table = fit(rows, series, max(g["n_estimators"] for g in known), most_bins)
    model = [(*key[:2], g["candidate_index"], [_packed(*x) for x in own[: g["n_estimators"]]]) for key, own in found.items() for g, s in zip(known, of) if series[key[2]] == s]
    trees = spark.createDataFrame(model, f"outer_fold int, inner_fold int, candidate_index int, trees array<{_TREE}>")
    return E.gated(table, trees, candidates.select("candidate_index", "param_label"), F.col("trees").isNotNull(), _score(F.col("trees"), F.col("bins"), F.lit(0.0)), F.lit(True), margin, False)
