"""Exact reasons of tree models (F3, F5): Shapley values against background rows, without coalitions.

A fitted decision tree, random forest or boosted ensemble is read from its saved
nodes into flat arrays of leaves: on each leaf's path every feature has one interval, and
the leaf has a value. For a customer x and a background row z a leaf splits its
features into those that only x keeps inside their interval (U), those that only
z keeps (V), and those that both keep. A coalition reaches the leaf if it takes all of U
and none of V from x, so with u = |U|, v = |V| the leaf's Shapley values are

    + value (u - 1)! v! / (u + v)!  for each feature of U
    - value u! (v - 1)! / (u + v)!  for each feature of V

and none at all if neither keeps some feature. A leaf's values depend on a customer only by the set of
features that the customer fails, so they are worked out once for every set (TABLE_BITS features at most) and
looked up for each customer. With the weights as integrals, (u - 1)! v! / (u + v)! = int t^(u - 1) (1 - t)^v dt over
0 to 1, the sum over the background rows for every set is one sum over subsets at each node of a quadrature that is exact
for these powers. On longer paths background rows that fail the same features
of a leaf are one group with a count, and customers that fail the same ones are one case.

Leaves and background are one broadcast, whose size the model's parameters set
(trees, depth, background rows); customers are explained where they are, in
Arrow batches, in batch and stream alike.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import factorial
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import (
    DecisionTreeClassificationModel,
    GBTClassificationModel,
    RandomForestClassificationModel,
)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import c
from ..session import scratch_path

#: Numbers of one slice (customers x leaves) that a task goes through at once.
SLICE_NUMBERS = 1 << 25
#: Pairs of a case and a background group that a task holds.
PAIRS = 1 << 20
#: Numbers of the tables of some leaves that a task works out at once: few enough for a cache of a core.
TABLE_NUMBERS = 1 << 17
#: Rows that a task holds before it explains them, as the tables of the trees are worked out once for them.
HELD_ROWS = 40_000
#: Path features of a leaf up to which its values are worked out for every set of them.
TABLE_BITS = 12


@dataclass
class Tree:
    """Leaves of one tree: (leaves x path features) features, the number of them that a leaf has, and the leaves' values.

    `nodes` are the steps down to them: (feature, threshold, bit of the feature on the path, left, right), or -1 and the leaf.
    """

    feature: np.ndarray
    width: np.ndarray
    value: np.ndarray
    nodes: list[tuple]

    def misses(self, x: np.ndarray) -> np.ndarray:
        """(leaves x rows): a bit for every path feature outside its interval; `x` is (features x rows). NaN goes right, as in the model."""
        kind = np.int16 if self.feature.shape[1] < 15 else np.int64
        out = np.zeros((len(self.value), x.shape[1]), kind)
        stack = [(0, np.zeros(x.shape[1], kind))]
        while stack:
            at, missed = stack.pop()
            feature, threshold, bit, left, right = self.nodes[at]
            if feature < 0:
                out[left] = missed
                continue
            inside = (x[feature] <= threshold).astype(kind) << kind(bit)
            stack.append((right, missed | inside))
            stack.append((left, missed | (inside ^ kind(1 << bit))))
        return out


def _tree(nodes: dict[int, tuple], scale: float) -> Tree:
    """Leaves of the nodes {id: (value, left, right, feature, threshold)} of one tree."""
    paths, values, steps, place, stack = [], [], [], {}, [(0, [])]
    while stack:
        at, path = stack.pop()
        place[at] = len(steps)
        value, left, right, feature, threshold = nodes[at]
        if left < 0:
            steps.append((-1, 0.0, 0, len(paths), 0))
            paths.append(path)
            values.append(value * scale)
            continue
        path = path if feature in path else [*path, feature]
        steps.append((feature, threshold, path.index(feature), left, right))
        stack += [(right, path), (left, path)]
    width = np.array([len(path) for path in paths])
    feature = np.zeros((len(paths), max(1, width.max())), np.int64)
    for k, path in enumerate(paths):
        feature[k, : len(path)] = path
    steps = [step if step[0] < 0 else (*step[:3], place[step[3]], place[step[4]]) for step in steps]
    return Tree(feature, width, np.array(values), steps)


def read_trees(spark: SparkSession, model) -> list[Tree]:
    """The leaves of a fitted tree model, from the node table that it saves.

    Values add up to the probability of class 1 for trees and forests, to the
    log-odds for boosted trees. Node tables have trees x 2^(depth + 1) rows at most.
    """
    path = scratch_path(spark, "trees")
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data")
    if isinstance(model, DecisionTreeClassificationModel):
        saved = saved.select(F.lit(0).alias("treeID"), F.struct("*").alias("nodeData"))
    rows = saved.select(
        "treeID",
        "nodeData.id",
        "nodeData.prediction",
        "nodeData.impurityStats",
        "nodeData.leftChild",
        "nodeData.rightChild",
        "nodeData.split.featureIndex",
        F.try_element_at("nodeData.split.leftCategoriesOrThreshold", F.lit(1)).alias("threshold"),
        "nodeData.split.numCategories",
    )
    rows = rows.collect()
    if any(r.numCategories >= 0 for r in rows if r.leftChild >= 0):
        raise ValueError("categorical splits have no interval")
    boosted = isinstance(model, GBTClassificationModel)
    weights = [1.0] if isinstance(model, DecisionTreeClassificationModel) else list(model.treeWeights)
    trees: dict[int, dict] = {}
    for r in rows:
        total = sum(r.impurityStats)
        value = r.prediction if boosted else r.impurityStats[1] / total if total else 0.0
        trees.setdefault(r.treeID, {})[r.id] = (value, r.leftChild, r.rightChild, r.featureIndex, r.threshold)
    whole = 1.0 if boosted else sum(weights)
    return [_tree(nodes, (2.0 if boosted else 1.0) * weights[k] / whole) for k, nodes in sorted(trees.items())]


def _bits(masks: np.ndarray) -> np.ndarray:
    return np.bitwise_count(masks).astype(np.int64)


class Ensemble:
    """Trees with background rows; scores and explains rows of features."""

    def __init__(self, trees: list[Tree], background: np.ndarray):
        self.trees, self.background = trees, background
        most = max(t.feature.shape[1] for t in trees)
        if most > 40:
            raise ValueError("a path has more than 40 features")
        self.taken = np.zeros((most + 1, most + 1))  # (u - 1)! v! / (u + v)!, for u > 0
        for u in range(1, most + 1):
            for v in range(most + 1 - u):
                self.taken[u, v] = factorial(u - 1) * factorial(v) / factorial(u + v)
        self.baseline = float(np.mean(self.score(background)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The model's output for each row: probability, or log-odds of boosted trees."""
        columns = np.ascontiguousarray(x.T)
        out = np.zeros(len(x))
        for tree in self.trees:
            step = max(1, SLICE_NUMBERS // len(tree.value))
            for lo in range(0, len(x), step):
                out[lo : lo + step] += tree.value @ (tree.misses(columns[:, lo : lo + step]) == 0)
        return out

    def explain(self, x: np.ndarray) -> np.ndarray:
        """(rows x features) Shapley values; each row sums to its score less the baseline."""
        columns, out = np.ascontiguousarray(x.T), np.zeros(x.shape[::-1])
        background = np.ascontiguousarray(self.background.T)
        for tree in self.trees:
            own = tree.misses(background)
            step = max(1, SLICE_NUMBERS // len(tree.value))
            for lo in range(0, len(x), step):
                missed = tree.misses(columns[:, lo : lo + step])
                for width in np.unique(tree.width[tree.width > 0]):
                    leaves = np.flatnonzero(tree.width == width)
                    add = self._add_tables if width <= TABLE_BITS else self._add_cases
                    add(tree, leaves, int(width), own, missed, out[:, lo : lo + step])
        return np.ascontiguousarray(out.T)

    def _add_tables(self, tree: Tree, leaves: np.ndarray, width: int, own: np.ndarray, missed: np.ndarray, out: np.ndarray) -> None:
        """Adds the values of leaves with as many path features, looked up by the features that a row misses."""
        nodes, weights = np.polynomial.legendre.leggauss((width + 1) // 2)
        sets = np.arange(1 << width)
        size = _bits(sets)[:, None]
        more = sets | (1 << np.arange(width))[:, None]  # each set with one feature more
        step = max(1, TABLE_NUMBERS // (width << width))
        part = np.empty(missed.shape[1])
        for lo in range(0, len(leaves), step):
            some = leaves[lo : lo + step]
            where = own[some].astype(np.int64) * len(some) + np.arange(len(some))[:, None]
            shares = np.bincount(where.ravel(), minlength=len(sets) * len(some)).reshape(len(sets), -1) / own.shape[1]
            now, then = np.zeros((2, *shares.shape))
            for t, w in zip((nodes + 1) / 2, weights / 2):
                held = shares * t**size
                for k in range(width):  # summed over all subsets of a set
                    halves = held.reshape(len(sets) >> (k + 1), 2, -1)
                    halves[:, 1] += halves[:, 0]
                # background rows that miss no feature of the set, by what it gives to the others and to one more
                held = held[::-1] * (w * (1 - t) ** (size - 1) / t)
                then += held
                now += held * (1 - t)
            now, then = (np.ascontiguousarray(x.T) * tree.value[some][:, None] for x in (now, then))
            values = np.take(then, more, axis=1)
            np.subtract(now[:, None, :], values, out=values)
            for leaf, table in zip(some, values):
                at = missed[leaf].astype(np.intp)
                for k in range(width):
                    table[k].take(at, out=part, mode="clip")
                    out[tree.feature[leaf, k]] += part

    def _add_cases(self, tree: Tree, leaves: np.ndarray, width: int, own: np.ndarray, missed: np.ndarray, out: np.ndarray) -> None:
        """Adds the values of leaves with as many path features, by pairs of cases and background groups."""
        step = max(1, SLICE_NUMBERS // (len(leaves) * width))
        at = np.broadcast_to(np.arange(len(leaves))[:, None], (len(leaves), own.shape[1]))
        keys, counts = np.unique(np.stack([at.ravel(), own[leaves].ravel()], axis=1), axis=0, return_counts=True)
        groups = keys[:, 1], counts / own.shape[1], np.searchsorted(keys[:, 0], np.arange(len(leaves) + 1))
        for lo in range(0, missed.shape[1], step):
            self._add_slice(tree, leaves, width, groups, missed[leaves, lo : lo + step].T, out[:, lo : lo + step])

    def _add_slice(self, tree: Tree, leaves: np.ndarray, width: int, groups: tuple, missed: np.ndarray, out: np.ndarray) -> None:
        masks, shares, first = groups
        cases, case_of = np.unique((np.arange(len(leaves)) << width) | missed, return_inverse=True)
        leaf, mine_of = cases >> width, cases & ((1 << width) - 1)
        # every case meets the background groups of its leaf, in runs of cases with a bounded number of pairs
        sizes = first[leaf + 1] - first[leaf]
        parts = np.zeros((width, len(cases)))
        ends = np.cumsum(sizes)
        lo = 0
        while lo < len(cases):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
            size, mine = sizes[lo:hi], mine_of[lo:hi]
            case = np.repeat(np.arange(hi - lo), size)
            group = np.arange(len(case)) + np.repeat(first[leaf[lo:hi]] - np.cumsum(size) + size, size)
            met = (masks[group] & mine[case]) == 0  # no feature that both miss
            case, group = case[met], group[met]
            u, v = _bits(masks[group]), _bits(mine[case])
            weight = tree.value[leaves[leaf[lo:hi][case]]] * shares[group]
            for_u = weight * self.taken[u, v]
            for_v = np.bincount(case, weight * self.taken[v, u], hi - lo)
            for k in range(width):
                parts[k, lo:hi] = np.bincount(case, for_u * (masks[group] >> k & 1), hi - lo) - for_v * (mine >> k & 1)
            lo = hi
        some = parts.any(axis=0)
        case_of = case_of.reshape(missed.shape)
        row, at = np.nonzero(some[case_of])
        which = case_of[row, at]
        for k in range(width):
            where = tree.feature[leaves[at], k] * out.shape[1] + row
            out += np.bincount(where, parts[k][which], out.size).reshape(out.shape)


@dataclass
class TreeExplainer:
    """Reasons of a fitted tree model: the same interface as LinearExplainer, for batch and streaming frames."""

    feature_names: list[str]
    ensemble: Ensemble
    shared: object  # broadcast of the ensemble

    @classmethod
    def fit(cls, model, feature_names: list[str], background: DataFrame) -> "TreeExplainer":
        """`background` is a bounded sample (`background_sample(..., n)`) with the features; it is collected."""
        if not isinstance(model, (DecisionTreeClassificationModel, RandomForestClassificationModel, GBTClassificationModel)):
            raise ValueError(f"no tree model: {type(model).__name__}")
        spark = background.sparkSession
        rows = background.select(*[c(f).cast("double").alias(f"b{i}") for i, f in enumerate(feature_names)]).collect()
        if not rows:
            raise ValueError("empty background")
        ensemble = Ensemble(read_trees(spark, model), np.array(rows, dtype=np.float64))
        return cls(list(feature_names), ensemble, spark.sparkContext.broadcast(ensemble))

    @property
    def baseline(self) -> float:
        """Mean output of the background rows."""
        return self.ensemble.baseline

    def inputs(self) -> Column:
        return F.array(*[c(f).cast("double") for f in self.feature_names])

    def impacts(self) -> Column:
        """array<double>: the Shapley value of every feature, in list order."""
        shared, width = self.shared, len(self.feature_names)

        @F.pandas_udf("array<double>")
        def explained(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            held: list[np.ndarray] = []

            def values():
                phi = shared.value.explain(np.concatenate(held))
                ends = np.cumsum([len(rows) for rows in held])
                return [pd.Series(list(part), dtype=object) for part in np.split(phi, ends[:-1])]

            for x in batches:
                held.append(np.array([np.array(r, np.float64) for r in x]) if len(x) else np.empty((0, width)))
                if sum(map(len, held)) >= HELD_ROWS:
                    yield from values()
                    held = []
            if held:
                yield from values()

        return explained(self.inputs())

    def contributions(self) -> Column:
        """array<struct<k, idx, feature, value, impact>> in list order; k = -|impact| ranks the reasons."""
        names = F.array(*[F.lit(f) for f in self.feature_names])
        parts = F.arrays_zip(self.impacts().alias("impact"), self.inputs().alias("value"), names.alias("feature"))
        return F.transform(
            parts,
            lambda r, i: F.struct(
                (-F.abs(r["impact"])).alias("k"), i.alias("idx"), r["feature"].alias("feature"), r["value"].alias("value"), r["impact"].alias("impact")
            ),
        )


def dealt_to_tasks(df: DataFrame) -> DataFrame:
    """`df` dealt over all cores: its rows are few bytes for the work that each takes, so the sizes of files or shuffles would
    leave them in a few partitions. One task a core, as each works out the tables of the trees for itself."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def tree_shapley(features: DataFrame, explainer: TreeExplainer, key: str) -> DataFrame:
    """Long (key, feature, idx, phi) for every row of `features`."""
    names = F.array(*[F.lit(f) for f in explainer.feature_names])
    long = dealt_to_tasks(features).select(F.col(key), F.posexplode(explainer.impacts()).alias("idx", "phi"))
    return long.select(key, F.element_at(names, F.col("idx") + 1).alias("feature"), "idx", "phi")
