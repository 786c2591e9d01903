"""Near-duplicate embeddings: exact cosine links by cover-tree dual traversal over metric cells."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import components, discard, written
from plumbline.llm.topk import finite

#: Vectors from which a cell is split, pivots of one split at most, and points from which a node is a leaf.
CELL, FAN, LEAF = 2048, 16, 24
#: Points of a large cell that one group gets, on average.
LOT = 4096
#: Rounds without a change of the large cells after which splitting gives up, loudly.
STUCK = 8
#: Rounding that bounds allow for.
SLACK = 1e-9


class Node:
    """A cover-tree node: a centre, the largest distance of its points, and children or the points themselves."""

    __slots__ = ("centre", "radius", "points", "children", "centres", "radii")

    def __init__(self, unit: np.ndarray, points: np.ndarray, cover: float, finest: float = 0.0):
        """``points`` begin with the centre; the children's points lie within ``cover / 2`` of their own centres.

        A node no wider than ``finest`` is a leaf: bounds between its parts would rule nothing out.
        """
        self.centre, self.points, self.children = points[0], points, []
        away = distance(unit[points], unit[points[:1]])[:, 0]
        self.radius = float(away.max())
        if len(points) <= LEAF or self.radius <= finest:
            return
        cover = min(cover, self.radius) / 2
        left = points
        while len(left):
            near = distance(unit[left], unit[left[:1]])[:, 0] <= cover
            near[0] = True
            self.children.append(Node(unit, left[near], cover, finest))
            left = left[~near]
        self.centres = np.array([c.centre for c in self.children])
        self.radii = np.array([c.radius for c in self.children])


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def dual_traversal(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All ``(i, j)`` with cosine(a[i], b[j]) >= threshold, by descending two cover trees together.

    A pair of nodes is dropped where the distance of the centres exceeds both covering radii and the distance that the
    threshold stands for; what is left is compared in double precision.
    """
    lengths = [np.sqrt((m * m).sum(1)) for m in (a, b)]
    ua, ub = a / lengths[0][:, None], b / lengths[1][:, None]
    reach = float(np.sqrt(max(2.0 - 2.0 * threshold, 0.0))) + SLACK
    trees = [Node(u, np.arange(len(u)), 2.0, reach / 2) for u in (ua, ub)]
    none = np.zeros(0, np.int64)
    out_a, out_b, todo = [none], [none], [tuple(trees)]
    while todo:
        x, y = todo.pop()
        if not x.children and not y.children:
            cosine = (a[x.points] @ b[y.points].T) / (lengths[0][x.points][:, None] * lengths[1][y.points][None, :])
            i, j = np.nonzero(cosine >= threshold)
            out_a.append(x.points[i])
            out_b.append(y.points[j])
            continue
        xs, xc, xr = (x.children, x.centres, x.radii) if x.children else ([x], np.array([x.centre]), np.array([x.radius]))
        ys, yc, yr = (y.children, y.centres, y.radii) if y.children else ([y], np.array([y.centre]), np.array([y.radius]))
        near = distance(ua[xc], ub[yc]) <= xr[:, None] + yr[None, :] + reach
        todo += [(xs[i], ys[j]) for i, j in np.argwhere(near)]
    return np.concatenate(out_a), np.concatenate(out_b)


def least_reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index that links reach from each of ``n`` indexes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def cells(points: DataFrame) -> DataFrame:
    """Adds ``cell`` to ``(uid, root, v, n_rows)``: a path of nested cells of the nearest of some pivots, until none is large.

    ``root`` holds no dot. A large cell's points are dealt to lots of bounded size, by hash; a lot gets its cell's pivots once. Points that are as near
    to several pivots fall to one of them by hash, so that even points of one direction come apart. Points of small cells aren't written again.
    """
    columns = ["uid", "root", "v", "n_rows", "cell"]
    points = points.withColumn("cell", F.col("root").cast("string")).select(*columns)
    points = written(points, "cells")
    done, largest, stuck, depth = [], None, 0, 0
    while True:
        sizes = points.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CELL)
        now = tuple(sizes.agg(F.max("n"), F.count("*")).first())
        if not now[1]:
            return reduce(DataFrame.unionByName, done, points)
        stuck = stuck + 1 if largest == now else 0
        if stuck >= STUCK:
            raise RuntimeError(f"{now[1]} cells of up to {now[0]} vectors don't come apart")
        largest = now
        sized = written(points.hint("merge").join(sizes.hint("rebalance").hint("merge"), "cell", "left").select(*columns, "n"), "sized")
        discard(points)
        done.append(sized.where("n IS NULL").select(*columns))
        lots = F.ceil(F.col("n") / LOT)
        large = sized.where("n IS NOT NULL").withColumn("lot", F.pmod(F.xxhash64("uid", F.lit(~depth)), lots))
        share = F.least(F.lit(FAN), F.ceil(F.col("n") * 2 / CELL)) / F.col("n")
        drawn = F.pmod(F.xxhash64("uid", F.lit(depth)), F.lit(1 << 30)) < share * (1 << 30)
        pivots = large.where(drawn).groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("uid", "v"))).alias("pivots"), F.first(lots).alias("lots"))
        pivots = pivots.select(F.col("cell").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), "pivots")

        def nearest(rows: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:  # noqa: B023  run before the next round
            chosen = held["pivots"].iloc[0] if len(held) else []
            if len(chosen) >= 2 and len(rows):
                m, own = _matrix(pd.Series([p["v"] for p in chosen])), _matrix(rows["v"])
                close = (own / np.sqrt((own * own).sum(1))[:, None]) @ (m / np.sqrt((m * m).sum(1))[:, None]).T
                tied = close >= close.max(1)[:, None] - SLACK
                pick = ((rows["uid"].to_numpy(np.int64) * 0x9E3779B1 >> 7) + depth) % tied.sum(1)
                at = (np.cumsum(tied, 1) > pick[:, None]).argmax(1)
                rows = rows.assign(cell=[f"{c}.{i}" for c, i in zip(rows["cell"], at)])
            return rows[columns]

        split = large.select(*(F.col(c).alias(c) for c in (*columns, "lot"))).groupBy("cell", "lot").cogroup(pivots.groupBy("cell", "lot"))
        points = written(split.applyInPandas(nearest, sized.select(*columns).schema), "cells")
        depth += 1


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)


def _apart(x: Column, y: Column) -> Column:
    """Distance of two vectors' directions."""
    return F.sqrt(F.greatest(2.0 - 2.0 * _dot(x, y) / F.sqrt(_dot(x, x) * _dot(y, y)), F.lit(0.0)))


def tree(points: DataFrame) -> tuple[DataFrame, int]:
    """``node, parent, centre, radius, leaf`` of all cells and those around them, and the depth of the deepest.

    Cells' radii are taken over their points. Further up, a node's centre is that of one of its cells, and its radius the
    largest of their distances and radii together, so no level but the lowest looks at points. There is a row per cell: a
    two-thousandth of the points, or thereabouts.
    """
    centres = points.groupBy("root", "cell").agg(F.min_by("v", "uid").alias("centre"))
    held = points.hint("merge").join(centres.hint("rebalance").hint("merge"), ["root", "cell"])
    level = held.groupBy("root", "cell").agg(F.max(_apart(F.col("v"), F.col("centre"))).alias("radius"), F.first("centre").alias("centre"))
    depth = F.size(F.split("cell", r"\.", -1)) - 1
    leaves = written(level.select(F.col("cell").alias("node"), "centre", "radius", depth.alias("depth")), "leaves")
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    parent = F.regexp_replace("node", r"\.[^.]*$", "")
    every, below = [leaves.withColumn("leaf", F.lit(True))], None
    for at in range(deepest, 0, -1):
        own = leaves.where(F.col("depth") == at)
        below = (own if below is None else own.unionByName(below)).withColumn("parent", parent)
        middle = below.groupBy("parent").agg(F.min_by("centre", "node").alias("middle"))
        wide = below.hint("merge").join(middle.hint("merge"), "parent").groupBy("parent").agg(F.first("middle").alias("centre"), F.max(_apart(F.col("centre"), F.col("middle")) + F.col("radius")).alias("radius"))
        below = written(wide.select(F.col("parent").alias("node"), "centre", "radius", F.lit(at - 1).alias("depth")), "level")
        every.append(below.withColumn("leaf", F.lit(False)))
    nodes = reduce(DataFrame.unionByName, every)
    return written(nodes.withColumn("parent", F.when(F.col("depth") > 0, parent)), "tree"), deepest


def cell_pairs(nodes: DataFrame, deepest: int, threshold: float) -> DataFrame:
    """``left, right`` (left <= right) of cells that may hold a link: the tree is descended pair by pair, from each root with itself.

    A pair of nodes is dropped where the distance of the centres exceeds both radii and the distance that the threshold stands for, and
    only pairs that are left look at their children.
    """
    reach = float(np.sqrt(max(2.0 - 2.0 * threshold, 0.0))) + 1e-6
    side = lambda n, of: nodes.where(of).select(F.col("parent").alias(n), F.col("node").alias(f"{n}_kid"), F.col("centre").alias(f"{n}_c"), F.col("radius").alias(f"{n}_r"))
    stay = lambda n: nodes.where("leaf").select(F.col("node").alias(n), F.col("node").alias(f"{n}_kid"), F.col("centre").alias(f"{n}_c"), F.col("radius").alias(f"{n}_r"))
    kids = {n: side(n, F.col("parent").isNotNull()).unionByName(stay(n)) for n in ("left", "right")}
    pairs = written(nodes.where("depth = 0").select(F.col("node").alias("left"), F.col("node").alias("right")), "cellpairs")
    for _ in range(deepest):
        last = pairs
        both = last.hint("merge").join(kids["left"].hint("merge"), "left").hint("merge").join(kids["right"].hint("merge"), "right")
        once = (F.col("left") != F.col("right")) | (F.col("left_kid") <= F.col("right_kid"))
        both = both.where(once & (_apart(F.col("left_c"), F.col("right_c")) <= F.col("left_r") + F.col("right_r") + reach))
        pairs = written(both.select(F.least("left_kid", "right_kid").alias("left"), F.greatest("left_kid", "right_kid").alias("right")), "cellpairs")
        discard(last)
    return pairs


def links(points: DataFrame, threshold: float) -> DataFrame:
    """``uid, n, other``: for points with links, how many rows each pair of cells links them with, and their least partner."""
    nodes, deepest = tree(points)
    pairs = cell_pairs(nodes, deepest, threshold)

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"uid": [], "n": [], "other": []}, dtype="int64")
        same = bool(x["left"].iloc[0] == x["right"].iloc[0])
        x, y = x.sort_values("uid"), y.sort_values("uid")
        i, j = dual_traversal(_matrix(x["v"]), _matrix(y["v"]), threshold)
        if same:
            i, j = i[i != j], j[i != j]
        ids = np.concatenate([x["uid"].to_numpy(), [] if same else y["uid"].to_numpy()]).astype(np.int64)
        count = np.bincount(i, weights=y["n_rows"].to_numpy(np.float64)[j], minlength=len(ids))
        if not same:
            count += np.bincount(j + len(x), weights=x["n_rows"].to_numpy(np.float64)[i], minlength=len(ids))
        root = ids[least_reachable(len(ids), i, j if same else j + len(x))]
        held = count > 0
        return pd.DataFrame({"uid": ids[held], "n": count[held].astype(np.int64), "other": root[held]})

    fresh = lambda df: df.select(*(F.col(c).alias(c) for c in df.columns))  # noqa: E731  both sides are of one table
    sides = [fresh(points.withColumnRenamed("cell", side).hint("merge").join(pairs.hint("merge"), side).select("left", "right", "uid", "v", "n_rows")).groupBy("left", "right") for side in ("left", "right")]
    return sides[0].cogroup(sides[1]).applyInPandas(compare, "uid long, n long, other long")


def embedding_groups(vectors: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row; rows link where labels are equal and cosine >= threshold.

    Equal vectors of one label are one point that counts for all its rows. Labels (with lengths) are numbered. Points of one number fall
    into nested cells, split at pivots until none is large, with a centre and a covering radius each. The nested cells are descended
    pair by pair, level by level, as tables; only cells that the triangle inequality can't rule out on the way meet, in groups of
    bounded size, where two cover trees with halving radii are traversed together and what is left is compared exactly. A group sends back counts and one link per point, never
    its pairs. Where vectors have no metric structure, pruning at the cells is weak, and the work is that of all pairs
    of a label, as it must be for an exact result; memory stays bounded.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, nor do rows whose
    label is null; vectors of different lengths never link. Ids may repeat (each row counts); rows with a null id are
    partners of others, but never a component's id unless it has no other (then it is null, and ``kept`` is false).
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    valid = F.col("label").isNotNull() & finite(F.col("v")) & F.coalesce(F.exists("v", lambda c: c != 0), F.lit(False))
    rows = rows.withColumn("valid", valid)
    classes = rows.where("valid").groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n_rows"))
    classes = written(classes.withColumns({"uid": F.monotonically_increasing_id(), "length": F.size("v")}), "classes")
    roots = written(classes.select(F.col("label").alias("label"), F.col("length").alias("length")).distinct().withColumn("root", F.monotonically_increasing_id()), "roots")
    points = cells(classes.hint("merge").join(roots.hint("rebalance").hint("merge"), ["label", "length"]).select("uid", "root", "v", "n_rows"))
    found = written(links(points, threshold), "links")
    counts = found.groupBy("uid").agg(F.sum("n").alias("n"))
    reached = components(found.select(F.col("uid").alias("u"), F.col("other").alias("v")), "veclinks")
    parts = classes.select("uid", "least").hint("merge").join(reached.withColumnRenamed("node", "uid").hint("merge"), "uid", "left").select("uid", "least", F.coalesce("component", "uid").alias("part"))
    least = parts.groupBy("part").agg(F.min("least").alias("component_id"))
    named = parts.select("uid", "part").hint("merge").join(least.hint("rebalance").hint("merge"), "part").hint("merge").join(counts.hint("merge"), "uid", "left")
    named = classes.select("uid", "label", "v", "n_rows").hint("merge").join(named.select("uid", "component_id", "n").hint("merge"), "uid")
    named = named.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("n_rows") - 1).alias("n_links"), "component_id")
    linked = rows.where("valid").select("vec_id", "v", "label").hint("merge").join(named.hint("rebalance").hint("merge"), ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("valid")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: The same in DuckDB: all pairs, and the links' closure.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (
  SELECT a.vec_id AS u, b.vec_id AS v FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
c AS (SELECT u, min(v) AS component_id FROM r GROUP BY u),
n AS (SELECT u, count(*) AS n FROM l GROUP BY u)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN c ON c.u = e.vec_id LEFT JOIN n ON n.u = e.vec_id
"""
