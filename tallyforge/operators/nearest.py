"""Exact nearest-neighbour and radius searches as equi-joins.

1. Points at the same place are collapsed first, so a group of copies is one place however large
   it is; at most the ``k + 1`` smallest keys of a place can ever be among the nearest.
2. A sample of places serves as pivots of a tree of two levels: about the square root of them are tops,
   and every other pivot hangs on its nearest top. Every point belongs to the cell of the nearest pivot
   of its nearest top, so cells stay small while the table grows (up to ``PIVOT_BYTES`` of pivots).
3. A nearest search first compares every query with its own cell, which bounds the distance of its
   k-th neighbour; by the triangle inequality it then has to visit only the cells whose nearest possible
   point is within that bound, tops first. What a task reports are its k best within the bound, so the
   rows that are shuffled stay near the number of results.
4. Points and visiting queries of a cell are packed into blocks of bounded size, and a numpy
   kernel compares block with block, so no task holds a cell and no pair list is ever produced. Where
   most cells have to be visited anyway (many dimensions), the tops serve as cells, so that a query is
   not copied more often than it helps; where most tops are open too, all places are one cell and
   blocks meet in a grid.
5. Vectors of more than ``NARROW`` numbers are compared by matrix products first. Their rounding error
   is bounded, so they only sort out what cannot count; what is left is measured dimension by dimension.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.session import materialise

# Points a cell is meant for, and the most that all pivots together may take.
CELL_ROWS = 128
PIVOT_BYTES = 32_000_000
# Share of all cells beyond which the tops serve as cells.
COARSE_SHARE = 0.25
BLOCK = 1024
# Queries whose cells are looked up at once.
PART = 512
# Blocks of a cell that are compared by one task.
GROUP = 8
# Share of all tops beyond which all places are one cell, and its blocks and least groups a side.
WHOLE_SHARE = 0.25
WHOLE_BLOCK = 2048
WHOLE_GROUP = 16
WHOLE_SIDE = 8
# Most dimensions that are compared directly, and rows of a block that are compared at once.
NARROW = 8
ROWS_AT_ONCE = 512


def distances(q: np.ndarray, p: np.ndarray, metric: str) -> np.ndarray:
    """All distances of two blocks, summed dimension by dimension."""
    total = np.zeros((len(q), len(p)))
    for j in range(q.shape[1]):
        gap = q[:, j, None] - p[None, :, j]
        total += np.abs(gap) if metric == "manhattan" else gap * gap
    return total if metric == "manhattan" else np.sqrt(total)


def _squares(q: np.ndarray, p: np.ndarray):
    """Squared distances by one product of single-precision matrices and, per row, a bound of their
    error; none where the numbers are too large or not finite."""
    with np.errstate(all="ignore"):
        middle = p.mean(axis=0)
        q, p = q - middle, p - middle
        qq, pp = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", p, p)
        if not (np.isfinite(qq).all() and np.isfinite(pp).all() and max(qq.max(), pp.max()) < 1e30):
            return None
    away = np.sqrt(qq) + np.sqrt(pp.max())
    error = 8.0 * (q.shape[1] + 8) * (np.finfo(np.float32).eps * away + np.finfo(float).eps * np.abs(middle).max()) * away + 1e-30
    ones = lambda x: np.ones((len(x), 1))
    left = np.hstack([-2.0 * q, qq[:, None], ones(q)]).astype(np.float32)
    right = np.hstack([p, ones(p), pp[:, None]]).astype(np.float32)
    return left @ right.T, error


def _rough(q: np.ndarray, p: np.ndarray, metric: str, side: int) -> np.ndarray:
    """Distances that are never below (``side`` 1) or never above (-1) the true ones, and next to them."""
    found = _squares(q, p) if metric == "euclidean" and q.shape[1] > NARROW and len(q) and len(p) else None
    if found is None:
        return distances(q, p, metric)
    return np.sqrt(np.maximum(found[0].astype(float) + side * found[1][:, None], 0.0))


def _paired(q: np.ndarray, p: np.ndarray, metric: str) -> np.ndarray:
    """Distances of row to row, summed as in ``distances``."""
    total = np.zeros(len(q))
    for j in range(q.shape[1]):
        gap = q[:, j] - p[:, j]
        total += np.abs(gap) if metric == "manhattan" else gap * gap
    return total if metric == "manhattan" else np.sqrt(total)


def _closest(q: np.ndarray, bound: np.ndarray, p: np.ndarray, m: int, metric: str):
    """Rows, columns and distances of all pairs within the bounds that are among the ``m`` best of
    their row, and some more."""
    found = _squares(q, p) if metric == "euclidean" and q.shape[1] > NARROW else None
    if found is None:
        d = distances(q, p, metric)
        row, col = np.nonzero(d <= np.minimum(np.partition(d, m - 1, axis=1)[:, m - 1], bound)[:, None])
        return row, col, d[row, col]
    squares, error = found
    limit = bound * bound * (1.0 + 1e-6) + error
    inside = squares <= limit.astype(np.float32)[:, None]
    at = np.flatnonzero(inside)
    many = np.flatnonzero(np.bincount(at // len(p), minlength=len(q)) > 4 * m)
    if len(many):
        some = squares[many]
        best = np.partition(some, m - 1, axis=1)[:, m - 1] * (1.0 + 1e-6) + 2.0 * error[many]
        inside[many] &= some <= best.astype(np.float32)[:, None]
        at = np.flatnonzero(inside)
    row, col = np.divmod(at, len(p))
    d = _paired(q[row], p[col], metric)
    near = d <= bound[row]
    return row[near], col[near], d[near]


def unit(x: Column) -> Column:
    """A vector scaled to length 1; the chord between unit vectors orders by cosine distance."""
    length = F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(x, lambda v: F.when(length > 0, v / length).otherwise(v))


class Cells:
    """The cells of a set of places, and which of them a query has to visit."""

    def __init__(self, places: DataFrame, metric: str, weight: str | None = None):
        self.metric = metric
        n = places.count()
        first = places.select(F.size("x").alias("width")).first()
        self.width = first.width if first else 0
        m = max(1, min(-(-n // CELL_ROWS), PIVOT_BYTES // (8 * max(1, self.width))))
        rows = places.select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(m).collect()
        self._tree(np.array([r.x for r in rows], dtype=float).reshape(len(rows), self.width))
        self.places = places.withColumn("_near", self._assign()(F.col("x"))).select(
            *places.columns, F.col("_near.cell").alias("cell"), F.col("_near.top").alias("top"),
            F.col("_near.away").alias("away"), F.col("_near.away_top").alias("away_top"))
        held = F.sum(weight) if weight else F.count("*")
        facts = self.places.groupBy("cell").agg(
            held.alias("held"), F.count("*").alias("n"), F.max("away").alias("reach"), F.max("away_top").alias("reach_top")).collect()
        cells, tops = len(self.pivots), len(self.tops)
        self.rows, self.held, self.reach = np.zeros(cells, np.int64), np.zeros(cells), np.full(cells, -np.inf)
        self.reach_top = np.full(tops, -np.inf)
        for r in facts:
            self.rows[r.cell], self.held[r.cell], self.reach[r.cell] = r.n, r.held, r.reach
            self.reach_top[self.owner[r.cell]] = max(self.reach_top[self.owner[r.cell]], r.reach_top)
        self.coarse = self.whole = False
        self.block, self.group = BLOCK, GROUP

    def _tree(self, pivots: np.ndarray) -> None:
        """The first pivots are tops; all of them are ordered by their nearest top."""
        self.tops = pivots[:math.isqrt(len(pivots)) + 1]
        nearest_top = [distances(pivots[i:i + BLOCK], self.tops, self.metric).argmin(axis=1) for i in range(0, len(pivots), BLOCK)]
        used, owner = np.unique(np.concatenate(nearest_top) if nearest_top else np.zeros(0, np.int64), return_inverse=True)
        self.tops = self.tops[used]  # 0.0 and -0.0 are two pivots at one place
        order = np.argsort(owner, kind="stable")
        self.pivots, self.owner = pivots[order], owner[order]
        self.ends = np.searchsorted(self.owner, np.arange(len(self.tops) + 1))

    def _assign(self):
        tree = (self.tops, self.pivots, self.ends, self.metric)

        @F.pandas_udf("cell int, top int, away double, away_top double")
        def assign(xs: pd.Series) -> pd.DataFrame:
            return _in_parts(lambda xs: pd.DataFrame(dict(zip(("cell", "top", "away", "away_top"), _descend(_rows(xs), *tree)[:4]))), xs)

        return assign

    def _bounds(self, k: int):
        """Own cell of a query and a distance within which there are ``k`` points for certain."""
        tree, held, reach, reach_top = (self.tops, self.pivots, self.ends, self.metric), self.held, self.reach, self.reach_top
        held_top = np.add.reduceat(held, self.ends[:-1]) if len(held) else np.zeros(0)

        def part(xs: pd.Series) -> pd.DataFrame:
            x = _rows(xs)
            cell, top, _, _, tops = _descend(x, *tree)
            bound = _enough(tops + reach_top, held_top, k)
            for t in np.unique(top):
                mine, cells = top == t, slice(tree[2][t], tree[2][t + 1])
                far = _rough(x[mine], tree[1][cells], tree[3], 1) + reach[cells]
                bound[mine] = np.minimum(bound[mine], _enough(far, held[cells], k))
            return pd.DataFrame({"cell": cell, "top": top, "bound": bound})

        @F.pandas_udf("cell int, top int, bound double")
        def bounds(xs: pd.Series) -> pd.DataFrame:
            return _in_parts(part, xs)

        return bounds

    def _visited(self):
        """The cells that a query has to visit within its bound."""
        tops, pivots, ends, metric = self.tops, self.pivots, self.ends, self.metric
        reach, reach_top, coarse = self.reach, self.reach_top, self.coarse
        slack = 1e-9 * (1.0 + np.abs(pivots).max(initial=0.0))

        def lists(xs: pd.Series, bounds: pd.Series, coarse: bool):
            x, bound = _rows(xs), bounds.to_numpy(float)[:, None] + slack
            with np.errstate(invalid="ignore"):
                open_tops = np.concatenate([_rough(x[i:i + BLOCK], tops, metric, -1) for i in range(0, len(x), BLOCK)] or [np.zeros((0, len(tops)))])
                open_tops = (open_tops - reach_top <= bound) & np.isfinite(reach_top)
                if coarse:
                    return np.nonzero(open_tops)
                row, cell = [], []
                for t in np.flatnonzero(open_tops.any(axis=0)):
                    asked, cells = np.flatnonzero(open_tops[:, t]), slice(ends[t], ends[t + 1])
                    near = (_rough(x[asked], pivots[cells], metric, -1) - reach[cells] <= bound[asked]) & np.isfinite(reach[cells])
                    i, j = np.nonzero(near)
                    row.append(asked[i])
                    cell.append(j + ends[t])
            return np.concatenate(row or [np.zeros(0, int)]), np.concatenate(cell or [np.zeros(0, int)])

        def named(xs: pd.Series, bounds: pd.Series) -> pd.Series:
            row, cell = lists(xs, bounds, coarse)
            order = np.argsort(row, kind="stable")
            cuts = np.searchsorted(row[order], np.arange(1, len(xs)))
            return pd.Series(np.split(cell[order].astype(np.int32), cuts)[:len(xs)])

        def counted(xs: pd.Series, bounds: pd.Series) -> pd.DataFrame:
            return pd.DataFrame({name: np.bincount(lists(xs, bounds, coarse)[0], minlength=len(xs))
                                 for name, coarse in (("cells", False), ("tops", True))})

        @F.pandas_udf("array<int>")
        def visited(xs: pd.Series, bounds: pd.Series) -> pd.Series:
            return _in_parts(named, xs, bounds)

        @F.pandas_udf("cells long, tops long")
        def number(xs: pd.Series, bounds: pd.Series) -> pd.DataFrame:
            return _in_parts(counted, xs, bounds)

        return visited, number

    def visits(self, queries: DataFrame) -> DataFrame:
        """One row per query (``site, x, bound``) and cell to visit. The size of the cells, not the
        result, follows from how many of them are visited."""
        number = queries.select(self._visited()[1]("x", "bound").alias("n")).agg(
            F.avg("n.cells").alias("cells"), F.avg("n.tops").alias("tops")).first()
        self.coarse = (number.cells or 0.0) > COARSE_SHARE * len(self.pivots)
        self.whole = self.coarse and self.width > NARROW and number.tops > WHOLE_SHARE * len(self.tops)
        if self.whole:
            self.block = WHOLE_BLOCK
            self.group = int(min(WHOLE_GROUP, max(1, -(-self.rows.sum() // (WHOLE_SIDE * WHOLE_BLOCK)))))
            return queries.withColumn("cell", F.lit(0))
        return queries.withColumn("cell", F.explode(self._visited()[0]("x", "bound")))

    def points(self) -> DataFrame:
        """The places with the cells that ``visits`` has chosen."""
        if self.whole:
            return self.places.withColumn("cell", F.lit(0))
        return self.places.withColumn("cell", F.col("top")) if self.coarse else self.places

    def sizes(self) -> np.ndarray:
        if self.whole:
            return np.array([self.rows.sum()])
        return np.add.reduceat(self.rows, self.ends[:-1]) if self.coarse else self.rows

    def block_pairs(self, queries: DataFrame, carry: list[str]) -> DataFrame:
        """Joins packed query blocks (``site, x, cell, bound``) with packed point blocks of their cell.

        A crowded cell is cut into groups of blocks on both sides, and each group of the one side
        is sent to each group of the other, so its comparisons spread over many tasks.
        """
        sizes = self.sizes()
        calls = {r.cell: r.n for r in queries.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        plan = []
        for cell, n in calls.items():
            q_blocks, p_blocks = -(-n // self.block), -(-int(sizes[cell]) // self.block)
            plan.append((cell, q_blocks, p_blocks, -(-q_blocks // self.group), -(-p_blocks // self.group)))
        table = F.broadcast(queries.sparkSession.createDataFrame(  # one row per cell, no more than pivots
            plan, "cell int, q_blocks long, p_blocks long, q_groups long, p_groups long"))
        q = _pack(queries.join(table, "cell"), "site", ["bound"], "q", "p", self.group)
        p = _pack(self.points().join(table, "cell"), "key", carry, "p", "q", self.group)
        keys = ["cell", "q_group", "p_group"]
        if self.whole and plan:  # few bytes, many comparisons: partitions by the number of meetings
            q, p = (side.repartition(2 * plan[0][3] * plan[0][4], *keys) for side in (q, p))
        return q.join(p, keys)


def _in_parts(run, *columns: pd.Series):
    """``run`` over a few queries after another: their lists of cells grow with the table, so a whole
    Arrow batch of them must not be held with its temporaries."""
    starts = range(0, len(columns[0]), PART) or [0]
    return pd.concat([run(*(c.iloc[i:i + PART] for c in columns)) for i in starts], ignore_index=True)


def _rows(xs: pd.Series) -> np.ndarray:
    return np.vstack(xs.to_numpy()).astype(float) if len(xs) else np.zeros((0, 0))


def _descend(x, tops, pivots, ends, metric):
    """Cell, top and the distances to their pivots; and the distances to all tops."""
    if not len(x):
        none = np.zeros(0)
        return none.astype(int), none.astype(int), none, none, np.zeros((0, len(tops)))
    away_tops = np.concatenate([_rough(x[i:i + BLOCK], tops, metric, 1) for i in range(0, len(x), BLOCK)])
    top = away_tops.argmin(axis=1)
    cell, away = np.zeros(len(x), int), np.zeros(len(x))
    for t in np.unique(top):
        mine = np.flatnonzero(top == t)
        cell[mine] = _rough(x[mine], pivots[ends[t]:ends[t + 1]], metric, 1).argmin(axis=1) + ends[t]
        away[mine] = _paired(x[mine], pivots[cell[mine]], metric)
    return cell, top, away, _paired(x, tops[top], metric), away_tops


def _enough(far: np.ndarray, held: np.ndarray, k: int) -> np.ndarray:
    """Per row the smallest entry of ``far`` such that the cells up to it hold ``k`` points."""
    if held.sum() < k:
        return np.full(len(far), np.inf)
    order = np.argsort(far, axis=1)
    place = (np.cumsum(held[order], axis=1) >= k).argmax(axis=1)
    row = np.arange(len(far))
    return far[row, order[row, place]]


def _pack(df: DataFrame, key: str, carry: list[str], mine: str, other: str, group: int) -> DataFrame:
    """Rows of a cell in blocks of about as many rows as the cells ask for, spread by the hash of the key, one copy
    for each group of blocks on the other side."""
    block = F.pmod(F.xxhash64(key), F.col(f"{mine}_blocks"))
    fields = F.collect_list(F.struct(F.col(key).alias("key"), "x", *carry))
    packed = df.groupBy("cell", block.alias("_block")).agg(
        fields.alias("_rows"), F.first(f"{other}_groups").alias("_copies"))
    return packed.select(
        "cell", F.floor(F.col("_block") / group).alias(f"{mine}_group"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1)).alias(f"{other}_group"),
        F.col("_rows.key").alias(f"{mine}_key"), F.flatten(F.col("_rows.x")).alias(f"{mine}_x"),
        *[F.col(f"_rows.{c}").alias(f"{mine}_{c}") for c in carry])


def _blocks(batches: Iterator[pa.RecordBatch], width: int, carry: list[str]):
    for batch in batches:
        columns = {n: batch.column(n) for n in batch.schema.names}
        for i in range(batch.num_rows):
            value = lambda n: columns[n][i].values.to_numpy(zero_copy_only=False)  # noqa: B023, E731
            yield (value("q_key"), value("q_x").reshape(-1, width), value("q_bound"),
                   value("p_key"), value("p_x").reshape(-1, width), *[value(f"p_{c}") for c in carry])


def nearest(points: DataFrame, k: int, queries: DataFrame | None = None, key: str = "key",
            features: str = "features", metric: str = "euclidean", skip_self: bool = False) -> DataFrame:
    """The ``k`` nearest points of every query: ``(query, neighbour, distance, rank)``.

    ``features`` are number arrays and keys are whole numbers; ties go to the smaller key. Without
    ``queries`` the points query each other and a point is not its own neighbour; ``skip_self``
    asks for the same when the queries are some of the points.
    """
    itself = queries is None
    skip_self = skip_self or itself
    take = k + 1 if skip_self else k
    shape = unit if metric == "cosine" else (lambda x: x)
    straight = "euclidean" if metric == "cosine" else metric
    pts = points.select(F.col(key).cast("bigint").alias("key"), shape(F.col(features).cast("array<double>")).alias("x"))
    asks = pts if itself else queries.select(
        F.col(key).cast("bigint").alias("key"), shape(F.col(features).cast("array<double>")).alias("x"))
    copies = Window.partitionBy("x").orderBy("key")
    kept = materialise(pts.withColumn("_n", F.row_number().over(copies)).filter(F.col("_n") <= take).drop("_n"))
    sites = materialise(asks.groupBy("x").agg(F.min("key").alias("site"), F.count("*").alias("_n")))
    found = _candidates(kept, sites.select("site", "x"), take, straight)
    best = Window.partitionBy("site").orderBy("distance", "neighbour")
    by_site = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= take)
    if metric == "cosine":
        by_site = by_site.withColumn("distance", F.col("distance") * F.col("distance") / 2.0)
    shared = sites.filter("_n > 1")
    alone = sites.filter("_n = 1").select(F.col("site").alias("query"), "site")
    # only places with copies need the way back from the place to its rows
    many = asks.join(shared.select("x", "site"), "x").select(F.col("key").alias("query"), "site")
    out = alone.unionByName(many).join(by_site, "site").drop("site")
    if skip_self:
        mine = Window.partitionBy("query").orderBy("distance", "neighbour")
        out = out.filter("query <> neighbour").withColumn("rank", F.row_number().over(mine)).filter(F.col("rank") <= k)
    return out.select("query", "neighbour", "distance", "rank")


def _candidates(places: DataFrame, sites: DataFrame, take: int, metric: str) -> DataFrame:
    """``site, neighbour, distance``: the ``take`` best of the blocks that a query meets one after
    another, as far as they are within its bound."""
    cells = Cells(places, metric)
    pairs = cells.block_pairs(cells.visits(_bounded(cells, sites, take)), [])
    width = cells.width

    def kernel(batches):
        asked, held, limit = None, None, None
        for q_key, q, bound, p_key, p in _blocks(batches, width, []):
            if asked is None or not np.array_equal(asked, q_key):  # the join gives the points of a query block in a row
                if held is not None:
                    yield pa.RecordBatch.from_pydict({"site": asked[held[0]], "neighbour": held[1], "distance": held[2]})
                asked, held, limit = np.array(q_key), None, np.array(bound)
            m, parts = min(take, len(p_key)), [] if held is None else [held]
            for i in range(0, len(q_key), ROWS_AT_ONCE):
                row, col, d = _closest(q[i:i + ROWS_AT_ONCE], limit[i:i + ROWS_AT_ONCE], p, m, metric)
                parts.append((row + i, p_key[col], d))
            row, near, d = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((near, d, row))
            row, near, d = row[order], near[order], d[order]
            place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(q_key)))[row]
            keep = place < take
            held = row[keep], near[keep], d[keep]
            last = place == take - 1
            limit[row[last]] = np.minimum(limit[row[last]], d[last])
        if held is not None:
            yield pa.RecordBatch.from_pydict({"site": asked[held[0]], "neighbour": held[1], "distance": held[2]})

    return pairs.mapInArrow(kernel, "site bigint, neighbour bigint, distance double")


def _bounded(cells: Cells, sites: DataFrame, k: int) -> DataFrame:
    """``site, x, bound``: a distance within which every query has ``k`` points, from a comparison with
    its own cell: the k-th best of any block that has as many."""
    home = materialise(sites.withColumn("_home", cells._bounds(k)("x")).select(
        "site", "x", F.col("_home.cell").alias("cell"), F.col("_home.bound").alias("bound")))
    width, metric = cells.width, cells.metric

    def kernel(batches):
        for q_key, q, bound, p_key, p in _blocks(batches, width, []):
            if len(p_key) >= k:
                kth = np.concatenate([np.partition(_rough(q[i:i + ROWS_AT_ONCE], p, metric, 1), k - 1, axis=1)[:, k - 1]
                                      for i in range(0, len(q_key), ROWS_AT_ONCE)])
                yield pa.RecordBatch.from_pydict({"site": q_key, "kth": np.minimum(kth, bound)})

    found = cells.block_pairs(home, []).mapInArrow(kernel, "site bigint, kth double")
    best = found.groupBy("site").agg(F.min("kth").alias("kth"))
    return materialise(home.join(best, "site", "left").select("site", "x", F.least("bound", F.coalesce("kth", "bound")).alias("bound")))


def within(points: DataFrame, queries: DataFrame, radius: float, measure: str, column: str,
           metric: str = "euclidean") -> DataFrame:
    """``(site, value)``: sum or min of ``column`` over the points within ``radius`` of a query.

    Both sides hold distinct places: points ``(key, x, column)`` and queries ``(site, x)``.
    """
    cells = Cells(points, metric)
    pairs = cells.block_pairs(cells.visits(queries.withColumn("bound", F.lit(float(radius)))), [column])
    width = cells.width

    def kernel(batches):
        for q_key, q, _, _, p, value in _blocks(batches, width, [column]):
            near = distances(q, p, metric) <= radius
            hit = near.any(axis=1)
            if measure == "sum":
                out = near @ value
            else:
                out = np.where(near, value[None, :], np.iinfo(np.int64).max).min(axis=1)
            yield pa.RecordBatch.from_pydict(
                {"site": q_key[hit], "value": out[hit].astype(np.int64)})

    parts = pairs.mapInArrow(kernel, "site bigint, value bigint")
    merge = F.sum("value") if measure == "sum" else F.min("value")
    return parts.groupBy("site").agg(merge.alias("value"))


def links_within(points: DataFrame, radius: float, metric: str = "euclidean") -> DataFrame:
    """Edges ``(a, b)`` that connect the same points as all pairs within ``radius`` would.

    Each pair of blocks reports its connected groups only, so the edges of a dense region grow
    with its points and not with its pairs.
    """
    cells = Cells(points, metric)
    queries = points.select(F.col("key").alias("site"), "x")
    pairs = cells.block_pairs(cells.visits(queries.withColumn("bound", F.lit(float(radius)))), [])
    width = cells.width

    def kernel(batches):
        for q_key, q, _, p_key, p in _blocks(batches, width, []):
            near = distances(q, p, metric) <= radius
            big = np.iinfo(np.int64).max
            q_label, p_label = q_key.astype(np.int64), p_key.astype(np.int64)
            while True:
                p_new = np.minimum(p_label, np.where(near, q_label[:, None], big).min(axis=0))
                q_new = np.minimum(q_label, np.where(near, p_new[None, :], big).min(axis=1))
                if (p_new == p_label).all() and (q_new == q_label).all():
                    break
                p_label, q_label = p_new, q_new
            a = np.concatenate([q_key, p_key]).astype(np.int64)
            b = np.concatenate([q_label, p_label])
            moved = a != b
            yield pa.RecordBatch.from_pydict({"a": a[moved], "b": b[moved]})

    return pairs.mapInArrow(kernel, "a bigint, b bigint").distinct()
