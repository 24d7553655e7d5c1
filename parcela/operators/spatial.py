"""Points near other points or inside regions: a dual-tree join (problem 7).

The reference side (points with a reach, polygons) is one tree. Each task builds a tree over its
own points and descends both at once: pairs of nodes that can't meet are discarded, pairs that
meet for certain are accepted whole, and only uncertain leaves are compared point by point.

Distances are great circles on a sphere. Nodes are boxes of unit vectors in space, whose straight
distances bound the chords, so that the bounds hold everywhere, at the poles and the date line too.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcela.storage import TooLarge, bounded_rows, materialize

EARTH_M = 6_371_008.8
#: Most reference rows that every task gets whole; of more, each task gets its part (``near_points``).
BROADCAST_ROWS = 200_000
#: Most vertices (of 16 characters) of the polygons that every task gets whole.
BROADCAST_VERTICES = 2_000_000
LEAF = 48
#: Chords are compared with this slack before they count as certain; in between, points are compared exactly.
_SLACK = 1e-12


def position(latitude: Column, longitude: Column, south: float = -55.0, north: float = -17.0, west: float = -109.0, east: float = -66.0) -> tuple[Column, Column]:
    """Both coordinates as doubles, or both null unless each reads as a decimal number, with point or
    comma, and lies in the given bounds as written. Outer blanks don't matter; nothing is repaired."""
    number = r"^[\s ]*[+-]?\d+([.,]\d*)?[\s ]*$"
    read = lambda c: F.when(c.rlike(number), F.regexp_replace(F.regexp_replace(c, r"[\s ]", ""), ",", ".").try_cast("double"))
    y, x = read(latitude), read(longitude)
    valid = y.between(south, north) & x.between(west, east)
    return F.when(valid, y), F.when(valid, x)


def unit_vectors(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], axis=1)


def great_circle(lat1, lon1, lat2, lon2):
    """Metres between positions in degrees (haversine)."""
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.minimum(1.0, np.sqrt(h)))


@dataclass
class Tree:
    """A balanced tree of boxes over rows of vectors; node k covers ``order[start[k]:stop[k]]``."""

    order: np.ndarray
    start: list[int]
    stop: list[int]
    low: list[np.ndarray]
    high: list[np.ndarray]
    child: list[tuple[int, int] | None]

    @staticmethod
    def build(low: np.ndarray, high: np.ndarray, leaf: int = LEAF) -> Tree:
        """Over boxes ``low``..``high`` (points: both the same), cut at the median of the widest side."""
        t = Tree(np.arange(len(low)), [], [], [], [], [])
        todo = [(0, len(low), None)] if len(low) else []
        while todo:
            a, b, parent = todo.pop()
            own = t.order[a:b]
            lo, hi = low[own].min(axis=0), high[own].max(axis=0)
            k = len(t.start)
            t.start.append(a)
            t.stop.append(b)
            t.low.append(lo)
            t.high.append(hi)
            t.child.append(None)
            if parent is not None:
                up, side = parent
                kids = list(t.child[up] or (0, 0))
                kids[side] = k
                t.child[up] = (kids[0], kids[1])
            if b - a > leaf and np.any(hi > lo):
                axis = int(np.argmax(hi - lo))
                middle = (low[own, axis] + high[own, axis]) / 2
                half = (b - a) // 2
                t.order[a:b] = own[np.argpartition(middle, half)]
                todo.append((a, a + half, (k, 0)))
                todo.append((a + half, b, (k, 1)))
        return t


class NearPoints:
    """Reference points with a reach in metres each, as one tree."""

    def __init__(self, ids, lat, lon, reach):
        self.ids, self.lat, self.lon, self.reach = np.asarray(ids), np.asarray(lat, float), np.asarray(lon, float), np.asarray(reach, float)
        v = unit_vectors(self.lat, self.lon)
        self.tree = Tree.build(v, v)
        chord = 2 * np.sin(np.minimum(self.reach / (2 * EARTH_M), np.pi / 2))
        t = self.tree
        self.most = [chord[t.order[a:b]].max() for a, b in zip(t.start, t.stop)]
        self.least = [chord[t.order[a:b]].min() for a, b in zip(t.start, t.stop)]

    def join(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index of position, index of reference) within reach."""
        if not len(lat) or not len(self.ids):
            return np.empty(0, int), np.empty(0, int)
        v = unit_vectors(lat, lon)
        q, r = Tree.build(v, v), self.tree
        left, right, todo = [], [], [(0, 0)]
        while todo:
            a, b = todo.pop()
            gap = np.maximum(0.0, np.maximum(q.low[a] - r.high[b], r.low[b] - q.high[a]))
            if math.sqrt(float(gap @ gap)) > self.most[b] + _SLACK:
                continue  # no pair of these can be near
            far = np.maximum(q.high[a] - r.low[b], r.high[b] - q.low[a])
            i, j = q.order[q.start[a] : q.stop[a]], r.order[r.start[b] : r.stop[b]]
            if math.sqrt(float(far @ far)) < self.least[b] - 1e-9:
                left.append(np.repeat(i, len(j)))  # every pair is near
                right.append(np.tile(j, len(i)))
            elif q.child[a] is None and r.child[b] is None:
                near = great_circle(lat[i][:, None], lon[i][:, None], self.lat[j][None, :], self.lon[j][None, :]) <= self.reach[j][None, :]
                x, y = np.nonzero(near)
                left.append(i[x])
                right.append(j[y])
            elif r.child[b] is None or q.child[a] is not None and len(i) >= len(j):
                todo.extend((c, b) for c in q.child[a])
            else:
                todo.extend((a, c) for c in r.child[b])
        return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int), np.empty(0, int))


_RING = re.compile(r"\(([^()]+)\)")


def rings(wkt: str) -> list[np.ndarray]:
    """The rings of a POLYGON or MULTIPOLYGON in WKT as arrays of (longitude, latitude), closed."""
    out = []
    for m in _RING.finditer(wkt):
        ring = np.array([[float(x) for x in p.split()[:2]] for p in m.group(1).split(",")])
        out.append(ring if np.array_equal(ring[0], ring[-1]) else np.vstack([ring, ring[:1]]))
    return out


class Regions:
    """Polygons with straight borders in degrees, as one tree of boxes."""

    def __init__(self, ids, wkts):
        self.ids = np.asarray(ids)
        polygons = [rings(w) for w in wkts]
        self.edges = [np.concatenate([np.hstack([r[:-1], r[1:]]) for r in p]) if p else np.empty((0, 4)) for p in polygons]
        low = np.array([e.reshape(-1, 2).min(axis=0) if len(e) else [np.inf, np.inf] for e in self.edges]).reshape(-1, 2)
        high = np.array([e.reshape(-1, 2).max(axis=0) if len(e) else [-np.inf, -np.inf] for e in self.edges]).reshape(-1, 2)
        self.tree = Tree.build(low, high, leaf=1)

    def inside(self, k: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Even-odd rule; half-open edges, so that a point on a shared border lies in one region."""
        e = self.edges[k]
        x1, y1, x2, y2 = e[:, 0][:, None], e[:, 1][:, None], e[:, 2][:, None], e[:, 3][:, None]
        spans = (y1 > y) != (y2 > y)
        with np.errstate(divide="ignore", invalid="ignore"):
            cross = x < (x2 - x1) * (y - y1) / (y2 - y1) + x1
        return (spans & cross).sum(axis=0) % 2 == 1

    def _touches(self, k: int, low: np.ndarray, high: np.ndarray) -> bool:
        """Whether a border of region k may run through the box: an edge whose box meets it and whose line isn't all on one side."""
        e = self.edges[k]
        meets = (np.minimum(e[:, 0], e[:, 2]) <= high[0]) & (np.maximum(e[:, 0], e[:, 2]) >= low[0]) & (np.minimum(e[:, 1], e[:, 3]) <= high[1]) & (np.maximum(e[:, 1], e[:, 3]) >= low[1])
        e = e[meets]
        if not len(e):
            return False
        dx, dy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]
        side = np.stack([dx * (y - e[:, 1]) - dy * (x - e[:, 0]) for x in (low[0], high[0]) for y in (low[1], high[1])])
        return bool(np.any(~((side > 0).all(axis=0) | (side < 0).all(axis=0))))

    def join(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index of position, index of the region that contains it)."""
        if not len(lat) or not len(self.ids):
            return np.empty(0, int), np.empty(0, int)
        v = np.stack([lon, lat], axis=1)
        q, r = Tree.build(v, v), self.tree
        left, right, todo = [], [], [(0, 0)]
        while todo:
            a, b = todo.pop()
            if np.any(q.low[a] > r.high[b]) or np.any(q.high[a] < r.low[b]):
                continue
            i = q.order[q.start[a] : q.stop[a]]
            if r.child[b] is not None:
                if q.child[a] is not None and len(i) > 16 * LEAF:
                    todo.extend((c, b) for c in q.child[a])
                else:
                    todo.extend((a, c) for c in r.child[b])
                continue
            k = int(r.order[r.start[b]])
            if not self._touches(k, q.low[a], q.high[a]):
                within = bool(self.inside(k, q.low[a][:1], q.low[a][1:])[0])
                taken = i if within else i[:0]  # the whole box lies on one side of every border
            elif q.child[a] is not None:
                todo.extend((c, b) for c in q.child[a])
                continue
            else:
                taken = i[self.inside(k, lon[i], lat[i])]
            left.append(taken)
            right.append(np.full(len(taken), k))
        return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int), np.empty(0, int))


def _join_udf(sides: list[tuple[str, object]], id_column: str):
    """Positions of a batch against every reference tree; equal positions are compared once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            ids, at = batch[id_column].to_numpy(), batch[["lat", "lon"]].to_numpy(float)
            distinct, code = np.unique(at, axis=0, return_inverse=True)
            code = code.reshape(-1)
            by_code = np.argsort(code, kind="stable")
            first = np.searchsorted(code[by_code], np.arange(len(distinct) + 1))
            for kind, side in sides:
                q, r = side.join(distinct[:, 0], distinct[:, 1])
                count = first[q + 1] - first[q]
                start = np.repeat(first[q], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                yield pd.DataFrame({id_column: ids[by_code[start]], "clase": pd.Series([kind] * len(start), dtype=object), "ref_id": np.asarray(side.ids)[np.repeat(r, count)].astype(np.int64)})

    return run


def located(listings: DataFrame, id_column: str = "row_id") -> DataFrame:
    """id, ``lat``, ``lon`` of the rows whose position counts."""
    y, x = position(F.col("latitud"), F.col("longitud"))
    return listings.select(id_column, y.alias("lat"), x.alias("lon")).filter("lat is not null and lon is not null")


def tree_join(points: DataFrame, sides: list[tuple[str, object]], id_column: str = "row_id") -> DataFrame:
    """id, ``clase``, ``ref_id`` of the points against reference trees that every task gets whole: no shuffle."""
    kind = dict(points.dtypes)[id_column]
    return points.mapInPandas(_join_udf(sides, id_column), f"{id_column} {kind}, clase string, ref_id long")


# --- reference trees of any size -----------------------------------------------------------------
#
# Beyond one task's memory the top of both trees is cut off: positions are dealt to the leaves of a
# tree over their own counts, and each reference descends it to the leaves that it may meet. A task
# then goes on with the descent between one leaf's positions and its references. Leaves with many of
# either are cut into shares, each pair of shares one task, so that neither a crowded place nor a
# place that all references reach is one task's load.

#: Levels of the tree over positions: cells of 180/2^k by 360/2^k degrees.
_FIRST, _STEP, _LAST = 9, 4, 21


def _spread_bits(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << shift)) & mask
    return x


def _gather_bits(x: np.ndarray) -> np.ndarray:
    x = x & 0x5555555555555555
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = (x | (x >> shift)) & mask
    return x


def cell_code(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """The cell of each position at the last level, in Z-order: a cell of a coarser level is a range of them."""
    n = 1 << _LAST
    y = np.clip(np.floor((np.asarray(lat, float) + 90) / 180 * n), 0, n - 1).astype(np.int64)
    x = np.clip(np.floor((np.asarray(lon, float) + 180) / 360 * n), 0, n - 1).astype(np.int64)
    return (_spread_bits(y) << 1) | _spread_bits(x)


@dataclass
class Leaves:
    """The leaves of the tree over all positions: first code, level and number of positions of each."""

    start: np.ndarray
    level: np.ndarray
    count: np.ndarray

    @staticmethod
    def of(points: DataFrame, target: int) -> Leaves:
        """Cells are counted level by level; only those with more than ``target`` positions are cut
        further, so that at most 256 rows for each ``target`` positions come to the driver."""
        code = _code_udf()(F.col("lat"), F.col("lon"))
        start, level, count = [], [], []
        k, hot = _FIRST, None
        while True:
            shift = 2 * (_LAST - k)
            counted = points.select(code.alias("c"))
            if hot is not None:
                above = F.broadcast(points.sparkSession.createDataFrame([(int(h),) for h in hot], "h long"))
                counted = counted.join(above, F.shiftright("c", shift + 2 * _STEP) == F.col("h"), "left_semi")
            found = counted.groupBy(F.shiftright("c", shift).alias("c")).count().collect()
            deeper = [r.c for r in found if r["count"] > target] if k + _STEP <= _LAST else []
            cut = set(deeper)
            for r in found:
                if r.c not in cut:
                    start.append(r.c << shift)
                    level.append(k)
                    count.append(r["count"])
            if not deeper:
                break
            k, hot = k + _STEP, deeper
        order = np.argsort(np.array(start, dtype=np.int64), kind="stable")
        return Leaves(*[np.array(v, dtype=np.int64)[order] for v in (start, level, count)])

    def find(self, code: np.ndarray) -> np.ndarray:
        """The leaf of each code that a position has."""
        return np.searchsorted(self.start, code, "right") - 1

    def boxes(self) -> tuple[np.ndarray, np.ndarray]:
        """South-west and north-east corner (latitude, longitude) of each leaf."""
        side = 360.0 / (1 << self.level).astype(float)
        n = float(1 << _LAST)
        south, west = _gather_bits(self.start >> 1) / n * 180 - 90, _gather_bits(self.start) / n * 360 - 180
        return np.stack([south, west], axis=1), np.stack([south + side / 2, west + side], axis=1)


def _code_udf():
    @F.pandas_udf("long")
    def code(lat: pd.Series, lon: pd.Series) -> pd.Series:
        return pd.Series(cell_code(lat.to_numpy(), lon.to_numpy()))

    return code


class LeafBalls:
    """The leaves as balls in space (centre and chord to the farthest corner), as one tree."""

    def __init__(self, leaves: Leaves):
        low, high = leaves.boxes()
        middle = (low + high) / 2
        centre = unit_vectors(middle[:, 0], middle[:, 1])
        corners = [unit_vectors(y, x) for y in (low[:, 0], high[:, 0]) for x in (low[:, 1], high[:, 1])]
        # along a cell's side the distance to its centre is largest at an end
        self.radius = np.max([np.linalg.norm(c - centre, axis=1) for c in corners], axis=0) * (1 + 1e-9) + _SLACK
        self.centre = centre
        self.tree = Tree.build(centre - self.radius[:, None], centre + self.radius[:, None])

    def near(self, lat: np.ndarray, lon: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (leaf, reference) that may hold a position within reach; both trees descend together."""
        v = unit_vectors(lat, lon)
        chord = 2 * np.sin(np.minimum(reach / (2 * EARTH_M), np.pi / 2)) + 1e-9
        r, q = Tree.build(v - chord[:, None], v + chord[:, None]), self.tree
        left, right, todo = [], [], [(0, 0)] if len(lat) and len(self.centre) else []
        while todo:
            a, b = todo.pop()
            if np.any(q.low[a] > r.high[b]) or np.any(r.low[b] > q.high[a]):
                continue
            i, j = q.order[q.start[a] : q.stop[a]], r.order[r.start[b] : r.stop[b]]
            if q.child[a] is None and r.child[b] is None:
                gap = np.linalg.norm(self.centre[i][:, None, :] - v[j][None, :, :], axis=2)
                x, y = np.nonzero(gap <= self.radius[i][:, None] + chord[j][None, :])
                left.append(i[x])
                right.append(j[y])
            elif r.child[b] is None or q.child[a] is not None and len(i) >= len(j):
                todo.extend((c, b) for c in q.child[a])
            else:
                todo.extend((a, c) for c in r.child[b])
        return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int), np.empty(0, int))


def _shared(points: DataFrame, refs: DataFrame, leaves: Leaves, id_column: str, kind: str, carried: list[str], make, target: int, most: int) -> DataFrame:
    """``points`` against ``refs``, which name the ``leaf`` they may meet: id, ``clase``, ``ref_id``.

    ``make`` builds a reference side from the columns ``carried``. A leaf is cut into shares of about
    ``target`` positions and ``most`` references; points of a share are repeated for the leaf's shares of
    references and the other way round.
    """
    many = np.zeros(len(leaves.start), dtype=np.int64)
    for r in refs.groupBy("leaf").count().collect():  # one row a leaf
        many[r.leaf] = r["count"]
    own, other = -(-leaves.count // target), -(-many // most)

    def deal(mine: np.ndarray, theirs: np.ndarray):
        """For each row of a side: its leaf's unit of (own share, other side's share), for all shares of the other side."""

        def run(leaf: pd.Series, salt: pd.Series) -> pd.Series:
            k = leaf.to_numpy()
            share = salt.to_numpy() % np.maximum(mine[k], 1)
            return pd.Series([np.arange(n, dtype=np.int64) + s * n for s, n in zip(share, theirs[k])], dtype=object)

        return run

    leaf_of = F.pandas_udf(lambda lat, lon: pd.Series(leaves.find(cell_code(lat.to_numpy(), lon.to_numpy()))), "long")
    # units are (own share of points) x (share of references) + share of references
    by_point = F.pandas_udf(deal(own, other), "array<long>")

    @F.pandas_udf("array<long>")
    def by_ref(leaf: pd.Series, salt: pd.Series) -> pd.Series:
        k = leaf.to_numpy()
        share = salt.to_numpy() % np.maximum(other[k], 1)
        return pd.Series([np.arange(n, dtype=np.int64) * m + s for s, n, m in zip(share, own[k], other[k])], dtype=object)

    salt = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1 << 30))
    dealt = points.select(id_column, "lat", "lon", leaf_of("lat", "lon").alias("leaf")).select(id_column, "lat", "lon", "leaf", F.explode(by_point("leaf", salt(id_column, "lat"))).alias("unit"))
    spread = refs.select("leaf", *carried, F.explode(by_ref("leaf", salt(F.monotonically_increasing_id()))).alias("unit"))

    def run(key, mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({id_column: mine[id_column][:0], "clase": pd.Series([], dtype=object), "ref_id": np.empty(0, dtype=np.int64)})
        side = make(theirs)
        return pd.concat(_join_udf([(kind, side)], id_column)(iter([mine])), ignore_index=True)

    schema = f"{id_column} {dict(points.dtypes)[id_column]}, clase string, ref_id long"
    return dealt.groupBy("leaf", "unit").cogroup(spread.groupBy("leaf", "unit")).applyInPandas(run, schema)


def near_points(points: DataFrame, refs: DataFrame, id_column: str = "row_id", target: int = 200_000, most: int = 100_000, leaves: Leaves | None = None) -> DataFrame:
    """``points`` (id, lat, lon) within ``reach`` metres of ``refs`` (ref_id, lat, lon, reach): id, 'punto', ref_id.

    For references of any number and reach, everywhere on the sphere: a reference goes only to the
    leaves within its own reach.
    """
    leaves = leaves or Leaves.of(points, target)

    def descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        balls = LeafBalls(leaves)
        for b in batches:
            if len(b):
                at = b[["lat", "lon", "reach"]].to_numpy(float)
                leaf, ref = balls.near(at[:, 0], at[:, 1], at[:, 2])
                yield b.iloc[ref].assign(leaf=leaf)

    met = materialize(refs.select("ref_id", "lat", "lon", "reach").mapInPandas(descend, "ref_id long, lat double, lon double, reach double, leaf long"), "met")
    make = lambda t: NearPoints(t["ref_id"].to_numpy(), t["rlat"].to_numpy(), t["rlon"].to_numpy(), t["reach"].to_numpy())
    refs = met.withColumnsRenamed({"lat": "rlat", "lon": "rlon"})
    return _shared(points, refs, leaves, id_column, "punto", ["ref_id", "rlat", "rlon", "reach"], make, target, most)


def containing_regions(points: DataFrame, regions: DataFrame, id_column: str = "row_id", target: int = 200_000, most: int = 2_000, leaves: Leaves | None = None) -> DataFrame:
    """``points`` (id, lat, lon) inside of ``regions`` (ref_id, wkt): id, 'comuna', ref_id.

    For polygons of any number: each goes to the leaves that its border may run through, and as a
    mark without its border to those that lie in it.
    """
    leaves = leaves or Leaves.of(points, target)

    def descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        low, high = leaves.boxes()
        tree = Tree.build(low[:, ::-1].copy(), high[:, ::-1].copy())  # (longitude, latitude)
        for b in batches:
            for ref, wkt in zip(b["ref_id"], b["wkt"]):
                shape, out, todo = Regions([ref], [wkt]), [], [0] if len(low) else []
                if not len(shape.edges[0]):
                    continue
                while todo:
                    a = todo.pop()
                    if np.any(tree.low[a] > shape.tree.high[0]) or np.any(tree.high[a] < shape.tree.low[0]):
                        continue
                    i = tree.order[tree.start[a] : tree.stop[a]]
                    if not shape._touches(0, tree.low[a], tree.high[a]):
                        if shape.inside(0, tree.low[a][:1], tree.low[a][1:])[0]:
                            out += [(ref, None, k) for k in i.tolist()]  # all of these lie in it
                    elif tree.child[a] is not None:
                        todo.extend(tree.child[a])
                    else:
                        out += [(ref, wkt, k) for k in i.tolist()]
                ids, borders, found = zip(*out) if out else ((), (), ())
                yield pd.DataFrame({"ref_id": np.array(ids, dtype=np.int64), "wkt": pd.Series(borders, dtype=object), "leaf": np.array(found, dtype=np.int64)})

    met = materialize(regions.select("ref_id", "wkt").mapInPandas(descend, "ref_id long, wkt string, leaf long"), "met")
    return _shared(points, met, leaves, id_column, "comuna", ["ref_id", "wkt"], lambda t: RegionsOrWhole(t["ref_id"].to_numpy(), list(t["wkt"])), target, most)


class RegionsOrWhole:
    """Regions of one leaf; those without a border hold every position of it."""

    def __init__(self, ids, wkts):
        self.whole = np.array([i for i, w in zip(ids, wkts) if w is None], dtype=np.int64)
        rest = [(i, w) for i, w in zip(ids, wkts) if w is not None]
        self.regions = Regions([i for i, _ in rest], [w for _, w in rest])
        self.ids = np.concatenate([np.asarray(self.regions.ids, dtype=np.int64), self.whole])

    def join(self, lat: np.ndarray, lon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q, r = self.regions.join(lat, lon)
        n, m = len(lat), len(self.whole)
        return np.concatenate([q, np.tile(np.arange(n), m)]), np.concatenate([r, len(self.regions.ids) + np.repeat(np.arange(m), n)])


def places(listings: DataFrame, regions: DataFrame, interest: DataFrame) -> DataFrame:
    """``row_id``, ``clase``, ``ref_id``: the comuna that contains the position of each row ('comuna')
    and each point of interest at most its ``radio_m`` away ('punto').

    Rows without a valid position, polygons that are null and points without position or reach
    give nothing. Repeated references give a row each. A reference tree within one task's memory
    (``BROADCAST_ROWS``, ``BROADCAST_VERTICES``) goes to every task whole, so that no position is
    shuffled; of a larger one each task gets the part that its positions may meet.
    """
    points = located(listings)
    shapes = regions.select(F.col("comuna_id").cast("long").alias("ref_id"), F.col("poligono").alias("wkt")).dropna()
    refs = interest.select(F.col("poi_id").cast("long").alias("ref_id"), F.col("latitud").cast("double").alias("lat"), F.col("longitud").cast("double").alias("lon"), F.col("radio_m").cast("double").alias("reach")).dropna()
    sides: list[tuple[str, object]] = []
    apart: list[DataFrame] = []
    leaves: Leaves | None = None
    size = shapes.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("wkt")), F.lit(0)).alias("b")).first()
    if size.n <= BROADCAST_ROWS and size.b <= BROADCAST_VERTICES * 16:
        rows = bounded_rows(shapes, BROADCAST_ROWS, "polygons")
        sides.append(("comuna", Regions([r.ref_id for r in rows], [r.wkt for r in rows])))
    else:
        leaves = Leaves.of(points, 200_000)
        apart.append(containing_regions(points, shapes, leaves=leaves))
    try:
        rows = bounded_rows(refs, BROADCAST_ROWS, "points")
        sides.append(("punto", NearPoints(*[np.array([r[k] for r in rows]) for k in range(4)])))
    except TooLarge:
        leaves = leaves or Leaves.of(points, 200_000)
        apart.append(near_points(points, refs, leaves=leaves))
    return reduce(DataFrame.unionByName, [*([tree_join(points, sides)] if sides else []), *apart])
