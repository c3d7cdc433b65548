"""Exact inner-product search: ball trees with branch and bound, one a shard."""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

LEAF = 48
LEAST_ROWS, SAMPLE = 2048, 8192
LONG = (-(1 << 63), (1 << 63) - 1)


def whole(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x): as doubles where inner products stay exact in them, else as Python integers."""
    with np.errstate(over="ignore"):
        x = np.floor(vectors * scale)
        most = float(np.abs(x).max(initial=0.0))
        if most * most * max(1, x.shape[1]) < 2.0**52:
            return x
    # beyond 2 ** 60 a double is an integer, and its product may be no double
    exact = lambda v: math.floor(v * scale) if abs(v) < 2.0**60 else math.floor(Fraction(v) * Fraction(scale))
    return np.array([[exact(float(v)) for v in row] for row in vectors], object).reshape(x.shape)


def as_float(x: np.ndarray) -> np.ndarray:
    """Doubles; integers that are too large for one become infinite."""
    if x.dtype != object:
        return x.astype(float)
    flat = [float(v) if -(1 << 1023) < v < 1 << 1023 else math.inf if v > 0 else -math.inf for v in x.ravel()]
    return np.array(flat, float).reshape(x.shape)


def ball_bounds(centres: np.ndarray, radii: np.ndarray, q: np.ndarray) -> np.ndarray:
    """No row in a ball scores above this with the query: q.c + |q| r, plus what rounding may take; infinite if it overflows."""
    with np.errstate(all="ignore"):
        f = as_float(q)
        length = np.sqrt((f * f).sum(1))[:, None]
        reach = np.sqrt((centres**2).sum(1)) + radii
        out = f @ centres.T + length * radii + 1e-9 * length * reach + 1e-6
    return np.where(np.isfinite(out), out, np.inf)


class BallTree:
    """Balls over the rows of x, halved along the direction to the farthest row; leaves hold LEAF rows, or equal ones."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        with np.errstate(all="ignore"):
            self._build(x, ids, rows)

    def _build(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.arange(len(x))
        f = as_float(x)
        self.lo, self.hi, self.kids, centres, radii = [], [], [], [], []
        todo = [(0, len(x), -1)]
        while todo:
            lo, hi, parent = todo.pop()
            me = len(self.lo)
            if parent >= 0:
                self.kids[parent].append(me)
            part = f[order[lo:hi]]
            c = part.mean(0)
            d = np.sqrt(((part - c) ** 2).sum(1))
            self.lo.append(lo)
            self.hi.append(hi)
            self.kids.append([])
            centres.append(c)
            radii.append(float(d.max()))
            if hi - lo <= LEAF or radii[me] == 0.0:
                continue
            a = part[int(d.argmax())]
            b = part[int(((part - a) ** 2).sum(1).argmax())]
            along = part @ (a - b)
            mid = (hi - lo) // 2
            side = np.argpartition(along, mid)
            order[lo:hi] = order[lo:hi][side]
            todo += [(lo + mid, hi, me), (lo, lo + mid, me)]
        self.x, self.ids, self.rows = x[order], ids[order], rows[order]
        self.f = self.x
        self.centres, self.radii = np.array(centres), np.array(radii)
        self.least_id = [int(self.ids[a:b].min()) for a, b in zip(self.lo, self.hi)]

    def bounds(self, q: np.ndarray) -> np.ndarray:
        return ball_bounds(self.centres, self.radii, q)

    def search(self, q: np.ndarray, bound: np.ndarray, own_row: int, k: int, floor: tuple[int, int] | None) -> list[tuple[int, int]]:
        """The k best (score, id) by score, then smaller id; only those that may beat ``floor``, a kth result found elsewhere."""
        if q.dtype == object and self.f.dtype != object:
            self.f = np.array([[int(v) for v in row] for row in self.x], object).reshape(self.x.shape)
        if self.f.dtype == object and q.dtype != object:
            q = np.array([int(v) for v in q], object)
        best: list[tuple[int, int]] = []  # heap of (score, -id): the worst on top
        stop = None if floor is None else (floor[0], -floor[1])
        heap = [(-bound[0], 0)]
        while heap:
            top, n = heapq.heappop(heap)
            if stop is not None:
                most = min(int(np.floor(-top)), LONG[1]) if np.isfinite(top) else LONG[1]
                if most < stop[0]:
                    break
                if most == stop[0] and -self.least_id[n] < stop[1]:
                    continue
            if self.kids[n]:
                for c in self.kids[n]:
                    heapq.heappush(heap, (-bound[c], c))
                continue
            lo, hi = self.lo[n], self.hi[n]
            s = self.f[lo:hi] @ q if len(q) else np.zeros(hi - lo)
            if s.dtype == object:
                s = np.array([min(max(int(v), LONG[0]), LONG[1]) for v in s], np.int64)
            near = np.arange(hi - lo) if stop is None else np.flatnonzero(s >= stop[0])
            if len(near) > k:  # of many equal rows, only the least ids matter
                ids = self.ids[lo:hi][near]
                near = near[np.lexsort((ids, ~s[near] if s.dtype == np.int64 else -s[near]))][: k + 1]  # -s of the least long is itself
            for i in near:
                if self.rows[lo + i] == own_row:
                    continue
                item = (int(s[i]), -int(self.ids[lo + i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
                if len(best) == k and (stop is None or best[0] > stop):
                    stop = best[0]
        return [(s, -i) for s, i in sorted(best, reverse=True)]


class Router:
    """Halves space at medians along the direction to the farthest row of a sample, until there are enough leaves."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.dim, self.cuts, self.kids = sample.shape[1], [], []
        todo, made = [(np.arange(len(sample)), -1, 0)], 1
        while todo:
            rows, parent, side = todo.pop(0)  # largest first, as all are halves
            me = len(self.cuts)
            if parent >= 0:
                self.kids[parent][side] = me
            cut = None
            if made < leaves and len(rows) > 1:
                part = sample[rows]
                a = part[int(((part - part.mean(0)) ** 2).sum(1).argmax())]
                b = part[int(((part - a) ** 2).sum(1).argmax())]
                along = part @ (a - b)
                at = float(np.median(along))
                if np.isfinite(at) and (along > at).any():
                    cut = (a - b, at)
                    made += 1
                    todo += [(rows[along <= at], me, 0), (rows[along > at], me, 1)]
            self.cuts.append(cut)
            self.kids.append([-1, -1])

    def place(self, x: np.ndarray) -> np.ndarray:
        """A leaf (number of its node) for each row."""
        out = np.zeros(len(x), np.int64)
        with np.errstate(all="ignore"):
            for me, cut in enumerate(self.cuts):  # a node comes after its parent
                if cut is not None:
                    at = np.flatnonzero(out == me)
                    out[at] = np.where(x[at] @ cut[0] > cut[1], self.kids[me][1], self.kids[me][0])
        return out


def _placed(batches: Iterator[pa.RecordBatch], router: Router | None) -> Iterator[pa.RecordBatch]:
    """Adds the leaf; 0 for vectors of another length than the sample's."""
    for b in batches:
        leaf = np.zeros(b.num_rows, np.int64)
        if router is not None:
            v = b.column(b.schema.get_field_index("v")).to_pylist()
            own = np.array([len(x) == router.dim for x in v], bool)
            if own.any():
                leaf[own] = router.place(np.array([x for x, ok in zip(v, own) if ok], float).reshape(-1, router.dim))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf.astype(np.int32))], names=[*b.schema.names, "leaf"])


def _wanted(batches: Iterator[pa.RecordBatch], balls: dict, scale: float) -> Iterator[pa.RecordBatch]:
    """A row for each query and other shard whose ball may hold something better than the query's floor."""
    for b in batches:
        got = {n: b.column(k).to_pylist() for k, n in enumerate(b.schema.names)}
        rows, shards = [], []
        for dim in {len(v) for v in got["v"]}:
            if dim not in balls:
                continue
            names, centres, radii, least = balls[dim]
            at = [i for i, v in enumerate(got["v"]) if len(v) == dim]
            bound = ball_bounds(centres, radii, whole(np.array([got["v"][i] for i in at], float).reshape(len(at), dim), scale))
            for i, most in zip(at, bound):
                ok = names != got["shard"][i]
                if got["floor_score"][i] is not None:
                    floor, most = got["floor_score"][i], np.floor(most)
                    ok &= (most > floor) | ((most == floor) & (least < got["floor_id"][i]))
                shards += names[ok].tolist()
                rows += [i] * int(ok.sum())
        out = b.take(pa.array(rows, pa.int64()))
        yield out.set_column(out.schema.get_field_index("shard"), "shard", pa.array(shards, pa.int32()))


def _scan(batches: Iterator[pa.RecordBatch], k: int, scale: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (shard, role): a shard's vectors, then the queries that search it, which stream by. Gives the best
    of each query, and of each shard and length of vectors the ball around them (row: the shard)."""
    shard, store, trees = None, {}, None
    names = ["row", "query_id", "vec_id", "score", "centre", "radius"]

    def grow():
        out = {}
        for dim, rows in store.items():
            x = whole(np.array([r[0] for r in rows], float).reshape(len(rows), dim), scale)
            out[dim] = BallTree(x, np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64))
        return out

    def put(out):
        kinds = [pa.int64()] * 4 + [pa.list_(pa.float64()), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(names, kinds)], names=names)

    def ball():
        out: dict[str, list] = {n: [] for n in names}
        for tree in (grow() if trees is None else trees).values():
            for n, x in zip(names, (shard, None, tree.least_id[0], None, tree.centres[0].tolist(), float(tree.radii[0]))):
                out[n].append(x)
        return put(out)

    for b in batches:
        got = b.to_pydict()
        out: dict[str, list] = {n: [] for n in names}
        i, n = 0, b.num_rows
        while i < n:
            if got["shard"][i] != shard:
                if shard is not None:
                    yield ball()
                shard, store, trees = got["shard"][i], {}, None
            j = i
            while j < n and got["shard"][j] == shard and got["role"][j] == got["role"][i]:
                j += 1
            if got["role"][i] == 0:
                for r in range(i, j):
                    store.setdefault(len(got["v"][r]), []).append((got["v"][r], got["id"][r], got["row"][r]))
            else:
                if trees is None:
                    trees, store = grow(), {}
                by_dim: dict[int, list[int]] = {}
                for r in range(i, j):
                    by_dim.setdefault(len(got["v"][r]), []).append(r)
                for dim, rs in by_dim.items():
                    tree = trees.get(dim)
                    if tree is None:
                        continue
                    for a in range(0, len(rs), 512):
                        part = rs[a : a + 512]
                        q = whole(np.array([got["v"][r] for r in part], float).reshape(len(part), dim), scale)
                        bound = tree.bounds(q)
                        for m, r in enumerate(part):
                            floor = None if got["floor_score"][r] is None else (got["floor_score"][r], got["floor_id"][r])
                            for s, v in tree.search(q[m], bound[m], got["row"][r], k, floor):
                                for name, x in zip(names, (got["row"][r], got["id"][r], v, s, None, None)):
                                    out[name].append(x)
            i = j
        yield put(out)
    if shard is not None:
        yield ball()


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0, shard_rows: int = 65536) -> DataFrame:
    """For each query row, the k rows with the highest inner product of floor(scale * x), the query's own row left out.

    Rows go to shards of up to ``shard_rows`` or so (fewer while there are fewer shards than tasks can run): space is cut by
    halves fitted to a sample of rows, which only decides what is near what, and leaves with too many rows are split by
    hash. Each shard builds a ball tree in its task. A query first searches its own shard; its kth (score, id) there is
    shared as the floor from which all others prune: it is sent only to shards whose ball, by q.c + |q| r, may hold
    something better. In a tree, balls are opened in the order of their bounds, until none can beat the kth score; of
    balls that could tie with it, those without a smaller id are passed over. Queries stream through a shard, in blocks;
    none is broadcast. The balls of shards, one vector for shard_rows, are.

    Returns query_id long, rank int (from 1), vec_id long, score long, ties to the smaller id. Vectors that are null, or
    hold null or non-finite components, and rows with a null id take no part. Vectors of unlike lengths aren't compared.
    Repeated rows are rows like others: a copy of the query is a candidate. Scores beyond a long count as its ends. Empty
    tables and queries without candidates give no rows.
    """
    ok = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    base = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"), is_query.alias("q")).filter("id is not null").filter(ok)
    base = stash(base.select(F.monotonically_increasing_id().alias("row"), "id", "v", F.coalesce("q", F.lit(False)).alias("q")), "topk")
    n = base.count()
    size = max(1, min(shard_rows, max(LEAST_ROWS, -(-n // vectors.sparkSession.sparkContext.defaultParallelism))))
    placed = stash(base.mapInArrow(lambda b, r=_router(base, n, size): _placed(b, r), "row long, id long, v array<double>, q boolean, leaf int"), "topk-placed")
    shards, table = 0, []
    for r in sorted(placed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()):  # a row a shard at most
        pieces = max(1, round(r["n"] / size))
        table.append((r["leaf"], shards, pieces))
        shards += pieces
    where = placed.sparkSession.createDataFrame(table, "leaf int, first int, pieces int")
    placed = placed.join(F.broadcast(where), "leaf").withColumn("shard", (F.col("first") + F.pmod(F.xxhash64("id", "row"), F.col("pieces"))).cast("int"))
    cols = ["shard", "role", "row", "id", "v", "floor_score", "floor_id"]
    none = [F.lit(None).cast("long").alias("floor_score"), F.lit(None).cast("long").alias("floor_id")]
    stored = placed.select("shard", F.lit(0).alias("role"), "row", "id", "v", *none)
    asked = placed.filter("q").select("shard", F.lit(1).alias("role"), "row", "id", "v", *none)
    schema = "row long, query_id long, vec_id long, score long, centre array<double>, radius double"

    def search(queries: DataFrame) -> DataFrame:
        rows = stored.select(*cols).unionByName(queries.select(*cols))
        return rows.repartition(max(1, shards), "shard").sortWithinPartitions("shard", "role").mapInArrow(lambda b: _scan(b, k, scale), schema)

    first = stash(search(asked), "topk-own")
    balls: dict[int, list] = {}
    for r in first.filter("centre is not null").collect():
        balls.setdefault(len(r["centre"]), []).append(r)
    balls = {d: (np.array([r["row"] for r in rs]), np.array([r["centre"] for r in rs]).reshape(len(rs), d), np.array([r["radius"] for r in rs]), np.array([r["vec_id"] for r in rs])) for d, rs in balls.items()}
    found = first.filter("centre is null").select("row", "query_id", "vec_id", "score")
    if shards > 1:
        kth = found.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("score"), (-F.col("vec_id")).alias("m"))).alias("w")).filter(F.col("n") >= k)
        floors = kth.select("row", F.col("w.score").alias("floor_score"), (-F.col("w.m")).alias("floor_id"))
        rest = asked.drop("floor_score", "floor_id").join(floors, "row", "left").select(*cols)
        rest = rest.mapInArrow(lambda b: _wanted(b, balls, scale), rest.schema)
        found = found.unionByName(search(rest).filter("centre is null").select("row", "query_id", "vec_id", "score"))
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _router(base: DataFrame, n: int, size: int) -> Router | None:
    """Halves for n / size leaves, from SAMPLE rows at most in hashed order."""
    if n <= size:
        return None
    rows = base.select("v").orderBy(F.xxhash64("row")).limit(SAMPLE).collect()
    dim = Counter(len(r["v"]) for r in rows).most_common(1)[0][0]
    with np.errstate(all="ignore"):
        return Router(np.array([r["v"] for r in rows if len(r["v"]) == dim], float).reshape(-1, dim), -(-n // size))
