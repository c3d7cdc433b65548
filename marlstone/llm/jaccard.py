"""Exact Jaccard join of word shingles: size-banded tiles, bitmap bounds, sorted intersections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import among, drop, stash, trimmed
from .components import components
from .words import ONE, TWO, bounded, mix, shingle_set

RATIO = 1.5  # of the ends of a band of set sizes
TILE = 1024  # classes of a tile that are compared in one task
KEYS_A_TASK = 1_000_000
LOCAL = 16  # classes of a batch from which on a key is dealt to all tasks
LEADERS, MORE, STARS, FEW = 2, 4, 3, 64  # orders of leaders in the first and in later rounds, rounds, classes of a tile that are compared at once
NEAREST = 16  # leaders that a class meets in the first round: those that lead most of its keys
WORTH = 16  # pairs of a later round for each link: where it takes more, tiles do the rest
DENSE = 8  # partners that bitmaps leave to a class of a tile, on average, beyond which each class asks its nearest first
KEY, ROW, ROW_NO_ID, PAIR, SPREAD = 0, 1, 2, 3, 4
MEMBER = np.dtype([("cls", "<i8"), ("n", "<i4")])


def bands(limit: int) -> np.ndarray:
    """Lower ends of the bands of set sizes, past limit."""
    out = [1]
    while out[-1] <= limit:
        out.append(max(out[-1] + 1, int(np.ceil(out[-1] * RATIO))))
    return np.array(out, np.int64)


_ENDS = bands(1 << 40)


def most_differences(size: int, percent: int) -> int:
    """Elements in which two sets of up to ``size`` can differ at 100 * intersection >= percent * union."""
    return 2 * size * (100 - percent) // (100 + percent)


def _cells(h: np.ndarray, n: int, salt: int) -> np.ndarray:
    return ((mix(h + np.uint64((salt * int(ONE)) & ((1 << 64) - 1))) >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def candidate_keys(h: np.ndarray, percent: int) -> np.ndarray:
    """Keys such that any two linked, unlike sets have one in common.

    Sets of a band of sizes differ in d elements at most. Dealt by hash to d + 1 cells and some to spare, linked sets agree
    in a cell, and in one that isn't empty unless more cells are empty than are to spare. A set with too many empty cells
    also gives keys by another dealing, until it has few enough: of two sets, the one that ends first makes sure of both. A
    set gives keys for its own band and for all later ones that a partner may be in.
    """
    s = len(h)
    band = int(np.searchsorted(_ENDS, s, "right")) - 1
    out, own = [], band
    while band == own or 100 * s >= percent * int(_ENDS[band]):
        d = most_differences(int(_ENDS[band + 1]) - 1, percent)
        if d:
            spare = 1 + d // 4  # of a set near the least size of a band, a sixth of the cells are empty
            n = d + 1 + spare
            for salt in range(64):
                cell = _cells(h, n, salt)
                order = np.argsort(cell, kind="stable")
                sorted_cells = cell[order]
                starts = np.flatnonzero(np.concatenate(([True], sorted_cells[1:] != sorted_cells[:-1])))
                sums = np.add.reduceat(mix(h[order]), starts)
                tag = np.uint64((band << 40) | (salt << 32)) + sorted_cells[starts]
                out.append(mix(sums + mix(tag)))
                if n - len(starts) <= spare:
                    break
            else:
                out.append(mix(np.array([band], np.uint64)))  # all that fail 64 times meet
        band += 1
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def near_size(a, b, percent: int):
    """Whether sets of these sizes can be linked."""
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def may_link(a, b, apart, percent: int):
    """Whether sets of sizes a and b that differ in ``apart`` elements at least can be linked: a bound on the overlap from above."""
    most = (a + b - apart) // 2
    return 100 * most >= percent * (a + b - most)


def most_alike(a, b, apart):
    """The highest Jaccard similarity that sets of sizes a and b can have that differ in ``apart`` elements at least."""
    most = (a + b - apart) // 2
    return most / (a + b - most)


def class_of(h: np.ndarray, salt: int = 0) -> tuple[int, int]:
    """Two independent names of a set: equal sets, whatever their texts, are one class. The first is its id, the second a check."""
    if not len(h):
        return 0, 0
    s = np.uint64(salt)
    out = []
    for odd in (ONE, TWO):
        name = (int(mix((h ^ (h >> np.uint64(29))) * odd + s * ONE + odd).sum(dtype=np.uint64)) * int(odd) + len(h)) & ((1 << 64) - 1)
        out.append(name - (1 << 64) if name >> 63 else name)
    return out[0], out[1]


def parity(h: np.ndarray, bits: int) -> np.ndarray:
    """Bitmap of the set, a bit the parity of the elements hashed to it: where bitmaps differ in x bits, sets differ in x elements at least."""
    on = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(on).view(np.uint64)


def bits_of(n: int) -> int:
    """Two bits an element or more, and 2048 at least: so the bound is near the differences that there are."""
    return 1 << min(13, max(11, int(2 * n - 1).bit_length()))


# --- keys, and the tiles that they make -------------------------------------------------------------------------------------


@trimmed
def _emit(batches: Iterator[pa.RecordBatch], n: int, percent: int, buckets: int, salt: int) -> Iterator[pa.RecordBatch]:
    """Per batch: keys with their classes dealt to buckets, and rows (id, size, class, check, text hash).

    A key that LOCAL or more classes of the batch have goes to all buckets, by class (SPREAD); its own bucket gets its
    first class. So a key that a large part of all sets have is no task's alone.
    """
    names = ["bucket", "kind", "a", "b", "c"]
    for b in bounded(batches, 1):
        ids, classes, checks, sizes, keys, owner, seen, members = b.column(0), [], [], [], [], [], {}, []
        for t in b.column(1):
            h = shingle_set(t.as_py(), n)
            c, check = class_of(h, salt)
            classes.append(c)
            checks.append(check)
            sizes.append(len(h))
            if len(h) and c not in seen:
                seen[c] = len(members)
                members.append((c, len(h)))
                k = candidate_keys(h, percent)
                keys.append(k)
                owner.append(np.full(len(k), seen[c], np.int64))
        rows = []
        if keys:
            k, o, m = np.concatenate(keys), np.concatenate(owner), np.array(members, MEMBER)
            order = np.argsort(k, kind="stable")
            k, o = k[order], o[order]
            new = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.empty(0, bool)
            group = np.cumsum(new) - 1
            often = np.bincount(group)[group] >= LOCAL if len(k) else new
            home = (k >> np.uint64(40)) % np.uint64(buckets)
            away = mix(np.ascontiguousarray(m["cls"])[o].view(np.uint64) + k) % np.uint64(buckets)
            for kind, at, to in ((KEY, ~often | new, home), (SPREAD, often, away)):
                rows += [(x, kind, *part) for x, part in _parts(k[at], o[at], to[at].astype(np.int64), m)]
        if classes:
            null = np.array(ids.is_null())
            idv = np.array(ids.fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            cols = np.column_stack((idv, np.array(sizes, np.int64), np.array(classes, np.int64), np.array(checks, np.int64), b.column(2).to_numpy(zero_copy_only=False)))
            for kind, which in ((ROW, ~null), (ROW_NO_ID, null)):
                if which.any():
                    rows.append((int(mix(cols[:1, 4].view(np.uint64))[0] % np.uint64(buckets)), kind, cols[which].tobytes(), b"", b""))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), *[pa.array([r[j] for r in rows], pa.binary()) for j in (2, 3, 4)]], names=names)


def _parts(k: np.ndarray, o: np.ndarray, to: np.ndarray, m: np.ndarray) -> Iterator[tuple[int, tuple[bytes, bytes, bytes]]]:
    """(bucket, keys, which of the members each has, members), for the buckets that get any."""
    order = np.argsort(to, kind="stable")
    starts = np.flatnonzero(np.diff(to[order], prepend=-1))
    for lo, hi in zip(starts, [*starts[1:], len(order)]):
        at = order[lo:hi]
        here, which = np.unique(o[at], return_inverse=True)
        yield int(to[at[0]]), (k[at].tobytes(), which.astype("<u4" if len(here) >> 16 else "<u2").tobytes(), m[here].tobytes())


@trimmed
def _meet(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """A bucket's keys (key, class, size): those whose class has one of a near size beside it, or that went to all tasks;
    and pairs of a class of a key with a leader of it, by one of LEADERS orders of classes, and in how many keys."""
    names = ["kind", "a", "b", "c", "d", "e"]
    keys, which, members, often, n = [], [], [], [], 0

    def out(kind, *cols):
        cols = [*cols, *[np.zeros(len(cols[0]), np.int64)] * (5 - len(cols))]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), kind, np.int32)), *[pa.array(np.ascontiguousarray(c)) for c in cols]], names=names)

    for bt in batches:
        for kind, a, b, c in zip(*[bt.column(x).to_pylist() for x in ("kind", "a", "b", "c")]):
            if kind in (KEY, SPREAD):
                members.append(np.frombuffer(c, MEMBER))
                keys.append(np.frombuffer(a, np.uint64))
                which.append((np.frombuffer(b, "<u4" if len(members[-1]) >> 16 else "<u2").astype(np.int64) + n).astype(np.int32))
                often.append(np.full(len(keys[-1]), kind == SPREAD))
                n += len(members[-1])
            else:
                yield out(kind, *np.frombuffer(a, np.int64).reshape(-1, 5).T)
    if not keys:
        return
    k, o, wide, m = np.concatenate(keys), np.concatenate(which), np.concatenate(often), np.concatenate(members)
    keys, which, often, members = [], [], [], []
    # one number for each class, in the order of sizes, so that sorting by (key, class) takes little memory
    name, at, back = np.unique(m["cls"], return_index=True, return_inverse=True)
    size = m["n"][at].astype(np.int64)
    place = np.empty(len(name), np.int32)
    place[np.lexsort((name, size))] = np.arange(len(name), dtype=np.int32)
    o = place[back[o]]
    name, size = (x[np.argsort(place, kind="stable")] for x in (name, size))
    order = np.lexsort((o, k))
    k, o, wide = k[order], o[order], wide[order]
    del order, m, back, at
    again = (k[1:] == k[:-1]) & (o[1:] == o[:-1])  # one class from several batches
    wide[:-1] |= wide[1:] & again
    new = np.concatenate(([True], ~again))
    k, o, wide = k[new], o[new], wide[new]
    close = (k[1:] == k[:-1]) & near_size(size[o[1:]], size[o[:-1]], percent)
    k, o = (x[wide | np.concatenate(([False], close)) | np.concatenate((close, [False]))] for x in (k, o))
    if not len(k):
        return
    yield out(KEY, k.view(np.int64), name[o], size[o])
    start = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    group = np.cumsum(np.concatenate(([True], k[1:] != k[:-1]))) - 1
    rank = mix(name[o].view(np.uint64) + mix(k) % np.uint64(LEADERS) * TWO)
    lead = o[np.lexsort((rank, group))[start]][group]  # the first of each key
    ok = (name[lead] != name[o]) & near_size(size[lead], size[o], percent)
    pairs, times = np.unique(np.column_stack((name[lead[ok]], name[o[ok]])), axis=0, return_counts=True)
    if len(pairs):
        yield out(PAIR, pairs[:, 0], pairs[:, 1], times.astype(np.int64))


def _possible(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of pairs (a, b, g, size and bitmap of a, of b) those that the bitmaps let link."""
    for b in batches:
        x, y = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 5))
        apart = np.zeros(b.num_rows, np.int64)
        for i, (p, q) in enumerate(zip(b.column(4).to_pylist(), b.column(6).to_pylist())):
            p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
            w = min(len(p), len(q))
            apart[i] = np.bitwise_count(np.bitwise_xor.reduce(p.reshape(-1, w), axis=0) ^ np.bitwise_xor.reduce(q.reshape(-1, w), axis=0)).sum()
        yield b.select(["a", "b", "g"]).filter(pa.array(may_link(x, y, apart, percent)))


# --- tiles ---------------------------------------------------------------------------------------------------------------


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Elements in common of two sorted arrays of distinct elements."""
    if len(a) > len(b):
        a, b = b, a
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())


def tile_pairs(n: np.ndarray, root: np.ndarray, sigs: list[np.ndarray], percent: int, block: np.ndarray | None = None, prior: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, partners, how alike each can be) of the sets of a tile that sizes and bitmaps let link and that aren't connected yet.

    By size, smallest first: partners are at most 100 / percent times as large. ``block``: only pairs of unlike blocks.
    ``prior``: of two such sets another tile has the pair.
    """
    order = np.lexsort((root, n))
    n, root = n[order], root[order]
    words = np.array([len(sigs[i]) for i in order])
    block = None if block is None else block[order]
    prior = None if prior is None or not prior.any() else prior[order]
    folded: dict[int, np.ndarray] = {}
    for i in range(len(order)):
        hi = int(np.searchsorted(n, n[i] * 100 // percent, "right"))
        j = np.arange(i + 1, hi)
        j = j[root[j] != root[i]]
        if block is not None:
            j = j[block[j] != block[i]]
        if prior is not None and prior[i]:
            j = j[~prior[j]]
        if not len(j):
            continue
        w = int(words[i])
        if w not in folded:  # larger bitmaps folded to w words; smaller ones belong to smaller sets, which come before
            folded = {w: np.stack([np.bitwise_xor.reduce(sigs[x].reshape(-1, w), axis=0) if len(sigs[x]) >= w else np.zeros(w, np.uint64) for x in order])}
        sig = folded[w]
        apart = np.bitwise_count(sig[j] ^ sig[i]).sum(1, dtype=np.int64)
        ok = may_link(n[i], n[j], apart, percent)
        j, apart = j[ok], apart[ok]
        if len(j):
            yield int(order[i]), order[j], most_alike(n[i], n[j], apart)


def nearest(pairs: Iterator[tuple[int, np.ndarray, np.ndarray]], root: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a tile, from its pairs: the sets that have partners, outside the largest component; the most alike partner of
    each, how alike they can be, the number of partners, and whether the largest component has any of them."""
    roots, sizes = np.unique(root, return_counts=True)
    main = root == roots[np.argmax(sizes)]
    mate, alike, others, meets = np.zeros(len(root), np.int64), np.full(len(root), -1.0), np.zeros(len(root), np.int64), np.zeros(len(root), bool)
    for i, j, most in pairs:
        others[i] += len(j)
        others[j] += 1
        meets[i] |= main[j].any()
        meets[j] |= main[i]
        k = int(np.argmax(most))
        if most[k] > alike[i]:
            mate[i], alike[i] = j[k], most[k]
        more = most > alike[j]
        mate[j[more]], alike[j[more]] = i, most[more]
    at = np.flatnonzero((others > 0) & ~main)
    return at, mate[at], alike[at], others[at], np.where(meets[at], roots[np.argmax(sizes)], root[at])


@trimmed
def _tiles(batches: Iterator[pa.RecordBatch], percent: int, first: bool) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by tile: (tile, key, cross, class, size, root, block, prior, bitmap). Gives pairs (a, b, root of a); if
    ``first``, a row at most for each that came, but for the largest component of a tile: (key, class, root, most alike
    partner, its root, how alike, partners, the largest component where it has partners, else the class's own)."""
    names = ["key", "cls", "root", "mate", "mroot", "alike", "others", "met"] if first else ["a", "b", "g"]
    tile, key, cross, rows = None, 0, False, []

    def close():
        if len(rows) < 2:
            return
        c, n, root, block, prior = (np.array([r[k] for r in rows], np.int64) for k in range(5))
        pairs = tile_pairs(n, root, [np.frombuffer(r[5], np.uint64) for r in rows], percent, block if cross else None, prior > 0)
        if first:
            at, mate, alike, others, met = nearest(pairs, root)
            yield np.full(len(at), key, np.int64), c[at], root[at], c[mate], root[mate], alike, others, met
            return
        for i, j, _ in pairs:
            lo = root[j] < root[i]
            yield np.where(lo, c[j], c[i]), np.where(lo, c[i], c[j]), np.where(lo, root[j], root[i])

    def out(parts):
        cols = [np.concatenate([p[k] for p in parts]) if parts else np.empty(0) for k in range(len(names))]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if x == "alike" else pa.int64()) for x, c in zip(names, cols)], names=names)

    for b in batches:
        parts, size = [], 0
        for t, at, x, *r in zip(*[b.column(k).to_pylist() for k in range(9)]):
            if t != tile:
                for p in close():
                    parts.append(p)
                    size += len(p[0])
                    if size > 100_000:
                        yield out(parts)
                        parts, size = [], 0
                tile, key, cross, rows = t, at, x, []
            rows.append(r)
        yield out(parts)
    for p in close():
        yield out([p])


@trimmed
def _verify(batches: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (tile, role): the sets of a tile's first members, which are connected already, then the others,
    each with those to compare it with, until it links with one."""
    tile, sets = None, {}
    for b in batches:
        links = []
        for t, role, c, asks, text in zip(*[b.column(k).to_pylist() for k in range(4)], b.column(4)):
            if t != tile:
                tile, sets = t, {}
            h = shingle_set(text.as_py(), n)
            if role == 0:
                sets[c] = h
                continue
            for a in asks:
                o = overlap(sets[a], h)
                if 100 * o >= percent * (len(sets[a]) + len(h) - o):
                    links.append((a, c))
                    break
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


# --- the join ------------------------------------------------------------------------------------------------------------


class _Join:
    """The texts, rows and candidate tiles of one run."""

    def __init__(self, docs: DataFrame, n: int, percent: int, id_col: str, text_col: str):
        self.spark, self.n, self.percent = docs.sparkSession, n, percent
        if not isinstance(docs.schema[id_col].dataType, IntegralType):
            raise TypeError(f"{id_col} must be an integer column, not {docs.schema[id_col].dataType.simpleString()}")
        self.base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"))
        self.least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        total = self.base.agg(F.sum(F.octet_length("text")).alias("t")).first()["t"] or 0
        keys = total / 6 * 2 * (100 - percent) / (100 + percent) * 2.5  # of words of five letters
        self.parts = parts = max(self.least, int(keys / KEYS_A_TASK))
        for salt in range(4):
            found = self.base.mapInArrow(lambda b, s=salt: _emit(b, n, percent, parts, s), "bucket int, kind int, a binary, b binary, c binary")
            self.found = stash(found.repartition(parts, "bucket").mapInArrow(lambda b: _meet(b, percent), "kind int, a long, b long, c long, d long, e long"), "jaccard")
            is_id = F.col("kind") == ROW
            self.rows = self.found.filter((F.col("kind") == ROW) | (F.col("kind") == ROW_NO_ID)).select(F.when(is_id, F.col("a")).alias("id"), F.col("b").alias("n"), F.col("c").alias("cls"), F.col("d").alias("chk"), F.col("e").alias("th"))
            where = F.struct(F.col("id").isNull().alias("none"), "id", "th")
            self.reps = stash(self.rows.filter("n > 0").groupBy("cls").agg(F.min(where).alias("r"), F.min("chk").alias("lo"), F.max("chk").alias("hi")), "jaccard-reps")
            if not self.reps.filter("lo <> hi").limit(1).count():  # no two sets have one name
                break
            drop(self.found, self.reps)
        else:
            raise RuntimeError("names of sets collide")

    def texts(self, classes: DataFrame) -> DataFrame:
        """(class, text, size, bitmap): one text of each class."""
        n = self.n
        want = stash(classes.select("cls").distinct().join(self.reps, "cls").select("cls", F.col("r.id").alias("wid"), F.col("r.th").alias("wth")), "jaccard-want")
        near = among(self.base, want.select(F.col("wth").alias("h")), "th", want.count()).filter("__hit")
        rows = near.join(want, (F.col("th") == F.col("wth")) & F.col("id").eqNullSafe(F.col("wid")))
        rows = rows.groupBy("cls").agg(F.first("text").alias("text"))  # rows that repeat are one
        return stash(rows.mapInArrow(lambda b: _bitmaps(b, n), "cls long, text string, n int, sig binary"), "jaccard-texts")

    def possible(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        percent = self.percent
        of = lambda k: texts.select(F.col("cls").alias(k), F.col("n").alias(f"n{k}"), F.col("sig").alias(f"s{k}"))
        rows = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "g", "na", "sa", "nb", "sb")
        return rows.mapInArrow(lambda b: _possible(b, percent), "a long, b long, g long")

    def verify(self, pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """Links among the pairs (a, b, g): the a's of a g are connected; tiles hold TILE or so of them, and the b's that ask
        for them stream by. Each b gets one link a tile at most."""
        n, percent = self.n, self.percent
        sizes = pairs.groupBy("g").agg(F.approx_count_distinct("a").alias("x"), F.approx_count_distinct("b").alias("y"))
        large = sizes.filter(f"x > {TILE} or y > {TILE}").select(F.col("g").alias("lg"), F.ceil(F.col("x") / TILE).alias("x"), F.ceil(F.col("y") / TILE).alias("y"))
        tiled = pairs.join(large, F.col("g") == F.col("lg"), "left")
        part = lambda c, k: F.coalesce(F.pmod(F.xxhash64(c), F.col(k)), F.lit(0)).cast("string")
        tiled = stash(tiled.select(F.concat_ws(":", F.col("g").cast("string"), part("a", "x"), part("b", "y")).alias("tile"), "a", "b"), "jaccard-tiled")
        first = tiled.select("tile", F.lit(0).alias("role"), F.col("a").alias("cls"), F.lit(None).cast("array<long>").alias("asks")).distinct()
        then = tiled.groupBy("tile", F.col("b").alias("cls")).agg(F.collect_set("a").alias("asks")).select("tile", F.lit(1).alias("role"), "cls", "asks")  # of one tile
        rows = first.unionByName(then).join(texts.select("cls", "text"), "cls").select("tile", "role", "cls", "asks", "text")
        rows = rows.repartition(self.parts, "tile").sortWithinPartitions("tile", "role")
        out = stash(rows.mapInArrow(lambda b: _verify(b, n, percent), "a long, b long"), "jaccard-links")
        drop(tiled)
        return out

    def links(self) -> DataFrame:
        """Links that span the components: of the leaders of each key first, then of what is still apart in a tile."""
        percent = self.percent
        led = self.found.filter(F.col("kind") == PAIR).groupBy("a", "b").agg(F.sum("c").alias("times"))
        best = led.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct(-F.col("times"), "a"))), 1, NEAREST)["a"].alias("by"))
        stars = stash(best.select(F.explode("by").alias("a"), "b").withColumn("g", F.col("a")), "jaccard-stars")
        texts = self.texts(stars.select(F.col("a").alias("cls")).unionByName(stars.select(F.col("b").alias("cls"))))
        maybe = stash(self.possible(stars, texts), "jaccard-maybe")
        links = self.verify(maybe, texts)
        drop(maybe, stars)
        tiles = self.open_tiles(self.found.filter(F.col("kind") == KEY).select(F.col("a").alias("key"), F.col("b").alias("cls"), F.col("c").alias("n")), links)
        drop(texts)
        count = tiles.count()
        texts = self.texts(tiles.select("cls")) if count else None
        for salt in range(1, STARS):  # classes of larger tiles meet other leaders, as long as that connects a good part
            many = tiles.filter(F.col("size") > FEW)
            if not count or not many.limit(1).count():
                break
            order = F.xxhash64("cls", F.pmod(F.col("key"), F.lit(MORE)) + F.lit(salt * MORE))
            lead = many.groupBy("key").agg(F.min_by(F.struct("cls", "n", "root"), order).alias("l"))
            near = 100 * F.least("n", "l.n") >= percent * F.greatest("n", "l.n")
            pairs = many.join(lead, "key").filter((F.col("root") != F.col("l.root")) & near).select(F.col("l.cls").alias("a"), F.col("cls").alias("b"), F.col("l.cls").alias("g")).distinct()
            pairs = stash(pairs, "jaccard-stars")
            maybe = stash(self.possible(pairs, texts), "jaccard-maybe")
            more = self.verify(maybe, texts)
            worth = WORTH * more.count() >= pairs.count()
            after = stash(links.unionByName(more), "jaccard-links")
            drop(maybe, pairs, links, more)
            links = after
            if not worth:
                break
            now = self.open_tiles(tiles.select("key", "cls", "n"), links)
            drop(tiles)
            tiles, count = now, now.count()
        # of dense groups, classes ask those first that may be most alike: one that links spares all others of its component
        dense = bool(count)
        while dense:
            near = stash(self.compared(tiles, texts, True), "jaccard-near")
            seen = near.agg(F.count(F.lit(1)).alias("rows"), F.sum("others").alias("others")).first()
            # a class that isn't in near has no partner, but may be one where it belongs to the largest component
            asking, met = near.select("key", "cls").distinct(), near.select("key", F.col("met").alias("root")).distinct()
            left = tiles.join(asking, ["key", "cls"], "left_semi").unionByName(tiles.join(met, ["key", "root"], "left_semi")).distinct()
            dense, count = (seen["others"] or 0) > DENSE * seen["rows"], seen["rows"]
            if dense:
                asks = near.groupBy("cls", "root").agg(F.max_by(F.struct("mate", "mroot"), F.struct("alike", "mate")).alias("m"))
                lo = F.col("m.mroot") < F.col("root")
                asks = asks.select(F.when(lo, F.col("m.mate")).otherwise(F.col("cls")).alias("a"), F.when(lo, F.col("cls")).otherwise(F.col("m.mate")).alias("b"), F.least("root", "m.mroot").alias("g"))
                asks = stash(asks.distinct(), "jaccard-asks")
                more = self.verify(asks, texts)
                dense = WORTH * more.count() >= asks.count()
                after = stash(links.unionByName(more), "jaccard-links")
                now = self.open_tiles(left.select("key", "cls", "n"), after)
                count = now.count()
                drop(asks, links, more)
                links = after
            else:
                now = stash(left, "jaccard-open")
            drop(tiles, near)
            tiles, dense = now, dense and count > 0
        if not count:
            drop(tiles, texts)
            return links
        pairs = stash(self.compared(tiles, texts, False).distinct(), "jaccard-pairs")
        more = self.verify(pairs, texts)
        out = stash(links.unionByName(more), "jaccard-links")
        drop(tiles, texts, pairs, links, more)
        return out

    def compared(self, tiles: DataFrame, texts: DataFrame, first: bool) -> DataFrame:
        """What _tiles gives of the open tiles. A large tile falls into bands of sizes: a set is in its own and in the next
        (as prior: pairs of such sets are their own band's), so linked sets meet; large bands into blocks, each of which meets each."""
        percent = self.percent
        band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent))) + 1e-9).cast("int") if percent < 100 else F.col("n").cast("int")
        large = tiles.filter(f"size > {TILE}").withColumn("prior", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("band", band + F.col("prior"))
        blocks = large.groupBy("key", "band").agg(F.ceil(F.count(F.lit(1)) / F.lit(TILE / 2)).cast("int").alias("blocks"), F.min("prior").alias("least")).filter("least = 0")
        dealt = large.join(blocks, ["key", "band"]).withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        name = F.concat_ws(":", F.col("key").cast("string"), F.col("band").cast("string"), F.least("block", "other").cast("string"), F.greatest("block", "other").cast("string"))
        # where a block meets itself, all pairs; else those of unlike blocks
        dealt = dealt.select(name.alias("tile"), "key", (F.col("block") != F.col("other")).alias("cross"), "cls", "n", "root", F.col("block").cast("long").alias("block"), "prior")
        small = tiles.filter(f"size <= {TILE}").select(F.col("key").cast("string").alias("tile"), "key", F.lit(False).alias("cross"), "cls", "n", "root", F.lit(0).cast("long").alias("block"), F.lit(0).alias("prior"))
        rows = small.unionByName(dealt).join(texts.select("cls", "sig"), "cls").select("tile", "key", "cross", "cls", "n", "root", "block", "prior", "sig")
        rows = rows.repartition(self.parts, "tile").sortWithinPartitions("tile")
        schema = "key long, cls long, root long, mate long, mroot long, alike double, others long, met long" if first else "a long, b long, g long"
        return rows.mapInArrow(lambda b: _tiles(b, percent, first), schema)

    def open_tiles(self, tiles: DataFrame, links: DataFrame) -> DataFrame:
        """(key, class, size, root, classes of the key) of the keys whose classes aren't all connected; of keys that have the
        same classes, one. Their sums of two hashes tell: 128 bits, and no class can cancel another."""
        roots = components(links).select(F.col("node").alias("cls"), "root")
        rooted = tiles.join(roots, "cls", "left").select("key", "cls", "n", F.coalesce("root", "cls").alias("root"))
        hashes = [F.xxhash64("cls", F.lit(salt)) for salt in (1, 2)]
        halves = [h for x in hashes for h in (F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF)))]
        names = [F.sum(h).alias(f"h{k}") for k, h in enumerate(halves)]
        keys = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size"), *names).filter("lo <> hi")
        apart = keys.groupBy("size", "h0", "h1", "h2", "h3").agg(F.min("key").alias("key")).select("key", "size")
        return stash(rooted.join(apart, "key"), "jaccard-open")

    def result(self) -> DataFrame:
        """Per row: id, th, n, component (a class), the least member (none, id, th) of the component."""
        links = self.links()
        roots = components(links)
        drop(links)
        named = self.reps.join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
        smallest = named.groupBy("root").agg(F.min("r").alias("best"))
        final = stash(named.join(smallest, "root").select("cls", "best"), "jaccard-classes")
        wordless = self.rows.filter("n = 0").select("id", "th", "n", F.lit(None).cast(final.schema["best"].dataType).alias("best"))
        return self.rows.filter("n > 0").join(final, "cls").select("id", "th", "n", "best").unionByName(wordless)


@trimmed
def _bitmaps(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for b in bounded(batches, 1):
        sets = [shingle_set(t.as_py(), n) for t in b.column(1)]
        sigs = [parity(h, bits_of(len(h))).tobytes() for h in sets]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(h) for h in sets], pa.int32()), pa.array(sigs, pa.binary())], names=["cls", "text", "n", "sig"])


def jaccard_classes(docs: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, n_shingles, component_id, the least id that links reach.

    Two rows link if 100 * intersection >= percent * union of their sets of n-word shingles (A-Z lower-cased). Sets are
    compared exactly, as sorted arrays of 64-bit hashes; equal sets are one class and are compared once, however many rows.

    candidate_keys gives any linked pair a key in common. Each key is a tile: only sets that share a key, and are of near
    sizes, are compared. First each class meets those that lead most of its tiles; classes that such links connect need no more
    comparison (the others in tiles of over FEW classes meet other leaders, while that connects a good part), so that a large group of near copies, whose tiles are all alike, costs a few comparisons a member. Of tiles
    with classes that are still apart, pairs that sizes and bitmaps let link are compared: where they are many, first each
    class with the one that bitmaps let be most alike, by rounds, as long as that connects a good part; then all pairs that are
    left apart. Tiles over TILE classes are split by bands of sizes and pairs of blocks. A key that is frequent in a batch is dealt to all tasks. Texts travel
    only to the comparisons that bounds leave over.

    Rows without words have 0 shingles and only themselves. Ids are integers (else a TypeError); rows with a null id link,
    but lend no id; a component without ids has a null one. Repeated rows and an empty table are fine.
    """
    out = _Join(docs, n, percent, id_col, text_col).result()
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("best.id")).alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component of jaccard_classes: that with the least id (rows without one come last), of
    unlike texts with that id the one with the least text hash, and of rows equal in id and text one.

    Rows without words are linked with nothing and all stay. Other rows that bear a kept id stay or go by their own text.
    """
    for c in ("__th", "__hit", "__gone", "__id"):
        if c in docs.columns:
            raise ValueError(f"column exists already: {c}")
    out = _Join(docs, n, percent, id_col, text_col).result().filter("n > 0")
    mine = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    each = out.groupBy("id", "th").agg(F.count(F.lit(1)).alias("times"), F.max(F.when(mine == F.col("best"), 0).otherwise(1)).alias("gone"))
    marks = stash(each.filter("gone = 1 or times > 1").select(F.col("id").alias("__id"), F.col("th").alias("__h"), F.col("gone").alias("__gone")), "jaccard-marks")
    looked = among(docs.withColumn("__th", F.xxhash64(text_col)), marks.select(F.col("__h").alias("h")), "__th", marks.count())
    sure = looked.filter(~F.col("__hit")).select(*docs.columns)
    held = looked.filter("__hit").join(marks, (F.col("__th") == F.col("__h")) & F.col(id_col).cast("long").eqNullSafe(F.col("__id")), "left")
    again = held.filter("__gone = 0").dropDuplicates(["__id", "__th"])
    return sure.unionByName(held.filter("__gone is null").select(*docs.columns)).unionByName(again.select(*docs.columns))
