"""Repeated passages by sparse suffix arrays: suffixes at minimisers, sorted, neighbours extended left and right."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from .common import among, drop, stash, trimmed
from .words import bounded, windows, word_hashes

MIN_WORDS, SEED_WORDS = 50, 16
KEYS_A_TASK = 2_000_000
SUFFIXES_A_TASK = 100_000
LAST = np.iinfo(np.int64).max
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = ["bucket", "kind", "a", "b", "c"]
KIND = "bucket int, kind int, a binary, b binary, c binary"
SORTED, REPEATS, FOUND = 0, 1, 2


def minimisers(h: np.ndarray, min_words: int, seed_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of seed_words words, for each run of min_words words the place of its minimiser).

    The minimiser is the leftmost least hash in the run: the same content selects the same place.
    """
    g = windows(h, seed_words)
    span = min_words - seed_words + 1
    if len(g) < span:
        return g, np.empty(0, np.int64)
    at = np.arange(len(g) - span + 1)
    return g, np.lib.stride_tricks.sliding_window_view(g, span).argmin(1) + at


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32())]
        + [pa.array([r[2 + k].tobytes() if len(r) > 2 + k else b"" for r in rows], pa.binary()) for k in range(3)], names=NAMES)


def _deal(key: np.ndarray, buckets: int, kind: int, *cols: np.ndarray) -> list[tuple]:
    to = ((key >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    cuts = np.flatnonzero(np.diff(to[order], prepend=-1))
    return [(int(to[order[lo]]), kind, *[c[order[lo:hi]] for c in cols]) for lo, hi in zip(cuts, [*cuts[1:], len(order)])]


def _starts(sorted_keys: np.ndarray) -> np.ndarray:
    return np.concatenate(([True], sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.empty(0, bool)


@trimmed
def _suffixes(batches: Iterator[pa.RecordBatch], min_words: int, seed_words: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Suffixes (seed, text) retained at minimisers, sorted in the batch: equal neighbours are found here, and of those only
    the seed goes on, with the mark that it repeats."""
    for b in bounded(batches, 0):
        seeds, owner, seen = [], [], set()
        for t, th in zip(b.column(0), b.column(1).to_pylist()):
            if th in seen:
                continue
            seen.add(th)
            g, at = minimisers(word_hashes(t.as_py()), min_words, seed_words)
            s = g[np.unique(at)]
            seeds.append(s)
            owner.append(np.full(len(s), th, np.int64))
        if not seeds:
            continue
        k, o = np.concatenate(seeds), np.concatenate(owner)
        order = np.lexsort((o, k))
        k, o = k[order], o[order]
        new = _starts(k)
        group = np.cumsum(new) - 1
        several = np.bincount(group, minlength=int(new.sum()))[group] > 1
        rows = _deal(k[~several], buckets, SORTED, k[~several], o[~several])
        rows += _deal(k[several & new], buckets, REPEATS, k[several & new])
        if several.any():
            rows += _deal(k[several], buckets, FOUND, k[several], o[several])
        yield _blobs(rows)


@trimmed
def _repeating(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, seed) of the seeds that another text, or another place of the text, has too."""
    keys, owner, marked, n = [], [], [], 0

    def out(o, k):
        return pa.RecordBatch.from_arrays([pa.array(o), pa.array(k.view(np.int64))], names=["th", "seed"])

    for bt in batches:
        for kind, a, b in zip(*[bt.column(x).to_pylist() for x in ("kind", "a", "b")]):
            k = np.frombuffer(a, np.uint64)
            if kind == SORTED:
                keys.append(k)
                owner.append(np.frombuffer(b, np.int64))
            elif kind == REPEATS:
                marked.append(k)
            else:
                yield out(np.frombuffer(b, np.int64), k)
    if keys:
        k, o = np.concatenate(keys), np.concatenate(owner)
        order = np.lexsort((o, k))
        k, o = k[order], o[order]
        new = _starts(k)
        group = np.cumsum(new) - 1
        unlike = np.zeros(int(new.sum()), bool)
        unlike[group[1:][(k[1:] == k[:-1]) & (o[1:] != o[:-1])]] = True  # neighbours with one seed and unlike texts
        hit = unlike[group]
        if marked:
            m = np.unique(np.concatenate(marked))
            at = np.minimum(np.searchsorted(m, k), len(m) - 1)
            hit |= m[at] == k
        yield out(o[hit], k[hit])


def _runs(th: np.ndarray, pos: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ranges that runs of neighbouring windows cover."""
    order = np.lexsort((pos, th))
    th, pos = th[order], pos[order]
    new = np.concatenate(([True], (th[1:] != th[:-1]) | (pos[1:] > pos[:-1] + 1))) if len(th) else np.empty(0, bool)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(th)) - 1 if len(first) else first
    return th[first], pos[first], pos[last] + width


def neighbours(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of words in sorted order, and how many leading words each has in common with the one before it."""
    flat = np.ascontiguousarray(words.astype(">u8")).view(f"S{8 * words.shape[1]}")[:, 0]
    order = np.argsort(flat, kind="stable")
    a = words[order]
    apart = a[1:] != a[:-1]
    common = np.where(apart.any(1), apart.argmax(1), words.shape[1])
    return order, np.concatenate(([0], common))


def later_windows(words: np.ndarray, most: np.ndarray, least: np.ndarray, rank: np.ndarray, before: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(offset, rows, whether each is later): of suffixes, the runs of words that reach ``offset`` words before them, and
    whether a suffix of lower rank has the same run.

    words: ``before`` words on the left of each suffix, then its first words; runs are as long as the latter. Suffixes are
    sorted by what follows and neighbours compared, which says how far each match goes right; then by what comes before,
    read backwards, which says how far left. Runs are equal where both reach far enough. A suffix has the offsets from
    ``least`` to ``most``.
    """
    n, length = len(words), words.shape[1] - before
    right, far_right = neighbours(words[:, before:])
    left, far_left = neighbours(words[:, :before][:, ::-1]) if before else (np.arange(n), np.zeros(n, np.int64))
    follows, comes = np.empty(n, np.int64), np.empty(n, np.int64)
    for offset in range(before + 1):
        rows = np.flatnonzero((least <= offset) & (offset <= most))
        if not len(rows):
            continue
        follows[right] = np.cumsum(far_right < length - offset)
        comes[left] = np.cumsum(far_left < offset)
        key = follows[rows] * (n + 1) + comes[rows]
        order = np.lexsort((rank[rows], key))
        k, r = key[order], rank[rows][order]
        first = np.flatnonzero(_starts(k))
        lowest = np.repeat(r[first], np.diff(first, append=len(k)))
        later = np.empty(len(rows), bool)
        later[order] = r > lowest  # rows equal in id, text and place have one rank
        yield offset, rows, later


class _Suffixes:
    """Suffixes at repeating minimisers: with the words around, whose they are, their places, and the runs they stand for."""

    def __init__(self, min_words: int, seed_words: int):
        self.length, self.before = min_words, min_words - seed_words
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, seed, words, who):
        """who: id, text, place, most and least offset, a row each."""
        self.parts.append((seed, words, who))
        self.size += len(seed)

    def compare(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """(seed, words, who, which have a run that no other before them has, (text, lo, hi) of runs that repeat)."""
        seed, words, who = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        order = np.lexsort((who[:, 2], who[:, 1], who[:, 0]))
        w = who[order]
        rank = np.empty(len(who), np.int64)
        rank[order] = np.cumsum(np.concatenate(([True], (w[1:, :3] != w[:-1, :3]).any(1)))) - 1
        new, t, at = np.zeros(len(who), bool), [], []
        for offset, rows, later in later_windows(words, who[:, 3], who[:, 4], rank, self.before):
            new[rows[~later]] = True
            t.append(who[rows[later], 1])
            at.append(who[rows[later], 2] - offset)
        spans = list(_runs(np.concatenate(t), np.concatenate(at), self.length)) if t else [np.empty(0, np.int64)] * 3
        same = np.zeros(len(who), bool)  # of equal rows one goes on
        same[order[1:]] = rank[order[1:]] == rank[order[:-1]]
        return seed, words, who, new & ~same, spans


@trimmed
def _extend(batches: Iterator[pa.RecordBatch], min_words: int, seed_words: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Repeating suffixes with the words around them. A batch compares its own; of those whose every run repeats an earlier
    one only the ranges go on."""
    before = min_words - seed_words
    for b in bounded(batches, 0):
        own = _Suffixes(min_words, seed_words)
        for text, th, i, known in zip(*[b.column(k).to_pylist() for k in range(4)]):
            h = word_hashes(text)
            g, at = minimisers(h, min_words, seed_words)
            if not len(at):
                continue
            run = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))  # runs of windows with one minimiser
            last = np.append(run[1:], len(at)) - 1
            p = at[run]
            wanted = np.isin(g[p], np.array(known, np.int64).view(np.uint64))
            if not wanted.any():
                continue
            p, run, last = p[wanted], run[wanted], last[wanted]
            padded = np.concatenate((np.zeros(before, np.uint64), h, np.zeros(min_words, np.uint64)))
            words = np.lib.stride_tricks.sliding_window_view(padded, before + min_words)[p]
            own.add(g[p], words, np.column_stack((np.full(len(p), LAST if i is None else i), np.full(len(p), th), p, p - run, p - last)).astype(np.int64))
        if not own.size:
            continue
        seed, words, who, new, spans = own.compare()
        rows = _deal(seed[new], buckets, SORTED, seed[new], words[new], who[new])
        if len(spans[0]):
            rows.append((int(spans[1][0]) % buckets, FOUND, *spans))
        yield _blobs(rows)


@trimmed
def _later(batches: Iterator[pa.RecordBatch], min_words: int, seed_words: int) -> Iterator[pa.RecordBatch]:
    """Word ranges (text, lo, hi) that repeat an earlier passage: a bucket's suffixes, sorted and compared."""
    own = _Suffixes(min_words, seed_words)

    def out(t, lo, hi):
        return pa.RecordBatch.from_arrays([pa.array(t), pa.array(lo), pa.array(hi)], names=["th", "lo", "hi"])

    for bt in batches:
        for kind, *blobs in zip(*[bt.column(x).to_pylist() for x in ("kind", "a", "b", "c")]):
            if kind == FOUND:
                yield out(*[np.frombuffer(x, np.int64) for x in blobs])
            else:
                seed = np.frombuffer(blobs[0], np.uint64)
                own.add(seed, np.frombuffer(blobs[1], np.uint64).reshape(len(seed), -1), np.frombuffer(blobs[2], np.int64).reshape(len(seed), -1))
    if own.size:
        yield out(*own.compare()[4])


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(firsts, spans): the least id of each distinct text (th, first), and per text its word ranges [lo, hi) that lie in a
    run of ``min_words`` words (A-Z lower-cased) found before, in the order of (id, place). Both are stashed.

    A sparse suffix array holds the suffixes that start at minimisers: in each run of min_words words, the seed of
    seed_words words with the least hash. Equal runs have equal seeds, so a seed that no neighbour in the sorted order
    shares needs no more work. The others, with the words around them, are sorted by what follows and by what comes before
    (read backwards), and neighbours are compared word by word: that says how far matches extend right and left, and so
    which runs are equal; of equal ones the first stays. Batches compare their own suffixes first and send on only those
    with a run that is new to the batch, so the inside of a passage that very many texts share costs a row a batch. Words
    are compared as 64-bit hashes, one by one; texts are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th")).filter("text is not null")
    total = base.agg(F.sum(F.octet_length("text")).alias("t")).first()["t"] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    span = min_words - seed_words + 1
    parts = max(least, int(total / 6 * 2 / (span + 1) / KEYS_A_TASK))
    found = base.select("text", "th").mapInArrow(lambda b: _suffixes(b, min_words, seed_words, parts), KIND)
    found = found.repartition(parts, "bucket").mapInArrow(_repeating, "th long, seed long")
    seeds = stash(found.groupBy("th").agg(F.collect_set("seed").alias("seeds")), "suffix-seeds")  # of one text
    firsts = stash(base.groupBy("th").agg(F.min("id").alias("first")), "suffix-firsts")
    near = among(base, seeds.select(F.col("th").alias("h")), "th", seeds.count()).filter("__hit")
    known = seeds.join(firsts, "th").withColumnRenamed("th", "kth")
    some = near.join(known, (F.col("th") == F.col("kth")) & F.col("id").eqNullSafe(F.col("first"))).select("text", "th", "id", "seeds")
    parts = max(least, int(total / 6 * 2 / (span + 1) / 2 / SUFFIXES_A_TASK))
    runs = some.mapInArrow(lambda b: _extend(b, min_words, seed_words, parts), KIND)
    runs = runs.repartition(parts, "bucket").mapInArrow(lambda b: _later(b, min_words, seed_words), "th long, lo long, hi long")
    spans = stash(runs.groupBy("th").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans")), "suffix-spans")  # of one text
    drop(seeds)
    return firsts, spans


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi))
        else:
            out.append((lo, hi))
    return out


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words [lo, hi) of the spans and the white space that follows them."""
    if not spans:
        return text
    at = [m.start() for m in _WORDS.finditer(text)] + [len(text)]
    out, done = [], 0
    for lo, hi in spans:
        out.append(text[done : at[lo]])
        done = at[hi]
    return "".join([*out, text[done:]])


def cut_repeats(docs: DataFrame, min_words: int = MIN_WORDS, seed_words: int = SEED_WORDS, id_col: str = "doc_id", text_col: str = "text", cut_col: str | None = "cut_text") -> DataFrame:
    """docs with n_words, n_cut_words, cut_spans (array of struct lo, hi: word ranges) and, if named, ``cut_col``: the text
    without passages of at least ``min_words`` words that a document before it (by id, then place) has too.

    The first occurrence stays whole. A text that another document of a smaller id has as it is goes whole if it has
    min_words words. Null texts stay null and have no words; rows with a null id come last; rows equal in id and text
    are one document and get equal results. Extra columns pass; a clash with an added name is an error.
    """
    added = ["n_words", "n_cut_words", "cut_spans"] + ([cut_col] if cut_col else [])
    if set(added) & set(docs.columns):
        raise ValueError(f"columns exist already: {sorted(set(added) & set(docs.columns))}")
    firsts, spans = repeated_spans(docs, min_words, seed_words, id_col, text_col)
    known = firsts.join(spans, "th", "left").withColumnRenamed("th", "__th")
    kind = "array<struct<lo:bigint,hi:bigint>>"
    rows = docs.filter(F.col(text_col).isNotNull()).withColumn("__th0", F.xxhash64(text_col)).join(known, F.col("__th0") == F.col("__th"), "left")
    is_first = F.col(id_col).cast("long").eqNullSafe(F.col("first"))
    rows = rows.select(*docs.columns, F.when(is_first, F.coalesce("spans", F.array().cast(kind))).alias("__spans"))
    rows = rows.unionByName(docs.filter(F.col(text_col).isNull()).withColumn("__spans", F.lit(None).cast(kind)))  # these meet nothing
    schema = StructType(list(docs.schema.fields)).add("n_words", "long").add("n_cut_words", "long").add("cut_spans", DataType.fromDDL(kind))
    if cut_col:
        schema = schema.add(cut_col, "string")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches, at):
            words, cut, where, texts = [], [], [], []
            for text, s in zip(b.column(at), b.column(b.num_columns - 1).to_pylist()):
                t = text.as_py()
                n = len((t or "").encode("utf-8", "surrogatepass").split())
                s = ([(0, n)] if n >= min_words else []) if s is None else joined([(x["lo"], x["hi"]) for x in s])
                words.append(n)
                cut.append(sum(hi - lo for lo, hi in s))
                where.append([{"lo": lo, "hi": hi} for lo, hi in s])
                texts.append(None if t is None else cut_words(t, s) if cut_col else "")
            cols = [*b.columns[:-1], pa.array(words, pa.int64()), pa.array(cut, pa.int64()), pa.array(where, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))]
            if cut_col:
                cols.append(pa.array(texts, pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:-1], *added])

    return rows.mapInArrow(run, schema)
