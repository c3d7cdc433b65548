"""Hashed maximum-entropy language model: n-gram and skip features, class-factored softmax, distributed gradient updates."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash, trimmed
from .words import bounded

#: Words with a place in the softmax: GROUPS of PER_GROUP classes of PER_CLASS words; classes of the other words, one more group.
GROUPS, PER_GROUP, PER_CLASS, RARE = 16, 32, 16, 32
CLASSES = GROUPS * PER_GROUP
HOT = CLASSES * PER_CLASS
#: Rows (as bits) of the hashed tables of weights: for the group, the class in it, the word in that. At most 16.
BITS = (15, 16, 16)
#: Words whose counts every task holds; the counts of all others come by a join.
COUNTED, LONGEST = 1 << 18, 64
END = b""  # the end token: no word is empty
ROUNDS, BATCH, RATE = 3, 32768, 0.35
TASK_BYTES = 48 << 20  # of text that a training task gets at least, so that it learns more than it sends
ROWS_A_BLOCK = 512
SLICE = 4 << 20  # bytes of text that become tokens at once
PIECE = 16  # rows of a run that are summed together
LN10 = math.log(10)


def rare_class(word: bytes) -> int:
    """Class of a word without a place of its own: by its last two bytes, which any word has, known or not."""
    return zlib.crc32(word[-2:]) % RARE


@dataclass
class Vocabulary:
    """Bounded by COUNTED words of LONGEST bytes at most."""

    words: list[bytes]  # the HOT most frequent, which are in the softmax, by their last letters; then the others by falling count
    counts: np.ndarray
    tokens: int  # N
    types: int  # V
    rare_mass: np.ndarray  # by rare class: counts of its words + its words + 1

    def __post_init__(self):
        self._known = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in ("words", "counts", "tokens", "types", "rare_mass")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._known = None

    @property
    def known(self) -> pa.Array:
        if self._known is None:
            self._known = pa.array(self.words, pa.binary())
            self.rare_of = np.array([rare_class(w) for w in self.words] or [0], np.int32)
            self.end = self.words.index(END) if END in self.words else -1
        return self._known


@dataclass
class Tokens:
    """The tokens of some texts, one after the other: what the model needs to know of each."""

    before: np.ndarray  # symbol of the word before; symbols: hot words, then rare classes, then the start
    before2: np.ndarray
    group: np.ndarray  # GROUPS: that of the rare classes
    inner: np.ndarray  # class in the group, or rare class
    word: np.ndarray  # place in the class, of hot words
    hot: np.ndarray
    ids: np.ndarray  # -1: not among the counted words
    others: pa.Array  # those
    sizes: np.ndarray  # tokens of each text

    def part(self, a: int, b: int) -> tuple:
        return tuple(x[a:b] for x in (self.before, self.before2, self.group, self.inner, self.word, self.hot))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of the texts (A-Z lower-cased), one after the other, and how many each has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # at the six ASCII spaces
    words, owner = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)
    some = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # beside spaces at the ends there are empty ones
    return words.filter(pa.array(some)).cast(pa.binary()), np.bincount(owner[some], minlength=len(texts)).astype(np.int64)


#: Rare class of a word by its last byte, if it has one, and by its last two.
_LAST = np.array([rare_class(bytes([x])) for x in range(256)], np.int32)
_LAST_TWO = np.array([rare_class(bytes([x >> 8, x & 255])) for x in range(1 << 16)], np.int32)


def rare_classes(words: pa.Array) -> np.ndarray:
    """rare_class of each word; none is empty."""
    if not len(words):
        return np.empty(0, np.int32)
    _, ends, data = words.buffers()
    end = np.frombuffer(ends, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    raw, size, last = np.frombuffer(data, np.uint8), np.diff(end), end[1:] - 1
    return np.where(size > 1, _LAST_TWO[raw[np.maximum(last - 1, 0)].astype(np.int64) << 8 | raw[last]], _LAST[raw[last]])


def tokens_of(vocab: Vocabulary, texts: pa.Array | list[str]) -> Tokens:
    """Words (A-Z lower-cased) and the end of each text."""
    if isinstance(texts, list):
        texts = pa.array(texts, pa.string())
    words, sizes = words_of(texts)
    found = pc.index_in(words, value_set=vocab.known).fill_null(-1).to_numpy(zero_copy_only=False)
    others = words.filter(pa.array(found < 0))
    rare = vocab.rare_of.take(found, mode="clip")
    rare[found < 0] = rare_classes(others)
    sizes = sizes + 1
    start = np.cumsum(sizes) - sizes
    last = start + sizes - 1
    word = np.ones(int(sizes.sum()), bool)
    word[last] = False
    ids, inner = np.full(len(word), vocab.end, np.int32), np.zeros(len(word), np.int32)
    ids[word], inner[word] = found, rare
    inner[last] = rare_class(END)
    hot = (ids >= 0) & (ids < HOT)
    cls = ids // PER_CLASS
    symbol = np.where(hot, ids, HOT + inner)
    before = np.empty_like(symbol)
    before[1:] = symbol[:-1]
    before[start] = HOT + RARE
    before2 = np.empty_like(symbol)
    before2[1:] = before[:-1]
    before2[start] = HOT + RARE
    return Tokens(before, before2, np.where(hot, cls // PER_GROUP, GROUPS), np.where(hot, cls % PER_GROUP, inner), np.where(hot, ids % PER_CLASS, 0), hot, ids, others, sizes)


def _hash(context: np.ndarray, salt: int, bits: int) -> np.ndarray:
    x = (context + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    return ((x * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - bits)).astype(np.uint16)


class Model:
    """Chances factored into group, class in the group, and word in the class. At each level, a softmax over a bias (log
    frequencies) and three hashed rows of weights: of the word before, of the word before that (skip), and of both
    (trigram), each together with the group or class that the level is within."""

    def __init__(self, biases: list[np.ndarray], weights: list[np.ndarray] | None = None):
        self.biases = [b.astype(np.float32) for b in biases]
        self.weights = [np.zeros((1 << n, w), np.float32) for n, w in zip(BITS, (GROUPS + 1, PER_GROUP, PER_CLASS))] if weights is None else weights

    def level(self, k: int, before, before2, group, inner, word, hot):
        """(rows of the three features, logits, target, which tokens) of level k."""
        at = slice(None)
        if k == 2:  # only hot words have one
            at = np.flatnonzero(hot)
            before, before2, group, inner, word = (x.take(at) for x in (before, before2, group, inner, word))
        within = None if k == 0 else group if k == 1 else group * PER_GROUP + inner
        b, s = before.astype(np.uint64), before2.astype(np.uint64)
        own = np.uint64(0) if k == 0 else within.astype(np.uint64) + np.uint64(1)
        rows = [_hash(x * np.uint64(1024) + own, 8 * k + i, BITS[k]) for i, x in enumerate((b, s, b * np.uint64(65537) + s))]
        w = self.weights[k]
        logit = w.take(rows[0], axis=0)
        logit += w.take(rows[1], axis=0)
        logit += w.take(rows[2], axis=0)
        logit += self.biases[0] if k == 0 else self.biases[k].take(within, axis=0)
        np.clip(logit, -60, 60, out=logit)  # so that exp() stays finite
        return rows, logit, (group, inner, word)[k], at

    def score(self, tokens: Tokens) -> np.ndarray:
        """Natural log chance of each token's group, class and, for hot words, of the word in it."""
        out = np.zeros(len(tokens.ids))
        for a in range(0, len(out), BATCH):
            part = out[a : a + BATCH]
            for k in range(3):
                _, logit, target, at = self.level(k, *tokens.part(a, a + BATCH))
                if len(logit):
                    mine = logit[np.arange(len(target)), target].astype(float)
                    part[at] += mine - np.log(np.exp(logit, out=logit).sum(1))
        return out


def run_sums(grad: np.ndarray, order: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sums of grad[order] over the runs that begin at start. Runs fall into pieces of PIECE rows, the k-th rows of all
    pieces are added at once, and then the pieces of a run in the same way."""
    length = np.diff(start, append=len(order))
    pieces = -(-length // PIECE)
    first = np.cumsum(pieces) - pieces
    place = np.arange(int(pieces.sum())) - np.repeat(first, pieces)
    begin = np.repeat(start, pieces) + place * PIECE
    size = np.minimum(np.repeat(length, pieces) - place * PIECE, PIECE)
    rank = np.argsort(np.uint8(PIECE) - size.astype(np.uint8), kind="stable")  # longest first
    begin, more = begin[rank], PIECE - np.sort(PIECE - size)
    sums = grad.take(order[begin], axis=0)
    for k in range(1, PIECE):
        n = int(np.searchsorted(-more, -k))  # pieces of more than k rows
        if not n:
            break
        sums[:n] += grad.take(order[begin[:n] + k], axis=0)
    back = np.empty(len(rank), np.int64)
    back[rank] = np.arange(len(rank))
    return sums.take(back, axis=0) if len(rank) == len(start) else run_sums(sums, back, first)


class Trainer:
    """Adaptive gradient steps on one task's tokens, from the shared model."""

    def __init__(self, model: Model):
        self.m = model
        self.acc = [np.full(1 << n, 1e-3, np.float32) for n in BITS]
        self.seen = [np.zeros(1 << n, np.float32) for n in BITS]

    def step(self, *part) -> None:
        for k in range(3):
            rows, grad, target, _ = self.m.level(k, *part)
            if not len(grad):
                continue
            np.exp(grad, out=grad)
            grad *= (1 / grad.sum(1))[:, None]
            grad[np.arange(len(target)), target] -= 1
            rows, n = np.concatenate(rows), len(grad)
            order = np.argsort(rows, kind="stable")
            rows = rows[order]
            start = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
            order[order >= 2 * n] -= n
            order[order >= n] -= n
            total, u = run_sums(grad, order, start), rows[start]
            acc = self.acc[k][u] + np.einsum("ij,ij->i", total, total) * np.float32(8 / total.shape[1])
            self.acc[k][u] = acc
            self.seen[k][u] += np.diff(start, append=len(rows))
            total *= (RATE / np.sqrt(acc))[:, None]
            w = self.m.weights[k]
            w[u] = w.take(u, axis=0) - total


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))


@trimmed
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in bounded(batches, 0, 32 << 20):
        words, _ = words_of(b.column(0))
        c = pc.value_counts(words)
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([c.field("values"), pa.array([END], pa.binary())]), pa.concat_arrays([c.field("counts"), pa.array([b.num_rows], pa.int64())])], names=["word", "n"])


def _vocabulary(table: DataFrame) -> Vocabulary:
    """Counts of all words are in table; the driver gets the most frequent, COUNTED at most, and sums.

    A histogram of counts in steps of a 64th of a doubling (4096 rows at most) says from which count on there are few
    enough words; so no task sends more than its share of them.
    """
    sums = table.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    step = F.floor(F.log2(F.col("c").cast("double")) * 64 + 1e-9).cast("long")
    short = table.filter(F.octet_length("word") <= LONGEST).withColumn("step", step)
    upto, least = 0, 1 << 60
    for r in sorted(short.groupBy("step").agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        upto += r["n"]
        if upto > COUNTED:
            break
        least = r["step"]
    best = short.filter(F.col("step") >= least).select("word", "c").toArrow()
    words, counts = best.column(0).to_pylist(), best.column(1).to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
    order[:HOT] = sorted(order[:HOT], key=lambda i: words[i][::-1])  # words that end alike share a class
    words, counts = [words[i] for i in order], np.array([counts[i] for i in order], np.int64)
    rare = F.pmod(F.crc32(F.expr("substring(word, -2, 2)")), F.lit(RARE))
    mass = np.ones(RARE)
    for r in table.groupBy(rare.alias("k")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        mass[r["k"]] += r["n"] + r["v"]
    for w, c in zip(words[:HOT], counts[:HOT].tolist()):
        mass[rare_class(w)] -= c + 1
    return Vocabulary(words, counts, int(sums["n"] or 0), int(sums["v"]), np.maximum(mass, 1.0))


def _start(v: Vocabulary) -> Model:
    """Weights 0; biases are the log frequencies, so that training starts from the unigram model."""
    hot = np.zeros(HOT)
    hot[: min(HOT, len(v.counts))] = v.counts[:HOT]
    per = hot.reshape(GROUPS, PER_GROUP, PER_CLASS) + 1e-3
    by_class, by_group = per.sum(2), np.append(per.sum((1, 2)), v.rare_mass.sum())
    return Model([np.log(by_group / by_group.sum()), np.log(np.vstack((by_class, v.rare_mass)) / by_group[:, None]), np.log(per / by_class[:, :, None]).reshape(CLASSES, PER_CLASS)])


def _blocks(kind: int, table: np.ndarray, base: np.ndarray, seen: np.ndarray) -> Iterator[tuple[int, int, bytes, bytes]]:
    """What a task moved, in blocks of rows, weighed by how often it saw each row; rows that it didn't see are left out."""
    for k in range(0, len(table), ROWS_A_BLOCK):
        n = seen[k : k + ROWS_A_BLOCK]
        if n.any():
            at = k + np.flatnonzero(n)
            yield kind, k, n.astype("<f4").tobytes(), ((table[at] - base[at]) * seen[at, None]).astype("<f4").tobytes()


@trimmed
def _learn(batches: Iterator[pa.RecordBatch], vocab: Vocabulary, model: Model) -> Iterator[pa.RecordBatch]:
    own = Model(model.biases, [w.copy() for w in model.weights])
    trainer = Trainer(own)
    for b in bounded(batches, 0, SLICE):
        tokens = tokens_of(vocab, b.column(0))
        for a in range(0, len(tokens.ids), BATCH):
            trainer.step(*tokens.part(a, a + BATCH))
    rows = [r for k in range(3) for r in _blocks(k, own.weights[k], model.weights[k], trainer.seen[k])]
    for a in range(0, len(rows), 16):
        part = rows[a : a + 16]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.int32()), *[pa.array([r[k] for r in part], pa.binary()) for k in (2, 3)]], names=["kind", "at", "n", "delta"])


@trimmed
def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[int, int], list] = {}
    for b in batches:
        for kind, at, n, d in zip(*[b.column(k).to_pylist() for k in range(4)]):
            n = np.frombuffer(n, "<f4").astype(np.float64)
            own = n > 0
            d = np.frombuffer(d, "<f4").reshape(int(own.sum()), -1)
            s = sums.setdefault((kind, at), [np.zeros(len(n)), np.zeros((len(n), d.shape[1]))])
            s[0] += n
            s[1][own] += d
    for (kind, at), (n, d) in sums.items():
        mean = (d / np.maximum(n, 1e-9)[:, None]).astype("<f4")
        yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([at], pa.int32()), pa.array([mean.tobytes()], pa.binary())], names=["kind", "at", "delta"])


def train(docs: DataFrame, vocab: Vocabulary, id_col: str = "doc_id", rounds: int = ROUNDS) -> Model:
    """Each round, every task makes gradient steps on its share of a slice of the documents, all from the same weights; what
    rows moved is averaged over tasks, by how often each saw them, summed in blocks by a shuffle, and shared again. One pass
    over all training documents in ``rounds`` slices. Tasks get TASK_BYTES of text or more, as far as there is more. The
    driver holds one model (about 15 MB), whatever the corpus. Weights depend on how rows are dealt to tasks.
    """
    spark = docs.sparkSession
    model = _start(vocab)
    words = spark.sparkContext.broadcast(vocab)
    total = docs.agg(F.sum(F.octet_length("text")).alias("t")).first()["t"] or 0
    tasks = max(1, -(-total // TASK_BYTES))
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(model)
        part = docs.filter(F.pmod(F.xxhash64(id_col, F.lit(5)), F.lit(rounds)) == k).select("text").coalesce(tasks)
        moved = part.mapInArrow(lambda b: _learn(b, words.value, shared.value), "kind int, at int, n binary, delta binary")
        moved = moved.repartition("kind", "at").mapInArrow(_sum_blocks, "kind int, at int, delta binary")
        tables = [w.copy() for w in model.weights]
        got = moved.toArrow()  # of the size of the model
        for kind, at, delta in zip(got["kind"].to_pylist(), got["at"].to_pylist(), got["delta"].to_pylist()):
            t = tables[kind]
            d = np.frombuffer(delta, "<f4").reshape(-1, t.shape[1])
            t[at : at + len(d)] += d
        model = Model(model.biases, tables)
        shared.unpersist()
    return model


@trimmed
def _score(batches: Iterator[pa.RecordBatch], vocab: Vocabulary, model: Model) -> Iterator[pa.RecordBatch]:
    norm = math.log(vocab.tokens + vocab.types + 1)
    log_mass = np.log(vocab.rare_mass)
    log_count = np.log(vocab.counts + 1.0) if len(vocab.counts) else np.zeros(1)
    for b in bounded(batches, 2, SLICE):
        t = tokens_of(vocab, b.column(2))
        s = model.score(t)
        known = t.ids >= 0
        lc = np.where(known, log_count.take(t.ids, mode="clip"), 0.0)
        rare = t.group == GROUPS
        s[rare] += lc[rare] - log_mass[t.inner[rare]]
        at = np.cumsum(t.sizes) - t.sizes
        sums = [np.add.reduceat(x, at) for x in ((lc - norm) / LN10, s / LN10, known.astype(np.int64))]
        unknown = np.add.reduceat((~known).astype(np.int64), at) - (vocab.end < 0)  # an unknown end isn't among the others
        others, counts, n = t.others.to_pylist(), [], 0
        for k in unknown.tolist():
            counts.append(Counter(others[n : n + k]))
            n += k
        words = pa.array([w for c in counts for w in c], pa.binary())
        times = pa.array([x for c in counts for x in c.values()], pa.int64())
        offsets = np.concatenate(([0], np.cumsum([len(c) for c in counts])))
        rest = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([words, times], names=["word", "n"]))
        yield pa.RecordBatch.from_arrays([
            b.column(0), b.column(1), pa.array(t.sizes), pa.array(sums[2]), pa.array(sums[0]), pa.array(sums[1]), rest],
            names=["row", "id", "n_tokens", "n_known", "base", "score", "rest"])


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Per row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 chance of the whole text).

    Learns from rows whose crc32(id as text) mod 7 isn't 2. The model: of the HOT most frequent words, a group, a class in
    it and the word in that, each by a softmax over hashed weights of the two words before; of all others, one more group
    and in it a class by their last letters, then the word by its count + 1 among those of the class, where one more
    stands for unknown words. Chances sum to 1 over the known words and the unknown ones.

    Counts of words beyond the COUNTED most frequent come by a join on the word, so that no vocabulary is held whole. Null
    texts count as empty (one token, the end); rows with null ids are learned from; repeated rows count each; with no
    training rows all tokens are unknown.
    """
    base = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    seen = base.filter(~held_out("id"))
    counts = stash(seen.select("text").mapInArrow(_count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c")), "lm-counts")
    vocab = _vocabulary(counts)
    model = train(seen, vocab, "id", rounds)
    spark = docs.sparkSession
    words, shared = spark.sparkContext.broadcast(vocab), spark.sparkContext.broadcast(model)
    kinds = dict(base.dtypes)
    schema = f"row long, id {kinds['id']}, n_tokens long, n_known long, base double, score double, rest array<struct<word:binary,n:bigint>>"
    scored = stash(base.mapInArrow(lambda b: _score(b, words.value, shared.value), schema), "lm-scores")
    rest = scored.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.n").join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    # the pass above has counted these with c = 0
    rest = rest.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"))
    return scored.drop("rest").join(rest, "row", "left").select(
        F.col("id").alias(id_col), held_out("id").alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(vocab.tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
