"""Toxicity: a learned lexicon, matched through Levenshtein automata over its trie, weighed by context windows."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import drop, stash, trim, trimmed

#: Bounds of the labelled rows that are learned from; parameters of toxicity_model.
MAX_TOXIC, MAX_CLEAN = 4000, 24000
#: Lengths of the openings of words that can be terms; toxic texts that must hold a term; natural words near a term that it bears.
PREFIXES = (4, 5, 6, 7, 8)
MIN_TEXTS, MAX_AROUND = 3, 2
BUCKETS = 64
WORD_CACHE = 150_000
STEPS, ITEMS = 200_000, 400_000
EDGES = "".join(map(chr, range(33, 48))) + ":;<=>?@[\\]^_`{|}~‘’“”„«»…¿¡"
#: Marks of quotation, and words that report what others say.
OPENING, CLOSING = frozenset("\"'“‘„«"), frozenset("\"'”’“»")
REPORTING = frozenset("said says saying called calls calling wrote writes quote quoted quoting word words term slur insult dit sagte dijo".split())
REPORT_WINDOW, QUOTE_WINDOW = 3, 8
QUOTED, MISSPELT = 0.25, 0.6
_RUNS = re.compile(r"(.)\1{2,}")


def edits_allowed(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 12 else 2


class LexiconAutomaton:
    """The Levenshtein automata of all terms run against their common trie at once, made deterministic as words need it.

    A state is the set of (trie node, edits so far, transposed letter or '') that the letters read may have led to; a step
    matches, replaces, inserts, drops or swaps letters. States and steps are kept, so that most words cost a few lookups
    until they reach the empty state.
    """

    def __init__(self, terms: dict[str, float], prefixes: dict[str, float], fuzzy: set[str]):
        self.kids: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.prefix: list[str | None] = [None]
        self.room = [0]
        for word, is_prefix in [*((t, False) for t in sorted(terms)), *((t, True) for t in sorted(prefixes))]:
            n, path = 0, [0]
            for c in word:
                if c not in self.kids[n]:
                    self.kids[n][c] = len(self.kids)
                    self.kids.append({})
                    self.term.append(None)
                    self.prefix.append(None)
                    self.room.append(0)
                n = self.kids[n][c]
                path.append(n)
            if is_prefix:
                self.prefix[n] = word
            else:
                self.term[n] = word
                if word in fuzzy:
                    for p in path:
                        self.room[p] = max(self.room[p], edits_allowed(word))
        self.allowed = {t: edits_allowed(t) if t in fuzzy else 0 for t in terms}
        self._forget()

    def _forget(self) -> None:
        self.steps: dict[tuple[int, str], int] = {}
        self.sets: list[frozenset] = []
        self.known: dict[frozenset, int] = {}
        self.held = 0  # items of all states
        self.dead = self._state(set())
        self.start = self._state({(0, 0, "")})

    def _state(self, items: set) -> int:
        todo, full = list(items), set()
        while todo:  # dropped letters: a term's letter that the word lacks
            n, e, swap = x = todo.pop()
            if x in full or e > self.room[n]:
                continue
            full.add(x)
            if not swap:
                todo += [(k, e + 1, "") for k in self.kids[n].values()]
        key = frozenset(full)
        if key not in self.known:
            self.known[key] = len(self.sets)
            self.sets.append(key)
            self.held += len(key)
        return self.known[key]

    def _step(self, s: int, c: str) -> int:
        out = set()
        for n, e, swap in self.sets[s]:
            if swap:  # the second letter of a swapped pair
                if c == swap:
                    out.add((n, e, ""))
                continue
            if c in self.kids[n]:
                out.add((self.kids[n][c], e, ""))
            if e < self.room[n]:
                out.add((n, e + 1, ""))
                for x, k in self.kids[n].items():
                    out.add((k, e + 1, ""))
                    if c in self.kids[k]:
                        out.add((self.kids[k][c], e + 1, x))
        return self._state(out)

    def find(self, word: str) -> tuple[str, int] | None:
        """The term that the word is, begins with (then with 0 edits), or is nearest to within its edits; None if none is."""
        s, n = self.start, 0
        for c in word:
            if n >= 0:
                n = self.kids[n].get(c, -1)
                if n >= 0 and self.prefix[n] is not None:
                    return self.prefix[n] + "*", 0
            t = self.steps.get((s, c))
            if t is None:
                if len(self.steps) > STEPS or self.held > ITEMS:  # keeps memory bounded
                    self._forget()
                    return self.find(word)
                t = self.steps[s, c] = self._step(s, c)
            s = t
            if s == self.dead and n < 0:
                return None
        if n >= 0 and self.term[n] is not None:
            return self.term[n], 0
        near = [(e, self.term[m]) for m, e, swap in self.sets[s] if not swap and self.term[m] is not None and e <= self.allowed[self.term[m]]]
        return (lambda b: (b[1], b[0]))(min(near)) if near else None


def bare(token: str) -> str:
    """A token without marks at its ends, with no letter more than twice in a row."""
    w = token.strip(EDGES)
    return _RUNS.sub(r"\1\1", w) if len(w) > 4 else w


@dataclass
class ToxicityModel:
    """What scoring needs; bounded by the labelled rows learned from, whatever the corpus."""

    terms: dict[str, float] = field(default_factory=dict)
    prefixes: dict[str, float] = field(default_factory=dict)
    fuzzy: set[str] = field(default_factory=set)
    exceptions: set[str] = field(default_factory=set)
    coef: list[float] = field(default_factory=lambda: [-20.0, 0.0])

    def __post_init__(self):
        self._auto, self._kept = None, {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("_auto", "_kept")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def forget(self) -> None:
        """Drops what was kept for speed: workers outlive their tasks."""
        self._auto, self._kept = None, {}

    def match(self, token: str) -> tuple[float, bool] | None:
        """(weight, misspelt) of a lower-case token, or None."""
        got = self._kept.get(token, 0)
        if got != 0:
            return got
        if self._auto is None:
            self._auto = LexiconAutomaton(self.terms, self.prefixes, self.fuzzy)
        if len(self._kept) > WORD_CACHE:
            self._kept.clear()
        word, out = bare(token), None
        hit = self._auto.find(word) if word else None
        if hit and not (hit[1] and word in self.exceptions):
            term, e = hit
            out = (self.prefixes[term[:-1]] if term.endswith("*") else self.terms[term], e > 0)
        self._kept[token] = out
        return out

    def evidence(self, text: str) -> float:
        """Summed weight of the hits of a whole text. A hit weighs less if misspelt, and less if it
        stands within quotation marks or next to a word that reports speech."""
        tokens = text.lower().split()
        kept, match = self._kept, self.match  # match() may clear kept, but doesn't replace it
        hits = [i for i, t in enumerate(tokens) if (kept[t] if t in kept else match(t)) is not None]
        total = 0.0
        for i in hits:
            weight, off = match(tokens[i])
            total += weight * (MISSPELT if off else 1.0) * (QUOTED if quoted(tokens, i) else 1.0)
        return total

    def feature(self, text: str) -> float:
        return math.log1p(self.evidence(text))

    def score(self, text: str) -> float:
        z = self.coef[0] + self.coef[1] * self.feature(text)
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def quoted(tokens: list[str], i: int) -> bool:
    """Whether the word at i stands in a quotation: marks open before and close after it nearby, or a report word is near."""
    near = range(max(0, i - REPORT_WINDOW), min(len(tokens), i + REPORT_WINDOW + 1))
    if any(j != i and tokens[j].strip(EDGES) in REPORTING for j in near):
        return True
    opens = next((j for j in range(i, max(-1, i - QUOTE_WINDOW), -1) if tokens[j][0] in OPENING), None)
    if opens is None:
        return False
    if any(tokens[j].rstrip(".,;:!?")[-1:] in CLOSING for j in range(opens, i) if len(tokens[j]) > 1):
        return False  # closed before
    return any(tokens[j].rstrip(".,;:!?")[-1:] in CLOSING and len(tokens[j]) > 1 for j in range(i, min(len(tokens), i + QUOTE_WINDOW)))


@trimmed
def _settings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their settings (hashes of the neighbouring words) with the text's label, dealt to buckets by word."""
    for b in batches:
        texts, toxic = b.column(0).to_pylist(), b.column(1).to_pylist()
        for lo, hi in slices(texts, 1 << 20):
            index: dict[str, int] = {}
            ids, settings, labels = [], [], []
            for t, x in zip(texts[lo:hi], toxic[lo:hi]):
                words = [bare(w) for w in t.lower().split()]
                around = ["", *words, ""]
                kept = [i for i, w in enumerate(words) if len(w) >= 3]
                ids += [index.setdefault(words[i], len(index)) for i in kept]
                settings += [xxhash.xxh3_64_intdigest(f"{around[i]}\x00{around[i + 2]}".encode("utf-8", "surrogatepass")) for i in kept]
                labels += [x] * len(kept)
            if not ids:
                continue
            names = np.array(list(index), object)
            own = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) % BUCKETS for w in names), np.int64, len(names))
            i, s, x = np.array(ids), np.array(settings, np.uint64), np.array(labels, np.uint8)
            rows = []
            for k in np.unique(own):
                at = np.flatnonzero(own[i] == k)
                here, which = np.unique(i[at], return_inverse=True)
                rows.append((int(k), names[here].tolist(), which.astype("<u4").tobytes(), s[at].tobytes(), x[at].tobytes()))
            kinds = pa.int32(), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["bucket", "words", "which", "settings", "labels"])


@trimmed
def _count_settings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word: its distinct settings in toxic and in clean texts. A bucket holds its share of the bounded sample."""
    index: dict[str, int] = {}
    ids, settings, labels = [], [], []
    for b in batches:
        for words, which, s, x in zip(*[b.column(k).to_pylist() for k in range(1, 5)]):
            own = np.array([index.setdefault(w, len(index)) for w in words], np.int64)
            ids.append(own[np.frombuffer(which, "<u4")])
            settings.append(np.frombuffer(s, np.uint64))
            labels.append(np.frombuffer(x, np.uint8))
    if not ids:
        return
    i, s, x = np.concatenate(ids), np.concatenate(settings), np.concatenate(labels)
    order = np.lexsort((x, s, i))
    i, s, x = i[order], s[order], x[order]
    new = np.concatenate(([True], (i[1:] != i[:-1]) | (s[1:] != s[:-1]) | (x[1:] != x[:-1])))
    counts = [np.bincount(i[new & (x == k)], minlength=len(index)) for k in (1, 0)]
    yield pa.RecordBatch.from_arrays([pa.array(list(index), pa.string()), pa.array(counts[0]), pa.array(counts[1])], names=["word", "a", "c"])


@trimmed
def _toxic_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many of the texts each word, and each opening (marked *), occurs."""
    for b in batches:
        n: Counter = Counter()
        for t in b.column(0).to_pylist():
            words = {w for w in map(bare, set(t.lower().split())) if len(w) >= 3}
            n.update(words)
            n.update({w[:p] + "*" for w in words for p in PREFIXES if len(w) > p})
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["term", "d"])


def _fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> list[float]:
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(a.shape[1])
    penalty = np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        g = a.T @ (y - p) - penalty @ w
        h = (a * (p * (1 - p))[:, None]).T @ a + penalty
        step = np.linalg.solve(h, g)
        w += step / max(1.0, float(np.abs(step).max()) / 5)
        if np.abs(step).max() < 1e-8:
            break
    return [float(v) for v in w]


def _near(batches: Iterator[pa.RecordBatch], terms: dict, prefixes: dict, fuzzy: frozenset) -> Iterator[pa.RecordBatch]:
    """Of natural words, those that would count as a misspelt term, and which."""
    auto = LexiconAutomaton(terms, prefixes, set(fuzzy))
    for b in batches:
        found = [(w, hit[0]) for w in b.column(0).to_pylist() if (hit := auto.find(w)) and hit[1]]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], names=["word", "near"])
    del auto
    trim()


def held_out(id_col: str, mod: int, rest: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(mod)) == rest, F.lit(False))


def toxicity_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                   max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> ToxicityModel:
    """Learns from labelled rows only, those with crc32(id) mod 3 other than 1, and of these from ``max_toxic`` toxic and
    ``max_clean`` clean ones at most, in hashed order; equal texts with one label count once. The model depends on those
    rows alone, not on how they are dealt to tasks.

    A word counts by its distinct settings (the words beside it), so that copied passages count once; an opening of words
    has the sum of its words. The lexicon: words, and openings that stand for several words, that occur in MIN_TEXTS toxic
    texts or more, nine times in ten in toxic ones, and too often so for chance. Misspellings of a term count unless more
    than MAX_AROUND words of clean texts lie around it, and never those words themselves.
    """
    known = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col, 3, 1)).groupBy(id_col).agg(F.max(F.col(label_col).cast("int")).alias("__x"))
    order = F.xxhash64(id_col)
    some = known.filter("__x = 1").orderBy(order, id_col).limit(max_toxic).unionByName(known.filter("__x = 0").orderBy(order, id_col).limit(max_clean))
    text = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    sample = text.join(F.broadcast(some), id_col).select("__text", "__x")  # max_toxic + max_clean ids at most
    sample = stash(sample.groupBy(F.xxhash64("__text").alias("h"), "__x").agg(F.first("__text").alias("__text")).select("__text", "__x").repartition(32), "toxic-sample")
    sizes = {r["__x"]: r["t"] for r in sample.groupBy("__x").agg(F.sum(F.length("__text")).alias("t")).collect()}
    if 1 not in sizes:
        drop(sample)
        return ToxicityModel()
    share = max(1, sizes[1]) / max(1, sum(sizes.values()))
    words = sample.mapInArrow(_settings, "bucket int, words array<string>, which binary, settings binary, labels binary").repartition(BUCKETS, "bucket")
    words = stash(words.mapInArrow(_count_settings, "word string, a long, c long"), "toxic-words")
    opening = F.explode(F.filter(F.array(*[F.when(F.length("word") > p, F.concat(F.substring("word", 1, p), F.lit("*"))) for p in PREFIXES]), lambda x: x.isNotNull()))
    openings = words.select(opening.alias("term"), "a", "c").groupBy("term").agg(F.sum("a").alias("a"), F.sum("c").alias("c"), F.max("a").alias("most"))
    counts = words.select(F.col("word").alias("term"), "a", "c", F.lit(0).cast("long").alias("most")).unionByName(openings)
    n = F.col("a") + F.col("c")
    gain = 2 * (F.col("a") * F.log(F.col("a") / (n * share)) + F.when(F.col("c") > 0, F.col("c") * F.log(F.col("c") / (n * (1 - share + 1e-9)))).otherwise(0))
    texts = sample.filter("__x = 1").select("__text").mapInArrow(_toxic_texts, "term string, d long").groupBy("term").agg(F.sum("d").alias("d")).filter(F.col("d") >= MIN_TEXTS)
    best = counts.filter("a > 0 and a >= 9 * c").filter(gain >= 20).join(texts, "term").select("term", "a", "c", "most").collect()  # of max_toxic texts
    weight = {r["term"]: min(8.0, math.log((r["a"] + 0.5) / (r["c"] + 0.5) * (1 - share + 1e-9) / share)) for r in sorted(best)}
    terms = {t: w for t, w in weight.items() if not t.endswith("*")}
    prefixes = {r["term"][:-1]: weight[r["term"]] for r in sorted(best) if r["term"].endswith("*") and r["a"] >= 2 * r["most"]}  # not one word's own opening
    # terms with many natural words around them are matched as they are, until no other term takes over such words
    fuzzy, clean = {t for t in terms if edits_allowed(t)}, words.filter("c > 0").select("word")
    while True:
        near = clean.mapInArrow(lambda b, f=frozenset(fuzzy): _near(b, terms, prefixes, f), "word string, near string")
        around = near.groupBy("near").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) <= MAX_AROUND, F.array_sort(F.collect_set("word"))).alias("words")).collect()  # a row a term at most
        gone = {r["near"] for r in around if r["n"] > MAX_AROUND}
        fuzzy -= gone
        if not gone:
            break
    drop(words)
    model = ToxicityModel(terms, prefixes, fuzzy, {w for r in around for w in r["words"]})

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([model.feature(t) for t in b.column(0).to_pylist()], pa.float64())], names=["x", "f"])

    rows = sample.mapInArrow(features, "x int, f double").groupBy("x", "f").agg(F.count(F.lit(1)).alias("n")).collect()  # the sample's size at most
    drop(sample)
    rows.sort()
    x = np.repeat(np.array([[r["f"]] for r in rows]), [r["n"] for r in rows], axis=0)
    y = np.repeat(np.array([float(r["x"]) for r in rows]), [r["n"] for r in rows])
    model.coef = _fit_logistic(x, y)
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Adds the score of each whole text, from its words alone; a null text counts as empty. No shuffle."""
    keep = docs.columns if keep is None else keep
    if score_col in keep:
        raise ValueError(f"column exists already: {score_col}")
    data = docs.select(*[F.col(c) for c in keep], F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    schema = data.drop("__text").schema.add(score_col, "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded, see ToxicityModel

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            scores = [m.score(t.as_py()) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64())], names=[*b.schema.names[:-1], score_col])
        m.forget()
        trim()

    return data.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """Per row of docs: id, held_out (crc32 of the id mod 3 is 1: never learned from), score in [0, 1], predicted.

    Repeated rows and null ids are scored like others; null texts as empty ones; without toxic labels scores are near 0.
    """
    model = toxicity_model(docs, labels, id_col, text_col, label_col)
    out = score_toxicity(docs, model, text_col, "score", keep=[id_col])
    return out.select(id_col, held_out(id_col, 3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
