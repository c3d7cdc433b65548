"""BPE encoding and decoding: a segment tree over the ranks of adjacent pairs."""

from __future__ import annotations

import gc
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import trim

#: The code points with the property White_Space.
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
NONE = np.iinfo(np.int64).max
CACHE = 250_000
SLICE_BYTES = 8 << 20
MARKS = frozenset(".,;:!?")


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the rest from U+0100 on, in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """What encoding and decoding need from a tokenizer file of kind word-end BPE with byte letters."""

    def __init__(self, raw: bytes):
        spec = json.loads(raw)
        model = spec["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ids = model["vocab"]
        self.words = dict(sorted((i, w) for w, i in (ids | self.specials).items()))
        self.letter = [ids[x] for x in byte_letters()]
        self.last = [ids[x + self.end] for x in byte_letters()]
        self.letters, self.lasts = np.array(self.letter, np.int64), np.array(self.last, np.int64)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        key = np.array([(ids[a] << 32) | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)  # by rank
        self.rank_of = dict(zip(key.tolist(), range(len(pairs))))
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split.replace("\\s", SPACE))
        self.spaces = regex.compile(f"[{SPACE}]+")
        self.mark = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or NONE."""
        want = (left << 32) | right
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.ranks[at], NONE)

    def symbols(self, raw: bytes) -> list[int]:
        return [self.letter[b] for b in raw[:-1]] + [self.last[raw[-1]]]


class SegmentTree:
    """One word: leaves hold (rank, position) of the pair that starts there, nodes the least below them."""

    def __init__(self, vocab: Vocabulary, symbols: list[int]):
        self.v, self.sym = vocab, list(symbols)
        n = len(symbols)
        self.next, self.prev = list(range(1, n + 1)), list(range(-1, n - 1))
        self.size = 1 << max(0, n - 1).bit_length()
        self.node = [(NONE, NONE)] * (2 * self.size)
        for i in range(n - 1):
            self.node[self.size + i] = self._pair(i)
        for k in range(self.size - 1, 0, -1):
            self.node[k] = min(self.node[2 * k], self.node[2 * k + 1])

    def _pair(self, i: int):
        j = self.next[i]
        rank = self.v.rank_of.get((self.sym[i] << 32) | self.sym[j]) if j < len(self.sym) else None
        return (NONE, NONE) if rank is None else (rank, i)

    def _put(self, i: int, value) -> None:
        k = self.size + i
        self.node[k] = value
        while k > 1:
            k >>= 1
            self.node[k] = min(self.node[2 * k], self.node[2 * k + 1])

    def merge_all(self) -> list[int]:
        n = len(self.sym)
        while n > 1 and self.node[1][0] != NONE:
            rank, i = self.node[1]
            j = self.next[i]
            self.sym[i] = int(self.v.made[rank])
            self.next[i] = k = self.next[j]
            if k < n:
                self.prev[k] = i
            self._put(j, (NONE, NONE))
            self._put(i, self._pair(i))
            if self.prev[i] >= 0:
                self._put(self.prev[i], self._pair(self.prev[i]))
        out, i = [], 0
        while i < n:
            out.append(self.sym[i])
            i = self.next[i]
        return out


def merge_many(v: Vocabulary, words: list[bytes], size: int) -> tuple[bytes, list[int]]:
    """The same trees, one a row, for many words of up to ``size`` bytes (a power of two): every step merges at each root.

    Returns the ids of all words, packed one after the other, and the bounds of each in bytes.
    """
    n = len(words)
    lens = np.fromiter(map(len, words), np.int64, n)
    sym = np.zeros((n, size + 1), np.int64)
    inside = np.arange(size + 1)[None, :] < lens[:, None]
    raw = np.frombuffer(b"".join(words), np.uint8)
    ids = v.letters[raw]
    ends = np.cumsum(lens) - 1
    ids[ends] = v.lasts[raw[ends]]
    sym[inside] = ids
    nxt = np.tile(np.arange(1, size + 2), (n, 1))
    prv = np.tile(np.arange(-1, size), (n, 1))
    tree = np.full((n, 2 * size), NONE, np.int64)
    rank = np.where(inside[:, 1:], v.pair_ranks(sym[:, :-1], sym[:, 1:]), NONE)
    tree[:, size:] = np.where(rank == NONE, NONE, rank * size + np.arange(size))
    k = size // 2
    while k:
        tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])
        k //= 2
    flat = tree.reshape(-1)
    row = np.flatnonzero(tree[:, 1] != NONE) if size > 1 else np.empty(0, np.int64)

    def put(rows, at, value):
        base, k = rows * (2 * size), at + size
        flat[base + k] = value
        while True:
            k = k >> 1
            if not k[0]:
                break
            flat[base + k] = np.minimum(flat[base + 2 * k], flat[base + 2 * k + 1])

    def pair(rows, at):
        j = nxt[rows, at]
        r = np.where(j < lens[rows], v.pair_ranks(sym[rows, at], sym[rows, np.minimum(j, size)]), NONE)
        return np.where(r == NONE, NONE, r * size + at)

    while len(row):
        top = flat[row * (2 * size) + 1]
        rank, at = top // size, top % size
        gone = nxt[row, at]
        sym[row, at] = v.made[rank]
        after = nxt[row, gone]
        nxt[row, at] = after
        prv[row, np.minimum(after, size)] = at  # column size is a spare
        put(row, gone, NONE)
        put(row, at, pair(row, at))
        before = prv[row, at]
        some = before >= 0
        if some.any():
            r, b = row[some], before[some]
            put(r, b, pair(r, b))
        row = row[flat[row * (2 * size) + 1] != NONE]
    alive = inside.copy()
    alive[:, 0] = lens > 0
    live = np.zeros_like(alive)
    at = np.zeros(n, np.int64)
    rows = np.flatnonzero(lens > 0)
    while len(rows):
        live[rows, at[rows]] = True
        at[rows] = nxt[rows, at[rows]]
        rows = rows[at[rows] < lens[rows]]
    return sym[live].astype("<u4").tobytes(), [0, *(np.cumsum(live.sum(1)) * 4).tolist()]


class Codec:
    """Encodes and decodes texts; keeps the ids of CACHE chunks at most."""

    def __init__(self, raw: bytes):
        self.v = Vocabulary(raw)
        self.kept: dict[str, bytes] = {}

    def _chunks(self, text: str) -> list[str]:
        """What white space parts: pieces never span it."""
        if any(x in text for x in "\x1c\x1d\x1e\x1f"):  # str.split() would part at these too
            return [c for c in self.v.spaces.split(text) if c]
        return text.split()

    def _learn(self, chunks: list[str]) -> None:
        """Adds chunks to the kept ones; all new pieces of a batch go through the trees together."""
        # no rule for a final sigma: the library lowers letter by letter
        normal = unicodedata.normalize("NFC", "\n".join(chunks)).replace("\u03a3", "\u03c3").lower().split("\n")
        pieces: list = [c if c.isalpha() else (c[:-1], c[-1]) if c[-1:] in MARKS and c[:-1].isalpha() else tuple(self.v.pieces.findall(c)) for c in normal]
        done: dict[str, bytes] = {}
        new = {p for p in pieces if isinstance(p, str)}
        new = list(new.union(*[p for p in pieces if not isinstance(p, str)]))
        raws = [p.encode("utf-8", "surrogatepass") for p in new]
        by_size: dict[int, list[int]] = {}
        for i, r in enumerate(raws):
            by_size.setdefault(max(2, 1 << (len(r) - 1).bit_length()), []).append(i)
        for size, at in by_size.items():
            if size > 64:
                for i in at:
                    done[new[i]] = np.array(SegmentTree(self.v, self.v.symbols(raws[i])).merge_all(), "<u4").tobytes()
            else:
                for k in range(0, len(at), 8192):
                    part = at[k : k + 8192]
                    ids, bounds = merge_many(self.v, [raws[i] for i in part], size)
                    for j, i in enumerate(part):
                        done[new[i]] = ids[bounds[j] : bounds[j + 1]]
        for c, ps in zip(chunks, pieces):
            self.kept[c] = done[ps] if isinstance(ps, str) else b"".join([done[p] for p in ps])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. A special token's string is that token."""
        if len(self.kept) > CACHE:
            self.kept.clear()
        parts = []
        for t in texts:
            runs = self.v.mark.split(t) if self.v.mark and "<|" in t else [t]
            parts.append([r if r in self.v.specials else self._chunks(r) for r in runs])
        new = set().union(*[r for p in parts for r in p if not isinstance(r, str)]) - self.kept.keys()
        if new:
            gc.disable()  # strings and bytes only: nothing that a collection could free
            try:
                self._learn(list(new))
            finally:
                gc.enable()
        get = self.kept.__getitem__
        special = {s: np.array([i], "<u4").tobytes() for s, i in self.v.specials.items()}
        return [b"".join([special[r] if isinstance(r, str) else b"".join(map(get, r)) for r in p]) for p in parts]

    def decode(self, ids: bytes) -> str:
        """Tokens with their word ends, parted by single spaces, as a tokenizer without a decoder gives them."""
        return " ".join(map(self.v.words.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_CODECS: dict[int, Codec] = {}


def _codec(raw: bytes) -> Codec:
    """One a worker process, as long as it lives."""
    key = hash(raw)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(raw)
    return _CODECS[key]


def slices(texts: list[str], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of up to ``limit`` characters together, or of one longer text."""
    a = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > limit:
            yield a, i
            a, held = i, 0
        held += len(t)
    if a < len(texts):
        yield a, len(texts)


def bpe_encode(df: DataFrame, vocab_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Adds ``ids_col``, the token ids of each whole text packed as little-endian unsigned 32-bit integers, and, if named,
    ``decoded_col``, those ids decoded again. ``keep``: the columns to keep, all by default.

    Each piece's merges come from a segment tree over the ranks of its adjacent pairs: the root is the leftmost pair of
    the lowest rank, and a merge changes three leaves, in logarithmic time, until no pair is left that can be merged. Words
    up to 64 bytes go through many trees at once in numpy; longer ones have a tree each.

    The vocabulary is read on the driver and broadcast: its size is that of the file, whatever the data. A null text counts
    as empty and has no ids; other columns, nulls and repeated rows pass as they are; a kept column that has the name of an
    added one is an error. No shuffle; a task holds one Arrow batch.
    """
    keep = df.columns if keep is None else keep
    clash = {ids_col, decoded_col} & set(keep)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    with open(vocab_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    data = df.select(*[F.col(c) for c in keep], F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    kept = data.drop("__text")
    more = [(ids_col, "binary")] + ([(decoded_col, "string")] if decoded_col else [])
    schema = kept.schema
    for name, kind in more:
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            for lo, hi in slices(texts):
                ids = codec.encode_batch(texts[lo:hi])
                cols = [c.slice(lo, hi - lo) for c in b.columns[:-1]] + [pa.array(ids, pa.binary())]
                if decoded_col:
                    cols.append(pa.array([codec.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names[:-1], *[n for n, _ in more]])
        if len(codec.kept) > CACHE // 2:
            codec.kept.clear()  # workers outlive tasks
        trim()

    return data.mapInArrow(run, schema)


def bpe_decode(df: DataFrame, vocab_path: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """Adds the text of packed ids; null ids give a null text."""
    with open(vocab_path, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())
    schema = StructType(list(df.schema.fields)).add(decoded_col, "string")  # add() changes what it is called on
    at = df.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for b in batches:
            texts = [None if x is None else codec.decode(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, decoded_col])

    return df.mapInArrow(run, schema)


def bpe_digests(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256, from bpe_encode's real outputs."""
    out = bpe_encode(docs, vocab_path, text_col, "ids", "decoded", keep=[id_col])
    return out.select(
        id_col, F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2(F.col("ids"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
