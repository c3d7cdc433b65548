"""Quality by weak supervision: rules vote or abstain, and their accuracies are estimated without labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .common import stash

#: The symbols counted, the window of the repeat count, and the base limits.
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_alpha_words", "n_stutter"]
SPACE = b" \t\n\x0b\x0c\r"


def repeat_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` words found at least twice in the text, every find included."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    base = int(ids.max()) + 1
    if base**window < 1 << 63:
        key = np.zeros(n, np.int64)
        for k in range(window):
            key = key * base + ids[k : k + n]
        _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    else:  # pairs, then pairs of pairs: exact ids of windows, no hashes
        level, width = ids.astype(np.int64), 1
        while width < window:
            step = min(width, window - width)
            a, b = level[: len(level) - step], level[step:]
            _, level = np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)
            width += step
        _, back, times = np.unique(level, return_inverse=True, return_counts=True)
    found = (times[back] > 1).astype(np.int64)
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[:n] += found
    edge[window : window + n] -= found
    return int((np.cumsum(edge)[:-1] > 0).sum())


def counts_of(text: str) -> tuple[int, ...]:
    """COUNTS of one whole text. Words are runs of anything but the six ASCII spaces; lines are parted by \\n."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return (0, 0, sum(map(text.count, SYMBOLS)), 0, 0, 0, 0, 0, 0)
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    seen = len(set(lines))
    alpha = [w.decode("utf-8", "surrogatepass").strip(".,;:!?\"'()").isalpha() for w in index]
    return (
        n, len(text) - sum(map(text.count, " \t\n\x0b\x0c\r")), sum(map(text.count, SYMBOLS)), len(lines) - seen, repeat_words(ids),
        len(lines), len(index), int(np.asarray(alpha)[ids].sum()), int((ids[1:] == ids[:-1]).sum()),
    )


#: The rules: name, and an SQL expression of a vote: 1 for quality, -1 against, 0 to abstain.
RULES = {
    "length": "CASE WHEN n_words < 20 THEN -1 WHEN n_words >= 50 AND n_words <= 100000 THEN 1 ELSE 0 END",
    "word_length": "CASE WHEN word_chars < 3 * n_words OR word_chars > 12 * n_words THEN -1 WHEN word_chars >= 3.5 * n_words AND word_chars <= 10 * n_words THEN 1 ELSE 0 END",
    "symbols": "CASE WHEN 10 * n_symbols > n_words THEN -1 WHEN 100 * n_symbols <= n_words THEN 1 ELSE 0 END",
    "lines": "CASE WHEN 2 * n_dup_lines > n_lines THEN -1 WHEN 10 * n_dup_lines <= n_lines THEN 1 ELSE 0 END",
    "repeats": "CASE WHEN 10 * n_repeat_words > n_words THEN -1 WHEN 100 * n_repeat_words <= 5 * n_words THEN 1 ELSE 0 END",
    "letters": "CASE WHEN 10 * n_alpha_words < 7 * n_words THEN -1 WHEN 10 * n_alpha_words >= 8.5 * n_words THEN 1 ELSE 0 END",
    "variety": "CASE WHEN n_words >= 30 AND 10 * n_distinct < 2 * sqrt(30.0 * n_words) THEN -1 WHEN n_words >= 30 AND 10 * n_distinct >= 5 * sqrt(30.0 * n_words) THEN 1 ELSE 0 END",
    "stutter": "CASE WHEN 5 * n_stutter > n_words THEN -1 WHEN 20 * n_stutter <= n_words THEN 1 ELSE 0 END",
}

#: Pseudo-votes before any is seen: of each rule, right and wrong ones on texts of quality and on poor ones; good and poor texts.
RIGHT, WRONG, BALANCE = (8.0, 2.0), (2.0, 2.0), (4.0, 1.0)


def estimate(votes: np.ndarray, times: np.ndarray, rounds: int = 500, tol: float = 1e-10) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns, with one latent variable, quality, given which rules vote independently.

    votes: patterns x rules in {-1, 0, 1}; times: documents of each pattern. Returns the share of quality, the accuracy of
    each rule on texts of quality and on poor ones (2 x rules: the chance that a vote cast is right), and each pattern's
    posterior chance of quality. It starts from the majority of the votes cast; whether a rule abstains says nothing.
    """
    yes, no = (votes == 1).astype(float), (votes == -1).astype(float)
    post = (yes.sum(1) + 1) / (yes.sum(1) + no.sum(1) + 2)
    prior = np.array([RIGHT, WRONG])  # [right, wrong] x [quality, poor]
    last = -np.inf
    share, accuracy = 0.5, np.full((2, votes.shape[1]), 0.5)
    for _ in range(rounds):
        good, poor = post * times, (1 - post) * times
        right = np.stack([good @ yes, poor @ no]) + np.array(RIGHT)[:, None]
        wrong = np.stack([good @ no, poor @ yes]) + np.array(WRONG)[:, None]
        accuracy = right / (right + wrong)
        share = (good.sum() + BALANCE[0]) / (times.sum() + sum(BALANCE))
        log_good = np.log(share) + yes @ np.log(accuracy[0]) + no @ np.log(1 - accuracy[0])
        log_poor = np.log(1 - share) + no @ np.log(accuracy[1]) + yes @ np.log(1 - accuracy[1])
        both = np.logaddexp(log_good, log_poor)
        post = np.exp(log_good - both)
        now = float(times @ both + prior[0] @ np.log(accuracy).sum(1) + prior[1] @ np.log(1 - accuracy).sum(1) + BALANCE[0] * np.log(share) + BALANCE[1] * np.log(1 - share))
        if now - last < tol * max(1.0, abs(now)):
            break
        last = now
    return float(share), accuracy, post


def quality_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and COUNTS of each whole text; a null text has no words."""
    data = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    schema = data.drop("__text").schema
    for c in COUNTS:
        schema = schema.add(c, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in slices(texts):
                rows = np.array([counts_of(t) for t in texts[lo:hi]], np.int64).reshape(-1, len(COUNTS))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *[pa.array(rows[:, k]) for k in range(len(COUNTS))]], names=[id_col, *COUNTS])

    return data.mapInArrow(run, schema)


def weak_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, rules: dict[str, str] = RULES) -> DataFrame:
    """Verdict on each document from rules of unknown accuracy: posterior chance of quality and ``kept``.

    Each rule votes for or against or abstains. Only the counts of vote patterns (3 ** rules at most) reach the driver,
    where expectation-maximisation estimates every rule's accuracy from agreement alone, over all documents, starting from
    the majority of votes; a vote weighs by its rule's accuracies, so one vote against a text can be outvoted. The
    posteriors go back as a table of those patterns; a document whose posterior is the threshold is kept. ``base_failed`` (fewer than 10 words, or over 20 % of the words in
    repeated 5-word windows) is a plain limit: such documents aren't kept whatever the votes.

    Returns id, COUNTS, base_failed, the votes (vote_<rule>), posterior, kept. Null texts count as empty ones and fail
    the base; null ids and repeated rows are rows like others; an empty table gives none.
    """
    base = F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")
    names = [f"vote_{r}" for r in rules]
    table = quality_features(docs, id_col, text_col).withColumn("base_failed", base)
    table = stash(table.withColumns({f"vote_{r}": F.expr(e).cast("int") for r, e in rules.items()}), "quality")
    patterns = table.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()  # 3 ** len(rules) rows at most
    if not patterns:
        return table.withColumn("posterior", F.lit(0.0)).withColumn("kept", F.lit(False))
    patterns.sort()
    votes = np.array([[r[c] for c in names] for r in patterns], np.int64)
    _, _, post = estimate(votes, np.array([r["n"] for r in patterns], float))
    spark = docs.sparkSession
    known = spark.createDataFrame([(*map(int, v), float(p)) for v, p in zip(votes, post)], ", ".join(f"{c} int" for c in names) + ", posterior double")
    out = table.join(F.broadcast(known), names)  # bounded as the patterns are
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold)).select(id_col, *COUNTS, "base_failed", *names, "posterior", "kept")
