"""Temperature mixing of sources, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, stash, word_pattern

SECTIONS, LEVELS = 32, 6
BLOCK_ROWS, MAX_BLOCKS = 256, 4096


def word_count(col: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(col), F.lit(word_pattern())), F.lit(0)).cast("long")


def _bisect(totals: DataFrame, passes, grow: bool) -> float:
    """The smallest (grow) or largest exponent in [0, 1] where ``passes(aggregates)`` holds, to 32**-6.

    Each job halves the interval five times at once: one aggregate gives entropy and repetition at 33 exponents.
    """
    lo, hi = 0.0, 1.0
    for _ in range(LEVELS):
        at = [lo + (hi - lo) * k / SECTIONS for k in range(SECTIONS + 1)]
        aggs = []
        for k, a in enumerate(at):
            lw = F.col("logp") * F.lit(a)
            aggs += [F.sum(F.exp(lw)).alias(f"z{k}"), F.sum(F.exp(lw) * lw).alias(f"s{k}"), F.max(lw - F.col("logp")).alias(f"hi{k}"), F.min(lw - F.col("logp")).alias(f"lo{k}")]
        row = totals.agg(*aggs).first()  # a few scalars, whatever the number of sources
        if row["z0"] is None:
            return 1.0
        ok = [passes(row[f"z{k}"], row[f"s{k}"], row[f"lo{k}"], row[f"hi{k}"]) for k in range(SECTIONS + 1)]
        if grow:  # False ... True
            k = next((k for k, x in enumerate(ok) if x), SECTIONS)
            lo, hi = at[max(0, k - 1)], at[k]
            if k == 0:
                return lo
        else:  # True ... False
            k = max([k for k, x in enumerate(ok) if x], default=0)
            if k == SECTIONS:
                return hi
            lo, hi = at[k], at[k + 1]
    return hi if grow else lo


def mixture(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", flatten: float | None = 0.5,
            max_passes: float | None = 2.0, budget: int | None = None, seed: int = 17, keep: list[str] | None = None) -> DataFrame:
    """Mixes sources with weights proportional to (token share) ** a and realises them as passes over shuffled blocks.

    The exponent a in [0, 1] is found by bisection: the largest whose weights have at least the target entropy
    H(1) + flatten * (H(0) - H(1)), raised as far as needed to keep every source within ``max_passes`` passes; the limit wins
    (at a = 1, the raw shares, a limit under one pass for the given budget can't be met and holds only as near as that).
    ``budget`` is in tokens (words); None takes the least budget that gives every source at least one whole pass, so that
    no document is lost. Source s then gets weight * budget tokens: whole passes over all its rows, then a last pass that
    takes whole blocks in permuted order and, of the block in which the budget ends, rows until it is met.

    A block is a hashed set of about 256 rows of a source (4096 blocks at most). Each pass orders blocks by a hash of
    (source, block, pass), rows within by a hash of (id, pass): ``mix_block_key`` and ``mix_row_key`` give that order.

    Returns the kept columns (default: id, source), mix_pass (from 0), n_tokens, mix_block, mix_block_key, mix_row_key,
    mix_weight, mix_passes. A null source is a source of its own. Rows without words cost nothing; a source of only such
    rows has weight 0 and gets one pass. Repeated rows count each; a kept column with the name of an added one is an error. An empty table gives an empty result.
    """
    keep = keep or [id_col, source_col]
    added = {"mix_pass", "n_tokens", "mix_block", "mix_weight", "mix_passes", "mix_block_key", "mix_row_key", "__s", "__i", "__text", "__whole", "__blocks", "__rest", "__tokens"}
    if added & set(keep):
        raise ValueError(f"columns exist already: {sorted(added & set(keep))}")
    src = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    light = stash(docs.select(src.alias("__s"), word_count(text_col).alias("__t"), ident.alias("__i")), "mix-light")
    totals = stash(light.groupBy("__s").agg(F.sum("__t").alias("tokens"), F.count(F.lit(1)).alias("rows")), "mix-totals")
    grand = totals.agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).first()
    total = int(grand["t"] or 0)
    shares = totals.filter("tokens > 0").withColumn("logp", F.log(F.col("tokens") / F.lit(float(max(total, 1)))))
    a = _exponent(shares, total, flatten, max_passes, budget)
    lw = F.col("logp") * F.lit(a)
    norm = shares.agg(F.sum(F.exp(lw)).alias("z"), F.min(lw - F.col("logp")).alias("least")).first()
    z, least = norm["z"] or 1.0, norm["least"] or 0.0
    # passes(s) = weight(s) * budget / tokens(s)
    passes = F.exp(lw - F.col("logp") - F.lit(least)) if budget is None else F.exp(lw - F.col("logp")) / z * (budget / max(total, 1))
    plan = totals.join(shares.select("__s", (F.exp(lw) / z).alias("mix_weight"), passes.alias("mix_passes")), "__s", "left").select(
        "__s",
        F.coalesce("mix_weight", F.lit(0.0)).alias("mix_weight"),
        F.coalesce("mix_passes", F.lit(1.0)).alias("mix_passes"),
        F.floor(F.coalesce("mix_passes", F.lit(1.0)) + 1e-9).cast("int").alias("__whole"),
        F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("rows") / BLOCK_ROWS)).cast("long").alias("__blocks"),
        F.col("tokens").alias("__tokens"),
    ).withColumn("__rest", F.greatest(F.lit(0), F.floor((F.col("mix_passes") - F.col("__whole")) * F.col("__tokens"))).cast("long"))
    plan = stash(plan, "mix-plan")  # a row a source: as a small file, Spark sends it to the rows instead of dealing these by source
    block = lambda: (_hash(F.col("__i"), F.lit(f"block{seed}")) % F.col("__blocks")).alias("mix_block")
    block_key = lambda p: F.md5(F.concat_ws("|", F.col("__s"), F.col("mix_block").cast("string"), p.cast("string"), F.lit(str(seed))))
    row_key = lambda p: F.md5(F.concat_ws("|", F.col("__i"), p.cast("string"), F.lit(str(seed))))
    # the last pass: which blocks fit whole, and where the budget ends
    cols = ["__s", "mix_block", "__whole", "__rest"]
    blocks = light.join(plan, "__s").select("__s", "__whole", "__rest", "__t", block())
    blocks = blocks.groupBy(*cols).agg(F.sum("__t").alias("__bt")).withColumn("__k", block_key(F.col("__whole")))
    upto = Window.partitionBy("__s").orderBy("__k", "mix_block").rowsBetween(Window.unboundedPreceding, 0)  # MAX_BLOCKS rows a source at most
    blocks = stash(blocks.select("__s", "mix_block", "__rest", (F.sum("__bt").over(upto) - F.col("__bt")).alias("__before"), "__bt")
                   .filter("__before < __rest").select("__s", "mix_block", "__before", (F.col("__before") + F.col("__bt") > F.col("__rest")).alias("__cut")), "mix-blocks")
    drop(light)
    rows = docs.select(*keep, src.alias("__s"), F.col(text_col).alias("__text"), ident.alias("__i")).join(plan, "__s").select("*", block())
    # one scan gives every row its whole passes and, where its block fits, the last; another looks at the blocks that are cut
    several = F.sequence(F.lit(0), F.col("__whole") - F.when(F.col("__fits"), 0).otherwise(1))
    fits = blocks.filter("not __cut").select("__s", "mix_block", F.lit(True).alias("__fits"))
    whole = rows.join(fits, ["__s", "mix_block"], "left").withColumn("__fits", F.coalesce("__fits", F.lit(False))).filter("__fits or __whole > 0")
    whole = whole.withColumn("n_tokens", word_count("__text")).withColumn("mix_pass", F.explode(several))
    ending = rows.join(blocks.filter("__cut").select("__s", "mix_block", "__before"), ["__s", "mix_block"]).withColumn("mix_pass", F.col("__whole")).withColumn("n_tokens", word_count("__text"))
    own = Window.partitionBy("__s").orderBy(row_key(F.col("mix_pass")), *[F.col(c) for c in ("__i", "n_tokens")]).rowsBetween(Window.unboundedPreceding, 0)  # one block a source
    ending = ending.withColumn("__at", F.col("__before") + F.sum("n_tokens").over(own) - F.col("n_tokens")).filter("__at < __rest")
    out = [*keep, "mix_pass", "n_tokens", "mix_block", "mix_weight", "mix_passes", "__s", "__i"]
    every = whole.select(*out).unionByName(ending.select(*out))
    every = every.withColumn("mix_block_key", block_key(F.col("mix_pass"))).withColumn("mix_row_key", row_key(F.col("mix_pass")))
    return every.drop("__s", "__i")


def _exponent(shares: DataFrame, total: int, flatten: float | None, max_passes: float | None, budget: int | None) -> float:
    from math import exp, log

    a = 1.0
    if flatten is not None:
        entropy = lambda z, s: log(z) - s / z
        ends = shares.agg(F.sum(F.exp("logp")).alias("z"), F.sum(F.exp("logp") * F.col("logp")).alias("s"), F.count(F.lit(1)).alias("n")).first()
        if not ends["n"]:
            return a
        h1, h0 = entropy(ends["z"], ends["s"]), log(ends["n"])
        goal = h1 + flatten * (h0 - h1)
        a = _bisect(shares, lambda z, s, lo, hi: entropy(z, s) >= goal - 1e-12, grow=False)
    if max_passes is not None:
        if budget is None:
            fits = lambda z, s, lo, hi: exp(hi - lo) <= max_passes + 1e-12
        else:
            fits = lambda z, s, lo, hi: exp(hi) / z * budget / max(total, 1) <= max_passes + 1e-12
        a = max(a, _bisect(shares, fits, grow=True))
    return a


def _hash(*cols: Column) -> Column:
    """48 bits of md5, which SQL engines share, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *cols)), 1, 12), 16, 10).cast("long")
