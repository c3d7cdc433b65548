"""Sharding by balanced label propagation, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, ranked, stash

CELLS = 256


def balanced_shards(docs: DataFrame, shards: int = 8, rounds: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deals every row of docs to one of ``shards`` shards whose row counts are at most one apart (law ``rows``).

    Rows with equal texts are linked. Rows start dealt round robin in hashed order, so counts are even from the start. In
    each round linked rows ask for the shard where most of their neighbours are (ties by a hash of text and shard); a
    move from i to j is granted only against a move from j to i: that of another linked row or of an unlinked one, which
    gains and loses nothing. So counts never change, and cut links fall from round to round. A shard that was asked for and
    had no place left is closed: its rows stay, and the rest of their groups then gather in the best of the other shards.
    So a group larger than a shard fills one after the other. It ends when nobody asks, or when every shard that is asked
    for is closed (``rounds``: or after so many; by default two a shard, which is enough for a group in all of them).

    Returns id, size (UTF-8 bytes + 1; a null text counts as no bytes), text_crc32 (of no bytes for a null text), law,
    shard, slot (gapless from 0 in each shard), grown_shard (null under this law) and group_rows, one row per input row:
    repeated rows and null ids are rows like others; null texts are linked with empty ones. An empty table gives none.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = stash(
        docs.select(
            F.col(id_col).alias("__id"),
            F.monotonically_increasing_id().alias("__rid"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.md5(text.cast("binary"))).alias("__th"),
        ),
        "shard-base",
    )
    groups = base.groupBy("__th").agg(F.count(F.lit(1)).alias("group_rows")).filter("group_rows > 1")
    cell = F.pmod(F.xxhash64("__rid", F.lit(7)), F.lit(CELLS)).cast("int")
    one = base.select("__rid", "__th", F.lit(0).alias("__all"))
    first = ranked(one, ["__all"], [F.col("__rid")], cell, CELLS, "__r")
    state = stash(
        first.join(groups, "__th", "left").select(
            "__rid", "__th", F.coalesce("group_rows", F.lit(1)).alias("group_rows"), F.pmod("__r", F.lit(shards)).cast("int").alias("shard")
        ),
        "shard-state",
    )
    closed: set[int] = set()
    for _ in range(2 * shards if rounds is None else rounds):
        new, full = _round(state, shards, closed)
        closed |= full
        if new is not None:
            after = stash(new, "shard-state")
            drop(state)
            state = after
        elif not full:
            break
    slots = ranked(state.select("__rid", "group_rows", "shard"), ["shard"], [F.col("__rid")], cell, CELLS, "slot")
    return base.join(slots, "__rid").select(
        F.col("__id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_rows",
    )


def _round(state: DataFrame, shards: int, closed: set[int]) -> tuple[DataFrame | None, set[int]]:
    """One round of asking, quotas and moves among the shards that aren't closed: (the new state, or None when no row moves;
    the shards that were asked for and had no place)."""
    linked = state.filter("group_rows > 1")
    if closed:
        linked = linked.filter(~F.col("shard").isin(sorted(closed)))
    votes = linked.groupBy("__th", "shard").agg(F.count(F.lit(1)).alias("n"))
    wish = votes.groupBy("__th").agg(F.max(F.struct("n", F.xxhash64("__th", "shard").alias("h"), "shard")).alias("w")).select("__th", F.col("w.shard").alias("to"))
    movers = stash(linked.join(wish, "__th").filter("shard <> to").select("__rid", "__th", "shard", "to"), "shard-movers")
    asked = {(r["shard"], r["to"]): r["n"] for r in movers.groupBy("shard", "to").agg(F.count(F.lit(1)).alias("n")).collect()}  # shards**2 rows at most
    if not asked:
        drop(movers)
        return None, set()
    free = {r["shard"]: r["n"] for r in state.filter("group_rows = 1").groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    granted, fill = {}, {}
    for (i, j), n in sorted(asked.items()):
        back = asked.get((j, i), 0)
        extra = min(max(0, n - back), free.get(j, 0))
        free[j] = free.get(j, 0) - extra
        granted[i, j] = min(n, back + extra)
        if extra:
            fill[j, i] = extra
    full = {j for _, j in asked} - {j for (_, j), n in granted.items() if n}
    if not any(granted.values()):
        drop(movers)
        return None, full
    # linked rows: in the order of their texts, so that a group moves whole where the quota ends within the queue
    cell = (F.pmod(F.xxhash64("__th", F.lit(3)), F.lit(CELLS // 16)) * 16 + F.pmod(F.xxhash64("__rid", F.lit(5)), F.lit(16))).cast("int")
    limit = _table([(i, j, n) for (i, j), n in granted.items()])
    queue = ranked(movers, ["shard", "to"], [F.col("__th"), F.col("__rid")], cell, CELLS, "__r")
    moved = queue.filter(F.col("__r") < limit(F.col("shard"), F.col("to"))).select("__rid", "to")
    if fill:
        spans, at = [], {}
        for (j, i), n in sorted(fill.items()):
            spans.append((j, i, at.get(j, 0), at.get(j, 0) + n))
            at[j] = at.get(j, 0) + n
        spare = state.filter(F.col("group_rows") == 1).filter(F.col("shard").isin(sorted(at))).select("__rid", "shard")
        line = ranked(spare, ["shard"], [F.col("__rid")], F.pmod(F.xxhash64("__rid", F.lit(11)), F.lit(CELLS)).cast("int"), CELLS, "__r")
        to = F.lit(None).cast("int")
        for j, i, lo, hi in spans:
            to = F.when((F.col("shard") == j) & (F.col("__r") >= lo) & (F.col("__r") < hi), F.lit(i)).otherwise(to)
        moved = moved.unionByName(line.select("__rid", to.alias("to")).filter("to is not null"))
    return state.join(moved, "__rid", "left").select("__rid", "__th", "group_rows", F.coalesce("to", "shard").alias("shard")), full


def _table(rows: list[tuple[int, int, int]]):
    """A lookup (i, j) -> n as an expression over a literal map of shards**2 entries at most."""
    entries = [x for i, j, n in rows for x in (F.lit(f"{i}:{j}"), F.lit(int(n)).cast("long"))]
    table = F.create_map(*entries)
    return lambda i, j: F.coalesce(F.try_element_at(table, F.concat_ws(":", i.cast("string"), j.cast("string"))), F.lit(0))
