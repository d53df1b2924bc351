"""Filling fixed-capacity containers with items (problem 8): sum-of-squares packing.

An item goes where the sum, over all gaps, of the squared number of open containers with that gap
becomes smallest; a new container counts like any other place, and of equal gaps no more count than
there are items to come that they can take. Items larger than the capacity fill
containers of their own and leave a rest, which is an item.

Items are hashed into blocks of about ``BLOCK`` items; each block is packed on its own from a
histogram of open containers by gap, so a worker holds one block's sizes and nothing grows with the
corpus. After each round a block settles its containers and hands on only the emptiest of those
that could still take its smallest item, holding at most one in ``SHRINK`` of its items. What is
handed on is pooled with that of other blocks and packed again, in blocks of the same size, until
one block is left. So whatever the sizes are, the pool shrinks by ``SHRINK`` a round, no group
holds more than about ``BLOCK`` items, and little room is lost at the seams. Items and their hashes
are cut into the checkpoint folder first, so a lost executor cannot change what is in a block.

Hashes come from the rows alone, so the same rows give the same containers however they are
partitioned. Repeated rows are counted before they are hashed and handed out in parts of at most
``COPIES``, so a row repeated very often is spread over blocks like any others.

Defined cases: items of size null, zero or less take no room and do not come out; repeated ids are
items of their own; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

#: Items in a block, the share of them that a round may hand on, copies of a row in one part.
BLOCK, SHRINK, COPIES = 20_000, 16, 64
_STEP = 0x9E3779B97F4A7C15  # any odd number: copies of a row get hashes of their own


def sum_of_squares(sizes: np.ndarray, capacity: int, ahead: bool = False) -> np.ndarray:
    """The container number of each item, 0 < size <= capacity, in the order given.

    ``ahead``: the sizes to come are known, so of the open containers with a gap no more count than
    there are items to come that such a gap can take. Gaps that nothing will fill then cost nothing,
    as a full container does, and sizes that never fill a container to the brim do no harm.
    """
    counts = np.zeros(capacity + 1, np.int64)  # by gap, of open containers; full and empty ones don't count
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, made, n = np.empty(len(sizes), np.int64), 0, len(sizes)
    # An upper bound of the items to come by the gap they fit into; exact when large items come first.
    fit = np.cumsum(np.bincount(sizes, minlength=capacity + 1)) if ahead else np.full(capacity + 1, n + 1)
    fit[0] = 0
    never = np.iinfo(np.int64).max
    for i, s in enumerate(sizes):
        room = np.minimum(fit, n - i - 1) if ahead else fit
        more = np.where(counts < room, 2 * counts + 1, 0)  # what one more container with a gap adds to the sum
        here = counts[s:capacity]
        less = np.where(here <= room[s:capacity], 2 * here - 1, 0)  # what one fewer takes off it
        cost = np.where(here > 0, more[: capacity - s] - less, never)
        best = int(cost.argmin()) if len(cost) else -1
        if best >= 0 and cost[best] != never and cost[best] <= more[capacity - s]:
            gap = best + s
            k = stacks[gap].pop()
            counts[gap] -= 1
        else:
            gap, k = capacity, made
            made += 1
        where[i] = k
        left = gap - s
        if left > 0:
            counts[left] += 1
            stacks[left].append(k)
    return where


def settle(sizes: np.ndarray, capacity: int, tries: int = 12) -> np.ndarray:
    """sum_of_squares, then again for the items in containers with a gap while that saves containers.

    Each try takes these items in another fixed order; full containers stay as they are.
    """
    k = sum_of_squares(sizes, capacity, True)
    for t in range(tries):
        fill = np.bincount(k, sizes)
        open_ = np.flatnonzero(fill[k] < capacity)
        if len(open_) < 2:
            break
        order = open_[np.random.default_rng(t).permutation(len(open_))]
        if t % 2:
            order = order[np.argsort(-sizes[order], kind="stable")]
        again = sum_of_squares(sizes[order], capacity, True)
        if again.max() + 1 <= (fill < capacity).sum():
            k[order] = again + k.max() + 1
            k = np.unique(k, return_inverse=True)[1]
    return k


def handed_on(sizes: np.ndarray, k: np.ndarray, fill: np.ndarray, capacity: int) -> np.ndarray:
    """For each container: is it handed on? The emptiest that can take the smallest item, with few items in all."""
    able = np.flatnonzero(capacity - fill >= sizes.min())
    able = able[np.argsort(fill[able], kind="stable")]
    few = np.cumsum(np.bincount(k, minlength=len(fill))[able]) <= len(sizes) // SHRINK
    out = np.zeros(len(fill), bool)
    out[able[few]] = True
    return out


def _pack_block(capacity: int, last: bool):
    def pack(x: pd.DataFrame) -> pd.DataFrame:
        copies = x["copies"].to_numpy()
        x = x.loc[x.index.repeat(copies)].reset_index(drop=True)
        number = np.arange(len(x), dtype=np.uint64) - np.repeat(np.cumsum(copies) - copies, copies).astype(np.uint64)
        x = x.assign(h=(x["h"].to_numpy().view(np.uint64) + number * np.uint64(_STEP)).view(np.int64), copies=np.int32(1))
        # Large items first; among equals the order is that of their hashes.
        x = x.sort_values(["n_tokens", "h", "item_id", "start"], ascending=[False, True, True, True], kind="stable")
        sizes = x["n_tokens"].to_numpy()
        k = settle(sizes, capacity) if last else sum_of_squares(sizes, capacity, True)
        fill = np.bincount(k, sizes).astype(np.int64)
        open_ = np.zeros(len(fill), bool) if last else handed_on(sizes, k, fill, capacity)
        return x.assign(slot=k, fill=fill[k], final=~open_[k])

    return pack


def pack_items(sizes: DataFrame, item_id: str, size: str, capacity: int = 1024) -> DataFrame:
    """container STRING, item_id, start, n_tokens, fill: one row per item or part of an oversized one.

    ``start`` is the offset of the part in its item; parts of an item that fits start at 0.
    ``fill`` is the number of tokens in the whole container.
    """
    s = sizes.select(F.col(item_id).alias("item_id"), F.col(size).cast("bigint").alias("n")).where("n > 0")
    s = s.groupBy("item_id", "n").agg(F.count("*").alias("m"))
    s = s.select("item_id", "n", "m", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(m - 1) div {COPIES}"))).alias("part"))
    s = s.select("item_id", "n", F.least(F.lit(COPIES), F.col("m") - F.col("part") * COPIES).cast("int").alias("copies"), F.xxhash64("item_id", "n", "part").alias("h"))
    s = cut(s)
    cap = F.lit(capacity)
    own = s.where(F.col("n") >= cap).select("item_id", "h", "n", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
    own = own.select("item_id", "h", "copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.expr(f"n div {capacity}"))).alias("k"))
    name = F.concat_ws(":", F.lit("own"), F.coalesce(F.col("item_id").cast("string"), F.lit("")), "h", "copy", "k")
    full = own.select(name.alias("container"), "item_id", ((F.col("k") - 1) * cap).cast("bigint").alias("start"), cap.cast("bigint").alias("n_tokens"), cap.cast("bigint").alias("fill"))
    rest = s.select("item_id", "h", "copies", F.expr(f"(n div {capacity}) * {capacity}").alias("start"), F.expr(f"n % {capacity}").alias("n_tokens")).where("n_tokens > 0")
    columns = rest.columns
    kinds = ", ".join(f"{c} {t}" for c, t in rest.dtypes) + ", block bigint, slot bigint, fill bigint, final boolean"
    n, level, done = rest.agg(F.sum("copies").alias("n")).first()["n"] or 0, 0, full
    while True:
        blocks = max(1, round(n / BLOCK))
        block = F.pmod(F.xxhash64("h", F.lit(level)), F.lit(blocks))
        out = cut(rest.withColumn("block", block).groupBy("block").applyInPandas(_pack_block(capacity, blocks == 1), kinds))
        placed = out.where("final").select(F.concat_ws(":", F.lit(f"r{level}"), "block", "slot").alias("container"), "item_id", "start", "n_tokens", "fill")
        done = done.unionByName(placed)
        if blocks == 1:
            return done
        rest = out.where("not final").select(*columns)
        n, level = rest.count(), level + 1
