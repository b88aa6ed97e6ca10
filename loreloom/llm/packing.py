"""Filling fixed-capacity containers with items by swap-based local search.

Texts are measured in tokens, then spread by hash over groups of bounded size. A group starts from a
best-fit-decreasing packing and improves it by local search: a document moves, or is exchanged
one-for-one or two-for-one, between underfull containers whenever that raises the sum of squared
fills, so the emptiest containers drain into the others. What stays underfull in all groups is
regrouped and searched again until one group is left or a level fills no further container. Every group is
searched in full: until no two of its containers have a trade left.

Defined results: a text is split only if it alone exceeds the capacity; its full pieces fill
containers of their own and the remainder is packed like any other item. Empty and null texts have
zero tokens and join the fullest container of their group. Repeated rows are items of their own.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch
from . import bpe

CAPACITY = 2048
#: Items of a group, which one task packs; and containers that each container trades with where not every one is tried.
GROUP_ITEMS, NEIGHBOURS = 20_000, 48
MOST_TASKS = 20_000
#: The sum of a pair that isn't there.
NOTHING = -(1 << 40)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Item numbers of each container; the open containers are kept as a bit set of their free space."""
    bins: list[list[int]] = []
    free: dict[int, list[int]] = {}
    mask = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        fit = mask >> s
        if fit:
            gap = s + (fit & -fit).bit_length() - 1
            b = free[gap].pop()
            if not free[gap]:
                mask &= ~(1 << gap)
        else:
            gap, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        left = gap - s
        if left:
            free.setdefault(left, []).append(b)
            mask |= 1 << left
    return bins


def closest_pairs(values: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each limit the greatest sum of two values that isn't above it, and their positions; NOTHING where no pair is."""
    order = np.argsort(values, kind="stable")
    s, i = values[order], np.arange(len(values))
    j = np.searchsorted(s, limits[:, None] - s[None, :], "right") - 1
    j = np.where(j == i, j - 1, j)  # not the value itself
    sums = np.where(j >= 0, s[None, :] + s[np.maximum(j, 0)], NOTHING)
    k = sums.argmax(axis=1)
    rows = np.arange(len(limits))
    return sums[rows, k], order[k], order[j[rows, k]]


def _twice(values: np.ndarray) -> np.ndarray:
    """Positions of two documents of each size at most, which have all the sums of two that all documents have."""
    if len(values) <= 32:
        return np.arange(len(values))
    order = np.argsort(values, kind="stable")
    s = values[order]
    return np.sort(order[np.concatenate([[True, True], s[2:] != s[:-2]])])


def best_trade(donor: np.ndarray, taker: np.ndarray, gap: int, ahead: int) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """The exchange that brings the taker closest to full: (gain, positions out of donor, positions out of taker).

    ``ahead`` is the donor's fill less the taker's; the sum of squares rises only by gains above it.
    """
    best: tuple[int, tuple[int, ...], tuple[int, ...]] = (max(0, ahead), (), ())
    fits = np.where(donor <= gap, donor, -1)
    if len(fits) and fits.max() > best[0]:
        best = (int(fits.max()), (int(fits.argmax()),), ())
    if best[0] == gap or not len(donor) or not len(taker):
        return best
    give_at, back_at = _twice(donor), _twice(taker)
    give, back = donor[give_at].astype(np.int64), taker[back_at].astype(np.int64)
    diff = give[:, None] - back[None, :]
    diff = np.where(diff <= gap, diff, -1)
    k = int(diff.argmax())
    if diff.flat[k] > best[0]:
        best = (int(diff.flat[k]), (int(give_at[k // len(back)]),), (int(back_at[k % len(back)]),))
        if best[0] == gap:
            return best
    if len(give) > 1:
        sums, i, j = closest_pairs(give, gap + back)
        k = int((sums - back).argmax())
        if sums[k] - back[k] > best[0]:
            best = (int(sums[k] - back[k]), tuple(sorted((int(give_at[i[k]]), int(give_at[j[k]])))), (int(back_at[k]),))
            if best[0] == gap:
                return best
    if len(back) > 1:
        sums, i, j = closest_pairs(-back, gap - give)
        k = int((give + sums).argmax())
        if give[k] + sums[k] > best[0]:
            best = (int(give[k] + sums[k]), (int(give_at[k]),), tuple(sorted((int(back_at[i[k]]), int(back_at[j[k]])))))
    return best


def _trade(sizes: np.ndarray, bins: list[list[int]], fill: list[int], a: int, b: int, capacity: int) -> bool:
    """All trades between a and b that raise the sum of squared fills, the best first."""
    traded = False
    while fill[b] < capacity and bins[a]:
        gain, out, back = best_trade(sizes[bins[a]], sizes[bins[b]], capacity - fill[b], fill[a] - fill[b])
        if not out:
            break
        moved, returned = [bins[a][i] for i in out], [bins[b][i] for i in back]
        bins[a] = [x for k, x in enumerate(bins[a]) if k not in out] + returned
        bins[b] = [x for k, x in enumerate(bins[b]) if k not in back] + moved
        fill[a] -= gain
        fill[b] += gain
        traded = True
    return traded


def _near_trades(sizes: np.ndarray, bins: list[list[int]], fill: list[int], capacity: int, neighbours: int) -> bool:
    """One round of trades of every underfull container with its likeliest partners."""
    improved = False
    under = sorted((i for i in range(len(bins)) if 0 < fill[i] < capacity), key=lambda i: fill[i])
    levels = [fill[i] for i in under]  # as the round began
    gone: set[int] = set()
    for a in under:
        if not bins[a] or fill[a] >= capacity:
            continue
        # partners: the fullest that still have room for one of its documents, and the fullest of all for exchanges
        room = bisect_right(levels, capacity - int(sizes[bins[a]].min()))
        near = [*reversed(under[max(0, room - neighbours // 2) : room]), *reversed(under[-(neighbours // 2) :])]
        for b in [b for b in dict.fromkeys(near) if b != a and b not in gone and fill[b] < capacity]:
            improved |= _trade(sizes, bins, fill, a, b, capacity)
            if not bins[a]:
                gone.add(a)
                break
    return improved


def _pair_sums(values: np.ndarray) -> np.ndarray:
    """The distinct sums of two of the values."""
    v = values[_twice(values)]
    i, j = np.triu_indices(len(v), 1)
    return np.unique(v[i] + v[j])


def _may_give(sizes: np.ndarray, container: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct sizes of a container's documents, and of two of them."""
    own = sizes[container]
    return np.unique(own), _pair_sums(own)


class _Takers:
    """What the containers numbered ``of`` may give back and the gaps it would leave."""

    def __init__(self, of: np.ndarray, gives: list[tuple[np.ndarray, np.ndarray]], gap: np.ndarray):
        self.of, self.gap = of, gap[of]
        none = np.zeros(0, np.int64)
        parts = [(np.concatenate([none, *(gives[k][i] for k in of)]), np.repeat(np.arange(len(of)), [len(gives[k][i]) for k in of])) for i in (0, 1)]
        (self.one, self.one_of), (self.two, self.two_of) = parts
        self.one_to, self.two_to = self.one + self.gap[self.one_of], self.two + self.gap[self.two_of]

    def hits(self, single: np.ndarray, double: np.ndarray, ahead: np.ndarray) -> np.ndarray:
        """Which of them have a trade that raises the sum; single and double: the donor's cumulated counts by size."""
        ahead = ahead[self.of]
        hit = single[self.gap] > single[ahead]
        hit[self.one_of[double[self.one_to] > double[self.one + ahead[self.one_of]]]] = True
        hit[self.two_of[single[self.two_to] > single[self.two + ahead[self.two_of]]]] = True
        return hit


def _all_trades(sizes: np.ndarray, bins: list[list[int]], fill: list[int], capacity: int, gives: dict[int, tuple[np.ndarray, np.ndarray]], fresh: set[int]) -> set[int]:
    """One round in which every underfull container is tried with every other; returns the containers it changed.

    What a container may give is kept as cumulated counts by size, so one look at both ends of the window of wanted
    sizes tells for every document, or sum of two, of all the others whether an exchange for it raises the sum.
    Only two containers of which neither is ``fresh`` were tried with each other before and are left out. ``gives``
    has what containers may give, for the next rounds.
    """
    under = [i for i in range(len(bins)) if 0 < fill[i] < capacity]
    if len(under) < 2 or not fresh:
        return set()
    for i in under:
        if i in fresh or i not in gives:
            gives[i] = _may_give(sizes, bins[i])
    level, is_fresh = np.array([fill[i] for i in under]), np.array([i in fresh for i in under])
    may, gap = [gives[i] for i in under], capacity - level
    every = _Takers(np.arange(len(under)), may, gap)
    some = every if is_fresh.all() else _Takers(np.flatnonzero(is_fresh), may, gap)
    open_ = np.ones(len(under), bool)  # containers that are as the round began

    def known(values: np.ndarray) -> np.ndarray:
        return np.cumsum(np.bincount(values, minlength=2 * capacity + 1) > 0)

    for k, a in enumerate(under):
        if not open_[k]:
            continue  # changed in this round, so another follows
        own, sums = may[k]
        while bins[a]:
            single, double = known(own), known(np.concatenate([own, sums]))
            takers = every if is_fresh[k] or not open_[k] else some
            hit = takers.hits(single, double, np.maximum(0, fill[a] - level)) & open_[takers.of] & (takers.of != k)
            if not hit.any():
                break
            m = int(takers.of[np.where(hit, level[takers.of], -1).argmax()])  # the fullest
            _trade(sizes, bins, fill, a, under[m], capacity)
            open_[k] = open_[m] = False
            if bins[a]:
                own, sums = _may_give(sizes, bins[a])
    return {under[k] for k in np.flatnonzero(~open_)}


def local_search(sizes: np.ndarray, bins: list[list[int]], capacity: int, neighbours: int = NEIGHBOURS, every: bool = True) -> list[list[int]]:
    """Drain the emptiest containers into the others; stops when no trade raises the sum of squared fills.

    Without ``every`` it stops as soon as none does among the ``neighbours`` partners of each container. Those are
    much the same for all containers, so that takes longer and fills fewer; nothing here asks for it.
    """
    fill = [int(sizes[b].sum()) if b else 0 for b in bins]
    if every:
        gives: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        fresh = set(range(len(bins)))
        while fresh:
            fresh = _all_trades(sizes, bins, fill, capacity, gives, fresh)
    else:
        while _near_trades(sizes, bins, fill, capacity, neighbours):
            pass
    return [b for b in bins if b]


def pack_group(sizes: np.ndarray, capacity: int = CAPACITY, neighbours: int = NEIGHBOURS, every: bool = True) -> list[list[int]]:
    """Containers of item numbers; items without tokens join the fullest container."""
    real = np.flatnonzero(sizes > 0)
    bins = local_search(sizes[real], best_fit_decreasing(sizes[real], capacity), capacity, neighbours, every) if len(real) else []
    out = [[int(real[i]) for i in b] for b in bins]
    none = np.flatnonzero(sizes <= 0).tolist()
    if none:
        if out:
            max(out, key=lambda b: sizes[b].sum()).extend(none)
        else:
            out = [none]
    return out


def _pack(level: int, capacity: int, neighbours: int):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row_id", "piece_no"], kind="stable").reset_index(drop=True)
        sizes = pdf["n_tokens"].to_numpy(np.int64)
        bin_of, full = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), bool)
        for k, b in enumerate(pack_group(sizes, capacity, neighbours, True)):
            bin_of[b] = k
            full[b] = sizes[b].sum() == capacity
        return pdf.assign(container_id=[f"{level}-{g}-{k}" for g, k in zip(pdf["grp"], bin_of)], full=full)

    return pack


def fill_containers(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    vocabulary: str = bpe.VOCABULARY,
    group_items: int = GROUP_ITEMS,
    neighbours: int = NEIGHBOURS,
) -> DataFrame:
    """(container_id, key, piece_no, start_token, n_tokens), one row for each text or piece of a text."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    counts = bpe.token_counts(docs, key, text, vocabulary)
    counts = scratch.write(counts.select(F.col(key).alias("item"), "n_tokens", F.monotonically_increasing_id().alias("row_id")), "sizes")
    cap = F.lit(capacity).cast("long")
    # a sequence of the full pieces and the remainder; whole texts are one piece of number 0
    pieces = counts.withColumn("last", F.floor(F.greatest(F.col("n_tokens") - 1, F.lit(0)) / cap).cast("long"))
    pieces = pieces.select("item", "row_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("piece_no"))
    pieces = pieces.select(
        "item", "row_id", "piece_no", (F.col("piece_no") * cap).alias("start_token"),
        F.least(cap, F.col("n_tokens") - F.col("piece_no") * cap).alias("n_tokens"),
    )
    columns = ["container_id", "item", "piece_no", "start_token", "n_tokens"]
    done = [
        pieces.filter(F.col("n_tokens") == cap)
        .withColumn("container_id", F.concat_ws("-", F.lit("w"), "row_id", "piece_no"))
        .select(columns)
    ]
    left = pieces.filter(F.col("n_tokens") < cap)
    n, level = left.count(), 0
    while True:
        groups = max(1, -(-n // group_items))
        grouped = left.withColumn("grp", F.pmod(F.xxhash64("row_id", "piece_no", F.lit(level)), F.lit(groups)).cast("int"))
        schema = grouped.select("*", F.lit("").alias("container_id"), F.lit(True).alias("full")).schema
        # one group a task where there are tasks enough, by number, as hashes would give a task several; sizes in bytes say
        # nothing about the work
        grouped = grouped.repartitionById(min(groups, MOST_TASKS), "grp")
        packed = scratch.write(grouped.groupBy("grp").applyInPandas(_pack(level, capacity, neighbours), schema), f"level{level}")
        if groups == 1:
            done.append(packed.select(columns))
            break
        done.append(packed.filter("full").select(columns))
        left_packed = packed.filter(~F.col("full"))
        left = left_packed.drop("container_id", "full", "grp")
        before, n, level = n, left.count(), level + 1
        if n == before:
            done.append(left_packed.select(columns))
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.withColumnRenamed("item", key)


def container_summary(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, the least number of containers that could hold them, mean fill."""
    per = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("tokens"))
    return per.agg(
        F.count(F.lit(1)).alias("containers"),
        F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
        F.ceil(F.coalesce(F.sum("tokens"), F.lit(0)) / capacity).alias("least_containers"),
        F.max("tokens").alias("fullest"),
        F.round(F.avg(F.col("tokens") / capacity), 6).alias("mean_fill"),
    )
