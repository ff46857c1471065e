"""Filling containers of fixed capacity with documents: linear grouping, configurations, best fit.

Large documents are sorted and cut into a few groups of equal number; each is taken as long as the
longest of its group, which leaves few sizes.  Which fillings of a container to use, and how often, is
the linear programme of fewest containers over all fillings, solved by column generation: the prices
of an optimal basis are put to a knapsack, whose best filling enters the basis while it pays.  The
counts are rounded down, what is left over is filled greedily; then the documents themselves take the
places of their group, and the small ones are put where they leave least room.  Documents are dealt
into shards by a hash of the id, so the work of a shard is bounded however many documents there are,
and a source or call with a third of them is spread.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from talkweave.functions.durable import small

#: Documents in a shard, on average; a shard leaves at most a few containers less than full.
SHARD = 20_000
#: Groups of large documents, and the share of the capacity from which a document is large.
GROUPS, LARGE = 96, 0.34
#: Steps of room that a filling is counted in, and the most columns that enter the basis; the basis is feasible after each.
STEPS, ROUNDS = 1024, 400


def best_filling(sizes: np.ndarray, worth: np.ndarray, most: np.ndarray, room: int) -> np.ndarray:
    """How often to take each size, at most `most` times, for the greatest sum of worth within the room: a bounded knapsack."""
    best = np.zeros(room + 1)
    taken = []
    for s, w, m in zip(sizes.tolist(), worth.tolist(), most.tolist()):
        n_of = np.zeros(room + 1, dtype=np.int16)
        if w > 0:
            base = best.copy()
            for n in range(1, min(m, room // s) + 1):
                cand = base[: room + 1 - n * s] + n * w
                better = cand > best[n * s :] + 1e-12
                best[n * s :][better] = cand[better]
                n_of[n * s :][better] = n
        taken.append(n_of)
    out, at = np.zeros(len(sizes), dtype=np.int64), room
    for k in range(len(sizes) - 1, -1, -1):
        out[k] = taken[k][at]
        at -= int(out[k]) * int(sizes[k])
    return out


def fillings(sizes: np.ndarray, counts: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The fillings (columns) of an optimal basis of the linear programme of fewest containers, and how often each is used."""
    n = len(sizes)
    each = room // sizes
    basis, inverse = np.diag(each).astype(float), np.diag(1.0 / each)
    used = counts / each
    for _ in range(ROUNDS):
        price = inverse.sum(0)  # of an item of each size, in containers
        new = best_filling(sizes, price, each, room)
        if price @ new <= 1 + 1e-7:
            break
        step = inverse @ new
        ratio = np.where(step > 1e-9, used / np.where(step > 1e-9, step, 1.0), np.inf)
        out = int(ratio.argmin())
        used = np.maximum(used - ratio[out] * step, 0.0)
        used[out] = ratio[out]
        basis[:, out] = new
        inverse[out] /= step[out]
        others = np.arange(n) != out
        inverse[others] -= step[others, None] * inverse[out]
    return basis.astype(np.int64), used


def configurations(sizes: np.ndarray, counts: np.ndarray, cap: int) -> list[tuple[np.ndarray, int]]:
    """Fillings (how often each size) and how many containers get each, together taking all items.

    `sizes` come largest first.  The optimal fillings as often as whole containers of them are used,
    then for the items left over the fillings that take most room, as often as these items last.
    """
    unit = max(1, cap // STEPS)
    rough = np.minimum(-(-sizes // unit), cap // unit)  # on a coarser scale, rounded up, so that a filling always fits
    left, plan = counts.astype(np.int64).copy(), []
    columns, used = fillings(rough, left, cap // unit)
    for k in np.argsort(-used, kind="stable"):
        take = columns[:, k]
        times = int(min(np.floor(used[k] + 1e-6), (left[take > 0] // take[take > 0]).min()))
        if times:
            left -= take * times
            plan.append((take, times))
    while left.any():
        take = best_filling(rough, np.where(left > 0, rough, 0), left, cap // unit)
        times = int((left[take > 0] // take[take > 0]).min())
        left -= take * times
        plan.append((take, times))
    return plan


def pack(lengths: np.ndarray, cap: int, groups: int = GROUPS, large: float = LARGE) -> np.ndarray:
    """The container number of each item, 0.. without a hole; every length must be within 0..cap."""
    n = len(lengths)
    box = np.full(n, -1, dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    big = order[lengths[order] > max(1, large * cap)]
    room: list[int] = []
    if len(big):
        # groups of equal number, largest first; each rounds up to its first, the largest
        cut = np.unique(np.linspace(0, len(big), min(groups, len(big)) + 1).astype(int))
        tops = lengths[big[cut[:-1]]]
        cut = np.append(cut[:-1][np.append(True, tops[1:] < tops[:-1])], len(big))  # groups of one size are one
        of_group = [list(big[a:b][::-1]) for a, b in zip(cut[:-1], cut[1:])]
        sizes = np.array([lengths[big[a]] for a in cut[:-1]], dtype=np.int64)
        plan = configurations(sizes, np.diff(cut), cap)
        for take, times in plan:
            for _ in range(times):
                free = cap
                for k in np.flatnonzero(take):
                    for _ in range(int(take[k])):
                        i = of_group[k].pop()
                        box[i] = len(room)
                        free -= int(lengths[i])
                room.append(free)
        room, box = _refill(lengths, big, box, room)
    # best fit for the small ones: the container with the least room that is enough
    open_ = sorted((r, b) for b, r in enumerate(room))
    for i in order:
        if box[i] >= 0:
            continue
        k = bisect_left(open_, (int(lengths[i]), -1))
        if k < len(open_):
            r, b = open_.pop(k)
        else:
            r, b = cap, len(room)
            room.append(cap)
        box[i] = b
        insort(open_, (r - int(lengths[i]), b))
    return box


def _refill(lengths: np.ndarray, big: np.ndarray, box: np.ndarray, room: list[int]) -> tuple[list[int], np.ndarray]:
    """Takes apart the emptiest containers whose documents fit, whole, into the room rounding left elsewhere."""
    members: dict[int, list[int]] = {}
    for i in big:
        members.setdefault(int(box[i]), []).append(int(i))
    open_ = sorted((r, b) for b, r in enumerate(room))
    for b in sorted(range(len(room)), key=lambda b: -room[b]):
        moves, undone = [], False
        if (room[b], b) not in members and b not in members:
            continue
        at = bisect_left(open_, (room[b], b))
        open_.pop(at)
        for i in sorted(members[b], key=lambda i: -lengths[i]):
            k = bisect_left(open_, (int(lengths[i]), -1))
            if k == len(open_):
                undone = True
                break
            r, to = open_.pop(k)
            insort(open_, (r - int(lengths[i]), to))
            moves.append((i, to, r))
        if undone:
            for i, to, r in reversed(moves):
                open_.pop(bisect_left(open_, (r - int(lengths[i]), to)))
                insort(open_, (r, to))
            insort(open_, (room[b], b))
            break
        for i, to, _ in moves:
            box[i] = to
            room[to] -= int(lengths[i])
            members[to].append(i)
        del members[b]
        room[b] = -1
    kept = [b for b in range(len(room)) if b in members]
    new = {b: k for k, b in enumerate(kept)}
    for b in kept:
        for i in members[b]:
            box[i] = new[b]
    return [room[b] for b in kept], box


def _shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """Packs one shard for one limit: full containers of items that are too large, then the rests with all others."""
    pdf = pdf.sort_values("item", kind="stable")
    cap = int(pdf["capacity"].iloc[0])
    item, size = pdf["item"].to_numpy(), pdf["size"].to_numpy(dtype=np.int64)
    whole = np.where(size > cap, size // cap, 0)
    rest = size - whole * cap
    at = np.flatnonzero((whole == 0) | (rest > 0))
    box = pack(rest[at], cap)
    fill = np.bincount(box, weights=rest[at], minlength=1).astype(np.int64)
    over = np.repeat(np.arange(len(size)), whole)
    nth = np.arange(len(over)) - np.repeat(np.cumsum(whole) - whole, whole)
    return pd.DataFrame(
        {
            "limit_id": pdf["limit_id"].iloc[0],
            "capacity": cap,
            "shard": pdf["shard"].iloc[0],
            "box": np.concatenate([box, len(fill) + np.arange(len(over))]),
            "item": np.concatenate([item[at], item[over]]),
            "piece": np.concatenate([whole[at], nth]).astype(np.int32),
            "size": np.concatenate([rest[at], np.full(len(over), cap)]),
            "fill": np.concatenate([fill[box], np.full(len(over), cap)]),
        }
    )


def fill_containers(sized: DataFrame, limits: DataFrame, item: str = "doc_id", size: str = "n_tokens", shard: int = SHARD) -> DataFrame:
    """Every item placed into containers of each limit.

    `sized` has the item's id and size; `limits` has limit_id and max_tokens and is small by its
    nature (up to 1,000 rows, else an error).  Result, one row per placed piece: limit_id,
    max_tokens, container_id, <item>, piece (0 unless the item is larger than the capacity), size,
    fill (total size in the container).  An item is split only if it is larger than the capacity,
    into full containers and a rest that is packed like an item.  Items of size 0, and null sizes,
    which count as 0, take a place with no room; limits that are null or below 1 are left out.
    Null ids and repeated rows are items of their own.  Placement depends on ids and sizes only.
    An empty table, or one of limits, gives no containers.
    """
    caps = sorted({(str(r[0]), int(r[1])) for r in small(limits.where("max_tokens >= 1").select("limit_id", "max_tokens"), 1000)})
    shards = max(1, -(-sized.select(F.lit(1)).count() // shard))
    each = F.array(*[F.struct(F.lit(n).alias("limit_id"), F.lit(c).cast("long").alias("capacity")) for n, c in caps] or [F.lit(None).cast("struct<limit_id:string,capacity:bigint>")])
    rows = sized.select(
        F.col(item).alias("item"),
        F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("size"),
        F.explode(each).alias("limit"),
    ).where("limit IS NOT NULL")
    kind = sized.schema[item].dataType.simpleString()
    return (
        rows.select("item", "size", "limit.*", F.pmod(F.xxhash64("item", "size"), F.lit(shards)).alias("shard"))
        .groupBy("limit_id", "capacity", "shard")
        .applyInPandas(_shard, f"limit_id string, capacity long, shard long, box long, item {kind}, piece int, size long, fill long")
        .select(
            "limit_id",
            F.col("capacity").alias("max_tokens"),
            F.concat_ws("-", "limit_id", F.col("shard"), F.col("box")).alias("container_id"),
            F.col("item").alias(item),
            "piece",
            "size",
            "fill",
        )
    )
