"""Sharing sequences out by workload.

A step's batch is shared out by one function on its lengths, since each placement depends on all before; batches are independent and
run side by side (applyInPandas by batch)."""

from __future__ import annotations

import heapq
from array import array
from bisect import insort
from collections.abc import Iterable, Iterator, MutableMapping, MutableSequence, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def workload(length: Column | float):
    """Linear and quadratic work of a sequence."""
    return 24576 * length + length * length


def ceil_div(a: int, b: int) -> int:
    return -(-a // b)


def round_up(a: int, b: int) -> int:
    return ceil_div(a, b) * b


def state(sets: list[tuple], k: int) -> list[tuple]:
    """k sets (sum, number of items, items), the heaviest first; those that are not given are empty."""
    return sorted([*sets, *[(0, 0, ())] * (k - len(sets))], reverse=True)


def _uneven(sets: list[tuple], k: int) -> tuple:
    """Order of states: the most uneven first; of those, the one with the greater heaviest set."""
    return sets[0][0] - (sets[-1][0] if len(sets) == k else 0), *sets[0][:3]


def _merged(a: list[tuple], b: list[tuple], k: int, after: MutableMapping | MutableSequence) -> list[tuple]:
    """The state of two: only the lightest sets of each that find no empty partner are joined."""
    p, q = len(a), len(b)
    t = max(0, p + q - k)
    pairs = []
    for x, y in zip(a[p - t :], b[::-1][:t], strict=True):
        after[x[3]] = -y[2]
        pairs.append((x[0] + y[0], x[1] + y[1], x[2], y[3]))
    del a[p - t :], b[q - t :]
    if len(a) < len(b):
        a, b = b, a
    b += pairs
    if len(a) > 64 and len(b) <= 16:
        for x in b:
            insort(a, x)
    else:
        a += b
        a.sort()
    return a


def _joined(states: Iterator[list[tuple]], k: int, after: MutableMapping | MutableSequence) -> list[tuple]:
    """One state: the two most uneven are joined, the heaviest set of one with the lightest of the other and so on, until one is left.

    A set is (-sum, -number of items, -first item, last item), so that the heaviest comes first; a state has only its sets that are not empty; states
    are given in their order. The item behind another of its set is written to `after`: items are in one set each, so that sets of
    equal sums and numbers are told apart by their first items, and no join copies items."""
    heap: list[tuple] = []
    given = ((*_uneven(s, k), s) for s in states)
    new = next(given, None)
    while True:
        two = []
        while len(two) < 2 and (new or heap):
            if new and not (heap and heap[0] < new):
                two.append(new[-1])
                new = next(given, None)
            else:
                two.append(heapq.heappop(heap)[-1])
        if len(two) < 2:
            return two[0] if two else []
        both = _merged(*two, k, after)
        heapq.heappush(heap, (*_uneven(both, k), both))


def _items(one: tuple, after: MutableMapping | MutableSequence) -> list[int]:
    items = [-one[2]]
    while items[-1] != one[3]:
        items.append(after[items[-1]])
    return items


def joined(states: Sequence[list[tuple]]) -> list[tuple]:
    """One state of k sets (sum, number of items, items), as `state` gives them: see _joined."""
    k, after, given = len(states[0]), {}, []
    for s in states:
        own = []
        for total, n, items in s:
            if items:
                after.update(zip(items, items[1:], strict=False))
                own.append((-total, -n, -items[0], items[-1]))
        given.append(sorted(own))
    one = _joined(iter(sorted(given, key=lambda s: _uneven(s, k))), k, after)
    return state([(-s[0], -s[1], tuple(_items(s, after))) for s in one], k)


def differencing(loads: Sequence[float], k: int, equal_size: bool = False) -> list[list[int]]:
    """Largest differencing: items make states of k sets, which are joined to one. States are of one item, or with equal_size of k items that follow
    one another in order of load."""
    n = len(loads)
    if equal_size and n % k:
        raise ValueError(f"{n} items do not make {k} equal sets")
    order = sorted(range(n), key=lambda i: loads[i])
    if equal_size:
        top = lambda at: order[at + k - 1]
        ats = sorted(range(0, n, k), key=lambda at: (loads[top(at)] - loads[order[at]], loads[top(at)], top(at)), reverse=True) if k > 1 else range(n - 1, -1, -1)
        states = ([(-loads[i], -1, -i, i) for i in reversed(order[at : at + k])] for at in ats)
    else:
        states = ([(-loads[i], -1, -i, i)] for i in reversed(order))
    after = array("q", bytes(8 * n))
    sets = [sorted(_items(s, after)) for s in _joined(states, k, after)]
    return sets + [[] for _ in range(k - len(sets))]


def greedy(loads: Sequence[float], k: int, equal_size: bool = False) -> list[list[int]]:
    """Each item, in the order given, to the lightest set (with equal_size, among those not full)."""
    sets, sums, most = [[] for _ in range(k)], [0.0] * k, ceil_div(len(loads), k)
    for i, v in enumerate(loads):
        j = min((j for j in range(k) if not equal_size or len(sets[j]) < most), key=lambda j: (sums[j], j))
        sets[j].append(i)
        sums[j] += v
    return sets


def partitions(loads: Sequence[float], k: int, equal_size: bool = False) -> list[list[int]]:
    """k sets, none empty, that cover all items, each in ascending order."""
    if len(loads) < k:
        raise ValueError(f"{len(loads)} items cannot fill {k} sets")
    out = differencing(loads, k, equal_size)
    if any(not s for s in out):
        out = greedy(loads, k, True)
    return out


def micro_batches(lengths: Sequence[int], most_tokens: int, groups: Sequence | None = None, least: int = 1, multiple: int = 1) -> list[list[int]]:
    """Sets of rows of about even work and, as far as that allows, at most so many tokens; rows of a group stay together. Heavy sets come in the middle."""
    if len(lengths) and max(lengths) > most_tokens:
        raise ValueError("a sequence is longer than a micro-batch may be")
    keys = list(groups) if groups is not None else list(range(len(lengths)))
    members: dict = {}
    for i, g in enumerate(keys):
        members.setdefault(g, []).append(i)
    items = list(members.values())
    n = min(len(items), ceil_div(sum(lengths), most_tokens))
    n = min(len(items), round_up(max(n, least), multiple))
    loads = [sum(workload(lengths[i]) for i in m) for m in items]
    sets = [sorted(i for j in s for i in items[j]) for s in partitions(loads, n)]
    heavy = sorted(sets, key=lambda s: (-sum(workload(lengths[i]) for i in s), s))
    return heavy[::2][::-1] + heavy[1::2]


def runs(groups: Sequence) -> list[list[int]]:
    """Rows of equal consecutive groups, together."""
    out: list[list[int]] = []
    for i, g in enumerate(groups):
        if i and groups[i - 1] == g:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def group_partitions(lengths: Sequence[int], groups: Sequence, k: int) -> list[list[int]]:
    """As partitions, of runs of one group; as many runs in each set."""
    items = runs(groups)
    if len(items) < k:
        raise ValueError(f"{len(items)} groups cannot fill {k} sets")
    loads = [sum(workload(lengths[i]) for i in m) for m in items]
    return [sorted(i for j in s for i in items[j]) for s in partitions(loads, k, len(items) % k == 0)]


def inside_rank(rows: Iterable[int], lengths: Sequence[int]) -> list[int]:
    """A rank's rows, light ones at both ends and heavy ones in the middle."""
    asc = sorted(rows, key=lambda i: (workload(lengths[i]), i))
    return asc[::2] + asc[1::2][::-1]


def required_multiple(workers: int, *mini_batches: int) -> int:
    import math

    return math.lcm(workers, *mini_batches)


def assigned(rows: DataFrame, by: str, k: int, length: str = "seqlen", key: str = "row_idx", group: str | None = None, equal_size: bool = False, how: str = "differencing") -> DataFrame:
    """by, key, part, place: each batch's rows dealt to k parts, by largest differences or (greedy) one after another; `place` orders a part's rows."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        lengths = pdf[length].tolist()
        loads = [workload(v) for v in lengths]
        sets = group_partitions(lengths, pdf[group].tolist(), k) if group else greedy(loads, k, equal_size) if how == "greedy" else partitions(loads, k, equal_size)
        pairs = [(i, p, n) for p, s in enumerate(sets) for n, i in enumerate(inside_rank(s, lengths))]
        at = [i for i, _, _ in pairs]
        return pd.DataFrame({by: pdf[by].iloc[at].to_numpy(), key: pdf[key].iloc[at].to_numpy(), "part": [p for _, p, _ in pairs], "place": [n for _, _, n in pairs]})

    kinds = dict(rows.dtypes)
    return rows.select(by, key, length, *([group] if group else [])).groupBy(by).applyInPandas(one, f"{by} {kinds[by]}, {key} {kinds[key]}, part long, place long")


def micro_assigned(rows: DataFrame, by: str, most_tokens: int, length: str = "seqlen", key: str = "row_idx", group: str | None = None, least: int = 1, multiple: int = 1) -> DataFrame:
    """by, key, micro_batch: each batch's rows in micro-batches of bounded tokens."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        sets = micro_batches(pdf[length].tolist(), most_tokens, pdf[group].tolist() if group else None, least, multiple)
        pairs = [(i, m) for m, s in enumerate(sets) for i in s]
        at = [i for i, _ in pairs]
        return pd.DataFrame({by: pdf[by].iloc[at].to_numpy(), key: pdf[key].iloc[at].to_numpy(), "micro_batch": [m for _, m in pairs]})

    kinds = dict(rows.dtypes)
    return rows.select(by, key, length, *([group] if group else [])).groupBy(by).applyInPandas(one, f"{by} {kinds[by]}, {key} {kinds[key]}, micro_batch long")


def in_rank_order(rows: DataFrame, by: str, k: int, mode: str = "batch", mini: int | None = None, length: str = "seqlen", key: str = "row_idx", group: str | None = None) -> DataFrame:
    """by, key, part, place of each batch's rows, dealt to k ranks of as many rows: all at once; `mini`: mini-batch by mini-batch (of `mini`
    rows, in order of key), so that each spreads over all ranks; `group`: whole groups, in order of key within a rank, as many groups to each."""
    if mode == "batch":
        return assigned(rows, by, k, length, key, equal_size=True)
    if mode == "mini":
        if not mini:
            raise ValueError("mini-batches need their size")

        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(key).reset_index(drop=True)
            lengths, ranks = pdf[length].tolist(), [[] for _ in range(k)]
            for start in range(0, len(lengths) // mini * mini, mini):
                for r, s in enumerate(partitions([workload(v) for v in lengths[start : start + mini]], k, True)):
                    ranks[r] += [start + i for i in s]
            pairs = [(i, r, n) for r, s in enumerate(ranks) for n, i in enumerate(inside_rank(s, lengths))]
            at = [i for i, _, _ in pairs]
            return pd.DataFrame({by: pdf[by].iloc[at].to_numpy(), key: pdf[key].iloc[at].to_numpy(), "part": [r for _, r, _ in pairs], "place": [n for _, _, n in pairs]})

        kinds = dict(rows.dtypes)
        return rows.select(by, key, length).groupBy(by).applyInPandas(one, f"{by} {kinds[by]}, {key} {kinds[key]}, part long, place long")
    if mode != "group" or not group:
        raise ValueError(f"no such balance: {mode!r}")

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        if len(runs(pdf[group].tolist())) % k:
            raise ValueError("the number of groups is no multiple of the number of ranks")
        sets = group_partitions(pdf[length].tolist(), pdf[group].tolist(), k)
        pairs = [(i, p, n) for p, s in enumerate(sets) for n, i in enumerate(s)]
        at = [i for i, _, _ in pairs]
        return pd.DataFrame({by: pdf[by].iloc[at].to_numpy(), key: pdf[key].iloc[at].to_numpy(), "part": [p for _, p, _ in pairs], "place": [n for _, _, n in pairs]})

    kinds = dict(rows.dtypes)
    return rows.select(by, key, length, group).groupBy(by).applyInPandas(whole, f"{by} {kinds[by]}, {key} {kinds[key]}, part long, place long")


def inverse(table: DataFrame, old: str, new: str) -> DataFrame:
    """The permutation that undoes a permutation."""
    return table.select(F.col(new).alias(old), F.col(old).alias(new))


def shared_prefixes(rows: DataFrame, group: str = "uid", length: str = "prompt_length") -> DataFrame:
    """group, n, prefix_tokens, saved_tokens: what keeping a group's prompt once saves, from lengths alone, if the rows of a group have one prompt
    (`prefixes.prefix_forest` compares the tokens)."""
    n = F.count("*")
    return rows.groupBy(group).agg(n.alias("n"), F.max(length).alias("prefix_tokens"), (F.max(length) * (n - 1)).alias("saved_tokens"))


