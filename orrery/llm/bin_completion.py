"""Bin completion: fewest bins for items told by a histogram of sizes.

Items of one size are alike, so a packing is a list of (filling, times), a filling being ((size, number), ...) from large to small. Work
and memory follow the number of sizes, never the number of items.

Branch and bound. A node takes the largest item left and tries its fillings, the least wasteful first. Sums that the other sizes can
reach are bits of an integer (a bounded subset sum over multiplicities), which leads the enumeration straight to the fillings
of each sum. A filling is passed over when it is dominated: an item left over could take the place of one of its items, or of two,
and still fit. A node is pruned when its bins, and a bound from the waste that the items left must cause, reach the incumbent. Incumbents
are best-fit decreasing completions of the nodes. A filling is applied as often as its items last, then, as another branch, once.

Where the search ends without a proof, rounds of repacking follow: the bins with room left and a random share of the full ones are emptied,
and their items completed anew, sums being met in a random order of sizes; the result is kept if it has no more bins. The
random numbers have a fixed seed, so the packing is a function of the counts.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

Filling = tuple[tuple[int, int], ...]
#: Nodes of a search at most. Where they don't suffice the best packing so far stands; it is whole, only not proven least.
NODES = 1000
#: Dominated fillings passed over in a row at most: of many small items there are very many. Taking one costs time, not bins.
PASSED = 100
#: Rounds of repacking, and the shares of full bins emptied in them.
ROUNDS = 60
SHARES = (0.1, 0.3, 0.6)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing: each item, from large to small, goes where the least room is left. Alike bins are filled together."""
    rooms: list[int] = []  # ascending, of open bins
    bins: dict[int, list[tuple[Filling, int]]] = {}

    def put(filling: Filling, times: int, room: int) -> None:
        if room not in bins:
            insort(rooms, room)
        bins.setdefault(room, []).append((filling, times))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                filling, times = bins[room].pop()
                if not bins[room]:
                    del bins[room], rooms[at]
            else:
                room, filling, times = capacity, (), left
            each = room // size  # the bin just used has the least room, so it takes the next items of this size too
            full = min(times, left // each)
            if full:
                put((*filling, (size, each)), full, room - each * size)
            left -= full * each
            times -= full
            if times and left and left < each:
                put((*filling, (size, left)), 1, room - left * size)
                left, times = 0, times - 1
            if times and filling:
                put(filling, times, room)
    return [x for room in rooms for x in bins[room]]


def least_waste(counts: dict[int, int], capacity: int) -> int:
    """Room that any packing leaves empty besides items of more than half a bin: all smaller items that fit there don't fill it."""
    sizes = sorted(counts)
    waste = available = at = 0
    for size in reversed(sizes):
        if 2 * size <= capacity:
            break
        room = capacity - size
        while at < len(sizes) and sizes[at] <= room and sizes[at] < size:
            available += sizes[at] * counts[sizes[at]]
            at += 1
        need = counts[size] * room
        waste += max(0, need - available)
        available = max(0, available - need)
    return waste


def least_bins(counts: dict[int, int], capacity: int) -> int:
    return -(-(sum(s * n for s, n in counts.items()) + least_waste(counts, capacity)) // capacity)


def fillings(counts: dict[int, int], capacity: int, order: Callable[[int], float] | None = None) -> Iterator[Filling]:
    """Undominated fillings of a bin with the largest item, the fullest first, of equal sums those of sizes late in the order first.

    The order is by size where none is given; with one, dominated fillings come too.
    """
    largest = max(counts)
    room = capacity - largest
    spare = {s: n - (s == largest) for s, n in counts.items() if s <= room and n > (s == largest)}
    sizes = sorted(spare, key=order)
    mask = (1 << (room + 1)) - 1
    reach = [1]  # reach[i]: sums of the first i sizes
    for s in sizes:
        sums, most, step = reach[-1], min(spare[s], room // s), 1
        while most:  # one to most items, in powers of two
            take = min(step, most)
            sums |= sums << (take * s) & mask
            most -= take
            step *= 2
        reach.append(sums)
    total, passed = reach[-1], 0
    while total:
        goal = total.bit_length() - 1
        total ^= 1 << goal
        for rest in _with_sum(sizes, spare, reach, len(sizes), goal):
            if order is None and passed < PASSED and _dominated(rest, spare, room - goal, goal == reach[-1].bit_length() - 1):
                passed += 1
            else:
                passed = 0
                same = sum(n for s, n in rest if s == largest) + 1
                yield ((largest, same), *[(s, n) for s, n in rest if s != largest])


def _with_sum(sizes: list[int], spare: dict[int, int], reach: list[int], i: int, goal: int) -> Iterator[Filling]:
    """Fillings of just this sum from the first i sizes."""
    stack: list[tuple[int, int, Filling]] = [(i, goal, ())]
    while stack:
        i, goal, have = stack.pop()
        if not goal:
            yield have
            continue
        while sizes[i - 1] > goal:
            i -= 1
        s = sizes[i - 1]
        for n in range(min(spare[s], goal // s) + 1):  # the last pushed, the most items, is looked at first
            if reach[i - 1] >> (goal - n * s) & 1:
                stack.append((i - 1, goal - n * s, (*have, (s, n)) if n else have))


def _dominated(filling: Filling, spare: dict[int, int], slack: int, fullest: bool) -> bool:
    """Whether an item left over could replace one item, or two together, and still fit."""
    used = dict(filling)
    free = [s for s, n in spare.items() if n > used.get(s, 0)]
    bits = sum(1 << s for s in free)
    within = lambda low, high: bits >> low & ((1 << (high - low + 1)) - 1)
    if not fullest and slack and within(1, slack):  # room for one more
        return True
    sizes = [s for s, _ in filling]
    if not fullest and slack and any(within(s + 1, s + slack) for s in sizes):
        return True
    pairs = [(a + b) for k, a in enumerate(sizes) for b in sizes[k + 1 :]] + [2 * s for s, n in filling if n > 1]
    return any(within(p, p + slack) for p in pairs)


def _total(packing: list[tuple[Filling, int]]) -> int:
    return sum(t for _, t in packing)


def _without(counts: dict[int, int], filling: Filling, times: int) -> dict[int, int]:
    after = dict(counts)
    for s, n in filling:
        after[s] -= n * times
        if not after[s]:
            del after[s]
    return after


def search(counts: dict[int, int], capacity: int, nodes: int) -> tuple[list[tuple[Filling, int]], bool]:
    """(packing, proven) by branch and bound from the best-fit packing."""
    best = best_fit(counts, capacity)
    fewest, floor = _total(best), least_bins(counts, capacity)

    def children(left: dict[int, int]) -> Iterator[tuple[Filling, int]]:
        for filling in fillings(left, capacity):
            times = min(left[s] // n for s, n in filling)
            yield filling, times
            if times > 1:
                yield filling, 1

    stack = [(counts, (), 0, children(counts))]
    seen = 0
    while stack and seen < nodes and fewest > floor:
        left, made, used, rest = stack[-1]
        step = next(rest, None)
        if step is None:
            stack.pop()
            continue
        seen += 1
        after, bins, now = _without(left, *step), used + step[1], (made, step)
        if bins + least_bins(after, capacity) >= fewest:
            continue
        tail = best_fit(after, capacity)
        if bins + _total(tail) < fewest:
            head: list[tuple[Filling, int]] = []
            link = now
            while link:
                link, own = link
                head.append(own)
            best, fewest = [*reversed(head), *tail], bins + _total(tail)
        if after:
            stack.append((after, now, bins, children(after)))
    return best, not stack or fewest == floor


def complete(counts: dict[int, int], capacity: int, order: Callable[[int], float] | None = None) -> list[tuple[Filling, int]]:
    """The packing at the end of the search's first path: always the first filling, as often as its items last."""
    left, out = counts, []
    while left:
        filling = next(fillings(left, capacity, order))
        times = min(left[s] // n for s, n in filling)
        out.append((filling, times))
        left = _without(left, filling, times)
    return out


def repacked(packing: list[tuple[Filling, int]], capacity: int, rng: random.Random) -> list[tuple[Filling, int]]:
    """The packing with a random part of it, and all that isn't full, packed anew if that needs no more bins."""
    share = rng.choice(SHARES)
    kept: dict[Filling, int] = {}
    free: dict[int, int] = {}
    for filling, times in packing:
        full = sum(s * n for s, n in filling) == capacity
        stay = 0 if not full else sum(rng.random() > share for _ in range(times)) if times < 50 else int(times * (1 - share))
        if stay:
            kept[filling] = kept.get(filling, 0) + stay
        for s, n in filling if times > stay else ():
            free[s] = free.get(s, 0) + n * (times - stay)
    spread = 3 * rng.random()
    key = {s: s * (1 + spread * rng.random()) for s in sorted(free)}
    for filling, times in min(complete(free, capacity, key.__getitem__), best_fit(free, capacity), key=_total):
        kept[filling] = kept.get(filling, 0) + times
    new = list(kept.items())
    return new if _total(new) <= _total(packing) else packing


def pack(counts: dict[int, int], capacity: int, nodes: int = NODES, rounds: int = ROUNDS) -> tuple[list[tuple[Filling, int]], bool]:
    """(packing, proven): a packing of all items, and whether no smaller one exists. Sizes are 1 to capacity."""
    counts = {s: n for s, n in sorted(counts.items()) if n > 0}
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("sizes must be 1 to capacity")
    best, proven = search(counts, capacity, nodes)
    floor, rng = least_bins(counts, capacity), random.Random(0)
    if not proven:
        best = min(best, complete(counts, capacity), key=_total)
    for _ in range(0 if proven else rounds):
        if _total(best) == floor:
            break
        best = repacked(best, capacity, rng)
    return best, proven or _total(best) == floor
