"""Best-fit packing of token pieces into fixed-length sequences, by bin completion.

Packing needs only how many pieces there are of each length, at most `capacity` numbers however large the corpus is.
The driver solves that bounded problem: best-fit decreasing gives the first incumbent and waste bounds the optimum.
While they differ, bins are completed around the largest length left: first by the fullest filling of all, which a
dynamic programme over the lengths finds, with ties and near ties for the longer pieces; then by a branch-and-bound
search that tries undominated fillings from the least waste on and drops branches whose waste rules out a better
packing. The work is bounded; `gap` tells how far a packing is from the bound, and 0 proves it the best. What is found
are patterns, each with the number of bins that take it. Pieces then get their places in parallel, from their rank among
the pieces of their length; no piece is shuffled for it unless the table of ranks is too large to broadcast.

Nulls: a null text is empty and packs as its end token alone; a null id keeps its pieces. Rows that repeat an id each
have pieces of their own. An empty table gives an empty result. Columns other than the id and the text don't matter.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .common import cut_table
from .token_counts import encoder
from .words import slices

CAPACITY = 2048
END = 0
#: Search nodes, and steps of the dynamic programme (lengths times room); beyond them the incumbent stands.
NODES, STEPS = 3000, 1 << 30
#: How much a filling's longer pieces count for: the sum of (length / capacity) ^ power is greatest.
POWERS = (1.05, 1.2, 1.1, 1.4, 2.0, 3.0)
#: Rows of the rank table (about 100 bytes each in memory) up to which it is broadcast; above, it is joined by a shuffle.
BROADCAST_ROWS = 100_000

Pattern = tuple[int, tuple[tuple[int, int], ...]]


def tokenise(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32[, ids]) and their rank `nth` among those of their length in their part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 20):
                own = batch.slice(a, b - a)
                ids, ends = encoder(path).encode(own.column(1))
                ids = np.insert(ids.astype("<u4"), ends[1:], END)
                sizes = np.diff(ends) + 1
                pieces = -(-sizes // capacity)
                row = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(sizes[row] - start, capacity)
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                head = np.searchsorted(ordered, ordered)
                nth = np.empty(len(row), np.int64)
                nth[order] = np.arange(len(row)) - head + seen[ordered]
                seen += np.bincount(length, minlength=capacity + 1)
                cuts = np.append(0, np.cumsum(length))
                data = ids.tobytes()
                crc = [zlib.crc32(data[4 * x : 4 * y]) for x, y in zip(cuts.tolist(), cuts[1:].tolist())]
                out = [own.column(0).take(pa.array(row)), piece.astype(np.int32), start, length, np.array(crc, np.int64), np.full(len(row), part, np.int32), nth]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.view("<i4"))))
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"] + ["ids"] * with_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def waste_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer bins, by the best of three families of bounds.

    For a threshold, long items stand alone and the rest must fit the room they leave. For a unit, an item weighs as many
    units as it holds, or, above half a bin, as many as it keeps others from having. For a least length, of which k go
    into a bin at most, so many bins hold k items as the shortest items allow, and the others one less.
    """
    lengths = np.array(sorted(counts), np.int64)
    n = np.array([counts[x] for x in lengths.tolist()], np.int64)
    best = -(-int((lengths * n).sum()) // capacity)
    for k in lengths[lengths <= capacity // 2].tolist():
        big, middle, small = lengths > capacity - k, (lengths <= capacity - k) & (lengths > capacity / 2), (lengths >= k) & (lengths <= capacity / 2)
        room = int((n[middle] * (capacity - lengths[middle])).sum())
        rest = int((n[small] * lengths[small]).sum()) - room
        best = max(best, int(n[big].sum() + n[middle].sum()) + max(0, -(-rest // capacity)))
    double = np.sign(2 * lengths - capacity)
    for unit in range(1, capacity // 2 + 1):
        most = capacity // unit
        weight = np.where(double > 0, 2 * (most - (capacity - lengths) // unit), np.where(double < 0, 2 * (lengths // unit), most))
        best = max(best, -(-int((weight * n).sum()) // (2 * most)))
    ends, sums = np.append(0, np.cumsum(n)).tolist(), np.append(0, np.cumsum(lengths * n)).tolist()
    for i, least in enumerate(lengths.tolist()):
        if (k := capacity // least) < 2:
            break

        def shortest(m: int) -> int:
            """The length of the m shortest of these items together."""
            at = bisect_left(ends, ends[i] + m, i)
            return sums[at - 1] - sums[i] + (ends[i] + m - ends[at - 1]) * int(lengths[at - 1]) if m else 0

        items = ends[-1] - ends[i]
        low, high = 0, items // k  # bins of k items: at most `low`
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if shortest(k * middle) <= capacity * middle else (low, middle - 1)
        best = max(best, -(-(items - low) // (k - 1)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing over groups of equal bins."""
    groups: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = {}
    room: list[int] = []

    def add(left: int, many: int, items: tuple[tuple[int, int], ...]) -> None:
        if many:
            if left not in groups:
                groups[left] = []
                insort(room, left)
            groups[left].append((many, items))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            i = bisect_left(room, length)
            left = room[i] if i < len(room) else capacity
            if i < len(room):
                many, items = groups[left].pop()
                if not groups[left]:
                    del groups[left]
                    room.pop(i)
            else:
                many, items = math.inf, ()
            k = left // length
            full = min(many, n // k)
            add(left - k * length, full, (*items, (length, k)))
            n -= full * k
            if full < many and 0 < n < k:
                add(left - n * length, 1, (*items, (length, n)))
                full, n = full + 1, 0
            if many != math.inf:
                add(left, many - full, items)
    return [(many, items) for own in groups.values() for many, items in own]


def covers(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the items of b can be dealt into places of the sizes in a: a dominates b."""
    if not b:
        return True
    rest = b[1:]
    return any(size >= b[0] and covers((*a[:i], size - b[0], *a[i + 1 :]), rest) for i, size in enumerate(a))


def grown(filling: tuple[int, ...], counts: dict[int, int], room: int, lengths: np.ndarray) -> tuple[int, ...]:
    """The filling and, as long as any length fits, the largest that does."""
    out, left = list(filling), room - sum(filling)
    i = len(lengths) - 1
    while i >= 0:
        i = min(i, int(np.searchsorted(lengths, left, "right")) - 1)
        if i < 0:
            break
        x = int(lengths[i])
        if k := min(left // x, counts[x] - out.count(x)):
            out += [x] * k
            left -= k * x
        i -= 1
    return tuple(sorted(out, reverse=True))


def fillings(counts: dict[int, int], room: int, width: int) -> list[tuple[int, ...]]:
    """Undominated sets of further lengths for a bin with so much room, least waste first; none has room for another."""
    lengths = np.array(sorted(x for x in counts if x <= room), np.int64)
    if not len(lengths):
        return [()]
    found: set[tuple[int, ...]] = {(int(lengths[-1]),)}

    def pairs(room: int, used: int = 0) -> list[tuple[int, int]]:
        first = lengths[lengths < room]
        at = np.searchsorted(lengths, np.minimum(first, room - first), "right") - 1
        ok = at >= 0
        first, second = first[ok], lengths[at[ok]]
        best = np.argsort(-(first + second), kind="stable")[: 2 * width]
        return [(int(x), int(y)) for x, y in zip(first[best], second[best])]

    found.update(pairs(room))
    if max(map(sum, found)) < room:
        for x in lengths[lengths < room - 1].tolist()[-64:]:
            found.update(tuple(sorted((x, *p), reverse=True)) for p in pairs(room - x)[:2])
    fit = list({grown(f, counts, room, lengths) for f in found if all(counts[x] >= f.count(x) for x in f)} or {grown((), counts, room, lengths)})
    fit.sort(key=lambda f: (room - sum(f), len(f), [-x for x in f]))
    out: list[tuple[int, ...]] = []
    for f in fit:
        if not any(len(f) <= 4 and covers(g, f) for g in out):  # of many pieces the search for a dealing takes too long
            out.append(f)
        if len(out) == width:
            break
    return out


def fullest(counts: dict[int, int], room: int, capacity: int, power: float) -> tuple[tuple[int, ...], int]:
    """The further lengths for a bin with so much room whose (length / capacity) ^ power sum highest, and the steps taken."""
    best, taken = np.full(room + 1, -np.inf), []
    best[0] = 0
    for x in sorted((x for x in counts if x <= room), reverse=True):
        n, k = min(counts[x], room // x), 1
        while n:  # so many pieces of a length as powers of two and a rest
            m = min(k, n)
            n, k = n - m, 2 * k
            now = best.copy()
            np.maximum(now[m * x :], best[: room + 1 - m * x] + m * (x / capacity) ** power, out=now[m * x :])
            taken.append((x, m, now > best))
            best = now
    at, out = int(np.argmax(best)), []
    for x, m, better in reversed(taken):
        if better[at]:
            out += [x] * m
            at -= m * x
    return tuple(sorted(out, reverse=True)), len(taken) * (room + 1)


def without(left: dict[int, int], items: tuple[int, ...], most: float = math.inf) -> tuple[dict[int, int], int, tuple[tuple[int, int], ...]]:
    """What is left when bins of these items are filled as often as they go, or `most` times; how often; the pattern."""
    use = {x: items.count(x) for x in items}
    times = int(min(most, *(left[x] // k for x, k in use.items())))
    rest = {x: n - times * use.get(x, 0) for x, n in left.items()}
    return {x: n for x, n in rest.items() if n}, times, tuple(use.items())


def move(left: dict[int, int], pattern: Pattern, sign: int) -> None:
    """Take the items of a pattern's bins out of what is left (sign -1), or put them back (1)."""
    times, items = pattern
    for x, k in items:
        if n := left.get(x, 0) + sign * times * k:
            left[x] = n
        else:
            del left[x]


def one_less(counts: dict[int, int], x: int) -> dict[int, int]:
    return {**counts, x: counts[x] - 1} if counts[x] > 1 else {y: n for y, n in counts.items() if y != x}


def filled(counts: dict[int, int], capacity: int, power: float, steps: int) -> tuple[list[Pattern], int]:
    """A packing by fullest fillings; when the steps are used up, the rest goes by best fit. Also the steps left."""
    made, left = [], counts
    while left and steps > 0:
        largest = max(left)
        filling, cost = fullest(one_less(left, largest), capacity - largest, capacity, power)
        left, times, pattern = without(left, (largest, *filling))
        made.append((times, pattern))
        steps -= cost
    return made + best_fit(left, capacity), steps


def bins(patterns: list[Pattern]) -> int:
    return sum(many for many, _ in patterns)


def gap(patterns: list[Pattern], counts: dict[int, int], capacity: int) -> int:
    """By how many bins a packing exceeds the bound. At 0 it is proven to be the best."""
    return bins(patterns) - waste_bound(counts, capacity) if patterns else 0


def complete(counts: dict[int, int], capacity: int, nodes: int = NODES, width: int = 3, steps: int = STEPS) -> list[Pattern]:
    """Bin completion: patterns that hold all items of the given lengths, in as few bins as the search finds."""
    counts = {x: n for x, n in counts.items() if n}
    if not counts:
        return []
    best, bound = best_fit(counts, capacity), waste_bound(counts, capacity)
    for power in POWERS:
        if bins(best) > bound and steps > 0:
            found, steps = filled(counts, capacity, power, steps)
            best = min(best, found, key=bins)
    most = bins(best)
    total = sum(x * n for x, n in counts.items())
    # one copy of what is left, where the search stands, and the patterns that led there: a branch holds its own pattern
    left, made = dict(counts), []
    stack: list[tuple[int, Pattern | None, int, int]] = [(0, None, 0, 0)]
    while stack and most > bound and nodes:
        nodes -= 1
        depth, pattern, used, waste = stack.pop()
        if waste > (most - 1) * capacity - total:
            continue
        while len(made) > depth:
            move(left, made.pop(), 1)
        if pattern:
            move(left, pattern, -1)
            made.append(pattern)
        if not left:
            best, most = [*made], used
            continue
        largest = max(left)
        others, room = one_less(left, largest), capacity - largest
        found = fillings(others, room, width)
        if steps > 0:
            first, cost = fullest(others, room, capacity, POWERS[0])
            steps -= cost
            found = [first, *(f for f in found if f != first)]
        branches = []
        for most_times in (math.inf, 1):  # once is tried last
            for filling in found:
                items = (largest, *filling)
                use = tuple({x: items.count(x) for x in items}.items())
                often = min(left[x] // k for x, k in use)
                if most_times > 1 or often > 1:
                    times = min(often, most_times)
                    branches.append((len(made), (times, use), used + times, waste + times * (capacity - sum(items))))
        if nodes % 16 == 0:  # best fit of what the first branch leaves, as an incumbent
            _, own, so_far, _ = branches[0]
            move(left, own, -1)
            if left:
                tail = best_fit(left, capacity)
                if so_far + bins(tail) < most:
                    best, most = [*made, own, *tail], so_far + bins(tail)
            move(left, own, 1)
        stack += branches[::-1]
    return best


class Places:
    """Where the r-th piece of each length goes: arrays whose size depends on the patterns alone."""

    def __init__(self, patterns: list[Pattern], full: int):
        rows: list[tuple[int, int, int, int, int]] = []
        seen: dict[int, int] = {}
        base = 0
        for times, items in patterns:
            offset = 0
            for length, k in items:
                rows.append((length, seen.get(length, 0), base, k, offset))
                seen[length] = seen.get(length, 0) + times * k
                offset += length * k
            base += times
        rows.append((full, 0, base, 1, 0))
        rows.sort()
        self.length, self.rank, self.base, self.each, self.offset = (np.array(x, np.int64) for x in zip(*rows))
        self.keys = self.length << 44 | self.rank

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, length << 44 | rank, "right") - 1
        nth = rank - self.rank[at]
        return self.base[at] + nth // self.each[at], self.offset[at] + nth % self.each[at] * length


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of tokenise() (materialised) -> the same with sequence_id and offset."""
    parts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    counts.pop(capacity, None)  # full pieces have a sequence each
    found = Places(complete(counts, capacity), capacity)
    sent = pieces.sparkSession.sparkContext.broadcast(found)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = parts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    if parts.count() <= BROADCAST_ROWS:
        ranks = F.broadcast(ranks)
    ranked = pieces.join(ranks, ["part", "length"])

    keep = [c for c in pieces.columns if c not in ("part", "nth")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = dict(zip(batch.schema.names, batch.columns))
            sequence, offset = sent.value.find(at["length"].to_numpy(), at["nth"].to_numpy() + at["before"].to_numpy())
            yield pa.RecordBatch.from_arrays([*[at[c] for c in keep], pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    schema = T.StructType([pieces.schema[c] for c in keep] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.select(*keep, "nth", "before").mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    return place(cut_table(tokenise(docs, path, capacity, id_col, text_col, with_ids)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves: (sequence_id, ids, doc_ids, offsets). Each is at most the capacity long."""
    rows = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(rows.alias("r")).select("sequence_id", F.flatten("r.ids").alias("ids"), F.col("r.doc_id").alias("doc_ids"), F.col("r.offset").alias("offsets"))
