"""Best-fit packing of tokenized documents into fixed-length sequences by bin completion.

Documents are tokenized (plus an end id) and cut into pieces of at most ``capacity`` ids; only
lengths are packed. Pieces are dealt evenly into groups of a bounded number of pieces, each
group is packed by itself, and the groups' sequences are simply numbered apart: against one
global packing this costs less than one sequence a group.

In a group, best-fit decreasing gives the first incumbent. Where it exceeds the lower bound,
a branch-and-bound walks bin by bin: around the largest piece left it enumerates the fillings of the
rest from all lengths left, the least wasteful first, passes over dominated ones, goes on with the
next filling on backtracking, and abandons a branch whose waste so far rules out fewer sequences
than the incumbent. The search ends at the lower bound, when all fillings were tried, or after
``nodes`` of them; the incumbent is always a whole packing.

Nulls: a null text is the empty text (its one end id is packed); null or repeated ids are kept
as they are, row by row. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import math
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netpulse.llm.common import id_text, materialize
from netpulse.llm.tokens import Encoder

CAPACITY = 2048
GROUP_PIECES = 8192  # pieces that one task packs together
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"


def tokenized_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0,
                     id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of every whole document: its place in the document, length and crc32."""

    def run(batches):
        enc = Encoder(tokenizer)
        end = np.array([end_id], np.uint32)
        row = 0
        for batch in batches:
            ids, cols = batch.column(0).to_pylist(), [[], [], [], [], [], []]
            for a, b, tokens, ends in enc.encode(batch.column(1)):
                for doc_id, text in zip(ids[a:b], np.split(tokens, ends[:-1])):
                    text = np.concatenate([text, end]).astype("<u4")
                    for k in range(0, len(text), capacity):
                        part = text[k : k + capacity]
                        row += 1
                        for c, v in zip(cols, (doc_id, k // capacity, k, len(part), zlib.crc32(part), row)):
                            c.append(v)
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "row"])

    return id_text(docs, id_col, text_col).mapInArrow(run, PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: each length goes to the fullest open bin that holds it."""
    free: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for x in sorted(lengths, reverse=True):
        i = bisect.bisect_left(free, (x, -1))
        if i < len(free):
            room, b = free.pop(i)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(x)
        if room > x:
            bisect.insort(free, (room - x, b))
    return bins


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The larger of the total over the capacity and, for each split point, the bins that long
    pieces force: a piece over capacity - k shares with none of at least k."""
    if len(lengths) == 0:
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    number, total = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    best = math.ceil(int(total[-1]) / capacity)
    for k in range(1, capacity // 2 + 1):
        big = number[-1] - number[capacity - k]  # over capacity - k: alone
        mid = number[capacity - k] - number[capacity // 2]  # over half, up to capacity - k: one a bin
        mid_sum = total[capacity - k] - total[capacity // 2]
        small = total[capacity // 2] - total[k - 1]  # k to half
        best = max(best, int(big + mid + max(0, math.ceil((small - (mid * capacity - mid_sum)) / capacity))))
    return best


class _Left:
    """Pieces left: their number by length, and the distinct lengths in order and as a bit mask."""

    def __init__(self, lengths: list[int], capacity: int) -> None:
        self.count = [0] * (capacity + 1)
        self.lengths: list[int] = []
        self.mask = 0
        for x in lengths:
            self.put(x)

    def put(self, x: int) -> None:
        if not self.count[x]:
            bisect.insort(self.lengths, x)
            self.mask |= 1 << x
        self.count[x] += 1

    def take(self, x: int) -> None:
        self.count[x] -= 1
        if not self.count[x]:
            del self.lengths[bisect.bisect_left(self.lengths, x)]
            self.mask ^= 1 << x

    def longest(self, room: int) -> int:
        i = bisect.bisect_right(self.lengths, room)
        return self.lengths[i - 1] if i else -1


def dominated(left: _Left, filling: tuple[int, ...], waste: int) -> bool:
    """Whether a piece that is left can replace pieces of the filling that are together shorter (none
    of them, too, where the waste holds it), or two or more that are together as long."""
    one, more = 0, 0  # sums of one piece, and of two or more, as bits
    for x in filling:
        more |= (more | one) << x
        one |= 1 << x
    span, wide = (1 | one | more) << 1, 1
    while wide < waste:  # every sum, longer by 1 to ``waste``
        step = min(wide, waste - wide)
        span |= span << step
        wide += step
    others = left.mask
    for x in set(filling):
        if left.count[x] == filling.count(x):
            others ^= 1 << x
    return bool(((span if waste else 0) | more) & others)


def fillings(left: _Left, room: int, common_first: bool = False) -> Iterator[tuple[int, tuple[int, ...], bool]]:
    """All fillings of ``room`` as (waste, pieces, dominated), least waste first and then longest (or
    most common) piece first, one at a time: subset sums over the distinct lengths tell where a filling
    can be completed. ``left`` has to be in the same state whenever the next one is drawn."""
    whole = (1 << (room + 1)) - 1
    lengths = left.lengths[: bisect.bisect_right(left.lengths, room)]
    reach = [1]  # sums of the shortest lengths as bits; of more lengths than that, every sum
    for x in lengths:
        sums = reach[-1]
        if sums == whole:
            break
        for _ in range(min(left.count[x], room // x)):
            if (longer := (sums | sums << x) & whole) == sums:
                break
            sums = longer
        reach.append(sums)
    last = len(reach) - 1

    def exact(i: int, need: int) -> Iterator[tuple[int, ...]]:
        if need == 0:
            yield ()
            return
        i = bisect.bisect_right(lengths, need, 0, i)
        if not reach[min(i, last)] >> need & 1:
            return
        longest = range(i - 1, -1, -1)  # of the filling; the rest is shorter
        for j in sorted(longest, key=lambda j: -left.count[lengths[j]]) if common_first else longest:
            x, below = lengths[j], reach[min(j, last)]
            for k in range(min(left.count[x], need // x), 0, -1):
                if below >> (need - k * x) & 1:
                    for rest in exact(j, need - k * x):
                        yield (x,) * k + rest

    sums = reach[last]
    while sums:
        need = sums.bit_length() - 1
        sums ^= 1 << need
        for filling in exact(len(lengths), need):
            yield room - need, filling, dominated(left, filling, room - need)


def bin_completion(lengths: list[int], capacity: int, nodes: int) -> list[list[int]]:
    """The fewest bins found: best-fit decreasing, improved by two branch-and-bound searches, one for
    each order of equally wasteful fillings, that look at ``nodes`` fillings together."""
    best = best_fit(lengths, capacity)
    bound = lower_bound(np.array(lengths, np.int64), capacity)
    for common_first in (False, True):
        if len(best) > bound:
            best = _search(best, bound, lengths, capacity, nodes // 2, common_first)
    return best


def _search(best: list[list[int]], bound: int, lengths: list[int], capacity: int, nodes: int,
            common_first: bool) -> list[list[int]]:
    """``best``, or the packing in fewest bins that bin completion finds."""
    total = sum(lengths)
    left = _Left(lengths, capacity)
    # (bin, its waste, fillings drawn for it, their generator); a bin that was not yet revised keeps no generator
    path: list[tuple[tuple[int, ...], int, int, Iterator | None]] = []
    waste, spent, n_left = 0, 0, len(lengths)
    options, drawn, revised = None, 0, False
    while spent < nodes:
        largest = left.longest(capacity)  # a bin around the largest piece left
        left.take(largest)
        if options is None:
            options = islice(fillings(left, capacity - largest, common_first), drawn, None)
        w, filling, worse = next(options, (capacity, (), True))
        left.put(largest)
        drawn += 1
        spent += 1
        if waste + w <= (len(best) - 1) * capacity - total:
            if worse:
                continue
            chosen = (largest, *filling)
            for x in chosen:
                left.take(x)
            n_left -= len(chosen)
            waste += w
            path.append((chosen, w, drawn, options if revised else None))
            options, drawn, revised = None, 0, False
            if n_left:
                continue
            if len(path) < len(best):
                best = [list(c) for c, _, _, _ in path]
            if len(best) <= bound:
                break
        if not path:
            break
        chosen, w, drawn, options = path.pop()
        for x in chosen:
            left.put(x)
        n_left += len(chosen)
        waste -= w
        revised = True
    return best


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Give every piece (columns of ``PIECES``) its sequence and its place there."""
    pieces = materialize(pieces)
    groups = max(1, math.ceil(pieces.count() / group_pieces))

    def run(table: pa.Table) -> pa.Table:
        length = table.column("length").to_numpy()
        group = table.column("grp")[0].as_py()
        bins = bin_completion(length.tolist(), capacity, nodes=2 * len(length))
        rows: dict[int, list[int]] = {}
        for i, x in enumerate(length.tolist()):
            rows.setdefault(x, []).append(i)
        seq, at = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for b, members in enumerate(bins):
            place = 0
            for x in members:
                i = rows[x].pop()
                seq[i], at[i] = (group << 32) | b, place
                place += x
        return (table.drop_columns(["row", "grp"]).append_column("sequence_id", pa.array(seq))
                .append_column("offset", pa.array(at)))

    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "row"), F.lit(groups)))
    schema = PIECES.replace(", row long", "") + ", sequence_id long, offset long"
    return dealt.groupBy("grp").applyInArrow(run, schema)


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0,
                     id_col: str = "doc_id", text_col: str = "text",
                     group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Tokenize, cut and pack whole documents; one row per piece."""
    return pack(tokenized_pieces(docs, tokenizer, capacity, end_id, id_col, text_col), capacity, group_pieces)
