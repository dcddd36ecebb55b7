"""Best-fit packing of documents into fixed-length training sequences.

The documents' token ids are cut into pieces of at most ``capacity`` ids (only
longer documents are cut), and the pieces are packed into as few sequences of
``capacity`` ids as the search finds.

Packing needs only how many pieces there are of each length, a table of at
most ``capacity`` rows whatever the corpus holds.  ``plan_bins`` works on that
histogram by bin completion: it takes the largest remaining length, lists
undominated fillings of the space beside it, and searches depth first,
pruning by the waste a better solution may still have.  Best-fit decreasing
gives the incumbent.  A pattern is first applied as often as its pieces allow,
once only as the alternative, and a node with a single child costs nothing, so
the search acts alike at every size of corpus.  The fillings of a node are made
as backtracking asks for them, all of them in the end.  The search ends at the
lower bound, when all is searched, or after ``node_limit`` choices (or
``STEPS`` times as many nodes) with the best solution so far; every piece is
placed in any case.  Spark then gives each piece its rank among the pieces
of its length and looks up the rank's place in the plan.

Defined cases: a NULL text is an empty one; an empty text is one piece with
the end id alone; a NULL ``doc_id`` stays NULL; repeated rows are packed each;
an empty table gives no rows; columns other than ``doc_id`` and ``text`` are
not read.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabforge.llm.tokens import default_tokenizer, encoder
from tabforge.session import written

CAPACITY = 2048
NODE_LIMIT = 3000        # choices of the search beyond the first incumbent
STEPS = 2               # nodes, forced ones included, for each of these
LIVE = 16               # nodes of the search whose further children are held
DOMINATED = 200         # dominated fillings in a row that are left out; the next is taken as it is
FILLING_LENGTHS = 192   # different lengths that the first fillings of a node choose from
_RANK_BITS = 44         # ranks within one length stay below 2**44

Pattern = tuple[tuple[int, int], ...]          # ((length, copies), ...), longest first
PIECE_FIELDS = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ---------------------------------------------------------------- the plan

def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """No packing has fewer bins (area bound and Martello-Toth's L2)."""
    by = np.zeros(capacity + 1, dtype=object)
    for length, n in counts.items():
        by[length] = n
    n_to = np.cumsum(by)                                  # pieces of length <= i
    sum_to = np.cumsum(by * np.arange(capacity + 1))
    half = capacity // 2
    best = -(-int(sum_to[-1]) // capacity)
    for a in range(half + 1):
        large = n_to[-1] - n_to[capacity - a]             # longer than capacity - a: alone
        mid = n_to[capacity - a] - n_to[half]             # no two of them together
        room = mid * capacity - (sum_to[capacity - a] - sum_to[half])
        small = sum_to[half] - (sum_to[a - 1] if a else 0)
        best = max(best, int(large + mid + max(0, -(-(small - room) // capacity))))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on the histogram: bins with the same content are one
    entry, so the work follows the number of lengths, not of pieces."""
    open_bins: dict[int, list[tuple[Pattern, int]]] = {}
    done: list[tuple[Pattern, int]] = []
    least = min(counts, default=0)

    def put(pattern: Pattern, n: int, room: int) -> None:
        if n > 0:
            (open_bins.setdefault(room, []) if room >= least else done).append((pattern, n))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in sorted(r for r in open_bins if r >= length):
            if not left:
                break
            per, groups = room // length, open_bins.pop(room)
            for pattern, n in groups:
                full = min(n, left // per)
                rest = left - full * per if full < n else 0
                put(pattern + ((length, per),), full, room - per * length)
                if rest:
                    put(pattern + ((length, rest),), 1, room - rest * length)
                put(pattern, n - full - (rest > 0), room)
                left -= full * per + rest
        per = capacity // length
        if left:
            put(((length, per),), left // per, capacity - per * length)
            if left % per:
                put(((length, left % per),), 1, capacity - left % per * length)
    return done + [g for groups in open_bins.values() for g in groups]


def fillings(counts: dict[int, int], room: int) -> Iterator[Pattern]:
    """Undominated fillings of ``room`` from the lengths in ``counts``, least
    waste first: those of some lengths, then, when asked for, the others.

    Reachable sums are kept as bit sets per suffix of the lengths, so the walk
    enters no branch that misses its target sum.  A filling is dominated when
    some of its pieces (two or more, or one shorter) can be replaced by one
    longer remaining piece within the room it leaves.
    """
    lengths = [x for x in sorted(counts, reverse=True) if x <= room and counts[x] > 0]
    if len(lengths) <= FILLING_LENGTHS:
        yield from _fillings(counts, room, lengths)
        return
    half = FILLING_LENGTHS // 2             # the longest, and others evenly spread
    some = lengths[:half] + lengths[half::-(-(len(lengths) - half) // half)]
    yield from _fillings(counts, room, some)
    among = set(some)
    yield from (f for f in _fillings(counts, room, lengths) if not all(x in among for x, _ in f))


def _fillings(counts: dict[int, int], room: int, lengths: list[int]) -> Iterator[Pattern]:
    reach = [1] * (len(lengths) + 1)
    mask = (1 << (room + 1)) - 1
    for i in range(len(lengths) - 1, -1, -1):
        bits, n, step = reach[i + 1], min(counts[lengths[i]], room // lengths[i]), 1
        while n > 0:
            take = min(step, n)
            bits |= (bits << (take * lengths[i])) & mask
            n -= take
            step *= 2
        reach[i] = bits
    skipped = [0]

    def dominated(pattern: Pattern, slack: int) -> bool:
        used = dict(pattern)
        parts = [x for x, k in pattern for _ in range(k)]
        sums = {x: 1 for x in parts}
        for i, x in enumerate(parts):
            for y in parts[i + 1:]:
                sums.setdefault(x + y, 2)
        for s, size in sums.items():
            for y in range(s if size > 1 else s + 1, min(s + slack, room) + 1):
                if counts.get(y, 0) > used.get(y, 0):
                    return True
        return False

    def walk(i: int, left: int, have: Pattern, slack: int) -> Iterator[Pattern]:
        if left == 0:
            skipped[0] = skipped[0] + 1 if skipped[0] < DOMINATED and dominated(have, slack) else 0
            if not skipped[0]:
                yield have
            return
        while i < len(lengths):
            x = lengths[i]
            for k in range(min(left // x, counts[x]), 0, -1):
                if reach[i + 1] >> (left - k * x) & 1:
                    yield from walk(i + 1, left - k * x, have + ((x, k),), slack)
            i += 1
            if not reach[i] >> left & 1:
                return

    for total in range(room, -1, -1):
        if reach[0] >> total & 1:
            yield from walk(0, total, (), room - total)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY, node_limit: int = NODE_LIMIT) -> list[tuple[Pattern, int]]:
    """Patterns and how many bins follow each; together they hold every piece."""
    counts = {x: int(n) for x, n in counts.items() if n > 0}
    if not counts:
        return []
    bound = lower_bound(counts, capacity)
    best = best_fit(counts, capacity)
    size = sum(n for _, n in best)
    total = sum(x * n for x, n in counts.items())
    choices = nodes = 0

    def children(left: dict[int, int]) -> Iterator[tuple[dict[int, int], Pattern, int, int]]:
        """Pattern (as counts too), how often, and its waste."""
        largest = max(left)
        others = left | {largest: left[largest] - 1}
        for filling in fillings(others, capacity - largest):
            inside = dict(filling)
            inside[largest] = inside.get(largest, 0) + 1
            pattern = tuple(sorted(inside.items(), reverse=True))
            gap = capacity - sum(x * k for x, k in pattern)
            most = min(left[x] // k for x, k in pattern)
            yield inside, pattern, most, gap
            if most > 1:
                yield inside, pattern, 1, gap

    # What is left at the top of the stack; going back puts a pattern's pieces back.
    left = dict(counts)
    # A node: the plan up to it as a chain, its bins, its waste, its further children, children so far.
    # Only the last LIVE nodes hold their further children: another makes them anew, past those it has had.
    stack: list[list] = [[None, 0, 0, None, 0]]

    def back() -> None:
        chain = stack.pop()[0]
        if chain:
            for x, k in chain[0][0]:
                left[x] = left.get(x, 0) + k * chain[0][1]

    while stack and size > bound and choices < node_limit and nodes < STEPS * node_limit:
        node = stack[-1]
        chain, used, waste, further, n_tried = node
        most = max(left)
        if waste > (size - 1) * capacity - total or n_tried and not any(x <= capacity - most for x in left):
            back()      # no better solution is below, or the pattern it had is the only one: nothing fits beside the largest piece
            continue
        if further is None:
            further = node[3] = itertools.islice(children(dict(left)), n_tried, None)
            if len(stack) > LIVE:
                stack[-LIVE - 1][3] = None
        child = next(further, None)
        if child is None:
            back()
            continue
        node[4] += 1
        choices += n_tried > 0 or len(left) > 1 and min(left) <= capacity - most
        nodes += 1
        inside, pattern, m, gap = child
        if waste + m * gap > (size - 1) * capacity - total:
            continue
        for x, k in pattern:
            left[x] -= m * k
            if not left[x]:
                del left[x]
        link, used = ((pattern, m), chain), used + m
        stack.append([link, used, waste + m * gap, None, 0])
        if not left or nodes % 64 == 1:
            rest = best_fit(left, capacity)
            if used + sum(n for _, n in rest) < size:
                size, best, at = used + sum(n for _, n in rest), rest, link
                while at:
                    best, at = [*best, at[0]], at[1]
        if not left:
            back()
    return best


def plan_table(plan: list[tuple[Pattern, int]]) -> dict[str, np.ndarray]:
    """The plan as sorted arrays: for each length, runs of ranks and their bins."""
    rank: dict[int, int] = {}
    rows, first = [], 0
    for pattern, n in plan:
        at = 0
        for length, k in pattern:
            rows.append((length << _RANK_BITS | rank.get(length, 0), k, first, at))
            rank[length] = rank.get(length, 0) + n * k
            at += k * length
        first += n
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(-1, 4)
    return dict(zip(("key", "per", "first", "at"), cols.T))


# ---------------------------------------------------------------- the Spark job

def cut_pieces(docs: DataFrame, capacity: int, end_id: int, tokenizer: str, with_ids: bool) -> DataFrame:
    """One row per piece, with the task (``part``) that made it and its rank
    (``seq``) among that task's pieces of the same length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        encode = encoder(tokenizer).encode
        end = np.array([end_id], "<u4").tobytes()
        seen = [0] * (capacity + 1)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist())):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    raw = ids[at:at + 4 * capacity]
                    n = len(raw) // 4
                    rows.append((doc, piece, at // 4, n, zlib.crc32(raw), part, seen[n], *([raw] if with_ids else [])))
                    seen[n] += 1
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.binary()] * with_ids
    schema = PIECE_FIELDS + ", part int, seq long" + ", ids binary" * with_ids
    names = [f.strip().split(" ")[0] for f in schema.split(",")]
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, tokenizer: str | None = None,
                   with_ids: bool = False, node_limit: int = NODE_LIMIT) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` and, with
    ``with_ids``, the piece's ids as little-endian uint32 ``binary``."""
    pieces = written(cut_pieces(docs, capacity, end_id, tokenizer or default_tokenizer(), with_ids), "pieces")
    per_task = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    counts = per_task.groupBy("length").agg(F.sum("n").alias("n"))
    # at most `capacity` rows come to the driver, and at most 63 lengths meet in one pattern
    table = plan_table(plan_bins({r.length: r.n for r in counts.collect()}, capacity, node_limit))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    shared = docs.sparkSession.sparkContext.broadcast(table)
    ranked = pieces.join(offsets, ["part", "length"]).withColumn("rank", F.col("before") + F.col("seq"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            key = (length << _RANK_BITS) | batch.column("rank").to_numpy()
            e = np.searchsorted(plan["key"], key, side="right") - 1
            nth = key - plan["key"][e]
            sequence = plan["first"][e] + nth // plan["per"][e]
            offset = plan["at"][e] + nth % plan["per"][e] * length
            rest = [batch.column("ids")] if with_ids else []
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(sequence), pa.array(offset)] + rest,
                                             names + ["sequence_id", "offset"] + ["ids"] * with_ids)

    fields = PIECE_FIELDS + ", sequence_id long, offset long" + ", ids binary" * with_ids
    return ranked.select(*names, "rank", *(["ids"] if with_ids else [])).mapInArrow(place, fields)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences of ``pack_documents(..., with_ids=True)``: their ids
    in order and the document of each piece.  A group holds ``capacity`` ids at most."""
    grouped = packed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("p"), F.sum("length").alias("length"))
    return grouped.select("sequence_id", "length", F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets"),
                          F.aggregate(F.col("p.ids"), F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))
