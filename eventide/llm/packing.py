"""Packing of documents into sequences of a fixed number of tokens, by bin completion.

The documents' pieces are counted by length, which gives at most `capacity` rows whatever the corpus, and the plan is
made on those counts: around the largest length that is left, undominated fillings are tried in a branch-and-bound
search, which is cut where the waste of a plan of fewer sequences than the incumbent is used up. Pieces then find their place by their number among the pieces of their length.
"""

from __future__ import annotations

import base64
import bisect
import functools
import itertools
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventide.llm.common import materialize, table

CAPACITY = 1024
END_ID = 2
#: The byte-level BPE vocabulary byte_bpe_50k.json in the form of ranks: the same ids, read by a faster library.
VOCABULARY = "byte_bpe_50k.tiktoken"
# The special tokens of byte_bpe_50k.json, which it also finds in plain text.
SPECIAL = {"<|endoftext|>": 50256}
#: Rows of one Arrow batch that are tokenized at once.
SLICE_ROWS = 256
#: Nodes of one search; the best plan so far holds when they are used up.
NODES = 400
#: Dual feasible functions of the lower bound.
DUALS = 32
#: Pieces of one length that are numbered by one task.
NUMBERED = 1000


@functools.cache
def encoder(vocabulary: str):
    """The tokenizer, made once in a worker: making one for every task leaves memory behind."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


@functools.cache
def slow_encoder(vocabulary: str):
    """The tokenizer of the same vocabulary in the tokenizers library, from the .json file beside that of the ranks."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(vocabulary.rpartition(".")[0] + ".json"))


def token_ids(text: str, vocabulary: str) -> list[int]:
    """The ids of text. The faster library gives up on a text with about a million white spaces in a row, where its
    pattern runs out of places to go back to; such a text is read by the slower one."""
    try:
        return encoder(vocabulary).encode(text, allowed_special="all")
    except ValueError:
        return slow_encoder(vocabulary).encode(text, add_special_tokens=False).ids


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n ids: all are full but the first, which takes what is left over."""
    start, length = 0, n % capacity or min(n, capacity)
    while start < n:
        yield start, length
        start, length = start + length, capacity


def pieces(docs: DataFrame, text: str, keys: list[str], capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY) -> DataFrame:
    """keys, piece, start, length and ids_crc32 of every piece of every row of docs; a null text is an empty one."""
    schema = T.StructType([*(docs.schema[k] for k in keys), *(T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType())))])

    def tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                row, found = [], ([], [], [], [])
                for i, doc in enumerate(batch.column(len(keys)).to_pylist()):
                    ids = np.array(token_ids(doc or "", vocabulary), "<u4").tobytes() + end
                    for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        row.append(i)
                        for column, value in zip(found, (k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])), strict=True):
                            column.append(value)
                kept = [batch.column(j).take(pa.array(row, pa.int64())) for j in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(found[0], pa.int32()), *(pa.array(x, pa.int64()) for x in found[1:])], names=schema.fieldNames())

    return docs.select(*(F.col(k) for k in keys), F.col(text)).mapInArrow(tokenized, schema)


@functools.cache
def dual(capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of dual feasible functions of the lengths, and what a whole sequence counts in each: the length itself, and
    for k = 1, 2, .. the whole multiples of 1 / k below x (k + 1) / capacity, or x where (k + 1) x is a multiple of
    capacity. No sequence holds more than a whole one of any of them; with k = 3, say, only three lengths over a
    quarter."""
    k, x = np.arange(1, DUALS + 1)[:, None], np.arange(capacity + 1)
    whole, over = np.divmod((k + 1) * x, capacity)
    return np.vstack([x, np.where(over, whole * capacity, k * x)]), np.concatenate([[[1]], k]) * capacity


def least_bins(counts: np.ndarray) -> int:
    """A lower bound of the bins that the lengths need: the best over dual feasible functions, each also with lengths
    below e left out and those above capacity - e counted as whole bins, for every e up to half the capacity."""
    capacity = len(counts) - 1
    values, one = dual(capacity)
    sums = np.concatenate([np.zeros((DUALS + 1, 1), np.int64), np.cumsum(values * counts, axis=1)], axis=1)
    number = np.concatenate([[0], np.cumsum(counts)])
    e = np.arange(capacity // 2 + 1)
    whole = values[:, capacity:] * (number[-1] - number[capacity - e + 1])
    return int((-(-(sums[:, capacity - e + 1] - sums[:, e] + whole) // one)).max())


def fillings(left: np.ndarray, room: int, most_waste: int, few: bool) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of room by the lengths left that waste at most most_waste, those that waste least first;
    of equal waste either those of fewest pieces first or those of the largest pieces.

    A filling is dominated if one more length fits, or if some of its lengths can give way to a single larger one (or,
    if they are several, one as large) that is left. A table of the sums that the smaller lengths reach leads every
    step to some filling.
    """
    sizes = np.flatnonzero(left[: room + 1]).tolist()
    have = dict(zip(sizes, left[sizes].tolist(), strict=True))
    reached: list[int] = []  # as bits: the sums of the lengths before each

    def prepare() -> list[int]:
        if not reached:
            reached.append(1)
            for s in sizes:
                bits, copies, step = reached[-1], min(have[s], room // s), 1
                while copies:
                    step = min(step, copies)
                    bits |= (bits << s * step) & ((1 << room + 1) - 1)
                    copies, step = copies - step, 2 * step
                reached.append(bits)
        return reached

    def below(most: int) -> Iterator[int]:
        return reversed(sizes[: bisect.bisect_right(sizes, most)])

    def pairs(total: int, most: int) -> Iterator[tuple[int, ...]]:
        for s in below(min(total - 1, most)):
            if 2 * s < total:
                break
            if have.get(total - s, 0) > (2 * s == total):
                yield s, total - s

    def triples(total: int) -> Iterator[tuple[int, ...]]:
        for s in below(total - 2):
            if 3 * s < total:
                break
            yield from ((s, *p) for p in pairs(total - s, s) if have[s] > p.count(s))

    def sums(total: int, top: int) -> Iterator[tuple[int, ...]]:
        """Every choice among the first top lengths, the largest pieces first."""
        if not total:
            yield ()
            return
        for i in range(bisect.bisect_right(sizes, total, 0, top) - 1, -1, -1):
            s = sizes[i]
            if not reached[i + 1] >> total & 1:
                return
            for copies in range(min(have[s], total // s), 0, -1):
                if reached[i] >> total - copies * s & 1:
                    yield from ((s,) * copies + rest for rest in sums(total - copies * s, i))

    def of(total: int) -> Iterator[tuple[int, ...]]:
        if few:
            yield from ((total,) for _ in range(have.get(total, 0) > 0))
            yield from pairs(total, total)
            yield from triples(total)
        if prepare()[-1] >> total & 1:
            yield from (f for f in sums(total, len(sizes)) if not few or len(f) > 3)

    def dominated(chosen: tuple[int, ...], waste: int) -> bool:
        def some(low: int, high: int) -> bool:
            return any(have[y] > chosen.count(y) for y in sizes[bisect.bisect_left(sizes, low) : bisect.bisect_right(sizes, high)])

        if some(1, waste):
            return True
        for n in range(1, min(len(chosen), 4) + 1):
            for part in set(itertools.combinations(chosen, n)):
                if some(sum(part) + (n == 1), sum(part) + waste):
                    return True
        return False

    for waste in range(min(most_waste, room) + 1):
        if waste == room:
            yield from [()] if not sizes else []
        else:
            yield from (f for f in of(room - waste) if not dominated(f, waste))


def best_fit(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: every length, the largest first, goes where it leaves the least room."""
    capacity = len(counts) - 1
    open_bins: dict[int, dict[tuple[int, ...], int]] = {capacity: {(): int(counts.sum())}}
    rooms = [capacity]
    for size in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[size])
        while left:
            room = rooms[bisect.bisect_left(rooms, size)]
            pattern, bins = next(iter(open_bins[room].items()))
            copies = min(room // size, left)
            times = min(bins, left // copies)
            for r, p, change in ((room, pattern, -times), (room - size * copies, pattern + (size,) * copies, times)):
                if r not in open_bins:
                    open_bins[r] = {}
                    bisect.insort(rooms, r)
                open_bins[r][p] = open_bins[r].get(p, 0) + change
                if not open_bins[r][p]:
                    del open_bins[r][p]
                if not open_bins[r]:
                    del open_bins[r]
                    rooms.remove(r)
            left -= copies * times
    return [(p, n) for found in open_bins.values() for p, n in found.items() if p]


def search(counts: np.ndarray, target: int | None, nodes: int, few: bool) -> list[tuple[tuple[int, ...], int]] | None:
    """A plan of at most target sequences, or of any number if target is None; None if there is none, or none is found
    in so many nodes.

    Depth first: around the largest length left, fillings are tried in the order of fillings(), each as often as the
    counts and the waste that target still leaves allow. A branch is cut where the lower bound of the rest is over what
    target leaves.
    """
    capacity = len(counts) - 1
    left = counts.astype(np.int64)
    waste = int(left.sum()) * capacity if target is None else target * capacity - int(left @ np.arange(capacity + 1))
    path: list[tuple[tuple[int, ...], int]] = []
    stack: list[tuple[int, Iterator[tuple[int, ...]]]] = []
    while True:
        if left.any():
            largest = int(np.flatnonzero(left)[-1])
            others = left.copy()
            others[largest] -= 1
            used = sum(times for _, times in path)
            open_ = target is None or used + least_bins(left) <= target
            stack.append((largest, fillings(others, capacity - largest, waste, few) if open_ else iter(())))
        else:
            return path
        while (filling := next(stack[-1][1], None)) is None:
            stack.pop()
            if not path:
                return None
            pattern, times = path.pop()
            np.add.at(left, list(pattern), times)
            waste += (capacity - sum(pattern)) * times
        nodes -= target is not None
        if nodes < 0:
            return None
        pattern = (stack[-1][0], *filling)
        sizes, copies = np.unique(pattern, return_counts=True)
        times, lost = int((left[sizes] // copies).min()), capacity - sum(pattern)
        times = min(times, waste // lost) if lost else times
        left[sizes] -= copies * times
        waste -= lost * times
        path.append((pattern, times))


def plan(counts: np.ndarray, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths, each with the number of sequences that take it; counts[n] pieces have length n.

    The first incumbents are best-fit decreasing and the first leaves of the search in its two orders. Then the search
    asks for the lower bound, and for one sequence less than the incumbent as long as that is found. It ends at the
    lower bound, where the plan is proved to be the best, or when `nodes` nodes of a search are used up.
    """
    if not counts.any():
        return []
    goal = least_bins(counts)

    def used(patterns: list) -> int:
        return sum(times for _, times in patterns)

    best = min([best_fit(counts), *(search(counts, None, 0, few) for few in (False, True))], key=used)
    target = goal
    while used(best) > goal:
        better = search(counts, target, nodes, False) or search(counts, target, nodes, True)
        if better:
            best = better
        elif target >= used(best) - 1:
            break
        target = used(best) - 1
    assert sum(times * sum(pattern) for pattern, times in best) == int(counts @ np.arange(len(counts)))
    return best


def places(patterns: Iterable[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first number, copies in a sequence, first sequence and offset of each run of its pieces."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        offset = 0
        for size in sorted(set(pattern), reverse=True):
            copies = pattern.count(size)
            runs.setdefault(size, []).append((taken.get(size, 0), copies, sequence, offset))
            taken[size] = taken.get(size, 0) + copies * times
            offset += copies * size
        sequence += times
    return {size: tuple(np.array(x, np.int64) for x in zip(*found, strict=True)) for size, found in runs.items()}


def numbered(items: DataFrame, length: str, order: list[str], number: str) -> DataFrame:
    """items with a gapless number among those of equal length. A frequent length is dealt over several tasks: each
    numbers a share, and the sizes of the shares before it are added."""
    shares = F.pmod(F.xxhash64(*order), F.greatest(F.lit(1), F.ceil(F.col("_n") / NUMBERED)))
    sizes = items.groupBy(length).agg(F.count("*").alias("_n"))
    dealt = items.join(F.broadcast(sizes), length).withColumn("_share", shares).drop("_n")
    by_share = dealt.groupBy(length, "_share").agg(F.count("*").alias("_n"))
    before = by_share.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(length).orderBy("_share").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(length, "_share").orderBy(*order))
    return dealt.withColumn("_own", own).join(before, [length, "_share"]).withColumn(number, F.col("_own") - 1 + F.col("_before")).drop("_own", "_before", "_share")


def pack(docs: DataFrame, text: str, keys: list[str], capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str = VOCABULARY) -> DataFrame:
    """Every piece of docs with its sequence and offset: keys, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is an empty one and has the end id alone. Equal rows are packed each for itself. No rows give no
    pieces. Other columns of docs are not looked at.
    """
    found = materialize(pieces(docs, text, keys, capacity, end_id, vocabulary))
    counts = np.zeros(capacity + 1, np.int64)
    for row in found.groupBy("length").count().collect():  # capacity rows at most
        counts[row["length"]] = row["count"]
    where = places(plan(counts))
    schema = T.StructType([*found.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    columns = found.columns

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "_number"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for size in np.unique(length):
                mine = np.flatnonzero(length == size)
                first, copies, start, base = where[int(size)]
                run = np.searchsorted(first, number[mine], "right") - 1
                nth = number[mine] - first[run]
                sequence[mine] = start[run] + nth // copies[run]
                offset[mine] = base[run] + nth % copies[run] * size
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in columns), pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    return numbered(found, "length", [*keys, "piece", "ids_crc32"], "_number").mapInArrow(placed, schema)


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", ["doc_id"])
