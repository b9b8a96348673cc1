"""Best-fit packing of documents into token sequences by bin completion.

What matters to the packing is how many pieces there are of each length, at most `capacity` numbers, however many documents
there are. The driver solves the packing of this histogram by bin completion: it takes the largest length that remains,
enumerates undominated fillings of the rest of its sequence, least waste first, and branches over them. A branch whose waste
exceeds what any better solution may waste is cut; best-fit decreasing gives the first incumbent. Large packings are improved part by part.
A solution is a short list of (filling, repeats). Pieces then find their places by their rank within their length:
counts by partition and prefix sums give ranks without gathering a length's pieces anywhere.

Cases: a null or empty text is a piece with the end id alone; only documents longer than a sequence are cut, the first of their
pieces taking what is over; repeated and null ids are packed like any others; pieces of equal length take their places in the order of the
input's parts, and rows within these; an empty table gives no rows; other columns, whatever their names, are left alone."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import require, stash, tidy
from .token_files import encoder

Filling = tuple[tuple[int, int], ...]  #: (length, how often), longest first


def spread(bits: int, n: int) -> int:
    """The bits, and each of them moved up by 1 to n places."""
    k = 1
    while n > 0:
        step = min(k, n)
        bits |= bits << step
        n -= step
        k += step
    return bits


def completions(rem: np.ndarray, largest: int, capacity: int, most_waste: int) -> Iterator[tuple[int, Filling]]:
    """(waste, filling) of all undominated fillings around one piece of the largest length, least waste first, with at most `most_waste`.

    They are made one at a time, longer pieces first. A bit set for each length tells which sums the shorter ones can reach, so
    every step of the search leads to a filling of the waste that is sought."""
    rest = capacity - largest
    have = rem[: rest + 1].copy()
    if largest <= rest:
        have[largest] -= 1
    lengths = np.flatnonzero(have)[::-1].tolist()
    number = {a: int(have[a]) for a in lengths}
    there = sum(1 << a for a in lengths)
    below = (1 << (rest + 1)) - 1
    reach = [1] * (len(lengths) + 1)  # bit s of reach[i]: pieces of lengths[i:] can sum to s
    for i in range(len(lengths) - 1, -1, -1):
        r, n, k = reach[i + 1], min(number[lengths[i]], rest // lengths[i]), 1
        while n > 0:
            k = min(k, n)
            r |= (r << (k * lengths[i])) & below
            n, k = n - k, 2 * k
        reach[i] = r

    def fill(i: int, left: int) -> Iterator[Filling]:
        if not left:
            yield ()
        while left and reach[i] >> left & 1:
            a = lengths[i]
            i += 1
            for n in range(min(number[a], left // a), 0, -1):
                if reach[i] >> (left - n * a) & 1:
                    for more in fill(i, left - n * a):
                        yield (a, n), *more

    for waste in range(rest - reach[0].bit_length() + 1, min(most_waste, rest) + 1):
        for filling in fill(0, rest - waste) if reach[0] >> (rest - waste) & 1 else ():
            if not dominated(filling, waste, number, there):
                rest_of = dict(filling)
                yield waste, tuple(sorted((rest_of | {largest: rest_of.get(largest, 0) + 1}).items(), reverse=True))


def dominated(filling: Filling, waste: int, number: dict[int, int], there: int) -> bool:
    """Whether a piece that is left out can take the place of some of the filling's pieces, or of none, and of some of the waste.

    The exchanged filling is no worse: what it sets free fits wherever that piece would lie."""
    one, several, left_out = 1, 0, there  # sums of no piece or one, of two or more; lengths of which a piece is left out
    for a, n in filling:
        if n == number[a]:
            left_out ^= 1 << a
        for _ in range(n):
            several |= (several | one & ~1) << a
            one |= 1 << a
    return bool(spread(several, waste) & left_out or waste and spread(one << 1, waste - 1) & left_out)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[Filling, int]]:
    """Each sequence takes the longest piece that still fits, again and again."""
    rem, out = counts.copy(), []
    while len(lengths := np.flatnonzero(rem)):
        rest, filling = capacity, []
        for length in lengths[::-1].tolist():
            if n := min(int(rem[length]), rest // length):
                filling.append((length, n))
                rest -= n * length
        k = min(int(rem[a]) // n for a, n in filling)
        for a, n in filling:
            rem[a] -= n * k
        out.append((tuple(filling), k))
    return out


def least_bins(counts: np.ndarray, capacity: int) -> int:
    """A lower bound on the sequences: pieces of over half a sequence lie apart, and of the others those of at least `a` tokens can
    only use the room that is left beside pieces of at most capacity - a; the best such bound over all a."""
    lengths = np.arange(capacity + 1)
    n, t = np.cumsum(counts), np.cumsum(counts * lengths)
    half, a = capacity // 2, lengths[: capacity // 2 + 1]
    beside, room = n[capacity - a] - n[half], t[capacity - a] - t[half]
    small = t[half] - np.where(a > 0, t[np.maximum(a - 1, 0)], 0)
    more = np.maximum(0, -(-(small - (beside * capacity - room)) // capacity))
    return int((n[capacity] - n[half] + more).max())


def branch(counts: np.ndarray, capacity: int, most: int, steps: int) -> tuple[list[tuple[Filling, int]] | None, bool]:
    """(a packing into at most `most` sequences or None, whether the search came to its end): bin completion, `steps` fillings at most.

    A filling is first taken as often as the counts allow, then once; both ways lead through all multisets of fillings. What waste
    is allowed bounds every branch, and pieces that have been left over before in as few sequences are not looked at again."""
    allowed = most * capacity - int((counts * np.arange(len(counts))).sum())
    if allowed < 0:
        return None, True
    rem, bins, wasted = counts.copy(), 0, 0
    path: list[tuple[Filling, int, int]] = []
    seen: dict[bytes, int] = {}

    def options() -> Iterator[tuple[Filling, int, int]]:
        for waste, filling in completions(rem, int(np.flatnonzero(rem)[-1]), capacity, allowed - wasted):
            k = min(int(rem[a]) // n for a, n in filling)
            k = min(k, (allowed - wasted) // waste) if waste else k
            yield filling, k, waste
            if k > 1:
                yield filling, 1, waste

    def take(filling: Filling, k: int, waste: int) -> None:
        nonlocal bins, wasted
        for a, n in filling:
            rem[a] -= n * k
        bins, wasted = bins + k, wasted + waste * k

    if not rem.any():
        return [], True
    stack = [options()]
    while stack:
        if steps <= 0:
            return None, False
        option = next(stack[-1], None)
        if option is None:
            stack.pop()
            if path:
                filling, k, waste = path.pop()
                take(filling, -k, waste)
            continue
        steps -= 1
        take(*option)
        if not rem.any():
            return [(f, k) for f, k, _ in [*path, option]], True
        key = rem.tobytes()
        if seen.get(key, most + 1) > bins and bins + least_bins(rem, capacity) <= most:
            seen[key] = bins
            path.append(option)
            stack.append(options())
        else:
            take(option[0], -option[1], option[2])
    return None, True


def solve(counts: np.ndarray, capacity: int, steps: int = 2500, rounds: int = 60, seed: int = 0) -> list[tuple[Filling, int]]:
    """(filling, repeats) that use up counts[length] pieces of each length 1..capacity.

    The first incumbent is best-fit's. Each search asks for one sequence less than the incumbent has, until least_bins is reached or
    the search has come to its end: then the packing is as small as can be. A search over more pieces than `steps` fillings can tell of goes
    on by parts: a part is some of the sequences with the most waste, together one sequence's worth or more, and some others; bin completion looks for a
    packing of its pieces into one sequence less, which then takes the place of the part as often as its sequences repeat. `rounds` parts are
    tried. In any case the packing is whole."""
    least, best = least_bins(counts, capacity), best_fit(counts, capacity)
    while (n := sum(k for _, k in best)) > least:
        found, ended = branch(counts, capacity, n - 1, steps)
        if found is None:
            break
        best = found
    else:
        return best
    if ended:
        return best
    rng = np.random.default_rng(seed)
    waste = lambda f: capacity - sum(a * m for a, m in f)
    held: Counter[Filling] = Counter()
    for filling, k in best:
        held[filling] += k
    fillings, wasteful = list(held), {f: waste(f) for f in held if waste(f)}  # of fillings that are used up, some stay listed
    for turn in range(rounds):
        if n <= least:
            break
        part: Counter[Filling] = Counter()
        room, enough = 0, capacity + turn % 4 * capacity // 4
        for f in sorted(wasteful, key=lambda f: (-wasteful[f] * rng.uniform(0.5, 1), f)):
            part[f] = min(held[f], -(-(enough - room) // wasteful[f]))
            room += part[f] * wasteful[f]
            if room >= enough:
                break
        if room < capacity:
            break  # what is wasted doesn't make a sequence
        for i in rng.choice(len(fillings), min(len(fillings), int(rng.integers(2, 40))), replace=False):
            f = fillings[i]
            if held[f] > part[f]:
                part[f] += 1
        pieces = np.zeros_like(counts)
        for f, m in part.items():
            for a, times in f:
                pieces[a] += times * m
        found, _ = branch(pieces, capacity, sum(part.values()) - 1, steps // 10)
        if found is None:
            continue
        k = min(held[f] // m for f, m in part.items() if m)
        for f, m in part.items():
            held[f] -= m * k
        for f, m in found:
            if f not in held:
                fillings.append(f)
            held[f] += m * k
        wasteful = {f: waste(f) for f in {*wasteful, *(f for f, _ in found)} if held[f] and waste(f)}
        n -= k
    return sorted((+held).items(), reverse=True)


def places(solution: list[tuple[Filling, int]]) -> dict[int, np.ndarray]:
    """By length, rows of (first rank, first sequence, pieces in each sequence, first offset) in order of rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for filling, k in solution:
        at = 0
        for length, n in filling:
            out.setdefault(length, []).append((used.get(length, 0), sequence, n, at))
            used[length] = used.get(length, 0) + n * k
            at += length * n
        sequence += k
    return {a: np.array(rows, np.int64) for a, rows in out.items()}


def pieces(docs: DataFrame, tokenizer: str, end_id: int, spaces: bool, capacity: int, text: str, doc_id: str) -> DataFrame:
    """A row for each piece, with the partition that made it and its rank among that partition's pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, seen, end = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            enc = encoder(tokenizer, spaces)
            rows: list[tuple[int, int, int, int, int]] = []
            for i, ids in enumerate(enc.ids(x.as_py() for x in batch.column(1))):
                ids += end
                n = len(ids) // 4
                if n <= capacity:
                    rows.append((i, 0, 0, n, zlib.crc32(ids)))
                    continue
                start = 0
                for k in range(-(-n // capacity)):
                    length = (n % capacity or capacity) if k == 0 else capacity
                    rows.append((i, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                    start += length
            row, piece, start, length, crc = (np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 5
            order = np.argsort(length, kind="stable")
            same = length[order]
            first = np.searchsorted(same, same)
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(same)) - first + seen[same]
            np.add.at(seen, length, 1)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).take(pa.array(row)), "piece": pa.array(piece.astype(np.int32)), "start": start, "length": length, "ids_crc32": crc, "pid": pa.array(np.full(len(row), pid, np.int32)), "rank": rank})

    rows = require(docs, doc_id, text).toDF("doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(tidy(run, "tokens"), "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, rank long")


def pack(docs: DataFrame, capacity: int = 1024, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, spaces: bool = True, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    made = stash(pieces(docs, tokenizer, end_id, spaces, capacity, text, doc_id), "pieces")
    counts = made.groupBy("pid", "length").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # `capacity` rows at most
        histogram[row.length] = row.n
    at = places(solve(histogram, capacity))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("pid")) - F.col("n"))
    ranked = made.join(before.select("pid", "length", "before"), ["pid", "length"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for a in np.unique(length).tolist():
                of, table = length == a, at[a]
                first, seq, n, start = table[np.searchsorted(table[:, 0], rank[of], "right") - 1].T
                sequence[of] = seq + (rank[of] - first) // n
                offset[of] = start + (rank[of] - first) % n * a
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(tidy(run, "tokens"), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
