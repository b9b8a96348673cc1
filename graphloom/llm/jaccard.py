"""Exact Jaccard join of word n-gram sets with set-relation skipping.

Sets are sorted in one global order, rare shingles first, and two sets that reach the threshold share a shingle of their prefixes.
The index has a list for each prefix shingle. Two kinds of relations between sets save work:

* In a list, entries lie in blocks by position. What follows a position bounds the overlap that a pair can still reach, so whole
  blocks are skipped, by position and by size; a 256-bit parity sketch bounds the symmetric difference of the pairs in the others.
  Before a set is moved, a sketch of a bit or more for each shingle does so for the pairs that are left.
* A set that is highly similar to one whose answers are known is kept as that set, its leader, with what it has more and less. Sets
  that a leader already joins need no comparison for the classes. The others' overlaps are derived from the overlap
  of their leaders, computed once, and the few shingles by which they differ from these.

Stages: (1) sketch every document; equal sets become one. (2) In each list link every set with a first partner in reach, verify
these pairs exactly, and take components. (3) Verify every pair in reach whose sets are still in different components. What is left unverified
joins sets of one component, so components are exact. Nothing is sampled but the table of frequent shingles, which only orders the shingles: any order gives
the same result. All pairs of a group are never listed: a list gives a forest in (2), and in (3) only pairs between components.

A set is compared by 64-bit hashes of its shingles; within a pair of sets of m shingles a collision has odds of m^2 / 2^64.

Cases: a null text or one without words has the empty set and links with nothing; a document with a null id links with nothing and has a
null component; rows that repeat an id are returned each, and link with each other; texts of fewer words than n are one shingle; an empty
table gives no rows; other columns, whatever their names, are left alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHasher, combine, drop_stash, i64, mix, require, stash, tidy, unused
from .components import components

#: About so many documents, by id hash, give the table of frequent shingles, which has HOT rows at most (2 MB).
SAMPLE = 8000
HOT = 1 << 17
#: Lists of more entries are compared leader by leader, block by block.
LONG = 32
#: Size of the filter that lets the texts of index members through to the second pass: 2 MB.
BITS = 1 << 24
POSITIONS = 128  #: entries of a block
#: Bits of the sketches that index entries carry.
SHORT = 256
#: The list of a shingle that the sample lets expect in more documents is dealt into chunks of about so many, which are compared by themselves
#: and then by their leaders.
CHUNK = 1 << 15
ENTRY = ("token", "id", "n", "pos", "s0", "s1", "s2", "s3")
#: What equal sets share.
SAME = ["n_shingles", "d1", "d2"]
_hasher = WordHasher()


def shingle_sets(col: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The set of each text's n-word shingles as sorted distinct hashes."""
    for _, words, off in _hasher(col):
        if len(words) >= n:
            grams = combine(*(words[k : len(words) - n + 1 + k] for k in range(n)))
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            if b - a >= n:
                g = np.sort(grams[a : b - n + 1])
                yield g[np.concatenate([[True], g[1:] != g[:-1]])]
            elif b > a:
                yield combine(*(words[k : k + 1] for k in range(a, b)), words[a : a + 1])
            else:
                yield np.zeros(0, np.uint64)


def least_partner(n: np.ndarray | int, percent: int):
    """The least size of a set that can reach the threshold with one of n; also the least overlap of the two."""
    return -(-percent * n // 100)


def sketches(docs: DataFrame, n: int, percent: int, hot: np.ndarray) -> DataFrame:
    """id, n_shingles, d1, d2 (digest of the set), parity (bits, one or more for each shingle), prefix (its hashes in the global order).

    hot: frequent shingles, rarest first; they come after all others in the global order."""
    order = np.argsort(hot)
    known = hot[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, digests, parities, prefix = [], [], [], []
            for g in shingle_sets(batch.column(1), n):
                m = len(g)
                size.append(m)
                if not m:
                    digests.append((0, 0))
                    parities.append(b"")
                    prefix.append(b"")
                    continue
                digests.append(digest(g))
                parities.append(parity(g).tobytes())
                keep = m - int(least_partner(m, percent)) + 1
                if len(known):
                    at = np.minimum(np.searchsorted(known, g), len(known) - 1)
                    is_hot = known[at] == g
                    cold = g[~is_hot]
                    first = cold[:keep]
                    if len(first) < keep:
                        first = np.concatenate([first, hot[np.sort(order[at[is_hot]])[: keep - len(first)]]])
                else:
                    first = g[:keep]
                prefix.append(first.tobytes())
            d = np.array(digests, np.uint64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), i64(np.array(size, np.int64)), i64(d[:, 0]), i64(d[:, 1]), pa.array(parities, pa.binary()), pa.array(prefix, pa.binary())], ["id", "n_shingles", "d1", "d2", "parity", "prefix"])

    return docs.mapInArrow(tidy(run), "id long, n_shingles long, d1 long, d2 long, parity binary, prefix binary")


def digest(g: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    with np.errstate(over="ignore"):
        return int(g.sum()), int(mix(g ^ np.uint64(0x5851F42D4C957F2D)).sum())


def parity(g: np.ndarray) -> np.ndarray:
    """Bytes of a parity sketch of at least as many bits as there are shingles, a power of 2; the shingle's low bits are its place.

    Two sets differ by at least as many shingles as their sketches differ by bits."""
    bits = 1 << max(SHORT.bit_length() - 1, (len(g) - 1).bit_length())
    return np.packbits((np.bincount((g & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little")


def folded(p: np.ndarray, size: int) -> np.ndarray:
    """The sketch of `size` bytes that a longer one implies."""
    return np.bitwise_xor.reduce(p.reshape(-1, size), axis=0)


def frequent(docs: DataFrame, n: int, sample: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several documents of a bounded sample have, rarest first, the most frequent `rows` of them, and the
    number of all documents that this lets expect to have each."""
    total = docs.count()
    every = max(1, total // sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                token, count = np.unique(np.concatenate([*shingle_sets(batch.column(1), n), np.zeros(0, np.uint64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([i64(token), i64(count)], ["token", "n"])

    some = docs.where(F.pmod(F.xxhash64("id", F.lit(23)), F.lit(every)) == 0)
    counts = some.mapInArrow(tidy(run), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n >= 3")
    got = counts.orderBy(F.col("n").desc(), "token").limit(rows).toArrow()
    token, count = got["token"].to_numpy().astype(np.int64).view(np.uint64), got["n"].to_numpy().astype(np.int64)
    return np.ascontiguousarray(token[::-1]), count[::-1] * every


def _bit(column: str):
    return F.pmod(F.xxhash64(column, F.lit(29)), F.lit(BITS))


def member_bits(members: DataFrame) -> np.ndarray:
    """A filter of BITS bits, whatever the number of members: texts that it lets through beyond the members only cost their sets."""
    bit = members.select((_bit("id") + 1).alias("bit"))  # buckets of 32768 count from number 1
    words = bit.groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    out = np.zeros(BITS // 8, np.uint8)
    for k, bits in words:  # BITS / 32768 rows of 4 KB at most
        at = (k - 1) * 4096
        out[at : at + len(bits)] = np.frombuffer(bits, np.uint8)
    return out


class Entries:
    """Columns of index entries: token, id, n, pos, and s (4 parities), which may be missing."""

    def __init__(self, token, id, n, pos, s, percent: int) -> None:
        self.token, self.id, self.n, self.pos, self.s, self.percent = token, id, n, pos, s, percent

    def reach(self, i, j) -> np.ndarray:
        """Whether sets at i and j, which share the token, may reach the threshold."""
        p, a, b = self.percent, self.n[i], self.n[j]
        need = -(-p * (a + b) // (100 + p))
        ok = (np.minimum(a - self.pos[i], b - self.pos[j]) >= need) & (100 * np.minimum(a, b) >= p * np.maximum(a, b))
        if self.s is not None and ok.any():
            differ = np.bitwise_count(self.s[i] ^ self.s[j]).sum(-1)
            ok &= differ <= a + b - 2 * need
        return ok

    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and sizes of the lists."""
        starts = np.flatnonzero(np.concatenate([[True], self.token[1:] != self.token[:-1]]))
        return starts, np.diff(np.append(starts, len(self.token)))

    def in_company(self) -> np.ndarray:
        """Entries sorted by token: which have a partner in reach; all of those of long lists count as such."""
        _, sizes = self.lists()
        any_ = np.repeat(sizes > LONG, sizes)
        short = np.flatnonzero(~any_)
        token = self.token[short]
        for k in range(1, LONG):
            same = np.flatnonzero(token[k:] == token[:-k])
            if not len(same):
                break
            i, j = short[same], short[same + k]
            ok = self.reach(i, j)
            any_[i[ok]] = any_[j[ok]] = True
        return any_

    def forest(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries sorted by (token, n): pairs (i, j) that link each entry with a first partner in reach, and which entries have any."""
        starts, sizes = self.lists()
        long = np.repeat(sizes > LONG, sizes)
        any_, left, right = np.zeros(len(self.token), bool), [], []
        short = np.flatnonzero(~long)
        token, taken = self.token[short], np.zeros(len(short), bool)
        for k in range(1, LONG):
            same = np.flatnonzero(token[k:] == token[:-k])
            if not len(same):
                break
            i, j = short[same], short[same + k]
            ok = self.reach(i, j)
            any_[i[ok]] = any_[j[ok]] = True
            ok &= ~taken[same + k]
            taken[same[ok] + k] = True
            left.append(i[ok])
            right.append(j[ok])
        for a, size in zip(starts[sizes > LONG].tolist(), sizes[sizes > LONG].tolist(), strict=True):
            i, j = self.leaders(a, a + size)
            any_[i] = any_[j] = True
            left.append(i)
            right.append(j)
        empty = np.zeros(0, np.int64)
        return np.concatenate([empty, *left]), np.concatenate([empty, *right]), any_

    def leaders(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """One long list: its first entry without a partner leads all in reach of it, block by block of positions, until none is left."""
        order = a + np.argsort(self.pos[a:b], kind="stable")
        cuts = np.arange(0, len(order), POSITIONS)
        n, rest = self.n[order], (self.n - self.pos)[order]
        most_n, least_n, most_rest = (f.reduceat(x, cuts) for f, x in ((np.maximum, n), (np.minimum, n), (np.maximum, rest)))
        free, p, left, right = np.ones(len(order), bool), self.percent, [], []
        while len(open_ := np.flatnonzero(free)):
            x = open_[0]
            free[x] = False
            low = least_partner(n[x], p)
            need = -(-p * (n[x] + np.maximum(least_n, low)) // (100 + p))
            blocks = np.flatnonzero((np.minimum(rest[x], most_rest) >= need) & (most_n >= low) & (p * least_n <= 100 * n[x]))
            at = (blocks[:, None] * POSITIONS + np.arange(POSITIONS)).ravel()
            at = at[at < len(order)]
            at = at[at != x]
            hit = at[self.reach(np.full(len(at), order[x]), order[at])]
            new = hit[free[hit]]
            free[new] = False
            first = hit[~np.isin(hit, new)][:1]  # a set that another one leads: the two groups are in reach of each other
            for y in (new, first):
                left.append(np.full(len(y), order[x]))
                right.append(order[y])
        return np.concatenate(left), np.concatenate(right)


def by_list(batches: Iterator[pa.RecordBatch], rows: int = 200_000) -> Iterator[dict[str, np.ndarray]]:
    """Batches sorted by token as columns of whole lists, about `rows` rows at a time."""
    held, n = [], 0

    def columns() -> dict[str, np.ndarray]:
        t = pa.Table.from_batches(held)
        return {k: t[k].to_numpy() for k in t.column_names}

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        token = batch.column("token").to_numpy()
        last = int(np.flatnonzero(token != token[-1])[-1]) + 1 if token[0] != token[-1] else 0  # the list of the last token may go on in the next batch
        if last == 0:
            continue
        held[-1] = batch.slice(0, last)
        yield columns()
        held = [batch.slice(last)]
        n = held[0].num_rows
    if n:
        yield columns()


def postings(reps: DataFrame, hot: np.ndarray, chunks: np.ndarray) -> DataFrame:
    """token, salt, id, np (size and position of the token) of every prefix shingle. hot, sorted: tokens whose lists are dealt into several chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefix = batch.column("prefix").to_pylist()
            size = np.array([len(x) // 8 for x in prefix], np.int64)
            row = np.repeat(np.arange(len(size)), size)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            token = np.frombuffer(b"".join(prefix), np.int64)
            id_, n = (batch.column(c).to_numpy()[row] for c in ("id", "n_shingles"))
            salt = np.zeros(len(row), np.int32)
            if len(hot) and len(row):
                at = np.minimum(np.searchsorted(hot, token), len(hot) - 1)
                of = np.flatnonzero(hot[at] == token)
                with np.errstate(over="ignore"):
                    salt[of] = 1 + (mix(id_[of].view(np.uint64)) % chunks[at[of]].astype(np.uint64)).astype(np.int32)
            for i in range(0, len(row), 200_000):
                cut = slice(i, i + 200_000)
                yield pa.RecordBatch.from_arrays([pa.array(token[cut]), pa.array(salt[cut]), pa.array(id_[cut]), pa.array(n[cut] << 32 | pos[cut])], ["token", "salt", "id", "np"])

    return reps.select("id", "n_shingles", "prefix").mapInArrow(tidy(run), "token long, salt int, id long, np long")


def shared(entries: DataFrame, percent: int) -> DataFrame:
    """Entries (token, salt, id, n, pos) but those that meet no other in reach of them by size and position. Most lists have one entry,
    so this needs no sketches; entries of chunks all stay, as their partners may be in other chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in by_list(batches):
            same = c["token"][1:] == c["token"][:-1]
            of = np.flatnonzero(np.concatenate([[False], same]) | np.concatenate([same, [False]]) | (c["salt"] > 0))
            if not len(of):
                continue
            c = {k: v[of] for k, v in c.items()}
            n, pos = c["np"] >> 32, c["np"] & 0xFFFFFFFF
            stay = Entries(c["token"], c["id"], n, pos, None, percent).in_company() | (c["salt"] > 0)
            yield pa.RecordBatch.from_arrays([pa.array(x[stay]) for x in (c["token"], c["salt"], c["id"], n, pos)], ["token", "salt", "id", "n", "pos"])

    return entries.repartition("token", "salt").sortWithinPartitions("token", "salt").mapInArrow(tidy(run), "token long, salt int, id long, n long, pos long")


def forests(entries: DataFrame, percent: int) -> DataFrame:
    """Of each list, or chunk of one: rows with kind 0, pairs (token = a, id = b) of a forest; with kind 1, the entries that may have a partner;
    of chunks also, with kind 2, those that no other leads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *(i64(x) for x in columns)], ["kind", *ENTRY])

        for c in by_list(batches):
            s = np.stack([c[f"s{k}"] for k in range(4)], 1)
            # a chunk of a token is a list of its own
            e = Entries(c["token"] + c["salt"] * np.int64(0x1E3779B97F4A7C15), c["id"], c["n"], c["pos"], s.view(np.uint64), percent)
            i, j, any_ = e.forest()
            if len(i):
                pairs = np.unique(np.sort(np.stack([e.id[i], e.id[j]], 1), 1), axis=0)
                yield rows(0, *pairs.T, *[np.zeros(len(pairs), np.int64)] * 6)
            chunk = c["salt"] > 0
            leads = chunk.copy()
            leads[j] = False
            for kind, of in ((1, any_ | chunk), (2, leads)):
                if of.any():
                    yield rows(kind, c["token"][of], e.id[of], e.n[of], e.pos[of], *s[of].T)

    return entries.repartition("token", "salt").sortWithinPartitions("token", "salt", "n", "id").mapInArrow(tidy(run), "kind int, " + ", ".join(f"{k} long" for k in ENTRY))


def near(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole parity sketches allow the threshold; sketches are a small part of the sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("m", "n", "x", "y"))
            mask = pa.array([in_reach(m, n, np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8), percent) for m, n, x, y in zip(*columns, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(mask) for c in ("a", "b")], ["a", "b"])

    side = lambda *names: reps.select("id", "n_shingles", "parity").toDF(*names)
    return pairs.join(side("a", "m", "x"), "a").join(side("b", "n", "y"), "b").select("a", "b", "m", "x", "n", "y").mapInArrow(tidy(run), "a long, b long")


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The elements of a, sorted, that b has, sorted."""
    if not len(b):
        return a[:0]
    at = np.searchsorted(b, a)
    return a[b[np.minimum(at, len(b) - 1)] == a]


def verify_leaders(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, linked, and what b has more and less than a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, more, less = [], [], []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = overlap(x, y)
                ok = 100 * len(both) >= percent * (len(x) + len(y) - len(both))
                linked.append(ok)
                more.append(np.setdiff1d(y, both, True).tobytes() if ok else b"")
                less.append(np.setdiff1d(x, both, True).tobytes() if ok else b"")
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_()), pa.array(more, pa.binary()), pa.array(less, pa.binary())], ["a", "b", "linked", "more", "less"])

    joined = pairs.join(sets.toDF("a", "x").hint("merge"), "a").join(sets.toDF("b", "y").hint("merge"), "b").select("a", "b", "x", "y")
    return joined.mapInArrow(tidy(run), "a long, b long, linked boolean, more binary, less binary")


def verify_rest(pairs: DataFrame, sets: DataFrame, family: DataFrame, percent: int) -> DataFrame:
    """The linked ones of pairs (a, b), by the overlap of their leaders and what sets a leader and its follower apart.

    family: id, leader, more, less; a set that is not in it leads itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[tuple[int, int], np.ndarray] | None = None
        for batch in batches:
            linked = []
            columns = [batch.column(c) for c in ("la", "lb", "x", "y", "a_more", "a_less", "b_more", "b_less")]
            for la, lb, *blobs in zip(*columns, strict=True):
                x, y, am, al, bm, bl = (np.frombuffer(v.as_buffer() if v.is_valid else b"", np.uint64) for v in blobs)
                key = (la.as_py(), lb.as_py())
                if kept is None or kept[0] != key:
                    kept = key, overlap(x, y)
                both = kept[1]
                gone = np.union1d(al, bl)
                size = len(both) - len(overlap(gone, both)) + len(overlap(am, y)) - len(overlap(am, bl)) + len(overlap(bm, x)) - len(overlap(bm, al)) + len(overlap(am, bm))
                total = len(x) + len(am) - len(al) + len(y) + len(bm) - len(bl)
                linked.append(100 * size >= percent * (total - size))
            mask = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], ["a", "b"])

    side = lambda s: family.select(F.col("id").alias(s), F.col("leader").alias(f"l{s}"), F.col("more").alias(f"{s}_more"), F.col("less").alias(f"{s}_less"))
    led = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").withColumn("la", F.coalesce("la", "a")).withColumn("lb", F.coalesce("lb", "b"))
    joined = led.join(sets.toDF("la", "x").hint("merge"), "la").join(sets.toDF("lb", "y").hint("merge"), "lb").sortWithinPartitions("la", "lb")
    return joined.mapInArrow(tidy(run), "a long, b long")


def rest_pairs(entries: DataFrame, label: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs in reach, by their whole parity sketches too, whose sets are in different components: from the lists in which more than one is left.

    In each list the sets outside its largest component meet all others. A long list is dealt into chunks: every entry is at home in one of them,
    and those outside the largest component are guests in the others, so a task holds a chunk and the guests of a batch."""
    e = entries.select("token", "id", "n", "pos").join(label.toDF("id", "c"), "id", "left").withColumn("c", F.coalesce("c", "id"))
    per = e.groupBy("token", "c").agg(F.count("*").alias("k"))
    mixed = per.groupBy("token").agg(F.max_by("c", F.struct("k", "c")).alias("major"), F.count("*").alias("cs"), F.ceil(F.sum("k") / CHUNK).cast("int").alias("chunks")).where("cs > 1").select("token", "major", "chunks")
    e = e.join(mixed, "token").join(reps.select("id", "parity"), "id")
    home = F.pmod(F.xxhash64("id"), F.col("chunks").cast("long")).cast("int")
    at = F.when(F.col("c") == F.col("major"), F.array(home)).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = e.withColumn("home", home).withColumn("chunk", F.explode(at)).select("token", "chunk", (F.col("home") == F.col("chunk")).alias("home"), (F.col("c") != F.col("major")).alias("minor"), "id", "n", "pos", "c", "parity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in by_list(batches, 100_000):
            own = c["token"] + c["chunk"] * np.int64(0x1E3779B97F4A7C15)
            parities = [np.frombuffer(x, np.uint8) for x in c["parity"]]
            s = np.array([folded(x, SHORT // 8) for x in parities], np.uint8).reshape(-1, SHORT // 8).view(np.uint64)
            t = Entries(own, c["id"], c["n"], c["pos"], s, percent)
            found: set[tuple[int, int]] = set()
            for start, size in zip(*(x.tolist() for x in t.lists()), strict=True):
                minor = start + np.flatnonzero(c["minor"][start : start + size])
                homes = start + np.flatnonzero(c["home"][start : start + size])
                step = max(1, 500_000 // max(1, len(homes)))
                for k in range(0, len(minor), step):
                    x, y = (z.ravel() for z in np.meshgrid(minor[k : k + step], homes, indexing="ij"))
                    once = (c["c"][x] != c["c"][y]) & (~c["minor"][y] | (c["id"][x] < c["id"][y]))
                    x, y = x[once], y[once]
                    ok = t.reach(x, y)
                    for i, j in zip(x[ok].tolist(), y[ok].tolist(), strict=True):
                        pair = (int(min(c["id"][i], c["id"][j])), int(max(c["id"][i], c["id"][j])))
                        if pair not in found and in_reach(int(c["n"][i]), int(c["n"][j]), parities[i], parities[j], percent):
                            found.add(pair)
            pairs = np.array(sorted(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return dealt.repartition("token", "chunk").sortWithinPartitions("token", "chunk").mapInArrow(tidy(run), "a long, b long").distinct()


def in_reach(m: int, n: int, x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether sets of sizes m and n with these sketches may reach the threshold."""
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum()) <= m + n - 2 * -(-percent * (m + n) // (100 + percent))


def fetch(rows: DataFrame, members: DataFrame, reps: DataFrame, n: int) -> DataFrame:
    """The sets (id, g) of the members (id), made again from the texts that have them."""
    wanted = stash(members.distinct().join(reps.select("id", "doc", *SAME), "id"), "members")
    bits = member_bits(wanted.select(F.col("doc").alias("id")))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)))
            for i in range(0, batch.num_rows, 512):
                part, made = batch.slice(i, 512), {}
                for g in shingle_sets(part.column(1), n):
                    made[len(g), *digest(g)] = g.tobytes()
                d = np.array([k[1:] for k in made], np.uint64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in made], pa.int64()), i64(d[:, 0]), i64(d[:, 1]), pa.array(made.values(), pa.binary())], [*SAME, "g"])

    made = rows.where("id IS NOT NULL").withColumn("bit", _bit("id")).mapInArrow(tidy(sets_of), "n_shingles long, d1 long, d2 long, g binary")
    sets = stash(made.join(wanted.drop("doc"), SAME).select("id", "g").dropDuplicates(["id"]), "sets")
    drop_stash(rows.sparkSession, wanted)
    return sets


def join(docs: DataFrame, n: int = 4, percent: int = 85, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE, hot_rows: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; links are pairs with percent / 100 of their shingles in common."""
    spark = docs.sparkSession
    rows = require(docs, doc_id, text).toDF("id", "text").select(F.col("id").cast("long").alias("id"), "text")
    hot, expected = frequent(rows, n, sample, hot_rows)
    sketch = stash(sketches(rows, n, percent, hot), "sketches")
    doc = stash(sketch.select("id", *SAME), "documents")
    # one node, numbered from here on, for all documents of equal sets; `doc` is the least of these
    some = sketch.where("n_shingles > 0 AND id IS NOT NULL")
    reps = some.groupBy(*SAME).agg(F.min(F.struct("id", "parity", "prefix")).alias("r"), F.count("*").alias("copies"))
    reps = reps.select(F.monotonically_increasing_id().alias("id"), *SAME, "copies", F.col("r.id").alias("doc"), F.col("r.parity").alias("parity"), F.col("r.prefix").alias("prefix"))
    reps = stash(reps, "sets-once")
    drop_stash(spark, sketch)

    long = expected > CHUNK
    order = np.argsort(hot[long].view(np.int64))
    met = stash(shared(postings(reps, hot[long].view(np.int64)[order], -(-expected[long] // CHUNK)[order]), percent), "postings")
    found = stash(forests(met.join(short_parities(reps), "id"), percent), "lists")
    drop_stash(spark, met)
    leaders = found.where("kind = 2").drop("kind").withColumn("salt", F.lit(0))
    joined = stash(forests(leaders, percent).where("kind = 0"), "leaders")  # the chunks of a list meet by their leaders
    tree = found.where("kind = 0").union(joined)
    pairs = stash(near(tree.select(F.col("token").alias("a"), F.col("id").alias("b")).distinct(), reps, percent), "pairs")
    entries = found.where("kind = 1").drop("kind")

    sets = fetch(rows, pairs.select(F.explode(F.array("a", "b")).alias("id")), reps, n)
    first = stash(verify_leaders(pairs, sets, percent), "verified")
    for x in (joined, pairs, sets):
        drop_stash(spark, x)
    links = first.where("linked").select("a", "b").union(of_one_id(doc, reps))
    label = stash(components(links), "labels")
    open_ = stash(rest_pairs(entries, label, reps, percent).join(first.select("a", "b"), ["a", "b"], "left_anti"), "open-pairs")
    drop_stash(spark, found)
    if not open_.isEmpty():
        ends = open_.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        leads = first.where("linked").groupBy("b").agg(F.min(F.struct("a", "more", "less")).alias("f"))
        family = stash(leads.select(F.col("b").alias("id"), "f.*").join(ends, "id", "left_semi").withColumnRenamed("a", "leader"), "family")
        sets = fetch(rows, ends.join(family, "id", "left_anti").union(family.select("leader")), reps, n)
        more = stash(verify_rest(open_, sets, family, percent), "more-links")
        drop_stash(spark, sets)
        drop_stash(spark, family)
        if not more.isEmpty():
            label = stash(components(label.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more)), "labels")

    of = reps.select("id", "doc", "copies", *SAME).join(label, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = of.groupBy("component").agg(F.min("doc").alias("component_id"))
    named = of.join(least, "component").where("copies > 1 OR doc <> component_id").select(*SAME, "component_id")
    out = doc.join(stash(named, "named"), SAME, "left")
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))


def short_parities(reps: DataFrame) -> DataFrame:
    """id, s0..s3: the sketches of SHORT bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.array([folded(np.frombuffer(p, np.uint8), SHORT // 8) for p in batch.column("parity").to_pylist()], np.uint8).reshape(-1, SHORT // 8).view(np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(i64(s[:, k]) for k in range(4))], ["id", "s0", "s1", "s2", "s3"])

    return reps.select("id", "parity").mapInArrow(tidy(run), "id long, s0 long, s1 long, s2 long, s3 long")


def of_one_id(doc: DataFrame, reps: DataFrame) -> DataFrame:
    """Links (a, b) between the sets of documents that share an id."""
    known = doc.where("n_shingles > 0 AND id IS NOT NULL")
    several = known.groupBy("id").count().where("count > 1").select("id")
    of = known.join(several, "id", "left_semi").distinct().join(reps.select(F.col("id").alias("b"), *SAME), SAME).select("id", "b")
    return of.join(of.groupBy("id").agg(F.min("b").alias("a")), "id").where("a <> b").select("a", "b")


def one_of_each(docs: DataFrame, n: int = 4, percent: int = 85, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows, with all their columns, of one document of each component: the one of least id.

    A node is a row key, the hash of id and text, so rows that repeat an id go only if their texts are near copies. Of equal ids
    with equal texts one row stays, the one of least hash of its columns but maps. Rows with a null id are held against each other, and one of each component stays beside
    the one with an id. Texts without words are no near copies of anything, so all of them stay."""
    name = unused("key", docs.columns)
    id_, text_ = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    key = F.when(text_.rlike(r"[^\x20\x09-\x0D]"), F.xxhash64(id_.isNull(), id_.cast("string"), text_))
    keys = stash(docs.select(key.alias("key"), id_.alias("id")).where("key IS NOT NULL"), "keys")
    repeated = stash(keys.groupBy("key").count().where("count > 1").select(F.col("key").alias(name)), "repeated")
    keyed = docs.withColumn(name, key)
    if not repeated.isEmpty():
        plain = [f"`{f.name}`" for f in docs.schema if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
        whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        first = keyed.join(repeated, name, "left_semi").groupBy(name).agg(F.min_by(whole, F.xxhash64(*plain)).alias("row"))
        keyed = stash(keyed.join(repeated, name, "left_anti").select(*[f"`{c}`" for c in docs.columns], name).union(first.select("row.*", name)), "once")
    rows = keyed.where(F.col(name).isNotNull()).select(F.col(name).alias("key"), text_.alias("text"))
    classes = stash(join(rows, n, percent, "text", "key").select(F.col("doc_id").alias("key"), "component_id"), "classes")
    several = classes.groupBy("component_id").count().where("count > 1").select("component_id")
    members = stash(classes.join(several, "component_id").join(keys.distinct(), "key").select("key", "id", "component_id"), "members")
    stays = members.groupBy("component_id", F.col("id").isNull().alias("no_id")).agg(F.min(F.struct("id", "key")).alias("m"))
    gone = stash(members.select(F.col("key").alias(name)).join(stays.select(F.col("m.key").alias(name)), name, "left_anti"), "gone")
    for x in (keys, repeated, classes, members):
        drop_stash(docs.sparkSession, x)
    return keyed.join(gone, name, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
    WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
          ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM w),
    t AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
          GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (min(a.n) + min(b.n) - count(*))),
    e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
    r AS (WITH RECURSIVE c(id, x) AS (SELECT doc_id, doc_id FROM documents UNION SELECT c.id, e.b FROM c JOIN e ON c.x = e.a) SELECT id, min(x) AS component_id FROM c GROUP BY id)
    SELECT s.doc_id, len(s.s) AS n_shingles, r.component_id FROM s JOIN r ON r.id = s.doc_id"""
