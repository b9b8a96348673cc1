"""Language-model scoring by a probabilistic suffix tree over words.

States are the empty context and contexts of 1 to `max_depth` words. The tree is grown level by level. A context is a candidate if the
training text has it `least_count` times or more, which holds for a context only if it does for all its parts; it keeps
the symbols that follow it as often. A candidate is retained if its next-symbol distribution diverges enough from that of the longest
retained state it would fall back to (mean divergence in nats, and the log-likelihood gain over all its occurrences, less a cost for each symbol that it
keeps). Thresholds are counts, not shares, so the tree grows with the corpus. A token is scored by the retained state that is the
longest suffix of what precedes it.

Distributions are smoothed. The root has c + 0.5 for every token and one more for all unknown ones. A longer state gives a symbol that it keeps
its count less `discount`; what is left over goes to the other symbols in proportion to the next shorter retained state, so every
distribution sums to one.

In logarithms the walk from the root to the longest state is a sum: each retained context adds what falling back from it costs, and each
symbol it keeps adds the difference that keeping it makes. So the tree is one table of weights by key, a context's or a context's and
symbol's hash, and a text's score is its score by the root and the weights of all keys that it has. Words, levels and weights are
tables of any size. What tasks get by broadcast is bounded at any size of the corpus: the WORDS most frequent words, the WEIGHTS most
frequent weights, and a filter of BITS bits. Other words, and other keys that pass the filter, are looked up by a join; none of them is among the most frequent, so none is hot.

Keys are 64-bit hashes: with m keys in the tree an absent one is mistaken for one of them with odds of m / 2^64.

Cases: a null or empty text has only the end; documents with a null id are scored and not learnt from; repeated rows are each scored
and learnt from; without any training document all tokens are unknown; of symbols with equal counts all or none are kept; an empty table gives no
rows; other columns, whatever their names, are left alone."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHasher, combine, crc_remainder, drop_stash, i64, require, stash, tidy

#: The end as a token; no word has this hash but by chance of 2^-64.
END = np.uint64(0xE4D0E4D0E4D0E4D1)
#: What a context's key is marked with, as the same words are also a shorter context and its symbol.
CONTEXT = 0x2545F4914F6CDD1D
#: At most so many words, weights and bits of the filter are broadcast; a small corpus takes less.
WORDS = 1 << 20
WEIGHTS = 1 << 21
BITS = 1 << 27
HELD = 1 << 21  #: keys that a task counts at a time
_hasher = WordHasher()


def tokens(col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For slices of texts: first text, hashes of words with END after each text, offsets."""
    for first, words, off in _hasher(col):
        n = len(off) - 1
        out = np.empty(len(words) + n, np.uint64)
        new = off + np.arange(n + 1)
        mark = np.zeros(len(out), bool)
        mark[new[1:] - 1] = True
        out[mark] = END
        out[~mark] = words
        yield first, out, new


def contexts(h: np.ndarray, off: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For 1, 2 .. depth words before: the keys of what stands before each token, those of as many words that end with
    the token itself, and which tokens have so many before them."""
    place = np.arange(len(h)) - np.repeat(off[:-1], np.diff(off))
    gram = h
    for d in range(1, depth + 1):
        before = np.empty_like(gram)
        before[0], before[1:] = 0, gram[:-1]
        yield before, gram, place >= d
        if d < depth:
            gram = combine(before, h)


def key_filter(keys: DataFrame) -> np.ndarray:
    """Two bits for each key (key) in BITS bits at most, whatever the number of keys: what it lets through beyond them only costs a look-up."""
    size = min(BITS, 1 << max(18, (32 * keys.count()).bit_length()))
    at = lambda k: F.shiftrightunsigned("key", 36 * k).bitwiseAND(F.lit(size - 1)) + 1  # noqa: E731  buckets of 32768 count from number 1
    bit = keys.select(F.explode(F.array(at(0), at(1))).alias("bit"))
    words = bit.groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).toArrow()
    out = np.zeros(size // 8, np.uint8)
    for k, bits in zip(words["k"].to_pylist(), words["bits"].to_pylist(), strict=True):  # size / 32768 rows of 4 KB at most
        out[(k - 1) * 4096 : (k - 1) * 4096 + len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def passes(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    ok = None
    for k in (0, 1):
        at = (key >> np.uint64(36 * k)) & np.uint64(8 * len(bits) - 1)
        one = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
        ok = one if ok is None else ok & one
    return ok


class Slots:
    """The values of the most frequent keys, `size` at most: two arrays of places, and a sorted list for those that find theirs taken in both."""

    def __init__(self, size: int, kind: type = np.float64) -> None:
        self.size, self.kind = size, kind
        self.keys, self.values = [], []
        self.last_keys, self.last_values = np.zeros(0, np.uint64), np.zeros(0)

    def fill(self, table: DataFrame) -> DataFrame:
        """table: key, n, value. The rows that are not taken are returned: those of a frequency class that would not fit as a whole, and of all below."""
        grade = F.floor(F.log2("n") * 16).cast("int")
        left, least = self.size, None
        for g, n in sorted(table.groupBy(grade.alias("g")).agg(F.count("*").alias("n")).collect(), reverse=True):  # 16 classes for each power of 2
            if n > left:
                break
            left, least = left - n, g
        if least is None:
            return table
        t = table.where(grade >= least).select("key", "n", "value").toArrow()  # `size` rows at most
        order = np.argsort(-t["n"].to_numpy(), kind="stable")
        key, value = t["key"].to_numpy().astype(np.int64).view(np.uint64)[order], t["value"].to_numpy()[order]
        size = 1 << len(key).bit_length()
        for k in (0, 1):
            size = max(1, size // 2)
            keys, values = np.zeros(size, np.uint64), np.zeros(size, self.kind)
            at, first = np.unique(slot(key, k, size), return_index=True)
            keys[at], values[at] = key[first], value[first]
            self.keys.append(keys)
            self.values.append(values)
            rest = np.ones(len(key), bool)
            rest[first] = False
            key, value = key[rest], value[rest]
        order = np.argsort(key)
        self.last_keys, self.last_values = key[order], value[order]
        return table.where(grade < least)

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of keys, 0 for those that are not here; and the places of these."""
        out, open_ = np.zeros(len(key)), np.arange(len(key))
        for k, (keys, values) in enumerate(zip(self.keys, self.values, strict=True)):
            at = slot(key[open_], k, len(keys))
            hit = keys[at] == key[open_]
            out[open_[hit]] = values[at[hit]]
            open_ = open_[~hit]
        if len(self.last_keys):
            at = np.minimum(np.searchsorted(self.last_keys, key[open_]), len(self.last_keys) - 1)
            hit = self.last_keys[at] == key[open_]
            out[open_[hit]] = self.last_values[at[hit]]
            open_ = open_[~hit]
        return out, open_


def slot(key: np.ndarray, k: int, slots: int) -> np.ndarray:
    return (key >> np.uint64(23 * k)) & np.uint64(slots - 1)


@dataclass
class Model:
    """What tasks get by broadcast."""

    words: Slots  # counts
    total: int
    norm: float  # log10 of what counts are divided by in the root
    depth: int
    weights: Slots
    bits: np.ndarray


def _sums(rows: DataFrame, key, schema: str, least: int = 1) -> DataFrame:
    """Sums over batches of how often each of the keys occurs that key(hashes, offsets) gives as arrays of one length."""
    names = [x.split()[0] for x in schema.split(", ")]

    def summed(parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
        _, at, n = np.unique(columns[0] if len(columns) == 1 else combine(*columns), return_index=True, return_counts=True)
        for i in range(0, len(at), 200_000):
            yield pa.RecordBatch.from_arrays([*(i64(c[at[i : i + 200_000]]) for c in columns), i64(n[i : i + 200_000])], [*names, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for _, h, off in tokens(batch.column(0)):
                parts.append(key(h, off))
                held += len(parts[-1][0])
                if held >= HELD:  # what a task holds, whatever its batches
                    yield from summed(parts)
                    parts, held = [], 0
        if parts:
            yield from summed(parts)

    sums = rows.mapInArrow(tidy(run), schema + ", n long").groupBy(*names).agg(F.sum("n").alias("n"))
    return sums.where(F.col("n") >= least) if least > 1 else sums


def _grams(rows: DataFrame) -> DataFrame:
    """Adds gram, the key of a context (ctx) and its symbol, and lower, that of its shorter context (short) and the symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ctx, sym = (batch.column(c).to_numpy().view(np.uint64) for c in ("ctx", "sym"))
            short = batch.column("short").to_numpy(zero_copy_only=False)
            whole = ~np.isnan(short) if short.dtype.kind == "f" else np.ones(len(ctx), bool)
            lower = sym.copy()
            if whole.any():
                lower[whole] = combine(short[whole].astype(np.int64).view(np.uint64), sym[whole])
            gram = combine(ctx, sym) if len(ctx) else ctx
            yield pa.RecordBatch.from_arrays([*batch.columns, i64(gram), i64(lower)], [*batch.schema.names, "gram", "lower"])

    return rows.mapInArrow(tidy(run), ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", gram long, lower long")


def grow(rows: DataFrame, words: DataFrame, max_depth: int, least_count: int, discount: float, divergence: float, gain: float, charge: float) -> list[DataFrame]:
    """The weights (key, n, w) of the retained states, a list of tables. words: gram (a word), n, short (null), eff (ln of its probability in the root)."""
    spark, out = rows.sparkSession, []
    known = words.where(F.col("n") >= least_count)
    shorter = words.select("gram", "eff")
    for d in range(1, max_depth + 1):
        bits = key_filter(known.select(F.col("gram").alias("key")))

        def pairs(h: np.ndarray, off: np.ndarray, d=d, bits=bits) -> list[np.ndarray]:
            *_, (before, gram, ok) = contexts(h, off, d)  # of what occurs often enough, the parts do too
            at = np.flatnonzero(ok & passes(bits, gram))
            at = at[passes(bits, before[at])]
            return [before[at], h[at]]

        found = _sums(rows, pairs, "ctx long, sym long", least_count)
        of = known.select(F.col("gram").alias("ctx"), F.col("n").alias("total"), "short")
        placed = _grams(found.join(of, "ctx").withColumn("short", F.col("short") if d > 1 else F.lit(None).cast("long")).select("ctx", "sym", "n", "total", "short"))
        # a kept symbol's shorter context keeps it too, as it follows that one at least as often
        level = stash(placed.join(shorter.select(F.col("gram").alias("lower"), "eff"), "lower").select("ctx", "sym", "gram", "lower", "n", "total", "eff"), f"level-{d}")
        held = F.col("n") - discount
        sums = level.groupBy("ctx").agg(F.max("total").alias("total"), F.count("*").alias("m"), F.sum(held * (F.log(held) - F.col("eff"))).alias("a"), F.sum(held).alias("b"), F.sum(F.exp("eff")).alias("c"))
        rest, free = 1 - F.col("b") / F.col("total"), F.greatest(1 - F.col("c"), F.lit(1e-12))
        # nats by which the state's distribution, what is left over included, diverges from the shorter state's
        kl = F.col("a") / F.col("total") - F.col("b") / F.col("total") * F.log("total") + rest * F.log(rest / free)
        states = sums.where((rest > 0) & (kl >= divergence) & (kl * F.col("total") >= gain + charge * F.col("m"))).select("ctx", F.col("total").alias("n"), F.log(rest / free).alias("left"))
        states = stash(states, f"states-{d}")
        own = F.log((F.col("n") - discount) / F.col("total"))
        grown = level.join(states.select("ctx", "left"), "ctx", "left")
        grown = stash(grown.select("ctx", "gram", "lower", "n", F.when(F.col("left").isNull(), F.col("eff")).otherwise(own).alias("eff"), F.when(F.col("left").isNotNull(), own - F.col("eff") - F.col("left")).alias("w")), f"grown-{d}")
        drop_stash(spark, level)
        out += [states.select(F.col("ctx").bitwiseXOR(F.lit(CONTEXT)).alias("key"), "n", F.col("left").alias("w")), grown.where("w IS NOT NULL").select(F.col("gram").alias("key"), "n", "w")]
        known, shorter = grown.select("gram", "n", F.col("lower").alias("short")), grown.select("gram", "eff")
    return out


def train(docs: DataFrame, learn: Column, text: str, doc_id: str, max_depth: int = 3, least_count: int = 8, discount: float = 0.6, divergence: float = 0.02, gain: float = 6.0, charge: float = 2.0) -> tuple[Model, DataFrame, DataFrame]:
    """The model, and the counts of words and the weights in log10 that it does not hold (key, n, value)."""
    spark = docs.sparkSession
    rows = require(docs, doc_id, text).toDF("doc_id", "text").where(learn).select("text")
    counts = stash(_sums(rows, lambda h, off: [h], "key long"), "word-counts")
    got = counts.agg(F.sum("n"), F.count("*")).first()
    n, v = int(got[0] or 0), int(got[1])
    norm = float(np.log10(n + 0.5 * (v + 1)))
    model = Model(Slots(WORDS), n, norm, max_depth, Slots(WEIGHTS, np.float32), np.zeros(4, np.uint8))
    rare = model.words.fill(counts.select("key", "n", F.col("n").cast("double").alias("value")))
    words = counts.select(F.col("key").alias("gram"), "n", F.lit(None).cast("long").alias("short"), (F.log(F.col("n") + 0.5) - float(norm * np.log(10))).alias("eff"))
    weights = None
    for part in grow(rows, words, max_depth, least_count, discount, divergence, gain, charge):
        weights = part if weights is None else weights.union(part)
    weights = stash(weights.select("key", "n", (F.col("w") / float(np.log(10))).alias("value")), "weights")
    model.bits = key_filter(weights)
    return model, rare, model.weights.fill(weights)


def score(docs: DataFrame, learn: Column, text: str = "text", doc_id: str = "doc_id", **parameters) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every document; `learn` selects the training documents by doc_id."""
    spark = docs.sparkSession
    trained, counts, weights = train(docs, learn, text, doc_id, **parameters)
    model = spark.sparkContext.broadcast(trained)
    schema = "doc_id long, uid long, n_tokens long, n_found long, base double, path double, rare array<long>, keys array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, uid = model.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, h, off in tokens(batch.column(1)):
                n = len(off) - 1
                count, rare = t.words.find(h)
                base = np.log10(count + 0.5) - t.norm
                base[rare] = 0
                path, keys, at = np.zeros(len(h)), [], []
                for before, _, ok in contexts(h, off, t.depth):
                    of = np.flatnonzero(ok)
                    for key in (before[of] ^ np.uint64(CONTEXT), combine(before[of], h[of])) if len(of) else ():
                        known = np.flatnonzero(passes(t.bits, key))
                        w, open_ = t.weights.find(key[known])
                        path[of[known]] += w
                        keys.append(key[known[open_]])
                        at.append(of[known[open_]])
                at = np.concatenate([np.zeros(0, np.int64), *at])
                order = np.argsort(at, kind="stable")
                keys, at = np.concatenate([np.zeros(0, np.uint64), *keys])[order], at[order]
                per = lambda y: np.add.reduceat(y, off[:-1])  # noqa: E731  every text has its end, so no segment is empty
                lists = lambda values, ends: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), i64(values))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), i64(uid + np.arange(n)), i64(np.diff(off)), i64(per((count > 0).astype(np.int64))), pa.array(per(base)), pa.array(per(path)), lists(h[rare], np.searchsorted(rare, off)), lists(keys, np.searchsorted(at, off))], ["doc_id", "uid", "n_tokens", "n_found", "base", "path", "rare", "keys"])
                uid += n

    rows = require(docs, doc_id, text).toDF("doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    part = stash(rows.mapInArrow(tidy(run), schema), "scored")
    asked = lambda column: part.select("uid", F.explode(column).alias("key"))
    seen = asked("rare").join(counts, "key", "left")
    rest = seen.select("uid", (F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5)) - F.lit(trained.norm)).alias("rest"), F.when(F.col("n").isNotNull(), 1).otherwise(0).cast("long").alias("seen"), F.lit(0.0).alias("more"))
    more = asked("keys").join(weights, "key").select("uid", F.lit(0.0).alias("rest"), F.lit(0).cast("long").alias("seen"), F.col("value").alias("more"))
    sums = rest.union(more).groupBy("uid").agg(F.sum("rest").alias("rest"), F.sum("seen").alias("seen"), F.sum("more").alias("more"))
    whole = part.drop("rare", "keys").join(sums, "uid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    base = F.col("base") + zero("rest")
    return whole.select("doc_id", "n_tokens", (F.col("n_found") + zero("seen")).alias("n_known"), F.lit(trained.total).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("path") + zero("more")).alias("score"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, F.coalesce(crc_remainder("doc_id", 5) != 1, F.lit(False)))
    return out.withColumn("held_out", F.coalesce(crc_remainder("doc_id", 5) == 1, F.lit(False)))
