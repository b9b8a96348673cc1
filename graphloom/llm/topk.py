"""Exact top-k search by inner product: ball-tree branch and bound in each shard.

Every partition of the candidates packs its rows into shards of bounded size, and shards are dealt into groups of a few. A group's task gets each of its
shards once and builds a ball tree of it: nodes hold a centre, a radius and the least id below. Then the queries stream past, in blocks. For each block
the task keeps the k best so far and shares the current kth score among all shards and nodes it visits, the shard that promises most first. A task
holds its group's trees and one block, whatever the number of queries. The inner product of a query q with anything in a node is
at most q.centre + |q| * radius; nodes are visited in falling order of that bound and left out where it can't reach the
kth score. Results of the tasks meet in one window of k rows a task for each query.

Components are whole numbers, floor(scale * x). They are multiplied as doubles where every sum stays below 2^53, else as 64-bit
integers, so scores are exact as long as they fit 64 bits.

Cases: vectors that are null, empty or hold a null or non-finite component take no part, nor do rows with a null id; a query
meets vectors of its own length only; rows that repeat an id are queries and candidates each, and a query meets all rows but its own where
rows are told apart by a column of row numbers, else all of another id; ties go to the smaller id; an empty table gives no rows; other columns,
whatever their names, are left alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import require, stash

SHARD = 4096
BLOCK = 512
LEAF = 64
#: Shards whose trees a task holds at a time, of about SHARD * 16 bytes for each component.
GROUP = 16


def tree(x: np.ndarray, ids: np.ndarray, own: np.ndarray) -> dict[str, np.ndarray]:
    """A ball tree over the rows: nodes in breadth-first order, node i with children 2i + 1 and 2i + 2, and the rows in order."""
    depth = max(0, int(np.ceil(np.log2(max(1, len(x)) / LEAF))))
    order = np.arange(len(x))
    bounds = [np.array([0, len(x)])]
    f = x.astype(np.float64)
    for _ in range(depth):
        cut = [0]
        for a, b in zip(bounds[-1][:-1], bounds[-1][1:], strict=True):
            part, m = order[a:b], (a + b) // 2
            if b - a > 1:
                c = f[part]
                far = c[np.square(c - c.mean(0)).sum(1).argmax()]
                other = c[np.square(c - far).sum(1).argmax()]
                order[a:b] = part[np.argpartition(c @ (other - far), m - a)]
            cut += [m, b]
        bounds.append(np.array(cut))
    centres, radii, least, starts, ends = [], [], [], [], []
    for level in bounds:
        for a, b in zip(level[:-1], level[1:], strict=True):
            part = f[order[a:b]]
            c = part.mean(0) if b > a else np.zeros(x.shape[1])
            centres.append(c)
            radii.append(np.sqrt(np.square(part - c).sum(1).max()) if b > a else -np.inf)
            least.append(ids[order[a:b]].min() if b > a else np.iinfo(np.int64).max)
            starts.append(a)
            ends.append(b)
    return {"x": x[order], "ids": ids[order], "own": own[order], "centre": np.array(centres), "radius": np.array(radii), "least": np.array(least), "start": np.array(starts), "end": np.array(ends), "depth": np.array(depth)}


class Best:
    """The k best (score, id) of each query of a block so far."""

    def __init__(self, q: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> None:
        self.q, self.ids, self.own, self.k = q, ids, own, k
        self.f = q.astype(np.float64)
        self.norm = np.sqrt(np.square(self.f).sum(1))
        self.score = np.full((len(q), k), np.iinfo(np.int64).min)
        self.of = np.full((len(q), k), np.iinfo(np.int64).max)

    def reach(self, bound: np.ndarray, least: int) -> np.ndarray:
        """Which queries may still gain from a node with these bounds, whose least id is given."""
        kth = self.score[:, -1].astype(np.float64)
        slack = 1e-9 * np.abs(bound) + 1e-6
        return (bound + slack > kth) & ((bound - slack > kth) | (least < self.of[:, -1]) | (bound + slack >= kth + 1))

    def offer(self, rows: np.ndarray, score: np.ndarray, ids: np.ndarray, own: np.ndarray) -> None:
        """score: rows x candidates."""
        kth, last = self.score[rows, -1][:, None], self.of[rows, -1][:, None]
        gain = ((score > kth) | ((score == kth) & (ids[None] < last))) & (own[None] != self.own[rows][:, None])
        hit, which = np.nonzero(gain)
        if not len(hit):
            return
        touched, hit_at = np.unique(hit, return_inverse=True)
        own = rows[touched]
        row = np.concatenate([np.repeat(np.arange(len(own)), self.k), hit_at])
        s = np.concatenate([self.score[own].ravel(), score[hit, which]])
        i = np.concatenate([self.of[own].ravel(), ids[which]])
        order = np.lexsort((i, ~s, row))
        row, s, i = row[order], s[order], i[order]
        at = np.arange(len(row)) - np.searchsorted(row, row)
        top = at < self.k
        self.score[own[row[top]], at[top]] = s[top]
        self.of[own[row[top]], at[top]] = i[top]

    def search(self, t: dict[str, np.ndarray]) -> None:
        bound = self.f @ t["centre"].T + self.norm[:, None] * t["radius"][None]
        big = float(np.abs(t["x"]).max(initial=0)) * float(np.abs(self.q).max(initial=0)) * self.q.shape[1]
        exact = big < 2.0**53
        x = t["x"].astype(np.float64) if exact else t["x"]
        leaves = 2 ** int(t["depth"]) - 1
        stack = [0]
        while stack:
            i = stack.pop()
            rows = np.flatnonzero(self.reach(bound[:, i], int(t["least"][i])))
            if not len(rows) or t["start"][i] == t["end"][i]:
                continue
            if i < leaves:
                left, right = 2 * i + 1, 2 * i + 2
                # the child that promises more comes first, and its finds cut the other
                stack += [right, left] if bound[rows, left].mean() >= bound[rows, right].mean() else [left, right]
                continue
            a, b = int(t["start"][i]), int(t["end"][i])
            score = (self.f[rows] @ x[a:b].T).astype(np.int64) if exact else self.q[rows] @ x[a:b].T
            self.offer(rows, score, t["ids"][a:b], t["own"][a:b])

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        full = self.of != np.iinfo(np.int64).max
        n = full.sum(1)
        return np.repeat(self.ids, n), np.repeat(self.own, n), self.of[full], self.score[full]

    def promise(self, t: dict[str, np.ndarray]) -> float:
        """How much a tree's root promises to the block's queries on the whole."""
        return float((self.f @ t["centre"][0] + self.norm * t["radius"][0]).mean())


def _packed(df: DataFrame, size: int, scale: float) -> DataFrame:
    """Rows (id, own, vector) of each partition packed into blocks of at most `size` of one length: dim, ids, own, x (64-bit whole numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

        def block(dim: int, n: int) -> pa.RecordBatch:
            ids, own, x = (np.concatenate([h[k] for h in held[dim]]) for k in (0, 1, 2))
            held[dim] = [(ids[n:], own[n:], x[n:])]
            return pa.RecordBatch.from_pydict({"dim": pa.array([dim], pa.int32()), "ids": [ids[:n].tobytes()], "own": [own[:n].tobytes()], "x": [x[:n].tobytes()]})

        for batch in batches:
            ids, own, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
            flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            if len(flat) and np.abs(flat).max() >= 2.0**62:
                raise ValueError("a scaled component does not fit 64 bits")
            ends = np.cumsum(sizes)
            for dim in np.unique(sizes).tolist():
                of = np.flatnonzero(sizes == dim)
                x = flat[(ends[of] - dim)[:, None] + np.arange(dim)].astype(np.int64)
                held.setdefault(dim, []).append((ids[of], own[of], x))
                while sum(len(h[0]) for h in held[dim]) >= size:
                    yield block(dim, size)
        for dim in held:
            if sum(len(h[0]) for h in held[dim]):
                yield block(dim, size)

    return df.mapInArrow(run, "dim int, ids binary, own binary, x binary")


def valid(vector: Column) -> Column:
    """Not null, not empty, every component finite."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def search(queries: DataFrame, candidates: DataFrame, k: int = 20, scale: float = 64.0, vec_id: str = "vec_id", vector: str = "embedding", row: str | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k candidates of largest inner product with each query.

    row: a column that tells rows apart, the same in both tables; without it a row is told by its id."""
    own = F.col(f"`{row or vec_id}`").cast("long")
    clean = lambda df: df.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), own.alias("own"), F.col(f"`{vector}`").alias("v")).where(F.col("vec_id").isNotNull() & F.col("own").isNotNull() & valid(F.col("v")))
    spark = candidates.sparkSession
    parallel = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    shards = stash(_packed(clean(candidates), SHARD, scale), "shards")
    n = shards.count()
    groups = max(min(n, parallel), -(-n // GROUP), 1)
    placed = shards.withColumn("part", F.pmod(F.xxhash64("own"), F.lit(groups)).cast("int")).withColumn("kind", F.lit(0))
    blocks = _packed(clean(queries).repartition(parallel, "own"), BLOCK, scale)
    asks = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("kind", F.lit(1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, trees = None, {}
        for batch in batches:
            for at, kind, dim, *blobs in zip(*(batch.column(c).to_pylist() for c in ("part", "kind", "dim", "ids", "own", "x")), strict=True):
                if at != part:
                    part, trees = at, {}
                ids, own_, x = (np.frombuffer(v, np.int64) for v in blobs)
                if kind == 0:
                    trees.setdefault(dim, []).append(tree(x.reshape(-1, dim), ids, own_))
                    continue
                best = Best(x.reshape(-1, dim), ids, own_, k)
                for t in sorted(trees.get(dim, []), key=best.promise, reverse=True):
                    best.search(t)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in best.rows()], ["query_id", "query", "vec_id", "score"])

    # a group's shards come before the blocks, so a task builds its trees first
    dealt = placed.unionByName(asks).repartition(groups, "part").sortWithinPartitions("part", "kind")
    found = dealt.mapInArrow(run, "query_id long, query long, vec_id long, score long")
    w = Window.partitionBy("query_id", "query").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = require(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding").withColumn("row", F.monotonically_increasing_id())
    rows = stash(rows, "rows")  # where a row's number is the same for both sides
    return search(rows.where(F.col("vec_id") % 20 == 0), rows, row="row")


ORACLE = """
    WITH e AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
               WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS score
          FROM e q JOIN e c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
