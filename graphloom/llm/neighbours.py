"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors link when their cosine reaches the threshold, that is, when their squared distance is at most 2 - 2 * threshold. They are
rotated by a fixed random rotation and split into blocks of few dimensions. If the squared distances of all blocks exceeded their
proportional shares of that budget, the whole would exceed it; so linked vectors are within the share in one block at least.

Each block is a range join over a grid on its first dimensions, cut at their medians. No vector is copied into further cells: a vector meets the
cells whose nearest corner is within the share by all of the grid's dimensions together. The grid lives in the task that holds the
vectors, and has a dimension more whenever they double. A pair is verified in double precision, and counted by the first block that
has it in range only. So the union of the candidates needs no list of pairs: a task gives the links of each vector, summed, and a forest that joins its
components.

Equal vectors of a label become one before the join, with their number. The vectors of a label are one group in one task up to CELL rows. Larger
labels are written once, in chunks of CELL rows, to the shared folder; a task holds one chunk and reads up to RUN chunks that it meets, so no
label is gathered whole and none of its vectors is shuffled for each pair of chunks.

Cases: vectors that are null, empty, zero or hold a null or non-finite component, rows without a label and rows without an id link with
nothing (component: their own id); vectors of different lengths don't link; rows that repeat an id are vectors of their own, with the
same component; vectors at the threshold, and ties of any kind, are compared alike; an empty table gives no rows; other columns, whatever their
names, are left alone."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .common import require, scratch, stash, tidy
from .components import components
from .token_files import _fs
from .topk import valid

BLOCK_DIMS = 16
CELL = 65_536  #: rows of a chunk, fewer for vectors of more than 64 components
COMPONENTS = 1 << 22  #: of a chunk's vectors together
RUN = 4  #: chunks that a task reads for the one it holds
GRID_ROWS = 128  #: rows of a grid's cell, about
SLACK = 1e-9
ROUGH = 1e-5  #: what 4-byte components may be wrong by in a squared distance
BATCH = 16_384  #: candidates verified at a time


def scaled(v: np.ndarray) -> np.ndarray:
    """Vectors divided by powers of 2, which is exact, so that their largest components are near 1."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])


class Space:
    """The rotation, the blocks and their budgets for vectors of one length."""

    def __init__(self, dim: int, threshold: float) -> None:
        q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
        self.rotation = q * np.sign(np.diag(r))
        blocks = max(1, dim // BLOCK_DIMS)
        self.cuts = np.array([len(x) for x in np.array_split(np.arange(dim), blocks)]).cumsum()
        self.starts = np.concatenate([[0], self.cuts[:-1]])
        self.budget = (2 - 2 * threshold) * (self.cuts - self.starts) / dim + SLACK
        self.threshold = threshold

    def in_range(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """pairs x blocks: whether a block's squared distance is within its share."""
        return np.add.reduceat(np.square(x - y), self.starts, axis=1) <= self.budget


class Chunk:
    """Vectors of one label and length: the rows of a task."""

    def __init__(self, space: Space, rows: pa.Table) -> None:
        self.row, self.ids, self.count = (rows.column(c).to_numpy() for c in ("row", "id", "m"))
        flat = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.v = scaled(flat.reshape(len(rows), -1).astype(np.float64))
        self.norm = np.sqrt(np.square(self.v).sum(1))
        self.u = (self.v / self.norm[:, None]) @ space.rotation
        self.links = np.zeros(len(rows), np.int64)


class Grid:
    """A chunk's rows in a block, by cell: a cell is one side or the other of the medians of the first dimensions."""

    def __init__(self, x: np.ndarray) -> None:
        n, dims = x.shape
        g = min(dims, max(0, int(np.log2(max(1, n // GRID_ROWS)))))
        self.at = np.median(x[:, :g], axis=0).astype(np.float32) if g else np.zeros(0, np.float32)
        code = ((x[:, :g] > self.at) << np.arange(g)).sum(1)
        self.order = np.argsort(code, kind="stable")
        cells, starts = np.unique(code[self.order], return_index=True)
        self.ends = [*starts.tolist(), n]
        upper = cells[:, None] >> np.arange(g) & 1
        self.crossed = np.concatenate([1 - upper, upper], axis=1).astype(np.float32)  #: which medians lie between a cell and a row above or below them
        self.x = Grid.padded(x)[self.order]

    @staticmethod
    def padded(x: np.ndarray) -> np.ndarray:
        half = np.square(x).sum(1, keepdims=True) / -2
        return np.concatenate([x, half, np.ones_like(half)], axis=1)

    def near(self, y: np.ndarray, budget: float) -> np.ndarray:
        """cells x rows of y: whether a row can be in range of a cell's rows."""
        d = y[:, : len(self.at)] - self.at
        return self.crossed @ np.concatenate([np.square(np.maximum(d, 0)), np.square(np.minimum(d, 0))], axis=1).T <= budget


def _forest(n: int, i: np.ndarray, j: np.ndarray, root: np.ndarray) -> None:
    """Join the components of i and j, given and kept as each node's least node."""
    while True:
        a, b = root[i], root[j]
        if (a == b).all():
            return
        np.minimum.at(root, a, b)
        np.minimum.at(root, b, a)
        while (root != root[root]).any():
            root[:] = root[root]


def candidates(grid: Grid, y: np.ndarray | None, budget: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of the grid, rows of y) that are in range by the block's components; without y, pairs of the grid's own rows, each once."""
    own = y is None
    dims = grid.x.shape[1] - 2
    z = grid.x[:, [*range(dims), -1, -2]] if own else Grid.padded(y)[:, [*range(dims), -1, -2]]  # the product with a row of the grid is half the squared distance, negated
    for a in range(0, len(z), 4096):
        part = z[a : a + 4096]
        for cell, near in enumerate(grid.near(part[:, :dims], budget)):
            s, e = grid.ends[cell : cell + 2]
            if own and s >= a + len(part):
                break
            of = np.flatnonzero(near)
            if own and s > a:
                of = of[np.searchsorted(of, s - a) :]
            if not len(of):
                continue
            there = part[of].T
            for k in range(s, e, 512):
                hit = np.flatnonzero((grid.x[k : min(k + 512, e)] @ there).ravel() >= -budget / 2)
                i, j = k + hit // len(of), a + of[hit % len(of)]
                if own:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    yield grid.order[i], grid.order[j] if own else j


def meet(space: Space, a: Chunk, b: Chunk, grids: list[Grid]) -> tuple[np.ndarray, np.ndarray]:
    """Count the links between the chunks, or within one, and return ids of a forest that joins their components."""
    n = len(a.v)
    root = np.arange(n if a is b else n + len(b.v))
    for block, grid in enumerate(grids):
        y = None if a is b else b.u[:, space.starts[block] : space.cuts[block]].astype(np.float32)
        for i, j in candidates(grid, y, float(space.budget[block]) + ROUGH):
            for k in range(0, len(i), BATCH):
                x, y_ = i[k : k + BATCH], j[k : k + BATCH]
                ok = np.einsum("nd,nd->n", a.v[x], b.v[y_]) / (a.norm[x] * b.norm[y_]) >= space.threshold
                x, y_ = x[ok], y_[ok]
                hit = space.in_range(a.u[x], b.u[y_])
                first = hit[:, block] & ~hit[:, :block].any(1)
                x, y_ = x[first], y_[first]
                np.add.at(a.links, x, b.count[y_])
                np.add.at(b.links, y_, a.count[x])
                _forest(len(root), x, y_ if a is b else y_ + n, root)
    ids, joined = a.ids if a is b else np.concatenate([a.ids, b.ids]), np.flatnonzero(root != np.arange(len(root)))
    return ids[joined], ids[root[joined]]


def meet_all(space: Space, a: Chunk, others: Iterator[Chunk]) -> pa.RecordBatch:
    """Links of rows (kind 0: row, links) and edges of a forest (kind 1: id, id) of a chunk and those it meets, itself perhaps among them."""
    grids = [Grid(a.u[:, x:y].astype(np.float32)) for x, y in zip(space.starts, space.cuts, strict=True)] if len(a.v) else []
    kind, left, right = [], [], []

    def add(k: int, x: np.ndarray, y: np.ndarray) -> None:
        kind.append(np.full(len(x), k, np.int32))
        left.append(x)
        right.append(y)

    def add_links(c: Chunk) -> None:
        some = np.flatnonzero(c.links)
        add(0, c.row[some], c.links[some])

    for b in others:
        add(1, *meet(space, a, b, grids))
        if b is not a:
            add_links(b)
    add_links(a)
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in ((kind, pa.int32()), (left, pa.int64()), (right, pa.int64()))], ["kind", "a", "b"])


def _read(path: str, group: int, chunk: int) -> pa.Table | None:
    """The rows of a written chunk; None if it has none."""
    from pyarrow import fs as files
    from pyarrow import parquet

    fs, folder = _fs(path)
    found = fs.get_file_info(files.FileSelector(f"{folder}/group={group}/chunk={chunk}", allow_not_found=True))
    tables = []
    for f in found:
        if f.base_name.endswith(".parquet"):
            with fs.open_input_file(f.path) as source:
                tables.append(parquet.ParquetFile(source).read())
    return pa.concat_tables(tables) if tables else None


def join(rows: DataFrame, threshold: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row; links join vectors of one label whose cosine is at least the threshold."""
    all_ = require(rows, vec_id, vector, label).toDF("vec_id", "v", "label").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v"), F.col("label").cast("string").alias("label"))
    element = getattr(rows.schema[vector].dataType, "elementType", None)
    stored = "array<float>" if isinstance(element, FloatType) else "array<double>"  # cells carry vectors as their column holds them
    most = F.array_max(F.transform("v", lambda x: F.abs(x)))
    takes_part = valid(F.col("v")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.coalesce(most > 0, F.lit(False))
    distinct = all_.where(takes_part).groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("m"))
    distinct = stash(distinct.withColumn("row", F.monotonically_increasing_id()), "vectors")
    spaces: dict[int, Space] = {}

    def space(dim: int) -> Space:
        if dim not in spaces:
            spaces[dim] = Space(dim, threshold)
        return spaces[dim]

    key = ["label", "dim"]
    met_schema = "kind int, a long, b long"
    rows_of = distinct.select("label", F.size("v").alias("dim"), "row", "id", "m", F.col("v").cast(stored).alias("v"))
    size = F.greatest(F.lit(1), F.least(F.lit(CELL), F.floor(F.lit(COMPONENTS) / F.col("dim"))))
    large = rows_of.groupBy(*key).agg(F.count("*").alias("n")).withColumn("chunks", F.ceil(F.col("n") / size).cast("int")).where("chunks > 1")
    large = stash(large.select(*key, "chunks", F.monotonically_increasing_id().alias("group")), "large")

    def within(group: pa.Table) -> pa.Table:
        sp = space(group.column("dim")[0].as_py())
        a = Chunk(sp, group)
        return pa.Table.from_batches([meet_all(sp, a, iter([a]))])

    met = rows_of.join(large, key, "left_anti").groupBy(*key).applyInArrow(within, met_schema)
    if runs := large.selectExpr("sum((chunks + 1) * (1 + chunks / 2))").first()[0]:
        path = scratch(rows.sparkSession, "chunks")
        split = rows_of.join(F.broadcast(large), key).withColumn("chunk", F.pmod(F.xxhash64("row", F.lit(5)), F.col("chunks").cast("long")).cast("int"))
        split.select("group", "chunk", "row", "id", "m", "v").repartition("group", "chunk").write.partitionBy("group", "chunk").parquet(path)

        def between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for group, dim, i, j, chunks in zip(*(batch.column(c).to_pylist() for c in ("group", "dim", "i", "j", "chunks")), strict=True):
                    if (held := _read(path, group, i)) is None:
                        continue
                    sp = space(dim)
                    a = Chunk(sp, held)
                    del held
                    read = (_read(path, group, k) if k > i else None for k in range(j, min(j + RUN, chunks)))
                    others = (Chunk(sp, t) for t in read if t is not None)
                    yield meet_all(sp, a, itertools.chain([a] if i == j else [], others))

        pairs = large.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("j", F.explode(F.sequence(F.col("i"), F.col("chunks") - 1, F.lit(RUN))))
        met = met.union(pairs.repartition(int(min(runs, 10_000))).mapInArrow(tidy(between), met_schema))
    met = stash(met, "vector-links")
    number = met.where("kind = 0").groupBy(F.col("a").alias("row")).agg(F.sum("b").alias("links"))
    classes = components(met.where("kind = 1").select("a", "b"))
    hashed = F.xxhash64("label", "v").alias("h")  # sorts faster than a vector
    known = distinct.join(number, "row", "left").join(classes, "id", "left").select(hashed, "label", "v", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    whole = all_.where(takes_part).withColumn("h", hashed).join(known, ["h", "label", "v"]).select("vec_id", "n_links", "component_id")
    alone = all_.where(~takes_part).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return whole.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
    WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
    o AS (SELECT * FROM e WHERE v IS NOT NULL AND label IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(v, lambda x: x * x)) > 0),
    p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM o a JOIN o b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
    r AS (WITH RECURSIVE c(id, x) AS (SELECT vec_id, vec_id FROM e UNION SELECT c.id, p.b FROM c JOIN p ON c.x = p.a) SELECT id, min(x) AS component_id FROM c GROUP BY id),
    n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
    SELECT e.vec_id, coalesce(n.n, 0) AS n_links, r.component_id, e.vec_id = r.component_id AS kept
    FROM e JOIN r ON r.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""
