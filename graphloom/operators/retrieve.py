"""Hybrid retrieval: lexical, vector and graph candidates, fused by reciprocal rank and weighted by age and importance."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..schema import INFERRED_TYPES, STRUCTURAL_TYPES
from ..tables import written
from .graph import bfs, of_types

K = 60


def _searched(text: str | None) -> Column:
    """What a lexical search reads: the title and the content, or one column."""
    return F.col(text) if text else F.concat_ws(" ", "title", "content")


def _times(term: tuple[str, ...]) -> Column:
    """How often a term occurs in `words`: a word, or a phrase of several that follow each other."""
    if len(term) == 1:
        return F.size("words") - F.size(F.array_remove("words", term[0]))
    k, phrase = len(term), F.array(*[F.lit(t) for t in term])
    starts = F.sequence(F.lit(1), F.size("words") - (k - 1))
    return F.when(F.size("words") >= k, F.size(F.filter(starts, lambda i: F.slice("words", i, k) == phrase))).otherwise(0)


def _scored(nodes: DataFrame, query: str, text: str | None, per_project: bool = False) -> DataFrame | None:
    """(id, row_seq, score, and project_id if statistics are kept by project) of nodes that have a term of the query, by BM25.

    A first scan sums up what the corpus has of the terms. The second cuts only texts in which a term occurs at all; the counts leave it through
    a generator, since a filter on them would otherwise be pushed below and cut every text again."""
    terms = S.phrases(query)
    if not terms:
        return None
    any_of = lambda tests: reduce(or_, tests)
    keys = ["project_id"] if per_project else []
    low = F.lower(_searched(text))
    near = nodes.where(any_of(reduce(lambda a, b: a & b, (low.contains(w) for w in t)) for t in terms)).select("id", "row_seq", *keys, S.words(_searched(text)).alias("words"))
    facts_of = F.struct(F.size("words").alias("dl"), *[_times(t).alias(f"tf{i}") for i, t in enumerate(terms)])
    counted = near.select("id", "row_seq", *keys, F.inline(F.array(facts_of))).where(any_of(F.col(f"tf{i}") > 0 for i in range(len(terms))))
    held = [F.count_if(_times(t) > 0).alias(f"df{i}") for i, t in enumerate(terms)]
    facts = nodes.select(*keys, S.words(_searched(text)).alias("words")).groupBy(*keys).agg(F.count("*").alias("n"), F.avg(F.size("words")).alias("avgdl"), *held)
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.greatest(F.log((F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5)), F.lit(1e-6))
        score = score + idf * F.col(f"tf{i}") * 2.2 / (F.col(f"tf{i}") + 1.2 * (0.25 + 0.75 * F.col("dl") / F.col("avgdl")))
    whole = counted.join(facts, keys) if keys else counted.crossJoin(F.broadcast(facts))  # facts: one row
    return whole.select("id", "row_seq", *keys, F.round(score, 9).alias("score"))


def lexical(nodes: DataFrame, query: str, limit: int, mode: str = "bm25", text: str | None = None) -> DataFrame:
    """(id, score, rank) of nodes that have a term of the query in title or content: by BM25, or in order of row_seq.

    Terms stand between white space; one that the tokenizer cuts, such as red-blue, is a phrase."""
    found = _scored(nodes, query, text)
    if found is None:
        return nodes.select("id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where(F.lit(False))
    if mode == "rowid":
        best = found.select("id", F.lit(0.0).alias("score"), F.col("row_seq").cast("double").alias("key")).orderBy("key", "id").limit(limit)
        return best.withColumn("rank", F.row_number().over(Window.orderBy("key", "id"))).select("id", "score", "rank")
    best = found.select("id", "score").orderBy(F.col("score").desc(), "id").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")))


def vector(vectors: DataFrame, query: list[float], limit: int, model: str | None = None) -> DataFrame:
    """(id, score, rank) of the nearest vectors by cosine; the top rows of each partition are all that moves."""
    v = vectors.where(F.col("model_id") == model) if model else vectors
    target = F.array(*[F.lit(float(x)) for x in query])
    v = v.where(F.size("embedding") == len(query))
    best = v.select(F.col("owner_id").alias("id"), F.round(S.cosine(F.col("embedding"), target), 9).alias("score")).orderBy(F.col("score").desc(), "id").limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")))


def search_chunks(chunk_vectors: DataFrame, chunks: DataFrame, nodes: DataFrame, query: list[float], limit: int = 15, model: str | None = None) -> DataFrame:
    """(rank, id, parent_node_id, score, title, source, content, embedding) of the chunks nearest to a vector, whose parents are among the nodes."""
    of = chunks.select("id", "parent_node_id", "content").join(nodes.select(F.col("id").alias("parent_node_id"), "title", F.coalesce(F.nullif(F.col("source_adapter"), F.lit("")), F.lit("unknown")).alias("source")), "parent_node_id")
    mine = chunk_vectors.join(of.select(F.col("id").alias("owner_id")), "owner_id", "left_semi")
    best = vector(mine, query, limit, model)
    v = chunk_vectors.where(F.col("model_id") == model) if model else chunk_vectors
    return best.join(of, "id").join(v.select(F.col("owner_id").alias("id"), "embedding"), "id").select("rank", "id", "parent_node_id", "score", "title", "source", "content", "embedding")


def fuse(lists: dict[str, DataFrame]) -> DataFrame:
    """(id, rrf, match_type) over ranked lists by reciprocal rank; what both searches have is hybrid, what only the graph has is graph."""
    whole = None
    for name, df in lists.items():
        part = df.select("id", (1.0 / (K + F.col("rank"))).alias("r"), F.lit(name).alias("source"))
        whole = part if whole is None else whole.union(part)
    has = lambda name: F.bool_or(F.col("source") == name)
    kind = F.when(has("lexical") & has("semantic"), "hybrid").when(has("lexical"), "lexical").when(has("semantic"), "semantic").otherwise("graph")
    return whole.groupBy("id").agg(F.sum("r").alias("rrf"), kind.alias("match_type"))


def weigh(fused: DataFrame, nodes: DataFrame, as_of: Column, limit: int) -> DataFrame:
    """Scores times decay and importance; rows that come to nothing go."""
    found = fused.join(nodes.select("id", "title", "importance", F.coalesce("updated_at", "created_at").alias("at")), "id")
    score = F.round(F.col("rrf") * S.recency_decay(F.col("at"), as_of) * F.col("importance"), 9)
    return found.select("id", "title", "match_type", score.alias("score")).where("score > 0").orderBy(F.col("score").desc(), "id").limit(limit)


def recall(nodes: DataFrame, vectors: DataFrame, edges: DataFrame | None, query: str, embedding: list[float] | None, as_of: Column, limit: int = 10, mode: str = "bm25", model: str | None = None, depth: int = 1, types: list[str] | None = None, log: DataFrame | None = None, rerank: bool = False) -> DataFrame:
    """(id, title, match_type, score). Without an embedding it is lexical alone, without edges nothing is pulled in from the graph.

    With an access log (node_id, accessed_at), scores are boosted by accesses after the limit; the order of the list is by the scores before that
    unless `rerank` is set, and `place` tells it."""
    lists = {"lexical": lexical(nodes, query, 3 * limit, mode)}
    if embedding is not None:
        lists["semantic"] = vector(vectors, embedding, 2 * limit, model)
    found = weigh(fuse(lists), nodes, as_of, limit)
    if edges is not None and depth > 0:
        lists = {k: written(df, k) for k, df in lists.items()}  # read three times from here on
        found = written(weigh(fuse(lists), nodes, as_of, limit), "first-recall")
        lists["graph"] = graph_ranks(pulled_in(edges, found, nodes, depth, types), lists)
        found = weigh(fuse(lists), nodes, as_of, limit)
    if log is None:
        return found
    placed = found.withColumn("place", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")))  # `limit` rows
    return boosted(placed, log, as_of, rerank)


def pulled_in(edges: DataFrame, found: DataFrame, nodes: DataFrame, depth: int = 1, types: list[str] | None = None, seeds: int = 5) -> DataFrame:
    """(id, confidence) of what the edges lead to from the best rows that isn't found yet; the best row that leads there gives the confidence."""
    best = found.orderBy(F.col("score").desc(), "id").limit(seeds).withColumn("seed", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")))
    best = written(best.select(F.col("id").alias("start"), "seed"), "seeds")
    near = bfs(edges, best.select("start"), depth, types, nodes).join(best, "start")
    return near.groupBy("id").agg(F.min_by("confidence", F.struct("seed", "depth")).alias("confidence")).join(found.select("id"), "id", "left_anti")


def graph_ranks(found: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """Ranks for graph neighbours by confidence, after as many ranks as the other lists have rows, five at least."""
    before = None
    for df in lists.values():
        before = df.select("id") if before is None else before.union(df.select("id"))
    hits = before.agg(F.greatest(F.count("*") + 1, F.lit(5)).alias("hits"))
    n = F.count("*").over(Window.partitionBy())  # neighbours of five rows
    rank = F.greatest(F.floor((1 - F.col("confidence")) * (n - 1)) + 1, F.lit(1))
    return found.withColumn("pseudo", rank).crossJoin(hits).select("id", "confidence", (F.col("hits") + F.col("pseudo")).cast("int").alias("rank"))


def boosted(found: DataFrame, log: DataFrame, as_of: Column, rerank: bool = False) -> DataFrame:
    """Scores times the boost of their nodes' accesses; `place` follows them only if they are ranked again."""
    stats = log.join(found.select(F.col("id").alias("node_id")), "node_id", "left_semi").groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("accesses"), F.max(F.col("accessed_at").cast("timestamp")).alias("last"))
    out = found.join(stats, "id", "left").withColumn("score", F.round(F.col("score") * S.access_boost(F.col("accesses"), F.col("last"), as_of), 9)).drop("accesses", "last")
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.col("score").desc(), "id"))) if rerank else out


def enrich(found: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """The most confident edges of each found node, structural and inferred apart; others, such as proposed ones, are no knowledge."""
    kind = F.when(F.col("edge_type").isin(*INFERRED_TYPES), "inferred").otherwise("structural")
    mine = found.select(F.col("id").alias("from_id")).join(of_types(edges, [*STRUCTURAL_TYPES, *INFERRED_TYPES]), "from_id").withColumn("relation", kind)
    w = Window.partitionBy("from_id", "relation").orderBy(F.col("confidence").desc(), "to_id", "edge_type")
    return mine.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select(F.col("from_id").alias("id"), "relation", "rank", "to_id", "edge_type", "confidence")


def previews(found: DataFrame, nodes: DataFrame, chunks: DataFrame, most: int = 3) -> DataFrame:
    """(id, excerpt, chunks, preview, more_available, next_chunk_start): an excerpt of each found node, how many chunks it has, and its first ones."""
    mine = chunks.select(F.col("parent_node_id").alias("id"), F.col("id").alias("chunk_id"), "chunk_index").join(found.select("id"), "id", "left_semi")
    w = Window.partitionBy("id")
    placed = mine.withColumn("place", F.row_number().over(w.orderBy("chunk_index", "chunk_id"))).withColumn("total", F.count("*").over(w)).where(F.col("place") <= most)
    first = placed.groupBy("id").agg(F.max("total").alias("chunks"), F.transform(F.sort_array(F.collect_list(F.struct("place", "chunk_id"))), lambda x: x["chunk_id"]).alias("preview"))
    whole = found.select("id").join(nodes.select("id", S.excerpt(F.col("content")).alias("excerpt")), "id").join(first, "id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    more = F.col("chunks") > most
    return whole.select("id", "excerpt", "chunks", F.coalesce("preview", F.array().cast("array<string>")).alias("preview"), more.alias("more_available"), F.when(more, most).otherwise(-1).alias("next_chunk_start"))


@dataclass
class Recalled:
    """What a recall returns: ranked nodes, their edges, excerpts and first chunks, the nearest chunks, and links between chunks of different sources."""

    nodes: DataFrame
    edges: DataFrame
    previews: DataFrame
    chunks: DataFrame | None
    links: DataFrame | None


def recall_all(nodes: DataFrame, vectors: DataFrame, edges: DataFrame, chunks: DataFrame, chunk_vectors: DataFrame, log: DataFrame, query: str, embedding: list[float] | None, as_of: Column, limit: int = 10, model: str | None = None, most_chunks: int = 15, threshold: float = 0.75) -> Recalled:
    """The whole read path; what of it depends on others is read from written tables."""
    found = written(recall(nodes, vectors, edges, query, embedding, as_of, limit, model=model, log=log), "recalled")
    near = links = None
    if embedding is not None:
        near = written(search_chunks(chunk_vectors, chunks, nodes, embedding, most_chunks, model), "recalled-chunks")
        links = cross_source_links(near, threshold)
    return Recalled(found, enrich(found, edges), previews(found, nodes, chunks), near, links)


def recall_projects(nodes: DataFrame, vectors: DataFrame, query: str, embedding: list[float] | None, as_of: Column, limit: int = 10, projects: list[str] | None = None) -> DataFrame:
    """(id, project_id, rrf, score): one recall for each project, with that project's statistics, all in one plan, and their lists fused by place."""
    mine = nodes.where(F.col("project_id").isin(*projects)) if projects else nodes
    top = lambda df, n: df.withColumn("rank", F.row_number().over(Window.partitionBy("project_id").orderBy(F.col("score").desc(), "id"))).where(F.col("rank") <= n)
    lists, lexical_ = {}, _scored(mine, query, None, per_project=True)
    if lexical_ is not None:
        lists["lexical"] = top(lexical_, 3 * limit)
    if embedding is not None:
        target = F.array(*[F.lit(float(x)) for x in embedding])
        near = vectors.where(F.size("embedding") == len(embedding)).select(F.col("owner_id").alias("id"), F.round(S.cosine(F.col("embedding"), target), 9).alias("score"))
        lists["semantic"] = top(near.join(mine.select("id", "project_id"), "id"), 2 * limit)
    if not lists:
        return mine.select("id", "project_id", F.lit(0.0).alias("rrf"), F.lit(0.0).alias("score")).where(F.lit(False))
    found = fuse(lists).join(mine.select("id", "project_id", "importance", F.coalesce("updated_at", "created_at").alias("at")), "id")
    score = F.round(F.col("rrf") * S.recency_decay(F.col("at"), as_of) * F.col("importance"), 9)
    ranked = top(found.select("id", "project_id", score.alias("score")).where("score > 0"), limit)
    return fuse_projects(ranked.drop("rank"), limit).join(mine.select("id", "project_id"), "id")


def fuse_projects(ranked: DataFrame, limit: int) -> DataFrame:
    """Lists of several projects (project_id, id, score) fused by their places, counted from 0."""
    w = Window.partitionBy("project_id").orderBy(F.col("score").desc(), "id")
    placed = ranked.withColumn("place", F.row_number().over(w) - 1)
    return placed.groupBy("id").agg(F.round(F.sum(1.0 / (K + F.col("place"))), 9).alias("rrf"), F.max("score").alias("score")).orderBy(F.col("rrf").desc(), F.col("score").desc(), "id").limit(limit)


def chunk_page(chunks: DataFrame, start: int, end: int) -> DataFrame:
    """Chunks [start, end) of every parent by their place, with how many the parent has and where the next page begins (-1: nowhere)."""
    w = Window.partitionBy("parent_node_id")
    placed = chunks.withColumn("place", F.row_number().over(w.orderBy("chunk_index", "id")) - 1).withColumn("total", F.count("*").over(w))
    return placed.where((F.col("place") >= start) & (F.col("place") < end)).withColumn("next_start", F.when(F.col("total") > end, end).otherwise(-1))


def cross_source_links(found: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Pairs of a bounded list of found chunks (rank, id, source, embedding) from different sources that are alike."""
    side = lambda s: found.select(*[F.col(c).alias(f"{s}_{c}") for c in ("rank", "id", "source", "embedding")])
    pairs = side("a").join(side("b"), (F.col("a_rank") < F.col("b_rank")) & (F.col("a_source") != F.col("b_source")))
    return pairs.select("a_id", "b_id", F.round(S.cosine(F.col("a_embedding"), F.col("b_embedding")), 6).alias("similarity")).where(F.col("similarity") >= threshold)
