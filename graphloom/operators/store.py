"""Reads and writes of the memory graph. Writes are functions from the old table and the new rows to the next table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..schema import TIERS

EDGE_KEY = ["from_id", "to_id", "edge_type"]


def upsert_nodes(old: DataFrame, new: DataFrame, as_of: Column) -> DataFrame:
    """New rows replace old ones by id and keep their time of creation; of rows with one id, the last by row_seq counts."""
    fresh = new.groupBy("id").agg(F.max_by(F.struct(*new.columns), "row_seq").alias("n")).select("n.*")
    made = old.select("id", F.col("created_at").alias("was_created"))
    defaults = {"project_id": F.when(F.coalesce("project_id", F.lit("")) == "", "default").otherwise(F.col("project_id")), "status": F.when(F.coalesce("status", F.lit("")) == "", "current").otherwise(F.col("status")), "updated_at": as_of}
    fresh = fresh.join(made, "id", "left").withColumn("created_at", F.coalesce("was_created", as_of)).drop("was_created").withColumns(defaults)
    return old.join(fresh.select("id"), "id", "left_anti").unionByName(fresh.select(*old.columns))


def guard_vectors(vectors: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """(usable, skipped): a vector of another length or with a component that isn't finite is skipped, its node is not."""
    ok = F.coalesce((F.size("embedding") == dim) & ~S.non_finite(F.col("embedding")), F.lit(False))
    return vectors.where(ok), vectors.where(~ok)


def tier_rank(tier: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in TIERS]), tier)


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge for each key: highest confidence (0 counts as 1), strongest tier, bidirectional if any is, earliest time."""
    return merged_by(edges.where("from_id <> '' AND to_id <> '' AND edge_type <> ''"), EDGE_KEY)


def merged_by(edges: DataFrame, key: list[str]) -> DataFrame:
    """`merge_edges` by other columns that tell the edges apart, such as numbers, of which less is moved than of ids."""
    confidence = F.when(F.coalesce("confidence", F.lit(0.0)) == 0, 1.0).otherwise(F.col("confidence"))
    tier = F.when(F.coalesce("confidence_tier", F.lit("")) == "", "INFERRED").otherwise(F.col("confidence_tier"))
    merged = edges.groupBy(*key).agg(F.max(confidence).alias("confidence"), F.max(tier_rank(tier)).alias("rank"), F.max("bidirectional").alias("bidirectional"), F.min("created_at").alias("created_at"))
    name = F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.col("rank").cast("int"))
    return merged.select(*key, "confidence", name.alias("confidence_tier"), "bidirectional", "created_at")


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with the project of both ends, null where an end is no node. Sides are as large as the nodes: no broadcast is forced."""
    end = lambda s: nodes.select(F.col("id").alias(f"{s}_id"), F.col("project_id").alias(f"{s}_project"))
    return edges.join(end("from"), "from_id", "left").join(end("to"), "to_id", "left")


def upsert_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(next edges, skipped): new edges between different stages are skipped."""
    placed = with_ends(new, nodes)
    ok = S.edge_visible(F.col("from_project"), F.col("to_project"))
    return merge_edges(old.unionByName(placed.where(ok).select(*old.columns))), placed.where(~ok).select(*old.columns)


def upsert_chunks(old: DataFrame, new: DataFrame) -> DataFrame:
    """The chunks of the new rows' parents are replaced; of rows with one place, the greatest id counts; neighbours are linked anew."""
    w = Window.partitionBy("parent_node_id", "chunk_index").orderBy(F.col("id").desc())
    fresh = new.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return old.join(new.select("parent_node_id").distinct(), "parent_node_id", "left_anti").unionByName(link_chunks(fresh).select(*old.columns))


def link_chunks(chunks: DataFrame) -> DataFrame:
    w = Window.partitionBy("parent_node_id").orderBy("chunk_index")
    return chunks.withColumn("prev_chunk_id", F.coalesce(F.lag("id").over(w), F.lit(""))).withColumn("next_chunk_id", F.coalesce(F.lead("id").over(w), F.lit("")))


def forget(ids: DataFrame, nodes: DataFrame, edges: DataFrame, chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four tables without the nodes `ids` (id) and all that hangs from them."""
    key = lambda name: ids.select(F.col("id").alias(name)).distinct()
    kept = edges.join(key("from_id"), "from_id", "left_anti").join(key("to_id"), "to_id", "left_anti")
    gone = chunks.join(key("parent_node_id"), "parent_node_id", "left_semi").select("id").union(ids.select("id")).distinct().withColumnRenamed("id", "owner_id")
    return nodes.join(key("id"), "id", "left_anti"), kept, chunks.join(key("parent_node_id"), "parent_node_id", "left_anti"), vectors.join(gone, "owner_id", "left_anti")


def clear_counts(project: str, nodes: DataFrame, edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """What clearing a project removes, as one row."""
    own = nodes.where(F.col("project_id") == project).select("id")
    touched = edges.join(own.withColumnRenamed("id", "from_id"), "from_id", "left_semi").union(edges.join(own.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(*edges.columns)).dropDuplicates(EDGE_KEY)
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(own, "nodes").crossJoin(one(touched, "edges")).crossJoin(one(vectors.join(own.withColumnRenamed("id", "owner_id"), "owner_id", "left_semi"), "vectors"))


def resolve_unresolved(refs: DataFrame, nodes: DataFrame, confidence: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """(edges, refs left): mentions of a title in the same project become edges."""
    target = nodes.select("project_id", F.col("title").alias("mention"), F.col("id").alias("to_id"))
    edges = refs.join(target, ["project_id", "mention"]).select(F.col("source_id").alias("from_id"), "to_id", F.col("relation").alias("edge_type"), F.lit(confidence).alias("confidence"))
    return edges.distinct(), refs.join(target.select("project_id", "mention").distinct(), ["project_id", "mention"], "left_anti")


def list_nodes(nodes: DataFrame, project: str, types: list[str] | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    rows = nodes.where(F.col("project_id") == project)
    rows = rows.where(F.col("node_type").isin(*types)) if types else rows
    return rows.orderBy(F.col("created_at").desc(), "id").offset(offset).limit(limit)


def updated_after(nodes: DataFrame, after: Column, limit: int = 100) -> DataFrame:
    return nodes.where(F.col("updated_at") > after).orderBy(F.col("updated_at").desc(), "id").limit(limit)


def top_importance(nodes: DataFrame, types: list[str], limit: int) -> DataFrame:
    return nodes.where(F.col("node_type").isin(*types)).orderBy(F.col("importance").desc(), "id").limit(limit)


def project_stats(nodes: DataFrame, edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """Nodes, stale nodes, conventions, edges (by their first end) and vectors of every project that has nodes."""
    per = nodes.groupBy("project_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("status") == "stale").alias("stale"), F.count_if(F.col("node_type") == "convention").alias("conventions"))
    of = nodes.select("id", "project_id")
    e = edges.join(of.withColumnRenamed("id", "from_id"), "from_id").groupBy("project_id").agg(F.count("*").alias("edges"))
    v = vectors.join(of.withColumnRenamed("id", "owner_id"), "owner_id").groupBy("project_id").agg(F.count("*").alias("vectors"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return per.join(e, "project_id", "left").join(v, "project_id", "left").select("project_id", "nodes", "stale", "conventions", zero("edges"), zero("vectors"))


def edge_type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count("*").alias("edges"))


def access_stats(log: DataFrame) -> DataFrame:
    return log.groupBy("node_id").agg(F.count("*").alias("access_count"), F.max("accessed_at").alias("last_accessed_at"))


def log_access(log: DataFrame, nodes: DataFrame, session: str, as_of: Column) -> DataFrame:
    """The log with an access of each of the nodes (id, project_id); counts and last times are read from the log."""
    rows = nodes.select("project_id", F.col("id").alias("node_id"), F.lit(session).alias("session_id"), as_of.alias("accessed_at"))
    return log.unionByName(rows, allowMissingColumns=True)


def recent_accesses(log: DataFrame, as_of: Column, seconds: int) -> DataFrame:
    return log.where(F.unix_seconds(F.col("accessed_at").cast("timestamp")) >= F.unix_seconds(as_of) - seconds).select("node_id").distinct()


def set_embed_status(config: DataFrame, project: str, model: str, status: str, as_of: Column) -> DataFrame:
    """The project's model marked dirty or clean; it is entered if it is new."""
    spark = config.sparkSession
    row = spark.createDataFrame([(project, model, status)], "project_id string, model_id string, status string")
    key = ["project_id", "model_id"]
    was = config.select(*key, F.col("created_at").alias("was"))
    row = row.join(was, key, "left").withColumn("created_at", F.coalesce("was", as_of)).drop("was")
    return config.join(row.select(*key), key, "left_anti").unionByName(row.select(*config.columns))


def upsert_edge(edges: DataFrame, nodes: DataFrame, from_id: str, to_id: str, edge_type: str, confidence: float = 1.0, tier: str = "INFERRED", bidirectional: bool = False, as_of: Column | None = None) -> DataFrame:
    """One edge more, or the one there made stronger. An empty key and ends in different stages are errors."""
    if not (from_id and to_id and edge_type):
        raise ValueError("an edge needs both ends and a type")
    spark = edges.sparkSession
    new = spark.createDataFrame([(from_id, to_id, edge_type, float(confidence), tier, bidirectional)], "from_id string, to_id string, edge_type string, confidence double, confidence_tier string, bidirectional boolean").withColumn("created_at", as_of if as_of is not None else F.current_timestamp())
    after, skipped = upsert_edges(edges, new.select(*edges.columns), nodes)
    if not skipped.isEmpty():
        raise ValueError(f"{from_id} and {to_id} are in different stages")
    return after


def delete_edge(edges: DataFrame, from_id: str, to_id: str, edge_type: str) -> DataFrame:
    return edges.where(~((F.col("from_id") == from_id) & (F.col("to_id") == to_id) & (F.col("edge_type") == edge_type)))


def delete_chunks(parents: DataFrame, chunks: DataFrame, vectors: DataFrame, model: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(chunks, vectors) without the chunks of parents (id) and their vectors; with a model its vectors alone go, the chunks stay."""
    key = parents.select(F.col("id").alias("parent_node_id")).distinct()
    gone = chunks.join(key, "parent_node_id", "left_semi").select(F.col("id").alias("owner_id"), F.lit("chunk").alias("owner_kind"))
    if model:
        return chunks, vectors.join(gone.withColumn("model_id", F.lit(model)), ["owner_id", "owner_kind", "model_id"], "left_anti").select(*vectors.columns)
    return chunks.join(key, "parent_node_id", "left_anti").select(*chunks.columns), vectors.join(gone, ["owner_id", "owner_kind"], "left_anti").select(*vectors.columns)


def clear_project(project: str, tables: dict[str, DataFrame], model: str | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the tables without a project, what went as one row: nodes, edges, chunks, vectors). With a model only its vectors and its state go.

    tables: nodes, edges, chunks, vectors, embed_config and access_log."""
    nodes, edges, chunks, vectors, config = (tables[k] for k in ("nodes", "edges", "chunks", "vectors", "embed_config"))
    own = nodes.where(F.col("project_id") == project).select("id")
    mine = chunks.join(own.withColumnRenamed("id", "parent_node_id"), "parent_node_id", "left_semi")
    owners = own.union(mine.select("id")).distinct().withColumnRenamed("id", "owner_id")
    of_project = F.col("project_id") == project
    one = lambda df, name: df.agg(F.count("*").alias(name))
    if model:
        dead = vectors.where(F.col("model_id") == model).join(owners, "owner_id", "left_semi")
        kept = vectors.where(F.col("model_id") != model).unionByName(vectors.where(F.col("model_id") == model).join(owners, "owner_id", "left_anti").select(*vectors.columns))
        out = tables | {"vectors": kept, "embed_config": config.where(~(of_project & (F.col("model_id") == model)))}
        return out, one(dead, "vectors").select(F.lit(0).cast("long").alias("nodes"), F.lit(0).cast("long").alias("edges"), F.lit(0).cast("long").alias("chunks"), "vectors")
    n, e, c, v = forget(own, nodes, edges, chunks, vectors)
    counts = one(own, "nodes").crossJoin(edges.agg(F.count("*").alias("a")).crossJoin(e.agg(F.count("*").alias("b"))).select((F.col("a") - F.col("b")).alias("edges"))).crossJoin(one(mine, "chunks")).crossJoin(one(vectors.join(owners, "owner_id", "left_semi"), "vectors"))  # one row each
    out = tables | {"nodes": n, "edges": e, "chunks": c, "vectors": v, "embed_config": config.where(~of_project)}
    if "access_log" in tables:
        out["access_log"] = tables["access_log"].where(~of_project)
    return out, counts


def upsert_project(projects: DataFrame, project: str, name: str, url: str, as_of: Column) -> DataFrame:
    row = projects.sparkSession.createDataFrame([(project, name, url)], "project_id string, project_name string, repository_url string").withColumn("updated_at", as_of)
    return projects.where(F.col("project_id") != project).unionByName(row.select(*projects.columns))


def get_node(nodes: DataFrame, chunks: DataFrame, id_: str) -> DataFrame:
    """The node, with whether it has chunks; no row if there is none."""
    one = nodes.where(F.col("id") == id_)
    has = chunks.where(F.col("parent_node_id") == id_).select(F.col("parent_node_id").alias("id"), F.lit(True).alias("has_chunks")).limit(1)
    return one.join(F.broadcast(has), "id", "left").withColumn("has_chunks", F.coalesce("has_chunks", F.lit(False)))  # one row at most


def edges_of_type(edges: DataFrame, nodes: DataFrame, project: str, edge_type: str, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the edges of a type that begin in a project."""
    own = nodes.where(F.col("project_id") == project).select(F.col("id").alias("from_id"))
    return edges.where(F.col("edge_type") == edge_type).join(own, "from_id", "left_semi").select(*edges.columns).orderBy(F.col("confidence").desc(), "from_id", "to_id").offset(offset).limit(limit)


def project_ids(nodes: DataFrame) -> DataFrame:
    return nodes.select("project_id").distinct().orderBy("project_id")


def node_embeddings(vectors: DataFrame, ids: DataFrame, dim: int, model: str | None = None) -> DataFrame:
    """(id, embedding) of nodes (id); vectors of another length or with components that aren't finite are left out."""
    v = vectors.where(F.col("model_id") == model) if model else vectors
    good, _ = guard_vectors(v, dim)
    return good.select(F.col("owner_id").alias("id"), "embedding").join(ids.select("id").distinct(), "id", "left_semi")


def access_history(log: DataFrame, node: str, limit: int = 50) -> DataFrame:
    """A node's accesses, the newest first."""
    return log.where(F.col("node_id") == node).orderBy(F.col("accessed_at").desc(), "session_id").limit(limit)


def search_box(nodes: DataFrame, query: str, limit: int = 50) -> DataFrame:
    hit = S.ui_match(query, F.col("title"), F.col("id"), F.col("project_id"), F.col("node_type"))
    return nodes.where(hit).orderBy("title", "id").limit(limit)


def project_state(project: str, nodes: DataFrame, edges: DataFrame, chunks: DataFrame, vectors: DataFrame, config: DataFrame, model: str | None = None) -> DataFrame:
    """One row about a project: counts, edge counts by type, and whether it is already whole for the model, so that onboarding would change nothing."""
    own = nodes.where(F.col("project_id") == project)
    ids = own.select("id")
    mine = chunks.join(ids.withColumnRenamed("id", "parent_node_id"), "parent_node_id", "left_semi")
    owners = ids.union(mine.select("id")).withColumnRenamed("id", "owner_id")
    v = (vectors.where(F.col("model_id") == model) if model else vectors).join(owners, "owner_id", "left_semi")
    by_type = edges.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_semi").groupBy("edge_type").agg(F.count("*").alias("k"))
    e = by_type.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("edges"), F.sort_array(F.collect_list(F.struct("edge_type", "k"))).alias("edge_types"))
    n = own.agg(F.count("*").alias("nodes"), F.count_if(F.col("status") == "stale").alias("stale"), F.count_if(F.col("node_type") == "convention").alias("conventions"))
    clean = config.where((F.col("project_id") == project) & (F.col("model_id") == F.lit(model)) & (F.col("status") == "clean")).agg((F.count("*") > 0).alias("clean"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    row = n.crossJoin(e).crossJoin(one(mine, "chunks")).crossJoin(one(v, "vectors")).crossJoin(clean)  # one row each
    return row.select(F.lit(project).alias("project_id"), "nodes", "stale", "conventions", "edges", "edge_types", "chunks", "vectors", ((F.col("nodes") > 0) & F.col("clean")).alias("gated"))


def model_warning(state: str, nodes: int, model: str) -> str:
    """What to tell a reader about a project's data for a model; state: clean, dirty or empty."""
    if not model or not nodes or state == "clean":
        return ""
    if state == "dirty":
        return f"data for model {model!r} may be incomplete, as the last ingest did not end; onboard again"
    return f"no data found for model {model!r}; onboard or ingest first"


def stage_warning(project: str, stage: str, local_nodes: int) -> str:
    if stage == "local" or not local_nodes:
        return ""
    return f"project {project!r} also has data at stage 'local', ingested before its branch was known; clear it with stage 'local'"
