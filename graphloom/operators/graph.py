"""Traversals and views of the typed graph. `edges` are a stored table with one row a key; a traversal writes each frontier and joins it to the
next hop, so every hop scans the edges once and the plan does not grow with the depth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..schema import CROSS_PROJECT_TYPES, GRAPH_DATA_TYPES, IMPACT_TYPES, PROJECT_GRAPH_TYPES
from ..tables import written
from .store import with_ends


def of_types(edges: DataFrame, types: list[str] | None) -> DataFrame:
    return edges.where(F.col("edge_type").isin(*types)) if types else edges


def visible(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges that a reader may see: those whose ends do not lie in two different stages."""
    return with_ends(edges, nodes).where(S.edge_visible(F.col("from_project"), F.col("to_project"))).select(*edges.columns)


def directed(edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Edges as steps (src, dst, edge_type, confidence): bidirectional ones go both ways."""
    e = of_types(edges, types)
    step = lambda a, b: [F.col(a).alias("src"), F.col(b).alias("dst"), "edge_type", "confidence"]
    return e.select(*step("from_id", "to_id")).union(e.where("bidirectional").select(*step("to_id", "from_id")))


def bfs(edges: DataFrame, seeds: DataFrame, depth: int, types: list[str] | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(start, id, depth, confidence) of what is reached from the seeds (start): least depth, then highest confidence.

    With nodes, edges between different stages are not walked, and ids that are no nodes are not returned."""
    steps = directed(edges if nodes is None else written(visible(of_types(edges, types), nodes), "visible-edges"), types)
    front = written(seeds.select("start", F.col("start").alias("id"), F.lit(0).alias("depth"), F.lit(1.0).alias("confidence")), "frontier")
    seen = front
    for d in range(1, depth + 1):
        reached = steps.join(front.select("start", F.col("id").alias("src")), "src").groupBy("start", F.col("dst").alias("id")).agg(F.max("confidence").alias("confidence"))
        front = written(reached.join(seen.select("start", "id"), ["start", "id"], "left_anti").select("start", "id", F.lit(d).alias("depth"), "confidence"), "frontier")
        seen = seen.union(front)
        if d < depth and front.isEmpty():
            break
    found = seen.where("depth > 0")
    return found if nodes is None else found.join(nodes.select("id"), "id", "left_semi").select(*found.columns)


def impact(edges: DataFrame, changed: DataFrame, depth: int = 2, direction: str = "out", nodes: DataFrame | None = None) -> DataFrame:
    """What goes stale when the nodes `changed` (start) change."""
    e = edges if direction == "out" else edges.withColumns({"from_id": F.col("to_id"), "to_id": F.col("from_id")})
    return bfs(e, changed, depth, list(IMPACT_TYPES), nodes).select("start", "id", "depth", F.lit("stale").alias("status"))


def mark_stale(nodes: DataFrame, edges: DataFrame, changed: DataFrame, depth: int = 2, direction: str = "out") -> DataFrame:
    """The nodes, those stale that `changed` (start) reaches; marking is no update, so their times stay."""
    stale = impact(edges, changed, depth, direction, nodes).select("id").distinct().withColumn("_stale", F.lit(True))
    return nodes.join(stale, "id", "left").withColumn("status", F.when(F.col("_stale"), "stale").otherwise(F.col("status"))).select(*nodes.columns)


SMALL = 10_000  #: rows of a frontier that is broadcast, so that the edges stay where they are


def shortest_path(edges: DataFrame, start: str, goal: str, depth: int = 10, merge: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(hop, id, edge_type, confidence) of a shortest path, the smallest in order of ids, with the strongest edge that enters each hop;
    one row if start is the goal, none if there is no path. With merge, the edges may have repeats, of which only those along the path are merged."""
    spark, schema = edges.sparkSession, "hop int, id string, edge_type string, confidence double"
    steps = directed(edges)
    front, n = spark.createDataFrame([(start, [start])], "id string, path array<string>"), 1
    seen = front.select("id")
    for _ in range(depth + 1):
        found = front.where(F.col("id") == goal).select("path").first()
        if found or not n:
            break
        reached = steps.join(F.broadcast(front) if n <= SMALL else front, front.id == steps.src).groupBy(F.col("dst").alias("id")).agg(F.min(F.concat("path", F.array("dst"))).alias("path"))
        front = written(reached.join(seen, "id", "left_anti"), "frontier")
        n = front.count()
        seen = seen.union(front.select("id"))
    else:
        found = None
    if not found:
        return spark.createDataFrame([], schema)
    hops = spark.createDataFrame([(k, found.path[k - 1] if k else None, x) for k, x in enumerate(found.path)], "hop int, src string, dst string")
    if merge:
        ends = hops.select(F.col("src").alias("from_id"), F.col("dst").alias("to_id"))
        steps = directed(merge(edges.join(F.broadcast(ends.union(ends.select("to_id", "from_id"))), ["from_id", "to_id"], "left_semi")))
    best = steps.join(F.broadcast(hops), ["src", "dst"]).groupBy("hop").agg(F.min_by(F.struct("edge_type", "confidence"), F.struct(-F.col("confidence"), "edge_type")).alias("e"))
    return hops.join(best, "hop", "left").select("hop", F.col("dst").alias("id"), "e.edge_type", "e.confidence")


def edges_of(edges: DataFrame, id_: str, types: list[str] | None = None) -> DataFrame:
    """(direction, other, edge_type, confidence) of a node's edges; bidirectional ones count both ways."""
    e = of_types(edges, types)
    out, back, both = F.col("from_id") == id_, F.col("to_id") == id_, F.col("bidirectional")
    row = lambda fits, direction, other: F.when(fits, F.struct(F.lit(direction).alias("direction"), F.col(other).alias("other")))
    rows = F.array(row(out, "out", "to_id"), row(back & both, "out", "from_id"), row(back, "in", "from_id"), row(out & both, "in", "to_id"))
    return e.where(out | back).select(F.explode(F.array_compact(rows)).alias("d"), "edge_type", "confidence").select("d.direction", "d.other", "edge_type", "confidence").distinct()


def neighbourhood(edges: DataFrame, id_: str, limit: int = 20, direction: str = "both", types: list[str] | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """A node's edges both ways, the most confident of each direction, with how many there are in all; with nodes, only edges that are
    visible, and the other ends' titles and types, which an unknown end gets from its id."""
    mine = edges_of(edges if nodes is None else visible(edges.where((F.col("from_id") == id_) | (F.col("to_id") == id_)), nodes), id_, types)
    mine = mine if direction == "both" else mine.where(F.col("direction") == direction)
    w = Window.partitionBy("direction")
    ranked = mine.withColumn("total", F.count("*").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.col("confidence").desc(), "other", "edge_type"))).where(F.col("rank") <= limit)
    if nodes is None:
        return ranked
    known = nodes.select(F.col("id").alias("other"), "title", "node_type")
    guess = F.when(F.contains("other", F.lit("/code:type/")), "code:type").when(F.contains("other", F.lit("/code:package/")), "code:package").otherwise("code:function")
    return ranked.join(known, "other", "left").withColumns({"title": F.coalesce("title", S.display_name(F.col("other"))), "node_type": F.coalesce(F.nullif(F.col("node_type"), F.lit("")), guess)})


def neighbour_counts(edges: DataFrame, id_: str, types: list[str] | None = None) -> DataFrame:
    """How many edges of each type a node has, counted both ways before any limit."""
    return edges_of(edges, id_, types).groupBy("edge_type").agg(F.count("*").alias("edges"))


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, neighbours): each node's neighbours both ways, sorted."""
    both = edges.select(F.col("from_id").alias("id"), F.col("to_id").alias("other")).union(edges.select("to_id", "from_id"))
    return both.distinct().groupBy("id").agg(F.sort_array(F.collect_list("other")).alias("neighbours"))


def project_edges(placed: DataFrame, project: str, types: list[str] | None = None, limit: int = 5000, offset: int = 0) -> DataFrame:
    """The visible edges with an end in the project, the most confident first, on edges with the projects of their ends; `total` counts all of them."""
    mine = of_types(placed, types).where((F.col("from_project") == project) | (F.col("to_project") == project)).where(S.edge_visible(F.col("from_project"), F.col("to_project")))
    page = mine.orderBy(F.col("confidence").desc(), "from_id", "to_id", "edge_type").offset(offset).limit(limit)
    return page.join(mine.agg(F.count("*").alias("total")), how="cross")  # one row


def edge_total(placed: DataFrame, project: str, types: list[str] | None = None) -> DataFrame:
    """(total) of the project's visible edges, also where a page has none."""
    mine = of_types(placed, types).where((F.col("from_project") == project) | (F.col("to_project") == project))
    return mine.where(S.edge_visible(F.col("from_project"), F.col("to_project"))).agg(F.count("*").alias("total"))


def project_graph(placed: DataFrame, nodes: DataFrame, project: str, types: list[str] | None = None, limit: int = 5000, tiers: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes with weight, edges) of a project. Tiers are filtered after the limit, so they change neither it nor the total."""
    page = project_edges(placed, project, types or list(PROJECT_GRAPH_TYPES), limit)
    page = page.where(F.col("confidence_tier").isin(*tiers)) if tiers else page
    weights = degrees(page).withColumnRenamed("degree", "weight")
    return weights.join(nodes.select("id", "title", "node_type", "project_id"), "id", "left").select("id", "title", "node_type", "project_id", "weight"), page.select("from_id", "to_id", "edge_type", "confidence", "confidence_tier", "total")


def graph_data(placed: DataFrame, nodes: DataFrame, project: str, sidecars: list[str] | None = None, limit: int = 2000, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) for a drawing of a project: proposed edges apart from structural ones, the best nodes of the sidecar projects, and of edges
    that leave the project only those to a sidecar."""
    shown = [project, *(sidecars or [])]
    placed = placed.where(S.edge_visible(F.col("from_project"), F.col("to_project")))
    page = project_edges(placed, project, list(GRAPH_DATA_TYPES), limit)
    inside = lambda c: F.coalesce(F.col(c).isin(*shown), F.lit(False))
    edges = page.where((F.col("edge_type") == "proposed") | (inside("from_project") & inside("to_project"))).select("from_id", "to_id", "edge_type", "confidence", F.when(F.col("edge_type") == "proposed", "proposed").otherwise("structural").alias("kind"), "total")
    ids = degrees(page).withColumnRenamed("degree", "weight")
    known = nodes.select("id", "title", "node_type", "project_id", "importance", F.length("content").alias("size"))
    for s in sidecars or []:
        crossing = cross_project_nodes(placed, s, project).join(known.select("id", "importance"), "id").orderBy(F.col("importance").desc(), "id").limit(most).select("id")
        best = known.where(F.col("project_id") == s).orderBy(F.col("importance").desc(), "id").limit(most).select("id")
        ids = ids.union(crossing.union(best).withColumn("weight", F.lit(1).cast("long")))
    weighed = ids.groupBy("id").agg(F.sum("weight").alias("weight")).join(known, "id").where(F.col("project_id").isin(*shown))
    return weighed.select("id", "title", "node_type", S.group_of(F.col("id"), F.col("project_id")).alias("group"), "size", "weight", "project_id"), edges


def linked_projects(placed: DataFrame, types: list[str] | None = None, stage: str | None = None) -> DataFrame:
    """Pairs of projects (project, other) that an edge joins, on edges with the projects of their ends; by default over the types that
    lead from project to project. With a stage, only others of that stage."""
    fit = of_types(placed, list(CROSS_PROJECT_TYPES) if types is None else types)
    pair = fit.where("from_project <> to_project").select(F.explode(F.array(F.struct(F.col("from_project").alias("project"), F.col("to_project").alias("other")), F.struct(F.col("to_project").alias("project"), F.col("from_project").alias("other")))).alias("p")).select("p.*")
    pair = pair.where(S.stage_of(F.col("other")) == stage) if stage else pair
    return pair.groupBy("project", "other").agg(F.count("*").alias("edges"))


def cross_project_nodes(placed: DataFrame, project: str, other: str) -> DataFrame:
    """The nodes of a project on edges to or from another: one pass over the edges, no OR join."""
    p, q = F.lit(project), F.lit(other)
    fit = ((F.col("from_project") == p) & (F.col("to_project") == q)) | ((F.col("from_project") == q) & (F.col("to_project") == p))
    return placed.where(fit).select(F.when(F.col("from_project") == p, F.col("from_id")).otherwise(F.col("to_id")).alias("id")).groupBy("id").agg(F.count("*").alias("edges"))


def node_look(weight: Column, group: Column) -> tuple[Column, Column]:
    """A node's radius, which grows with the logarithm of its weight, and its hue, by its group."""
    return F.round(4 + 6 * F.log10(1 + weight), 3), F.pmod(F.crc32(group), F.lit(360))
