"""The memory graph's tools over a store of Parquet tables: remember, recall, onboard, link and so on, by the names that users know."""

from __future__ import annotations

import subprocess
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .functions import scalar as S
from .functions.embedding import Embedder, HashingEmbedder, embedded_or_none
from .jobs import Job, Jobs, ulid
from .operators import graph, ingest, link, retrieve, store
from .operators.ingest import rule_extractor
from .sources import files
from .tables import Store, written

HELP = "remember and recall notes; onboard a folder; query_graph, find_path and check_impact walk what links them"


@dataclass
class Answer:
    """What a tool returns: values, tables, and a warning if there is something to know."""

    values: dict[str, object]
    tables: dict[str, DataFrame]
    warning: str = ""

    def json(self) -> str:
        import json

        rows = {k: [json.loads(x) for x in df.toJSON().collect()] for k, df in self.tables.items()}
        return json.dumps(self.values | rows | ({"warning": self.warning} if self.warning else {}), default=str)


class Memory:
    """The tools. Reads are plans over the last versions of the tables; writes make new versions, one job at a time."""

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None, now: Column | None = None) -> None:
        self.spark, self.store, self.jobs = spark, Store(spark, path), Jobs(spark)
        self.embedder: Embedder = embedder or HashingEmbedder()
        self._now = now

    def now(self) -> Column:
        return self._now if self._now is not None else F.current_timestamp()

    def table(self, name: str) -> DataFrame:
        return self.store.read(name)

    def scope(self, project: str, stage: str = "") -> str:
        """The id of a project at a stage; an id that is staged already, a stage that can't be held, or a marker within one is an error."""
        if not stage:
            return project or "default"
        got = self.spark.range(1).select(S.encode_scope(F.lit(project), F.lit(stage))).first()[0]
        if got is None:
            raise ValueError(f"no scope for project {project!r} at stage {stage!r}")
        return got

    def scopes(self, project: str = "", stage: str = "", project_ids: list[str] | None = None, project_scopes: list[tuple[str, str]] | None = None, all_projects: bool = False) -> list[str]:
        """The projects that a recall reads: the ones named, or all, or one, which at a stage is read with its base."""
        if project_ids and project_scopes:
            raise ValueError("project_ids and project_scopes exclude each other")
        if project_scopes:
            return [self.scope(p, s) for p, s in project_scopes]
        if project_ids:
            return list(project_ids)
        if all_projects:
            return [r[0] for r in store.project_ids(self.table("nodes")).collect()]
        return [self.scope(project, stage), project or "default"] if stage else [project or "default"]

    def suggestions(self, project: str, names: DataFrame | None = None) -> str:
        names = names if names is not None else store.project_ids(self.table("nodes")).select(F.col("project_id").alias("name"))
        found = [r.name for r in link.similar_names(names, project, 3).collect()]
        return f"no such project {project!r}; did you mean {', '.join(found)}?" if found else ""

    # reads

    def init(self) -> Answer:
        return Answer({"help": HELP, "model_id": self.embedder.model_id}, {"projects": self.list_projects().tables["projects"]})

    def list_projects(self) -> Answer:
        stats = store.project_stats(self.table("nodes"), self.table("edges"), self.table("vectors"))
        meta = self.table("projects").select("project_id", "project_name", "repository_url")
        rows = stats.join(meta, "project_id", "left").withColumn("base", S.base_project(F.col("project_id"))).withColumn("stage", S.stage_of(F.col("project_id")))
        return Answer({}, {"projects": rows.orderBy("project_id")})

    def onboard_check(self, project: str, stage: str = "", model: str | None = None) -> Answer:
        id_ = self.scope(project, stage)
        row = store.project_state(id_, self.table("nodes"), self.table("edges"), self.table("chunks"), self.table("vectors"), self.table("embed_config"), model or self.embedder.model_id).first()
        values = row.asDict(True) | {f"has_{k}": row[k] > 0 for k in ("nodes", "edges", "chunks", "vectors", "conventions")}
        return Answer(values, {}, "" if row.nodes else self.suggestions(id_))

    def recall(self, query: str, project: str = "", stage: str = "", limit: int = 10, link_threshold: float = 0.75, project_ids: list[str] | None = None, project_scopes: list[tuple[str, str]] | None = None, all_projects: bool = False, session: str = "") -> Answer:
        ids = self.scopes(project, stage, project_ids, project_scopes, all_projects)
        nodes, vectors, now = self.table("nodes").where(F.col("project_id").isin(*ids)), self.table("vectors").where(F.col("model_id") == self.embedder.model_id), self.now()
        owners = nodes.select(F.col("id").alias("owner_id"))
        mine = vectors.where("owner_kind = 'node'").join(owners, "owner_id", "left_semi")
        embedding = embedded_or_none(self.embedder, query)
        log = self.table("access_log")
        if len(ids) > 1:
            found = written(retrieve.recall_projects(nodes, mine, query, embedding, now, limit), "recalled")
            tables = {"results": found.orderBy(F.col("rrf").desc(), F.col("score").desc(), "id")}
        else:
            got = retrieve.recall_all(nodes, mine, graph.visible(self.table("edges"), self.table("nodes")), self.table("chunks"), vectors.where("owner_kind = 'chunk'"), log, query, embedding, now, limit, most_chunks=15, threshold=link_threshold)
            found = got.nodes
            tables = {"results": found.join(got.previews, "id").orderBy("place"), "edges": got.edges} | ({"chunks": got.chunks.drop("embedding"), "links": got.links} if got.chunks is not None else {})
        hits = found.join(nodes.select("id", "project_id"), "id").select(*(c for c in ["project_id"])) if "project_id" not in found.columns else found.select("project_id")
        seen = found.select("id") if "project_id" in found.columns else found.select("id")
        if not hits.isEmpty():
            rows = seen.join(nodes.select("id", "project_id"), "id").select("project_id", F.col("id").alias("node_id"), F.lit(session or f"sess-{ulid()}").alias("session_id"), now.alias("accessed_at"))
            self.store.append("access_log", rows)
        return Answer({"project_ids": ids}, tables, "" if not hits.isEmpty() else self.suggestions(ids[0]))

    def recall_chunks(self, parent: str, start: int = 0, end: int = 3) -> Answer:
        start = max(0, start)
        end = max(start + 1, end)
        page = retrieve.chunk_page(self.table("chunks").where(F.col("parent_node_id") == parent), start, end)
        got = page.agg(F.count("*").alias("n"), F.max("total").alias("total"), F.max("next_start").alias("next")).first()
        values = {"returned_range": f"{start}-{start + got.n - 1} of {got.total}" if got.n else "none", "next_chunk_start": got.next if got.n else -1}
        return Answer(values, {"chunks": page.orderBy("place")})

    def query_graph(self, node: str, direction: str = "both", types: list[str] | None = None, limit: int = 20) -> Answer:
        nodes, edges = self.table("nodes"), self.table("edges")
        own = nodes.where(F.col("id") == node).select("title", S.excerpt(F.col("content")).alias("excerpt")).first()
        shown = written(graph.visible(edges.where((F.col("from_id") == node) | (F.col("to_id") == node)), nodes), "neighbourhood")
        return Answer({"node_id": node, "title": own.title if own else "", "content_excerpt": own.excerpt if own else ""}, {"edges": graph.neighbourhood(shown, node, limit, direction, types, nodes), "neighbor_counts": graph.neighbour_counts(shown, node, types)})

    def project_graph(self, project: str, stage: str = "", types: list[str] | None = None, max_edges: int = 5000, tiers: list[str] | None = None) -> Answer:
        id_ = self.scope(project, stage)
        placed = written(store.with_ends(self.table("edges"), self.table("nodes")), "placed-edges")
        nodes, edges = graph.project_graph(placed, self.table("nodes"), id_, types, max_edges, tiers)
        total = graph.edge_total(placed, id_, types or list(schema.PROJECT_GRAPH_TYPES)).first()[0]
        return Answer({"project_id": id_, "total_edges": total}, {"nodes": nodes, "edges": edges}, "" if total else self.suggestions(id_))

    def graph_data(self, project: str, stage: str = "", sidecars: list[str] | None = None, max_edges: int = 2000) -> Answer:
        id_ = self.scope(project, stage)
        placed = written(store.with_ends(self.table("edges"), self.table("nodes")), "placed-edges")
        nodes, edges = graph.graph_data(placed, self.table("nodes"), id_, sidecars, max_edges)
        return Answer({"project_id": id_, "total_edges": graph.edge_total(placed, id_, list(schema.GRAPH_DATA_TYPES)).first()[0]}, {"nodes": nodes, "edges": edges})

    def find_path(self, start: str, goal: str, max_depth: int = 10) -> Answer:
        path = graph.shortest_path(graph.visible(self.table("edges"), self.table("nodes")), start, goal, max_depth)
        return Answer({"from": start, "to": goal, "found": not path.isEmpty()}, {"hops": path.orderBy("hop")})

    def check_recent(self, project: str, stage: str = "", days: int = 7) -> Answer:
        own = self.table("nodes").where(F.col("project_id") == self.scope(project, stage))
        return Answer({}, {"nodes": store.updated_after(own, self.now() - F.make_dt_interval(F.lit(days))).select("id", "title", "node_type", "updated_at")})

    def linked_projects(self, project: str, stage: str = "") -> Answer:
        id_ = self.scope(project, stage)
        pairs = graph.linked_projects(store.with_ends(self.table("edges"), self.table("nodes")), stage=stage or None)
        return Answer({"project_id": id_}, {"linked_projects": pairs.where(F.col("project") == id_).select("other", "edges").orderBy("other")})

    # writes

    def _put(self, project: str, nodes: DataFrame, edges: DataFrame) -> None:
        """Upsert nodes and edges, cut and embed what has changed, and link what is alike: the write path of every source."""
        now, model = self.now(), self.embedder.model_id
        old = self.table("nodes")
        shaped = nodes
        for f in self.spark.createDataFrame([], schema.NODES).schema.fields:
            if f.name not in shaped.columns:
                shaped = shaped.withColumn(f.name, F.lit(None).cast(f.dataType))
        shaped = shaped.withColumns({"project_id": F.lit(project), "content_hash": F.sha2(F.coalesce("content", F.lit("")), 256), "row_seq": F.coalesce("row_seq", F.xxhash64("id"))}).select(*old.columns)
        self.store.write("embed_config", store.set_embed_status(self.table("embed_config"), project, model, "dirty", now))
        fresh = written(shaped, "new-nodes")
        work = written(ingest.changed(fresh, old, self.table("chunks")), "changed")  # against the nodes as they were before this write
        self.store.write("nodes", store.upsert_nodes(old, fresh, now))
        after, _ = store.upsert_edges(self.table("edges"), edges.withColumn("created_at", now).withColumn("bidirectional", F.coalesce(F.col("bidirectional"), F.lit(False))).select(*self.table("edges").columns), self.table("nodes"))
        self.store.write("edges", after)
        cut = ingest.chunk_documents(work.where("node_type <> 'directory'").select("id", "node_type", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("language", F.lit("")).alias("language")))
        cut = written(cut.withColumn("created_at", now), "new-chunks")
        stale_chunks, vectors = store.delete_chunks(work, self.table("chunks"), self.table("vectors"))
        vectors = vectors.join(work.select(F.col("id").alias("owner_id")), "owner_id", "left_anti").select(*vectors.columns)
        made = ingest.embed(work.where("node_type <> 'directory'").select("id", F.concat_ws("\n", "title", "content").alias("content")), self.embedder).unionByName(ingest.embed(cut.select("id", "content"), self.embedder, "chunk"))
        self.store.write("vectors", vectors.unionByName(made))
        shape = self.spark.createDataFrame([], schema.CHUNKS).columns
        for c in shape:
            if c not in cut.columns:
                cut = cut.withColumn(c, F.lit(None).cast("string"))
        self.store.write("chunks", store.upsert_chunks(stale_chunks, cut.select(*shape)))
        near = self.table("nodes").join(fresh.select("id"), "id", "left_semi").where("node_type <> 'directory'").join(self.table("vectors").where((F.col("model_id") == model) & (F.col("owner_kind") == "node")).select(F.col("owner_id").alias("id"), "embedding"), "id")
        alike = link.similarity_links(near.withColumn("source_path", F.coalesce("source_path", F.lit("")))).withColumn("bidirectional", F.lit(False)).withColumn("created_at", now)
        self.store.write("edges", store.merge_edges(self.table("edges").unionByName(alike.select(*self.table("edges").columns))))
        self.store.write("embed_config", store.set_embed_status(self.table("embed_config"), project, model, "clean", now))

    def remember(self, content: str, title: str, project: str = "default", node_type: str = "fact", id_: str = "", importance: float = 0.5, links: list[tuple[str, str]] | None = None, stage: str = "") -> Answer:
        """Keep a note; links: (other node, edge type). A project that is not there but nearly is one that is there is an error."""
        scope = self.scope(project, stage)
        base = S.base_project(F.lit(scope))
        names = store.project_ids(self.table("nodes")).select(S.base_project(F.col("project_id")).alias("name")).distinct()
        if names.where(F.col("name") == base).isEmpty() and (hint := self.suggestions(project or "default", names)):
            raise ValueError(hint)
        id_ = id_ or f"{scope}/{node_type}/{ulid()}"
        row = self.spark.createDataFrame([(id_, node_type, title, content, float(importance), "remember")], "id string, node_type string, title string, content string, importance double, source_adapter string")
        edges = self.spark.createDataFrame([(id_, to, kind, 1.0, "EXTRACTED", False) for to, kind in links or []], "from_id string, to_id string, edge_type string, confidence double, confidence_tier string, bidirectional boolean")
        job = self.jobs.start(scope, "remember", lambda job: self._put(scope, row, edges), wait=True)
        return Answer({"id": id_, "status": job.status, "error": job.error}, {})

    def ingest(self, root: str, project: str, stage: str = "local", mappings: list[dict[str, str]] | None = None, repository_url: str = "", wait: bool = True) -> Job:
        """Read a folder by all adapters that fit it, and put what they find into the graph."""
        scope = self.scope(project, stage)

        def work(job: Job) -> dict[str, int]:
            self.store.set_marker("ingest")
            job.progress("reading")
            tree = files.read_tree(self.spark, root)
            nodes, edges, counts = files.auto_detect(tree, scope, mappings)
            nodes, edges = written(nodes, "found-nodes"), written(edges.withColumn("bidirectional", F.lit(False)) if "bidirectional" not in edges.columns else edges, "found-edges")
            job.progress("hierarchy")
            dirs, contains = link.hierarchy(nodes.where("node_type <> 'code:package'").select("id", "source_path"), scope)
            code = nodes.where(F.col("node_type").startswith("code:") & (F.col("node_type") != "code:file"))
            conv, members = link.convention_graph(code.select("id", F.regexp_replace("source_path", "/?[^/]*$", "").alias("package"), F.substring_index("title", ".", -1).alias("name"), F.when(F.contains("title", F.lit(".")), S.before_last_dot(F.col("title"))).otherwise("").alias("receiver")), scope)
            all_nodes = nodes.unionByName(dirs.withColumn("title", S.display_name(F.col("source_path"))), allowMissingColumns=True).unionByName(conv, allowMissingColumns=True)
            all_edges = edges.unionByName(contains, allowMissingColumns=True).unionByName(members, allowMissingColumns=True)
            job.progress("writing")
            self._put(scope, all_nodes, all_edges)
            self.store.write("projects", store.upsert_project(self.table("projects"), scope, project, repository_url, self.now()))
            self.store.clear_marker("ingest")
            return {r.source_adapter: r.nodes for r in counts.collect()}

        return self.jobs.start(scope, "ingest", work, wait)

    def onboard(self, root: str, project: str, stage: str = "local", **options) -> Answer:
        """Ingest, unless the project is already whole for the model."""
        state = self.onboard_check(project, stage)
        if state.values["gated"]:
            return Answer({"status": "gated", "job_id": ""}, {}, f"project {project!r} is whole for model {self.embedder.model_id!r}; clear it to onboard anew")
        local = self.table("nodes").where(F.col("project_id") == self.scope(project, "local")).count() if stage != "local" else 0
        job = self.ingest(root, project, stage, **options)
        return Answer({"status": job.status, "job_id": job.id, "error": job.error, "result": job.result}, {}, store.stage_warning(project, stage, local))

    def forget(self, id_: str) -> Answer:
        ids = self.spark.createDataFrame([(id_,)], "id string")
        n, e, c, v = store.forget(ids, *(self.table(t) for t in ("nodes", "edges", "chunks", "vectors")))
        found = not self.table("nodes").where(F.col("id") == id_).isEmpty()
        for name, df in (("vectors", v), ("chunks", c), ("edges", e), ("nodes", n)):  # the node goes last, so a crash leaves nothing without its node
            self.store.write(name, written(df, name))
        return Answer({"id": id_, "status": "forgotten" if found else "not found"}, {})

    def link(self, from_id: str, to_id: str, edge_type: str, confidence: float = 1.0) -> Answer:
        self.store.write("edges", store.upsert_edge(self.table("edges"), self.table("nodes"), from_id, to_id, edge_type, confidence, as_of=self.now()))
        return Answer({"from": from_id, "to": to_id, "edge_type": edge_type, "status": "linked"}, {})

    def check_impact(self, id_: str, max_depth: int = 2, direction: str = "out") -> Answer:
        """Mark what a changed node makes stale, and return it."""
        seed = self.spark.createDataFrame([(id_,)], "start string")
        stale = written(graph.impact(self.table("edges"), seed, max_depth, direction, self.table("nodes")), "stale")
        self.store.write("nodes", graph.mark_stale(self.table("nodes"), self.table("edges"), seed, max_depth, direction))
        return Answer({"id": id_, "count": stale.count()}, {"stale_nodes": stale})

    def extract_and_remember(self, project: str, conversation: str, extractor=rule_extractor, wait: bool = True) -> Job:
        """Facts of a conversation become nodes; a fact that one of its kind already tells takes that one's id."""

        def work(job: Job) -> int:
            job.progress("extracting")
            facts = written(ingest.extract_facts(self.spark.createDataFrame([("c", conversation)], "id string, text string"), extractor), "facts")
            facts = written(facts.select(F.concat(F.lit(f"{project}/fact/"), F.substring(F.sha2("content", 256), 1, 16)).alias("id"), F.col("kind").alias("node_type"), "title", "content", "importance", F.lit("extract").alias("source_adapter")).dropDuplicates(["id"]), "facts")
            embedded = ingest.embed(facts.select("id", F.concat_ws("\n", "title", "content").alias("content")), self.embedder).select(F.col("owner_id").alias("id"), "embedding")
            nodes = self.table("nodes").where(F.col("project_id") == project).select("id", "node_type")
            known = self.table("vectors").where((F.col("model_id") == self.embedder.model_id) & (F.col("owner_kind") == "node")).select(F.col("owner_id").alias("id"), "embedding").join(nodes, "id")
            same = link.nearest_of_kind(embedded.join(facts.select("id", "node_type"), "id"), known)
            named = facts.join(same.select(F.col("fact").alias("id"), F.col("id").alias("known_id")), "id", "left").withColumn("id", F.coalesce("known_id", "id")).drop("known_id")
            job.progress("writing")
            self._put(project, named.dropDuplicates(["id"]), self.spark.createDataFrame([], schema.EDGES).drop("created_at"))
            return facts.count()

        return self.jobs.start(project, "extract", work, wait)

    def link_projects(self, project: str, most: int = 10_000) -> Answer:
        """Link a project's symbols, modules and vectors with those of all others."""
        nodes = self.table("nodes").where(F.col("node_type").startswith("code:"))
        mine, others = F.col("project_id") == project, F.col("project_id") != project
        sample = nodes.where(mine).orderBy(F.col("importance").desc(), "id").limit(most).unionByName(nodes.where(others))
        symbols = written(sample.select("id", "project_id", "node_type", S.label_of(F.col("title")).alias("label"), F.coalesce("language", F.lit("")).alias("lang"), "importance"), "link-symbols")
        code = symbols.where(~F.col("node_type").isin("code:package", "code:file") & (F.col("label") != ""))
        vectors = self.table("vectors").where(F.col("model_id") == self.embedder.model_id).select(F.col("owner_id").alias("id"), "embedding")
        found = link.cross_project_links(code).withColumn("confidence_tier", F.lit("INFERRED"))
        found = found.unionByName(link.module_links(symbols.where("node_type = 'code:package'").select("id", "project_id", F.col("label").alias("path")))).unionByName(link.vector_links(code.join(vectors, "id")))
        own = nodes.where(mine).select("id")
        touching = written(found.join(own.withColumnRenamed("id", "from_id"), "from_id", "left_semi").unionByName(found.join(own.withColumnRenamed("id", "to_id"), "to_id", "left_semi")).dropDuplicates(["from_id", "to_id", "edge_type"]), "links")
        self.store.write("edges", store.merge_edges(self.table("edges").unionByName(touching.withColumn("created_at", self.now()).select(*self.table("edges").columns))))
        return Answer({"edges_created": touching.count()}, {"edges": touching})

    def clear_project(self, project: str, stage: str = "", confirm: bool = False, model: str | None = None) -> Answer:
        if not confirm:
            raise ValueError("clearing a project must be confirmed")
        names = ("nodes", "edges", "chunks", "vectors", "embed_config", "access_log")
        after, counts = store.clear_project(self.scope(project, stage), {t: self.table(t) for t in names}, model)
        gone = written(counts, "cleared").first().asDict()
        after = {t: written(after[t], t) for t in names}  # all of them are made before the first is replaced
        for t in reversed(names):
            self.store.write(t, after[t])
        return Answer(gone, {})

    def consolidate(self, seconds: int = 86400, least: int = 3) -> Answer:
        """Co-accessed edges from the access log."""
        pairs = link.co_access(self.table("access_log"), self.now(), seconds, least)
        found = written(pairs.select("from_id", "to_id", F.lit("co-accessed").alias("edge_type"), F.lit(0.6).alias("confidence"), F.lit("INFERRED").alias("confidence_tier"), F.lit(True).alias("bidirectional"), self.now().alias("created_at")), "co-accessed")
        self.store.write("edges", store.merge_edges(self.table("edges").unionByName(found)))
        return Answer({"edges": found.count()}, {})

    def job_status(self, id_: str) -> Answer:
        job = self.jobs.get(id_)
        return Answer(job.state() if job else {"id": id_, "status": "unknown"}, {})

    def abort_ingestion(self, id_: str) -> Answer:
        return Answer({"id": id_, "aborted": self.jobs.abort(id_)}, {})

    def clone_repo(self, url: str, folder: str) -> Answer:
        """A shallow clone on the driver, of a remote that is one: no local path, no option."""
        if not self.spark.range(1).select(S.valid_remote(F.lit(url))).first()[0]:
            raise ValueError(f"no remote: {url!r}")
        done = subprocess.run(["git", "clone", "--depth", "1", "--", url, folder], capture_output=True, text=True, timeout=600)
        return Answer({"path": folder, "status": "cloned" if done.returncode == 0 else "failed", "error": done.stderr[-500:] if done.returncode else ""}, {})
