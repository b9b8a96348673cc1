"""The tools over a store in a folder, with jobs and the HTTP front."""

import json
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalar as S
from graphloom.functions.embedding import HttpEmbedder, embedded_or_none, mean_pool, probe
from graphloom.http import serve
from graphloom.jobs import Jobs, ulid
from graphloom.operators import graph, ingest, link, store
from graphloom.sources import code, files
from graphloom.tables import Store
from graphloom.tools import Memory


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    for path, text in {
        "docs/guide.md": "# Guide\n\nHow coupons are redeemed, see [the api](api.md). " + "Coupons are kept for a year. " * 10,
        "docs/api.md": "# API\n\nThe redeem call takes a coupon and a customer. " * 6,
        "src/a.py": "class Coupon:\n    pass\n\n\ndef redeem(c: Coupon) -> bool:\n    return check_limit(c)\n\n\ndef redeem_all(cs):\n    pass\n",
        "src/b.py": "def check_limit(c):\n    return True\n",
        "pkg/package.json": '{"name": "@shop/ui", "dependencies": {"react": "1"}}',
        "pkg/tsconfig.json": "{}",
        "go.mod": "module x",
        ".env": "SECRET=1",
        "credentials.yml": "x: 1",
        "build": "a file, not a directory",
        "vendor/skip.md": "# no",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return str(root)


@pytest.fixture(scope="module")
def memory(spark, tree, tmp_path_factory):
    m = Memory(spark, "file://" + str(tmp_path_factory.mktemp("store")))
    job = m.ingest(tree, "shop", "main")
    assert job.status == "done", job.error
    return m


def ids(df, column="id"):
    return sorted(r[0] for r in df.select(column).collect())


def test_ingest(memory):
    scope = "shop::stage:main"
    nodes = {r.id: r for r in memory.table("nodes").collect()}
    assert {f"{scope}/docs/guide.md", f"{scope}/docs/api.md", f"{scope}/src/a.py#redeem", f"{scope}/src/b.py#check_limit", f"{scope}/dir/", f"{scope}/pkg/@shop/ui"} <= set(nodes)
    assert not any("skip" in i or ".env" in i or "credentials" in i for i in nodes)
    edges = {(r.from_id.removeprefix(scope + "/"), r.to_id.removeprefix(scope + "/"), r.edge_type) for r in memory.table("edges").collect()}
    assert {("docs/guide.md", "docs/api.md", "references"), ("src/a.py", "src/a.py#redeem", "defines"), ("src/a.py#redeem", "src/b.py#check_limit", "calls"), ("src/a.py#redeem", "src/a.py#Coupon", "references"), ("dir/", "dir/docs", "contains")} <= edges
    assert any(e[2] == "convention-member" for e in edges)
    assert not memory.store.has_marker("ingest") and memory.table("vectors").count() > 0 and memory.table("chunks").count() > 0
    assert memory.jobs.latest(scope).result["markdownglob"] == 2
    assert memory.onboard("nowhere", "shop", "main").values["status"] == "gated"
    check = memory.onboard_check("shop", "main").values
    assert check["gated"] and check["has_nodes"] and check["has_chunks"] and check["has_edges"]
    assert "did you mean" in memory.onboard_check("shop", "mainn").warning


def test_second_ingest_changes_nothing(memory, tree):
    before = {t: memory.table(t).count() for t in ("nodes", "edges", "chunks", "vectors")}
    assert memory.ingest(tree, "shop", "main").status == "done"
    assert {t: memory.table(t).count() for t in before} == before


def test_recall_and_graph(memory):
    scope = "shop::stage:main"
    got = memory.recall("redeem coupon", project_ids=[scope])
    rows = got.tables["results"].collect()
    assert rows and rows[0].place == 1 and {"guide", "api", "redeem"} & {r.title for r in rows}
    assert memory.table("access_log").count() == len(rows)
    assert json.loads(memory.recall("redeem", "shop", "main").json())["results"]
    assert memory.recall("redeem", all_projects=True).values["project_ids"] == [scope]
    with pytest.raises(ValueError):
        memory.scopes(project_ids=["a"], project_scopes=[("a", "b")])
    assert memory.scopes("shop", "main") == [scope, "shop"] and memory.scopes() == ["default"]
    near = memory.query_graph(f"{scope}/src/a.py#redeem")
    assert near.values["title"] == "redeem" and {r.edge_type: r.edges for r in near.tables["neighbor_counts"].collect()}["calls"] >= 1
    path = memory.find_path(f"{scope}/src/a.py", f"{scope}/src/b.py#check_limit").tables["hops"].collect()
    assert [r.edge_type for r in path] == [None, "defines", "calls"]
    drawn = memory.project_graph("shop", "main")
    assert drawn.values["total_edges"] > 0 and drawn.tables["nodes"].where("weight > 0").count() > 0
    assert memory.check_recent("shop", "main").tables["nodes"].count() > 0
    page = memory.recall_chunks(f"{scope}/docs/guide.md")
    assert page.values["returned_range"].startswith("0-") and memory.recall_chunks("none").values["returned_range"] == "none"
    assert memory.consolidate(least=1).values["edges"] > 0 and memory.init().values["model_id"] == memory.embedder.model_id


def test_remember_link_impact_forget(spark, tmp_path):
    m = Memory(spark, f"file://{tmp_path}/s")
    a = m.remember("Coupons expire after a year, that is decided.", "Expiry", "shop", "prd").values["id"]
    b = m.remember("The expiry job runs each night and ends old coupons.", "Job", "shop", links=[(a, "references")]).values["id"]
    with pytest.raises(ValueError, match="did you mean shop"):
        m.remember("x", "y", "shopp")
    m.link(a, b, "implements")
    assert m.check_impact(a).values["count"] == 1
    assert {r.id: r.status for r in m.table("nodes").collect()} == {a: "current", b: "stale"}
    m.remember("A note of a stage.", "S", "shop", id_="s1", stage="one")
    m.remember("A note of another stage.", "T", "shop", id_="t1", stage="two")
    with pytest.raises(ValueError, match="stages"):
        m.link("s1", "t1", "related")
    assert m.forget(b).values["status"] == "forgotten" and m.forget("none").values["status"] == "not found"
    assert ids(m.table("nodes")) == sorted([a, "s1", "t1"]) and m.table("vectors").where(F.col("owner_id") == b).count() == 0
    with pytest.raises(ValueError):
        m.clear_project("shop")
    assert m.clear_project("shop", confirm=True).values["nodes"] == 1 and ids(m.table("nodes")) == ["s1", "t1"]
    assert m.extract_and_remember("shop", "We decided to use Parquet for storage. The team must always write tests first.").result == 2
    assert m.extract_and_remember("shop", "We decided to use Parquet for storage.").status == "done" and m.table("nodes").where("project_id = 'shop'").count() == 2
    with pytest.raises(ValueError):
        m.clone_repo("--upload-pack=x", "y")


def test_link_projects(spark, tmp_path):
    m = Memory(spark, f"file://{tmp_path}/s")
    rows = [("a/f", "a", "code:function", "Run()", "", "python", 0.5), ("b/f", "b", "code:function", "Run", "", "python", 0.5), ("c/f", "c", "code:function", "Run", "", "rust", 0.5), ("a/p", "a", "code:package", "@x/y", "", "", 0.5), ("b/p", "b", "code:package", "@x/y/z", "", "", 0.5)]
    m.store.write("nodes", spark.createDataFrame(rows, "id string, project_id string, node_type string, title string, content string, language string, importance double"))
    m.store.write("vectors", spark.createDataFrame([("node", "a/f", m.embedder.model_id, [1.0, 0.1]), ("node", "b/f", m.embedder.model_id, [1.0, 0.0]), ("node", "c/f", m.embedder.model_id, [0.0, 1.0])], "owner_kind string, owner_id string, model_id string, embedding array<float>"))
    got = {(r.from_id, r.to_id, r.edge_type) for r in m.link_projects("a").tables["edges"].collect()}
    assert got == {("a/f", "b/f", "cross-project-call"), ("a/p", "b/p", "depends_on"), ("a/f", "b/f", "auto-linked")}
    assert m.linked_projects("a").tables["linked_projects"].first().other == "b"


def test_store(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/t")
    p = lambda *names: spark.createDataFrame([(n, n, "") for n in names], "project_id string, project_name string, repository_url string")
    assert s.read("projects").count() == 0
    for k in range(3):
        s.append("projects", p(f"p{k}"))
    assert ids(s.read("projects"), "project_id") == ["p0", "p1", "p2"] and s.versions("projects") == ["v000002", "v000003"]
    (tmp_path / "t/projects/v000004").mkdir()  # a write that crashed
    assert s.read("projects").count() == 3 and s.write("projects", p("q")).count() == 1
    s.set_marker("job")
    assert s.has_marker("job")
    s.clear_marker("job")
    assert not s.has_marker("job") and s.backup(f"file://{tmp_path}/b") == ["projects"] and s.backup(f"file://{tmp_path}/b") == []
    assert Store(spark, f"file://{tmp_path}/b").read("projects").count() == 1


def test_jobs(spark):
    jobs = Jobs(spark)
    begun, go = threading.Event(), threading.Event()

    def slow(job):
        begun.set()
        go.wait(20)
        job.progress("more", 1, 2)

    a = jobs.start("p", "ingest", slow)
    assert begun.wait(20) and jobs.abort(a.id)
    go.set()
    a.over.wait(20)
    assert a.state()["status"] == "aborted" and not jobs.abort(a.id) and not jobs.abort("none")
    b = jobs.start("p", "ingest", lambda job: 1 / 0, wait=True)
    assert b.status == "failed" and "ZeroDivision" in b.error and jobs.latest("p") is b
    assert len(ulid()) == 26 and ulid(1) < ulid(2) and ulid(0)[:10] == "0" * 10


def test_http(memory):
    server = serve(memory, token="key")
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_address[1]}"

    def get(path, key="key", data=None):
        try:
            with urllib.request.urlopen(urllib.request.Request(base + path, data, {"Authorization": f"Bearer {key}"})) as r:
                return r.status, json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)

    assert get("/health", "") == (200, {"status": "ok"}) and get("/api/projects", "no")[0] == 401
    assert get("/api/projects")[1]["projects"][0]["stage"] == "main" and get("/ingest/jobs/none")[0] == 404
    got = get("/graph/shop?stage=main&max_edges=50")[1]
    assert got["total_edges"] > 0 and got["nodes"] and {e["kind"] for e in got["edges"]} <= {"structural", "proposed"}
    assert get("/graph/shop/linked?stage=main")[1]["linked_projects"] == [] and get("/graph/a::stage:b")[0] == 400
    assert get("/ingest", data=b"{}")[0] == 400 and get("/none")[0] == 404
    server.shutdown()


def test_http_embedder(monkeypatch):
    import io

    replies = [{"data": [{"index": 1, "embedding": [0, 1]}, {"index": 0, "embedding": [1, 0]}]}, {"embeddings": [[1, 2]]}, {"data": [{"index": 1, "embedding": [0, 1]}]}, {"embeddings": [[1, 2, 3]]}]
    monkeypatch.setattr(urllib.request, "urlopen", lambda *a, **k: io.BytesIO(json.dumps(replies.pop(0)).encode()))
    e = HttpEmbedder("http://x", "m", dim=2)
    assert e.embed(["a", "b"]).tolist() == [[1, 0], [0, 1]] and probe(e) == 2
    with pytest.raises(ValueError):
        e.embed(["a"])
    with pytest.raises(ValueError):
        e.embed(["a"])

    class Slow:
        def embed(self, texts):
            raise OSError

    assert embedded_or_none(Slow(), "q") is None and embedded_or_none(None, "q") is None
    pooled = mean_pool(np.array([[[1.0, 0], [3, 0], [9, 9]]]), np.array([[1, 1, 0]]))
    assert pooled.tolist() == [[1, 0]]


def test_failed_batches_are_left_out(spark):
    class Picky:
        model_id, dim, max_chars = "p", 1, 100

        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError
            return np.ones((len(texts), 1))

    rows = spark.createDataFrame([("a", "good"), ("b", "bad"), ("c", "good")], "id string, content string").coalesce(1)
    assert ids(ingest.embed(rows, Picky(), batch_size=1), "owner_id") == ["a", "c"]
    calls = []

    def flaky(text):
        calls.append(text)
        if len(calls) < 2:
            raise OSError
        return "[]"

    assert ingest.retried(flaky, "x", 2) == "[]" and ingest.retried(lambda t: 1 / 0, "x", 2) is None


def test_sources(spark, tree):
    t = files.read_tree(spark, tree)
    assert {(r.root, r.language) for r in files.module_roots(t).collect()} == {("", "go"), ("pkg", "ts")}
    assert "build" in ids(files.clean(t), "path")
    paths = spark.createDataFrame([("x/shop/.git/HEAD",), ("y/shop/.git/HEAD",), ("y/shop/a.md",), ("z/tool/.git/HEAD",)], "path string")
    index = files.repositories(paths, spark.createDataFrame([("x/shop", "git@h.example:Org/shop.git")], "root string, url string"))
    find = lambda w: [r.root for r in files.find_repository(index, w).collect()]
    assert find("https://h.example/Org/shop") == ["x/shop"] and find("y/shop") == ["y/shop"] and find("tool") == ["z/tool"] and find("none") == []
    go = "type Widget struct {\n\tOwner *Person\n\tTags []map[string]Tag\n}\nfunc (w *Widget) Show(x []Item, f func(Arg) Res) (Out, error) {\n}\n"
    assert set(code.go_types(go)) == {("Widget", "Person"), ("Widget", "Tag"), *(("Widget.Show", t) for t in ("Widget", "Item", "Arg", "Res", "Out"))}
    assert code.python_types("class K:\n    x: 'A'\n    def f(self, y: list[B]) -> C: ...\n") == [("K", "A"), ("K.f", "B"), ("K.f", "list"), ("K.f", "C")] or set(code.python_types("class K:\n    x: 'A'\n    def f(self, y: list[B]) -> C: ...\n")) == {("K", "A"), ("K.f", "B"), ("K.f", "list"), ("K.f", "C")}


def test_scalars(spark):
    import struct

    df = spark.createDataFrame([(struct.pack("<5f", 1.5, -2.25, 0.0, 1e-40, float("inf")), "o/p::stage:x", "git@h.example:Org/Repo.git")], "b binary, p string, u string")
    r = df.select(S.floats_of(F.col("b")).alias("f"), S.sidecar_project(F.col("p")).alias("p"), S.remote_name(F.col("u")).alias("n"), S.remote_project(F.col("u")).alias("i")).first()
    assert r.f == pytest.approx([1.5, -2.25, 0.0, 1e-40, float("inf")], rel=1e-4) and (r.p, r.n, r.i) == ("p", "Repo", "h.example/Org/Repo")
    assert S.phrases('red-blue  Coupon "x"') == [("red", "blue"), ("coupon",), ("x",)]
    radius, hue = graph.node_look(F.lit(9), F.lit("g"))
    got = spark.range(1).select(radius.alias("r"), hue.alias("h")).first()
    assert got.r == 10.0 and 0 <= got.h < 360
    assert store.model_warning("dirty", 3, "m") and not store.model_warning("clean", 3, "m") and store.stage_warning("p", "main", 2) and not store.stage_warning("p", "local", 2)


def test_duplicates(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, embedding array<double>")
    assert link.is_duplicate([1.0, 0.1], rows) and not link.is_duplicate([-1.0, -1.0], rows)
    assert link.most_similar([0.2, 1.0], rows).first().id == "b" and link.most_similar([-1.0, -1.0], rows).count() == 0


def test_stages_in_reads(spark):
    nodes = spark.createDataFrame([("m", "r::stage:main"), ("n", "r::stage:main"), ("f", "r::stage:feat"), ("u", "r")], "id string, project_id string").withColumns({"title": F.lit("t"), "node_type": F.lit("fact")})
    e = spark.createDataFrame([("m", "f", "calls", 1.0, "INFERRED", False), ("m", "n", "calls", 1.0, "INFERRED", False), ("n", "u", "calls", 1.0, "INFERRED", True), ("m", "gone", "calls", 1.0, "INFERRED", False)], "from_id string, to_id string, edge_type string, confidence double, confidence_tier string, bidirectional boolean")
    seed = spark.createDataFrame([("m",)], "start string")
    assert ids(graph.bfs(e, seed, 3)) == ["f", "gone", "n", "u"] and ids(graph.bfs(e, seed, 3, nodes=nodes)) == ["n", "u"]
    assert ids(graph.neighbourhood(e, "m", nodes=nodes), "other") == ["gone", "n"]
    placed = store.with_ends(e, nodes)
    assert graph.project_edges(placed, "r::stage:main").first().total == 3 and graph.edge_total(placed, "none").first()[0] == 0
    assert graph.edges_of(e, "u").count() == 2


def test_go_packages_and_aliases(spark):
    rows = [("shop/a.go", b'package shop\n\nimport "fmt"\n\ntype Cart struct {\n}\n\nfunc (c *Cart) Add(x Item) {\n\tfmt.Println(x)\n\tcheck(x)\n}\n'), ("shop/b.go", b"package shop\n\ntype Item struct {\n}\n\nfunc check(x Item) {\n}\n"), ("web/tsconfig.json", b'{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"]}}}'), ("web/app.ts", b"import { f } from '@/lib/f'\nexport function run() {\n  f()\n}\n"), ("web/src/lib/f.ts", b"export function f() {\n  return 1\n}\n")]
    tree = spark.createDataFrame([(p, len(c), c) for p, c in rows], "path string, length long, content binary")
    assert files.path_aliases(tree) == {"@/": "web/src"}
    nodes, edges = code.graph_of(tree, "p")
    kinds = {r.id: r.node_type for r in nodes.collect()}
    assert kinds["p/shop/a.go#Cart.Add"] == "code:method" and kinds["p/pkg/shop"] == "code:package"
    got = {(r.from_id, r.to_id, r.edge_type) for r in edges.collect()}
    assert {("p/pkg/shop", "p/shop/a.go", "defines"), ("p/pkg/shop", "p/pkg/fmt", "imports"), ("p/shop/a.go#Cart.Add", "p/shop/b.go#Item", "references"), ("p/shop/a.go#Cart.Add", "p/shop/b.go#check", "calls"), ("p/web/app.ts", "p/web/src/lib/f.ts", "imports"), ("p/web/app.ts#run", "p/web/src/lib/f.ts#f", "calls")} <= got


def test_large_declarations():
    from graphloom.functions.chunking import code as cut

    body = "".join(f"    def m{k}(self):\n        return {k}\n\n" for k in range(30))
    got = cut("class K:\n" + body, "python", 200)
    assert all(len(c.text) <= 200 for c in got) and [c.path for c in got][:3] == [["K"], ["K", "m0"], ["K", "m1"]] and len(got) == 31
    flat = cut("function f() {\n" + "  step()\n" * 100 + "}", "js", 90)
    assert all(len(c.text) <= 90 and c.path == ["f"] for c in flat) and "\n".join(c.text for c in flat).count("step") == 100


def test_similarity_in_chunks(spark, monkeypatch):
    import random

    rng = random.Random(3)
    rows = [(f"n{i:02}", rng.choice(["code:function", "prd", "erd", None]), rng.choice(["getUser", "user_user", "makeIt"]), rng.choice(["a/x.md", "a/b/x.md", "", None]), [rng.gauss(0, 1) for _ in range(3)]) for i in range(40)]
    n = spark.createDataFrame(rows, "id string, node_type string, title string, source_path string, embedding array<double>")
    want = {tuple(r) for r in link.similarity_links(n).collect()}
    monkeypatch.setattr(link, "CHUNK", 5)
    assert want and {tuple(r) for r in link.similarity_links(n).collect()} == want


def test_consolidated_stream(spark, tmp_path):
    from graphloom.streaming import access

    schema = "session_id string, node_id string, accessed_at timestamp"
    for day, sessions in ((1, ("a", "b")), (9, ("c", "d", "e"))):
        rows = spark.createDataFrame([(s, n) for s in sessions for n in ("x", "y")], "session_id string, node_id string").withColumn("accessed_at", F.lit(f"2024-01-0{day} 10:00:00").cast("timestamp"))
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        found = []
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        access.consolidate(stream, f"{tmp_path}/log", f"{tmp_path}/check", lambda df, found=found: found.append(df.collect()), least=2).awaitTermination()
        assert [(r.from_id, r.to_id, r.sessions) for r in found[-1]] == [("x", "y", len(sessions))]
    assert spark.read.parquet(f"{tmp_path}/log").count() == 10
    log = store.log_access(spark.createDataFrame([], "project_id string, node_id string, session_id string, accessed_at timestamp"), spark.createDataFrame([("n", "p")], "id string, project_id string"), "s", F.lit("2024-01-01").cast("timestamp"))
    assert store.access_stats(log).first().access_count == 1
