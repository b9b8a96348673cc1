import itertools

import pytest
from pyspark.sql import functions as F

from graphloom.operators import graph, ingest, link, retrieve, store

EDGE = "from_id string, to_id string, edge_type string, confidence double, confidence_tier string, bidirectional boolean, created_at timestamp"


def edges(spark, *rows):
    return spark.createDataFrame([(*r, None)[:7] if len(r) == 6 else (*r, 1.0, "INFERRED", False, None)[:7] for r in rows], EDGE)


def ids(df, column="id"):
    return sorted(r[0] for r in df.select(column).collect())


@pytest.fixture
def impact_edges(spark):
    return edges(spark, ("prd", "api", "implements"), ("prd", "test", "tests"), ("prd", "erd", "specifies"), ("prd", "other", "related"))


def test_impact(spark, impact_edges):
    seed = spark.createDataFrame([("prd",)], "start string")
    assert ids(graph.impact(impact_edges, seed)) == ["api", "erd", "test"]
    assert ids(graph.bfs(impact_edges, seed, 1)) == ["api", "erd", "other", "test"]


def test_merge_is_idempotent_and_ordered(spark):
    rows = [("a", "b", "calls", 0.0, "PROPOSED", False), ("a", "b", "calls", 0.4, "EXTRACTED", True), ("a", "b", "calls", 0.7, "", False), ("", "b", "calls", 1.0, "", False)]
    want = [("a", "b", "calls", 1.0, "EXTRACTED", True)]
    for p in itertools.permutations(rows):
        once = store.merge_edges(edges(spark, *p))
        assert [tuple(r)[:6] for r in once.collect()] == want
        break
    assert [tuple(r)[:6] for r in store.merge_edges(once.union(once)).collect()] == want


def test_stages_keep_apart(spark):
    nodes = spark.createDataFrame([("m", "r::stage:main"), ("f", "r::stage:feat"), ("u", "r")], "id string, project_id string")
    new = edges(spark, ("m", "f", "calls"), ("m", "u", "calls"), ("m", "missing", "related"))
    kept, skipped = store.upsert_edges(edges(spark).limit(0) if False else new.limit(0), new, nodes)
    assert ids(kept, "to_id") == ["missing", "u"] and ids(skipped, "to_id") == ["f"]


def test_guard_and_chunks(spark):
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [float("nan"), 1.0]), ("c", [1.0])], "owner_id string, embedding array<float>")
    ok, skipped = store.guard_vectors(v, 2)
    assert ids(ok, "owner_id") == ["a"] and ids(skipped, "owner_id") == ["b", "c"]
    c = "id string, parent_node_id string, chunk_index int, prev_chunk_id string, next_chunk_id string"
    old = spark.createDataFrame([("x0", "x", 0, "", ""), ("y0", "y", 0, "", "")], c)
    new = spark.createDataFrame([("y1a", "y", 1, "", ""), ("y1b", "y", 1, "", ""), ("y0n", "y", 0, "", "")], c)
    got = {r.id: (r.prev_chunk_id, r.next_chunk_id) for r in store.upsert_chunks(old, new).collect()}
    assert got == {"x0": ("", ""), "y0n": ("", "y1b"), "y1b": ("y0n", "")}


def test_forget_cascades(spark, impact_edges):
    nodes = spark.createDataFrame([("prd",), ("api",)], "id string")
    chunks = spark.createDataFrame([("c", "prd")], "id string, parent_node_id string")
    vectors = spark.createDataFrame([("c",), ("prd",), ("api",)], "owner_id string")
    n, e, c, v = store.forget(spark.createDataFrame([("prd",)], "id string"), nodes, impact_edges, chunks, vectors)
    assert ids(n) == ["api"] and e.count() == 0 and c.count() == 0 and ids(v, "owner_id") == ["api"]


def test_embed_status(spark):
    none = spark.createDataFrame([], "project_id string, model_id string, status string, created_at timestamp")
    t = lambda d: F.lit(f"2024-01-0{d} 00:00:00").cast("timestamp")
    dirty = store.set_embed_status(none, "p", "m", "dirty", t(1))
    done = store.set_embed_status(dirty, "p", "m", "clean", t(2)).collect()
    assert [(r.status, r.created_at.day) for r in done] == [("clean", 1)]


def test_shortest_path(spark):
    e = edges(spark, ("a", "b", "x"), ("b", "c", "x"), ("a", "d", "x"), ("d", "c", "x"), ("c", "e", "x", 1.0, "INFERRED", True))
    path = lambda a, b: [r.id for r in graph.shortest_path(e, a, b).orderBy("hop").collect()]
    assert path("a", "c") == ["a", "b", "c"] and path("a", "a") == ["a"] and path("e", "c") == ["e", "c"] and path("c", "a") == []


def test_shortest_path_merges_along_the_path(spark, monkeypatch):
    e = edges(spark, ("b", "a", "x", 0.3, "INFERRED", True), ("b", "a", "x", 0.0, "PROPOSED", False), ("b", "c", "y", 0.2, "", False), ("b", "c", "y", 0.4, "", False), ("b", "c", "z", 0.3, "", False), ("q", "c", "x", 0.9, "", True))
    want = [(0, "a", None, None), (1, "b", "x", 1.0), (2, "c", "y", 0.4)]
    for small in (graph.SMALL, 0):
        monkeypatch.setattr(graph, "SMALL", small)
        assert [tuple(r) for r in graph.shortest_path(e, "a", "c", merge=store.merge_edges).orderBy("hop").collect()] == want
    assert [tuple(r) for r in graph.shortest_path(store.merge_edges(e), "a", "c").orderBy("hop").collect()] == want


def test_hierarchy(spark):
    files = spark.createDataFrame([("1", "Acme/Alpha/PRD/rbac/00-index.md"), ("2", "Acme/Bravo/PRD/single-feature/00-index.md")], "id string, source_path string")
    nodes, e = link.hierarchy(files, "p")
    assert ids(nodes) == ["p/dir/", "p/dir/Acme", "p/dir/Acme/Alpha/PRD/rbac", "p/dir/Acme/Bravo/PRD/single-feature"]
    assert {(r.from_id, r.to_id) for r in e.collect()} >= {("p/dir/Acme", "p/dir/Acme/Bravo/PRD/single-feature"), ("p/dir/", "p/dir/Acme"), ("p/dir/Acme/Alpha/PRD/rbac", "1")}
    nodes, e = link.hierarchy(files.limit(0), "p")
    assert ids(nodes) == ["p/dir/"] and e.count() == 0


def test_similarity_blocking_loses_nothing(spark):
    import random

    rng = random.Random(4)
    rows = [(f"n{i}", rng.choice(["code:function", "code:type", "prd"]), rng.choice(["getUser", "setUser", "userId", "make_it", "getIt"]), rng.choice(["a/b/x.py", "a/c/y.py", "z/q.py", "k.md"]), [rng.gauss(0, 1) for _ in range(3)]) for i in range(40)]
    n = spark.createDataFrame(rows, "id string, node_type string, title string, source_path string, embedding array<double>")
    blocked = {(r.from_id, r.to_id) for r in link.similarity_links(n).collect()}
    all_ = link.similarity_links(n.withColumn("title", F.concat("title", F.lit("_w"))))  # a shared word makes every pair a candidate
    assert blocked and all_.count() > 0
    import numpy as np

    def score(a, b):
        import re

        tok = lambda s: re.sub("([a-z])([A-Z])", r"\1 \2", re.sub("[-_.]", " ", s)).lower().split()
        x, y = np.array(a[4]), np.array(b[4])
        cos = x @ y / np.sqrt((x @ x) * (y @ y))
        ty = 1 if a[1] == b[1] else 0.5 if ":" in a[1] and ":" in b[1] else 0
        p, q = a[3].split("/"), b[3].split("/")
        k = next((i for i, (u, v) in enumerate(zip(p, q)) if u != v), min(len(p), len(q)))
        t, u = tok(a[2]), tok(b[2])
        m = sum(w in u for w in t)
        return 0.4 * cos + 0.2 * ty + 0.2 * k / max(len(p), len(q)) + 0.2 * m / (len(t) + len(u) - m)

    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and round(score(a, b), 6) >= 0.55}
    assert blocked == want


def test_large_keys_are_dealt_where_they_lie(spark, monkeypatch):
    rows = [(f"n{i:03}", "prd" if i % 3 else "erd", "one two", f"a/{i}.md", [1.0, i / 100, 0.5]) for i in range(60)]
    n = spark.createDataFrame(rows, "id string, node_type string, title string, source_path string, embedding array<double>")
    want = sorted(link.similarity_links(n).collect())
    monkeypatch.setattr(link, "CHUNK", 8)
    dealt = link.similarity_links(n)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Aggregate" not in plan  # no task has all copies of a key, and pairs leave once
    got = sorted(dealt.collect())
    assert got == want and len({r[:2] for r in got}) == len(got) == 60 * 59 // 2


def test_cosines_in_parts(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    v = rng.standard_normal((6, 4))[rng.integers(0, 6, 300)] + 0.3 * rng.standard_normal((300, 4)) * (np.arange(300) % 3 > 0)[:, None]  # with copies, which tie
    n = spark.createDataFrame([(f"n{i:03}", "ab"[i % 2], x.tolist()) for i, x in enumerate(v)] + [("z", "a", [0.0] * 4), ("y", "a", None), ("x", "a", [1.0, float("nan"), 0.0, 0.0]), ("w", "b", [1.0, 2.0])], "id string, node_type string, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -9)
    best = {f"n{i:03}": sorted((-x, f"n{j:03}") for j, x in enumerate(r) if j != i)[:5] for i, r in enumerate(s)}
    want = {a: next((b, -x) for x, b in near if (int(a[1:]) - int(b[1:])) % 2 == 0 and -x >= 0.71) for a, near in best.items() if any((int(a[1:]) - int(b[1:])) % 2 == 0 and -x >= 0.71 for x, b in near)}
    monkeypatch.setattr(link, "SIDE", 40)
    monkeypatch.setattr(link, "BLOCK", 16)
    found = link.nearest_of_kind(n, n)
    assert len(want) > 200 and {r.fact: (r.id, r.similarity) for r in found.collect()} == want
    assert {(r.a, r.b) for r in link.blocked_cosines(n, n, k=5).collect()} == {(a, b) for a, near in best.items() for _, b in near}
    some = n.where("id < 'n020'")
    assert {(r.a, r.b) for r in link.blocked_cosines(some, n, 0.9, strict=True).collect()} == {(f"n{i:03}", f"n{j:03}") for i, j in zip(*np.nonzero(s[:20] > 0.9))}
    groups = link.blocked_cosines(n, n, 0.71)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in groups and "REPARTITION_BY_NUM" in groups  # no task has all blocks of a length


def test_call_resolution(spark):
    calls = spark.createDataFrame([("f", "g", "py", "a.py"), ("f", "h", "ts", "a.ts"), ("f", "k", "ts", "a.ts")], "caller string, callee string, lang string, file string")
    symbols = spark.createDataFrame([("G", "g", "py", "b.py"), ("H", "h", "ts", "b.ts"), ("K1", "k", "ts", "b.ts"), ("K2", "k", "ts", "c.ts")], "id string, label string, lang string, file string")
    imports = spark.createDataFrame([("a.ts", "b.ts")], "file string, target_file string")
    got = {(r.to_id, r.confidence) for r in link.resolve_calls(calls, symbols, imports).collect()}
    assert got == {("G", 0.8), ("H", 1.0), ("K1", 1.0)}


def test_features_and_links(spark):
    docs = spark.createDataFrame([("p", "P", "prd", "x"), ("a", "P", "api-spec", "x"), ("t", "P", "test-case", "x"), ("e", "P", "erd", "y")], "id string, project_id string, node_type string, feature string")
    assert {(r.from_id, r.to_id, r.edge_type) for r in link.feature_links(docs).collect()} == {("a", "p", "implements"), ("t", "p", "tests")}
    md = spark.createDataFrame([("1", "d/a.md", "see [b](../b.md) and [x](none.md)"), ("2", "b.md", "")], "id string, source_path string, content string")
    assert [(r.from_id, r.to_id) for r in link.document_links(md).collect()] == [("1", "2")]


def test_lexical_and_recall(spark):
    t = F.lit("2024-01-02 00:00:00").cast("timestamp")
    nodes = spark.createDataFrame([("a", "Coupon Redeem", "coupon redeem flow", 1, 0.9), ("b", "Coupon Expiry", "when a coupon expires", 2, 0.5), ("c", "Login Flow", "login", 3, 0.5), ("z", "Zero", "coupon", 4, 0.0)], "id string, title string, content string, row_seq long, importance double").withColumns({"updated_at": t, "created_at": t, "project_id": F.lit("p")})
    assert ids(retrieve.lexical(nodes, "coupon", 10)) == ["a", "b", "z"] and [r.id for r in retrieve.lexical(nodes, "coupon", 10, "rowid").orderBy("rank").collect()] == ["a", "b", "z"]
    assert retrieve.lexical(nodes, "", 10).count() == 0
    vectors = spark.createDataFrame([("a", "m", [1.0, 0.0]), ("c", "m", [0.0, 1.0])], "owner_id string, model_id string, embedding array<double>")
    e = edges(spark, ("a", "c", "related", 0.3, "INFERRED", False))
    got = retrieve.recall(nodes, vectors, e, "coupon", [1.0, 0.0], t, 2).collect()
    assert got[0].id == "a" and got[0].match_type == "hybrid" and "z" not in [r.id for r in got]
    assert [r.match_type for r in retrieve.recall(nodes, vectors, None, "coupon", None, t, 5).collect()] == ["lexical", "lexical"]


def test_chunks_embed_facts(spark):
    from graphloom.functions.chunking import chunks_of, code, markdown
    from graphloom.functions.embedding import HashingEmbedder

    text = "# A\n" + "x" * 120 + "\n```\n# no heading\n```\n## B\nshort\n## C\n" + "y" * 150
    got = markdown(text)
    assert [c.path for c in got] == [["A"], ["A", "C"]]
    assert all(len(c.text) <= 200 for c in chunks_of("Word one. " * 400, "generic-doc", "", 200))
    assert [c.path for c in code("import x\n\ndef f():\n    pass\n\nclass K:\n    pass\n", "python")] == [[], ["f"], ["K"]]
    assert [c.path for c in code("package p\nfunc (s *S) Get() {\n}\ntype User struct {\n}\n", "go")] == [[], ["Get"], ["User"]]
    assert chunks_of("", "generic-doc") == [] and chunks_of(None, None) == []
    nodes = spark.createDataFrame([("n", "generic-doc", text), ("e", "generic-doc", ""), ("u", None, None)], "id string, node_type string, content string")
    assert [(r.chunk_index, r.parent_node_id) for r in ingest.chunk_documents(nodes).orderBy("chunk_index").collect()] == [(0, "n"), (1, "n")]
    v = ingest.embed(nodes, HashingEmbedder(16)).collect()
    assert len(v) == 1 and sum(x * x for x in v[0].embedding) == pytest.approx(1, abs=1e-5)
    facts = ingest.extract_facts(spark.createDataFrame([(1, "We decided to use Parquet for storage. Hi there. The team must always write tests first.")], "id long, text string")).collect()
    assert len(facts) == 2 and facts[0].kind == "fact"
    new = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", "h3")], "id string, content_hash string")
    old = spark.createDataFrame([("a", "h1"), ("b", "h0"), ("c", "h3")], "id string, content_hash string")
    assert ids(ingest.changed(new, old, spark.createDataFrame([("a",), ("b",)], "parent_node_id string"))) == ["b", "c"]
