import json

from pyspark.sql import functions as F

from graphloom.sources import code, files
from graphloom.streaming import access


def tree(spark, content):
    rows = [(p, len(c if isinstance(c, bytes) else c.encode()), c if isinstance(c, bytes) else c.encode()) for p, c in content.items()]
    return spark.createDataFrame(rows, "path string, length long, content binary")


MAPPINGS = [{"path_glob": "**/PRD/**/*.md", "type": "prd", "group_by": r"PRD/(?P<feature>[^/]+)/"}, {"path_glob": "**/APISpec/*.md", "type": "api-spec", "group_by": r"APISpec/(?P<feature>[^.]+)\.md"}]


def test_documents(spark):
    t = tree(spark, {"C/PRD/redeem/01.md": "# a", "C/APISpec/redeem.md": "b", "README.md": "r", ".git/x": "n", "a/node_modules/y.md": "n", ".env.local": "s", "k.pem": "s", "bin.dat": b"a\0b", "ok.txt": b"\x10\x01"})
    got = {(r.source_path, r.node_type, r.feature) for r in files.documents(t, "p", MAPPINGS).collect()}
    assert got == {("C/PRD/redeem/01.md", "prd", "redeem"), ("C/APISpec/redeem.md", "api-spec", "redeem")}
    assert {r.source_path for r in files.documents(t, "p").collect()} == {"C/PRD/redeem/01.md", "C/APISpec/redeem.md", "README.md", "ok.txt"}


def test_read_tree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "MEMORY.md").write_text("m")
    (tmp_path / "MEMORY.md").write_text("m")
    (tmp_path / "big.md").write_text("x" * (files.LARGEST + 1))
    t = files.read_tree(spark, str(tmp_path))
    assert {r.path for r in t.collect()} == {"a/MEMORY.md", "MEMORY.md"}
    assert {r.id for r in files.memory_files(t, "p").collect()} == {"p/a/memory", "p/memory"}


def test_vault_markdown_packages(spark):
    t = tree(spark, {"Arch.md": "---\nname: Architecture\ntype: design-doc\n---\nsee [[API Spec|spec]] and [[Other]]", "API Spec.md": "plain", "docs/adr/1.md": "x", "docs/design/2.md": "x", "package.json": json.dumps({"name": "app", "dependencies": {"a": "1"}, "devDependencies": {"a": "1", "b": "2"}})})
    nodes, edges = files.vault(t, "p")
    assert {(r.id, r.node_type, r.title) for r in nodes.collect()} >= {("p/obsidian/Arch", "design-doc", "Architecture"), ("p/obsidian/API Spec", "obsidian-note", "API Spec")}
    assert {(r.from_id, r.to_id) for r in edges.collect()} == {("p/obsidian/Arch", "p/obsidian/API Spec"), ("p/obsidian/Arch", "p/obsidian/Other")}
    kinds = {r.source_path: r.node_type for r in files.markdown_files(t, "p").collect()}
    assert kinds["docs/adr/1.md"] == "architecture-decision" and kinds["docs/design/2.md"] == "visual-design"
    nodes, edges = files.packages(t, "p")
    assert [r.title for r in nodes.collect()] == ["app"] and sorted(r.to_id for r in edges.collect()) == ["p/pkg/a", "p/pkg/b"]


def test_code(spark):
    t = tree(spark, {"a.py": "import os\nfrom .b import g\n\ndef f():\n    h()\n    g()\n\ndef h():\n    pass\n\nclass K:\n    def m(self):\n        self.x()\n", "b.go": "package b\n\nfunc Foo() {\n\tBar()\n\tfmt.Println()\n}\n\nfunc Bar() {}\n\ntype Widget struct{}\n", "bad.py": "def (", "c.txt": "x"})
    found = code.extract(t, "p")
    assert {(r.id, r.node_type) for r in code.nodes(found).collect()} >= {("p/a.py", "code:file"), ("p/a.py#f", "code:function"), ("p/a.py#K", "code:type"), ("p/a.py#K.m", "code:method"), ("p/b.go#Widget", "code:type"), ("p/bad.py", "code:file")}
    edges = {(r.from_id, r.to_id, r.edge_type) for r in code.edges(found).collect()}
    assert {("p/a.py#f", "p/a.py#h", "calls"), ("p/b.go#Foo", "p/b.go#Bar", "calls"), ("p/a.py", "p/a.py#K", "defines")} <= edges
    calls = {(r.callee_name, r.is_member_call) for r in code.raw_calls(found).collect()}
    assert {("g", False), ("Println", True), ("x", True)} <= calls


def test_import_resolution(spark):
    imports = spark.createDataFrame([("src/a.ts", "./b"), ("src/a.ts", "../lib"), ("src/a.ts", "react")], "path string, specifier string")
    there = spark.createDataFrame([("src/b.tsx",), ("src/b.js",), ("lib/index.ts",)], "path string")
    assert {(r.specifier, r.target) for r in files.resolve_imports(imports, there).collect()} == {("./b", "src/b.tsx"), ("../lib", "lib/index.ts")}


def test_streaming(spark, tmp_path):
    rows = [(f"s{i}", n, "2024-01-01 10:00:00") for i in range(3) for n in ("a", "b")]
    log = spark.createDataFrame(rows, "session_id string, node_id string, at string").select("session_id", "node_id", F.col("at").cast("timestamp").alias("accessed_at"), F.lit(1).alias("user_id"))
    log.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    out = []
    access.consolidate(stream, str(tmp_path / "log"), str(tmp_path / "cp"), lambda df: out.extend(df.collect())).awaitTermination(120)
    assert [(r.from_id, r.to_id, r.sessions) for r in out] == [("a", "b", 3)]
    assert [r.accesses for r in access.sessions(log).collect()] == [6] and {r.accesses for r in access.window_counts(log).collect()} == {3}
