"""Adapters from file trees to nodes and edges. A tree is read once as (path, length, content); every adapter is a projection of it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S

#: What a tree holds besides its documents.
NOISE = (".git", ".hg", ".svn", "node_modules", "vendor", "dist", "build", "target", ".next", "__pycache__", ".venv", "venv", ".idea", ".vscode")
SECRET_NAMES = ("credentials", "credentials.yml", "credentials.yaml", "secrets.yml", "secrets.yaml")
SECRET_SUFFIXES = (".pem", ".key", ".secret", ".kubeconfig")
LARGEST = 1 << 20


def read_tree(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """(path from the root, length, content) of all files; the size filter is pushed to the listing."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    base = root.rstrip("/")
    return reader.load(root).where(F.col("length") <= LARGEST).select(F.regexp_replace("path", f"^(file:)?/*{re.escape(re.sub('^(file:)?/*', '', base))}/", "").alias("path"), "length", "content")


def clean(tree: DataFrame) -> DataFrame:
    """Without noise, secrets, large and binary files."""
    name, parts = F.substring_index("path", "/", -1), F.split("path", "/")
    noise = F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*[F.lit(x) for x in NOISE]))  # directories; a file may have such a name
    secret = name.startswith(".env") | name.isin(*SECRET_NAMES)
    for s in SECRET_SUFFIXES:
        secret = secret | name.endswith(s)
    zero = F.hex(F.substring("content", 1, 512)).rlike("^(..)*00")
    return tree.where(~noise & ~secret & (F.col("length") <= LARGEST) & ~zero)


def glob_regex(glob: str) -> str:
    """A glob with `**`, `*`, `?` and `{a,b}` as a regular expression over whole paths."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
        i += 1
    return f"^{out}$"


def classify(path: Column, mappings: list[dict[str, str]]) -> tuple[Column, Column]:
    """(node type, feature) of the first mapping that fits; null type if none does."""
    kind, feature = F.lit(None).cast("string"), F.lit("")
    for m in reversed(mappings):
        fits = path.rlike(glob_regex(m["path_glob"]))
        kind = F.when(fits, m["type"]).otherwise(kind)
        group = m.get("group_by")
        if group:
            names = re.findall(r"\(\?P<(\w+)>", group)
            java = group.replace("(?P<", "(?<")
            feature = F.when(fits, F.regexp_extract(path, java, 1 + names.index("feature") if "feature" in names else 1)).otherwise(feature)
        else:
            feature = F.when(fits, F.lit("")).otherwise(feature)
    return kind, feature


def _nodes(files: DataFrame, project: str, kind: Column, adapter: str, title: Column | None = None, id_: Column | None = None) -> DataFrame:
    text = F.decode("content", "UTF-8")
    path = F.col("path")
    return files.select((id_ if id_ is not None else F.concat(F.lit(f"{project}/"), path)).alias("id"), F.lit(project).alias("project_id"), kind.alias("node_type"), (title if title is not None else F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")).alias("title"), text.alias("content"), F.sha2("content", 256).alias("content_hash"), F.lit(adapter).alias("source_adapter"), path.alias("source_path"), F.lit(0.5).alias("importance"))


def documents(tree: DataFrame, project: str, mappings: list[dict[str, str]] | None = None) -> DataFrame:
    """Every clean file as a node with its feature; with mappings only files that one fits."""
    kind, feature = classify(F.col("path"), mappings or [])
    files = clean(tree)
    files = files.where(kind.isNotNull()) if mappings else files
    return _nodes(files, project, F.coalesce(kind, F.lit("generic-doc")), "docwalk").withColumn("feature", classify(F.col("source_path"), mappings or [])[1])


def memory_files(tree: DataFrame, project: str, name: str = "MEMORY.md") -> DataFrame:
    """Files of one name, one node for each directory."""
    files = clean(tree).where(F.substring_index("path", "/", -1).rlike(glob_regex(name)))
    directory = F.regexp_replace("path", r"/?[^/]*$", "")
    return _nodes(files, project, F.lit("generic-doc"), "gitrepo", id_=F.concat_ws("/", F.lit(project), F.when(directory != "", directory), F.lit("memory")))


def vault(tree: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """Notes with front matter as nodes, and `[[wiki links]]` as edges to notes that may not exist."""
    text = F.decode("content", "UTF-8")
    files = clean(tree).where(F.col("path").endswith(".md")).withColumn("front", F.when(text.startswith("---"), F.regexp_extract(text, r"(?s)^---\s*\n(.*?)\n---", 1)).otherwise(""))
    value = lambda key: F.trim(F.regexp_extract("front", rf"(?m)^{key}:\s*[\"']?([^\"'\n]*)", 1))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", "")
    id_ = lambda name: F.concat(F.lit(f"{project}/obsidian/"), name)
    kind, title = F.when(value("type") != "", value("type")).otherwise("obsidian-note"), F.when(value("name") != "", value("name")).otherwise(stem)
    nodes = _nodes(files, project, kind, "obsidian", title, id_(stem))
    target = F.explode(F.array_distinct(F.regexp_extract_all(F.decode("content", "UTF-8"), F.lit(r"\[\[([^\]|#]+)"), 1)))
    edges = files.select(id_(stem).alias("from_id"), target.alias("t")).select("from_id", id_(F.trim("t")).alias("to_id"), F.lit("related").alias("edge_type"), F.lit(0.8).alias("confidence"))
    return nodes, edges


def markdown_files(tree: DataFrame, project: str) -> DataFrame:
    path = F.lower(F.concat(F.lit("/"), "path"))
    kind = F.when(path.rlike("/adrs?/"), "architecture-decision").when(path.rlike("/(design|visual|ui)/"), "visual-design").otherwise("generic-doc")
    return _nodes(clean(tree).where(F.col("path").endswith(".md")), project, kind, "markdownglob")


def packages(tree: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """package.json files: a node for each package, and depends_on edges over the three kinds of dependencies."""
    found = tree.where(F.substring_index("path", "/", -1) == "package.json").withColumn("j", F.from_json(F.decode("content", "UTF-8"), "name string, dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>")).where(F.col("j.name").isNotNull())
    id_ = lambda name: F.concat(F.lit(f"{project}/pkg/"), name)
    nodes = _nodes(found, project, F.lit("code:package"), "packagejson", F.col("j.name"), id_(F.col("j.name")))
    names = lambda c: F.coalesce(F.map_keys(f"j.{c}"), F.array().cast("array<string>"))
    all_ = F.array_union(F.array_union(names("dependencies"), names("devDependencies")), names("peerDependencies"))
    edges = found.select(id_(F.col("j.name")).alias("from_id"), F.explode(all_).alias("d")).select("from_id", id_(F.col("d")).alias("to_id"), F.lit("depends_on").alias("edge_type"), F.lit(1.0).alias("confidence"))
    return nodes, edges


def path_aliases(tree: DataFrame) -> dict[str, str]:
    """Prefixes of module names and the directories they stand for, from the tsconfig.json files of a tree: a few rows for each module."""
    found = tree.where(F.substring_index("path", "/", -1) == "tsconfig.json").select(F.regexp_replace("path", "/?[^/]*$", "").alias("root"), F.from_json(F.decode("content", "UTF-8"), "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>").alias("j"))
    rows = found.select("root", F.coalesce("j.compilerOptions.baseUrl", F.lit(".")).alias("base"), F.explode("j.compilerOptions.paths").alias("name", "to")).where("size(to) > 0")
    place = S.resolve_link(F.col("root"), F.concat_ws("/", "base", F.regexp_replace(F.get("to", F.lit(0)), r"/?\*$", "")))
    return {r.prefix: r.place for r in rows.select(F.regexp_replace("name", r"\*$", "").alias("prefix"), place.alias("place")).orderBy("prefix").limit(1000).collect()}


def resolve_imports(imports: DataFrame, files: DataFrame, extensions: tuple[str, ...] = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".py"), aliases: dict[str, str] | None = None) -> DataFrame:
    """Imports (path, specifier) of relative modules, or of those under an alias, to the files (path) they mean: as they stand, with an extension, or
    a directory's index."""
    tries = ["", *extensions, *(f"/index{e}" for e in extensions)]
    parts = F.split("path", "/")
    base = S.resolve_link(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"), F.col("specifier"))
    known = F.col("specifier").startswith(".")
    for prefix, place in sorted((aliases or {}).items(), key=lambda x: len(x[0])):  # the longest prefix counts
        fits = F.col("specifier").startswith(prefix)
        base = F.when(fits, S.resolve_link(F.lit(place), F.substr("specifier", F.lit(len(prefix) + 1)))).otherwise(base)
        known = known | fits
    wanted = imports.where(known).withColumn("base", base).select("path", "specifier", "base", F.posexplode(F.array(*[F.lit(t) for t in tries])).alias("priority", "end"))
    hit = wanted.withColumn("target", F.concat("base", "end")).join(files.select(F.col("path").alias("target")), "target")
    return hit.groupBy("path", "specifier").agg(F.min_by("target", "priority").alias("target"))


MODULE_FILES = {"go.mod": "go", "package.json": "js", "pyproject.toml": "python", "Cargo.toml": "rust"}
MODULE_DEPTH = 6


def module_roots(tree: DataFrame) -> DataFrame:
    """(root, language) of the modules of a tree, at most MODULE_DEPTH directories deep; a package.json beside a tsconfig.json is TypeScript."""
    name, parts = F.substring_index("path", "/", -1), F.split("path", "/")
    table = F.create_map(*[F.lit(x) for pair in MODULE_FILES.items() for x in pair])
    noise = F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*[F.lit(x) for x in NOISE]))
    root = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
    found = tree.where((F.size(parts) <= MODULE_DEPTH) & ~noise).select(root.alias("root"), name.alias("name"))
    typed = found.where(F.col("name") == "tsconfig.json").select("root", F.lit(True).alias("ts")).distinct()
    modules = found.where(F.col("name").isin(*MODULE_FILES)).join(typed, "root", "left")
    return modules.select("root", F.when((F.col("name") == "package.json") & F.col("ts"), "ts").otherwise(table[F.col("name")]).alias("language")).distinct()


def repositories(paths: DataFrame, remotes: DataFrame | None = None) -> DataFrame:
    """(root, name, remote) of the git repositories among file paths (path); remotes: (root, url)."""
    found = paths.where(F.col("path").rlike("(^|/)\\.git/")).select(F.regexp_extract("path", "^(.*?)/?\\.git/", 1).alias("root")).distinct()
    named = found.withColumn("name", F.substring_index("root", "/", -1))
    if remotes is None:
        return named.withColumn("remote", F.lit(""))
    return named.join(remotes.select("root", S.remote_project(F.col("url")).alias("remote")), "root", "left").withColumn("remote", F.coalesce("remote", F.lit("")))


def find_repository(index: DataFrame, wanted: str) -> DataFrame:
    """The repository that a remote, a name or the end of a path means: a remote counts before a name, a name before a path, and long paths before short ones."""
    w, remote = F.lit(wanted.strip("/")), S.remote_project(F.lit(wanted))
    grade = F.when((F.col("remote") != "") & (F.col("remote") == remote), 0).when(F.col("name") == w, 1).when((F.col("root") == w) | F.col("root").endswith("/" + wanted.strip("/")), 2)
    return index.withColumn("grade", grade).where("grade IS NOT NULL").orderBy("grade", F.length("root").desc(), "root").limit(1).drop("grade")


def read_snippets(spark: SparkSession, path: str) -> DataFrame:
    """Rows (text) of a file of JSON lines."""
    return spark.read.schema("text string").json(path)


def calibration(scores: DataFrame, score: str = "similarity") -> tuple[DataFrame, DataFrame]:
    """(one row of count, mean, least, most and 90th percentile; counts of ten equal buckets of 0 to 1) of scores."""
    c = F.col(score)
    facts = scores.agg(F.count(c).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.min(c).alias("least"), F.max(c).alias("most"), F.round(F.percentile(c, 0.9), 6).alias("p90"))
    bucket = F.least(F.width_bucket(F.greatest(c, F.lit(0.0)), F.lit(0.0), F.lit(1.0), F.lit(10)), F.lit(10)).cast("int")
    return facts, scores.where(c.isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def auto_detect(tree: DataFrame, project: str, mappings: list[dict[str, str]] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, counts by adapter) of all adapters that fit a tree, concatenated; then calls across files and links between documents.

    Mappings make the tree a documented one. Without them, a tree with .obsidian is a vault, and markdown files are documents. Modules bring
    in the adapters of code and of packages. The facts that choose the adapters are a few booleans, read from the listing of paths."""
    from ..operators import link
    from . import code

    name = F.substring_index("path", "/", -1)
    has = tree.agg(F.coalesce(F.bool_or(F.col("path").rlike("(^|/)\\.obsidian/")), F.lit(False)).alias("vault"), F.coalesce(F.bool_or(name == "package.json"), F.lit(False)).alias("packages"), F.coalesce(F.bool_or(name == "MEMORY.md"), F.lit(False)).alias("memory"), F.coalesce(F.bool_or(F.col("path").rlike(code.SUFFIXES)), F.lit(False)).alias("code")).first()
    nodes, edges = [], []
    if mappings:
        nodes.append(documents(tree, project, mappings))
        edges.append(link.feature_links(nodes[0].select("id", "project_id", "node_type", "feature")).withColumn("confidence_tier", F.lit("EXTRACTED")))
    if has.vault:
        n, e = vault(tree, project)
        nodes.append(n)
        edges.append(e)
    elif not mappings:
        nodes.append(markdown_files(tree, project))
    if has.memory:
        nodes.append(memory_files(tree, project))
    if has.packages:
        n, e = packages(tree, project)
        nodes.append(n)
        edges.append(e)
    if has.code:
        n, e = code.graph_of(tree, project)
        nodes.append(n)
        edges.append(e)
    all_nodes = nodes[0]
    for n in nodes[1:]:
        all_nodes = all_nodes.unionByName(n, allowMissingColumns=True)
    all_nodes = all_nodes.dropDuplicates(["id"])
    edges.append(link.document_links(all_nodes.where(F.col("source_path").endswith(".md")).select("id", "source_path", "content")).withColumn("confidence_tier", F.lit("EXTRACTED")))
    all_edges = edges[0]
    for e in edges[1:]:
        all_edges = all_edges.unionByName(e, allowMissingColumns=True)
    return all_nodes, all_edges, adapter_counts(all_nodes)


def adapter_counts(nodes: DataFrame) -> DataFrame:
    """(source_adapter, nodes, with_content) of what adapters have made."""
    return nodes.groupBy("source_adapter").agg(F.count("*").alias("nodes"), F.count_if(F.length(F.coalesce("content", F.lit(""))) > 0).alias("with_content"))
