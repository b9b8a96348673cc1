"""Scalar functions of the memory graph, as Column expressions that stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "::stage:"
WEEK = 7 * 86400.0
DOCUMENT_TYPES = ("prd", "prd-detail", "erd", "api-spec", "test-case", "template", "foundation-doc", "design-doc", "generic-doc", "architecture-decision", "visual-design", "obsidian-note")  #: fixed values


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors, different lengths and zero norms; summed in double precision."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def non_finite(v: Column) -> Column:
    return F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def recency_decay(at: Column, as_of: Column, half_life: float = WEEK) -> Column:
    """Halves with every half life; 1 for what lies in the future."""
    return F.pow(F.lit(2.0), -F.greatest(F.unix_seconds(as_of) - F.unix_seconds(at), F.lit(0)) / F.lit(half_life))


def access_boost(count: Column, last: Column, as_of: Column) -> Column:
    recent = F.coalesce((F.unix_seconds(as_of) - F.unix_seconds(last)) < 3600, F.lit(False))
    return F.when(F.coalesce(count, F.lit(0)) <= 0, 1.0).otherwise((1 + 0.2 * F.log2(1 + count)) * F.when(recent, 1.3).otherwise(1.0))


def excerpt(text: Column, n: int = 200) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def terms(query: str) -> list[str]:
    """The words of a query, each as the tokenizer of texts cuts it."""
    import re

    return list(dict.fromkeys(re.findall(r"[^\W_]+", query.lower())))


def phrases(query: str) -> list[tuple[str, ...]]:
    """The terms of a query, which white space parts, each as the words that the tokenizer cuts it into."""
    import re

    return list(dict.fromkeys(t for f in query.lower().split() if (t := tuple(re.findall(r"[^\W_]+", f)))))


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def display_name(id_: Column) -> Column:
    return F.when(id_.endswith("/"), id_).otherwise(F.substring_index(id_, "/", -1))


def group_of(id_: Column, project: Column) -> Column:
    """The first path segment after the project, if more follows."""
    rest = F.when(id_.startswith(F.concat(project, F.lit("/"))), F.substr(id_, F.length(project) + 2)).otherwise(id_)
    return F.when(F.locate("/", rest) > 0, F.substring_index(rest, "/", 1)).otherwise("")


def encode_scope(base: Column, stage: Column) -> Column:
    """base::stage:<percent-encoded stage>; null for what no scope can hold."""
    good = (stage != "") & ~stage.rlike(r"[\x00-\x1f\x7f]") & ~F.contains(base, F.lit(MARK))
    return F.when(good, F.concat(F.when(base == "", "default").otherwise(base), F.lit(MARK), F.replace(F.url_encode(stage), F.lit("+"), F.lit("%20"))))


def base_project(project: Column) -> Column:
    return F.substring_index(project, MARK, 1)


def stage_of(project: Column) -> Column:
    """The stage of a scope, '' for none; null if it can't be decoded."""
    raw = F.when(F.contains(project, F.lit(MARK)), F.split_part(project, F.lit(MARK), F.lit(2)))
    bad = (raw == "") | raw.rlike(r"%(?![0-9A-Fa-f]{2})")
    return F.when(raw.isNull(), "").when(bad, None).otherwise(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))))


def edge_visible(from_project: Column, to_project: Column) -> Column:
    """Hidden only if both ends are staged and their stages differ; an unknown end hides nothing."""
    raw = lambda p: F.coalesce(F.when(F.contains(p, F.lit(MARK)), F.split_part(p, F.lit(MARK), F.lit(2))), F.lit(""))
    a, b = raw(from_project), raw(to_project)
    return (a == "") | (b == "") | (a == b)


def normalise_repository(url: Column) -> Column:
    """scp form to ssh; host in lower case; without credentials, query, fragment, .git and closing slashes."""
    u = F.regexp_replace(F.trim(url), r"^(?:[\w.-]+@)?([\w.-]+):(?!//)(.+)$", "ssh://$1/$2")
    u = F.regexp_replace(F.regexp_replace(u, r"[?#].*$", ""), r"^(\w+://)[^/@]*@", "$1")
    u = F.regexp_replace(F.regexp_replace(u, r"/+$", ""), r"\.git$", "")
    host = F.regexp_extract(u, r"^\w+://([^/]+)", 1)
    return F.when(host == "", "").otherwise(F.concat(F.regexp_extract(u, r"^(\w+://)", 1), F.lower(host), F.regexp_replace(u, r"^\w+://[^/]+", "")))


def remote_project(url: Column) -> Column:
    return F.regexp_replace(normalise_repository(url), r"^\w+://", "")


def remote_name(url: Column) -> Column:
    """The last segment of a remote's path."""
    return F.substring_index(remote_project(url), "/", -1)


def sidecar_project(project: Column) -> Column:
    """A project's id as a drawing names it: without its stage and its first segment."""
    base = base_project(project)
    return F.when(F.locate("/", base) > 0, F.regexp_replace(base, "^[^/]*/", "")).otherwise(base)


def floats_of(blob: Column) -> Column:
    """The 32-bit little-endian floats of a binary value, decoded in the JVM; bytes that make no whole float are left out."""
    quad = lambda i: F.conv(F.concat(*[F.substring(F.hex(blob), i * 8 + 7 - 2 * k, 2) for k in range(4)]), 16, 10).cast("long")

    def value(i: Column) -> Column:
        u = quad(i)
        sign, e, m = F.when(u >= 1 << 31, -1.0).otherwise(1.0), F.shiftright(u, 23).bitwiseAND(F.lit(255)), u.bitwiseAND(F.lit((1 << 23) - 1))
        finite = F.when(e == 0, m * 2.0**-149).otherwise((1 + m / float(1 << 23)) * F.pow(F.lit(2.0), e - 127))
        return (sign * F.when(e < 255, finite).when(m == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))).cast("float")

    n = F.floor(F.octet_length(blob) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), value)).otherwise(F.array().cast("array<float>"))


def ui_match(query: str, title: Column, id_: Column, project: Column, kind: Column) -> Column:
    """Whether a search box's text occurs in any of the four, whatever its case."""
    hit = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(query.strip().lower()))
    return hit(title) | hit(id_) | hit(project) | hit(kind)


def valid_remote(url: Column) -> Column:
    return url.rlike(r"^(https?://|ssh://|git@)\S+$") & ~url.startswith("-")


def identifier_tokens(name: Column) -> Column:
    """Lower-case words of an identifier; a word ends before a capital that follows a small letter."""
    return F.filter(F.split(F.lower(F.regexp_replace(F.translate(name, "-_.", "   "), "([a-z])([A-Z])", "$1 $2")), " +"), lambda x: x != "")


def identifier_overlap(a: Column, b: Column) -> Column:
    """Share of common tokens, on token arrays; repeats on the left count."""
    hits = F.size(F.filter(a, lambda x: F.array_contains(b, x)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(hits / F.greatest(F.size(a) + F.size(b) - hits, F.lit(1)))


def path_proximity(a: Column, b: Column) -> Column:
    """Leading segments that two paths share, over the longer one's number of segments; on arrays."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    shared = F.aggregate(same, F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, x: F.struct((s["on"] & x).alias("on"), F.when(s["on"] & x, s["n"] + 1).otherwise(s["n"]).alias("n")), lambda s: s["n"])
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(shared / F.greatest(F.size(a), F.size(b)))


def type_compatibility(a: Column, b: Column) -> Column:
    family = lambda t: F.when(F.locate(":", t) > 0, F.substring_index(t, ":", 1))
    return F.when(a == b, 1.0).when(F.coalesce(family(a) == family(b), F.lit(False)), 0.5).otherwise(0.0)


def collision_penalty(type_a: Column, path_a: Column, type_b: Column, path_b: Column) -> Column:
    """Documents of one file name in different directories are likely copies of a template."""
    name = lambda p: F.substring_index(p, "/", -1)
    both = type_a.isin(*DOCUMENT_TYPES) & type_b.isin(*DOCUMENT_TYPES)
    return F.when(both & (path_a != "") & (path_b != "") & (name(path_a) == name(path_b)) & (path_a != path_b), -0.2).otherwise(0.0)


def name_prefix(name: Column) -> Column:
    """The leading capitalised word of three letters or more, else the leading small letters, two at least."""
    pascal, small = F.regexp_extract(name, "^([A-Z][a-z]{2,})", 1), F.regexp_extract(name, "^([a-z]{2,})", 1)
    return F.when(pascal != "", pascal).otherwise(small)


def before_last_dot(name: Column) -> Column:
    return F.when(F.locate(".", name) > 0, F.regexp_extract(name, r"^(.*)\.[^.]*$", 1)).otherwise(name)


def after_last_dot(name: Column) -> Column:
    return F.when(F.locate(".", name) > 0, F.substring_index(name, ".", -1)).otherwise("")


def label_of(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"\(\)$", ""), r"^\.", "")


def module_root(path: Column) -> Column:
    """@scope/name, else the first three segments."""
    return F.when(path.startswith("@"), F.substring_index(path, "/", 2)).otherwise(F.substring_index(path, "/", 3))


def links_in(text: Column) -> Column:
    """Targets of inline, wiki and reference links in their order, without anchors and queries."""
    inline = F.regexp_extract_all(text, F.lit(r"\[[^\]]*\]\(([^)\s]+)[^)]*\)"), 1)
    wiki = F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#]+)[^\]]*\]\]"), 1)
    reference = F.regexp_extract_all(text, F.lit(r"(?m)^\[[^\]]+\]:\s*(\S+)"), 1)
    bare = F.transform(F.concat(inline, wiki, reference), lambda x: F.trim(F.regexp_replace(x, "[#?].*$", "")))
    return F.array_distinct(F.filter(bare, lambda x: (x != "") & is_local(x)))


def is_local(link: Column) -> Column:
    return ~link.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|//|#|!)")


def resolve_link(directory: Column, link: Column) -> Column:
    """A link's path from the root: `.` and `..` resolved, a leading slash is the root."""
    whole = F.when(link.startswith("/"), link).otherwise(F.concat_ws("/", directory, link))
    step = lambda path, x: F.when(x.isin("", "."), path).when((x == "..") & (F.size(path) > 0), F.slice(path, 1, F.size(path) - 1)).when(x == "..", path).otherwise(F.concat(path, F.array(x)))
    return F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/")


def fuzzy_match(a: Column, b: Column, most: int = 2) -> Column:
    x, y = F.lower(a), F.lower(b)
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x) | (F.levenshtein(x, y) <= most))


def parse_facts(reply: Column) -> Column:
    """Facts of a model's reply: the outermost JSON list, fences or prose around it notwithstanding; importance held to 0..1."""
    from ..schema import FACTS

    facts = F.from_json(F.regexp_extract(reply, r"(?s)(\[.*\])", 1), FACTS)
    fix = lambda f: F.struct(F.when(f["kind"].isin("fact", "entity"), f["kind"]).otherwise("fact").alias("kind"), f["title"].alias("title"), f["content"].alias("content"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(f["importance"], F.lit(0.5)))).alias("importance"))
    tidy = lambda f: (F.length(f["title"]) > 0) & (F.octet_length(f["title"]) <= 120) & (F.octet_length(f["content"]) <= 500) & ~F.concat(f["title"], f["content"]).rlike(r'[{}]|":')
    return F.filter(F.transform(facts, fix), tidy)
