import math

import pytest
from pyspark.sql import functions as F

from graphloom.functions import scalar as S


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def arr(*x):
    return F.array(*[F.lit(v) for v in x])


@pytest.mark.parametrize("name, prefix", [("GetUserByID", "Get"), ("handleRequest", "handle"), ("NewServer", "New"), ("isValid", "is"), ("toJSON", "to"), ("x", ""), ("ab", "ab"), ("abc123", "abc")])
def test_name_prefix(spark, name, prefix):
    assert value(spark, S.name_prefix(F.lit(name))) == prefix


@pytest.mark.parametrize("name, tokens", [("GetUserByID", ["get", "user", "by", "id"]), ("handle_request", ["handle", "request"]), ("to-json", ["to", "json"]), ("hello", ["hello"])])
def test_identifier_tokens(spark, name, tokens):
    assert value(spark, S.identifier_tokens(F.lit(name))) == tokens


def test_overlap_and_paths(spark):
    t = lambda x: S.identifier_tokens(F.lit(x))
    assert value(spark, S.identifier_overlap(t("GetUserByID"), t("GetUser"))) > 0
    assert value(spark, S.identifier_overlap(t("FooBar"), t("BazQux"))) == 0
    assert value(spark, S.identifier_overlap(t("FooBar"), t("FooBar"))) == 1
    p = lambda x: F.split(F.lit(x), "/")
    assert value(spark, S.path_proximity(p("a/b/c.go"), p("a/b/d.go"))) == pytest.approx(2 / 3)
    assert value(spark, S.path_proximity(p("a/b/c.go"), p("x/y/d.go"))) == 0


def test_types_and_collisions(spark):
    c = lambda a, b: value(spark, S.type_compatibility(F.lit(a), F.lit(b)))
    assert (c("prd", "prd"), c("code:function", "code:type"), c("code:function", "generic-doc")) == (1.0, 0.5, 0.0)
    k = lambda *x: value(spark, S.collision_penalty(*map(F.lit, x)))
    assert k("prd", "a/x.md", "erd", "b/x.md") == -0.2
    assert k("prd", "a/x.md", "erd", "a/y.md") == k("code:file", "a/x.md", "erd", "b/x.md") == 0


def test_cosine_and_decay(spark):
    c = lambda a, b: value(spark, S.cosine(a, b))
    assert c(arr(1.0, 0.0), arr(0.0, 1.0)) == 0 and c(arr(1.0, 2.0), arr(1.0, 2.0)) == pytest.approx(1) and c(arr(1.0), arr(1.0, 2.0)) == 0 and c(arr(0.0), arr(0.0)) == 0
    at = lambda s: F.timestamp_seconds(F.lit(s))
    d = lambda days: value(spark, S.recency_decay(at(0), at(days * 86400)))
    assert [d(0), d(7), d(14), d(-3)] == [1, 0.5, 0.25, 1]
    assert value(spark, S.access_boost(F.lit(3), at(0), at(10))) == pytest.approx(1.4 * 1.3) and value(spark, S.access_boost(F.lit(0), at(0), at(10))) == 1


@pytest.mark.parametrize("stage", ["main", "feature/auth", "100%done", "分支", "::stage:x", " ", "a+b"])
def test_scope_round_trip(spark, stage):
    assert value(spark, S.stage_of(S.encode_scope(F.lit("repo"), F.lit(stage)))) == stage


def test_scope_errors(spark):
    assert value(spark, S.encode_scope(F.lit("repo"), F.lit(""))) is None and value(spark, S.encode_scope(F.lit("a::stage:b"), F.lit("x"))) is None and value(spark, S.encode_scope(F.lit("r"), F.lit("a\x01"))) is None
    assert value(spark, S.stage_of(F.lit("repo::stage:%zz"))) is None and value(spark, S.stage_of(F.lit("repo::stage:"))) is None and value(spark, S.stage_of(F.lit("repo"))) == ""
    assert value(spark, S.encode_scope(F.lit(""), F.lit("x"))) == "default::stage:x"


@pytest.mark.parametrize("a, b, ok", [("r", "r", True), ("r::stage:main", "r", True), ("r", "r::stage:main", True), ("r::stage:main", "q::stage:main", True), ("r::stage:main", "r::stage:feature", False), (None, "r::stage:main", True)])
def test_edge_visible(spark, a, b, ok):
    assert value(spark, S.edge_visible(F.lit(a).cast("string"), F.lit(b))) is ok


@pytest.mark.parametrize("url", ["git@gitea.example:Org/repo.git", "https://user:pw@Gitea.example/Org/repo/", "ssh://git@gitea.example/Org/repo?x=1"])
def test_remote(spark, url):
    assert value(spark, S.remote_project(F.lit(url))) == "gitea.example/Org/repo"


def test_links(spark):
    text = "[a](x.md#top) [[Note|n]] ![i](http://e.x/y.png) [b](/r/z.md?q) [m](mailto:a@b)\n[ref]: ../up.md\n"
    assert value(spark, S.links_in(F.lit(text))) == ["x.md", "/r/z.md", "Note", "../up.md"]
    r = lambda d, x: value(spark, S.resolve_link(F.lit(d), F.lit(x)))
    assert (r("a/b", "../c.md"), r("a", "/x.md"), r("", "./y.md"), r("a", "../../z")) == ("a/c.md", "x.md", "y.md", "z")


def test_parse_facts(spark):
    p = lambda s: value(spark, S.parse_facts(F.lit(s)))
    got = p('```json\n[{"kind":"weird","title":"T","content":"C","importance":1.5},{"kind":"entity","title":"U","content":"D","importance":-0.3}]\n```')
    assert [(f.kind, f.title, f.importance) for f in got] == [("fact", "T", 1.0), ("entity", "U", 0.0)]
    assert p("[]") == [] and not p("nothing")


def test_small_ones(spark):
    v = lambda c: value(spark, c)
    assert (v(S.before_last_dot(F.lit("foo.bar.baz"))), v(S.after_last_dot(F.lit("foo.bar.baz"))), v(S.before_last_dot(F.lit("no-dot"))), v(S.after_last_dot(F.lit("no-dot")))) == ("foo.bar", "baz", "no-dot", "")
    assert v(S.label_of(F.lit(".run()"))) == "run" and v(S.display_name(F.lit("a/b"))) == "b" and v(S.display_name(F.lit("a/b/"))) == "a/b/"
    assert v(S.group_of(F.lit("p/g/x"), F.lit("p"))) == "g" and v(S.group_of(F.lit("p/x"), F.lit("p"))) == ""
    assert v(S.module_root(F.lit("@a/b/c"))) == "@a/b" and v(S.module_root(F.lit("g.com/o/r/x"))) == "g.com/o/r"
    assert v(S.excerpt(F.lit("abcdef"), 3)) == "abc..." and v(S.non_finite(arr(1.0, math.nan))) is True
    assert v(S.fuzzy_match(F.lit("acme-backned"), F.lit("acme-backend"))) is True and S.terms("Coupon redeem_x!") == ["coupon", "redeem", "x"]
