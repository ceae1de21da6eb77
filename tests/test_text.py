import pytest
from pyspark.sql import functions as F

from codequarry.functions import text as T


def evaluate(spark, column, schema, *row):
    return spark.createDataFrame([row], schema).select(column.alias("out")).first().out


@pytest.mark.parametrize(
    "url, slug",
    [
        ("https://github.com/a/b/tree/x", "a/b"),
        ("https://github.com/a", "a"),
        ("http://github.com/a/b", "http:/"),
        ("https://githubXcom/a/b", "https:/"),
        ("", None),
        (None, None),
    ],
)
def test_repo_slug(spark, url, slug):
    assert evaluate(spark, T.repo_slug(F.col("u")), "u string", url) == slug


BRANCHES = "b array<struct<name: string, commit: struct<url: string>>>, d string"


@pytest.mark.parametrize(
    "names, default, picked",
    [
        (["dev", "main", "master"], "dev", "main"),
        (["trunk", "dev"], "trunk", "trunk"),
        (["x"], "y", None),
        ([], "y", None),
        (["develop", "master"], "master", "develop"),
    ],
)
def test_preferred_branch(spark, names, default, picked):
    column = T.preferred_branch(F.col("b"), F.col("d"))
    branches = [(name, (f"https://api/{name}",)) for name in names]
    row = evaluate(spark, column, BRANCHES, branches, default)
    assert (row.name if row else None) == picked


def test_archive_url(spark):
    column = T.archive_url(F.col("u"))
    assert evaluate(spark, column, "u string", "https://api/x/commits/abc") == "https://api/x/zipball"


@pytest.mark.parametrize(
    "doc, short, distance, kept",
    [
        (84, 200, 0.0, "doc"),
        (84, 10, 99.0, "doc"),
        (100, 40, 10.5, "doc"),
        (100, 150, 9.0, None),
        (100, 40, 9.0, "short"),
        (100, 150, 10.0, "short"),
        (130, 150, 11.0, "short"),
    ],
)
def test_keep_rule(spark, doc, short, distance, kept):
    column = T.keep_rule(F.col("d"), F.col("s"), F.col("x"))
    out = evaluate(spark, column, "d string, s string, x double", "d" * doc, "s" * short, distance)
    assert out == {"doc": "d" * doc, "short": "s" * short, None: None}[kept]


@pytest.mark.parametrize(
    "body, comment, rest",
    [
        ("# hello\nx = 1", "hello", "x = 1"),
        ("  # hi\nx = 1", "hi", "x = 1"),
        ("#\nx = 1", None, "x = 1"),
        ("#", None, ""),
        ("x = 1 # no", None, "x = 1 # no"),
        ("## twice\r\nx = 1\r\n", "twice", "x = 1"),
        ("", None, ""),
    ],
)
def test_leading_comment(spark, body, comment, rest):
    assert evaluate(spark, T.leading_comment(F.col("b")), "b string", body) == comment
    assert evaluate(spark, T.without_leading_comment(F.col("b")), "b string", body) == rest


@pytest.mark.parametrize(
    "html, link",
    [
        ('<a href="/x">1</a><a href="https://github.com/a/b">2</a>', "https://github.com/a/b"),
        ("<A class=k HREF = 'https://github.com/c'>", "https://github.com/c"),
        ("<a href=https://github.com/d/e>x", "https://github.com/d/e"),
        ('<!-- <a href="https://github.com/no"> --><a href="https://github.com/yes">', "https://github.com/yes"),
        ('<script>s = "<a href=\'https://github.com/no\'>"</script>', None),
        ('<a data-href="https://github.com/no">', None),
        ('<area href="https://github.com/no">', None),
        ('<a href="https://github.com/f?x=1&amp;y=2">', "https://github.com/f?x=1&y=2"),
        ("", None),
        (None, None),
    ],
)
def test_first_link(spark, html, link):
    assert evaluate(spark, T.first_link(F.col("h"), "github.com"), "h string", html) == link


@pytest.mark.parametrize(
    "args, out",
    [("{self  a\tb}", "self, a, b"), ("{a,b}", "a,b"), ("{}", ""), (None, None)],
)
def test_format_args(spark, args, out):
    assert evaluate(spark, T.format_args(F.col("a")), "a string", args) == out


def test_small_functions(spark):
    assert evaluate(spark, T.strip_nul(F.col("t")), "t string", "a\0b\0") == "ab"
    assert evaluate(spark, T.flatten(F.col("t")), "t string", "a\r\nb\nc") == "a  b c"
    assert evaluate(spark, T.count_substring(F.col("t"), "aa"), "t string", "aaaaa") == 2
    assert evaluate(spark, T.count_substring(F.col("t"), "def "), "t string", "undef def x") == 2
    assert evaluate(spark, T.file_stem(F.col("t")), "t string", "file:/x/a.b.zip") == "a.b"
    assert evaluate(spark, T.file_stem(F.col("t")), "t string", "/x/.py") == ".py"
    assert evaluate(spark, T.search_text(F.col("t")), "t string", " \t\n") is None
    assert evaluate(spark, T.search_text(F.col("t"), 3), "t string", "ABCDE") == "abc"
    assert evaluate(spark, T.parse_list_literal(F.col("t")), "t string", "['a', 'b']") == ["a", "b"]
    assert evaluate(spark, T.parse_list_literal(F.col("t")), "t string", "['don't']") is None
    for path, hit in {"a/b.py": True, "d.PY": False, ".py": False, "x/.py": False}.items():
        assert evaluate(spark, T.has_suffix(F.col("t"), (".py",)), "t string", path) is hit


def test_render(spark):
    name, args, body, doc = (F.lit(x) for x in ("f", "a, b", "x\ny", "Doc"))
    one = spark.range(1)
    plain = T.render_function(name, args, body)
    assert one.select(plain).first()[0] == "def f(a, b):\n x y"
    full = T.render_with_docstring(name, args, body, doc)
    assert one.select(full).first()[0] == "def f(a, b):\n x y\n\nDoc"
    bare = T.render_with_docstring(name, args, body, F.lit(None).cast("string"))
    assert one.select(bare).first()[0] == "def f(a, b):\n x y\n\n"
