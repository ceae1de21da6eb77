import pytest

from codequarry.functions.source_code import function_rows, split_body_text
from codequarry.plans import corpus

CLASS = '''class A:
    def f(self, x, /, y, *args, k=2, **kw):
        # note
        def g():
            return 1
        return g
'''


@pytest.mark.parametrize(
    "content, rows",
    [
        (
            'def add(a: int, b=1):\n    """Add."""\n    return a + b\n',
            [("add", ["a", "b"], ["int"], ["1"], "return a + b", "Add.", 1, None)],
        ),
        (
            CLASS,
            [
                ("f", ["y"], [], [], "def g():\n    return 1\nreturn g", None, 2, None),
                ("g", [], [], [], "return 1", None, 4, None),
            ],
        ),
        (
            "async def h():\n    def inner(): pass\n",
            [("inner", [], [], [], "pass", None, 2, None)],
        ),
        ("x = lambda q: q\n", []),
        (None, []),
        ("de\0f f(): pass", [("f", [], [], [], "pass", None, 1, None)]),
    ],
)
def test_function_rows(content, rows):
    assert list(function_rows(content)) == rows


@pytest.mark.parametrize("content", ["def (", "print 'old'", "(" * 5000])
def test_bad_source_is_one_reject(content):
    rows = list(function_rows(content))
    assert len(rows) == 1 and rows[0][:-1] == (None,) * 7 and rows[0][-1]


@pytest.mark.parametrize(
    "body, out, docstring",
    [
        ("'Add.'\nreturn a + b", "return a + b", "Add."),
        ("'''Doc\n  more'''\nreturn 1", "return 1", "Doc\nmore"),
        ("'Only.'", "", "Only."),
        ("''\nreturn 0", "''\nreturn 0", None),
        ("# hello\nx = 1", "x = 1", "hello"),
        ("  # hi\nx = 1", "x = 1", "hi"),
        ("#\nx = 1", "x = 1", None),
        ("x = (", "x = (", None),
        ("'a'\n'b'\nx = 1", '"""b"""\nx = 1', "a"),
    ],
)
def test_split_body_text(body, out, docstring):
    assert split_body_text(body) == (out, docstring)


def test_functions_table(spark):
    files = spark.createDataFrame(
        [
            (1, 7, CLASS),
            (2, 7, "def ("),
            (3, None, "def g():\n    return 1\n"),
            (4, 8, None),
            (5, 8, "def g():\n    return 2\n"),
        ],
        "id bigint, repo bigint, content string",
    )
    functions, rejects = corpus.functions_table(files)
    rows = functions.orderBy("id").select("id", "file_id", "repo", "name", "lineno").collect()
    assert [tuple(row) for row in rows] == [(1, 1, 7, "f", 2), (2, 1, 7, "g", 4), (3, 5, 8, "g", 1)]
    assert [tuple(row) for row in rejects.collect()] == [("SyntaxError", 1)]


def test_few_files_are_parsed_at_a_time(spark):
    """What a task holds is bounded by files of one batch, and no file is lost."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        files = spark.range(700).selectExpr(
            "id AS file_id", "'r' AS repo", "if(id % 7 = 0, 'x = (', concat('def f', id, '(): pass')) AS content"
        )
        found = corpus.extract_functions(files.coalesce(1))
        assert int(spark.conf.get(name)) <= corpus.PARSE_ROWS
        assert corpus.reject_counts(found).collect() == [("SyntaxError", 100)]
        assert found.where("name = concat('f', file_id)").count() == 600
    finally:
        spark.conf.set(name, before)
