import json
import zipfile

import pytest
from pyspark.sql import functions as F

from codequarry.plans import corpus
from codequarry.sources import archives, tables, vectors


def rows(df):
    return sorted(tuple(row) for row in df.collect())


def test_json_rows(spark, tmp_path):
    path = tmp_path / "packages.json"
    document = {
        "last_update": "2024-01-01",
        "rows": [{"project": "a", "download_count": 2}, {"project": "b", "download_count": 1}],
    }
    path.write_text(json.dumps(document, indent=1))
    df = tables.read_json_rows(spark, str(path))
    assert rows(df.select("project", "download_count", "last_update")) == [
        ("a", 2, "2024-01-01"),
        ("b", 1, "2024-01-01"),
    ]


def test_records_drop_null(spark, tmp_path):
    path = tmp_path / "repos.json"
    path.write_text('[{"name": "a", "owner": {"id": 1}}, null, {"name": null, "owner": {"id": 2}}]')
    schema = "name string, owner struct<id: bigint>"
    df = tables.read_records(spark, str(path), schema, multi_line=True)
    assert df.select("name", "owner.id").orderBy("id").collect() == [("a", 1), (None, 2)]


def test_stitch_csv_from_pandas_files(spark, tmp_path):
    tmp_path = tmp_path / "with space"
    tmp_path.mkdir()
    (tmp_path / "slice-0-2.csv").write_text(
        ",full_name,size,note\n0,a/a,5,\"two\nlines, \"\"quoted\"\"\"\n1,b/b,6,x\n"
    )
    (tmp_path / "slice-2-4.csv").write_text(",full_name,topics\n0,a/a,['late']\n1,c/c,['t']\n")
    df = tables.stitch_csv(spark, [str(tmp_path / "slice-*.csv")], "full_name")
    assert df.columns == ["full_name", "size", "note", "topics"]
    assert df.orderBy("full_name").collect() == [
        ("a/a", "5", 'two\nlines, "quoted"', None),
        ("b/b", "6", "x", None),
        ("c/c", None, None, "['t']"),
    ]


def test_csv_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], 'q"x\ny')], "id int, tags array<string>, t string")
    tables.write_csv(df, str(tmp_path / "out"))
    back = tables.stitch_csv(spark, [str(tmp_path / "out" / "*.csv")])
    assert back.collect() == [("1", '["a","b"]', 'q"x\ny')]


def test_write_refuses_its_own_source(spark, tmp_path):
    path = str(tmp_path / "a table")
    tables.write_table(spark.range(5), path)
    tables.write_table(spark.range(3), path)
    back = tables.read_table(spark, path, key="id", partitions=3)
    assert rows(back) == [(0,), (1,), (2,)]
    with pytest.raises(ValueError, match="refusing"):
        tables.write_table(back.where("id > 0"), path)
    tables.write_table(spark.range(2), "kept_table")
    assert rows(tables.read_table(spark, "kept_table")) == [(0,), (1,)]
    with pytest.raises(ValueError, match="refusing"):
        tables.write_table(spark.table("kept_table"), "kept_table")


@pytest.fixture
def zips(tmp_path):
    with zipfile.ZipFile(tmp_path / "good.repo.zip", "w") as out:
        out.writestr("a/b.py", "def f(): pass\n")
        out.writestr("a/c.txt", "no")
        out.writestr("d.PY", "no")
        out.writestr(".py", "no")
        out.writestr("e.py", b"caf\xff\xc3\xa9")
    (tmp_path / "bad.zip").write_bytes(b"this is no archive")
    return str(tmp_path / "*.zip")


def test_zip_members(spark, zips):
    df = archives.read_zip_members(spark, zips)
    assert rows(df.where("status = 'ok'").select("archive", "file", "content")) == [
        ("good.repo", "a/b.py", "def f(): pass\n"),
        ("good.repo", "e.py", "café"),
    ]
    assert rows(df.where("status <> 'ok'").select("archive", "status")) == [
        ("bad", "unreadable: BadZipFile")
    ]


def test_a_bad_member_ends_nothing(spark, tmp_path):
    path = tmp_path / "three.zip"
    with zipfile.ZipFile(path, "w") as out:
        for name in ("a.py", "b.py", "c.py"):
            out.writestr(name, f"# {name}")
    path.write_bytes(path.read_bytes().replace(b"# b.py", b"# B.py"))  # its checksum fails
    for found in (
        archives.read_zip_members(spark, str(path)),
        archives.unpack_archives(
            spark.createDataFrame([("three", path.read_bytes())], "archive string, data binary"), "data", ["archive"]
        ),
    ):
        assert rows(found.select("file", "content", "status")) == [
            ("a.py", "# a.py", "ok"),
            ("b.py", None, "unreadable: BadZipFile"),
            ("c.py", "# c.py", "ok"),
        ]


def test_files_table(spark, zips):
    repos = spark.createDataFrame(
        [(9, "good.repo"), (4, "good.repo"), (1, "other")], "index bigint, name string"
    )
    files, bad = corpus.files_table(spark, zips, repos)
    assert rows(files.select("id", "repo", "file")) == [(1, 4, "a/b.py"), (2, 4, "e.py")]
    assert bad.count() == 1
    unknown, _ = corpus.files_table(spark, zips, repos.where("name = 'other'"))
    assert rows(unknown.select("id", "repo")) == [(1, None), (2, None)]


def test_repo_pipeline(spark):
    pages = spark.createDataFrame([('<a href="https://github.com/o/n/x">',), ("<p>",)], "html string")
    assert [row.repo for row in corpus.project_repos(pages).collect()] == ["o/n", None]
    repos = spark.createDataFrame(
        [("n", "dev", [("main", ("https://h/commits/1",))]), ("m", "dev", [("x", ("u",))])],
        "name string, default_branch string, branches array<struct<name: string, commit: struct<url: string>>>",
    )
    assert rows(corpus.archive_links(corpus.with_branch(repos))) == [("n", "https://h/zipball")]


def test_vectors(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [1.0, None])], "id bigint, vec array<double>"
    )
    assert rows(vectors.normalise_vectors(df, 2)) == [(1, [1.0, 2.0])]
    assert rows(vectors.vector_reject_counts(df, 2)) == [(1, 3)]
    path = str(tmp_path / "v")
    vectors.write_vectors(df, path)
    back = vectors.read_vectors(spark, path, 2)
    assert back.schema["vec"].dataType.simpleString() == "array<float>"
    assert rows(back) == [(1, [1.0, 2.0])]
    wide = vectors.vector_to_columns(df.where("size(vec) = 2 OR vec IS NULL"), 2)
    assert wide.columns == ["id", "c0", "c1"]
    with pytest.raises(Exception, match="a vector is not 2 wide"):
        vectors.vector_to_columns(df, 2).collect()
    saved = spark.createDataFrame([(0, "x")], "position int, v string")
    assert rows(vectors.import_positional(saved, "position")) == [(1, "x")]
    assert vectors.columns_to_vector(wide, ["c0", "c1"]).where(F.col("id") == 1).first() == (
        1,
        [1.0, 2.0],
    )
