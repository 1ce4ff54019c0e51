"""The queries that have SQL, against it, on the smallest tables; aliases and shared lines on made ones."""

import duckdb
import pytest
from conftest import SMALL

from dealerscope.llm import queries

TABLES = ("documents", "pages", "embeddings")
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean"}


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([row[i] for i in order]) for row in rows)


def _same(spark, folder, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet{'' if folder == SMALL else '/*.parquet'}')")
    wanted = connection.sql(queries.oracle_sql()[name])
    found = queries.queries()[name](spark, folder)
    assert sorted(found.columns) == sorted(wanted.columns)
    assert dict(found.dtypes) == {c: TYPES[str(t)] for c, t in zip(wanted.columns, wanted.types)}
    got = _rows(found.columns, found.collect())
    assert got == _rows(wanted.columns, wanted.fetchall())
    return got


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_given_tables(spark, name):
    assert _same(spark, SMALL, name)


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("made"))
    line = [" ".join(f"l{n}w{i}" for i in range(9)) for n in range(8)]
    texts = [
        "\n".join(line[:5]),
        "\n".join([line[7], *line[1:4], "end"]),  # three lines of nine words repeat
        "\n".join([*line[2:4], "", "short", line[6]]),  # two do not hold 25
        "\n".join([" " + line[1], "", line[2] + "\t", line[3], line[4], "x"]),  # blanks do not matter
        "\n".join([line[0]] * 7),
        "\n".join(line[5:]),
        None,
        "",
    ]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    vectors = [(i * 10, i % 3, [float((i * k) % 7) / 4 for k in range(1, 5)]) for i in range(90)] + [(5, 1, None), (6, None, [1.0] * 4), (900, 2, [0.0] * 4)]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    canonical = '<html><head><LINK rel="canonical" HREF="{}"></head>'
    refresh = "<meta http-equiv='refresh' content='0; url={}'>"
    pages = [
        (1, "http://a.net/start", canonical.format("http://b.net/x?q=1&amp;r=2")),
        (2, "http://B.net/x?q=1&r=2#here", refresh.format("/moved")),
        (3, "http://b.net/moved", canonical.format("http://shop.com/de/1")),  # blocked, and no page itself
        (4, "http://c.org/", canonical.format("http://a.net/start")),  # an allowed alias stays allowed
        (5, "http://c.net/dir/page", canonical.format("other")),
        (6, "http://c.net/dir/other", None),
        (7, "https://a.net/start", "<p>"),  # another scheme is another address
        (8, "http://d.net", refresh.format("//www.example.org/en/12")),
        (9, "http://e.net", canonical.format("http://e.net")),
        (10, None, canonical.format("http://shop.com/de/1")),
    ]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_made_tables(spark, made, name):
    got = _same(spark, made, name)
    if name == "op10_url_filters":
        pages = queries.queries()[name](spark, made).collect()
        assert {p["page_id"] for p in pages if p["verdict"] == "block"} == {1, 2, 3, 8}
    if name == "op7_line_dedup":
        assert [g.split(",")[1].strip() for g in got] == ["0", "3", "0", "5", "6", "0", "0", "0"]
