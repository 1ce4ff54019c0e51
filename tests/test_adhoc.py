import pytest

from dealerscope.plans import adhoc
from dealerscope.plans.views import VIEW_NAMES, register_views
from dealerscope.sources.roles import roles_from_star

AS_OF = "2001-08-01"


@pytest.mark.parametrize("word", sorted(adhoc.FORBIDDEN_WORDS | adhoc.JAVA_CALLS))
def test_each_forbidden_word_is_refused(word):
    for statement in (f"{word} something", f"SELECT region FROM regional_performance WHERE '{word.lower()}' = region"):
        with pytest.raises(ValueError):
            adhoc.checked_select(statement)


@pytest.mark.parametrize("statement", ["SELECT 1; SELECT 2", "WITH a AS (SELECT 1) SELECT * FROM a", "", "  explain SELECT 1"])
def test_refused(statement):
    with pytest.raises(ValueError):
        adhoc.checked_select(statement)


@pytest.mark.parametrize(
    ("statement", "expected"),
    [
        ("SELECT * FROM dealers", "SELECT * FROM dealers LIMIT 200"),
        ("  select 1 ; ", "select 1 LIMIT 200"),
        ("SELECT 1;;", "SELECT 1 LIMIT 200"),
        ("SELECT * FROM dealers limit 5", "SELECT * FROM dealers limit 5"),
        ("SELECT * FROM dealers LIMIT 500", "SELECT * FROM dealers LIMIT 500"),
        ("SELECT updated, dropped FROM t", "SELECT updated, dropped FROM t LIMIT 200"),
        ("SELECT credit_limit FROM dealers", "SELECT credit_limit FROM dealers LIMIT 200"),
    ],
)
def test_bounded(statement, expected):
    assert adhoc.checked_select(statement) == expected


def test_rows_are_cut_whatever_limit_is_written(spark):
    spark.range(1000).createOrReplaceTempView("many")
    for statement in ("SELECT * FROM many LIMIT 500", "SELECT * FROM (SELECT * FROM many LIMIT 900) WHERE id >= 0"):
        assert adhoc.bounded_select(spark, statement, names=["many"]).count() == 200
    chosen = adhoc.bounded_select(spark, "SELECT * FROM many WHERE id < :n", {"n": 7}, names=["Many"])
    assert chosen.count() == 7
    assert adhoc.bounded_select(spark, "SELECT * FROM many WHERE id < :limit", {"limit": 900}, ["many"]).count() == 200


@pytest.mark.parametrize(
    "statement",
    [
        "SELECT * FROM secret",
        "SELECT region FROM regional_performance WHERE region IN (SELECT name FROM secret)",
        "SELECT (SELECT max(name) FROM secret) AS n FROM regional_performance",
        "SELECT * FROM parquet/**/.`{path}`",
        "SELECT * FROM `parquet`.`{path}`",
        "SELECT * FROM Parquet . `{path}`",
        "SELECT * FROM IDENTIFIER('sec' || 'ret')",
        "SELECT * FROM range(5)",
        "SELECT * FROM (SELECT * FROM global_temp.secret)",
        "SELECT * FROM regional_performance r, LATERAL (SELECT * FROM secret)",
        "SELECT * FROM (WITH secret AS (SELECT 1) SELECT * FROM secret)",
    ],
)
def test_only_registered_names_are_read(spark, statement):
    spark.createDataFrame([("x",)], "name STRING").createOrReplaceTempView("secret")
    roles = roles_from_star(spark, "/root/testdata/sf0.001")
    with pytest.raises(ValueError):
        adhoc.ask(spark, roles, AS_OF, statement.format(path="/root/testdata/sf0.001/region.parquet"))


def test_a_statement_that_takes_too_long_is_cancelled(spark):
    spark.range(0, 3_000_000_000, 1, 64).createOrReplaceTempView("many")
    slow = adhoc.bounded_select(spark, "SELECT count(DISTINCT sha2(string(id), 256)) AS n FROM many", names=["many"])
    with pytest.raises(TimeoutError):
        adhoc.answer(slow, seconds=1)
    assert adhoc.answer(adhoc.bounded_select(spark, "SELECT 1 AS one"))[0].one == 1


def test_every_name_can_be_queried(spark):
    roles = roles_from_star(spark, "/root/testdata/sf0.001")
    names = register_views(spark, roles, AS_OF)
    assert set(names) == set(VIEW_NAMES)
    for name in names:
        assert adhoc.bounded_select(spark, f"SELECT * FROM {name} LIMIT 3").count() == 3


def test_only_the_mentioned_views_are_registered(spark):
    for name in VIEW_NAMES:
        spark.catalog.dropTempView(name)
    roles = roles_from_star(spark, "/root/testdata/sf0.001")
    rows = adhoc.ask(spark, roles, AS_OF, "SELECT region, dealer_count FROM Regional_Performance ORDER BY region")
    assert rows.count() == 5
    assert not spark.catalog.tableExists("dealer_scorecard")
