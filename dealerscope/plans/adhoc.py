"""Bounded read-only SQL over the registered names."""

from __future__ import annotations

import datetime as dt
import re
import threading
import uuid
from collections.abc import Iterable, Mapping

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row, SparkSession

from dealerscope.plans.views import VIEW_NAMES, register_views
from dealerscope.sources.roles import Roles

ROW_BOUND = 200
TIME_BOUND = 5.0  # seconds

# Words that a read-only statement may not contain, in any case.
FORBIDDEN_WORDS = frozenset({"INSERT", "UPDATE", "DELETE", "DROP", "ALTER", "TRUNCATE", "GRANT", "REVOKE"})

# What a database role without rights would refuse: Spark's calls into Java.
JAVA_CALLS = frozenset({"REFLECT", "TRY_REFLECT", "JAVA_METHOD"})

# How the parser shows what a statement reads: a name, a table function, or a name that is computed.
_RELATION = re.compile(r"UnresolvedRelation \[([^\]]*)\]")
_COMPUTED = re.compile(r"UnresolvedTableValuedFunction|WithUnresolvedIdentifier|UnresolvedTVF|UDTF")


def checked_select(statement: str, limit: int = ROW_BOUND) -> str:
    """The statement with a row bound, or ValueError unless it is one plain SELECT.

    A forbidden word is refused even inside a string; ``WITH`` is not accepted. Trailing
    semicolons are dropped. A statement that has a LIMIT anywhere keeps it as it is.
    """
    body = statement.strip().rstrip("; \t\n")
    words = re.findall(r"\w+", body.upper())
    if not body.upper().startswith("SELECT"):
        raise ValueError("the statement must start with SELECT")
    if ";" in body:
        raise ValueError("only one statement is accepted")
    if found := (FORBIDDEN_WORDS | JAVA_CALLS).intersection(words):
        raise ValueError(f"not a read-only statement: {', '.join(sorted(found))}")
    has_limit = any(a == "LIMIT" and b.isdigit() for a, b in zip(words, words[1:]))
    return body if has_limit else f"{body} LIMIT {limit}"


def names_read(spark: SparkSession, statement: str) -> set[str]:
    """The names that a statement reads, subqueries included, from its parsed plan.

    A name of several parts, such as a file's path behind its format, is given as it is; table
    functions and computed names are refused, since they have no name to check.
    """
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement).toString()
    if _COMPUTED.search(plan):
        raise ValueError("only registered names can be read")
    return {name.strip().lower() for name in _RELATION.findall(plan)}


def bounded_select(
    spark: SparkSession,
    statement: str,
    parameters: Mapping[str, object] | None = None,
    names: Iterable[str] = VIEW_NAMES,
) -> DataFrame:
    """Run a checked SELECT that reads none but ``names``; never more than ROW_BOUND rows.

    ``parameters`` are bound to ``:name`` markers.
    """
    body = checked_select(statement)
    if unknown := names_read(spark, body) - {n.lower() for n in names}:
        raise ValueError(f"only registered names can be read, not {', '.join(sorted(unknown))}")
    return spark.sql(body, args=dict(parameters) if parameters else None).limit(ROW_BOUND)


def ask(
    spark: SparkSession,
    roles: Roles,
    as_of: dt.date | str,
    statement: str,
    results: Mapping[str, DataFrame] | None = None,
    parameters: Mapping[str, object] | None = None,
) -> DataFrame:
    """Register the names that the statement reads and run it bounded."""
    surface = (*VIEW_NAMES, *(results or {}))
    read = names_read(spark, checked_select(statement))
    register_views(spark, roles, as_of, results, [n for n in surface if n.lower() in read])
    return bounded_select(spark, statement, parameters, surface)


def answer(rows: DataFrame, seconds: float = TIME_BOUND) -> list[Row]:
    """The rows of a bounded statement, or TimeoutError if they take longer than ``seconds``.

    The statement runs as a job group of its own, which is cancelled when the time is up.
    """
    spark = rows.sparkSession
    group = f"ask-{uuid.uuid4().hex}"
    late = threading.Event()

    def stop() -> None:
        late.set()
        spark.sparkContext.cancelJobGroup(group)

    timer = threading.Timer(seconds, inheritable_thread_target(spark)(stop))
    spark.sparkContext.setJobGroup(group, "bounded statement", interruptOnCancel=True)
    timer.start()
    try:
        return rows.collect()
    except Exception as error:
        if late.is_set():
            raise TimeoutError(f"the statement took more than {seconds:g} seconds") from error
        raise
    finally:
        timer.cancel()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
