"""Predicates, LIKE, order, slices and distinct against a plain Python model."""

import itertools
import random

import pytest

from millrace.errors import DataError, QueryError
from millrace.functions.like import parts
from millrace.plans import query
from millrace.plans.predicate import Condition, Filter

ROWS = [(0, 30, "c", 0.0), (1, 10, "a", -0.0), (2, None, "b", 1.0)]


@pytest.fixture(scope="module")
def q(spark):
    return spark.createDataFrame(ROWS, "__pos long, price long, name string, g double").cache()


def names(df):
    return [r["name"] for r in df.collect()]


@pytest.mark.parametrize(
    ("where", "expected"),
    [
        ([("price", ">", 20)], "c"), ([("price", ">", 20, True)], "ab"), ([("price", "<", 20)], "a"), ([("price", "=", None)], "b"), ([("price", "=", None, True)], "ca"),
        ([("price", ">", 20, True), ("price", "=", None, True)], "a"), ([("price", "IN", [])], ""), ([("price", "IN", [], True)], "cab"), ([("price", "IN", [None])], "b"),
        ([("price", "IN", [None, 30])], "cb"), ([("price", "IN", [None, 30], True)], "a"), ([("price", "IN", [30], True)], "ab"), ([("price", "BETWEEN", [30, 10])], ""),
        ([("price", "BETWEEN", {"lo": 10, "hi": 30})], "ca"), ([("price", "BETWEEN", [5, 15], True)], "cb"), ([("g", "=", 0)], "ca"), ([("name", "LIKE", "%")], "cab"),
    ],
)
def test_two_valued_conditions(q, where, expected):
    assert "".join(sorted(names(query.select(q, [Condition(*w) for w in where])))) == "".join(sorted(expected))


def test_counts_and_distinct(q):
    n = lambda **o: query.count(q, **o).first()["n"]
    assert n(where=[Condition("g", "=", 0.0)]) == 2
    assert n(distinct=["g"]) == 3  # -0.0 is a value of its own
    assert n(distinct=["price"]) == 3  # a null key counts
    assert query.exists(q, [Condition("name", "=", "a")]) and not query.exists(q, [Condition("name", "=", "z")])


def test_order_slice(q):
    assert names(query.select(q, order=["price"])) == ["b", "a", "c"]
    assert names(query.select(q, order=[("price", "DESC")])) == ["c", "a", "b"]
    assert names(query.select(q, limit=0)) == [] and names(query.select(q, offset=1)) == ["a", "b"]
    assert names(query.select(q, limit=1, offset=1)) == ["a"]


@pytest.mark.parametrize(
    ("make", "code"),
    [
        (lambda q: query.select(q, [Condition("x", "=", 1)]), "QueryUnknownColumn"), (lambda q: query.select(q, limit=-1), "InvalidLimit"),
        (lambda q: query.select(q, offset=-1), "InvalidOffset"), (lambda q: query.select(q, order=[("price", "up")]), "InvalidSortDirection"),
        (lambda q: query.select(q, distinct=["zz"]), "QueryUnknownColumn"), (lambda q: Filter().where("price", "~", 1), "InvalidOperator"),
        (lambda q: query.select(q, [Condition("price", "BETWEEN", [1])]), "InvalidBetween"), (lambda q: query.select(q, [Condition("price", "IN", 5)]), "InvalidIn"),
        (lambda q: query.select(q, [Condition("price", ">", None)]), "InvalidOperand"), (lambda q: query.select(q, [Condition("price", "LIKE", "1%")]), "LikeOnNonStringColumn"),
    ],
)
def test_query_errors(q, make, code):
    with pytest.raises(QueryError) as e:
        make(q)
    assert e.value.code == code


@pytest.mark.parametrize(("column", "value"), [("price", "10"), ("price", True), ("price", 1.0), ("name", 5), ("g", "1"), ("g", float("nan"))])
def test_literals_are_exact(q, column, value):
    with pytest.raises(DataError):
        query.select(q, [Condition(column, "=", value)])


def model_like(pattern, value):
    tokens, i = [], 0
    while i < len(pattern):
        if pattern[i] == "\\" and i + 1 < len(pattern):
            tokens.append(pattern[i + 1])
            i += 2
        else:
            tokens.append(None if pattern[i] == "%" else pattern[i])
            i += 1
    reach = {0}
    for t in tokens:
        reach = set(range(min(reach), len(value) + 1)) if t is None and reach else {p + 1 for p in reach if t is not None and p < len(value) and value[p] == t}
    return len(value) in reach


def test_like_against_a_model(spark):
    rng = random.Random(3)
    values = ["".join(rng.choice("ab%_\\.\nя") for _ in range(rng.randint(0, 7))) for _ in range(120)] + ["100% off", "back\\slash", "under_score", "aXb"]
    df = spark.createDataFrame(list(enumerate(values)), "id long, v string").cache()
    patterns = ["".join(rng.choice("ab%%_\\я") for _ in range(rng.randint(0, 6))) for _ in range(40)] + ["%", "", "a%", "%b", "%a%", "a%b", "%\\%%", "under_score"]
    for p in patterns:
        got = {r["id"] for r in query.select(df, [Condition("v", "LIKE", p)], tie=["id"]).collect()}
        assert got == {i for i, v in enumerate(values) if model_like(p, v)}, (p, parts(p))
        none = {r["id"] for r in query.select(df, [Condition("v", "LIKE", p, True)], tie=["id"]).collect()}
        assert none == set(range(len(values))) - got


def test_random_pipelines_against_a_model(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([None, *range(5)]), rng.choice(["x", "y", None, "zz"])) for i in range(60)]
    df = spark.createDataFrame(rows, "__pos long, n long, s string").cache()
    for keys, down, off, lim, dist in itertools.product((["n"], ["s", "n"]), (False, True), (None, 3), (None, 7), ((), ("s",))):
        got = [(r["n"], r["s"]) for r in query.select(df, order=[(k, "desc" if down else "asc") for k in keys], offset=off, limit=lim, distinct=dist).collect()]
        want = list(rows)
        for k in reversed(keys):
            at = {"n": 1, "s": 2}[k]
            key = (lambda r, at=at: (r[at] is not None, r[at])) if k == "n" else (lambda r, at=at: (r[at] is not None, r[at] or ""))
            if down:  # a stable descending sort
                want = [r for _, r in sorted(enumerate(want), key=lambda e: (key(e[1]), -e[0]) if e[1][at] is not None else ((False, 0 if k == "n" else ""), -e[0]), reverse=True)]
            else:
                want = sorted(want, key=lambda r: key(r) if r[at] is not None else (False, 0 if k == "n" else ""))
        if dist:
            seen, first = set(), []
            for r in want:
                if r[2] not in seen:
                    seen.add(r[2])
                    first.append(r)
            want = first
        want = want[off or 0 :][: lim if lim is not None else None]
        assert got == [(r[1], r[2]) for r in want], (keys, down, off, lim, dist)


def test_pushdown_and_topk(spark, tmp_path):
    spark.range(1000).selectExpr("id", "cast(id % 7 as string) AS s").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    plan = query.select(df, [Condition("id", ">", 10, True), Condition("s", "LIKE", "3%")], order=[("id", "desc")], tie=[], limit=5, project=["id"])._jdf.queryExecution().toString()
    assert "StringStartsWith(s,3)" in plan and "TakeOrderedAndProject" in plan and "Or(" in plan


def test_collation_orders_text_only(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["B", "a", "я", "ё"])], "__pos long, v string")
    assert [r[0] for r in query.select(df, order=["v"], project=["v"]).collect()] == ["B", "a", "я", "ё"]
    assert [r[0] for r in query.select(df, order=["v"], project=["v"], collation="UNICODE").collect()] == ["a", "B", "ё", "я"]
