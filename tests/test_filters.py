import random

import pytest
from pyspark.sql import functions as F

from quern.functions.filters import Compiler, FilterError, attributes, tokens
from quern.functions.patterns import UnsupportedPattern, glob_regex, re2_regex
from quern.plans.query import Collection

ROWS = [(1, "Alpha", 10, ["a", "b"]), (2, "Beta", 20, ["b", "c"]), (3, "Gamma", 30, ["c", "d"]), (4, "Delta", 40, None)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "id long, name string, score long, tags array<string>").cache()


@pytest.mark.parametrize(
    "filters, count",
    [
        (["score", "Eq", 20], 1), (["score", "NotEq", 20], 3), (["score", "Lt", 25], 2), (["score", "Lte", 20], 2), (["score", "Gt", 20], 2), (["score", "Gte", 20], 3),
        (["score", "In", [10, 30]], 2), (["score", "NotIn", [10, 30]], 2), (["And", [["score", "Gt", 10], ["score", "Lt", 40]]], 2), (["Or", [["score", "Eq", 10], ["score", "Eq", 40]]], 2),
        (["tags", "Contains", "b"], 2), (["tags", "Eq", None], 1), (["tags", "NotEq", None], 3), (["tags", "NotContains", "b"], 2), (["tags", "ContainsAny", ["a", "d"]], 2),
        (["tags", "NotContainsAny", ["a", "d"]], 2), (["tags", "AnyGt", "c"], 1), (["tags", "Eq", "a"], 0), (["Or", []], 4), (["And", []], 4), (["Not", ["tags", "Contains", "b"]], 2),
        (["missing", "Eq", None], 4), (["missing", "Eq", 1], 0), (["missing", "NotEq", 1], 4), (["missing", "NotIn", [1]], 4), (["score", "Eq", "20"], 0), (["score", "NotEq", "20"], 4),
        (["name", "Glob", "*ta"], 2), (["name", "NotGlob", "*ta"], 2), (["name", "IGlob", "AL*"], 1), (["name", "Regex", "^[AB]"], 2), (["name", "NotRegex", "^[AB]"], 2), (["name", "Regex", "("], 0), (["name", "Regex", "(?U)^A.*"], 1), (["name", "Regex", "(?iU:^a)"], 1),
        (["score", "In", 10], 0), (["score", "Lt", None], 0), (["id", "Gt", 2], 2),
    ],
)
def test_truth_table(table, filters, count):
    assert Collection(table).where(filters).count() == count


def test_missing_and_null_are_alike(spark):
    df = spark.createDataFrame([(1, "a@x"), (2, None), (3, None), (4, "b@x")], "id long, email string")
    ids = lambda f: sorted(r.id for r in Collection(df).where(f).collect())
    assert ids(["email", "Eq", None]) == [2, 3] and ids(["email", "NotEq", None]) == [1, 4] and ids(["email", "In", ["a@x", None]]) == [1, 2, 3]


@pytest.mark.parametrize("bad", [["score", "Like", 1], ["score", "Eq"], "x", [], ["And", "x"], [1, "Eq", 2], ["Or", [["a"]]]])
def test_malformed(table, bad):
    with pytest.raises(FilterError):
        Compiler(table.schema).compile(bad)


def test_regex_gate(table):
    with pytest.raises(FilterError):
        Compiler(table.schema, set()).compile(["name", "Regex", "a"])


@pytest.mark.parametrize("pattern, yes, no", [("test[", ["test["], ["test"]), ("a?c*e?g", ["abcdefg", "axceyg"], ["aceg"]), ("[!a-c]x", ["dx"], ["ax", "x"]), ("*", ["", "a/b\nc"], []), ("a.b", ["a.b"], ["axb"]), ("[]a]b", ["]b", "ab"], ["b"])])
def test_glob(spark, pattern, yes, no):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*yes, *no])], "id long, t string")
    assert {r.t for r in Collection(df).where(["t", "Glob", pattern]).collect()} == set(yes)
    assert glob_regex(pattern).endswith("\\z")


def test_re2_translation():
    assert re2_regex("(?P<n>h)") == "(?<n>h)" and re2_regex("[[:alpha:]_]+") == "[\\p{Alpha}_]+"
    for bad in ("(?=a)", "(a)\\1", "[[:no:]]", "(", "[a"):
        with pytest.raises(UnsupportedPattern):
            re2_regex(bad)


def test_tokens(spark):
    assert tokens("hello_world") == ["hello", "world"] and tokens("CamelCase") == ["camelcase"] and tokens(".,;!?") == []
    df = spark.createDataFrame([(1, "Quick brown_Fox"), (2, "fox brown"), (3, None), (4, "brownie foxy")], "id long, t string")
    ids = lambda op, v: sorted(r.id for r in Collection(df).where(["t", op, v]).collect())
    assert ids("ContainsTokenSequence", "brown fox") == [1] and ids("ContainsAllTokens", "FOX brown") == [1, 2]
    assert ids("ContainsAllTokens", ["fox"]) == [1, 2] and ids("ContainsTokenSequence", "") == [1, 2, 4]
    assert ids("ContainsTokenSequence", {"query": "brown fo", "last_as_prefix": True}) == [1] and ids("ContainsAllTokens", {"query": "fox", "last_as_prefix": True}) == [1, 2, 4]


def test_attributes():
    assert attributes(["And", [["a", "Eq", 1], ["Not", ["Or", [["b", "Lt", 2], ["c", "In", []]]]]]]) == {"a", "b", "c"}


def _naive(expr, row):
    if expr[0] == "And":
        return all(_naive(e, row) for e in expr[1])
    if expr[0] == "Or":
        return not expr[1] or any(_naive(e, row) for e in expr[1])
    if expr[0] == "Not":
        return not _naive(expr[1], row)
    name, op, v = expr
    x = row[name]
    if op.startswith("Not"):
        return x is not None if v is None else not _naive([name, op[3:] if op != "NotEq" else "Eq", v], row)
    if op == "Eq":
        return x is None if v is None else x == v
    if op == "In":
        return x in v
    if x is None or v is None:
        return False
    return {"Lt": x < v, "Lte": x <= v, "Gt": x > v, "Gte": x >= v}[op]


def test_random_filters_agree_with_a_naive_evaluator(spark):
    rng = random.Random(4)
    rows = [{"id": i, "a": rng.choice([None, 0, 1, 2, 3]), "b": rng.choice([None, 0, 1, 2])} for i in range(60)]
    df = spark.createDataFrame([(r["id"], r["a"], r["b"]) for r in rows], "id long, a long, b long").cache()

    def make(depth):
        if depth and rng.random() < 0.7:
            op = rng.choice(["And", "Or", "Not"])
            return [op, make(depth - 1)] if op == "Not" else [op, [make(depth - 1) for _ in range(rng.randrange(0, 3))]]
        op = rng.choice(["Eq", "NotEq", "In", "NotIn", "Lt", "Lte", "Gt", "Gte"])
        return [rng.choice("ab"), op, [rng.choice([None, 0, 1, 2]) for _ in range(2)] if op.endswith("In") else rng.choice([None, 0, 1, 2]) if op.endswith("Eq") else rng.randrange(3)]

    filters = [make(3) for _ in range(60)]
    c = Compiler(df.schema)
    got = df.select("id", *[F.coalesce(F.when(c.compile(f), True), F.lit(False)).alias(f"f{i}") for i, f in enumerate(filters)]).collect()
    for r in got:
        for i, f in enumerate(filters):
            assert r[f"f{i}"] == _naive(f, rows[r.id]), f


def test_pushdown(spark, sf_dir):
    lines = Collection(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_orderkey")
    plan = lambda f: lines.where(f)._jdf.queryExecution().executedPlan().toString()
    text = plan(["And", [["l_quantity", "Gt", 45], ["l_returnflag", "NotEq", "R"], ["l_linestatus", "Glob", "O*"]]])
    pushed = text[text.index("PushedFilters") :]
    assert "GreaterThan(l_quantity" in pushed and "Not(EqualNullSafe(l_returnflag" in pushed and "StringStartsWith(l_linestatus" in pushed
