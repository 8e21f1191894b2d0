"""Columns against the values that they are defined by."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import budget, vectors
from tessera.functions import text as tx


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("text, n", [("你好世界", 4), ("hello world", 3), ("我有 3 个 apple", 6), ("", 0), (None, 0)])
def test_token_count(spark, text, n):
    assert one(spark, tx.token_count(F.lit(text))) == n


def test_digest_tells_metadata_apart(spark):
    meta = F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))
    same = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    assert one(spark, tx.content_digest(F.lit("x"), meta)) == one(spark, tx.content_digest(F.lit("x"), same)) != one(spark, tx.content_digest(F.lit("x")))


def test_clip_and_mask(spark):
    assert one(spark, tx.clip(F.lit("abcdef"), 4)) == "abcd…(+2)"
    assert one(spark, tx.masked(F.lit("key sk-abcdefghijklmnop1234 here"))) == "key *** here"
    hidden = one(spark, tx.redacted(F.create_map(F.lit("API_KEY"), F.lit("v"), F.lit("run_id"), F.lit("r"), F.lit("x"), F.lit("y"))))
    assert hidden == {"API_KEY": "***", "run_id": "r", "x": "y"}


def test_tool_name(spark):
    assert one(spark, tx.tool_name(F.lit("a b/c"))) == "a_b_c"
    assert one(spark, tx.tool_name(F.lit(None).cast("string"))) == "tool"


def test_lists_and_json(spark):
    assert one(spark, tx.bullet_lines(F.lit("- a\n2. b\n\n* c"))) == ["a", "b", "c"]
    assert one(spark, tx.query_list(F.array(F.lit(" "), F.lit("q"), F.lit("q")), F.lit("o"))) == ["q"]
    assert one(spark, tx.query_list(F.array(F.lit(" ")), F.lit("o"))) == ["o"]
    assert one(spark, F.variant_get(tx.json_in_prose(F.lit('so: ```json\n{"a": 1}\n``` ok')), "$.a", "int")) == 1
    assert one(spark, tx.json_in_prose(F.lit("no json"))) is None


def test_sanitized_keeps_joiners(spark):
    assert one(spark, tx.sanitized(F.lit("a\x00b‍\tc​"))) == "ab‍\tc"


@pytest.mark.parametrize("a, b, value", [(None, [1.0], 0), ([], [], 0), ([1.0, 0.0], [1.0], 0), ([0.0], [1.0], 0), ([1.0, 0.0], [2.0, 0.0], 1)])
def test_cosine_guards(spark, a, b, value):
    lit = lambda x: F.lit(x).cast("array<double>") if x is None else F.array(*map(F.lit, x)).cast("array<double>")
    assert one(spark, vectors.cosine(lit(a), lit(b))) == pytest.approx(value)


@pytest.mark.parametrize("values, out", [([-0.1, -0.5, -0.9], [1, 0.5, 0]), ([0.9, 0.6, 0.3], [1, 2 / 3, 1 / 3]), ([5.0, 5.0], [1, 1])])
def test_share_of_max(spark, values, out):
    found = [one(spark, vectors.share_of_max(F.lit(v), F.lit(min(values)), F.lit(max(values)))) for v in values]
    assert found == pytest.approx(out)


def test_output_reserve(spark):
    reserve = lambda w, d, m: one(spark, budget.output_reserve(F.lit(w), F.lit(d), F.lit(m).cast("int")))
    assert reserve(1_000_000, 4096, 32_768) == 4096
    assert reserve(8192, 999_999, None) == 4096


def test_recency_halves(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    assert one(spark, vectors.recency(at("2024-01-01"), at("2024-01-02"), 24.0)) == pytest.approx(0.5)
    assert one(spark, vectors.recency(at("2024-01-03"), at("2024-01-02"), 24.0)) == 1


@pytest.mark.parametrize("text, value", [("1 + 2 * 3", 7), ("sqrt(16) // 3", 1), ("-2 ** 2", -4), ("pi", 3.141592653589793), ("1 / 0", None), ("9 ** 9 ** 9", None), ("__import__('os')", None), ("", None), (None, None), ("1 +", None), ("(" * 300, None), ("True", None)])
def test_evaluate(text, value):
    from tessera.functions.parsing import evaluate

    assert evaluate(text) == (None if value is None else pytest.approx(value))


def test_directive():
    from tessera.functions.parsing import directive

    assert directive('x {bad {"tool": 1} {"tool": "t", "b": {"tool": "inner"}}') == '{"b": {"tool": "inner"}, "tool": "t"}'
    assert directive("none") is None and directive(None) is None
    assert directive('{"a": {"tool": "x"}}') is None
    assert directive('{"a": {"tool": "x"}} then {"tool": "y"}') == '{"tool": "y"}'


def test_first_json_value():
    from tessera.functions.jsontext import bounded, value_in

    assert [value_in(t) for t in ("42", ' "x" ', "none", "", "null")] == ["42", '"x"', None, None, "null"]
    assert value_in('see ```JSON {"a": 1} and more``` or [2]') == '{"a": 1}'  # the fence is searched inside
    assert value_in("```\nno json\n``` but [1, 2] {3}") == "[1, 2]"
    assert value_in("```\nnone\n```\n```json\n[3]\n```") == "[3]"
    assert bounded('[[1]]', most_depth=2) == "[[1]]" and bounded('[[[1]]]', most_depth=2) == '{"truncated": true}'
