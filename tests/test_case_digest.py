"""Case digests: detail levels of short, long and large cases, lines of fields, and work that is done once."""

import random

import pytest
from pyspark.sql import functions as F

from lurelens.operators import evidence, pages

_STATE = "target_id string, state_id string, depth int, dom_hash string, is_leaf boolean"


def _sequential(states, limit):
    """Levels of one target, state by state."""
    seen, shown, expected = {}, 0, {}
    leaves = {}
    for i, (_, sid, _, content, leaf) in enumerate(states, start=1):
        content = content or f"state:{sid}"
        if content in seen:
            expected[sid] = (i, "same", seen[content])
        elif not leaf and (content in leaves or shown >= limit):
            leaves.setdefault(content, None)
            expected[sid] = (i, "summary", None)
        else:
            seen[content] = i
            shown += not leaf
            expected[sid] = (i, "full", None)
    return expected


@pytest.mark.parametrize("large", [4096, 40, 3])
def test_detail_levels_of_cases_of_all_sizes(spark, monkeypatch, large):
    monkeypatch.setattr(evidence, "LARGE_CASE", large)
    rnd, states, expected = random.Random(11), [], {}
    for target, n in (("a", 1), ("b", 5), ("c", 12), ("d", 30), ("e", 90), ("f", 4)):
        rows = [(target, f"{target}s{i:03d}", i // 7, rnd.choice([None, "", *(f"h{k}" for k in range(max(2, n // 2)))]), rnd.random() < 0.3) for i in range(n)]
        states += rows
        expected |= _sequential(rows, 12)
    df = spark.createDataFrame(states, _STATE)
    got = evidence.with_detail_level(df).collect()
    assert {r.state_id: (r.position, r.detail, r.same_as) for r in got} == expected
    assert len(got) == len(states)


def test_states_without_an_id_count_and_are_not_shown(spark):
    rows = [("t", None, 0, "h", True), ("t", "a", 0, "h", True), ("t", "b", None, "h", False), (None, "c", 0, "h", True)]
    df = spark.createDataFrame(rows, _STATE)
    found = [tuple(r) for how in (evidence._detail_of_small(df, None), evidence._detail_of_small(df, 12), evidence._detail_of_large(df, 12))
             for r in how.select("target_id", "state_id", "position", "detail", "same_as").collect()]
    assert found == [("t", "a", 3, "full", None)] * 3


def _digest(spark, fields):
    """All lines of a case with one full state, one that is the same and one that has other fields."""
    states = spark.createDataFrame(
        [("t", "a", 0, "h", False, "u", "Title", "some text", "x\n y \n\nz"), ("t", "b", 1, "h", False, "u", "Title", "some text", ""), ("t", "c", 2, "g", True, "u", "", "", "")],
        f"{_STATE}, url string, title string, visible_text string, ocr_text string")
    values = dict(input_url="i", canonical_url=None, num_states=3, num_transitions=2, max_depth_reached=2, lexical_risk_score=0.0, passive_risk_score=0.0)
    bundle = spark.createDataFrame([("t",)], "target_id string").withColumns({name: F.lit(v) for name, v in values.items()} | {flag: F.lit(False) for flag in evidence.FLAGS})
    bundle = bundle.withColumns({c: F.create_map(F.lit("k"), F.lit(1).cast("long")) for c in ("transition_kinds", "evidence_counts")})
    return evidence.case_digest(bundle, states, fields)


def test_lines_around_fields(spark):
    rows = [("t", "a", i, "input", "text", f"f{i:02d}", "L" if i == 3 else "") for i in range(30)] + [("t", "b", 1, "input", "text", "g", ""), ("t", "b", 2, "input", "text", "h", ""), ("t", "c", None, "input", None, "n", "")]
    fields = spark.createDataFrame(rows, "target_id string, state_id string, ord int, tag string, type string, name_or_id string, nearby_label_text string")
    df = _digest(spark, fields)
    lines = {}
    for r in sorted(df.collect(), key=lambda r: (r.section, r.position, r.line_no)):
        lines.setdefault((r.section, r.position), []).append((r.line_no, r.line))
    assert all([n for n, _ in found] == list(range(len(found))) for found in lines.values())
    shown = {position: [line for _, line in found] for (section, position), found in lines.items() if section}
    field = lambda i: f"    input[type=text]  name_or_id=f{i:02d}" + ('  → "L"' if i == 3 else "")
    assert shown[1] == [
        "--- State #1 ---", "  Depth: 0 (continued)", "  URL: u", "  Title: Title", "  Form fields detected (30):", *(field(i) for i in range(25)), "    …and 5 more fields",
        "  Visible text (truncated):", "    some text", "  Text read from the screenshot:", "    x", "    y", "    z"]
    assert shown[2] == ["--- State #2 (same content as State #1) ---", "  Depth: 1 (continued)", "  URL: u"]
    assert shown[3] == ["--- State #3 ---", "  Depth: 2 (leaf, no further action)", "  URL: u", "  Form fields detected (1):", None]
    assert {r.line for r in _digest(spark, None).where("position = 3").collect()} >= {"  Form fields: none"}


def test_lines_are_made_once(spark):
    """No filter works the lines out before they are unfolded, no list of fields is collected, and the states of a case are dealt out once by target."""
    fields = spark.createDataFrame([("t", "a", 1, "input", "text", "f", "")], "target_id string, state_id string, ord int, tag string, type string, name_or_id string, nearby_label_text string")
    plan = _digest(spark, fields)._jdf.queryExecution().optimizedPlan().toString()
    assert "size(" not in plan and "collect_list" not in plan


@pytest.mark.parametrize("text,limit,expected", [
    ("one line", 100, ["    one line"]), ("   ", 100, []), ("a" * 300, 1000, ["    " + "a" * 200]), ("b" * 50, 20, ["    " + "b" * 20, "    …[30 more characters]"]),
    ("a\n  b \n\nc", 100, ["    a", "    b", "    c"])])
def test_text_lines(spark, text, limit, expected):
    df = spark.createDataFrame([(text,)], "t string").withColumn("t", F.concat("t"))
    assert df.select(evidence._text_lines(F.col("t"), limit).alias("x")).first()[0] == expected


def test_texts_are_trimmed_of_all_blanks(spark):
    df = spark.createDataFrame([("<title>  A b 　\n</title> <p> c \td </p>\x85",), ("<title></title> ",)], "html string")
    assert [tuple(r) for r in df.select(pages.title(F.col("html")), pages.visible_text(F.col("html"))).collect()] == [("A b", "A b c d"), ("", "")]
