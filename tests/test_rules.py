from __future__ import annotations

import json

from pyspark.sql import functions as F

from threadline.operators import rules


def test_default_cases_pass(spark):
    assert rules.run_rule_cases(spark).where("NOT passed").count() == 0
    assert rules.run_rule_cases(spark).count() == 4


def test_python_notation_is_translated(make):
    rule = rules.Rule(name="r", steps=((r"(?P<a>x)(?P=a)(\d)", r"$\g<1>-\2"), ("(bad", "")))
    assert make("t string", ("xx7",)).select(rules.apply_rule(F.col("t"), rule)).first()[0] == "$x-7"
    assert rule.problems() == ["step 2 is not a valid regex and is skipped"]


def test_disabled_and_foreign_rules_are_skipped():
    off = rules.Rule(name="a", enabled=False, steps=(("x", ""),))
    other = rules.Rule(name="b", dialect="ansi", steps=(("x", ""),))
    late = rules.Rule(name="c", priority=9, steps=(("x", ""),))
    early = rules.Rule(name="d", priority=1, steps=(("x", ""),))
    assert [r.name for r in rules.active((off, other, late, early), "tsql", "cleaning")] == ["d", "c"]


def test_load_and_list(spark, tmp_path):
    good = {
        "name": "hash", "dialect": "tsql", "enabled": True, "priority": 3, "pattern": ["a", "b"], "replacement": ["1", "2"],
        "test_cases": [{"name": "t", "input": "ab", "expected": "12"}],
    }
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "one.json").write_text(json.dumps(good))
    (tmp_path / "two.yaml").write_text(
        "name: src\nrule_type: extraction\nextraction_target: source\npriority: 1\npattern: '(FROM)\\s+(\\w+)'\n"
        "extraction_options:\n  skip_catalog_validation: true\n"
    )
    (tmp_path / "bad.yaml").write_text("name: x\nrule_type: extraction\nextraction_target: nowhere\npattern: a\n")
    loaded, failed = rules.load_rules(tmp_path)
    assert [r.name for r in loaded] == ["src", "hash"]
    assert loaded[0].skip_catalog_validation
    assert [f[0] for f in failed] == ["bad.yaml"]
    table = rules.rules_table(spark, loaded, failed)
    assert [r["name"] for r in table.collect()] == ["src", "hash", "bad.yaml"]
    assert [r["name"] for r in rules.rules_table(spark, loaded, failed, text="HA", enabled=True).collect()] == ["hash"]
    assert rules.run_rule_cases(spark, loaded).where("passed").count() == 1
