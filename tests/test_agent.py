from __future__ import annotations

import json

import pytest

from sieveworks.__main__ import main
from sieveworks.agent import provenance, skills, tools
from sieveworks.agent.cards import passed_checks
from sieveworks.agent.governance import simulate
from sieveworks.agent.library import ACTIVE_CAP, Library, unattended
from sieveworks.agent.session import Session, by_policy, clip, parse_tags, run_clean_once
from sieveworks.agent.transcript import Transcript
from sieveworks.diff import column_change, inline, word_segments
from sieveworks.report import ranges

FIX = "from pyspark.sql import functions as F\ndef fix(df, columns):\n    return df.withColumns({c: F.trim(F.regexp_replace(c, ' +', ' ')) for c in columns})\n"


def test_library_rules(tmp_path):
    lib = Library.load(tmp_path)
    at = lambda: lib.entries["a"]
    assert lib.register("a", 6)["state"] == "probation" and not unattended(at(), "AUTO")
    for d in ("x", "x", "y"):
        last = lib.record("a", success=True, dataset=d)
    assert last["state"] == "proven" == at()["state"] and unattended(at(), "AUTO") and not unattended(at(), "GATE")
    assert (at()["successes"], at()["datasets"]) == (3, ["x", "y"])
    lib.record("a", success=False, dataset="z")
    assert at()["state"] == "proven"
    lib.record("a", success=False, dataset="z")
    assert at()["state"] == "retired" and lib.candidates(6) == [] and at()["failures"] == 2
    lib.record("a", success=True, dataset="x")
    assert at()["state"] == "retired"  # for good
    lib.save()
    assert Library.load(tmp_path).entries == lib.entries
    for i in range(ACTIVE_CAP + 3):
        lib.register(f"s{i}", 1)
    assert len(lib.candidates(1)) == ACTIVE_CAP
    result = simulate(rounds=60, skills=20)
    assert result["bad_share"]["governed"] < result["bad_share"]["ungoverned"]


def test_skill_format(spark, tmp_path):
    s = skills.Skill("tidy", 'says "x": y', FIX, "def test_it():\n    assert callable(fix)\ndef test_bad():\n    assert False\n", {"disease": "6"}, allowed_tools=["a"], body="text\n")
    path = skills.save(s, tmp_path)
    assert skills.load(path) == s
    assert [f.split(":")[0] for f in skills.run_tests(s)] == ["test_bad"]
    for bad in ("def fix(df): pass", "x = 1", "def fix(df, columns:"):
        with pytest.raises(ValueError):
            skills.save(skills.Skill("x", "d", bad), tmp_path)
    with pytest.raises(ValueError):
        skills.parse("name: x")
    with pytest.raises(ValueError):
        skills.function("import os\ndef fix(df, columns):\n    return df\n")
    (path / "SKILL.md").write_text((path / "SKILL.md").read_text().replace("license:", "extra: x\nlicense:"))
    with pytest.raises(ValueError):
        skills.load(path)
    assert skills.parse_proposal("<name>n</name><description>d</description><fix>f</fix><test>t</test>") == {"name": "n", "description": "d", "fix": "f", "test": "t"}
    assert skills.parse_proposal("<name>n</name>") is None
    assert skills.export(tmp_path, {"tidy": {"name": "tidy", "disease": 6, "state": "proven", "successes": 3, "failures": 0}}, tmp_path / "x.zip").stat().st_size > 0


def test_transcript_numbers_on(tmp_path):
    t = Transcript(tmp_path / "t.jsonl")
    assert [t.append("user", text="a"), t.append("model", text="b")] == [1, 2]
    assert Transcript(tmp_path / "t.jsonl").append("user", text="c") == 3
    with pytest.raises(ValueError):
        t.append("other")


def test_small_parts():
    assert parse_tags("x <execute>a</execute>") == ("execute", "a") and parse_tags("<answer>b</answer>") == ("answer", "b")
    assert parse_tags("none")[0] == parse_tags("<execute>a</execute><answer>b</answer>")[0] == "malformed"
    assert len(clip("x" * 9000)) < 2100 and ranges([1, 2, 3, 5]) == "1-3, 5"
    assert passed_checks("result = 1\nassert result > 0") == [{"expr": "result > 0", "passed": True}] and passed_checks("x =") == []
    assert inline("12.0 oz", "12.0") == "12.0[- oz-]" and word_segments("a", "a") == [("equal", "a")]
    said = column_change("c", 5, 9, [("a" * 100 + " x", "a" * 100 + " y")] * 5, ["d"])
    assert "5 of 9" in said and "2 more" in said and "1 columns untouched" in said and "[-x-]{+y+}" in said


@pytest.fixture
def messy(tmp_path):
    p = tmp_path / "messy.csv"
    p.write_text("city,amount,kind\n" + "".join(f"{' Kent' if i % 2 else 'Clay'},{i},k{i % 3}\n" for i in range(40)))
    return p


def test_clean_flow_and_provenance(spark, tmp_path, messy):
    s = Session(tmp_path / "w", spark=spark)
    summary = run_clean_once(s, str(messy))
    assert {"disease": 6, "slug": "whitespace-damage", "grade": "AUTO", "status": "fixed"} in summary["fixes"]
    assert spark.read.parquet(summary["outputs"]["parquet"]).where("city like ' %'").count() == 0
    graph = provenance.build(s.folder)
    (out,) = [n for n in graph.nodes if n.startswith("out:")]
    assert provenance.trust(graph, out)["trusted"] and "trusted" in s.why()
    assert not provenance.trust(graph, "claim:none")["trusted"]
    again = Session(tmp_path / "w", spark=spark, resume=s.id)
    assert "messy" in again.tables and again.tables["messy"].where("city like ' %'").count() == 0


def test_skills_come_first_and_are_scored(spark, tmp_path, messy):
    skills.save(skills.Skill("trims", "trims spaces", FIX), tmp_path / "lib")
    lib = Library(tmp_path / "lib")
    lib.register("trims", 6)
    lib.save()
    s = Session(tmp_path / "w", spark=spark, skills_dir=tmp_path / "lib")
    s.load(str(messy))
    report = s.clean("messy", by_policy("auto"))
    assert [x["origin"] for x in report.fixes if x["finding"]["disease"] == 6] == ["skill:trims"]
    assert s.library.entries["trims"]["successes"] == 1
    skipped = s.clean("messy", lambda g: "skip")
    assert all(x["status"] == "skipped" for x in skipped.fixes)


def test_model_repairs_are_gated_verified_and_admitted(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("id,k,tag\n" + "".join(f"{i},x{i},a{i}|b\n" for i in range(40)))
    code = "from pyspark.sql import functions as F\ndef fix(df, columns):\n    return df.withColumns({c: F.regexp_replace(c, '[|]', ' ') for c in columns})"
    s = Session(tmp_path / "w", lambda m: f"<execute>{code}</execute>", allow_code=True, spark=spark)
    s.load(str(p))
    report = s.clean("t", by_policy("all"))
    (fix,) = [x for x in report.fixes if x["finding"]["disease"] == 17]
    assert fix["status"] == "fixed" and fix["origin"] == "model"
    assert report.skills_admitted and Library.load(s.library.root).entries[report.skills_admitted[0]]["state"] == "probation"


def test_question_turn(spark, tmp_path, messy):
    replies = iter(["no tags", "<execute>result = messy.count()</execute>", "<answer>40</answer>", "<execute>result = messy.count()\nassert result == 40</execute>", "<answer>There are 40 rows.</answer>", "<restatement>rows</restatement><verdict>match</verdict><reason></reason>"])
    s = Session(tmp_path / "w", lambda m: next(replies), allow_code=True, spark=spark)
    s.load(str(messy))
    card = s.ask("How many rows?")
    assert card.answer == "There are 40 rows." and card.checks == [{"expr": "result == 40", "passed": True}] and not any(card.flags.values())
    graph = provenance.build(s.folder)
    assert provenance.trust(graph, f"claim:{card.card_id}")["trusted"]
    assert "# How many rows?" in (s.folder / "cards" / "c001.md").read_text()


def test_question_turn_limits(spark, tmp_path, messy):
    s = Session(tmp_path / "w", lambda m: "<execute>import os</execute>", allow_code=True, spark=spark)
    s.load(str(messy))
    card = s.ask("?")
    assert card.flags["capped"] and card.flags["malformed_answer"] and len(card.cells) == 6 and all(c["status"] is None for c in card.cells)
    with pytest.raises(PermissionError):
        Session(tmp_path / "w", lambda m: "", spark=spark).ask("?")


def test_tools_and_command_line(spark, tmp_path, messy, capsys):
    assert tools.diagnose_file(str(messy))["rows"] == 40 and "error" in tools.diagnose_file("/none.csv")
    opened = tools.open_data(str(messy), workspace=str(tmp_path / "w"))
    assert "provenance" in tools.why(opened["session"]) and tools.close_session(opened["session"])["closed"] and "error" in tools.why(opened["session"])
    assert tools.clean_file(str(messy), workspace=str(tmp_path / "w"))["variable"] == "messy"
    assert main(["diagnose", str(messy), "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["rows"] == 40
    assert main(["clean", str(messy), "--workspace", str(tmp_path / "w")]) == 0 and main(["diagnose", "/none.csv"]) == 1


def test_family_flow(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,city\n" + "".join(f"{i}, Kent\n" for i in range(20)))
    (tmp_path / "b.csv").write_text("key;city\n" + "".join(f"{i};Kent \n" for i in range(20)))
    out = Session(tmp_path / "w", spark=spark).clean_family(str(tmp_path / "*.csv"), "t", {"b": {"key": "id"}})
    assert out["slices"] == 2 and len(out["drift"]) == 1 and all(c["fixed"] >= 1 for c in out["cleaned"].values())


def test_stream(spark, tmp_path):
    from sieveworks.streaming.monitor import diagnosed, findings_to

    spark.createDataFrame([(" a", i) for i in range(20)], "t string, k int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("t string, k int").parquet(f"{tmp_path}/in")
    seen = {}
    query = diagnosed(stream, lambda n, r: (seen.update({n: r.findings}), findings_to(f"{tmp_path}/out")(n, r))).trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/ckpt").start()
    query.awaitTermination(60)
    assert any(f["disease"] == 6 for f in seen[0]) and spark.read.parquet(f"{tmp_path}/out").count() == len(seen[0])
