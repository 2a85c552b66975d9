"""Judging, roster and view filters on a few rows."""

from pyspark.sql import functions as F

from postlake import calibration, profile
from postlake.functions import predicates
from postlake.operators import judging, roster, views
from postlake.profile import Profile, Vocabulary

PROFILE = Profile(vocabulary=Vocabulary(core=("eeg",), domain=("neural",), skill=("python", "spark", "sql")))
STORE = "job_id string, title string, description string, status string, disposition string, resume_fit_score double, fit_reason string, fit_gates array<string>, fit_domain double, fit_function double, fit_stack double, fit_seniority double"
BODY = "EEG and neural data in Python, Spark and SQL. " + "x" * 200


def stored(spark, *rows):
    return spark.createDataFrame([(j, t, d, s, None, fit, why, None, None, None, None, None) for j, t, d, s, fit, why in rows], STORE)


def test_unscored_are_healed_and_short_ones_cleared(spark):
    rows = stored(spark, ("a", "Engineer", BODY, "open", None, None), ("b", "Engineer", "  short " + " " * 300, "open", 0.4, "old"), ("c", "Engineer", BODY, "closed", None, None), ("d", "Manager", BODY + " must have an active secret clearance", "open", None, None))
    scorer = judging.keyword_scorer(PROFILE)
    healed = {r["job_id"]: r for r in judging.healed(rows, scorer, PROFILE).collect()}
    assert healed["a"]["resume_fit_score"] > 0 and healed["a"]["fit_function"] == 1.0 and healed["b"]["fit_reason"] == "old" and healed["c"]["resume_fit_score"] is None
    assert sorted(healed["d"]["fit_gates"]) == ["clearance", "management"] and healed["d"]["fit_reason"].startswith("[dom0.67")
    again = {r["job_id"]: r for r in judging.rescored(rows, scorer, PROFILE).collect()}
    assert again["b"]["resume_fit_score"] is None and "too short" in again["b"]["fit_reason"]
    assert judging.within_budget(rows, 3)[0] is False and judging.within_budget(rows, 0)[0] is True


def test_a_judge_that_drops_all_is_not_believed(spark):
    rows = stored(spark, *[(f"j{i}", "Manager", BODY, "open", 0.9, "r") for i in range(6)])
    same, broken = judging.verified_top(rows, judging.keyword_scorer(PROFILE), PROFILE, top=6)
    assert broken and {r["resume_fit_score"] for r in same.collect()} == {0.9}
    out, broken = judging.verified_top(rows.withColumn("resume_fit_score", F.lit(0.1)), judging.keyword_scorer(PROFILE), PROFILE, top=2)
    assert not broken and sum("deep:" in (r["fit_reason"] or "") for r in out.collect()) == 2


def test_roster(spark, tmp_path):
    schema = "name string, ats string, slug string, tags array<string>, active boolean, mission_tier string, notes string"
    firms = spark.createDataFrame([("Acme", "lever", "acme", ["watch"], True, "off-mission", None), ("Beta", "ashby", "beta", [], True, "off-mission", None), ("Gone", "lever", "gone", [], True, "core", None)], schema)
    roster.export_roster(firms, f"{tmp_path}/r")
    assert sorted(map(repr, roster.import_roster(spark, f"{tmp_path}/r", firms).select(*firms.columns).collect())) == sorted(map(repr, firms.collect()))
    out = {r["name"]: (r["active"], r["notes"]) for r in roster.pruned(firms, spark.createDataFrame([("Gone", False), ("Acme", None)], "name string, ok boolean"), off_mission=True).collect()}
    assert out == {"Acme": (True, None), "Beta": (False, "off mission"), "Gone": (False, "board not found")}
    found = spark.createDataFrame([("New One", "lever", "one", 0), ("New-One", "ashby", "one2", 1), ("Two", "lever", "acme", 2), ("Three", "unheard", "x", 3), ("Four", "lever", "bad slug", 4), ("ACME", "lever", "zz", 5)], "name string, ats string, slug string, pos int")
    assert [(r["name"], r["source"]) for r in roster.discovered(firms, found, "term").collect()] == [("New One", "discovery:term")]


def test_filters_and_digest(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "Dev", "X", "Durham", 0.9, "local", True, "NEW", True, False), (2, "b", "Dev", "Y", "EU", 0.8, "remote", False, "3d", False, False), (3, "c", "Ops", "Z", "LA", 0.7, "relocation", True, "60d!", False, True)], "rank int, job_id string, title string, company string, location string, fit double, bucket string, us_ok boolean, age string, watched boolean, verified boolean")
    ids = lambda **k: [r["job_id"] for r in views.shown(rows, **k).orderBy("rank").collect()]
    assert ids() == ["a"] and ids(relocation=True) == ["a", "c"] and ids(relocation=True, age="stale") == ["c"] and ids(search="durham") == ["a"] and ids(min_fit=0.95) == [] and ids(relocation=True, verified_only=True) == ["c"]
    views.write_digest(rows, f"{tmp_path}/d")
    lines = [r["value"] for r in spark.read.text(f"{tmp_path}/d").collect()]
    assert lines[0] == "# Ranked postings" and lines[1].startswith("1. [0.90] Dev")


def test_clearances_that_must_be_held(spark):
    texts = {"Active TS/SCI clearance": True, "a current DoD Top Secret security clearance is needed": True, "active u.s. government secret clearance": True, "eligible for a clearance": False, "ability to obtain a security clearance": False, "must hold clearance": False, "inactive clearance": False, "Active  clearance": True, None: False, "": False}
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r[0]: r[1] for r in frame.select("t", predicates.needs_clearance("t")).collect()}
    assert got == texts
    own = frame.select(predicates.needs_clearance(F.lit("must hold a+b top-level clearance"), ("must hold",), ("a+b", "top level"))).first()[0]
    assert own is True


def test_anchors_by_the_default_weights(spark):
    row = calibration.calibrated(calibration.anchors(spark)).first()
    assert row["n"] == 17 and round(row["mae"], 4) == 0.0365 and round(row["agreement"], 4) == 0.9118
    harsh = calibration.calibrated(calibration.anchors(spark), penalties={**profile.GATE_PENALTIES, "clearance": 0.01}).first()
    assert harsh["mae"] > row["mae"]


def deep_scorer(scores, seen):
    def score(rows):
        got = [r["job_id"] for r in rows.collect()]
        seen.append(sorted(got))
        data = [(j, *([float(scores[j])] * 4), [], "why", 5, "management" if j == "a" else "", ["x", "y", "z", "w"]) for j in got if j in scores]
        return rows.sparkSession.createDataFrame(data, "job_id string, domain double, function double, stack double, seniority double, gates array<string>, reason string, years int, seat string, gaps array<string>")

    return score


def stored_for_rounds(spark, n=8):
    rows = [(chr(97 + i), "Role", "text " * 60, 0.9 - i / 20, "first", "open", None) for i in range(n)]
    schema = "job_id string, title string, description string, resume_fit_score double, fit_reason string, status string, disposition string"
    extra = {"fit_gates": F.array().cast("array<string>"), **{f"fit_{a}": F.lit(None).cast("double") for a in profile.AXES}}
    return spark.createDataFrame(rows, schema).withColumns(extra)


def test_rounds_reach_what_a_demotion_lifts(spark):
    """The best two fall in the first round; the second judges those that took their place, once each."""
    seen = []
    live = spark.createDataFrame([("b", "longer text " * 60)], "job_id string, description string")
    stored, log = judging.verified_rounds(stored_for_rounds(spark), deep_scorer({j: 0.3 for j in "abcd"}, seen), PROFILE, top=2, rounds=2, live=live)
    got = {r["job_id"]: r for r in stored.collect()}
    assert {j for j, r in got.items() if "deep:" in r["fit_reason"]} == {"a", "b", "c", "d"}
    assert set(map(tuple, seen)) == {("a", "b"), ("c", "d")} and [x["scored"] for x in log] == [2, 2] and not any(x["broken"] for x in log)
    assert "management" in got["a"]["fit_gates"] and "[5+yrs | management | gaps: x; y; z]" in got["a"]["fit_reason"]
    assert len(got["b"]["description"]) > 600 and got["e"]["fit_reason"] == "first"


def test_a_broken_judge_stops_after_its_round(spark):
    seen = []
    stored, log = judging.verified_rounds(stored_for_rounds(spark), deep_scorer({j: 0.01 for j in "abcdef"}, seen), PROFILE, top=6, rounds=3)
    assert [x["broken"] for x in log] == [True] and log[0]["fell"] >= 5
    kept, log = judging.verified_rounds(stored_for_rounds(spark), deep_scorer({}, seen), PROFILE, top=6)
    assert log == [] and all(r["fit_reason"] == "first" for r in kept.collect())


def test_usage_is_counted_as_the_job_runs(spark):
    rows = [(i, None if i % 5 == 0 else i, 2, 1 if i % 2 else None, 3) for i in range(100)] + [(100, None, None, None, None)]
    answers = spark.createDataFrame(rows, "job_id int, uncached_input int, cache_write int, cache_read int, output int").repartition(7)
    frame, usage = judging.counted(answers)
    assert frame.count() == 101 and usage.get == {"calls": 100, "uncached_input": sum(i for i in range(100) if i % 5), "cache_write": 200, "cache_read": 50, "output": 300}
    assert judging.usage_line(usage.get) == "100 call(s) | input 4,250 tok (cache read 50, wrote 200, uncached 4,000; 20% of cacheable prefix hit) | output 300 tok"
    empty, none = judging.counted(answers.limit(0), "none")
    assert empty.count() == 0 and none.get["calls"] == 0
