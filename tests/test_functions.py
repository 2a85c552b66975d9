"""Text, predicate and scoring columns on single values."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postlake.functions import predicates as P
from postlake.functions import scoring as S
from postlake.functions import text as T
from postlake.profile import AXES, AXIS_WEIGHTS, GATE_PENALTIES, Excludes, Profile, Vocabulary, validate


def values(spark, rows, schema, *columns):
    """What the columns give, row for row."""
    frame = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], f"pos int, {schema}")
    found = frame.select("pos", *[c.alias(f"c{i}") for i, c in enumerate(columns)]).orderBy("pos").collect()
    return [r[1] if len(columns) == 1 else tuple(r[1:]) for r in found]


def test_posted_dates(spark):
    today = F.lit("2026-03-10").cast("date")
    texts = ["2026-02-01T10:00:00+00:00", "Posted Today", "See posting", "1767225600000", "Posted 3 Days Ago", "Posted 30+ Days Ago", "Posted Yesterday", None, "", "12"]
    found = values(spark, [(t,) for t in texts], "t string", T.posted_date("t", today))
    assert [None if x is None else str(x) for x in found] == ["2026-02-01", "2026-03-10", None, "2026-01-01", "2026-03-07", "2026-02-08", "2026-03-09", None, None, None]


def test_age_tags(spark):
    today = F.lit("2026-03-10").cast("date")
    rows = [("2026-03-10", None), ("2026-01-01", "2026-03-04"), ("2026-01-01", "2026-01-09"), ("2026-01-01", None), (None, None)]
    assert values(spark, rows, "seen string, posted string", T.age_tag("seen", "posted", today)) == ["NEW", "6d", "60d!", "?", "?"]


def test_normal_forms(spark):
    assert values(spark, [(" HTTPS://A.io/x/?q#f ",), ("a.io/x//",)], "u string", T.norm_url("u")) == ["a.io/x", "a.io/x"]
    assert values(spark, [("  Data\t Engineer ",)], "t string", T.norm_title("t")) == ["data engineer"]
    assert values(spark, [("wd_acme_x_y",), ("custom_blob",), (None,)], "j string", T.id_namespace("j")) == ["wd_acme_", None, None]


def test_clip_keeps_head_and_tail(spark):
    text = "HEAD" + "x" * 9000 + "TAIL"
    (out,) = values(spark, [(text,)], "t string", T.clipped("t", 5000))
    assert out.startswith("HEAD") and out.endswith("TAIL") and "elided" in out and len(out) == 5000 + len(T.ELISION)


def test_relevance(spark):
    words = Vocabulary(core=("eeg", "signal processing"), domain=("medical",), skill=("python",), exclude=("unpaid",), exclude_title=("intern",), boilerplate=(r"medical\s+insurance",))
    rows = [("Engineer", "EEG work"), ("Engineer", "recognised freegeeg"), ("Engineer", "medical devices in Python"), ("Engineer", "Medical insurance, Python"), ("Intern", "EEG"), ("Engineer", "eeg, unpaid"), ("Engineer", "x" * 1300 + " medical python")]
    assert values(spark, rows, "t string, d string", P.relevance_tier("t", "d", words)) == ["CORE", None, "DOMAIN+SKILL", None, None, None, None]


def test_first_keyword_of_the_list_wins(spark):
    words = Vocabulary(core=("beta", "alpha"))
    assert values(spark, [("alpha beta", ""), ("alphabet", ""), ("", None)], "t string, d string", P.core_anchor("t", "d", words)) == ["beta", None, None]


def test_exclusion_order(spark):
    terms = Excludes(role_phrases=("scribe",), title_tokens=("rn",), strong=("missile",), weak=("army", "radar range", "navy"), nonclinical=("nurse",))
    rows = [("Describe", "a scribe"), ("Describe things", ""), ("RN lead", ""), ("Lead", "our rn team"), ("Eng", "Missile nurse"), ("Eng", "army"), ("Eng", "navy and army"), ("Eng", "radar for defense"), ("Eng", "nurse")]
    wanted = ["role: scribe", None, "role-title: RN", None, "defense: missile", None, "defense: army+navy", "defense: military radar", "non-clinical: nurse"]
    assert values(spark, rows, "t string, d string", P.exclude_reason("t", "d", terms)) == wanted
    assert values(spark, rows[4:5], "t string, d string", P.exclude_reason("t", "d", terms, allow_defense=True)) == ["non-clinical: nurse"]
    assert values(spark, rows, "t string, d string", P.exclude_reason("t", "d", Excludes())) == [None] * len(rows)


def test_remote_and_locality(spark):
    local = P.locality_pattern(("nc",), ("durham",))
    rows = [("Remote - US", ""), ("Boston", "distributed training"), ("Remote; Durham, NC", ""), ("Boston", "fully remote"), ("Remote", "this role is not remote"), ("clinic", ""), (None, None)]
    assert values(spark, rows, "l string, d string", P.geo_mode("l", "d", local)) == ["remote", None, "onsite", "remote", None, None, None]
    assert values(spark, [("Philippines Remote",), ("Remote - US or Canada",), ("",), ("Austria",)], "l string", P.us_eligible("l")) == [False, True, True, True]
    assert values(spark, [("Berlin", "not remote", "tele")], "l string, d string, h string", P.remote_signal("l", "d", "h")) == ["hint:tele"]


def test_clearance(spark):
    assert values(spark, [("Must have an active TS/SCI clearance",), ("able to obtain a security clearance",)], "t string", P.needs_clearance("t")) == [True, False]


def by_hand(axes, gates):
    log = sum(AXIS_WEIGHTS[a] * math.log(max(1e-6, axes[a])) for a in AXES) / sum(AXIS_WEIGHTS.values())
    return math.exp(log) * min([1.0, *(GATE_PENALTIES.get(g, 1.0) for g in gates)])


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(*[st.floats(0, 1)] * 4, st.lists(st.sampled_from([*GATE_PENALTIES, "other"]), max_size=3)), min_size=1, max_size=20))
def test_combined_fit(spark, rows):
    found = values(spark, rows, ", ".join(f"{a} double" for a in AXES) + ", g array<string>", S.combined_fit({a: F.col(a) for a in AXES}, F.col("g"), digits=9))
    for row, got in zip(rows, found, strict=True):
        assert got == pytest.approx(by_hand(dict(zip(AXES, row)), row[4]), abs=1e-8) and 0 <= got <= 1


def test_mission_and_clamp(spark):
    assert values(spark, [(0.9, 0.2), (0.5, 0.5), (None, 0.5), (-1.0, 0.5)], "f double, m double", F.round(S.with_mission("f", "m"), 3)) == [0.424, 0.5, None, None]
    assert values(spark, [("0.4",), ("7",), ("-1",), ("x",), (None,)], "v string", S.clamped("v")) == [0.4, 1.0, 0.0, 0.0, 0.0]


def test_reason_round_trip(spark):
    axes = {a: F.lit(v) for a, v in zip(AXES, (0.45, 0.72, 0.55, 0.8))}
    unknown = {a: F.lit(None).cast("double") for a in axes}
    assert spark.range(1).select(S.reason_text(unknown, F.array(F.lit("geo")), F.lit("fine"))).first()[0] == "fine"
    frame = spark.range(1).select(S.reason_text(axes, F.array(F.lit("geo"), F.lit("phd")), F.lit("fine")).alias("r"))
    row = frame.select("r", *[c.alias(a) for a, c in S.parsed_axes("r").items()], S.clean_reason("r").alias("c")).first()
    assert row["r"] == "[dom0.45 fun0.72 sta0.55 sen0.80 gate:geo+phd] fine"
    assert (row["domain"], row["seniority"], row["gates"], row["c"]) == (0.45, 0.8, ["geo", "phd"], "fine")


def test_profile():
    assert Profile().with_fit(weights={"domain": 0.5}).weights["stack"] == AXIS_WEIGHTS["stack"]
    assert Vocabulary(core=("EEG",)).focused(core=("eeg", "MEG")).core == ("EEG", "MEG")
    assert Vocabulary(core=("EEG",)).only(core=()).core == ("EEG",)
    assert validate({"keywords": {"core": [1]}, "exclude": {}, "locations": {}, "fit": {"weights": {"domain": 1.5}}}) == ["[keywords] core must hold strings", "[fit] weights.domain must be from 0 to 1"]


def test_keep_job(spark):
    gates = {"technical": "engineer", "vocabulary": Vocabulary(core=("eeg",)), "excludes": Excludes(strong=("missile",)), "local": P.locality_pattern(["nc"], ["durham"])}
    flags = {name: F.col(c) for name, c in (("multi_division", "m"), ("watched", "w"), ("whole_board", "b"))}
    rows = [
        ("Engineer", "any", "Boston", False, False, False, True), ("Nurse", "eeg", "Durham", False, False, False, False), (None, None, None, False, False, False, False),
        ("Engineer", "any", "Boston", True, False, False, False), ("Engineer", "eeg", "Boston", True, False, False, True),
        ("Engineer", "missile", "Boston", False, False, False, False), ("Engineer", "missile", "Boston", False, True, False, True),
        ("Engineer", "any", "Durham", False, False, True, True), ("Engineer", "any", "Remote - US", False, False, True, False), ("Engineer", "any", "Remote - US", False, True, True, True), ("Engineer", "any", "Boston", False, True, True, False), ("Engineer", "any", None, False, False, True, False),
    ]
    schema = "t string, d string, l string, m boolean, w boolean, b boolean, wanted boolean"
    assert values(spark, rows, schema, P.keep_job("t", "d", "l", **gates, **flags)) == [r[-1] for r in rows]
    assert values(spark, rows[5:6], schema, P.keep_job("t", "d", "l", **gates | {"excludes": None, "local": None}, **flags)) == [True]


def test_terms_are_looked_for_as_characters_first(spark):
    """A term found anywhere needs no pattern, and texts are lowered and scrubbed once, however many tiers and terms there are."""
    rows = [("an eeg", "a.b"), ("eegs", "aXb"), ("EEG", "x"), (None, "a.b")]
    show = lambda term, pattern: values(spark, rows, "t string, d string", T.holds(F.col("t"), term, pattern))
    assert show("eeg", T.keyword_pattern) == [True, False, False, None] and show("eeg", T.escaped) == [True, True, False, None]
    assert values(spark, rows, "t string, d string", T.holds(F.col("d"), "a.b", T.escaped)) == [True, False, False, True]
    words = Vocabulary(core=("eeg",), domain=("medical",), skill=("python",), extra=("x y",), exclude=("unpaid",), boilerplate=(r"medical\s+insurance",))
    for column in (P.relevance_tier("t", "d", words), P.exclude_reason("t", "d", Excludes(role_phrases=("a", "b"), strong=("missile", "tank"), weak=("c", "d"), nonclinical=("nurse",)), (r"medical\s+insurance",))):
        plan = spark.createDataFrame(rows, "t string, d string").select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("insurance") <= 2  # the text, and for a tier its head
