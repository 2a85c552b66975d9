"""Fit arithmetic: axes and gates come from a scorer, everything after is columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postlake.functions.text import col
from postlake.profile import AXES, AXIS_WEIGHTS, GATE_PENALTIES

EPS = 1e-6


def clamped(c) -> Column:
    """A number from 0 to 1; what is no number counts 0."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(col(c).try_cast("double"), F.lit(0.0))))


def base_fit(axes: dict[str, Column], weights: dict[str, float] = AXIS_WEIGHTS) -> Column:
    """The weighted geometric mean of the axes; a missing axis counts 0, and none below EPS."""
    total = sum(weights[a] for a in AXES) or 1.0
    logs = [F.lit(weights[a]) * F.ln(F.greatest(F.lit(EPS), F.coalesce(axes.get(a, F.lit(None)).cast("double"), F.lit(0.0)))) for a in AXES]
    return F.exp(sum(logs[1:], logs[0]) / F.lit(total))


def gate_factor(gates: Column, penalties: dict[str, float] = GATE_PENALTIES) -> Column:
    """The penalty of the worst failed gate, 1 for none and for unknown ones."""
    table = F.create_map(*[F.lit(x) for pair in penalties.items() for x in pair])
    known = F.transform(F.coalesce(gates, F.array().cast("array<string>")), lambda g: F.coalesce(F.try_element_at(table, g), F.lit(1.0)))
    return F.least(F.lit(1.0), F.coalesce(F.array_min(known), F.lit(1.0)))


def combined_fit(axes: dict[str, Column], gates: Column, weights=AXIS_WEIGHTS, penalties=GATE_PENALTIES, digits: int = 2) -> Column:
    return F.round(base_fit(axes, weights) * gate_factor(gates, penalties), digits)


def with_mission(fit, mission) -> Column:
    """sqrt(fit x mission); null if either is null or negative."""
    return F.when((col(fit) >= 0) & (col(mission) >= 0), F.sqrt(col(fit) * col(mission)))


def effective_mission(mission, multi_division: Column, floor: float) -> Column:
    return F.when(multi_division, F.greatest(F.coalesce(col(mission), F.lit(0.0)), F.lit(floor))).otherwise(col(mission))


def reason_text(axes: dict[str, Column], gates: Column, reason) -> Column:
    """[dom0.45 fun0.72 sta0.55 sen0.80 gate:a+b] reason; the plain reason if no axis is known."""
    numbers = F.concat_ws(" ", *[F.concat(F.lit(a[:3]), F.format_string("%.2f", F.coalesce(axes[a], F.lit(0.0)))) for a in AXES])
    failed = F.when(F.size(gates) > 0, F.concat(F.lit(" gate:"), F.array_join(gates, "+"))).otherwise("")
    plain = F.coalesce(col(reason), F.lit(""))
    known = F.coalesce(*[axes[a] for a in AXES]).isNotNull()
    return F.when(known, F.trim(F.concat(F.lit("["), numbers, failed, F.lit("] "), plain))).otherwise(plain)


_TAG = r"^\[dom(\d\.\d+) fun(\d\.\d+) sta(\d\.\d+) sen(\d\.\d+)(?: gate:([^\]]*))?\]"


def parsed_axes(reason) -> dict[str, Column]:
    """The axes and the gates (as a list) that a reason's tag holds; null where there is none."""
    out = {a: F.regexp_extract(col(reason), _TAG, i + 1).try_cast("double") for i, a in enumerate(AXES)}
    gates = F.regexp_extract(col(reason), _TAG, 5)
    return out | {"gates": F.when(gates != "", F.split(gates, "\\+"))}


def clean_reason(reason) -> Column:
    return F.regexp_replace(col(reason), r"^\[[^\]]*\]\s*", "")


def mean_error(rows: DataFrame, predicted: str, wanted: str) -> DataFrame:
    return rows.agg(F.avg(F.abs(F.col(predicted) - F.col(wanted))).alias("mae"), F.count("*").alias("n"))


def rank_agreement(rows: DataFrame, group: list[str], predicted: str, wanted: str, key: list[str]) -> DataFrame:
    """Kendall's agreement of two orders within groups: (concordant - discordant) / pairs, 1 for a single row.

    Both orders fall, ties going to the smaller of ``key``.  The group is the join key, so
    pairs arise within groups only; groups are meant to be small, as a set of
    anchors or the lines of an order is.
    """
    order = lambda c: F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(c), *key))
    placed = rows.select(*group, order(predicted).alias("p"), order(wanted).alias("w"))
    pairs = placed.alias("a").join(placed.alias("b"), [F.col(f"a.{g}") == F.col(f"b.{g}") for g in group]).where("a.p < b.p")
    signs = pairs.select(*[F.col(f"a.{g}").alias(g) for g in group], F.when(F.col("a.w") < F.col("b.w"), 1).otherwise(-1).alias("s"))
    found = signs.groupBy(*group).agg(F.avg("s").alias("agreement"))
    return rows.select(*group).distinct().join(found, group, "left").select(*group, F.coalesce("agreement", F.lit(1.0)).alias("agreement"))


#: What counts as no in a judge's object of gates.
_NO = ("false", "null", "0", "0.0", "", "[]", "{}")


def known_gates(answer, gates: tuple[str, ...] = tuple(GATE_PENALTIES)) -> Column:
    """The known gates that a judge's JSON names: a list of names, or an object of flags of which the true ones count; else none.

    A flag written as the text "false" counts as false.
    """
    text = F.trim(F.coalesce(col(answer), F.lit("")))
    listed = F.from_json(F.when(text.startswith("["), text), "array<string>")
    flags = F.from_json(F.when(text.startswith("{"), text), "map<string,string>")
    on = F.map_keys(F.map_filter(flags, lambda _, v: v.isNotNull() & ~F.lower(v).isin(*_NO)))
    return F.filter(F.coalesce(listed, on, F.array().cast("array<string>")), lambda g: g.isin(*gates))


def seat_gates(gates: Column, seat) -> Column:
    """A seat of management or programmes fails the management gate, whatever the judge listed."""
    leads = F.lower(F.trim(F.coalesce(col(seat), F.lit("")))).isin("management", "program-product")
    return F.when(leads, F.array_union(gates, F.array(F.lit("management")))).otherwise(gates)


def deep_reason(reason, years, seat, gaps: Column) -> Column:
    """deep: reason [5+yrs | seat | gaps: a; b; c], with what is known and three gaps at most."""
    seat, years = F.lower(F.trim(F.coalesce(col(seat), F.lit("")))), col(years)
    named = F.slice(F.filter(F.transform(F.coalesce(gaps, F.array().cast("array<string>")), lambda g: F.trim(g)), lambda g: g != ""), 1, 3)
    bits = F.array_compact(F.array(F.when(years > 0, F.concat(years.cast("string"), F.lit("+yrs"))), F.nullif(seat, F.lit("")), F.when(F.size(named) > 0, F.concat(F.lit("gaps: "), F.array_join(named, "; ")))))
    said = F.concat(F.lit("deep: "), F.trim(F.coalesce(col(reason), F.lit(""))))
    return F.when(F.size(bits) > 0, F.concat(said, F.lit(" ["), F.array_join(bits, " | "), F.lit("]"))).otherwise(said)


def judged_score(score) -> Column:
    """A judge's number from 0 to 1; null, not 0, for what is no number."""
    number = col(score).try_cast("double")
    return F.when(number.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), number)))


def mission(name, tier, score, tiers: tuple[str, ...], pinned: str | None = None, pinned_tier: str | None = None) -> Column:
    """struct(tier, score) of an employer: 1 for names that the pattern ``pinned`` finds, else the judge's known tier and number."""
    low = F.lower(F.trim(col(tier)))
    out = F.struct(F.when(low.isin(*tiers), low).alias("tier"), judged_score(score).alias("score"))
    if pinned is None:
        return out
    target = F.coalesce(F.lower(col(name)).rlike(pinned), F.lit(False))
    return F.when(target, F.struct(F.lit(pinned_tier).cast("string").alias("tier"), F.lit(1.0).alias("score"))).otherwise(out)
