"""How well the combiner agrees with scores given by hand: anchors with their axes and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlake.functions import scoring
from postlake.profile import AXES, AXIS_WEIGHTS, GATE_PENALTIES

# Role, domain, function, stack, seniority, failed gates and the score given by hand.
ANCHORS = (
    ("Sphere DS Biomedical Signal", 0.85, 0.85, 0.60, 1.0, (), 0.70),
    ("Zyphra Research Eng BCI", 0.95, 0.80, 0.55, 0.90, (), 0.66),
    ("Bandwidth AI Eng R&D", 0.30, 0.78, 0.68, 1.0, (), 0.60),
    ("BD Engineer II", 0.45, 0.72, 0.70, 1.0, (), 0.55),
    ("Pedestal Data Engineer", 0.55, 0.45, 0.62, 1.0, (), 0.50),
    ("NVIDIA SWE AI Clusters", 0.15, 0.48, 0.58, 1.0, (), 0.42),
    ("Epic ML Recommendations", 0.10, 0.42, 0.48, 1.0, (), 0.35),
    ("Google SWE Cloud Storage", 0.10, 0.45, 0.40, 0.85, (), 0.28),
    ("DHHS Lead Data Engineer", 0.30, 0.38, 0.25, 0.85, (), 0.22),
    ("Sonova DSP (CA, embedded)", 0.55, 0.42, 0.40, 1.0, ("geo", "embedded"), 0.10),
    ("Delsys R&D SWE (MA, embedded)", 0.60, 0.55, 0.55, 1.0, ("geo", "embedded"), 0.12),
    ("Astera Research Scientist", 0.80, 0.70, 0.55, 0.80, ("phd",), 0.30),
    ("Ceribell Sr Mgr Applied AI", 0.35, 0.30, 0.35, 0.45, ("management",), 0.20),
    ("CoVar Signal Processing Eng", 0.15, 0.80, 0.70, 1.0, (), 0.52),
    ("Vadum DSP (active TS/SCI)", 0.15, 0.60, 0.55, 1.0, ("clearance",), 0.21),
    ("Teleflex Sr QE (CAPA-heavy)", 0.45, 0.40, 0.30, 0.90, (), 0.38),
    ("restor3d Automation Engineer", 0.42, 0.45, 0.50, 0.78, (), 0.48),
)


def anchors(spark: SparkSession) -> DataFrame:
    """(name, place, one column for each axis, gates, hand)."""
    rows = [(name, i, *numbers, list(gates), hand) for i, (name, *numbers, gates, hand) in enumerate(ANCHORS)]
    return spark.createDataFrame(rows, "name string, place int, " + ", ".join(f"{a} double" for a in AXES) + ", gates array<string>, hand double")


def predicted(rows: DataFrame, weights: dict[str, float] = AXIS_WEIGHTS, penalties: dict[str, float] = GATE_PENALTIES) -> DataFrame:
    """Rows with ``fit``, the combiner's score of their axes and gates."""
    return rows.withColumn("fit", scoring.combined_fit({a: F.col(a) for a in AXES}, F.col("gates"), weights, penalties))


def calibrated(rows: DataFrame, weights: dict[str, float] = AXIS_WEIGHTS, penalties: dict[str, float] = GATE_PENALTIES) -> DataFrame:
    """(mae, n, agreement): the mean error of the combiner against ``hand`` and how far the two orders agree; ties go by ``place``."""
    scored = predicted(rows, weights, penalties).withColumn("_all", F.lit(1))
    order = scoring.rank_agreement(scored, ["_all"], "fit", "hand", ["place"])
    return scoring.mean_error(scored, "fit", "hand").join(order.select("agreement"), F.lit(True))
