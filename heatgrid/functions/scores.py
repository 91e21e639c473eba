"""Suitability, need, opportunity and priority as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from heatgrid.functions.cells import clamp

# Fixed values of the scoring rules.
NEED = {"severity_score": 0.40, "one_minus_ndvi": 0.25, "ndbi": 0.20, "lst": 0.15}
NEED_D = {"severity_score": 0.40, "one_minus_vegetation_cover": 0.25, "ndbi": 0.20, "lst": 0.15}
OPPORTUNITY = {"landuse": 0.30, "built_inverse": 0.25, "road": 0.15, "green": 0.15, "headroom": 0.15}
OPPORTUNITY_D = {"landuse": 0.30, "built_inverse": 0.15, "road": 0.15, "green": 0.15, "headroom": 0.25}
COOLING = {"lst": 0.55, "one_minus_ndvi": 0.25, "ndbi": 0.20}
SCENARIOS = {"A": (1.0, 1.0), "B": (0.6, 0.3), "C": (0.3, 0.5), "D": (1.0, 1.0)}
LANDUSE_SCORE = {0: 50, 1: 40, 2: 30, 3: 50, 4: 35, 5: 20, 6: 90, 7: 30, 8: 60}
UNTAGGED_SCORE = 50
CLASS_EDGES = (20.0, 40.0, 60.0, 80.0)


def scaled(v: Column, lo: Column, hi: Column, top: float = 100.0) -> Column:
    """Clip to [lo, hi] and scale to 0..top."""
    clipped = F.when(v.isNotNull(), F.least(F.greatest(v, lo), hi))
    return clamp((clipped - lo) / (hi - lo) * top, 0.0, top)


def road_accessibility(m: Column) -> Column:
    """NULL where the distance is NULL (an empty layer)."""
    return (
        F.when(m.isNull(), F.lit(None)).when(m < 50, m * 40.0 / 50.0).when(m <= 500, 100.0)
        .when(m < 2000, 100.0 - 70.0 * (m - 500) / 1500.0).otherwise(30.0))


def green_proximity(m: Column) -> Column:
    """NULL where the distance is NULL (an empty layer)."""
    return F.when(m.isNotNull(), F.greatest(F.lit(0.0), 1 - m / 500.0) * 100.0)


def landuse_eligibility(code: Column) -> Column:
    table = F.create_map(*[F.lit(float(x)) if i % 2 else F.lit(x) for kv in LANDUSE_SCORE.items() for i, x in enumerate(kv)])
    return F.coalesce(table[code], F.lit(float(UNTAGGED_SCORE)))


def weighted(weights: dict[str, float], terms: dict[str, Column], top: float) -> Column:
    total = F.lit(0.0)
    for name, w in weights.items():
        total = total + terms[name] * w
    return clamp(total, 0.0, top)


def gated_product(need: Column, opportunity: Column, scale: float = 100.0) -> Column:
    return clamp(need * opportunity / scale, 0.0, scale)


def weighted_geometric(need: Column, opportunity: Column, a: float, b: float) -> Column:
    return clamp(F.lit(100.0 ** (1 - a - b)) * F.pow(need, F.lit(a)) * F.pow(opportunity, F.lit(b)), 0.0, 100.0)


def additive(need: Column, opportunity: Column) -> Column:
    return clamp(need * 0.5 + opportunity * 0.5, 0.0, 100.0)


def priority_class(score: Column, t1: Column, t2: Column) -> Column:
    """Bands of the float32 score; NULL stays NULL."""
    x = score.cast("float").cast("double")
    return F.when(score.isNotNull(), (x >= t1).cast("int") + (x >= t2).cast("int"))


def priority_tier(cls: Column) -> Column:
    return F.when(cls >= 4, 3).when(cls == 3, 2).when(cls == 2, 1).otherwise(0)


def constraint_class(water: Column, buildings: Column, roads: Column) -> Column:
    return F.when(water, 1).when(buildings, 2).when(roads, 3).otherwise(0)
