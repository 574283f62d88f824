"""Scores, distances and rules as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: Fixed value: the prime modulus of the uniforms.
MERSENNE = 2**31 - 1


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def clean(x: Column) -> Column:
    """NaN is missing."""
    return F.when(~F.isnan(x), x)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(clip(a, 0, 1))) * (2 * EARTH_M)


def uncertainty(p: Column) -> Column:
    """1 where p is a half, 0 where it is 0 or 1."""
    return 1 - F.abs(clip(p, 0, 1) - 0.5) * 2


def threshold_class(x: Column, at: float) -> Column:
    return (x >= at).cast("int")


def risk_band(x: Column, cuts: Sequence[float] = (0.19, 0.40, 0.60, 0.80)) -> Column:
    """1 (below the first cut) to 5 (above the last). The two inner cuts are an assumption, so all are parameters."""
    a, b, c, d = cuts
    return F.when(x < a, 1).when(x < b, 2).when(x < c, 3).when(x <= d, 4).when(x > d, 5)


def char_sum(text: Column) -> Column:
    """Sum of the character codes: names with the same letters collide, by design."""
    return F.aggregate(F.transform(F.split(text, ""), F.ascii), F.lit(0).cast("bigint"), lambda s, x: s + x) % MERSENNE


def uniform(seed: Column, stream: int) -> Column:
    return ((seed * 1103515245 + stream) % MERSENNE).cast("double") / float(MERSENNE)


def hash_features(df: DataFrame, name: str, rainfall_mm_h: float = 25.0) -> DataFrame:
    """The eight features drawn from the characters of a cell's name; stand-ins, to be labelled as synthetic."""
    x = df.withColumn("hx_seed", char_sum(F.col(name)))
    u = lambda k: uniform(F.col("hx_seed"), k)
    x = x.withColumn("impervious_frac", clip(u(4) * 0.7 + 0.1, 0, 1))
    x = x.withColumns(
        {
            "elevation_m": u(1) * 80 + 5 + (F.col("hx_seed") % 1000) / 1000.0 * 20,
            "slope_deg": u(2) * 12 + 0.5,
            "flow_accum_proxy": F.log1p(-clip(u(3), 1e-9, 1 - 1e-9)) * -2,
            "building_density": F.col("impervious_frac") * (u(5) * 200 + 50),
            "dist_stream_m": u(6) * 800 + 20,
            "rainfall_mm_h": F.lit(float(rainfall_mm_h)),
            "land_cover_urban": (F.col("impervious_frac") > 0.45).cast("double"),
        }
    )
    return x.drop("hx_seed")


def normal_noise(cell: Column, scale: float, seed: int = 42) -> Column:
    """Normal noise from the cell id alone, so it does not depend on partitions: Box-Muller on two hashes."""
    one = F.pmod(F.xxhash64(F.lit(seed), cell), F.lit(1 << 40)).cast("double")
    two = F.pmod(F.xxhash64(F.lit(seed + 1), cell), F.lit(1 << 40)).cast("double")
    return F.sqrt(F.log((one + 1) / float(1 << 40)) * -2) * F.cos(two * (6.283185307179586 / float(1 << 40))) * scale


def synthetic_score(noise: Column | None = None) -> Column:
    """Demo risk from six features, clipped to 0..1; higher when low, flat, paved, rainy, built up and near streams."""
    parts = [
        (100 - clip(F.col("elevation_m"), 0, 100)) * (0.25 / 100),
        (1 - clip(F.col("slope_deg"), 0, 15) / 15) * 0.15,
        F.col("impervious_frac") * 0.25,
        F.col("rainfall_mm_h") / 50 * 0.15,
        F.col("building_density") / 250 * 0.10,
        (1 - clip(F.col("dist_stream_m"), 0, 500) / 500) * 0.10,
    ]
    total = parts[0]
    for x in parts[1:]:
        total = total + x
    return clip(total if noise is None else total + noise, 0, 1)


def ponding_score(df: DataFrame, by: Sequence[str] = (), name: str = "rule_score") -> DataFrame:
    """Ponding rule: low, flat, paved ground scores high. Spans are taken over the rows of equal ``by`` (a fold), or all.

    Extremes come from one small aggregate that is joined back, so no partition holds all rows.
    """
    tan = F.tan(F.radians(clip(F.col("slope_deg"), 0.05, 89)))
    x = df.withColumn("hx_wet", F.log1p(F.greatest(F.col("flow_accum_proxy"), F.lit(0.0)) / (tan + 1e-6)))
    ends = x.groupBy(*by).agg(*[f(c).alias(f"hx_{n}_{c}") for c in ("elevation_m", "hx_wet") for n, f in (("lo", F.min), ("hi", F.max))])
    x = x.join(F.broadcast(ends), list(by)) if by else x.crossJoin(F.broadcast(ends))
    scaled = lambda c: clip((F.col(c) - F.col(f"hx_lo_{c}")) / (F.col(f"hx_hi_{c}") - F.col(f"hx_lo_{c}") + 1e-9), 0, 1)
    score = (1 - scaled("elevation_m")) * 0.40 + clip(F.col("impervious_frac"), 0, 1) * 0.35 + (1 - clip(F.col("slope_deg"), 0, 15) / 15) * 0.15 + scaled("hx_wet") * 0.10
    return x.withColumn(name, clip(score, 0, 1)).select(*[F.col(f"`{c}`") for c in df.columns if c != name], name)


def is_incident(complaint: Column, descriptor: Column) -> Column:
    """Service calls about floods or sewers."""
    said = lambda x: F.coalesce(x.like("%Flood%") | x.like("%Sewer%"), F.lit(False))
    return said(complaint) | said(descriptor)


def provenance(df: DataFrame) -> DataFrame:
    """One row, verdict: fixture, mixed, the one label source, or synthetic where there is none."""
    modes = F.collect_set("assembly_mode") if "assembly_mode" in df.columns else F.array().cast("array<string>")
    sources = F.collect_set("label_source") if "label_source" in df.columns else F.array().cast("array<string>")
    x = df.agg(modes.alias("m"), sources.alias("s"))
    only_fixture = (F.size("m") == 1) & F.array_contains("m", "fixture")
    verdict = F.when(only_fixture, "fixture").when(F.array_contains("m", "fixture"), "mixed").when(F.size("s") == 1, F.col("s")[0]).when(F.size("s") > 1, "mixed").otherwise("synthetic")
    return x.select(verdict.alias("verdict"))

