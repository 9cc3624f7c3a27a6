"""Row-level expressions of the track model: calibration, behaviour predicates, zone names, labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default thresholds (fixed values: a switching user expects the same cut-offs).
IMMOBILE_CM_S, IMMOBILE_PX_S = 2.0, 8.0
FREEZING_CM_S, FREEZING_PX_S = 0.5, 2.0
#: Keywords by zone role: fixed values, found anywhere in a lower-case name.
ZONE_WORDS = {
    "novel": ["novel", "novel_object", "new", "object1", "obj1"],
    "familiar": ["familiar", "familiar_object", "old", "object2", "obj2"],
    "open": ["open"],
    "closed": ["closed", "close"],
    "light": ["light", "bright", "illuminated"],
    "dark": ["dark", "black", "unilluminated", "shelter"],
    "centre": ["center", "centre", "inner", "central"],
    "periphery": ["peripher", "outer", "wall", "thigmo", "border"],
    "platform": ["platform", "goal", "target", "escape"],
    "quadrant": ["quadrant", "q1", "q2", "q3", "q4", "nw", "ne", "sw", "se", "north", "south", "east", "west"],
    "arm": ["arm", "left", "right", "centre", "center", "novel", " a", " b", " c"],
}
#: A name that says the second role isn't of the first.
_YIELDS = {"familiar": "novel", "dark": "light"}


def valid(ok: Column, x: Column) -> Column:
    return F.coalesce(ok & x.isNotNull(), F.lit(False))


def to_cm(px: Column, px_per_cm: Column) -> Column:
    return F.when(px_per_cm > 0, px / px_per_cm)


def slower(speed_px: Column, speed_cm: Column, px_per_cm: Column, limit_px: float, limit_cm: float) -> Column:
    """Below the cm limit where calibrated and known, else below the px limit; null speeds are not slower."""
    return F.coalesce(F.when((px_per_cm > 0) & speed_cm.isNotNull(), speed_cm < limit_cm).otherwise(speed_px < limit_px), F.lit(False))


def immobile(speed_px: Column, speed_cm: Column, px_per_cm: Column, limit_px: float = IMMOBILE_PX_S, limit_cm: float = IMMOBILE_CM_S) -> Column:
    return slower(speed_px, speed_cm, px_per_cm, limit_px, limit_cm)


def freezing(speed_px: Column, speed_cm: Column, px_per_cm: Column, limit_px: float = FREEZING_PX_S, limit_cm: float = FREEZING_CM_S) -> Column:
    return slower(speed_px, speed_cm, px_per_cm, limit_px, limit_cm)


def freezing_override(speed_px: Column, speed_cm: Column, px_per_cm: Column, override_cm: Column) -> Column:
    """Freezing under a session's own cm/s threshold where that is positive, else the default one.

    A known cm speed decides whatever the calibration; the px threshold follows it.
    """
    limit = F.when(override_cm > 0, override_cm).otherwise(FREEZING_CM_S)
    px = F.when(px_per_cm > 0, limit * px_per_cm).otherwise(FREEZING_PX_S)
    return F.coalesce(F.when(speed_cm.isNotNull(), speed_cm < limit).otherwise(speed_px < px), F.lit(False))


def behaviour_state(tracked: Column, rearing: Column, is_freezing: Column, is_immobile: Column) -> Column:
    """untracked, rearing, freezing, immobile or mobile; the first that holds."""
    return F.when(~tracked, "untracked").when(F.coalesce(rearing, F.lit(False)), "rearing").when(is_freezing, "freezing").when(is_immobile, "immobile").otherwise("mobile")


def names_zone(name: Column, role: str) -> Column:
    """Whether a zone's name says the role. Familiar gives way to novel, dark to light, and close (not closed) to open."""
    low = F.lower(F.coalesce(name, F.lit("")))
    if role in ("novel", "familiar"):
        low = F.translate(low, " -", "__")
    says = lambda r: reduce(lambda a, b: a | b, (low.contains(w) for w in ZONE_WORDS[r]))
    if role == "closed":
        return low.contains("closed") | (low.contains("close") & ~says("open"))
    return says(role) & ~says(_YIELDS[role]) if role in _YIELDS else says(role)


def time_label(seconds: Column) -> Column:
    whole = F.floor(seconds).cast("int")
    return F.format_string("%d:%02d", F.floor(whole / 60).cast("int"), whole % 60)


def stars(p: Column, none: str = "ns") -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise(none)


def trial_number(label: Column) -> Column:
    """The first digits of a label as a number, else 0."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(label, r"\d+", 0), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))


def natural_key(label: Column) -> Column:
    """Sort key: text before the first digits, then their number."""
    return F.struct(F.regexp_extract(label, r"^\D*", 0).alias("head"), trial_number(label).alias("number"), label.alias("whole"))


def any_contains(query: str, *columns: str) -> Column:
    low = query.lower()
    return reduce(lambda a, b: a | b, (F.coalesce(F.lower(F.col(c).cast("string")).contains(low), F.lit(False)) for c in columns))


def safe_ratio(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.when(b != 0, a / b), F.lit(default))


def entropy(vector: Column) -> Column:
    """Shannon entropy (natural log) of a vector that is normalised by its sum; 0 where the sum is 0."""
    total = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x)
    parts = F.transform(F.filter(vector, lambda x: x > 0), lambda x: -(x / total) * F.log(x / total))
    return F.when(total > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)


def motif_label(c: dict[str, Column]) -> Column:
    """A name for a motif from its mean features, missing ones as 0; thresholds and names are fixed values."""
    c = {k: F.coalesce(F.nanvl(v, F.lit(0.0)), F.lit(0.0)) for k, v in c.items()}
    return (
        F.when(c["rearing"] > 0.3, "rearing").when(c["grooming"] > 0.3, "grooming")
        .when((c["speed"] < 0.1) & (c["turn"] < 0.1), "stillness").when((c["curvature"] > 0.25) & (c["speed"] < 0.3), "hunching")
        .when((c["turn"] > 0.6) & (c["speed"] > 0.2), "turning").when(c["speed"] > 0.7, "running").when(c["speed"] > 0.3, "walking").otherwise("slow_movement")
    )


def qc_grade(value: Column, a: float, b: float, low_is_good: bool = True) -> Column:
    good = (lambda v, t: v <= t) if low_is_good else (lambda v, t: v >= t)
    return F.when(good(value, a), "A").when(good(value, b), "B").otherwise("C")


def qc_tier(*grades: Column) -> Column:
    """C if any grade is C or three are B; B if two are B; else A."""
    bs = reduce(lambda x, y: x + y, ((g == "B").cast("int") for g in grades))
    cs = reduce(lambda x, y: x + y, ((g == "C").cast("int") for g in grades))
    return F.when((cs > 0) | (bs >= 3), "C").when(bs >= 2, "B").otherwise("A")
