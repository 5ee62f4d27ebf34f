"""Row-level rules and scores as Column expressions (null means unknown, never NaN)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ordered point-of-interest rules (category, tag key, allowed values or None for any).
POI_RULES = [
    ("hospital_count", "amenity", ["hospital"]),
    ("hospital_count", "healthcare", ["hospital"]),
    ("university_count", "amenity", ["university"]),
    ("school_count", "amenity", ["school"]),
    ("healthcare_count", "healthcare", None),
    ("healthcare_count", "amenity", ["clinic", "doctors", "dentist", "pharmacy"]),
    ("cafe_count", "amenity", ["cafe"]),
    ("restaurant_count", "amenity", ["restaurant", "fast_food"]),
    ("bar_pub_count", "amenity", ["bar", "pub", "biergarten"]),
    ("supermarket_count", "shop", ["supermarket"]),
    ("retail_count", "shop", None),
    ("office_count", "office", None),
    ("tourism_count", "tourism", None),
    ("leisure_count", "leisure", None),
]
# Green areas by tag key.
GREEN = {
    "leisure": ["park", "garden", "nature_reserve", "recreation_ground", "golf_course"],
    "landuse": ["forest", "grass", "meadow", "recreation_ground", "allotments", "village_green"],
    "natural": ["wood", "scrub", "grassland", "heath"],
}
# Road classes.
MAJOR_ROADS = ["motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link"]
LOCAL_ROADS = ["tertiary", "tertiary_link", "residential", "living_street", "unclassified", "service", "road"]
NOT_WALKABLE = ["motorway", "motorway_link", "trunk", "trunk_link"]
NOT_CYCLABLE = [*NOT_WALKABLE, "steps"]
# Everyday-needs rules, same shape as POI_RULES.
EVERYDAY_RULES = [
    ("A_food_groceries", "shop", ["supermarket"]),
    ("A_food_groceries", "amenity", ["marketplace"]),
    ("B_healthcare", "amenity", ["hospital"]),
    ("B_healthcare", "amenity", ["clinic", "doctors", "dentist", "pharmacy"]),
    ("C_education", "amenity", ["school", "university", "kindergarten", "library"]),
    ("D_daily_services", "amenity", ["bank", "atm", "post_office", "bureau_de_change", "veterinary"]),
    ("D_daily_services", "shop", ["hairdresser", "laundry", "dry_cleaning"]),
    ("E_retail_shopping", "shop", None),
    ("F_leisure_social", "amenity", ["cafe", "restaurant", "fast_food", "bar", "pub", "biergarten"]),
    ("G_green_recreation", "leisure", GREEN["leisure"]),
    ("F_leisure_social", "leisure", None),
]
# Tags that drop a way from a mode's network.
WALK_EXCLUDE = {
    "area": ["yes"],
    "access": ["private"],
    "highway": ["abandoned", "construction", "no", "planned", "platform", "proposed", "raceway", "razed", "rest_area", "services", "bus_guideway", "cycleway", "motor", "motorway", "motorway_link"],
    "foot": ["no"],
    "service": ["private"],
    "sidewalk": ["separate"],
    "sidewalk:both": ["separate"],
    "sidewalk:left": ["separate"],
    "sidewalk:right": ["separate"],
}
CYCLE_EXCLUDE = {
    "area": ["yes"],
    "access": ["private"],
    "highway": ["abandoned", "construction", "no", "planned", "platform", "proposed", "raceway", "razed", "rest_area", "services", "bus_guideway", "corridor", "elevator", "escalator", "footway", "steps", "motor", "motorway", "motorway_link"],
    "bicycle": ["no"],
    "service": ["private"],
}
# Cycleway tags and their protection category.
CYCLEWAY_KEYS = ["cycleway", "cycleway:left", "cycleway:right", "cycleway:both"]
CYCLEWAY_SKIP = ["no", "separate", "crossing"]
CYCLEWAY_CATEGORY = {
    "track": "protected_separated",
    "lane": "dedicated_lane",
    "shared_lane": "painted_on_road",
    "opposite_lane": "painted_on_road",
}
POI_CATEGORIES = sorted({c for c, _, _ in POI_RULES})
EVERYDAY_CATEGORIES = sorted({c for c, _, _ in EVERYDAY_RULES})


def first_match(rules: Sequence[tuple[str, str, Sequence[str] | None]], tag) -> Column:
    """Category of the first rule that holds, else null; `tag(key)` gives the tag's column."""
    out = F.lit(None).cast("string")
    for cat, key, allowed in reversed(rules):
        hit = tag(key).isNotNull() if allowed is None else F.coalesce(tag(key).isin(*allowed), F.lit(False))
        out = F.when(hit, cat).otherwise(out)
    return out


def any_in(values: Mapping[str, Sequence[str]], tag) -> Column:
    """True when any tag key has a listed value; null tags never match."""
    out = F.lit(False)
    for key, allowed in values.items():
        out = out | F.coalesce(tag(key).isin(*allowed), F.lit(False))
    return out


def road_flags(highway: Column) -> dict[str, Column]:
    """major/local by listing, walkable/cycle by exclusion (an unknown class counts as both)."""
    return {
        "is_major": F.coalesce(highway.isin(*MAJOR_ROADS), F.lit(False)),
        "is_local": F.coalesce(highway.isin(*LOCAL_ROADS), F.lit(False)),
        "is_walkable": ~F.coalesce(highway.isin(*NOT_WALKABLE), F.lit(False)),
        "is_cycle": ~F.coalesce(highway.isin(*NOT_CYCLABLE), F.lit(False)),
    }


def first_class(highway: Column) -> Column:
    """Class of a road tagged with a list: its first entry (input 'a;b' or '[a, b]')."""
    return F.trim(F.element_at(F.split(F.regexp_replace(highway, r"[\[\]']", ""), "[;,]"), 1))


def fix_coordinate(raw: Column, int_digits: int = 2) -> Column:
    """Repair numbers whose thousands dots were put in by a locale: '410.123.564' -> 41.0123564."""
    text = F.trim(raw)
    dots = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit("")))
    digits = F.replace(text, F.lit("."), F.lit(""))
    rebuilt = F.concat(F.substring(digits, 1, int_digits), F.lit("."), F.substr(digits, F.lit(int_digits + 1)))
    ok = digits.rlike("^[0-9]+$") & (F.length(digits) > int_digits)
    return F.when(dots <= 1, text.try_cast("double")).when(ok, rebuilt.try_cast("double"))


def entropy_bits(counts: Sequence[Column]) -> Column:
    """Shannon entropy in bits over the positive entries; 0 when all are 0."""
    total = sum((c.cast("double") for c in counts), F.lit(0.0))
    terms = [F.when(c > 0, -(c / total) * F.log2(c / total)).otherwise(0.0) for c in counts]
    return F.when(total > 0, sum(terms, F.lit(0.0))).otherwise(0.0)


def density_km2(value: Column, land_area_m2: Column) -> Column:
    return F.try_divide(value, land_area_m2 / 1e6)


def piecewise_cost(x: Column, comfortable: float, steep: float, floor: float) -> Column:
    """1 up to `comfortable`, straight line down to `floor` at `steep`, then `floor`; null stays null."""
    mid = 1.0 - (x - comfortable) / (steep - comfortable) * (1.0 - floor)
    return F.when(x <= comfortable, 1.0).when(x <= steep, mid).when(x > steep, floor)


def share_cost_floor(pct: Column, floor: float = 0.5) -> Column:
    return 1.0 - (pct / 100.0) * (1.0 - floor)


def target_range(r: Column, low: float, high: float, floor: float) -> Column:
    """Rises to 1 at `low`, stays until `high`, falls to `floor` at 1."""
    return F.when(r < low, r / low).when(r <= high, 1.0).otherwise(1.0 - (r - high) / (1.0 - high) * (1.0 - floor))


def inverted_u(r: Column, peak: float, near: float, far: float) -> Column:
    """1 at `peak`, `near` at rank 0, `far` at rank 1, straight lines between."""
    return F.when(r >= peak, far + (1 - r) / (1 - peak) * (1 - far)).otherwise(near + (r / peak) * (1 - near))


def benefit(r: Column) -> Column:
    return F.sqrt(r)


def cost(r: Column) -> Column:
    return F.sqrt(1 - r)


def snap_class(dist: Column) -> Column:
    d = F.bround(dist, 2)
    return F.when(d <= 100, "DIRECT").when(d <= 300, "NEARBY").when(d <= 1000, "LARGE_SNAP").otherwise("QUESTIONABLE")


def masked_weighted_mean(weighted: Sequence[tuple[Column, float]]) -> Column:
    """Mean over the non-null columns of a row, weights rescaled to those present."""
    num = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in weighted), F.lit(0.0))
    den = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in weighted), F.lit(0.0))
    return F.try_divide(num, den)


def row_mean(cols: Sequence[Column]) -> Column:
    return masked_weighted_mean([(c, 1.0) for c in cols])


def count_true(flags: Sequence[Column]) -> Column:
    return sum((F.coalesce(f, F.lit(False)).cast("long") for f in flags), F.lit(0).cast("long"))


def argmin_name(cols: Mapping[str, Column]) -> Column:
    """Name of the smallest non-null column; the first listed wins a tie."""
    entries = [F.when(c.isNotNull(), F.struct(c.cast("double").alias("v"), F.lit(i).alias("i"), F.lit(n).alias("n"))) for i, (n, c) in enumerate(cols.items())]
    return F.array_min(F.array_compact(F.array(*entries))).getField("n")


def argmax_name(cols: Mapping[str, Column]) -> Column:
    return argmin_name({n: -c for n, c in cols.items()})


def excess(t: Column, limit: float) -> Column:
    return F.when(t.isNotNull(), F.greatest(t - limit, F.lit(0.0)))


def headroom(t: Column, limit: float) -> Column:
    return F.when(t.isNotNull(), F.greatest(limit - t, F.lit(0.0)))


def join_labels(flags: Mapping[str, Column], none: str) -> Column:
    """'A+B' for the flags that are true, `none` when no flag is."""
    text = F.concat_ws("+", *[F.when(c, F.lit(n)) for n, c in flags.items()])
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(none))


def bin_label(x: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Left-closed bins: labels[i] for edges[i] <= x < edges[i + 1]; the last bin is open."""
    out = F.lit(None).cast("string")
    for lo, label in zip(edges, labels):
        out = F.when(x >= lo, label).otherwise(out)
    return out


def time_parts(ts: Column) -> dict[str, Column]:
    day = F.weekday(ts)
    return {
        "weekday_name": F.date_format(ts, "EEEE"),
        "hour": F.hour(ts),
        "is_weekend": day >= 5,
        "day": F.to_date(ts),
    }


def sanitize(name: Column) -> Column:
    return F.translate(name, " &/", "")


def log1p_clip(x: Column) -> Column:
    return F.log1p(F.greatest(x, F.lit(0.0)))


def consensus_class(pct: Column) -> Column:
    return (
        F.when(pct >= 100, "ROBUST_HIGH")
        .when(pct >= 75, "FREQUENT_HIGH")
        .when(pct >= 25, "CONDITIONAL_HIGH")
        .when(pct > 0, "RARE_HIGH")
        .otherwise("NEVER_HIGH")
    )
