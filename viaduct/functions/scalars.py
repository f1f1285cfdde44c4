"""Column functions of the road and raster model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
# Speeds in km/h and the classes of highway tags.
SPEED_KMH = {"arterial": 50.0, "local": 30.0}
ARTERIAL_TAGS = (
    "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link",
)
ARTERIAL_STEMS = ("motorway", "trunk", "primary")
ROLE_SUFFIX = "(_satellite|_sat|_image|_img|_mask|_label|_gt)$"
SPLITS = (("train", 0.8), ("val", 0.1), ("test", 0.1))


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_m(lat1, lng1, lat2, lng2) -> Column:
    """Great-circle metres between two points in degrees."""
    a, b, c, d = (F.radians(_c(x)) for x in (lat1, lng1, lat2, lng2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def speed_kmh(road_class) -> Column:
    return F.when(_c(road_class) == "arterial", F.lit(SPEED_KMH["arterial"])).otherwise(F.lit(SPEED_KMH["local"]))


def travel_time_s(length_m, road_class) -> Column:
    """Seconds, to one decimal with banker's rounding."""
    return F.bround(_c(length_m) / (speed_kmh(road_class) * 1000 / 3600), 1)


def weight_ds(travel_time) -> Column:
    """Whole deciseconds, so that equal paths tie exactly."""
    return F.round(_c(travel_time) * 10).cast("long")


def class_by_tag(highway) -> Column:
    """Rule A: the arterial tags, links and secondary roads among them."""
    return F.when(_c(highway).isin(*ARTERIAL_TAGS), "arterial").otherwise("local")


def class_by_stem(highway) -> Column:
    """Rule B: what stands before the first underscore."""
    return F.when(F.split(_c(highway), "_")[0].isin(*ARTERIAL_STEMS), "arterial").otherwise("local")


def tortuosity(path, straight) -> Column:
    return F.when(_c(straight) > 0, _c(path) / _c(straight)).otherwise(1.0)


def class_by_geometry(path, straight, least_m: float = 400.0, most: float = 1.15) -> Column:
    return F.when((_c(path) >= least_m) & (tortuosity(path, straight) <= most), "arterial").otherwise("local")


def class_by_length(path, least_m: float = 400.0) -> Column:
    return F.when(_c(path) >= least_m, "arterial").otherwise("local")


def class_by_criticality(criticality) -> Column:
    c = _c(criticality)
    return F.when(c >= 0.8, "highway").when(c >= 0.6, "primary").when(c >= 0.35, "secondary").otherwise("residential")


def geo_by_bbox(r, c, h, w, lat_min, lat_max, lng_min, lng_max) -> tuple[Column, Column]:
    """(lat, lng) of a pixel; row 0 is the northern edge. Null below two rows or columns."""
    ok = (_c(h) >= 2) & (_c(w) >= 2)
    lat = _c(lat_max) - (_c(lat_max) - _c(lat_min)) * _c(r) / (_c(h) - 1)
    lng = _c(lng_min) + (_c(lng_max) - _c(lng_min)) * _c(c) / (_c(w) - 1)
    return F.when(ok, lat), F.when(ok, lng)


def geo_by_affine(r, c, affine) -> tuple[Column, Column]:
    """(y, x) with x = a c + b r + c0 and y = d c + e r + f for ``affine`` = [a, b, c0, d, e, f]."""
    m = _c(affine)
    return m[3] * _c(c) + m[4] * _c(r) + m[5], m[0] * _c(c) + m[1] * _c(r) + m[2]


def place_by_pixel(r, c) -> tuple[Column, Column]:
    """(y, x) of a pixel as it is, for rasters without a place on earth."""
    return _c(r).cast("double"), _c(c).cast("double")


def pixel_metres(r1, c1, r2, c2, metres_per_pixel: float = 1.0) -> Column:
    return F.sqrt(F.pow(_c(r2) - _c(r1), 2) + F.pow(_c(c2) - _c(c1), 2)) * metres_per_pixel


def foreground(value, threshold: float = 0.5, strict: bool = False) -> Column:
    """Whether a pixel is foreground; null and NaN are background."""
    v = F.coalesce(F.nanvl(_c(value).cast("double"), F.lit(float("-inf"))), F.lit(float("-inf")))
    return v > threshold if strict else v >= threshold


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-_c(x)))


def clamp(x, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(_c(x).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), _c(x))))


def percent_text(x, digits: int = 0, missing: str = "—") -> Column:
    """A share as a percentage, or the marker where it is missing."""
    return F.coalesce(F.concat(F.format_number(clamp(F.nanvl(_c(x), F.lit(None).cast("double"))) * 100, digits), F.lit("%")), F.lit(missing))


def resilience_tier(index) -> Column:
    i = _c(index)
    return F.when(i.isNull(), "Unknown").when(i >= 80, "Resilient").when(i >= 60, "Moderate").otherwise("Fragile")


# The stops of the colour ramp, from not critical to critical.
RAMP = ((0.0, (167, 215, 197)), (0.5, (255, 217, 125)), (1.0, (255, 122, 78)))


def ramp_colour(value, stops=RAMP) -> Column:
    """"rgb(r, g, b)" on a piecewise-linear ramp over [0, 1]; values beyond are clamped."""
    v = clamp(value)
    out = None
    for (a, low), (b, high) in zip(stops[:-1], stops[1:], strict=True):
        t = (v - a) / (b - a)
        channels = [F.round(F.lit(float(x)) + (y - x) * t).cast("int").cast("string") for x, y in zip(low, high, strict=True)]
        text = F.concat(F.lit("rgb("), F.concat_ws(", ", *channels), F.lit(")"))
        out = F.when(v <= b, text) if out is None else out.when(v <= b, text)
    return out


def resilience_colour(index) -> Column:
    """The ramp for an index of 0 to 100, on which the most resilient is the least critical."""
    return ramp_colour(1 - _c(index) / 100)


def edge_weight_px(criticality, disabled) -> Column:
    """Drawn width of an edge."""
    return F.when(_c(disabled), 1.5).otherwise(1.5 + 3.5 * F.coalesce(_c(criticality), F.lit(0.0)))


def scene_id(path) -> Column:
    """File name without folder, extension and role suffix."""
    name = F.regexp_extract(_c(path), r"([^/\\]+)$", 1)
    return F.regexp_replace(F.regexp_replace(name, r"\.[^.]*$", ""), ROLE_SUFFIX, "")


def unit_interval(scene, salt: str = "") -> Column:
    """The first eight bytes of SHA-256 of salt:scene as a number in [0, 1)."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), _c(scene)), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / 2.0**64


def assign_split(u, splits=SPLITS) -> Column:
    out, total = None, 0.0
    for name, share in splits[:-1]:
        total += share
        out = F.when(_c(u) < total, name) if out is None else out.when(_c(u) < total, name)
    return out.otherwise(splits[-1][0]) if out is not None else F.lit(splits[-1][0])


def hash_unit(*parts) -> Column:
    """A uniform number in [0, 1) from the SHA-256 of the parts, the same in any engine."""
    digest = F.sha2(F.concat_ws("|", *[_c(p).cast("string") for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2.0**32


def normalise_channel(value, mean: float, std: float) -> Column:
    return (_c(value) / 255.0 - mean) / std


def first_present(df_columns: list[str], *names: str) -> Column:
    """The first of the named columns that the table has; none is an error."""
    have = [F.col(n) for n in names if n in df_columns]
    if not have:
        raise ValueError(f"none of the columns {names} is there")
    return F.coalesce(*have)
