"""Scalar geometry as Column expressions; points and boxes are structs of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Two segments touch if an end of one lies this close to the other.
TOUCH_TOLERANCE = 0.5
#: Boxes at most this far apart are adjacent.
ADJACENT_GAP = 5.0
WALL_ASPECT_RATIO = 4.0
LEAST_DIMENSION = 0.001


def half_up(value: Column, digits: int = 3) -> Column:
    """Rounding half toward positive infinity."""
    scale = 10**digits
    return F.floor(value * scale + 0.5) / scale


def is_finite(value: Column) -> Column:
    return F.coalesce(value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")), F.lit(False))


def prefix_number(text: Column) -> Column:
    """The number at the start of a text (`12px` is 12); null where there is none."""
    found = F.regexp_extract(text, r"^\s*([-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)", 1)
    return F.when(found != "", found.try_cast("double"))


def length_with_unit(text: Column) -> Column:
    """`12.5mm` as (value, unit); px where no unit stands, null where it is no length."""
    pattern = r"^\s*([-+]?[0-9]*\.?[0-9]+)\s*([A-Za-z%]*)\s*$"
    number = F.regexp_extract(text, pattern, 1)
    unit = F.regexp_extract(text, pattern, 2)
    return F.when(number != "", F.struct(number.try_cast("double").alias("value"), F.when(unit == "", "px").otherwise(unit).alias("unit")))


def point_list(text: Column) -> Column:
    """`x,y x,y` as points; numbers may carry a unit; an odd count, an empty place or a value that is no number gives an empty array."""
    numbers = F.transform(F.split(F.trim(text), r"[\s,]+"), prefix_number)
    n = F.size(numbers)
    ok = (n > 0) & (n % 2 == 0) & F.forall(numbers, is_finite)
    points = F.transform(F.sequence(F.lit(0), F.greatest(n / 2 - 1, F.lit(0)).cast("int")), lambda i: F.struct(F.get(numbers, 2 * i).alias("x"), F.get(numbers, 2 * i + 1).alias("y")))
    return F.when(ok, points).otherwise(F.array().cast("array<struct<x:double,y:double>>"))


def _segment(a: Column, b: Column) -> Column:
    return F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2"))


def segments_of(points: Column, close: bool) -> Column:
    """Consecutive segments of a point array, with the closing one if asked for and there are over two points."""
    empty = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    n = F.size(points)
    steps = F.when(n >= 2, F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: _segment(F.get(points, i), F.get(points, i + 1)))).otherwise(empty)
    if close:
        steps = F.when(n > 2, F.concat(steps, F.array(_segment(F.element_at(points, -1), F.get(points, F.lit(0)))))).otherwise(steps)
    return steps


def round_segments(segments: Column, digits: int = 3) -> Column:
    return F.transform(segments, lambda s: F.struct(*(half_up(s[c], digits).alias(c) for c in ("x1", "y1", "x2", "y2"))))


def box(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    return F.struct(min_x.alias("min_x"), min_y.alias("min_y"), max_x.alias("max_x"), max_y.alias("max_y"))


def box_of_points(points: Column) -> Column:
    """Bounding box of a point array; null if it is empty."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.when(F.size(points) > 0, box(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def box_of_shape(kind: Column, x: Column, y: Column, w: Column, h: Column, r: Column, x2: Column, y2: Column) -> Column:
    """Bounding box of a line, rect, circle or text; null for other kinds."""
    return (
        F.when(kind == "line", box(F.least(x, x2), F.least(y, y2), F.greatest(x, x2), F.greatest(y, y2)))
        .when(kind == "rect", box(x, y, x + w, y + h))
        .when(kind == "circle", box(x - r, y - r, x + r, y + r))
        .when(kind == "text", box(x, y, x, y))
    )


def box_overlap(a: Column, b: Column) -> Column:
    """Closed boxes share a point."""
    return (a["min_x"] <= b["max_x"]) & (b["min_x"] <= a["max_x"]) & (a["min_y"] <= b["max_y"]) & (b["min_y"] <= a["max_y"])


def box_contains(outer: Column, inner: Column) -> Column:
    return (outer["min_x"] <= inner["min_x"]) & (outer["min_y"] <= inner["min_y"]) & (outer["max_x"] >= inner["max_x"]) & (outer["max_y"] >= inner["max_y"])


def box_gap(a: Column, b: Column) -> Column:
    """Distance of two boxes, 0 where they overlap."""
    zero = F.lit(0.0)
    dx = F.greatest(a["min_x"] - b["max_x"], b["min_x"] - a["max_x"], zero)
    dy = F.greatest(a["min_y"] - b["max_y"], b["min_y"] - a["max_y"], zero)
    return F.sqrt(dx * dx + dy * dy)


def box_width(a: Column) -> Column:
    return a["max_x"] - a["min_x"]


def box_height(a: Column) -> Column:
    return a["max_y"] - a["min_y"]


def polygon_area(points: Column) -> Column:
    """Absolute area by the shoelace formula."""
    n = F.size(points)
    terms = F.transform(points, lambda p, i: p["x"] * F.get(points, (i + 1) % n)["y"] - F.get(points, (i + 1) % n)["x"] * p["y"])
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2


def shape_area(kind: Column, w: Column, h: Column, r: Column) -> Column:
    """Area of a rect or circle; null for open kinds."""
    return F.when(kind == "rect", w * h).when(kind == "circle", F.pi() * r * r)


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def distance_to_segment(px: Column, py: Column, s: Column) -> Column:
    """Distance of a point to a segment; a segment without length is a point."""
    dx, dy = s["x2"] - s["x1"], s["y2"] - s["y1"]
    square = dx * dx + dy * dy
    t = F.when(square == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - s["x1"]) * dx + (py - s["y1"]) * dy) / F.when(square == 0, 1.0).otherwise(square))))
    return distance(px, py, s["x1"] + t * dx, s["y1"] + t * dy)


def segments_touch(a: Column, b: Column, tolerance: float = TOUCH_TOLERANCE) -> Column:
    """An end of one segment lies within the tolerance of the other; a mere crossing does not count."""
    ends = [(a["x1"], a["y1"], b), (a["x2"], a["y2"], b), (b["x1"], b["y1"], a), (b["x2"], b["y2"], a)]
    out = F.lit(False)
    for x, y, other in ends:
        out = out | (distance_to_segment(x, y, other) <= tolerance)
    return out


def pair_key(a: Column, b: Column) -> Column:
    """The same text for both orders of a pair."""
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def rolling_hash(text: Column) -> Column:
    """Hash with multiplier 31 over the text's UTF-16 units, wrapped to 32 signed bits, then made absolute."""
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    beyond = lambda c: c - 65536
    units = lambda c: F.when(c < 65536, F.array(c)).otherwise(F.array(F.floor(beyond(c) / 1024) + 0xD800, beyond(c) % 1024 + 0xDC00))
    codes = F.flatten(F.transform(points, units))

    def wrap(v: Column) -> Column:
        return v.bitwiseAND(F.lit(4294967295)).bitwiseXOR(F.lit(2147483648)) - F.lit(2147483648)

    return F.abs(F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + c)))


def hash_coordinates(text: Column) -> tuple[Column, Column]:
    """Coordinates between 0 and 99 derived from a text."""
    h = rolling_hash(text)
    return h % 100, F.floor(h / 100) % 100


def point_wkt(p: Column) -> Column:
    return F.concat(F.lit("POINT("), p["x"].cast("string"), F.lit(" "), p["y"].cast("string"), F.lit(")"))


def _coordinates(points: Column) -> Column:
    return F.array_join(F.transform(points, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", ")


def line_wkt(points: Column) -> Column:
    return F.concat(F.lit("LINESTRING("), _coordinates(points), F.lit(")"))


def close_ring(points: Column) -> Column:
    """The ring with its first point at the end as well."""
    return F.when(F.element_at(points, 1) == F.element_at(points, -1), points).otherwise(F.concat(points, F.slice(points, 1, 1)))


def open_ring(points: Column) -> Column:
    """The ring without a last point that repeats the first."""
    n = F.size(points)
    return F.when((n > 1) & (F.element_at(points, 1) == F.element_at(points, -1)), F.slice(points, 1, n - 1)).otherwise(points)


def polygon_wkt(points: Column) -> Column:
    return F.concat(F.lit("POLYGON(("), _coordinates(close_ring(points)), F.lit("))"))


def title_case(text: Column) -> Column:
    """The first letter as it is, the rest in lower case."""
    return F.concat(F.substring(text, 1, 1), F.lower(F.substr(text, F.lit(2))))


def is_uuid(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"), F.lit(False))


def geojson_points(text: Column) -> tuple[Column, Column]:
    """(type, points) of a GeoJSON geometry: points is an array of (x, y) of a Point, a LineString or the outer ring of a Polygon.

    Other types, text that is no JSON, and positions of fewer than two numbers give null points.
    """
    kind = F.get_json_object(text, "$.type")
    inner = F.get_json_object(text, "$.coordinates")
    read = lambda schema: F.from_json(inner, schema)
    raw = (
        F.when(kind == "Point", F.array(read("array<double>")))
        .when(kind == "LineString", read("array<array<double>>"))
        .when(kind == "Polygon", F.get(read("array<array<array<double>>>"), F.lit(0)))
    )
    points = F.transform(raw, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return kind, F.when(F.forall(points, lambda p: p["x"].isNotNull() & p["y"].isNotNull()), points)


def geojson_shape(text: Column) -> tuple[Column, Column]:
    """(type, points) as geojson_points gives them, a ring without the last point that closes it."""
    kind, points = geojson_points(text)
    return kind, F.when(kind == "Polygon", open_ring(points)).otherwise(points)


#: The types that a written geometry may have, and the least number of points of those that hold a list.
LEAST_POINTS = {"Line": 2, "Polygon": 3}
GEOMETRY_TYPES = ("Point", *LEAST_POINTS)


def geometry_reason(text: Column) -> Column:
    """Why a JSON geometry {type, coordinates} is refused, else null.

    `missing`: null, no JSON, or neither object nor list; `type`: none of GEOMETRY_TYPES;
    `point`: coordinates of a Point that are not {x, y} with two finite numbers; `points`: those
    of a Line or Polygon that are no list of at least so many points.  Numbers in quotes are none.
    """
    value = F.try_parse_json(text)

    def number(v: Column) -> Column:
        told = F.schema_of_variant(v)
        return F.coalesce(told.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)") & is_finite(F.try_variant_get(v, "$", "double")), F.lit(False))

    def point(v: Column) -> Column:
        return number(F.try_variant_get(v, "$.x", "variant")) & number(F.try_variant_get(v, "$.y", "variant"))

    kind = F.try_variant_get(value, "$.type", "string")
    listed = F.try_variant_get(value, "$.coordinates", "array<variant>")
    least = F.create_map(*(F.lit(x) for pair in LEAST_POINTS.items() for x in pair))[kind]
    many = (F.size(listed) >= least) & F.forall(listed, point)
    return (
        F.when(~F.coalesce(F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)"), F.lit(False)), "missing")
        .when(~F.coalesce(kind.isin(*GEOMETRY_TYPES), F.lit(False)), "type")
        .when((kind == "Point") & ~point(F.try_variant_get(value, "$.coordinates", "variant")), "point")
        .when((kind != "Point") & ~F.coalesce(many, F.lit(False)), "points")
    )
