"""Column builders for boxes, polygons and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of corner boxes; touching or empty boxes give 0."""
    w = F.greatest(F.lit(0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    i = w * h
    u = (a["x1"] - a["x0"]) * (a["y1"] - a["y0"]) + (b["x1"] - b["x0"]) * (b["y1"] - b["y0"]) - i
    return F.when(u <= 0, F.lit(0.0)).otherwise(i.cast("double") / u.cast("double"))


def corners(prefix: str) -> dict[str, Column]:
    return {c: F.col(f"{prefix}.{c}") for c in ("x0", "y0", "x1", "y1")}


def letterbox(nw: Column, nh: Column, width: Column, height: Column, side: int = 640) -> dict[str, Column]:
    """Measures of a normalised box before and after fitting its image into a square."""
    scale = F.least(F.lit(side) / width, F.lit(side) / height)
    pw, ph = nw * width, nh * height
    return {"scale": scale, "pixel_width": pw, "pixel_height": ph, "pixel_area": pw * ph, "effective_width": pw * scale, "effective_height": ph * scale, "effective_area": pw * scale * ph * scale, "effective_short_side": F.least(pw * scale, ph * scale), "relative_area": nw * nh}


def orientation(width: Column, height: Column) -> Column:
    r = width / height
    return F.when(r < 0.95, "portrait").when(r > 1.05, "landscape").otherwise("approximately_square")


def size_group(short_side: Column) -> Column:
    return F.when(short_side < 32, 0).when(short_side < 64, 1).otherwise(2)


def aspect_extremeness(width: Column, height: Column) -> Column:
    return F.abs(F.log(width / height))


def polygon_area(points: Column) -> Column:
    """Shoelace area of array<struct<x,y>>, the ring closed."""
    turned = F.concat(F.slice(points, 2, F.greatest(F.lit(1), F.size(points))), F.slice(points, 1, 1))
    return F.abs(F.aggregate(F.zip_with(points, turned, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, v: s + v)) / 2


def polygon_box(points: Column) -> Column:
    """Centre-form box around a polygon: struct<xc, yc, w, h>."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    x0, x1, y0, y1 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    return F.struct(((x0 + x1) / 2).alias("xc"), ((y0 + y1) / 2).alias("yc"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))


def edges(box: Column) -> Column:
    return F.struct((box["xc"] - box["w"] / 2).alias("x0"), (box["yc"] - box["h"] / 2).alias("y0"), (box["xc"] + box["w"] / 2).alias("x1"), (box["yc"] + box["h"] / 2).alias("y1"))


def contains(points: Column, box: Column, tol: float = 1e-10) -> Column:
    e = edges(box)
    return F.forall(points, lambda p: (p["x"] >= e["x0"] - tol) & (p["x"] <= e["x1"] + tol) & (p["y"] >= e["y0"] - tol) & (p["y"] <= e["y1"] + tol))


def occupancy(points: Column, box: Column) -> Column:
    return F.least(F.try_divide(polygon_area(points), box["w"] * box["h"]), F.lit(1.0))


def border_distance(box: Column) -> Column:
    e = edges(box)
    return F.least(e["x0"], e["y0"], 1 - e["x1"], 1 - e["y1"])


def metrics(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """Precision, recall and F1; 0 where the denominator is 0."""
    d = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return {"precision": d(tp, tp + fp), "recall": d(tp, tp + fn), "f1": d(2 * tp, 2 * tp + fp + fn)}


def percentage(count: Column, total: Column) -> Column:
    return F.try_divide(F.lit(100.0) * count, total)


def source_key(stem: Column) -> Column:
    """A file's stem without its export suffix, in lower case."""
    return F.lower(F.regexp_replace(stem, r"(?i)\.rf\.[0-9a-f]{16,}$", ""))


def label_row(class_id: Column, box: Column) -> Column:
    return F.format_string("%d %.10f %.10f %.10f %.10f", class_id, box["xc"], box["yc"], box["w"], box["h"])


def remap_class(line: Column) -> Column:
    return F.regexp_replace(line, "^[0-5] ", "0 ")


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def measures(nw: Column, nh: Column, width: Column, height: Column, side: int = 640) -> dict[str, Column]:
    """The thirteen measures of a normalised box in its image; all null where a size is out of range."""
    ok = (nw > 0) & (nw <= 1) & (nh > 0) & (nh <= 1) & (width > 0) & (height > 0)
    m = letterbox(nw, nh, width, height, side)
    own = {
        "normalized_width": nw,
        "normalized_height": nh,
        "normalized_area": nw * nh,
        "normalized_shorter_side": F.least(nw, nh),
        "normalized_longer_side": F.greatest(nw, nh),
        "width_px": m["pixel_width"],
        "height_px": m["pixel_height"],
        "area_px": m["pixel_area"],
        "letterbox_scale": m["scale"],
        "effective_width": m["effective_width"],
        "effective_height": m["effective_height"],
        "effective_area": m["effective_area"],
        "effective_short_side": m["effective_short_side"],
    }
    return {k: F.when(ok, v) for k, v in own.items()}


def minimum_box(points: Column) -> Column:
    """Centre-form box of the extrema, from one ordered pass over each axis; null below three vertices."""
    xs, ys = F.array_sort(F.transform(points, lambda p: p["x"])), F.array_sort(F.transform(points, lambda p: p["y"]))
    span = lambda v: (F.element_at(v, 1), F.element_at(v, -1))
    (x0, x1), (y0, y1) = span(xs), span(ys)
    return F.when(F.size(points) >= 3, F.struct(((x0 + x1) / 2).alias("xc"), ((y0 + y1) / 2).alias("yc"), (x1 - x0).alias("w"), (y1 - y0).alias("h")))


def same_box(a: Column, b: Column, tol: float = 1e-10) -> Column:
    return F.coalesce((F.abs(a["xc"] - b["xc"]) <= tol) & (F.abs(a["yc"] - b["yc"]) <= tol) & (F.abs(a["w"] - b["w"]) <= tol) & (F.abs(a["h"] - b["h"]) <= tol), F.lit(False))


def valid_box(box: Column, tol: float = 1e-12) -> Column:
    """Whether a centre-form box is finite, positive and inside the unit square."""
    e = edges(box)
    inside = (e["x0"] >= -tol) & (e["y0"] >= -tol) & (e["x1"] <= 1 + tol) & (e["y1"] <= 1 + tol)
    return finite(box["xc"]) & finite(box["yc"]) & finite(box["w"]) & finite(box["h"]) & (box["w"] > 0) & (box["h"] > 0) & inside


def valid_corners(box: dict[str, Column], width: Column, height: Column) -> Column:
    """Whether a corner box is finite, of positive area and inside its image."""
    all_finite = finite(box["x0"]) & finite(box["y0"]) & finite(box["x1"]) & finite(box["y1"])
    return all_finite & (box["x0"] >= 0) & (box["y0"] >= 0) & (box["x0"] < box["x1"]) & (box["y0"] < box["y1"]) & (box["x1"] <= width) & (box["y1"] <= height)


def strict_occupancy(points: Column, box: Column, tol: float = 1e-10) -> Column:
    """Share of the box that the polygon covers; an error where it is more than whole."""
    share = F.try_divide(polygon_area(points), box["w"] * box["h"])
    return F.when(share > 1 + tol, F.raise_error(F.lit("a polygon is larger than its box")).cast("double")).otherwise(F.least(share, F.lit(1.0)))


def strict_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """``overlap``; an error for boxes that are not finite or are reversed."""
    bad = lambda x: ~(finite(x["x0"]) & finite(x["y0"]) & finite(x["x1"]) & finite(x["y1"])) | (x["x0"] > x["x1"]) | (x["y0"] > x["y1"])
    return F.when(bad(a) | bad(b), F.raise_error(F.lit("a box is reversed or not finite")).cast("double")).otherwise(overlap(a, b))


def geometry_check(points: Column, box: Column) -> Column:
    """All that is checked of a polygon's prepared box, in one struct."""
    return F.struct(
        minimum_box(points).alias("expected_box"),
        box.alias("prepared_box"),
        polygon_area(points).alias("polygon_area"),
        (box["w"] * box["h"]).alias("box_area"),
        F.try_divide(polygon_area(points), box["w"] * box["h"]).alias("occupancy"),
        F.coalesce(contains(points, box), F.lit(False)).alias("contained"),
        same_box(minimum_box(points), box).alias("minimum"),
        valid_box(box, 1e-10).alias("valid"),
    )


def to_pixels(box: Column, width: Column, height: Column) -> Column:
    """Corner box in pixels of a normalised centre-form box."""
    e = edges(box)
    return F.struct((e["x0"] * width).alias("x0"), (e["y0"] * height).alias("y0"), (e["x1"] * width).alias("x1"), (e["y1"] * height).alias("y1"))


def detector_label(class_id: Column, classes: int = 6) -> Column:
    return F.when(class_id.between(0, classes - 1), class_id + 1).otherwise(F.raise_error(F.lit("no foreground class")).cast("int"))


def canonical_label(label: Column, classes: int = 6) -> Column:
    return F.when(label.between(1, classes), label - 1).otherwise(F.raise_error(F.lit("background is no detection")).cast("int"))


def unletterbox(box: dict[str, Column], left: Column, top: Column, ratio: tuple[Column, Column], width: Column, height: Column) -> Column:
    """A box of the padded square back in its image, cut at the borders."""
    back = lambda v, pad, r, most: F.greatest(F.lit(0.0), F.least((v - pad) / r, most.cast("double")))
    return F.struct(back(box["x0"], left, ratio[0], width).alias("x0"), back(box["y0"], top, ratio[1], height).alias("y0"), back(box["x1"], left, ratio[0], width).alias("x1"), back(box["y1"], top, ratio[1], height).alias("y1"))


def exported(conf: Column, box: dict[str, Column], floor: float = 0.001) -> Column:
    """Whether a prediction is exported: above the floor, finite, of positive area."""
    return finite(conf) & (conf > floor) & finite(box["x0"]) & finite(box["y0"]) & finite(box["x1"]) & finite(box["y1"]) & (box["x1"] > box["x0"]) & (box["y1"] > box["y0"])


def size_flags(relative_area: Column) -> dict[str, Column]:
    return {"is_very_small": relative_area < 0.001, "is_unusually_large": relative_area > 0.5}


def extreme_aspect(width: Column, height: Column) -> Column:
    r = width / height
    return (r < 0.5) | (r > 2.0)


def split_path(path: Column) -> Column:
    """The path from its first split component on; an error without one."""
    found = F.regexp_extract(path, r"(?:^|/)((?:train|valid|test)(?:/.*)?)$", 1)
    return F.when(found == "", F.raise_error(F.concat(F.lit("no split in "), path))).otherwise(found)


def display_path(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)


def band(conf: Column) -> Column:
    return F.when(conf >= 0.25, "reference").when(conf >= 0.01, "low").otherwise("very_low")


def fixed(x: Column, digits: int = 12) -> Column:
    """Text of a double with a fixed number of digits."""
    return F.format_string(f"%.{digits}f", x)


def viewport(focus: dict[str, Column], other: dict[str, Column], iou: Column, width: Column, height: Column) -> Column:
    """What to show of an image around a box: with its counterpart if they overlap by a tenth, two and a half times as wide, 160 pixels at least."""
    both = F.coalesce(iou >= 0.1, F.lit(False))
    lo = lambda k: F.when(both, F.least(focus[k], other[k])).otherwise(focus[k])
    hi = lambda k: F.when(both, F.greatest(focus[k], other[k])).otherwise(focus[k])

    def axis(a: Column, b: Column, most: Column) -> tuple[Column, Column]:
        span = F.least(most.cast("double"), F.greatest(F.lit(160.0), (b - a) * 2.5))
        at = F.greatest(F.lit(0.0), F.least(most - span, (a + b) / 2 - span / 2))
        return F.floor(at), F.ceil(at + span)

    (x0, x1), (y0, y1) = axis(lo("x0"), hi("x1"), width), axis(lo("y0"), hi("y1"), height)
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def fit_panel(view: Column, panel: tuple[float, float, float, float]) -> Column:
    """scale and offsets that centre a viewport in a panel (x, y, width, height)."""
    px, py, pw, ph = (F.lit(float(v)) for v in panel)
    w, h = view["x1"] - view["x0"], view["y1"] - view["y0"]
    s = F.least(pw / w, ph / h)
    return F.struct(s.alias("scale"), (px + (pw - w * s) / 2).alias("dx"), (py + (ph - h * s) / 2).alias("dy"))


def map_box(box: dict[str, Column], view: Column, fit: Column) -> Column:
    """A box as drawn in the panel, cut at the viewport; null if nothing is left."""
    x0, y0 = F.greatest(box["x0"], view["x0"]), F.greatest(box["y0"], view["y0"])
    x1, y1 = F.least(box["x1"], view["x1"]), F.least(box["y1"], view["y1"])
    at = lambda v, base, off: off + (v - base) * fit["scale"]
    drawn = F.struct(at(x0, view["x0"], fit["dx"]).alias("x0"), at(y0, view["y0"], fit["dy"]).alias("y0"), at(x1, view["x0"], fit["dx"]).alias("x1"), at(y1, view["y0"], fit["dy"]).alias("y1"))
    return F.when((x0 < x1) & (y0 < y1), drawn)


def affine(width: Column, height: Column, angle: float, dx: float, dy: float, scale: float) -> Column:
    """Rows of the matrix that turns and scales about the centre, then shifts by shares of the size."""
    rad = F.radians(F.lit(float(angle)))
    c, s = F.cos(rad) * scale, F.sin(rad) * scale
    tx = c * (-width / 2) + s * (-height / 2) + (0.5 + dx) * width
    ty = -s * (-width / 2) + c * (-height / 2) + (0.5 + dy) * height
    return F.array(F.array(c, s, tx), F.array(-s, c, ty))


def touches_border(box: dict[str, Column], width: Column, height: Column) -> Column:
    return (box["x0"] <= 0) | (box["y0"] <= 0) | (box["x1"] >= width) | (box["y1"] >= height)


def learning_rate(images_seen: Column, epoch: Column, base: float, warmup_images: float, epochs: int, final_factor: float) -> Column:
    """Linear warm-up over images, linear decay over epochs."""
    warm = F.least(images_seen / F.lit(float(warmup_images)), F.lit(1.0))
    decay = F.greatest(1 - epoch / F.lit(float(epochs)), F.lit(0.0)) * (1 - final_factor) + final_factor
    return F.lit(base) * warm * decay


def class_map(counts: Column, names: list[str]) -> Column:
    """An array of counts by class as a map from names, in the order of the classes; another length is an error."""
    fits = F.size(counts) == len(names)
    made = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), counts)
    return F.when(fits, made).otherwise(F.raise_error(F.concat(F.lit(f"{len(names)} classes, but counts: "), F.size(counts).cast("string"))).cast("map<string,bigint>"))


def by_identifier(boxes: Column) -> Column:
    """Boxes of an export in the order of their identifiers, whatever the order they came in."""
    keyed = F.transform(boxes, lambda b: F.struct(b["box_id"].alias("k"), b.alias("b")))
    return F.transform(F.array_sort(keyed, lambda x, y: F.when(x["k"] < y["k"], -1).when(x["k"] > y["k"], 1).otherwise(0)), lambda x: x["b"])
