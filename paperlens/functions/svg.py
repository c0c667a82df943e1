"""Boxes of vector drawings: clip paths of SVG pages and filled paths of page traces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_POINT = "array<struct<x:double,y:double>>"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), then), 1)


def matrix(c: Column) -> Column:
    """The six numbers of `matrix(a,b,c,d,e,f)`, or null."""
    numbers = F.filter(F.transform(F.split(F.regexp_extract(c, "matrix\\(([^)]+)\\)", 1), ","), lambda x: F.trim(x).try_cast("double")), lambda x: x.isNotNull())
    return F.when(F.size(numbers) == 6, numbers)


def path_points(d: Column) -> Column:
    """Points of a path of moves and lines, absolute or relative: array of (x, y).

    The tokens are folded with the last command, the place reached and an x that waits for its y; anything else is passed over.
    """
    tokens = F.regexp_extract_all(d, F.lit("\\p{L}|[^\\p{L}\\s]+"), 0)
    start = F.struct(F.lit("M").alias("cmd"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(None).cast("double").alias("half"), F.array().cast(_POINT).alias("out"))

    def step(s: Column, token: Column) -> Column:
        read = F.struct(token.try_cast("double").alias("n"), token.rlike("^\\p{L}$").alias("letter"), F.lower(s["cmd"]).alias("kind"), F.when(F.lower(s["cmd"]) == s["cmd"], 1.0).otherwise(0.0).alias("rel"))

        def place(r: Column) -> Column:
            two = r["kind"].isin("m", "l")
            whole = ~r["letter"] & r["n"].isNotNull() & ((two & s["half"].isNotNull()) | r["kind"].isin("h", "v"))
            x = F.when(~whole | (r["kind"] == "v"), s["x"]).otherwise(F.when(two, s["half"]).otherwise(r["n"]) + r["rel"] * s["x"])
            y = F.when(~whole | (r["kind"] == "h"), s["y"]).otherwise(r["n"] + r["rel"] * s["y"])
            half = F.when(~r["letter"] & two & s["half"].isNull(), r["n"])
            return F.struct(F.when(r["letter"], token).otherwise(s["cmd"]).alias("cmd"), x.alias("x"), y.alias("y"), half.alias("half"), whole.alias("whole"))

        return _let(_let(read, place), lambda p: F.struct(p["cmd"], p["x"], p["y"], p["half"], F.when(p["whole"], F.concat(s["out"], F.array(F.struct(p["x"].alias("x"), p["y"].alias("y"))))).otherwise(s["out"]).alias("out")))

    return F.aggregate(tokens, start, step)["out"]


def _around(points: Column, m: Column) -> Column:
    """The box of points after a transformation."""
    xs = F.transform(points, lambda p: m[0] * p["x"] + m[2] * p["y"] + m[4])
    ys = F.transform(points, lambda p: m[1] * p["x"] + m[3] * p["y"] + m[5])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def path_box(d: Column, m: Column) -> Column:
    """The box around the transformed corners of a path's own box; null for fewer than two points or no matrix."""

    def box(both: Column) -> Column:
        points = both["points"]
        x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
        ends = F.struct(F.array_min(x).alias("x0"), F.array_max(x).alias("x1"), F.array_min(y).alias("y0"), F.array_max(y).alias("y1"))
        corners = lambda e: F.array(*[F.struct(e[a].alias("x"), e[b].alias("y")) for a in ("x0", "x1") for b in ("y0", "y1")])
        return F.when((F.size(points) >= 2) & both["m"].isNotNull(), _let(_let(ends, corners), lambda c: _around(c, both["m"])))

    return _let(F.struct(path_points(d).alias("points"), m.alias("m")), box)


def clip_boxes(svg: Column) -> Column:
    """Boxes of an SVG page's clip paths: array of (x0, y0, x1, y1). Those under 2,000 units or of a side ratio beyond 12 are decoration."""
    bodies = F.regexp_extract_all(svg, F.lit('(?s)<clipPath\\s+[^>]*id="[^"]+"[^>]*>(.*?)</clipPath>'), 1)
    path = '<path\\s+[^>]*transform="([^"]+)"[^>]*d="([^"]+)"'
    paths = F.flatten(F.transform(bodies, lambda b: F.regexp_extract_all(b, F.lit(f"(?s){path}"), 0)))
    boxes = F.transform(paths, lambda p: path_box(F.regexp_extract(p, path, 2), matrix(F.regexp_extract(p, path, 1))))

    def large(b: Column) -> Column:
        w, h = b["x1"] - b["x0"], b["y1"] - b["y0"]
        return b.isNotNull() & (w * h >= 2000) & (w / F.nullif(h, F.lit(0.0))).between(1 / 12, 12)

    return F.filter(boxes, large)


def fill_boxes(trace: Column, page_height: Column) -> Column:
    """Boxes of the filled paths of a page trace, with y from the top: array of (x0, y0, x1, y1).

    The page's own height counts where it names one. Only areas above 3,000, wider than 100 and higher than 10 are kept.
    """
    media = F.split(F.trim(F.regexp_extract(trace, '<page[^>]*mediabox="([\\d\\s.]+)"', 1)), "\\s+")
    height = F.coalesce(F.get(media, F.lit(3)).try_cast("double"), page_height.cast("double"))
    fill = '<fill_path[^>]*transform="([^"]+)"[^>]*>(.*?)</fill_path>'
    paths = F.regexp_extract_all(trace, F.lit(f"(?s){fill}"), 0)

    def numbers(line: Column, name: str) -> Column:
        return F.filter(F.transform(F.regexp_extract_all(line, F.lit(f'{name}="([^"]+)"'), 1), lambda v: v.try_cast("double")), lambda v: v.isNotNull())

    def box(path: Column) -> Column:
        m = F.filter(F.transform(F.split(F.trim(F.regexp_extract(path, fill.replace("(.*?)", "[\\s\\S]*?"), 1)), "\\s+"), lambda v: v.try_cast("double")), lambda v: v.isNotNull())
        lines = F.split(F.regexp_replace(path, "^<fill_path[^>]*>", ""), "\\n")
        both = lambda x: F.struct(numbers(x, "\\bx").alias("x"), numbers(x, "\\by").alias("y"))
        zipped = lambda v: F.when(F.size(v["x"]) == F.size(v["y"]), F.zip_with(v["x"], v["y"], lambda a, b: F.struct(a.alias("x"), b.alias("y")))).otherwise(F.array().cast(_POINT))
        pairs = F.flatten(F.transform(lines, lambda x: _let(both(x), zipped)))
        return _let(F.struct(pairs.alias("points"), m.alias("m")), lambda v: F.when((F.size(v["m"]) == 6) & (F.size(v["points"]) > 0), _around(v["points"], v["m"])))

    turned = _let(height, lambda h: F.transform(F.filter(F.transform(paths, box), lambda b: b.isNotNull()), lambda b: F.struct(b["x0"].alias("x0"), (h - b["y1"]).alias("y0"), b["x1"].alias("x1"), (h - b["y0"]).alias("y1"))))
    return F.filter(turned, lambda b: ((b["x1"] - b["x0"]) * (b["y1"] - b["y0"]) > 3000) & (b["x1"] - b["x0"] > 100) & (b["y1"] - b["y0"] > 10))
