"""Blocks of a page put together to figures: which two belong together, and what a figure of several blocks is.

Two blocks are measured once (gaps, common extents, sizes); rules over the measures and the captions then decide, the first that applies.
A page is folded until nothing joins any more: each block goes to the first figure one of whose original blocks it belongs to, so a figure that
has grown draws in no more than its blocks did. A figure that came to cover a foreign one is taken apart again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlens.functions import geometry as g
from paperlens.functions.geometry import Box
from paperlens.functions.text import caption_mismatch, caption_number, looks_like_caption
from paperlens.operators.layout import PAGE, _pages, propagate_captions, propagate_unique

Rect = tuple[float, float, float, float]
FIGURE_KINDS = ("image", "chart")

# Thresholds of the rules, in points or as shares.
TOUCH = 0.05  # common area of two boxes, as a share of both
LOOSE = 0.40  # gap between rows of blocks without a caption, as a share of the lower one
COMMON = 0.3  # common extent that makes neighbours
SNAP = 15.0
LEAK, LEAK_SLACK = 40.0, 5.0
NARROW = 0.65


@dataclass(frozen=True)
class Block:
    box: Rect
    body: Rect
    kind: str
    desc: str
    caption: str | None
    said: str | None  # the number in its own description
    titled: bool  # whether the description begins as a caption does
    parts: tuple[int, ...]

    @property
    def bare(self) -> bool:
        return self.desc.startswith(("image on page", "chart on page", "table on page"))


@dataclass(frozen=True)
class Measures:
    """Of two boxes: gaps and common extents in both directions, their shares of the smaller box, sizes, and common area."""

    gap_x: float
    gap_y: float
    share_x: float
    share_y: float
    common: float
    widths: tuple[float, float]
    heights: tuple[float, float]

    @classmethod
    def of(cls, a: Rect, b: Rect) -> Measures:
        w, h = (abs(a[2] - a[0]), abs(b[2] - b[0])), (abs(a[3] - a[1]), abs(b[3] - b[1]))
        x, y = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
        both = max(x, 0.0) * max(y, 0.0)
        whole = w[0] * h[0] + w[1] * h[1] - both
        part = lambda common, sizes: max(common, 0.0) / min(sizes) if min(sizes) > 0 else 0.0
        return cls(max(-x, 0.0), max(-y, 0.0), part(x, w), part(y, h), both / whole if whole > 0 else 0.0, w, h)

    @property
    def in_row(self) -> bool:
        return self.share_y > 0.5 and _like(self.heights)

    @property
    def aligned(self) -> bool:
        return self.in_row or self.share_x > 0.5 and _like(self.widths) and self.gap_y < 0.3 * min(self.heights)


def _like(sizes: tuple[float, float]) -> bool:
    return abs(sizes[0] - sizes[1]) < 0.35 * max(sizes)


def _ratio(sizes: tuple[float, float]) -> float:
    return max(sizes) / max(min(sizes), 1.0)


def _family(kind: str) -> str:
    return "figure" if kind in (*FIGURE_KINDS, "interline_equation") else kind


def _inside(outer: Rect, inner: Rect) -> bool:
    return outer[0] <= inner[0] and outer[1] <= inner[1] and outer[2] >= inner[2] and outer[3] >= inner[3]


def _around(a: Rect, b: Rect) -> Rect:
    return min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])


def barrier(named: Block, other: Block) -> bool:
    """Whether a block that names its own caption ends a figure: what begins below it belongs to another, unless it bears the
    same number or, without one, is about as wide."""
    if named.caption is None or named.said != named.caption or named.caption in (other.caption, other.said):
        return False
    if other.caption is None:
        wide = max(abs(named.body[2] - named.body[0]), 1.0)
        if abs(other.body[2] - other.body[0]) / wide >= NARROW:
            return False
    return other.box[1] >= named.box[3] - 2.0


def neighbours(a: Block, b: Block, page_w: float) -> bool:
    """Whether two blocks lie as parts of one figure do, by their bodies; captions count only where they differ."""
    m = Measures.of(a.body, b.body)
    low, slim = min(m.heights), min(m.widths)
    numbers = {a.caption, b.caption} - {None}
    if _family(a.kind) != _family(b.kind) and "table" in (a.kind, b.kind):
        beside = m.share_y > 0.5 and _ratio(m.heights) < 2.5 and m.gap_x < 25
        below = m.share_x > 0.5 and _ratio(m.widths) < 2.5 and m.gap_y < 0.5 * max(low, 1.0)
        if not (beside or below):
            return False
    if (a.kind == "interline_equation") != (b.kind == "interline_equation") or len(numbers) == 2 and m.share_y <= 0.5:
        return False
    if not m.aligned and not numbers and m.gap_y > LOOSE * low:
        return False
    if m.common > TOUCH:
        return True
    if m.share_x == 0 and m.gap_x > max(0.02 * page_w, 10.0):
        # beside one another across a gap: columns, unless one of the row names its figure or both are slim
        if not m.in_row:
            return False
        if a.said is None and b.said is None and (slim > 0.25 * page_w or m.gap_x > 1.5 * slim):
            return False
    if a.kind == b.kind == "table":
        reach_x, reach_y = 0.15 * slim, 0.15 * low
    else:
        reach_x = max(1.5 * slim, 100.0) if m.in_row else 0.3 * slim
        far = 250.0 if len(numbers) == 1 and a.caption == b.caption or a.bare or b.bare else 100.0
        reach_y = max(0.3 * low, far) if m.share_x > 0.5 else 0.3 * low
    return m.share_x > COMMON and m.gap_y < reach_y or m.share_y > COMMON and m.gap_x < reach_x


def _reach(a: Block, b: Block, m: Measures, page_w: float, page_h: float) -> tuple[float, float]:
    """How far two blocks of one figure may lie apart, across and down."""
    none, same = a.caption is None and b.caption is None, a.caption is not None and a.caption == b.caption
    if a.kind == b.kind == "table":
        near = 1 if none and not m.aligned else 2
        return max(0.04 * near * page_w, 10.0 * near), max(0.02 * near * page_h, 5.0 * near)
    across = max(0.25 * page_w, 40.0)
    if none:
        return across, max(0.03 * page_h, 10.0)
    if same or a.bare or b.bare:
        return across, max(0.22 * page_h, 60.0)
    return across, max(0.12 * page_h, 40.0)


def belong(a: Block, b: Block, page_w: float, page_h: float, apart: frozenset[str] = frozenset()) -> bool:
    """Whether two blocks are parts of one figure. Figures of `apart` are never put together."""
    numbers = {a.caption, b.caption} - {None}
    if numbers & apart or len(numbers) == 2:
        return False
    if (a.kind == "interline_equation") != (b.kind == "interline_equation"):
        equation, figure = (a, b) if a.kind == "interline_equation" else (b, a)
        named = any((x or "").startswith("F:") for x in (figure.caption, figure.said))
        return figure.kind in FIGURE_KINDS and named and _inside(figure.box, equation.box)
    if barrier(a, b) or barrier(b, a):
        return False
    m = Measures.of(a.box, b.box)
    same = a.caption is not None and a.caption == b.caption
    if not m.aligned and not same and m.gap_y > LOOSE * min(m.heights):
        return False
    if m.common > TOUCH:
        return True
    across, down = _reach(a, b, m, page_w, page_h)
    return m.share_x > COMMON and m.gap_y < down or m.share_y > COMMON and m.gap_x < across


def clipped(outer: Block, inner: Block) -> Block | None:
    """An outer box that has run over a captioned block within it and far below: cut off where that block ends, with its caption."""
    number = inner.caption or inner.said
    if _family(outer.kind) != _family(inner.kind) or not _inside(outer.box, inner.box) or not inner.titled or number is None:
        return None
    begins = outer.desc.lstrip().lower().startswith(("figure", "fig.", "fig ", "table", "tbl"))
    if begins and (outer.caption or outer.said) != number:
        return None
    if outer.box[1] >= inner.box[1] or outer.body[3] > inner.box[1] + LEAK_SLACK or outer.box[3] - inner.box[3] < LEAK:
        return None
    left, top, right, _ = _around(outer.box, inner.box)
    return replace(outer, box=(left, top, right, inner.box[3]), body=_around(outer.body, inner.body), desc=inner.desc, caption=number, said=inner.said, titled=True)


def _described(a: Block, b: Block) -> tuple[str, str | None, bool]:
    """Description of two blocks together: the richer one, or both."""
    short, long = sorted((a, b), key=lambda x: len(x.desc))
    within = long.desc.startswith(short.desc) or long.desc.endswith(short.desc) or len(short.desc) >= 20 and short.desc in long.desc
    if within:
        richer = b if len(a.desc) < len(b.desc) and b.desc.startswith(a.desc) and a.said is None and b.said is not None else a
    elif a.bare:
        richer = b
    elif b.bare:
        richer = a
    else:
        return f"{a.desc}; {b.desc}", a.said or b.said, a.titled
    return richer.desc, richer.said, richer.titled


def together(a: Block, b: Block) -> Block:
    """Two blocks as one: boxes around both; an image wins over a chart or table, a caption of the right kind over one of the other."""
    desc, said, titled = _described(a, b)
    kind = "image" if b.kind == "image" else a.kind
    right = lambda number, of: number is not None and not (number.startswith("F:") and of == "table" or number.startswith("T:") and of in FIGURE_KINDS)
    take = b.caption is not None and (a.caption is None or not right(a.caption, kind) and right(b.caption, b.kind))
    made = Block(_around(a.box, b.box), _around(a.body, b.body), kind, desc, b.caption if take else a.caption, said, titled, a.parts + b.parts)
    cut = clipped(a, b) or clipped(b, a)
    return made if cut is None else replace(made, box=cut.box, body=cut.body, desc=cut.desc, caption=cut.caption, said=cut.said, titled=True)


def _fold(items: list[Block], blocks: list[Block], joins: Callable[[Block, Block], bool]) -> list[Block]:
    out: list[Block] = []
    for item in items:
        for at, group in enumerate(out):
            if len({group.caption, item.caption} - {None}) < 2 and any(joins(blocks[i], item) for i in group.parts):
                out[at] = together(group, item)
                break
        else:
            out.append(item)
    return out


def _spread_apart(blocks: list[Block], apart: frozenset[str]) -> list[Block]:
    """Captions of figures that stay apart, to blocks in line with theirs that have none, until nothing changes."""
    out, todo = list(blocks), [i for i, b in enumerate(blocks) if b.caption in apart]
    while todo:
        i = todo.pop()
        for j, other in enumerate(out):
            if other.caption is None and _family(other.kind) == _family(out[i].kind):
                m = Measures.of(out[i].box, other.box)
                if m.aligned and m.gap_x < 25:
                    out[j] = replace(other, caption=out[i].caption)
                    todo.append(j)
    return out


def group_page(blocks: list[Block], apart: frozenset[str] = frozenset(), edges: tuple[float, float] | None = None, noise: Callable[[Block], bool] = lambda b: False) -> list[Block]:
    """The figures of a page, `parts` being the places of their blocks in order of top and left edge.

    edges: left and right edge of the page's text; boxes that end just within it are drawn out to it.
    """
    if not blocks:
        return []
    page_w = min(max(1.3 * max(max(b.box[2] for b in blocks), 0.0), 400.0), 700.0)
    page_h = min(max(1.3 * max(max(b.box[3] for b in blocks), 0.0), 600.0), 1000.0)
    order = sorted(_spread_apart(blocks, apart), key=lambda b: (b.box[1], b.box[0]))
    order = [replace(b, parts=(i,)) for i, b in enumerate(order)]
    joins = lambda a, b: belong(a, b, page_w, page_h, apart)
    groups, before = _fold(order, order, joins), len(order) + 1
    while len(groups) < before:
        before = len(groups)
        groups = _fold(groups, order, joins)

    def swallows(group: Block) -> bool:
        for other in order:
            if other.parts[0] in group.parts or _family(other.kind) != _family(group.kind) or min(other.body[2] - other.body[0], other.body[3] - other.body[1]) < 30 or not _inside(group.body, other.body):
                continue
            if other.caption not in (None, group.caption) or not any(neighbours(order[i], other, page_w) for i in group.parts):
                return True
        return False

    kept = [b for group in groups for b in ([order[i] for i in group.parts] if len(group.parts) > 1 and swallows(group) else [group])]
    kept = _repair([b for b in kept if b.caption is not None or not noise(b)])
    return [_snapped(b, edges) for b in kept] if edges else kept


def _repair(blocks: list[Block]) -> list[Block]:
    """Boxes that have run over a captioned block are cut off at it and take it in; of several such boxes the largest."""
    out: list[Block | None] = list(blocks)
    for at in range(len(out)):
        inner = out[at]
        if inner is None:
            continue
        fits = [(abs(o.box[2] - o.box[0]) * abs(o.box[3] - o.box[1]), -i, c) for i, o in enumerate(out) if o is not None and i != at and (c := clipped(o, inner))]
        if fits:
            _, place, cut = max(fits, key=lambda f: f[:2])
            out[-place], out[at] = replace(cut, parts=cut.parts + inner.parts), None
    return [b for b in out if b is not None]


def _snapped(b: Block, edges: tuple[float, float]) -> Block:
    left, top, right, bottom = b.box
    if 0 < edges[1] - right <= SNAP:
        right = edges[1]
    if 0 < left - edges[0] <= SNAP:
        left = edges[0]
    return replace(b, box=(left, top, right, bottom))


def prepared(blocks: DataFrame) -> DataFrame:
    """Blocks without noise, with captions spread; tiny ones are noise, others only where no caption of their kind is alone on the page."""
    page = Window.partitionBy(*PAGE)
    wrong = F.coalesce(caption_mismatch(F.col("caption_number"), F.col("block_type")), F.lit(False))
    alone = lambda kind: F.size(F.collect_set(F.when(~wrong & F.col("caption_number").startswith(kind), F.col("caption_number"))).over(page)) == 1
    own = F.when(F.col("block_type") == "table", alone("T:")).when(F.col("block_type").isin(*FIGURE_KINDS), alone("F:")).otherwise(False)
    b = Box.of()
    tiny = F.col("desc").rlike("^(?:image|chart|table) on page") & (b.width < 25) & (b.height < 25)
    kept = blocks.withColumn("_own", own).where(~tiny & (~g.is_noise(b, F.col("desc")) | F.col("_own"))).drop("_own")
    return propagate_unique(propagate_captions(kept))


SCHEMA = "paper_id string, page_idx int, figure int, block_type string, x0 double, y0 double, x1 double, y1 double, desc string, caption_number string, parts int"


def post_process(blocks: DataFrame, apart: tuple[str, ...] = (), edges: DataFrame | None = None) -> DataFrame:
    """Figures of pages from blocks(paper_id, page_idx, pos, block_type, x0, y0, x1, y1, desc, caption_number).

    apart: caption numbers of figures that are to stay in parts. edges: (paper_id, page_idx, x0, x1), the text's left and right edge.
    The body of a block is its box. A page is a small group by nature; a task gets whole pages.
    """
    ready = prepared(blocks).withColumn("said", caption_number(F.col("desc"))).withColumn("titled", looks_like_caption(F.col("desc"))).withColumn("noise", g.is_noise(Box.of(), F.col("desc")))
    if edges is None:
        ready = ready.withColumn("e0", F.lit(None).cast("double")).withColumn("e1", F.lit(None).cast("double"))
    else:
        ready = ready.join(edges.select(*PAGE, F.col("x0").alias("e0"), F.col("x1").alias("e1")), PAGE, "left")
    kept_apart = frozenset(apart)

    def work(page: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        text = lambda c: [x if isinstance(x, str) else None for x in page[c]]
        rects = list(zip(*(page[c].tolist() for c in ("x0", "y0", "x1", "y1"))))
        rows = [Block(r, r, k, d or "", c, s, bool(t), (i,)) for i, (r, k, d, c, s, t) in enumerate(zip(rects, text("block_type"), text("desc"), text("caption_number"), text("said"), page["titled"]))]
        noisy = {(b.box, b.desc) for b, n in zip(rows, page["noise"]) if n}
        e = (page["e0"][0], page["e1"][0])
        made = group_page(rows, kept_apart, None if e[0] is None or np.isnan(e[0]) else e, lambda b: (b.box, b.desc) in noisy)
        n = len(made)
        box = np.array([b.box for b in made], dtype=float).reshape(n, 4)
        return {
            "paper_id": np.repeat(page["paper_id"][:1], n), "page_idx": np.repeat(page["page_idx"][:1], n), "figure": np.arange(n, dtype=np.int32), "block_type": np.array([b.kind for b in made], dtype=object),
            "x0": box[:, 0], "y0": box[:, 1], "x1": box[:, 2], "y1": box[:, 3], "desc": np.array([b.desc for b in made], dtype=object), "caption_number": np.array([b.caption for b in made], dtype=object), "parts": np.array([len(b.parts) for b in made], dtype=np.int32),
        }

    columns = ["paper_id", "page_idx", "pos", "block_type", "x0", "y0", "x1", "y1", "desc", "caption_number", "said", "titled", "noise", "e0", "e1"]
    return _pages(ready.select(*columns), ["pos"], work, SCHEMA)
