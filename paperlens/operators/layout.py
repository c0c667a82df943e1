"""Blocks of page layouts: extraction from nested documents, columns, captions, grouping, validation.

All operators are keyed by (paper_id, page_idx); a page is a small group by nature, and grouped functions get one page at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from paperlens.functions import geometry as g
from paperlens.functions.geometry import Box
from paperlens.functions.text import caption_mismatch, caption_number, same_block_type
from paperlens.schemas import RAW_BLOCK

PAGE = ["paper_id", "page_idx"]
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def _text(lines: Column) -> Column:
    return F.array_join(F.filter(F.flatten(F.transform(lines, lambda ln: F.transform(ln["spans"], lambda s: s["content"]))), lambda x: x.isNotNull()), " ")


def raw_blocks(pages: DataFrame) -> DataFrame:
    """Figure and table blocks of pages(paper_id, page): one row a block, with body box, description and caption number.

    Missing arrays count as empty. A block without a caption is described as `<type> on page <n>`.
    """
    block = pages.select("paper_id", F.col("page.page_idx").alias("page_idx"), F.posexplode(F.coalesce("page.para_blocks", "page.preproc_blocks")).alias("pos", "b")).where(F.col("b.type").isin("image", "table", "chart"))
    subs = F.coalesce(F.col("b.blocks"), F.array().cast("array<struct<type:string,bbox:array<float>,image_path:string,lines:array<struct<bbox:array<float>,spans:array<struct<type:string,content:string,image_path:string>>>>>>"))
    bodies = F.filter(subs, lambda s: s["type"].endswith("_body"))
    captions = F.filter(subs, lambda s: s["type"].endswith("_caption"))
    edge = lambda i, low: (F.array_min if low else F.array_max)(F.transform(bodies, lambda s: F.get(s["bbox"], F.lit(i))))
    own = lambda i, low: F.coalesce(edge(i, low), F.get(F.col("b.bbox"), F.lit(i))).cast("double")
    said = F.nullif(F.trim(F.array_join(F.transform(captions, lambda s: _text(s["lines"])), " ")), F.lit(""))
    desc = F.coalesce(said, F.format_string("%s on page %d", F.col("b.type"), F.col("page_idx") + 1))
    rows = block.select("paper_id", "page_idx", "pos", F.col("b.type").alias("block_type"), own(0, True).alias("x0"), own(1, True).alias("y0"), own(2, False).alias("x1"), own(3, False).alias("y1"), desc.alias("desc"))
    return rows.withColumn("caption_number", caption_number(F.col("desc"))).withColumn("caption_number", F.when(F.col("desc").rlike("^(?:image|chart|table) on page"), F.lit(None)).otherwise(F.col("caption_number")))


def page_lines(pages: DataFrame) -> DataFrame:
    """(paper_id, page_idx, x0, y0, x1, y1, text) of every line of text blocks."""
    block = pages.select("paper_id", F.col("page.page_idx").alias("page_idx"), F.explode(F.coalesce("page.para_blocks", "page.preproc_blocks")).alias("b"))
    line = block.select(*PAGE, F.explode("b.lines").alias("l"))
    at = lambda i: F.get(F.col("l.bbox"), F.lit(i)).cast("double")
    return line.select(*PAGE, at(0).alias("x0"), at(1).alias("y0"), at(2).alias("x1"), at(3).alias("y1"), F.array_join(F.transform("l.spans", lambda s: F.coalesce(s["content"], F.lit(""))), "").alias("text"))


def extents(boxes: DataFrame) -> DataFrame:
    """Union of all boxes of a page, and its text edges."""
    return boxes.groupBy(*PAGE).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def columns(boxes: DataFrame, gutter: float = 12.0, share: float = 0.2, least: int = 4) -> DataFrame:
    """Boundaries between columns of a page: (paper_id, page_idx, boundary).

    Horizontal intervals are merged into islands; a gap of at least `gutter` between two islands that each span `share` of the whole is a boundary.
    """
    spans = boxes.select(*PAGE, F.least("x0", "x1").alias("s"), F.greatest("x0", "x1").alias("e"))
    order = Window.partitionBy(*PAGE).orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(before.isNull() | (F.col("s") > before), 1).otherwise(0)).withColumn("total", F.count("*").over(Window.partitionBy(*PAGE)))
    islands = marked.where(F.col("total") >= least).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*PAGE, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    page = Window.partitionBy(*PAGE)
    along = page.orderBy("island")
    near = islands.withColumn("span", F.greatest(F.max("e").over(page) - F.min("s").over(page), F.lit(1.0))).withColumn("ns", F.lead("s").over(along)).withColumn("ne", F.lead("e").over(along))
    wide = lambda a, b: F.col(b) - F.col(a) >= share * F.col("span")
    return near.where((F.col("ns") - F.col("e") >= gutter) & wide("s", "e") & wide("ns", "ne")).select(*PAGE, ((F.col("e") + F.col("ns")) / 2).alias("boundary"))


def overlaps(boxes: DataFrame, least: float = 0.0) -> DataFrame:
    """Pairs of boxes of a page (by pos) with their IoU above `least` and how much of each the other covers."""
    a = boxes.select(*PAGE, F.col("pos").alias("a"), *[F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")])
    b = boxes.select(*PAGE, F.col("pos").alias("b"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    p, q = Box.of("a_"), Box.of("b_")
    return a.join(b, PAGE).where("a < b").withColumn("iou", g.iou(p, q)).where(F.col("iou") > least).select(*PAGE, "a", "b", "iou", g.overlap_ratio(p, q).alias("b_covered"), g.overlap_ratio(q, p).alias("a_covered"), g.contains(p, q).alias("contains"))


def recurring_headers(lines: DataFrame, least: int = 2) -> DataFrame:
    """Texts that recur at one height in a paper: (paper_id, height, text, n)."""
    return lines.groupBy("paper_id", F.round(F.col("y0") / 10).cast("long").alias("height"), F.trim("text").alias("text")).agg(F.count("*").alias("n")).where((F.col("n") >= least) & (F.col("text") != ""))


def line_clusters(lines: DataFrame, gap: float) -> DataFrame:
    """Lines of a page in clusters: a new one where a line begins at least `gap` below the line before."""
    order = Window.partitionBy(*PAGE).orderBy("y0", "x0", "pos")
    opens = F.when(F.col("y0") - F.lag("y1").over(order) >= gap, 1).otherwise(0)
    numbered = lines.withColumn("opens", opens).withColumn("cluster", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*PAGE, "cluster").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n"))


def largest_gap(lines: DataFrame) -> DataFrame:
    """Where a page's lines are furthest apart: (paper_id, page_idx, gap, at)."""
    order = Window.partitionBy(*PAGE).orderBy("y0", "x0", "pos")
    apart = lines.select(*PAGE, (F.col("y0") - F.lag("y1").over(order)).alias("gap"), F.col("y0").alias("at")).where("gap is not null")
    return apart.groupBy(*PAGE).agg(F.max(F.struct("gap", (-F.col("at")).alias("n"))).alias("m")).select(*PAGE, "m.gap", (-F.col("m.n")).alias("at"))


def propagate_unique(blocks: DataFrame) -> DataFrame:
    """On pages where all captioned blocks of a kind carry one number, blocks of that kind without one get it."""
    kind = F.when(F.col("block_type") == "table", "T").otherwise("F")
    page = Window.partitionBy(*PAGE, kind)
    fits = F.col("caption_number").startswith(kind)
    numbers = F.collect_set(F.when(fits, F.col("caption_number"))).over(page)
    return blocks.withColumn("caption_number", F.when(F.col("caption_number").isNull() & (F.size(numbers) == 1), F.element_at(numbers, 1)).otherwise(F.col("caption_number")))


def _pages(rows: DataFrame, order: list[str], work: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], schema: str | StructType) -> DataFrame:
    """Runs `work` on the columns of each page, many pages to a batch: tasks get whole pages in order, without a call of Python per page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def made(pdf: pd.DataFrame) -> pd.DataFrame:
            columns = {c: pdf[c].to_numpy() for c in pdf.columns}
            paper, page = columns["paper_id"], columns["page_idx"]
            cut = np.flatnonzero(np.r_[True, (paper[1:] != paper[:-1]) | (page[1:] != page[:-1]), True])
            parts = [work({c: v[lo:hi] for c, v in columns.items()}) for lo, hi in zip(cut[:-1], cut[1:])]
            return pd.DataFrame({c: np.concatenate([x[c] for x in parts]) for c in parts[0]})

        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            last = (pdf["paper_id"] == pdf["paper_id"].iloc[-1]) & (pdf["page_idx"] == pdf["page_idx"].iloc[-1])
            ready, held = pdf[~last], pdf[last].reset_index(drop=True)
            if len(ready):
                yield made(ready)
        if held is not None and len(held):
            yield made(held)

    return rows.repartition(*PAGE).sortWithinPartitions(*PAGE, *order).mapInPandas(run, schema)


def _spread(page: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Captions of one page to blocks without one: each from the nearest captioned block of a like kind through aligned neighbours,
    by total gaps; blocks that have a caption pass none on. A tie within a point decides nothing."""
    n = len(page["pos"])
    box = list(zip(*(page[c].tolist() for c in ("x0", "y0", "x1", "y1"))))
    kind, number = page["block_type"].tolist(), [c if isinstance(c, str) else None for c in page["caption_number"]]
    if all(x is not None for x in number) or not any(number):
        return page
    near: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i in range(n):
        for j in range(i + 1, n):
            if (kind[i] == "table") != (kind[j] == "table"):
                continue
            a, b = box[i], box[j]
            v = max(0.0, b[1] - a[3], a[1] - b[3])
            h = max(0.0, b[0] - a[2], a[0] - b[2])
            vo, ho = min(a[3], b[3]) - max(a[1], b[1]), min(a[2], b[2]) - max(a[0], b[0])
            ah, bh, aw, bw = a[3] - a[1], b[3] - b[1], a[2] - a[0], b[2] - b[0]
            row = vo > 0 and vo > 0.5 * min(ah, bh) and abs(ah - bh) < 0.35 * max(ah, bh) and h <= 30
            column = ho > 0 and ho > 0.5 * min(aw, bw) and abs(aw - bw) < 0.35 * max(aw, bw) and v < 0.3 * min(ah, bh)
            if row or column:
                near[i].append((j, v + h))
                near[j].append((i, v + h))
    best: list[dict[str, float]] = [{} for _ in range(n)]
    for start in range(n):
        if number[start] is None or (number[start][0] == "T") != (kind[start] == "table"):
            continue
        seen, heap = {start: 0.0}, [(0.0, start)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > seen[u] or u != start and number[u] is not None:
                continue
            for v, w in near[u]:
                if d + w < seen.get(v, float("inf")):
                    seen[v] = d + w
                    heapq.heappush(heap, (d + w, v))
        for u, d in seen.items():
            if number[u] is None:
                best[u][number[start]] = min(d, best[u].get(number[start], float("inf")))
    for u in range(n):
        ranked = sorted(best[u].items(), key=lambda x: (x[1], x[0]))
        if ranked and (len(ranked) == 1 or ranked[1][1] - ranked[0][1] > 1.0):
            number[u] = ranked[0][0]
    return page | {"caption_number": np.array(number, dtype=object)}


def propagate_captions(blocks: DataFrame) -> DataFrame:
    """Captions spread over aligned neighbours, page by page."""
    return _pages(blocks.select("paper_id", "page_idx", "pos", "block_type", "x0", "y0", "x1", "y1", "desc", "caption_number"), ["pos"], _spread, RAW_BLOCK)


def rebind_captions(blocks: DataFrame, orphans: DataFrame, most: float = 150.0) -> DataFrame:
    """Captions that no block owns, to blocks of their kind and page without one: the nearest pairs first, each used once, none further apart than `most`.

    Where two or more figure captions of a page stand above a block, and one of them above a table, the captions of that page stand one block too
    low; they go to its blocks without one from top to bottom, before any other.

    orphans: (paper_id, page_idx, x0, y0, x1, y1, desc, caption_number). The distance is the vertical gap plus the horizontal one, doubled where both have no width in common.
    """
    columns = ["paper_id", "page_idx", "pos", "block_type", "x0", "y0", "x1", "y1", "desc", "caption_number"]
    loose = orphans.select("paper_id", "page_idx", F.lit(None).cast("int").alias("pos"), F.lit("caption").alias("block_type"), "x0", "y0", "x1", "y1", "desc", "caption_number")

    def bind(page: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        kind, number, desc = page["block_type"].tolist(), page["caption_number"].tolist(), page["desc"].tolist()
        box = list(zip(*(page[c].tolist() for c in ("x0", "y0", "x1", "y1"))))
        bare = [i for i, k in enumerate(kind) if k != "caption" and not isinstance(number[i], str)]
        loose = [i for i, k in enumerate(kind) if k == "caption"]
        used: set[int] = set()
        titles = sorted((c for c in loose if isinstance(number[c], str) and number[c].startswith("F:")), key=lambda c: (box[c][1], c))
        solid = [i for i, k in enumerate(kind) if k != "caption"]
        under = [min(below, key=lambda i: (box[i][1], i)) for c in titles if (below := [i for i in solid if box[i][1] >= box[c][3] - 5])]
        if len(under) >= 2 and any(kind[i] == "table" for i in under):
            for c, b in zip(titles, sorted((b for b in bare if box[b][1] < max(box[c][1] for c in titles)), key=lambda b: (box[b][1], b))):
                used |= {c, b}
                number[b], desc[b] = number[c], desc[c]
        pairs = []
        for c in loose:
            for b in bare:
                if isinstance(number[c], str) and (number[c][0] == "T") == (kind[b] == "table"):
                    p, q = box[c], box[b]
                    v, h = max(0.0, q[1] - p[3], p[1] - q[3]), max(0.0, q[0] - p[2], p[0] - q[2])
                    d = (v + h) * (2 if h > 0 else 1)
                    if d <= most:
                        pairs.append((d, c, b))
        for _, c, b in sorted(pairs):
            if c not in used and b not in used:
                used |= {c, b}
                number[b], desc[b] = number[c], desc[c]
        kept = [i for i, k in enumerate(kind) if k != "caption"]
        out = page | {"caption_number": np.array(number, dtype=object), "desc": np.array(desc, dtype=object)}
        return {c: v[kept] for c, v in out.items()}

    return _pages(blocks.select(*columns).unionByName(loose), ["block_type", "pos"], bind, RAW_BLOCK)


def swap_captions(blocks: DataFrame) -> DataFrame:
    """On pages where just one table has a figure's caption and just one figure a table's, the two captions change places."""
    page = Window.partitionBy(*PAGE)
    wrong = F.coalesce(caption_mismatch(F.col("caption_number"), F.col("block_type")), F.lit(False))
    on_table, on_figure = wrong & (F.col("block_type") == "table"), wrong & (F.col("block_type") != "table")
    one = (F.count_if(on_table).over(page) == 1) & (F.count_if(on_figure).over(page) == 1)
    caption = F.struct("caption_number", "desc")
    other = F.when(on_table, F.max(F.when(on_figure, caption)).over(page)).when(on_figure, F.max(F.when(on_table, caption)).over(page))
    new = F.when(one & wrong, other).otherwise(caption)
    return blocks.withColumn("_new", new).withColumn("caption_number", F.col("_new.caption_number")).withColumn("desc", F.col("_new.desc")).drop("_new")


def settle_captions(blocks: DataFrame, apart: tuple[str, ...] = ()) -> DataFrame:
    """Captions of the other kind than their blocks, put right page by page.

    The first table with a figure's caption and the first figure with a table's change captions, then the second of each, and so on. A caption
    that is left goes to the nearest block of its kind without one, by the gap between them, ties by place; its block has none then. Captions of
    `apart` stay where they are in that.
    """
    columns = ["paper_id", "page_idx", "pos", "block_type", "x0", "y0", "x1", "y1", "desc", "caption_number"]

    def work(page: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        table = [k == "table" for k in page["block_type"]]
        number, desc = [c if isinstance(c, str) else None for c in page["caption_number"]], page["desc"].tolist()
        wrong = [n is not None and n.startswith("F:" if t else "T:") for n, t in zip(number, table)]
        on_tables, on_figures = ([i for i, w in enumerate(wrong) if w and table[i] == side] for side in (True, False))
        for i, j in zip(on_tables, on_figures):
            number[i], number[j], desc[i], desc[j] = number[j], number[i], desc[j], desc[i]
        paired = min(len(on_tables), len(on_figures))
        top, bottom = page["y0"], page["y1"]
        for i in sorted(on_tables[paired:] + on_figures[paired:]):
            if number[i] in apart:
                continue
            free = [j for j in range(len(table)) if number[j] is None and table[j] == number[i].startswith("T:") and j != i]
            if free:
                j = min(free, key=lambda j: (max(top[j] - bottom[i], top[i] - bottom[j], 0.0), j))
                number[j], desc[j], number[i] = number[i], desc[i], None
                desc[i] = f"{page['block_type'][i]} on page {page['page_idx'][i] + 1}"
        return page | {"caption_number": np.array(number, dtype=object), "desc": np.array(desc, dtype=object)}

    return _pages(blocks.select(*columns), ["pos"], work, RAW_BLOCK)


def figures(blocks: DataFrame) -> DataFrame:
    """Blocks with one caption number on a page as one figure: union of boxes, number of parts. Blocks without a number stay alone."""
    key = F.coalesce("caption_number", F.concat(F.lit("pos:"), F.col("pos").cast("string")))
    return blocks.groupBy(*PAGE, key.alias("figure")).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("parts"), F.first("caption_number", ignorenulls=True).alias("caption_number"))


def panels(blocks: DataFrame, bucket: float = 20.0) -> DataFrame:
    """Letters of the parts of a figure, row by row: rows are 20 points high, parts of a row go from left to right."""
    order = Window.partitionBy(*PAGE, "caption_number").orderBy(F.round(F.col("y0") / bucket), "x0", "pos")
    n = F.row_number().over(order)
    letter = F.when(n <= 26, F.substring(F.lit(LETTERS), n, F.lit(1)))
    return blocks.where("caption_number is not null").select(*PAGE, "pos", "caption_number", letter.alias("panel"))


def absorb_titles(figs: DataFrame, titles: DataFrame, overlap: float = 0.85, gap: float = 30.0) -> DataFrame:
    """Figures extended upwards by the nearest title (x0, y0, x1, y1) above them that overlaps them enough in width."""
    t = titles.select(*PAGE, *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")])
    near = figs.select(*PAGE, "figure", "x0", "y0", "x1", "y1").join(t, PAGE)
    apart = F.col("y0") - F.col("t_y1")
    near = near.where((apart >= 0) & (apart <= gap) & (g.horizontal_overlap(Box.of(), Box.of("t_")) >= overlap))
    best = near.groupBy(*PAGE, "figure").agg(F.min_by(F.struct("t_x0", "t_y0", "t_x1"), F.struct(apart.alias("gap"), "t_x0")).alias("t"))
    out = figs.join(best, [*PAGE, "figure"], "left")
    pick = lambda f, c: F.coalesce(f(c, f"t.t_{c}"), c).alias(c)
    return out.select(*PAGE, "figure", pick(F.least, "x0"), pick(F.least, "y0"), pick(F.greatest, "x1"), "y1", "parts", "caption_number")


def distinct_boxes(candidates: DataFrame, score: str = "score", most: float = 0.5) -> DataFrame:
    """Candidates that overlap no better one of their page by more than `most`, greedily by score; ties by pos."""

    def keep(page: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        box = list(zip(*(page[c].tolist() for c in ("x0", "y0", "x1", "y1"))))
        kept: list[int] = []
        for i in sorted(range(len(box)), key=lambda i: (-page[score][i], page["pos"][i])):
            a = box[i]
            for j in kept:
                b = box[j]
                both = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
                whole = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
                if whole > 0 and both / whole > most:
                    break
            else:
                kept.append(i)
        return {c: v[kept] for c, v in page.items()}

    return _pages(candidates, ["pos"], keep, candidates.schema)


def missing_numbers(figs: DataFrame) -> DataFrame:
    """Per paper and kind the numbers from 1 to the greatest that no figure has: (paper_id, kind, number)."""
    plain = figs.where(F.col("caption_number").rlike("^[FT]:[0-9]+$")).select("paper_id", F.substring("caption_number", 1, 1).alias("kind"), F.substring("caption_number", 3, 9).cast("int").alias("number"))
    have = plain.groupBy("paper_id", "kind").agg(F.max("number").alias("top"), F.collect_set("number").alias("have"))
    return have.select("paper_id", "kind", F.explode(F.array_except(F.sequence(F.lit(1), "top"), "have")).alias("number"))


def validate(figs: DataFrame, known: DataFrame) -> DataFrame:
    """What is wrong with extracted figures(paper_id, page_idx, figure, box, caption_number): (paper_id, error, detail).

    known(paper_id, caption_number): what the layout names. Errors: `duplicate` (a number on several pages), `absent` (named, not extracted), `unknown`
    (extracted, not named), `gap` (a number between others that is named nowhere extracted), `overlap` (two figures of a page cover each other by half).
    """
    numbered = figs.where("caption_number is not null")
    twice = numbered.groupBy("paper_id", "caption_number").agg(F.count("*").alias("n")).where("n > 1").select("paper_id", F.lit("duplicate").alias("error"), F.col("caption_number").alias("detail"))
    have = numbered.select("paper_id", "caption_number").distinct()
    named = known.select("paper_id", "caption_number").where("caption_number is not null").distinct()
    absent = named.join(have, ["paper_id", "caption_number"], "left_anti").select("paper_id", F.lit("absent").alias("error"), F.col("caption_number").alias("detail"))
    unknown = have.join(named, ["paper_id", "caption_number"], "left_anti").select("paper_id", F.lit("unknown").alias("error"), F.col("caption_number").alias("detail"))
    holes = missing_numbers(numbered).select("paper_id", F.concat_ws(":", "kind", F.col("number").cast("string")).alias("caption_number")).join(named, ["paper_id", "caption_number"], "left_semi").select("paper_id", F.lit("gap").alias("error"), F.col("caption_number").alias("detail"))
    place = figs.withColumn("pos", F.row_number().over(Window.partitionBy(*PAGE).orderBy("figure")))
    both = overlaps(place).where("a_covered > 0.5 or b_covered > 0.5").select("paper_id", F.lit("overlap").alias("error"), F.concat_ws("-", F.col("a").cast("string"), F.col("b").cast("string")).alias("detail"))
    return twice.unionByName(absent).unionByName(unknown).unionByName(holes).unionByName(both)


def mismatched(blocks: DataFrame) -> DataFrame:
    """Blocks whose caption is of another kind than they are."""
    return blocks.where(caption_mismatch(F.col("caption_number"), F.col("block_type")))


def match_boxes(a: DataFrame, b: DataFrame, least: float = 0.8) -> DataFrame:
    """For each block of `a` the first block of `b` of its page and a like kind that it covers, and that covers it, by `least`: (paper_id, page_idx, pos, other)."""
    left = a.select(*PAGE, "pos", "block_type", "x0", "y0", "x1", "y1")
    right = b.select(*PAGE, F.col("pos").alias("other"), F.col("block_type").alias("other_type"), *[F.col(c).alias(f"o_{c}") for c in ("x0", "y0", "x1", "y1")])
    p, q = Box.of(), Box.of("o_")
    ok = (g.overlap_ratio(p, q) >= least) & (g.overlap_ratio(q, p) >= least) & same_block_type(F.col("block_type"), F.col("other_type"))
    return left.join(right, PAGE).where(ok).groupBy(*PAGE, "pos").agg(F.min("other").alias("other"))


def crops(figs: DataFrame, adjustments: DataFrame, keep_caption: bool = False) -> DataFrame:
    """Boxes to cut out: with the caption or the body alone, moved by the adjustments(paper_id, name, left, top, right, bottom) of their names.

    figs has box columns and body_ ones; an empty body counts as the whole.
    """
    body = Box.of("body_")
    use = F.lit(keep_caption) | (body.area <= 0) | body.x0.isNull()
    base = Box(*(F.when(use, F.col(c)).otherwise(F.col(f"body_{c}")) for c in ("x0", "y0", "x1", "y1")))
    joined = figs.join(adjustments, ["paper_id", "name"], "left")
    box = g.adjust(base, F.col("left"), F.col("top"), F.col("right"), F.col("bottom"))
    return joined.select("paper_id", "name", "page_idx", box.x0.alias("cx0"), box.y0.alias("cy0"), box.x1.alias("cx1"), box.y1.alias("cy1"))


def overlay(figs: DataFrame, pages: DataFrame) -> DataFrame:
    """One row for every page of pages(paper_id, n_pages), with the figures on it in order, empty pages too."""
    grid = pages.select("paper_id", F.explode(F.sequence(F.lit(0), F.col("n_pages") - 1)).alias("page_idx"))
    found = figs.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("y0", "x0", "figure"))).alias("f")).select(*PAGE, F.transform("f", lambda x: x["figure"]).alias("figures"))
    return grid.join(found, PAGE, "left").select(*PAGE, F.coalesce("figures", F.array().cast("array<string>")).alias("figures"))


def caption_candidates(bodies: DataFrame, lines: DataFrame, k: int = 10, reach: float = 200.0) -> DataFrame:
    """The k lines of a page most likely to be the caption of each body(pos): (paper_id, page_idx, pos, text, score, rank)."""
    t = lines.select(*PAGE, "text", *[F.col(c).alias(f"t_{c}") for c in ("x0", "y0", "x1", "y1")])
    both = bodies.select(*PAGE, "pos", "x0", "y0", "x1", "y1").join(t, PAGE)
    a, b = Box.of(), Box.of("t_")
    gap = g.gaps(a, b)[0]
    keyword = F.when(F.col("text").rlike("(?i)^\\s*(?:figure|fig\\.?|table|tbl\\.?)\\s*[0-9A-Z]"), 1.0).otherwise(0.0)
    scored = both.where(gap <= reach).withColumn("score", F.round(g.caption_score(keyword, gap, g.horizontal_overlap(a, b)), 6))
    order = Window.partitionBy(*PAGE, "pos").orderBy(F.desc("score"), "t_y0", "t_x0")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select(*PAGE, "pos", "text", "score", "rank")
