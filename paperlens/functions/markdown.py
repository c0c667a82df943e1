"""Markdown of insights: image references, headings, a renderer of a subset, and the layout of images."""

from __future__ import annotations

import html
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value, a format: `![alt](url =size align)`; size is a number with % or px, and may have a height.
IMAGE = r"!\[([^\]]*)\]\(([^)\s]+)(?:\s*=\s*(\d+(?:\.\d+)?(?:%|px)?)(?:x(\d+(?:\.\d+)?(?:%|px)?))?(?:\s+(left|right|inline|center))?)?\)"
_IMAGE = re.compile(IMAGE)


def images(c: Column) -> Column:
    """All image references in order: array of (full, alt, url, size, align), the last two null where absent."""
    full = F.regexp_extract_all(c, F.lit(IMAGE), 0)

    def part(x: Column, group: int) -> Column:
        return F.nullif(F.regexp_extract(x, IMAGE, group), F.lit(""))

    return F.transform(full, lambda x: F.struct(x.alias("full"), F.regexp_extract(x, IMAGE, 1).alias("alt"), F.regexp_extract(x, IMAGE, 2).alias("url"), part(x, 3).alias("size"), part(x, 5).alias("align")))


def is_formatted(c: Column) -> Column:
    """Whether a local image has a size or an alignment."""
    return F.exists(images(c), lambda i: ~i["url"].rlike("^https?://") & (i["size"].isNotNull() | i["align"].isNotNull()))


def rebuild_image(alt: str, url: str, size: str | None = None, align: str | None = None) -> str:
    return f"![{alt}]({url}{f' ={size}' if size else ''}{f' {align}' if align else ''})"


def decide_layout(width: Column, height: Column, is_table: Column, page_width: Column) -> Column:
    """(size, align) of an image by its share of the page; null for very wide ones."""
    wide = width / F.greatest(height, F.lit(1)) > F.when(is_table, 5.2).otherwise(3.0)
    share = F.when(page_width > 0, F.least(width / page_width, F.lit(1.0))).otherwise(0.4)
    pct = F.greatest(F.lit(50), F.least(F.lit(95), F.round(share * 120).cast("int")))
    return F.when(~wide, F.struct(F.concat(pct.cast("string"), F.lit("%")).alias("size"), F.when(pct <= 50, "right").otherwise("center").alias("align")))


def _decide(width: float, height: float, is_table: bool, page: float) -> tuple[str, str] | None:
    if width / max(height, 1) > (5.2 if is_table else 3.0):
        return None
    share = min(width / page, 1.0) if page > 0 else 0.4
    pct = min(95, max(50, int(share * 120 + 0.5)))
    return f"{pct}%", "right" if pct <= 50 else "center"


def relayout_text(text: str, sizes: dict[str, list[float]], page: float = 3000.0, force: bool = False) -> str:
    """Sizes and alignments for the images whose pixel sizes are known; no two floats to the right in a row."""
    floating = False

    def one(m: re.Match[str]) -> str:
        nonlocal floating
        alt, url, size, _, align = m.groups()
        if not force and (size or align):
            return m.group()
        known = None if url.startswith(("http://", "https://")) else sizes.get(url)
        table = url.startswith("table/") or "/table" in url.lower() or "_table" in url.lower() or "table" in alt.lower() or "表格" in alt
        made = _decide(known[0], known[1], table, page) if known else None
        if made is None:
            floating = False
            return m.group()
        place = "center" if made[1] == "right" and floating else made[1]
        floating = place == "right"
        return rebuild_image(alt, url, made[0], place)

    return _IMAGE.sub(one, text)


@F.pandas_udf(T.StringType())
def relayout(text: pd.Series, sizes: pd.Series) -> pd.Series:
    """`relayout_text` with sizes as a JSON object {url: [width, height]}."""
    return pd.Series([None if t is None else relayout_text(t, json.loads(s or "{}")) for t, s in zip(text, sizes)], dtype=object)


def headings(c: Column) -> Column:
    """The headings of a text, outside code, with hierarchical numbers below the first level: array of (level, text, num)."""
    bare = F.regexp_replace(c, "(?s)```.*?(?:```|$)", "")
    found = F.regexp_extract_all(bare, F.lit("(?m)^(#{1,6}[ \\t]+[^\\n]+?)[ \\t]*#*[ \\t]*$"), 1)
    rows = F.transform(found, lambda h: F.struct(F.length(F.regexp_extract(h, "^#+", 0)).alias("level"), F.regexp_replace(h, "^#+[ \\t]+", "").alias("text")))
    zero = F.struct(F.array_repeat(F.lit(0), 6).alias("n"), F.array().cast("array<struct<level:int,text:string,num:string>>").alias("out"))

    def step(acc: Column, h: Column) -> Column:
        counts = F.transform(acc["n"], lambda v, i: F.when(i + 1 < h["level"], v).when(i + 1 == h["level"], v + 1).otherwise(0))
        shown = F.filter(F.slice(counts, 1, h["level"]), lambda v: v > 0)
        return F.struct(counts.alias("n"), F.concat(acc["out"], F.array(F.struct(h["level"].alias("level"), h["text"].alias("text"), F.array_join(shown.cast("array<string>"), ".").alias("num")))).alias("out"))

    return F.aggregate(rows, zero, step, lambda acc: acc["out"])


# the renderer
_INLINE_CODE = re.compile(r"`([^`\n]+)`")
_MATH = re.compile(r"\$\$(.+?)\$\$|(?<![\\$\d])\$(?![\s\d])([^$\n]+?)(?<!\s)\$(?!\d)", re.S)
_LINK = re.compile(r"\[([^\]]+)\]\(([^)\s]+)\)")
_AUTO = re.compile(r"(?<![\"'>=])(https?://[^\s<>\"'）】」，。；、]+)")
_SAFE = re.compile(r"^(?:https?:|mailto:|/|#|\.|[\w./-]+$)", re.I)


def _inline(text: str) -> str:
    kept: list[str] = []

    def keep(piece: str) -> str:
        kept.append(piece)
        return f"\0{len(kept) - 1}\0"

    text = _INLINE_CODE.sub(lambda m: keep(f"<code>{html.escape(m.group(1), quote=False)}</code>"), text)
    text = _MATH.sub(lambda m: keep(f'<span class="math">\\[{html.escape(m.group(1), quote=False)}\\]</span>' if m.group(1) is not None else f'<span class="math">\\({html.escape(m.group(2), quote=False)}\\)</span>'), text)

    def image(m: re.Match[str]) -> str:
        alt, url, size, _, align = m.groups()
        style = (f"width:{size};" if size else "") + {"left": "float:left;", "right": "float:right;", "center": "display:block;margin:auto;"}.get(align or "", "")
        return keep(f'<img src="{html.escape(url)}" alt="{html.escape(alt)}"' + (f' style="{style}"' if style else "") + ">") if _SAFE.match(url) else html.escape(alt)

    text = _IMAGE.sub(image, text)
    text = _LINK.sub(lambda m: keep(f'<a href="{html.escape(m.group(2))}">{_inline(m.group(1))}</a>') if _SAFE.match(m.group(2)) else m.group(1), text)
    text = _AUTO.sub(lambda m: keep(f'<a href="{html.escape(m.group(1))}">{html.escape(m.group(1))}</a>'), text)
    text = html.escape(text, quote=False)
    text = re.sub(r"\*\*(?=\S)(.+?)(?<=\S)\*\*", r"<strong>\1</strong>", text)
    text = re.sub(r"(?<![*\w])\*(?=[^\s*])(.+?)(?<=[^\s*])\*(?![*\w])", r"<em>\1</em>", text)
    while "\0" in text:
        text = re.sub("\0(\\d+)\0", lambda m: kept[int(m.group(1))], text)
    return text


def _table(lines: list[str]) -> str:
    cells = [[c.strip() for c in line.strip().strip("|").split("|")] for line in lines]
    head = "".join(f"<th>{_inline(c)}</th>" for c in cells[0])
    body = "".join("<tr>" + "".join(f"<td>{_inline(c)}</td>" for c in row) + "</tr>" for row in cells[2:])
    return f'<div class="table"><table><thead><tr>{head}</tr></thead><tbody>{body}</tbody></table></div>'


def render_html(text: str) -> tuple[str, list[tuple[str, int, str, str]]]:
    """HTML and table of contents (id, level, text, number). Headings, paragraphs, quotations, lists, tables, code, images, links, emphasis
    and formulas are known; any other markup is shown as text."""
    out: list[str] = []
    toc: list[tuple[str, int, str, str]] = []
    counts = [0] * 6
    lines = text.replace("\r\n", "\n").split("\n")
    i = 0
    while i < len(lines):
        line = lines[i]
        if m := re.match(r"\s*```\s*(\w*)", line):
            j = i + 1
            while j < len(lines) and not lines[j].lstrip().startswith("```"):
                j += 1
            body = html.escape("\n".join(lines[i + 1 : j]), quote=False)
            out.append(f'<pre><code class="language-{m.group(1)}">{body}</code></pre>' if m.group(1) else f"<pre><code>{body}</code></pre>")
            i = j + 1
        elif m := re.match(r"(#{1,6})\s+(.+?)\s*#*\s*$", line):
            level = len(m.group(1))
            counts[level - 1] += 1
            counts[level:] = [0] * (6 - level)
            num = ".".join(str(n) for n in counts[:level] if n)
            toc.append((f"h-{len(toc) + 1}", level, m.group(2), num))
            out.append(f'<h{level} id="h-{len(toc)}">{num} {_inline(m.group(2))}</h{level}>')
            i += 1
        elif "|" in line and i + 1 < len(lines) and re.match(r"\s*\|?[\s:|-]+\|[\s:|-]*$", lines[i + 1]):
            j = i
            while j < len(lines) and "|" in lines[j]:
                j += 1
            out.append(_table(lines[i:j]))
            i = j
        elif m := re.match(r"\s*(?:[-*+]|(\d+)[.)])\s+", line):
            kind, items, j = ("ol" if m.group(1) else "ul"), [], i
            while j < len(lines) and (n := re.match(r"\s*(?:[-*+]|\d+[.)])\s+(.*)", lines[j])):
                items.append(f"<li>{_inline(n.group(1))}</li>")
                j += 1
            out.append(f"<{kind}>{''.join(items)}</{kind}>")
            i = j
        elif line.startswith(">"):
            j = i
            while j < len(lines) and lines[j].startswith(">"):
                j += 1
            out.append(f"<blockquote><p>{_inline(' '.join(x.lstrip('> ') for x in lines[i:j]))}</p></blockquote>")
            i = j
        elif not line.strip():
            i += 1
        else:
            j = i
            while j < len(lines) and lines[j].strip() and not re.match(r"\s*```|#{1,6}\s|>", lines[j]) and not (j > i and re.match(r"\s*[-*+]\s|\s*\|", lines[j])):
                j += 1
            out.append(f"<p>{_inline(chr(10).join(lines[i:max(j, i + 1)]))}</p>")
            i = max(j, i + 1)
    return "\n".join(out), toc


_TOC = T.ArrayType(T.StructType().add("id", "string").add("level", "integer").add("text", "string").add("num", "string"))


@F.pandas_udf(T.StructType().add("html", "string").add("toc", _TOC))
def render(text: pd.Series) -> pd.DataFrame:
    """`render_html` of each text; null for null."""
    rows = [(None, None) if t is None else render_html(t) for t in text]
    return pd.DataFrame({"html": [r[0] for r in rows], "toc": [None if r[1] is None else [dict(zip(("id", "level", "text", "num"), x)) for x in r[1]] for r in rows]})


def find_text(text: str, quote: str) -> list[int]:
    """Where a quotation lies in a text: everywhere as it is, else everywhere with any blanks in place of its own."""
    if not quote.strip():
        return []
    exact = [m.start() for m in re.finditer(re.escape(quote), text)]
    return exact or [m.start() for m in re.finditer(r"\s+".join(map(re.escape, quote.split())), text)]


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def quote_places(text: pd.Series, quote: pd.Series) -> pd.Series:
    """`find_text` of each pair; an empty list where either is null."""
    return pd.Series([find_text(t, q) if t and q else [] for t, q in zip(text, quote)])


@F.pandas_udf(T.StructType().add("status", "string").add("text", "string"))
def apply_edit(text: pd.Series, old: pd.Series, new: pd.Series) -> pd.DataFrame:
    """Replace `old` by `new` where it lies in just one place: status applied, missing or ambiguous."""
    rows = []
    for t, o, n in zip(text, old, new):
        at = find_text(t, o) if t and o else []
        if len(at) == 1:
            size = re.match(r"\s+".join(map(re.escape, o.split())), t[at[0] :])
            end = at[0] + (len(o) if t.startswith(o, at[0]) else size.end())
            rows.append(("applied", t[: at[0]] + (n or "") + t[end:]))
        else:
            rows.append(("missing" if not at else "ambiguous", t))
    return pd.DataFrame(rows, columns=["status", "text"])
