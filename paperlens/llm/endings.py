"""How a text ends: at its end, before it, or undecided."""

from __future__ import annotations

import re

# Characters that end a sentence, and those that may follow them.
STOPS = ".。!！?？"
CLOSERS = "\"'”’」』)）]】»*_"
PAIRS = {"(": ")", "（": "）", "「": "」", "『": "』", "“": "”", "[": "]", "【": "】"}
# Marks that a cut leaves behind.
CUT_MARK = re.compile(r"(?:\.\.\.|…|�|[\[(<](?:cut|truncated|snip|continued|more)[\])>])\s*$", re.I)
LABEL = re.compile(r"[-+]?\d+(?:[.,]\d+)?\s*%?|[^\W\d_]{2,12}\.? \d+(?:\.\d+)?[a-z]?|[^\W\d_]{1,3} ?\d+(?:\.\d+)?")
LIST = re.compile(r"\s*(?:[-*+•]|\d+[.)])\s+")

ENDS, CUT, OPEN = "ends", "cut", "open"


_NUMBER_END = re.compile(r"\d[\d.,]*$")
_WORD_END = re.compile(r"[^\W\d_][\w’'-]*$")
_RUNS = re.compile(r"[㐀-鿿]+|\d[\d.,]*|[^\W\d_][\w’'-]*")


def last_word(line: str) -> str:
    """The closing word of a line: a Latin word, a number as #, or the last two Chinese characters; other characters as they are."""
    line = line.rstrip()
    if "㐀" <= line[-1:] <= "鿿":
        return line[-2:] if "㐀" <= line[-2:-1] <= "鿿" else line[-1:]
    end = line.rsplit(None, 1)[-1] if line else ""  # neither a number nor a word has a blank in it
    if _NUMBER_END.search(end):
        return "#"
    if m := _WORD_END.search(end):
        return m.group().casefold()
    return line[-1:]


def line_words(line: str) -> list[str]:
    """All words that could close a line, in the form of `last_word`."""
    out = []
    for w in _RUNS.findall(line.casefold()):
        if "㐀" <= w[0] <= "鿿":
            out.extend(map(str.__add__, w, w[1:]))
        else:
            out.append("#" if w[0].isdigit() else w)
    return out


def _unclosed(line: str) -> bool:
    stack = []
    for ch in line:
        if ch in PAIRS:
            stack.append(PAIRS[ch])
        elif stack and ch == stack[-1]:
            stack.pop()
    return bool(stack) or line.count("`") % 2 == 1


def ending(text: str) -> tuple[str, str, str]:
    """(verdict, kind of the last line, its closing word). Verdicts: `ends`, `cut`, or `open` where the closing word must tell."""
    body = text.rstrip()
    if not body:
        return ENDS, "none", ""
    if CUT_MARK.search(body):
        # a full sentence before three dots is a pause of the writer, unless it is a mark in brackets
        bare = CUT_MARK.sub("", body).rstrip()
        if bare:
            return CUT, "mark", ""
    if body.count("```") % 2:
        return CUT, "code", ""
    line = body.rsplit("\n", 1)[-1]
    strip = line.strip()
    if strip.startswith("```"):
        return ENDS, "code", ""
    if body.count("$$") % 2:
        return CUT, "math", ""
    if strip.startswith("$$") or strip.endswith("$"):
        return (ENDS if re.fullmatch(r".*\$\$[^$]+\$\$|[^$]*(?:\$[^$]+\$[^$]*)*", strip) else CUT), "math", ""
    if strip.startswith("|"):
        rows = [x.strip() for x in body.rsplit("\n\n", 1)[-1].split("\n") if x.strip().startswith("|")]
        whole = strip.endswith("|") and len(rows) >= 3 and strip.count("|") == rows[0].count("|")
        return (ENDS if whole else CUT), "table", ""
    if strip.startswith("#"):
        return CUT, "heading", ""
    if strip.startswith("!["):
        return (ENDS if re.fullmatch(r"!\[.*\]\([^()]+\)(?:\{[^}]*\})?", strip) else CUT), "image", ""
    if LIST.match(line):
        item = LIST.sub("", line, count=1)
        if item.count("**") % 2 or _unclosed(item):
            return CUT, "list", ""
        if item[-1:] in STOPS:
            return ENDS, "list", ""
        return OPEN, "list", last_word(item)
    if re.fullmatch(r"\s*(?:<[^>]+>\s*)+", strip):
        return ENDS, "markup", ""
    core = strip.rstrip(CLOSERS)
    if core[-1:] in STOPS and core:
        return ENDS, "text", ""
    if core != strip and not _unclosed(strip):
        # a line that is one quotation or one remark in brackets
        if strip[0] in PAIRS or strip[0] in "\"'*_“«":
            return ENDS, "wrapped", ""
    if _unclosed(strip):
        return CUT, "text", ""
    if "\n" not in body and LABEL.fullmatch(strip):
        return ENDS, "label", ""
    return OPEN, "text", last_word(strip)
