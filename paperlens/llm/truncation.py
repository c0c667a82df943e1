"""Text cut off before its end.

A near-copy that is longer tells best: both are aligned at the end of the shorter, and if the longer goes on there in the midst of
a sentence, the shorter is cut, whatever its ending looks like (as in `by 47.` for `by 47.78 points.`). Where the two end alike, what
is known of the one holds for the other.

Every other text is judged by its ending. Structures left open (code, formulas, tables, links, brackets) and marks of a cut show in the
ending itself. A text that merely stops is scored by the terminality of its closing word: how much oftener that word closes complete
sentences and lines than it stands anywhere in them, over all texts. How much oftener it must be depends on how many such texts are
whole at all, which is estimated from all of them at once.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperlens.llm.endings import LIST, OPEN, STOPS, ending, last_word, line_words
from paperlens.llm.nearcopy import compare_copies, containment
from paperlens.operators.components import components
from paperlens.session import materialize

SIMILAR = 0.8
TAIL, SAME = 40, 3
_PROSE = re.compile(r"\s*(?:#|\||```|\$\$|!\[|<)")
_PARTS = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
_SHUT = "\"'”’」』)）]】»*_ " + STOPS


class Tally:
    """Words of some texts, by kind of line: how often each stands there, and how often it closes a complete line or sentence."""

    def __init__(self) -> None:
        self.ends: dict[str, Counter[str]] = {"list": Counter(), "text": Counter()}
        self.total: dict[str, Counter[str]] = {"list": Counter(), "text": Counter()}

    def add(self, text: str) -> None:
        lines = text.rstrip().split("\n")
        prose: list[str] = []
        code = False
        for number, line in enumerate(lines):
            if line.lstrip().startswith("```"):
                code = not code
            if code or not line or _PROSE.match(line):
                continue
            whole = number < len(lines) - 1  # a line is complete if another follows it
            if LIST.match(line):
                item = LIST.sub("", line, count=1)
                words = line_words(item)
                self.total["list"].update(words if whole else words[:-1])
                if whole:
                    self._close("list", item, words)
                continue
            parts = _PARTS.split(line)
            if not whole:
                # the word where a text stops is the one in question: it is evidence of nothing
                self.total["text"].update(line_words(parts.pop())[:-1])
            prose.extend(parts)
            for part in parts:
                self._close("text", part, None)
        if prose:
            self.total["text"].update(line_words("\n".join(prose)))

    def _close(self, kind: str, part: str, words: list[str] | None) -> None:
        last = last_word(part.rstrip(_SHUT))
        if last:
            self.ends[kind][last] += 1
            if words is not None:
                self.total[kind][last] += last not in words[-1:]


def terminality(texts: DataFrame, text: str = "text") -> DataFrame:
    """Of every word in list lines and in other lines: rows (kind, word, ends, total), where `ends` counts complete lines and sentences
    that it closes, with or without a stop. Null and empty texts count for nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally = Tally()
            for value in batch.column(0).to_pylist():
                if value:
                    tally.add(value)
            for kind, total in tally.total.items():
                ends = tally.ends[kind]
                total.update({w: 0 for w in ends})  # a closing sign that is no word stands where it closes
                words = list(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(words), pa.string()), pa.array(words, pa.string()), pa.array([ends[w] for w in words], pa.int64()), pa.array([max(total[w], ends[w]) for w in words], pa.int64())],
                    ["kind", "word", "ends", "total"],
                )

    return texts.select(text).mapInArrow(run, "kind string, word string, ends long, total long").groupBy("kind", "word").agg(F.sum("ends").alias("ends"), F.sum("total").alias("total"))


def _whole_share(scores: list[tuple[float | None, int]]) -> float:
    """The share of whole texts among texts with these scores (log ratio, number; None: the word closes nothing), by likelihood."""
    n, share = sum(k for _, k in scores), 0.5
    for _ in range(200):
        now = (1 + sum(k * share / (share + (1 - share) * math.exp(-s)) for s, k in scores if s is not None)) / (n + 2)
        if abs(now - share) < 1e-6:
            break
        share = now
    return share


def settle(rows: DataFrame, words: DataFrame) -> DataFrame:
    """Adds `cut` to rows with an open end (kind, word).

    The score of a word is the logarithm of how much oftener it closes than it stands anywhere; a word that closes nothing speaks for a cut.
    With the share of whole texts among all open ones of its kind, estimated from the scores of all, a text is cut where that is likelier.
    """
    words = materialize(words)
    sums = words.groupBy("kind").agg(F.sum("ends").alias("all_ends"), F.sum("total").alias("all_total"))  # one row a kind
    score = F.when(F.col("ends") > 0, F.log(F.col("ends") / (F.col("total") + 1)) - F.log(F.col("all_ends") / F.col("all_total")))
    rated = materialize(rows.join(words, ["kind", "word"], "left").join(sums, "kind", "left").withColumn("score", score).drop("ends", "total", "all_ends", "all_total"))
    # a histogram of scores in tenths, so its size is bounded by their range
    histogram: dict[str, list[tuple[float | None, int]]] = {}
    for kind, at, n in rated.groupBy("kind", F.round("score", 1)).count().collect():
        histogram.setdefault(kind, []).append((at, n))
    odds = F.lit(0.0)
    for kind, scores in histogram.items():
        share = _whole_share(scores)
        odds = F.when(F.col("kind") == kind, F.lit(math.log(share / (1 - share)))).otherwise(odds)
    return rated.withColumn("cut", F.coalesce(F.col("score") + odds < 0, F.lit(True))).drop("score")


def _ends(tail: str, text: str, most: int) -> list[tuple[int, int]]:
    """(distance, end) of every place of the text where the tail ends with at most `most` edits, by bit-parallel columns."""
    places: dict[str, int] = {}
    for i, x in enumerate(tail):
        places[x] = places.get(x, 0) | 1 << i
    full, high, distance, out = (1 << len(tail)) - 1, 1 << len(tail) - 1, len(tail), []
    more, less = full, 0
    for end, x in enumerate(text, 1):
        hit = places.get(x, 0)
        down, along = hit | less, (((hit & more) + more) ^ more) | hit
        up, back = (less | ~(along | more)) & full, more & along
        distance += bool(up & high) - bool(back & high)
        up, back = up << 1, back << 1
        more, less = (back | ~(down | up)) & full, up & down
        if distance <= most:
            out.append((distance, end))
    return out


def aligned(a: str, b: str) -> int:
    """Where the end of `a` lies in `b`, or -1: its last characters aligned with the fewest edits, the very last ones without any.

    Of several such places the one with the longest equal text before it counts, then the one nearest to the length of `a`.
    """
    tail, same = a[-TAIL:], a[-SAME:]
    lo = max(0, len(a) - len(tail) - len(a) // 4)
    ends, at = [], b.find(tail, lo)
    while at >= 0:
        ends.append((0, at + len(tail)))
        at = b.find(tail, at + 1)
    if not ends:
        ends = [(d, lo + end) for d, end in _ends(tail, b[lo:], len(tail) // 4) if b.endswith(same, lo, lo + end)]
    if not ends:
        return -1
    least = min(ends)[0]

    def common(end: int) -> int:
        n, most = 0, min(len(a), end)
        while n < most and a[-1 - n] == b[end - 1 - n]:
            n += 1
        return n

    return max((end for d, end in ends if d == least), key=lambda end: (common(end), -abs(end - len(a))))


def outcome(a: str, b: str, cache: dict[str, int] | None = None) -> str:
    """What a longer text `b` tells of `a`: `cut`, `same` (both end alike) or nothing."""
    a = a.rstrip()
    if containment(a, b, cache) < SIMILAR or (end := aligned(a, b)) < 0:
        return ""
    rest = b[end:]
    if not rest.strip():
        return "same"
    # in the midst of a sentence: a letter or number follows at once what looks like an end, or anything what doesn't
    if len(rest.strip()) > 1 and (rest[:1].isalnum() and not "㐀" <= rest[:1] <= "鿿" or a[-1:].isalnum() and not rest[:1].isspace()):
        return "cut"
    # a text that stops without a stop, where the other goes on in the same line
    if rest[:1] in " \t" and rest.lstrip(" \t")[:1] not in ("\n", "\r") and ending(a)[0] == OPEN:
        return "cut"
    return ""


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache: dict[str, int] = {}
    for batch in batches:
        told = [outcome(a, b, cache) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(told, pa.string())], [batch.schema.names[0], "longer", "outcome"])


def cut_copies(texts: DataFrame, key: str = "id", text: str = "text", group: int = 64) -> DataFrame:
    """Keys of texts that have a longer near-copy which goes on in the midst of a sentence where they end, or that end like such a text.

    Equal texts are judged once. Null texts and texts without words are never cut by this.
    """
    marks = materialize(texts.where(F.col(text).isNotNull()).select(key, F.unhex(F.sha2(text, 256)).alias("digest")))
    one = materialize(marks.groupBy("digest").agg(F.min(key).alias(key)))
    different = texts.join(one.select(key), key, "left_semi").select(key, text)
    long = different.select(F.col(key).alias("longer"), F.col(text).alias("long"))
    kind = texts.schema[key].dataType.simpleString()

    def compare(pairs: DataFrame) -> DataFrame:
        both = pairs.join(different, key).join(long, "longer").select(key, "longer", text, "long")
        return both.mapInArrow(_compare, f"{key} {kind}, longer {kind}, outcome string")

    told = materialize(compare_copies(different, compare, key, text, group).where("outcome <> ''"))
    cut = told.where("outcome = 'cut'").select(key).distinct()
    same = told.where("outcome = 'same'").select(F.col(key).alias("u"), F.col("longer").alias("v"))
    if not cut.isEmpty() and not same.isEmpty():
        parts = materialize(components(same))
        marked = parts.join(cut.select(F.col(key).alias("node")), "node", "left_semi").select("component").distinct()
        cut = cut.unionByName(parts.join(marked, "component", "left_semi").select(F.col("node").alias(key))).distinct()
    return marks.join(one.join(cut, key, "left_semi").select("digest"), "digest", "left_semi").select(key)
