"""Broken prompt and response pairs: empty, truncated, refusing, copying, or in another language.

Copies are found by aligning the tokens of answer and prompt: shingles of the answer that the prompt contains cover its tokens, and
the longest common subsequence tells how much of the prompt comes back. Refusals are found by aligning every sentence with templates
of refusals (see `refusals`).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlens.llm.endings import CUT, OPEN, ending
from paperlens.llm.refusals import is_refusal
from paperlens.llm.words import language, tokens

# What stands in place of an answer.
PLACEHOLDERS = "null none nil nan n/a na tbd todo undefined empty placeholder answer reply response antwort réponse reponse respuesta 回复 回答 答复 答案 无 暂无"
_PLACEHOLDERS = frozenset(PLACEHOLDERS.split())
_LONGEST = max(map(len, _PLACEHOLDERS))
_AROUND = "*_`#>:：[](){}<>\"' \t\r\n　"
_MARKUP = re.compile(r"<[^<>]*>|&\w+;|[​-‏⁠﻿]")

_WORD = re.compile(r"[^\W_]")

# What asks for another language, or to delete something.
ASKED = {
    "en": r"\b(?:in|into|to) english\b|英文|英语|auf englisch|ins englische|en anglais|en inglés|al inglés",
    "zh": r"\b(?:in|into|to) chinese\b|中文|汉语|auf chinesisch|ins chinesische|en chinois|en chino|al chino",
    "de": r"\b(?:in|into|to) german\b|德文|德语|auf deutsch|ins deutsche|en allemand|en alemán|al alemán",
    "fr": r"\b(?:in|into|to) french\b|法文|法语|auf französisch|ins französische|en français|en francés|al francés",
    "es": r"\b(?:in|into|to) spanish\b|西班牙文|西班牙语|auf spanisch|ins spanische|en espagnol|en español|al español",
    "it": r"\b(?:in|into|to) italian\b|意大利语|auf italienisch|en italien|en italiano|al italiano|in italiano",
    "pt": r"\b(?:in|into|to) portuguese\b|葡萄牙语|auf portugiesisch|en portugais|en portugués|al portugués|em português",
    "nl": r"\b(?:in|into|to) dutch\b|荷兰语|auf niederländisch|en néerlandais|en neerlandés|in het nederlands",
    "ja": r"\b(?:in|into|to) japanese\b|日语|日文|auf japanisch|en japonais|en japonés|日本語で",
    "ko": r"\b(?:in|into|to) korean\b|韩语|韩文|auf koreanisch|en coréen|en coreano|한국어로",
    "ru": r"\b(?:in|into|to) russian\b|俄语|俄文|auf russisch|en russe|en ruso|по-русски",
}
_ASKED = {k: re.compile(v, re.I) for k, v in ASKED.items()}
DELETE = re.compile(
    r"\b(?:delete|remove|erase|take out|get rid of|(?:drop|strike|cut) (?:this|that|the|it)\b)|删|去掉(?:吧|这|该|它)|去掉$|移除|\b(?:lösch|streich|entfern)\w*|\b(?:supprim|enlèv|enlev|effac)\w*|\b(?:elimin(?:a|ar|e|en)|borra\w*|borre\w*|quita\w*|suprim\w*)\b",
    re.I,
)
# Words that lead in what is given back.
LEAD_IN = frozenset("you ask asked asking question re regarding about your sie fragen fragten frage zur zu betreff vous demandez demandiez question votre à propos usted pregunta preguntas sobre su 关 于 问 题 您 你 的 原 文 引 用 agent q a the user said says here is text".split())


def is_empty(text: str | None) -> bool:
    """Null, or nothing but blanks, punctuation, markup or a placeholder."""
    if text is None:
        return True
    bare = _MARKUP.sub(" ", text)
    core = bare.strip(_AROUND)
    return len(core) <= _LONGEST and core.casefold() in _PLACEHOLDERS or not _WORD.search(bare)


def asked_for(language_: str, comment: str) -> bool:
    """Whether a comment asks for an answer in that language."""
    return language_ in _ASKED and _ASKED[language_].search(comment) is not None


def _lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel columns."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, row = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        hit = places.get(y, 0)
        kept = row & hit
        row = ((row + kept) | (row - kept)) & full
    return len(a) - row.bit_count()


def is_copy(answer: str, prompt: str, back: float = 0.8, own: int = 2, n: int = 3) -> bool:
    """Whether the answer gives back the prompt and at most `own` tokens of its own besides lead-ins."""
    p = [t for t in tokens(prompt) if t != "agent"]
    if not p:
        return False
    a = tokens(answer)
    words, foreign = set(p), 0
    for t in a:  # most answers have many words of their own
        if t not in words and t not in LEAD_IN:
            foreign += 1
            if foreign > own:
                return False
    if not a:
        return False
    n = min(n, len(p))
    known = {tuple(p[i : i + n]) for i in range(len(p) - n + 1)}
    covered = bytearray(len(a))
    for i in range(len(a) - n + 1):
        if tuple(a[i : i + n]) in known:
            covered[i : i + n] = b"\1" * n
    left = sum(1 for t, c in zip(a, covered) if not c and t not in LEAD_IN)
    return left <= own and _lcs(p, a) >= back * len(p)


def defect(answer: str | None, comment: str | None, old: str | None, new_text: bool, speech: bool = True) -> tuple[str, str, str, str]:
    """(defect, kind of last line, closing word, defect if it isn't cut).

    The defect is `open` where the closing word must tell whether the answer is cut; then the last item holds if it is not.
    Without `speech` languages aren't compared.
    """
    comment, old = comment or "", old or ""
    if is_empty(answer):
        return ("" if DELETE.search(comment) else "empty"), "", "", ""
    if is_copy(answer, comment) or new_text and is_copy(answer, old, 0.95, own=0):
        return "copy", "", "", ""
    if is_refusal(answer):
        return "refusal", "", "", ""
    verdict, kind, word = ending(answer)
    if verdict == CUT:
        return "truncated", kind, word, ""
    other = ""
    if speech:
        said, meant = language(answer), language(old if new_text else comment, short=True)
        if said and meant and said != meant and not asked_for(said, comment):
            other = "language"
    return ("open", kind, word, other) if verdict == OPEN else (other, kind, word, "")


def judge(df: DataFrame, key: str, answers: dict[str, tuple[Column, bool]], comment: Column, old: Column, speech: bool = True) -> DataFrame:
    """Rows (key, answer, defect, kind, word, other) of every answer with a defect, or with an open end.

    answers: name -> (column, whether it is a rewriting of `old`). Nulls are empty answers; null prompts count as empty texts.
    """
    names, news = list(answers), {name: new for name, (_, new) in answers.items()}
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            prompt, before = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, name in enumerate(names):
                texts, asked = batch.column(3 + 2 * i).to_pylist(), batch.column(4 + 2 * i).to_pylist()
                new = news[name]
                rows = [(j, *defect(t, c, o, new, speech)) for j, (t, c, o, want) in enumerate(zip(texts, prompt, before, asked)) if want]
                rows = [r for r in rows if r[1]]
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [keys.take(at), pa.array([name] * len(rows), pa.string()), *[pa.array([r[k] for r in rows], pa.string()) for k in (1, 2, 3, 4)]],
                    [key, "answer", "defect", "kind", "word", "other"],
                )

    columns = [comment, old]
    for column, new in answers.values():
        columns += [column, (F.length(old) > 0) if new else F.lit(True)]
    flat = df.select(key, *[c.alias(f"_c{i}") for i, c in enumerate(columns)])
    return flat.mapInArrow(run, f"`{key}` {kind}, answer string, defect string, kind string, word string, other string")
