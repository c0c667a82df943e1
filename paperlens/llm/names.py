"""Variant spellings of names typed by people.

Every name is rewritten to canonical forms by rules of case, marks, hyphens, titles, token order, nicknames, initials and legal forms;
names that share a form are linked by an equi-join on it. A form counts by its rarity: where a name has several forms that others
use, those that mean one entity are taken together, and of different ones the rarest wins if it is much rarer than the next; one that
several different people or organisations could be written as (an initial before a common family name, say) links nothing.

A slip of the pen is a rewriting, too: a form with one letter replaced by a wildcard, left out, or swapped with the next. Two words that
both stand beside many different others are two words, not one and a slip of it.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlens.operators.components import components
from paperlens.session import materialize

# Words of legal and other generic forms, each line one word and its spellings.
LEGAL_FORMS = """
laboratory lab labs laboratories
collaboration collab consortium
institute inst institut
centre center ctr
university univ
department dept
company co corp corporation inc incorporated ltd limited llc gmbh ag plc
association assoc
foundation fdn
group grp
team teams
society soc
academy acad
school sch
division div
"""
# Words that are no legal forms but generic beside one, and their spellings.
GENERIC = """
model models modelling modeling
language lang
science sciences sci
system systems sys
robotics robotic
learning
data
research
technology technologies tech
engineering eng
computing
computer
"""
# Abbreviations of generic words, and words without weight.
ABBREVIATIONS = {"lm": "language model", "llm": "language model", "ai": "artificial intelligence", "ml": "machine learning", "nlp": "natural language processing"}
WEIGHTLESS = frozenset("the of for and at in on de la le der die das und fur et y".split())
TITLES = frozenset("dr prof professor mr mrs ms phd md msc bsc jr sr dipl ing".split())

_CANON: dict[str, str] = {}
for _line in (LEGAL_FORMS + GENERIC).strip().split("\n"):
    if _line.strip():
        _first, *_rest = _line.split()
        _CANON |= {w: _first for w in (_first, *_rest)}
_LEGAL = frozenset(line.split()[0] for line in LEGAL_FORMS.strip().split("\n"))
_LONG = sorted((w for w in _CANON if len(w) >= 7), key=lambda w: (len(w), w))
_DASH = re.compile("[‐-―−]")
_TAIL = re.compile(r"[\s]*(?:[†‡*§¶#✉]+|\^?\d+(?:\s*,\s*\d+)*|\((?!collaboration|consortium)[^()]*\))\s*$", re.I)


def fold(text: str) -> str:
    """Lower case, without marks on letters."""
    bare = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return bare.casefold().replace("ß", "ss").replace("ø", "o").replace("ł", "l").replace("đ", "d").replace("æ", "ae").replace("œ", "oe")


def slip(a: str, b: str) -> bool:
    """Whether two different words are one letter put in, left out or replaced apart, or two neighbours swapped."""
    if len(a) == len(b):
        d = [i for i in range(len(a)) if a[i] != b[i]]
        return len(d) == 1 or len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]]
    if abs(len(a) - len(b)) != 1:
        return False
    short, long = sorted((a, b), key=len)
    i = next((i for i in range(len(short)) if short[i] != long[i]), len(short))
    return short[i:] == long[i + 1 :]


def _generic(word: str) -> str | None:
    if word in _CANON:
        return _CANON[word]
    if len(word) >= 7:
        for known in _LONG:
            if abs(len(known) - len(word)) <= 1 and slip(word, known):
                return _CANON[known]
    return None


def pair(a: str, b: str) -> str:
    return "|".join(sorted((a, b)))


def rewrite(name: str) -> tuple[str, str, list[str], str | None, tuple[str, str] | None]:
    """(kind, key, further forms, middle initial, (formal, familiar) where the name tells a nickname).

    kind `pair`: a key of two words whatever their order; `initial`: family name and first initial; `other`: anything else.
    """
    text = unicodedata.normalize("NFKC", name)
    text = _DASH.sub("-", re.sub(r"\s+", " ", text)).strip()
    while (cut := _TAIL.sub("", text)) != text and cut.strip():
        text = cut
    nick = None
    if m := re.search(r"[\"“'‘(]([^\W\d_]{2,})[\"”'’)] ", text):
        if m.start() > 0:
            nick, text = fold(m.group(1)), (text[: m.start()] + text[m.end() :]).strip()
    raw = re.findall(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*", text)
    words = [fold(w).replace("-", "").replace("'", "").replace("’", "") for w in raw]
    if not words:
        return "other", fold(text), [], None, None
    # organisations
    spread = [part for w in words for part in ABBREVIATIONS.get(w, w).split()]
    canon = [_generic(w) for w in spread]
    if any(c in _LEGAL for c in canon):
        core = "".join(w for w, c in zip(spread, canon) if c is None and w not in WEIGHTLESS)
        form = [c for c in canon if c]
        key = pair(core or " ".join(sorted(set(form))), " ".join(sorted(set(form))))
        acronym = "".join(c[0] for c in form)
        return "pair", key, [pair(core, acronym)] if core and len(form) >= 2 else [], None, None
    # people
    keep = [(w, r) for w, r in zip(words, raw) if w not in TITLES or len(words) <= 1]
    if not keep:
        return "other", " ".join(words), [], None, None
    cased = [r for _, r in keep if not r.isupper()]
    plain, initials = [], []
    for w, r in keep:
        if len(w) == 1:
            initials.append(w)
        elif r.isupper() and len(r) == 2 and cased:
            initials.extend(w)
        else:
            plain.append((w, r))
    if len(plain) == 1 and not initials:
        glued = re.split(r"(?<=[^\W\d_A-ZÀ-Þ])(?=[A-ZÀ-Þ][^\W\d_A-ZÀ-Þ])", plain[0][1].replace("-", "\0"))
        if len(glued) == 2:
            plain = [(fold(g).replace("\0", ""), g) for g in glued]
    tokens = [w for w, _ in plain]
    if len(tokens) == 1 and initials:
        return "initial", f"{tokens[0]}|{initials[0]}", [], initials[1] if len(initials) > 1 else None, None
    if len(tokens) == 2:
        told = (tokens[0], nick) if nick else None
        return "pair", pair(*tokens), [pair(nick, tokens[1])] if nick else [], initials[0] if initials else None, told
    if len(tokens) >= 3:
        forms = [pair(tokens[0], "".join(tokens[1:])), pair("".join(tokens[:-1]), tokens[-1])]
        return "other", " ".join(tokens), forms, initials[0] if initials else None, None
    return "other", " ".join(words), [], None, None


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(n, *rewrite(n)) for n in batch.column(0).to_pylist()]
        told = [r[5] or (None, None) for r in rows]
        yield pa.RecordBatch.from_arrays(
            [*[pa.array([r[i] for r in rows], pa.string()) for i in (0, 1, 2)], pa.array([r[3] for r in rows], pa.list_(pa.string())), pa.array([r[4] for r in rows], pa.string()),
             pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.string())],
            ["name", "kind", "key", "forms", "middle", "formal", "familiar"],
        )


def _spelled(form: str) -> str:
    """A form as it travels: very long ones as a digest."""
    return form if len(form) <= 80 else hashlib.blake2b(form.encode(), digest_size=16).hexdigest()


def _slips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forms with one slip in either word: (form, how, exact, key, word). `exact` only for a name as it is typed, not rewritten."""
    for batch in batches:
        form, how, exact, keys, words = [], [], [], [], []
        for key, written, typed in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            x, y = written.split("|")
            for fixed, w in {(x, y), (y, x)}:
                if len(w) < 2:
                    continue
                out = {(_spelled(f"{fixed}|{w}"), "as is")}
                out.update((_spelled(f"{fixed}|{w[:i]}*{w[i + 1:]}"), "other letter") for i in range(len(w)))
                out.update((_spelled(f"{fixed}|{w[:i]}{w[i + 1:]}"), "left out") for i in range(len(w)))
                out.update((_spelled(f"{fixed}|{i}:{w[:i]}{min(w[i:i + 2])}{max(w[i:i + 2])}{w[i + 2:]}"), "swapped") for i in range(len(w) - 1) if w[i] != w[i + 1])
                form.extend(f for f, _ in out), how.extend(h for _, h in out), exact.extend(typed and h == "as is" for _, h in out)
                keys.extend([key] * len(out)), words.extend([w] * len(out))
            if len(form) >= 100_000:
                yield _slip_batch(form, how, exact, keys, words)
                form, how, exact, keys, words = [], [], [], [], []
        yield _slip_batch(form, how, exact, keys, words)


def _slip_batch(form: list[str], how: list[str], exact: list[bool], keys: list[str], words: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(form, pa.string()), pa.array(how, pa.string()), pa.array(exact, pa.bool_()), pa.array(keys, pa.string()), pa.array(words, pa.string())], ["form", "how", "exact", "key", "word"])


def _beside(either: DataFrame, words: DataFrame, times: int = 2, share: float = 0.3) -> DataFrame:
    """Familiar given names that the names tell by themselves: one that stands beside a family name again and again where the same
    more frequent one does, in at least `times` families and `share` of its own.

    A pair must share so many families that it shares one of the familiar name's rarest, too; only those are joined, so that the
    families everybody has form no pairs. The count of the candidates is exact.
    """
    n = either.select("word", "rest").distinct().join(words, "word").join(words.select(F.col("word").alias("rest"), F.col("n").alias("n_rest")), "rest").where("n > n_rest and n >= 2").select("rest", "word", "n")
    n = materialize(n)
    often = n.groupBy("rest").agg(F.count("*").alias("members"))
    sizes = n.groupBy("word").agg(F.count("*").alias("size"), F.max("n").alias("n_all")).withColumn("least", F.greatest(F.lit(times), F.ceil(F.lit(share) * F.col("n_all"))))
    ranked = n.join(sizes.where("size >= least"), "word").join(often, "rest").withColumn("rank", F.row_number().over(Window.partitionBy("word").orderBy("members", "rest")))
    rarest = ranked.where("rank <= size - least + 1").select("rest", F.col("word").alias("familiar"), "n")
    formal = n.select("rest", F.col("word").alias("formal"), F.col("n").alias("n_formal"))
    tried = rarest.join(formal, "rest").where("n_formal > n").select("formal", "familiar").distinct()
    both = tried.join(n.select(F.col("word").alias("familiar"), "rest", "n"), "familiar").join(n.select(F.col("word").alias("formal"), "rest"), ["formal", "rest"])
    counted = both.groupBy("formal", "familiar").agg(F.count("*").alias("k"), F.max("n").alias("n"))
    return counted.where((F.col("k") >= times) & (F.col("k") >= share * F.col("n"))).select("formal", "familiar")


def entities(names: DataFrame, familiar: DataFrame, name: str = "name", established: int = 3, share: float = 0.2, rarer: float = 4.0) -> DataFrame:
    """(name, entity) of every distinct name; names of one person or organisation have one entity.

    names: a column of names as typed; familiar: (formal, familiar) given names, completed by the nicknames that names tell in quotes.
    Null names are dropped; a name of blanks or signs only is an entity of its own. Names in `papers.authors` with outer blanks are to be trimmed
    by the caller, or they are names of their own that fall into the same entity. Names of any number and length of words are compared.
    """
    parsed = materialize(names.select(F.col(f"`{name}`").alias("name")).where("name is not null").distinct().mapInArrow(_parse, "name string, kind string, key string, forms array<string>, middle string, formal string, familiar string"))
    # one pair of words with different middle initials is different people
    middles = materialize(parsed.where("kind <> 'initial' and middle is not null").groupBy("key").agg(F.count_distinct("middle").alias("n")).where("n > 1").select("key", F.lit(True).alias("many")))
    parsed = materialize(parsed.join(middles, "key", "left").withColumn("who", F.when(F.col("many"), F.concat_ws("#", "key", F.coalesce("middle", F.lit("")))).otherwise(F.col("key"))))
    keys = parsed.where("kind <> 'initial'").select(F.col("who").alias("key"), F.col("key").alias("form"), "kind", "forms").distinct()
    # different middle initials tell people with like names apart
    told_middle = materialize(parsed.where("kind <> 'initial' and middle is not null").groupBy(F.col("who").alias("key")).agg(F.min("middle").alias("middle")))

    # every name as two words: a key of two words as it is, a longer one by its first word and by its last
    pairs = keys.where("kind = 'pair'").select("key", F.col("form").alias("written"), F.lit(True).alias("short"))
    pairs = materialize(pairs.unionByName(keys.where("kind = 'other'").select("key", F.explode("forms").alias("written"), F.lit(False).alias("short"))).distinct())
    split = pairs.select("key", "written", "short", F.split("written", "\\|").alias("w"))
    turns = F.array(F.struct(F.col("w")[0].alias("word"), F.col("w")[1].alias("rest")), F.struct(F.col("w")[1].alias("word"), F.col("w")[0].alias("rest")))
    either = split.select("key", "written", "short", F.explode(turns).alias("p")).select("key", "written", "short", "p.*")
    words = materialize(either.where("short").select("written", "word").distinct().groupBy("word").agg(F.count("*").alias("n")))
    told = parsed.where("formal is not null").select("formal", "familiar").unionByName(familiar.select(F.lower("formal").alias("formal"), F.lower("familiar").alias("familiar")))
    told = told.unionByName(_beside(either.where("short"), words)).distinct()
    formal = materialize(either.join(told, either["word"] == told["familiar"]).select("key", F.concat_ws("|", F.sort_array(F.array("formal", "rest"))).alias("form")).distinct())

    # slips of the pen, in keys as typed and with the formal given name
    typed = pairs.select("key", "written", F.lit(True).alias("typed")).unionByName(formal.select("key", F.col("form").alias("written"), F.lit(False).alias("typed")))
    slips = materialize(typed.mapInArrow(_slips, "form string, how string, exact boolean, key string, word string"))
    shared = slips.groupBy("form").agg(F.count_distinct("key").alias("k"), F.max("exact").alias("whole")).where("k > 1")
    # a rewritten name that is another as it stands is no slip; whether it is meant is settled below
    near = slips.where("exact or how <> 'as is'").join(shared, "form").where("whole or how in ('other letter', 'swapped')").join(words, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    many = typed.join(middles, typed["written"] == middles["key"], "left_semi").select("key").distinct().withColumn("many", F.lit(True))
    near = materialize(near.join(told_middle, "key", "left").join(many, "key", "left"))
    top = F.max(F.struct("exact", "n", "key", "word", "middle", "many")).alias("hub")
    # one whose namesakes differ by middle initials is linked to that of them with its own
    mine = near.where("middle is not null").groupBy("form", "middle").agg(top)
    alike = near.join(mine, ["form", "middle"])
    general = near.join(near.groupBy("form").agg(top), "form").where("hub.many is null and many is null").where("middle is null or hub.middle is null or middle = hub.middle")
    linked = alike.select("key", "word", "n", "exact", "hub").unionByName(general.select("key", "word", "n", "exact", "hub")).where("key <> hub.key and word <> hub.word").where("not hub.exact or not exact")
    two = (F.least("n", "hub.n") >= established) & (F.least("n", "hub.n") > share * F.greatest("n", "hub.n"))
    by_slip = linked.where(~two).select(F.col("key").alias("u"), F.col("hub.key").alias("v")).distinct()

    # nicknames and other rewritings: a key's further forms, where they are anyone else's
    further = formal.unionByName(keys.select("key", F.explode("forms").alias("form"))).where("key <> form").distinct()
    holders = keys.select("form", F.col("key").alias("holder")).unionByName(further.select("form", F.col("key").alias("holder"))).distinct()
    held = holders.groupBy("form").agg(F.count("*").alias("n")).where("n > 1")
    used = further.join(held, "form").join(told_middle, "key", "left").join(middles.select(F.col("key").alias("form"), "many"), "form", "left")
    # where the form is that of people with different middle initials, only that with the same one is meant
    used = used.withColumn("node", F.when(F.col("many").isNull(), F.col("form")).when(F.col("middle").isNotNull(), F.concat_ws("#", "form", "middle"))).where("node is not null")
    other = told_middle.select(F.col("key").alias("node"), F.col("middle").alias("other"))
    used = materialize(used.join(other, "node", "left").where("middle is null or other is null or middle = other").select("key", "node", "n").distinct())
    times = used.groupBy("key").agg(F.count("*").alias("times"))
    once = used.join(times.where("times = 1"), "key").select(F.col("key").alias("u"), F.col("node").alias("v"))
    edges = materialize(by_slip.unionByName(once))
    parts = materialize(components(edges))
    several = used.join(times.where("times > 1"), "key")
    if not several.isEmpty():
        # the forms of one entity count as one; of different ones the rarest counts if it is much rarer than the next
        meant = several.join(parts, several["node"] == parts["node"], "left").select("key", F.coalesce("component", several["node"]).alias("entity"), several["node"], "n")
        scored = meant.groupBy("key", "entity").agg(F.min("n").alias("n"), F.min("node").alias("node"))
        ranked = scored.groupBy("key").agg(F.min(F.struct("n", "node")).alias("best"), F.count("*").alias("meanings"), F.expr("get(sort_array(collect_list(n)), 1)").alias("next"))
        chosen = ranked.where((F.col("meanings") == 1) | (F.col("next") >= rarer * F.col("best.n"))).select(F.col("key").alias("u"), F.col("best.node").alias("v"))
        if not chosen.isEmpty():
            edges = materialize(edges.unionByName(chosen))
            parts = materialize(components(edges))
    own = keys.select("key").distinct().join(parts, F.col("key") == F.col("node"), "left").select("key", F.coalesce("component", "key").alias("entity"))
    own = materialize(own)

    # initials: the family name with a first initial, where just one entity can be meant
    can = either.join(own, "key").select(F.concat_ws("|", "rest", F.substring("word", 1, 1)).alias("form"), "entity").distinct()
    # the same with the given name before it was rewritten from a nickname
    can = can.unionByName(formal.join(own, "key").select(F.explode(F.expr("transform(array(0, 1), i -> concat_ws('|', split(form, '\\\\|')[i], substring(split(form, '\\\\|')[1 - i], 1, 1)))")).alias("form"), "entity")).distinct()
    unique = can.groupBy("form").agg(F.count("*").alias("n"), F.min("entity").alias("entity"))
    first = parsed.where("kind = 'initial'").join(unique, parsed["key"] == unique["form"], "left")
    middle = F.concat_ws("#", "key", F.coalesce("middle", F.lit("")))
    by_initial = first.select("name", F.when(F.col("n").isNull(), F.concat(F.lit("initial:"), "key")).when(F.col("n") == 1, F.col("entity")).otherwise(F.concat(F.lit("unclear:"), middle)).alias("entity"))
    by_key = parsed.where("kind <> 'initial'").join(own, parsed["who"] == own["key"]).select("name", "entity")
    return by_key.unionByName(by_initial)


def name_pairs(members: DataFrame) -> DataFrame:
    """Pairs name_a < name_b of names of one entity."""
    a, b = members.withColumnRenamed("name", "name_a"), members.withColumnRenamed("name", "name_b")
    return a.join(b, "entity").where("name_a < name_b").select("name_a", "name_b")
