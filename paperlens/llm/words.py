"""Words of texts in five languages: tokens, function words, language."""

from __future__ import annotations

import re

# Names that stand in texts of any language (model and data names) are no words of it.
NAME = re.compile(r"@\w+|\b\w*[A-Za-z]\w*(?:-\w+)*-(?:\d\w*|XL|S|lite)\b|\b[A-Z][a-z]+[A-Z]\w*|\b[A-Z]\w+\b(?=[^A-Za-z]*[一-鿿])")
TOKEN = re.compile(r"[㐀-鿿]|[^\W_]+(?:['’-][^\W_]+)*")
LATIN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
HAN = re.compile(r"[㐀-鿿]")

# Frequent function words of four languages.
FUNCTION_WORDS = {
    "en": "the of and to in is it that for on with as by at from this be are was were not or an which what why how who when where does do did can could should would will if but than then there these those whose its has have had into only all you we they your our their please such yes no a once however moreover therefore consequently instead specifically similarly conversely otherwise nevertheless additionally meanwhile thus also between within under over more most each both while since because after before during until there here very much many some any other another same new first last",
    "de": "der die das den dem des ein eine einen einem einer eines und oder nicht ist sind war wird werden wurde mit von vom zu zum zur auf für bei aus nach über um gegenüber dagegen nur auch als wie was warum wenn weil ob es er sie ihr sich noch schon erst hier gibt kann kein keine durch sie dass jedoch deshalb daher außerdem stattdessen während seit bis vor ohne mehr sehr jede jeder jedes alle andere gleiche bleibt rund zwischen ja nein bitte im am",
    "fr": "le les des du de un une et ou est sont n'est pas ne que qui quoi dans pour par sur avec sans au aux ce cet cette ces il elle on nous vous se sa son ses leur plus alors dont où si mais après lorsque quand comment pourquoi tandis celui entre même déjà oui non seulement l'on c'est qu'une qu'un d'une d'un toujours cependant donc ainsi pendant depuis jusqu avant très chaque tous toutes autre cela comme a à dès lors été reste",
    "es": "el los las del de un una unos y o es son no que quien en para por con sin al lo se su sus más pero cuando cómo como qué porque mientras si ya entre este esta estos esto solo sólo desde hasta sobre cada sí está después donde dónde sigue hay ante según tras la sin embargo además durante cada todos todas otro otra esa ese eso muy a fue queda",
}
# The same of languages that answers may stray into; words that they share with the others count half.
OTHER_WORDS = {
    "it": "il lo gli che non è della dello degli delle nel nella sono una per con più dei del questo questa anche come ma di da si alla al sul sulla tra ogni molto poi perché quando senza dopo prima e",
    "pt": "porque está pode cada todos o os as um uma não é são do da dos das no na nos nas ao à pelo pela com para que se por mais mas como também muito este esta isso seu sua entre sobre até já quando sem depois antes ou e foi ser",
    "nl": "het een en van niet is zijn op te dat die met voor aan ook als maar door bij naar uit over nog wordt worden deze dit geen wel meer heeft hebben omdat zonder na tussen zeer de dan of om",
}
_OTHER = {language: frozenset(words.split()) for language, words in OTHER_WORDS.items()}
_OTHER_LETTERS = {"pt": frozenset("ãõ")}
# Letters of scripts that tell a language.
SCRIPTS = {"ja": re.compile("[぀-ヿ]"), "ko": re.compile("[가-힯]"), "ru": re.compile("[Ѐ-ӿ]")}
_WORDS = {language: frozenset(words.split()) for language, words in FUNCTION_WORDS.items()}
_SHARED = {"en": frozenset({"a", "once", "on"}), "fr": frozenset({"la", "de", "un", "que", "se", "si", "es", "les", "a", "on"}), "es": frozenset({"la", "de", "un", "que", "se", "si", "a"})}
_KNOWN = frozenset().union(*_WORDS.values())
_LETTERS = {"de": frozenset("äöüß"), "fr": frozenset("èêàùçœîôû"), "es": frozenset("ñ¿¡íóú")}


def tokens(text: str) -> list[str]:
    """Lower-case words; a Chinese character is a word of its own."""
    return TOKEN.findall(text.casefold())


def language(text: str, short: bool = False) -> str | None:
    """en, de, fr, es, zh, it, pt, nl, ja, ko or ru; None where the text doesn't tell. With `short` one function word tells for a few words."""
    bare = NAME.sub(" ", text)
    han = len(HAN.findall(bare))
    if not bare.isascii():
        for script, letters in SCRIPTS.items():
            found = len(letters.findall(bare))
            # Japanese is written with Chinese characters as well
            if found >= 2 and 2 * (found + (han if script == "ja" else 0)) >= sum(map(str.isalpha, bare)) and (script != "ja" or 8 * found >= han):
                return script
    words = LATIN.findall(HAN.sub(" ", bare).casefold().replace("’", "'"))
    latin = len(words)
    if han >= 2 and han >= latin:
        return "zh"
    if not latin:
        return "zh" if han else None
    score = {k: 0.0 for k in _WORDS}
    for w in words:
        for k, known in _WORDS.items():
            if w in known:
                score[k] += 0.5 if w in _SHARED.get(k, ()) else 1.0
        for k, letters in _LETTERS.items():
            if not letters.isdisjoint(w):
                score[k] += 0.7
        if "'" in w and w.split("'")[0] in ("l", "d", "n", "qu", "s", "c", "j"):
            score["fr"] += 1.0
    ranked = sorted(score, key=lambda k: (-score[k], k))
    best, second = score[ranked[0]], score[ranked[1]]
    for k, known in _OTHER.items():
        there = [w for w in words if w in known]
        distinct = len({w for w in there if w not in _KNOWN})
        letters = sum(1.5 for w in words if not _OTHER_LETTERS.get(k, frozenset()).isdisjoint(w))
        if distinct >= 2 and letters + sum(0.5 if w in _KNOWN else 1.0 for w in there) > best:
            return k
    if short and latin <= 5 and best >= 1 and not second:
        return ranked[0]
    if best >= 2 and best >= 1.5 * second and best >= 0.08 * latin:
        return ranked[0]
    return None
