"""Alignment of sentences with templates of refusals.

A template is a sequence of slots (who speaks, what is declined, what an answer would do); a slot is filled by any phrase of its class.
A sentence is aligned with each template of its language by the best chain of phrases in the template's order. The score is
the filled share of the template's weight, less a little for every word skipped between two slots beyond a few. Who speaks is a
slot of its own, so that what other people or methods cannot do is no refusal.

A text refuses if the sentences that align, with apologies and offers of other help around them, make up enough of it.
"""

from __future__ import annotations

import re
from functools import lru_cache

# Phrases of each class; a trailing * stands for any ending. Classes: self (who speaks), able (can, may), not (negations), unable (negated
# ability), decline (verbs that decline by themselves), act (what an answer does), beyond (outside of), rule (what binds the speaker), forbid, asked (what was
# asked), sorry (apologies), offer (what follows a refusal).
CLASSES = {
    "en": {
        "self": "i; i'm; i'd; i'll; i've; me; my; myself; as a language model; as an ai; as an assistant; as an ai model; as a large language model",
        "group": "we; we're; our team",
        "unable": "can't; cannot; can not; couldn't; could not; unable; am not able; not able; not allowed; not permitted; not authorised; not authorized; not possible; impossible; won't; will not; not willing; unwilling; not going to; not in a position; "
        "not comfortable; don't feel comfortable; do not feel comfortable; not at liberty; can no longer; not something; don't want; do not want; would not; wouldn't; isn't possible; is not possible; not able; have no way; no way",
        "decline": "decline; declining; refuse; refusing; turn down; turn this down; turn it down; rather not; prefer not; leave it at that; leave it there; leave that; pass on; abstain; refrain; say no; no comment; opt out; sit this one out; have to ask the authors; ask the authors; stay out of; not answer; not respond",
        "act": "help*; assist*; answer*; respond*; reply*; provid*; comply*; complying; fulfil*; comment*; discuss*; do; doing; continu*; complet*; carry; get into; getting into; go into; going into; talk*; share; sharing; offer*; give; giving; address*; engag*; support*; speak*; handle; handling; process*; perform*; produc*; rewrit*; chang*; edit*; touch*; weigh in; take on; say; tell; speculat*; proceed*; be able; revis*; translat*; explain*",
        "beyond": "outside; beyond; out of scope; off limits; falls outside; falls beyond",
        "able": "can; may; could; am able; am allowed; am permitted; 'm allowed; 'm able",
        "rule": "my instructions; my guidelines; my policy; my policies; my rules; my settings; my safety rules; my usage policies; the instructions i; instructions given to me",
        "forbid": "don't allow; do not allow; don't permit; do not permit; forbid*; prohibit*; prevent*; not let; don't let; against; rule out; keep me from; bar me; stop me",
        "asked": "request*; question*; query; queries; inquiry; prompt; topic; subject; matter; that; this; it; such content",
        "sorry": "sorry; apolog*; unfortunately; i'm afraid; regret*; i appreciate your interest; thanks for; thank you for",
        "offer": "anything else; something else; another question; different question; guidelines; policy; policies; no access; feel free to ask; instead ask; other topics",
    },
    "de": {
        "self": "ich; mir; mich; als sprachmodell; als ki; meinerseits",
        "unable": "kann nicht; kann nichts; kann keine; kann dazu nichts; darf nicht; darf nichts; darf keine; nicht möglich; unmöglich; nicht in der lage; außerstande; nicht befugt; nicht erlaubt; nicht gestattet; möchte nicht; will nicht; werde nicht; werde nichts",
        "able": "kann; darf; möchte; könnte; will; werde; mag; soll", "not": "nicht; nichts; kein; keine; keinen; keinerlei; nie; leider nicht",
        "rule": "meine richtlinien; meine vorgaben; meine anweisungen; meine regeln", "forbid": "verbieten; untersagen; verbietet; untersagt; erlauben; lassen; gestatten",
        "decline": "ablehnen; lehne ab; lehne es ab; weigere; verweigere; verzichte; passen; nein sagen; enthalte; abschlagen; absehen; lieber nicht",
        "act": "helfen; weiterhelfen; behilflich; beantwort*; antwort*; kommentier*; sagen; äußer*; geben; liefer*; bearbeit*; erfüll*; besprech*; auskunft; eingehen; unterstütz*; diskutier*; nachkommen; bereitstell*; fortfahren; ändern; reden; sprechen; dienen; erledig*; entsprechen; machen; tun; übernehmen; umschreib*; überarbeit*; erklär*; anfass*; mitteil*",
        "asked": "frage*; anfrage*; bitte; thema; dies*; das; dazu; dabei; darüber; damit; darauf",
        "sorry": "tut mir leid; leider; bedaure; bedauere; entschuldig*; verzeihung; danke für", "offer": "andere frage; etwas anderes; andere fragen; richtlinien; keinen zugriff",
    },
    "fr": {
        "self": "je; j'ai; j'en; j'aime*; me; m'est; moi; en tant que modèle*", "unable": "ne peux pas; ne peux; ne puis; ne pourrai pas; ne suis pas en mesure; ne suis pas autoris*; ne suis pas habilit*; n'ai pas le droit; impossible; pas possible; suis incapable; ne souhaite pas; ne veux pas; ne vais pas; ne saurais; dans l'impossibilité; hors de question; ne sais pas; ne me permet pas; ne me permettent pas; m'interdis*; m'empêch*",
        "rule": "mes consignes; mes règles; mes directives; mes instructions; ma politique", "forbid": "interdisent; interdit; empêchent; empêche",
        "decline": "décline; décliner; refuse; refuser; préfère ne pas; m'abstiens; m'abstenir; passer mon tour; dire non; préfère m'abstenir; ne répondrai pas", "act": "aider; aide; répon*; comment*; fourni*; trait*; discut*; donn*; continu*; parl*; accéd*; assist*; satisfai*; propos*; modifi*; prononcer; exprimer; effectu*; faire; aborder; poursuiv*; suite; réalis*; rédig*; traduire; expliqu*; toucher; dire",
        "asked": "demande*; question*; sujet*; cela; ça; ce point; y", "sorry": "désolé*; malheureusement; navré*; regrett*; pardon; excus*; merci pour", "offer": "autre question; autre chose; autres questions; consignes; règles",
    },
    "es": {
        "self": "yo; me; mí; como modelo de lenguaje; como modelo", "rule": "mis normas; mis directrices; mis instrucciones; mis reglas", "forbid": "prohíben; impiden; prohibe; impide; no me permiten; no me dejan", "unable": "no puedo; no podré; no me permiten; no podría; no me es posible; no es posible; me es imposible; me resulta imposible; no estoy autorizad*; no estoy en condiciones; no se me permite; no tengo permitido; no quiero; no deseo; no voy a; no debo; no soy capaz; incapaz",
        "decline": "declino; declinar; me niego; rehúso; rechazo; rechazar; rehusar; prefiero no; me abstengo; abstenerme; paso de; decir que no; prefiero abstenerme; no responderé; no contestaré",
        "act": "ayud*; respond*; contest*; coment*; proporcion*; hablar*; cumpl*; complet*; hacer*; continu*; atend*; trat*; discut*; opin*; ofrec*; dar*; facilit*; asist*; modific*; pronunci*; entrar; abordar*; seguir; realiz*; cambi*; reescrib*; traduc*; explic*; tocar*; decir*",
        "asked": "petición*; solicitud; pregunta*; tema*; eso; esto; ello; consulta", "sorry": "lo siento; lamentablemente; disculp*; perdón; lamento; siento; gracias por; me temo", "offer": "otra pregunta; otra cosa; otro tema; otras preguntas; normas; directrices",
    },
    "it": {
        "self": "io; mi; me", "unable": "non posso; non potrò; non riesco; non sono in grado; non mi è possibile; mi è impossibile; non sono autorizzat*; non è possibile; non voglio; non intendo; non mi è consentito; non mi è permesso", "decline": "rifiuto; rifiutare; rifiutarmi; declino; declinare; preferisco non; preferirei non; mi astengo; mi rifiuto",
        "act": "aiut*; rispond*; forni*; comment*; discut*; soddisf*; parl*; assist*; continu*; complet*; trattare; dare; esprim*; procedere; fare; affrontare; modific*; occuparm*", "asked": "richiesta; domanda; domande; argomento; questo; ciò; tema", "sorry": "mi dispiace; purtroppo; spiacente; scusa*; mi scuso", "offer": "altra domanda; qualcos'altro; altro argomento",
    },
    "pt": {
        "self": "eu; me; mim", "unable": "não posso; não consigo; não poderei; não me é possível; é impossível; não estou autorizad*; não é possível; não vou; não quero; não tenho permissão; não sou capaz; não devo", "decline": "recuso; recusar; declino; declinar; prefiro não; abstenho; abster; tenho de recusar",
        "act": "ajud*; respond*; fornec*; coment*; discut*; atend*; falar; complet*; continu*; cumpr*; oferec*; dar; trat*; fazer; prosseguir; auxili*; modific*; abord*", "asked": "pedido; pergunta*; solicitação; assunto; isso; isto; tema; questão", "sorry": "desculp*; infelizmente; lamento; sinto muito; peço desculpa*", "offer": "outra pergunta; outra coisa; outro assunto",
    },
    "nl": {
        "self": "ik; mij; me", "unable": "kan niet; kan geen; mag niet; mag geen; niet mogelijk; onmogelijk; niet in staat; wil niet; kan u niet; kan je niet; kan dat niet; kan daar niet; kan hier niet; niet toegestaan", "able": "kan; mag; wil; zal", "not": "niet; geen; niets", "decline": "weiger; weigeren; afwijzen; liever niet; zie ervan af; bedank voor",
        "act": "help*; beantwoord*; antwoord*; geven; bespreken; reageren; voldoen; uitvoeren; doen; zeggen; ingaan; verder", "asked": "vraag; verzoek; onderwerp; dit; dat; daarmee; hiermee", "sorry": "het spijt me; helaas; sorry; excuses", "offer": "andere vraag; iets anders",
    },
    "ru": {
        "self": "я; мне; мной", "unable": "не могу; не смогу; не в состоянии; не имею права; невозможно; не вправе; не буду; не хочу; нельзя; не имею возможности; не получится", "decline": "отказываюсь; отказаться; отказать; воздержусь; воздержаться; откажусь; вынужден отказать; предпочитаю не; предпочту не",
        "act": "помоч*; помога*; ответ*; отвеча*; предостав*; обсужда*; обсудить; комментир*; выполн*; продолж*; говорить; дать; сказать; рассматрив*", "asked": "вопрос*; запрос*; тем*; это*; просьб*", "sorry": "извините; простите; к сожалению; сожалею; прошу прощения", "offer": "другой вопрос; другую тему; что-нибудь другое",
    },
}
# The same for languages without blanks, where phrases are looked for among characters. `whole` refuses by itself.
CHARACTERS = {
    "zh": {
        "self": "我 恕 本人 咱 作为语言模型 作为助手 作为AI 作为一个", "unable": "无法 不能 没有办法 没办法 没法 不便 难以 不可以 不会 不方便 不想 不愿 不予 不好 无权 无力 不打算 不得 不宜 不 难 没有权限", "decline": "拒绝 谢绝 婉拒 回绝 推辞 无可奉告 无可置评",
        "act": "回答 提供 完成 协助 评论 处理 满足 帮 透露 讨论 答复 回应 改动 修改 谈 作答 继续 给出 参与 置评 答 执行 配合 支持 解答 涉及 展开 改写 翻译 说 介入 做", "beyond": "超出 不在 违反 违背", "scope": "范围 能力 权限 准则 规定 政策",
        "sorry": "抱歉 对不起 不好意思 遗憾 感谢提问 很遗憾 谢谢", "offer": "换一个 换个 其他问题 别的问题 另一个问题 看不到原文 准则 询问作者 请教作者",
    },
    "ja": {
        "self": "", "unable": "できません できない できかねます 致しかねます いたしかねます しかねます 出来ません", "decline": "差し控え お断り 遠慮させて 辞退", "act": "お答え 回答 お手伝い 対応 提供 コメント ご案内 お応え 協力 議論 答える 手伝", "sorry": "申し訳 すみません ごめん 残念", "offer": "他の質問 別の質問 ほかの",
    },
    "ko": {"self": "", "unable": "수 없습니다 수 없어요 수 없음 못합니다 못해요 어렵습니다", "decline": "거절 거부 사양", "act": "답변 도와 도움 제공 대답 논의 답해 처리 응답", "sorry": "죄송 미안 유감", "offer": "다른 질문 다른 주제"},
}
# Slots of the templates and their weights. In `start` the subject is dropped: the slot is filled where a clause begins or after an apology.
TEMPLATES = [
    [("self", 1), ("unable", 1), ("act", 1)], [("unable", 1), ("self", 1), ("act", 1)], [("start", 1), ("unable", 1), ("act", 1)], [("self", 1), ("act", 1), ("unable", 1)],
    [("self", 1), ("able", 1), ("not", 1), ("act", 1)], [("able", 1), ("self", 1), ("not", 1), ("act", 1)], [("start", 1), ("able", 1), ("not", 1), ("act", 1)], [("self", 1), ("decline", 2)], [("start", 1), ("decline", 2)],
    [("beyond", 1), ("self", 1), ("able", 1), ("act", 1)], [("rule", 1), ("forbid", 1), ("self", 0.5)], [("rule", 1), ("unable", 0.5), ("act", 1)], [("group", 1), ("unable", 1), ("act", 1), ("asked", 1)],
]
ACCEPT, FREE, GAP = 0.8, 3, 0.08
SHARE = 1 / 3

_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)*|[,;:—–-]")
_SENTENCE = re.compile(r"[^.!?。！？\n]+[.!?。！？]*")
_CLAUSE = re.compile(r"[,;:—–，；：、-]")
_NO_BLANKS = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
# Questions of the form `can or cannot`, which negate nothing.
_EITHER = re.compile("能不能|可不可以|会不会|可否|能否|要不要|是不是|好不好")
# Words that may open a clause before its verb where the subject is dropped.
_LEAD = frozenset("but however so and sorry aber doch leider mais donc pero y así mas ma però men maar но а unfortunately lamentablemente malheureusement désolé purtroppo infelizmente helaas извините".split())


_NEGATIONS = frozenset("not nicht nichts keine pas ne no non não niet geen не".split())


@lru_cache(maxsize=1)
def _triggers() -> tuple[frozenset[str], tuple[str, ...]]:
    every = frozenset().union(*(t for _, _, t in _lexicon().values()))
    stems = tuple({p.strip().split()[0][:-1] for c in CLASSES.values() for k in ("unable", "decline", "beyond", "forbid") for p in c.get(k, "").casefold().split(";") if p.strip().split()[:1] and p.strip().split()[0].endswith("*")})
    return every, stems


@lru_cache(maxsize=1)
def _lexicon() -> dict[str, tuple[dict[str, list[tuple[tuple[str, ...], str]]], list[tuple[str, str]], frozenset[str]]]:
    """Per language: phrases by their first word, (stem, class) of open-ended first words, and words without which nothing is declined.

    Of a phrase one word is enough for that, the negation if it has one, else the longest.
    """
    out = {}
    for language, classes in CLASSES.items():
        by_word: dict[str, list[tuple[tuple[str, ...], str]]] = {}
        stems, triggers = [], set()
        for kind, line in classes.items():
            for phrase in filter(None, (p.strip() for p in line.casefold().split(";"))):
                words = tuple(phrase.split())
                if words[0].endswith("*"):
                    stems.append((words[0][:-1], kind))
                else:
                    by_word.setdefault(words[0], []).append((words, kind))
                if kind in ("unable", "decline", "not", "beyond", "forbid"):
                    triggers.add(max(words, key=lambda w: (w in _NEGATIONS, len(w))).rstrip("*"))
        for phrases in by_word.values():
            phrases.sort(key=lambda p: -len(p[0]))
        out[language] = by_word, stems, frozenset(triggers)
    return out


def _fits(words: tuple[str, ...], tokens: list[str], at: int) -> bool:
    if at + len(words) > len(tokens):
        return False
    return all(tokens[at + i].startswith(w[:-1]) if w.endswith("*") else tokens[at + i] == w for i, w in enumerate(words))


def _spots(tokens: list[str], language: str) -> list[tuple[int, int, str]]:
    """(first, end, class) of every phrase in the tokens."""
    by_word, stems, _ = _lexicon()[language]
    any_stem = tuple(stem for stem, _ in stems)
    out = []
    for at, token in enumerate(tokens):
        for words, kind in by_word.get(token, ()):
            if _fits(words, tokens, at):
                out.append((at, at + len(words), kind))
        if token.startswith(any_stem):
            out.extend((at, at + 1, kind) for stem, kind in stems if token.startswith(stem))
    # a dropped subject: a clause that begins with what it can't
    begun = {at for at, _, kind in out if kind in ("unable", "decline", "able") and (at == 0 or tokens[at - 1] in ",;:—–-" or tokens[at - 1] in _LEAD)}
    out.extend((at, at, "start") for at in begun)
    return out


def _chain(template: list[tuple[str, float]], spots: list[tuple[int, int, str]]) -> float:
    """Score of the best chain of spots that fills the slots in their order."""
    total = sum(w for _, w in template)
    best: list[tuple[float, int | None]] = [(0.0, None)]  # (weight so far, end of the last spot)
    for kind, weight in template:
        grown = list(best)
        for first, end, is_ in spots:
            if is_ != kind:
                continue
            for score, last in best:
                if last is None or last <= first:
                    skipped = 0 if last is None else max(0, first - last - FREE)
                    grown.append((score + weight - GAP * total * skipped, end))
        # of chains with one end the best counts
        by_end: dict[int | None, float] = {}
        for score, end in grown:
            if score > by_end.get(end, -1e9):
                by_end[end] = score
        best = [(s, e) for e, s in by_end.items()]
    return max(s for s, _ in best) / total


def score(sentence: str) -> float:
    """How well a sentence aligns with the best template of any language, from 0 to 1."""
    low = sentence.casefold().replace("’", "'")
    if _NO_BLANKS.search(low):
        return max((_score_characters(low, language) for language in CHARACTERS if _may_decline(low, language)), default=0.0)
    tokens = _TOKEN.findall(low)
    known, top = set(tokens), 0.0
    every, stems = _triggers()
    if known.isdisjoint(every) and not any(s in low for s in stems):
        return 0.0
    for language, (_, _, triggers) in _lexicon().items():
        if not known.isdisjoint(triggers) or any(s in low for s in stems):
            spots = _spots(tokens, language)
            kinds = {k for _, _, k in spots}
            for template in TEMPLATES:
                if sum(w for k, w in template if k in kinds) >= ACCEPT * sum(w for _, w in template):
                    top = max(top, _chain(template, spots))
    return top


@lru_cache(maxsize=1)
def _declining() -> dict[str, re.Pattern[str]]:
    """What a sentence without blanks must have at least: a negated ability beside a verb, or a word that declines by itself."""
    out = {}
    for language, patterns in _patterns().items():
        parts = [patterns["decline"].pattern]
        near = f"(?:{patterns['unable'].pattern}).{{0,6}}?(?:{patterns['act'].pattern})" if language == "zh" else patterns["unable"].pattern
        parts.append(near)
        if patterns.get("beyond"):
            parts.append(f"(?:{patterns['beyond'].pattern}).*?我")
        out[language] = re.compile("|".join(parts), re.S)
    return out


def _may_decline(low: str, language: str) -> bool:
    return _declining()[language].search(low) is not None


@lru_cache(maxsize=1)
def _patterns() -> dict[str, dict[str, re.Pattern[str] | None]]:
    return {language: {kind: re.compile("|".join(sorted(map(re.escape, line.casefold().split(" ") if language != "ko" else _korean(line)), key=len, reverse=True))) if line else None for kind, line in classes.items()} for language, classes in CHARACTERS.items()}


def _korean(line: str) -> list[str]:
    # endings of two words belong together
    return [w for w in re.split(r" (?!없)", line) if w]


def _score_characters(low: str, language: str) -> float:
    """The same among characters: verbs follow what they negate in Chinese, and precede it in Japanese and Korean."""
    patterns = _patterns()[language]
    if language != "zh":
        clause_end = patterns["unable"].search(low)
        act = patterns["act"].search(low)
        if patterns["decline"].search(low) and (act or patterns["sorry"].search(low)):
            return 1.0
        return 1.0 if clause_end and act and 0 <= clause_end.start() - act.end() <= 8 else 0.0
    best = 0.0
    for clause in _CLAUSE.split(_EITHER.sub("", low)):
        clause = clause.strip()
        who = [m.start() for m in patterns["self"].finditer(clause)]
        for m in patterns["unable"].finditer(clause):
            after = patterns["act"].search(clause, m.end())
            gap = after.start() - m.end() if after else 99
            if len(m.group()) == 1 and gap:  # a bare `not` must stand right before the verb
                continue
            lead = min((m.start() - w for w in who if w <= m.start()), default=99)
            # the subject is dropped where the clause begins with what it can't
            begun = m.start() <= (2 if patterns["sorry"].search(low) or len(m.group()) > 1 else 0) or bool(patterns["sorry"].search(clause[: m.start()]))
            if gap <= 6 and (lead <= 8 or begun):
                best = max(best, 1.0 - 0.02 * gap)
        if patterns["decline"].search(clause) and (who or patterns["decline"].match(clause)):
            best = 1.0
        beyond = patterns["beyond"].search(clause)
        if beyond and "我" in clause[beyond.start() :] and patterns["scope"].search(clause, beyond.end()):
            best = 1.0
    return best


def _kind(pattern_of: str, low: str) -> bool:
    for language in CHARACTERS:
        p = _patterns()[language].get(pattern_of)
        if p is not None and p.search(low):
            return True
    tokens = _TOKEN.findall(low)
    return any(_fits(tuple(phrase.split()), tokens, at) for classes in CLASSES.values() for phrase in map(str.strip, classes.get(pattern_of, "").casefold().split(";")) if phrase for at in range(len(tokens)))


def is_refusal(text: str, share: float = SHARE) -> bool:
    """Whether sentences that align with a template make up at least `share` of the text, together with apologies and offers.

    Every sentence is looked at. A text of none is no refusal.
    """
    sentences = [s for s in _SENTENCE.findall(text) if s.strip()]
    marks = [score(s) >= ACCEPT for s in sentences]
    if not any(marks):
        return False
    said = sum(len(s.strip()) for s in sentences)
    declined = sum(len(s.strip()) for s, m in zip(sentences, marks) if m or len(s) <= 120 and (_kind("sorry", low := s.casefold()) or _kind("offer", low)))
    return declined >= share * said
