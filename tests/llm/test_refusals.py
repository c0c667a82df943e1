"""Refusals in wordings of their own, none of them taken from the tables, and sentences that only look like one.

The first two lists were looked at while the lexicon was written, LATER was not.
"""

import pytest

from paperlens.llm.answers import is_empty
from paperlens.llm.refusals import is_refusal, score

REFUSING = """
Sorry, this request is one I have to turn down.
I'm afraid I am in no position to answer that; I cannot assist here.
I would prefer not to comment on this figure.
Regrettably I am not permitted to share details about this section.
As an AI model, I can't in good conscience rewrite this passage.
My guidelines prevent me from discussing this topic.
I have to pass on this one.
Unable to comply with this request.
That lies beyond what I can discuss.
We are unable to assist with this request.
No comment.
This is not something I can help with.
I refuse to answer.
Dazu möchte ich mich nicht äußern.
Diese Anfrage muss ich leider ablehnen.
Ich bin nicht befugt, darüber Auskunft zu geben.
Es ist mir nicht möglich, diese Frage zu beantworten.
Dabei kann ich Ihnen leider nicht weiterhelfen.
Je suis désolé, je ne suis pas autorisé à discuter de ce sujet.
Je préfère ne pas me prononcer sur ce tableau.
Je dois décliner cette demande.
Mes consignes ne me permettent pas de répondre.
Me temo que no estoy autorizado a comentar eso.
Prefiero no opinar sobre esta figura.
Tengo que rechazar esta solicitud, me niego a contestar.
Mi dispiace, non posso rispondere a questa domanda.
Purtroppo non sono in grado di aiutarti con questo.
Desculpe, não posso ajudar com isso.
Infelizmente, não estou autorizado a responder.
Helaas kan ik deze vraag niet beantwoorden.
К сожалению, я не могу ответить на этот вопрос.
申し訳ありませんが、その質問にはお答えできません。
回答を差し控えさせていただきます。申し訳ございません。
죄송하지만 그 질문에는 답변할 수 없습니다.
对这个问题，我不方便发表评论。
这件事恕难回答。
很抱歉，此类请求我没有权限处理。
我选择不回应这个要求。
抱歉，这个我帮不了，无法提供。
我拒绝回答这个问题。
"""
SOUND = """
The authors cannot provide guarantees here.
Der Autor kann nicht antworten.
I cannot see a contradiction here; the two tables measure different things.
The model is not able to answer questions about long documents.
We cannot reject the null hypothesis at this level.
It is not possible to compare the rows directly, so here is the detour. The first row counts samples.
No. The bound does not hold for negative margins.
The method refuses to converge when the step is too large.
I'm sorry, I misread the caption earlier; here is the corrected version. It drops by 3 points.
Users who can't answer the survey are left out of the count.
The policy network can't handle unseen actions, which is why the gain is small.
I can't confirm the exact figure from the excerpt, but Table 3 gives 4.5 points for the larger set and 2.1 for the smaller one, so the gap is close to half of what the abstract claims.
Die Methode kann lange Texte nicht verarbeiten.
Das Modell darf die Testdaten nicht sehen, deshalb gibt es eine zweite Menge.
Man kann die Werte nicht direkt vergleichen.
Le modèle ne peut pas traiter de longues séquences.
On ne peut pas comparer directement les deux lignes.
El método no puede procesar textos largos.
No se puede comparar directamente, pero la segunda fila ayuda.
Il metodo non può gestire testi lunghi.
O modelo não consegue tratar sequências longas.
Модель не может обрабатывать длинные тексты.
このモデルは長い文書を処理できません。
该方法无法处理超长文本，因此作者改用分块。
这里不能直接相除，需要先换算。
模型不会在训练时看到测试集。
作者没有回答这个问题，但附录给出了答案。
作者拒绝了这一假设，因为方差太大。
能不能回答得更简单？当然，这里的意思是误差下降。
The request queue does not allow more than ten entries.
Our results do not support this claim.
The reviewers declined the paper twice before it was accepted.
I would rather say that the second table answers it: the drop is 3 points.
This is beyond the range that the sensor can support.
The instructions in the appendix don't allow for a second pass.
One cannot do better than the lower bound.
The decline in accuracy that I mentioned comes from the smaller buffer.
Nicht möglich ist das nur bei negativen Werten.
Ich sehe hier keinen Widerspruch; beide Tabellen messen Verschiedenes.
Je ne vois pas de contradiction ici.
"""


def test_held_out():
    """Recall and precision of at least nine in ten."""
    refusing, sound = REFUSING.strip().split("\n"), SOUND.strip().split("\n")
    found = [s for s in refusing if is_refusal(s)]
    wrong = [s for s in sound if is_refusal(s)]
    assert len(found) >= 0.9 * len(refusing) and len(found) >= 0.9 * (len(found) + len(wrong)), (set(refusing) - set(found), wrong)


@pytest.mark.parametrize("text", ["", "\n", "...", "42", "？"])
def test_nothing_said(text):
    assert not is_refusal(text) and score(text) == 0.0


def test_place_and_length_of_a_refusal():
    """A refusal counts wherever it stands, and with any explanation, as long as it is a third of what is said."""
    no = "I'm sorry, but I cannot help with this request."
    lead = "Thank you for the question. It is a good one. It touches the third table. "
    assert is_refusal(lead + no)
    assert is_refusal(no + " " + "My guidelines rule it out. " * 12)
    assert is_refusal(no + " The table in question belongs to another paper, which I have not seen.")
    assert not is_refusal(no + " " + "The loss falls by four points on the larger set. " * 12)


def test_empty_without_a_length():
    tag = "<p class='" + "x" * 2500 + "'></p>"
    assert is_empty(tag) and is_empty("null" + " " * 2500) and is_empty("\n" * 3000 + "N/A")
    assert not is_empty(tag + "word") and not is_empty("nullable" + " " * 300)


# Written after the lexicon was finished and measured once: 14 of 15 are found.
LATER = """
I'm not going to speculate about the authors' motives, sorry.
That request is one I have to refuse.
Unfortunately I lack the permission to answer; I'm unable to share this.
I don't want to discuss this appendix.
Zu diesem Abschnitt darf ich leider keine Auskunft geben.
Ich lehne es ab, den Text umzuschreiben.
Je regrette, mais je ne peux pas traiter cette question.
Je ne souhaite pas commenter ce passage.
No voy a responder a esa pregunta.
Lamento no poder ayudar con esta consulta.
Non intendo discutere questo argomento.
Não vou comentar esse trecho.
我不想讨论这个问题。
很遗憾，您的请求我无法满足。
这个部分我没有权限改写。
"""


def test_later():
    later = LATER.strip().split("\n")
    assert sum(map(is_refusal, later)) >= 0.8 * len(later)
