import pytest
from pyspark.sql import functions as F

from paperlens.llm.answers import _lcs, defect, is_copy, is_empty, judge
from paperlens.llm.words import language

Q = "@AGENT What happens to recall if the memory buffer is left out?"
OLD = "The proof bounds the buffer by 3.5 times the margin. It needs only few of its updates, and the loss is low."


@pytest.mark.parametrize("text", [None, "", "  \n", "。", "...", "null", "N/A", "**Answer:**", "{}", "```\n```", "<p></p>", "​", "—", "**回复：**"])
def test_empty(text):
    assert is_empty(text) and defect(text, Q, "", False)[0] == "empty"
    assert defect(text, "Delete this sentence.", OLD, True)[0] == ""


@pytest.mark.parametrize(
    "answer, want",
    [
        ("It drops by 3 points.", ""), ("No.", ""), ("42", ""), ("See Table 2.", ""),
        ("It drops by 3 points, whereas the", "open"), ("I'm sorry, but I can't help with that request. Is there anything else I can do?", "refusal"),
        ("I'm sorry, I misread the caption earlier; here is the corrected version. It drops by 3.", ""), ("I cannot see a contradiction here. It drops.", ""),
        ("抱歉，我无法回答该问题。", "refusal"), ("Lo siento, no puedo ayudarte con eso.", "refusal"), ("Leider darf ich dabei nicht helfen.", "refusal"), ("Désolé, je ne peux pas vous aider sur ce point.", "refusal"),
        ("what  happens to RECALL if the memory buffer is left out", "copy"), ("Question: What happens to recall if the memory buffer is left out?!", "copy"), ("> What happens to recall if the memory buffer is left out?\n\nWhat happens to recall if the memory buffer is left out?", "copy"),
        ("You ask: \"What happens to recall if the memory buffer is left out?\" It drops by three points on both of the sets.", ""),
        ("去掉缓冲之后，召回率下降三个百分点。", "language"), ("Ohne den Puffer verliert das Modell rund drei Punkte, weil die Abfrage nicht mehr stimmt.", "language"),
    ],
)
def test_replies(answer, want):
    assert defect(answer, Q, "", False)[0] == want


def test_asked_for():
    assert defect("Das Modell verliert ohne den Puffer rund drei Punkte.", "Please answer in German: what does this mean?", "", False)[0] == ""
    assert defect("去掉缓冲之后，召回率下降三个百分点。", "Explain this in German.", "", False)[0] == "language"


def test_rewritings():
    assert defect(OLD.upper(), Q, OLD, True)[0] == "copy"
    assert defect("The proof bounds the buffer by 3.5 times the margin.", "Shorten this", OLD, True)[0] == ""
    assert defect("La preuve borne le tampon, et la perte reste faible pour tous les modèles.", Q, OLD, True)[0] == "language"


def test_parts():
    assert _lcs(list("abcbdab"), list("bdcaba")) == 4 and _lcs([], ["a"]) == 0 and _lcs(["a"], []) == 0
    assert not is_copy("", Q) and not is_copy("x", "")
    assert language("这是一个测试") == "zh" and language("") is None and language("42") is None
    assert language("¿Por qué necesita el modelo la capa?") == "es" and language("Pourquoi le modèle a-t-il besoin de la couche ?") == "fr"


def test_table(spark):
    rows = [(1, Q, None, "", ""), (2, Q, "It drops.", OLD, OLD), (3, None, "Fine.", None, None), (3, None, "Fine.", None, None)]
    df = spark.createDataFrame(rows, "id long, comment string, ai_reply string, ai_old_text string, ai_new_text string").withColumn("defect", F.lit("clash"))
    out = judge(df, "id", {"ai_reply": (F.col("ai_reply"), False), "ai_new_text": (F.col("ai_new_text"), True)}, F.coalesce("comment", F.lit("")), F.coalesce("ai_old_text", F.lit("")))
    assert {(r.id, r.answer, r.defect) for r in out.collect()} == {(1, "ai_reply", "empty"), (2, "ai_new_text", "copy")}


@pytest.mark.parametrize(
    "text, want",
    [
        ("Il modello perde tre punti perché la memoria non è più disponibile nella seconda fase.", "it"), ("O modelo perde três pontos porque a memória não está disponível na segunda fase.", "pt"), ("Het model verliest drie punten omdat het geheugen niet meer wordt gebruikt.", "nl"),
        ("このモデルは第二段階で性能が下がります。", "ja"), ("이 모델은 두 번째 단계에서 성능이 떨어집니다.", "ko"), ("Модель теряет три пункта на втором этапе.", "ru"), ("The model loses three points since the memory isn't there in the second phase.", "en"),
        ("Das Modell verliert drei Punkte, weil der Speicher in der zweiten Phase fehlt.", "de"), ("Le modèle perd trois points parce que la mémoire manque dans la seconde phase.", "fr"), ("El modelo pierde tres puntos porque la memoria no está en la segunda fase.", "es"), ("模型在第二阶段下降三个百分点。", "zh"),
    ],
)
def test_languages(text, want):
    assert language(text) == want


def test_copy_after_repetitions():
    """All of a long answer is aligned: the whole prompt comes only after a part of it was said again and again."""
    part = " ".join(Q.split()[:5])
    assert is_copy(" ".join([part] * 12) + " " + Q, Q)
