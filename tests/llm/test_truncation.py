from pyspark.sql import functions as F

from paperlens.llm.answers import judge
from paperlens.llm.endings import CUT, ENDS, OPEN, ending
import random

from paperlens.llm.nearcopy import similarity
from paperlens.llm.truncation import _whole_share, aligned, cut_copies, outcome, settle, terminality


def test_endings():
    for text in ("All is said.", "说完了。", 'He said "yes."', "a\n\n| x | y |\n|---|---|\n| 1 | 2 |", "a\n```\nx = 1\n```", "$$a = b$$", "![x](figure/3)", "(see Figure 3)", "「引文」", "42", "Table 2", "Done!  \n\n", "<p></p>", "- one item."):
        assert ending(text)[0] == ENDS, text
    for text in ("It ends in the mid…", "It ends ...", "broken �", "```\nx = 1", "$$a = \\frac{", "| x | y |\n|---|---|\n| 1 | ", "![x](fig", "see (Figure", "## Heading", "and `code", "cut [cut]"):
        assert ending(text)[0] == CUT, text
    for text in ("It ends in the", "它在这里停"):
        assert ending(text) == (OPEN, "text", ending(text)[2])
    assert ending("- item with 3 samples") == (OPEN, "list", "samples")
    assert ending("") == ending("  \n")  == (ENDS, "none", "")


def test_closing_words(spark):
    rows = [(i, f"Text.\n\n- Setting A with {i} samples\n- Setting B with {i} samples\n\nEnd.") for i in range(10)]
    rows += [(100 + i, f"The gain on the sets is {i}.5 points on MMLU. Best of all, the model agreed.\n\nThanks") for i in range(10)] + [(200, "Thanks\nEnd.")]
    words = terminality(spark.createDataFrame(rows, "id long, text string"))
    tail = [(1, "list", "samples"), (2, "list", "with"), (3, "text", "the"), (4, "list", "samp"), (5, "text", "MMLU".casefold()), (6, "text", "agreed"), (7, "text", "thanks"), (8, "text", "sets")]
    got = settle(spark.createDataFrame(tail, "id long, kind string, word string"), words).collect()
    assert {r.id: r.cut for r in got} == {1: False, 2: True, 3: True, 4: True, 5: False, 6: False, 7: False, 8: True}
    assert terminality(spark.createDataFrame([(None,), ("",)], "text string")).count() == 0
    assert settle(spark.createDataFrame([], "id long, kind string, word string"), words).count() == 0


def test_share_of_whole_texts():
    """Where nearly all open texts end in words that close nothing, a word must close much oftener than it stands to speak for a whole text."""
    assert _whole_share([(1.0, 3), (None, 97)]) < 0.1 < 0.9 < _whole_share([(1.0, 97), (None, 3)])
    assert _whole_share([]) == 0.5


def test_copies(spark):
    long = "The proof bounds the compact buffer by many times the margin of the former one, and it lowers the final calibration error of all models here by 47.78 points."
    cut = long[: long.index("78 points")]
    other = long.replace("compact", "wide") + " A second sentence follows."
    assert similarity(cut, long) >= 0.8
    rows = [(1, long), (2, cut), (3, long), (4, None), (5, ""), (6, "other words entirely"), (7, other), (8, cut)]
    assert {r.id for r in cut_copies(spark.createDataFrame(rows, "id long, text string")).collect()} == {2, 8}
    assert cut_copies(spark.createDataFrame([], "id long, text string")).count() == 0


def test_family_of_copies(spark):
    """The longest text of a bucket has another ending; the one that goes on has an edit in the last characters before the cut."""
    body = " ".join(f"word{i} stands{i * 7 % 40} here{i % 13}" for i in range(700))
    whole = body + " and it lowers the final error of all models here by 47.78 points."
    cut = whole[: whole.index("78 points")]
    edited = cut.replace("models here", "models there")
    others = [f"{body} in other words at length {i} of a family that has endings of its own kinds." for i in range(12)]
    rows = list(enumerate([whole, cut, edited, whole, cut, *others]))
    assert {r.id for r in cut_copies(spark.createDataFrame(rows, "id long, text string")).collect()} == {1, 2, 4}


def test_aligned():
    text = "The loss falls by 4.5 points. In the end the loss falls by 4.5 points again."
    assert aligned("The loss falls by 4.", text) == 20
    assert aligned("The loss falls by 4.5 points. In the end the loss falls by 4.", text) == 61
    assert aligned("The loss fell by 4.", text) == 20
    assert aligned("Nothing of the kind is said", text) == -1


def test_rows(spark):
    df = spark.createDataFrame([(1, "It stops in the"), (2, None), (3, "Fine."), (4, "")], "id long, defect string")
    got = {r.id: r.defect for r in judge(df, "id", {"a": (F.col("defect"), False)}, F.lit(""), F.lit("")).collect()}
    assert got == {1: "open", 2: "empty", 4: "empty"}


def _prose(rng, words):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()) + str(rng.randrange(9)) for _ in range(words))


def test_planted_copies(spark):
    """Copies cut at a third to nine tenths of their originals, with some words typed otherwise: at least nine in ten are found."""
    rng, rows, planted = random.Random(11), [], set()
    for i in range(60):
        whole = _prose(rng, rng.randrange(150, 500)) + "."
        words = whole[: int(len(whole) * rng.uniform(0.33, 0.9))].split(" ")
        for _ in range(len(words) // 80):
            words[rng.randrange(len(words) - 12)] += "x"
        rows += [(2 * i, whole), (2 * i + 1, " ".join(words))]
        planted.add(2 * i + 1)
    found = {r.id for r in cut_copies(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert found <= planted and len(found) >= 0.9 * len(planted)


def test_typo_before_the_cut():
    whole = "The loss falls for every model that was trained on the larger set, as the last table of the paper shows in its lower half for all of them."
    assert outcome(whole[:90], whole) == "cut"
    assert outcome(whole[:90].replace("larger", "largr"), whole) in ("cut", "")  # one shingle in five goes with a word
    body = _prose(random.Random(2), 120)
    assert outcome((body[:500] + " as the last tabel of the pap"), body[:500] + " as the last table of the paper shows, " + body[500:]) == "cut"
    assert outcome(body + ".", body + ". " + body) == "" and outcome(body, body + "\n\nA new paragraph.") == ""


def test_large_family_shrinks(spark):
    """300 near-copies with one ending, in a bucket far above the group size, two of them cut: all cut ones are found, in few comparisons."""
    rng = random.Random(3)
    body = _prose(rng, 300)
    rows = [(i, f"{body} copy {i} ends here as all of its family do, with the very same words at last.") for i in range(300)]
    rows += [(1000, rows[5][1][:-30]), (1001, rows[250][1][:-12])]
    df = spark.createDataFrame(rows, "id long, text string")
    assert {r.id for r in cut_copies(df, group=16).collect()} == {1000, 1001}
