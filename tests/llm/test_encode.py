import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paperlens.llm.encode import decode_column, decode_tree, encode_column, encode_tree, load


NAMES = ["byte_bpe_50k", "byte_bpe_multi_50k", "word_bpe_49k", "piece_bpe_32k"]
TEXTS = st.text(alphabet=st.one_of(st.characters(exclude_categories=("Cs",)), st.sampled_from(" \t\n's'ttll.中文0123abc a b\x1c\x1f\x85​")), max_size=120)


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=150, deadline=None)
@given(text=TEXTS, leaf=st.integers(1, 9))
def test_halves_join(name, text, leaf):
    own = load(name)
    assert own.splits is not None
    ids = own.encode(text)
    assert encode_tree(text, own, leaf) == ids
    if own.pieces:
        assert decode_tree(ids, own, leaf) == text


@pytest.mark.parametrize("name", NAMES)
def test_long_texts(name):
    own = load(name)
    rng = random.Random(2)
    for text in ("a" * 9000, " " * 5000 + "x", "中" * 4000, "".join(rng.choice("ab '\n中1.") for _ in range(20000)), "<|endoftext|>" * 900, "some words of a plain text, " * 300):
        assert encode_tree(text, own, 512) == own.encode(text)


def test_windows_stop_early():
    """In a plain text a window is a few words, not the whole text."""
    from collections import Counter

    text, sizes = "these are the plain words of some text that goes on and on " * 400, Counter()
    for name in NAMES:
        own = load(name)

        def encode(part, own=own, name=name):
            sizes[name] = max(sizes[name], len(part))
            return own.encode(part)

        assert encode_tree(text, own._replace(encode=encode), 64) == own.encode(text)
    assert max(sizes.values()) <= 64


def test_unknown_pattern_encodes_whole_texts():
    own = load("byte_bpe_50k")
    assert encode_tree("ab cd " * 50, own._replace(splits=None), 8) == own.encode("ab cd " * 50)


@pytest.mark.parametrize("name", NAMES)
def test_columns(spark, name):
    rows = [(1, "Hello <|endoftext|> 世界"), (2, ""), (3, None), (3, "again " * 3000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n_tokens string")
    out = sorted((r.doc_id, list(r.ids)) for r in encode_column(df, "doc_id", "text", name, leaf=64).collect())
    encode = load(name).encode
    assert out == sorted((k, list(encode(t)) if t else []) for k, t in rows)
    assert sorted(r.n_tokens for r in encode_column(df, "doc_id", "text", name, counts_only=True).collect()) == sorted(len(x) for _, x in out)
    assert encode_column(df.limit(0), "doc_id", "text", name).count() == 0
    if name.startswith("byte"):
        back = decode_column(encode_column(df, "doc_id", "text", name, leaf=64), "doc_id", "ids", name, leaf=3)
        assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((k, t or "") for k, t in rows)


def test_same_as_the_other_library():
    from tokenizers import Tokenizer

    from paperlens.llm.encode import vocabulary_path

    other = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    for text in ("It's 12,5 % — naïve\r\n\r\n  x", "<|endoftext|> 公式 8", "\u0085 a b　c"):
        assert encode_tree(text, load("byte_bpe_50k"), 3) == other.encode(text, add_special_tokens=False).ids
