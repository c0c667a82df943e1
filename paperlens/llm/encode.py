"""Encoding of a corpus with a public tokenizer.

Encodings form a monoid under concatenation of texts: a text is cut into halves down to leaves, each leaf is encoded alone,
and neighbours are joined by encoding again a window around their border. The window grows to both sides until each end
lies where the tokenizer splits whatever stands further away; the ids outside it then stay as they are. Decoding goes up the same
tree, joining the bytes of the halves.

Where that is provable depends on the tokenizer. For the byte-level ones such a place is a change of character class (blank, letter,
number, other) after a character that is no blank and no apostrophe: no alternative of their pattern matches across it, and none
looks at what is before it. For those that cut at blanks it is a single blank between a plain letter or digit and a plain letter: no
piece of the vocabulary has a blank after another character, and no normalisation reaches over it. A tokenizer of which
neither is known (another pattern, another vocabulary) encodes whole texts.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

LEAF = 512
# Fixed value: the pattern for which `_splits` holds.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizer(NamedTuple):
    """encode and decode of a public tokenizer, without special tokens; `splits` tells the places where it surely splits (None: unknown),
    `skip` is 1 where a text is encoded as if a blank stood before it, so a part begins behind the blank where it splits.
    `pieces` gives the bytes of some ids where those of a text are just joined."""

    encode: Callable[[str], list[int]]
    decode: Callable[[list[int]], str]
    splits: Callable[[str, int], bool] | None
    skip: int
    pieces: Callable[[list[int]], bytes] | None


def vocabulary_path(name: str, folder: str | None = None) -> str:
    """Place of a vocabulary file: below `folder`, else where the installed package has it."""
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=8)
def load(name: str, folder: str | None = None) -> Tokenizer:
    """A public tokenizer by name."""
    if name in ("byte_bpe_50k", "byte_bpe_multi_50k"):
        import public_tokenizers
        import tiktoken

        with open(vocabulary_path(f"{name}.tiktoken", folder), "rb") as f:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        own = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return Tokenizer(own.encode_ordinary, own.decode, _splits if public_tokenizers.PATTERN == PATTERN else None, 0, own.decode_bytes)
    if name == "word_bpe_49k":
        from tokenizers import Tokenizer as Words

        words = Words.from_file(vocabulary_path(f"{name}.json", folder))
        words.encode_special_tokens = True
        apart = not any(" " in w for w in words.get_vocab())
        return Tokenizer(lambda text: words.encode(text, add_special_tokens=False).ids, words.decode, _splits_at_blank if apart else None, 1, None)
    if name == "piece_bpe_32k":
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(f"{name}.model", folder))
        apart = not any("▁" in pieces.id_to_piece(i).lstrip("▁") for i in range(pieces.get_piece_size()))
        return Tokenizer(pieces.encode, pieces.decode, _splits_at_blank if apart else None, 1, None)
    raise ValueError(f"unknown tokenizer {name!r}")


def _kind(ch: str) -> str:
    if ch.isspace():  # the pattern's \s; of the few characters on which both differ, see _splits
        return " "
    top = unicodedata.category(ch)[0]
    return top if top in "LN" else "O"


def _splits(text: str, at: int) -> bool:
    """Whether the pre-tokenizer splits at `at` whatever the rest of the text is."""
    before, after = text[at - 1], text[at]
    if before == "'" or before.isspace() or "\x1c" <= before <= "\x1f" or "\x1c" <= after <= "\x1f":
        return False
    a, b = _kind(before), _kind(after)
    return a != b


def _splits_at_blank(text: str, at: int) -> bool:
    """The same for tokenizers that cut at blanks; a blank at the end of a text is none that tells."""
    before, after = text[at - 1], text[at + 1 : at + 2]
    return text[at] == " " and before.isascii() and before.isalnum() and after.isascii() and after.isalpha()


def _left(text: str, lo: int, at: int, own: Tokenizer) -> int:
    # the character after the place must lie in the left half, too
    return next((place + own.skip for place in range(at - 2, lo, -1) if own.splits(text, place)), lo)


def _right(text: str, at: int, hi: int, own: Tokenizer) -> int:
    return next((place for place in range(at + 1, hi - 1) if own.splits(text, place)), hi)


def encode_tree(text: str, tokenizer: Tokenizer, leaf: int = LEAF) -> list[int]:
    """The ids of `text`, by halves joined over growing windows."""
    encode = tokenizer.encode
    if tokenizer.splits is None:
        return encode(text)

    def whole(lo: int, hi: int) -> list[int]:
        if hi - lo <= leaf:
            return encode(text[lo:hi])
        at = (lo + hi) // 2
        a, b = whole(lo, at), whole(at, hi)
        # The halves were encoded as texts of their own, so a window never reaches over their outer ends.
        left, right = _left(text, lo, at, tokenizer), _right(text, at, hi, tokenizer)
        keep = len(a) - len(encode(text[left:at]))
        drop = len(encode(text[at:right]))
        return a[:keep] + encode(text[left:right]) + b[drop:]

    return whole(0, len(text))


def decode_tree(ids: list[int], tokenizer: Tokenizer, leaf: int = LEAF) -> str:
    """The text of some ids: the bytes of halves are joined up the tree, so a character whose bytes lie in both comes out whole."""
    pieces = tokenizer.pieces
    if pieces is None:
        return tokenizer.decode(ids)

    def whole(lo: int, hi: int) -> bytes:
        if hi - lo <= leaf:
            return pieces(ids[lo:hi])
        at = (lo + hi) // 2
        return whole(lo, at) + whole(at, hi)

    return whole(0, len(ids)).decode("utf-8", "replace")


def encode_column(df: DataFrame, key: str, text: str, tokenizer: str = "byte_bpe_50k", folder: str | None = None, leaf: int = LEAF, counts_only: bool = False) -> DataFrame:
    """Token ids of every text: rows (key, ids), or (key, n_tokens) with `counts_only`.

    One row for each row of `df`; null and empty texts have an empty list. Strings that look like special tokens are
    ordinary text. Other columns of `df` are ignored. A text of any length is encoded whole.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(tokenizer, folder)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                ids = [encode_tree(t, own, leaf) if t else [] for t in part.column(1).to_pylist()]
                made = pa.array(list(map(len, ids)), pa.int32()) if counts_only else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), made], [key, "n_tokens" if counts_only else "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, " + ("n_tokens int" if counts_only else "ids array<int>"))


def decode_column(df: DataFrame, key: str, ids: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str | None = None, leaf: int = LEAF) -> DataFrame:
    """The texts of lists of ids: rows (key, text). Null and empty lists are empty texts; other columns are ignored."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(tokenizer, folder)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [decode_tree(x, own, leaf) if x else "" for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], [key, "text"])

    return df.select(key, ids).mapInArrow(run, f"`{key}` {kind}, text string")
