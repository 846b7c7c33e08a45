"""Token counts of whole texts, as the tokenizer library gives them.

Texts are cut into overlapping chunks of ``chunk_chars`` which are encoded with offsets
and spliced where two neighbouring encodings share a proven boundary: both end a
pre-token there, after a character that is no white space and at least ``GUARD``
characters before the left chunk's end. What follows such a place is encoded the same
whichever text stands before it, since the pre-tokenizer looks ahead only, and less far
than that. Where the overlap holds no such place (a pre-token longer than the overlap),
the overlap is doubled; where the whole chunk has none, the chunk is. What is left after
the last place, or a text of one chunk, is counted as it stands.

That holds for tokenizers whose pre-tokens are those of the usual byte-level pattern, which :func:`spliceable`
makes sure of when one is loaded; with any other, each text is encoded in one piece.

Nulls count as empty (0 tokens), repeated rows are counted each, an empty table
gives an empty result, and columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import functools
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters that a pre-token boundary's proof needs to its right: longer than any
#: added token's string.
GUARD = 64
#: Characters whose class (letter, number, space, other) is the same in every
#: Unicode version; texts of these alone may be split here instead of in the library.
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
_PLAIN = re.compile(r"[\t-\r -~¡-ɏ]*")
_PRE_TOKEN = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+"
)


def spliceable(settings: dict) -> bool:
    """Whether a tokenizer (its file's content) splits texts by the byte-level pattern alone: no normaliser, no first
    space, and added tokens that are shorter than ``GUARD`` and take nothing of what stands around them."""
    split, model = settings.get("pre_tokenizer") or {}, settings.get("model") or {}
    own = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
    plain = settings.get("normalizer") is None and model.get("type") == "BPE" and not model.get("continuing_subword_prefix") and not model.get("dropout")
    added = settings.get("added_tokens") or []
    apart = all(len(t["content"]) < GUARD and not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in added)
    return bool(own and plain and apart)


class Counted:
    """Counts tokens with a library tokenizer, remembering up to ``keep`` pre-tokens."""

    def __init__(self, path: str, keep: int = 250_000) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.spliceable = spliceable(json.loads(self.tokenizer.to_str()))
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.keep, self.known = keep, {}

    def sizes(self, pre_tokens: list[str]) -> list[int]:
        """Tokens of each pre-token, from the library for those not seen before."""
        known = self.known
        new = [p for p in pre_tokens if p not in known]
        if new:
            if len(known) + len(new) > self.keep:
                known.clear()
                new = pre_tokens
            encoded = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
            known.update(zip(new, map(len, encoded), strict=True))
        return [known[p] for p in pre_tokens]

    def plain(self, text: str) -> bool:
        """Whether this text may be split into pre-tokens here."""
        return _PLAIN.fullmatch(text) is not None and not any(a in text for a in self.added)

    def count(self, text: str) -> int:
        """Tokens of a text that fits in one chunk."""
        if not self.plain(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False))
        found = Counter(_PRE_TOKEN.findall(text))
        return sum(n * k for n, k in zip(found.values(), self.sizes(list(found)), strict=True))

    def boundaries(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ends of the pre-tokens that end in no white space, and the tokens up to each."""
        if self.plain(text):
            pieces = [(m.end(), m.group()) for m in _PRE_TOKEN.finditer(text)]
            ends = np.array([e for e, _ in pieces], dtype=np.int64)
            tokens = np.cumsum(np.array(self.sizes([p for _, p in pieces]), dtype=np.int64))
        else:
            encoded = self.tokenizer.encode(text, add_special_tokens=False)
            words = np.array([-1 if w is None else w for w in encoded.word_ids], dtype=np.int64)
            last = np.flatnonzero(np.append(words[1:] != words[:-1], True)) if len(words) else words
            ends = np.array([encoded.offsets[i][1] for i in last], dtype=np.int64)
            tokens = last + 1
        solid = np.array([e > 0 and not text[e - 1].isspace() for e in ends], dtype=bool)
        return ends[solid], tokens[solid]


def count_spliced(counted: Counted, text: str, chunk: int, overlap: int) -> int:
    """Tokens of a text of any length, by overlapping chunks of ``chunk`` characters."""
    if not counted.spliceable:
        return len(counted.tokenizer.encode(text, add_special_tokens=False))
    total, start, end = 0, 0, min(chunk, len(text))  # tokens before start are in total; start is a proven boundary
    while end < len(text):
        ends, tokens = counted.boundaries(text[start:end])
        ends, reach, lap, at = ends + start, end - GUARD, overlap, None
        while at is None and end - lap > start:
            # the next chunk's own encoding of the overlap: it knows nothing of what stands before
            own, _ = counted.boundaries(text[end - lap : end])
            common = np.intersect1d(ends[ends <= reach], own + (end - lap))
            if len(common):
                at = int(common[-1])
            lap *= 2
        if at is None:  # no boundary in the whole chunk: make the chunk itself longer
            end = min(len(text), end + (end - start))
            continue
        total += int(tokens[np.searchsorted(ends, at)])
        start, end = at, min(len(text), at + chunk)
    return total + counted.count(text[start:])


@functools.lru_cache(maxsize=2)
def _counted(path: str) -> Counted:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Counted(path)


def token_count(text: Column, tokenizer_path: str, chunk_chars: int, overlap_chars: int) -> Column:
    """Tokens of ``text`` (null: 0). Texts go to Python in Arrow batches; nothing is shuffled."""

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counted = _counted(tokenizer_path)
        for batch in batches:
            yield pd.Series(
                [0 if t is None else count_spliced(counted, t, chunk_chars, overlap_chars) for t in batch],
                dtype="int64",
            )

    return tokens(text)


def count_tokens(
    docs: DataFrame, tokenizer_path: str, limit: int = 1024, chunk_chars: int = 2_048, overlap_chars: int = 256
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row of ``docs``."""
    return docs.select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        token_count(F.col("text"), tokenizer_path, chunk_chars, overlap_chars).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)
