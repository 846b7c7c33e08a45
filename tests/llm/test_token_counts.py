"""Counts against the library's own, in one piece and spliced."""

import json
import random

import public_tokenizers
from tokenizers import Tokenizer

from panelspark.llm import token_counts as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "a", "it's  the\n\n end ", "x <|endoftext|> y<|endoftext|>", "\x1c a\x85b\xa0 c", "über 12³ ½ ☃ 漢字 𐍈 ",
    "a" * 5000, " " * 3000 + "b", "we'll\t\tdon't 'S 's", "é ​ x ١٢٣", "\n".join(["foo  bar, baz! "] * 400),
]


def test_counts_equal_the_library(spark):
    library = Tokenizer.from_file(PATH)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(0, None), (1, TEXTS[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens")
    got = {(r.doc_id, r.n_tokens, r.n_bytes) for r in tc.count_tokens(docs, PATH, chunk_chars=256, overlap_chars=16).collect()}
    want = {(i, len(library.encode(t or "", add_special_tokens=False)), len((t or "").encode())) for i, t in rows}
    assert got == want


def test_ordinary_texts_are_spliced(monkeypatch):
    """With production parameters a text of some pages goes through several chunks."""
    library, counted, rng = Tokenizer.from_file(PATH), tc.Counted(PATH), random.Random(5)
    text = " ".join("".join(rng.choices("abcdeé", k=rng.randrange(1, 9))) for _ in range(3000))
    chunks, plain = [], counted.boundaries
    monkeypatch.setattr(counted, "boundaries", lambda t: chunks.append(len(t)) or plain(t))
    assert tc.count_spliced(counted, text, 2048, 256) == len(library.encode(text, add_special_tokens=False))
    assert sum(n == 2048 for n in chunks) > 5 and max(chunks) == 2048


def test_splicing_holds_on_random_texts():
    library, counted, rng = Tokenizer.from_file(PATH), tc.Counted(PATH), random.Random(7)
    parts = ["the", " the", "  ", "\n", "'ll", "<|endoftext|>", "é", "☃", "12", "!?", "x" * 90, "<|end", "　"]
    for _ in range(60):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(0, 700)))
        assert tc.count_spliced(counted, text, 200, 8) == len(library.encode(text, add_special_tokens=False))


def test_empty_table(spark):
    assert tc.count_tokens(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_other_tokenizers_are_not_spliced(spark, tmp_path):
    """A normaliser, a first space, other patterns, or added tokens that take white space: counts are the library's all the same."""
    other = public_tokenizers.path("word_bpe_49k.json")
    settings = json.loads(Tokenizer.from_file(PATH).to_str())
    assert tc.spliceable(settings) and not tc.spliceable(json.loads(Tokenizer.from_file(other).to_str()))
    changes = [
        lambda s: s.update(normalizer={"type": "Lowercase"}), lambda s: s["pre_tokenizer"].update(add_prefix_space=True),
        lambda s: s["added_tokens"][0].update(lstrip=True), lambda s: s.update(truncation={"direction": "Right", "max_length": 5, "strategy": "LongestFirst", "stride": 0}),
    ]
    paths = [other]
    for i, change in enumerate(changes):
        own = json.loads(json.dumps(settings))
        change(own)
        assert tc.spliceable(own) == (i == 3)  # truncation is switched off
        (tmp_path / f"{i}.json").write_text(json.dumps(own))
        paths.append(str(tmp_path / f"{i}.json"))
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for path in paths:
        library = Tokenizer.from_file(path)
        library.no_truncation()
        got = {r.doc_id: r.n_tokens for r in tc.count_tokens(docs, path, chunk_chars=256, overlap_chars=16).collect()}
        assert got == {i: len(library.encode(t, add_special_tokens=False)) for i, t in enumerate(TEXTS)}
