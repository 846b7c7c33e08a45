"""N-best lists against all segmentations of short texts, and exact round trips."""

import random

import public_tokenizers

from panelspark.llm import nbest_pieces as nb

PATH = public_tokenizers.path("piece_bpe_32k.model")


def every(pieces, written):
    """All (score, nodes) of a text by plain recursion over the lattice's definition."""
    if not written:
        return [0.0]
    out = []
    for j in range(1, len(written) + 1):
        if written[:j] in pieces.pieces:
            out += [pieces.pieces[written[:j]][1] + s for s in every(pieces, written[j:])]
    if written[0] not in pieces.pieces:
        out += [pieces.unknown + s for s in every(pieces, written[1:])]
    return out


def score_of(pieces, packed):
    """The sum of the scores of a sequence of ids; a run of bytes of one character counts once."""
    scores, total, held = {i: s for i, s in pieces.pieces.values()}, 0.0, b""
    for i in nb.array("i", packed):
        if i in scores:
            total += scores[i]
            continue
        held += pieces.bytes_of[i]
        try:
            held.decode()
        except UnicodeDecodeError:
            continue
        total, held = total + pieces.unknown, b""
    return total


def test_nbest_of_longer_texts():
    """The lists of a text of many parts: in order, all different, each with its own score, and the text itself."""
    pieces = nb.Pieces.load(PATH)
    rng = random.Random(12)
    for _ in range(20):
        t = " ".join(rng.choice(["internationalisation", "the", "of", "Ångström", "unbelievably", "漢字", "x9"]) for _ in range(30))
        _, scores, found = pieces.segment(t, 6)
        assert len(set(found)) == 6 and scores == sorted(scores, reverse=True)
        for score, own in zip(scores, found, strict=True):
            assert pieces.decode(nb.array("i", own)) == t and abs(score_of(pieces, own) - score) < 1e-6 * abs(score)


def test_nbest_equals_all_segmentations():
    pieces = nb.Pieces.load(PATH)
    rng = random.Random(1)
    texts = ["", "a", "the cat", "  x", "hello\nyou", "☃𐍈 é", "a▁b"]
    texts += ["".join(rng.choice("the an\nioé☃") for _ in range(rng.randrange(1, 11))) for _ in range(40)]
    for t in texts:
        written = (" " + t).replace("▁", "\0").replace(" ", "▁") if t else ""
        want = sorted(every(pieces, written), reverse=True)
        for n in (1, 4, 7):
            ids, scores, found = pieces.segment(t, n)
            assert scores == want[:n], t
            assert pieces.decode(nb.array("i", ids)) == t
            assert len(set(found)) == len(found) == len(scores)
            for score, own in zip(scores, found, strict=True):
                assert pieces.decode(nb.array("i", own)) == t and abs(score_of(pieces, own) - score) < 1e-6


def test_astar_lists_are_distinct_and_in_order():
    pieces = nb.Pieces.load(PATH)
    found = pieces.nbest(" internationalisation", 50)
    scores = [s for s, _ in found]
    assert len(found) == 50 and scores == sorted(scores, reverse=True) and len({tuple(i) for _, i in found}) == 50
    assert scores[0] == pieces.solve(" internationalisation")[1] and scores[0] - scores[1] == pieces.solve(" internationalisation")[2]


def test_table_round_trips(spark):
    texts = [None, "", " lead  and trail ", "▁▁ x", "tab\tand\r\n", "w" * 3000, "漢字かな 𝄞", "the " * 2000]
    docs = spark.createDataFrame([(i // 2, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, scores int")
    rows = nb.segment(docs, PATH).collect()
    assert len(rows) == len(texts) and all(r.round_trip for r in rows)
    ids = docs.select("text", nb.encoded(docs.text, PATH).alias("e")).select("text", nb.decoded(nb.F.col("e.ids"), PATH).alias("back"))
    assert all(r.back == (r.text or "") for r in ids.collect())
    assert nb.segment(docs.limit(0), PATH).collect() == []
    lists, digests = (nb.encode(docs, PATH, lists=x).collect() for x in (True, False))
    packed = [[nb.hashlib.sha256(nb.array("i", x).tobytes()).hexdigest() for x in r.nbest] for r in lists]
    assert packed == [list(r.nbest_sha256) for r in digests] == [list(r.nbest_sha256) for r in rows]
    assert all([len(x) for x in r.nbest] == list(s.nbest_pieces) for r, s in zip(lists, rows, strict=True))


def test_long_parts_are_cut_where_no_piece_crosses(monkeypatch):
    import sentencepiece

    model, pieces = sentencepiece.SentencePieceProcessor(model_file=PATH), nb.Pieces.load(PATH)
    rng = random.Random(6)
    for letters, size in (("ABCDEFGHabcdefgh0123+/", 3000), ("漢字かなカナ☃é", 3000), ("theanio", 2000), ("x", 3000)):
        text = "".join(rng.choice(letters) for _ in range(size))
        assert "".join(pieces.cut(f" {text}")) == f" {text}"
        ids, scores, _ = pieces.segment(text, 4)
        assert list(nb.array("i", ids)) == model.encode(text)
        monkeypatch.setattr(nb, "LONG", 10**9)
        whole = nb.Pieces.load(PATH).segment(text, 4)
        monkeypatch.undo()
        assert ids == whole[0] and all(abs(a - b) < 1e-6 * abs(a) for a, b in zip(scores, whole[1], strict=True))


def test_unspaced_text_of_a_megabyte():
    pieces = nb.Pieces.load(PATH)
    text = "".join(random.Random(3).choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=1_000_000))
    ids, scores, found = pieces.segment(text, 2)
    assert len(scores) == 2 and all(pieces.decode(nb.array("i", x)) == text for x in (ids, *found))
    assert max(map(len, pieces.cut(f" {text}"))) < 2000


def test_ids_are_the_models_own():
    import sentencepiece

    model, pieces = sentencepiece.SentencePieceProcessor(model_file=PATH), nb.Pieces.load(PATH)
    rng = random.Random(2)
    texts = ["the lawsuit disrupted several analytics conducting harbor programs", "", " ", "   ", "\n", "\n\n a", "a\nb  c \n", " \n ", "tab\tand\r\n", "漢字かな 𝄞", "\0x", "<s> <0x41>", "w" * 500]
    texts += ["".join(rng.choice(["the", "an", "ing", " ", "  ", "\n", "\t", "é", "☃", "Q", "7", ".", "\u00a0", "\ue000"]) for _ in range(60)) for _ in range(300)]
    for t in texts:
        assert list(nb.array("i", pieces.segment(t, 4)[0])) == model.encode(t), t
    assert len(nb.array("i", pieces.segment(texts[0], 4)[0])) == 10
    for t in ["▁", "a▁b", "▁▁ x\n▁", "\ue000▁\ue001"]:
        assert pieces.decode(nb.array("i", pieces.segment(t, 4)[0])) == t
