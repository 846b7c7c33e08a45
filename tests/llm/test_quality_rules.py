"""Counts and distances against plain computations."""

import math
import random
import re
from collections import Counter

from panelspark.llm import quality_rules as qr

rng = random.Random(2)
TEXTS = [
    None, "", " \n ", "a b", "a b c", "a b c a b c", "x x x x x", "# $ 100% <b>|é|</b>\n\n# $ 100% <b>|é|</b>\n \n", "A\x0bB\x0cC\tD\rE", "\x1c \x85 \xa0é 漢 𐍈",
    " ".join(rng.choice("abcdefghijkl") for _ in range(700)), "THE DOG!! " * 90, "the cat and the dog of " * 40, "the cat sat.\n" * 3, "w" * 5000, " ".join(f"w{i}" for i in range(300)), " ".join(f"THE-{i}" for i in range(300)),
] + [" ".join(rng.choice(["the", "and", "cat", "tree", "of", "run", "sky", "x1"]) for _ in range(300)) for _ in range(20)]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(zip(words, words[1:], words[2:]))
    repeat = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat), failed


def distance(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    term = lambda x, m: x * math.log2(x / m) if x else 0.0
    return math.sqrt(max(0.0, sum(term(x, (x + y) / 2) + term(y, (x + y) / 2) for x, y in zip(p, q)) / 2))


def words_in(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def histograms(text, common):
    text, words = text or "", words_in(text)
    chars = [len(re.findall(f"[{p}]", text)) for p in ("a-z", "A-Z", "0-9", r"\x20\x09-\x0D", "\x80-\U0010ffff", "#*$%&|<>")]
    held = [words.count(w) for w in common]
    return [*chars, len(text) - sum(chars)], [*held, len(words) - sum(held)]


def test_counts_and_verdicts_equal_plain(spark):
    rows = [(None if i == 3 else i % 20, t, None if i % 9 == 0 else "en", i) for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words int")
    got = Counter(map(str, (tuple(r) for r in qr.judge(docs).collect())))
    sums, held, common = {}, {}, {}
    for _, t, lang, _ in rows:
        held.setdefault(lang, Counter()).update(words_in(t))
    for lang, count in held.items():
        common[lang] = [w for w, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[: qr.COMMON]]
    for _, t, lang, _ in rows:
        sums.setdefault(lang, []).append(histograms(t, common[lang]))
    want = Counter()
    for d, t, lang, _ in rows:
        c, w = histograms(t, common[lang])
        cr, wr = ([sum(x) for x in zip(*(h[k] for h in sums[lang]))] for k in (0, 1))
        cd = distance(c, cr) if len(t or "") >= 500 else None
        wd = distance(w, wr) if sum(w) >= 200 else None
        p = plain(t)
        kept = not p[5] and not (cd is not None and cd > 0.3) and not (wd is not None and wd > 0.2)
        want[str((d, *p, kept, cd if cd is None else round(cd, 6), wd if wd is None else round(wd, 6)))] += 1
    assert got == want
    assert any(not plain(t)[5] for t in TEXTS)


def test_empty_table(spark):
    assert qr.judge(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
