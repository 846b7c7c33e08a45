"""Groups of near copies against all pairs compared exactly."""

import random
import re
from collections import Counter

import numpy as np
import pandas as pd

from panelspark.llm import near_copies as nc
from panelspark.llm import simhash_dedup as sh
from panelspark.llm.substring_dedup import without_repeats


def plain_shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or ({tuple(words)} if words else set())


def plain_groups(rows, similarity=0.8):
    sets = [plain_shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        known = [x for x in (low.get(find(i)), d) if x is not None]
        low[find(i)] = min(known, default=None)
    return {(d, low[find(i)]) for i, (d, _) in enumerate(rows)}


def corpus(copies=60, others=60):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    line = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [None, "", " \n", "a b", "A  B", "é"]
    base = line(300)
    for _ in range(copies):  # one crowded group, one word changed in each
        words = list(base)
        words[rng.randrange(300)] = "x%d" % rng.randrange(10_000)
        texts.append(" ".join(words))
    for _ in range(others):
        words = line(rng.randrange(30, 400))
        texts.append(" ".join(words))
        for changes in rng.sample(range(12), 2):
            own = list(words)
            for _ in range(changes):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(" ".join(own))
    return texts


def test_groups_equal_plain(spark):
    rows = [(None if i == 3 else i, t) for i, t in enumerate(corpus())]
    rows += [(7, rows[7][1]), (2000, rows[8][1])]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, node int").repartition(3)
    for room in (nc.ROOM, 8):  # the copies fill larger keys, which are cut into blocks of 8
        got = {tuple(r) for r in nc.group_near_copies(docs, room=room).collect()}
        want = plain_groups(rows)
        assert {d for d, _ in got} == {d for d, _ in want}
        whole = dict(want)
        assert all(whole[d] == whole[c] for d, c in got if d is not None)  # nothing is merged wrongly
        missed = [d for d, c in got if c != whole[d]]
        assert len(missed) <= 0.02 * len(want)  # keys are shared with odds of 0.95 at just the limit
    assert {r.doc_id for r in nc.one_near_copy(docs).collect()} == {d for d, c in got if d == c}


def test_planted_pairs_are_found(spark):
    """Pairs by similarity: at least 0.9 of those just above the limit, all of those well above; none below."""
    rng = random.Random(11)
    word = lambda: "k%d" % rng.randrange(10**6)
    texts, similarity = [], []
    for i in range(400):
        words = [word() for _ in range(200)]
        other = list(words)
        for at in rng.sample(range(0, 195, 6), (2, 3, 4, 5)[i % 4]):
            other[at + 2] = word()
        a, b = plain_shingles(" ".join(words)), plain_shingles(" ".join(other))
        similarity.append(len(a & b) / len(a | b))
        texts += [" ".join(words), " ".join(other)]
    got = dict(map(tuple, nc.group_near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()))
    found = [got[2 * i + 1] == 2 * i for i in range(400)]
    share = lambda lo, hi: np.mean([f for f, s in zip(found, similarity, strict=True) if lo <= s < hi])
    assert share(0.8, 0.84) >= 0.9 and share(0.84, 1.01) >= 0.98 and not any(f for f, s in zip(found, similarity, strict=True) if s < 0.8)
    assert all(c in (d, d - 1) for d, c in got.items())


def test_keys_follow_the_number_of_texts():
    assert nc.key_bits(10) == 16 and nc.key_bits(2**20) == 26 and nc.key_bits(2**34) == 40
    bits = nc.key_bits(1000)
    keys = nc.keys_needed(bits, 0.8)
    equal = (1 - nc.expected_distance(0.8) / nc.WIDTH) ** bits
    assert 1 - (1 - equal) ** keys >= nc.RECALL > 1 - (1 - equal) ** (keys - 1)
    groups = nc.dealt_groups(bits, keys, 3)
    assert len(groups) * 3 >= keys and all(len(set(g)) == 3 * bits for g in groups)


def test_keys_meet_whatever_tasks_hold():
    """All pairs of small keys, and all members of larger ones, from sorted blocks of any tasks."""
    rng = np.random.default_rng(4)
    key = np.repeat(rng.integers(0, 2**26, 40), rng.integers(1, 30, 40))
    node = rng.permutation(len(key)).astype(np.int64) + 2**40
    blocks = []
    for own in np.array_split(rng.permutation(len(key)), 3):
        own = own[np.lexsort((node[own], key[own]))]
        blocks.append(nc._key_block(5, key[own], node[own], 26, 2))
    rows = pd.concat([nc._met(g) for _, g in pd.concat(blocks).groupby(["part", "grp"])])
    members, pairs = rows[rows["kind"] == nc.MEMBER], {(a, b) for a, b in zip(rows["a"], rows["b"], strict=True) if b}
    for k in set(key.tolist()):
        own = sorted(node[key == k].tolist())
        if len(own) <= nc.FEW:
            assert all((a, b) in pairs for a in own for b in own if a < b)
        else:
            assert sorted(members["a"][members["key"] == k]) == own
    assert (nc._unpacked(nc._packed(node)) == node).all()


def test_distance_follows_similarity():
    rng = random.Random(5)
    a = [f"v{rng.randrange(10**6)}" for _ in range(1000)]
    b = a[:900] + [f"v{rng.randrange(10**6)}" for _ in range(100)]
    sets = plain_shingles(" ".join(a)), plain_shingles(" ".join(b))
    similarity = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    x, y = nc.wide_fingerprints([" ".join(a), " ".join(b)], 5)
    differing = int(np.bitwise_count((x ^ y).view(np.uint64)).sum())
    assert abs(differing - nc.expected_distance(similarity)) < 60


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert nc.one_near_copy(docs).collect() == []


def test_unrelated_short_texts_stay_apart(spark):
    rng = random.Random(8)
    word = lambda: "v%d" % rng.randrange(10**9)
    texts = [" ".join(word() for _ in range(rng.randrange(1, 7))) for _ in range(3000)]
    for size in (30, 53, 58, 64):  # one word more at the end: 0.8 and more; every fifth changed: no shingle in common
        base = [word() for _ in range(size)]
        texts += [" ".join(base), " ".join([*base, word()]), " ".join(w if i % 5 else word() for i, w in enumerate(base))]
    rows = list(enumerate(texts))
    got = dict(map(tuple, nc.group_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == {i: i - 1 if i >= 3000 and (i - 3000) % 3 == 1 else i for i, _ in rows}


def test_exact_links_decide(spark):
    """Pairs whose distance is taken as a link, but whose shingles are below the limit, stay apart."""
    texts = spark.createDataFrame([(0, "a b c d e f g h"), (1, "a b c d e f g x"), (2, "a b c d e y z x")], "node long, text string")
    close = spark.createDataFrame([(0, 1, 0), (1, 2, 5), (0, 2, 300)], "a long, b long, distance long")
    none = spark.createDataFrame([], "a long, b long")
    assert [tuple(r) for r in nc.verified_links(close, texts, none, 262, 5, 0.6).collect()] == [(0, 1)]
    assert nc.verified_links(close, texts, none, 262, 5, 0.8).collect() == []


def test_larger_keys_are_led_by_the_most_central(spark):
    members = spark.createDataFrame([(0, k, n) for k in range(6) for n in (7, 10 * k + 100, 10 * k + 101)], "part int, key long, node long")
    assert {(r.a, r.b) for r in nc.central_pairs(members).collect()} == {(10 * k + 100 + i, 7) for k in range(6) for i in (0, 1)}


def test_groups_of_one_key_are_compared(spark):
    """Nodes that links leave apart meet in every block of their key."""
    prints = nc.wide_fingerprints([" ".join(f"w{i}" for i in range(100))] * 12, 5)
    nodes = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(prints)], "node long, fingerprint array<long>")
    members = spark.createDataFrame([(0, 9, i) for i in range(12)] + [(1, 3, i) for i in range(4)], "part int, key long, node long")
    roots = spark.createDataFrame([(i, 0) for i in range(1, 8)] + [(9, 8)], "node long, root long")
    for room in (3, 100):
        got = {(r.a, r.b) for r in nc.crossed_pairs(members, roots, nodes, 10, room).collect()}
        group = [0] * 8 + [8, 8, 10, 11]
        assert got == {(a, b) for a in range(12) for b in range(a + 1, 12) if group[a] != group[b]}


def test_one_row_of_each_group_stays(spark):
    rng = random.Random(9)
    text = lambda: " ".join("u%d" % rng.randrange(10**6) for _ in range(80))
    same, a, b, c, d = (text() for _ in range(5))
    rows = [(1, same), (1, same), (1, same), (None, same), (None, a), (None, b), (2, a + " x"), (3, c), (3, d), (3, d), (4, c), (None, None), (None, None)]
    frame = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, row string").repartition(3)
    want = Counter([(1, same, "s"), (None, b, "s"), (2, a + " x", "s"), (3, c, "s"), (3, d, "s"), (None, None, "s")])
    kept = nc.one_near_copy(frame)
    assert Counter(map(tuple, kept.collect())) == want
    assert Counter(map(tuple, without_repeats(kept).collect())) == want
    assert Counter(map(tuple, sh.one_of_each(frame.filter("text is null or doc_id = 1")).collect())) == Counter([(1, same, "s"), (None, None, "s")])


def test_family_just_below_the_limit(spark, monkeypatch):
    """400 texts of one template that are no near copies of each other: rows stay near those of each text's own keys."""
    rng = random.Random(17)
    base = [f"t{rng.randrange(10**6)}" for _ in range(300)]
    texts = []
    for _ in range(400):
        words = list(base)
        for at in rng.sample(range(300), 24):
            words[at] = f"c{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    counted = []
    plain = nc.shared_keys
    monkeypatch.setattr(nc, "shared_keys", lambda *a: counted.append((found := plain(*a)).count()) or found)
    rows = list(enumerate(texts))
    got = dict(map(tuple, nc.group_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == dict(plain_groups(rows))
    assert max(counted) <= 1.2 * counted[0]


def test_blocks_give_fewer_links_than_texts(spark):
    """A family of which all pairs are close by the sketches: what a block gives follows its texts, and connects all that is alike."""
    rng = random.Random(23)
    template = [f"t{i}" for i in range(120)]
    texts, group = [], {}
    for i in range(150):  # thirty drafts, below the limit, of five texts each, above it
        if i % 5 == 0:
            draft = list(template)
            for at in range(i // 5 % 3 * 2, 120, 30):
                draft[at] = f"d{i}-{at}"
            draft += [f"e{i}-{k}" for k in range(10)]
        own = list(draft)
        if i % 5:
            own[rng.randrange(8, 100)] = f"c{i}"
        texts.append(" ".join(own))
        group[i] = i // 5 * 5
    sets = [nc.shingles_of(t, 5) for t in texts]
    alike = lambda a, b: (both := len(np.intersect1d(sets[a], sets[b]))) / (len(sets[a]) + len(sets[b]) - both) >= 0.8
    assert all(alike(a, b) == (group[a] == group[b]) for a in group for b in group if a % 5 == 0)
    prints = nc.wide_fingerprints(texts, 5)
    nodes = spark.createDataFrame([(i, len(x), p.tolist()) for i, (x, p) in enumerate(zip(sets, prints, strict=True))], "node long, size int, fingerprint array<long>")
    members = spark.createDataFrame([(0, 9, i) for i in range(150)] + [(1, 3, i) for i in range(0, 150, 2)], "part int, key long, node long")
    roots = spark.createDataFrame([(i, 0) for i in range(1, 5)], "node long, root long")
    own = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(sets)], "node long, shingles binary")
    for room, shingles in ((10, 1000), (1000, nc.SHINGLES_AT_ONCE)):
        pairs = nc.crossed_pairs(members, roots, nodes, 700, room).count()
        rows = nc.close_rows(members, roots, nodes, 700, room, shingles)
        assert rows.filter(f"role = {nc.TOLD}").groupBy("part", "key", "block", "sub").count().filter("count > 30").isEmpty() == (room == 10)
        links = [tuple(r) for r in nc.crossed_links(nc.in_order(rows.join(own, "node"), "sub"), 0.8, 700).collect()]
        assert pairs > 9000 and all(alike(a, b) and group[a] == group[b] for a, b in links)
        assert room == 10 or len(links) <= 149 + 74
        found = {r.node: r.root for r in nc.connected_components(spark.createDataFrame(links + [(i, 0) for i in range(1, 5)], "a long, b long")).collect()}
        assert found == group


def test_many_alike_short_texts_give_few_links(spark, monkeypatch):
    """Short texts beyond a block's room: all that is alike is connected, by fewer links than there are pairs."""
    counted = []
    plain = nc.crossed_links
    monkeypatch.setattr(nc, "crossed_links", lambda *a: counted.append((found := plain(*a)).count()) or found)
    rows = [(i, " ".join(["same", "first", "words", "of", "all"] + [f"{'abcdefgh'[i % 8]}{k}" for k in range(20)] + [f"x{i}"])) for i in range(160)]
    got = dict(map(tuple, nc.group_near_copies(spark.createDataFrame(rows, "doc_id long, text string"), room=16).collect()))
    assert got == dict(plain_groups(rows))
    assert sum(counted) <= 2 * len(rows)


def test_all_that_is_computed_counts(spark, monkeypatch):
    """Keys have met once, and no job runs between that and what they give."""
    spark.sparkContext.setJobGroup("keys-met", "")
    ran = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("keys-met"))
    jobs, met, central = [], nc.shared_keys, nc.central_pairs
    monkeypatch.setattr(nc, "shared_keys", lambda *a: (met(*a), jobs.append(ran()))[0])
    monkeypatch.setattr(nc, "central_pairs", lambda members: (jobs.append(ran()), central(members))[1])
    rows = [(i, " ".join(f"w{i % 7}-{k}" for k in range(80)) + f" x{i}") for i in range(60)]
    got = dict(map(tuple, nc.group_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == {i: i % 7 for i in range(60)}
    assert len(jobs) == 2 and 0 < jobs[0] == jobs[1]
