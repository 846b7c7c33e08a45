"""The curve's rule, and placement against a plain computation."""

import zlib
from collections import Counter
from itertools import product

from panelspark.llm import hilbert_shards as hs


def test_curve_visits_all_cells_by_unit_steps():
    for dims, bits in ((2, 3), (3, 2), (3, 4)):
        cells = sorted(product(range(1 << bits), repeat=dims), key=lambda c: hs.hilbert_index(c, bits))
        assert [hs.hilbert_index(c, bits) for c in cells] == list(range(len(cells)))
        assert all(sum(abs(a - b) for a, b in zip(c, d, strict=True)) == 1 for c, d in zip(cells, cells[1:]))


def test_runs_are_even_and_gapless(spark):
    rows = [(i % 7, "same" * (i % 5) if i % 4 else None, "hot" if i % 3 else f"s{i}", None if i % 11 == 0 else "en", i) for i in range(203)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, shard int")
    got = hs.shard_documents(docs, shards=10, bits=2, slice_rows=7).collect()
    held = Counter(r.shard for r in got)
    assert sorted(held) == list(range(10)) and max(held.values()) - min(held.values()) <= 1
    for s, n in held.items():
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n))
    want = Counter((d, len(t or "") + 16, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == want
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_curve_order_holds_across_shards(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 50), f"s{i % 9}", "en") for i in range(400)], "doc_id long, text string, source string, lang string")
    curve = {r.doc_id: r.curve for r in hs.on_curve(hs.metadata(docs), 3).collect()}
    placed = sorted(hs.shard_documents(docs, shards=7, bits=3).collect(), key=lambda r: (r.shard, r.slot))
    in_order = [curve[r.doc_id] for r in placed]
    assert in_order == sorted(in_order)


def test_strings_with_one_prefix_are_told_apart(spark):
    rows = [(i, "x", f"https://example.org/{i % 16:02d}", "en") for i in range(320)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    cuts = hs.string_cuts(hs.metadata(docs), "source_key", 4)
    assert [sum(r[2] <= c for r in rows) for c in cuts] == [80, 160, 240]
    hot = docs.withColumn("source", hs.F.when(docs.doc_id < 200, "a").otherwise(docs.source))
    assert hs.string_cuts(hs.metadata(hot), "source_key", 4)[0] == "a"


def test_empty_and_fewer_rows_than_shards(spark):
    schema = "doc_id long, text string, source string, lang string"
    assert hs.shard_documents(spark.createDataFrame([], schema)).collect() == []
    few = hs.shard_documents(spark.createDataFrame([(1, "a", None, None), (None, None, None, None)], schema), shards=40).collect()
    assert len({r.shard for r in few}) == 2 and {r.slot for r in few} == {0}


def test_written_shards_read_back(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}", "s", "en") for i in range(50)], "doc_id long, text string, source string, lang string")
    placed = hs.shard_documents(docs, shards=5)
    hs.write_shards(docs, placed, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 50 and back.filter("shard = 2").count() == 10
