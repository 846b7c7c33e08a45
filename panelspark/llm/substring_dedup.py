"""Removal of word sequences that stand more than once in a corpus.

A window is ``window`` consecutive words of one document. Words covered by a window
whose words also start anywhere else, in any document, are removed; all windows are
judged on the input.

1. A window is sketched by its minimizer: the smallest hash among its runs of half as
   many words, the first of equal ones. Equal windows that start at different places have
   equal minimizers at different places, so no repeated window is lost, and neighbouring
   windows mostly share theirs: some tenth of the places are counted.
2. Each task hashes its minimizers into count-min sketches: sorted cell numbers, coded as
   gaps of about a byte each, in blocks of ``BLOCK_CELLS`` cells. The blocks of all
   tasks are merged by Spark into one bit a cell: held twice or more. No count can be
   too low, so every repeated window is estimated repeated.
3. The bits are broadcast. Each of two rows has four to eight cells for a minimizer, whatever
   the size of the corpus. Where these are more than ``max_cells`` (2 ** 29, 64 MB of
   bits), the space of hashes is cut into slices with a sketch each, of which one is
   held at a time. A second pass hashes again and keeps only windows whose minimizer
   both rows hold repeated.
4. Those are grouped exactly by 96 bits of hash. A task sends one representative of a
   window however often it holds it (the others are settled where they are), so a
   passage in a third of all documents gives one entry a task. Groups are ranges of
   hashes, as many as keep each near ``GROUP_WINDOWS`` entries at most.
   Equal rows, whose places are equal too, send them once a task, and the same list of places counts once.
5. Documents that may have repeated windows, by a bitmap of their hashes of at most
   2 ** 28 bits, meet their places in a join by doc_id and the text's hash, where words are
   removed. All others stay where they are.

The 96 bits are two polynomials over one 64-bit hash of each word, so two windows are
taken for equal only if hashes of different words agree. A null text has no words; repeated
rows repeat each other's windows like any other documents; an empty table gives an empty
result; other columns, whatever their names, are kept by :func:`without_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import written
from panelspark.llm.word_hashes import mixed, run_hashes, word_hashes

BLOCK_CELLS = 1 << 22
#: Minimizers that a task holds before it sends them on as sketches; windows, as candidates.
SKETCH_PLACES, FLUSH_WINDOWS = 1 << 21, 1 << 19
#: Entries of one exact group of hash ranges, at most about.
GROUP_WINDOWS = 1 << 21
#: So many groups at least (a power of two of this), for all cores and an even growth.
LEAST_GROUP_BITS = 6
ROWS = 2
#: Bits of a place in a minimizer's rank, and places of a text that are ranked at once.
PLACE_BITS, PLACES_AT_ONCE = 24, 1 << 23
#: Bits of the bitmap of documents with repeats: for each document, and at most.
BITMAP_SHARE, BITMAP_BITS = 16, 28


def minimizers(words: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of a text's minimizers, their hashes, and for each window which of them is its own."""
    gram = max(1, window // 2)
    hashes, width = run_hashes(words, gram), window - gram + 1
    windows = len(words) - window + 1
    if windows < 1:
        none = np.zeros(0, dtype=np.int64)
        return none, none.astype(np.uint64), none
    chosen = np.empty(windows, dtype=np.int64)
    for at in range(0, windows, PLACES_AT_ONCE):
        some = hashes[at : at + PLACES_AT_ONCE + width - 1]
        low = some >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS) | np.arange(len(some), dtype=np.uint64)
        span = 1
        while 2 * span <= width:  # the least of each run of 1, 2, 4 .. hashes
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[: len(some) - width + 1], low[width - span :])
        chosen[at : at + len(low)] = (low & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64) + at
    first = np.append(True, chosen[1:] != chosen[:-1])
    places = chosen[first]
    return places, hashes[places], np.cumsum(first) - 1


def encode_gaps(cells: np.ndarray) -> bytes:
    """Sorted numbers as gaps: a byte below 255 ends a gap, 255 adds 255 to it."""
    gaps = np.diff(cells.astype(np.int64), prepend=0)
    long = gaps // 255
    out = np.full(int(long.sum()) + len(gaps), 255, dtype=np.uint8)
    out[np.cumsum(long + 1) - 1] = gaps % 255
    return out.tobytes()


def decode_gaps(coded: bytes) -> np.ndarray:
    """The numbers that :func:`encode_gaps` coded."""
    steps = np.frombuffer(coded, dtype=np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


def cells_of(hashes: np.ndarray, row: int, bits: int) -> np.ndarray:
    """The cell of each window in a row of the sketch."""
    return mixed(hashes + np.uint64(0x9E3779B97F4A7C15 * row & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(64 - bits)


def slice_of(hashes: np.ndarray, slices: int) -> np.ndarray:
    """The slice of the hash space that each hash lies in."""
    return mixed(hashes ^ np.uint64(0xA24BAED4963EE407)) % np.uint64(slices)


def sketches(docs: DataFrame, window: int, bits: int, slices: int = 1, which: int = 0) -> DataFrame:
    """row, block and coded cells of each task's minimizers of a slice, a cell at most twice."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, count = [], 0

        def flush() -> Iterator[pd.DataFrame]:
            hashes = np.concatenate(held) if held else np.zeros(0, dtype=np.uint64)
            out = []
            for row in range(ROWS):
                cells = np.sort(cells_of(hashes, row, bits))
                if len(cells) > 2:
                    cells = cells[np.concatenate(([True, True], cells[2:] != cells[:-2]))]
                blocks = cells // np.uint64(BLOCK_CELLS)
                cuts = np.flatnonzero(np.diff(blocks)) + 1
                for part in np.split(cells, cuts) if len(cells) else []:
                    block = int(part[0]) // BLOCK_CELLS
                    out.append((row, block, encode_gaps(part - np.uint64(block * BLOCK_CELLS))))
            if out:
                yield pd.DataFrame(out, columns=["row", "block", "coded"])

        for batch in batches:
            for text in batch["text"]:
                _, hashes, _ = minimizers(word_hashes(text.encode()), window)
                if slices > 1:
                    hashes = hashes[slice_of(hashes, slices) == which]
                if len(hashes):
                    held.append(hashes)
                    count += len(hashes)
                if count >= SKETCH_PLACES:
                    yield from flush()
                    held, count = [], 0
        yield from flush()

    return docs.select("text").mapInPandas(sketch, "row int, block int, coded binary")


def merged_bits(parts: DataFrame, bits: int) -> list[np.ndarray]:
    """For each row of the sketch, one bit a cell: whether the merged count is two or more."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        once = np.zeros(BLOCK_CELLS, dtype=bool)
        twice = np.zeros(BLOCK_CELLS, dtype=bool)
        for coded in group["coded"]:
            cells = decode_gaps(coded)
            twice[cells[1:][cells[1:] == cells[:-1]]] = True
            cells = np.unique(cells)
            twice[cells[once[cells]]] = True
            once[cells] = True
        return pd.DataFrame({"row": group["row"][:1], "block": group["block"][:1], "twice": [np.packbits(twice).tobytes()]})

    out = [np.zeros(max(1 << bits, BLOCK_CELLS) // 8, dtype=np.uint8) for _ in range(ROWS)]
    size = BLOCK_CELLS // 8
    merged = parts.groupBy("row", "block").applyInPandas(merge, "row int, block int, twice binary")
    for r in merged.toLocalIterator(prefetchPartitions=True):
        out[r["row"]][r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["twice"], dtype=np.uint8)
    return out


def _held(bits: np.ndarray, cells: np.ndarray) -> np.ndarray:
    cells = cells.astype(np.int64)
    return (bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1


def candidates(texts: DataFrame, window: int, twice, bits: int, group_bits: int, slices: int = 1, which: int = 0) -> DataFrame:
    """What tasks send of the windows that the sketch (``twice``, broadcast) estimates repeated."""

    def estimated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held, count = twice.value, [], 0

        def flush() -> Iterator[pd.DataFrame]:
            if held:
                entries = _representatives(held, group_bits)
                yield pd.DataFrame(entries, columns=["group", "keys", "hashes", "checks", "places", "more"])

        for batch in batches:
            for id_hash, text_hash, text in zip(batch["id_hash"], batch["text_hash"], batch["text"], strict=True):
                words = word_hashes(text.encode())
                _, hashes, own = minimizers(words, window)
                again = np.logical_and.reduce([_held(rows[r], cells_of(hashes, r, bits)) for r in range(ROWS)])
                if slices > 1:
                    again &= slice_of(hashes, slices) == which
                if again.any():
                    at = np.flatnonzero(again[own])
                    checks = (run_hashes(words, window, 1)[at] >> np.uint64(32)).astype(np.uint32)
                    held.append((id_hash, text_hash, run_hashes(words, window)[at], checks, at.astype(np.int32)))
                    count += len(at)
                if count >= FLUSH_WINDOWS:
                    yield from flush()
                    held, count = [], 0
        yield from flush()

    return texts.mapInPandas(estimated, "group long, keys binary, hashes binary, checks binary, places binary, more binary")


def sketch_size(words: int, window: int, max_cells: int) -> tuple[int, int]:
    """Bits of a cell's number and slices: four to eight cells for each expected minimizer."""
    width = window - max(1, window // 2) + 1
    cells = max(BLOCK_CELLS, 4 * (2 * words // (width + 1) + 1))
    slices = 1 << max(0, ((cells - 1) // max_cells).bit_length())
    return max((cells // slices - 1).bit_length(), BLOCK_CELLS.bit_length() - 1), slices


def repeated_positions(texts: DataFrame, window: int, max_cells: int) -> DataFrame:
    """id_hash, text_hash and places (32-bit positions; several rows a document) of repeated windows."""
    spark = texts.sparkSession
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    expected = max(1, total // 6)
    bits, slices = sketch_size(expected, window, max_cells)
    group_bits = max(LEAST_GROUP_BITS, (expected // (slices * GROUP_WINDOWS)).bit_length())
    out = None
    for which in range(slices):
        twice = spark.sparkContext.broadcast(merged_bits(sketches(texts, window, bits, slices, which), bits))
        found = candidates(texts, window, twice, bits, group_bits, slices, which)
        found = found.groupBy("group").applyInPandas(_repeated, "id_hash long, text_hash long, places binary")
        if slices > 1:
            found = written(found, "repeated-windows")
            twice.unpersist()
        out = found if out is None else out.unionByName(found)
    return out


_KEY = np.dtype([("id_hash", "<i8"), ("text_hash", "<i8"), ("n", "<i4")])


def _packed(keys: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, bytes]:
    """The order by document and place, and the documents with how many places each has."""
    order = np.lexsort((at, doc))
    own, counts = np.unique(doc, return_counts=True)
    packed = keys[own]
    packed["n"] = counts
    return order, packed.tobytes()


def _representatives(held: list[tuple], group_bits: int) -> list[tuple]:
    """What a task sends: one entry of each window to its group of hashes, and the places
    of windows that it holds more than once to a group below 0 (nothing to compare): as many
    groups as of hashes, and at most a flush for each."""
    keys = np.array([(x[0], x[1], 0) for x in held], dtype=_KEY)
    h, g, at = (np.concatenate([x[i] for x in held]) for i in (2, 3, 4))
    # equal rows have equal places: they count as more, but their places are sent once
    _, first, same_row = np.unique(keys, return_index=True, return_inverse=True)
    doc = np.repeat(first[same_row], [len(x[2]) for x in held])
    order = np.lexsort((g, h))
    h, g, doc, at = h[order], g[order], doc[order], at[order]
    same = (h[1:] == h[:-1]) & (g[1:] == g[:-1])
    lead = np.concatenate(([True], ~same))
    more = np.concatenate((same, [False])) & lead
    settled, out = ~lead | more, []
    if settled.any():
        own = np.unique(doc[settled].astype(np.int64) << 32 | at[settled])
        _, packed = _packed(keys, own >> 32, own)
        group = -1 - (int(keys["id_hash"][0]) & (1 << group_bits) - 1)
        out.append((group, packed, b"", b"", (own & 0xFFFFFFFF).astype(np.int32).tobytes(), b""))
    h, g, doc, at, more = (x[lead] for x in (h, g, doc, at, more))
    part = (h >> np.uint64(64 - group_bits)).astype(np.int64) if group_bits else np.zeros(len(h), dtype=np.int64)
    cuts = np.flatnonzero(np.diff(part)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(part)], strict=True):
        inner, packed = _packed(keys, doc[lo:hi], at[lo:hi])
        inner = inner + lo
        out.append((int(part[lo]), packed, h[inner].tobytes(), g[inner].tobytes(), at[inner].tobytes(), np.packbits(more[inner]).tobytes()))
    return out


def _repeated(group: pd.DataFrame) -> pd.DataFrame:
    """The places of a group's windows that stand more than once, by document. Entries that
    their own task settled make others repeated but aren't returned again."""

    def all_of(name: str, kind: type) -> np.ndarray:
        return np.concatenate([np.frombuffer(x, dtype=kind) for x in group[name]])

    packed, at = all_of("keys", _KEY), all_of("places", np.int32)
    if group["group"].iloc[0] >= 0:
        h, g = all_of("hashes", np.uint64), all_of("checks", np.uint32)
        more = np.concatenate(
            [np.unpackbits(np.frombuffer(m, dtype=np.uint8), count=len(x) // 4) for m, x in zip(group["more"], group["places"], strict=True)]
        )
        order = np.lexsort((g, h))
        same = (h[order][1:] == h[order][:-1]) & (g[order][1:] == g[order][:-1])
        again = np.zeros(len(h), dtype=bool)
        again[order[1:]] |= same
        again[order[:-1]] |= same
        again &= more == 0
    else:
        again = np.ones(len(at), dtype=bool)
    ends = np.cumsum(packed["n"])
    upto = np.concatenate(([0], np.cumsum(again)))
    los, his = upto[ends - packed["n"]], upto[ends]
    kept = at[again]
    some = his > los
    places = [kept[lo:hi].tobytes() for lo, hi in zip(los[some], his[some], strict=True)]
    return pd.DataFrame({"id_hash": packed["id_hash"][some], "text_hash": packed["text_hash"][some], "places": places})


def bit_place(bits: int) -> Column:
    """A document's bit in the bitmap, from 1."""
    return F.shiftrightunsigned(F.xxhash64("id_hash", "text_hash"), 64 - bits) + 1


def marked_rows(keyed: DataFrame, repeats: DataFrame) -> DataFrame:
    """``keyed`` with ``maybe``: false only for documents that ``repeats`` doesn't have."""
    bits = min(BITMAP_BITS, max(15, (BITMAP_SHARE * repeats.count()).bit_length()))
    place = bit_place(bits)
    bitmap = (
        repeats.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("at"))
        .groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bitmap"))
    )
    # 4 KB for each of at most 2 ** (BITMAP_BITS - 15) buckets
    found = keyed.withColumn("bucket", F.bitmap_bucket_number(place)).join(F.broadcast(bitmap), "bucket", "left")
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.call_function("substring", F.col("bitmap"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    maybe = F.col("bitmap").isNotNull() & (F.getbit(byte, (at % 8).cast("int")) == 1)
    return found.withColumn("maybe", F.coalesce(maybe, F.lit(False))).drop("bucket", "bitmap")


def cut_column(text: Column, places: Column, window: int) -> Column:
    """n_words, n_removed, kept_text (words left, joined by one space; null if none was removed) and kept_sha256."""

    @F.pandas_udf("n_words long, n_removed long, kept_text string, kept_sha256 string")
    def cut(texts: pd.Series, places: pd.Series) -> pd.DataFrame:
        out = []
        for text, parts in zip(texts, places, strict=True):
            words = (text or "").encode().split()
            if parts is None or not len(parts):
                out.append((len(words), 0, None, hashlib.sha256(b" ".join(words)).hexdigest()))
                continue
            at = np.unique(np.concatenate([np.frombuffer(p, dtype=np.int32) for p in parts]))
            edges = np.zeros(len(words) + 1, dtype=np.int64)
            edges[at] += 1
            edges[at + window] -= 1
            keep = np.cumsum(edges[:-1]) == 0
            kept = b" ".join(compress(words, keep))
            out.append((len(words), int((~keep).sum()), kept.decode(), hashlib.sha256(kept).hexdigest()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_text", "kept_sha256"])

    return cut(text, places)


def found_repeats(docs: DataFrame, window: int, max_cells: int) -> tuple[DataFrame, DataFrame]:
    """``row`` (a struct of all columns) of the documents without repeats, and row and places of
    those that have or may have some."""
    keyed = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.xxhash64("doc_id").alias("id_hash"),
        F.xxhash64("text").alias("text_hash"),
    )
    texts = keyed.filter(F.col("row.text").isNotNull()).select("id_hash", "text_hash", F.col("row.text").alias("text"))
    repeats = repeated_positions(texts, window, max_cells).groupBy("id_hash", "text_hash").agg(F.collect_set("places").alias("places"))
    repeats = written(repeats, "repeated-places")
    marked = marked_rows(keyed, repeats)
    return marked.filter(~F.col("maybe")).select("row"), marked.filter("maybe").join(repeats, ["id_hash", "text_hash"], "left").select("row", "places")


def dedup_report(docs: DataFrame, window: int = 35, max_cells: int = 1 << 29) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``docs``."""
    whole, touched = found_repeats(docs.select("doc_id", "text"), window, max_cells)
    none = F.lit(None).cast("array<binary>")
    rows = whole.select("row", cut_column(F.col("row.text"), none, window).alias("cut"))
    rows = rows.unionByName(touched.select("row", cut_column(F.col("row.text"), F.col("places"), window).alias("cut")))
    return rows.select("row.doc_id", "cut.n_words", "cut.n_removed", "cut.kept_sha256")


def without_repeats(docs: DataFrame, window: int = 35, max_cells: int = 1 << 29) -> DataFrame:
    """``docs`` with the repeated words cut from ``text``; texts without any stay as they are."""
    whole, touched = found_repeats(docs, window, max_cells)
    done = touched.select("row", cut_column(F.col("row.text"), F.col("places"), window).alias("cut"))
    text = F.coalesce("cut.kept_text", "row.text")
    cut = done.select(*(text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns))
    return whole.select("row.*").unionByName(cut)
