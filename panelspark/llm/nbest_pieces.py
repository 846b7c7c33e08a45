"""SentencePiece encoding with the N best segmentations, and decoding.

A text is written with a leading space and ``▁`` for spaces, and its lattice holds
every piece of the model at every place where it stands; a character that is no piece
is one node below any piece's score, and is encoded as its UTF-8 bytes. A
segmentation's score is the sum of its pieces' scores.

The results are the N best segmentations, best first: their scores and piece ids. Beside them stand
the ids of the model's own encoding, by the library. In a BPE model scores are the ranks
of merges, and the segmentation with the best sum isn't its encoding. Merges don't cross the parts below either, so parts are
encoded alone and remembered. The library reads a ``▁`` in a text as a space; here it is
encoded as its bytes, so that decoding gives it back.

The lattice falls apart where no piece crosses: before a run of spaces, at line breaks,
and, in parts of over ``LONG`` characters, at any such place; what is left in one piece is
held in flat arrays. Each part is solved by a forward Viterbi pass, which carries the two best scores of
each place. The N best of a text deviate in at
most N - 1 parts, those with the nearest second best. There a backward A-star search
takes the forward scores as its heuristic, which is exact, so segmentations come out
of it in order. Sums of the parts' lists then give the text's N best.

Decoding gives the text back exactly. A null text has no pieces (score 0, one empty
segmentation); repeated rows are encoded each; an empty table gives an empty result;
columns other than doc_id and text are not read by :func:`segment`.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Longest part that is remembered, and how many are, by themselves and with their lists.
KEEP_CHARS, KEEP_PARTS, KEEP_LISTS = 64, 600_000, 20_000
#: Parts longer than this are cut wherever no piece crosses.
LONG = 256


class Pieces:
    """A model's pieces, and segmentation by them."""

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int], model, keep: int = KEEP_PARTS) -> None:
        self.pieces, self.byte_ids, self.model, self.keep = pieces, byte_ids, model, keep
        self.root: dict = {}  # character -> [following characters, (score, id) of the piece that ends here or None]
        for piece, (i, score) in pieces.items():
            following, node = self.root, None
            for c in piece:
                node = following.setdefault(c, [{}, None])
                following = node[0]
            node[1] = (score, i)
        self.unknown = min(s for _, s in pieces.values()) - UNKNOWN_PENALTY
        self.bytes_of = {i: p.replace(SPACE, " ").encode() for p, (i, _) in pieces.items()} | {b: bytes([k]) for k, b in enumerate(byte_ids)}
        inner = "".join(p[1:] for p in pieces) + "".join(p[:-1] for p in pieces)
        if any(SPACE in p.lstrip(SPACE) for p in pieces):
            self.parts = re.compile(r".+", re.DOTALL)
        elif "\n" in inner:
            self.parts = re.compile(r" *[^ ]+| +")
        else:
            self.parts = re.compile(r"\n| *[^ \n]+| +")
        #: What is known of parts, in two generations: the older one goes when the newer is full.
        self.known: dict[str, tuple[bytes, float, float, bytes]] = {}
        self.older: dict[str, tuple[bytes, float, float, bytes]] = {}
        self.listed: dict[tuple[str, int], list[tuple[float, list[int]]]] = {}

    @classmethod
    def load(cls, path: str, keep: int = KEEP_PARTS) -> Pieces:
        """From a SentencePiece model file; up to twice ``keep`` parts, of some 300 bytes each, are remembered."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        return cls({model.id_to_piece(i): (i, model.get_score(i)) for i in plain}, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], model, keep)

    def encode(self, part: str) -> array:
        """The model's own encoding of a text with its leading space, or of a part of one."""
        stand_in = ""
        if SPACE in part:
            stand_in = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in part and c not in self.root)
            part = part.replace(SPACE, stand_in)
        if part[0] == " ":  # the library writes the first space itself
            ids = self.model.encode(part[1:], num_threads=1) if part[1:] else self.model.encode("\n", num_threads=1)[:-1]
        else:  # a line break stands alone
            ids = self.model.encode(f"\n{part}", num_threads=1)[2:]
        if stand_in:
            was, now = ([self.byte_ids[b] for b in c.encode()] for c in (stand_in, SPACE))
            for i in range(len(ids) - 2):
                if ids[i : i + 3] == was:
                    ids[i : i + 3] = now
        return array("i", ids)

    def cut(self, part: str) -> Iterator[str]:
        """The part in pieces of its own, cut at every place that no piece crosses: segmentations of
        either side don't depend on the other, and merges stay on their side."""
        written, root, start, reach = part.replace(SPACE, "\0").replace(" ", SPACE), self.root, 0, 1
        for i in range(len(part)):
            if i >= reach:
                yield part[start:i]
                start = i
            node, j = root.get(written[i]), i + 1
            reach = max(reach, j)
            while node is not None:
                if node[1] is not None:
                    reach = max(reach, j)
                if j == len(part):
                    break
                node = node[0].get(written[j])
                j += 1
        yield part[start:]

    def forward(self, part: str) -> tuple:
        """The lattice's nodes in order of their start, in columns: starts, ends, scores and pieces (-1:
        unknown); the best score up to each place, and the node by which it is reached."""
        n, root, unknown = len(part), self.root, self.unknown
        if n <= LONG:  # lists are faster, arrays are smaller
            starts, ends, scores, pieces, best, via = [], [], [], [], [0.0] + [-math.inf] * n, [-1] * (n + 1)
        else:
            starts, ends, scores, pieces = array("i"), array("i"), array("d"), array("i")
            best, via = array("d", [0.0]) + array("d", [-math.inf]) * n, array("q", [-1]) * (n + 1)
        start, end, value, name, count = starts.append, ends.append, scores.append, pieces.append, 0
        written = part.replace(SPACE, "\0").replace(" ", SPACE)
        for i in range(n):
            node, j, upto = root.get(written[i]), i, best[i]
            if node is None or node[1] is None:
                if upto + unknown > best[i + 1]:
                    best[i + 1], via[i + 1] = upto + unknown, count
                start(i), end(i + 1), value(unknown), name(-1)
                count += 1
            while node is not None:
                following, piece = node
                j += 1
                if piece is not None:
                    score, which = piece
                    through = upto + score
                    if through > best[j]:
                        best[j], via[j] = through, count
                    start(i), end(j), value(score), name(which)
                    count += 1
                if j == n:
                    break
                node = following.get(written[j])
        return starts, ends, scores, pieces, best, via

    def ids(self, part: str, path: list[tuple[int, int, int]]) -> array:
        """The piece ids of a path of (start, end, piece)."""
        out = array("i")
        for i, j, piece in path:
            if piece >= 0:
                out.append(piece)
            else:
                out.extend(self.byte_ids[b] for b in part[i:j].encode())
        return out

    def solve(self, part: str) -> tuple[bytes, float, float, bytes]:
        """The encoding's ids, the best segmentation's score, how much the second best falls short, and the best one's ids."""
        n = len(part)
        if part in self.older:
            found = self.known[part] = self.older.pop(part)
            return found
        root, unknown = self.root, self.unknown
        if n <= LONG:  # lists are faster, arrays are smaller
            best, second, back, name = [0.0] + [-math.inf] * n, [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        else:
            best, second = array("d", [0.0]) + array("d", [-math.inf]) * n, array("d", [-math.inf]) * (n + 1)
            back, name = array("i", [0]) * (n + 1), array("i", [-1]) * (n + 1)
        written = part.replace(SPACE, "\0").replace(" ", SPACE)
        for i in range(n):
            node, j, upto, under = root.get(written[i]), i, best[i], second[i]
            if node is None or node[1] is None:
                through, so_far = upto + unknown, best[i + 1]
                if through > so_far:
                    second[i + 1] = max(so_far, under + unknown)
                    best[i + 1], back[i + 1], name[i + 1] = through, i, -1
                elif through > second[i + 1]:
                    second[i + 1] = through
            while node is not None:
                following, piece = node
                j += 1
                if piece is not None:
                    score, which = piece
                    through, so_far = upto + score, best[j]
                    if through > so_far:
                        other = under + score
                        second[j] = so_far if so_far > other else other
                        best[j], back[j], name[j] = through, i, which
                    elif through > second[j]:
                        second[j] = through
                if j == n:
                    break
                node = following.get(written[j])
        path, at = [], n
        while at:
            path.append((back[at], at, name[at]))
            at = back[at]
        encoding, first = self.encode(part).tobytes(), self.ids(part, path[::-1]).tobytes()
        found = (encoding, best[n], best[n] - second[n], encoding if first == encoding else first)
        if n <= KEEP_CHARS:
            if len(self.known) >= self.keep:
                self.known, self.older = {}, self.known
            self.known[part] = found
        return found

    def lists(self, part: str, n: int) -> list[tuple[float, list[int]]]:
        """:meth:`nbest`, remembered for short parts: the same common words deviate in many texts."""
        found = self.listed.get((part, n))
        if found is None:
            found = self.nbest(part, n)
            if len(part) <= KEEP_CHARS:
                if len(self.listed) >= KEEP_LISTS:
                    self.listed.clear()
                self.listed[part, n] = found
        return found

    def nbest(self, part: str, n: int) -> list[tuple[float, list[int]]]:
        """The ``n`` best segmentations of a part, best first, by backward A-star search."""
        starts, ends, scores, pieces, best, _ = self.forward(part)
        order = np.argsort(np.asarray(ends), kind="stable")
        upto = np.searchsorted(np.asarray(ends)[order], np.arange(len(part) + 2))
        taken, out, turn = array("i", [0]) * (len(part) + 1), [], 0
        agenda: list[tuple] = [(-best[-1], 0, len(part), 0.0, None)]
        while agenda and len(out) < n:
            _, _, at, behind, path = heapq.heappop(agenda)
            if taken[at] >= n:  # n better ways from here to the end are known
                continue
            taken[at] += 1
            if at == 0:
                nodes, i = [], 0
                while path:
                    (j, piece), path = path
                    nodes.append((i, j, piece))
                    i = j
                out.append((behind, list(self.ids(part, nodes))))
                continue
            for edge in order[upto[at] : upto[at + 1]].tolist():
                i, piece, score = starts[edge], pieces[edge], scores[edge]
                turn += 1
                heapq.heappush(agenda, (-(behind + score + best[i]), turn, i, behind + score, ((at, piece), path)))
        return out

    def segment(self, text: str, n: int) -> tuple[bytes, list[float], list[bytes]]:
        """The encoding's ids (32-bit numbers), and the scores and ids of the ``n`` best, best first."""
        if not text:
            return b"", [0.0], [b""]
        known, parts = self.known.get, self.parts.findall(f" {text}")
        if max(map(len, parts)) > LONG:
            parts = [x for p in parts for x in (self.cut(p) if len(p) > LONG else (p,))]
        ids, best, short, first = zip(*[known(p) or self.solve(p) for p in parts], strict=True)
        total, ways = sum(best), [(0.0, {})]  # how much a way falls short, and the parts in which it isn't the best
        for i in heapq.nsmallest(n - 1, range(len(parts)), key=short.__getitem__):
            if short[i] < math.inf:
                own = self.lists(parts[i], n)
                ways = sorted(((a + (s - own[0][0]), {**w, i: x} if turn else w) for a, w in ways for turn, (s, x) in enumerate(own)), key=lambda w: -w[0])[:n]
        found, held = [], list(first)
        for _, way in ways:
            for i, other in way.items():
                held[i] = array("i", other).tobytes()
            found.append(b"".join(held))
            for i in way:
                held[i] = first[i]
        return b"".join(ids), [total + s for s, _ in ways], found

    def decode(self, ids: array) -> str:
        """The text of a sequence of ids."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode()[1:]


@functools.lru_cache(maxsize=2)
def _pieces(path: str, keep: int = KEEP_PARTS) -> Pieces:
    return Pieces.load(path, keep)


def encoded(text: Column, model_path: str, n: int = 4, keep: int = KEEP_PARTS) -> Column:
    """A struct of ids, scores and nbest (the ids) of the ``n`` best segmentations, and round_trip for a column of texts."""

    @F.pandas_udf("ids array<int>, scores array<double>, nbest array<array<int>>, round_trip boolean")
    def of_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces = _pieces(model_path, keep)
        for batch in batches:
            out = []
            for text in batch:
                packed, scores, found = pieces.segment(text or "", n)
                ids = array("i", packed)
                out.append((ids.tolist(), scores, [array("i", x).tolist() for x in found], pieces.decode(ids) == (text or "")))
            yield pd.DataFrame(out, columns=["ids", "scores", "nbest", "round_trip"])

    return of_batches(text)


def encoding(text: Column, model_path: str, n: int = 4, keep: int = KEEP_PARTS) -> Column:
    """The same with nbest_sha256, a digest of each of the ``n`` best, in place of their ids."""

    @F.pandas_udf("ids array<int>, scores array<double>, nbest_sha256 array<string>, round_trip boolean")
    def of_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces = _pieces(model_path, keep)
        for batch in batches:
            out = []
            for text in batch:
                packed, scores, found = pieces.segment(text or "", n)
                ids = array("i", packed)
                out.append((ids.tolist(), scores, [hashlib.sha256(x).hexdigest() for x in found], pieces.decode(ids) == (text or "")))
            yield pd.DataFrame(out, columns=["ids", "scores", "nbest_sha256", "round_trip"])

    return of_batches(text)


def decoded(ids: Column, model_path: str) -> Column:
    """The texts of a column of ids."""

    @F.pandas_udf("string")
    def of_batches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = _pieces(model_path)
        for batch in batches:
            yield pd.Series([None if x is None else pieces.decode(array("i", list(x))) for x in batch], dtype="object")

    return of_batches(ids)


def encode(docs: DataFrame, model_path: str, n: int = 4, lists: bool = False, keep: int = 100_000) -> DataFrame:
    """doc_id, ids, scores, nbest_sha256 (with ``lists`` nbest, the ids of the ``n`` best) and round_trip of every row of ``docs``.

    Workers stay between the stages of a pipeline, so here they remember fewer parts (``keep``) than in :func:`segment`."""
    own = encoded if lists else encoding
    return docs.select("doc_id", own(F.col("text"), model_path, n, keep).alias("encoded")).select("doc_id", "encoded.*")


def segment(docs: DataFrame, model_path: str, n: int = 4) -> DataFrame:
    """doc_id, scores, nbest_pieces (their numbers) and nbest_sha256 (digests of their ids as 32-bit little-endian numbers) of the
    ``n`` best segmentations, n_pieces and ids_sha256 of the library's encoding, and round_trip (it decodes to the
    text) of every row of ``docs``."""

    @F.pandas_udf("scores array<double>, nbest_pieces array<int>, nbest_sha256 array<string>, n_pieces long, ids_sha256 string, round_trip boolean")
    def of_batches(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces, columns = _pieces(model_path), ["scores", "nbest_pieces", "nbest_sha256", "n_pieces", "ids_sha256", "round_trip"]
        for batch in batches:
            out = []
            for text in batch:
                packed, scores, found = pieces.segment(text or "", n)
                back = pieces.decode(array("i", packed)) == (text or "")
                digests = [hashlib.sha256(x).hexdigest() for x in found]
                out.append((scores, [len(x) // 4 for x in found], digests, len(packed) // 4, hashlib.sha256(packed).hexdigest(), back))
            yield pd.DataFrame(out, columns=columns)

    return docs.select("doc_id", of_batches(F.col("text")).alias("found")).select("doc_id", "found.*")
