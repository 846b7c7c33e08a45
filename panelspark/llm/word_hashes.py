"""Vectorised hashes of the words of a text and of its runs of words.

Arithmetic is modulo 2 ** 64. A word's hash is a polynomial over random numbers for
its bytes, a run's a polynomial over its words' hashes; both come from prefix sums,
multiplied by the inverse power of where the run starts, and are then mixed. The same
words give the same hash wherever they stand.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
#: Odd bases of the polynomials; the random numbers of bytes come from a seed.
_BYTE_BASE, _RUN_BASES = 0x9E3779B97F4A7C15, (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
_BYTE_VALUES = np.random.default_rng(20_240_229).integers(0, 2**64, 256, dtype=np.uint64)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: The longest powers so far of each base and of its inverse, from which shorter ones are cut.
_POWERS: dict[tuple[int, bool], np.ndarray] = {}
#: Longer ones than this aren't kept.
KEEP_POWERS = 1 << 19


def powers(base: int, length: int, inverse: bool = False) -> np.ndarray:
    """The first ``length`` powers of ``base`` (or of its inverse); sizes are rounded up for reuse."""
    held = _POWERS.get((base, inverse))
    if held is None or len(held) < length:
        held = np.full(1 << max(12, (length - 1).bit_length()), pow(base, -1, 2**64) if inverse else base, dtype=np.uint64)
        held[0] = 1
        held = np.multiply.accumulate(held)
        if len(held) <= KEEP_POWERS:
            _POWERS[base, inverse] = held
    return held[:length]


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every bit of ``x`` over all bits."""
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _piece_hashes(piece: np.ndarray) -> np.ndarray:
    space = _IS_SPACE[piece]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(piece) and not space[0]:
        edges = np.concatenate(([0], edges))
    if len(edges) % 2:
        edges = np.append(edges, len(piece))
    starts, ends = edges[::2], edges[1::2]
    sums = np.empty(len(piece) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE_VALUES[piece] * powers(_BYTE_BASE, len(piece)), out=sums[1:])
    found = (sums[ends] - sums[starts]) * powers(_BYTE_BASE, len(piece), inverse=True)[starts]
    return mixed(found + (ends - starts).astype(np.uint64))


def word_hashes(text: bytes, piece_bytes: int = 1 << 19) -> np.ndarray:
    """The hash of each word ``[^\\x20\\x09-\\x0D]+`` of a text, in order.

    Long texts are hashed in pieces cut at white space, so that memory follows the
    piece (or the longest word), not the text."""
    data = np.frombuffer(text, dtype=np.uint8)
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + piece_bytes)
        while end < len(data):
            spaces = np.flatnonzero(_IS_SPACE[data[at:end]]) if end - at <= piece_bytes else np.flatnonzero(_IS_SPACE[data[end - piece_bytes : end]]) + (end - piece_bytes - at)
            if len(spaces):
                end = at + int(spaces[-1]) + 1
                break
            end = min(len(data), end + piece_bytes)
        out.append(_piece_hashes(data[at:end]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def run_hashes(words: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """The hash of each run of ``length`` consecutive words; ``which`` of two independent ones."""
    if len(words) < length:
        return np.zeros(0, dtype=np.uint64)
    base = _RUN_BASES[which]
    values = words if which == 0 else mixed(words ^ _U(0xA0761D6478BD642F))
    sums = np.empty(len(words) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(values * powers(base, len(words)), out=sums[1:])
    starts = len(words) - length + 1
    return mixed((sums[length:] - sums[:-length]) * powers(base, starts, inverse=True))
