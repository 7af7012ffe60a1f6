"""Words of whole texts as arrays: spans, digests and rolling window hashes."""

from __future__ import annotations

from hashlib import blake2b
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}
#: Words whose digests are summed before they are mixed.
PIECE = 16


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 to base**(n - 1) modulo 2**64, kept for a process."""
    held = _POWERS.get(int(base))
    if held is None or len(held) < n:
        size = 1 << max(16, (int(n) - 1).bit_length())
        held = np.full(size, base, np.uint64)
        held[0] = 1
        np.multiply.accumulate(held, out=held)
        _POWERS[int(base)] = held
    return held[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64 bits, so that every bit depends on all."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of bytes."""
    edge = np.empty(len(data) + 2, bool)
    edge[0] = edge[-1] = True
    np.take(_BLANK, data, out=edge[1:-1])
    at = np.flatnonzero(edge[1:] != edge[:-1])
    return at[::2], at[1::2]


def word_digests(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(digests, words of each text): two 64-bit halves of a cryptographic digest of every word, in order.

    Words are told apart by their bytes; Arrow splits the texts and numbers the
    different words, each of which is digested once.
    """
    data = pa.array(texts, pa.large_binary())
    split = pc.ascii_split_whitespace(pa.Array.from_buffers(pa.large_string(), len(data), data.buffers()))
    flat = split.flatten()
    real = pc.not_equal(pc.binary_length(flat), 0)  # blanks at the ends of a text leave empty ones
    before = np.concatenate(([0], np.cumsum(real.to_numpy(zero_copy_only=False))))
    coded = flat.filter(real).dictionary_encode()
    _, ends, held = coded.dictionary.buffers()
    ends = np.frombuffer(ends, np.int64, len(coded.dictionary) + 1, coded.dictionary.offset * 8).tolist() if len(coded.dictionary) else [0]
    held = held.to_pybytes() if held is not None else b""
    own = b"".join([blake2b(held[a:b], digest_size=16).digest() for a, b in pairwise(ends)])
    return (np.frombuffer(own, "<u8").astype(np.uint64).reshape(-1, 2)[coded.indices.to_numpy()],
            np.diff(before[split.offsets.to_numpy()]))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive words, given as digests.

    Sums of digests times powers roll over short pieces only: over long ones, sequences built like Thue and Morse's would cancel
    modulo 2**64. The pieces of a window are mixed one after the other.
    """
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    piece = min(width, PIECE)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _powers(_BASE, len(words)), out=total[1:])
    rolled = mixed((total[piece:] - total[:-piece]) * _powers(_INVERSE, len(words) - piece + 1))
    out = rolled[:n]
    for at in range(piece, width, piece):
        at = min(at, width - piece)
        out = mixed(out * _BASE + rolled[at:at + n])
    return out
