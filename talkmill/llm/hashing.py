"""Hashes of byte windows, words and word shingles, over many texts at once (numpy, inside tasks).

All are polynomials modulo the prime 2 ** 61 - 1 in a base that is drawn for each run, so two strings of n bytes,
whatever they are, have equal hashes with a chance of n / 2 ** 61 at most.
"""

from __future__ import annotations

import re
import secrets
from typing import NamedTuple

import numpy as np

_U = np.uint64
PRIME = (1 << 61) - 1
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SPACE = re.compile(rb"[\x09-\x0D\x20]")

#: Bytes of text whose words are hashed at once; powers for that many and a few more are kept.
PIECE = 1 << 20
KEPT_POWERS = PIECE + (1 << 18)
#: Bytes that a sum of 41-bit terms takes without overflow.
LONGEST_SUM = 1 << 22


class Base(NamedTuple):
    """What the polynomials are taken at: ``byte`` for a string's bytes, ``word`` for a shingle's words."""

    byte: int
    word: int


def draw() -> Base:
    """A base for one run; the driver draws it and every task of the run gets the same."""
    return Base(secrets.randbelow(PRIME - 1000) + 500, secrets.randbelow(PRIME - 1000) + 500)


#: For hashes that have to stay the same from run to run and may collide, as bins of features do.
FIXED_BASE = Base(0x13198A2E03707344, 0x0A4093822299F31D)


def fold(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    x = (x & _U(PRIME)) + (x >> _U(61))
    return np.minimum(x, x - _U(PRIME))


def times(a, b) -> np.ndarray:
    """a * b modulo PRIME, of numbers below it."""
    half = _U((1 << 31) - 1)
    a1, a0, b1, b0 = a >> _U(31), a & half, b >> _U(31), b & half
    mid = a1 * b0 + a0 * b1
    return fold(a1 * b1 * _U(2) + (mid >> _U(30)) + ((mid & _U((1 << 30) - 1)) << _U(31)) + a0 * b0)


def _raised(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1)."""
    out = np.ones(n, _U)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = times(out[:more], _U(pow(base, done, PRIME)))
        done += more
    return out


#: The first KEPT_POWERS powers of the last base used, and of its inverse.
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(base, -1, PRIME)
    if n > KEPT_POWERS:
        return _raised(base, n), _raised(inverse, n)
    if base not in _powers:
        _powers.clear()
        _powers[base] = _raised(base, KEPT_POWERS), _raised(inverse, KEPT_POWERS)
    up, down = _powers[base]
    return up[:n], down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads each bit over the word; a bijection."""
    h = h ^ (h >> _U(32))
    h *= _U(0xD6E8FEB86659FD93)
    h ^= h >> _U(29)
    h *= _U(0xA0761D6478BD642F)
    return h ^ (h >> _U(32))


def spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """The polynomial modulo PRIME of buf[start:end] for each start; no byte counts as nought, so lengths tell apart too."""
    up, down = powers(base, len(buf) + 1)
    one = buf.astype(_U) + _U(1)
    low, high = np.zeros(len(buf) + 1, _U), np.zeros(len(buf) + 1, _U)
    # The sums may run over 2 ** 64; the difference over a span of up to LONGEST_SUM bytes doesn't.
    np.cumsum(one * (up[:-1] & _U(0xFFFFFFFF)), out=low[1:])
    np.cumsum(one * (up[:-1] >> _U(32)), out=high[1:])

    def joined(x, y):
        h = fold(high[y] - high[x])
        return fold(fold(low[y] - low[x]) + (h >> _U(29)) + ((h & _U((1 << 29) - 1)) << _U(32)))

    first = np.minimum(ends, starts + LONGEST_SUM)
    total = joined(starts, first)
    while (rest := np.flatnonzero(first < ends)).size:
        upto = np.minimum(ends[rest], first[rest] + LONGEST_SUM)
        total[rest] = fold(total[rest] + joined(first[rest], upto))
        first[rest] = upto
    return times(total, down[starts])


def windows(buf: np.ndarray, starts: np.ndarray, length: int, base: int, chunk: int = 1 << 19) -> np.ndarray:
    """Hash of the ``length`` bytes from each start (ascending); memory for one chunk at a time."""
    out = np.empty(len(starts), _U)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = int(np.searchsorted(starts, low + chunk))
        own = starts[at:to] - low
        out[at:to] = mix(spans(buf[low : low + int(own[-1]) + length], own, own + length, base))
        at = to
    return out


def pieces(text: bytes) -> list[bytes]:
    """``text`` cut at white space into pieces of PIECE bytes or, where words are longer, a little more."""
    out, at = [], 0
    while len(text) - at > PIECE:
        cut = next((m.start() for m in _SPACE.finditer(text, at + PIECE)), len(text))
        out.append(text[at:cut])
        at = cut
    return [*out, text[at:]]


def word_hashes(texts: list[bytes], base: Base) -> tuple[np.ndarray, np.ndarray]:
    """(hash below PRIME of every word of all texts, number of words of each text); A-Z lower-cased, ASCII white space parts.

    Beside the result, memory is a multiple of the texts' bytes or, for a text of more than PIECE bytes, of PIECE.
    """
    if len(texts) == 1 and len(texts[0]) > PIECE:
        some = [_word_hashes([p], base) for p in pieces(texts[0])]
        return np.concatenate([h for h, _ in some]), np.array([sum(int(n[0]) for _, n in some)])
    return _word_hashes(texts, base)


def _word_hashes(texts: list[bytes], base: Base) -> tuple[np.ndarray, np.ndarray]:
    buf = LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    gap = np.concatenate([[True], IS_SPACE[buf]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = edge[::2], edge[1::2]
    h = spans(buf, starts, ends, base.byte)
    stops = np.cumsum([len(t) + 1 for t in texts])
    return h, np.diff(np.searchsorted(starts, stops), prepend=0)


def shingle_sets(texts: list[bytes], base: Base, k: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's k-word shingles; with fewer words the whole sequence is one; none without words."""
    h, counts = word_hashes(texts, base)
    if len(h) == 0:
        return [np.zeros(0, _U) for _ in texts]
    step = _U(base.word)
    rolled = np.zeros(max(0, len(h) - k + 1), _U)
    for i in range(k):
        rolled = fold(times(rolled, step) + h[i : i + len(rolled)])
    rolled = mix(rolled)
    out, at = [], 0
    for n in counts.tolist():
        if n >= k:
            own = np.sort(rolled[at : at + n - k + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif n:
            whole = n
            for x in h[at : at + n].tolist():
                whole = (whole * base.word + x) % PRIME
            out.append(mix(np.array([whole], _U)))
        else:
            out.append(np.zeros(0, _U))
        at += n
    return out


def in_slices(texts: list[bytes], most_bytes: int = 1 << 20):
    """(from, to) runs of texts of about ``most_bytes``, one text at least."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > most_bytes:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)
