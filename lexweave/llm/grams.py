"""Vectorised character n-grams over a batch of texts: one code point array, one hash array, no loop per character."""

from __future__ import annotations

import unicodedata

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_FIN = np.uint64(0xD6E8FEB86659FD93)
_tables: tuple[np.ndarray, np.ndarray] | None = None


def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its compatibility-composed, case-folded form where that is one character, and whether that
    is a letter or digit. Built once per worker; ideographs fold to themselves."""
    global _tables
    if _tables is None:
        fold = np.arange(0x110000, dtype=np.uint32)
        solid = np.zeros(0x110000, dtype=bool)
        solid[0x3400:0x4DC0] = solid[0x4E00:0xA000] = solid[0xAC00:0xD7A4] = solid[0x20000:0x32000] = True
        for c in [*range(0x3400), *range(0xA000, 0xAC00), *range(0xF900, 0x10000), *range(0x1D400, 0x1D800), *range(0x2F800, 0x2FA20)]:
            f = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", chr(c)).casefold())
            if len(f) == 1:
                fold[c] = ord(f)
                solid[c] = f.isalnum()
            else:
                solid[c] = chr(c).isalnum()
        _tables = fold, solid
    return _tables


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the texts in one array, and the offset at which each text starts."""
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return chars, np.concatenate([[0], np.cumsum(sizes)])


def letters_only(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters and digits of the texts in one array, and where each text starts in it."""
    fold, solid = letter_tables()
    chars, starts = code_points(texts)
    keep = solid[chars]
    at = np.concatenate([[0], np.cumsum(keep)])
    return fold[chars[keep]], at[starts]


def gram_hashes(chars: np.ndarray, n: int) -> np.ndarray:
    """A hash for the n-gram that begins at each place; the last n - 1 places have none."""
    size = max(0, len(chars) - n + 1)
    if not size:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        span, have, power, out = 1, chars.astype(np.uint64) + np.uint64(1), _MIX, None
        done, left = 0, n
        while left:
            if left & 1:
                part = have[done : done + size]
                out = part.copy() if out is None else out * power + part
                done += span
            left >>= 1
            if left:
                have = have[:-span] * power + have[span:]
                power = power * power
                span *= 2
        out ^= out >> np.uint64(29)
        out *= _FIN
        out ^= out >> np.uint64(32)
    return out


def gram_owner(starts: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each n-gram place the text it begins in, and whether it ends in that text too."""
    lengths = np.diff(starts)
    owner = np.repeat(np.arange(len(lengths)), lengths)[:size]
    return owner, np.arange(size) + n <= starts[1:][owner]


def slices(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Runs of rows of at most so many characters together (a longer text is a run of its own)."""
    out, a, total = [], 0, 0
    for i, s in enumerate(sizes):
        if i > a and total + s > most:
            out.append((a, i))
            a, total = i, 0
        total += s
    return [*out, (a, len(sizes))] if sizes else []
