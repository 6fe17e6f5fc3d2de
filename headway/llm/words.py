"""Hashes of words and word windows, over many texts at a time with numpy."""

from __future__ import annotations

import hashlib

import numpy as np

_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_OTHER, _THIRD = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x8CB92BA72F3D8DD7)
#: Words of more than so many bytes are hashed one by one.
_LONG = 256
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_spans(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts joined by spaces, the words' starts and ends in that, and each text's first word (with a last entry, the number of words)."""
    data = b" ".join([*texts, b""])
    space = _SPACE[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True)) if len(data) else np.zeros(0, np.int64)
    starts, ends = edge[::2], edge[1::2]
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=first[1:])
    return data, starts, ends, np.searchsorted(starts, first)


def lowered(text: bytes) -> bytes:
    """A-Z as a-z; other characters stay."""
    return text.translate(_LOWER)


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each word: its length, then 8 bytes at a time, each mixed in before the next; BLAKE2 for long words. second: another such hash, by other constants."""
    size = ends - starts
    base, step = (_OTHER, _THIRD) if second else (_BASE, _STEP)
    h = mixed(size.astype(np.uint64) * step + base)
    eight = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))  # the 8 bytes from each place
    left = np.flatnonzero(size <= _LONG)
    done = 0
    while len(left):
        rest = size[left] - done
        part = eight[starts[left] + done]
        short = np.flatnonzero(rest < 8)
        part[short] &= (np.uint64(1) << (rest[short] * 8).astype(np.uint64)) - np.uint64(1)
        h[left] = mixed((h[left] ^ part) * base + step)
        left = left[rest > 8]
        done += 8
    for k in np.flatnonzero(size > _LONG):
        h[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8, person=b"second" if second else b"").digest(), "little")
    return h


def window_hashes(words: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of `size` words: one per start."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, seed * int(_BASE) & 0xFFFFFFFFFFFFFFFF, np.uint64)
    for k in range(size):
        h = (h ^ (h >> np.uint64(29))) * _STEP + words[k : k + n]
    return mixed(h)
