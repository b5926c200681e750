"""Word-shingle hashes of whole texts, vectorised over a batch of documents."""

from __future__ import annotations

import numpy as np

_SLICE = 256 << 10  # bytes hashed at a time: some 20 bytes of arrays for each, and powers that stay with the worker
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i up to n, modulo 2**64."""
    if len(_powers.get("up", ())) <= n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            x = np.full(n + 1, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"][: n + 1], _powers["down"][: n + 1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """p with p[j] - p[i], times base**-i, a hash of data[i:j] that does not depend on i."""
    up, _ = powers(len(data))
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=p[1:])
    return p


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word [^\\x20\\x09-\\x0D]+ of the bytes, A-Z lower-cased. Long input goes in slices cut at blanks."""
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(len(data), at + _SLICE)
        if end < len(data):
            cut = np.flatnonzero(_BLANK[data[at:end]])
            if len(cut):
                end = at + int(cut[-1]) + 1
            else:  # one word longer than a slice
                cut = np.flatnonzero(_BLANK[data[end:]])
                end = end + int(cut[0]) + 1 if len(cut) else len(data)
        part = data[at:end]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], _BLANK[part], [True])).astype(np.int8)))
        s, e = edge[::2], edge[1::2]
        p, (_, down) = prefix_hash(_LOWER[part]), powers(len(part))
        hashes.append(mix((p[e] - p[s]) * down[s] + (e - s).astype(np.uint64)))
        starts.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct width-word shingle hashes of each text; of fewer words, one shingle of them all."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    bounds = np.cumsum([0] + [len(r) + 1 for r in raw])
    words, starts = word_hashes(np.frombuffer(b" ".join(raw) + b" ", np.uint8))
    first = np.searchsorted(starts, bounds)
    factor = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(width)]
    n = max(0, len(words) - width + 1)
    rolled = np.full(n, width, np.uint64)
    for k in range(width):
        rolled += words[k : k + n] * factor[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            some = words[a:b] * np.array(factor[: b - a], np.uint64)
            out.append(mix(some.sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
