"""XXH64 over many short byte ranges at once, after the published xxHash specification."""

from __future__ import annotations

import numpy as np
import xxhash

# The five primes of the XXH64 specification.
P1 = np.uint64(0x9E3779B185EBCA87)
P2 = np.uint64(0xC2B2AE3D27D4EB4F)
P3 = np.uint64(0x165667B19E3779F9)
P4 = np.uint64(0x85EBCA77C2B2AE63)
P5 = np.uint64(0x27D4EB2F165667C5)
#: Ranges longer than this are hashed one by one by the C library.
LONG = 256


def _rot(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rot(acc + lane * P2, 31) * P1


def _same_length(w64, w32, buf, at, n: int, seed: int) -> np.ndarray:
    """Hashes of the ranges [at, at + n)."""
    pos = 0
    seed = np.uint64(seed)
    if n >= 32:
        v = [np.full(len(at), s, np.uint64) for s in (seed + P1 + P2, seed + P2, seed, seed - P1)]
        while pos + 32 <= n:
            for k in range(4):
                v[k] = _round(v[k], w64[at + (pos + 8 * k)])
            pos += 32
        h = _rot(v[0], 1) + _rot(v[1], 7) + _rot(v[2], 12) + _rot(v[3], 18)
        for x in v:
            h = (h ^ _round(np.uint64(0), x)) * P1 + P4
    else:
        h = np.full(len(at), seed + P5, np.uint64)
    h = h + np.uint64(n)
    while pos + 8 <= n:
        h = _rot(h ^ _round(np.uint64(0), w64[at + pos]), 27) * P1 + P4
        pos += 8
    if pos + 4 <= n:
        h = _rot(h ^ (w32[at + pos].astype(np.uint64) * P1), 23) * P2 + P3
        pos += 4
    while pos < n:
        h = _rot(h ^ (buf[at + pos].astype(np.uint64) * P5), 11) * P1
        pos += 1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def xxh64(buf: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 42) -> np.ndarray:
    """Unsigned XXH64 of ``buf[start : start + size]`` for each range; ``buf`` needs 8 spare bytes at its end."""
    out = np.zeros(len(start), np.uint64)
    if not len(start):
        return out
    raw = buf.tobytes() if not buf.flags["C_CONTIGUOUS"] else buf
    w64 = np.ndarray((len(buf) - 7,), "<u8", raw, strides=(1,))
    w32 = np.ndarray((len(buf) - 3,), "<u4", raw, strides=(1,))
    order = np.argsort(np.minimum(size, 65535).astype(np.uint16), kind="stable")
    lengths = size[order]
    short = order[lengths <= LONG]
    cuts = np.flatnonzero(np.diff(size[short])) + 1
    with np.errstate(over="ignore"):
        for idx in np.split(short, cuts) if len(short) else []:
            out[idx] = _same_length(w64, w32, buf, start[idx], int(size[idx[0]]), seed)
    view = memoryview(np.ascontiguousarray(buf))
    for i in order[lengths > LONG].tolist():
        out[i] = xxhash.xxh64_intdigest(view[start[i] : start[i] + size[i]], seed)
    return out
