"""Plain versions of the operators' contracts, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    bits = Counter()
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        bits.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b, n in bits.items() if 2 * n > len(grams))


def components(fps, max_bits=2):
    """fps: doc_id → fingerprint; links at ``max_bits`` or fewer bits."""
    root = {d: d for d in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (fps[a] ^ fps[b]).bit_count() <= max_bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def repeated_words(text):
    words = WORD.findall(text or "")
    at = defaultdict(list)
    for i in range(len(words) - 2):
        at[tuple(words[i : i + 3])].append(i)
    return len({p + k for places in at.values() if len(places) > 1 for p in places for k in range(3)})


def duplicate_lines(text):
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(lines) - len(set(lines))


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]+")


def secrets(text):
    text = text or ""
    return {
        "assign": [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 6],
        "access": [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= 20],
        "hex": [m.span() for m in HEX.finditer(text) if len(m[0]) >= 24],
    }


def joined_spans(spans):
    kinds = list(spans)
    rows = sorted((a, kinds.index(k), b, k) for k, found in spans.items() for a, b in found)
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in rows)


def repeats(texts, size=35):
    """texts: id → text → id → (words, removed, digest of the rest)."""
    words = {d: WORD.findall(t or "") for d, t in texts.items()}
    seen = Counter(tuple(w[i : i + size]) for w in words.values() for i in range(len(w) - size + 1))
    out = {}
    for d, w in words.items():
        gone = {p + k for p in range(len(w) - size + 1) if seen[tuple(w[p : p + size])] > 1 for k in range(size)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n
