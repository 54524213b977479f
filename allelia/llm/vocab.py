"""Public vocabularies, loaded once in each Python worker, and exact encoders over them."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 as itself, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def library_tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class ByteBpe:
    """Ids as the tokenizers library gives them for a byte-level BPE file, by the faster rank-based encoder over the
    same vocabulary. The two agree on every character of Unicode (tests/llm). The faster one's pattern matcher keeps a
    step of its stack for each character of a run of white space, so texts with a very long run go to the library."""

    #: White space of Unicode, in a run as long as which a text goes to the library.
    LONG_RUN = 100_000
    SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

    def __init__(self, path: str):
        import regex
        import tiktoken

        spec = json.load(open(path, encoding="utf-8"))
        byte_of = {c: b for b, c in byte_letters().items()}
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
        self.added = frozenset(added)
        # Fixed value: the pre-tokenizer's pattern that goes with such files.
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("from_file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
        self.library = library_tokenizer(path)
        self.long_run = regex.compile(f"[{self.SPACES}]{{{self.LONG_RUN}}}")

    @staticmethod
    @lru_cache(maxsize=4)
    def load(path: str) -> ByteBpe:
        return ByteBpe(path)

    def encode(self, text: str) -> np.ndarray:
        if len(text) >= self.LONG_RUN and self.long_run.search(text):
            return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return np.asarray(self.fast.encode(text, allowed_special=self.added, disallowed_special=()), dtype=np.uint32)
