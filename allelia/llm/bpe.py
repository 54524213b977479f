"""BPE encoding and decoding by forced boundaries.

Two bytes that never stand side by side inside any token of the vocabulary can never be merged over, so the place
between them is a certain cut. Words are cut there, each fragment is encoded by itself, and the ids are put together
again. Runs of text repeat, so each worker keeps what it has encoded.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import per_slice
from .vocab import byte_letters, library_tokenizer

#: Runs without white space that a worker remembers; beyond that it starts anew. Longer ones are not remembered.
MEMORY, LONGEST = 400_000, 64


class WordBpe:
    """Ids as the tokenizers library gives them for a lower-casing BPE file with word ends."""

    #: From here on Python's Unicode tables may differ from the library's: such text is brought into form and split
    #: into words by the file's own normalizer and pre-tokenizer, and then cut and encoded like any other.
    SURE_BELOW = 0x0250

    def __init__(self, path: str):
        from tokenizers import models

        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        self.library = library_tokenizer(path)
        self.end = model["end_of_word_suffix"]
        merges = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        self.last = models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=self.end)
        self.inner = models.BPE(vocab=model["vocab"], merges=merges)
        self.ids = model["vocab"]
        self.token = {i: t for t, i in self.ids.items()}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token |= {i: t for t, i in self.added.items()}
        self.letters = byte_letters()
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        # Fixed value: the pattern in the file's pre-tokenizer; what it does not match is dropped.
        self.word = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.run = regex.compile(r"\S+")
        self.joined = self._joined_pairs()
        #: Runs without white space → (ids as little-endian bytes, decoded bytes).
        self.chunks: dict[str, tuple[bytes, bytes]] = {}

    def _joined_pairs(self) -> set[str]:
        """Pairs of byte letters that stand side by side inside some token."""
        pairs = set()
        for t in self.ids:
            if t not in self.added:
                t = t.removesuffix(self.end)
                pairs.update(a + b for a, b in zip(t, t[1:]))
        return pairs

    @staticmethod
    @lru_cache(maxsize=4)
    def load(path: str) -> WordBpe:
        return WordBpe(path)

    def cut(self, word: str) -> list[str]:
        """The fragments of a word in byte letters, cut at every forced boundary."""
        out, begin = [], 0
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in self.joined:
                out.append(word[begin:i])
                begin = i
        out.append(word[begin:])
        return out

    def fragment(self, text: str, ends_word: bool) -> list[int]:
        return [t.id for t in (self.last if ends_word else self.inner).tokenize(text)]

    def _chunk(self, chunk: str) -> tuple[bytes, bytes]:
        """A run without white space: words by the pattern, then fragments."""
        ids: list[int] = []
        if self.sure(chunk):
            words = ["".join(map(self.letters.__getitem__, w.encode())) for w in self.word.findall(chunk)]
        else:
            words = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(chunk)]
        for letters in words:
            *inner, last = self.cut(letters)
            for f in inner:
                ids += self.fragment(f, False)
            ids += self.fragment(last, True)
        return np.array(ids, "<u4").tobytes(), " ".join(self.token[i] for i in ids).encode()

    def _span(self, text: str, out: list[bytes], said: list[bytes]) -> None:
        """Text without special tokens."""
        chunks = self._chunks(text)
        if not chunks:
            return
        known = self.chunks
        if len(known) >= MEMORY:
            known.clear()
        long: dict[str, tuple[bytes, bytes]] = {}
        for c in set(chunks):
            if c not in known:
                (known if len(c) <= LONGEST else long)[c] = self._chunk(c)
        ids, words = zip(*((known.get(c) or long[c] for c in chunks) if long else map(known.__getitem__, chunks)))
        out.extend(ids)
        said.extend(words)

    def sure(self, text: str) -> bool:
        return text.isascii() or ord(max(text)) < self.SURE_BELOW

    def _chunks(self, text: str) -> list[str]:
        """The runs without white space of the text in its normal form."""
        if not self.sure(text):
            return [c for c in self.library.normalizer.normalize_str(text).split(" ") if c]
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        text = text.replace("Σ", "σ").lower()  # one character at a time, as the library does: no final sigma
        # str.split also cuts at four control characters that are no white space to the library.
        return self.run.findall(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """(ids as little-endian 32-bit numbers, the text they decode to in UTF-8)."""
        out: list[bytes] = []
        said: list[bytes] = []
        parts = self.special.split(text) if "<|" in text else [text]
        for p in parts:
            if p in self.added:
                out.append(np.array([self.added[p]], "<u4").tobytes())
                said.append(p.encode())
            elif p:
                self._span(p, out, said)
        return b"".join(out), b" ".join(said)

    def decode(self, ids) -> str:
        """The tokens joined by spaces, as the library does for a file without a decoder; unknown ids are left out."""
        return " ".join(self.token[i] for i in ids if i in self.token)


def encode(docs: DataFrame, vocab_path: str) -> DataFrame:
    """``docs(doc_id, text, ...)`` → ``(doc_id, ids array<int>)``; null and empty texts have no ids."""

    def run(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        bpe = WordBpe.load(vocab_path)
        ids = [np.frombuffer(bpe.encode(t)[0], "<i4") for t in texts]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(per_slice(run), "doc_id long, ids array<int>")


def decode(rows: DataFrame, vocab_path: str) -> DataFrame:
    """``rows(doc_id, ids)`` → ``(doc_id, text)``; null ids give the empty text."""

    def run(batches):
        bpe = WordBpe.load(vocab_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or ()) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, vocab_path: str) -> DataFrame:
    """``docs(doc_id, text, ...)`` → ``(doc_id, n_tokens, ids_sha256, decoded_sha256)``, one row for each row.

    Null and empty texts have no tokens; repeated rows get equal results; null ids are carried; other columns are
    ignored; an empty table gives an empty result."""

    def run(part: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
        bpe = WordBpe.load(vocab_path)
        pairs = [bpe.encode(t) for t in texts]
        cols = [part.column(0), pa.array([len(a) // 4 for a, _ in pairs], pa.int64()), *(pa.array([hashlib.sha256(x[k]).hexdigest() for x in pairs], pa.string()) for k in (0, 1))]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(per_slice(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
