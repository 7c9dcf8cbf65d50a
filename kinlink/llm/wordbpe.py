"""Ids of the public lower-casing word BPE tokenizer, fast enough for whole corpora.

The tokenizer collapses white space, lower-cases, splits into letter runs, single digits and symbol runs, and merges bytes
inside each such piece, so nothing crosses white space: the ids of a text are those of its white-space chunks in order, and a
bounded memo of chunks answers most of a corpus. A chunk that the memo lacks is split and merged by a byte-pair core over the
same merges. Texts with characters outside the plain Latin range go through the tokenizer itself, whole.
"""

from __future__ import annotations

import json
import unicodedata
from array import array

import numpy as np

#: Chunks kept by a worker; at this count the memo starts afresh.
MEMO_CHUNKS = 300_000
#: Marks the end of a piece inside the byte-pair core; it occurs in no UTF-8 text.
_END = b"\xff"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordBpe:
    def __init__(self, path: str | None = None, memo_chunks: int = MEMO_CHUNKS):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        path = path or default_path()
        self.whole = Tokenizer.from_file(path)
        model = json.load(open(path, encoding="utf-8"))["model"]
        letters, vocab = _byte_letters(), model["vocab"]

        def raw(token: str) -> bytes:
            ends = token.endswith("</w>")
            return bytes(letters[c] for c in (token[:-4] if ends else token)) + _END * ends

        # Ranks: single bytes, then byte and end (joined before all else), then the merges in their order.
        order = [bytes([b]) for b in range(256)] + [bytes([b]) + _END for b in range(255)]
        known = set(order)
        for merge in model["merges"]:
            token = raw("".join(merge if isinstance(merge, list) else merge.split(" ")))
            if token not in known:
                known.add(token)
                order.append(token)
        ids = {raw(t): i for t, i in vocab.items() if not t.startswith("<|")}
        self._ids = [ids.get(t, -1) for t in order]
        self._merge = tiktoken.Encoding(
            "word_bpe", pat_str=r"\S+", mergeable_ranks={t: r for r, t in enumerate(order)}, special_tokens={}
        )._core_bpe.encode_single_piece
        self._pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self._odd = regex.compile("[^\x00-\x1b\x20-\x84\x86-\x9f\xa1-ɏ]|<\\|").search
        self._memo: dict[str, bytes] = {}
        self._counts: dict[str, int] = {}
        self._limit = memo_chunks

    def _chunk(self, chunk: str) -> list[int]:
        ids = self._ids
        return [ids[r] for piece in self._pieces(chunk) for r in self._merge(piece.encode() + _END)]

    def _packed(self, chunk: str) -> bytes:
        return array("I", self._chunk(chunk)).tobytes()

    def _chunks(self, text: str) -> list[str] | None:
        """White-space chunks, or None if the tokenizer itself has to take the text."""
        if not text.isascii():
            if self._odd(text):
                return None
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
        elif self._odd(text):
            return None
        return text.lower().split()

    def encode(self, text: str) -> np.ndarray:
        """Ids as little-endian unsigned 32-bit numbers, without special tokens."""
        chunks = self._chunks(text)
        if chunks is None:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4")
        memo = self._memo
        try:
            return np.frombuffer(b"".join([memo[c] for c in chunks]), dtype="<u4")
        except KeyError:
            if len(memo) > self._limit:
                memo.clear()
            for c in chunks:
                if c not in memo:
                    memo[c] = self._packed(c)
            return np.frombuffer(b"".join([memo[c] for c in chunks]), dtype="<u4")

    def count(self, text: str) -> int:
        """How many ids encode() gives."""
        chunks = self._chunks(text)
        if chunks is None:
            return len(self.whole.encode(text, add_special_tokens=False).ids)
        counts = self._counts
        try:
            return sum([counts[c] for c in chunks])
        except KeyError:
            if len(counts) > self._limit:
                counts.clear()
            for c in chunks:
                if c not in counts:
                    counts[c] = len(self._chunk(c))
            return sum([counts[c] for c in chunks])


_loaded: dict[str, WordBpe] = {}


def loaded(path: str | None = None) -> WordBpe:
    """One encoder for each worker process."""
    path = path or default_path()
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]
