"""Ids of a public byte-level vocabulary for many texts, remembering what frequent words encode to."""

from __future__ import annotations

import base64
import json
import re

import numpy as np

VOCABULARY = "byte_bpe_50k"
#: Words after which the encoder looks whether remembering pays, and the share of new words, one in so many, up to which it does.
PERIOD, NEW = 50_000, 20
#: White space next to a space, where a word's encoding could depend on what stands before it.
_RUN = re.compile(r"\s\s")


class WordIds(dict):
    """Bytes of the ids of a space followed by the key; forgets everything at ``limit`` words, so memory stays bounded."""

    def __init__(self, encode, limit: int = 400_000) -> None:
        super().__init__()
        self.encode, self.limit, self.missed = encode, limit, 0

    def __missing__(self, word: str) -> bytes:
        self.missed += 1
        if len(self) >= self.limit:
            self.clear()
        ids = np.array(self.encode(" " + word), np.uint32).tobytes()
        if len(word) <= 64:
            self[word] = ids
        return ids


class Encoder:
    """The ids that the vocabulary's own tokenizer gives to ordinary text; a special string is ordinary text here.

    Its pre-tokenizer starts a new piece at every single space between two other characters, so the words between such
    spaces can be encoded one by one. Texts with longer white space are encoded whole, and so are all texts once a period
    but the first has brought many new words: to encode and remember those takes longer than to encode the text.
    """

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.words = WordIds(self.encode)
        self.forget()

    def forget(self) -> None:
        self.words.clear()
        self.words.missed, self.seen, self.periods, self.whole = 0, 0, 0, False

    def _looked(self, words: int) -> None:
        self.seen += words
        if self.seen >= PERIOD:
            if self.periods and self.words.missed * NEW > self.seen:
                self.words.clear()
                self.whole = True
            self.words.missed, self.seen, self.periods = 0, 0, self.periods + 1

    def __call__(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.whole or _RUN.search(text):
            return np.array(self.encode(text), np.uint32)
        first, *rest = text.split(" ")
        head = np.array(self.encode(first), np.uint32).tobytes()
        ids = np.frombuffer(head + b"".join(map(self.words.__getitem__, rest)), np.uint32)
        self._looked(len(rest))
        return ids


class DocumentEncoder:
    """The ids that the vocabulary's own tokenizer gives with ``add_special_tokens=False``: that adds no token around a text, but
    an added token of the vocabulary that stands in the text is its one id, and the text on both sides is encoded by itself."""

    def __init__(self, vocabulary: str = VOCABULARY) -> None:
        import public_tokenizers

        with open(public_tokenizers.path(f"{vocabulary}.json"), encoding="utf-8") as file:
            added = json.load(file)["added_tokens"]
        if odd := [t["content"] for t in added if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]:
            raise ValueError(f"added tokens that are not matched as they stand: {odd}")
        self.added = {t["content"]: np.array([t["id"]], np.uint32) for t in added}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if added else lambda text: [text]
        self.ordinary = encoder(vocabulary)

    def forget(self) -> None:
        """Frees the remembered words; the worker process outlives the task, and the next one soon knows its own words."""
        self.ordinary.forget()

    def __call__(self, text: str) -> np.ndarray:
        parts = self.split(text)
        if len(parts) == 1:
            return self.ordinary(text)
        return np.concatenate([self.added[p] if i % 2 else self.ordinary(p) for i, p in enumerate(parts)])


_DOCUMENT_ENCODERS: dict[str, DocumentEncoder] = {}
_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """One encoder per worker process."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def document_encoder(vocabulary: str = VOCABULARY) -> DocumentEncoder:
    """One encoder of documents per worker process."""
    if vocabulary not in _DOCUMENT_ENCODERS:
        _DOCUMENT_ENCODERS[vocabulary] = DocumentEncoder(vocabulary)
    return _DOCUMENT_ENCODERS[vocabulary]
