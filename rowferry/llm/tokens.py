"""Encoding whole texts with a public word tokenizer.

The tokenizer drops white space and never joins characters across it, so the
ids of a text are those of its white-space-separated words in order. Each task
keeps the ids of words it has met; the library encodes every other word, words
of letters by its merges alone, without its normaliser and splitter.
"""

from __future__ import annotations

import re

from rowferry.llm.common import Remembered

#: Small letters of Latin-1, which no normalisation changes, then ASCII marks that cannot begin a contraction.
STEM_AND_MARKS = re.compile(
    rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)((?:[!-&(-/:-@\[-`{-~][!-/:-@\[-`{-~]*)?)"
)


def byte_letters() -> dict[int, int]:
    """The letter that stands for each byte: the byte itself where it is visible in Latin-1, else from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = [b for b in range(256) if b not in visible]
    return {b: b for b in visible} | {b: 256 + i for i, b in enumerate(other)}


class WordEncoder:
    """Texts to ids, as little-endian unsigned 32-bit integers; keep bounds the words remembered."""

    _open: dict[str, WordEncoder] = {}

    def __init__(self, path: str, keep: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.merges, self.letters = self.tokenizer.model.tokenize, byte_letters()
        self.seen = Remembered(self._encoded, keep)

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """One encoder for each Python worker."""
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def _encoded(self, word: bytes) -> bytes:
        """Words of letters and marks behind them are encoded by parts, as the tokenizer would cut them."""
        found = STEM_AND_MARKS.fullmatch(word)
        if found and found[2]:
            return self.seen[found[1]] + self.seen[found[2]]
        if found:
            ids = [t.id for t in self.merges(word.decode("latin-1").translate(self.letters))]
        else:
            ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        return b"".join([i.to_bytes(4, "little") for i in ids])

    def __call__(self, texts: list[str]) -> list[bytes]:
        # Bytes: small letters and white space of ASCII only, as the library would.
        return [b"".join(self.seen.of(t.encode().lower().split())) for t in texts]
