"""Tokenising inside tasks: exact ids of the public word-level BPE, cached per word.

The vocabulary's normaliser folds case and drops white space, and its words never merge with each other.
Texts of ASCII and Latin letters are cut into the same words by one regular expression, and each distinct
word is asked of the BPE model once per worker; any other text goes through the tokenizer as a whole. The
cache is emptied when it holds ``CACHE`` words, which bounds a worker's memory whatever the input.
"""

from __future__ import annotations

import os
import re

from catascope.llm.common import by_value

CACHE = 600_000
#: Characters whose normal form, case folding or class this module leaves to the tokenizer, and its special tokens.
OTHER = re.compile("[^\t-\r\x20-\x7e\xa1-\u012f\u0131-\u017f]|<\\|")
_LETTERS, _NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The vocabulary's word pattern (fixed by its file), for lower-case Latin text.
WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\\s{_LETTERS}{_NUMBERS}]+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The usual byte-level alphabet: printable bytes stand for themselves, the rest follow from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Little-endian unsigned 32-bit ids of whole texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.letters = Tokenizer.from_file(path), {}, _byte_letters()
        self.model = self.tokenizer.model

    def word(self, word: str) -> bytes:
        if len(self.known) > CACHE:
            self.known.clear()
        units = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        self.known[word] = out = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(units)])
        return out

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if OTHER.search(text):
            return b"".join([i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids])
        known, word = self.known, self.word
        return b"".join([known[w] if w in known else word(w) for w in WORD.findall(text.lower())])


by_value(__name__)
