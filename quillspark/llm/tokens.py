"""Byte-level BPE ids through the ``tokenizers`` library, with a memo of words.

A byte-level BPE never merges across pre-tokens, so the ids of a text are the
ids of its pre-tokens in a row.  A pre-token that the memo of a worker has not
goes through the library's model alone; texts with characters on which two
regular-expression engines could differ go through the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from string import punctuation

import numpy as np

from quillspark.llm.common import keeps, takes_over

#: The pre-token pattern of the vocabulary file.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Texts of these characters alone take the memo.
PLAIN = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-ɏ]*")

#: With these, or a space at an end, a single space may stand elsewhere than before a pre-token.
ODD_SPACES = ("  ", " \n", "\n ", "\t", "\r")

#: Pre-tokens and pieces kept by a worker at most; a memo starts anew beyond it.
MEMO_WORDS, MEMO_CHUNKS = 600_000, 700_000

#: Longer ones are not kept.
MEMO_CHARS = 40

_loaded: dict[str, TextEncoder] = {}
keeps("tokens", _loaded.clear)


def _byte_characters() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(256 + k) for k, b in enumerate(rest)}


class TextEncoder:
    """Ids of texts as arrays of unsigned 32-bit integers, those that ``encode(text, add_special_tokens=False)`` gives.

    The contents of added tokens, such as ``<|endoftext|>``, are one id each
    there; a text that holds one goes through the library whole.
    """

    def __init__(self, path: str) -> None:
        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.whole = Tokenizer.from_file(path)
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.model = self.whole.model
        self.characters = _byte_characters()
        self.space = self.characters[0x20]
        self.split = regex.compile(PRETOKEN).findall
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if not (text.isascii() or PLAIN.fullmatch(text)) or any(x in text for x in self.added):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(self.words) > MEMO_WORDS:
            self.words.clear()
        if text[0] == " " or text[-1] == " " or any(x in text for x in ODD_SPACES):
            return np.frombuffer(self._joined(self.split(text)), "<u4")
        # each piece after the first stands for itself with the space before it
        first, *pieces = text.split(" ")
        known = self.chunks
        got = [*map(known.get, pieces)]
        if None in got:
            if len(known) > MEMO_CHUNKS:
                known.clear()
            for k, ids in enumerate(got):
                if ids is None:
                    piece = pieces[k]
                    if piece.isalpha():
                        ids = self._piece(piece)
                    elif (stem := piece.rstrip(punctuation)) and stem.isalpha():
                        # letters, then marks alone: two pre-tokens
                        tail = piece[len(stem) :]
                        ids = (known.get(stem) or self._piece(stem)) + (self.words.get(tail) or self._word(tail))
                        if len(piece) <= MEMO_CHARS:
                            known[piece] = ids
                    else:
                        ids = self._joined(self.split(f" {piece}"))
                        if len(piece) <= MEMO_CHARS:
                            known[piece] = ids
                    got[k] = ids
        got.insert(0, self._joined(self.split(first)))
        return np.frombuffer(b"".join(got), "<u4")

    def _joined(self, found: list[str]) -> bytes:
        words = self.words
        return b"".join([words[w] if w in words else self._word(w) for w in found])

    def _piece(self, letters: str) -> bytes:
        """Ids of the pre-token of a space and ``letters``, which is kept as a piece alone."""
        as_bytes = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.characters)
        ids = array("I", [t.id for t in self.model.tokenize(self.space + as_bytes)]).tobytes()
        if len(letters) <= MEMO_CHARS:
            self.chunks[letters] = ids
        return ids

    def _word(self, word: str) -> bytes:
        """Ids of one pre-token, by the library's model; kept where it is short."""
        ids = self.words.get(word)
        if ids is None:
            as_bytes = word.encode().decode("latin-1").translate(self.characters)
            ids = array("I", [t.id for t in self.model.tokenize(as_bytes)]).tobytes()
            if len(word) <= MEMO_CHARS:
                self.words[word] = ids
        return ids


def encoder(path: str) -> TextEncoder:
    """The worker's encoder for a vocabulary file, loaded once."""
    takes_over("tokens")
    if path not in _loaded:
        _loaded[path] = TextEncoder(path)
    return _loaded[path]


def default_vocabulary() -> str:
    """The public byte-level vocabulary of 50,257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
