"""Exact token ids of whole texts, one ASCII-white-space-separated word at a time where the vocabulary allows that.

Vocabulary files of one known shape drop white space and never let a token cross it, so a text's ids are those of its words
in order. Words recur, so each Python worker keeps the ids of those it met lately, as little-endian unsigned 32-bit bytes;
capitals and the signs after words are taken off for whole texts at once, so that fewer words are different.
Words of Latin letters, digits and signs are cut by the file's own pattern here and only the pieces go to its model; any
other word goes through the whole tokenizer. With a vocabulary file of any other shape whole texts go through the tokenizer.
"""

from __future__ import annotations

import json
import re
import sys
from array import array

import numpy as np
import regex

from chatloom.llm.workers import Recent, held

#: Characters that are their own composed form and whose lower case is one character: what a word may hold to be cut here.
_PLAIN = regex.compile(r"[\x21-\x7E\xA1-įı-ɏ]+")
#: A full stop or comma before white space, unless a letter (a-z, U+00C0 to U+00FF) or a digit is before it.
_SIGN_BEFORE = re.compile(rb"[.,][ \n](?<![a-z0-9]..)(?<!\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]..)", re.DOTALL).search
#: Words of one generation of a worker's table, and the longest that is kept, in bytes: 48 MB with words of the usual length
#: in both generations, 90 MB at most.
ENTRIES, LONGEST = 150_000, 32
_PROBE = "The quick  brown\tfox's 12 \n\njumps\r\nover-\x0bit\x0c ÉTÉ é <|endoftext|>x don't 'll ###"


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level vocabularies write bytes: printable bytes as themselves, the others from U+0100."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


def _state(part) -> dict:
    return json.loads(part.__getstate__()) if part else {}


class _Words(Recent):
    """word (UTF-8) -> ids. A piece is a word too, with the same ids, so one table has both."""

    def __init__(self, tokenizer, pattern: str, special: tuple[str, ...], whole):
        super().__init__(self._ids, ENTRIES, LONGEST)
        self.tokenize, self.letters, self.pieces = tokenizer.model.tokenize, str.maketrans(_byte_letters()), regex.compile(pattern).findall
        self.special, self.marks, self.whole = special, (*(x.lower().encode() for x in special), b"\xcc"), whole

    def split(self, text: bytes) -> list[bytes]:
        """Words that have the text's ids, in order, as few different ones as can be: A-Z lower-cased, a full stop or comma
        apart from the letter or digit before it. Texts that may hold a special token, which is sought before case is folded,
        or a combining mark, which may join a small letter and not its capital, are split as they are."""
        low = text.lower()
        if any(map(low.__contains__, self.marks)):
            return text.split()
        if not _SIGN_BEFORE(low):
            low = low.replace(b", ", b" , ").replace(b". ", b" . ").replace(b".\n", b" .\n")
        return low.split()

    def _ids(self, word: bytes) -> bytes:
        low = word.lower()
        if low.isalpha():  # bytes: ASCII letters only, so one piece
            return self._model(low.decode())
        if low[-1:] in b".," and low[:-1].isalpha():
            return self[low[:-1]] + self[low[-1:]]
        return self._cut(word)

    def _model(self, letters: str) -> bytes:
        return array("I", [x.id for x in self.tokenize(letters)]).tobytes()

    def _cut(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if len(text) > 256 or not _PLAIN.fullmatch(text) or any(x in text for x in self.special):
            return self.whole(text)
        low = text.lower()
        if not low.isalpha():  # letters only are one piece
            pieces = [x.encode() for x in self.pieces(low)]
            if pieces != [word]:
                return b"".join(map(self.__getitem__, pieces))
        return self._model(low.encode().decode("latin-1").translate(self.letters))


class WordIds:
    """``encode`` of whole texts by a vocabulary file; ``by_word`` says whether words are encoded one by one."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        steps = _state(self.tokenizer.pre_tokenizer).get("pretokenizers", [])
        shape = [(x["type"], x.get("behavior"), x.get("invert"), x.get("add_prefix_space"), x.get("use_regex")) for x in steps]
        folds = [x["type"] for x in _state(self.tokenizer.normalizer).get("normalizers", [])]
        known = shape == [("Split", "Removed", True, None, None), ("ByteLevel", None, None, False, False)] and folds == ["NFC", "Replace", "Lowercase"]
        loose = any(x.lstrip or x.rstrip or x.content.split() != [x.content] for x in added)
        self.by_word = sys.byteorder == "little" and known and not loose
        if self.by_word:
            self.words = _Words(self.tokenizer, steps[0]["pattern"]["Regex"], tuple(x.content for x in added), self._whole)
            self.by_word = self.encode(_PROBE.encode()) == self._whole(_PROBE)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: bytes | None) -> bytes:
        """All ids of a text, 4 bytes each; a null text has none."""
        if not text:
            return b""
        return b"".join(map(self.words.__getitem__, self.words.split(text))) if self.by_word else self._whole(text.decode("utf-8", "replace"))


def word_ids(path: str) -> WordIds:
    """The tables of a vocabulary file in this Python worker."""
    return held(f"ids of {path}", lambda: WordIds(path))
