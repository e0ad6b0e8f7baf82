"""Token ids by the tokenizers library, with the ids of frequent words kept in each worker.

A text is cut at blanks where its tokenizer can never join what lies on the two sides, so the ids of the parts, one after
the other, are those of the text. Most parts recur. A part that a worker does not know yet is encoded by the library: by
its BPE model alone where the part is one plain word, with or without ASCII punctuation after it, which needs no
pre-splitting but this, and by the whole tokenizer otherwise.

This rests on what the tokenizer's file says: its normalizer, its pre-splitting and its model are compared with the two
forms that are known here, and texts are encoded whole by the library where the file has another.
"""

from __future__ import annotations

import gc
import json
import os
import re
import sys
from array import array
from functools import lru_cache

import numpy as np

#: A worker keeps two generations of parts: a full younger one becomes the older one, and what is used again moves back.
ENTRIES, LONGEST = 600_000, 64
#: A word of Latin letters alone: stable under NFC, with one lower-case form each, and never split before the BPE model.
_LETTERS = "[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u01ba]+"
#: The word, and punctuation that the pre-splitting parts from it as one piece.
_PLAIN = re.compile(f"({_LETTERS})([!-/:-@\\[-`{{-~]*)")
#: The pre-splitting pattern, and the normalizers, of the files that are known.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_FOLDING = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte: itself if visible, else the next from 256."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in visible else next(rest)) for b in range(256)}


class CachedTokenizer:
    """The base: subclasses say how a text is cut, how a plain word is given to the model, and which files allow that."""

    lead = ""  # what a part has before its word

    def __init__(self, tokenizer_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        # a worker makes many short-lived lists and no cycles: the cycle collector would only walk through them again and again
        gc.set_threshold(100_000, 50, 100)
        from tokenizers import Tokenizer

        with open(tokenizer_file, encoding="utf-8") as file:
            told = json.load(file)
        plain = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
        self.known = all(told["model"].get(k) == v for k, v in plain.items()) and not told.get("truncation") and not told.get("post_processor") and self.fits(told)
        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {"": b""}

    def fits(self, told: dict) -> bool:
        """Whether the file has the form that parts_of() and folded() assume."""
        raise NotImplementedError

    def parts_of(self, text: str) -> list[str] | None:
        """The parts, or None where text can't be cut safely."""
        raise NotImplementedError

    def folded(self, word: str) -> str:
        return word

    def simple(self, word: str) -> str:
        """A word of ASCII letters as the model takes it."""
        raise NotImplementedError

    def encoded(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def by_model(self, word: str, lead: str = "") -> bytes:
        """The ids of a plain word or of a run of punctuation, after lead."""
        seen = self.folded(word)
        if not seen.isascii() or not seen.isprintable():
            seen = seen.encode().decode("latin-1").translate(self.letters)
        if lead:
            seen = self.letters[32] + seen
        return array("I", [t.id for t in self.model.tokenize(seen)]).tobytes()

    def tail(self, marks: str) -> bytes:
        """The ids of the punctuation after a word; the short runs are few and kept."""
        ids = self.tails.get(marks)
        if ids is None:
            ids = self.by_model(marks)
            if len(marks) <= 2:
                self.tails[marks] = ids
        return ids

    def spelled(self, part: str) -> bytes:
        """The ids of a part, worked out."""
        if not self.known:
            return self.encoded(self.lead + part)
        line_end, lead, word = (b"", self.lead, part) if part[:1] != "\n" else (self.tail("\n"), "", part[1:])
        plain = _PLAIN.fullmatch(word)
        if plain is None:
            return line_end + self.encoded(lead + word) if lead + word else line_end
        word, marks = plain.groups()
        own = self.found(word) if marks and lead else self.by_model(word, lead)
        return line_end + own + self.tail(marks) if marks or line_end else own

    def last(self, part: str) -> int | None:
        """The last id of a part, worked out from no more of it than that takes; None if it has no ids."""
        if self.known and not self.lead:
            if part.isascii() and part.isalpha():
                return self.model.tokenize(self.simple(part))[-1].id
            plain = _PLAIN.fullmatch(part)
            ids = self.tail(plain[2]) if plain and plain[2] else self.spelled(part)
        else:
            ids = self.spelled(part)
        return int.from_bytes(ids[-4:], sys.byteorder) if ids else None

    def found(self, part: str) -> bytes:
        """The ids of a part, known or worked out."""
        ids = self.young.get(part) or self.old.get(part)
        if ids is None:
            # most new parts are one word of ASCII letters, which the model takes as it is
            simple = self.known and part.isascii() and part.isalpha()
            ids = array("I", [t.id for t in self.model.tokenize(self.simple(part))]).tobytes() if simple else self.spelled(part)
            if len(part) > LONGEST:
                return ids
        if len(self.young) >= ENTRIES:
            self.old, self.young = self.young, {}
        self.young[part] = ids
        return ids

    def ids(self, text: str) -> np.ndarray:
        """The ids of a text as uint32."""
        parts = (self.parts_of(text) if self.known else None) if text else []
        if parts is None:
            return np.frombuffer(self.encoded(text), np.uint32)
        lists = list(map(self.young.get, parts))
        if None in lists:
            lists = [self.found(part) if ids is None else ids for ids, part in zip(lists, parts, strict=True)]
        return np.frombuffer(b"".join(lists), np.uint32)


class SpacedWords(CachedTokenizer):
    """For tokenizers that fold letters and drop white space: cut at white space."""

    _odd = re.compile("[\x1c-\x1f]")

    def fits(self, told: dict) -> bool:
        split = {"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}
        steps = [split, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]
        return told["model"].get("end_of_word_suffix") == "</w>" and told["normalizer"] == {"type": "Sequence", "normalizers": _FOLDING} and told["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": steps}

    def parts_of(self, text: str) -> list[str] | None:
        return None if self._odd.search(text) else text.split()

    def folded(self, word: str) -> str:
        return word.lower()

    simple = folded


class LedWords(CachedTokenizer):
    """For byte-level tokenizers whose words take one blank before them: cut before single blanks and line ends.

    A blank that has white space on both sides, or white space before it and nothing after, may belong to a longer
    match; a text with such a blank is encoded whole. The first part, which has no blank before it, is encoded apart.
    Where a line end lies beside other white space or at an end of the text, the text is encoded whole too.
    """

    lead = " "
    _rare = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
    _odd = re.compile(r"\s \s|\s \Z")
    _loose = re.compile(r"\s\n|\n\s|\A\n|\n\Z")

    def fits(self, told: dict) -> bool:
        whole = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        return told["model"].get("end_of_word_suffix") is None and told["normalizer"] is None and told["pre_tokenizer"] == whole

    def parts_of(self, text: str) -> list[str] | None:
        return text.split(" ")

    def simple(self, word: str) -> str:
        return self.letters[32] + word

    def _single(self, text: str) -> bool:
        """Whether all white space is single blanks and line ends between words: a quick test that most texts pass."""
        return not (text[-1] in " \n" or text[0] in " \n" or "  " in text or "\n " in text or " \n" in text or "\n\n" in text or self._rare.search(text))

    def ids(self, text: str) -> np.ndarray:
        first, blank, rest = text.partition(" ")
        if not self.known or not blank or (not self._single(text) and (self._odd.search(text) or self._loose.search(text))):
            return np.frombuffer(self.encoded(text), np.uint32)
        rest = rest.replace("\n", " \n")
        own = np.frombuffer(self.encoded(first), np.uint32)
        return np.concatenate([own, super().ids(rest) if rest else np.frombuffer(self.encoded(" "), np.uint32)])


@lru_cache(maxsize=4)
def cached_tokenizer(tokenizer_file: str, spaced: bool) -> CachedTokenizer:
    """One for each worker. spaced: the tokenizer drops white space."""
    return (SpacedWords if spaced else LedWords)(tokenizer_file)
