"""Byte-level BPE over texts, one distinct chunk at a time.

A chunk is a run of white space and the word after it. The library's pattern never looks behind a chunk's start nor
past its end, so a text's tokens are its chunks' tokens in a row. Words repeat, so each worker keeps the results of the
chunks it has seen, up to a bound.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable, Iterator

CHUNK = re.compile(r"\s*\S+|\s+")
# White space for Python's pattern but not for the library's.
ODD_SPACE = re.compile("[\x1c-\x1f]")
KEPT_CHUNKS = 350_000


@functools.cache
def load(path: str):
    """The tokenizer of a file, once a process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def specials(path: str) -> dict[str, int]:
    return {t.content: i for i, t in load(path).get_added_tokens_decoder().items() if t.special}


@functools.cache
def _special_pattern(path: str) -> re.Pattern | None:
    names = sorted(specials(path), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, names))) if names else None


def has_special(path: str, text: str) -> bool:
    return any(s in text for s in specials(path))


def segments(path: str, text: str) -> Iterator[tuple[str, str | None]]:
    """Ordinary stretches of a text, each with the special string that ends it, or None at the text's end."""
    pattern, at = _special_pattern(path), 0
    if pattern is not None:
        for found in pattern.finditer(text):
            yield text[at : found.start()], found.group()
            at = found.end()
    yield text[at:], None


def chunks(text: str) -> list[str]:
    return CHUNK.findall(text) if ODD_SPACE.search(text) is None else [text]


def byte_letters() -> dict[int, str]:
    """The letters that stand for bytes inside a byte-level vocabulary: printable Latin-1 for itself, then from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


LETTERS = byte_letters()
BLANK = LETTERS[0x20]


def as_letters(text: str) -> str:
    """A text's UTF-8 bytes, each as the letter that stands for it."""
    return text.encode().decode("latin-1").translate(LETTERS)


# The library's pattern, for Latin letters in Python's own syntax.
LATIN_PIECE = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
# Below U+0250, what Python's classes and the library's see differently.
NOT_ALIKE = re.compile("[\x1c-\x1f\u00b2\u00b3\u00b9\u00bc-\u00be]")


def pieces(path: str, chunk: str) -> list[str]:
    """The pieces of a chunk as letters that stand for bytes: by the library, or by the same pattern where that is sure."""
    word = chunk[1:] if chunk[0] == " " else chunk
    if chunk.isascii():
        if word.isalpha():
            return [BLANK + word if word is not chunk else word]
        if word[:-1].isalpha() and word[-1] in ".,;:!?":
            return [BLANK + word[:-1] if word is not chunk else word[:-1], word[-1]]
    elif word.isalpha() and max(word) < "\u0250":
        return [as_letters(chunk)]
    if max(chunk) < "\u0250" and NOT_ALIKE.search(chunk) is None:
        return [as_letters(p) for p in LATIN_PIECE.findall(chunk)]
    return [p for p, _ in load(path).pre_tokenizer.pre_tokenize_str(chunk)]


class Kept(dict):
    """Results by chunk. Beyond the bound the older half goes; what is asked again is computed again."""

    def __init__(self, compute: Callable[[str], object], bound: int = KEPT_CHUNKS):
        super().__init__()
        self.compute, self.bound, self.old = compute, bound, {}

    def __missing__(self, chunk: str):
        found = self.old.get(chunk)
        if found is None:
            found = self.compute(chunk)
        if len(chunk) <= 64 and "\n" not in chunk:
            if len(self) >= self.bound // 2:
                self.old = dict(self)
                self.clear()
            self[chunk] = found
        return found


class _Irregular(Exception):
    """White space other than single blanks and single line ends between words."""


class Chunked:
    """A value of a text from the values of its chunks: ``join`` of ``compute`` of each, special strings apart.

    Most texts are words with single blanks and line ends between them. Those are cut at the blanks alone, which needs
    no pattern; the first text with any other white space goes the general way.
    """

    def __init__(self, path: str, compute: Callable[[str], object], join: Callable, special: Callable[[int], object]):
        self.path, self.compute, self.join = path, compute, join
        self.special = {s: special(i) for s, i in specials(path).items()}
        self.spaced = Kept(self._spaced)
        self.plain = Kept(self._plain, KEPT_CHUNKS // 8)
        self.general = Kept(compute, KEPT_CHUNKS // 8)
        self.line_end = compute("\n")

    def _plain(self, item: str):
        if not item or item[0].isspace() or item[-1].isspace():
            raise _Irregular
        return self._lines(item, self.plain) if "\n" in item else self.compute(item)

    def _spaced(self, item: str):
        if not item or item[0].isspace() or item[-1].isspace():
            raise _Irregular
        return self._lines(item, self.spaced) if "\n" in item else self.compute(" " + item)

    def _lines(self, item: str, first: Kept):
        head, *rest = item.split("\n")
        values = [first[head]]
        for part in rest:
            values += (self.line_end, self.plain[part])
        return self.join(values)

    def ordinary(self, text: str):
        if not text:
            return self.join([])
        first, *items = text.split(" ")
        try:
            return self.join([self.plain[first], *map(self.spaced.__getitem__, items)])
        except _Irregular:
            return self.join(list(map(self.general.__getitem__, chunks(text))))

    def __call__(self, text: str):
        if not has_special(self.path, text):
            return self.ordinary(text)
        values = []
        for plain, special in segments(self.path, text):
            values.append(self.ordinary(plain))
            if special is not None:
                values.append(self.special[special])
        return self.join(values)
