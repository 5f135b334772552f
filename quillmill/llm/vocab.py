"""Exact sub-word encoding with a bounded cache of white-space separated chunks.

Both public vocabularies cut a text at white space before any merge, so a text
falls into chunks whose encodings do not depend on their neighbours, and each
distinct chunk goes through the tokenizers library once while it is in use.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: The white space of Unicode (White_Space property).
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: White space other than a blank or a line feed.
#: Below these, normalising is lower-casing letter by letter.
BEYOND = re.compile("[\u0130-\U0010ffff]")
LETTERS = re.compile(r"[^\W\d_]+")
ODD_WHITE = re.compile("[\\t\\x0b-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
GENERATION = 500_000
#: Byte-level vocabularies write printable bytes as themselves and the others, in order, from U+0100 on.
BYTE_LETTERS = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255))}


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def ragged(text: str) -> bool:
    """Whether white space meets white space somewhere, so that a cut before single blanks would be wrong."""
    return text[0] in " \n" or text[-1] in " \n" or "  " in text or " \n" in text or "\n " in text or "\n\n" in text or ODD_WHITE.search(text) is not None



class Memo(dict):
    """What ``make`` gives for each key, bounded by age: what wasn't used for a whole generation goes."""

    def __init__(self, make: Callable, size: int = GENERATION):
        super().__init__()
        self.make, self.size, self.old = make, size, {}

    def forget(self) -> None:
        self.clear()
        self.old = {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.size:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Ids of whole texts as little-endian bytes of ``dtype``.

    Special strings inside a text become their special ids, as the library
    does by default; texts that hold one are encoded whole, without the cache.
    """

    def __init__(self, path: str):
        self.library = tokenizer(path)
        self.tokenize = self.library.model.tokenize
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.blank = "Ġ" if self.library.normalizer is None else ""
        self.lowers = self.library.normalizer is not None
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.line_end = self._whole("\n")
        self.rests = Memo(self._whole, GENERATION // 8)
        self.inner = Memo(self._behind_blank)
        self.outer = Memo(self._alone, GENERATION // 8)

    def _whole(self, text: str) -> bytes:
        """By the library's full path."""
        return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, word: str, blank: str) -> bytes:
        """A run of letters is one unit of the merge model."""
        if not word.isascii():
            word = (word.lower() if self.lowers else word).encode().decode("latin-1").translate(BYTE_LETTERS)
        elif self.lowers:
            word = word.lower()
        return array(self.code, [t.id for t in self.tokenize(blank + word)]).tobytes()

    def _chunk(self, chunk: str, blank: str) -> bytes:
        """Leading letters go straight to the merge model; what follows them is encoded alone."""
        if self.lowers and not chunk.isascii() and BEYOND.search(chunk):
            return self._whole(blank + chunk)  # marks may compose with letters
        if chunk.isalpha():
            found = self._letters(chunk, self.blank if blank else "")
        else:
            start = LETTERS.match(chunk)
            if not start or not start[0].isalpha():  # the pattern also takes numbers such as ²
                return self._whole(blank + chunk)
            found = self._letters(start[0], self.blank if blank else "") + self.rests[chunk[start.end() :]]
        return found

    def _behind_blank(self, chunk: str) -> bytes:
        return self._chunk(chunk, " ")

    def _alone(self, chunk: str) -> bytes:
        return self._chunk(chunk, "")

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [self.encode_one(t) if t else b"" for t in texts]

    def encode_one(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return self._whole(text)
        if self.lowers and not BEYOND.search(text):
            text = text.lower()  # so that capitals aren't chunks of their own
        outer, inner = self.outer.__getitem__, self.inner.__getitem__
        if ragged(text):
            return b"".join(map(outer, CHUNK.findall(text)))
        lines = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            lines.append(outer(first) + b"".join(map(inner, rest)))
        return self.line_end.join(lines)

    def forget(self) -> None:
        """Lets go of what is cached; a worker that has encoded may serve other stages for long."""
        for memo in (self.rests, self.inner, self.outer):
            memo.forget()

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode([text])[0], self.dtype)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary, kept between tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, looked up where it is used."""
    import public_tokenizers

    return public_tokenizers.path(name)
