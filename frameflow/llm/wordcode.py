"""Whole-text tokenisation with the tokenizers library, remembering the ids of words.

Both public vocabularies used here split a text before they merge. One keeps white space, and a split always falls where
white space follows something else; the other drops white space, and a split falls at every space. So a text is cut there,
each distinct part is encoded once by the library, and a text's ids are its parts' ids in order. Marks at a word's end
are split from ASCII letters too, and are encoded apart. A vocabulary that lower-cases everything gets texts with A-Z
lower-cased, which it would do itself, and so has fewer distinct words.

Texts go to the library whole where a cut could matter: with an added token's string (such as <|endoftext|>, which gives
that token's id), with U+0000 (the mark used here), or with combining marks if case is dropped (they may compose with a
capital only, or with a small letter only).
"""

from __future__ import annotations

import json
import os
import re
from array import array

from frameflow.llm.common import claim

_WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # what \s matches in the library
_PARTS = re.compile(rf"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
_PLAIN_PART = re.compile(rf"[ \n][^{_WHITE}]+")
_MARKS = b".,;:!?#$%&*|"
_LETTERS = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_FIRST = b"\0"
LONGEST = 64  # bytes of a part that is remembered
ENTRY = 120  # bytes that an entry takes besides its key and ids
_LATIN = 0x250  # letters below stay themselves under normalisation; only U+0130 has a longer lower case


def _byte_characters() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: printable ones themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


_CHARACTERS = _byte_characters()


class WordEncoder(dict):
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit integers (bytes).

    The dictionary holds the ids of the parts seen so far. A key is a word that follows a space; a newline with its word;
    or, after a mark, any other part as it stands: a text's first word, a word's marks, a word after more white space.
    Past ``limit`` bytes it starts anew, and what is met again comes over from the parts before; parts of more than
    ``LONGEST`` bytes are never kept. So memory is bounded by twice the limit, whatever the texts hold."""

    def __init__(self, path: str, limit: int = 72 << 20):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tokenizers

        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)), re.I) if added else None  # any case: it may be matched after normalising
        self.added_start = re.match(r"[^\w]*", os.path.commonprefix(added))[0]  # a quick look for it rules out nearly all texts
        self.drops_spaces = kind.get("normalizer") is not None  # the lower-casing vocabulary drops white space
        self.limit, self.held = limit, 0
        self.older: dict[bytes, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [self._text(t) if t else b"" for t in texts]

    def _text(self, text: str) -> bytes:
        if self.held > self.limit:
            self.older, self.held = dict(self), 0
            self.clear()
        keys = self.keys_of(text, text.encode("utf-8", "surrogatepass"))
        return self.whole(text) if keys is None else b"".join(map(self.__getitem__, keys))

    def keys_of(self, text: str, data: bytes) -> list[bytes] | None:
        """A text's parts in order, ``data`` being its UTF-8; None if it has to go to the library whole."""
        if _FIRST in data or self.added and self.added_start in text and self.added.search(text):
            return None
        if self.drops_spaces:
            if b"\xcc" in data or b"\xcd" in data:  # the first bytes of U+0300 to U+037F in UTF-8
                return None
            return data.lower().replace(b"\n", b" ").split(b" ")
        if not self._plain(text, data):
            return self._parts(text)
        keys = data.replace(b"\n", b" \n").split(b" ")
        keys[0] = _FIRST + keys[0]
        return keys

    @staticmethod
    def _plain(text: str, data: bytes) -> bool:
        """Whether all white space is single spaces and newlines between words."""
        if len(data) == len(text):
            gaps = b"  " in data or b" \n" in data or b"\n " in data or b"\n\n" in data
            return not gaps and len(data.translate(None, b"\t\x0b\x0c\r")) == len(data) and data[-1] not in b" \n" and data[0] not in b" \n"
        return " ".join(text.split()) == text.replace("\n", " ")

    @staticmethod
    def _parts(text: str) -> list[bytes]:
        parts = []
        for p in _PARTS.findall(text):
            b = p.encode("utf-8", "surrogatepass")
            parts.append(_FIRST + b if not _PLAIN_PART.fullmatch(p) else b if p[0] == "\n" else b[1:])
        return parts

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, key: bytes) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            ids = self.ids(key)
        if len(key) <= LONGEST:
            self[key] = ids
            self.held += len(key) + len(ids) + ENTRY
        return ids

    def ids(self, key: bytes) -> bytes:
        """A part's ids from the library."""
        head = key.rstrip(_MARKS)
        if len(head) < len(key) and head and head[-1] in _LETTERS:
            return self[head] + self[_FIRST + key[len(head) :]]
        word = self._word(key)
        return self.whole(self._literal(key)) if word is None else array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _literal(self, key: bytes) -> str:
        """The text that a key stands for."""
        text = key.decode("utf-8", "surrogatepass")
        if text[:1] == "\0":
            return text[1:]
        return text if self.drops_spaces or text[:1] == "\n" else " " + text

    def _word(self, key: bytes) -> str | None:
        """What the library's model gets for a word of Latin letters, which nothing before it would split; else None."""
        first = key[:1] == _FIRST
        word = key[1:] if first else key
        space = "" if first or self.drops_spaces else _CHARACTERS[32]
        if word.isalpha():  # ASCII letters, which byte-level vocabularies write as they are
            return None if first and self.drops_spaces else space + word.decode("ascii")
        text = word.decode("utf-8", "surrogatepass")
        if not text.isalpha() or max(text) >= chr(_LATIN) or "\u0130" in text or first and self.drops_spaces:
            return None
        if self.drops_spaces:
            word = text.lower().encode()
        return space + word.decode("latin-1").translate(_CHARACTERS)


_encoders: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, limit: int = 72 << 20) -> WordEncoder:
    """A worker process's encoder for this vocabulary and limit; a former one goes, with what it remembered."""
    claim("tokens", _encoders)
    if (path, limit) not in _encoders:
        _encoders.clear()
        _encoders[path, limit] = WordEncoder(path, limit)
    return _encoders[path, limit]
