"""Public tokenizers inside tasks: whole texts to arrays of ids, with a bounded cache of words."""

from __future__ import annotations

import functools
import re
import string
from array import array

import numpy as np

#: Words longer than this are encoded each time. Each of the two caches has two generations of so many bytes.
CACHED_CHARS, CACHED_BYTES = 40, 48 << 20
#: Bytes that an entry takes besides its characters and ids.
ENTRY_BYTES = 180
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
#: All white space but the four characters at which texts are cut; and pairs of those four that split(" ") would tear.
_OTHER_WHITE = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \t\r\n"]
_PAIRS = ["  ", "\n ", " \n", "\t", "\r"]
#: White space and Latin letters up to white space or one of some marks that no letter joins; else all up to white space.
_CHUNK = re.compile(rf"[ \t\r\n]*+[{_LATIN}]++(?![^ \t\r\n,.;:!?&%#*$])|[ \t\r\n]*+[^ \t\r\n]+|[ \t\r\n]+\Z")
_WORD = re.compile(rf" [{_LATIN}]+\Z")
_LETTERS = re.compile(rf"[{_LATIN}]+\Z")
_MARKED = re.compile(rf"[{_LATIN}]+[,.;:!?]\Z")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts exactly as the tokenizer file does, word by word.

    Both public vocabularies split a text before they merge, and never join what stands before white space with
    what follows from that white space on, nor a letter with the mark after it. A text is therefore cut before each
    run of white space, and between a Latin letter and some marks, and what lies between is encoded once while it
    stays in the cache. A text with any other white space is encoded whole.
    Special tokens' strings are ordinary text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.after_blank = _Cache(self._after_blank)
        self.chunks = _Cache(self._chunk)
        self.model = self.tokenizer.model
        self.letters = {ord(c): "".join(p for p, _ in self._split(c)) for c in map(chr, [*range(65, 256)]) if re.match(f"[{_LATIN}]", c)}
        self.blank = self._split(" a")[0][0][:-1]
        self.same_ascii = all(self.letters.get(ord(c)) == c for c in string.ascii_letters)
        if any(self._word(w) != self.whole(w) for w in (" Word", " é", " a", " Häuser")):
            self.letters = {}

    def _split(self, text: str) -> list:
        normal = self.tokenizer.normalizer
        return self.tokenizer.pre_tokenizer.pre_tokenize_str(normal.normalize_str(text) if normal else text)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _word(self, chunk: str) -> bytes:
        """A blank and Latin letters, which are one piece for the model."""
        return self._letters(chunk[1:])

    def _letters(self, word: str) -> bytes:
        """Ids of a blank and a word of Latin letters."""
        if not (self.same_ascii and word.isascii()):
            word = word.translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(self.blank + word)]).tobytes()

    def _after_blank(self, piece: str) -> bytes:
        """Ids of a blank and what stands up to the next one; a plain word needs no cutting."""
        if self.letters and _LETTERS.match(piece):
            return self._letters(piece)
        if _MARKED.match(piece):
            return self.after_blank[piece[:-1]] + self.chunks[piece[-1]]
        return b"".join([self.chunks[c] for c in _CHUNK.findall(f" {piece}")])

    def _chunk(self, chunk: str) -> bytes:
        return self._word(chunk) if self.letters and _WORD.match(chunk) else self.whole(chunk)

    def ids(self, text: str) -> np.ndarray:
        if any(c in text for c in _OTHER_WHITE):
            raw = self.whole(text)
        elif any(p in text for p in _PAIRS) or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n"):
            raw = b"".join([self.chunks[c] for c in _CHUNK.findall(text)])
        else:
            first, *rest = text.split(" ")
            cache = self.after_blank
            raw = b"".join([self.chunks[c] for c in _CHUNK.findall(first)] + [cache[c] for c in rest])
        return np.frombuffer(raw, np.uint32)


class _Cache(dict):
    """Ids of words, made when they are asked for. When it is full, it becomes the older generation, from which what is asked for again comes back; what was not goes with it."""

    def __init__(self, make):
        super().__init__()
        self.make, self.held = make, 0
        self.older: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            ids = self.make(key)
        if len(key) <= CACHED_CHARS:
            self.held += ENTRY_BYTES + len(key) + len(ids)
            if self.held > CACHED_BYTES:
                self.older, self.held = dict(self), 0
                self.clear()
            self[key] = ids
        return ids


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    return Encoder(path)


def vocabulary_size(path: str) -> int:
    return encoder(path).tokenizer.get_vocab_size()
