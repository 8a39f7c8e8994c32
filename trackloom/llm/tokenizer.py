"""Encoding whole texts with public tokenizer files, each distinct chunk once per worker.

Both kinds of file cut a text into words before any merge, and no word spans the places where this
module cuts, so the ids of a text are the ids of its chunks in order. A worker keeps the ids of chunks
it has met as little-endian unsigned 32-bit integers. Closing punctuation is looked up apart from what it closes;
the two are remembered together from the second time on. Chunks of Latin letters
go straight to the library's merge model; all others go through its whole encoding, and so do whole texts that
hold a token the file adds, such as <|endoftext|>: like the library, `encoder` takes it for that token. Two generations of
``CHUNKS`` entries bound the memory, and a worker without texts for ``IDLE`` seconds gives it back; dropping
entries changes no result.
"""

from __future__ import annotations

import re
import sys
import threading
import time
from array import array
from functools import lru_cache

import numpy as np

CHUNKS = 300_000      # remembered chunks per generation and worker
LONGEST = 64          # longer chunks are encoded, not remembered
IDLE = 8.0            # seconds without a text until a worker forgets its chunks

_BEFORE_SPACE = re.compile(r"(?<=\S)(?=\s)")
_PLAIN = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")
_CLOSING = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"      # all of ASCII but the apostrophe, which may begin a word's ending
_CLOSED = frozenset(c for c in map(chr, range(0x30, 0x100)) if c.isascii() and c.isalnum() or "À" <= c <= "ÿ" and c not in "×÷")


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or 256 and up in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Known(dict):
    """Ids by chunk; a chunk that is not there is learnt, and kept unless it is long."""

    def __init__(self, learn, lead: str = ""):
        self.learn, self.lead, self.older = learn, lead, {}

    def __missing__(self, chunk: str) -> bytes:
        return self.learn(self, chunk)

    def turn(self) -> None:
        """Begins a generation; of the one before, what is met again moves over."""
        self.older = dict(self)
        self.clear()


class Encoder:
    """``encode_one(text)`` gives the bytes of its ids; null counts as empty. With `added`, the library's default,
    strings of added tokens are those tokens; without, they are ordinary text."""

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not added
        tokens = self.library.get_added_tokens_decoder().values()
        if any(t.normalized for t in tokens):
            raise ValueError("only added tokens that stand in the text as they are")
        self.added = [t.content for t in tokens if added or not t.special]
        self.model = self.library.model
        self.letters = str.maketrans(_byte_letters())
        normal = self.library.normalizer
        self.drops_space = normal is not None and not self._whole([" "])[0]
        if normal is not None and not self.drops_space:
            raise ValueError("only files that drop white space may normalise")
        self._forget()
        self.ends: dict[str, bytes] = {}      # closing punctuation of at most four characters
        self.texts, self.watched = 0, False
        if array("I").itemsize != 4 or sys.byteorder != "little":
            raise RuntimeError("needs little-endian 32-bit unsigned integers")
        # The short way must be this file's own way; a file of another kind never takes it.
        probe = ["Ünited", " naïve,", "So...", " x", " (7)", "so_$#", ' "Ab"']
        probe = [p.strip() for p in probe] if self.drops_space else probe
        self.short = True
        self.short = list(map(self.known.__getitem__, probe)) == self._whole(probe)
        self._forget()
        self.feed = self._whole(["\n"])[0]

    def _whole(self, chunks: list[str]) -> list[bytes]:
        found = self.library.encode_batch_fast(chunks, add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in found]

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():
            piece = piece.encode().decode("latin-1").translate(self.letters)
        elif piece[0] == " ":       # other ASCII letters stand for themselves
            piece = self.letters[32] + piece[1:]
        return array("I", [t.id for t in self.model.tokenize(piece)]).tobytes()

    def _learn(self, known: _Known, chunk: str) -> bytes:
        if self.short and chunk[-1:] not in _CLOSED:
            word = chunk.rstrip(_CLOSING)
            if len(word) < len(chunk) and word and word[-1] in _CLOSED:     # letters or digits end before the punctuation
                met = word in known and len(chunk) <= LONGEST
                ids = known[word] + self._closing(chunk[len(word):])
                if met:     # a word met once is not remembered twice
                    known[chunk] = ids
                return ids
        ids = known.older.get(chunk)
        if ids is None:
            if self.short and _PLAIN.fullmatch(chunk):
                ids = self._piece(chunk.lower() if self.drops_space else known.lead + chunk)
            else:
                ids = self._whole([known.lead + chunk])[0]
        if len(chunk) <= LONGEST:
            known[chunk] = ids
        return ids

    def _closing(self, end: str) -> bytes:
        ids = self.ends.get(end)
        if ids is None:
            ids = self._piece(end)
            if len(end) <= 4 and len(self.ends) < CHUNKS:
                self.ends[end] = ids
        return ids

    def _forget(self) -> None:
        self.known, self.spaced = _Known(self._learn), _Known(self._learn, " ")

    def _watch(self) -> None:
        """Runs beside the tasks, which keep what they are reading and learn the rest again."""
        before = -1
        while before != self.texts:
            before = self.texts
            time.sleep(IDLE)
        self.watched = False
        self._forget()

    def _join(self, chunks: list[str]) -> bytes:
        return b"".join(map(self.known.__getitem__, chunks))

    def encode_one(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(t in text for t in self.added):
            return self._whole([text])[0]
        self.texts += 1
        if not self.watched:
            self.watched = True
            threading.Thread(target=self._watch, daemon=True).start()
        for known in (self.known, self.spaced):
            if len(known) > CHUNKS:
                known.turn()
        if self.drops_space:
            return self._join(text.replace("\n", " ").split(" "))
        if "\0" in text:
            return self._join(_BEFORE_SPACE.split(text))
        parts = []
        for line in text.split("\n"):
            words = line.split()
            if len(words) != line.count(" ") + 1 or not line.isprintable():     # other white space, or several in a row
                return self._join(_BEFORE_SPACE.split(text))
            parts.append(self.known[words[0]] + b"".join(map(self.spaced.__getitem__, words[1:])))
        return self.feed.join(parts)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker and file."""
    return Encoder(path, added=True)
