"""Ids of words, remembered by a worker as numbers into arrays.

A text is cut before spaces that follow a non-space. Tokenizers that never let a token reach over such a cut encode the
pieces apart, so a word that is met again costs one look into a dictionary; the ids of a batch of texts are
then gathered at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

#: Words whose tokens a worker remembers, and their characters on average; only speed and memory depend on them.
REMEMBERED = 500_000
REMEMBERED_CHARS = 16
#: New words that the tokenizer gets as one text.
JOINED = 5000

_SAFE_CUT = re.compile(r"(?<=\S)(?= )")
_LETTERS = re.compile(r"[^\W\d_]+")
_SPACE_AFTER_SPACE = re.compile(r"\s ")


def start_and_rest(text: str) -> tuple[str, str]:
    """A text up to its first safe cut, and what follows, which starts with a space if there is any."""
    if text[:1] == " ":
        return "", text
    cut = _SAFE_CUT.search(text)
    return (text[: cut.start()], text[cut.start() :]) if cut else (text, "")


def words_of(spaced: str) -> list[str]:
    """The pieces of a text that starts with a space, each without its first space."""
    if _SPACE_AFTER_SPACE.search(spaced):
        return [piece[1:] for piece in _SAFE_CUT.split(spaced)]
    return spaced[1:].split(" ")


class Bytewise:
    """A byte-level tokenizer (.json): ids of pieces, and the bytes of each id. Strings of special tokens are
    plain text or, with ``special``, what the tokenizer takes them for."""

    def __init__(self, path: str, special: bool = False) -> None:
        import tokenizers

        model = tokenizers.Tokenizer.from_file(path)
        model.no_truncation()
        model.no_padding()
        model.encode_special_tokens = not special
        self.encode = lambda pieces: [e.ids for e in model.encode_batch_fast(pieces, add_special_tokens=False)]
        # The letters that byte-level vocabularies write bytes with: printable ones stand for themselves.
        printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        self.bytes = [b""] * model.get_vocab_size()
        for token, i in model.get_vocab().items():
            # An added token outside the byte alphabet cannot come from plain text.
            self.bytes[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else b""


class WordIds:
    """Ids of a space and each word under one or more tokenizers.

    ``sides`` have ``encode(pieces)`` and the ``bytes`` of each id. With ``spelt``, ids that do not spell their word
    are left out. With ``letters``, no token reaches from the letters a word starts with to what follows them, and
    both are remembered apart.
    """

    def __init__(self, sides: list, remembered: int = REMEMBERED, spelt: bool = True, letters: bool = False) -> None:
        self.sides, self.remembered, self.spelt, self.letters = sides, remembered, spelt, letters
        self.spaced = [np.array([x[:1] == b" " for x in side.bytes]) for side in sides]
        self.forget()

    def forget(self) -> None:
        """Start without words. A word's number leads to its one or two pieces (piece 0 is empty), a piece to where its
        ids start and end among those of all pieces."""
        self.number: dict[str, int] = {}
        self.rests: dict[str, int] = {}
        self.characters = 0
        self.pieces = np.zeros((0, 2), np.int64)
        self.ids = [np.zeros(0, np.int32) for _ in self.sides]
        self.first = [np.zeros(1, np.int64) for _ in self.sides]
        self.end = [np.zeros(1, np.int64) for _ in self.sides]

    def add(self, runs: list[list[tuple[np.ndarray, np.ndarray]]]) -> None:
        """Append pieces: for every run and side, ids and the places between the pieces."""
        for k in range(len(self.sides)):
            flats = [self.ids[k], *(run[k][0] for run in runs)]
            before = np.cumsum([len(f) for f in flats])
            places = [run[k][1] + at for run, at in zip(runs, before)]
            self.first[k] = np.concatenate([self.first[k], *(p[:-1] for p in places)])
            self.end[k] = np.concatenate([self.end[k], *(p[1:] for p in places)])
            self.ids[k] = np.concatenate(flats)

    def add_single(self, pieces: list[str]) -> None:
        """Append these pieces, each encoded by itself."""
        run = []
        for side in self.sides:
            told = [
                ids if not self.spelt or b"".join([side.bytes[i] for i in ids]) == piece.encode() else []
                for piece, ids in zip(pieces, side.encode(pieces) if pieces else [])
            ]
            run.append((np.array([i for ids in told for i in ids], np.int32), np.cumsum([0, *map(len, told)])))
        self.add([run])

    def add_joined(self, words: list[str]) -> list[str]:
        """Append a space and each word, many at a time: joined by spaces, each starts with the token that starts
        with a space. Returns the words in the order of their pieces."""
        joinable = [w for w in words if w and " " not in w and not w[-1].isspace()]
        single = [w for w in words if not w or " " in w or w[-1].isspace()]
        done: list[str] = []
        runs = []
        for at in range(0, len(joinable), JOINED):
            group = joinable[at : at + JOINED]
            joined = " " + " ".join(group)
            raw, run = joined.encode(), []
            for side, spaced in zip(self.sides, self.spaced):
                (ids,) = side.encode([joined])
                flat = np.array(ids, np.int32)
                starts = np.flatnonzero(spaced[flat])
                if len(starts) != len(group) or b"".join(map(side.bytes.__getitem__, ids)) != raw:
                    single += group
                    break
                run.append((flat, np.append(starts, len(flat))))
            else:
                done += group
                runs.append(run)
        self.add(runs)
        self.add_single([" " + w for w in single])
        return done + single

    def learn(self, words: set[str]) -> None:
        """Number these words, which are new."""
        cuts: dict[str, str] = {}
        plain = words
        if self.letters:
            for word in words:
                if not word.isalpha() and (start := _LETTERS.match(word)) and start[0].isalpha():
                    cuts[word] = start[0]
            plain = (words - cuts.keys()) | {w for w in cuts.values() if w not in self.number}
            rests = list({w[len(start) :] for w, start in cuts.items()} - self.rests.keys())
            self.rests.update(zip(rests, range(len(self.first[0]), len(self.first[0]) + len(rests))))
            self.add_single(rests)
        before = len(self.first[0])
        done = self.add_joined(list(plain))
        self.number.update(zip(done, range(len(self.pieces), len(self.pieces) + len(done))))
        own = np.stack([np.arange(before, before + len(done)), np.zeros(len(done), np.int64)], axis=1)
        self.pieces = np.concatenate([self.pieces, own])
        if cuts:
            starts = self.pieces[[self.number[start] for start in cuts.values()], 0]
            ends = np.array([self.rests[w[len(start) :]] for w, start in cuts.items()], np.int64)
            self.number.update(zip(cuts, range(len(self.pieces), len(self.pieces) + len(cuts))))
            self.pieces = np.concatenate([self.pieces, np.stack([starts, ends], axis=1)])
        self.characters += sum(map(len, words))

    def look_up(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each side, the ids of all words, one after another, and how many each word has."""
        if len(self.number) > self.remembered or self.characters > REMEMBERED_CHARS * self.remembered:
            self.forget()
        numbers = list(map(self.number.get, words))
        new = {w for w, n in zip(words, numbers) if n is None}
        if new:
            self.learn(new)
            numbers = [self.number[w] if n is None else n for w, n in zip(words, numbers)]
        at = self.pieces[np.array(numbers, np.int64)]
        at = at.ravel() if self.letters else at[:, 0]
        out = []
        for ids, firsts, ends in zip(self.ids, self.first, self.end):
            first = firsts[at]
            n = ends[at] - first
            before = np.cumsum(n) - n
            flat = ids[np.repeat(first - before, n) + np.arange(int(n.sum()))]
            out.append((flat, n.reshape(-1, 2).sum(axis=1) if self.letters else n))
        return out


def grouped(texts: list[str], characters: int) -> Iterator[list[str]]:
    """Consecutive texts of about so many characters."""
    group, size = [], 0
    for text in texts:
        group.append(text)
        size += len(text)
        if size >= characters:
            yield group
            group, size = [], 0
    if group:
        yield group
