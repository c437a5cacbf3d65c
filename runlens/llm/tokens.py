"""Token counts of whole texts, encoded in Arrow batches.

The encoding itself is the tokenizer library's. A byte-level tokenizer never lets a token reach from a
non-space character into a following space, so a text may be cut before every such space and the pieces
encoded apart. That bounds the work on one long text and lets repeated pieces be encoded once per worker.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts are handed to the tokenizer in groups of about so many bytes.
GROUP_BYTES = 1 << 20
#: Encoded pieces a worker remembers (twice so many at most), and the longest piece worth remembering.
#: Only speed depends on them.
REMEMBERED = 700_000
REMEMBERED_CHARS = 40
#: Words that the tokenizer gets as one text.
JOINED = 2000

#: A space after white space: there the next cut would not be safe.
_SPACE_AFTER_SPACE = re.compile(r"\s ")
_SAFE_CUT = re.compile(r"(?<=\S)(?= )")
#: Further cuts for a piece not met before: no token goes from a letter to a point or comma.
_FINER_CUT = re.compile(r"(?<=[A-Za-z])(?=[.,])|(?<=\S)(?=\s)")


def tokenizer_path(name: str) -> str:
    """A plain file name is looked up among the installed public tokenizers."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def splits_at_spaces(path: str) -> bool:
    """Whether this .json tokenizer is byte-level and may be given a text cut before spaces."""
    with open(path, encoding="utf-8") as file:
        told = json.load(file)
    before = told.get("pre_tokenizer") or {}
    return (
        told.get("normalizer") is None
        and before.get("type") == "ByteLevel"
        and not before.get("add_prefix_space")
        and before.get("use_regex", True)
        and not any(t["lstrip"] or t["rstrip"] or " " in t["content"] for t in told["added_tokens"])
    )


class Encoder:
    """Ids of texts, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        self.remembered = remembered
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        # Ids of a space and a word, by the word; of other pieces, by the piece.
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {}
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._encode = lambda texts: model.encode(texts, num_threads=1)
            self.cuts = False
        else:
            import tokenizers

            model = tokenizers.Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            self._encode = lambda texts: [
                e.ids for e in model.encode_batch_fast(texts, add_special_tokens=False)
            ]
            self.spaced = np.zeros(0, bool)
            self.cuts = splits_at_spaces(path)
            if self.cuts:  # in a byte-level vocabulary this letter stands for a space
                self.spaced = np.zeros(model.get_vocab_size(), bool)
                self.spaced[[i for t, i in model.get_vocab().items() if t[0] == "\u0120"]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, asked of the library one by one."""
        return [np.array(ids, "<u4").tobytes() for ids in self._encode(texts)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of a space and each word, the words being letters only: joined, each starts where a token
        starts with a space."""
        out: list[bytes] = []
        groups = [words[at : at + JOINED] for at in range(0, len(words), JOINED)]
        for group, found in zip(groups, self._encode([" " + " ".join(g) for g in groups])):
            ids = np.array(found, "<u4")
            cuts = [*np.flatnonzero(self.spaced[ids]).tolist(), len(ids)]
            raw = ids.tobytes()
            if len(cuts) != len(group) + 1:
                out += self.encode([" " + w for w in group])
            else:
                out += [raw[4 * i : 4 * j] for i, j in zip(cuts, cuts[1:])]
        return out

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of a space and each of these words, which memory does not hold."""
        known: dict[str, bytes] = {}
        plain: set[str] = set()
        cut: dict[str, list[str]] = {}
        for word in words:
            if (ids := self.older.get(word)) is not None:
                known[word] = ids
            elif word.isalpha():
                plain.add(word)
            else:
                cut[word] = parts = _FINER_CUT.split(" " + word)
                if (stem := parts[0][1:]).isalpha() and stem not in self.words:
                    if (ids := self.older.get(stem)) is None:
                        plain.add(stem)
                    else:
                        known[stem] = ids
        names = list(plain)
        known |= zip(names, self.encode_words(names))
        names = list({p for parts in cut.values() for p in (parts[1:] if parts[0][1:].isalpha() else parts) if p not in self.others})
        if len(self.others) > self.remembered:
            self.others = {}
        self.others |= zip(names, self.encode(names))
        for word, parts in cut.items():
            stem = parts[0][1:]
            if stem.isalpha():
                first = known[stem] if stem in known else self.words[stem]
                known[word] = b"".join([first, *[self.piece(p) for p in parts[1:]]])
            else:
                known[word] = b"".join([self.piece(p) for p in parts])
        return known

    def piece(self, text: str) -> bytes:
        ids = self.others.get(text)
        if ids is None:
            ids = self.others[text] = self.encode([text])[0]
        return ids

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each whole text."""
        if not self.cuts:
            for text in texts:
                yield self.encode([text])[0] if text else b""
            return
        for group in _groups(texts):
            done: list[bytes | None] = []
            left: dict[int, tuple[list[str], list[bytes | None]]] = {}
            for text in group:
                if _SPACE_AFTER_SPACE.search(text):
                    done.append(b"".join([self.piece(p) for p in _SAFE_CUT.split(text)]))
                    continue
                first, *words = text.split(" ")
                found = [self.piece(first) if first else b"", *map(self.words.get, words)]
                try:
                    done.append(b"".join(found))
                except TypeError:  # a word is not in memory
                    left[len(done)] = words, found
                    done.append(None)
            new = self.learn({w for words, found in left.values() for w, x in zip(words, found[1:]) if x is None})
            for at, (words, found) in left.items():
                done[at] = b"".join([found[0], *[new[w] if x is None else x for w, x in zip(words, found[1:])]])
            yield from done
            if len(self.words) > self.remembered:
                self.words, self.older = {}, self.words
            self.words |= {w: x for w, x in new.items() if len(w) <= REMEMBERED_CHARS}


def _groups(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts, about GROUP_BYTES of UTF-8 at a time."""
    group: list[str] = []
    size = 0
    for text in texts:
        group.append(text)
        size += len(text) if text.isascii() else len(text.encode())
        if size >= GROUP_BYTES:
            yield group
            group, size = [], 0
    if group:
        yield group


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    """The encoder of this worker process; loaded once."""
    if (path, remembered) not in _encoders:
        _encoders[path, remembered] = Encoder(path, remembered)
    return _encoders[path, remembered]


def token_count(text: Column, tokenizer: str = "byte_bpe_50k.json") -> Column:
    """Number of tokens of a text column; null counts as empty."""

    @F.pandas_udf("long")
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        use = encoder(tokenizer_path(tokenizer))
        for batch in batches:
            yield pd.Series([len(x) // 4 for x in use.ids([t or "" for t in batch])], dtype="int64")

    return counted(text)


def count_tokens(
    docs: DataFrame, text: str = "text", tokenizer: str = "byte_bpe_50k.json", limit: int = 1024
) -> DataFrame:
    """Every row with its size in bytes, its tokens, and whether it has more than ``limit`` of them.

    Null texts count as empty (0 bytes, 0 tokens). Existing columns of the result's names are replaced;
    all others stay. Repeated rows are counted each. A text may have any length.
    """
    return docs.withColumns(
        {
            "n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"),
            "n_tokens": token_count(F.col(text), tokenizer),
        }
    ).withColumn("over_limit", F.col("n_tokens") > limit)
