"""Exact token counts and ids of two public BPE vocabularies through caches of pre-tokens.

A pre-token here is what white space delimits; a worker has the library encode each once. The library's result for a text is put
together from those of its pre-tokens where its split rules allow that: other texts (special tokens' strings, unusual white space,
long runs of white space) go to the library whole.
"""

from __future__ import annotations

import array
import json
import os
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np

#: White space and control characters on which Python and the library may differ, and the beginning of special tokens' strings.
UNUSUAL = (*"\x1c\x1d\x1e\x1f\x85\xa0 ᠎    　﻿", *map(chr, range(0x2000, 0x2010)), "<|")
#: Entries of a worker's cache, and characters of the longest pre-token in it; a full cache starts anew, and longer ones are encoded
#: each time, which costs time and no result.
CACHE_ENTRIES, CACHE_LONGEST = 700_000, 128


def load(path: str):
    """The tokenizer of a vocabulary file; without threads of its own, as Spark's tasks share the cores."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def unusual(text: str) -> bool:
    return any(c in text for c in UNUSUAL)


class Encoder:
    """A cache of pre-tokens in front of a vocabulary; subclasses say what is kept for each."""

    def __init__(self, path: str):
        self.tokenizer, self.cache = load(path), {}

    def lookup(self, pretokens: list[str], frequent: dict) -> list:
        """What is kept for each pre-token: from the table that all workers have, else from this worker's cache, else encoded."""
        found = list(map((frequent or self.cache).get, pretokens))
        if None in found:
            at = [k for k, x in enumerate(found) if x is None]
            get, missing = self.cache.get, set()
            for k in at:
                found[k] = get(pretokens[k])
                if found[k] is None:
                    missing.add(pretokens[k])
            if missing:
                if len(self.cache) + len(missing) > CACHE_ENTRIES:
                    self.cache.clear()
                fresh = self.encode(sorted(missing))
                self.cache.update({k: v for k, v in fresh.items() if len(k) <= CACHE_LONGEST})
                for k in at:
                    if found[k] is None:
                        found[k] = fresh[pretokens[k]]
        return found

    def encode(self, pretokens: list[str]) -> dict:
        raise NotImplementedError


def byte_pair_encoding(path: str):
    """A byte-level vocabulary file's merges in a faster library; for pre-tokens, which have no special tokens in them."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        vocabulary = json.load(file)["model"]["vocab"]
    # the file writes bytes as characters: printable ones as themselves, the others as those from 256 on
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    ranks = {bytes(byte_of[c] for c in token): rank for token, rank in vocabulary.items()}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("byte level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class WordLengths(Encoder):
    """Token counts with the lower-casing vocabulary with word ends, which drops white space."""

    def encode(self, pretokens: list[str]) -> dict[str, int]:
        if any(not p.isascii() for p in pretokens):  # normal forms may move offsets
            found = self.tokenizer.encode_batch_fast(pretokens, add_special_tokens=False)
            return {p: len(e.ids) for p, e in zip(pretokens, found)}
        found = self.tokenizer.encode("".join(f" {p}" for p in pretokens), add_special_tokens=False)
        begin = np.cumsum([0, *(len(p) + 1 for p in pretokens[:-1])])
        owner = np.searchsorted(begin, [o[0] for o in found.offsets], side="right") - 1
        return dict(zip(pretokens, np.bincount(owner, minlength=len(pretokens)).tolist()))

    def pretokens(self, text: str) -> list[str] | None:
        """The text's pre-tokens, or None for a text that the library must see whole."""
        return None if unusual(text) else text.split()

    def count(self, text: str, frequent: dict[str, int]) -> int:
        found = self.pretokens(text)
        if found is None:
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return sum(self.lookup(found, frequent))


class ByteIds(Encoder):
    """Token ids with the byte-level vocabulary, as little-endian unsigned 32-bit integers.

    A space belongs to the pre-token behind it. In a run of two white-space characters before a word either stands alone (the
    second one with the word if it is a space); longer runs, and those at the end, are the library's own.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.newline, self.space = (self.whole(s) for s in "\n ")
        self.fast = byte_pair_encoding(path)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, pretokens: list[str]) -> dict[str, bytes]:
        return {p: array.array("I", self.fast.encode_ordinary(f" {p}")).tobytes() for p in pretokens}

    def ids(self, text: str) -> bytes:
        if unusual(text) or any(c in text for c in "\t\r\x0b\x0c"):
            return self.whole(text)
        spaces = text.replace("\n", " ")
        if "   " in spaces or spaces.endswith("  "):
            return self.whole(text)
        lines = [line.split(" ") for line in text.split("\n")]
        parts = self.lookup([p for line in lines for p in line[1:] if p], {})
        out, at = [], 0
        for k, line in enumerate(lines):
            if k:
                out.append(self.newline)
            if line[0]:
                out.append(self.first(line[0]))
            if all(line[1:]):
                out += parts[at : at + len(line) - 1]
                at += len(line) - 1
            else:
                for p in line[1:]:
                    out.append(parts[at] if p else self.space)
                    at += bool(p)
        return b"".join(out)

    def first(self, pretoken: str) -> bytes:
        """Of a pre-token without a space before it."""
        key = "\n" + pretoken  # no pre-token has a line break
        found = self.cache.get(key)
        if found is None:
            found = self.whole(pretoken)
            if len(pretoken) <= CACHE_LONGEST:
                self.cache[key] = found
        return found


_workers: dict[tuple[str, str], Encoder] = {}


def worker(kind: type[Encoder], path: str) -> Encoder:
    """The worker process' encoder for a vocabulary, kept between tasks."""
    if (kind.__name__, path) not in _workers:
        _workers[kind.__name__, path] = kind(path)
    return _workers[kind.__name__, path]


@contextmanager
def for_task(kind: type[Encoder], path: str) -> Iterator[Encoder]:
    """The worker process' encoder, whose cache is emptied at the end: a full one would stay with the idle worker through all that follows."""
    own = worker(kind, path)
    try:
        yield own
    finally:
        own.cache.clear()
