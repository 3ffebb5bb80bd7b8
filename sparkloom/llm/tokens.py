"""Tokenizing whole texts inside tasks, each distinct piece of text once.

A piece is cut so that no token crosses its ends: at single spaces for the byte-level vocabulary, at white
space for the word vocabulary. Texts in which that can't be told (special strings, runs of white space, or
characters outside Latin letters and printable ASCII) go to the tokenizers library as a whole.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np

os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism

PIECES = 100_000  # remembered by a Python worker at most,
LETTERS = 64  # and only pieces of so many characters at most, so some 20 MB
TEXT = 1_000_000  # characters of texts cut into pieces at once, about; a longer text is one by itself
_ODD = re.compile("[^\t\n\r\x20-\x7e¡-įı-ɏ]|<\\|")
# the same without what lower-cases to characters outside
_ODD_LOWER = re.compile("[^\t\n\r\x20-\x7e" + "".join(c for c in map(chr, range(0xA1, 0x250)) if not _ODD.search(c + c.lower())) + "]|<\\|")
_GAPS = re.compile(r"\s\s|\s\Z")


def _parts(texts: list[str], most: int = TEXT) -> Iterator[list[int]]:
    """Places of texts, in order, in parts of about `most` characters."""
    part, chars = [], 0
    for i, t in enumerate(texts):
        part.append(i)
        chars += len(t)
        if chars >= most:
            yield part
            part, chars = [], 0
    if part:
        yield part


def digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


class ByteCounts:
    """Token counts by a byte-level vocabulary of the tokenizers library, special strings handled as its default."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.first: dict[str, int] = {}  # counts of a text's first piece
        self.later: dict[str, int] = {}  # counts of a piece with the space before it

    def _learn(self, seen: dict[str, int], pieces: set[str], before: str) -> dict[str, int]:
        """Counts of the pieces that are not remembered; of those, short ones are from now on."""
        new, got = [p for p in pieces if p not in seen], {}
        for i in range(0, len(new), 5000):
            part = new[i : i + 5000]
            for p, e in zip(part, self.library.encode_batch_fast([before + p for p in part], add_special_tokens=False), strict=True):
                got[p] = len(e.ids)
        if len(seen) + len(got) > PIECES:
            seen.clear()
        return got

    def counts(self, texts: list[str]) -> list[int]:
        """Token counts of the texts; pieces of a part of them are held at once, not those of all."""
        out = [0] * len(texts)
        for places in _parts(texts):
            whole = [k for k in places if _ODD.search(texts[k]) or _GAPS.search(texts[k])]
            for i in range(0, len(whole), 64):
                part = whole[i : i + 64]
                for k, e in zip(part, self.library.encode_batch_fast([texts[k] for k in part], add_special_tokens=False), strict=True):
                    out[k] = len(e.ids)
            cut = {k: texts[k].split(" ") for k in sorted({*places}.difference(whole))}
            for seen, before, pieces in ((self.first, "", {p[0] for p in cut.values()}), (self.later, " ", {x for p in cut.values() for x in p[1:]})):
                known = {p: seen[p] for p in pieces if p in seen} | (got := self._learn(seen, pieces, before))
                for k, p in cut.items():
                    out[k] += sum(map(known.__getitem__, p[1:])) if before else known[p[0]]
                seen.update((p, n) for p, n in got.items() if len(p) <= LETTERS)
        return out


class WordIds:
    """Ids by the lower-casing word vocabulary, as little-endian unsigned 32-bit bytes, without special tokens added.

    The merges run in tiktoken over the same vocabulary as ranks, a zero byte standing for the end of a word;
    the tokenizers library itself encodes every text outside the plain alphabet, and tests hold both equal.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["id"] for t in model["added_tokens"]}
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
        ranks, ends = {}, np.zeros(max(model["model"]["vocab"].values()) + 1, bool)
        for token, i in model["model"]["vocab"].items():
            if i in special:
                continue
            end = i >= 256 and token.endswith("</w>")
            ranks[bytes(byte[c] for c in (token[:-4] if end else token)) + b"\0" * end] = i
            ends[i] = end
        self.ends = ends
        self.merges = tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})
        letters, numbers, space = "a-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t\n\r "
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+")
        self.seen: dict[str, bytes] = {}

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks that are not remembered; of those, short ones are from now on."""
        got = {}
        for i in range(0, len(chunks), 20_000):
            part = chunks[i : i + 20_000]
            words = [self.split.findall(c) for c in part]
            ids = self.merges.encode_to_numpy("".join("\0".join(w) + "\0" for w in words)).astype("<u4")
            stops = np.flatnonzero(self.ends[ids])[np.cumsum([len(w) for w in words]) - 1] + 1
            raw, last = ids.tobytes(), 0
            for c, stop in zip(part, (stops * 4).tolist(), strict=True):
                got[c] = raw[last:stop]
                last = stop
        if len(self.seen) + len(got) > PIECES:
            self.seen.clear()
        return got

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of the texts; chunks of a part of them are held at once, not those of all."""
        out: list[bytes] = [b""] * len(texts)
        for places in _parts(texts):
            chunks: dict[int, list[str]] = {}
            distinct: set[str] = set()
            for i in places:
                if _ODD_LOWER.search(texts[i]):
                    out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, "<u4").tobytes()
                else:
                    chunks[i] = texts[i].lower().split()
                    distinct.update(chunks[i])
            known = {c: self.seen[c] for c in distinct if c in self.seen} | (got := self._learn([c for c in distinct if c not in self.seen]))
            for i, c in chunks.items():
                out[i] = b"".join(map(known.__getitem__, c))
            self.seen.update((c, x) for c, x in got.items() if len(c) <= LETTERS)
        return out


_loaded: dict[tuple[type, str], object] = {}


def loaded(kind: type, path: str):
    """One tokenizer a Python worker, kept with its pieces from task to task."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]
