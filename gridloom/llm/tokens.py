"""Byte-level BPE ids of texts, by a vocabulary file in the JSON format of the `tokenizers` library.

The ids are those that `tokenizers` gives for the same file (tests hold them against it): with
`added`, the file's added tokens written out in a text are single ids, as the library has it unless
`encode_special_tokens` is set; without, they are plain text.  Whole texts go to the encoder in one
call; only very long runs of white space, which its pattern matcher cannot take, are encoded apart.
"""

from __future__ import annotations

import json
import re

import numpy as np

# Fixed value: the pre-tokenisation pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LONG = 50_000
_BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % _LONG)


def _byte_letters() -> dict[str, int]:
    """Letter -> byte of the byte-level alphabet: printable bytes stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_encoding(path: str):
    """A tiktoken encoder with the vocabulary of a `tokenizers` JSON file (byte-level BPE, ids in merge order)."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = _byte_letters()
    special = {t["content"] for t in spec.get("added_tokens", ())}
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def load_added(path: str) -> dict[str, int]:
    """Added token -> id."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    tokens = spec.get("added_tokens", ())
    for t in tokens:
        if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
            raise ValueError(f"added token {t['content']!r}: only tokens matched as they stand are supported")
    return {t["content"]: t["id"] for t in tokens}


class Encoder:
    def __init__(self, path: str, added: bool = False):
        self.encoding = load_encoding(path)
        self.added = load_added(path) if added else {}
        # Of tokens that start at one place the longest counts, as in the library.
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split

    def ids(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        if not any(token in text for token in self.added):
            return np.array(self._plain(text), "<u4")
        out: list[int] = []
        for i, part in enumerate(self.cut(text)):
            if i % 2:
                out.append(self.added[part])
            else:
                out += self._plain(part)
        return np.array(out, "<u4")

    def _plain(self, text: str) -> list[int]:
        encode = self.encoding.encode_ordinary
        if len(text) < _LONG:
            return encode(text)
        out: list[int] = []
        done = 0
        for run in _BLANKS.finditer(text):
            # The pattern takes a run whole, but for its last character where a word follows.
            end = run.end() - (run.end() < len(text))
            out += encode(text[done : run.start()])
            out += self.encoding._encode_single_piece(text[run.start() : end])
            done = end
        return out + encode(text[done:])
