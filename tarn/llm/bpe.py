"""Byte-level BPE from files of the tokenizers library: its ids, whole texts or by pre-tokens."""

from __future__ import annotations

import functools
import json

import numpy as np

#: The split that byte-level BPE files of this kind use.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def _bytes_by_sign() -> dict[str, int]:
    """The sign that stands for each byte in such files: itself if it can be printed, else the next free one from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBPE:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        odd = [t for t in spec["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]]
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or odd:
            raise ValueError(f"{path} isn't a plain byte-level BPE file")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._find = regex.compile(PATTERN).findall
        vocab, merges = spec["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        if all(vocab[a + b] == 256 + i for i, (a, b) in enumerate(merges)):
            # ids are the ranks of merges, so that a faster library gives the same ids
            import tiktoken

            byte = _bytes_by_sign()
            ranks = {bytes(byte[c] for c in piece): i for piece, i in vocab.items() if piece not in self.special}
            self._all = tiktoken.Encoding("all", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            self._one = tiktoken.Encoding("one", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            library = Tokenizer.from_file(path)
            self._all = self._one = lambda text: library.encode(text, add_special_tokens=False).ids

    def pretokens(self, text: str) -> list[str]:
        """The pre-tokens in order; special strings stand as they are, as one each."""
        if self._cut is None or not any(s in text for s in self.special):
            return self._find(text)
        out: list[str] = []
        for k, part in enumerate(self._cut.split(text)):
            out += [part] if k % 2 else self._find(part)
        return out

    def counts(self, pretokens: list[str]) -> list[int]:
        """How many pieces each pre-token, or special string, has."""
        return [1 if x in self.special else len(self._one(x)) for x in pretokens]

    def packed(self, text: str) -> bytes:
        """The ids of a text, little-endian, 4 bytes each."""
        if self._cut is None or not any(s in text for s in self.special):
            return np.array(self._all(text), "<u4").tobytes()
        parts = self._cut.split(text)
        return b"".join(np.array([self.special[x]] if k % 2 else self._all(x), "<u4").tobytes() for k, x in enumerate(parts))


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    """One per worker process."""
    return ByteBPE(path)
