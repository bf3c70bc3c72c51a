"""Byte-level BPE ids of whole texts, as the tokenizers library gives them for a .json vocabulary.

A text without a long run is encoded in one go. A huge text is encoded in overlapping chunks: each chunk's byte offsets are
the running sum of its tokens' lengths, and two neighbours are spliced at a *stable common boundary* p of the overlap: both
encodings have a token boundary at p, the character before p is not white space and the character at p is. The splitting
pattern has no alternative in which white space follows anything else, looks one character ahead at most and never back,
so p is a word boundary whatever stands further left or right: ids(text) = ids(text[:p]) + ids(text[p:]). Where an overlap
has no such p it is widened, and when it has reached the start of its chunk the chunk grows.

The ids come from tiktoken, built from the same .json (the vocabulary's ids are its merge ranks), which is about four
times as fast as tokenizers; tests/llm compare both over every code point and over texts. Vocabularies that are not plain
byte-level BPE go to tokenizers as a whole.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

CHUNK, OVERLAP = 1 << 12, 1 << 8
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Python counts U+001C to U+001F as white space, the pattern does not.
STABLE = re.compile(r"(?<=[\S\x1c-\x1f])(?=[^\S\x1c-\x1f])")


def _byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself where it is one, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in shown}
    free = 256
    for b in range(256):
        if b not in shown:
            out[chr(free)] = b
            free += 1
    return out


class Bpe:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast = None
        pre = spec.get("pre_tokenizer") or {}
        plain = spec["model"]["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        added = spec.get("added_tokens", [])
        plain = plain and all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not re.search(r"\s", t["content"]) for t in added)
        if plain:
            of, special = _byte_alphabet(), {t["content"]: t["id"] for t in added}
            ranks = {bytes(of[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
            merges = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
            made = [ranks[bytes(of[c] for c in m.replace(" ", "", 1))] for m in merges]
            if all(b in ranks for b in map(bytes, zip(range(256)))) and all(x < y for x, y in zip(made, made[1:])):
                self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
                self.width = np.zeros(max([*ranks.values(), *special.values()]) + 1, dtype=np.int64)
                for k, v in ranks.items():
                    self.width[v] = len(k)
                for k, v in special.items():
                    self.width[v] = len(k.encode())

    def _one(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except BaseException as e:  # the pattern engine's limit on very long runs of white space is a panic
                if isinstance(e, (KeyboardInterrupt, SystemExit, GeneratorExit)):
                    raise
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def ids(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
        """The ids of the whole text."""
        if not text:
            return np.zeros(0, dtype=np.uint32)
        if self.fast is None or len(text) <= 2 * chunk:
            return self._one(text)
        out: list[np.ndarray] = []
        at, size = 0, chunk  # the chunk starts at `at`, a proven boundary
        left = None
        while at + size < len(text):
            end = at + size
            left = self._one(text[at:end])
            edges = np.cumsum(self.width[left])
            wide, spliced = overlap, None
            while spliced is None:
                lo = max(at, end - wide)
                right = self._one(text[lo:end])
                spliced = self._common(text, at, lo, end, edges, np.cumsum(self.width[right]))
                if lo == at:
                    break
                wide *= 4
            if spliced is None:
                size *= 2
                continue
            p, k = spliced
            out.append(left[:k])
            at, size = p, chunk
        out.append(self._one(text[at:]))
        return np.concatenate(out)

    @staticmethod
    def _common(text: str, at: int, lo: int, end: int, left: np.ndarray, right: np.ndarray) -> tuple[int, int] | None:
        """The last stable boundary in (lo, end) at which both encodings have a token boundary: its place and the left tokens before it."""
        found = [m.start() + lo for m in STABLE.finditer(text[lo:end])]
        for p in reversed(found):
            if p <= at:
                break
            x, y = len(text[at:p].encode()), len(text[lo:p].encode())
            i, j = int(np.searchsorted(left, x)), int(np.searchsorted(right, y))
            if left[i] == x and right[j] == y:
                return p, i + 1
        return None


@lru_cache(maxsize=4)
def bpe(path: str) -> Bpe:
    """One a Python worker."""
    return Bpe(path)
