"""Token ids by a byte-level BPE file of the ``tokenizers`` library, with a cache of text chunks."""

from __future__ import annotations

import json
import os
from array import array

import numpy as np

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
# Chunks whose ids a Python worker keeps, and their longest length.
CACHE_CHUNKS = 400_000
CACHE_LENGTH = 48
# Below this character all libraries agree on which characters are letters and numbers.
LATIN_END = "\u0250"
# Fixed: how the vocabulary's pre-tokenizer cuts a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of whole texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    What a byte-level pre-tokenizer does from a position on depends on nothing before it, and it never
    joins a character with white space after it. So a text may be cut before any space or line
    feed that follows another kind of character, and the chunks encoded one by one. The ids of common
    chunks are kept. Other chunks of letters whose classes all libraries agree on are merged by
    the same vocabulary in its faster form; all else (special tokens, control characters, other
    scripts, white space in a row) takes the tokenizer itself. ``ordinary`` takes the strings of
    special tokens as ordinary text.
    """

    def __init__(self, path: str, ordinary: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = ordinary
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = [] if ordinary else special
        self.cache: dict[str, bytes] = {}
        self.fast = _ranked(path)

    def _plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _chunk(self, chunk: str) -> bytes | None:
        """Ids of a chunk as ``encode`` cuts it; None if the cut after it is not safe."""
        if not chunk or chunk[-1].isspace():
            return None
        ids = self.run("\n" + chunk[1:] if chunk[0] == "\0" else " " + chunk)
        if len(self.cache) < CACHE_CHUNKS and len(chunk) <= CACHE_LENGTH:
            self.cache[chunk] = ids
        return ids

    def run(self, text: str) -> bytes:
        """Ids of a short text without special tokens."""
        if self.fast and max(text) < LATIN_END and text[1:].isprintable() and text[0] in " \n":
            return array("I", self.fast.encode_ordinary(text)).tobytes()
        return self._plain(text)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if "\0" in text or any(s in text for s in self.special):
            return self._plain(text)
        head, *rest = text.replace("\n", " \0").split(" ")
        if not rest or not head or head[-1].isspace():
            return self._plain(text)
        parts = list(map(self.cache.get, rest))
        if None in parts:
            for i, part in enumerate(parts):
                if part is None:
                    parts[i] = self._chunk(rest[i])
                    if parts[i] is None:
                        return self._plain(text)
        return self._plain(head) + b"".join(parts)


def _ranked(path: str):
    """The vocabulary of the file as merge ranks, if its merges are in the order of its ids."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    shown = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    merged = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [model["vocab"]["".join(pair)] for pair in merged]
    if ids != list(range(256, 256 + len(ids))):
        return None
    ranks = {bytes(map(byte.__getitem__, t)): i for t, i in model["vocab"].items() if i < 256 + len(ids)}
    return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, ordinary: bool = False) -> Encoder:
    """The worker's encoder of a vocabulary file; kept from task to task."""
    if (path, ordinary) not in _ENCODERS:
        _ENCODERS[path, ordinary] = Encoder(path, ordinary)
    return _ENCODERS[path, ordinary]
