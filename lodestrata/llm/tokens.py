"""Token ids of a public byte-level BPE vocabulary, with the ids of repeated pre-tokens remembered.

Merges never cross the pre-tokens of the vocabulary's split pattern, so the ids
of a text are the joined ids of its pre-tokens. A new pre-token is merged by the rank
encoder, which is several times faster on single words; it is used only if the ids of
the vocabulary are its merge ranks, as checked when the file is read. Texts with characters on which
regular-expression engines could disagree (outside Latin), and texts that spell
an added token, go to the tokenizer whole.
"""

from __future__ import annotations

import json
from array import array
from functools import lru_cache

import regex
import tiktoken
from tokenizers import Tokenizer

#: The split pattern that the byte-level pre-tokenizer is published with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_split = regex.compile(PATTERN).findall
_other = regex.compile("[^\t\n\r\x20-\x7e¡-ɏ]").search
#: Pre-tokens remembered by one Python worker.
CACHE_ENTRIES = 200_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


def _rank_encoder(vocabulary: dict[str, int], merges: list):
    """Maps the bytes of one pre-token to ids; None if ids are not ranks."""
    pairs = (m if isinstance(m, str) else " ".join(m) for m in merges)
    if any(vocabulary.get(pair.replace(" ", "")) != 256 + rank for rank, pair in enumerate(pairs)):
        return None
    byte_of = _byte_of()
    ranks = {bytes(byte_of[c] for c in token): k for token, k in vocabulary.items() if k < 256 + len(merges)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class PackedEncoder(dict):
    """Maps a pre-token to its ids as packed little-endian 32-bit integers; ``encode`` does so for a text."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as source:
            file = json.load(source)
        self.added = [x["content"] for x in file["added_tokens"]]
        self.single = _rank_encoder(file["model"]["vocab"], file["model"]["merges"])

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, pre_token: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        packed = array("I", self.single(pre_token.encode())).tobytes() if self.single else self.whole(pre_token)
        if len(pre_token) <= 64:
            self[pre_token] = packed
        return packed

    def encode(self, text: str) -> bytes:
        if _other(text) or any(x in text for x in self.added):
            return self.whole(text)
        return b"".join(map(self.__getitem__, _split(text)))


@lru_cache(maxsize=1)
def encoder(path: str) -> PackedEncoder:
    """The encoder of a vocabulary file: one for each Python worker, which the worker's tasks share."""
    return PackedEncoder(path)
