"""Byte-level BPE as the tokenizers library computes it, pre-token by pre-token.

The library defines the result. Special strings are cut out first, as it does. What lies between is split into
pre-tokens: by ``re`` where all code points are of classes that no Unicode version disputes, else by the library's
own pre-tokenizer. Each distinct pre-token is merged once per worker by a rank table read from the same file, so no
text is ever encoded as a whole.
"""

from __future__ import annotations

import json
import re

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

DEFAULT_FILE = "byte_bpe_50k.json"
#: Pre-tokens that a worker remembers before it starts anew.
REMEMBER = 400_000
LONGEST = 64

_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
#: The split of the byte-level scheme for code points that _OTHER doesn't match.
SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_OTHER = re.compile("[^\x00-ɏ‐-‧‰-⁞]")


def path_of(name: str) -> str:
    """A name that public_tokenizers knows, or a path."""
    return name if "/" in name else public_tokenizers.path(name)


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins for bytes: printable Latin-1 as itself, the others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairs:
    """encode() gives the ids as little-endian uint32 bytes; pieces() counts them for a pre-token."""

    _loaded: dict[str, BytePairs] = {}

    def __init__(self, file: str) -> None:
        with open(path_of(file), encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_str(json.dumps(spec | {"truncation": None, "padding": None}))
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if spec.get("normalizer") or any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("only plain byte-level files without a normalizer are covered")
        self.specials = {text: np.array([i], "<u4").tobytes() for text, i in added.items()}
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        alphabet = _byte_alphabet()
        ranks = {bytes(alphabet[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in self.specials}
        self.merger = tiktoken.Encoding("merger", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
        self.ids: dict[str, bytes] = {}

    @classmethod
    def of(cls, file: str) -> BytePairs:
        """One instance per worker process, kept over tasks."""
        if file not in cls._loaded:
            cls._loaded[file] = cls(file)
        return cls._loaded[file]

    def plain(self, text: str) -> bool:
        """Whether ``re`` splits this text as the library does."""
        return not _OTHER.search(text)

    def split(self, text: str) -> tuple[list[str], list[str]]:
        """The pre-tokens of a text and its special strings, each in order."""
        cut = self.special.findall(text) if self.special else []
        parts = self.special.split(text) if cut else [text]
        return [t for part in parts for t in self._pre_tokens(part)], cut

    def _pre_tokens(self, text: str) -> list[str]:
        if self.plain(text):
            return SPLIT.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def piece(self, token: str) -> bytes:
        """The ids of one pre-token."""
        ids = self.ids.get(token)
        if ids is None:
            ids = np.array(self.merger._core_bpe.encode_single_piece(token.encode()), "<u4").tobytes()
            if len(self.ids) >= REMEMBER:
                self.ids.clear()
            if len(token) <= LONGEST:
                self.ids[token] = ids
        return ids

    def encode(self, text: str) -> bytes:
        known, out, last = self.ids, [], 0
        marks = [*self.special.finditer(text)] if self.special else []
        for m in [*marks, None]:
            for token in self._pre_tokens(text[last : m.start() if m else len(text)] if marks else text):
                out.append(known.get(token) or self.piece(token))
            if m:
                out.append(self.specials[m[0]])
                last = m.end()
        return b"".join(out)
