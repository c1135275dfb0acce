"""Exact encoders with a memory of text units.

Both tokenizers below treat a text as independent units, and natural text repeats its units, so an encoder keeps
the result of a unit and encodes only those it has not met. The memory is bounded and emptied when full; it lives
in the Python worker and changes no result.
"""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import numpy as np

#: The byte-to-character table of byte-level vocabularies in JSON form: printable bytes stand for themselves.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: A space inside or at the end of a run of white space: there a cut before the space would split one pre-token.
_RUN = re.compile(r"\s \s|\s \Z")


def _byte_of() -> dict[str, int]:
    table, extra = {chr(b): b for b in _PRINTABLE}, 256
    for b in range(256):
        if b not in _PRINTABLE:
            table[chr(extra)], extra = b, extra + 1
    return table


def ranks_of(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Merge ranks and added tokens of a byte-level vocabulary, from a rank file or the JSON form.

    The JSON form is accepted only if its merges are listed in the order of their ids; then rank and id coincide.
    """
    if not path.endswith(".json"):
        with open(path, "rb") as file:
            return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}, {}
    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, added = whole["model"], {x["content"]: x["id"] for x in whole["added_tokens"]}
    table = _byte_of()
    ranks = {bytes(table[c] for c in token): i for token, i in model["vocab"].items() if token not in added}
    last = -1
    for merge in model["merges"]:
        a, b = merge if isinstance(merge, list) else merge.split(" ")
        rank = ranks[bytes(table[c] for c in a + b)]
        if rank <= last:
            raise ValueError("the merges are not in the order of their ids")
        last = rank
    return ranks, added


class ByteEncoder:
    """Byte-level BPE; ``pattern`` cuts a text into pre-tokens, each of which is encoded by itself.

    The pattern lets a space belong to the word after it, so that every space after which the run of white space
    ends begins a pre-token. Texts without longer runs that include a space are cut there; others are encoded whole.
    ``special`` decides whether the strings of added tokens inside a text become those tokens.
    """

    def __init__(self, path: str, pattern: str, special: bool = False, units: int = 400_000):
        import tiktoken

        ranks, added = ranks_of(path)
        self.special = added if special else {}
        self.encoding = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
        self.allowed, self.units, self.memory = frozenset(self.special), units, {}

    def _whole(self, text: str) -> bytes:
        return self.encoding._core_bpe.encode_to_tiktoken_buffer(text, self.allowed)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if " " not in text or _RUN.search(text) or any(s in text for s in self.special):
            return bytes(self._whole(text))
        first, *rest = text.split(" ")
        memory, parts = self.memory, [bytes(self._whole(first))] if first else []
        if len(memory) > self.units:
            memory.clear()
        for unit in rest:
            got = memory.get(unit)
            if got is None:
                got = bytes(self._whole(" " + unit))
                if len(unit) <= 64:
                    memory[unit] = got
            parts.append(got)
        return b"".join(parts)

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode(text), dtype="<u4")


class PieceCounter:
    """Counts of pieces of a sentencepiece model.

    No piece of such a vocabulary has the space mark after another character (checked when it is loaded), so no
    merge crosses the beginning of a run of spaces, and the units "run of spaces and what follows it" are encoded
    independently. Otherwise whole texts are encoded.
    """

    MARK = "▁"

    def __init__(self, path: str, units: int = 400_000):
        import sentencepiece

        self.model, self.units, self.memory = sentencepiece.SentencePieceProcessor(model_file=path), units, {}
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        neutral = self.model.encode("ﬁ ½", out_type=str) == [self.MARK, "ﬁ", self.MARK, "½"] and len(self.model.encode("a  b")) == 3
        self.cuts = neutral and not any(self.MARK in p.lstrip(self.MARK) for p in pieces)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.cuts or self.MARK in text:
            return len(self.model.encode(text))
        if "  " in text or text[0] == " " or text[-1] == " ":
            units = re.findall(r" *[^ ]+| +", text)
            units[1:] = [u[1:] for u in units[1:]]  # encoding a unit by itself sets one space before it
        else:
            units = text.split(" ")
        memory = self.memory
        if len(memory) > self.units:
            memory.clear()
        total, missed = 0, []
        if len(units) > 1 and not units[-1]:  # one space at the end is a piece of its own, but alone it would be nothing
            total, units = 1, units[:-1]
        for u in units:
            n = memory.get(u)
            if n is None:
                missed.append(u)
            else:
                total += n
        if missed:
            for u, got in zip(missed, self.model.encode(missed, num_threads=1), strict=True):
                total += len(got)
                if len(u) <= 64:
                    memory[u] = len(got)
        return total


@lru_cache(maxsize=8)
def byte_encoder(path: str, pattern: str, special: bool = False) -> ByteEncoder:
    """One encoder for each vocabulary and Python worker."""
    return ByteEncoder(path, pattern, special)


@lru_cache(maxsize=4)
def piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)
