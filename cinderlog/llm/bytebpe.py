"""Ids of a byte-level BPE vocabulary, with a bounded memory of words.

The vocabulary's own pattern never joins text across a single blank between two
characters that are not white space, so the pieces between such blanks can be
encoded one by one. Each piece goes through the tokenizers library once and is
then remembered as the bytes of its ids, two each; ``MOST`` bounds that memory.
"""

from __future__ import annotations

import functools
import os
import re
from array import array

from cinderlog.llm.common import tokenizer_path

MOST = 700_000
VOCABULARY = "byte_bpe_50k.json"
CUT = re.compile(r"(?<=\S) (?=\S)")
# Letters, then ASCII marks: two units of the pattern.
MARKED = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]+)")


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = (b for b in range(256) if b not in set(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Uneven(Exception):
    """A blank stands beside other white space or at an end of the text."""


def uneven(piece: str) -> bool:
    return not piece or piece[0].isspace() or piece[-1].isspace()


class Pieces(dict):
    """Ids, two bytes each, of pieces that follow ``lead`` (a blank or nothing)."""

    def __init__(self, tokenizer, lead: str, most: int, head: Pieces | None = None) -> None:
        super().__init__()
        self.encode, self.bpe, self.lead, self.most = tokenizer.encode, tokenizer.model.tokenize, lead, most
        self.head = self if head is None else head
        self.letters = byte_letters()
        self.first = self.letters[32] if lead else ""
        self.marks: dict[str, bytes] = {}
        self.newline = self.bytes(self.encode("\n", add_special_tokens=False).ids)

    def __missing__(self, piece: str) -> bytes:
        if piece.isalpha():
            out = self.word(piece)
        elif (found := MARKED.fullmatch(piece)) and found[1].isalpha():
            # Only the letters are remembered.
            return self[found[1]] + (self.marks.get(found[2]) or self.mark(found[2]))
        elif uneven(piece):
            raise Uneven
        elif "\n" in piece and not any(map(uneven, lines := piece.split("\n"))):
            # A single line end between other characters is a unit of its own.
            first, *rest = lines
            return self[first] + b"".join(self.newline + self.head[line] for line in rest)
        else:
            out = self.whole(piece)
        if len(self) >= self.most:
            self.clear()
        self[piece] = out
        return out

    def mark(self, run: str) -> bytes:
        if len(self.marks) >= self.most:
            self.marks.clear()
        self.marks[run] = out = self.bytes([t.id for t in self.bpe(run)])
        return out

    def whole(self, piece: str) -> bytes:
        return self.bytes(self.encode(self.lead + piece, add_special_tokens=False).ids)

    @staticmethod
    def bytes(ids: list[int]) -> bytes:
        return array("H", ids).tobytes()

    def word(self, letters: str) -> bytes:
        """A run of letters is one unit of the pattern: it needs no splitting."""
        shown = letters if letters.isascii() else letters.encode().decode("latin-1").translate(self.letters)
        return self.bytes([t.id for t in self.bpe(self.first + shown)])


class ByteBPE:
    """With ``plain`` special strings inside texts are ordinary text."""

    def __init__(self, vocabulary: str = VOCABULARY, most: int = MOST, plain: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(vocabulary))
        self.tokenizer.encode_special_tokens = plain
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("this form holds ids below 65536")
        self.head = Pieces(self.tokenizer, "", most)
        self.inner = Pieces(self.tokenizer, " ", most, self.head)

    def encode(self, text: str) -> bytes:
        """All ids of a text as 16-bit bytes."""
        if not text:
            return b""
        first, *rest = text.split(" ")
        try:
            return self.head[first] + b"".join(map(self.inner.__getitem__, rest))
        except Uneven:
            first, *rest = CUT.split(text)
        pick = lambda known, piece: known.whole(piece) if uneven(piece) else known[piece]
        return pick(self.head, first) + b"".join(pick(self.inner, piece) for piece in rest)


@functools.cache
def shared(vocabulary: str = VOCABULARY, most: int = MOST) -> ByteBPE:
    """One encoder per Python worker; workers serve many tasks."""
    return ByteBPE(vocabulary, most)
