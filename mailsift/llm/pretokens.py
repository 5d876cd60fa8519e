"""Splitting text into pre-tokens, chunk by chunk.

Under the usual byte-level patterns a space before a non-space always opens a pre-token, so a text can be cut at its
spaces and each chunk (a word with what clings to it) handled by itself, once per worker as long as a bounded memo
keeps it. Where a space stands inside a longer run of white space the run decides, and the text goes through the
pattern whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

from mailsift.llm.common import Memo

#: A space that is neither the first nor the last of its run of white space, or that ends the text after another.
INNER_SPACE = re.compile(r"\s (?:\s|\Z)")
CHUNKS, PIECES = 100_000, 250_000


class Chunks:
    """Values of a text's chunks, in order; ``value(chunk)`` must only depend on the chunk's pre-tokens.

    ``whole`` gives the values of a text that can't be cut at its spaces; ``unsafe`` are strings (special tokens)
    that also send a text there.
    """

    def __init__(self, value: Callable[[str], object], whole: Callable[[str], list], unsafe: tuple[str, ...] = (),
                 most: int = CHUNKS):
        self.value, self.whole, self.unsafe = value, whole, unsafe
        self.spaced = Memo(lambda rest: value(" " + rest), most)

    def __call__(self, text: str) -> list:
        if any(s in text for s in self.unsafe) or INNER_SPACE.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        values = list(map(self.spaced.__getitem__, rest))
        return [self.value(first), *values] if first else values


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All pre-tokens of a text by a pattern."""
    return regex.compile(pattern).findall
