"""A worker's cache of what a tokenizer makes of pre-tokens, filled a batch at a time.

Texts of plain Latin characters are cut where the pre-tokenizer cuts them, by one regular expression over the whole
text; all other texts are cut at white space, and their words that aren't plain stay whole. What a batch of texts misses
goes to the tokenizer's library together, so a new pre-token costs a small part of a call.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Mapping
from itertools import chain

#: ASCII without its rarer control characters, and Latin-1 letters.
PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")

#: Characters of the longest piece that is kept.
LONG = 256


def load(definition: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks share the cores already
    from tokenizers import Tokenizer

    return Tokenizer.from_str(definition)


def is_plain(text: str) -> bool:
    """No character on which engines differ, and nothing that could be part of a special token."""
    return PLAIN.fullmatch(text) is not None and "<|" not in text


class Pieces:
    """Piece of text -> value. Two generations of at most `size` entries above `known`: what is in use moves on when one is full.

    make(pieces) gives the values of pieces that are missing, all at once. `known` (values of frequent pieces) is part of
    every generation.
    """

    def __init__(self, make: Callable[[list[str]], Iterable], known: Mapping | None = None, size: int = 400_000):
        self.make, self.known, self.size = make, dict(known or {}), size
        self.new, self.old = dict(self.known), {}

    def look_up(self, cuts: list[list[str]]) -> list[list]:
        """The values of the pieces of each text."""
        if len(self.new) - len(self.known) > self.size:
            self.old, self.new = self.new, dict(self.known)
        get = self.new.get
        found = [list(map(get, pieces)) for pieces in cuts]
        gaps = [i for i, values in enumerate(found) if None in values]
        if gaps:
            missed = dict.fromkeys(chain.from_iterable((p for p, v in zip(cuts[i], found[i], strict=True) if v is None) for i in gaps))
            for piece in missed:
                missed[piece] = self.old.get(piece)
            unknown = [p for p, v in missed.items() if v is None]
            missed.update(zip(unknown, self.make(unknown), strict=True))
            self.new.update((p, v) for p, v in missed.items() if len(p) <= LONG)
            for i in gaps:
                found[i] = [missed[p] if v is None else v for p, v in zip(cuts[i], found[i], strict=True)]
        return found

