"""Whole texts as codes of their pieces, for operators that tokenize each distinct piece once."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable

import numpy as np


def coder() -> defaultdict:
    """A dictionary that gives each new key the next number."""
    codes: defaultdict = defaultdict()
    codes.default_factory = codes.__len__
    return codes


#: Latin letters that normal form C leaves alone and whose case is one character's affair.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")


_ALL_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ\n]+")


def is_plain(piece: str) -> bool:
    return _PLAIN.fullmatch(piece) is not None


def are_plain(pieces: list[str], joined: str) -> bool:
    """Whether all pieces are plain; joined: they themselves with line ends between them."""
    found = _ALL_PLAIN.fullmatch(joined)
    return found is not None and joined.count("\n") == len(pieces) - 1


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def splitter(pattern: str) -> Callable[[str], list[str]]:
    """All matches of a pattern."""
    import regex

    return regex.compile(pattern).findall
