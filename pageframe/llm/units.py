"""Texts cut where byte-level and piece tokenizers both start anew, and tables of what is known of a unit."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from types import ModuleType

#: White space before a space: there a space need not begin a unit.
DOUBLE = re.compile(r"\s ")
BREAK = re.compile(r"(?<=\S) ")
CACHED_UNITS = 500_000


def split_units(text: str) -> list[str]:
    """The text cut at each space that follows a character that is no white space, without those spaces.

    Byte-level pre-tokens never hold such a place inside, and pieces of a vocabulary in which a space only leads do not
    either, so the tokens of a text are those of its units, each but the first with its space in front.
    """
    return BREAK.split(text) if DOUBLE.search(text) else text.split(" ")


class Remembered(dict):
    """What `make` says of a key, made when first asked for.

    When a generation of keys is full the next begins; a key of the one before is carried over when it is met.
    """

    def __init__(self, make, most: int = CACHED_UNITS):
        super().__init__()
        self.make = make
        self.most = most
        self.before: dict = {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        value = self[key] = self.before[key] if key in self.before else self.make(key)
        return value


def per_worker(key: tuple, make: Callable):
    """What `make` returns, made once in a Python worker and kept from task to task.

    The package travels to executors by value, so its globals are new in every task; a registered module stays.
    """
    kept = _kept()
    if key not in kept:
        kept[key] = make()
    return kept[key]


def forget(kind: str) -> None:
    """Drops what the worker keeps under keys of a kind, where a later stage has no use for it."""
    for key in [key for key in _kept() if key[0] == kind]:
        del _kept()[key]


def _kept() -> dict:
    return sys.modules.setdefault("pageframe_worker", ModuleType("pageframe_worker")).__dict__.setdefault("kept", {})
