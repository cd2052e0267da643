"""The question's algebra: positive and negative groups, limits, and the vector they combine to."""

from __future__ import annotations

import numpy as np

#: Limits: terms, characters in all, characters of the shortest positive term.
TERMS, CHARACTERS, SHORTEST = 10, 512, 5


class Refused(ValueError):
    """A question that can't be asked; the message names the limit: empty, long, terms or short."""


def parse(text: str) -> tuple[list[str], list[str]]:
    """(positive, negative) terms. ``+(..)`` and ``-(..)`` open groups, which may nest; ``|`` parts alternatives.

    A group that isn't closed takes the rest. Other parentheses are dropped. Any text parses.
    """
    sides: dict[bool, list[str]] = {True: [], False: []}
    open_: list[bool | None] = []  # a sign for each group, None for other parentheses
    held, positive = [], True

    def end() -> None:
        sides[positive].extend(t for part in "".join(held).split("|") if (t := " ".join(part.split())))
        held.clear()

    i = 0
    while i < len(text):
        two = text[i : i + 2]
        if two in ("+(", "-("):
            end()
            open_.append(positive)
            positive = positive == (two == "+(")
            i += 2
            continue
        if text[i] == "(":
            open_.append(None)
        elif text[i] == ")":
            if open_ and (back := open_.pop()) is not None:
                end()
                positive = back
        else:
            held.append(text[i])
        i += 1
    end()
    return sides[True], sides[False]


def check(positive: list[str], negative: list[str]) -> None:
    """Refusals in their order: empty, long, terms, short."""
    if not positive:
        raise Refused("empty")
    if sum(map(len, [*positive, *negative])) > CHARACTERS:
        raise Refused("long")
    if len(positive) + len(negative) > TERMS:
        raise Refused("terms")
    if min(map(len, positive)) < SHORTEST:
        raise Refused("short")


def combine(positive: np.ndarray, negative: np.ndarray | None = None) -> np.ndarray:
    """The unit mean of the positive vectors without its part along that of the negative ones, as 8-bit integers.

    What is left of less than a thousandth has been cancelled, which is refused.
    """
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    q = unit(np.mean([unit(p) for p in positive], axis=0))
    if negative is not None and len(negative):
        n = unit(np.mean([unit(p) for p in negative], axis=0))
        q = q - (q @ n) * n
        if np.linalg.norm(q) < 1e-3:
            raise Refused("cancelled")
        q = unit(q)
    return np.clip(np.floor(q * 127 + 0.5), -127, 127).astype(np.int8)
