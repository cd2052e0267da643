"""Repair of extracted text: normal forms, split words, sentences, and passages around a question's words.

What looks ahead or back over several lines runs on Arrow batches, one text at a time; the rest is expressions.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pandas as pd
from pyspark.sql import Column, functions as F

from . import text as t

#: Characters that extraction leaves behind, and what stands for them.
LEFT_BEHIND = {
    "­": "", "​": "", "‌": "", "‍": "", "﻿": "", " ": " ", " ": " ", " ": " ", " ": " ", "": "•", "‣": "•",
}
_PRIVATE = re.compile("[-]")
_WORD = re.compile(r"\w+")
_SPLIT = re.compile(r"(\w+)-\n(\w+)")
_BOUNDARY = re.compile(r"(?<=[.!?])[\"')\]]*\s+(?=[\"'(\[]?[A-ZÀ-Þ0-9])")
_NO_END = re.compile(r"(?:(?i:(?:^|[^a-z0-9.])(?:" + "|".join(re.escape(a) for a in t.ABBREVIATIONS) + r"))|(?:^|[^A-Za-z])[A-Z]|(?:^|\s)[0-9]+)\.$")


def clean(text: str | None) -> str:
    """NFKC, without private characters; left-behind ones replaced; blanks collapsed; empty without a letter or digit."""
    out = "".join(LEFT_BEHIND.get(c, c) for c in text or "")
    out = unicodedata.normalize("NFKC", _PRIVATE.sub("", out))
    out = "\n".join(" ".join(line.split()) for line in out.split("\n")).strip()
    return out if any(c.isalnum() for c in out) else ""


def rejoin(text: str | None) -> str:
    """Words parted at a line's end are joined where the text uses the joined form as often as the hyphenated, and the
    second part begins in lower case. A joined line may give its end to the next."""
    text = text or ""
    plain, hyphened = Counter(w.lower() for w in _WORD.findall(text)), Counter(w.lower() for w in re.findall(r"\w+-\w+", text))

    def one(m: re.Match) -> str:
        if not m[2][:1].islower():
            return m[0]
        return m[1] + m[2] if plain[(m[1] + m[2]).lower()] >= hyphened[f"{m[1]}-{m[2]}".lower()] else f"{m[1]}-{m[2]}"

    while (joined := _SPLIT.sub(one, text)) != text:
        text = joined
    return text


def sentences(text: str | None) -> list[str]:
    """Pieces that end in final punctuation, unless a shortening, initial or number goes before it."""
    out: list[str] = []
    for piece in _BOUNDARY.split(text or ""):
        if out and _NO_END.search(out[-1]):
            out[-1] = f"{out[-1]} {piece}"
        else:
            out.append(piece)
    return [s for s in (p.strip() for p in out) if s]


def around(text: str | None, terms: list[str], most: int = 260, snap: int = 30) -> str:
    """The stretch with most distinct terms, centred, its ends moved to blanks near by, with ellipses where text is cut."""
    whole = re.sub(r"\n{2,}", "\n", re.sub(r" ?\n ?", "\n", re.sub(r"[ \t]+", " ", text or ""))).strip()
    if len(whole) <= most:
        return whole
    folded = "".join(unicodedata.normalize("NFD", c)[0].lower() for c in whole)
    wanted = set(terms)
    hits = [(m.start(), m.end(), m[0]) for m in re.finditer("[a-z0-9]+", folded) if m[0] in wanted]
    if not hits:
        at = whole.rfind(" ", 0, most + 1)
        return whole[: at if at > 0.6 * most else most] + "…"
    best = max(range(len(hits)), key=lambda i: (len({w for s, e, w in hits[i:] if e <= hits[i][0] + most}), -i))
    inside = [h for h in hits[best:] if h[1] <= hits[best][0] + most]
    start = max(0, min(len(whole) - most, (inside[0][0] + inside[-1][1] - most) // 2))
    end = start + most
    if start and 0 <= (at := whole.find(" ", start, start + snap)) <= inside[0][0]:
        start = at + 1
    if end < len(whole) and (at := whole.rfind(" ", end - snap, end)) >= inside[-1][1]:
        end = at
    return ("…" if start else "") + whole[start:end] + ("…" if end < len(whole) else "")


def on_texts(function, kind: str, *columns: Column | str) -> Column:
    """``function`` of each row's values, on Arrow batches."""

    @F.pandas_udf(kind)
    def run(first: pd.Series, *others: pd.Series) -> pd.Series:
        return pd.Series([function(*values) for values in zip(first, *others, strict=True)], dtype=object)

    return run(*columns)


def cleaned(text: Column | str) -> Column:
    return on_texts(clean, "string", text)


def rejoined(text: Column | str) -> Column:
    return on_texts(rejoin, "string", text)


def split_sentences(text: Column | str) -> Column:
    return on_texts(sentences, "array<string>", text)


def snippet(text: Column | str, terms: Column | str) -> Column:
    return on_texts(lambda x, w: around(x, list(w)), "string", text, terms)


def ligature_votes(words: Column, readings: list[str], mark: str = "\u0001") -> Column:
    """For words with an unreadable code in them, how many of the document's words each reading makes."""
    known = F.filter(words, lambda w: ~F.contains(w, F.lit(mark)))
    broken = F.filter(words, lambda w: F.contains(w, F.lit(mark)))
    return F.transform(
        F.array(*map(F.lit, readings)), lambda r: F.struct(F.size(F.filter(broken, lambda w: F.array_contains(known, F.replace(w, F.lit(mark), r)))).alias("votes"), r.alias("reading"))
    )


def read_ligatures(text: Column, readings: list[str], mark: str = "\u0001") -> Column:
    """The code as the reading that makes most known words, or as a blank if none does."""
    best = F.array_max(F.transform(ligature_votes(F.split(F.lower(text), r"[^\w\x01]+"), readings, mark), lambda s: F.struct(s["votes"], s["reading"])))
    return F.replace(text, F.lit(mark), F.when(best["votes"] > 0, best["reading"]).otherwise(F.lit(" ")))
