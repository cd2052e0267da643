"""Text expressions: Column in, Column out, all JVM-side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Letters with marks that documents use, and their plain forms.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"


def fold(text: Column) -> Column:
    """Lower case without accents, for the Latin letters in ``MARKED``; deterministic, so usable in joins."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def fold_any(text: Column) -> Column:
    """Lower case without any combining accent; Catalyst treats it as non-deterministic, so project it before a join."""
    return F.call_function("java_method", F.lit("org.apache.commons.lang3.StringUtils"), F.lit("stripAccents"), F.lower(text))


def tokens(text: Column) -> Column:
    """Folded alphanumeric words of 2 to 39 characters."""
    return F.filter(F.split(fold(text), "[^a-z0-9]+"), lambda t: F.length(t).between(2, 39))


def cell_values(cell: Column, separator: str = ";") -> Column:
    """The trimmed non-empty values of a multi-valued cell."""
    return F.filter(F.transform(F.split(F.coalesce(cell, F.lit("")), separator), lambda v: F.trim(v)), lambda v: v != "")


def digit_key(line: Column) -> Column:
    """A line with each run of digits as ``#``, trimmed and lower-cased: running heads and feet share it."""
    return F.lower(F.trim(F.regexp_replace(line, r"\d+", "#")))


def tidy(text: Column) -> Column:
    """Runs of blanks become one, blank lines go, line ends stay."""
    out = F.regexp_replace(text, r"[ \t]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r" ?\n ?", "\n"), r"\n{2,}", "\n"))


#: Shortenings after which a full stop ends no sentence.
ABBREVIATIONS = ("e.g", "i.e", "etc", "fig", "figs", "al", "vs", "cf", "no", "nos", "vol", "pp", "ed", "eds", "dr", "mr", "mrs", "ms", "prof", "st", "approx", "ex", "chap", "p")


def ends_sentence(line: Column) -> Column:
    """Final punctuation that no shortening, initial or number goes before."""
    trimmed = F.trim(line)
    short = trimmed.rlike(r"(?i)(^|[^a-z0-9.])(" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")\.$")
    return trimmed.rlike(r"[.!?:;][\"')\]]*$") & ~short & ~trimmed.rlike(r"(^|[^A-Za-z])[A-Z]\.$") & ~trimmed.rlike(r"(^|\s)[0-9]+\.$")


def is_item(line: Column) -> Column:
    """A bullet, a number or a letter that opens a list item."""
    return F.trim(line).rlike(r"^([-*•–]|[0-9]{1,3}[.)]|[a-zA-Z][.)])\s")


def first_match(text: Column, table: list[tuple[str, str]]) -> Column:
    """The value of the first pattern in ``table`` that ``text`` matches."""
    return F.coalesce(*(F.when(text.rlike(p), F.lit(v)) for p, v in table), F.lit(""))


def ascii_edges(pattern: str) -> str:
    """``pattern`` with ``\\b`` where ASCII words end: Java 17 takes accented letters for letters of words there, RE2 and later Javas don't."""
    return pattern.replace(r"\b", r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))")


def marker_counts(text: Column, markers: dict[str, str]) -> dict[str, Column]:
    return {language: F.regexp_count(F.lower(text), F.lit(pattern)) for language, pattern in markers.items()}


def guess_language(text: Column, markers: dict[str, str], least: int = 10) -> Column:
    """The language with most markers; blank where markers are few or two languages tie for the first place."""
    counts = marker_counts(text, markers)
    most, total = F.greatest(*counts.values()), reduce(lambda a, b: a + b, counts.values())
    firsts = reduce(lambda a, b: a + b, ((c == most).cast("int") for c in counts.values()))
    named = F.coalesce(*(F.when(c == most, F.lit(k)) for k, c in counts.items()))
    return F.when((total < least) | (firsts > 1), F.lit("")).otherwise(named)


def without_identifiers(text: Column) -> Column:
    """ISBN, ISSN and long numbers as blanks, so that no year is read from them."""
    out = F.regexp_replace(text, r"(?i)(isbn|issn)[-: 0-9x]*", " ")
    return F.regexp_replace(out, r"[0-9][0-9-]{5,}[0-9]", " ")


def guess_year(name: Column, text: Column, fallback: Column, newest: int, oldest: int = 1940, head: int = 1500) -> Column:
    """A plausible year in the name, else in the text's head, else the fallback; null where none is plausible."""

    def first(column: Column) -> Column:
        found = F.transform(F.regexp_extract_all(column, F.lit(r"(?:^|[^0-9])((?:19|20)[0-9]{2})(?:$|[^0-9])"), F.lit(1)), lambda y: y.cast("int"))
        return F.get(F.filter(found, lambda y: y.between(oldest, newest)), F.lit(0))

    return F.coalesce(first(name), first(without_identifiers(F.substring(text, 1, head))), F.when(fallback.between(oldest, newest), fallback))


def isbn_valid(raw: Column) -> Column:
    """Whether the check digit of an ISBN-10 (mod 11, X is ten) or ISBN-13 (mod 10) is right."""
    digits = F.upper(F.regexp_replace(raw, "[^0-9Xx]", ""))
    value = lambda c: F.when(c == "X", F.lit(10)).otherwise(c.try_cast("int"))
    at = F.filter(F.split(digits, ""), lambda c: c != "")
    ten = F.aggregate(F.transform(at, lambda c, i: value(c) * (10 - i)), F.lit(0), lambda a, x: a + x.cast("int")) % 11 == 0
    thirteen = F.aggregate(F.transform(at, lambda c, i: value(c) * F.when(i % 2 == 0, 1).otherwise(3)), F.lit(0), lambda a, x: a + x.cast("int")) % 10 == 0
    return F.when(digits.rlike("^[0-9]{9}[0-9X]$"), ten).when(digits.rlike("^[0-9]{13}$"), thirteen).otherwise(F.lit(False))


def doi_of(pages: Column, head: int = 2) -> Column:
    """The one DOI after a marker in the first pages; blank where a page has several."""
    found = F.transform(
        F.slice(pages, 1, head),
        lambda p: F.array_distinct(F.transform(F.regexp_extract_all(p, F.lit(r"(?i)doi(?:\.org/|:)\s*(10\.[0-9]{4,9}/[^\s\"<>]+)"), F.lit(1)), lambda d: F.lower(F.regexp_replace(d, r"[.,;)]+$", "")))),
    )
    return F.when(F.exists(found, lambda d: F.size(d) > 1), F.lit("")).otherwise(F.coalesce(F.get(F.flatten(found), F.lit(0)), F.lit("")))


def href(name: Column) -> Column:
    """URL-encoded, with blanks as %20."""
    return F.replace(F.url_encode(name), F.lit("+"), F.lit("%20"))


def natural_key(title: Column) -> Column:
    """Folded, with digit runs padded, so that 9 comes before 10."""
    runs = F.regexp_extract_all(fold(title), F.lit("([0-9]+|[^0-9]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.when(r.rlike("^[0-9]+$"), F.lpad(r, 12, "0")).otherwise(r)), "")


def snippet_head(text: Column, most: int = 260) -> Column:
    """The head of a text, cut at a blank past three fifths of its room, with an ellipsis."""
    whole = tidy(text)
    head = F.substring(whole, 1, most)
    at = most - F.length(F.substring_index(head, " ", -1))
    cut = F.when(at > 0.6 * most, F.substring(head, F.lit(1), (at - 1).cast("int"))).otherwise(head)
    return F.when(F.length(whole) <= most, whole).otherwise(F.concat(cut, F.lit("…")))
