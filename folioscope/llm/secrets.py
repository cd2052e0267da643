"""Secret scans in DataFrame functions alone: fixed shapes, and strings whose characters look random.

Three base kinds are found leftmost and non-overlapping, each kind by itself: ``assign`` (a keyword, a separator and a
value of 12 characters or more), ``access`` (``AKIA`` and 14 or more capitals and digits) and ``hex`` (16 or more of
``0-9a-f``). The fourth kind, ``entropy``, is judged by a window of ``WINDOW`` characters that slides over each candidate
string: the counts gain the character that enters and lose the one that leaves, and the sum of n*log2(n) over the counts,
in whole units that don't drift, is corrected by those two terms alone, which gives the window's Shannon entropy. A
string is reported if any window reaches the threshold of its character class, unless the allow-list names it.

Defined results: a null or empty text has no spans; repeated rows each get their own result; offsets count code points,
ends are exclusive; overlapping spans of different kinds are all reported; columns named like results are replaced.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\\x20*[:=]\\x20*[\"']?"
_VALUE = "[A-Za-z0-9+/_.=-]"
#: A shorter value is matched too, and dropped afterwards: it uses up its text.
ASSIGN, LONG_ASSIGN = f"{_ASSIGN}{_VALUE}+", f"^{_ASSIGN}{_VALUE}{{12,}}$"
ACCESS, HEX = "AKIA[A-Z0-9]{14,}", "[0-9a-f]{16,}"

WINDOW = 20
CANDIDATE = f"[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Character classes: pattern, alphabet (letters lower-cased for the first), least entropy of a window in bits.
CLASSES = (
    ("^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 3.0),
    ("^", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.9),
)
#: Never reported: no digit or no letter, words joined by marks, one short piece again and again, samples. What can repeat
#: without bound gives nothing back (``++``): Java matches groups that may by recursion, and a long slug would end the stack.
ALLOWED = r"^[^0-9]+$|^[^A-Za-z]+$|^[A-Za-z]++(?:[/_=-]++[A-Za-z]++)*+[/_=-]*+[0-9]{0,4}$|^(.{1,4})\1+.{0,3}$|(?i:example|sample|placeholder|xxxxx)"
#: Matches that one inner step places; keeps the work on texts with very many matches near linear.
_BLOCK = 64
#: Fraction bits of n*log2(n), and characters of a candidate that are judged at once.
_BITS, _PIECE = 40, 4096


def _with(value: Column, then) -> Column:
    """``then(value)``, which may use the value several times or for each element: an array of one row makes it once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _lowest(text: Column, alphabet: str) -> Column:
    """The lowest sum of n*log2(n) over a window's counts, in units of 2^-``_BITS``, of any window of ``text``.

    Counts are letters of a string, one for each symbol of ``alphabet``, so that a step changes two of them in place.
    """
    terms = F.array(*(F.lit(_term(n)) for n in range(WINDOW + 1)))
    count = lambda counts, symbol: F.ascii(F.substring(counts, symbol, F.lit(1))) - ord("A")
    put = lambda counts, symbol, n: F.overlay(counts, F.char(n + ord("A")), symbol, F.lit(1))
    step = lambda state, **now: F.struct(*(now.get(k, state[k]).alias(k) for k in ("counts", "sum", "best", "seen")))

    def leave(state: Column, symbol: Column) -> Column:
        n = count(state["counts"], symbol)
        return F.when(symbol == 0, state).otherwise(step(state, counts=put(state["counts"], symbol, n - 1), sum=state["sum"] - F.get(terms, n) + F.get(terms, n - 1)))

    def enter(state: Column, symbol: Column) -> Column:
        n = count(state["counts"], symbol)
        total, seen = state["sum"] - F.get(terms, n) + F.get(terms, n + 1), state["seen"] + 1
        best = F.when(seen >= WINDOW, F.least(state["best"], total)).otherwise(state["best"])
        return step(state, counts=put(state["counts"], symbol, n + 1), sum=total, best=best, seen=seen)

    start = F.struct(F.lit("A" * len(alphabet)).alias("counts"), F.lit(0).cast("long").alias("sum"), F.lit(_term(WINDOW)).alias("best"), F.lit(0).alias("seen"))
    codes = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(alphabet), c))

    def walk(codes: Column) -> Column:
        leaving = F.concat(F.array_repeat(F.lit(0), WINDOW), codes)
        moves = F.zip_with(codes, F.slice(leaving, F.lit(1), F.size(codes)), lambda x, y: F.struct(x.alias("enters"), y.alias("leaves")))
        return F.aggregate(moves, start, lambda state, move: _with(leave(state, move["leaves"]), lambda now: enter(now, move["enters"])), lambda state: state["best"])

    return _with(codes, walk)


def _term(n: int) -> int:
    return round(n * log2(n) * (1 << _BITS)) if n else 0


def _reaches(text: Column, alphabet: str, least: float) -> Column:
    """Whether any window of ``text`` has an entropy of ``least`` bits. A long text goes piece by piece, each with the start of the
    next, up to the first that has."""
    limit = int((log2(WINDOW) - least + 1e-9) * WINDOW * (1 << _BITS))

    def found(pieces: Column) -> Column:
        whole = F.transform(pieces, lambda x, i: F.concat(x, F.substring(F.coalesce(F.get(pieces, i + 1), F.lit("")), 1, WINDOW - 1)))
        return F.exists(whole, lambda x: _lowest(x, alphabet) <= limit)

    return _with(F.regexp_extract_all(text, F.lit(f".{{1,{_PIECE}}}"), F.lit(0)), found)


def _random(text: Column) -> Column:
    """Whether the allow-list doesn't name ``text`` and its entropy reaches its class's threshold."""
    (hexes, low, least), (_, every, much) = CLASSES
    judged = F.when(text.rlike(hexes), _reaches(F.lower(text), low, least)).otherwise(_reaches(text, every, much))
    return ~text.rlike(ALLOWED) & judged


def _placed(found: Column, gaps: Column, kind: int) -> Column:
    """Structs (start, kind, end) of the matches, given the texts before, between and behind them."""
    empty = "array<struct<start:int,kind:int,end:int>>"

    def place(state: Column, i: Column) -> Column:
        start = state["at"] + F.length(F.get(gaps, i))
        end = start + F.length(F.get(found, i))
        one = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    def block(state: Column, first: Column) -> Column:
        inner = F.aggregate(
            F.sequence(first, F.least(first + _BLOCK, F.size(found)) - 1), F.struct(state["at"].alias("at"), F.array().cast(empty).alias("out")), place
        )
        return _with(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(state["out"], F.array(x["out"])).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{empty}>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1, F.lit(_BLOCK)), start, block, lambda state: F.flatten(state["out"]))


def _kept(kind: int, pattern: str, text: str) -> Column:
    """The spans of the matches that passed; only a text with such a match is cut at its matches."""
    found, none = F.col(f"_found{kind}"), F.array().cast("array<struct<start:int,kind:int,end:int>>")
    placed = _with(F.split(text, pattern, -1), lambda gaps: _placed(found, gaps, kind))
    kept = F.filter(placed, lambda x, i: F.get(f"_sound{kind}", i))
    return F.when(F.exists(f"_sound{kind}", lambda x: x), kept).otherwise(none).alias(f"_spans{kind}")


def scan(docs: DataFrame, *, text: str = "text", found: str = "found") -> DataFrame:
    """``docs`` with ``found``: the spans as structs (start, kind, end), sorted; ``kind`` indexes ``KINDS``."""
    kinds = range(len(KINDS))
    own = {f"_{name}{k}" for name in ("found", "sound", "spans") for k in kinds} | {found}
    names, patterns = [c for c in docs.columns if c not in own], (ASSIGN, ACCESS, HEX, CANDIDATE)
    tests = (lambda m: m.rlike(LONG_ASSIGN), lambda m: F.lit(True), lambda m: F.lit(True), _random)
    out = docs.select(*names, *(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(patterns[k]), F.lit(0)).alias(f"_found{k}") for k in kinds))
    out = out.select(*names, *(f"_found{k}" for k in kinds), *(F.transform(f"_found{k}", tests[k]).alias(f"_sound{k}") for k in kinds))
    out = out.select(*names, *(_kept(k, patterns[k], text) for k in kinds))
    return out.select(*names, F.array_sort(F.concat(*(f"_spans{k}" for k in kinds))).alias(found))


def spell(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"], x["end"])), ",")


def digest(scanned: DataFrame, keep: list[str]) -> DataFrame:
    """Counts by base kind, the base spans' digest, and all spans."""
    of = lambda test: F.filter("found", lambda x: test(x["kind"]))
    return scanned.select(
        *keep, *(F.size(of(lambda kind, k=k: kind == k)).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)),
        F.sha2(spell(of(lambda kind: kind < 3)), 256).alias("base_sha256"), spell(F.col("found")).alias("spans"),
    )


def _runs(found: Column) -> Column:
    """Overlapping or touching spans as one; the array is folded in blocks, so that work stays near linear."""
    empty = F.array().cast("array<struct<start:int,end:int>>")

    def merge(state: Column, x: Column) -> Column:
        joins = x["start"] <= state["end"]
        closed = F.when(joins | (state["end"] < 0), state["out"]).otherwise(F.concat(state["out"], F.array(F.struct(state["start"].alias("start"), state["end"].alias("end")))))
        return F.struct(
            F.when(joins, state["start"]).otherwise(x["start"]).alias("start"), F.when(joins, F.greatest(state["end"], x["end"])).otherwise(x["end"]).alias("end"), closed.alias("out")
        )

    def block(state: Column, first: Column) -> Column:
        inner = F.aggregate(F.slice(found, first, F.lit(_BLOCK)), F.struct(state["start"].alias("start"), state["end"].alias("end"), empty.alias("out")), merge)
        return _with(inner, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.concat(state["out"], F.array(x["out"])).alias("out")))

    start = F.struct(F.lit(0).alias("start"), F.lit(-1).alias("end"), F.array().cast("array<array<struct<start:int,end:int>>>").alias("out"))
    last = lambda state: F.concat(F.flatten(state["out"]), F.array(F.struct(state["start"].alias("start"), state["end"].alias("end"))))
    return F.aggregate(F.sequence(F.lit(1), F.size(found), F.lit(_BLOCK)), start, block, last)


def redact(docs: DataFrame, *, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with ``mark`` in the place of each run of overlapping spans; a text without spans stays as it is.

    A text with spans is cut into pieces of ``_PIECE`` characters first, so that each kept part is taken out of few of them.
    """
    names, r = [F.col(c) for c in docs.columns], F.col("_runs")
    scanned = scan(docs, text=text, found="_secrets")
    runs = scanned.select(*names, F.when(F.size("_secrets") > 0, _runs(F.col("_secrets"))).alias("_runs"))
    cut = runs.select(*names, "_runs", F.when(r.isNotNull(), F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))).alias("_pieces"))

    def part(start: Column, end: Column) -> Column:
        """The characters from ``start`` to ``end``."""
        inside = F.slice("_pieces", F.floor(start / _PIECE).cast("int") + 1, F.floor(F.greatest(end - 1, start) / _PIECE).cast("int") - F.floor(start / _PIECE).cast("int") + 1)
        return F.substring(F.array_join(inside, ""), F.pmod(start, F.lit(_PIECE)) + 1, end - start)

    before = F.transform(r, lambda x, k: part(F.coalesce(F.get(r, k - 1)["end"], F.lit(0)), x["start"]))
    tail = part(F.element_at(r, -1)["end"], F.length(text))
    clean = F.when(r.isNull(), F.col(text)).otherwise(F.array_join(F.concat(before, F.array(tail)), mark))
    return cut.select(*(clean.alias(c) if c == text else F.col(c) for c in docs.columns))
