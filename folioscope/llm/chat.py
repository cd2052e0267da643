"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. Nothing of its inside is used: successive turn
prefixes are rendered and consecutive outputs compared. Where an output begins with the one before it, the rest is the
new turn's span; where it doesn't, the template rewrites history, which is reported. A probe text in the last turn shows
where inside its span the turn's text stands; the texts of the loss roles make up the loss mask.

Rows are sorted by conversation and turn (ties: role, then text) over range partitions, so that a conversation of any length
is dealt over several tasks, and are formatted in segments of at most ``SEGMENT`` turns. That needs a template whose
output for turns in a row is that of each turn joined. No probe can show that, so its author declares it (``local``);
``is_local`` only finds wrong declarations. With any other template each conversation is one segment, held by one task.

Defined results: a null role or text counts as empty, a null conversation id is an id of its own; repeated rows are
turns of their own; a conversation without rows has no output; extra columns take no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

SEGMENT = 64
LOSS_ROLES = frozenset({"assistant"})
_PROBE = "\x00"

_MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s> ", " </s>")}
_CONTROL = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]", "[END]")
_ESCAPED = re.compile("|".join(map(re.escape, ("\\", *_CONTROL))))
_TURN = re.compile(r"<<SYS>>(?P<system>.*?)<</SYS>>|\[INST\] (?P<user>.*?) \[/INST\]|<s> (?P<assistant>.*?) </s>|\[ROLE\](?P<role>.*?)\[/ROLE\](?P<text>.*?)\[END\]", re.S)


def escape(text: str) -> str:
    """Doubles backslashes and sets one behind the first character of each control string, so that none is left."""
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def local(template: Template) -> Template:
    """Declares that turns in a row come out as each turn's own output joined, whatever their roles, texts and number."""
    template.local = True
    return template


@local
def instruct(turns: list[Turn]) -> str:
    """The operator's own template: each turn between marks of its role, other roles by name."""
    out = []
    for role, text in turns:
        left, right = _MARKS.get(role) or (f"[ROLE]{escape(role)}[/ROLE]", "[END]")
        out += left, escape(text), right
    return "".join(out)


def parse(formatted: str) -> list[Turn]:
    """The turns of an output of ``instruct``."""
    return [
        (unescape(m["role"]), unescape(m["text"])) if m["role"] is not None else (m.lastgroup, unescape(m[m.lastgroup])) for m in _TURN.finditer(formatted)
    ]


def is_local(template: Template) -> bool:
    """Whether turns in a row come out as each turn's own output joined, for each pair of roles."""
    turns = [(role, text) for role in ("system", "user", "assistant", "tool", "") for text in (" probe ", "")]
    alone = {turn: template([turn]) for turn in turns}
    return all(template([a, b]) == alone[a] + alone[b] for a in turns for b in turns)


def locate(turns: list[Turn], template: Template, loss_roles=LOSS_ROLES) -> tuple[str, list[list[int]], list[list[int]], bool]:
    """(output, each turn's span, spans under the loss mask, whether some prefix's output was rewritten)."""
    before, spans, loss, rewritten = "", [], [], False
    for k, (role, _) in enumerate(turns):
        after = template(turns[: k + 1])
        if not after.startswith(before):
            rewritten = True
            break
        spans.append([len(before), len(after)])
        if role in loss_roles:
            probe = template([*turns[:k], (role, _PROBE)])
            at = probe.find(_PROBE, len(before))
            if not probe.startswith(before) or at < 0:
                rewritten = True
                break
            loss.append([at, len(after) - (len(probe) - at - len(_PROBE))])
        before = after
    return (template(turns), [], [], True) if rewritten else (before, spans, loss, False)


_SPANS = pa.list_(pa.list_(pa.int64()))
_OUT = "part long, n_turns long, formatted string, spans array<array<long>>, loss array<array<long>>, rewritten boolean"


def _formatter(template: Template, loss_roles, limit: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        rows = chain.from_iterable(zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True) for b in batches)
        key, turns = None, []

        def flush():
            nonlocal part, turns
            text, spans, loss, rewritten = locate(turns, template, loss_roles)
            values = ([key], [part], [len(turns)], [text], [spans], [loss], [rewritten])
            kinds = (None, pa.int64(), pa.int64(), pa.string(), _SPANS, _SPANS, pa.bool_())
            part, turns = part + 1, []
            return pa.RecordBatch.from_arrays([pa.array(v, k or pa.int64()) for v, k in zip(values, kinds, strict=True)], names=["conv_id", "part", "n_turns", "formatted", "spans", "loss", "rewritten"])

        for conv, role, text in rows:
            if turns and (conv != key or limit and len(turns) >= limit):
                yield flush()
            key = conv
            turns.append((role or "", text or ""))
        if turns:
            yield flush()

    return run


def format_conversations(turns: DataFrame, *, template: Template = instruct, loss_roles=LOSS_ROLES, segment: int = SEGMENT) -> DataFrame:
    """A row for each segment of a conversation: conv_id, part (their order), n_turns, formatted, spans, loss, rewritten.

    ``turns`` has conv_id long, turn long, role and text.
    """
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    by = ["conv_id", "turn", "role", "text"]
    parted = getattr(template, "local", False) and is_local(template)
    dealt = (rows.repartitionByRange(*by) if parted else rows.repartition("conv_id")).sortWithinPartitions(*by)
    return dealt.mapInArrow(_formatter(template, frozenset(loss_roles), segment if parted else None), f"conv_id long, {_OUT}")


def _digester(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation's segments come in order; only counts and running digests are kept."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewritten", pa.bool_())])
    key, now, out = None, None, []

    def done():
        out.append((key, now[0], now[1].hexdigest(), now[2], now[3].hexdigest(), now[4], now[5]))

    for batch in batches:
        for conv, text, loss, rewritten in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss", "rewritten")), strict=True):
            if now is None or conv != key:
                if now is not None:
                    done()
                key, now = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, False]
            for role, said in parse(text):
                now[0] += 1
                now[1].update(f"{role}\n{said}\n".encode())
            for i, j in loss:
                said = unescape(text[i:j])
                now[2] += len(said)
                now[3].update(said.encode())
            now[4] += len(text)
            now[5] |= rewritten
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)
            out = []
    if now is not None:
        done()
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema=schema)


def digest(segments: DataFrame) -> DataFrame:
    """Counts and digests by conversation, read back from the formatted text.

    A digest is made in the order of the turns, so each conversation streams through one task, which keeps no more
    than a segment of it.
    """
    dealt = segments.select("conv_id", "part", "formatted", "loss", "rewritten").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return dealt.mapInArrow(_digester, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewritten boolean")
