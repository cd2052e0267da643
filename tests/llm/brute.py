"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re


def sha(x: str | bytes) -> str:
    return hashlib.sha256(x.encode() if isinstance(x, str) else x).hexdigest()


def lower_ascii(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text)


def decontaminate(docs, items, n=13):
    word = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower_ascii(t or ""))
    windows: dict[tuple, set[str]] = {}
    for item, text in items:
        if item is None:
            continue
        w = word(text)
        for i in range(max(1, len(w) - n + 1)) if w else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = word(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (x := tuple(w[i : i + size])) in windows:
                    hit.update(range(i, i + size))
                    found |= windows[x]
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def secrets_base(text):
    """[(start, kind index, end)] of the base kinds."""
    text, out = text or "", []
    for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def secrets_entropy(text, window, candidate, classes, allowed):
    """[(start, 3, end)]: every window's entropy counted anew."""
    from collections import Counter
    from math import log2

    out = []
    for m in re.finditer(candidate, text or ""):
        x = m[0]
        if re.search(allowed, x):
            continue
        small = re.search(classes[0][0], x)
        least, y = (classes[0][2], x.lower()) if small else (classes[1][2], x)
        best = max(-sum(n / window * log2(n / window) for n in Counter(y[i : i + window]).values()) for i in range(len(y) - window + 1))
        if best >= least - 1e-9:
            out.append((m.start(), 3, m.end()))
    return out


def spell_secrets(spans):
    return ",".join(f"{('assign', 'access', 'hex', 'entropy')[k]}:{i}:{j}" for i, k, j in sorted(spans))


def chat(rows):
    """rows: (conv_id, turn, role, text). {conv_id: (n_turns, turns_sha256, loss_chars, loss_sha256)}."""
    convs: dict = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")):
        convs.setdefault(c, []).append((r or "", x or ""))
    loss = {c: "".join(x for r, x in v if r == "assistant") for c, v in convs.items()}
    return {c: (len(v), sha("".join(f"{r}\n{x}\n" for r, x in v)), len(loss[c]), sha(loss[c])) for c, v in convs.items()}


def jaccard(docs, n, percent):
    """[(doc_id, size, component)]: all pairs compared."""
    sets = []
    for doc, text in docs:
        w = [x for x in re.split("[\x20\x09-\x0d]+", lower_ascii(text or "")) if x]
        sets.append((doc, frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()))
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if None not in (a, b) and x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = find(a), find(b)
                    root[max(p, q)] = min(p, q)
    return [(d, len(x), None if d is None else find(d)) for d, x in sets]


def repeats(docs, length=50):
    """[(doc_id, n_bytes, n_removed, n_spans, kept_sha256)]."""
    first: dict[bytes, int] = {}
    data = [(d, (t or "").encode()) for d, t in docs]
    for d, b in data:
        for i in range(len(b) - length + 1) if d is not None else ():
            s = b[i : i + length]
            first[s] = min(first.get(s, d), d)
    out = []
    for d, b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1) if d is not None else ():
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append((d, len(b), sum(gone), runs, sha(kept)))
    return out
