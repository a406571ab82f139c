"""Plain-Python versions of the operators' definitions, for small inputs."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections import defaultdict

SPACES = r"[\x20\x09-\x0D]"
LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text: str | None) -> list[str]:
    return [w for w in re.split(SPACES + "+", (text or "").translate(LOW)) if w]


def shingle_set(text: str | None, width: int = 5) -> frozenset:
    w = words(text)
    return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def linked(sets: dict, percent: int) -> dict:
    """Smallest key reachable over pairs with enough overlap."""
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k in sets}


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def line_dedup(docs: list[tuple[int, str | None]], min_chars: int = 20, min_docs: int = 3) -> dict:
    def key(line: str) -> str:
        return line.strip(" \t\n\x0b\x0c\r").translate(LOW)

    holders = defaultdict(set)
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(doc)
    out = {}
    for doc, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or len(h := holders.get(key(x), ())) < min_docs or max(h) == doc]
        out[doc, text] = (len(lines), len(lines) - len(kept), sha("\n".join(kept).encode()))
    return out


def repeats(texts: list[str | None], length: int) -> list[tuple[int, int, int, str]]:
    data = [(t or "").encode() for t in texts]
    seen = defaultdict(int)
    for d in data:
        for p in range(len(d) - length + 1):
            seen[d[p : p + length]] += 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if seen[d[p : p + length]] > 1:
                gone[p : p + length] = b"\x01" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, sha(bytes(c for c, g in zip(d, gone, strict=True) if not g))))
    return out


def pii_base(text: str | None) -> str:
    def luhn(digits: str) -> bool:
        values = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
        return sum(v - 9 if v > 9 else v for v in values) % 10 == 0

    text, found = text or "", []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fits = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m.group().split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }
            if fits[kind]:
                found.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(found)


def leaks(doc: str | None, item: str | None, window: int = 13, differ: int = 2) -> tuple[int, int, int] | None:
    def tokens(text):
        return [w for w in re.split(r"[^\w]+|_+", (text or "").lower()) if w]

    d, b = tokens(doc), tokens(item)
    hits = []
    for i in range(len(d) - window + 1):
        for j in range(len(b) - window + 1):
            same = sum(x == y for x, y in zip(d[i : i + window], b[j : j + window], strict=True))
            if same >= window - differ:
                hits.append((i, i + window - 1, same))
    return (min(h[0] for h in hits), max(h[1] for h in hits), max(h[2] for h in hits)) if hits else None


def interactions(docs: list[tuple], labels: list[tuple]) -> set[tuple]:
    """Rows of the filter audit for ``docs(doc_id, text, source)`` and ``labels(doc_id, quality, toxic)``, each order replayed."""
    smallest = {}
    for d, t, _ in docs:
        if d is not None:
            smallest[t or ""] = min(d, smallest.get(t or "", d))
    told = []
    for d, t, source in docs:
        t = t or ""
        w = [x for x in re.split(SPACES + "+", t) if x]
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": d is not None and smallest[t] < d,
        }
        mine = [x for x in labels if d is not None and x[0] == d]
        told.append((source or "", {f for f in fails if fails[f]}, any(x[1] == 1 for x in mine), any(x[2] == 1 for x in mine)))
    out = []
    for part in {x[0] for x in told}:
        removed_by = defaultdict(int)
        rows = []
        for order in itertools.permutations("ABCDE"):
            left = [x for x in told if x[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                now = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                only = sum(x[1] == {f} for x in told if x[0] == part)
                rows.append((part, "".join(order), step, len(left), len(now), sum(f in x[1] for x in gone), only, sum(x[2] for x in now), sum(x[3] for x in now)))
                removed_by[f] += len(now)
                gone += now
        out += [(*row, removed_by[row[1][row[2] - 1]]) for row in rows]
    return set(out)


def product_codes(rows: list[tuple]) -> dict:
    """``vec_id -> (code, error, label_error)`` and the codebooks' hash of ``rows(vec_id, vector, label)`` of one length."""
    kept = [(v, [math.floor(1024 * x) for x in vec], label) for v, vec, label in rows if vec is not None and all(x is not None and math.isfinite(x) for x in vec)]
    kept.sort(key=lambda r: r[0])
    width = len(kept[0][1]) // 4
    part = lambda vec, p: vec[p * width : (p + 1) * width]
    books = [[part(vec, p) for _, vec, _ in kept[:256]] for p in range(4)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, entry, strict=True)), k) for k, entry in enumerate(book))

    for turn in range(5):
        found = [[nearest(part(vec, p), books[p]) for p in range(4)] for _, vec, _ in kept]
        if turn < 4:
            for p in range(4):
                for k in range(len(books[p])):
                    mine = [part(vec, p) for (_, vec, _), f in zip(kept, found, strict=True) if f[p][1] == k]
                    if mine:
                        books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    by_label = defaultdict(int)
    for (_, _, label), f in zip(kept, found, strict=True):
        by_label[label] += sum(x[0] for x in f)
    listed = sha(",".join(str(x) for book in books for entry in book for x in entry).encode())
    return {v: ("".join(f"{k:02x}" for _, k in f), sum(x[0] for x in f), by_label[label], listed) for (v, _, label), f in zip(kept, found, strict=True)}
