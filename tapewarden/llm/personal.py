"""Personal data in text by weak supervision.

1. *Base patterns* (e-mail, IP address, card, phone) are exact and always stay.
2. *Candidates* are base spans and looser ones: spelled-out e-mails, phones without a
   plus sign, numbers beside telling words, names after titles or greetings, long runs of
   letters and digits that may be keys or tokens.
3. *Labelers* vote on each candidate (for, against or not at all): shape, base
   pattern, gazetteer, words before, words after. Their votes are noisy.
4. *Expectation-maximisation* over the counts of vote patterns estimates, for each
   kind, how common true spans are and how reliable every labeler is, without a
   single hand label. Patterns are a fixed set of combinations, so the driver sees a
   small table whatever the input.
5. A *span classifier* (logistic regression on coarse features of the span and its
   surroundings, not on the votes) is trained on the posteriors over all candidates,
   counted by feature combination, and decides on the added spans. It also judges spans
   on which no labeler voted.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewarden.llm.scratch import written
from tapewarden.session import ship_package

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "name", "secret")
FOR, ABSTAIN, AGAINST = 1, 0, -1
LABELERS = ("pattern", "shape", "gazetteer", "before", "after")
#: Added spans need this probability.
ACCEPT = 0.5

# Words that stand next to personal data.
TELLING = {
    "email": ("mail", "email", "e-mail", "contact", "write", "correo", "courriel", "adresse"),
    "ip": ("ip", "host", "server", "address", "addr"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "tarjeta", "carte", "number"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "cell", "telefon", "telefono", "number"),
    "secret": ("token", "key", "apikey", "api", "secret", "password", "passwd", "pwd", "bearer", "authorization", "credential", "clave", "schluessel"),
    "name": ("mr", "mrs", "ms", "dr", "herr", "frau", "senor", "senora", "madame", "monsieur", "dear", "name", "sincerely"),
}
MISLEADING = ("version", "v", "isbn", "order", "page", "chapter", "section", "id", "build", "release", "usd", "eur", "total")
FIRST_NAMES = (
    "james", "mary", "john", "patricia", "robert", "jennifer", "michael", "linda", "william", "elizabeth", "david", "susan",
    "anna", "maria", "peter", "paul", "thomas", "laura", "sofia", "carlos", "jose", "luis", "ana", "carmen", "hans", "klaus",
    "petra", "monika", "jean", "pierre", "marie", "claire", "alice", "bob", "sarah", "emma", "daniel", "martin",
)
MAIL_HOSTS = ("gmail", "yahoo", "hotmail", "outlook", "example", "mail", "proton", "icloud", "gmx", "web")

_AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# possessive: a run of digits is never tried again from its middle, where it would end in the same way
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?: ?[(\[] ?at ?[)\]] ?| at )[A-Za-z0-9-]{1,63}(?:(?:\.| ?[(\[] ?dot ?[)\]] ?| dot )[A-Za-z0-9-]{1,63}){1,6}")
_LOOSE_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{2,5}\)?(?:[ ./-][0-9]{2,5}){1,4}(?![0-9])")
_LEADS = "|".join(w.capitalize() for w in (*FIRST_NAMES, *TELLING["name"][:9]))
#: A known first name and another one, or a title and one or two names.
_NAME = re.compile(rf"(?<!\w)(?:{_LEADS})\b\.?(?: [A-Z][a-zà-ÿ]{{1,20}}){{1,2}}(?!\w)")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W_]+")

#: Letters and digits in one run, at least one digit and one letter.
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{16,512}+(?![A-Za-z0-9_+/-])={0,2}")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
# Beginnings of issued keys.
_ISSUED = ("AKIA", "ASIA", "ghp_", "gho_", "glpat-", "sk-", "pk_", "xoxb-", "xoxp-", "eyJ", "AIza")

Span = tuple[str, int, int]


def entropy(run: str) -> float:
    """Bits a character: random keys have over 3, words and counters fewer."""
    share = [run.count(c) / len(run) for c in set(run)]
    return -sum(p * math.log2(p) for p in share)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        value = int(d) * (1 + k % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, leftmost and non-overlapping for each kind; by kind, then start."""
    found: list[Span] = []
    end = 0
    if "@" in text:
        for match in _AT_DOMAIN.finditer(text):
            # the part before the sign is the whole run before it, as far as no earlier match has taken it
            begin = match.start()
            while begin > end and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin < match.start():
                end = match.end()
                found.append(("email", begin, end))
    if not _DIGIT.search(text):
        return found
    for match in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match.group().split(".")):
            found.append(("ip", *match.span()))
    for match in _CARD.finditer(text):
        digits = match.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *match.span()))
    if "+" in text:
        for match in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in match.group()) <= 15:
                found.append(("phone", *match.span()))
    return found


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Looser spans of all kinds that touch no base span and no earlier candidate."""
    taken = sorted((start, end) for _, start, end in base)
    out: list[Span] = []
    passes = []
    lowered = text.lower() if (" at " in text or "at)" in text or "at]" in text or " AT " in text) else ""
    if "dot" in lowered or (lowered and "." in lowered):
        passes.append(("email", _SPELLED))
    if _DIGIT.search(text):
        passes.append(("secret", _SECRET))
        passes += [("ip", _IP), ("card", _CARD), ("phone", _PHONE), ("phone", _LOOSE_PHONE)]
    passes.append(("name", _NAME))
    for kind, pattern in passes:
        fresh = []
        at = 0
        for match in pattern.finditer(text):
            start, end = match.span()
            digits = sum(c in "0123456789" for c in match.group())
            if kind == "card" and not 12 <= digits <= 19 or kind == "phone" and not 7 <= digits <= 15:
                continue
            if kind == "email" and "dot" not in match.group().lower():
                continue
            while at < len(taken) and taken[at][1] <= start:
                at += 1
            if at < len(taken) and taken[at][0] < end:
                continue
            fresh.append((kind, start, end))
        out += fresh
        taken = sorted(taken + [(s, e) for _, s, e in fresh])
    return out


def _near(text: str, start: int, end: int) -> tuple[list[str], list[str]]:
    before = _WORD.findall(text[max(0, start - 40) : start].lower())[-4:]
    return before, _WORD.findall(text[end : end + 30].lower())[:2]


def votes(kind: str, text: str, start: int, end: int, is_base: bool) -> tuple[int, ...]:
    """One vote for each of :data:`LABELERS`."""
    span = text[start:end]
    before, after = _near(text, start, end)
    digits = [c for c in span if c in "0123456789"]
    pattern = FOR if is_base else ABSTAIN
    shape = ABSTAIN
    if kind == "email":
        shape = FOR if "(at)" in span.lower() or "[at]" in span.lower() or "@" in span else AGAINST
    elif kind == "ip":
        shape = FOR if all(int(p[-4:]) <= 255 for p in span.split(".") if p.isdigit()) else AGAINST
    elif kind == "card":
        shape = FOR if luhn("".join(digits)) else AGAINST
    elif kind == "name":
        shape = FOR if len(set(span.split())) == len(span.split()) else AGAINST
    elif kind == "secret":
        bits = entropy(span)
        shape = FOR if bits >= 3.2 and 0.1 <= len(digits) / len(span) <= 0.9 else AGAINST if bits < 2.8 else ABSTAIN
        pattern = FOR if span.startswith(_ISSUED) else ABSTAIN
    elif kind == "phone":
        shape = FOR if span[0] in "+(" or len(digits) >= 9 else AGAINST if len(digits) == 8 and span.count("-") == 2 else ABSTAIN
    gazetteer = ABSTAIN
    words = _WORD.findall(span.lower())
    if kind == "name":
        gazetteer = FOR if any(w in FIRST_NAMES for w in words) else ABSTAIN
    elif kind == "email":
        gazetteer = FOR if any(w in MAIL_HOSTS or w in FIRST_NAMES for w in words) else ABSTAIN
    elif kind == "secret":
        # digests and keys have fixed lengths in one alphabet; words joined by signs do not
        fixed = _HEX.fullmatch(span) is not None and len(span) in (32, 40, 48, 56, 64, 96, 128)
        mixed_case = any(c.isupper() for c in span) and any(c.islower() for c in span) and not set(span) & set("-/")
        gazetteer = FOR if fixed or mixed_case else AGAINST if any(len(w) > 2 and w.isalpha() for w in re.split("[-_/=+]", span)) else ABSTAIN
    told = FOR if any(w in TELLING[kind] for w in before) else AGAINST if any(w in MISLEADING for w in before[-2:]) else ABSTAIN
    if kind == "secret":
        opened, closed = text[max(0, start - 1) : start], text[end : end + 1]
        quoted = opened == closed != "" and opened in "\"'`"
        later = FOR if quoted or text[max(0, start - 3) : start].rstrip().endswith(("=", ":")) else AGAINST if closed in (".", "/") else ABSTAIN
        return pattern, shape, gazetteer, told, later
    later = FOR if any(w in TELLING[kind] for w in after) else AGAINST if kind == "name" and text[end : end + 1].isalnum() else ABSTAIN
    return pattern, shape, gazetteer, told, later


def features(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """Coarse properties of a span, each a small number, so that there are few combinations."""
    span = text[start:end]
    before, after = _near(text, start, end)
    digits = sum(c in "0123456789" for c in span)
    signs = len({c for c in span if not c.isalnum()})
    context = 2 if any(w in TELLING[kind] for w in before) else 1 if any(w in MISLEADING for w in before) else 0
    known = int(any(w in FIRST_NAMES or w in MAIL_HOSTS for w in _WORD.findall(span.lower())))
    edge = int(start == 0 or text[start - 1] in "\n:,;(") + 2 * int(end == len(text) or text[end] in "\n,.;)")
    valid = int(luhn("".join(c for c in span if c in "0123456789"))) if kind == "card" else int("+" in span or "@" in span)
    if kind == "secret":
        signs = len(set(span) & set("_+/=-"))
        known = int(_HEX.fullmatch(span) is not None)
        edge = int(text[max(0, start - 1) : start] in ("\"", "'", "`")) + 2 * int(text[end : end + 1] in ("\"", "'", "`"))
        valid = min(int(entropy(span)), 5)
    return min(len(span) // 6, 5), min(digits // 3, 6), min(signs, 3), context, known, edge, int(any(w in TELLING[kind] for w in after)), valid


def _listed(spans: list[Span]) -> str:
    order = {kind: k for k, kind in enumerate(KINDS)}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (order[x[0]], x[1], x[2])))


_FOUND = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, "
    "found array<struct<kind:string, start:int, end:int, is_base:boolean, votes:string, features:string>>"
)


def _scanned(documents: DataFrame) -> DataFrame:
    found_type = pa.list_(
        pa.struct(
            [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("is_base", pa.bool_()), ("votes", pa.string()), ("features", pa.string())]
        )
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for value in batch["text"]:
                text = value.as_py() or ""
                base = base_spans(text)
                every = [(*s, True) for s in base] + [(*s, False) for s in candidates(text, base)]
                rows = [
                    {
                        "kind": kind, "start": start, "end": end, "is_base": is_base,
                        "votes": " ".join(map(str, votes(kind, text, start, end, is_base))),
                        "features": " ".join(map(str, features(kind, text, start, end))),
                    }
                    for kind, start, end, is_base in every
                ]
                counts = [sum(k == kind for k, _, _ in base) for kind in BASE_KINDS]
                for column, item in zip(columns, [*counts, _listed(base), rows], strict=True):
                    column.append(item)
            kinds = [pa.int64()] * 4 + [pa.string(), found_type]
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *arrays], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "found"]
            )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, _FOUND)


def aggregate_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, float, np.ndarray]:
    """EM over vote patterns (rows of -1, 0, 1): posterior of each pattern, share of true spans, reliabilities.

    ``reliabilities[class, labeler, vote + 1]`` is the chance of a vote given false (0) or true (1) spans.
    It starts from a majority vote; smoothing by one vote keeps chances away from 0.
    """
    posterior = 1 / (1 + np.exp(-patterns.sum(axis=1).astype(float)))
    chance = np.zeros((2, patterns.shape[1], 3))
    share = 0.5
    for _ in range(rounds):
        share = float((posterior * counts).sum() + 1) / (counts.sum() + 2)
        for c, weight in enumerate(((1 - posterior) * counts, posterior * counts)):
            for vote in (-1, 0, 1):
                chance[c, :, vote + 1] = ((patterns == vote) * weight[:, None]).sum(axis=0) + 1
        chance /= chance.sum(axis=2, keepdims=True)
        spots = np.arange(patterns.shape[1])
        log = [np.log(chance[c, spots, patterns + 1]).sum(axis=1) for c in (0, 1)]
        odds = log[1] - log[0] + np.log(share / (1 - share))
        fresh = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        done = np.abs(fresh - posterior).max() < 1e-9
        posterior = fresh
        if done:
            break
    return posterior, share, chance


def one_hot(combinations: list[str], levels: int = 8) -> np.ndarray:
    values = np.array([[int(x) for x in c.split()] for c in combinations])
    out = np.zeros((len(values), values.shape[1] * levels + 1))
    for k in range(values.shape[1]):
        out[np.arange(len(values)), k * levels + values[:, k]] = 1
    out[:, -1] = 1
    return out


def fit_classifier(x: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Logistic regression with soft targets by Newton steps, ridge 1."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weight * (target - p)) - beta
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(x.shape[1])
        step = np.linalg.solve(hessian, gradient)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def _decisions(counted: pd.DataFrame) -> pd.DataFrame:
    """``kind, features, accepted``; ``counted`` has a row for each (kind, votes, features), a bounded table."""
    out = []
    for kind, rows in counted.groupby("kind"):
        by_votes = rows.groupby("votes")["n"].sum()
        patterns = np.array([[int(v) for v in p.split()] for p in by_votes.index])
        posterior, _, _ = aggregate_votes(patterns, by_votes.to_numpy(dtype=float))
        truth = rows["votes"].map(dict(zip(by_votes.index, posterior, strict=True))).to_numpy()
        combined = rows.assign(mass=rows["n"] * truth).groupby("features", as_index=False)[["n", "mass"]].sum()
        x = one_hot(combined["features"].tolist())
        n = combined["n"].to_numpy(dtype=float)
        beta = fit_classifier(x, combined["mass"].to_numpy() / n, n)
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        out.append(pd.DataFrame({"kind": kind, "features": combined["features"], "accepted": p >= ACCEPT}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"kind": [], "features": [], "accepted": []})


def personal_data(documents: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row of ``documents(doc_id, text, …)``.

    Counts and ``base_sha256`` are of the base spans; ``spans`` lists those and the added ones as
    ``kind:start:end`` by kind, then start (code points, end exclusive). Added spans touch no base span; a key or token
    is the run itself, without quotes.

    A null text is empty: no spans, an empty list. Repeated rows are scanned each; a row without
    doc_id too. Other columns are ignored; an empty table gives an empty result.
    """
    spark = documents.sparkSession
    ship_package(spark)
    scanned = written(_scanned(documents), "found")
    spans = scanned.select(F.explode("found").alias("f")).select("f.kind", "f.votes", "f.features")
    # at most as many rows as there are combinations of votes and coarse features
    counted = spans.groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n")).toPandas()
    rules = _decisions(counted)
    accepted = frozenset(rules[rules["accepted"].astype(bool)][["kind", "features"]].itertuples(index=False, name=None))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, lists = [], []
            for base, found in zip(batch["base"].to_pylist(), batch["found"].to_pylist(), strict=True):
                hashes.append(hashlib.sha256(base.encode()).hexdigest())
                lists.append(_listed([(f["kind"], f["start"], f["end"]) for f in found if f["is_base"] or (f["kind"], f["features"]) in accepted]))
            kept = [batch[c] for c in ("doc_id", "n_email", "n_ip", "n_card", "n_phone")]
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(hashes, pa.string()), pa.array(lists, pa.string())], names)

    kind = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return scanned.mapInArrow(decide, kind)
