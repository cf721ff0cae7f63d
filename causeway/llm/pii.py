"""Personal data: generators propose overlapping spans, boosted trees decide which to redact.

Base spans (exact patterns with their checks) always stand. Broad generators propose further spans with high
recall: obfuscated addresses, numbers in any grouping, account numbers. They find maximal runs and propose every part of
a run that could be the thing, so proposals overlap. Each is described by its format, its context and what of its run it
leaves out, scored by gradient-boosted trees, and taken if its score passes its kind's calibrated threshold and it
overlaps no span that was taken before it. The trees are trained on formats and contexts written out below, on the
driver, and travel to the tasks as arrays.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import Trees, calibrate, fit_trees

#: The base patterns in the order of their kinds.
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
KINDS = (*BASE, "address", "number", "account")
#: The same in forms that stay linear on very long runs of word characters or digits.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile("(?<![0-9])" + BASE["ip"].pattern)
#: Maximal runs from which proposals are cut.
ADDRESS = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]+ ?(?:@|[\[(] ?[Aa][Tt] ?[\])]) ?)[A-Za-z0-9-]+(?: ?(?:\.|[\[(] ?[Dd][Oo][Tt] ?[\])]) ?[A-Za-z0-9-]+)+")
DOT = re.compile(r" ?(?:\.|[\[(] ?[Dd][Oo][Tt] ?[\])]) ?([A-Za-z0-9-]+)")
NUMBER = re.compile(r"\+?\(?[0-9]+(?:[\x20()./-]{1,2}[0-9]+)*")
ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: The digits of a number, the most characters of an account, the most characters that a domain name can have.
FEWEST_DIGITS, MOST_DIGITS, MOST_ACCOUNT, MOST_DOMAIN = 7, 19, 34, 253
#: Words of the context in four languages (fixed values): those that speak for personal data and those against it.
FOR = (
    "phone", "tel", "call", "mobile", "fax", "mail", "contact", "ssn", "social", "card", "visa", "account", "iban", "passport", "reach", "whatsapp",
    "appel", "joindre", "courriel", "portable", "compte", "num", "anruf", "handy", "konto", "erreich", "rufnummer", "llam", "correo", "cuenta", "escrib", "móvil",
)
AGAINST = (
    "order", "version", "isbn", "invoice", "page", "date", "figure", "part", "item", "section", "release", "build", "id", "doi", "year", "total",
    "commande", "facture", "ann", "bestell", "rechnung", "seite", "jahr", "artikel", "datum", "pedido", "factura", "fecha", "año", "référence", "modell", "código",
)
#: At least this share of accepted proposals of the calibration set must be personal data.
PRECISION = 0.98


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _passes(kind: str, match: str) -> bool:
    if kind == "ip":
        return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in match.split("."))
    digits = re.sub("[^0-9]", "", match)
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    return True


def _emails(text: str) -> list[tuple[int, int]]:
    """The matches of the email pattern, from each @ outward: its local part is what stands before it."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(end, at + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, place of the kind in KINDS, end), sorted."""
    out = [(a, 0, b) for a, b in _emails(text)]
    for n, (kind, pattern) in enumerate(BASE.items()):
        if kind != "email" and (kind != "phone" or "+" in text):
            out += [(m.start(), n, m.end()) for m in (_IP if kind == "ip" else pattern).finditer(text) if _passes(kind, m[0])]
    return sorted(out)


def proposals(text: str) -> list[tuple[int, int, int, int, int]]:
    """Overlapping candidate spans of all generators, sorted: (start, place of the kind, end, start and end of its run).

    A number starts and ends with groups of digits of its run, has 7 to 19 digits and a group of two or more. A run with
    more digits is proposed as a whole too, as is every account, and every address, besides each end of a label up to the length
    of a domain name, so that nothing is cut short unseen.
    """
    out = []
    kind = KINDS.index("address")
    for m in ADDRESS.finditer(text):
        name = re.compile("[A-Za-z0-9-]+").match(text, m.end(1))
        at, length, ends = name.end(), len(name[0]), []
        while at < m.end():
            label = DOT.match(text, at)
            at, length = label.end(), length + 1 + len(label[1])
            if length > MOST_DOMAIN:
                break
            ends.append(at)
        out += [(m.start(), kind, e, m.start(), m.end()) for e in dict.fromkeys([*ends, m.end()])]
    kind = KINDS.index("number")
    for m in NUMBER.finditer(text):
        groups = [(g.start() + m.start(), g.end() + m.start()) for g in re.finditer("[0-9]+", m[0])]
        for i, (a, _) in enumerate(groups):
            start = m.start() if not i else a - (text[a - 1] == "(")
            digits, wide = 0, False
            for c, d in groups[i : i + MOST_DIGITS]:
                digits, wide = digits + d - c, wide or d - c > 1
                if digits > MOST_DIGITS:
                    break
                if digits >= FEWEST_DIGITS and wide:
                    out.append((start, kind, d, m.start(), m.end()))
        if sum(b - a for a, b in groups) > MOST_DIGITS:
            out.append((m.start(), kind, m.end(), m.start(), m.end()))
    kind = KINDS.index("account")
    for m in ACCOUNT.finditer(text):
        ends = [x.start() + m.start() for x in re.finditer(" ", m[0][: MOST_ACCOUNT + 9]) if x.start() >= 12]
        out += [(m.start(), kind, e, m.start(), m.end()) for e in (*ends, m.end())]
    return sorted(out)


@lru_cache(maxsize=64)
def _context(before: str) -> tuple[bool, bool, bool, bool, bool]:
    """What the characters before a proposal say; many proposals start at one place."""
    near = re.findall(r"[^\W\d_]+", before.lower())[-4:]
    return any(w.startswith(FOR) for w in near), any(w.startswith(AGAINST) for w in near), before[-1:].isalnum(), before[-1:] in "#$€£:", before[-1:] == "("


def describe(text: str, proposal: tuple[int, int, int, int, int]) -> list[float]:
    """Format and context features of one proposal."""
    start, kind, end, low, high = proposal
    s, after = text[start:end], text[end : end + 1]
    speaks_for, against, joined, marked, opened = _context(text[max(0, start - 40) : start])
    groups = re.findall("[0-9]+", s) or [""]
    sizes = [len(g) for g in groups]
    digits, low_s = "".join(groups), s.lower()
    number = kind == KINDS.index("number")
    return [
        kind, len(s), len(digits), len(groups), sizes[0], sizes[-1], max(sizes), min(sizes), s.count("-"), s.count("."), s.count(" "), s.count("("), s.count("/"),
        s[0] == "+", not number and "at" in low_s and "dot" in low_s, "@" in s, luhn(digits) if 13 <= len(digits) <= 19 else -1, groups[0][:2] in ("19", "20"), groups[0].startswith("0"),
        0 if number else sum(map(str.isalpha, s)), speaks_for, against, joined, marked, after.isalnum(),
        start - low, high - end, len(set(re.findall("[^0-9]+", s.strip("+(")))) if number else 0, ". " in s, opened or s[0] == "(", len(sizes) > 2 and len(set(sizes[1:])) == 1, after == ")" and "(" in s,
    ]


def _formats(r: np.random.Generator) -> tuple[tuple, tuple]:
    """Makers of personal data and of other numbers, in many formats."""
    d = lambda k: "".join(map(str, r.integers(0, 10, k)))
    w = lambda: "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), r.integers(2, 9)))
    top = lambda: str(r.choice(["com", "org", "net", "de", "fr", "es", "co.uk"]))
    bank = lambda: f"{r.choice(['DE', 'FR', 'ES', 'GB', 'IT', 'NL'])}{d(2)}"
    pairs = lambda k, by=" ": by.join(d(2) for _ in range(k))
    personal = (
        lambda: f"{w()}.{w()} (at) {w()} (dot) {top()}", lambda: f"{w()}{d(2)} [at] {w()} [dot] {top()}", lambda: f"{w()} @ {w()}.{top()}", lambda: f"{w()}(at){w()}.{top()}", lambda: f"{w()}_{w()} [AT] {w()}-{w()} [DOT] {top()}",
        lambda: f"{w()} (AT) {w()} (DOT) {w()} (DOT) {top()}", lambda: f"{w()}{d(1)}[at]{w()}.{w()}.{top()}",
        lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"{d(3)} {d(3)} {d(4)}", lambda: f"0{d(3)} {d(3)} {d(4)}", lambda: f"00{d(2)} {d(3)} {d(7)}", lambda: f"1-{d(3)}-{d(3)}-{d(4)}",
        lambda: f"0{d(1)} {pairs(4)}", lambda: f"0{d(1)}.{pairs(4, '.')}", lambda: f"(0{d(1)}) {pairs(4)}", lambda: f"0{d(1)}-{pairs(4, '-')}", lambda: f"00{d(2)} {d(1)} {pairs(4)}", lambda: f"0{d(9)}", lambda: f"0{d(10)}",
        lambda: f"0{d(3)}/{d(7)}", lambda: f"0{d(2)} {d(8)}", lambda: f"(0{d(2)}) {d(7)}", lambda: f"(0{d(3)}) {d(3)} {d(4)}", lambda: f"0{d(4)} {d(6)}", lambda: f"0{d(2)}-{d(7)}", lambda: f"0{d(3)} / {d(4)}-{d(2)}",
        lambda: f"6{d(2)} {pairs(3)}", lambda: f"9{d(2)} {d(3)} {d(3)}", lambda: f"{r.choice(['6', '7', '9'])}{d(8)}", lambda: f"9{d(1)} {d(3)} {pairs(2)}", lambda: f"00{d(2)} {d(3)} {d(6)}", lambda: f"6{d(2)}-{d(3)}-{d(3)}",
        lambda: f"{d(3)}-{d(2)}-{d(4)}", lambda: f"{bank()} {d(4)} {d(4)} {d(4)} {d(4)} {d(2)}", lambda: f"{bank()}{d(20)}", lambda: f"{bank()} {d(4)} {d(4)} {d(4)} {d(4)}", lambda: f"{bank()} {w()[:4].upper():A<4} {d(4)} {d(4)} {d(4)} {d(2)}",
        lambda: f"{bank()}{d(18)}", lambda: f"{bank()} {d(4)} {d(4)} {d(4)} {d(4)} {d(4)} {d(3)}",
    )
    other = (
        lambda: f"{r.integers(1900, 2030)}-{r.integers(10, 13)}-{r.integers(10, 29)}", lambda: f"{r.integers(10, 29)}/{r.integers(10, 13)}/{r.integers(1900, 2030)}", lambda: f"{r.integers(1900, 2030)}-{r.integers(1900, 2030)}",
        lambda: f"{r.integers(10, 29)}.{r.integers(10, 13)}.{r.integers(1900, 2030)}", lambda: f"{r.integers(10, 29)}.{r.integers(10, 13)}.{r.integers(1900, 2030)} {r.integers(10, 24)}.{r.integers(10, 60)}",
        lambda: d(int(r.integers(7, 14))), lambda: f"{d(1)}.{d(2)}.{d(4)}", lambda: f"97{r.integers(8, 10)}-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"10.{d(4)}/{d(6)}", lambda: f"{d(4)}.{d(5)}", lambda: f"{r.integers(1, 99)} {d(3)} {d(3)}",
        lambda: f"{d(2)}/{d(2)}/{d(4)}", lambda: f"NO{d(2)} REF{d(1)} {d(4)}", lambda: d(16), lambda: f"{d(3)}.{d(3)}.{d(3)}.{d(3)}", lambda: " ".join(d(1) for _ in range(8)), lambda: pairs(r.integers(4, 12)),
        lambda: "-".join(d(4) for _ in range(r.integers(3, 9))), lambda: d(int(r.integers(20, 40))), lambda: f"{d(3)}.{d(3)}.{d(3)}", lambda: f"{w()} @ {w()}. {w().title()}", lambda: f"20{d(2)}{d(6)}", lambda: f"{d(4)}-{d(4)}-{d(2)}",
        lambda: f"{r.integers(1900, 2030)}-{d(4)}", lambda: f"{r.integers(1, 9)} {d(3)} {d(3)} {d(3)}", lambda: f"{r.integers(1, 99)},{d(3)},{d(3)}.{d(2)}", lambda: f"{r.integers(1, 999)}.{d(3)}.{d(3)}", lambda: f"{d(4)}-{d(4)}-{d(4)}",
        lambda: f"{d(2)}:{d(2)}:{d(2)} {d(7)}", lambda: f"0.{d(9)}", lambda: f"{r.integers(2, 30)}.{r.integers(0, 30)}.{r.integers(0, 30)}.{r.integers(0, 9)} {d(4)}", lambda: f"{d(3)}/{d(4)}/{d(2)}", lambda: f"{w()} @ {w()}. {d(2)}",
    )
    return personal, other


def training_set(n: int = 6000, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at least n proposals in written-out examples: one or two formats of personal data or of
    other numbers, each in a context. A proposal is personal data if it is just what was written."""
    r = np.random.default_rng(seed)
    w = lambda: "".join(r.choice(list("abcdefghijklmnopqrstuvwxyz"), r.integers(2, 9)))
    personal, other = _formats(r)
    x, y = [], []
    while len(x) < n:
        text, truth = w(), set()
        for _ in range(int(r.integers(1, 3))):
            yes = bool(r.random() < 0.5)
            makers = personal if yes else other
            said_ = str(makers[r.integers(len(makers))]())
            hint = r.choice(FOR if yes else AGAINST) + r.choice(["", "", "e", "en"]) if r.random() < 0.6 else w()
            text += f" {hint}{r.choice([' ', ': ', ' is ', ' (', ' ' + w() + ' '])}" if r.random() < 0.85 else " "
            if yes:
                truth.add((len(text), len(text) + len(said_)))
            text += said_ + r.choice(["", "", ".", ",", ")"])
        text += f" {w()}"
        for p in proposals(text):
            x.append(describe(text, p))
            y.append((p[0], p[2]) in truth)
    return np.array(x, dtype=np.float64), np.array(y, dtype=np.float64)


@lru_cache(maxsize=1)
def fitted() -> tuple[Trees, dict[int, float]]:
    """The trees and each kind's lowest threshold that keeps the precision asked for on texts that were left out of
    training, 1.01 (none) where no one does."""
    x, y = training_set(60_000)
    third = np.arange(len(y)) // 50 % 3 == 0  # proposals of one text stay together, but for a few
    model = calibrate(fit_trees(x[~third], y[~third], trees=100, depth=5), x[third], y[third])
    p, limits = model.predict(x[third]), {}
    for kind in range(len(BASE), len(KINDS)):
        here = x[third][:, 0] == kind
        good = [t for t in np.linspace(0.05, 0.99, 95) if (p[here] >= t).any() and y[third][here & (p >= t)].mean() >= PRECISION]
        limits[kind] = float(min(good, default=1.01))
    return model, limits


def find_pii(texts: list[str | None], model: Trees, limits: dict[int, float]) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """(base spans, further spans) of each text."""
    bases, offers, features = [], [], []
    for t in texts:
        t = t or ""
        quick = re.search("[0-9@]|[\\[(] ?[Aa][Tt]", t) is not None
        base = base_spans(t) if quick else []
        offer = proposals(t) if quick else []
        starts, reach = [b[0] for b in base], list(accumulate((b[2] for b in base), max))
        offer = [o for o in offer if not (at := bisect_left(starts, o[2])) or reach[at - 1] <= o[0]]
        bases.append(base)
        offers.append([o[:3] for o in offer])
        features += [describe(t, o) for o in offer]
    p = iter(model.predict(np.array(features, dtype=np.float64)) if features else ())
    out = []
    for base, offer in zip(bases, offers):
        taken: list[tuple[int, int, int]] = []  # sorted and apart, so only the neighbours can overlap
        for score, o in sorted(((next(p), o) for o in offer), key=lambda x: (-x[0], x[1])):
            at = bisect_left(taken, o)
            if score >= limits[o[1]] and (at == 0 or taken[at - 1][2] <= o[0]) and (at == len(taken) or taken[at][0] >= o[2]):
                taken.insert(at, o)
        out.append((base, taken))
    return out


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan_pii(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans (of all kinds).

    Null and empty texts have no spans; very long texts are searched whole; repeated rows, and rows with a null id, are
    answered one by one; of proposals that score alike the first by start, then kind, then end is taken; an empty table
    gives an empty result; other columns are ignored, so clashing names cannot arise.
    """
    names = [f"n_{k}" for k in BASE]
    model, limits = fitted()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for at in range(0, b.num_rows, 512):
                rows += find_pii(b.column("text")[at : at + 512].to_pylist(), model, limits)
            counts = [pa.array([sum(s[1] == n for s in base) for base, _ in rows], pa.int64()) for n in range(len(BASE))]
            shas = [hashlib.sha256(said(base).encode()).hexdigest() for base, _ in rows]
            spans = [said(base + more) for base, more in rows]
            every = pa.array([len(base) + len(more) for base, more in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, pa.array(shas, pa.string()), pa.array(spans, pa.string()), every], ["doc_id", *names, "base_sha256", "spans", "n_spans"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(scan, f"doc_id long, {', '.join(f'{n} long' for n in names)}, base_sha256 string, spans string, n_spans long")


def redact(text: Column, spans: Column) -> Column:
    """The text with each span of ``scan_pii`` replaced by its kind in brackets; overlapping spans are merged.

    A null text gives an empty one, null or empty spans the text as it is; spans may stand in any order and repeat.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def replace(texts, said_spans):
        out = []
        for t, s in zip(texts, said_spans):
            t, at, pieces = t or "", 0, []
            for kind, a, b in sorted((x.split(":") for x in (s or "").split(",") if x), key=lambda x: int(x[1])):
                if int(a) >= at:
                    pieces += [t[at : int(a)], f"[{kind}]"]
                at = max(at, int(b))
            out.append("".join(pieces) + t[at:])
        return texts.__class__(out)

    return replace(F.coalesce(text, F.lit("")), spans)
