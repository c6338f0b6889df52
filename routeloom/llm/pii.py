"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Kinds email, ip, card and phone follow fixed rules; iban (mod-97) and account
(a digit run beside a word that names an account) are added where they overlap none
of those.  A score only decides whether an added span is kept; base spans stay.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from routeloom.llm.common import append

KINDS = ("email", "ip", "card", "phone", "iban", "account")
BASE = KINDS[:4]
LEAST_SCORE = 0.5
NEAR = 40

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a digit run begins: later starts in the run fail or end alike.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_ACCOUNT = re.compile(r"(?<![A-Za-z0-9.+-])[0-9]{8,12}(?![A-Za-z0-9-])")
_NOT_DIGIT = re.compile(r"[^0-9]")

# Words beside a span that make it likelier.
CONTEXT = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    "phone": ("tel", "phone", "call", "mobile", "telefon"),
    "iban": ("iban", "bank", "konto", "compte", "cuenta"),
    "account": ("account", "acct", "konto", "compte", "cuenta"),
}
_CONTEXT = {k: re.compile(r"\b(?:" + "|".join(v) + r")", re.I) for k, v in CONTEXT.items()}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "account": 0.3}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Every match holds one @; its local part is the run before it, as far as the last match."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            done = m.end()
            out.append((start, done))
        at = text.find("@", max(at + 1, done))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def spans(text: str | None) -> list[tuple[int, int, int, float]]:
    """(start, end, kind number, score) by start, then kind; code points, end exclusive."""
    if not text:
        return []
    found = [(a, b, 0) for a, b in emails(text)]
    found += [(m.start(), m.end(), 1) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
    for m in _PHONE.finditer(text):
        if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            found.append((m.start(), m.end(), 3))
    out = [(a, b, k, _score(text, a, b, KINDS[k])) for a, b, k in found]
    taken = sorted((a, b) for a, b, _ in found)
    for kind, pattern in ((4, _IBAN), (5, _ACCOUNT)):
        for m in pattern.finditer(text):
            a, b = m.span()
            if (kind == 4 and not mod97(m[0])) or any(x < b and a < y for x, y in taken):
                continue
            score = _score(text, a, b, KINDS[kind])
            if score >= LEAST_SCORE:
                out.append((a, b, kind, score))
                taken.append((a, b))
    return sorted(out, key=lambda s: (s[0], s[2]))


def _score(text: str, start: int, end: int, kind: str) -> float:
    near = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]
    prior = PRIOR[kind]
    return prior + (1 - prior) / 2 if _CONTEXT[kind].search(near) else prior


def _joined(found: list[tuple]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k, _ in found)


def find_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``pii``: spans (kind, start, end, score), by start then kind.

    Null and empty texts have none; rows stay as they are, repeated ones too; a column
    already called ``pii`` is replaced.
    """

    def run(texts):
        return [[[{"kind": KINDS[k], "start": a, "end": b, "score": s} for a, b, k, s in spans(t)] for t in texts]]

    return append(df, [text], run, "pii array<struct<kind: string, start: int, end: int, score: double>>")


def mask_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with every span of ``text`` replaced by its kind in brackets; null texts stay null.

    Overlapping spans are replaced as one, under the first one's kind.
    """

    def mask(value: str | None) -> str | None:
        if value is None:
            return None
        out, done, limit = [], 0, -1
        for a, b, k, _ in spans(value):
            if a >= limit:
                out += [value[done:a], f"[{KINDS[k].upper()}]"]
            limit = max(limit, b)
            done = limit
        return "".join(out) + value[done:]

    masked = append(df, [text], lambda texts: [[mask(t) for t in texts]], "_masked string")
    return masked.select(
        *[F.col("_masked").alias(c) if c == text else F.col(f"`{c}`") for c in df.columns]
    )


def digest_columns(df: DataFrame) -> DataFrame:
    """Counts per base kind and the joined span strings of ``find_pii`` rows."""
    label = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE))
    of = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in BASE]
    joined = lambda a: F.array_join(F.transform(a, label), ",")
    return df.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("pii")).alias("spans"))
