"""Personal data, with DataFrame functions only: patterns propose spans,
checksums confirm them, context words nearby adjust their score.

A pattern's matches and the pieces between them give every position by prefix
sums over lengths in code points, taken in blocks, so that a text of n matches
costs about n * BLOCK steps.  Patterns are possessive and anchored at the start
of a run: same matches as their plain forms, in time linear in the text.

Defined results: null and empty texts have no spans; a null doc_id and repeated
rows keep their rows; an empty table gives no rows; long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 64
CONTEXT_CHARS = 40
MIN_SCORE = 0.5

#: The base kinds, in the order in which ties of a position are listed, then the added ones.
KINDS = ["email", "ip", "card", "phone", "iban", "local_phone"]
N_BASE = 4

_LOCAL = "A-Za-z0-9._%+-"
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9A-Za-z+()-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
}
#: A text without this has no match (None: always looked at).
_NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None, "local_phone": None}
#: Score of a confirmed span before its context is looked at.
_PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.95, "local_phone": 0.4}
_CONTEXT = {
    "email": r"(?i)e-?mail|contact|write|correo|courriel",
    "ip": r"(?i)\bip\b|address|host|server|login",
    "card": r"(?i)card|visa|credit|tarjeta|carte|karte|payment",
    "phone": r"(?i)phone|call|tel\b|tel[.:]|mobile|fax|telefon|tel[eé]fono|t[eé]l[eé]phone",
    "iban": r"(?i)iban|account|bank|konto|cuenta|compte",
    "local_phone": r"(?i)phone|call|tel\b|tel[.:]|mobile|fax|telefon|tel[eé]fono|t[eé]l[eé]phone",
}
_AGAINST = r"(?i)version|order|invoice|serial|isbn|example of"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _chars(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(s), F.lit(1))), lambda i: F.substr(s, i, F.lit(1)))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""

    def value(c: Column, i: Column) -> Column:
        d = F.ascii(c) - 48
        twice = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice)).cast("long")

    return _total(F.transform(_chars(F.reverse(digits)), value)) % 10 == 0


def mod97(compact: Column) -> Column:
    """Whether an account number, its spaces removed, leaves 1 modulo 97."""
    moved = F.concat(F.substr(compact, F.lit(5)), F.substr(compact, F.lit(1), F.lit(4)))

    def step(a: Column, c: Column) -> Column:
        return F.when(c < "A", a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97

    return F.aggregate(_chars(moved), F.lit(0), step) == 1


def _confirmed(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return _let(_digits(match), lambda d: F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    if kind == "iban":
        return _let(F.replace(match, F.lit(" "), F.lit("")), lambda c: F.when(F.length(c).between(15, 34), mod97(c)).otherwise(False))
    return F.lit(True)


def _score(kind: str, around: Column) -> Column:
    up = F.when(around.rlike(_CONTEXT[kind]), 0.2).otherwise(0.0)
    down = F.when(around.rlike(_AGAINST), 0.2).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(_PRIOR[kind]) + up - down))


_SPAN = "array<struct<start:bigint,k:int,end:bigint,value:string,score:double>>"


def _spans(text: Column, kind: str) -> Column:
    """The confirmed spans of one kind."""
    pattern, k = F.lit(PATTERNS[kind]), KINDS.index(kind)

    def placed(found: Column) -> Column:
        matches, gaps = found["matches"], found["gaps"]
        steps = F.zip_with(matches, gaps, lambda m, g: F.when(m.isNotNull(), (F.length(g) + F.length(m)).cast("long")).otherwise(0))
        return _let(steps, lambda s: _let(_bases(s), lambda b: F.transform(matches, lambda m, i: _span(m, i, gaps, s, b))))

    def _bases(steps: Column) -> Column:
        """Where each block of steps begins."""
        blocks = F.transform(F.sequence(F.lit(0), (F.size(steps) / BLOCK).cast("int")), lambda b: _total(F.slice(steps, b * BLOCK + 1, BLOCK)))
        return F.aggregate(blocks, F.array(F.lit(0).cast("long")), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

    def _span(m: Column, i: Column, gaps: Column, steps: Column, bases: Column) -> Column:
        block = F.floor(i / BLOCK).cast("int")
        before = F.get(bases, block) + _total(F.slice(steps, block * BLOCK + 1, i - block * BLOCK))
        left, right = F.get(gaps, i), F.get(gaps, i + 1)
        around = F.concat_ws(" ", F.substr(left, F.greatest(F.length(left) - CONTEXT_CHARS + 1, F.lit(1))), F.substr(right, F.lit(1), F.lit(CONTEXT_CHARS)))
        start = before + F.length(left)
        return F.when(
            _confirmed(kind, m),
            F.struct(start.alias("start"), F.lit(k).alias("k"), (start + F.length(m)).alias("end"), m.alias("value"), _score(kind, around).alias("score")),
        )

    found = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("matches"), F.split(text, PATTERNS[kind], -1).alias("gaps"))
    spans = _let(found, lambda f: F.when(F.size(f["matches"]) > 0, F.filter(placed(f), lambda s: s.isNotNull())))
    if _NEEDS[kind]:
        spans = F.when(F.contains(text, F.lit(_NEEDS[kind])), spans)
    else:
        spans = F.when(text.rlike("[0-9][0-9 ()-]"), spans)
    return F.coalesce(spans, F.array()).cast(_SPAN)


def pii_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id and the spans of every row (code points, end exclusive), by start, then kind.

    Base kinds stay whatever their score; an added span needs ``min_score`` and
    must not overlap a base span.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    text = F.col("text")
    base = F.concat(*[_spans(text, k) for k in KINDS[:N_BASE]])
    added = F.filter(F.concat(*[_spans(text, k) for k in KINDS[N_BASE:]]), lambda s: s["score"] >= min_score)

    def apart(b: Column) -> Column:
        return F.filter(added, lambda s: ~F.exists(b, lambda x: (x["start"] < s["end"]) & (s["start"] < x["end"])))

    def named(s: Column) -> Column:
        return F.struct(F.element_at(F.array(*map(F.lit, KINDS)), s["k"] + 1).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), s["score"].alias("score"))

    spans = _let(base, lambda b: F.transform(F.array_sort(F.concat(b, apart(b))), named))
    return rows.select("doc_id", spans.alias("pii"))
