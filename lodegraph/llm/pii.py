"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust a score. DataFrame functions only.

Spark has no function that gives the places of all matches, but splitting by a pattern gives what lies between them:
with the pieces' and the matches' lengths in turn, running sums give every span in code points. Sums, context and
overlaps are found without going through a text again for each of its spans, so a long log is no harder than many short ones.

The patterns are those of the kinds' definitions, written so that Java's matcher takes linear time and constant stack:
possessive repeats, which lose nothing where what follows a repeat cannot also match within it, and a look-behind that
stops the search from trying every place inside a run again. ``\\G`` admits a match right after the last one.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of their spans. Those of BASE are always kept; the others are what checksums and context add.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "card_short", "ssn", "phone_local", "access_key", "secret")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "access_key": r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[A-Za-z0-9]{16,64}+(?![A-Za-z0-9])",
    "phone_local": r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
}
#: What a text must hold for a kind's pattern to be tried at all.
NEEDS = {"email": "@", "phone": "+", "ssn": "-", "access_key": "IA"}
#: Score of a span before context, what context adds, and the least score of a span that is kept, by kind.
SCORES = {"email": (0.9, 0.1), "ip": (0.7, 0.2), "card": (0.9, 0.1), "phone": (0.8, 0.2), "iban": (0.8, 0.2), "card_short": (0.4, 0.4), "ssn": (0.4, 0.4), "phone_local": (0.4, 0.4), "access_key": (0.8, 0.2), "secret": (0.4, 0.4)}
LEAST = 0.6
#: Words that speak for a kind, looked for within CONTEXT characters before and after a span.
CONTEXT = 60
CONTEXT_WORDS = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write)\b",
    "ip": r"(?i)\b(?:ip|address|host|server|login)\b",
    "card": r"(?i)\b(?:card|credit|debit|visa|payment|karte|carte|tarjeta)\b",
    "phone": r"(?i)\b(?:phone|tel|call|mobile|fax|telefon|t[ée]l[ée]phone|tel[ée]fono)\b",
    "iban": r"(?i)\b(?:iban|account|bank|konto|compte|cuenta)\b",
    "ssn": r"(?i)\b(?:ssn|social security)\b",
    "access_key": r"(?i)\b(?:key|access|secret|aws)\b",
    "secret": r"(?i)\b(?:password|passwd|pwd|passphrase|token|secret|credentials?|bearer|api[_-]?key)\b",
}
CONTEXT_WORDS |= {"card_short": CONTEXT_WORDS["card"], "phone_local": CONTEXT_WORDS["phone"]}


SPANS = "array<struct<start:int,end:int,found:string>>"
#: Code points of a text that are held together.
PIECE = 256


def _power(r: Column) -> Column:
    return F.pow(F.lit(2), r).cast("int")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: as a variable of a function over arrays it is not put in the place of
    each of its uses, some of which are within loops."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """The values up to each place, joined (sums, or maxima): in as many passes as the length has binary digits, each of
    which joins every value with one a power of two before it."""
    rounds = F.sequence(F.lit(0), F.length(F.bin(F.size(values))))
    one = lambda held, r: F.transform(held, lambda v, i: F.when(i >= _power(r), join(F.get(held, i - _power(r)), v)).otherwise(v))
    return F.when(F.size(values) < 2, values).otherwise(F.aggregate(rounds, values, one))


def spans_of(text: Column, pattern: str) -> Column:
    """Array of (start, end, found), in code points, for each match of the pattern from left to right.

    The lengths of what lies between matches and of the matches in turn, summed up, give the places.
    """

    def placed(found: Column) -> Column:
        between = F.split(text, pattern, -1)
        sizes = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, f: F.length(b) + F.length(f))
        span = lambda end, f: F.struct((end - F.length(f)).alias("start"), end.alias("end"), f.alias("found"))
        return F.when(F.size(found) == 0, F.array().cast(SPANS)).otherwise(bound(sizes, lambda each: F.zip_with(running(each, lambda x, y: x + y), found, span)))

    return bound(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def pieces(text: Column) -> Column:
    """The text in pieces of PIECE code points: what lies at a place is found without going through all before it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(held: Column, start: Column, end: Column) -> Column:
    """The code points from start to end of a text held in pieces."""
    first = F.floor(start / PIECE).cast("int")
    last = F.floor((end - 1) / PIECE).cast("int")
    some = F.array_join(F.transform(F.sequence(first, F.greatest(first, last)), lambda i: F.coalesce(F.get(held, i), F.lit(""))), "")
    return F.when(start >= end, F.lit("")).otherwise(F.substr(some, start - first * PIECE + 1, end - start))


def meets(spans: Column, start: Column, end: Column) -> Column:
    """Whether one of ``spans``, in order and apart from each other, shares a place with start to end: the last that
    begins before the end is found by halving."""
    steps = F.reverse(F.sequence(F.lit(0), F.length(F.bin(F.size(spans)))))

    def nearer(count: Column, r: Column) -> Column:
        more = count + _power(r)
        return F.when((more <= F.size(spans)) & (F.get(spans, more - 1)["start"] < end), more).otherwise(count)

    return F.coalesce(F.get(spans, F.aggregate(steps, F.lit(0), nearer) - 1)["end"] > start, F.lit(False))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass Luhn's check."""
    each = F.split(F.reverse(digits(value)), "")
    doubled = F.transform(each, lambda d, i: d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1))
    return F.aggregate(doubled, F.lit(0), lambda s, d: s + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number passes the mod-97 check: its first four characters moved to the end, letters as 10 to 35."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.split(F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4))), "")
    value_of = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(moved, value_of), F.lit(0), lambda s, v: (s * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def octets(value: Column) -> Column:
    part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
    return value.rlike(rf"^{part}(?:\.{part}){{3}}$")


def confirmed(kind: str, span: Column) -> Column:
    n = F.length(digits(span["found"]))
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: octets(span["found"]),
        "card": lambda: n.between(16, 19) & luhn(span["found"]),
        "card_short": lambda: n.between(13, 15) & luhn(span["found"]),
        "phone": lambda: n.between(8, 15),
        "iban": lambda: mod97(span["found"]),
        "ssn": lambda: ~span["found"].rlike("^(?:000|666|9)|-00-|-0000$"),
        "phone_local": lambda: F.lit(True),
        "access_key": lambda: F.lit(True),
        "secret": lambda: ~span["found"].rlike("^A[KS]IA[A-Z0-9]{16}$"),
    }[kind]()


def _scored_spans(order: int, kind: str, raw: Column, held: Column) -> Column:
    """The confirmed ones of a kind's proposed spans, with their scores; ``held`` is the text in pieces."""
    base, more = SCORES[kind]

    def scored(span: Column) -> Column:
        around = F.concat(cut(held, F.greatest(span["start"] - CONTEXT, F.lit(0)), span["start"]), F.lit(" "), cut(held, span["end"], span["end"] + CONTEXT))
        score = F.lit(base) + F.when(around.rlike(CONTEXT_WORDS[kind]), more).otherwise(0.0)
        return F.struct(F.lit(order).alias("kind_order"), span["start"].alias("start"), span["end"].alias("end"), F.lit(kind).alias("kind"), score.alias("score"))

    return F.transform(F.filter(raw, lambda span: confirmed(kind, span)), scored)


def spans_in(text: Column) -> Column:
    """All spans of a text, as :func:`find_pii` gives them."""
    sources = {k: k for k in (*BASE, *ADDED)} | {"card_short": "card"}
    kinds = list(dict.fromkeys(sources.values()))
    none = F.array().cast(SPANS)
    tried = lambda k: text.contains(NEEDS[k]) if k in NEEDS else text.rlike("[0-9]")
    raw = F.struct(*[F.when(tried(k), spans_of(text, PATTERNS[k])).otherwise(none).alias(k) for k in kinds])

    def scored(found: Column) -> Column:
        all_kinds = lambda held: F.struct(*[_scored_spans(order, k, found[sources[k]], held).alias(k) for order, k in enumerate((*BASE, *ADDED))])
        return bound(bound(pieces(text), all_kinds), merged)

    def merged(by: Column) -> Column:
        free = lambda s: (s["score"] >= LEAST) & ~functools.reduce(operator.or_, (meets(by[k], s["start"], s["end"]) for k in BASE))
        return F.concat(*[by[k] for k in BASE], *[F.filter(by[k], free) for k in ADDED])

    return bound(raw, scored)


def find_pii(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row a document: the id, and ``found``, an array of (kind_order, kind, start, end, score), by kind and start.

    Base kinds keep every confirmed span, whatever its score. An added kind's span must be confirmed, score at least
    LEAST and not overlap a base span. A null or empty text has no spans. Rows are independent of each other, nothing is
    shuffled, and repeated rows, null ids or further columns, whatever their names, change nothing. Time grows with a
    text's length and, but for a logarithm, with its spans.
    """
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    return df.select(F.col(f"`{id_column}`").alias("doc_id"), spans_in(text).alias("found"))


def redact(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id and the text, a row a document, with every span of :func:`find_pii` replaced by ``<KIND>``; spans that
    overlap are replaced together, by the kind of the first of them (of equal starts the longest)."""
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    ordered = F.array_sort(F.transform(spans_in(text), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def replaced(spans: Column) -> Column:
        ends = running(F.transform(spans, lambda s: -s["back"]), F.greatest)
        return bound(ends, lambda reached: F.when(F.size(spans) == 0, text).otherwise(bound(heads(spans, reached), lambda h: written(h, reached))))

    def heads(spans: Column, reached: Column) -> Column:
        """The spans that begin a group of overlapping ones, with their places."""
        told = F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), i.alias("i"), ((i == 0) | (s["start"] >= F.get(reached, i - 1))).alias("head")))
        return F.filter(told, lambda s: s["head"])

    def written(firsts: Column, reached: Column) -> Column:
        def all_parts(held: Column) -> Column:
            before = lambda h, k: F.when(k == 0, 0).otherwise(F.get(reached, h["i"] - 1))
            each = F.transform(firsts, lambda h, k: F.concat(cut(held, before(h, k), h["start"]), F.lit("<"), F.upper(h["kind"]), F.lit(">")))
            return F.concat(F.array_join(each, ""), cut(held, F.element_at(reached, -1), F.length(text)))

        return bound(pieces(text), all_parts)

    return df.select(F.col(f"`{id_column}`").alias("doc_id"), bound(ordered, replaced).alias(text_column))


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined in the order they have."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
