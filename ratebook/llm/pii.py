"""Operator 7: personal data by patterns, checksum validators and context words. SQL functions only.

Regular expressions propose spans. Validators confirm them: Luhn for cards,
part values for IP addresses, digit counts for phones, mod-97 for IBANs.
Each span has a score; a context word in the ``CONTEXT_CHARS`` code points
before a span raises it, and spans from ``THRESHOLD`` on are kept. Base kinds
are kept without context; the added kinds are

- ``iban``: account numbers that pass mod-97;
- ``card_short``: 13 to 15 digits that pass Luhn, near a card word;
- ``ssn``: 3-2-4 digits near an identity word;
- ``secret``: 32 to 128 hexadecimal digits, or an ``AKIA`` key id, near a credential word.

Positions are code points, end exclusive. They come from the pieces around
the matches: a split by the same pattern gives the text between the matches
and running sums of lengths give the places, so each text is scanned a fixed
number of times. The patterns are possessive, and start at run starts only,
so that no text makes them recurse or go quadratic.

Null and empty texts have no spans. Repeated rows each give a row. Extra
columns pass through; the operator's own columns replace clashing ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ratebook.llm.common import col
from ratebook.operators.staging import barrier

CONTEXT_CHARS = 40
THRESHOLD = 0.7
CONTEXT_BONUS = 0.3
BASE_KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns: (kind, pattern, text that must occur for a match to be possible or None).
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", None),
    "card": (r"[0-9](?:[\x20-]?[0-9]){15,}+", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3}+)?+(?![A-Za-z0-9])", None),
    "card_short": (r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,14}+(?![\x20-]?[0-9])", None),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", None),
    "secret": (r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}+|[0-9A-F]{32,128}+|AKIA[0-9A-Z]{16}+)(?![0-9A-Za-z])", None),
}
KINDS = tuple(PATTERNS)
#: The score of a confirmed span before context.
SCORES = {"email": 0.9, "ip": 0.8, "card": 0.95, "phone": 0.8, "iban": 0.95, "card_short": 0.5, "ssn": 0.5,
          "secret": 0.5}
#: Context words per kind, matched in lower case.
CONTEXT = {
    "email": "mail|contact|write", "ip": "host|server|address", "card": "card|visa|payment",
    "phone": "phone|call|tel|mobile", "iban": "iban|account|bank", "card_short": "card|visa|amex|diners|payment",
    "ssn": "ssn|social|security|identity", "secret": "token|secret|key|passw|credential|bearer",
}
STEP = 64


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(hit: Column) -> Column:
    """Whether an account number, its first four characters moved to the end, leaves 1 modulo 97."""
    plain = F.replace(hit, F.lit(" "), F.lit(""))
    moved = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))

    def step(rest, char):
        value = F.ascii(char)
        return F.when(value >= 65, (rest * 100 + value - 55) % 97).otherwise((rest * 10 + value - 48) % 97)
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def confirmed(kind: str, hit: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(hit, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind in ("card", "card_short"):
        digits = _digits(hit)
        least, most = (16, 19) if kind == "card" else (13, 15)
        return F.when(F.length(digits).between(least, most), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(hit)).between(8, 15)
    if kind == "iban":
        return mod97(hit)
    return F.lit(True)


def _ends(kind: str) -> Column:
    """End of each match: running sums of gap and match lengths, in steps so that long lists stay cheap."""
    steps = F.zip_with(f"__gaps_{kind}", f"__hits_{kind}", lambda g, h: g + F.length(h))
    return F.filter(steps, lambda x: x.isNotNull())


def find_pii(df: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """``df`` with ``out``: an array of (kind, start, end, score), by kind as in ``KINDS``, then by start."""
    work = df.drop(out) if out in df.columns else df
    names = work.columns
    text = F.coalesce(col(text_col), F.lit(""))

    def hits(kind):
        pattern, needs = PATTERNS[kind]
        found = F.regexp_extract_all(text, F.lit(pattern), 0)
        return found if needs is None else F.when(F.contains(text, F.lit(needs)), found).otherwise(F.array().cast("array<string>"))

    work = barrier(work.select("*", *[hits(k).alias(f"__hits_{k}") for k in KINDS]))

    def gaps(kind):
        lengths = F.transform(F.split(text, PATTERNS[kind][0], -1), F.length)
        return F.when(F.size(f"__hits_{kind}") > 0, lengths).otherwise(F.array().cast("array<int>"))

    work = barrier(work.select("*", *[gaps(k).alias(f"__gaps_{k}") for k in KINDS]))
    work = barrier(work.select(*map(col, names), *[f"__hits_{k}" for k in KINDS], *[_ends(k).alias(f"__step_{k}") for k in KINDS]))

    def bases(kind):
        """The running sum before each run of STEP matches."""
        steps = F.col(f"__step_{kind}")
        return F.aggregate(
            F.sequence(F.lit(0), F.expr(f"greatest(size(__step_{kind}) - 1, 0) div {STEP}").cast("int")),
            F.array(F.lit(0)),
            lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + F.aggregate(
                F.slice(steps, c * STEP + 1, F.lit(STEP)), F.lit(0), lambda a, x: a + x))))

    work = barrier(work.select("*", *[bases(k).alias(f"__base_{k}") for k in KINDS]))

    def spans(kind):
        steps, base = F.col(f"__step_{kind}"), F.col(f"__base_{kind}")

        def span(hit, i):
            run = F.floor(i / STEP).cast("int")
            end = F.element_at(base, run + 1) + F.aggregate(
                F.slice(steps, run * STEP + 1, i % STEP + 1), F.lit(0), lambda a, x: a + x)
            return F.struct(F.lit(kind).alias("kind"), (end - F.length(hit)).alias("start"), end.alias("end"),
                            confirmed(kind, hit).alias("sure"))
        return F.filter(F.transform(f"__hits_{kind}", span), lambda s: s["sure"])

    work = barrier(work.select(*map(col, names), *[spans(k).alias(f"__spans_{k}") for k in KINDS]))

    def scored(kind):
        def score(s):
            before = F.greatest(s["start"] - CONTEXT_CHARS, F.lit(0))
            near = F.rlike(F.lower(F.substring(text, before + 1, s["start"] - before)), F.lit(CONTEXT[kind]))
            value = F.lit(SCORES[kind]) + F.when(near, CONTEXT_BONUS).otherwise(0.0)
            return F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
                            F.least(value, F.lit(1.0)).alias("score"))
        return F.transform(f"__spans_{kind}", score)

    everything = F.filter(F.concat(*[scored(k) for k in KINDS]), lambda s: s["score"] >= THRESHOLD)
    return work.select(*map(col, names), everything.alias(out))


def digest(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def of_kind(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with every span of personal data replaced by its kind in brackets, e.g. ``[EMAIL]``.

    Overlapping spans are masked together, under the kind of the first.
    """
    names = df.columns
    found = barrier(find_pii(df, text_col, "__pii"))
    merged = F.aggregate(
        F.array_sort(F.transform("__pii", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"),
                                                             s["kind"].alias("kind")))),
        F.array().cast("array<struct<start:int,end:int,kind:string>>"),
        lambda acc, s: F.when((F.size(acc) > 0) & (s["start"] < F.element_at(acc, -1)["end"]), F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"),
                             F.greatest(F.element_at(acc, -1)["end"], s["end"]).alias("end"),
                             F.element_at(acc, -1)["kind"].alias("kind"))))).otherwise(F.concat(acc, F.array(s))))
    found = barrier(found.select(*map(col, names), F.when(F.size("__pii") > 0, merged).alias("__cut")))
    text = col(text_col)
    cut = F.col("__cut")
    masked = F.concat(F.array_join(F.transform(cut, lambda s, i: F.concat(
        F.substring(text, F.when(i > 0, F.get(cut, i - 1)["end"]).otherwise(0) + 1,
                    s["start"] - F.when(i > 0, F.get(cut, i - 1)["end"]).otherwise(0)),
        F.lit("["), F.upper(s["kind"]), F.lit("]"))), ""),
        F.substr(text, F.element_at(cut, -1)["end"] + 1))
    shown = [F.when(cut.isNull(), text).otherwise(masked).alias(c) if c == text_col else col(c) for c in names]
    return found.select(*shown)
