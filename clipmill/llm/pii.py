"""Personal data by regular expressions, checksum validators and context words.

A regular expression proposes spans of each kind, leftmost and non-overlapping;
a validator (number ranges, digit counts, Luhn, mod-97, entropy) drops failing
ones without a retry; words within ``CONTEXT`` code points on either side of a span
raise its score, others lower it. Kinds of ``BASE`` always stay. Kinds of ``ADDED``
stay from a score of ``threshold`` on. Scores are returned.

Everything is a column expression: splitting a text at the pattern gives the
pieces between matches, so running lengths give positions in code points. The
patterns use possessive quantifiers and look-behinds where those can't change a
match, so that no text makes them backtrack far or recurse deeply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

CONTEXT = 40
BLOCK = 256
PAGE = 1024
SPAN = "struct<kind:string,start:bigint,end:bigint,value:string,score:double>"

# Patterns, scores and context words of each kind.
LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "tel": r"(?<![0-9+)-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+",
    "key": r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}+|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+|-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)(?![A-Za-z0-9])",
    "login": r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]{1,20}://[^/\s:@?#]++:[^/\s:@?#]++@",
}
GUARDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "iban": None, "ssn": "-", "tel": None, "login": "://"}
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "ssn", "tel", "secret", "key", "login")
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "tel": 0.4, "secret": 0.4, "key": 0.95, "login": 0.95}
WORDS = {
    "email": "mail|contact|write",
    "ip": "ip|address|host|server",
    "card": "card|visa|mastercard|credit|payment",
    "phone": "phone|tel|call|mobile|fax",
    "iban": "iban|bank|account|konto|compte",
    "ssn": "ssn|social security",
    "tel": "phone|tel|call|mobile|fax|telefon",
    "secret": "token|secret|passw|passphrase|key|auth|bearer|credential",
    "key": "key|token|secret",
    "login": "url|host|connect|login",
}
AGAINST = {
    "email": "example only",
    "ip": "version|release|build|section|chapter",
    "card": "order|tracking|isbn|serial",
    "phone": "order|serial|part",
    "iban": "serial|part",
    "ssn": "order|serial|part|isbn",
    "tel": "order|serial|part|isbn",
    "secret": "sha-?[0-9]+|md5|checksum|digest|commit|revision",
    "key": "example only",
    "login": "example only",
}
CONTEXT_BONUS, CONTEXT_MALUS, THRESHOLD, ENTROPY = 0.3, 0.3, 0.65, 3.0


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""

    def doubled(d: Column, i: Column) -> Column:
        twice = d * 2
        return F.when(i % 2 == 1, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)

    parts = F.transform(F.split(F.reverse(number), ""), lambda c, i: doubled(c.cast("int"), i))
    return F.aggregate(parts, F.lit(0), lambda acc, d: acc + d) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether an account number passes the mod-97 check."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def octets(value: Column) -> Column:
    """Whether all dotted parts are at most 255, however many zeros they start with."""
    return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def entropy(value: Column) -> Column:
    """Bits per character."""
    n = F.length(value)

    def part(c: Column) -> Column:
        p = (n - F.length(F.replace(value, c, F.lit("")))) / n
        return -p * F.log2(p)

    return F.aggregate(F.transform(F.array_distinct(F.split(value, "")), lambda c: F.when(c == "", 0.0).otherwise(part(c))), F.lit(0.0), lambda a, x: a + x)


VALID = {
    "email": lambda v: F.lit(True),
    "ip": octets,
    "card": lambda v: F.length(digits(v)).between(16, 19) & luhn(digits(v)),
    "phone": lambda v: F.length(digits(v)).between(8, 15),
    "iban": lambda v: F.length(F.replace(v, F.lit(" "), F.lit(""))).between(15, 34) & mod97(v),
    "ssn": lambda v: ~v.rlike("^(?:000|666|9)|-00-|-0000$"),
    "tel": lambda v: F.lit(True),
    "secret": lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (entropy(v) >= ENTROPY),
    "key": lambda v: F.lit(True),
    "login": lambda v: F.lit(True),
}


def before_each(lengths: Column) -> Column:
    """Sums of all earlier elements, in two levels so that no step is quadratic in a long array."""
    none = F.lit(0).cast("bigint")

    def within(block: Column, start: Column) -> Column:
        zero = F.struct(start.alias("sum"), F.array().cast("array<bigint>").alias("out"))
        step = lambda acc, x: F.struct((acc["sum"] + x).alias("sum"), F.concat(acc["out"], F.array(acc["sum"])).alias("out"))
        return F.aggregate(block, zero, step, lambda acc: acc["out"])

    def total(block: Column) -> Column:
        return F.aggregate(block, none, lambda a, x: a + x)

    blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(lengths) / BLOCK).cast("int") - 1), lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    spread = let(blocks, lambda bs: let(F.transform(bs, total), lambda sums: F.flatten(F.transform(bs, lambda b, i: within(b, total(F.slice(sums, F.lit(1), i)))))))
    return F.when(F.size(lengths) == 0, F.array().cast("array<bigint>")).otherwise(spread)


def spans_of(text: Column, kind: str, threshold: float) -> Column:
    """Array of spans of one kind, in order of their starts."""
    empty = F.array().cast(f"array<{SPAN}>")
    pattern = PATTERNS[kind]

    def located(both: Column) -> Column:
        """Valid matches with their places; context is read from pages of the text, so a span costs the same in a long text."""
        return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), F.lit(0)), lambda pages: F.transform(valid(both), lambda r: placed(r, pages)))

    def valid(both: Column) -> Column:
        matches = both["matches"]
        pieces = F.slice(both["pieces"], F.lit(1), F.size(matches))
        lengths = F.zip_with(pieces, matches, lambda p, m: (F.length(p) + F.length(m)).cast("bigint"))
        rows = let(lengths, lambda n: F.arrays_zip(pieces.alias("piece"), matches.alias("value"), before_each(n).alias("prior")))
        return F.filter(rows, lambda r: VALID[kind](r["value"]))

    def stretch(pages: Column, begin: Column, end: Column) -> Column:
        first = F.floor(begin / PAGE).cast("int")
        two = F.concat(F.coalesce(F.get(pages, first), F.lit("")), F.coalesce(F.get(pages, first + 1), F.lit("")))
        return F.substr(two, (begin - first * PAGE + 1).cast("int"), (end - begin).cast("int"))

    def placed(r: Column, pages: Column) -> Column:
        start = r["prior"] + F.length(r["piece"])
        end = start + F.length(r["value"])
        around = F.lower(F.concat(stretch(pages, F.greatest(start - CONTEXT, F.lit(0)), start), F.lit(" "), stretch(pages, end, end + CONTEXT)))
        for_it = F.when(around.rlike(rf"(?:\b|_)(?:{WORDS[kind]})"), CONTEXT_BONUS).otherwise(0.0)
        against = F.when(around.rlike(rf"(?:\b|_)(?:{AGAINST[kind]})"), CONTEXT_MALUS).otherwise(0.0)
        score = F.round(F.greatest(F.least(F.lit(SCORES[kind]) + for_it - against, F.lit(1.0)), F.lit(0.0)), 2)
        return F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), r["value"].alias("value"), score.alias("score"))

    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"))
    found = let(both, lambda b: F.when(F.size(b["matches"]) == 0, empty).otherwise(located(b).cast(f"array<{SPAN}>")))
    if kind in ADDED:
        found = F.filter(found, lambda s: s["score"] >= threshold)
    if kind == "secret":  # without a word for it no secret reaches a threshold above its own score
        guard = F.lower(text).rlike(WORDS[kind]) if threshold > SCORES[kind] else F.lit(True)
    elif kind == "key":
        guard = text.rlike("AKIA|gh[pousr]_|xox|eyJ|-----BEGIN")
    else:
        guard = F.contains(text, F.lit(GUARDS[kind])) if GUARDS[kind] else text.rlike("[0-9]{3}|[0-9][ -][0-9]")
    return F.when(guard, found).otherwise(empty)


def find_pii(df: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, kinds: tuple[str, ...] = BASE + ADDED) -> DataFrame:
    """All rows as struct ``row`` with ``spans``: array of (kind, start, end, value, score).

    Spans are grouped by kind in the order of ``kinds``, then by start; offsets
    count code points and the end is exclusive. A null text counts as empty and
    has no spans; rows that repeat are each judged; whole texts are searched.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    return df.select(F.struct("*").alias("row"), F.flatten(F.array(*[spans_of(text, k, threshold) for k in kinds])).alias("spans")).select(
        "row", F.explode(F.array("spans")).alias("spans")
    )


def redact(found: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``find_pii`` with spans cut out of the text and their kind put in place.

    Of overlapping spans the earliest, then the longest, is named; covered parts vanish.
    """
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    text = F.coalesce(F.col(f"row.{text_col}"), F.lit(""))
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        named = F.concat(acc["out"], F.array(F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], -s["back"]).alias("at"), F.when(fresh, named).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(ordered, zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, (acc["at"] + 1).cast("int"))))
    return found.select("row", "spans", clean.alias("redacted"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, counts of base kinds, base_sha256, spans, and their scores in the same order."""

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")

    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    counts = [count(k).alias(f"n_{k}") for k in BASE]
    return found.select(F.col(f"row.{id_col}").alias("doc_id"), *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"))
