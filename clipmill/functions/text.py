"""Scalar text functions as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# How punctuation maps to ASCII, title suffixes in order, generic
# title words, weights of document states, prefixes of lines that are no claims.
PUNCTUATION = {"—": "-", "–": "-", "‘": "'", "’": "'", "“": '"', "”": '"', "…": "."}
TITLE_SUFFIXES = (" - Claude - Brave", " - Claude", "— Claude - Brave", "— Claude", " - Brave", " - Chrome", " - Firefox", " - Safari", " - Edge", " - Arc")
GENERIC_TITLES = ("untitled", "new tab", "bash", "zsh", "terminal", "new document")
STATUS_WEIGHTS = {"provisional": 0.8, "archived": 0.5, "missing": 0.3}
PREAMBLES = ("here are", "the following", "below are", "claims:", "claims extracted", "note:", "---")
SHORT_BYTES, MEDIUM_BYTES = 1200, 3500
MARKERS = "\x01\x02\x03"


def trim(c: Column) -> Column:
    """Without white space at both ends, of any script."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def lines(c: Column) -> Column:
    """Lines without their ends; a last line end opens no further line."""
    body = F.regexp_replace(c, r"\r?\n\z", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n", -1))


def words(c: Column) -> Column:
    """Maximal runs that hold no white space."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def normalize_to_ascii(c: Column) -> Column:
    """Curly punctuation made plain, other non-ASCII characters blank, white space collapsed."""
    plain = F.translate(c, "".join(PUNCTUATION), "".join(PUNCTUATION.values()))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^\x00-\x7F]", " "), r"[\s\x0B]+", " "))


def strip_source_suffix(c: Column) -> Column:
    """A window title without the first fitting browser suffix and without a trailing address."""
    first = F.lit(None).cast("string")
    for suffix in reversed(TITLE_SUFFIXES):
        first = F.when(c.endswith(suffix), F.substr(c, F.lit(1), F.length(c) - len(suffix))).otherwise(first)
    bare = F.coalesce(first, c)
    for scheme in ("https", "http"):
        bare = F.regexp_replace(bare, rf"(?s)^(.*) - {scheme}://.*$", "$1")
    return trim(bare)


def group_key(c: Column) -> Column:
    """The title to group by, or null where it is too short or generic."""
    key = strip_source_suffix(c)
    generic = F.lower(key).rlike("|".join(GENERIC_TITLES))
    return F.when((F.octet_length(key) >= 3) & ~generic, key)


def truncate_bytes(c: Column, most: int) -> Column:
    """At most ``most`` bytes, cut back to a whole character."""
    raw = F.substring(F.encode(c, "utf-8"), 1, most)
    tail = F.regexp_extract(F.hex(raw), r"(?:C[2-9A-F]|D.|E.(?:[89AB].)?|F.(?:[89AB].){0,2})$", 0)
    whole = F.substring(F.hex(F.encode(c, "utf-8")), 1, 2 * most)
    kept = F.substr(whole, F.lit(1), F.length(whole) - F.length(tail))
    return F.when(F.octet_length(c) <= most, c).otherwise(F.decode(F.unhex(kept), "utf-8"))


def strip_markers(c: Column) -> Column:
    return F.translate(c, MARKERS, "")


def diff_side(own: Column, other: Column) -> Column:
    """Lines of ``own`` whose trimmed form is not a line of ``other``; blank lines never count."""
    fresh = lambda seen: F.filter(lines(own), lambda line: (trim(line) != "") & ~F.array_contains(seen, trim(line)))
    # As an argument the trimmed lines are made once, not anew for each line of ``own``.
    return F.array_join(F.get(F.transform(F.array(F.transform(lines(other), trim)), fresh), 0), "\n")


def length_tier(c: Column, short: int = SHORT_BYTES, medium: int = MEDIUM_BYTES) -> Column:
    return F.when(F.octet_length(c) < short, "short").when(F.octet_length(c) < medium, "medium").otherwise("long")


def status_weight(c: Column) -> Column:
    weight = F.lit(1.0)
    for status, value in STATUS_WEIGHTS.items():
        weight = F.when(c == status, F.lit(value)).otherwise(weight)
    return weight


def claim_of_line(line: Column) -> Column:
    """A line of a model's answer without bullet, label or number."""
    s = trim(line)
    label = F.regexp_extract(s, r"(?Us)^\[[^\]]*\]\s*(\S.*)$", 1)
    numbered = F.regexp_extract(s, r"(?s)^[0-9]{0,3}\. (.*)$", 1)
    starred = s.startswith("- ") | s.startswith("* ")
    return F.when(starred, trim(F.substr(s, F.lit(3)))).when(label != "", trim(label)).when(s.rlike(r"^[0-9]{0,3}\. "), trim(numbered)).otherwise(s)


def is_preamble(claim: Column) -> Column:
    low = F.lower(claim)
    found = F.lit(False)
    for prefix in PREAMBLES:
        found = found | low.startswith(prefix)
    return found


def claims(response: Column) -> Column:
    """Array of claims of an answer, in order."""
    return F.filter(F.transform(lines(response), claim_of_line), lambda c: (c != "") & ~is_preamble(c))


def normalize_tag(c: Column) -> Column:
    return F.replace(F.lower(trim(c)), F.lit(" "), F.lit("-"))


def snippets_similar(a: Column, b: Column) -> Column:
    """Equal, or over four fifths of the words of ``a``, with repeats, are words of ``b`` (by the shorter length)."""
    x, y = trim(strip_markers(a)), trim(strip_markers(b))
    wa, wb = words(x), words(y)
    least = F.least(F.size(wa), F.size(wb))
    shared = F.size(F.filter(wa, lambda w: F.array_contains(wb, w)))
    return (x == y) | ((least >= 5) & (shared / least > 0.8))


def _accents() -> tuple[str, str]:
    """Letters that decompose to an ASCII letter and marks, and those letters: by rule from the Unicode database."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(code))
        if len(base) > 1 and base[0].isascii() and base[0].isalpha() and all(unicodedata.combining(x) for x in base[1:]):
            pairs.append((chr(code), base[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def fold(c: Column) -> Column:
    """Lower case without diacritics."""
    return F.lower(F.translate(F.regexp_replace(c, r"\p{M}", ""), ACCENTED, PLAIN))


def search_tokens(c: Column) -> Column:
    """Tokens of the text index: runs of letters, digits and private characters, folded."""
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def detailed_prompt(text: Column, instructions: str) -> Column:
    return F.concat(F.lit(instructions + "\n"), text)


def diff_prompt(added: Column, removed: Column, instructions: str) -> Column:
    side = lambda c: F.when(c == "", "(nothing)").otherwise(c)
    return F.concat(F.lit(f"{instructions}\n\n## Added in the new version\n"), side(added), F.lit("\n\n## Removed from the previous version\n"), side(removed), F.lit("\n"))


def claim_prompt(text: Column, rules: str, framing: Column | None = None) -> Column:
    head = F.coalesce(framing, F.lit("")) if framing is not None else F.lit("")
    return F.concat(head, F.lit(rules + "\n"), text)


def prompt_hash(text: str) -> str:
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()[:16]


def looks_like_mail_summary(c: Column) -> Column:
    low = F.lower(c)
    delimiter = c.contains("\nEMAIL\n") | c.contains("\n### EMAIL\n") | c.contains("\n##EMAIL\n") | c.contains("\n#EMAIL\n")
    return delimiter & low.contains("\nfrom:") & low.contains("\ndate:")


def looks_like_markdown(c: Column) -> Column:
    """Whether the first hundred lines score three points or more for marks of Markdown."""

    def score(line: Column) -> Column:
        t = trim(line)
        point = lambda cond, n=1: F.when(cond, n).otherwise(0)
        return (
            point(t.rlike("^#{1,3} "), 2) + point(t.startswith("```"), 2) + point(t.rlike(r"^(?:- |\* |1\. )")) + point(t.contains("**") | t.contains("__"))
            + point(t.contains("](") & t.contains("[")) + point(t.startswith("|") & t.endswith("|"))
        )

    return F.aggregate(F.slice(lines(c), 1, 100), F.lit(0), lambda acc, line: acc + score(line)) >= 3
