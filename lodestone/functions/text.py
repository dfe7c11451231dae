"""Text functions as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern values: what counts as sensitive in a text.
EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"\b\+?\d{1,3}[- ]?\d{2,4}[- ]?\d{2,4}[- ]?\d{3,4}\b"
CARD = r"\b(?:\d[ -]*?){13,19}\b"
PRIVATE_KEY = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"
API_KEY = r"\bsk-[A-Za-z0-9]{20,}\b"
HUB_TOKEN = r"\b(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,})\b"
CHAT_TOKEN = r"\bxox[baprs]-[A-Za-z0-9-]{10,}\b"
WEB_TOKEN = r"\beyJ[a-zA-Z0-9_-]*\.[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+\b"
ACCESS_KEY = r"\bAKIA[0-9A-Z]{16}\b"
PERSONAL = {"email": EMAIL, "phone": PHONE, "credit_card": CARD}
SECRET = {"private_key_block": PRIVATE_KEY, "openai_api_key": API_KEY, "github_token": HUB_TOKEN, "slack_token": CHAT_TOKEN, "jwt": WEB_TOKEN, "aws_access_key_id": ACCESS_KEY}
REDACTED = "[REDACTED]"


def query_words(query: str) -> list[str]:
    return [w for w in re.split(r"[\s　]+", query) if w]


def like_pattern(word: str) -> str:
    return "%" + re.sub(r"([%_\\])", r"\\\1", word) + "%"


def any_word(text: Column, words: list[str]) -> Column:
    """Case-insensitive substring match of any word; no words match nothing."""
    return reduce(lambda a, w: a | text.ilike(like_pattern(w)), words[1:], text.ilike(like_pattern(words[0]))) if words else F.lit(False)


def matched_share(text: Column, words: list[str]) -> Column:
    """Share of the words found in the text; 1 without words."""
    if not words:
        return F.lit(1.0)
    return reduce(lambda a, w: a + F.when(text.ilike(like_pattern(w)), 1.0).otherwise(0.0), words, F.lit(0.0)) / len(words)


def token_set(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits, two characters at least."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) >= 2))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def preview(text: Column, length: int = 120) -> Column:
    """White space collapsed, trimmed, cut with an ellipsis beyond ``length`` characters."""
    flat = F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))
    return F.when(F.length(flat) <= length, flat).otherwise(F.concat(F.substring(flat, 1, length - 3), F.lit("...")))


def expansion_term(value: Column) -> Column:
    """Dashes and underscores as spaces, trimmed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(value, r"[-_]+", " ")), F.lit(""))


def layer(scope: Column) -> Column:
    return F.when(scope == "principle", "macro").when(scope == "project", "meso").otherwise("micro")


def memory_type_of_kind(kind: Column) -> Column:
    """Default memory type of a kind; none for preferences."""
    return F.when(kind == "fact", "knowledge").when(kind == "task", "working_state").when(kind == "policy_hint", "norm")


def durable_scope(kind: Column, memory_type: Column) -> Column:
    return F.when((kind == "policy_hint") | F.coalesce(memory_type == "norm", F.lit(False)), "principle").otherwise("project")


def iso_instant(ts: Column) -> Column:
    """ISO-8601 with milliseconds, in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def kinds_found(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that match, in their fixed order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(name)) for name, p in patterns.items()]))


def redact(text: Column, patterns: dict[str, str] = PERSONAL) -> Column:
    """All matches replaced, one pattern after the other."""
    return reduce(lambda t, p: F.regexp_replace(t, p, REDACTED), patterns.values(), text)


def scrub_paths(text: Column) -> Column:
    return F.regexp_replace(text, r"/\S+", "[PATH]")


def digest(text: Column) -> Column:
    """SHA-256 of the raw text."""
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def flat_text(text: Column) -> Column:
    """Line ends unified, white space collapsed (Unicode spaces and byte-order marks too), trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "\r\n", "\n"), "[\\s   -     　﻿]+", " "))


def composed(text: Column) -> Column:
    """Unicode NFC, by the ICU library that Spark brings; a text below U+0300 is composed already."""
    nfc = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.when(text.rlike(r"[^\x{0}-\x{2FF}]"), nfc).otherwise(text)


def content_hash(text: Column, ascii_only: bool = False) -> Column:
    """Hash of the normalised text; NFC is skipped where the text is known to be composed already."""
    return F.concat(F.lit("sha256:"), F.sha2(flat_text(text if ascii_only else composed(text)).cast("binary"), 256))


# Fixed list: words that make a label generic.
GENERIC_WORDS = [
    "general", "overview", "summary", "notes", "note", "misc", "miscellaneous", "todo",
    "template", "sample", "example", "placeholder", "thing", "other", "default",
]


#: What parts the words of a label.
GAP = r" \t\n\x0B\f\r_-"


def generic_label(label: Column) -> Column:
    """Empty, short (two tokens and 24 characters at most), or with a generic word."""
    low = F.lower(label)
    flat = F.trim(F.regexp_replace(low, r"[_-]+", " "))
    tokens = F.filter(F.split(flat, r"[ \t\n\x0B\f\r]+"), lambda t: t != "")
    # A text that shows 25 characters at its start is not short, so only its words are looked for, in one pass.
    long = F.substring(low, 1, 200).rlike(r"^(?:[ _-]*[^ _-]){25}")
    short = F.when(long, False).when(F.length(flat) <= 24, F.size(tokens) <= 2).otherwise(False)
    return F.when(label.isNotNull(), short | low.rlike(rf"(?<![^{GAP}])(?:{'|'.join(GENERIC_WORDS)})(?![^{GAP}])"))


def least_rotation(nodes: Column) -> Column:
    """The lexicographically smallest rotation of a cycle's node list."""
    n = F.size(nodes)
    turned = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.concat(F.slice(nodes, k + 1, n - k), F.slice(nodes, 1, k)))
    return F.array_min(turned)
