"""Format-preserving pseudonyms for personal data (operator 3).

Values are found by pattern, validated, and replaced by a keyed permutation inside their own
format: a card number by another card number that passes the check digit, a date by another
date written with the same widths, an address by another address. Decimal digits of any script are read by their value and
written back in their own script. Numbers go through a balanced
Feistel network with cycle walking. Strings go through an alternating one over their two halves,
whose round function draws a stream as long as the half it changes from all of the other half, so
every character depends on the whole value, whatever its length. Equal values get equal pseudonyms
in every document under one key and different values of one format never share one.
"""

from __future__ import annotations

import bisect
import datetime
import functools
import hashlib
import hmac
import ipaddress
import re
import secrets
import unicodedata
from collections.abc import Mapping
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.frames import map_rows

ROUNDS = 10
DIGITS = "0123456789"
LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
#: Of each character that may change, the characters it may become.
MIXED = {c: kind for kind in (DIGITS, LOWER, UPPER) for c in kind}
NUMBER = {c: DIGITS for c in DIGITS}
HEX = {c: DIGITS + "abcdef" for c in DIGITS + "abcdef"}
UPPER_HEX = {c: DIGITS + "ABCDEF" for c in DIGITS + "ABCDEF"}
MIXED_HEX = {c: kind for kind in (DIGITS, "abcdef", "ABCDEF") for c in kind}
#: Signs that may stand inside a secret; quotes and backslashes keep their places.
SIGNS = "!#$%&()*+,-./:;<=>?@[]^_`{|}~"
KEY_CHARS = {c: UPPER + DIGITS for c in UPPER + DIGITS}
FIRST_YEAR, LAST_YEAR = 1900, 2099
#: The session setting that holds the key.
KEY_SETTING = "spark.lodestone.pseudonym.key"


@functools.cache
def _alike(c: str) -> str:
    """The characters near ``c`` in the code table that are of its category."""
    low = ord(c) & ~31
    return "".join(x for x in map(chr, range(low, low + 32)) if unicodedata.category(x) == unicodedata.category(c))


class Everything(Mapping):
    """Kinds of all letters and digits of any script, and of ``signs``."""

    def __init__(self, signs: str = ""):
        self.known = MIXED | {c: signs for c in signs}

    def __contains__(self, c: object) -> bool:
        return c in self.known or (c > "\x7f" and c.isalnum())

    def __getitem__(self, c: str) -> str:
        return self.known[c] if c in self.known else _alike(c)

    def __iter__(self):
        return iter(self.known)

    def __len__(self) -> int:
        return len(self.known)


ANY_LETTER, ANY_SIGN = Everything(), Everything(SIGNS)


@functools.cache
def _drawn(application: str) -> str:
    return secrets.token_hex(32)


def session_key(spark: SparkSession) -> str:
    """The key that the session names in KEY_SETTING; without one, a random key of this application.

    Under a drawn key equal values are linked inside the application's results, and no one can link or
    invert them later. Set the key to link results of several runs.
    """
    return spark.conf.get(KEY_SETTING, None) or _drawn(spark.sparkContext.applicationId)


def permute(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """A keyed permutation of range(size): a balanced Feistel network, walked until it lands inside."""
    if size < 2:
        return value
    half = isqrt(size - 1) + 1
    width = (half.bit_length() + 7) // 8 + 16
    while True:
        left, right = divmod(value, half)
        for r in range(ROUNDS):
            mac = hmac.digest(key, b"%d|%b|%d" % (r, tweak, right), "sha256")
            left, right = right, (left + int.from_bytes(hashlib.shake_256(mac).digest(width), "big")) % half
        value = left * half + right
        if value < size:
            return value


def permute_string(values: list[int], bases: list[int], key: bytes, tweak: bytes) -> list[int]:
    """A keyed permutation of all strings of numbers below ``bases``: an alternating Feistel network over two halves.

    Each round adds to one half, number by number, a stream of its length drawn from the whole other half.
    """
    cut = len(values) // 2
    half = [np.array(values[:cut], np.uint64), np.array(values[cut:], np.uint64)]
    base = [np.array(bases[:cut], np.uint64), np.array(bases[cut:], np.uint64)]
    for r in range(ROUNDS):
        i = r % 2
        mac = hmac.digest(key, b"%d|%d|%b|" % (r, len(values), tweak) + half[1 - i].astype(np.uint8).tobytes(), "sha256")
        stream = np.frombuffer(hashlib.shake_256(mac).digest(8 * len(half[i])), "<u8")
        half[i] = (half[i] + stream % base[i]) % base[i]
    return [*half[0].tolist(), *half[1].tolist()]


def swap(text: str, kinds: Mapping[str, str], key: bytes, tweak: bytes) -> str:
    """``text`` with the characters in ``kinds`` permuted among all strings of their kinds; the others stay."""
    at = [k for k, c in enumerate(text) if c in kinds]
    kind = [kinds[text[k]] for k in at]
    new = permute_string([g.index(text[k]) for k, g in zip(at, kind)], [len(g) for g in kind], key, tweak + b"|" + "".join([g[0] for g in kind]).encode())
    out = list(text)
    for k, g, v in zip(at, kind, new):
        out[k] = g[v]
    return "".join(out)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _card(m: re.Match, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if not 13 <= len(digits) <= 19 or not luhn(digits):
        return None
    # The leading digit stays (the network), the last is the check digit.
    body = digits[0] + swap(digits[1:-1], NUMBER, key, b"card" + digits[0].encode())
    check = next(c for c in DIGITS if luhn(body + c))
    fresh = iter(body + check)
    return re.sub(r"\d", lambda _: next(fresh), m[0])


def _iban(m: re.Match, key: bytes) -> str | None:
    def number(s: str) -> int:
        return int("".join(str(int(c, 36)) for c in s))

    plain = m[0].replace(" ", "")
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = swap(plain[4:], MIXED, key, b"iban" + plain[:2].encode())
    check = 98 - number(body + plain[:2] + "00") % 97
    fresh = iter(f"{plain[:2]}{check:02d}{body}")
    return re.sub(r"\S", lambda _: next(fresh), m[0])


@functools.cache
def _days(low_month: int, high_month: int, low_day: int, high_day: int) -> list[int]:
    """All days of the supported years whose month and day are in the ranges, in order."""
    first, last = datetime.date(FIRST_YEAR, 1, 1).toordinal(), datetime.date(LAST_YEAR, 12, 31).toordinal()
    dates = (datetime.date.fromordinal(d) for d in range(first, last + 1))
    return [d.toordinal() for d in dates if low_month <= d.month <= high_month and low_day <= d.day <= high_day]


def _date(m: re.Match, key: bytes) -> str | None:
    """Another day among those that are written with the same widths and leading zeros."""
    text = m[0]
    fields = re.findall(r"\d+", text)
    a, b, c = (int(x) for x in fields)
    first = len(fields[0]) == 4
    try:
        day = datetime.date(a, b, c) if first else datetime.date(c, b, a)
        order = (0, 1, 2) if first else (2, 1, 0)
    except ValueError:
        try:
            day, order = datetime.date(c, a, b), (1, 2, 0)
        except ValueError:
            return None
    if not FIRST_YEAR <= day.year <= LAST_YEAR:
        return None
    month, monthday = (fields[order.index(k)] for k in (1, 2))
    if len(month) == len(monthday) == 2:
        ranges = (1, 12, 1, 31)
    else:
        ranges = sum(((1, 9) if len(f) == 1 or f[0] == "0" else (10, 31) for f in (month, monthday)), ())
    days = _days(*ranges)
    new = datetime.date.fromordinal(days[permute(bisect.bisect_left(days, day.toordinal()), len(days), key, b"date%d,%d,%d,%d" % ranges)])
    parts = [new.year, new.month, new.day]
    fresh = iter([f"{parts[k]:0{len(f)}d}" for k, f in zip(order, fields)])
    return re.sub(r"\d+", lambda _: next(fresh), text)


def _ip(m: re.Match, key: bytes) -> str | None:
    parts = [int(x) for x in m[0].split(".")]
    if max(parts) > 255:
        return None
    value = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, b"ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


def _ssn(m: re.Match, key: bytes) -> str | None:
    area, group, serial = (int(x) for x in m[0].split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    areas = [a for a in range(1, 900) if a != 666]
    value = permute((areas.index(area) * 99 + group - 1) * 9999 + serial - 1, len(areas) * 99 * 9999, key, b"ssn")
    value, serial = divmod(value, 9999)
    area, group = divmod(value, 99)
    return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


def _phone(m: re.Match, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", m[0])
    if not 9 <= len(digits) <= 15:
        return None
    keep = 1 if m[0].lstrip().startswith("+") else 0
    fresh = iter(digits[:keep] + swap(digits[keep:], NUMBER, key, b"phone" + digits[:keep].encode()))
    return re.sub(r"\d", lambda _: next(fresh), m[0])


def _email(m: re.Match, key: bytes) -> str | None:
    """Local part and host name are permuted; the last label (the top-level domain) stays."""
    local, _, domain = m[0].rpartition("@")
    host, _, top = domain.rpartition(".")
    return f"{swap(local, ANY_LETTER, key, b'local')}@{swap(host, ANY_LETTER, key, b'host')}.{top}"


def _hex(m: re.Match, key: bytes) -> str | None:
    head, text = m["head"] or "", m["hex"]
    low, high = re.search(r"[a-f]", text), re.search(r"[A-F]", text)
    if not re.search(r"\d", text) or not (low or high):
        return None
    return head + swap(text, MIXED_HEX if low and high else UPPER_HEX if high else HEX, key, b"hex")


def _ip6(m: re.Match, key: bytes) -> str | None:
    """Another address, in the short form; however an address is written, it becomes the same one."""
    try:
        value = int(ipaddress.IPv6Address(m[0]))
    except ValueError:
        return None
    if value < 2:  # unspecified and loopback
        return None
    text = str(ipaddress.IPv6Address(permute(value, 1 << 128, key, b"ip6")))
    return text.upper() if re.search("[A-F]", m[0]) else text


def _access_key(m: re.Match, key: bytes) -> str | None:
    return m[0][:4] + swap(m[0][4:], KEY_CHARS, key, b"access")


def _secret(m: re.Match, key: bytes) -> str | None:
    """A quoted value as a whole; one without quotes but for the punctuation after it."""
    if m["quoted"]:
        return m["lead"] + m["quote"] + swap(m["quoted"], ANY_SIGN, key, b"secret") + m["quote"]
    value = m["value"]
    end = len(value.rstrip(".,;:!?)]}>"))
    end = end if end >= 6 else len(value)
    return m["lead"] + m["open"] + swap(value[:end], ANY_SIGN, key, b"secret") + value[end:]


def _token(m: re.Match, key: bytes) -> str | None:
    """A token behind its fixed lead; a value without any digit is a word."""
    if not re.search(r"\d", m["value"]):
        return None
    return m["lead"] + swap(m["value"], MIXED, key, b"token" + m["lead"].strip().lower().encode())


_NAME = r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b)[\"']?[ \t]*+[=:][ \t]*+"
#: Patterns in order of precedence, and what a text must hold for them; where two kinds could match, the first that validates wins.
KINDS = (
    ("email", ("@",), re.compile(r"(?<![\w.%+-])[\w.%+-]++@(?:[\w-]++\.)+[^\W\d_][\w-]*[^\W_]"), _email),
    ("access_key", ("AKIA", "ASIA"), re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"), _access_key),
    ("secret", ("=", ":"), re.compile(rf"(?P<lead>{_NAME})(?:(?P<quote>[\"'])(?P<quoted>[^\"'\r\n]{{6,}}+)(?P=quote)|(?P<open>[\"']?)(?P<value>[^\s\"']{{6,}}+))"), _secret),
    ("token", ("earer", "EARER"), re.compile(r"(?P<lead>(?i:\bbearer)[ \t]++)(?P<value>[A-Za-z0-9._~+/-]{12,}+)"), _token),
    ("token", ("eyJ",), re.compile(r"(?P<lead>\beyJ)(?P<value>[A-Za-z0-9_-]*+\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++)"), _token),
    ("token", ("gh", "xox", "sk-"), re.compile(r"(?P<lead>\b(?:gh[pousr]_|github_pat_|xox[baprs]-|sk-))(?P<value>[A-Za-z0-9_-]{10,}+)"), _token),
    ("hex", (), re.compile(r"(?<![A-Za-z0-9])(?P<head>0[xX])?(?P<hex>[0-9a-fA-F]{32,}+)(?![A-Za-z0-9])"), _hex),
    ("iban", (), re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), _iban),
    ("ip", (":",), re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9A-Fa-f]{0,4})(?![\w:])"), _ip6),
    ("ip", (".",), re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])(?!\.[0-9])"), _ip),
    ("date", (), re.compile(r"(?<![0-9./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?![0-9])(?![./-][0-9])"), _date),
    ("ssn", ("-",), re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])(?!-[0-9])"), _ssn),
    ("card", (), re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9])"), _card),
    ("phone", (), re.compile(r"(?<![\w+])\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![\w(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![\w.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])"), _phone),
)
#: A text without any of these holds nothing that a pattern can match.
MAYBE = re.compile(r"[\d@]|::|AKIA|ASIA|(?i:password|passwd|pwd|secret|token|api[_-]?key)")
_OTHER_DIGIT = re.compile(r"[^\D0-9]")


def _folded(text: str) -> str:
    """The text with decimal digits of all scripts as 0 to 9; every character keeps its place."""
    return text if text.isascii() else _OTHER_DIGIT.sub(lambda m: str(unicodedata.decimal(m[0])), text)


def _in_script(new: str, old: str) -> str:
    """``new`` with its digits in the scripts of the digits of ``old``, place by place, the last one for the rest."""
    zeros = [ord(c) - unicodedata.decimal(c) for c in old if c.isdecimal()]
    if not zeros or set(zeros) == {ord("0")}:
        return new
    out, k = [], 0
    for c in new:
        if c in DIGITS:
            c = chr(zeros[min(k, len(zeros) - 1)] + int(c))
            k += 1
        out.append(c)
    return "".join(out)


def pseudonymise(text: str, key: bytes) -> tuple[str, dict[str, int]]:
    """The text with every validated value replaced, and how many of each kind.

    Kinds are applied in turn, each to what the earlier ones left alone, so no value is replaced twice.
    """
    counts: dict[str, int] = {}
    if not MAYBE.search(text):
        return text, counts
    plain = _folded(text)
    parts: list[tuple[str | None, int, int]] = [(None, 0, len(text))]
    for name, needs, pattern, make in KINDS:
        if needs and not any(x in plain for x in needs):
            continue
        fresh: list[tuple[str | None, int, int]] = []
        for new, start, end in parts:
            if new is not None or end - start < 6:
                fresh.append((new, start, end))
                continue
            at, part = start, plain[start:end]
            for m in pattern.finditer(part):
                value = make(m, key)
                if value is not None:
                    low, high = start + m.start(), start + m.end()
                    fresh += [(None, at, low), (_in_script(value, text[low:high]), low, high)]
                    at = high
                    counts[name] = counts.get(name, 0) + 1
            fresh.append((None, at, end))
        parts = fresh
    return "".join([text[a:b] if new is None else new for new, a, b in parts]), counts


def _run(key: bytes):
    def run(batches):
        for batch in batches:
            texts, counts = [], []
            for value in batch.column(1):
                text = value.as_py()
                new, found = (None, {}) if text is None else pseudonymise(text, key)
                texts.append(new)
                counts.append(found)
            kinds = pa.array([list(c.items()) for c in counts], pa.map_(pa.string(), pa.int64()))
            total = pa.array([sum(c.values()) for c in counts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), total, kinds], names=["doc_id", "text", "n_found", "kinds"])

    return run


def pseudonyms(docs: DataFrame, key: str) -> DataFrame:
    """(doc_id, text, n_found, kinds): each whole text with its personal data replaced by pseudonyms.

    Validated kinds: email, cloud access key, password or token value, bearer, web, hub and chat token, long hexadecimal string of either case,
    IBAN (mod 97), IP address of either version, date (1900-2099), social security number, card number (check digit), phone number, with
    decimal digits of any script. What
    fails validation stays as it is. A null text stays null; rows are independent, so repeated rows
    get equal results; other columns are ignored; an empty table gives no rows.
    """
    return docs.select("doc_id", "text").mapInArrow(_run(key.encode()), "doc_id long, text string, n_found long, kinds map<string,long>")


def replace_text(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with all its columns and rows, ``text`` (and n_chars, if there) as pseudonymised."""
    names = docs.columns
    at = names.index("text")
    secret = key.encode()

    def run(batches):
        for batch in batches:
            new = [None if (t := v.as_py()) is None else pseudonymise(t, secret)[0] for v in batch.column(at)]
            cols = list(batch.columns)
            cols[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    out = map_rows(docs, run)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
