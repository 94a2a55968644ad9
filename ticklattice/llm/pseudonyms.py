"""Format-preserving pseudonyms for numbers, dates and addresses (operator 3).

Each validated item is replaced by the image of a keyed Feistel permutation of
its format: the separators and the length stay, equal values get equal
pseudonyms in every document, and two values never get the same one. What made
the item valid stays true of the pseudonym (check digits are made again, dates
stay dates, address parts stay in range).
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import column, pick, pieces, small_batches, table

#: Spark setting that holds the secret key of the query.
KEY_SETTING = "spark.ticklattice.pseudonyms.key"
#: Stands in where the setting is missing, as in tests: pseudonyms made with it can be reversed by anyone.
KEY = b"ticklattice"
ROUNDS = 8


def permute(value: int, size: int, key: bytes, tweak: bytes) -> int:
    """The image of value under a keyed permutation of range(size): an alternating Feistel
    network over two factors whose product is at least size, walked until it falls inside."""
    if size < 2:
        return value
    a = max(2, math.isqrt(size - 1) + 1)
    b = -(-size // a)
    wide = -(-(size.bit_length() // 2 + 64) // 8)  # bytes of a round's value: a half and 64 bits, so that the rest is even
    while True:
        left, right = divmod(value, b)
        for r in range(ROUNDS):
            mod, half = (a, right) if r % 2 == 0 else (b, left)
            named = hmac.new(key, b"%s|%x|%x|%x" % (tweak, size, r, half), hashlib.sha256).digest()
            f = int.from_bytes(hashlib.shake_256(named).digest(wide), "big")
            left, right = ((left + f) % mod, right) if r % 2 == 0 else (left, (right + f) % mod)
        value = left * b + right
        if value < size:
            return value


def digits(number: str, key: bytes, kind: str) -> str:
    """A string of digits permuted among those of its length."""
    if len(number) <= 4000:
        return str(permute(int(number), 10 ** len(number), key, kind.encode())).zfill(len(number)) if number else ""
    # longer than Python turns into a number: in parts, each with what stands before it as tweak
    out, before = [], kind.encode()
    for a in range(0, len(number), 4000):
        part = number[a : a + 4000]
        out.append(str(permute(int(part), 10 ** len(part), key, before)).zfill(len(part)))
        before = hmac.new(key, before + part.encode(), hashlib.sha256).digest()
    return "".join(out)


def over(text: str, new: str, what: str = "0123456789") -> str:
    """text with its characters of what replaced in turn by those of new."""
    it = iter(new)
    return "".join(next(it) if c in what else c for c in text)


def luhn(number: str) -> bool:
    total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(number))))
    return total % 10 == 0


def card(m: re.Match, key: bytes) -> str | None:
    """13 to 19 digits that pass the Luhn check, or 16 digits that begin like a card; a valid one stays valid."""
    raw = re.sub(r"\D", "", m[0])
    valid = luhn(raw)
    if not valid and not (len(raw) == 16 and raw[0] in "3456" or len(raw) == 15 and raw[:2] in ("34", "37")):
        return None
    head = raw[0] + digits(raw[1:-1] if valid else raw[1:], key, f"card{raw[0]}{valid}")
    if valid:
        head += next(c for c in "0123456789" if luhn(head + c))
    elif luhn(head):  # stays among the invalid: the last digit moves by a step, which two values cannot share
        return over(m[0], invalid(raw, key))
    return over(m[0], head)


def invalid(raw: str, key: bytes) -> str:
    """The permutation walked on until its image fails the Luhn check too."""
    now = raw
    while True:
        now = raw[0] + digits(now[1:], key, f"card{raw[0]}False")
        if not luhn(now):
            return now


def iban(m: re.Match, key: bytes) -> str | None:
    raw = m[0].replace(" ", "")
    turned = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(raw) <= 34 or turned(raw[4:] + raw[:4]) % 97 != 1:
        return None
    own = re.sub(r"\D", "", raw[4:])
    body = over(raw[4:], digits(own, key, "iban" + re.sub(r"\d", "0", raw[:2] + raw[4:])))
    check = 98 - turned(body + raw[:2] + "00") % 97
    return over(m[0], f"{raw[:2]}{check:02d}{body}", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def address(m: re.Match, key: bytes) -> str | None:
    parts = [int(x) for x in m[0].split(".")]
    if max(parts) > 255:
        return None
    value = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, b"ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


def phone(m: re.Match, key: bytes) -> str | None:
    """8 to 15 digits with a country code or separators; the country code stays."""
    raw = re.sub(r"\D", "", m[0])
    if not 8 <= len(raw) <= 15:
        return None
    keep = len(re.match(r"\+?(\d{0,3})(?=\D)", m[0])[1]) if m[0].startswith("+") and re.match(r"\+\d{1,3}\D", m[0]) else 0
    return over(m[0], raw[:keep] + digits(raw[keep:], key, f"phone{raw[:keep]}"))


def social(m: re.Match, key: bytes) -> str | None:
    a, b, c = m[0].split("-")
    ok = lambda a, b, c: a not in ("000", "666") and a < "900" and b != "00" and c != "0000"
    if not ok(a, b, c):
        return None
    raw = a + b + c
    while True:  # walked until it is valid again
        raw = digits(raw, key, "social")
        if ok(raw[:3], raw[3:5], raw[5:]):
            return over(m[0], raw)


FIRST, DAYS = datetime.date(1900, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days


def date(m: re.Match, key: bytes) -> str | None:
    """A day of 1900 to 2099, year first or last; day and month as they stand, day first if both can be."""
    a, b, c = re.split(r"\D", m[0])
    ymd = len(a) == 4
    for order in (("y", "m", "d"),) if ymd else (("d", "m", "y"), ("m", "d", "y")):
        got = dict(zip(order, map(int, (a, b, c))))
        try:
            day = datetime.date(got["y"], got["m"], got["d"])
        except ValueError:
            continue
        if not 0 <= (day - FIRST).days < DAYS:
            continue
        new = FIRST + datetime.timedelta(permute((day - FIRST).days, DAYS, key, b"date"))
        while not ymd and order[0] == "m" and new.day <= 12:  # stays in the format it was read in
            new = FIRST + datetime.timedelta(permute((new - FIRST).days, DAYS, key, b"date"))
        put = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
        return over(m[0], "".join(put[k] for k in order))
    return None


def email(m: re.Match, key: bytes) -> str:
    """The part before the @: letters among letters, digits among digits; the host stays."""
    local, host = m[0].split("@")
    low = "abcdefghijklmnopqrstuvwxyz"
    letters = [c for c in local.lower() if c in low]
    shape = re.sub(r"[0-9]", "0", re.sub(r"[A-Za-z]", "a", local))
    tweak, out = f"mail{shape}@{host}".encode(), []
    for a in range(0, len(letters), 512):  # parts of a bounded length, each with what stands before it as tweak
        part, value, made = letters[a : a + 512], 0, []
        for c in part:
            value = value * 26 + low.index(c)
        value = permute(value, 26 ** len(part), key, tweak)
        for _ in part:
            value, d = divmod(value, 26)
            made.append(low[d])
        out += reversed(made)
        tweak = hmac.new(key, tweak + "".join(part).encode(), hashlib.sha256).digest()
    new = over(local.lower(), "".join(out), low)
    new = over(new, digits(re.sub(r"\D", "", local), key, f"mail{shape}@{host}"))
    return "".join(n.upper() if o.isupper() and o.isascii() else n for o, n in zip(local, new)) + "@" + host


#: In the order in which a place in the text is tried.
KINDS: list[tuple[str, str, Callable]] = [
    ("email", r"(?<![\w.+%-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", email),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", iban),
    ("ip", r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])", address),
    ("date", r"(?<![\w./-])(?:[0-9]{4}([-/.])[0-9]{2}\1[0-9]{2}|[0-9]{2}([-/.])[0-9]{2}\2[0-9]{4})(?![\w]|[./-][0-9])", date),
    ("social", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", social),
    ("card", r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])", card),
    ("phone", r"(?<![\w.])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![\w])", phone),
]
MAYBE = re.compile(r"[0-9@]")
PATTERNS = [(name, re.compile(pattern), make) for name, pattern, make in KINDS]


def replaced(text: str, key: bytes = KEY) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of what they replace in the input."""
    if not MAYBE.search(text):
        return text, []
    taken: list[tuple[int, int, str, str]] = []
    free = text
    for name, pattern, make in PATTERNS:
        here = []
        for m in pattern.finditer(free):
            new = make(m, key)
            if new is not None:
                here.append((m.start(), m.end(), name, new))
        at, left = 0, []
        for a, b, *_ in here:
            left += [free[at:a], "\x00" * (b - a)]
            at = b
        free = "".join([*left, free[at:]])
        taken += here
    taken.sort()
    out, at = [], 0
    for a, b, _, new in taken:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), [(name, a, b) for a, b, name, _ in taken]


def pseudonymise(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """(doc_id, n_found, spans, text) for each row of docs (doc_id, text).

    spans: kind:start:end of what was replaced, in code points of the input,
    comma-joined. Who has the key can take pseudonyms back, so it must be
    secret. A null text stays null with nothing found. Repeated rows
    give equal results, an empty table none; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_found", pa.int64()), ("spans", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "text"):
                rows = []
                for doc, text in zip(column(piece, "doc_id").to_pylist(), column(piece, "text").to_pylist()):
                    new, spans = replaced(text, key) if text is not None else (None, [])
                    rows.append((doc, len(spans), ",".join(f"{k}:{a}:{b}" for k, a, b in spans), new))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return pick(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, n_found bigint, spans string, text string")


def op3_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(KEY_SETTING, None)
    return pseudonymise(table(spark, sf_dir, "documents"), key.encode() if key else KEY)


QUERIES = {"op3_feistel_pseudonyms": op3_feistel_pseudonyms}
ORACLES: dict[str, str] = {}
