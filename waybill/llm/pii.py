"""Format-preserving pseudonyms of personal numbers, dates, addresses and secrets.

A validated value is a number in the domain of its format: the digits of a card before
its check digit, the days of a calendar, the letters and digits of a mail name. A keyed
Feistel network permutes that domain, so equal values get equal pseudonyms in every
document, different ones stay different, and check digits, separators, case and length
are those of the format. The permutation applied is ``E^-1(E(x) + 1)``, one cycle
through the whole domain: no value is its own pseudonym.

Defined results: a null text stays null, an empty one empty; every other column and row
is unchanged; repeated rows get equal texts; values that fail validation are left alone.
"""

from __future__ import annotations

import datetime as dt
import re
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.llm.common import place, sealed, unsealed

KEY = "waybill"  # for tests and queries; production passes its own secret
ROUNDS = 8


class Permutation:
    """Keyed permutation of 0..n-1 without fixed points (for n > 1)."""

    def __init__(self, key: str, tag: str, n: int):
        self.n = n
        self.a = max(1, _root(n))
        self.b = -(-n // self.a)
        self.key = key.encode()[:64]
        self.tag = f"{tag}|{n}|".encode()

    def _f(self, round_no: int, value: int) -> int:
        text = self.tag + b"%d|%d" % (round_no, value)
        return int.from_bytes(blake2b(text, key=self.key).digest(), "big")

    def _forward(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i in range(0, ROUNDS, 2):
            left = (left + self._f(i, right)) % self.a
            right = (right + self._f(i + 1, left)) % self.b
        return left * self.b + right

    def _back(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i in range(ROUNDS - 2, -1, -2):
            right = (right - self._f(i + 1, left)) % self.b
            left = (left - self._f(i, right)) % self.a
        return left * self.b + right

    def __call__(self, x: int) -> int:
        y = self._forward(x)
        while y >= self.n:  # walk along the cycle back into the domain
            y = self._forward(y)
        y = self._back((y + 1) % self.n)
        while y >= self.n:
            y = self._back(y)
        return y


def _root(n: int) -> int:
    r = int(n**0.5) if n < 1 << 52 else 1 << ((n.bit_length() + 1) // 2)
    while r * r > n:
        r = (r + n // r) // 2
    return r


_permutation = lru_cache(4096)(Permutation)


@lru_cache(1 << 16)
def _digits(key: str, tag: str, radices: tuple[int, ...], value: tuple[int, ...]) -> tuple:
    """Mixed-radix value, permuted."""
    x = n = 0
    n = 1
    for r, v in zip(radices, value):
        x, n = x * r + v, n * r
    y = _permutation(key, tag, n)(x)
    out = []
    for r in reversed(radices):
        y, v = divmod(y, r)
        out.append(v)
    return tuple(reversed(out))


def _put(text: str, chars: str) -> str:
    """``chars`` in the places of the letters and digits of ``text``."""
    rest = iter(chars)
    return "".join(next(rest) if c.isalnum() else c for c in text)


def _symbols(key: str, tag: str, text: str) -> str:
    """Letters stay letters of their case, digits digits; equal up to case stays linked."""
    some = [c for c in text if c.isalnum()]
    value = tuple(int(c) if c.isdigit() else ord(c.lower()) - 97 for c in some)
    radices = tuple(10 if c.isdigit() else 26 for c in some)
    new = _digits(key, tag, radices, value)
    chars = [str(v) if r == 10 else chr(97 + v) for v, r in zip(new, radices)]
    return _put(text, "".join(n.upper() if c.isupper() else n for n, c in zip(chars, some)))


def luhn(digits: str) -> int:
    """Sum that is a multiple of ten for a valid number."""
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return sum(int(d) for d in digits[::-2]) + sum(t - 9 if t > 9 else t for t in twice)


def _card(key: str, text: str) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 13 <= len(digits) <= 19 or luhn(digits) % 10 or len(set(digits)) == 1:
        return None
    body = digits[:-1]
    new = "".join(map(str, _digits(key, "card", (10,) * len(body), tuple(map(int, body)))))
    return _put(text, new + str(-luhn(new + "0") % 10))


def _ip(key: str, text: str) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (p[0] == "0" and p != "0") for p in parts):
        return None
    return ".".join(map(str, _digits(key, "ip", (256,) * 4, tuple(map(int, parts)))))


def _phone(key: str, text: str) -> str | None:
    digits = re.sub(r"\D", "", text)
    if not 10 <= len(digits) <= 15:
        return None
    # the country code of an international number stays
    code = len(re.match(r"\+?(\d*)", text)[1]) if text[0] == "+" else 0
    code = code if 0 < code <= 3 else (1 if text[0] == "+" else 0)
    if text[0] != "+" and len(digits) == 11:
        code = 1  # the trunk 1
    body = digits[code:]
    new = _digits(key, "phone", (10,) * len(body), tuple(map(int, body)))
    return _put(text, digits[:code] + "".join(map(str, new)))


def _social(key: str, text: str) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    at = area - 1 - (area > 666)
    a, g, s = _digits(key, "social", (898, 99, 9999), (at, group - 1, serial - 1))
    return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{s + 1:04d}"


def _mod97(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text)) % 97


def _iban(key: str, text: str) -> str | None:
    flat = text.replace(" ", "")
    if not 15 <= len(flat) <= 34 or _mod97(flat[4:] + flat[:4]) != 1:
        return None
    body = _symbols(key, "iban" + flat[:2], flat[4:])
    check = 98 - _mod97(body + flat[:2] + "00")
    return _put(text, f"{flat[:2]}{check:02d}{body}")


_FIRST_DAY = dt.date(1900, 1, 1).toordinal()
_DAYS = dt.date(2099, 12, 31).toordinal() - _FIRST_DAY + 1


def _day(year: str, month: str, day: str) -> int | None:
    try:
        at = dt.date(int(year), int(month), int(day)).toordinal() - _FIRST_DAY
    except ValueError:
        return None
    return at if 0 <= at < _DAYS else None


def _date(key: str, text: str) -> str | None:
    mark = re.search(r"\D", text)[0]
    parts = text.split(mark)
    # year first; else day first where that is a date, else month first
    orders = ("ymd",) if len(parts[0]) == 4 else ("dmy", "mdy")
    for order in orders:
        named = dict(zip(order, parts))
        at = _day(named["y"], named["m"], named["d"])
        if at is not None:
            break
    else:
        return None
    new = dt.date.fromordinal(_digits(key, "date", (_DAYS,), (at,))[0] + _FIRST_DAY)
    if order == "mdy" and new.day <= 12:
        # such a text would be read day first: take the day that a reader finds there
        order = "dmy"
    wide = all(len(p) >= 2 for p in parts)
    shown = {"y": f"{new.year:04d}", "m": str(new.month), "d": str(new.day)}
    return mark.join(shown[c].zfill(2) if wide else shown[c] for c in order)


def _mail(key: str, text: str) -> str | None:
    name, _, host = text.partition("@")
    return f"{_symbols(key, 'mail@' + host.lower(), name)}@{host}"


def _secret(key: str, text: str) -> str | None:
    if not re.search(r"\d", text) or not re.search(r"[A-Za-z]", text):
        return None
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", text):
        new = _digits(key, "hex", (16,) * len(text), tuple(int(c, 16) for c in text))
        hexed = "".join(f"{v:x}" for v in new)
        return hexed.upper() if text.upper() == text else hexed
    head = re.match(r"(?:AKIA|ASIA|gh[pousr]_|sk-|xox[abpr]-)?", text)[0]
    return head + _symbols(key, "secret" + head, text[len(head) :])


# kind, pattern, pseudonym; the first that matches at a place and validates wins
_NUMBERS = (
    ("secret", r"(?:AKIA|ASIA)[0-9A-Z]{16}|(?:gh[pousr]_|sk-|xox[abpr]-)[0-9A-Za-z-]{16,}"
               r"|[0-9a-f]{32,128}|[0-9A-F]{32,128}", _secret),
    ("iban", r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?", _iban),
    ("ip", r"\d{1,3}(?:\.\d{1,3}){3}", _ip),
    ("date", r"\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}"
             r"|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}-\d{1,2}-\d{4}", _date),
    ("social", r"\d{3}-\d{2}-\d{4}", _social),
    ("card", r"\d(?:[ -]?\d){12,18}", _card),
    ("phone", r"\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}"
              r"|\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}"
              r"|(?:1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}", _phone),
)
_KINDS = {kind: fn for kind, _, fn in _NUMBERS}
_PATTERNS = {kind: pattern for kind, pattern, _ in _NUMBERS}
_END = r"(?![\w]|[.-]\w)"
_ENDS = {"date": rf"(?:{_END}|(?=T\d))"}  # the time of day may follow
_EACH = {
    kind: re.compile(rf"(?<![\w.+-])(?:{pattern}){_ENDS.get(kind, _END)}", re.ASCII)
    for kind, pattern, _ in _NUMBERS
}
_SHORTER = {"iban", "card", "phone"}  # check digits or the greatest length tell where these end


def _match(kind: str, text: str, place: int, key: str) -> tuple[int, str] | None:
    """End and pseudonym of the longest value of the kind that begins at the place. What
    follows may look like a part of it, so shorter ends at its spaces are tried too."""
    m = _EACH[kind].match(text, place)
    if not m:
        return None
    ends = [m.end()]
    if kind in _SHORTER:
        ends += [place + i for i, c in enumerate(m[0]) if c == " "][::-1]
    for end in ends:
        some = text[place:end]
        if end == m.end() or re.fullmatch(_PATTERNS[kind], some, re.ASCII):
            new = _KINDS[kind](key, some)
            if new is not None:
                return end, new
    return None


# where any of them may begin
_START = re.compile(r"(?<![\w.+-])(?:[+(]?\d|[A-Fa-f]{1,31}\d|[A-Z]{2}\d|AKIA|ASIA|gh[pousr]_|sk-|xox)",
                    re.ASCII)
_MAIL = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
)


def pseudonymize(text: str, key: str = KEY) -> tuple[str, int]:
    """The text with pseudonyms, and how many values were replaced."""
    n = 0
    if "@" in text:

        def mail(m: re.Match) -> str:
            nonlocal n
            n += 1
            return _mail(key, m[0])

        text = _MAIL.sub(mail, text)
    out, done, at = [], 0, _START.search(text)
    while at:
        place, end = at.start(), at.end()
        if text[place] == "(":  # a bracket around a value, or a phone number's own
            end = place + 1
        for kind in _KINDS:
            found = _match(kind, text, place, key)
            if found:
                out += (text[done:place], found[1])
                done = end = found[0]
                n += 1
                break
        at = _START.search(text, end)
    return "".join([*out, text[done:]]), n


def pseudonyms(text: Column, key: str = KEY) -> Column:
    """Struct of the text with pseudonyms and the number of values replaced."""

    @F.arrow_udf("text string, n_replaced bigint")
    def replace(texts: pa.Array) -> pa.Array:
        done = [None if t is None else pseudonymize(t, key) for t in texts.to_pylist()]
        return pa.StructArray.from_arrays(
            [
                pa.array([d and d[0] for d in done], pa.string()),
                pa.array([d[1] if d else 0 for d in done], pa.int64()),
            ],
            names=["text", "n_replaced"],
        )

    return replace(text)


def without_pii(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """The documents with pseudonyms in their text."""
    at = place(docs, text)
    rows = sealed(docs)
    rows = rows.select(*rows.columns, pseudonyms(F.col(at), key).alias("__pii"))
    return rows.withColumn(at, F.col("__pii.text")).select(*unsealed(docs))
