"""Personal data replaced by format-preserving Feistel pseudonyms.

Each kind of value is found by a pattern and validated (Luhn, IBAN check
digits, calendar, octets, number-plan rules).  A valid value is a number in
the domain of all values of its format; a keyed Feistel network with cycle
walking permutes that domain, so the pseudonym has the same format (length,
separators, letter case, check digits) and equal values get equal pseudonyms
in every document, while different values never collide.

Kinds: email (the local part, and the domain's labels below its last two),
phone, card, iban, ssn, ipv4, date and secret (access keys, password= and
token= values).  A value that fails validation is left as it is.

Cases: null texts stay null, empty ones empty, both with no replacement;
repeated rows repeat; texts are read whole.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from math import prod

from pyspark.sql import DataFrame

from .common import map_texts

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

PATTERN = re.compile(
    r"(?P<email>(?<![\w.+%-])[A-Za-z0-9_.+%-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-]))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<key>(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w))"
    r"|(?P<named>(?i:\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b)\s{0,3}[=:]\s{0,3}[\"']?)(?P<secret>[A-Za-z0-9_+/.-]{8,128})"
    r"|(?P<ipv4>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))"
    r"|(?P<date>(?<![\w/.-])(?:\d{4}(?P<s1>[-/.])\d{2}(?P=s1)\d{2}|\d{1,2}(?P<s2>[/.])\d{1,2}(?P=s2)\d{4})(?![\w/-]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{2,4}[ .-]?\d{3,4}(?!\w|[.-]\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w|[.-]\d)|(?<![\w(])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\w|[.-]\d))"
    r"|(?P<card>(?<![\w-])(?:\d{13,19}|\d{4}(?P<s3>[ -])\d{4}(?P=s3)\d{4}(?P=s3)\d{1,7}|\d{4}(?P<s4>[ -])\d{6}(?P=s4)\d{5})(?![\w-]))"
)
_HINT = re.compile(r"[0-9@]|(?i:pass|pwd|token|secret|api|AKIA|ASIA)")


class Feistel:
    """A keyed permutation of range(n) for any n: an unbalanced-safe Feistel network on bits, walked into the range."""

    def __init__(self, key: bytes, rounds: int = 8):
        self.key, self.rounds = hashlib.sha256(b"riverine-pii" + key).digest(), rounds

    def _round(self, tweak: bytes, i: int, value: int, bits: int) -> int:
        out, block, at = 0, b"", value.to_bytes((bits + 7) // 8 or 1, "big")
        while len(block) * 8 < bits:
            block += hashlib.blake2b(tweak + bytes([0, i, len(block) // 64]) + at, key=self.key).digest()
        out = int.from_bytes(block, "big")
        return out & ((1 << bits) - 1)

    def permute(self, tweak: str, x: int, n: int, back=False) -> int:
        if n < 2:
            return x
        half = ((n - 1).bit_length() + 1) // 2
        mask, name = (1 << half) - 1, f"{tweak}/{n}".encode()
        while True:
            a, b = x >> half, x & mask
            for i in range(self.rounds - 1, -1, -1) if back else range(self.rounds):
                if back:
                    a, b = b ^ self._round(name, i, a, half), a
                else:
                    a, b = b, a ^ self._round(name, i, b, half)
            x = a << half | b
            if x < n:
                return x


def luhn(digits: str) -> int:
    """Sum that is 0 mod 10 for a valid number."""
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


class Pseudonyms:
    """value -> value of the same format, by kind."""

    def __init__(self, key: bytes, first_year=1900, last_year=2099):
        self.feistel = Feistel(key)
        self.days = (datetime.date(first_year, 1, 1).toordinal(), datetime.date(last_year, 12, 31).toordinal())

    def _mixed(self, tweak: str, digits: list[int], bases: list[int], back: bool) -> list[int]:
        x = 0
        for d, b in zip(digits, bases, strict=True):
            x = x * b + d
        x = self.feistel.permute(tweak, x, prod(bases), back)
        out = []
        for b in reversed(bases):
            x, d = divmod(x, b)
            out.append(d)
        return out[::-1]

    def characters(self, tweak: str, text: str, back=False) -> str:
        """Digits to digits, capital and small ASCII letters to such; all else stays."""
        at = [(i, k, k.index(c)) for i, c in enumerate(text) for k in (DIGITS, LOWER, UPPER) if c in k]
        out = list(text)
        for (i, k, _), d in zip(at, self._mixed(tweak + "/" + "".join(k[0] for _, k, _ in at), [d for _, _, d in at], [len(k) for _, k, _ in at], back), strict=True):
            out[i] = k[d]
        return "".join(out)

    def email(self, x, back=False):
        local, _, domain = x.rpartition("@")
        head, last = domain.split(".")[:-2], domain.split(".")[-2:]
        out = self.characters("email", local + "@" + ".".join(head), back)
        return ".".join([out, *last] if head else [out + last[0], last[1]])

    def phone(self, x, back=False):
        digits = [i for i, c in enumerate(x) if c.isdigit()]
        if not 7 <= len(digits) <= 15:
            return None
        start = len(re.match(r"\+\d{1,3}(?=[ .(-])|\+?", x)[0])  # the country code stays
        return x[:start] + self.characters("phone" + x[:start], x[start:], back)

    def card(self, x, back=False):
        digits = re.sub(r"\D", "", x)
        if not 13 <= len(digits) <= 19 or digits[0] not in "3456" or luhn(digits):
            return None
        body = digits[0] + self.characters("card" + digits[0], digits[1:-1], back)
        filled = iter(body + str((10 - luhn(body + "0")) % 10))
        return "".join(next(filled) if c.isdigit() else c for c in x)

    def iban(self, x, back=False):
        plain = x.replace(" ", "")
        if not 15 <= len(plain) <= 34 or iban_rest(plain) != 1:
            return None
        body = self.characters("iban" + plain[:2], plain[4:], back)
        filled = iter(plain[:2] + f"{98 - iban_rest(plain[:2] + '00' + body):02d}" + body)
        return "".join(c if c == " " else next(filled) for c in x)

    def ssn(self, x, back=False):
        a, b, c = map(int, x.split("-"))
        if not (0 < a < 900 and a != 666 and b and c):
            return None
        a, b, c = self._mixed("ssn", [a - 1 - (a > 666), b - 1, c - 1], [898, 99, 9999], back)
        return f"{a + 1 + (a >= 665):03d}-{b + 1:02d}-{c + 1:04d}"

    def ipv4(self, x, back=False):
        parts = x.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        low, many = [(0, 0), (0, 10), (10, 90), (100, 156)], [len(p) for p in parts]
        out = self._mixed("ipv4" + "".join(map(str, many)), [int(p) - low[n][0] for p, n in zip(parts, many, strict=True)], [low[n][1] for n in many], back)
        return ".".join(str(d + low[n][0]) for d, n in zip(out, many, strict=True))

    def date(self, x, back=False):
        sep = re.search(r"[-/.]", x)[0]
        parts = x.split(sep)
        ymd = len(parts[0]) == 4
        for order in ((0, 1, 2),) if ymd else ((2, 1, 0), (2, 0, 1)):  # day first, month first where only that is a date
            try:
                day = datetime.date(*(int(parts[i]) for i in order)).toordinal()
            except ValueError:
                continue
            if not self.days[0] <= day <= self.days[1]:
                return None
            # days whose form needs another reading or width are walked over, so that the pseudonym reads back
            wide = [len(p) for p in parts]
            while True:
                day = self.days[0] + self.feistel.permute("date", day - self.days[0], self.days[1] - self.days[0] + 1, back)
                new = datetime.date.fromordinal(day)
                found = {0: new.year, 1: new.month, 2: new.day}
                out = [""] * 3
                for k, i in enumerate(order):
                    out[i] = str(found[k]).zfill(wide[i])
                if [len(p) for p in out] == wide and (ymd or order == (2, 1, 0) or new.day > 12):
                    return sep.join(out)
        return None

    def secret(self, x, back=False):
        return self.characters("secret", x, back) if len(x) >= 8 else None

    def key(self, x, back=False):
        return x[:4] + self.characters("key", x[4:], back)

    def replace(self, text: str | None, back=False) -> tuple[str | None, list[tuple[str, int, int]]]:
        """(the text with pseudonyms, (kind, start, end) of each in it); pseudonyms are as long as the values."""
        if not text or not _HINT.search(text):
            return text, []
        parts, spans, done = [], [], 0
        for m in PATTERN.finditer(text):
            kind = m.lastgroup
            value = m[kind]
            new = getattr(self, kind)(value, back)
            if new is None and kind == "phone" and (other := self.card(value, back)):
                kind, new = "card", other
            if new is not None:
                start, end = m.span(m.lastgroup)
                parts += [text[done:start], new]
                spans.append((kind, start, end))
                done = end
        return "".join(parts) + text[done:], spans


def pseudonymise(df: DataFrame, key: bytes, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, text (with pseudonyms), n_found, spans; one pass, no shuffle."""

    def start():
        by = Pseudonyms(key)

        def judge(found):
            return [(t, len(s), [{"kind": k, "start": a, "end": b} for k, a, b in s]) for t, s in map(by.replace, found)]

        return judge

    return map_texts(df, id_col, text_col, start, "text string, n_found int, spans array<struct<kind:string,start:int,end:int>>")
