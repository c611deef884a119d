"""Format-preserving Feistel pseudonyms for personal data and secrets.

A value that passes its validation is replaced by another of the same format:
its symbols are numbers in a mixed-radix domain, permuted by a keyed Feistel
network (ten rounds of keyed BLAKE2). Where the domain's size is no square or
some members are invalid, the permutation is walked until a valid member comes
up, which keeps it one-to-one. Equal values therefore get equal pseudonyms in
every document, and nothing has to be shared between tasks.

Kinds: card numbers (Luhn), IBANs (mod 97), NANP phone numbers, US social
security numbers, IPv4 addresses, calendar dates (year, month and day with hyphens
or slashes, day, month and year with slashes, dots or hyphens, month first with
slashes if nothing else fits), e-mail addresses, AWS-like access keys, and the values of
password / token / secret assignments, in quotes up to the closing quote. Separators, length, letter case and
digit positions stay; check digits are computed anew.

Edge cases: a null text stays null; an empty text stays empty; a text without
such values is returned unchanged; overlapping candidates go to the leftmost,
then to the first kind in the order above, then to the longest that passes its
validation; card numbers in other than the customary groups come after all
others; repeated rows are treated alike; other columns pass through. Texts are
read whole.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from almanac.llm.common import table

#: Key of the registered queries; a deployment passes its own.
DEMO_KEY = b"almanac demonstration key"
ROUNDS = 10
KINDS = ("card", "iban", "phone", "ssn", "ip", "date", "email", "access_key", "secret")

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
HEX = DIGITS + "abcdef"

#: Where a card number may end: before no word character, and before a hyphen only if no word or a last short group follows, such as a CVV.
CARD_END = r"(?:(?!\w|-\w)|(?=-\d{3,4}(?![\w-])))"
#: Customary groups of card numbers, by one separator.
GROUPED = "|".join(rf"\d{{4}}(?:{s}\d{{4}}){{2}}{s}(?:\d{{4}}{s}\d{{1,3}}|\d{{1,4}}){CARD_END}|\d{{4}}{s}\d{{6}}{s}\d{{4,5}}{CARD_END}" for s in " -")
PATTERNS = {
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "card": rf"(?<![\w.-])(?:\d{{13,19}}{CARD_END}|{GROUPED})",
    "phone": r"(?<![\w+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|[2-9]\d\d[ .-])\d{3}[ .-]\d{4}(?=x\d|(?!\w))",
    "ssn": r"(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)",
    "date": r"(?<![\w/.-])(?:\d{4}-\d\d-\d\d(?=T\d\d|(?![\w/-]))|(?:\d{4}/\d\d/\d\d|\d\d/\d\d/\d{4}|\d\d\.\d\d\.\d{4}|\d\d-\d\d-\d{4})(?![\w/-]))",
    "email": r"(?<![\w.+-])[A-Za-z0-9](?:[\w.+-]*[A-Za-z0-9])?@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}",
    "access_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "secret": r"(?i:password|passwd|pwd|secret|token|api[_-]?key)\s*[:=]\s*(?:(?P<quote>[\"'])(?P<quoted>[^\"'\n]{6,})(?P=quote)|[\"']?(?P<value>[A-Za-z0-9_+/.@!#$%^&*~-]{6,}))",
}
PATTERN = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in PATTERNS.items()))
SINGLE = {kind: re.compile(pattern) for kind, pattern in PATTERNS.items()}
#: A card number in any groups; tried where nothing of a customary form is found.
LOOSE = re.compile(r"(?<![\w.-])\d(?:(?: {2}|[ -])?\d){12,18}" + CARD_END)
END = re.compile(CARD_END)
#: A text without any of these holds no value of any kind.
HINT = re.compile(r"[0-9@]|(?i:passw|pwd|secret|token|api.?key)|A[KS]IA")


class Feistel:
    """Keyed permutations of 0 .. size - 1."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key).digest()

    def permute(self, value: int, size: int, tweak: str, valid: Callable[[int], bool] = lambda _: True) -> int:
        """The image of a valid ``value`` among the valid numbers below ``size``."""
        a = max(2, math.isqrt(max(size - 1, 1)) + 1)
        while True:
            value = self.rounds(value, a, tweak)
            if value < size and valid(value):
                return value

    def rounds(self, value: int, a: int, tweak: str) -> int:
        left, right = divmod(value, a)
        for r in range(ROUNDS):
            left, right = right, (left + self.mixed(r, right, a, tweak)) % a
        return left * a + right

    def mixed(self, r: int, half: int, a: int, tweak: str) -> int:
        message = f"{tweak}|{r}|{a}|{half}".encode()
        n = (a.bit_length() + 7) // 8 + 8
        if n <= 64:
            return int.from_bytes(hashlib.blake2b(message, key=self.key, digest_size=n).digest()) % a
        return int.from_bytes(hashlib.shake_256(self.key + message).digest(n)) % a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def luhn_digit(payload: str) -> str:
    return next(c for c in DIGITS if luhn(payload + c))


def iban_number(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4]))


def symbols(feistel: Feistel, value: str, tweak: str, alphabets: Callable[[str], str] | None = None) -> str:
    """Permute letters and digits within their classes; other symbols stay."""
    def own(c: str) -> str:
        return next((a for a in (DIGITS, LOWER, UPPER) if c in a), "")

    of = [(alphabets or own)(c) for c in value]
    size = math.prod(len(a) for a in of if a)
    if size < 2:
        return value
    number = 0
    for c, a in zip(value, of, strict=True):
        if a:
            number = number * len(a) + a.index(c)
    number = feistel.permute(number, size, tweak)
    out = []
    for c, a in zip(reversed(value), reversed(of), strict=True):
        if a:
            number, at = divmod(number, len(a))
            c = a[at]
        out.append(c)
    return "".join(reversed(out))


def refill(shape: str, fill: str) -> str:
    """``shape`` with its letters and digits replaced, in order, by ``fill``."""
    it = iter(fill)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def card(f: Feistel, s: str) -> str | None:
    digits = re.sub(r"\D", "", s)
    if not luhn(digits) or len(set(digits)) == 1:
        return None
    n = len(digits) - 2
    middle = f.permute(int(digits[1:-1]), 10**n, f"card{len(digits)}{digits[0]}")
    payload = digits[0] + str(middle).zfill(n)
    return refill(s, payload + luhn_digit(payload))


def iban(f: Feistel, s: str) -> str | None:
    flat = s.replace(" ", "")
    if not 15 <= len(flat) <= 34 or iban_number(flat) % 97 != 1:
        return None
    body = symbols(f, flat[4:], f"iban{flat[:2]}")
    return refill(s, f"{flat[:2]}{98 - iban_number(flat[:2] + '00' + body) % 97:02d}{body}")


def phone(f: Feistel, s: str) -> str | None:
    digits = re.sub(r"\D", "", s)
    front, number = digits[:-10], digits[-10:]

    def assigned(v: int) -> bool:  # area and exchange codes start with 2 to 9
        return v >= 2 * 10**9 and v // 10**6 % 10 >= 2

    # Numbers that could be assigned stay so; made-up ones stay made up.
    new = f.permute(int(number), 10**10, "phone", lambda v: assigned(v) == assigned(int(number)))
    return refill(s, front + str(new).zfill(10))


def ssn(f: Feistel, s: str) -> str | None:
    def valid(v: int) -> bool:
        area = v // 10**6
        return 0 < area < 900 and area != 666 and v // 10**4 % 100 > 0 and v % 10**4 > 0

    v = int(s.replace("-", ""))
    return refill(s, str(f.permute(v, 10**9, "ssn", valid)).zfill(9)) if valid(v) else None


def ip(f: Feistel, s: str) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    v = int.from_bytes(bytes(map(int, parts)))
    return ".".join(map(str, f.permute(v, 2**32, "ip").to_bytes(4)))


FIRST, LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def date(f: Feistel, s: str) -> str | None:
    mark = next(c for c in s if not c.isdigit())
    month_first = False
    form = f"%Y{mark}%m{mark}%d" if s[4] == mark else f"%d{mark}%m{mark}%Y"

    def read(form: str) -> int | None:
        try:
            return datetime.datetime.strptime(s, form).date().toordinal()
        except ValueError:
            return None

    day = read(form)
    if day is None and mark == "/" and s[2] == mark:  # 03/25/1990 has its month first; it becomes a date that has so, too
        form, month_first = "%m/%d/%Y", True
        day = read(form)
    if day is None or not FIRST <= day <= LAST:
        return None

    def valid(v: int) -> bool:
        return not month_first or datetime.date.fromordinal(FIRST + v).day > 12

    return datetime.date.fromordinal(FIRST + f.permute(day - FIRST, LAST - FIRST + 1, "month first" if month_first else "date", valid)).strftime(form)


def email(f: Feistel, s: str) -> str | None:
    local, _, domain = s.rpartition("@")
    name, dot, top = domain.rpartition(".")
    return f"{symbols(f, local, 'local')}@{symbols(f, name, 'domain')}{dot}{top}"


def access_key(f: Feistel, s: str) -> str | None:
    return s[:4] + symbols(f, s[4:], "access", lambda _: UPPER + DIGITS)


#: Labels after which even a plain word is a secret, unless prose says it of passwords.
PASSWORD = re.compile(r"(?i)passw|pwd")
PROSE = frozenset("required optional protected incorrect invalid expired changed reset needed missing forgotten hidden unknown default policy manager recovery generator strength rotation".split())


EMAIL = SINGLE["email"]


def is_prose(text: str, label: int, start: int, end: int) -> bool:
    """Whether the value after a label is a word of prose, as in "password: required", or the start of an address."""
    if EMAIL.fullmatch(text, start, end):
        return True
    word = text[start:end].rstrip("._/-!")
    if not (word.isalpha() and (word.islower() or word.istitle())):
        return False
    return not PASSWORD.match(text, label) or word.lower() in PROSE or text[end : end + 1] == "@"


def secret(f: Feistel, s: str) -> str | None:
    return symbols(f, s, "secret", (lambda _: HEX) if set(s) <= set(HEX) else None)


RULES = {"card": card, "iban": iban, "phone": phone, "ssn": ssn, "ip": ip, "date": date, "email": email, "access_key": access_key, "secret": secret}


def shorter(text: str, start: int, end: int) -> list[int]:
    """The end of a match and, longest first, the group ends within it."""
    return [end, *(e for e in range(end - 1, start, -1) if text[e] in " -" and END.match(text, e))]


def customary(text: str, feistel: Feistel) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of the values in a form of their kind, in order."""
    found, at = [], 0
    while m := PATTERN.search(text, at):
        s, at = m.start(), m.start() + 1
        # Kinds before the matched one have no candidate here.
        for kind in list(PATTERNS)[list(PATTERNS).index(m.lastgroup) :]:
            first = SINGLE[kind].match(text, s)
            part = "quoted" if kind == "secret" and first and first["quoted"] else "value"
            ends = [] if first is None else shorter(text, s, first.end()) if kind in ("iban", "card") else [first.end(part) if kind == "secret" else first.end()]
            for e in ends:
                if kind != "secret" and e < first.end() and not SINGLE[kind].fullmatch(text, s, e):
                    continue
                begin = first.start(part) if kind == "secret" else s
                new = None if kind == "secret" and is_prose(text, s, begin, e) else RULES[kind](feistel, text[begin:e])
                if new is not None:
                    found.append((begin, e, kind, new))
                    at = e
                    break
            if at > s + 1:
                break
    return found


def loose(text: str, feistel: Feistel, start: int, stop: int) -> list[tuple[int, int, str, str]]:
    """The same for card numbers in other groups between two places.

    Shorter readings and later starts within a failed one are tried only for
    groups of three digits or more; of a row of smaller numbers, some reading
    would nearly always pass the check digit.
    """
    found, at, barred = [], start, start
    while m := LOOSE.search(text, at, stop):
        s, at = m.start(), m.start() + 1
        for e in shorter(text, s, m.end()):
            number = text[s:e]
            n = sum(map(str.isdigit, number))
            if n < 13 or not END.match(text, e):
                continue
            whole = e == m.end() and s >= barred
            new = card(feistel, number) if whole or min(map(len, re.split("[ -]+", number))) >= 3 else None
            if new is not None:
                found.append((s, e, "card", new))
                at = e
                break
        barred = max(barred, m.end())
    return found


def pseudonymise(text: str | None, feistel: Feistel) -> tuple[str | None, Counter]:
    """The text with pseudonyms, and how many values of each kind were replaced."""
    counts: Counter = Counter()
    if not text or not HINT.search(text):
        return text, counts
    found = customary(text, feistel)
    if LOOSE.search(text):
        edges = [0, *(e for f in found for e in f[:2]), len(text)]
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            found += loose(text, feistel, a, b)
        found.sort()
    out, at = [], 0
    for s, e, kind, new in found:
        counts[kind] += 1
        out += [text[at:s], new]
        at = e
    return "".join([*out, text[at:]]), counts


def protect(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and a count column n_<kind> for each kind."""
    kept = [c for c in docs.columns if not (c.startswith("n_") and c[2:] in KINDS)]

    def run(batches):
        feistel = Feistel(key)
        for batch in batches:
            if batch.num_rows:
                found = [pseudonymise(t, feistel) for t in batch.column(text).to_pylist()]
                columns = [pa.array([t for t, _ in found], pa.string()) if c == text else batch.column(c) for c in kept]
                counts = [pa.array([c[k] for _, c in found], pa.int32()) for k in KINDS]
                yield pa.RecordBatch.from_arrays([*columns, *counts], names=[*kept, *(f"n_{k}" for k in KINDS)])

    shape = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema]
    return docs.select(*kept).mapInArrow(run, ", ".join(shape + [f"n_{k} int" for k in KINDS]))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return protect(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms in their texts and n_chars brought up to date."""
    safe = protect(docs, DEMO_KEY).select(*docs.columns)
    return safe.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else safe
