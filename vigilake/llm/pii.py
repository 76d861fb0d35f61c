"""Format-preserving pseudonyms for personal data.

Validated values are permuted within their format by a keyed Feistel network: a card number that passes its check digit
becomes another that passes, a date another date, an address another address. The permutation depends on the key and
the kind alone, and works on the value, not on how it is written: equal values get equal pseudonyms in all documents,
written each as it was found, and the holder of the key can undo them.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import ipaddress
import re
from bisect import bisect_left
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: The days that dates are permuted within.
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1), dt.date(2099, 12, 31)
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


class Feistel:
    """Keyed permutations of range(n), one for each label."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, label: str, k: int, half: int) -> int:
        made = hashlib.blake2b(f"{label}|{k}|{half}".encode(), key=self.key, digest_size=24)
        return int.from_bytes(made.digest(), "big")

    def permute(self, x: int, n: int, label: str, undo: bool = False) -> int:
        """x's image in range(n): alternating modular additions over two halves, walked on until it is in range."""
        if n < 2:
            return x
        a = 1
        while a * a < n:
            a += 1 if a < 64 else max(1, (n - a * a) // (2 * a + 1))
        b = -(-n // a)
        label = f"{label}|{n}"
        while True:
            left, right = divmod(x, b)  # left < a, right < b
            for k in reversed(range(ROUNDS)) if undo else range(ROUNDS):
                sign = -1 if undo else 1
                if k % 2:
                    right = (right + sign * self._round(label, k, left)) % b
                else:
                    left = (left + sign * self._round(label, k, right)) % a
            x = left * b + right
            if x < n:
                return x

    def symbols(self, text: str, label: str, undo: bool = False) -> str:
        """`text` with its digits, small and large letters permuted together, each within its own alphabet."""
        x, n, bases = 0, 1, []
        for c in text:
            for alphabet in (DIGITS, LOWER, UPPER):
                if c in alphabet:
                    x, n = x * len(alphabet) + alphabet.index(c), n * len(alphabet)
                    bases.append(alphabet)
                    break
            else:
                bases.append("")
        x = self.permute(x, n, label, undo)
        out = []
        for c, alphabet in zip(reversed(text), reversed(bases), strict=True):
            if alphabet:
                x, k = divmod(x, len(alphabet))
                c = alphabet[k]
            out.append(c)
        return "".join(reversed(out))


def luhn_ok(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    turned = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _onto(template: str, symbols: str) -> str:
    """`template` with its letters and digits replaced, in order, by `symbols`."""
    it = iter(symbols)
    return "".join(next(it) if c.isalnum() else c for c in template)


def _card(f: Feistel, s: str, undo: bool) -> str | None:
    digits = re.sub(r"\D", "", s)
    if not luhn_ok(digits) or len(set(digits)) == 1:
        return None
    body = f.symbols(digits[:-1], "card", undo)
    return _onto(s, body + next(c for c in DIGITS if luhn_ok(body + c)))


def _iban(f: Feistel, s: str, undo: bool) -> str | None:
    """In capitals, or in small letters with ten digits or more; both are one number."""
    plain = s.replace(" ", "")
    small = plain.islower()
    if not (small or plain.isupper()) or (small and sum(c in DIGITS for c in plain) < 10) or not iban_ok(plain.upper()):
        return None
    plain = plain.upper()
    body = f.symbols(plain[4:], f"iban|{plain[:2]}", undo)
    check = next(k for k in range(2, 99) if iban_ok(f"{plain[:2]}{k:02d}{body}"))
    made = _onto(s, f"{plain[:2]}{check:02d}{body}")
    return made.lower() if small else made


# Country calling codes of one and two digits; all others have three.
_CODES = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
)


def _phone(f: Feistel, s: str, undo: bool) -> str | None:
    """What follows the country code is permuted; numbers of ten digits without a code are taken for code 1's."""
    digits = re.sub(r"\D", "", s)
    if not s.startswith("+"):
        return _onto(s, f.symbols(digits, "phone|1", undo)) if len(digits) == 10 else None
    if not 8 <= len(digits) <= 15:
        return None
    code = next((digits[:k] for k in (1, 2) if digits[:k] in _CODES), digits[:3])
    return _onto(s, code + f.symbols(digits[len(code) :], f"phone|{code}", undo))


def _ssn(f: Feistel, s: str, undo: bool) -> str | None:
    good = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    digits = s.replace("-", "")
    if not good(digits):
        return None
    digits = f.symbols(digits, "ssn", undo)
    while not good(digits):
        digits = f.symbols(digits, "ssn", undo)
    return _onto(s, digits)


def _ip(f: Feistel, s: str, undo: bool) -> str | None:
    parts = [int(p) for p in s.split(".")]
    if max(parts) > 255:
        return None
    x = f.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip", undo)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _ip6(f: Feistel, s: str, undo: bool) -> str | None:
    """Written in its shortest form."""
    try:
        value = int(ipaddress.IPv6Address(s))
    except ValueError:
        return None
    if not any(c in DIGITS for c in s) or sum(map(bool, s.split(":"))) < 2:
        return None
    return ipaddress.IPv6Address(f.permute(value, 1 << 128, "ip6", undo)).compressed


def _mac(f: Feistel, s: str, undo: bool) -> str | None:
    """Capitals or small letters; an address with letters keeps some, so that its case is known."""
    plain = re.sub(r"[:-]", "", s)
    letters, upper = bool(re.search("[A-Fa-f]", plain)), not re.search("[a-f]", plain)
    if letters and not (plain.islower() or plain.isupper()):
        return None
    x = int(plain, 16)
    while True:
        x = f.permute(x, 1 << 48, "mac", undo)
        if bool(re.search("[a-f]", f"{x:012x}")) == letters:
            return _onto(s, f"{x:012{'X' if upper else 'x'}}")


def _day(f: Feistel, day: dt.date, undo: bool) -> dt.date | None:
    """Another day of the range. Days whose number could be a month's are permuted among themselves, and so are those with
    a number of one digit: each form then reads its pseudonym the same way as the date, and a date has one in all forms."""
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    kind = lambda d: (d.day <= 12, d.day < 10 or d.month < 10)
    new = day
    while True:
        at = f.permute((new - FIRST_DAY).days, (LAST_DAY - FIRST_DAY).days + 1, "date", undo)
        new = FIRST_DAY + dt.timedelta(at)
        if kind(new) == kind(day):
            return new


def _date(f: Feistel, s: str, undo: bool) -> str | None:
    """Year first, else day first, else month first; what doesn't make a day of the range is no date. Where a number has
    one digit, none is filled up."""
    marks, parts = re.findall(r"[-/.]", s), re.split(r"[-/.]", s)
    width = "d" if any(len(x) == 1 for x in parts) else "02d"
    for order in ((0, 1, 2),) if len(parts[0]) == 4 else ((2, 1, 0), (2, 0, 1)):
        try:
            day = dt.date(*(int(parts[k]) for k in order))
        except ValueError:
            continue
        if width == "d" and any(len(x) != len(str(int(x))) for x in parts):
            return None  # one filled up and one not
        new = _day(f, day, undo)
        if new is None:
            continue
        out = ["", "", ""]
        out[order[0]], out[order[1]], out[order[2]] = f"{new.year:04d}", f"{new.month:{width}}", f"{new.day:{width}}"
        return out[0] + marks[0] + out[1] + marks[1] + out[2]
    return None


# The months' names in the four languages of dates that are written out.
_MONTHS = {
    "en": "January February March April May June July August September October November December".split(),
    "de": "Januar Februar März April Mai Juni Juli August September Oktober November Dezember".split(),
    "fr": "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split(),
    "es": "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
}
_NAMES = {k: "|".join(v) for k, v in _MONTHS.items()}
_WRITTEN = {
    "de": rf"(?P<day>\d{{1,2}})\. (?P<month>{_NAMES['de']}) (?P<year>\d{{4}})", "es": rf"(?P<day>\d{{1,2}}) de (?P<month>{_NAMES['es']}) de (?P<year>\d{{4}})",
    "fr": rf"(?P<day>\d{{1,2}}) (?P<month>{_NAMES['fr']}) (?P<year>\d{{4}})", "en": rf"(?P<day>\d{{1,2}}) (?P<month>{_NAMES['en']}) (?P<year>\d{{4}})",
    "us": rf"(?P<month>{_NAMES['en']}) (?P<day>\d{{1,2}}), (?P<year>\d{{4}})",
}


def _written(f: Feistel, s: str, undo: bool) -> str | None:
    """A date with its month's name, in the same language and order; the day isn't filled up."""
    for form, pattern in _WRITTEN.items():
        if m := re.fullmatch(pattern, s):
            names = _MONTHS["en" if form == "us" else form]
            try:
                day = dt.date(int(m["year"]), names.index(m["month"]) + 1, int(m["day"]))
            except ValueError:
                return None
            new = None if m["day"][0] == "0" else _day(f, day, undo)
            if new is None:
                return None
            values = {"day": str(new.day), "month": names[new.month - 1], "year": str(new.year)}
            for name in sorted(values, key=m.start, reverse=True):
                s = s[: m.start(name)] + values[name] + s[m.end(name) :]
            return s
    return None


def _email(f: Feistel, s: str, undo: bool) -> str | None:
    local, _, domain = s.partition("@")
    return f"{f.symbols(local, f'email|{domain.lower()}', undo)}@{domain}"


def _hex(s: str) -> str | None:
    """The hex alphabet that a text is wholly written in, if it has a letter of it."""
    for letters in ("abcdef", "ABCDEF"):
        if set(s) <= set(DIGITS + letters) and not set(s) <= set(DIGITS):
            return letters
    return None


def _value(f: Feistel, s: str, undo: bool) -> str:
    """A password or token: hex digits stay hex digits of their case, others stay digits and letters of theirs."""
    letters = _hex(s)
    if letters is None:
        while True:
            s = f.symbols(s, "value", undo)
            if _hex(s) is None:
                return s
    digits = any(c in DIGITS for c in s)
    while True:
        x = f.permute(int(s, 16), 16 ** len(s), "hex", undo)
        s = f"{x:0{len(s)}x}"
        if _hex(s) and any(c in DIGITS for c in s) == digits:
            return s.upper() if letters == "ABCDEF" else s


def _key(f: Feistel, s: str, undo: bool) -> str | None:
    """Keys that begin with their issuer's mark, which stays."""
    mark = _MARK.match(s)[0]
    return mark + f.symbols(s[len(mark) :], f"key|{mark}", undo)


def _credential(f: Feistel, s: str, undo: bool) -> str | None:
    """The name and sign stay; the value is a secret by where it stands. After a colon a bare word may be prose, so there
    it needs a digit or a mark, or to be quoted."""
    start = _NAMED.match(s).end()
    if ":" in s[:start] and s[start - 1] not in "\"'" and s[start:].rstrip(".!?:)").isalpha():
        return None
    return s[:start] + _value(f, s[start:], undo)


def _pieces(f: Feistel, s: str, label: str, undo: bool, size: int = 60) -> str:
    """A long text's symbols, permuted in pieces by their place."""
    return "".join(f.symbols(s[k : k + size], f"{label}|{k}", undo) for k in range(0, len(s), size))


def _jwt(f: Feistel, s: str, undo: bool) -> str | None:
    """Three parts, of which the first two keep the mark that they begin with."""
    head, body, sign = s.split(".")
    return f"eyJ{_pieces(f, head[3:], 'jwt0', undo)}.eyJ{_pieces(f, body[3:], 'jwt1', undo)}.{_pieces(f, sign, 'jwt2', undo)}"


def _block(f: Feistel, s: str, undo: bool) -> str | None:
    """A private key between its two lines."""
    first, last = s.index("KEY-----") + 8, s.rindex("-----END")
    return s[:first] + _pieces(f, s[first:last], "block", undo) + s[last:]


# Marks of issued keys, and names that a secret value follows.
_MARK = re.compile(r"sk-(?:proj-|svcacct-|admin-)?(?=[0-9A-Za-z_-]{20})|AKIA|ASIA|sk_(?:live|test)_|rk_live_|gh[pousr]_|github_pat_|glpat-|xox[abps]-|AIza")
_NAMED = re.compile(
    r"(?i)(?:password|passwd|pwd|passphrase|secret|token|api[_ -]?key|access[_ -]?key|auth[_ -]?key|client[_ -]?secret)[\"']?\s{0,3}(?:=|:)\s{0,3}[\"']?"
)


class Kind(NamedTuple):
    name: str
    pattern: str
    #: A text without this has none of the kind.
    needs: str
    permute: Callable[[Feistel, str, bool], str | None]


#: Kinds in order of precedence; a value is tried by every kind whose pattern fits it until one finds it valid.
KINDS = (
    Kind("secret", r"-----BEGIN (?:[A-Z]{2,12} ){0,2}PRIVATE KEY-----[A-Za-z0-9+/=\s]{1,20000}-----END (?:[A-Z]{2,12} ){0,2}PRIVATE KEY-----", "PRIVATE KEY", _block),
    Kind("secret", r"(?<![\w.-])eyJ[A-Za-z0-9_-]{8,4000}\.eyJ[A-Za-z0-9_-]{8,8000}\.[A-Za-z0-9_-]{8,2000}(?![\w-])", "eyJ", _jwt),
    Kind("email", r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}", "@", _email),
    Kind("iban", r"(?<!\w)[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)", r"\d\d", _iban),
    Kind("iban", r"(?<!\w)[a-z]{2}\d\d(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?(?!\w)", r"[a-z]\d\d", _iban),
    Kind("mac", r"(?<![\w:-])[0-9A-Fa-f]{2}([:-])[0-9A-Fa-f]{2}(?:\1[0-9A-Fa-f]{2}){4}(?![\w:-])", r"[0-9A-Fa-f]{2}[:-][0-9A-Fa-f]{2}[:-]", _mac),
    Kind("secret", rf"(?<!\w)(?:{_MARK.pattern})[0-9A-Za-z_-]{{10,200}}(?!\w)", r"A[KS]IA|[srgx][khiol][_xtpousra-]|AIza", _key),
    Kind("secret", rf"(?<![A-Za-z]){_NAMED.pattern.replace('(?i)', '(?i:', 1)})[^\s\"',;<>&]{{4,200}}", r"(?i)pass|pwd|secret|token|key", _credential),
    Kind("ip", r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:.])", r":[0-9A-Fa-f:]{0,5}:", _ip6),
    Kind("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", r"\d\.\d", _ip),
    Kind("date", r"(?<![\w/.-])(?:\d{4}([-/.])\d\d\1\d\d|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![\w/-]|\.\d)", r"\d[-/.]\d", _date),
    Kind("date", rf"(?<![\w.-])(?:{'|'.join(re.sub(r'[?]P<[a-z]+>', '?:', p) for p in _WRITTEN.values())})(?!\w)", rf"(?:{'|'.join(_NAMES.values())})", _written),
    Kind("ssn", r"(?<![\w-])\d{3}-\d\d-\d{4}(?![\w-])", r"\d-\d\d-\d", _ssn),
    Kind("card", r"(?<![\w+-])\d(?:[ -]?\d){12,18}(?![\w-])", r"\d", _card),
    Kind("phone", r"(?<![\w+])\+[1-9]\d{0,2}(?:[ .-]?(?:\(\d{1,4}\)|\d{1,5})){2,6}(?!\w)", r"\+\d", _phone),
    Kind("phone", r"(?<![\w+(])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\w)", r"\d[.-]\d", _phone),
    Kind("phone", r"(?<![\w+(.,-])(?<!\d )[2-9]\d\d \d{3} \d{4}(?!\w| \d)", r"\d \d{3} \d", _phone),
)


class Pseudonyms:
    """Replaces what the kinds find in texts; `undo` turns pseudonyms back."""

    def __init__(self, key: bytes, kinds: tuple[Kind, ...] = KINDS, undo: bool = False):
        self.feistel, self.undo = Feistel(key), undo
        self.kinds = [(k, re.compile(k.pattern), re.compile(k.needs)) for k in kinds]

    def __call__(self, text: str) -> tuple[str, list[str]]:
        """The text with pseudonyms, and the kinds replaced in text order."""
        spans: list[tuple[int, int, str, str]] = []  # sorted, and apart from one another
        for kind, pattern, needs in self.kinds:
            if not needs.search(text):
                continue
            starts, found = [s[0] for s in spans], []
            for m in pattern.finditer(text):
                k = bisect_left(starts, m.end())  # the spans before k start before the match ends
                if k and spans[k - 1][1] > m.start():
                    continue
                new = kind.permute(self.feistel, m[0], self.undo)
                if new is not None:
                    found.append((m.start(), m.end(), new, kind.name))
            if found:
                spans = sorted(spans + found)
        out, at = [], 0
        for a, b, new, _ in spans:
            out += [text[at:a], new]
            at = b
        return "".join([*out, text[at:]]), [s[3] for s in spans]


def pseudonymise(
    docs: DataFrame, key: str, kinds: tuple[Kind, ...] = KINDS, text_col: str = "text", undo: bool = False
) -> DataFrame:
    """`docs` with the values in the text replaced, and n_replaced and kinds (in text order) added; input columns of
    these names give way.

    Null texts stay null, empty ones empty, both with nothing replaced. Numbers that fail their check (card and IBAN
    digits, dates that no calendar has, IP numbers over 255) stay. Rows are treated one by one, so repeated rows come
    out alike; an empty table stays empty; very long texts are read whole, in time that grows with their length. A key
    is needed: an empty one is an error.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    secret = key.encode()

    @F.pandas_udf("struct<text: string, kinds: array<string>>")
    def replaced(column: pd.Series) -> pd.DataFrame:
        change = Pseudonyms(secret, kinds, undo)
        made = [(None, []) if t is None else change(t) for t in column]
        return pd.DataFrame({"text": [m[0] for m in made], "kinds": [m[1] for m in made]})

    names = [c for c in docs.columns if c.lower() not in ("n_replaced", "kinds")]
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    held = docs.select(row, replaced(F.col(f"`{text_col}`").cast("string")).alias("made"))
    columns = [F.col("made.text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in names]
    return held.select(*columns, F.size("made.kinds").cast("long").alias("n_replaced"), F.col("made.kinds").alias("kinds"))
