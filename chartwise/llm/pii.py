"""Personal data replaced by format-preserving pseudonyms.

Numbers and dates are found by their form, validated (Luhn, mod 97, octets, calendar ...), and permuted by a keyed
Feistel network on the numbers of their own format, so the pseudonym is valid too and keeps its
punctuation. The permutation depends on the key, the kind and the value alone: equal values stay linked across
documents, and different ones stay different. Where numbers stand next to each other, a form's shorter ends and the
other forms are tried at every token, and those values are taken that leave the fewest digits in clear.
"""

from __future__ import annotations

import bisect
import datetime
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from chartwise.llm.vocab import slices

ROUNDS = 8
KINDS = ("card", "iban", "phone", "ip", "ssn", "date", "secret", "email")

#: Days that dates are permuted among.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

EMAIL = re.compile(r"(?<![\w.+-])([A-Za-z0-9._+-]{1,64})(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})(?![\w-])")
#: The forms one by one: cards as they are printed (card1) and in any other grouping (card2); phones in groups (phone1), with
#: a plus and a country code (phone2), and ten digits with a leading 0 or an area code (phone3).
FORMS = {form: re.compile(pattern + "(?![0-9A-Za-z])") for form, pattern in {
    "secret": r"(?:(?=[0-9a-f]{0,63}[0-9])(?=[0-9a-f]{0,63}[a-f])[0-9a-f]{32,64}|(?=[0-9A-F]{0,63}[0-9])(?=[0-9A-F]{0,63}[A-F])[0-9A-F]{32,64}|AKIA[0-9A-Z]{16}|(?<=password=)[0-9a-f]{8,31})",
    "iban": r"(?:[A-Z]{2}[0-9]{2}(?:[ ]?[0-9A-Z]{4}){2,7}(?:[ ]?[0-9A-Z]{1,3})?|[a-z]{2}[0-9]{2}(?:[ ]?[0-9a-z]{4}){2,7}(?:[ ]?[0-9a-z]{1,3})?)",
    "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?!\.?[0-9])",
    "date": r"(?:[0-9]{4}(?P<d1>[-/.])[0-9]{1,2}(?P=d1)[0-9]{1,2}|[0-9]{1,2}(?P<d2>[-/.])[0-9]{1,2}(?P=d2)[0-9]{4})",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "card1": r"(?:[0-9]{13,19}|[0-9]{4}(?P<c1>[ -])[0-9]{4}(?P=c1)[0-9]{4}(?P=c1)[0-9]{4}(?:(?P=c1)[0-9]{3})?|[0-9]{4}(?P<c2>[ -])[0-9]{6}(?P=c2)[0-9]{4,5})",
    "phone1": r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
    "phone2": r"\+[0-9](?:[ .-]?\(?[0-9]\)?){7,14}",
    "phone3": r"(?:0[1-9](?P<p3>[ .-]?)[0-9]{2}(?P=p3)[0-9]{2}(?P=p3)[0-9]{2}(?P=p3)[0-9]{2}|[2-9][0-9]{9})",
    "card2": r"[0-9](?:[ -]?[0-9]){12,18}",
}.items()}
#: Where a number begins that has one of the forms; it is validated, and left alone if it isn't one.
NUMBER = re.compile(r"(?<![0-9A-Za-z])(?<![0-9]\.)(?:" + "|".join(re.sub(r"\?P<(\w+)>", rf"?P<{form}_\1>", re.sub(r"\(\?P=(\w+)\)", rf"(?P={form}_\1)", own.pattern)) for form, own in FORMS.items() if form != "phone2")
                    + ")|" + FORMS["phone2"].pattern)

# Country calling codes of one and two digits (all others have three), and how many digits follow where
# that is fixed.
SHORT_CODES = {"1", "7"}
TWO_DIGIT_CODES = {"20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58",
                   "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98"}
NATIONAL_DIGITS = {"1": 10, "7": 10, "31": 9, "33": 9, "34": 9, "41": 9, "44": 10, "48": 9, "61": 9, "86": 11, "91": 10, "351": 9}
#: Forms that may run on into the next number.
OPEN = {"iban", "card1", "card2", "phone2"}
#: Where values overlap, what a form counts for beside its letters and digits (100 each; 1 in card2, where one grouping in
#: ten holds by chance), and how the numbers of printed cards begin.
SURE = {"secret": 1000, "iban": 1000, "ip": 50, "date": 50, "ssn": 50}
ISSUER = re.compile(r"3[0-9]|4|5[0-8]|6|222[1-9]|22[3-9]|2[3-6]|27[01]|2720")


def country_code(digits: str) -> str:
    return next((digits[:n] for n, codes in ((1, SHORT_CODES), (2, TWO_DIGIT_CODES)) if digits[:n] in codes), digits[:3])


def phone_start(digits: str) -> str:
    """How a number begins (a trunk 0, a 1, another digit), which its pseudonym keeps."""
    return digits[0] if digits[0] in "01" and digits[1] != "0" else digits[:2] if digits[0] in "01" else ""


def ends(form: str, text: str, at: int) -> list[int]:
    """Where values of a form that begin at ``at`` can end, the longest first; a phone of a country whose numbers have a
    fixed length ends there if it can."""
    m = FORMS[form].match(text, at)
    if m is None:
        return []
    out = [m.end()]
    if form in OPEN:
        out += [e for e in range(m.end() - 1, at, -1) if text[e - 1].isalnum() and not text[e].isalnum() and FORMS[form].fullmatch(text, at, e)]
    if form == "phone2":
        code = country_code(re.sub(r"\D", "", m[0]))
        if code in NATIONAL_DIGITS:
            fits = len(code) + NATIONAL_DIGITS[code]
            return [e for e in out if sum(map(str.isdigit, text[at:e])) == fits] or out
    return out


def plausible(text: str, at: int, end: int, longest: bool) -> bool:
    """Whether digits in an unusual grouping may be a card: a whole run of numbers, or up to six groups of which the
    first has four digits or more. Otherwise one in ten of all pieces of any table of numbers would be a card."""
    if longest and not re.search(r"[0-9][ -]$", text[max(0, at - 2):at]):
        return True
    groups = re.split("[ -]", text[at:end])
    return len(groups) <= 6 and len(groups[0]) >= 4


def luhn(digits: str) -> int:
    """The check digit of ``digits``."""
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return -total % 10


def iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


class Pseudonyms:
    def __init__(self, key: bytes):
        self.key = key

    def permute(self, kind: str, x: int, n: int, valid: Callable[[int], bool] = lambda _: True) -> int:
        """A keyed permutation of the numbers below ``n`` that are valid: Feistel, walked until it lands on one."""
        side = math.isqrt(n - 1) + 1
        person = kind.encode()[:16]
        while True:
            left, right = divmod(x, side)
            for turn in range(ROUNDS):
                data = b"%d|%d|%d" % (turn, n, right)
                left, right = right, (left + int.from_bytes(hashlib.blake2b(data, key=self.key, person=person, digest_size=16 + side.bit_length() // 8).digest(), "big")) % side
            x = left * side + right
            if x < n and valid(x):
                return x

    def digits(self, kind: str, text: str, valid: Callable[[str], bool] = lambda _: True) -> str:
        k = len(text)
        return f"{self.permute(kind, int(text), 10 ** k, lambda y: valid(f'{y:0{k}d}')):0{k}d}"

    def letters(self, kind: str, text: str) -> str:
        """Each character stays in its own class (digits, small or capital letters); others stay as they are."""
        sets = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
        own = [next((s for s in sets if c in s), "") for c in text]
        x, n = 0, 1
        for c, s in zip(text, own, strict=True):
            if s:
                x, n = x * len(s) + s.index(c), n * len(s)
        if n == 1:
            return text
        pattern = "".join(s[0] if s else c for c, s in zip(text, own, strict=True))
        x, out = self.permute(f"{kind}{hashlib.blake2b(pattern.encode(), digest_size=4).hexdigest()}", x, n), []
        for c, s in zip(reversed(text), reversed(own), strict=True):
            if s:
                x, i = divmod(x, len(s))
                c = s[i]
            out.append(c)
        return "".join(reversed(out))

    def card(self, text: str) -> str | None:
        digits = re.sub(r"\D", "", text)
        if luhn(digits[:-1]) != int(digits[-1]) or len(set(digits)) == 1:
            return None
        payload = self.digits("card", digits[:-1])
        return refill(text, payload + str(luhn(payload)))

    def iban(self, text: str) -> str | None:
        plain = text.replace(" ", "").upper()  # capital and small spellings are one value
        if not 15 <= len(plain) <= 34 or iban_check(plain[:2], plain[4:]) != plain[2:4]:
            return None
        rest = self.letters("iban", plain[4:])
        new = plain[:2] + iban_check(plain[:2], rest) + rest
        return refill(text, new.lower() if text[0].islower() else new, r"[0-9A-Za-z]")

    def ip(self, text: str) -> str | None:
        parts = [int(p) for p in text.split(".")]
        if any(p > 255 for p in parts):
            return None
        x = self.permute("ip", int.from_bytes(bytes(parts), "big"), 1 << 32)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def ssn(self, text: str) -> str | None:
        def valid(d: str) -> bool:
            return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
        digits = text.replace("-", "")
        return refill(text, self.digits("ssn", digits, valid)) if valid(digits) else None

    def phone(self, text: str) -> str | None:
        """The digits after the country code are permuted by their number alone, so all groupings of a number, and a number
        with and without the code, stay linked; a 0 in front (instead of a code) belongs to the digits."""
        every = re.sub(r"\D", "", text)
        code = country_code(every) if text[0] == "+" else ""
        digits = every[len(code):]
        if not 7 <= len(digits) <= 14 or len(set(digits)) == 1:
            return None
        return refill(text, code + self.digits("phone", digits, lambda new: phone_start(new) == phone_start(digits)))

    def date(self, text: str) -> str | None:
        """A day becomes another day, whatever the order in which its parts are written; days after the 12th stay such
        days, so that a date is read the same way afterwards."""
        mark = re.search(r"\D", text).group()
        parts = text.split(mark)
        numbers = [int(p) for p in parts]
        orders = [(0, 1, 2)] if len(parts[0]) == 4 else [(2, 1, 0), (2, 0, 1)]  # day first, else month first
        for order in orders:
            try:
                old = datetime.date(*[numbers[i] for i in order])
            except ValueError:
                continue
            if not FIRST_DAY <= old.toordinal() <= LAST_DAY:
                return None
            new = datetime.date.fromordinal(FIRST_DAY + self.permute("date", old.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1,
                                                                     lambda x: (datetime.date.fromordinal(x + FIRST_DAY).day > 12) == (old.day > 12)))
            values = {order[0]: new.year, order[1]: new.month, order[2]: new.day}
            return mark.join(f"{values[i]:0{4 if i == order[0] else 2}d}" for i in range(3))
        return None

    def secret(self, text: str) -> str:
        """Long hexadecimal tokens, access key names (their prefix stays), hexadecimal passwords."""
        if text.startswith("AKIA"):
            return text[:4] + self.letters("secret", text[4:])
        new = f"{self.permute('secret', int(text, 16), 16 ** len(text)):0{len(text)}x}"
        return new.upper() if re.fullmatch("[0-9A-F]+", text) else new

    def values(self, text: str, at: int) -> Iterator[tuple[int, int, int, str, str]]:
        """(start, end, weight, form, pseudonym) of what validates at ``at``."""
        for form in FORMS:
            if at and text[at - 1] == "+":  # the digits after a plus are a phone's
                continue
            for i, end in enumerate(ends(form, text, at)):
                if form == "card2" and not plausible(text, at, end, i == 0):
                    continue
                own = text[at:end]
                new = getattr(self, form.rstrip("123"))(own)
                if new is not None:
                    joined = re.search(r"[0-9][-/.]$", text[max(0, at - 2):at])
                    sure = 50 * bool(ISSUER.match(own) and not joined) if form == "card1" else SURE.get(form, 0)
                    yield at, end, sum(map(str.isalnum, own)) * (1 if form == "card2" else 100) + sure, form, new

    def text(self, text: str) -> tuple[str, dict[str, int]]:
        found = dict.fromkeys(KINDS, 0)

        def email(m: re.Match) -> str:
            found["email"] += 1
            return self.letters("email", m[1]) + m[2]

        if "@" in text:
            text = EMAIL.sub(email, text)
        out, at, done = [], 0, 0
        near: list[tuple[int, int, int, str, str]] = []  # values that overlap, in a chain
        reach = 0
        while True:
            m = NUMBER.search(text, at)
            if near and (m is None or m.start() >= reach):
                for start, end, _, form, new in heaviest(near):
                    out += [text[done:start], new]
                    done = end
                    found[form.rstrip("123")] += 1
                near, reach = [], 0
            if m is None:
                return "".join(out) + text[done:], found
            for value in self.values(text, m.start()):
                near.append(value)
                reach = max(reach, value[1])
            at = m.start() + 1  # the next token may begin one as well


def heaviest(near: list[tuple[int, int, int, str, str]]) -> list[tuple[int, int, int, str, str]]:
    """Those of ``near`` (by start) that don't overlap and weigh the most together; on ties the first."""
    starts = [v[0] for v in near]
    after = [bisect.bisect_left(starts, v[1]) for v in near]
    best = [0] * (len(near) + 1)
    for i in range(len(near) - 1, -1, -1):
        best[i] = max(best[i + 1], near[i][2] + best[after[i]])
    out, i = [], 0
    while i < len(near):
        if near[i][2] + best[after[i]] == best[i]:
            out.append(near[i])
            i = after[i]
        else:
            i += 1
    return out


def refill(form: str, values: str, place: str = r"[0-9]") -> str:
    """``form`` with its places taken by ``values`` one by one."""
    each = iter(values)
    return re.sub(place, lambda _: next(each), form)


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, text with pseudonyms, and ``n_<kind>`` for each of KINDS.

    Whole texts are searched, very long ones too. Equal values get one pseudonym whatever their punctuation, grouping,
    case and the order of a date's parts; only a phone with a leading 0 isn't linked to the number with its country code,
    which the text doesn't tell. What doesn't validate stays as it is. A null text stays null with counts of 0; ids
    (null and repeated ones too) are carried along; an empty table gives an empty one; other columns aren't read.
    """
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        none = dict.fromkeys(KINDS, 0)
        for batch in slices(batches):
            some = pc.fill_null(pc.match_substring_regex(batch.column("text"), r"[0-9@]"), False).to_pylist()
            pairs = [names.text(t) if s else (t, none) for t, s in zip(batch.column("text").to_pylist(), some, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t for t, _ in pairs], pa.string()), *[pa.array([n[k] for _, n in pairs], pa.int64()) for k in KINDS]],
                                             names=["doc_id", "text", *[f"n_{k}" for k in KINDS]])

    own = docs.selectExpr(f"CAST(`{id_col}` AS long) AS doc_id", f"CAST(`{text_col}` AS string) AS text")
    return own.mapInArrow(each, "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in KINDS))
