"""Personal data: validated numbers, dates and addresses become pseudonyms of the same format.

Each value is a number within its format's domain, and a keyed Feistel network permutes that domain. Equal values get equal
pseudonyms in all documents, different values different ones, and who holds the key can turn them back. Check digits are
made anew, so a pseudonym passes the checks that its value passed.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiscore.llm.words import bound_batches

ROUNDS = 8
KINDS = ("email", "iban", "card", "phone", "ip", "ssn", "date")

PATTERN = re.compile(
    r"""
    (?P<email>(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-]))
  | (?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9]))
  | (?P<ip>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))
  | (?P<ssn>(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9]))
  | (?P<iso>(?<![0-9-])[0-9]{4}(?P<a>[-/])[0-9]{2}(?P=a)[0-9]{2}(?![0-9]|[-/][0-9]))
  | (?P<dmy>(?<![0-9./-])[0-9]{1,2}(?P<b>[-/.])[0-9]{1,2}(?P=b)[0-9]{4}(?![0-9]|[-/.][0-9]))
  | (?P<card>(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?P<c>[\x20-])[0-9]{4}(?P=c)[0-9]{4}(?P=c)[0-9]{1,7}
        |[0-9]{4}(?P<d>[\x20-])[0-9]{6}(?P=d)[0-9]{5})(?![0-9]))
  | (?P<phone>(?<![0-9])(?:\+[0-9]{1,3}[\x20.-]?(?:\([0-9]{1,4}\)|[0-9])[0-9\x20.-]{4,14}[0-9]
        |\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}(?P<e>[\x20.-])[0-9]{3}(?P=e)[0-9]{4})(?![0-9]))
    """,
    re.VERBOSE,
)

# Public numbering plans: digits of a number after its country code, where that is fixed or nearly so.
NATIONAL_DIGITS = {
    "1": (10,), "7": (10,), "20": (9, 10), "27": (9,), "30": (10,), "31": (9,), "32": (8, 9), "33": (9,), "34": (9,), "36": (8, 9),
    "39": (9, 10), "40": (9,), "41": (9,), "44": (10,), "45": (8,), "46": (7, 8, 9), "47": (8,), "48": (9,), "49": (10, 11),
    "51": (9,), "52": (10,), "54": (10,), "55": (10, 11), "56": (9,), "57": (10,), "61": (9,), "63": (10,), "64": (8, 9), "65": (8,),
    "66": (9,), "81": (9, 10), "82": (9, 10), "84": (9,), "86": (11,), "90": (10,), "91": (10,), "92": (10,), "98": (10,),
    "212": (9,), "213": (9,), "216": (8,), "234": (10,), "254": (9,), "351": (9,), "353": (9,), "359": (8, 9), "380": (9,),
    "420": (9,), "421": (9,), "852": (8,), "886": (8, 9), "966": (9,), "971": (9,), "972": (8, 9),
}


def known_code(digits: str) -> str:
    """The country code that the digits begin with, of those in ``NATIONAL_DIGITS``; no code begins with another."""
    return next((digits[:n] for n in (1, 2, 3) if digits[:n] in NATIONAL_DIGITS), "")


def phone_parts(text: str) -> tuple[str, str]:
    """The part of a match that is one phone number, and its country code.

    A code is up to three digits before a separator, or else a known one that the digits begin with. A number of a known code
    ends where a group of digits ends and its plan is met, at the last such place, so that a number which follows is left
    alone; without such a place, or with an unknown code, the match is taken whole.
    """
    if not text.startswith("+"):
        return text, ""
    apart = re.match(r"\+(\d{1,3})(?=[ .(-])", text)
    code = apart[1] if apart else known_code(re.sub(r"\D", "", text))
    for end in reversed([m.end() for m in re.finditer(r"[0-9]+", text)]):
        if sum(c.isdigit() for c in text[:end]) - len(code) in NATIONAL_DIGITS.get(code, ()):
            return text[:end], code
    return text, code


# Days from 1900 to 2099 change places with one another, and so do all other days of the calendar's years 1 to 9999.
_FIRST_DAY = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _FIRST_DAY
_OTHER_DAYS = datetime.date.max.toordinal() - _DAYS

#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    country: int(length)
    for length, countries in (
        pair.split(":")
        for pair in (
            "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
            "23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM "
            "28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
        ).split()
    )
    for country in countries.split(",")
}


class Feistel:
    """A keyed permutation of 0 .. size - 1 for any size.

    Two halves of mixed radix a x b >= size take turns; a result outside the domain goes round again, which keeps the whole
    a permutation and ends after a few turns, as a x b is less than size + 2 sqrt(size) + 1.
    """

    def __init__(self, key: bytes, rounds: int = ROUNDS) -> None:
        self.key = hashlib.blake2b(key, digest_size=32).digest()
        self.rounds = rounds

    def _noise(self, tweak: str, turn: int, half: int, size: int) -> int:
        text = f"{tweak}|{size}|{turn}|{half}".encode()
        # 64 bits beyond the largest half that occurs keep the remainder even.
        return int.from_bytes(hashlib.blake2b(text, key=self.key, digest_size=40).digest(), "big")

    def _turns(self, value: int, size: int, tweak: str, back: bool) -> int:
        a = isqrt(size - 1) + 1
        b = -(-size // a)
        left, right = divmod(value, b)
        for i in reversed(range(self.rounds)) if back else range(self.rounds):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * self._noise(tweak, i, left, size)) % b
            else:
                left = (left + sign * self._noise(tweak, i, right, size)) % a
        return left * b + right

    def permute(self, value: int, size: int, tweak: str, back: bool = False, allowed: Callable[[int], bool] | None = None) -> int:
        """``allowed`` narrows the domain further; a value in it stays in it."""
        if size <= 1:
            return value
        while True:
            value = self._turns(value, size, tweak, back)
            if value < size and (allowed is None or allowed(value)):
                return value


def luhn_digit(payload: str) -> str:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in payload[::-2])
    return str(-(doubled + sum(int(d) for d in payload[-2::-2])) % 10)


def iban_check(country: str, body: str) -> str:
    digits = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{98 - int(digits) % 97:02d}"


def iban_valid(text: str) -> bool:
    plain = text.replace(" ", "")
    return len(plain) <= 34 and plain[2:4] == iban_check(plain[:2], plain[4:])


def iban_head(text: str) -> str:
    """The begin of a match that is as long as its country's IBANs, if a space follows; else an empty text.

    The pattern runs on over upper-case words and numbers behind an IBAN.
    """
    size = IBAN_LENGTHS.get(text[:2], 0)
    ends = [i for i, c in enumerate(text, start=1) if c != " "][size - 1 : size] if size else []
    return text[: ends[0]] if ends and text[ends[0] : ends[0] + 1] == " " else ""


def _filled(shape: str, chars: str, is_slot: Callable[[str], bool]) -> str:
    """``shape`` with its slots filled in order; the marks between them stay."""
    it = iter(chars)
    return "".join(next(it) if is_slot(c) else c for c in shape)


_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _alphabet(c: str) -> str:
    return next((a for a in _ALPHABETS if c in a), "")


class Pseudonyms:
    """Pseudonyms of single values under one key. ``back`` undoes them."""

    def __init__(self, key: bytes, back: bool = False) -> None:
        self.feistel, self.back = Feistel(key), back
        self.of = lru_cache(maxsize=1 << 16)(self._of)

    def _permute(self, value: int, size: int, tweak: str, allowed=None) -> int:
        return self.feistel.permute(value, size, tweak, self.back, allowed)

    def _chars(self, text: str, tweak: str, allowed: Callable[[str], bool] | None = None) -> str:
        """Letters and digits permuted, each within its own alphabet, as one number of mixed radix."""

        def chars(value: int) -> str:
            out = []
            for c in reversed(text):
                if alphabet := _alphabet(c):
                    value, i = divmod(value, len(alphabet))
                    c = alphabet[i]
                out.append(c)
            return "".join(reversed(out))

        value, size = 0, 1
        for c in text:
            if radix := len(_alphabet(c)):
                value = value * radix + _alphabet(c).index(c)
                size *= radix
        shape = "".join(_alphabet(c)[:1] or c for c in text)
        return chars(self._permute(value, size, f"{tweak}|{shape}", allowed and (lambda v: allowed(chars(v)))))

    def _number(self, digits: str, tweak: str, allowed: Callable[[str], bool] | None = None) -> str:
        shown = lambda value: f"{value:0{len(digits)}d}"
        fits = allowed and (lambda value: allowed(shown(value)))
        return shown(self._permute(int(digits), 10 ** len(digits), f"{tweak}|{len(digits)}", fits))

    def _date(self, year: str, month: str, day: str, allowed=None, tweak: str = "date") -> datetime.date | None:
        try:
            value = datetime.date(int(year), int(month), int(day)).toordinal() - _FIRST_DAY
        except ValueError:
            return None
        if 0 <= value < _DAYS:
            at = lambda v: datetime.date.fromordinal(v + _FIRST_DAY)
            return at(self._permute(value, _DAYS, tweak, allowed and (lambda v: allowed(at(v)))))
        at = lambda v: datetime.date.fromordinal(v + 1 + (_DAYS if v + 1 >= _FIRST_DAY else 0))
        value += _FIRST_DAY - 1 - (_DAYS if value > 0 else 0)
        return at(self._permute(value, _OTHER_DAYS, f"{tweak}|other", allowed and (lambda v: allowed(at(v)))))

    def _of(self, kind: str, text: str) -> tuple[str, str] | None:
        """Kind and pseudonym of a match, or None where it fails its check."""
        if kind == "email":
            local, domain = text.split("@")
            return "email", f"{self._chars(local, 'email')}@{domain}"
        if kind == "iban":
            if iban_valid(head := iban_head(text)):
                text = head
            elif not iban_valid(text):
                return None
            plain = text.replace(" ", "")
            country, body = plain[:2], plain[4:]
            whole = lambda body: _filled(text, country + iban_check(country, body) + body, lambda c: c != " ")
            # What is valid at another length than its country's must not have a pseudonym that is valid at that one.
            apart = (lambda body: not iban_valid(iban_head(whole(body)))) if iban_head(text) else None
            return "iban", whole(self._chars(body, f"iban|{country}", apart))
        if kind == "ip":
            octets = text.split(".")
            if any(int(o) > 255 or (o[0] == "0" and o != "0") for o in octets):
                return None
            value = self._permute(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, "ip")
            return "ip", ".".join(map(str, value.to_bytes(4, "big")))
        if kind == "ssn":
            # The domain holds valid numbers only: no area 000, 666 or 900 and above, no group 00, no serial 0000.
            area, group, serial = map(int, text.split("-"))
            if area in (0, 666) or area >= 900 or not group or not serial:
                return None
            rank = (area - 1 - (area > 666)) * 99 * 9999 + (group - 1) * 9999 + serial - 1
            rank, serial = divmod(self._permute(rank, 898 * 99 * 9999, "ssn"), 9999)
            area, group = divmod(rank, 99)
            return "ssn", f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"
        if kind == "iso":
            day = self._date(text[:4], text[5:7], text[8:])
            return day and ("date", f"{day.year:04d}{text[4]}{day.month:02d}{text[4]}{day.day:02d}")
        if kind == "dmy":
            mark = next(c for c in text if not c.isdigit())
            first, second, year = text.split(mark)
            wide = len(first) == 2 or first.startswith("0")
            if day := self._date(year, second, first):
                parts = day.day, day.month
            else:
                # Month first, which only a day beyond 12 shows; its pseudonym has such a day too.
                if not (day := self._date(year, first, second, lambda d: d.day > 12)):
                    return None
                parts = day.month, day.day
            pad = (lambda n: f"{n:02d}") if wide else str
            return "date", f"{pad(parts[0])}{mark}{pad(parts[1])}{mark}{day.year:04d}"
        digits = "".join(c for c in text if c.isdigit())
        if kind == "card":
            if digits[-1] != luhn_digit(digits[:-1]):
                return None
            payload = self._number(digits[:-1], "card")
            return "card", _filled(text, payload + luhn_digit(payload), str.isdigit)
        # A phone number keeps its country code; its other digits change places with others of that many digits.
        text, code = phone_parts(text)
        digits = "".join(c for c in text if c.isdigit())
        if not 7 <= len(digits) <= 15 or len(digits) - len(code) < 6:
            return None
        # A number without a known code must not seem to have one.
        unknown = (lambda number: not known_code(number)) if text.startswith("+") and not code else None
        return "phone", _filled(text, code + self._number(digits[len(code) :], "phone", unknown), str.isdigit)

    def rewrite(self, text: str) -> tuple[str, Counter]:
        """The text with its values replaced, and how many of each kind."""
        counts: Counter = Counter()
        out, at, search = [], 0, 0
        while m := PATTERN.search(text, search):
            done = self.of(m.lastgroup, m[0]) if m.lastgroup else None
            if done is None:
                # Not valid as this kind; another may begin at a later character of it.
                search = m.start() + 1
                continue
            counts[done[0]] += 1
            out += [text[at : m.start()], done[1]]
            # An IBAN or a phone number may end before its match does; its pseudonym is as long as it is.
            at = search = m.start() + len(done[1]) if done[0] in ("iban", "phone") else m.end()
        return "".join([*out, text[at:]]) if out else text, counts


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """``doc_id, text, n_email, n_iban, n_card, n_phone, n_ip, n_ssn, n_date`` for each row of ``docs``, whole texts.

    ``back`` turns pseudonyms into the values again. What fails its check (a card number by its last digit, an IBAN by its
    remainder, a date by the calendar of the years 1 to 9999, an address by its octets) stays as it is. A null text stays null, with no values.
    Rows that repeat an id, or have none, each have their row; no rows give no rows.
    """
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key, back)
        for batch in batches:
            # Every kind has a digit or an @, most texts neither.
            maybe = pc.fill_null(pc.match_substring_regex(batch.column(1), r"[0-9]|@[A-Za-z0-9]"), False).to_pylist()
            texts, counts = [], {k: [] for k in KINDS}
            for value, flagged in zip(batch.column(1), maybe):
                text, n = names.rewrite(value.as_py()) if flagged else (value.as_py(), {})
                texts.append(text)
                for k in KINDS:
                    counts[k].append(n.get(k, 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), *(pa.array(counts[k], pa.int64()) for k in KINDS)],
                names=["doc_id", "text", *(f"n_{k}" for k in KINDS)],
            )

    bound_batches(docs.sparkSession)
    return narrow.mapInArrow(replace, f"doc_id {id_type}, text string, " + ", ".join(f"n_{k} bigint" for k in KINDS))
