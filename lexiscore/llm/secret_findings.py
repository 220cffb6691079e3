"""Labelled findings made by rule: keys of known forms against look-alikes, in surroundings of both kinds.

Patterns confirm only the secrets that they know, so a network that learns from their verdicts alone learns the patterns.
These findings tell it what the patterns cannot: random keys of the usual alphabets and lengths, keys with a vendor's
beginning, heads and bodies of signed tokens; and on the other side paths, identifiers, slugs, UUIDs, numbers, times, rows
of one character, long words, and digests or pictures that the words before them name as such. All of it follows from a
seed, so every run and every executor has the same ones.
"""

from __future__ import annotations

import base64
import random
import string
from collections.abc import Callable

HEX = "0123456789abcdef"
BASE62 = string.ascii_letters + string.digits
BASE64, BASE64_URL = BASE62 + "+/", BASE62 + "-_"
BASE36 = string.ascii_lowercase + string.digits

# Beginnings of keys and the alphabet and length of what follows them.
VENDOR_KEYS = {
    "ghp_": (BASE62, 36),
    "glpat-": (BASE64_URL, 20),
    "npm_": (BASE62, 36),
    "sk_live_": (BASE62, 24),
    "rk_test_": (BASE62, 24),
    "AIza": (BASE64_URL, 35),
    "xoxb-": (string.digits, 12),
    "AKIA": (string.ascii_uppercase + string.digits, 16),
    "dop_v1_": (HEX, 64),
    "hf_": (string.ascii_letters, 34),
}

KEY_BEFORE = (
    "key = '", 'api_key: "', "Authorization: Bearer ", "export AUTH=", 'credential="', "client secret is ", "--key ", "signing_key=",
    "pass: ", "auth ", "<key>", "private: ",
)
PLAIN_BEFORE = (
    "see ", "in ", "from ", "import ", "path = '", 'href="', "file: ", "name=", "id: ", "class ", "at ", "(", '"', "| ", "- ", "", "# ",
    "ref ", "number ", "call ", "card ", "order ",
)
DIGEST_BEFORE = ("sha256: ", "sha1 ", "md5sum ", "checksum=", "commit ", "etag: ", "integrity sha512-", "digest ", "revision ", "hash: ", "image;base64,")
AFTER = ("", " ", "'", '"', ", ", ". ", ")", "\n", '">', ";", " | ", ":")

WORDS = (
    "access account action adapter array basic blob bridge buffer build cache center client cluster column config content core "
    "count data default device document event factory feature field file filter form frame group handler header image index "
    "input item key layer left library list local manager map member message method model module node object option order "
    "package page parent part path player point policy process project proxy query reader record region report request result "
    "right root route sample schema scope search service session shape shared single site source stage state storage stream "
    "string style system table target task template test text theme token tool tree type unit update upper user value vector "
    "version view widget window worker writer"
).split()


class _Maker:
    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def of(self, alphabet: str, low: int, high: int | None = None) -> str:
        return "".join(self.rng.choices(alphabet, k=self.rng.randint(low, high or low)))

    def word(self) -> str:
        if self.rng.random() < 0.6:
            return self.rng.choice(WORDS)
        return "".join(self.rng.choice("bcdfghjklmnprstvw") + self.rng.choice("aeiou") for _ in range(self.rng.randint(1, 4)))

    def words(self, low: int, high: int) -> list[str]:
        return [self.word() for _ in range(self.rng.randint(low, high))]

    def number(self, p: float = 0.5, digits: int = 3) -> str:
        return str(self.rng.randrange(10**digits)) if self.rng.random() < p else ""

    # Keys.

    def random_key(self) -> str:
        alphabet = self.rng.choice((HEX, HEX.upper(), HEX.upper(), BASE62, BASE62, BASE64, BASE64_URL, BASE36, string.ascii_uppercase + "234567"))
        key = self.of(alphabet, 20, 64)
        return key + "=" * self.rng.choice((0, 0, 1, 2)) if alphabet == BASE64 else key

    def short_key(self) -> str:
        return self.of(BASE62, 16, 22)

    def vendor_key(self) -> str:
        start, (alphabet, n) = self.rng.choice(list(VENDOR_KEYS.items()))
        key = start + self.of(alphabet, n)
        return f"{key}-{self.of(string.digits, 12)}-{self.of(BASE62, 24)}" if start == "xoxb-" else key

    def token(self) -> str:
        part = lambda text: base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")
        head = part('{"alg":"%s","typ":"JWT"}' % self.rng.choice(("HS256", "RS256", "ES256", "HS512")))
        body = part('{"sub":"%s","name":"%s","iat":%d}' % (self.of(string.digits, 6, 10), " ".join(self.words(1, 2)), self.rng.randrange(10**9, 2 * 10**9)))
        return f"{head}.{body}.{self.of(BASE64_URL, 43)}"

    # Look-alikes.

    def path(self) -> str:
        roots = ("/usr/local/lib", "/home", "/var/log", "src", "/opt", "https://www", "docs", "/etc", "/usr/share")
        return "/".join([self.rng.choice(roots), *(w + self.number(0.3, 2) for w in self.words(2, 6))])

    def identifier(self) -> str:
        words = self.words(3, 7)
        style = self.rng.randrange(4)
        if style == 0:
            name = "".join(w.capitalize() for w in words)
        elif style == 1:
            name = words[0] + "".join(w.capitalize() for w in words[1:])
        else:
            name = "_".join(words)
        return (name.upper() if style == 3 else name) + self.rng.choice(("", "_")) + self.number(0.7)

    def slug(self) -> str:
        return "-".join([*self.words(3, 8), self.number(0.8, 4)]).strip("-")

    def uuid(self) -> str:
        text = "-".join(self.of(HEX, n) for n in (8, 4, 4, 4, 12))
        return text.upper() if self.rng.random() < 0.2 else text

    def digits(self) -> str:
        return self.rng.choice(("", "", "", "+", "-")) + self.of(string.digits, 16, self.rng.choice((16, 16, 19, 40)))

    def time(self) -> str:
        r = self.rng
        day = f"{r.randint(1990, 2035)}{r.choice(('-', ''))}{r.randint(1, 12):02}{r.choice(('-', ''))}{r.randint(1, 28):02}"
        return f"{day}{r.choice('T-_')}{r.randrange(24):02}{r.randrange(60):02}{r.randrange(60):02}{r.choice(('Z', '+0000', '-0500', '000'))}"

    def row(self) -> str:
        unit = self.rng.choice(("=", "-", "_", "+", "/", "-=", "+-", "=-", "x", "0", "1", "a", "A", "--+", "9", "F", "01", "ab", "10"))
        return (unit * 90)[: self.rng.randint(24, 90)]

    def long_word(self) -> str:
        text = "".join(self.words(6, 12))
        return text.upper() if self.rng.random() < 0.3 else text

    def formula(self) -> str:
        signs = self.rng.choice(("+", "/", "=", "-", "_"))
        return signs.join(w + self.number(0.6, 2) for w in self.words(4, 8))

    def prose(self) -> str:
        return " ".join(self.words(4, 8))


def labelled(rows: int, seed: int = 7) -> list[tuple[str, int, int, int]]:
    """About ``rows`` findings of each label: text, start and end of the value in it, label. Forms take turns."""
    make = _Maker(seed)
    r = make.rng
    keys: list[Callable[[], str]] = [
        make.random_key, make.random_key, make.vendor_key, make.random_key, make.short_key, make.random_key, make.random_key, make.token,
        make.vendor_key,
    ]
    others: list[Callable[[], str]] = [
        make.path, make.identifier, make.slug, make.uuid, make.digits, make.time, make.row, make.long_word, make.formula, make.identifier, make.digits,
        make.uuid,
    ]
    found = []

    def put(before: str, value: str, label: int) -> None:
        before = f"{make.prose()} {before}" if r.random() < 0.8 else before
        after = r.choice(AFTER) + (make.prose() if r.random() < 0.7 else "")
        # A letter or sign in front or behind would be part of the run.
        after = after if not after or not (after[0].isalnum() or after[0] in "+/_=-") else " " + after
        found.append((before + value + after, len(before), len(before) + len(value), label))

    for i in range(rows):
        value = keys[i % len(keys)]()
        put(r.choice(KEY_BEFORE if r.random() < 0.4 else PLAIN_BEFORE), value, 1)
        if i % 10 == 9:
            # The same kind of value, which the words before it name as no secret.
            put(r.choice(DIGEST_BEFORE), make.random_key(), 0)
        else:
            put(r.choice(KEY_BEFORE if r.random() < 0.1 else PLAIN_BEFORE), others[i % len(others)](), 0)
    return found
