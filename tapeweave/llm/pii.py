"""Surrogates for personal data: keyed, of the same type and format, distinct and consistent.

Detected values are brought to a canonical form (a phone number is its digits), so that every
spelling of one entity gets the same surrogate in its own spelling. A value of a format (which
character class at which place) is a number in mixed radix; a keyed Feistel permutation of that
range, walked until it lands inside, is its surrogate, so two values of one format never share one.
Check digits are made right again. Names map within their gender (where a title or a given name tells
it) and script. A name is found by its shape after a title, a known given name or a phrase that
introduces one; where a document has named someone, later mentions of one of the names follow. The
distinct entities of the corpus and their surrogates then meet in one grouping: a surrogate that is a
real value of the corpus, or that two entities share, is drawn again with the next tweak. After
ATTEMPTS draws a walk passes every value of the format once; then mail names and secrets grow by a
letter at a time, addresses vary in all parts, and given names get syllables. The first draw of a
fixed format (cards, phones, dates of birth) is a derangement of all its values; where the corpus has
so many of them that free ones may run out, that is the surrogate.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeweave.llm.common import cut, fresh, small_batches, text_of

KEY_CONF = "spark.tapeweave.pii.key"  # the secret of a production session
KEY = "tapeweave"  # where neither the caller nor the session gives one, as in tests
ATTEMPTS = 32  # draws before the walk through a format
WIDE = 1_000_000  # draws of one round at most, if each open entity has one
NO_END = 1 << 62
FULL = 4  # a format is dense if the corpus has more than one in so many of its values
SMALL = 50_000  # rows of redrawn entities that are broadcast at most; more are joined by shuffle

# Titles (u: of any gender), phrases before a name, given names to find, and given names to put in their place.
TITLES = {"f": "Mrs Ms Miss Madame Mme Frau Señora Sra Signora Госпожа".split(), "m": "Mr Mister Monsieur Herr Señor Signor Господин".split(), "u": "Dr Prof Professor Doctor Доктор Профессор".split()}
CUES = "my name is|her name is|his name is|person named|signed by|signed,|sincerely,|regards,|attn:|attention:|contact person|on behalf of|patient|меня зовут|ich heiße|je m'appelle|me llamo".split("|")
GIVEN = {
    ("latin", "f"): "Mary Anna Maria Emma Sophie Laura Julia Sarah Lisa Elena Carmen Claire Ingrid Olivia Alice Emily Jennifer Patricia Linda Susan".split(),
    ("latin", "m"): "John James Peter Paul Michael Thomas David Carlos Pierre Hans Luis Robert William George Henry Daniel Stefan Antonio Charles Joseph".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Татьяна Наталья".split(),
    ("cyrillic", "m"): "Иван Пётр Сергей Алексей Дмитрий Николай".split(),
}
STAND_IN = {
    ("latin", "f"): "Adela Brenna Celeste Dorit Elvira Fenna Greta Hedwig Ilse Jovana Katrin Leonie Marit Nerea Odette Petra Rosalind Solveig Thea Ursula Viola Wanda Xenia Yvette Zelda".split(),
    ("latin", "m"): "Alaric Bastian Cedric Dorian Edgar Florian Gunnar Hector Ivar Jasper Konrad Leander Magnus Nestor Oswald Philip Quentin Roland Sigurd Tobias Ulric Valentin Werner Xavier Yorick".split(),
    ("cyrillic", "f"): "Варвара Галина Зинаида Ксения Лариса Марфа Нина Раиса".split(),
    ("cyrillic", "m"): "Богдан Вадим Глеб Егор Захар Игнат Лев Матвей".split(),
}
SYLLABLES = {"latin": "ba be do fa ga hol ka lan mo nir ol pe ra so tal ur ve win yo zar".split(), "cyrillic": "ба ве го да жи за ка ло ма не пи ро са ту ша".split()}
ENDING = {("latin", "f"): "ina", ("latin", "m"): "ion", ("latin", "u"): "en", ("cyrillic", "f"): "ина", ("cyrillic", "m"): "ион", ("cyrillic", "u"): "ен"}
SEX = {name: (script, sex) for (script, sex), names in GIVEN.items() for name in names}

CAPITAL = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+"
OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
EMAIL = re.compile(r"(?<![\w.%+-])[^\W_][\w.%+-]*@(?:[^\W_](?:[^\W_]|-)*(?<!-)\.)+[^\W\d_]{2,}")
SECRET = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk[-_][A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{10,})(?![A-Za-z0-9])")
LABELLED = re.compile(r"\b(?:api[_-]?key|access[_-]?key|secret(?:[_-]?key)?|auth[_-]?token|token|password|passwd|pwd)\b[\"']?\s*[:=]\s*[\"']?([^\s\"'<>]{6,})", re.I)
PREFIX = re.compile(r"(?:AKIA|ASIA|gh[pousr]_|sk[-_]|xox[abprs]-|eyJ)?")
HINTS = ("token", "key", "secret", "passw", "pwd")
MARKS = ("AKIA", "ASIA", "gh", "sk-", "sk_", "xox", "eyJ")
NUMBER = re.compile(
    rf"(?P<ip>(?<![\w.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d))"
    r"|(?P<card>(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<!\w)(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4}|0\d{3,4}[ -]\d{5,6}|0\d{2,3}[ -]\d{3,4}[ -]\d{4})(?!\w))"
)
TOLD = re.compile(
    r"\b(?:(?:phone|tel|telephone|mobile|cell|fax)\b(?: (?:no|number|is))?[.:]? {0,2}(?P<phone>\d{7,15}|\d{3}-\d{4})"
    r"|(?:call|ring|text|reach)\b(?: (?:me|us|him|her|them))? (?:at|on) (?P<line>\d{7,15}|\d{3}-\d{4})"
    r"|passport\b(?: (?:no|number|is))?[.:#]* {0,2}(?P<passport>[A-Z]{0,2}\d{6,9})"
    r"|(?:dob|date of birth|born(?: on)?)\b[.:]? {0,2}(?P<dob>\d{4}-\d\d-\d\d|\d\d[./]\d\d[./]\d{4}))(?!\w)", re.I,
)
TOLD_BEFORE = 40  # characters in which a word that says what a number is stands before it
NUMERIC = re.compile(r"\d{6,15}|(?<![\d-])\d{3}-\d{4}(?![\d-])|\d{4}-\d\d-\d\d|\d\d[./]\d\d[./]\d{4}")
IPV6 = re.compile(r"(?<![\w:.])(?=[0-9a-fA-F:]*[0-9])(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}(?![\w:])|(?<![\w:.])(?:[0-9a-fA-F]{1,4}:){2,6}:(?:[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){0,5})(?![\w:])")
DIGITS = re.compile(r"[+(\d][\d ().+-]{6,}")
IBAN = re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b")
IBAN_CLUE = re.compile(r"[A-Z][A-Z]\d\d")
CUED = re.compile(rf"\b(?i:{'|'.join(map(re.escape, CUES))})(?: |\n{{1,2}})(?P<cued>{CAPITAL}(?:[ -]{CAPITAL}){{1,2}})")
PERSON = re.compile(rf"\b(?:(?P<title>{'|'.join(sum(TITLES.values(), []))})\.? (?P<titled>{CAPITAL}(?:[ -]{CAPITAL}){{0,2}})|(?P<given>{'|'.join(sorted(SEX, key=len, reverse=True))}) (?P<surname>{CAPITAL}))")
DEEDS = "said wrote told asked replied answered phoned emailed met thanked contacted spoke".split()  # beside them stands who did it, and to whom
GREETINGS = ("Dear ", "dear ", "Hello ", "hello ")
ACTOR_BEFORE = 80  # characters in which the one who did it stands before a verb
RUN = rf"{CAPITAL}(?:[ -]{CAPITAL}){{1,2}}"
ACTOR = re.compile(rf"\b(?P<cued>{RUN}) (?:has |had )?(?:{'|'.join(DEEDS)})\b")
OTHER = re.compile(rf"\b(?:(?:{'|'.join(DEEDS)})(?: to| with)?|[Dd]ear|[Hh]ello) (?P<cued>{RUN})")
LISTED = re.compile(rf"(?:,? and|,) (?P<cued>{RUN})")
COMMON = set("The This That These Those A An In On At For And But If When Where Then There Here We They He She It You Our Your My New North South East West All Some Sir Madam Later Yesterday Today Tomorrow Now Once Soon Finally Meanwhile However Perhaps Also Again".split()) | set(sum(TITLES.values(), []))  # words that begin a sentence or a place, not a name
CALLED = re.compile("|".join(sorted([*sum(TITLES.values(), []), *SEX], key=len, reverse=True)))
WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿА-Яа-яЁёẞß]+")


def permuted(value: int, size: int, tweak: str, key: str, back: bool = False) -> int:
    """A keyed permutation of range(size), or its inverse: a balanced Feistel network, walked until inside."""
    if size < 2:
        return value
    half = ((size - 1).bit_length() + 1) // 2
    mask = (1 << half) - 1
    need = -(-half // 8)
    while True:
        left, right = value >> half, value & mask
        if back:
            left, right = right, left
        for r in range(7, -1, -1) if back else range(8):
            data = f"{tweak}|{size}|{r}|{right}".encode()
            noise = hashlib.blake2b(data, key=key.encode()[:64], digest_size=min(64, need)).digest()
            if need > 64:
                noise = hashlib.shake_256(noise + key.encode()).digest(need)
            left, right = right, left ^ (int.from_bytes(noise, "big") & mask)
        value = right << half | left if back else left << half | right
        if value < size:
            return value


def deranged(value: int, size: int, tweak: str, key: str) -> int:
    """A keyed permutation of range(size) that leaves no place where it is: a shift, seen through another permutation."""
    if size < 2:
        return value
    noise = hashlib.blake2b(f"{tweak}|{size}|shift".encode(), key=key.encode()[:64]).digest()
    shift = 1 + int.from_bytes(noise, "big") % (size - 1)
    return permuted((permuted(value, size, tweak, key) + shift) % size, size, tweak, key, back=True)


CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", *("".join(map(chr, r)) for r in (range(0xE0, 0xF7), range(0xC0, 0xD7), range(0x430, 0x450), range(0x410, 0x430))))


def _alphabet(c: str) -> str:
    return next((letters for letters in CLASSES if c in letters), c)


def _alphabets(value: str) -> list[str]:
    """The class of each character; a value of hexadecimal digits stays one."""
    if len(value) >= 16 and re.fullmatch("[0-9a-f]+|[0-9A-F]+", value):
        return ["0123456789ABCDEF" if value != value.lower() else "0123456789abcdef"] * len(value)
    return list(map(_alphabet, value))


def walked(number: int, size: int, tweak: str, key: str, step: int | None = 0) -> int:
    """A keyed permutation of range(size), without fixed places if step is None; steps 1 to size of one number pass every place once."""
    if step is None:
        return deranged(number, size, tweak, key)
    place = permuted(number, size, tweak, key)
    return permuted((place + step) % size, size, tweak + "|walk", key) if step else place


def _sizes(alphabets: list[str]) -> int:
    return math.prod(map(len, alphabets))


def reshaped(value: str, tweak: str, key: str, alphabets: list[str] | None = None, step: int | None = 0) -> str:
    """value with every letter and digit replaced by one of its class."""
    alphabets = alphabets or _alphabets(value)
    number, size = 0, 1
    for c, a in zip(value, alphabets, strict=True):
        number, size = number * len(a) + a.index(c), size * len(a)
    number = walked(number, size, tweak + "|" + "".join(a[0] + a[-1] for a in alphabets), key, step)
    out = []
    for a in reversed(alphabets):
        number, i = divmod(number, len(a))
        out.append(a[i])
    return "".join(reversed(out))


def luhn(digits: str) -> int:
    """The digit that makes digits and it pass the Luhn check."""
    total = sum(sum(divmod(int(d) * (2 if i % 2 == 0 else 1), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def canonical(kind: str, value: str) -> str:
    if kind == "email":
        return value.lower()
    if kind in ("card", "ssn"):
        return re.sub(r"\D", "", value)
    if kind == "phone":  # a country code belongs to it, but for 1, which one spelling has and another hasn't
        digits = re.sub(r"\D", "", value)
        if not value.startswith("+"):
            return digits
        return digits[1:] if digits[0] == "1" and len(digits) == 11 else f"+{digits}"
    if kind in ("passport", "ip6"):
        return value.upper() if kind == "passport" else value.lower()
    if kind == "dob":
        return value if value[4] == "-" else f"{value[6:]}-{value[3:5]}-{value[:2]}"
    if kind == "iban":
        return value.replace(" ", "")
    return value


FIRST_DAY, DAYS = date(1920, 1, 1).toordinal(), 40_000  # dates of birth map to dates of birth


def _script(word: str) -> str:
    return "cyrillic" if re.search("[А-Яа-яЁё]", word) else "latin"


def stand_in(kind: str, value: str, attempt: int, key: str) -> str:
    """The surrogate of a canonical value at an attempt, canonical as well.

    The first attempt is a derangement of the value's format. From ATTEMPTS on, attempts walk through
    the format: room(kind, value) of them meet each of its values.
    """
    step = max(0, attempt - ATTEMPTS + 1) if attempt else None
    tweak = f"{kind}|{min(attempt, ATTEMPTS)}"
    if step and kind in GROWS and step > room(kind, value):
        return _widened(kind, value, step - room(kind, value) - 1, key)
    if kind == "email":
        local, _, domain = value.partition("@")
        host, _, top = domain.rpartition(".")
        known = re.fullmatch(r"(?:[\w-]+\.)*example\.(?:com|net|org)", domain)
        hosts, locals_ = (x + 1 for x in divmod(step - 1, _sizes(_alphabets(local)))) if step else (0, 0)
        where = domain if known else f"{reshaped(host.replace('.', '-'), tweak + top, key, step=hosts)}.example"
        return f"{reshaped(local, tweak + domain, key, step=locals_)}@{where}"
    if kind == "ip":
        octets = [int(x) for x in value.split(".")]
        number, size = 0, 1
        for x in octets:
            if 0 < x < 255:
                number, size = number * 254 + x - 1, size * 254
        number = walked(number, size, tweak + "".join("x" if 0 < x < 255 else str(x) for x in octets), key, step)
        for i in range(3, -1, -1):
            if 0 < octets[i] < 255:
                number, x = divmod(number, 254)
                octets[i] = x + 1
        return ".".join(map(str, octets))
    if kind == "card":
        off = (int(value[-1]) - luhn(value[:-1])) % 10
        body = value[0] + reshaped(value[1:-1], tweak + value[0], key, ["0123456789"] * (len(value) - 2), step)
        return body + str((luhn(body) + off) % 10)
    if kind == "iban":
        body = reshaped(value[4:], tweak + value[:2], key, list(map(_alphabet, value[4:])), step)
        rest = int("".join(str(int(c, 36)) for c in body + value[:2] + "00")) % 97
        return f"{value[:2]}{98 - rest:02d}{body}"
    if kind == "phone":
        return reshaped(value, tweak, key, _phone(value), step)
    if kind == "ssn":
        return reshaped(value, tweak, key, step=step)
    if kind == "ip6":
        return reshaped(value, tweak, key, ["0123456789abcdef" if c != ":" else c for c in value], step)
    if kind == "dob":
        day = _day(value)
        if day is not None:
            return date.fromordinal(FIRST_DAY + walked(day, DAYS, tweak, key, step)).isoformat()
        while True:  # digits that are no such date stay apart from dates
            value = reshaped(value, tweak, key, step=step)
            if _day(value) is None:
                return value
    if kind.startswith("given"):
        _, script, sex = kind.split("-")
        names, pool = GIVEN.get((script, sex), []), STAND_IN.get((script, sex), [])
        if sex == "u":
            return (_syllables(script, f"{kind}|{attempt}|{value}", 2 + (step or 0) // 64, key) + ENDING[script, sex]).capitalize()
        if value in names:
            shift = permuted(0, len(pool), tweak, key)
            name = pool[(permuted(names.index(value), len(names), tweak, key) + shift) % len(pool)]
            if attempt < ATTEMPTS:
                return name
            return name + _syllables(script, f"{kind}|{attempt}|{value}", 1 + step // 64, key) + ENDING[script, sex]
    if kind.startswith(("given", "surname")):
        return _syllables(kind.split("-")[1], f"{kind}|{attempt}|{value}", 5 + (step or 0) // 64, key).capitalize()
    head = PREFIX.match(value)[0] if kind == "secret" else ""
    return head + reshaped(value[len(head) :], tweak + head, key, step=step)


GROWS = ("email", "secret", "ip")  # formats that have more values than those of one length or one pattern of zeros


def _widened(kind: str, value: str, extra: int, key: str) -> str:
    """The surrogate number extra (from 0) beyond the format of value: a longer mail name or secret, or an address that varies in all parts."""
    if kind == "ip":
        number = permuted((int.from_bytes(hashlib.blake2b(value.encode(), key=key.encode()[:64], digest_size=8).digest(), "big") + extra) % 254**4, 254**4, "ip|wide", key)
        return ".".join(str(number // 254**i % 254 + 1) for i in range(4))
    letters, more, size = CLASSES[1], 1, 26
    while extra >= size:
        extra, more, size = extra - size, more + 1, size * 26
    number = permuted(extra, size, f"{kind}|wide|{more}", key)
    tail = "".join(letters[number // 26**i % 26] for i in range(more))
    base, at, domain = stand_in(kind, value, 0, key).partition("@")
    return base + tail + at + domain


def _day(value: str) -> int | None:
    """The number of a date of birth, None where it is no date or outside of the range."""
    try:
        day = date.fromisoformat(value).toordinal() - FIRST_DAY
    except ValueError:
        return None
    return day if 0 <= day < DAYS else None


def _phone(value: str) -> list[str]:
    """Alphabets of a phone number: a country code keeps its first digits (one for 1 and 7, else two), and where a number or its second part begins with 0, that stays."""
    kept = (2 if value[1] in "17" else 3) if value[0] == "+" else 0
    begins = lambda c: "0" if c == "0" else CLASSES[0][1:]
    return [c if i < kept else begins(c) if i - kept in (0, 3) else CLASSES[0] for i, c in enumerate(value)]


def _syllables(script: str, tweak: str, count: int, key: str) -> str:
    """A word of count syllables."""
    syllables = SYLLABLES[script]
    number = int.from_bytes(hashlib.blake2b(tweak.encode(), key=key.encode()[:64], digest_size=16).digest(), "big") % len(syllables) ** count
    word = ""
    for _ in range(count):
        number, i = divmod(number, len(syllables))
        word += syllables[i]
    return word


def room(kind: str, value: str) -> int:
    """How many values the format of a canonical value has; NO_END for names and for more than that."""
    if kind.startswith(("given", "surname")):
        return NO_END
    if kind == "ip6":
        return min(16 ** sum(c != ":" for c in value), NO_END)
    if kind == "dob" and _day(value) is not None:
        return DAYS
    if kind == "email":
        local, _, domain = value.partition("@")
        known = re.fullmatch(r"(?:[\w-]+\.)*example\.(?:com|net|org)", domain)
        size = _sizes(_alphabets(local)) * (1 if known else _sizes(_alphabets(domain.rpartition(".")[0].replace(".", "-"))))
    elif kind == "ip":
        size = 254 ** sum(0 < int(x) < 255 for x in value.split("."))
    elif kind == "card":
        size = 10 ** (len(value) - 2)
    elif kind == "iban":
        size = _sizes(list(map(_alphabet, value[4:])))
    elif kind == "phone":
        size = _sizes(_phone(value))
    else:
        size = _sizes(_alphabets(value[len(PREFIX.match(value)[0]) if kind == "secret" else 0 :]))
    return min(size, NO_END)


def form(kind: str, value: str) -> str | None:
    """The format that a surrogate shares with its value, for kinds of fixed formats: no two formats have a value in common."""
    if kind in GROWS or kind.startswith(("given", "surname")):
        return None
    if kind == "dob":
        return "day" if _day(value) is not None else "digits"
    if kind == "card":
        return f"{value[0]} {len(value)} {(int(value[-1]) - luhn(value[:-1])) % 10}"
    if kind == "iban":
        return value[:2] + "".join(a[0] for a in map(_alphabet, value[4:]))
    if kind == "ip6":
        return re.sub("[^:]", "x", value)
    return "".join(a[0] for a in (_phone(value) if kind == "phone" else _alphabets(value)))


def rendered(kind: str, shown: str, surrogate: str) -> str:
    """The canonical surrogate in the spelling of the value shown."""
    if kind == "dob" and shown[4] != "-":
        return f"{surrogate[8:]}{shown[2]}{surrogate[5:7]}{shown[5]}{surrogate[:4]}"
    if kind in ("card", "ssn", "phone", "iban"):
        surrogate = surrogate.lstrip("+")
        before = sum(c.isalnum() for c in shown) - len(surrogate)  # a country code
        letters = iter("".join(c for c in shown if c.isalnum())[:before] + surrogate)
        return "".join(next(letters) if c.isalnum() else c for c in shown)
    return surrogate.upper() if kind == "email" and shown.isupper() else surrogate


def found(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical) of each entity, in order and apart; of overlapping ones the first and longest."""
    spans: list[tuple[int, int, str, str]] = []
    if "@" in text:
        spans += [(m.start(), m.end(), "email", canonical("email", m[0])) for m in EMAIL.finditer(text)]
    low = text.lower()
    if any(h in low for h in HINTS):
        for m in LABELLED.finditer(text):
            value = re.sub(r"[^\w/+=-]+$", "", m[1])
            if len(value) >= 6 and re.search(r"\d", value):
                spans.append((m.start(1), m.start(1) + len(value), "secret", value))
    if any(k in text for k in MARKS):
        spans += [(m.start(), m.end(), "secret", m[0]) for m in SECRET.finditer(text)]
    last = 0
    for near in DIGITS.finditer(text):
        if near.start() >= last:
            for m in NUMBER.finditer(text, near.start(), min(len(text), near.end() + 1)):
                spans.append((m.start(), m.end(), m.lastgroup, canonical(m.lastgroup, m[0])))
                last = m.end()
    if IBAN_CLUE.search(text):
        spans += [(m.start(), m.end(), "iban", canonical("iban", m[0])) for m in IBAN.finditer(text)]
    for near in NUMERIC.finditer(text):
        told = [m for m in TOLD.finditer(text, max(0, near.start() - TOLD_BEFORE), near.end() + 1) if m.end() > near.start()]
        for m in told:
            kind = "phone" if m.lastgroup == "line" else m.lastgroup
            spans.append((m.start(m.lastgroup), m.end(m.lastgroup), kind, canonical(kind, m[m.lastgroup])))
    if "::" in text or text.count(":") >= 7:
        spans += [(m.start(), m.end(), "ip6", canonical("ip6", m[0])) for m in IPV6.finditer(text)]
    people = list(PERSON.finditer(text)) if CALLED.search(text) else []
    if any(cue in low for cue in CUES):
        people += CUED.finditer(text)
    people += _beside(text)
    if people:
        named = sorted({x for m in people for x in _names(m)})
        kinds: dict[str, str] = {}
        for _, _, kind, value in named:  # one name is one entity in a document, whose gender any of its mentions may tell
            if kinds.get(value, "-u").endswith("-u"):
                kinds[value] = kind
        named = [(a, b, kinds[value], value) for a, b, _, value in named]
        spans += named + _mentions(text, named)
    if len(spans) < 2:
        return spans
    out: list[tuple[int, int, str, str]] = []
    for x in sorted(spans, key=lambda x: (x[0], -x[1])):
        if not out or x[0] >= out[-1][1]:
            out.append(x)
    return out


def _beside(text: str) -> Iterator[re.Match]:
    """Runs of capitalised words beside a verb of speech or after a salutation, and those listed after one."""
    for cue in (*DEEDS, *GREETINGS):
        at = text.find(cue)
        while at >= 0:
            end = at + len(cue)
            near = [OTHER.match(text, at)]
            if cue in DEEDS and not text[end : end + 1].isalnum():
                near += [m for m in ACTOR.finditer(text, max(0, at - ACTOR_BEFORE), end) if m.end() == end]
            for m in near:
                while m is not None and COMMON.isdisjoint(re.split("[ -]", m["cued"])):
                    yield m
                    m = LISTED.match(text, m.end("cued"))
            at = text.find(cue, end)


def _names(m: re.Match) -> Iterator[tuple[int, int, str, str]]:
    if m.re is not PERSON:
        words, at = re.split("[ -]", m["cued"]), m.start("cued")
        sex = SEX[words[0]][1] if words[0] in SEX else "u"
    elif m["title"]:
        sex = next(sex for sex, titles in TITLES.items() if m["title"] in titles)
        words, at = re.split("[ -]", m["titled"]), m.start("titled")
        if len(words) > 1 and words[0] in SEX:
            sex = SEX[words[0]][1]
    else:
        sex, words, at = SEX[m["given"]][1], [m["given"], m["surname"]], m.start("given")
    for i, word in enumerate(words):
        yield at, at + len(word), f"given-{_script(word)}-{sex}" if i < len(words) - 1 else f"surname-{_script(word)}", word
        at += len(word) + 1


def _mentions(text: str, named: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Later mentions of a name alone; a name that the text also has as a word in small letters is taken for that word."""
    first: dict[str, tuple[int, str]] = {}
    for _, end, kind, value in named:
        first.setdefault(value, (end, kind))
    if not first:
        return []
    words = [(m.start(), m.end(), m[0]) for m in WORD.finditer(text)]
    plain = {w for *_, w in words if w[0].islower()}
    return [(a, b, first[w][1], w) for a, b, w in words if w in first and a >= first[w][0] and w.lower() not in plain]


def entities(docs: DataFrame) -> DataFrame:
    """kind, value (canonical): the distinct entities of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = sorted({(kind, value) for text in batch["text"] for _, _, kind, value in found(text.as_py())})
            yield pa.record_batch([pa.array([x[i] for x in got], pa.string()) for i in (0, 1)], ["kind", "value"])

    return docs.select(text_of().alias("text")).mapInArrow(run, "kind string, value string").distinct()


def _drawn(rows: DataFrame, key: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [stand_in(k, v, a, key) for k, v, a in zip(*(batch[c].to_pylist() for c in ("kind", "value", "attempt")), strict=True)]
            yield pa.record_batch([batch["kind"], batch["value"], batch["attempt"], pa.array(made, pa.string())], ["kind", "value", "attempt", "surrogate"])

    return rows.select("kind", "value", "attempt").mapInArrow(run, "kind string, value string, attempt int, surrogate string")


def _dense(rows: DataFrame) -> DataFrame:
    """kind, value of the entities in a format of which the corpus has more than a part (FULL) of all values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(k, v, f, room(k, v)) for k, v in zip(batch["kind"].to_pylist(), batch["value"].to_pylist(), strict=True) if (f := form(k, v)) is not None]
            yield pa.record_batch([pa.array([x[i] for x in got], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.int64()))], ["kind", "value", "form", "room"])

    each = rows.select("kind", "value").mapInArrow(run, "kind string, value string, form string, room long")
    full = each.groupBy("kind", "form").agg(F.count(F.lit(1)).alias("n"), F.min("room").alias("room")).where(F.col("n") * FULL > F.col("room"))
    return each.join(full.select("kind", "form"), ["kind", "form"], "left_semi").select("kind", "value")


def _closed(rows: DataFrame) -> DataFrame:
    """The rows (kind, value, attempt) whose format has been walked through and leaves no other value to draw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tried = zip(*(batch[c].to_pylist() for c in ("kind", "value", "attempt")), strict=True)
            got = [(k, n) for k, v, a in tried if k not in GROWS and a - ATTEMPTS >= (n := room(k, v)) - 1]
            yield pa.record_batch([pa.array([k for k, _ in got], pa.string()), pa.array([n for _, n in got], pa.int64())], ["kind", "room"])

    return rows.select("kind", "value", "attempt").mapInArrow(run, "kind string, room long")


def _movable(rows: DataFrame) -> DataFrame:
    """The rows whose format has more than one value; an address such as 0.0.0.0 is nobody's and stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([room(k, v) > 1 for k, v in zip(batch["kind"].to_pylist(), batch["value"].to_pylist(), strict=True)], pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def session_key(docs: DataFrame) -> str:
    return docs.sparkSession.conf.get(KEY_CONF, KEY)


def surrogates(docs: DataFrame, key: str | None = None) -> DataFrame:
    """kind, value, attempt, surrogate: distinct within a kind, never the value itself, and never one that the corpus has unless its format is dense.

    The first draws within a format are a derangement of it, so they are distinct and nobody's own.
    Who holds a free surrogate alone, or is the least of those who share it, keeps it. The others draw
    again, in each round twice as often, until all have one. Where the corpus has more than one in
    FULL values of a format (dates of birth soon, short numbers later), that many others can't be
    free: there the derangement stays, and a surrogate may be what another entity really has. Only a
    format of a single value maps to itself. The key is the caller's, or the session's (KEY_CONF).
    """
    key = key or session_key(docs)
    family = F.split("kind", "-")[0].alias("family")
    drawn = cut(_drawn(cut(entities(docs)).withColumn("attempt", F.lit(0)), key))
    claims = drawn.select(family, F.col("surrogate").alias("name"), F.struct("kind", "value").alias("owner"))
    values = drawn.select(family, F.col("value").alias("name"))
    seen = claims.union(values.withColumn("owner", F.lit(None).cast("struct<kind:string,value:string>"))).groupBy("family", "name").agg(F.min("owner").alias("first"), F.max(F.col("owner").isNull()).alias("real"))
    judged = drawn.withColumns({"family": F.split("kind", "-")[0], "name": F.col("surrogate")}).join(seen, ["family", "name"])
    dense = _dense(drawn).withColumn("dense", F.lit(True))
    judged = judged.join(dense, ["kind", "value"], "left")
    again = (F.col("real") & F.col("dense").isNull()) | (F.struct("kind", "value") != F.col("first"))
    bad = cut(_movable(judged.where(again).select("kind", "value", "attempt")))
    count, wide = bad.count(), 1
    if not count:
        return drawn
    kept = drawn.join(bad.select("kind", "value"), ["kind", "value"], "left_anti").select("kind", "value", "attempt", "surrogate")
    while count:
        none = _closed(bad).first()
        if none:
            raise ValueError(f"no free surrogate: a format of kind {none['kind']} has {none['room']} values, and the corpus and its surrogates take them all")
        tries = bad.withColumn("attempt", F.explode(F.sequence(F.col("attempt") + 1, F.col("attempt") + wide)))
        tries = _drawn(tries, key).withColumns({"family": F.split("kind", "-")[0], "name": F.col("surrogate")})
        taken = values.union(kept.select(family, F.col("surrogate").alias("name")))
        free = tries.join(taken, ["family", "name"], "left_anti").groupBy("family", "kind", "value").agg(F.min(F.struct("attempt", "surrogate")).alias("draw"))
        free = cut(free.select("family", "kind", "value", "draw.attempt", "draw.surrogate"))
        chosen = free.groupBy("family", "surrogate").agg(F.min(F.struct("kind", "value", "attempt")).alias("x")).select("x.kind", "x.value", "x.attempt", "surrogate")
        kept = cut(kept.unionByName(chosen))
        left = bad.join(chosen.select("kind", "value"), ["kind", "value"], "left_anti").join(free.select("kind", "value", F.col("attempt").alias("lost")), ["kind", "value"], "left")
        bad = cut(left.select("kind", "value", F.coalesce("lost", F.col("attempt") + wide).alias("attempt")))
        count = bad.count()
        wide = max(1, min(2 * wide, WIDE // max(1, count)))
    fixed = drawn.join(kept.select("kind", "value"), ["kind", "value"], "left_anti").select("kind", "value", "attempt", "surrogate")
    return cut(kept.unionByName(fixed))


def pseudonymised(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with the entities in text replaced, and n_entities; a text without any is unchanged.

    Null text stays null, with 0 entities. All other columns, and repeated rows, stay as they are.
    Texts are read whole. The draws of a second or later attempt reach their rows by a join on the
    row's text, broadcast only if counted small.
    """
    small_batches(docs.sparkSession)
    key = key or session_key(docs)
    redrawn_of, row_of = fresh(docs, "_redrawn", "_row")
    redrawn = surrogates(docs, key).where("attempt > 0").select("kind", "value", "attempt")
    redrawn = cut(redrawn)
    few = redrawn.count()
    if not few:
        return _replaced(docs.withColumn(redrawn_of, F.lit(None).cast("array<struct<kind:string,value:string,attempt:int>>")), docs, key, redrawn_of)

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted({(row, k, v) for row, text in zip(batch["_row"].to_pylist(), batch["text"], strict=True) for _, _, k, v in found(text.as_py())})
            yield pa.record_batch([pa.array([x[i] for x in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], ["_row", "kind", "value"])

    row = F.xxhash64(text_of()).alias("_row")  # of this inner table; the documents' own is row_of
    where = docs.select(row, text_of().alias("text")).mapInArrow(spots, "_row long, kind string, value string")
    small = F.broadcast(redrawn) if few <= SMALL else redrawn
    by_row = cut(where.join(small, ["kind", "value"]).distinct().groupBy("_row").agg(F.collect_set(F.struct("kind", "value", "attempt")).alias("_redrawn")))
    few_rows = by_row.count() <= SMALL
    by_row = by_row.withColumnsRenamed({"_row": row_of, "_redrawn": redrawn_of})
    by_row = F.broadcast(by_row) if few_rows else by_row
    return _replaced(docs.withColumn(row_of, F.xxhash64(text_of())).join(by_row, row_of, "left").drop(row_of), docs, key, redrawn_of)


def _replaced(rows: DataFrame, docs: DataFrame, key: str, redrawn_of: str) -> DataFrame:
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("n_entities", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[tuple, str] = {}
        for batch in batches:
            texts, sizes = [], []
            for text, redrawn in zip(batch["text"], batch[redrawn_of], strict=True):
                text = text.as_py()
                out, at, n = [], 0, 0
                later = {(x["kind"], x["value"]): x["attempt"] for x in redrawn.as_py() or []}
                for start, end, kind, value in found(text or ""):
                    draw = (kind, value, later.get((kind, value), 0))
                    if draw not in memo:
                        if len(memo) > 100_000:
                            memo.clear()
                        memo[draw] = stand_in(*draw, key)
                    out += [text[at:start], rendered(kind, text[start:end], memo[draw])]
                    at, n = end, n + 1
                texts.append("".join(out) + text[at:] if n else text)
                sizes.append(n)
            columns = [pa.array(texts, pa.string()) if c == "text" else batch[c] for c in names]
            yield pa.record_batch([*columns, pa.array(np.array(sizes, np.int64))], [*names, "n_entities"])

    return rows.select(*names, redrawn_of).mapInArrow(run, schema)
