"""Personal data and secrets replaced by keyed surrogates of the same type, gender, script and format."""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .common import cut, drop, fresh

#: Fixed lists: given names by gender, by which names without a title are found.
GIVEN = {
    "f": """Anna Maria Sophie Emma Laura Julia Clara Lucia Elena Marta Alice Camille Louise Carla Nora Ines Greta Hannah Olivia Charlotte Amelia Sarah Emily Jessica Elizabeth Jennifer Linda Barbara Susan Mary
        Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия Μαρία Ελένη Κατερίνα Σοφία Άννα""".split(),
    "m": """Paul Peter Thomas Martin Lukas Felix Hugo Louis Pierre Antoine Carlos Diego Javier Pablo Oscar James John Robert Michael William David Richard Joseph Charles Daniel Matthew Anthony George Henry Jack
        Иван Пётр Алексей Дмитрий Сергей Андрей Михаил Николай Владимир Павел Γιώργος Γιάννης Νίκος Κώστας Δημήτρης""".split(),
}
#: Fixed lists: consonants and vowels of invented names, and what ends a given name, by script and gender (x: either).
SOUNDS = {"latin": ("bdfgklmnprstvz", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу"), "greek": ("βγδκλμνπρστ", "αειο")}
ENDINGS = {
    ("latin", "f"): "na la ra ella ina".split(), ("latin", "m"): "ro mus rik ton bert".split(), ("latin", "x"): "ley kim ris bin".split(),
    ("cyrillic", "f"): "на ла рия ша".split(), ("cyrillic", "m"): "ил рей лав кин".split(), ("cyrillic", "x"): "ня ли".split(),
    ("greek", "f"): "να ρα νη".split(), ("greek", "m"): "νος ρης λας".split(), ("greek", "x"): "νι ρι".split(),
}
#: Fixed list: titles and the gender they tell (x: none).
TITLES = {"mr": "m", "herr": "m", "monsieur": "m", "señor": "m", "sr": "m", "господин": "m", "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "madame": "f", "mme": "f", "señora": "f", "sra": "f", "госпожа": "f", "dr": "x", "prof": "x"}
GENDER = {n.lower(): g for g, names in GIVEN.items() for n in names}
#: What is known of a name's gender, as bits that add up over the corpus.
BITS = {"f": 1, "m": 2, "x": 4}
#: Fixed list: country codes of one and of two digits; all others have three.
COUNTRY_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Fixed list: second labels that stand before a country's top-level domain without naming an owner.
SECOND = frozenset("ac co com edu gob gov net ne or org".split())
#: Fixed list: what secrets of known kinds begin with; it tells the kind, and stays.
SECRET_PREFIX = re.compile(r"gh[pousr]_|github_pat_|glpat-|npm_|hf_|AKIA|ASIA|AIza|xox[abeprs]-|sk_(?:live|test)_|sk-(?:proj-|ant-)?|eyJ")

UP, LOW = "A-ZÀ-ÖØ-ÞА-ЯЁΑ-ΩΆ-Ώ", "a-zß-öø-ÿа-яёα-ωά-ώ"
NAME_WORD = rf"(?:[{UP}]['’])?[{UP}][{LOW}]+(?:[-'’]?[{UP}][{LOW}]+)*"
TITLED = re.compile(rf"\b(?P<title>{'|'.join(t.capitalize() for t in TITLES)})\b\.? (?P<names>{NAME_WORD}(?: {NAME_WORD})?)")
_LISTED = sorted((n for v in GIVEN.values() for n in v), key=len, reverse=True)
LISTED = re.compile(rf"\b(?:(?P<given>{'|'.join(_LISTED)}) (?P<surname>{NAME_WORD})|(?P<GIVEN>{'|'.join(n.upper() for n in _LISTED)}) (?P<SURNAME>[{UP}]['’]?[{UP}]+(?:-[{UP}]+)*))\b")
SECRET_WORD = re.compile(r"(?i)\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b\s*[=:]\s*[\"']?(?P<v>[^\s\"',;]{8,})")
#: Letters of addresses: of scripts that put blanks between words, so that an address can stand in running text of others.
IN = "0-9A-Za-z_À-ɏͰ-ϿЀ-ӿ"
PATTERNS = [
    ("pem", re.compile(r"-----BEGIN ([A-Z ]{0,40}PRIVATE KEY)-----[^-]{16,20000}-----END \1-----")),
    ("email", re.compile(rf"(?<![{IN}.+'-])[0-9A-Za-zÀ-ɏͰ-ϿЀ-ӿ][{IN}.%+'-]{{0,63}}@(?:[{IN}][{IN}-]{{0,62}}\.)+[A-Za-zÀ-ɏͰ-ϿЀ-ӿ]{{2,24}}(?![{IN}-])")),
    ("aws", re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b")),
    ("secret", re.compile(r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_\w{22,}|glpat-[\w-]{20,}|npm_[A-Za-z0-9]{36}|hf_[A-Za-z0-9]{30,}|AIza[\w-]{35}|xox[abeprs]-[A-Za-z0-9-]{10,}|sk_(?:live|test)_[A-Za-z0-9]{16,}|sk-(?:proj-|ant-)?[\w-]{20,}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]{10,})\b")),
    ("iban", re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("card", re.compile(r"(?<![\w.+-])\d(?:[ -]?\d){12,18}(?![\w-])")),
    ("ssn", re.compile(r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])")),
    ("phone", re.compile(r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])|(?<![\w.,+-])(?<!\d )0\d{1,4}(?:(?: \d{2,4}){2,4}| \d{5,8})(?![\w-]| \d|[.,]\d)|(?<![\w.,+-])(?<!\d )[2-9]\d{2} \d{3} \d{4}(?![\w-]| \d|[.,]\d)")),
    ("ipv4", re.compile(r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![\w]|\.[0-9])")),
    ("ipv6", re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{3,40}(?![\w:])")),
]
LAYOUT = {"card": re.compile(r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}(?:\1\d{3})?|\d{4}([ -])\d{6}\2\d{4,5}"), "iban": re.compile(r"\w+|\w{4}(?: \w{4})+(?: \w{1,3})?")}
#: A pattern is only sought in texts that hold one of these, or about runs of what its matches are made of: that is cheap to find.
HINTS = {"pem": ["PRIVATE KEY-----"], "email": ["@"], "aws": ["AKIA", "ASIA"], "secret": "ghp_ gho_ ghu_ ghs_ ghr_ github_pat_ glpat- npm_ hf_ AIza xox sk_ sk- eyJ".split(), "ipv6": [":"]}
NUMBERS = re.compile(r"[+(\d][\d .()+-]{6,}")
NUMERIC = ("card", "ssn", "phone", "ipv4")
IBAN_HINT = re.compile(r"[A-Z][A-Z][0-9][0-9]")
TITLE_HINT = re.compile("|".join(t.capitalize() for t in TITLES))
NAME_HINT = re.compile("|".join([*_LISTED, *(n.upper() for n in _LISTED)]))


class Mention(NamedTuple):
    start: int
    end: int
    kind: str
    norm: str
    gender: int = 0


def plain_digits(s: str) -> str:
    """``s`` with the digits of all scripts as those of ASCII."""
    return s if s.isascii() else "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in s)


def luhn(digits: str) -> int:
    """Sum by the Luhn rule; 0 modulo 10 for a valid number."""
    return sum(int(c) if k % 2 == 0 else (2 * int(c) - 9 * (c > "4")) for k, c in enumerate(reversed(digits)))


def iban_valid(s: str) -> bool:
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def valid_part(kind: str, s: str) -> tuple[int, int, str] | None:
    """Start, end and normal form of the card number or IBAN in ``s`` that ends and starts where groups do; None if there is none.

    Of several the first whose groups are laid out as such numbers are goes, or else the longest.
    """
    cuts = [k for k, c in enumerate(s) if c in " -"]
    best = None
    for a in (0, *(k + 1 for k in cuts)):
        for b in (*cuts, len(s)):
            part = s[a:b]
            bare = plain_digits(re.sub("[ -]", "", part))
            if (13 <= len(bare) <= 19 and bare[0] in "23456" and luhn(bare) % 10 == 0) if kind == "card" else (re.match(r"[A-Z]{2}\d{2}", bare) and iban_valid(bare)):
                rank = (LAYOUT[kind].fullmatch(part) is not None, len(bare), -a)
                if best is None or rank > best[0]:
                    best = rank, (a, b, bare)
    return best and best[1]


def ipv6_valid(s: str) -> bool:
    """An address, other than :: and ::1, which tell nobody apart, and names of code such as a::b."""
    if s.endswith(":") and not s.endswith("::") or "::" in s and not re.search(r"\d|[a-fA-F]{4}", s):
        return False
    try:
        return int(ipaddress.IPv6Address(s)) > 1
    except ValueError:
        return False


def script_of(word: str) -> str:
    c = word[0]
    return "cyrillic" if "Ѐ" <= c <= "ӿ" else "greek" if "Ͱ" <= c <= "Ͽ" else "latin"


def registrable(domain: str) -> str:
    """The part of a domain that its owner has registered: the last label before the public suffix, and that suffix."""
    labels = domain.split(".")
    return ".".join(labels[-3 if len(labels) > 2 and labels[-2] in SECOND and len(labels[-1]) == 2 else -2 :])


def detect(text: str) -> list[Mention]:
    """Entities of a whole text, in order and without overlaps; an earlier pattern precedes a later one.

    Digits of any script count. A surname that a title or a listed given name has told is found wherever it stands again in
    the text, and a capitalised word within a sentence right before it as its given name.
    """
    found: list[Mention] = []
    starts: list[int] = []

    def add(start: int, end: int, kind: str, norm: str, gender: int = 0) -> None:
        at = bisect_left(starts, start)
        if (at == 0 or found[at - 1].end <= start) and (at == len(found) or found[at].start >= end):
            found.insert(at, Mention(start, end, kind, norm, gender))
            starts.insert(at, start)

    runs = [(m.start(), m.end()) for m in NUMBERS.finditer(text)]

    def sought(kind: str, pattern: re.Pattern) -> Iterator[re.Match]:
        if kind not in NUMERIC:
            yield from pattern.finditer(text)
        for start, end in runs if kind in NUMERIC else ():
            # What stands around a run decides whether a match is a part of something longer.
            yield from pattern.finditer(text, start, min(len(text), end + 8))

    for kind, pattern in PATTERNS:
        if kind in HINTS and not any(h in text for h in HINTS[kind]) or kind in NUMERIC and not runs or kind == "iban" and not IBAN_HINT.search(text):
            continue
        if kind in ("iban", "card"):
            for start, end in [(0, len(text))] if kind == "iban" else runs:
                end = min(len(text), end + 8)
                m = pattern.search(text, start, end)
                while m:
                    got = valid_part(kind, m[0])
                    if got:
                        add(m.start() + got[0], m.start() + got[1], kind, got[2])
                    # Without one, another number can start at the next group.
                    at = got[1] if got else next((k + 1 for k, c in enumerate(m[0]) if c in " -"), len(m[0]))
                    m = pattern.search(text, m.start() + at, end)
            continue
        for m in sought(kind, pattern):
            s = m[0]
            if kind == "phone":
                digits = "".join(c for c in plain_digits(s) if c in "0123456789")
                if (9 if digits[0] == "0" and s[0] not in "+(" else 7) <= len(digits) <= 15:
                    add(*m.span(), kind, ("+" if s[0] == "+" else "") + digits)
            elif kind == "ipv6":
                s = next((x for x in (s, s[:-1]) if ipv6_valid(x)), None)
                if s:
                    add(m.start(), m.start() + len(s), kind, str(ipaddress.IPv6Address(s)))
            else:
                add(*m.span(), kind, s.lower() if kind == "email" else plain_digits(s))
    for m in SECRET_WORD.finditer(text) if "=" in text or ":" in text else ():
        add(*m.span("v"), "secret", m["v"])
    surnames: set[str] = set()

    def name(start: int, end: int, kind: str, gender: str = "") -> None:
        word = text[start:end]
        add(start, end, f"{kind}-{script_of(word)}", word.lower(), BITS.get(gender, 0))
        if kind == "surname" and len(word) > 2:
            surnames.add(word)

    for m in (TITLED.match(text, h.start()) for h in TITLE_HINT.finditer(text)):
        if m is None:
            continue
        words, at = m["names"].split(" "), m.start("names")
        if len(words) == 2:
            name(at, at + len(words[0]), "given", GENDER.get(words[0].lower(), TITLES[m["title"].lower()]))
        name(m.end("names") - len(words[-1]), m.end("names"), "surname")
    for m in (LISTED.match(text, h.start()) for h in NAME_HINT.finditer(text)):
        if m is None:
            continue
        g, s = ("given", "surname") if m["given"] else ("GIVEN", "SURNAME")
        name(*m.span(g), "given", GENDER[m[g].lower()])
        name(*m.span(s), "surname")
    if surnames:
        again = re.compile(rf"(?:(?<=[^.!?…:\s] )(?P<given>{NAME_WORD}) )?\b(?P<surname>{'|'.join(sorted(map(re.escape, surnames), key=len, reverse=True))})\b")
        for m in again.finditer(text):
            if m["given"] and m["given"].lower() not in TITLES:
                name(*m.span("given"), "given", GENDER.get(m["given"].lower(), "x"))
            name(*m.span("surname"), "surname")
    return found


class Draw:
    """Numbers below a bound from a key and a name, by HMAC-SHA256 in counter mode."""

    def __init__(self, key: bytes, *name):
        self.key, self.name, self.count, self.pool = key, "|".join(map(str, name)).encode("utf-8", "surrogatepass"), 0, 0

    def __call__(self, bound: int) -> int:
        if self.pool < 1 << 64:
            self.pool = self.pool << 256 | int.from_bytes(hmac.new(self.key, self.name + b"|%d" % self.count, hashlib.sha256).digest(), "big")
            self.count += 1
        self.pool, out = divmod(self.pool, bound)
        return out


@cache
def letters_like(c: str) -> str:
    """The letters among which a letter is replaced: those of its script and case."""
    if "a" <= c <= "z" or "ß" <= c <= "ɏ" and c.islower():
        return "abcdefghijklmnopqrstuvwxyz"
    if "A" <= c <= "Z" or "À" <= c <= "ɏ" and c.isupper():
        return "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    if "α" <= c.lower() <= "ω" or "а" <= c.lower() <= "я":
        letters = "αβγδεζηθικλμνξοπρστυφχψω" if c.lower() <= "ω" else "".join(map(chr, range(ord("а"), ord("я") + 1)))
        return letters.upper() if c.isupper() else letters
    first = ord(c) & ~0x3F
    return "".join(x for x in map(chr, range(first, first + 64)) if unicodedata.category(x) == unicodedata.category(c))


def same_form(s: str, draw: Draw, longer: int = 0) -> str:
    """Another string of the same form: digits for digits, letters of the same script and case for letters, hex for hex.

    ``longer`` adds as many symbols like the last letter or digit: short forms have too few strings for very many entities.
    """
    hexed = len(s) >= 12 and re.fullmatch(r"[0-9a-f]+", s) is not None
    s += longer * next((c for c in reversed(s) if c.isalnum()), "a")
    pick = lambda letters: letters[draw(len(letters))]
    return "".join(pick("0123456789abcdef") if hexed else pick("0123456789") if c.isdecimal() else pick(letters_like(c)) if c.isalpha() else c for c in s)


def invented(script: str, draw: Draw, syllables: int, ending: str = "") -> str:
    consonants, vowels = SOUNDS[script]
    return ("".join(consonants[draw(len(consonants))] + vowels[draw(len(vowels))] for _ in range(syllables)) + ending).capitalize()


def settled(bits: int) -> str:
    """The gender of a name by all that is known of it: x if nothing, or if it is both."""
    return "f" if bits & 3 == 1 else "m" if bits & 3 == 2 else "x"


def surrogate(key: bytes, kind: str, norm: str, attempt: int = 0, gender: int = 0) -> str:
    """The replacement of an entity, in its normal form; another for each attempt. Of an e-mail address only the local part
    is replaced: its domain is an entity of its own."""
    draw = Draw(key, kind, norm, attempt)
    # Forms with too few strings grow after some attempts.
    longer = attempt // 4
    if kind == "email":
        local, _, domain = norm.rpartition("@")
        return f"{same_form(local, draw, longer)}@{domain}"
    if kind == "domain":
        label, _, suffix = norm.partition(".")
        return f"{same_form(label, draw, longer)}.{suffix}"
    if kind == "card":
        body = norm[0] + "".join(str(draw(10)) for _ in norm[1:-1])
        return body + str(-luhn(body + "0") % 10)
    if kind == "phone":
        # The country code, or a leading 0, and so what can be dialled, stay.
        code = next((n for n in (1, 2) if norm[1 : 1 + n] in COUNTRY_CODES), 3)
        keep = 1 + code if norm[0] == "+" else 1 if norm[0] == "0" else 0
        return norm[:keep] + "".join(str(2 + draw(8)) if k == keep else str(draw(10)) for k in range(keep, len(norm) + attempt // 32))
    if kind == "ssn":
        return f"{1 + draw(665):03d}-{1 + draw(99):02d}-{1 + draw(9999):04d}"
    if kind == "ipv4":
        first = norm.split(".")[0]
        return ".".join([first if first in ("10", "127", "192") else str(11 + draw(212)), *(str(1 + draw(254)) for _ in range(3))])
    if kind == "iban":
        body = same_form(norm[4:], draw)
        rest = int("".join(str(int(c, 36)) for c in body + norm[:2] + "00")) % 97
        return f"{norm[:2]}{98 - rest:02d}{body}"
    if kind == "ipv6":
        return ":".join(f"{draw(65536):x}" for _ in range(8))
    if kind == "pem":
        head, tail = norm.index("-----", 5) + 5, norm.rindex("-----END")
        return norm[:head] + same_form(norm[head:tail], draw) + norm[tail:]
    if kind.startswith("given"):
        script = kind.split("-")[1]
        ends = ENDINGS[script, settled(gender)]
        return invented(script, draw, 3 + attempt // 8, ends[draw(len(ends))])
    if kind.startswith("surname"):
        return invented(kind.split("-")[1], draw, 4 + attempt // 8)
    known = SECRET_PREFIX.match(norm)
    keep = known.end() if known else 0
    return norm[:keep] + same_form(norm[keep:], draw, 0 if kind == "aws" else longer)


def render(surface: str, kind: str, new: str) -> str:
    """The normal form ``new`` in the layout of ``surface``: its separators, its script's digits, and its letter case."""
    if kind in ("card", "phone", "iban", "ssn", "ipv4"):
        zero = next((ord(c) - unicodedata.decimal(c) for c in surface if c.isdecimal()), 48)
        if kind == "ssn" or kind == "ipv4":
            return "".join(chr(zero + int(c)) if c.isdecimal() else c for c in new)
        rest, out = iter(new.lstrip("+")), []
        for c in surface:
            d = next(rest) if c.isdecimal() or c.isalpha() else c
            out.append(chr(ord(c) - unicodedata.decimal(c) + int(d)) if c.isdecimal() and d.isdecimal() else d)
        return "".join([*out, *rest])
    if kind == "email" and len(new) == len(surface):
        return "".join(n.upper() if c.isupper() else n for c, n in zip(surface, new, strict=True))
    if kind != "pem" and surface.isupper() and not new.isupper() and len(surface) > 1:
        return new.upper()
    return new


def parts(m: Mention) -> list[tuple[str, str]]:
    """What of a mention has a surrogate of its own: of an e-mail address also the domain, so that it stays one in all addresses."""
    return [(m.kind, m.norm), ("domain", registrable(m.norm.rpartition("@")[2]))] if m.kind == "email" else [(m.kind, m.norm)]


def replacement(key: bytes, m: Mention, surface: str, known: dict[tuple[str, str], tuple[int, int]]) -> str:
    """The text in the place of a mention; ``known`` has the attempt and the gender of entities for which these are not the usual."""
    attempt, gender = known.get((m.kind, m.norm), (0, m.gender))
    new = surrogate(key, m.kind, m.norm, attempt, gender)
    if m.kind == "email":
        local, _, domain = new.rpartition("@")
        own = registrable(domain)
        above = domain[: len(domain) - len(own)]
        sub = "".join(f"{same_form(x, Draw(key, 'label', x, own))}." for x in above.split(".")[:-1])
        new = f"{local}@{sub}{surrogate(key, 'domain', own, known.get(('domain', own), (0, 0))[0])}"
    return render(surface, m.kind, new)


def collide(kind: str, norm: str, new: str) -> str:
    """What must be distinct: letter case does not tell entities apart, nor do labels before the domain that is registered."""
    return f"{new.rpartition('@')[0]}@{registrable(norm.rpartition('@')[2])}".lower() if kind == "email" else new.lower()


def entities(mentions: DataFrame) -> DataFrame:
    """Distinct (kind, norm) with all that is known of the gender, and whether that differs between mentions."""
    return mentions.groupBy("kind", "norm").agg(F.bit_or("gender").alias("gender"))


def assign(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, norm, gender, attempt) for each entity: surrogates distinct within a kind, and none an entity of the corpus.

    Every round draws for the entities still without one; of those that draw the same the smallest keeps it. Where many
    rounds are needed the kind's forms grow longer, so that the rounds end.
    """
    draw = pandas_udf(lambda kind, norm, gender, attempt: pd.Series([collide(k, n, surrogate(key, k, n, int(a), int(g))) for k, n, g, a in zip(kind, norm, gender, attempt, strict=True)]), "string")
    pending, done, attempt = found.select("kind", "norm", "gender"), None, 0
    taken = found.select("kind", F.lower("norm").alias("low"))
    while True:
        drawn = cut(pending.withColumn("attempt", F.lit(attempt)).withColumn("low", draw("kind", "norm", "gender", "attempt")), "drawn")
        if attempt:
            drop(pending)
        free = drawn.join(taken, ["kind", "low"], "left_anti")
        won = cut(free.groupBy("kind", "low").agg(F.min(F.struct("norm", "gender", "attempt")).alias("w")).select("kind", "low", "w.norm", "w.gender", "w.attempt"), "won")
        done = won if done is None else done.union(won)
        taken = taken.union(won.select("kind", "low"))
        pending = cut(drawn.join(won, ["kind", "norm"], "left_anti").select("kind", "norm", "gender"), "pending")
        drop(drawn)
        attempt += 1
        if pending.isEmpty():
            return done.select("kind", "norm", "gender", "attempt")
        if attempt > 400:
            raise RuntimeError("entities of one form are nearly all strings of that form")


def replace_entities(docs: DataFrame, key: bytes, count: str | None = None) -> DataFrame:
    """``docs`` with every detected entity in ``text`` replaced; all columns and rows stay.

    ``count`` names a column for the number of entities; one of that name goes. An entity's surrogate depends on the key,
    its type and its normal form, so that it is the same in all documents and in all its layouts; surrogates are checked
    against each other and against all entities of the corpus. Mentions are found once and written; the first draw of
    nearly every entity stands, so each task draws for itself, and only rows with an entity whose draw was repeated, or
    whose gender other mentions tell otherwise, meet the table of those, by a join on the text's hash. Null texts stay null,
    empty ones empty; texts of any length are read whole; repeated rows are replaced alike; rows of null id like any other;
    no rows give no rows; other columns pass through, whatever their names.
    """
    if count == "text":
        raise ValueError("the texts are in the column text")
    docs = docs.drop(count) if count else docs
    names = docs.columns
    at = names.index("text")
    hashed, told = fresh("_mosaique_h", names), fresh("_mosaique_a", names)
    schema = T.StructType([*docs.schema.fields, *([T.StructField(count, T.IntegerType())] if count else [])])

    def mention(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = set()
            for t in batch["text"]:
                if t and (got := detect(t)):
                    h = hashlib.md5(t.encode("utf-8", "surrogatepass")).hexdigest()
                    rows |= {(h, k, n, m.gender) for m in got for k, n in parts(m)}
            yield pd.DataFrame(sorted(rows), columns=["h", "kind", "norm", "gender"])

    mentions = cut(docs.select("text").mapInPandas(mention, "h string, kind string, norm string, gender int"), "mentions")
    found = cut(entities(mentions), "entities")
    again = cut(assign(found, key).where(f"attempt > 0 or not ({' or '.join(f'gender = {b}' for b in (0, *BITS.values()))})"), "again")

    def change(texts: list, known: list[list] | None) -> tuple[list, list]:
        new, n = [], []
        for k, t in enumerate(texts):
            mentions = detect(t) if t else []
            of = {(x["kind"], x["norm"]): (x["attempt"], x["gender"]) for x in known[k] or ()} if known is not None else {}
            pieces, last = [], 0
            for m in mentions:
                pieces += [t[last : m.start], replacement(key, m, t[m.start : m.end], of)]
                last = m.end
            new.append("".join([*pieces, t[last:]]) if mentions else t)
            n.append(len(mentions))
        return new, n

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            known = batch.column(len(names)).to_pylist() if batch.num_columns > len(names) else None
            new, n = change(batch.column(at).to_pylist(), known)
            columns = [pa.array(new, pa.string()) if k == at else batch.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(n, pa.int32())] if count else []), names=schema.names)

    if again.isEmpty():
        return docs.mapInArrow(run, schema)
    # Only texts with such an entity have a row to meet; the texts themselves are shuffled only where these are very many.
    met = mentions.select("h", "kind", "norm").join(again, ["kind", "norm"])
    met = cut(met.groupBy("h").agg(F.collect_set(F.struct("kind", "norm", "attempt", "gender")).alias(told)), "met").withColumnRenamed("h", hashed)
    columns = [F.col(f"`{c}`") for c in names]
    joined = docs.select(*columns, F.md5("text").alias(hashed)).join(met, hashed, "left").select(*columns, told)
    return joined.mapInArrow(run, schema)
