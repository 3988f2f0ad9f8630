"""Surrogates for personal data: keyed, type-consistent and distinct.

Detected entities are replaced by surrogates of the same kind and format. A surrogate is
a keyed bijection on the entity's own domain (the digits of a phone number, the letters
and digits of an address, the words of a name), of any size, so equal entities get equal surrogates in
all documents (coreference), different ones get different ones, however many there are,
and no table of entities is needed. Check digits are computed anew, and numbers with a
range of valid values stay valid.

Names of any number of words are found by the titles before them. In a document with titled names every other
mention of their words is replaced too. Each word of a name has one surrogate, whatever
the title, the other words or the letter case: a known given name another one of the same
gender and script, any other word one of the same pattern of vowels and consonants with
the same last letter, which is never a known given name. So "Mrs. Anna Smith", "Dr. Anna
Smith", "Ms. Smith" and a bare "Smith" agree. collisions() checks over a corpus that no
two entities share a surrogate.

Cases: null texts stay null, and texts without entities as they are; a surrogate is never
detected as part of a neighbouring entity, since entities are found first and replaced at
once; overlapping finds go to the kind that says more; repeated rows get equal results;
very long texts take time in proportion to their length; null ids and other columns, of
any name, pass through; an empty table gives no rows. A domain of one value (a name of one
letter without company) keeps it.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import secrets
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import isqrt, prod

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sink, free_name, map_batches, quoted, rows

#: Titles that go before a name.
TITLES = (
    "Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Frau", "Mme", "Madame", "Mlle", "Señora", "Sra.", "Doña", "госпожа", "Mr.", "Mr", "Herr", "Monsieur", "Señor", "Sr.", "Don",
    "господин", "Dr.", "Dr", "Prof.", "Professor", "Κυρία", "Κύριος",
)
#: Given names by gender and script; each is replaced by another of its group.
GIVEN = {
    ("f", "latin"): "Ada Alice Amelia Ana Anna Barbara Carla Carmen Charlotte Clara Claire Elena Elizabeth Emily Emma Eva Greta Hanna Helen Ines Isabel Jane Jennifer Julia Karen Laura Lena Linda Lisa Lucia Margaret Maria Marie Marta Mary Nora Olivia Patricia Paula Rita Rosa Ruth Sarah Sofia Sophie Susan Teresa Vera".split(),
    ("m", "latin"): "Adam Albert Anton Bruno Carlos Charles Daniel David Edward Emil Felix Francisco Frank Fritz George Hans Henry Hugo Jack James Jean John Jonas Jorge José Juan Karl Leo Louis Luis Manuel Mark Martin Max Michael Miguel Oscar Otto Paul Pedro Peter Pierre Richard Robert Stefan Thomas Victor William".split(),
    ("", "latin"): "Alex Charlie Dominique Kim Luca Robin Sascha Toni".split(),
    ("f", "cyrillic"): "Анна Вера Елена Ирина Мария Ольга".split(),
    ("m", "cyrillic"): "Антон Иван Лев Олег Павел Юрий".split(),
    ("", "cyrillic"): "Женя Саша Валя".split(),
    ("f", "greek"): "Άννα Ελένη Μαρία Σοφία".split(),
    ("m", "greek"): "Γιώργος Δημήτρης Νίκος Πέτρος".split(),
}
GROUP_OF = {n.lower(): (group, i) for group, names in GIVEN.items() for i, n in enumerate(names)}
#: Letters of names, vowels and consonants of each script.
LETTERS = (
    "aeiouy", "bcdfghjklmnpqrstvwxz", "àáâãäåèéêëìíîïòóôõöøùúûüýÿæœ", "çñšžčćřďťňłśźżðþğş",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "ъь", "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ",
)
LETTER_CLASS = {c: k for k, letters in enumerate(LETTERS) for c in letters}
_UPPER = "".join(c for c in map(chr, range(0x41, 0x530)) if unicodedata.category(c) == "Lu")
_CAPITAL = rf"[{_UPPER}](?:[^\W\d_]+|(?=['’-][^\W\d_]))(?:['’-][^\W\d_]+)*"
_PARTICLES = "(?:(?:van|von|de|der|den|del|la|le|di|da) )*"
_TITLE = "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True))
NAME = re.compile(rf"(?<!\w)(?:(?:{_TITLE})[ \u00a0])+((?:[{_UPPER}]\. ?)*{_PARTICLES}{_CAPITAL}(?: {_PARTICLES}{_CAPITAL})*)")
POSSESSIVE = re.compile(r"['’]s(?!\w)")
WORD = re.compile(rf"(?<![^\W\d_]){_CAPITAL}|(?<!\w)[{_UPPER}]\.")
EMAIL = re.compile(r"(?<![\w.+%-])([A-Za-z0-9][A-Za-z0-9._%+-]*)@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)\.([A-Za-z]{2,})(?![\w-])")
IPV4 = re.compile(r"(?<![\w.])(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})(?![\w]|\.\d)")
PHONE = re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]?\d{3,4}(?!\w)")
LONG_PHONE = re.compile(r"(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?!\w)")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
CARD = re.compile(r"(?<![\w.+-])[2-6]\d{3}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?![\w-])")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
ACCESS = re.compile(r"(?<!\w)(AKIA|ASIA|ghp_|gho_|sk-|xox[bap]-)([A-Za-z0-9_-]{12,})")
IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:])")
#: Ten digits without any mark are a phone number after a word that says so.
BARE_PHONE = re.compile(r"(?i:\b(?:phone|call|tel|telephone|mobile|cell|fax|telefon|teléfono|téléphone)\b[^\d\n]{0,12})(?<![\w+.-])([2-9]\d{9})(?![\w-])")
#: The word may be the last part of a longer name (client_secret, aws_secret_access_key).
ASSIGNED = re.compile(r"(?<![A-Za-z0-9])(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s*[=:]\s*([\"']?)([^\s\"',;]{6,})\1")
#: A quoted hexadecimal string of at least 128 bits is a key or a token, whatever it is assigned to.
QUOTED = re.compile(r"([\"'])([0-9A-Fa-f]{32,128})\1")

#: Hexadecimal strings stay so; short ones are taken as letters and digits, lest the
#: images of other strings fall among theirs.
HEX = re.compile(r"(?=.*\d)(?:[0-9a-f]{16,}|[0-9A-F]{16,})\Z")
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Labels that registries use below country codes; they name nobody.
REGISTRY = frozenset("ac co com edu go gob gov ne net or org".split())


@dataclass(frozen=True)
class Key:
    """The key of all bijections and hashes."""

    secret: bytes

    def number(self, below: int, *parts) -> int:
        """A keyed number below a bound, of as many hashes as the bound and 64 bits more need."""
        message = "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass")
        blocks = range((below.bit_length() + 64) // 256 + 1)
        return int.from_bytes(b"".join(hmac.digest(self.secret, b"%d\x1f" % i + message, "sha256") for i in blocks), "big") % below

    def moved(self, kind: str, value: int, *factors: int) -> int:
        """A keyed permutation of the numbers below the product of factors that is one cycle, so
        none of two values and more stays. Values of a small domain follow each other in a keyed order. In a large one the
        square above it is mixed by alternating rounds, one step is made, and it is unmixed,
        until the value is in the domain."""
        size = prod(factors)
        if size < 2:
            return value
        if size <= SMALL:
            return keyed_cycle(self, kind, size)[value]
        side = isqrt(size - 1) + 1
        rounds = range(6)
        while True:
            a, b = divmod(value, side)
            for r in rounds:
                if r % 2 == 0:
                    a = (a + self.number(side, kind, size, r, b)) % side
                else:
                    b = (b + self.number(side, kind, size, r, a)) % side
            a, b = divmod((a * side + b + 1) % (side * side), side)
            for r in reversed(rounds):
                if r % 2 == 0:
                    a = (a - self.number(side, kind, size, r, b)) % side
                else:
                    b = (b - self.number(side, kind, size, r, a)) % side
            value = a * side + b
            if value < size:
                return value

    def placed(self, kind: str, text: str, alphabets: list[str | None]) -> str:
        """Characters with an alphabet move within it; the others stay."""
        at = [i for i, alphabet in enumerate(alphabets) if alphabet]
        radix = [len(alphabets[i]) for i in at]
        value = 0
        for i, r in zip(at, radix):
            value = value * r + alphabets[i].index(text[i])
        fixed = "".join("\x00" if alphabet else c for c, alphabet in zip(text, alphabets))
        value = self.moved(f"{kind}:{fixed}:{','.join(map(str, radix))}", value, *radix)
        out = list(text)
        for i, r in zip(reversed(at), reversed(radix)):
            value, d = divmod(value, r)
            out[i] = alphabets[i][d]
        return "".join(out)

    def same_format(self, kind: str, text: str, keep: int = 0) -> str:
        """Letters and digits move within their class; other characters and the first
        `keep` letters and digits stay."""
        hexed = HEX.match(text) is not None
        alphabets: list[str | None] = []
        for c in text:
            k = next((k for k, alphabet in enumerate(CLASSES) if c in alphabet), None)
            alphabet = None if k is None else CLASSES[k][:6] if hexed and k else CLASSES[k]
            if alphabet and keep:
                alphabet, keep = None, keep - 1
            alphabets.append(alphabet)
        return self.placed(kind, text, alphabets)


#: Domains up to this size are ordered by the hashes of all their values.
SMALL = 1024


@lru_cache(maxsize=4096)
def keyed_cycle(key: Key, kind: str, size: int) -> list[int]:
    """What follows each value in the keyed order; the first follows the last."""
    order = sorted(range(size), key=lambda v: (key.number(1 << 256, "cycle", kind, size, v), v))
    out = [0] * size
    for v, following in zip(order, [*order[1:], order[0]]):
        out[v] = following
    return out


def walked(step, value, inside):
    """The bijection `step` on the values that are inside as this one is: it goes on until
    it meets one, so values inside have images inside, each its own."""
    kind, value = inside(value), step(value)
    while inside(value) != kind:
        value = step(value)
    return value


def luhn(digits: str) -> int:
    """The check digit of a card number without it."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def is_card(text: str) -> bool:
    digits = "".join(c for c in text if c.isdigit())
    return 13 <= len(digits) <= 19 and luhn(digits[:-1]) == int(digits[-1])


def refill(text: str, digits: str) -> str:
    """text with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in text)


#: First octets of public addresses, for surrogates of public ones.
PUBLIC = tuple(x for x in range(11, 224) if x not in (100, 127, 169, 172, 192, 198, 203))


def iban_check(country: str, body: str) -> str:
    """The check digits of an account number."""
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{98 - number % 97:02d}"


def valid_ssn(digits: str) -> bool:
    """No area 000, 666 or 900 and above, no group 00, no serial 0000."""
    return "000" < digits[:3] < "900" and digits[:3] != "666" and digits[3:5] != "00" and digits[5:] != "0000"


@dataclass
class Surrogates:
    """Makes the surrogate of an entity."""

    key: Key

    def email(self, text: str) -> str:
        local, domain = text.rsplit("@", 1)
        labels = domain.split(".")
        # labels of reserved example domains name nobody and stay; so do registry labels
        named = len(labels) - 1
        if named > 1 and len(labels[-1]) == 2 and labels[-2].lower() in REGISTRY:
            named -= 1
        if labels[-2].lower() == "example":
            named = 0
        kept = [self.key.same_format("domain", x.lower()) for x in labels[:named]] + labels[named:]
        moved = self.key.same_format("email", local)
        return f"{moved}@{'.'.join(kept if named else labels)}"

    def ipv6(self, text: str) -> str:
        """The address, whatever its spelling, moves behind its first two groups. All spellings
        get the shortest one of the surrogate."""
        number = int(ipaddress.IPv6Address(text))
        head = number >> 96
        new = str(ipaddress.IPv6Address(head << 96 | self.key.moved(f"ipv6{head}", number & ((1 << 96) - 1), 1 << 96)))
        return new.upper() if any(c in "ABCDEF" for c in text) else new

    def ip(self, text: str) -> str:
        octets = [int(x) for x in text.split(".")]
        a = octets[0]
        if a in PUBLIC:
            value = ((PUBLIC.index(a) * 256 + octets[1]) * 256 + octets[2]) * 256 + octets[3]
            value = self.key.moved("ip", value, len(PUBLIC) << 24)
            rest = [value >> 16 & 255, value >> 8 & 255, value & 255]
            return ".".join(map(str, [PUBLIC[value >> 24], *rest]))
        value = self.key.moved(f"ip{a}.{octets[1]}", octets[2] * 256 + octets[3], 1 << 16)
        return f"{a}.{octets[1]}.{value >> 8}.{value & 255}"

    def phone(self, text: str) -> str:
        digits = "".join(c for c in text if c.isdigit())
        code = ""
        if text.startswith("+"):
            code = re.match(r"\+(\d{1,3}?)(?=[ .(-]|\d{10}$)|\+(\d)", text)
            code = code[1] or code[2]
        elif len(digits) == 11 and digits[0] == "1":
            code = "1"
        body = digits[len(code) :]
        step = lambda d: f"{self.key.moved(f'phone{len(d)}', int(d), 10 ** len(d)):0{len(d)}d}"
        # ten digits are a number without any mark only if the first is 2 to 9: that stays so
        return refill(text, code + walked(step, body, lambda d: "2" <= d[0]))

    def ssn(self, text: str) -> str:
        step = lambda d: f"{self.key.moved('ssn', int(d), 10**9):09d}"
        return refill(text, walked(step, text.replace("-", ""), valid_ssn))

    def card(self, text: str) -> str:
        digits = "".join(c for c in text if c.isdigit())
        body = digits[:-1]
        n = len(body) - 1
        moved = self.key.moved(f"card{digits[0]}{n}", int(body[1:]), 10**n)
        body = body[0] + f"{moved:0{n}d}"
        return refill(text, body + str(luhn(body)))

    def iban(self, text: str) -> str:
        """The account moves; check digits are right again, or wrong again."""
        plain = text.replace(" ", "")
        country = plain[:2]
        right = lambda n: iban_check(country, n[2:]) == n[:2]
        if right(plain[2:]):
            body = self.key.same_format("iban" + country, plain[4:])
            new = iban_check(country, body) + body
        else:
            new = walked(lambda n: self.key.same_format("wrong" + country, n), plain[2:], right)
        it = iter(country + new)
        return "".join(c if c == " " else next(it) for c in text)

    def secret(self, text: str) -> str:
        return self.key.same_format("secret", text)

    def name(self, text: str) -> str:
        """Each word of a name, without its title; particles between them stay."""
        return WORD.sub(lambda m: self.name_word(m[0]), text)

    def name_word(self, word: str) -> str:
        return "".join(p if i % 2 else self.name_part(p) for i, p in enumerate(re.split("(['’-])", word)))

    def name_part(self, part: str) -> str:
        low = part.lower()
        if low in GROUP_OF:
            group, i = GROUP_OF[low]
            names = GIVEN[group]
            new = names[self.key.moved("given" + "".join(group), i, len(names))]
            return new.upper() if part.isupper() and len(part) > 1 else new.lower() if part.islower() else new

        def step(text: str) -> str:
            ends = len(text) - 1 if len(text) > 2 else len(text)  # the last letter stays
            return self.key.placed("name", text, [LETTERS[LETTER_CLASS[c]] if c in LETTER_CLASS and i < ends else None for i, c in enumerate(text)])

        new = walked(step, low, GROUP_OF.__contains__)
        return "".join(n.upper() if c.isupper() and len(n.upper()) == 1 else n for n, c in zip(new, part)) if len(low) == len(part) else new


def is_ipv6(text: str) -> bool:
    try:
        ipaddress.IPv6Address(text)
    except ValueError:
        return False
    return sum(c.isalnum() for c in text) > 3


def bare(name: str) -> str:
    """A name up to its first possessive ending."""
    return POSSESSIVE.split(name, maxsplit=1)[0]


def names_of(text: str) -> list[tuple[int, int, str]]:
    """Spans of names: those after a title, and the other mentions of their words."""
    titled = [(m.start(1), m.start(1) + len(bare(m[1]))) for m in NAME.finditer(text)]
    if not titled:
        return []
    known = {w[0] for a, b in titled for w in WORD.finditer(text, a, b) if w[0][1:] != "."}
    known |= {w.upper() for w in known}
    found = [(a, b, "name") for a, b in titled]
    return found + [(m.start(), m.start() + len(bare(m[0])), "name") for m in WORD.finditer(text) if bare(m[0]) in known]


def entities(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and kind of each entity, in order, without overlaps. Kinds that say more
    about a span are tried first."""
    found: list[tuple[int, int, str]] = []
    has_digit = any(d in text for d in "0123456789")
    if has_digit or "=" in text or ":" in text:
        found += [(*m.span(2), "secret") for m in ASSIGNED.finditer(text)] if "=" in text or ":" in text else []
        found += [(*m.span(2), "secret") for p in (ACCESS, QUOTED) for m in p.finditer(text)]
    if "@" in text:
        found += [(*m.span(), "email") for m in EMAIL.finditer(text)]
    if has_digit:
        found += [(*m.span(), "iban") for m in IBAN.finditer(text)]
        found += [(*m.span(), "ip") for m in IPV4.finditer(text) if all(int(x) < 256 and (x == "0" or x[0] != "0") for x in m.groups())]
        found += [(*m.span(), "card") for m in CARD.finditer(text) if is_card(m[0])]
        found += [(*m.span(), "ssn") for m in SSN.finditer(text)]
        found += [(*m.span(), "phone") for p in (PHONE, LONG_PHONE) for m in p.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
        found += [(*m.span(1), "phone") for m in BARE_PHONE.finditer(text)]
    if ":" in text:
        found += [(*m.span(), "ipv6") for m in IPV6.finditer(text) if is_ipv6(m[0])]
    if any(t in text for t in TITLES):
        found += names_of(text)
    if len(found) > 1:  # in order of precedence
        taken, kept = bytearray(len(text)), []
        for e in found:
            if 1 not in taken[e[0] : e[1]]:
                taken[e[0] : e[1]] = b"\1" * (e[1] - e[0])
                kept.append(e)
        found = sorted(kept)
    yield from found


def replaced(text: str, surrogates: Surrogates) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with surrogates, and kind, start and end of each in the new text."""
    out, at, size, spans = [], 0, 0, []
    for start, end, kind in entities(text):
        new = getattr(surrogates, kind)(text[start:end])
        size += start - at
        spans.append((kind, size, size + len(new)))
        size += len(new)
        out += (text[at:start], new)
        at = end
    return "".join([*out, text[at:]]), spans


def plain_form(kind: str, text: str) -> str:
    """What entities of a kind that mean the same have in common."""
    if kind in ("card", "ssn"):
        return "".join(c for c in text if c.isdigit())
    if kind == "ipv6":
        return str(ipaddress.IPv6Address(text))
    return text.casefold() if kind in ("name", "email") else text


def collisions(df: DataFrame, key: Key, text_col: str = "text") -> DataFrame:
    """(kind, surrogate, n): surrogates that different entities share; none, if all is well.

    Each distinct entity is one row of two 128-bit digests, combined in the workers and by
    the shuffle; only shared surrogates are left."""
    surrogates = Surrogates(key)
    schema = pa.schema([("kind", pa.string()), ("entity", pa.binary()), ("surrogate", pa.binary())])
    digest = lambda kind, x: hashlib.blake2b(plain_form(kind, x).encode("utf-8", "surrogatepass"), digest_size=16).digest()

    def run(batches):
        sink, seen = Sink(schema), set()
        for (text,) in rows(batches):
            for start, end, kind in entities(text or ""):
                old = text[start:end]
                words = [m[0] for m in WORD.finditer(old)] if kind == "name" else [old]
                for word in words:
                    if (kind, word) not in seen:
                        seen.add((kind, word))
                        sink.add(kind, digest(kind, word), digest(kind, getattr(surrogates, kind)(word)))
            if len(seen) > 200_000:
                seen.clear()
            if sink.full():
                yield sink.take()
        yield sink.take()

    texts = df.select(F.col(quoted(text_col)).cast("string").alias("text"))
    found = map_batches(texts, run, "kind string, entity binary, surrogate binary").distinct()
    return found.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).where("n > 1")


def pseudonymized(df: DataFrame, key: Key, text_col: str = "text") -> tuple[DataFrame, str, str]:
    """The frame with text replaced and two more columns, whose names, which no column of
    the frame begins with, are given too: the number of entities, and their kinds, sorted
    and joined by commas. All other columns pass through."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    surrogates, at = Surrogates(key), df.columns.index(text_col)
    counted, kinded = free_name(df.columns, "__n"), free_name(df.columns, "__kinds")
    schema = StructType([*df.schema.fields, StructField(counted, LongType()), StructField(kinded, StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            texts, counts, kinds = [], [], []
            for text in batch.column(at):
                text = text.as_py()
                new, spans = (None, []) if text is None else replaced(text, surrogates)
                texts.append(new)
                counts.append(len(spans))
                kinds.append(",".join(sorted(k for k, _, _ in spans)))
            columns = [c if i != at else pa.array(texts, pa.string()) for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(
                [c.cast(f.type) for c, f in zip([*columns, pa.array(counts, pa.int64()), pa.array(kinds, pa.string())], arrow)], schema=arrow
            )

    # the workers' side takes columns by place, under names without dots
    sent = df.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(df.columns)])
    return map_batches(sent, run, schema), counted, kinded


#: The session setting that holds the key, as text.
KEY_SETTING = "spark.nucleoframe.pii.key"
_OWN_KEYS: dict[str, Key] = {}


def key_of(spark: SparkSession) -> Key:
    """The key that the session sets. An application that sets none gets a random one, which is
    kept nowhere: its surrogates agree with each other, and nobody can reverse them."""
    text = spark.conf.get(KEY_SETTING, None)
    if text is not None:
        return Key(hashlib.sha256(text.encode()).digest())
    return _OWN_KEYS.setdefault(spark.sparkContext.applicationId, Key(secrets.token_bytes(32)))


def raise_collisions(df: DataFrame, key: Key, text_col: str = "text") -> None:
    """An error if different entities of the corpus share a surrogate."""
    shared = collisions(df, key, text_col).limit(5).collect()
    if shared:
        raise ValueError(f"different entities share surrogates: {[(r.kind, r.n) for r in shared]}")


def pseudonymize(docs: DataFrame, key: Key) -> DataFrame:
    """doc_id, text with surrogates, n_entities and kinds of each row, after the check of
    collisions over all rows."""
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    raise_collisions(held, key)
    out, counted, kinded = pseudonymized(held, key)
    return out.select("doc_id", "text", F.col(counted).alias("n_entities"), F.col(kinded).alias("kinds"))
