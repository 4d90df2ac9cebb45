"""PII surrogates: keyed, type-consistent replacements for detected entities.

Detected are mail addresses, phone numbers, IPv4 and IPv6 addresses, IBANs, card or account numbers,
national numbers written as 3-2-4 digits, secrets in hexadecimal, tokens with a provider's prefix or after
a word such as "api_key =", and names that follow a form of address; the parts of such a name are found
again wherever they stand in the same text. A surrogate is the next value on a keyed cycle
through all strings of the same form: each character stays in its class (digits, hex digits, vowels and
consonants of its script and case; other scripts by letters and digits), punctuation stays where it is.
A cycle gives distinct entities distinct surrogates, none its own, and the same entity the same one
everywhere, without a table of entities: no shuffle, and no state to lose. Names are replaced part by
part, so that a person is the same by full name, given name or surname. Given names of the gendered
lists go through names of the same gender and script, and other names never become one of those (the
cycle is walked on until the form fits, which keeps it one to one). Card numbers that pass their check
digit go to numbers that pass it, others to others; IBANs get the check digits that fit.

:func:`replace` searches each text once and writes its result, with a keyed digest of each entity and
surrogate; :func:`collisions` then holds these against each other over the whole table. Should two
entities share a surrogate or one stay as it is, the next tweak of the key is taken, and where none is left
it raises. The key comes from the caller; whoever has it can reverse the surrogates.

Defined results: null texts stay null, empty texts empty, texts without entities are unchanged;
entities that differ in letter case alone are one entity (also letters with one capital, as both small
sigmas; not so tokens), and surrogates follow the case; addresses that differ in leading zeros are one;
repeated rows get the same surrogates; columns of any name are handed on; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import ipaddress
import re
import sys
import unicodedata
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palaver.llm import common

#: Used where the session's ``KEY_SETTING`` is unset, as on test tables: it hides nothing from readers of this file.
TEST_KEY, KEY_SETTING = b"palaver surrogate key", "spark.palaver.pii.key"
TWEAKS = 8

#: Given names by script and gender.
NAMES = {
    ("latin", "f"): "Alice Anna Carmen Chloe Clara Elena Emma Eva Greta Hannah Helga Ines Julia Laura Lucia Maria Marie Nina Olga Paula Rosa Sarah Sofia Ursula".split(),
    ("latin", "m"): "Adam Anton Bruno Carlos Daniel David Emil Felix Georg Hans Hugo Ivan Jakob Jean Juan Karl Lukas Marco Max Oscar Otto Paul Peter Thomas".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга Софья Юлия".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Денис Иван Максим Николай Олег Павел Сергей".split(),
}
#: Forms of address by gender.
TITLES = {"f": "Mrs Ms Miss Madam Frau Madame Mme Mademoiselle Señora Sra Doña Госпожа".split(), "m": "Mr Mister Sir Herr Monsieur Señor Sr Don Господин".split(), "": "Dr Prof Professor".split()}

_GENDER = {t.lower(): g for g, titles in TITLES.items() for t in titles}
_KNOWN = {n.lower(): (k, i) for k, names in NAMES.items() for i, n in enumerate(names)}
_LETTERS = r"[^\W\d_]"
_NAME = rf"\b(?P<title>{'|'.join(sorted((t for x in TITLES.values() for t in x), key=len, reverse=True))})\b\.?[ ](?P<name>(?=[^\W\d_a-zà-ÿа-я]){_LETTERS}+(?:[-'’]{_LETTERS}+)*(?:[ ](?=[^\W\d_a-zà-ÿа-я]){_LETTERS}{{2,}}(?:[-'’]{_LETTERS}+)*)?)"
_GAP = r"[^\w\n]{1,6}"
ENTITY = re.compile(
    "|".join(
        (
            r"(?P<email>[A-Za-z0-9][\w.%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,})",
            r"(?P<secret>\b(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,128}\b)",
            r"(?P<ip>(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d))",
            r"(?P<national>(?<![\w.+-])\d{3}-\d{2}-\d{4}(?![\w-]))",
            rf"(?P<phone>(?<![\w+])(?:\+\d{{1,3}}{_GAP})?\(\d{{2,4}}\){_GAP}?\d{{3,4}}{_GAP}?\d{{3,4}}(?!\w)|(?<![\w+])\+\d{{1,3}}(?:[ .-]?\d{{2,4}}){{2,4}}(?!\w)|(?<![\w.+-])\d{{3}}[-. ]\d{{3}}[-. ]\d{{4}}(?!\w))",
            r"(?P<card>(?<![\w.])\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}(?!\w)|(?<![\w.])\d{12,19}(?!\w))",
        )
    )
)
#: Searched before the others, each only where a cheap hint is found; candidates are checked.
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
IPV6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{0,4}:[0-9A-Fa-f:]{2,36}(?![\w:])")
#: Prefixes of tokens as their providers publish them.
TOKEN = re.compile(r"(?<![\w-])(?P<prefix>A[KS]IA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|AIza|[spr]k[-_](?:live[-_]|test[-_]|proj[-_])?|eyJ)(?P<token>(?=[\w.-]*\d)[A-Za-z0-9_.-]{14,}[A-Za-z0-9])")
ASSIGNED = re.compile(r"(?i:api[_-]?key|access[_-]?key|secret|token|password|passwd)[\"']?\s{0,3}[:=]\s{0,3}[\"']?(?P<token>(?=[\w+/.=-]*\d)(?=[\w+/.=-]*[A-Za-z])[A-Za-z0-9+/_=.-]{15,}[A-Za-z0-9+/=])")
_HEX_SECRET = re.compile(r"[0-9a-fA-F]{32,128}")
_TOKEN_HINT = re.compile(r"(?:[AI]A|ey|gh|gl|pat|xox|[spr]k)[\w-]{12}|(?i:key|secret|token|passw)")
_IPV6_HINT = re.compile(r"::|:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:")
NAME = re.compile(_NAME)
_CHEAP = re.compile(r"[0-9@]")

_CLASSES = ["0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåèéêëìíîïòóôõöùúûü", "çñß", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщъь", "αεηιουω", "βγδζθκλμνξπρστφχψ"]
_CLASS_OF = {c: (cls, i) for cls in _CLASSES for i, c in enumerate(cls)}
_HEX = "0123456789abcdef"
_HEX_OF = {c: (_HEX, i) for i, c in enumerate(_HEX)}
_PLAIN_OF = {c: (cls, i) for cls in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") for i, c in enumerate(cls)}


def small(text: str) -> str:
    """Small letters, one for each capital."""
    return text.lower() if text.isascii() else "".join(low if len(up := c.upper()) == 1 and len(low := up.lower()) == 1 else c.lower() for c in text)


@functools.cache
def _scripts() -> dict[tuple[str, str], str]:
    """The letters and digits that no list has, by script (the first word of their names) and kind."""
    found: dict[tuple[str, str], list[str]] = {}
    for c in map(chr, range(128, sys.maxunicode + 1)):
        if c.isalnum() and c not in _CLASS_OF and small(c) == c:
            found.setdefault(_script(c), []).append(c)
    alone = sorted(c for x in found.values() if len(x) == 1 for c in x)
    return {k: "".join(x) if len(x) > 1 else "".join(alone) for k, x in found.items()}


def _script(c: str) -> tuple[str, str]:
    return unicodedata.name(c, "OTHER").split(" ")[0], unicodedata.category(c)


@functools.lru_cache(100_000)
def _class_of(c: str) -> tuple[str, int] | None:
    """A character's class and its place there; None if it stays."""
    if c in _CLASS_OF or not c.isalnum():
        return _CLASS_OF.get(c)
    cls = _scripts()[_script(c)]
    return cls, bisect_left(cls, c)


class Permuter:
    """Keyed cycles; the tweak picks another one."""

    def __init__(self, key: bytes, tweak: int = 0):
        self.key = hashlib.sha256(key + bytes([tweak])).digest()
        self.orders: dict[tuple[str, int], tuple[list[int], list[int]]] = {}

    def _number(self, context: str, round_: int, value: int, modulus: int) -> int:
        digest = hmac.digest(self.key, f"{context}|{round_}|{value:x}".encode(), "sha256")
        while len(digest) * 8 < modulus.bit_length() + 64:
            digest += hmac.digest(self.key, digest, "sha256")
        return int.from_bytes(digest, "big") % modulus

    def _order(self, form: str, n: int) -> tuple[list[int], list[int]]:
        """A permutation of a small range, and its inverse."""
        if (form, n) not in self.orders:
            order = sorted(range(n), key=lambda i: self._number(form, i, 0, 1 << 64))
            places = [0] * n
            for place, i in enumerate(order):
                places[i] = place
            self.orders[form, n] = order, places
        return self.orders[form, n]

    def places(self, values: list[int], sizes: list[int], context: str, step: int = 1) -> list[int]:
        """Tuples with ``values[i] < sizes[i]`` stand on one cycle in a keyed order, that of an alternating
        Feistel network of mixed radix; this is the tuple ``step`` further, another one unless the step is
        a multiple of their number."""
        form = f"{context}|{','.join(map(str, sizes))}"
        if len(values) == 1:
            order, places = self._order(form, sizes[0])
            return [order[(places[values[0]] + step) % sizes[0]]]
        halves = []
        for part in (slice(0, None, 2), slice(1, None, 2)):
            number, modulus = 0, 1
            for v, n in zip(values[part], sizes[part], strict=True):
                number, modulus = number * n + v, modulus * n
            halves.append([number, modulus])
        for r in range(10):
            to, by = halves[r % 2], halves[1 - r % 2]
            to[0] = (to[0] + self._number(form, r, by[0], to[1])) % to[1]
        (a, m), (b, n) = halves
        halves[0][0], halves[1][0] = divmod((a * n + b + step) % (m * n), n)
        for r in reversed(range(10)):
            to, by = halves[r % 2], halves[1 - r % 2]
            to[0] = (to[0] - self._number(form, r, by[0], to[1])) % to[1]
        out = [0] * len(values)
        for (number, _), start in zip(halves, (0, 1), strict=True):
            for i in reversed(range(start, len(values), 2)):
                number, out[i] = divmod(number, sizes[i])
        return out

    def text(self, value: str, context: str, fits=None, class_of=_class_of) -> str:
        """Another string in small letters, each of the class of its character. With ``fits``, strings
        that fit go to strings that fit; the others to the others, by walking on."""
        goal = fits(value) if fits else None
        classes = [class_of(c) for c in value]
        at = [i for i, c in enumerate(classes) if c]
        if not at:
            raise ArithmeticError("nothing here can be replaced")
        numbers, sizes = [classes[i][1] for i in at], [len(classes[i][0]) for i in at]
        context += "|" + "".join(c for c, k in zip(value, classes, strict=True) if not k)
        for step in range(1, 10_001):
            chars = list(value)
            for i, n in zip(at, self.places(numbers, sizes, context, step), strict=True):
                chars[i] = classes[i][0][n]
            out = "".join(chars)
            if out == value:
                break
            if fits is None or fits(out) == goal:
                return out
        raise ArithmeticError("no other string of this form fits")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed([c for c in digits if c.isdigit()])):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _like(case_of: str, text: str) -> str:
    if len(case_of) != len(text):  # from a list: only the first letter and all capitals are told
        return text.upper() if case_of.isupper() and len(case_of) > 1 else text[:1].upper() + text[1:] if case_of[:1].isupper() else text
    return "".join(t.upper() if c.isupper() and len(t.upper()) == 1 else t for c, t in zip(case_of, text, strict=True))


def _iban_check(country: str, rest: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in f"{rest}{country}00")) % 97


def normal(kind: str, value: str) -> str:
    """What makes two mentions the same entity."""
    if kind in ("phone", "card", "national"):
        return ("+" if value.startswith("+") else "") + "".join(c for c in value if c.isdigit())
    if kind == "ip":
        return ".".join(str(int(x)) for x in value.split("."))
    if kind == "ipv6":
        return f"{int(ipaddress.IPv6Address(value)):032x}"
    if kind == "iban":
        return value.replace(" ", "")
    return value if kind == "token" else small(value)


class Surrogates:
    def __init__(self, key: bytes, tweak: int = 0):
        self.by = Permuter(key, tweak)
        self.known: dict[tuple[str, str], str] = {}

    def form(self, kind: str, value: str) -> str:
        """The surrogate of a normal form."""
        by = self.by
        if kind == "email":
            head, _, top = value.rpartition(".")
            return f"{by.text(head, 'email')}.{top}"
        if kind == "secret":
            return by.text(value, "secret", class_of=_HEX_OF.get)
        if kind == "token":
            return by.text(value, "token", class_of=_PLAIN_OF.get)
        if kind == "ip":
            parts = by.places([int(x) for x in value.split(".")], [256] * 4, "ip")
            return ".".join(map(str, parts))
        if kind == "ipv6":  # groups of zeros stay
            groups = [int(value[i : i + 4], 16) for i in range(0, 32, 4)]
            at = [i for i, g in enumerate(groups) if g]
            for i, g in zip(at, by.places([groups[i] - 1 for i in at], [65_535] * len(at), f"ipv6 {at}"), strict=True):
                groups[i] = g + 1
            return "".join(f"{g:04x}" for g in groups)
        if kind == "iban":
            rest = by.text(value[4:], f"iban {value[:2]}", class_of=_PLAIN_OF.get)
            return f"{value[:2]}{_iban_check(value[:2], rest):02d}{rest}"
        if kind == "card":
            return by.text(value, "card", _luhn)
        if kind == "national":
            return by.text(value, "national")
        if kind == "phone":
            head = 0
            if value.startswith("+"):
                head = 1 + max(1, len(value) - 1 - 10)
            return value[:head] + by.text(value[head:], "phone" + value[:head])
        return " ".join(map(self._part, value.split(" ")))

    def _part(self, name: str) -> str:
        hit = _KNOWN.get(name)
        if hit is None:
            return self.by.text(name, "name", lambda x: x in _KNOWN)
        kind, at = hit
        names = NAMES[kind]
        return names[self.by.places([at], [len(names)], f"given {kind}")[0]].lower()

    def of(self, kind: str, value: str) -> str:
        key = normal(kind, value)
        made = self.known.get((kind, key))
        if made is None:
            if len(self.known) > 100_000:
                self.known.clear()
            made = self.known[kind, key] = self.form(kind, key)
        if kind in ("phone", "card", "national"):  # back into the punctuation
            digits = iter(made.lstrip("+"))
            return "".join(next(digits) if c.isdigit() else c for c in value)
        if kind == "iban":
            chars = iter(made)
            return "".join(c if c == " " else next(chars) for c in value)
        if kind == "ipv6":
            groups = [int(made[i : i + 4], 16) for i in range(0, 32, 4)]
            left, _, right = value.partition("::")
            sides = [x.split(":") if x else [] for x in (left, right)]
            parts = [[f"{g:0{len(o)}x}" for g, o in zip(of, side, strict=True)] for of, side in zip((groups[: len(sides[0])], groups[8 - len(sides[1]) :]), sides, strict=True)]
            out = ":".join(parts[0]) + ("::" if "::" in value else "") + ":".join(parts[1])
            return out.upper() if any(c.isupper() for c in value) else out
        if kind.startswith("name"):
            return " ".join(_like(a, b) for a, b in zip(value.split(" "), made.split(" "), strict=True))
        if kind == "secret":  # letters may stand where digits stood
            return made.upper() if value.isupper() else made
        return made if kind in ("ip", "token") else _like(value, made)


def _candidates(text: str) -> list[tuple[str, int, int]]:
    """Entities that a check confirms or a hint leads to."""
    out = []
    for m in IBAN.finditer(text):
        a, b = m.span()
        while b - a >= 15:  # words in capitals may have been taken along
            plain = text[a:b].replace(" ", "")
            if _iban_check(plain[:2], plain[4:]) == int(plain[2:4]):
                out.append(("iban", a, b))
                break
            b = a + max(text[a:b].rfind(" "), 0)
    if _IPV6_HINT.search(text):
        for m in IPV6.finditer(text):
            try:
                if int(ipaddress.IPv6Address(m[0])) >> 16 and any(c.isdigit() for c in m[0]):
                    out.append(("ipv6", *m.span()))
            except ValueError:
                pass
    if _TOKEN_HINT.search(text):
        for pattern in (TOKEN, ASSIGNED):
            for m in pattern.finditer(text):
                plain = pattern is ASSIGNED and _HEX_SECRET.fullmatch(m["token"])
                out.append(("secret" if plain else "token", *m.span("token")))
    return out


def _apart(found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """In order, without those that overlap one found before them."""
    out: list[tuple[str, int, int]] = []
    taken: list[tuple[int, int]] = []
    for kind, a, b in found:
        i = bisect_left(taken, (a, b))
        if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or b <= taken[i][0]):
            taken.insert(i, (a, b))
            out.append((kind, a, b))
    return sorted(out, key=lambda x: x[1])


def _again(text: str, named: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The parts of titled names, wherever they stand: as words of three letters or more where the script
    has capitals; elsewhere names of two or more, which no spaces set off."""
    words, runs, kinds = set(), set(), {}
    for kind, a, b in named:
        for part in text[a:b].split(" "):
            cased = part[:1].lower() != part[:1].upper()
            if len(part) >= (3 if cased else 2):
                (words if cased else runs).add(part)
                kinds.setdefault(part, kind)
                kinds.setdefault(part.upper(), kind)
    if not kinds:
        return []
    longest = lambda x: sorted(map(re.escape, x), key=len, reverse=True)
    forms = [rf"(?<![\w@.-])(?:{'|'.join(longest(words | {w.upper() for w in words}))})(?![\w@])"] if words else []
    return [(kinds[m[0]], *m.span()) for m in re.finditer("|".join(forms + longest(runs)), text)]


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, first character, character after the last) of entities, in order."""
    out = []
    if _CHEAP.search(text):
        out = _candidates(text) + [(m.lastgroup, *m.span()) for m in ENTITY.finditer(text)]
    named = [(f"name{_GENDER[m['title'].lower()]}", *m.span("name")) for m in NAME.finditer(text)]
    return _apart(out + named + _again(text, named)) if named else _apart(out) if out else out


def collisions(found: DataFrame) -> DataFrame:
    """Of rows (kind, entity, surrogate): surrogates that more than one entity has, or that are the entity itself."""
    pairs = found.select("kind", "entity", "surrogate").distinct()
    groups = pairs.groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("entity") == F.col("surrogate")).alias("same"))
    return groups.filter("n > 1 OR same")


def _searched(df: DataFrame, at: int, key: bytes, tweak: int) -> DataFrame:
    """The columns by place with surrogates in the text, ``said`` (kind, place and surrogate of each entity)
    and ``pairs`` (kind, and digests of entity and surrogate)."""
    plain = common.by_place(df)
    schema = ", ".join([*(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(plain.schema)), "said array<struct<kind: string, begin: int, end: int, surrogate: string>>", "pairs array<struct<kind: string, entity: binary, surrogate: binary>>"])
    kinds = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))
    pair_kinds = pa.list_(pa.struct([("kind", pa.string()), ("entity", pa.binary()), ("surrogate", pa.binary())]))
    secret = hashlib.sha256(key + b" digest").digest()
    digest = lambda x: hashlib.blake2b(x.encode(), digest_size=16, key=secret).digest()

    def run(batches):
        makes = Surrogates(key, tweak)

        def one(text):
            found = find(text) if text else []
            if not found:
                return text, [], []
            out, last, size, said, pairs = [], 0, 0, [], set()
            for kind, a, b in found:
                new = makes.of(kind, text[a:b])
                out += [text[last:a], new]
                size += a - last + len(new)
                said.append({"kind": kind, "begin": size - len(new), "end": size, "surrogate": new})
                # the surrogate as it stands in the text, not as it was made
                pairs.add(("name" if kind.startswith("name") else kind, digest(normal(kind, text[a:b])), digest(normal(kind, new))))
                last = b
            return "".join([*out, text[last:]]), said, [{"kind": k, "entity": e, "surrogate": s} for k, e, s in sorted(pairs)]

        for batch in batches:
            for part in (batch.slice(i, 2000) for i in range(0, batch.num_rows, 2000)):
                made = [one(t) for t in part.column(at).to_pylist()]
                columns = list(part.columns)
                columns[at] = pa.array([m[0] for m in made], part.column(at).type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array([m[1] for m in made], kinds), pa.array([m[2] for m in made], pair_kinds)], [*part.schema.names, "said", "pairs"])

    return plain.transform(common.in_batches).mapInArrow(common.lean(run), schema)


def _replaced(df: DataFrame, key: bytes, text_col: str) -> DataFrame:
    """As :func:`_searched`, written, under the first tweak without collisions; an error if there is none."""
    at = df.columns.index(text_col)
    for tweak in range(TWEAKS):
        out = common.materialize(_searched(df, at, key, tweak), "surrogates")
        pairs = out.filter(F.size("pairs") > 0).select(F.explode("pairs").alias("p")).select("p.*")
        if collisions(pairs).limit(1).count() == 0:
            return out
        common.drop(out)
    raise ArithmeticError("entities share a surrogate or stay as they are under every tweak")


def replace(df: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """All columns with surrogates in the text, and ``pii``: kind, first character and character after
    the last in the new text, and surrogate of each entity."""
    return _replaced(df, key, text_col).drop("pairs").toDF(*df.columns, "pii")


def key_of(spark) -> bytes:
    """The key that the session names in ``KEY_SETTING``."""
    found = spark.conf.get(KEY_SETTING, None)
    return found.encode() if found else TEST_KEY


def without_pii(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with surrogates in place of entities."""
    names = docs.columns
    out = _replaced(docs, key_of(spark), "text")
    columns = [F.col(f"c{i}") for i in range(len(names))]
    if "n_chars" in names:
        at, text = names.index("n_chars"), common.place_of(docs, "text")
        columns[at] = F.when(columns[at].isNotNull(), F.char_length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*columns).toDF(*names)


def op8_pii(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace(docs, key_of(spark)).select("doc_id", "text", F.size("pii").cast("long").alias("n_entities"), "pii")
