"""Surrogates for personal data: keyed, of the same type, script, gender and format, distinct and coreferent.

Detected are e-mail addresses, phone and card numbers, IPv4 addresses, social security
numbers, IBANs, long hexadecimal secrets, values that are assigned to a key, token, secret or password and
look drawn (letters and digits), names after a form of address (also in capitals) or an
introduction ('my name is', 'signed by'), and the same names elsewhere in the document. Given names (of a gender) and family names are entities of their own,
so that 'Mr. John Smith', 'Dr. Smith', 'John Smith' and 'Smith' agree. A mention's
canonical form (lower case, digits only) is the entity; its surrogate depends on the key and
the entity alone, and the mention's case and punctuation are kept, so that an entity has one
surrogate in all documents. Digits and letters go through a keyed Feistel network over
positions of their own alphabets, which is a bijection within a format: two entities of a
format can't meet. Card numbers and IBANs that pass their check keep passing it.

What a bijection can't exclude is checked over the whole corpus: a surrogate that two
entities have, or that is itself an entity of the corpus, is drawn again with the next
attempt number. What later attempts draw from grows with the attempt (names and e-mails get
keyed syllables and letters), so that any number of entities is settled. Only entities are
grouped (hot ones are pre-aggregated); texts are not shuffled, unless the table of redrawn
entities by text is too large for Spark to broadcast.

Null texts stay null and have no entities. Ids are never read, so that null and repeated ids
make no difference; repeated rows are all returned, with equal texts. Other columns are kept,
whatever their names; only n_replaced is overwritten. An empty table stays empty.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import cache
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import slices
from .shared import cut

ROUNDS = 6
ENTITIES = "array<struct<kind: string, entity: string>>"

# Forms of address by gender, and names by script and gender.
ADDRESS = {
    "m": "Mr Mister Herr Señor Sr Monsieur Signor Господин",
    "f": "Mrs Ms Miss Frau Señora Sra Señorita Madame Mme Mademoiselle Signora Госпожа",
    "n": "Dr Prof Mx Доктор",
}
GIVEN = {
    ("latin", "m"): "Adrian Bruno Conrad Daniel Emil Felix Gustav Hugo Ivan Julian Karl Leon Marco Nils Oscar Paul Quentin Robert Simon Thomas Ulrich Victor Walter Xavier",
    ("latin", "f"): "Alma Bianca Clara Diana Elena Flora Greta Helena Irene Julia Karin Laura Maria Nora Olivia Paula Rosa Sofia Tina Ursula Vera Wanda Xenia Yvonne",
    ("latin", "n"): "Alex Charlie Dana Eden Finn Gale Jamie Kim Lee Morgan Noel Robin Sam Taylor",
    ("cyrillic", "m"): "Андрей Борис Виктор Григорий Дмитрий Иван Кирилл Лев Максим Николай Олег Павел Роман Сергей",
    ("cyrillic", "f"): "Алла Вера Галина Дарья Елена Зоя Ирина Ксения Лидия Мария Нина Ольга Софья Татьяна",
    ("cyrillic", "n"): "Саша Женя Валя Слава",
}
FAMILY = {
    "latin": "Abbott Becker Castro Duval Engel Fischer Garner Hansen Ibarra Jansen Keller Lambert Moreno Novak Ortega Perrin Quiroga Renner Santos Torres Ullman Vargas Weber Young Zimmer Bennett Carver Dalton Ellis Foster",
    "cyrillic": "Алексеенко Бондаренко Василенко Гнатюк Дорошенко Ефименко Жуковских Захаренко Коваленко Литвиненко Мельник Никитенко Остапенко Петренко",
}  # family names that don't change with gender
#: What names of later attempts are made of: beginnings and endings of syllables, and last syllables by gender.
SYLLABLES = {"latin": ("b d f g h k l m n p r s t v w z", "a e i o u"), "cyrillic": ("б в г д з к л м н п р с т ф", "а е и о у")}
LAST = {
    ("latin", "m"): "bert mund win rik",
    ("latin", "f"): "lina rosa bella dora",
    ("latin", "n"): "ley ren sky lin",
    ("cyrillic", "m"): "слав мир дар бор",
    ("cyrillic", "f"): "лина слава мира дара",
    ("cyrillic", "n"): "ша ля ня ся",
    ("latin", ""): "mann sen ton ger",
    ("cyrillic", ""): "енко ук ых ич",
}

_TITLES = {t: g for g, names in ADDRESS.items() for t in names.split()}
#: Last words of introductions, with what stands before them.
INTRODUCTIONS = {"is": "[Mm]y name ", "by": "[Ss]igned "}
_GIVEN_GENDER = {n: g for (_, g), names in GIVEN.items() for n in names.split()}
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}
_JUNK = r"[^\w\n]{0,7}"
_CAPITALS = r"[A-ZÀ-ÖØ-ÞА-ЯЁ]{2,}(?:-[A-ZÀ-ÖØ-ÞА-ЯЁ]{2,})?"
_NAME = r"[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+(?:-[A-ZÀ-ÖØ-ÞА-ЯЁ][a-zß-öø-ÿа-яё]+)?"
#: Kinds of entities; the first that matches at a place counts.
PATTERNS = {
    "email": r"(?<![\w.+-])[\w+-](?:[\w.+-]{0,62}[\w+-])?@[\w-]{1,63}(?:\.[\w-]{1,63})+",
    "iban": r"(?<![\w])[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]{4}){2,7}(?: ?[A-Za-z0-9]{1,3})?(?![\w])",
    "credential": r"(?:[Kk]ey|KEY|[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD|[Pp]asswd|pwd|PWD)[\"']?\s{0,2}[=:]\s{0,2}[\"']?([\w+/.~-]{12,128})",
    "secret": r"(?<![\w])(?=[a-fA-F]*\d)[0-9a-fA-F]{32,}(?![\w])",
    "phone": rf"(?<![\w])(?:\+\d{{1,3}}{_JUNK}\(?\d{{2,4}}\)?{_JUNK}\d{{3,4}}[-. ]?\d{{3,4}}(?:[-. ]?\d{{2,4}}(?![\d.]))?|\(\d{{3}}\){_JUNK}\d{{3}}[-. ]\d{{4}}|\d{{3}}[-.]\d{{3}}[-.]\d{{4}})(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)",
    "card": r"(?<![\w.-])(?:\d{13,19}|\d{4}(?: \d{4}){2} \d{1,7}|\d{4}(?:-\d{4}){2}-\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w]|[.-]\d)",
    "name": rf"(?<!\w)(?:{'|'.join(sorted(_TITLES, key=len, reverse=True))})\.? {_NAME}(?: {_NAME})?|(?<!\w)(?:{'|'.join(t.upper() for t in sorted(_TITLES, key=len, reverse=True))})\.? {_CAPITALS}(?: {_CAPITALS})?(?!\w)|(?:{'|'.join(f'(?<={before}){word}' for word, before in INTRODUCTIONS.items())}) {_NAME}(?: {_NAME})?",
}
_FIND = re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in PATTERNS.items()))
_WORD = re.compile(rf"(?<!\w){_NAME}(?!\w)")
_ONE = {kind: re.compile(p) for kind, p in PATTERNS.items()}
#: Whatever _FIND matches holds a match of this.
_MAYBE = re.compile(rf"@|\d[\d.]|[0-9a-fA-F]{{32}}|[=:]\s{{0,2}}[\"']?[\w+/.~-]{{12}}|(?<!\w)(?:{'|'.join([*_TITLES, *(t.upper() for t in _TITLES)])})\.? |{'|'.join(f'{before}{word} ' for word, before in INTRODUCTIONS.items())}")


def luhn(digits: str) -> int:
    """The remainder of the checksum; 0 if it is right."""
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10


def iban_rest(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def low(text: str) -> str:
    """Lower case, character by character; what would grow stays."""
    return text.lower() if text.isascii() else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def raised(c: str) -> str:
    """The capital letter of a canonical one, or itself where it has none that leads back."""
    return c.upper() if len(c.upper()) == 1 and low(c.upper()) == c else c


def plain(digits: str) -> str:
    """Decimal digits of any script as ASCII digits."""
    return digits if digits.isascii() else "".join(str(unicodedata.decimal(c)) if c.isdecimal() else c for c in digits)


def like(c: str, digit: str) -> str:
    """An ASCII digit in the script of the digit ``c``."""
    return digit if c.isascii() or not digit.isdecimal() else chr(ord(c) - unicodedata.decimal(c) + int(digit))


def title_gender(title: str) -> str:
    """The gender of a form of address, in capitals or not; introductions tell none."""
    title = title.rstrip(".")
    return _TITLES.get(title) or _TITLES.get(title.capitalize(), "n")


def canonical(kind: str, mention: str) -> str | None:
    """The entity that a mention names, or None where it isn't one after all."""
    if kind in ("phone", "ssn", "card"):
        digits = plain(re.sub(r"\D", "", mention))
        if kind == "card" and len(digits) != 16 and luhn(digits):
            return None
        return digits if kind != "phone" or 9 <= len(digits) <= 15 else None
    if kind == "iban":
        iban = plain(mention.replace(" ", "").upper())
        return iban if 15 <= len(iban) <= 34 and iban_rest(iban) == 1 else None
    if kind == "name":
        title, *names = mention.split(" ")
        gender = title_gender(title)
        names = ["-".join(p.capitalize() for p in n.split("-")) if n.isupper() else n for n in names]
        if gender == "n" and len(names) > 1:
            gender = _GIVEN_GENDER.get(names[0], "n")
        return f"{gender} {' '.join(names)}"
    if kind == "ip":
        octets = mention.split(".")
        return ".".join(str(int(x)) for x in octets) if all(int(x) < 256 and (len(x) < 3 or int(x) > 99) for x in octets) else None
    if kind == "credential":
        if _ONE["secret"].fullmatch(mention):
            return low(mention)
        return mention if len(set(mention)) > 6 and re.search("[0-9]", mention) and re.search("[A-Za-z]", mention) else None
    return low(mention)


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, entity) of the mentions in a text, from left to right."""
    if not _MAYBE.search(text):
        return []
    found, at = [], 0
    while m := _FIND.search(text, at):
        mention = accepted(text, m.start())
        if mention:
            found.append(mention)
        at = mention[1] if mention else m.start() + 1
    return with_untitled(text, found) if any(kind == "name" for _, _, kind, _ in found) else found


def with_untitled(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """The mentions of a text and those of their names without a form of address.

    A given name after a neutral title has the gender that the text's other titles give it. A name
    that the text also has as a word in lower case doesn't count where it stands alone.
    """
    genders, families = {}, {}
    titled = lambda start: title_gender(text[start : text.index(" ", start)])
    for start, _, kind, entity in found:
        gender, *names = entity.split(" ") if kind == "name" else ("",)
        if len(names) > 1:
            genders.setdefault(names[0], {})[titled(start)] = gender
            families.setdefault(names[1], gender)
    given = {}
    for name, by_title in genders.items():
        sure = sorted({"m", "f"} & set(by_title))
        given[name] = sure[0] if len(sure) == 1 else by_title.get("n", by_title.get("m"))
    out = []
    for start, end, kind, entity in found:
        if kind == "name":
            gender, *names = entity.split(" ")
            neutral = titled(start) == "n"
            if names[0] in given and neutral and (len(names) > 1 or names[0] not in families):
                gender = given[names[0]]
            if len(names) == 1 and names[0] in given and names[0] not in families:
                kind = "given"
            elif len(names) == 1:
                families.setdefault(names[0], gender)
            entity = " ".join([gender, *names])
        out.append((start, end, kind, entity))
    edges = [0, *(x for m in out for x in m[:2]), len(text)]
    plain_words = {w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in re.findall(r"\w+", text[a:b])}
    alone = lambda name: name.lower() not in plain_words
    taken, more, at = iter([*out, (len(text), len(text), "", "")]), [], 0
    span, words = next(taken), [(m.start(), m.end(), m.group()) for m in _WORD.finditer(text)]
    for i, (start, end, word) in enumerate(words):
        while span[1] <= start and span[0] < len(text):
            span = next(taken)
        if start < at or end > span[0]:
            continue
        follows = words[i + 1] if i + 1 < len(words) and words[i + 1][0] == end + 1 and text[end] == " " and words[i + 1][1] <= span[0] else None
        if word in given and follows and follows[2] in families:
            more.append((start, follows[1], "name", f"{given[word]} {word} {follows[2]}"))
            at = follows[1]
        elif word in families and alone(word):
            more.append((start, end, "name", f"{families[word]} {word}"))
        elif word in given and alone(word):
            more.append((start, end, "given", f"{given[word]} {word}"))
    return sorted([*out, *more])


def parts(kind: str, entity: str) -> list[tuple[str, str]]:
    """The entities that have surrogates of their own: a name's given and family name, or the entity itself."""
    if kind != "name":
        return [(kind, entity)]
    gender, *names = entity.split(" ")
    return [*(("given", f"{gender} {n}") for n in names[:-1]), ("family", names[-1])]


def accepted(text: str, start: int) -> tuple[int, int, str, str] | None:
    """The mention that begins at a place: the first kind that has a valid one there, at its longest valid end."""
    for kind, pattern in _ONE.items():
        m = pattern.match(text, start)
        if m and kind == "credential":
            if (entity := canonical(kind, m[1])) is not None:  # the value alone; a hexadecimal one is the same entity wherever it stands
                return m.start(1), m.end(1), "secret" if _ONE["secret"].fullmatch(m[1]) else kind, entity
        elif m:
            for end in ends(kind, text, start, m.end()):
                if (entity := canonical(kind, text[start:end])) is not None:
                    return start, end, kind, entity
    return None


def ends(kind: str, text: str, start: int, end: int) -> Iterator[int]:
    """Where a mention whose longest match is given may end: an IBAN as its country says, numbers at any shorter match."""
    if kind == "iban":
        n = IBAN_LENGTHS.get(text[start : start + 2].upper(), 0)
        places = [i for i in range(start, end) if text[i] != " "]
        if n and len(places) >= n and not re.match(r"\w", text[places[n - 1] + 1 : places[n - 1] + 2]):
            yield places[n - 1] + 1
    yield end
    if kind in ("phone", "card"):
        for shorter in range(end - 1, start + 8, -1):
            # the real text must not go on there with a letter or digit, nor with a point or dash and a digit
            if text[shorter - 1].isdecimal() and not re.match(r"\w|[.-]\d", text[shorter : shorter + 2]) and _ONE[kind].fullmatch(text, start, shorter):
                yield shorter


def stream(key: bytes, *parts: str) -> Iterator[int]:
    n = 0
    while True:
        yield from hashlib.blake2b("\x1f".join((*parts, str(n))).encode(), key=key, digest_size=64).digest()
        n += 1


@cache
def _class(c: str) -> tuple[str, str] | None:
    """What a letter or number of the canonical form shares with those that may replace it: category and script."""
    if not c.isalnum() or low(c) != c:
        return None
    category = unicodedata.category(c)
    return category, unicodedata.name(c, "").split(" ")[0] if category[0] == "L" else ""


@cache
def _page(n: int) -> dict[str, str]:
    """The alphabet of each letter and number of 256 code points; classes of few characters are put together."""
    groups: dict = {}
    for c in map(chr, range(n * 256, n * 256 + 256)):
        if (k := _class(c)) and k[0] != "Nd":
            groups.setdefault(k, []).append(c)
    few = [c for g in groups.values() if len(g) < 4 for c in g]
    return {c: "".join(g) for g in [few, *(g for g in groups.values() if len(g) > 3)] for c in g if len(g) > 1}


@cache
def alphabet(c: str) -> str:
    """The characters that may replace this one: digits of its block, letters of its script near it; "" if it stays."""
    for chars in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя"):
        if c in chars:
            return chars
    if not c.isalnum():
        return ""
    if c.isdecimal():
        zero = ord(c) - unicodedata.decimal(c)
        return "".join(map(chr, range(zero, zero + 10)))
    return _page(ord(c) // 256).get(c, "")


def permuted(text: str, key: bytes, tweak: str, alphabets: list[str] | None = None) -> str:
    """A bijection of texts of one format: every letter or digit stays in its alphabet, other characters stay."""
    if alphabets is None:
        # a character that is alone in its class becomes a letter; entities that meet so are drawn again
        text = "".join(c if alphabet(c) or not c.isalnum() else chr(97 + ord(c) % 26) for c in text)
        alphabets = [alphabet(c) for c in text]
    places = [i for i, a in enumerate(alphabets) if a]
    values = [alphabets[i].index(text[i]) for i in places]
    sizes = [len(alphabets[i]) for i in places]
    form = tweak + "|" + ",".join(map(str, sizes)) + ("" if text.isascii() else "|" + "".join(a[0] for a in alphabets if a))
    half = len(places) // 2
    for r in range(ROUNDS):
        moved, other = (range(half, len(places)), range(half)) if r % 2 == 0 else (range(half), range(half, len(places)))
        drawn = stream(key, form, str(r), ",".join(str(values[i]) for i in other))
        for i in moved:
            values[i] = (values[i] + next(drawn) * 256 + next(drawn)) % sizes[i]
    out = list(text)
    for i, v in zip(places, values, strict=True):
        out[i] = alphabets[i][v]
    return "".join(out)


def letters(key: bytes, tweak: str, entity: str, n: int) -> str:
    """``n`` letters that depend on the entity."""
    return "".join(chr(97 + x % 26) for x, _ in zip(stream(key, tweak, "letters", entity), range(n), strict=False))


def named(drawn: Iterator[int], script: str, gender: str, attempt: int) -> str:
    """A name of a gender, or a family name: of the pool at first, then of more syllables with each attempt."""
    pick = lambda pool: pool[(next(drawn) * 256 + next(drawn)) % len(pool)]
    if attempt == 0:
        return pick((GIVEN[script, gender] if gender else FAMILY[script]).split())
    begins, ends = (x.split() for x in SYLLABLES[script])
    return ("".join(pick(begins) + pick(ends) for _ in range(attempt + 1)) + pick(LAST[script, gender].split())).capitalize()


def surrogate(kind: str, entity: str, key: bytes, attempt: int = 0) -> str:
    """The canonical form of the entity's replacement."""
    tweak = f"{kind}{attempt}"
    if kind == "email":
        local, _, domain = entity.rpartition("@")
        labels = domain.split(".")
        few = not any(map(str.isalnum, local + "".join(labels[:-1])))
        more = letters(key, tweak, entity, 4 + attempt if few else attempt - 3)  # short addresses are few
        return f"{permuted(local, key, tweak + domain)}{more}@{'.'.join([permuted('.'.join(labels[:-1]), key, tweak), labels[-1]])}"
    if kind == "secret":
        return permuted(entity, key, tweak, ["0123456789" if c.isdigit() else "abcdef" for c in entity])
    if kind == "ip":
        octets = "".join(chr(int(x)) for x in entity.split("."))
        every = "".join(map(chr, range(256)))
        return ".".join(str(ord(c)) for c in permuted(octets, key, tweak, [every[1:224] if 0 < ord(octets[0]) < 224 else every[:1] + every[224:], every, every, every]))
    if kind == "phone":
        code = 1 if len(entity) == 11 and entity[0] == "1" else max(0, len(entity) - 10)
        first = ["23456789" if c in "23456789" else "01" for c in entity[code : code + 1]]
        return entity[:code] + permuted(entity[code:], key, tweak + entity[:code], first + ["0123456789"] * (len(entity) - code - 1))
    if kind == "card" and luhn(entity) == 0:
        body = permuted(entity[:-1], key, tweak + "luhn")
        return body + str((10 - luhn(body + "0")) % 10)
    if kind == "iban":
        body = permuted(entity[4:], key, tweak + entity[:2])
        return f"{entity[:2]}{98 - iban_rest(entity[:2] + '00' + body):02d}{body}"
    if kind == "name":
        return entity[:2] + " ".join(surrogate(k, e, key, attempt).split(" ")[-1] for k, e in parts(kind, entity))
    if kind in ("given", "family"):
        gender, name = entity.split(" ") if kind == "given" else ("", entity)
        script = "cyrillic" if re.match("[А-Яа-яЁё]", name) else "latin"
        drawn = stream(key, tweak, entity)
        made = "-".join(named(drawn, script, gender, attempt) for _ in name.split("-"))
        return f"{gender} {made}" if gender else made
    return permuted(entity, key, tweak)


def dressed(kind: str, mention: str, made: str) -> str:
    """The canonical surrogate in the mention's case and punctuation."""
    if kind in ("phone", "ssn", "card"):
        digits = iter(made)
        return "".join(like(c, next(digits)) if c.isdecimal() else c for c in mention)
    if kind == "iban":
        made = made if mention.upper() == mention else made.lower()
        letters = iter(made)
        return "".join(c if c == " " else next(letters) if not c.isdecimal() else like(c, next(letters)) for c in mention)
    if kind in ("name", "given"):
        names = made.split(" ")[1:]
        if mention.isupper():
            names = [n.upper() for n in names]
        return " ".join([*mention.split(" ")[: -len(names)], *names])
    if kind == "ip":
        return "".join(like(mention[0], c) for c in made)
    if mention.isupper():
        return "".join(map(raised, made))
    if kind in ("email", "secret") and len(made) == len(mention):
        return "".join(raised(m) if c.isupper() else m for c, m in zip(mention, made, strict=True))
    return made


def replaced(text: str, key: bytes, redrawn: dict[tuple[str, str], int], same: dict[tuple[str, str], str] | None = None) -> tuple[str, int]:
    """(the text with surrogates, how many mentions were replaced); ``same`` has entities that are another of their kind."""
    out, at, found = [], 0, mentions(text)
    for start, end, kind, entity in found:
        made = []
        for k, e in parts(kind, entity):
            e = (same or {}).get((k, e), e)
            made.append(surrogate(k, e, key, redrawn.get((k, e), 0)))
        whole = " ".join([entity[0], *(m.split(" ")[-1] for m in made)]) if kind == "name" else made[0]
        out += [text[at:start], dressed(kind, text[start:end], whole)]
        at = end
    return "".join([*out, text[at:]]), len(found)


#: Two hashes of a text, by which what was found in it is found again: equal texts have equal entities.
DIGEST = ["hash_a", "hash_b"]


def digest(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias(DIGEST[0]), F.xxhash64(text, F.lit(1)).alias(DIGEST[1])]


def entities(docs: DataFrame) -> DataFrame:
    """hash_a, hash_b, kind and entity: each text's entities once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b, text in zip(*(batch.column(c).to_pylist() for c in DIGEST), batch.column("text"), strict=True):
                rows += [(a, b, *x) for x in sorted({p for m in mentions(text.as_py() or "") for p in parts(*m[2:])})]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[*DIGEST, "kind", "entity"])

    text = F.col("text").cast("string")
    return docs.where("text is not null").select(*digest(text), text.alias("text")).mapInArrow(run, "hash_a long, hash_b long, kind string, entity string").distinct()


def drawn(table: DataFrame, key: bytes) -> DataFrame:
    """kind, entity, attempt with made: the canonical surrogate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [surrogate(k, e, key, a) for k, e, a in zip(*(batch.column(c).to_pylist() for c in ("kind", "entity", "attempt")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, "made"])

    return table.select("kind", "entity", "attempt").mapInArrow(run, "kind string, entity string, attempt int, made string")


def attempts(found: DataFrame, key: bytes) -> DataFrame:
    """kind, entity and attempt of the entities whose first surrogate isn't theirs alone.

    Of entities that share a surrogate the smallest keeps it, unless the surrogate is itself
    an entity. Each round draws from a larger space, so that few rounds settle all.
    """
    every = cut(found.select("kind", "entity").distinct().withColumn("attempt", F.lit(0)))
    own = every.select("kind", F.col("entity").alias("made")).withColumn("real", F.lit(True))
    settled = cut(drawn(every, key))
    for attempt in count(1):
        keep = settled.groupBy("kind", "made").agg(F.count("*").alias("many"), F.min(F.struct("attempt", "entity")).alias("first"))
        bad = keep.join(own, ["kind", "made"], "left").where("many > 1 or real")
        again = settled.join(bad, ["kind", "made"]).where("real or entity <> first.entity").select("kind", "entity")
        again = cut(again.withColumn("attempt", F.lit(attempt)))
        if again.limit(1).count() == 0:
            break
        settled = cut(settled.join(again.select("kind", "entity"), ["kind", "entity"], "left_anti").select(*settled.columns).unionByName(drawn(again, key)))
    return settled.where("attempt > 0").select("kind", "entity", "attempt")


def same_given(found: DataFrame) -> DataFrame:
    """entity and target: given names seen after neutral titles that the corpus has with one gender only."""
    seen = found.where("kind = 'given'").select(F.substring("entity", 1, 1).alias("gender"), F.expr("substring(entity, 3)").alias("name")).distinct()
    by_name = seen.groupBy("name").agg(F.array_sort(F.collect_set("gender")).alias("g"))
    one = by_name.where(F.col("g").isin(F.array(F.lit("m"), F.lit("n")), F.array(F.lit("f"), F.lit("n"))))
    return one.select(F.concat(F.lit("n "), "name").alias("entity"), F.concat(F.col("g")[0], F.lit(" "), "name").alias("target"))


def free(names: list[str], name: str) -> str:
    """A column's name that none of the others has."""
    while name.lower() in {n.lower() for n in names}:
        name += "_"
    return name


def anonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with surrogates in text, and n_replaced (mentions)."""
    found = cut(entities(docs))
    given = found.where("kind = 'given'").join(same_given(found), "entity", "left")
    found = cut(found.where("kind <> 'given'").withColumn("target", F.col("entity")).unionByName(given.withColumn("target", F.coalesce("target", "entity"))))
    redrawn = attempts(found.select("kind", F.col("target").alias("entity")), key).withColumnRenamed("entity", "target")
    special = found.join(redrawn, ["kind", "target"], "left").where("attempt is not null or target <> entity")
    drawn_again = F.collect_list(F.struct("kind", "entity", "target", F.coalesce("attempt", F.lit(0)).alias("attempt")))  # of one text
    docs = docs.drop("n_replaced")
    names = docs.columns
    own = [free(names, x) for x in (*DIGEST, "redrawn")]
    special = cut(special.groupBy(*DIGEST).agg(drawn_again.alias("redrawn"))).toDF(*own)
    keyed = docs.withColumns(dict(zip(own, digest(F.col("text").cast("string")), strict=False)))
    rows = keyed.join(special, own[:2], "left").select(*names, own[2])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for text, special in zip(part.column("text").to_pylist(), part.column(own[2]).to_pylist(), strict=True):
                    redrawn = {(x["kind"], x["target"]): x["attempt"] for x in special or ()}
                    same = {(x["kind"], x["entity"]): x["target"] for x in special or ()}
                    out.append((None, 0) if text is None else replaced(text, key, redrawn, same))
                texts, many = zip(*out, strict=True)
                columns = [pa.array(texts, part.schema.field("text").type) if n == "text" else part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(many, pa.int64())], names=[*names, "n_replaced"])

    return rows.mapInArrow(run, f"{schema}, n_replaced long")
