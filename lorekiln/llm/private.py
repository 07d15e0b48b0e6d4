"""Personal information inside free text: detection, typed placeholders and keyed surrogates."""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorekiln.session import cut

KINDS = ("email", "address", "phone", "id_number", "name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}

#: Capitals of the Latin, Cyrillic and Greek scripts.
U = "A-ZÀ-ÖØ-ÞА-ЯЁΆΈ-ΏΑ-ΡΣ-Ϋ"
M = "̀-ͯ"
CAP = rf"[{U}](?:[\w{M}]|['’](?=\w))+(?:[-‐][{U}](?:[\w{M}]|['’](?=\w))+)*"
INITIAL = rf"[{U}][{M}]?\."
GAP = r"(?:[  ]|[ ]?\n[ ]?)"
#: Particles within surnames.
PARTICLE = rf"(?:(?:de{GAP}la|de{GAP}las|de{GAP}los|del|de|da|das|do|dos|di|van|von|DE{GAP}LA|DE{GAP}LOS|DEL|DE|DA){GAP})"
SEQUENCE = re.compile(rf"(?:{CAP}|{INITIAL})(?:{GAP}{PARTICLE}?(?:{CAP}|{INITIAL})(?![\w{M}@]))*")
UNIT = re.compile(rf"({PARTICLE})?({CAP}|{INITIAL})")
INVERTED = re.compile(rf",{GAP}({CAP}(?:[ ](?:{CAP}|{INITIAL}))*)")
PARTICLE_END = re.compile(rf"(?<!\w){PARTICLE}$")

#: Titles, which aren't part of a name, and labels of forms.
TITLES = set("mr mrs ms miss dr dra sr sra srta prof rev hno hna fr bro brother sister bishop elder president father mother don doña dona hermano hermana obispo élder presidente señor señora padre madre tío tía uncle aunt señorita doctor doctora".split())
SHORT_TITLES = set("mr mrs ms dr dra sr sra srta prof rev hno hna fr bro pres".split())
LABELS = set("name nombre id documento document home domicilio phone teléfono telefono tel email correo mail address dirección direccion from de to para re fax móvil movil mobile dni passport pasaporte cell".split())
LABEL_BEFORE = re.compile(r"(?:[—–]\s?|(?:Name|Nombre|From|De|To|Para|Nom|Nome)\s?:\s?)$")
#: Words that open sentences or join them and are no given names.
FUNCTION = set(
    "a an the this that these those in on at of to for from with by and or but if when while after before as then there here who what why how where which it he she they we you i my our his her its their is are was were have has had do does did no not nobody nothing some many all every each one two both perhaps however even so little let remember between during kindly please visitors your "
    "see write reports copies send ask call tell according bread hymn room passport membership shelfmark catalogue record lesson meeting early "
    "el la los las un una unos unas este esta estos estas ese esa en de del al a con por para sin sobre y e o u pero si cuando mientras después antes como que quien quién qué cómo dónde no ni nada nadie algunos muchos todo todos cada ambos quizás sin aun así poco entre durante según al mi su sus nuestro lo le les se es son fue era hay ha han "
    "véase vea escriban escriba escríbanme envíen pregunten pueden visitamos doy agradezco encontramos donde hasta el himno sala cédula pasaporte ficha lección reunión signatura catálogo obispo calle "
    "le les la un une des du au aux ce cette ces dans sur sous avec sans pour par et ou mais si quand comme qui que ne pas il elle nous vous ils à o os as um uma no na nos nas do da dos das ao à com sem para por se quando mas não".split()
)
#: Words of places, rooms and books that may carry a family's name.
PLACES = set(
    "room hall house library chapel street st lane ln avenue ave road rd row green court ct bridge school park centre center building wing garden gardens square church temple museum gallery press papers letters reading fund prize collection institute college hospital station farm mill valley river lake mount mountain city town county foundation award trust society "
    "sala salón salon biblioteca capilla calle avenida avda plaza paseo pasaje camino carretera casa puente escuela parque centro edificio jardín jardin iglesia templo museo galería cartas papeles premio fondo colección instituto colegio hospital estación finca molino valle río lago monte ciudad fundación aula auditorio".split()
)
BOOK_AFTER = re.compile(r"[ ]\d{1,3}(?::|,[ ])\d")

STREET = r"(?:Street|St\b\.?|Avenue|Ave\b\.?|Road|Rd\b\.?|Lane|Ln\b\.?|Court|Ct\b\.?|Row\b|Green\b|Drive|Dr\b\.?|Way\b|Place|Pl\b\.?|Square|Sq\b\.?|Terrace|Close\b|Crescent|Boulevard|Blvd\b\.?|Parkway|Hill\b|Walk\b|Circle)"
NUMBERED = re.compile(rf"\d{{1,5}}[A-Za-z]?\s(?:(?:[NSEW]\.|North|South|East|West)\s)?(?:{CAP}\s){{1,4}}?{STREET}(?!\w)")
GRID = re.compile(r"\d{1,4}\s(?:[NSEW]\.?|North|South|East|West)\s\d{2,4}(?:\s\d{2,4})?(?:\s(?:[NSEW]\b\.?|North|South|East|West))?(?!\w)")
DOOR = re.compile(rf"(?:(?:Flat|Apt|Unit|Suite|Ste|Apartment|Room|Floor|No)\b\.?\s#?\d+\w?,\s|(?:{CAP}[ ]){{1,2}}(?:House|Cottage|Villa|Court|Lodge),\s){{1,2}}$")
BOX = re.compile(r"(?:Rural\sRoute\s\d+,\sBox\s\d+|R\.\s?R\.\s\d+,\sBox\s\d+|(?:P\.\s?O\.|PO|Post\sOffice)\sBox\s\d+|(?:Apartado(?:\sde\s[Cc]orreos)?|Apdo\.?|Casilla(?:\sde\s[Cc]orreo)?)\s\d+)")
BOX_CUES = ("Box", "Apartado", "Apdo", "Casilla")
NUMBER_ES = r"(?:,?\s(?:n\.?\s?[º°o]\.?\s|núm\.\s|#)?\d{1,4}(?!\w|:\d)(?:-\d+)?(?:,\s\d{1,2}\.?[º°ª]\s?\w{0,4})?|,?\ss/n)"
STREET_ES = re.compile(rf"(?:(?:[Cc]alle|C/|[Aa]venida|Avda\.?|Av\.|[Pp]laza|Pza\.?|Plza\.?|[Pp]asaje|Pje\.?|[Pp]aseo|Pº|[Cc]amino|[Cc]arretera|Ctra\.?|[Cc]allejón|[Rr]onda|[Tt]ravesía|[Jj]irón|[Cc]arrera|Rua|Rue)\s(?:(?:de\sla|de\slos|de\slas|del|de|da|do|des|du)\s)?{CAP}(?:\s(?:(?:de\sla|de\slos|de\slas|del|de|y)\s)?{CAP}){{0,4}}{NUMBER_ES}|Km\.?\s\d+(?:,\d)?,\s(?:carretera|camino|ctra\.)\s(?:(?:de\sla|de\slos|de\slas|del|de)\s)?{CAP}(?:\s(?:(?:de\sla|de\slos|de\slas|del|de)\s)?{CAP}){{0,3}})")
STREET_CUES = ("Calle", "calle ", "C/", "Aven", "aven", "Avda", "Av.", "laza", "Pza", "Plza", "asaje", "Pje", "Paseo", "paseo ", "Pº", "Camino", "Carretera", "Ctra", "Ronda", "ravesía", "Jirón", "jirón", "Carrera", "Km", "Rua ", "Rue ")
STREET_CUE = re.compile(r"[Cc]alle|C/|[Aa]ven|Av|[Pp]laza|P[zl]*za|[Pp]asaje|Pje|[Pp]aseo|Pº|[Cc]amino|[Cc]arrete|Ctra|[Rr]onda|[Tt]ravesía|[Jj]irón|[Cc]arrera|Km|Ru[ae]")

PHONE = re.compile(r"(?:\+\d{1,3}[ .-]?\(?\d{2,4}\)?(?:[ .-]?\d{2,4}){1,4}|\+\d{1,3} \d{6,10}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|\d{3} \d{3} \d{4}|00\d{3}-\d{2}-\d{4}|0\d{4} \d{6}|0\d{2} \d{4} \d{4}|\d{3}-\d{4}|\d{10})(?:,? (?:ext|int|x)\.? ?\d{1,5})?(?![\w-]|[.,]\d)")
NO_PHONE_BEFORE = re.compile(r"(?:Hymn|Himno|himno|hymn|ISBN|MS|box|caja|No\.|núm\.|n\.º|Psalm|Salmo|p\.|pp\.)\s?$")
IDS = re.compile(r"(?:\d{3}-\d{2}-\d{4}|\d-\d{3}-\d{4}|\d{3}-\d{4}-\d{3}[\dA-Z]|\d{2}\.\d{3}\.\d{3}-?[\dA-Z]|\d{7,8}-?[A-Z]|[A-Z]{1,3}\d{6,9}[A-Z]?|[A-Z]{4}\d{6}[HMX][A-Z]{5}[A-Z\d]\d)(?![\w-])")
NO_ID_BEFORE = re.compile(r"(?:ISBN|ISSN|MS|box|caja|Hymn|Himno|himno)\s?(?:[\w-]+,?\s)?$")
DIGITS = re.compile(r"\d+")
AT = re.compile(r"\s?(?:@|\[@\]|\(@\)|\((?:at|arroba)\)|\[(?:at|arroba)\])\s?|\s(?:arroba|AT|at|ARROBA)\s")
DOT = r"(?:\.|\[\.\]|\(\.\)|\s?\((?:dot|punto)\)\s?|\s?\[(?:dot|punto)\]\s?|\s(?:dot|punto|DOT|PUNTO)\s)"
LOCAL = re.compile(rf"[\w{M}](?:[\w{M}+%'-]|\.(?=\w)|\[\.\])*$")
DOMAIN = re.compile(rf"[\w-]+(?:{DOT}[\w-]+)+")
AT_CUES = ("@", "(at)", "[at]", "arroba", "ARROBA")
#: Figures in words.
FIGURES = "zero oh one two three four five six seven eight nine cero uno dos tres cuatro cinco seis siete ocho nueve".split()
SPOKEN = re.compile(rf"(?<!\w)(?:{'|'.join(FIGURES)})(?:[ ,-]+(?:{'|'.join(FIGURES)})){{6,}}(?!\w)", re.I)
FIGURE_CUES = set(FIGURES) - {"one", "uno", "two", "dos", "oh"}


def _emails(t: str) -> Iterator[tuple[int, int]]:
    last = 0
    for m in AT.finditer(t):
        if m.start() < last:
            continue
        left = LOCAL.search(t, max(last, m.start() - 80), m.start())
        right = DOMAIN.match(t, m.end())
        if not left or not right:
            continue
        if m.group().strip().lower() in ("at", "arroba") and not re.search(r"\s(?:dot|punto)\s", right.group(), re.I):
            if m.group().strip().lower() == "at" or not re.match(r"[\w-]+\.[\w.-]+", right.group()):
                continue
        last = right.end()
        yield left.start(), last


def _by_digits(t: str) -> Iterator[tuple[str, int, int]]:
    """Addresses, phone and identity numbers that begin with a figure, or with the sign or capitals right before it."""
    last = 0
    for m in DIGITS.finditer(t):
        a = m.start()
        if a < last:
            continue
        prev = t[a - 1] if a else " "
        if prev in "+(":
            a -= 1
        elif prev.isalpha():
            while a and t[a - 1].isupper() and m.start() - a < 4:
                a -= 1
        if a and (t[a - 1].isalnum() or t[a - 1] in ".,:#/-+_"):
            continue
        if a == m.start():
            street = NUMBERED.match(t, a) or GRID.match(t, a)
            if street:
                door = DOOR.search(t, max(0, a - 60), a)
                last = street.end()
                yield "address", (door.start() if door else a), last
                continue
        if m.end() - a > 1 or t[m.end() : m.end() + 1] == "-":
            phone = PHONE.match(t, a)
            if phone and not NO_PHONE_BEFORE.search(t, max(0, a - 10), a):
                last = phone.end()
                yield "phone", a, last
                continue
            number = IDS.match(t, a)
            if number and not NO_ID_BEFORE.search(t, max(0, a - 14), a):
                last = number.end()
                yield "id_number", a, last


def _folded(w: str) -> str:
    return w if w.isascii() else unicodedata.normalize("NFC", w)


def _is_title(w: str) -> bool:
    w = _folded(w).lower()
    return w[:-1] in SHORT_TITLES if w.endswith(".") else w in TITLES


def _titled(before: str) -> bool:
    if before[-1:] not in (" ", "\n", "\u00a0"):
        return False
    last = before.split()[-1:] or [""]
    if _is_title(last[0]):
        return True
    if last[0].lower() in ("la", "el", "del", "los", "las", "de") and (particle := PARTICLE_END.search(before)):
        last = before[: particle.start()].split()[-1:]
        return bool(last) and _is_title(last[0])
    return False


def _names(t: str, public: frozenset[str]) -> Iterator[tuple[int, int]]:
    """Names in a text whose other finds are blanked."""
    for m in SEQUENCE.finditer(t):
        one = m.group()
        if one in public or one.lower() in FUNCTION:
            continue
        a, z = m.span()
        prev = t[a - 1] if a else "\n"
        if prev.isalnum() or prev in "@-_‐" or (z < len(t) and (t[z].isalnum() or t[z] == "@")):
            continue
        before = t[max(0, a - 16) : a]
        titled = _titled(before)
        if " " not in one and "\n" not in one and not titled and t[z : z + 1] != ",":
            if prev not in "\n —–:" or not LABEL_BEFORE.search(before) or not re.match(r"\s*(?:\n|$|[;|<(])", t[z : z + 4]):
                continue
        units = [(u.start(2) if not u.group(1) else u.start(), u.start(2), u.end(2)) for u in UNIT.finditer(t, a, z)]
        words = [_folded(t[x:y]) for _, x, y in units]
        while words and (words[0].lower() in FUNCTION or words[0].lower().rstrip(".") in TITLES or words[0].lower().rstrip(".") in LABELS or (len(words) > 1 and words[0] in public and not words[0].isupper())):
            titled = words[0].lower().rstrip(".") in TITLES
            units, words = units[1:], words[1:]
        # a label on the next line ends the sequence; a line that is a whole name isn't continued by the next one
        for i in range(1, len(units)):
            if "\n" in t[units[i - 1][2] : units[i][0]]:
                line = t[t.rfind("\n", 0, units[0][1]) + 1 : units[0][1]]
                alone = i >= 2 and len(words) - i >= 2 and (not line.strip() or LABEL_BEFORE.search(line))
                if words[i].lower().rstrip(".") in LABELS or words[i].lower() in FUNCTION or words[i] in public or alone or (t[units[-1][2] : units[-1][2] + 1] == ":" and i == len(units) - 1):
                    units, words = units[:i], words[:i]
                    break
        while words and (words[-1].lower() in FUNCTION or words[-1].lower().rstrip(".") in TITLES or words[-1].lower() in LABELS or (len(words[-1]) <= 3 and words[-1][-1] == ".")):
            units, words = units[:-1], words[:-1]
        if not words:
            continue
        start, end = units[0][1], units[-1][2]
        before = t[max(0, start - 16) : start]
        titled = titled or _titled(before)
        if any(w.lower() in PLACES for w in words) or BOOK_AFTER.match(t, end):
            continue
        whole = " ".join(_folded(t[start:end]).split())
        if whole in public or words[-1] in public or " ".join(words[-2:]) in public:
            continue
        after = re.match(r"\s(\w+)", t[end : end + 24])
        before_word = re.search(r"(\w+)\s$", before)
        if (after and before_word and after.group(1).lower() in PLACES and before_word.group(1).lower() in ("the", "la", "el", "a", "del", "al")) or (before_word and before_word.group(1).lower() in PLACES):
            continue
        particle = PARTICLE_END.search(before)
        if particle and _titled(before[: particle.start()]):
            start -= len(particle.group())
        labelled = LABEL_BEFORE.search(before) is not None
        inverted = INVERTED.match(t, end)
        if inverted and len(words) <= 3 and (titled or labelled or len(words) == 1 or before.endswith((", ", ",\n"))):
            given = [_folded(w) for w in inverted.group(1).split()]
            closed = re.match(r"\s*(?:$|\n|[;|<(.,])|\s[^A-ZÀ-Þ\s]", t[inverted.end() : inverted.end() + 3] or "\n")
            if closed and not any(w in public or w.lower() in FUNCTION or w.lower() in PLACES or w.lower() in LABELS for w in given):
                if particle and not titled:
                    start -= len(particle.group())
                yield start, inverted.end()
                continue
        named = len(words[-1]) > 1 and words[-1][-1] != "." and (len(words) >= 2 or titled or (labelled and len(words[0]) > 3))
        if named:
            yield start, end


def spans(t: str, public: frozenset[str]) -> list[tuple[str, int, int]]:
    """(kind, start, end) in order and without overlaps; where kinds meet, the earlier of KINDS wins."""
    out: list[tuple[str, int, int]] = []

    def add(kind: str, a: int, b: int) -> None:
        if all(b <= x or a >= y for _, x, y in out):
            out.append((kind, a, b))

    if any(c in t for c in AT_CUES) or (" dot " in t and " at " in t):
        for a, b in _emails(t):
            add("email", a, b)
    if any(c in t for c in BOX_CUES):
        for m in BOX.finditer(t):
            if m.start() == 0 or not t[m.start() - 1].isalnum():
                add("address", *m.span())
    for cue in STREET_CUE.finditer(t) if any(c in t for c in STREET_CUES) else ():
        if cue.start() == 0 or not t[cue.start() - 1].isalnum():
            if m := STREET_ES.match(t, cue.start()):
                add("address", *m.span())
    for k, a, b in _by_digits(t):
        add(k, a, b)
    if not FIGURE_CUES.isdisjoint(t.lower().split()):
        for m in SPOKEN.finditer(t):
            add("phone", *m.span())
    rest = t
    if out:
        parts, at = [], 0
        for _, a, b in sorted(out, key=lambda x: x[1]):
            parts += [t[at:a], "\x00" * (b - a)]
            at = b
        rest = "".join([*parts, t[at:]])
    for a, b in _names(rest, public):
        add("name", a, b)
    return sorted(out, key=lambda x: x[1])


#: Syllables of invented names. No onset begins with a coda, so that different syllables never spell the same name.
ONSETS, VOWELS, CODAS = "b br c cl d dr f g gr j m p t tr v z".split(), "aeiou", ["", "n", "r", "l", "s"]
SYLLABLES = [o + v + c for o in ONSETS for v in VOWELS for c in CODAS]
ENDINGS = {"f": [o + "a" for o in ONSETS], "m": [o + v for o in ONSETS for v in ("o", "an", "el", "en", "in", "or")]}
#: The letters of the syllables in other scripts, one for one.
SCRIPTS = {
    "cyrillic": str.maketrans("abcdefgijlmnoprstuvz", "абкдефгижлмнопрстувз"),
    "greek": str.maketrans("abcdefgijlmnoprstuvz", "αβκδεφγιχλμνοπρστυξζ"),
}
#: Titles that tell a person's gender, and given names whose ending doesn't.
TITLE_GENDER = dict.fromkeys("mr sr hno bro brother father don hermano obispo señor padre tío uncle".split(), 1) | dict.fromkeys("mrs ms miss sra srta hna sister mother doña hermana señora madre tía aunt señorita dra doctora".split(), -1)
NOT_BY_ENDING = dict.fromkeys("joshua luca elisha ezra nikita borja bautista andrea micah noah jonah isaiah jeremiah никита илья лука фома кузьма".split(), "m") | dict.fromkeys(
    "carmen isabel ruth esther raquel mercedes dolores pilar rocio consuelo rosario luz beatriz ines elizabeth margaret susan karen jennifer alice anne grace helen jane joan kate mary nancy rachel sarah hannah leah любовь".split(), "f"
)
FEMININE = re.compile(r"(?:a|ette|elle|ine|ia|yn|а|я|α|η)$")


FIGURES_EN, FIGURES_ES = FIGURES[:1] + FIGURES[2:11], FIGURES[11:]
VALUE = {w: d for names in (FIGURES_EN, FIGURES_ES) for d, w in enumerate(names)} | {"oh": 0}
FIGURE = re.compile(rf"(?<!\w)(?:{'|'.join(FIGURES)})(?!\w)", re.I)
ADDRESS_NAME = re.compile(rf"(?<=\s)(?!{STREET})({CAP})(?=\s{STREET}|,|\s\d)")


def _draw(key: bytes, *parts: str) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(parts).encode(), hashlib.sha256).digest()[:8], "big")


def _cased(new: str, old: str) -> str:
    return new.upper() if old.isupper() and len(old) > 1 else new.lower() if old.islower() else new


def _plain(w: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", w.lower()) if not unicodedata.combining(c))


def gender_of(plain: str, votes: int) -> str:
    """The gender an invented name must have: that of the titles the name has in all documents, else by the name itself."""
    return "m" if votes > 0 else "f" if votes < 0 else NOT_BY_ENDING.get(plain) or ("f" if FEMININE.search(plain) else "m")


def invented(key: bytes, plain: str, gender: str, turn: int) -> str:
    """The form that a word gets in its ``turn``, never itself: four syllables (over 10 to the 9th forms a gender) in its script."""
    while True:
        n = _draw(key, "word", plain, str(turn))
        ends = ENDINGS[gender]
        n, i = divmod(n, len(ends))
        new = "".join(SYLLABLES[n // len(SYLLABLES) ** k % len(SYLLABLES)] for k in range(3)) + ends[i]
        if "а" <= plain[:1] <= "џ":
            new = new.translate(SCRIPTS["cyrillic"])
        elif "α" <= plain[:1] <= "ω":
            new = new.translate(SCRIPTS["greek"])
        if new != plain:
            return new
        turn += 1 << 32


def _permuted(key: bytes, n: int, base: int, size: int) -> int:
    """Another number of ``size`` figures for each: a keyed permutation (Feistel rounds over both halves of the figures) carries
    a step to the next number, so it has no fixed point and no two numbers meet."""
    if size == 1:
        order = sorted(range(base), key=lambda x: _draw(key, "figure", str(base), str(x)))
        return order[(order.index(n) + 1) % base]
    low = size // 2
    halves = (base**low, base ** (size - low))

    def rounds(n: int, sign: int) -> int:
        a, b = divmod(n, halves[0])  # a has size - low figures, b has low
        for r in range(10) if sign > 0 else reversed(range(10)):
            if r % 2:
                a = (a + sign * _draw(key, "round", str(size), str(r), str(b))) % halves[1]
            else:
                b = (b + sign * _draw(key, "round", str(size), str(r), str(a))) % halves[0]
        return a * halves[0] + b

    return rounds((rounds(n, 1) + 1) % base**size, -1)


#: The parts of a mail address that are replaced: words and figures, but not the words for @ and dot, nor the last label.
MAIL_PART = re.compile(rf"(?:{AT.pattern})|{DOT}|[^\W\d_]+|\d+")
WORDS = re.compile(r"[^\W\d_]+")


def parts(kind: str, old: str) -> list[tuple[str, str]]:
    """What a surrogate is made of, in order: (what, text), what being word (another word for it), figures (others of the same
    number), initial, spoken (a figure in words) or as (stays)."""
    out: list[tuple[str, str]] = []

    def add(what: str, text: str) -> None:
        if text:
            out.append((what, text))

    def words(text: str) -> None:
        at = 0
        for m in WORDS.finditer(text):
            add("as", text[at : m.start()])
            add("initial" if len(m.group()) == 1 else "word", m.group())
            at = m.end()
        add("as", text[at:])

    at = 0
    if kind == "name":
        for u in UNIT.finditer(old):
            add("as", old[at : u.start(2)])
            words(u.group(2))
            at = u.end(2)
    elif kind == "email":
        found = list(MAIL_PART.finditer(old))
        last = max((m.start() for m in found if WORDS.fullmatch(m.group())), default=-1)
        for m in found:
            add("as", old[at : m.start()])
            word, figures = WORDS.fullmatch(m.group()), m.group().isdigit()
            add("figures" if figures else "word" if word and m.start() != last else "as", m.group())
            at = m.end()
    elif kind == "address":
        names = {m.start(): m.end() for m in ADDRESS_NAME.finditer(old)}
        for m in re.finditer(r"\d+|\S+", old):
            if m.start() < at:
                continue
            add("as", old[at : m.start()])
            at = m.end()
            if m.start() in names:
                words(old[m.start() : names[m.start()]])
                at = names[m.start()]
            else:
                add("figures" if m.group().isdigit() else "as", m.group())
    elif any(c.isdigit() for c in old):
        add("number", old)
        at = len(old)
    else:
        for m in FIGURE.finditer(old):
            add("as", old[at : m.start()])
            add("spoken", m.group())
            at = m.end()
    add("as", old[at:])
    return out


def plain_words(kind: str, old: str) -> list[str]:
    """The words of an original that are replaced by drawn ones, in plain form."""
    return [_plain(_folded(t)) for what, t in parts(kind, old) if what == "word"]


def surrogate(key: bytes, kind: str, old: str, forms: dict[str, str]) -> str:
    """The surrogate of an original; ``forms`` holds the drawn form of each of its words. Figures and initials are permuted."""

    def digits(text: str) -> str:
        own = [int(c) for c in text if c.isdigit()]
        new = iter(str(_permuted(key, int("".join(map(str, own))), 10, len(own))).zfill(len(own)))
        return "".join(next(new) if c.isdigit() else c for c in text)

    def initial(text: str) -> str:
        c = _plain(text)
        new = chr(97 + _permuted(key, ord(c) - 97, 26, 1)) if "a" <= c <= "z" and len(c) == 1 else c
        return new.upper() if text.isupper() else new

    def word(text: str) -> str:
        folded = _folded(text)
        new = forms[_plain(folded)]
        return new.upper() if folded.isupper() and len(folded) > 1 else new if folded.islower() else new.capitalize()

    split = parts(kind, old)
    spoken = [t for what, t in split if what == "spoken"]
    names = FIGURES_ES if any(_plain(t) in FIGURES_ES for t in spoken) else FIGURES_EN
    told = iter(digits("".join(str(VALUE[_plain(t)]) for t in spoken))) if spoken else iter(())
    by = {"as": lambda t: t, "word": word, "figures": digits, "number": digits, "initial": initial, "spoken": lambda t: _cased(names[int(next(told))], t)}
    return "".join(by[what](t) for what, t in split)


def _vote(before: str) -> int:
    """What the title before a name says of the person: 1 a man, -1 a woman, 0 nothing."""
    last = before.split()[-1:] if before[-1:].isspace() else []
    return TITLE_GENDER.get(_folded(last[0]).lower().rstrip("."), 0) if last else 0


def detect(df: DataFrame, public_names: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_hash, kind, start_char, end_char, original, vote): one row for each occurrence. One Arrow pass without a shuffle.

    ``public_names``: names of known entities and their aliases (a table of fixed size), which aren't private people. Null and
    empty texts give nothing; other columns are ignored; repeated rows give repeated occurrences. ``vote`` is for a whole name
    what the title before it says of the gender. Names are found in Latin, Cyrillic and Greek letters; scripts without
    capitals aren't covered.
    """
    public = frozenset(_folded(n) for n in public_names if n and n[:1].isupper())
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.int32())
    names = [key, "text_hash", "kind", "start_char", "end_char", "original", "vote"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, h, t in zip(*(b.column(k).to_pylist() for k in range(3))):
                for kind, a, z in spans(t, public) if t else ():
                    one = t[a:z]
                    rows.append((i, h, kind, a, z, one, _vote(t[max(0, a - 16) : a]) if kind == "name" and len(one.split()) > 1 else 0))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, kinds)], names=names)

    rows = df.select(F.col(key).cast("long").alias(key), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).where("text is not null")
    return rows.mapInArrow(run, f"{key} long, text_hash long, kind string, start_char int, end_char int, original string, vote int")


def drawn_forms(words: DataFrame, key: bytes, draw=invented) -> DataFrame:
    """(plain, form) of the distinct words of ``words`` (plain, vote): keyed draws, different for different words.

    Of several words that draw the same form the first in order keeps it, the others draw again, until no two meet; all of it
    by windows over the forms, so nothing comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            plain, votes, turns = (b.column(k).to_pylist() for k in range(3))
            forms = [draw(key, p, gender_of(p, v), t) for p, v, t in zip(plain, votes, turns)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(forms, pa.string())], names=["plain", "votes", "turn", "form"])

    state = words.groupBy("plain").agg(F.sum("vote").alias("votes")).withColumn("turn", F.lit(0).cast("long"))
    while True:
        state = state.mapInArrow(run, "plain string, votes long, turn long, form string")
        ranked = cut(state.withColumn("rn", F.row_number().over(Window.partitionBy("form").orderBy("turn", "plain"))))
        if ranked.where("rn > 1").isEmpty():
            return ranked.select("plain", "form")
        state = ranked.select("plain", "votes", F.when(F.col("rn") > 1, F.col("turn") + 1).otherwise(F.col("turn")).alias("turn"))


def replacements(df: DataFrame, public_names: list[str], secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text_hash, kind, start_char, end_char, surrogate): one row for each occurrence, repeated rows once, with its keyed
    surrogate.

    Equal originals get equal surrogates in every document, different ones different ones, and a name's parts are replaced word by
    word, so that a surname alone still refers to the person named in full. A surrogate has its original's kind, script, case and
    format (hyphens, initials, separators, how @ and dots are written), and a given name's gender: that of the titles it has
    in all documents, else by a table and its ending. ``secret`` keys everything. Null keys are kept as they are.
    """
    k = secret.encode()
    found = cut(detect(df, public_names, key, text).distinct())
    place = [key, "text_hash", "kind", "start_char", "end_char"]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for kind, old, vote in zip(*(b.column(c).to_pylist() for c in range(3))):
                rows += [(w, vote if i == 0 else 0) for i, w in enumerate(plain_words(kind, old))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[], []], (pa.string(), pa.int32()))], names=["plain", "vote"])

    forms = drawn_forms(found.select("kind", "original", "vote").mapInArrow(split, "plain string, vote int"), k)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(kind, old, w) for kind, old in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for w in plain_words(kind, old) or [None]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [[]] * 3)], names=["kind", "original", "plain"])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [surrogate(k, kind, old, dict(pairs)) for kind, old, pairs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), ([(x["plain"], x["form"]) for x in row] for row in b.column(2).to_pylist()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(new, pa.string())], names=["kind", "original", "surrogate"])

    # different originals only, however often they occur
    originals = found.select("kind", "original").distinct().mapInArrow(listed, "kind string, original string, plain string")
    plain, drawn = originals.where("plain is null").select("kind", "original", F.array().cast("array<struct<plain:string,form:string>>").alias("forms")), originals.where("plain is not null").join(forms, "plain").groupBy("kind", "original").agg(F.collect_set(F.struct("plain", "form")).alias("forms"))
    table = cut(plain.unionByName(drawn).mapInArrow(made, "kind string, original string, surrogate string"))
    return found.join(table, ["kind", "original"]).select(*place, "surrogate")


def masked(df: DataFrame, public_names: list[str], secret: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, surrogate_text, n_found): the text with typed placeholders, and with keyed surrogates in their stead; see
    ``replacements``. Texts without personal information come out as they are, nulls as null, repeated rows each."""
    found = replacements(df, public_names, secret, key, text).groupBy(key, "text_hash").agg(F.sort_array(F.collect_list(F.struct("start_char", "end_char", "kind", "surrogate"))).alias("found"))
    # the occurrences of one text
    rows = df.select(F.col(key).cast("long").alias(key), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).alias("r")
    same = F.col(f"r.{key}").eqNullSafe(F.col(f"f.{key}")) & (F.col("r.text_hash") == F.col("f.text_hash"))
    both = rows.join(found.alias("f"), same, "left").select(f"r.{key}", "r.text", "f.found")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            plain, fake, n = [], [], []
            for t, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                kept, new, at = [], [], 0
                for f in found or ():
                    kept += [t[at : f["start_char"]], PLACEHOLDER[f["kind"]]]
                    new += [t[at : f["start_char"]], f["surrogate"]]
                    at = f["end_char"]
                plain.append("".join([*kept, t[at:]]) if found else t)
                fake.append("".join([*new, t[at:]]) if found else t)
                n.append(len(found or ()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(plain, pa.string()), pa.array(fake, pa.string()), pa.array(n, pa.int32())], names=[key, "text", "surrogate_text", "n_found"])

    return both.mapInArrow(run, f"{key} long, text string, surrogate_text string, n_found int")
