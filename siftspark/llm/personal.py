"""Personal information in free text, found by anchors and replaced by typed placeholders.

An Aho-Corasick automaton finds anchors in one pass: at-signs and their disguises, signs and digits a telephone
number begins with, words that announce a number, an identity document or a name, given names, and words for streets. A parser
of the anchor's kind then reads the text around it, finds where the value begins and ends,
and checks its form. Nothing is learned; equal texts give equal results. Parsers read as far as a value goes, and the
time is linear in the text's length.

Values of JSON texts are read as decoded strings, each with its key as further context, and
are replaced in place, so that all else stays as it was written. Keys and numbers of JSON aren't values
and aren't looked at.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from siftspark.llm.spans import apart

PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id": "[ID]", "address": "[ADDRESS]", "name": "[NAME]"}
#: Of values that overlap, the kind named first is kept.
ORDER = ("email", "id", "phone", "address", "name")

Span = tuple[str, int, int]

# ---- e-mail addresses -------------------------------------------------------------------

_AT = ("@", "＠", "%40", "(at)", "[at]", " at ")
_DOMAIN = re.compile(r"[^\W_](?:[\w-]*[^\W_])?(?:\.[^\W_](?:[\w-]*[^\W_])?)+")
_SPELT = {
    "(at)": re.compile(r"\s?([\w-]+(?:\s?(?:\(dot\)|\.)\s?[\w-]+)+)", re.I),
    "[at]": re.compile(r"\s?([\w-]+(?:\s?(?:\[dot\]|\.)\s?[\w-]+)+)", re.I),
    " at ": re.compile(r"([\w-]+(?: dot [\w-]+)+)", re.I),
}
_SCHEME = re.compile(r"://\S*")
_REMOTE = re.compile(r"\b(?:ssh|scp|sftp|rsync|clone|mosh)\s+(?:-\S+\s+)*", re.I)
_MACHINE_USERS = {"git", "svn", "hg", "root"}


@lru_cache(1)
def _machines(text: str) -> tuple[list[int], list[int], frozenset[int]]:
    """Starts and ends of addresses with a scheme, and where the targets of remote commands begin."""
    schemes = [m.span() for m in _SCHEME.finditer(text)] if "://" in text else []
    return [a for a, _ in schemes], [b for _, b in schemes], frozenset(m.end() for m in _REMOTE.finditer(text))


def _of_machine(text: str, start: int) -> bool:
    if text[start - 1 : start] in (":", "/"):
        return True
    starts, ends, targets = _machines(text)
    i = bisect_left(starts, start) - 1
    return start in targets or (i >= 0 and start <= ends[i])


def _email(text: str, anchor: str, at: int, end: int) -> Span | None:
    stop = at - 1 if text[at - 1 : at].isspace() else at
    start = stop
    while start and (text[start - 1].isalnum() or text[start - 1] in "_.+'-"):
        start -= 1
    if start == stop or not (text[stop - 1].isalnum() or text[stop - 1] in "_+") or (anchor == "%40" and text[start:at].endswith("%")):
        return None
    while start < at and text[start] in ".'-+":
        start += 1
    domain = _SPELT[anchor].match(text, end) if anchor in _SPELT else _DOMAIN.match(text, end)
    if not domain or start >= at:
        return None
    local = text[start:at].strip().lower()
    if local in _MACHINE_USERS or text[start - 1 : start] == "@" or (text[max(0, start - 7) : start].lower() != "mailto:" and _of_machine(text, start)):
        return None
    stop = domain.end()
    if re.match(r":[\w/~]|/\w", text[stop : stop + 2]) or text[stop : stop + 1] in ("@", "("):
        return None
    labels = re.split(r"(?i)\s?(?:\(dot\)|\[dot\]|\bdot\b|\.)\s?", domain[0].strip())
    if not re.fullmatch(r"[^\W\d_]{2,24}|xn--[\w-]+", labels[-1]):
        return None
    return ("email", start, stop)


# ---- telephone numbers ------------------------------------------------------------------

_B = r"[    ]"
_S = r"[     .\-‐-–/]"
_OPEN = r"(?<![\w.+/#:-])(?<!\d[ ,])"
_CLOSE = r"(?![\w]|[-./:]\w)"
_SURE = re.compile(
    rf"{_OPEN}(?:"
    rf"(?:\(\+\d{{1,3}}\)|\+\d{{1,3}}|00[1-9]\d{{0,2}}(?={_B}|\())(?:{_S}?\(\d{{1,5}}\)|{_S}?\d{{1,12}}){{1,7}}"  # with a country code
    rf"|(?:1{_S})?(?:\(\d{{3}}\){_S}?|\d{{3}}{_S})\d{{3}}{_S}\d{{4}}"  # three, three, four
    rf"|\(0\d{{1,4}}\){_S}?\d{{3,8}}(?:{_S}\d{{1,5}})?|0[1-9]\d{{1,3}}/\d{{4,9}}(?:-\d{{1,4}})?"  # area code in brackets or before a slash
    rf"|0[1-9](?:{_S}\d\d){{4}}"  # five pairs
    rf"|07\d{{3}}{_S}?\d{{3}}{_S}?\d{{3}}|02\d{{1}}{_S}\d{{4}}{_S}\d{{4}}"
    rf"|8{_S}?\(\d{{3}}\){_S}?\d{{3}}{_S}?\d\d{_S}?\d\d|8{_S}\d{{3}}{_S}\d{{3}}{_S}\d\d{_S}\d\d"
    rf"){_CLOSE}"
)
_ANNOUNCED = re.compile(rf"[\s:.]*(?:(?:no|nr|n°|№)\.?\s*)?(\(?\+?\d(?:{_S}{{0,2}}[()]?{_S}?\d){{6,16}}){_CLOSE}", re.I)
_PHONE_CUES = (
    "tel", "tél", "phone", "fax", "mobile", "mobil", "cell", "call", "rang twice from", "caller left", "ring back", "móvil", "movil", "llamar al", "teléfono",
    "rückruf unter", "erreichbar", "rufnummer", "rappeler au", "joignable au", "portable", "тел", "моб", "перезвонить", "звонить", "номер", "contact", "whatsapp",
)
#: Words for telephones: what they announce needs no sign in it.
_TELEPHONE = ("tel", "tél", "phone", "fax", "mobile", "mobil", "handy", "móvil", "movil", "teléfono", "rufnummer", "тел", "моб", "whatsapp")
_PHONE_STARTS = ("+", "(", *"0123456789")
_PHONE_KEYS = re.compile(r"(?i)^(?:.*[_-])?(?:contact|callback|reach|phone|tel|telephone|mobile|cell|fax|line\d?|call|number)$")


def _digits(text: str) -> int:
    return sum(c.isdigit() for c in text)


def _phone_here(text: str, anchor: str, at: int, end: int) -> Span | None:
    """A number whose form says that it is one."""
    if at and (text[at - 1].isdigit() or (anchor != "(" and text[at - 1] in "(+")) and not text.startswith("((", at - 1):
        return None
    m = _SURE.match(text, at)
    return ("phone", *m.span()) if m and 9 <= _digits(m[0]) <= 15 else None


def _phone(text: str, anchor: str, at: int, end: int) -> Span | None:
    """A number that is announced. Behind a word for telephones it needs no form but its length."""
    if at and text[at - 1].isalnum():
        return None
    rest = re.compile(r"[^\W\d_]*").match(text, end).end()
    m = _ANNOUNCED.match(text, rest)
    telephone = anchor in _TELEPHONE
    if not m or not (7 if telephone else 8) <= _digits(m[1]) <= 15 or re.match(r"\d{4}-\d\d-\d\d|(?:19|20)\d\d[01]\d[0-3]\d$", m[1]):
        return None
    if telephone and rest == end:
        return ("phone", *m.span(1))
    if not re.search(rf"{_S}|^\+|[()]", m[1]) or any(p.fullmatch(m[1]) for p in _ID_SHAPES if not _SURE.fullmatch(m[1])):
        return None
    return ("phone", *m.span(1))


# ---- identity numbers -------------------------------------------------------------------

_ID_SHAPES = [
    re.compile(p)
    for p in (
        rf"[A-Z]{{2}}{_B}?\d\d{_B}?\d\d{_B}?\d\d{_B}?[A-D]",  # National Insurance
        rf"[12]{_B}?\d\d{_B}?\d\d{_B}?\d[\dAB]{_B}?\d{{3}}{_B}?\d{{3}}(?:{_B}?\d\d)?",  # French social security
        rf"\d{{3}}[-{_B[1:-1]}]\d\d[-{_B[1:-1]}]\d{{4}}",  # US social security
        rf"\d{{3}}-\d{{3}}-\d{{3}}[  -]\d\d",  # SNILS
        rf"\d\d{_B}\d{{3}}{_B}\d{{3}}{_B}\d{{3}}",  # German tax number
        rf"\d\d{_B}\d\d{_B}\d{{6}}|\d{{4}}{_B}\d{{6}}",  # Russian passport
        r"\d{6}/\d{3,4}",
        r"\d{4}-\d{4}-\d{2,4}",
        r"[XYZ]-?\d{7}-?[A-Z]|\d{8}-?[A-Z]",  # DNI and NIE
        r"[A-Z]{1,3}\d{6,9}|[A-Z]\d{2}[A-Z0-9]\d{4,6}|[CFGHJKLMNPRTVWXYZ0-9]{9}",  # passports and identity cards
        r"\d{9,12}",
    )
]
_ID_ANY = re.compile(rf"[A-Z0-9]+(?:[-/{_B[1:-1]}][A-Z0-9]*\d[A-Z0-9]*)*")
_ID_CUES = (
    "ssn", "social security no", "social security number", "social security", "ni number", "national insurance", "passport", "national id", "identity card", "id card", "id no", "tax id",
    "driver's licence", "driving licence", "driver license", "ausweisnummer", "personalausweis", "ausweis", "reisepass", "steuer-id", "steuernummer", "sozialversicherungsnummer", "dni", "nie", "nif",
    "pasaporte", "numéro de sécurité sociale", "sécurité sociale", "carte d’identité", "carte d'identité", "passeport", "n° de passeport", "паспорт", "снилс", "инн", "удостоверение личности",
)
_ID_LEAD = re.compile(r"(?:[^\W\d_]{0,2}(?![^\W\d_]))?(?:\s+(?:no|nr|number|nummer|num|número|numéro|номер|физлица|серия|code|n°|№)\b\.?)*\.?\s*(?:(?:is|ist|lautet|est|es)\s+)?[:#№=]?\s*", re.I)
_ID_KEYS = re.compile(r"(?i)^(?:.*[_-])?(?:doc_no|reference|checked_with|ssn|passport|id_no|id_number|national_id|tax_id|document|identity|dni|snils|inn)$")


def _id(text: str, anchor: str, at: int, end: int) -> Span | None:
    if at and (text[at - 1].isalnum() or text[at - 1] == "_"):
        return None
    start = _ID_LEAD.match(text, end).end()
    if start == end or (start < len(text) and not text[start].isalnum()):
        return None
    for shape in _ID_SHAPES:
        m = shape.match(text, start)
        if m and not re.match(r"\w|[-/]\d", text[m.end() : m.end() + 2]):
            return ("id", *m.span())
    m = _ID_ANY.match(text, start)
    if m and not re.match(r"[A-Z]{4}", m[0]) and _digits(m[0]) >= 6 and len(m[0]) <= 24 and not re.match(r"\w", text[m.end() : m.end() + 1]):
        return ("id", *m.span())
    return None


# ---- street addresses -------------------------------------------------------------------

_EN_TYPES = r"(?:street|st\.|st(?![\w.])|road|rd\.?|avenue|ave\.?|lane|ln\.?|drive|close|crescent|terrace|row|court|ct\.?|place|square|boulevard|blvd\.?|way|grove|gardens|hill|mews|parade|walk|highway|hwy\.?)(?!\w)"
_ADDRESSES = [
    re.compile(rf"(?<![\w.#-])\d{{1,5}}[A-Z]?{_B}+(?:(?:[NSEW]\.|North|South|East|West|NORTH|SOUTH|EAST|WEST){_B}+){{0,2}}(?:[A-Z][\w’'-]*{_B}+){{1,3}}?(?i:{_EN_TYPES})(?!{_B}+(?i:{_EN_TYPES}))"),
    re.compile(rf"(?<![\w.-])(?:(?:Am|An{_B}der|Auf{_B}der|Alte[rsn]?|Obere[rsn]?|Untere[rsn]?|Neue[rsn]?|Große[rsn]?|Kleine[rsn]?|Hintere[rsn]?|Vordere[rsn]?|Lange[rsn]?|OBERE|UNTERE|ALTE|NEUE){_B}+)*[A-ZÄÖÜ][\wäöüß-]*(?:straße|strasse|str\.|gasse|weg|platz|allee|chaussee|damm|ufer|ring|steig|pfad|STRASSE|STRAßE|STR\.|GASSE|WEG|PLATZ|ALLEE),?{_B}+\d{{1,4}}(?:(?:{_B}?[a-k]|[A-K])(?![\w.]))?(?![\w:])"),
    re.compile(rf"(?<![\w.-])\d{{1,4}}(?:{_B}?(?:bis|ter|quater))?,?{_B}+(?:rue|avenue|av\.|boulevard|bd\.?|chemin|impasse|allée|place|quai|route|cours|passage|square|sentier|ruelle){_B}+(?:(?:de{_B}la|de{_B}l[’']|des|du|de|d[’'])(?:{_B}+|(?<=[’'])))?[^\W\d_][\w’'-]*(?:(?:{_B}+(?:(?:de|du|des|la|le){_B}+)?(?-i:[A-ZÀ-Ý])[\w’'-]*){{1,2}}(?=\s*(?:[,.;()<\"\n]|$)))?", re.I),
    re.compile(rf"(?<![\w.-])(?:calle|c/|avenida|avda\.?|av\.|plaza|pza\.?|paseo|pº|camino|ronda|travesía|carrera|callejón){_B}*(?:(?:del|de{_B}las|de{_B}los|de{_B}la|de){_B}+)?[^\W\d_][\w’'-]*(?:{_B}+(?:(?:del?|las|los|la|y){_B}+)*[^\W\d_][\w’'-]*){{0,3}}?(?:,{_B}*|{_B}+)(?:(?:n\.º|nº|n°|núm\.|num\.|no\.){_B}*)?\d{{1,4}}(?:{_B}?[a-d](?!\w))?(?!\w)", re.I),
    re.compile(rf"(?<![\w.-])(?:ул\.|улица|пер\.|переулок|пр-т|просп\.|проспект|пр\.|наб\.|набережная|пл\.|площадь|ш\.|шоссе|б-р|бульвар|бул\.|проезд|тупик|аллея){_B}*[^\W\d_][\w-]*(?:{_B}+[^\W\d_][\w-]*){{0,2}}?,?{_B}*(?:(?:д\.|дом|д){_B}*)?\d{{1,4}}(?:{_B}?(?-i:[а-е])(?!\w))?(?:,?{_B}*(?:к\.|корп\.|стр\.){_B}*\d+)?(?!\w)", re.I),
]
#: Words for streets, in the order of the patterns above.
_STREET_WORDS = (
    ("street", " st", "road", " rd", "avenue", " ave", " lane", " ln", " drive", " close", "crescent", "terrace", " row", " court", " ct", " place", "square", "boulevard", "blvd", " way", " grove",
     "gardens", " hill", " mews", "parade", " walk", "highway", "hwy"),
    ("straße", "strasse", "str.", "gasse", "weg ", "weg,", "platz ", "platz,", "allee", "chaussee", "damm ", "damm,", "ufer ", "ufer,", "ring ", "ring,", "steig ", "steig,", "pfad ", "pfad,"),
    ("rue ", "avenue ", " av. ", " bd ", " bd. ", "boulevard ", "chemin ", "impasse ", "allée ", "place ", "quai ", "route ", "cours ", "passage ", "square ", "sentier ", "ruelle "),
    ("calle", "c/", "avenida", "avda", "av. ", "plaza", "pza", "paseo", "pº", "camino", "ronda", "travesía", "carrera", "callejón"),
    ("ул.", "улица", "пер.", "переулок", "пр-т", "просп", "пр. ", "наб.", "набережная", "пл.", "площадь", "ш. ", "шоссе", "б-р", "бульвар", "бул.", "проезд", "тупик", "аллея"),
)
_ADDRESS_CUES = (
    "lives at", "living at", "moved from", "ship to", "site visit:", "parcel goes to", "address:", "deliver to", "resides at", "wohnhaft", "einsatzort:", "lieferung nach", "anschrift:", "adresse:", "adresse :",
    "domicilié", "domiciliée", "rendez-vous :", "rendez-vous:", "livraison au", "vive en", "visita:", "entregar en", "dirección:", "проживает:", "проживает", "выезд по адресу", "доставка:", "адрес:",
)
_PLAIN_ADDRESSES = [
    re.compile(rf"\s*(\d{{1,5}}[A-Za-z]?{_B}+(?:[^\W\d_][\w.’'-]*{_B}+){{1,4}}?(?:{_EN_TYPES})(?!{_B}+{_EN_TYPES}))", re.I),
    re.compile(rf"\s*((?:[^\W\d_][\w.’'-]*{_B}+){{1,4}}?\d{{1,4}}(?:{_B}?[a-k](?!\w))?)(?=\s*(?:[,.;()<\n\"]|$)|{_B}+[A-ZА-Я])"),
]
_ADDRESS_KEYS = re.compile(r"(?i)^(?:.*[_-])?(?:line\d?|site|deliver_to|place|address|addr|street|location|ship_to)$")


def _addresses_of_line(text: str, which: int, start: int, end: int) -> Iterator[Span]:
    """The addresses of one line that has a word for streets."""
    for m in _ADDRESSES[which].finditer(text, start, end):
        yield ("address", *m.span())


def _address_announced(text: str, anchor: str, at: int, end: int) -> Span | None:
    if at and text[at - 1].isalnum():
        return None
    start = re.compile(r"(?:e\b)?\s*[:.]?\s*(?:[^\W\d_]+(?:{_B}[^\W\d_]+)?,{_B}+(?=(?:ул|пер|пр|наб|пл|ш|б)\S))?".replace("{_B}", _B), re.I).match(text, end).end()
    for pattern in _ADDRESSES:
        if m := pattern.match(text, start):
            return ("address", *m.span())
    for pattern in _PLAIN_ADDRESSES:
        if m := pattern.match(text, start):
            return ("address", *m.span(1))
    return None


# ---- personal names ---------------------------------------------------------------------

_PART = r"(?:[^\W\d_](?:[^\W\d_]|[’'‘`‐‑-](?=[^\W\d_]))*)"
_INITIAL = r"(?:[^\W\d_]\.)"
_TOKEN = re.compile(rf"(?:St\.|ST\.|st\.|{_INITIAL}(?:{_B}?{_INITIAL})*|{_PART})")
_PATRONYMIC = re.compile(r"(?:вич|вна|ична|ич)$", re.I)
_PARTICLES = {"von", "van", "de", "der", "den", "du", "del", "della", "di", "da", "la", "le", "st.", "al", "el", "bin", "ben", "zu", "af", "av", "mac", "dos"}
#: What comes after these ends with a name, and the sentence goes on.
_NAME_INSIDE = (
    "spoke with ", "filled in by ", "patient ", "requested by ", "dr. ", "dr ", "mr. ", "mrs. ", "ms. ", "prof. ", "mr ", "mrs ", "ms ", "j’ai parlé avec ", "j'ai parlé avec ", "rücksprache mit ", "demande de ", "solicitud de ", "antrag von ",
    "la sra. ", "el sr. ", "sra. ", "sr. ", "frau ", "herr ", "herrn ", "hablé con ", "mme ", "mme. ", "monsieur ", "madame ", "mlle ", "met with ", "talked to ", "on behalf of ", "my name is ", "i am ", "this is ", "ask for ", "contact ", "dear ", "sincerely yours, ", "je m'appelle ", "je m’appelle ", "me llamo ", "mi nombre es ", "ich heiße ", "mein name ist ", "меня зовут ", "говорили с клиентом, это ", "г-жа ", "г-н ", "господин ", "госпожа ",
)
#: What comes after these is a name at the end of a line.
_NAME_AFTER = ("signed:", "attn.", "attn:", "thanks,", "regards,", "gez.", "firmado:", "signé :", "signé:", "подпись:", "заявку подал(а)", "заявку подал", "ответственное лицо —", "ответственное лицо -", "atentamente,", "cordialement,", "gezeichnet", "name:", "nombre:", "nom :", "имя:", "фио:")
_FIELD_CUES = {"name:", "nombre:", "nom :", "имя:", "фио:"}
_NAME_KEYS = re.compile(r"(?i)^(?:.*[_-])?(?:owner|who|signed|requester|name|full_name|author|patient|client|customer|person|contact|assignee|applicant)$")
#: Words that begin sentences rather than names.
_STOP = set(
    "the a an in on at of and or but for from to with without by as is are was were it they he she we i you who whom which what when where most both some someone nobody whoever see notes note "
    "der die das ein eine im in am zum zur wer ohne früher zuerst und oder nach von mit wartet liegt la el los las una un hay quien según primero palabra en y o qué por le les des il on rien mot qui "
    "в на и не о об по кто что вопрос всего сначала ключевое вам нам мне это will asked about has had would should no not all any please that this these those our your my its who waits recibida reçue hier ayer am liegt espera attend wartet".split()
)


def _name_tokens(text: str, start: int) -> list[re.Match]:
    out, at = [], start
    while len(out) < 7:
        m = _TOKEN.match(text, at)
        if not m:
            break
        out.append(m)
        gap = re.compile(rf"{_B}").match(text, m.end())
        if not gap:
            break
        at = gap.end()
    return out


def _capital(word: str) -> bool:
    return word[0].isupper() or word[0] in "’'" and word[1:2].isupper()


def _is_initial(word: str) -> bool:
    return word.endswith(".") and word.lower() != "st."


def _family(tokens: list[str]) -> bool:
    return any(len(t) > 1 and not t.endswith(".") for t in tokens)


def _name_length(text: str, tokens: list[re.Match], words: list[str], run: int) -> int:
    """How many of ``run`` capitalised parts are the name, where a sentence may follow it without a sign between."""
    if run < 3:
        return run
    if words[1].count(".") > 1:  # family name and initials
        return 2
    at = 1
    if not _is_initial(words[0]) and _is_initial(words[1]):
        at = 2
    particle = words[at].lower() in _PARTICLES
    length = at + 1 + particle
    if length < run and not particle and at == 1 and not _is_initial(words[0]):
        if words[length].lower() in _PARTICLES and length + 1 < run:
            return length + 2
        ends = text[tokens[length].end() : tokens[length].end() + 1] in ("", "\n", "\r", "<", '"', ",", ".", ";", ")")
        if ends or _PATRONYMIC.search(words[1]) or _PATRONYMIC.search(words[length]):
            length += 1
    return length


def _name_span(text: str, start: int, goes_on: bool) -> tuple[int, int] | None:
    """Where the name that starts at ``start`` ends. ``goes_on``: lower-case words may follow."""
    tokens = _name_tokens(text, start)
    if not tokens:
        return None
    words = [t[0] for t in tokens]
    comma = re.compile(rf",{_B}+")
    lower = not _capital(words[0])
    if lower and (words[0].lower() in _STOP or len(words[0]) < 2):
        return None
    # family name, comma, given names: the comma comes after the first part
    for k in range(1, 3):
        if len(tokens) == k and (c := comma.match(text, tokens[k - 1].end())) and (k == 1 or words[0].lower() in _PARTICLES):
            given = _name_tokens(text, c.end())
            names = [g[0] for g in given]
            if not given or names[0].lower() in _STOP or _capital(names[0]) == lower:
                return None
            last = 0
            follows = text[given[-1].end() : given[-1].end() + 1]
            if len(names) > 1 and (_is_initial(names[1]) or (names[1][0].isupper() and not lower and goes_on and names[1].lower() not in _STOP and len(names) > 2 and not _capital(names[2]))):
                last = 1
            elif len(names) == 2 and not lower and _capital(names[1]) and follows in ("", "\n", "<", '"', ".", "\r") and names[1].lower() not in _STOP:
                last = 1
            return (start, given[last].end())
    # parts of a name in a row: capitalised, or all lower case
    run = 0
    for k, w in enumerate(words):
        if w.lower() in _STOP and not (w.lower() in _PARTICLES and k + 1 < len(words) and _capital(words[k + 1])):
            break
        if not lower and not _capital(w) and w.lower() not in _PARTICLES:
            break
        if lower and _capital(w) and not _is_initial(w):
            break
        run = k + 1
    if lower:
        # without capitals: two parts, or three with an initial or a particle between, or as many as are alone on the line
        ends = text[tokens[run - 1].end() : tokens[run - 1].end() + 1] if run else "x"
        alone = run == len(words) and ends in ("", "\n", "\r", "<", '"', ",", ".", ";", ")")
        keep = 3 if run >= 3 and (_is_initial(words[1]) or words[1] in _PARTICLES or (alone and run == 3)) else 2
        run = min(run, keep)
    else:
        following = words[run] if run < len(words) else ""
        if not goes_on and following and run > 2 and (not _capital(following) or following.lower() in _STOP) and not words[run - 1].isupper() * (len(words[run - 1]) > 1) and words[run - 1].lower() not in _PARTICLES and not _is_initial(words[run - 2]) and not _PATRONYMIC.search(words[run - 1]):
            run -= 1  # a capital before lower case begins the next sentence
        if words[0].isupper() and len(words[0]) > 1 and not words[0].endswith("."):
            shout = 0
            while shout < run and words[shout].isupper():
                shout += 1
            if shout > 1 and len(words[shout - 1]) == 1:
                shout -= 1
            run = min(run, shout) if shout > 1 else run
        if goes_on:
            run = min(run, 4)
        else:
            run = min(run, _name_length(text, tokens, words, run))
    while run and (words[run - 1].lower() in _PARTICLES or (_is_initial(words[run - 1]) and run > 2)):
        run -= 1
    if run < 2 or words[0].lower() == "st." or not _family(words[:run]) or all(_is_initial(w) for w in words[:run]):
        return None
    return (start, tokens[run - 1].end())


#: Given names that are anchors by themselves: common ones of the corpus's languages, in Russian in the nominative. A parameter of :func:`find_personal`'s automaton, not a list of all people.
GIVEN_NAMES = (
    "james john robert michael william david richard joseph thomas charles daniel matthew anthony mark steven paul andrew kevin brian george edward peter henry jack adam simon alan "
    "mary patricia jennifer linda elizabeth susan jessica sarah karen nancy lisa margaret sandra emily emma olivia anna laura julia maria alice helen rachel hannah "
    "hans jürgen klaus wolfgang stefan uwe jörg matthias sabine petra monika ursula heike katrin birgit jean pierre michel philippe nicolas françois luc marie nathalie sophie isabelle camille "
    "juan carlos luis miguel antonio javier pedro pablo carmen ana isabel lucía elena rosa "
    "александр алексей андрей анна антон борис вадим виктор владимир галина дмитрий евгений екатерина елена иван игорь илья ирина людмила марина мария михаил наталья николай оксана олег ольга павел пётр светлана сергей татьяна юлия юрий"
).split()
#: What after two capitals shows that they name a place, a firm or a thing.
_NOT_PEOPLE = set(
    "street road avenue lane drive square park university college school institute hospital church cathedral library museum award prize foundation inc ltd llc gmbh ag corp company bank airport station "
    "river lake mount island bridge effect theorem law equation method test act day week project cup stadium building tower memorial gallery hotel house hall center centre".split()
)


def _named(text: str, anchor: str, at: int, end: int) -> Span | None:
    """A given name with a family name behind it: both capitalised, and not part of the name of a place or a thing."""
    if (at and (text[at - 1].isalnum() or text[at - 1] in "_-@./\\'’")) or not text[at].isupper() or text[end : end + 1] not in (" ", "\u00a0"):
        return None
    span = _name_span(text, at, False)
    if not span:
        return None
    words = text[span[0] : span[1]].split()
    following = re.compile(rf"{_B}*([^\W\d_]*)").match(text, span[1])[1].lower()
    before = re.compile(rf"([^\W\d_]+){_B}$").search(text, max(0, at - 40), at)
    if following in _NOT_PEOPLE or any(w.lower() in _NOT_PEOPLE for w in words) or (before and before[1].lower() in ("saint", "st", "san", "santa", "mount", "port", "lake", "fort")):
        return None
    return ("name", *span)


_TITLES = re.compile(r"(?:(?:Dr|Prof|Mr|Mrs|Ms|Frau|Herr|Herrn|Sra|Sr|Mme|M|Ing)\.?\s+)*")


def _name_inside(text: str, anchor: str, at: int, end: int) -> Span | None:
    if at and (text[at - 1].isalnum() or text[at - 1] in "_-"):
        return None
    if anchor in ("patient ", "dr ", "mr ", "mrs ", "ms ", "frau ", "herr ", "mme ", "demande de ", "solicitud de ", "antrag von ", "dr. ", "requested by ") and not (span := _name_span(text, _TITLES.match(text, end).end(), True)):
        return None
    span = _name_span(text, _TITLES.match(text, end).end(), True)
    if not span:
        return None
    if not _capital(text[span[0]]) and not re.match(rf"{_B}+(?:about|asked|will|on|waits|hier|am|reçue|recibida|liegt|espera|wartet|ayer|attend)\b|[,.;<\n\"]|$", text[span[1] : span[1] + 12]):
        return None
    return ("name", *span)


def _name_after(text: str, anchor: str, at: int, end: int) -> Span | None:
    if at and (text[at - 1].isalnum() or text[at - 1] in "_-"):
        return None
    start = _TITLES.match(text, re.compile(r"[ \t ]*").match(text, end).end()).end()
    span = _name_span(text, start, False)
    if not span or (anchor in _FIELD_CUES and not _capital(text[span[0]])):
        return None
    return ("name", *span)


_WHOLE_NAME = re.compile(rf"(?:{_TOKEN.pattern})(?:,?{_B}(?:{_TOKEN.pattern})){{1,4}}")


# ---- all kinds together -----------------------------------------------------------------


@lru_cache(1)
def _automaton():
    import ahocorasick

    found: dict[str, list[tuple[str, Callable | int]]] = {}
    for words, parser in (
        (_AT, _email),
        (_PHONE_STARTS, _phone_here),
        (tuple(dict.fromkeys((*_PHONE_CUES, *_TELEPHONE))), _phone),
        (_ID_CUES, _id),
        *((words, which) for which, words in enumerate(_STREET_WORDS)),
        (_ADDRESS_CUES, _address_announced),
        (_NAME_INSIDE, _name_inside),
        (_NAME_AFTER, _name_after),
        (GIVEN_NAMES, _named),
    ):
        for word in words:
            found.setdefault(word, []).append((word, parser))
    automaton = ahocorasick.Automaton()
    for word, parsers in found.items():
        automaton.add_word(word, parsers)
    automaton.make_automaton()
    return automaton


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def find_personal(text: str | None, key: str | None = None) -> list[Span]:
    """(kind, start, end) of the personal values in ``text``, in order and without overlap. ``key`` is the name of its field, if it has one."""
    if not text:
        return []
    spans: set[Span] = set()
    read = [0] * len(_ADDRESSES)  # how far lines have been read for addresses
    for last, parsers in _automaton().iter(_lower(text.replace("\u00a0", " "))):
        for word, parser in parsers:
            at = last + 1 - len(word)
            if not callable(parser):
                if at >= read[parser]:
                    start = text.rfind("\n", read[parser], at) + 1 or read[parser]
                    end = text.find("\n", at + 1)
                    read[parser] = len(text) if end < 0 else end
                    spans.update(_addresses_of_line(text, parser, start, read[parser]))
                continue
            span = parser(text, word, at, last + 1)
            if span:
                spans.add(span)
    if key:
        spans |= _whole(text, re.sub(r"(?:_(?:old|new|\d+))+$", "", key))
    return [(ORDER[kind], start, end) for kind, start, end in apart((ORDER.index(kind), start, end) for kind, start, end in spans)]


def _whole(text: str, key: str) -> set[Span]:
    """A field's value as a whole, where the field's name says what it may be."""
    value = text.strip()
    a = text.find(value)
    span = (a, a + len(value))
    if _ID_KEYS.match(key) and any(p.fullmatch(value) for p in _ID_SHAPES):
        return {("id", *span)}
    if _PHONE_KEYS.match(key) and re.fullmatch(rf"[+(]?\d[\d()+]*(?:{_S}?[()]?\d+\)?)*", value) and 8 <= _digits(value) <= 15:
        return {("phone", *span)}
    if _ADDRESS_KEYS.match(key):
        for pattern in (*_ADDRESSES, *_PLAIN_ADDRESSES):
            m = pattern.match(value)
            if m and m.end() == len(value):
                return {("address", *span)}
    if _NAME_KEYS.match(key) and _WHOLE_NAME.fullmatch(value):
        return {("name", *span)}
    return set()


_JSON_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)


def _json_strings(text: str) -> list[tuple[int, int, str | None]] | None:
    """(start, end, key) of each string value of a JSON text; None if the text isn't JSON."""
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return None
    out, key, after = [], None, -1
    for m in _JSON_STRING.finditer(text):
        colon = re.compile(r"\s*:").match(text, m.end())
        if colon:
            key, after = json.loads(m[0], strict=False), colon.end()
        else:
            direct = after >= 0 and not text[after : m.start()].strip()
            out.append((m.start(), m.end(), key if direct else None))
    return out


def personal_values(text: str | None, as_json: bool = False) -> set[tuple[str, str]]:
    """(kind, value) of the personal values in ``text``; in JSON, in its decoded strings."""
    if not text:
        return set()
    strings = _json_strings(text) if as_json else None
    if strings is None:
        return {(kind, text[a:b]) for kind, a, b in find_personal(text)}
    out = set()
    for start, end, key in strings:
        value = json.loads(text[start:end], strict=False)
        out |= {(kind, value[a:b]) for kind, a, b in find_personal(value, key)}
    return out


def _masked(text: str, key: str | None = None) -> str:
    out, last = [], 0
    for kind, a, b in find_personal(text, key):
        out += [text[last:a], PLACEHOLDERS[kind]]
        last = b
    return "".join([*out, text[last:]]) if out else text


def mask(text: str | None, as_json: bool = False) -> str | None:
    """``text`` with each personal value replaced by a placeholder of its kind; JSON stays JSON and is changed in those strings only."""
    if not text:
        return text
    strings = _json_strings(text) if as_json else None
    if strings is None:
        return _masked(text)
    out, last = [], 0
    for start, end, key in strings:
        value = json.loads(text[start:end], strict=False)
        clean = _masked(value, key)
        if clean != value:
            out += [text[last:start], json.dumps(clean, ensure_ascii=text[start:end].isascii())]
            last = end
    return "".join([*out, text[last:]])


_FOUND = ArrayType(StructType([StructField("kind", StringType()), StructField("found", StringType())]))
_ARROW_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("found", pa.string())]))


def _apply(values: pa.Array, as_json: bool) -> pa.Array:
    clean = lambda s: s.encode("utf-8", "replace").decode()  # noqa: E731 - escapes of JSON can make lone surrogates
    return pa.array([[{"kind": k, "found": clean(f)} for k, f in sorted(personal_values(v.as_py(), as_json))] for v in values], _ARROW_FOUND)


@F.arrow_udf(_FOUND)
def _in_text(values: pa.Array) -> pa.Array:
    return _apply(values, False)


@F.arrow_udf(_FOUND)
def _in_json(values: pa.Array) -> pa.Array:
    return _apply(values, True)


@F.arrow_udf(StringType())
def _mask_text(values: pa.Array) -> pa.Array:
    return pa.array([mask(v.as_py()) for v in values], pa.string())


@F.arrow_udf(StringType())
def _mask_json(values: pa.Array) -> pa.Array:
    return pa.array([mask(v.as_py(), True) for v in values], pa.string())


def personal(rows: DataFrame, key: str, text: str, as_json: bool = False) -> DataFrame:
    """One row for each row key, kind and distinct value: key, kind, found.

    Null and empty texts give no row; JSON texts that don't parse are read as plain text;
    rows sent twice count once; keys may be null; further columns are ignored.
    """
    found = (_in_json if as_json else _in_text)(F.col(text))
    exploded = rows.select(F.col(key), F.explode(found).alias("__f"))
    return exploded.select(key, F.col("__f.kind").alias("kind"), F.col("__f.found").alias("found")).distinct()


def masked(text: Column, as_json: bool = False) -> Column:
    """The text of each row with its personal values replaced; null for null."""
    return (_mask_json if as_json else _mask_text)(text)
