"""Recognition and masking of secrets and personal data: secrets, Russian full names and mobile numbers, labelled values, keywords.

A recogniser gives matches (kind, label, start, end, confidence) in characters. Overlapping ones are merged before masking, so that
no tail of a crossing span stays. Whatever goes wrong in inspecting a text gives an error and never the text.
"""

from __future__ import annotations

import base64
import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftspark.functions import regexlang
from siftspark.operators.normalize import normalized
from siftspark.operators.text import SECRET_SIGNS, SECRETS, has_any


class Match(NamedTuple):
    kind: str
    label: str
    start: int
    end: int
    confidence: float


Recognizer = Callable[[str], Iterable[Match]]


@dataclass(frozen=True)
class Options:
    """What is looked for beside the built-in recognisers: keywords, values never hidden, a floor of entropy (0: none), and further recognisers."""

    keywords: tuple[str, ...] = ()
    allowlist: tuple[str, ...] = ()
    least_entropy: float = 0.0
    recognizers: tuple[Recognizer, ...] = ()
    order_value: bool = field(default=False)


DEFAULT = Options()

# ---- Russian full names -----------------------------------------------------------------
# Base forms of given names; their cases follow from the rules below.
GIVEN_NAMES = """
Александр Александра Алексей Алина Алла Алёна Алена Анатолий Андрей Анна Антон Антонина Аркадий Арсений Артем Артём Артур Борис Вадим Валентин Валентина Валерий Валерия Василий Вера Виктор Виктория
Виталий Владимир Владислав Вячеслав Галина Геннадий Георгий Глеб Григорий Даниил Данила Дарья Денис Дмитрий Евгений Евгения Екатерина Елена Елизавета Зинаида Зоя Иван Игорь Илья Инна Ирина Кирилл
Клавдия Константин Ксения Лариса Лев Леонид Лидия Любовь Людмила Максим Маргарита Марина Мария Матвей Михаил Надежда Наталья Наталия Нина Николай Оксана Олег Ольга Павел Петр Пётр Полина Раиса Роман
Руслан Светлана Семен Семён Сергей Станислав Степан София Софья Таисия Тамара Татьяна Тимофей Тимур Ульяна Федор Фёдор Юлия Юрий Яков Яна Ярослав
"""
# Words that are no part of a name though they look like one.
NO_NAMES = frozenset(
    "данные имя клиент контакт массив не неизвестно нет объект ответственный отчество подписал подписала получил получила проверил проверила протокол пусто связаться согласовал согласовала сотрудник строка тест тип фамилия число".split()
)
# Endings of the cases, by how the nominative ends; the longest that fits counts.
_CASES = (
    ("ия", 2, ("ии", "ию", "ией")),
    ("ий", 1, ("я", "ю", "ем", "е")),
    ("ей", 1, ("я", "ю", "ем", "е")),
    ("ь", 1, ("я", "ю", "ем", "е")),
    ("а", 1, ("ы", "и", "е", "у", "ой")),
    ("я", 1, ("и", "е", "ю", "ей")),
    ("", 0, ("а", "у", "ом", "е")),
)


@lru_cache(1)
def _given_forms() -> frozenset[str]:
    out = set()
    for name in GIVEN_NAMES.lower().split():
        cut, endings = next((n, e) for end, n, e in _CASES if name.endswith(end))
        out.add(name)
        out.update(name[: len(name) - cut] + e for e in endings)
    return frozenset(out)


# Endings of family names, by declension: possessive ones, adjectives, and those that don't change or add a vowel.
_FAMILY_END = re.compile(
    r"(?:(?:[оеё]в|[иы]н)(?:а|у|ой|ым|е)?|(?:ск|цк)(?:ий|ая|ого|ому|им|ую|ой|их)|[ыи]х|[ао]я|ой|ого|ому|ко|ук|юк|ич)$", re.I
)
_PATRONYMIC_END = re.compile(r"(?:(?:[оеё]в|ь)ич(?:а|у|ем|е)?|(?:[оеё]вн|инич?н|ичн)(?:а|ы|е|у|ой))$", re.I)
_PERSON_WORDS = r"фио|имя|фамилия|отчество|контакт(?:ное лицо)?|клиент|сотрудник|ответственн[а-яё]*|подписал[а-яё]*|проверил[а-яё]*|согласовал[а-яё]*|получател[а-яё]*|отправител[а-яё]*"
_CONTEXT = re.compile(rf"(?:{_PERSON_WORDS})(?:\([а-яё]+\))?[ \t:—–=-]*$", re.I)
_LABELLED_PERSON = re.compile(r"(?:фио|контактное лицо|ответственн[а-яё]*(?:[ \t]+[а-яё]+){0,3}|получател[а-яё]*|отправител[а-яё]*)[ \t]*[:=][ \t]*$", re.I)
_RU_WORD = re.compile(r"[А-ЯЁа-яё]\.|[А-ЯЁа-яё]+(?:[-‑][А-ЯЁа-яё]+)*")
#: Characters before a name that may announce it.
_LOOK_BACK = 100


def _is_given(word: str) -> bool:
    parts = [p for p in re.split(r"[-‑]", word.lower()) if p]
    return bool(parts) and all(p in _given_forms() for p in parts)


def _may_name(word: str) -> bool:
    return len(word) > 1 and not word.endswith(".") and word.lower() not in NO_NAMES


def _roles(word: str, announced: bool, labelled: bool) -> set[str]:
    """What a word may be in a name: g(iven), f(amily), p(atronymic), i(nitial); G and F: by its capital or its label only."""
    if word.endswith("."):
        return {"i"}
    out = set()
    given, capital = _is_given(word), word[0].isupper()
    if given:
        out |= {"g", "G"}
    if _PATRONYMIC_END.search(word):
        out.add("p")
    if _may_name(word):
        if not given and (_FAMILY_END.search(word) or (announced and capital)):
            out |= {"f", "F"}
        if capital or labelled:
            out |= {"G", "F"}
    return out


# Orders of a full name: of three parts, and of two.
_THREE, _TWO = ("GpF", "FGp", "fii", "iif"), ("gf", "gp", "fg")


def russian_names(text: str) -> Iterator[Match]:
    """Full names of two or three parts, by what their parts can be and by what announces them."""
    words = [] if text.isascii() else list(_RU_WORD.finditer(text))
    # Every order has one of these: a given name, a patronymic or an initial. Most words are none.
    known = [w[0].endswith(".") or _is_given(w[0]) or bool(_PATRONYMIC_END.search(w[0])) for w in words]
    at = 0
    while at < len(words):
        taken = 0
        for size, orders in ((3, _THREE), (2, _TWO)):
            part = words[at : at + size]
            if len(part) < size or not any(known[at : at + size]):
                continue
            start, end = part[0].start(), part[-1].end()
            if any(len(gap := text[a.end() : b.start()]) > 16 or gap.strip(" \t  ") for a, b in zip(part, part[1:])):  # noqa: B905
                continue
            if (start and (text[start - 1].isalnum() or text[start - 1] == "_")) or (end < len(text) and (text[end].isalnum() or text[end] == "_")):
                continue
            before = text[max(0, start - _LOOK_BACK) : start]
            announced, labelled = bool(_CONTEXT.search(before)), bool(_LABELLED_PERSON.search(before))
            if size == 2 and not announced and not (part[0][0][0].isupper() and part[1][0][0].isupper()):
                continue
            roles = [_roles(w[0], announced, labelled) for w in part]
            if any(all(r in have for r, have in zip(order, roles, strict=True)) for order in orders):
                yield Match("pii", "full_name", start, end, 0.85)
                taken = size
                break
        at += taken or 1


# ---- Russian mobile numbers -------------------------------------------------------------
_MOBILE = re.compile(r"\+?[78](?:[ \t  ()\-‐‑‒–—−]{0,4}[0-9]){10}")
_ORDER_BEFORE = re.compile(r"(?:^|\W)(?:номер[ \t]+заказа|заказ|order(?:[_ \t]*(?:number|id|no))?)[ \t]*[:=#№\"']?[ \t\r\n\"']*$", re.I)
_MORE_DIGITS = re.compile(r"\.[0-9]|[-(][ \-)]*[0-9]")


def mobiles(text: str, order_value: bool = False) -> Iterator[Match]:
    """Numbers of eleven digits that begin with 7 or 8 and then 9; a bare one that is an order's number isn't one."""
    for m in _MOBILE.finditer(text):
        start, end = m.span()
        before, value = text[max(0, start - 2) : start], m[0]
        digits = re.sub(r"\D", "", value)
        if before[-1:].isalnum() or before[-1:] in ("_", "+") or (end < len(text) and (text[end].isalnum() or text[end] == "_")) or _MORE_DIGITS.match(text, end, end + 16):
            continue
        if before[-1:] in ("-", ".") and (before[:-1].isalnum() or (before == "-" and start == 1)):
            continue
        if digits[1] != "9" or value.startswith("+8"):
            continue
        if value == digits and (order_value or _ORDER_BEFORE.search(text[max(0, start - 96) : start])):
            continue
        yield Match("pii", "phone", start, end, 0.95)


# ---- fields -----------------------------------------------------------------------------
# What the names of fields say of their values; names are compared by their letters and digits.
FIELD_LABELS = dict.fromkeys(
    ("contactname", "customername", "familyname", "fio", "firstname", "fullname", "givenname", "lastname", "middlename", "patronymic", "personname", "surname", "имя", "отчество", "фамилия", "фио"), "full_name"
) | dict.fromkeys(("contactmobile", "mobile", "mobilephone", "phone", "phonenumber", "telephone", "номертелефона", "телефон"), "phone")
ORDER_FIELDS = frozenset(("orderid", "orderno", "ordernumber", "идентификаторзаказа", "номерзаказа"))
_SINGLE_ANY = frozenset(("firstname", "givenname", "lastname", "surname", "familyname", "фамилия"))
_SINGLE_PATRONYMIC = frozenset(("patronymic", "middlename", "отчество"))


def field_key(name: str) -> str:
    return "".join(c for c in name.lower() if c.isalnum())


def field_label(name: str) -> str | None:
    return FIELD_LABELS.get(field_key(name))


def _personal(name: str, value: str) -> bool:
    """Whether a value under a field for names is a name."""
    key, value = field_key(name), value.strip().removeprefix(placeholder("full_name")).strip()
    if len(value.split()) == 1 and re.fullmatch(r"[А-ЯЁа-яё‑-]{2,}", value) and _may_name(value):
        if key in _SINGLE_ANY or (key == "имя" and _is_given(value)) or (key in _SINGLE_PATRONYMIC and _PATRONYMIC_END.search(value)):
            return True
    return any(True for _ in russian_names(value))


_LABEL = re.compile(r"(?:^|(?<=[\W_]))((?:first|last|given|family|full)[_ -]?name|patronymic|имя|фамилия|отчество|фио)[ \t]*[:=：][ \t]*([^\r\n;,]+)", re.I | re.M)


def labelled(text: str) -> Iterator[Match]:
    """Names behind the name of a field."""
    low = text.lower()
    for m in _LABEL.finditer(text) if has_any(low, ("name", "patronymic", "имя", "фамилия", "отчество", "фио")) else ():
        if m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] == "_"):
            continue
        value = m[2].rstrip(" .!?")
        if value and _personal(m[1], value):
            yield Match("pii", "full_name", m.start(2), m.start(2) + len(value), 0.9)


# ---- secrets, keywords, entropy ---------------------------------------------------------
_TOKEN = re.compile(r"[A-Za-z0-9+/=_-]{20,}")


def secrets(text: str) -> Iterator[Match]:
    low = text.lower()
    for label, confidence, pattern, group in SECRETS:
        for m in () if not has_any(low, SECRET_SIGNS[label]) else regexlang.python(pattern).finditer(text):
            if m.end(group) > m.start(group):
                yield Match("auth" if label in ("auth_header", "url_credentials") else "secret", label, m.start(group), m.end(group), confidence)


def _tokens(text: str, least: float) -> Iterator[Match]:
    for m in _TOKEN.finditer(text):
        n = len(m[0])
        bits = -sum(c / n * math.log2(c / n) for c in Counter(m[0]).values())
        if bits >= least and any(map(str.isalpha, m[0])) and any(map(str.isdigit, m[0])):
            yield Match("secret", "high_entropy", *m.span(), 0.5)


def found(text: str, options: Options = DEFAULT) -> list[Match]:
    """All matches of a text, merged where they overlap, by start. Raises if a recogniser fails or gives no span of the text."""
    out = [*secrets(text), *russian_names(text), *mobiles(text, options.order_value), *labelled(text)]
    for word in options.keywords:
        if word:
            out += [Match("custom", "keyword", *m.span(), 1.0) for m in re.finditer(re.escape(word), text, re.I)]
    if options.least_entropy > 0:
        out += _tokens(text, options.least_entropy)
    for recognize in options.recognizers:
        out += [Match(*m) for m in recognize(text)]
    if any(not 0 <= m.start < m.end <= len(text) for m in out):
        raise ValueError("a recogniser gave no span of the text")
    return merged(m for m in out if not any(a and a in text[m.start : m.end] for a in options.allowlist))


def merged(matches: Iterable[Match]) -> list[Match]:
    """Crossing matches as one, which has the label of the first, longest, surest."""
    out: list[Match] = []
    for m in sorted(matches, key=lambda m: (m.start, -m.end, -m.confidence)):
        if out and m.start < out[-1].end:
            out[-1] = out[-1]._replace(end=max(out[-1].end, m.end))
        else:
            out.append(m)
    return out


def placeholder(label: str) -> str:
    return f"[REDACTED:{label}]"


def mask_matches(text: str, matches: Iterable[Match]) -> str:
    out, last = [], 0
    for m in matches:
        out += [text[last : m.start], placeholder(m.label)]
        last = m.end
    return "".join([*out, text[last:]])


def mask(text: str, options: Options = DEFAULT) -> str:
    """The text with its matches hidden; hidden as a whole where only its normalised form shows them."""
    clean = normalized(text) or ""
    if clean != text and found(clean, options):
        return placeholder("normalized_pii")
    return mask_matches(text, found(text, options))


def mask_field(name: str, value: str, options: Options = DEFAULT) -> str:
    """A field's value: names as a whole under fields for names; bare numbers of orders stay."""
    if field_label(name) == "full_name" and _personal(name, value):
        return value if any(a and a in value for a in options.allowlist) else placeholder("full_name")
    return mask(value, replace(options, order_value=field_key(name) in ORDER_FIELDS))


_SHORT_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")


def encoded_sensitive(value: str, options: Options = DEFAULT) -> bool:
    """Whether a value is a base64 copy of a text with matches. The first alphabet in which it decodes to a text decides."""
    if len(value) > 1 << 20 or not _SHORT_BASE64.fullmatch(value):
        return False
    for url in (False, True):
        for padded in (True, False):
            if padded and len(value) % 4 or not padded and value.endswith("="):
                continue
            try:
                raw = base64.b64decode(value + "=" * (-len(value) % 4), altchars=b"-_" if url else None, validate=True).decode()
            except ValueError:
                continue
            return bool(found(raw, options))
    return False


# ---- values of JSON ---------------------------------------------------------------------
class Digits(str):
    """A number as it is written."""

    __slots__ = ()


def number_text(raw: str) -> str:
    """A number's other spellings (decimal point, exponent) as the whole number they are; anything else as written. Guards: 128 signs, exponents to 64, 34 digits."""
    if len(raw) > 128 or raw.startswith("-"):
        return raw
    m = re.fullmatch(r"(\d+)(?:\.(\d+))?(?:[eE]([+-]?\d+))?", raw)
    if not m or (m[3] and not -64 <= int(m[3]) <= 64):
        return raw
    digits, shift = m[1] + (m[2] or ""), int(m[3] or 0) - len(m[2] or "")
    if shift < 0:
        if len(digits) + shift <= 0 or digits[shift:].strip("0"):
            return raw
        digits = digits[:shift]
    elif len(digits) + shift > 34:
        return raw
    return (digits + "0" * shift).lstrip("0") or "0"


class Withheld(ValueError):
    """Why a value can't be shown."""


@dataclass
class Change:
    changed: bool = False
    protected: bool = False
    numeric: bool = False


# Places of a tool result that its protocol defines.
ROOT, CONTENT, BLOCK, RESOURCE, PROTOCOL, OTHER = "root", "content", "block", "resource", "protocol", "other"


def place_of(value: dict, place: str, key: str) -> str:
    """Where the value under ``key`` is."""
    if place == ROOT and key == "content":
        return CONTENT
    if place == BLOCK and key == "resource" and value.get("type") == "resource":
        return RESOURCE
    if place == PROTOCOL or (place in (BLOCK, RESOURCE) and key == "annotations"):
        return PROTOCOL
    return OTHER


def place_in_list(place: str) -> str:
    return {CONTENT: BLOCK, PROTOCOL: PROTOCOL}.get(place, OTHER)


def opaque(value: dict, place: str, key: str) -> bool:
    """Whether the protocol has binary data here. Anywhere else the same keys are ordinary JSON."""
    return (place == RESOURCE and key == "blob") or (place == BLOCK and key == "data" and value.get("type") in ("image", "audio"))


def protected(place: str, key: str) -> bool:
    return place == PROTOCOL or (place in (BLOCK, RESOURCE) and key in ("type", "uri", "mimeType"))


def mask_json(value, change: Change, options: Options = DEFAULT, place: str = OTHER, name: str = "", allow_opaque: bool = False):
    """A JSON value with its strings and numbers masked, by the names of their fields, which pass down. Keys are never changed: a key or protocol field that would be sets ``change.protected``."""
    if isinstance(value, dict):
        out = {}
        for key, item in value.items():
            inherits = bool(field_label(name)) and not field_label(key)
            if mask_field(name if inherits else "", key, options) != key:
                change.protected = True
            if opaque(value, place, key):
                if not allow_opaque:
                    raise Withheld("opaque_pii_unavailable")
                out[key] = item
                continue
            out[key] = mask_json(item, change, options, place_of(value, place, key), name if inherits else key, allow_opaque)
            if protected(place, key) and isinstance(item, str) and out[key] != item:
                change.protected = True
        return out
    if isinstance(value, list):
        inner = place_in_list(place)
        out = [mask_json(x, change, options, inner, name, allow_opaque) for x in value]
        if place == PROTOCOL and any(isinstance(a, str) and a != b for a, b in zip(value, out, strict=True)):
            change.protected = True
        return out
    if isinstance(value, Digits):
        text = number_text(value)
        clean = mask_field(name, text, options)
        if clean != text:
            change.changed = change.numeric = True
            return clean
        return value
    if isinstance(value, str):
        if encoded_sensitive(value, options):
            raise Withheld("encoded_sensitive_data")
        clean = mask_field(name, value, options)
        change.changed = change.changed or clean != value
        return clean
    return value


def render(value) -> str:
    """JSON with numbers as they were written."""
    if isinstance(value, Digits):
        return str.__str__(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{render(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(render, value)) + "]"
    return json.dumps(value, ensure_ascii=False)


# Keywords of JSON Schema whose values aren't data.
SCHEMA_WORDS = frozenset(
    "$anchor $comment $dynamicAnchor $dynamicRef $id $ref $schema $vocabulary additionalItems additionalProperties allOf anyOf contains contentEncoding contentMediaType contentSchema dependencies dependentRequired "
    "deprecated else exclusiveMaximum exclusiveMinimum format id if items maxContains maxItems maxLength maxProperties maximum minContains minItems minLength minProperties minimum multipleOf not oneOf pattern prefixItems "
    "propertyNames readOnly required then type unevaluatedItems unevaluatedProperties uniqueItems writeOnly".split()
)
_NAMED_SCHEMAS = ("$defs", "definitions", "dependentSchemas", "patternProperties", "properties")


def mask_schema(value, options: Options = DEFAULT, name: str = ""):
    """A tool's schema without personal data: defaults and examples that hold some are left out, descriptions are masked; where a name or a constraint holds some, it is withheld."""

    def same(text: str) -> None:
        if mask(text, options) != text:
            raise Withheld("sensitive schema")

    def unchanged(item, under: str) -> bool:
        change = Change()
        mask_json(item, change, options, OTHER, under)
        return not (change.changed or change.protected)

    if isinstance(value, list):
        return [mask_schema(x, options, name) for x in value]
    if isinstance(value, str):
        same(number_text(value) if isinstance(value, Digits) else value)
        return value
    if not isinstance(value, dict):
        return value
    out = {}
    for key, item in value.items():
        same(key)
        if key in ("default", "example", "examples"):
            if unchanged(item, name):
                out[key] = item
        elif key in ("description", "title") and isinstance(item, str):
            out[key] = mask(item, options)
        elif key in ("const", "enum"):
            if not unchanged(item, name):
                raise Withheld("sensitive schema")
            out[key] = item
        elif key in _NAMED_SCHEMAS and isinstance(item, dict):
            for inner in item:
                same(inner)
            out[key] = {inner: mask_schema(schema, options, inner) for inner, schema in item.items()}
        else:
            if key not in SCHEMA_WORDS and key not in ("description", "title") and key not in _NAMED_SCHEMAS and not unchanged(item, key):
                raise Withheld("sensitive schema")
            out[key] = mask_schema(item, options, name)
    return out


# ---- columns ----------------------------------------------------------------------------
MASKED = "struct<ok:boolean,text:string,labels:array<string>,error:string>"
_MASKED_ARROW = pa.struct([("ok", pa.bool_()), ("text", pa.string()), ("labels", pa.list_(pa.string())), ("error", pa.string())])


def _row(name: str | None, text: str | None, options: Options) -> dict:
    if text is None:
        return {"ok": True, "text": None, "labels": [], "error": None}
    try:
        clean = mask_field(name, text, options) if name else mask(text, options)
        return {"ok": True, "text": clean.encode("utf-8", "replace").decode(), "labels": re.findall(r"\[REDACTED:(\w+)\]", clean), "error": None}
    except Exception as e:  # noqa: BLE001 - whatever fails, the text isn't shown
        return {"ok": False, "text": None, "labels": [], "error": type(e).__name__}


def masked(text: Column, name: Column | None = None, options: Options = DEFAULT) -> Column:
    """(ok, text, labels, error) of each text, under its field's name if there is one. Null stays null; a text that can't be inspected gives ok = false and no text."""

    @F.arrow_udf(MASKED)
    def run(names: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array([_row(n, t, options) for n, t in zip(names.to_pylist(), texts.to_pylist(), strict=True)], _MASKED_ARROW)

    return run(F.lit(None).cast("string") if name is None else name, text)
