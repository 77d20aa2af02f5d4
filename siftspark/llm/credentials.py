"""Credentials in source code and configuration, found and redacted.

Candidates are quoted strings and tokens. Each is measured, whatever way it came in: its alphabet, its Shannon
entropy and the entropy a random string of its length over that alphabet would have.
Where nothing around it speaks of a credential, it must come near the latter, and must
not be a digest, an identifier, made of words or an encoded public key. Where its key name, its place in
an address, its place among arguments or its issuer's prefix does, the threshold is lower, so that passwords
made by people are found as well. Placeholders, references and masks are never cases.

Nothing is left out for its length: keys, users and commands before a value may be of any, and so may texts.
"""

from __future__ import annotations

import base64
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from siftspark.llm.spans import apart

REDACTED = "REDACTED"

#: Share of a random string's entropy that a candidate must reach: after an issuer's prefix, in a context that speaks of a credential, and without any.
MARKED, IN_CONTEXT, ALONE = 0.3, 0.5, 0.8
#: Least length in context, quoted and alone; excerpts cut off inside a value show less.
LEAST_IN_CONTEXT, LEAST_QUOTED, LEAST_ALONE = 6, 12, 20
#: Excerpts are cut off at this length.
EXCERPT_CHARS = 120

# Words a key name ends in when its value is a credential.
_TERM = (
    r"(?:pass(?:word|wort|wd|phrase|code)|(?<![A-Za-z])pass|(?<=[a-z])Pass|pwd|(?<![A-Za-z])pw|kennwort|contrase(?:ñ|n)a|parole|пароль|secret|token|credential|(?<![A-Za-z])creds?|"
    r"authorization|(?<![A-Za-z])auth|api[_-]?key|(?<=[_-])key|(?<=[a-z])Key|(?<![\w-])keys?|(?<![A-Za-z])sig|signature)s?"
)
_KEY = rf"(?:(?<![0-9])[A-Za-zА-я_][\w.-]*?)?(?:{_TERM})(?![\w-])"
_VALUE = r"""(?:\[\]\w+\{\s*)?(?:(?P<q>["'`])(?P<in>(?:(?!(?P=q))[^\n])*)|(?P<bare>[^\s"'`<>,;]+))"""

_PAIR = r"""["'`][\w.@-]+["'`]\s*,\s*(?P<q>["'`])(?P<in>(?:(?!(?P=q))[^\n])*)"""

# Places that speak of a credential, after the signs (in lower case) without any of which a text has no such place.
_CONTEXTS = [
    # key = value in any spelling: assignment, mapping, call argument, list of flags, comment about an old value
    ((), re.compile(rf"(?i:(?<![\w.$?&-])-*(?P<key>{_KEY})[\"'`]?\]?(?:\s*:\s*(?:str|string|String))?[ \t]*(?:=>|:=|=|:|,(?=\s*[\"'`])|[ ]was(?=[ ]))[ \t]*){_VALUE}")),
    # a mapping entry named by the line before
    (("name:",), re.compile(rf"(?i:name:[ \t]*[\"']?(?P<key>{_KEY})[\"']?[ \t\r]*\n[ \t]*value:[ \t]*){_VALUE}")),
    # elements and attributes
    (("<",), re.compile(rf"<(?i:(?P<key>(?:[\w.]+:)?{_KEY}))(?:\s[^<>]*)?>\s*(?:<!\[CDATA\[)?(?P<bare>[^<>\n]+?)(?=\]\]>|</|\s*$)")),
    (("value=",), re.compile(rf"(?i:\b(?:key|name|id|property)=[\"'](?P<key>{_KEY})[\"']\s+value=){_VALUE}")),
    # flags and words followed by a value
    (("-",), re.compile(rf"(?i:(?<!\S)--?(?P<key>{_KEY})[ \t]+){_VALUE}")),
    (("login", "identified", "password"), re.compile(rf"(?i:(?<=\s)(?P<key>login\s+\S+\s+password|identified\s+by|password(?=\s+[\"']))\s+){_VALUE}")),
    (("mysql", "mariadb"), re.compile(r"(?:^|(?<=\s))(?P<key>(?:mysql|mysqldump|mariadb)\b(?:(?!\s(?:mysql|mariadb))[^\n|;&])*?\s-p)(?P<bare>[^\s\"'-][^\s\"']*)")),
    (("sshpass",), re.compile(rf"(?:^|(?<=\s))(?P<key>sshpass\s+-p\s*){_VALUE}")),
    # user and password of an address
    (("://",), re.compile(r"(?P<key>://[^\s/:@\"'`<>]+):(?P<bare>[^\s@\"'`<>]+?)(?=@|\Z)")),
    ((":thin:",), re.compile(r"(?P<key>:thin:[^\s/:@\"'`<>]+)/(?P<bare>[^\s@\"'`<>]+?)(?=@|\Z)")),
    (("@",), re.compile(r"(?P<key>(?<=[\"'`])[\w.-]+):(?P<bare>[^\s@\"'`<>/]+?)(?=@(?:tcp|unix|udp)?\()")),
    (("-u",), re.compile(r"(?P<key>(?:\s-u|(?<!\S)--user)[ =]?[\"']?[\w.@-]+):(?P<bare>[^\s\"']+)")),
    (("?", "&", ";"), re.compile(rf"(?P<key>[?&;](?i:{_KEY}))=(?P<bare>[^\s\"'`<>&;#]+)")),
    # authentication schemes
    (("bearer", "basic", "token", "apikey"), re.compile(r"(?P<key>(?i:\b(?:bearer|basic|token|apikey)))[ \t]+(?P<bare>[A-Za-z0-9+/=._~!*%^?#-]{6,})")),
    # places among arguments: what is after a user name, what signs, what logs in
    (("login", "connect", "auth", "signin", "credential"), re.compile(rf"(?P<key>(?i:(?<!\w)\w*(?:login|connect|auth|signin|credentials?)\w*\s*=?\s*\())\s*{_PAIR}")),
    (("(",), re.compile(rf"(?P<key>[:=\[(,]\s*\((?=\s*[\"'`][a-z]+_))\s*{_PAIR}")),
    (("sign",), re.compile(r"(?P<key>(?i:\bsign\w*\.?\w*\((?:(?!\bsign)[^\n\"'`])*,\s*))(?P<q>[\"'`])(?P<in>(?:(?!(?P=q))[^\n])*)")),
    (("echo", "printf"), re.compile(r"(?P<key>\b(?:echo|printf)\s+)(?P<q>[\"'])(?P<in>(?:(?!(?P=q))[^\n])*)(?=[\"']\s*\|[^\n]*(?i:login|stdin|passw))")),
]
# Without any of these, in lower case, a text has no key name.
_TERM_SIGNS = ("pass", "pwd", "pw", "kennwort", "contrase", "parole", "пароль", "secret", "token", "cred", "auth", "key", "sig")
_KEYED = frozenset(p for _, p in _CONTEXTS if _TERM in p.pattern)

#: Forms by which issuers mark their tokens: a place that speaks of a credential, as a key name is.
_KNOWN = re.compile(
    r"(?<![A-Za-z0-9_/+-])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|AIza[\w-]{30,}|gh[opsur]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|xox[abprse]-[\w-]{20,}|"
    r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|sk-[\w-]{20,}|hf_[A-Za-z0-9]{20,}|npm_[A-Za-z0-9]{20,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{8,})(?![A-Za-z0-9])"
)
# A line end as it stands, or as it is written in a literal of JSON or source code.
_END = r"(?:[ \t]*\r?\n|[ \t]*(?:\\r)?\\n)"
_PRIVATE_KEY = re.compile(
    rf"-----BEGIN (?:[A-Z0-9]+ ){{0,3}}PRIVATE KEY(?: BLOCK)?-----{_END}(?:[ \t]*[A-Za-z-]+:(?:(?!\\n|\n)[\s\S])*{_END}|{_END})*[ \t]*(?P<first>[A-Za-z0-9+/=_-]+)"
    rf"(?P<rest>(?:{_END}[ \t]*[A-Za-z0-9+/=_-]+(?![A-Za-z0-9+/=_ -]*-----))*)"
)
_BODY_LINE = re.compile(rf"{_END}[ \t]*([A-Za-z0-9+/=_-]+)")
_BLOCK = re.compile(r"-----BEGIN (?P<kind>[A-Z0-9 ]+)-----(?:(?!-----)[\s\S])*(?:-----END (?P=kind)-----|\Z)")
_LONG = re.compile(rf"(?<![\w+/-])[A-Za-z0-9+/_-]{{{LEAST_ALONE},}}={{0,2}}(?![\w+/=-])")
_QUOTED = re.compile(r"([\"'`])((?:(?!\1)\S)++)\1")

# Pairs of letters that make up most of English and of names in code; about one in six pairs of random letters is among them.
_PAIRS = frozenset(
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur ca el ta la ns di fo ho pe ec pr no ct us ac ot il tr ly nc et ut ss so rs un lo wa ge ie wh ee wi em ad ol rt po we na ul ni ts mo ow pa im mi ai sh ir su id os iv ia am fi ci vi pl ig tu ev ld ry mp fe bl ab gh ty op wo sa ay ex ke ui ck ap ag ac bo pi qu up ub if ey og od ue ug oc av da do".split()
)

_PLACEHOLDER = re.compile(
    r"(?i)^[<{\[(]|^\$[\w{(]|^%\w*[%(]|^![a-z]+$|^[@&][a-z_.]+$|^[x*•.·_#?-]+$|\$\{|\$\(|\{\{|%\(|\bredacted|^your[\s_-]|_here$|^<|change[_-]?me|^(?:todo|none|null|nil|true|false|undefined|example|placeholder|dummy|secret|password|test)$|"
    r"^(?:kv|vault|secret|ssm|op|arn|file|env|ref)[:/]|^sha\d{1,3}[-:]|^(?:https?|file)://|^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$|^\d+$|^(?:\d+\.)+\d+$|^\*+$|^[0-9a-f]{2}(?::[0-9a-f]{2})+$"
)
_REFERENCE = re.compile(r"^(?:process|os|env|config|settings|self|this|ctx|vault|secrets?|system|cfg|args?|params?|data|vars?|local|module|options?|request|req|import)\b[.\[(]|[()\[\]{}]|^\w+(?:\.[a-z_]\w*){2,}$", re.I)
_WORDS = re.compile(r"[a-zа-яäöüßéèáíóúñ]+(?:[-_ ./][a-zа-яäöüßéèáíóúñ]+)*|[A-ZА-Я]{2,}(?:[-_ .][A-ZА-Я]+)*|[a-z]{2,}(?:[A-Z][a-z]{2,})+|[A-Z][a-z]{2,}(?:[A-Z][a-z]{2,})*(?:[-_ ][A-Z]?[a-z]+)*")
_PATH = re.compile(r"~?\.{0,2}/?[a-z0-9_.-]*[a-z][a-z0-9_.-]*(?:/[a-z0-9_.-]+)+/?")
_HEX = re.compile(r"(?:0x)?(?:[0-9a-f]+|[0-9A-F]+)")
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_PUBLIC_BEFORE = re.compile(r"(?i)(?:sha\d{1,3}|md5|integrity|digest|checksum|etag|commit|fingerprint|ssh-\w+|ecdsa-\S+|public|cert\w*)\W{0,12}$")


def alphabet_of(text: str) -> int:
    """Size of the smallest usual alphabet the text is written in: digits, hex, lower case, alphanumeric, base64, printable."""
    if text.isdigit():
        return 10
    if _HEX.fullmatch(text):
        return 16
    if not text.isascii():
        return 160
    bare = text.rstrip("=")
    if bare.isalnum():
        return 36 if bare == bare.lower() or bare == bare.upper() else 62
    return 64 if re.fullmatch(r"[A-Za-z0-9+/_-]+", bare) else 94


def entropy(text: str) -> float:
    """Shannon entropy of the text's characters in bits; 0 for the empty text."""
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def expected_entropy(length: int, alphabet: int) -> float:
    """About the entropy a random text of that length over that alphabet shows."""
    if length < 2:
        return 0.0
    return math.log2(length) - (length - 1) / (2 * math.log(2) * alphabet) if length < alphabet else math.log2(alphabet) - (alphabet - 1) / (2 * math.log(2) * length)


def credible(value: str, share: float) -> bool:
    return entropy(value) >= share * expected_entropy(len(value), alphabet_of(value))


def _kinds(value: str) -> int:
    return sum(any(map(test, value)) for test in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))


def _in_context(value: str, bare: bool, cut: bool) -> bool:
    """Whether a value at a place that speaks of a credential is one."""
    if _PLACEHOLDER.search(value) or len(set(value)) < (2 if cut else 3):
        return False
    if any(c.isspace() for c in value) or (bare and _REFERENCE.search(value)):
        return False
    if cut:  # what is visible of it
        return credible(value, IN_CONTEXT)
    if len(value) < LEAST_IN_CONTEXT or _WORDS.fullmatch(value.strip(".,!?:;")) or _PATH.fullmatch(value):
        return False
    return _kinds(value) >= 2 and credible(value, IN_CONTEXT)


def _changes(text: str) -> float:
    """Share of neighbours that are of different kinds: lower case, upper case, digits, signs."""
    kinds = [(c.islower(), c.isupper(), c.isdigit()) for c in text]
    return sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, len(text) - 1)  # noqa: B905


def _spelled(text: str) -> bool:
    """Whether a text is made of words or abbreviations: its pairs of letters are those of words, or most of it is in pieces of one kind."""
    low = text.lower()
    pairs = [a + b for a, b in zip(low, low[1:]) if a.isalpha() and b.isalpha()]  # noqa: B905
    if len(pairs) >= 3 and sum(p in _PAIRS for p in pairs) > 0.42 * len(pairs):
        return True
    pieces = [p for p in re.split(r"[^A-Za-z0-9]+", text) if p]
    return len(pieces) > 1 and sum(len(p) for p in pieces if re.fullmatch(r"[A-Z]?[a-z]+\d{0,2}|[A-Z]+\d{0,2}|\d+", p)) >= 0.5 * sum(map(len, pieces))


def _alone(text: str, start: int, value: str) -> bool:
    """Whether a quoted string or a long token is a credential without any context."""
    core = value.rstrip("=")
    digits = len(re.findall(r"\d+", core))
    if len(core) < LEAST_QUOTED or (not digits and len(core) < LEAST_ALONE):
        return False
    if _HEX.fullmatch(core) or _UUID.fullmatch(core) or not core.isascii() or not any(c.isalpha() for c in core):
        return False
    if _PLACEHOLDER.search(value) or _WORDS.fullmatch(core) or _PATH.fullmatch(core) or re.search(r"://|^[\w.-]+@[\w-]+\.|\\", core):
        return False
    if "/" in core and _kinds(core.replace("/", "")) < 3:
        return False
    if re.fullmatch(r"(?:[A-Za-z]*\d*[-_/])*[A-Za-z]+\d*", core) or _PUBLIC_BEFORE.search(text[max(0, start - 40) : start]) or core.startswith("AAAA"):
        return False
    if alphabet_of(core) == 94 and (_REFERENCE.search(core) or _kinds(core) < 4):
        return False
    lower, upper = any(map(str.islower, core)), any(map(str.isupper, core))
    if not (lower and upper) and (digits < (2 if len(core) >= LEAST_ALONE else 3) or not core.isalnum()):
        return False
    if not digits and _changes(core) < 0.4:
        return False
    # Long tokens of three kinds that stand free aren't words; all others must not be spelled like them.
    free = text[start - 1 : start] not in ("=", ":", ".")
    if not (lower and upper and digits and free and len(core) >= LEAST_ALONE) and (_changes(core) < 0.12 or _spelled(core)):
        return False
    if _encodes_text(value):
        return False
    least = 3.5 if len(core) >= LEAST_ALONE else 3.0
    return credible(core, ALONE) and entropy(core) > least


def _encodes_text(value: str) -> bool:
    """Whether a token is the base64 form of readable text, which is a payload rather than a key."""
    try:
        raw = base64.b64decode(value.rstrip("=").replace("-", "+").replace("_", "/") + "=" * (-len(value.rstrip("=")) % 4), validate=True)
        return raw.decode().isprintable()
    except ValueError:
        return False


_PREFIX = re.compile(r"(?:AKIA|ASIA|AIza|gh[opsur]_|github_pat_|glpat-|xox[abprse]-|[sr]k_(?:live|test)_|sk-|hf_|npm_)?")


def _random(body: str) -> bool:
    """Whether what follows an issuer's prefix, or a key's opening line, is random; masks aren't."""
    return len(set(body)) >= 4 and credible(body, MARKED)


def _spans(text: str, cut: bool) -> Iterator[tuple[int, int, int]]:
    """(priority, start, end) of each candidate that is a credential."""
    end_of_text = len(text)
    blocks = [(m.start(), m.end()) for m in _BLOCK.finditer(text)] if "-----BEGIN" in text else []
    starts = [a for a, _ in blocks]

    def outside(at: int) -> bool:
        i = bisect_right(starts, at) - 1
        return i < 0 or at >= blocks[i][1]

    for m in _PRIVATE_KEY.finditer(text) if blocks else ():
        if _random(m["first"]) or (cut and m.end("first") == end_of_text):
            yield (0, m.start("first"), m.end("first"))
    for m in _KNOWN.finditer(text):
        if outside(m.start()) and _random(m[0][_PREFIX.match(m[0]).end() :]):
            yield (1, m.start(), m.end())
    low = text.lower()
    keyed = any(s in low for s in _TERM_SIGNS)
    for signs, pattern in _CONTEXTS:
        if (signs and not any(s in low for s in signs)) or (not keyed and pattern in _KEYED):
            continue
        for m in pattern.finditer(text):
            groups = m.groupdict()
            bare = groups.get("in") is None
            start, end = m.span("bare" if bare else "in")
            if not outside(start):
                continue
            value = text[start:end]
            scheme = re.match(r"(?i)(?:bearer|basic|token|digest|apikey)\s+(?=\S)", value)
            if scheme:
                start += scheme.end()
            elif not bare and (address := re.search(r"\w:/?/?[^\s/:@]+[:/]([^\s@]+)@", value)):
                start, end = start + address.start(1), start + address.end(1)
            while bare and end > start and text[end - 1] in ",;":
                end -= 1
            if bare and text[end - 1 : end] in ")]}" and not re.search(r"[(\[{]", text[start:end]):
                end -= len(text[start:end]) - len(text[start:end].rstrip(")]}"))
            if start < end and _in_context(text[start:end], bare, cut and end == end_of_text):
                yield (2, start, end)
    for m in _LONG.finditer(text):
        if outside(m.start()) and _alone(text, m.start(), m[0]):
            yield (3, m.start(), m.end())
    for m in _QUOTED.finditer(text):
        if outside(m.start()) and _alone(text, m.start(2), m[2]):
            yield (3, m.start(2), m.end(2))


def find_credentials(text: str | None, excerpt: bool = False) -> list[tuple[int, int]]:
    """Spans of the credentials in ``text``, in order and without overlap.

    In an excerpt, a backslash before n stands for a line end, and a value that reaches the
    cut is taken as far as it is visible. A private key is given by its first body line, whether its
    line ends stand as they are or are written as escapes.
    """
    if not text:
        return []
    seen = text.replace("\\n", " \n") if excerpt else text
    return [(start, end) for _, start, end in apart(_spans(seen, excerpt and len(text) >= EXCERPT_CHARS))]


def redact(text: str | None, excerpt: bool = False) -> str | None:
    """``text`` with each credential replaced by a word that is well formed wherever a credential was; all else unchanged."""
    if not text:
        return text
    spans = find_credentials(text, excerpt)
    seen = text.replace("\\n", " \n") if excerpt else text
    for m in _PRIVATE_KEY.finditer(seen) if "PRIVATE KEY" in seen else ():
        at = m.start("rest")
        spans += [(at + line.start(1), at + line.end(1)) for line in _BODY_LINE.finditer(m["rest"])]
    out, last = [], 0
    for start, end in sorted(spans):
        out += [text[last:start], REDACTED]
        last = end
    return "".join([*out, text[last:]])


_FOUND = ArrayType(StructType([StructField("line_no", LongType()), StructField("found", StringType())]))


def _found(text: str | None, excerpt: bool) -> list[dict]:
    out, line, seen = [], 1, 0
    for a, b in find_credentials(text, excerpt):
        if not excerpt:
            line, seen = line + text.count("\n", seen, a), a
        out.append({"line_no": line, "found": text[a:b]})
    return out


@F.arrow_udf(_FOUND)
def _found_in_text(texts: pa.Array) -> pa.Array:
    return pa.array([_found(v.as_py(), False) for v in texts], pa.list_(pa.struct([("line_no", pa.int64()), ("found", pa.string())])))


@F.arrow_udf(_FOUND)
def _found_in_excerpt(texts: pa.Array) -> pa.Array:
    return pa.array([_found(v.as_py(), True) for v in texts], pa.list_(pa.struct([("line_no", pa.int64()), ("found", pa.string())])))


@F.arrow_udf(StringType())
def _redact_text(texts: pa.Array) -> pa.Array:
    return pa.array([redact(v.as_py()) for v in texts], pa.string())


@F.arrow_udf(StringType())
def _redact_excerpt(texts: pa.Array) -> pa.Array:
    return pa.array([redact(v.as_py(), True) for v in texts], pa.string())


def credentials(rows: DataFrame, key: str, text: str, excerpt: bool = False) -> DataFrame:
    """One row for each distinct credential, line and row key: key, line_no, found.

    Null and empty texts give no row, nor do texts without credentials; rows sent twice
    count once; a key may be null; further columns are ignored. Lines of an excerpt aren't told apart: line_no is 1.
    """
    found = (_found_in_excerpt if excerpt else _found_in_text)(F.col(text))
    exploded = rows.select(F.col(key), F.explode(found).alias("__f"))
    return exploded.select(key, F.col("__f.line_no").alias("line_no"), F.col("__f.found").alias("found")).distinct()


def redacted(text: Column, excerpt: bool = False) -> Column:
    """The text of each row with its credentials redacted; null for null."""
    return (_redact_excerpt if excerpt else _redact_text)(text)
