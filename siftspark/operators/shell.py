"""Data flow of shell commands: what is read, decoded, downloaded and sent within a pipeline.

Nothing is run. Snippets that may be commands are found by a native filter; a small parser
(quotes, substitutions, pipes, lists, groups) turns them into pipelines of calls; what each call does is
looked up in a table made from the commands' manuals, and what the calls of a pipeline do gives the findings.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Args = Sequence[str]
Test = Callable[[Args], bool]


# ---- what is asked of a call's arguments ------------------------------------------------
def always(args: Args) -> bool:
    return True


def alone(args: Args) -> bool:
    return not args


def option(*names: str) -> Test:
    """One of these options is given, with or without ``=value``; a short one also within a cluster or with its value behind it."""
    long = frozenset(n for n in names if n.startswith("--"))
    exact = frozenset(names)
    letters = tuple(n[1] for n in names if len(n) == 2 and n[0] == "-" and n[1].isalpha())

    def test(args: Args) -> bool:
        for a in args:
            if a in exact or a.split("=", 1)[0] in long:
                return True
            if letters and len(a) > 2 and a[0] == "-" and a[1] in letters and a[1] != "-":
                return True
        return False

    return test


def word(*names: str) -> Test:
    """One of the arguments is one of these words."""
    return lambda args: not frozenset(names).isdisjoint(args)


def reading(pattern: re.Pattern) -> Test:
    return lambda args: any(pattern.search(a) for a in args)


def operand(pattern: re.Pattern) -> Test:
    return lambda args: any(pattern.match(a) for a in args if not a.startswith("-"))


def both(*tests: Test) -> Test:
    return lambda args: all(t(args) for t in tests)


def either(*tests: Test) -> Test:
    return lambda args: any(t(args) for t in tests)


def without(test: Test) -> Test:
    return lambda args: not test(args)


def first(*names: str) -> Test:
    return lambda args: bool(args) and args[0] in names


CREDENTIAL = re.compile(r"(?:^|[/~.=@])\.?(?:ssh/|aws/|gnupg/|kube/|docker/config|netrc\b|pgpass\b|npmrc\b|pypirc\b|git-credentials\b|env(?:\.\w+)?$|id_(?:dsa|ecdsa|ed25519|rsa)\b|credentials\b)|(?:^|/)\.(?:ssh|aws|gnupg|kube)$|/etc/(?:g?shadow|master\.passwd|passwd)\b")
SECRET_NAME = re.compile(r"\$\{?\w*(?:API_?KEY|ACCESS_?KEY|CREDENTIAL|PASSPHRASE|PASSW(?:OR)?D|PRIVATE|SECRET|TOKEN)\w*", re.I)
HOST = re.compile(r"(?:^|@|//)(?:[a-z0-9-]+\.)+[a-z][a-z0-9-]*(?=[:/]|$)|(?:^|@|//)\d{1,3}(?:\.\d{1,3}){3}\b|^\[[0-9a-f:]+\]", re.I)
#: What is lost for good if it is deleted: roots, homes, everything here, and the system's folders.
PRECIOUS = re.compile(r"(?:/\*?|~(?:/\*?)?|\$\{?HOME\}?(?:/\*?)?|\*|\.{1,2}/?\*?|/(?:bin|boot|dev|etc|home|lib|opt|root|sbin|usr|var)(?:/.*)?)$")
SOCKET = re.compile(r"/dev/(?:tcp|udp)/")

# ---- the table ---------------------------------------------------------------------------
# By effect: the programs that have it, and what their arguments must be for it.
_SHOW = "awk cat cut diff egrep fgrep grep head hexdump jq less more nl od paste rev rg sed sort strings tac tail tee uniq wc xxd yq"
_COPY = "7z cp cpio install mv pax rar tar zip"
_SHELL = "ash bash csh dash fish ksh sh tcsh zsh"
_SCRIPT = "node perl php python python2 python3 ruby"
_SYSTEM = "apk apt apt-get aptitude brew choco dnf emerge flatpak microdnf pacman pkg port scoop snap winget yum zypper"
_LANGUAGE = "bun cargo composer conda cpan gem go npm pip pip3 pipx pnpm poetry uv yarn"
_INDEX = re.compile(r"registry|index-url|GOPROXY", re.I)
_SENDS = option("-d", "--data", "--data-ascii", "--data-binary", "--data-raw", "--data-urlencode", "--json", "-F", "--form", "--form-string", "-T", "--upload-file")

MANUAL: tuple[tuple[str, str, Test], ...] = (
    # reads what should stay
    ("source", f"{_SHOW} {_COPY} curl rsync scp sftp", reading(CREDENTIAL)),
    ("source", "env", alone),
    ("source", "declare export set typeset", either(alone, reading(SECRET_NAME))),
    ("source", "history printenv", always),
    ("source", "echo printf", reading(SECRET_NAME)),
    ("source", "security", lambda args: bool(args) and (args[0].startswith("find-") or args[0] in ("dump-keychain", "export"))),
    # sends to another machine
    ("sink", "curl", either(_SENDS, option("-X", "--request"))),
    ("sink", "wget", option("--body-data", "--body-file", "--method", "--post-data", "--post-file")),
    ("sink", "ncat nc netcat socat telnet", either(reading(HOST), lambda args: len(args) > 1)),
    ("sink", "rsync scp sftp ssh", reading(HOST)),
    ("sink", "openssl", first("s_client")),
    # gives what it loads to the next command
    ("download", "curl", without(option("-o", "-O", "--output", "--remote-name"))),
    ("download", "wget", either(lambda args: any(re.fullmatch(r"-[a-zA-Z]*O-", a) for a in args), both(option("-O"), word("-")), lambda args: "--output-document=-" in args)),
    # runs what it is given
    ("shell", _SHELL, either(lambda args: all(a.startswith("-") for a in args), option("-c", "-s"))),
    ("shell", _SCRIPT, either(alone, option("-c", "-e", "-r"), word("-"))),
    ("shell", ". eval source", always),
    # decodes or unpacks
    ("decoder", "base32 base64", option("-d", "-D", "--decode")),
    ("decoder", "bzip2 gzip lz4 xz zstd", option("-d", "--decompress", "--uncompress")),
    ("decoder", "bunzip2 bzcat gunzip lzcat uncompress unxz unzstd xzcat zcat zstdcat", always),
    ("decoder", "openssl", both(first("enc"), option("-d"))),
    ("decoder", "gpg gpg2", option("-d", "--decrypt")),
    ("decoder", "xxd", option("-p", "-r")),
    # makes unreadable
    ("encryption", "openssl", both(first("enc"), without(option("-d")))),
    ("encryption", "gpg gpg2", option("-c", "-e", "--encrypt", "--symmetric")),
    ("encryption", "age ccrypt", always),
    # destroys
    ("deletion", "rm", both(lambda args: any(re.match(r"-[a-zA-Z]*[rR]|--recursive$", a) for a in args), operand(PRECIOUS))),
    ("deletion", "find", both(word("-delete"), operand(PRECIOUS))),
    ("deletion", "dd", reading(re.compile(r"^of=/dev/"))),
    ("deletion", "diskutil mkfs shred srm wipe", always),
    # adds software, and where it comes from
    ("install", _SYSTEM, either(word("add", "install"), option("-S"))),
    ("install", _LANGUAGE, word("add", "get", "i", "install")),
    ("repo", "brew", word("tap")),
    ("repo", _LANGUAGE, both(word("config"), word("set"), reading(_INDEX))),
    ("repo", "go", both(word("env"), word("-w"))),
    ("repo", "add-apt-repository apt-add-repository", always),
    ("repo", "rpm", word("--import")),
    # adds trust
    ("gpg", "gpg gpg2", option("--import", "--receive-keys", "--recv-key", "--recv-keys")),
    ("gpg", "apt-key", always),
    ("gpg", "rpm", word("--import")),
    ("cert", "security", word("add-certificates", "add-trusted-cert")),
    ("cert", "certutil trust update-ca-certificates update-ca-trust", always),
    # stays
    ("persist", "crontab", always),
    ("persist", "launchctl", word("bootstrap", "load")),
    ("persist", "systemctl", word("enable")),
)


def _by_program() -> dict[str, list[tuple[str, Test]]]:
    out: dict[str, list[tuple[str, Test]]] = {}
    for effect, programs, test in MANUAL:
        for program in programs.split():
            out.setdefault(program, []).append((effect, test))
    return out


_EFFECTS = _by_program()


def effects(name: str, args: Args) -> set[str]:
    """What a call does, by the table."""
    known = _EFFECTS.get(name) or (_EFFECTS["mkfs"] if name.startswith("mkfs.") else ())
    return {effect for effect, test in known if test(args)}


#: Commands that run the command behind their options: the letters of options with a value of their own, and how many operands come first.
WRAPPERS = {
    "command": ("", 0), "doas": ("Cu", 0), "env": ("CSu", 0), "exec": ("a", 0), "ionice": ("cnpu", 0), "nice": ("n", 0), "nohup": ("", 0), "setsid": ("", 0), "stdbuf": ("eio", 0),
    "sudo": ("CDghpRrTtuU", 0), "time": ("fo", 0), "timeout": ("ks", 1), "xargs": ("adEILnPs", 0),
}
# Well-known services that hide where an address leads.
SHORTENERS = ("bit.ly", "buff.ly", "cutt.ly", "goo.gl", "is.gd", "ow.ly", "rb.gy", "rebrand.ly", "shorturl.at", "t.co", "t.ly", "tiny.cc", "tinyurl.com", "v.gd")

COMMANDS = sorted(_EFFECTS.keys() - {".", "history"})
#: A line may hold commands if one of these names stands anywhere in it, or a sign of an expansion or of a socket; where in the line is for the parser to say.
_NAMED = r"(?<![A-Za-z0-9_])(?:" + "|".join(map(re.escape, COMMANDS)) + r"|history(?=\s*(?:$|[|;&>)\d-])))(?![A-Za-z0-9_])|\$'|\$[({]|/dev/(?:tcp|udp)/"
#: A text may hold commands if one of its lines may, or by its prompts and fences.
CANDIDATE = rf"(?m){_NAMED}|^\s*\$\s|^```"
#: Sources that are scripts whatever they begin with.
SCRIPTS = (".sh", ".bash", ".zsh")

_LIKELY = re.compile(_NAMED)
_TOKENS = re.compile(r"[A-Za-z0-9_]+")
_HEADS = frozenset(_TOKENS.match(c)[0] for c in (*COMMANDS, "history"))


def _likely(line: str) -> bool:
    """Whether a line may hold commands: the names' first words are looked for before the pattern is tried."""
    return ("$" in line or "/dev/" in line or not _HEADS.isdisjoint(_TOKENS.findall(line))) and bool(_LIKELY.search(line))


class _Unparsed(ValueError):
    pass


def _words(text: str, at: int, stop: str, ends: list[int] | None = None) -> tuple[list[list], int]:
    """Pipelines from ``at`` to the closing sign ``stop``; each is a list of calls, a call a list of (word, quoted, substitutions). ``ends`` gets where each but the last ends."""
    pipelines: list[list] = [[[]]]
    word: list[str] = []
    subs: list = []
    open_word = quoted = False

    def close() -> None:
        nonlocal open_word, quoted, subs
        if open_word:
            pipelines[-1][-1].append(("".join(word), quoted, subs))
            word.clear()
            subs, open_word, quoted = [], False, False

    def end_call() -> None:
        close()
        if pipelines[-1][-1]:
            pipelines[-1].append([])

    def end_pipeline() -> None:
        end_call()
        if pipelines[-1] != [[]]:
            pipelines.append([[]])
            if ends is not None:
                ends.append(at)

    while at < len(text):
        c = text[at]
        if c == stop:
            close()
            return pipelines, at + 1
        if c == "\\" and at + 1 < len(text):
            if text[at + 1] != "\n":
                word.append(text[at + 1])
                open_word = True
            at += 2
        elif c == "'":
            end = text.find("'", at + 1)
            if end < 0:
                raise _Unparsed
            word.append(text[at + 1 : end])
            open_word = quoted = True
            at = end + 1
        elif c == '"':
            at += 1
            open_word = quoted = True
            while at < len(text) and text[at] != '"':
                if text[at] == "\\" and at + 1 < len(text):
                    word.append(text[at + 1])
                    at += 2
                elif text.startswith("$(", at):
                    inner, nxt = _words(text, at + 2, ")")
                    subs.append(inner)
                    word.append(text[at:nxt])
                    at = nxt
                else:
                    word.append(text[at])
                    at += 1
            if at >= len(text):
                raise _Unparsed
            at += 1
        elif text.startswith(("$(", "<(", ">("), at) and not text.startswith("$((", at):
            inner, nxt = _words(text, at + 2, ")")
            subs.append(inner)
            word.append(text[at:nxt])
            open_word = True
            at = nxt
        elif c == "`":
            inner, nxt = _words(text, at + 1, "`")
            subs.append(inner)
            word.append(text[at:nxt])
            open_word = True
            at = nxt
        elif c in " \t\r":
            close()
            at += 1
        elif c == "#" and not open_word:
            end = text.find("\n", at)
            at = len(text) if end < 0 else end
        elif c == "\n" or c == ";":
            end_pipeline()
            at += 1
        elif text.startswith(("||", "&&"), at):
            end_pipeline()
            at += 2
        elif c == "|":
            end_call()
            at += 2 if text.startswith("|&", at) else 1
        elif c == "&" and text[at + 1 : at + 2] not in (">",) and not (word and word[-1] in "<>"):
            end_pipeline()
            at += 1
        elif c in "({" and not open_word:
            inner, nxt = _words(text, at + 1, ")" if c == "(" else "}")
            pipelines[-1][-1].append(("(group)", False, [inner]))
            at = nxt
        else:
            word.append(c)
            open_word = True
            at += 1
    if stop:
        raise _Unparsed
    close()
    return pipelines, at


def _called(words: list) -> tuple[str, list[str]]:
    """Program and arguments of a call: what is behind assignments to its environment and behind commands that run commands."""
    items = [w for w, _, _ in words]
    at = 0
    while at < len(items):
        if "=" in items[at] and re.match(r"[A-Za-z_]\w*\+?=", items[at]) and at + 1 < len(items):
            at += 1
            continue
        name = items[at].rsplit("/", 1)[-1].lower()
        if name not in WRAPPERS or at + 1 == len(items):
            return name, items[at + 1 :]
        valued, operands = WRAPPERS[name]
        at += 1
        while at < len(items) and items[at].startswith("-"):
            at += 2 if len(items[at]) == 2 and items[at][1] in valued and at + 2 < len(items) else 1
        at += operands if at + operands < len(items) else 0
    return "", []


# Category and confidence of what a single call does.
_SINGLE = {"deletion": ("deletion", 0.9), "encryption": ("encryption", 0.8), "install": ("install", 0.7), "repo": ("repo_change", 0.9), "gpg": ("gpg_key", 0.9), "cert": ("certificate", 0.9), "persist": ("arbitrary_command", 0.7)}


def _inside(words: list) -> set[str]:
    """What the calls within a call's substitutions do."""
    out: set[str] = set()
    for _, _, subs in words:
        for pipelines in subs:
            for pipeline in pipelines:
                for call in pipeline:
                    if call:
                        out |= effects(*_called(call)) | _inside(call)
    return out


def _judge(pipelines: list, found: list[tuple[str, float]]) -> None:
    for pipeline in pipelines:
        calls = [c for c in pipeline if c]
        before: set[str] = set()
        lone = False
        for k, call in enumerate(calls):
            name, args = _called(call)
            own, inner = effects(name, args), _inside(call)
            if any(SOCKET.search(w) for w, _, _ in call):
                found.append(("exfiltration", 0.95))
            elif {"source", "sink"} <= own or ("sink" in own and "source" in before | inner) or (name in ("curl", "wget") and "source" in inner):
                found.append(("exfiltration", 0.95))
            elif "sink" in own and k:
                found.append(("exfiltration", 0.85))
            if "shell" in own and ("download" in before | inner or any("curl" in w or "wget" in w for w, _, s in call if s)):
                found.append(("remote_exec", 0.95))
            elif "shell" in own and "decoder" in before | inner:
                found.append(("remote_exec", 0.9))
            found += [_SINGLE[c] for c in sorted(own & set(_SINGLE))]
            if name and re.match(r"\$'|[^<>]*\$\{[^}]*[#%:/]", call[0][0]) and not call[0][1]:
                found.append(("arbitrary_command", 0.7))
            lone = lone or "source" in own
            before |= own | inner
        if lone and not any(c == "exfiltration" for c, _ in found):
            found.append(("sensitive_output", 0.75))
        for call in calls:
            for _, _, subs in call:
                for inner_pipelines in subs:
                    _judge(inner_pipelines, found)


def _snippets(text: str, source: str | None) -> Iterator[tuple[str, bool, int]]:
    """(commands, whether they illustrate a text, offset) of a script, of fenced blocks, of prompts, or of lines that name a command."""
    if text.startswith("#!") or (source or "").lower().endswith(SCRIPTS):
        yield text, False, 0
        return
    rest, last = [], 0
    for m in re.finditer(r"^```(\w*)[^\n]*\n([\s\S]*?)^```", text, re.M):
        if m[1].lower() in ("", "sh", "bash", "zsh", "shell", "console", "terminal"):
            rest.append((last, text[last : m.start()]))
            last = m.end()
            yield re.sub(r"(?m)^\$ ", "  ", m[2]), True, m.start(2)
    rest.append((last, text[last:]))
    for offset, part in rest:
        for line in part.split("\n"):
            at = offset + len(line) - len(line.lstrip())
            offset += len(line) + 1
            line = line.strip()
            if line.startswith("$ "):
                yield line[2:], False, at + 2
            elif _likely(line):
                yield line, False, at


def shell_spans(text: str | None, kind: str | None = None, source: str | None = None) -> list[tuple[str, float, int, int]]:
    """(category, confidence, start, end) of what each pipeline in a text does; what can't be parsed gives none. In files, illustrations count half."""
    if not text:
        return []
    out = []
    for snippet, docs, offset in _snippets(text, source):
        found: list[tuple[str, float]] = []
        placed: list[tuple[int, int]] = []
        ends: list[int] = []
        try:
            last = 0
            pipelines = _words(snippet, 0, "", ends)[0]
            for pipeline, end in zip(pipelines, [*ends, len(snippet)], strict=True):
                _judge([pipeline], found)
                start = last + len(snippet[last:end]) - len(snippet[last:end].lstrip("\r\n\t ;&"))
                placed += [(offset + start, offset + start + len(snippet[start:end].rstrip()))] * (len(found) - len(placed))
                last = end
        except (_Unparsed, RecursionError):
            continue
        plain = re.search(r"http://|https?://\d+\.\d+\.\d+\.\d+", snippet) or any(s in snippet for s in SHORTENERS) or re.search(r"base64\s+(?:-d|--decode)", snippet)
        for (category, confidence), (start, end) in zip(found, placed, strict=True):
            if category == "remote_exec":
                confidence = 0.7 if plain else 0.4  # by where the code comes from
            if docs and kind == "file":
                confidence /= 2
            out.append((category, confidence, start, end))
    return out


def shell_findings(text: str | None, kind: str | None = None, source: str | None = None) -> list[tuple[str, float]]:
    """(category, confidence) of what the commands in a text do, each once."""
    best: dict[str, float] = {}
    for category, confidence, _, _ in shell_spans(text, kind, source):
        best[category] = max(best.get(category, 0), confidence)
    return sorted(best.items())


def shell(docs: DataFrame, key: str, text: str, kind: str = "kind", source: str = "source") -> DataFrame:
    """key, category, confidence, start, end (characters) of what each command of each document does, each place and category once; only texts that may hold commands leave the JVM."""
    out = "array<struct<category:string,confidence:double,start:int,end:int>>"
    arrow = pa.list_(pa.struct([("category", pa.string()), ("confidence", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    @F.arrow_udf(out)
    def run(texts: pa.Array, kinds: pa.Array, sources: pa.Array) -> pa.Array:
        rows = []
        for t, k, s in zip(texts.to_pylist(), kinds.to_pylist(), sources.to_pylist(), strict=True):
            best: dict[tuple, float] = {}
            for category, confidence, start, end in shell_spans(t, k, s):
                best[category, start, end] = max(confidence, best.get((category, start, end), 0))
            rows.append([{"category": c, "confidence": f, "start": a, "end": b} for (c, a, b), f in best.items()])
        return pa.array(rows, arrow)

    script = F.lower(F.coalesce(F.col(source), F.lit("")))
    likely = docs.where(F.rlike(F.col(text), F.lit(CANDIDATE)) | F.startswith(F.col(text), F.lit("#!")) | F.rlike(script, F.lit(r"\.(?:sh|bash|zsh)\z")))
    return likely.select(key, F.explode(run(F.col(text), F.col(kind), F.col(source))).alias("f")).select(key, "f.*")
