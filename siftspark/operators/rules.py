"""Rules: patterns of instructions, weak signals and commands, with category, confidence and level.

All rules run in one Arrow function over a text: a rule's pattern is tried only where one of its anchors stands in the
text. Its findings come out as one array, so nothing is joined or shuffled, and the plan stays small however many rules there are.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftspark.functions import regexlang
from siftspark.operators.text import has_any
from siftspark.session import spread

# The level each category has.
IMPACT = {
    "instruction_override": 3, "system_prompt": 3, "encryption": 3, "sensitive_output": 3, "repo_change": 3, "certificate": 3, "remote_exec": 3, "hook_config": 3,
    "exfiltration": 2, "deletion": 2, "gpg_key": 2, "encoded_payload": 2, "hidden_text": 2, "abort_bait": 2, "obfuscation": 2,
    "install": 1, "arbitrary_command": 1, "secret_material": 1, "pii": 1,
}
LEVELS = {0: "none", 1: "base", 2: "medium", 3: "critical"}


@dataclass(frozen=True)
class Rule:
    rule_id: str
    rule_set: str
    category: str
    confidence: float
    pattern: str
    group: int = 0


_BEFORE = r"(?:previous|prior|above|earlier)"
_ORDERS = r"(?:instructions?|prompts?|rules?|directions?)"
_HOST = r"[a-z0-9][a-z0-9.-]*\.[a-z]{2,}"
_IPV4 = r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}"

# Ids, sets, categories and confidences. Patterns are our own; gaps within a line reach over up to 1000 characters.
RULES = [
    Rule("R01", "instruction", "instruction_override", 0.95, rf"\bignore\s+(?:(?:all|any|the|of|your|my|these|those)\s+){{0,4}}{_BEFORE}\s+(?:\w+\s+){{0,2}}{_ORDERS}"),
    Rule("R02", "instruction", "instruction_override", 0.95, rf"\bdisregard\s+(?:(?:all|any|the|of|your|these|everything)\s+){{0,4}}{_BEFORE}"),
    Rule("R03", "instruction", "instruction_override", 0.85, r"\bforget\s+(?:everything|all|your)\s+(?:(?:of|the|that|your|previous)\s+){0,3}(?:you|instructions?|rules?)"),
    Rule("R04", "instruction", "instruction_override", 0.95, r"(?:игнорируй|забудь|отмени|пренебреги)[а-яё]*\s+(?:[а-яё]+\s+){0,4}(?:инструкци|правил|указани|промпт)[а-яё]*"),
    Rule("R05", "instruction", "instruction_override", 0.6, r"\b(?:from\s+now\s+on,?\s+you\s+are|you\s+are\s+now\s+(?:a|an|the|in)|act\s+as\s+(?:a|an|if|though)|pretend\s+(?:to\s+be|you\s+are|that\s+you))\b|притворись|ты\s+теперь\s|представь,?\s+что\s+ты"),
    Rule("R06", "instruction", "instruction_override", 0.9, r"\b(?:do\s+not|don't|never)\s+(?:tell|inform|mention|reveal)\s+(?:[\w']+\s+){0,5}(?:the\s+)?user\b"),
    Rule("R07", "instruction", "instruction_override", 0.9, r"не\s+(?:говори|сообщай|упоминай|раскрывай)[а-яё]*\s+(?:[а-яё]+\s+){0,4}пользовател[а-яё]+"),
    Rule("R08", "instruction", "instruction_override", 0.6, r"\b(?:without|before)\s+(?:asking|confirming|telling|informing)\s+(?:with\s+)?(?:the\s+)?user\b"),
    Rule("R09", "instruction", "instruction_override", 0.7, r"\b(?:important|note|attention)\s*[:,]?\s*(?:to|for)\s+(?:any\s+|the\s+|all\s+)?(?:ai|llm|model|agent|assistant)s?\b"),
    Rule("R10", "instruction", "instruction_override", 0.7, r"(?:важно|внимание|заметка|примечание)\s*[:,]?\s*для\s+(?:[а-яё]+\s+)?(?:ии|нейросети|модели|агент[а-яё]*|ассистент[а-яё]*)"),
    Rule("R11", "instruction", "system_prompt", 0.8, r"</?(?:system|assistant|developer|human)(?:\s[^<>]*)?>"),
    Rule("R12", "instruction", "system_prompt", 0.9, r"\[/?INST\]|<</?SYS>>|<\|im_(?:start|end)\|>"),
    Rule("R13", "instruction", "system_prompt", 0.5, r"^[ \t]*(?:system|assistant|developer)[ \t]*:[ \t]"),
    Rule("R14", "instruction", "system_prompt", 0.5, r"\bsystem\s+prompt\b|системн[а-яё]+\s+промпт"),
    Rule("R15", "instruction", "system_prompt", 0.9, r"</?(?:system-reminder|tool_result|function_calls|function_results|user-prompt-submit-hook)>"),
    Rule("R16", "weak", "instruction_override", 0.3, r"\b(?:you|the\s+(?:ai|assistant|agent|model|llm))\s+(?:must|should|will|shall|(?:need|have)\s+to)\b"),
    Rule("R17", "weak", "instruction_override", 0.3, r"\b(?:when|if|once|after|before)\s+you\s+(?:read|see|receive|process|reply|open)\b"),
    Rule("R18", "weak", "instruction_override", 0.25, r"\b(?:answer|reply|respond|write)\s+(?:back\s+)?(?:only\s+|exclusively\s+)?(?:in|using|with)\b"),
    Rule("R19", "weak", "instruction_override", 0.3, r"\b(?:covertly|discreetly|in\s+secret|quietly|secretly|silently|stealthily)\b"),
    Rule("R20", "weak", "instruction_override", 0.35, r"\bthis\s+(?:file|document|message|page)\s+(?:\w+\s+){0,4}for\s+(?:the\s+|any\s+)?(?:ai|agent|assistant|model|llm)s?\b"),
    Rule("R21", "weak", "instruction_override", 0.3, r"\b(?:ты|вы|ассистент|агент)\s+(?:долж[а-яё]+|обязан[а-яё]*)\b"),
    Rule("R22", "weak", "instruction_override", 0.3, r"\b(?:втайне|молча|незаметно|по-тихому|скрытно|тайком|тайно)\b"),
    Rule("R23", "weak", "instruction_override", 0.35, r"\b(?:этот|данный)\s+(?:файл|документ)\s+(?:[а-яё]+\s+){0,3}для\s+(?:ии|агента|ассистента)\b"),
    Rule("R24", "command", "exfiltration", 0.85, r"\b(?:curl|wget|http)\s(?:[^\n|;]{0,1000}\s)?(?:-[dFT](?:[\s@\"']|$)|--data\S*|--form\S*|--json|--upload-file|--post-(?:data|file))"),
    Rule("R25", "command", "exfiltration", 0.9, r"\b(?:curl|wget)\s[^\n]{0,1000}\$\((?:cat|printenv|env|whoami|id)\b"),
    Rule("R26", "command", "exfiltration", 0.7, rf"\b(?:scp|sftp|rsync|ftp|nc|ncat|netcat|socat)\s[^\n|;]{{0,1000}}(?:{_HOST}|{_IPV4})"),
    Rule("R27", "command", "exfiltration", 0.5, rf"\bssh\s+(?:-\S+\s+)*[\w.-]+@(?:{_HOST}|{_IPV4})"),
    Rule("R28", "command", "exfiltration", 0.9, r"/dev/tcp/"),
    Rule("R29", "command", "deletion", 0.9, r"\brm\s+(?:-[a-z]+\s+)*-[a-z]*r[a-z]*\s+(?:-[a-z]+\s+)*(?:/|~|\$HOME|\*|\.)(?:\s|/|\*|$)"),
    Rule("R30", "command", "deletion", 0.7, r"\b(?:shred|srm|wipe)\s+-?[\w/]"),
    Rule("R31", "command", "deletion", 0.6, r"\bgit\s+push\s+(?:\S+\s+){0,3}(?:--force\b|-f\b)"),
    Rule("R32", "command", "deletion", 0.9, r"\bmkfs(?:\.\w+)?\s|\bdd\s[^\n]{0,1000}of=/dev/"),
    Rule("R33", "command", "encryption", 0.8, r"\bopenssl\s+enc\b|\bgpg\s+(?:-c\b|--symmetric)|\bage\s+-[er]\s|\bccrypt\b|\bzip\s+-e\b|\b7z\s+a\s[^\n]{0,1000}\s-p"),
    Rule("R34", "command", "sensitive_output", 0.7, r"\bprintenv\b|\benv\s*\||\becho\s+[\"']?\$\{?[A-Z_]*(?:TOKEN|SECRET|PASSWORD|KEY)\b"),
    Rule("R35", "command", "sensitive_output", 0.7, r"\bsecurity\s+(?:find-[a-z]+-password|dump-keychain|export)\b"),
    Rule("R36", "command", "install", 0.8, r"\b(?:apk|apt|apt-get|brew|choco|dnf|pacman|winget|yum|zypper)\s+(?:-\S+\s+)*(?:install|add|-S)\b"),
    Rule("R37", "command", "install", 0.7, r"\b(?:cargo|gem|go|npm|pip|pip3|pipx|pnpm|poetry|uv|yarn)\s+(?:install|add|get|i)\s+\S"),
    Rule("R38", "command", "repo_change", 0.9, r"\b(?:add-apt-repository|apt-add-repository)\b|/etc/(?:apt/(?:sources\.list|trusted\.gpg)|yum\.repos\.d|zypp/repos\.d|apk/repositories|pacman\.conf)|\b(?:zypper\s+(?:addrepo|ar)|(?:dnf|yum)(?:-|\s+)config-manager)\b"),
    Rule("R39", "command", "repo_change", 0.9, r"\b(?:npm|yarn|pnpm)\s+config\s+set\s+registry\b|\bpip\s+config\s+set\s+[\w.]*index-url|\bgo\s+env\s+-w\s+GOPROXY"),
    Rule("R40", "command", "repo_change", 0.8, r"\b(?:PIP_INDEX_URL|PIP_EXTRA_INDEX_URL|UV_INDEX_URL|NPM_CONFIG_REGISTRY|YARN_REGISTRY|GOPROXY|GONOSUMDB)\s*="),
    Rule("R41", "command", "repo_change", 0.6, r"\bbrew\s+tap\s+\S"),
    Rule("R42", "command", "gpg_key", 0.9, r"\bgpg\d?\s+(?:-\S+\s+)*--(?:import|recv-keys?|receive-keys)\b|\bapt-key\s+(?:add|adv)\b|\brpm\s+--import\b|/etc/apt/(?:keyrings|trusted\.gpg\.d)/"),
    Rule("R43", "command", "certificate", 0.9, r"\bupdate-ca-(?:certificates|trust)\b|\bsecurity\s+add-trusted-cert\b|\bcertutil\s+-A\b|\btrust\s+anchor\b|/usr/local/share/ca-certificates/|/etc/pki/ca-trust/"),
    Rule("R44", "command", "certificate", 0.7, r"\bcurl\s[^\n]{0,1000}(?:\s-k\b|--insecure\b)|--no-check-certificate\b|\bNODE_TLS_REJECT_UNAUTHORIZED\s*=\s*[\"']?0|\bGIT_SSL_NO_VERIFY\s*=\s*(?:1|true)|\bPYTHONHTTPSVERIFY\s*=\s*0|http\.sslVerify\s*=?\s*false"),
    Rule("R45", "command", "arbitrary_command", 0.6, r"\b(?:eval|exec)\s*[(\"$`]"),
    Rule("R46", "command", "arbitrary_command", 0.7, r"\bbase64\s+(?:-d|-D|--decode)\b[^\n]{0,1000}\|\s*(?:ba|da|z)?sh\b|\bxxd\s+-r\b|\bexec\(\s*base64|\b(?:python[23]?\s+-c|perl\s+-e|node\s+-e|ruby\s+-e)\s"),
    Rule("R47", "command", "arbitrary_command", 0.4, r"\bchmod\s+\+x\b|\bsudo\s|\bdoas\s"),
    Rule("R48", "command", "arbitrary_command", 0.7, r"\bcrontab\s+-|/etc/cron|\blaunchctl\s+(?:load|bootstrap)\b|/Library/Launch(?:Agents|Daemons)/|\bsystemctl\s+(?:--user\s+)?enable\b"),
]

def _before_blank(word: str, rest: str) -> tuple[str, ...]:
    """A word with the blanks that may follow it: one and then ``rest``, or any other."""
    return (word + rest, *(word + b for b in ("\t", "\n", "\f", "\r", "  ")))


#: Texts without any of a rule's anchors (in lower case) can't match it, and are spared its pattern.
ANCHORS = {
    "R01": ("ignore",), "R02": ("disregard",), "R03": ("forget",), "R04": ("игнорируй", "забудь", "отмени", "пренебреги"), "R05": ("now", "act", "pretend", "притворись", "теперь", "представь"), "R06": ("user",),
    "R07": ("пользовател",), "R08": ("user",), "R09": ("important", "note", "attention"), "R10": ("важно", "внимание", "заметка", "примечание"), "R11": ("system", "assistant", "developer", "human"),
    "R12": ("inst]", "sys>>", "im_start", "im_end"), "R13": ("system", "assistant", "developer"), "R14": ("prompt", "промпт"), "R15": ("system-reminder", "tool_result", "function_", "user-prompt"),
    "R16": ("must", "should", "will", "shall", "need", "have"), "R17": ("you",), "R18": ("answer", "reply", "respond", "write"), "R19": ("covertly", "discreetly", "secret", "quietly", "silently", "stealthily"), "R20": ("this",), "R21": ("долж", "обязан"),
    "R22": ("втайне", "молча", "незаметно", "тих", "скрытно", "тайком", "тайно"), "R23": ("для",), "R24": ("curl", "wget", "http"), "R25": ("curl", "wget"), "R26": ("scp", "ftp", "rsync", *_before_blank("nc", " "), "ncat", "netcat", "socat"), "R27": ("ssh",), "R28": ("/dev/tcp/",),
    "R29": ("rm",), "R30": ("shred", "srm", "wipe"), "R31": ("push",), "R32": ("mkfs", "of=/dev/"), "R33": ("openssl", "gpg", *_before_blank("age", " -"), "ccrypt", *_before_blank("zip", " -"), "7z"), "R34": ("printenv", "env", "echo"), "R35": ("security",),
    "R36": ("apt", "yum", "dnf", "apk", "brew", "choco", "pacman", "winget", "zypper"), "R37": ("pip", "npm", "yarn", "gem", "cargo", "go", "poetry", "uv"), "R38": ("apt-repository", "/etc/", "zypper", "config-manager"), "R39": ("config", "goproxy"),
    "R40": ("_index_url", "_registry", "goproxy", "gonosumdb", "pip_extra"), "R41": ("brew",), "R42": ("gpg", "apt-key", "rpm", "/etc/apt/"), "R43": ("update-ca", "security", "certutil", "trust", "ca-cert"), "R44": ("curl", "no-check-cert", "node_tls", "git_ssl", "pythonhttps", "sslverify"), "R45": ("eval", "exec"),
    "R46": ("base64", "xxd", "python", "perl", "node", "ruby"), "R47": ("chmod", "sudo", "doas"), "R48": ("crontab", "/etc/cron", "launch", "systemctl"),
}


def folded(text: str) -> str:
    """Lower case, with the long s and the Kelvin sign as case folding has them. Anchors are looked for in it."""
    low = text.lower()
    return low if low.isascii() else low.replace("ſ", "s")


def matches(text: str, low: str, rules: Sequence[Rule]) -> Iterator[tuple[Rule, int, int]]:
    """(rule, start, end) in characters of each match, rule by rule; ``low`` is the folded text."""
    for rule in rules:
        anchors = ANCHORS.get(rule.rule_id)
        if anchors is None or has_any(low, anchors):
            for m in regexlang.python(rule.pattern).finditer(text):
                start, end = m.span(rule.group)
                if start < end:
                    yield rule, start, end


def impact(category: Column) -> Column:
    """The level of a category as a number; 0 for unknown ones."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in IMPACT.items() for x in kv])[category], F.lit(0))


def level_name(level: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv])[level]


_HITS = "array<struct<rule_id:string,hits:bigint>>"


def rule_hits(docs: DataFrame, key: str, text: str, rules: list[Rule] = RULES) -> DataFrame:
    """Rows (key, rule_id, rule_set, category, confidence, hits) for the rules with a hit. Null and empty texts have none."""

    @F.arrow_udf(_HITS)
    def run(texts: pa.Array) -> pa.Array:
        out = []
        for value in texts.to_pylist():
            n: dict[str, int] = {}
            for rule, _, _ in matches(value, folded(value), rules) if value else ():
                n[rule.rule_id] = n.get(rule.rule_id, 0) + 1
            out.append([{"rule_id": r, "hits": h} for r, h in n.items()])
        return pa.array(out, pa.list_(pa.struct([("rule_id", pa.string()), ("hits", pa.int64())])))

    of = lambda what: F.create_map(*[F.lit(x) for r in rules for x in (r.rule_id, getattr(r, what))])[F.col("r.rule_id")].alias(what)
    return spread(docs).select(key, F.explode(run(F.col(text))).alias("r")).select(key, "r.rule_id", of("rule_set"), of("category"), of("confidence"), "r.hits")


class Place:
    """Line, fence and inline code at growing offsets of a text."""

    def __init__(self, text: str) -> None:
        self.text, self.at, self.line, self.fences, self.ticks = text, 0, 1, 0, 0

    def go(self, at: int) -> None:
        """To ``at``, which must not be before where it was."""
        part = self.text[self.at : at]
        self.line += part.count("\n")
        last = part.rfind("\n")
        self.ticks = part.count("`", last + 1) + (self.ticks if last < 0 else 0)
        # Fences are counted from left to right, also where one begins before and ends behind.
        edge = self.text.find("```", self.fence_end if self.fences else 0)
        while 0 <= edge and edge + 3 <= at:
            self.fences += 1
            self.fence_end = edge + 3
            edge = self.text.find("```", self.fence_end)
        self.at = at

    fence_end = 0

    @property
    def in_code(self) -> bool:
        return self.fences % 2 == 1 or self.ticks % 2 == 1


def confidence_at(rule: Rule, kind: str | None, place: Place) -> float:
    """A rule's confidence: lower for system prompts in instruction files (x 0.8) and for commands of files inside code (x 0.5)."""
    if kind == "instructions" and rule.category == "system_prompt":
        return round(rule.confidence * 0.8, 6)
    if kind == "file" and rule.rule_set == "command" and place.in_code:
        return round(rule.confidence * 0.5, 6)
    return rule.confidence


def excerpt(text: str, start: int, end: int) -> str:
    return text[start : min(end, start + 120)].replace("\n", "\\n")


FINDING = "array<struct<rule_id:string,category:string,level:int,confidence:double,start:int,end:int,line:int,excerpt:string>>"
_FINDING_ARROW = pa.list_(pa.struct([("rule_id", pa.string()), ("category", pa.string()), ("level", pa.int32()), ("confidence", pa.float64()), ("start", pa.int32()), ("end", pa.int32()), ("line", pa.int32()), ("excerpt", pa.string())]))


def found_in(text: str | None, kind: str | None = None, rules: Sequence[Rule] = RULES) -> list[dict]:
    """The findings of a text by start, then by rule; offsets in UTF-8 bytes."""
    if not text:
        return []
    hits = sorted(((start, i, rule, end) for i, (rule, start, end) in enumerate(matches(text, folded(text), rules))), key=lambda h: h[:2])
    at = in_bytes(text, {o for start, _, _, end in hits for o in (start, end)})
    place, out = Place(text), []
    for start, _, rule, end in hits:
        place.go(start)
        out.append({"rule_id": rule.rule_id, "category": rule.category, "level": IMPACT.get(rule.category, 0), "confidence": confidence_at(rule, kind, place), "start": at[start], "end": at[end], "line": place.line, "excerpt": excerpt(text, start, end)})
    return out


def in_bytes(text: str, offsets: set[int]) -> dict[int, int]:
    """UTF-8 byte offsets of character offsets."""
    if text.isascii():
        return {o: o for o in offsets}
    out, at, total = {}, 0, 0
    for o in sorted(offsets):
        total += len(text[at:o].encode("utf-8", "replace"))
        out[o], at = total, o
    return out


def findings_column(text: Column, kind: Column | None = None, rules: Sequence[Rule] = RULES) -> Column:
    """All findings of each text as one array."""

    @F.arrow_udf(FINDING)
    def run(texts: pa.Array, kinds: pa.Array) -> pa.Array:
        return pa.array([found_in(t, k, rules) for t, k in zip(texts.to_pylist(), kinds.to_pylist(), strict=True)], _FINDING_ARROW)

    # Called nondeterministic, as Spark would else run it once more for each filter on what it finds.
    return run.asNondeterministic()(text, F.lit(None).cast("string") if kind is None else kind)


def undominated_column(findings: Column) -> Column:
    """The findings that no other of their category dominates: overlaps with more confidence, or with as much and from an earlier rule, or an earlier place of that rule. Within the array, without a join."""
    stronger = lambda f, g: (
        (g.category == f.category) & (g.start < f.end) & (f.start < g.end)
        & ((g.confidence > f.confidence) | ((g.confidence == f.confidence) & ((g.rule_id < f.rule_id) | ((g.rule_id == f.rule_id) & (g.start < f.start)))))
    )
    return F.filter(findings, lambda f: ~F.exists(findings, lambda g: stronger(f, g)))


def rule_findings(docs: DataFrame, key: str, text: str, keep: tuple[str, ...] = (), rules: list[Rule] = RULES) -> DataFrame:
    """One row for each match: key, kept columns, rule_id, category, level, confidence, start, end (UTF-8 bytes), line, excerpt.

    Confidence is lowered for system prompts in instruction files (x 0.8) and for commands of
    files inside a code fence or inline code (x 0.5), if ``kind`` is among the kept columns. Null and empty texts have none.
    """
    found = findings_column(F.col(text), F.col("kind") if "kind" in keep else None, rules)
    return spread(docs.select(key, *keep, text)).select(key, *keep, F.explode(found).alias("__f")).select(key, *keep, "__f.*")
