"""Rule tables for grading and redaction.

Patterns are kept once, in the RE2 spelling users configure.  `java_regex` derives the
spelling Spark's regex functions need, so the two can never drift apart.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields, replace
from functools import lru_cache

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

LEVELS = ("S1", "S2", "S3")
ACTIONS = ("allow", "redact", "review", "block")


@dataclass(frozen=True)
class PatternRule:
    """Replace every match of `pattern` by [REDACTED:tag].

    `anchors`: literals of which at least one occurs in any match (a cheap pre-check);
    `option`: name of the opt-in switch, None for rules that are always on;
    `probe`: a look-around-free regex that any match contains, for rules without a literal;
    `run_class`: a class the match must start with a whole run of.  The regex is then tried
    only at run starts, which keeps long runs linear on a backtracking engine.
    """

    pattern: str
    tag: str
    anchors: tuple[str, ...] = ()
    option: str | None = None
    run_class: str | None = None
    probe: str | None = None


@dataclass(frozen=True)
class LabelRule:
    """Replace the word that follows a label.  `optional_gap` labels also accept a bare space."""

    label: str
    tag: str
    anchors: tuple[str, ...]
    needs_separator: bool = False
    option: str | None = None

    @property
    def pattern(self) -> str:
        verb = r"\s+(?:is|are|was|were)(?:\s+(?:in|at|on|of|for)){0,3}"
        if self.needs_separator:
            follow = rf"(?:{verb}|\s*[=:])\s*"
        else:
            follow = rf"(?:{verb}\s*|\s*[=:]\s*|\s+)"
        return rf"\b(?:{self.label})\b{follow}"


# Rule patterns, tags and defaults below decide results and are kept as given.

PRIVATE_IP = r"\b(?:10|172\.(?:1[6-9]|2\d|3[01])|192\.168)\.\d{1,3}\.\d{1,3}\b"
PREFIXED_KEY = r"\b(?:sk|key|token)-[A-Za-z0-9]{16,}\b"
PEM_KIND = r"(?:RSA |EC |DSA |OPENSSH )?"

PATTERN_RULES = (
    PatternRule(
        rf"-----BEGIN {PEM_KIND}PRIVATE KEY-----[\s\S]*?-----END {PEM_KIND}PRIVATE KEY-----",
        "PRIVATE_KEY",
        ("PRIVATE KEY-----",),
    ),
    PatternRule(PREFIXED_KEY, "KEY", ("sk-", "key-", "token-")),
    PatternRule(r"\b(?:sk_live|sk_test)_[A-Za-z0-9]{24,}\b", "KEY", ("sk_live_", "sk_test_")),
    PatternRule(r"\bghp_[A-Za-z0-9]{36,}\b", "KEY", ("ghp_",)),
    PatternRule(r"\bgho_[A-Za-z0-9]{36,}\b", "KEY", ("gho_",)),
    PatternRule(r"\bya29\.[A-Za-z0-9_-]{16,}", "KEY", ("ya29.",)),
    PatternRule(r"\bxoxb-[A-Za-z0-9-]{10,}", "KEY", ("xoxb-",)),
    PatternRule(r"\bxoxp-[A-Za-z0-9-]{10,}", "KEY", ("xoxp-",)),
    PatternRule(r"\bASIA[0-9A-Z]{16}\b", "AWS_KEY", ("ASIA",)),
    PatternRule(r"\bAKIA[0-9A-Z]{16}\b", "AWS_KEY", ("AKIA",)),
    PatternRule(
        r"""(?:mysql|postgres|postgresql|mongodb|redis|amqp)://[^\s"'<>]+""", "DB_CONNECTION", ("://",)
    ),
    PatternRule(
        r"(?:快递单号|运单号|取件码)[：:\s]*[A-Za-z0-9]{6,20}", "DELIVERY", ("快递单号", "运单号", "取件码")
    ),
    PatternRule(
        r"(?:门禁码|门禁密码|门锁密码|开门密码)[：:\s]*[A-Za-z0-9#*]{3,12}",
        "ACCESS_CODE",
        ("门禁码", "门禁密码", "门锁密码", "开门密码"),
    ),
    PatternRule(PRIVATE_IP, "INTERNAL_IP", ("10.", "172.", "192.168."), "internal_ip"),
    PatternRule(
        r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
        "EMAIL",
        ("@",),
        "email",
        r"[A-Za-z0-9._%+\-]",
    ),
    PatternRule(
        r"""(?m)^(?:export\s+)?[A-Z_]{2,}=(?:"|')?[^\s"']+(?:"|')?$""", "ENV_VAR", ("=",), "env_var"
    ),
    PatternRule(r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{1,7}\b", "CARD", (), "credit_card", probe=r"\d{4}[\s-]?\d{4}"),
    PatternRule(r"\b1[3-9]\d{9}\b", "PHONE", (), "chinese_phone", probe=r"1[3-9]\d{9}"),
    PatternRule(r"\b\d{17}[\dXx]\b", "ID", (), "chinese_id", probe=r"\d{17}"),
    PatternRule(
        r"[\p{Han}]{2,}(?:省|市|区|县|镇|路|街|巷|弄|号|栋|幢|室|楼|单元|门牌)\d*[\p{Han}\d]*",
        "ADDRESS",
        ("省", "市", "区", "县", "镇", "路", "街", "巷", "弄", "号", "栋", "幢", "室", "楼", "单元", "门牌"),
        "chinese_address",
        r"\p{Han}",
    ),
)

LABEL_RULES = (
    LabelRule(
        r"password|passwd|pwd|passcode|master[_\s]?password",
        "PASSWORD",
        ("password", "passwd", "pwd", "passcode"),
    ),
    LabelRule(r"credit\s*card|card\s*number", "CARD", ("card",), needs_separator=True),
    LabelRule(r"api[_\s]?key|access[_\s]?key|secret[_\s]?key", "API_KEY", ("key",)),
    LabelRule(r"secret", "SECRET", ("secret",), needs_separator=True),
    LabelRule(r"(?:auth[_\s]?)?token|bearer", "TOKEN", ("token", "bearer")),
    LabelRule(r"(?:credential|cred)s?", "CREDENTIAL", ("cred",)),
    LabelRule(r"ssn|social\s+security\s+number", "SSN", ("ssn", "social"), needs_separator=True),
    LabelRule(r"pin|pin\s*code|pin\s*number", "PIN", ("pin",), needs_separator=True, option="pin"),
)

# literals (lower case) one of which any match of a default grading pattern holds
PATTERN_ANCHORS = {
    PRIVATE_IP: ("10.", "172.", "192.168."),
    r"""(?:mysql|postgres|postgresql|mongodb|redis|amqp)://[^\s"']+""": ("://",),
    PREFIXED_KEY: ("sk-", "key-", "token-"),
    rf"-----BEGIN {PEM_KIND}PRIVATE KEY-----": ("private key-----",),
    r"AKIA[0-9A-Z]{16}": ("akia",),
    r"ASIA[0-9A-Z]{16}": ("asia",),
}

PLACEHOLDER = r"\[REDACTED:[A-Z_]+\]"
PATH_TOKEN = r"""(?:~|\.{1,2}|/)[^\s"'<>]+|[A-Za-z]:\\[^\s"'<>]+"""
FILE_SUFFIXES = (".pem", ".key", ".p12", ".pfx", ".env")
FILE_WORDS = ("id_rsa", "id_dsa", "id_ecdsa", "id_ed25519")
MAX_TEXT_BYTES = 1024 * 1024
MAX_BODY_BYTES = 10 * 1024 * 1024
OPTION_NAMES = (
    "internal_ip", "email", "env_var", "credit_card",
    "chinese_phone", "chinese_id", "chinese_address", "pin",
)
DEFAULT_ON = ("email", "chinese_phone", "chinese_id")
FORCED_ON = ("internal_ip", "env_var", "credit_card")


@dataclass(frozen=True)
class Rules:
    """The eight grading lists, with their default values (fixed values)."""

    keywords_s2: tuple[str, ...] = ("password", "api_key", "secret", "token", "credential", "auth_token")
    keywords_s3: tuple[str, ...] = ("ssh", "id_rsa", "private_key", ".pem", ".key", ".env", "master_password")
    patterns_s2: tuple[str, ...] = (
        PRIVATE_IP,
        r"""(?:mysql|postgres|postgresql|mongodb|redis|amqp)://[^\s"']+""",
        PREFIXED_KEY,
    )
    patterns_s3: tuple[str, ...] = (
        rf"-----BEGIN {PEM_KIND}PRIVATE KEY-----",
        r"AKIA[0-9A-Z]{16}",
        r"ASIA[0-9A-Z]{16}",
    )
    tools_s2: tuple[str, ...] = ("exec", "shell")
    tools_s3: tuple[str, ...] = ("system.run", "sudo", "ssh")
    paths_s2: tuple[str, ...] = ("~/secrets", "~/private")
    paths_s3: tuple[str, ...] = ("~/.ssh", "/etc", "~/.aws", "~/.config/credentials", "/root")

    def configured(self, **lists) -> "Rules":
        """Service-level override: a non-empty list replaces the default list as a whole."""
        return replace(self, **{k: tuple(v) for k, v in lists.items() if v})

    def requested(self, spark: SparkSession, **lists) -> "Rules":
        """Per-request override: any given list replaces, even an empty one; bad regexes are refused."""
        out = replace(self, **{k: tuple(str(x) for x in v) for k, v in lists.items() if v is not None})
        bad = [p for p in out.patterns_s2 + out.patterns_s3 if not pattern_compiles(p)]
        if bad:
            raise ValueError(f"invalid privacy pattern {bad[0]!r}")
        return out

    def usable(self, spark: SparkSession) -> "Rules":
        """Drop patterns that do not compile; grading skips them silently."""

        def keep(ps):
            return tuple(p for p in ps if pattern_compiles(p))

        return replace(self, patterns_s2=keep(self.patterns_s2), patterns_s3=keep(self.patterns_s3))

    def as_rows(self) -> list[tuple[str, int, str]]:
        return [(f.name, i, v) for f in fields(self) for i, v in enumerate(getattr(self, f.name))]


@dataclass(frozen=True)
class Policy:
    """Grading settings: on/off, what to do per level, rule lists and redaction switches."""

    enabled: bool = True
    handling_s2: str = "redact"
    handling_s3: str = "block"
    rules: Rules = field(default_factory=Rules)
    options: frozenset[str] = frozenset(DEFAULT_ON)
    placeholder_s3: str = "[PRIVATE]"
    placeholder_review: str = "[REVIEW_REQUIRED]"

    def action_for(self, level: str) -> str:
        if level == "S1":
            return "allow"
        wanted = (self.handling_s3 if level == "S3" else self.handling_s2).strip().lower() or "allow"
        return wanted if wanted in ACTIONS else "block"


#: what Java takes and RE2 refuses: look-around, atomic groups, back references, possessive quantifiers
NOT_RE2 = re.compile(r"\\[1-9kGXRZ]|\(\?(?:[=!>]|<[=!])|(?:[*+?]|\{\d+,?\d*\})\+")


@lru_cache(4096)
def pattern_compiles(pattern: str) -> bool:
    """Whether a user's pattern is one; asks the driver's JVM, without a job."""
    plain = re.sub(r"\\Q.*?(?:\\E|$)|\\[^1-9kGXRZ]|\[\^?\]?(?:\[:\^?\w+:\]|\\.|[^\]\\])*\]", "x", pattern, flags=re.S)
    if NOT_RE2.search(plain):
        return False
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(java_regex(pattern, "(?iu)"))
        return True
    except (Py4JError, PySparkException, KeyError):  # KeyError: no such class name
        return False


POSIX = re.compile(r"\[:(\^?)(\w+):\]")
#: fixed values: names of ASCII classes in RE2 and in Java
POSIX_CLASSES = {
    "alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit", "graph": "Graph",
    "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper", "word": "", "xdigit": "XDigit",
}
GROUP_NAME = re.compile(r"\(\?P?<[A-Za-z_]\w*>")


def java_regex(pattern: str, flags: str = "", word_edges: bool = False) -> str:
    """Spell an RE2 pattern for java.util.regex with the same meaning.

    RE2: \\b is ASCII, \\s has no vertical tab, (?m) anchors break on \\n only, scripts are \\p{Han}; in a class, [:digit:]
    is a class, and [ and && stand for themselves, as ] does in first place; (?P<n>..) is a group (its name is not needed).
    `word_edges`: every \\b is known to sit at the outer edge of a word (first one in front, later ones
    behind), so a one-sided look-around does.
    """
    word, space = "A-Za-z0-9_", r"\t\n\f\r "
    out, in_class, edges, i, begun = [], False, 0, 0, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        step = 2
        if two == r"\b" and not in_class:
            if not word_edges:
                out.append(f"(?:(?<=[{word}])(?![{word}])|(?<![{word}])(?=[{word}]))")
            else:
                out.append(f"(?![{word}])" if edges else f"(?<![{word}])")
            edges += 1
        elif two == r"\s":
            out.append(space if in_class else f"[{space}]")
        elif two == r"\S":
            out.append(r"\S\x0B" if in_class else f"[^{space}]")
        elif m := re.match(r"\\p\{(Han|Hiragana|Katakana|Hangul)\}", pattern[i:]):
            out.append(rf"\p{{Is{m.group(1)}}}")
            step = m.end()
        elif two == r"\Q":
            end = pattern.find(r"\E", i)
            step = (len(pattern) if end < 0 else end + 2) - i
            out.append(pattern[i : i + step])
        elif two[:1] == "\\":
            out.append(two)
        elif in_class and (m := POSIX.match(pattern, i)):
            out.append(("\\P" if m[1] else "\\p") + f"{{{POSIX_CLASSES[m[2]]}}}" if m[2] != "word" else ("\\W" if m[1] else "\\w"))
            step = len(m[0])
        elif in_class and (pattern[i] == "[" or two == "&&" or (pattern[i] == "]" and i == begun)):
            out.append("\\" + pattern[i])
            step = 1
        elif not in_class and (m := GROUP_NAME.match(pattern, i)):
            out.append("(")
            step = len(m[0])
        elif not in_class and pattern[i] == "[":
            in_class, step = True, 2 if two == "[^" else 1
            begun = i + step
            out.append(pattern[i : begun])
        elif pattern.startswith("(?m)", i):
            out.append("(?md)")
            step = 4
        else:
            in_class = {"[": True, "]": False}.get(pattern[i], in_class)
            out.append(pattern[i])
            step = 1
        i += step
    return flags + "".join(out)


def pattern_java(rule: PatternRule) -> str:
    java = java_regex(rule.pattern, word_edges=True)
    if rule.run_class is None:
        return java
    cls = java_regex(rule.run_class)
    return rf"(?:\G|(?<!{cls})){java}"


def glob_regex(glob: str) -> str | None:
    """Java regex for a shell glob whose * and ? stay inside one path segment; None if plain or malformed."""
    if not re.search(r"[*?\[\\]", glob):
        return None
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[":
            m = re.match(r"\[(\^?)((?:\\.|[^\]\\])+)\]", glob[i:])
            if not m:
                return None
            body = m.group(2).replace("[", r"\[").replace("&&", r"&\&")
            out.append(f"[{m.group(1)}{body}]")
            i += m.end() - 1
        elif c == "\\":
            if i + 1 == len(glob):
                return None
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + r"\z"
