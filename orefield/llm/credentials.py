"""Credentials embedded in source code: finding their places and redacting only their values.

Each source is read once, from left to right, by a lexer: comments, literals (with the escapes of the
language family: doubled quotes in COBOL, JCL and SQL, backslashes elsewhere), URLs, key headers, names
and separators.  A literal is a finding when it belongs to a name that says credential: assigned or
compared to it (``=``, ``:=``, ``:``, ``IS``, ``EQUAL TO``, ``VALUE`` of a data item), moved to it,
standing behind it, or passed to it (``PASSWORD('...')``, ``login(user, '...')``, ``CALL ... USING``),
adjacent literals being one value; and when it is no placeholder.  Bare words count behind ``=`` and
``:`` and in the cards that have a place for a password.  The inside of any other literal, and of a
comment, is read by the same lexer, so a connection string in a literal gives its password alone.
Further: passwords in URLs, authorization headers, log-on and transfer cards, comments that tell a
password, and private keys from their BEGIN line on.

Redaction puts a mask of the same length over the characters of the value alone: ``X``, or ``0`` in
numbers; quotes, escapes, separators, comment marks, indentation and line ends stay, a key is masked
line by line, so columns and line numbers stay and what parsed before parses after.

Before a text is read, one linear-time pattern per Arrow batch asks whether any rule could fire in it;
it is derived from the names and marks of the rules and wider than they are.  Work is per row: no
shuffle and no state, so skew cannot arise.

Defined cases: null and empty sources have no finding; columns other than those named are kept or
ignored; repeated rows are each treated; texts are scanned whole, whatever their length.  Refused as
values, even after a credential name: fewer than four characters or three different ones, paths in
lower case, URLs, references (``vault``, ``arn:`` and the like), masks, variables and the words of
PLACEHOLDERS; digits alone unless there are six and the name says password; blanks unless the literal
is quoted and reads as a pass phrase; bare words unless they hold a digit or look chosen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of a name that say credential, and parts that follow them where the value is about one.
STRONG = {"password", "passwd", "pswd", "pwd", "pw", "passphrase", "secret", "credential", "credentials", "newpassword", "oldpassword", "passcode"}
TOKENS = {"token", "tkn", "auth", "apikey", "authorization", "pat", "jwt", "bearer"}
KEYS_AFTER = {"api", "access", "http", "secret", "private", "client", "auth", "encryption", "signing", "account", "storage", "service", "shared", "app"}
ABOUT = {
    "hash", "min", "max", "length", "len", "rules", "policy", "expiry", "expires", "age", "date", "count", "url", "uri", "path", "file", "dir", "hint", "reset", "link", "santa", "manager",
    "id", "authid", "name", "type", "size", "days", "retries", "history", "required", "enabled", "ttl", "endpoint", "header", "prompt", "ref", "alias", "label", "strength", "message",
}
#: Among them those after which not even a value that looks made by a machine is one.
NEVER = {"hash", "url", "uri", "path", "file", "dir", "link", "santa", "endpoint", "id", "authid"}
#: Functions to which a credential is passed, and parts of a name of a phrase.
CALLS = {"login", "logon", "signon", "authenticate", "connect", "getconnection", "createconnection", "basicauth"}
#: Values that stand for a credential without being one.
PLACEHOLDERS = {
    "changeme", "change_me", "change-me", "password", "passwd", "secret", "token", "dummy", "example", "sample", "test", "none", "null", "nil", "true", "false", "yes", "no",
    "spaces", "space", "low-values", "high-values", "zero", "zeros", "zeroes", "quotes", "todo", "tbd", "xxx", "n/a", "na", "default", "empty", "redacted", "masked", "hidden",
    "prompt", "user", "userid", "pass", "pw", "pwd", "undefined", "your_password", "yourpassword", "placeholder", "required", "mypassword", "unknown",
}
_SAYING = re.compile(r"(?i)\b(?:your|change|enter|insert|replace|example|here|invalid|must|please|the|ask|is|not|for|of|wrong|missing|expired|required|password|secret)\b")


def _trigger() -> str:
    """What a source must hold for any rule of ``scan`` to fire, derived from the sets the rules use; wider than the rules, never narrower."""
    parts = {*STRONG, *TOKENS, "pass"}
    parts = [p for p in sorted(parts) if not any(q != p and q in p for q in parts)]
    keys = [k for k in sorted(KEYS_AFTER) if not any(p in k for p in parts)]
    rules = [
        rf"(?:{'|'.join(keys)})[_.\-]*key", "-key", r"x-[a-z\-]*key", r"basic[ \t]", "private key", "://", r"log(?:ged)?[ \t]*on", "identified", *sorted(CALLS),
        r"using[^a-z0-9'\"]+(?:by[^a-z0-9]+(?:content|reference|value)[^a-z0-9'\"]+)?['\"]", r"dd[ \t]+(?:\*|data)",
    ]
    return "(?i)" + "|".join([*parts, *rules])


#: Sources without any of these hold nothing to find.
TRIGGER = _trigger()

_SPLIT = re.compile(r"[^A-Za-z0-9]+|(?<=[a-z0-9])(?=[A-Z])")


@lru_cache(maxsize=1 << 16)
def credential_name(name: str) -> str:
    """What an identifier says: '' no credential, 'token', 'password', or 'about' where it names something about one."""
    parts = [p.lower() for p in _SPLIT.split(name) if p]
    said = ""
    for i, p in enumerate(parts):
        strong = p in STRONG or (p == "pass" and (len(parts) > 1 or name.isupper() or name.islower()))
        if strong or p in TOKENS or (p == "key" and i > 0 and parts[i - 1] in KEYS_AFTER):
            rest = set(parts[i + 1 :])
            if not rest & ABOUT:
                return "password" if strong else "token"
            if not rest & NEVER:
                said = "about"
    return said


def says_credential(name: str) -> bool:
    """Does an identifier name a credential (and not something about one)?"""
    return credential_name(name) in ("password", "token")


def is_value(value: str, bare: bool = False, name: str = "password") -> bool:
    """Could this text be a usable credential: no mask, placeholder, variable, symbol or reference?"""
    v = value.strip()
    low = v.lower()
    if len(v) < 4 or low in PLACEHOLDERS or len(set(v)) < 3:
        return False
    if v[0] in "&:$%<{[(?*@" and not re.search(r"[A-Za-z0-9].*[0-9].*[A-Za-z]|[a-z].*[A-Z]", v[1:]):
        return False
    if re.match(r"\$[({]|&[A-Z#@$]|:[A-Za-z]|%[A-Za-z_]+%$|<[^>]*>$|\{\{|\[|ENC\(|@\w+@$|[a-z][a-z0-9+.\-]*://", v):
        return False
    if low.startswith(("vault", "secretsmanager", "keyring", "ssm:", "file:", "env:", "ref:", "arn:")) or "redacted" in low or "****" in v or "xxxx" in low:
        return False
    if re.fullmatch(r"(?:/[a-z0-9_.\-]+)+/?", v):  # a path
        return False
    if re.search(r"\s", v):
        words = v.split()
        return not bare and name == "password" and not _SAYING.search(v) and (len(words) >= 4 or bool(re.search(r"\d", v))) and all(len(w) > 1 for w in words)
    if v.isdigit():
        return name == "password" and len(v) >= 6
    if name == "about":
        return looks_made(v)
    return not bare or looks_chosen(v) or bool(re.search(r"\d", v))


def is_token(v: str) -> bool:
    """A machine-made token: long, of mixed characters."""
    return len(v) >= 16 and bool(re.search(r"\d", v)) and not re.search(r"\s", v)


def looks_chosen(v: str) -> bool:
    """Characters as in passwords and tokens: letters with digits or marks, of some length."""
    if len(v) >= 8 and re.search(r"[a-z]", v) and re.search(r"[A-Z]", v) and re.search(r"[A-Za-z][@#$!%][A-Za-z]", v):
        return True
    return len(v) >= 6 and bool(re.search(r"\d", v)) and bool(re.search(r"[A-Za-z]", v)) and not re.fullmatch(r"\d+[A-Za-z]{1,2}|[A-Za-z]+\d{1,2}[.,;]?|[0-9a-f]{40}|[0-9a-f]{64}", v)


def looks_made(v: str) -> bool:
    """Characters that nobody writes for a length, a date or a name: letters between digits, or three kinds of characters."""
    if len(v) < 8 or re.fullmatch(r"[0-9a-f]{32,}|[\d.:/\-]+", v):
        return False
    kinds = sum(bool(re.search(p, v)) for p in (r"[a-z]", r"[A-Z]", r"\d", r"[^A-Za-z0-9]"))
    return bool(re.search(r"\d", v)) and (kinds >= 3 or bool(re.search(r"[A-Za-z]\d+[A-Za-z]", v)))


# ---------------------------------------------------------------- the lexer

_KEY = r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----"
_KEY_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
_KEY_LINE = re.compile(r"((?:\d{6}(?=[ */]))?[ \t]*(?://\*|\*|--|#|;)?[ \t]*['\"+]*)([A-Za-z0-9+/=]{20,}|[A-Za-z0-9+/]*={1,2}|[A-Za-z0-9+/]+(?=[ \t'\"+,;]*\r?$))[ \t'\"+,;]*\r?$")
_KEY_RUN = re.compile(r"(?<![\\A-Za-z0-9+/=])(?:(?<=\\)[nr])?[A-Za-z0-9+/=]{2,}|(?<=\\[nr])[A-Za-z0-9+/=]{2,}")
_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*"
_COMMENT = {
    "cobol": r"(?<![^\n])[^\n\t]{6}[*/]", "jcl": "", "sql": r"--(?!---)|/\*", "other": r"(?<![^\s])(?:\#|//|--(?!---)|;)(?=[ \t]|[A-Za-z!])",
}
_COMMENT = {family: rf"(?<![^\n])[ \t]*(?:\*|//\*|--(?!---)|\#)" + (f"|{more}" if more else "") for family, more in _COMMENT.items()}  # the former also in embedded text
_DOUBLED = r"'(?:[^'\n]|'')*+'|\"(?:[^\"\n]|\"\")*+\""
_ESCAPED = r"'(?:[^'\\\n]|\\[^\n]|'')*+'|\"(?:[^\"\\\n]|\\[^\n])*+\""


def _lexer(family: str) -> re.Pattern:
    quoted = _ESCAPED if family == "other" else _DOUBLED
    return re.compile(
        rf"(?P<key>{_KEY})|(?P<comment>{_COMMENT[family]})|(?P<url>[A-Za-z][A-Za-z0-9+.\-]*://[^\s'\"<>]+)|(?P<literal>{quoted})|(?P<name>{_NAME})|(?P<number>\d[A-Za-z0-9_\-]*)"
        r"|(?P<op>:=|=>|==|!=|<>|\|\||[=:(),<>+&])|(?P<line>\n)|(?P<end>[;.](?=\s|$)|[{}\[\]])"
    )


_LEXERS = {family: _lexer(family) for family in _COMMENT}
_BARE = re.compile(r"[ \t]*(?::=|=>|==|=|:)[ \t]*([^\s'\",;()|<>{}][^\s'\",;()|<>]*)")
_BARE_IN = re.compile(r"[ \t]*(?::=|=>|==|=|:)[ \t]*(?:''|\\\"|\\')([^'\"\\]+)(?:''|\\\"|\\')")
_CARD = re.compile(r"[ \t]+([^\s'\"=:]+)[ \t]*\r?(?=\n|$)")
_LOGON = re.compile(r"[ \t]*(?:APPLID\([^)\n]*\)[ \t]*)?[A-Za-z0-9@#$]+/([^\s/,]+)", re.I)
_WORD = re.compile(r"[ \t]+([^\s'\"]+)")
_HEADER = re.compile(r"[ \t]*:[ \t]*(?!(?:bearer|basic|token)\b)([^\s'\"]+)", re.I)
_HEADER_NAME = re.compile(r"x-[a-z\-]*(?:key|token|auth[a-z]*)|authorization|api-key", re.I)
_TAG = re.compile(r"(?:\s[^>\n]*)?>([^<\n]+)</")
_USER_PART = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://[^\s/:@'\"]*:([^\s/'\"]+)@(?=[A-Za-z0-9\[])")
#: A comment that tells a password.
_TOLD = re.compile(
    r"(?i)[^\n]*?(?:\b(?:pass(?:word|wd)?|pwd|pw|secret|token|credential)\b[^\n]*?(?:\bis(?:[ \t]+still|[ \t]+now)?[ \t]+|[=:][ \t]*)|\blog(?:ged)?[ \t]*on[ \t]+with[ \t]+|\bold[ \t]+login[ \t]+was[ \t]+\S+[ \t]*/[ \t]*)"
    r"(?:\S+[ \t]*/[ \t]*)?(\S+)[ \t]*\r?(?=\n|$)"
)
#: In-stream cards of a file transfer: host, user and password in the first three lines.
_TRANSFER = re.compile(
    r"(?i)[ \t]+(?:\*|DATA)[^\n]*\n[ \t]*([A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)+)[ \t]*(?:[ \t]\d+[ \t]*)?\r?\n[ \t]*([A-Za-z0-9@#$_.\-]+)[ \t]*\r?\n[ \t]*(\S+)[ \t]*\r?\n[ \t]*(?:bin|binary|ascii|asc|ebcdic|get|put|mget|mput|cd|lcd|quit|quote|site|locsite)\b"
)
_LINKS = {"=", ":=", ":", "=>", "==", "!=", "<>", "("}
_LINK_WORDS = {"is", "equal", "equals", "to", "not", "eq", "ne"}
_JOINS = {"+", "&", "||"}
_VERBS = set("accept add compute continue delete display divide evaluate exec else go goback if initialize inspect into move multiply open perform read return rewrite set start stop string subtract unstring when write delimited".split())


def family_of(text: str, kind: str | None = None) -> str:
    """Which comments and escapes hold: told by the kind of the unit, else by the text."""
    if kind in ("paragraph", "copybook", "job_step", "sql_block"):
        return {"paragraph": "cobol", "copybook": "cobol", "job_step": "jcl", "sql_block": "sql"}[kind]
    if kind:
        return "other"
    if text.startswith("//") or "\n//" in text:
        return "jcl" if re.search(r"(?m)^//(?:\*|[A-Z@#$]\S*[ \t]+\S)", text) else "other"
    if re.search(r"(?im)^(?:\d{6}|[ \t]{6,}).*\b(?:MOVE|PERFORM|PIC|VALUE|IF|EXEC|DISPLAY|CALL|STRING|USING)\b|^.{6}\*", text):
        return "cobol"
    return "sql" if re.search(r"(?im)^\s*(?:CREATE|SELECT|INSERT|UPDATE|DELETE|SET|CALL|ALTER|GRANT|CONNECT|OPTIONS)\b", text) else "other"


class _Reader:
    """One pass over a text; what it finds is (start, end, kind, ranges to mask)."""

    def __init__(self, text: str, family: str):
        self.text, self.family, self.lexer, self.found = text, family, _LEXERS[family], []
        self.open: dict[int, tuple] = {}  # content of a literal: ranges of the value so far, its finding, kind and what its name says

    def add(self, kind: str, start: int, end: int, bare: bool = False, name: str = "password") -> bool:
        good = is_value(self.text[start:end], bare, name)
        if good:
            self.found.append((start, end, kind, ((start, end),)))
        return good

    def read(self, start: int, end: int, inside: bool) -> None:
        """Tokens from ``start`` to ``end``; ``inside`` a literal only bare assignments, headers and URLs count."""
        text, back, at, entry, comment = self.text, [], start, None, -1  # back: tokens before, (what, word, start, end)
        while m := self.lexer.search(text, at, end):
            what, word, at = m.lastgroup, m[0], m.end()
            if what == "line":
                if back and back[-1][0] != "line":
                    back.append((what, word, m.start(), at))
                continue
            if what == "comment":
                told = _TOLD.match(text, at, end)
                if told and looks_chosen(told[1]):
                    self.add("PASSWORD", told.start(1), told.end(1), True)
                comment = at
            elif what == "key":
                at = self.key(m.start(), at, end)
            elif what == "url":
                user = _USER_PART.match(text, m.start(), end)
                if user:
                    self.add("URL_PASSWORD", user.start(1), user.end(1))
            elif what == "literal":
                if not self.literal(m.start(), at, back, entry) and len(word) > 6 and re.search(r"[=:<]|-----|(?i:bearer|basic|token)[ \t]", word):
                    self.read(m.start() + 1, at - 1, True)
                    if self.found and self.found[-1][1] == at - 1:  # the next literal may go on with the value
                        self.open[m.start() + 1] = (self.found[-1][3], len(self.found) - 1, self.found[-1][2], "password")
            elif what == "name":
                if back and back[-1][0] == "number" and len(back[-1][1]) <= 2 and (len(back) < 2 or back[-2][0] in ("line", "end")):
                    entry = word
                at = self.name(word, m.start(), at, end, back, inside)
            back.append((what, word, m.start(), m.end()))
            if at > m.end():  # a bare value was read behind the name
                back.append(("value", "", m.end(), at))
            if len(back) > 48:
                del back[:16]

    # -- names and what stands behind them

    def name(self, word: str, start: int, at: int, end: int, back: list, inside: bool) -> int:
        text, low = self.text, word.lower()
        first = not back or back[-1][0] in ("line", "comment") or (len(back) == 1 and back[0][0] == "line")
        says = credential_name(word)
        if says:
            m = _BARE.match(text, at, end)
            if m and not (m.end() < end and text[m.end()] == "(" and m[1].isidentifier()):  # a call that gives the value is none
                if self.add("PASSWORD", m.start(1), m.end(1), True, says):
                    return m.end(1)
            if inside and (m := _BARE_IN.match(text, at, end)) and self.add("PASSWORD", m.start(1), m.end(1), False, says):
                return m.end(1)
        if low in ("pass", "password", "passwd", "pwd"):
            if first and (m := _CARD.match(text, at, end)) and self.add("PASSWORD", m.start(1), m.end(1), True):
                return m.end(1)
            line = [t[1].lower() for t in back[-8:] if t[0] == "name"]
            if "login" in line and "machine" in line and (m := _WORD.match(text, at, end)) and self.add("PASSWORD", m.start(1), m.end(1), True):
                return m.end(1)
        elif low == "logon" and start - (text.rfind("\n", 0, start) + 1) <= 12:
            m = _LOGON.match(text, at, end)
            if m and self.add("PASSWORD", m.start(1), m.end(1), True):
                return m.end(1)
        elif low == "dd" and (m := _TRANSFER.match(text, at, end)):
            self.add("FTP_PASSWORD", m.start(3), m.end(3), True)
        elif low == "by" and back and back[-1][1].lower() == "identified":
            m = _WORD.match(text, at, end)
            if m and self.add("PASSWORD", m.start(1), len(text[: m.end(1)].rstrip(";")), True):
                return m.end(1)
        if low in ("bearer", "basic") or (low == "token" and inside and not back):
            m = _WORD.match(text, at, end)
            if m and self.add("TOKEN", m.start(1), m.end(1)):
                return m.end(1)
        elif _HEADER_NAME.fullmatch(word):
            m = _HEADER.match(text, at, end)
            if m and self.add("TOKEN", m.start(1), m.end(1)):
                return m.end(1)
        if says and back and back[-1][1] == "<":
            m = _TAG.match(text, at, end)
            if m and self.add("PASSWORD", m.start(1), m.end(1)):
                return m.end(1)
        return at

    # -- literals and the names they belong to

    def literal(self, start: int, end: int, back: list, entry: str | None) -> bool:
        before = self.open.get(self.joined(start, back))
        says = before[3] if before else self.owner(start, back, entry) or self.behind(end)
        if not says:
            return False
        if says == "chosen":
            return looks_chosen(self.text[start + 1 : end - 1]) and self.add("PASSWORD", start + 1, end - 1)
        if says == "key":
            return is_token(self.text[start + 1 : end - 1]) and self.add("PASSWORD", start + 1, end - 1)
        content = (start + 1, end - 1)
        before = self.open.get(self.joined(start, back))
        ranges, at = (*before[0], content) if before else (content,), before[1] if before else None
        value = "".join(self.text[a:b] for a, b in ranges)
        if at is None and is_value(value, False, says):
            at = len(self.found)
            self.found.append(())
        if at is not None:
            kind = before[2] if before else "PASSWORD"
            self.found[at] = (ranges[0][0], content[1], kind, ranges)
        self.open[content[0]] = (ranges, at, before[2] if before else "PASSWORD", says)
        return at is not None

    def joined(self, start: int, back: list) -> int | None:
        """Where the content of the literal begins that the one at ``start`` goes on: joined by an operator, or adjacent (in COBOL also on the next line)."""
        k, line, operator = len(back) - 1, False, False
        while k >= 0 and (back[k][0] == "line" or back[k][1] in _JOINS):
            line, operator = line or back[k][0] == "line", operator or back[k][0] == "op"
            k -= 1
        if k < 0 or back[k][0] != "literal" or (line and not operator and self.family != "cobol"):
            return None
        return back[k][2] + 1

    def owner(self, start: int, back: list, entry: str | None) -> str:
        """What the name says to which the literal at ``start`` belongs, by the tokens before it."""
        k = len(back) - 1
        link, lines = "", 0
        while k >= 0:
            what, word, _, _ = back[k]
            low = word.lower()
            if what == "line":
                lines += 1
                if lines > 2:
                    return ""
            elif what == "op" and word in _LINKS and not link:
                link = word
            elif what == "name" and low in _LINK_WORDS:
                link = link or low
            elif word == "]" and link:  # a quoted name in brackets
                pass
            else:
                break
            k -= 1
        if k < 0:
            return ""
        what, word, _, _ = back[k]
        low = word.lower().rstrip(".")
        if what == "literal":
            return credential_name(word[1:-1]) if link in (":", "=", "=>", "==") and re.fullmatch(_NAME, word[1:-1]) else self.passed(back)
        if what == "op" and word == ",":
            return self.passed(back)
        if what != "name":
            return ""
        if low == "value" and entry and not link:
            return credential_name(entry)
        if low == "using":
            before = [t[1].lower().lstrip(":") for t in back[max(0, k - 3) : k] if t[0] in ("name", "literal")]
            if len(before) >= 2 and before[-2] in ("user", "userid"):
                return "password"
        if low in ("content", "reference", "value", "using"):
            return self.passed(back)
        if low == "by" and k and back[k - 1][1].lower() == "identified":
            return "password"
        says = credential_name(word)
        near = not lines or self.family != "other"
        return says if says and (link or (near and self.text[start - 1] in " \t\n")) else ""

    def passed(self, back: list) -> str:
        """'chosen' for an argument, not the first, of CALL ... USING or of a function that logs on."""
        depth, arguments = 0, 0
        for k in range(len(back) - 1, -1, -1):
            what, word, _, _ = back[k]
            low = word.lower()
            if what == "op":
                depth += (word == ")") - (word == "(")
                arguments += word == "," and depth == 0
                if depth < 0:
                    name = back[k - 1][1].lower().split(".")[-1] if k and back[k - 1][0] == "name" else ""
                    if arguments and k + 1 < len(back) and back[k + 1][0] == "literal" and says_credential(back[k + 1][1][1:-1]):
                        return "password"
                    return "chosen" if arguments and name in CALLS else ""
            elif what == "literal":
                arguments += 1
            elif what == "end" or (what == "name" and low in _VERBS):
                return ""
            elif what == "name" and low == "using":
                called = [t for t in back[max(0, k - 4) : k] if t[0] in ("name", "literal")][-2:]
                return "chosen" if len(called) == 2 and called[0][1].lower() == "call" and called[1][0] == "literal" and arguments else ""
        return ""

    def behind(self, end: int) -> str:
        """What the name says to which the literal is moved or compared, by what follows it."""
        m = _MOVED.match(self.text, end)
        if not m:
            return ""
        if m[1].strip().lower() != "to":
            return credential_name(m[2])
        for name in re.findall(_NAME, m[2] + m[3]):
            if name.lower() in _VERBS:
                break
            if credential_name(name):
                return credential_name(name)
            if name.upper().rstrip(".").endswith("-KEY"):
                return "key"
            if name.endswith("."):
                break
        return ""

    def key(self, start: int, at: int, end: int) -> int:
        """A private key: its lines from the BEGIN line on; the end of the last."""
        text = self.text
        stop = _KEY_END.search(text, at, end)
        last = stop.start() if stop else end
        ranges = []
        if "\n" not in text[at:last]:  # on one line, with escapes or blanks for line ends
            ranges = [(m.start(), m.end()) for m in _KEY_RUN.finditer(text, at, last)]
        else:
            place = text.find("\n", at, end) + 1
            while 0 < place < last:
                close = text.find("\n", place, end)
                close = close if close >= 0 else end
                m = _KEY_LINE.match(text[place:close])
                if m:
                    ranges.append((place + m.start(2), place + m.end(2)))
                elif text[place:close].strip(" \t\r*/#-;") and not re.match(r"[ \t*/#;\-]*[A-Za-z\-]+:[ \t]", text[place:close]):
                    break
                place = close + 1
        if not ranges or not any(len(set(text[a:b])) > 2 for a, b in ranges):
            return at
        ended = stop is not None and not re.sub(r"[\s*/#;'\"+\\nr\-]", "", text[ranges[-1][1] : stop.start()])
        self.found.append((start, stop.end() if ended else ranges[-1][1], "PRIVATE_KEY", tuple(ranges)))
        return stop.end() if ended else ranges[-1][1]


_MOVED = re.compile(rf"(\s*(?:==|=)\s*|\s+to\s+)({_NAME})((?:[,\s]+{_NAME}){{0,2}})", re.I)


def _places(text: str, kind: str | None = None) -> list[tuple[str, int, int, tuple]]:
    reader = _Reader(text, family_of(text, kind))
    reader.read(0, len(text), False)
    out, last = [], -1
    for start, end, what, ranges in sorted(reader.found, key=lambda f: (f[0], -f[1])):
        if start >= last:
            out.append((what, start, end, ranges))
            last = end
    return out


def scan(text: str, kind: str | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every credential value, in order and without overlap; ``kind`` is that of the unit, if known."""
    return [(what, start, end) for what, start, end, _ in _places(text, kind)]


# ---------------------------------------------------------------- on DataFrames

_RANGES = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))
FINDINGS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("span_start", T.IntegerType()), T.StructField("span_end", T.IntegerType()), T.StructField("line_no", T.LongType()), T.StructField("ranges", _RANGES),
]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("span_start", pa.int32()), ("span_end", pa.int32()), ("line_no", pa.int64()), ("ranges", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))]))


def _findings(text: str, kind: str | None) -> list[dict]:
    return [{"kind": k, "span_start": s, "span_end": e, "line_no": text.count("\n", 0, s) + 1, "ranges": [{"a": a, "b": b} for a, b in r]} for k, s, e, r in _places(text, kind)]


@F.arrow_udf(FINDINGS)
def _findings_of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, kinds in batches:
        maybe = pc.fill_null(pc.match_substring_regex(texts, pattern=TRIGGER), False).to_pylist()
        yield pa.array([_findings(texts[i].as_py(), kinds[i].as_py()) if hit else [] for i, hit in enumerate(maybe)], _ARROW)


# So that the filter on findings is not pushed below the scan, which would scan every text twice.
_findings_of = _findings_of.asNondeterministic()


def with_findings(units: DataFrame, source: str = "source", kind: str | None = None, out: str = "credentials") -> DataFrame:
    """Rows that hold credentials, with their findings: kind, span (0-based characters, end excluded), line and the ranges to mask.

    ``kind`` names the column that tells the kind of a unit (and with it comments and escapes); without it the text tells.
    """
    of_kind = F.col(kind) if kind else F.lit(None).cast("string")
    return units.where(F.length(source) > 3).withColumn(out, _findings_of(F.col(source), of_kind)).where(F.size(out) > 0)


def found_lines(units: DataFrame) -> DataFrame:
    """(unit_id, line_no): one row per line of source where the value of a credential starts."""
    return (
        with_findings(units.select("unit_id", "kind", "source"), kind="kind")
        .select("unit_id", F.explode(F.array_distinct(F.transform("credentials", lambda c: c["line_no"]))).alias("line_no"))
    )


def redacted(source: Column, findings: Column) -> Column:
    """Source with only the values masked, character by character, so that lines and columns stay."""
    mask = lambda s: F.when(s.rlike("^[0-9]+$"), F.repeat(F.lit("0"), F.length(s))).otherwise(F.regexp_replace(s, r"(?<!\\)[^\\'\"\r\n]", "X"))
    step = lambda acc, r: F.struct(
        F.concat(acc["text"], F.substr(source, acc["at"] + 1, r["a"] - acc["at"]), mask(F.substr(source, r["a"] + 1, r["b"] - r["a"]))).alias("text"), r["b"].alias("at"),
    )
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))
    return F.aggregate(F.flatten(F.transform(findings, lambda f: f["ranges"])), start, step, lambda acc: F.concat(acc["text"], F.substr(source, acc["at"] + 1, F.length(source))))
