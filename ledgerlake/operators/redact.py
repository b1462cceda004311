"""Credential redaction as chained expressions; idempotent, since no rule matches its own replacement."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (
    (r'(token|secret|password)( = )"[^"<]+"', "$1$2<redacted:key>", ' = "'),
    (r"[A-Za-z0-9._]+@[A-Za-z0-9.]+[A-Za-z0-9]", "<redacted:mail>", "@"),
    (r"\b[0-9]{12,19}\b", "<redacted:number>"),
)


def redact(text: Column, rules: tuple = RULES) -> Column:
    """text by rules of a pattern, its replacement and, where there is one, a text without which the pattern cannot match."""
    for pattern, replacement, *needed in rules:
        done = F.regexp_replace(text, pattern, replacement)
        text = F.when(F.contains(text, F.lit(needed[0])), done).otherwise(text) if needed else done
    return text


def redact_columns(rows: DataFrame, columns: list[str], rules: tuple = RULES) -> DataFrame:
    """rows with the given text columns redacted; rows, their order and all other columns stay."""
    return rows.withColumns({c: redact(F.col(c), rules) for c in columns})


def redact_tail(value: Column, policy: list[str]) -> Column:
    """A trailing value stays if it is a number, a policy word or redacted already."""
    return F.when(value.rlike("^[0-9]+$") | value.isin(policy) | value.startswith("<redacted"), value).otherwise("<redacted:tail>")


# Communities that stay, since that a device still has one of them is what an audit looks for.
DEFAULT_COMMUNITIES = ("public", "private", "cisco", "juniper", "snmp", "community", "admin", "default", "monitor", "manager", "read", "write", "ro", "rw")

#: Commands up to their credential, which is the next word. Words stand for themselves, a|b for either, * for any word, # for a number, [..] for
#: words that may be missing, ~ for whatever comes before the first place where the rest fits, and ~~ before the last.
FORMS = (
    "snmp-server user ~ auth *",
    "snmp-server user ~~ priv * [#]",
    "enable secret|password [level #] [#]",
    "username * [privilege #] [view *] secret|password [#]",
    "tacacs-server|radius-server ~~ key [#]",
    "key-string [#]",
    "[ip] ospf|eigrp|rip authentication key|key-string [#]",
    "[ip] ospf message-digest-key # * [#]",
    "crypto * key|pre-shared-key [#]",
    "ntp authentication-key # * [#]",
    "set * ENC",
)
COMMUNITY_FORMS = ("snmp-server community", "snmp-server host * [vrf *] [inform|informs|trap|traps] [version 1|2c]")
#: Names whose value is a credential where it ends the line.
SECRET_NAMES = ("authentication-key", "authpwd", "privpwd", "secret", "bind-password", "pre-shared-key", "psksecret", "passphrase")

_BLANK, _LEFT = r"[ \t]+", "<redacted:secret>"
#: Not what a rule has already replaced.
_NEW = r"(?!<redacted)"


def form(words: str) -> str:
    """The expression of a form, from the start of a line to its credential."""
    one = {"*": r"\S+", "#": r"\d+"}
    out = ""
    for part in re.findall(r"\[[^\]]*\]|\S+", words):
        if part in ("~", "~~"):
            out += r"(?:\S.*?[ \t])??" if part == "~" else r"(?:.*[ \t])?"
            continue
        inside = "".join((one.get(w) or f"(?:{'|'.join(map(re.escape, w.split('|')))})") + _BLANK for w in part.strip("[]").split())
        out += f"(?:{inside})?+" if part[0] == "[" else inside
    return f"^([ \t]*{out})"


def _credential_rules() -> tuple:
    flags = "(?im)"
    kept = "|".join(DEFAULT_COMMUNITIES)
    named = "(?!(?:version|vrf|informs?|traps?)(?!\\S))"
    rules = [(f"{flags}{form(f)}{named}(?!(?:{kept})(?!\\S)){_NEW}(?!\\d+[ \\t])\\S+", f"$1{_LEFT}") for f in COMMUNITY_FORMS]
    rules += [(f"{flags}{form(f)}{_NEW}\\S+", f"$1{_LEFT}") for f in FORMS]
    rules += [
        # a password of its own in an indented line, with or without a type
        (rf"{flags}^([ \t]+password{_BLANK}(?:\d+{_BLANK})?+)(?!encryption(?!\S)){_NEW}\S+", f"$1{_LEFT}"),
        # after a type digit anywhere in a line
        (rf"{flags}(?<![^ \t\r\n])((?:key|password){_BLANK}\d+{_BLANK}){_NEW}\S+", f"$1{_LEFT}"),
        # a hash keeps its marker, which tells how it was made
        (rf"{flags}(\$[0-9a-z]{{1,6}}\$){_NEW}[^\"'\s;,<]+", f"$1{_LEFT}"),
        # a value that ends its line: a number alone names a key, anything else is one
        (rf"{flags}(?<![^ \t\r\n])((?:key|password){_BLANK})(?!\d+[ \t]*$)(?!\S*<redacted)\S+([ \t]*)$", f"$1{_LEFT}$2"),
        (rf"{flags}(?<![^ \t\r\n])((?:{'|'.join(SECRET_NAMES)}){_BLANK})(?!\S*<redacted)\S+([ \t]*)$", f"$1{_LEFT}$2"),
    ]
    return tuple(rules)


#: Rules for credentials in configuration text; they leave the command, the type of the credential and what follows it.
CREDENTIALS = _credential_rules()
