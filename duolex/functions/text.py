"""Token patterns and character classes as Spark (Java) and DuckDB (RE2) regular expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"[\s\x1c-\x1f]"
_ARROW = r"\p{Nd}++" + _SPACE + r"*(?:→|->)" + _SPACE + r"*\p{Nd}+"
#: What is kept whole as a protected span.
PROTECTED = _ARROW + r"|\[\[[^\[\]\r\n]+\]\]|\{\{[^{}\r\n]+\}\}|\$\{[^{}\r\n]+\}|</?[A-Za-z][^>\r\n]*>"
_START = r"[\p{L}\p{N}\p{Pc}]"
_GOES_ON = r"[\p{L}\p{N}\p{Pc}\p{M}]"
#: A protected span, or a word that stops where one begins, or any other visible character. Inside a word only an arrow between numbers can
#: begin, and only at the first digit of a run. Possessive, so that the engine keeps no state for each character of a word.
TOKEN = rf"(?U)(?:{PROTECTED})|{_START}(?:(?!(?<!\p{{Nd}}){_ARROW}){_GOES_ON}|['’\-](?!{_ARROW})(?={_START}))*+|[^\s\x1c-\x1f]"
#: The same with the white space before it.
PIECE = rf"(?U){_SPACE}*+(?:{TOKEN.removeprefix('(?U)')})"
#: RE2 has no look-ahead. The same tokens where no protected span touches a word.
TOKEN_RE2 = rf"\p{{Nd}}+\s*(?:→|->)\s*\p{{Nd}}+|\[\[[^\[\]\r\n]+\]\]|\{{\{{[^{{}}\r\n]+\}}\}}|\$\{{[^{{}}\r\n]+\}}|</?[A-Za-z][^>\r\n]*>|{_START}{_GOES_ON}*(?:['’\-]{_START}{_GOES_ON}*)*|[^\s]"
PROTECTED_RE2 = r"^(?:\p{Nd}+\s*(?:→|->)\s*\p{Nd}+|\[\[[^\[\]\r\n]+\]\]|\{\{[^{}\r\n]+\}\}|\$\{[^{}\r\n]+\}|</?[A-Za-z][^>\r\n]*>)$"
#: Languages whose text goes to a segmenter.
SEGMENTED = ("zh", "yue", "wuu")


def visible(text: Column) -> Column:
    """Has a character that isn't white space."""
    return text.rlike(r"(?U)[^\s\x1c-\x1f]")


def is_protected(token: Column) -> Column:
    return token.rlike(rf"(?U)\A(?:{PROTECTED})\z")


def is_content(token: Column, protected: Column) -> Column:
    return ~protected & token.rlike(r"[\p{L}\p{N}]")


def is_punctuation(token: Column) -> Column:
    return token.rlike(r"\A\p{P}+\z")


def language_code(code: Column) -> Column:
    """The code is well formed."""
    code = F.trim(code)
    return F.length(code).between(2, 35) & code.rlike(r"\A[A-Za-z]{2,8}(?:-[A-Za-z0-9]{1,8})*\z")


def segmented(code: Column) -> Column:
    return F.lower(F.split_part(F.trim(code), F.lit("-"), F.lit(1))).isin(*SEGMENTED)
