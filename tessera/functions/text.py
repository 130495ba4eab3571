"""Scalar text functions as Column -> Column expressions (JVM side, codegen).

Two normalizers exist on purpose:

* ``normalize`` — retrieval form: entity-decoded, lower case, ASCII
  ``[a-z0-9]`` runs joined by one space.
* ``normalize_text`` — ranking form: lower case, keeps Unicode letters,
  digits, ``_``, ``'`` and ``-``; no entity decoding.

Python's ``\\s`` / ``str.strip`` are Unicode-aware and include the
separators U+001C..U+001F that Java's ``(?U)\\s`` lacks, so the whitespace
class is spelled out once here and reused by every pattern (the same class
is valid in RE2, so the SQL oracle uses it verbatim).
"""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L

# Whitespace as Python's str.isspace() sees it.
WS = (r"\t\n\x0b\x0c\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
      r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
WORD = r"\p{L}\p{N}_"          # Python's \w on str patterns
NONWORD_OR_EDGE_L = rf"(?:^|[^{WORD}])"
NONWORD_OR_EDGE_R = rf"(?:[^{WORD}]|$)"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(c) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends.

    The regex only runs when the first or last character is whitespace;
    otherwise the value is returned as is (no per-character scan)."""
    x = _c(c)
    edge = F.substring(x, 1, 1).rlike(f"[{WS}]") | F.substring(x, -1, 1).rlike(f"[{WS}]")
    return F.when(edge, F.regexp_replace(F.regexp_replace(x, rf"^[{WS}]+", ""), rf"[{WS}]+$", "")) \
            .otherwise(x)


# FIXED VALUES — characters that HTML gives to the numeric references 128 to
# 159 (null: not assigned, the reference stands for the code point itself).
LATIN_EXTRA = ["€", None, "‚", "ƒ", "„", "…", "†", "‡", "ˆ", "‰", "Š", "‹", "Œ", None, "Ž", None,
               None, "‘", "’", "“", "”", "•", "–", "—", "˜", "™", "š", "›", "œ", None, "ž", "Ÿ"]


#: Every HTML5 name, with and without the semicolon, as the standard library lists them.
_NAMES = json.dumps(html.entities.html5)
#: Names that stand without a semicolon, the longest first.
_BARE = "^(?:" + "|".join(sorted((n for n in html.entities.html5 if not n.endswith(";")), key=lambda n: (-len(n), n))) + ")"


def _numeric(piece: Column) -> Column:
    """``#`` and digits after an ampersand as their character, then the rest."""
    ref = F.regexp_extract(piece, r"^#(?:[xX][0-9a-fA-F]+|[0-9]+);?", 0)
    hexa = ref.rlike("^#[xX]")
    bare = F.regexp_replace(ref, r"^#[xX]?0*|;", "")
    n = F.when(F.length(bare) > 7, F.lit(0x110000)).when(hexa, F.conv(bare, 16, 10)).otherwise(F.conv(bare, 10, 10)).cast("long")
    n = F.coalesce(n, F.lit(0))
    plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    # code points that no text may hold leave nothing
    none = (n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE))
    char = (F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd")
            .when(n.between(128, 159), F.coalesce(F.get(F.array(*[F.lit(x) for x in LATIN_EXTRA]), (n - 128).cast("int")), plain))
            .when(none, "").otherwise(plain))
    return F.when(ref == "", F.concat(F.lit("&"), piece)).otherwise(F.concat(char, F.substr(piece, F.length(ref) + 1)))


def _named(piece: Column) -> Column:
    """A name after an ampersand as its text, then the rest: the whole name up
    to its semicolon, or else the longest one that may stand without."""
    names = F.from_json(F.lit(_NAMES), "map<string,string>")
    whole = F.regexp_extract(piece, r"^[^\t\n\f <&#;]{1,32};?", 0)
    part = F.regexp_extract(piece, _BARE, 0)
    rest = lambda n: F.substr(piece, F.length(n) + 1)
    found = F.element_at(names, whole)
    return F.when(found.isNotNull(), F.concat(found, rest(whole))) \
            .when(part != "", F.concat(F.element_at(names, part), rest(part))).otherwise(F.concat(F.lit("&"), piece))


def unescape(c) -> Column:
    """HTML entity decoding, native and in a single pass: every numeric
    reference and every HTML5 name.  A text is cut at its ampersands and each
    piece is decoded on its own; a text without one is left as it is."""
    x = _c(c)
    pieces = F.split(x, "&")
    tail = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))),
                       lambda p: F.when(p.startswith("#"), _numeric(p)).otherwise(_named(p)))
    return F.when(x.contains("&"), F.concat(F.get(pieces, F.lit(0)), F.array_join(tail, ""))).otherwise(x)


def clean_text(c) -> Column:
    """Falsy -> ''; decode entities; drop tags; collapse whitespace; strip."""
    x = unescape(F.coalesce(_c(c), F.lit("")))
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    x = F.regexp_replace(x, rf"[{WS}]+", " ")
    return F.trim(x)


def normalize(c) -> Column:
    """Retrieval normalizer: decode, lower, [^a-z0-9]+ -> ' ', strip."""
    x = F.lower(unescape(F.coalesce(_c(c), F.lit(""))))
    return F.trim(F.regexp_replace(x, r"[^a-z0-9]+", " "))


def tokenize(c) -> Column:
    """Tokens of ``normalize``; empty text gives an empty array."""
    n = normalize(c)
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.split(n, " "))


def normalize_text(c) -> Column:
    """Ranking normalizer: lower; [^\\w\\s'-] -> ' '; \\s+ -> ' '; strip."""
    x = F.lower(F.coalesce(_c(c), F.lit("")))
    x = F.regexp_replace(x, rf"[^{WORD}{WS}'-]", " ")
    x = F.regexp_replace(x, rf"[{WS}]+", " ")
    return F.trim(x)


def split_words(n: Column) -> Column:
    """Split an already-normalized string on single spaces; '' -> []."""
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.split(n, " "))


def tokens(c) -> Column:
    return split_words(normalize_text(c))


def article_text(title, summary) -> Column:
    """Stripped non-blank title and summary joined by one space."""
    t = F.nullif(strip(title), F.lit(""))
    s = F.nullif(strip(summary), F.lit(""))
    return F.concat_ws(" ", t, s)


def article_key(url, title) -> Column:
    """lower(strip(url)) when url is non-empty, else the normalized title."""
    u = _c(url)
    return F.when(u.isNotNull() & (u != ""), F.lower(strip(u))).otherwise(normalize(title))


def title_key(title) -> Column:
    return normalize(title)


def _lit_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def query_terms(query, stopwords=None) -> Column:
    """Query tokens minus stopwords; order and duplicates kept."""
    stop = _lit_array(stopwords if stopwords is not None else L.STOPWORDS)
    return F.filter(tokenize(query), lambda t: ~F.array_contains(stop, t))


def alias_map(aliases=None) -> Column:
    aliases = aliases if aliases is not None else L.QUERY_ALIASES
    return F.create_map(*[x for k, v in aliases.items() for x in (F.lit(k), _lit_array(v))])


def query_aliases(query, aliases=None) -> Column:
    n = normalize(query)
    return F.coalesce(F.element_at(alias_map(aliases), n), F.array(n))


def contains_alias(norm_text: Column, aliases: Column) -> Column:
    """Any alias is a substring of the normalized text."""
    return F.exists(aliases, lambda a: F.contains(norm_text, a))


def source_or_default(source_title, default: str = L.DEFAULT_SOURCE) -> Column:
    return strip(F.coalesce(F.nullif(_c(source_title), F.lit("")), F.lit(default)))


def is_blank(c) -> Column:
    return F.coalesce(strip(c), F.lit("")) == ""


def alternation(patterns) -> str:
    return "(?:" + "|".join(patterns) + ")"
