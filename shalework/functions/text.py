"""Column functions on text; each keeps NULL as NULL."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The characters that Unicode (and the information separators that text tools) treat as white space.
WHITE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

#: File name extensions of application files.
EXTENSIONS = ("fmp12", "fp7", "fp5", "fp3", "fmp")

#: A line ends at any of these; CRLF counts once.
BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def strip(c: Column) -> Column:
    """Without white space at either end, by the Unicode notion of white space (``trim`` knows blanks only)."""
    return F.btrim(c, F.lit(WHITE))


def blank(c: Column) -> Column:
    """True where the value is null, empty or white space only."""
    return c.isNull() | (F.length(strip(c)) == 0)


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def nfc(c: Column) -> Column:
    """The composed Unicode form. Only texts beyond ASCII pass through Python; the others reach it as NULL."""
    odd = c.rlike(r"[^\x00-\x7f]")
    return F.when(odd, _nfc(F.when(odd, c))).otherwise(c)


def file_key(c: Column) -> Column:
    """A file name for comparison: outer white space, letter case and one final ``.fmp12`` do not count."""
    return F.regexp_replace(F.lower(strip(c)), r"\.fmp12$", "")


def path_key(c: Column) -> Column:
    """A path in its one spelling: forward slashes, composed characters."""
    return nfc(F.translate(c, "\\", "/"))


def strip_extension(c: Column) -> Column:
    """Without a known extension in any letter case; a name that is nothing but an extension stays whole."""
    return F.regexp_replace(c, rf"(?i)(?<=[^.])\.({'|'.join(EXTENSIONS)})$", "")


def lines_of(c: Column) -> Column:
    """The lines of a text as an array; a final break leaves an empty last line."""
    return F.split(c, BREAK, -1)


def one_line(c: Column) -> Column:
    """Every line break as a pilcrow."""
    return F.regexp_replace(c, BREAK, "¶")


def normal(c: Column) -> Column:
    """For containment tests: straight quotes, no ellipsis, no white space."""
    straight = F.translate(c, "“”„‘’…", "\"\"\"''")
    return F.regexp_replace(straight, rf"[{WHITE}]+", "")


def quoted(c: Column) -> Column:
    """On one line, in quotes if it is empty or holds a blank."""
    x = one_line(c)
    return F.when((x == "") | F.contains(x, F.lit(" ")), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(x)


def bare(c: Column) -> Column:
    """Trimmed and without one pair of outer double quotes."""
    x = strip(c)
    outer = F.startswith(x, F.lit('"')) & F.endswith(x, F.lit('"')) & (F.length(x) > 1)
    return F.when(outer, F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x)


def short_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 8)


@F.pandas_udf(T.StringType())
def _wide_slug(s: pd.Series, limit: pd.Series, max_bytes: pd.Series) -> pd.Series:
    def one(x: object, n: int, size: int) -> object:
        if x is None:
            return None
        t = re.sub(r"[^\w.-]+", "_", unicodedata.normalize("NFC", x).strip()).strip("._")[:n]
        kept = t.encode()[:size].decode(errors="ignore")  # a cut character is dropped as a whole
        return kept.strip("._") or "unnamed"

    return pd.Series([one(*x) for x in zip(s, limit, max_bytes)], dtype=object)


def slug(c: Column, limit: int = 60, max_bytes: int = 200) -> Column:
    """A name safe for a path: composed, other characters than letters, digits, ``_.-`` as one underscore, no outer dots
    or underscores, at most ``limit`` characters and ``max_bytes`` bytes; ``unnamed`` if nothing is left.

    ASCII names, whose bytes are their characters, stay in the JVM."""
    odd = c.rlike(r"[^\x00-\x7f]")
    x = F.substring(F.btrim(F.regexp_replace(strip(c), r"[^\w.-]+", "_"), F.lit("._")), 1, min(limit, max_bytes))
    x = F.btrim(x, F.lit("._"))
    plain = F.when(c.isNull(), F.lit(None)).when(x == "", "unnamed").otherwise(x)
    return F.when(odd, _wide_slug(F.when(odd, c), F.lit(limit), F.lit(max_bytes))).otherwise(plain)


def css_props(c: Column) -> Column:
    """The lines of a style sheet that end in a semicolon, joined by blanks."""
    kept = F.filter(F.transform(lines_of(c), strip), lambda x: F.endswith(x, F.lit(";")))
    return F.array_join(kept, " ")


def path_list(c: Column) -> Column:
    """The entries of a path list: separated by line breaks, or by white space in front of a scheme."""
    parts = F.transform(F.split(c, r"[\r\n]+|\s+(?=[A-Za-z][A-Za-z0-9]*:)"), strip)
    return F.filter(parts, lambda x: x != "")


def path_target(c: Column) -> Column:
    """The file a path names: no scheme, no trailing slash, the last segment."""
    x = F.regexp_replace(strip(c), r"^[A-Za-z][A-Za-z0-9]*:", "")
    x = F.regexp_replace(x, r"[/\\]+$", "")
    return strip(F.regexp_extract(x, r"([^/\\]*)$", 1))


def char_of(c: Column) -> Column:
    """The character of a decimal code: ``''`` for 0, null and non-numbers; ``U+XXXX`` for what is no character.

    A code becomes the bytes of its UTF-32 form, which Spark decodes."""
    digits = F.when(strip(c).rlike("^[0-9]+$"), F.regexp_replace(strip(c), "^0+", ""))
    hexa = F.conv(digits, 10, 16)
    n = F.when(F.length(digits) <= 7, digits.try_cast("int"))
    char = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(hexa, 8, "0"))), "UTF-32")  # behind a byte order mark, so that a code may be one itself
    none = n.isNull() | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    return F.when(F.coalesce(digits, F.lit("")) == "", "").when(none, F.concat(F.lit("U+"), F.lpad(hexa, F.greatest(F.lit(4), F.length(hexa)), F.lit("0")))).otherwise(char)


char_code = char_of


def snake(c: Column) -> Column:
    """``CustomerName2`` as ``customer_name_2``: split where lower meets upper case and where letters meet digits."""
    x = F.regexp_replace(c, r"([a-z])([A-Z])", "$1_$2")
    x = F.regexp_replace(x, r"([A-Za-z])([0-9])", "$1_$2")
    x = F.regexp_replace(x, r"([0-9])([A-Za-z])", "$1_$2")
    return F.lower(F.btrim(F.regexp_replace(x, r"(?U)[^\w]+", "_"), F.lit("_")))


# --- calculation text -------------------------------------------------------------------------------------------

#: Fixed value: what is not code in a calculation, by the grammar of the language: straight strings with escapes, curly strings, line and
#: block comments, each allowed to end with the text. The string branch is unrolled, since a repeated alternation overflows the regex stack on long literals.
NOT_CODE = r'"[^"\\]*(?:\\[\s\S][^"\\]*)*"?|“[^”]*”?|//[^\n\r]*|/\*[\s\S]*?(?:\*/|\z)'

#: Fixed value: how a reference without a target is printed in a calculation, its occurrence in front where one is shown.
MARKER = r'(?:[^\s:()"<>;,]+::)?<(?:[A-Z][a-z]+ Missing|unknown)>'


def live_code(c: Column) -> Column:
    """The calculation with every string and comment replaced by one double quote."""
    return F.regexp_replace(c, NOT_CODE, '"')


def live_markers(c: Column) -> Column:
    return F.regexp_extract_all(live_code(c), F.lit(f"({MARKER})"), 1)


def commented_markers(c: Column) -> Column:
    parts = F.regexp_extract_all(c, F.lit(f"({NOT_CODE})"), 1)
    comments = F.filter(parts, lambda x: F.startswith(x, F.lit("/")))
    return F.flatten(F.transform(comments, lambda x: F.regexp_extract_all(x, F.lit(f"({MARKER})"), 1)))
