"""String and regular-expression functions as Column builders.

Lengths are in bytes where the name says so. Patterns use what RE2 and Java
have in common (no look-around).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions.math import col

lower, upper = (lambda s, f=f: f(col(s)) for f in (F.lower, F.upper))


def _all(s, pattern: str) -> Column:
    return col(s).rlike(pattern)


def title(s) -> Column:
    """Upper case after every non-letter, lower case elsewhere."""
    parts = F.regexp_extract_all(col(s), F.lit(r"(\p{L}+|[^\p{L}]+)"), 1)
    return F.array_join(F.transform(parts, F.initcap), "")


def capitalize(s) -> Column:
    return F.concat(F.upper(F.substring(col(s), 1, 1)), F.lower(F.substring(col(s), 2, 1 << 30)))


def islower(s) -> Column:
    return _all(s, r"\p{Ll}") & ~_all(s, r"[\p{Lu}\p{Lt}]")


def isupper(s) -> Column:
    return _all(s, r"\p{Lu}") & ~_all(s, r"[\p{Ll}\p{Lt}]")


def istitle(s) -> Column:
    return _all(s, r"\p{L}") & (col(s) == title(s))


def isalnum(s) -> Column:
    return _all(s, r"^[\p{L}\p{N}]+$")


def isalpha(s) -> Column:
    return _all(s, r"^\p{L}+$")


def isdecimal(s) -> Column:
    return _all(s, r"^\p{Nd}+$")


def isdigit(s) -> Column:
    """Decimal digits, and super- and subscript ones."""
    return _all(s, r"^[\p{Nd}\x{B2}\x{B3}\x{B9}\x{2070}\x{2074}-\x{2079}\x{2080}-\x{2089}]+$")


def isnumeric(s) -> Column:
    return _all(s, r"^\p{N}+$")


def isempty(s) -> Column:
    return F.length(col(s)) == 0


def isspace(s) -> Column:
    return _all(s, r"^\s+$")


def strip(s, chars: str | None = None) -> Column:
    return F.btrim(col(s), F.lit(chars)) if chars else F.regexp_replace(col(s), r"^\s+|\s+$", "")


def byte_lengths(s) -> Column:
    return F.octet_length(col(s))


def get_bytes(s) -> Column:
    return F.encode(col(s), "UTF-8")


def encode_idna_safe(s) -> Column:
    """ASCII form with escapes for the rest; ``decode`` is its inverse for what it made."""
    return F.url_encode(col(s))


def decode_idna_safe(s) -> Column:
    return F.url_decode(col(s))


def contains(s, what: str, regex: bool = False) -> Column:
    return col(s).rlike(what) if regex else col(s).contains(what)


def startswith(s, what: str, regex: bool = False) -> Column:
    return col(s).rlike(f"^(?:{what})") if regex else col(s).startswith(what)


def endswith(s, what: str, regex: bool = False) -> Column:
    return col(s).rlike(f"(?:{what})$") if regex else col(s).endswith(what)


def search(s, pattern: str) -> Column:
    return col(s).rlike(pattern)


def match(s, pattern: str) -> Column:
    return col(s).rlike(f"^(?:{pattern})")


def fullmatch(s, pattern: str) -> Column:
    return col(s).rlike(f"^(?:{pattern})$")


def group(s, pattern: str, n: int = 0) -> Column:
    """Group n of the first match; NULL without one."""
    return F.when(col(s).rlike(pattern), F.regexp_extract(col(s), pattern, n))


def findall(s, pattern: str) -> Column:
    return F.regexp_extract_all(col(s), F.lit(pattern), 0)


def count_matches(s, pattern: str) -> Column:
    return F.regexp_count(col(s), F.lit(pattern))


def _matches(s, pattern: str) -> Column:
    """array<struct<gap, size>>: the length of every match (it may be 0) and of the text between it and the match before.

    Matches are marked by two code points that are no characters (U+FDD0, U+FDD1); texts hold none. The mark behind a match
    also parts the text, so that a part holds one gap and one match: no part is looked up from within a lambda, which
    would replace and part the whole text anew for every match.
    """
    parts = F.split(F.regexp_replace(col(s), pattern, "\ufdd1$0\ufdd0"), "\ufdd0", -1)
    at = lambda x: F.instr(x, "\ufdd1")
    return F.transform(F.filter(parts, lambda x: at(x) > 0), lambda x: F.struct((at(x) - 1).alias("gap"), (F.length(x) - at(x)).alias("size")))


def find_locations(s, pattern: str) -> Column:
    """array<struct<start, length>> of all matches, in characters from 0."""
    step = lambda acc, x: F.array_append(acc, F.struct((F.coalesce(F.try_element_at(acc, F.lit(-1))["start"] + F.try_element_at(acc, F.lit(-1))["length"], F.lit(0)) + x["gap"]).alias("start"), x["size"].alias("length")))
    return F.aggregate(_matches(s, pattern), F.array().cast("array<struct<start:int,length:int>>"), step)


def locations(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, n, start, length): a row a match. Linear in the text, where ``find_locations`` copies its result for every match."""
    rows = df.select(key, F.monotonically_increasing_id().alias("__r"), _matches(text, pattern).alias("__p")).select(key, "__r", F.posexplode("__p").alias("n", "__e"))
    before = F.sum(F.col("__e.gap") + F.col("__e.size")).over(Window.partitionBy("__r").orderBy("n"))
    return rows.select(key, "n", (before - F.col("__e.size")).alias("start"), F.col("__e.size").alias("length"))


def sub(s, pattern: str, replacement: str, count: int = 0) -> Column:
    """Replace all matches, or the first ``count``; groups are written $1."""
    if not count:
        return F.regexp_replace(col(s), pattern, replacement)
    parts = F.split(F.regexp_replace(col(s), pattern, f"\ufdd0$0\ufdd1{replacement}\ufdd2"), "\ufdd0", -1)
    before, behind = lambda x, mark: F.substring_index(x, mark, 1), lambda x, mark: F.substr(x, F.instr(x, mark) + 1)
    chosen = lambda x, i: F.when(i < count, before(behind(x, "\ufdd1"), "\ufdd2")).otherwise(before(x, "\ufdd1"))
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x, i: F.concat(chosen(x, i), behind(x, "\ufdd2")))
    return F.concat(F.get(parts, 0), F.array_join(rest, ""))


def subn(s, pattern: str, replacement: str, count: int = 0) -> Column:
    n = count_matches(s, pattern)
    return F.struct(sub(s, pattern, replacement, count).alias("text"), (F.least(n, F.lit(count)) if count else n).alias("n"))


def find_match(s, pattern: str, kind: str = "search") -> Column:
    """struct<start, end, text> of the first match ('search'), of one at the start ('match') or of the whole text ('fullmatch'); NULL without one."""
    anchored = {"search": pattern, "match": f"^(?:{pattern})", "fullmatch": f"^(?:{pattern})$"}[kind]
    first = F.get(_matches(s, anchored), 0)
    span = F.struct(first["gap"].alias("start"), (first["gap"] + first["size"]).alias("end"), F.substr(col(s), first["gap"] + 1, first["size"]).alias("text"))
    return F.when(first.isNotNull(), span)


def split(s, delimiter: str, regex: bool = False) -> Column:
    return F.split(col(s), delimiter if regex else _literal(delimiter), -1)


def regex_split(s, pattern: str, maxsplit: int = 0) -> Column:
    return F.split(col(s), pattern, maxsplit + 1 if maxsplit else -1)


def _literal(text: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and c.isascii() else c for c in text)


def peel(s, delimiter: str, times: int = 1, include: bool = False, keep_partial: bool = False) -> tuple[Column, Column]:
    """(left, right) around the ``times``-th delimiter from the left.

    Without enough delimiters the whole text is the right part, or the left
    one if ``keep_partial``.
    """
    parts = split(s, delimiter)
    enough = F.size(parts) > times
    left = F.array_join(F.slice(parts, 1, times), delimiter)
    right = F.array_join(F.slice(parts, times + 1, F.size(parts)), delimiter)
    left = F.concat(left, F.lit(delimiter)) if include else left
    return F.when(enough, left).otherwise(col(s) if keep_partial else F.lit("")), F.when(enough, right).otherwise(F.lit("") if keep_partial else col(s))


def rpeel(s, delimiter: str, times: int = 1, include: bool = False, keep_partial: bool = False) -> tuple[Column, Column]:
    """(left, right) around the ``times``-th delimiter from the right."""
    parts = split(s, delimiter)
    n = F.size(parts)
    enough = n > times
    left = F.array_join(F.slice(parts, 1, F.greatest(n - times, F.lit(0))), delimiter)
    right = F.array_join(F.slice(parts, F.greatest(n - times + 1, F.lit(1)), n), delimiter)
    right = F.concat(F.lit(delimiter), right) if include else right
    return F.when(enough, left).otherwise(F.lit("") if keep_partial else col(s)), F.when(enough, right).otherwise(col(s) if keep_partial else F.lit(""))


def stick(a, b, delimiter: str = "") -> Column:
    return F.concat(col(a), F.lit(delimiter), col(b))


def lstick(a, b, delimiter: str = "") -> Column:
    return F.concat(col(b), F.lit(delimiter), col(a))


def get_prefixes(s, n: int, proper: bool = True) -> Column:
    """The first n bytes' text of ASCII strings longer than n (or as long); NULL for others."""
    return F.when(F.octet_length(col(s)) >= n + proper, F.substring(col(s), 1, n))


def get_suffixes(s, n: int, proper: bool = True) -> Column:
    return F.when(F.octet_length(col(s)) >= n + proper, F.substring(col(s), -n, n))


def hash128(s) -> tuple[Column, Column]:
    """Two independent 64-bit hashes."""
    return F.xxhash64(col(s)), F.xxhash64(F.lit("second"), col(s))
