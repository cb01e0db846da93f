"""String expressions. All run in the JVM; ``(?U)`` makes ``\\s`` cover every Unicode white space."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

WS_EDGES = r"(?U)^\s+|\s+$"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim all Unicode white space on both ends (``trim`` only knows U+0020)."""
    return F.regexp_replace(as_col(c), WS_EDGES, "")


def squeeze(c: Column | str) -> Column:
    """Lower case without any white space: the key under which texts count as repeated."""
    return F.regexp_replace(F.lower(as_col(c)), r"(?U)\s+", "")


def non_empty(c: Column | str) -> Column:
    """NULL for the empty string, so that ``coalesce`` skips both."""
    return F.nullif(as_col(c), F.lit(""))


def non_blank(c: Column | str) -> Column:
    """The stripped text, or NULL where nothing but white space is left."""
    return F.nullif(strip(c), F.lit(""))


def first_filled(*cols: Column | str) -> Column:
    """The first value that is neither NULL nor empty."""
    return F.coalesce(*[non_empty(c) for c in cols])


def id_key(c: Column | str) -> Column:
    """The form in which ids are compared: trimmed, lower case, NULL if blank."""
    return F.lower(non_blank(c))


def content_hash(c: Column | str) -> Column:
    """SHA-256 of the stripped text with LF line ends; '' for nothing."""
    text = F.regexp_replace(strip(c), "\r\n", "\n")
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit("")).otherwise(F.sha2(text, 256))


def short_md5(c: Column | str) -> Column:
    """First 12 hex digits of the MD5."""
    return F.substring(F.md5(as_col(c)), 1, 12)


@lru_cache(maxsize=1)
def _compatibility() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """From the Unicode data: characters that become one other, those that become several, and pairs that compose."""
    one, several, pairs = {}, {}, {}
    for p in range(0x80, sys.maxunicode + 1):
        c = chr(p)
        if 0xAC00 <= p < 0xE000 or not unicodedata.decomposition(c):
            continue
        form = unicodedata.normalize("NFKC", c)
        if form != c:
            (one if len(form) == 1 else several)[c] = form
        parts = unicodedata.normalize("NFD", c)
        head, mark = unicodedata.normalize("NFC", parts[:-1]), parts[-1]
        if len(head) == 1 and unicodedata.combining(mark) and unicodedata.normalize("NFC", head + mark) == c:
            pairs[head + mark] = c
    return one, several, pairs


def _lookup(entries: dict[str, str], key: Column) -> Column:
    listed = lambda xs: F.split(F.lit("\x1f".join(xs)), "\x1f", -1)
    return F.try_element_at(F.map_from_arrays(listed(entries.keys()), listed(entries.values())), key)


def _one_of(chars) -> str:
    """A character class of runs of code points."""
    runs: list[list[int]] = []
    for p in sorted(map(ord, chars)):
        if runs and runs[-1][1] == p - 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"


#: Characters that are their own compatible form, or full-width ASCII: nearly all that texts hold.
_USUAL = r"[^\x00-\x7f\x{c0}-\x{131}\x{400}-\x{52f}\x{2010}\x{2012}-\x{2016}\x{2018}-\x{2022}\x{3000}-\x{3035}\x{4e00}-\x{9fff}\x{ff01}-\x{ff5e}]"


def half_width(c: Column | str) -> Column:
    """Full-width ASCII and the wide space in their ASCII form."""
    wide = range(0xFF01, 0xFF5F)
    return F.translate(as_col(c), "".join(map(chr, wide)) + "\u3000", "".join(chr(p - 0xFEE0) for p in wide) + " ")


def compatible(c: Column | str) -> Column:
    """Compatibility normalization (NFKC), in the JVM.

    Full-width ASCII is translated at once; only a text with an unusual character is taken through all tables: characters that
    become one other by a translation, those that become several, and accents that compose with the letter before them, one by
    one. Several accents on one letter are composed in the order in which they stand.
    """
    plain = half_width(c)
    return F.when(plain.rlike(_USUAL), _all_compatible(plain)).otherwise(plain)


@lru_cache(maxsize=1)
def _tables() -> tuple[str, str, str, str]:
    """Texts of the translation, and the classes of characters that become several and of accents."""
    one, several, pairs = _compatibility()
    return "".join(one), "".join(one.values()), _one_of(several), _one_of({k[-1] for k in pairs})


def _named(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), use)[0]


def _all_compatible(c: Column) -> Column:
    _, several, pairs = _compatibility()
    old, new, widening, accents = _tables()
    chars = lambda t: F.filter(F.split(t, ""), lambda x: x != "")
    widened = lambda t: F.when(t.rlike(widening), F.array_join(F.transform(chars(t), lambda x: F.coalesce(_lookup(several, x), x)), "")).otherwise(t)
    with_last = lambda acc, x: _named(_lookup(pairs, F.concat(F.right(acc, F.lit(1)), x)), lambda one: F.when(one.isNotNull(), F.concat(F.left(acc, F.length(acc) - 1), one)).otherwise(F.concat(acc, x)))
    composed = lambda t: F.when(t.rlike(accents), F.aggregate(chars(t), F.lit(""), with_last)).otherwise(t)
    return _named(_named(F.translate(c, old, new), widened), composed)
