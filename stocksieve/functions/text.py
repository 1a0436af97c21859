"""String expressions built from native Spark functions (no Python UDFs).

Each helper returns a ``Column`` so it stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _case_words(s: ColumnOrName, word_class: str) -> Column:
    """Split into runs of word / non-word characters, capitalise each word
    run (first char upper, rest lower) and glue the runs back together."""
    runs = F.regexp_extract_all(_c(s), F.lit(f"({word_class}+|[^{word_class[1:-1]}]+)"), 1)
    fixed = F.transform(runs, lambda t: F.concat(F.upper(F.substring(t, 1, 1)), F.lower(F.substring(t, 2, 1 << 30))))
    return F.when(_c(s).isNull(), F.lit(None).cast("string")).otherwise(F.array_join(fixed, ""))


def title_case(s: ColumnOrName) -> Column:
    """Python ``str.title``: a letter after any non-letter starts a word
    (``3com`` -> ``3Com``, ``co-chief`` -> ``Co-Chief``)."""
    return _case_words(s, r"[\p{L}]")


def pg_initcap(s: ColumnOrName) -> Column:
    """PostgreSQL ``initcap``: words are runs of letters *or digits*
    (``3com`` -> ``3com``, ``co-ceo`` -> ``Co-Ceo``).  Spark's own
    ``initcap`` only splits on spaces, so it is not used."""
    return _case_words(s, r"[\p{L}\p{N}]")


def pg_left(s: ColumnOrName, n: Column | int) -> Column:
    """PostgreSQL ``left(s, n)``: first n characters; a negative n means
    all but the last |n| characters."""
    s = _c(s)
    n = F.lit(n) if isinstance(n, int) else n
    keep = F.when(n >= 0, n).otherwise(F.greatest(F.length(s) + n, F.lit(0)))
    return s.substr(F.lit(1), keep)


# Every character Python's str.strip() removes (derived, not listed).
WHITESPACE = "".join(ch for ch in map(chr, range(0x3001)) if ch.isspace())


def strip_ws(s: ColumnOrName) -> Column:
    """Python ``str.strip()``: leading/trailing whitespace of any kind
    (Spark ``trim`` only removes spaces).  ``btrim`` with a character set
    is a plain scan, several times cheaper than a regex replace."""
    return F.btrim(_c(s), F.lit(WHITESPACE))


def trimmed(s: ColumnOrName) -> Column:
    """Whether a text begins and ends with a visible ASCII character, so that
    ``strip_ws`` leaves it as it is (two comparisons of bytes, where the trim
    lists every character)."""
    def visible(c: Column) -> Column:
        return (c >= "!") & (c < "\x7f")

    return visible(_c(s)) & visible(F.reverse(_c(s)))


def one_line(s: ColumnOrName) -> Column:
    """Newlines to spaces (cells are written one line each)."""
    return F.translate(_c(s), "\n", " ")


def parse_count(s: ColumnOrName) -> Column:
    """``'1,234'`` -> 1234 as bigint; anything unparsable -> null."""
    return F.replace(_c(s), F.lit(","), F.lit("")).try_cast("bigint")


def parse_number(s: ColumnOrName) -> Column:
    """Coercing numeric parse that also accepts ``'123.0'`` text."""
    s = F.replace(_c(s), F.lit(","), F.lit(""))
    return F.coalesce(s.try_cast("bigint"), s.try_cast("double").try_cast("bigint"))


def dash_part(s: ColumnOrName, i: int, whole_tail: bool = False) -> Column:
    """Part ``i`` of ``'TICK - Company'`` split on ``-``, trimmed; missing
    part -> null.  ``whole_tail`` keeps everything after the first hyphen
    (a company name that itself contains a hyphen stays whole)."""
    s = _c(s)
    if whole_tail and i == 1:
        return strip_ws(F.get(F.split(s, "-", 2), 1))
    # cut in bytes, without an array of all parts; most parts end in spaces at most
    part = F.substring_index(s, "-", i + 1)
    if i:
        part = F.when(F.substring_index(s, "-", i) != s, F.substring_index(part, "-", -1))
    cut = F.trim(part)
    return F.when(trimmed(cut), cut).otherwise(strip_ws(cut))


def comma_items(s: ColumnOrName) -> Column:
    """``'a, b,c'`` -> ``['a','b','c']`` (trimmed, empties dropped)."""
    return F.filter(F.transform(F.split(_c(s), ","), strip_ws), lambda x: x != "")


def join_list(arr: ColumnOrName, sep: str = ",") -> Column:
    """List cell -> comma string (elements cast to text)."""
    return F.array_join(F.transform(_c(arr), lambda x: x.cast("string")), sep)


def normalise_name(s: ColumnOrName, max_len: int | None = 59) -> Column:
    """Column/line-item name normalisation: lower-case, space -> ``_``,
    optionally cut to ``max_len`` characters."""
    out = F.replace(F.lower(_c(s)), F.lit(" "), F.lit("_"))
    if max_len is not None:
        out = F.substring(out, 1, max_len)
    return out


def none_to_null(s: ColumnOrName) -> Column:
    """The text ``'None'`` means missing."""
    return F.nullif(_c(s), F.lit("None"))


def nan_to_null(x: ColumnOrName) -> Column:
    x = _c(x)
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)
