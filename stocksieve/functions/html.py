"""Table and link extraction from landed HTML/XML bodies, as native
regex + higher-order array expressions (no per-row Python).

The patterns handle flat tables (the shape of the screener and filing
pages).  Scripts, styles and comments are removed first because they may
contain tag-like text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .markup import element, flat_element, has_class, has_value, hrefs, let
from .text import ColumnOrName, _c, strip_ws, trimmed

_NOISE = r"(?is)<(?:script\b.*?</script>|style\b.*?</style>|!--.*?-->)"
_MAY_BE_NOISE = r"(?i)<(?:script|style|!--)"


def strip_noise(html: ColumnOrName) -> Column:
    """Drop scripts, styles and comments, in any spelling.  The pattern only
    runs on bodies that may contain one of them."""
    h = _c(html)
    return F.when(h.rlike(_MAY_BE_NOISE), F.regexp_replace(h, _NOISE, "")).otherwise(h)


def _inner(tag: str) -> str:
    # (.*?) up to the closing tag, looking for it at each "<" only
    return rf"(?is)<{tag}\b[^>]*>((?>[^<]*)(?:(?><(?!/{tag}>)[^<]*))*+)</{tag}>"


def _plain(tag: str) -> str:
    """Pattern of a row of nothing but ``tag`` elements whose texts are as they
    are seen: no tag, no entity, a visible ASCII character at either end."""
    text = r"(?:(?=[!-~])(?>[^<&]*)(?<=[!-~]))?+"
    return rf"(?is)\A(?>[^<]*)(?:(?><{tag}\b[^>]*>){text}</{tag}>(?>[^<]*))*+\z"


def tag_bodies(html: ColumnOrName, tag: str) -> Column:
    """Inner text of every ``<tag ...>...</tag>`` (non-nested)."""
    return F.regexp_extract_all(_c(html), F.lit(_inner(tag)), 1)


def tables(html: ColumnOrName) -> Column:
    return tag_bodies(strip_noise(html), "table")


def nth_table(html: ColumnOrName, ordinal: int) -> Column:
    """Body of the ``ordinal``-th table (0-based); null when absent."""
    return F.get(tables(html), ordinal)


def table_with_class(html: ColumnOrName, css_class: str) -> Column:
    """Body of the first table of a class (its whole class attribute or one of
    its tokens); tables inside it stay whole."""
    return let(element(strip_noise(html), "table", lambda t: has_class(t, css_class)), lambda x: F.when(x != "", x))


def table_with_attr(html: ColumnOrName, attr: str, value: str) -> Column:
    """Body of the first table with that attribute.  One pattern finds most
    tables; the walk over tags and depths is for the others."""
    plain = strip_noise(html)
    walked = let(element(plain, "table", lambda t: has_value(t, attr, value)), lambda x: F.when(x != "", x))
    return F.coalesce(flat_element(html, "table", attr, value), flat_element(plain, "table", attr, value), walked)


def rows(table: ColumnOrName) -> Column:
    """``<tr>`` bodies of a table body."""
    return tag_bodies(table, "tr")


def unescape(s: ColumnOrName) -> Column:
    src = _c(s)
    out = src
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                    ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return F.when(src.contains("&"), out).otherwise(src)


def cell_text(raw: ColumnOrName) -> Column:
    """Visible text of a cell: tags removed, entities decoded, stripped
    (each step skipped when the cell has nothing for it to do)."""
    r = _c(raw)
    no_tags = F.when(r.contains("<"), F.regexp_replace(r, r"(?s)<[^>]*>", "")).otherwise(r)
    same = trimmed(r) & ~r.contains("<") & ~r.contains("&")
    return F.when(same, r).otherwise(strip_ws(unescape(no_tags)))


def cells(row: ColumnOrName, tag: str = "td") -> Column:
    """Text of every ``<td>`` of one row; a row whose texts need no step is
    told by one look at the row."""
    r = _c(row)
    # in such a row a text ends at the next "<"
    plain = F.regexp_extract_all(r, F.lit(rf"(?i)<{tag}\b[^>]*>([^<]*)"), 1)
    return F.when(r.rlike(_plain(tag)), plain).otherwise(F.transform(tag_bodies(r, tag), cell_text))


def links(html: ColumnOrName) -> Column:
    """Target of every anchor, in page order."""
    return hrefs(html)


def div_with_id(html: ColumnOrName, div_id: str) -> Column:
    """Body of the div of that id, the divs inside it included."""
    return element(strip_noise(html), "div", lambda t: has_value(t, "id", div_id))


def page_links(html: ColumnOrName, div_id: str = "pages") -> Column:
    """Distinct targets under ``div#pages``, sorted, the first one dropped
    (it is the page being read)."""
    targets = F.coalesce(F.array_sort(F.array_distinct(links(div_with_id(html, div_id)))), F.array().cast("array<string>"))
    return F.slice(targets, 2, F.greatest(F.size(targets) - 1, F.lit(0)))


def escape(s: ColumnOrName) -> Column:
    out = F.replace(_c(s), F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    return F.replace(out, F.lit(">"), F.lit("&gt;"))


def render_row(values: list[Column], tag: str = "td") -> Column:
    """``<tr><td>v1</td>...</tr>`` (values escaped, null as empty)."""
    parts = [F.concat(F.lit(f"<{tag}>"), F.coalesce(escape(v), F.lit("")), F.lit(f"</{tag}>")) for v in values]
    return F.concat(F.lit("<tr>"), *parts, F.lit("</tr>"))


def chunks(arr: ColumnOrName, width: int) -> Column:
    """Split an array into consecutive slices of ``width`` (last may be
    short); an empty or null array gives an empty list.  The array is computed
    once."""
    def cut(whole: Column) -> Column:
        n = F.coalesce(F.size(whole), F.lit(0))
        n_chunks = F.floor((n + F.lit(width - 1)) / F.lit(width)).cast("int")
        idx = F.when(n_chunks > 0, F.sequence(F.lit(0), n_chunks - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(idx, lambda i: F.slice(whole, i * width + 1, width))

    return let(_c(arr), cut)
