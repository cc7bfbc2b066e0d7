"""HTML text extraction with built-in regex functions (no parser, no UDF).

A page is treated as text: scripts, styles and comments are removed, tags
become node boundaries, node texts are stripped and joined by a separator,
the way a DOM ``get_text(sep, strip=True)`` reads.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ratebook.functions.text import col_, strip_unicode, try_cast

# Patterns of the published notices.
NOTICE_DATE_PATTERN = r"(\d{4})年(\d{1,2})月(\d{1,2})日"
NOTICE_RATE_PATTERN = r"1美元对人民币(\d+(?:\.\d+)?)元"
NOTICE_RATE_PATTERN_4DP = r"1美元对人民币(\d+\.\d{4})元"
RATE_LINK_KEYWORD = "人民币汇率中间价"

# Character references decoded in text nodes.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
            ("&#39;", "'"), ("&amp;", "&"))

_MARK = "\u0001"
_DROP_BLOCKS = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"


def decode_entities(c) -> Column:
    out = col_(c)
    for ent, ch in ENTITIES:
        out = F.replace(out, F.lit(ent), F.lit(ch))
    return out


def text_nodes(html) -> Column:
    """Array of stripped, non-empty text nodes in document order."""
    body = F.regexp_replace(col_(html), _DROP_BLOCKS, _MARK)
    marked = F.regexp_replace(body, r"(?s)<[^>]*>", _MARK)
    parts = F.split(marked, _MARK)
    cleaned = F.transform(parts, lambda x: strip_unicode(decode_entities(x)))
    return F.filter(cleaned, lambda x: x != "")


def page_text(html, sep: str) -> Column:
    """The page text, node texts joined by ``sep``."""
    return F.array_join(text_nodes(html), sep)


def extract_group(text, pattern: str, idx: int) -> Column:
    """``regexp_extract`` with no-match as null (not the empty string)."""
    return F.nullif(F.regexp_extract(col_(text), pattern, idx), F.lit(""))


def notice_date(text) -> Column:
    """First ``yyyy年m月d日`` in the text as a date, else null."""
    t = col_(text)
    return F.try_make_timestamp(
        try_cast(extract_group(t, NOTICE_DATE_PATTERN, 1), "int"),
        try_cast(extract_group(t, NOTICE_DATE_PATTERN, 2), "int"),
        try_cast(extract_group(t, NOTICE_DATE_PATTERN, 3), "int"),
        F.lit(0), F.lit(0), F.lit(0)).cast("date")


def notice_rate(text, four_decimals: bool = False) -> Column:
    """First ``1美元对人民币N元`` value (DECIMAL), else null."""
    pattern = NOTICE_RATE_PATTERN_4DP if four_decimals else NOTICE_RATE_PATTERN
    return try_cast(extract_group(col_(text), pattern, 1), "decimal(18,6)")


# Anchor: href in double or single quotes, inner HTML up to </a>.
ANCHOR_PATTERN = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a\s*>"""


def anchors(html) -> Column:
    """array<struct<pos:int, href:string, text:string>> of anchors in order."""
    hrefs = F.regexp_extract_all(col_(html), F.lit(ANCHOR_PATTERN), 1)
    inner = F.regexp_extract_all(col_(html), F.lit(ANCHOR_PATTERN), 2)
    zipped = F.arrays_zip(hrefs.alias("href"), inner.alias("inner"))
    return F.transform(zipped, lambda z, i: F.struct(
        (i + 1).alias("pos"),
        strip_unicode(decode_entities(z["href"])).alias("href"),
        F.array_join(text_nodes(z["inner"]), "").alias("text")))


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*:"
_ORIGIN = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"


def _fold_dots(path: Column) -> Column:
    """Drop ``.`` segments and let ``..`` remove the segment before it, at any depth.

    Only the path is folded; a query or fragment behind it stays as it is. A
    dot segment at the end leaves its slash.
    """
    bare = F.regexp_extract(path, r"^([^?#]*)", 1)
    rest = F.substr(path, F.length(bare) + 1)
    segments = F.split(bare, "/")
    folded = F.aggregate(
        F.slice(segments, 2, F.size(segments)), F.array().cast("array<string>"),
        lambda out, s: F.when(s == "..", F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))))
        .when(s == ".", out).otherwise(F.concat(out, F.array(s))))
    open_end = F.element_at(segments, -1).isin(".", "..") & (F.size(folded) > 0)
    return F.concat(F.lit("/"), F.array_join(folded, "/"), F.when(open_end, "/").otherwise(""), rest)


def resolve_url(base, href) -> Column:
    """Resolve an href against the page URL (absolute, ``//``, rooted, relative)."""
    b = col_(base)
    h = col_(href)
    scheme = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    origin = F.regexp_extract(b, _ORIGIN, 1)
    base_no_frag = F.regexp_replace(b, r"#.*$", "")
    base_no_query = F.regexp_replace(base_no_frag, r"\?.*$", "")
    base_dir = F.regexp_replace(base_no_query, r"[^/]*$", "")
    base_path = F.substr(base_dir, F.length(origin) + 1)
    return (F.when(h == "", base_no_frag)
            .when(h.rlike(_SCHEME), h)
            .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
            .when(h.startswith("/"), F.concat(origin, _fold_dots(h)))
            .when(h.startswith("?"), F.concat(base_no_query, h))
            .when(h.startswith("#"), F.concat(base_no_frag, h))
            .otherwise(F.concat(origin, _fold_dots(F.concat(
                F.when(base_path == "", F.lit("/")).otherwise(base_path), h)))))


def first_table(html, table_id: str | None = None) -> Column:
    """Inner HTML of the first ``<table>`` (optionally with the given id)."""
    if table_id:
        pat = r"(?is)<table\b[^>]*\bid\s*=\s*[\"']" + table_id + r"[\"'][^>]*>(.*?)</table\s*>"
    else:
        pat = r"(?is)<table\b[^>]*>(.*?)</table\s*>"
    return extract_group(col_(html), pat, 1)


def table_rows(table_html) -> Column:
    """Array of rows, each an array of stripped cell texts; rows without cells dropped."""
    rows = F.regexp_extract_all(col_(table_html), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr\s*>"), 1)
    cells = F.transform(rows, lambda r: F.transform(
        F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]\s*>"), 1),
        lambda c: F.array_join(text_nodes(c), "")))
    return F.filter(cells, lambda r: F.size(r) > 0)


def locate_column(header, keywords) -> Column:
    """0-based index of the first header cell containing any keyword (case-insensitive), else null."""
    hit = F.transform(col_(header), lambda h: F.exists(
        F.array(*[F.lit(k.lower()) for k in keywords]),
        lambda k: F.contains(F.lower(strip_unicode(h)), k)))
    pos = F.array_position(hit, F.lit(True))
    return F.when(pos > 0, (pos - 1).cast("int"))
