"""Main-content extraction (O38) and page quality flags.

A fixed sequence of regex rewrites evaluated as Column expressions -- drop
script/style/comments and boilerplate blocks, keep the ``<article>`` (else ``<main>``, else ``<body>``)
region, drop inline tags, turn other tags into spaces, decode common named entities, collapse whitespace.
The same steps are emitted as SQL text for the DuckDB oracle (``native_extract_sql``), so both engines apply
one rule list. It cannot equal an external DOM readability library; it keeps the same inputs, outputs and flags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text as X

# Extraction rules (pattern, replacement), applied in order.
_BLOCK_TAGS = ["script", "style", "noscript", "template", "svg", "iframe", "nav", "footer", "aside", "form",
               "header"]
# One alternation, one pass over the text: comments and boilerplate blocks, whichever starts first
# (the shared '<' is factored out so other positions fail on one comparison).
DROP_STEPS = [(r"(?is)<(?:!--.*?-->|" + "|".join(rf"{t}(?:\s[^>]*)?>.*?</{t}\s*>" for t in _BLOCK_TAGS) + ")", " ")]
INLINE_TAGS = ["a", "b", "i", "em", "strong", "span", "code", "small", "sup", "sub", "u", "s", "mark", "abbr",
               "cite", "q", "time", "font"]
INLINE_STEP = (r"(?i)</?(?:" + "|".join(INLINE_TAGS) + r")(?:\s[^>]*)?/?>", "")
TAG_STEP = (r"<[^>]*>", " ")
REGION_PATTERNS = [r"(?is)<article(?:\s[^>]*)?>(.*)</article\s*>", r"(?is)<main(?:\s[^>]*)?>(.*)</main\s*>",
                   r"(?is)<body(?:\s[^>]*)?>(.*)</body\s*>"]
#: The same in two steps, each linear in the text: what is before the last closing tag, and of that what follows the first
#: opening one (a region's pattern looks through the rest of the text again for every opening tag without a closing one).
_REGION_STEPS = [(rf"(?is)^(.*)</{t}\s*>", rf"(?is)<{t}(?:\s[^>]*)?>(.*)") for t in ("article", "main", "body")]
TITLE_PATTERN = r"(?is)<title(?:\s[^>]*)?>(.*?)</title\s*>"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
            ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"), ("&middot;", "·"),
            ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&laquo;", "«"),
            ("&raquo;", "»"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"),
            ("&rdquo;", "”"), ("&amp;", "&")]
_NAME_BYTES = max(len(name) for name, _ in ENTITIES) - 2


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value bound to a lambda variable: it is computed once, however often ``use`` names it (an
    expression that is written out again in CASE branches or lambdas is computed again)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def numeric_references(col) -> Column:
    """``&#8217;`` and ``&#x2019;`` become their characters; numbers beyond Unicode, zero and surrogates stay as written.
    The text is cut at ``&#`` and each part after the first starts with the number, if it is one."""

    def coded(ref: Column) -> Column:
        return F.when(F.lower(ref).startswith("x"), F.conv(F.substring(ref, 2, 8), 16, 10)).otherwise(ref).try_cast("int")

    def decoded(part: Column, at: Column) -> Column:
        def told(x: Column) -> Column:
            char = F.decode(F.unhex(F.lpad(F.hex(x.code), 8, "0")), "UTF-32")
            fits = x.code.between(1, 0xD7FF) | x.code.between(0xE000, 0x10FFFF)
            return F.when(fits, F.concat(char, F.substr(part, F.length(x.ref) + 2))).otherwise(F.concat(F.lit("&#"), part))

        ref = F.regexp_extract(part, r"^([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});", 1)
        return F.when(at == 0, part).otherwise(_once(ref, lambda r: _once(F.struct(r.alias("ref"), coded(r).alias("code")), told)))

    return _once(_c(col), lambda text: F.when(text.contains("&#"), F.array_join(F.transform(F.split(text, "&#"), decoded), ""))
                 .otherwise(text))


def named_references(col) -> Column:
    """``&amp;`` and the other ``ENTITIES`` become their characters, in one pass: the text is cut at ``&`` and each part after
    the first starts with a name and ``;``, or not. None of the characters but the ampersand can begin or end another
    reference, and an ampersand that comes of one is not looked at again."""
    chars = F.create_map(*[F.lit(x) for name, char in ENTITIES for x in (name[1:-1], char)])

    def decoded(part: Column, at: Column) -> Column:
        def told(name: Column) -> Column:
            char = F.when((F.length(name) < F.length(part)) & (F.octet_length(name) <= _NAME_BYTES), chars[name])
            return _once(char, lambda c: F.when(c.isNotNull(), F.concat(c, F.substr(part, F.length(name) + 2)))
                         .otherwise(F.concat(F.lit("&"), part)))

        return F.when(at == 0, part).otherwise(_once(F.substring_index(part, ";", 1), told))

    return _once(_c(col), lambda text: F.when(text.contains("&"), F.array_join(F.transform(F.split(text, "&"), decoded), ""))
                 .otherwise(text))


def unescape(col) -> Column:
    """Numeric references, then named ones."""
    return named_references(numeric_references(col))


def quality_reason(title, plaintext) -> Column:
    """captcha_or_paywall by title or by the first 500 characters, then empty below 200 characters.
    The 200 threshold counts UTF-16 units like JavaScript's ``length`` (astral characters count twice); the
    500-character prefix is taken in code points."""
    t, p = _c(title), _c(plaintext)
    return (F.when(t.isNotNull() & t.rlike(S.TITLE_CAPTCHA_PATTERN), F.lit("captcha_or_paywall"))
            .when(F.substring(p, 1, S.BODY_PREFIX_SCAN_CHARS).rlike(S.BODY_CAPTCHA_PATTERN),
                  F.lit("captcha_or_paywall"))
            .when((F.length(p) < S.MIN_USEFUL_PLAINTEXT_CHARS) & (X.length_utf16(p) < S.MIN_USEFUL_PLAINTEXT_CHARS), F.lit("empty")))


def extract(df: DataFrame, html_col: str) -> DataFrame:
    """Add ``title, plaintext, low_signal, reason`` (reason: parse_error | captcha_or_paywall | empty).

    Staged as columns: the dropped text and each region candidate are computed once per row and referenced afterwards (an expression repeated inside CASE branches would be
    re-evaluated, since conditional branches are not shared by subexpression elimination)."""
    h = F.col(html_col)
    t = h
    for p, r in DROP_STEPS:
        t = F.regexp_replace(t, p, r)
    cols = df.columns
    s2 = df.select("*", t.alias("__gl_t"),
                   F.regexp_extract(h, TITLE_PATTERN, 1).alias("__gl_title_raw"))
    region = F.lit("")
    for i, (close, start) in enumerate(_REGION_STEPS):  # a region is looked for when those before it were not found
        s2 = s2.withColumn(f"__gl_r{i}", F.when(region == "", F.regexp_extract(F.regexp_extract("__gl_t", close, 1), start, 1))
                           .otherwise(region))
        region = F.col(f"__gl_r{i}")
    region = F.when(region == "", F.col("__gl_t")).otherwise(region)
    text = F.regexp_replace(F.regexp_replace(region, *INLINE_STEP), *TAG_STEP)
    s3 = s2.select(*cols, h.isNull().alias("__gl_pe"),
                   F.when(h.isNotNull(), X.collapse_ws(unescape(text))).otherwise(F.lit("")).alias("plaintext"),
                   F.when(h.isNotNull(), F.nullif(X.collapse_ws(unescape(F.regexp_replace("__gl_title_raw", *TAG_STEP))),
                                                  F.lit(""))).alias("title"))
    s4 = s3.withColumn("reason", F.when(F.col("__gl_pe"), F.lit("parse_error"))
                       .otherwise(quality_reason(F.col("title"), F.col("plaintext"))))
    return s4.withColumn("low_signal", F.col("reason").isNotNull()).drop("__gl_pe")


# ------------------------------------------------------------------------------------------------
# SQL twin for the oracle
# ------------------------------------------------------------------------------------------------
def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_numeric(e: str) -> str:
    ref = "regexp_extract(x, '^([0-9]{1,7}|[xX][0-9a-fA-F]{1,6});', 1)"
    code = f"(case when {ref} = '' then 0 when lower({ref}[1]) = 'x' then cast('0' || lower({ref}) as int) else cast({ref} as int) end)"
    fits = f"({code} between 1 and 55295 or {code} between 57344 and 1114111)"
    part = f"case when {fits} then chr({code}) || x[length({ref}) + 2:] else '&#' || x end"
    return (f"(case when contains({e}, '&#') then string_split({e}, '&#')[1] || "
            f"array_to_string(list_transform(string_split({e}, '&#')[2:], lambda x: {part}), '') else {e} end)")


def _sql_unescape(e: str) -> str:
    e = _sql_numeric(e)
    for a, b in ENTITIES:
        e = f"replace({e}, {_q(a)}, {_q(b)})"
    return e


def _sql_collapse(e: str) -> str:
    ws = X.WS
    return f"regexp_replace(regexp_replace({e}, {_q(ws + '+')}, ' ', 'g'), {_q('^' + ws + '+|' + ws + '+\\z')}, '', 'g')"


def native_extract_sql(h: str) -> tuple[str, str]:
    """(title_sql, plaintext_sql) for DuckDB over the html expression ``h``."""
    t = h
    for p, r in DROP_STEPS:
        t = f"regexp_replace({t}, {_q(p)}, {_q(r)}, 'g')"
    region = t
    for p in reversed(REGION_PATTERNS):
        region = f"(case when regexp_extract({t}, {_q(p)}, 1) <> '' then regexp_extract({t}, {_q(p)}, 1) else {region} end)"
    text = f"regexp_replace(regexp_replace({region}, {_q(INLINE_STEP[0])}, '', 'g'), {_q(TAG_STEP[0])}, ' ', 'g')"
    plaintext = f"(case when {h} is null then '' else {_sql_collapse(_sql_unescape(text))} end)"
    title_raw = f"regexp_replace(regexp_extract({h}, {_q(TITLE_PATTERN)}, 1), {_q(TAG_STEP[0])}, ' ', 'g')"
    title = f"nullif({_sql_collapse(_sql_unescape(title_raw))}, '')"
    return title, plaintext


def quality_sql(title: str, plaintext: str) -> str:
    return (f"(case when {title} is not null and regexp_matches({title}, {_q(S.TITLE_CAPTCHA_PATTERN)}) then 'captcha_or_paywall'"
            f" when regexp_matches(substring({plaintext}, 1, {S.BODY_PREFIX_SCAN_CHARS}), {_q(S.BODY_CAPTCHA_PATTERN)}) then 'captcha_or_paywall'"
            f" when length({plaintext}) + length(regexp_replace({plaintext}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g'))"
            f" < {S.MIN_USEFUL_PLAINTEXT_CHARS} then 'empty' end)")
