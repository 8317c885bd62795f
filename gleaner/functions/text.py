"""String, hash, time and encoding scalars as Column expressions.

All of these stay inside whole-stage codegen: no Python UDF. Regex notes:
* JavaScript ``\\s`` and ``trim`` include NBSP, BOM and Unicode spaces; Java's do not, so one class ``WS`` is used.
* Java ``$`` matches before a final newline; end anchors use ``\\z``.
* ``\\d``, ``[A-Z]``, ``\\b`` stay ASCII, as in JavaScript.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schemas as S

WS_CHARS = r"\s\x{000B}\x{00A0}\x{FEFF}\p{Z}"
WS = f"[{WS_CHARS}]"
#: Runs of whitespace other than one space. Printable ASCII is told by one comparison, before the class is looked at.
_WS_RUN = f"(?![!-~])(?: {WS}+|[{WS_CHARS}&&[^ ]]{WS}*)"

# Sentence boundary, citation url and trailing punctuation (must equal the service's patterns).
SENTENCE_SPLIT_PATTERN = r"(?<=[.!?])" + WS + r"+(?=[A-Z\d\"(`])"
URL_IN_TEXT_PATTERN = r"https?://[^" + WS_CHARS + r")\]<>'\"]+"
URL_TRAILING_PUNCT_PATTERN = r"[.,;:!?)\]]+\z"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_trim(col) -> Column:
    """Trim with JavaScript's whitespace set."""
    return F.regexp_replace(_c(col), f"^{WS}+|{WS}+\\z", "")


def collapse_ws(col) -> Column:
    """Collapse whitespace runs to one space and trim (O32). Single spaces are left as they are, and then no other
    whitespace is there to trim."""
    return F.trim(F.regexp_replace(_c(col), _WS_RUN, " "))


def split_sentences(text) -> Column:
    """Ordered sentences; blank pieces dropped."""
    return F.filter(F.split(_c(text), SENTENCE_SPLIT_PATTERN), lambda s: F.length(js_trim(s)) > 0)


def extract_urls(sentence) -> Column:
    """Every http(s) url in ``sentence`` with trailing punctuation removed."""
    return F.transform(F.regexp_extract_all(_c(sentence), F.lit(f"({URL_IN_TEXT_PATTERN})"), 1),
                       lambda u: F.regexp_replace(u, URL_TRAILING_PUNCT_PATTERN, ""))


def sha256_hex(col) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(_c(col), 256)


def low_signal_sha(url) -> Column:
    return sha256_hex(F.concat(F.lit(S.LOW_SIGNAL_SHA_PREFIX), _c(url)))


def iso_ms(ts) -> Column:
    """ISO-8601 text with milliseconds and ``Z`` (session time zone must be UTC)."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def parse_iso(text) -> Column:
    """Parse ISO-8601 text; NULL when unparsable."""
    return F.try_to_timestamp(_c(text))


def uri_component(col) -> Column:
    """``encodeURIComponent``: Java form-encoding then the six characters it treats differently."""
    e = F.url_encode(_c(col))
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        e = F.replace(e, F.lit(a), F.lit(b))
    return e


def decode_body(body) -> Column:
    """Lossy UTF-8 decode of a binary body, leading BOM dropped (O36): each maximal part of a broken sequence becomes
    one U+FFFD, as a WHATWG decoder has it."""
    b, mark = _c(body), F.unhex(F.lit("EFBBBF"))
    rest = F.when(F.call_function("substr", b, F.lit(1), F.lit(3)) == mark, F.call_function("substr", b, F.lit(4))).otherwise(b)
    return F.make_valid_utf8(rest.cast("string"))


def render_segment(origin, sha, plaintext) -> Column:
    """Wrap page text as an untrusted segment; literal close tags inside are escaped."""
    safe = F.replace(_c(plaintext), F.lit(S.UNTRUSTED_CLOSE), F.lit(S.UNTRUSTED_CLOSE_ESCAPED))
    return F.concat(F.lit(S.UNTRUSTED_OPEN + " origin="), _c(origin), F.lit(" sha256="), _c(sha), F.lit(">\n"),
                    safe, F.lit("\n" + S.UNTRUSTED_CLOSE))


def length_utf16(col) -> Column:
    """Length in UTF-16 code units (JavaScript ``.length``): astral characters count twice."""
    return (F.octet_length(F.encode(_c(col), "UTF-16BE")) / 2).cast("int")
