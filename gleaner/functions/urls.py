"""URL scalars as Column expressions (JVM-side, codegen'd).

The host follows the WHATWG rules that decide where a request really goes. White space and controls around the
url are trimmed, tabs and line breaks inside it removed. In the special schemes (http, https, ws, wss, ftp) a
backslash is a slash and any number of slashes may follow the colon; userinfo ends at the last ``@`` before the
path; a host with a forbidden character, or a port beyond 65535, does not parse. Two differences, both on the
safe side: a host with a percent sign or a non-ASCII character is taken as it stands or rejected, never decoded.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AROUND_PATTERN = r"^[\x00-\x20]+|[\x00-\x20]+\z"
INSIDE_PATTERN = r"[\t\n\r]"
_HOST = r"(\[[0-9A-Fa-f:.]+\]|[^\x00-\x20\x7F/\\?#:@<>\[\]^|%]+)"
_PORT = r"(?::(0*(?:[0-9]{1,4}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5])|))?"  # to 65535
# 1 special scheme, 2 host, 3 port, or 4 other scheme, 5 its host, 6 its port; then path, query, fragment or end
URL_PATTERN = (r"^(?:((?i)https?|wss?|ftp):[/\\]*(?:[^/\\?#]*@)?" + _HOST + _PORT + r"(?:[/\\?#]|\z)"
               r"|(?!(?i)(?:https?|wss?|ftp):)([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#]*@)?" + _HOST + _PORT
               + r"(?:[/?#]|\z))[\s\S]*")
AUTHORITY_PATTERN = r"^(?:((?i)https?|wss?|ftp):[/\\]*[^/\\?#]*|[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)"
DEFAULT_PORTS = {"http": 80, "https": 443, "ws": 80, "wss": 443, "ftp": 21}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cleaned(url) -> Column:
    """The url as a parser reads it: trimmed, without tabs and line breaks."""
    return F.regexp_replace(F.regexp_replace(_c(url), AROUND_PATTERN, ""), INSIDE_PATTERN, "")


def _parsed(url) -> Column:
    """Scheme, host and port, lower-cased and parted by spaces behind a mark that no cleaned url starts with; without
    the mark if the url does not parse."""
    return F.lower(F.regexp_replace(cleaned(url), URL_PATTERN, "\x01$1$4 $2$5 $3$6"))


def _part(url, i: int) -> Column:
    return F.nullif(F.regexp_extract(_parsed(url), r"^\x01(\S*) (\S*) (\S*)\z", i), F.lit(""))


def scheme(url) -> Column:
    return _part(url, 1)


def hostname(url) -> Column:
    """Lower-cased hostname, NULL when the url does not parse."""
    return _part(url, 2)


def port(url) -> Column:
    """Explicit port as int, NULL when absent or empty."""
    return _part(url, 3).cast("int")


def origin(url, fallback=None) -> Column:
    """``scheme://host[:port]`` with the scheme's default port dropped; ``'null'`` for non-special schemes
    (as WHATWG); ``fallback`` (default: the raw url) when the url does not parse. The parsed url is rewritten step by
    step, so the expression holds the parse twice, however it is used."""
    u = _c(url)
    parsed = _parsed(u)
    default = "|".join(f"({'|'.join(s for s, q in DEFAULT_PORTS.items() if q == p)}) (\\S*) 0*{p}"
                       for p in dict.fromkeys(DEFAULT_PORTS.values()))
    special = "|".join(DEFAULT_PORTS)
    out = F.regexp_replace(parsed, f"^\\x01(?:{default})\\z", "\x01$1$3$5 $2$4$6 ")
    out = F.regexp_replace(out, f"^\\x01({special}) (\\S*) \\z", "$1://$2")
    out = F.regexp_replace(out, f"^\\x01({special}) (\\S*) 0*(\\d+)\\z", "$1://$2:$3")
    out = F.regexp_replace(out, "^\\x01[\\s\\S]*", "null")
    return F.when(parsed.startswith("\x01"), out).otherwise(u if fallback is None else _c(fallback))


def canonical_url(url) -> Column:
    """Declared cache key (D2): fragment stripped, scheme and host lower-cased, default port dropped.
    Unparsable urls keep their raw string minus the fragment."""
    no_frag = F.regexp_replace(cleaned(url), r"#[\s\S]*\z", "")
    rest = F.regexp_replace(no_frag, AUTHORITY_PATTERN, "")
    rest = F.when(rest == "", F.lit("/")).otherwise(rest)
    return F.when(hostname(no_frag).isNull(), no_frag).otherwise(F.concat(origin(no_frag), rest))


def host_labels(host) -> Column:
    return F.split(_c(host), r"\.")


def host_suffix(host, k: int) -> Column:
    """The last ``k`` labels of ``host`` joined by '.', NULL when the host has fewer labels."""
    labels = host_labels(host)
    return F.when(F.size(labels) >= k, F.array_join(F.slice(labels, -k, k), "."))


def suffix_candidates(host) -> Column:
    """Host itself plus every parent domain with at least two labels, longest first (O16 candidates)."""
    labels = host_labels(host)
    n = F.size(labels)
    return F.when(_c(host).isNull(), F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
                    lambda i: F.array_join(F.slice(labels, i, n - i + 1), ".")))
