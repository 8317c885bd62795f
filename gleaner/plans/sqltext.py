"""SQL-text twins of the Column functions, for the DuckDB oracle (RE2 regex; no look-around). The url rules are
written step by step here, apart from the one pattern that the Spark side uses."""

from __future__ import annotations


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def cleaned(u: str) -> str:
    return f"regexp_replace(regexp_replace({u}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'), '[\\x09\\x0A\\x0D]', '', 'g')"


def is_special(u: str) -> str:
    return f"regexp_matches(lower({cleaned(u)}), '^(http|https|ws|wss|ftp):')"


def host_and_port(u: str) -> str:
    """What stands between the slashes (userinfo removed) and the path; '' when the url has no such place."""
    c = cleaned(u)
    authority = (f"(case when {is_special(u)} then split_part(regexp_replace(translate(regexp_replace({c}, '[?#].*$', '', 's'), "
                 f"chr(92), '/'), '^[a-zA-Z]+:/*', ''), '/', 1) "
                 f"when regexp_matches({c}, '^[a-zA-Z][a-zA-Z0-9+.-]*://') then regexp_extract({c}, '://([^/?#]*)', 1) else '' end)")
    return f"regexp_replace({authority}, '^.*@', '', 's')"


def raw_port(u: str) -> str:
    return f"regexp_extract({host_and_port(u)}, ':([0-9]+)$', 1)"


def host(u: str) -> str:
    hp, p = host_and_port(u), raw_port(u)
    name = f"regexp_replace({hp}, ':[0-9]*$', '')"
    good = (f"(regexp_full_match({name}, '\\[[0-9A-Fa-f:.]+\\]') or (length({name}) > 0 and "
            f"not regexp_matches({name}, '[\\x00-\\x20\\x7F#/:<>?@\\[\\\\\\]^|%]')))")
    return f"(case when {good} and coalesce(try_cast(nullif({p}, '') as hugeint), 0) <= 65535 then lower({name}) end)"


def scheme(u: str) -> str:
    return f"(case when {host(u)} is not null then lower(split_part({cleaned(u)}, ':', 1)) end)"


def port(u: str) -> str:
    return f"(case when {host(u)} is not null then cast(nullif({raw_port(u)}, '') as integer) end)"


def origin(u: str, fallback: str | None = None) -> str:
    s, h, p = scheme(u), host(u), port(u)
    d = (f"(case {s} when 'http' then 80 when 'https' then 443 when 'ws' then 80 when 'wss' then 443 "
         f"when 'ftp' then 21 end)")
    fb = fallback or u
    return (f"(case when {h} is null then {fb} when {d} is not null then concat({s}, '://', {h}, "
            f"case when {p} is not null and {p} <> {d} then concat(':', cast({p} as varchar)) else '' end) "
            f"else 'null' end)")


def canonical(u: str) -> str:
    nf = f"regexp_replace({cleaned(u)}, '#.*$', '', 's')"
    rest = (f"(case when {is_special(u)} then regexp_replace({nf}, '^[a-zA-Z]+:[/\\\\]*[^/\\\\?]*', '') "
            f"else regexp_replace({nf}, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*', '') end)")
    return (f"(case when {host(nf)} is null then {nf} else concat({origin(nf)}, "
            f"case when {rest} = '' then '/' else {rest} end) end)")


def allow_best(url_expr: str, key_cols: str, src: str) -> str:
    """Longest matching allowlist entry per row of ``src`` (written as a theta join + row_number)."""
    h = host(url_expr)
    return f"""(select * from (select {key_cols}, al.entry_index, al.domain, al.purpose, al.ttl_class,
   row_number() over (partition by {key_cols} order by length(al.domain) desc, al.entry_index) as rk
  from (select s.*, {h} as gl_h from {src} s) s
  join al on (s.gl_h = al.domain or ends_with(s.gl_h, '.' || al.domain))) where rk = 1)"""


TTL_CASE = ("(case ttl_class when 'insurance-med' then 86400 when 'airline' then 3600 "
            "when 'generic' then 604800 end)")
