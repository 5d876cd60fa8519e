"""DuckDB SQL fragments stating each rule independently of the Spark code.

Used only to build the ``oracle_sql()`` strings of the query catalog: DuckDB
(RE2 regexes, list lambdas) runs them on the same parquet tables and the
driver compares the results with the Spark queries.
"""

from __future__ import annotations

from ..constants import (
    CONSUMER_DOMAINS,
    HTML_BLOCK_TAGS,
    HTML_ENTITIES,
    HTML_HIDDEN_TAGS,
    HTML_LEGACY_NAMES,
    SPF_RESULT_WORDS,
    SPF_STATUS_WORDS,
)
from ..functions.text import IPV6_PATTERN, IPVFUTURE_PATTERN, NFKC_DELIMITER_CLASS


def lit(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


# white space and links, stated here for themselves
_SPACE = (r"\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}"
          r"\x{205f}\x{3000}")
WS = f"[{_SPACE}]"
URL = lit(r"[hH][tT][tT][pP][sS]?://[^\"'()<>" + _SPACE + "]+")
_PUNCT = r"[.,!?;*\-]"


def py_strip(e: str) -> str:
    return f"regexp_replace({e}, {lit('^' + WS + '+|' + WS + '+' + chr(92) + 'z')}, '', 'g')"


def collapse_ws(e: str) -> str:
    return f"regexp_replace({e}, {lit(WS + '+')}, ' ', 'g')"


def _domain_of(b: str) -> str:
    """SQL for the domain of a URL with scheme held in expression ``b``."""
    n = f"regexp_extract({b}, {lit(r'(?i)^https?://([^/?#]*)')}, 1)"
    host = f"regexp_replace(regexp_extract({n}, '^[^:]*', 0), {lit(r'(?i)^www\.')}, '')"
    inner = f"regexp_extract({n}, {lit(r'^[^\[]*\[([^\]]*)')}, 1)"
    valid = (f"(CASE WHEN starts_with({inner}, 'v') THEN regexp_matches({inner}, {lit(IPVFUTURE_PATTERN)}) "
             f"ELSE regexp_matches({inner}, {lit(IPV6_PATTERN)}) END)")
    has_l, has_r = f"contains({n}, '[')", f"contains({n}, ']')"
    nfkc = f"regexp_matches({n}, {lit(NFKC_DELIMITER_CLASS)})"
    refused = f"(starts_with({n}, ':') AND (({has_l}) <> ({has_r}) OR (({has_l}) AND NOT {valid}) OR {nfkc}))"
    return f"(CASE WHEN {n} = '' OR {refused} THEN {b} ELSE {host} END)"


def url_domain(e: str) -> str:
    return f"(CASE WHEN {e} IS NULL THEN NULL ELSE {_domain_of(e)} END)"


def _reduced_list(t: str, vocab: str | None) -> str:
    base = f"regexp_replace(lam_u, {lit(_PUNCT + '+' + chr(92) + 'z')}, '')"
    punct = f"regexp_extract(lam_u, {lit(_PUNCT + '*' + chr(92) + 'z')}, 0)"
    pairs = f"list_transform(regexp_extract_all({t}, {URL}, 0), lambda lam_u: struct_pack(b := {base}, p := {punct}))"
    dom = _domain_of("lam_s.b")
    if vocab is not None:
        dom = f"(CASE WHEN list_contains({vocab}, {dom}) THEN '[DOM_' || {dom} || ']' ELSE {dom} END)"
    return f"list_transform({pairs}, lambda lam_s: {dom} || lam_s.p)"


def strip_urls(t: str, vocab: str | None = None) -> str:
    red = _reduced_list(t, vocab)
    joined = (
        f"array_to_string(list_transform(list_zip(string_split_regex({t}, {URL}), {red}), "
        f"lambda lam_z: lam_z[1] || coalesce(lam_z[2], '')), '')"
    )
    return f"(CASE WHEN {t} IS NULL THEN NULL ELSE {joined} END)"


def url_domains(t: str) -> str:
    base = f"regexp_replace(lam_u, {lit(_PUNCT + '+' + chr(92) + 'z')}, '')"
    bases = f"list_transform(regexp_extract_all({t}, {URL}, 0), lambda lam_u: {base})"
    return f"list_transform({bases}, lambda lam_b: {_domain_of('lam_b')})"


def html_text_flat(h: str) -> str:
    drop = "(?is)<(?:" + "|".join(["!--.*?-->"] + [rf"{t}\b[^>]*>.*?</{t}\s*>" for t in HTML_HIDDEN_TAGS]) + ")"
    decl = r"<![^>]*>|<\?[^>]*>"
    brk = (r"(?i)<br\b[^>]*>|</(?:" + "|".join(HTML_BLOCK_TAGS) + r")\s*>|<(?:"
           + "|".join(HTML_BLOCK_TAGS) + r")\b[^>]*/>")
    tag = r"</?[a-zA-Z][^>]*>"
    legacy = "&(" + "|".join(HTML_LEGACY_NAMES) + ")([^-.a-zA-Z0-9;])"
    e = f"regexp_replace({h}, {lit(legacy)}, {lit(chr(38) + chr(92) + '1;' + chr(92) + '2')}, 'g')"
    e = f"regexp_replace({e}, {lit(legacy)}, {lit(chr(38) + chr(92) + '1;' + chr(92) + '2')}, 'g')"
    e = f"regexp_replace({e}, {lit(drop)}, '', 'g')"
    e = f"regexp_replace({e}, {lit(decl)}, '', 'g')"
    e = f"regexp_replace({e}, {lit(brk)}, chr(10), 'g')"
    e = f"regexp_replace({e}, {lit(tag)}, '', 'g')"
    for ent, ch in HTML_ENTITIES:
        e = f"replace({e}, {lit(ent)}, {lit(ch)})"
    e = f"replace({e}, {lit(chr(92) + 'n')}, chr(10))"
    e = f"replace({e}, chr(13), '')"
    e = f"regexp_replace({e}, ' +', ' ', 'g')"
    e = f"regexp_replace({e}, {lit(chr(10) + ' +')}, chr(10), 'g')"
    e = f"regexp_replace({e}, {lit(chr(10) + '+')}, chr(10) || chr(10), 'g')"
    return f"(CASE WHEN {h} IS NULL OR {h} = '' THEN '' ELSE {py_strip(e)} END)"


def email_domain(h: str) -> str:
    # quoted names and comments go, then everything from the first comma on
    bare = f"regexp_replace({h}, {lit(chr(92) * 2 + '.')}, '', 'g')"
    h = f"split_part(regexp_replace({bare}, {lit('"[^"]*"|[(][^()]*[)]')}, '', 'g'), ',', 1)"
    addr = f"(CASE WHEN regexp_matches({h}, '<[^<>]*>') THEN regexp_extract({h}, '<([^<>]*)>', 1) ELSE {py_strip(h)} END)"
    dom = f"lower({py_strip(f'split_part({addr}, chr(64), -1)')})"
    return f"(CASE WHEN {h} IS NULL THEN '' WHEN contains({addr}, chr(64)) THEN {dom} ELSE '' END)"


def consumer(d: str) -> str:
    return f"({d} IN {in_list(CONSUMER_DOMAINS)})"


def mismatch(fd: str, rd: str) -> str:
    return (f"(CASE WHEN {fd} <> '' AND {rd} <> '' AND {fd} <> {rd} AND NOT {consumer(fd)} AND {consumer(rd)} "
            f"THEN 1.0 ELSE 0.0 END)::DOUBLE")


def spf_feature(x: str, rs: str, ar: str) -> str:
    xs = f"lower({py_strip(x)})"
    v1 = f"(CASE WHEN {xs} IN {in_list(SPF_STATUS_WORDS)} THEN {xs} ELSE 'none' END)"
    first = lit("^" + WS + "*([a-zA-Z]+)")
    auth = lit(r"(?i)(?:^|[^\pL\pN_])spf" + WS + "*=" + WS + "*([a-zA-Z]+)")
    rsw = (f"list_filter(list_transform(coalesce({rs}, []::VARCHAR[]), lambda lam_h: lower(regexp_extract(lam_h, {first}, 1))), "
           f"lambda lam_w: lam_w IN {in_list(SPF_RESULT_WORDS)})[1]")
    arw = (f"list_filter(list_transform(coalesce({ar}, []::VARCHAR[]), lambda lam_h: lower(regexp_extract(lam_h, {auth}, 1))), "
           f"lambda lam_w: lam_w IN {in_list(SPF_RESULT_WORDS)})[1]")
    v2 = f"(CASE WHEN {v1} = 'none' THEN coalesce({rsw}, 'none') ELSE {v1} END)"
    v3 = f"(CASE WHEN {v2} = 'none' THEN coalesce({arw}, 'none') ELSE {v2} END)"
    return f"(CASE WHEN {v3} = 'pass' THEN 1.0 WHEN {v3} IN ('fail', 'softfail') THEN -1.0 ELSE 0.0 END)::DOUBLE"
