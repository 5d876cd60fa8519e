"""Native text expressions: URL reduction, URL domain, flat HTML to text.

All functions take and return ``Column``s and contain no Python UDF, so they run
in the JVM; those with lambdas are interpreted, outside whole-stage codegen.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    HTML_BLOCK_TAGS,
    HTML_ENTITIES,
    HTML_HIDDEN_TAGS,
    HTML_LEGACY_NAMES,
    URL_PATTERN,
    URL_TRAILING_PUNCT,
    WS_CHARS,
    WS_CLASS,
)

_PUNCT_CLASS = "[" + re.escape(URL_TRAILING_PUNCT).replace("\\ ", " ") + "]"
_TRAIL_PUNCT = _PUNCT_CLASS + r"*\z"
_TRAIL_PUNCT_PLUS = _PUNCT_CLASS + r"+\z"
_NETLOC = r"(?i)^https?://([^/?#]*)"


def _ipv6_pattern() -> str:
    """Textual IPv6 addresses as the standard library accepts them: eight 1-4
    digit hex groups, one '::' standing for at least one group, an optional
    dotted IPv4 tail worth two groups (no leading zeros), an optional '%zone'."""
    h = "[0-9a-fA-F]{1,4}"
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    v4 = octet + r"(?:\." + octet + "){3}"

    def groups(n: int) -> str:
        return "" if n == 0 else h + "(?::" + h + "){%d}" % (n - 1) if n > 1 else h

    forms = []
    for tail, width in (("", 8), (v4, 6)):
        sep = ":" if tail else ""
        forms.append(groups(width) + sep + tail)  # no compression
        for left in range(width):
            for right in range(width - left):
                if left + right > width - 1:
                    continue
                rhs = groups(right) + (sep if right and tail else "") + tail
                forms.append(groups(left) + "::" + rhs)
    return "^(?:" + "|".join(forms) + ")(?:%[^%]+)?$"


IPV6_PATTERN = _ipv6_pattern()
IPVFUTURE_PATTERN = r"^v[a-fA-F0-9]+\..+$"


def _nfkc_delimiters() -> str:
    """Non-ASCII characters whose NFKC form holds a URL delimiter (full-width
    '／', '℀' = "a/c", ...). The parser refuses a netloc containing one. Derived
    from the Unicode data of this Python; all of them lie in the BMP."""
    import unicodedata

    return "".join(chr(c) for c in range(0x80, 0x10000) if not 0xD800 <= c <= 0xDFFF
                   and any(d in unicodedata.normalize("NFKC", chr(c)) for d in "/?#@:"))


NFKC_DELIMITERS = _nfkc_delimiters()
NFKC_DELIMITER_CLASS = "[" + NFKC_DELIMITERS + "]"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _parser_refuses(netloc: Column) -> Column:
    """The stdlib URL parser raises for this netloc: a lone bracket, a
    bracketed host that is neither IPv6 nor IPvFuture (IPv4 included), or a
    character that NFKC normalisation turns into a delimiter."""
    has_l, has_r = netloc.contains("["), netloc.contains("]")
    bracketed = F.regexp_extract(netloc, r"^[^\[]*\[([^\]]*)", 1)
    valid = F.when(bracketed.startswith("v"), bracketed.rlike(IPVFUTURE_PATTERN)).otherwise(
        bracketed.rlike(IPV6_PATTERN))
    return (has_l != has_r) | (has_l & ~valid) | netloc.rlike(NFKC_DELIMITER_CLASS)


def _domain_from(base: Column, netloc: Column) -> Column:
    """Host up to the first ':' without a leading 'www.'; the URL itself when the
    netloc is empty, or when it starts with ':' (so the fallback host pattern
    finds nothing) and the parser refuses it."""
    host = F.regexp_replace(F.regexp_extract(netloc, r"^[^:]*", 0), r"(?i)^www\.", "")
    refused = netloc.startswith(":") & _parser_refuses(netloc)
    return F.when((netloc == "") | refused, base).otherwise(host)


def _domain_of(base: Column) -> Column:
    """Host of a URL with scheme: netloc up to the first ':', leading 'www.' dropped.

    An empty netloc, or one that starts with ':' and carries a bracket, gives
    the URL itself back. (Top-level use: Catalyst's subexpression elimination
    evaluates the shared netloc once.)
    """
    return _domain_from(base, F.regexp_extract(base, _NETLOC, 1))


def url_domain(url: Column | str) -> Column:
    """Domain of one URL (letter case kept)."""
    u = _col(url)
    return F.when(u.isNull(), F.lit(None)).otherwise(_domain_of(u))


def _reduced_urls(t: Column, vocab: Column | None = None) -> Column:
    """Reduced form of every URL in ``t``, in order.

    Lambdas get no common-subexpression elimination, so each intermediate
    (base/punct, then netloc) is computed once in its own ``transform`` stage
    and carried in a struct.
    """
    urls = F.regexp_extract_all(t, F.lit(URL_PATTERN), 0)
    split = F.transform(urls, lambda u: F.struct(F.regexp_replace(u, _TRAIL_PUNCT_PLUS, "").alias("b"),
                                                 F.regexp_extract(u, _TRAIL_PUNCT, 0).alias("p")))
    with_net = F.transform(split, lambda s: F.struct(s["b"].alias("b"), s["p"].alias("p"),
                                                     F.regexp_extract(s["b"], _NETLOC, 1).alias("n")))
    doms = F.transform(with_net, lambda s: F.struct(_domain_from(s["b"], s["n"]).alias("d"), s["p"].alias("p")))
    if vocab is None:
        return F.transform(doms, lambda s: F.concat(s["d"], s["p"]))
    return F.transform(doms, lambda s: F.concat(
        F.when(F.array_contains(vocab, s["d"]), F.concat(F.lit("[DOM_"), s["d"], F.lit("]"))).otherwise(s["d"]),
        s["p"]))


def strip_urls(text: Column | str, vocab: Column | None = None) -> Column:
    """Replace every http(s) URL in ``text`` by its domain.

    Trailing ``.,!?;*-`` are cut off each match and put back after the domain.
    With ``vocab`` (an array<string> column or literal) a domain found in it is
    written as the single token ``[DOM_<domain>]`` (X16). The text pieces
    between URLs and the reduced URLs are zipped once (linear in the number of
    URLs), then joined.
    """
    t = _col(text)
    parts = F.split(t, URL_PATTERN, -1)
    zipped = F.arrays_zip(parts, _reduced_urls(t, vocab))
    joined = F.array_join(F.transform(zipped, lambda z: F.concat(z["0"], F.coalesce(z["1"], F.lit("")))), "")
    return F.when(t.isNull(), F.lit(None)).otherwise(joined)


def url_domains(text: Column | str) -> Column:
    """Domains of all URLs in ``text`` (array<string>), used for vocabularies."""
    t = _col(text)
    urls = F.regexp_extract_all(t, F.lit(URL_PATTERN), 0)
    bases = F.transform(urls, lambda u: F.regexp_replace(u, _TRAIL_PUNCT_PLUS, ""))
    nets = F.transform(bases, lambda b: F.struct(b.alias("b"), F.regexp_extract(b, _NETLOC, 1).alias("n")))
    return F.transform(nets, lambda s: _domain_from(s["b"], s["n"]))


def links_count(text: Column | str) -> Column:
    """Number of http(s) URLs in ``text`` (X15 ``links_count``)."""
    return F.size(F.regexp_extract_all(_col(text), F.lit(URL_PATTERN), 0))


def py_strip(text: Column | str) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace
    (a character-set trim, no regex)."""
    return F.btrim(_col(text), F.lit(WS_CHARS))


# The characters of WS_CLASS for Java alone: those of Latin-1 one by one, which it looks up in a table, and the others
# behind one comparison, so a letter costs two tests rather than one a range.
WS_RUN = (r"[[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0][\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}"
          r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]+")


def collapse_ws(text: Column | str) -> Column:
    """Every run of (Python) whitespace becomes one space."""
    return F.regexp_replace(_col(text), WS_RUN, " ")


def combined_text(subject: Column | str, body: Column | str) -> Column:
    """The text that is embedded, identical for training and scoring."""
    return F.concat(
        F.lit("Subject: "), F.coalesce(_col(subject), F.lit("")), F.lit("\n"), F.coalesce(_col(body), F.lit(""))
    )


def _hidden_pattern(tags: Sequence[str]) -> str:
    # '<' is factored out so each text position costs one comparison
    alts = ["!--.*?-->"] + [rf"{t}\b[^>]*>.*?</{t}\s*>" for t in tags]
    return "(?is)<(?:" + "|".join(alts) + ")"


HTML_DROP_PATTERN = _hidden_pattern(HTML_HIDDEN_TAGS)
HTML_DECL_PATTERN = r"<![^>]*>|<\?[^>]*>"
HTML_BREAK_PATTERN = r"(?i)<br\b[^>]*>|</(?:" + "|".join(HTML_BLOCK_TAGS) + r")\s*>|<(?:" + "|".join(
    HTML_BLOCK_TAGS
) + r")\b[^>]*/>"
HTML_TAG_PATTERN = r"</?[a-zA-Z][^>]*>"


def collapse_breaks(text: Column) -> Column:
    """The whitespace clean-up after tag removal (shared by X1 and X1b)."""
    t = F.regexp_replace(text, r"\\n", "\n")
    t = F.regexp_replace(t, "\r", "")
    t = F.regexp_replace(t, " {2,}", " ")  # same as " +" → " ", without rewriting single spaces
    t = F.regexp_replace(t, "\n +", "\n")
    t = F.regexp_replace(t, "\n+", "\n\n")
    return py_strip(t)


# A legacy reference without ';' ("&amp<", "&copy 2"): the character after the name
# ends it. Writing the ';' in (on the raw HTML, where that character is still the
# one the HTML parser sees) lets the ordinary decoding below handle it. The
# terminator is consumed by each match, so a second pass catches back-to-back
# references.
HTML_LEGACY_PATTERN = "&(" + "|".join(HTML_LEGACY_NAMES) + ")([^-.a-zA-Z0-9;])"


def html_to_text_flat(html: Column | str) -> Column:
    """All-native HTML to text.

    Legacy references get their ';', then comments and script/style/template/
    rt/rp bodies go (script bodies may hold tag-like strings), then
    declarations; a line break is put at every ``<br>`` and every closing
    ``p/div/li/tr`` tag; remaining tags are removed, a fixed list of entities is
    decoded and the breaks are collapsed. Differs from the tree form (X1) only
    for unclosed or mis-nested block elements and entities outside the list.
    """
    h = _col(html)
    t = F.regexp_replace(h, HTML_LEGACY_PATTERN, "&$1;$2")
    t = F.regexp_replace(t, HTML_LEGACY_PATTERN, "&$1;$2")
    t = F.regexp_replace(t, HTML_DROP_PATTERN, "")
    t = F.regexp_replace(t, HTML_DECL_PATTERN, "")
    t = F.regexp_replace(t, HTML_BREAK_PATTERN, "\n")
    t = F.regexp_replace(t, HTML_TAG_PATTERN, "")
    for ent, ch in HTML_ENTITIES:
        t = F.replace(t, F.lit(ent), F.lit(ch))
    out = collapse_breaks(t)
    return F.when(h.isNull() | (h == ""), F.lit("")).otherwise(out)
