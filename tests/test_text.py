"""URL reduction (X2), URL domain (X3): fixture cases and a differential test
against a plain-Python statement of the rule."""

import random
import re
import urllib.parse

import pytest

from conftest import one_col
from mailsift.functions.text import strip_urls, url_domain

CASES = [
    ("see http://www.Ex.com/a?b=1, ok", "see Ex.com, ok"),
    ("HTTPS://user:pw@h.com/x.", "user."),
    ("http://user@host/p http://-", "user@host http://-"),
    ("http://... http://www. http://www./x http://:80/y http://[::1]/z http://[bad/q",
     "http://... www.   [ [bad"),
    ("a https://WWW.a.b:8080?x#y!!! (http://c.d) <http://e.f>", "a a.b!!! (c.d) <e.f>"),
    ("http://x.y?", "x.y?"),
    ("http://x.y/?.", "x.y?."),
    ("https://https://q.r", "https"),
    ("xhttp://in.word-", "xin.word-"),
    ("http://::1]x y", "http://::1]x y"),
    ("http://a.b/x c", "a.b c"),
    ("", ""),
    ("no urls here", "no urls here"),
]


def test_strip_urls_cases(spark):
    got = one_col(spark, [c[0] for c in CASES], strip_urls)
    assert got == [c[1] for c in CASES]


def test_strip_urls_null(spark):
    assert one_col(spark, [None], strip_urls) == [None]


# --- plain-Python statement of the rule (test oracle) ---------------------------
_URL = re.compile(r"https?://[^\s<>\"'()]+", re.IGNORECASE)


def _parses(url):
    try:
        return bool(urllib.parse.urlsplit(url)) or True
    except ValueError:
        return False


def _host(url):
    """scheme "://" authority; the authority ends at a path, query or fragment, the host at a port."""
    authority = re.split("[/?#]", url.partition("://")[2], maxsplit=1)[0]
    host, port_sign, _ = authority.partition(":")
    if not host and not (port_sign and _parses(url)):
        return url  # nothing to call a host
    return re.sub(r"(?i)\Awww\.", "", host)


def _reduce(text):
    def sub(m):
        u = m.group(0)
        base = u.rstrip(".,!?;*-")
        return _host(base) + u[len(base):]

    return _URL.sub(sub, text)


PIECES = ["http://", "https://", "HTTP://", "www.", "WWW.", "a", "b.c", "xy", ".", ",", "!", "?", ";", "*", "-",
          ":", "/", "#", "@", "[", "]", " ", " ", " ", "\x1c", "\n", "é", "(", ")", "<", ">", '"', "'",
          "x:80", "\\", "$1", "=", "&", "::1", "[::]", "v1.x", "%z", "1.2.3.4", "ffff", "＃", "：", "℀", "﹫", "ｗ"]


def test_strip_urls_differential(spark):
    rnd = random.Random(7)
    texts = []
    while len(texts) < 6000:
        t = "".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 14)))
        texts.append(t)
    got = one_col(spark, texts, strip_urls)
    bad = [(t, g, _reduce(t)) for t, g in zip(texts, got) if g != _reduce(t)]
    assert not bad[:5], bad[:5]


@pytest.mark.parametrize("url,dom", [
    ("http://www.Example.com/x", "Example.com"),
    ("https://user:pw@h.com/", "user"),
    ("http://:80/y", ""),
    ("http:///x", "http:///x"),
    ("https://m.x.example.net/en/25#top", "m.x.example.net"),
])
def test_url_domain(spark, url, dom):
    assert one_col(spark, [url], url_domain) == [dom]


@pytest.mark.parametrize("url,dom", [
    ("http://:[::1]/z", ""),            # valid bracketed IPv6 after ':' parses: empty host
    ("http://:[1.2.3.4]/z", "http://:[1.2.3.4]/z"),  # IPv4 in brackets is refused
    ("http://:[vF.x]/z", ""),           # IPvFuture
    ("http://:[zz]/z", "http://:[zz]/z"),
    ("http://:[fe80::1%eth0]:80/", ""),
])
def test_url_domain_bracketed_after_colon(spark, url, dom):
    assert one_col(spark, [url], url_domain) == [dom]
    assert _host(url) == dom


def test_sql_statement_of_the_rule_agrees_on_random_texts(spark):
    """The DuckDB fragments used as oracles state the same rule (checked on adversarial text)."""
    import duckdb

    from mailsift.plans import oracle as O

    rnd = random.Random(23)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 14))) for _ in range(1500)]
    con = duckdb.connect()
    con.execute("CREATE TABLE t (i INTEGER, s VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", list(enumerate(texts)))
    sql = dict(con.execute(f"SELECT i, {O.strip_urls('s')} FROM t").fetchall())
    assert [sql[i] for i in range(len(texts))] == one_col(spark, texts, strip_urls)


def test_mark_domains_differential(spark):
    """Vocabulary domains become [DOM_<domain>], others their domain (plain statement vs native)."""
    from pyspark.sql import functions as F

    rnd = random.Random(29)
    texts = ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(1, 12))) for _ in range(1500)]
    vocab = ["a", "b.c", "xy", "www", "https"]

    def mark(text):
        def sub(m):
            u = m.group(0)
            base = u.rstrip(".,!?;*-")
            d = _host(base)
            return (f"[DOM_{d}]" if d in vocab else d) + u[len(base):]

        return _URL.sub(sub, text)

    got = one_col(spark, texts, lambda c: strip_urls(c, F.array(*[F.lit(v) for v in vocab])))
    bad = [(t, g, mark(t)) for t, g in zip(texts, got) if g != mark(t)]
    assert not bad[:5], bad[:5]
