"""Fixed values that must equal the reference behaviour for identical results.

Everything here is data (word lists, patterns, formats, defaults), not logic.
"""

from __future__ import annotations

# --- fixed values: large free-mail ("consumer") providers -------------------
# A Reply-To on one of these while From is on another (private) domain is the
# mismatch signal. Kept verbatim, in the reference's order.
CONSUMER_DOMAINS = (
    "gmail.com",
    "outlook.com",
    "hotmail.com",
    "yahoo.com",
    "yahoo.fr",
    "yandex.ru",
    "icloud.com",
    "me.com",
    "mac.com",
    "protonmail.com",
    "proton.me",
    "pm.me",
    "protonmail.ch",
    "zoho.com",
    "aol.com",
    "gmx.com",
    "gmx.de",
    "mail.com",
    "fastmail.com",
    "tutanota.com",
)

# --- fixed values: charset aliases the stdlib codec lookup may miss ---------
CHARSET_ALIASES = {
    "cp-850": "cp850",
    "cp850": "cp850",
    "ibm850": "cp850",
    "ibm-850": "cp850",
    "iso-8859-14": "iso8859-14",
    "iso_8859-14": "iso8859-14",
    "iso-8859-10": "iso8859-10",
    "iso_8859-10": "iso8859-10",
}
DEFAULT_CHARSET = "utf-8"
FALLBACK_CHARSET = "latin-1"

# --- fixed values: whitespace --------------------------------------------------
# The code points Python's str.isspace() / re "\s" accept, written as a regex
# character-class body that Java regex (Spark) and RE2 (DuckDB) both read the
# same way.
WS_CLASS = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)

# The same code points as a plain string (for character-set trims).
WS_CHARS = (
    "".join(chr(c) for c in range(0x09, 0x0E)) + "".join(chr(c) for c in range(0x1C, 0x21)) + "\x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: URL reduction ---------------------------------------------
# A URL is "http(s)://" followed by anything but whitespace, <, >, ", ', ( or ).
URL_PATTERN = r"(?i)https?://[^<>\"'()" + WS_CLASS + r"]+"
# Characters cut off the end of a matched URL and re-appended after the domain.
URL_TRAILING_PUNCT = ".,!?;*-"

# --- fixed values: HTML to text ------------------------------------------------
# Elements followed by a line-break marker (besides <br>).
HTML_BLOCK_TAGS = ("p", "div", "li", "tr")
# Elements whose text never reaches the extracted text.
HTML_HIDDEN_TAGS = ("script", "style", "template", "rt", "rp")
# Entities decoded by the all-native HTML variant (declared approximation;
# '&amp;' must come last).
HTML_ENTITIES = (
    ("&nbsp;", "\u00a0"),
    ("&copy;", "©"),
    ("&middot;", "·"),
    ("&reg;", "®"),
    ("&hellip;", "…"),
    ("&mdash;", "—"),
    ("&ndash;", "–"),
    ("&laquo;", "«"),
    ("&raquo;", "»"),
    ("&euro;", "€"),
    ("&quot;", '"'),
    ("&#34;", '"'),
    ("&apos;", "'"),
    ("&#39;", "'"),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&amp;", "&"),
)

# Those of the above that HTML also accepts without the ';' (legacy names),
# when the next character cannot continue a name.
HTML_LEGACY_NAMES = ("nbsp", "copy", "middot", "reg", "laquo", "raquo", "quot", "lt", "gt", "amp")

# --- fixed values: model / scoring defaults ------------------------------------
DEFAULT_EMBEDDING_DIM = 384
DEFAULT_EMBEDDING_MODEL = "sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2"
MAX_TOKENS = 512
DEFAULT_THRESHOLD = 0.50
FALLBACK_SCORE_TEXT = "0.5000"
LR_MAX_ITER = 1000
LR_C = 1.0
POOL_EPS = 1e-9

# --- fixed values: verdict output formats --------------------------------------
# (each %s receives text: numbers are printed beforehand with four decimals)
STATUS_HEADER_FMT = "X-Spam-Status: %s, score=%s, threshold=%s\n"
SCORE_HEADER_FMT = "X-Spam-Score: %s\n"
ERROR_STATUS_FMT = 'X-Spam-Status: Error, score=0.0000, threshold=%s, error="%s"\n'
ERROR_SCORE_HEADER = "X-Spam-Score: 0.0000\n"
SPAM_FOLDER = "spam"
HAM_FOLDER = "ham"

# --- fixed values: SPF verdict words --------------------------------------------
SPF_STATUS_WORDS = ("pass", "fail", "softfail", "neutral", "none")
SPF_RESULT_WORDS = ("pass", "fail", "softfail", "neutral", "none", "temperror", "permerror")
