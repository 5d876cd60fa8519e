"""Secret scans: fixed patterns, and random strings told by their tokens.

A byte-pair vocabulary has long tokens for what people write and short ones for what they don't: a string that
needs many tokens for its length is random. Candidates are long unbroken runs with letters; digests of known lengths,
UUIDs and names made of words are left out, of all others the ratio decides.
"""

from __future__ import annotations

import base64
import re

import tiktoken
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from mailsift.llm.common import Memo, text_udf

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Every HEX match of 24 characters, found faster: runs are maximal, so shorter ones can't hide longer ones.
LONG_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
MIN_ASSIGNED, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: Token-efficiency test: candidates of at least MIN_RUN characters with under MAX_RATIO characters a token.
MIN_RUN, MAX_RATIO = 20, 2.2
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Hex digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512), whole.
DIGEST = re.compile(r"(?i)(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})\Z")
UUID = re.compile(r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\Z")
#: Parts of a run: letters in one case or capitalised, and numbers.
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
#: A part is a word from so many letters, with so many letters a token; letters of fewer are a short part.
WORD_LETTERS = 3
RESULT = "n_assign bigint, n_access bigint, n_hex bigint, n_token bigint, base_spans string, spans string"
MASK = "[SECRET]"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost non-overlapping per kind, by start and kind."""
    low = text.lower()
    found = []
    if any(w in low for w in ("passw", "secret", "token", "api")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
    return sorted(found)


def named(run: str, n_tokens) -> bool:
    """Whether a run is a name made of words: they hold most of its letters and digits, and short parts are no more than
    words. Linear in the run."""
    parts = PARTS.findall(run)
    letters = [p.lower() for p in parts if p.isalpha()]
    words = [p for p in letters if len(p) >= WORD_LETTERS
             and len(p) >= WORD_LETTERS * min(n_tokens(p), n_tokens(" " + p))]
    return 2 * sum(map(len, words)) > sum(map(len, parts)) and sum(len(p) < WORD_LETTERS for p in letters) <= len(words)


def random_spans(text: str, n_tokens, known: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of kind ``token``: runs that the vocabulary needs many tokens for, each as far as it lies between the known
    spans."""
    out, at = [], 0
    for a, _, b in [*known, (len(text), 3, len(text))]:
        for m in RUN.finditer(text, at, max(at, a)):
            run = m[0]
            if not any(map(str.isalpha, run)) or DIGEST.match(run) or UUID.match(run) or len(set(run)) < 8:
                continue
            if len(run) < MAX_RATIO * n_tokens(run) and not named(run, n_tokens):
                out.append((m.start(), 3, m.end()))
        at = max(at, b)
    return out


def encoding(raw: bytes, pattern: str) -> tiktoken.Encoding:
    """An encoding from the content of a rank file."""
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scanner(raw: bytes, pattern: str):
    """A function from texts to the columns of ``RESULT``."""
    enc = encoding(raw, pattern)
    count = Memo(lambda run: len(enc.encode_ordinary(run)), most=20_000)

    def work(texts):
        rows = []
        for text in texts:
            base = base_spans(text or "")
            more = random_spans(text or "", count.__getitem__, base)
            kinds = [k for _, k, _ in base]
            rows.append((kinds.count(0), kinds.count(1), kinds.count(2), len(more), listed(base), listed(sorted(base + more))))
        return list(zip(*rows, strict=True))

    return work


def masker(raw: bytes, pattern: str):
    """A function from texts to (text with every span replaced by ``MASK``, number of spans)."""
    enc = encoding(raw, pattern)
    count = Memo(lambda run: len(enc.encode_ordinary(run)), most=20_000)

    def work(texts):
        out, n = [], []
        for text in texts:
            base = base_spans(text or "")
            spans = sorted(base + random_spans(text or "", count.__getitem__, base))
            n.append(len(spans))
            parts, at = [], 0
            for s, _, e in spans:
                if s >= at:
                    parts += [text[at:s], MASK]
                at = max(at, e)
            out.append(text if text is None else "".join([*parts, text[at:]]))
        return [out, n]

    return work


def _vocabulary(path: str | None, pattern: str | None) -> tuple[bytes, str]:
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), pattern or public_tokenizers.PATTERN


def scan(spark: SparkSession, text: Column | str = "text", path: str | None = None, pattern: str | None = None) -> Column:
    """The struct ``RESULT`` of a text column: counts by kind, the spans of the fixed patterns and all spans, as
    ``kind:start:end`` in code points, end exclusive, by start and then kind, comma-joined.

    Null and empty texts have no spans (counts 0, empty strings). The rank file (under 1 MB) is read on the driver
    and broadcast.
    """
    shared = spark.sparkContext.broadcast(_vocabulary(path, pattern))
    return text_udf(lambda: scanner(*shared.value), RESULT, text)


def mask(spark: SparkSession, text: Column | str = "text", path: str | None = None, pattern: str | None = None) -> Column:
    """The struct (text, n_spans): the text with every span replaced by ``MASK``; overlapping spans share one. Null stays."""
    shared = spark.sparkContext.broadcast(_vocabulary(path, pattern))
    return text_udf(lambda: masker(*shared.value), "text string, n_spans bigint", text)
