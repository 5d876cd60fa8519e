"""Quality rules: Jensen-Shannon distance of a document to references of its languages.

References are learned from the corpus itself: for every value of ``lang``, the distribution of
character classes and of its most common words, counted over all labelled documents. A document is
kept when its length passes the base rules and both its histograms lie near those of at least one
language. Texts too short for a histogram to mean anything are not judged by it (the guards below).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsift.llm.common import Memo, held, slices, text_udf

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS, MAX_REPEATED_PERCENT = 10, 20
#: Common words held per language, and what surrounds a word without being part of it.
TOP_WORDS = 32
EDGES = ".,;:!?\"'()[]{}«»„“”…#*$%&|<>-"
#: A histogram is judged from so many characters or words on; below, it passes.
MIN_CHARS_JUDGED, MIN_WORDS_JUDGED = 200, 40
#: Largest Jensen-Shannon distances (base 2, 0 to 1) to the nearest language.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.25, 0.385
#: A task flushes its word counts at so many distinct words.
MOST_WORDS = 100_000
#: Bytes of text looked at at a time, and words whose place among the common ones a task remembers.
TEXT_BYTES, MEMO_WORDS = 1 << 20, 30_000

CLASSES = ("lower", "upper", "letter", "digit", "space", "point", "symbol", "other")
RESULT = ("n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
          "base_failed boolean, kept boolean, char_distance double, word_distance double, nearest_lang string")


def class_table() -> np.ndarray:
    """The character class of every code point."""
    table = np.full(0x110000, CLASSES.index("other"), np.uint8)
    for c in range(0x30000):
        ch = chr(c)
        if ch.isalpha():
            table[c] = 0 if ch.islower() else 1 if ch.isupper() else 2
        elif ch.isdigit():
            table[c] = 3
        elif ch.isspace():
            table[c] = 4
        elif ch in ".,;:!?\"'()-":
            table[c] = 5
        elif ch in "#*$%&|<>@^~=+_\\/{}[]`":
            table[c] = 6
    return table


def char_counts(text: str) -> np.ndarray:
    """Characters of each class."""
    table = held(("quality classes",), class_table)
    return np.bincount(table[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)], minlength=len(CLASSES))


def plain_word(word: bytes) -> str:
    """A word without its edges, in lower case."""
    return word.decode("utf-8", "replace").strip(EDGES).lower()


def repeated_words(words: list[bytes], width: int = WINDOW) -> int:
    """Words inside windows of ``width`` words that occur at least twice, first occurrences included."""
    windows = list(zip(*(words[k:] for k in range(width)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    often = Counter(windows)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered += i + width - max(i, end)
            end = i + width
    return covered


def base_counts(text: str | None) -> tuple[list[bytes], tuple[int, int, int, int, int]]:
    """The words of a text, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return words, (len(words), len(text) - (len(raw) - len(raw.translate(None, SPACES))),
                   len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words))


@dataclass(frozen=True)
class References:
    """Per language: share of each character class, common words, and their shares with the rest last."""

    langs: tuple[str, ...]
    chars: np.ndarray
    words: tuple[tuple[str, ...], ...]
    word_shares: tuple[np.ndarray, ...]


def _partial_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, key, n): character classes and words of a task's documents."""
    chars: dict[str, np.ndarray] = {}
    words: dict[str, Counter] = {}

    def rows():
        out = [(lang, "char", CLASSES[i], int(n)) for lang, c in chars.items() for i, n in enumerate(c) if n]
        for lang, counts in words.items():
            plain: Counter = Counter()
            for w, n in counts.items():
                plain[plain_word(w)] += n
            out += [(lang, "word", w, n) for w, n in plain.items() if w]
            out.append((lang, "words", "", sum(counts.values())))
        chars.clear(), words.clear()
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["lang", "kind", "key", "n"])

    for batch in batches:
        texts = batch.column("text")
        for lo, hi in slices(texts, TEXT_BYTES):
            for lang, text in zip(batch.column("lang").slice(lo, hi - lo).to_pylist(),
                                  texts.slice(lo, hi - lo).to_pylist(), strict=True):
                chars[lang] = chars.get(lang, 0) + char_counts(text)
                words.setdefault(lang, Counter()).update(text.encode("utf-8", "replace").split())
            if sum(map(len, words.values())) > MOST_WORDS:
                yield rows()
    if chars:
        yield rows()
    pa.default_memory_pool().release_unused()  # the worker lives on


def learn_references(docs: DataFrame, lang: str = "lang", text: str = "text", top: int = TOP_WORDS) -> References:
    """Reference histograms of every language in ``docs``, counted over all rows with a text and a lang.

    Words are counted map-side per task and summed by Spark; what reaches the driver is ``top`` words and the
    character classes of each language. Ties between words go to the smaller word.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    counts = rows.mapInArrow(_partial_counts, "lang string, kind string, key string, n bigint").groupBy(
        "lang", "kind", "key").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "key"))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= top).collect()
    langs = tuple(sorted({r.lang for r in best}))
    chars = np.zeros((len(langs), len(CLASSES)))
    words, shares = [], []
    for i, name in enumerate(langs):
        own = [r for r in best if r.lang == name]
        for r in own:
            if r.kind == "char":
                chars[i, CLASSES.index(r.key)] = r.n
        common = sorted((r for r in own if r.kind == "word"), key=lambda r: r.rank)
        total = max(1, sum(r.n for r in own if r.kind == "words"))
        share = np.array([r.n / total for r in common])
        words.append(tuple(r.key for r in common))
        shares.append(np.append(share, max(0.0, 1 - share.sum())))
    chars /= np.maximum(chars.sum(axis=1, keepdims=True), 1)
    return References(langs, chars, tuple(words), tuple(shares))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (root of the divergence, base 2) along the last axis."""
    m = (p + q) / 2

    def part(a):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / m), 0.0).sum(axis=-1)

    return np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))


def judge(refs: References):
    """A function from texts to the columns of ``RESULT``."""
    code = {w: i + 1 for i, w in enumerate(sorted({w for ws in refs.words for w in ws}))}
    memo = Memo(lambda w: code.get(plain_word(w), 0), MEMO_WORDS)
    places = [np.array([code[w] for w in ws], np.int64) for ws in refs.words]

    def work(texts):
        base, chars, words = [], [], []
        for text in texts:
            ws, counts = base_counts(text)
            base.append(counts)
            chars.append(char_counts(text or ""))
            words.append(np.bincount(np.fromiter(map(memo.__getitem__, ws), np.int64, len(ws)),
                                     minlength=len(code) + 1))
        n = np.array(base, np.int64).reshape(-1, 5)
        chars, words = np.array(chars, float), np.array(words, float)
        n_chars, n_words = chars.sum(axis=1), n[:, 0]
        failed = (n_words < MIN_WORDS) | (100 * n[:, 4] > MAX_REPEATED_PERCENT * n_words)
        if not refs.langs:
            none = [None] * len(texts)
            return [*n.T, failed, ~failed, none, none, none]
        p = chars / np.maximum(n_chars, 1)[:, None]
        dc = np.stack([js_distance(p, r) for r in refs.chars], axis=1)
        q = words / np.maximum(n_words, 1)[:, None]
        dw = []
        for at, share in zip(places, refs.word_shares, strict=True):
            own = q[:, at]
            dw.append(js_distance(np.column_stack([own, np.clip(1 - own.sum(axis=1), 0, 1)]), share))
        dw = np.stack(dw, axis=1)
        dc[n_chars < MIN_CHARS_JUDGED] = 0
        dw[n_words < MIN_WORDS_JUDGED] = 0
        near = (dc / MAX_CHAR_DISTANCE + dw / MAX_WORD_DISTANCE).argmin(axis=1)
        fits = ((dc <= MAX_CHAR_DISTANCE) & (dw <= MAX_WORD_DISTANCE)).any(axis=1)
        at = np.arange(len(texts))
        return [*n.T, failed, fits & ~failed, dc[at, near], dw[at, near], [refs.langs[i] for i in near]]

    return work


def quality(refs: References, text: Column | str = "text", repeatable: bool = True) -> Column:
    """The struct ``RESULT`` of a text column.

    Null and empty texts have no words: they fail the base rule and are not kept. Without any reference
    (an empty table, no languages) only the base rules decide and the distances are null. Equal texts get
    equal results, however often they occur.
    """
    return text_udf(lambda: judge(refs), RESULT, text, repeatable, TEXT_BYTES)


def quality_rules(docs: DataFrame, refs: References | None = None, id_col: str = "doc_id", text: str = "text",
                  lang: str = "lang") -> DataFrame:
    """One row per document: its id and the columns of ``RESULT``. Other columns of ``docs`` don't matter."""
    refs = refs or learn_references(docs, lang, text)
    return docs.select(F.col(id_col), quality(refs, text).alias("__q")).select(id_col, "__q.*")
