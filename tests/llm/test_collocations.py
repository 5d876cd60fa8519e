"""Operator 12: phrases against counts in plain Python."""

import re
from collections import Counter

from llm_tables import docs, empty, odd  # noqa: F401

import mailsift.llm.collocations as C
from mailsift.llm.collocations import collocations, phrase_counts


def brute(rows, least=30, covered=80, top=2000):
    f, n, out = {}, Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    f.setdefault(lang, Counter())[tuple(words[i:i + k])] += 1
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            score, _, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and any(q[i:i + len(p)] == p for i in range(len(q))) and 100 * b >= covered * a
                         for q, b in candidates.items())
            if not inside:
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def found(rows, **more):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in collocations(rows, **more).collect())


ROWS = ([("New York is big, new\tYork is  old; NEW YORK\nis new york", "en")] * 12 + [("a a a a a a", "en")] * 9
        + [("É É x. É É x", "fr")] * 5 + [("z y", None), (None, "en"), ("", None), (" \t ", "de"), (".;!", "de")] * 6
        + [("the cat sat on the mat and the cat sat on the rug", "en")] * 20 + [("über über alles\x0bso so\x0cso", "de")] * 7)


def test_small_counts(spark):
    rows = spark.createDataFrame(ROWS, "text string, lang string").withColumnsRenamed({}).selectExpr(
        "*", "1 AS n", "2 AS phrase", "3 AS w1", "4 AS k", "5 AS pair")
    for least, covered, top in ((30, 80, 2000), (3, 80, 2000), (1, 50, 4), (5, 100, 7)):
        assert found(rows, least=least, covered=covered, top=top) == brute(ROWS, least, covered, top)


def test_odd_and_empty_tables(odd, empty):
    rows = [(r.text, r.lang) for r in odd.collect()]
    assert found(odd, least=2) == brute(rows, 2)
    assert found(empty) == []


def test_test_table(docs):
    rows = [(r.text, r.lang) for r in docs.collect()]
    assert found(docs, least=5) == brute(rows, 5)


def test_full_bit_table_changes_nothing(spark, monkeypatch):
    """Every mark set: windows are as long as can be, counts the same."""
    rows = spark.createDataFrame(ROWS, "text string, lang string")
    expected = phrase_counts(rows, least=4).orderBy("lang", "w1", "w2", "w3", "w4", "k").collect()
    monkeypatch.setattr(C, "_bit_table", lambda pairs, least: b"\xff" * 8192)
    assert phrase_counts(rows, least=4).orderBy("lang", "w1", "w2", "w3", "w4", "k").collect() == expected


def test_words_with_one_hash(monkeypatch):
    """Two words of a batch that share a hash are still two words."""
    import pyarrow as pa

    monkeypatch.setattr(C.xxhash, "xxh3_64_intdigest", lambda w: 99)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": ["b a b. a a"]})

    class Bits:
        value = b"\xff" * 8192

    counted = Counter()
    for out in C._windows(Bits)(iter([batch])):
        for row in out.to_pylist():
            counted[row["w1"], row["w2"], row["w3"], row["w4"]] += row["n"]
    assert counted == {("b", "a", "b", None): 1, ("a", "b", None, None): 1, ("b", None, None, None): 1, ("a", "a", None, None): 1,
                       ("a", None, None, None): 1}


def test_decimal_products():
    """Counts near 2**62 leave the range of 64 bits in the score's product."""
    assert 2000000 * (1 << 62) // (1 << 63) == 1000000


def test_large_counts_stay_exact(spark, monkeypatch):
    """Scores of counts whose products pass 64 bits."""
    a, one, two = 1 << 58, (1 << 59) + 7, (1 << 60) + 3
    counts = spark.createDataFrame(
        [("en", "x", "y", None, None, 2, a), ("en", "x", None, None, None, 1, one), ("en", "y", None, None, None, 1, two),
         ("en", None, None, None, None, 0, one + two)], "lang string, w1 string, w2 string, w3 string, w4 string, k int, f bigint")
    monkeypatch.setattr(C, "phrase_counts", lambda *x: counts)
    docs = spark.createDataFrame([], "text string, lang string")
    assert found(docs) == [("en", 1, "x y", a, one, two, one + two, 2000000 * a // (one + two))]
