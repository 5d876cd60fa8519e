"""BPE transducer, token counts, packing: against the libraries, exact round trips, plans by brute force."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from llm_tables import docs, empty, odd  # noqa: F401

from mailsift.llm import bpe_transducer, packing, token_counts
from mailsift.llm.pretokens import Chunks, splitter

RANKS = "byte_bpe_multi_50k.tiktoken"
ALPHABET = "aeiou bcdf\n\t   　éüßñ'!?.,0123٣²Ⅷ日本語中文の한국مرحباпривет😀👩‍\x1c\x85#*"


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def codec():
    with open(public_tokenizers.path(RANKS), "rb") as f:
        return bpe_transducer.codec(f.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def gpt():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def random_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


def test_transducer_equals_library(docs, codec, library):
    for text in [r.text for r in docs.collect()] + random_texts(5000, 1):
        ids = codec.encode(text)
        assert ids == library.encode_ordinary(text)
        assert "".join(codec.decode_stream(ids, 3)) == text


def test_transducer_equals_plain_merges(codec):
    rnd, tokens = random.Random(2), list(codec.transducer.ranks)
    for _ in range(5000):
        piece = b"".join(rnd.choice(tokens) for _ in range(rnd.randint(2, 4)))
        want = codec.transducer.ranks.get(piece)
        want = (want,) if want is not None else tuple(codec.transducer.ranks[t] for t in bpe_transducer.merge(piece, codec.transducer.ranks))
        assert codec.transducer.encode(piece) == want


def test_feeding_in_any_cuts_and_bounded_lookahead(codec):
    t, rnd = codec.transducer, random.Random(3)
    tokens, longest = list(t.ranks), max(map(len, t.ranks))
    for _ in range(3000):
        piece = b"".join(rnd.choice(tokens) for _ in range(rnd.randint(2, 8)))
        out, state, at = [], None, 0
        while at < len(piece):
            n = rnd.randint(1, 6)
            sure, state = t.feed(piece[at:at + n], state)
            out += sure
            at += n
            assert len(state[1]) <= 2 * longest
        assert tuple(out + t.finish(state)) == t.encode(piece) or piece in t.ranks


def test_table_starts_afresh_when_full(monkeypatch, library):
    monkeypatch.setattr(bpe_transducer, "MOST_STATES", 20)
    with open(public_tokenizers.path(RANKS), "rb") as f:
        small = bpe_transducer.Codec(f.read(), public_tokenizers.PATTERN)
    for text in random_texts(500, 4):
        assert small.encode(text) == library.encode_ordinary(text)


def test_utf8_stream():
    text = "aé日😀"
    raw = text.encode()
    for step in (1, 2, 3, 5):
        s = bpe_transducer.Utf8Stream()
        assert "".join([s.feed(raw[i:i + step]) for i in range(0, len(raw), step)] + [s.finish()]) == text
    s = bpe_transducer.Utf8Stream()
    assert s.feed(b"a\xff\xe6\x97") + s.finish() == "a��"


def test_chunks_cut_as_the_whole_pattern_does():
    split = splitter(public_tokenizers.PATTERN)
    chunks = Chunks(split, split)
    for text in random_texts(20000, 5):
        got = [p for v in chunks(text) for p in ([v] if isinstance(v, str) else v)]
        assert got == split(text)


def test_round_trip_of_awkward_tables(spark, odd, empty, library):
    rows = odd.select("text", bpe_transducer.round_trip(spark).alias("r"), bpe_transducer.encode(spark).alias("e")).collect()
    assert len(rows) == odd.count()
    for r in rows:
        ids = library.encode_ordinary(r.text or "")
        assert r.e.ids == ids and r.r.n_tokens == len(ids)
        assert r.r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    coded = odd.select("doc_id", bpe_transducer.encode(spark).alias("e")).select("doc_id", "e.ids")
    assert sorted(r.text for r in bpe_transducer.decode(spark, coded).collect()) == sorted(t.text or "" for t in odd.collect())
    assert empty.select(bpe_transducer.round_trip(spark)).collect() == []


def test_counts_equal_library(spark, docs, odd, empty, gpt):
    for table in (docs, odd):
        want = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), len(gpt.encode(r.text or "", add_special_tokens=False).ids))
                      for r in table.collect())
        got = token_counts.count_tokens(table).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
        assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts.count_tokens(empty).collect() == []


def test_counts_without_the_broadcast_part(spark, docs, monkeypatch):
    want = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs).collect()}
    monkeypatch.setattr(token_counts, "HOT", 5)
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs).collect()} == want


def test_counts_of_odd_texts(spark, gpt):
    texts = random_texts(800, 6) + ["<|endoftext|>", "a <|endoftext|>  b<|endoftext|>", " <|endoftext|"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in token_counts.count_tokens(df).collect():
        assert r.n_tokens == len(gpt.encode(texts[r.doc_id], add_special_tokens=False).ids)


def check_packing(rows, texts, gpt, length=packing.LENGTH):
    """Every id once, sequences within the length and gapless, checksums right."""
    ids = [gpt.encode(t or "", add_special_tokens=False).ids + [1] for t in texts]
    want = sorted((len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids)
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= length
    assert sorted(sequences) == list(range(len(sequences)))
    return want, by_doc


def test_packing_keeps_every_id(spark, docs, gpt):
    rows = packing.pack(docs, with_ids=True).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    check_packing(rows, list(texts.values()), gpt)
    pieces = {}
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
    for i, t in texts.items():
        whole = np.array(gpt.encode(t, add_special_tokens=False).ids + [1], "<u4").tobytes()
        at = 0
        for start, raw in sorted(pieces[i]):
            assert start == at
            at += len(raw) // 4
        assert b"".join(raw for _, raw in sorted(pieces[i])) == whole
    total = sum(r.length for r in rows)
    assert max(r.sequence_id for r in rows) + 1 <= 1.01 * total / packing.LENGTH + 2


def test_packing_of_awkward_tables(spark, odd, empty, gpt):
    rows = packing.pack(odd).collect()
    check_packing(rows, [r.text for r in odd.collect()], gpt)
    n = sum(len(gpt.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
    assert sum(r.length for r in rows) == n
    assert packing.pack(empty).collect() == []


def test_packing_many_equal_rows(spark, gpt):
    df = spark.range(3000).selectExpr("id % 10 as doc_id", "'the same words in every row' as text")
    rows = packing.pack(df).collect()
    check_packing(rows, ["the same words in every row"] * 3000, gpt)
    assert max(r.sequence_id for r in rows) + 1 == -(-3000 * packing.UNIT // packing.LENGTH)  # 7 ids count as 8


def test_knapsack_matches_enumeration():
    rnd = np.random.default_rng(0)
    for _ in range(50):
        prices, room = rnd.random(4), int(rnd.integers(3, 12))
        best = 0
        for a in range(room + 1):
            for b in range(room // 2 + 1):
                for c in range(room // 3 + 1):
                    for d in range(room // 4 + 1):
                        if a + 2 * b + 3 * c + 4 * d <= room:
                            best = max(best, np.dot([a, b, c, d], prices))
        worth, pattern = packing.best_pattern(prices, np.full(4, 100), room)
        assert worth == pytest.approx(best) and pattern @ np.arange(1, 5) <= room


def test_plan_places_every_piece_and_is_tight():
    rnd = np.random.default_rng(1)
    for counts in (rnd.integers(0, 50, 32), np.eye(32, dtype=int)[31] * 7, np.zeros(32, int), np.eye(32, dtype=int)[17] * 999):
        made = packing.plan(counts, 32, 8)
        placed = np.zeros(32, int)
        for s, first, end, _, _ in made.rows:
            assert first == placed[s]
            placed[s] = end
        assert (placed == counts).all()
        units = int(counts @ np.arange(1, 33))
        assert made.sequences <= -(-units // 32) + 1
        filler = sum((e - f) * (s + 1) * 8 for s, f, e, _, q in made.rows if q < 0)
        assert filler <= (made.gaps[-1][1] if made.gaps else 0)


def _ranks():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def test_chunks_of_letters_and_signs_as_the_pattern_has_them():
    """Words cut without the pattern: contractions, signs, digits and marks inside and behind them."""
    import random

    import tiktoken
    from mailsift.llm import bpe_transducer as B

    raw, pattern = _ranks()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=B.read_ranks(raw), special_tokens={})
    codec, rng = B.Codec(raw, pattern), random.Random(11)
    parts = ["word", "don't", "it's", "s'", "'s", "x_y", "a1", "é", "日本", "²", "!!", "#$", "...", "’", "_", "Ünï", "é", "ⅷ", "\n", "end.\nNext"]
    for _ in range(3000):
        text = " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 6)))
        assert codec.encode(text) == library.encode_ordinary(text), text
    assert library.decode(codec.encode("word's end")) == "word's end"


def test_table_bound_holds_inside_one_pre_token(monkeypatch):
    """A pre-token that has more states than the table may hold: same ids, no more states."""
    import random

    import tiktoken
    from mailsift.llm import bpe_transducer as B

    raw, pattern = _ranks()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=B.read_ranks(raw), special_tokens={})
    monkeypatch.setattr(B, "MOST_STATES", 500)
    monkeypatch.setattr(B, "MOST_PAIRS", 1000)
    codec, rng = B.Codec(raw, pattern), random.Random(2)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(60_000))
    assert codec.encode(text) == library.encode_ordinary(text)
    assert len(codec.transducer.states) <= 500 and len(codec.transducer.apart) <= 1000


def test_long_texts_go_through_in_blocks(monkeypatch):
    """Texts and pre-tokens over the block sizes: blocks are bounded, ids and decoded bytes the library's."""
    import hashlib

    import tiktoken
    from mailsift.llm import bpe_transducer as B

    raw, pattern = _ranks()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=B.read_ranks(raw), special_tokens={})
    monkeypatch.setattr(B, "LONG_TEXT", 1000)
    monkeypatch.setattr(B, "BLOCK_PIECES", 50)
    codec = B.Codec(raw, pattern)
    for text in ("some words, and more 12 " * 400 + "x" * 20_000 + " 日本語" * 900, "é" * 9000, "=" * 30_000, "a b\n \n" * 500 + " "):
        blocks = list(codec.blocks(text))
        assert max(map(len, blocks)) <= max(B.BLOCK_BYTES, 50 * B.BLOCK_BYTES // 8)
        ids = library.encode_ordinary(text)
        assert [i for b in blocks for i in b] == ids
        n, ids_hash, text_hash = B.digests(lambda: codec)([text])
        assert n == [len(ids)] and ids_hash == [hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()]
        assert text_hash == [hashlib.sha256(text.encode()).hexdigest()]
