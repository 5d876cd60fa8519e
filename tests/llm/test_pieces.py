"""Operator 11: pieces, spans and decoding against the sentencepiece library."""

import hashlib
import random
import struct

import pytest
import sentencepiece
from llm_tables import ODD, docs, empty, odd  # noqa: F401

import public_tokenizers
from mailsift.llm import piece_codec
from mailsift.llm.piece_codec import Model, PieceCodec, normalise

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def raw():
    with open(PATH, "rb") as f:
        return f.read()


def _varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number, value):
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _model(pieces, rules=b"", byte_fallback=False):
    """A small BPE model: (piece, score, kind) and the normaliser's message."""
    out = b"".join(_field(1, _field(1, p.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", s) + _field(3, k)) for p, s, k in pieces)
    return out + _field(2, _field(3, 2) + _field(35, int(byte_fallback))) + _field(3, rules)


def _same(codec, library, text):
    ids, ends = codec.encode(text)
    found = library.encode(text, return_type="proto").pieces
    assert ids == [p.id for p in found], text
    assert ends.tolist() == [p.end for p in found], text
    assert [0, *ends[:-1].tolist()][:len(ids)] == [p.begin for p in found] or codec.model.trim, text
    assert codec.decode(ids) == library.decode(ids), text


def _strings(alphabet, n, most=60):
    rng = random.Random(7)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(most))) for _ in range(n)]


def test_ids_spans_and_text_as_the_library(raw):
    codec, library = PieceCodec(raw), sentencepiece.SentencePieceProcessor(model_file=PATH)
    alphabet = [*"abcthe ing  .,!?()'²³①5_", "▁", "\t", "\n", "\r\n", "é", "日本", "😀", "‍", "\x00", "<s>", "</s>", "<0x41>", "ﬁ"]
    for text in ["", " ", "   ", "a ", "a▁ b", "▁", " ▁ ", "a" * 300, "ab" * 400, "=" * 200, *_strings(alphabet, 3000), *_strings(alphabet, 20, 3000)]:
        _same(codec, library, text)


def test_bytes_that_are_no_text_decode_as_the_library(raw):
    codec, library = PieceCodec(raw), sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(3)
    for _ in range(500):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000), 1, 2]) for _ in range(rng.randrange(1, 12))]
        assert codec.decode(ids) == library.decode(ids), ids


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc", "nfkc_cf", "nmt_nfkc_cf"])
@pytest.mark.parametrize("trim", [0, 1])
def test_compiled_character_maps(rule, trim):
    """Models of our own with the library's compiled maps: ids, spans and text."""
    spec = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec()
    blob = dict(piece_codec.fields(spec))[2]
    pieces = [("<unk>", 0, 2), *((c, -50.0 - i, 1) for i, c in enumerate("▁abcdefi1á ́"))]
    pieces += [("▁a", -1, 1), ("ab", -2, 1), ("fi", -3, 1), ("▁▁", -4, 1), ("ba", -5, 1), ("▁ab", -6, 1), ("aba", -2.5, 1)]
    made = _model(pieces, _field(2, blob) + _field(3, 1) + _field(4, trim) + _field(5, 1))
    codec, library = PieceCodec(made), sentencepiece.SentencePieceProcessor(model_proto=made)
    assert codec.model.map.units
    for text in ["", "  ", "　a", "a　 b", "ﬁ①  ａ́ á", *_strings([*"abABfi  ", "　", "ﬁ", "①", "á", "́", "ａ", "\t", "​", "日"], 800, 25)]:
        _same(codec, library, text)


def test_unused_and_user_defined_pieces():
    pieces = [("<unk>", 0, 2), *((c, -50.0 - i, 1) for i, c in enumerate("▁abc")), ("ab", -1, 5), ("abc", -2, 1), ("bc", -3, 1), ("ca", -4, 4), ("▁a", -5, 1)]
    made = _model(pieces, _field(3, 1) + _field(4, 0) + _field(5, 1))
    codec, library = PieceCodec(made), sentencepiece.SentencePieceProcessor(model_proto=made)
    for text in _strings("abc ", 600, 20):
        _same(codec, library, text)


def test_equal_scores_join_from_the_left():
    pieces = [("<unk>", 0, 2), *((c, -50.0, 1) for c in "▁ab"), ("ab", -1, 1), ("ba", -1, 1), ("aba", -1, 1)]
    made = _model(pieces, _field(3, 1) + _field(4, 0) + _field(5, 1))
    codec, library = PieceCodec(made), sentencepiece.SentencePieceProcessor(model_proto=made)
    for text in _strings("ab ", 400, 90):
        _same(codec, library, text)


def test_source_of_every_normalised_byte(raw):
    data, source = normalise(Model(raw), "é b")
    assert (data.decode(), source) == ("▁é▁b", [0, 0, 0, 0, 0, 2, 2, 2, 3, 4])


def test_columns_and_query(spark, odd, empty, raw):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = odd.select("doc_id", "text", piece_codec.round_trip(spark).alias("r"), piece_codec.encode(spark).alias("e"))
    rows = rows.withColumn("d", piece_codec.decode(spark, rows["e.ids"])).collect()
    assert len(rows) == len(ODD)
    for row in rows:
        ids = library.encode(row.text or "")
        assert row.e.ids == ids and row.r.n_tokens == len(ids)
        assert row.r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
        assert row.d.text == library.decode(ids)
        assert row.e.ends[-1:] == ([len(row.text.encode())] if row.text else [])
        assert row.r.spans_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}q", *row.e.ends)).hexdigest()
    assert empty.select(piece_codec.round_trip(spark).alias("r")).count() == 0


def test_words_decode_as_their_ids_do(raw, monkeypatch):
    """The round trip looks the bytes up once a word, not once an id, and gives what decoding all ids gives."""
    rules = _field(3, 0) + _field(4, 1)
    small = _model([("<unk>", 0, 2), ("<0xE2>", 0, 6), ("▁a", -1, 1), ("▁", -2, 1), ("a", -3, 1), ("b", -4, 1)], rules)
    for model in (raw, small):
        codec = PieceCodec(model)
        texts = [*(row[1] or "" for row in ODD), " a  b ", "aa\n\nab ⁇ x", *_strings("ab ▁é\n日", 100)]
        want = [(len(ids), codec.decode_bytes(ids)) for ids, _ in map(codec.encode, texts)]
        with monkeypatch.context() as patch:
            patch.setattr(codec, "decode_bytes", None)
            found = piece_codec.digests(codec)(texts)
        assert found[0] == [n for n, _ in want]
        assert found[2] == [hashlib.sha256(b).hexdigest() for _, b in want]
