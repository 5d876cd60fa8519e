"""SentencePiece BPE encoding that keeps source offsets, and decoding.

A text is normalised by the longest prefixes that the model's compiled character map knows; every byte written
remembers the byte of the source it stands for. Pieces are then merged in the normalised text, best score first, and
the ends of the pieces are looked up in that record: each piece gets the span of source bytes it came from. A text is
cut at places that no piece of the vocabulary can cross (before a word's space mark, and for long stretches between
any two characters that no piece has side by side), so the words of a text are encoded once per worker as long as a
bounded memo keeps them.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from mailsift.llm.common import Memo, held, text_udf

#: The space mark of escaped text.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words kept by a worker (in each of two generations); from this many characters on, a word is cut between characters.
WORDS, LONG_WORD = 300_000, 64
NEVER = 1 << 60
RESULT = "n_tokens bigint, ids_sha256 string, decoded_sha256 string, spans_sha256 string"


def fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol buffer message: whole numbers, 32-bit fields as bytes, and byte strings."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, raw[at:at + size]
            at += size


class CharacterMap:
    """The compiled map of a normaliser: a double array of byte moves whose leaves point at replacement strings."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4) if blob else ()
        self.strings = blob[4 + size:]

    @staticmethod
    def _offset(unit):
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, bytes replaced) of the longest prefix of ``data[at:]`` that the map knows."""
        units = self.units
        if not units:
            return None
        found, place = None, self._offset(units[0])
        for i in range(at, len(data)):
            place ^= data[i]
            if place >= len(units):
                break
            unit = units[place]
            if unit & 0x800000FF != data[i]:
                break
            place ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (units[place] & 0x7FFFFFFF, i + 1 - at)
        if found is None:
            return None
        start, length = found
        return self.strings[start:self.strings.index(b"\0", start)], length


class Model:
    """Pieces, scores and rules of a SentencePiece BPE model file's content."""

    def __init__(self, raw: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer, rules = {}, {}
        for number, value in fields(raw):
            if number == 1:
                part = dict(fields(value))
                score = struct.unpack("<f", part[2])[0] if 2 in part else 0.0
                self.pieces.append((part.get(1, b"").decode(), score, part.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                rules = dict(fields(value))
        if trainer.get(3, 1) != 2 or trainer.get(24, 0):
            raise ValueError("only BPE models with space marks in front of words are read")
        self.byte_fallback = bool(trainer.get(35, 0))
        self.unknown_surface = trainer.get(44, " ⁇ ".encode()).decode()
        self.map = CharacterMap(rules.get(2, b""))
        self.dummy_prefix, self.trim, self.escape = (bool(rules.get(n, 1)) for n in (3, 4, 5))
        kinds = {NORMAL, USER, UNUSED}
        self.ids = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in kinds}
        self.user = sorted((p for p, _, kind in self.pieces if kind == USER), key=len, reverse=True)
        self.unused = {i for i, x in enumerate(self.pieces) if x[2] == UNUSED}
        self.unknown = next(i for i, x in enumerate(self.pieces) if x[2] == UNKNOWN)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        # equal scores join from the left, whichever piece they make
        order = {s: r for r, s in enumerate(sorted({s for _, s, _ in self.pieces}, reverse=True))}
        self.rank = {p: order[self.pieces[i][1]] for p, i in self.ids.items()}
        #: characters that stand side by side inside some piece
        self.joined = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        # runs of unknown characters are one piece, across words too
        self.cut_at_marks = self.escape and self.byte_fallback and not self.user and not any(x[1] == MARK and x[0] != MARK for x in self.joined)
        self.word = self._words()

    def _words(self) -> re.Pattern:
        """What the stretches of normalised text look like that are encoded by themselves.

        A cut lies before a run of space marks, between a letter and a sign that no piece has side by side for any
        letter, and on both sides of a character that no piece has beside any other.
        """
        signs = {chr(c) for c in range(128) if not chr(c).isalnum()}
        alone = {c for c in signs if not any(c in x for x in self.joined)}
        like_letters = {x[0] for x in self.joined if re.match(r"[^\W\d_]", x[0]) and not x[0].isalpha()}
        signs -= alone | {x[1] for x in self.joined if x[0].isalpha()}
        s, a, more = ("".join(map(re.escape, sorted(x))) for x in (signs, alone, like_letters))
        letters, others = rf"[^\W\d_{more}]", rf"(?:(?![{MARK}{a}])[\W\d_{more}])"
        bound = rf"(?:(?![{MARK}{a}{s}])[\W\d_{more}])"
        return re.compile((f"[{a}]|" if a else "") + f"(?s:(?=.)){MARK}*{others}*(?:{letters}+(?:{bound}{others}*)?)*")


def normalise(model: Model, text: str) -> tuple[bytes, list[int]]:
    """The normalised UTF-8 text and, for each byte of it and its end, the source byte it stands for."""
    data = text.encode("utf-8", "replace")
    user = [u.encode() for u in model.user]
    mark = MARK.encode() if model.escape else b" "
    out, source = bytearray(), []

    def prefix(at):
        for u in user:
            if data.startswith(u, at):
                return u, len(u)
        known = model.map.longest(data, at)
        if known is None:
            lead = data[at]
            n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            known = data[at:at + n], n
        return known

    def write(part, at):
        for b in part:
            new = mark if b == 0x20 else (b,)
            out.extend(new)
            source.extend([at] * len(new))

    at = 0
    if model.trim:
        while at < len(data) and (p := prefix(at))[0] == b" ":
            at += p[1]
    if at >= len(data):
        return b"", [at]
    if model.dummy_prefix:
        write(b" ", at)
    after_space = model.trim
    while at < len(data):
        part, n = prefix(at)
        if after_space:
            part = part.lstrip(b" ")
        if part:
            write(part, at)
            after_space = part.endswith(b" ")
        at += n
        after_space = after_space and model.trim
    if model.trim:
        while out.endswith(mark):
            at = source[len(out) - len(mark)]
            del out[-len(mark):], source[-len(mark):]
    return bytes(out), [*source, at]


class PieceCodec:
    """Encoding with source offsets and decoding, with one model."""

    def __init__(self, raw: bytes):
        m = self.model = Model(raw)
        #: per id, the bytes it decodes to
        self.surface = []
        for i, (p, _, kind) in enumerate(m.pieces):
            text = {CONTROL: "", UNKNOWN: m.unknown_surface}.get(kind, p.replace(MARK, " "))
            self.surface.append(bytes([int(p[3:5], 16)]) if kind == BYTE else text.encode())
        self.controls = {i for i, x in enumerate(m.pieces) if x[2] == CONTROL}
        #: per piece: id, bytes, bytes when a space mark counts as one
        self.own = {p: (i, len(p.encode()), len(p.encode()) - 2 * p.count(MARK)) for p, i in m.ids.items()}
        self.digits = [str(i) for i in range(len(m.pieces))]
        #: the source is the normalised text but for the space marks: words carry their spans with them
        self.plain = not m.map.units and not m.trim and m.cut_at_marks and m.dummy_prefix
        self.words = Memo(self._word, WORDS)

    def merge(self, text: str) -> list[str]:
        """Pieces of normalised text: of all neighbours that make a known piece the best score joins first, the
        leftmost of equals."""
        if len(text) > LONG_WORD or self.model.user or self.model.unused:
            return self._merge_long(text)
        rank, parts = self.model.rank.get, list(text)
        ranks = [rank(a + b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == NEVER:
                break
            i = ranks.index(best)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], NEVER)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], NEVER)
        return parts

    def _merge_long(self, text: str) -> list[str]:
        """The same with a heap and linked parts, for long texts and models with user-defined or unused pieces."""
        m, parts, at = self.model, [], 0
        fixed = set(m.user)
        while at < len(text):
            parts.append(next((u for u in m.user if text.startswith(u, at)), text[at]))
            at += len(parts[-1])
        n = len(parts)
        made: dict[str, tuple[str, str]] = {}
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))

        def offers(i):
            left, right = parts[i], parts[after[i]]
            r = None if left in fixed or right in fixed else m.rank.get(left + right)
            if r is None:
                return ()
            if m.unused:
                made.setdefault(left + right, (left, right))
            return ((r, i, after[i], len(left) + len(right)),)

        waiting = [x for i in range(n - 1) for x in offers(i)]
        heapq.heapify(waiting)
        while waiting:
            _, i, j, size = heapq.heappop(waiting)
            if not parts[i] or after[i] != j or len(parts[i]) + len(parts[j]) != size:
                continue  # one of the two has joined another since
            parts[i], parts[j], after[i] = parts[i] + parts[j], "", after[j]
            if after[i] < n:
                before[after[i]] = i
                for x in offers(i):
                    heapq.heappush(waiting, x)
            if before[i] >= 0:
                for x in offers(before[i]):
                    heapq.heappush(waiting, x)
        out, todo = [], [p for p in reversed(parts) if p]
        while todo:  # pieces marked as unused come apart again
            p = todo.pop()
            if p in made and m.ids[p] in m.unused:
                todo += reversed(made[p])
            else:
                out.append(p)
        return out

    def _stretches(self, text: str) -> Iterable[str]:
        """Stretches of normalised text that no piece crosses the borders of."""
        if self.model.user or len(text) <= LONG_WORD:
            return (text,)
        joined = self.model.joined
        cuts = [0, *(i for i, x in enumerate(map(str.__add__, text, text[1:]), 1) if x not in joined), len(text)]
        return (text[a:b] for a, b in zip(cuts, cuts[1:]))

    def pieces(self, text: str, marks: int = 3) -> tuple[list[int], list[int]]:
        """Ids of normalised text and how many of its bytes each stands for (a character in bytes counts at its last);
        a space mark counts as ``marks`` bytes."""
        m, ids, sizes, own = self.model, [], [], self.own
        for stretch in self._stretches(text):
            for p in self.merge(stretch):
                known = own.get(p)
                if known is not None:
                    ids.append(known[0])
                    sizes.append(known[1] if marks == 3 else known[2])
                    continue
                size = marks if p == MARK else len(p.encode())
                if m.byte_fallback:
                    ids += [m.byte_ids[b] for b in p.encode()]
                    sizes += [0] * (len(p.encode()) - 1) + [size]
                elif ids and ids[-1] == m.unknown:  # unknown characters in a row are one piece
                    sizes[-1] += size
                else:
                    ids.append(m.unknown)
                    sizes.append(size)
        return ids, sizes

    def _word(self, word: str) -> tuple[tuple[int, ...], str, bytes, bytes]:
        """(ids, their digits, sizes as bytes, bytes the ids decode to) of a word with its space marks.

        Sizes count normalised bytes, or source bytes (a mark is one) where the map is ``plain``.
        """
        ids, sizes = self.pieces(word, 1 if self.plain else 3)
        return (tuple(ids), ",".join(map(self.digits.__getitem__, ids)), array("q", sizes).tobytes(),
                b"".join(map(self.surface.__getitem__, ids)))

    def parts(self, text: str) -> tuple[list[tuple], np.ndarray]:
        """The words' (ids, digits, sizes, decoded bytes), in order, and the end of each piece in source bytes."""
        if not text:
            return [], np.zeros(0, np.int64)
        if self.plain and MARK not in text:
            words = list(map(self.words.__getitem__, self.model.word.findall(MARK + text.replace(" ", MARK))))
            ends = np.cumsum(np.frombuffer(b"".join([w[2] for w in words]), np.int64))
            return words, np.maximum(ends - 1, 0)  # the first mark is the model's own
        data, source = normalise(self.model, text)
        if self.plain or not self.model.cut_at_marks:
            ids, sizes = self.pieces(data.decode())
            words = [(ids, ",".join(map(self.digits.__getitem__, ids)), b"", b"".join(map(self.surface.__getitem__, ids)))]
        else:
            words = list(map(self.words.__getitem__, self.model.word.findall(data.decode())))
            sizes = np.frombuffer(b"".join([w[2] for w in words]), np.int64)
        return words, np.array(source, np.int64)[np.cumsum(sizes, dtype=np.int64)]

    def encode(self, text: str) -> tuple[list[int], np.ndarray]:
        """Ids, and the end of each piece in source bytes; a piece begins where the one before it ends."""
        words, ends = self.parts(text)
        return list(chain.from_iterable([w[0] for w in words])), ends

    def _leading(self, ids: Iterable[int]) -> int:
        """Marks of the first piece, and of all before the first text where the model trims: they aren't decoded."""
        m, marks = self.model, 0
        for i in ids if m.dummy_prefix or m.trim else ():
            piece, _, kind = m.pieces[i]
            if kind != CONTROL:
                marks += kind != UNKNOWN and piece.startswith(MARK)
                if piece != MARK or not m.trim:
                    break
        return marks

    def decode_words(self, words: list[tuple]) -> bytes:
        """``decode_bytes`` of the ids of encoded words, whose bytes were looked up when the words were encoded."""
        raw = b"".join([w[3] for w in words])
        try:
            raw.decode()
        except UnicodeError:
            return self.decode_bytes(chain.from_iterable([w[0] for w in words]))
        return raw[self._leading(chain.from_iterable(w[0] for w in words)):]

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """UTF-8 of the ids' text. Bytes that aren't UTF-8 become U+FFFD, one each."""
        ids = list(ids)
        m, marks = self.model, self._leading(ids)
        raw = b"".join(map(self.surface.__getitem__, ids))
        try:
            if not self.controls.isdisjoint(ids):
                raise UnicodeError
            raw.decode()
        except UnicodeError:  # bytes make characters only within a run of them
            raw = "".join(b"".join(map(self.surface.__getitem__, run)).decode("utf-8", "one_each")
                          for _, run in groupby(ids, lambda i: m.pieces[i][2] if m.pieces[i][2] in (BYTE, CONTROL) else NORMAL)).encode()
        return raw[marks:]

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode()


codecs.register_error("one_each", lambda e: ("�", e.start + 1))


def codec(raw: bytes) -> PieceCodec:
    """The codec of a worker process, made once for a model."""
    return held(("pieces", hashlib.sha256(raw).digest()), lambda: PieceCodec(raw))


def _model(spark: SparkSession, path: str | None):
    import public_tokenizers

    with open(path or public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(spark: SparkSession, text: Column | str = "text", path: str | None = None) -> Column:
    """The struct (ids array<int>, ends array<bigint>) of a text column: pieces and where each ends in the UTF-8
    bytes of the text. A piece begins where the one before it ends; of a character given in bytes the last byte has the
    span. Null and empty texts have no pieces. The model file (under 1 MB) is read on the driver and broadcast.
    """
    shared = _model(spark, path)

    def make():
        c = codec(shared.value)

        def work(texts):
            found = [c.encode(t or "") for t in texts]
            return [[f[0] for f in found], [f[1].tolist() for f in found]]

        return work

    return text_udf(make, "ids array<int>, ends array<bigint>", text)


def decode(spark: SparkSession, ids: Column | str = "ids", path: str | None = None) -> Column:
    """The struct (text string) of an array column of ids; null ids give a null text."""
    shared = _model(spark, path)
    flat = F.array_join(F.col(ids) if isinstance(ids, str) else ids, " ")

    def make():
        c = codec(shared.value)
        return lambda rows: [[None if r is None else c.decode(map(int, r.split())) for r in rows]]

    return text_udf(make, "text string", flat)


def digests(c: PieceCodec):
    """A function from texts to the columns of ``RESULT``: encoded with spans, decoded from the ids, all hashed."""
    def work(texts):
        out = [[], [], [], []]
        for text in texts:
            words, ends = c.parts(text or "")
            digits = ",".join([w[1] for w in words if w[1]])
            hashed = (digits.encode(), c.decode_words(words), ends.tobytes())
            for column, value in zip(out, (len(ends), *(hashlib.sha256(h).hexdigest() for h in hashed)), strict=True):
                column.append(value)
        return out

    return work


def round_trip(spark: SparkSession, text: Column | str = "text", path: str | None = None) -> Column:
    """The struct ``RESULT``: number of ids and hashes of the ids (decimal, comma-joined), of the text they decode to,
    and of the pieces' ends (64-bit, little-endian). Null counts as empty."""
    shared = _model(spark, path)
    return text_udf(lambda: digests(codec(shared.value)), RESULT, text)
