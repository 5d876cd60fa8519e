"""Byte-level BPE as a finite-state transducer, made deterministic as it runs, and streaming decoding.

A sequence of tokens is the BPE form of its bytes exactly when every two neighbours stay apart under the merge
rules. So the form of a prefix is known from its last token alone, and that token is the longest-lived candidate
among the tokens that end here whose left neighbour (the last token of the shorter prefix before it) it stays apart
from. A state is the place in the suffix automaton of the vocabulary (the longest end of the input that begins a
token) and the last token of every prefix from which a token may still be under way. Reading a byte gives the next
state and that prefix's last token. All prefixes still under way share an older prefix, at most the longest
tokens back: up to there the tokens are certain and are written. Moves are made when first met and kept, up to a bound; beyond it
they are worked out from the last tokens themselves.

Long texts go through piece by piece, and a long pre-token through ``feed`` and ``finish`` in blocks: what is held is the
table, the block and the tokens still under way, whatever the text's length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.llm.common import Memo, held, text_udf
from mailsift.llm.pretokens import PIECES, Chunks, splitter

#: Bounds of the lazily made table, and of the known pairs (two generations of them).
MOST_STATES, MOST_PAIRS, MOST_SHAPES = 150_000, 400_000, 200_000
#: Bytes of a block of a long pre-token; characters of a text that goes through piece by piece, and pieces of a block.
BLOCK_BYTES, LONG_TEXT, BLOCK_PIECES = 4096, 1 << 20, 4096
#: Chunks kept by a worker, in each of two generations.
WORDS = 400_000
#: The pattern whose pre-tokens of letters and of ASCII signs are told without it.
WORDS_AND_SIGNS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SIGNS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
RESULT = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """Tokens and ranks of a rank file's content."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}


def merge(piece: bytes, ranks: dict[bytes, int], stop: int = 1) -> list[bytes]:
    """Plain BPE: the pair with the lowest rank joins first, the leftmost of equals; until ``stop`` parts are left."""
    parts = [piece[i:i + 1] for i in range(len(piece))]
    while len(parts) > stop:
        best, at = None, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1])
            if r is not None and (best is None or r < best):
                best, at = r, i
        if best is None:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Transducer:
    """Encodes single pre-tokens: whole with ``encode``, or in pieces of any cut with ``feed`` and ``finish``."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        # trie: moves[node * 256 + byte] -> node; the root is 0
        self.moves: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        self.depth, inner, parents = [0], {0}, []
        for token, i in ranks.items():
            node = 0
            for b in token:
                key = node << 8 | b
                if key not in self.moves:
                    self.moves[key] = len(self.depth)
                    parents.append((len(self.depth), node, b))
                    self.depth.append(self.depth[node] + 1)
                    inner.add(node)
                node = self.moves[key]
            self.token_at[node] = i
        self.inner = inner
        # the longest shorter end that is in the trie too
        self.shorter = [0] * len(self.depth)
        for node, parent, b in sorted(parents, key=lambda x: self.depth[x[0]]):
            if parent:
                self.shorter[node] = self._goto(self.shorter[parent], b)
        #: per node, when needed: (token, length) of the tokens that end here; lengths from which more may come
        self.ends: dict[int, tuple[tuple[int, int], ...]] = {0: ()}
        self.live: dict[int, tuple[int, ...]] = {0: (0,)}
        #: by (left + 1) << 20 | right: whether the two stay apart
        self.apart: dict[int, bool] = {}
        self.apart_before: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.shapes: dict[int, tuple] = {}
        start = (0, (-1,))
        self.ids = {start: 0}
        self.states = [start]
        self.steps: list[dict[int, tuple[int, int]]] = [{}]

    def _goto(self, node: int, byte: int) -> int:
        while True:
            to = self.moves.get(node << 8 | byte)
            if to is not None:
                return to
            if not node:
                return 0
            node = self.shorter[node]

    def _of(self, node: int) -> tuple[tuple[tuple[int, int], ...], tuple[int, ...]]:
        """Tokens that end at a node, longest first, and the lengths of ends that may go on."""
        if node not in self.ends:
            ends, live = self._of(self.shorter[node])
            own = self.token_at.get(node)
            self.ends[node] = ends if own is None else ((own, self.depth[node]), *ends)
            self.live[node] = (self.depth[node], *live) if node in self.inner else live
        return self.ends[node], self.live[node]

    def _halves(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes a token, itself twice where none does (single bytes, unreachable ones)."""
        pair = self.halves.get(token)
        if pair is None:
            whole = self.bytes_of[token]
            parts = merge(whole, self.ranks, stop=2) if len(whole) > 1 and self._stays(-1, token) else []
            pair = self.halves[token] = tuple(self.ranks[x] for x in parts) if len(parts) == 2 else (token, token)
        return pair

    def _stays(self, left: int, right: int) -> bool:
        """Whether two neighbours are what the merges make of their bytes; left -1: the piece begins.

        Merges are undone from the latest to the earliest, always in the token nearer to have been made last. Two
        halves that face each other over the border at some point would have merged if their merge came before
        the one just undone.
        """
        key = left + 1 << 20 | right
        stays = self.apart.get(key)
        if stays is None:
            stays = self.apart_before.get(key)
            if stays is None and left < 0:
                stays = merge(self.bytes_of[right], self.ranks) == [self.bytes_of[right]]
            elif stays is None:
                stays = self._meet(left, right) and self._stays(-1, left) and self._stays(-1, right)
            if len(self.apart) >= MOST_PAIRS:
                self.apart_before = dict(self.apart)
                self.apart.clear()
            self.apart[key] = stays
        return stays

    def _meet(self, a: int, b: int) -> bool:
        """Whether no two halves of the tokens join over the border."""
        joined, bytes_of, halves, before = self.ranks.get, self.bytes_of, self.halves, len(self.ranks) + 1
        while True:
            rank = joined(bytes_of[a] + bytes_of[b])
            if rank is not None and rank < before:
                return False
            inner_a, inner_b = (halves.get(a) or self._halves(a))[1], (halves.get(b) or self._halves(b))[0]
            if inner_b == b:
                if inner_a == a:
                    return True
                before, a = a, inner_a
            elif inner_a != a and a > b:  # on the left border merges of equal rank happen first
                before, a = a, inner_a
            else:
                before, b = b + 1, inner_b

    def _shape(self, node: int, byte: int) -> tuple:
        """The next place and the tokens that may end there, whatever the last tokens are."""
        to = self._goto(node, byte)
        if len(self.shapes) >= MOST_SHAPES:
            self.shapes.clear()
        shape = self.shapes[node << 8 | byte] = (to, self._of(to)[0])
        return shape

    def _key(self, node: int, lasts: list[int]) -> tuple[int, tuple]:
        """The state: the place and the last tokens where a token under way may have begun."""
        return node, tuple([lasts[-1 - k] for k in self._of(node)[1]])

    def _walk(self, data: bytes, node: int, lasts: list[int]) -> int:
        """Reads bytes without the table; adds each prefix's last token and gives the place reached."""
        shapes, apart, at = self.shapes, self.apart, len(lasts)
        for b in data:
            node, ends = shapes.get(node << 8 | b) or self._shape(node, b)
            for token, n in ends:
                left = lasts[at - n]
                stays = apart.get(left + 1 << 20 | token)
                if self._stays(left, token) if stays is None else stays:
                    break
            else:
                raise ValueError(f"no token ends with byte {b}")
            lasts.append(token)
            at += 1
        return node

    def _run(self, data: bytes, node: int, lasts: list[int]) -> int:
        """Reads bytes from a state on through the table as far as it goes, then without it.

        ``lasts``: the last token of every prefix still needed, the first that of the prefix before (-1: the piece begins).
        """
        state, steps = self.ids.get(self._key(node, lasts)) if len(lasts) > 1 else 0 if lasts[0] < 0 else None, self.steps
        if state is None:
            return self._walk(data, node, lasts)
        for at, b in enumerate(data):
            move = steps[state].get(b)
            if move is None:
                node = self.states[state][0]
                if len(self.states) >= MOST_STATES:
                    return self._walk(data[at:], node, lasts)
                key = self._key(self._walk(data[at:at + 1], node, lasts), lasts)
                found = self.ids.setdefault(key, len(self.states))
                if found == len(self.states):
                    self.states.append(key)
                    steps.append({})
                steps[state][b] = (found, lasts[-1])
                state = found
            else:
                state, last = move
                lasts.append(last)
        return self.states[state][0]

    def _back(self, lasts: list[int], end: int) -> list[int]:
        """The tokens of the first ``end`` bytes after ``lasts[0]``, from the last tokens of all prefixes."""
        out, size = [], self.bytes_of
        while end > 0:
            token = lasts[end]
            out.append(token)
            end -= len(size[token])
        out.reverse()
        return out

    def encode(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token. A piece that is a token itself is that token, as the library has it."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        if len(piece) > BLOCK_BYTES:
            return tuple(chain.from_iterable(self.encode_blocks(piece)))
        lasts = [-1]
        self._run(piece, 0, lasts)
        return tuple(self._back(lasts, len(piece)))

    def encode_blocks(self, piece: bytes) -> Iterator[list[int]]:
        """The ids of one pre-token that is no token itself, as they become certain."""
        held = None
        for i in range(0, len(piece), BLOCK_BYTES):
            sure, held = self.feed(piece[i:i + BLOCK_BYTES], held)
            yield sure
        yield self.finish(held)

    def feed(self, data: bytes, held: tuple | None = None) -> tuple[list[int], tuple]:
        """Reads on: the tokens that are certain by now, and what to pass to the next call.

        ``held``: the place, and the last tokens of the prefixes from the last token written on.
        """
        node, lasts = held or (0, [-1])
        lasts = list(lasts)
        node = self._run(data, node, lasts)
        under_way = {len(lasts) - 1 - k for k in self._of(node)[1]}
        while len(under_way) > 1:  # the furthest steps back by a token until all meet
            furthest = max(under_way)
            under_way.remove(furthest)
            under_way.add(furthest - len(self.bytes_of[lasts[furthest]]))
        sure = max(0, *under_way, 0)
        return self._back(lasts, sure), (node, lasts[sure:])

    def finish(self, held: tuple) -> list[int]:
        """The tokens still held when the piece ends."""
        return self._back(held[1], len(held[1]) - 1)


class Utf8Stream:
    """Incremental UTF-8: takes bytes in any cuts, gives text up to the last whole character.

    The state is the bytes of a character begun; bytes that can't be part of one become U+FFFD.
    """

    def __init__(self):
        self.begun = b""

    def feed(self, data: bytes) -> str:
        data = self.begun + data
        cut = len(data)
        for back in range(1, min(3, len(data)) + 1):
            b = data[-back]
            if b & 0xC0 == 0x80:
                continue
            need = 2 if 0xC2 <= b <= 0xDF else 3 if 0xE0 <= b <= 0xEF else 4 if 0xF0 <= b <= 0xF4 else 1
            if need > back:
                cut = len(data) - back
            break
        self.begun = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.begun = self.begun, b""
        return rest.decode("utf-8", "replace")


class Codec:
    """Encoding and decoding of whole texts with one vocabulary and pattern."""

    def __init__(self, raw: bytes, pattern: str):
        ranks = read_ranks(raw)
        self.transducer = Transducer(ranks)
        self.bytes_of = self.transducer.bytes_of
        self.pattern = regex.compile(pattern)
        encode, split = self.transducer.encode, splitter(pattern)
        self.piece = piece = Memo(lambda p: encode(p.encode("utf-8", "replace")), PIECES)
        known = pattern == WORDS_AND_SIGNS

        def chunk(c):
            """Ids of a chunk: a space and what stands up to the next one."""
            word = c[1:]
            if known and c[:1] == " " and word:
                if word.isalpha():  # one pre-token, which no other chunk's pieces hold
                    return encode(c.encode("utf-8", "replace"))
                stem = word.rstrip(SIGNS)
                if stem.isalpha():  # letters, then signs: two pre-tokens
                    return self.chunks.spaced[stem] + piece[word[len(stem):]]
            parts = split(c)
            return piece[parts[0]] if len(parts) == 1 else tuple(chain.from_iterable(map(piece.__getitem__, parts)))

        self.chunks = Chunks(chunk, lambda t: list(map(piece.__getitem__, split(t))), most=WORDS)

    def blocks(self, text: str) -> Iterator[list[int]]:
        """The text's ids, block by block; a text of ordinary length is one."""
        if len(text) <= LONG_TEXT:
            yield list(chain.from_iterable(self.chunks(text)))
            return
        values = []
        for found in self.pattern.finditer(text):
            size = found.end() - found.start()
            if size <= BLOCK_BYTES:
                values.append(self.piece[found.group()])
            if values and (size > BLOCK_BYTES or len(values) >= BLOCK_PIECES):
                yield list(chain.from_iterable(values))
                values = []
            if size > BLOCK_BYTES:
                yield from filter(None, self.transducer.encode_blocks(found.group().encode("utf-8", "replace")))
        if values:
            yield list(chain.from_iterable(values))

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.blocks(text)))

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_stream(self, ids: list[int], block: int = 4096) -> Iterable[str]:
        """Text of the ids, block by block, never with half a character."""
        stream = Utf8Stream()
        for i in range(0, len(ids), block):
            yield stream.feed(self.decode_bytes(ids[i:i + block]))
        yield stream.finish()


def codec(raw: bytes, pattern: str) -> Codec:
    """The codec of a worker process, made once for a vocabulary."""
    return held(("codec", hashlib.sha256(raw).digest(), pattern), lambda: Codec(raw, pattern))


def _vocabulary(spark: SparkSession, path: str | None, pattern: str | None):
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        return spark.sparkContext.broadcast((f.read(), pattern or public_tokenizers.PATTERN))


def encode(spark: SparkSession, text: Column | str = "text", path: str | None = None, pattern: str | None = None) -> Column:
    """The struct (ids array<int>) of a text column; null and empty texts have no ids.

    The rank file (under 1 MB) is read on the driver and broadcast.
    """
    shared = _vocabulary(spark, path, pattern)

    def make():
        c = codec(*shared.value)
        return lambda texts: [[c.encode(t or "") for t in texts]]

    return text_udf(make, "ids array<int>", text)


def decode(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", ids: str = "ids", path: str | None = None,
           pattern: str | None = None) -> DataFrame:
    """(id, text) from an array column of ids; null ids give a null text. Bytes that aren't UTF-8 become U+FFFD."""
    shared = _vocabulary(spark, path, pattern)
    flat = F.array_join(F.col(ids), " ")

    def make():
        c = codec(*shared.value)
        return lambda rows: [[None if r is None else "".join(c.decode_stream(list(map(int, r.split())))) for r in rows]]

    return docs.select(id_col, text_udf(make, "text string", flat).alias("__d")).select(id_col, "__d.text")


def digests(make_codec: Callable[[], Codec]):
    """A function from texts to the columns of ``RESULT``: encoded, decoded again as a stream, both hashed."""
    c = make_codec()
    digits = {i: str(i) for i in c.bytes_of}

    def work(texts):
        n, ids_hash, text_hash = [], [], []
        for text in texts:
            count, of_ids, of_text, stream = 0, hashlib.sha256(), hashlib.sha256(), Utf8Stream()
            for ids in c.blocks(text or ""):
                of_ids.update((("," if count and ids else "") + ",".join(map(digits.__getitem__, ids))).encode())
                count += len(ids)
                of_text.update(stream.feed(c.decode_bytes(ids)).encode())
            of_text.update(stream.finish().encode())
            n.append(count)
            ids_hash.append(of_ids.hexdigest())
            text_hash.append(of_text.hexdigest())
        return [n, ids_hash, text_hash]

    return work


def round_trip(spark: SparkSession, text: Column | str = "text", path: str | None = None, pattern: str | None = None) -> Column:
    """The struct ``RESULT``: number of ids, hash of the ids, hash of the bytes they decode to. Null counts as empty."""
    shared = _vocabulary(spark, path, pattern)
    return text_udf(lambda: digests(lambda: codec(*shared.value)), RESULT, text)
