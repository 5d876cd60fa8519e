"""Byte-level BPE vocabularies in the JSON form of the tokenizers library."""

from __future__ import annotations

import hashlib
import json

from mailsift.llm.common import held


def read_path(path: str | None, name: str = "byte_bpe_50k.json") -> tuple[str, str]:
    """The content of a vocabulary file and the pattern that goes with it; read on the driver, then broadcast."""
    import public_tokenizers

    with open(path or public_tokenizers.path(name), encoding="utf-8") as f:
        return f.read(), public_tokenizers.PATTERN


def special_strings(content: str) -> tuple[str, ...]:
    """Strings that the library takes out of a text before it splits it."""
    return tuple(t["content"] for t in json.loads(content)["added_tokens"])


def tokenizer(content: str):
    """The library's tokenizer, once per process; it works on one thread, as Spark runs one task a core."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    def make():
        t = Tokenizer.from_str(content)
        t.no_truncation(), t.no_padding()
        return t

    return held(("tokenizer", hashlib.sha256(content.encode()).digest()), make)


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins that such files use for bytes: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def rank_encoding(content: str, pattern: str):
    """The same vocabulary as a rank encoding, many times faster; None where ids don't follow the merges.

    Merges in such a file come in the order of the ids they make, after the single bytes; then ids are ranks.
    """
    import tiktoken

    def make():
        data = json.loads(content)
        vocab, back = data["model"]["vocab"], byte_of_char()
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        merges = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        made = [vocab.get(a + b, -1) for a, b in merges]
        if made != sorted(made) or len(set(made)) < len(made) or -1 in made:
            return None
        ranks = {bytes(back[c] for c in t): i for t, i in vocab.items() if t not in special}
        if len(ranks) != 256 + len(made) or max((i for t, i in ranks.items() if len(t) == 1)) > made[0]:
            return None
        return tiktoken.Encoding("json", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    return held(("ranks", hashlib.sha256(content.encode()).digest(), pattern), make)
