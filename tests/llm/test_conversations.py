"""Operator 13: faults and cheapest edits against a plain search."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

import mailsift.llm.conversations as C
from mailsift.llm.conversations import repair, repaired_rows

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
FIELDS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def spaced(x):
    return " " if x is None else str(x)


def damage(rows):
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = spaced(role), spaced(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        for _ in range({0: 0, 3: 2}.get(kind, 1)):
            yield conv, turn, role, text


def cheapest(rows):
    """(cost, letters, repaired lines) by trying every edit; rows are (role, fault)."""
    @lru_cache(None)
    def best(i, state):
        follow = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        whole = {"u": "user", "a": "assistant"}[follow]
        options = []
        if i < len(rows):
            role, text, fault = rows[i]
            late = 1 if fault == "truncated" else 0
            options.append((3, "D", i + 1, state, None))
            if fault not in ("blank", "duplicate"):
                if role[:1] == follow or role[:1] == "s" and state == "":
                    options.append((late, "K", i + 1, role[:1], f"{role}:{text}"))
                options.append((2 + late, "R", i + 1, follow, f"{whole}:{text}"))
        for cost, letter, at, to, line in options:
            c, letters, lines = best(at, to)
            found.append((cost + c, letter + letters, lines if line is None else (line, *lines)))
        # an insertion may only follow a bounded number of others
        return min([*found, *inserted(i, follow, whole, 1)])

    @lru_cache(None)
    def inserted(i, state, whole, depth):
        """One insertion and what comes after it, at most three in a row."""
        out = []
        follow = {"u": "a", "a": "u"}[state]
        for cost, letters, lines in plain(i, state):
            out.append((2 + cost, "I" + letters, (f"{whole}:", *lines)))
        if depth < 3:
            for cost, letters, lines in inserted(i, follow, {"u": "user", "a": "assistant"}[follow], depth + 1):
                out.append((2 + cost, "I" + letters, (f"{whole}:", *lines)))
        return tuple(out)

    @lru_cache(None)
    def plain(i, state):
        """Ways on from a row on without an insertion before it."""
        follow = {"u": "a", "a": "u"}[state]
        found = [(0, "", ())] if i == len(rows) and state == "a" else []
        if i < len(rows):
            role, text, fault = rows[i]
            late = 1 if fault == "truncated" else 0
            options = [(3, "D", state, None)]
            if fault not in ("blank", "duplicate"):
                if role[:1] == follow:
                    options.append((late, "K", follow, f"{role}:{text}"))
                options.append((2 + late, "R", follow, {"u": "user", "a": "assistant"}[follow] + f":{text}"))
            for cost, letter, to, line in options:
                c, letters, lines = best(i + 1, to)
                found.append((cost + c, letter + letters, lines if line is None else (line, *lines)))
        return tuple(found)

    return best(0, "")


def brute(rows, damaged=True):
    out = []
    for conv in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == conv]
        left = list(damage(mine)) if damaged else [(c, t, spaced(r), spaced(x)) for c, t, r, x in mine]
        left.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faulty = set(), []
        for _, _, role, text in left:
            visible = re.sub("[ \t-\r]", "", text)
            fault = ("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [r[1] for r in left if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
        cost, letters, lines = cheapest(tuple(faulty))
        counts = [sum(f == kind for _, _, f in faulty) for kind in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df, **more):
    return sorted((tuple(r[c] for c in FIELDS) for r in repair(df, **more).collect()), key=str)


def made(seed, n, most=9):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for _ in range(rng.randrange(most)):
            role = rng.choice(["user", "assistant", "system", "assistant", "user", "tool", "", None, "U", "a"])
            text = rng.choice(["Hi.", "Hi", "Hi. ", "", " \t", None, "So?", "é!", " ", "x.\x0b", "Hi.\n"])
            rows.append((conv, rng.choice([None, *range(12), 40]), role, text))
    return rows


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("damaged", [False, True])
def test_against_a_plain_search(spark, seed, damaged):
    rows = made(seed, 60)
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS code", "'x' AS letters", "2 AS cost", "3 AS place")
    assert found(df, damage=damaged) == brute(rows, damaged)


def test_blocks_and_batches_of_a_few_rows(spark, monkeypatch):
    """Conversations over many blocks, ties of one turn over several of them."""
    rng = random.Random(5)
    rows = [(c, rng.choice([None, 1, 2, i]), rng.choice(["user", "assistant"]), rng.choice(["a.", "b", f"{i}."])) for c in range(3) for i in range(90)]
    df = spark.createDataFrame(rows, SCHEMA)
    blocks = C._Backwards
    monkeypatch.setattr(C, "BLOCK", 7)
    # the worker imports its own module: run the two streams here, on the rows in their order
    planned = brute(rows, False)
    assert found(df) == planned
    moves, out = {}, {}
    for conv in range(3):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]), reverse=True)
        one, parts = blocks(conv), []
        for i, r in enumerate(mine):
            earlier = {(x[2], x[3]) for x in mine[i + 1:]}
            fault = C.DUPLICATE if (r[2], r[3]) in earlier else C.SOUND if r[3].endswith(".") else C.TRUNCATED
            part = one.row(r[1], {"user": C.USER, "assistant": C.ASSISTANT}[r[2]] + 4 * fault, moves)
            parts += [part] if part else []
        parts.append(one.flush(True))
        assert len(parts) == -(-len(mine) // 7) and all(len(p[3]) <= 7 for p in parts)
        letters, lines = [], []
        walk = C._Forwards(conv, lambda c, letter, role, text: (letters.append(C.LETTERS[letter]), lines.append(f"{role}:{text}") if letter else None))
        for p in reversed(parts):
            walk.block(p[3], p[4:])
        for r in reversed(mine):
            walk.row(r[2], r[3])
        walk.end()
        out[conv] = ("".join(letters), hashlib.sha256("\n".join(lines).encode()).hexdigest(), walk.figures[-1])
    assert [out[p[0]] for p in planned] == [(p[7], p[8], p[6]) for p in planned]


def test_rows_of_the_edits_give_the_digest(spark):
    rows = made(9, 30)
    df = spark.createDataFrame(rows, SCHEMA)
    lines = {}
    for r in sorted(repaired_rows(df, damage=True).collect(), key=lambda r: (str(r.conv_id), r.place)):
        lines.setdefault(r.conv_id, []).append(r)
    for conv, _, _, _, _, _, _, audit, digest in brute(rows):
        mine = lines.get(conv, [])
        assert "".join(r.edit for r in mine) == audit
        kept = [r for r in mine if r.edit != "D"]
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in kept).encode()).hexdigest() == digest
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in kept))


def test_giant_conversation_and_long_text(spark):
    """One conversation of 200,000 rows: three blocks; every second text is long."""
    n = 200_000
    rows = spark.range(n).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"),
                                 F.concat(F.col("id").cast("string"), F.when(F.col("id") % 50_000 == 0, F.repeat(F.lit("long "), 200_000)).otherwise(""), F.lit("."))
                                 .alias("text"))
    row = repair(rows).collect()
    assert [(r.cost, r.illegal, r.audit == "K" * n) for r in row] == [(0, 0, True)]


def test_empty_table_and_table_of_the_tests(spark):
    assert repair(spark.createDataFrame([], SCHEMA), damage=True).collect() == []
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert found(table, damage=True) == brute(rows)
