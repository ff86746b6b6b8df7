"""The trie against one that is built turn by turn in plain Python."""

import hashlib
import re
import zlib

import pytest

from colprov.llm import prefix_trie as pt

SF = "/root/testdata/sf0.001"
KIND = "conv_id long, turn long, role string, text string, depth int, key string"


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text))


def own_turns(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    name = lambda v: hashlib.md5(f"{len(v[2])}:{v[2]}{v[3]}".encode()).hexdigest()
    return {c: [v[2:] for v in sorted(x, key=lambda v: (v[:2], name(v)))] for c, x in own.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + turns[h:]
    return out


def brute(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saved[p] = sum(saved[k] for k in kids.get(p, [])) + (len(members[p]) - 1) * (words(p[-1][1]) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p))
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saved[p], sha))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select(*[c.split()[0] for c in pt.NODE.split(", ")]).collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "k") for r in rows], KIND)


def made(n, seed, turns=3, kinds=2):
    x, rows = seed, []
    for c in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        for t in range(x // 7 % (turns + 1)):
            x = (x * 1103515245 + 12345) % 2**31
            rows.append((c, t, "user", "w " * (1 + x // 11 % kinds)))
    return rows


CASES = [
    (1, 0, "user", "hello there"), (1, 1, "assistant", "b c"), (2, 1, "assistant", "b c"), (2, 0, "user", "hello there"),
    (3, None, "user", "hello there"), (3, 5, "assistant", "other"), (4, 0, None, None), (5, 0, "", ""), (6, 0, "user", "hello there"),
    (7, 0, "use", "rhello there"), (None, 0, "user", "lost"), (8, 0, "a", "x"), (8, 0, "a", "x"), (9, 0, "b", "y"), (9, 0, "a", "x"), (-3, 0, "user", "hello there"),
]


def test_cases(spark):
    assert got(pt.trie(pt.sequences(table(spark, CASES)))) == brute(own_turns(CASES))


@pytest.mark.parametrize("parts", [1, 3, 40, 150])
def test_any_number_of_partitions(spark, parts):
    """Boundaries through copies, prefixes of each other and single sequences; over 64 partitions two rounds."""
    for seed, turns, kinds in ((1, 3, 2), (2, 9, 2), (3, 2, 40)):
        rows = made(240, seed, turns, kinds) + [(c, t, "user", f"w {t}") for c in range(1000, 1080) for t in range(5)]
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            assert got(pt.trie(pt.sequences(table(spark, rows)).coalesce(4))) == brute(own_turns(rows))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_conversations_as_the_contract_has_them(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(c + 5000 if c is not None else c, *r) for c, *r in CASES]
    assert got(pt.trie(pt.rebuilt(pt.sequences(table(spark, rows))))) == brute(rebuilt(own_turns(rows)))


def test_ids_of_one_conversation_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(pt, "CHUNK", 16)
    rows = [(c, 0, "user", "same") for c in range(500)]
    assert got(pt.trie(pt.sequences(table(spark, rows)))) == brute(own_turns(rows))


def test_long_conversation(spark):
    rows = [(c, t, "user", "a b") for c in (1, 2) for t in range(3000)] + [(3, t, "user", "a b") for t in range(1500)]
    out = got(pt.trie(pt.sequences(table(spark, rows))))
    assert len(out) == 3001 and out == brute(own_turns(rows))


def test_empty_table(spark):
    assert got(pt.trie(pt.rebuilt(pt.sequences(table(spark, []))))) == []
