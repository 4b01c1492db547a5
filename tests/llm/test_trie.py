import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.llm import trie as T
from tests.oracle import compare

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def sequences(rows):
    """Rebuilt conversations as lists of (role, text)."""
    by = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[: 2 * T.KEY]
            by.setdefault(c, []).append((turn is not None, turn or 0, role, key, text))
    own = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in by.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(int(c / 100) * 100, [])[:h] + turns[h:]
    return out


def brute(by):
    members = {}
    for c, turns in by.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {p: 0 for p in members}
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(by[c]) == len(p)).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], ends(p)) for p, m in members.items())


def got(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


def some(rng, n, turns=4):
    rows = []
    for c in range(n):
        rows += [(c, k, rng.choice("ua"), "x" * rng.randint(0, 2), "") for k in range(rng.randint(1, turns))]
    return rows


@pytest.mark.parametrize("blocks", [1, 5, 40])
def test_against_brute_force(spark, monkeypatch, blocks):
    """Few distinct texts, so intervals reach over many blocks; runs of three ids are hashed as streams."""
    monkeypatch.setattr(T, "RUN", 3)
    rows = some(random.Random(blocks), 300, 7)
    df = spark.createDataFrame(rows, SCHEMA)
    conversations = T.rebuilt(T.conversation_turns(df))
    assert got(T.prefix_trie(conversations, blocks)) == brute(sequences(rows))


def test_odd_rows(spark, tmp_path):
    rng = random.Random(9)
    rows = some(rng, 40) + [(7, None, None, None, None), (7, None, "u", "", ""), (7, 0, None, "y", ""), (7, 0, None, "y", ""), (None, 1, "u", "z", ""), (250, 1, "u", "alone", "q"), (-130, 0, "u", "below", ""), (-100, 0, "a", "base", "")]
    rows += [(100 + k, t, "u", f"same {t}", "") for k in range(90) for t in range(8)] + [(300, t, "a", f"{t}" * 50, "") for t in range(400)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert got(T.op12_conversation_trie(spark, str(tmp_path))) == brute(sequences(rows))


def test_turnless_only_and_empty(spark, tmp_path):
    # conversations whose only turn is among those that their (missing) base would give
    ids = [c for c in range(101, 400) if c % 100 and zlib.crc32(str(c).encode()) % 6 > 0][:20]
    rows = [(c, 0, "u", "gone", "") for c in ids]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(T.prefix_trie(T.rebuilt(T.conversation_turns(df)), 3)) == [(ids[0], 0, -1, 20, 0, 1, 0, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())]
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    assert T.op12_conversation_trie(spark, str(tmp_path)).count() == 0


def test_common():
    a = bytes(range(96))
    for n in range(7):
        b = a[: n * T.KEY] + b"\xff" * T.KEY
        assert T.common(a, b) == T.common(b, a) == n if n < 6 else True
    assert T.common(a, a[:32]) == 2 and T.common(b"", a) == 0


def test_against_sql(spark):
    found, want = compare(spark, T.op12_conversation_trie, T.OP12_SQL, "/root/testdata/sf0.01")
    assert found == want and len(found[1]) > 300
