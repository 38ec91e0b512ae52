"""The conversation trie against plain Python, level by level there."""

import hashlib
import random
import re
from zlib import crc32

import duckdb
import pytest

from tallyline.llm.conversation_trie import conversation_trie
from tallyline.llm.queries import ORACLE_SQL

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def expected(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            digest = hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest, role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    members, ends = {}, {}
    for c in own:
        base, h = c - (abs(c) % 20) * (1 if c > 0 else -1), crc32(str(c).encode()) % 4
        path = (own.get(base, [])[:h] if base in own else []) + own[c][h:]
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
        ends.setdefault(tuple(path), []).append(c)
    out = []
    for node, convs in members.items():
        children = [n for n in members if n and n[:-1] == node]
        below = [n for n in members if n[: len(node)] == node]
        leaves = [n for n in below if n in ends and not any(m[: len(n)] == n and len(m) > len(n) for m in members)]
        saved = sum((len(members[n]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) for n in below if n)
        text = ",".join(map(str, sorted(ends.get(node, []))))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children), len(leaves), saved, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows():
    rng = random.Random(11)
    texts = ["", None, "hello there", "one two three", "x", "tab\tand\nline"]
    out = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts)) for c in range(45, 130) if c not in (60, 80) for t in range(rng.randint(1, 6))]
    out += [(c, 0, "user", "first") for c in (*range(140, 180), -3, -20, -25, -41, 3, 0)] + [(c, 1, "assistant", "long " * 20_000) for c in (140, 141, 162)]
    out += [(None, 0, "user", "no id"), (200, None, "user", "null turn"), (200, 0, "user", "then"), (200, 0, "user", "tied"), (201, 1, "u", "same"), (201, 1, "u", "same")]
    return out + [(220, t, "user", f"deep {t}") for t in range(300)] + [(c, t, "user", f"deep {t}") for c in (223, 224) for t in range(3)]


def test_same_as_python(spark):
    table = rows()
    df = spark.createDataFrame([(*r, 1, "n") for r in table], "conv_id long, turn long, role string, text string, depth int, node string")
    for order in (df.repartition(6), df.orderBy("text", "conv_id").coalesce(2)):
        got = conversation_trie(order)
        assert got.columns == list(COLUMNS)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == expected(table)
    assert conversation_trie(df.limit(0)).collect() == []


def test_hot_first_turn(spark):
    """Very many conversations that share their turns: one row of the root for each family, and one digest."""
    df = spark.range(8000).selectExpr("id AS conv_id", "explode(array(0, 1)) AS turn", "'user' AS role", "'same text' AS text")
    got = {r.depth: r for r in conversation_trie(df).collect()}
    assert set(got) == {0, 1, 2} and {r.n_convs for r in got.values()} == {8000}
    assert got[2].ends_sha256 == hashlib.sha256(",".join(map(str, range(8000))).encode()).hexdigest()
    assert got[0].saved_tokens == 2 * 7999 * 2 and got[0].n_leaves == 1


@pytest.mark.parametrize("part", [rows()[:200], rows()])
def test_sql(spark, tmp_path, part):
    import pyarrow as pa
    import pyarrow.parquet as pq

    cols = list(zip(*part, strict=True))
    pq.write_table(pa.table({"conv_id": pa.array(cols[0], pa.int64()), "turn": pa.array(cols[1], pa.int64()), "role": pa.array(cols[2], pa.string()), "text": pa.array(cols[3], pa.string())}), tmp_path / "c.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c.parquet'")
    got = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE_SQL['op13_conversation_trie']})").fetchall()
    assert sorted(got, key=repr) == expected(part)
