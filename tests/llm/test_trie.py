"""The trie of conversations against one built turn by turn, with odd rows, long conversations and many equal ones."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tidemark.llm import queries, trie
from tidemark.operators import ranges

SCHEMA = "conv_id long, turn long, role string, text string"
SF = "/root/testdata/sf0.001"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()), role, text))
    own = {c: [x[1:] for x in sorted(ts)] for c, ts in own.items()}
    members = defaultdict(list)
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        seq = tuple(own.get(base, [])[:h] + ts[h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append((c, len(seq) == d))
    kids = defaultdict(list)
    for seq in members:
        if seq:
            kids[seq[:-1]].append(seq)
    sums = {}
    for seq in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", seq[-1][1])) if seq else 0
        own_saved = (len(members[seq]) - 1) * words
        sums[seq] = (sum(sums[k][0] for k in kids[seq]) or 1, own_saved + sum(sums[k][1] for k in kids[seq]))
    out = set()
    for seq, ms in members.items():
        ends = ",".join(map(str, sorted(c for c, end in ms if end)))
        out.add((min(ms)[0], len(seq), min(members[seq[:-1]])[0] if seq else None, len(ms), len(kids[seq]), *sums[seq], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def run(spark, rows, **more):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5).selectExpr("*", "1 as place", "'x' as sign", "2 as depth", "3 as words")
    placed = trie.turns(frame)
    from pyspark.sql import functions as F

    c = F.col("conv_id")
    out = trie.trie(*trie.branched(placed, c - c % 20, F.crc32(c.cast("string").cast("binary")) % 4, 3), **more)
    got = [tuple(r[c] for c in COLUMNS) for r in out.collect()]
    assert len(got) == len(set(got))
    return set(got)


def random_rows(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), -3, -20, -25, 10**12]:
        for k in range(rng.randrange(1, 7)):
            rows.append((c, rng.choice([k, k, k, None, 0]), rng.choice(["user", "assistant", None, ""]), rng.choice(["hi", "a b  c", "", None, " x y", "same first words here"])))
    rows += rows[:5] + [(None, 0, "user", "nobody's")] * 3
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_one_built_turn_by_turn(spark, seed):
    rows = random_rows(seed)
    assert run(spark, rows) == plain(rows)


def test_long_paths_go_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 4)
    rng = random.Random(3)
    rows = [(c, k, "user", f"t{k if k < 9 * (c % 3) else rng.randrange(3)} w") for c in range(0, 200, 20) for k in range(rng.randrange(1, 30))]
    assert run(spark, rows) == plain(rows)


def test_many_members_of_one_node_are_hashed_in_order(spark):
    rows = [(c * 20, k, "user", f"turn {k}") for c in range(150) for k in range(2)] + [(7, 0, None, None)]
    assert run(spark, rows, many=16) == plain(rows)


def test_without_turns_of_their_own_and_without_any_row(spark):
    rows = [(c, 0, "user", "x") for c in range(1, 20)]  # their base, 0, is absent: those that share a turn with it keep none
    got = run(spark, rows)
    assert got == plain(rows) and any(r[1] == 0 and r[7] != hashlib.sha256(b"").hexdigest() for r in got)
    assert run(spark, []) == set()


def test_places_over_several_ranges(spark):
    rng = random.Random(4)
    rows = [("hot", rng.randrange(50), i) for i in range(700)] + [(f"k{i % 37}", rng.randrange(9), 1000 + i) for i in range(300)]
    got = ranges.numbered(spark.createDataFrame(rows, "key string, n long, id long"), "key", ["n", "id"], "place", parts=9).collect()
    want, seen = {}, defaultdict(int)
    for key, _, i in sorted(rows):
        want[i], seen[key] = seen[key], seen[key] + 1
    assert {r.id: r.place for r in got} == want


def test_the_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert {tuple(r[c] for c in COLUMNS) for r in queries.op11_prefix_trie(spark, SF).collect()} == plain(rows)
