"""Conversation prefix trie against a dictionary of prefixes: odd rows, ties, copies, long conversations, shard edges."""

import hashlib
import math
import random
import zlib

import pytest

from lodestone.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, id string, len string, strip string, shard string, n string"


def odd_rows():
    rng = random.Random(3)
    rows = []
    for c in [*range(-30, 40), *range(95, 160), *range(230, 260), 1000]:
        for t in range(rng.choice([0, 1, 2, 3, 4, 5, 6, 8, 8, 12, 13, 16, 20])):
            text = rng.choice(["a", "b", "", "é漢", None, "long " * 3]) if t > 2 else "hi"
            rows.append((c, rng.choice([t, t, t, None, 2]), rng.choice(["user", "assistant", None]), text))
    rows += [(None, 1, "user", "x"), (5, 1, "user", "x"), (5, 1, "user", "x"), (7, 1, "user", "w" * 100_000)]
    return rows + [(c, t, "u", f"same {t}") for c in range(300, 340) for t in range(9)]


def brute(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    leaves, saved, children = (dict.fromkeys(members, 0) for _ in range(3))
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
            leaves[k[:d]] += children[k] == 0
    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def talks(spark):
    return spark.createDataFrame([(*r, "i", "l", "s", "d", "n") for r in odd_rows()], SCHEMA).repartition(3)


@pytest.mark.parametrize("width,shard_rows", [(64, 1 << 15), (4, 25), (64, 40)])
def test_nodes_equal_brute_force(talks, width, shard_rows):
    got = trie.prefix_trie(*trie.rebuilt(talks), width=width, shard_rows=shard_rows)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(odd_rows())


def test_a_sequence_over_many_shards(spark):
    """Copies are dealt over shards; their one list of members is hashed as a stream."""
    rows = [(c * 100, t, "u", f"turn {t}") for c in range(300) for t in range(3)]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = trie.prefix_trie(*trie.rebuilt(talks), shard_rows=40)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_nothing_gives_no_node(talks):
    assert trie.conversation_trie(talks.where("false")).count() == 0
    assert trie.conversation_trie(talks.where("conv_id is null")).count() == 0
