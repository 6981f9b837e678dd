"""The prefix trie against a dictionary of prefixes, with tiny bands and shards; double arrays; long conversations."""

import hashlib
import zlib

import numpy as np
import pytest

from snapgrid.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, part int, n long, key string"


def rebuilt(rows, group=20, openings=4):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, key, role, text))
    own = {c: [(r, t) for *_, r, t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % openings, c - int(np.fmod(c, group))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(convs):
    """Nodes from a dictionary of prefixes; tokens are separated by ASCII blanks."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {p: 0 for p in members}
    for p in members:
        if p:
            kids[p[:-1]] += 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p, m in members.items():
        mine = (len(m) - 1) * len(p[-1][1].encode().split()) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += mine
    return sorted(
        (
            min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p],
            hashlib.sha256(",".join(str(c) for c in sorted(m) if len(convs[c]) == len(p)).encode()).hexdigest(),
        )
        for p, m in members.items()
    )


def rows_of(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def conversations(n=130, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(n):
        for turn in range(int(rng.integers(1, 9))):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", f"say {rng.integers(2)}" + " w" * int(rng.integers(2))))
    rows += [(1_000 + c, t, "user", f"same {t}") for c in range(40) for t in range(4)]  # many equal conversations
    rows += [(2_000, t, "user", f"long {t % 3}") for t in range(40)] + [(2_001, t, "user", f"long {t % 3}") for t in range(33)]
    rows += [(5, None, None, None), (5, None, "user", None), (5, 2, "x", "tie b"), (5, 2, "x", "tie a"), (5, 2, "x", "tie a")]
    rows += [(None, 0, "user", "nobody"), (-7, 0, "user", "say 0"), (-7, 1, "user", "say 1"), (3_001, 0, "u", "x"), (3_002, 0, "u", "x")]
    return [rows[k] for k in rng.permutation(len(rows))]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "k") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("band, shard", [(128, 20_000), (128, 40), (4, 20_000), (4, 25), (1, 3)])
def test_equals_a_dictionary_of_prefixes(spark, band, shard):
    rows = conversations()
    turns, convs = prefix_trie.with_openings(prefix_trie.numbered(table(spark, rows)))
    assert rows_of(prefix_trie.nodes(turns, convs, band, shard)) == brute(rebuilt(rows))


def test_some_conversations_are_turnless(spark):
    lost = [c for c in range(20, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 > 0][:3]
    rows = [(c, 0, "user", "only") for c in lost]
    turns, convs = prefix_trie.with_openings(prefix_trie.numbered(table(spark, rows)))
    got = rows_of(prefix_trie.nodes(turns, convs))
    assert got == brute(rebuilt(rows)) and len(got) == 1 and got[0][3] == 3


def test_empty(spark):
    turns, convs = prefix_trie.with_openings(prefix_trie.numbered(table(spark, conversations()).limit(0)))
    assert prefix_trie.nodes(turns, convs).count() == 0


def test_many_members_of_one_node(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS_AT_ONCE", 7)
    rows = [(20 * c, 0, "user", "hello") for c in range(500)]
    turns, convs = prefix_trie.with_openings(prefix_trie.numbered(table(spark, rows)))
    assert rows_of(prefix_trie.nodes(turns, convs)) == brute(rebuilt(rows))


def test_double_array_holds_its_sequences_and_no_other():
    rng = np.random.default_rng(1)
    seqs = {tuple(rng.integers(0, 30, rng.integers(0, 6)).tolist()) for _ in range(800)} | {()}
    listed = sorted(seqs)
    symbols = np.array([x for s in listed for x in s], dtype=np.int64)
    sizes = np.array([len(s) for s in listed])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    trie = prefix_trie.pack(np.full(len(listed), 30), symbols, starts, sizes, 31)

    def walk(seq):
        state = np.array([0])
        for x in (30, *seq):
            state = trie.step(state, np.array([x]))
        return int(state[0])

    prefixes = {s[:d] for s in seqs for d in range(len(s) + 1)}
    states = {p: walk(p) for p in prefixes}
    assert min(states.values()) > 0 and len(set(states.values())) == len(prefixes)
    for _ in range(2_000):
        s = tuple(rng.integers(0, 31, 4).tolist())
        assert (walk(s) > 0) == (s in prefixes)
    assert trie.end < 3 * len(prefixes)
