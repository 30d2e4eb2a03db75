"""The prefix trie against a dictionary of prefixes."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from shelfwise.llm.prefix_trie import TernaryTree, conversation_trie, medians, shard_nodes

COLUMNS = "conv_id long, turn long, role string, text string, ids string, seq long, key long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    """Sorted nodes of the conversations in (conv_id, turn, role, text) rows."""
    own = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            own[conv_id].append((turn is not None, turn or 0, sha(f"{len(role)}:{role}{text}"), role, text))
    own = {c: [t[3:] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        base = c - c % 20 if c >= 0 else -(-c - -c % 20)
        sequence = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(sequence) + 1):
            members[tuple(sequence[:d])].append(c)
        ends[tuple(sequence)].append(c)
    children = defaultdict(set)
    for p in members:
        if p:
            children[p[:-1]].add(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, held in members.items():
        words = len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(held) - 1) * words
            leaves[p[:d]] += not children[p]
    return sorted((
        (min(held), len(p), min(members[p[:-1]]) if p else None, len(held), len(children[p]), leaves[p], saved[p], sha(",".join(map(str, sorted(ends[p])))))
        for p, held in members.items()), key=repr)


def found(spark, rows, shard):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], COLUMNS).repartition(5)
    return sorted((tuple(r) for r in conversation_trie(df, shard).collect()), key=repr)


def some(seed, n, words=3):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "bot"]), " ".join("abc"[rng.randrange(3)] for _ in range(rng.randrange(words))))
            for c in range(n) for t in range(rng.randrange(1, 6))]


@pytest.mark.parametrize("shard", [1, 7, 10_000])
def test_random_conversations(spark, shard):
    rows = some(shard, 150)
    assert found(spark, rows, shard) == brute(rows)


def test_odd_rows(spark):
    """Null ids, numbers, roles and texts, equal numbers, repeated rows, negative ids, and conversations left without turns."""
    rows = [
        (0, 0, "user", "hi there"), (1, None, "user", "last"), (1, 1, None, "hi"), (1, 1, "user", None), (1, 1, "user", None), (None, 0, "user", "lost"),
        (2, 0, "user", "hi there"), (2, 0, "bot", "hi there"), (45, 3, "user", ""), (46, 0, "a", "b"), (47, 0, "a", "b"), (-7, 0, "x", "y z"), (-20, 0, "x", "  \t "),
        *[(c, 0, "user", "word " * 50_000) for c in (60, 61, 62)],
    ]
    assert found(spark, rows, 2) == brute(rows)


def test_a_third_of_all_conversations_alike(spark):
    """Conversations that are all equal end at one node, in several runs of ids; others share their first turn."""
    rows = [(20 * c, 0, "user", "same") for c in range(5000)] + [(20 * c, 1, "bot", str(c % 7)) for c in range(0, 5000, 2)]
    assert found(spark, rows, 3) == brute(rows)


def test_long_conversation(spark):
    rows = [(c, t, "user", f"{t} {c if t == 900 else ''}") for c in (0, 20, 40) for t in range(1000)]
    assert found(spark, rows, 1) == brute(rows)


def test_empty_table(spark):
    assert found(spark, [], 5) == []
    assert found(spark, [(None, 0, "user", "lost")], 5) == []


def test_medians_balance_the_tree():
    assert sorted(medians(100)) == list(range(100))
    tree = TernaryTree()
    for k in medians(1000):
        tree.path([k], add=True)
    deepest, level = 0, [tree.below[0]]
    while level := [n for node in level for n in (tree.less[node], tree.more[node]) if n]:
        deepest += 1
    assert deepest < 10 and sorted(d for _, _, d in tree.walk()) == [1] * 1000
    with pytest.raises(KeyError):
        tree.path([2000])


def test_shared_nodes_add_up():
    """Two ranges that share a prefix: what they say of it sums to the whole."""
    whole = shard_nodes([[1], [1, 2], [1, 3]], [[5], [5, 1], [5, 1]], [1, 1, 2], [4, 5, 6], ["x", "y", "z"], -1, -1)
    parts = [
        *shard_nodes([[1]], [[5]], [1], [4], ["x"], -1, 1), *shard_nodes([[1, 2], [1, 3]], [[5, 1], [5, 1]], [1, 2], [5, 6], ["y", "z"], 1, -1)]
    sums = defaultdict(lambda: [0] * 4)
    for row in parts:
        sums[row[3] if row[0] else (row[3], row[2])] = [a + b for a, b in zip(sums[row[3] if row[0] else (row[3], row[2])], row[5:9])]
    assert sorted(sums.values()) == sorted([*row[5:9]] for row in whole)
