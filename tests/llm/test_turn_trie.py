import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from querymill.llm import radix as R
from querymill.llm import turn_trie as T
from querymill.session import Scratch
from tests.llm.helpers import LONG, words

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SF = "/root/testdata/sf0.001"


def brute_force(convs):
    """Rows of {conv_id: [(role, text), ...]}."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    rows = Counter()
    for node, ids in members.items():
        below = [n for n in members if n[:len(node)] == node]
        inner = {n[:-1] for n in members if n}
        saved = sum((len(members[n]) - 1) * len(words(n[-1][1])) for n in below if n)
        ends = sorted(c for c in ids if len(convs[c]) == len(node))
        rows[(
            min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), sum(len(n) == len(node) + 1 for n in below), sum(n not in inner for n in below), saved,
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        )] += 1
    return rows


def told(rows):
    """Conversations of rows (conv_id, turn, role, text), as the operator orders them."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            name = hashlib.md5(f"{len(role)}:{role}:{text}".encode()).hexdigest()
            convs[c].append(((turn is not None, turn or 0, role, name), (role, text)))
    return {c: [t for _, t in sorted(turns)] for c, turns in convs.items()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def random_rows(seed, n, texts, most):
    rng = random.Random(seed)
    return [(c, t, rng.choice(["user", "assistant"]), f"said {'x ' * rng.randrange(texts)}") for c in range(n) for t in range(rng.randrange(1, most))]


def built(df):
    return Counter(tuple(r) for r in df.select(COLUMNS).collect())


@pytest.mark.parametrize("stretch,piece", [(T.STRETCH, T.PIECE), (20, 2), (1, 1)])
def test_every_prefix_is_a_node(spark, monkeypatch, stretch, piece):
    """Also where prefixes, and whole conversations, span many trees."""
    monkeypatch.setattr(T, "STRETCH", stretch)
    monkeypatch.setattr(T, "PIECE", piece)
    rows = random_rows(1, 150, 2, 6) + [(c, t, "user", "the same") for c in range(200, 260) for t in range(3)]
    assert built(T.trie(Scratch(spark), T.sequences(frame(spark, rows)))) == brute_force(told(rows))


def test_odd_rows(spark):
    rows = [
        (1, None, None, None), (1, 3, "user", ""), (1, 3, "user", "tie"), (1, 3, "user", "tie"), (1, -2, "user", "a b"), (2, None, "", ""), (2, 0, "user", "a b"), (None, 1, "user", "a"),
        (-5, 1, "a:", "b"), (-6, 1, "a", ":b"), (7, 1, "user", LONG), (8, 1, "user", LONG), (8, 2, "user", "é漢\x0b\x85x"), (9, 1, "user", None),
    ]
    df = frame(spark, rows).withColumns({c: F.lit("own") for c in ("turns", "key", "words", "id", "segment")})
    assert built(T.trie(Scratch(spark), T.sequences(df))) == brute_force(told(rows))
    assert not built(T.trie(Scratch(spark), T.sequences(df.limit(0))))


def test_conversations_without_turns_belong_to_the_root(spark):
    rows = random_rows(2, 60, 3, 4)
    convs = T.sequences(frame(spark, rows))
    rebuilt = T.with_starts_of(Scratch(spark), convs.where("conv_id <> 20"), F.expr("conv_id - conv_id % 20"), F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4, 3)
    own = {c: t for c, t in told(rows).items() if c != 20}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    want = {c: own.get(c - c % 20, [])[:h[c]] + t[h[c]:] for c, t in own.items()}
    assert not all(want.values())
    assert built(T.trie(Scratch(spark), rebuilt)) == brute_force(want)


def test_one_long_conversation_beside_its_beginning(spark):
    rows = [(1, t, "user", str(t % 7)) for t in range(3000)] + [(2, t, "user", str(t % 7)) for t in range(1500)]
    got = T.trie(Scratch(spark), T.sequences(frame(spark, rows)))
    assert got.agg(F.count("*"), F.max("depth"), F.sum("n_convs"), F.max("n_leaves"), F.max("saved_tokens")).first() == (3001, 3000, 4502, 1, 1500)


@pytest.mark.parametrize("fanout", [3, 4, 5, 16, 17, 48, 49, 256])
def test_node_layouts_grow(fanout):
    bytes_ = random.Random(fanout).sample(range(256), fanout)
    tree = R.Tree()
    keys = sorted(bytes([9, b]) + bytes(R.WIDTH - 2) for b in bytes_)
    for i, key in enumerate(keys):
        tree.insert(key, i, [1])
    (fork,) = [n for _, n in tree.root.children.items()]
    room = {R.Listed: lambda: fork.children.room, R.Indexed: lambda: 48, R.Full: lambda: 256}[type(fork.children)]()
    assert fork.path == b"\x09" and room == next(r for r in (4, 16, 48, 256) if fanout <= r)
    assert [b for b, _ in fork.children.items()] == sorted(bytes_) and all(len(n.path) == R.WIDTH - 1 for _, n in fork.children.items())


def test_paths_without_branches_are_one_node():
    tree, ids = R.Tree(), [bytes([i]) * R.WIDTH for i in range(6)]
    tree.insert(b"".join(ids), 1, [1] * 6)
    tree.insert(b"".join(ids[:3]) + ids[5], 2, [1] * 4)
    (path,) = [n for _, n in tree.root.children.items()]
    assert path.path == b"".join(ids[:3]) and sorted(len(n.path) for _, n in path.children.items()) == [R.WIDTH, 3 * R.WIDTH]
    rows, spine = tree.report()
    assert not rows and sorted(s.depth for s in spine) == [0, 1, 2, 3, 4, 4, 5, 6]
