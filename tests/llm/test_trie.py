import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from tallyframe.llm import trie
from tallyframe.llm.queries import BASE, HEAD

SCHEMA = "conv_id long, turn long, role string, text string"


def rebuilt(rows, head=True):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append(((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()), role, text))
    plain = {c: [x[1:] for x in sorted(v)] for c, v in convs.items()}
    if not head:
        return plain
    out = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = plain.get(c - c % 5, [])[:h] + own[h:]
    return out


def plain_trie(convs):
    members = defaultdict(list)
    for c, s in convs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[x] for x in children[node])
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
    out = []
    for node, cs in members.items():
        ends = hashlib.sha256(",".join(str(c) for c in sorted(cs) if len(convs[c]) == len(node)).encode()).hexdigest()
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children[node]), leaves[node], saved[node], ends))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select(*(c.split()[0] for c in trie.NODE.split(", "))).collect()), key=repr)


def talk(n=160, seed=1):
    """Conversations that share first turns, many of them wholly equal; gaps in ids; null turns, roles and texts; turns that repeat."""
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        if c % 17 == 5:
            continue
        kind = rnd.randrange(4)
        length = rnd.randrange(1, 14)
        for t in range(length):
            text = f"shared {kind} {t} é" if t < 4 or kind == 0 else rnd.choice([f"{c} {t}", "again", "ein Wort", None])
            rows.append((c, t if t or c % 3 else None, ("user", "assistant", None)[t % 3], text))
        if c % 9 == 0:
            rows.append((c, length, "user", "twice"))
            rows.append((c, length, "user", "twice"))
    return [*rows, (None, 0, "user", "nobody"), (10**12 + 3, 7, None, None)]


@pytest.mark.parametrize("local, head", [(40, True), (150, False), (20_000, True)])
def test_brute_force(spark, local, head):
    """However small the buckets that one task finishes."""
    rows = talk()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = trie.prefix_trie(df, HEAD, BASE, local) if head else trie.prefix_trie(df, local=local)
    assert got(found) == plain_trie(rebuilt(rows, head))


def test_equal_conversations_and_long_ones(spark):
    """Hundreds of equal conversations, long chains, one that is another's beginning."""
    rows = [(c, t, "user", f"turn {t}") for c in range(300) for t in range(6)]
    rows += [(c, t, "user", f"turn {t}") for c in (1000, 1001) for t in range(900 if c == 1000 else 899)]
    df = spark.createDataFrame(rows, SCHEMA)
    for local in (100, 20_000):
        assert got(trie.prefix_trie(df, local=local)) == plain_trie(rebuilt(rows, False))


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trie.prefix_trie(empty, HEAD, BASE).count() == 0
    rows = [(8, None, None, None), (8, None, None, None), (8, 1, "a", "bc"), (9, 1, "ab", "c")]
    clash = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", bucket string, depth int")
    assert got(trie.prefix_trie(clash)) == plain_trie(rebuilt(rows, False))
    # A conversation all of whose turns another gives, which isn't there, has none and is a member of the root alone.
    taken = next(c for c in range(1, 1000) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    one = [(taken, 0, "user", "gone")]
    assert got(trie.prefix_trie(spark.createDataFrame(one, SCHEMA), HEAD, BASE)) == plain_trie(rebuilt(one)) == [(taken, 0, None, 1, 0, 1, 0, hashlib.sha256(str(taken).encode()).hexdigest())]
