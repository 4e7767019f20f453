"""Operator 13 against a plain version, with more shards than paths and with one path in many shards."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from shopfloor.llm import prefix_trie as pt

KIND = "conv_id long, turn long, role string, text string, path string, size int"


def plain_paths(rows):
    digest = lambda t: hashlib.sha256(f"{len(t[0].encode())}:".encode() + (t[0] + t[1]).encode()).digest()[:16]
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn, (role or "", text or "")))
    for turns in own.values():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, digest(x[1])))
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = [t for _, t in own.get(c - c % 5, [])[:h] + turns[h:]]
    return out


def plain(paths):
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out = []

    def walk(node):
        leaves, saved = (0, 0) if children[node] else (1, 0)
        for x in children[node]:
            more = walk(x)
            leaves, saved = leaves + more[0], saved + more[1]
        saved += (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        ends = ",".join(map(str, sorted(c for c in members[node] if len(paths[c]) == len(node))))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if paths:
        walk(())
    return sorted(out, key=str)


def made(seed, n=200):
    rnd = random.Random(seed)
    say = lambda: (rnd.choice(["user", "user", None, "bot"]), rnd.choice(["hi", "Hällo", "", None, "x" * 300, f"t{rnd.randrange(9)}"]))
    rows, common = [], [say() for _ in range(12)]
    for c in range(n):
        if c % 7 == 0:
            continue
        turns = common[: rnd.randrange(12)] if c % 3 else []
        turns = turns + [say() for _ in range(rnd.randrange(5))] or [say()]
        rows += [(c, k, *t) for k, t in enumerate(turns)]
    rows += [(None, 1, "user", "lost"), (3, None, "user", "first"), (3, None, "bot", "first"), (8, 2, "bot", "again"), (8, 2, "bot", "again"), (8, 2, "user", "again")]
    rows += [(1000 + c, k, *t) for c in range(150) for k, t in enumerate(common[:10])]  # a group of copies
    rows += [(5000, k, "user", f"{k % 3}") for k in range(400)] + [(5002, k, "user", f"{k % 3}") for k in range(400)]
    rnd.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*r, "p", 1) for r in rows], KIND).repartition(3)


@pytest.mark.parametrize("shards", [1, 4, 60])
def test_equals_the_plain_version(spark, shards):
    rows = made(shards)
    convs = pt.rebuilt(table(spark, rows))
    wanted = plain_paths(rows)
    assert {r.conv_id: len(r.path) // 16 for r in convs.collect()} == {c: len(p) for c, p in wanted.items()}
    assert sorted((tuple(r) for r in pt.trie(convs, shards).collect()), key=str) == plain(wanted)


def test_small_chunks_shallow_splitters_and_joins_without_broadcast(spark, monkeypatch):
    for name, value in (("CHUNK", 8), ("DEEP", 3), ("BROADCAST_NODES", 0)):
        monkeypatch.setattr(pt, name, value)
    rows = made(7)
    # Functions that run in tasks read the constants of their own process, so the shards are walked here.
    convs = [(r.conv_id, bytes(r.path), list(r.sizes)) for r in pt.rebuilt(table(spark, rows)).collect()]
    assert sorted((tuple(r) for r in pt.trie(spark.createDataFrame(convs, "conv_id long, path binary, sizes array<long>"), 20).collect()), key=str) == plain(plain_paths(rows))
    ordered = sorted((0, c, p, s) for c, p, s in convs)
    ordered.sort(key=lambda x: (x[2], x[1]))
    found = list(pt.shard_nodes(ordered, pt.Skeleton([])))
    finished = [(r[3], r[4], r[6], r[7], r[8], r[9], r[12]) for r in found if r[0] == pt.FINISHED]
    assert sorted(finished, key=str) == sorted(((x[0], x[1], *x[3:]) for x in plain(plain_paths(rows)) if x[1]), key=str)
    ends = [r[12] for r in found if r[0] == pt.ENDS]
    assert [r[0] for r in found].count(pt.PART) == 1 and ",".join(ends) == ",".join(str(c) for _, c, p, _ in ordered if not p)


def test_every_node_of_two_shards_is_in_the_skeleton():
    rnd = random.Random(2)
    keys = sorted({(b"".join(bytes([rnd.randrange(3)]) * 16 for _ in range(rnd.randrange(7))), c) for c in range(400)})
    bounds = keys[25::25]
    skeleton = pt.Skeleton(p for p, _ in bounds)
    shards = defaultdict(set)
    for path, c in keys:
        node = 0
        for d in range(0, len(path) + 1, 16):
            node = skeleton.child.get((node, path[d - 16 : d]), -1) if d and node >= 0 else node
            shards[path[:d], node].add(sum((path, c) >= b for b in bounds))
    assert all(node >= 0 for (_, node), where in shards.items() if len(where) > 1)


def test_no_turns_and_empty_table(spark):
    assert pt.trie(pt.rebuilt(table(spark, [(None, 1, "user", "x")]))).count() == 0
    # Conversation 2 has one turn, fewer than its 5 given ones, and there is no conversation 0.
    assert zlib.crc32(b"2") % 9 > 1
    empty = hashlib.sha256(b"2").hexdigest()
    assert [tuple(r) for r in pt.trie(pt.rebuilt(table(spark, [(2, 0, "user", "x")]))).collect()] == [(2, 0, None, 1, 0, 1, 0, empty)]
