"""Prefix trie of conversations: a skeleton of splitter paths, and shards that finish everything else.

A conversation is the path of its turns' digests.  Conversations are dealt to shards by ranges of (path, conv_id);
the bounds are splitters from a sample.  A node of which two shards have members is a prefix of the splitter between
them, so the trie of the splitters' paths, the skeleton, has all such nodes.  The skeleton is broadcast.  A shard
reads its rows in order with a stack of open nodes and finishes the nodes outside the skeleton; for those in it, it
gives partial sums, which are reduced by node and summed up along the skeleton.  As conversations of one path are
ordered by id, one path may fill many shards: any number of copies is split like everything else.

Identity: a turn is the first 128 bits of the SHA-256 of its role's length, role and text.

Rules for unusual input
-----------------------
null role or text      read as the empty text
null conv_id           names no conversation: such rows are in no node
null turn              comes first
equal turns            of one conversation are ordered by their digests
very long text         only its digest and length are kept
long conversations     one row of 24 bytes for each turn; those alike in more than ``DEEP`` turns are not split further
repeated rows          are turns each
extra columns          ignored
empty table            empty result, without a root
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

WIDTH = 16  # bytes of a turn's digest
PER_SHARD = 500_000  # conversations of a shard, about
SAMPLE = 32  # sampled conversations for each splitter
DEEP = 256  # turns of a splitter's path, at most
CHUNK = 1 << 20  # characters of ids that travel together
BROADCAST_NODES = 200_000  # skeleton nodes that may be broadcast; more are joined by a shuffle
GROUP, SHARED = 5, 9  # conversations that share a beginning, and one more than its longest turns
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
MADE = f"kind int, shard long, skeleton long, {NODE}, size long, chunk long, ends string"
NAMES = [f.split()[0] for f in MADE.split(", ")]
KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
FINISHED, PART, ENDS = 0, 1, 2
EMPTY = hashlib.sha256(b"").hexdigest()


def turns(rows: DataFrame) -> DataFrame:
    """``(conv_id, turns)``: of every conversation its turns in order, as ``(turn, digest, size)``."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH))
    each = rows.where("conv_id is not null").select("conv_id", F.struct("turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("size")).alias("x"))
    # Conversations that share a beginning are in one partition, so that they find it without a further shuffle.
    near = each.withColumn("base", F.expr(f"conv_id - conv_id % {GROUP}")).repartition("base")
    return near.groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))


def rebuilt(rows: DataFrame) -> DataFrame:
    """``(conv_id, path, sizes)``: each conversation with its first turns taken from the first of its group."""
    every = turns(rows)
    head = every.where("conv_id = base").select("base", F.slice("turns", 1, SHARED - 1).alias("head"))
    h = F.expr(f"cast(crc32(cast(conv_id as string)) % {SHARED} as int)")
    both = every.join(head, "base", "left").withColumn("h", h)
    taken = F.expr("concat(slice(coalesce(head, slice(turns, 1, 0)), 1, h), slice(turns, h + 1, greatest(size(turns) - h, 0)))")
    listed = both.select("conv_id", taken.alias("turns"))
    path = F.unhex(F.array_join(F.transform("turns", lambda x: F.hex(x["digest"])), ""))
    return listed.select("conv_id", path.alias("path"), F.transform("turns", lambda x: x["size"]).alias("sizes"))


class Skeleton:
    """The trie of the splitters' paths."""

    def __init__(self, paths: Iterable[bytes]):
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth = [-1], [0]
        for path in paths:
            at = 0
            for i in range(0, len(path), WIDTH):
                key = at, path[i : i + WIDTH]
                if key not in self.child:
                    self.child[key] = len(self.parent)
                    self.parent.append(at)
                    self.depth.append(self.depth[at] + 1)
                at = self.child[key]

    def line(self, node: int) -> list[int]:
        """The node and all above it."""
        out = []
        while node >= 0:
            out.append(node)
            node = self.parent[node]
        return out


def splitters(convs: DataFrame, shards: int) -> list[tuple[bytes, int]]:
    """Up to ``shards - 1`` bounds, from a sample of at most ``SAMPLE`` times as many conversations, by hash of their ids."""
    sample = convs.orderBy(F.xxhash64("conv_id"), "conv_id").limit(SAMPLE * shards).select(F.substring("path", 1, DEEP * WIDTH), F.when(F.length("path") <= DEEP * WIDTH, F.col("conv_id")).otherwise(-(1 << 63)))
    keys = sorted((bytes(p), c) for p, c in sample.collect())
    return sorted({keys[i * len(keys) // shards] for i in range(1, shards)}) if keys else []


class _Open:
    """A node whose rows are being read."""

    __slots__ = ("skeleton", "size", "first_row", "least", "children", "leaves", "saved", "done", "text", "held", "sha", "ended", "chunk")

    def __init__(self, skeleton: int, size: int, row: int):
        self.skeleton, self.size, self.first_row, self.least = skeleton, size, row, None
        self.children = self.leaves = self.saved = 0
        self.done: list[list] = []  # finished children that wait for this node's least member
        self.text: list[str] = []
        self.held, self.ended, self.chunk = 0, 0, 0
        self.sha = None if skeleton >= 0 else hashlib.sha256()


def shard_nodes(rows: Iterable[tuple[int, int, bytes, list[int]]], skeleton: Skeleton) -> Iterator[list]:
    """Rows of ``MADE`` from ``(shard, conv_id, path, sizes)`` in order of shard, path and id."""
    stack: list[_Open] = []
    number, shard, before = 0, None, b""

    def flush(node: _Open) -> list | None:
        """What has gathered of the ids that end at a node: hashed at once, or, in the skeleton, sent as a chunk."""
        if not node.text:
            return None
        text = ("," if node.ended and node.skeleton < 0 else "") + ",".join(node.text)
        node.ended, node.text, node.held = 1, [], 0
        if node.skeleton < 0:
            node.sha.update(text.encode())
            return None
        node.chunk += 1
        return [ENDS, shard, node.skeleton, None, None, None, None, None, None, None, None, node.chunk, text]

    def close() -> Iterator[list]:
        node = stack.pop()
        sent = flush(node)
        if sent:
            yield sent
        depth, n = len(stack), number - node.first_row
        for child in node.done:
            child[5] = node.least
            yield child
        if node.skeleton >= 0:
            yield [PART, shard, node.skeleton, node.least, depth, None, n, node.children, node.leaves, node.saved, node.size, None, None]
        else:
            leaves = node.leaves if node.children else 1
            saved = node.saved + (n - 1) * node.size
            above = stack[-1]
            made = [FINISHED, shard, above.skeleton, node.least, depth, None, n, node.children, leaves, saved, node.size, None, node.sha.hexdigest()]
            above.children += 1
            above.leaves += leaves
            above.saved += saved
            if above.skeleton >= 0:
                yield made
            else:
                above.done.append(made)
        if stack and (stack[-1].least is None or node.least < stack[-1].least):
            stack[-1].least = node.least

    for now, conv, path, sizes in rows:
        if now != shard:
            while stack:
                yield from close()
            shard, before = now, b""
            stack.append(_Open(0, 0, number))
        if path != before:
            common = 0
            while path[common : common + WIDTH] == before[common : common + WIDTH] and common < len(path) and common < len(before):
                common += WIDTH
            while len(stack) > common // WIDTH + 1:
                yield from close()
            for i in range(common, len(path), WIDTH):
                above = stack[-1].skeleton
                stack.append(_Open(skeleton.child.get((above, path[i : i + WIDTH]), -1) if above >= 0 else -1, sizes[i // WIDTH], number))
            before = path
        node = stack[-1]
        if node.least is None or conv < node.least:
            node.least = conv
        name = str(conv)
        node.text.append(name)
        node.held += len(name) + 1
        if node.held >= CHUNK:
            sent = flush(node)
            if sent:
                yield sent
        number += 1
    while stack:
        yield from close()


def _batched(rows: Iterator[list], size: int = 5_000) -> Iterator[pa.RecordBatch]:
    kinds = [KINDS[f.split()[1]] for f in MADE.split(", ")]
    held: list[list] = []
    chars = 0
    for row in rows:
        held.append(row)
        chars += len(row[-1] or "")
        if len(held) >= size or chars >= 4 * CHUNK:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], NAMES)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], NAMES)


def _hashed(chunks: DataFrame) -> DataFrame:
    """``(skeleton, ends_sha256)`` of chunks in order of shard and chunk, read as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        one = lambda: pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([sha.hexdigest()], pa.string())], ["skeleton", "ends_sha256"])
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column(0)[i].as_py()
                if own != node:
                    if node is not None:
                        yield one()
                    node, sha = own, hashlib.sha256()
                else:
                    sha.update(b",")
                sha.update(batch.column(1)[i].as_py().encode())
        if node is not None:
            yield one()

    ordered = chunks.repartition("skeleton").sortWithinPartitions("skeleton", "shard", "chunk")
    return ordered.select("skeleton", "ends").mapInArrow(run, "skeleton long, ends_sha256 string")


def trie(convs: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per node of the trie of ``convs(conv_id, path, sizes)``, with unique ids."""
    spark = convs.sparkSession
    convs = materialize(convs)
    if shards is None:
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-convs.count() // PER_SHARD))
    bounds = splitters(convs, shards)
    skeleton = Skeleton(p for p, _ in bounds)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect_right(bounds, (p, c)) for c, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *batch.columns], ["shard", *batch.schema.names])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*[batch.column(i).to_pylist() for i in range(4)]))
        return _batched(shard_nodes(rows, skeleton))

    placed = convs.select("conv_id", "path", "sizes").mapInArrow(place, "shard long, conv_id long, path binary, sizes array<long>")
    dealt = placed.repartition(shards, "shard").sortWithinPartitions("shard", "path", "conv_id")
    made = materialize(dealt.mapInArrow(work, MADE))

    line = spark.createDataFrame([(i, skeleton.parent[i], skeleton.depth[i], skeleton.line(i)) for i in range(len(skeleton.parent))], "skeleton long, above long, depth long, line array<long>")
    total = lambda c: F.sum(c).alias(c)
    parts = made.where(F.col("kind") == PART).groupBy("skeleton").agg(F.min("conv_id").alias("conv_id"), *[total(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], F.max("size").alias("size"))
    below = line.groupBy(F.col("above").alias("skeleton")).agg(F.count(F.lit(1)).alias("more"))
    own = parts.join(below, "skeleton", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    own = own.withColumns({"n_leaves": F.col("n_leaves") + (F.col("n_children") == 0).cast("long"), "saved_tokens": F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size")})
    own = own.join(line, "skeleton")
    sums = own.select(F.explode("line").alias("skeleton"), "n_leaves", "saved_tokens").groupBy("skeleton").agg(total("n_leaves"), total("saved_tokens"))
    ended = _hashed(made.where(F.col("kind") == ENDS))
    nodes = materialize(own.drop("n_leaves", "saved_tokens", "line").join(sums, "skeleton").join(ended, "skeleton", "left"))
    least = nodes.select(F.col("skeleton").alias("above"), F.col("conv_id").alias("least"))
    if len(skeleton.parent) <= BROADCAST_NODES:
        least = F.broadcast(least)
    columns = ["conv_id", "depth", F.coalesce("parent_conv_id", "least").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    inner = nodes.withColumns({"parent_conv_id": F.lit(None).cast("long"), "ends_sha256": F.coalesce("ends_sha256", F.lit(EMPTY))}).join(least, "above", "left")
    outer = made.where(F.col("kind") == FINISHED).withColumnsRenamed({"skeleton": "above", "ends": "ends_sha256"}).join(least, "above", "left")
    return inner.select(*columns).unionByName(outer.select(*columns))


def op13_conversation_trie(spark, sf_dir: str) -> DataFrame:
    return trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


# Bit by bit: each byte is followed by seven zeros, one for each further shift.
_CRC32 = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(c::varchar, ''), lambda x: [ascii(x)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)), 4294967295)"""
OP13_SQL = f"""
with t as (select conv_id c, row_number() over (partition by conv_id order by turn nulls first, x) k, x, strlen(coalesce(text, '')) size
  from (select *, sha256(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) x from conversations where conv_id is not null)),
h as (select c, {_CRC32} % {SHARED} h from (select distinct c from t)),
r as (select h.c, 0 own, k, x, size from h join t on t.c = h.c - h.c % {GROUP} and k <= h union all select h.c, 1, k, x, size from h join t on t.c = h.c and k > h),
p as (select h.c, coalesce(list(x order by own, k) filter (where x is not null), []) l, coalesce(list(size order by own, k) filter (where x is not null), []) s from h left join r on r.c = h.c group by h.c),
m as (select c, l, s, unnest(range(len(l) + 1)) d from p),
n as (select array_to_string(l[1:d], ',') id, any_value(l[1:d]) l, d as depth, min(c) conv_id, count(*) n_convs, coalesce(any_value(s[d]), 0) size, coalesce(string_agg(c::varchar, ',' order by c) filter (where len(l) = d), '') ends from m group by all),
u as (select *, case when depth > 0 then array_to_string(l[1 : depth - 1], ',') end above from n),
k as (select above id, count(*) n_children from u where depth > 0 group by above),
w as (select u.*, coalesce(n_children, 0) n_children from u left join k on k.id = u.id and k.id is not null),
b as (select l, depth, n_children, (n_convs - 1) * size saved, unnest(range(depth + 1)) a from w),
z as (select array_to_string(l[1:a], ',') id, a as depth, count(*) filter (where n_children = 0) n_leaves, sum(saved) saved_tokens from b group by all)
select w.conv_id::bigint conv_id, w.depth::bigint as depth, q.conv_id::bigint parent_conv_id, w.n_convs::bigint n_convs, w.n_children::bigint n_children, z.n_leaves::bigint n_leaves, z.saved_tokens::bigint saved_tokens, sha256(w.ends) ends_sha256
from w join z on z.id = w.id and z.depth = w.depth left join w q on w.above = q.id and q.depth = w.depth - 1
"""
