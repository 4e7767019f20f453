"""Benchmark decontamination by spaced seeds.

A mask looks at some positions of a 13-word window and ignores the others.  The 13 positions form four groups
and each mask ignores two of them, so any two substituted words fall into groups that some mask ignores: six
masks find every aligned window with at most two substitutions.  An item of 7 to 12 words is one window that bears one
substitution, found by two masks, its first half and its second, of which one is unchanged; shorter items match whole
and unchanged.  Masks of equal places serve items of several lengths, so that all lengths under 13 words ask for ten keys
of a place at most; longer items are looked for by a pass of their own, which keeps the generated code of each pass small
enough to be compiled.  Hits are checked word by word, and the windows of one alignment are put together.  Words are compared by 64-bit hashes with
a secret key of the run.  The overlap so found ends where it must: the word after it (or before it) differs
or is missing, as an equal one would have made one more window.

Everything is DataFrame functions; no Python runs on the executors.

Rules for unusual input
-----------------------
null or empty text         no words, no match, on either side
very long text             its windows are rows; no array of its words is shuffled
items under 13 words       searched as a whole, with ``allowed`` substitutions, down to one word; marked as ``short``
empty items                match nothing
null ids                   kept as they are: a null doc_id or item_id can match
ties, repeated rows        every row of ``docs`` is matched by itself, but equal results appear once
extra columns              ignored by ``matches``; ``clean`` keeps them
empty table                no match on either side; ``clean`` then keeps all rows
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize
from .words import keyed, lower_ascii, new_key, words

SPAN = 13  # words in a window
SUBSTITUTIONS = 2  # at most, in a window
LEAST = 5  # words of the shortest item for which ``clean`` drops a document: fewer are ordinary text
BROADCAST_ROWS = 200_000  # seeds of up to 150 bytes that may be broadcast; more are joined by a shuffle
BROADCAST_IDS = 1_000_000  # ids that may be broadcast
GROUPS = ((0, 4, 8, 12), (1, 5, 9), (2, 6, 10), (3, 7, 11))
MASKS = tuple(tuple(p for g in range(4) if g not in out for p in GROUPS[g]) for out in combinations(range(4), 2))


def allowed(n: int) -> int:
    """Substitutions that a window of ``n`` words bears."""
    return SUBSTITUTIONS * n // SPAN


def _masks(n: int) -> tuple[tuple[int, ...], ...]:
    """Positions of a window of ``n`` words that each mask looks at."""
    if n >= SPAN:
        return MASKS
    return (tuple(range(n // 2)), tuple(range(n // 2, n // 2 * 2))) if allowed(n) else (tuple(range(n)),)


def _hashes(text: Column, key: int) -> Column:
    return F.transform(words(lower_ascii(text)), lambda w: keyed(key, w))


def _keys(array: str, at: Column, masks: Iterable[tuple[int, ...]]) -> Column:
    """Keys of the words from a place on, one for each mask; different masks have different keys."""
    return F.array(*[F.xxhash64(F.lit(sum(1 << p for p in mask)), *[F.get(F.col(array), at + p) for p in mask]) for mask in masks])


def seeds(items: DataFrame) -> DataFrame:
    """``(key, window, item_id, ipos)`` for every mask and window of every item; a short item is one window."""
    last = F.greatest(F.size("b") - SPAN, F.lit(0))
    at = items.select("item_id", "b", F.explode(F.sequence(F.lit(0), last)).alias("ipos"))
    keys = F.when(F.size("b") >= SPAN, _keys("b", F.col("ipos"), MASKS))
    for n in range(1, SPAN):
        keys = keys.when(F.size("b") == n, _keys("b", F.lit(0), _masks(n)))
    return at.select(F.explode(keys).alias("key"), F.slice("b", F.col("ipos") + 1, F.lit(SPAN)).alias("window"), "item_id", "ipos")


def _items(benchmark: DataFrame, text: str, key: int, least: int = 1) -> DataFrame:
    return benchmark.select("item_id", _hashes(F.col(text), key).alias("b")).where(F.size("b") >= least)


def _parts(table: DataFrame) -> list[tuple[DataFrame, list[int]]]:
    """Seeds of whole windows and those of short items, each with the lengths of their windows; what does not occur is left out."""
    span = F.size("window")
    found = sorted(r[0] for r in table.select(span.alias("n")).distinct().collect())  # at most SPAN
    short = [n for n in found if n < SPAN]
    parts = [(table.where(span < SPAN), short)] if short else []
    return parts if short == found and found else [*parts, (table.where(span == SPAN), [SPAN])]


def _hits(docs: DataFrame, table: DataFrame, lengths: list[int], text: str, key: int) -> DataFrame:
    """``(doc_id, pos, span, ...)``: windows of documents that hold those of ``table(key, window, ...)``, word by word.

    ``lengths`` are those of the table's windows.  Seeds are broadcast up to ``BROADCAST_ROWS``, so of the documents nothing
    is shuffled; beyond it, keys are shuffled to the seeds with the words of their window.
    """
    few = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    masks = sorted({mask for n in lengths for mask in _masks(n)})
    at = docs.select("doc_id", _hashes(F.col(text), key).alias("d")).select("doc_id", "d", F.posexplode("d").alias("pos", "first"))
    pos, span = F.col("pos"), F.size("window")
    at = at.where(F.size("d") - pos >= min(lengths))
    # Comparisons stay in generated code: a join condition outside it would copy the document's array for every probe.
    equal = lambda words, at: sum(F.coalesce((F.get(words, at + k) == F.get("window", F.lit(k))).cast("int"), F.lit(0)) for k in range(max(lengths)))
    enough = span - F.floor(span * SUBSTITUTIONS / SPAN)
    if few:
        both = at.select("doc_id", "d", "pos", F.explode(_keys("d", pos, masks)).alias("key")).join(F.broadcast(table), "key")
        found = both.where((F.size("d") - pos >= span) & (equal(F.col("d"), pos) >= enough))
    else:
        own = at.select("doc_id", "pos", F.slice("d", pos + 1, F.lit(max(lengths))).alias("own"), _keys("d", pos, masks).alias("keys"))
        both = own.select("doc_id", "pos", "own", F.explode("keys").alias("key")).join(table.hint("merge"), "key")
        found = both.where((F.size("own") >= span) & (equal(F.col("own"), F.lit(0)) >= enough))
    return found.select("doc_id", "pos", span.alias("span"), *[c for c in table.columns if c not in ("key", "window")])


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, start, end, n_windows, short)``: one row for each document, item and alignment with a match.

    Words ``start`` to ``end`` (exclusive) of the document hold the matching windows, of which there are ``n_windows``;
    ``short`` says that the item has fewer words than a window, so that such matches can be left aside.  A short item is one
    window, so its matches are made distinct and need no further sums.
    """
    key = new_key()
    made = []
    for table, lengths in _parts(seeds(_items(benchmark, item_text, key))):
        found = _hits(docs, table, lengths, text, key)
        if lengths == [SPAN]:
            windows = found.select("doc_id", "item_id", (F.col("pos") - F.col("ipos")).alias("shift"), "pos").distinct()
            runs = windows.groupBy("doc_id", "item_id", "shift").agg(F.min("pos").alias("start"), (F.max("pos") + SPAN).alias("end"), F.count(F.lit(1)).alias("n_windows"))
            runs = runs.withColumn("short", F.lit(False))
        else:
            windows = found.groupBy("doc_id", "item_id", "pos").agg(F.max("span").alias("span"))
            runs = windows.select("doc_id", "item_id", F.col("pos").alias("start"), (F.col("pos") + F.col("span")).alias("end"), F.lit(1).cast("long").alias("n_windows"), F.lit(True).alias("short"))
        made.append(runs.select("doc_id", "item_id", F.col("start").cast("long"), F.col("end").cast("long"), "n_windows", "short"))
    return made[0] if len(made) == 1 else made[0].unionByName(made[1])


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_text: str = "text", least: int = LEAST) -> DataFrame:
    """The rows of ``docs``, columns as they are, whose document matches no item of ``least`` words or more.

    A window that many items share is looked for once, and ids of matching documents are made distinct before they
    are shuffled.  Up to ``BROADCAST_IDS`` of them are broadcast, so that texts are not shuffled; more are joined by a
    shuffle.
    """
    key = new_key()
    table = seeds(_items(benchmark, item_text, key, least)).select("key", "window").distinct()
    found = [_hits(docs, part, lengths, text, key).select(F.col("doc_id").alias("_dirty")).distinct() for part, lengths in _parts(table)]
    dirty = materialize(found[0] if len(found) == 1 else found[0].unionByName(found[1]).distinct())
    if dirty.count() <= BROADCAST_IDS:
        dirty = F.broadcast(dirty)
    return docs.join(dirty, docs["doc_id"].eqNullSafe(dirty["_dirty"]), "left_anti")


def op2_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def short_items(benchmark: DataFrame, text: str = "text") -> DataFrame:
    """Every item cut to its first 1 to 12 words, by its id."""
    first = F.slice(words(F.col(text)), 1, (1 + F.pmod("item_id", F.lit(SPAN - 1))).cast("int"))
    return benchmark.select("item_id", F.array_join(first, " ").alias(text))


def short_item_matches(spark, sf_dir: str) -> DataFrame:
    """Operator 2 on items of 1 to 12 words, of which the benchmark has none."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return matches(docs, short_items(spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
