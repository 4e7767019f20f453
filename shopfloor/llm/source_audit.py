"""Divergence of the sources of each language, from a frequent-pattern tree of term rows.

Terms are counted per source where the texts are read, and the partial counts are summed by Spark.  A kept term's row
lists its nonzero counts in the order of the sources.  Equal rows are one row with a multiplicity; sorted rows form
a tree, in which a node is a source with a count below a path of such, and its multiplicity that of all rows through it.

For a pair of sources the sum of ``f`` over all terms is that of a term without occurrences, times the number of terms,
plus what each source's own counts change (one row per distinct count), plus what changes where both occur: a
correction for the counts of a node and of one of its ancestors, computed once for each such combination and multiplied
by the node's multiplicity.  So rows that share a path share its work, no term is paired with sources that lack
it, and any division of the rows into trees gives the same sum.

All numbers are integers.  Corrections in tasks are kept modulo 2^64, and the sum is again in range: over all terms
``f`` is below twice the square of 10^9 plus the number of terms.

Rules for unusual input
-----------------------
null text, lang, source   read as the empty text
very long text            counted as a whole
ties                      of equal values the item that is less as UTF-8 comes first
repeated rows             each counts
extra columns             ignored
empty table               empty result
no kept term              pairs have the value 0, no term rows
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import arrays
from .scratch import materialize

LEAST_DOCS = 3  # documents of a language that a kept term is in, at least
TOP = 200  # ranks of terms
SCALE = 1_000_000_000
COUNTED = 2 << 20  # bytes of text that are counted at once
CELLS = 500_000  # places of the matrix that a tree is made from, at most (one longer row stands alone)
BROADCAST_GROUPS = 200_000  # sources with their totals that may be broadcast; more are joined by a shuffle
WRAP = "cast(18446744073709551616 as decimal(38,0))"


def _bounded(df: DataFrame, groups: int) -> DataFrame:
    return F.broadcast(df) if groups <= BROADCAST_GROUPS else df


def sources(docs: DataFrame) -> DataFrame:
    """``(lang, source, lang_no, source_no, n_docs)`` of all that occur; numbers are places in their order."""
    found = docs.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n_docs"))
    langs = found.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("lang_no", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("lang")) - 1)
    # Large sources last: what begins a path is then rare and its counts are small, so that paths share more.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("n_docs", "source")) - 1
    return found.withColumn("source_no", place).join(langs.drop("n"), "lang")


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and sizes of the terms, maximal runs of letters in one text, and the mask of letters."""
    letter = (data >= 0x80) | ((data >= 97) & (data <= 122))
    first, last = letter.copy(), letter.copy()
    first[1:] &= ~letter[:-1]
    last[:-1] &= ~letter[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first[cuts], last[cuts - 1] = letter[cuts], letter[cuts - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1 - starts, letter


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang_no, source_no, term, n, n_docs)``: occurrences, and documents with the term.

    ``docs`` has ``lang_no``, ``source_no`` and ``text``.  Some megabytes of text at a time are counted by exact
    dictionaries; Spark sums these counts per task, then per key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in arrays.chunks(batches, "text", COUNTED):
            data = arrays.lower_ascii(data)
            starts, sizes, letter = _terms(data, offsets)
            if not len(starts):
                continue
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
            terms = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(data[letter])).dictionary_encode()
            code, known = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), terms.dictionary
            of = np.searchsorted(offsets, starts, "right") - 1
            where = [rows.column(rows.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lang_no", "source_no")]
            groups, group = np.unique(where[0] << 32 | where[1], return_inverse=True)
            size = len(known)
            pairs, times = np.unique(of * size + code, return_counts=True)  # a document and a term
            keys, place = np.unique(group[pairs // size] * size + pairs % size, return_inverse=True)
            n = np.zeros(len(keys), dtype=np.int64)
            np.add.at(n, place, times)
            own = groups[keys // size]
            yield pa.RecordBatch.from_arrays(
                [pa.array(own >> 32, pa.int32()), pa.array(own & 0xFFFFFFFF, pa.int32()), known.take(pa.array(keys % size)).cast(pa.string()), pa.array(n), pa.array(np.bincount(place).astype(np.int64))],
                ["lang_no", "source_no", "term", "n", "n_docs"],
            )

    parts = docs.select("lang_no", "source_no", "text").mapInArrow(run, "lang_no int, source_no int, term string, n long, n_docs long")
    return parts.groupBy("lang_no", "source_no", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs"))


def term_rows(counts: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """``(lang_no, term, path)`` of kept terms; ``path`` has ``(s, n)`` for each source with the term, in order."""
    rows = counts.groupBy("lang_no", "term").agg(F.sort_array(F.collect_list(F.struct(F.col("source_no").alias("s"), "n"))).alias("path"), F.sum("n_docs").alias("n_docs"))
    return rows.where(F.col("n_docs") >= least).drop("n_docs")


def _wide(x: str) -> str:
    return f"cast({x} as decimal(19,0))"


def share(n: str, total: str, terms: str) -> str:
    """SQL: the share of ``n`` occurrences, smoothed by one, in billionths plus one."""
    return f"(1 + {_wide(SCALE)} * {_wide(f'({n} + 1)')} div {_wide(f'nullif({total} + {terms}, 0)')})"


def divergence(p: str, q: str) -> str:
    """SQL: ``floor((p - q)^2 / q)`` of longs."""
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def _shares(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """``share`` of arrays, three digits at a time, so that nothing leaves 64 bits below 9 * 10^15 occurrences."""
    out, rest = (n + 1) // whole, (n + 1) % whole
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


class Tree:
    """The prefix tree of sorted rows of one language: ``flat`` items, row after row of ``sizes``.

    Column d of a row belongs to a new node where the row leaves the one before it at d or earlier; the rows up to the next
    such place go through that node.
    """

    def __init__(self, sizes: np.ndarray, s: np.ndarray, n: np.ndarray, whole: np.ndarray, times: np.ndarray):
        rows, depth = len(sizes), int(sizes.max()) if len(sizes) else 0
        here = np.arange(depth) < sizes[:, None]
        grid = lambda x, gap: (g := np.full((rows, depth), gap, dtype=np.int64), g.__setitem__(here, x))[0]
        self.s, self.n, self.whole = grid(s, -1), grid(n, 0), grid(whole, 1)
        same = np.zeros((rows, depth), dtype=bool)
        same[1:] = (self.s[1:] == self.s[:-1]) & (self.n[1:] == self.n[:-1]) & here[1:]
        self.new = here & ~np.logical_and.accumulate(same, axis=1)
        self.here, self.times, self.depth = here, times, depth

    def nodes(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows where the nodes of a depth begin, and their multiplicities."""
        first = np.flatnonzero(self.new[:, d])
        count = np.zeros(len(first), dtype=np.int64)
        inside = np.flatnonzero(self.here[:, d])
        np.add.at(count, np.searchsorted(first, inside, "right") - 1, self.times[inside])
        return first, count

    def corrections(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys ``s << 32 | t`` and values of every node with every ancestor, both ways, modulo 2^64; one sum by key for each pair of depths."""
        p, p0 = _shares(self.n, self.whole), _shares(np.zeros_like(self.n), self.whole)
        for d in range(1, self.depth):
            rows, times = self.nodes(d)
            for a in range(d):
                for x, y in ((d, a), (a, d)):
                    px, x0, qy, y0 = p[rows, x], p0[rows, x], p[rows, y], p0[rows, y]
                    yield _summed(self.s[rows, x] << 32 | self.s[rows, y], times * (_f(px, qy) - _f(px, y0) - _f(x0, qy) + _f(x0, y0)))


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, place = np.unique(keys, return_inverse=True)
    out = np.zeros(len(keys), dtype=np.int64)
    np.add.at(out, place, values)
    return keys, out


def pair_corrections(rows: DataFrame) -> DataFrame:
    """``(lang_no, s, t, value)``, partial sums; ``rows`` has ``lang_no, times, path`` with ``(s, n, whole)``, sorted in partitions."""

    def summed(lang: int, kept: list[tuple]) -> pa.RecordBatch:
        tree = Tree(*[np.concatenate(x) for x in zip(*kept)])
        parts = list(tree.corrections()) or [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        keys, out = _summed(*[np.concatenate(x) for x in zip(*parts)])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), lang), pa.int32()), pa.array(keys >> 32, pa.int32()), pa.array(keys & 0xFFFFFFFF, pa.int32()), pa.array(out)], ["lang_no", "s", "t", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, kept, held, deep = None, [], 0, 0
        for batch in batches:
            langs, times = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            path = batch.column(2)
            ends = np.asarray(path.offsets, dtype=np.int64)
            s, n, whole = (np.asarray(path.values.field(i), dtype=np.int64) for i in range(3))
            sizes = np.diff(ends)
            a = 0
            while a < len(sizes):
                b = a
                if kept and langs[a] != lang:
                    yield summed(lang, kept)
                    kept, held, deep = [], 0, 0
                lang = int(langs[a])
                while b < len(sizes) and langs[b] == lang and (held + b - a + 1) * max(deep, int(sizes[b])) <= CELLS:
                    deep = max(deep, int(sizes[b]))
                    b += 1
                if b == a and not kept:  # a row beyond the limit by itself
                    deep, b = int(sizes[a]), a + 1
                own = slice(ends[a], ends[b])
                if b > a:
                    kept.append((sizes[a:b], s[own], n[own], whole[own], times[a:b]))
                    held += b - a
                if b < len(sizes) and langs[b] == lang:  # the matrix is full
                    yield summed(lang, kept)
                    kept, held, deep = [], 0, 0
                a = b
        if kept:
            yield summed(lang, kept)

    return rows.select("lang_no", "times", "path").mapInArrow(run, "lang_no int, s int, t int, value long")


def _ranked(rows: DataFrame, top: int | None = None) -> DataFrame:
    w = Window.partitionBy("lang_no", "source_no").orderBy(F.col("value").desc(), "item")
    out = rows.withColumn("rank", F.row_number().over(w))
    return out if top is None else out.where(F.col("rank") <= top)


def audit(docs: DataFrame, top: int = TOP, least: int = LEAST_DOCS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how far each source is from each other one, and its most overused terms."""
    filled = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    known = materialize(sources(filled))
    n_groups = known.count()
    numbered = filled.join(_bounded(known.select("lang", "source", "lang_no", "source_no"), n_groups), ["lang", "source"])
    kept = materialize(term_rows(term_counts(numbered), least))

    long = kept.select("lang_no", "term", F.explode("path").alias("x")).select("lang_no", "term", F.col("x.s").alias("source_no"), "x.n")
    totals = long.groupBy("lang_no", "source_no").agg(F.sum("n").alias("total"))
    terms = kept.groupBy("lang_no").agg(F.count(F.lit(1)).alias("terms"))
    own = known.join(totals, ["lang_no", "source_no"], "left").join(terms, "lang_no", "left")
    own = own.withColumns({"total": F.coalesce("total", F.lit(0)), "terms": F.coalesce("terms", F.lit(0))})
    all_of = own.groupBy("lang_no").agg(F.sum("total").alias("lang_total"))
    group = materialize(own.join(all_of, "lang_no").select("lang_no", "source_no", "lang", "source", "total", "terms", "lang_total"))

    # Pairs: the value without occurrences, each side's own counts, and the tree's corrections.
    side = lambda x: group.select("lang_no", F.col("source_no").alias(x), F.col("total").alias(f"total_{x}"), *(["terms"] if x == "t" else []))
    pairs = side("s").join(side("t"), "lang_no").where("s != t")  # as many rows as the result has pairs
    zero = {x: share("0", f"total_{x}", "terms") for x in "st"}
    plain = pairs.selectExpr("lang_no", "s", "t", f"cast(coalesce({divergence(zero['s'], zero['t'])}, 0) as decimal(38,0)) * terms as value")
    distinct = long.groupBy("lang_no", "source_no", "n").agg(F.count(F.lit(1)).alias("times"))
    counted = distinct.join(_bounded(group.select("lang_no", "source_no", "total"), n_groups), ["lang_no", "source_no"])

    def alone(x: str, y: str) -> DataFrame:
        """Changes by the counts of ``x`` where ``y`` has none."""
        mine = counted.select("lang_no", F.col("source_no").alias(x), F.col("total").alias(f"total_{x}"), "n", "times")
        other = group.select("lang_no", F.col("source_no").alias(y), F.col("total").alias(f"total_{y}"), "terms")
        both = mine.join(_bounded(other, n_groups), "lang_no").where("s != t")
        here = zero | {x: share("n", f"total_{x}", "terms")}
        return both.selectExpr("lang_no", "s", "t", f"cast({divergence(here['s'], here['t'])} - {divergence(zero['s'], zero['t'])} as decimal(38,0)) * times as value")

    whole = group.groupBy("lang_no").agg(F.map_from_entries(F.collect_list(F.struct("source_no", F.col("total") + F.col("terms")))).alias("whole"))
    rows = kept.where(F.size("path") > 1).groupBy("lang_no", "path").agg(F.count(F.lit(1)).alias("times")).join(_bounded(whole, n_groups), "lang_no")
    rows = rows.select("lang_no", "times", F.transform("path", lambda x: F.struct(x["s"].alias("s"), x["n"].alias("n"), F.col("whole")[x["s"]].alias("whole"))).alias("path"))
    ordered = rows.repartitionByRange("lang_no", "path").sortWithinPartitions("lang_no", "path")
    corrected = pair_corrections(ordered).withColumn("value", F.col("value").cast("decimal(38,0)"))
    summed = plain.unionByName(alone("s", "t")).unionByName(alone("t", "s")).unionByName(corrected).groupBy("lang_no", "s", "t").agg(F.sum("value").alias("value"))
    exact = summed.selectExpr("lang_no", "s as source_no", "t as item_no", f"cast(pmod(value, {WRAP}) as bigint) as value")
    names = group.select("lang_no", F.col("source_no").alias("item_no"), F.col("source").alias("item"))
    pair_part = _ranked(exact.join(_bounded(names, n_groups), ["lang_no", "item_no"]).select("lang_no", "source_no", "item", "value")).withColumn("part", F.lit("pair"))

    # Terms: shares of a source against those of its language.
    of_lang = kept.select("lang_no", "term", F.expr("aggregate(path, 0L, (a, x) -> a + x.n)").alias("all_n"), F.explode("path").alias("x"))
    numbers = group.select("lang_no", "source_no", "total", "terms", "lang_total")
    placed = of_lang.select("lang_no", F.col("term").alias("item"), "all_n", F.col("x.s").alias("source_no"), "x.n").join(_bounded(numbers, n_groups), ["lang_no", "source_no"])
    shares = placed.selectExpr("lang_no", "source_no", "item", f"{share('n', 'total', 'terms')} as p", f"{share('all_n', 'lang_total', 'terms')} as q")
    over = shares.where("p > q").selectExpr("lang_no", "source_no", "item", f"{divergence('p', 'q')} as value")
    term_part = _ranked(over, top).withColumn("part", F.lit("term"))
    both = pair_part.unionByName(term_part).join(_bounded(group.select("lang_no", "source_no", "lang", "source"), n_groups), ["lang_no", "source_no"])
    return both.select("lang", "source", "part", "item", "value", "rank")


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_P = lambda n, total, v: f"(1 + (1000000000::hugeint * ({n} + 1)) // ({total} + {v}))"
_F = lambda p, q: f"((({p}) - ({q})) * (({p}) - ({q})) // ({q}))"
OP12_SQL = rf"""
with d as (select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') w from documents),
groups as (select distinct lang, source from d), tok as (select r, lang, source, unnest(w) term from d),
voc as (select lang, term from tok group by lang, term having count(distinct r) >= 3),
cnt as (select lang, source, term, count(*) n from tok semi join voc using (lang, term) group by all),
v as (select lang, count(*) v from voc group by lang), tot as (select lang, source, sum(n) total from cnt group by all),
g as (select groups.lang, groups.source, coalesce(total, 0) total, coalesce(v, 0) v from groups left join tot using (lang, source) left join v using (lang)),
gt as (select g.lang, g.source, voc.term, {_P("coalesce(n, 0)", "total", "v")} p, coalesce(n, 0) n from g join voc using (lang) left join cnt on cnt.lang = g.lang and cnt.source = g.source and cnt.term = voc.term),
lt as (select lang, term, sum(n) n from cnt group by all), ln as (select lang, sum(n) total from lt group by lang),
lp as (select lang, term, {_P("n", "total", "v")} q from lt join ln using (lang) join v using (lang)),
pairs as (select a.lang, a.source, b.source item, sum({_F("a.p", "b.p")}) as value from gt a join gt b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pair_all as (select a.lang, a.source, b.source item, coalesce(p.value, 0)::bigint as value from groups a join groups b on a.lang = b.lang and a.source <> b.source left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source),
terms as (select gt.lang, gt.source, gt.term item, {_F("p", "q")}::bigint as value from gt join lp using (lang, term) where n > 0 and p > q)
select lang, source, 'pair' part, item, value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from pair_all
union all select * from (select lang, source, 'term', item, value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from terms) where rank <= 200
"""
