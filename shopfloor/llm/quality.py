"""Quality rules: text statistics and a decision list learned from labelled documents.

The statistics and the rules are column expressions; no Python runs on the executors.  The list is fitted on
the driver from the statistics of at most ``SAMPLE`` labelled documents, whether or not the base rule rejects them, so
that it says by itself what bad documents look like.

Rules for unusual input
-----------------------
null or empty text     all counts are 0, the document fails the base rule
very long text         one row like any other; the windows of a text are hashed and sorted within its row
null doc_id or label   scored like any other, but never a training row
several labels         a document counts as bad if any label says so
repeated rows          each row is scored by itself
ties                   of equally good tests, the first by feature and threshold is taken
no usable label        the list is empty; only the base rule rejects
extra columns          kept, unless their name starts with ``_q_`` or is one of the columns that ``judge`` adds
empty table            empty result
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import SPACES, UPPER, new_key, words

SAMPLE = 8000  # labelled documents that the list is fitted on, at most
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = {
    "words": "cast(n_words as double)",
    "mean_word": "word_chars / greatest(n_words, 1L)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1L)",
    "repeated_lines": "n_dup_lines / greatest(_q_lines, 1L)",
    "repeated_words": "n_repeat_words / greatest(n_words, 1L)",
    "capitals": "_q_upper / greatest(word_chars, 1L)",
    "digits": "_q_digits / greatest(word_chars, 1L)",
    "marks_per_word": "_q_marks / greatest(n_words, 1L)",
    "words_per_line": "n_words / greatest(_q_lines, 1L)",
}
HELPERS = ("_q_lines", "_q_upper", "_q_digits", "_q_marks")


MARKS = ".,;:!?"
_KINDS = ((UPPER, "A"), ("0123456789", "0"), (MARKS, "."), (SYMBOLS, "#"))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of ``COUNTS`` and the helper counts of ``HELPERS`` to every row.

    One pass over the characters turns each into its kind; the kinds are counted after.  Only texts with equal 3-word
    windows sort the hashes of their windows, so that equal ones are neighbours: n log n steps for n words.
    """
    df = docs.withColumn("_q_text", F.coalesce(F.col(text), F.lit("")))
    kinds = F.translate("_q_text", "".join(k for k, _ in _KINDS) + SPACES, "".join(m * len(k) for k, m in _KINDS))
    df = df.withColumns({"_q_words": words(F.col("_q_text")), "_q_split": F.filter(F.split("_q_text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""), "_q_kinds": kinds})
    count = lambda mark: (F.octet_length("_q_kinds") - F.octet_length(F.replace("_q_kinds", F.lit(mark), F.lit("")))).cast("long")
    upper, digits, marks, symbols = (count(m) for _, m in _KINDS)
    key = f"cast('{new_key()}' as bigint)"  # windows are told apart by 64-bit hashes with a secret key of the run
    df = df.withColumns({
        "n_words": F.size("_q_words").cast("long"),
        "word_chars": F.length("_q_kinds").cast("long"),
        "n_symbols": symbols,
        "n_dup_lines": (F.size("_q_split") - F.size(F.array_distinct("_q_split"))).cast("long"),
        "_q_lines": F.size("_q_split").cast("long"),
        "_q_upper": upper, "_q_digits": digits, "_q_marks": marks,
        "_q_hash": F.expr(f"case when size(_q_words) < 3 then cast(array() as array<bigint>) else transform(sequence(0, size(_q_words) - 3), i -> xxhash64({key}, _q_words[i], _q_words[i + 1], _q_words[i + 2])) end"),
    })
    df = df.drop("_q_text", "_q_words", "_q_split", "_q_kinds")
    # A generated row keeps later filters above it; pushed further down, they would hash the windows once per window.
    made = [*COUNTS[:-1], *HELPERS, "_q_hash"]
    df = df.select(*[c for c in df.columns if c not in made], F.inline(F.array(F.struct(*made))))
    grams = "case when size(_q_hash) = size(array_distinct(_q_hash)) then cast(array() as array<struct<h:bigint,i:int>>) else sort_array(transform(_q_hash, (h, i) -> named_struct('h', h, 'i', i))) end"
    df = df.withColumn("_q_grams", F.expr(grams)).drop("_q_hash")
    df = df.select(*[c for c in df.columns if c != "_q_grams"], F.inline(F.array(F.struct("_q_grams"))))
    df = df.withColumn("_q_twice", F.expr("filter(_q_grams, (g, k) -> (k > 0 and get(_q_grams, k - 1).h = g.h) or coalesce(get(_q_grams, k + 1).h = g.h, false))"))
    df = df.withColumn("n_repeat_words", F.expr("cast(size(array_distinct(flatten(transform(_q_twice, g -> array(g.i, g.i + 1, g.i + 2))))) as bigint)"))
    return df.drop("_q_grams", "_q_twice")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """Reject where every test ``(feature, above, threshold)`` holds: value >= threshold if above, else value < threshold."""

    tests: tuple[tuple[str, bool, float], ...]
    bad: int
    good: int

    def column(self) -> Column:
        out = F.lit(True)
        for feature, above, threshold in self.tests:
            value = F.expr(FEATURES[feature])
            out = out & (value >= threshold if above else value < threshold)
        return out

    def holds(self, x: dict[str, float]) -> bool:
        return all((x[f] >= t) == above for f, above, t in self.tests)

    def __str__(self) -> str:
        return " and ".join(f"{f} {'>=' if a else '<'} {t:.6g}" for f, a, t in self.tests)


def thresholds(values: list[float], bad: list[bool], most: int) -> list[float]:
    """Cuts between neighbouring distinct values, where the best one for some class mixture must be: not inside a stretch of one class.

    Of more than ``most`` cuts, every so manieth is kept.
    """
    kinds: dict[float, set[bool]] = {}
    for v, b in zip(values, bad):
        kinds.setdefault(v, set()).add(b)
    distinct = sorted(kinds)
    cuts = [(u + v) / 2 for u, v in zip(distinct, distinct[1:]) if len(kinds[u] | kinds[v]) > 1]
    return cuts if len(cuts) <= most else [cuts[len(cuts) * k // most] for k in range(most)]


def needed(parts: tuple[tuple[tuple[str, bool, float], int], ...], rows: int) -> list[tuple[tuple[str, bool, float], int]]:
    """The tests of ``parts`` but for those without which the others hold for the same ``rows``, the last ones first."""

    def covered(some: list) -> int:
        out = rows
        for _, mask in some:
            out &= mask
        return out

    kept = list(parts)
    for part in reversed(parts):
        others = [x for x in kept if x is not part]
        if others and covered(others) == covered(kept):
            kept = others
    return kept


def learn(rows: list[tuple[dict[str, float], bool]], max_rules: int = 12, max_tests: int = 4, cuts: int = 100, least_precision: float = 0.98, least_bad: int = 5, max_tries: int = 20) -> list[Rule]:
    """Sequential covering for the bad class.

    Two thirds of the rows grow a rule test by test for the largest information gain, the last third prunes it to what
    it was after one of its steps; rows that a rule covers are taken out before the next one.  A stricter threshold on a
    feature and side takes the place of the one before it, and a test without which the rule covers the same rows goes.
    A step counts only if the rule is right at least ``least_precision`` of the time then, on all rows and on the pruning
    rows, and covers ``least_bad`` bad rows.  Where none does, no rule begins with that first test again; after
    ``max_tries`` of these the list ends.  Row sets are bit sets in integers.
    """
    everything = (1 << len(rows)) - 1
    bad = sum(1 << i for i, (_, is_bad) in enumerate(rows) if is_bad)
    prune = sum(1 << i for i in range(0, len(rows), 3))
    tests = []
    for f in FEATURES:
        for t in thresholds([x[f] for x, _ in rows], [b for _, b in rows], cuts):
            at_least = sum(1 << i for i, (x, _) in enumerate(rows) if x[f] >= t)
            tests += [((f, True, t), at_least), ((f, False, t), everything & ~at_least)]

    def count(mask: int) -> tuple[int, int]:
        return (mask & bad).bit_count(), (mask & ~bad).bit_count()

    def right(mask: int) -> bool:
        p, n = count(mask)
        return p > 0 and p / (p + n) >= least_precision

    left, rules, banned = everything, [], set()
    while len(rules) < max_rules and len(banned) <= max_tries and count(left & ~prune)[0]:
        chosen, cover, steps, first = {}, left, [], None
        while True:
            p0, n0 = count(cover & ~prune)
            if not n0:
                break
            base, best = math.log2(p0 / (p0 + n0)), None
            for test, mask in tests:
                if (not chosen and test in banned) or (len(chosen) == max_tests and test[:2] not in chosen):
                    continue
                p1, n1 = count(cover & mask & ~prune)
                if p1 and (gain := p1 * (math.log2(p1 / (p1 + n1)) - base)) > 1e-9 and (best is None or gain > best[0]):
                    best = (gain, test, mask)
            if best is None:
                break
            _, test, mask = best
            first = first or test
            chosen[test[:2]] = (test, mask)
            cover &= mask
            steps.append((tuple(chosen.values()), cover))
        if not steps:
            break
        heads = []
        for k, (_, mask) in enumerate(steps):
            p, n = count(mask & prune)
            if right(mask & prune) and right(mask) and count(mask)[0] >= least_bad:
                heads.append(((p - n) / (p + n), -k))
        if not heads:
            banned.add(first)
            continue
        parts, cover = steps[-max(heads)[1]]
        rules.append(Rule(tuple(t for t, _ in needed(parts, left)), *count(cover)))
        left &= ~cover
    return rules


def training_rows(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE) -> list[tuple[dict[str, float], bool]]:
    """Features and label of up to ``sample`` labelled documents, chosen by the hash of their id."""
    by = [F.xxhash64("doc_id"), F.col("doc_id")]
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_q_quality"))
    known = known.orderBy(*by).limit(sample)
    found = docs.select("doc_id", F.col(text).alias("_q_own")).join(F.broadcast(known), "doc_id")  # at most `sample` rows of two numbers
    found = with_statistics(found, "_q_own")
    picked = found.select("doc_id", (F.col("_q_quality") == 0).alias("bad"), *[F.expr(v).alias(k) for k, v in FEATURES.items()])
    rows = picked.orderBy(*by, *FEATURES).limit(sample).collect()
    return [({k: r[k] for k in FEATURES}, r["bad"]) for r in rows]


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression over statistics: true keeps the document."""
    out = F.when(base_failed(), False)
    for rule in rules:
        out = out.when(rule.column(), False)
    return out.otherwise(True)


def measured(rows: list[tuple[dict[str, float], bool]], folds: int = 5) -> tuple[float, float]:
    """Precision and recall of learned lists for the bad class on rows that they were not learned from."""
    caught = wrong = total = 0
    for f in range(folds):
        rules = learn([r for i, r in enumerate(rows) if i % folds != f])
        for x, bad in rows[f::folds]:
            hit = any(r.holds(x) for r in rules)
            total, caught, wrong = total + bad, caught + (hit and bad), wrong + (hit and not bad)
    return caught / max(caught + wrong, 1), caught / max(total, 1)


def judge(docs: DataFrame, labels: DataFrame, text: str = "text", sample: int = SAMPLE) -> DataFrame:
    """Every row of ``docs`` with its counts, ``base_failed`` and ``kept``."""
    rules = learn(training_rows(docs, labels, text, sample))
    df = with_statistics(docs, text)
    return df.withColumns({"base_failed": base_failed(), "kept": verdict(rules)}).drop(*HELPERS)


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select("doc_id", *COUNTS, "base_failed", "kept")
