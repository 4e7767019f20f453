"""Roles as bitmaps: one row per record, two bits for each scheme and fold.

``roles`` is an array of longs with 32 roles each: 0 excluded, 1 train, 2 validation, 3 test; what is beyond its end
is excluded.  A table of combinations says which place belongs to which scheme and fold.  Counts group equal bitmaps
first, of which there are a few for each run; checks compare bitmaps as wholes; only ``expand`` makes a row for
each record and fold.

Rules for unusual input
-----------------------
null run or role       excluded everywhere
no valid run           no fold of a run scheme; ``within_run`` excludes all
fewer runs than first  no fold of ``forward_run``
repeated row_ids       stay, and are found by ``differing`` and ``uncovered``
helper columns         begin with ``_sf_``, which is reserved
empty table            no bitmap
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROLES = ("excluded", "train", "validation", "test")
PER_WORD = 32
BROADCAST_COMBINATIONS = 100_000  # combinations that may be broadcast
KEYS = ["dataset", "row_id", "order", "episode_id", "run_id"]


def code_of(role: Column) -> Column:
    """0-3 for the name of a role; null is excluded."""
    out = F.lit(0)
    for i, name in enumerate(ROLES[1:], 1):
        out = F.when(role == name, i).otherwise(out)
    return out.cast("bigint")


def role_at(roles: str, place: str) -> Column:
    """Name of the role at a place of a bitmap."""
    code = F.expr(f"cast(coalesce(shiftright(get({roles}, cast({place} div {PER_WORD} as int)), cast(2 * ({place} % {PER_WORD}) as int)) & 3, 0) as int)")
    return F.get(F.array(*[F.lit(r) for r in ROLES]), code)


def numbered_runs(runs: DataFrame, by: str) -> DataFrame:
    """Runs with their place ``_sf_k`` and number ``_sf_runs``; one row per run."""
    whole = Window.partitionBy(F.lit(0))
    r = runs.select(by).where(F.col(by).isNotNull()).distinct()
    return r.withColumns({"_sf_k": F.row_number().over(whole.orderBy(by)) - 1, "_sf_runs": F.count(F.lit(1)).over(whole)})


def run_words(runs: DataFrame, by: str, first: int = 2) -> DataFrame:
    """``(by, _sf_words)``: the bitmap of every valid run over both run schemes (J4), with place 0 left free.

    Folds of ``run_holdout`` come first, where the last other run validates, then those of ``forward_run`` from the
    ``first``-th run on, where the run before validates, earlier ones train and later ones are excluded.
    """
    held = "transform(sequence(0, _sf_runs - 1), i -> case when i = _sf_k then 3 when _sf_k = if(i = _sf_runs - 1, _sf_runs - 2, _sf_runs - 1) then 2 else 1 end)"
    ahead = f"if(_sf_runs > {first}, transform(sequence({first}, _sf_runs - 1), i -> case when i = _sf_k then 3 when i - 1 = _sf_k then 2 when _sf_k < i then 1 else 0 end), cast(array() as array<int>))"
    packed = f"transform(sequence(0, (size(_sf_codes) - 1) div {PER_WORD}), w -> aggregate(sequence(0, {PER_WORD - 1}), 0L, (a, b) -> a | shiftleft(cast(coalesce(get(_sf_codes, cast(w * {PER_WORD} + b as int)), 0) as bigint), 2 * b)))"
    codes = numbered_runs(runs, by).withColumn("_sf_codes", F.expr(f"concat(array(0), {held}, {ahead})"))
    return codes.select(by, F.expr(packed).alias("_sf_words"))


def run_combinations(runs: DataFrame, by: str, first: int = 2) -> DataFrame:
    """``(scheme, fold, place)`` that belong to ``run_words``, and ``within_run`` at place 0."""
    r = numbered_runs(runs, by)
    fold = F.col(by).cast("string").alias("fold")
    own = r.sparkSession.range(1).select(F.lit("within_run").alias("scheme"), F.lit("primary").alias("fold"), F.lit(0).cast("bigint").alias("place"))
    held = r.select(F.lit("run_holdout").alias("scheme"), fold, (F.col("_sf_k") + 1).cast("bigint").alias("place"))
    ahead = r.where(F.col("_sf_k") >= first).select(F.lit("forward_run").alias("scheme"), fold, (F.col("_sf_k") + 1 + F.col("_sf_runs") - first).cast("bigint").alias("place"))
    return own.unionByName(held).unionByName(ahead)


def with_roles(df: DataFrame, words: DataFrame, by: str, role: str = "role", used: Column | None = None) -> DataFrame:
    """Add ``roles``: the run's bitmap with the row's own ``role`` at place 0; empty where ``used`` does not hold."""
    own = code_of(F.col(role))
    joined = df.join(words, by, "left")
    some = F.col("_sf_words").isNotNull() if used is None else F.col("_sf_words").isNotNull() & F.coalesce(used, F.lit(False))
    both = F.transform("_sf_words", lambda w, i: F.when(i == 0, w.bitwiseOR(own)).otherwise(w))
    return joined.withColumn("roles", F.when(some, both).otherwise(F.array().cast("array<bigint>"))).drop("_sf_words")


def single(role: Column) -> Column:
    """The bitmap of a dataset with one scheme and fold, at place 0."""
    return F.array(code_of(role))


def _small(combinations: DataFrame) -> DataFrame:
    few = combinations.limit(BROADCAST_COMBINATIONS + 1).count() <= BROADCAST_COMBINATIONS
    return F.broadcast(combinations) if few else combinations


def expand(bitmaps: DataFrame, combinations: DataFrame) -> DataFrame:
    """One row for each record and combination, for export (F8).

    Stored bitmaps are small, so that few tasks would read them, but every record becomes many rows: records are dealt out
    evenly first.
    """
    n = int(bitmaps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = bitmaps.repartition(n, "row_id", "order").join(_small(combinations), "dataset")
    return both.select("dataset", "scheme", "fold", "row_id", role_at("roles", "place").alias("role"), "order", "episode_id", "run_id")


def role_counts(bitmaps: DataFrame, combinations: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Records of each role of each combination (A14), also per further columns ``by``; equal bitmaps are counted once."""
    kinds = bitmaps.groupBy("dataset", "roles", *by).agg(F.count(F.lit(1)).alias("_sf_n"))
    each = kinds.join(_small(combinations), "dataset").withColumn("role", role_at("roles", "place"))
    return each.groupBy("dataset", "scheme", "fold", "role", *by).agg(F.sum("_sf_n").alias("n"))


def readiness(bitmaps: DataFrame, combinations: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """Rows, positives and whether a ranking score can be computed, per slice (A20); ``labels`` has ``row_id`` and ``label``."""
    marked = bitmaps.join(labels.select("row_id", F.coalesce(F.col(label) == 1, F.lit(False)).alias("_sf_positive")), "row_id")
    counts = role_counts(marked, combinations, ("_sf_positive",)).where(F.col("role") != ROLES[0])
    positive = F.coalesce(F.sum(F.when(F.col("_sf_positive"), F.col("n"))), F.lit(0)).alias("n_positive")
    out = counts.groupBy("dataset", "scheme", "fold", "role").agg(F.sum("n").alias("n"), positive)
    return out.withColumn("auc_computable", (F.col("n_positive") > 0) & (F.col("n_positive") < F.col("n")))


def differing(bitmaps: DataFrame) -> DataFrame:
    """``(dataset, row_id, n)``: records with several bitmaps that are not all alike."""
    seen = bitmaps.groupBy("dataset", "row_id").agg(F.count(F.lit(1)).alias("n"), F.min("roles").alias("_sf_low"), F.max("roles").alias("_sf_high"))
    return seen.where((F.col("n") > 1) & (F.col("_sf_low") != F.col("_sf_high"))).drop("_sf_low", "_sf_high")


def uncovered(df: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``(row_id, n, wanted)``: rows of ``df`` without exactly one bitmap, and bitmaps of unknown rows."""
    got = bitmaps.groupBy("row_id").agg(F.count(F.lit(1)).alias("n"))
    both = df.select("row_id").distinct().withColumn("wanted", F.lit(1)).join(got, "row_id", "full")
    return both.select("row_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("wanted", F.lit(0)).alias("wanted")).where("n != wanted")


def role_alignment(a: DataFrame, b: DataFrame, combinations: DataFrame, keys: list[str]) -> DataFrame:
    """``(scheme, fold, *keys, role_a, role_b)``: same key in both, different roles, neither excluded.

    Records meet once, whatever the number of folds; a row is made for each violation only.
    """
    both = a.select(*keys, F.col("roles").alias("_sf_a")).join(b.select(*keys, F.col("roles").alias("_sf_b")), keys)
    # The lower bit of each pair of bits is set where both have a role and the roles differ.
    torn = "zip_with(_sf_a, _sf_b, (x, y) -> coalesce((x | shiftright(x, 1)) & (y | shiftright(y, 1)) & ((x ^ y) | shiftright(x ^ y, 1)) & 6148914691236517205L, 0L))"
    bad = both.withColumn("_sf_torn", F.expr(torn)).where("exists(_sf_torn, w -> w != 0)")
    places = f"filter(sequence(0L, size(_sf_torn) * {PER_WORD}L - 1), p -> (shiftright(get(_sf_torn, cast(p div {PER_WORD} as int)), cast(2 * (p % {PER_WORD}) as int)) & 1) = 1)"
    each = bad.select("*", F.explode(F.expr(places)).alias("place"))
    named = each.join(_small(combinations.select("scheme", "fold", "place").distinct()), "place")
    return named.select("scheme", "fold", *keys, role_at("_sf_a", "place").alias("role_a"), role_at("_sf_b", "place").alias("role_b"))


def stored_counts(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """Records of each role of the combinations ``wanted(dataset, scheme, fold, place)`` of a store of bitmaps.

    Words without a wanted place are pruned when the list is known; equal words are counted once.
    """
    wanted = wanted.select("dataset", "scheme", "fold", "place", F.expr(f"cast(place div {PER_WORD} as int)").alias("word"))
    words = _small(wanted.select("dataset", "word").distinct())
    kinds = store.join(words, ["dataset", "word"]).groupBy("dataset", "word", "bits").agg(F.count(F.lit(1)).alias("_sf_n"))
    each = kinds.join(_small(wanted), ["dataset", "word"]).withColumn("role", role_at("array(bits)", f"(place % {PER_WORD})"))
    return each.groupBy("dataset", "scheme", "fold", "role").agg(F.sum("_sf_n").alias("n"))


def use_stored(df: DataFrame, store: DataFrame, place: int, scored: bool = True) -> DataFrame:
    """Rows with their role at one place of a store of bitmaps, of which one dataset and the word of the place were read."""
    return use_bitmap(df, store.select("row_id", F.array("bits").alias("roles")), int(place) % PER_WORD, scored)


def use_bitmap(df: DataFrame, bitmaps: DataFrame, place: int, scored: bool = True) -> DataFrame:
    """Rows with their role at one place (P24, J2): one join on ``row_id``, whatever the number of folds."""
    one = bitmaps.select("row_id", role_at("roles", str(int(place))).alias("role"))
    return df.join(one.where(F.col("role") != ROLES[0]) if scored else one, "row_id")
