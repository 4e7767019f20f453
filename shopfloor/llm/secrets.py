"""Secret scan: fixed patterns, plus tokens that look random and do not look like words.

A candidate is reported if a battery of randomness tests cannot tell it from random characters of its encoding, and
if it is a discovery against the null hypothesis that it is an ordinary token.  An ordinary token is, without regard to
case, drawn by one of two models: letter pairs as in the words of the corpus, or kinds of characters that follow
one another as there (vowel, consonant, digit, mark), each as likely as any other of its kind, which also takes words
that this corpus does not know.  Case is a chain of its own that seldom changes inside a run of letters, so words
in capitals, titles and joined words are ordinary.  Under the null hypothesis the likelihood ratio of random characters
to an ordinary token has a mean of at most 1, so a ratio of r or more has a probability of at most 1 / r (Markov): 1 / r
is the p-value.  Benjamini-Hochberg on the p-values of all candidates, within each length class, holds down the share of
ordinary tokens among the discoveries.

The models learn from distinct words of under ``LEAST`` characters and the number of documents that each is in: a key never
trains the model that judges it, however many copies of its document there are.

Everything is a column expression or a small aggregate; no Python runs on the executors.

Rules for unusual input
-----------------------
null or empty text     no spans
very long text         scanned as a whole; the spans are found in one pass
ties                   spans of equal start are ordered by kind, base kinds first
repeated rows          each row is scanned and returned by itself
extra columns          kept, unless their name starts with ``_sec_`` or is ``base_spans`` or ``all_spans``
empty table            empty result
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import materialize

# Fixed values of the base patterns: kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
LEAST = 16  # characters of the shortest candidate
CLASSES = 8  # length classes: 16+, 32+, 64+, ...
ALPHA = 0.001  # a battery's p-value below this says: not random
DECADES = 30  # p-values are told apart down to 10 to the minus this
CANDIDATE = r"[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST
KINDS = ("aeiouy", "bcdfghjklmnpqrstvwxz", "0123456789", "+/_-")
SYMBOLS = "".join(KINDS)  # of an ordinary token; place 0 stands for its edge
KNOWN = 0.95  # share of the learnt model in each step; the rest takes any symbol
TURN = 0.05  # share of neighbouring letters of an ordinary token that differ in case
ALPHABETS = (
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("HEX", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base64url", "^[A-Za-z0-9_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("base64", "^[A-Za-z0-9+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
)
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def _spans(text: str, kind: str, pattern: str, group: int, least: int, rank: int) -> Column:
    """Spans of the leftmost non-overlapping matches: gaps and matches alternate, so their lengths give the offsets."""
    pat = F.lit(pattern)
    found = F.regexp_extract_all(F.col(text), pat, F.lit(0))
    counted = found if group == 0 else F.regexp_extract_all(F.col(text), pat, F.lit(group))
    steps = F.arrays_zip(F.split(F.col(text), pattern, -1).alias("gap"), found.alias("hit"), counted.alias("key"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["0"])
        e = s + F.coalesce(F.length(x["1"]), F.lit(0))
        one = F.struct(s.alias("start"), F.lit(rank).alias("rank"), e.alias("end"), F.lit(kind).alias("kind"))
        passes = F.coalesce(F.length(x["2"]), F.lit(-1)) >= least
        return F.struct(e.alias("at"), F.when(passes, F.array_append(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    zipped = F.transform(steps, lambda x: F.struct(x["gap"].alias("0"), x["hit"].alias("1"), x["key"].alias("2")))
    walked = F.aggregate(zipped, begin, step, lambda acc: acc["spans"])
    return F.when(F.size(found) > 0, walked).otherwise(F.array().cast(SPAN))


def _tail(z: str) -> str:
    """Upper tail of the normal distribution (Abramowitz and Stegun 26.2.17), for z >= 0."""
    t = f"(1D / (1D + 0.2316419D * ({z})))"
    poly = f"{t} * (0.319381530D + {t} * (-0.356563782D + {t} * (1.781477937D + {t} * (-1.821255978D + {t} * 1.330274429D))))"
    return f"(exp(-({z}) * ({z}) / 2D) / 2.5066282746310002D * {poly})"


def _battery() -> list[tuple[str, str]]:
    """Fields added to each candidate ``c``, in order; ``p`` is the combined p-value that its characters are
    uniform over the alphabet of its encoding.

    Three tests, joined by Fisher's rule: chi-squared over equal parts of the alphabet (as many parts as
    leave five expected characters each), runs above and below the alphabet's middle, and serial
    correlation of neighbours.
    """
    encoding = " ".join(f"when c.body rlike '{pat}' then '{letters}'" for _, pat, letters in ALPHABETS)
    above = "sqrt(greatest(({ab} * ({ab} - c.n)) / (1D * c.n * c.n * (c.n - 1)), 1e-9D))".format(ab="(2D * c.hi * (c.n - c.hi))")
    return [
        ("body", "rtrim('=', c.token)"),
        ("alphabet", f"case {encoding} else '{ALPHABETS[-1][2]}' end"),
        ("size", "length(c.alphabet)"),
        ("n", "length(c.body)"),
        ("v", "transform(filter(split(c.body, ''), x -> x != ''), x -> greatest(instr(c.alphabet, x) - 1, 0))"),
        ("k", "cast(least(16, c.size, greatest(2, c.n div 5)) as int)"),
        ("bins", "transform(c.v, x -> x * c.k div c.size)"),
        ("share", "transform(sequence(0, c.k - 1), b -> size(filter(sequence(0, c.size - 1), x -> x * c.k div c.size = b)) / cast(c.size as double))"),
        ("chi", "aggregate(sequence(0, c.k - 1), 0D, (s, b) -> s + power(size(filter(c.bins, x -> x = b)) - c.n * c.share[b], 2) / (c.n * c.share[b]))"),
        ("z1", "(power(c.chi / (c.k - 1), 1D / 3D) - (1D - 2D / (9D * (c.k - 1)))) / sqrt(2D / (9D * (c.k - 1)))"),
        ("high", "transform(c.v, x -> x * 2 >= c.size)"),
        ("hi", "size(filter(c.high, x -> x))"),
        ("runs", "1 + size(filter(c.high, (x, i) -> i > 0 and x != c.high[i - 1]))"),
        ("z2", f"abs(c.runs - 1D - 2D * c.hi * (c.n - c.hi) / c.n) / {above}"),
        ("mean", "aggregate(c.v, 0D, (s, x) -> s + x) / c.n"),
        ("spread", "aggregate(c.v, 0D, (s, x) -> s + power(x - c.mean, 2))"),
        ("cov", "aggregate(sequence(1, c.n - 1), 0D, (s, i) -> s + (c.v[i] - c.mean) * (c.v[i - 1] - c.mean))"),
        ("z3", "abs(c.cov) / greatest(c.spread, 1e-9D) * sqrt(cast(c.n as double))"),
        ("p1", f"case when c.z1 >= 0 then {_tail('c.z1')} else 1D - {_tail('abs(c.z1)')} end"),
        ("p2", f"case when c.hi = 0 or c.hi = c.n then power(2D, 1 - c.n) else 2D * {_tail('c.z2')} end"),
        ("p3", f"case when c.spread <= 0 then 1e-12D else 2D * {_tail('c.z3')} end"),
        ("half", "-(" + " + ".join(f"ln(greatest(least(c.{p}, 1D), 1e-60D))" for p in ("p1", "p2", "p3")) + ")"),
        ("p", "exp(-c.half) * (1D + c.half + c.half * c.half / 2D)"),
        ("strength", f"cast(least({CLASSES - 1}, floor(log2(c.n / {LEAST}D))) as int)"),
    ]


def _with(column: str, known: list[str], name: str, value: str) -> str:
    """SQL that adds one field to every struct of an array column."""
    fields = ", ".join(f"'{f}', c.{f}" for f in known)
    return f"transform({column}, c -> named_struct({fields}, '{name}', {value}))"


def _masked(text: str, spans: str) -> str:
    """SQL for the text with the characters of spans, in order, turned into spaces."""
    return f"""case when size({spans}) = 0 then {text} else aggregate({spans}, named_struct('at', 0, 'out', ''),
        (a, s) -> named_struct('at', greatest(a.at, s.end), 'out', concat(a.out, substring({text}, a.at + 1, greatest(s.start - a.at, 0)), repeat(' ', s.end - greatest(s.start, a.at)))),
        a -> concat(a.out, substring({text}, a.at + 1))) end"""


def pair_counts(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """How often two symbols follow one another in distinct words, by the documents that hold the word; an edge is a space.

    A table of at most 41 x 41 numbers, whatever the corpus.
    """
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    own = F.filter(F.array_distinct(F.split(t, "[^a-z0-9+/_-]+")), lambda w: (F.length(w) > 0) & (F.length(w) < LEAST))
    words = docs.select(F.explode(own).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    edged = F.concat(F.lit(" "), F.col("w"), F.lit(" "))
    pairs = words.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") + 1), lambda i: F.substring(edged, i, F.lit(2)))).alias("pair"))
    return {r["pair"]: r["n"] for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}


def step_costs(pairs: dict[str, int]) -> tuple[list[float], list[float]]:
    """-log10 of each symbol after each symbol or edge, under both models; row and column 0 are the edge."""
    all_of = " " + SYMBOLS
    kind = {c: k for k, own in enumerate(KINDS) for c in own} | {" ": len(KINDS)}
    turns = {(k, m): 1.0 for k in range(len(KINDS) + 1) for m in range(len(KINDS))}
    for p, n in pairs.items():
        if p[1] != " ":
            turns[kind[p[0]], kind[p[1]]] += n
    learnt, kinds = [], []
    for c in all_of:
        row = [pairs.get(c + d, 0) + 0.5 for d in SYMBOLS]
        total, of_kind = sum(row), sum(turns[kind[c], m] for m in range(len(KINDS)))
        learnt += [0.0] + [-math.log10(KNOWN * n / total + (1 - KNOWN) / len(SYMBOLS)) for n in row]
        kinds += [0.0] + [-math.log10(KNOWN * turns[kind[c], kind[d]] / of_kind / len(KINDS[kind[d]]) + (1 - KNOWN) / len(SYMBOLS)) for d in SYMBOLS]
    return learnt, kinds


def candidates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``base_spans`` and ``_sec_cands``: further long tokens, outside the base spans."""
    t = "_sec_text"
    df = docs.withColumn(t, F.coalesce(F.col(text), F.lit("")))
    parts = [_spans(t, kind, pat, group, least, i) for i, (kind, pat, group, least) in enumerate(BASE)]
    df = df.withColumn("base_spans", F.sort_array(F.concat(*parts)))
    df = df.withColumn(t, F.expr(_masked(t, "base_spans")))
    df = df.withColumn("_sec_found", _spans(t, "random", CANDIDATE, 0, LEAST, len(BASE)))
    df = df.withColumn("_sec_cands", F.expr(f"transform(_sec_found, c -> named_struct('span', c, 'token', substring({t}, c.start + 1, c.end - c.start)))"))
    return df.drop("_sec_found", t)


def _ordinary(costs: tuple[list[float], list[float]]) -> list[tuple[str, str]]:
    """Fields added to each candidate: ``ratio``, log10 of the likelihood ratio of random to ordinary."""
    size = len(SYMBOLS) + 1
    table = lambda x: "cast(split('" + ",".join(f"{v:.6f}" for v in x) + "', ',') as array<double>)"
    walk = lambda x: f"aggregate(sequence(0, c.n - 1), 0D, (s, i) -> s + {table(x)}[if(i = 0, 0, c.symbol[i - 1]) * {size} + c.symbol[i]])"
    case = lambda same: f"size(filter(sequence(1, c.n - 1), i -> c.letter[i] != 0 and c.letter[i - 1] != 0 and c.letter[i] {'=' if same else '!='} c.letter[i - 1]))"
    turned, kept = -math.log10(TURN), -math.log10(1 - TURN)
    return [
        ("symbol", f"transform(filter(split(lower(c.body), ''), x -> x != ''), x -> instr('{SYMBOLS}', x))"),
        ("letter", "transform(filter(split(c.body, ''), x -> x != ''), x -> case when x between 'A' and 'Z' then 1 when x between 'a' and 'z' then 2 else 0 end)"),
        ("words", f"least({walk(costs[0])}, {walk(costs[1])}) + {math.log10(2)}D"),
        ("begun", "size(filter(sequence(0, c.n - 1), i -> c.letter[i] != 0 and (i = 0 or c.letter[i - 1] = 0)))"),
        ("cases", f"{turned}D * {case(False)} + {kept}D * {case(True)} + {math.log10(2)}D * c.begun"),
        ("ratio", "c.words + c.cases - c.n * log10(c.size)"),
    ]


def graded(found: DataFrame, costs: tuple[list[float], list[float]]) -> DataFrame:
    """Give each candidate its length class, whether the battery lets it pass, and its grade: 100 log10 of the likelihood ratio."""
    known = ["span", "token"]
    for name, value in [*_battery(), *_ordinary(costs)]:
        found = found.withColumn("_sec_cands", F.expr(_with("_sec_cands", known, name, value)))
        known.append(name)
    grade = f"cast(floor(greatest(least(100D * c.ratio, {DECADES * 100}D), 0D)) as int)"
    return found.withColumn("_sec_cands", F.expr(f"transform(_sec_cands, c -> named_struct('span', c.span, 'strength', c.strength, 'random', c.p >= {ALPHA}D, 'grade', {grade}))"))


def discoveries(found: DataFrame, fdr: float) -> dict[int, int]:
    """Benjamini-Hochberg within each length class: the least grade that is a discovery.

    The hypotheses are those of all candidates; the battery only takes from the discoveries what is surely not random.
    Classes double in length, so the many short tokens do not set the cutoff of long ones.  P-values are rounded up to a hundredth of a decade, so the sorted list is a table of at most CLASSES x
    3,001 rows whatever the corpus.
    """
    each = found.where(F.size("_sec_cands") > 0).select(F.explode("_sec_cands").alias("c"))
    grades = each.groupBy("c.strength", "c.grade").agg(F.count(F.lit(1)).alias("n"))
    ranked = grades.selectExpr("strength", "grade", "sum(n) over (partition by strength order by grade desc) as k", "sum(n) over (partition by strength) as m")
    passing = ranked.where(F.pow(F.lit(10.0), -F.col("grade") / 100) <= F.col("k") / F.col("m") * fdr)
    return {r["strength"]: r["cut"] for r in passing.groupBy("strength").agg(F.min("grade").alias("cut")).collect()}


def scan(docs: DataFrame, text: str = "text", fdr: float = 0.05, keep_text: bool = True) -> DataFrame:
    """Add ``base_spans`` and ``all_spans`` (arrays of start, rank, end, kind, in order) to every row of ``docs``.

    Offsets are code points, the end is exclusive.  ``random`` spans do not overlap base spans.  The corpus is scanned
    once and the spans and candidates are stored with its rows (without the text unless ``keep_text``); another pass
    counts words.
    """
    costs = step_costs(pair_counts(docs, text))
    found = candidates(docs, text)
    found = graded(materialize(found if keep_text else found.drop(text)), costs)
    cuts = discoveries(found, fdr)
    cutoff = "case " + " ".join(f"when c.strength = {k} then {v}" for k, v in sorted(cuts.items())) + " else 2147483647 end" if cuts else "2147483647"
    random = F.expr(f"transform(filter(_sec_cands, c -> c.random and c.grade >= {cutoff}), c -> c.span)")
    return found.withColumn("all_spans", F.sort_array(F.concat("base_spans", random))).drop("_sec_cands")


def redact(scanned: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace every span of ``all_spans`` in ``text``; overlapping spans become one mark."""
    merged = F.expr(
        """aggregate(all_spans, named_struct('at', 0, 'out', ''),
           (a, s) -> named_struct('at', greatest(a.at, s.end), 'out', case when s.start < a.at then a.out
             else concat(a.out, substring({t}, a.at + 1, s.start - a.at), '{m}') end),
           a -> concat(a.out, substring({t}, a.at + 1)))""".format(t=f"`{text}`", m=mark)
    )
    return scanned.withColumn(text, F.when(F.size("all_spans") > 0, merged).otherwise(F.col(text)))


def digest(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), keep_text=False)
    count = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k, *_ in BASE], F.sha2(digest(F.col("base_spans")), 256).alias("base_sha256"), digest(F.col("all_spans")).alias("spans"))
