"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import op11_bpe_round_trip
from .decontam import op2_decontamination, short_item_matches
from .lm import MU, STEP, op3_lm_scores
from .packing import op8_packing
from .preferences import OP1_SQL, op1_preference_pairs
from .prefix_trie import OP13_SQL, op13_conversation_trie
from .quality import op10_quality_rules
from .recompression import op5_repeat_removal
from .secrets import op4_secret_scan
from .simhash import op6_simhash_components
from .source_audit import OP12_SQL, op12_source_divergence
from .token_counts import op7_token_counts
from .token_store import op9_token_files

QUERIES = {
    "op1_preference_pairs": op1_preference_pairs,
    "op2_decontamination": op2_decontamination,
    "op3_lm_scores": op3_lm_scores,
    "op4_secret_scan": op4_secret_scan,
    "op5_repeat_removal": op5_repeat_removal,
    "op6_simhash_components": op6_simhash_components,
    "op7_token_counts": op7_token_counts,
    "op8_packing": op8_packing,
    "op9_token_files": op9_token_files,
    "op10_quality_rules": op10_quality_rules,
    "op11_bpe_round_trip": op11_bpe_round_trip,
    "op12_source_divergence": op12_source_divergence,
    "op13_conversation_trie": op13_conversation_trie,
}
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Two substitutions leave four equal words in a row in any 13, one leaves three in any 7: those find the alignments, which are
# then checked whole.
def _op2_sql(items: str) -> str:
    gram = lambda n: f"select doc_id, {n} g, unnest(range(len(w) - {n - 1})) pos, w from dl where len(w) >= {n}"
    return f"""
with dl as (select doc_id, {WORDS.format(LOWER)} w from documents), bl as (select item_id, w, case when len(w) >= 13 then 4 else least(len(w), 3) end g from ({items}) where len(w) > 0),
d as (select doc_id, unnest(w) word, unnest(range(len(w))) pos from dl), b as (select item_id, len(w) n, unnest(w) word, unnest(range(len(w))) pos from bl),
dg as ({" union all ".join(gram(n) for n in (1, 2, 3, 4))}), bg as (select item_id, g, unnest(range(len(w) - g + 1)) pos, w from bl),
shifts as (select distinct doc_id, item_id, x.pos - y.pos as shift from (select doc_id, g, pos, array_to_string(w[pos + 1 : pos + g], ' ') k from dg where g in (select g from bl)) x join (select item_id, g, pos, array_to_string(w[pos + 1 : pos + g], ' ') k from bg) y using (g, k)),
aligned as (select s.doc_id, s.item_id, s.shift, b.n, b.pos, (b.word = d.word)::int eq from shifts s join b on b.item_id = s.item_id join d on d.doc_id = s.doc_id and d.pos = b.pos + s.shift),
windows as (select *, sum(eq) over w k, count(*) over w c from aligned window w as (partition by doc_id, item_id, shift order by pos rows between current row and 12 following)),
hits as (select * from windows where (n >= 13 and c = 13 and k >= 11) or (n < 13 and pos = 0 and c = n and k >= n - case when n >= 7 then 1 else 0 end))
select doc_id, item_id, min(pos + shift)::bigint as start, max(pos + shift + least(13, n))::bigint as "end", count(*)::bigint n_windows, any_value(n < 13) short from hits group by doc_id, item_id, shift
"""


OP2_SQL = _op2_sql(f"select item_id, {WORDS.format(LOWER)} w from benchmark")
SHORT_SQL = _op2_sql(f"select item_id, ({WORDS.format(LOWER)})[1 : 1 + item_id % 12] w from benchmark")

OP5_SQL = f"""
with l as (select doc_id, {WORDS.format("coalesce(text, '')")} w from documents),
win as (select doc_id, i, array_to_string(w[i : i + 49], ' ') k from (select doc_id, w, unnest(range(1, len(w) - 48)) i from l where len(w) >= 50)),
first as (select k, min(doc_id) least_id from win group by k),
gone as (select distinct doc_id, unnest(range(i, i + 50)) pos from win join first using (k) where least_id < doc_id),
each as (select doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) pos from l),
kept as (select e.doc_id, count(g.pos) n_removed, string_agg(e.word, ' ' order by e.pos) filter (where g.pos is null) t from each e left join gone g on g.doc_id = e.doc_id and g.pos = e.pos group by e.doc_id)
select l.doc_id, len(w)::bigint n_words, coalesce(n_removed, 0)::bigint n_removed, sha256(coalesce(t, '')) kept_sha256 from l left join kept using (doc_id)
"""

# What SQL can say of operators 3, 4 and 10, by queries of their own: the whole result of the first, its logarithms rounded.


def lm_rounded(spark, sf_dir: str) -> DataFrame:
    return op3_lm_scores(spark, sf_dir).withColumns({c: F.round(c, 4) for c in ("base_score", "score")})


def secret_base_spans(spark, sf_dir: str) -> DataFrame:
    return op4_secret_scan(spark, sf_dir).drop("spans")


def quality_base_counts(spark, sf_dir: str) -> DataFrame:
    return op10_quality_rules(spark, sf_dir).drop("kept")


QUERIES |= {"short_item_matches": short_item_matches, "lm_rounded": lm_rounded, "secret_base_spans": secret_base_spans, "quality_base_counts": quality_base_counts}

# Bit by bit: each byte is followed by seven zeros, one for each further shift.
CRC32 = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::varchar, ''), lambda x: [ascii(x)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)), 4294967295)"""
LM_SQL = f"""
with d as (select doc_id, row_number() over () r, coalesce({CRC32} % 5 = 1, false) held, {WORDS.format(LOWER)} w from documents),
tok as (select r, held, unnest(list_append(w, ' ')) x, unnest(list_prepend('  ', w)) y from d),
c as (select x, count(*) filter (where not held) c from tok group by x), total as (select sum(c)::bigint n, count(*) filter (where c > 0) v from c),
pair as (select y, x, count(*) c2 from tok where not held group by y, x), before as (select y, count(*) b from tok where not held group by y),
each as (select r, c.c, (c.c + 5e-1) / (n + 5e-1 * (v + 1)) p, coalesce(b, 0) b, c2 from tok cross join total join c using (x) left join pair using (y, x) left join before using (y)),
logs as (select r, c, log10(p) base, case when c2 is null then log10(p) + log10({MU} / (b + {MU})) else round(-log10((c2 + {MU} * p) / (b + {MU})) * {STEP}) / -{STEP} end own from each),
sums as (select r, count(*)::bigint n_tokens, count(*) filter (where c > 0)::bigint n_known, round(sum(base), 4) base_score, round(sum(own), 4) score from logs group by r)
select doc_id, held held_out, n_tokens, n_known, n train_tokens, base_score, score from d join sums using (r) cross join total
"""

_NAMES = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_BASE = (("assign", rf"""({_NAMES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16))
_FOUND = " union all ".join(
    f"select r, {rank} as rank, '{kind}' kind, {least} least, unnest(m) hit, unnest(g) own, unnest(s[1 : len(m)]) gap, unnest(range(len(m))) i from "
    f"(select r, regexp_extract_all(t, '{pattern}') m, regexp_extract_all(t, '{pattern}', {group}) g, string_split_regex(t, '{pattern}') s from d)"
    for rank, (kind, pattern, group, least) in enumerate(_BASE)
)
SECRET_SQL = f"""
with d as (select doc_id, row_number() over () r, coalesce(text, '') t from documents), found as ({_FOUND}),
placed as (select *, (sum(length(gap) + length(hit)) over (partition by r, kind order by i))::bigint hi from found),
spans as (select r, kind, rank, hi - length(hit) lo, hi from placed where length(own) >= least),
each as (select r, count(*) filter (where kind = 'assign') a, count(*) filter (where kind = 'access') k, count(*) filter (where kind = 'hex') h, string_agg(kind || ':' || lo || ':' || hi, ',' order by lo, rank) x from spans group by r)
select doc_id, coalesce(a, 0)::bigint n_assign, coalesce(k, 0)::bigint n_access, coalesce(h, 0)::bigint n_hex, sha256(coalesce(x, '')) base_sha256 from d left join each using (r)
"""

QUALITY_SQL = f"""
with d as (select doc_id, row_number() over () r, coalesce(text, '') t, {WORDS.format("coalesce(text, '')")} w from documents),
lines as (select *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) l from d),
gram as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] g from (select r, w, unnest(range(1, len(w) - 1)) i from d where len(w) > 2)),
twice as (select distinct r, unnest([i, i + 1, i + 2]) pos from (select r, i, count(*) over (partition by r, g) n from gram) where n > 1),
again as (select r, count(*) n from twice group by r),
made as (select doc_id, len(w)::bigint n_words, length(array_to_string(w, ''))::bigint word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols,
  (len(l) - len(list_distinct(l)))::bigint n_dup_lines, coalesce(n, 0)::bigint n_repeat_words from lines left join again using (r))
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from made
"""

ORACLES: dict[str, str] = {
    "op1_preference_pairs": OP1_SQL, "op2_decontamination": OP2_SQL, "short_item_matches": SHORT_SQL, "op5_repeat_removal": OP5_SQL,
    "op12_source_divergence": OP12_SQL, "op13_conversation_trie": OP13_SQL, "lm_rounded": LM_SQL, "secret_base_spans": SECRET_SQL, "quality_base_counts": QUALITY_SQL,
}
