"""Preference pairs: common turns as prompt, the rest of each side as a masked completion.

A turn is ``<|role|>`` LF text LF.  The prompt is the longest common prefix of turns of the chosen and the
rejected side, rendered once.  In a completion, the texts of assistant turns (with their closing LF) are trained
on; everything else is masked out.

Rules for unusual input
-----------------------
null or empty text     a turn without characters
null role              rendered as ``unknown``, never trained on; equal to another null role
null or equal turns    ordered by turn, nulls first, then by role and text
null pair_id           no pair; such turns are left out
repeated rows          turns like any other
one side missing       the pair is returned with an empty completion for it and ``paired`` false
very long texts        rendered whole; a conversation is one row
extra columns          ignored
empty table            no pairs from two, one-sided pairs from one
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPLETER = "assistant"


def _side(turns: DataFrame, name: str) -> DataFrame:
    """One row for each pair: its turns in order.  A conversation is one training text, so it fits one row."""
    one = F.struct(F.col("turn"), F.col("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.where("pair_id is not null").groupBy("pair_id").agg(F.sort_array(F.collect_list(one)).alias(name))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("unknown")), F.lit("|>\n"), t["text"], F.lit("\n"))), "")


def _trained(turns: str) -> Column:
    """``start:end`` of trained characters, comma-joined, counted in the completion's code points."""
    return F.expr(
        f"""array_join(aggregate({turns}, named_struct('at', 0, 'spans', cast(array() as array<string>)),
            (a, t) -> named_struct('at', a.at + 6 + length(coalesce(t.role, 'unknown')) + length(t.text),
              'spans', case when t.role = '{COMPLETER}'
                then array_append(a.spans, concat(a.at + 5 + length(t.role), ':', a.at + 6 + length(t.role) + length(t.text)))
                else a.spans end),
            a -> a.spans), ',')"""
    )


def format_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """``(pair_id, paired, n_common, prompt, chosen, chosen_trained, rejected, rejected_trained)`` from two tables of turns.

    ``chosen`` and ``rejected`` have ``pair_id, turn, role, text``.  Only pairs that are ``paired`` have turns on both sides.
    """
    both = _side(chosen, "c").join(_side(rejected, "r"), "pair_id", "full")
    none = F.array().cast("array<struct<turn:bigint,role:string,text:string>>")
    paired = (F.col("c").isNotNull() & F.col("r").isNotNull()).alias("paired")
    both = both.select("pair_id", paired, *[F.coalesce(s, none).alias(s) for s in ("c", "r")])
    differs = F.expr(
        """filter(sequence(0, least(size(c), size(r))),
            i -> i >= least(size(c), size(r)) or not (c[i].role <=> r[i].role and c[i].text <=> r[i].text))"""
    )
    df = both.withColumn("n_common", F.array_min(differs))
    rest = lambda s: F.slice(s, F.col("n_common") + 1, F.size(s) - F.col("n_common"))
    prompt = F.slice("c", F.lit(1), F.col("n_common")).alias("p")
    sides = [F.when(F.size(s) > F.col("n_common"), rest(s)).otherwise(F.slice(s, F.lit(1), F.lit(0))).alias(s) for s in ("c", "r")]
    df = df.select("pair_id", "paired", "n_common", prompt, *sides)
    return df.select(
        "pair_id", "paired", F.col("n_common").cast("long").alias("n_common"), _render(F.col("p")).alias("prompt"),
        _render(F.col("c")).alias("chosen"), _trained("c").alias("chosen_trained"),
        _render(F.col("r")).alias("rejected"), _trained("r").alias("rejected_trained"),
    )


def with_swapped_reply(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns from plain conversations ``(conv_id, turn, role, text)``.

    Conversations 2k and 2k + 1 are partners.  The chosen side is the conversation up to its last assistant turn;
    the rejected side has that turn's text replaced by the partner's last assistant text.  A conversation without
    an assistant turn has no chosen side, one whose partner has none no rejected side.
    """
    own = turns.where("conv_id is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    last = own.where(F.col("role") == COMPLETER).groupBy("conv_id").agg(F.max("turn").alias("last"), F.max_by(F.struct(F.coalesce("text", F.lit("")).alias("text")), F.struct("turn", "text"))["text"].alias("reply"))
    upto = own.join(last.select("conv_id", "last"), "conv_id").where(F.col("turn") <= F.col("last"))
    chosen = upto.select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("reply").alias("other"))
    swapped = upto.join(other, "conv_id").select(F.col("conv_id").alias("pair_id"), "turn", "role", F.when((F.col("turn") == F.col("last")) & (F.col("role") == COMPLETER), F.col("other")).otherwise(F.col("text")).alias("text"))
    return chosen, swapped


def op1_preference_pairs(spark, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return format_pairs(*with_swapped_reply(turns))


OP1_SQL = r"""
with turns as (select conv_id, turn, coalesce(role, 'unknown') role, coalesce(text, '') text from conversations where conv_id is not null),
last as (select conv_id, max(turn) last_turn, arg_max(text, turn) reply from turns where role = 'assistant' group by conv_id),
upto as (select t.conv_id, t.turn, t.role, t.text, l.last_turn, o.reply other, o.conv_id is not null paired,
                row_number() over (partition by t.conv_id order by t.turn) - 1 as place
         from turns t join last l using (conv_id) left join last o on o.conv_id = xor(t.conv_id, 1) where t.turn <= l.last_turn),
sides as (select *, case when turn = last_turn then other else text end as other_text from upto),
common as (select conv_id, bool_or(paired) paired, case when not bool_or(paired) then 0 when bool_or(turn = last_turn and text <> other_text) then count(*) - 1 else count(*) end as n_common from sides group by conv_id),
rendered as (select s.*, c.n_common, '<|' || role || '|>' || chr(10) || text || chr(10) as own, '<|' || role || '|>' || chr(10) || other_text || chr(10) as swapped from sides s join common c using (conv_id)),
placed as (select *, sum(case when place >= n_common then length(own) else 0 end) over w - length(own) as own_at, sum(case when place >= n_common then length(swapped) else 0 end) over w - length(swapped) as other_at
           from rendered window w as (partition by conv_id order by turn))
select conv_id as pair_id, any_value(paired) as paired, any_value(n_common)::bigint as n_common,
       coalesce(string_agg(own, '' order by turn) filter (where place < n_common), '') as prompt,
       coalesce(string_agg(own, '' order by turn) filter (where place >= n_common), '') as chosen,
       coalesce(string_agg((own_at + 5 + length(role))::bigint::varchar || ':' || (own_at + length(own))::bigint::varchar, ',' order by turn) filter (where place >= n_common and role = 'assistant'), '') as chosen_trained,
       coalesce(string_agg(swapped, '' order by turn) filter (where place >= n_common and paired), '') as rejected,
       coalesce(string_agg((other_at + 5 + length(role))::bigint::varchar || ':' || (other_at + length(swapped))::bigint::varchar, ',' order by turn) filter (where place >= n_common and role = 'assistant' and paired), '') as rejected_trained
from placed group by conv_id
"""
