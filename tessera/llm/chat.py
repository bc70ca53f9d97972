"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all turns before it as context,
and only its text under the loss mask. A conversation that doesn't end with an
assistant turn gets one more example without a target, so no turn is lost.

Template: ``<|start|>role<|says|>text<|end|>`` per turn. Inside roles and texts a
backslash is doubled and ``<|`` becomes ``<\\|``, so no text can hold a mark, and
:func:`unescape` gives the text back exactly.

Turns are ordered by turn number, then role, then text; repeated rows stay. Null
roles and texts are empty; null turn numbers come first; rows with null conv_id are
one conversation. An empty table gives no rows. All turns of a conversation meet in
one row, as every example must hold all that precede it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import saved, scratch_dir

# The marks of the template.
START, SAYS, END, TARGET_ROLE = "<|start|>", "<|says|>", "<|end|>", "assistant"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def examples(turns: DataFrame) -> DataFrame:
    """conv_id, example, formatted, loss_start, loss_end (code points, end exclusive), n_context; from (conv_id, turn, role, text)."""
    own = turns.select("conv_id", F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    convs = own.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))  # null turn numbers first, as structs compare
    said = F.transform("ts", lambda t: F.struct((t["role"] == TARGET_ROLE).alias("target"), F.concat(F.lit(START), escape(t["role"]), F.lit(SAYS)).alias("head"), escape(t["text"]).alias("body")))
    parts = convs.select("conv_id", said.alias("p"), F.transform("ts", lambda t: t["role"]).alias("roles"))
    indexed = parts.select("conv_id", "p", F.filter(F.sequence(F.lit(1), F.size("p")), lambda i: F.element_at("p", i)["target"] | (i == F.size("p"))).alias("ends"))
    each = indexed.select("conv_id", "p", F.posexplode("ends").alias("example", "i"))
    turn_text = lambda x: F.concat(x["head"], x["body"], F.lit(END))
    context = F.array_join(F.transform(F.slice("p", F.lit(1), F.col("i") - 1), turn_text), "")
    last = F.element_at("p", F.col("i"))
    built = each.select("conv_id", "example", (F.col("i") - 1).alias("n_context"), F.concat(context, last["head"]).alias("before"), last["body"].alias("body"), last["target"].alias("target"))
    start = F.length("before")
    return built.select(
        "conv_id",
        "example",
        F.concat("before", "body", F.lit(END)).alias("formatted"),
        start.cast("long").alias("loss_start"),
        (start + F.when(F.col("target"), F.length("body")).otherwise(0)).cast("long").alias("loss_end"),
        "n_context",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation of :func:`examples` output: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples."""
    pieces = F.slice(F.split("formatted", r"<\|start\|>"), 2, 1 << 30)
    turn = F.transform(
        pieces,
        lambda x: F.concat(unescape(F.substring_index(x, SAYS, 1)), F.lit("\n"), unescape(F.substring_index(F.substring_index(x, SAYS, -1), END, 1)), F.lit("\n")),
    )
    loss = unescape(F.expr("substring(formatted, cast(loss_start as int) + 1, cast(loss_end - loss_start as int))"))
    read = formatted.select("conv_id", "example", F.size(pieces).cast("long").alias("n"), F.sha2(F.array_join(turn, ""), 256).alias("sha"), loss.alias("loss"), F.length("formatted").cast("long").alias("chars"))
    whole = read.groupBy("conv_id").agg(
        F.max(F.struct("example", "n", "sha")).alias("last"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
        F.sum("chars").alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_examples"),
    )
    return whole.select("conv_id", F.col("last.n").alias("n_turns"), F.col("last.sha").alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose texts hold another template's marks."""
    text = "</s>[INST] ok [/INST]"
    return spark.sql(f"select -1L as conv_id, 0L as turn, 'user' as role, '{text}' as text union all select -1L, 1L, 'assistant', '{text}'")


def op8(spark: SparkSession, turns: DataFrame) -> DataFrame:
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return read_back(saved(examples(rows.unionByName(probe(spark))), f"{scratch_dir(spark)}/examples"))


#: DuckDB SQL for all columns of ``op8``: what the template must give, computed from the turns.
ORACLE = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), o as (
  select *, row_number() over w as k, count(*) over (partition by conv_id) as n,
    length('<|start|><|says|><|end|>') + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) as chars
  from t window w as (partition by conv_id order by turn nulls first, role, text)
), c as (
  select *, sum(chars) over (partition by conv_id order by k rows unbounded preceding) as so_far, role = 'assistant' or k = n as ends from o
)
select conv_id, cast(count(*) as bigint) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  cast(length(coalesce(string_agg(case when role = 'assistant' then text end, '' order by k), '')) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by k), '')) as loss_sha256,
  cast(sum(case when ends then so_far else 0 end) as bigint) as formatted_chars,
  cast(count(*) filter (where ends) as bigint) as n_examples
from c group by conv_id
"""
