"""Evaluation: answer-key validation, anchor containment, run totals, comparison of runs, selection of questions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.anchors import containment as anchor_containment
from tessera.operators.anchors import saved
from tessera.session import shared_dir

def anchor_elsewhere(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Anchors found in a document other than their own: (anchor_id, doc_id) of ``found`` without ``expected``."""
    return found.join(expected, ["anchor_id", "doc_id"], "left_anti")


def validate(questions: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """problem, id, detail of an answer key. Eight checks.

    ``questions``: id, expected array<struct<source_id, anchors>>, acceptable array<string>;
    ``documents``: source_id, text; ``chunks``: source_id, text.
    """
    say = lambda df, problem, detail: df.select(F.lit(problem).alias("problem"), "id", detail.cast("string").alias("detail"))
    exp = questions.select("id", F.explode("expected").alias("e")).select("id", "e.source_id", "e.anchors")
    acc = questions.select("id", F.explode("acceptable").alias("source_id"))
    known = chunks.select("source_id").distinct()
    have = documents.filter("text is not null")
    anchors = exp.select("id", "source_id", F.explode("anchors").alias("anchor"))
    own = anchors.join(have, "source_id").withColumn("inside", F.contains("text", "anchor"))
    # numbers by place change with the order of rows, so they are given once and read back
    folder = shared_dir(questions.sparkSession)
    numbered = saved(anchors.select("anchor").distinct().withColumn("anchor_id", F.monotonically_increasing_id()), f"{folder}/anchors")
    names = saved(have.select("source_id").distinct().withColumn("doc_id", F.monotonically_increasing_id()), f"{folder}/names")
    found = anchor_containment(numbered, have.join(names, "source_id").select("doc_id", "text")).join(numbered, "anchor_id").join(names, "doc_id").select("anchor", F.col("source_id").alias("other"))
    other = anchors.withColumnRenamed("source_id", "own").join(found, "anchor").filter("own <> other").select("id", "own", "anchor", "other").distinct()
    whole = own.filter("inside").select("id", "source_id", "anchor").join(chunks.select("source_id", F.col("text").alias("piece")), "source_id").groupBy("id", "source_id", "anchor").agg(F.max(F.contains("piece", "anchor")).alias("any")).filter("not any")
    parts = [
        say(questions.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "duplicate_id", F.col("n")),
        say(questions.filter("expected is null or size(expected) = 0"), "no_expected", F.lit("")),
        say(exp.join(acc, ["id", "source_id"], "left_semi").select("id", "source_id").distinct(), "overlap", F.col("source_id")),
        say(exp.select("id", "source_id").union(acc).distinct().join(known, "source_id", "left_anti"), "unknown_source", F.col("source_id")),
        say(exp.join(have, "source_id", "left_anti"), "no_document", F.col("source_id")),
        say(own.filter("not inside"), "anchor_missing", F.col("anchor")),
        say(other, "anchor_elsewhere", F.concat_ws("@", "anchor", "other")),
        say(whole, "anchor_straddles", F.col("anchor")),
    ]
    return reduce(DataFrame.unionAll, parts)


def totals(records: DataFrame) -> DataFrame:
    """One row of totals of a generation run; probes don't count, token sums take answered rows only."""
    scored = records.filter(~F.col("probe"))
    answered = F.col("answer").isNotNull()
    on = lambda c: F.sum(F.when(answered, c).otherwise(0)).cast("long")
    usage = lambda k: on(F.coalesce(F.try_element_at("usage", F.lit(k)), F.lit(0)))
    return scored.agg(
        F.count(F.lit(1)).alias("questions"),
        F.count_if(answered).alias("answered"),
        on(F.col("citations")).alias("citations"),
        on(F.size("unknown")).alias("fabricated"),
        on(F.size("malformed")).alias("malformed"),
        on(F.size("off_target_cites")).alias("off_target_cites"),
        on(F.size("cited")).alias("sources_cited"),
        on(F.col("sources")).alias("sources_shown"),
        F.sum("anchors").cast("long").alias("anchors"),
        F.sum("anchors_in_cited").cast("long").alias("anchors_in_cited"),
        F.sum("anchors_in_context").cast("long").alias("anchors_in_context"),
        F.count_if(answered & F.col("refused_verbatim")).alias("refused_verbatim"),
        F.count_if(answered & F.col("truncated")).alias("truncated"),
        F.sum(F.size("expected_retrieved")).cast("long").alias("expected_retrieved"),
        F.sum(F.size("expected_cited")).cast("long").alias("expected_cited"),
        usage("promptTokenCount").alias("prompt_tokens"),
        usage("candidatesTokenCount").alias("answer_tokens"),
        usage("thoughtsTokenCount").alias("thought_tokens"),
        F.round(F.sum(F.when(answered, F.col("seconds")).otherwise(0.0)), 1).alias("seconds"),
    )


def degraded(records: DataFrame) -> DataFrame:
    """degraded_category, n over scored rows."""
    return records.filter(~F.col("probe") & F.col("degraded_category").isNotNull()).groupBy("degraded_category").agg(F.count(F.lit(1)).alias("n"))


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Questions of two runs side by side."""
    fields = ("anchors_in_cited", "off_target", "citations", "thought_tokens")
    pick = lambda df, side: df.select("id", *(F.col(f).alias(f"{f}_{side}") for f in fields))
    return pick(left, "left").join(pick(right, "right"), "id")


def config_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Fields (field, value) that differ between two configurations, null-safe, missing ones included."""
    pick = lambda df, side: df.select("field", F.col("value").alias(side))
    return pick(left, "left_value").join(pick(right, "right_value"), "field", "full_outer").filter(~F.col("left_value").eqNullSafe(F.col("right_value")))


def select_questions(questions: DataFrame, probes: DataFrame, wanted: DataFrame, include_probes: bool = True) -> DataFrame:
    """Wanted questions in the questions' order, then probes with a flag; (position, id) and (id)."""
    chosen = questions.join(wanted, "id", "left_semi").select("position", "id", F.lit(False).alias("probe"))
    if not include_probes:
        return chosen
    return chosen.unionByName(probes.select((F.col("position") + 1_000_000).alias("position"), "id", F.lit(True).alias("probe")))


def unknown_ids(questions: DataFrame, wanted: DataFrame) -> DataFrame:
    return wanted.join(questions, "id", "left_anti").select("id").distinct()


def dry_run(prompts: DataFrame) -> DataFrame:
    """qid, chars and the token estimate of four characters each."""
    return prompts.select("qid", F.length("prompt").cast("long").alias("chars"), F.floor(F.length("prompt") / 4).cast("long").alias("token_estimate"))


def ceiling(prompts: DataFrame, sources: DataFrame, anchors: DataFrame) -> DataFrame:
    """:func:`dry_run` with anchors and reachable: those (qid, anchor) that a source (qid, text) contains, the most that an answer can cite."""
    found = anchors.join(sources.select("qid", "text"), "qid", "left").groupBy("qid", "anchor").agg(F.max(F.coalesce(F.contains("text", "anchor"), F.lit(False))).alias("there"))
    per = found.groupBy("qid").agg(F.count(F.lit(1)).alias("anchors"), F.count_if("there").alias("reachable"))
    return dry_run(prompts).join(per, "qid", "left").select("qid", "chars", "token_estimate", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("anchors", "reachable")))


def ceiling_totals(rows: DataFrame) -> DataFrame:
    """One row: questions, anchors, reachable, prompt_chars and tokens_each, the estimate for a question."""
    return rows.agg(F.count(F.lit(1)).alias("questions"), F.coalesce(F.sum("anchors"), F.lit(0)).alias("anchors"), F.coalesce(F.sum("reachable"), F.lit(0)).alias("reachable"), F.coalesce(F.sum("chars"), F.lit(0)).alias("prompt_chars")).withColumn("tokens_each", F.floor(F.floor(F.col("prompt_chars") / F.greatest("questions", F.lit(1))) / 4).cast("long"))


def grid_totals(runs: DataFrame) -> DataFrame:
    """One row over all answers of all runs, probes too: answers, citations, fabricated, malformed.

    ``runs``: file, config, totals, questions array<struct<answer, citations, unknown, malformed>>; nulls count 0.
    """
    q = runs.select(F.explode("questions").alias("q")).select("q.*")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    size = lambda c: F.size(F.coalesce(c, F.array().cast("array<string>")))
    return q.agg(F.count_if(F.coalesce("answer", F.lit("")) != "").alias("answers"), n(F.col("citations")).alias("citations"), n(size("unknown")).alias("fabricated"), n(size("malformed")).alias("malformed"))


def shipping_run(runs: DataFrame, k: int, thinking: str) -> DataFrame:
    """The first run by file name of the configuration (k, thinking); no row where none was made."""
    return runs.filter((F.col("config.k") == k) & (F.col("config.thinking") == thinking)).orderBy("file").limit(1).select("file", "config", "totals")


# The named subsets of the questions.
SUBSETS = {
    "movers": ("false-testimony", "removal-proceedings", "court-decides-or-remands", "notice-to-appear-warrant"),
    "controls": ("delay-after-interview", "appeal-denial", "spouse-three-years"),
}


def wanted_ids(questions: DataFrame, names: list[str]) -> DataFrame:
    """id: question ids of ``names``, each an id or the name of a subset."""
    ids = [i for name in names for i in SUBSETS.get(name, (name,))]
    return questions.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], "id string")


def headline(results: DataFrame, k: int) -> DataFrame:
    """Totals of retrieval results with recall as map<string,double>, as JSON gives it back."""
    r = F.element_at("recall", F.lit(str(k)))
    return results.agg(F.count(F.lit(1)).alias("questions"), F.round(F.avg(r), 6).alias("recall"), F.count_if("hit").alias("hits"), F.count_if(r == 1.0).alias("complete"), F.sum("anchors").cast("long").alias("anchors"), F.sum("anchors_in_window").cast("long").alias("anchors_in_window"))
