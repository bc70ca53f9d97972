"""Answers: the generator interface, response columns, scores, statuses and flags."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The required refusal and its test.
REFUSAL = "Not covered by the retrieved sources."


class Generator(Protocol):
    """Adds ``response`` (JSON) to (qid, prompt); network providers implement this outside the engine."""

    def __call__(self, prompts: DataFrame) -> DataFrame: ...


def extractive(prompts: DataFrame) -> DataFrame:
    """An offline generator: the first sentence of the first source, with its label."""
    first = F.regexp_extract("prompt", r"\[S1\][^\n]*\n([^\n.!?]*[.!?]?)", 1)
    body = F.when(first == "", F.lit(REFUSAL)).otherwise(F.concat(first, F.lit(" [S1]")))
    return prompts.withColumn("response", F.to_json(F.struct(F.array(F.struct(F.struct(F.array(F.struct(body.alias("text"))).alias("parts")).alias("content"), F.lit("STOP").alias("finishReason"))).alias("candidates"))))


RESPONSE = "candidates array<struct<content:struct<parts:array<struct<text:string,thought:boolean>>>,finishReason:string>>, usageMetadata map<string,bigint>"
LOCAL_RESPONSE = "response string, done boolean, prompt_eval_count bigint, eval_count bigint"


def read_response(answers: DataFrame) -> DataFrame:
    """Adds answer, finish, usage, degraded_category to rows with ``response``: no_candidate, empty_answer, bad_json."""
    j = F.from_json("response", RESPONSE)
    own = answers.withColumn("_j", j).withColumn("_c", F.try_element_at(F.col("_j.candidates"), F.lit(1)))
    parts = F.filter(F.coalesce(F.col("_c.content.parts"), F.array().cast("array<struct<text:string,thought:boolean>>")), lambda p: ~F.coalesce(p["thought"], F.lit(False)))
    text = F.trim(F.array_join(F.transform(parts, lambda p: F.coalesce(p["text"], F.lit(""))), ""))
    bad = F.col("response").isNull() | F.col("_j").isNull() | (F.col("_j.candidates").isNull() & F.col("_j.usageMetadata").isNull() & ~F.col("response").rlike(r"^\s*\{"))
    category = F.when(bad, "bad_json").when(F.col("_c").isNull(), "no_candidate").when(text == "", "empty_answer")
    return own.select(*answers.columns, F.when(category.isNull(), text).alias("answer"), F.col("_c.finishReason").alias("finish"), F.col("_j.usageMetadata").alias("usage"), category.alias("degraded_category")).withColumns(
        {"refused_verbatim": F.coalesce(F.startswith("answer", F.lit(REFUSAL)), F.lit(False)), "truncated": F.coalesce(F.col("finish") == "MAX_TOKENS", F.lit(False))}
    )


def read_local_response(answers: DataFrame) -> DataFrame:
    """Like :func:`read_response` for a local server's replies: empty_answer, bad_json."""
    own = answers.withColumn("_j", F.from_json("response", LOCAL_RESPONSE))
    text = F.trim(F.coalesce("_j.response", F.lit("")))
    category = F.when(F.col("response").isNull() | ~F.coalesce(F.col("response").rlike(r"^\s*\{"), F.lit(False)), "bad_json").when(text == "", "empty_answer")
    none = F.lit(False)
    usage = F.map_filter(F.create_map(F.lit("promptTokenCount"), F.col("_j.prompt_eval_count"), F.lit("candidatesTokenCount"), F.col("_j.eval_count")), lambda k, v: v.isNotNull())
    return own.select(*answers.columns, F.when(category.isNull(), text).alias("answer"), F.when(F.coalesce("_j.done", F.lit(False)), "STOP").otherwise("").alias("finish"), usage.alias("usage"), category.alias("degraded_category")).withColumns({"refused_verbatim": F.coalesce(F.startswith("answer", F.lit(REFUSAL)), none), "truncated": none})


#: Known providers: what makes a reply of a prompt (None where that is outside the engine), and what reads it.
PROVIDERS: dict[str, tuple[Generator | None, Callable[[DataFrame], DataFrame]]] = {"extractive": (extractive, read_response), "gemini": (None, read_response), "local": (None, read_local_response)}


def status(row: dict[str, Column] | None = None) -> Column:
    """FAIL without an answer; flag for unknown or malformed citations and truncation; decl for the refusal; else ok."""
    c = row or {k: F.col(k) for k in ("answer", "unknown", "malformed", "truncated", "refused_verbatim")}
    return F.when(c["answer"].isNull(), "FAIL").when((F.size(c["unknown"]) > 0) | (F.size(c["malformed"]) > 0) | c["truncated"], "flag").when(c["refused_verbatim"], "decl").otherwise("ok")


# Fixed values below: the texts of the flags.
def flags() -> Column:
    """Everything about an answer that calls for a look, one text each, in this order; empty where nothing does."""
    ignored = F.array_except("expected_retrieved", "expected_cited")
    return F.array_compact(
        F.array(
            F.when(F.size("unknown") > 0, F.concat(F.lit("FABRICATED citations: "), F.array_join("unknown", ", "))),
            F.when(F.size("malformed") > 0, F.concat(F.lit("non-source citations: "), F.array_join("malformed", ", "))),
            F.when(F.col("truncated"), F.lit("hit maxOutputTokens, so the citation check is not trustworthy here")),
            F.when(F.col("refused_verbatim"), F.lit("used the required refusal sentence")),
            F.when(F.size("off_target_cites") > 0, F.concat(F.lit("cited "), F.array_join("off_target_cites", ", "), F.lit(" from a document that is neither expected nor acceptable"))),
            F.when(F.size(ignored) > 0, F.concat(F.lit("retrieved but never cited: "), F.array_join(ignored, ", "))),
        )
    )


def score(answers: DataFrame, sources: DataFrame, anchors: DataFrame, expected: DataFrame, acceptable: DataFrame) -> DataFrame:
    """Per question: anchors, anchors_in_context, anchors_in_cited, expected_retrieved, expected_cited, off_target.

    ``answers``: qid, cited (array of labels); ``sources``: qid, label, source_id, text;
    ``anchors``: qid, anchor; ``expected``/``acceptable``: qid, source_id. Anchors have
    no line breaks, so a match never spans two sources. Without any allowed document
    nothing is off target.
    """
    cited = answers.select("qid", F.explode("cited").alias("label")).distinct()
    shown = sources.join(cited.withColumn("is_cited", F.lit(True)), ["qid", "label"], "left").withColumn("is_cited", F.coalesce("is_cited", F.lit(False)))
    a = anchors.join(shown, "qid", "left").groupBy("qid", "anchor").agg(F.max(F.coalesce(F.contains("text", "anchor"), F.lit(False))).alias("ctx"), F.max(F.coalesce(F.contains("text", "anchor") & F.col("is_cited"), F.lit(False))).alias("cit"))
    per = a.groupBy("qid").agg(F.count(F.lit(1)).alias("anchors"), F.count_if("ctx").alias("anchors_in_context"), F.count_if("cit").alias("anchors_in_cited"))
    docs = shown.groupBy("qid", "source_id").agg(F.max("is_cited").alias("c"))
    exp = expected.distinct().join(docs, ["qid", "source_id"], "left").groupBy("qid").agg(F.count(F.when(F.col("c").isNotNull(), 1)).alias("expected_retrieved"), F.count_if(F.coalesce("c", F.lit(False))).alias("expected_cited"))
    allowed = expected.unionByName(acceptable).distinct()
    off = shown.filter("is_cited").join(allowed, ["qid", "source_id"], "left_anti").join(allowed.select("qid").distinct(), "qid", "left_semi").groupBy("qid").agg(F.count(F.lit(1)).alias("off_target_cites"))
    out = answers.select("qid")
    for part in (per, exp, off):
        out = out.join(part, "qid", "left")
    return out.select("qid", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("anchors", "anchors_in_context", "anchors_in_cited", "expected_retrieved", "expected_cited", "off_target_cites")))
