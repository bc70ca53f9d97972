"""From a question to a checked answer: search, source blocks, citations, prompt, generator, citation check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import citations
from tessera.operators import answers, search, windows
from tessera.plans.flagship import stored

#: What a citation is made of.
CITED = ("source_id", "source_type", "title", "citation", "court_id", "date", "url", "footnote_numbers")


def sources(hits: DataFrame, index: DataFrame) -> DataFrame:
    """qid, rank, label, source_id, text, citation, section of the hits' blocks.

    ``hits``: qid, rank, source_id, chunk_index, chunk_total; ``index``: source_id, chunk_index,
    text, section and the columns of ``CITED``.
    """
    blocks = windows.source_blocks(hits, index)
    row = {c: F.col(c) for c in CITED}
    about = hits.select("qid", "rank", "source_id", "chunk_index").join(index.select("chunk_index", "section", *CITED), ["source_id", "chunk_index"]).select("qid", "rank", citations.format_citation(row).alias("citation"), "section")
    return blocks.join(about, ["qid", "rank"]).select("qid", "rank", "label", "source_id", "text", "citation", "section")


def generate(questions: DataFrame, shown: DataFrame, generator: Callable[[DataFrame], DataFrame] | None = None, provider: str = "extractive") -> DataFrame:
    """qid, question, answer, finish, usage, degraded_category, refused_verbatim, truncated, labels, cited, unknown, uncited, malformed, citations.

    Every question gives a row: without sources the category is ``no_sources`` and the generator isn't asked;
    where it fails, answer is null and the category says why. ``generator`` replaces the provider's own; the
    provider's reader reads its replies.
    """
    own, read_reply = answers.PROVIDERS[provider]
    if (generator or own) is None:
        raise ValueError(f"{provider} needs a generator: its service is outside the engine")
    prompts = windows.prompts(shown, questions.select("qid", "question"))
    read = read_reply((generator or own)(prompts))
    labels = shown.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label"))), lambda x: x["label"]).alias("labels"))
    asked = questions.select("qid", "question").join(labels, "qid", "left").join(read.select("qid", "answer", "finish", "usage", "degraded_category", "refused_verbatim", "truncated"), "qid", "left")
    none = F.array().cast("array<string>")
    asked = asked.withColumns({
        "degraded_category": F.when(F.col("labels").isNull(), "no_sources").otherwise(F.col("degraded_category")),
        "labels": F.coalesce("labels", none),
        "refused_verbatim": F.coalesce("refused_verbatim", F.lit(False)),
        "truncated": F.coalesce("truncated", F.lit(False)),
    })
    checked = citations.check_citations(asked.filter("answer is not null").select(F.col("qid").alias("answer_id"), "answer", F.col("labels").alias("known")))
    out = asked.join(checked.withColumnRenamed("answer_id", "qid"), "qid", "left")
    return out.withColumns({**{c: F.coalesce(c, none) for c in ("cited", "unknown", "uncited", "malformed")}, "citations": F.coalesce("citations", F.lit(0).cast("long"))})


def answer_questions(index: DataFrame, questions: DataFrame, encode: Callable[[Column], Column], k: int = search.TOP_K, where: Column | None = None, generator: Callable[[DataFrame], DataFrame] | None = None, provider: str = "extractive") -> tuple[DataFrame, DataFrame]:
    """(answers, their sources) of ``questions`` (qid: long, question) over ``index`` (vec_id, embedding, and as in :func:`sources`)."""
    found = search.search(index, questions.select("qid", encode(F.col("question")).alias("embedding")), k, where)
    hits = stored(found.join(index.select("vec_id", "source_id", "chunk_index", "chunk_total"), "vec_id").drop("vec_id"))
    shown = stored(sources(hits, index))
    return generate(questions, shown, generator, provider), shown
