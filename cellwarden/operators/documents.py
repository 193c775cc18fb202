"""Documentation for incidents: retrieval, references and the grounding check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwarden.functions.text import html_title, html_to_text
from cellwarden.operators.search import PAGE_SIZE, passages, query_terms, text_search
from cellwarden.operators.text_index import TextIndex
from cellwarden.scale import lookup_join
from cellwarden.schemas import REFERENCE

# Address prefix of stored documents; pass the one of your document store.
DOCUMENT_PREFIX = "documents/"
# The two messages.
NO_INTERNAL = "Internal search haven't found any documents or the search failed."
NO_EXTERNAL = "External search haven't found any documents or the search failed."

REFERENCES = f"array<{REFERENCE.simpleString()}>"


def extract_references(chunks: Column, prefix: str = DOCUMENT_PREFIX) -> Column:
    """References of the chunks of one answer, in order.

    A chunk is a struct with ``web`` (uri, title) and ``retrieved_context`` (document_name,
    text); chunks with neither are dropped. One expression per row: nothing is gathered.
    """

    def reference(chunk: Column) -> Column:
        web = F.struct(chunk["web"]["uri"].alias("url"), chunk["web"]["title"].alias("title"))
        context = chunk["retrieved_context"]
        stored = F.struct(
            F.concat(F.lit(prefix), context["document_name"]).alias("url"),
            context["text"].alias("title"),
        )
        return F.when(chunk["web"].isNotNull(), web).when(context.isNotNull(), stored)

    return F.coalesce(F.array_compact(F.transform(chunks, reference)), F.array().cast(REFERENCES))


def grounding_gate(answer: Column, references: Column, message: str) -> Column:
    """The answer, or ``message`` where it has no references."""
    return F.when(F.size(references) > 0, answer).otherwise(F.lit(message))


def incident_queries(incidents: DataFrame) -> DataFrame:
    """(incident_id, query): description and names of the missed KPIs."""
    words = F.concat_ws(" ", "description", F.array_join("kpi_missed.kpi", " "))
    return incidents.select("incident_id", words.alias("query"))


def _retrieve(incidents: DataFrame, docs: DataFrame, k: int, chunk: Column, empty: str, index: TextIndex | None) -> DataFrame:
    """Search once per distinct query text, then hand the result to all its incidents.

    Incidents of the same KPI ask the same question, so the search does not grow with them. The
    answer is the best passage of each document found, best document first.
    """
    asked = incident_queries(incidents)
    questions = asked.select("query").distinct().withColumn("query_id", F.sha2("query", 256))
    found = passages(text_search(docs, questions, k, index=index), docs, query_terms(questions))
    texts = lookup_join(docs.drop("text"), found, ["doc_id"]).withColumn("chunk", chunk)
    hits = texts.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk", F.col("passage").alias("answer")))).alias("hits")
    )
    answered = questions.join(hits, "query_id", "left").select(
        "query",
        F.array("query").alias("queries"),
        extract_references(F.transform("hits", lambda h: h["chunk"])).alias("references"),
        F.array_join(F.transform("hits", lambda h: h["answer"]), "\n").alias("_answer"),
    ).withColumn("search_result", grounding_gate(F.col("_answer"), F.col("references"), empty))
    return lookup_join(asked, answered.drop("_answer"), ["query"], "left").drop("query")


_WEB = "struct<uri:string,title:string>"
_CONTEXT = "struct<document_name:string,text:string>"


def retrieve_docs(
    incidents: DataFrame, docs: DataFrame, k: int = PAGE_SIZE, *, id_col: str = "doc_id", title_col: str = "title",
    index: TextIndex | None = None,
) -> DataFrame:
    """Internal documents per incident: queries, references (best first) and the passages found.

    ``index`` is a written index of the documents' texts, if there is one.
    """
    corpus = docs.select(F.col(id_col).alias("doc_id"), "text", F.col(title_col).alias("_title"))
    chunk = F.struct(
        F.lit(None).cast(_WEB).alias("web"),
        F.struct(
            F.col("doc_id").cast("string").alias("document_name"), F.col("_title").alias("text")
        ).alias("retrieved_context"),
    )
    return _retrieve(incidents, corpus, k, chunk, NO_INTERNAL, index)


def allowed_pages(pages: DataFrame, allow: DataFrame) -> DataFrame:
    """Pages whose URL is on the allow-list (url), as (doc_id, url, title, text)."""
    kept = lookup_join(pages, allow.select("url").distinct(), ["url"], "left_semi")
    return kept.select(
        F.col("page_id").alias("doc_id"),
        "url",
        html_title(F.col("html")).alias("title"),
        html_to_text(F.col("html")).alias("text"),
    )


def retrieve_pages(incidents: DataFrame, pages: DataFrame, allow: DataFrame, k: int = PAGE_SIZE) -> DataFrame:
    """External pages per incident, over allow-listed URLs only."""
    chunk = F.struct(
        F.struct(F.col("url").alias("uri"), F.col("title").alias("title")).alias("web"),
        F.lit(None).cast(_CONTEXT).alias("retrieved_context"),
    )
    return _retrieve(incidents, allowed_pages(pages, allow), k, chunk, NO_EXTERNAL, None)
