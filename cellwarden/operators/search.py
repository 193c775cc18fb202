"""Ranked text search, spelling correction, query expansion, snippets and passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellwarden.functions.passages import passage
from cellwarden.functions.text import first_hit, long_distance, segment_probes, segments, snippet, tokens
from cellwarden.operators.text_index import SCORE_DIGITS, TextIndex, scratch_index, search_index
from cellwarden.scale import lookup_join
from cellwarden.session import cut_lineage

# Fixed value: results per page of the rule search.
PAGE_SIZE = 10
# Columns of a rule document that are searched.
RULE_TEXT = (
    "description",
    "processing_rule",
    "processing_rule_tools",
    "severity_determination_rule",
    "severity_determination_rule_tools",
    "vendor",
    "author",
)

#: Letters beyond which two terms are compared beside the diagonal only.
LONG_TERM = 64


def query_terms(queries: DataFrame, query_col: str = "query") -> DataFrame:
    """Distinct (query_id, term) of free-text queries."""
    terms = F.explode(F.array_distinct(tokens(F.col(query_col))))
    return queries.select("query_id", terms.alias("term"))


def text_search(
    docs: DataFrame,
    queries: DataFrame,
    k: int = PAGE_SIZE,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    terms: DataFrame | None = None,
    index: TextIndex | None = None,
) -> DataFrame:
    """The ``k`` best documents of every query (query_id, query) by BM25: query_id, doc_id, score, rank.

    Equal scores (to six digits) are ordered by document id. ``terms`` replaces the query
    tokens, for corrected or expanded queries. ``index`` is an index of the same documents
    written before; without it one is written to the shared folder. So are the results, which
    callers count and join.
    """
    if terms is None:
        terms = query_terms(queries)
    terms = cut_lineage(terms.select("query_id", "term").distinct(), "terms")
    if index is None:
        index = scratch_index(docs, id_col, text_col)
    return cut_lineage(search_index(index, terms, k), "results")


def vocabulary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct terms of a corpus with the number of documents that contain them."""
    terms = docs.select(F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def spell_correct(terms: DataFrame, vocab: DataFrame, max_dist: int = 1) -> DataFrame:
    """For every distinct term its nearest vocabulary term within ``max_dist`` edits.

    Terms found in the vocabulary stay and are not compared. A vocabulary term is cut into ``max_dist + 1`` parts; within that
    many edits less one at least one part stays whole, moved by ``max_dist`` letters at most. So candidates meet by
    equality of length, number of the part and its letters, of which a term makes a fixed number,
    each no longer than the term. Ties: most documents first, then alphabetical.
    """
    asked = cut_lineage(terms.select("term").distinct(), "asked")
    known = cut_lineage(lookup_join(vocab.select("term"), asked, ["term"], "left_semi").distinct(), "known")
    open_terms = lookup_join(asked, known, ["term"], "left_anti")
    left = open_terms.select("term", F.explode(segment_probes(F.col("term"), max_dist)).alias("_part"))
    right = vocab.select(F.col("term").alias("found"), "df", F.explode(segments(F.col("term"), max_dist)).alias("_part"))
    part = [F.col(f"_part.{c}").alias(f"_{c}") for c in ("length", "number", "letters")]

    def near(some: Column, distance: Column) -> DataFrame:
        """Candidates whose common length is ``some``."""
        pairs = lookup_join(
            right.select("found", "df", *part).where(some), left.select("term", *part).where(some), ["_length", "_number", "_letters"]
        )
        return pairs.select("term", "found", "df").distinct().withColumn("distance", distance)

    is_long = F.col("_length") > LONG_TERM
    candidates = near(~is_long, F.levenshtein("term", "found", max_dist)).unionByName(
        near(is_long, long_distance(F.col("term"), F.col("found"), max_dist))
    )
    best = (
        candidates.where(F.col("distance") >= 0)
        .groupBy("term")
        .agg(F.min(F.struct("distance", (-F.col("df")).alias("_rare"), "found")).alias("_best"))
    )
    corrected = open_terms.join(best, "term", "left").select(
        "term", F.col("_best.found").alias("corrected"), F.col("_best.distance").alias("distance")
    )
    return known.select("term", F.col("term").alias("corrected"), F.lit(0).alias("distance")).unionByName(corrected)


def apply_corrections(terms: DataFrame, corrections: DataFrame) -> DataFrame:
    """Query terms with their corrections in place; uncorrectable terms stay."""
    fixed = lookup_join(terms, corrections.select("term", "corrected"), ["term"], "left")
    return fixed.select("query_id", F.coalesce("corrected", "term").alias("term")).distinct()


def expand_query(terms: DataFrame, synonyms: DataFrame) -> DataFrame:
    """(query_id, term): the query terms and everything ``synonyms`` (term, related) adds."""
    added = lookup_join(terms, synonyms.select("term", "related").distinct(), ["term"])
    related = added.select("query_id", F.col("related").alias("term"))
    return terms.select("query_id", "term").unionByName(related).distinct()


def mine_related(
    docs: DataFrame, reach: int = 4, least: int = 5, cut: float = 1.0, k: int = 3, text_col: str = "text"
) -> DataFrame:
    """(term, related, n, information): the ``k`` terms that stand most tellingly near each term of a corpus.

    Two different terms are a pair wherever they are at most ``reach`` tokens apart. Their pointwise information is the logarithm of
    the pair's count over that expected from how often each is in a pair. Pairs met ``least`` times with an information of
    ``cut`` or more count; ties go to the more frequent, then alphabetically. Counting combines before its shuffle.
    """
    words = docs.select(tokens(F.col(text_col)).alias("w"))
    steps = []
    for step in range(1, reach + 1):
        left = F.greatest(F.size("w") - step, F.lit(0))
        zipped = F.arrays_zip(F.slice("w", 1, left).alias("a"), F.slice("w", step + 1, left).alias("b"))
        steps.append(zipped)
    # A text is cut into tokens once for all steps; the outer form keeps a filter that would cut it again from being put before.
    pairs = words.select(F.inline_outer(F.concat(*steps)))
    ordered = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    met = cut_lineage(ordered.groupBy("a", "b").agg(F.count("*").alias("n")), "pairs")
    both = met.select(F.col("a").alias("term"), F.col("b").alias("related"), "n").union(met.select("b", "a", "n"))
    of_term = cut_lineage(both.groupBy("term").agg(F.sum("n").alias("c")), "pair-terms")
    total = of_term.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("t")).first()["t"]  # twice the pairs
    often = both.where(F.col("n") >= least)
    first = lookup_join(often, of_term, ["term"])
    scored = lookup_join(first, of_term.select(F.col("term").alias("related"), F.col("c").alias("d")), ["related"])
    information = F.round(F.log(F.col("n") * F.lit(float(total)) / (F.col("c").cast("double") * F.col("d"))), SCORE_DIGITS)
    order = Window.partitionBy("term").orderBy(F.col("information").desc(), F.col("n").desc(), "related")
    return (
        scored.withColumn("information", information).where(F.col("information") >= cut)
        .withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= k)
        .select("term", "related", "n", "information")
    )


def search_rules(
    rules: DataFrame,
    queries: DataFrame,
    k: int = PAGE_SIZE,
    *,
    max_dist: int = 1,
    synonyms: DataFrame | None = None,
) -> DataFrame:
    """Free-text search over rule documents: rank, id, description and both rule texts.

    Query terms unknown to the rules are corrected to the nearest known term (``max_dist`` 0
    turns this off), then widened by ``synonyms`` (term, related) if given.
    """
    fields = [
        F.array_join(c, " ") if c.endswith("_tools") else F.col(c)
        for c in RULE_TEXT
        if c in rules.columns
    ]
    docs = rules.select(F.col("rule_id").alias("doc_id"), F.concat_ws(" ", *fields).alias("text"))
    terms = query_terms(queries)
    if max_dist:
        known = cut_lineage(vocabulary(docs), "vocabulary")
        fixes = cut_lineage(spell_correct(terms, known, max_dist), "corrections")
        terms = apply_corrections(terms, fixes)
    if synonyms is not None:
        terms = expand_query(terms, synonyms)
    found = text_search(docs, queries, k, terms=terms).withColumnRenamed("doc_id", "rule_id")
    shown = ["rule_id", "description", "severity_determination_rule", "processing_rule"]
    return lookup_join(rules.select(*shown), found, ["rule_id"])


def snippets(
    results: DataFrame,
    docs: DataFrame,
    queries: DataFrame,
    width: int = 80,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Add the text around the first place where any query term occurs.

    The results (at most k per query) go to the documents, so the texts are not shuffled while
    the results fit the broadcast bound.
    """
    asked = queries.select("query_id", F.array_distinct(tokens(F.col("query"))).alias("_terms"))
    wanted = lookup_join(results, asked, ["query_id"])
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    return (
        lookup_join(texts, wanted, ["doc_id"])
        .withColumn("_place", first_hit(F.col("_text"), F.col("_terms")))
        .withColumn("snippet", snippet(F.col("_text"), F.col("_place"), width))
        .drop("_text", "_terms", "_place")
    )


def passages(
    results: DataFrame, docs: DataFrame, terms: DataFrame, width: int = 30, *, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Add the passage of each result: the window of ``width`` tokens with most distinct query terms.

    ``terms`` (query_id, term) are those that were searched, so corrected ones count. Added are ``passage``,
    ``first_token`` and ``last_token`` (from 0) of the terms' window, and ``distinct_terms``. As with
    snippets, the results go to the texts.
    """
    asked = terms.groupBy("query_id").agg(F.array_sort(F.collect_set("term")).alias("_terms"))
    wanted = lookup_join(results, asked, ["query_id"])
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    made = lookup_join(texts, wanted, ["doc_id"]).withColumn("_p", passage(F.col("_text"), F.col("_terms"), width))
    return made.select(
        *results.columns, F.col("_p.passage").alias("passage"), F.col("_p.first_token").alias("first_token"),
        F.col("_p.last_token").alias("last_token"), F.col("_p.distinct_terms").alias("distinct_terms"),
    )
