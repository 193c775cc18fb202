import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cellwarden.functions.text import html_title, html_to_text
from cellwarden.functions.passages import best_window
from cellwarden.operators import documents, search, text_index
from cellwarden.session import scratch_path
from tests.conftest import rows


def words(text):
    return re.findall("[a-z0-9]+", text.lower())


def brute_bm25(docs, queries, k):
    cut = {i: words(t) for i, t in docs}
    mean = sum(map(len, cut.values())) / len(cut)
    df = Counter(t for ws in cut.values() for t in set(ws))
    found = []
    for q, text in queries:
        scores = {}
        for i, ws in cut.items():
            tf = Counter(ws)
            terms = [t for t in set(words(text)) if tf[t]]
            if terms:
                scores[i] = round(sum(
                    math.log(1 + (len(cut) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2
                    / (tf[t] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for t in terms), 6)
        ranked = sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:k]
        found += [(q, i, s, r) for r, (i, s) in enumerate(ranked, start=1)]
    return sorted(found, key=str)


def corpus(seed=4):
    rng = random.Random(seed)
    vocab = [f"w{n}" for n in range(30)]
    docs = [(i, " ".join(["the"] * rng.randrange(5) + rng.choices(vocab, k=rng.randrange(1, 40)))) for i in range(60)]
    docs += [(100, "THE W1, w1; W2"), (101, "the w1 w1 w2"), (102, ""), (103, "... !!!")]
    return docs, [(0, "w1 W1 w2 the"), (1, "w29"), (2, "unseen"), (3, "")]


@pytest.mark.parametrize("block_docs", [3, 1024])
def test_bm25_matches_brute_force(spark, block_docs):
    docs, asked = corpus()
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    index = text_index.build_index(d, scratch_path(spark, "index"), block_docs=block_docs)
    for k in (2, 10):
        whole = search.text_search(d, spark.createDataFrame(asked, "query_id long, query string"), k, index=index)
        assert rows(whole, "query_id", "doc_id", "score", "rank") == brute_bm25(docs, asked, k)


def test_blocks_below_the_floor_are_not_scored(spark, monkeypatch):
    """Of many blocks only those whose bound reaches the k-th score are visited, and the result is exact."""
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices([f"w{n}" for n in range(400)], k=rng.randrange(20, 900)))) for i in range(300)]
    docs += [(1000 + i, "rare other words here") for i in range(4)]
    asked = [(0, "rare words"), (1, "w1 w2"), (2, "")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    index = text_index.build_index(d, scratch_path(spark, "index"), block_docs=4)
    visited, plain = [], text_index._scored

    def counting(index, visits, *rest):
        visited.append(visits.count())
        return plain(index, visits, *rest)

    monkeypatch.setattr(text_index, "_scored", counting)
    found = search.text_search(d, spark.createDataFrame(asked, "query_id long, query string"), 4, index=index)
    assert rows(found, "query_id", "doc_id", "score", "rank") == brute_bm25(docs, asked, 4)
    blocks = index.table("stats").first()["blocks"]
    assert blocks > 60 and sum(visited) < blocks
    joined = found._jdf.queryExecution().optimizedPlan().toString()
    assert "doc_id" in joined and "Join" not in joined


def test_search_moves_documents_whole_and_looks_up_blocks_and_terms_apart(spark, monkeypatch):
    """No row per document and term is written, and no table of pairs of block and term is met with the lists."""
    rng = random.Random(11)
    docs = [(i, " ".join(rng.choices([f"w{n}" for n in range(60)], k=rng.randrange(20, 300)))) for i in range(120)]
    docs.append(docs[0])  # the same row twice: its terms add up
    asked = [(i, f"w{i} w{i + 1} w{i + 2}") for i in range(40)]
    written, met, cut, join = {}, [], text_index.cut_lineage, text_index.lookup_join

    def writing(df, name="step"):
        written[name] = (table := cut(df, name)).count()
        return table

    def joining(facts, table, on, *rest):
        met.append(list(on))
        return join(facts, table, on, *rest)

    monkeypatch.setattr(text_index, "cut_lineage", writing)
    monkeypatch.setattr(text_index, "lookup_join", joining)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    index = text_index.build_index(d, scratch_path(spark, "index"), block_docs=8)
    assert written["counted"] == len(docs)
    twice = index.table("postings").select(F.explode(F.arrays_zip("docs", "weights"))).where("col.docs = 0")
    assert twice.count() == len(set(docs[0][1].split()))
    found = search.text_search(d, spark.createDataFrame(asked, "query_id long, query string"), 4, index=index)
    assert found.count() == 160 and ["block", "term"] not in met


def test_lists_are_made_in_their_block_and_long_documents_make_smaller_blocks(spark, monkeypatch):
    """Ids that are text, null or repeat; a row that comes twice adds up; no block holds much more than the bounded tokens."""
    monkeypatch.setattr(text_index, "BLOCK_TOKENS", 60)
    rng = random.Random(5)
    docs = [(f"d{i:02d}", " ".join(rng.choices("abcdefgh", k=20))) for i in range(40)]
    docs += [docs[3], docs[3], ("d05", "A, b!"), (None, "b c"), ("none", None), ("empty", "!")]
    index = text_index.build_index(spark.createDataFrame(docs, "doc_id string, text string").repartition(3), scratch_path(spark, "index"))
    words = Counter((i, t) for i, t in docs if t is not None)
    parts = {(i, t): Counter(re.findall("[a-z]", t.lower())) for i, t in words}
    mean = sum(sum(c.values()) for c in parts.values()) / len(parts)
    weights = Counter()  # two texts of one id add up
    for (i, t), tfs in parts.items():
        for term, tf in tfs.items():
            n = tf * words[i, t]
            weights[term, i] += n * 2.2 / (n + 1.2 * (0.25 + 0.75 * sum(tfs.values()) / mean))
    expected = {}
    for (term, i), weight in weights.items():
        expected.setdefault(term, []).append((i, round(weight, 9)))
    found = {}
    for r in index.table("postings").collect():
        pairs = list(zip(r.docs, r.weights))
        assert pairs == sorted(pairs, key=lambda p: (p[0] is not None, p[0] or "")) and r.top == max(r.weights)
        found.setdefault(r.term, []).extend((i, round(w, 9)) for i, w in pairs)
    assert {t: sorted(p, key=str) for t, p in found.items()} == {t: sorted(p, key=str) for t, p in expected.items()}
    stats = index.table("stats").first()
    assert stats["n"] == len(parts) and stats["blocks"] >= 800 / 60
    df = {r.term: r.df for r in index.table("terms").collect()}
    assert df == Counter(t for c in parts.values() for t in c)


def test_index_of_odd_documents(spark):
    for docs in ([], [(1, None), (2, ""), (3, "!!")], [(1, "a"), (1, "a b"), (None, "a")]):
        d = spark.createDataFrame(docs, "doc_id long, text string")
        asked = spark.createDataFrame([(0, "a"), (1, None)], "query_id long, query string")
        found = search.text_search(d, asked, 5).collect()
        assert {r["query_id"] for r in found} <= {0} and len(found) == (2 if len(docs) == 3 and docs[0][1] == "a" else 0)


def brute_window(tokens, wanted, width):
    best = None
    for i in range(len(tokens)):
        for j in range(i, min(len(tokens), i + width)):
            if tokens[i] in wanted and tokens[j] in wanted:
                found = (-len(wanted.intersection(tokens[i : j + 1])), j - i, i)
                best = min(best or found, found)
    return best and (best[2], best[2] + best[1], -best[0])


def test_window_matches_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        tokens = rng.choices("abcdefgh", k=rng.randrange(1, 40))
        wanted, width = set(rng.sample("abcdxyz", rng.randrange(1, 5))), rng.randrange(1, 12)
        hits = [(i, t) for i, t in enumerate(tokens) if t in wanted]
        if hits:
            assert best_window([i for i, _ in hits], [t for _, t in hits], width) == brute_window(tokens, wanted, width)


def test_passage_is_cut_from_the_whole_text(spark):
    text = "Filler, " * 4000 + "the RSSI (level) of Cell-7 is low; " + "filler " * 50 + "level"
    docs = spark.createDataFrame([(1, text), (2, "Cell"), (3, None)], "doc_id long, text string")
    terms = spark.createDataFrame([(5, "rssi"), (5, "cell"), (5, "low"), (6, "none")], "query_id long, term string")
    results = spark.createDataFrame([(5, 1, 1), (5, 2, 2), (6, 2, 1), (5, 3, 3)], "query_id long, doc_id long, rank int")
    found = {(r.query_id, r.doc_id): r for r in search.passages(results, docs, terms, 8).collect()}
    assert found[5, 1].passage == "RSSI (level) of Cell-7 is low; filler" and found[5, 1].distinct_terms == 3
    assert (found[5, 1].first_token, found[5, 1].last_token) == (4001, 4007)
    assert found[5, 2].passage == "Cell" and found[6, 2].passage is None and found[5, 3].passage is None


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("max_dist", [1, 2])
def test_spelling_finds_every_nearest_term(spark, max_dist):
    rng = random.Random(8)
    vocab = {"".join(rng.choices("abc1", k=rng.randrange(1, 7))): rng.randrange(1, 4) for _ in range(150)}
    asked = {"".join(rng.choices("abc1", k=rng.randrange(1, 8))) for _ in range(80)} | {"zzzzzzzz"}
    found = {r.term: (r.corrected, r.distance) for r in search.spell_correct(
        spark.createDataFrame([(t,) for t in asked], "term string"),
        spark.createDataFrame(list(vocab.items()), "term string, df long"), max_dist).collect()}
    for term in asked:
        near = sorted((edit_distance(term, v), -df, v) for v, df in vocab.items())
        best = next(((v, d) for d, _, v in near if d <= max_dist), (None, None))
        assert found[term] == best
    assert len(found) == len(asked)


def test_corrections_and_expansion(spark):
    terms = spark.createDataFrame([(1, "drp"), (1, "call"), (2, "qqq")], "query_id int, term string")
    fixed = search.apply_corrections(terms, spark.createDataFrame([("drp", "drop"), ("qqq", None)], "term string, corrected string"))
    assert rows(fixed) == [(1, "call"), (1, "drop"), (2, "qqq")]
    related = spark.createDataFrame([("drop", "release"), ("drop", "call"), ("x", "y")], "term string, related string")
    assert rows(search.expand_query(fixed, related)) == [(1, "call"), (1, "drop"), (1, "release"), (2, "qqq")]


def test_rule_search_corrects_and_expands(spark):
    store = spark.createDataFrame(
        [("drops", "High call drop levels", "Check the uplink", ["get_uplink_rssi_level"], "High if above 3.5", [], "Acme", "J"),
         ("rate", "Success rate", "Check traces", [], "High if below 95", [], "Acme", "J")],
        "rule_id string, description string, processing_rule string, processing_rule_tools array<string>, "
        "severity_determination_rule string, severity_determination_rule_tools array<string>, vendor string, author string",
    )
    asked = spark.createDataFrame([(1, "uplnk"), (2, "release"), (3, "rssi"), (4, "acme")], "query_id int, query string")
    related = spark.createDataFrame([("release", "drop")], "term string, related string")
    columns = ["query_id", "rule_id", "rank"]
    found = {r[:2] for r in rows(search.search_rules(store, asked), *columns)}
    assert found == {(1, "drops"), (3, "drops"), (4, "rate"), (4, "drops")}
    wide = search.search_rules(store, asked, max_dist=0, synonyms=related)
    assert {r[:2] for r in rows(wide, *columns)} == {(2, "drops"), (3, "drops"), (4, "rate"), (4, "drops")}
    first = wide.where("query_id = 2").first()
    assert first.description == "High call drop levels" and first.processing_rule == "Check the uplink"


def test_snippet_is_taken_from_the_whole_text(spark):
    long = "filler " * 5000 + "The RSSI level is low"
    docs = spark.createDataFrame([(1, long), (2, "RSSI")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "rssi missing")], "query_id long, query string")
    found = search.snippets(search.text_search(docs, asked, 2), docs, asked, 20)
    texts = {r.doc_id: r.snippet for r in found.collect()}
    assert texts[2] == "RSSI" and "RSSI" in texts[1] and len(texts[1]) == 20


def test_html_text(spark):
    page = "<HTML><head><title>A b</title><style>x{}</style></head><!-- no --><body>Hi<br>\n there<script>1<2</script></body>"
    df = spark.createDataFrame([(page,)], "html string")
    assert df.select(html_to_text(F.col("html")), html_title(F.col("html"))).first()[:] == ("A b Hi there", "A b")


CHUNKS = (
    "id int, chunks array<struct<web:struct<uri:string,title:string>,"
    "retrieved_context:struct<document_name:string,text:string>>>"
)


def test_references_and_grounding(spark):
    df = spark.createDataFrame(
        [
            (1, [(None, ("d/1", "doc")), (("http://x", "X"), ("d/2", "both")), (None, None)]),
            (2, [(None, None)]),
            (3, []),
            (4, None),
        ],
        CHUNKS,
    ).withColumn("refs", documents.extract_references(F.col("chunks"), "store/"))
    found = {r.id: [tuple(x) for x in r.refs] for r in df.collect()}
    assert found == {1: [("store/d/1", "doc"), ("http://x", "X")], 2: [], 3: [], 4: []}
    gated = df.select("id", documents.grounding_gate(F.lit("yes"), F.col("refs"), documents.NO_INTERNAL).alias("a"))
    assert rows(gated) == [(1, "yes"), (2, documents.NO_INTERNAL), (3, documents.NO_INTERNAL), (4, documents.NO_INTERNAL)]


def test_retrieval_answers_each_incident_and_respects_the_allow_list(spark):
    incidents = spark.createDataFrame(
        [("i", "call drops", [("retainability", 4.0)]), ("j", "call drops", [("retainability", 9.0)]), ("k", "none", [("zzz", 1.0)])],
        "incident_id string, description string, kpi_missed array<struct<kpi:string,value:double>>",
    )
    docs = spark.createDataFrame([(1, "drops of a call", "T1"), (2, "other", "T2")], "doc_id long, text string, title string")
    found = {r.incident_id: r for r in documents.retrieve_docs(incidents, docs).collect()}
    assert set(found) == {"i", "j", "k"}
    assert [r.title for r in found["i"].references] == ["T1"] and found["i"].search_result == "T1"
    assert found["i"].references == found["j"].references
    assert found["k"].references == [] and found["k"].search_result == documents.NO_INTERNAL
    pages = spark.createDataFrame(
        [(1, "http://a/", "<title>A</title>call"), (2, "http://b/", "<title>B</title>call call")], "page_id long, url string, html string"
    )
    allow = spark.createDataFrame([("http://a/",)], "url string")
    external = {r.incident_id: r for r in documents.retrieve_pages(incidents, pages, allow).collect()}
    assert [(r.url, r.title) for r in external["i"].references] == [("http://a/", "A")]
    assert external["k"].search_result == documents.NO_EXTERNAL


def test_snippets_start_at_whole_words(spark):
    docs = spark.createDataFrame([(1, "retainability was poor when the cell failed in may")], "doc_id int, text string")
    asked = spark.createDataFrame([("q", "in"), ("none", "!?")], "query_id string, query string")
    results = spark.createDataFrame([("q", 1, 1), ("none", 1, 1)], "query_id string, doc_id int, rank int")
    found = {r.query_id: r.snippet for r in search.snippets(results, docs, asked, 10).collect()}
    assert found == {"q": "iled in ma", "none": None}
