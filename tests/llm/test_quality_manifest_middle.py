"""Compression quality, Merkle manifest and fill-in-the-middle against brute force, SQL, and on odd rows."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from cellwarden.llm import compression_quality, fill_middle, merkle, queries
from cellwarden.llm.oracles import ORACLES

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977} And{i % 13}" for i in range(20_000))
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string, root string, path string, n string"
#: Nulls in every column, empty and long texts, repeated rows and ids, and columns called as internal or result columns are.
ODD = [
    (1, None, "en", "a", 3, "x", "x", "x", "x"), (2, "", "en", "", 0, None, None, None, None), (3, "One two", None, None, None, "x", "x", "x", "x"),
    (3, "One two", None, None, None, "x", "x", "x", "x"), (None, "No Id", "en", "a", 5, "x", "x", "x", "x"), (None, "No Id", "en", "a", 5, "x", "x", "x", "x"),
    (None, "Other", "en", "a", 5, "x", "x", "x", "x"), (4, LONG, "", "a", len(LONG), "x", "x", "x", "x"), (5, "ÄÖ \U0001f600 é\x00\r\n", "É", "a", 9, "x", "x", "x", "x"),
    (6, "a <S> marker", "z", "a", 9, "x", "x", "x", "x"), (7, "x" * 5000, "z", "a", 9, "x", "x", "x", "x"), (8, "<" * 40 + "P>", "z", "a", 1, "x", "x", "x", "x"),
    (9, "tail <P", "z", "a", 1, "x", "x", "x", "x"),
]


def write(spark, rows, path, schema=COLUMNS):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def answers(df):
    return sorted(map(tuple, df.collect()), key=str)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_fill_middle"])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    found = queries.QUERIES[name](spark, SF)
    result = con.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(found.columns) == sorted(columns)
    assert answers(found.select(*columns)) == sorted(result.fetchall(), key=str)


# --- fill in the middle


def brute_middle(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    h = [int(sha(f"1:{'' if doc_id is None else doc_id}")[i : i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    form = "spm" if h[3] % 100 < 20 else "psm"
    out = f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, form, len(p), len(m), sha(out), sha(text)


def test_middle_of_odd_rows(spark, tmp_path):
    folder = write(spark, ODD, tmp_path)
    expected = sorted((brute_middle(r[0], r[1]) for r in ODD), key=str)
    assert answers(queries.op13_fill_middle(spark, folder)) == expected


def test_middle_of_every_form(spark, tmp_path):
    """Many short texts, so that all forms and cuts at both ends occur."""
    rows = [(i, "ab c<d\n"[: i % 8], None, None, None, None, None, None, None) for i in range(600)]
    found = answers(queries.op13_fill_middle(spark, write(spark, rows, tmp_path)))
    assert found == sorted((brute_middle(r[0], r[1]) for r in rows), key=str)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}


def test_middle_of_an_empty_table(spark, tmp_path):
    assert answers(queries.op13_fill_middle(spark, write(spark, [], tmp_path))) == []


@pytest.mark.parametrize("window", [1, 2, 7, 64])
def test_units_are_the_same_in_windows(window):
    for text in ("", "a", "ab cd", "a1b22 ", "x" * 300, "-" * 100, "ab é\U0001f600cd\n" * 20, " lead", "word " * 40 + "y" * 90):
        ends = fill_middle.unit_ends(text, window).tolist()
        assert ends == [m.end() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]


# --- Merkle manifest


def tree(nodes):
    """All levels of a tree."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    return levels


def sides(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 8 * 8
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + 8])))
        at //= 8
    return out


def leaf(row):
    texts = [row["doc_id"], row["source"], row["lang"], row["n_chars"], row["text"]]
    return sha("".join("-" if t is None else f"{len(str(t).encode())}:{t}" for t in texts))


def lowered(text):
    return text if text is None else re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute_manifest(rows):
    names = sorted({r["lang"] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = {}
    for name in names:
        mine = [(r, leaf(r)) for r in rows if r["lang"] == name]
        groups[name] = sorted(mine, key=lambda x: (x[0]["doc_id"] is not None, x[0]["doc_id"] or 0, x[1]))
    trees = {name: tree([h for _, h in mine]) for name, mine in groups.items()}
    top = tree([trees[name][-1][0] for name in names])
    out = []
    for place, name in enumerate(names):
        for at, (row, own) in enumerate(groups[name]):
            path = sides(trees[name], at) + sides(top, place)
            now = own
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0:
                now = leaf({**row, "text": lowered(row["text"])})
            for left, right in path:
                now = sha(left + now + right)
            root = top[-1][0]
            out.append((row["doc_id"], own, trees[name][-1][0], root, sha("".join(a + b for a, b in path)), now, now == root))
    return sorted(out, key=str)


def test_manifest_of_odd_rows(spark, tmp_path):
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    found = answers(queries.op12_merkle_manifest(spark, write(spark, ODD, tmp_path)))
    assert found == brute_manifest([dict(zip(names, r)) for r in ODD])
    assert {r[-1] for r in found} == {True, False}


def test_manifest_of_an_empty_table(spark, tmp_path):
    assert answers(queries.op12_merkle_manifest(spark, write(spark, [], tmp_path))) == []


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_of_groups_of_all_sizes(spark, levels):
    """Groups around the powers of eight and more of them than one run, over one layer and over several."""
    sizes = [1, 2, 7, 8, 9, 63, 64, 65, 72, 129, 512, 513, 600]
    rows = [
        dict(doc_id=1000 * g + i, text=f"Text {i}", lang=f"g{g:02d}", source="s", n_chars=i) for g, size in enumerate(sizes) for i in range(size)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    made = merkle.manifest(queries.document_leaves(docs), ["doc_id", "digest"], levels)
    found = made.proofs().select(
        "item.doc_id", "digest", "subroot", "root", merkle.digest(merkle.siblings(F.col("path"))).alias("proof"),
        merkle.folded(F.coalesce("item.start", "digest"), F.col("path")).alias("folded"),
    )
    assert answers(found.withColumn("ok", F.col("folded") == F.col("root"))) == brute_manifest(rows)
    assert len(made.layers) == max(1, math.ceil(round(math.log(600, 8), 6) / levels))


def test_manifest_does_not_depend_on_the_partitions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = set()
    for parts in (1, 11):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        made = merkle.manifest(queries.document_leaves(docs.repartition(parts)), ["doc_id", "digest"])
        seen.add(made.proofs().agg(F.sum(F.xxhash64("item", "path") % 1_000_003), F.min("root"), F.max("root")).first())
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert len(seen) == 1


# --- compression quality


def test_held_out_accuracy_of_quality(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.op11_compression_quality(spark, folder)
    joined = found.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out and quality is not null").collect()
    assert len(joined) > 50
    assert sum(r["predicted"] == r["quality"] for r in joined) >= 0.9 * len(joined)
    assert found.count() == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_quality_does_not_depend_on_the_partitions(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    seen = []
    for parts in (1, 4, 11):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        model = queries.quality_model(docs.repartition(parts), labels.repartition(parts))
        seen.append(answers(compression_quality.score(docs.repartition(parts), model)))
    spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert seen[0] == seen[1] == seen[2] and len({r[2] for r in seen[0]}) > 5


def test_differences_are_those_of_blocks():
    texts = ["", None, "a" * 3000, LONG, "short"]
    bad, good = (compression_quality.compressor(compression_quality.dictionary([s.encode()])) for s in ("aaaa bbbb" * 50, "word1 And2 " * 90))
    found = compression_quality.differences(pa.array(texts), bad, good)
    for text, x in zip(texts, found):
        raw = (text or "").encode()
        cut = [raw[i : i + 1024] for i in range(0, len(raw), 1024)]
        total = sum(len(bad.compress(c)) - len(good.compress(c)) for c in cut)
        assert x == (total / len(raw) if raw else 0.0)


def test_few_samples_give_a_dictionary():
    assert compression_quality.dictionary([]) == b""
    assert compression_quality.dictionary([b"one"]) == b"one"
    assert isinstance(compression_quality.compressor(b"one").compress(b"one one"), bytes)
    many = [f"sample number {i} of some length {i * i}".encode() for i in range(2000)]
    assert zstandard.ZstdCompressionDict(compression_quality.dictionary(many, 4096)).dict_id()


def test_rising_curve():
    x = np.array([3.0, 1, 2, 4, 5, 1])
    y = np.array([0.0, 0, 1, 1, 1, 0])
    knots, shares = compression_quality.rising(x, y, np.ones(6))
    assert knots.tolist() == [1.0, 2.5, 4.0, 5.0] or (np.diff(knots) > 0).all()
    assert (np.diff(shares) >= 0).all() and 0 < shares.min() and shares.max() < 1
    heavy = compression_quality.rising(x, y, np.where(y == 1, 10.0, 1.0))
    assert np.interp(2.5, *heavy) > np.interp(2.5, knots, shares)


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame(ODD, COLUMNS)
    labels = [(2, 1), (3, 1), (4, 1), (5, 0), (6, 0), (7, 0), (8, None), (1, 7)]
    for known in (labels, [r for r in labels if r[1] != 0], []):
        model = queries.quality_model(docs, spark.createDataFrame(known, "doc_id long, quality int"))
        found = compression_quality.score(docs, model).collect()
        assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in ODD)
        assert all(0 <= r["score"] <= 1 for r in found)
        assert len({r["score"] for r in found if r["doc_id"] == 3}) == 1
    assert {r["score"] for r in found} == {0.0}
    assert compression_quality.score(docs.limit(0), model).count() == 0
