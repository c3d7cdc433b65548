"""Registered corpus queries against their SQL, and the pipeline against its stages' brute-force versions."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))
from compare import connect, rows  # noqa: E402

from marlstone.llm import queries, suffixes  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_gives_what_its_sql_gives(spark, name):
    got = queries.queries()[name](spark, SF).toPandas()
    assert rows(got) == rows(connect(SF).execute(queries.oracle_sql()[name]).fetchdf())


def test_pipeline_stages(spark):
    import corpus_pipeline as p
    from test_operators import brute_classes, words

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(p.STAGES)
    clean = stage["toxicity"](spark, docs, SF).collect()
    assert 0.8 * docs.count() < len(clean) <= docs.count()
    frame = spark.createDataFrame(clean, docs.schema)
    kept = stage["ngram_jaccard_join"](spark, frame, SF).collect()
    want = {d for d, _, c in brute_classes([(r["doc_id"], r["text"]) for r in clean], 5, 80) if d == c}
    assert {r["doc_id"] for r in kept} == want
    cut = {r["doc_id"]: r["text"] for r in stage["suffix_array_dedup"](spark, spark.createDataFrame(kept, docs.schema), SF).collect()}
    seen = set()
    for r in sorted(kept, key=lambda r: r["doc_id"]):
        w, gone = words(r["text"]), set()
        for k in range(len(w) - 49):
            g = tuple(w[k : k + 50])
            gone |= set(range(k, k + 50)) if g in seen else set()
            seen.add(g)
        left = suffixes.cut_words(r["text"], suffixes.joined([(k, k + 1) for k in sorted(gone)]))
        assert (cut.get(r["doc_id"]) == left) if len(gone) < len(w) or not w else r["doc_id"] not in cut
    out = p.run(spark, SF)
    assert out.select("doc_id").distinct().count() == len(cut)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids", "decoded_sha256"]


def test_pipeline_stages_on_odd_rows(spark, corpus, nothing):
    """Null and repeated ids, null, empty and long texts, repeated rows, an empty table, columns with clashing names."""
    import corpus_pipeline as p

    df, rows = corpus
    clash = df.withColumn("th", df["doc_id"]).withColumn("mix_pass", df["n"]).withColumn("ids", df["n"])
    for name, stage in p.STAGES:
        out = stage(spark, clash, SF)
        assert out.columns == (p.COLUMNS if name != "bpe" else ["doc_id", "source", "n_tokens", "ids", "decoded_sha256"])
        got = [r["doc_id"] for r in out.collect()]
        empty = stage(spark, nothing, SF)
        assert empty.count() == 0 and empty.columns == out.columns
        if name in ("toxicity", "bpe"):  # nothing here is toxic
            assert len(got) == len(rows) and got.count(None) == 2
        elif name == "ngram_jaccard_join":
            # texts[1] and its copies are one; the repeated row 4 is one; without words all stay; the null-id copy of texts[2] goes
            assert got.count(1) == 1 and got.count(4) == 1 and got.count(None) == 1 and not {72, 73, 80} & set(got)
        elif name == "suffix_array_dedup":
            assert got.count(4) == 3 and len(got) < len(rows)
        else:
            assert all(got.count(i) >= [r[0] for r in rows].count(i) for i in set(got)) and set(got) == {r[0] for r in rows}
