"""Registered queries next to their SQL, and the pipeline stage by stage."""

import collections
import itertools

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.test_operators import brute_links, brute_spans, check_places, words
from tools import check
from tuneloom.llm import language, queries


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_its_sql(spark, data, name):
    kind, n, _, note, _ = check.compare(spark, check.duck(data), data, name)
    assert kind == "ok" and n > 0, note


@pytest.mark.parametrize(("name", "columns"), [
    ("op1_language_id", ["doc_id", "held_out", "lang_pred", "score"]), ("op3_token_counts", ["doc_id", "n_bytes", "n_tokens", "over_limit"]),
    ("op5_html_text", ["page_id", "url", "text", "n_chars"]), ("op8_quality", ["doc_id", "held_out", "score", "predicted"]),
    ("op9_packing", ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]), ("op10_url_filter", ["page_id", "host", "path", "rule", "verdict"])])
def test_columns_and_rows(spark, data, name, columns):
    found = entry.queries()[name](spark, data)
    assert found.columns[:len(columns)] == columns
    table = spark.read.parquet(f"{data}/{'pages' if columns[0] == 'page_id' else 'documents'}.parquet")
    assert found.select(columns[0]).distinct().count() == table.count()
    assert name == "op9_packing" or found.count() == table.count()


def test_pipeline_against_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    frame = docs
    for (name, stage), number in zip(corpus_pipeline.STAGES, itertools.count(), strict=False):
        made = stage(spark, frame, data)
        if number == 4:
            rows = made.collect()
            check_places(rows)
            assert {r["doc_id"] for r in rows} == set(left)
            break
        assert made.columns == docs.columns
        kept = {r["doc_id"] for r in made.collect()}
        if number == 0:
            found = language.identify(docs, docs.where(~language.held_out())).collect()
            want = {r["doc_id"] for r in found if r["lang_pred"] != "und" and r["score"] >= language.LEAST_SCORE}
        elif number == 1:
            last = {}
            for i, t in sorted(left.items()):
                last[(t or "").lower() if t and t.isascii() else "".join(c.lower() if c.isascii() else c for c in t or "")] = i
            want = set(last.values())
        elif number == 2:
            want = {i for i, (group, _, _) in brute_links_sparse(left).items() if i == group}
        else:
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
            want = {k[0] for k in brute_spans(left.items(), items) if not k[2]}
        assert kept == want, name
        left = {i: left[i] for i in kept}
        frame = docs.where(F.col("doc_id").isin(list(kept)))
    assert corpus_pipeline.run(spark, data).count() == len(rows)


def brute_links_sparse(texts):
    """As brute_links, on the texts that share a shingle with another one."""
    seen = collections.Counter(s for t in texts.values() for s in set(zip(*[words(t)[k:] for k in range(5)])))
    shared = {i: t for i, t in texts.items() if any(seen[s] > 1 for s in zip(*[words(t)[k:] for k in range(5)])) or len(words(t)) < 5}
    return {i: (i, i, 0) for i in texts} | brute_links(shared.items())
