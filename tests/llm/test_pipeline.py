"""The pipeline against a plain version of its stages, and the registered queries against their SQL."""

from __future__ import annotations

import os
import re

import duckdb
import pytest

import corpus_pipeline
from purchaseflow.llm import common, queries
from tests.llm.test_operators import brute_exact, brute_measures, brute_near, brute_spans


def plain_stages(rows):
    """Ids after rules, exact copies and near copies; texts after passages; all by brute force."""

    def passes(text):
        n, chars, symbols, dup, rep = brute_measures(text)
        letters, upper = len(re.findall("[A-Za-z]", text)), len(re.findall("[A-Z]", text))
        lines = len([x for x in text.split("\n") if x.strip(" \t\n\r\x0b\x0c")])
        digits, marks = len(re.findall("[0-9]", text)), len(re.findall("[!?]", text))
        return not (n < 50 or 100 * rep > 50 * n or 10 * symbols > n or (lines >= 6 and 10 * dup > 5 * lines) or (letters >= 40 and 10 * upper > 6 * letters) or (n and (chars < 2 * n or chars > 20 * n)) or (n and 10 * digits > 3 * chars) or 10 * marks > 3 * n)

    kept = [(i, t) for i, t in rows if passes(t or "")]
    ids = {r[0] for r in brute_exact(kept) if r[3]}
    kept = [(i, t) for i, t in kept if i in ids]
    ids = {r[0] for r in brute_near(kept, 5, 80) if r[3]}
    kept = [(i, t) for i, t in kept if i in ids]
    out = {}
    for i, data, spans in brute_spans(kept, 50):
        gone = bytearray(len(data))
        for a, z in spans:
            while a < len(data) and data[a] & 0xC0 == 0x80:
                a += 1
            while z < len(data) and data[z] & 0xC0 == 0x80:
                z -= 1
            gone[a:z] = b"\1" * max(0, z - a)
        text = bytes(c for c, g in zip(data, gone) if not g).decode()
        if re.search(r"[^\x20\x09-\x0D]", text):
            out[i] = text
    return out


def test_pipeline_against_plain_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = plain_stages([(r.doc_id, r.text) for r in docs.collect()])
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf_dir)
        assert now.columns == docs.columns and now.schema == docs.schema, name
    rows = now.collect()
    assert {r.doc_id: r.text for r in rows} == want
    assert all(r.n_chars == len(r.text) for r in rows)
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in want.items()}
    found: dict = {}
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        found[r.doc_id] = found.get(r.doc_id, 0) + r.n_words
    assert found == words


def test_pipeline_leaves_only_what_its_result_reads(spark, sf_dir):
    top = common.shared_dir(spark).removeprefix("file:")
    there = set(os.listdir(top))
    rows = corpus_pipeline.run(spark, sf_dir)
    left = sorted(name.rsplit("-", 1)[0] for name in set(os.listdir(top)) - there)
    assert left == ["lengths", "suffix_dedup"] and rows.count() > 0


def test_pipeline_on_odd_documents(spark):
    rows = [(1, None, "en", "s", None), (None, "word " * 60, None, None, 5), (2, "", "en", "s", 0), (3, " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80)), "en", "s", 9), (3, " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80)), "en", "s", 9)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, id string")
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "")
        assert now.columns == docs.columns
    assert {r.doc_id for r in now.collect()} == {3}
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, "")
    assert none.count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(sf_dir, t)}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    columns, rows = list(want.columns), want.fetchall()
    got = queries.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(repr, rows))
