"""The pipeline on the smallest tables: each stage on its own input."""

import zlib
from collections import Counter

import corpus_pipeline
import regex
from duolex.llm.shared import Tables, load
from tests.llm.test_operators import plain_components, plain_contaminated, plain_scorer, plain_windows

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    tables = Tables(spark)
    docs = load(spark, SF, "documents")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(tables.put(stage(spark, kept[-1], SF), name))
    raw, told, single, clean, mixed, sharded = kept
    assert all(x.columns == raw.columns for x in kept[:-1])
    ids = [[r.doc_id for r in x.select("doc_id").collect()] for x in kept]
    # Language: what is told with a fair score stays, everything else goes.
    rows = raw.select("doc_id", "text", "lang").collect()
    learned = [r for r in rows if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    words = Counter((r.lang, w) for r in learned for w in regex.findall(r"\p{L}[\p{L}\p{M}]*", r.text.lower()))
    score = plain_scorer([(x, w, n) for (x, w), n in words.items()], sorted({r.lang for r in learned}))
    sure = {r.doc_id: score(r.text)[1] for r in rows if r.text and regex.search(r"\p{L}", r.text)}
    assert not any(abs(x - 0.5) < 1e-4 for x in sure.values())
    assert sorted(ids[1]) == sorted(i for i, x in sure.items() if x >= 0.5) and len(ids[1]) > 0.95 * len(ids[0])
    # One document of each group: none is lost that has no partner, all that stay are the least of theirs.
    comps, n = plain_components([(r.doc_id, r.text) for r in told.select("doc_id", "text").collect()])
    assert sorted(ids[2]) == sorted(i for i, _, c in comps if i == c) and len(ids[2]) == n
    windows = plain_windows([r.text for r in load(spark, SF, "benchmark").select("text").collect()])
    assert sorted(ids[3]) == sorted(r.doc_id for r in single.select("doc_id", "text").collect() if not plain_contaminated(r.text, windows)) and len(ids[3]) < len(ids[2])
    assert set(ids[4]) <= set(ids[3]) and max(ids[4].count(i) for i in set(ids[4])) <= 3
    assert sorted(ids[5]) == sorted(ids[4])
    slots = sharded.groupBy("shard").agg({"slot": "max", "*": "count"}).collect()
    assert all(r["max(slot)"] + 1 == r["count(1)"] for r in slots)


def test_odd_rows_and_none(spark, tmp_path):
    """Null ids and texts, rows that repeat, columns of clashing names, and no rows at all, through every stage."""
    from tests.llm.test_operators import SCHEMA, make_rows

    rows = make_rows()
    for name, some in (("odd", rows), ("none", [])):
        path = str(tmp_path / name)
        spark.createDataFrame(some, SCHEMA).write.parquet(path)
        docs, tables = spark.read.parquet(path), Tables(spark)
        columns = docs.columns
        for stage, run in corpus_pipeline.STAGES:
            before = docs
            docs = tables.put(run(spark, before, SF), stage)
            if stage != "sharding":
                assert docs.columns == columns, stage
            kept = {str(r) for r in docs.select("doc_id", "text").collect()}
            assert kept <= {str(r) for r in before.select("doc_id", "text").collect()}
            assert bool(kept) == bool(some), stage
