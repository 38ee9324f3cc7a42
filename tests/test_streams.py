"""Requests gathered from a stream of their pairs, over restarts; requests as a data source."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from duolex.operators.vectors import HashEmbedder
from duolex.sources.pairs import read_requests
from duolex.sources.request_format import RequestFormat, lines_between
from duolex.streaming.requests import ARRIVAL_SCHEMA, gather_requests, serve_stream

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
START = datetime(2024, 5, 1, tzinfo=timezone.utc)


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield spark
    spark.conf.set(key, before)


def arrival(request, idx, n, at, text="one two", **more):
    return {"request_id": request, "idx": idx, "n_pairs": n, "id": f"{request}{idx}", "source": text, "target": "un deux", "source_language": "en", "target_language": "fr", "sent_at": (START + timedelta(seconds=at)).isoformat(), **more}


def drop(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(map(json.dumps, rows)))


#: Pairs out of order and again; a request that stays incomplete until its time is over; pairs that come after that; one beside its range; a second request that is whole over a restart.
FIRST = [arrival("a", 2, 3, 0), arrival("b", 0, 2, 1), arrival("a", 0, 3, 2), arrival("a", 0, 3, 3, text="other"), arrival("c", 1, 2, 4), arrival("c", 7, 2, 4), arrival(None, 0, 1, 4), arrival("z", 0, 0, 4)]
SECOND = [arrival("a", 1, 3, 20), arrival("a", 1, 3, 21), arrival("b", 1, 2, 25)]
THIRD = [arrival("a", 2, 3, 30), arrival("tick", 0, 1, 200)]
FOURTH = [arrival("c", 0, 2, 195), arrival("tock", 0, 1, 201)]


def test_requests_are_gathered_once_over_restarts(rocks, tmp_path):
    spark = rocks
    for number, rows in enumerate((FIRST, SECOND, THIRD, FOURTH)):
        drop(tmp_path / "in", f"{number}.json", rows)
        # Each turn is a start of its own from the same checkpoint.
        arrivals = spark.readStream.schema(ARRIVAL_SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        query = gather_requests(arrivals, "60 seconds", "10 seconds").writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        query.awaitTermination(180)
    got = sorted(spark.read.json(str(tmp_path / "out")).collect(), key=lambda r: r.request_id)
    assert [(r.request_id, r.complete, [p.idx for p in r.sentence_pairs], r.missing) for r in got] == [("a", True, [0, 1, 2], []), ("b", True, [0, 1], []), ("c", False, [1], [0]), ("tick", True, [0], []), ("tock", True, [0], [])]
    assert got[0].sentence_pairs[0].source == "one two" and got[0].source_language == "en"


def test_gathered_requests_are_served(rocks, tmp_path):
    spark = rocks
    vectors = HashEmbedder(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<float>"))
    rows = [arrival("a", 1, 2, 0, method="inter"), arrival("a", 0, 2, 1), arrival("bad", 0, 1, 2, text=" "), arrival("worse", 0, 1, 2, repair='{"min_similarity": 7}'), arrival("half", 0, 2, 3)]
    drop(tmp_path / "in", "0.json", rows)
    drop(tmp_path / "in", "1.json", [arrival("late", 0, 1, 300)])
    arrivals = spark.readStream.schema(ARRIVAL_SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    serve_stream(arrivals, vectors, str(tmp_path / "out"), str(tmp_path / "bad"), str(tmp_path / "check"), trigger={"availableNow": True}).awaitTermination(300)
    out = {r.request_id: r for r in spark.read.json(str(tmp_path / "out")).where(F.col("request_id").isNotNull()).collect()}
    assert set(out) == {"a", "late"} and out["a"].method == "inter" and [p.id for p in out["a"].sentence_alignments] == ["a0", "a1"]
    bad = {r.request_id: r.errors for r in spark.read.json(str(tmp_path / "bad")).where(F.col("request_id").isNotNull()).collect()}
    assert bad == {"bad": ["source"], "worse": ["repair"], "half": ["missing: 1"]}


# ---------------------------------------------------------------- the same as a data source
def requests():
    whole = {"source_language": "en", "target_language": "fr"}
    pairs = [{"id": f"p{i}", "source": f"one é😀 {i}", "target": f"un {i}"} for i in range(4)]
    return [
        whole | {"sentence_pairs": pairs}, whole | {"sentence_pairs": pairs[:1], "method": "inter", "repair": {"min_similarity": 0.9, "max_source_span": 4}}, whole | {"sentence_pairs": []},
        whole | {"sentence_pairs": pairs[:2], "more": 1}, whole | {"sentence_pairs": [{"source": "a", "target": "b", "x": 1}]}, whole | {"sentence_pairs": pairs[:1], "repair": {"min_similarity": 7.0}},
        {"sentence_pairs": [{"source": None, "target": "b"}]},
    ]


def test_requests_by_byte_ranges(spark, tmp_path):
    (tmp_path / "in").mkdir()
    text = "\n".join(json.dumps(r, ensure_ascii=False) for r in requests() * 3)
    (tmp_path / "in/a.json").write_text(text + "\n\nnot json\n[1]")
    (tmp_path / "in/b.json").write_text(text)
    spark.dataSource.register(RequestFormat)
    columns = ["idx", "source_language", "target_language", "source", "target", "method", "id", "repair", "request_errors"]
    told = lambda df: sorted(str(r) for r in df.select(*columns).collect())
    read = lambda n: spark.read.format("alignment_requests").option("splitBytes", n).load(str(tmp_path / "in"))
    want = told(read_requests(spark, str(tmp_path / "in")))
    for n in (7, 100, 1 << 20):
        got = read(n)
        assert told(got.where("not array_contains(request_errors, 'json')")) == [x for x in want if "'json'" not in x]
        assert got.where("array_contains(request_errors, 'json')").count() == 2 and got.select("pair_id").distinct().count() == got.count()
    assert read(7).rdd.getNumPartitions() > 100


def test_lines_belong_to_the_range_they_begin_in():
    data = b"ab\n\ncdef\ng\n" + b"x" * 50 + b"\nlast"
    whole = list(lines_between(lambda at, n: data[at : at + 5], 0, len(data)))
    assert [x for _, x in whole] == data.split(b"\n")
    for n in range(1, 30):
        parts = [x for a in range(0, len(data), n) for x in lines_between(lambda at, k: data[at : at + 5], a, min(len(data), a + n))]
        assert parts == whole


def test_only_a_commit_shows_results(spark, tmp_path):
    spark.dataSource.register(RequestFormat)
    out = str(tmp_path / "out")
    df = spark.range(20).repartition(3).selectExpr("cast(id as string) as request_id", "array(id, id + 1) as x", "named_struct('é', id) as y")
    df.write.format("alignment_requests").mode("append").save(out)
    back = spark.read.json(out)
    assert sorted(r.request_id for r in back.collect()) == sorted(map(str, range(20)))
    fails = df.withColumn("z", F.when(F.col("request_id") == "7", F.raise_error(F.lit("no"))).otherwise("fine"))
    with pytest.raises(Exception, match="no"):
        fails.write.format("alignment_requests").mode("append").save(out)
    assert spark.read.json(out).count() == 20 and not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_writing")]
    df.limit(5).write.format("alignment_requests").mode("overwrite").save(out)
    assert spark.read.json(out).count() == 5
