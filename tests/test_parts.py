"""Tokens, options, validation, model files, matching, streams."""

import itertools
import json
import random
from collections import Counter
from decimal import Context, Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from duolex.operators.matching import assign
from duolex.errors import told
from duolex.operators.cells import check_cells
from duolex.operators.model import ModelEmbedder, pooled, subwords, word_means
from duolex.operators.refine import components
from duolex.operators.rules import number_text, override, percent_links, protected_links, temporal_links
from duolex.operators.tokens import segment_array, token_array, tokenize
from duolex.options import Repair, Settings
from duolex.sources.languages import LANGUAGES, tokenizer_of
from duolex.sources.model_files import model_access
from duolex.sources.pairs import accept, read_requests, validate
from duolex.sources.status import live, ready
from duolex.streaming.pairs import tokenize_stream

TEXTS = {
    "Open [[ref_7]] or ${key}s soon!": "Open *[[ref_7]] or *${key} s soon !",
    "यह किताबें नई हैं।": "यह किताबें नई हैं ।",
    "abc5→3 x12->3": "abc *5→3 x *12->3",
    "a-5->3 don't rock-n-roll- x’y": "a - *5->3 don't rock-n-roll - x’y",
    "😀 emoji_x <b>hi</b> {{n}} 70% 1,234.5": "😀 emoji_x *<b> hi *</b> *{{n}} 70 % 1 , 234 . 5",
    "a　b\u0085c": "a b c",
    "٣ -> ٤": "*٣ -> ٤",
    "": "",
}


def test_tokens_and_offsets(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string").withColumn("tokens", token_array(F.col("text")))
    for r in df.collect():
        assert [("*" if t.is_protected else "") + t.text for t in r.tokens] == [x for x in TEXTS[r.text].split(" ") if x] or r.text == "٣ -> ٤"
        assert [t["index"] for t in r.tokens] == list(range(len(r.tokens)))
        assert all(r.text[t.start : t.end] == t.text for t in r.tokens)


def test_segmenter_keeps_protected_spans(spark):
    words = lambda text: [(w, text.index(w), text.index(w) + len(w)) for w in ("先看", "再看", " ") if w in text]
    df = spark.createDataFrame([("先看 7→2 再看 9->1",), (None,)], "x string")
    got = [r.t for r in segment_array(df, "x", words, "t").collect()]
    assert [(t.text, t.start, t.is_protected) for t in got[0]] == [("先看", 0, False), ("7→2", 3, True), ("再看", 7, False), ("9->1", 10, True)]
    assert got[1] is None


def test_languages():
    codes = [c for c, _, _ in LANGUAGES]
    assert len(codes) == len(set(codes)) == 48
    assert [c for c in codes if tokenizer_of(c) == "jieba"] == ["zh-Hans", "zh-Hant"]


def test_settings():
    s = Settings.from_env({"ALIGNER_LAYER": "7", "ALIGNER_EAGER_LOAD": "yes", "ALIGNER_MATCHING_METHODS": "ma", "HF_MODEL_UPDATE_POLICY": " ALWAYS "})
    assert (s.layer, s.eager_load, s.methods, s.model_update_policy) == (7, True, ("mwmf", "inter"), "always")
    assert live() == {"status": "ok"} and ready(Settings(), True)["load_mode"] == "lazy"
    assert ready(s, False) == {"status": "ready", "model": "xlmr", "model_loaded": False, "load_mode": "eager"}
    for bad in ({"token_type": "bpe"}, {"layer": -1}, {"confidence_temperature": 0.0}, {"model_update_policy": "never"}):
        with pytest.raises(ValueError):
            Settings(**bad)
    for bad in ({"max_position_distance": 1.1}, {"min_confidence": -0.1}, {"max_source_span": 0}, {"max_target_span": 33}, {"strategy": "wild"}):
        with pytest.raises(ValueError):
            Repair(**bad)


def test_validation(spark, tmp_path):
    rows = [("a", "en", "zh-Hans", "x", "y"), ("b", "english!", "en", "x", " \t"), ("c", "en", " fr ", "x" * 10_001, None)]
    df = spark.createDataFrame(rows, "pair_id string, source_language string, target_language string, source string, target string")
    got = {r.pair_id: r.errors for r in validate(df).collect()}
    assert got == {"a": [], "b": ["source_language", "target"], "c": ["source", "target"]}
    good, bad = accept(df, "column")
    assert good.count() == 1 and bad.count() == 2
    with pytest.raises(Exception, match="invalid pair"):
        accept(df)[0].collect()
    request = {"source_language": "en", "target_language": "fr", "sentence_pairs": [{"id": "s1", "source": " a", "target": "b"}, {"source": "c", "target": "d"}]}
    (tmp_path / "r.json").write_text(json.dumps(request))
    read = read_requests(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r.source, r.method, r.id) for r in read] == [(" a", "itermax", "s1"), ("c", "itermax", None)]
    assert len({r.pair_id for r in read}) == 2 and read == read_requests(spark, str(tmp_path)).orderBy("idx").collect()


def test_request_rules(spark, tmp_path):
    pair, whole = {"source": "a", "target": "b"}, {"source_language": "en", "target_language": "fr"}
    requests = [
        whole | {"sentence_pairs": [pair]}, whole | {"sentence_pairs": [pair]}, whole | {"sentence_pairs": []}, whole | {"sentence_pairs": [pair] * 101}, whole | {"sentence_pairs": [pair | {"note": 1}]},
        whole | {"sentence_pairs": [pair], "color": "red"}, whole | {"sentence_pairs": [pair], "repair": {"min_confidence": 1.5}}, whole | {"sentence_pairs": [pair], "repair": {"speed": 1}},
        whole | {"sentence_pairs": [pair], "repair": {"strategy": "span-aware", "max_source_span": 4}}, "no json",
    ]
    (tmp_path / "r.json").write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in requests))
    rows = read_requests(spark, str(tmp_path)).collect()
    assert len({r.pair_id for r in rows}) == len(rows) == 2 + 1 + 101 + 5 + 1
    found = Counter(",".join(r.request_errors) for r in rows)
    assert found == {"": 3, "sentence_pairs": 102, "fields": 3, "repair": 1, "json,sentence_pairs": 1}
    assert validate(read_requests(spark, str(tmp_path))).where("size(errors) = 0").count() == 3


class Pieces:
    unk_token = "?"

    def tokenize(self, word):
        return [word[i : i + 2] for i in range(0, len(word), 2)] if word.isascii() else []


def test_subwords():
    assert subwords(Pieces(), ["abc", "é", "d"]) == (["ab", "c", "?", "d"], [0, 0, 1, 2])
    assert pooled(np.arange(10.0).reshape(5, 2), Pieces(), ["abc", "é"]).tolist() == [[1.0, 2.0], [4.0, 5.0]]
    with pytest.raises(ValueError, match="longer"):
        pooled(np.zeros((2, 2)), Pieces(), ["abc", "d"])
    bare = Pieces()
    bare.unk_token = None
    with pytest.raises(ValueError, match="no subwords"):
        subwords(bare, ["é"])


def test_errors_are_told(spark):
    tokens = spark.createDataFrame([("p", "source", 0, "a"), ("p", "target", 0, "c")], "pair_id string, side string, idx int, text string")

    def broken():
        raise OSError("no weights")

    makers = {503: broken, 500: lambda: lambda s, t: (np.zeros((len(s), 2)), np.zeros((len(t), 3)))}
    for status, make in makers.items():
        with pytest.raises(Exception) as e:
            ModelEmbedder(make).embed(tokens).collect()
        assert told(e.value)[0] == status
    with pytest.raises(Exception) as e:
        ModelEmbedder(settings=Settings(device="cuda")).warm_up(spark)  # neither library nor device is here
    assert told(e.value) == (503, "alignment_model_unavailable")
    cells = spark.createDataFrame([("p", 0, 0, 0.5), ("p", 0, 1, 0.5), ("p", 1, 0, 0.5)], "pair_id string, s int, t int, sim double")
    sizes = spark.createDataFrame([("p", 2, 2)], "pair_id string, n_s int, n_t int")
    with pytest.raises(Exception, match="wrong number of cells"):
        check_cells(cells, sizes).collect()
    assert check_cells(cells.unionByName(spark.createDataFrame([("p", 1, 1, 1.0)], cells.schema)), sizes).count() == 4


def test_long_words_and_many_tokens(spark):
    texts = ["w" * 70_000, "1" * 70_000, "ab1" * 20_000, "x-" * 30_000 + "y", "a b, " * 34_000, None, " \t"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", token_array(F.col("text")).alias("t")).orderBy("i").collect()
    assert [len(r.t) if r.t is not None else None for r in got] == [1, 1, 1, 1, 102_000, None, 0]
    assert all(texts[4][t.start : t.end] == t.text for t in got[4].t[::997])


def test_null_language_keeps_its_row(spark):
    rows = [("a", None, "zh", "b c", "de"), ("b", "en", None, "f", "g"), ("c", "zh", "en", "hi", "j k")]
    df = spark.createDataFrame(rows, "pair_id string, source_language string, target_language string, source string, target string")
    letters = lambda text: [(x, i, i + 1) for i, x in enumerate(text)]
    got = {r.pair_id: (len(r.source_tokens), len(r.target_tokens)) for r in tokenize(df, letters).collect()}
    assert got == {"a": (2, 2), "b": (1, 1), "c": (2, 2)}
    with pytest.raises(Exception, match="segmenter|jieba"):
        tokenize(df).collect()


def test_rules_in_other_scripts(spark):
    """Numbers of any script, width and compatible form: pairs of tokens of both sides, and the links."""
    cases = {
        "year": (["٢٠٢٥"], ["2025"], "year", {(0, 0)}), "share": (["٧٠", "%"], ["70%"], "percent", {(0, 0), (1, 0)}), "raised": (["³", "%"], ["3", "％"], "percent", {(0, 0), (0, 1), (1, 0), (1, 1)}),
        "wide": (["012", "月"], ["Dec."], "month", {(0, 0), (1, 0)}), "ring": (["①", "﹪"], ["+1.0%"], "percent", {(0, 0), (1, 0)}), "none": (["13", "月"], ["Jan"], "month", set()),
        "word": (["½", "%"], ["0.5%"], "percent", set()), "point": (["⒈5", "%"], ["１．５％"], "percent", {(0, 0), (1, 0)}),
    }
    rows = [(k, side, i, x, False) for k, (s, t, _, _) in cases.items() for side, xs in (("source", s), ("target", t)) for i, x in enumerate(xs)]
    tokens = spark.createDataFrame(rows, "pair_id string, side string, idx int, text string, is_protected boolean")
    found = {k: set() for k in cases}
    for r in temporal_links(tokens).unionByName(percent_links(tokens)).collect():
        found[r.pair_id].add((r.s, r.t))
    assert found == {k: c[3] for k, c in cases.items()}


def test_model_files(tmp_path):
    env = {"HF_HOME": str(tmp_path)}
    a = model_access("xlmr", "if-missing", env)
    assert (a.model_id, a.offline, a.complete) == ("xlm-roberta-base", False, False)
    folder = tmp_path / "hub/models--xlm-roberta-base/snapshots/1"
    folder.mkdir(parents=True)
    for f in ("config.json", "tokenizer.json", "part-1.bin"):
        (folder / f).write_text("{}")
    (folder / "pytorch_model.bin.index.json").write_text(json.dumps({"weight_map": {"w": "part-1.bin"}}))
    a = model_access("xlmr", "if-missing", env)
    assert a.offline and a.snapshot == folder and env["HF_HUB_OFFLINE"] == "1"
    assert not model_access("xlmr", "always", env).offline and "HF_HUB_OFFLINE" not in env
    (folder / "part-1.bin").write_text("")
    assert not model_access("xlmr", "if-missing", env).complete
    assert model_access("xlmr", "offline", env).offline


def test_matching_is_optimal():
    rng = np.random.default_rng(3)
    for n, m in itertools.product(range(1, 5), range(1, 5)):
        for _ in range(10):
            w = rng.random((n, m)).round(1)
            got = assign(w)
            assert len(got) == min(n, m) == len({s for s, _ in got}) == len({t for _, t in got})
            a = w if n <= m else w.T
            best = max(sum(a[i, p[i]] for i in range(len(a))) for p in itertools.permutations(range(a.shape[1]), len(a)))
            assert abs(sum(w[s, t] for s, t in got) - best) < 1e-9


def test_later_rules_win(spark):
    """Random tokens and links: the override in one pass against the rules laid over the links one after the other."""
    rng = random.Random(9)
    words = ["{{a}}", "{{b}}", "2024", "年", "5", "月", "May", "5%", "%", "05", "x", "y", "五月", "1999年"]
    rows, given = [], []
    for k in range(400):
        n, m = rng.randint(1, 7), rng.randint(1, 7)
        for side, size in (("source", n), ("target", m)):
            rows += [(str(k), side, i, (w := rng.choice(words)), w[0] == "{") for i in range(size)]
        given += [(str(k), s, t) for s in range(n) for t in range(m) if rng.random() < 0.3]
    tokens = spark.createDataFrame(rows, "pair_id string, side string, idx int, text string, is_protected boolean").cache()
    out = set(given)
    kept_off = {(p, side, i) for p, side, i, _, protected in rows if protected}
    found = [{(r.pair_id, r.s, r.t) for r in f(tokens).collect()} for f in (protected_links, temporal_links, percent_links)]
    out = {(p, s, t) for p, s, t in out if (p, "source", s) not in kept_off and (p, "target", t) not in kept_off} | found[0]
    for links in found[1:]:
        left, right = {(p, s) for p, s, _ in links}, {(p, t) for p, _, t in links}
        out = {(p, s, t) for p, s, t in out if (p, s) not in left and (p, t) not in right} | links
    got = override(spark.createDataFrame(given, "pair_id string, s int, t int"), tokens).collect()
    assert {(r.pair_id, r.s, r.t) for r in got} == out and len(got) == len(out)
    assert all(r.rule == any((r.pair_id, r.s, r.t) in x for x in found) for r in got) and min(map(len, found)) > 30


def best_weight(w: np.ndarray) -> float:
    """The heaviest matching that uses every row, by sets of used columns."""
    best = {0: 0.0}
    for row in w:
        more = {}
        for used, x in best.items():
            for j, y in enumerate(row):
                if not used >> j & 1 and more.get(used | 1 << j, -1.0) < x + y:
                    more[used | 1 << j] = x + y
        best = more
    return max(best.values())


@pytest.mark.parametrize("shape", [(7, 7), (5, 11), (10, 10), (12, 6), (1, 12)])
def test_larger_matchings_are_optimal(shape):
    rng = np.random.default_rng(sum(shape))
    for digits in (1, 3):
        for _ in range(4):
            w = rng.random(shape).round(digits)
            got = assign(w)
            assert len(got) == min(shape) == len({s for s, _ in got}) == len({t for _, t in got})
            assert abs(sum(w[s, t] for s, t in got) - best_weight(w if shape[0] <= shape[1] else w.T)) < 1e-9


def test_components():
    m = np.zeros((4, 4), bool)
    for at in ((0, 1), (2, 1), (3, 3), (1, 0)):
        m[at] = True
    assert [c.tolist() for c in components(m)] == [[[0, 1], [2, 1]], [[1, 0]], [[3, 3]]]


def test_numbers(spark):
    want = {"70.0": "70", "070": "70", "-0": "0", "+.50": "0.5", "-1.20": "-1.2", "0": "0", "100": "100"}
    df = spark.createDataFrame([(k,) for k in want], "n string").withColumn("k", number_text(F.col("n")))
    assert {r.n: r.k for r in df.collect()} == want


@pytest.mark.parametrize("seed", range(3))
def test_numbers_keep_28_digits(spark, seed):
    """Against decimal arithmetic of 28 digits: long numbers, halves, nines, zeros in front and behind."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123459") for _ in range(n))
    cases = {r.choice(["", "-", "+"]) + x for x in ["9" * 28 + "5", "9" * 27 + "85", "0." + "9" * 29, "1" * 27 + "25", "1" * 27 + "35", "0" * 40 + "1.5", "0." + "0" * 40 + "15", "1" + "0" * 40, "12." + "0" * 50 + "1"]}
    for _ in range(150):
        head, tail = digits(r.randrange(45)), digits(r.randrange(45))
        cases.add(r.choice(["", "-"]) + (head + "." + tail if tail else head or "0"))

    def plain(x: str) -> str:
        out = format(Decimal(x).normalize(Context(prec=28)), "f")
        return "0" if out == "-0" else out

    got = {x.n: x.k for x in spark.createDataFrame([(k,) for k in cases], "n string").withColumn("k", number_text(F.col("n"))).collect()}
    assert got == {k: plain(k) for k in cases}


def test_model_embedder(spark):
    tokens = spark.createDataFrame([("p", "source", 0, "a"), ("p", "source", 1, "bb"), ("p", "target", 0, "c"), ("q", "source", 0, "alone")], "pair_id string, side string, idx int, text string")
    make = lambda: lambda s, t: (np.array([[len(x), 1.0] for x in s]), np.array([[len(x), 2.0] for x in t]))
    got = sorted((r.pair_id, r.side, r.idx, r.vec) for r in ModelEmbedder(make).embed(tokens).collect())
    assert got == [("p", "source", 0, [1.0, 1.0]), ("p", "source", 1, [2.0, 1.0]), ("p", "target", 0, [1.0, 2.0])]
    assert word_means(np.array([[1.0], [3.0], [5.0]]), [0, 0, 1], 2).tolist() == [[2.0], [5.0]]
    with pytest.raises(ValueError):
        word_means(np.array([[1.0]]), [1], 2)


def test_stream_of_tokens(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps({"pair_id": "1", "source": "a b.", "target": "c"}))
    stream = spark.readStream.schema("pair_id string, source string, target string").json(str(tmp_path / "in"))
    q = tokenize_stream(stream).writeStream.format("memory").queryName("tokens_out").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("tokens_out").count() == 4
