"""Every operator against a plain version, over a table with nulls, empty and long texts, repeated rows and clashing columns, and
over an empty table."""

import functools
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from duolex.llm import jaccard_join, mixing, substring_dedup
from duolex.llm.chat import FEATURES, ROLES, STATES, Chances, across, page_text, solid, telling_words, format_chats, format_conversations, joined, learn_chances, pages, parse, read_back, render, viterbi
from duolex.llm.decontamination import decontaminate, keep_clean
from duolex.llm.exact_dedup import exact_dedup
from duolex.llm.jaccard_join import keep_one, near_duplicates
from duolex.llm.language_id import Model, identify, keep_identified, learn
from duolex.llm.mixing import _split, deal, mix_sources, mixed_documents
from duolex.llm.pii import SHAPES, base_spans, candidates, find_personal_data, luhn, patterns
from duolex.llm.shared import Tables
from duolex.llm.sharding import permute, shard_documents, shard_rows
from duolex.llm.substring_dedup import remove_repeats
from duolex.llm.token_counts import Units, count_by_chunks, count_tokens, processor

SPACES = r"[^\x20\x09-\x0D]+"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, shard string, size string, h string, key string, id string, grp string"


def make_rows():
    rng = random.Random(11)
    vocab = {"en": [f"{a}{b}" for a in ("the", "sh", "wor", "thin") for b in ("ing", "ed", "ly", "ness", "th")], "fr": [f"{a}{b}" for a in ("é", "qu", "eau", "le") for b in ("ment", "eux", "ique", "ée", "oi")]}
    words = lambda lang, n: " ".join(rng.choice(vocab[lang]) + (str(rng.randint(0, 99)) if rng.random() < 0.3 else "") for _ in range(n))
    out = []
    for i in range(60):
        lang = "en" if i % 2 else "fr"
        out.append((i, words(lang, rng.randint(3, 90)), lang if i % 5 else None, f"s{i % 4}" if i % 9 else None))
    base = words("en", 120)
    near = base.split()
    for i in range(60, 75):
        w = list(near)
        for _ in range(i % 4):
            w[rng.randrange(120)] = f"edit{i}"
        out.append((i, " ".join(w), "en", "s0"))
    passage = words("en", 55)
    for i in range(75, 82):
        out.append((i, f"{words('fr', 12)} {passage}\n{words('fr', 9)}", "fr", "s1"))
    tail = [
        None, "", "  \t\n", "one", "one", "!!! 123 ???", "a " * 400, "x" * 70_000, "é😀中 " * 30, words("en", 9_000), base, base.upper(), "two words",
        "mail bob.smith@mail.example.com, or +1 (415) 555-0199; card 4539578763621486 at 10.0.0.255 or 10.0.0.256",
    ]
    out += [(100 + i, t, "en", "s2") for i, t in enumerate(tail)]
    out += [(110, base, "en", "s2"), (110, base, "en", "s2"), (None, "null id here", "en", "s3"), (None, None, None, None)]
    return [(d, t, lg, s, len(t or ""), "r", "sh", "sz", "h", "k", "i", "g") for d, t, lg, s in out]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "d")
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return spark.read.parquet(path)


def same(got, want):
    assert Counter(map(tuple, got)) == Counter(want)


def test_exact_dedup(docs, none, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    want = []
    for t, ids in groups.items():
        top = max(ids, key=lambda x: -1 if x is None else x)
        kept = False
        for i in ids:
            stays = i == top and not kept
            kept |= stays
            want.append((i, top, len(ids), stays, hashlib.sha256(t.encode()).hexdigest()))
    same(exact_dedup(docs).collect(), want)
    assert exact_dedup(none).count() == 0


def test_sharding(docs, none, rows):
    got = shard_rows(docs).collect()
    assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t := (x[1] or "").encode())) + 1, zlib.crc32(t)) for x in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    place = permute(np.arange(len(rows)), len(rows), 20240229)
    assert all((r.shard, r.slot) == (place[r.row_number] % 8, place[r.row_number] // 8) for r in got)
    whole = shard_documents(docs).collect()
    assert len(whole) == len(rows) and {type(r.shard) for r in whole} == {int}
    assert shard_rows(none).count() == shard_documents(none).count() == 0
    for n in (1, 2, 3, 100, 1000):
        assert sorted(permute(np.arange(n), n, 5)) == list(range(n))


def plain_place(x, n, seed):
    """One row number through the network, in whole numbers: rounds of left, right -> right, left xor f(right), again until it is below n."""
    prime, keys, k = 2**31 - 1, [], seed % (2**31 - 1)
    for _ in range(18):
        k = (k * 48271 + 11) % prime
        keys.append(k or 1)
    bits = max(1, math.ceil(math.log2(max(n, 2)) / 2))
    while True:
        left, right = divmod(x, 2**bits)
        for r in range(6):
            a, b, c = keys[3 * r : 3 * r + 3]
            t = (right * a + b) % prime
            left, right = right, left ^ (t * t + c) % prime % 2**bits
        x = left * 2**bits + right
        if x < n:
            return x


def test_shards_follow_the_plain_walk(docs, rows):
    order = lambda r: tuple((v is None, 0 if v is None else v) for v in (r[0], zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 1))
    want = Counter()
    for k, r in enumerate(sorted(rows, key=order)):
        p = plain_place(k, len(rows), 7)
        want[r[0], len((r[1] or "").encode()) + 1, p % 5, p // 5] += 1
    got = Counter((r.doc_id, r.size, r.shard, r.slot) for r in shard_rows(docs, 5, 7).collect())
    # Rows equal in id, checksum and size may change places with each other.
    twins = {k for k, n in Counter(map(order, rows)).items() if n > 1}
    loose = {r[0] for r in rows if order(r) in twins}
    assert {k: n for k, n in got.items() if k[0] not in loose} == {k: n for k, n in want.items() if k[0] not in loose}
    for n in (1, 2, 5, 17, 300):
        assert permute(np.arange(n), n, 3).tolist() == [plain_place(i, n, 3) for i in range(n)]


def test_mixing(docs, none, rows):
    size = defaultdict(int)
    for r in rows:
        size[r[3]] += len(re.findall(SPACES, r[1] or ""))
    names = sorted(size, key=lambda x: (x is None, x or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(size.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > 3 * size[s]]
        if not over:
            break
        fixed |= {s: 3.0 * size[s] for s in over}
    target = {s: fixed.get(s, level * weight[s]) for s in names}
    got = mix_sources(docs).collect()
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 and len(r.draws) <= 3
        assert [d.epoch for d in r.draws] == list(range(len(r.draws))) and all(0 <= d.shard < 8 for d in r.draws)
        taken[r.source] += r.size * len(r.draws)
    assert not nearer(got, taken, target)
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(docs).collect()))
    assert mixed_documents(docs).count() == sum(len(r.draws) for r in got)
    assert mix_sources(none).count() == mixed_documents(none).count() == 0


def nearer(got, taken, target):
    """Documents (rows of one id are taken together) that a source takes less often than others of it, and that would bring it nearer to its target."""
    least, size, draws = {}, Counter(), {}
    for r in got:
        size[r.source, r.doc_id] += r.size
        draws[r.source, r.doc_id] = len(r.draws)
    for (s, _), n in draws.items():
        least[s] = min(n, least.get(s, 9))
    lacks = {s: t - taken[s] for s, t in target.items()}
    return [k for k, n in size.items() if n and draws[k] == least[k[0]] and draws[k] < 3 and abs(lacks[k[0]] - n) < abs(lacks[k[0]]) - 1e-6]


@pytest.mark.parametrize("sf,far", [("sf0.001", 0.35), ("sf0.01", 0.01)])
def test_sources_of_the_tables_reach_their_targets(spark, sf, far):
    got = mix_sources(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source] += r.size * len(r.draws)
        target[r.source] = r.target
    assert not nearer(got, taken, target)
    assert all(abs(taken[s] - t) <= far * t for s, t in target.items())


def test_splits_are_hypergeometric(spark):
    """A node of 3, 2 and 4 entries sends 4 left: each outcome as often as all draws of 4 of the 9 say."""
    quotas = (3, 2, 4)
    nodes = spark.range(6000).select(F.col("id").alias("node"), F.array(*[F.lit(q).cast("long") for q in quotas]).alias("quotas"))
    out = defaultdict(dict)
    for r in _split(nodes, 5, Tables(spark)).collect():
        out[r.node // 2][r.node % 2] = tuple(r.quotas)
    assert len(out) == 6000 and all(tuple(map(sum, zip(x[0], x[1], strict=True))) == quotas and sum(x[0]) == 4 for x in out.values())
    got = Counter(x[0] for x in out.values())
    chance = {k: math.prod(math.comb(q, i) for q, i in zip(quotas, k, strict=True)) / math.comb(9, 4) for k in itertools.product(*(range(q + 1) for q in quotas)) if sum(k) == 4}
    assert sum((got[k] - 6000 * p) ** 2 / (6000 * p) for k, p in chance.items()) < 40  # 11 degrees of freedom


def test_the_tree_decides_what_is_taken(spark, docs, monkeypatch):
    tables = Tables(spark)
    entries = spark.createDataFrame([(i, e, b, None) for i, n in enumerate((7, 1, 12)) for e in range(2) for b in range(n)], "idx int, epoch int, block int, only long")
    quotas = entries.groupBy("idx").agg(F.count("*").alias("n"))
    dealt = deal(quotas, entries, 2, 9, tables).collect()
    assert len(dealt) == 40 and len({(r.idx, r.epoch, r.block) for r in dealt}) == 40  # disjoint, and all of them
    assert set(Counter(r.shard for r in dealt).values()) == {10}
    fewer = deal(quotas.withColumn("n", F.col("n") - (F.col("idx") == 2).cast("int") * 5), entries, 2, 9, tables).collect()
    assert Counter(r.idx for r in fewer) == {0: 14, 1: 2, 2: 19}
    want = sum(r.size * len(r.draws) for r in mix_sources(docs).collect())
    whole = mixing.deal
    monkeypatch.setattr(mixing, "deal", lambda quotas, *a: whole(quotas.withColumn("n", F.floor(F.col("n") / 2)), *a))
    assert sum(r.size * len(r.draws) for r in mix_sources(docs).collect()) < 0.8 * want


def test_fewer_entries_than_shards(spark):
    """One document, and three of two sources, to eight shards: most nodes of the tree are empty."""
    rows = [(1, "a b c", "x"), (2, "", "x"), (3, "d e", "y"), (4, None, None)]
    for some in (rows[:1], rows):
        few = spark.createDataFrame(some, "doc_id long, text string, source string")
        drawn = {r.doc_id: len(r.draws) for r in mix_sources(few).collect()}
        assert len(drawn) == len(some) and 1 <= drawn[1] <= 3 and all(n <= 3 for n in drawn.values())
        assert Counter(r.doc_id for r in mixed_documents(few).collect()) == {i: n for i, n in drawn.items() if n}


@pytest.mark.parametrize("partitions", ["4", "20"])
def test_mixed_documents_stand_shuffled_in_their_shards(spark, docs, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        want = sorted((d.shard, d.place, str(r.doc_id)) for r in mix_sources(docs).collect() for d in r.draws)
        got = mixed_documents(docs).select("doc_id", F.spark_partition_id().alias("at")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [str(r.doc_id) for r in got] == [i for _, _, i in want]
    ranges = -(-int(partitions) // 8)
    assert [r["at"] // ranges for r in got] == [s for s, _, _ in want] and len({s for s, _, _ in want}) > 1


def test_language(docs, none, rows):
    model = learn(docs)
    got = identify(docs, model).collect()
    assert len(got) == len(rows) and {r.lang_pred for r in got} <= {"en", "fr", "und"} and all(0 <= r.score <= 1 for r in got)
    pred = {r.doc_id: r.lang_pred for r in got}
    held = [r for r in rows if r[0] is not None and r[0] < 75 and r[2] and zlib.crc32(str(r[0]).encode()) % 3 == 1]
    assert len(held) > 10 and sum(pred[r[0]] == r[2] for r in held) >= 0.9 * len(held)
    texts = defaultdict(set)
    for r in rows:
        texts[r[0]].add(r[1])
    assert all(pred[i] == "und" for i, ts in texts.items() if i is not None and not any(c.isalpha() for t in ts for c in t or ""))
    kept = keep_identified(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() < len(rows)
    empty = learn(none)
    assert identify(none, empty).count() == 0 and {r.lang_pred for r in identify(docs, empty).collect()} == {"und"}
    assert keep_identified(none, empty).count() == 0


def plain_scorer(model_rows, langs):
    """A function of a text, from counted words (lang, word, n): dictionaries and loops."""
    cut = lambda w, k: [w] if k == 0 else [x for i in range(len(w) + 3 - k) if (x := f"<{w}>"[i : i + k]) and (k > 1 or 0 < i <= len(w))]
    counts = [defaultdict(Counter) for _ in range(6)]
    for lang, w, n in model_rows:
        for k in range(6):
            for g in cut(w, k):
                counts[k][g][lang] += n
    sums = [Counter() for _ in range(6)]
    for k in range(6):
        for by in counts[k].values():
            sums[k].update(by)
    logs = functools.cache(lambda k, g: np.array([np.log((counts[k][g][x] + 0.5) / (sums[k][x] + 0.5 * len(counts[k]))) for x in langs]))

    def score(text):
        total, seen = np.zeros(len(langs)), 0
        for w in regex.findall(r"\p{L}[\p{L}\p{M}]*", text.lower()):
            for k in (0, 5, 4, 3, 2, 1):
                known = [logs(k, g) for g in cut(w, k) if g in counts[k]]
                if known:
                    s = np.mean(known, axis=0)
                    total, seen = total + s - s.mean(), seen + 1
                    break
        e = np.exp((total - total.max()) / max(1, seen) ** 0.5)
        return int(np.argmax(total)), e.max() / e.sum()

    return score


def test_language_scores_equal_the_plain_ones():
    rng = random.Random(8)
    letters = {"a": "abcdeé", "b": "abxyzह\u093f", "c": "abcxyз"}
    word = lambda x: "".join(rng.choice(letters[x]) for _ in range(rng.randint(1, 7)))
    rows = Counter((x, regex.sub(r"^\p{M}+", "", word(x))) for x in letters for _ in range(300))
    rows = [(x, w, n) for (x, w), n in rows.items() if w]
    langs = sorted(letters)
    model = Model(langs, pa.array([w for _, w, _ in rows]), np.array([langs.index(x) for x, _, _ in rows]), np.array([float(n) for *_, n in rows]))
    texts = [" ".join(word(rng.choice(langs)) for _ in range(rng.randint(1, 12))) + rng.choice(["", " 12!", "½ Ⅷ"]) for _ in range(300)] + ["Ж", "AB, Cd"]
    texts = [t for t in texts if any(c.isalpha() for c in t)]
    best, score = model.predict(pa.array(texts))
    plain = plain_scorer(rows, langs)
    for t, b, s in zip(texts, best, score, strict=True):
        want = plain(t)
        assert abs(s - want[1]) < 1e-4 and (b == want[0] or want[1] < 0.5), t
    none, zero = model.predict(pa.array(["", "½ ² Ⅷ 12 ___", " \u0301"]))
    assert none.tolist() == [-1] * 3 and zero.tolist() == [0.0] * 3


def tokenizer():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_token_counts(docs, none, rows):
    path = tokenizer()
    sp = processor(path)
    got = count_tokens(docs, path, chunk=2_000, overlap=16).collect()
    same(got, [(r[0], len((t := r[1] or "").encode()), (n := len(sp.encode(t))), n > 4096) for r in rows])
    assert count_tokens(none, path).count() == 0


def test_chunks_agree_with_whole_texts():
    path = tokenizer()
    sp, rng = processor(path), random.Random(2)
    parts = ["the quick ", "é中😀", "  ", "\n\n", "▁", "international", "<s>", "aaaa", " 12345", "\0", "ﬁ"]
    for k in range(150):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 200)))
        assert count_by_chunks(path, text, rng.choice([5, 30, 200]), rng.choice([1, 4, 32])) == len(sp.encode(text)), text
        assert Units(path).count([text]) == [len(sp.encode(text))], text


def plain_hits(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    w, hit, found = words(text), set(), set()
    for name, t in items:
        p = words(t)
        m = min(13, len(p))
        for k in range(len(p) - m + 1) if m else ():
            for i in range(len(w) - m + 1):
                if w[i : i + m] == p[k : k + m]:
                    hit |= set(range(i, i + m))
                    found.add(name)
    return len(w), len(hit), found


def plain_windows(items):
    """The windows of the items as tuples of words, by their length."""
    out = defaultdict(set)
    for t in items:
        p = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
        m = min(13, len(p))
        out[m] |= {tuple(p[k : k + m]) for k in range(len(p) - m + 1)} if m else set()
    return out


def plain_contaminated(text, windows):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    hit = {j for m, some in windows.items() for i in range(len(w) - m + 1) if m and tuple(w[i : i + m]) in some for j in range(i, i + m)}
    return bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block", [1 << 20, 150])
def test_decontamination(spark, docs, none, rows, block):
    text = {r[0]: r[1] for r in rows}
    parts = text[75].split()
    items = [("1", " ".join(parts[15:50])), ("2", " ".join(parts[20:33])), ("3", "ONE"), ("4", ""), ("5", None), (None, "two words"), ("7", "! " + text[3])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate(docs, bench, block_bytes=block).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    want = []
    for r in rows:
        n, k, found = plain_hits(r[1], items)
        names = sorted(x for x in found if x)
        want.append((r[0], n, k, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), k > 0 and 20 * k >= n))
    same(got, want)
    clean = keep_clean(docs, bench, block_bytes=block)
    assert clean.columns == docs.columns and clean.count() == sum(not x[5] for x in want)
    assert decontaminate(none, bench).count() == 0
    assert not any(r.contaminated for r in decontaminate(docs, bench.limit(0)).collect())


def plain_components(rows):
    sets = []
    for r in rows:
        w = re.findall(SPACES, (r[1] or "").translate(LOW))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, r in enumerate(rows):
        least[find(i)].append(r[0])
    low = {k: min((x for x in v if x is not None), default=None) for k, v in least.items()}
    return [(r[0], len(sets[i]), low[find(i)] if sets[i] else r[0]) for i, r in enumerate(rows)], len(least)


@pytest.mark.parametrize("short", [48, 2])
def test_near_duplicates(docs, none, rows, monkeypatch, short):
    # With `short` at 2 nearly all lists are long: pivots and the search for what they missed do the work.
    monkeypatch.setattr(jaccard_join, "SHORT", short)
    monkeypatch.setattr(jaccard_join, "PIVOTS", 1)
    monkeypatch.setattr(jaccard_join, "PART", 3 if short == 2 else 200_000)
    monkeypatch.setattr(jaccard_join, "CHUNK", 2 if short == 2 else 64)
    want, n = plain_components(rows)
    same(near_duplicates(docs).collect(), want)
    if short > 2:
        kept = keep_one(docs)
        assert kept.columns == docs.columns and kept.count() == n
        assert near_duplicates(none).count() == keep_one(none).count() == 0


def plain_linked(a, b):
    both = len(set(a.tolist()) & set(b.tolist()))
    return 100 * both >= jaccard_join.LEAST * (len(a) + len(b) - both)


@pytest.mark.parametrize("probe", [0.0085, 1e-9, 10])
def test_divide_skip(monkeypatch, probe):
    # All lists long, most short, as usual: the same links.
    monkeypatch.setattr(jaccard_join, "PROBE", probe)
    rng = np.random.default_rng(6)
    for _ in range(150):
        pool = np.unique(rng.integers(0, 1 << 63, int(rng.integers(2, 200))).astype(np.uint64))
        some = lambda: pool[rng.random(len(pool)) < rng.uniform(0.7, 1)]  # noqa: B023, E731
        query, found = some(), [some() for _ in range(int(rng.integers(1, 12)))]
        if len(query):
            found = [x for x in [*found, query] if len(x)]
            assert sorted(jaccard_join.divide_skip(query, found)) == [k for k, x in enumerate(found) if plain_linked(query, x)]


def test_only_heap_and_probes_link(monkeypatch):
    """What the search pops, skips and probes is what decides: without its heap nothing is linked."""
    rng, seen, linked = np.random.default_rng(17), Counter(), 0
    cases = []
    for _ in range(60):
        base = np.unique(rng.integers(0, 1 << 63, 160).astype(np.uint64))
        some = lambda share: np.unique(np.concatenate([base[rng.random(len(base)) < share], rng.integers(0, 1 << 63, 8).astype(np.uint64)]))  # noqa: B023, E731
        cases.append((some(0.97), [some(rng.choice([0.3, 0.6, 0.85, 0.97])) for _ in range(30)]))
    usual = jaccard_join.PROBE
    for probe in (usual, 0.5):  # the usual weight sets most lists aside; a greater one leaves more to the merge, which then skips
        monkeypatch.setattr(jaccard_join, "PROBE", probe)
        for query, found in cases:
            got = jaccard_join.divide_skip(query, found, seen)
            assert sorted(got) == [k for k, x in enumerate(found) if plain_linked(query, x)]
            linked += len(got)
        assert seen["popped"] > 1000 and seen["probed"] > 1000
    monkeypatch.setattr(jaccard_join, "PROBE", usual)
    postings = sum(len(np.intersect1d(q, x)) for q, f in cases for x in f)
    assert linked > 200 and seen["skipped"] > 100 and seen["popped"] < 2 * postings
    monkeypatch.setattr(jaccard_join.heapq, "heapify", lambda heap: heap.clear())
    assert not any(jaccard_join.divide_skip(q, f) for q, f in cases)


def test_frequent_shingles_fit_at_any_level(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MOST_FREQUENT", 50)
    texts = [" ".join(f"w{i}" for i in range(k, k + 60)) for k in range(40)] * 3
    keys, n = jaccard_join.frequent_shingles(spark.createDataFrame([(t,) for t in texts], "text string"), 5)
    assert 40 <= len(keys) <= 60 and n.min() >= 66  # the 51st has 72


def test_bitmaps_never_refuse_a_link():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.uniform(0.6, 1)], rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 3))).astype(np.uint64)]))
        if len(b) and plain_linked(a, b):
            assert jaccard_join.may_reach(jaccard_join.parity(a), jaccard_join.parity(b), len(a), len(b))


def test_substring_dedup(docs, none, rows, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SEGMENTS", 3_000)
    monkeypatch.setattr(substring_dedup, "PASSAGES", 700)
    words = [re.findall(SPACES, r[1] or "") for r in rows]
    order = lambda r: (r[0] is None, r[0] or 0)
    first = {}
    for r, w in zip(rows, words, strict=True):
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            first[key] = min(first.get(key, (order(r), k)), (order(r), k))
    want = []
    for r, w in zip(rows, words, strict=True):
        gone = {p for k in range(len(w) - 19) if first[tuple(w[k : k + 20])] < (order(r), k) for p in range(k, k + 20)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    same(remove_repeats(docs).drop("removed").collect(), want)
    assert remove_repeats(none).count() == 0


def test_rows_keep_their_numbers_when_scans_are_cut_otherwise(spark, docs, rows, monkeypatch):
    """What is written is scanned in small splits, the last scan of each operator isn't, as when executors come or go between them."""
    key, put, calls = "spark.sql.files.maxPartitionBytes", Tables.put, []

    def cut(self, df, name):
        spark.conf.set(key, "4k")
        calls.append(name)
        out = put(self, df, name)
        spark.conf.set(key, "128m")
        return out

    default = spark.conf.get(key)
    bench = spark.createDataFrame([("1", "one"), ("2", " ".join(rows[75][1].split()[15:50]))], "item_id string, text string")
    forms = {
        "remove_repeats": lambda: remove_repeats(docs),
        "keep_one": lambda: keep_one(docs),
        "keep_clean": lambda: keep_clean(docs, bench, block_bytes=150),
        "shard_documents": lambda: shard_documents(docs).select("doc_id", "text"),
    }
    wrong = []
    try:
        for name, form in forms.items():
            want = sorted(map(str, form().collect()))
            calls.clear()
            with monkeypatch.context() as m:
                m.setattr(Tables, "put", cut)
                got = sorted(map(str, form().collect()))
            wrong += [name] if not calls or got != want else []
    finally:
        spark.conf.set(key, default)
    assert not wrong


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP, CARD, PHONE = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m)) <= 15]


def test_base_spans():
    rng = random.Random(7)
    for k in range(20_000):
        t = "".join(rng.choice("ab@@..--+ ()0123459é١\n" if k % 2 else "0149 -.") for _ in range(rng.randint(0, 60)))
        assert base_spans(t) == plain_spans(t), t


def test_personal_data(spark, docs, none, rows):
    names = ("email", "ip", "card", "phone")
    want = []
    for r in rows:
        found = plain_spans(r[1] or "")
        told = ",".join(f"{names[k]}:{s}:{e}" for k, s, e in found)
        want.append((r[0], *[sum(x[0] == k for x in found) for k in range(4)], hashlib.sha256(told.encode()).hexdigest(), told))
    same(find_personal_data(docs).drop("n_added", "private").collect(), want)
    assert all(r.private == bool(r.spans) for r in find_personal_data(docs).collect())
    assert find_personal_data(none).count() == 0
    told = [f"my contact number is +1 (415) 555-0{i:03d} today" for i in range(12)]
    told += ["my contact number is 415-555-0199 today", "my contact number is five today", "lot 415-555-0188 was sold"]
    got = find_personal_data(spark.createDataFrame(list(enumerate(told)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.spans for r in got[12:]] == ["phone:21:33", "", ""] and all(r.n_added == 0 for r in got[:12])


def test_personal_data_of_many_sure_patterns(spark):
    # Six patterns of confidence 0.999 give a score of exactly 1.0: the surest finds are no seeds.
    told = [f"{x} +1 (415) 555-0{i}{k:02d} {y}" for i, (x, y) in enumerate([("my contact number is", "today"), ("please call us on", "or write"), ("the desk answers under", "all day")]) for k in range(3)]
    told += ["my contact number is 415-555-0199 today", "please call us on 415-555-0199 or write", "the desk answers under 415-555-0199 all day"]
    got = find_personal_data(spark.createDataFrame(list(enumerate(told)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.spans for r in got[9:]] == ["phone:21:33", "phone:18:30", "phone:23:35"] and all(r.n_added == 0 for r in got[:9])


def test_unseen_identifiers_are_found_and_others_left(spark):
    """Seeds in some contexts; identifiers that no base form matches in the same ones and, through instances that were promoted, in a
    context without any seed; and numbers that are none. Recall and precision by document."""
    rng = random.Random(21)
    seeded = ["my contact number is {} today", "please call us on {} or write", "the desk answers under {} all day", "ring {} for help"]
    number = lambda: f"{rng.randint(200, 999)}{{0}}{rng.randint(200, 999)}{{0}}{rng.randint(1000, 9999)}"
    rows, hidden, second = [], set(), set()
    for _ in range(120):
        rows.append((rng.choice(seeded), f"+1 {number().format(' ')}"))
    many = [number().format(rng.choice("-. ")) for _ in range(30)]
    for x in many:  # each stands in two seeded contexts, and in one that has no seed
        for t in rng.sample(seeded, 2):
            hidden.add(len(rows))
            rows.append((t, x))
        second.add(len(rows))
        rows.append(("fax line {} only", x))
    fresh = [number().format("-") for _ in range(4)]
    for x in fresh:  # stands in the context without seeds only
        second.add(len(rows))
        rows.append(("fax line {} only", x))
    clean = range(len(rows), len(rows) + 80)
    for _ in clean:
        rows.append((rng.choice(["lot {} was sold", "in all {} were made", "page {} of the book"]), number().format("-")))
    got = find_personal_data(spark.createDataFrame([(i, t.format(x)) for i, (t, x) in enumerate(rows)], "doc_id long, text string")).collect()
    added = {r.doc_id: r.spans for r in got if r.n_added}
    right = {i for i, s in added.items() if s == f"phone:{rows[i][0].index('{')}:{rows[i][0].index('{') + len(rows[i][1])}"}
    assert len(right & hidden) >= 0.9 * len(hidden) and len(right & second) >= 0.9 * len(second)
    assert not set(added) - hidden - second and not set(added) & set(clean)


def plain_bootstrap(texts):
    """Spans that contexts add, by text: the rounds over the graph of patterns and instances in dictionaries and loops."""
    seen = [(i, k, s, e, t[s:e].lower(), patterns(t, s, e)) for i, t in enumerate(texts) for k, s, e in base_spans(t) + [(-1, s, e) for s, e in candidates(t, base_spans(t))]]
    members, seeds, scores = defaultdict(set), {(w, k) for _, k, _, _, w, _ in seen if k >= 0}, {}
    for *_, w, ps in seen:
        for x in ps:
            members[x].add(w)
    told = {w for w, _ in seeds}
    open_ = {(w, x) for _, k, _, _, w, ps in seen if k < 0 and w not in told for x in ps}
    rounds = 0
    while True:
        rounds, before, rules = rounds + 1, len(scores), {}
        for x, ws in members.items():
            for k in range(4):
                known = [1.0 if (w, k) in seeds else scores[w, k] for w in ws if (w, k) in seeds or (w, k) in scores]
                if len(known) >= 3 and sum(known) / len(ws) >= 0.5:
                    rules[x, k] = sum(known) / len(ws)
        for w in {w for w, _ in open_}:
            for k in range(4):
                doubts = [1 - min(rules[x, k], 0.999) for v, x in open_ if v == w and (x, k) in rules]
                if doubts and 1 - np.prod(doubts) >= 0.8 and re.search(SHAPES[k], w):
                    scores[w, k] = max(scores.get((w, k), 0.0), 1 - np.prod(doubts))
        if len(scores) == before:
            break
    out = defaultdict(list)
    for i, k, s, e, w, ps in seen:
        sure = [(rules[x, j], -j) for x in ps for j in range(4) if k < 0 and rules.get((x, j), 0) >= 0.8 and (w, j) in scores]
        if sure:
            out[i].append((-max(sure)[1], s, e))
    return dict(out), rounds


@pytest.mark.parametrize("seed", range(2))
def test_contexts_add_what_plain_rounds_add(spark, seed):
    """Contexts with any share of seeds of two kinds, unseen identifiers in several of them, numbers that are none, repeated and null texts."""
    rng = random.Random(seed)
    number = lambda by: by.join((str(rng.randint(200, 999)), str(rng.randint(200, 999)), str(rng.randint(1000, 9999))))
    holes = [f"{a} {b} {{}} {c}" for a, b, c in zip(["ring", "fax", "lot", "mail", "desk", "note", "unit"], ["on", "line", "no", "to", "at", "of", "x"], ["now", "only", "sold", "please", "daily", "it", "."])]
    mail = [f"user{i}@mail{i % 3}.example.com" for i in range(9)] + [f"user{i}@intern" for i in range(6)]
    numbers = [f"+1 {number(' ')}" for _ in range(20)] + [number("-") for _ in range(10)]
    texts = [None, "", "no identifiers here"]
    for h in holes:
        some = rng.sample(mail if h.startswith("mail") else numbers, rng.randint(5, 12)) + rng.sample(mail, rng.choice([0, 0, 1]))
        texts += [h.format(x) for x in some]
    texts += [f"box {number('-')} gone" for _ in range(4)]
    texts += rng.sample(texts, 6) + [rng.choice(holes).format(x) + " and " + rng.choice(holes).format(y) for x, y in zip(rng.sample(numbers, 12), rng.sample(numbers, 12), strict=True)]
    want, rounds = plain_bootstrap([t or "" for t in texts])
    got = find_personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    kinds = ("email", "ip", "card", "phone")
    spans = {r.doc_id: r.spans for r in got}
    for i, t in enumerate(texts):
        assert spans[i] == ",".join(f"{kinds[k]}:{s}:{e}" for k, s, e in sorted(base_spans(t or "") + want.get(i, []))), t
    assert want and rounds > 1 and all(r.n_added == 0 for r in got if (texts[r.doc_id] or "").startswith("box"))


TALK = "conv_id long, turn long, role string, text string, n long, page long, first string, c string"


def talk_rows(rows):
    return [(*r, 1, 2, "f", "c") for r in rows]


def test_chats(spark):
    talk = [(1, 0, "system", "be brief"), (1, 1, "user", "what is it?\nplease say"), (1, 2, "assistant", "- one\n- two\n\nthat is all"), (1, 3, "user", "thanks"), (2, 0, "user", None), (3, 0, "odd", "can you help?"), (3, 1, "Assistant", "yes:\n    if x:\n        y()"), (None, None, None, None)]
    df = spark.createDataFrame(talk_rows(talk), TALK)
    got = {r.conv_id: r for r in format_conversations(df).collect()}
    assert got[1].roles == "system,user,assistant,user" and got[3].roles == "user,assistant" and got[None].n_turns == got[2].n_turns == 0
    assert (got[1].n_told, got[3].n_told, got[3].n_rows, got[1].page, got[1].continued) == (4, 1, 2, 0, False)
    assert read_back(got[1].canonical) == [("system", "be brief"), ("user", "what is it?\nplease say"), ("assistant", "- one\n- two\n\nthat is all"), ("user", "thanks")]
    assert read_back(got[3].canonical)[1][1] == "yes:\n    if x:\n        y()"
    assert format_conversations(df.limit(0)).count() == 0
    assert parse("") == [] and render([]) == ""
    odd = [("user", "a <|end|> \\ b"), ("assistant", "<|user|>\nx")]
    assert read_back(render(odd)) == odd
    texts = spark.createDataFrame([(1, "User: hi\n\nBot:     x = 1;\n    y = 2;", "z"), (1, None, "z"), (2, " \n", "z")], "conv_id long, text string, roles string")
    assert sorted((r.n_turns, r.roles) for r in format_chats(texts).collect()) == [(0, ""), (0, ""), (2, "user,assistant")]
    assert parse("User: hi\n\nBot:     x = 1;\n    y = 2;")[1][1] == "    x = 1;\n    y = 2;"


def test_pages_give_what_whole_conversations_do(spark):
    """Ties, repeated rows, null turns, very long turns; pages of two rows against pages that hold all."""
    rng = random.Random(12)
    say = lambda: "\n".join(rng.choice(["what is it?", "- one", "done;", "so that was all there was to be said of this for now, and nothing else is left to be told", "", "Note: x", "Q: y?"]) for _ in range(rng.randint(1, 5)))
    rows = [(c, t if t % 7 else None, rng.choice(["user", "assistant", None]), say()) for c in range(12) for t in range(rng.randint(1, 14))]
    rows += rows[:5] + [(3, 4, None, "word " * 20_000)]
    df = spark.createDataFrame(talk_rows(rows), TALK)
    whole, cut = ({} for _ in range(2))
    for page, to in ((10_000, whole), (2, cut)):
        for r in format_conversations(df, page).orderBy("conv_id", "page").collect():
            roles = r.roles.split(",") if r.roles else []
            to.setdefault(r.conv_id, []).extend(roles[r.continued :])
    assert whole == cut and sum(map(len, whole.values())) > 50


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(3)
    for _ in range(60):
        n = len(STATES)
        c = Chances(rng.integers(0, 9, 3).astype(float), rng.integers(0, 9, (3, 3)).astype(float), rng.integers(1, 9, n).astype(float), np.zeros((n, len(FEATURES))), np.array([3.0, 4.0]))
        e = rng.normal(0, 2, (int(rng.integers(1, 6)), n))
        entry = None if rng.random() < 0.5 else int(rng.integers(n))
        end = None if rng.random() < 0.5 else int(rng.integers(n))

        def weight(path):
            w = (c.start if entry is None else c.move[entry])[path[0]] + e[0][path[0]]  # noqa: B023
            return w + sum(c.move[a, b] + e[i + 1][b] for i, (a, b) in enumerate(itertools.pairwise(path)))  # noqa: B023

        best = max((weight(p) for p in itertools.product(range(n), repeat=len(e)) if end is None or p[-1] == end))
        got = viterbi(e, c, entry, end)
        assert (best == -np.inf or abs(weight(got) - best) < 1e-9) and (end is None or got[-1] == end)
        for cut in range(1, len(e)):
            (_, at), (before, last) = joined([across(e[:cut], c), across(e[cut:], c)])
            path = viterbi(e[:cut], c, None, at) + viterbi(e[cut:], c, before, last)
            assert before == at and abs((c.start[path[0]] + e[0][path[0]] + sum(c.move[a, b] + e[i + 1][b] for i, (a, b) in enumerate(itertools.pairwise(path)))) - max(across(e, c)[0])) < 1e-9


def test_chances_are_counted(spark):
    talk = [(1, 0, "user", "a?\nb"), (1, 1, "assistant", "c\n\n- d"), (1, 2, "user", "e"), (2, 0, "system", "f"), (2, 1, None, "g"), (2, 2, "user", "h")]
    df = spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")
    for page in (10, 2, 1):
        c = learn_chances(pages(df, Tables(spark), page))
        assert c.first.tolist() == [1, 0, 1] and c.follows.tolist() == [[0, 1, 0], [1, 0, 0], [0, 0, 0]], page
    assert c.first.tolist() == [1, 0, 1] and c.follows.tolist() == [[0, 1, 0], [1, 0, 0], [0, 0, 0]] and c.marked.tolist() == [1, 5]
    assert c.lines.tolist() == [3, 1, 1, 1, 1, 0] and c.seen[0].tolist() == [1, 3, 0, 0, 0, 0, 3, 0, 0, 0] and c.seen[3].tolist() == [0, 1, 0, 0, 1, 0, 1, 0, 0, 0]


def test_hidden_roles_are_recovered(spark):
    """Roles of a third of the conversations are hidden from text and counts."""
    from duolex.llm.queries import op5_chat_format

    got = op5_chat_format(spark, "/root/testdata/sf0.01").collect()
    hidden = [r for r in got if r.held_out]
    assert sum(r.n_told for r in hidden) == 0 < sum(r.n_lines for r in hidden) and {zlib.crc32(str(r.conv_id).encode()) % 3 == 1 for r in hidden} == {True}
    assert sum(r.n_right for r in hidden) >= 0.9 * sum(r.n_lines for r in hidden)
    assert sum(r.n_rows for r in got) == spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").count()


def test_short_conversations_against_all_paths(spark):
    """From rows to roles: the path with the greatest weight of all, by trying each, with the chances that were counted."""
    rng = random.Random(19)
    say = {"user": ["why so?", "please go on", "and then?"], "assistant": ["it is so because of that, and of that, and of much more that would have to be told here", "so it goes;"], "system": ["be kind"]}
    rows = []
    for c in range(40):
        for t in range(rng.randint(1, 4)):
            role = "system" if t == 0 and c % 4 == 0 else ("user", "assistant")[t % 2]
            rows.append((c, t, role if c % 3 else None, rng.choice(say[role])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = pages(df, Tables(spark))
    chances = learn_chances(made, telling_words(df))
    assert chances.words
    want = {}
    for r in made.collect():
        lines = solid(page_text([x.asDict() for x in r.rows]), True)
        e = chances.emissions(lines)
        weigh = lambda p, e=e: chances.start[p[0]] + e[0][p[0]] + sum(chances.move[a, b] + e[k + 1][b] for k, (a, b) in enumerate(itertools.pairwise(p)))
        want[r.conv_id] = max(map(weigh, itertools.product(range(len(STATES)), repeat=len(lines)))), weigh, lines
    for r in format_conversations(df).collect():
        best, weigh, lines = want[r.conv_id]
        roles, path = r.roles.split(","), viterbi(chances.emissions(lines), chances)
        assert abs(weigh(path) - best) < 1e-9 and roles == [ROLES[STATES[s][0]] for s in path if STATES[s][1]]


def test_chat_roles_with_lost_markers():
    rng = random.Random(1)
    ask, tell = ["can you explain this?", "what is the plan?", "please fix it", "how do I start?"], ["Here is the plan, with all that matters for the first of the steps to be taken in it.", "That works as follows and needs no more than what was said in the first of the parts.", "1. open the file\n2. read it\n3. close it again"]
    right = total = 0
    for _ in range(200):
        turns = [("user", rng.choice(ask)) if i % 2 == 0 else ("assistant", rng.choice(tell)) for i in range(6)]
        text = "\n\n".join((f"{r.title()}: " if rng.random() < 0.6 else "") + t for r, t in turns)
        got = [r for r, _ in parse(text)]
        right += got == [r for r, _ in turns]
        total += 1
    assert right >= 0.9 * total


def test_substring_dedup_with_ids_of_text(spark):
    rng = random.Random(31)
    words = lambda n: [f"w{rng.randint(0, 400)}" for _ in range(n)]
    shared = words(60)
    rows = [(f"d{i}" if i else None, " ".join(words(rng.randint(0, 15)) + shared[rng.randint(0, 10) : rng.randint(35, 60)] + words(5))) for i in range(14)]
    rows.append(("d3x", " ".join([*shared, *words(3), *shared[5:40]])))
    first, want = {}, []
    order = lambda r: (r[0] is None, r[0] or "")
    for r in rows:
        w = r[1].split()
        for k in range(len(w) - 19):
            key = tuple(w[k : k + 20])
            first[key] = min(first.get(key, (order(r), k)), (order(r), k))
    for r in rows:
        w = r[1].split()
        gone = {p for k in range(len(w) - 19) if first[tuple(w[k : k + 20])] < (order(r), k) for p in range(k, k + 20)}
        want.append((r[0], len(w), len(gone)))
    got = remove_repeats(spark.createDataFrame(rows, "doc_id string, text string"))
    same(got.select("doc_id", "n_words", "n_removed").collect(), want)
    assert sum(n for *_, n in want) > 200
