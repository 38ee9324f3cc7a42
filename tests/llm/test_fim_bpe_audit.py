"""Fill-in-middle, BPE and the filter audit against plain versions and the library, over the odd rows of test_operators and none."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from duolex.llm import bpe, fill_in_middle as fim
from duolex.llm import filter_audit as audit
from tests.llm.test_operators import SCHEMA, SPACES, docs, none, rows, same  # noqa: F401


# ---------------------------------------------------------------- fill in the middle
UNITS = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def plain_fim(ident, text):
    units, told = UNITS.findall(text), hashlib.sha256(f"1:{'' if ident is None else ident}".encode()).hexdigest()
    h = [int(told[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("every,step", [(256, 1 << 16), (3, 7)])
def test_fill_in_middle(docs, none, rows, every, step):  # noqa: F811
    made = fim.fill_in_middle(docs, every=every, step=step)
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    want = [(r[0], *plain_fim(r[0], r[1] or "")) for r in rows]
    same(made.collect(), want)
    assert {x[2] for x in want} == {"plain", "psm", "spm"}
    same(made.select("doc_id", fim.restored().alias("text")).collect(), [(r[0], r[1] or "") for r in rows])
    assert fim.fill_in_middle(none).count() == 0


def test_texts_with_parts_of_markers(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice(["<", "P", "S", "M", ">", "é", "😀", "ab", "\n", " ", "<P", "S>"]) for _ in range(rng.randint(0, 40))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = fim.fill_in_middle(df).select("*", fim.restored().alias("back")).collect()
    assert all(tuple(r)[1:6] == plain_fim(r.doc_id, texts[r.doc_id]) and r.back == texts[r.doc_id] for r in made) and len(made) == 600
    assert {r.form for r in made if "<P>" not in texts[r.doc_id]} == {"plain", "psm", "spm"}


def test_checkpoints_find_every_unit():
    rng = random.Random(9)
    for _ in range(200):
        text = "".join(rng.choice(["a", "Bc", "é", "中", "😀", " ", "1", "\n", "-"]) for _ in range(rng.randint(1, 60)))
        index = fim.Checkpoints(text.encode(), rng.randint(1, 9), rng.randint(1, 20))
        found = [m.start() for m in UNITS.finditer(text)] + [len(text)]
        assert index.units == len(found) - 1 and index.points == len(text)
        assert [index.find(k) for k in range(len(found))] == [(len(text[:p].encode()), p) for p in found]
        assert len(index.at_unit) <= -(-index.units // max(1, index.at_unit[1] if len(index.at_unit) > 1 else index.units))


# ---------------------------------------------------------------- byte-level BPE
@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


def ids_of(b):
    return np.frombuffer(bytes(b), "<u4").tolist()


def test_bpe_equals_the_library(docs, none, rows, path, library):  # noqa: F811
    made = bpe.bpe_decode(bpe.bpe_encode(docs, path), path)
    want = [(r[0], tuple(ids := library.encode(r[1] or "", add_special_tokens=False).ids), library.decode(ids, skip_special_tokens=False)) for r in rows]
    same([(r.doc_id, tuple(ids_of(r.ids)), r.text) for r in made.collect()], want)
    assert bpe.bpe_decode(bpe.bpe_encode(none, path), path).count() == 0


def test_bpe_of_odd_texts(path, library, monkeypatch):
    rng, encoder = random.Random(2), bpe.Encoder(path)
    monkeypatch.setattr(bpe, "KEPT", 50)
    monkeypatch.setattr(bpe, "AT_ONCE", 100)
    parts = ["the quick ", "é中😀", "  ", "\n\n", "international", "<|endoftext|>", "<|endof", "aaaa", " 12345", "\0", "ﬁ", "'s", "'ll", "\x1c", "\x85", "　", "abab", "====", "́"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(600)]
    texts += ["".join(rng.choice("ab eEhtn'.-=") for _ in range(rng.randint(1, 300))) for _ in range(300)] + [f"a{chr(c)} b{chr(c)}1" for c in range(0x20, 0x3000, 3)]
    whole = encoder.encode_all(texts)
    for t, b in zip(texts, whole, strict=True):
        ids = ids_of(b)
        assert b == encoder.encode(t)
        assert ids == library.encode(t, add_special_tokens=False).ids, t
        assert b"".join(encoder.v.spoken[i] for i in ids).decode("utf-8", "replace") == library.decode(ids, skip_special_tokens=False)


def test_decoding_of_any_ids(spark, path, library):
    rng = random.Random(4)
    runs = [[rng.randrange(50_257) for _ in range(rng.randint(0, 12))] for _ in range(200)] + [[rng.randrange(256) for _ in range(9)] for _ in range(100)]
    df = spark.createDataFrame([(i, bytearray(np.array(x, "<u4").tobytes()), "z") for i, x in enumerate(runs)] + [(None, None, "z")], "doc_id long, ids binary, text string")
    got = {r.doc_id: r.text for r in bpe.bpe_decode(df, path).collect()}
    assert got.pop(None) == "" and got == {i: library.decode(x, skip_special_tokens=False) for i, x in enumerate(runs)}


def merged(v, letters):
    """Merging as it is defined: the pair of lowest rank, the leftmost of equals, until none is left."""
    ids = list(letters)
    while True:
        ranks = [v.rank_of.get(p, bpe.NEVER) for p in itertools.pairwise(ids)]
        if not ranks or min(ranks) == bpe.NEVER:
            return ids
        k = ranks.index(min(ranks))
        ids[k : k + 2] = [next(t for t, p in v.parts.items() if v.rank[t] == ranks[k])]


def test_prefixes_and_pairs_of_a_small_vocabulary(tmp_path):
    """On made-up merges: every prefix's encoding ends with the token that is stored, and pairs are compatible as merging says."""
    import json

    rng = random.Random(6)
    for k in range(12):
        letters, tokens, merges = bpe.byte_letters(), ["a", "b", "c"], []
        while len(merges) < 25:
            x, y = rng.choice(tokens), rng.choice(tokens)
            if x + y not in tokens and len(x + y) < 9:
                tokens.append(x + y)
                merges.append([x, y])
        every = letters + [t for t in tokens if len(t) > 1]
        spec = {
            "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "decoder": {"type": "ByteLevel"},
            "model": {"type": "BPE", "vocab": {t: i for i, t in enumerate(every)}, "merges": merges},
        }
        where = tmp_path / f"{k}.json"
        where.write_text(json.dumps(spec))
        v, id_of = bpe.Vocabulary(str(where)), {t: i for i, t in enumerate(every)}
        for _ in range(60):
            text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 25)))
            assert v.encode_unit(text) == merged(v, [id_of[c] for c in text]), (merges, text)
        good = [t for t in tokens if merged(v, [id_of[c] for c in t]) == [id_of[t]]]
        for x, y in itertools.product(good[:14], repeat=2):
            assert v.compatible(id_of[x], id_of[y]) == (merged(v, [id_of[c] for c in x + y]) == [id_of[x], id_of[y]])
    spec["normalizer"] = {"type": "NFC"}
    where.write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        bpe.Vocabulary(str(where))


# ---------------------------------------------------------------- filter audit
def plain_audit(rows, labels):  # noqa: F811
    good, toxic = ({i for i, q, t in labels if i is not None and x(q, t)} for x in (lambda q, t: q == 1, lambda q, t: t == 1))
    parts = defaultdict(list)
    for r in rows:
        t, w = r[1] or "", re.findall(SPACES, r[1] or "")
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        fails["E"] = r[0] is not None and any(o[0] is not None and o[0] < r[0] and (o[1] or "") == t for o in rows)
        parts[r[3] or ""].append((fails, r[0] in good, r[0] in toxic))
    out = []
    for part, docs_ in parts.items():
        found = {}
        for order in itertools.permutations("ABCDE"):
            left = docs_
            for k, f in enumerate(order):
                gone, fail = [d for d in left if d[0][f]], [d for d in docs_ if d[0][f]]
                left = [d for d in left if not d[0][f]]
                alone = sum(sum(d[0].values()) == 1 for d in fail)
                found["".join(order), k + 1] = (f, len(left), len(gone), len(fail) - len(gone), alone, sum(d[1] for d in gone), sum(d[2] for d in gone))
        shapley = Counter()
        for f, _, n, *_ in found.values():
            shapley[f] += n
        out += [(part, order, k, *x[1:], shapley[x[0]]) for (order, k), x in found.items()]
    return out


def audit_rows(rows):  # noqa: F811
    rng = random.Random(3)
    more = ["LOUD " * 60, "odd # sign", "A & B " * 80, " ".join(f"w{i}" for i in range(70)), " ".join(f"w{i}" for i in range(70)), "É" * 10 + "ABC"]
    out = rows + [(200 + i, t, "en", rng.choice(["s0", "", None]), 1, "r", "sh", "sz", "h", "k", "i", "g") for i, t in enumerate(more * 2)]
    return [r for r in out if r[1] is None or len(r[1]) < 50_000 or r[0] == 107]


@pytest.mark.parametrize("held", [1000, 1])
def test_filter_audit(spark, docs, none, rows, monkeypatch, held):  # noqa: F811
    monkeypatch.setattr(audit, "PARTS_HELD", held)
    some = audit_rows(rows)
    told = [(r[0], i % 3 % 2 if i % 7 else None, int(i % 5 == 0), "x") for i, r in enumerate(some)] + [(3, 1, 1, "x"), (3, 0, 0, "x"), (9999, 1, 1, "x"), (None, 1, 1, "x")]
    labels = spark.createDataFrame(told, "doc_id long, quality int, toxic int, source string")
    got = audit.filter_audit(spark.createDataFrame(some, SCHEMA).repartition(3), labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    want = plain_audit(some, [x[:3] for x in told])
    same(got.collect(), want)
    assert len(want) == 600 * len({r[3] or "" for r in some}) and sum(x[7] for x in want) and sum(x[8] for x in want)
    if held > 1:
        assert audit.filter_audit(none, labels).count() == 0
        assert audit.filter_audit(docs, labels.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first() == (0, 0)


def test_the_table_has_the_first_failure():
    table = audit.first_failures()
    assert table.shape == (32, 120) and (table[0] == 5).all()
    for mask, (k, order) in itertools.product(range(32), enumerate(audit.ORDERS)):
        steps = [i for i, f in enumerate(order) if mask >> "ABCDE".index(f) & 1]
        assert table[mask, k] == min(steps, default=5)
