"""Personal data by bootstrapped contextual extraction."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables, blocks, lean, need

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CHAIN = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]++")
#: Instances (seeds or promoted ones) that a pattern needs; confidence from which a pattern scores, and from which it adds spans and
#: an instance is promoted.
SUPPORT, HALF, SURE = 3, 0.5, 0.8
#: Digits that make a run a candidate; characters looked at for a word of context, a longer one counts as cut off.
CANDIDATE_DIGITS, CONTEXT = 4, 80
#: What an instance of each kind has to look like, besides its context.
SHAPES = {0: r"@", 1: r"^[0-9]+([.:_ -][0-9]+){3}$", 2: r"^([^0-9]*[0-9]){12,19}[^0-9]*$", 3: r"^([^0-9]*[0-9]){7,15}[^0-9]*$"}
_RUN = re.compile(r"\(?[0-9](?:[0-9]|[ ._:/()-]{1,2}(?=[0-9]))*+")
_EDGE = ".,;:!?()[]{}<>\"'*#&$%"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def emails(text: str):
    """Each @ with the run of local characters before it and the domain behind it: what the pattern finds, in linear time."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def ips(text: str):
    """Runs of dotted numbers, four parts at a time; a match with a part above 255 is dropped, not tried anew."""
    for m in _DOTTED.finditer(text):
        parts = [(x.start() + m.start(), x.end() + m.start()) for x in _DIGITS.finditer(m[0])]
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            if all(len(v := text[a:b].lstrip("0")) < 4 and int(v or 0) <= 255 for a, b in four):
                yield four[0][0], four[3][1]


def cards(text: str):
    for m in _CHAIN.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str):
    for m in _PHONE.finditer(text):
        if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
            yield m.span()


FINDERS = (emails, ips, cards, phones)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every base match, by kind, then start."""
    return [(k, s, e) for k, find in enumerate(FINDERS) for s, e in find(text)]


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What may be an identifier outside the base spans: words with an @, and runs of CANDIDATE_DIGITS digits or more with up to two
    separators between them."""
    found = []
    at = text.find("@")
    while at >= 0:
        s = e = at
        while s > 0 and not text[s - 1].isspace():
            s -= 1
        while e < len(text) and not text[e].isspace():
            e += 1
        word = text[s:e]
        found.append((s + len(word) - len(word.lstrip(_EDGE)), e - len(word) + len(word.rstrip(_EDGE))))
        at = text.find("@", e)
    for m in _RUN.finditer(text):
        if sum("0" <= c <= "9" for c in m[0]) >= CANDIDATE_DIGITS:
            found.append((m.start() + (m[0][0] == "(" and ")" not in m[0]), m.end()))
    # What is left of the text between base spans and candidates before; both lists are without overlaps then.
    held: list[list[int]] = []
    for s, e in sorted((s, e) for _, s, e in taken):
        if held and s < held[-1][1]:
            held[-1][1] = max(held[-1][1], e)
        else:
            held.append([s, e])
    out, k, done = [], 0, 0
    for s, e in sorted(found):
        while k < len(held) and held[k][1] <= s:
            k += 1
        if done <= s < e and not (k < len(held) and held[k][0] < e):
            out.append((s, e))
            done = e
    return out


def _plain(word: str) -> str:
    return re.sub(r"[0-9]", "0", word.lower().strip(_EDGE)) or "_"


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: the two words before it; the word before and the word behind."""
    before, behind = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    left, right = [_plain(x) for x in before.split()[-2:]], [_plain(x) for x in behind.split()[:1]]
    # A word that goes on beyond what is looked at has no end to be known by.
    if left and len(before.split()) <= 2 and start > CONTEXT and not text[start - CONTEXT - 1].isspace() and not before[0].isspace():
        left[0] = "..."
    if right and len(behind) == CONTEXT and len(behind.split(None, 1)) == 1 and not behind[-1].isspace():
        right[0] = "..."
    left, right = ["^", "^", *left], [*right, "$"]
    return [f"{left[-2]} {left[-1]} _", f"{left[-1]} _ {right[0]}"]


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data in every whole text.

    Base matches are the seeds. Each seed, and each other word or run of digits that may be an identifier, is an instance with the lexical
    patterns around it. The graph of patterns and instances is scored in rounds: a pattern's confidence for a kind is the mean score
    of its distinct instances (seeds 1, promoted ones their score, others 0), once SUPPORT of them are seeds or promoted; an
    instance's score is 1 minus the product of the doubts of its patterns of confidence HALF or more. One that looks like its kind and scores SURE or more is
    promoted: from then on it supports patterns as seeds do, so a pattern that no seed stands in may be admitted. Nothing is demoted, so
    the rounds end, when one promotes nothing. Promoted instances in a pattern of confidence SURE add a span. Edges are distinct
    before they are joined, so a line that millions of texts share counts once.

    Returns one row per input row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans (base and added), n_added, private (whether there is
    any span). Offsets are code points, ends exclusive. A null text is empty; a text without identifiers, or an empty table, adds
    nothing. Rows that repeat are judged each by itself, and count once in the graph. Of two kinds that fit a place the surer one is
    told, then the first listed. Other columns are ignored. Very long texts are taken by themselves.
    """
    need(docs, id_col, text_col)
    spark = docs.sparkSession
    tables = Tables(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32())])
    seen = pa.struct([("k", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("word", pa.string()), ("patterns", pa.list_(pa.string()))])

    def scan(batches):
        for batch in batches:
            for piece, texts in blocks(batch, 1, 1_000_000):
                base, all_ = [], []
                for t in texts.to_pylist():
                    found = base_spans(t)
                    base.append([{"k": k, "s": s, "e": e} for k, s, e in found])
                    every = found + [(-1, s, e) for s, e in candidates(t, found)]
                    all_.append([{"k": k, "s": s, "e": e, "word": t[s:e].lower(), "patterns": patterns(t, s, e)} for k, s, e in every])
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(base, pa.list_(span)), pa.array(all_, pa.list_(seen))], names=["id", "base", "seen"])

    span_type = "array<struct<k: int, s: int, e: int>>"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(scan), f"id {kind}, base {span_type}, seen array<struct<k: int, s: int, e: int, word: string, patterns: array<string>>>")
    rows = tables.put(rows.withColumn("row", F.monotonically_increasing_id()), "spans")
    words = rows.select("row", F.explode("seen").alias("x")).select("row", "x.*")
    edges = tables.put(words.select("k", "word", F.explode("patterns").alias("pattern")).distinct(), "edges")
    added = _bootstrap(words, edges, tables)
    empty = F.expr(f"cast(array() as {span_type})")
    out = rows.select("row", "id", "base").join(added.hint("merge"), "row", "left").withColumn("all", F.array_sort(F.concat("base", F.coalesce("more", empty)))) if added is not None else rows.select("id", "base", empty.alias("more"), F.col("base").alias("all"))
    names = F.array(*map(F.lit, KINDS))
    told = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"], x["e"])))
    n = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return out.select(F.col("id").alias(id_col), *[n(k).alias(f"n_{name}") for k, name in enumerate(KINDS)], F.sha2(told("base"), 256).alias("base_sha256"), told("all").alias("spans"), F.coalesce(F.size("more"), F.lit(0)).alias("n_added"), (F.size("all") > 0).alias("private"))


def _shaped():
    out = F.lit(False)
    for k, shape in SHAPES.items():
        out = out | ((F.col("k") == k) & F.col("word").rlike(shape))
    return out


def _bootstrap(words: DataFrame, edges: DataFrame, tables: Tables) -> DataFrame | None:
    """(row, more): spans that the patterns add. None where no pattern has the instances it needs."""
    links = tables.put(edges.select("pattern", "word").distinct(), "links")
    size = tables.put(links.groupBy("pattern").agg(F.count("*").alias("n")), "sizes")
    seeds = tables.put(edges.where("k >= 0").select("word", "k", F.lit(1.0).alias("score")).distinct(), "seeds")
    open_ = tables.put(edges.where("k < 0").select("pattern", "word").distinct().join(seeds.select("word").distinct(), "word", "left_anti"), "open")
    promoted, known, rules = seeds.limit(0), 0, None
    while True:
        scored = links.join(seeds.unionByName(promoted), "word").groupBy("pattern", "k").agg(F.sum("score").alias("s"), F.count("*").alias("support"))
        rules = scored.where(F.col("support") >= SUPPORT).join(size, "pattern").select("pattern", "k", (F.col("s") / F.col("n")).alias("confidence")).where(F.col("confidence") >= HALF)
        rules = tables.put(rules, "rules")
        if rules.isEmpty():
            return None
        doubt = F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(0.999))))
        guessed = open_.join(rules, "pattern").groupBy("word", "k").agg((1 - F.exp(doubt)).alias("score")).where((F.col("score") >= SURE) & _shaped())
        promoted = tables.put(promoted.unionByName(guessed).groupBy("word", "k").agg(F.max("score").alias("score")), "promoted")
        before, known = known, promoted.count()
        if known == before:
            break
    found = words.where("k < 0").select("row", "s", "e", "word", F.explode("patterns").alias("pattern"))
    found = found.join(rules.where(F.col("confidence") >= SURE), "pattern").join(promoted, ["word", "k"])
    best = found.groupBy("row", "s", "e").agg(F.max_by("k", F.struct("confidence", (-F.col("k")).alias("i"))).alias("k"))
    return tables.put(best.groupBy("row").agg(F.collect_list(F.struct("k", "s", "e")).alias("more")), "added")
