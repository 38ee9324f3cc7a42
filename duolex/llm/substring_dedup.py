"""Substring dedup by repeated-phrase automata."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import PLAIN, Tables, Words, blocks, grams, lean, need

WINDOW = 20
#: Words of an anchor: each window is known by its least hash of so many consecutive words.
ANCHOR = 8
#: Bytes of passages that one automaton is built from, and of segments that run through one copy of it. Both bound a task, not the data:
#: more passages make more automata, more segments more copies.
PASSAGES, SEGMENTS = 500_000, 4_000_000
#: Bytes of text that a task looks at at once, but for a single longer one.
BLOCK_BYTES = 1_000_000

_ODD = np.uint64(0x9FB21C651E98DF25)


def least_anchors(g: np.ndarray, window: int) -> np.ndarray:
    """For each window the least of the anchor hashes in it. Equal windows have equal ones. By doubling."""
    need_, have, out = window - ANCHOR + 1, 1, g
    while have * 2 <= need_:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (need_ - have)], out[need_ - have :]) if need_ > have else out


def by_text(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Values told apart by text, too."""
    return values ^ (doc.astype(np.uint64) * _ODD)


class Windows:
    """The windows of a block of texts: first words `at`, texts `doc`, anchors `least`."""

    def __init__(self, w: Words, window: int):
        self.g = grams(w.hashes(), ANCHOR)
        least = least_anchors(self.g, window) if len(self.g) >= window - ANCHOR + 1 else self.g[:0]
        count = np.diff(w.row)
        doc = np.repeat(np.arange(len(count)), count)[: len(least)]
        ends = w.row[1:][doc]
        ok = np.arange(len(least)) + window <= ends
        self.at, self.doc, self.least = np.flatnonzero(ok), doc[ok], least[ok]

    def within(self, hits: pa.ListArray) -> np.ndarray:
        """Keeps the windows whose anchor is in the text's list of (h, home), and gives their homes."""
        flat = hits.flatten()
        sizes = pa.compute.list_value_length(hits).to_numpy(zero_copy_only=False).astype(np.int64)
        keys = by_text(flat.field(0).to_numpy().view(np.uint64), np.repeat(np.arange(len(hits)), sizes))
        order = np.argsort(keys)
        keys, homes = keys[order], flat.field(1).to_numpy()[order]
        mine = by_text(self.least, self.doc)
        at = np.searchsorted(keys, mine)
        keep = np.zeros(len(mine), bool)
        inside = at < len(keys)
        keep[inside] = keys[at[inside]] == mine[inside]
        self.at, self.doc, self.least = self.at[keep], self.doc[keep], self.least[keep]
        return homes[at[keep]]


def stretches(w: Words, at: np.ndarray, doc: np.ndarray, home: np.ndarray, window: int):
    """Runs of consecutive windows of one home as (text, home, first word in the text, words joined by single spaces)."""
    if not len(at):
        return
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]) | (home[1:] != home[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    lo, hi = w.start[at[first]], w.end[at[last] + window - 1]
    raw = w.data
    for k, i in enumerate(first):
        d = int(doc[i])
        yield d, int(home[i]), int(at[i] - w.row[d]), b" ".join(raw[lo[k] : hi[k]].tobytes().split()).decode()


class Phrases:
    """An automaton over passages (id, row, start, words). Its phrases are blocks of words, cut so densely that each window inside a
    passage holds a whole one; of those in reach the block is taken that is rarest among the passages, so that what differs tells near
    copies apart. What is found is extended word by word as far as passage and segment agree."""

    def __init__(self, passages: list[tuple], window: int):
        self.passages, self.window = passages, window
        block = max(1, 2 * window // 5)
        reach = window - block + 1
        keys = [[" " + " ".join(words[k : k + block]) + " " for k in range(len(words) - block + 1)] for *_, words in passages]
        count = Counter(x for ks in keys for x in ks)
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for p, ks in enumerate(keys):
            # A window from word i on holds a block that begins at i to i + reach - 1.
            k, last = -1, len(passages[p][3]) - window
            while k < last:
                k = min(range(min(k + reach, len(ks) - 1), k, -1), key=lambda j: count[ks[j]])
                places[ks[k]].append((p, k))
        self.automaton = ahocorasick.Automaton()
        for key, where in places.items():
            self.automaton.add_word(key, (len(key), where))
        if places:
            self.automaton.make_automaton()
        self.known: dict[str, list[tuple[int, int, int, int]]] = {}

    def locate(self, text: str) -> list[tuple[int, int, int, int]]:
        """(passage, shift, a, b): words a to b - 1 of the segment are those of the passage from a - shift on; one entry for each
        longest agreement of a window or more. Segments repeat, so some are remembered."""
        if text in self.known:
            return self.known[text]
        out, done, words, counted, i = [], {}, None, 0, 0
        spaced = f" {text} "
        for end, (size, where) in self.automaton.iter(spaced) if len(self.automaton) else ():
            if words is None:
                words = text.split(" ")
            at = end - size + 1
            if at < counted:
                counted, i = 0, 0
            i += spaced.count(" ", counted, at)
            counted = at
            for p, k in where:
                shift = i - k
                if done.get((p, shift), -1) > i:
                    continue
                passage = self.passages[p][3]
                a, b = i, i
                while a > 0 and a > shift and words[a - 1] == passage[a - 1 - shift]:
                    a -= 1
                most = min(len(words), len(passage) + shift)
                while b + 32 <= most and words[b : b + 32] == passage[b - shift : b - shift + 32]:
                    b += 32
                while b < most and words[b] == passage[b - shift]:
                    b += 1
                done[p, shift] = b
                if b - a >= self.window:
                    out.append((p, shift, a, b))
        if len(self.known) >= 500:
            self.known.clear()
        if len(text) < 10_000:
            self.known[text] = out
        return out


def union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _arrow(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Removes each word that lies in a window of `window` consecutive words which also starts earlier: in a document with a smaller
    id, or earlier in the same one. Windows are judged on the input.

    1. Confirmed passages. Of each window the least hash of its 8-word phrases is its anchor, about one word in seven. Anchors are
       counted over all documents; one that occurs once is dropped with all its windows. Windows left over are counted by hash;
       what occurs twice is owned by the least id. Runs of windows that a document owns, at their first place in it, are the
       passages: all text that recurs, each window once.
    2. Sharded automata. An anchor's home is the first row that holds it, so windows with that anchor, wherever they are, share a home.
       Homes are packed into shards of about PASSAGES bytes of passages, and each shard's passages are compiled into one automaton.
    3. Streaming. Every document runs, in its stretches of recurring anchors, through the automata of their homes; outside of
       these stretches no window can recur. The automaton finds the passages' phrases, which are extended word by word: this alone
       decides what is removed. A shard with many segments is copied to as many tasks, one with too large passages is cut, too.

    Returns one row per input row: id, n_words, n_removed, kept_sha256 (kept words joined by single spaces), removed (ranges of
    word numbers, end exclusive). A null text has no words. Rows that repeat an id are the same document twice: neither is
    earlier. Null ids come after all others. Rows are numbered once, in a written table that all later steps read. Other columns
    are ignored; an empty table gives no rows. Occurrences are compared word by word; the only chance is that two different
    recurring windows share 64 bits, when the one with the larger owner may keep its repeats.
    """
    need(docs, id_col, text_col)
    if window < ANCHOR:
        raise ValueError(f"a window has {ANCHOR} words at least")
    spark = docs.sparkSession
    tables = Tables(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    whole_numbers = kind in ("bigint", "int", "smallint", "tinyint")
    if whole_numbers:
        ident, id_kind = F.coalesce(F.col("doc").cast("long"), F.lit((1 << 63) - 1)), "bigint"
    else:
        ident, id_kind = F.struct(F.col("doc").isNull().alias("z"), F.col("doc").alias("d")), f"struct<z: boolean, d: {kind}>"
    # Another scan of `docs` may be cut otherwise and number its rows otherwise.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    rows = tables.put(rows, "rows")

    def scan(batches):
        for batch in batches:
            for piece, texts in blocks(batch, 2, BLOCK_BYTES):
                w = Words(texts, PLAIN)
                v = Windows(w, window)
                # Anchors by text, once for each; twice where the phrase stands at two places of the text.
                turn = np.ones(len(v.at), bool)
                turn[1:] = (v.least[1:] != v.least[:-1]) | (v.doc[1:] != v.doc[:-1])
                at = np.flatnonzero(turn)
                keys, first = np.unique(by_text(v.least[at], v.doc[at]), return_index=True)
                all_docs = np.repeat(np.arange(len(texts)), np.diff(w.row))[: len(v.g)]
                every = np.sort(by_text(v.g, all_docs))
                twice = np.unique(every[1:][every[1:] == every[:-1]])
                many = np.isin(keys, twice)
                at = at[first]
                doc, value = np.repeat(v.doc[at], 1 + many), np.repeat(v.least[at], 1 + many)
                order = np.argsort(doc, kind="stable")
                offsets = np.searchsorted(doc[order], np.arange(len(texts) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(value[order].view(np.int64)))
                digest = [hashlib.sha256(b" ".join(t.as_buffer().to_pybytes().split())).hexdigest() for t in texts]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(np.diff(w.row).astype(np.int64)), pa.array(digest, pa.string()), lists], names=["row", "doc", "n_words", "sha", "anchors"])

    scanned = tables.put(rows.select("row", "doc", "text").mapInArrow(lean(scan), f"row long, doc {kind}, n_words long, sha string, anchors array<long>"), "anchors")
    each = scanned.select("row", F.explode("anchors").alias("h"))
    recurring = tables.put(each.groupBy("h").agg(F.count("*").alias("n"), F.min("row").alias("home")).where("n > 1").select("h", "home"), "recurring")
    tables.sweep()
    hits = each.join(recurring.hint("merge"), "h").groupBy("row").agg(F.collect_set(F.struct("h", "home")).alias("hits"))
    hits = tables.put(hits, "hits")
    light = tables.put(scanned.select("row", "doc", "n_words", "sha"), "words")
    tables.drop(scanned, recurring)
    texts = tables.put(rows.join(hits.hint("merge"), "row").select("row", ident.alias("id"), "text", "hits"), "texts")
    tables.drop(rows, hits)

    def candidates(batches):
        """Windows that may recur: hash, id, whether once or more often in the text."""
        for batch in batches:
            for piece, part in blocks(batch, 1, BLOCK_BYTES):
                w = Words(part, PLAIN)
                v, whole = Windows(w, window), grams(w.hashes(), window)
                v.within(piece.column(2))
                _, first, n = np.unique(by_text(whole[v.at], v.doc), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(whole[v.at[first]].view(np.int64)), piece.column(0).take(pa.array(v.doc[first])), pa.array(np.minimum(n, 2).astype(np.int32))], names=["h", "id", "n"])

    found = texts.select("id", "text", "hits").mapInArrow(lean(candidates), f"h long, id {id_kind}, n int")
    owned = found.groupBy("h").agg(F.sum("n").alias("n"), F.min("id").alias("owner")).where("n > 1").select("h", "owner")
    owned = tables.put(owned.groupBy("owner").agg(F.collect_list("h").alias("own")), "owned")
    tables.sweep()
    names, types = ["home", "row", "id", "start", "size", "words"], f"home long, row long, id {id_kind}, start int, size int, words string"

    def cut(own: bool):
        """Stretches of each text: with `own` those of the windows it owns, at their first places, otherwise all that may recur."""

        def run(batches):
            for batch in batches:
                for piece, part in blocks(batch, 2, BLOCK_BYTES):
                    w = Words(part, PLAIN)
                    v = Windows(w, window)
                    home = v.within(piece.column(3))
                    if own:
                        lists = piece.column(4)
                        sizes = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
                        wanted = by_text(lists.flatten().to_numpy().view(np.uint64), np.repeat(np.arange(len(lists)), sizes))
                        keys, first = np.unique(by_text(grams(w.hashes(), window)[v.at], v.doc), return_index=True)
                        take = np.sort(first[np.isin(keys, wanted)])
                        v.at, v.doc, home = v.at[take], v.doc[take], home[take]
                    of, out = [], []
                    for d, h, start, words in stretches(w, v.at, v.doc, home, window):
                        of.append(d)
                        out.append((h, start, len(words), words))
                    cols = list(zip(*out, strict=True)) or [()] * 4
                    at = pa.array(of, pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), piece.column(0).take(at), piece.column(1).take(at), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], names=names)

        return lean(run)

    passages = tables.put(texts.join(owned.hint("merge"), F.col("id") == F.col("owner")).select("row", "id", "text", "hits", "own").mapInArrow(cut(True), types), "passages")
    tables.drop(owned)
    segments = tables.put(texts.select("row", "id", "text", "hits").mapInArrow(cut(False), types), "segments")
    shards = 1 + int(passages.agg(F.sum("size")).first()[0] or 0) * 2 // PASSAGES
    shard = F.pmod(F.xxhash64("home"), F.lit(shards)).alias("shard")
    grid = passages.groupBy(shard).agg(F.sum("size").alias("p")).join(segments.groupBy(shard).agg(F.sum("size").alias("q")), "shard")
    grid = tables.put(grid.select("shard", F.ceil(F.col("q") / SEGMENTS).cast("int").alias("copies"), F.ceil(F.col("p") / PASSAGES).cast("int").alias("cuts")), "grid")
    place = F.xxhash64("row", "start")
    keys = ["shard", "copy", "cut"]
    all_ = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n: F.pmod(place, F.col(n)).cast("int")
    kept = ["row", "id", "start", "words"]
    laid = passages.select(shard, *kept).join(grid, "shard").select("shard", all_("copies").alias("copy"), one("cuts").alias("cut"), F.lit(0).alias("kind"), *kept)
    sent = segments.select(shard, *kept).join(grid, "shard").select("shard", one("copies").alias("copy"), all_("cuts").alias("cut"), F.lit(1).alias("kind"), *kept)
    earlier = (lambda a, b: a < b) if whole_numbers else (lambda a, b: (a["z"], a["d"]) < (b["z"], b["d"]))

    def stream(batches):
        """Rows sorted by shard, copy, cut, kind: passages come first, then the segments that run through their automaton."""
        now, passages, phrases, out = None, [], None, []
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                for *key, kind_, row, ident_, start, words in zip(*(c.to_pylist() for c in batch.slice(lo, 500).columns), strict=True):
                    if key != now:
                        now, passages, phrases = key, [], None
                    if kind_ == 0:
                        passages.append((ident_, row, start, words.split(" ")))
                        continue
                    phrases = phrases or Phrases(passages, window)
                    hit = []
                    for p, shift, a, b in phrases.locate(words):
                        other, its_row, its_start, _ = passages[p]
                        if earlier(other, ident_) or (its_row == row and its_start - shift < start):
                            hit.append((a, b))
                    out += [(row, start + s, start + e) for s, e in union(hit)]
                yield _arrow(out, ["row", "s", "e"], [pa.int64(), pa.int32(), pa.int32()])
                out = []

    cells = laid.unionByName(sent).repartition(*keys).sortWithinPartitions(*keys, "kind")
    located = cells.mapInArrow(lean(stream), "row long, s int, e int")
    located = tables.put(located.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("at")), "located")
    tables.drop(passages, segments)

    def clean(batches):
        for batch in batches:
            for piece, part in blocks(batch, 1, BLOCK_BYTES):
                gone, digest, merged = [], [], []
                for text, at in zip(part, piece.column(2).to_pylist(), strict=True):
                    words, kept, last = text.as_buffer().to_pybytes().split(), [], 0
                    ranges = union([(x["s"], x["e"]) for x in at])
                    for s, e in ranges:
                        kept += words[last:s]
                        last = e
                    kept += words[last:]
                    gone.append(len(words) - len(kept))
                    digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                    merged.append([{"s": s, "e": e} for s, e in ranges])
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(merged, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))], names=["row", "n_removed", "kept", "removed"])

    changed = texts.select("row", "text").join(located.hint("merge"), "row").mapInArrow(lean(clean), "row long, n_removed long, kept string, removed array<struct<s: int, e: int>>")
    changed = tables.put(changed, "changed")
    tables.drop(texts, located)
    out = light.join(changed.hint("merge"), "row", "left")
    return out.select(F.col("doc").alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "sha").alias("kept_sha256"), F.coalesce("removed", F.array()).alias("removed"))
