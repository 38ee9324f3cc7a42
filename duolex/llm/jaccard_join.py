"""n-gram Jaccard self-join by T-occurrence search (DivideSkip), with its components."""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected
from .shared import LOWER, Tables, Words, blocks, grams, lean, mix, need

SIZE = 5
#: Least Jaccard similarity, in hundredths.
LEAST = 80
#: Shingles that lists are ordered by frequency for; a bound of what is broadcast. All others go by hash.
MOST_FREQUENT = 1 << 17
#: Shingles that one counting pass over a part of the documents holds.
COUNTED = 2_000_000
#: A list of up to so many documents is paired completely at once; members of a longer one first go to its PIVOTS.
SHORT, PIVOTS = 32, 1
#: Members that one part of a very long list has; each part has a pivot of its own, and the pivots are a list in turn.
PART = 200_000
#: Members of long lists that one task holds against as many others.
BLOCK = 500
#: Candidates that a query is merged with at once.
CHUNK = 64
#: DivideSkip's weight of a probe against a merge step: L = T / (PROBE * log2 of the longest list + 1) lists are probed.
PROBE = 0.0085
#: Most bits of the map that tells a scan which documents to send.
MAP_BITS = 27
_SALT = 0xD6E8FEB86659FD93


def shingle_sets(texts: pa.Array, size: int):
    """Yields for each text its sorted distinct shingle hashes. A text of fewer words has one, of all its words; one of none has none."""
    w = Words(texts, LOWER)
    h = w.hashes()
    g = grams(h, size)
    for i in range(len(w.row) - 1):
        a, b = int(w.row[i]), int(w.row[i + 1])
        if b - a >= size:
            yield np.unique(g[a : b - size + 1])
        elif b > a:
            yield mix(grams(h[a:b], b - a) ^ np.uint64(_SALT * (b - a) % (1 << 64)))
        else:
            yield h[:0]


def signature(s: np.ndarray) -> bytes:
    """128 bits of a set: sets with the same signature are one class."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def prefix(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The q - T + 1 rarest shingles of a set of q, T = ceil(LEAST q / 100): a partner shares T shingles at least, so it is in one
    of their lists. These are the short lists that are merged; the T - 1 others, with the frequent shingles (`frequent`: sorted
    from rare to frequent, behind all others), are the long lists that are only probed."""
    q = len(s)
    k = q - -(-LEAST * q // 100) + 1
    keys, ranks = frequent
    at = np.minimum(np.searchsorted(keys, s), max(len(keys) - 1, 0))
    hot = keys[at] == s if len(keys) else np.zeros(q, bool)
    cold = s[~hot]  # in the order of hashes
    if len(cold) >= k:
        return cold[:k]
    warm = s[hot][np.argsort(ranks[at[hot]], kind="stable")]
    return np.concatenate([cold, warm[: k - len(cold)]])


def parity(s: np.ndarray) -> bytes:
    """A bitmap of two bits a shingle (a power of two, 64 at least) in which each shingle flips one bit. Two maps of one width differ
    in no more bits than the sets have unshared shingles; folding a map halves its width and keeps that."""
    width = 64
    while width < 2 * len(s):
        width *= 2
    flips = np.bincount((s % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def may_reach(a: bytes, b: bytes, n_a: int, n_b: int) -> bool:
    """Whether the bitmaps leave room for a similarity of LEAST. Exact in one direction: no linked pair is refused."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    apart = int(np.unpackbits(x ^ y).sum())
    # 100 i >= LEAST (n - i) with i = (n - apart) / 2 for n = n_a + n_b
    return (100 + LEAST) * (n_a + n_b - apart) >= 2 * LEAST * (n_a + n_b)


def required(n, m):
    """The least intersection of linked sets of n and m: 100 i >= LEAST (n + m - i). Works on numbers and on arrays."""
    return -(-LEAST * (n + m) // (100 + LEAST))


def inverted(query: np.ndarray, found: list[np.ndarray]) -> list[list[int]]:
    """Of the shingles of `query` that some of the sets `found` has, the lists of the sets that have them, each rising: all shingles sorted once."""
    shingle, member = np.concatenate(found), np.repeat(np.arange(len(found)), [len(s) for s in found])
    at = np.minimum(np.searchsorted(query, shingle), len(query) - 1)
    mine = query[at] == shingle
    at, member = at[mine], member[mine]
    order = np.argsort(at * len(found) + member)
    edges = np.flatnonzero(np.diff(at[order])) + 1
    return [x.tolist() for x in np.split(member[order], edges) if len(x)]


def divide_skip(query: np.ndarray, found: list[np.ndarray], seen: Counter | None = None) -> list[int]:
    """Which of the sets `found` are linked with `query`, by T-occurrence search over the inverted lists of the query's shingles.

    T is the least intersection that any of them needs. The L longest lists are set aside; the others are merged by a heap, in which lists
    skip ahead by binary search where fewer than T - L could agree. What occurs T - L times is looked up in the long lists by binary
    search, and stays if it reaches the intersection its own size asks for. Nothing else counts. `seen` is told of heads popped, places skipped and lists probed."""
    seen = Counter() if seen is None else seen
    need_ = [int(required(len(query), len(s))) for s in found]
    lists = sorted(inverted(query, found), key=len)
    if not lists:
        return []
    least = min(need_)
    n_long = max(0, min(least - 1, len(lists) - 1, int(least / (PROBE * math.log2(len(lists[-1]) + 1) + 1))))
    short, long_ = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    enough = least - n_long
    heap = [(x[0], k, 0) for k, x in enumerate(short)]
    heapq.heapify(heap)
    out = []
    while len(heap) >= enough:
        top, popped = heap[0][0], []
        while heap and heap[0][0] == top:
            popped.append(heapq.heappop(heap))
        if len(popped) >= enough:
            count = len(popped)
            for k, x in enumerate(long_):
                if count >= need_[top] or count + len(long_) - k < need_[top]:
                    break
                at = bisect_left(x, top)
                count += at < len(x) and x[at] == top
                seen["probed"] += 1
            if count >= need_[top]:
                out.append(top)
            ahead = top + 1
        else:
            while heap and len(popped) < enough - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            ahead = heap[0][0]
        seen["popped"] += len(popped)
        for _, k, was in popped:
            at = bisect_left(short[k], ahead, was)
            seen["skipped"] += max(0, at - was - 1)
            if at < len(short[k]):
                heapq.heappush(heap, (short[k][at], k, at))
    return out


def frequent_shingles(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes sorted, rank by frequency) of the most frequent shingles of all documents: lossy counting, part by part. What comes
    twice in a part is reported, so nothing more frequent than the number of parts is missed. Only the order of lists depends on it."""

    def count(batches):
        kept, held = [], 0

        def told():
            u, c = np.unique(np.concatenate(kept), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(u[c > 1].view(np.int64)), pa.array(c[c > 1].astype(np.int64))], names=["h", "n"])

        for batch in batches:
            for _, texts in blocks(batch, 0):
                for s in shingle_sets(texts, size):
                    kept.append(s)
                    held += len(s)
                if held > COUNTED:
                    yield told()
                    kept, held = [], 0
        if kept:
            yield told()

    tables = Tables(docs.sparkSession)
    seen = tables.put(docs.select("text").mapInArrow(lean(count), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "frequent")
    # The most frequent by classes of like counts, 16 to a doubling: whole classes, and of the first that doesn't fit a share by hash.
    level = F.floor(F.log2("n") * 16).cast("int")
    left, least, share = MOST_FREQUENT, 0, 1.0
    for r in seen.groupBy(level.alias("level")).agg(F.count("*").alias("k")).orderBy(F.desc("level")).collect():
        if r["k"] > left:
            least, share = r["level"], left / r["k"]
            break
        left -= r["k"]
    unit = F.shiftrightunsigned(F.xxhash64("h"), 11) / float(1 << 53)
    rows = seen.where((level > least) | ((level == least) & (unit < share))).toPandas()
    h = rows["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], rows["n"].to_numpy(np.int64)[order]


def parts_of(s: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """In how many parts the list of each shingle is cut."""
    keys, n = frequent
    out = np.ones(len(s), np.int32)
    if len(keys) and len(s):
        at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
        out = np.where(keys[at] == s, -(-n[at] // PART), 1).astype(np.int32)
    return out


def near_duplicates(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", tables: Tables | None = None) -> DataFrame:
    """Links documents whose sets of `size`-word shingles (A-Z lower-cased) have a Jaccard similarity of LEAST / 100 or more.

    T-occurrence search: documents of equal sets form a class, classes are searched. Inverted lists over all documents hold, for each class, its
    rarest q - T + 1 shingles, so two linked classes meet in one of these short lists; members that meet are candidates, which a
    bitmap that can't refuse a linked pair thins. DivideSkip decides: over the inverted lists of a class and CHUNK of its candidates, the short
    lists are merged by a heap that skips ahead, the long ones are probed by binary search, and what reaches the required
    intersection is linked. Inverted lists longer than SHORT first pair each member with PIVOTS members, by a hash of its own for each list;
    very long ones are cut in parts whose pivots form a list in turn. After components are found, members of a long list that still lie in
    different components meet block by block in a task, which sends on what sizes, places and bitmaps don't refuse. So copies and near
    copies of one text cost one link each, and no link between components is lost.

    Shingles are told by 64 bits and sets by 128 bits of their shingles: in a corpus of 10^12 distinct shingles some 27,000 pairs share their
    64 bits, each of which moves the intersection of two documents by one at most; equal digests of different sets aren't to be expected.

    Returns one row per input row: id, n_shingles, component_id (the least id reachable by links). A text that is null or has no
    words has 0 shingles and is its own component; fewer words than `size` make one shingle of all of them. A null id is passed
    over when the least id is sought. Rows that repeat are one class. An empty table gives no rows.
    """
    need(docs, id_col, text_col)
    spark = docs.sparkSession
    tables = tables or Tables(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    frequent = spark.sparkContext.broadcast(frequent_shingles(rows, size))
    kind = rows.schema["id"].dataType.simpleString()

    def sets(batches):
        for batch in batches:
            for piece, texts in blocks(batch, 1):
                n, sig, pre, bits, cut = [], [], [], [], [np.zeros(0, np.int32)]
                for s in shingle_sets(texts, size):
                    n.append(len(s))
                    sig.append(signature(s))
                    pre.append(prefix(s, frequent.value))
                    cut.append(parts_of(pre[-1], frequent.value))
                    bits.append(parity(s))
                at = np.concatenate([[0], np.cumsum([len(x) for x in pre])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(pre).view(np.int64)) if pre else pa.array([], pa.int64()))
                parts = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(cut)))
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), lists, parts, pa.array(bits, pa.binary())], names=["id", "n", "sig", "prefix", "parts", "bits"])

    made = rows.mapInArrow(lean(sets), f"id {kind}, n long, sig binary, prefix array<long>, parts array<int>, bits binary")
    made = tables.put(made.withColumn("row", F.monotonically_increasing_id()), "sets")
    frequent.destroy()  # what is written isn't made again
    classes = tables.put(made.where("n > 0").groupBy("sig").agg(F.min("row").alias("node"), F.min("id").alias("least_id")), "classes")
    reps = made.join(classes.select("node").hint("merge"), F.col("row") == F.col("node")).select("node", "n", "sig", "bits", "prefix", "parts")
    reps = tables.put(reps, "reps")
    light = tables.put(made.select("id", "n", "sig"), "light")
    tables.drop(made)

    lists = reps.select(F.posexplode(F.arrays_zip("prefix", "parts")).alias("pos", "x"), "node", F.col("n").cast("int").alias("n")).select(F.col("x.prefix").alias("h"), "x.parts", "node", "n", "pos")
    lists = lists.withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("node"), F.col("parts"))).otherwise(0).cast("int"))
    order = lambda df: df.repartition("h", "part").withColumn("r", F.xxhash64("h", "node")).sortWithinPartitions("h", "part", "r").select("h", "part", "parts", "node", "n", "pos").mapInArrow(lean(_merge), _FOUND)
    found = tables.put(order(lists), "found")
    tables.sweep()
    again = found.where("node is not null")
    if not again.isEmpty():
        again = again.select("h", F.lit(1).alias("parts"), "node", "n", "pos", F.lit(0).alias("part"))
        found = found.unionByName(tables.put(order(again), "pivots"))
    links = _verify(rows, reps, found.where("a is not null").select("a", "b").distinct(), size, tables)
    roots = connected(links, tables)
    long_lists = found.where("long").select("h").distinct()
    if not long_lists.isEmpty():
        more = _rest(reps, roots, long_lists, tables)
        links = links.unionByName(_verify(rows, reps, more, size, tables))
        roots = connected(links, tables)
    # A component's least id, then to every row of its classes.
    rooted = classes.join(tables.put(roots, "roots"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = tables.put(rooted, "rooted")
    least = tables.put(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "least")
    named = tables.put(rooted.join(least, "root").select("sig", "component_id"), "named")
    out = light.join(named, "sig", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def keep_one(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, of each component the row with the least id (null ids last; of rows that repeat an
    id, the first). Rows are numbered once, in a written table."""
    kept, passing = Tables(docs.sparkSession), Tables(docs.sparkSession)
    packed = docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    packed = kept.put(packed, "rows")
    ident = F.col(f"_doc.`{id_col}`")
    key = F.struct(ident.isNull().alias("z"), ident.alias("d"), F.col("_row").alias("r"))
    found = near_duplicates(packed.select(key.alias("key"), F.col(f"_doc.`{text_col}`").alias("text")), size, "key", "text", passing)
    stay = kept.put(found.where("component_id.r = key.r").select(F.col("key.r").alias("_row")), "stay")
    passing.clear()
    return packed.join(stay.hint("merge"), "_row", "left_semi").select("_doc.*")


def fits(n, m, i, j):
    """Whether sets of n and m shingles, which first meet at places i and j of their order, can still share enough: their sizes are
    near, and what lies behind the meeting suffices. Works on numbers and on arrays."""
    enough = 100 * np.minimum(n, m) >= LEAST * np.maximum(n, m)
    return enough & ((100 + LEAST) * np.minimum(n - i, m - j) >= LEAST * (n + m))


_FOUND = "a long, b long, h long, long boolean, node long, n int, pos int"


def _merge(batches):
    """Streams sorted lists (h, part, parts, node, n, pos): pairs of members that could be similar by size and place; for a list longer than
    SHORT the pairs of its first members, those of all others with PIVOTS of them, and the list's key, marked as long; for a part of a list
    the key and its pivot. Holds SHORT members at most."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int32())
    names = [x.split(" ")[0] for x in _FOUND.split(", ")]
    now, held, out = None, [], []

    def pair(x, y):
        (_, n, i), (_, m, j) = x, y
        if 100 * min(n, m) >= LEAST * max(n, m) and (100 + LEAST) * min(n - i, m - j) >= LEAST * (n + m):  # as in fits()
            out.append((min(x[0], y[0]), max(x[0], y[0]), None, None, None, None, None))

    def batch():
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 7, kinds, strict=True)], names=names)
        out.clear()
        return made

    count = 0
    for b in batches:
        h, part, parts, node, n, pos = (b.column(k).to_numpy() for k in range(6))
        if not len(h):
            continue
        # Rows of lists with one member are passed over at once.
        same = (h[1:] == h[:-1]) & (part[1:] == part[:-1])
        live = parts > 1
        live[1:] |= same
        live[:-1] |= same
        live[[0, -1]] = True  # a list may go on in the next batch
        for i in np.flatnonzero(live):
            x, key = (int(node[i]), int(n[i]), int(pos[i])), (int(h[i]), int(part[i]))
            if key != now:
                now, held, count = key, [], 0
                if parts[i] > 1:
                    out.append((None, None, now[0], True, *x))
            count += 1
            if count <= SHORT:
                for y in held:
                    pair(x, y)
                held.append(x)
            else:
                for y in held[:PIVOTS]:
                    pair(x, y)
                if count == SHORT + 1:
                    out.append((None, None, now[0], True, None, None, None))
        if len(out) > 20_000:
            yield batch()
    yield batch()


def _rest(reps: DataFrame, roots: DataFrame, long_lists: DataFrame, tables: Tables) -> DataFrame:
    """Pairs of members of long lists that lie in different components and that sizes, places and bitmaps don't refuse. In each list
    the members outside its largest component (strays) meet all of the other components, BLOCK against BLOCK in a task, and only
    what passes is sent on; a list of one component, as near copies of one text form, gives none."""
    roots = tables.put(roots, "roots")
    members = reps.select(F.posexplode("prefix").alias("pos", "h"), "node", F.col("n").cast("int").alias("n")).join(tables.put(long_lists, "long").hint("merge"), "h")
    members = tables.put(members.join(roots, "node", "left").select("h", "node", "n", "pos", F.coalesce("root", "node").alias("root")), "members")
    sizes = members.groupBy("h", "root").agg(F.count("*").alias("k"))
    lists = sizes.groupBy("h").agg(F.count("*").alias("roots"), F.sum("k").alias("all"), F.max(F.struct("k", "root")).alias("main"))
    cut = lambda n: F.ceil(n / BLOCK).cast("int")
    lists = tables.put(lists.where("roots > 1").select("h", F.col("main.root").alias("main"), cut(F.col("all") - F.col("main.k")).alias("a"), cut(F.col("all")).alias("b")), "lists")
    both = members.join(lists, "h").join(reps.select("node", "bits"), "node").withColumn("r", F.xxhash64("node"))
    columns = ["h", "node", "n", "pos", "root", "bits"]
    # Strays of block x meet members of block y in cell (x, y): each goes to all cells of its row or column.
    stray = both.where("root != main").select(*columns, F.lit(0).alias("side"), F.expr("pmod(r, a)").alias("x"), F.explode(F.expr("sequence(0, b - 1)")).alias("y"))
    other = both.select(*columns, F.lit(1).alias("side"), F.explode(F.expr("sequence(0, a - 1)")).alias("x"), F.expr("pmod(r, b)").alias("y"))
    cells = stray.withColumn("y", F.col("y").cast("long")).unionByName(other.withColumn("x", F.col("x").cast("long")))
    cells = cells.repartition("h", "x", "y").sortWithinPartitions("h", "x", "y", "side").select("h", "x", "y", "side", "node", "n", "pos", "root", "bits")
    return tables.put(cells.mapInArrow(lean(_meet), "a long, b long").distinct(), "rest")


def _fold(bits: np.ndarray, width: int) -> np.ndarray:
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def meet(s: dict, t: dict) -> np.ndarray:
    """Which strays (rows) may be linked with which members (columns)."""
    n, m = s["n"][:, None].astype(np.int64), t["n"][None, :].astype(np.int64)
    ok = fits(n, m, s["pos"][:, None], t["pos"][None, :]) & (s["root"][:, None] != t["root"][None, :])
    widths = [np.array([len(x) for x in side["bits"]]) for side in (s, t)]
    for u in np.unique(widths[0]):
        for v in np.unique(widths[1]):
            i, j = np.flatnonzero(widths[0] == u), np.flatnonzero(widths[1] == v)
            if not ok[np.ix_(i, j)].any():
                continue
            w = min(u, v)
            x, y = (_fold(np.frombuffer(b"".join(side["bits"][k] for k in at), np.uint8).reshape(len(at), -1), w).view(np.uint64) for side, at in ((s, i), (t, j)))
            for k, row in zip(i, x, strict=True):
                apart = np.bitwise_count(y ^ row).sum(axis=1, dtype=np.int64)
                total = n[k, 0] + m[0, j]
                ok[k, j] &= (100 + LEAST) * (total - apart) >= 2 * LEAST * total
    return ok


def _meet(batches):
    now, rows = None, []

    def pairs():
        side = np.array([r[3] for r in rows])
        parts = []
        for k in (0, 1):
            at = [r for r, c in zip(rows, side, strict=True) if c == k]
            parts.append({"node": np.array([r[4] for r in at], np.int64), "n": np.array([r[5] for r in at], np.int64), "pos": np.array([r[6] for r in at], np.int64), "root": np.array([r[7] for r in at], np.int64), "bits": [r[8] for r in at]})
        s, t = parts
        if not len(s["node"]) or not len(t["node"]):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=["a", "b"])
        i, j = np.nonzero(meet(s, t))
        x, y = s["node"][i], t["node"][j]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    for b in batches:
        for r in zip(*(b.column(k).to_pylist() for k in range(9)), strict=True):
            if r[:3] != now:
                if rows:
                    yield pairs()
                now, rows = r[:3], []
            rows.append(r)
    if rows:
        yield pairs()


def _verify(rows: DataFrame, reps: DataFrame, pairs: DataFrame, size: int, tables: Tables) -> DataFrame:
    """Pairs (a, b) of nodes that are linked. Bitmaps thin them; then the sets of what is left are made again from the texts."""
    spark = rows.sparkSession
    maps = reps.select("node", "n", "bits", "sig")
    side = lambda k: maps.select(F.col("node").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("n", "bits", "sig")])
    both = tables.put(pairs, "pairs").join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b", "sig_a", "sig_b")

    def thin(batches):
        for b in batches:
            na, nb, x, y = (b.column(k).to_pylist() for k in range(2, 6))
            keep = [may_reach(p, q, n, m) for p, q, n, m in zip(x, y, na, nb, strict=True)]
            yield b.filter(pa.array(keep, pa.bool_())).select(["a", "b", "sig_a", "sig_b"])

    left = tables.put(both.mapInArrow(lean(thin), "a long, b long, sig_a binary, sig_b binary"), "thinned")
    wanted = left.select(F.explode(F.array("sig_a", "sig_b")).alias("sig")).distinct()
    # Which documents to send: a map of 16 slots for each that is wanted, up to a fixed size; so what a scan passes on needn't be joined with all texts.
    bits = min(MAP_BITS, max(12, 4 + int(wanted.count()).bit_length()))
    slot = F.conv(F.substring(F.hex("sig"), 1, 8), 16, 10).cast("long") % (1 << bits)
    words = wanted.select(slot.alias("k")).groupBy(F.shiftright("k", 5).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(k & 31 as int))")).alias("v")).toArrow()
    slots = np.zeros(1 << (bits - 5), np.uint32)
    slots[words.column("w").to_numpy()] = words.column("v").to_numpy().astype(np.uint32)
    sent = spark.sparkContext.broadcast(slots)

    def again(batches):
        want, seen = sent.value, set()
        for batch in batches:
            for _, texts in blocks(batch, 0):
                sig, items = [], []
                for s in shingle_sets(texts, size):
                    k = signature(s)
                    at = int.from_bytes(k[:4]) % (1 << bits)
                    if want[at >> 5] >> (at & 31) & 1 and k not in seen:
                        seen.add(k)
                        sig.append(k)
                        items.append(s.tobytes())
                if len(seen) > 200_000:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(sig, pa.binary()), pa.array(items, pa.binary())], names=["sig", "items"])

    sets = rows.select("text").mapInArrow(lean(again), "sig binary, items binary")
    sets = tables.put(sets.groupBy("sig").agg(F.first("items").alias("items")), "items")
    sent.destroy()

    # A query with its candidates, CHUNK at once, in one task: the sets of all come in rows behind the query's.
    sets = sets.select("sig", "items")
    counted = left.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    chunked = left.join(counted, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"), "b", "sig_a", "sig_b")
    chunked = tables.put(chunked, "chunks")
    asked = chunked.select("a", "chunk", F.lit(None).cast("long").alias("b"), F.col("sig_a").alias("sig")).distinct()
    given = chunked.select("a", "chunk", "b", F.col("sig_b").alias("sig"))
    full = asked.unionByName(given).join(sets.hint("merge"), "sig").select("a", "chunk", "b", "items")

    def search(batches):
        now, query, nodes, found = None, None, [], []

        def told():
            at = divide_skip(query, found) if nodes else []
            return pa.RecordBatch.from_arrays([pa.array([now[0]] * len(at), pa.int64()), pa.array([nodes[k] for k in at], pa.int64())], names=["a", "b"])

        for batch in batches:
            for i in range(batch.num_rows):
                key, node = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py()), batch.column(2)[i].as_py()
                items = np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64).copy()
                if key != now:
                    if now:
                        yield told()
                    now, nodes, found = key, [], []
                if node is None:
                    query = items
                else:
                    nodes.append(node)
                    found.append(items)
        if now:
            yield told()

    ordered = full.repartition("a", "chunk").sortWithinPartitions("a", "chunk", F.col("b").asc_nulls_first())
    out = tables.put(ordered.mapInArrow(lean(search), "a long, b long"), "links")
    tables.sweep()
    return out
