"""Chat formatting: a hidden Markov model recovers the roles of transcript lines, then turns are rendered canonically."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WORD, Tables, lean, need
from .sharding import number_rows

ROLES = ("user", "assistant", "system")
#: Speaker markers at the start of a line, by role.
MARKERS = {
    "user": ("user", "human", "customer", "client", "q", "question", "me", "you", "prompt", "instruction"),
    "assistant": ("assistant", "ai", "bot", "agent", "model", "a", "answer", "response", "support"),
    "system": ("system", "context", "note"),
}
_BY_MARKER = {m: r for r, ms in MARKERS.items() for m in ms}
MARKER = re.compile(r"^\s*(?:<\|(\w+)\|>|\[(\w+)\]|\*{0,2}#{0,3}\s*(\w+)\s*\*{0,2}\s*[:>]) ?")
#: A state is a role that begins a turn at this line or goes on with one.
STATES = tuple((r, new) for r in range(len(ROLES)) for new in (True, False))
FEATURES = ("question", "short", "long", "very_long", "list", "code", "blank_before", *(f"words_of_{r}" for r in ROLES))
#: How often a marker tells the truth, and how often one stands where no turn begins: not to be learned from rows that have a role.
TRUE, STRAY = 0.97, 0.005
#: Rows of a conversation that are parsed in one piece; pieces of one conversation give what the whole would.
PAGE = 500
#: Words by which a line votes for a role: the most telling of about so many rows with a role; and in how many of these a word has to be.
TELLING, SAMPLE, SEEN = 200, 200_000, 8


def read_marker(line: str) -> tuple[str | None, str]:
    """The role that a speaker marker at the start of the line names, and the line without it."""
    m = MARKER.match(line)
    if m:
        role = _BY_MARKER.get(next(g for g in m.groups() if g).lower())
        if role:
            return role, line[m.end() :]
    return None, line


def vote(line: str, words: dict[str, list[float]]) -> int | None:
    """The role that the telling words of a line speak for, if it has any. How far that is to be trusted is for the counts to say."""
    told = [words[w] for w in set(line.lower().split()) if w in words] if words else ()
    return int(np.argmax(np.sum(told, axis=0))) if told else None


def features(line: str, blank_before: bool, words: dict[str, list[float]] | None = None) -> list[bool]:
    s = line.strip()
    role = vote(s, words or {})
    return [
        s.endswith("?"), len(s) < 80, len(s) > 160, len(s) > 320, bool(re.match(r"(?:[-*•]|\d+[.)])\s", s)), line.startswith("    ") or s.startswith(("```", "def ", "import ", "{", "}")) or s.endswith(";"), blank_before,
        *(role == k for k in range(len(ROLES))),
    ]


def _log(x) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(x)


@dataclass
class Chances:
    """Counts that the model learns from, one added to each: roles that begin conversations, roles that follow roles, lines that begin turns and others, turns with
    and without a marker, lines with each feature by state (role, new); and words with what each says for each role. Without any, all is as likely."""

    first: np.ndarray = field(default_factory=lambda: np.zeros(len(ROLES)))
    follows: np.ndarray = field(default_factory=lambda: np.zeros((len(ROLES), len(ROLES))))
    lines: np.ndarray = field(default_factory=lambda: np.zeros(len(STATES)))
    seen: np.ndarray = field(default_factory=lambda: np.zeros((len(STATES), len(FEATURES))))
    marked: np.ndarray = field(default_factory=lambda: np.zeros(2))
    words: dict[str, list[float]] = field(default_factory=dict)

    def __post_init__(self):
        first, follows = self.first + 1, self.follows + 1
        new = np.array([x for _, x in STATES])
        role = np.array([r for r, _ in STATES])
        # How likely a turn goes on at its next line depends on whose it is.
        goes_on = np.array([(self.lines[(role == r) & ~new].sum() + 1) / (self.lines[role == r].sum() + 2) for r in range(len(ROLES))])[role][:, None]
        self.start = np.where(new, _log(first / first.sum())[role], -np.inf)
        follows = follows / follows.sum(axis=1, keepdims=True)
        self.move = np.where(new[None, :], _log((1 - goes_on) * follows[np.ix_(role, role)]), np.where(role[:, None] == role[None, :], _log(goes_on), -np.inf))
        on = (self.seen + 1) / (self.lines[:, None] + 2)
        self.on, self.off = _log(on), _log(1 - on)
        marked = (self.marked[1] + 1) / (self.marked.sum() + 2)
        told = np.array([[TRUE if r == k else (1 - TRUE) / (len(ROLES) - 1) for k in range(len(ROLES))] for r in role])
        self.unmarked = np.where(new, _log(1 - marked), _log(1 - STRAY))
        self.told = np.where(new[:, None], _log(marked * told), _log(STRAY / len(ROLES)))

    def emissions(self, lines: list[tuple[int, str, bool]]) -> np.ndarray:
        """Log chances of lines (number, line, whether blank lines stand before it), one row each, in each state."""
        read = [read_marker(line) for _, line, _ in lines]
        has = np.array([features(rest, blank, self.words) for (_, rest), (_, _, blank) in zip(read, lines, strict=True)], float)
        by_role = np.vstack([self.told.T, self.unmarked])
        return by_role[[len(ROLES) if role is None else ROLES.index(role) for role, _ in read]] + has @ (self.on - self.off).T + self.off.sum(axis=1)


#: What is assumed of transcripts where no rows with roles are at hand: counts of an invented hundred turns.
ASSUMED = Chances(
    np.array([65.0, 10.0, 25.0]), np.array([[6.0, 92.0, 2.0], [92.0, 6.0, 2.0], [90.0, 8.0, 2.0]]), np.array([100.0, 40.0, 100.0, 200.0, 10.0, 12.0]),
    np.array([[50, 85, 5, 1, 3, 4, 90, 0, 0, 0], [10, 28, 4, 1, 4, 8, 6, 0, 0, 0], [5, 18, 40, 12, 20, 8, 90, 0, 0, 0], [16, 80, 60, 20, 70, 40, 24, 0, 0, 0], [0, 3, 3, 1, 1, 0, 7, 0, 0, 0], [2, 4, 3, 1, 4, 2, 1, 0, 0, 0]], float), np.array([55.0, 45.0]),
)


def viterbi(emissions: np.ndarray, chances: Chances, entry: int | None = None, end: int | None = None) -> list[int]:
    """The likeliest run of states; ties go to the first state. `entry`: the state before the first line (none: a conversation begins here);
    `end`: the state of the last line (none: the likeliest)."""
    best, back = (chances.start if entry is None else chances.move[entry]) + emissions[0], []
    for e in emissions[1:]:
        every = best[:, None] + chances.move
        back.append(np.argmax(every, axis=0))
        best = every[back[-1], np.arange(len(best))] + e
    path = [int(np.argmax(best)) if end is None else end]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def across(emissions: np.ndarray, chances: Chances) -> tuple[np.ndarray, np.ndarray]:
    """What a piece does to the scores of states: (scores at its end if a conversation begins with it; from each state before it to each at its end)."""
    both = np.vstack([chances.start[None, :], chances.move]) + emissions[0]
    for e in emissions[1:]:
        both = (both[:, :, None] + chances.move[None, :, :]).max(axis=1) + e
    return both[0], both[1:]


class Joined:
    """The states at the ends of a conversation's pieces, which come one after the other, on the likeliest way through all of them. Of each piece six small numbers are kept."""

    def __init__(self):
        self.scores, self.back, self.ids = None, [], []

    def add(self, ident, begins: np.ndarray, moves: np.ndarray) -> None:
        every = None if self.scores is None else self.scores[:, None] + moves
        self.back.append(None if every is None else every.argmax(axis=0).astype(np.uint8).tobytes())
        self.scores = begins if every is None else every.max(axis=0)
        self.ids.append(ident)

    def ends(self) -> list[tuple]:
        """(id, the state before the piece, the one at its end), in order."""
        out, end = [], int(np.argmax(self.scores))
        for k in range(len(self.ids) - 1, -1, -1):
            entry = None if self.back[k] is None else self.back[k][end]
            out.append((self.ids[k], entry, end))
            end = entry
        return out[::-1]


def joined(pieces: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int | None, int]]:
    """For each piece of a conversation, in order, the state before it and at its end on the likeliest way through all of them."""
    whole = Joined()
    for k, (begins, moves) in enumerate(pieces):
        whole.add(k, begins, moves)
    return [x[1:] for x in whole.ends()]


def solid(text: str, after_blank: bool = False) -> list[tuple[int, str, bool]]:
    """(number, line, whether blank lines stand before it) of each line that isn't blank."""
    out, blank = [], after_blank
    for i, line in enumerate(text.split("\n")):
        if line.strip():
            out.append((i, line, blank))
            blank = False
        else:
            blank = True
    return out


def turns_of(text: str, states: dict[int, int]) -> list[tuple[str, str, bool]]:
    """(role, text, whether it begins here) by the states of lines. Lines keep their order and their indentation; markers go, and blank lines at the ends of turns."""
    out: list[tuple[str, list[str], bool]] = []
    for i, line in enumerate(text.split("\n")):
        if i in states:
            r, new = STATES[states[i]]
            if new or not out:
                out.append((ROLES[r], [read_marker(line)[1] if new else line], new))
                continue
        if out:
            out[-1][1].append(line)
    return [(r, "\n".join(x.rstrip() for x in lines).strip("\n"), new) for r, lines, new in out]


def parse(text: str, chances: Chances = ASSUMED) -> list[tuple[str, str]]:
    """Turns (role, text) of a transcript."""
    lines = solid(text)
    if not lines:
        return []
    path = viterbi(chances.emissions(lines), chances)
    return [(r, t) for r, t, _ in turns_of(text, {i: s for (i, _, _), s in zip(lines, path, strict=True)})]


def render(turns: list[tuple[str, str]]) -> str:
    """Canonical form, a turn after the other: <|role|>, a line break, the text, <|end|>. Neighbouring turns of one role are joined.
    Backslashes and <| inside a text are escaped, so the form can be read back."""
    out: list[list[str]] = []
    for role, text in turns:
        text = text.replace("\\", "\\\\").replace("<|", "<\\|")
        if out and out[-1][0] == role:
            out[-1][1] += "\n" + text
        else:
            out.append([role, text])
    return "\n".join(f"<|{r}|>\n{t}\n<|end|>" for r, t in out)


def read_back(canonical: str) -> list[tuple[str, str]]:
    found = re.findall(r"<\|(\w+)\|>\n(.*?)\n<\|end\|>", canonical, re.S)
    return [(r, re.sub(r"\\([\\|])", r"\1", t)) for r, t in found]


def pages(conversations: DataFrame, tables: Tables, page: int = PAGE, truth_col: str | None = None) -> DataFrame:
    """Pieces (conv_id, block, part, rows) of up to `page` rows of a conversation, from rows (conv_id, turn, role, text). Rows stand in the order of turn (null ones last), role and a
    hash of the text; rows that repeat keep apart. A block is a run of `page` turn numbers. One that holds more rows, as of turns that repeat or have no number, is
    cut in parts by numbering its rows; so a group is bounded, whatever a conversation holds. A row with a role is marked with it."""
    need(conversations, "conv_id", "turn", "role", "text", *([truth_col] if truth_col else []))
    lower = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    rows = conversations.select("conv_id", "turn", lower("role").alias("role"), (lower(truth_col) if truth_col else F.lit(None).cast("string")).alias("truth"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumns({"block": F.floor(F.col("turn") / page).cast("long"), "tie": F.xxhash64("text"), "part": F.lit(0).cast("long"), "at": F.lit(0).cast("long")})
    full = rows.groupBy("conv_id", "block").agg(F.count("*").alias("k")).where(F.col("k") > page).select(F.col("conv_id").alias("fc"), F.col("block").alias("fb"))
    full = tables.put(full, "full")
    if not full.isEmpty():
        scratch, within = Tables(conversations.sparkSession), F.expr("conv_id <=> fc and block <=> fb")
        crowded = scratch.put(rows.join(full, within, "left_semi").withColumn("at", F.monotonically_increasing_id()), "crowded")
        numbered, _ = number_rows(crowded.select("conv_id", "turn", "role", "tie", "at"), ["conv_id", "turn", "role", "tie", "at"], scratch)
        parts = numbered.select("at", F.floor(F.col("n") / page).cast("long").alias("part"))
        rows = rows.join(full, within, "left_anti").unionByName(crowded.drop("part").join(parts, "at"))
    # Nulls come last in each of the keys.
    key = [x for c in ("turn", "role") for x in (F.col(c).isNull().alias(f"{c}_null"), F.col(c))]
    held = F.array_sort(F.collect_list(F.struct(*key, "tie", "at", "text", "truth")))
    made = rows.groupBy("conv_id", "block", "part").agg(F.transform(held, lambda x: F.struct(x["text"].alias("line"), x["role"].alias("role"), x["truth"].alias("truth"))).alias("rows"))
    return tables.put(made, "pages")


def page_text(rows: list[dict]) -> str:
    """Rows one after the other, a blank line between them; one with a role has its marker before its first line that isn't blank."""
    out = []
    for r in rows:
        lines = r["line"].split("\n")
        first = next((k for k, x in enumerate(lines) if x.strip()), None)
        if r["role"] in ROLES and first is not None:
            lines[first] = f"{r['role'].capitalize()}: {lines[first]}"
        out.append("\n".join(lines))
    return "\n\n".join(out)


def telling_words(conversations: DataFrame, most: int = TELLING, sample: int = SAMPLE) -> dict[str, list[float]]:
    """The words that tell most of a row's role, by mutual information of role and word, and the log chance of each in rows of each role; over about `sample` rows with a role that a
    hash picks. So sample and words are bounded."""
    rows = conversations.select(F.lower(F.trim(F.col("role").cast("string"))).alias("role"), F.col("text").cast("string").alias("text"), F.xxhash64("conv_id", "turn").alias("h")).where(F.col("role").isin(*ROLES))
    n = rows.count()
    if n > sample:
        rows = rows.where(F.shiftrightunsigned("h", 11) / float(1 << 53) < sample / n)
    words = rows.select("role", F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"({WORD})"), F.lit(1))).alias("w"))
    sizes = {r["role"]: r["n"] for r in rows.groupBy("role").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values()) or 1
    counts = words.select("role", F.explode("w").alias("w")).groupBy("w").agg(F.count("*").alias("n"), *[F.count_if(F.col("role") == r).alias(r) for r in ROLES])
    gain = F.lit(0.0)
    for r in ROLES:
        for n, own in ((F.col("n"), F.col(r)), (total - F.col("n"), sizes.get(r, 0) - F.col(r))):
            gain = gain + F.when((own > 0) & (n > 0), own / total * F.log(own * total / (n * max(1, sizes.get(r, 0))))).otherwise(0.0)
    top = counts.where(F.col("n") >= SEEN).select("w", *ROLES, gain.alias("gain")).orderBy(F.desc("gain"), "w").limit(most).collect()
    return {r["w"]: [float(np.log((r[k] + 0.5) / (sizes.get(k, 0) + 1))) for k in ROLES] for r in top}


def learn_chances(made: DataFrame, words: dict[str, list[float]] | None = None) -> Chances:
    """Counts over all rows of pages that have a role: who begins, who follows whom, how lines look. Pages tell their own sums and their first and last roles;
    where pages of a conversation meet, a window over pages has the one before."""
    n_f, n_s, n_r = len(FEATURES), len(STATES), len(ROLES)
    kind = made.schema["conv_id"].dataType.simpleString()

    def count(batches):
        sums = np.zeros(n_s + n_s * n_f + 2 + n_r * n_r)
        for b in batches:
            ends = []
            for rows in b.column(3).to_pylist():
                roles = [ROLES.index(r["role"]) if r["role"] in ROLES else None for r in rows]
                ends.append((roles[0], roles[-1]))
                for x, y in zip(roles, roles[1:]):
                    if x is not None and y is not None:
                        sums[n_s + n_s * n_f + 2 + x * n_r + y] += 1
                for role, r in zip(roles, rows, strict=True):
                    sums[n_s + n_s * n_f + int(role is not None)] += 1
                    for k, (_, line, blank) in enumerate(solid(r["line"], True)) if role is not None else ():
                        s = STATES.index((role, k == 0))
                        sums[s] += 1
                        sums[n_s + s * n_f : n_s + (s + 1) * n_f] += features(line, blank, words)
            none = pa.nulls(len(ends), pa.list_(pa.float64()))
            first, last = (pa.array([e[k] for e in ends], pa.int32()) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), first, last, none], names=["conv_id", "block", "part", "first", "last", "sums"])
            kind_of = b.schema
        if sums.any():
            empty = [pa.nulls(1, kind_of.field(k).type) for k in range(3)] + [pa.nulls(1, pa.int32())] * 2
            yield pa.RecordBatch.from_arrays([*empty, pa.array([sums.tolist()], pa.list_(pa.float64()))], names=["conv_id", "block", "part", "first", "last", "sums"])

    told = Tables(made.sparkSession).put(made.select("conv_id", "block", "part", "rows").mapInArrow(lean(count), f"conv_id {kind}, block long, part long, first int, last int, sums array<double>"), "told")
    flat = np.zeros(n_s + n_s * n_f + 2 + n_r * n_r)
    for r in told.where("sums is not null").select(F.posexplode("sums").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect():
        flat[r["k"]] = r["x"]
    w = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_last(), "part")
    met = told.where("sums is null").select("first", F.lag("last").over(w).alias("before"), F.row_number().over(w).alias("nth"))
    first, follows = np.zeros(n_r), flat[-n_r * n_r :].reshape(n_r, n_r).copy()
    for r in met.where("first is not null").groupBy("first", "before", (F.col("nth") == 1).alias("begins")).agg(F.count("*").alias("k")).collect():
        if r["begins"]:
            first[r["first"]] += r["k"]
        elif r["before"] is not None:
            follows[r["before"], r["first"]] += r["k"]
    return Chances(first, follows, flat[:n_s], flat[n_s : n_s * (1 + n_f)].reshape(n_s, -1), flat[n_s * (1 + n_f) : n_s * (1 + n_f) + 2], words or {})


def format_conversations(conversations: DataFrame, page: int = PAGE, truth_col: str | None = None) -> DataFrame:
    """Transcripts of conversations, parsed and rendered page by page.

    The chances of the hidden Markov model are counted over all rows with a role. Observations are a line's speaker marker and features
    (question, length, list, code, blank line before, and votes of words that tell roles apart in a bounded sample of rows with a role); states are a role and whether a turn begins. Each page
    tells how it moves the scores of states, a fold over a conversation's pages finds the states at their ends on the likeliest way through the whole (it keeps six
    small numbers a page), and each page is then decoded between them: the result is that of one Viterbi pass over the conversation.

    Returns one row per page: conv_id, page (from 0), n_turns, continued (the first turn goes on from the page before), n_rows, n_told (rows with a role), n_lines and n_right (lines of rows
    whose role is in `truth_col`, and those of them whose role is found; 0 without), roles (comma-joined), canonical. Roles beyond user, assistant and system count as null: the model has to
    find them, and `truth_col` is never looked at for it. Null and blank texts give no turns, a conversation of such rows a page without turns; null conversations are one, null
    turns stand last. Ties go to the first state. Other columns are ignored; an empty table gives no rows.
    """
    tables = Tables(conversations.sparkSession)
    made = pages(conversations, tables, page, truth_col)
    kind = made.schema["conv_id"].dataType.simpleString()
    sent = conversations.sparkSession.sparkContext.broadcast(learn_chances(made, telling_words(conversations)))

    def score(batches):
        for b in batches:
            begins, moves = [], []
            for rows in b.column(3).to_pylist():
                lines = solid(page_text(rows), True)
                v, m = across(sent.value.emissions(lines), sent.value) if lines else (None, None)
                begins.append(None if v is None else v.tolist())
                moves.append(None if m is None else m.ravel().tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(begins, pa.list_(pa.float64())), pa.array(moves, pa.list_(pa.float64()))], names=["conv_id", "block", "part", "begins", "moves"])

    # Only conversations of several pages have to be joined; what has one page is decoded by itself.
    several = made.groupBy("conv_id").agg(F.count("*").alias("k")).where("k > 1").select(F.col("conv_id").alias("sc"))
    several = tables.put(several, "several")
    within = F.expr("conv_id <=> sc")
    none = F.lit(None).cast("int")
    one_page = several.isEmpty()
    alone = made if one_page else made.join(several, within, "left_anti")
    alone = alone.select("conv_id", F.lit(0).cast("long").alias("place"), "rows", none.alias("entry"), none.alias("last"))
    n = len(STATES)

    def fold(batches):
        """Pages sorted by conversation and place."""
        now, held, kind_ = None, None, None

        def told():
            ids, entry, end = zip(*held.ends(), strict=True)
            columns = [pa.array([now] * len(ids), kind_), *(pa.array([i[k] for i in ids], pa.int64()) for k in range(3)), pa.array(entry, pa.int32()), pa.array(end, pa.int32())]
            return pa.RecordBatch.from_arrays(columns, names=["c", "b", "p", "place", "entry", "last"])

        for b in batches:
            kind_ = b.column(0).type
            for conv, block, part, place, begins, moves in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held is not None and conv != now:
                    yield told()
                    held = None
                if held is None:
                    now, held = conv, Joined()
                held.add((block, part, place), np.array(begins), np.array(moves).reshape(n, n))
        if held is not None:
            yield told()

    def long_ones() -> DataFrame:
        pages_ = made.join(several, within, "left_semi")
        scored = tables.put(pages_.select("conv_id", "block", "part", "rows").mapInArrow(lean(score), f"conv_id {kind}, block long, part long, begins array<double>, moves array<double>"), "scored")
        w = Window.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_last(), "part")
        placed = tables.put(scored.withColumn("place", F.row_number().over(w).cast("long") - 1), "placed")
        tables.drop(scored)
        ordered = placed.where("begins is not null").repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "block", "part", "place", "begins", "moves")
        ends = tables.put(ordered.mapInArrow(lean(fold), f"c {kind}, b long, p long, place long, entry int, last int"), "ends").drop("place")
        marks = placed.select(F.col("conv_id").alias("pc"), F.col("block").alias("pb"), F.col("part").alias("pp"), "place").join(ends, F.expr("pc <=> c and pb <=> b and pp = p"), "left")
        marks = tables.put(marks.select("pc", "pb", "pp", "place", "entry", "last"), "marks")
        return pages_.join(marks, F.expr("conv_id <=> pc and block <=> pb and part = pp")).select("conv_id", "place", "rows", "entry", "last")

    def decode(batches):
        for b in batches:
            out = []
            for rows, entry, last in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                text = page_text(rows)
                lines, turns, found = solid(text, True), [], []
                if lines:
                    found = viterbi(sent.value.emissions(lines), sent.value, entry, last)
                    turns = turns_of(text, {i: s for (i, _, _), s in zip(lines, found, strict=True)})
                truth = [r["truth"] for r in rows for _ in solid(r["line"])]
                known = [(t, ROLES[STATES[s][0]]) for t, s in zip(truth, found, strict=True) if t in ROLES]
                shown = [(r, t) for r, t, _ in turns]
                told = sum(r["role"] in ROLES for r in rows)
                out.append((len(turns), bool(turns) and not turns[0][2], len(rows), told, len(known), sum(x == y for x, y in known), ",".join(r for r, _ in shown), render(shown)))
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = [pa.array(x, k) for x, k in zip(list(zip(*out, strict=True)) or [()] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["conv_id", "page", "n_turns", "continued", "n_rows", "n_told", "n_lines", "n_right", "roles", "canonical"])

    every = alone if one_page else alone.unionByName(long_ones())
    return every.mapInArrow(lean(decode), f"conv_id {kind}, page long, n_turns long, continued boolean, n_rows long, n_told long, n_lines long, n_right long, roles string, canonical string")


def format_chats(texts: DataFrame, id_col: str = "conv_id", text_col: str = "text", chances: Chances = ASSUMED) -> DataFrame:
    """Parses and renders transcripts that are one text each, with the chances given.

    Returns one row per input row: id, n_turns, roles (comma-joined), canonical. A null or blank text gives no turns and an
    empty form; rows that repeat are parsed each by itself; other columns are ignored; an empty table gives no rows. Nothing is shuffled; a text is read line by
    line with six states a line.
    """
    need(texts, id_col, text_col)
    kind = texts.schema[id_col].dataType.simpleString()

    def run(batches):
        for b in batches:
            turns = [parse(t or "", chances) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in turns], pa.int64()), pa.array([",".join(r for r, _ in x) for x in turns], pa.string()), pa.array([render(x) for x in turns], pa.string())], names=["id", "n_turns", "roles", "canonical"])

    out = texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(run), f"id {kind}, n_turns long, roles string, canonical string")
    return out.withColumnRenamed("id", id_col)
