"""Language identification by words first, backing off to character n-grams."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables, blocks, grams, lean, mix, need

#: Bound of the sample that the model learns from: about so many texts of each language, by hash. Nothing else is bounded.
SAMPLE_TEXTS = 1500
LONGEST_GRAM = 5
UNKNOWN = "und"
#: A word is a letter with the letters and marks behind it; whatever is neither separates.
_BETWEEN, _BEFORE = r"[^\p{L}\p{M}]+", r"^\p{M}+"
_ODD = np.uint64(0xD1342543DE82EF95)


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words in lower case, the number of the word at each place, the number of the text at each place)."""
    low = pc.utf8_trim_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), _BETWEEN, " "))
    lists = pc.split_pattern(low, " ")
    flat = lists.flatten().dictionary_encode()
    words = pc.replace_substring_regex(flat.dictionary, _BEFORE, "")
    count = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    code, doc = flat.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(texts)), count)
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)[code] if len(words) else np.zeros(0, bool)
    return words, code[real], doc[real]


class Spelling:
    """Hashes of words and of their n-grams, from code points; a word stands between two marks of its ends."""

    def __init__(self, words: pa.Array):
        self.size = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64) + 2
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        points = np.frombuffer("".join(f"<{w}>" for w in words.to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.h = mix(points.astype(np.uint64) * _ODD + _ODD)
        self.word = np.repeat(np.arange(len(words)), self.size)

    def words(self) -> np.ndarray:
        if not len(self.size):
            return self.h
        powers = np.cumprod(np.full(int(self.size.max()), _ODD))
        return mix(np.add.reduceat(self.h * powers[np.arange(len(self.h)) - self.at[self.word]], self.at[:-1]))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of each n-gram, number of its word). A single character is no mark of an end."""
        g = grams(self.h, n)
        i = np.arange(len(g))
        ok = i + n <= self.at[self.word[i] + 1]
        if n == 1:
            ok &= (i > self.at[self.word[i]]) & (i + 1 < self.at[self.word[i] + 1])
        return g[ok], self.word[i[ok]]


class Model:
    """Log frequencies per language of words (length 0) and of n-grams, each as sorted hashes with a row of scores. The chance that two
    entries share 64 bits is left aside."""

    def __init__(self, langs: list[str], words: pa.Array, lang: np.ndarray, n: np.ndarray):
        """Learns from rows (word, number of its language in `langs`, count)."""
        self.langs = langs
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []
        for length in range(LONGEST_GRAM + 1):
            keys, counts = np.zeros(0, np.uint64), np.zeros((0, len(langs)))
            for lo in range(0, len(words), 1 << 16):
                spelled = Spelling(words.slice(lo, 1 << 16))
                h, of = spelled.grams(length) if length else (spelled.words(), np.arange(len(spelled.size)))
                some, at = np.unique(h, return_inverse=True)
                more = np.stack([np.bincount(at, weights=n[lo + of] * (lang[lo + of] == k), minlength=len(some)) for k in range(len(langs))], axis=1)
                keys, at = np.unique(np.concatenate([keys, some]), return_inverse=True)
                counts = np.stack([np.bincount(at, weights=c, minlength=len(keys)) for c in np.concatenate([counts, more]).T], axis=1)
            # Add-half smoothing: a language that lacks the entry keeps half a count.
            self.tables.append((keys, np.log((counts + 0.5) / (counts.sum(axis=0) + 0.5 * len(keys))).astype(np.float32)))

    @staticmethod
    def _find(table, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, scores = table
        at = np.searchsorted(keys, h)
        seen = at < len(keys)
        seen[seen] = keys[at[seen]] == h[seen]
        return seen, scores[at[seen]]

    def score(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(centred scores of each word, whether anything in it was seen). Known words score by themselves, others by the mean of their
        longest n-grams that were seen, so that a long unseen word weighs like a known one."""
        out, known = np.zeros((len(words), len(self.langs)), np.float32), np.zeros(len(words), bool)
        spelled = Spelling(words)
        seen, found = self._find(self.tables[0], spelled.words())
        out[seen], known[seen] = found, True
        for length in range(LONGEST_GRAM, 0, -1):
            left = np.flatnonzero(~known)
            if not len(left):
                break
            some = Spelling(words.take(pa.array(left)))
            h, of = some.grams(length)
            seen, found = self._find(self.tables[length], h)
            n = np.bincount(of[seen], minlength=len(left))
            total = np.stack([np.bincount(of[seen], weights=found[:, k], minlength=len(left)) for k in range(len(self.langs))], axis=1)
            hit = n > 0
            out[left[hit]], known[left[hit]] = total[hit] / n[hit, None], True
        return out - out.mean(axis=1, keepdims=True), known

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(number of the language of each text, -1 for none; score)."""
        best, score = np.full(len(texts), -1), np.zeros(len(texts))
        words, code, doc = words_of(texts)
        if not self.langs or not len(code):
            return best, score
        by, known = self.score(words)
        weight = np.bincount(doc, weights=known[code], minlength=len(texts))
        total = np.stack([np.bincount(doc, weights=by[code, k], minlength=len(texts)) for k in range(len(self.langs))], axis=1)
        lettered = np.bincount(doc, minlength=len(texts)) > 0
        first = np.argmax(total, axis=1)
        # Words of a text aren't independent: evidence grows with the root of their number.
        apart = (total - total.max(axis=1, keepdims=True)) / np.sqrt(np.maximum(weight, 1))[:, None]
        best[lettered] = first[lettered]
        score[lettered] = (1 / np.exp(apart).sum(axis=1))[lettered]
        return best, score


def learn(docs: DataFrame, sample_texts: int = SAMPLE_TEXTS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits the model on text and lang of rows that aren't held out and have a lang, a sample by hash of about `sample_texts` a
    language. All words of the sample, counted in Spark, and all their n-grams enter. Repeated rows count as often as they are drawn;
    a language of few rows enters with all of them; no labelled row, or an empty table, gives a model without languages."""
    need(docs, id_col, text_col, lang_col)
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.count("*")).collect()}
    langs = sorted(counts)
    if not counts:
        return Model([], pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample_texts / n))])
    unit = F.shiftrightunsigned(F.xxhash64(F.lit(17), "id"), 11) / float(1 << 53)
    sample = rows.where(unit < share[F.col("lang")]).select("lang", "text")

    def count(batches):
        for batch in batches:
            for piece, texts in blocks(batch, 1):
                words, code, doc = words_of(texts)
                lang = piece.column(0).dictionary_encode()
                of = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc]
                keys, n = np.unique(of * max(1, len(words)) + code, return_counts=True)
                of, code = np.divmod(keys, max(1, len(words)))
                yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(of)), words.take(pa.array(code)), pa.array(n.astype(np.int64))], names=["lang", "word", "n"])

    words = sample.mapInArrow(lean(count), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    got = Tables(spark).put(words, "words").toArrow().combine_chunks()
    number = {x: k for k, x in enumerate(langs)}
    word = pa.concat_arrays([pa.array([], pa.string()), *got.column("word").cast(pa.string()).chunks])
    return Model(langs, word, np.array([number[x] for x in got.column("lang").to_pylist()], np.int64), got.column("n").to_numpy().astype(float))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Predicts the language of every whole text from the text alone.

    A known word adds its log frequency in each language; an unseen one the mean over its longest n-grams that the
    model knows. `score` is the posterior of the best language with evidence tempered by the root of the number of
    words. Returns one row per document: id, lang_pred, score; a null or empty text, one without letters, and any text if the
    model has no language get `und` with score 0. A text of letters that the model has never seen gets the first language with
    an even score. Ties go to the first language; rows that repeat are judged each by itself; other columns are ignored; an empty table
    gives no rows. Nothing is shuffled; the model, bounded by its sample, is broadcast.
    """
    need(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches):
        names = pa.array([*sent.value.langs, UNKNOWN], pa.string())
        for batch in batches:
            for piece, texts in blocks(batch, 1):
                best, score = sent.value.predict(texts)
                yield pa.RecordBatch.from_arrays([piece.column(0), names.take(pa.array(np.where(best < 0, len(names) - 1, best))), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lean(scan), f"id {kind}, lang_pred string, score double")
    return out.withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, whose language is told with a score of `least` or more. Rejected are
    null texts, texts without letters and those between languages. Rows that repeat are judged each by itself, ids aren't looked at;
    with a model without languages, or an empty table, nothing stays. The test runs beside the row, so nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def sure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def judged(batches):
            for batch in batches:
                out = [np.zeros(0, bool)]
                for _, texts in blocks(pa.record_batch([batch], names=["t"]), 0):
                    best, score = sent.value.predict(texts)
                    out.append((best >= 0) & (score >= least))
                yield pa.array(np.concatenate(out))

        yield from lean(judged)(batches)

    return docs.where(sure(F.col(text_col).cast("string")))
