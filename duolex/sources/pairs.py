"""Sentence pairs: requests read as JSON, stand-ins from the driver's tables, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import language_code, visible
from ..options import METHODS, SHARES, SPANS, STRATEGIES, Repair

PAIR_SCHEMA = "pair_id string, idx int, source_language string, target_language string, source string, target string"
REPAIR_SCHEMA = "struct<enabled: boolean, strategy: string, max_position_distance: double, min_similarity: double, min_confidence: double, max_source_span: int, max_target_span: int, min_score_gain: double, min_span_coverage: double>"
REQUEST_SCHEMA = f"source_language string, target_language string, method string, repair {REPAIR_SCHEMA}, sentence_pairs array<struct<id: string, source: string, target: string>>"
#: The fields of a request and of a pair, the numbers of pairs a request may have.
REQUEST_FIELDS, PAIR_FIELDS, PAIRS = ("source_language", "target_language", "method", "repair", "sentence_pairs"), ("id", "source", "target"), (1, 100)
MONTHS = ("Jan", "February", "Mar", "Apr", "May", "June", "Jul", "Aug.", "Sept", "October", "Nov", "Dec")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Requests as JSON lines, one row per sentence pair; pair_id is unique and the same at each read: file, digest of the line, which of
    equal lines, place. A request that breaks a rule as a whole has its name in `request_errors`; one without pairs keeps a row, so that its errors are told."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.substring(F.sha2("value", 256), 1, 16).alias("line"), F.monotonically_increasing_id().alias("at"))
    lines = lines.withColumn("copy", F.row_number().over(Window.partitionBy("file", "line").orderBy("at")) - 1)
    raw = lines.withColumns({"r": F.from_json("value", REQUEST_SCHEMA), "whole": F.from_json("value", "sentence_pairs array<string>")})
    known = lambda keys, names: F.size(F.array_except(F.coalesce(keys, F.array()), F.array(*map(F.lit, names)))) == 0
    rules = {
        "json": F.json_object_keys("value").isNotNull(),
        "fields": known(F.json_object_keys("value"), REQUEST_FIELDS) & F.forall(F.coalesce("whole.sentence_pairs", F.array()), lambda p: known(F.json_object_keys(p), PAIR_FIELDS))
        & known(F.json_object_keys(F.get_json_object("value", "$.repair")), Repair.__dataclass_fields__),
        "sentence_pairs": F.coalesce(F.size("r.sentence_pairs"), F.lit(0)).between(*PAIRS),
        "repair": valid_repair(F.col("r.repair")),
    }
    raw = raw.withColumn("request_errors", broken(rules))
    pairs = raw.select("file", "line", "copy", "request_errors", "r.source_language", "r.target_language", F.coalesce("r.method", F.lit("itermax")).alias("method"), "r.repair", F.posexplode_outer("r.sentence_pairs").alias("idx", "p"))
    request = F.concat_ws(":", F.element_at(F.split("file", "/"), -1), "line", "copy")
    return pairs.select(F.concat_ws(":", request, "idx").alias("pair_id"), request.alias("request_id"), "idx", "source_language", "target_language", "p.source", "p.target", "method", F.col("p.id").alias("id"), "repair", "request_errors")


def broken(rules: dict[str, Column]) -> Column:
    """The names of the rules that don't hold."""
    failed = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return F.array_compact(F.array(*failed))


def valid_repair(repair: Column) -> Column:
    """Repair options in their ranges; those that aren't given have defaults."""
    unset = lambda c, ok: repair[c].isNull() | ok
    out = unset("strategy", repair["strategy"].isin(*STRATEGIES))
    for c in SHARES:
        out = out & unset(c, repair[c].between(0, 1))
    for c in SPANS:
        out = out & unset(c, repair[c].between(1, 32))
    return repair.isNull() | out


def write_results(result: DataFrame, path: str, format: str = "parquet") -> None:
    result.write.format(format).mode("errorifexists").save(path)


def conversation_pairs(conversations: DataFrame) -> DataFrame:
    """All sentences of a user's turn beside those of the assistant's answer, the k-th with the k-th; what has no counterpart stands beside
    an empty text. Stand-ins for translations: both sides are keyed by (conv_id, turn, k), so long turns are spread."""
    sentences = F.posexplode(F.regexp_extract_all("text", F.lit(r"[^.]*[.]|[^.]+"), F.lit(0)))
    asked = conversations.where("role = 'user'").select("conv_id", "turn", sentences.alias("k", "source"))
    given = conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), sentences.alias("k", "target"))
    both = asked.join(given, ["conv_id", "turn", "k"], "full")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return both.select(F.concat_ws(":", "conv_id", "turn", "k").alias("pair_id"), empty("source"), empty("target"))


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """Each turn, whole and whatever its role, beside the turn behind it; the last one, and one that nothing has the number of, beside an empty text. Keyed by (conv_id, turn)."""
    behind = conversations.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("target"))
    both = conversations.select("conv_id", "turn", F.col("text").alias("source")).join(behind, ["conv_id", "turn"], "left")
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return both.select(F.concat_ws(":", "conv_id", "turn").alias("pair_id"), empty("source"), empty("target"))


def literal_pairs(orders: DataFrame) -> DataFrame:
    """Pairs with placeholders, dates and percentages on both sides, written from the orders."""
    month = F.element_at(F.array(*map(F.lit, MONTHS)), F.month("o_orderdate"))
    share = (F.col("o_custkey") % 100).cast("string")
    date = (month, F.year("o_orderdate").cast("string"))
    source = F.concat(F.lit("Keep [["), "o_orderkey", F.lit("]] from "), date[0], F.lit(" "), date[1], F.lit(" at "), share, F.lit("% or "), share, F.lit("％ , ${x} done"))
    target = F.concat(date[1], F.lit(" 年 "), F.month("o_orderdate"), F.lit(" 月 0"), share, F.lit("% [["), "o_orderkey", F.lit("]] ${x} "), date[1], F.lit("年 ok"))
    return orders.select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("pair_id"), source.alias("source"), target.alias("target"))


def validate(pairs: DataFrame) -> DataFrame:
    """Adds `errors`, the names of the rules that a row breaks (empty: valid). Texts are kept as they are."""
    rules = {
        "source_language": language_code(F.col("source_language")),
        "target_language": language_code(F.col("target_language")),
        "source": F.length("source").between(1, 10_000) & visible(F.col("source")),
        "target": F.length("target").between(1, 10_000) & visible(F.col("target")),
    }
    if "method" in pairs.columns:
        rules["method"] = F.col("method").isin(*METHODS)
    if "id" in pairs.columns:
        rules["id"] = F.col("id").isNull() | (F.length("id") <= 100)
    found = broken(rules)
    return pairs.withColumn("errors", F.concat("request_errors", found) if "request_errors" in pairs.columns else found)


def accept(pairs: DataFrame, on_error: str = "fail") -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their errors); `fail` raises on the first invalid row that is reached."""
    checked = validate(pairs)
    bad = F.size("errors") > 0
    if on_error == "fail":
        message = F.concat(F.lit("invalid pair: "), F.concat_ws(", ", "errors"))
        return checked.where(F.when(bad, F.raise_error(message).cast("boolean")).otherwise(True)).drop("errors"), checked.where(bad)
    if on_error != "column":
        raise ValueError("on_error must be fail or column")
    return checked.where(~bad).drop("errors"), checked.where(bad)
