"""Deterministic links: equal placeholders, months and years, percentages."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Month names without their final dots, Chinese numerals of months.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7,
    "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}
NUMERALS = {"一": 1, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10, "十一": 11, "十二": 12}
#: What a rule's kinds override: a link goes where a link of a later level has one of its ends.
LEVELS = {"protected": 1, "year": 2, "month": 2, "percent": 3}


@lru_cache(1)
def number_forms() -> dict[str, str]:
    """Each character beyond ASCII that stands for digits, signs, a point or a percent sign in some compatible form, and the ASCII for it."""
    out = {}
    for c in map(chr, range(128, sys.maxunicode + 1)):
        if unicodedata.category(c)[0] in "NPS":
            plain = [x if x in "+-.%" else unicodedata.decimal(x, None) for x in unicodedata.normalize("NFKC", c)]
            if None not in plain:
                out[c] = "".join(map(str, plain))
    return out


def _class(characters) -> str:
    """The characters as a regular expression's class, in ranges."""
    ranges: list[list[int]] = []
    for c in sorted(map(ord, characters)):
        if ranges and c == ranges[-1][1] + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in ranges)


def plain_number(text: Column) -> Column:
    """The text in compatible form (NFKC) with ASCII digits, if that may be a number; any other text as it is."""
    forms = number_forms()
    table = F.create_map(*[F.lit(x) for kv in forms.items() for x in kv])
    odd = text.rlike(r"[^\x00-\x7F]") & text.rlike(rf"\A[-+.%0-9{_class(forms)}]+\z")
    return F.when(odd, F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")).otherwise(text)


def plain_digits(text: Column) -> Column:
    """The text with all decimal digits in ASCII."""
    digits = {c: d for c, d in number_forms().items() if unicodedata.decimal(c, None) is not None}
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, "".join(digits), "".join(digits.values()))).otherwise(text)


def dated(text: Column, following: Column) -> Column:
    """Whether a month or year may begin at a token, told by cheap means: most tokens have neither a digit nor a month's name."""
    name = F.rtrim(F.translate(F.lower(text), "ſ", "s"), F.lit("."))
    return text.rlike("[0-9]") | text.endswith("月") | F.coalesce(following == "月", F.lit(False)) | name.isin(*MONTHS)


def _lookup(table: dict[str, int], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def temporal(text: Column, following: Column) -> Column:
    """(kind, value, len) of the month or year that begins at a token (in plain digits), given the next token if that is free; null if none does. A
    unit that a number takes never begins a span, so looking one token ahead is enough."""
    named = _lookup(MONTHS, F.rtrim(F.translate(F.lower(text), "ſ", "s"), F.lit(".")))
    small = lambda digits: F.when(F.length(F.ltrim(digits, F.lit("0"))).between(1, 2), digits.try_cast("long"))
    month = lambda m: F.when(m.between(1, 12), m)
    year = lambda pattern: F.when(text.rlike(pattern), F.substring(text, 1, 4))
    chinese = F.when(text.endswith("月"), _lookup(NUMERALS, F.regexp_replace(text, "月$", "")))
    unit = F.when(text.rlike(r"\A[0-9]{1,2}月\z"), month(small(F.regexp_extract(text, "^[0-9]+", 0))))
    number = F.when(following == "月", F.coalesce(F.when(text.rlike(r"\A[0-9]+\z"), month(small(text))), _lookup(NUMERALS, text)))
    bare = year(r"\A[12][0-9]{3}\z")
    told = lambda kind, value, size: F.when(value.isNotNull(), F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value"), F.lit(size).alias("len")))
    return F.coalesce(
        told("month", named, 1), told("year", year(r"\A[12][0-9]{3}年\z"), 1), told("month", unit, 1), told("month", chinese, 1),
        told("year", F.when(following == "年", bare), 2), told("month", number, 2), told("year", bare, 1),
    )


#: Fixed value: significant digits that a number keeps; those beyond are rounded away, halves to the even digit.
DIGITS = 28


def number_text(c: Column) -> Column:
    """Decimal text without sign of plus, leading and trailing zeros, rounded to 28 significant digits."""
    sign = F.when(c.startswith("-"), "-").otherwise("")
    digits = F.regexp_replace(c, r"^[+-]", "")
    whole = F.regexp_replace(F.split_part(digits, F.lit("."), F.lit(1)), r"^0+", "")
    part = F.regexp_replace(F.split_part(digits, F.lit("."), F.lit(2)), r"0+$", "")
    shown = F.when(F.length(whole) + F.length(part) > DIGITS, _rounded(whole, part)).otherwise(_written(whole, part))
    return F.when(shown == "0", "0").otherwise(F.concat(sign, shown))


def _written(whole: Column, part: Column) -> Column:
    return F.concat(F.when(whole == "", "0").otherwise(whole), F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))


def _rounded(whole: Column, part: Column) -> Column:
    """The number of these digits, in text, for Spark's decimals have 38: the kept digits, one more where the rest is more than a half, or a half behind an odd digit. As many zeros as
    were cut off stand in for them in front of the point."""
    all_ = F.regexp_replace(F.concat(whole, part), "^0+", "")
    kept, rest = F.substring(all_, 1, DIGITS), F.substring(all_, DIGITS + 1, 2**31 - 1)
    half = F.regexp_replace(rest, "0+$", "")
    up = (half > "5") | ((half == "5") & F.substring(kept, DIGITS, 1).isin(*"13579"))
    number = (kept.cast("decimal(28,0)") + up.cast("int").cast("decimal(1,0)")).cast("string")
    # Places behind the point that are left; below 0 where digits in front of it were cut.
    places = F.length(part) - F.length(rest)
    padded = F.lpad(number, F.greatest(F.length(number), places), "0")
    at = F.length(padded) - F.greatest(places, F.lit(0))
    split = _written(F.regexp_replace(F.substring(padded, F.lit(1), at), "^0+", ""), F.regexp_replace(F.substring(padded, at + 1, F.length(padded)), "0+$", ""))
    return F.when(F.length(all_) <= DIGITS, _written(whole, part)).when(places < 0, F.concat(number, F.repeat(F.lit("0"), -places))).otherwise(split)


def percentage(text: Column, following: Column) -> Column:
    """(kind, value, len) of the percentage that begins at a token (as a plain number), given the next token if that is free; null if none does."""
    number = r"[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)"
    alone, before = text.rlike(rf"\A{number}%\z"), text.rlike(rf"\A{number}\z") & (plain_number(F.trim(following)) == "%")
    told = lambda value, size: F.struct(F.lit("percent").alias("kind"), number_text(value).alias("value"), F.lit(size).alias("len"))
    return F.when(alone, told(F.regexp_replace(text, "%$", ""), 1)).when(before, told(text, 2))


def rule_spans(tokens: DataFrame, kinds: tuple[str, ...] = tuple(LEVELS)) -> DataFrame:
    """All spans (pair_id, side, idx, kind, value, len, occ) of the rules, in one pass over the tokens of a pair; occ counts the equal keys of a side.
    Tokens that have their `following` stay where they are, and only spans are dealt by pair; others are dealt to find it."""
    if "following" not in tokens.columns:
        w = Window.partitionBy("pair_id", "side").orderBy("idx")
        tokens = tokens.select("pair_id", "side", "idx", "text", "is_protected").repartition("pair_id").withColumn("following", F.when(~F.lead("is_protected").over(w), F.lead("text").over(w)))
    free = ~F.col("is_protected")
    makers = {
        "protected": F.when(~free, F.struct(F.lit("protected").alias("kind"), F.col("text").alias("value"), F.lit(1).alias("len"))),
        "year": F.when(free & dated(F.col("dated"), F.col("following")), temporal(F.col("dated"), F.col("following"))),
        "percent": F.when(free & F.col("counted").rlike("[0-9]"), percentage(F.col("counted"), F.col("following"))),
    }
    found = F.array_compact(F.array(*[c for k, c in makers.items() if k in kinds]))
    told = tokens.withColumn("trimmed", F.trim("text")).withColumns({"dated": plain_digits(F.col("trimmed")), "counted": plain_number(F.col("trimmed"))})
    spans = told.select("pair_id", "side", "idx", F.explode(found).alias("x")).select("pair_id", "side", "idx", "x.*")
    return spans.repartition("pair_id").withColumn("occ", F.row_number().over(Window.partitionBy("pair_id", "side", "kind", "value").orderBy("idx")))


def match_spans(spans: DataFrame) -> DataFrame:
    """The k-th source span of a key with the k-th target span: the cross product of their tokens, with the level of the rule. Both sides stand in
    one group, so nothing is joined."""
    side = lambda s: F.max(F.when(F.col("side") == s, F.struct("idx", "len")))
    both = spans.groupBy("pair_id", "kind", "value", "occ").agg(side("source").alias("a"), side("target").alias("b")).where("a is not null and b is not null")
    level = F.try_element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), "kind").alias("level")
    places = lambda x: F.explode(F.expr(f"sequence({x}.idx, {x}.idx + {x}.len - 1)"))
    return both.select("pair_id", level, "b", places("a").alias("s")).select("pair_id", "s", places("b").alias("t"), "level")


def _links(tokens: DataFrame, *kinds: str) -> DataFrame:
    return match_spans(rule_spans(tokens, kinds)).select("pair_id", "s", "t").distinct()


def protected_links(tokens: DataFrame) -> DataFrame:
    """Equal placeholders, the k-th with the k-th."""
    return _links(tokens, "protected")


def temporal_links(tokens: DataFrame) -> DataFrame:
    return _links(tokens, "year", "month")


def percent_links(tokens: DataFrame) -> DataFrame:
    return _links(tokens, "percent")


def override(links: DataFrame, tokens: DataFrame) -> DataFrame:
    """Links after all rules, with `rule`: placeholders first, then dates, then percentages; a later rule wins.

    Given links are of level 0 and must keep off protected tokens, placeholders are of level 1, dates 2, percentages 3: a link goes where
    one of a later level from 2 on has one of its ends. One exchange by pair carries all of it. Further columns of the given links go along, null where a rule alone links."""
    held = [c for c in links.columns if c not in ("pair_id", "s", "t")]
    ruled = match_spans(rule_spans(tokens))
    marks = tokens.where("is_protected").select("pair_id", F.when(F.col("side") == "source", F.col("idx")).alias("s"), F.when(F.col("side") == "target", F.col("idx")).alias("t"), F.lit(-1).alias("level"))
    every = links.select("pair_id", "s", "t", F.lit(0).alias("level"), *held).unionByName(ruled, allowMissingColumns=True).unionByName(marks, allowMissingColumns=True).repartition("pair_id")
    over = lambda end: Window.partitionBy("pair_id", end)
    for end in ("s", "t"):
        every = every.withColumn(f"{end}_last", F.max("level").over(over(end))).withColumn(f"{end}_kept", F.min("level").over(over(end)) < 0)
    free = "level > 0 or not (s_kept or t_kept)"
    stays = f"level >= 0 and ({free}) and greatest(s_last, t_last) <= greatest(level, 1)"
    return every.where(stays).groupBy("pair_id", "s", "t").agg((F.max("level") > 0).alias("rule"), *[F.max(c).alias(c) for c in held])
