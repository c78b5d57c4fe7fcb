"""A table of patterns matched against URIs, and what changed between two versions of it."""

from __future__ import annotations

import string
from collections.abc import Callable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from alertloom.functions.literals import LEAST_LITERAL, required_literals
from alertloom.session import package_on_workers, stored

# Rules become expressions of the plan: so many in one scan of the table.
RULES_PER_SCAN = 2000
# Patterns that no literal is required for are such expressions; of them a feed may have so many.
MOST_WITHOUT_LITERAL = 20_000
# So many patterns in all are tried as expressions; building an index would cost more.
FEW_PATTERNS = 200
# Characters of a key of the index, for literals of that length or more, and for shorter ones.
KEY, SHORT_KEY = 6, LEAST_LITERAL


def valid_regex(spark: SparkSession, pattern: str) -> bool:
    """Whether the JVM, which will match it, can compile the pattern. Runs no job."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, PySparkException):
        return False
    return True


def feed_table(feed: DataFrame) -> DataFrame:
    """One row per pattern; with a ``line`` column the last line wins."""
    order = F.col("line") if "line" in feed.columns else F.col("description")
    return feed.groupBy("regex").agg(F.max_by("description", order).alias("description"))


def feed_patterns(feed: DataFrame) -> DataFrame:
    """One row per pattern of the feed with ``valid``: the JVM, which will match it, can compile it."""
    compiled = F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col("regex"))
    return feed_table(feed).withColumn("valid", F.col("regex").isNotNull() & compiled.isNotNull())


def checked_patterns(feed: DataFrame) -> tuple[list[Row], list[Row]]:
    """Usable patterns, and those that are no valid regular expression, as lists for people to look at."""
    rows = feed_patterns(feed).orderBy("regex").collect()
    return [r for r in rows if r["valid"]], [r for r in rows if not r["valid"]]


def blocks(df: DataFrame, rules: list, hit: Callable[[object], Column], hit_type: str) -> DataFrame:
    """Every row once per rule it fulfils. ``hit`` gives a struct, or null if the rule does not
    apply. Rows are never paired up with rules before the test; the table is read once for every
    ``RULES_PER_SCAN`` rules."""
    def matched(block: list) -> DataFrame:
        hits = F.array_compact(F.array(*[hit(r) for r in block])) if block else \
            F.array().cast(f"array<{hit_type}>")
        return df.select("*", F.inline(hits))

    parts = [rules[i:i + RULES_PER_SCAN] for i in range(0, len(rules), RULES_PER_SCAN)] or [[]]
    return reduce(DataFrame.unionByName, [matched(p) for p in parts])


def _lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _keys(text: Column, length: int) -> Column:
    """All stretches of ``length`` characters of a text, each once, in one pass over it."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{length}}}))"), F.lit(1)))


def literal_index(patterns: DataFrame) -> DataFrame:
    """Where to look a pattern up: ``key``, ``regex``, ``description``, ``literals`` (a literal and its key for each alternative).

    ``patterns``: valid ones with ``required``, the literals of which a match holds one. The key of a literal is
    the stretch of it that the fewest literals have, so that patterns with common parts lie apart.
    """
    each = patterns.select("regex", "description", F.posexplode("required").alias("n", "literal"))
    length = F.when(F.char_length("literal") >= KEY, F.lit(KEY)).otherwise(SHORT_KEY)
    parts = each.select("*", F.explode(F.when(length == KEY, _keys(F.col("literal"), KEY)).otherwise(_keys(F.col("literal"), SHORT_KEY))).alias("key"))
    counts = parts.groupBy("key").agg(F.count(F.lit(1)).alias("uses"))
    chosen = parts.join(counts, "key").groupBy("regex", "n").agg(
        F.min_by("key", F.struct("uses", "key")).alias("key"), F.first("literal").alias("literal"), F.first("description").alias("description"))
    whole = chosen.groupBy("regex").agg(
        F.first("description").alias("description"),
        F.transform(F.array_sort(F.collect_list(F.struct("n", "literal", "key"))), lambda x: F.struct(x["literal"], x["key"])).alias("literals"))
    return whole.select(F.explode(F.array_distinct("literals.key")).alias("key"), "regex", "description", "literals")


def match_feed(uris: DataFrame, feed: DataFrame, uri_col: str = "uri") -> DataFrame:
    """URIs with each feed pattern found anywhere in them. Invalid patterns match nothing.

    From each pattern the literals are taken that any match must hold; one key of each is joined with
    the stretches of that length of the URI, and only on what meets there and holds the literal the regular expression is
    tried. The index is a stored table: Spark sends it to the tasks if it sees that it is small, and shuffles the
    stretches otherwise. No pattern with a literal comes to the driver; the few without one are tried on every URI, as are all
    of a feed of at most ``FEW_PATTERNS``.
    """
    package_on_workers(uris.sparkSession)
    patterns = feed_patterns(feed).where("valid").drop("valid")

    def hit(p: Row) -> Column:
        found = F.struct(F.lit(p["regex"]).alias("regex"), F.lit(p["description"]).alias("description"))
        return F.when(F.col(uri_col).rlike(p["regex"]), found)

    kind = "struct<regex:string,description:string>"
    few = patterns.orderBy("regex").limit(FEW_PATTERNS + 1).collect()
    if len(few) <= FEW_PATTERNS:
        return blocks(uris, few, hit, kind)

    patterns = stored(patterns.withColumn("required", required_literals("regex")))
    index = stored(literal_index(patterns.where(F.size("required") > 0)))
    low = _lowered(F.col(uri_col))
    lengths = {KEY, SHORT_KEY} & {r.n for r in index.select(F.char_length("key").alias("n")).distinct().collect()}
    keys = F.flatten(F.array(F.array().cast("array<string>"), *[_keys(low, n) for n in sorted(lengths)]))
    met = uris.select(F.struct("*").alias("_uri"), low.alias("_low"), F.explode(keys).alias("key")).join(index, "key")
    # A pattern may be met under several keys: the one of its first literal that is there counts.
    first = F.filter("literals", lambda x: F.contains(F.col("_low"), x["literal"]))
    met = met.where(F.get(first, F.lit(0))["key"] == F.col("key"))
    indexed = met.where(F.rlike(F.col("_uri")[uri_col], F.col("regex"))).select("_uri.*", "regex", "description")

    rest = patterns.where(F.size("required") == 0).select("regex", "description")
    if (count := rest.count()) > MOST_WITHOUT_LITERAL:
        raise ValueError(f"{count} patterns without a literal of {LEAST_LITERAL} characters; at most {MOST_WITHOUT_LITERAL} are tried on every row")
    return indexed.unionByName(blocks(uris, rest.orderBy("regex").collect(), hit, kind))


def feed_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """NEW, CHANGED and REMOVED patterns; unchanged ones yield no row."""
    old = feed_table(previous).withColumnRenamed("description", "old_description")
    new = feed_table(current)
    change = (
        F.when(F.col("old_description").isNull(), "NEW")
        .when(F.col("description").isNull(), "REMOVED")
        .when(F.col("description") != F.col("old_description"), "CHANGED")
    )
    return old.join(new, "regex", "full_outer").select(
        "regex", F.coalesce("description", "old_description").alias("description"),
        change.alias("change"),
    ).where(F.col("change").isNotNull())
