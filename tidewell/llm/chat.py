"""Chat formatting by quotation linking, in DataFrame operations only.

Lines are parsed for nested quote levels, neighbouring lines of one level form
passages, and the normalised text of a quoted passage is hashed and joined to
the message of the same conversation that said it; where no passage of a level
is found whole, as in interleaved and trimmed replies, its single lines are.
The nearest earlier message that a turn quotes is its parent; messages are then ordered so that
each follows its parent, and their text is given without quotes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import staged

#: Turns in a range within which quotes are matched first.
TURNS = 256

_MARKS = "regexp_extract({}, '^((?:[ \\\\t]*>)*)', 1)"


def said(messages: DataFrame) -> DataFrame:
    """One row per passage (kind 0) and non-blank line (kind 1): conv_id, turn, kind, level, h1, h2.

    Level 0 are own words. A passage is a run of non-blank lines of one quote
    level; hashes are of lower case with runs of blanks as one blank.
    """
    folded = "trim(regexp_replace(lower({}), '[ \\t\\r\\n]+', ' '))"
    lines = messages.select(
        "conv_id",
        "turn",
        F.expr(f"transform(split(text, '\n', -1), l -> named_struct('level', length(replace(replace({_MARKS.format('l')}, ' ', ''), '\t', '')), 'body', {folded.format(f'substring(l, length({_MARKS.format("l")}) + 1)')}))").alias("lines"),
    )
    # a passage begins where the level changes or a blank line ends
    starts = "filter(sequence(0, size(lines) - 1), i -> lines[i].body <> '' and (i = 0 or lines[greatest(i - 1, 0)].body = '' or lines[greatest(i - 1, 0)].level <> lines[i].level))"
    cut = lines.select("conv_id", "turn", "lines", F.expr(starts).alias("starts"))
    whole = "array_join(filter(transform(slice(lines, s + 1, coalesce(get(starts, k + 1), size(lines)) - s), l -> l.body), b -> b <> ''), ' ')"
    every = f"concat(transform(starts, (s, k) -> named_struct('kind', 0, 'level', lines[s].level, 'said', {whole})), transform(filter(lines, l -> l.body <> ''), l -> named_struct('kind', 1, 'level', l.level, 'said', l.body)))"
    each = cut.select("conv_id", "turn", F.expr(f"explode({every})").alias("e"))
    return each.select("conv_id", "turn", "e.kind", "e.level", F.xxhash64("e.said").alias("h1"), F.xxhash64(F.lit(1), "e.said").alias("h2"))


def parents(told: DataFrame) -> DataFrame:
    """What ``said`` gives -> (conv_id, turn, parent): the latest earlier turn whose own words the turn quotes.

    What is quoted at the outermost level decides; deeper levels only where
    no outer one is found. Within a level whole passages decide; its single
    lines only where no passage is found. Quotes and sayings of a text meet in
    order of turns, in ranges of ``TURNS`` turns and then over the ranges'
    last sayings, so that what a long conversation says and quotes again and
    again makes no pairs.
    """
    key = ["conv_id", "kind", "h1", "h2"]
    quoted = told.where("level > 0").select(*key, "turn", "level").distinct()
    own = told.where("level = 0").join(quoted.select(key).distinct(), key, "left_semi").select(*key, "turn", "level").distinct()
    rows = quoted.unionByName(own).withColumns({"reach": F.expr(f"turn div {TURNS}"), "said": F.when(F.col("level") == 0, F.col("turn"))})
    near = F.max("said").over(Window.partitionBy(*key, "reach").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    far = F.max("last").over(Window.partitionBy(*key).orderBy("reach").rowsBetween(Window.unboundedPreceding, -1))
    before = rows.groupBy(*key, "reach").agg(F.max("said").alias("last")).select(*key, "reach", far.alias("far"))
    found = rows.withColumn("near", near).where("level > 0").join(before, [*key, "reach"]).withColumn("said_in", F.coalesce("near", "far")).where("said_in is not null")
    best = found.groupBy("conv_id", "turn", "level", "kind").agg(F.max("said_in").alias("said_in"))
    return best.groupBy("conv_id", "turn").agg(F.min_by("said_in", F.struct("level", "kind")).alias("parent"))


def _threads(links: DataFrame, messages: DataFrame) -> DataFrame:
    """(conv_id, turn, root_turn, depth) of linked turns by pointer doubling."""
    now = staged(links.select("conv_id", "turn", F.col("parent").alias("up"), F.lit(1).cast("long").alias("depth")), messages)
    while True:
        up = now.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("far"), F.col("depth").alias("more"))
        moved = now.join(up, ["conv_id", "up"], "left")
        if moved.where("far is not null").isEmpty():
            return now.withColumnRenamed("up", "root_turn")
        now = staged(moved.select("conv_id", "turn", F.coalesce("far", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth")), messages)


def formatted(table: DataFrame) -> DataFrame:
    """One row per message: conv_id, turn, role, parent_turn, root_turn, depth, n_quoted, text.

    text is the message without quoted lines and without blank lines at its
    ends. Sorting a conversation by (root_turn, depth, turn) puts every reply
    after what it answers; messages without a found quote are roots. Null
    texts are empty messages. Messages with a null conv_id or turn, and
    repeats of a (conv_id, turn), come through; a repeat quotes and is quoted
    as one message with the other. Other columns are ignored.
    """
    messages = table.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = messages.where("conv_id is not null and turn is not null")
    # only conversations in which anything is quoted are taken apart
    quoting = known.where("text like '%>%'").where(F.expr("text rlike '(?m)^[ \\t]*>'")).select("conv_id").distinct()
    told = staged(said(known.join(quoting, "conv_id", "left_semi")), table)
    links = staged(parents(told), table)
    threads = _threads(links, table).join(links, ["conv_id", "turn"])
    level = f"length({_MARKS.format('l')}) > 0"
    clean = messages.withColumns(
        {
            "n_quoted": F.expr(f"cast(size(filter(split(text, '\\n', -1), l -> {level})) as long)"),
            "text": F.expr(f"regexp_replace(array_join(filter(split(text, '\\n', -1), l -> not ({level})), '\\n'), '\\\\A\\\\s+|\\\\s+\\\\z', '')"),
        }
    )
    out = clean.join(threads, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", F.col("parent").alias("parent_turn"), F.coalesce("root_turn", "turn").alias("root_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), "n_quoted", "text")
