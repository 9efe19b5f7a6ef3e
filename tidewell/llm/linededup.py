"""Line dedup as a deletion-neighbourhood join, in DataFrame operations only.

A line occurrence goes when an earlier occurrence, in order of (doc_id,
line_no), has the same line or one within one edit (a character replaced,
inserted or deleted). Equal lines meet by hash. For the others all variants
within the edit bound are emitted as hashed keys and equal variants joined:

* two lines of one length are one replacement apart if, for some place, they
  agree without that character: key (length, place, rest);
* lines of length N and N - 1 are one deletion apart if the shorter is the
  longer without one character: key (N, rest), matched full against deleted.

A line of n characters has n variants of n - 1 characters, so two exact
filters come first. One edit leaves the head or the tail of a line alone:
only lines that share a long enough head or tail with another line go on.
Those are cut into chunks of about the root of their length, one edit leaves
all chunks but one alone, and only lines that agree outside some chunk emit
the variants of that chunk. Both filters, and the variants, only compare the
least and the greatest member of a key, which are pre-aggregated before the
shuffle; no group is ever collected and no pairs are emitted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import staged

#: Lines up to this long skip the head-and-tail filter (it serves from this length on).
SHORT = 16
#: Least characters in a chunk.
CHUNK = 64

_SPLIT = "split(text, '\\n', -1)"
_TRIM = "btrim({}, ' \\t\\r')"
_DOC = ["named", "doc_id", "th"]


def _identified(docs: DataFrame) -> DataFrame:
    """named, doc_id, th, text: a null doc_id is not named and 0, so that plain keys hold all rows."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return named.select(F.col("doc_id").isNotNull().alias("named"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def _reach(n: str) -> str:
    """Length of the head and tail that a line of the class has to share."""
    return f"(case when {n} < 64 then 4 * ({n} div 8) else 16 * ({n} div 32) end)"


def _ends() -> str:
    """Keys of a line's heads and tails, for its own length and one more; null for short lines."""
    keys = []
    for n in ("n", "(n + 1)"):
        r = _reach(n)
        keys += [f"xxhash64('head', {r}, substring(line, 1, {r}))", f"xxhash64('tail', {r}, right(line, {r}))"]
    return f"case when n >= {SHORT} then array_distinct(array({', '.join(keys)})) end"


def _lines(docs: DataFrame) -> DataFrame:
    """named, doc_id, th, line_no, h1, h2, n, ends: the lines that are not blank, without their text."""
    every = _identified(docs).select(*_DOC, F.posexplode(F.expr(_SPLIT)).alias("line_no", "raw"))
    line = every.select(*_DOC, "line_no", F.expr(_TRIM.format("raw")).alias("line")).where("line <> ''").withColumn("n", F.length("line"))
    return line.select(*_DOC, "line_no", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), "n", F.expr(_ends()).alias("ends"))


def _two_members(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that at least two different lines have."""
    ends = [f(h).alias(f"{f.__name__}_{h}") for f in (F.min, F.max) for h in ("h1", "h2")]
    return rows.groupBy(*keys).agg(*ends).where("min_h1 <> max_h1 or min_h2 <> max_h2").select(*keys)


def _chunks(lines: DataFrame) -> DataFrame:
    """One row per line, length class and chunk: what is in it and a key of all else."""
    each = lines.select("*", F.expr("explode(array(n, n + 1))").alias("cls")).withColumn("c", F.expr(f"greatest({CHUNK}, cast(ceil(sqrt(cls)) as int))"))
    each = each.select("*", F.expr("explode(sequence(0, (cls - 1) div c))").alias("j")).withColumn("after", F.expr("cls - least(c * (j + 1), cls)"))
    each = each.withColumns({"head": F.expr("substring(line, 1, c * j)"), "tail": F.expr("right(line, after)"), "mid": F.expr("substring(line, c * j + 1, n - c * j - after)")})
    return each.withColumns({"k1": F.expr("xxhash64(cls, j, head, tail)"), "k2": F.expr("xxhash64(tail, j, cls, head)")}).select("h1", "h2", "pos", "n", "cls", "mid", "k1", "k2")


def _variants(chunks: DataFrame) -> DataFrame:
    """The deletion neighbourhood: v1, v2 are the hashed key, role is how the line has it."""
    without = "concat(substring(mid, 1, i), substring(mid, i + 2))"
    places = chunks.where("n = cls").select("*", F.expr("explode(case when length(mid) > 0 then sequence(0, length(mid) - 1) end)").alias("i")).withColumn("rest", F.expr(without))
    key = lambda *x: {"v1": F.expr(f"xxhash64(k1, k2, {', '.join(x)})"), "v2": F.expr(f"xxhash64({', '.join(x)}, k2, k1)")}
    columns = ["h1", "h2", "pos", "v1", "v2", "role"]
    replaced = places.withColumns(key("i", "rest")).withColumn("role", F.lit("replaced")).select(columns)
    deleted = places.withColumns(key("-1", "rest")).withColumn("role", F.lit("deleted")).select(columns)
    full = chunks.where("n = cls - 1").withColumns(key("-1", "mid")).withColumn("role", F.lit("full")).select(columns)
    return replaced.unionByName(deleted).unionByName(full)


def _near(docs: DataFrame, first: DataFrame) -> DataFrame:
    """h1, h2, near: of lines with an earlier other line within one edit, the earliest such."""
    ends = first.select("h1", "h2", F.explode("ends").alias("key"))
    sharing = ends.join(_two_members(ends, ["key"]), "key").select("h1", "h2").distinct()
    chosen = first.join(sharing, ["h1", "h2"], "left_semi").unionByName(first.where(f"n <= {SHORT}")).select("h1", "h2", "pos")
    wanted = chosen.groupBy(*(F.col(f"pos.{c}").alias(c) for c in _DOC)).agg(F.collect_list(F.struct("h1", "h2", "pos")).alias("wanted"))
    # one shuffle of the texts, for the repeated rows and for the join; then only the wanted lines go on
    source = _identified(docs).groupBy(*_DOC).agg(F.any_value("text").alias("text")).join(wanted, _DOC)
    texts = source.select(F.expr(_SPLIT).alias("all"), F.explode("wanted").alias("w"))
    texts = texts.select("w.h1", "w.h2", "w.pos", F.expr(_TRIM.format("get(all, w.pos.line_no)")).alias("line")).where(F.xxhash64("line") == F.col("h1"))
    texts = staged(texts.withColumn("n", F.length("line")), docs)

    chunks = _chunks(texts)
    chunks = chunks.join(_two_members(chunks, ["k1", "k2"]), ["k1", "k2"])
    variants = staged(_variants(chunks), docs)
    who = F.struct("pos", "h1", "h2")
    least = lambda role: F.min(F.when(F.col("role") == role, who)).alias(role)
    met = variants.groupBy("v1", "v2").agg(least("replaced"), F.max(F.when(F.col("role") == "replaced", who)).alias("last"), least("deleted"), least("full")).where("(deleted is not null and full is not null) or replaced <> last").drop("last")
    partner = F.expr("case role when 'replaced' then replaced when 'deleted' then full else deleted end")
    links = variants.join(met, ["v1", "v2"]).withColumn("with", partner).where("with.pos < pos").select("h1", "h2", F.col("with.pos").alias("near"), F.col("with.h1").alias("g1"), F.col("with.h2").alias("g2")).distinct()
    one, other = texts.select("h1", "h2", "line"), texts.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("line").alias("other"))
    verified = links.join(one, ["h1", "h2"]).join(other, ["g1", "g2"]).where("levenshtein(line, other, 1) between 0 and 1")
    return verified.groupBy("h1", "h2").agg(F.min("near").alias("near"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs``, all rows and columns, with repeated and near-repeated lines cut.

    Added columns: n_lines and n_removed (long). Lines are the parts between
    newlines; they are compared without blanks, tabs and carriage returns
    around them, and blank lines always stay. The earliest occurrence stays
    unless a still earlier line is within one edit of it, whether or not that
    one stays itself. Null texts stay null with no lines. Rows with equal
    doc_id and text are one document and keep the same lines; a null doc_id
    comes before all others. n_chars, where there is one, follows the text.
    Other columns may have any names but those added; ones of the same name
    are replaced.
    """
    lines = staged(_lines(docs), docs)
    pos = F.struct("named", "doc_id", "line_no", "th").alias("pos")
    first = staged(lines.select("h1", "h2", "n", "ends", pos).groupBy("h1", "h2").agg(F.min("pos").alias("pos"), F.max("n").alias("n"), F.any_value("ends").alias("ends"), F.count("*").alias("times")), docs)
    near = staged(_near(docs, first), docs)
    act = first.join(near, ["h1", "h2"], "left").where("times > 1 or near is not null").select("h1", "h2", F.least("pos", "near").alias("stays"))
    gone = lines.select("h1", "h2", pos).join(act, ["h1", "h2"]).where("pos > stays")
    drops = gone.groupBy(*(F.col(f"pos.{c}").alias(f"__{c}") for c in _DOC)).agg(F.collect_set("pos.line_no").alias("__drops"))

    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    named = docs.select(*kept, F.xxhash64(F.col("text").cast("string")).alias("__text"))
    same = (named["doc_id"].isNotNull() == drops["__named"]) & (F.coalesce(named["doc_id"].cast("long"), F.lit(0)) == drops["__doc_id"]) & (named["__text"] == drops["__th"])
    joined = named.join(drops, same, "left")
    rest = "array_except(sequence(0, size(__all) - 1), __drops)"
    cut = joined.withColumn("__all", F.expr(_SPLIT)).withColumn("__new", F.expr(f"case when __drops is null then text else array_join(transform({rest}, i -> get(__all, i)), '\\n') end"))
    made = {"text": F.col("__new"), "n_chars": F.length("__new").cast("long")}
    return cut.select(
        *(made[c].alias(c) if c in made else F.col(c) for c in kept),
        F.when(F.col("text").isNull(), 0).otherwise(F.size("__all")).cast("long").alias("n_lines"),
        F.when(F.col("__drops").isNull(), 0).otherwise(F.size("__drops")).cast("long").alias("n_removed"),
    )
