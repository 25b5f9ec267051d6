"""Repeated runs of lines: later copies are deleted.

Lines get identifiers (two 64-bit hashes of the trimmed line; blank lines take
no part and stay). Prefix doubling names, for every place, its next 1, 2, 4, ...
lines by hashing two names of half the length; a stretch of any length is named
by the two names that cover it. Suffixes that share a prefix are an interval of
the suffix order; here an interval is the class of its common name, held
without sorting: doubling stays inside a document's lines and one aggregation
finds the intervals.

A run of lines counts if it has at least ``min_words`` words and stands earlier
too (in order of doc_id, null last, then row, then line; also within one text).
Every line of such a run lies in a shortest run of that size that begins or
ends at one of its lines, and these also stand earlier; so the union of the
shortest runs' later copies is the union of all maximal runs' later copies, and
intervals are needed at their depths only. Neighbouring deleted lines are
reported as one maximal run.

Only DataFrame functions are used. Defined cases: null text stays null and has
no lines; an empty text is one blank line; a text whose lines all go becomes
empty; rows equal in all columns are copies of one another like any others;
other columns are kept, those named as results replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyfs.llm.common import hot_join, materialize, prepare

MIN_WORDS = 4
TRIM = " \\t\\r\\u000b\\f"
WORDS = "regexp_count({}, '[^\\\\x20\\\\x09-\\\\x0D]+')"


def line_table(docs: DataFrame) -> DataFrame:
    """(seq, doc_id, n_lines, _lines): _lines holds number, identifiers and
    words of the lines with words, in order."""
    line = f"trim(both '{TRIM}' from x)"
    lines = docs.select("seq", "doc_id", F.split("text", "\n", -1).alias("_all"))
    coded = F.expr(f"transform(_all, (x, no) -> struct(no as no, xxhash64({line}) as a, xxhash64({line}, 3) as b, "
                   f"{WORDS.format('x')} as w))")
    return (lines.withColumn("_coded", coded)
            .select("seq", "doc_id", F.when(F.col("_all").isNull(), 0).otherwise(F.size("_all")).alias("n_lines"),
                    F.coalesce(F.expr("filter(_coded, l -> l.w > 0)"),
                               F.expr("cast(array() as array<struct<no:int,a:bigint,b:bigint,w:int>>)")).alias("_lines")))


def shortest_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """(seq, doc_id, i, n, name): the shortest runs of ``min_words`` words from
    and up to every line, named by their length and two names that cover them.

    Such a run has at most ``min_words`` lines, so names of that many lines are
    doubled up to. The windows share one partitioning by text.
    """
    at = Window.partitionBy("seq").orderBy("i")
    df = lines.select("seq", "doc_id", F.posexplode("_lines").alias("i", "l")).select(
        "seq", "doc_id", "i", F.col("l.a").alias("a0"), F.col("l.b").alias("b0"), F.col("l.w").cast("long").alias("w"))
    df = df.withColumn("upto", F.sum("w").over(at.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    for j in range(min_words.bit_length() - 1):  # names of 2^(j + 1) lines from two of 2^j
        a, b = F.col(f"a{j}"), F.col(f"b{j}")
        a2, b2 = F.lead(a, 1 << j).over(at), F.lead(b, 1 << j).over(at)
        df = df.select("*", F.when(a2.isNotNull(), F.xxhash64(a, b, a2, b2)).alias(f"a{j + 1}"),
                       F.when(a2.isNotNull(), F.xxhash64(b2, F.lit(7), a2, b, a)).alias(f"b{j + 1}"))
    runs = []
    for n in range(1, min_words + 1):
        j = n.bit_length() - 1
        a, b = F.col(f"a{j}"), F.col(f"b{j}")
        a2, b2 = (F.lead(c, n - (1 << j)).over(at) for c in (a, b))
        words = F.lead("upto", n - 1).over(at) - F.col("upto") + F.col("w")
        shortest = (words - F.lead("w", n - 1).over(at) < min_words) | (words - F.col("w") < min_words)
        name = F.concat(F.hex(F.xxhash64(a, b, a2, b2, F.lit(n))), F.lit("-"),
                        F.hex(F.xxhash64(F.lit(n), b2, F.lit(5), a2, b, a)))
        runs.append(F.when((words >= min_words) & shortest, F.struct(F.lit(n).alias("n"), name.alias("name"))))
    found = df.select("seq", "doc_id", "i", F.filter(F.array(*runs), lambda r: r.isNotNull()).alias("runs"))
    return found.select("seq", "doc_id", "i", F.explode("runs").alias("r")).select("seq", "doc_id", "i", "r.n", "r.name")


def later_copies(spark: SparkSession, lines: DataFrame, min_words: int) -> DataFrame:
    """(seq, places): places (in _lines) of the lines that later copies cover."""
    runs = materialize(spark, shortest_runs(lines, min_words), "line_runs")
    place = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "seq", "i")
    classes = (runs.groupBy("name").agg(F.count("*").alias("copies"), F.min(place).alias("first"))
               .filter("copies > 1"))
    classes = materialize(spark, classes, "line_classes")
    later = (hot_join(runs, classes, "name", "copies", "seq")
             .filter((F.col("seq") != F.col("first.seq")) | (F.col("i") != F.col("first.i"))))
    return later.groupBy("seq").agg(F.array_sort(F.array_distinct(F.flatten(
        F.collect_list(F.expr("sequence(i, i + n - 1)"))))).alias("places"))


def line_dedup(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with clean_text, n_lines, removed (line numbers from 0) and
    n_runs (maximal deleted runs)."""
    if min_words < 1:
        raise ValueError("a run has at least one word")
    prepare(spark)
    results = ("clean_text", "n_lines", "removed", "n_runs")
    names = [c for c in docs.columns if c not in results]
    # The user's row is one column: no name of it meets a name used here.
    base = docs.select(F.monotonically_increasing_id().alias("_seq"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    base = materialize(spark, base, "line_docs")
    text = F.col("_row.text").cast("string")
    lines = materialize(spark, line_table(base.select(
        F.col("_seq").alias("seq"), F.col("_row.doc_id").cast("long").alias("doc_id"), text.alias("text"))), "line_ids")
    gone = later_copies(spark, lines, min_words)
    decided = lines.join(gone, "seq", "left").select(
        F.col("seq").alias("_seq"), F.col("n_lines").alias("_n_lines"),
        F.expr("coalesce(transform(places, p -> _lines[p].no), cast(array() as array<int>))").alias("_removed"),
        F.expr("coalesce(size(array_except(places, transform(places, p -> p + 1))), 0)").alias("_runs"))
    decided = materialize(spark, decided, "line_decisions")
    rows = base.join(decided, "_seq").withColumn("_text", text)
    # the split text as a lambda's variable, so that it is made once
    kept = F.expr("transform(array(split(_text, '\\n', -1)), a -> concat_ws('\\n', transform("
                  "array_except(sequence(0, size(a) - 1), _removed), i -> a[i])))[0]")
    return rows.select(*[F.col("_row").getField(c).alias(c) for c in names],
                       F.when(F.col("_runs") == 0, F.col("_text")).otherwise(kept).alias("clean_text"),
                       F.col("_n_lines").alias("n_lines"), F.col("_removed").alias("removed"), F.col("_runs").alias("n_runs"))
