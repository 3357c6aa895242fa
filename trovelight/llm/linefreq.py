"""Quality rules natively in Spark: base statistics of a text and cross-document line frequency.

Lines are normalised and hashed; per host the distinct documents (different texts) that hold a line are counted; lines
above the limits are removed, and a document that loses nearly all its words is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelight.llm import common

#: Limits: a line is removed when more distinct documents of its host hold it than this share of them, but never fewer than the least
#: and never more than the most, so that the limit does not fade as a host grows (from 1,000 documents on it is the most).
LINE_LEAST, LINE_MOST = 5, 20
LINE_SHARE = 0.02
#: A document is depleted when fewer words than this remain, or when this share of its words went.
REMAINING_WORDS = 10
REMOVED_SHARE = 0.8
MIN_WORDS, REPEAT_PERCENT, WINDOW = 10, 20, 5

SPACE = r"[\x20\x09-\x0D]"
SPACES = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """The maximal runs of characters other than white space; none for a null or blank text."""
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE + "+")).otherwise(F.array().cast("array<string>"))


def _covered(places: Column) -> Column:
    """Words covered by windows that begin at the sorted ``places``."""
    gap = F.transform(places, lambda p, k: F.when(k + 1 < F.size(places), F.least(F.lit(WINDOW), F.get(places, k + 1) - p)).otherwise(F.lit(WINDOW)))
    return F.aggregate(gap, F.lit(0).cast("long"), lambda a, x: a + x)


def base_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed to ``docs``."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_words", words(t))
    out = out.withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    windows = F.transform(F.sequence(F.lit(0), F.size("_hashes") - WINDOW), lambda i: F.xxhash64(*[F.get("_hashes", i + k) for k in range(WINDOW)]))
    out = out.withColumn("_windows", F.when(F.size("_hashes") > WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    # Only a text with a repeated window is sorted.
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    out = out.withColumn("_sorted", F.when(repeats, placed))
    same = F.transform(
        "_sorted",
        lambda x, k: F.when((F.get(F.col("_sorted"), k - 1)["h"] == x["h"]) | (F.get(F.col("_sorted"), k + 1)["h"] == x["h"]), x["i"]),
    )
    out = out.withColumn("_places", F.sort_array(F.filter(same, lambda i: i.isNotNull())))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    out = out.withColumn("_lines", lines)
    out = out.withColumn("n_words", F.size("_words").cast("long")).withColumn("n_repeat_words", F.coalesce(_covered(F.col("_places")), F.lit(0)).cast("long"))
    out = out.withColumns({
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": F.size(F.regexp_extract_all(t, F.lit(r"[#*$%&|<>]"), F.lit(0))).cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")),
    })
    return out.drop("_words", "_hashes", "_windows", "_sorted", "_places", "_lines")


def normalised(line: Column) -> Column:
    """Lower case, digits and white space as single spaces, no spaces at the ends."""
    return F.trim(F.regexp_replace(F.lower(line), r"[0-9\x20\x09-\x0D]+", " "))


def depleted_texts(docs: DataFrame, host: str) -> DataFrame:
    """(host, h1, h2) of the texts that line removal depletes; h1 and h2 are hashes of the text."""
    t = F.col("text")
    lines = F.filter(
        F.transform(F.split(t, "\n"), lambda x: F.struct(normalised(x).alias("norm"), F.size(words(x)).alias("n"))), lambda s: s["n"] > 0
    )
    hashed = F.transform(lines, lambda s: F.struct(F.xxhash64(s["norm"]).alias("line"), s["n"].alias("n")))
    rows = docs.filter(t.isNotNull()).select(F.coalesce(F.col(host), F.lit("")).alias("host"), F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), hashed.alias("lines"))
    # Copies count once: a row per host and different text, combined before the shuffle.
    texts = common.materialize(rows.groupBy("host", "h1", "h2").agg(F.first("lines").alias("lines")), "line-hashes")
    held = texts.select("host", F.explode(F.array_distinct(F.transform("lines", lambda s: s["line"]))).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > LINE_LEAST)
    sizes = common.materialize(texts.groupBy("host").agg(F.count("*").alias("host_docs")), "host-sizes")
    limit = F.least(F.lit(float(LINE_MOST)), LINE_SHARE * F.col("host_docs"))
    above = common.join_hot(held, sizes, ["host"], "inner", F.col("line")).filter(F.col("n_docs") > limit).select("host", "line", F.lit(True).alias("above"))
    above = common.materialize(above, "lines-above")
    each = texts.select("host", "h1", "h2", F.explode("lines").alias("s")).select("host", "h1", "h2", F.col("s.line").alias("line"), F.col("s.n").alias("n"))
    joined = common.join_hot(each, above, ["host", "line"], "left", F.col("h1"))
    sums = joined.groupBy("host", "h1", "h2").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("above"), F.col("n")).otherwise(0)).alias("gone"))
    lost = (F.col("gone") > 0) & ((F.col("n") - F.col("gone") < REMAINING_WORDS) | (F.col("gone") >= REMOVED_SHARE * F.col("n")))
    return common.materialize(sums.filter(lost).select("host", "h1", "h2", F.lit(True).alias("depleted")), "depleted")


def quality(docs: DataFrame, host: str = "source") -> DataFrame:
    """``docs(doc_id, text, <host>)`` to doc_id, the base statistics, base_failed and kept.

    A null text has no words and fails; a null host counts as ''. Copies share one verdict per host; repeated rows are
    kept as rows. Lines without a word don't count. Other columns are ignored.
    """
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col(host).cast("string").alias("host"))
    gone = depleted_texts(docs, "host")
    keyed = docs.withColumns({"host": F.coalesce("host", F.lit("")), "h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")})
    stats = base_statistics(keyed).drop("text")
    joined = common.join_hot(stats, gone, ["host", "h1", "h2"], "left", F.col("doc_id"))
    kept = ~F.col("base_failed") & ~F.coalesce("depleted", F.lit(False))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, text, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, concat_ws(' ', w[i], w[i+1], w[i+2], w[i+3], w[i+4]) AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - 4)) AS i FROM d WHERE len(w) > 4)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n FROM rep, (SELECT unnest(generate_series(0, 4)) AS k) GROUP BY r),
ln AS (SELECT r, host, text, unnest(string_split(t, chr(10))) AS line FROM d),
lw AS (SELECT r, host, text, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
              trim(regexp_replace(lower(line), '[0-9\x20\x09-\x0D]+', ' ', 'g')) AS norm FROM ln),
lines AS (SELECT * FROM lw WHERE n > 0),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r),
hosts AS (SELECT host, count(DISTINCT text) AS n FROM d WHERE text IS NOT NULL GROUP BY host),
above AS (SELECT l.host, l.norm FROM lines l JOIN hosts h USING (host) GROUP BY l.host, l.norm, h.n
          HAVING count(DISTINCT l.text) > {LINE_LEAST} AND count(DISTINCT l.text) > least({LINE_MOST}, {LINE_SHARE} * h.n)),
gone AS (SELECT l.r, sum(l.n) AS n, sum(CASE WHEN a.norm IS NOT NULL THEN l.n ELSE 0 END) AS gone
         FROM lines l LEFT JOIN above a ON a.host = l.host AND a.norm = l.norm GROUP BY l.r),
base AS (SELECT d.r, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
                CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
                CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words FROM d LEFT JOIN dup USING (r) LEFT JOIN cov USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words)
       AND NOT coalesce(g.gone > 0 AND (g.n - g.gone < {REMAINING_WORDS} OR g.gone >= {REMOVED_SHARE} * g.n), false) AS kept
FROM base LEFT JOIN gone g USING (r)
"""
