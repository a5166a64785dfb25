"""Quality rules: base counts, and distance of a document to its language's usual distributions.  All in DataFrame operations.

Base counts are of words (runs of anything but ASCII white space), symbols, repeated
lines and words in repeated three-word windows.

References: for each language, over all documents, the shares of seven character classes
and of its COMMON most used words (all other words are one class).  A document of at least ``least`` words is kept if the Jensen-Shannon distance
(square root of the divergence in bits) of either histogram to its language's stays
within the limit; shorter ones and those that fail a base rule are not kept.  Documents
without a language are held against the sum of all.

Null and empty texts have no words and fail the base rules; repeated rows are each judged
and count each for the references.  Texts of any length are counted whole; equally used words are taken in
their order; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respondex.plans.staging import staged

#: Words of a reference; languages up to which references are broadcast (more are joined by a shuffle); parts in which a language's words are ranked first.
COMMON, LANGUAGES, PARTS = 40, 200, 64
#: Characters of the classes, stripped from a text in this order; what is left is the last class (fixed values).
CLASSES = {"lower": "a-z", "space": r"\x20\x09-\x0D", "wide": r"^\x00-\x7F", "upper": "A-Z", "digit": "0-9", "mark": r".,;:!?'\"()\-"}
SYMBOLS = "#*$%&|<>"
#: Largest distances of the two histograms.
LIMIT_CHARS, LIMIT_WORDS = 0.30, 0.50


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")


def letter_words(text: Column) -> Column:
    """Runs of letters, lower-cased."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda x: x != "")


def with_histograms(d: DataFrame) -> DataFrame:
    """Adds ``chars`` (characters of t in each class and in none), ``n_symbols``, ``lw`` (letter words) and their number ``letters``.

    Each class is taken from what the ones before left, so a text is read whole once.
    """
    columns, left, sizes = d.columns, "t", []
    for i, c in enumerate(CLASSES.values()):
        d = d.withColumn(f"r{i}", F.regexp_replace(left, f"[{c}]+", ""))
        sizes.append(F.length(left) - F.length(f"r{i}"))
        left = f"r{i}"
    chars = F.array(*[x.cast("double") for x in [*sizes, F.length(left)]])
    symbols = F.length(left) - F.length(F.regexp_replace(left, f"[{SYMBOLS}]+", ""))
    return d.select(*columns, chars.alias("chars"), symbols.cast("long").alias("n_symbols"), letter_words(F.col("t")).alias("lw")).withColumn("letters", F.size("lw"))


def counts(docs: DataFrame, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    """Whole texts to counts and small arrays; the text itself goes no further."""
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    d = docs.select(F.col(id_col).alias("id"), lang.alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    t = F.col("t")
    d = d.select("id", "lang", "t", words(t).alias("w"), F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    n = F.size("w")
    hashes = F.slice(F.transform("w", lambda x, i: F.xxhash64(x, F.get("w", i + 1), F.get("w", i + 2))), F.lit(1), F.greatest(n - 2, F.lit(0)))
    dup = (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")
    d = with_histograms(d.select("id", "lang", "t", n.cast("long").alias("n_words"), dup.alias("n_dup_lines"), hashes.alias("h"))).drop("t")
    d = d.withColumn("word_chars", (F.aggregate("chars", F.lit(0.0), lambda a, x: a + x) - F.col("chars")[1]).cast("long"))
    # windows in order of their hashes: equal ones are neighbours
    d = d.withColumn("s", F.when(F.size(F.array_distinct("h")) < F.size("h"), F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    twice = lambda x, k: (F.get("s", k + 1)["h"] == x["h"]) | F.when(k > 0, F.get("s", k - 1)["h"] == x["h"]).otherwise(False)
    d = d.withColumn("at", F.array_sort(F.transform(F.filter("s", lambda x, k: F.coalesce(twice(x, k), F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate(F.transform("at", lambda x, k: F.least(F.lit(3), F.coalesce(F.get("at", k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x)
    return d.select("id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "chars", "letters", "lw")


def references(counted: DataFrame) -> DataFrame:
    """``(ref, chars array<double>, common array<struct<word,share>>)`` for each language; ref ``*`` is the sum of all."""
    d = counted.select(F.coalesce("lang", F.lit("*")).alias("lang"), "chars", "letters", "lw")
    entry = lambda kind, key, n: F.struct(F.lit(kind).alias("kind"), key.alias("key"), n.alias("n"))
    sums = [entry("c", F.lit(f"{i}"), F.col("chars")[i]) for i in range(len(CLASSES) + 1)] + [entry("n", F.lit(""), F.col("letters").cast("double"))]
    once = d.select("lang", F.inline(F.array(*sums))).groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    used = d.select("lang", F.explode("lw").alias("key")).groupBy("lang", "key").agg(F.count("*").cast("double").alias("n"))
    each = staged(used.select("lang", F.lit("w").alias("kind"), "key", "n").unionByName(once), "rule-counts")
    every = each.groupBy("kind", "key").agg(F.sum("n").alias("n")).select(F.lit("*").alias("lang"), "kind", "key", "n")
    table = each.where("lang <> '*'").unionByName(every)
    top = ranked(table)
    whole = table.where("kind = 'n'").select("lang", F.col("n").alias("total"))
    chars = table.where("kind = 'c'").groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("key").cast("int").alias("k"), "n"))), lambda x: x["n"]).alias("c"))
    out = chars.join(whole, "lang").join(top, "lang", "left")
    share = lambda x: F.struct(x["key"].alias("word"), F.try_divide(x["n"], F.col("total")).alias("share"))
    return staged(out.select(F.col("lang").alias("ref"), F.transform("c", lambda x: F.try_divide(x, F.aggregate("c", F.lit(0.0), lambda a, y: a + y))).alias("ref_chars"), F.transform("common", share).alias("common")), "rule-references")


def ranked(table: DataFrame) -> DataFrame:
    """The COMMON most counted words of each language; ties by the word.  Those of PARTS parts of a language's words come first, so no task ranks all of them."""
    top = table.where("kind = 'w'").withColumn("part", F.pmod(F.xxhash64("key"), F.lit(PARTS)))
    for by in (["lang", "part"], ["lang"]):
        top = top.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "key"))).where(F.col("rank") <= COMMON)
    return top.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("key", "n"))).alias("common"))


def js_term(p: Column, q: Column) -> Column:
    """Twice an entry's part of the divergence in bits."""
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    return part(p) + part(q)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", least: int = 50, limit_chars: float = LIMIT_CHARS, limit_words: float = LIMIT_WORDS) -> DataFrame:
    """Counts, distances and verdict of every row.

    ``(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, js_chars, js_words, base_failed, kept)``
    """
    d = staged(counts(docs, id_col, text_col, lang_col), "rule-documents", "zstd")
    refs = references(d)
    # every language of a document has a row; none looks up the sum of all
    side = refs.withColumnRenamed("common", "ref_words")
    d = d.withColumn("ref", F.coalesce("lang", F.lit("*"))).join(F.broadcast(side) if refs.count() <= LANGUAGES + 1 else side, "ref", "left")
    total = F.aggregate("chars", F.lit(0.0), lambda a, x: a + x)
    d = d.withColumn("total", total)
    js_chars = F.aggregate(F.zip_with("chars", "ref_chars", lambda c, q: js_term(c / F.col("total"), q)), F.lit(0.0), lambda a, x: a + x) / 2
    # counts of the document's common words as lengths of runs in sorted order
    names = F.transform("ref_words", lambda r: r["word"])
    longest = F.array_max(F.transform("ref_words", lambda r: F.length(r["word"])))
    d = d.withColumn("names", names).withColumn("longest", longest)
    d = d.withColumn("common", F.array_sort(F.filter("lw", lambda x: (F.length(x) <= F.col("longest")) & F.array_contains("names", x)))).drop("lw")
    ends = F.filter(F.transform("common", lambda x, i: F.when(F.coalesce(F.get("common", i + 1) != x, F.lit(True)), F.struct(x.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
    d = d.withColumn("ends", ends)
    count = lambda x, i: x["i"] - F.when(i > 0, F.get("ends", i - 1)["i"]).otherwise(-1)
    share = lambda x: F.get("ref_words", F.array_position("names", x["w"]).cast("int") - 1)["share"]
    d = d.withColumn("seen", F.transform("ends", lambda x, i: F.struct((count(x, i) / F.col("letters")).alias("p"), share(x).alias("q"))))
    absent = F.aggregate("ref_words", F.lit(0.0), lambda a, r: a + r["share"]) - F.aggregate("seen", F.lit(0.0), lambda a, x: a + x["q"])
    other_p = F.greatest(F.lit(0.0), 1.0 - F.aggregate("seen", F.lit(0.0), lambda a, x: a + x["p"]))
    other_q = F.greatest(F.lit(0.0), 1.0 - F.aggregate("ref_words", F.lit(0.0), lambda a, r: a + r["share"]))
    # an absent word's term is its share: q log2(q / (q / 2))
    js_words = (F.aggregate("seen", F.lit(0.0), lambda a, x: a + js_term(x["p"], x["q"])) + F.greatest(F.lit(0.0), absent) + js_term(other_p, other_q)) / 2
    judge = (F.col("letters") > 0) & (F.col("total") > 0)
    d = d.withColumn("js_chars", F.when(judge, F.sqrt(F.greatest(js_chars, F.lit(0.0))))).withColumn("js_words", F.when(judge, F.sqrt(F.greatest(js_words, F.lit(0.0)))))
    d = d.withColumn("base_failed", (F.col("n_words") < least) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    kept = ~F.col("base_failed") & (F.coalesce("js_chars", F.lit(1.0)) <= limit_chars) & (F.coalesce("js_words", F.lit(1.0)) <= limit_words)
    return d.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "js_chars", "js_words", "base_failed", kept.alias("kept"))


def op9(spark, sf_dir: str) -> DataFrame:
    """Contract query: every document, production limits."""
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("js_chars", "js_words")


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '*') AS lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls, regexp_extract_all(lower(t), '\p{L}+') AS lw FROM t),
cls AS (SELECT r, doc_id, lang, len(w) AS n_words, length(t) - length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS c1, length(t) AS total, length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines, len(lw) AS letters,
  length(t) - length(regexp_replace(t, '[a-z]+', '', 'g')) AS c0, length(t) - length(regexp_replace(t, '[^\x00-\x7F]+', '', 'g')) AS c2, length(t) - length(regexp_replace(t, '[A-Z]+', '', 'g')) AS c3, length(t) - length(regexp_replace(t, '[0-9]+', '', 'g')) AS c4, length(t) - length(regexp_replace(t, '[.,;:!?''"()-]+', '', 'g')) AS c5 FROM w),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS k FROM win) WHERE k > 1) GROUP BY 1),
sw AS (SELECT r, lang, x AS word FROM (SELECT r, lang, unnest(lw) AS x FROM w)),
wide AS (SELECT lang AS ref, letters, c0, c1, c2, c3, c4, c5, total FROM cls WHERE lang <> '*' UNION ALL SELECT '*', letters, c0, c1, c2, c3, c4, c5, total FROM cls),
ref AS (SELECT ref, sum(letters) AS letters, sum(c0) / sum(total) AS q0, sum(c1) / sum(total) AS q1, sum(c2) / sum(total) AS q2, sum(c3) / sum(total) AS q3, sum(c4) / sum(total) AS q4, sum(c5) / sum(total) AS q5, 1 - (sum(c0) + sum(c1) + sum(c2) + sum(c3) + sum(c4) + sum(c5)) / sum(total) AS q6 FROM wide GROUP BY 1),
rw AS (SELECT ref, word, n / letters AS q FROM (SELECT ref, word, count(*) AS n FROM (SELECT lang AS ref, word FROM sw WHERE lang <> '*' UNION ALL SELECT '*', word FROM sw) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY ref ORDER BY count(*) DESC, word) <= 40) JOIN ref USING (ref)),
dw AS (SELECT r, lang, word, count(*) AS n FROM sw GROUP BY 1, 2, 3),
jw AS (SELECT c.r, sum(CASE WHEN n > 0 THEN n / letters * log2(n / letters / ((n / letters + q) / 2)) ELSE 0 END + q * log2(q / ((coalesce(n, 0) / letters + q) / 2))) AS s, greatest(0, 1 - sum(coalesce(n, 0)) / any_value(letters)) AS p, greatest(0, 1 - sum(q)) AS q FROM cls c JOIN rw ON ref = lang LEFT JOIN dw ON dw.r = c.r AND dw.word = rw.word WHERE letters > 0 GROUP BY 1),
js AS (SELECT r, sqrt(greatest(0, (s + CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS js_words FROM jw),
ch AS (SELECT r, sqrt(greatest(0, sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)) AS js_chars FROM (SELECT r, unnest([c0 / total, c1 / total, c2 / total, c3 / total, c4 / total, c5 / total, (total - c0 - c1 - c2 - c3 - c4 - c5) / total]) AS p, unnest([q0, q1, q2, q3, q4, q5, q6]) AS q FROM cls JOIN ref ON ref = lang WHERE total > 0) GROUP BY 1)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(total - c1 AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
  n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words) AND coalesce(js_chars, 1) <= 0.3 AND coalesce(js_words, 1) <= 0.5 AS kept
FROM cls LEFT JOIN rep USING (r) LEFT JOIN js USING (r) LEFT JOIN ch USING (r)
"""
