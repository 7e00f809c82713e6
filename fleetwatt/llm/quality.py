"""Quality rules by distribution divergence, in DataFrame operations alone.

Two histograms of a document, of character classes (small letters, capitals, digits, punctuation, others) and of its
language's COMMON most frequent short words (and short tokens without letter or digit, and all the rest), are held against the sums over all documents of that
language by the Jensen-Shannon distance (base 2, 0 to 1). A document fails if either distance exceeds its limit.
Guards: documents of fewer than LEAST_WORDS words, and languages of fewer than LEAST_LANGUAGE words, aren't judged by distance.

Null text counts as empty. A null language is a language of its own. Rows are independent; repeated rows get equal
results. An empty table gives an empty result. Work on a document is proportional to its length, whatever that is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetwatt.session import checkpointed

#: Limits of the two distances.
CLASS_LIMIT = 0.32
WORD_LIMIT = 0.42

#: Guards, in words.
LEAST_WORDS = 50
LEAST_LANGUAGE = 1000

#: Common words of a language's histogram, and their length at most.
COMMON = 20
SHORT = 5

#: Languages whose tables are sent to all tasks; with more of them the rows are shuffled.
LANGUAGES = 2000

#: Base rules.
WINDOW = 5
BASE_WORDS = 10
BASE_REPEAT_PERCENT = 20

GAPS = r"[\x20\x09-\x0D]+"
PUNCTUATION = r"[.,;:!?'\"()-]"
SYMBOLS = r"[#*$%&|<>]"
LETTERS = [chr(97 + i) for i in range(COMMON)]

#: Stands for a short token without letter or digit.
MARK = "!"


def word_list(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAPS), lambda w: w != "")


def sorted_windows(g: Column) -> Column:
    """Hashes of windows with their places, equal ones together; null if all differ."""
    return F.when(F.size(F.array_distinct(g)) < F.size(g), F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i")))))


def repeated(s: Column) -> Column:
    """Places of windows that stand twice or more, in order."""
    twice = F.transform(s, lambda x, i: F.when((F.get(s, i - 1)["g"] == x["g"]) | (F.get(s, i + 1)["g"] == x["g"]), x["i"]))
    return F.sort_array(F.filter(twice, lambda i: i.isNotNull()))


def covered(at: Column) -> Column:
    """How many words the windows at these sorted places cover."""
    new = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
    return F.aggregate(new, F.lit(0), lambda a, x: a + x)


def common_words(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, letters): each language's common words, each with a letter that stands for it."""
    short = F.filter(word_list(F.col(text)), lambda w: F.length(w) <= SHORT)
    w = docs.select(F.col(lang).cast("string").alias("lang"), F.explode(short).alias("w")).select("lang", F.lower("w").alias("w")).groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n"))
    w = w.filter(F.col("w").rlike(r"^\p{L}+$"))
    best = lambda *by: Window.partitionBy(*by).orderBy(F.desc("n"), "w")
    some = w.withColumn("part", F.pmod(F.xxhash64("w"), F.lit(16))).withColumn("r", F.row_number().over(best("lang", "part"))).filter(F.col("r") <= COMMON)
    top = some.withColumn("r", F.row_number().over(best("lang"))).filter(F.col("r") <= COMMON)
    # COMMON entries a language
    return top.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("w", F.substring(F.lit("".join(LETTERS)), F.col("r"), F.lit(1))))).alias("letters"))


def small(rows: DataFrame) -> DataFrame:
    """A table of one row a language, sent to all tasks if it is small; texts then aren't shuffled by language."""
    return F.broadcast(rows) if rows.count() <= LANGUAGES else rows


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, commons) of every row."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    known = small(checkpointed(common_words(docs, text, lang)))
    rows = rows.alias("r").join(known.alias("k"), F.col("r.lang").eqNullSafe(F.col("k.lang")), "left").select("id", "r.lang", "text", "letters")
    full = F.filter(F.split(F.col("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    a = rows.select("id", "lang", "letters", word_list(F.col("text")).alias("ws"), full.alias("lines"))
    hits = F.transform("ws", lambda w: F.when(F.length(w) <= SHORT, F.coalesce(F.try_element_at("letters", F.lower(w)), F.when(w.rlike(r"^[^\p{L}\p{N}]+$"), MARK), F.lit(""))).otherwise(F.lit("")))
    b = a.select(
        "id",
        "lang",
        F.size("ws").cast("bigint").alias("n_words"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.concat_ws("", "ws").alias("body"),
        F.transform("ws", lambda w: F.xxhash64(w)).alias("h"),
        F.concat_ws("", hits).alias("hits"),
    )
    h = F.col("h")
    grams = F.transform(F.slice(h, F.lit(1), F.greatest(F.lit(0), F.size(h) - (WINDOW - 1))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))
    c = b.select(
        "id", "lang", "n_words", "n_dup_lines", "hits",
        F.length("body").cast("bigint").alias("word_chars"),
        F.regexp_count("body", F.lit(r"\p{Lu}")).cast("bigint").alias("upper"),
        F.regexp_replace("body", r"\p{L}+", "").alias("rest"),
        grams.alias("g"),
    )
    d = c.select(
        "id", "lang", "n_words", "word_chars", "n_dup_lines", "hits", "upper",
        F.length("rest").cast("bigint").alias("others"),
        F.regexp_count("rest", F.lit("[0-9]")).cast("bigint").alias("digits"),
        F.regexp_count("rest", F.lit(PUNCTUATION)).cast("bigint").alias("marks"),
        F.regexp_count("rest", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        sorted_windows(F.col("g")).alias("s"),
    )
    # a lambda reads arrays of an earlier projection; an expression in it would be worked out for every element
    d = d.select("*", repeated(F.col("s")).alias("places"))
    classes = F.array(F.col("word_chars") - F.col("others") - F.col("upper"), "upper", "digits", "marks", F.col("others") - F.col("digits") - F.col("marks"))
    counts = [F.length("hits") - F.length(F.replace(F.col("hits"), F.lit(x), F.lit(""))) for x in [*LETTERS, MARK]]
    commons = F.transform(F.array(*counts, F.col("n_words") - F.length("hits")), lambda x: x.cast("bigint"))
    return d.select("id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered(F.col("places")), F.lit(0)).cast("bigint").alias("n_repeat_words"), classes.alias("classes"), commons.alias("commons"))


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts; 0 if either is empty."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))
    part = lambda x: F.transform(x, lambda v: v.cast("double") / F.greatest(total(x), F.lit(1.0)))
    term = lambda x, y: F.when(x > 0, x * F.log2(x / ((x + y) / 2))).otherwise(F.lit(0.0))
    both = F.aggregate(F.zip_with(part(p), part(q), lambda x, y: (term(x, y) + term(y, x)) / 2), F.lit(0.0), lambda a, v: a + v)
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(F.lit(0.0), both))).otherwise(F.lit(0.0))


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Features, distances rounded to 9 digits, base_failed and kept of every row."""
    rows = checkpointed(features(docs, doc_id, text, lang))
    sums = [F.sum(F.get("classes", F.lit(i))) for i in range(5)]
    words = [F.sum(F.get("commons", F.lit(i))) for i in range(COMMON + 2)]
    reference = rows.groupBy("lang").agg(F.array(*sums).alias("ref_classes"), F.array(*words).alias("ref_commons"), F.sum("n_words").alias("ref_words"))
    x = rows.alias("r").join(small(checkpointed(reference)).alias("f"), F.col("r.lang").eqNullSafe(F.col("f.lang")))
    x = x.select("r.*", "ref_words", F.round(distance(F.col("classes"), F.col("ref_classes")), 9).alias("class_distance"), F.round(distance(F.col("commons"), F.col("ref_commons")), 9).alias("word_distance"))
    failed = (F.col("n_words") < BASE_WORDS) | (100 * F.col("n_repeat_words") > BASE_REPEAT_PERCENT * F.col("n_words"))
    far = (F.col("class_distance") > CLASS_LIMIT) | (F.col("word_distance") > WORD_LIMIT)
    guarded = (F.col("n_words") < LEAST_WORDS) | (F.col("ref_words") < LEAST_LANGUAGE)
    return x.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", failed.alias("base_failed"), (~failed & (guarded | ~far)).alias("kept"))
