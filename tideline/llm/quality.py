r"""Quality rules: a table of thresholds compiled into one Spark projection, without user functions.

Words are runs without white space (``[^\x20\x09-\x0D]+``). ``measured`` adds to each document counts of words, letters,
symbols, lines and repeats, and ratios of them; ``judged`` turns rows of (name, measure, least, most) into one boolean
each, their conjunction, and the list of the names that fail. A bound that is null is open; a measure that is null
(a ratio of nothing) fails each rule that has a bound on it.

Words in repeated windows: the hashes of all three-word windows of a text, and, if one of them comes twice, the windows
themselves sorted by hash, text and place, so that equal ones are neighbours; the words that those cover are counted
once each. Work on a text of n words is n log n, in one row, whatever it repeats.

Cases: null, empty and blank texts have no words and no lines, fail the least number of words and aren't kept; a text is
one row of any length; repeated rows and null ids are judged like any other; an empty table gives no rows; columns
beside doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Signs that running text has few of; the base symbols are among them.
MARKS = SYMBOLS + "!?=@^~_{}\\/[]+"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the of and to in a is that it for was with as on be at by this are or from "
    "le la les de des du et un une en est que qui dans pour par sur au "
    "der die das und ist von zu den mit ein eine nicht auf für im dem "
    "el los las y que del se por con una para al lo como su"
).split()

#: (name, measure, least, most). The first two are the base rules.
RULES = (
    ("few_words", "n_words", 50, None),
    ("repeated_words", "repeat_ratio", None, 0.5),
    ("word_length", "mean_word", 2, 12),
    ("symbols", "symbol_ratio", None, 0.1),
    ("marks", "mark_ratio", None, 0.5),
    ("stop_words", "stop_ratio", 0.02, None),
    ("repeated_lines", "dup_line_ratio", None, 0.3),
    ("bullet_lines", "bullet_ratio", None, 0.9),
    ("ellipsis_lines", "ellipsis_ratio", None, 0.3),
)
BASE = {"few_words", "repeated_words"}


def _count(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    kept = "".join("\\" + c if c in r"\[]^-&" else c for c in chars)
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")


def _repeated(documents: DataFrame) -> DataFrame:
    """Adds n_repeat_words to rows that have __w, the array of words."""
    size = F.size("__w")
    of = lambda i, f: F.slice(F.transform("__w", lambda x, j: F.when(j < size - 2, f(x, F.get("__w", j + 1), F.get("__w", j + 2), j))), 1, F.greatest(size - 2, F.lit(0)))
    out = documents.withColumn("__h", of(0, lambda a, b, c, _: F.xxhash64(a, b, c)))
    twice = F.size(F.array_distinct("__h")) < F.size("__h")
    windows = of(0, lambda a, b, c, j: F.struct(F.xxhash64(a, b, c).alias("h"), F.concat_ws(" ", a, b, c).alias("s"), j.alias("i")))
    out = out.withColumn("__s", F.when(twice, F.sort_array(windows)))
    beside = lambda x, k: F.get("__s", k)["s"] == x["s"]
    found = F.filter(F.transform("__s", lambda x, k: F.when(F.coalesce(beside(x, k - 1), F.lit(False)) | F.coalesce(beside(x, k + 1), F.lit(False)), x["i"])), lambda i: i.isNotNull())
    covered = F.size(F.array_distinct(F.flatten(F.transform(found, lambda i: F.array(i, i + 1, i + 2)))))
    return out.withColumn("n_repeat_words", F.when(F.col("__s").isNull(), 0).otherwise(covered).cast("long")).drop("__h", "__s")


def measured(documents: DataFrame) -> DataFrame:
    """doc_id and the measures of each whole text."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select("doc_id", text.alias("__t")).withColumn("__w", F.array_remove(F.split("__t", SPACE), ""))
    rows = rows.withColumn("__l", F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = _repeated(rows)
    n, lines = F.size("__w"), F.size("__l")
    share = lambda x, of: x / F.when(of > 0, of)
    like = lambda pattern: F.size(F.filter("__l", lambda x: x.rlike(pattern)))
    out = rows.select(
        "doc_id", n.cast("long").alias("n_words"), F.length(F.array_join("__w", "")).cast("long").alias("word_chars"), _count(F.col("__t"), SYMBOLS).alias("n_symbols"),
        (lines - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"), "n_repeat_words", _count(F.col("__t"), MARKS).alias("n_marks"), lines.cast("long").alias("n_lines"),
        F.size(F.filter("__w", lambda x: x.isin(*STOP_WORDS, *[w.capitalize() for w in STOP_WORDS]))).cast("long").alias("n_stop_words"),
        like(r"^[\x20\x09-\x0D]*[-*•‣◦]").cast("long").alias("n_bullets"), like(r"([.][.][.]|…)[\x20\x09-\x0D]*$").cast("long").alias("n_ellipses"),
    )
    words, by_line = F.col("n_words"), F.col("n_lines")
    ratios = {"mean_word": ("word_chars", words), "symbol_ratio": ("n_symbols", words), "mark_ratio": ("n_marks", words), "stop_ratio": ("n_stop_words", words), "repeat_ratio": ("n_repeat_words", words), "dup_line_ratio": ("n_dup_lines", by_line), "bullet_ratio": ("n_bullets", by_line), "ellipsis_ratio": ("n_ellipses", by_line)}
    return out.select("*", *[share(F.col(c), of).alias(name) for name, (c, of) in ratios.items()])


def holds(measure: Column, least, most) -> Column:
    """Whether a measure lies within its bounds."""
    out = F.lit(True)
    if least is not None:
        out = out & (measure >= F.lit(least))
    if most is not None:
        out = out & (measure <= F.lit(most))
    return F.coalesce(out, F.lit(False))


def judged(measures: DataFrame, rules: Iterable[tuple] | DataFrame = RULES) -> DataFrame:
    """Adds failed (array of rules' names, in the order of the table) and kept to a table of measures.

    ``rules`` may be a table with columns name, measure, least, most: a row a rule, so it is small, and the order is that of the names.
    """
    if isinstance(rules, DataFrame):
        rules = [tuple(r) for r in rules.select("name", "measure", "least", "most").orderBy("name").collect()]
    failed = F.array_compact(F.array(*[F.when(~holds(F.col(measure), least, most), F.lit(name)) for name, measure, least, most in rules]).cast("array<string>"))
    return measures.withColumn("failed", failed).withColumn("kept", F.size("failed") == 0)


def judge(documents: DataFrame, rules: Iterable[tuple] | DataFrame = RULES) -> DataFrame:
    """Measures, failed rules and verdict of each document."""
    return judged(measured(documents), rules)
