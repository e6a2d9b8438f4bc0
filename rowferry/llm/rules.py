"""Quality rules: a table of thresholds compiled into one projection.

Every measure of a text is a built-in Spark expression over that row alone, so
the operator is one scan without a shuffle; a hot source or a group of copies
costs no more than other rows. Long texts are one row and are read whole.

Defined cases: a null text has no words; a text without words has all counts 0
and fails the base rules; repeated rows give repeated rows; other columns are
not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowferry.llm.common import bound

WORD = "[^\\x20\\x09-\\x0D]+"
SYMBOLS = "[#*$%&|<>]"

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it was for on are with as at be this by from or an "
    "der die das und den von zu mit sich auf ist im dem nicht ein eine als auch "
    "le la les et des un une du que est pour qui dans par sur au il elle en "
    "el los las y se del por con para su lo como más pero de no es"
).split()

#: (family, left, weight of left, comparison, right, weight of right): a text is
#: kept when every line holds. Whole numbers, so both engines agree exactly.
THRESHOLDS = (
    ("length: words", "n_words", 1, ">=", None, 50),
    ("length: mean word of 2 characters or more", "word_chars", 1, ">=", "n_words", 2),
    ("length: mean word of 14 characters or fewer", "word_chars", 1, "<=", "n_words", 14),
    ("repetition: words in repeated windows", "n_repeat_words", 100, "<=", "n_words", 50),
    ("symbols to words", "n_symbols", 10, "<=", "n_words", 3),
    ("stop words: one word in 25 or more", "n_stop_words", 25, ">=", "n_words", 1),
    ("lines: repeated to all", "n_dup_lines", 2, "<=", "n_lines", 1),
)

#: The first and fourth line are the base rules.
BASE = (THRESHOLDS[0], THRESHOLDS[3])


def compile_rules(rules=THRESHOLDS) -> Column:
    """One boolean expression over the measures' columns."""
    kept = F.lit(True)
    for _, left, times, sign, right, weight in rules:
        a = F.col(left) * F.lit(times).cast("long")
        b = F.lit(weight).cast("long") if right is None else F.col(right) * F.lit(weight).cast("long")
        kept = kept & ((a >= b) if sign == ">=" else (a <= b))
    return kept


def rules_sql(rules=THRESHOLDS) -> str:
    """The same table as a SQL condition."""
    return " and ".join(
        f"{left} * {times} {sign} {weight if right is None else f'{right} * {weight}'}"
        for _, left, times, sign, right, weight in rules
    )


def _repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more.

    Windows are compared by a 64-bit hash first; only texts with two equal
    hashes are sorted, and equal hashes count only if their words are equal.
    """

    def same(a, b):
        equal = (a["h"] == b["h"]) & (F.get(w, a["i"]) == F.get(w, b["i"]))
        for k in (1, 2):
            equal = equal & (F.get(w, a["i"] + k) == F.get(w, b["i"] + k))
        return F.coalesce(equal, F.lit(False))

    def starts(s):
        marked = F.transform(
            s, lambda p, k: F.when(same(p, F.get(s, k - 1)) | same(p, F.get(s, k + 1)), p["i"])
        )
        return F.sort_array(F.filter(marked, lambda i: i.isNotNull()))

    def covered(r):
        steps = F.transform(r, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(r, k + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(hashes):
        indexed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(
            F.size(F.array_distinct(hashes)) < F.size(hashes), bound(bound(indexed, starts), covered)
        ).otherwise(F.lit(0).cast("long"))

    windows = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3),
        lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
    )
    return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(bound(windows, count))


def measure(text: Column) -> Column:
    """All measures of one text as a struct."""
    text = F.coalesce(text, F.lit(""))

    def words(w):
        stop = F.filter(w, lambda x: F.rtrim(x, F.lit(".,;:")).isin(*STOP_WORDS))
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.concat_ws("", w)).cast("long").alias("word_chars"),
            F.size(stop).cast("long").alias("n_stop_words"),
            _repeat_words(w).alias("n_repeat_words"),
        )

    def lines(x):
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        )

    with_word = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return F.struct(
        bound(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), words).alias("w"),
        bound(with_word, lines).alias("l"),
        (F.size(F.split(text, SYMBOLS, -1)) - 1).cast("long").alias("n_symbols"),
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_lines")
HELPER = "__llm_measure"


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=THRESHOLDS) -> DataFrame:
    """doc_id, the measures, base_failed and kept, one row for each row of docs."""
    measured = docs.select(F.col(id_col).alias("doc_id"), measure(F.col(text_col)).alias(HELPER))
    flat = measured.select("doc_id", f"{HELPER}.w.*", f"{HELPER}.l.*", f"{HELPER}.n_symbols")
    failed = ~compile_rules(BASE)
    return flat.select(
        "doc_id", *MEASURES, failed.alias("base_failed"), (~failed & compile_rules(rules)).alias("kept")
    )


def keep_good(docs: DataFrame, text_col: str = "text", rules=THRESHOLDS) -> DataFrame:
    """The rows of docs that pass, with the columns of docs."""
    ones = {"w": MEASURES[:2] + ("n_repeat_words", "n_stop_words"), "l": ("n_lines", "n_dup_lines")}
    m = F.col(HELPER)
    flat = F.struct(
        *[m[part][name].alias(name) for part, names in ones.items() for name in names],
        m["n_symbols"].alias("n_symbols"),
    )
    kept = F.lit(True)
    for _, left, times, sign, right, weight in rules:
        a = F.col(HELPER)[left] * times
        b = F.lit(weight) if right is None else F.col(HELPER)[right] * weight
        kept = kept & ((a >= b) if sign == ">=" else (a <= b))
    measured = docs.withColumn(HELPER, measure(F.col(text_col))).withColumn(HELPER, flat)
    return measured.where(kept).select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') as w from d),
g as (select rid, unnest(range(1, len(w) - 1)) as i, w from w where len(w) >= 3),
n as (select rid, i, count(*) over (partition by rid, w[i], w[i + 1], w[i + 2]) as c from g),
r as (select rid, count(distinct p) as n_repeat_words
      from (select rid, i + unnest([0, 1, 2]) as p from n where c > 1) group by rid),
l as (select rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from w),
m as (select w.rid, doc_id, len(w) as n_words,
        coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars,
        len(regexp_extract_all(t, '{SYMBOLS}')) as n_symbols,
        (len(l) - len(list_distinct(l)))::bigint as n_dup_lines,
        coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
        len(list_filter(w, lambda x: list_contains({STOP_WORDS!r}, rtrim(x, '.,;:'))))::bigint as n_stop_words,
        len(l)::bigint as n_lines
      from w join l using (rid) left join r using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, n_lines,
  not ({rules_sql(BASE)}) as base_failed, ({rules_sql(BASE)}) and ({rules_sql()}) as kept
from m"""
