"""Quality rules as a bitmask ledger, in DataFrame functions only.

``ledger`` evaluates every rule once for each text and keeps the measurements and one integer of failure bits. Policies
are named masks over these bits: ``apply_policy`` judges without touching the text again, and ``ablation`` tells from the
ledger alone what each rule rejects, what it alone rejects, and what a policy without it would keep.

Null texts have no words: all measurements are 0. Lines and words are compared as they stand. Repeated rows give repeated
results; an empty table gives an empty ledger; other columns pass through ``keep`` only, so clashing names can't meet.
The word windows of a text are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only_new

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

#: Rule name to (bit, Spark SQL condition of failure). Bits never change their meaning; a new rule takes a new bit.
RULES: dict[str, tuple[int, str]] = {
    "few_words": (0, "n_words < 20"),
    "repeated_windows": (1, "100 * n_repeat_words > 30 * n_words"),
    "symbols": (2, "10 * n_symbols > 3 * n_words"),
    "duplicate_lines": (3, "n_dup_lines >= 2 and 10 * n_dup_lines > 3 * n_lines"),
    "short_words": (4, "word_chars < 2 * n_words"),
    "long_words": (5, "word_chars > 20 * n_words"),
    "shouting": (6, "2 * n_upper_words > n_words and n_words > 0"),
    "no_end_marks": (7, "n_words >= 200 and n_sentence_ends = 0"),
}


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules; a text is kept if none of them fails."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << RULES[r][0] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
PROSE = Policy("prose", 1, ("few_words", "repeated_windows", "symbols", "duplicate_lines", "short_words", "long_words", "shouting"))
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper_words", "n_sentence_ends")


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column) -> Column:
    """How many words lie in windows of ``WINDOW`` words that occur twice or more in the text.

    Windows are hashed, sorted with their positions, and kept where a neighbour in that order has the same hash; the
    kept positions, again sorted, each add the words up to the next one, ``WINDOW`` at most.
    """
    n = F.size(words)
    hashed = lambda ws: F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.struct(F.xxhash64(F.slice(ws, i, WINDOW)).alias("h"), i.alias("i")))
    same = lambda a, i: (F.get(a, i - 1)["h"] == F.get(a, i)["h"])
    # get() gives null before the first and after the last place
    twice = lambda a: F.filter(a, lambda x, i: F.coalesce(same(a, i), F.lit(False)) | F.coalesce(same(a, i + 1), F.lit(False)))
    places = bind(F.array_sort(bind(F.transform(words, lambda w: F.xxhash64(w)), hashed)), lambda a: F.array_sort(F.transform(twice(a), lambda x: x["i"])))
    covered = bind(places, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda s, x: s + x))
    return F.when(n >= WINDOW, covered).otherwise(F.lit(0)).cast("long")


def measures(text: Column) -> Column:
    """A struct of ``MEASURES``."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(F.translate(x, "\t\x0b\x0c\r", "    ")) != "")

    def of(ws: Column) -> Column:
        upper = F.size(F.filter(ws, lambda w: (F.upper(w) == w) & (F.lower(w) != w)))
        dup = bind(lines, lambda ls: F.struct(F.size(ls).cast("long").alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("d")))
        removed = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")
        return F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            removed(SYMBOLS).alias("n_symbols"),
            dup.alias("lines"),
            repeat_words(ws).alias("n_repeat_words"),
            upper.cast("long").alias("n_upper_words"),
            removed(".!?").alias("n_sentence_ends"),
        )

    return bind(words, of)


def failure_bits(rules: dict[str, tuple[int, str]] = RULES) -> Column:
    bits = [F.when(F.expr(condition), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")) for bit, condition in rules.values()]
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def ledger(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``keep``, the measurements, and ``fail_bits``. One projection: no shuffle, no Python."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    only_new([id_col, *keep], (*MEASURES, "fail_bits"))
    kept = [F.col(c).alias(f"__k{i}") for i, c in enumerate(keep)]
    base = docs.select(F.col(id_col).alias("__id"), *kept, measures(text).alias("__m"))
    at = {"n_lines": "lines.n", "n_dup_lines": "lines.d"}
    flat = base.select("__id", *[f"__k{i}" for i in range(len(keep))], *(F.col(f"__m.{at.get(c, c)}").alias(c) for c in MEASURES)).withColumn("fail_bits", failure_bits())
    return flat.withColumnsRenamed({"__id": id_col} | {f"__k{i}": c for i, c in enumerate(keep)})


def passes(policy: Policy, bits: str = "fail_bits") -> Column:
    return F.col(bits).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def apply_policy(ledger_df: DataFrame, policy: Policy, name: str = "kept") -> DataFrame:
    """The ledger with a verdict of ``policy``; the texts aren't read again."""
    return ledger_df.withColumn(name, passes(policy))


def ablation(ledger_df: DataFrame, policy: Policy) -> DataFrame:
    """A row for each rule of the policy: n_failed, n_failed_alone (that no other rule of it rejects), n_kept_without, n_docs.

    One aggregation over distinct bit patterns; the ledger may have any number of rows.
    """
    mask = F.lit(policy.mask).cast("long")
    patterns = ledger_df.groupBy(F.col("fail_bits").bitwiseAND(mask).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES[r][0]).cast("long").alias("bit")) for r in policy.rules)))
    spread = patterns.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    total = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0))
    return spread.groupBy("rule").agg(
        total(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        total(F.col("bits") == F.col("bit")).alias("n_failed_alone"),
        total(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0).alias("n_kept_without"),
        F.sum("n").alias("n_docs"),
    )


def filter_documents(docs: DataFrame, policy: Policy = PROSE, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, unchanged, that the policy keeps."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    at = {"n_lines": "lines.n", "n_dup_lines": "lines.d"}
    row = docs.select(F.struct("*").alias("__row"), measures(text).alias("__m"))
    judged = row.select("__row", *(F.col(f"__m.{at.get(c, c)}").alias(c) for c in MEASURES)).withColumn("fail_bits", failure_bits())
    return judged.where(passes(policy)).select("__row.*")


#: Base measures and the verdict of PROSE, for DuckDB.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t,
        list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, i, array_to_string(ws[i:i+7], ' ') AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g),
p AS (SELECT r, count(DISTINCT i + k) AS n FROM c, range(8) AS q(k) WHERE n > 1 GROUP BY r),
m AS (SELECT doc_id, len(ws) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
        length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words,
        len(list_filter(ws, lambda x: upper(x) = x AND lower(x) <> x)) AS n_upper_words
      FROM w LEFT JOIN p USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (10 * n_symbols > 3 * n_words) AND NOT (n_dup_lines >= 2 AND 10 * n_dup_lines > 3 * n_lines)
  AND NOT (word_chars < 2 * n_words) AND NOT (word_chars > 20 * n_words) AND NOT (2 * n_upper_words > n_words AND n_words > 0) AS kept
FROM b
"""
