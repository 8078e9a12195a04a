"""Quality rules: a threshold table compiled into one projection, built-in functions only.

Defined cases: a null or blank text has no words and fails the base rule; very long texts cost time in
proportion to their words; repeated rows are judged alike, one result a row; further columns pass through
apply_rules() untouched unless they bear the name of a signal, which then is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE

BLANKS = r"[\x20\x09-\x0D]+"
WINDOW = 8
#: Frequent function words of the languages served, in lower case.
STOP_WORDS = (
    "the of and to in a is it that with for on as be this by are was he or an at from but not have "
    "der die und das ist von mit den zu ein eine im auf nicht des dem sich "
    "le la les de des et un une du en que qui dans pour pas sur est "
    "el los las y del se por con para su al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """A signal with its bounds; None leaves a side open."""

    signal: str
    least: float | None = None
    most: float | None = None


#: The production thresholds.
RULES = (
    Rule("n_words", least=20),
    Rule("repeat_ratio", most=0.30),
    Rule("mean_word_chars", least=1.5, most=24),
    Rule("symbol_ratio", most=0.25),
    Rule("shout_ratio", most=0.25),
    Rule("stop_ratio", least=0.02),
    Rule("dup_line_ratio", most=0.30),
)


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def _window(words: Column, i: Column) -> list[Column]:
    return [F.get(words, i + k) for k in range(WINDOW)]


def _covered(words: Column, n: Column) -> Column:
    """Words in windows that occur twice or more: sort the windows' 128-bit hashes with their places, keep those
    that equal a neighbour, and add up what the kept places cover in order."""
    places = F.sequence(F.lit(0), n - WINDOW)
    rows = F.sort_array(F.transform(places, lambda i: F.struct(F.xxhash64(*_window(words, i)).alias("a"), F.xxhash64(F.lit(7), *_window(words, i)).alias("b"), i.alias("i"))))

    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x["a"] == y["a"]) & (x["b"] == y["b"]), F.lit(False))

    starts = _let(rows, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1))), lambda x: x["i"])))
    steps = _let(starts, lambda d: F.aggregate(F.transform(d, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(d, j + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x))
    return steps.cast("long")


#: Names of the counts that signals() makes in one projection; ratios and verdicts follow.
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_shouts", "n_stop_words", "__repeats")


def signals(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the counts and ratios that the rules speak of; columns of these names are replaced."""
    t = F.coalesce(F.col(text), F.lit(""))
    core = F.btrim(t, F.lit(WHITE))
    df = df.withColumn("__words", F.when(core == "", F.array().cast("array<string>")).otherwise(F.split(core, BLANKS)))
    words = F.col("__words")
    df = df.withColumn("__lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("__hashes", F.transform(words, lambda w: F.xxhash64(w)))
    for step in (1, 2, 4):  # hashes of 2, 4 and 8 words in order, from those of half as many
        h = F.col("__hashes")
        left = F.greatest(F.size(h) - step, F.lit(0))
        df = df.withColumn("__hashes", F.zip_with(F.slice(h, F.lit(1), left), F.slice(h, F.lit(1 + step), left), lambda x, y: F.xxhash64(x, y)))
    forms = sorted({f for w in STOP_WORDS for f in (w, w.capitalize())})
    df = df.select(
        *[F.col(f"`{c}`") for c in df.columns if c not in ("__lines", "__hashes", *SIGNALS)],
        F.size(words).cast("long").alias("n_words"),
        F.length(_without(t, WHITE)).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        (F.size(F.array_distinct("__hashes")) < F.size("__hashes")).alias("__repeats"),
        (F.length(t) - F.length(_without(t, "!"))).cast("long").alias("n_shouts"),
        F.size(F.filter(words, lambda w: F.rtrim(w, F.lit(",.;:!?")).isin(forms))).cast("long").alias("n_stop_words"),
    )
    df = df.withColumn("n_repeat_words", F.when(F.col("__repeats"), _covered(words, F.size(words))).otherwise(F.lit(0).cast("long")))
    n, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return df.withColumns({
        "repeat_ratio": F.col("n_repeat_words") / n,
        "mean_word_chars": F.col("word_chars") / n,
        "symbol_ratio": F.col("n_symbols") / n,
        "shout_ratio": F.col("n_shouts") / n,
        "stop_ratio": F.col("n_stop_words") / n,
        "dup_line_ratio": F.col("n_dup_lines") / lines,
    }).drop("__words", "__repeats")


def compile_rules(rules=RULES) -> tuple[Column, Column]:
    """The verdict, and the names of the rules that fail, as two expressions over the signals."""
    checks = []
    for r in rules:
        ok = F.lit(True)
        if r.least is not None:
            ok = ok & (F.col(r.signal) >= F.lit(r.least))
        if r.most is not None:
            ok = ok & (F.col(r.signal) <= F.lit(r.most))
        checks.append((r.signal, ok))
    verdict = F.lit(True)
    for _, ok in checks:
        verdict = verdict & ok
    return verdict, F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in checks]), lambda x: x.isNotNull())


def apply_rules(df: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """df with its signals, kept (all rules hold) and failed (the names of those that don't)."""
    verdict, failed = compile_rules(rules)
    return signals(df, text).withColumns({"kept": verdict, "failed": failed})


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return apply_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("kept")).alias("kept"),
    )


_STOPS_SQL = ", ".join(f"'{f}'" for f in sorted({f for w in STOP_WORDS for f in (w, w.capitalize())}))
SQL_OP8 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), g AS (
  SELECT rid, unnest(range(1, len(ws) - 6)) AS i, unnest(list_transform(range(1, len(ws) - 6), lambda i: ws[i:i+7])) AS win FROM w WHERE len(ws) >= 9
), k AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM g
), s AS (
  SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS step FROM k WHERE c > 1
), r AS (
  SELECT rid, sum(step)::BIGINT AS n_repeat_words FROM s GROUP BY rid
), f AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(ls) AS n_lines, len(regexp_extract_all(t, '!')) AS n_shouts,
         len(list_filter(ws, lambda x: rtrim(x, ',.;:!?') IN ({_STOPS_SQL}))) AS n_stop
  FROM w LEFT JOIN r USING (rid)
), v AS (
  SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, greatest(n_words, 1)::DOUBLE AS n FROM f
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND n_repeat_words / n <= 0.30 AND word_chars / n BETWEEN 1.5 AND 24 AND n_symbols / n <= 0.25
        AND n_shouts / n <= 0.25 AND n_stop / n >= 0.02 AND n_dup_lines / greatest(n_lines, 1)::DOUBLE <= 0.30) AS kept
FROM v
"""
