"""Quality rules by weak supervision, with DataFrame functions only.

Each rule looks at a few measures of a text and votes or abstains: some rules vote bad (-1) when they see a fault,
others vote good (1) when they see what prose has. Nobody says which rules to believe: expectation-maximisation
finds, from how the rules agree over all documents, how often each votes on good documents and how often on bad ones,
and how common good documents are. A document's verdict is the posterior probability that it is good, so a believable
fault outweighs much praise and a fault that good documents often have outweighs none. A bad document need not have
more than one fault: the priors say that a fault is rare in good documents and in a bad one each of them is unlikely.

The documents enter the estimation as a histogram of vote patterns, of which there are 2 ** len(RULES) at most
(512), whatever the corpus; it is gathered into one row and the iterations run over it in one expression. Nothing
is collected to the driver. Measures are written to the shared folder once, so texts are read once.

Repeated words are found by 64-bit hashes of five-word windows compared within a text only: sorting the hashes with
their places costs n log n for any repetition. Defined cases: a null text is an empty one (no words, so the base
test fails); null identifiers and repeated rows are documents like others; an empty table gives an empty result;
columns other than the text and those carried on request are not read, and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sahifa.cluster import materialize

SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"
WINDOW, MIN_WORDS, MAX_REPEATED = 5, 10, 20
ITERATIONS, THRESHOLD = 30, 0.5
#: Priors as pseudo-counts: good and bad documents; then votes and abstentions, on good and on bad documents.
PRIOR_GOOD = (4.0, 1.0)
PRIOR_FAULT, PRIOR_PRAISE = ((0.02, 9.98), (2.0, 8.0)), ((9.0, 1.0), (3.0, 7.0))
#: A word as prose has it: one capital at most, and no more around it than punctuation.
PLAIN = r"""^["'(«„]?\p{L}[\p{Ll}\p{Lo}\p{M}'’-]*[.,;:!?…)"'»]{0,3}$"""
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measures(df: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``carry``, renamed to ``_0``, ``_1`` and so on, and the measures of each text.

    The steps are projections of their own because each uses what the one before it made more than once.
    """
    kept = [f"_{i}" for i in range(len(carry))]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    step = df.select(*(F.col(c).alias(k) for c, k in zip(carry, kept, strict=True)), text.alias("t"))
    trimmed = F.btrim("t", F.lit(SPACE_CHARS))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE))
    lines = F.filter(F.split("t", "\n"), lambda line: F.btrim(line, F.lit(SPACE_CHARS)) != "")
    step = step.select(*kept, words.alias("w"), lines.alias("l"), F.regexp_count("t", F.lit(SYMBOLS)).alias("n_symbols"), F.regexp_count("t", F.lit("[A-Z]")).alias("n_upper"))
    starts = F.when(F.size("w") >= WINDOW, F.sequence(F.lit(0), F.size("w") - WINDOW)).otherwise(F.array().cast("array<int>"))
    ends_well = F.filter("l", lambda line: F.right(F.btrim(line, F.lit(SPACE_CHARS)), F.lit(1)).isin(".", "!", "?"))
    step = step.select(
        *kept, "n_symbols", "n_upper", F.size("w").alias("n_words"), F.length(F.array_join("w", "")).alias("word_chars"), F.size(F.array_distinct("w")).alias("n_distinct"),
        F.size(F.filter("w", lambda word: word.rlike(PLAIN))).alias("n_plain"),
        F.size("l").alias("n_lines"), (F.size("l") - F.size(F.array_distinct("l"))).alias("n_dup_lines"), F.size(ends_well).alias("n_ended"),
        F.transform(starts, lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(WINDOW)))).alias("h"),
    )
    rest = [c for c in step.columns if c != "h"]
    placed = F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    step = step.select(*rest, F.when(F.size("h") > F.size(F.array_distinct("h")), F.sort_array(placed)).otherwise(none).alias("s"))
    places = F.when(F.size("s") > 0, F.sequence(F.lit(0), F.size("s") - 1)).otherwise(F.array().cast("array<int>"))
    same = lambda i, j: F.get("s", i)["h"].eqNullSafe(F.get("s", j)["h"])
    twice = F.filter(places, lambda i: same(i, i - 1) | same(i, i + 1))
    step = step.select(*rest, F.sort_array(F.transform(twice, lambda i: F.get("s", i)["i"])).alias("p"))
    # A window covers as far as the next one begins, or all its words.
    covered = F.zip_with("p", F.slice("p", F.lit(2), F.greatest(F.size("p"), F.lit(1))), lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    step = step.select(*rest, F.aggregate(covered, F.lit(0), lambda a, x: a + x).alias("n_repeat_words"))
    return step.select(*kept, *(F.col(c).cast("long").alias(c) for c in (*MEASURES, "n_distinct", "n_plain", "n_lines", "n_ended", "n_upper")))


def faults() -> dict[str, Column]:
    """Rules that vote bad, or abstain where a fault isn't seen."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    mean = F.col("word_chars") / words
    return {
        "symbols": F.col("n_symbols") >= 0.15 * words,
        "capitals": F.col("n_upper") >= 0.4 * F.greatest(F.col("word_chars"), F.lit(1)),
        "repeated_lines": (F.col("n_lines") >= 4) & (F.col("n_dup_lines") >= 0.4 * lines),
        "repeated_words": 100 * F.col("n_repeat_words") > MAX_REPEATED * words,
        "word_length": (mean < 2) | (mean > 14),
        "few_words": (F.col("n_words") >= 30) & (F.col("n_distinct") < 3 * F.sqrt(words)),
    }


def praise() -> dict[str, Column]:
    """Rules that vote good, or abstain where a text has too little to say so."""
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return {
        "prose": F.col("n_plain") >= 0.8 * words,
        "line_ends": F.col("n_ended") >= 0.5 * lines,
        "varied": (F.col("n_words") >= 20) & (F.col("n_distinct") >= 4 * F.sqrt(words)),
    }


RULES = ("symbols", "capitals", "repeated_lines", "repeated_words", "word_length", "few_words", "prose", "line_ends", "varied")
N_FAULTS = 6


def votes() -> Column:
    """The votes of RULES in order."""
    bad, good = faults(), praise()
    return F.array(*(F.when(bad[r], -1).otherwise(0) if r in bad else F.when(good[r], 1).otherwise(0) for r in RULES)).cast("array<tinyint>")


def posteriors(patterns: DataFrame) -> DataFrame:
    """The ``pattern`` (votes) of all documents to one row per pattern: ``pattern``, ``n``, ``posterior``.

    The rates are estimated from votes and abstentions. The posterior then counts votes alone: abstaining isn't held
    against a document, so one on which no rule votes has the prior. The state of the estimation is (log odds of good, each rule's rate of votes on good documents, the same on bad).
    """
    k = len(RULES)
    counted = patterns.groupBy("pattern").agg(F.count(F.lit(1)).cast("double").alias("n"))
    row = counted.agg(F.sort_array(F.collect_list(F.struct("pattern", "n"))).alias("all"))
    odds_by = """1 / (1 + exp(-aggregate(sequence(0, {last}), state.odds, (sum, j) ->
        sum + IF(p.pattern[j] != 0Y, ln(state.on_good[j] / state.on_bad[j]), {silent}))))"""
    of_pattern = odds_by.format(last=k - 1, silent="ln((1 - state.on_good[j]) / (1 - state.on_bad[j]))")
    by_votes = odds_by.format(last=k - 1, silent="0D")
    weighted = f"transform(all, p -> named_struct('v', p.pattern, 'good', p.n * ({of_pattern}), 'bad', p.n * (1 - ({of_pattern}))))"

    def prior(side: int, part: slice) -> str:
        """Sum of a part of the pseudo-counts of each rule, as an array."""
        return "array(" + ", ".join(f"{sum((PRIOR_FAULT if j < N_FAULTS else PRIOR_PRAISE)[side][part])}D" for j in range(k)) + ")"

    def rates(side: str, place: int) -> str:
        cast = f"aggregate(weights, {prior(place, slice(0, 1))}[j], (sum, x) -> sum + IF(x.v[j] != 0Y, x.{side}, 0D))"
        total = f"aggregate(weights, {prior(place, slice(0, 2))}[j], (sum, x) -> sum + x.{side})"
        return f"transform(sequence(0, {k - 1}), j -> {cast} / {total})"

    def first(place: int) -> str:
        return "array(" + ", ".join(f"{pair[place][0] / sum(pair[place])}D" for pair in [PRIOR_FAULT] * N_FAULTS + [PRIOR_PRAISE] * (k - N_FAULTS)) + ")"

    sums = "aggregate(weights, {0}D, (sum, x) -> sum + x.{1})"
    odds = f"ln({sums.format(PRIOR_GOOD[0], 'good')} / {sums.format(PRIOR_GOOD[1], 'bad')})"
    step = f"transform(array({weighted}), weights -> named_struct('odds', {odds}, 'on_good', {rates('good', 0)}, 'on_bad', {rates('bad', 1)}))[0]"
    begin = f"named_struct('odds', ln({PRIOR_GOOD[0]}D / {PRIOR_GOOD[1]}D), 'on_good', {first(0)}, 'on_bad', {first(1)})"
    estimated = row.select("all", F.expr(f"aggregate(sequence(1, {ITERATIONS}), {begin}, (state, i) -> {step})").alias("state"))
    return estimated.select(F.expr(f"inline(transform(all, p -> named_struct('pattern', p.pattern, 'n', p.n, 'posterior', {by_votes})))"))


def assess(df: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per input row: ``carry``, the measures, ``base_failed``, ``posterior`` and ``kept``."""
    measured = measures(df, text_col, carry)
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    kept = [f"_{i}" for i in range(len(carry))]
    rows = materialize(measured.select(*kept, *MEASURES, base_failed.alias("base_failed"), votes().alias("pattern")), "quality")
    # At most 2 ** 9 rows, so broadcast for any corpus.
    verdicts = F.broadcast(materialize(posteriors(rows.select("pattern")), "verdicts").drop("n"))
    joined = rows.join(verdicts, "pattern")
    return joined.select(
        *(F.col(k).alias(c) for k, c in zip(kept, carry, strict=True)), *MEASURES, "base_failed", "posterior", (~F.col("base_failed") & (F.col("posterior") >= THRESHOLD)).alias("kept")
    )


def filter_quality(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns; they are carried through the one written table."""
    names = tuple(df.columns)
    renamed = df.toDF(*(f"c{i}" for i in range(len(names))))
    judged = assess(renamed, f"c{names.index(text_col)}", tuple(renamed.columns)).filter("kept")
    return judged.select(*renamed.columns).toDF(*names)
