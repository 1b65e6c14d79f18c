"""Fuzzy line deduplication by MinHash, with DataFrame functions only.

Lines are compared as their lower-cased text without surrounding white space; a line needs a character besides white
space to count. Equal lines are one from the start. Two lines link when their sets of GRAM-character shingles have a
Jaccard similarity of PERCENT or more; the linked lines of the whole corpus make components, and of each component
the occurrence in the smallest document, and there the first, stays. A line shorter than a shingle is a shingle.

Signatures are VALUES minima over all shingles' hashes, each under another XOR mask; a value is equal in two lines
with their Jaccard similarity as probability. Bands of five values deal lines to buckets. A bucket of two lines is a
candidate pair; in larger ones a line is held against the leader that it shares most buckets with. AGREE values must be
equal, which a few bits of each tell of most pairs. Bitmaps of the shingles of all lines in such pairs rule out what
isn't nearly similar without a loss, and then the Jaccard similarity of all shingles is taken. Large buckets whose lines
hang together are done; what others hold is held against another leader. Then all pairs of different components that a
bucket has are taken, whatever its size, those of large buckets in several tasks.

A pair of similarity 0.8, 0.85 or 0.9 is a candidate with probability 0.99, 0.998 or 0.9998; that is the banding's
recall and the only way to lose a link. Lines are told apart by 64-bit hashes.

Defined cases: a null text has no lines; rows that repeat identifier and text are one document, so each keeps what the
other keeps; null identifiers come first; documents without lines are in the result; an empty table gives an empty
result; only the identifier and text columns are read.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sahifa.cluster import materialize
from sahifa.functions.frames import once
from sahifa.llm.union_find import components, narrowed

SPACE_CHARS = " \t\n\x0b\x0c\r"
GRAM, PERCENT = 5, 80
#: Lines are cut up in a form in which each character has WIDTH bytes, so that a shingle is found by its place. A row of
#: STEP shingles is looked up, read and written once in what is summed up by line.
WIDE, WIDTH, STEP = "UTF-32", 4, 8
#: Signatures have SIDE times SIDE values, laid out as a square; a candidate's must agree in AGREE of them at least.
SIDE = 5
VALUES, AGREE = SIDE * SIDE, 14
#: Masks differ in their first five bits, so that values of lines of many shingles are of different shingles.
XORS = [((11 * k % 32) << 27 | (0x9E3779B1 * (k + 1)) % (1 << 27)) - (1 << 31) for k in range(VALUES)]
#: Each band is SIDE values: the rows of the square, its columns and two kinds of diagonals. Two bands share one value at most.
BANDS = [[SIDE * r + c for c in range(SIDE)] for r in range(SIDE)] + [[SIDE * r + (c + m * r) % SIDE for r in range(SIDE)] for m in range(3) for c in range(SIDE)]
MASKS = [sum(1 << v for v in band) for band in BANDS]
#: Bits of each value that a bucket's rows carry together, and that many ones at the places of the lowest.
FEW = 2
LOWEST = sum(1 << FEW * k for k in range(VALUES))
#: Rows of a few numbers that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Rows of a bucket that one task holds against the whole bucket, on average.
SHARE = 1000
#: Rounds against leaders before all pairs that are left are taken.
ROUNDS = 2
#: Lines in a bucket all of whose pairs are told by signatures before bitmaps, at most. Bitmaps have WORDS numbers of 64
#: bits; in large buckets those folded to FOLDED are compared before, at less cost.
SMALL, WORDS, FOLDED = 64, 32, 16


def normal(line: Column) -> Column:
    return F.lower(F.btrim(line, F.lit(SPACE_CHARS)))


def occurrences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each line of each row: ``_id``, ``_text`` (hash of the text), ``at`` (its place), ``line``, ``h`` (null if blank)."""
    # The text's hash is taken before its lines are: after it, each line would ask for it.
    texts = df.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text"), F.split(F.coalesce(F.col(text_col), F.lit("")), "\n").alias("lines"))
    rows = texts.select("_id", "_text", F.posexplode_outer("lines").alias("at", "line")).withColumn("line", normal(F.col("line")))
    return rows.withColumn("h", F.when(F.col("line") != "", F.xxhash64("line")))


def last_place(wide: Column) -> Column:
    """The byte where the last shingle of a wide line begins, from 1; a line shorter than a shingle is one."""
    return F.greatest(F.octet_length(wide) - (WIDTH * GRAM - 1), F.lit(1))


def shingle(wide: Column, at: Column) -> Column:
    return F.substring(wide, at, F.lit(WIDTH * GRAM))


def steps(lines: DataFrame, hashed) -> DataFrame:
    """(``h``, ``n``, ``x0``, ...): rows of STEP shingles of each line, hashed; the last is taken again where none is left.

    ``n`` is the number of the line's shingles, equal ones counted each.
    """
    wide = lines.select("h", F.encode("line", WIDE).alias("wide"))
    rows = wide.select("h", "wide", last_place(F.col("wide")).alias("last"))
    rows = rows.select("h", "wide", "last", F.explode(F.sequence(F.lit(1), F.col("last"), F.lit(WIDTH * STEP))).alias("at"))
    places = (F.least(F.col("at") + WIDTH * j, F.col("last")) if j else F.col("at") for j in range(STEP))
    return rows.select("h", ((F.col("last") + (WIDTH - 1)) / WIDTH).cast("int").alias("n"), *(hashed(shingle(F.col("wide"), at)).alias(f"x{j}") for j, at in enumerate(places)))


def signatures(rows: DataFrame) -> DataFrame:
    """(``h``, ``sig``, ``few``: FEW bits of each value); equal lines have equal signatures, so they are combined as they come."""
    parts = steps(rows.filter(F.col("h").isNotNull()), F.hash)
    least = parts.groupBy("h").agg(*(F.min(F.least(*(F.col(f"x{j}").bitwiseXOR(F.lit(x)) for j in range(STEP)))).alias(f"m{k}") for k, x in enumerate(XORS)))
    bits = (F.shiftleft(F.col(f"m{k}").bitwiseAND((1 << FEW) - 1).cast("bigint"), FEW * k) for k in range(VALUES))
    return least.select("h", F.array(*(f"m{k}" for k in range(VALUES))).alias("sig"), functools.reduce(lambda x, y: x.bitwiseOR(y), bits).alias("few"))


def bucket_rows(signed: DataFrame) -> DataFrame:
    """(``h``, ``band``, ``bucket``): a row for each band of each line.

    Bands are taken from a table and looked up then: an array of all keys would be more code than the JVM compiles.
    """
    bands = F.array(*(F.struct(F.lit(b).alias("band"), *(F.lit(v).alias(f"v{k}") for k, v in enumerate(band))) for b, band in enumerate(BANDS)))
    numbered = signed.select("h", "sig", F.explode(bands).alias("of"))
    return numbered.select("h", F.col("of.band").alias("band"), F.xxhash64("of.band", *(F.get("sig", F.col(f"of.v{k}")) for k in range(SIDE))).alias("bucket"))


def few_agree(a: str, b: str) -> Column:
    """Whether AGREE values can be equal, by the bits of ``few``."""
    x = F.col(a).bitwiseXOR(F.col(b))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    return VALUES - F.bit_count(x.bitwiseAND(F.lit(LOWEST))) >= AGREE


def equal_values(a: str, b: str) -> Column:
    """Which values of two signatures are equal, as bits."""
    bits = F.zip_with(F.zip_with(a, b, lambda x, y: x == y), F.array(*(F.lit(1 << k) for k in range(VALUES))), lambda same, bit: F.when(same, bit).otherwise(0))
    return F.aggregate(bits, F.lit(0), lambda total, bit: total.bitwiseOR(bit))


def bounded(df: DataFrame) -> DataFrame:
    """``df`` (written), to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def grams(line: str) -> Column:
    """The shingles of a line, as hashes, equal ones each."""
    # An array of one lets the wide line be made once for all its shingles.
    places = lambda wide: F.sequence(F.lit(1), last_place(wide), F.lit(WIDTH))
    found = F.transform(F.array(F.encode(line, WIDE)), lambda wide: F.transform(places(wide), lambda at: F.xxhash64(shingle(wide, at))))
    return F.get(found, F.lit(0))


def with_both(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """``pairs`` (written) with the columns of ``lines`` for ``h``, and as ``leader_...`` for the leader."""
    return bounded(pairs).join(lines, "h").join(among(named_leader(lines), pairs, "leader"), "leader")


def likely(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs (written) whose signatures can agree by their few bits; the signatures aren't moved for that."""
    both = with_both(pairs, signed.select("h", "few"))
    return both.filter(few_agree("few", "leader_few")).select(pairs.columns)


def agreeing(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """The pairs (written) whose signatures agree in AGREE values; lines aren't read for that."""
    both = with_both(pairs, signed.select("h", "sig"))
    return materialize(both.filter(F.bit_count(equal_values("sig", "leader_sig")) >= AGREE).select(pairs.columns), "agreeing")


def among(rows: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """``rows`` of which ``pairs`` has the key, if these are few: what is to be shuffled is less then."""
    return rows.join(F.broadcast(pairs.select(key).distinct()), key, "left_semi") if pairs.count() <= BROADCAST_ROWS else rows


def verified(pairs: DataFrame, texts: DataFrame, held: DataFrame) -> DataFrame:
    """The (``h``, ``leader``) pairs (written) whose lines are similar. ``texts`` has ``h`` and ``line``, ``held`` bitmaps."""
    pairs = materialize(with_both(pairs, held).filter(whole_allow()).select("h", "leader"), "allowed")
    both = with_both(pairs, texts)
    sets = once(once(both, "x", grams("line")).drop("line"), "y", grams("leader_line")).drop("leader_line")
    similar = sets.filter(100 * F.size(F.array_intersect("x", "y")) >= PERCENT * F.size(F.array_union("x", "y")))
    return materialize(similar.select("h", "leader"), "similar")


def presence(texts: DataFrame) -> DataFrame:
    """(``h``, ``n``, ``bits``): the number of shingles of different lines, equal ones counted each, and which cells they hash to."""
    cells = steps(texts, F.xxhash64)
    word = lambda j: F.shiftrightunsigned(f"x{j}", 6).bitwiseAND(WORDS - 1)
    cells = cells.select("h", "n", *(word(j).alias(f"word{j}") for j in range(STEP)), *(F.expr(f"shiftleft(1L, int(x{j} & 63))").alias(f"bit{j}") for j in range(STEP)))
    some = lambda k: functools.reduce(lambda x, y: x.bitwiseOR(y), (F.when(F.col(f"word{j}") == k, F.col(f"bit{j}")).otherwise(F.lit(0).cast("bigint")) for j in range(STEP)))
    found = cells.groupBy("h").agg(F.max("n").alias("n"), *(F.bit_or(some(k)).alias(f"w{k}") for k in range(WORDS)))
    return found.select("h", "n", F.array(*(f"w{k}" for k in range(WORDS))).alias("bits"))


def folded(held: DataFrame) -> DataFrame:
    """``held`` with ``b0``, ...: the bitmaps folded."""
    return held.select("*", *(functools.reduce(lambda x, y: x.bitwiseOR(y), (F.get("bits", F.lit(k)) for k in range(j, WORDS, FOLDED))).alias(f"b{j}") for j in range(FOLDED)))


def most_differing() -> Column:
    """In how many shingles two similar lines can differ, times 100 + PERCENT; by numbers that are too large it is more."""
    return (F.col("n") + F.col("leader_n")) * (100 - PERCENT)


def whole_allow() -> Column:
    """Whether two bitmaps differ in no more cells than similar lines' shingles can."""
    whole = F.aggregate(F.zip_with("bits", "leader_bits", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda total, c: total + c)
    return whole * (100 + PERCENT) <= most_differing()


def bits_allow() -> Column:
    """The same, first by the folded bitmaps."""
    differ = sum(F.bit_count(F.col(f"b{k}").bitwiseXOR(F.col(f"leader_b{k}"))) for k in range(FOLDED))
    return (differ * (100 + PERCENT) <= most_differing()) & whole_allow()


def named_leader(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.col(c).alias("leader" if c == "h" else f"leader_{c}") for c in rows.columns))


def best_leaders(rows: DataFrame) -> DataFrame:
    """For each line the leader of most of its buckets."""
    counted = rows.filter("h <> leader").groupBy("h", "leader").agg(F.count(F.lit(1)).alias("c"))
    return counted.groupBy("h").agg(F.max_by("leader", F.struct("c", "leader")).alias("leader"))


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """The components that ``found`` and further links make: each line is linked to its component, so rounds are few."""
    return components(found.toDF("h", "leader").unionByName(links), "h", "leader")


def open_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with each line's component so far, without the buckets that have one only."""
    few = rows.count()
    all_read = few + found.count()
    rows = rows.join(bounded(found.withColumnRenamed("node", "h")), "h", "left").withColumn("component", F.coalesce("component", "h"))
    rows = materialize(narrowed(rows, all_read), "labelled")
    several = rows.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("bucket")
    return materialize(narrowed(rows.join(bounded(materialize(narrowed(several, few), "several")), "bucket"), few), "open")


def other_leaders(rows: DataFrame, turn: int) -> DataFrame:
    """(``h``, ``leader``): lines outside their bucket's largest component, with a line of that; another in each turn."""
    lead = F.min(F.struct(F.xxhash64("h", F.lit(turn)).alias("k"), "h")).alias("lead")
    sizes = rows.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c"), lead)
    top = sizes.groupBy("bucket").agg(F.max(F.struct("c", "component", "lead")).alias("top"))
    led = rows.select("bucket", "h", "component").join(top.select("bucket", F.col("top.component").alias("_top"), F.col("top.lead.h").alias("leader")), "bucket")
    return materialize(narrowed(led.filter("component <> _top").select("h", "leader").distinct(), 2 * rows.count()), "tried")


def in_parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` twice, so that each meets its whole bucket: on one side it's in one part, on the other in each."""
    sizes = rows.groupBy("bucket").agg((F.floor(F.count(F.lit(1)) / SHARE) + 1).cast("int").alias("parts")).filter("parts > 1")
    rows = rows.join(bounded(materialize(sizes, "sizes")), "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    x = rows.withColumn("part", F.pmod(F.xxhash64("h"), F.col("parts")).cast("int")).drop("parts")
    return x, named_leader(rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts"))


def first_agreeing() -> Column:
    """Whether two signatures agree and the rows' band is the first that they share; then they meet once only.

    The equal values are an array's one element, so that they are found once for both tests.
    """
    before = F.slice(F.array(*map(F.lit, MASKS)), F.lit(1), F.col("band"))
    return F.exists(F.array(equal_values("sig", "leader_sig")), lambda e: (F.bit_count(e) >= AGREE) & ~F.exists(before, lambda m: e.bitwiseAND(m) == m))


def small_pairs(rows: DataFrame, signed: DataFrame) -> DataFrame:
    """All (``h``, ``leader``) pairs of small buckets that are likely, for each bucket: a row meets SMALL others at most."""
    marked = materialize(bounded(rows.select("bucket", "h")).join(signed.select("h", "few"), "h"), "small")
    same = (F.col("bucket") == F.col("leader_bucket")) & (F.col("h") < F.col("leader")) & few_agree("few", "leader_few")
    return marked.join(named_leader(marked), same).select("h", "leader")


def large_pairs(rows: DataFrame, signed: DataFrame, held: DataFrame) -> DataFrame:
    """All (``h``, ``leader``) pairs of different components of large buckets whose signatures agree and bitmaps allow."""
    ids = materialize(rows.select("h").distinct(), "ids")
    known = bounded(ids).join(folded(held), "h").join(bounded(ids).join(signed, "h"), "h")
    x, y = in_parts(materialize(bounded(rows.select("bucket", "band", "h", "component")).join(known, "h"), "marked"))
    same = (F.col("bucket") == F.col("leader_bucket")) & (F.col("part") == F.col("leader_part"))
    apart = (F.col("h") < F.col("leader")) & (F.col("component") != F.col("leader_component")) & few_agree("few", "leader_few")
    met = x.join(y.drop("leader_band"), same & apart & bits_allow() & first_agreeing())
    # Each pair is met once. Being distinct keeps a bucket's part in its task: parts are cut to size, Spark needn't cut them again.
    return materialize(met.select("bucket", "part", "h", "leader").distinct().select("h", "leader"), "pairs")


def apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The (``h``, ``leader``) pairs that the components found don't hold together."""
    read, found = pairs.count() + 2 * found.count(), bounded(found)
    of = lambda key, name: found.select(F.col("node").alias(key), F.col("component").alias(name))
    both = pairs.join(of("h", "x"), "h", "left").join(of("leader", "y"), "leader", "left")
    return materialize(narrowed(both.filter(F.coalesce("x", "h") != F.coalesce("y", "leader")).select("h", "leader"), read), "apart")


def line_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``node``, ``component``) of each line that is similar to another."""
    rows = occurrences(df, id_col, text_col)
    signed = materialize(signatures(rows), "signatures")
    keys = bucket_rows(signed)
    found = keys.groupBy("bucket").agg(F.min("h").alias("leader"), F.max("h").alias("last"), F.count(F.lit(1)).alias("c")).filter("leader < last")
    shared = materialize(found, "buckets")
    # A bucket of two is a pair; of larger ones the rows are needed.
    twos = shared.filter("c = 2").select(F.col("last").alias("h"), "leader").distinct()
    members = materialize(keys.join(bounded(shared.filter("c > 2").select("bucket", "leader", "c")), "bucket"), "members")
    large = members.filter(F.col("c") > SMALL).drop("c")
    first = likely(materialize(twos.unionByName(best_leaders(members)), "tried"), signed)
    both = first.withColumn("first", F.lit(True)).unionByName(small_pairs(members.filter(F.col("c") <= SMALL), signed).withColumn("first", F.lit(False)))
    # Pairs of small buckets run the other way than those of leaders; each is asked for once.
    both = both.groupBy(F.greatest("h", "leader").alias("h"), F.least("h", "leader").alias("leader")).agg(F.max("first").alias("first"))
    pairs = agreeing(materialize(both, "likely"), signed)
    tried = pairs.filter("first").drop("first")
    pairs = pairs.filter("not first").drop("first")
    ends = lambda x: x.select(F.explode(F.array("h", "leader")).alias("h"))
    wanted = materialize(ends(tried).unionByName(ends(pairs)).unionByName(large.select("h")).distinct(), "wanted")
    # Occurrences are combined before they are shuffled; with the line as a key that takes no sort.
    lines = rows.select("h", "line").join(bounded(wanted), "h", "left_semi").groupBy("h", "line").agg(F.count(F.lit(1)).alias("c"))
    texts = materialize(lines.drop("c"), "lines")
    held = materialize(presence(texts), "bitmaps")

    found = components(verified(tried, texts, held), "h", "leader")
    left = open_rows(large.drop("leader"), found)
    for turn in range(ROUNDS - 1):
        found = joined(found, verified(agreeing(other_leaders(left, turn), signed), texts, held))
        left = open_rows(left.drop("component"), found)
    found = joined(found, verified(apart(pairs, found), texts, held))
    left = open_rows(left.drop("component"), found)
    return joined(found, verified(large_pairs(left, signed, held), texts, held))


def line_verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``_id``, ``_text``, ``n_lines`` (with a word), ``n_kept`` and ``dropped`` (places, sorted)."""
    found = line_components(df, id_col, text_col).withColumnRenamed("node", "h")
    rows = occurrences(df, id_col, text_col).select("_id", "_text", "at", "h").join(bounded(found), "h", "left")
    rows = materialize(rows.select("_id", "_text", "at", F.coalesce("component", "h").alias("component")), "occurrences")
    # Most lines are the only ones of their component; an owner is needed of the others.
    owner = rows.filter("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("_id", "_text", "at")).alias("owner"), F.count(F.lit(1)).alias("c"))
    owner = materialize(owner.filter("c > 1").drop("c"), "owners")
    judged = rows.join(bounded(owner), "component", "left").withColumn("stays", F.col("owner").isNull() | F.struct("_id", "_text", "at").eqNullSafe(F.col("owner")))
    has_line = F.col("component").isNotNull()
    # Rows that repeat identifier and text come together here, so a place counts once.
    places = judged.groupBy("_id", "_text").agg(
        F.collect_set(F.when(has_line, F.col("at"))).alias("lines"), F.collect_set(F.when(has_line & ~F.col("stays"), F.col("at"))).alias("dropped"),
    )
    return places.select("_id", "_text", F.size("lines").alias("n_lines"), (F.size("lines") - F.size("dropped")).alias("n_kept"), F.sort_array("dropped").alias("dropped"))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the lines that don't stay taken out of its texts; rows all of whose lines go are left out.

    A row that had no line to begin with stays as it is.
    """
    names = df.columns
    rows = df.toDF(*(f"_c{i}" for i in range(len(names))))
    key, text = F.col(f"_c{names.index(id_col)}"), F.col(f"_c{names.index(text_col)}")
    verdicts = line_verdicts(df, id_col, text_col).filter("n_kept < n_lines").select("_id", "_text", "n_kept", "dropped")
    joined = rows.join(verdicts, key.eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_text")), "left")
    kept = joined.filter(F.col("n_kept").isNull() | (F.col("n_kept") > 0))
    # Two steps: the places that stay, by a set difference, then the lines at these places.
    lines = F.split(text, "\n")
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("dropped"))
    cut = kept.withColumn("_places", places).withColumn("_lines", F.when(F.col("dropped").isNotNull(), lines))
    left = F.array_join(F.transform("_places", lambda i: F.get("_lines", i)), "\n")
    cut = cut.withColumn("_left", F.when(F.col("dropped").isNull(), text).otherwise(left))
    return cut.select(*(F.col("_left" if n == text_col else f"_c{i}").alias(n) for i, n in enumerate(names)))
