"""Documents whose word shingles have a Jaccard similarity of 0.8 or more, by prefixes under several orders.

If two sets of shingles are that similar, then under *any* total order of all shingles their first fifths share one.
Lists are of the first order, which puts rare shingles first: a set is in the lists of its prefix. Two sets that a list
brings together are a candidate if their prefixes under two further orders share shingles too; these prefixes are kept
as hashes beside the set and intersected before any text is read. How rare a shingle is, is told by counts over all
documents, hashed to a table of fixed size; a wrong count costs time and never a link.

The result is each document's component, so a large group of near copies needs its links only until it hangs
together. Sets that are equal are one node from the start. Then, in rounds, each node is verified against a node that
leads most of its lists; lists whose nodes hang together go; and when few pairs are left, or rounds find little more,
*all* pairs of different components that a list has are taken, each in the first list that has it. Of these a bitmap
of each set, of the parity of its shingles by cell, already rules out most that aren't similar: where two bitmaps
differ, so do the sets. What is left is verified. No list, pair or text is left out for its size.

Lists of very many nodes are cut into parts by node, each with a leader, and keep all their rows; a leader of very
many nodes is given copies, each of which verifies some of them. Shingles and sets are told apart by hashes of 64 and
128 bits. Identifiers are integers.

Defined cases: a null text, or one without words, has no shingles and is a component of its own; a text of fewer
words than a shingle is one shingle; rows that repeat an identifier are one document that has all their texts, and
rows that repeat text are linked; null identifiers take no part in links but get the component of equal texts, if
any has an identifier; an empty table gives an empty result; only the identifier and text columns are read.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sahifa.cluster import materialize
from sahifa.llm.arrow import field, map_slices, map_stream
from sahifa.llm.union_find import components

WORDS, PERCENT = 5, 80
#: Shingles are counted in 2 ** SKETCH_BITS cells, by far the most of what is sent to the driver and broadcast: a byte each.
SKETCH_BITS, CHUNK = 22, 1 << 14
#: Nodes in one part of a list, on average, and that one copy of a leader verifies.
PART, SHARE = 20_000, 400
#: Rounds of leaders before all pairs that are left are taken; or when these are at most FEW times the list rows, or
#: when a round has linked less than YIELD of what it verified.
ROUNDS, FEW, YIELD = 2, 1, 0.3
#: Earlier lists of a node that each list row names, so that a pair is taken in its first list and in few others.
EARLIER = 3
#: Rows of a list that one task holds against the whole list, on average.
ROWS = 1000
#: Cells of a bitmap for each shingle of the set, at least; their number is a power of two, and MIN_CELLS at least.
CELLS, MIN_CELLS = 1, 512
#: Rows of a few numbers, 24 bytes or so each, that are broadcast at most; more are joined by a shuffle, and bitmaps and
#: prefixes always are, unless Spark finds that what there is of them is small.
BROADCAST_ROWS = 300_000
#: Orders besides the first, as what a shingle's hash is multiplied by.
ORDERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
MAX_WORDS = 400_000


class WordHashes(dict):
    """64-bit hashes of words, each found once; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MAX_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


HASHES = WordHashes()
STEP = np.array([pow(0xD1342543DE82EF95, k + 1, 1 << 64) for k in range(WORDS)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that leaves no pattern (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def all_shingles(text: str | None) -> np.ndarray:
    """Hashes of the shingles of a text in order; ``bytes.split`` cuts at the six ASCII white space characters."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    if len(words) < WORDS:
        return mixed(np.array([(hashes * STEP[: len(words)]).sum() + np.uint64(len(words))], np.uint64))
    n = len(words) - WORDS + 1
    total = np.zeros(n, np.uint64)
    for k in range(WORDS):
        total += hashes[k : k + n] * STEP[k]
    return mixed(total)


def least_overlap(n):
    """Shingles that a set of ``n`` must share to be similar to any."""
    return (PERCENT * n + 99) // 100


def prefix_length(n):
    return n - least_overlap(n) + 1


def parities(found: np.ndarray) -> np.ndarray:
    """The bitmap of a set as 64-bit numbers: a bit is the parity of the shingles in its cell."""
    cells = max(MIN_CELLS, 1 << int(CELLS * max(1, len(found)) - 1).bit_length())
    counts = np.bincount((found & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def count_sketch(df: DataFrame, text_col: str) -> np.ndarray:
    """Counts of all shingles of all documents, hashed to cells, as classes of a byte: eight to each doubling."""
    cells = 1 << SKETCH_BITS
    shift = np.uint64(64 - SKETCH_BITS)

    def local(batches):
        total, held, size = np.zeros(cells, np.uint32), [], 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.append(all_shingles(text) >> shift)
                size += len(held[-1])
                if size > cells:
                    total += np.bincount(np.concatenate(held).astype(np.int64), minlength=cells).astype(np.uint32)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held).astype(np.int64), minlength=cells).astype(np.uint32)
        for chunk in np.flatnonzero(total.reshape(-1, CHUNK).any(axis=1)).tolist():
            yield {"chunk": [chunk], "counts": [zlib.compress(total[chunk * CHUNK : (chunk + 1) * CHUNK].tobytes(), 1)]}

    def added(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[chunk] = sums.get(chunk, 0) + np.frombuffer(zlib.decompress(counts), np.uint32).astype(np.uint64)
        for chunk, counts in sums.items():
            yield {"chunk": [chunk], "counts": [np.minimum(8 * np.log2(1 + counts), 255).astype(np.uint8).tobytes()]}

    schema = T.StructType([T.StructField("chunk", T.IntegerType()), T.StructField("counts", T.BinaryType())])
    classes = np.zeros(cells, np.uint8)
    parts = map_stream(df.select(text_col), local, schema).repartition("chunk")
    for row in map_stream(parts, added, schema).toLocalIterator():
        classes[row["chunk"] * CHUNK : (row["chunk"] + 1) * CHUNK] = np.frombuffer(row["counts"], np.uint8)
    return classes


def shingled(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: ``_id``, ``n``, ``key`` (of the whole set; null if empty), ``bits``, its prefix, rare first, and
    ``orders``: hashes of its prefixes under the further orders."""
    spread = df.sparkSession.sparkContext.broadcast(count_sketch(df, text_col))
    shift = np.uint64(64 - SKETCH_BITS)

    def run(batch):
        classes = spread.value
        out = {"_id": batch.column(0), "n": [], "key": [], "bits": [], "prefix": [], "parts": [], "orders": []}
        for text in batch.column(1).to_pylist():
            found = np.unique(all_shingles(text))
            n = len(found)
            out["n"].append(n)
            out["key"].append(xxhash.xxh3_128_digest(found.tobytes()) if n else None)
            out["bits"].append(parities(found))
            # Sets of fewer than four are similar to equal ones only.
            p = prefix_length(n) if n >= 4 else 0
            kind = classes[found >> shift]
            rank = (kind.astype(np.uint64) << np.uint64(56)) | (found >> np.uint64(8))
            first = np.argpartition(rank, p - 1)[:p] if p else np.zeros(0, np.int64)
            first = first[np.argsort(rank[first], kind="stable")]
            out["prefix"].append(found[first].view(np.int64))
            out["parts"].append((np.exp2(kind[first] / 8.0) / PART).astype(np.int32) + 1)
            further = (np.argpartition(found * np.uint64(order), p - 1)[:p] if p else [] for order in ORDERS)
            out["orders"].append([found[at].astype(np.uint32).view(np.int32) if p else [] for at in further])
        return out

    schema = T.StructType(
        [
            field(df, id_col, "_id"), T.StructField("n", T.IntegerType()), T.StructField("key", T.BinaryType()),
            T.StructField("bits", T.ArrayType(T.LongType())), T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("parts", T.ArrayType(T.IntegerType())),
            T.StructField("orders", T.ArrayType(T.ArrayType(T.IntegerType()))),
        ]
    )
    return materialize(map_slices(df.select(id_col, text_col), run, schema), "shingled")


def partners(run: np.ndarray, n: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the first row of its list whose size it can be similar to, and how many others there are.

    Rows are ordered by list and size. A partner's size is near, and no greater than what the row's place leaves
    room for: the overlap that the two sizes ask for must follow the shingle that the list is of.
    """
    key = (run.astype(np.int64) << 32) + n
    low, high = least_overlap(n), np.minimum(n * 100 // PERCENT, (n - at) * (100 + PERCENT) // PERCENT - n)
    first = np.searchsorted(key, (run.astype(np.int64) << 32) + low, "left")
    after = np.searchsorted(key, (run.astype(np.int64) << 32) + high, "right")
    return first, after - first - ((low <= n) & (n <= high))


def shared_lists(nodes: DataFrame) -> DataFrame:
    """The rows of lists that have a partner there: ``token``, ``node``, ``n``, ``at`` (place in the prefix), ``leader``, ``leader_n``.

    Parts are for choosing leaders: a partner may be in any part, so the rows of a list that is cut all stay.
    """
    both = F.explode(F.arrays_zip("prefix", "parts", F.sequence(F.lit(0), F.size("prefix") - 1)))
    rows = nodes.filter(F.size("prefix") > 0).select("node", "n", both.alias("e"))
    # A shingle is counted no less often than its list has nodes, so only lists that may be long are counted by node.
    maybe = nodes.filter(F.exists("parts", lambda p: p > 1)).select(F.explode(F.arrays_zip("prefix", "parts")).alias("e")).filter("e.parts > 1")
    long = materialize(maybe.groupBy(F.col("e.prefix").alias("token")).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > PART), "long")
    rows = rows.select(F.col("e.prefix").alias("token"), "node", "n", F.col("e.2").alias("at")).join(bounded(long), "token", "left")
    # Parts of a list that is cut are numbered from 1; 0 is a whole list.
    part = F.coalesce(F.pmod(F.xxhash64("node"), F.floor(F.col("c") / PART) + 1) + 1, F.lit(0)).cast("int")
    rows = rows.select("token", part.alias("part"), "node", "n", "at")
    dealt = rows.repartition("token", "part").sortWithinPartitions("token", "part", "n", "node")
    names = ("token", "part", "node", "n", "at")

    def paired(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Rows with partners; a row whose partners all go goes in the second turn."""
        for _ in range(2):
            new = np.append(True, (rows["token"][1:] != rows["token"][:-1]) | (rows["part"][1:] != rows["part"][:-1]))[: len(rows["token"])]
            first, others = partners(np.cumsum(new), rows["n"].astype(np.int64), rows["at"].astype(np.int64))
            keep = (others > 0) | (rows["part"] > 0)
            lead = {"leader": rows["node"][np.minimum(first, len(keep) - 1)], "leader_n": rows["n"][np.minimum(first, len(keep) - 1)]} if len(keep) else {"leader": rows["node"], "leader_n": rows["n"]}
            rows = {k: v[keep] for k, v in (rows | lead).items()}
        return {k: v for k, v in rows.items() if k != "part"}

    def run(batches):
        held: dict[str, np.ndarray] | None = None  # the list that may go on in the next batch; lists are cut to about PART rows
        for batch in batches:
            if not batch.num_rows:
                continue
            now = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            if held is not None:
                now = {c: np.concatenate([held[c], now[c]]) for c in names}
            changes = np.flatnonzero((now["token"][1:] != now["token"][:-1]) | (now["part"][1:] != now["part"][:-1]))
            cut = int(changes[-1]) + 1 if len(changes) else 0
            if cut:
                yield paired({c: now[c][:cut] for c in names})
            held = {c: now[c][cut:] for c in names}
        if held is not None:
            yield paired(held)

    fields = [("token", T.LongType()), ("node", T.LongType()), ("n", T.IntegerType()), ("at", T.IntegerType()), ("leader", T.LongType()), ("leader_n", T.IntegerType())]
    return materialize(map_stream(dealt, run, T.StructType([T.StructField(*f) for f in fields])), "lists")


def bounded(df: DataFrame) -> DataFrame:
    """``df`` (written), to be broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def near_in_size(n: str, m: str):
    """Whether sets of these sizes can be similar."""
    return (F.least(n, m) * 100).cast("long") >= F.greatest(n, m).cast("long") * PERCENT


def best_leaders(rows: DataFrame) -> DataFrame:
    """(node, leader): for each node the leader of most of its lists, of those near in size."""
    counted = rows.filter((F.col("node") != F.col("leader")) & near_in_size("n", "leader_n")).groupBy("node", "leader").agg(F.count(F.lit(1)).alias("c"))
    return counted.groupBy("node").agg(F.max_by("leader", F.struct("c", "leader")).alias("leader"))


def meet(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are similar."""
    if 100 * min(len(x), len(y)) < PERCENT * max(len(x), len(y)):
        return False
    shared = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * shared >= PERCENT * (len(x) + len(y) - shared)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (node, leader) pairs that are similar. ``texts`` has ``node`` and ``text``."""
    copies = pairs.groupBy("leader").agg((F.floor(F.count(F.lit(1)) / SHARE) + 1).cast("int").alias("copies"))
    pairs = materialize(pairs.join(copies, "leader").withColumn("copy", F.pmod(F.xxhash64("node", F.lit(2)), F.col("copies")).cast("int")), "pairs")
    own = pairs.select(F.col("leader").alias("node"), "leader", "copy").distinct()
    wanted = bounded(materialize(pairs.select("node", "leader", "copy").unionByName(own), "wanted"))
    led = texts.join(wanted, "node").select("leader", "copy", "node", "text")
    dealt = led.withColumn("_first", F.col("node") != F.col("leader")).repartition("leader", "copy").sortWithinPartitions("leader", "copy", "_first")

    def run(batches):
        now, sets = None, []
        for batch in batches:
            out = {"node": [], "leader": []}
            for leader, copy, node, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                found = np.unique(all_shingles(text))
                if node == leader:
                    # A document with several texts has several sets.
                    sets = [*sets, found] if (leader, copy) == now else [found]
                    now = (leader, copy)
                elif now == (leader, copy) and len(found) and any(len(s) and meet(found, s) for s in sets):
                    out["node"].append(node)
                    out["leader"].append(leader)
            yield out

    schema = T.StructType([T.StructField("node", T.LongType()), T.StructField("leader", T.LongType())])
    return materialize(map_stream(dealt.drop("_first"), run, schema), "similar")


def labelled(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``rows`` with the ``component`` of each node so far, without the lists that have one only."""
    found = bounded(components(links, "node", "leader"))
    rows = rows.join(found, "node", "left").select("token", "node", "n", "at", F.coalesce("component", "node").alias("component"))
    several = rows.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("token")
    return materialize(rows.join(several, "token"), "open")


def pairs_left(rows: DataFrame) -> int:
    """Pairs of rows of a list in different components, at most; each list's are counted from its components' sizes."""
    sizes = rows.groupBy("token", "component").agg(F.count(F.lit(1)).cast("double").alias("c"))
    total = sizes.groupBy("token").agg(((F.pow(F.sum("c"), 2) - F.sum(F.col("c") * F.col("c"))) / 2).alias("p"))
    return int(total.agg(F.sum("p")).first()[0] or 0)


def next_leaders(rows: DataFrame, turn: int) -> DataFrame:
    """``rows`` outside their list's largest component, led by some node of that; another in each round."""
    lead = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n"))
    sizes = rows.groupBy("token", "component").agg(F.count(F.lit(1)).alias("c"), lead.alias("lead"))
    largest = sizes.groupBy("token").agg(F.max_by(F.struct("component", "lead"), F.struct("c", "component")).alias("top"))
    led = rows.join(largest.select("token", F.col("top.component").alias("_top"), F.col("top.lead.node").alias("leader"), F.col("top.lead.n").alias("leader_n")), "token")
    return led.filter("component <> _top")


def differing(x, y):
    """In how many cells two bitmaps of one size differ."""
    return F.aggregate(F.zip_with(x, y, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, c: n + c)


def folded(bits):
    """The bitmap of half as many cells."""
    half = F.floor(F.size(bits) / 2).cast("int")
    return F.zip_with(F.slice(bits, F.lit(1), half), F.slice(bits, half + 1, half), lambda a, b: a.bitwiseXOR(b))


def bits_allow():
    """Whether the bitmaps of two sets, of sizes that can be similar, differ in no more cells than similar sets can.

    Such sizes are less than a factor of two apart, so one number of cells is at most twice the other.
    """
    size, leader_size = F.size("bits"), F.size("leader_bits")
    differ = F.when(size == leader_size, differing("bits", "leader_bits")).when(size == 2 * leader_size, differing(folded("bits"), "leader_bits"))
    differ = differ.when(2 * size == leader_size, differing("bits", folded("leader_bits"))).otherwise(0)
    return differ <= F.col("n") + F.col("leader_n") - 2 * asked()


def asked():
    """The overlap that two sets of sizes ``n`` and ``leader_n`` need."""
    return F.ceil((F.col("n") + F.col("leader_n")) * PERCENT / (100.0 + PERCENT) - 1e-9)


def orders_allow():
    """Whether two sets' prefixes under each further order share a shingle."""
    shared = (F.arrays_overlap(F.get("orders", F.lit(k)), F.get("leader_orders", F.lit(k))) for k in range(len(ORDERS)))
    return functools.reduce(lambda a, b: a & b, shared)


def viable(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (node, leader) pairs that sizes, bitmaps and the further orders allow. ``sets`` has ``node``, ``n``, ``bits``, ``orders``."""
    led = sets.select(*(F.col(c).alias("leader" if c == "node" else f"leader_{c}") for c in sets.columns))
    # The pairs go to the sets, unless there are very many; what is shuffled then is of these pairs only.
    pairs = materialize(pairs, "tried")
    few = pairs.count() <= BROADCAST_ROWS
    mine = sets.join(F.broadcast(pairs) if few else pairs, "node")
    led = led.join(F.broadcast(pairs.select("leader").distinct()), "leader", "left_semi") if few else led
    both = mine.join(led, "leader").filter(near_in_size("n", "leader_n"))
    return materialize(both.filter(bits_allow()).filter(orders_allow()).select("node", "leader").distinct(), "viable")


def all_pairs(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Every pair of nodes in different components that a list has and that sizes, places and bitmaps allow.

    A pair is taken in the first list that has it: rows name the last lists before theirs that their node is in, and
    where two rows name the same one the pair has been met. What is met again further on is the same pair.

    In the join itself the bitmaps are those folded to MIN_CELLS cells, as columns, which rule out most pairs of sets
    of up to about as many shingles; pairs of larger sets meet their whole bitmaps after it.
    """
    columns = range(MIN_CELLS // 64)
    place = lambda k: F.aggregate(F.filter("bits", lambda x, i: F.pmod(i, F.lit(len(columns))) == k), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(x))
    mine = sets.join(bounded(materialize(rows.select("node").distinct(), "nodes")), "node", "left_semi").select("node", *(place(k).alias(f"b{k}") for k in columns))
    before = Window.partitionBy("node").orderBy("at", "token")
    rows = rows.select("*", *(F.lag("token", k + 1).over(before).alias(f"e{k}") for k in range(EARLIER))).join(bounded(materialize(mine, "bits")), "node")
    sizes = rows.groupBy("token").agg((F.floor(F.count(F.lit(1)) / ROWS) + 1).cast("int").alias("parts")).filter("parts > 1")
    rows = materialize(rows, "marked")
    rows = rows.join(bounded(materialize(sizes, "sizes")), "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    # Each row meets its whole list: on one side it's in one part, on the other in each. What no row names is 0 or 1.
    earlier = [f"e{k}" for k in range(EARLIER)]
    x = rows.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts").fillna(0, earlier)
    y = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts").fillna(1, earlier)
    y = y.select(*(F.col(c).alias("leader" if c == "node" else f"leader_{c}") for c in y.columns))
    # At the first shingle that two prefixes share, what follows must hold the overlap that their sizes ask for.
    most = F.least(F.col("n") - F.col("at"), F.col("leader_n") - F.col("leader_at"))
    open_pair = (F.col("node") < F.col("leader")) & (F.col("component") != F.col("leader_component"))
    met = functools.reduce(lambda a, b: a | b, (F.col(e) == F.col(f"leader_{d}") for e in earlier for d in earlier))
    differ = sum(F.bit_count(F.col(f"b{k}").bitwiseXOR(F.col(f"leader_b{k}"))) for k in columns)
    same = (F.col("token") == F.col("leader_token")) & (F.col("part") == F.col("leader_part"))
    match = same & open_pair & near_in_size("n", "leader_n") & (most >= asked()) & ~met & (differ <= F.col("n") + F.col("leader_n") - 2 * asked())
    return viable(x.join(y, match).select("node", "leader").distinct(), sets)


def row_components(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: ``_id``, ``n``, ``key`` (of the set of shingles; null if empty) and ``component_id``."""
    rows = shingled(df, id_col, text_col)
    classes = rows.filter("key IS NOT NULL").groupBy("key").agg(F.min("_id").alias("node"), F.count(F.lit(1)).alias("c"))
    several = materialize(classes.filter("c > 1").select("key", "node"), "classes")
    # A set that only one row has is its row's; of others, the rows of the smallest identifier stand for all.
    named = rows.join(bounded(several), "key", "left").withColumn("node", F.coalesce("node", "_id"))
    nodes = named.filter((F.col("node") == F.col("_id")) & F.col("key").isNotNull())
    lists, sets = shared_lists(nodes.select("node", "n", "prefix", "parts")), nodes.select("node", "n", "bits", "orders")
    texts = df.select(F.col(id_col).alias("node"), F.col(text_col).alias("text"))

    links = verified(viable(best_leaders(lists), sets), texts)
    left = labelled(lists.drop("leader", "leader_n"), links)
    for turn in range(ROUNDS - 1):
        if pairs_left(left) <= FEW * left.count():
            break
        tried = viable(best_leaders(next_leaders(left, turn)), sets)
        more = verified(tried, texts)
        links = links.unionByName(more)
        left = labelled(left.drop("component"), links)
        if more.count() <= YIELD * tried.count():
            break
    links = links.unionByName(verified(all_pairs(left, sets), texts))

    found = components(links, "node", "leader").withColumnRenamed("node", "_node")
    out = rows.select("_id", "n", "key").join(bounded(several), "key", "left").withColumn("node", F.coalesce("node", "_id"))
    out = out.join(bounded(found), F.col("node") == F.col("_node"), "left")
    return out.select("_id", "n", "key", F.coalesce("component", "node").alias("component_id"))


def near_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: identifier, ``n_shingles`` and ``component_id``, the smallest identifier reachable."""
    return row_components(df, id_col, text_col).select(F.col("_id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` without the documents that aren't the smallest of their component, and without rows that repeat one.

    Of rows of one identifier, or of none, that have equal sets of shingles one stays; of those without an identifier
    none does if a row with an identifier has the set. Rows without shingles stay.
    """
    names = df.columns
    found = materialize(row_components(df, id_col, text_col), "components")
    gone = materialize(found.filter("_id <> component_id").select(F.col("_id").alias("_gone")).distinct(), "copies")
    kept = df.join(bounded(gone), df[id_col] == F.col("_gone"), "left_anti")
    sets = found.filter("key IS NOT NULL AND (_id IS NULL OR _id = component_id)").groupBy("_id", "key").agg(F.count(F.lit(1)).alias("c"), F.max("component_id").alias("component"))
    again = materialize(sets.filter("c > 1 OR component IS NOT NULL AND _id IS NULL").drop("c"), "again")
    if again.isEmpty():
        return kept
    ids = bounded(materialize(again.select("_id").distinct(), "ids"))
    rows = kept.toDF(*(f"_c{i}" for i in range(len(names))))
    key, text = f"_c{names.index(id_col)}", names.index(text_col)
    same = F.col(key).eqNullSafe(F.col("_id"))

    def run(batch):
        sets = (np.unique(all_shingles(t)) for t in batch.column(text).to_pylist())
        return {n: batch.column(n) for n in batch.schema.names} | {"_key": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]}

    told = rows.join(ids, same, "left_semi")
    told = materialize(map_slices(told, run, T.StructType([*told.schema.fields, T.StructField("_key", T.BinaryType())])), "told")
    owned = again.filter("_id IS NULL AND component IS NOT NULL").select("key")
    one = told.filter("_key IS NOT NULL").dropDuplicates([key, "_key"]).join(owned, F.col(key).isNull() & (F.col("_key") == F.col("key")), "left_anti")
    out = rows.join(ids, same, "left_anti").unionByName(told.filter("_key IS NULL").drop("_key")).unionByName(one.drop("_key"))
    return out.toDF(*names)
