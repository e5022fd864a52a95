"""Benchmark decontamination: SimHash windows, multi-index Hamming blocks, exact verification.

An item of L words is looked for in windows of L words (a shorter text is one
window). The similarity is the shingles' weighted overlap, sum of lesser
frequencies over the greater of the two totals, and must be SIMILARITY or more. A
window has no more shingles than the item, so it may lack a share of
1 - SIMILARITY of the item's at most: whatever lacks all of a set of item shingles
that weighs more is not similar. Each item has such a set, its probes, those that
the fewest items have, and only windows that hold a probe of an item of their
length are looked at.

These windows and the items get 128-bit SimHash fingerprints over their shingles,
each weighted by its frequency, cut into BLOCKS blocks of 8 bits. If two differ in
RADIUS bits or fewer, some block differs in FLIPS or fewer, so an item filed under
every value that near to each of its blocks, and under its length, meets all windows
of that length within the radius, without exception. The full distance is checked,
and candidates are verified by the exact similarity. At 0.8 the expected distance is
26 bits with a deviation of 5; RADIUS is four deviations off, and of 1,841 simulated
windows at 0.80 to 0.86 none lay beyond it. Items of LONG shingles or more, whose
votes would not fit, are verified with every window that holds a probe.

All steps are DataFrame functions. Defined results: null or empty text is clean;
items with fewer than five words have no shingle and match nothing; repeated rows
get equal answers; a null doc_id is clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .shingles import WIDTH, small, text_shingles, with_spots, words

SIMILARITY, RADIUS, BLOCKS = 0.8, 47, 16
FLIPS = RADIUS // BLOCKS
BITS = 128 // BLOCKS
#: Votes are summed in lanes: LANES longs, each with the bits lane, lane + LANES and lane + 2 * LANES.
LANES = 22
LONG = 1 << 19


def probes(items: DataFrame) -> DataFrame:
    """Rows (item_id, n, h): per item, shingles in order of rarity until those left weigh less than a similar window must have."""
    kinds = items.select("item_id", "n", F.size("sh").alias("m"), F.explode("sh").alias("h")).groupBy("item_id", "n", "m", "h").agg(F.count("h").alias("w"))
    kinds = kinds.join(kinds.groupBy("h").agg(F.count("h").alias("spread")), "h")
    before = F.sum("w").over(Window.partitionBy("item_id", "n", "m").orderBy("spread", "h").rowsBetween(Window.unboundedPreceding, -1))
    return kinds.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") <= F.floor(F.col("m") * (1 - SIMILARITY) + 1e-6)).select("item_id", "n", "h").distinct()


def _votes(sh: Column, lane: int) -> Column:
    """Sums over the shingles of three bits, 22 places apart; they stay apart for fewer than LONG shingles."""
    ones = F.lit(1 | 1 << LANES | 1 << 2 * LANES)
    return F.aggregate(sh, F.lit(0).cast("long"), lambda a, x: a + F.shiftrightunsigned(x, lane).bitwiseAND(ones))


def _bits(votes: Column, total: Column) -> Column:
    """The bits whose votes are more than half of the total."""

    def lane_bits(v: Column, lane: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(2)),
            F.lit(0).cast("long"),
            lambda acc, part: F.when(
                2 * F.call_function("shiftrightunsigned", v, LANES * part).bitwiseAND(F.lit((1 << LANES) - 1)) > total,
                acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), lane + LANES * part)),
            ).otherwise(acc),
        )

    return F.aggregate(F.transform(votes, lane_bits), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x))


def fingerprinted(df: DataFrame) -> DataFrame:
    """Adds the fingerprint's halves f1 and f2 to rows with sh; equal votes give 0."""
    df = df.withColumn("sh2", F.transform("sh", lambda x: F.xxhash64(x, F.lit(1))))
    for v, sh in (("v1", "sh"), ("v2", "sh2")):
        df = df.withColumn(v, F.array(*(_votes(F.col(sh), lane) for lane in range(LANES))))
    for f, v in (("f1", "v1"), ("f2", "v2")):
        df = df.withColumn(f, _bits(F.col(v), F.size("sh")))
    return df.drop("sh2", "v1", "v2")


def blocks() -> Column:
    """The blocks of f1 and f2, each with its number above its bits."""
    half = BLOCKS // 2
    return F.array(*(F.shiftrightunsigned(f, BITS * j).bitwiseAND(F.lit((1 << BITS) - 1)) + F.lit((half * i + j) << 16) for i, f in enumerate(("f1", "f2")) for j in range(half)))


def overlap(a: Column, b: Column) -> Column:
    """Weighted overlap: lesser frequencies of shared shingles over the greater total."""
    both = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + F.least(F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    return both / F.greatest(F.size(a), F.size(b))


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, similarity, start): the best window of each text for each item it contains."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.size(words(F.col(item_text))).alias("n"), text_shingles(F.col(item_text)).alias("sh")).where("item_id is not null")
    items = cut(items.where("size(sh) > 0"), "items")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    shingled = own.select("doc_id", text_shingles(F.col("text")).alias("sh"))
    probe = cut(probes(items), "probes")
    keys = probe.select("h", "n").distinct()
    hits = shingled.select("doc_id", F.size("sh").alias("m"), F.posexplode("sh").alias("pos", "h")).join(small(keys), "h")
    # Windows of n words that hold the shingle; a text with fewer words has one window, itself.
    low, high = F.greatest(F.lit(0), F.col("pos") - F.col("n") + WIDTH), F.least("pos", F.greatest(F.lit(0), F.col("m") - F.col("n") + WIDTH - 1))
    spots = cut(hits.select("doc_id", "n", F.explode(F.sequence(F.least(low, high), high)).alias("s")).distinct(), "spots")
    part = with_spots(own, spots, F.struct("n", "s")).select("doc_id", text_shingles(F.col("text")).alias("sh"), "spots").select("doc_id", "sh", F.explode("spots").alias("x")).select("doc_id", F.col("x.s").alias("start"), F.col("x.n").alias("n"), F.slice("sh", F.col("x.s") + 1, F.col("x.n") - WIDTH + 1).alias("sh"))
    part = part.withColumn("g1", F.xxhash64("sh")).withColumn("g2", F.hash("sh"))
    part = cut(part, "windows")
    # Equal windows get one fingerprint and are looked up and verified once.
    kinds = cut(fingerprinted(part.dropDuplicates(["g1", "g2", "n"]).select("g1", "g2", "n", "sh")), "kinds")
    masks = F.filter(F.sequence(F.lit(0), F.lit((1 << BITS) - 1)), lambda x: F.bit_count(x) <= FLIPS)
    filed = fingerprinted(items).select("item_id", "n", F.size("sh").alias("m"), F.col("f1").alias("i1"), F.col("f2").alias("i2"), F.explode(blocks()).alias("block")).where(F.col("m") < LONG)
    filed = filed.withColumn("mask", F.explode(masks)).select("item_id", "n", "i1", "i2", F.col("block").bitwiseXOR(F.col("mask").cast("long")).alias("block"))
    asked = kinds.select("g1", "g2", "n", "f1", "f2", F.explode(blocks()).alias("block"))
    far = F.bit_count(F.col("f1").bitwiseXOR(F.col("i1"))) + F.bit_count(F.col("f2").bitwiseXOR(F.col("i2")))
    near = asked.join(small(cut(filed, "blocks")), ["n", "block"]).where(far <= RADIUS).select("g1", "g2", "n", "item_id")
    long = kinds.where(F.col("n") >= LONG).select("g1", "g2", "n", F.explode("sh").alias("h")).join(probe, ["h", "n"]).select("g1", "g2", "n", "item_id")
    near = near.unionAll(long).distinct()
    alike = near.join(kinds.select("g1", "g2", "n", "sh"), ["g1", "g2", "n"]).join(small(items.select("item_id", "n", F.col("sh").alias("ish"))), ["item_id", "n"])
    alike = alike.withColumn("similarity", overlap(F.col("ish"), F.col("sh"))).where(F.col("similarity") >= SIMILARITY).select("g1", "g2", "n", "item_id", "similarity")
    alike = small(cut(alike, "alike"))
    best = F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("back"))).alias("best")
    return part.select("doc_id", "start", "n", "g1", "g2").join(alike, ["g1", "g2", "n"]).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.back")).alias("start"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_items (that the text contains), similarity (the best, 0 without any) and contaminated."""
    found = matches(docs, benchmark, id_col, text_col).groupBy("doc_id").agg(F.count("item_id").alias("n_items"), F.max("similarity").alias("similarity"))
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    return own.join(found, "doc_id", "left").select("doc_id", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.col("n_items").isNotNull().alias("contaminated"))


def oracle() -> str:
    """DuckDB: the overlap of all windows with all items they share a shingle with, without probes."""
    split = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    return f"""
    WITH i1 AS (SELECT item_id, {split} AS w FROM benchmark),
    i2 AS (SELECT item_id, len(w) AS n, w, unnest(range(0, len(w) - {WIDTH} + 1)) AS pos FROM i1),
    its AS (SELECT item_id, n, array_to_string(w[pos + 1:pos + {WIDTH}], ' ') AS s, count(*) AS ni FROM i2 GROUP BY ALL),
    d1 AS (SELECT doc_id, {split} AS w FROM documents WHERE text IS NOT NULL),
    d2 AS (SELECT doc_id, len(w) AS m, w, unnest(range(0, len(w) - {WIDTH} + 1)) AS pos FROM d1),
    ds AS (SELECT doc_id, m, pos, array_to_string(w[pos + 1:pos + {WIDTH}], ' ') AS s FROM d2),
    hit AS (SELECT doc_id, item_id, n, m, pos, s, ni FROM ds JOIN its USING (s)),
    win AS (SELECT *, unnest(range(greatest(0, least(pos - n + {WIDTH}, m - n)), least(pos, greatest(0, m - n)) + 1)) AS start FROM hit),
    one AS (SELECT doc_id, item_id, n, start, s, least(any_value(ni), count(*)) AS shared FROM win GROUP BY doc_id, item_id, n, start, s),
    per AS (SELECT doc_id, item_id, start, sum(shared) / any_value(n - {WIDTH} + 1) AS sim FROM one GROUP BY doc_id, item_id, start),
    best AS (SELECT doc_id, item_id, max(sim) AS sim FROM per WHERE sim >= {SIMILARITY} GROUP BY ALL),
    agg AS (SELECT doc_id, count(*) AS n_items, max(sim) AS similarity FROM best GROUP BY doc_id)
    SELECT d.doc_id, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(similarity, 0.0) AS similarity, n_items IS NOT NULL AS contaminated FROM documents d LEFT JOIN agg USING (doc_id)
    """
