"""N-gram Jaccard join by inverted lists with set-relation skipping.

Documents become sets of hashed word shingles; equal sets are one class from then on.
A class enters the inverted lists of its prefix only: its first shingles in one global
order, rare ones first, of which any set similar enough shares at least one.

* Index-level skipping: a list is cut into blocks by set size, and each entry carries its
  position. A block whose smallest size and the entry's position rule it out is skipped for it.
* Answer-level skipping: in each block one set is the leader, whose answers (overlaps
  with all other sets of the block) are computed first. For another set they bound the
  overlap with any third one from above, by what each shares with the leader and the
  sizes of what each adds to it, so that most of its answers need no computing; sets that
  the leader's answers already link are settled. Only what is left is compared, after
  parity bits of the sets, whose differing bits bound the shingles not shared from below.

The global order sends shingles that are frequent in a documented sample of the
documents to the end. It changes how much work there is, never the result.

Links make components. The number of links of each set is derived in the same way, for all
sets of a component from one base: the shingles that more than half of them have. With each
set's difference from the base, two sets differ in as many shingles as their differences
have together, less twice what these share. Of sets whose differences share nothing, the
links follow from sums of two numbers, one for each set, so they are counted by the numbers'
distribution; only pairs whose differences share a shingle, and that the sum alone does not
link, are looked at one by one.

Null texts and texts without words have an empty set and no links; an empty table gives an
empty table. Texts of any length are read whole. Repeated rows have equal sets and equal
results; rows of one id are one node of the graph, and an id counts once among the links of
a set, however many rows it has. Of a component's ids the smallest names it. Further
columns, whatever their names, are not read.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.common import arrow_map, cut, discard, documents

#: One document in so many is counted for the order of the shingles.
SAMPLE = 16
#: Shingles that the order moves to the end, at most; the most frequent of the sample.
HEAVY_SHINGLES = 200_000
#: Times that new leaders are tried before the remaining pairs are compared.
LEADER_ROUNDS = 2
#: Ids that may be broadcast (8 bytes each); more are shuffled.
BROADCAST_IDS = 500_000

FACTOR = np.uint64(0x9E3779B97F4A7C15)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct hashed shingles of a text as sorted signed 64-bit integers."""
    words = text.encode().lower().split() if text else []
    n = len(words)
    if not n:
        return np.empty(0, np.int64)
    if n < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=n)], np.uint64).view(np.int64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    rolled = hashes[: n - width + 1].copy()
    for i in range(1, width):
        rolled *= FACTOR
        rolled += hashes[i : n - width + 1 + i]
    rolled ^= rolled >> np.uint64(30)
    rolled *= MIX_1
    rolled ^= rolled >> np.uint64(27)
    rolled *= MIX_2
    rolled ^= rolled >> np.uint64(31)
    return np.unique(rolled.view(np.int64))


def parity_bits(own: np.ndarray) -> np.ndarray:
    """One parity bit for about each shingle: bits that differ between two sets are no more than the shingles that they do not share.

    The number of 64-bit words is a power of two, so the longer of two can be folded.
    """
    bits = 64
    while bits < len(own):
        bits *= 2
    odd = np.bincount(own & (bits - 1), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8")


def heavy_shingles(docs: DataFrame, width: int) -> np.ndarray:
    """The most frequent shingles of the sample in ascending order of frequency; at most HEAVY_SHINGLES, so they may be broadcast."""
    sample = docs.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(SAMPLE)) == 0)

    def make():
        return lambda columns: [[shingle_set(t, width) for t in columns[1]]]

    counted = arrow_map(sample, make, [("shingles", "array<bigint>")]).select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    rows = counted.where("n >= 3").orderBy(F.desc("n"), "s").limit(HEAVY_SHINGLES).collect()
    return np.array([r.s for r in reversed(rows)], np.int64)


def prefix_length(n, percent: int):
    """Of a set of n: shingles of which a similar set must share one."""
    return n - (percent * n + 99) // 100 + 1


def signatures(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """id, n_shingles, digest of the set and its prefix in the global order."""
    heavy = docs.sparkSession.sparkContext.broadcast(heavy_shingles(docs, width))

    def make():
        order = heavy.value
        by_hash = np.argsort(order)
        ordered = order[by_hash]

        def prefix(own: np.ndarray) -> np.ndarray:
            p = prefix_length(len(own), percent) if len(own) else 0
            if not len(ordered) or not p:
                return own[:p]
            at = np.searchsorted(ordered, own)
            at[at == len(ordered)] = 0
            is_heavy = ordered[at] == own
            light = own[~is_heavy]
            if len(light) >= p:
                return light[:p]
            return np.concatenate([light, order[np.sort(by_hash[at[is_heavy]])][: p - len(light)]])

        def block(columns):
            sets = [shingle_set(t, width) for t in columns[1]]
            return [columns[0], [len(s) for s in sets], [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], [prefix(s) for s in sets], [parity_bits(s) for s in sets]]

        return block

    return arrow_map(docs, make, [("id", "bigint"), ("n", "bigint"), ("digest", "binary"), ("prefix", "array<bigint>"), ("bits", "array<bigint>")])


def classes_of(signed: DataFrame) -> DataFrame:
    """One row per distinct set, named by its smallest id."""
    return signed.where("n > 0").groupBy("digest").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))


def shared_entries(classes: DataFrame, percent: int) -> DataFrame:
    """The lists of two sets or more: shingle, block (of sizes), rep, n, pos.

    A list is counted by a partial aggregation; the join back onto its entries can be
    split where it is skewed. Entries whose position leaves too little to share with the
    smallest set of their block are skipped.
    """
    entries = classes.select("rep", "n", F.posexplode("prefix").alias("pos", "shingle"))
    lists = entries.groupBy("shingle").agg(F.count("*").alias("k")).where("k > 1").select("shingle")
    ratio = float(np.log(100 / percent))
    size_block = F.floor(F.log(F.col("n").cast("double")) / F.lit(ratio))
    # Sizes of similar sets are in one block or in two that follow each other: each set stands in its own and the next.
    shared = cut(entries.join(lists, "shingle")).withColumn("block", F.explode(F.array(size_block, size_block + 1)))
    blocks = shared.groupBy("shingle", "block").agg(F.count("*").alias("k"), F.min("n").alias("least_n")).where("k > 1").select("shingle", "block", "least_n")
    floor = F.greatest(F.col("least_n"), F.ceil(F.col("n") * percent / 100))
    return shared.join(blocks, ["shingle", "block"]).where(F.col("n") - F.col("pos") >= required(F.col("n"), floor, percent)).drop("least_n")


def sets_of(docs: DataFrame, reps: DataFrame, width: int) -> DataFrame:
    """rep and its shingles. Few ids are broadcast to the scan, more are joined by a shuffle."""

    def make():
        return lambda columns: [columns[0], [shingle_set(t, width) for t in columns[1]]]

    ids = reps.withColumnRenamed("rep", "id")
    if reps.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return arrow_map(docs.join(ids, "id", "left_semi"), make, [("rep", "bigint"), ("shingles", "array<bigint>")])


def possible(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose parity bits do not differ in more places than similar sets of their sizes may."""
    left, right = (bits.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"{x}_bits")) for x in "ab")
    folded = "IF(size({0}) > {1}, zip_with(slice({0}, 1, {1}), slice({0}, {1} + 1, {1}), (x, y) -> x ^ y), {0})"
    least = "least(size(a_bits), size(b_bits))"
    differing = F.expr(f"aggregate(zip_with({folded.format('a_bits', least)}, {folded.format('b_bits', least)}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    most = F.col("na") + F.col("nb") - 2 * required(F.col("na"), F.col("nb"), percent)
    return pairs.join(right, "b").join(left, "a").where(differing <= most).select("a", "b")


def required(n, m, percent: int):
    """Shared shingles that sets of n and m need, as a column."""
    return F.ceil((n + m) * F.lit(percent) / F.lit(100 + percent) - F.lit(1e-9))


def overlaps(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b, na, nb, o (shared shingles) and linked of each pair (a, b)."""
    left, right = (sets.select(F.col("rep").alias(x), F.col("shingles").alias(f"{x}_set")) for x in "ab")
    joined = pairs.join(right, "b").join(left, "a")
    o = F.size(F.array_intersect("a_set", "b_set")).cast("bigint")
    counted = joined.select("a", "b", F.size("a_set").cast("bigint").alias("na"), F.size("b_set").cast("bigint").alias("nb"), o.alias("o"))
    return counted.withColumn("linked", 100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o")))


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of all nodes of edges (a, b), by large and small stars in turn."""

    def star(graph: DataFrame, large: bool) -> DataFrame:
        both = graph.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(graph.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        if large:
            return joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        near = joined.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b"))
        return near.unionByName(least.where("u != m").select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()

    graph = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        old, graph = graph, cut(star(star(graph, True), False))
        discard(old)
        state = graph.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    nodes = graph.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component")).distinct()


def size_fits(n, m, percent: int):
    return (100 * F.least(n, m)) >= (percent * F.greatest(n, m))


def labelled(lists: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links).select(F.col("node").alias("rep"), "component")
    return lists.join(found, "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")


def leader_pairs(lists: DataFrame, turn: int, percent: int) -> DataFrame:
    """In each block with two components or more, the leader with each set that is not yet linked to it."""
    rank = F.col("rep") if turn == 0 else F.xxhash64("rep", F.lit(turn))
    blocks = lists.groupBy("shingle", "block").agg(F.min(F.struct(rank.alias("r"), F.col("rep").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"))).alias("lead"), F.min("comp").alias("c1"), F.max("comp").alias("c2")).where("c1 != c2").select("shingle", "block", "lead.a", "lead.na", "lead.ca")
    joined = lists.join(blocks, ["shingle", "block"]).where((F.col("rep") != F.col("a")) & (F.col("comp") != F.col("ca")) & size_fits(F.col("n"), F.col("na"), percent))
    return joined.select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b")).distinct()


def remaining_pairs(lists: DataFrame, answers: DataFrame, percent: int) -> DataFrame:
    """Pairs of different components in one block that neither positions nor the leaders' answers rule out.

    Of a block's sets all but those of its largest component look for partners.
    """
    # Each set's closest leader: what it shares with it, and what it adds.
    sides = answers.select(F.col("a").alias("rep"), F.col("b").alias("lead"), "o").unionByName(answers.select(F.col("b").alias("rep"), F.col("a").alias("lead"), "o"))
    closest = sides.groupBy("rep").agg(F.max(F.struct("o", "lead")).alias("x")).select("rep", F.col("x.lead").alias("lead"), F.col("x.o").alias("o"))
    known = lists.join(closest, "rep", "left").select("shingle", "block", "rep", "n", "pos", "comp", "lead", "o")
    sizes = known.groupBy("shingle", "block", "comp").agg(F.count("*").alias("k"))
    blocks = sizes.groupBy("shingle", "block").agg(F.max(F.struct("k", "comp")).alias("x"), F.count("*").alias("c")).where("c > 1").select("shingle", "block", F.col("x.comp").alias("most"))
    live = known.join(blocks, ["shingle", "block"])
    seek = live.where("comp != most").select("shingle", "block", *(F.col(c).alias(f"x_{c}") for c in ("rep", "n", "pos", "comp", "lead", "o")))
    need = required(F.col("n"), F.col("x_n"), percent)
    by_position = F.least(F.col("n") - F.col("pos"), F.col("x_n") - F.col("x_pos")) >= need
    # Answer-level skip: shared within the leader at most, and shared outside of it at most.
    most_shared = F.least("o", "x_o") + F.least(F.col("n") - F.col("o"), F.col("x_n") - F.col("x_o"))
    by_answer = ~F.coalesce((F.col("lead") == F.col("x_lead")) & (most_shared < need), F.lit(False))
    once = (F.col("comp") == F.col("most")) | (F.col("rep") < F.col("x_rep"))
    return live.join(seek, ["shingle", "block"]).where((F.col("comp") != F.col("x_comp")) & once & size_fits(F.col("n"), F.col("x_n"), percent) & by_position & by_answer).select(F.least("rep", "x_rep").alias("a"), F.greatest("rep", "x_rep").alias("b")).distinct()


def link_counts(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """rep and links: for each set (rep, component, w: its ids) the ids of other sets of its component that it links with.

    With d shingles of difference, sets of n and m link when (100 + percent) d <=
    (100 - percent) (n + m). excess is what of this one set brings: a pair links when its
    excesses add up to no more than 2 (100 + percent) times the shingles that their
    differences from the base share.
    """
    own = cut(members.join(sets, "rep").select("component", "rep", "w", "shingles"))
    sizes = own.groupBy("component").agg(F.count("*").alias("of"))
    common = own.select("component", F.explode("shingles").alias("s")).groupBy("component", "s").agg(F.count("*").alias("k"))
    bases = common.where("k > 1").join(sizes, "component").where("2 * k > of").groupBy("component").agg(F.collect_list("s").alias("base"))
    difference = F.concat(F.array_except("shingles", "base"), F.array_except("base", "shingles"))
    joined = own.join(bases, "component", "left").withColumn("base", F.coalesce("base", F.array().cast("array<bigint>")))
    excess = (F.lit(100 + percent) * F.size("difference") - F.lit(100 - percent) * F.size("shingles")).cast("bigint")
    measured = cut(joined.withColumn("difference", difference).select("component", "rep", "w", "difference", excess.alias("excess")))
    # Ids of a component by excess, added up to minus that of each set: what links if no difference is shared.
    spread = measured.groupBy("component", "excess").agg(F.sum("w").alias("w"))
    asked = spread.select("component", (-F.col("excess")).alias("key"), F.lit(1).alias("q"), F.lit(0).cast("bigint").alias("w"), "excess")
    both = spread.select("component", F.col("excess").alias("key"), F.lit(0).alias("q"), "w", "excess").unionByName(asked)
    so_far = F.sum("w").over(Window.partitionBy("component").orderBy("key", "q").rowsBetween(Window.unboundedPreceding, 0))
    apart = both.withColumn("links", so_far).where("q = 1").select("component", "excess", "links")
    counted = measured.join(apart, ["component", "excess"]).select("rep", (F.col("links") - F.when(F.col("excess") <= 0, F.col("w")).otherwise(0)).alias("links"))
    # Pairs that this does not link, but what their differences share may.
    parts = measured.select("component", "rep", "w", "excess", F.explode("difference").alias("s"))
    other = parts.select("component", "s", *(F.col(c).alias(f"x_{c}") for c in ("rep", "w", "excess")))
    pairs = parts.join(other, ["component", "s"]).where((F.col("rep") < F.col("x_rep")) & (F.col("excess") + F.col("x_excess") > 0))
    shared = pairs.groupBy("rep", "w", "excess", "x_rep", "x_w", "x_excess").agg(F.count("*").alias("c"))
    more = shared.where(F.col("excess") + F.col("x_excess") <= F.lit(2 * (100 + percent)) * F.col("c"))
    sides = more.select("rep", F.col("x_w").alias("links")).unionByName(more.select(F.col("x_rep").alias("rep"), F.col("w").alias("links")))
    return counted.unionByName(sides).groupBy("rep").agg(F.sum("links").alias("links"))


def jaccard_components(docs: DataFrame, width: int = 3, percent: int = 90, id_column: str = "doc_id", text_column: str = "text", count_links: bool = True) -> DataFrame:
    """id, n_shingles, component_id and n_links of every row; sets link when 100 * intersection >= percent * union.

    n_links: the other ids with an equal set or one that links; left out without count_links.
    """
    source = documents(docs, id_column, text_column)
    signed = cut(signatures(source, width, percent))
    classes = classes_of(signed)
    lists = cut(shared_entries(classes, percent))
    bits = cut(classes.select("rep", "n", "bits").join(lists.select("rep").distinct(), "rep", "left_semi"))
    answers: DataFrame | None = None
    sets: DataFrame | None = None
    links: DataFrame | None = None
    kept = [lists, bits]
    for turn in range(LEADER_ROUNDS + 1):
        now = lists.withColumn("comp", F.col("rep")) if links is None else cut(labelled(lists, links))
        pairs = leader_pairs(now, turn, percent) if turn < LEADER_ROUNDS else remaining_pairs(now, answers, percent)
        if answers is not None:
            pairs = pairs.join(answers.select("a", "b"), ["a", "b"], "left_anti")
        pairs = cut(possible(pairs, bits, percent))
        needed = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep"))).distinct()
        if sets is not None:
            needed = needed.join(sets.select("rep"), "rep", "left_anti")
        needed = cut(needed)
        more = cut(sets_of(source, needed, width))
        kept.append(more)
        sets = more if sets is None else sets.unionByName(more)
        found = cut(overlaps(pairs, sets, percent))
        kept.append(found)
        discard(needed, pairs, now if links is not None else None)
        answers = found if answers is None else answers.unionByName(found)
        links = answers.where("linked").select("a", "b")
    labels = cut(components(links))
    discard(*kept)
    named = classes.select("digest", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    columns = [F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")]
    if not count_links:
        # An empty set has no class: its own id, its own component.
        found = named.select("digest", F.coalesce("component", "rep").alias("component"))
        return signed.select("id", "n", "digest").join(found, "digest", "left").select(*columns)
    ids = signed.where("n > 0").select("digest", "id").distinct().groupBy("digest").agg(F.count("*").alias("w"))
    classed = cut(named.join(ids, "digest").select("digest", "rep", "component", "w"))
    members = cut(classed.where("component IS NOT NULL").select("rep", "component", "w"))
    counts = link_counts(members, sets_of(source, members.select("rep"), width), percent)
    others = F.coalesce("links", F.lit(0)) + F.coalesce("w", F.lit(1)) - 1
    found = classed.join(counts, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"), others.cast("bigint").alias("n_links"))
    return signed.select("id", "n", "digest").join(found, "digest", "left").select(*columns, F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
