"""SimHash fingerprints, and near copies among them by pigeonring filtering.

Put the m segments of two fingerprints in a ring. If they differ in k bits at most, then some segment begins a chain in
which the first l segments together differ in l * k / m bits at most, for every l. With m = 7 and k = 2 the first three
are equal, so a fingerprint is looked up by its seven runs of three segments, and a candidate must keep within the
budget for longer runs before its full distance counts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, graph

BITS, SEED = 64, 42
#: Fingerprints that share a key are compared with each other up to so many; beyond that by common neighbours.
DENSE = 64
#: Rounds in which the members of a key are compared with one of them, before what is left is compared block by block.
HUBS = 2
#: Members of a key that one task compares with the ones outside its largest component.
SALTED = 512
#: Partitions, at least, that these blocks are dealt to.
BLOCKS = 200


def shingles(text: str, n: int) -> list[bytes]:
    words = common.lower_words(text)
    if len(words) <= n:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[k:] for k in range(n)), strict=False)]


def hashes(text: str, n: int) -> np.ndarray:
    parts = shingles(text, n)
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in parts), dtype="<u8", count=len(parts))


def majority(values: np.ndarray) -> int:
    """The bits set in over half the values; none set without values."""
    if not len(values):
        return 0
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(values), 250):  # counts of up to 255 fit a byte
        counts += np.unpackbits(values[i : i + 250].view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="u1")
    return int(np.packbits(2 * counts > len(values), bitorder="little").view("<u8")[0])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long.

    A text without words, or null, has fingerprint zero; one of fewer words than a shingle has its one sequence.
    """

    def make() -> Callable:
        return lambda batch: {"doc_id": batch.column(0), "fp": [signed(majority(hashes(t, shingle))) for t in common.texts_of(batch)]}

    return common.map_texts(docs, [common.doc_id(), "text"], "doc_id long, fp long", make)


def segments(m: int) -> list[int]:
    """Bit masks of m runs of bits, as even as can be."""
    edge = [round(i * BITS / m) for i in range(m + 1)]
    return [((1 << b) - 1) & ~((1 << a) - 1) for a, b in zip(edge, edge[1:])]  # noqa: B905


def chains(k: int, m: int) -> list[tuple[int, list[tuple[int, int]], int]]:
    """For each start in the ring: the mask of the segments that must be equal, (mask, budget) of each longer run that bounds more than the next, and 0, the word."""
    parts, out = segments(m), []
    clean = max(n for n in range(m + 1) if n * k // m == 0)
    for i in range(m):
        run = [sum(parts[(i + j) % m] for j in range(n)) for n in range(m + 1)]
        longer = [(run[n], n * k // m) for n in range(clean + 1, m + 1) if n == m or (n + 1) * k // m > n * k // m]
        out.append((run[clean], longer, 0))
    return out


def _flat(mask: int) -> Column:
    return F.lit(signed(mask)).cast("long")


def links(classes: DataFrame, plan: list[tuple[int, list[tuple[int, int]], int]], accept: Callable[[Callable[[str], Column]], Column], scratch: common.Scratch) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints in `classes` (fp) that agree on a key of `plan`, keep its budgets and pass `accept`.

    Keys that many fingerprints share make no pairs. Beyond DENSE of them, which holds for links at two bits or fewer, their
    fingerprints are tied through common neighbours, values one bit off or themselves: two that share one differ in two
    bits at most, and all that do so share one. A value has 65 such fingerprints at most, so no group is large however
    many near copies there are.
    """
    key = lambda i, mask: F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(_flat(mask)).alias("key"))
    held = classes.select("fp", F.inline(F.array(*(key(i, mask) for i, (mask, _, _) in enumerate(plan)))))
    sizes = scratch.keep(held.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    shared = scratch.keep(held.join(sizes, ["k", "key"]), "shared")

    def passes(l: str, r: str) -> Column:  # noqa: E741
        differ = F.col(f"{l}.fp").bitwiseXOR(F.col(f"{r}.fp"))
        ok = accept(lambda c: F.col(f"{l}.{c}"), lambda c: F.col(f"{r}.{c}"))
        for j in range(max(len(x) for _, x, _ in plan)):
            masks = F.array(*(_flat(x[j][0]) for _, x, _ in plan))
            most = F.array(*(F.lit(x[j][1]) for _, x, _ in plan))
            at = (F.col(f"{l}.k") + 1).cast("int")
            ok = ok & (F.bit_count(differ.bitwiseAND(F.element_at(masks, at))) <= F.element_at(most, at))
        return ok

    few = shared.where(F.col("n") <= DENSE)
    same = (F.col("l.k") == F.col("r.k")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.fp") < F.col("r.fp"))
    found = few.alias("l").join(few.alias("r"), same & passes("l", "r")).select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    near = F.concat(F.array(F.col("fp")), F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda j: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), j))))
    close = shared.where(F.col("n") > DENSE).select("fp").distinct().select("fp", F.explode(near).alias("value"))
    middle = close.groupBy("value").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    return found.unionByName(close.join(middle, "value").where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b")).distinct()


def link_components(rows: DataFrame, plan, accept) -> DataFrame:
    """`rows` (doc_id, fp, ...) with component_id: the smallest doc_id among all rows whose fingerprints links connect.

    Equal fingerprints are one class from the start, so a large group of copies costs one row a task.
    """
    with common.Scratch(rows.sparkSession) as scratch:
        classes = scratch.keep(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
        named = _name(classes, graph.components(links(classes, plan, accept, scratch), scratch), "fp")
    return rows.join(named, "fp")


def _name(classes: DataFrame, roots: DataFrame, by: str) -> DataFrame:
    """(by, component_id) of `classes` (by, first) from the (node, root) of those that links connect."""
    grouped = classes.select(by, "first").join(roots, F.col(by) == F.col("node"), "left").select(by, "first", F.coalesce("root", by).alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    return common.materialise(grouped.join(least, "root").select(by, "component_id"), "components")


def near_duplicates(docs: DataFrame, shingle: int = 3, k: int = 2, m: int = 7) -> DataFrame:
    """(doc_id, fingerprint, component_id): fingerprints link at k differing bits or fewer.

    Rows come out as often as they come in. Null ids count as no id: a component of such rows alone has a null
    component_id. An empty table gives an empty result; columns but doc_id and text are not read.
    """
    if k > 2:
        raise ValueError("common neighbours are exact up to two bits; use similar_documents beyond")
    rows = common.materialise(fingerprints(docs, shingle).select("doc_id", "fp"), "fingerprints")
    accept = lambda l, r: F.bit_count(l("fp").bitwiseXOR(r("fp"))) <= k  # noqa: E731, E741
    out = link_components(rows, chains(k, m), accept)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: For keep_one: words of a shingle, and the Jaccard similarity that counts.
SHINGLE, SIMILAR = 5, 0.8
#: A key is the smallest values of the set under so many of the orders; so many keys.
ROWS, KEYS = 5, 25
#: Bits of the long fingerprint, how many may differ, segments of the ring, and the longest chain that is looked at before all bits are.
LONG, FAR, RING, CHAIN = 128, 40, 8, 3
#: Bits of a text's hash that stand behind its id in a node.
BEHIND = 56


def _orders() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    return r.integers(0, 1 << 31, ROWS * KEYS, dtype="<u4") * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, ROWS * KEYS, dtype="<u4")


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, ROWS * KEYS): the smallest value of each set of 32-bit values, which has one at least, under each order."""
    values, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    out, held = np.empty((ROWS * KEYS, len(sets)), dtype="<u4"), np.empty_like(values)
    for k, (factor, add) in enumerate(zip(*_orders(), strict=True)):
        np.multiply(values, factor, out=held)
        np.add(held, add, out=held)
        np.minimum.reduceat(held, starts, out=out[k])
    return out.T.astype("<u8")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys_of(least: np.ndarray) -> np.ndarray:
    """KEYS longs a set, from its minima."""
    keys = np.empty((len(least), KEYS), dtype="<u8")
    for b in range(KEYS):
        x = np.full(len(least), b + 1, dtype="<u8")
        for j in range(ROWS):
            x = _mixed((x << np.uint64(1)) + _mixed(least[:, b * ROWS + j]))
        keys[:, b] = x
    return keys.view("<i8")


def node_of(doc_id: Column, text: Column) -> Column:
    """A number for an id and a text that orders by id, null last: a component's smallest node names its smallest id."""
    whole = F.coalesce(doc_id.cast("decimal(20,0)"), F.lit(str(1 << 63)).cast("decimal(20,0)"))
    behind = F.xxhash64(F.coalesce(text, F.lit(""))).bitwiseAND(F.lit((1 << BEHIND) - 1))
    return (whole * F.lit(1 << BEHIND).cast("decimal(18,0)") + behind.cast("decimal(18,0)")).cast("decimal(38,0)")


def shingle_sets(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, same, size, x, y, keys, shingles) from (node, text).

    `same` is a hash of the set of distinct shingles, x and y its long fingerprint, `shingles` 32 bits of each one's hash.
    A text without words has the empty set and no key.
    """

    def make() -> Callable:
        def rows(batch):
            got = [np.unique(hashes(t, shingle)) for t in common.texts_of(batch)]
            short = [(h >> np.uint64(32)).astype("<u4") for h in got]
            some = [i for i, h in enumerate(got) if len(h)]
            keys = keys_of(minima([short[i] for i in some])) if some else np.empty((0, KEYS), "<i8")
            at = {i: n for n, i in enumerate(some)}
            return {
                "node": batch.column(0),
                "same": [signed(xxhash.xxh64_intdigest(h.tobytes(), SEED)) for h in got],
                "size": [len(h) for h in got],
                "x": [signed(majority(h)) for h in got],
                "y": [signed(majority(_mixed(h))) for h in got],
                "keys": [keys[at[i]] if i in at else [] for i in range(len(got))],
                "shingles": [h.view("<i4") for h in short],
            }

        return rows

    schema = "node decimal(38,0), same long, size int, x long, y long, keys array<long>, shingles array<int>"
    return common.map_texts(docs, ["node", "text"], schema, make)


def ring(k: int = FAR, m: int = RING, longest: int = CHAIN) -> list[list[tuple[int, int]]]:
    """For each start in the ring of `m` segments, (mask over LONG bits, budget) of its chains of up to `longest` segments."""
    width = LONG // m
    part = [((1 << width) - 1) << (i * width) for i in range(m)]
    return [[(sum(part[(i + j) % m] for j in range(n)), n * k // m) for n in range(1, longest + 1)] for i in range(m)]


def close(similarity: float) -> Column:
    """Whether l and r may have the similarity: by their sizes, by a chain of segments within its budgets, and by all bits.

    Fingerprints of sets of similarity 0.8 differ in 15 % of the bits, 19 of LONG, with a standard deviation of 4: FAR is 5
    of these away. If they differ in FAR bits at most, some start of the ring has all of its chains within the
    proportional budgets, so only pairs with such a start are counted in full.
    """
    words = [F.col(f"l.{c}").bitwiseXOR(F.col(f"r.{c}")) for c in ("x", "y")]

    def differ(mask: int) -> Column:
        parts = [(w, mask >> (64 * i) & (1 << 64) - 1) for i, w in enumerate(words)]
        counts = [F.bit_count(w.bitwiseAND(_flat(m))) for w, m in parts if m]
        return counts[0] if len(counts) == 1 else counts[0] + counts[1]

    chain = None
    for start in ring():
        fits = None
        for mask, most in start:
            fits = differ(mask) <= most if fits is None else fits & (differ(mask) <= most)
        chain = fits if chain is None else chain | fits
    return (F.least("l.size", "r.size") >= similarity * F.greatest("l.size", "r.size")) & chain & (differ((1 << LONG) - 1) <= FAR)


def alike(l: str, r: str, similarity: float) -> Column:  # noqa: E741
    shared = F.size(F.array_intersect(l, r))
    return shared >= similarity * (F.size(l) + F.size(r) - shared)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of `pairs` (a, b), each once, whose sets (node, shingles) have the Jaccard similarity."""
    both = pairs.distinct().join(sets.toDF("a", "_l"), "a").join(sets.toDF("b", "_r"), "b")
    return both.where(alike("_l", "_r", similarity)).select("a", "b")


def _pair(l: str, r: str) -> list[Column]:  # noqa: E741
    return [F.greatest(l, r).alias("a"), F.least(l, r).alias("b")]


def _more(linked: DataFrame | None, found: DataFrame) -> DataFrame:
    return found if linked is None else linked.unionByName(found).distinct()


def similar_roots(classes: DataFrame, sets: DataFrame, similarity: float, scratch: common.Scratch) -> DataFrame:
    """(node, root) of the `classes` (node, keys, x, y, size) that pairs of the similarity which share a key connect.

    Only what can still connect something is compared. A round compares one member of each key, the hub, with all that are
    not yet in its component, and takes the hub out, as all of its pairs are now known. A key whose members are all in
    one component is done. After HUBS rounds, the members outside a key's largest component are compared with all members
    of other components, in blocks: no pair is left out but within a component.
    """
    held = classes.select("node", "x", "y", "size", F.explode("keys").alias("key"))
    sizes = held.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    many = scratch.keep(held.join(sizes, "key"), "shared")
    sets = scratch.keep(sets.join(many.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")), "candidates")
    linked, roots = None, None
    for turn in range(HUBS + 1):
        if roots is None:
            known = many.withColumn("root", F.col("node"))
        else:
            known = many.drop("root").join(roots.toDF("node", "_root"), "node", "left").withColumn("root", F.coalesce("_root", "node")).drop("_root")
        apart = known.groupBy("key").agg(F.max(F.struct("root", "node", "x", "y", "size")).alias("r"), F.min("root").alias("_least")).where(F.col("r.root") != F.col("_least")).drop("_least")
        many = scratch.keep(known.join(apart, "key"), "apart")
        if many.isEmpty() or turn == HUBS:
            break
        tried = many.select("key", F.struct("root", "node", "x", "y", "size").alias("l"), "r").where((F.col("l.root") != F.col("r.root")) & close(similarity))
        tried = scratch.keep(tried.select(*_pair("l.node", "r.node")).distinct(), "tried")
        # First one partner for each node: in a group of near copies that connects most of the others, whose sets then stay where they are.
        first = tried.groupBy("a").agg(F.min("b").alias("b"))
        linked = scratch.keep(_more(linked, verified(first, sets, similarity)), "links")
        joined = graph.components(linked, scratch)
        root = lambda c: joined.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))  # noqa: E731, B023
        rest = tried.join(first, ["a", "b"], "left_anti").join(root("a"), "a", "left").join(root("b"), "b", "left")
        rest = rest.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")
        linked = scratch.keep(_more(linked, verified(rest, sets, similarity)), "links")
        roots = graph.components(linked, scratch)
        many = many.where(F.col("node") != F.col("r.node")).drop("r")
    if many.isEmpty():
        return roots if roots is not None else many.select("node", F.col("node").alias("root"))
    counted = many.groupBy("key", "root").agg(F.count("*").alias("n"))
    largest = counted.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("_most"), F.ceil(F.sum("n") / SALTED).cast("int").alias("_salts"))
    # Here the members bring their sets along, a row a block, as pairs that fail may be very many more than members.
    bring = many.drop("r").join(largest, "key").join(sets, "node").join(classes.select("node", "keys"), "node")
    dealt = scratch.keep(bring, "dealt")
    left = dealt.where(F.col("root") != F.col("_most")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    right = dealt.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("_salts")).cast("int"))
    at = (F.col("l.key") == F.col("r.key")) & (F.col("l.salt") == F.col("r.salt")) & (F.col("l.root") != F.col("r.root"))
    once = (F.col("r.root") == F.col("r._most")) | (F.col("l.node") > F.col("r.node"))
    # A pair counts under its first common key: where that is no longer here, one of the two was its hub.
    first = F.element_at(F.array_intersect("l.keys", "r.keys"), 1) == F.col("l.key")
    # Few bytes may be many pairs, so blocks are dealt out by number, not by size.
    deal = lambda df: df.repartition(max(BLOCKS, df.sparkSession.sparkContext.defaultParallelism), "key", "salt")
    rest = deal(left).hint("merge").alias("l").join(deal(right).alias("r"), at & once & close(similarity) & first & alike("l.shingles", "r.shingles", similarity))
    return graph.components(_more(linked, rest.select(*_pair("l.node", "r.node"))), scratch)


def keep_one(docs: DataFrame, similarity: float = SIMILAR, shingle: int = SHINGLE) -> DataFrame:
    """`docs` with one row of each group of near copies: the smallest doc_id's, where null comes last, and one row of those with equal ids.

    Near copies are texts whose sets of shingles have the Jaccard similarity, which is computed for every candidate. Candidates
    share a key, the smallest hashes of both sets under ROWS orders, and pass the pigeonring filter over long fingerprints.
    Texts of fewer words than a shingle are compared as a whole; texts without words, null among them, are one group. An
    empty table gives an empty result. All columns stay as they are, whatever their names.
    """
    whole = docs.select(F.struct("*").alias("doc"))
    own = whole.select("doc", F.col("doc.text").alias("text"), node_of(F.col("doc.doc_id"), F.col("doc.text")).alias("node"))
    with common.Scratch(docs.sparkSession) as scratch:
        rows = scratch.keep(shingle_sets(own, shingle), "sets")
        # Equal sets are one class, known by the smallest of its nodes; their keys are equal, so any will do.
        classes = scratch.keep(rows.groupBy("same", "x", "y", "size").agg(F.min("node").alias("node"), F.first("keys").alias("keys")), "classes")
        roots = similar_roots(classes, rows.select("node", "shingles"), similarity, scratch).where(F.col("node") != F.col("root")).select("node")
        stays = classes.select("node").join(roots, "node", "left_anti")
        times = rows.groupBy("node").agg(F.count("*").alias("_times"))
        stays = common.materialise(stays.join(times, "node").withColumnRenamed("node", "_node"), "stays")
    found = own.drop("text").join(stays, F.col("node") == F.col("_node"))
    once = found.where(F.col("_times") == 1).select("doc.*")
    if stays.where(F.col("_times") > 1).isEmpty():
        return once
    # Of rows that repeat, each task keeps one before they meet.
    repeated = found.where(F.col("_times") > 1).groupBy("node").agg(F.first("doc").alias("doc")).select("doc.*")
    return once.unionAll(repeated)
