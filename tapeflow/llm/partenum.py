"""N-gram Jaccard join by PartEnum signatures.

Sets are put into bands of nearly equal size. Two sets of a band pair that are similar
enough differ in at most k features, a number that follows from the band alone. The
feature domain is cut into partitions by a hash; by the pigeonhole principle similar sets
agree on some subset of partitions, and every such subset gives one signature. Sets that
share a signature are compared on all their features, so nothing is approximate.
"""

from __future__ import annotations

import functools
import itertools
import math
import operator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.llm.components import components
from tapeflow.llm.shared import bit_filter, bloom, filter_words, might_hold, mix64, spaced_words
from tapeflow.plans.tables import keep, scratch

_CACHED_WORDS = 400_000
#: Buckets of the frequency table: 4 MB in each task, whatever the number of features.
_BUCKETS = 1 << 20
#: Bits of a set's sketch, a power of two; the sets of signatures of up to _CROWD sets meet on them.
_BITS = 1 << 10
_CROWD = 256


# --- the scheme --------------------------------------------------------------------------

@functools.lru_cache(maxsize=None)
def size_bands(per_cent: int, upto: int) -> tuple[tuple[int, int], ...]:
    """Consecutive size ranges (low, high), high = low / similarity, that cover 1..upto.

    Sets of similarity ``per_cent`` or more lie in the same band or in adjacent ones."""
    out, low = [], 1
    while low <= upto:
        high = low * 100 // per_cent
        out.append((low, high))
        low = high + 1
    return tuple(out)


def band_of(size: int, per_cent: int) -> int:
    bands = size_bands(per_cent, 1 << max(10, size.bit_length()))
    lo, hi = 0, len(bands) - 1
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if bands[mid][1] < size else (lo, mid)
    return lo


@functools.lru_cache(maxsize=None)
def scheme(band: int, per_cent: int) -> tuple[int, int, int]:
    """(k, parts, chosen) for sets of up to a band's largest size.

    k: the most features two similar sets can differ in. Small k: k + 2 partitions, any two
    of them that agree (at least two must). Otherwise one agreeing partition of ``parts``;
    more than k + 1 of them, so that some agreeing one is not empty (see ``signatures_of``).
    """
    low, high = 0, 0
    upto = 1 << 10
    while True:
        bands = size_bands(per_cent, upto)
        if band < len(bands):
            low, high = bands[band]
            break
        upto *= 2
    k = (2 * high * (100 - per_cent)) // (100 + per_cent)
    if k == 0:
        return 0, 1, 1
    if k <= 6:
        return k, k + 2, 2
    spare = 0
    while spare < k:
        parts = k + 1 + spare
        empty = parts * math.exp(-low * per_cent / 100 / parts)
        if empty + 2 * math.sqrt(empty) <= spare:
            break
        spare += 1
    return k, k + 1 + spare, 1


@functools.lru_cache(maxsize=None)
def _subsets(parts: int, chosen: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(parts), chosen)), dtype=np.int64)


def signatures_of(features: np.ndarray, per_cent: int) -> np.ndarray:
    """Signatures (uint64) of a set of hashed features in its own band and in the next.

    A partition's projection is named by the sum of its mixed features, so equal projections
    have equal names. Where one partition is chosen, empty ones are left out unless a set has
    so many that all its agreeing partitions could be empty; then both sets of a similar pair
    have that many, and both name them.
    """
    own, out = band_of(len(features), per_cent), []
    for band in (own, own + 1):
        k, parts, chosen = scheme(band, per_cent)
        salt = np.uint64(band * 2 + 1)
        mixed = mix64(features ^ mix64(np.array([salt], np.uint64)))
        where = ((mixed >> np.uint64(40)) * np.uint64(parts) >> np.uint64(24)).astype(np.int64)
        sums = np.zeros(parts, np.uint64)
        np.add.at(sums, where, mix64(mixed))
        if chosen == 1:
            count = np.bincount(where, minlength=parts)
            used = np.arange(parts)
            if (count == 0).sum() < parts - k:
                used = used[count > 0]
            name = sums[used] ^ (used.astype(np.uint64) << np.uint64(32))
        else:
            subsets = _subsets(parts, chosen)
            name = np.arange(len(subsets), dtype=np.uint64) << np.uint64(32)
            for c in range(chosen):
                name = mix64(name) ^ sums[subsets[:, c]]
        out.append(mix64(mix64(name) ^ (salt << np.uint64(48))))
    return np.concatenate(out)


class _Words(dict):
    """Words to 64-bit hashes; forgets all when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(words: list[bytes], width: int, cache: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words are one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - width + 1)
    acc = np.full(n, min(len(h), width), np.uint64)
    for i in range(min(len(h), width)):
        acc = mix64(acc) ^ h[i : i + n]
    return np.unique(mix64(acc))


def set_name(features: np.ndarray) -> tuple[int, int]:
    """128 bits of a set as two signed numbers."""
    d = xxhash.xxh3_128_intdigest(features.tobytes())
    both = np.array([d & (2**64 - 1), d >> 64], np.uint64).view(np.int64)
    return int(both[0]), int(both[1])


def sketch_of(features: np.ndarray) -> np.ndarray:
    """_BITS bits (as uint64), one set for every feature."""
    bits = np.zeros(_BITS, np.uint8)
    bits[(features >> np.uint64(65 - _BITS.bit_length())).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


# --- Spark side --------------------------------------------------------------------------

def _id() -> Column:
    return F.coalesce("doc_id", F.lit(-(2**63)))


def _hash() -> Column:
    return F.xxhash64("text")


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.col("text").cast("binary").alias("text"), _hash().alias("th"))


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def sets_table(documents: DataFrame, width: int, per_cent: int) -> DataFrame:
    """(doc_id, th, n, f1, f2, sigs, bits): a row per document, to be stored. Empty sets have no name.

    Copies that one task sees carry their signatures and sketch once."""
    types = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("f1", pa.int64()), ("f2", pa.int64()),
                       ("sigs", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])

    def run(batches):
        cache, signed = _Words(), set()
        for batch in batches:
            n, f1, f2, sigs, bits = [], [], [], [], []
            for text in batch.column(1):
                u = shingle_set(spaced_words(text.as_py()), width, cache)
                n.append(len(u))
                a, b = set_name(u) if len(u) else (None, None)
                f1.append(a)
                f2.append(b)
                if not len(u) or (a, b) in signed:
                    sigs.append([])
                    bits.append([])
                    continue
                bits.append(_signed(sketch_of(u)))
                sigs.append(_signed(signatures_of(u, per_cent)))
                if len(signed) < _CACHED_WORDS:
                    signed.add((a, b))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(2), pa.array(n, pa.int64()), pa.array(f1, pa.int64()),
                 pa.array(f2, pa.int64()), pa.array(sigs, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))],
                schema=types)

    return _texts(documents).mapInArrow(run, "doc_id long, th long, n long, f1 long, f2 long, sigs array<long>, bits array<long>")


def _features_of(documents: DataFrame, sets: DataFrame, width: int, wanted: DataFrame, swap: frozenset[int]) -> DataFrame:
    """(f1, features) of the wanted sets: of each, only texts with one hash are read again (``sets`` are (th, f1)).

    Other texts stop at a bounded filter before any Python, and what slips by at another inside the task."""
    texts = keep(sets.join(wanted, "f1").groupBy("f1").agg(F.min("th").alias("th")))
    words = filter_words(wanted.count())
    sieve = documents.sparkSession.sparkContext.broadcast(bit_filter(wanted, F.col("f1"), wanted.count()))
    types = pa.schema([("f1", pa.int64()), ("features", pa.list_(pa.int64()))])

    def run(batches):
        cache, sent = _Words(), set()
        for batch in batches:
            f1, features = [], []
            for text in batch.column(1):
                u = shingle_set(spaced_words(text.as_py()), width, cache)
                a, other = set_name(u) if len(u) else (None, None)
                a = other if a in swap else a
                if a is None or a in sent or not sieve.value.holds(a):
                    continue
                if len(sent) < _CACHED_WORDS:  # saves sending copies; what slips by is dropped below
                    sent.add(a)
                f1.append(a)
                features.append(_signed(u))
            yield pa.RecordBatch.from_arrays(
                [pa.array(f1, pa.int64()), pa.array(features, pa.list_(pa.int64()))], schema=types)

    read = might_hold(_texts(documents), F.col("th"), bloom(texts, F.col("th"), words), words, "_in").where("_in").drop("_in")
    found = read.mapInArrow(run, "f1 long, features array<long>")
    return keep(found.join(wanted, "f1", "left_semi").dropDuplicates(["f1"]))


def _rare_first(features: DataFrame) -> DataFrame:
    """The same sets with their features in one common order, rare ones first.

    Frequencies are counted over all sets by a bucket of the hash, so the driver sees at most
    _BUCKETS counts. A feature that shares its bucket with others only ranks later: any order
    that all sets have in common gives right results.
    """
    counts = features.select(F.explode("features").alias("d")).groupBy(
        F.col("d").bitwiseAND(F.lit(_BUCKETS - 1).cast("long")).alias("bucket")).agg(F.count("*").alias("n")).toArrow()
    table = np.zeros(_BUCKETS, np.uint32)
    table[counts.column("bucket").to_numpy()] = np.minimum(counts.column("n").to_numpy(), 2**32 - 1)
    often = features.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        for batch in batches:
            sets = batch.column(1)
            flat, at = sets.flatten().to_numpy(), np.diff(sets.offsets.to_numpy())
            order = np.lexsort((flat, often.value[flat & (_BUCKETS - 1)], np.repeat(np.arange(len(at)), at)))
            ends = pa.array(np.concatenate([[0], np.cumsum(at)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(flat[order]))],
                                             names=["f1", "features"])

    return features.mapInArrow(run, "f1 long, features array<long>")


def _joined(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """(a, b, x, y): the sets of each pair."""
    x = features.select(F.col("f1").alias("a"), F.col("features").alias("x"))
    y = features.select(F.col("f1").alias("b"), F.col("features").alias("y"))
    return pairs.join(x, "a").join(y, "b")


def _alike(same: Column, n: Column, per_cent: int) -> Column:
    """``n`` is the sum of both sizes."""
    return same * 100 >= F.lit(per_cent) * (n - same)


def shared_keys(sets: DataFrame) -> DataFrame:
    """(key, f, m): the sets f that share a signature, and how many they are.

    Of signatures with the same sets one stays: two near copies share hundreds of them. A signature's sets are
    named by their number, the sum and the exclusive or of their mixed names.
    """
    keys = sets.where("n > 0").select(F.col("f1").alias("f"), F.explode("sigs").alias("key"))
    # Counts alone travel; keys that only copies of one set share go below.
    shared = keep(keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"))
    words = filter_words(shared.count())
    near = might_hold(keys, F.col("key"), bloom(shared, F.col("key"), words), words, "_in").where("_in").drop("_in")
    same = Window.partitionBy("key")
    met = near.join(shared, "key").select("key", "f").distinct().withColumns({
        "m": F.count("*").over(same), "x": F.bit_xor(F.xxhash64("f")).over(same),
        "s": F.sum(F.shiftright(F.xxhash64(F.lit(1), "f"), 24)).over(same)})
    met = keep(met.where("m > 1"))
    first = met.groupBy("m", "x", "s").agg(F.min("key").alias("key")).select("key")
    return keep(met.join(first, "key", "left_semi").select("key", "f", "m"))


def _may_be_alike(per_cent: int) -> Column:
    """False only where the sketches show that two sets (n, w, bits) and (n2, w2, bits2) are not similar (``_weighed``).

    A bit that one sketch has alone is a feature that the other set has not, and no two bits are the same feature.
    So a set has no more in common with the other than the bits they share and the n - w features beyond its own bits.
    """
    # The shared bits stand here once: a longer expression would be a method too large to be compiled.
    shared = functools.reduce(operator.add, [
        F.bit_count(F.get("bits", F.lit(i)).bitwiseAND(F.get("bits2", F.lit(i)))) for i in range(_BITS // 64)])
    beyond = F.least(F.col("n") - F.col("w"), F.col("n2") - F.col("w2"))
    return shared * (100 + per_cent) >= (F.col("n") + F.col("n2")) * per_cent - beyond * (100 + per_cent)


def _weighed(marks: DataFrame) -> DataFrame:
    """(f, n, w, bits): ``w`` bits are set."""
    w = F.aggregate("bits", F.lit(0), lambda n, x: n + F.bit_count(x))
    return marks.select("f", "n", w.alias("w"), "bits")


def _met(spots: DataFrame, marks: DataFrame, per_cent: int) -> DataFrame:
    """Pairs (a, b) of sets of one signature, of different components, whose sketches let them be similar."""
    left = spots.select("key", "f", "root").join(_weighed(marks), "f")
    right = left.select("key", *[F.col(c).alias(c + "2") for c in ("f", "root", "n", "w", "bits")])
    fits = (F.col("root") != F.col("root2")) & (F.col("f") < F.col("f2")) & _may_be_alike(per_cent)
    return left.join(right, "key").where(fits).select(F.col("f").alias("a"), F.col("f2").alias("b"))


def similar_links(documents: DataFrame, sets: DataFrame, members: DataFrame, marks: DataFrame, width: int, per_cent: int,
                  swap: frozenset[int] = frozenset()) -> DataFrame:
    """Verified links (a, b) between set names that join every similar pair; ``sets`` are (th, f1) of the documents,
    ``members`` from ``shared_keys``, ``marks`` are (f, n, bits), a sketch of each of their sets.

    Among the sets of a signature the hub is the one with the most company over all its
    signatures: in a group of near copies that is the text they were made from. All others
    are compared with the hub, if their sketches let them be similar. Sets that similar hubs join already need no
    link of their own, so a signature whose sets, the hub aside, they join goes no further. In another of up to _CROWD
    sets all that their sketches let be similar meet (``_met``). Beyond, let D be a set's differences from the hub. If a set is not similar to the
    hub, any set similar to it must share differences with it, at least as many as the sizes
    imply (disjoint differences would add up to more than the first one's, which are too many
    already). So the sets around a hub are joined on a prefix of their differences, rarest
    first, and what meets is compared in full. No pair is left out, and none is made from sets that only
    share a hub.
    """
    company = members.groupBy("f").agg(F.sum("m").alias("company"))
    first = F.min(F.struct((-F.col("company")).alias("c"), F.col("f").alias("f")))
    hubs = members.join(company, "f").groupBy("key").agg(first.alias("first")).select("key", F.col("first.f").alias("hub"))
    spots = keep(members.join(hubs, "key").where("f <> hub"))
    pairs = spots.groupBy(F.col("f").alias("a"), F.col("hub").alias("b")).agg((F.max("m") > _CROWD).alias("crowd"))
    own, hub = _weighed(marks).withColumnRenamed("f", "a"), _weighed(marks).toDF("b", "n2", "w2", "bits2")
    pairs = keep(pairs.join(own, "a").join(hub, "b").where(F.col("crowd") | _may_be_alike(per_cent)).select("a", "b", "crowd"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("f1")).union(spots.where("m > 2").select("f"))
    wanted = keep(ends.distinct())
    features = _features_of(documents, sets, width, wanted, swap)
    sized = _joined(pairs, _rare_first(features)).withColumns({
        "same": F.size(F.array_intersect("x", "y")), "nx": F.size("x"), "ny": F.size("y")})
    sized = sized.withColumns({
        "linked": _alike(F.col("same").cast("long"), F.col("nx") + F.col("ny"), per_cent),
        "nd": F.col("nx") + F.col("ny") - 2 * F.col("same")})
    # Differences a set must share with a similar one, if one of them is not similar to the hub.
    far = F.col("nd") - F.floor(F.col("nx") * (100 - per_cent) / per_cent).cast("int")
    close = F.ceil(F.col("nd") * per_cent / (100 + per_cent) - 1e-9).cast("int")
    least = F.greatest(F.lit(1), far, F.when(F.col("linked"), close).otherwise(0))
    # What the hub lacks is rarer than what the hub has, so it comes first, its rarest first:
    # a passage that many sets around a hub add comes behind the prefix. Of what the hub has,
    # the rarest is missing from the most sets, so that comes last.
    differences = F.concat(F.array_except("x", "y"), F.reverse(F.array_except("y", "x")))
    prefix = F.when(F.col("crowd"), F.slice(differences, F.lit(1), F.greatest(F.col("nd") - least + 1, F.lit(0))))
    more_than_hub, less_than_hub = F.col("nx") - F.col("same"), F.col("ny") - F.col("same")
    compared = keep(sized.select("a", "b", "nx", "linked", more_than_hub.alias("ins"), less_than_hub.alias("del"),
                                 prefix.alias("prefix")))
    links = compared.where("linked").select("a", "b")
    # What links to hubs join already, over any hubs, needs no link of its own.
    roots = components(links).withColumnRenamed("node", "a")
    placed = spots.where("m > 2").join(roots.withColumnRenamed("a", "f"), "f", "left")
    placed = keep(placed.withColumn("root", F.coalesce("root", "f")))
    split = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    placed = keep(placed.join(split, "key"))
    met = _met(placed.where(F.col("m") <= _CROWD), marks, per_cent)
    around = placed.where(F.col("m") > _CROWD).select(F.col("f").alias("a"), F.col("hub").alias("b"), "root").distinct()
    cols = ("at", "a", "nx", "ins", "del", "root")
    spread = compared.where("prefix is not null").join(around, ["a", "b"]).select(
        "b", "a", "nx", "ins", "del", "root", F.posexplode("prefix").alias("at", "d"))
    # A difference that one component has alone joins nothing.
    same_place = Window.partitionBy("b", "d")
    spread = keep(spread.withColumns({"lo": F.min("root").over(same_place), "hi": F.max("root").over(same_place)})
                  .where("lo <> hi").drop("lo", "hi"))
    right = spread.select("b", "d", *[F.col(c).alias(c + "2") for c in cols])
    # Of a similar pair the first common difference has enough behind it on both sides:
    # additions behind it and all that is lacked, or what is lacked behind it.
    added = F.least(F.col("ins") - F.col("at"), F.col("ins2") - F.col("at2"))
    behind = F.when(added > 0, added + F.least("del", "del2")).otherwise(
        F.least(F.col("ins") + F.col("del") - F.col("at"), F.col("ins2") + F.col("del2") - F.col("at2")))
    apart = F.floor((F.col("nx") + F.col("nx2")) * (100 - per_cent) / (100 + per_cent))
    fits = (
        (F.col("root") != F.col("root2")) & (F.col("a") < F.col("a2"))
        & (F.least("nx", "nx2") * 100 >= F.greatest("nx", "nx2") * per_cent)
        & (behind * 2 >= F.col("ins") + F.col("del") + F.col("ins2") + F.col("del2") - apart)
    )
    beyond = spread.join(right, ["b", "d"]).where(fits).select("a", F.col("a2").alias("b"))
    more = keep(met.union(beyond).distinct())
    n = (F.size("x") + F.size("y")).cast("long")
    same = F.size(F.array_intersect("x", "y")).cast("long")
    found = _joined(more, features).select("a", "b", n.alias("n"), same.alias("same"))
    return links.union(keep(found.where(_alike(F.col("same"), F.col("n"), per_cent)).select("a", "b")))


def _swapped_names(sets: DataFrame) -> frozenset[int]:
    """64-bit names shared by different sets (n^2 / 2^65 of them are to be expected)."""
    names = sets.where("n > 0").groupBy("f1").agg(F.min("f2").alias("lo"), F.max("f2").alias("hi"))
    return frozenset(r.f1 for r in names.where("lo <> hi").select("f1").toLocalIterator())


def _grouped_rows(documents: DataFrame, width: int, per_cent: int) -> DataFrame:
    """(doc_id, th, n, g): g names the component of a row's set; null for an empty one."""
    with scratch() as last:
        with scratch() as beyond:  # signatures are by far the widest table and go first
            signed = keep(sets_table(documents, width, per_cent))
            swap = _swapped_names(signed)
            if swap:  # these sets go by the other half of their 128 bits
                signed = signed.withColumn("f1", F.when(F.col("f1").isin(*swap), F.col("f2")).otherwise(F.col("f1")))
            members = beyond(shared_keys(signed))
            marks = signed.where("size(bits) > 0").select(F.col("f1").alias("f"), "n", "bits").dropDuplicates(["f"])
            marks = beyond(marks.join(members.select("f").distinct(), "f"))
            sets = beyond(signed.select("doc_id", "th", "n", "f1"))
        roots = components(similar_links(documents, sets.select("th", "f1"), members, marks, width, per_cent, swap))
        return last(
            sets.join(roots.withColumnRenamed("node", "f1"), "f1", "left")
            .select("doc_id", "th", "n", F.coalesce("root", "f1").alias("g"))
        )


def jaccard_groups(documents: DataFrame, width: int = 5, per_cent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    A document's set holds its distinct shingles of ``width`` words, words being runs without
    `[\\x20\\x09-\\x0D]` in lower case (A-Z only); with fewer words the whole sequence is one
    shingle. Documents are linked when 100 * intersection >= per_cent * union; component_id
    is the smallest doc_id reachable. Null or empty texts have n_shingles 0 and are linked
    with nothing, nor with each other. Equal sets are one class, so copies cost one row each.
    Repeated rows each give a row. A null doc_id never is a component's smallest while
    another id is there. Other columns are ignored. An empty table gives no row.
    """
    rows = _grouped_rows(documents, width, per_cent)
    least = rows.where("n > 0").groupBy("g").agg(F.min("doc_id").alias("component_id"))
    linked = rows.where("n > 0").join(least, "g").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.union(alone)


def one_per_group(documents: DataFrame, width: int = 5, per_cent: int = 80) -> DataFrame:
    """The documents that stay: of each component the one with the smallest doc_id.

    Of repeated rows (same doc_id and text) one stays. Documents without words all stay.
    Columns are those of ``documents``. Only documents that share a component with another
    row are shuffled, found by a bounded filter.
    """
    with scratch() as last:
        rows = _grouped_rows(documents, width, per_cent).where("n > 0")
        first = F.struct(F.col("doc_id").isNull(), "doc_id", "th")
        crowds = keep(rows.groupBy("g").agg(F.count("*").alias("rows"), F.min(first).alias("first")).where("rows > 1"))
        words = filter_words(crowds.count())
        near = might_hold(rows, F.col("g"), bloom(crowds, F.col("g"), words), words, "_in").where("_in")
        verdicts = last(near.join(crowds, "g").groupBy(_id().alias("dk"), "th").agg(F.max(first == F.col("first")).alias("stays")))
    cols = documents.columns
    docs = documents.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(cols)], _id().alias("dk"), _hash().alias("th"))
    words = filter_words(verdicts.count())
    docs = might_hold(docs, F.col("th"), bloom(verdicts, F.col("th"), words), words, "_in")
    near = docs.where("_in").join(verdicts, ["dk", "th"], "left")
    back = [F.col(f"c{i}").alias(c) for i, c in enumerate(cols)]
    return (
        docs.where("not _in").select(*back)
        .union(near.where("stays is null").select(*back))
        .union(near.where("stays").dropDuplicates(["dk", "th"]).select(*back))
    )
