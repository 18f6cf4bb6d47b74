"""Near-duplicate lines by MinHash, in DataFrame functions only.

Two lines are alike when the sets of their 10-character shingles have a Jaccard similarity
of 0.8 or more. Signatures use the shingles that begin a word (and those inside a run of
more than 12 characters without a blank), a sample that depends on the text alone. Their hashes fall into six
classes; the four smallest of a class are a band. Alike lines that share a band are joined
by links verified on their full shingle sets, and links are closed by distributed union-find.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeflow.llm.components import components
from tapeflow.llm.shared import bloom, filter_words, might_hold
from tapeflow.plans.tables import keep, scratch

WIDTH = 10
BANDS = 6
PER_BAND = 4
LIKE = 80  # per cent
# Lines end at \n only, so a dot must match \r, NEL and U+2028 as well.
# A word of up to 12 characters is stepped over whole, a longer run one character at a time.
_STARTS = r"(?s)(?=(\S.{0,%d}+))\S(?:\S{0,11}+(?:\s++|$))?+" % (WIDTH - 1)
_ALL = r"(?s)(?=(.{%d}))" % WIDTH
_NO_ID = -(2**63)
#: Buckets of the table that orders differences.
_COUNTS = 1 << 17
#: Columns of the sketch of a line's shingles, 64 bits each; a power of two of them.
_BITS = tuple(f"b{i:x}" for i in range(16))
#: Sketches of a line on a second look; a power of two.
_PAGES = 4
#: What is stored of a line: its number of shingles, of bits set, and the sketch.
_MARKS = ("n", "w", *_BITS)
#: Members of bands up to this size meet each other on their sketches. In larger bands those around one hub do, whatever
#: their band, if they are up to _AROUND.
_CROWD = 256
_AROUND = 4096


def _lines(text: Column) -> Column:
    """Lines in lower case; null text has none."""
    return F.split(F.lower(text), "\n", -1)


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _with_bands(rows: DataFrame) -> DataFrame:
    """Add ``bands``, up to BANDS hashes of ``line``: of each class of shingle hashes, its
    PER_BAND smallest.

    Classes are ranges of the hash. Their limits are sorted in among the hashes, so a class
    lies between two limits. Each step is a column of its own and so is computed once.
    """
    hashes = F.transform(F.regexp_extract_all("line", F.lit(_STARTS), F.lit(1)),
                         lambda s: F.shiftrightunsigned(F.xxhash64(s), 1))
    limits = [F.lit(2**63 // BANDS * j) for j in range(1, BANDS)]
    rows = rows.withColumn("_s", F.sort_array(F.array_distinct(F.concat(hashes, F.array(*limits)))))
    rows = rows.withColumns({f"_p{j}": F.array_position("_s", x).cast("int") for j, x in enumerate(limits, 1)})
    ends = [F.lit(0), *[F.col(f"_p{j}") for j in range(1, BANDS)], F.size("_s") + 1]
    bands = []
    for j in range(BANDS):
        n = ends[j + 1] - ends[j] - 1
        bands.append(F.when(n > 0, F.xxhash64(F.lit(j), F.slice("_s", ends[j] + 1, F.least(n, F.lit(PER_BAND))))))
    return rows.withColumn("bands", F.array_compact(F.array(*bands))).drop("_s", *[f"_p{j}" for j in range(1, BANDS)])


def _shingles(line: Column) -> Column:
    """Distinct shingles; a shorter line is its own only shingle."""
    return F.when(F.char_length(line) < WIDTH, F.array(line)).otherwise(
        F.array_distinct(F.regexp_extract_all(line, F.lit(_ALL), F.lit(1)))
    )


def _doc_key(documents: DataFrame) -> list[Column]:
    return [F.coalesce("doc_id", F.lit(_NO_ID)).alias("dk"), F.xxhash64("text").alias("th")]


def _line_id(line: Column) -> Column:
    return F.xxhash64(line)


def signatures(documents: DataFrame) -> DataFrame:
    """(dk, th, pos, lid, chk, bands) of every line that is not blank, written once."""
    # A document's hash is taken before its lines go their own ways, not for each of them.
    own = documents.where(F.col("text").isNotNull()).select(*_doc_key(documents), "text")
    rows = own.select("dk", "th", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    rows = rows.withColumn("line", _trimmed(F.col("line"))).where("line <> ''")
    return keep(_with_bands(rows).select("dk", "th", "pos", _line_id(F.col("line")).alias("lid"),
                                         F.xxhash64(F.lit(1), "line").alias("chk"), "bands"))


def fuzzy_links(documents: DataFrame, sigs: DataFrame, like: int = LIKE) -> DataFrame:
    """Verified links (a, b) between ids of different lines that join every alike pair of a band.

    In each band the line with the most company over all its bands is the hub; the others are
    compared with it. Lines that the links to hubs join, over any hubs, need no link of their own.
    What is left meets on sketches in bands of up to _CROWD lines and around hubs of up to _AROUND
    (``_met``), and on its differences from the hub around larger ones (``_met_around``), so the work follows the size of a band and the
    pairs that may be alike, not the square of the band. What meets is compared in full, hubs
    included, unless the sketches of the two lines rule out that they are alike.
    """
    with scratch() as last:
        keys = sigs.select("lid", F.explode("bands").alias("key"))
        shared = keep(keys.groupBy("key").agg(F.min("lid").alias("lo"), F.max("lid").alias("hi"))
                      .where("lo <> hi").select("key"))
        words = filter_words(shared.count())
        near = might_hold(keys, F.col("key"), bloom(shared, F.col("key"), words), words, "_in").where("_in").drop("_in")
        members = keep(near.join(shared, "key").select("key", "lid").distinct())
        wanted = members.select("lid").distinct()
        words = filter_words(wanted.count())
        texts = (
            documents.where(F.col("text").isNotNull())
            .select(F.explode(_lines(F.col("text"))).alias("line")).withColumn("line", _trimmed(F.col("line")))
            .withColumn("lid", _line_id(F.col("line")))
        )
        texts = might_hold(texts, F.col("lid"), bloom(wanted, F.col("lid"), words), words, "_in").where("_in")
        texts = keep(texts.select("lid", "line").dropDuplicates(["lid"]).join(wanted, "lid"))
        sizes = members.groupBy("key").agg(F.count("*").alias("m"))
        company = members.join(sizes, "key").groupBy("lid").agg(F.sum("m").alias("company"))
        first = F.min(F.struct((-F.col("company")).alias("c"), F.col("lid").alias("lid")))
        hubs = members.join(company, "lid").groupBy("key").agg(first.alias("first"), F.count("*").alias("m"))
        spots = keep(members.join(hubs.select("key", "m", F.col("first.lid").alias("hub")), "key").where("lid <> hub"))
        marks = keep(_sketches(texts).drop("page"))
        links = keep(_verified(_sifted(spots.select("lid", "hub").distinct(), marks, like), texts, like))
        # A band of two is settled by its one comparison.
        spots = spots.where("m > 2").join(components(links).withColumnRenamed("node", "lid"), "lid", "left")
        spots = keep(spots.withColumn("root", F.coalesce("root", "lid")))
        # So is a band whose members, the hub aside, the links to hubs join already.
        split = spots.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
        spots = keep(spots.join(split, "key"))
        crowds = keep(spots.where(F.col("m") > _CROWD).select("hub", "lid", "root").distinct())
        vast = keep(crowds.groupBy("hub").agg(F.count("*").alias("c")).where(F.col("c") > _AROUND).select("hub"))
        small = spots.where(F.col("m") <= _CROWD).select("key", "lid", "root")
        mid = crowds.join(vast, "hub", "left_anti").select(F.col("hub").alias("key"), "lid", "root")
        more = _met(small, marks, like).union(_met(mid, marks, like)).union(
            _met_around(crowds.join(vast, "hub"), links, texts, marks, like))
        return last(links.union(_verified(_sifted_again(keep(more.distinct()), texts, like), texts, like)))


def _sifted(pairs: DataFrame, marks: DataFrame, like: int) -> DataFrame:
    """Pairs (lid, hub) whose sketches let them be alike."""
    hubs = marks.select(F.col("lid").alias("hub"), *[F.col(c).alias(c + "2") for c in _MARKS])
    return keep(pairs.join(marks, "lid").join(hubs, "hub").where(_may_be_alike(like)).select("lid", "hub"))


def _sifted_again(pairs: DataFrame, texts: DataFrame, like: int) -> DataFrame:
    """Pairs (lid, hub) whose sketches of _PAGES pages let them be alike; alike lines have a page in common."""
    wanted = pairs.select(F.explode(F.array("lid", "hub")).alias("lid")).distinct()
    whole = Window.partitionBy("lid")
    pages = _sketches(texts.join(wanted, "lid"), _PAGES).withColumns({c: F.sum(c).over(whole) for c in ("n", "w")})
    pages = keep(pages)
    hubs = pages.select(F.col("lid").alias("hub"), "page", *[F.col(c).alias(c + "2") for c in _MARKS])
    both = pairs.join(pages, "lid").join(hubs, ["hub", "page"]).select("lid", "hub", "n", "w", "n2", "w2", _shared().alias("shared"))
    both = both.groupBy("lid", "hub", "n", "w", "n2", "w2").agg(F.sum("shared").alias("shared"))
    return keep(both.where(_enough(F.col("shared"), like)).select("lid", "hub"))


def _met(spots: DataFrame, marks: DataFrame, like: int) -> DataFrame:
    """Pairs (lid, hub) of members of one band, of different components, whose sketches let them be alike."""
    cols = ("lid", "root", *_MARKS)
    left = spots.select("key", "lid", "root").join(marks, "lid")
    right = left.select("key", *[F.col(c).alias(c + "2") for c in cols])
    fits = (F.col("root") != F.col("root2")) & (F.col("lid") < F.col("lid2")) & _may_be_alike(like)
    return left.join(right, "key").where(fits).select("lid", F.col("lid2").alias("hub"))


def _met_around(spots: DataFrame, links: DataFrame, texts: DataFrame, marks: DataFrame, like: int) -> DataFrame:
    """Pairs (lid, hub) of members of large bands of one hub, of different components, that may be alike.

    ``spots`` are (lid, hub, root), ``links`` those of lines and hubs that are alike.
    Let D be
    the shingles in which a line differs from the hub. A line the hub rejects shares some of its D
    with any line alike to it, at least as many as the sizes imply, or both would be further apart
    than alike lines can be. So lines of different components are joined on a prefix of D, the
    rarest first; what lines of one component have alone joins nothing, and what sketches rule out
    is not made. The order is by a table of
    2^17 counts, bounded whatever the input; any common order gives right results. Names of shingles
    are hashes and only choose the candidates: equal shingles have equal names, so no pair is left out.
    """
    hit = links.select(F.col("a").alias("lid"), F.col("b").alias("hub"), F.lit(True).alias("linked"))
    around = spots.select("lid", "hub", "root").join(hit, ["lid", "hub"], "left")
    around = keep(around.withColumn("linked", F.coalesce("linked", F.lit(False))))
    names = lambda s: F.transform(s, lambda x: F.xxhash64(x))
    sets = F.array(F.struct(_shingles(F.col("x")).alias("s"), _shingles(F.col("y")).alias("t")))
    parts = F.transform(sets, lambda p: F.struct(
        F.size(p.s).alias("nx"), names(F.array_except(p.s, p.t)).alias("more"), names(F.array_except(p.t, p.s)).alias("less")))
    both = _with_texts(around, texts).select("lid", "hub", "linked", "root", F.inline(parts))
    apart = keep(both.select(F.monotonically_increasing_id().alias("p"), "lid", "hub", "linked", "root", "nx",
                             F.size("more").alias("ins"), F.size("less").alias("del"), F.concat("more", "less").alias("d")))
    nd = F.col("ins") + F.col("del")
    far = nd - F.floor(F.col("nx") * (100 - like) / like).cast("int")
    close = F.ceil(nd * like / (100 + like) - 1e-9).cast("int")
    least = F.greatest(F.lit(1), far, F.when(F.col("linked"), close).otherwise(0))
    # Names of (hub, difference) pairs: equal ones meet, and a clash costs a comparison.
    around_hub = F.transform("d", lambda x: F.xxhash64("hub", x))
    bucket = lambda x: x.bitwiseAND(F.lit(_COUNTS - 1).cast("long")).cast("int")
    named = apart.select("p", "root", nd.alias("nd"), least.alias("least"), around_hub.alias("d"))
    often = _bucket_counts(named.select(F.explode("d").alias("d")).select(bucket(F.col("d")).alias("bucket")))
    ranked = F.array_sort(F.transform("d", lambda x: F.struct(F.col("often")[bucket(x)].alias("n"), x.alias("d"))))
    prefix = F.slice(ranked, F.lit(1), F.greatest(F.col("nd") - F.col("least") + 1, F.lit(0)))
    spread = named.withColumn("often", often).select("p", "root", F.posexplode(prefix).alias("at", "one")).select("p", "root", "at", F.col("one.d").alias("d"))
    same = Window.partitionBy("d")
    spread = keep(spread.withColumns({"lo": F.min("root").over(same), "hi": F.max("root").over(same)})
                  .where("lo <> hi").select("p", "root", "at", "d"))
    slim = apart.select("p", "lid", "nx", "ins", "del").join(marks, "lid")
    sized = spread.join(slim, "p").drop("p")
    right = sized.select("d", *[F.col(c).alias(c + "2") for c in ("lid", "root", "at", "nx", "ins", "del", *_MARKS)])
    nd2 = F.col("ins2") + F.col("del2")
    # Twice the differences that an alike pair shares, at least; the first of them has the others behind it.
    twice = nd + nd2 - F.floor((F.col("nx") + F.col("nx2")) * (100 - like) / (100 + like))
    fits = (
        (F.col("root") != F.col("root2")) & (F.col("lid") < F.col("lid2"))
        & (F.least("nx", "nx2") * 100 >= F.greatest("nx", "nx2") * like)
        & (F.least(nd - F.col("at"), nd2 - F.col("at2")) * 2 >= twice)
        & ((F.least("ins", "ins2") + F.least("del", "del2")) * 2 >= twice)
        & _may_be_alike(like)
    )
    return sized.join(right, "d").where(fits).select("lid", F.col("lid2").alias("hub"))


def _places(code: Column) -> Column:
    """Where the shingles of a line begin, in its code of four bytes a character; a shorter line has one."""
    return F.sequence(F.lit(0), F.greatest((F.octet_length(code) / 4).cast("int") - WIDTH, F.lit(0)))


def _shingle_hash(code: Column, at: Column) -> Column:
    """Hash of the shingle that begins there. Such a code is cut without reading it from its start."""
    return F.xxhash64(code.substr(at * 4 + 1, F.lit(4 * WIDTH)))


def _sketches(texts: DataFrame, pages: int = 1) -> DataFrame:
    """(lid, page, _MARKS) of lines (lid, line): ``_marks`` as an aggregate, which calls no lambda function for each shingle.

    Shingles are dealt over the pages by their hash. ``n`` counts the places of shingles, so one that comes again counts again.
    """
    codes = texts.select("lid", F.encode("line", "UTF-32").alias("code"))
    hashes = codes.select("lid", "code", F.explode(_places(F.col("code"))).alias("at")).select(
        "lid", _shingle_hash(F.col("code"), F.col("at")).alias("h"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    page = F.shiftrightunsigned("h", 40).bitwiseAND(F.lit(pages - 1).cast("long")).cast("int")
    bits = hashes.select("lid", page.alias("page"), _part("h").alias("part"), F.call_function("shiftleft", one, _place("h")).alias("bit"))
    sketches = bits.groupBy("lid", "page").agg(F.count("*").alias("n"), *[
        F.bit_or(F.when(F.col("part") == j, F.col("bit")).otherwise(none)).alias(c) for j, c in enumerate(_BITS)])
    return sketches.select("lid", "page", "n", _weight([F.col(c) for c in _BITS]).alias("w"), *_BITS)


def _weight(bits: list[Column]) -> Column:
    return functools.reduce(operator.add, map(F.bit_count, bits))


def _marks(line: Column) -> Column:
    """An array of one struct of _MARKS: each of the ``n`` shingles sets a bit of the sketch _BITS, which has ``w`` in all."""
    def hashes(code: Column) -> Column:
        return F.array_distinct(F.transform(_places(code), lambda i: _shingle_hash(code, i)))

    # Lambda arguments are computed once.
    sketch = F.transform(F.transform(F.array(F.encode(line, "UTF-32")), hashes),
                         lambda h: F.struct(F.size(h).alias("n"), *[_bits(h, j).alias(c) for j, c in enumerate(_BITS)]))
    return F.transform(sketch, lambda s: F.struct(s["n"].alias("n"), _weight([s[c] for c in _BITS]).alias("w"), *[s[c].alias(c) for c in _BITS]))


def _part(h: Column | str) -> Column:
    """The column of the sketch in which a hash sets its bit."""
    return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(len(_BITS) - 1).cast("long")).cast("int")


def _place(h: Column | str) -> Column:
    h = F.col(h) if isinstance(h, str) else h
    return h.bitwiseAND(F.lit(63).cast("long")).cast("int")


def _bits(h: Column, part: int) -> Column:
    """64 bits, one set for every hash of this part."""
    one = F.lit(1).cast("long")
    return F.aggregate(F.filter(h, lambda x: _part(x) == part), F.lit(0).cast("long"),
                       lambda bits, x: bits.bitwiseOR(F.call_function("shiftleft", one, _place(x))))


def _may_be_alike(like: int) -> Column:
    """False only where the sketches show that two lines (n, w, _BITS; the other's names with a 2) are not alike.

    A bit that one sketch has alone is a shingle that the other line has not, and no two bits are the same shingle.
    So a line has no more in common with the other than the bits they share and the n - w shingles beyond its own bits.
    """
    # The shared bits stand here once: a longer expression would be a method too large to be compiled.
    return _enough(_shared(), like)


def _shared() -> Column:
    return _weight([F.col(c).bitwiseAND(F.col(c + "2")) for c in _BITS])


def _enough(shared: Column, like: int) -> Column:
    return shared * (100 + like) >= (F.col("w") + F.col("w2")) * like - F.least(F.col("n") - F.col("w"), F.col("n2") - F.col("w2")) * (100 - like)


def _bucket_counts(buckets: DataFrame) -> Column:
    """How often each of the _COUNTS buckets occurs, as one array: a scalar subquery of bounded size."""
    every = buckets.sparkSession.range(0, _COUNTS, 1, 1).select(F.col("id").cast("int").alias("bucket"))
    counts = every.join(buckets.groupBy("bucket").agg(F.count("*").alias("n")), "bucket", "left")
    item = F.struct("bucket", F.coalesce("n", F.lit(0)).cast("int").alias("n"))
    return counts.agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["n"]).alias("often")).scalar()


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (lid, hub) with their lines x and y."""
    a = texts.select("lid", F.col("line").alias("x"))
    b = texts.select(F.col("lid").alias("hub"), F.col("line").alias("y"))
    return pairs.join(a, "lid").join(b, "hub")


def _verified(pairs: DataFrame, texts: DataFrame, like: int) -> DataFrame:
    """Pairs whose full shingle sets reach the similarity."""
    # Lambda arguments are computed once; plain columns would be copied into the filter.
    alike = F.exists(
        F.array(F.struct(_shingles(F.col("x")).alias("s"), _shingles(F.col("y")).alias("t"))),
        lambda p: F.exists(
            F.array(F.size(F.array_intersect(p.s, p.t))),
            lambda same: same * 100 >= F.lit(like) * (F.size(p.s) + F.size(p.t) - same),
        ),
    )
    return _with_texts(pairs, texts).where(alike).select(F.col("lid").alias("a"), F.col("hub").alias("b"))


def dedup_lines(documents: DataFrame, like: int = LIKE) -> DataFrame:
    """All columns of ``documents`` with later copies of lines taken out of ``text``.

    Adds n_lines and n_dropped (long). Of each component of equal or alike lines, over the
    whole table, the occurrence in the smallest (doc_id, text hash, line number) stays.
    Blank lines are no lines here and stay where they are. Lines are compared in lower case
    without blanks at their ends; the text that stays is as written. Null text stays null with
    n_lines 0; a null doc_id sorts first; rows with the same doc_id and text are one
    document and are treated alike. n_chars is left as it is: see the pipeline. Extra
    columns stay, except that n_lines and n_dropped are replaced.
    """
    with scratch() as last:
        sigs = signatures(documents)
        roots = components(fuzzy_links(documents, sigs, like))
        where = sigs.select("dk", "th", "pos", "lid", "chk")
        # The id of a linked line is its root; any other line stands for itself by two hashes.
        grouped = where.join(roots.withColumnRenamed("node", "lid"), "lid", "left").select(
            "dk", "th", "pos", F.coalesce("root", "lid").alias("g"),
            F.when(F.col("root").isNull(), F.col("chk")).otherwise(F.lit(0).cast("long")).alias("gc"),
        )
        grouped = keep(grouped)
        spot = F.struct("dk", "th", "pos")
        firsts = keep(grouped.groupBy("g", "gc").agg(F.count("*").alias("n"), F.min(spot).alias("first"))
                      .where("n > 1").select("g", "gc", "first"))
        words = filter_words(firsts.count())
        again = might_hold(grouped, F.col("g"), bloom(firsts, F.col("g"), words), words, "_in").where("_in")
        gone = again.join(firsts, ["g", "gc"]).where(spot != F.col("first"))
        gone = last(gone.groupBy("dk", "th").agg(F.sort_array(F.collect_set("pos")).alias("gone")))
    return _without(documents, gone)


def _without(documents: DataFrame, gone: DataFrame) -> DataFrame:
    """Texts without the listed lines. Only documents that may lose a line are shuffled."""
    own = documents.drop("n_lines", "n_dropped")
    docs = own.select(*[own[c].alias(f"c{i}") for i, c in enumerate(own.columns)],
                      own["text"].alias("_t"), *_doc_key(own))
    words = filter_words(gone.count())
    docs = might_hold(docs, F.col("th"), bloom(gone, F.col("th"), words), words, "_in")
    touched = docs.where("_in").join(gone, ["dk", "th"], "left")
    lines = F.split("_t", "\n", -1)
    stay = F.filter(lines, lambda x, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), F.col("_t")).otherwise(F.array_join(stay, "\n"))
    at = own.columns.index("text")
    # What the comparison trims off a line counts as blank here too.
    n_lines = F.size(F.filter(F.coalesce(F.split("_t", "\n", -1), F.array()), lambda x: _trimmed(x) != "")).cast("long")

    def out(df: DataFrame, text: Column, dropped: Column) -> DataFrame:
        cols = [(text if i == at else F.col(f"c{i}")).alias(c) for i, c in enumerate(own.columns)]
        return df.select(*cols, n_lines.alias("n_lines"), dropped.cast("long").alias("n_dropped"))

    kept = out(docs.where("not _in"), F.col("_t"), F.lit(0))
    return kept.union(out(touched, text, F.coalesce(F.size("gone"), F.lit(0))))
