"""Corpus operators against plain loops, round trips and odd inputs."""

import base64
import gzip
import hashlib
import pathlib
import random
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from tapeflow.llm import chat, components, decontam, exact, lines, mixing, partenum, quality, urls, warc, wordpiece  # noqa: E402
from tapeflow.llm import shared  # noqa: E402
from tapeflow.llm.queries import VOCABULARY  # noqa: E402

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def package_on_workers(spark):
    spark.sparkContext.environment["PYTHONPATH"] = str(pathlib.Path(__file__).resolve().parents[2])


def docs_of(frame, texts, partitions=3):
    return frame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], DOCS, partitions)


ODD = [None, "", "  \n\t", "a", "A", "x " * 6000, "same text here", "same text here", "é ü あ\U0001f600", "\\ </s> [INST]"]


def odd(frame):
    """Nulls, blanks, long texts, repeated rows and columns with clashing names."""
    base = docs_of(frame, ODD)
    more = frame([(None, "null id", None, None, None), (6, "same text here", "en", "s0", 14)], DOCS, 1)
    return base.union(more).withColumns({c: F.lit("mine") for c in ("copy", "host", "n_words", "n_lines", "kept", "score")})


# --- components and the filter ---------------------------------------------------------------

def test_components_of_paths_stars_and_loops(frame):
    r, edges = random.Random(1), []
    edges += [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 40)] + [(500, 500), (7, 3)]
    edges += [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(60)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {g["node"]: g["root"] for g in components.components(frame([*edges, (None, 4)], "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root}
    assert components.components(frame([], "a bigint, b bigint", 1)).count() == 0


def test_filter_has_no_false_negatives(frame):
    keys = frame([(i * 7919,) for i in range(2000)], "k bigint")
    words = shared.filter_words(2000)
    probe = frame([(i * 7919,) for i in range(4000)] + [(None,)], "k bigint")
    h = F.xxhash64("k")
    got = shared.might_hold(probe, F.when(F.col("k").isNotNull(), h), shared.bloom(keys, h, words), words, "hit")
    hits = [r["k"] for r in got.where("hit").collect()]
    assert {i * 7919 for i in range(2000)} <= set(hits) and len(hits) < 2400
    own = shared.bit_filter(keys, h, 2000)
    assert all(own.holds(r[0]) for r in keys.select(h).collect())


# --- exact dedup -----------------------------------------------------------------------------

def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault("".join(c for c in t or "" if c not in " \t\n\x0b\f\r"), []).append((-len(t or ""), i))
    return {k: (min(v)[1], len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("key", [F.xxhash64, lambda b: F.char_length(b).cast("long")])
@pytest.mark.parametrize("size", [4, 4096])
def test_block_names_group_equal_texts(frame, key, size):
    """A key that clashes takes the way on the blocks themselves."""
    r = random.Random(size)
    texts = [None, "", " \n", *["".join(r.choice("ab \n") for _ in range(r.randrange(40))) for _ in range(120)]]
    rows = list(enumerate(texts))
    want = brute_exact(rows)
    for g in exact.exact_groups(docs_of(frame, texts), size, key).collect():
        norm = "".join((texts[g["doc_id"]] or "").split())
        assert (g["keep_id"], g["group_size"]) == want[norm]
        assert g["kept"] == (g["doc_id"] == g["keep_id"]) and g["text_sha256"] == hashlib.sha256(norm.encode()).hexdigest()


def test_exact_dedup_keeps_one_of_repeated_rows(frame):
    out = exact.exact_groups(odd(frame))
    assert out.count() == 12
    kept = out.groupBy("text_sha256").agg(F.sum(F.col("kept").cast("int")).alias("k")).collect()
    assert {r["k"] for r in kept} == {1}
    assert exact.exact_groups(odd(frame).limit(0)).count() == 0


# --- Jaccard join ----------------------------------------------------------------------------

def shingles(text, width):
    w = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def near_copies(seed):
    r, texts = random.Random(seed), []
    words = [f"w{k}" for k in range(300)]
    for _ in range(8):
        base = [r.choice(words) for _ in range(r.choice([2, 5, 12, 25, 60, 150]))]
        for _ in range(r.choice([1, 3, 25])):
            t = list(base)
            for _ in range(int(len(t) * r.random() * 0.12)):
                j, op = r.randrange(len(t)), r.random()
                if op < 0.5:
                    t[j] = r.choice(words)
                elif op < 0.75 and len(t) > 1:
                    del t[j]
                else:
                    t.insert(j, r.choice(words))
            texts.append(" ".join(t))
    return [*texts, None, "", " \n", "w1", "W1"]


@pytest.mark.parametrize("seed, width, per_cent", [(0, 3, 90), (1, 5, 80), (2, 1, 50)])
def test_jaccard_groups_lose_no_link(frame, seed, width, per_cent):
    texts = near_copies(seed)
    sets, root = [shingles(t, width) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            same = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * same >= per_cent * (len(sets[a]) + len(sets[b]) - same):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    docs = docs_of(frame, texts)
    got = {g["doc_id"]: (g["n_shingles"], g["component_id"]) for g in partenum.jaccard_groups(docs, width, per_cent).collect()}
    assert got == {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_large_signatures_lose_no_link(frame, monkeypatch):
    monkeypatch.setattr(partenum, "_CROWD", 2)
    test_jaccard_groups_lose_no_link(frame, 1, 5, 80)


def test_sets_of_a_signature_meet_only_if_they_may_be_alike(frame):
    r = random.Random(3)
    base = [f"w{r.randrange(900)}" for _ in range(120)]
    words = [[f"w{r.randrange(900)}" for _ in range(120)] for _ in range(60)]
    words += [[w if i != at else "new" for i, w in enumerate(base)] for at in range(10, 110, 10)]
    docs = docs_of(frame, [" ".join(w) for w in words])
    sets = partenum.sets_table(docs, 5, 80).select(F.col("f1").alias("f"), "doc_id", "n", "bits").collect()
    ids, marks = {g["f"]: g["doc_id"] for g in sets}, frame([(g["f"], g["n"], g["bits"]) for g in sets], "f long, n long, bits array<long>")
    spots = marks.select(F.lit(1).cast("long").alias("key"), "f", F.col("f").alias("root"))
    met = {frozenset((ids[a], ids[b])) for a, b in partenum._met(spots, marks, 80).collect()}
    assert met == {frozenset((a, b)) for a in range(60, 70) for b in range(60, a)}


def largest_method(df):
    """Bytes of the largest method that Spark makes for a plan; Java compiles none of more than 8,000."""
    spark = df.sparkSession
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        made = debug.codegenStringSeq(df.select("*")._jdf.queryExecution().executedPlan())
        return max(made.apply(i)._3().maxMethodCodeSize() for i in range(made.size()))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_comparisons_of_sketches_are_compiled(frame):
    """A signature's or band's pairs are compared by the million, so their condition must fit a method that Java compiles."""
    spots = frame([(1, 1, 1)], "key long, f long, root long")
    marks = frame([(1, 5, [1] * 16)], "f long, n long, bits array<long>")
    assert 0 < largest_method(partenum._met(spots, marks, 80)) < 8000
    marks = frame([(1, "a line")], "lid long, line string").select("lid", F.inline(lines._marks(F.col("line"))))
    marks = frame(marks.collect(), marks.schema)
    assert 0 < largest_method(lines._met(spots.withColumnRenamed("f", "lid"), marks, 80)) < 8000


def test_only_texts_of_wanted_sets_are_read_again(frame, monkeypatch):
    texts = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(300)]
    docs = docs_of(frame, texts + texts[:50])
    sets = partenum.sets_table(docs, 5, 80).select("doc_id", "th", "f1")
    wanted = sets.where("doc_id < 20").select("f1").distinct()
    seen, sieve = [], partenum.might_hold

    def counted(*given):
        out = sieve(*given)
        seen.append(out.where("_in").count())
        return out

    monkeypatch.setattr(partenum, "might_hold", counted)
    found = {g["f1"]: len(g["features"]) for g in partenum._features_of(docs, sets, 5, wanted, frozenset()).collect()}
    assert found == {g["f1"]: 26 for g in wanted.collect()} and len(found) == 20
    assert len(seen) == 1 and 20 <= seen[0] <= 50


def test_one_of_alike_stays(frame):
    docs = odd(frame)
    out = partenum.one_per_group(docs, 3, 90)
    assert out.columns == docs.columns
    got = [r["doc_id"] for r in out.collect()]
    assert sorted(x for x in got if x is not None) == [0, 1, 2, 3, 5, 6, 8, 9] and got.count(None) == 1
    assert partenum.one_per_group(docs.limit(0), 3, 90).count() == 0


# --- decontamination -------------------------------------------------------------------------

def brute_hits(text, items, width):
    words, hit, ids = shared.letter_words((text or "").encode()), set(), set()
    for item, it in items:
        for w in decontam.windows_of(shared.letter_words((it or "").encode()), width):
            for s in range(len(words) - len(w) + 1):
                if tuple(words[s : s + len(w)]) == w:
                    hit.update(range(s, s + len(w)))
                    ids.add(str(item))
    return len(words), len(hit), sorted(ids)


@pytest.mark.parametrize("most_chars", [10**6, 400])
def test_contamination_matches_brute_force(frame, most_chars):
    """A small bound on the block takes several passes and merges them."""
    r = random.Random(3)
    text = lambda n: " ".join(r.choice(["a", "b", "c", "Dé", "x1"]) for _ in range(n))
    items = [(i, text(r.choice([1, 2, 4, 7, 9]))) for i in range(40)] + [(90, None), (91, " .,"), (92, "b; b")]
    texts = [text(r.randrange(30)) for _ in range(40)] + ODD
    bench = frame(items, "item_id bigint, text string")
    got = decontam.contamination(docs_of(frame, texts), bench, 4, most_chars).collect()
    assert len(got) == len(texts)
    for g in got:
        assert (g["n_words"], g["n_hit"], g["items"]) == brute_hits(texts[g["doc_id"]], items, 4)


@pytest.mark.parametrize("most_chars", [10**6, 60])
def test_items_without_id_contaminate(frame, most_chars):
    items = [(None, "alpha beta gamma delta"), (None, "one two three four"), (7, "red green blue grey"), (8, "no such words here")]
    texts = ["x alpha beta gamma delta y", "one two three four alpha beta gamma delta", "red green blue grey one two three four", "clean"]
    bench, docs = frame(items, "item_id bigint, text string"), docs_of(frame, texts)
    got = {g["doc_id"]: g for g in decontam.contamination(docs, bench, 4, most_chars).collect()}
    assert [got[i]["n_hit"] for i in range(4)] == [4, 8, 8, 0]
    assert [got[i]["n_items"] for i in range(4)] == [1, 1, 2, 0]
    assert [got[i]["items"] for i in range(4)] == [[], [], ["7"], []]
    assert [r["doc_id"] for r in decontam.clean_documents(docs, bench, 4).collect()] == [3]


def test_contamination_of_odd_rows(frame):
    none = frame([], "item_id bigint, text string", 1)
    assert decontam.contamination(odd(frame), none).where("n_hit = 0").count() == 12
    assert decontam.clean_documents(odd(frame), none).columns == odd(frame).columns


# --- lines -----------------------------------------------------------------------------------

def test_fuzzy_lines_keep_one_of_each(frame):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9)))
    bases = [" ".join(word() for _ in range(40)) for _ in range(30)]
    texts, near = [], 0
    for i, b in enumerate(bases):
        w = b.split()
        w[7] = "changed"
        texts += [f"Head {i}\n\n{b}", f"{' '.join(w)}\nTail {i}", f"{b.upper()} \nmore {i}"]
        near += 2
    out = {g["doc_id"]: g for g in lines.dedup_lines(docs_of(frame, texts)).collect()}
    assert sum(g["n_lines"] for g in out.values()) == 6 * 30
    dropped = sum(g["n_dropped"] for g in out.values())
    assert 0.95 * near <= dropped <= near
    for i in range(30):
        assert out[3 * i]["text"] == texts[3 * i] and out[3 * i + 2]["text"] == f"more {i}"


def line_sets(all_lines):
    return [{x[i : i + lines.WIDTH] for i in range(max(1, len(x) - lines.WIDTH + 1))} for x in all_lines]


@pytest.mark.parametrize("n, edits", [(300, 2), (300, 3), (200, 4)])
def test_edits_of_one_line_are_grouped_like_brute_force(spark, frame, n, edits):
    """Alike pairs that share a band are all joined, whatever the size of the band."""
    r = random.Random(n + edits)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 8)))
    base, texts = [word() for _ in range(60)], []
    for _ in range(n):
        w = list(base)
        for at in r.sample(range(60), edits):
            w[at] = word()
        texts.append(" ".join(w))
    texts = sorted(set(texts))
    docs = docs_of(frame, texts)
    sigs = lines.signatures(docs)
    rows = sigs.select("dk", "lid", "bands").collect()
    sets, bands = line_sets(texts), {g["dk"]: set(g["bands"]) for g in rows}
    at = {g["lid"]: g["dk"] for g in rows}
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if bands[i] & bands[j] and same * 100 >= 80 * (len(sets[i]) + len(sets[j]) - same):
                root[max(find(i), find(j))] = min(find(i), find(j))
    got = {}
    links = lines.fuzzy_links(docs, sigs).collect()
    for a, b in links:
        same = len(sets[at[a]] & sets[at[b]])
        assert same * 100 >= 80 * (len(sets[at[a]]) + len(sets[at[b]]) - same)
    for g in components.components(spark.createDataFrame(links, "a long, b long")).collect():
        got.setdefault(g["root"], set()).add(at[g["node"]])
    want = {}
    for i in range(len(texts)):
        want.setdefault(find(i), set()).add(i)
    # A link over another hub may join more than one band alone does, never less.
    assert all(any(c <= d for d in got.values()) for c in want.values() if len(c) > 1)


def test_members_of_a_band_meet_only_if_they_may_be_alike(frame):
    """Of one band of strangers and edits every alike pair meets, and few others: the count follows the alike pairs."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij\u00e9\U0001f600") for _ in range(r.randrange(3, 8)))
    base = [word() for _ in range(30)]
    texts = [" ".join(word() for _ in range(30)) for _ in range(100)] + ["short", "shorter"]
    texts += [" ".join(w if i != at else word() for i, w in enumerate(base)) for at in range(20)]
    rows = frame(list(enumerate(texts)), "lid bigint, line string")
    marks = rows.select("lid", F.inline(lines._marks(F.col("line"))))
    sets = line_sets(texts)
    assert {g["lid"]: g["n"] for g in marks.collect()} == {i: len(s) for i, s in enumerate(sets)}
    spots = rows.select(F.lit(1).cast("bigint").alias("key"), "lid", F.col("lid").alias("root"))
    met = {(g["lid"], g["hub"]) for g in lines._met(spots, marks, 80).collect()}
    alike = {(i, j) for j in range(len(texts)) for i in range(j)
             if len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j])}
    assert alike <= met and all(min(p) >= 102 for p in met) and len(alike) > 20


def test_only_lines_that_sketches_leave_open_are_compared(frame, monkeypatch):
    """Strangers and far edits in shared bands are ruled out by their sketches, in either round; every alike pair is compared."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij\u00e9\U0001f600") for _ in range(r.randrange(3, 8)))
    base = [word() for _ in range(90)]

    def edited(n):
        at = set(r.sample(range(90), n))
        return " ".join(word() if i in at else w for i, w in enumerate(base))

    texts = sorted({edited(18) for _ in range(60)} | {edited(1) for _ in range(4)} | {"a" * 90, "a" * 91 + " b", "short"})
    sets = line_sets(texts)
    rows = frame(list(enumerate(texts)), "lid bigint, line string")
    marks = {g["lid"]: g for g in rows.select("lid", F.inline(lines._marks(F.col("line")))).collect()}
    for g in lines._sketches(rows).collect():
        assert all(g[c] == marks[g["lid"]][c] for c in ("w", *lines._BITS)) and g["n"] >= marks[g["lid"]]["n"]
    alike = {(i, j) for j in range(len(texts)) for i in range(j)
             if len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j])}
    pairs = frame([(i, j) for j in range(len(texts)) for i in range(j)], "lid bigint, hub bigint")
    for left in (lines._sifted(pairs, lines._sketches(rows).drop("page"), 80), lines._sifted_again(pairs, rows, 80)):
        left = {(g["lid"], g["hub"]) for g in left.collect()}
        assert alike <= left and len(left) <= len(alike) + 3
    compared, verified = [], lines._verified

    def counted(pairs, *more):
        compared.append(pairs.count())
        return verified(pairs, *more)

    monkeypatch.setattr(lines, "_verified", counted)
    docs = docs_of(frame, texts)
    assert lines.fuzzy_links(docs, lines.signatures(docs)).count() and len(alike) >= 6
    assert sum(compared) <= len(alike) + 3


@pytest.mark.parametrize("sign", ["\r", "\x85", "\u2028", "\u2029"])
def test_shingles_go_across_signs_that_do_not_end_lines(frame, sign):
    short, long = [f"a1{sign}b2{sign}c3{sign}d4", f"a1{sign}x7{sign}y8{sign}z9"], sign.join(f"word{i}" for i in range(12))
    rows = frame([(i, x) for i, x in enumerate([*short, long])], "i int, line string", 1)
    got = rows.select("i", lines._shingles(F.col("line")).alias("s")).collect()
    assert {g["i"]: set(g["s"]) for g in got} == dict(enumerate(line_sets([*short, long])))
    bands = {g["i"]: g["bands"] for g in lines._with_bands(rows).collect()}
    assert all(bands.values())
    out = lines.dedup_lines(docs_of(frame, short)).collect()
    assert sorted(g["text"] for g in out) == sorted(short)


def test_lines_of_odd_rows(frame):
    docs = odd(frame)
    got = lines.dedup_lines(docs)
    assert got.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    rows = {(r["doc_id"], r["source"]): r for r in got.collect()}
    assert rows[(0, "s0")]["text"] is None and rows[(1, "s1")]["text"] == "" and rows[(4, "s1")]["n_dropped"] == 1
    assert rows[(7, "s1")]["text"] == "" and rows[(6, "s0")]["text"] == "same text here"
    assert lines.dedup_lines(docs.limit(0)).count() == 0


# --- mix -------------------------------------------------------------------------------------

def test_mix_reaches_the_weights_and_repeats_itself(frame):
    docs = frame([(i, "x" * 99, "en", "big" if i % 10 else "small", 99) for i in range(4000)], DOCS)
    a = mixing.replicate(docs, {"big": 1.0, "small": 1.0})
    n = {r["source"]: r["count"] for r in a.groupBy("source").count().collect()}
    assert abs(n["big"] - 2000) < 200 and abs(n["small"] - 2000) < 200
    again = mixing.replicate(docs.repartition(7), {"big": 1.0, "small": 1.0})
    key = lambda d: [(r["doc_id"], r["copy"]) for r in d.select("doc_id", "copy").collect()]
    assert key(a) == key(again)
    few = mixing.replicate(docs.where("doc_id < 20"), {"big": 0.0, "small": 1.0})
    assert {r["source"] for r in few.collect()} == {"small"}


def test_mix_of_odd_rows(frame):
    out = mixing.replicate(odd(frame), power=1.0)
    assert out.columns == [c for c in odd(frame).columns if c != "copy"] + ["copy"]
    assert mixing.replicate(odd(frame).limit(0)).count() == 0
    large = mixing.replicate(frame([(1, "a", "en", "t", 1), (2, "b" * 3000, "en", "u", 1)], DOCS), {"t": 1.0, "u": 0.0})
    assert abs(large.count() - 1501) < 250


# --- chat ------------------------------------------------------------------------------------

PIECES = st.lists(st.sampled_from(["\\", "<", "[", "</s>", "[INST]", "[/INST]", " ", "<s>", "<|end|>", "|>", "<|role ", "a", "é", "\n", "<<SYS>>"]), max_size=8)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "x|>\\y"]), PIECES.map("".join)), min_size=1, max_size=5))
def test_formatted_turns_read_back(turns):
    t, whole = chat.INSTRUCT, ""
    for role, text in turns:
        before, after, _ = t.marks(role)
        whole += before + t.escape(text) + after
        assert chat.unescape(t.escape(text)) == text
    reader = chat.Reader(t)
    got = [x for c in whole for x in reader.feed(c)]
    assert got == turns and reader.buffer == ""


def test_chat_states_and_odd_rows(frame):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "</s>"), (2, 0, "assistant", "a"), (3, 0, "user", None),
            (None, None, None, None), (4, 1, "user", "b"), (4, 1, "user", "b"), (5, 0, "tool", "t" * 50_000)]
    df = frame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("state", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    flags = {c: (r["n_turns"], r["valid"], r["complete"]) for c, r in got.items()}
    assert flags == {1: (3, True, True), 2: (1, False, False), 3: (1, True, False), None: (1, False, False),
                     4: (2, False, False), 5: (1, False, False)}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"system\ns\nuser\nu\nassistant\n</s>\n").hexdigest()
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (4, hashlib.sha256(b"</s>").hexdigest())
    assert chat.format_chats(df.limit(0)).count() == 0


# --- URLs ------------------------------------------------------------------------------------

def test_urls_rules_and_list(frame):
    rows = ["http://a.org/x", "https://example.org/es/1", "http://x.example.org/en/12", "http://forexample.org/es/", "HTTP://WWW.B.net:80/p/?b=2&a=1#t",
            "http://b.net/p?a=1&b=2", "http://b.net/q", "b.net/p", None, "", "http://z.com/de/", "http://z.com/fr/", "http://c.org", "http://b.net/p?a=1&b=2"]
    pages = frame(list(enumerate(rows)), "page_id bigint, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages, frame([("https://b.net/p/?a=1&b=2",), (None,), ("x",)], "url string")).collect()}
    assert got[0] == ("a.org", "/x", "org/", "allow") and got[1][2:] == ("example.org/es/", "block")
    assert got[2][2:] == ("example.org/en/1", "block") and got[3][2:] == ("org/", "allow")
    assert got[4] == ("www.b.net:80", "/p/", None, "block") and got[5][3] == "block" and got[13][3] == "block"
    assert [got[i][3] for i in (6, 7, 8, 9)] == ["allow"] * 4 and got[8][:3] == ("", "", None)
    assert got[10][2:] == ("com/de/", "block") and got[11][2:] == ("com/fr/", "allow") and got[12][1:] == ("", None, "allow")
    assert urls.judge(pages.limit(0), pages.select("url").limit(0)).count() == 0


# --- WARC ------------------------------------------------------------------------------------

def test_salvage_recovers_what_follows_damage():
    recs = [warc.record(i, "http://a/ b\n", f"payload {i} WARC/1.1 \x1f".encode() * 9, "X", False, None) for i in range(6)]
    for pack in (lambda r: gzip.compress(r, mtime=0), lambda r: r):
        parts = [pack(r) for r in recs]
        offsets = [sum(map(len, parts[:i])) for i in range(7)]
        data = bytearray(b"".join(parts))
        data[offsets[2] + len(parts[2]) // 2] ^= 0xFF
        data = bytes(data[: offsets[4]]) + b"junk" + bytes(data[offsets[4] : -9])
        got = list(warc.salvage(data))
        ids = [x[3]["warc-record-id"] for x in got if x[0] == "record"]
        assert ids == [f"<urn:page:{i}>" for i in (0, 1, 3, 4)]
        gaps = [(x[1], x[2]) for x in got if x[0] == "gap"]
        assert gaps == [(offsets[2], offsets[3]), (offsets[4], offsets[4] + 4), (offsets[5] + 4, len(data))]


@pytest.mark.parametrize("form", [lambda d: d.hex(), lambda d: d.hex().upper(), lambda d: base64.b32encode(d).decode().lower()])
def test_salvage_takes_digests_of_other_writers(form):
    block = b"HTTP/1.1 200 OK\r\n\r\npage"

    def rec(digest):
        return b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Block-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (
            digest.encode(), len(block), block)

    good, wrong = form(hashlib.sha1(block).digest()), form(hashlib.sha1(b"other").digest())
    assert [x[0] for x in warc.salvage(rec(good) + rec(wrong) + rec("zz") + rec(good))] == ["record", "gap", "record"]


@pytest.mark.parametrize("compress", [True, False])
def test_archives_round_trip(spark, frame, tmp_path, compress):
    rows = [(1, "http://a/", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 5), (None, "u", "n")]
    pages = frame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash"))
    folder = str(tmp_path / "w")
    warc.write_archives(pages, folder, compress, per_file=2)
    got = warc.read_archives(spark, folder).collect()
    assert {g["kind"] for g in got} == {"record"} and len(got) == 6
    by = {g["record_id"]: g for g in got}
    assert by["<urn:page:1>"]["record_type"] == "revisit" and by["<urn:page:1>"]["refers_to"] == "<urn:page:2>"
    assert by["<urn:page:3>"]["refers_to"] == "<urn:page:4>" and by["<urn:page:4>"]["payload_bytes"] == 0
    assert bytes(by["<urn:page:5>"]["payload"]).decode() == rows[4][2] and bytes(by["<urn:page:2>"]["payload"]).decode() == rows[1][2]
    if compress:
        names = [p for p in pathlib.Path(folder).iterdir() if p.name.startswith("part")]
        assert sum(gzip.decompress(p.read_bytes()).count(b"WARC-Record-ID") for p in names) == 6
    warc.write_archives(pages.limit(0), str(tmp_path / "e"), compress)
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


# --- tokens ----------------------------------------------------------------------------------

@settings(max_examples=150, deadline=None)
@given(st.sets(st.binary(min_size=1, max_size=4).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=12),
       st.sets(st.binary(min_size=1, max_size=4).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=12),
       st.lists(st.binary(max_size=14).map(lambda b: bytes(97 + x % 3 for x in b)), max_size=20))
def test_automaton_counts_like_longest_match(start, rest, words):
    a = wordpiece.Automaton(start, rest)
    for w in words:
        assert a.count(w) == wordpiece.greedy_count(w, start, rest)


def test_token_counts_of_odd_rows(frame):
    start, rest = wordpiece.load_vocabulary(VOCABULARY)
    got = wordpiece.token_counts(odd(frame), start, rest).collect()
    for r in got:
        if r["doc_id"] is not None:
            words = wordpiece.split_words((ODD[r["doc_id"]] or "").encode())
            assert r["n_tokens"] == sum(wordpiece.greedy_count(w + b"\0", start, rest) for w in words)
    assert len(got) == 12 and wordpiece.token_counts(odd(frame).limit(0), start, rest).count() == 0


# --- quality ---------------------------------------------------------------------------------

def test_flat_trees_walk_like_single_ones():
    import numpy as np

    r = np.random.default_rng(0)
    x = r.normal(size=(600, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] < -0.2)).astype(float)
    t = quality.fit(x, y, rounds=30, depth=3)

    def walk(row):
        total = t.base
        for node in t.roots:
            while t.left[node] != node:
                node = t.left[node] if row[t.feature[node]] <= t.limit[node] else t.right[node]
            total += t.value[node]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(t.score(x), [walk(row) for row in x])
    assert ((t.score(x) > 0.5) == (y > 0.5)).mean() > 0.95
    one = quality.fit(x, np.ones(600))
    assert len(set(one.score(x))) == 1 and one.score(x)[0] > 0.9
    assert quality.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_quality_on_held_out_rows(spark, frame):
    docs, labels = (shared.read(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    trees = quality.train(docs, labels)
    scored = quality.quality_scores(docs, trees).join(labels, "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in scored)
    assert right >= 0.95 * len(scored)
    assert quality.quality_scores(odd(frame), trees).count() == 12
    assert quality.good_documents(odd(frame), trees).columns == odd(frame).columns
    assert quality.train(docs.limit(0), labels.limit(0)).score(__import__("numpy").zeros((1, 29))).tolist() == [0.5]


def test_repeated_rows_of_an_id_are_learned_once(frame, monkeypatch):
    texts = [f"some text number {i} " * (i % 7 + 1) for i in range(40)]
    docs = docs_of(frame, texts)
    labels = frame([(i, i % 2) for i in range(40)], "doc_id bigint, quality int")
    sizes = []
    monkeypatch.setattr(quality, "fit", lambda x, y: sizes.append(len(x)))
    learned = next(i for i in range(40) if docs.where(F.col("doc_id") == i).where(~quality.held_out(F.col("doc_id"))).count())
    quality.train(docs, labels)
    one = docs.where(F.col("doc_id") == learned)
    quality.train(docs.union(one.crossJoin(frame([(i,) for i in range(300)], "i int")).select(docs.columns)), labels)
    assert sizes[0] == sizes[1] <= 40
    many = one.crossJoin(frame([(i,) for i in range(300)], "i int")).withColumn("text", F.concat("text", "i")).select(docs.columns)
    quality.train(docs.union(many), labels, 50)
    assert 25 <= sizes[2] <= 80


# --- the pipeline ----------------------------------------------------------------------------

def test_stages_hold_on_their_own_input(spark):
    from tapeflow.plans.tables import keep

    docs = shared.read(spark, SF, "documents")
    items = [(r["item_id"], r["text"]) for r in shared.read(spark, SF, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = keep(stage(spark, docs, SF))
        before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (docs, out))
        assert set(after) <= set(before)
        if name != "mixing to target weights":
            assert out.columns == docs.columns and after
        if name == "n-gram Jaccard join":
            sets = [shingles(t, 5) for t in after.values()]
            sets = [s for s in sets if s]
            assert not any(100 * len(a & b) >= 80 * len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a & b)
            assert {t for t in before.values() if not shingles(t, 5)} <= set(after.values())
        if name == "benchmark decontamination":
            assert all((brute_hits(t, items, 10)[1] == 0) == (i in after) for i, t in before.items())
        docs = out


# --- names that operators use themselves, roles with control strings, archives by size ------------

INNER = ("_spans", "_dk", "_th", "_src", "_parts", "_cdf", "_n", "_at", "_word", "_bits", "_word0", "_bits0", "_canon", "_hash", "_in",
         "_listed", "n_words", "n_hit", "n_items", "items", "n_lines", "n_dropped", "dk", "th", "line", "lid", "gone", "g", "f1")


def test_columns_named_like_inner_ones_stay(frame):
    texts = ["one two three four five six seven eight nine ten eleven", "clean text of its own\nand a line", None, "same\nsame", "same"]
    docs = docs_of(frame, texts).withColumns({c: F.lit(f"mine {c}") for c in INNER})
    bench = frame([("q", texts[0])], "item_id string, text string")

    def held(out, ids):
        assert out.columns == docs.columns
        got = out.collect()
        assert sorted(r["doc_id"] for r in got) == ids
        assert all(r[c] == f"mine {c}" for r in got for c in INNER)

    held(decontam.clean_documents(docs, bench), [1, 2, 3, 4])
    held(corpus_pipeline.fresh_lines(None, docs, ""), [0, 1, 2, 3])
    held(partenum.one_per_group(docs), [0, 1, 2, 3, 4])
    marked = decontam.contamination(docs.drop("n_words", "n_hit", "n_items", "items"), bench, most_chars=20)
    assert {r["doc_id"]: r["n_hit"] for r in marked.collect()}[0] == 11 and marked.first()["_spans"] == "mine _spans"
    mixed = mixing.replicate(docs)
    assert mixed.columns == [*docs.columns, "copy"] and {r["_parts"] for r in mixed.collect()} <= {"mine _parts"}
    pages = frame([(1, "http://a.b/c"), (2, "http://a.b/d")], "page_id bigint, url string").withColumns({c: F.lit(f"mine {c}") for c in INNER})
    judged = urls.judge(pages, frame([("http://a.b/c",)], "url string"))
    assert {r["page_id"]: (r["verdict"], r["_word"], r["_listed"]) for r in judged.collect()} == {
        1: ("block", "mine _word", "mine _listed"), 2: ("allow", "mine _word", "mine _listed")}


@given(st.lists(st.tuples(st.lists(st.sampled_from(["<|role ", "|>", "<|end|>", "|", ">", "\\", "[INST]", "</s>", "a", " "]), max_size=5).map("".join),
                          st.lists(st.sampled_from(["|>", "<|end|>", "<|role x|>", "\\", "hi"]), max_size=4).map("".join)), max_size=4))
@settings(max_examples=300, deadline=None)
def test_roles_that_hold_control_strings_read_back(turns):
    t, reader, got = chat.INSTRUCT, chat.Reader(chat.INSTRUCT), []
    for role, text in turns:
        before, after, _ = t.marks(role)
        for piece in (before, t.escape(text), after):
            got += reader.feed(piece)
    assert got == turns and not reader.buffer


def test_long_pages_get_files_of_their_own(spark, frame, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "CLASSES", ((1000, 5000), (20_000, 3), (None, 1)))
    r = random.Random(1)
    pages = [(i, "http://x/", "".join(r.choices("abcdefgh", k=size))) for i, size in enumerate([10] * 40 + [5000] * 8 + [50_000] * 3)]
    warc.write_archives(frame(pages, "page_id bigint, url string, html string", 1), str(tmp_path / "w"))
    sizes = sorted(f.stat().st_size for f in (tmp_path / "w").glob("part-*"))
    assert len(sizes) == 1 + 3 + 3 and sizes[-1] < 40_000
    found = warc.read_archives(spark, str(tmp_path / "w"))
    got = {x["record_id"]: x["payload"].decode() for x in found.where("kind = 'record'").collect()}
    assert got == {f"<urn:page:{i}>": html for i, _, html in pages} and found.where("kind = 'gap'").count() == 0


# --- recall of the line bands ------------------------------------------------------------------

def alike_lines(every, like=80):
    """All pairs of different lines whose shingle sets are alike, by a prefix of rare shingles: no pair is lost."""
    sets = {x: s for x, s in zip(every, line_sets(every), strict=True)}
    often = {}
    for s in sets.values():
        for g in s:
            often[g] = often.get(g, 0) + 1
    index, out = {}, set()
    for x in sorted(sets, key=lambda x: (len(sets[x]), x)):
        own = sets[x]
        for g in sorted(own, key=lambda g: (often[g], g))[: len(own) - -(-len(own) * like // 100) + 1]:
            for y in index.get(g, ()):
                if (x, y) not in out and len(sets[y]) * 100 >= len(own) * like:
                    same = len(own & sets[y])
                    if same * 100 >= like * (len(own) + len(sets[y]) - same):
                        out.add((x, y))
            index.setdefault(g, []).append(x)
    return out


def test_recall_of_line_bands_on_the_given_documents(spark):
    """At sf0.01 the bands find 0.95 or more of the alike pairs, and lines of such pairs end in one component."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    lines_of = [x.strip(" \t\r") for r in docs.collect() for x in (r["text"] or "").lower().split("\n")]
    every = sorted({x for x in lines_of if x})
    pairs = alike_lines(every)
    sigs = lines.signatures(docs)
    ids = {r["x"]: r["lid"] for r in spark.createDataFrame([(x,) for x in every], "x string").select("x", lines._line_id(F.col("x")).alias("lid")).collect()}
    bands = {r["lid"]: set(r["bands"]) for r in sigs.select("lid", "bands").dropDuplicates(["lid"]).collect()}
    met = sum(bool(bands[ids[x]] & bands[ids[y]]) for x, y in pairs)
    roots = {r["node"]: r["root"] for r in components.components(lines.fuzzy_links(docs, sigs)).collect()}
    joined = sum(roots.get(ids[x], x) == roots.get(ids[y], y) for x, y in pairs)
    print(f"{len(every)} lines, {len(pairs)} alike pairs, {met} share a band, {joined} joined")
    assert len(pairs) > 100 and met >= 0.95 * len(pairs) and joined >= met
