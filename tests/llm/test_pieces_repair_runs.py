"""Piece encoding, conversation repair and periodic runs against plain definitions and odd inputs."""

import hashlib
import itertools
import pathlib
import random
import sys
import zlib
from fractions import Fraction

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))

from tapeflow.llm import pieces, repair, runs  # noqa: E402
from tapeflow.llm.queries import PIECES  # noqa: E402

DOCS = "doc_id bigint, text string"
ODD = [None, "", "  \n\t", "a", "x " * 6000, "same text", "same text", "é ü あ\U0001f600 <0x41> <s>", "a" * 20000, " " * 300, "a\0b▁c"]
CLASHING = ("ids", "decoded", "runs", "n_words", "pos", "block", "edit", "seq", "h", "w", "copies", "first")


@pytest.fixture(scope="module", autouse=True)
def package_on_workers(spark):
    spark.sparkContext.environment["PYTHONPATH"] = str(pathlib.Path(__file__).resolve().parents[2])


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd_docs(frame):
    rows = [*enumerate(ODD), (None, "no id"), (5, "same text")]
    return rows, frame(rows, DOCS).withColumns({c: F.lit("mine") for c in CLASHING})


# --- pieces ------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_encodes_and_decodes_like_the_library(library):
    own, r = pieces.Encoder(pieces.load_model(PIECES)), random.Random(5)
    signs = "aeiou nrst▁  \n\0<0x41>é漢😀ﷺ̀"
    for _ in range(1500):
        text = "".join(r.choice(signs) for _ in range(r.randrange(60)))
        assert own.encode(text) == library.encode(text)
        ids = [r.choice([r.randrange(300), r.randrange(32000), r.randrange(3, 259)]) for _ in range(r.randrange(12))]
        assert own.decode(ids) == library.decode(ids)
    for text in ("ab" * 20000, "=-" * 9000 + "x", " " * 5000, "漢" * 5000):
        assert own.encode(text) == library.encode(text)


@given(st.lists(st.text("ab", min_size=2, max_size=5), max_size=9, unique=True), st.data())
@settings(max_examples=300, deadline=None)
def test_backtracking_equals_merging(merged, data):
    scores = {"a": (-1.0, 0), "b": (-1.0, 1)}
    for i, p in enumerate(merged):
        scores[p] = (float(data.draw(st.integers(-3, 3))), i + 2)
    v = pieces.Vocabulary(scores, list(range(100, 356)), [], 99, False)
    text = data.draw(st.text("abc", max_size=40))
    own = pieces.Encoder(v)
    assert [own.text(i) for i in own.split(text)] == v.merge(text)


def test_encoded_odd_rows(frame, library):
    rows, docs = odd_docs(frame)
    got = pieces.digest(pieces.encode_documents(docs, pieces.load_model(PIECES))).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert pieces.encode_documents(docs.limit(0), pieces.load_model(PIECES)).count() == 0


def test_bytes_that_are_no_text(spark):
    docs = spark.sql("SELECT 1L AS doc_id, X'61FF62' AS text")
    assert pieces.encode_documents(docs, pieces.load_model(PIECES)).first()["decoded"] == "a�b"


# --- repair ------------------------------------------------------------------------------------

def cheapest(letters):
    """All edit strings with up to len + 2 insertions, by definition."""
    best, todo = None, [(0, "", 0, "")]
    limit = 2 * len(letters) + 10
    while todo:
        cost, audit, i, out = todo.pop()
        if cost > limit or (best and (cost, audit) > best and cost > best[0]):
            continue
        body = out[1:] if out.startswith("s") else out
        if any(c != "ua"[k % 2] for k, c in enumerate(body)):
            continue
        if i == len(letters) and (out == "" or (body and len(body) % 2 == 0)):
            best = min(best or (cost, audit), (cost, audit))
        todo += [(cost + 5, audit + "I", i, out + c) for c in "ua"]
        if i < len(letters):
            c = letters[i]
            more = 5 * c.isupper()
            todo.append((cost + 2, audit + "D", i + 1, out))
            if c != "x":
                if c.lower() in "sua":
                    todo.append((cost + more, audit + "K", i + 1, out + c.lower()))
                todo += [(cost + 1 + more, audit + "R", i + 1, out + t) for t in "ua"]
    return best


def test_lightest_derivation_equals_all_edits():
    r = random.Random(2)
    for n in range(6):
        for _ in range(40):
            letters = "".join(r.choice("suaoxUAS") for _ in range(n))
            steps = [repair.row_edits(c) for c in letters]
            want = cheapest(letters)
            assert repair.goal_of(steps) == want, letters
            for size in (1, 2, 3):
                parts = [repair.spans_of(steps[k : k + size]) for k in range(0, n, size)]
                assert repair.goal_of([repair.step_of(p) for p in parts]) == want, letters


CONV = "conv_id bigint, turn bigint, role string, text string"


def by_hand(rows):
    """The contract's columns for one conversation's rows after damage."""
    rows = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2]))
    seen, letters, count = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        solid = text.strip(" \t\n\v\f\r")
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        c = role[:1] if role[:1] in ("s", "u", "a") else "o"
        letters += "x" if fault in ("blank", "duplicate") else c.upper() if fault else c
        if fault:
            count[fault] += 1
    cost, audit = repair.goal_of([repair.row_edits(c) for c in letters])
    out, left = [], list(rows)
    for e in audit:
        want = "user" if not out or out[-1][0] in ("a", "s") else "assistant"
        if e == "I":
            out.append((want[0], f"{want}:"))
        else:
            _, role, text = left.pop(0)
            if e != "D":
                role = want if e == "R" else role
                out.append((role[:1], f"{role}:{text}"))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (gaps, *count.values(), illegal, cost, audit, sha("\n".join(x for _, x in out)))


@pytest.mark.parametrize("bits", [1, 8])
def test_repair_of_odd_rows(frame, bits):
    r = random.Random(4)
    rows = [(None, 1, "user", "no id."), (1, None, None, None), (1, 2, "user", "Hi."), (1, None, "", "x"), (2, 1, "assistant", "\t \n"),
            (3, 5, "tool", "a."), (3, 5, "tool", "a."), (3, 5, "user", "a."), (3, -4, "user", "long " * 20000), (4, 1, "umpire", "b!")]
    rows += [(9, t, r.choice(["user", "assistant", "system"]), r.choice(["Yes.", "No.", f"at {t}.", "cut", " "])) for t in range(300)]
    own = frame(rows, CONV).withColumns({c: F.lit("mine") for c in CLASHING})
    repaired = repair.repair(own, block_bits=bits)
    got = {x[0]: tuple(x)[1:] for x in repair.summary(repaired, own).collect()}
    groups = {}
    for c, t, role, text in rows:
        groups.setdefault(c, []).append((t, " " if role is None else role, " " if text is None else text))
    assert got == {c: by_hand(g) for c, g in groups.items()}
    assert repair.summary(repair.repair(own.limit(0)), own.limit(0)).count() == 0


def test_damage_and_conversations_without_rows(frame):
    rows = [(c, t, "user" if t % 2 else "assistant", f"Text {t}. Really?") for c in range(60) for t in range(3)] + [(None, None, None, None)]
    own = frame(rows, CONV)
    ways = {(c, t): zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20 for c, t, _, _ in rows}
    groups = {c: [] for c, _, _, _ in rows}
    for c, t, role, text in rows:
        role, text, way = role or " ", text or " ", ways[c, t]
        if way == 0:
            continue
        text = "" if way == 1 else text.replace(".", "").replace("?", "") if way == 2 else text
        groups[c] += [(t, "user" if way == 4 else role, text)] * (2 if way == 3 else 1)
    assert {0, 1, 2, 3, 4} <= set(ways.values())
    got = {x[0]: tuple(x)[1:] for x in repair.summary(repair.repair(repair.damage(own)), own).collect()}
    assert got == {c: by_hand(g) for c, g in groups.items()}
    gone = frame([(7, t, "user", "a.") for t in range(900) if zlib.crc32(f"7:{t}".encode()) % 20 == 0], CONV)
    assert tuple(repair.summary(repair.repair(repair.damage(gone)), gone).first()) == (7, 0, 0, 0, 0, 0, 0, "", sha(""))


# --- runs --------------------------------------------------------------------------------------

def all_runs(w):
    out = {}
    for q in range(1, len(w) // 3 + 1):
        i = q
        while i < len(w):
            b = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            if i - b + q >= max(24, 3 * q):
                out.setdefault((b - q, i), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def loops(r):
    w = []
    for _ in range(r.randrange(1, 9)):
        signs = r.choice(["ab", "abcdefgh"])
        if r.random() < 0.6:
            w += ([r.choice(signs) for _ in range(r.choice([1, 1, 2, 3, 4, 5, 7, 8, 9, 12, 16, 17, 25]))] * 40)[: r.randrange(1, 130)]
        else:
            w += [r.choice(signs) for _ in range(r.randrange(40))]
        if w and r.random() < 0.3:
            w += w[-r.randrange(1, len(w) + 1) :] * r.randrange(1, 4)
        w = w[:500]
    return w


def test_runs_equal_all_lags():
    r, found = random.Random(1), 0
    for _ in range(800):
        w = loops(r)
        want = all_runs(w)
        found += len(want)
        assert runs.periodic_runs(w) == want
    assert found > 1000
    assert runs.periodic_runs(["a"] * 200_000) == [(0, 200_000, 1)]


def test_run_digests_of_odd_rows_and_planted_loops(frame):
    r = random.Random(3)
    rows, docs = odd_docs(frame)
    rows = rows + [(100 + i, " \n".join(loops(r) + [f"w{k}" for k in range(r.randrange(80))])) for i in range(120)]
    docs = docs.union(frame(rows[len(ODD) + 2 :], DOCS).withColumns({c: F.lit("mine") for c in CLASHING}))
    want = []
    for i, t in rows:
        w = [x.decode() for x in (t or "").encode().split()]
        n, h = len(w), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
        own = all_runs(w)
        best = min(own, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if own else None
        drop = {k for s, size, q in own for k in range(s + q, s + size)}
        want.append((i, len(own), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                     sha("".join(f"{s},{size},{q}\n" for s, size, q in own)), sha(" ".join(x for k, x in enumerate(w) if k not in drop))))
    got = runs.summary(runs.find_runs(runs.with_loops(docs))).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert runs.find_runs(docs.limit(0)).count() == 0
