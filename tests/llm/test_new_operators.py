"""Fill-in-the-middle, prefix trie and toxicity."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import ODD, SF, documents, frame, wide

from voxelith.llm import fillmiddle as M
from voxelith.llm import prefixtrie as P
from voxelith.llm import toxicity as T
from voxelith.llm.queries import ORACLES, QUERIES

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]")


def by_sql(name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(ORACLES[name])
    return [d[0] for d in cur.description], sorted(cur.fetchall(), key=str)


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_prefix_trie"])
def test_equals_its_sql(spark, name):
    names, want = by_sql(name)
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect()), key=str) == want


# --- fill in the middle ---


def filled(i, t):
    t = t or ""
    w = TOKEN.findall(t)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(w) + 1), h2 % (len(w) + 1)))
    p, m, s = ("".join(x) for x in (w[:a], w[a:b], w[b:]))
    form = "plain" if t == "" or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90 else "spm" if h4 % 100 < 20 else "psm"
    out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    size = (None, None) if form == "plain" else (len(p), len(m))
    return (i, len(w), form, *size, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest(), out)


@pytest.mark.parametrize("size, group", [(M.CHUNK, M.GROUP), (97, 3), (7, 2)])
def test_fill_in_middle_by_chunks(spark, size, group):
    rng = random.Random(size)
    bits = ["a", "Bc", " ", "\n", "é", "中", "\U0001f600", "<P", ">", "<", "0", "zzzzzzzzzzzz"]
    rows = [(1000 + i, "".join(rng.choices(bits, k=rng.randrange(60)))) for i in range(60)] + [(i, t) for i, t in ODD if size > 100 or len(t or "") < 700]
    rows += [(77, "a <M> b"), (78, "x" * 500), (79, "中" * 300)] + [(80, "ab 中" * 40000)] * 2 * (size > 100)
    got = M.fill_in_middle(frame(spark, rows), size=size, group=group)
    assert sorted(map(tuple, got.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256", "output").collect()), key=str) == sorted((filled(*r) for r in rows), key=str)


def test_forms_restore_their_texts():
    rng = random.Random(4)
    for _ in range(500):
        t = "".join(rng.choices(["<", ">", "P", "S", "<P", "M>", "a"], k=rng.randrange(12))).encode()
        if any(s in t for s in (b"<P>", b"<S>", b"<M>")):
            continue
        a, b = sorted((rng.randrange(len(t) + 1), rng.randrange(len(t) + 1)))
        for form in ("psm", "spm", "plain"):
            assert M.restore(M.assemble(t, form, a, b), form) == t


def test_summaries_compose_in_any_grouping():
    rng = random.Random(5)
    text = "".join(rng.choices(["a", "bc", " ", "é", "1"], k=400)).encode()
    whole = M.scan(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    state, n = 0, 0
    cuts = sorted({0, len(text), *(x for x in (rng.randrange(len(text)) for _ in range(60)) if text[x] & 0xC0 != 0x80)})
    for x, y in zip(cuts, cuts[1:]):
        ends, counts, *_ = M.scan(np.frombuffer(text[x:y], np.uint8), np.array([0, y - x]))
        state, n = int(ends[0, state]), n + int(counts[0, state])
    assert (state, n) == (int(whole[0][0, 0]), int(whole[1][0, 0])) == (int(text[-1:].isalpha()), len(TOKEN.findall(text.decode())))


def test_fill_in_middle_takes_wide_and_empty_tables(spark):
    assert M.fill_in_middle(wide(spark)).count() == len(ODD)
    assert M.fill_in_middle(frame(spark, [])).collect() == []


# --- prefix trie ---


def brute_trie(rows):
    turns = {}
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).digest())):
        turns.setdefault(c, []).append((r or "", x or ""))
    nodes = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = turns.get(c - int(np.fmod(c, 20)), [])
        seq = tuple(base[:h] + own[h:])
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append((c, len(seq) == d))
    kids = {}
    for s in nodes:
        if s:
            kids.setdefault(s[:-1], []).append(s)
    out = []

    def walk(s):
        below = [walk(k) for k in kids.get(s, [])]
        leaves = sum(b[0] for b in below) or 1
        saved = sum(b[1] for b in below) + (len(re.findall(r"[^\x20\x09-\x0D]+", s[-1][1])) * (len(nodes[s]) - 1) if s else 0)
        ends = ",".join(str(c) for c in sorted(c for c, e in nodes[s] if e))
        up = min(c for c, _ in nodes[s[:-1]]) if s else None
        out.append((min(c for c, _ in nodes[s]), len(s), up, len(nodes[s]), len(below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if nodes:
        walk(())
    return sorted(out, key=str)


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")


@pytest.mark.parametrize("part_turns", [P.PART_TURNS, 60, 5])
def test_trie_of_odd_conversations(spark, part_turns):
    rng = random.Random(part_turns)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["one", "two words", "", None, "a b c"])) for c in [*range(0, 70), -21, -40, 10**15] for t in range(rng.choice([1, 1, 2, 3, 9]))]
    rows += [(c, t, "user", "copied turn here") for c in range(2000, 2090) for t in range(3)]  # one group of copies, over many parts
    rows += [(None, 1, "user", "x"), (5, None, "user", "null turn first"), (5, 0, "user", "tie a"), (5, 0, "user", "tie b"), (5, 0, "user", "tie b")] + [(4001, t, "user", str(t)) for t in range(60)]
    got = P.trie(P.rebuilt(conversations(spark, rows)), part_turns=part_turns)
    assert sorted(map(tuple, got.select(NAMES).collect()), key=str) == brute_trie(rows)


def test_trie_of_an_empty_table_and_of_extra_columns(spark):
    assert P.trie(P.rebuilt(conversations(spark, []))).collect() == []
    rows = [(1, 0, "a", "x"), (2, 0, "a", "y")]
    more = conversations(spark, rows).selectExpr("*", "1 as part", "2 as node", "3 as own", "4 as first", "5 as h", "6 as words", "7 as code")
    assert sorted(map(tuple, P.trie(P.rebuilt(more)).select(NAMES).collect()), key=str) == brute_trie(rows)


def test_merge_never_compares_known_turns(monkeypatch):
    rng = random.Random(8)
    code = lambda k: bytes([k]) * P.CODE
    rows = sorted((b"".join(code(1 + rng.randrange(2)) for _ in range(rng.randrange(12))), i) for i in range(400))
    runs = [P.encode_run([(k, i, np.ones(len(k) // P.CODE, int)) for k, i in rows[j::7]]) for j in range(7)]
    looked = []
    real = P.shared_turns
    monkeypatch.setattr(P, "shared_turns", lambda a, b, known=0: looked.append((n := real(a, b, known)) - known) or n)
    got = list(P.merged(runs))
    assert [(k, i) for i, _, k, _ in got] == rows
    assert all(n == real(a[2], b[2]) for (a, b), n in zip(zip(got, got[1:]), (g[1] for g in got[1:])))
    assert sum(looked) < sum(len(k) // P.CODE for k, _ in rows) + len(rows)  # every turn is passed over about once


# --- toxicity ---


def toxic_rows(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices(["th", "er", "in", "on", "ea", "sh", "ti", "al", "or"], k=rng.randrange(1, 4))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        w = rng.choices(words, k=rng.randrange(20, 150))
        bad = i % 8 == 0
        if bad:
            for _ in range(max(2, len(w) // 25)):
                w[rng.randrange(len(w))] = rng.choice(["grobnik", "Vaskomir!", "plethuzz", "quornible"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return docs, labels


def test_toxic_documents_are_told_from_others(spark):
    docs, labels = toxic_rows(2400, 1)
    model = T.fit(frame(spark, docs).where(~T.held_out(F.col("doc_id"))), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    got = {r.doc_id: r for r in T.score(frame(spark, [*docs, *((i, t) for i, t in ODD if i is None)]), model).collect()}
    mark = dict(labels)
    held = [i for i in mark if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {i for i in mark if got[i].held_out} == set(held) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    hit = [got[i].predicted for i in held if mark[i]]
    miss = [got[i].predicted for i in held if not mark[i]]
    assert np.mean(hit) > 0.95 and np.mean(miss) < 0.01


def test_held_out_documents_of_the_small_table(spark):
    base = SF.replace("0.001", "0.01")
    got = QUERIES["op13_toxicity"](spark, base).join(spark.read.parquet(f"{base}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    s1, s0 = ([r.score for r in got if r.toxic == k] for k in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in s1 for b in s0]) > 0.7  # 34 toxic documents to learn from
    assert np.mean([x >= 0.7 for x in s0]) < 0.06


def test_windows_cover_whole_texts(monkeypatch):
    text = " ".join(f"Word{i}" for i in range(5000)) + " last, word"
    for piece in (T.PIECE, 100):
        monkeypatch.setattr(T, "PIECE", piece)
        got = [w[: -len(T._END)] for w in T.windows(text)]
        assert b"".join(w[: T.WINDOW] for w in got[:-1]) + got[-1] == f" {' '.join(T._WORD.findall(text.lower()))} ".encode()
        assert all(len(w) <= T.WINDOW + T.REACH for w in got)
    assert list(T.windows(None)) == list(T.windows("")) == [b" " + T._END]


def test_without_two_classes_every_score_is_zero(spark):
    odd = frame(spark)
    for labels in ([], [(9, 1)], [(9, 0), (None, 1), (10, None)]):
        model = T.fit(odd, spark.createDataFrame(labels, "doc_id bigint, toxic int"))
        assert {(r.score, r.predicted) for r in T.score(wide(spark), model).collect()} == {(0.0, 0)}
    assert T.score(frame(spark, []), model).collect() == []
