import random

from tests.llm.helpers import ODD, WORD, documents, frame, wide

from voxelith.llm import linededup
from voxelith.llm.linededup import dedup_lines


def brute(rows, percent=80):
    lines = [((i, n), frozenset(WORD.findall(t))) for i, x in rows if i is not None and x is not None for n, t in enumerate(x.split("\n"))]
    lines = sorted((p, s) for p, s in lines if s)
    by, gone, seen = {}, set(), []
    for at, s in lines:
        near = {j for w in s for j in by.get(w, ())}
        if any(100 * len(s & seen[j][1]) >= percent * len(s | seen[j][1]) and seen[j][0] < at for j in near):
            gone.add(at)
        for w in s:
            by.setdefault(w, []).append(len(seen))
        seen.append((at, s))
    return gone


def check(spark, rows, df=None):
    gone = brute(rows)  # lines of rows with equal ids go by number
    want = sorted((str(i), None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if i is None or (i, n) not in gone)) for i, t in rows)
    got = dedup_lines(df if df is not None else frame(spark, rows)).collect()
    assert sorted(((str(r.doc_id), r.text) for r in got), key=str) == sorted(want, key=str)
    return got


def test_documents(spark):
    d = documents()
    check(spark, list(zip(d.doc_id.tolist(), d.text.tolist())))


def test_near_copies_short_lines_and_groups(spark):
    rng = random.Random(2)
    rows, base = [], [f"w{i}" for i in range(40)]
    for i in range(150):
        line = [w if rng.random() > 0.06 else f"x{rng.randrange(1000)}" for w in base]
        short = rng.sample(["the", "of", "and", "to", "in", "a", "is"], rng.randrange(3, 8))
        rows.append((i, "\n".join([" ".join(line), " ".join(short), "", f"only here {i} alone and nowhere {i * 7}"])))
    got = check(spark, rows)
    assert sum(r.n_removed_lines for r in got) > 150 and all(r.n_lines == 4 for r in got)


def test_odd_rows_and_clashing_names(spark):
    rows = [r for r in ODD if r[0] != 10] + [(10, "the same text twice over and over again now")]
    check(spark, rows)
    got = dedup_lines(wide(spark, rows))
    assert got.columns[:4] == ["doc_id", "text", "id", "lang"] and got.count() == len(rows)
    assert dedup_lines(frame(spark, [])).count() == 0


def test_lines_of_a_dense_group_meet_few_of_it(spark, monkeypatch):
    rng = random.Random(5)
    base, rows = [f"w{i}" for i in range(40)], []
    for i in range(900):  # most are like many of the others, but not like one line of their group
        rows.append((i, " ".join(w if rng.random() > 0.1 else f"x{rng.randrange(40)}" for w in base)))
    tried, verified = [], linededup._verified
    monkeypatch.setattr(linededup, "_verified", lambda pairs, *a: (tried.append(pairs.count()), verified(pairs, *a))[1])
    check(spark, rows)
    assert len(tried) == 3 and tried[-1] < 35 * len(rows), tried
