"""Tokenising, packing, language id, quality rules, sharding and HTML."""

import base64
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql import functions as F
from tests.llm.helpers import ODD, SF, WORD, documents, frame, wide
from tokenizers import Tokenizer

from voxelith.llm.bpe import encode_decode
from voxelith.llm.htmltext import extract, main_text
from voxelith.llm.langid import fit, held_out, identify, temperature
from voxelith.llm.packing import _best_fit, pack, plan, solve
from voxelith.llm.quality import RULES, cascade, judge, keep_good, measures
from voxelith.llm.sharding import shard_rows, walk
from voxelith.llm.textbatch import chunks, pretokens

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tok():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def all_rows():
    d = documents()
    return ODD + list(zip((d.doc_id + 1000).tolist(), d.text.tolist()))


def test_pretokens_are_the_patterns_matches():
    rng = random.Random(1)
    bits = ["'", "s", "re", " ", "  ", "\n", "\t", "a", "é", "1", "½", "!", "'ll", "　", "中", "\U0001f600", "'ve", "\x1c", "d"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(30))) for _ in range(3000)] + [None, ""]
    for first, data, off in chunks(pa.array(texts)):
        s, e, b = pretokens(data, off)
        raw = data.tobytes()
        for i in range(len(off) - 1):
            assert [raw[x:y].decode() for x, y in zip(s[b[i] : b[i + 1]], e[b[i] : b[i + 1]])] == regex.findall(P.PATTERN, texts[first + i] or "")


def test_bpe_equals_the_library_and_decodes_to_the_text(spark, tok):
    rows = all_rows()
    got = encode_decode(frame(spark, rows), RANKS, with_ids=True).collect()
    by = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in got)
    want = Counter()
    for i, t in rows:
        ids = tok.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest(), tuple(ids)] += 1
    assert by == want
    assert encode_decode(wide(spark), RANKS).count() == len(ODD) and encode_decode(frame(spark, []), RANKS).count() == 0


def test_packing_keeps_every_token_once(spark):
    rows = all_rows()
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    got = pack(frame(spark, rows), JSON).collect()
    want = Counter()
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        head, a, n = len(ids) % 2048 or 2048, 0, 0
        b = head
        while a < len(ids):
            want[i, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
            a, b, n = b, b + 2048, n + 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    at = defaultdict(list)
    for r in got:
        at[r.sequence_id].append((r.offset, r.length))
    for parts in at.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end = o + n
        assert end <= 2048
    least = -(-sum(r.length for r in got) // 2048)
    assert len(at) <= least + max(2, least // 50)
    assert pack(wide(spark), JSON).count() == len([1 for r in got if r.doc_id is None or r.doc_id < 1000]) and pack(frame(spark, []), JSON).count() == 0


def test_plans_hold_the_histogram_and_are_tight():
    rng = np.random.default_rng(0)
    for n, top in ((1, 2048), (50, 100), (3000, 2048), (3000, 700)):
        lengths = np.minimum(top, rng.lognormal(5.5, 1.0, n).astype(int) + 1)
        counts = Counter(lengths.tolist())
        got = plan(counts, rounds=30)
        held = Counter()
        for config, many in got:
            assert sum(k * v for k, v in config.items()) <= 2048
            for k, v in config.items():
                held[k] += v * many
        assert held == counts and sum(m for _, m in got) <= sum(m for _, m in _best_fit(dict(counts), 2048)) + 1
    assert plan({}) == []


def test_the_configuration_program_places_most_pieces():
    rng = np.random.default_rng(1)
    counts = Counter(np.minimum(2048, rng.lognormal(5.5, 1.0, 3000).astype(int) + 1).tolist())
    for times in (1, 1000):
        said, many = {}, {k: v * times for k, v in counts.items()}
        sequences = sum(m for _, m in plan(many, said=said))
        assert said["program"] >= 0.5 * sequences and said["dual"] <= sequences <= 1.002 * said["dual"] + 1
        assert sequences <= 1.001 * sum(m for _, m in _best_fit(dict(many), 2048)) + 1
    lengths = np.array([512, 1024])  # two of the one and one of the other fill a sequence
    uses, primal, dual = solve(lengths, np.array([200.0, 100.0]), 2048)
    assert dual == 100 and 100 <= primal <= 102


def test_language_id_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out(docs.doc_id)))
    got = identify(docs, model).join(docs, "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 for r in got) and sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)
    assert sum(r.held_out for r in got) == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(1000))
    assert (model.weights == 0).mean() > 0.5
    odd = {r.doc_id: r for r in identify(frame(spark), model).collect()}
    assert odd[1].lang_pred == odd[2].lang_pred == odd[12].lang_pred == "und" and odd[12].score == 0
    assert odd[11].lang_pred in model.classes
    none = fit(wide(spark).selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {r.lang_pred for r in identify(frame(spark), none).collect()} == {"und"}


def test_temperature_cools_sure_but_wrong_logits():
    z, y = np.array([[9.0, 0], [9, 0], [9, 0], [9, 0]]), np.array([0, 0, 0, 1])
    assert temperature(z, y) > 3 and temperature(z[:0], y[:0]) == 1.0


def quality_brute(text):
    words = WORD.findall(text or "")
    wins = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if wins[tuple(words[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    base = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), base


def test_quality_counts_and_order_of_rules(spark):
    rows = all_rows() + [(5000, "a b c d e f g h " * 3 + "x y z"), (5001, " ".join(f"w{i}" for i in range(30)) + " " + " ".join(f"w{i}" for i in range(9)))]
    got = judge(frame(spark, rows))
    assert Counter(tuple(r[:7]) for r in got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()) == Counter(
        (i, *quality_brute(t)) for i, t in rows
    )
    kept = {r.doc_id: r.kept for r in got.collect()}
    measured = frame(spark, rows).withColumn("text", F.coalesce("text", F.lit(""))).withColumn("q", measures(F.col("text")))
    assert kept == {r.doc_id: r.kept for r in measured.select("doc_id", cascade(F.col("q"), F.col("text"), RULES[::-1]).alias("kept")).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    good = [kept[r.doc_id + 1000] for r in labels if r.quality == 1]
    assert sum(good) >= 0.9 * len(good)
    assert judge(frame(spark, [])).count() == 0


def test_quality_filters_stay_linear_and_names_may_clash(spark):
    long = [(1, "word " * 100_000), (2, " ".join(f"w{i}" for i in range(100_000))), (3, None)]
    began = time.perf_counter()
    assert [r.doc_id for r in judge(frame(spark, long)).where("kept and n_repeat_words = 0").select("doc_id").collect()] == [2]
    assert [r.doc_id for r in keep_good(frame(spark, long)).select("doc_id").collect()] == [2]
    assert time.perf_counter() - began < 60
    odd = frame(spark, long).selectExpr("doc_id", "text", "'mine' as n_words", "'mine' as kept", "'mine' as q", "'mine' as row", "'mine' as t")
    got = judge(odd).collect()
    assert len(got) == 3 and all(r.q == r.row == r.t == "mine" and r.n_words in (0, 100_000) for r in got)
    assert keep_good(odd).select("doc_id", "n_words", "kept").collect() == [(2, "mine", "mine")] and keep_good(odd).columns == odd.columns


def test_sharding_is_even_and_stable(spark):
    rows = all_rows() + [(7, "x")] * 400
    got = shard_rows(frame(spark, rows)).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    slots = defaultdict(list)
    for r in got:
        assert r.law == "rows" and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert shard_rows(wide(spark)).count() == len(ODD) and shard_rows(frame(spark, [])).count() == 0


def test_few_rows_move_when_a_shard_is_added():
    rng = random.Random(0)
    counts = Counter(rng.randrange(1 << 16) for _ in range(50000))
    place = lambda n: {(p, r): s for p, a, b, s, _ in walk(counts, n) for r in range(a, b)}
    before, after = place(24), place(25)
    assert len(before) == 50000 and sum(before[x] != after[x] for x in before) < 0.25 * 50000
    hot = walk({5: 1000, 70: 3}, 4)
    assert sum(b - a for _, a, b, *_ in hot) == 1003


PAGES = [
    (None, ""), ("", ""), ("<html><body></body></html>", ""), ("plain words &amp; more", "plain words & more"),
    ('<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/x">x</a></ul></nav><div class="ad">buy</div><article><h1>Head</h1><p><b>One\n two.<br><p>Three&nbsp;&lt;four&gt;</p></article><footer>&copy; us</footer>', "Head\nOne two.\nThree <four>"),
    ('<body><header><h1>Site</h1></header><div id="cookie-notice">We use cookies on this site, agree please, it is long text</div><div class="content"><p>' + "First long paragraph. " * 9 + "</p><div class='ad-box'>advert</div><p>" + "Second. " * 9 + '</p></div><div class="comments"><p>' + "I disagree. " * 40 + "</p></div><form><label>mail</label></form>", ("First long paragraph. " * 9).strip() + "\n" + ("Second. " * 9).strip()),
    ("<article><p>a<div class=sidebar><p>side</p></div><p>b</article><article class=comment><p>hello there long comment</p></article>", "a\nb"),
    ("<p>unclosed <b>bold <a href='x>y'>link</a> text", "unclosed bold link text"), ("<article><p>cut off <a hre", "cut off"),
]


def test_pages(spark):
    for page, want in PAGES:
        assert main_text(page) == want, page
    df = spark.createDataFrame([(i, f"u{i}", p) for i, (p, _) in enumerate(PAGES)], "page_id bigint, url string, html string").selectExpr("*", "1 as text", "2 as n_chars")
    assert [(r.text, r.n_chars) for r in extract(df).orderBy("page_id").collect()] == [(t, len(t)) for _, t in PAGES]
    assert extract(df.limit(0)).count() == 0
    import html as h
    import pandas as pd

    for r in pd.read_parquet("/root/testdata/sf0.01/pages.parquet").itertuples():
        inner = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        blocks = [" ".join(h.unescape(re.sub(r"<(?!/?(?:p|h1)\b)[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", inner)]
        assert main_text(r.html) == "\n".join(b for b in blocks if b)


def test_html_keeps_what_adverts_interrupt():
    long, short, ad = "A long paragraph of the article. " * 40, "A short one.", "<div class='advert'>Buy</div>"
    L = long.strip()
    for tag in ("<div class='content'>", "<section>"):
        end = f"</{tag[1:].split()[0].strip('>')}>"
        page = f"<html><body><div><a href='/'>Home</a></div>{tag}<p>{short}</p>{ad}<p>{long}</p>{ad}<p>{short}</p>{ad}<p><a href='x'>See the source</a></p><p>{long}</p>{ad}tail text{end}<div><a href='/x'>More</a></div></body></html>"
        assert main_text(page) == "\n".join([short, L, short, "See the source", L, "tail text"])
    # a short part outside the main container, between two parts that are heavy
    page = f"<body><div><p>{long}</p></div>{ad}<div><p>{short}</p></div>{ad}<div><p>{long}</p></div></body>"
    assert main_text(page) == "\n".join([L, short, L])
    page = f"<body><article><p>{short}</p></article><div>aside words</div><article><p>{long}</p></article><article class='comment'><p>{long}</p></article></body>"
    assert main_text(page) == f"{short}\n{L}"
