"""The training-data operators against brute force, the libraries, and DuckDB, and their edge cases."""

import hashlib
import itertools
import os
import random
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from veriset.llm import decontam, graph, line_dedup, packing, pii, quality_classifier, quality_rules, queries, simhash, suffix_dedup, token_counts, tokenise, toxicity
from veriset.llm.common import SHUFFLES_GO, cut

DATA = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor " * 20000
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, LONG), (6, "É é ñ 漢字 x\U0001f600"), (None, "no id"), (7, "a@b.cc +1 555 123 4567 10.0.0.1 4111 1111 1111 1111")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, words string, n string, h string, item string, id string, digest string"


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame([(i, t, "en", None, None, "w", "n", "h", "i", "id", "d") for i, t in EDGE], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.read.parquet(f"{DATA}/benchmark.parquet")


def frame(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {Path(f).stem} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    out = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, out))


# --- 1 -----------------------------------------------------------------------------------------------------------------

def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


@pytest.mark.parametrize("hot", [64, 1])
def test_simhash_components(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT", hot)
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(150):  # chains of few changed bits
        f = rng.choice(fps)
        fps.append(f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    reps = spark.createDataFrame([(i, f) for i, f in {f: i for i, f in reversed(list(enumerate(signed)))}.items() for i, f in [(f, i)]], "rep long, fp long")
    edges = simhash.link_exact(spark, reps)
    got = {r.node: r.component for r in graph.connected_components(spark, edges).collect()}
    first = {}
    want = components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    for i, f in enumerate(fps):
        r = first.setdefault(f, i)
        assert got.get(r, r) == want[i]


def test_simhash_query(spark, docs):
    got = {r.doc_id: r for r in queries.op1_simhash(spark, DATA).collect()}
    texts = [(r.doc_id, r.text or "") for r in docs.collect()]
    fps = [brute_fingerprint(t) for _, t in texts]
    want = components(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2])
    least = {}
    for i, c in enumerate(want):
        least[c] = min(least.get(c, 1 << 62), texts[i][0])
    for i, (d, _) in enumerate(texts):
        assert got[d].fingerprint == f"{fps[i]:016x}"
        assert got[d].component_id == least[want[i]]


def test_near_copies_go(spark):
    rng = random.Random(1)
    base = [[f"w{rng.randint(0, 5000)}" for _ in range(300)] for _ in range(30)]
    texts = [" ".join(b) for b in base] + [" ".join(w if i != 100 else "changed" for i, w in enumerate(b)) for b in base[:10]] + [" ".join(base[0])]
    kept = {r.doc_id for r in simhash.deduplicate(spark, frame(spark, texts)).collect()}
    assert kept == set(range(30))


@pytest.mark.parametrize("crowd", [1000, 3, 1])
def test_wide_links(spark, monkeypatch, crowd):
    """All pairs of keys that aren't crowded are compared; of crowded ones few links are lost and none is made up."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(5)
    lanes, width, radius = 2, 8, 12
    fps = [rng.getrandbits(128) for _ in range(30)]
    for _ in range(170):  # chains, so that parts under one key lie at all distances
        f = rng.choice(fps)
        fps.append(f ^ sum(1 << b for b in rng.sample(range(128), rng.randint(1, 16))))
    fps = list(dict.fromkeys(fps))
    words = lambda f: [x - (1 << 64) if x >> 63 else x for x in (f & (1 << 64) - 1, f >> 64)]
    parts = simhash.link_wide(spark, spark.createDataFrame([(i, words(f)) for i, f in enumerate(fps)], "rep long, fp array<bigint>"), lanes, radius, width, 16)
    got = {r.node: r.component for r in parts.collect()}
    keys = simhash.block_keys(np.array([words(f) for f in fps], np.int64).view(np.uint64), width, 16)
    links = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= radius and (keys[i] == keys[j]).any()]
    want, have = components(len(fps), links), [got.get(i, i) for i in range(len(fps))]
    if crowd == 1000:
        assert have == want
    assert all(want[i] == want[c] for i, c in enumerate(have))
    assert len(set(have)) <= 1.05 * len(set(want))


@pytest.mark.parametrize("crowd, block", [(4, 512), (1, 7)])
def test_wide_links_of_crowded_keys_are_whole(spark, monkeypatch, crowd, block):
    """Chains, stars and strangers under few keys: every link of a crowded key counts, whatever the block."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "BLOCK", block)
    lanes, width, radius, n_keys = 2, 4, 12, 3
    words = lambda f: [x - (1 << 64) if x >> 63 else x for x in (f & (1 << 64) - 1, f >> 64)]
    rng = random.Random(block)
    fps = [rng.getrandbits(128) for _ in range(60)]
    for _ in range(140):
        fps.append(rng.choice(fps[-30:]) ^ sum(1 << b for b in rng.sample(range(128), rng.randint(6, 16))))
    fps = list(dict.fromkeys(fps))
    rng.shuffle(fps)
    parts = simhash.link_wide(spark, spark.createDataFrame([(i, words(f)) for i, f in enumerate(fps)], "rep long, fp array<bigint>"), lanes, radius, width, n_keys)
    got = {r.node: r.component for r in parts.collect()}
    keys = simhash.block_keys(np.array([words(f) for f in fps], np.int64).view(np.uint64), width, n_keys)
    links = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= radius and (keys[i] == keys[j]).any()]
    want = components(len(fps), links)
    assert [got.get(i, i) for i in range(len(fps))] == want and len(set(want)) > 1


def test_block_plan():
    share = simhash.differing(0.8)
    for n in (1, 1000, 10**6, 10**10):
        width, keys = simhash.block_plan(n, 2048, share)
        assert n / 2**width <= 1 / 8 and 1 - (1 - (1 - share) ** width) ** keys >= 0.92
    fps = np.random.default_rng(0).integers(0, 1 << 63, (5, 32), dtype=np.uint64)
    keys = simhash.block_keys(fps, 22, 120)
    assert keys.shape == (5, 120) and len(np.unique(keys >> 22)) == 120 and np.array_equal(keys, simhash.block_keys(fps[:5], 22, 120))


@pytest.mark.parametrize("edits, least", [(4, 0.98), (7, 0.95), (9, 0.9)])
def test_recall_of_near_copies(spark, edits, least):
    """End to end: of pairs with a similarity of 0.8 or more, as many as promised lose one document; unrelated texts stay."""
    rng, texts, near = random.Random(edits), [], []
    for _ in range(150):
        a = [f"w{rng.randint(0, 20000)}" for _ in range(400)]
        b = list(a)
        for i in rng.sample(range(400), edits):
            b[i] = "changed%d" % rng.randint(0, 10**9)
        p, q = ({tuple(t[i : i + 5]) for i in range(396)} for t in (a, b))
        near.append(len(p & q) / len(p | q) >= 0.8)
        texts += [" ".join(a), " ".join(b)]
    kept = {r.doc_id for r in simhash.deduplicate(spark, frame(spark, texts)).collect()}
    assert set(range(0, 300, 2)) <= kept
    assert sum(2 * i + 1 not in kept for i, n in enumerate(near) if n) >= least * sum(near) and sum(near) > 50


# --- 2 -----------------------------------------------------------------------------------------------------------------

def plain_spans(t):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        s = sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and s % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_pii_base(docs):
    rng = random.Random(0)
    made = ["".join(rng.choice("ab@@..-+ 0123456789 ()%") for _ in range(200)) for _ in range(400)] + ["a@b@c.de", "a@b.c.", "1.2.3.4.5.6.7.8", "4111-1111-1111-1111", "+1 (212) 555-0199", "é@b.cc x@é.cc"]
    for t in made + [r.text for r in docs.collect()]:
        assert pii.base_spans(t) == plain_spans(t)


def test_pii_labels_spread_to_alike_tokens():
    known = [f"card 4111 1111 1111 1111 and call +1 212 555 01{i:02d} or mail joe{i}@mail.com on 12345678" for i in range(20)]
    field = pii.train(known)
    t = "pay with 4111 1111 1111 1111 today. " + "x " * 500 + "card 4111.1111.1111.1111 again, order 87654321"
    base, every = pii.spans(t, field)
    assert set(base) < set(every)
    assert [t[a:b] for k, a, b in every if (k, a, b) not in base] == ["4111.1111.1111.1111"]
    assert "[card]" in pii.redact(t, every)


def pii_texts(n, seed):
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        d = digits(15)
        return next(d + c for c in "0123456789" if pii.luhn(d + c))

    words = lambda: " ".join(rng.choice(["order", "call", "ref", "the", "ship", "note", "pay"]) for _ in range(rng.randint(3, 12)))
    made = lambda: rng.choice([card(), f"+{digits(2)} {digits(3)} {digits(7)}", f"u{digits(3)}@mail{digits(1)}.com", ".".join(str(rng.randint(0, 255)) for _ in range(4)), digits(rng.choice([6, 7, 8, 12])), f"{digits(4)}-{digits(2)}-{digits(2)}"])
    return [" ".join(f"{words()} {made()}" for _ in range(rng.randint(1, 5))) + " " + words() for _ in range(n)]


def test_pii_adds_respelled_spans():
    """Precision and recall of the added spans on texts whose matches were partly respelled."""
    field = pii.train(pii_texts(600, 1))
    hit = made_up = missed = 0
    for seed, t in enumerate(pii_texts(400, 2)):
        text, planted = pii.planted(t, 10**6 + seed)
        base, every = pii.spans(text, field)
        assert base == pii.base_spans(text) and set(base) <= set(every)
        want = {(k, a, b) for (a, b), k in planted.items()}
        more = set(every) - set(base)
        near = lambda x, ys: any(x[0] == k and x[1] < b and a < x[2] for k, a, b in ys)
        hit += sum(near(w, more | set(base)) for w in want)
        missed += sum(not near(w, more | set(base)) for w in want)
        made_up += sum(not near(m, want) for m in more)
    assert hit / (hit + missed) > 0.9 and hit / (hit + made_up) > 0.9


def test_pii_marginals_are_exact_on_trees():
    rng = np.random.default_rng(4)
    n, k = 5, len(pii.LABELS)
    edges = [(0, 1, 0), (1, 2, 0), (1, 3, 1), (3, 4, 0)]
    local, chain, skip = rng.normal(size=(n, k)), rng.normal(size=(k, k)), rng.normal(size=(k, k))
    graph = pii.Messages(n, edges)
    beliefs = graph.run(local, chain, skip, 200)
    want, pair = np.zeros((n, k)), np.zeros((len(edges), k, k))
    for labels in itertools.product(range(k), repeat=n):
        p = np.exp(sum(local[i, x] for i, x in enumerate(labels)) + sum((skip if s else chain)[labels[i], labels[j]] for i, j, s in edges))
        for i, x in enumerate(labels):
            want[i, x] += p
        for e, (i, j, _) in enumerate(edges):
            pair[e, labels[i], labels[j]] += p
    assert np.allclose(pii.normal(beliefs), want / want.sum(1, keepdims=True), atol=1e-3)
    assert np.allclose(graph.pair_marginals(beliefs, chain, skip), pair / pair.sum((1, 2), keepdims=True), atol=1e-3)


def test_pii_labels_reach_the_fiftieth_return():
    field = pii.train(pii_texts(600, 1))
    text = "pay 4111 1111 1111 1111 now" + "".join(f" word{i} and then 4111.1111.1111.1111 again," for i in range(50))
    base, every = pii.spans(text, field)
    assert len(base) == 1 and [k for k, _, _ in every] == ["card"] * 51


def test_pii_query(spark, docs):
    got = {r.doc_id: r for r in queries.op2_pii(spark, DATA).collect()}
    for r in docs.collect():
        base = plain_spans(r.text or "")
        want = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        q = got[r.doc_id]
        assert [q.n_email, q.n_ip, q.n_card, q.n_phone] == [sum(k == kind for k, _, _ in base) for kind in pii.KINDS]
        assert q.base_sha256 == hashlib.sha256(want.encode()).hexdigest() and set(filter(None, want.split(","))) <= set(q.spans.split(","))


def brute_matches(texts, items, size, slack):
    """Exact windows, and places where the two rarest terms of a window stand within ``slack`` of their distance."""
    split = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if w]
    docs, freq = [split(t) for t in texts], Counter(w for t in texts for w in split(t))
    out = set()
    for item, text in items:
        w = split(text)
        for window in {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else ():
            rare = sorted(range(len(window)), key=lambda i: (freq[window[i]], i))[:2]
            for d, words in enumerate(docs):
                out |= {(d, item, "phrase", i, 0) for i in range(len(words) - len(window) + 1) if tuple(words[i : i + len(window)]) == window}
                if len(rare) == 2:
                    one, two = ([p - o for p, x in enumerate(words) if x == window[o]] for o in rare)
                    out |= {(d, item, "proximity", a, b - a) for a in one for b in two if abs(a - b) <= slack}
    return out


@pytest.mark.parametrize("rows", [500_000, 0])
def test_phrase_and_proximity_matches(spark, monkeypatch, rows):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", rows)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(12)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(40)] + [None, "", "Start w1, rare w2 w3; w1 w2 END rare2"]
    texts += ["x w1 rare w2 w3 w1", texts[3], texts[3]]
    items = [("a", "w1 rare w2 w3 w1"), ("b", texts[5]), ("c", "w4"), ("d", None), ("e", "w1 w2 w1 w2"), ("b2", texts[5])]
    got = decontam.matches(spark, frame(spark, texts), spark.createDataFrame(items, "item_id string, text string"), 4, 3)
    got = [tuple(r) for r in got.select("doc_id", "item_id", "kind", "start", "gap").collect()]
    want = brute_matches(texts, items, 4, 3)
    assert len(got) == len(set(got)) and set(got) == want and {k for _, _, k, _, _ in want} == {"phrase", "proximity"}


def test_matches_of_empty_tables(spark, docs, bench):
    assert decontam.matches(spark, docs.limit(0), bench).collect() == decontam.matches(spark, docs, bench.limit(0)).collect() == []


# --- 5 -----------------------------------------------------------------------------------------------------------------

def test_lines_once(spark):
    rng = random.Random(2)
    say = lambda n: " ".join(f"w{rng.randint(0, 9999)}" for _ in range(n))
    passage = "\n".join(say(12) + "." for _ in range(12))
    texts = [say(20) + ".\n" + passage + "\n" + say(20) + "." for _ in range(6)] + [say(60) for _ in range(5)]
    df = frame(spark, texts).withColumn("n_chars", F.length("text"))
    got = {r.doc_id: r for r in line_dedup.apply(spark, df).collect()}
    assert got[0].text == texts[0] and all(got[i].text == texts[i] for i in range(6, 11))
    for i in range(1, 6):
        assert len(got[i].text) < 0.6 * len(texts[i]) and got[i].n_chars == len(got[i].text)


@pytest.mark.parametrize("lines, words", [(4, 15), (6, 10), (8, 15), (20, 4), (2, 30), (13, 4)])
def test_repeated_passages_go_whole(spark, lines, words):
    rng = random.Random(lines)
    say = lambda n: " ".join(f"w{rng.randint(0, 99999)}" for _ in range(n)) + "."
    texts, own = [], []
    for _ in range(30):
        passage = " ".join(say(words) for _ in range(lines))
        around = [[say(rng.randint(3, 20)) for _ in range(4)] for _ in range(2)]
        texts += [f"{a} {b}{sep}{passage}{sep}{c}\n{d}" for (a, b, c, d), sep in zip(around, (" ", "\n\n"))]
        own += [around[1]]
    got = {r.doc_id: r.text for r in line_dedup.apply(spark, frame(spark, texts)).collect()}
    for k, (a, b, c, d) in enumerate(own):
        assert got[2 * k] == texts[2 * k] and got[2 * k + 1].split() == f"{a} {b} {c} {d}".split()


def test_ranges_have_the_least_passages(spark):
    rng = random.Random(9)
    texts = []
    for most in (3, 12, 30, 60):  # words of a line
        for _ in range(6):
            lines = [rng.choice(("  ", " ", "\t", " ")).join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(1, most))) for _ in range(rng.randint(1, 90))]
            texts.append("".join(rng.choice(("", " ")) + x + rng.choice(("\n", " \n", ".\n \n", "\t\n\n")) for x in lines))
    stored = cut(spark, line_dedup.cut_lines(frame(spark, texts)), "lines")
    rows, asked = {r.doc_id: r for r in stored.collect()}, []
    for i, r in rows.items():
        solid = [x.strip() for x in r.lines if x.strip()]
        assert "".join(r.lines) == texts[i] and [r.lines[k].strip() for k in r["at"]] == solid and r.words == [len(x.split()) for x in solid]
        gaps = {rng.randrange(len(solid)) for _ in range(rng.randint(0, 5))}
        asked.append((i, [(j, h) for j, h in enumerate(r.hs) if j not in gaps]))
    found = line_dedup.ranges(stored.join(spark.createDataFrame(asked, "doc_id long, asked array<struct<j: int, h: long>>"), "doc_id"))
    # no expression over each line again: what made up most of the pipeline's line dedup
    assert "regexp" not in (plan := found._jdf.queryExecution().optimizedPlan().toString().lower()) and "rlike" not in plan
    for r in found.collect():
        words, here, want = rows[r.doc_id].words, {j for j, _ in dict(asked)[r.doc_id]}, set()
        for a in range(len(words)):
            one = next((b for b in range(a, len(words)) if sum(words[a : b + 1]) >= line_dedup.WORDS), None)
            other = next((b for b in range(a, -1, -1) if sum(words[b : a + 1]) >= line_dedup.WORDS), None)
            want |= {(a, one)} if one is not None and here.issuperset(range(a, one + 1)) else set()
            want |= {(other, a)} if other is not None and here.issuperset(range(other, a + 1)) else set()
        got = [(u.p, u.q) for u in r.units if u.p is not None]
        assert len(got) == len(set(got)) and set(got) == want
        assert all(r.solid[u.p : u.q + 1] == [x.strip() for x in r.lines[u.i : u.e + 1] if x.strip()] for u in r.units if u.p is not None)


def test_blanks_before_other_line_ends_count(spark):
    # U+2028 is no white space here: these texts differ in a word
    texts = [" ".join(f"w{i}" for i in range(60)) + end for end in (" \u2028", "\u2028")]
    assert {r.doc_id: r.text for r in line_dedup.apply(spark, frame(spark, texts)).collect()} == dict(enumerate(texts))


def test_periodic_text_keeps_its_first_passage(spark):
    line = " ".join(f"w{i}" for i in range(20)) + ".\n"
    got = {r.doc_id: r.text for r in line_dedup.apply(spark, frame(spark, [line * 40, line * 2])).collect()}
    assert got[0].startswith(line) and len(got[0]) <= 3 * len(line) and set(got) <= {0, 1}


# --- 6, 8 --------------------------------------------------------------------------------------------------------------

ODD = ["", " ", "a  b", " a", "a ", "\n", "don't  stop", "<|endoftext|> a<|endoftext|>b", "a\x1cb c", "É é é x", "it's, we'll. I'd!", "a.b, 12.5, 3,4 ., ..", "\ta\t b", "漢字 。 かな", "İstanbul ΣΑΣ ß. ŉ Ĳ", "́ a ́b", LONG]


def test_tokens_are_the_librarys(docs):
    from tokenizers import Tokenizer

    texts = ODD + [r.text for r in docs.collect()]
    a, b = queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("word_bpe_49k.json")
    assert tokenise.count_tokens(texts, a) == [len(e.ids) for e in Tokenizer.from_file(a).encode_batch(texts, add_special_tokens=False)]
    assert tokenise.token_ids(texts, b) == [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(b).encode_batch(texts, add_special_tokens=False)]


def test_every_letter_before_a_mark():
    from tokenizers import Tokenizer

    texts = [f"a{chr(c)}. {chr(c)}? x" for c in [*range(0x3100), *range(0xA000, 0xABFF), *range(0xF900, 0x10900), *range(0x1D400, 0x1D500), *range(0x1E900, 0x1E960)] if not 0xD800 <= c < 0xE000]
    a, b = queries.tokenizer_file("byte_bpe_50k.json"), queries.tokenizer_file("word_bpe_49k.json")
    assert tokenise.count_tokens(texts, a) == [len(e.ids) for e in Tokenizer.from_file(a).encode_batch(texts, add_special_tokens=False)]
    assert tokenise.token_ids(texts, b) == [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(b).encode_batch(texts, add_special_tokens=False)]


def test_query_keeps_a_cache(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/kept"
    spark.conf.set(queries.TOKEN_CACHE, path)
    try:
        first = sorted(map(tuple, queries.op6_token_counts(spark, DATA).collect()))
        n = spark.read.parquet(path).count()
        assert sorted(map(tuple, queries.op6_token_counts(spark, DATA).collect())) == first and spark.read.parquet(path).count() == n
    finally:
        spark.conf.unset(queries.TOKEN_CACHE)


@pytest.mark.parametrize("kept", [False, True])
def test_counts_go_to_few_files(spark, tmp_path, monkeypatch, kept):
    path, texts = queries.tokenizer_file("byte_bpe_50k.json"), [f"w{i % 150} x" if i % 3 else "a b" for i in range(300)]
    shared, cache = f"file://{tmp_path}", f"file://{tmp_path}/kept" if kept else None
    monkeypatch.setattr(token_counts, "shared_dir", lambda s: shared)
    monkeypatch.setattr("veriset.llm.common.shared_dir", lambda s: shared)
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        token_counts.count_tokens(spark, frame(spark, texts), path, cache).write.parquet(f"{shared}/out")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    files = Counter(f.parent for f in tmp_path.rglob("part-*.parquet"))
    assert len(files) == 2 + kept and max(files.values()) <= spark.sparkContext.defaultParallelism
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in spark.read.parquet(f"{shared}/out").collect()}
    assert got == {i: (len(t), n) for i, (t, n) in enumerate(zip(texts, tokenise.count_tokens(texts, path)))}


def test_cache_encodes_misses_only(spark, tmp_path, monkeypatch):
    path, cache = queries.tokenizer_file("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    first = token_counts.count_tokens(spark, frame(spark, ["a b", "a b", "c", None]), path, cache).collect()
    asked = []
    plain = token_counts.encode_missing
    monkeypatch.setattr(token_counts, "encode_missing", lambda m, p: (asked.append(m.count()), plain(m, p))[1])
    again = token_counts.count_tokens(spark, frame(spark, ["a b", "d e f", None]), path, cache).collect()
    assert sorted(r.n_tokens for r in first) == [0, 1, 2, 2] and sorted(r.n_tokens for r in again) == [0, 2, 3] and asked == [1]


def test_packing_round_trip(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS", 40)  # several partitions and rounds
    from tokenizers import Tokenizer

    path = queries.tokenizer_file("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = packing.pack(spark, packing.pieces(docs, path)).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for d in docs.collect():
        ids = t.encode(d.text or "", add_special_tokens=False).ids + [0]
        parts = sorted(by_doc[d.doc_id], key=lambda r: r.piece)
        assert [r.start for r in parts] == list(range(0, len(ids), 2048))
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_seq) <= 1.05 * sum(r.length for r in rows) / 2048 + 2


# --- 7 -----------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("hot", [2000, 3])
def test_repeats_by_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(50)] + ["été", "the"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = [say(rng.randint(30, 80)) for _ in range(6)]
    texts = ["", "abc", "x" * 500, "ab" * 300] + [say(rng.randint(5, 100)) + " " + rng.choice(shared) + " " + say(30) for _ in range(40)]
    texts += texts[4:8] + [t[:50] + "Q" + t[51:] for t in texts[10:20]] + [t + t for t in texts[20:22]]
    raws = [t.encode() for t in texts]
    seen = Counter(r[i : i + 200] for r in raws for i in range(len(r) - 199))
    got = {r.doc_id: r for r in suffix_dedup.removal(spark, frame(spark, texts)).collect()}
    for d, r in enumerate(raws):
        mask = np.zeros(len(r), bool)
        for i in range(len(r) - 199):
            if seen[r[i : i + 200]] > 1:
                mask[i : i + 200] = True
        kept = bytes(np.frombuffer(r, np.uint8)[~mask])
        runs = int((np.diff(np.concatenate(([0], mask.astype(int)))) == 1).sum())
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(r), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest())


def test_rows_that_share_an_id_share_no_bytes(spark):
    rng = random.Random(6)
    say = lambda n: " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(n))
    twice = say(60)
    rows = [(None, say(200)), (None, say(40) + "|" + twice + "|" + say(40)), (1, say(30) + "#" + twice + "#" + say(50)), (1, say(150)), (1, say(150)), (2, "short"), (2, "short"), (None, None)]
    got = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.kept_sha256): r for r in suffix_dedup.removal(spark, got).collect()}
    for i in (0, 3, 4, 5, 7):
        r = got[rows[i][0], hashlib.sha256((rows[i][1] or "").encode()).hexdigest()]
        assert r.n_removed == 0 and r.n_spans == 0
    assert sorted(r.n_removed for r in got.values() if r.n_spans) == [len(twice)] * 2


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 99, 400).astype(np.uint8)
    raw = text.tobytes()
    sa, _ = suffix_dedup.suffix_array(text, 400)
    assert sa.tolist() == sorted(range(400), key=lambda i: raw[i:])
    want = [0] + [next((k for k in range(50) if raw[a + k : a + k + 1] != raw[b + k : b + k + 1] or not raw[a + k : a + k + 1]), 50) for a, b in zip(sa, sa[1:])]
    assert suffix_dedup.common_prefixes(text, sa, 50).tolist() == want


# --- 9, 10 -------------------------------------------------------------------------------------------------------------

def made_texts(bad, n=400, seed=0):
    rng = random.Random(seed)
    texts, y = [], []
    for i in range(n):
        w = [f"{rng.choice('abcdefgh')}{rng.choice('aeiou')}{rng.choice('klmn')}" for _ in range(rng.randint(40, 120))]
        y.append(i % 3 == 0)
        if y[-1]:
            bad(rng, w)
        texts.append(" ".join(w))
    return texts, [int(v) for v in y]


def insult(rng, w):
    for _ in range(4):
        w.insert(rng.randrange(len(w)), rng.choice(["zzidiot", "zzmoron", "yyscum"]))


def grams_of(texts):
    g, n = toxicity.counted(sorted({w for t in texts for w in toxicity.units(t)}), toxicity.SHARED + 1)
    return dict(zip(g.tolist(), n.tolist()))


def test_toxicity_held_out():
    texts, y = made_texts(insult)
    model = toxicity.Model(toxicity.fit_texts(texts[:300], y[:300], 1 / 3, grams_of(texts)))
    got = model.probabilities(texts[300:]) >= 0.5
    assert np.mean(got == np.array(y[300:])) > 0.95
    assert 0 <= model.probabilities([""])[0] <= 1


def test_toxicity_models_are_distributions():
    """Each class's word probabilities, spelled in brute force from the counts, sum to at most 1 and agree with the model's ratios."""
    texts, y = made_texts(insult, 60)
    state = toxicity.fit_texts(texts, y, 1 / 3, grams_of(texts))
    model = toxicity.Model(state)

    def spell(tables, word):
        p, raw = 1.0, b"\x01" + word.encode() + b"\x02"
        for i in range(1, len(raw)):
            q = 1 / 256
            for k, (keys, share, contexts, down) in enumerate(tables, 1):
                g = int.from_bytes(raw[max(0, i - k + 1) : i + 1])
                q = dict(zip(keys.tolist(), share)).get(g, 0.0) + dict(zip(contexts.tolist(), down)).get(g >> 8, 1.0) * q
            p *= q
        return p

    words = ["zzidiot", "zzidiots", "aak", "nothing", "é"]
    want = []
    for c in (0, 1):
        own = dict(zip(state["words"].tolist(), state["share"][c]))
        want.append([own.get(xxhash.xxh64_intdigest(w), 0.0) + state["left"][c] * spell(state["levels"][c], w) for w in words])
        assert np.isclose(sum(own.values()) + state["left"][c], 1)
        for k, (keys, share, contexts, down) in enumerate(state["levels"][c]):  # shares and what is passed down make one
            total = dict(zip(contexts.tolist(), down))
            for g, s in zip(keys.tolist(), share):
                total[g >> 8] += s
            assert np.allclose(list(total.values()), 1)
    learned = model.learn(words)
    assert np.allclose([learned[w] for w in words], np.log(np.array(want[1]) / np.array(want[0])))
    assert learned["zzidiots"] > 3  # an unseen form of a toxic word


def test_toxicity_reads_whole_words(monkeypatch):
    texts, y = made_texts(insult)
    model = toxicity.Model(toxicity.fit_texts(texts, y, 1 / 3, grams_of(texts)))
    a, b = "x" * 100 + "zzidiot", "x" * 100 + "abababa"
    assert model.ratios([a])[0] != model.ratios([b])[0] and not any(len(w) > toxicity.LONG_WORD for w in model.memory)
    whole = model.ratios(texts)
    monkeypatch.setattr(toxicity, "PIECE", 50)
    monkeypatch.setattr(toxicity, "REMEMBER", 20)
    assert np.allclose(toxicity.Model(model.state).ratios(texts), whole)


def test_shared_grams_cover_all_documents(spark, docs):
    got = {r.gram: r.n for r in toxicity.shared_grams(toxicity.word_counts(docs)).collect()}
    assert got == grams_of([r.text or "" for r in docs.collect()])


def test_quality_held_out():
    texts, y = made_texts(lambda rng, w: w.__setitem__(slice(None), [x + "$$$" if rng.random() < 0.5 else x for x in w]))
    model = quality_classifier.train(texts[:300], [1 - v for v in y[:300]], 2 / 3)
    memory = quality_classifier.Memory(model.gain)
    got = [model.score(t, memory) >= 0.5 for t in texts[300:]]
    assert np.mean(np.array(got) != np.array(y[300:], bool)) > 0.95
    assert 0 <= model.score("", memory) <= 1


def test_quality_reads_long_words_whole(monkeypatch):
    gain = np.random.default_rng(0).normal(size=quality_classifier.BUCKETS + 1)
    model, memory = quality_classifier.Model(gain, 0.0), quality_classifier.Memory(gain)
    a, b = "x" * 60 + "good" * 50, "x" * 60 + "evil" * 50
    assert model.score(a, memory) != model.score(b, memory) and not memory
    assert set(quality_classifier.features(a, {})[0]) != set(quality_classifier.features(b, {})[0])
    monkeypatch.setattr(quality_classifier, "PIECE", 7)
    f = quality_classifier.word_features(a)
    assert np.isclose(quality_classifier.word_gain(a, gain), complex(gain[f].sum(), len(f)))


# --- edge cases ---------------------------------------------------------------------------------------------------------

def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def some_labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 8)] + [(None, 1, 0), (1, None, None), (10**9, 1, 1)], "doc_id long, quality int, toxic int")


def with_copies(docs):
    return docs.unionByName(docs.filter("doc_id = 7"))


OPERATORS = {
    "simhash": lambda s, d, b: simhash.near_duplicates(s, d),
    "simhash wide": lambda s, d, b: simhash.near_duplicates(s, d, 5, 16, 160, share=0.15),
    "pii": lambda s, d, b: pii.find(d, pii.fit(s, d)),
    "quality rules": lambda s, d, b: quality_rules.judge(s, d),
    "decontamination": lambda s, d, b: decontam.report(s, d, b),
    "line dedup": lambda s, d, b: line_dedup.deduplicated(s, d),
    "token counts": lambda s, d, b: token_counts.count_tokens(s, d, queries.tokenizer_file("byte_bpe_50k.json")),
    "suffix dedup": lambda s, d, b: suffix_dedup.removal(s, d),
    "quality classifier": lambda s, d, b: quality_classifier.score(d, quality_classifier.fit(s, d, no_labels(s), F.lit(True))),
    "toxicity": lambda s, d, b: toxicity.score(d, toxicity.fit(s, d, no_labels(s), F.lit(True))),
    "quality classifier, trained": lambda s, d, b: quality_classifier.score(d, quality_classifier.fit(s, with_copies(d), some_labels(s), F.lit(True))),
    "toxicity, trained": lambda s, d, b: toxicity.score(d, toxicity.fit(s, with_copies(d), some_labels(s), F.lit(True))),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_edge_rows(spark, edge, bench, name):
    f = OPERATORS[name]
    rows = f(spark, edge.filter("doc_id is not null"), bench).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in EDGE if i is not None)
    assert len({repr(r) for r in rows if r.doc_id == 4}) == 1  # repeated rows fare alike
    f(spark, edge, bench).collect()  # a null id does no harm
    assert f(spark, edge.limit(0), bench.limit(0)).collect() == []


def test_packing_edge(spark, edge):
    path = queries.tokenizer_file("word_bpe_49k.json")
    rows = packing.pack(spark, packing.pieces(edge, path)).collect()
    assert {r.doc_id for r in rows} == {i for i, _ in EDGE} and min(r.length for r in rows) == 1
    assert packing.pack(spark, packing.pieces(edge.limit(0), path)).collect() == []


WORKER = """
import pickle, re, sys
import pyarrow as pa

def held():
    return sum(map(int, re.findall(r"Pss_(?:Anon|Shmem):\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) // 1024

def texts(n):
    for k in range(0, n, 1000):
        words = [str(i).translate(str.maketrans("0123456789", "abcdefghij")) for i in range(20 * k, 20 * k + 20_000)]
        yield pa.RecordBatch.from_arrays([pa.array([" ".join(words[i : i + 20]) for i in range(0, 20_000, 20)])], names=["text"])

cache, run = pickle.load(sys.stdin.buffer)
n = sum(b.num_rows for b in run(texts(1000)))
before = held()
cache("ids:some").update((f"word {i}", b"1234") for i in range(500_000))
kept = len(cache("ids:some"))
n = sum(b.num_rows for b in run(texts(15_000)))
print(n, kept, len(cache("ids:some")), before, held())
"""


def test_toxicity_leaves_no_memory_in_workers(spark):
    """An idle worker counts to its executor: it keeps neither what another step remembered nor what this one counted."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    from veriset.llm.common import worker_cache

    class Docs:
        def select(self, *columns):
            return self

        groupBy = agg = select

        def mapInArrow(self, run, schema):  # noqa: N802
            self.run = run
            return self

    run = toxicity.word_counts(Docs()).run
    out = subprocess.run([sys.executable, "-c", WORKER], input=cloudpickle.dumps((worker_cache, run)), capture_output=True, check=True, cwd="/").stdout
    n, kept, left, before, after = map(int, out.split())
    assert n > 200_000 and kept == 500_000
    assert left == 0 and after < before + 40


def test_pipeline_stages(spark, docs, edge, tmp_path):
    import shutil

    shutil.copytree(DATA, tmp_path / "in")
    texts = {r.doc_id: r.text for r in docs.collect()}
    passage = duckdb.sql(f"select text from '{DATA}/benchmark.parquet' where length(text) > 200 limit 1").fetchall()[0][0]
    rng = random.Random(9)
    clean = " ".join(f"clean{rng.randint(0, 99999)}" for _ in range(200))
    extra = [(900001, clean), (900002, clean), (900003, "start here " + passage + " end"), (900004, None), (900004, None)]
    more = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in extra], docs.schema)
    d = docs.unionByName(more)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = cut(spark, stage(spark, d, f"{tmp_path}/in"))
        assert d.columns == docs.columns, name
    left = {r.doc_id for r in d.collect()}
    assert 900001 in left and not {900002, 900003} & left
    assert len(left) > 0.5 * len(texts)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, edge.select(docs.columns), f"{tmp_path}/in").collect()
        stage(spark, docs.limit(0), f"{tmp_path}/in").collect()


def _shuffle_files(spark) -> set[str]:
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (found.apply(i).getName() for i in range(found.size())) if n.startswith("shuffle_")}


def test_cut_leaves_no_shuffle_files(spark):
    before, setting = _shuffle_files(spark), spark.conf.get(SHUFFLES_GO, None)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    found = cut(spark, df, "no-shuffle")
    for _ in range(50):  # they are deleted in the background
        if not _shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not _shuffle_files(spark) - before
    assert spark.conf.get(SHUFFLES_GO, None) == setting
    want = {(k, len(range(k, 1000, 7))) for k in range(7)}
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in df.collect()} == {tuple(r) for r in cut(spark, df).collect()} == want
