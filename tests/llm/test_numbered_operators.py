"""The numbered operators on small tables against brute force, with nulls, empty and long texts, ties, repeats and odd columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from harborline.llm import bm25, bwt_dedup, extendible, jaccard_join, langid, mixing, parsing, pii, pitman_yor, sentencepieces

KIND = "doc_id long, text string"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def prose(rng, n, vocabulary=200):
    return " ".join(f"w{min(int(rng.paretovariate(0.8)), vocabulary)}" for _ in range(n))


ODD = [(None, None), (None, "null id"), (900, None), (901, ""), (902, " \t\n"), (903, "É ñ 漢字 🙂"), (904, "x" * 5000), (905, "same text here"), (905, "same text here"), (906, "same text here")]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    rows = [(i, prose(rng, rng.randint(1, 120))) for i in range(80)]
    for i in range(80, 120):  # near copies
        w = rows[i % 40][1].split()
        if i % 3 and len(w) > 20:
            w[rng.randrange(len(w))] = "edited"
        rows.append((i, " ".join(w)))
    return rows


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, KIND).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, KIND)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


# ---- 1 Pitman-Yor


def test_pitman_yor_base_and_probability(docs, corpus):
    got = pitman_yor.op1(docs).collect()
    fold = {i: zlib.crc32(str(i).encode()) % 5 for i, _ in corpus}
    count = Counter(w for i, t in corpus if fold[i] != 1 for w in [*words(t), "\n"])
    n, v = sum(count.values()), len(count)
    text = dict(corpus)
    assert len(got) == len(corpus)
    for r in got:
        tokens = [*words(text[r.doc_id]), "\n"]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold[r.doc_id] == 1, len(tokens), sum(count[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens))
        assert r.score < 0


def test_pitman_yor_beats_the_base_on_held_out_text(spark, sf_dir):
    got = [r for r in pitman_yor.op1(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_a_bucket_answers_its_blocks_together(spark, corpus, monkeypatch):
    """Contexts were looked up, and all of a bucket's sorted for it, once for every block: blocks times buckets in all."""
    rows = [(i, t or "", False, j % 40) for j, (i, t) in enumerate(corpus)]
    pairs = pitman_yor.written(pitman_yor._pairs(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean, block long"), 2), "pairs")
    fixed, seats, totals, kept = pitman_yor.fit(pairs, 2, 1, 1)
    taken, place = [], pitman_yor.Bucket.place

    class Kept:  # hands out the function that Spark would run
        def groupBy(self, _):
            return self

        def cogroup(self, _):
            return self

        def applyInArrow(self, run, _):
            return run

        def select(self, *_):
            return self

    run = pitman_yor._answers(Kept(), fixed, seats, totals, kept)
    left = pairs.where("bucket = 0").select("bucket", "block", "words", "width", "ctx").toArrow()
    right = pitman_yor._together(fixed, seats, totals).where("bucket = 0").toArrow()
    assert left.num_rows == 40
    monkeypatch.setattr(pitman_yor.Bucket, "place", lambda b, ctx: (taken.append(len(ctx)), place(b, ctx))[1])
    together = run(left, right).to_pydict()
    assert len(taken) == 1
    monkeypatch.setattr(pitman_yor, "ASKED", 1)
    assert run(left, right).to_pydict() == together and len(taken) == 41


def test_pitman_yor_scores_follow_from_the_seats(spark, corpus):
    """Seats and totals are collected; restaurants, their sums and every document's score are then made by plain loops."""
    from pyspark.sql import functions as F

    rows = [(i, t, i % 5 == 1) for i, t in corpus]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(3)
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(4)))
    pairs = pitman_yor.written(pitman_yor._pairs(dealt, 4), "pairs")
    fixed, seats, totals, kept = pitman_yor.fit(pairs, 4, 1, 2)
    seated = {r.bucket: r.seats for r in seats.collect()}
    want_c = Counter()
    for _, t, held in rows:
        if not held:
            x = [None, *words(t), "\n"]
            want_c.update(zip(x[:-1], x[1:]))

    def hashed(x):
        w, c, _ = pitman_yor._tokens(pitman_yor.pa.array([" ".join(y for y in x if y not in (None, "\n"))]))
        return w, c

    name_w, name_c = {}, {}
    for _, t, _ in rows:
        x = words(t)
        w, c = hashed(x)
        name_w.update(zip(w.tolist(), [*x, "\n"]))
        name_c.update(zip(c.tolist(), [None, *x]))
    ends = {x: c >> pitman_yor.FORM_BITS for c, x in name_c.items()}
    assert len(set(name_c.values())) == len(name_c) and ends["w10"] == ends.get("w110", ends["w10"])
    prob = []  # of each sample
    for s, g in enumerate(kept):
        t_u, t_e, t_w, c_u, c_e = Counter(), Counter(), Counter(), Counter(), Counter()
        for r in fixed.collect():
            b = pitman_yor.Bucket(r.asDict())
            t, te, tw = b.seats(seated[r.bucket][s])
            for i in range(len(b.c)):
                ctx, w = name_c[int(b.keys[b.key[i]])], name_w[int(b.words[b.word[i]])]
                assert b.c[i] == want_c[ctx, w] and 1 <= t[i] <= b.c[i]
                t_u[ctx, w], c_u[ctx, w] = int(t[i]), int(b.c[i])
                end = ends[ctx]
                c_e[end, w] += int(t[i])
                t_e[end, w] = int(te[b.up[i]])
                t_w[w] = int(tw[b.word[i]])
        assert len(c_u) == len(want_c) and all(1 <= t_e[k] <= c_e[k] for k in c_e)
        root_c, root_t = sum(t_e.values()), sum(t_w.values())
        assert (root_c, root_t) == (g["customers"], g["tables"])
        per = lambda x: Counter() if not x else sum((Counter({k[0]: v}) for k, v in x.items()), Counter())
        cu, tu, ce, te_ = per(c_u), per(t_u), per(c_e), per(t_e)
        cw = Counter()
        for (_, w), v in t_e.items():
            cw[w] += v

        def p(ctx, w):
            th, end = g["theta"], ends.get(ctx)
            top = (cw[w] - g["d0"] * t_w[w] + (th + g["d0"] * root_t) * g["h0"] if w in t_w else (th + g["d0"] * root_t) * g["unknown"]) / (th + root_c)
            mid = (c_e[end, w] - g["d1"] * t_e[end, w] + (th + g["d1"] * te_[end]) * top) / (th + ce[end])
            return (c_u[ctx, w] - g["d"] * t_u[ctx, w] + (th + g["d"] * tu[ctx]) * mid) / (th + cu[ctx])

        for ctx in [None, "w1", "w2", "w77", "never"]:
            assert sum(p(ctx, w) for w in t_w) + p(ctx, "unheard of") == pytest.approx(1)
        prob.append({(ctx, w): p(ctx, w) for _, t, _ in rows for ctx, w in zip([None, *words(t)], [*words(t), "\n"])})
    answers = pitman_yor._answers(pairs, fixed, seats, totals, kept).collect()
    got = {}
    for r in pairs.collect():
        a = next(x for x in answers if (x.block, x.bucket) == (r.block, r.bucket))
        w = np.repeat(np.frombuffer(r.words, np.uint64), np.frombuffer(r.width, np.uint32))
        for word, ctx, score in zip(w.tolist(), np.frombuffer(r.ctx, np.uint32).tolist(), np.frombuffer(a.score, np.float32).tolist()):
            got[name_c[ctx], name_w[word]] = score
    assert set(got) == set(prob[0])
    assert all(got[k] == pytest.approx(math.log10((prob[0][k] + prob[1][k]) / 2), abs=1e-5) for k in got)


def test_seating_follows_the_exact_posterior():
    rng = np.random.default_rng(0)
    d, theta, h, others, c = 0.6, 1.0, 0.05, 3, 5
    got = Counter(pitman_yor.seat(np.full(40000, c), np.full(40000, float(others)), np.full(40000, math.log(h)), d, theta, rng).tolist())

    def partitions(n):  # seatings of n customers: product of table weights by number of tables
        out = {(1,): 1.0}
        for i in range(1, n):
            new = {}
            for tables, w in out.items():
                for k in range(len(tables)):
                    key = tables[:k] + (tables[k] + 1,) + tables[k + 1 :]
                    new[key] = new.get(key, 0) + w * (tables[k] - d)
                key = tables + (1,)
                new[key] = new.get(key, 0) + w
            out = new
        return out

    weight = Counter()
    for tables, w in partitions(c).items():
        t = len(tables)
        weight[t] += w * h**t * math.prod(theta + d * (others + i) for i in range(t))
    total = sum(weight.values())
    for t, w in weight.items():
        assert got[t] / 40000 == pytest.approx(w / total, abs=0.01)
    big = pitman_yor.seat(np.array([1, 1000, 10**7]), np.zeros(3), np.full(3, -3.0), d, theta, rng)
    assert big[0] == 1 and (big >= 1).all() and (big < 50).all()  # each further table costs a factor near exp(-3)


def test_seating_of_many_customers_agrees_with_the_exact_way(monkeypatch):
    rng, d, theta = np.random.default_rng(1), 0.5, 1.0
    for c, h in (90, 0.02), (60, 0.3), (96, 0.9), (96, 1e-6):
        args = np.full(4000, c), np.full(4000, 4.0), np.full(4000, math.log(h)), d, theta
        exact = pitman_yor.seat(*args, rng)
        monkeypatch.setattr(pitman_yor, "EXACT", 8)
        pitman_yor._stirling.cache_clear()
        moved = pitman_yor.seat(*args, rng)
        monkeypatch.undo()
        pitman_yor._stirling.cache_clear()
        assert abs(moved.mean() - exact.mean()) < 0.04 * exact.mean() and abs(moved.std() - exact.std()) < 0.1 * exact.std() + 0.01
    # a customer's chance to sit alone is a ratio of Stirling numbers
    monkeypatch.setattr(pitman_yor, "EXACT", 400)
    for d in 0.3, 0.5, 0.8:
        pitman_yor._stirling.cache_clear()
        log_s = pitman_yor._stirling(d)
        for c in 100, 400:
            t = np.array([1, 2, 5, 20, 60, c])
            assert np.allclose(pitman_yor.leaves(np.full(6, c), t, d), np.exp(log_s[c - 1, t - 1] - log_s[c, t]), rtol=0.04, atol=1e-9)
    monkeypatch.undo()
    pitman_yor._stirling.cache_clear()


def test_pitman_yor_odd_rows(odd, empty):
    got = pitman_yor.op1(odd).collect()
    assert len(got) == len(ODD) and all(r.n_tokens >= 1 and r.score <= 0 for r in got)
    assert pitman_yor.op1(empty).count() == 0


# ---- 2 personal data


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    n = lambda m: len(re.sub(r"\D", "", m[0]))
    out = [(*m.span(), "email") for m in EMAIL.finditer(t)]
    out += [(*m.span(), "ip") for m in IP.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [(*m.span(), "card") for m in CARD.finditer(t) if 12 <= n(m) <= 19 and pii.luhn(re.sub(r"\D", "", m[0]))]
    out += [(*m.span(), "phone") for m in PHONE.finditer(t) if 9 <= n(m) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_are_the_rules():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    rng = random.Random(1)
    for _ in range(20000):
        t = "".join(rng.choice("0129.@+ -()ab_") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == plain_spans(t), t


SEED = [("phone", f"+1 ({200 + i}) 555-{1000 + i}") for i in range(40)] + [("card", c) for c in ("4111111111111111", "5500000000000004", "340000000000009")] + [("ip", f"10.2.{i}.7") for i in range(40)] + [("email", f"user{i}@mail.example.com") for i in range(40)]


def test_field_finds_respelled_data_and_leaves_look_alikes():
    w = pii.fit(SEED)
    found = lambda t: [(t[a:b], k) for a, b, k in pii.decode(t, pii.base_spans(t), w)]
    assert found("call (212) 555-0123 now") == [("(212) 555-0123", "phone")]
    assert found("write to ann [at] mail dot example dot com") == [("ann [at] mail dot example dot com", "email")]
    assert found("host 10[.]2[.]3[.]4 there") == [("10[.]2[.]3[.]4", "ip")]
    for clean in ("on 2024-01-31 at noon", "pi is 3.14159265", "years 2019 2020 2021", "look at the dot", "1,234,567"):
        assert found(clean) == []


def test_many_base_spans_lose_no_respelled_data():
    w = pii.fit(SEED)
    respelled = ["call (415) 555-0123 now", "host 10[.]2[.]3[.]4 there", "write to ann [at] mail dot example dot com, please", "on 2024-01-31 at noon"]
    parts = [p for i in range(100) for p in (f"see user{i}@mail.example.com or 10.2.{i}.7; ", respelled[i % 4] + "; ")]
    want, at = [], 0
    for p in parts:
        want += [(at + a, at + b, k) for a, b, k in pii.decode(p, pii.base_spans(p), w)]
        at += len(p)
    text = "".join(parts)
    assert len(want) == 75 and sorted(pii.decode(text, pii.base_spans(text), w)) == want
    rng = random.Random(6)
    for _ in range(2000):
        taken = [(a, a + rng.randint(1, 12), "ip") for a in (rng.randint(0, 300) for _ in range(rng.randint(0, 80)))]
        a = rng.randint(0, 300)
        b = a + rng.randint(1, 12)
        assert bool(pii._near(pii._disjoint(taken), (a, b))) == any(x < b and a < y for x, y, _ in taken)


def test_decode_takes_the_best_disjoint_segments():
    w = {("phone", "n=7"): 5.0, ("phone", "n=14"): 11.0, ("card", "n=14"): 30.0}
    t = "1234567 7654321"
    assert pii.decode(t, [], w, margin=0.0) == [(0, 15, "card")]
    assert pii.decode(t, [], {("phone", "n=7"): 5.0}, margin=0.0) == [(0, 7, "phone"), (8, 15, "phone")]


def test_decode_agrees_with_every_set_of_segments():
    rng = random.Random(3)
    w = pii.fit(SEED)
    for _ in range(300):
        t = " ".join(rng.choice(["415-555-1234", "[at]", "at", "host.com", "mail dot org", "ann", "(212) 555", "0123", "10[.]2[.]3[.]4", "2024-01-31", "4111 1111 1111 1111"]) for _ in range(rng.randint(1, 5)))
        taken = pii.base_spans(t)
        scored = [(a, b, pii._score(f, k, w) - pii.MARGIN) for a, b, f, ks in pii.segments(t, taken) for k in ks]
        scored = [s for s in scored if s[2] > 0]
        best = {0: 0.0}  # best score up to each position
        for x in range(1, len(t) + 1):
            best[x] = max([best[x - 1], *(best[a] + v for a, b, v in scored if b == x)])
        got = pii.decode(t, taken, w)
        value = sum(next(pii._score(f, k, w) for a, b, f, ks in pii.segments(t, taken) if (a, b) == (x, y) and k in ks) - pii.MARGIN for x, y, k in got)
        assert value == pytest.approx(best[len(t)]), t
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:])) and not any(a < y and x < b for a, b, _ in got for x, y, _ in taken)


def test_boundaries_and_kinds_are_chosen_jointly():
    w = pii.fit(SEED)
    found = lambda t: [(t[a:b], k) for a, b, k in pii.decode(t, pii.base_spans(t), w)]
    assert found("mail 415-555-1234 [at] host.com now") == [("415-555-1234 [at] host.com", "email")]  # not a phone besides
    assert found("write to ann dot lee at mail dot example dot com then") == [("ann dot lee at mail dot example dot com", "email")]
    assert found("write to ann [at] example.com then") == [("ann [at] example.com", "email")]
    assert len({(a, b) for a, b, f, k in pii.segments("ann dot lee at mail dot example dot com", [])}) == 4


def test_long_texts_are_decoded_in_little_memory():
    import tracemalloc

    w = pii.fit(SEED)
    text = "7 " * 100_000 + "call (212) 555-0123 now " + "a" * 500_000
    tracemalloc.start()
    got = pii.decode(text, pii.base_spans(text), w)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ("(212) 555-0123", "phone") in [(text[a:b], k) for a, b, k in got] and peak < 40 << 20


def test_pii_rows_and_redaction(spark):
    rows = [(1, "a@b.co and 1.2.3.4", "keep", 18), (2, None, "x", None), (3, "", None, 0), (4, "+1 (212) 555-0123" * 500, "y", 8500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, n_chars long")
    got = {r.doc_id: r for r in pii.op2(docs).collect()}
    assert (got[1].n_email, got[1].n_ip, got[1].spans) == (1, 1, "email:0:6,ip:11:18")
    assert got[2].base_sha256 == got[3].base_sha256 == hashlib.sha256(b"").hexdigest()
    for i, t, *_ in rows:
        assert got[i].base_sha256 == pii.digest(plain_spans(t or ""))
    out = {r.doc_id: r for r in pii.redact(docs, pii.learn(docs)).collect()}
    assert (out[1].text, out[1].n_chars, out[1].kind) == ("<EMAIL> and <IP>", 16, "keep") and out[2].text is None


# ---- 3 search


def plain_bm25(rows, queries, k=10):
    sets = [(i, Counter(words(t))) for i, t in rows]
    n, mean = len(sets), sum(sum(c.values()) for _, c in sets) / len(sets)
    df = Counter(w for _, c in sets for w in c)
    out = {}
    for q, t in queries:
        scored = []
        for i, c in sets:
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)) for w in set(words(t)) if c[w])
            if s > 0 and i is not None and i != q:
                scored.append((-round(s, 6), i))
        out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def test_search_is_exact_over_shards(spark, docs, corpus):
    index = bm25.build(docs, 3000)
    assert index.count() > 3
    queries = [(i, t) for i, t in corpus if i % 5 == 0] + [(7000, "absent"), (7001, None), (7002, "")]
    got = {}
    for r in bm25.search(index, spark.createDataFrame(queries, "query_id long, text string"), round_bytes=80_000).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    want = {q: v for q, v in plain_bm25(corpus, queries).items() if v}
    assert {q: [x[0] for x in v] for q, v in got.items()} == {q: [x[0] for x in v] for q, v in want.items()}


def test_search_reads_its_queries_once(spark, docs, corpus):
    """Every round used to read all queries, and the term lists of all shards, again."""
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def text(t):
        seen.add(1)
        return t

    index = bm25.build(docs, 3000)
    queries = spark.createDataFrame([(i, t) for i, t in corpus if i % 5 == 0], "query_id long, text string").coalesce(1)
    asked = queries.count()
    got = bm25.search(index, queries.select("query_id", F.udf(text, "string")("text").alias("text")), round_bytes=80_000)
    assert seen.value == asked
    one = bm25.search(index, queries, round_bytes=1 << 30)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, one.collect()))


def test_search_leaves_postings_unread():
    rng = random.Random(2)
    common, topics = np.arange(1, 40, dtype=np.uint64), np.arange(1000, 1200, dtype=np.uint64)
    docs = [np.array(rng.choices(common, k=60) + rng.choices(topics[20 * (i % 10) : 20 * (i % 10) + 20], k=20)) for i in range(640)]
    pairs = [(i, *x) for i, d in enumerate(docs) for x in Counter(d.tolist()).items()]
    row = bm25.indexed(np.array([x[1] for x in pairs], np.uint64), np.array([x[0] for x in pairs]), np.array([x[2] for x in pairs]), np.arange(640), np.ones(640, bool))
    assert (row["count"] > 0).all() and row["count"].sum() == len(row["doc"]) and row["cells"].sum() == len(row["block"])
    assert all(np.array_equal(bm25._unpacked(bm25._packed(row[k])), row[k]) for k in ("count", "tf", "least", "df"))
    every, df = row["terms"], row["df"].astype(np.int64)
    queries = [np.unique(docs[i]) for i in (3, 17, 200)]
    asked = bm25.Round(np.array([3, 17, 200]), queries, np.unique(np.concatenate(queries)), df[np.isin(every, np.concatenate(queries))], 640)
    best = bm25.Best(asked.ids, 5)
    reads = bm25.search_shard(row, 80.0, asked, best, False)
    for q, (number, terms) in enumerate(zip((3, 17, 200), queries)):
        plain = []
        for i, d in enumerate(docs):
            tf = Counter(d.tolist())
            plain.append((-round(sum(math.log(1 + (640 - df[j] + 0.5) / (df[j] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2) for w in terms.tolist() if tf[w] for j in [int(np.searchsorted(every, w))]), 6), i))
        assert [(-s, i) for s, i in sorted(x for x in plain if x[1] != number)[:5]] == list(zip(best.score[q].tolist(), best.doc[q].tolist()))
    assert reads["opened"] < reads["pairs"] / 2 and reads["read"] < reads["postings"] * 0.7


def test_search_odd_rows(odd, empty, spark):
    q = spark.createDataFrame([(1, "same text"), (905, "same text")], "query_id long, text string")
    got = [(r.query_id, r.doc_id) for r in bm25.search(bm25.build(odd), q).orderBy("query_id", "rank").collect()]
    assert got == [(1, 905), (1, 905), (1, 906), (905, 906)]
    assert bm25.search(bm25.build(empty), q).count() == 0


# ---- 4 extendible hashing


def test_shards_fit_and_are_shortest(spark, docs, corpus):
    got = {r.doc_id: r for r in extendible.sharded(docs, 2000).collect()}
    assert len(got) == len(corpus)
    bits = {i: bin(int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16))[2:].zfill(60) for i, _ in corpus}
    total = Counter()
    for i, t in corpus:
        for k in range(61):
            total[bits[i][:k]] += len(t)
    for i, _ in corpus:
        k = next(k for k in range(61) if total[bits[i][:k]] <= 2000)
        assert (got[i].shard, got[i].depth, got[i].shard_bytes) == (bits[i][:k], k, total[bits[i][:k]])


def test_shards_of_a_hot_key(spark):
    rows = [(1, "x" * 100)] * 50 + [(2, f"y{i}" * 30) for i in range(50)] + [(None, None), (3, ""), (4, "z" * 5000)]
    got = extendible.sharded(spark.createDataFrame(rows, KIND), 1000).toPandas()
    size = got.groupby("shard").text.apply(lambda t: sum(len(x or "") for x in t))
    assert len(got) == len(rows) and sorted(size)[-2] <= 1000 and size.max() == 5000
    assert dict(size) == dict(got.groupby("shard").shard_bytes.first())


def test_shards_of_nothing_and_clashing_columns(empty, spark):
    assert extendible.sharded(empty).count() == 0
    clash = spark.createDataFrame([(1, "a", "old", 9)], "doc_id long, text string, shard string, depth int")
    assert extendible.sharded(clash).columns == [*(f"{c}_input" if c in ("shard", "depth", "shard_bytes") else c for c in clash.columns), "shard", "depth", "shard_bytes"]


# ---- 5 language


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = langid.op5(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_odd_rows(spark, odd):
    train = spark.createDataFrame([("en", "the cat and the hat in the house"), ("fr", "le chat et la maison avec une porte"), (None, "the"), ("en", None)], "lang string, text string")
    model = langid.fit(train)
    rows = spark.createDataFrame([(1, "the house and the cat", "z"), (2, "123 !!", "z"), (3, None, "z"), (4, "", None), (5, "une maison et le chat", "z")], "doc_id long, text string, score string")
    said = langid.predict(rows, model).collect()
    assert {r.doc_id: r.score_input for r in said} == {1: "z", 2: "z", 3: "z", 4: None, 5: "z"}
    got = {r.doc_id: (r.lang_pred, r.score) for r in said}
    assert got[1][0] == "en" and got[5][0] == "fr" and {got[i] for i in (2, 3, 4)} == {("und", 0.0)}
    none = langid.fit(train.where("lang is null"))
    assert {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"}


def test_more_than_64_languages(spark):
    own = lambda i: " ".join([chr(0x4E00 + 40 * i + j) * 3 for j in range(30)])
    train = spark.createDataFrame([(f"l{i:03}", own(i)) for i in range(150)], "lang string, text string")
    model = langid.fit(train)
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame([(i, own(i)) for i in range(150)], KIND), model).collect()}
    assert all(got[i].lang_pred == f"l{i:03}" and got[i].score > 0.9 for i in range(150))


def test_votes_against_plain_filters(spark):
    """The filters written out: sets of slots per language, one n-gram and one probe at a time."""
    rng = random.Random(12)
    own = {"en": "the house and the cat sat on a mat", "fr": "le chat et la maison avec une porte", "de": "das haus und die katze auf dem dach"}
    rows = [(k, " ".join(rng.choice(t.split()) for _ in range(40))) for k, t in own.items() for _ in range(3)]
    train = spark.createDataFrame(rows, "lang string, text string")
    model = langid.fit(train)

    def grams(t):
        t = " " + re.sub(r"[^a-z]+", " ", t.lower()).strip() + " "
        return [t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)]

    count = {k: Counter(g for lang, t in rows if lang == k for g in grams(t)) for k in own}
    hashed = lambda g: langid._ngrams([g.strip()])

    def slots(g):
        h = np.full(1, len(g), np.uint64)
        for c in g:
            h = h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(ord(c)) * np.uint64(0xC2B2AE3D27D4EB4F)
        h = langid.mix(h)
        return [int(langid._probe(h, i, model["mask"].shape[1])[0]) for i in range(model["probes"])]

    filters = {k: {s for g in count[k] for s in slots(g)} for k in own}  # every n-gram of every language
    for i, k in enumerate(sorted(own)):
        assert set(np.flatnonzero(model["mask"][0] >> i & 1).tolist()) == filters[k]
    texts = ["the cat and le chat", "auf dem dach", "zzz", "a mat, a door; the house"]
    got = langid.predict(spark.createDataFrame(enumerate(texts), KIND), model).orderBy("doc_id").collect()
    for r, t in zip(got, texts):
        fill = {k: (len(filters[k]) / model["mask"].shape[1]) ** model["probes"] for k in own}
        score = {k: max(0.0, (sum(all(s in filters[k] for s in slots(g)) for g in grams(t)) / len(grams(t)) - fill[k]) / (1 - fill[k])) for k in own}
        assert abs(r.score - max(score.values())) < 1e-9 and score[r.lang_pred] == max(score.values())
    assert hashed("the")[2].all()


def test_filter_grows_with_the_corpus_and_stays_bounded():
    assert langid._slots(100, 3) == 1 << 11 and langid._slots(10**6, 3) == 1 << 24
    for members in 10, 1000, 300_000, 1 << 20:
        assert 1 - math.exp(-3 * members / langid._slots(members, 3)) <= langid.FILL


# ---- 6 mixing


def period(weights):
    """Per source, the slots of its blocks within one period: earliest deadline first, written out."""
    total, had = sum(weights), [0] * len(weights)
    slots = [[] for _ in weights]
    for slot in range(total):
        free = [s for s, w in enumerate(weights) if had[s] * total // w <= slot]
        s = min(free, key=lambda s: (-(-(had[s] + 1) * total // weights[s]), s))
        slots[s].append(slot)
        had[s] += 1
    return slots


def phases(blocks, weights):
    """(source, first block, end block, first slot, weight, period, slots) for every source and phase it is active in."""
    left, done, start, out = list(blocks), [0] * len(blocks), 0, []
    while active := [s for s, n in enumerate(left) if n > 0]:
        ws = [weights[s] for s in active]
        slots, total = period(ws), sum(ws)
        end = min((left[s] - 1) // w * total + slots[k][(left[s] - 1) % w] + 1 for k, (s, w) in enumerate(zip(active, ws)))
        for k, (s, w) in enumerate(zip(active, ws)):
            ran = end // total * w + sum(x < end % total for x in slots[k])
            out.append((s, done[s], done[s] + ran, start, w, total, slots[k]))
            done[s] += ran
            left[s] -= ran
        start += end
    return out


def test_period_stays_within_a_block():
    rng = random.Random(3)
    for _ in range(100):
        ws = [rng.randint(1, 40) for _ in range(rng.randint(1, 9))]
        for w, slots in zip(ws, period(ws)):
            done = 0
            for t in range(sum(ws)):
                done += done < len(slots) and slots[done] == t
                assert abs(done - (t + 1) * w / sum(ws)) < 1


def test_phases_use_every_block_once():
    rng = random.Random(4)
    for _ in range(100):
        n, ws = [rng.randint(0, 50) for _ in range(5)], [rng.randint(1, 20) for _ in range(5)]
        seen = [(s, start + (k - a) // w * total + slots[(k - a) % w]) for s, a, b, start, w, total, slots in phases(n, ws) for k in range(a, b)]
        assert sorted(x[1] for x in seen) == list(range(sum(n))) and [sum(s == x for x, _ in seen) for s in range(5)] == n


def within_a_block(slots, shares):
    source = np.full(sum(map(len, slots)), -1)
    for s, x in enumerate(slots):
        source[np.array(x)] = s
    end = min(x[-1] for x in slots if len(x)) + 1  # until the first source runs out
    for s, share in enumerate(shares):
        assert np.abs(np.cumsum(source[:end] == s) - np.arange(1, end + 1) * share).max() < 1
    return end


def test_schedule_stays_within_a_block_of_the_target_itself():
    n = [16 * 3000] * 19 + [16 * 28500]  # nineteen sources and one of 9.5 times their rows
    w = mixing.exact_weights(dict(enumerate(n)), None)
    assert within_a_block(mixing.schedule([x // 16 for x in n], [w[s] for s in range(20)]), np.sqrt(n) / np.sqrt(n).sum()) > 50000
    target = {0: 0.011, **{s: 0.0002 for s in range(1, 2001)}}  # small sources beside a larger one
    w = mixing.exact_weights(dict.fromkeys(target, 1), target)
    slots = mixing.schedule([110] + [2] * 2000, [w[s] for s in target])
    within_a_block(slots, [x / sum(target.values()) for x in target.values()])
    assert [list(x) for x in mixing.schedule([2, 3, 1], [0, 3, 1])][0] == [4, 5]
    rng = random.Random(9)
    for _ in range(50):
        n, ws = [rng.randint(0, 50) for _ in range(5)], [rng.randint(1, 20) for _ in range(5)]
        want = {(s, k): start + (k - a) // w * total + x[(k - a) % w] for s, a, b, start, w, total, x in phases(n, ws) for k in range(a, b)}
        assert {(s, k): x for s, xs in enumerate(mixing.schedule(n, ws)) for k, x in enumerate(xs)} == want


def test_mixed_slots_follow_the_schedule(spark, monkeypatch):
    n = {"a": 700, "b": 90, None: 33}
    docs = spark.createDataFrame([(i, s) for s, m in n.items() for i in range(m)], "doc_id long, source string").repartition(5)
    names = [None, "a", "b"]
    w = mixing.exact_weights(n, None)
    want = mixing.schedule([-(-n[s] // 4) for s in names], [w[s] for s in names])
    for chunk, rows in (1024, 2048), (7, 3):
        monkeypatch.setattr(mixing, "CHUNK_BLOCKS", chunk)
        monkeypatch.setattr(mixing, "BUCKET_ROWS", rows)
        monkeypatch.setattr(mixing, "GROUP_BUCKETS", chunk)
        got = {(r.source, r.block, r.slot) for r in mixing.mixed(docs, None, 4).collect()}
        assert got == {(s, k, x) for s, xs in zip(names, want) for k, x in enumerate(xs)}


def test_mixture_keeps_rows(spark):
    rows = [(i, f"s{i % 3}" if i % 7 else None, "t") for i in range(300)] + [(5, "s0", "t")] * 40 + [(None, "s1", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, slot string").repartition(5)
    got = mixing.mixed(docs, {"s0": 3, "s1": 1, None: 1}, 8).toPandas()
    assert sorted(got.slot_input.astype(str)) == sorted(str(r[2]) for r in rows)
    assert len(got) == len(rows) and got.position.is_unique
    assert (got.groupby("slot").source.nunique(dropna=False) == 1).all() and (got.groupby("slot").size() <= 8).all()
    odd = docs.selectExpr("*", "doc_id as position", "doc_id as _rank", "doc_id as before", "'x' as block", "map(1, 2) as m")
    back = mixing.in_order(odd, None, 8)
    assert back.columns == odd.columns and sorted(map(str, back.drop("m").collect())) == sorted(map(str, odd.drop("m").collect()))
    assert mixing.mixed(docs.limit(0)).count() == 0


# ---- 7 repeated passages


def plain_kept(rows):
    best, out = {}, {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - 49):
            best[b[k : k + 50]] = min(best.get(b[k : k + 50], 1 << 60), i)
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if best[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        out[i] = (len(b), sum(gone), sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1])), hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest())
    return out


def passages():
    rng = random.Random(1)
    base = ["".join(rng.choice("ab é") for _ in range(400)) for _ in range(3)] + ["a" * 300, "ab" * 150]
    rows = [(i, rng.choice(["", "zz" * rng.randint(0, 30)]) + rng.choice(base)[(a := rng.randint(0, 200)) : a + rng.randint(20, 180)] + rng.choice(base)[: rng.randint(0, 120)]) for i in range(120)]
    return rows + [(200, None), (201, ""), (202, "short"), (203, "x" * 49), (204, "x" * 50), (205, "x" * 50)]


@pytest.mark.parametrize("hot", [64, 1, 0])
def test_removed_bytes_are_exact(spark, monkeypatch, hot):
    monkeypatch.setattr(bwt_dedup, "HOT_BLOCKS", hot)
    rows = passages()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in bwt_dedup.covered(spark.createDataFrame(rows, KIND).repartition(4), 4000).collect()}
    assert got == plain_kept(rows)


def test_anchors_meet_in_fewer_buckets_than_blocks(spark, monkeypatch):
    """Rows between blocks and buckets, both as many as the corpus has, grow with its square."""
    rng, sizes, written = random.Random(5), {}, bwt_dedup.written
    common = ["".join(rng.choices("abcdefgh ", k=90)) for _ in range(12)]
    rows = [(i, " ".join([rng.choice(common), "".join(rng.choices("klmnop ", k=300)), rng.choice(common)])) for i in range(60)]

    def held(df, name="t", by=None):
        out = written(df, name, by)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(bwt_dedup, "written", held)
    got = {r.doc_id: r.n_removed for r in bwt_dedup.covered(spark.createDataFrame(rows, KIND), 1000).collect()}
    blocks = -(-sum(len(t) + 16 for _, t in rows) // 1000)
    assert blocks > 20 and sizes["shared"] <= blocks * (blocks // 4 + 1)
    for i, t in rows:
        before = {u[a : a + 50] for j, u in rows if j < i for a in range(len(u) - 49)}
        gone = {a + k for a in range(len(t) - 49) if t[a : a + 50] in before for k in range(50)}
        assert got[i] == len(gone)


def test_merged_transforms_order_and_group_suffixes():
    rng = random.Random(5)
    for _ in range(40):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(50, 140))) if rng.random() < 0.5 else (b"ab" * 90)[rng.randint(0, 3) : rng.randint(53, 170)] for _ in range(rng.randint(1, 25))]
        strings += [strings[0]] * rng.randint(0, 2)
        off = np.concatenate([[0], np.cumsum([len(x) + 8 for x in strings])])
        text = np.frombuffer(b"".join(x + b"\xff" * 8 for x in strings), np.uint8)
        shard = np.sort([rng.randrange(4) for _ in strings])
        shard = np.cumsum(np.concatenate([[0], np.diff(shard) > 0]))
        where, block = bwt_dedup.repeated(text, off, shard)
        number = np.repeat(np.arange(len(strings)), np.diff(off))
        keys = [(text[p : off[number[p] + 1]].tobytes() + b"\xff" * 60)[:50] for p in where]
        assert sorted(where) == list(range(len(text))) and keys == sorted(keys)
        assert all((block[i] == block[i - 1]) == (keys[i] == keys[i - 1]) for i in range(1, len(keys)) if 255 not in keys[i] and 255 not in keys[i - 1])


def test_repeats_odd_rows(odd, empty):
    got = bwt_dedup.op7(odd).collect()
    assert len(got) == len(ODD) and sum(r.n_removed for r in got) == 0
    assert bwt_dedup.op7(empty).count() == 0


# ---- 8 fingerprints


def test_equal_substrings_share_interior_phrases():
    rng = random.Random(6)
    shared = "".join(rng.choice("abcdefgh ") for _ in range(600))
    a, b = ("".join(rng.choice("abcdefgh ") for _ in range(n)) + shared for n in (37, 91))

    def names(t):
        x, off = np.frombuffer(t.encode("utf-32-le"), np.uint32), np.array([0, len(t)])
        for _ in range(2):
            x, off = parsing.phrases(x, off)
        return set(x.tolist())

    inside = names(shared)
    assert len(inside & names(a) & names(b)) > 0.9 * len(inside)


def test_phrases_do_not_look_across_texts():
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab aaa") for _ in range(rng.randint(0, 80))) for _ in range(50)]
    together = parsing.sketches(texts)
    for t, s in zip(texts, together):
        assert s.tolist() == parsing.sketches([t])[0].tolist()


def test_edited_texts(spark):
    rng = random.Random(8)
    rows = [(i * 3, prose(rng, rng.randint(0, 90))) for i in range(60)] + [(None, None), (None, "abc"), (7, "other"), (3, ""), (10**15, "x" * 100), (9, "tie"), (9, "tie")]
    docs = spark.createDataFrame(rows, KIND).repartition(4)
    hashes = {(r[0], r[1]): r[2] for r in docs.selectExpr("doc_id", "coalesce(text, '')", "xxhash64(coalesce(text, ''), octet_length(coalesce(text, '')))").collect()}
    order = sorted({(i, t or "") for i, t in rows}, key=lambda x: (x[0] is not None, x[0] or 0, hashes[x]))
    times, want = Counter((i, t or "") for i, t in rows), Counter()
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        a, b, c = parsing.sketches([t, edited, after])
        want[(i, len(t), hashlib.sha256(edited.encode()).hexdigest(), parsing._hex(a), parsing._hex(b), round(parsing.likeness(a, b), 9), round(parsing.likeness(a, c), 9))] += times[(i, t)]
    got = Counter((r[0], r[1], r[2], r[3], r[4], round(r[5], 9), round(r[6], 9)) for r in parsing.op8(docs).collect())
    assert got == want


def test_fingerprints_of_nothing(empty, odd):
    assert parsing.op8(empty).count() == 0
    got = {r.doc_id: r.fingerprint for r in parsing.fingerprints(odd).collect()}
    assert got[905] == got[906] != "" and got[901] == got[900] == ""


# ---- 9 similarity join


def plain_components(rows, n, num, den):
    sets = [(i, {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w := words(t)) >= n else ({tuple(w)} if w else set())) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j, (i, a) in enumerate(sets):
        for k, b in sets[:j]:
            if a and b and den * len(a & b) >= num * len(a | b):
                x, y = sorted((find(i), find(k)))
                root[y] = x
    return {i: (len(a), find(i)) for i, a in sets}


@pytest.mark.parametrize("n, num, chunk", [(3, 90, 1024), (5, 80, 1024), (3, 60, 3)])
def test_components_are_exact(docs, corpus, n, num, chunk):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(docs, n, num, 100, chunk).collect()}
    assert got == plain_components(corpus, n, num, 100)


def test_links_at_the_threshold(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-4])), (3, " ".join(base[:-5])), (4, "A b"), (5, "a B"), (6, "a")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.op9(spark.createDataFrame(rows, KIND)).collect()}
    assert got == plain_components(rows, 3, 90, 100) and got[5] == (1, 4) and got[6] == (1, 6)


def test_large_apart_groups_are_not_paired_out(spark, monkeypatch):
    """Sets that share routes but no link: rows that are searched follow the sets, not their square (they were broadcast, too)."""
    word = lambda i: f"w{i % 1800}"
    rows = [(i, " ".join(word(20 * i + j) for j in range(40))) for i in range(90)]
    rows += [(200 + i, " ".join(word(20 * i + j) for j in range(1, 43))) for i in range(0, 90, 9)] + [(300, rows[5][1]), (5, rows[50][1] + " a b")]
    rows, asked, search = sorted(rows), [], jaccard_join._searched
    monkeypatch.setattr(jaccard_join, "_searched", lambda found, *rest: (asked.append(found.count()), search(found, *rest))[1])
    docs = spark.createDataFrame(rows, KIND)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs, 1, 60, 100, 4).collect()}
    sets = [(i, set(t.split())) for i, t in rows]
    root = {i: i for i, _ in sets}
    for i, a in sets:
        for j, b in sets:
            if 100 * len(a & b) >= 60 * len(a | b) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    assert got == root and len(set(got.values())) == 89
    assert max(asked) >= 90 and sum(asked) <= 3 * len(rows)


def test_search_skips_nothing():
    rng = np.random.default_rng(9)
    for num in (60, 80, 90):
        base = rng.integers(0, 10**6, 60)
        sets = [np.unique(np.where(rng.random(60) < 0.08, rng.integers(0, 10**6, 60), base))[rng.integers(0, 8) :].astype(np.uint64) for _ in range(40)]
        off = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        got = jaccard_join.search(np.concatenate(sets), off, np.arange(40), num, 100)
        root = list(range(40))
        for i in range(40):
            for j in range(i):
                o = len(np.intersect1d(sets[i], sets[j]))
                if 100 * o >= num * (len(sets[i]) + len(sets[j]) - o):
                    root = [root[j] if r == root[i] else r for r in root]
        assert len(set(zip(got.tolist(), root))) == len(set(got.tolist())) == len(set(root))


def test_join_odd_rows(odd, empty):
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.op9(odd).collect()]
    assert len(got) == len(ODD)
    assert {x for x in got if x[0] in (905, 906)} == {(905, 1, 905), (906, 1, 905)}
    assert all(x[2] == x[0] for x in got if x[0] not in (905, 906))
    assert jaccard_join.op9(empty).count() == 0
    kept = jaccard_join.one_of_each(odd).collect()
    assert Counter(r.doc_id for r in kept) == Counter({None: 2, 900: 1, 901: 1, 902: 1, 903: 1, 904: 1, 905: 1})


# ---- 10 pieces


@pytest.fixture(scope="module")
def lattice():
    return sentencepieces.Lattice(*sentencepieces.vocabulary())


TEXTS = ["", "a b\nc  d▁e", "Hello world, ñandú 漢字 🙂\t!", "\n\n", " ", "  x", "▁▁", "x" * 5000, "the the and 漢漢", "\x00z", "tail "]


def test_round_trip(lattice):
    ids, off = lattice.encode(TEXTS, np.arange(len(TEXTS)).astype(np.uint64))
    assert lattice.decode(ids, off) == TEXTS
    again = lattice.encode(TEXTS[::-1], np.arange(len(TEXTS))[::-1].astype(np.uint64))
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [again[0][a:b].tolist() for a, b in zip(again[1], again[1][1:])][::-1]


def test_samples_follow_the_lattice(lattice):
    names, kinds = sentencepieces.vocabulary()
    rank = {names[i]: r for r, i in enumerate(i for i, k in enumerate(kinds) if k == 0)}
    total = sum(1 / (r + 2) for r in rank.values())
    paths = Counter()

    def walk(rest, path, w):
        if not rest:
            paths[path] = w
        for e in range(1, len(rest) + 1):
            if rest[:e] in rank:
                walk(rest[e:], (*path, rest[:e]), w / (rank[rest[:e]] + 2) / total)

    walk("▁thereon", (), 1.0)
    n = 20000
    ids, off = lattice.encode(["thereon"] * n, np.arange(n).astype(np.uint64))
    got = Counter(tuple(names[i] for i in ids[a:b]) for a, b in zip(off, off[1:]))
    z = sum(paths.values())
    assert set(got) <= set(paths) and all(abs(got[p] / n - w / z) < 0.015 for p, w in paths.items())


def test_pieces_rows(spark, odd, empty):
    got = sentencepieces.op10(odd).collect()
    assert len(got) == len(ODD) and all(r.lossless for r in got)
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate([*TEXTS, None])], "doc_id long, text string, ids string")
    back = sentencepieces.decoded(sentencepieces.encoded(docs))
    assert {r.doc_id: r.text for r in back.collect()} == dict(enumerate([*TEXTS, None]))
    assert sentencepieces.op10(empty).count() == 0


def test_long_chunks_are_sampled_alike_by_windows(monkeypatch):
    lattice = sentencepieces.Lattice(*sentencepieces.vocabulary())
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgh01AB漢é▁") for _ in range(40_000)), "short one\n two", "", "aa bb " * 3000]
    keys = np.array([5, 6, 7, 8], np.uint64)
    ids, off = lattice.encode(texts, keys)
    assert lattice.decode(ids, off) == texts
    monkeypatch.setattr(sentencepieces, "PART_POSITIONS", 1 << 17)
    whole = lattice.encode(texts, keys)
    assert np.array_equal(ids, whole[0]) and np.array_equal(off, whole[1])
    monkeypatch.setattr(sentencepieces, "STRETCH", 1000)
    assert np.array_equal(ids, lattice.encode(texts, keys)[0])


def test_a_very_long_text_without_blanks_keeps_within_memory(spark):
    text = "".join(random.Random(4).choice("abcdefgh01AB") for _ in range(1000)) * 2000
    got = sentencepieces.op10(spark.createDataFrame([(1, text)], KIND)).collect()[0]
    assert got.lossless and got.n_pieces > 100_000


# ---- all of them


def test_long_spans_hash_as_short_ones(monkeypatch):
    from harborline.llm import common

    rng = np.random.default_rng(8)
    raw = rng.choice(np.frombuffer(b"abc  ", np.uint8), 5000)
    raw[1000:1900] = 97
    start, end, _ = common.tokens(raw, np.array([0, 5000]))
    want = common.span_hashes(raw, start, end)
    for size in 64, 300, 1000:
        monkeypatch.setattr(common, "SPAN_BYTES", size)
        assert np.array_equal(common.span_hashes(raw, start, end), want)


def test_windows_of_long_texts_are_those_of_short_pieces():
    rng = random.Random(9)
    raw = np.frombuffer(("".join(rng.choice("ab ") for _ in range(3000)) + "z" * 9000 + "ab" * 2000).encode(), np.uint8)
    off = np.array([0, 10, 400, 8000, len(raw)])

    def every(piece):
        start, count, anchor, text = bwt_dedup.windows(raw, off, piece)
        at = np.repeat(start, count) + np.concatenate([np.arange(n) for n in count])
        order = np.argsort(at)
        return at[order], np.repeat(anchor, count)[order], np.repeat(text, count)[order]

    want = every(1 << 20)
    assert len(want[0]) == sum(max(0, int(n) - 49) for n in np.diff(off)) and len(np.unique(want[0])) == len(want[0])
    for piece in 200, 1000:
        assert all(np.array_equal(a, b) for a, b in zip(every(piece), want))


QUERY = {1: pitman_yor.op1, 2: pii.op2, 3: bm25.op3, 4: extendible.op4, 5: langid.op5, 6: mixing.op6, 7: bwt_dedup.op7, 8: parsing.op8, 9: jaccard_join.op9, 10: sentencepieces.op10}


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, blanks, ties, repeated rows, unbroken and repeating texts of a million characters, and columns with names in use inside."""
    rng = random.Random(10)
    rows = [*ODD, (100, "".join(rng.choice("abcdefgh01") for _ in range(1_000_000))), (200, "ab" * 500_000), (201, "ab" * 500_000), (300, "7 " * 300_000)]
    docs = spark.createDataFrame([(i, t, "en" if k % 2 else None, f"s{k % 3}" if k % 4 else None) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    names = "block bucket shard depth slot position score lang_pred ids h size n key entry rank query_id fingerprint held_out base added node label".split()
    return docs.selectExpr("*", *[f"doc_id as {n}" for n in names], *[f"source as _{n}" for n in names]).repartition(4).cache()


@pytest.mark.parametrize("number", sorted(QUERY))
def test_awkward_tables(awkward, number):
    got = QUERY[number](awkward).toPandas()
    if number == 3:
        assert set(got.query_id) <= {100, 200, 300, 900} and (got[got.query_id == 200].doc_id == 201).any()
    else:
        assert len(got) == awkward.count()
    if number == 7:
        assert got[got.doc_id == 201].n_removed.iloc[0] == 1_000_000 and got.n_removed.sum() == 1_000_000
    if number == 9:
        assert got[got.doc_id == 201].component_id.iloc[0] == 200
    if number == 10:
        assert got.lossless.all()
    assert QUERY[number](awkward.limit(0)).count() == 0
