"""Operators 11 to 13 against plain Python and SQL, and shards of a hot key whose rows differ, with awkward tables for each."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from harborline.llm import chat, extendible, hard_negatives, infilling

KIND = "doc_id long, text string"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def same(got: pd.DataFrame, want: pd.DataFrame):
    assert sorted(got.columns) == sorted(want.columns)
    clean = lambda f: (tuple(None if pd.isna(x) else float(x) if isinstance(x, (int, float, np.number)) and not isinstance(x, bool) else x for x in r) for r in f[sorted(f.columns)].itertuples(index=False))
    key = lambda r: str(r)
    assert sorted(clean(got), key=key) == sorted(clean(want), key=key)


def in_sql(sql, **tables):
    c = duckdb.connect()
    for name, frame in tables.items():
        c.register(name, frame)
    return c.sql(sql).df()


# ---- 11 fill-in-middle


def plain_infill(doc_id, text):
    t = text or ""
    units = UNIT.findall(t)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc_id, n, "plain", None, None, sha(t), sha(t)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    out = f"<S>{suf}<P>{pre}<M>{mid}" if form == "spm" else f"<P>{pre}<S>{suf}<M>{mid}"
    return doc_id, n, form, len(pre), len(mid), sha(out), sha(t)


def odd_texts():
    rng = random.Random(11)
    yield from [(None, None), (None, "no id here at all"), (1, None), (2, ""), (3, " "), (4, " \t\r\n "), (5, "x"), (6, "  x  "), (7, "a<P>b"), (8, "<"), (9, "a\x0bb\x0cc\x1cd\x85e\xa0f")]
    yield from [(10, "same words"), (10, "same words"), (11, "<S"), (12, "P> <M"), (13, "é漢 🙂\n" * 50)]
    for i in range(100, 400):
        yield i, "".join(rng.choice([" ", "\n", "\t", "a", "b", "é", "🙂", "<", "P", ">", "<M"]) for _ in range(rng.randint(0, 60)))


def test_infill_equals_plain_python(spark):
    rows = list(odd_texts())
    got = [tuple(r) for r in infilling.op11(spark.createDataFrame(rows, KIND).repartition(3)).collect()]
    want = [plain_infill(*r) for r in rows]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_infill_looks_ranks_up_in_a_sparse_directory(monkeypatch):
    monkeypatch.setattr(infilling, "STEP", 7)
    rng = random.Random(12)
    for _ in range(60):
        t = "".join(rng.choice("  \nabc") for _ in range(rng.randint(0, 200)))
        u, units = infilling.Units(t), UNIT.findall(t)
        assert u.n == len(units) and not u.sentinel
        assert [u.end(i) for i in range(u.n + 1)] == [len("".join(units[:i])) for i in range(u.n + 1)]


def test_infill_of_a_very_long_text(spark):
    long = "word and <tag> more\n" * 500_000
    rows = [(i, long) for i in (20, 21, 22, 23)]
    got = infilling.transformed(spark.createDataFrame(rows, KIND))
    out = got.select("doc_id", "n", "form", "output", infilling.restored(got["output"], got["form"]).alias("back")).collect()
    assert all(r.back == long and r.n == 2_000_001 for r in out) and any(r.form != "plain" for r in out)


def test_infill_keeps_columns_and_empty_tables(spark):
    clash = spark.createDataFrame([(1, "some text here", "mine", 5)], "doc_id long, text string, form string, N int")
    assert infilling.transformed(clash).columns == ["doc_id", "text", "form_input", "N_input", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert infilling.op11(spark.createDataFrame([], KIND)).count() == 0


# ---- 12 hard negatives


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def frame(rows):
    return pd.DataFrame({"vec_id": pd.array([r[0] for r in rows], "Int64"), "embedding": [None if r[1] is None else [None if x is None else float(np.float32(x)) for x in r[1]] for r in rows], "label": pd.array([r[2] for r in rows], "Int32")})


def test_negatives_equal_sql(spark, monkeypatch):
    for name, value in (("SLOT_ROWS", 40), ("BLOCK_ROWS", 16), ("PACK_ROWS", 3), ("TILE_ROWS", 2)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(12)
    middle = rng.normal(size=(9, 6))
    rows = [(i, (middle[i % 9] + 0.3 * rng.normal(size=6)).tolist(), int(rng.integers(0, 10))) for i in range(900)]
    rows += [(900 + i, rows[i % 2][1], i % 3) for i in range(200)]  # a hot list, and ties
    rows += [(2000, None, 1), (2001, [1.0] * 6, None), (None, [1.0] * 6, 1), (2100, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (2200, [float("nan")] + [1.0] * 5, 1), (2300, [float("inf")] + [1.0] * 5, 1), (-300, [0.0] * 6, 3)]
    got = hard_negatives.op12(vectors(spark, rows).repartition(5)).toPandas()
    want = in_sql(hard_negatives.OP12_SQL, embeddings=frame(rows))
    same(got, want)
    assert len(got) > 100


def test_negatives_of_odd_tables(spark):
    assert hard_negatives.op12(vectors(spark, [])).count() == 0
    assert hard_negatives.op12(vectors(spark, [(1, [1.0], 0)])).count() == 0  # no anchor
    assert hard_negatives.op12(vectors(spark, [(100, [1.0], 0), (200, [], 1)])).count() == 0  # nobody to meet
    # large and ragged vectors: sums of 64 bits, missing components count as 0
    rows = spark.createDataFrame([(0, 1, [3_000_000_019, 5]), (1, 1, [1_000_000_007]), (2, 2, [900_000_011, 1]), (3, 2, [900_000_011, 0, 7]), (3, 2, [900_000_011, 0, 7])], "id long, label long, vector array<long>")
    got = sorted(tuple(r) for r in hard_negatives.hard_negatives(rows, rows["id"] == 0).collect())
    p = 3_000_000_019 * 1_000_000_007
    n = 3_000_000_019 * 900_000_011
    assert got == [(0, 1, 1, 2, p, n + 5), (0, 1, 2, 3, p, n), (0, 1, 3, 3, p, n)]


# ---- 13 chat


TURNS = "conv_id long, turn long, role string, text string"


def test_chat_equals_sql_and_plain_python(spark):
    rng = random.Random(13)
    bits = ["</turn>", "<turn:", "<part:image:a:3>", "\\", "\\<", "<", ">", ":", "é🙂", "\n", "### Assistant: ", "word ", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd<role>:\\", None]), rng.choice([None, "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))])) for c in range(40) for t in range(rng.randint(1, 6))]
    rows += [(7, 2, "user", "again"), (7, 2, "user", "again"), (None, 1, "assistant", "nobody's"), (8, None, "assistant", "no turn"), (-7, 5, "assistant", "was here before")]
    got = chat.op13(spark.createDataFrame(rows, TURNS).repartition(4)).toPandas()
    table = pd.DataFrame({"conv_id": pd.array([r[0] for r in rows], "Int64"), "turn": pd.array([r[1] for r in rows], "Int64"), "role": [r[2] for r in rows], "text": [r[3] for r in rows]})
    same(got, in_sql(chat.OP13_SQL, conversations=table))
    said = "\\### Assistant: </turn> ok"
    own = chat.op13(spark.createDataFrame([], TURNS)).first()
    assert (own.conv_id, own.n_turns, own.turns_sha256, own.loss_chars, own.loss_sha256) == (-7, 2, sha(f"user\n{said}\nassistant\n{said}\n"), len(said), sha(said))


def test_parts_become_placeholders_in_order(spark):
    part = lambda kind, **v: {"type": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | v
    parts = [part("text", text="a<tu"), part("text", text="rn:x>"), part("image", ref="i:1>.png", width=28, height=15), None, part("audio", ref="s", seconds=1.5), part("document", ref="d", pages=2), part("video", ref="v"), part("text", text="\\end"), part("image", ref=None, width=-3)]
    df = spark.createDataFrame([(1, "assistant", parts), (1, "user", None), (1, None, [])], f"c long, role string, parts array<{chat.PART}>")
    first, second, third = chat.formatted(df).collect()
    told = [[("text", "a<turn:x>", 0)], ("image", "i:1>.png", 4), ("audio", "s", 38), ("document", "d", 512), ("video", "v", 0), ("text", "\\end", 0), ("image", "", 0)]
    ((role, back),) = chat.parsed(first.formatted)
    assert role == "assistant" and back == [*told[0], *told[1:]]
    assert [tuple(a) for a in first.attachments] == [("image", "i:1>.png", 4), ("audio", "s", 38), ("document", "d", 512), ("video", "v", 0), ("image", None, 0)] and first.attachment_tokens == 554
    assert [chat.unescaped(first.formatted[s.start : s.start + s.length]) for s in first.loss] == ["a<tu", "rn:x>", "\\end"]
    assert (second.formatted, second.loss, third.formatted) == ("<turn:user></turn>\n", [], "<turn:></turn>\n")
    with pytest.raises(ValueError):
        list(chat.parsed("<turn:user>unfinished"))


def test_chat_keeps_columns_and_very_long_texts(spark):
    long = "</turn> \\ <part: " * 200_000
    df = spark.createDataFrame([(1, 0, "assistant", long, "x")], f"{TURNS}, loss string").withColumn("parts", chat.as_parts(__import__("pyspark").sql.functions.col("text")))
    row = chat.formatted(df).first()
    assert row.loss_input == "x"
    ((role, ((kind, text, _),)),) = chat.parsed(row.formatted)
    assert (role, kind, text == long) == ("assistant", "text", True)


# ---- 4 rows of a hot key


def test_rows_of_a_hot_key_come_back_as_they_were(spark):
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    rows = [(1, "t" * (i % 7), start + dt.timedelta(microseconds=i), None if i % 3 else i, bytes([i % 256]), {"a": i % 2} if i % 5 else None, float("nan") if i % 11 == 0 else -0.0) for i in range(400)]
    rows += [(1, "alike", start, 5, b"x", {"b": 1}, 1.0)] * 300 + [(1, "L" * 900, start, None, None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, at timestamp, n int, raw binary, m map<string,int>, f double")
    got = extendible.sharded(df.repartition(4), 500)
    told = lambda r: str((r.doc_id, r.text, r.at, r.n, bytes(r.raw) if r.raw is not None else None, r.m, r.f))
    back = got.collect()
    assert sorted(map(told, back)) == sorted(map(told, df.collect()))
    held, said = {}, {}
    for r in back:
        held.setdefault(r.shard, []).append(len(r.text))
        said[r.shard] = r.shard_bytes
    assert {s: sum(v) for s, v in held.items()} == said
    assert all(sum(v) <= 500 or len(v) == 1 for v in held.values())


# ---- 2 and 5: nothing is cut


def test_spelled_out_names_are_whole():
    from harborline.llm import pii

    weights = {("email", "spelled"): 5.0}
    for name in ("a" * 80, "b" * 200, "first.last_" * 30, "x" + "y" * 40 + " dot " + "z" * 70):
        t = f"write to {name} [at] example.com now"
        assert pii.decode(t, pii.base_spans(t), weights) == [(9, 9 + len(name) + len(" [at] example.com"), "email")]
    for t in ("x [at] " + "h" * 70 + ".com", "x [at] example." + "t" * 70):
        assert pii.decode(t, pii.base_spans(t), weights) == []  # no host has such a label


def test_slices_of_a_long_text_have_its_ngrams(spark, monkeypatch):
    from harborline.llm import langid

    rng = random.Random(5)
    texts = ["".join(rng.choice("abc é漢  ..\nÀΣ1") for _ in range(rng.randint(51, 400))) for _ in range(60)]
    alone = [np.sort(langid._ngrams([t])[0]) for t in texts]
    grams, who, has = langid._ngrams(texts)
    for i, want in enumerate(alone):  # the same in any company
        assert np.array_equal(np.sort(grams[who == i]), want)
    monkeypatch.setattr(langid, "SLICE", 50)
    for t, want in zip(texts, alone):
        assert np.array_equal(np.sort(np.concatenate([g for g, _, _ in langid._long(t)])), want)
    rows = [(i, t, "x" if "é" in t[:20] else "y") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    count = lambda: sorted(map(tuple, langid.ngram_counts(df).collect()))
    cut = count()
    total = {}
    for (_, _, lang), g in zip(rows, alone):
        for x in g.view(np.int64).tolist():
            total[lang, x] = total.get((lang, x), 0) + 1
    assert cut == sorted((lang, x, n) for (lang, x), n in total.items())


# ---- 6 one key on many rows


def test_a_hot_key_is_many_buckets(spark, monkeypatch):
    from pyspark.sql import functions as F

    from harborline.llm import mixing

    monkeypatch.setattr(mixing, "BUCKET_ROWS", 50)
    rows = [(None, f"text {i}", "a") for i in range(1000)] + [(i, f"t{i}", "b") for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mixed(df)
    assert out.count() == 1500 and out.select("position").distinct().count() == 1500 and sorted(r.text for r in out.collect()) == sorted(t for _, t, _ in rows)
    order = F.xxhash64("text", "source", F.lit(1))
    spread = df.where("doc_id is null").groupBy(F.pmod(F.xxhash64("doc_id", order), F.lit(30))).count()
    assert spread.agg(F.max("count")).first()[0] < 100  # none near the whole thousand
