"""Fill-in-middle: texts cut at two unit ends and put together again around sentinels.

A unit is a word with the white space before it, or the white space that ends a text. One Aho-Corasick automaton reports the
events of a text: characters of ASCII white space, which change the class of what stands around them, and whole sentinels. What
lies between two events is one word or nothing, so units are counted from the distances of events and no other character is
looked at. Ranks are looked up in a sparse directory: the units and the position reached after every ``STEP`` events; one
stretch of events is read again for each cut.
"""

from __future__ import annotations

from functools import cache
from itertools import chain, islice

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, free

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SPACE = " \t\n\x0b\x0c\r"
#: Production parameters: seed, percentage of texts that are transformed, percentage of those whose suffix comes first.
SEED, RATE, SUFFIX_FIRST = 42, 50, 80
#: Events between two entries of a text's directory.
STEP = 1 << 15


@cache
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for c in SPACE:
        a.add_word(c, 0)
    for s in (PREFIX, SUFFIX, MIDDLE):
        a.add_word(s, 1)
    a.make_automaton()
    return a


def _events(text: str, start: int):
    """(positions, kinds) of the events from ``start`` on, STEP of them at a time."""
    found = _automaton().iter(text, start)
    while len(got := np.fromiter(chain.from_iterable(islice(found, STEP)), np.int64)):
        yield got[::2], got[1::2]


class Units:
    """The units of one text: how many there are, where each ends, and whether the text contains a sentinel."""

    def __init__(self, text: str):
        self.text, self.sentinel = text, False
        last, self.words, self.directory = -1, 0, [(0, 0)]
        for at, kind in _events(text, 0):
            self.sentinel |= bool(kind.any())
            space = at[kind == 0]
            if len(space):
                self.words += int(np.count_nonzero(np.diff(space, prepend=last) > 1))
                last = int(space[-1])
                self.directory.append((self.words, last + 1))
        self.words += last + 1 < len(text)
        self.n = self.words + (last >= 0 and last + 1 == len(text))

    def end(self, unit: int) -> int:
        """Characters up to the end of the unit-th unit (from 1; 0: none)."""
        if unit == 0:
            return 0
        if unit == self.n:
            return len(self.text)
        i = max(0, int(np.searchsorted([d[0] for d in self.directory], unit)) - 1)  # the last entry with fewer words
        words, start = self.directory[i]
        last = start - 1
        for at, kind in _events(self.text, start):
            space = at[kind == 0]
            ends = space[np.diff(space, prepend=last) > 1]
            if words + len(ends) >= unit:
                return int(ends[unit - words - 1])
            words += len(ends)
            last = int(space[-1]) if len(space) else last
        raise ValueError("no such unit")


def _cuts() -> Column:
    @F.pandas_udf("n long, sentinel boolean, first long, second long")
    def cuts(text: pd.Series, h1: pd.Series, h2: pd.Series, wanted: pd.Series) -> pd.DataFrame:
        rows = []
        for t, a, b, w in zip(text, h1, h2, wanted):
            u = Units(t)
            ends = [u.end(x) for x in sorted((a % (u.n + 1), b % (u.n + 1)))] if w and t and not u.sentinel else [None, None]
            rows.append((u.n, u.sentinel, *ends))
        return pd.DataFrame(rows, columns=["n", "sentinel", "first", "second"]).astype({"n": "int64", "sentinel": bool, "first": "Int64", "second": "Int64"})

    return cuts


def transformed(docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """docs plus n (units), form, prefix_chars, middle_chars and output, the text to train on.

    form is plain (output is the text), psm (prefix, suffix, middle) or spm (suffix, prefix, middle). Draws are digits of the
    sha-256 of seed and key, so they do not depend on partitions. A null text is empty, a null key the empty word; texts that
    are empty or contain a sentinel stay plain, with null lengths. Equal rows give equal rows; extra columns stay, one with
    the name of a new one is kept as ``<name>_input``. Nothing is shuffled.
    """
    new = ("n", "form", "prefix_chars", "middle_chars", "output")
    docs = aside(docs, *new)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    t, hashed, cut = free([*docs.columns, *new], "t", "hashed", "cut")
    h = lambda i: F.conv(F.substring(hashed, 8 * i - 7, 8), 16, 10).cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select(*columns, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(t), digest.alias(hashed))
    rows = rows.withColumn(cut, _cuts()(F.col(t), h(1), h(2), h(3) % 100 < rate))
    first, second = F.col(f"{cut}.first"), F.col(f"{cut}.second")
    form = F.when(first.isNull(), "plain").when(h(4) % 100 < suffix_first, "spm").otherwise("psm")
    part = lambda a, n: F.substring(F.col(t), (a + 1).cast("int"), n.cast("int"))
    prefix, middle, suffix = part(F.lit(0), first), part(first, second - first), part(second, F.lit((1 << 31) - 1))
    mark = [F.lit(x) for x in (PREFIX, SUFFIX, MIDDLE)]
    psm, spm = F.concat(mark[0], prefix, mark[1], suffix, mark[2], middle), F.concat(mark[1], suffix, mark[0], prefix, mark[2], middle)
    output = F.when(form == "plain", F.col(t)).when(form == "spm", spm).otherwise(psm)
    return rows.select(*columns, F.col(f"{cut}.n").alias("n"), form.alias("form"), first.alias("prefix_chars"), (second - first).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, read from the output and its form alone.

    Parts hold no sentinel and none can arise where a part meets one, so the first of each kind is the one that was put there.
    """
    between = lambda a, b: F.substring(output, F.locate(a, output) + 3, F.locate(b, output) - F.locate(a, output) - 3)
    middle = F.substring(output, F.locate(MIDDLE, output) + 3, F.lit((1 << 31) - 1))
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)


def op11(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the digests of the output and of the text restored from it."""
    out = transformed(docs.select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP11_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, sha256('42:' || coalesce(doc_id::varchar, '')) as h, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u from documents),
g as (select doc_id, t, u, len(u)::bigint as n, [('0x' || substr(h, i * 8 + 1, 8))::bigint for i in range(0, 4)] as h from d),
f as (select *, case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h[3] % 100 >= 50 then 'plain' when h[4] % 100 < 80 then 'spm' else 'psm' end as form,
  least(h[1] % (n + 1), h[2] % (n + 1)) as a, greatest(h[1] % (n + 1), h[2] % (n + 1)) as b from g),
p as (select *, array_to_string(u[1:a], '') as pre, array_to_string(u[a + 1:b], '') as mid, array_to_string(u[b + 1:], '') as suf from f)
select doc_id, n, form, case when form <> 'plain' then length(pre) end::bigint as prefix_chars, case when form <> 'plain' then length(mid) end::bigint as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256, sha256(t) as restored_sha256 from p"""
