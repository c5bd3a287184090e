r"""Chat formatting: turns of typed content parts as text to train on, with a loss mask, and the way back.

A turn is ``<turn:ROLE>`` CONTENT ``</turn>`` and a line break. Content is a list of typed parts. A visitor has one method for a
part's type and flattens the list, in order, into text: text parts are escaped, images, audio and documents become
placeholders ``<part:TYPE:REFERENCE:TOKENS>``, which stand for that many tokens. The visitor is made of column expressions.

Control strings begin with ``<``. In texts a backslash is doubled and each ``<`` gets a backslash before it, so that none can arise
where two parts meet, either; in roles, types and references ``>`` and ``:`` get one too. So what is not escaped is a mark, and
taking the backslash from each such pair gives back the text, whatever it is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import aside, free

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Production parameters: side of an image patch, tokens of a second of sound, tokens of a page.
PATCH, SOUND_TOKENS, PAGE_TOKENS = 14, 25, 256
#: The role whose texts are learned.
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\<"))


def escaped_name(name: Column) -> Column:
    return F.replace(F.replace(escaped(name), F.lit(">"), F.lit("\\>")), F.lit(":"), F.lit("\\:"))


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class Visitor:
    """One method for each type of part; ``visit`` gives a part's rendering, reference and number of tokens."""

    def text(self, p: Column) -> tuple[Column, Column]:
        return escaped(p["text"]), F.lit(0).cast("long")

    def image(self, p: Column) -> tuple[Column, Column]:
        side = lambda c: F.ceil(F.greatest(F.coalesce(p[c], F.lit(0)), F.lit(0)) / PATCH)
        return self._placeholder("image", p, side("width") * side("height"))

    def audio(self, p: Column) -> tuple[Column, Column]:
        return self._placeholder("audio", p, F.ceil(F.greatest(F.coalesce(p["seconds"], F.lit(0.0)), F.lit(0.0)) * SOUND_TOKENS))

    def document(self, p: Column) -> tuple[Column, Column]:
        return self._placeholder("document", p, F.greatest(F.coalesce(p["pages"], F.lit(0)), F.lit(0)).cast("long") * PAGE_TOKENS)

    def other(self, p: Column) -> tuple[Column, Column]:
        return self._placeholder(p["type"], p, F.lit(0).cast("long"))

    def _placeholder(self, kind, p: Column, tokens: Column) -> tuple[Column, Column]:
        kind = escaped_name(kind if isinstance(kind, Column) else F.lit(kind))
        return F.concat(F.lit("<part:"), kind, F.lit(":"), escaped_name(p["ref"]), F.lit(":"), tokens.cast("string"), F.lit(">")), tokens

    def visit(self, p: Column) -> Column:
        shown, tokens = self.other(p)
        for kind in ("document", "audio", "image", "text"):
            s, n = getattr(self, kind)(p)
            shown, tokens = F.when(p["type"] == kind, s).otherwise(shown), F.when(p["type"] == kind, n).otherwise(tokens)
        return F.struct(shown.alias("shown"), p["type"].alias("type"), p["ref"].alias("ref"), tokens.cast("long").alias("tokens"))


def as_parts(text: Column) -> Column:
    """A text as content of one text part; a null text is empty."""
    none = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()]))


def formatted(turns: DataFrame, parts: str = "parts", role: str = "role") -> DataFrame:
    """turns plus formatted, attachments(type, ref, tokens), attachment_tokens and loss, for the texts of a role to learn.

    A conversation's text is its turns' formatted texts one after another; a turn is a row, so nothing is shuffled and no
    conversation has to fit anywhere. loss holds (start, length) in code points of ``formatted``: each text part of a learned turn
    by itself, so placeholders are not learned. A null role is empty; null content has no parts; null parts are left
    out; a part of unknown type is a placeholder of no tokens. A column with the name of a new one is kept as
    ``<name>_input``.
    """
    turns = aside(turns, "formatted", "attachments", "attachment_tokens", "loss")
    (seen,) = free([*turns.columns, "formatted", "attachments", "attachment_tokens", "loss"], "seen")
    part_list = F.filter(F.coalesce(F.col(f"`{parts}`"), F.array().cast(f"array<{PART}>")), lambda p: p.isNotNull())
    rows = turns.withColumn(seen, F.transform(part_list, Visitor().visit))
    opening = F.concat(F.lit("<turn:"), escaped_name(F.col(f"`{role}`")), F.lit(">"))
    body = F.array_join(F.transform(seen, lambda v: v["shown"]), "")
    other = F.filter(seen, lambda v: ~v["type"].eqNullSafe(F.lit("text")))
    empty = F.struct(F.length(opening).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans"))
    size = lambda v: F.length(v["shown"]).cast("long")
    grown = lambda s, v: F.when((v["type"] == "text") & (size(v) > 0), F.array_append(s["spans"], F.struct(s["at"].alias("start"), size(v).alias("length")))).otherwise(s["spans"])
    spans = F.aggregate(seen, empty, lambda s, v: F.struct((s["at"] + size(v)).alias("at"), grown(s, v).alias("spans")), lambda s: s["spans"])
    columns = [F.col(f"`{c}`") for c in turns.columns]
    return rows.select(
        *columns,
        F.concat(opening, body, F.lit("</turn>\n")).alias("formatted"),
        F.transform(other, lambda v: F.struct(v["type"].alias("type"), v["ref"].alias("ref"), v["tokens"].alias("tokens"))).alias("attachments"),
        F.aggregate(other, F.lit(0).cast("long"), lambda s, v: s + v["tokens"]).alias("attachment_tokens"),
        F.when(F.col(f"`{role}`").eqNullSafe(F.lit(LEARNED)), spans).otherwise(F.array().cast("array<struct<start:long,length:long>>")).alias("loss"),
    )


_MARKS = re.compile(r"\\.|<turn:((?:\\.|[^>\\])*)>|(</turn>\n)|<part:((?:\\.|[^:\\])*):((?:\\.|[^:\\])*):(\d+)>", re.S)


def parsed(text: str) -> Iterator[tuple[str, list[tuple[str, str, int]]]]:
    """(role, parts) of each turn of a formatted text; parts are ("text", text, 0) or (type, reference, tokens)."""
    role, parts, at = None, [], 0
    for m in _MARKS.finditer(text):
        if m[0][0] == "\\":
            continue
        if m.start() > at:
            parts.append(("text", unescaped(text[at : m.start()]), 0))
        at = m.end()
        if m[2]:
            yield role, parts
            role, parts = None, []
        elif m[5] is not None:
            parts.append((unescaped(m[3]), unescaped(m[4]), int(m[5])))
        else:
            role, parts = unescaped(m[1]), []
    if at != len(text) or role is not None:
        raise ValueError("not a formatted text")


def read_back(pieces: DataFrame, conv: str, order: list[str]) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of each conversation, from its formatted text.

    pieces: conv, formatted and loss of ``formatted``; order: what sorts a conversation's pieces. A digest needs them in
    order, so a conversation is one sorted stream of which a task holds a batch at a time, however long it is.
    """
    rows = pieces.select(F.col(conv).alias("conv_id"), *[c for c in order if c != "formatted"], "formatted", "loss")
    kind = rows.schema["conv_id"].dataType.simpleString()
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", *order).select("conv_id", "formatted", "loss")

    class Digest:
        def __init__(self, conv):
            self.conv, self.turns, self.learned, self.size, self.all, self.loss = conv, 0, 0, 0, hashlib.sha256(), hashlib.sha256()

        def add(self, text: str, loss: list[dict]):
            for role, parts in parsed(text):
                self.turns += 1
                self.all.update(f"{role}\n{''.join(t for kind, t, _ in parts if kind == 'text')}\n".encode())
            for s in loss:
                t = unescaped(text[s["start"] : s["start"] + s["length"]])
                self.learned += len(t)
                self.loss.update(t.encode())
            self.size += len(text)

        def row(self):
            return self.conv, self.turns, self.all.hexdigest(), self.learned, self.loss.hexdigest(), self.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        flush = lambda: pa.RecordBatch.from_pydict(dict(zip(names, zip(*done))), schema=schema)
        for batch in batches:
            for conv, text, loss in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = Digest(conv)
                now.add(text, loss)
            if done:
                yield flush()
                done = []
        if now is not None:
            done.append(now.row())
            yield flush()

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    from pyspark.sql.pandas.types import to_arrow_schema

    out = f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    schema = to_arrow_schema(pieces.sparkSession.createDataFrame([], out).schema)
    return rows.mapInArrow(run, out)


def op13(turns: DataFrame) -> DataFrame:
    """Digests of all conversations and of conversation -7, read back from their formatted texts.

    Rows of a conversation go by turn (null first), equal turns by their formatted text. Rows with a null conv_id are one
    conversation. A null text is empty.
    """
    said = "\\### Assistant: </turn> ok"
    own = turns.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = turns.select("conv_id", "turn", "role", "text").unionByName(own)
    made = formatted(rows.select("conv_id", "turn", "role", as_parts(F.col("text")).alias("parts")))
    return read_back(made, "conv_id", ["turn", "formatted"])


OP13_SQL = r"""
with c as (select conv_id, turn, role, text from conversations union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, replace(replace(coalesce(text, ''), '\', '\\'), '<', '\<') as body, replace(replace(replace(replace(coalesce(role, ''), '\', '\\'), '<', '\<'), '>', '\>'), ':', '\:') as mark from c),
t as (select *, '<turn:' || mark || '>' || body || '</turn>' || chr(10) as formatted from e)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, formatted)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn nulls first, formatted) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length(formatted))::bigint as formatted_chars from t group by conv_id"""
