"""Personal data spans: fixed base rules plus a semi-Markov conditional random field over candidate segments.

Base rules (email, ip, card, phone) always hold. The field looks at the rest of a text. Candidate segments are up to
``MOST_GROUPS`` consecutive groups of digits (``MOST_CHARS`` characters at most), and what stands around a spelled-out "at": up to
``MOST_DOTS`` further parts of a name in front, up to ``MOST_DOTS`` labels behind, each choice a segment of its own. Parts of a name
are whole, whatever their length; a label of more than 63 characters makes no segment. A segment's score for a kind sums the weights of
features of the whole span (digit count, group shape, separators, check digit, octets, labels, neighbours). One dynamic program
over all candidates of a text picks boundaries and kinds jointly; leaving characters out scores zero. Segments are of bounded
length, so it runs along the text with a few of them in hand, whatever the text's length.

Weights are fitted here by conditional likelihood (forward-backward over the same segments) on runs made from the base spans
of a bounded sample of documents: each is rewritten in spellings that the base rules miss, beside look-alikes that are none.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

KINDS = ("email", "ip", "card", "phone")
MOST_GROUPS, MOST_CHARS, MOST_DOTS = 8, 64, 4
#: Documents whose base spans train the field, and base spans used of each kind.
SAMPLE_DOCS, SAMPLE_SPANS = 2000, 80
#: A segment must beat leaving it out by this much (natural log of the odds).
MARGIN = 2.0

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_RUN = re.compile(r"[0-9][0-9+(). \[\]/_ -]{5,}[0-9]")
_GROUP = re.compile(r"[0-9]+")
_AT = re.compile(r" ?(?:\(at\)|\[at\]|\{at\}| at ) ?", re.I)
_DOT_BEFORE = re.compile(r" ?(?:\(dot\)|\[dot\]|\{dot\}| dot ) ?\Z", re.I)
_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?![A-Za-z0-9-])")
_DOT = re.compile(r" ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z0-9-]{2,63}(?![A-Za-z0-9-])", re.I)
_LETTERS = re.compile(r"[A-Za-z]{2,6}\Z")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by the base rules, each kind leftmost and non-overlapping, in time linear in the text."""
    out = []
    if "@" in text:
        last = 0
        for m in _DOMAIN.finditer(text):
            at = m.start()
            while at > last and text[at - 1] in _LOCAL_CHARS:
                at -= 1
            if at < m.start():
                out.append((at, m.end(), "email"))
                last = m.end()
    if _DIGIT.search(text):
        if "." in text:
            out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:] if len(p) > 4 else p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((*m.span(), "card"))
        if "+" in text:
            out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def features(text: str, start: int, end: int, groups: list[str]) -> list[str]:
    """Names of the features of a span of digit groups, whatever its kind."""
    span = text[start:end]
    digits = "".join(groups)
    n = len(digits)
    seps = re.sub(r"[0-9]+", "", span)
    out = ["any", f"n={min(n, 20)}", f"groups={len(groups)}", "shape=" + "-".join(str(len(g)) for g in groups), "sep=" + "".join(sorted(set(seps)))]
    if 12 <= n <= 19:
        out.append("check-ok" if luhn(digits) else "check-bad")
    if len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups):
        out.append("octets")
    if n and len(groups) == 3 and re.fullmatch(r"(19|20)[0-9]{2}", groups[0]) and len(groups[1]) <= 2 and len(groups[2]) <= 2:
        out.append("date")
    if len(set(re.findall(r"[^0-9]+", span))) == 1:
        out.append("one-sep")
    before, after = text[start - 1 : start], text[end : end + 1]
    if before.isalnum() or after.isalnum():
        out.append("touches")
    if re.match(r"[.,/_-][0-9]", text[end : end + 2]) or re.search(r"[0-9][.,/_-]\Z", text[max(0, start - 2) : start]):
        out.append("goes-on")
    if _AT.match(text, end):
        out.append("at-follows")
    return out


#: A candidate segment: start, end, features, kinds.
Segment = tuple[int, int, list[str], tuple[str, ...]]


def segments(text: str, taken: list[tuple[int, int, str]]) -> Iterator[Segment]:
    """Candidate segments in order of their starts. None overlaps a base span."""
    busy = _disjoint(taken)
    return heapq.merge(_digit_segments(text, busy), _mail_segments(text, busy), key=lambda s: s[0])


def _digit_segments(text: str, busy: list[tuple[int, int]]) -> Iterator[Segment]:
    if not _DIGIT.search(text):
        return
    for m in _RUN.finditer(text):
        part: list[tuple[int, int]] = []  # the groups that a segment from the first of them may have
        for g in _GROUP.finditer(text, *m.span()):
            if _near(busy, g.span()):
                continue
            if part and (g.start() - part[-1][1] > 4 or _near(busy, (part[-1][1], g.start()))):
                while part:
                    yield from _from_first(text, part)
                    del part[0]
            elif len(part) == MOST_GROUPS:
                yield from _from_first(text, part)
                del part[0]
            part.append(g.span())
        while part:
            yield from _from_first(text, part)
            del part[0]


def _from_first(text: str, part: list[tuple[int, int]]) -> Iterator[Segment]:
    for j in range(1, len(part) + 1):
        start, end = part[0][0], part[j - 1][1]
        if text[start - 1 : start] == "(" and ")" in text[start:end]:
            start -= 1
        if end - start > MOST_CHARS:
            return
        if 7 <= sum(b - a for a, b in part[:j]) <= 19 or j == 4:
            yield start, end, features(text, start, end, [text[a:b] for a, b in part[:j]]), ("ip", "card", "phone")


def _name_start(text: str, end: int) -> int:
    """Where the run of name characters that ends at ``end`` begins, however long: runs before different words "at" are disjoint."""
    while end > 0 and text[end - 1] in _LOCAL_CHARS:
        end -= 1
    return end


def _mail_segments(text: str, busy: list[tuple[int, int]]) -> Iterator[Segment]:
    if "at" not in text and "AT" not in text and "At" not in text and "aT" not in text:
        return
    for at in _AT.finditer(text):
        user, host = _name_start(text, at.start()), _HOST.match(text, at.end())
        if user == at.start() or not host:
            continue
        starts, ends = [user], []
        while len(starts) <= MOST_DOTS and (more := _DOT_BEFORE.search(text, max(0, starts[-1] - 8), starts[-1])) and (user := _name_start(text, more.start())) < more.start():
            starts.append(user)
        end = host.end()
        while len(ends) <= MOST_DOTS and (more := _DOT.match(text, end)):
            ends.append(end := more.end())
        bracket = any(c in at[0] for c in "([{")
        for k in range(len(starts) - 1, -1, -1):
            for n, end in enumerate(ends[:MOST_DOTS], 1):
                words = "dot" in text[host.end() : end].lower()
                if (words or bracket) and not _near(busy, (starts[k], end)):
                    yield starts[k], end, _mail_features(text, starts[k], end, bracket, words, host, k, k + 1 < len(starts), n < len(ends)), ("email",)


def _mail_features(text: str, start: int, end: int, bracket: bool, words: bool, host: re.Match, dots: int, before: bool, after: bool) -> list[str]:
    out = ["spelled", "at-bracket" if bracket else "at-word", "dot-word" if words else "dot-sign", "tld" if _LETTERS.search(text, host.end(), end) else "no-tld", f"user-parts={dots}"]
    if len(host[0]) == 1:
        out.append("short-host")
    if before:
        out.append("goes-on-before")
    if after:
        out.append("goes-on-after")
    return out


def _disjoint(taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Spans of several kinds may overlap: their union as disjoint intervals, sorted by start and so by end."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for a, b, _ in taken):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _near(busy: list[tuple[int, int]], span: tuple[int, int]) -> list[tuple[int, int]]:
    """The disjoint sorted intervals that overlap span."""
    first = bisect.bisect_right(busy, span[0], key=lambda x: x[1])
    return busy[first : bisect.bisect_left(busy, span[1], lo=first, key=lambda x: x[0])]


def _score(features: list[str], kind: str, weights: dict[tuple[str, str], float]) -> float:
    return sum(weights.get((kind, f), 0.0) for f in features)


def decode(text: str, taken: list[tuple[int, int, str]], weights: dict[tuple[str, str], float], margin: float = MARGIN) -> list[tuple[int, int, str]]:
    """Spans that the field adds, in order: the best-scoring set of disjoint segments.

    Segments come in order of their starts. Those whose end has not been passed wait in a heap, with the best score up to
    their end; the best of all that end before the segment at hand is what it goes on from.
    """
    out: list[tuple[int, int, str]] = []
    waiting: list[tuple[int, int, float, tuple]] = []
    best, chain, last = 0.0, None, 0  # chain: the segments of the best set so far, from the last one back

    def told() -> None:
        nonlocal chain
        found = []
        while chain:
            found.append(chain[0])
            chain = chain[1]
        out.extend(reversed(found))

    for number, (start, end, names, kinds) in enumerate(segments(text, taken)):
        while waiting and waiting[0][0] <= start:
            _, _, value, path = heapq.heappop(waiting)
            if value > best:
                best, chain = value, path
        if start >= last and chain:  # nothing is open: what is best so far stays
            told()
            best = 0.0
        for k, kind in enumerate(kinds):
            gain = _score(names, kind, weights) - margin
            if gain > 0:
                heapq.heappush(waiting, (end, number * len(KINDS) + k, best + gain, ((start, end, kind), chain)))
                last = max(last, end)
    while waiting:
        _, _, value, path = heapq.heappop(waiting)
        if value > best:
            best, chain = value, path
    told()
    return out


def _examples(spans: list[tuple[str, str]], rng: random.Random) -> list[tuple[str, tuple[int, int, str] | None]]:
    """Short texts and their one entity (or none): base spans respelled, and look-alikes."""
    out = []

    def add(body: str, kind: str | None):
        left = rng.choice(["call ", "and ", "x, ", "on ", "at: ", ""])
        out.append((left + body + rng.choice([" then", ".", ", so", " the", ""]), (len(left), len(left) + len(body), kind) if kind else None))

    for kind, span in spans:
        digits = re.sub(r"[^0-9]", "", span)
        if kind == "phone":
            local = digits[-10:] if len(digits) >= 10 else digits
            a, b, c = local[:-7], local[-7:-4], local[-4:]
            for form in (f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"1-{a}-{b}-{c}", f"00{digits[:-10] or '1'} {a} {b} {c}"):
                add(form, kind)
        elif kind == "card":
            for sep in ".", "_", "/", " ":
                add(sep.join(digits[i : i + 4] for i in range(0, len(digits), 4)), kind)
            bad = digits[:-1] + str((int(digits[-1]) + rng.randint(1, 9)) % 10)
            for sep in (".", "_", " ", "-", ""):
                add(sep.join(bad[i : i + 4] for i in range(0, len(bad), 4)), None)
        elif kind == "ip":
            for sep in ("[.]", " . ", "(.)"):
                add(sep.join(span.split(".")), kind)
            add(".".join(str(int(p) + 300) for p in span.split(".")), None)
        elif kind == "email":
            user, _, host = span.partition("@")
            for form in (f"{user} [at] {host}", f"{user}(at){host}", f"{user} at {host.replace('.', ' dot ')}", f"{user} [at] {host.replace('.', ' [dot] ')}"):
                add(form, kind)
            if len(user) > 3:
                for form in (f"{user[:2]} dot {user[2:]} at {host.replace('.', ' dot ')}", f"{user[:-2]} [dot] {user[-2:]} [at] {host}"):
                    add(form, kind)
            for form in (f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(1000, 9999)} [at] {host}", f"{rng.randint(1000000, 9999999)}(at){host}"):
                add(form, kind)
            add(f"{user} at a dot in", None)
    for _ in range(len(spans)):
        d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
        for form in (f"20{d(2)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", f"20{d(2)}/{rng.randint(1, 12)}/{rng.randint(1, 28)}", d(7), d(8), d(9), d(10), d(11), d(13), d(16), f"{d(4)}.{d(4)}", f"{d(3)} {d(4)}", f"{d(4)}-{d(4)}", f"{d(1)}.{d(1)}.{d(2)}", f"{d(3)} {d(3)} {d(3)}", f"{d(2)}.{d(2)}.20{d(2)}", f"20{d(2)}-20{d(2)}", f"{d(2)} {d(2)} {d(2)} {d(2)}", f"{d(5)} {d(5)}", f"20{d(2)} 20{d(2)} 20{d(2)}"):
            add(form, None)
    return out


def fit(spans: list[tuple[str, str]], epochs: int = 6, rate: float = 0.2, decay: float = 1e-3, seed: int = 7) -> dict[tuple[str, str], float]:
    """Weights by stochastic gradient on the conditional log-likelihood; no spans give no weights (nothing is added)."""
    rng = random.Random(seed)
    weights: dict[tuple[str, str], float] = {}
    lattices = []
    for text, gold in _examples(spans, rng):
        found = list(segments(text, []))
        if found:
            borders = sorted({x for s in found for x in s[:2]})
            lattices.append((len(borders) - 1, [(borders.index(s[0]), borders.index(s[1]), *s) for s in found], gold))
    for _ in range(epochs):
        rng.shuffle(lattices)
        for n, found, gold in lattices:
            scored = [(i, j, _score(names, kind, weights), names, kind, (a, b, kind)) for i, j, a, b, names, kinds in found for kind in kinds]
            fore = [0.0] + [-math.inf] * n
            back = [-math.inf] * n + [0.0]
            ends: list[list] = [[] for _ in range(n + 1)]
            starts: list[list] = [[] for _ in range(n + 1)]
            for s in scored:
                ends[s[1]].append(s)
                starts[s[0]].append(s)
            for j in range(1, n + 1):
                fore[j] = _logsum([fore[j - 1], *(fore[s[0]] + s[2] for s in ends[j])])
            for i in range(n - 1, -1, -1):
                back[i] = _logsum([back[i + 1], *(back[s[1]] + s[2] for s in starts[i])])
            for i, j, value, names, kind, span in scored:
                step = float(span == gold) - math.exp(min(0.0, fore[i] + value + back[j] - fore[n]))
                if abs(step) > 1e-4:
                    for f in names:
                        w = weights.get((kind, f), 0.0)
                        weights[kind, f] = w + rate * (step - decay * w)
    return weights


def _logsum(xs: list[float]) -> float:
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs)) if top > -math.inf else top


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_spans: int = SAMPLE_SPANS) -> dict[tuple[str, str], float]:
    """Weights from the base spans of at most ``sample_docs`` distinct texts with digits or an @ (lowest hash of the text first).

    The hash of the last of them is found first, from hashes alone, so that no task meets more texts than the sample has.
    """
    near = docs.where(F.col("text").rlike(r"@[A-Za-z0-9-]+\.|\+[0-9]|[0-9] ?[0-9.][0-9.-]{5}")).select("text", F.xxhash64("text").alias("h"))
    last = near.select("h").distinct().orderBy("h").limit(sample_docs).agg(F.max("h")).first()[0]
    rows = near.where(F.col("h") <= (0 if last is None else last)).dropDuplicates(["h"]).select("text")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(k, t[a:b]) for t in batch.column(0).to_pylist() for a, b, k in base_spans(t)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string())], names=["kind", "span"])

    got = rows.mapInArrow(found, "kind string, span string").where("length(span) <= 64").distinct()
    ranked = got.withColumn("r", F.row_number().over(_window())).where(F.col("r") <= sample_spans)
    return fit(sorted((r[0], r[1]) for r in ranked.select("kind", "span").collect()))


def _window():
    from pyspark.sql import Window

    return Window.partitionBy("kind").orderBy(F.xxhash64("span"), "span")


def find(docs: DataFrame, weights: dict[tuple[str, str], float]) -> DataFrame:
    """docs(doc_id, text) -> doc_id, base and added: arrays of (start, end, kind) in code points, end exclusive.

    A null text is empty. Added spans never overlap base ones. Rows are independent, so copies and ties get equal spans.
    """
    span = "array<struct<start:int,end:int,kind:string>>"
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
        for batch in pieces(batches, most=2 << 20):
            base = [base_spans(t or "") for t in batch.column(1).to_pylist()]
            more = [sorted(decode(t or "", b, shared.value)) for t, b in zip(batch.column(1).to_pylist(), base)]
            dicts = [[[{"start": a, "end": b, "kind": k} for a, b, k in row] for row in rows] for rows in (base, more)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dicts[0], kind), pa.array(dicts[1], kind)], names=["doc_id", "base", "added"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {span}, added {span}")


def op2(docs: DataFrame) -> DataFrame:
    """doc_id, base counts per kind, base_sha256, spans (base and added), n_added."""
    found = find(docs, learn(docs))
    order = F.expr("transform(array_sort(transform(concat(base, added), s -> struct(s.start as start, array_position(array('email', 'ip', 'card', 'phone'), s.kind) as k, s.end as end, s.kind as kind))), s -> concat(s.kind, ':', s.start, ':', s.end))")
    base = F.expr("array_join(transform(base, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")
    n = [F.size(F.expr(f"filter(base, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *n, F.sha2(base, 256).alias("base_sha256"), F.array_join(order, ",").alias("spans"), F.size("added").cast("long").alias("n_added"))


def redact(docs: DataFrame, weights: dict[tuple[str, str], float]) -> DataFrame:
    """docs with every found span of text replaced by its kind in angle brackets (overlapping spans by the first one's).

    n_chars, where present, follows the new text. Null texts stay null; other columns are untouched.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    has = "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, most=2 << 20):
            at = batch.schema.get_field_index("text")
            cols, new = list(batch.columns), []
            for t in cols[at].to_pylist():
                if t:
                    base = base_spans(t)
                    out, end = [], 0
                    for a, b, k in sorted(base + decode(t, base, shared.value)):
                        if a >= end:
                            out += [t[end:a], f"<{k.upper()}>"]
                        end = max(end, b)
                    t = "".join([*out, t[end:]])
                new.append(t)
            cols[at] = pa.array(new, pa.string())
            if has:
                i = batch.schema.get_field_index("n_chars")
                old = cols[i].to_pylist()
                cols[i] = pa.array([o if t is None else len(t) for t, o in zip(new, old)], cols[i].type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def digest(spans: list[tuple[int, int, str]]) -> str:
    """The base digest of one text, for tests."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest()
