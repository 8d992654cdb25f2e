"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

The field reads stretches of tokens around digits, `@` and its spelled forms. A segment is one token outside
any entity, or up to LONGEST tokens as one entity of a type; features look at the segment's whole text. Segment and
transition weights are trained here by gradient steps on the conditional likelihood of generated labelled lines, with
sums over all segmentations by forward-backward. Decoding chooses boundaries and types jointly by dynamic
programming; a span is added if its marginal probability is at least SURE and no base span overlaps it.

All scans are linear in the text's length, except for the field, which is linear with a factor of LONGEST * types.
"""

from __future__ import annotations

import math
import pickle
import random
import re
from bisect import bisect_right
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common

KINDS = ("email", "ip", "card", "phone")
#: Columns that find() adds.
ADDED = (*(f"n_{k}" for k in KINDS), "base_spans", "spans", "masked")
LONGEST, SURE = 6, 0.9
#: A stretch is decoded in pieces of so many tokens, with so many more to each side.
PIECE, BESIDE = 400, 4 * LONGEST

# Fixed patterns of the base spans. A start inside a run of digits can match only what the run's start does, so it is passed over.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the patterns' matches that hold, sorted."""
    out = [(a, 0, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


_CUE = re.compile(r"[0-9@]+|[(\[]\x20?at\x20?[)\]]", re.I)
_TOKEN = re.compile(r"[^\s,;|<>\"'=:]+")
_TRAIL = ".!?)]}*#%&$"
#: Characters looked at to either side of a cue.
_SIDE = 24


def stretches(text: str) -> list[list[tuple[int, int]]]:
    """Tokens (start, end) around cues. Stretches are split at line ends and never overlap."""
    out: list[list[tuple[int, int]]] = []
    lo = hi = -1
    bounds = []
    for m in _CUE.finditer(text):
        a, b = max(m.start() - _SIDE, 0), m.end() + _SIDE
        if a > hi:
            if hi >= 0:
                bounds.append((lo, hi))
            lo = a
        hi = max(hi, b)
    if hi >= 0:
        bounds.append((lo, hi))
    floor = 0
    for a, b in bounds:
        while a > floor and not text[a - 1].isspace():
            a -= 1
        b = max(min(b, len(text)), floor)
        while b < len(text) and not text[b].isspace():
            b += 1
        floor, a = b, max(a, floor)
        row: list[tuple[int, int]] = []
        for m in _TOKEN.finditer(text, a, b):
            if row and "\n" in text[row[-1][1] : m.start()]:
                out.append(row)
                row = []
            row.append(m.span())
        if row:
            out.append(row)
    return out


_SHAPES = ((re.compile(r"[0-9]+"), "9"), (re.compile(r"[^\W\d_]+"), "a"))
_WORDS = {"tel": "phone", "phone": "phone", "call": "phone", "mobile": "phone", "fax": "phone", "mail": "email", "email": "email", "e-mail": "email", "card": "card", "visa": "card", "ip": "ip", "host": "ip", "address": "ip"}


def features(span: str, before: str, tokens: int) -> tuple[str, ...]:
    """Of the whole span, whatever its length; those of short ones are remembered."""
    return _remembered(span, before, tokens) if len(span) + len(before) <= 120 else _features(span, before, tokens)


def _features(span: str, before: str, tokens: int) -> tuple[str, ...]:
    digits = "".join(c for c in span if "0" <= c <= "9")
    letters = sum(c.isalpha() for c in span)
    shape = span
    for p, to in _SHAPES:
        shape = p.sub(to, shape)
    out = ["bias", f"digits:{min(len(digits), 20)}", f"letters:{min(letters, 3)}", f"tokens:{tokens}"]
    if len(shape) <= 24:
        out.append("shape:" + shape)
    parts = span.split(".")
    if len(parts) == 4 and all(x.isdigit() and len(x) <= 3 and int(x) <= 255 for x in parts):
        out.append("octets")
    if 13 <= len(digits) <= 19 and not letters and not any(c in "+()." for c in span):
        out.append(f"card:{luhn(digits)}:{len(digits) == len(span)}")
    if span[:1] == "+" or span[:1] == "(":
        out.append("opens:" + span[0])
    if re.fullmatch(r"[^\s@]+@[^\s@]+\.[A-Za-z]{2,}", span):
        out.append("mail")
    if re.fullmatch(r"[\w.%+-]+ ?[(\[] ?at ?[)\]] ?[\w-]+( ?([(\[] ?dot ?[)\]]|\.) ?[\w-]+)+", span, re.I):
        out.append("spelled")
    if re.fullmatch(r"[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}", span):
        out.append("national")
    if before in _WORDS:
        out.append("after:" + _WORDS[before])
    return tuple(out)


_remembered = lru_cache(50_000)(_features)


def _remember() -> None:
    common.holds("pii", _remembered.cache_clear)


def _cover(spans: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what sorted spans cover."""
    starts: list[int] = []
    ends: list[int] = []
    for a, _, b in spans:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _meets(cover: tuple[list[int], list[int]], a: int, b: int) -> bool:
    """Does the span share a character with what is covered?"""
    starts, ends = cover
    k = bisect_right(ends, a)  # the first that ends behind a
    return k < len(starts) and starts[k] < b


class Field:
    """Weights by (type, feature) and (type, type); type -1 is outside."""

    def __init__(self):
        self.w: dict[tuple, float] = {}

    def segments(self, text: str, row: list[tuple[int, int]]) -> list[list[tuple[int, int, int, tuple]]]:
        """For each end token: (first token, start, end, features)."""
        lower = [text[a:b].lower().rstrip(_TRAIL) for a, b in row]
        cue = [bool(_CUE.search(text, a, b)) or x in ("(at)", "[at]", "at") for (a, b), x in zip(row, lower, strict=True)]
        out = []
        for j, (_, end) in enumerate(row):
            here = []
            for i in range(j, max(-1, j - LONGEST), -1):
                a, b = row[i][0], end
                while b > a + 1 and text[b - 1] in _TRAIL:
                    b -= 1
                while a < b - 1 and text[a] in "[{*#":
                    a += 1
                if i == j or any(cue[i : j + 1]):
                    here.append((i, a, b, features(text[a:b], lower[i - 1] if i else "", j - i + 1)))
            out.append(here)
        return out

    def score(self, kind: int, found: tuple[str, ...]) -> float:
        w = self.w
        return sum([w.get((kind, f), 0.0) for f in found])

    def _steps(self, segs):
        """For each end the entering steps (first, kind, score, segment); outside segments have one token and no weight but the step's."""
        return [[(i, k, self.score(k, s[3]), s) for s in here for i in (s[0],) for k in range(len(KINDS))] + [(j, -1, 0.0, None)] for j, here in enumerate(segs)]

    def sums(self, segs) -> tuple[list[dict], list[dict], float, list]:
        """Log sums of all segmentations up to and from each place by type, and of all."""
        steps, n, w = self._steps(segs), len(segs), self.w
        ahead: list[dict] = [{-1: 0.0}] + [{} for _ in range(n)]
        for j in range(n):
            acc: dict[int, list] = {}
            for i, k, s, _ in steps[j]:
                for p, v in ahead[i].items():
                    acc.setdefault(k, []).append(v + s + w.get((p, k), 0.0))
            ahead[j + 1] = {k: _lse(x) for k, x in acc.items()}
        back: list[dict] = [{} for _ in range(n)] + [dict.fromkeys(range(-1, len(KINDS)), 0.0)]
        gather: list[dict] = [{} for _ in range(n + 1)]
        for j in range(n - 1, -1, -1):
            for i, k, s, _ in steps[j]:
                for p in range(-1, len(KINDS)):
                    gather[i].setdefault(p, []).append(s + w.get((p, k), 0.0) + back[j + 1].get(k, -1e9) if back[j + 1] else -1e9)
            if j in range(n):
                back[j] = {p: _lse(x) for p, x in gather[j].items()} if gather[j] else {}
                # all steps that start at j end at j or later, and these ends are done
        return ahead, back, _lse(list(ahead[n].values())) if n else 0.0, steps

    def marginals(self, segs) -> list[tuple[int, int, float, tuple | None, int]]:
        """(end token, kind, probability, segment, first) of every step."""
        ahead, back, total, steps = self.sums(segs)
        out = []
        for j, row in enumerate(steps):
            for i, k, s, seg in row:
                into = _lse([v + self.w.get((p, k), 0.0) for p, v in ahead[i].items()])
                out.append((j, k, math.exp(min(0.0, into + s + back[j + 1].get(k, 0.0) - total)), seg, i))
        return out

    def best(self, segs) -> list[tuple[int, int, int, int]]:
        """(start, kind, end, end token) of the entities of the best segmentation."""
        steps, w = self._steps(segs), self.w
        table: list[dict] = [{-1: (0.0, None)}]
        for j in range(len(segs)):
            here: dict[int, tuple] = {}
            for i, k, s, seg in steps[j]:
                for p, (v, _) in table[i].items():
                    x = v + s + w.get((p, k), 0.0)
                    if k not in here or x > here[k][0]:
                        here[k] = (x, (i, p, seg))
            table.append(here)
        out, j = [], len(segs)
        k = max(table[j], key=lambda k: table[j][k][0])
        while j:
            i, p, seg = table[j][k][1]
            if k >= 0:
                out.append((seg[1], k, seg[2], j - 1))
            j, k = i, p
        return out[::-1]

    def find(self, text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans beside those taken."""
        out, cover = [], _cover(taken)
        for row in stretches(text):
            if taken and all(_meets(cover, a, b) for a, b in row if _CUE.search(text, a, b)):
                continue  # every cue lies in a base span
            for at in range(0, len(row), PIECE):  # bounded pieces of an endless stretch; a span belongs to the piece that its last token is in
                first = max(0, at - BESIDE)
                segs = self.segments(text, row[first : at + PIECE + BESIDE])
                new = [x for x in self.best(segs) if at <= first + x[3] < at + PIECE and not _meets(cover, x[0], x[2]) and not (out and x[0] < out[-1][2])]
                if new:
                    sure = {(s[1], k, s[2]): p for _, k, p, s, _ in self.marginals(segs) if s is not None}
                    out += [x[:3] for x in new if sure.get(x[:3], 0.0) >= SURE]
        return out


def _lse(x: list[float]) -> float:
    m = max(x)
    return m + math.log(sum([math.exp(v - m) for v in x]))


def generated(n: int, seed: int = 5) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Labelled lines: words of invented prose, entities in several spellings, and numbers that are none."""
    g = random.Random(seed)
    word = lambda: "".join(g.choice(("th", "er", "on", "in", "ed", "es", "ou", "que", "re", "la", "un", "ge", "st")) for _ in range(g.randint(1, 3)))
    num = lambda k: "".join(g.choice("0123456789") for _ in range(k))

    def card() -> str:
        d = num(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        return g.choice((d, " ".join(d[i : i + 4] for i in range(0, 16, 4)), "-".join(d[i : i + 4] for i in range(0, 16, 4))))

    def mail() -> str:
        a, b, c = word() + g.choice(("", ".", "_")) + word() + g.choice(("", num(2))), word() + g.choice(("", num(1))), g.choice(("com", "org", "example.com", "net", "de"))
        return g.choice((f"{a}@{b}.{c}", f"{a}@{b}.{c}", f"{a} (at) {b}.{c}", f"{a} [at] {b} [dot] {c.split('.')[-1]}", f"{a}(at){b}(dot){c.split('.')[-1]}"))

    ip = lambda: ".".join(str(g.randint(0, 255)) for _ in range(4))
    phone = lambda: g.choice((f"+{g.randint(1, 99)} ({num(3)}) {num(3)}-{num(4)}", f"+{g.randint(1, 99)} {num(3)} {num(3)} {num(4)}", f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{num(11)}"))

    def not_card() -> str:
        while luhn(d := num(16)):
            pass
        return d

    plain = (lambda: num(g.randint(1, 6)), lambda: f"{num(1)}.{num(1)}", lambda: f"{num(4)}-{num(2)}-{num(2)}", not_card, not_card, not_card, lambda: f"{num(1)}.{num(1)}.{num(1)}", lambda: f"{g.randint(256, 999)}.{num(3)}.{num(3)}.{g.randint(256, 999)}", lambda: word() + num(3), lambda: f"{num(2)}:{num(2)}", lambda: "@" + word(), lambda: num(g.randint(7, 12)), lambda: f"{num(3)},{num(3)}", lambda: f"{word()} @ {num(2)}", lambda: f"v{num(1)}.{num(2)}.{num(3)}", lambda: f"{num(40)}", lambda: f"{num(8)}{word()}{num(8)}")
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(g.randint(2, 4)):
            text += " ".join(word() for _ in range(g.randint(0, 3))) + " "
            k = g.randint(-4, 3)
            if k >= 0:
                s = (mail, ip, card, phone)[k]()
                spans.append((len(text), k, len(text) + len(s)))
                text += s
            else:
                text += g.choice(plain)()
            text += g.choice((" ", ". ", ", "))
        out.append((text + word(), spans))
    return out


def train(lines: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = 4, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """Stochastic gradient steps on the conditional log-likelihood. Labelled spans that no segment has count as outside."""
    field, g, grown = Field(), random.Random(1), {}
    lines = list(lines)
    for _ in range(epochs):
        g.shuffle(lines)
        for text, spans in lines:
            for row in stretches(text):
                segs = field.segments(text, row)
                want, gold = {(a, k, b) for a, k, b in spans}, {}
                ends = {}
                for j, here in enumerate(segs):
                    for i, a, b, f in here:
                        for k in range(len(KINDS)):
                            if (a, k, b) in want and j not in ends:
                                ends[j] = (i, k, f)
                j, path = len(segs), []
                while j:
                    i, k, f = ends.get(j - 1, (j - 1, -1, ()))
                    path.append((k, f))
                    j = i
                p = -1
                for k, f in reversed(path):
                    for key in [(p, k), *((k, x) for x in f)]:
                        gold[key] = gold.get(key, 0.0) + 1.0
                    p = k
                ahead, back, total, steps = field.sums(segs)
                for j, row_steps in enumerate(steps):
                    for i, k, s, seg in row_steps:
                        after = back[j + 1].get(k, 0.0)
                        for q, v in ahead[i].items():
                            prob = math.exp(min(0.0, v + field.w.get((q, k), 0.0) + s + after - total))
                            if prob > 1e-6:
                                for key in [(q, k), *(((k, x) for x in seg[3]) if seg else ())]:
                                    gold[key] = gold.get(key, 0.0) - prob
                for key, d in gold.items():
                    grown[key] = grown.get(key, 1e-8) + d * d
                    field.w[key] = field.w.get(key, 0.0) * (1 - decay) + rate * d / math.sqrt(grown[key])
    return field


@lru_cache(1)
def trained() -> Field:
    return train(generated(1_200))


def spans(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each (start, kind, end), sorted."""
    known = base(text)
    return known, sorted(known + field.find(text, known)) if _CUE.search(text) else known


def find(docs: DataFrame, field: Field | None = None, text: str = "text") -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone, base_spans, spans (kind:start:end, comma-joined) and masked (the whole text with every span replaced by its kind in brackets; overlapping spans as one, by the first). A null text has no spans and stays null; existing columns of these names are replaced, others pass through."""
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    spark = common.ready(docs.sparkSession)
    held = spark.sparkContext.broadcast(common.bounded(pickle.dumps((field or trained()).w), "the field"))
    new = list(ADDED)
    keep = [c for c in docs.columns if c.lower() not in new]
    schema = StructType([*(docs.schema[c] for c in keep), *(StructField(n, LongType() if n[:2] == "n_" else StringType()) for n in new)])

    def run(batches):
        common.let_go("pii")
        _remember()
        field = Field()
        for b in batches:
            field.w = field.w or pickle.loads(held.value)
            cols: list[list] = [[] for _ in new]
            for t in b.column(text).to_pylist():
                known, every = spans(t or "", field)
                listed = lambda x: ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in x)
                for c, v in zip(cols, [*(sum(x[1] == k for x in known) for k in range(len(KINDS))), listed(known), listed(every), mask(t, every)], strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), *(pa.array(c, pa.int64() if n[:2] == "n_" else pa.string()) for c, n in zip(cols, new, strict=True))], names=[*keep, *new])

    return docs.select(*keep, *([text] if text not in keep else [])).mapInArrow(run, schema)


def mask(text: str | None, found: list[tuple[int, int, int]]) -> str | None:
    if text is None or not found:
        return text
    out, at = [], 0
    for a, k, b in found:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the numbers of base spans, their digest, and all spans. Null and empty texts have none; repeated rows all come back; further columns are ignored."""
    out = find(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.col("base_spans"), 256).alias("base_sha256"), "spans")


QUERIES = {"op10_pii": op10}
ORACLE_SQL: dict[str, str] = {}
