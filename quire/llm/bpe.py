"""Byte-level BPE encoding and decoding by prefix dynamic programming.

A byte string has one BPE encoding, and so has each of its prefixes. For every prefix we keep
the last token of its encoding: the one token t that ends the prefix and that may follow the
last token p of the prefix before it, i.e. BPE(p + t) = [p, t]. One pass over the bytes gives
all of them; following them back from the end gives the tokens. Since a prefix's entry depends on
nothing behind it, appends are exact and cost only the appended bytes, and after an edit the entries
need computing only until they agree with the old ones over the longest token's length.
"""

from __future__ import annotations

import base64
from hashlib import sha256
from itertools import chain

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import common

#: A piece of this many bytes or more isn't remembered; two generations of so many pieces are.
CACHE_BYTES, CACHE_PIECES = 64, 300_000


class Vocabulary:
    """Ranks of byte strings: the token ids, and the order of merges."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.sizes = {i: len(t) for t, i in ranks.items()}
        #: Lengths, largest first, of the tokens of two bytes or more that end in these two.
        ends: dict[bytes, set[int]] = {}
        for t in ranks:
            if len(t) > 1:
                ends.setdefault(t[-2:], set()).add(len(t))
        self.ends = {k: sorted(x, reverse=True) for k, x in ends.items()}
        self._follows: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}

    @classmethod
    def parse(cls, lines: bytes) -> Vocabulary:
        """From the lines `base64 rank` of a .tiktoken file."""
        return cls({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())})

    def merged(self, piece: bytes) -> list[int]:
        """The definition: merge the neighbours of least rank, leftmost first. Used on at most two tokens' bytes."""
        parts, ranks = [piece[i : i + 1] for i in range(len(piece))], self.ranks
        while len(parts) > 1:
            rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[x] for x in parts]

    def whole(self, t: int) -> bool:
        """Do merges make this token out of its bytes?"""
        if (known := self._whole.get(t)) is None:
            known = self._whole[t] = self.merged(self.tokens[t]) == [t]
        return known

    def follows(self, p: int, t: int) -> bool:
        """May t come right after p?"""
        if (known := self._follows.get((p, t))) is None:
            if len(self._follows) > 300_000:
                self._follows.clear()
            known = self._follows[p, t] = self.merged(self.tokens[p] + self.tokens[t]) == [p, t]
        return known

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


class Prefixes:
    """The encoding of a growing and changing byte string: last[i] is the last token of the first i + 1 bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.v, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        _extend(self.v, self.data, self.last, len(self.data))

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replaces data[start:stop]. Returns the number of entries computed: it ends where a longest token's length of them is as before."""
        old, moved = self.last[stop:], start + len(new)
        self.data, self.last = self.data[:start] + new + self.data[stop:], self.last[:start]
        alike = 0
        for i in range(start, len(self.data)):
            _extend(self.v, self.data, self.last, i + 1)
            alike = alike + 1 if i >= moved and old[i - moved] == self.last[-1] else 0
            if alike >= self.v.longest:
                self.last += old[i + 1 - moved :]
                return i + 1 - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        return _back(self.v, self.last)


def _extend(v: Vocabulary, data: bytes, last: list[int], stop: int) -> None:
    """Puts into last the entries of the prefixes up to `stop` bytes."""
    ranks, ends, known, follows, put = v.ranks.get, v.ends.get, v._follows, v.follows, last.append
    for i in range(len(last), stop):
        end = i + 1
        if i:
            for n in ends(data[i - 1 : end], ()):
                if n <= i:
                    if (t := ranks(data[end - n : end])) is not None:
                        p = last[i - n]
                        if known[p, t] if (p, t) in known else follows(p, t):
                            break
                elif n == end and (t := ranks(data[:end])) is not None and v.whole(t):
                    break
            else:
                if (t := ranks(data[i:end])) is None:
                    raise ValueError(f"the vocabulary lacks the byte {data[i]}")
                if not follows(last[i - 1], t):
                    raise ValueError("the ranks aren't those of byte pair merges")
        elif (t := ranks(data[:1])) is None:
            raise ValueError(f"the vocabulary lacks the byte {data[0]}")
        put(t)


def _back(v: Vocabulary, last: list[int]) -> list[int]:
    out, i, size = [], len(last) - 1, v.sizes
    while i >= 0:
        out.append(last[i])
        i -= size[last[i]]
    return out[::-1]


class Encoder:
    """Texts to ids, each match of the pattern by itself. A piece that is a token as it stands gets that id, as the library does."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.v, self.find = vocabulary, regex.compile(pattern).findall
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def piece(self, piece: str) -> tuple[int, ...]:
        if (known := self.old.get(piece)) is None:
            data = piece.encode()
            whole = self.v.ranks.get(data)
            if whole is not None:
                known = (whole,)
            else:
                last: list[int] = []
                _extend(self.v, data, last, len(data))
                known = tuple(_back(self.v, last))
            if len(data) >= CACHE_BYTES:
                return known
        if len(self.new) >= CACHE_PIECES:
            self.old, self.new = self.new, {}
        self.new[piece] = known
        return known

    def encode(self, text: str) -> list[int]:
        known, miss = self.new.get, self.piece
        return list(chain.from_iterable([known(p) or miss(p) for p in self.find(text)]))


_held: dict[tuple[int, str], Encoder] = {}


def _encoder(lines: bytes, pattern: str) -> Encoder:
    """One a worker and vocabulary; its cache outlives the task, until one of another operator begins."""
    common.holds("bpe", _held.clear)
    if (key := (hash(lines), pattern)) not in _held:
        _held.clear()
        _held[key] = Encoder(Vocabulary.parse(lines), pattern)
    return _held[key]


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds to each row of docs an array of the token ids of its whole text. Null is encoded as the empty text; an existing column ids is replaced."""
    return _mapped(docs, vocabulary_path, pattern, text, f"{ids} array<int>", lambda e, t: (e.encode(t),))


def decode(docs: DataFrame, vocabulary_path: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for. Null ids give null; an id outside the vocabulary is an error."""
    return _mapped(docs, vocabulary_path, "", ids, f"{data} binary", lambda e, x: (e.v.decode(x),), none=lambda: (None,))


def digests(docs: DataFrame, vocabulary_path: str, pattern: str, text: str = "text") -> DataFrame:
    """Adds n_tokens, ids_sha256 and decoded_sha256: the ids of encode(), and the bytes of decode() of these very ids, without moving them between workers."""

    def of(e: Encoder, t: str):
        ids = e.encode(t)
        return len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(e.v.decode(ids)).hexdigest()

    return _mapped(docs, vocabulary_path, pattern, text, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", of)


def _mapped(docs: DataFrame, vocabulary_path: str, pattern: str, column: str, adds: str, of, none=None) -> DataFrame:
    import pyarrow as pa
    from pyspark.sql.types import _parse_datatype_string

    spark = common.ready(docs.sparkSession)
    with open(vocabulary_path, "rb") as f:
        lines = spark.sparkContext.broadcast(common.bounded(f.read(), "the vocabulary"))
    new = _parse_datatype_string(adds)
    names = {x.name.lower() for x in new}
    keep = [c for c in docs.columns if c.lower() not in names]
    schema = _parse_datatype_string(adds)
    for x in reversed([x for x in docs.schema if x.name in keep]):
        schema.fields.insert(0, x)
    kinds = [{"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}[x.dataType.simpleString()] for x in new]

    def run(batches):
        common.let_go("bpe")
        e = None
        for b in batches:
            e = e or _encoder(lines.value, pattern)
            got = [none() if t is None and none else of(e, t if t is not None else "") for t in b.column(column).to_pylist()]
            cols = [b.column(c) for c in keep] + [pa.array(list(x), type=k) for x, k in zip(zip(*got) if got else [[]] * len(kinds), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, names=keep + [x.name for x in new])

    source = docs if column in keep else docs.select(*[docs[c] for c in keep], docs[column])
    return source.mapInArrow(run, schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: n_tokens, ids_sha256, decoded_sha256. A null text counts as empty; repeated rows are each answered."""
    import public_tokenizers as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(docs, p.path("byte_bpe_multi_50k.tiktoken"), p.PATTERN).select("doc_id", F.col("n_tokens").cast("long"), "ids_sha256", "decoded_sha256")


QUERIES = {"op5_byte_bpe": op5}
ORACLE_SQL: dict[str, str] = {}
