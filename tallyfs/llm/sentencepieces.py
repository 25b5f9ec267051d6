"""SentencePiece encoding and decoding by a max-plus scan over chunks.

The public model is a BPE vocabulary. Its encoding of a text is the one path of
pieces in which every two neighbours are stable: encoded together they come out
as the same two pieces. So each step weighs 0 if stable and minus infinity if
not, and the encoding is the best path in max-plus algebra. That makes it
parallel: a giant text is cut into chunks of CHUNK characters; the state at a
boundary is the piece that covers the last character before it; each chunk
yields its transfer matrix from entry to exit states; matrices are combined
associatively (blocks of FAN, level by level); the chosen boundary states go
back down the levels, and every chunk then traces its own pieces back.

Inside a chunk, a piece boundary is certain before every space mark that
follows another character (no piece of such a vocabulary goes on over it; this
is checked when the model is loaded). Between such places the library encodes,
word by word with a bounded cache; only the characters between a chunk's ends
and its first and last certain place need the matrix. A text of several chunks
but at most SPREAD characters goes through the same matrices within one task;
texts of one chunk are the same computation without boundaries.

The model file's path is a parameter; its bytes (under 1 MB) are sent to the
tasks. Defined cases: null and empty texts have no pieces; characters that the
vocabulary lacks are encoded as their UTF-8 bytes; a literal U+2581 counts as
a space, as in the library, and decodes as one; repeated rows each get their
result; other columns are kept, earlier results of the same names replaced.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from tallyfs.llm.common import hot_join, lean, materialize, prepare, row_key

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
CHUNK = 16_384
#: A text of up to this many characters is scanned by one task, all its chunks
#: one after the other; the chunks of a longer one are dealt out.
SPREAD = 1 << 20
#: Matrices combined in one step.
FAN = 64
#: Words and pairs that a task remembers.
CACHE = 150_000
#: Rows that a task encodes before it hands them on.
SLICE = 500
BOS = -1
MINUS_INF = float("-inf")
MODEL_BYTES = 64 << 20


class Pieces:
    """The vocabulary, the library's encoder without a dummy prefix, and which
    neighbours are stable."""

    def __init__(self, model: bytes):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if (proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or spec.precompiled_charsmap
                or spec.remove_extra_whitespaces or not spec.add_dummy_prefix):
            raise ValueError("a BPE model with byte fallback and identity normalisation is needed")
        spec.add_dummy_prefix = False
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type in (1, 4)}
        self.bytes = {i: int(p.piece[3:5], 16) for i, p in enumerate(proto.pieces) if p.type == 6}
        self.byte_id = {v: k for k, v in self.bytes.items()}
        self.longest = max(map(len, self.ids))
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece goes on over a space mark")
        self.out = [b""] * len(proto.pieces)
        for i, p in enumerate(proto.pieces):
            if p.type in (1, 4):
                self.out[i] = p.piece.replace(MARK, " ").encode()
            elif p.type == 6:
                self.out[i] = bytes([self.bytes[i]])
        self.words: dict[str, list[int]] = {}
        self.pairs: dict[tuple, bool] = {}

    def id_list(self, piece: str) -> list[int]:
        """Ids of one step: a piece, or the bytes of an unknown character."""
        i = self.ids.get(piece)
        return [i] if i is not None else [self.byte_id[b] for b in piece.encode()]

    def stable(self, a: str | None, b: str) -> bool:
        key = (a, b)
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= CACHE:
                self.pairs.clear()
            if a is None:
                known = self.lib.encode(b) == self.id_list(b)
            else:
                known = self.stable(None, b) and (
                    (b[0] == MARK and a[-1] != MARK) or self.lib.encode(a + b) == self.id_list(a) + self.id_list(b))
            self.pairs[key] = known
        return known

    def starting(self, s: str, p: int) -> list[str]:
        """Steps from place p: pieces, or the character itself if unknown."""
        found = [s[p:e] for e in range(p + 1, min(len(s), p + self.longest) + 1) if s[p:e] in self.ids]
        return found if s[p] in self.ids else [s[p], *found]

    def whole(self, s: str) -> list[int]:
        """Ids of a marked string whose ends are certain places."""
        out: list[int] = []
        words = self.words
        if len(words) > CACHE:
            words.clear()
        rest = s.split(MARK)
        if rest and rest[0]:  # begins within a word
            out += self.lib.encode(rest[0])
        space = 0
        for w in rest[1:]:
            if not w:
                space += 1
                continue
            if space:
                w, space = MARK * space + w, 0
            ids = words.get(w)
            if ids is None:
                ids = words[w] = self.lib.encode(MARK + w)
            out += ids
        if space:
            out += self.lib.encode(MARK * space)
        return out

    def walk(self, s: str, start: int, prev: str | None, stop: int) -> dict[int, str | None]:
        """Last step at each place reached from ``start`` after ``prev``, going
        on from places before ``stop``. At most one per place."""
        last: dict[int, str | None] = {start: prev}
        for p in range(start, stop):
            if p in last:
                for t in self.starting(s, p):
                    if self.stable(last[p], t):
                        last[p + len(t)] = t
        return last

    def trace(self, last: dict[int, str | None], start: int, end: int) -> list[int]:
        steps = []
        while end > start:
            steps.append(last[end])
            end -= len(last[end])
        return [i for t in reversed(steps) for i in self.id_list(t)]

    def covering(self, s: str, at: int) -> list[tuple[int, int]]:
        """States at boundary ``at``: (start, end) of steps that cover place at - 1."""
        return [(j, j + len(t)) for j in range(max(0, at - self.longest), at) for t in self.starting(s, j)
                if j + len(t) >= at]


def certain(s: str, lo: int, hi: int) -> tuple[int, int] | None:
    """First and last place in [lo, hi) where a space mark follows another
    character."""
    first = next((m.start() + 1 for m in re.finditer(f"[^{MARK}]{MARK}", s[max(lo - 1, 0):hi])), None)
    if first is None:
        return None
    first += max(lo - 1, 0)
    q = hi - 1
    while not (s[q] == MARK and s[q - 1] != MARK):
        q -= 1
    return first, q


def code(at: int, state: tuple[int, int]) -> int:
    """A state as a number that both chunks of a boundary agree on."""
    return (at - state[0]) * 4096 + state[1] - at


def decode_state(at: int, c: int) -> tuple[int, int]:
    return at - c // 4096, at + c % 4096


class Chunk:
    """One chunk with its surroundings: ``s`` holds ``left`` characters before
    the core, ``core`` characters, and the look-ahead."""

    def __init__(self, pieces: Pieces, s: str, left: int, core: int, first: bool, last: bool):
        self.p, self.s, self.lo, self.hi, self.first, self.last = pieces, s, left, left + core, first, last
        self.places = None

    def entries(self) -> list[int]:
        if self.first:
            return [BOS]
        return [code(self.lo, x) for x in self.p.covering(self.s, self.lo)]

    def exits(self) -> list[int]:
        found = [x for x in self.p.covering(self.s, self.hi)]
        return [code(self.hi, x) for x in found if not self.last or x[1] == self.hi]

    def _start(self, entry: int):
        if entry == BOS:
            return self.lo, None
        j, e = decode_state(self.lo, entry)
        return e, self.s[j:e]

    def _paths(self, entry: int):
        """(walk to the first certain place, the places, walk from the last)."""
        start, prev = self._start(entry)
        places = certain(self.s, start + 1, self.hi)
        if places is None:
            return self.p.walk(self.s, start, prev, self.hi), None, None
        a, b = places
        if self.places is None or self.places[0] != b:
            # the step before a certain place does not matter after it
            self.places = (b, self.p.walk(self.s, b, None, self.hi))
        return self.p.walk(self.s, start, prev, a), places, self.places[1]

    def transfer(self) -> list[tuple[int, int, float]]:
        out = []
        for entry in self.entries():
            head, places, tail = self._paths(entry)
            if places is not None and places[0] not in head:
                continue
            last = head if places is None else tail
            for x in self.exits():
                j, e = decode_state(self.hi, x)
                if last.get(e) == self.s[j:e] and (j in last):
                    out.append((entry, x, 0.0))
        return out

    def ids(self, entry: int, exit_: int) -> list[int]:
        head, places, tail = self._paths(entry)
        start, end = self._start(entry)[0], decode_state(self.hi, exit_)[1]
        if places is None:
            return self.p.trace(head, start, end)
        a, b = places
        return self.p.trace(head, start, a) + self.p.whole(self.s[a:b]) + self.p.trace(tail, b, end)


def combine(a: dict, b: dict) -> dict:
    """Max-plus product of two matrices held as {(entry, exit): weight}."""
    by_entry: dict[int, list] = {}
    for (e, x), w in b.items():
        by_entry.setdefault(e, []).append((x, w))
    out: dict[tuple[int, int], float] = {}
    for (e, m), w in a.items():
        for x, v in by_entry.get(m, ()):
            out[e, x] = max(out.get((e, x), MINUS_INF), w + v)
    return out


def _matrix(cells) -> dict:
    return {(c["e"], c["x"]): c["w"] for c in cells}


CELLS = "array<struct<e:int,x:int,w:double>>"


def _up(pdf):
    """Combine the matrices of one block, in order."""
    pdf = pdf.sort_values("idx")
    whole = None
    for cells in pdf["cells"]:
        m = _matrix(cells)
        whole = m if whole is None else combine(whole, m)
    cells = [{"e": e, "x": x, "w": w} for (e, x), w in whole.items()]
    return pdf.iloc[:1][["rk"]].assign(idx=pdf["_block"].iloc[0], cells=[cells])[["rk", "idx", "cells"]]


def boundary_states(matrices: list[dict], entry: int, exit_: int) -> list[tuple[int, int]]:
    """(state before, state after) of each of consecutive matrices on the best
    path from ``entry`` to ``exit_``."""
    scores = [{entry: (0.0, None)}]
    for m in matrices:
        nxt: dict[int, tuple] = {}
        for (e, x), w in m.items():
            if e in scores[-1] and scores[-1][e][0] + w > nxt.get(x, (MINUS_INF,))[0]:
                nxt[x] = (scores[-1][e][0] + w, e)
        scores.append(nxt)
    state, states = exit_, []
    for k in range(len(matrices), 0, -1):
        before = scores[k][state][1]
        states.append((before, state))
        state = before
    states.reverse()
    return states


def cut(marked: str, around: int, chunk: int) -> list[tuple[str, int, int, bool, bool]]:
    """Arguments of the chunks of a marked text (see :class:`Chunk`)."""
    n, out = n_chunks(len(marked), around, chunk), []
    for k in range(n):
        at, last = k * chunk, k == n - 1
        left, core = min(at, around), len(marked) - at if last else chunk
        out.append((marked[at - left:at + core + around], left, core, k == 0, last))
    return out


def n_chunks(length: int, around: int, chunk: int) -> int:
    """Chunks of a marked text; a last one shorter than ``around`` joins the one
    before."""
    return max(1, (length + chunk - around - 1) // chunk)


def scan_text(pieces: Pieces, marked: str, around: int, chunk: int) -> list[int]:
    """Ids of a marked text by the matrices of its chunks."""
    chunks = [Chunk(pieces, *c) for c in cut(marked, around, chunk)]
    matrices = [{(e, x): w for e, x, w in c.transfer()} for c in chunks]
    whole = functools.reduce(combine, matrices)
    exit_ = next(x for e, x in whole if e == BOS)
    states = boundary_states(matrices, BOS, exit_)
    return [i for c, (e, x) in zip(chunks, states) for i in c.ids(e, x)]


def _down(pdf):
    """States at the ends of each matrix of a block whose ends are known."""
    pdf = pdf.sort_values("idx")
    states = boundary_states([_matrix(c) for c in pdf["cells"]], int(pdf["entry"].iloc[0]), int(pdf["exit"].iloc[0]))
    return pdf[["rk", "idx"]].assign(entry=[a for a, _ in states], exit=[b for _, b in states])


def load_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        model = f.read(MODEL_BYTES + 1)
    if len(model) > MODEL_BYTES:
        raise ValueError("the model is larger than what is sent to tasks")
    return model


def _chunk_rows(big: DataFrame, around: int, chunk: int) -> DataFrame:
    """(rk, idx, s, left, core, first, last): the chunks of each distinct text;
    a last chunk shorter than ``around`` joins the one before."""
    n = f"greatest(1, (length(_m) + {chunk - around} - 1) div {chunk})"
    return (big.select(F.col("_rk").alias("rk"), F.concat(F.lit(MARK), F.translate("text", " ", MARK)).alias("_m"))
            .withColumn("_n", F.expr(n))
            .withColumn("idx", F.explode(F.expr("sequence(0L, _n - 1)")))
            .withColumn("_at", F.col("idx") * chunk)
            .withColumn("left", F.least(F.col("_at"), F.lit(around)).cast("int"))
            .withColumn("core", F.when(F.expr("idx = _n - 1"), F.length("_m") - F.col("_at")).otherwise(chunk).cast("int"))
            .select("rk", "idx", F.expr(f"substring(_m, cast(_at - left + 1 as int), left + core + {around})").alias("s"),
                    "left", "core", (F.col("idx") == 0).alias("first"), F.expr("idx = _n - 1").alias("last"))
            .dropDuplicates(["rk", "idx"]))


def encode_big(spark: SparkSession, big: DataFrame, model, around: int, chunk: int = CHUNK) -> DataFrame:
    """(_rk, n_rows, _ids) of texts of several chunks: one row per distinct key."""
    chunks = materialize(spark, _chunk_rows(big, around, chunk), "sp_chunks")

    def transfers(batches):
        pieces = Pieces(model.value)
        for b in batches:
            cells = [[{"e": e, "x": x, "w": w} for e, x, w in
                      Chunk(pieces, r["s"], r["left"], r["core"], r["first"], r["last"]).transfer()] for r in b.to_pylist()]
            t = pa.list_(pa.struct([("e", pa.int32()), ("x", pa.int32()), ("w", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column("rk"), b.column("idx"), pa.array(cells, t)], names=["rk", "idx", "cells"])

    levels = [materialize(spark, chunks.mapInArrow(lean(transfers), f"rk string, idx long, cells {CELLS}"), "sp_level")]
    while (levels[-1].agg(F.max("idx")).first()[0] or 0) > 0:
        up = (levels[-1].withColumn("_block", F.expr(f"idx div {FAN}")).groupBy("rk", "_block")
              .applyInPandas(_up, f"rk string, idx long, cells {CELLS}"))
        levels.append(materialize(spark, up, "sp_level"))
    # From the start to the end of the text: the weights leave one way.
    states = levels[-1].select("rk", "idx", F.lit(BOS).alias("entry"), F.expr("cells[0].x").alias("exit"))
    for level in reversed(levels[:-1]):
        ends = states.select("rk", F.col("idx").alias("_block"), "entry", "exit")
        below = level.withColumn("_block", F.expr(f"idx div {FAN}")).join(ends, ["rk", "_block"])
        states = below.groupBy("rk", "_block").applyInPandas(_down, "rk string, idx long, entry int, exit int")
    states = materialize(spark, states, "sp_states")

    def backtrace(batches):
        pieces = Pieces(model.value)
        for b in batches:
            ids = [Chunk(pieces, r["s"], r["left"], r["core"], r["first"], r["last"]).ids(r["entry"], r["exit"])
                   for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("rk"), b.column("idx"), pa.array(ids, pa.list_(pa.int32()))],
                                             names=["rk", "idx", "ids"])

    traced = chunks.join(states, ["rk", "idx"]).mapInArrow(lean(backtrace), "rk string, idx long, ids array<int>")
    return traced.groupBy(F.col("rk").alias("_rk")).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("idx", "ids"))), lambda c: c["ids"])).alias("_ids"))


def _decoded(ids: list[int], table: list[bytes]) -> str:
    data = b"".join([table[i] for i in ids])
    return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")


def _fields(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema.fields)


def encode(spark: SparkSession, docs: DataFrame, model_path: str = MODEL, chunk: int = CHUNK,
           verify: bool = False, spread: int = SPREAD) -> DataFrame:
    """``docs`` with ``token_ids`` (array<int>) added, as the library encodes
    the text, for texts of any length; with ``verify`` also ``round_trip``:
    whether the ids decode to the text."""
    prepare(spark)
    raw = load_model(model_path)
    around = Pieces(raw).longest
    if chunk < 4 * around:
        raise ValueError(f"chunks need {4 * around} characters at least")
    model = spark.sparkContext.broadcast(raw)
    docs = docs.drop("token_ids", "round_trip")
    names = docs.columns
    spread = max(chunk, spread)
    giant = F.coalesce(F.length("text"), F.lit(0)) + 1 > spread + around
    at = names.index("text")
    added = ["token_ids", "round_trip"] if verify else ["token_ids"]

    def run(batches):
        pieces = Pieces(model.value)
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                b = whole.slice(lo, SLICE)
                ids, ends, same = [], [0], []
                for t in b.column(at):
                    t = (t.as_py() or "").replace(" ", MARK)
                    if len(t) + 1 > chunk + around:
                        one = scan_text(pieces, MARK + t, around, chunk)
                    else:
                        one = pieces.whole(MARK + t) if t else []
                    if verify:
                        same.append(_decoded(one, pieces.out) == t.replace(MARK, " "))
                    ids.append(np.array(one, dtype=np.int32))
                    ends.append(ends[-1] + len(one))
                cols = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))]
                yield pa.RecordBatch.from_arrays([*b.columns, *cols, *([pa.array(same, pa.bool_())] if verify else [])],
                                                 names=[*b.schema.names, *added])

    small = docs.filter(~giant).mapInArrow(lean(run), _fields(docs) + "token_ids array<int>" + ", round_trip boolean" * verify)
    # The user's row is one column: no name of it meets a name used here.
    big = docs.filter(giant).select(row_key().alias("_rk"), F.col("text").cast("string").alias("text"),
                                    F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    if big.isEmpty():
        return small
    per_key = encode_big(spark, big.select("_rk", "text"), model, around, chunk)
    count = big.groupBy("_rk").agg(F.count("*").alias("_n"))
    per_key = materialize(spark, per_key.join(count, "_rk"), "sp_ids")
    salt = big.select("_rk", "_row", F.monotonically_increasing_id().alias("_seq"))
    joined = hot_join(salt, per_key, "_rk", "_n", "_seq").select(
        *[F.col("_row").getField(c).alias(c) for c in names], F.col("_ids").alias("token_ids"))
    if verify:
        joined = decode(spark, joined, model_path, out="round_trip").withColumn(
            "round_trip", F.col("round_trip") == F.translate("text", MARK, " "))
    return small.unionByName(joined)


def decode(spark: SparkSession, rows: DataFrame, model_path: str = MODEL, ids: str = "token_ids",
           out: str = "decoded") -> DataFrame:
    """``rows`` with the text of the id list ``ids`` in ``out``: the pieces'
    bytes in order without the first space; malformed bytes become U+FFFD.
    Null lists give null, ids out of range fail."""
    prepare(spark)
    model = spark.sparkContext.broadcast(load_model(model_path))
    rows = rows.drop(out)
    at = rows.columns.index(ids)

    def run(batches):
        table = Pieces(model.value).out
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE):
                b = whole.slice(lo, SLICE)
                texts = [_decoded(x.values.to_numpy().tolist(), table) if x.is_valid else None for x in b.column(at)]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])

    return rows.mapInArrow(lean(run), _fields(rows) + f"`{out}` string")
