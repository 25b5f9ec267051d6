"""Quality by perplexity: an interpolated modified Kneser-Ney character n-gram
model (order 4) trained on all trusted text.

Counts: each task counts the n-grams of its batches, one aggregation sums them.
Continuation counts, the three discounts per order and the back-off weights are
joins and aggregations over the n-gram tables.

Scoring: documents are packed into shards of about SHARD_CHARS characters. A
shard asks for its distinct n-grams only; the requests of all shards are joined
with the model by n-gram and return by shard to the packed texts, which lie in
a bucketed table below the checkpoint folder and do not move. Nothing of the model is broadcast or
collected, and its size is not limited.

Decision: a fifth of the trusted documents is left out of the counts. Per
language, a document's mean log-probability is compared with quantiles of these,
shrunk towards the language's mean by PRIOR_CHARS characters so that short texts
are not judged on noise; a language with few of them leans on the spread of all.

Defined cases: null text counts as empty; a text is its characters after three
start marks and before an end mark, so an empty one has one event; characters
outside the Basic Multilingual Plane count as one symbol; a language (or null)
without a left-out trusted row cannot be judged, by its own text for want of it
nor by that of other languages, so all its rows are kept and lo and hi are null;
repeated rows are judged one by one; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfs.llm.common import BROADCAST_ROWS, bounded_broadcast, lean, materialize, prepare, release_memory, row_key
from tallyfs.session import scratch_path

ORDER = 4
START, END = "\x02", "\x03"
SHARD_CHARS = 8_000_000
#: Characters whose n-grams are indexed at once: what a task holds beside its
#: texts does not grow with a batch, a shard or a giant text.
BLOCK_CHARS = 500_000
#: Largest lookup table of the n-gram indexer; beyond it, sorting is used.
TABLE = 1 << 24
PRIOR_CHARS = 200


def _dense(values: np.ndarray, size: int):
    """(distinct values ascending, index of each value in them, counts)."""
    if size <= TABLE:
        n = np.bincount(values, minlength=1)
        ids = np.flatnonzero(n)
        lut = np.zeros(len(n), dtype=np.int32)
        lut[ids] = np.arange(len(ids), dtype=np.int32)
        return ids, lut[values], n[ids]
    ids, inverse, n = np.unique(values, return_inverse=True, return_counts=True)
    return ids, inverse, n


def grams(pieces: list[bytes]):
    """4-grams of UTF-8 ``pieces``, none across pieces: (distinct codes, index
    of the code at each place, counts, places of each piece). A code holds four
    16-bit symbols."""
    # utf-32 through one decode of the whole: pieces keep their lengths in characters
    texts = [p.decode("utf-8", "replace") for p in pieces]
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    x = np.minimum(np.frombuffer("".join(texts).encode("utf-32-le", "replace"), dtype=np.uint32), 0xFFFF).astype(np.int64)
    if len(x) < ORDER:
        e = np.array([], dtype=np.int64)
        return e, e, e, np.maximum(sizes - ORDER + 1, 0)
    ids, ch, _ = _dense(x, 1 << 16)
    a = len(ids)
    two, b, _ = _dense(ch[:-1].astype(np.int64) * a + ch[1:], a * a)
    valid = np.ones(len(x) - ORDER + 1, dtype=bool)
    ends = np.cumsum(sizes)
    for back in range(1, ORDER):
        at = ends - back
        valid[at[(at >= 0) & (at < len(valid))]] = False
    q, inv, n = _dense((b[:-2].astype(np.int64) * len(two) + b[2:])[valid], len(two) ** 2)
    hi, lo = two[q // len(two)], two[q % len(two)]
    code = ids[hi // a].astype(np.uint64)
    for c in (ids[hi % a], ids[lo // a], ids[lo % a]):
        code = (code << np.uint64(16)) | c.astype(np.uint64)
    return code.view(np.int64), inv, n, np.maximum(sizes - ORDER + 1, 0)


def pieces_of(text: str | None, chars: int | None = None):
    """The marked text in pieces of ``chars`` n-grams at most, overlapping so
    that each n-gram is in one piece. Only one piece is held at a time."""
    text = text or ""
    chars = chars or min(BLOCK_CHARS, SHARD_CHARS)
    before = ORDER - 1
    for k in range(0, len(text) + 1, chars):  # n-gram i ends at symbol i of text + END
        piece = START * max(0, before - k) + text[max(0, k - before):k + chars]
        yield (piece + END if k + chars > len(text) else piece).encode("utf-8", "replace")


def blocks(pieces, size: int | None = None):
    """``pieces`` in lists of about ``size`` bytes, never an empty list."""
    size, held, n = size or BLOCK_CHARS, [], 0
    for p in pieces:
        held.append(p)
        n += len(p)
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


def count_grams(texts: DataFrame) -> DataFrame:
    """(gram, n) over the column ``text``. Each block's counts leave the task
    before the next block is read."""

    def run(batches):
        for b in batches:
            for held in blocks(p for t in b.column("text") for p in pieces_of(t.as_py())):
                code, _, n, _ = grams(held)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n.astype(np.int64))], names=["gram", "n"])

    return texts.select("text").mapInArrow(lean(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def _suffix(k: int):
    """The last k symbols of ``gram``."""
    return F.expr(f"gram & {(1 << (16 * k)) - 1}L")


def train(spark: SparkSession, trusted: DataFrame) -> list[DataFrame]:
    """Tables of orders 1 to 4: (gram, seen, ctx) with the discounted
    probability ``seen`` and, in the second of each pair, (ctx, back) the
    back-off weight of a context."""
    counts = materialize(spark, count_grams(trusted), "kn_counts")
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct symbols before
        levels[k] = materialize(spark, levels[k + 1].groupBy(_suffix(k).alias("gram")).agg(F.count("*").alias("n")),
                                f"kn_counts{k}")
    out = []
    for k in range(1, ORDER + 1):
        c = levels[k]
        m = c.agg(*[F.coalesce(F.sum((F.col("n") == i).cast("long")), F.lit(0)) for i in (1, 2, 3, 4)]).first()
        d = discounts(*m)
        D = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        ctx = F.expr("shiftrightunsigned(gram, 16)")
        total = materialize(spark, c.groupBy(ctx.alias("ctx")).agg(F.sum("n").alias("total"), F.sum(D).alias("freed")),
                            f"kn_contexts{k}")
        seen = (c.withColumn("ctx", ctx).join(total, "ctx")
                .select("gram", ((F.col("n") - D) / F.col("total")).alias("seen")))
        back = total.select("ctx", (F.col("freed") / F.col("total")).alias("back"))
        out.append((seen, back))
    return out


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """The three modified Kneser-Ney discounts, kept within their counts."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(v, 0.05), i - 0.05) for i, v in enumerate(raw, 1))


def log_probs(model, asked: DataFrame, symbols: int) -> DataFrame:
    """(gram, logp) of the distinct ``asked`` 4-grams. Each order reads written
    tables and writes one: the driver never plans or runs the joins of several
    orders at once."""
    spark = asked.sparkSession
    wanted = {ORDER: materialize(spark, asked.select("gram"), "kn_asked")}
    for k in range(ORDER - 1, 0, -1):
        wanted[k] = materialize(spark, wanted[k + 1].select(_suffix(k).alias("gram")).distinct(), f"kn_asked{k}")
    lower = None
    for k in range(1, ORDER + 1):
        seen, back = model[k - 1]
        grams_k = wanted[k].withColumn("ctx", F.expr("shiftrightunsigned(gram, 16)"))
        p = grams_k.join(seen, "gram", "left").join(back, "ctx", "left")
        if lower is None:
            rest = F.lit(1.0 / (symbols + 1))
        else:
            p = p.withColumn("low", _suffix(k - 1)).join(lower, "low")
            rest = F.col("p_low")
        prob = F.coalesce("seen", F.lit(0.0)) + F.coalesce("back", F.lit(1.0)) * rest
        lower = p.select(F.col("gram").alias("low"), prob.alias("p_low"))
        if k < ORDER:
            lower = materialize(spark, lower, f"kn_lower{k}")
    return lower.select(F.col("low").alias("gram"), F.log("p_low").cast("float").alias("logp"))


def pack(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, str]:
    """A table of shards of documents and its name, bucketed by shard: seq, doc_id, rk, lang (arrays
    over pieces), bytes of each piece, text (compressed), grams (distinct)."""

    def run(batches):
        for b in batches:
            cols = {c: b.column(c) for c in ("seq", "doc_id", "rk", "lang")}

            def shard(held):
                """Of (row, number of the piece, bytes)."""
                rows = pa.array([i for i, _, _ in held])
                out = {c: [v.take(rows).to_pylist()] for c, v in cols.items()}
                pieces = [p for _, _, p in held]
                out |= {"shard": [f"{out['seq'][0][0]}-{held[0][1]}"], "size": [[len(p) for p in pieces]],
                        "text": [zstandard.compress(b"".join(pieces), 3)], "grams": [distinct_grams(pieces)]}
                return pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

            held, size = [], 0
            for i, t in enumerate(b.column("text")):
                for k, p in enumerate(pieces_of(t.as_py())):
                    if held and size + len(p) > SHARD_CHARS:
                        yield shard(held)
                        held, size = [], 0
                    held.append((i, k, p))
                    size += len(p)
            if held:
                yield shard(held)

    ints, strs = pa.list_(pa.int64()), pa.list_(pa.string())
    schema = pa.schema([("shard", pa.string()), ("seq", ints), ("doc_id", ints), ("rk", strs), ("lang", strs),
                        ("size", ints), ("text", pa.binary()), ("grams", ints)])
    rows = docs.select(F.monotonically_increasing_id().alias("seq"), F.col("doc_id").cast("long"),
                       row_key().alias("rk"), F.col("lang").cast("string"), F.col("text").cast("string"))
    packed = rows.mapInArrow(lean(run), "shard string, seq array<long>, doc_id array<long>, rk array<string>, "
                                  "lang array<string>, size array<long>, text binary, grams array<long>")
    chars = docs.agg(F.sum(F.length(F.col("text").cast("string")))).first()[0] or 0
    name = f"tallyfs_kn_{uuid.uuid4().hex[:12]}"
    packed.write.bucketBy(int(min(2000, max(2, chars // SHARD_CHARS))), "shard") \
        .option("path", scratch_path(spark, "kn_shards")).format("parquet").saveAsTable(name)
    return spark.table(name), name


def distinct_grams(pieces: list[bytes]) -> np.ndarray:
    """The distinct codes of ``pieces``, block by block."""
    out = np.array([], dtype=np.int64)
    for held in blocks(pieces):
        out = np.union1d(out, grams(held)[0])
    return out


def _score(packed: pa.Table, probs: pa.Table) -> pa.Table:
    """Log-probability and events of each piece of one shard."""
    names = ["seq", "doc_id", "rk", "lang", "logp", "n"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64()]
    out = []
    for r in packed.to_pylist() if packed.num_rows else []:
        ends = np.cumsum(r["size"])
        data = zstandard.decompress(r["text"])
        known, lp = probs.column("gram").to_numpy(), probs.column("logp").to_numpy()
        order = np.argsort(known)
        known, lp = known[order], lp[order].astype(np.float64)
        sums, events = [], []
        for held in blocks(data[e - s:e] for e, s in zip(ends.tolist(), r["size"])):
            code, inv, _, places = grams(held)
            at = np.minimum(np.searchsorted(known, code), max(len(known) - 1, 0))
            if not np.array_equal(known[at], code):
                raise RuntimeError("a shard lacks n-grams that it asked for")
            steps = np.concatenate(([0.0], np.cumsum(lp[at][inv])))
            stop = np.cumsum(places)
            sums.append(steps[stop] - steps[stop - places])
            events.append(places)
        out.append([r["seq"], r["doc_id"], r["rk"], r["lang"], np.concatenate(sums), np.concatenate(events)])
    release_memory()
    cols = [pa.array(np.concatenate([o[k] for o in out]) if k > 3 else [v for o in out for v in o[k]], t) if out
            else pa.array([], t) for k, t in enumerate(types)]
    return pa.table(cols, names=names)


def perplexities(spark: SparkSession, docs: DataFrame, trusted_ids: DataFrame) -> DataFrame:
    """(doc_id, rk, lang, trusted, logp, n_chars): one row per document, logp
    summed over its n_chars events. ``trusted_ids`` (doc_id) names the rows to
    train on."""
    prepare(spark)
    trusted_ids = materialize(spark, trusted_ids.select(F.col("doc_id").cast("long").alias("doc_id"))
                              .filter("doc_id is not null").distinct(), "kn_trusted")
    marks, _ = bounded_broadcast(trusted_ids, BROADCAST_ROWS)
    base = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    model = train(spark, base.join(marks, "doc_id", "left_semi"))
    symbols = model[0][0].count()
    packed, name = pack(spark, base)
    try:
        asked = spark.table(name).select(F.col("shard").alias("asker"), F.explode("grams").alias("gram"))
        probs = materialize(spark, log_probs(model, asked.select("gram").distinct(), symbols), "kn_probs")
        parts = (packed.drop("grams").groupBy("shard")
                 .cogroup(asked.join(probs, "gram").groupBy("asker"))
                 .applyInArrow(_score, "seq long, doc_id long, rk string, lang string, logp double, n long"))
        whole = parts.groupBy("seq", "doc_id", "rk", "lang").agg(F.sum("logp").alias("logp"), F.sum("n").alias("n_chars"))
        return materialize(spark, whole.join(marks.withColumn("trusted", F.lit(True)), "doc_id", "left")
                           .withColumn("trusted", F.coalesce("trusted", F.lit(False))).drop("seq"), "kn_scored")
    finally:  # the files lie below the checkpoint folder, only the name goes
        spark.sql(f"drop table {name}")


def quality(spark: SparkSession, docs: DataFrame, trusted_ids: DataFrame, tail: float = 0.05, reach: float = 4.0,
            pooled_rows: int = 20, folds: int = 5) -> DataFrame:
    """One row per document: doc_id, rk, lang, trusted, perplexity (per
    character), score (shrunk mean log-probability), lo and hi (the accepted
    range), kept.

    One trusted row in ``folds`` (by a hash of its id) is left out of the counts
    and serves to set the ranges. A language's range reaches from the median of
    its left-out scores ``reach`` times as far as their quantiles ``tail`` and
    1 - ``tail``; these two distances are means of the language's own and of all
    languages' together, the latter weighing as ``pooled_rows`` rows. Its upper
    end is that of the counted rows if theirs is higher.
    """
    ids = materialize(spark, trusted_ids.select(F.col("doc_id").cast("long").alias("doc_id"))
                      .filter("doc_id is not null").distinct(), "kn_ids")
    left_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == 0
    scored = perplexities(spark, docs, ids.filter(~left_out))
    held, _ = bounded_broadcast(ids.filter(left_out).withColumn("held", F.lit(True)), BROADCAST_ROWS)
    scored = (scored.join(held, "doc_id", "left").withColumn("held", F.coalesce("held", F.lit(False)))
              .withColumn("l", F.coalesce("lang", F.lit(""))))
    mean = F.sum("logp") / F.sum("n_chars")
    all_mean = scored.filter("held").agg(mean).first()[0] or 0.0
    by_lang, _ = bounded_broadcast(materialize(spark, scored.filter("held").groupBy("l").agg(mean.alias("m")), "kn_means"),
                                   BROADCAST_ROWS)
    placed = (scored.join(by_lang, "l", "left").withColumn("m", F.coalesce("m", F.lit(all_mean)))
              .withColumn("score", (F.col("logp") + PRIOR_CHARS * F.col("m")) / (F.col("n_chars") + PRIOR_CHARS)))
    q = F.percentile_approx("score", F.array(F.lit(tail), F.lit(0.5), F.lit(1 - tail)), F.lit(10000))

    def spread(rows: DataFrame, prefix: str) -> tuple[DataFrame, float, float]:
        """Quantiles and rows per language; of all, how far the quantiles are
        from the language's median."""
        own = rows.groupBy("l").agg(q.alias(f"{prefix}_q"), F.count("*").alias(f"{prefix}_n"))
        own, _ = bounded_broadcast(materialize(spark, own, "kn_quantiles"), BROADCAST_ROWS)
        gap = F.percentile_approx(F.col("score") - F.col(f"{prefix}_q")[1], F.array(F.lit(tail), F.lit(1 - tail)), F.lit(10000))
        below, above = rows.join(own, "l").agg(gap).first()[0] or (0.0, 0.0)
        return own, -below, above

    def end(prefix: str, k: int, pooled: float) -> str:
        """One end of the range: ``reach`` times the way to quantile k."""
        sign, (near, far) = ("-", ("q[1]", "q[0]")) if k == 0 else ("+", ("q[2]", "q[1]"))
        return (f"{prefix}_q[1] {sign} {reach} * ({prefix}_n * ({prefix}_{near} - {prefix}_{far}) + {pooled_rows} * {pooled!r}D) "
                f"/ ({prefix}_n + {pooled_rows})")

    left, below, above = spread(placed.filter("held"), "left")
    # Counted text, and copies of it, scores best; it is not too good to be kept.
    counted, _, best = spread(placed.filter("trusted"), "counted")
    within = F.coalesce((F.col("score") >= F.col("lo")) & (F.col("score") <= F.col("hi")), F.lit(True))
    return (placed.join(left, "l", "left").join(counted, "l", "left")
            .withColumn("lo", F.expr(end("left", 0, below)))
            .withColumn("hi", F.expr(f"if(left_n is null, null, greatest({end('left', 2, above)}, {end('counted', 2, best)}))"))
            .select("doc_id", "rk", "lang", (F.col("trusted") | F.col("held")).alias("trusted"),
                    F.exp(-F.col("logp") / F.col("n_chars")).alias("perplexity"), "score", "lo", "hi", within.alias("kept")))
