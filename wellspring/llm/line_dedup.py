"""Line dedup: winnowing over line hashes.

Lines are logical: a line of ``LINE`` words starts at every word, because a passage pasted into other text shares no line
break with its source.  A run of at least ``min_words`` words that also stands earlier (documents in order of doc_id, nulls
last, then text hash; inside a document by position) is deleted; what stands first stays.

1. Of the line hashes in every window of ``min_words`` words the least is a fingerprint.  Equal windows pick equal
   fingerprints, so a repeated run of that length shares one, guaranteed; windows that overlap mostly share theirs.
2. Fingerprints are counted (pre-aggregated); those that occur once go.  Positions are joined to the first of their kind.
3. Matches grow from fingerprint to fingerprint: where the words up to the next fingerprint hash alike in both documents,
   the two are one run.  One row stands for a run, whatever its length.
4. Runs are extended both ways, word by word, beyond their outer fingerprints: the first holder sends only the words around
   its edges that some run asked for.  What then has ``min_words`` words is deleted.
5. Whole physical lines of ``min_line`` words or more, and whole documents, are told by one hash each: later equal ones go.

A fingerprint is compared with its first holder, never pair by pair, so a hot line costs its own rows only.  What goes
always stands earlier in ``min_words`` words or more; a run stays only if each of its fingerprints is held first by a
document that shares less than that around it.  Words are compared by 64-bit hashes, at the outer edges of runs by 32 bits.

Defined cases: words are those of ``wordstream``: blanks of any kind and number between them do not count, characters of
scripts without blanks are words.  Null text counts as empty and stays as it is; texts without a repeated run stay byte
for byte; a line that loses all its words goes with its line break, kept words keep the blanks between them; rows equal in
doc_id and text are one document and get the same result; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed, materialize, release, small_batches
from .wordstream import Words, mix, span_hash

MIN_WORDS = 25
MIN_LINE = 4  # words of a whole line that is deleted by itself
LINE = 8  # words of a logical line
_LINE, _TEXT = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)  # keep hashes of lines and of texts apart
_EXACT = np.iinfo(np.int32).min


def grain(min_words: int) -> tuple[int, int]:
    """(words of a logical line, lines in a window)."""
    line = max(1, min(LINE, min_words // 3))
    return line, min_words - line + 1


def _least(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every size neighbours."""
    step = 1
    while 2 * step <= size:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (size - step)], x[size - step :]) if step < size else x


def winnow(words: np.ndarray, starts: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the fingerprints of texts laid end to end; starts: first word of each, and the end."""
    line, window = grain(min_words)
    n = len(words)
    if n < min_words:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(n - line + 1)
    h = span_hash(words, at, at + line)
    bits = n.bit_length()  # the position breaks ties: the leftmost wins
    least = _least((h >> np.uint64(bits) << np.uint64(bits)) | at.astype(np.uint64), window)
    inside = np.arange(len(least)) + min_words <= np.repeat(starts[1:], np.diff(starts))[: len(least)]
    chosen = np.zeros(n, bool)
    chosen[(least[inside] & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
    at = np.flatnonzero(chosen)
    return at, h[at]


def _rows(batch: pa.RecordBatch, own: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """d and k of the texts own, and more columns."""
    take = pa.array(own)
    return pa.RecordBatch.from_arrays([batch.column("d").take(take), batch.column("k").take(take), *map(pa.array, columns.values())], ["d", "k", *columns])


def _positions(min_words: int, min_line: int | None):
    """Of each text: its fingerprints (n = 0, g: hash of the words up to the end of the next one, 0 for none), its whole
    lines (n: words) and the text as a whole (the same with p = -1)."""
    line = grain(min_words)[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = Words(batch.column("text"))
            at, h = winnow(w.hash, w.starts, min_words)
            own = w.text[at]
            g = np.zeros(len(at), np.int64)
            next_ = np.flatnonzero(own[:-1] == own[1:])
            g[next_] = (span_hash(w.hash, at[next_], at[next_ + 1] + line) | np.uint64(1)).view(np.int64)
            first, end = w.lines() if min_line is not None else (at[:0], at[:0])
            long = end - first >= (min_line or 1)
            full = np.flatnonzero(w.sizes >= min_words)
            lines = int(long.sum())
            first, end = np.concatenate([first[long], w.starts[full]]), np.concatenate([end[long], w.starts[full + 1]])
            whole = mix(span_hash(w.hash, first, end) ^ np.repeat([_LINE, _TEXT], [lines, len(full)]))
            own = np.concatenate([own, w.text[first]])
            p = np.concatenate([at, first]) - w.starts[own]
            p[len(at) + lines :] = -1
            yield _rows(
                batch,
                own,
                h=np.concatenate([h, whole]).view(np.int64),
                p=p.astype(np.int32),
                n=np.concatenate([np.zeros(len(at), np.int32), (end - first).astype(np.int32)]),
                g=np.concatenate([g, np.zeros(len(first), np.int64)]).astype(np.int32),
            )

    return run


def _chains(line: int):
    """Rows (d, k, p, n, same, d0, k0, p0) sorted by (d, k, p, n) to runs (d, k, i, j, d0, k0, z): the words i to j (end
    exclusive) stand z words further on in the first holder; z is _EXACT where the run needs no extension."""

    def link(x: dict[str, np.ndarray]) -> pa.RecordBatch:
        doc = (np.diff(x["d"], prepend=x["d"][:1]) != 0) | (np.diff(x["k"], prepend=x["k"][:1]) != 0)
        again = ~doc & (np.diff(x["p"], prepend=-2) == 0) & (np.diff(x["n"], prepend=-1) == 0)
        copied = (x["p"] == -1)[np.maximum.accumulate(np.where(doc, np.arange(len(doc)), 0))]  # a text that is a whole copy
        drop = again | copied & (x["p"] != -1)
        x = {c: v[~drop] for c, v in x.items()}
        whole = x["n"] > 0
        at = np.maximum(x["p"][whole], 0)
        out = [(x["d"][whole], x["k"][whole], at, at + x["n"][whole], x["d0"][whole], x["k0"][whole], np.full(whole.sum(), _EXACT))]
        x = {c: v[~whole] for c, v in x.items()}
        if len(x["p"]):
            z = x["p0"] - x["p"]
            head = np.ones(len(z), bool)
            head[1:] = ~x["same"][:-1]
            for v in (x["d"], x["k"], x["d0"], x["k0"], z):
                head[1:] |= v[1:] != v[:-1]
            i = np.flatnonzero(head)
            last = np.append(i[1:], len(z)) - 1
            out.append((x["d"][i], x["k"][i], x["p"][i], x["p"][last] + line, x["d0"][i], x["k0"][i], z[i]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v).astype(np.int64 if c < 2 or 3 < c < 6 else np.int32)) for c, v in enumerate(zip(*out))], ["d", "k", "i", "j", "d0", "k0", "z"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] | None = None
        for batch in batches:
            x = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            if kept is not None:
                x = {c: np.concatenate([kept[c], v]) for c, v in x.items()}
            if not len(x["d"]):
                continue
            open_ = int(np.argmax((x["d"] == x["d"][-1]) & (x["k"] == x["k"][-1])))  # the last document may go on
            kept = {c: v[open_:].copy() for c, v in x.items()}
            if open_:
                yield link({c: v[:open_] for c, v in x.items()})
        if kept is not None:
            yield link(kept)

    return run


def _around(reach: int):
    """The words that edges ask for, as 32-bit hashes, 0 for none: edge 2 * i those before word i, from the nearest on;
    edge 2 * j + 1 those from word j on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = Words(batch.column("text"))
            short = np.append(w.hash.astype(np.uint32) | np.uint32(1), np.uint32(0))
            asked = batch.column("edges")
            edge = np.array(asked.flatten(), np.int64)
            own = np.repeat(np.arange(batch.num_rows), np.asarray(asked.value_lengths().fill_null(0), np.int64))
            at, lo, hi = (edge >> 1) + w.starts[own], w.starts[own], w.starts[own + 1]
            on = np.arange(reach)[None, :]
            at = np.where((edge & 1)[:, None] == 1, at[:, None] + on, at[:, None] - 1 - on)
            at[(at < lo[:, None]) | (at >= hi[:, None])] = -1
            data = np.ascontiguousarray(short[at])
            offsets = np.arange(len(edge) + 1, dtype=np.int32) * (4 * reach)
            got = _rows(batch, own, edge=edge)
            yield pa.RecordBatch.from_arrays([*got.columns, pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(offsets), pa.py_buffer(data)])], ["d0", "k0", "edge", "c"])

    return run


def repeated_runs(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, min_line: int | None = None) -> DataFrame:
    """(d, k, runs): for each document with something to delete its runs (i, j, left, right): words i to j, and the words
    of the first holder before and after, or nulls where the run is as it is."""
    small_batches(spark)
    line, window = grain(min_words)
    source = keyed(docs).select("d", "k", "text")
    every = materialize(spark, source.mapInArrow(_positions(min_words, min_line), "d long, k long, h long, p int, n int, g int"))
    twice = materialize(spark, every.groupBy("h").agg(F.count("*").alias("c"), F.min("d").alias("m")).where("c > 1").drop("c"))
    shared = materialize(spark, every.join(twice, "h"))
    release(spark, every, twice)
    first = shared.where("d = m").groupBy("h").agg(F.min("d").alias("d0"), F.min(F.struct("k", "p", "g")).alias("f"))
    # Written, so that the join deals out both sides anew and can split a hot fingerprint.
    first = materialize(spark, first.select("h", "d0", F.col("f.k").alias("k0"), F.col("f.p").alias("p0"), F.col("f.g").alias("g0")))
    later = shared.join(first, "h").where("d <> d0 or k <> k0 or p <> p0")
    later = later.select("d", "k", "p", "n", (F.col("g") == F.col("g0")).alias("same"), "d0", "k0", "p0")
    later = later.withColumn("same", F.col("same") & (F.col("n") == 0)).repartition("d", "k").sortWithinPartitions("d", "k", "p", "n")
    runs = materialize(spark, later.mapInArrow(_chains(line), "d long, k long, i int, j int, d0 long, k0 long, z int"))
    release(spark, shared, first)
    grown = runs.where(F.col("z") != _EXACT)
    edges = grown.select("d", "k", "i", "j", "d0", "k0", F.explode(F.array((F.col("i") + F.col("z")).cast("long") * 2, (F.col("j") + F.col("z")).cast("long") * 2 + 1)).alias("edge"))
    asked = edges.select(F.col("d0").alias("d"), F.col("k0").alias("k"), "edge").distinct().groupBy("d", "k").agg(F.collect_list("edge").alias("edges"))
    around = source.join(asked, ["d", "k"]).mapInArrow(_around(window - 1), "d0 long, k0 long, edge long, c binary")
    around = materialize(spark, around.dropDuplicates(["d0", "k0", "edge"]))  # rows that repeat
    known = edges.join(around, ["d0", "k0", "edge"]).select("d", "k", "i", "j", (F.col("edge") % 2).cast("int").alias("side"), "c")
    exact = runs.where(F.col("z") == _EXACT).select("d", "k", "i", "j", F.lit(2).alias("side"), F.lit(None).cast("binary").alias("c"))
    out = materialize(spark, known.union(exact).groupBy("d", "k").agg(F.collect_list(F.struct("i", "j", "side", "c")).alias("runs")))
    release(spark, runs, around)
    return out


def extend(w: Words, runs: pa.ListArray, min_words: int) -> np.ndarray:
    """Which words of all texts go, given the runs of each (null: none)."""
    own = np.repeat(np.arange(len(runs)), np.asarray(runs.value_lengths().fill_null(0), np.int64))
    flat = runs.flatten()
    i, j, side = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("i", "j", "side"))
    lo, hi = w.starts[own], w.starts[own + 1]
    i, j = i + lo, j + lo
    cover = np.zeros(len(w.hash) + 1, np.int64)
    whole = side == 2
    np.add.at(cover, i[whole], 1)
    np.add.at(cover, j[whole], -1)
    grown = np.flatnonzero(~whole)
    if len(grown):
        grown = grown[np.lexsort((side[grown], i[grown]))]  # a word starts one run at most: its two edges stand together
        i, j, side, lo, hi = (x[grown] for x in (i, j, side, lo, hi))
        c = flat.field("c").take(pa.array(grown))
        reach = len(c[0].as_py()) // 4
        there = np.frombuffer(c.buffers()[2], np.uint32).reshape(-1, reach)[: len(grown)] if c.offset == 0 else np.frombuffer(b"".join(c.to_pylist()), np.uint32).reshape(-1, reach)
        on = np.arange(reach)[None, :]
        at = np.where(side[:, None] == 1, j[:, None] + on, i[:, None] - 1 - on)
        out = (at < lo[:, None]) | (at >= hi[:, None])
        here = np.append(w.hash.astype(np.uint32) | np.uint32(1), np.uint32(0))[np.where(out, -1, at)]
        far = np.argmin(np.concatenate([(here == there) & ~out, np.zeros((len(grown), 1), bool)], axis=1), axis=1)
        i, j = i[::2] - far[::2], j[::2] + far[1::2]
        enough = j - i >= min_words
        np.add.at(cover, i[enough], 1)
        np.add.at(cover, j[enough], -1)
    return np.cumsum(cover[:-1]) > 0


def delete(raw: bytes, first: np.ndarray, end: np.ndarray, gone: np.ndarray) -> bytes:
    """The text without some of its words; a line that loses all its words goes with its line break."""
    out, lo = [], 0
    at = 0
    for line in raw.split(b"\n"):
        hi = lo + len(line)
        upto = int(np.searchsorted(first, hi))
        lost = gone[at:upto]
        if not lost.any():
            out.append(line)
        elif not lost.all():
            kept = np.flatnonzero(~lost) + at
            cut = np.flatnonzero(np.diff(kept) > 1)
            a, b = kept[np.append(0, cut + 1)], kept[np.append(cut, len(kept) - 1)]
            begin, stop = first[a].tolist(), end[b].tolist()
            if not lost[0]:
                begin[0] = lo
            if not lost[-1]:
                stop[-1] = hi
            out.append(b" ".join([raw[x:y] for x, y in zip(begin, stop)]))
        at, lo = upto, hi + 1
    return b"\n".join(out)


def _shorten(min_words: int):
    def run(text: pa.Array, runs: pa.Array) -> pa.Array:
        """The text without its runs, and how many words went; nulls where there are none."""
        w = Words(text.fill_null(""))
        gone = extend(w, runs, min_words)
        n = np.bincount(w.text[gone], minlength=len(text))
        out: list[bytes | None] = [None] * len(text)
        for x in np.flatnonzero(n).tolist():
            a, b = w.offsets[x], w.offsets[x + 1]
            own = slice(w.starts[x], w.starts[x + 1])
            out[x] = delete(w.raw[a:b].tobytes(), w.first[own] - a, w.end[own] - a, gone[own])
        return pa.StructArray.from_arrays([pa.array(out, pa.binary()).cast(pa.string()), pa.array(n.astype(np.int32))], ["text", "n_deleted"])

    return run


def line_dedup(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, min_line: int | None = None) -> DataFrame:
    """(row, text, n_deleted): every row of docs as a struct, its text without later repeated runs and, with min_line,
    without later equal lines of so many words, and how many words went."""
    runs = repeated_runs(spark, docs, min_words, min_line)
    rewrite = F.arrow_udf(_shorten(min_words), "text string, n_deleted int")
    got = keyed(docs).join(runs, ["d", "k"], "left")
    got = got.select("row", "text", rewrite(F.when(F.col("runs").isNotNull(), F.col("text")), "runs").alias("x"))  # other texts stay in the JVM
    return got.select("row", F.coalesce("x.text", "text").alias("text"), F.col("x.n_deleted").alias("n_deleted"))


def dedup_documents(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS, min_line: int | None = MIN_LINE) -> DataFrame:
    """docs with its own columns; text is rewritten where a run or line went, and n_chars follows it."""
    out = line_dedup(spark, docs, min_words, min_line)
    new = {"text": F.when(F.col("n_deleted") > 0, F.col("text")).otherwise(F.col("row.text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_deleted") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words deleted, and the length and digest of what stays."""
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(spark, docs, min_line=MIN_LINE).select(F.col("row.doc_id").alias("doc_id"), "n_deleted", F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("kept_sha256"))
