"""PII: base patterns, and bootstrapped contextual extraction.

Seed entities are what the base patterns find, and long hexadecimal keys.  The two words before a mention are its lexical
pattern.  Spark scores the graph of patterns and instances in rounds.  In each, the instances that are good so far induce
patterns: those with ``MIN_SEEDS`` distinct good ones.  A pattern is as good as the share of all places where it stands,
over all documents, that hold good instances; an instance is as good as its best pattern, and a seed always counts as good.
So instances found in one round induce patterns in the next, until nothing changes or ``ROUNDS`` are over.  What stands at
a high-confidence pattern and looks like an identifier (``MIN_LENGTH`` characters or more with a digit, bare of quotes and
punctuation) is added as kind ``id``.

Every pattern with enough instances, good or not, is scored, and every one of high confidence is applied: patterns stay a
table that is joined, however many there are.  What the driver and the workers hold is a filter of 2 ** ``FILTER_BITS``
bits over the patterns' checksums; it only spares pairs of words that cannot be patterns the shuffle, and the joins are
exact.  Places are counted over all words of all documents.

Spans are half-open in code points.  Base spans always stay; an added span that would overlap one is not added.  Defined
cases: null and empty texts have no spans and the digest of nothing; rows that repeat get a row each; with too few seeds
no pattern is induced and only base spans are found.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_key, materialize, release, small_batches, table, texts

KINDS = ("email", "ip", "card", "phone", "id")
FILTER_BITS = 22
MIN_SEEDS = 5  # distinct seeds that induce a pattern
CONFIDENCE = 0.8
ROUNDS = 8
MIN_LENGTH = 6
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MENTION = re.compile(r"\S*[0-9]\S*")
_HEX = re.compile(r"[0-9a-fA-F]{32,128}")
_EDGES = "\"'`“”‘’«»()[]{}<>.,;:!?#*$%&|="
_JUNK = "#*$%&|<>!"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping; looked for from each @, so that long runs without one cost nothing."""
    out, pos, at = [], 0, text.find("@")
    while at >= 0:
        if at >= pos:
            s = at
            while s > pos and text[s - 1] in _LOCAL:
                s -= 1
            m = _DOMAIN.match(text, at + 1) if s < at else None
            if m:
                out.append((s, m.end()))
                pos = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                d = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out)


def plain(text: str) -> str:
    """Lower case without the symbols that decorate words."""
    text = text.lower()
    for c in _JUNK:
        if c in text:
            text = text.replace(c, "")
    return text


def pattern_before(text: str, at: int) -> str | None:
    """The two words before a mention, however long."""
    reach = 64
    while True:
        before = plain(text[max(0, at - reach) : at]).replace('"', " ").split()
        if len(before) > 2 or reach >= at:  # the first word may be cut unless the text starts there
            return f"{before[-2]} {before[-1]}" if len(before) >= 2 else None
        reach *= 4


def mentions(text: str) -> list[tuple[int, int]]:
    """Where something that may be an identifier stands."""
    out = []
    if _DIGIT.search(text):
        for m in _MENTION.finditer(text):
            word = m[0]
            s = m.start() + len(word) - len(word.lstrip(_EDGES))
            e = m.start() + len(word.rstrip(_EDGES))
            if e - s >= MIN_LENGTH:
                out.append((s, e))
    return out


def candidates(text: str, own: list[tuple[int, int, int]], bits: bytes) -> list[tuple[int, int, str]]:
    """(start, end, pattern) of the mentions apart from the base spans whose pattern passes the filter."""
    out = []
    for s, e in mentions(text) if bits else ():
        if not any(a < e and s < b for a, _, b in own) and (p := pattern_before(text, s)) and passes(bits, p):
            out.append((s, e, p))
    return out


def passes(bits: bytes, p: str) -> bool:
    """Whether a pattern may be among those of the filter."""
    h = zlib.crc32(p.encode("utf-8", "surrogatepass")) & ((1 << FILTER_BITS) - 1)
    return bool(bits[h >> 3] >> (h & 7) & 1)


def pattern_filter(patterns: DataFrame) -> bytes:
    """The filter over the column p, of a fixed size; empty without patterns."""
    h = F.crc32("p").bitwiseAND(F.lit((1 << FILTER_BITS) - 1))
    rows = patterns.select(h.alias("h")).groupBy(F.expr("h div 64").alias("i")).agg(F.expr("bit_or(shiftleft(1L, cast(h % 64 as int)))").alias("w")).collect()
    out = np.zeros(1 << (FILTER_BITS - 6), "<i8")
    for r in rows:
        out[r["i"]] = r["w"]
    return out.tobytes() if rows else b""


def _graph(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mentions with their pattern: seeds and candidates."""
    for batch in batches:
        found: Counter = Counter()
        for text in texts(batch.column("text")):
            own = base_spans(text)
            places = {(s, e): 1 for s, _, e in own}
            for s, e in mentions(text):
                if (s, e) not in places and not any(a < e and s < b for a, _, b in own):
                    places[s, e] = int(bool(_HEX.fullmatch(text, s, e)))
            for (s, e), seed in places.items():
                p = pattern_before(text, s)
                if p:
                    found[p, hashlib.md5(text[s:e].lower().encode("utf-8", "surrogatepass")).hexdigest(), seed] += 1
        cols = list(zip(*[(*k, n) for k, n in found.items()])) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int64()))], ["p", "x", "seed", "n"])


def _places(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = model.value
        for batch in batches:
            count: Counter = Counter()
            for text in texts(batch.column("text")):
                words = plain(text).replace('"', " ").split()
                # The last word has no place after it.
                for (a, b), n in Counter(zip(words, words[1:-1])).items():
                    if passes(bits, p := f"{a} {b}"):
                        count[p] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], ["p", "places"])

    return run


def confident(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(p): the patterns of high confidence."""
    small_batches(spark)
    graph = docs.select("text").mapInArrow(_graph, "p string, x string, seed int, n long")
    graph = materialize(spark, graph.groupBy("p", "x").agg(F.max("seed").alias("seed"), F.sum("n").alias("n")))
    known = materialize(spark, graph.groupBy("p").agg(F.count("*").alias("own")).where(F.col("own") >= MIN_SEEDS).select("p"))
    bits = pattern_filter(known)
    if not bits:
        return known
    places = docs.select("text").mapInArrow(_places(spark.sparkContext.broadcast(bits)), "p string, places long").groupBy("p").agg(F.sum("places").alias("places"))
    places = known.join(places, "p", "left")
    # A noted mention may end the text or be cut off from its words, so places can be fewer than mentions.
    own = graph.groupBy("p").agg(F.sum("n").alias("own"))
    places = materialize(spark, places.join(own, "p").select("p", F.greatest("places", "own").alias("places")))
    edges = materialize(spark, graph.join(places, "p"))
    release(spark, graph, known)
    score, patterns, before = edges.withColumn("c", F.col("seed").cast("double")), None, None
    for _ in range(ROUNDS):
        strong = F.sum((F.col("c") >= CONFIDENCE).cast("long"))
        sums = score.groupBy("p").agg(F.sum(F.col("c") * F.col("n")).alias("good"), strong.alias("strong")).where(F.col("strong") >= MIN_SEEDS)
        last, patterns = patterns, materialize(spark, sums.join(places, "p").select("p", (F.col("good") / F.col("places")).alias("score")))
        best = edges.join(patterns, "p").groupBy("x").agg(F.max("score").alias("best"))
        if last is not None:
            release(spark, last, score)
        score = materialize(spark, edges.join(best, "x", "left").select("p", "x", "seed", "n", F.greatest(F.col("seed").cast("double"), F.coalesce("best", F.lit(0.0))).alias("c")))
        now = patterns.agg(F.count("*"), F.sum(F.round("score", 6).cast("decimal(20,6)"))).first()
        if now == before:
            break
        before = now
    release(spark, edges, places, score)
    return patterns.where(F.col("score") >= CONFIDENCE).select("p")


def train(spark: SparkSession, docs: DataFrame) -> frozenset[str]:
    """The patterns of high confidence on the driver, for a look at small tables; find_in_documents joins the table."""
    return frozenset(r["p"] for r in confident(spark, docs).collect())


def _find(model):
    """Counts, digest and base spans of each row, and its candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = model.value
        for batch in batches:
            counts, sha, base, more = [], [], [], []
            for text in texts(batch.column("text")):
                own = base_spans(text)
                n = Counter(k for _, k, _ in own)
                counts.append([n[k] for k in range(4)])
                sha.append(hashlib.sha256(",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in own]).encode()).hexdigest())
                base.append([{"s": s, "k": k, "e": e} for s, k, e in own])
                more.append([{"s": s, "e": e, "p": p} for s, e, p in candidates(text, own, bits)])
            kinds = [pa.array([c[k] for c in counts], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "d", "k")] + kinds + [pa.array(sha, pa.string()), pa.array(base, _BASE), pa.array(more, _MORE)], ["doc_id", "d", "k", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "more"])

    return run


_BASE = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32())]))
_MORE = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("p", pa.string())]))


def find_in_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(doc_id, counts, base_sha256, spans, n_added) of every row of docs."""
    model = confident(spark, docs)
    bits = spark.sparkContext.broadcast(pattern_filter(model))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *doc_key(F.col("doc_id"), F.col("text")), "text")
    rows = materialize(spark, rows.mapInArrow(_find(bits), "doc_id long, d long, k long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<s: int, k: int, e: int>>, more array<struct<s: int, e: int, p: string>>"))
    # Rows that repeat have the same key and the same spans, so the set is that of one of them.
    more = rows.where(F.size("more") > 0).select("d", "k", F.inline("more")).join(model, "p")
    more = more.groupBy("d", "k").agg(F.collect_set(F.struct("s", F.lit(KINDS.index("id")).alias("k"), "e")).alias("added"))
    got = rows.drop("more").join(more, ["d", "k"], "left").withColumn("added", F.coalesce("added", F.array().cast("array<struct<s: int, k: int, e: int>>")))
    kinds = F.array(*map(F.lit, KINDS))
    spans = F.transform(F.array_sort(F.concat("base", "added")), lambda x: F.concat_ws(":", F.get(kinds, x["k"]), x["s"], x["e"]))
    return got.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.array_join(spans, ",").alias("spans"), F.size("added").cast("long").alias("n_added"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_in_documents(spark, table(spark, sf_dir, "documents").select("doc_id", "text"))
