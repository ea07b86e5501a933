"""Quality rules: base counts, and line labelling by a linear-chain conditional random field.

Viterbi decoding marks each line that has a word as content or boilerplate from its look (symbols, bars, capitals,
exclamation marks, repeats, length) and its neighbours.  A document that passes the base rules is kept if at least
``CONTENT_SHARE`` of its words stand in content lines.

The field is trained by gradient ascent on the exact likelihood (forward-backward) over at most ``SAMPLE`` labelled
documents, chosen by a hash of their id.  No line is labelled: lines of documents labelled good count as content, lines
of those labelled bad as boilerplate, and the chain settles the lines that say otherwise.

Defined cases: null and empty texts have no words and fail the base rules; without labelled rows of both kinds every line
is content; lines without a word are not labelled; rows that repeat get a row each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, small_batches, table

SAMPLE = 4_000  # labelled documents that training takes at most
CONTENT_SHARE = 0.5
MIN_WORDS = 50
CHAIN = 64  # lines of one training chain; longer documents make several
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = re.compile(r"[#*$%&|<>]")
FEATURES = ("one", "symbols", "bars", "capitals", "exclamations", "repeats", "digits", "short", "long", "sentence", "again", "word length")


def base(raw: bytes, text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    words = raw.split()  # bytes split at the six ASCII blanks only
    n = len(words)
    if not n:
        return 0, 0, len(_SYMBOLS.findall(text)), 0, 0
    chars = len(text) - sum(map(text.count, _BLANKS))
    symbols = sum(map(text.count, "#*$%&|<>"))
    lines = raw.split(b"\n")
    dup = 0
    if len(lines) > 1:
        full = [x for x in lines if x and x.strip()]
        dup = len(full) - len(set(full))
    repeat = 0
    if n > 3:
        known: dict[bytes, int] = {}
        ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
        if len(known) < n:
            v = len(known)
            two = ids[:-1] * v + ids[1:]
            if v >= 2_000_000:
                two = np.unique(two, return_inverse=True)[1]
            code = two[:-1] * v + ids[2:]
            _, back, count = np.unique(code, return_inverse=True, return_counts=True)
            hit = count[back] > 1
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= hit
            repeat = int(covered.sum())
    return n, chars, symbols, dup, repeat


def look(text: str) -> tuple[list[list[float]], list[int]]:
    """Features and words of each line that has a word."""
    rows, sizes, seen = [], [], set()
    for line in text.split("\n"):
        words = line.split()
        n = len(words)
        if not n:
            continue
        c = len(line)
        letters = sum(map(len, words))
        upper = 0 if line.islower() or not line.upper() != line.lower() else sum(map(str.isupper, words))
        bare = line.rstrip()
        rows.append([
            1.0,
            min(1.0, 2 * sum(map(line.count, "#*$%&<>")) / n),
            min(1.0, 2 * line.count("|") / n),
            upper / n if n > 1 or len(words[0]) > 2 else 0.0,
            min(1.0, line.count("!") / n),
            1 - len(set(words)) / n if n > 20 else 0.0,
            min(1.0, 5 * sum(map(line.count, "0123456789")) / c),
            float(n < 4),
            float(n > 30),
            float(bare[-1] in ".!?\"”»"),
            float(line in seen),
            min(2.0, letters / n / 8),
        ])
        sizes.append(n)
        seen.add(line)
    return rows, sizes


@dataclass
class Crf:
    """Two states: 1 content, 0 boilerplate.  emit scores content against boilerplate."""

    emit: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0]))
    trained: bool = False

    def decode(self, rows: list[list[float]]) -> list[bool]:
        """Viterbi; content at a tie."""
        if not self.trained:
            return [True] * len(rows)
        scores = (np.array(rows) @ self.emit).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        (a, b) = self.start.tolist()
        b += scores[0]
        back: list[tuple[bool, bool]] = []
        for e in scores[1:]:
            f0, f1 = b + m10 >= a + m00, b + m11 >= a + m01
            a, b = (b + m10 if f0 else a + m00), (b + m11 if f1 else a + m01) + e
            back.append((f0, f1))
        state = b >= a
        out = [state]
        for f in reversed(back):
            state = f[state]
            out.append(state)
        return out[::-1]


def fit(chains: list[tuple[np.ndarray, int]], steps: int = 200, rate: float = 0.1, l2: float = 1e-3) -> Crf:
    """chains: features of the lines and the label all of them share."""
    size = max(len(x) for x, _ in chains)
    x = np.zeros((len(chains), size, len(FEATURES)))
    mask = np.zeros((len(chains), size), bool)
    y = np.array([label for _, label in chains])
    for i, (own, _) in enumerate(chains):
        x[i, : len(own)] = own
        mask[i, : len(own)] = True
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))  # both kinds count alike
    params = np.zeros(len(FEATURES) + 6)
    m1, m2 = np.zeros_like(params), np.zeros_like(params)
    length = mask.sum(1)
    for step in range(1, steps + 1):
        emit, move, start = params[: len(FEATURES)], params[len(FEATURES) : -2].reshape(2, 2), params[-2:]
        e = np.stack([np.zeros(mask.shape), x @ emit], -1)
        alpha = np.zeros((*mask.shape, 2))
        alpha[:, 0] = start + e[:, 0]
        for t in range(1, size):
            alpha[:, t] = np.where(mask[:, t, None], np.logaddexp(alpha[:, t - 1, :1] + move[0], alpha[:, t - 1, 1:] + move[1]) + e[:, t], alpha[:, t - 1])
        beta = np.zeros_like(alpha)
        for t in range(size - 2, -1, -1):
            nxt = e[:, t + 1] + beta[:, t + 1]
            got = np.logaddexp(move[:, 0] + nxt[:, :1], move[:, 1] + nxt[:, 1:])
            beta[:, t] = np.where(mask[:, t + 1, None], got, 0)
        z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p1 = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None]) * mask
        grad = np.zeros_like(params)
        grad[: len(FEATURES)] = np.einsum("nt,ntf->f", weight[:, None] * mask * (y[:, None] - p1) / length[:, None], x)
        both = mask[:, 1:]
        for a in (0, 1):
            for b in (0, 1):
                p = np.exp(alpha[:, :-1, a] + move[a, b] + e[:, 1:, b] + beta[:, 1:, b] - z[:, None]) * both
                grad[len(FEATURES) + 2 * a + b] = (weight[:, None] / length[:, None] * (both * ((y == a) & (y == b))[:, None] - p)).sum()
        grad[-1] = (weight / length * (y - p1[:, 0])).sum()
        grad[-2] = -grad[-1]
        grad -= l2 * params
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad * grad
        params = params + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return Crf(params[: len(FEATURES)].copy(), params[len(FEATURES) : -2].reshape(2, 2).copy(), params[-2:].copy(), True)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Crf:
    small_batches(spark)
    known = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # a top-k: bounded on every executor

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [look(t or "")[0] for t in batch.column("text").to_pylist()]
            flat = [[v for row in rows for v in row] for rows in got]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(flat, pa.list_(pa.float32()))], ["doc_id", "quality", "x"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))  # one an id
    rows = rows.mapInArrow(lines, "doc_id long, quality int, x array<float>")
    got = materialize(spark, rows).orderBy("doc_id").toPandas()  # sample rows at most
    chains = []
    for x, q in zip(got["x"], got["quality"]):
        x = np.asarray(x, float).reshape(-1, len(FEATURES))
        chains += [(x[i : i + CHAIN], int(q)) for i in range(0, len(x), CHAIN)]
    if {q for _, q in chains} != {0, 1}:
        return Crf()
    return fit(chains)


def judge(text: str, raw: bytes, model: Crf) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_words)."""
    n, chars, symbols, dup, repeat = base(raw, text)
    failed = n < MIN_WORDS or 100 * repeat > 50 * n
    rows, sizes = look(text)
    content = sum(s for s, c in zip(sizes, model.decode(rows)) if c) if rows else 0
    return n, chars, symbols, dup, repeat, failed, not failed and content >= CONTENT_SHARE * sum(sizes), content


def judge_documents(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, base counts, base_failed, kept, content_words) of every row of docs."""
    model = spark.sparkContext.broadcast(train(spark, docs, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = model.value
        for batch in batches:
            raws = batch.column("text").cast(pa.binary()).to_pylist()
            got = [judge(t or "", r or b"", crf) for t, r in zip(batch.column("text").to_pylist(), raws)]
            cols = list(zip(*got)) if got else [[]] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_words"])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_words long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
