"""BPE encoding and decoding: speculate and verify.

Texts are cut at white space and each distinct chunk is encoded once per worker cache.  Greedy longest match, by one
automaton over all new words laid end to end, proposes tokens.  A sequence of tokens is what the merges give exactly when
every adjacent pair is what the merges give for the two alone; all pairs are tested together, on arrays, by undoing merges
at the seam.  Where a pair fails, the letters of the two are merged exactly, and the new seams are tested in the same way;
a word that still fails after ``ROUNDS`` such repairs is merged exactly as a whole.  So every result has passed the test.

The file must hold a BPE model with an end-of-word suffix, NFC and lower-case normalizers and the word pattern below;
anything else is refused.  Defined cases: null text is empty text; the special strings become their ids wherever they
stand; an empty text has no ids and the digest of nothing.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table, texts

CACHED_CHUNKS = 60_000  # in each of two generations, a bound on memory only: of the older one, what is used again stays
CACHED_PAIRS = 100_000
ROUNDS = 4
ROWS = 1024  # of a batch: each distinct chunk of a batch is looked up once
_END = "\n"  # stands for the suffix in the automaton; no letter of a word
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^\p{{White_Space}}\p{{L}}\p{{N}}]+")
_BLANKS = regex.compile(r"[\p{White_Space}--[\t-\r ]]+", regex.V1)
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones stand for themselves, others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [""] * 256, 0
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return out


class WordBpe:
    """Encoder over one vocabulary file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or kinds != ["NFC", "Replace", "Lowercase"] or split != PATTERN or spec["decoder"]:
            raise ValueError("not a word BPE file of the kind this operator reads")
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): (r, self.vocab[a + b]) for r, (a, b) in enumerate(merges)}
        size = max(self.vocab.values()) + 1
        self.made = np.full(size, -1, np.int64)  # rank of the merge that makes a token; -1: a base symbol
        self.left, self.right = np.arange(size), np.arange(size)
        for (a, b), (r, t) in self.rank.items():
            if self.made[t] < 0:
                self.made[t], self.left[t], self.right[t] = r, a, b
        self.shift = size
        keys = np.array([a * size + b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array([r for r, _ in self.rank.values()], np.int64)[order]
        self.order = {pair: r for pair, (r, _) in self.rank.items()}
        self.result = [t for _, t in self.rank.values()]
        self.none = len(self.result)
        self.greedy = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.length = np.zeros(size, np.int64)  # letters of a token; the suffix counts as one
        for token, i in self.vocab.items():
            spelled = token[:-4] + _END if token.endswith("</w>") and len(token) > 4 else token
            self.greedy.add_word(spelled, i)
            self.length[i] = len(spelled)
        self.greedy.make_automaton()
        self.letters = _byte_letters()
        self.table = "".join(self.letters)  # translates bytes read as Latin-1
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.unstable = {t for t in self.vocab.values() if not self.stable(t)}
        self.joined: dict[int, list[int]] = {}  # what merging gives for the letters of two tokens
        every = range(max(self.names) + 1)
        self.digits = pa.array([str(i) for i in every], pa.large_string())
        self.spellings = pa.array([self.names.get(i, "") for i in every], pa.large_string())
        self.ids_of: dict[str, str] = {}
        self.names_of: dict[str, str] = {}
        self.old_ids: dict[str, str] = {}
        self.old_names: dict[str, str] = {}
        self.merged = self.proposed = 0

    # -- speculate ------------------------------------------------------------------------------------------------
    def propose(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens of all words, tokens of each word, whether they make the word) by greedy longest match."""
        ends = np.cumsum([len(w) + 1 for w in words]) - 1  # of each word's suffix
        got = np.array(list(self.greedy.iter_long(_END.join(words) + _END)), np.int64).reshape(-1, 2)
        owner = np.searchsorted(ends, got[:, 0])
        size = np.bincount(owner, minlength=len(words))
        # A token may swallow the last letter and leave the suffix; such words, or gaps, do not add up.
        letters = np.bincount(owner, self.length[got[:, 1]], len(words)).astype(np.int64)
        return got[:, 1], size, letters == np.diff(ends, prepend=-1)

    # -- verify ---------------------------------------------------------------------------------------------------
    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.shift + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], np.iinfo(np.int64).max)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens: would merging leave the seam between them?

        Merges are undone from the later to the earlier on either side of the seam.  If at some moment the two symbols
        that touch it had a merge due before the next one on their own side, merging would have crossed the seam.
        """
        good = np.ones(len(a), bool)
        alive = np.arange(len(a))
        x, y = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)  # a crossing merge of a lower rank than this breaks the pair
        while len(alive):
            r = self._rank_of(x, y)
            broken = r < limit
            good[alive[broken]] = False
            mx, my = self.made[x], self.made[y]
            stay = ~broken & ((mx >= 0) | (my >= 0))
            # The latest merge goes first.  At the same rank the left one was made first, so the right one goes first;
            # a crossing merge of the very rank of the right token would start further left and so come before it.
            undo_left = mx > my
            limit = np.where(undo_left, mx, my + 1)
            nx, ny = np.where(undo_left, self.right[x], x), np.where(undo_left, y, self.left[y])
            alive, x, y, limit = alive[stay], nx[stay], ny[stay], limit[stay]
        return good

    def merge(self, symbols: list[int]) -> list[int]:
        """Exact merging: lowest rank first, leftmost at a tie."""
        s, get, none = list(symbols), self.order.get, self.none
        ranks = [get(p, none) for p in zip(s, s[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            s[i : i + 2] = [self.result[best]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((s[i - 1], s[i]), none)
            if i < len(ranks):
                ranks[i] = get((s[i], s[i + 1]), none)
        return s

    def base(self, word: str) -> list[int]:
        """Letters of a word; the last one carries the suffix."""
        return [*map(self.vocab.__getitem__, word[:-1]), self.vocab[word[-1] + "</w>"]]

    def letters_of(self, token: int) -> list[int]:
        name = self.names[token]
        return self.base(name[:-4]) if name.endswith("</w>") and len(name) > 4 else [self.vocab[c] for c in name]

    def stable(self, token: int) -> bool:
        """Do the merges build this token from its own letters?"""
        return self.merge(self.letters_of(token)) == [token]

    def join(self, a: int, b: int) -> list[int]:
        """Exact merging of the letters of two tokens that do not stand together."""
        code = a * self.shift + b
        got = self.joined.get(code)
        if got is None:
            if len(self.joined) >= CACHED_PAIRS:
                self.joined.clear()
            got = self.joined[code] = self.merge(self.letters_of(a) + self.letters_of(b))
        return got

    def failing(self, flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Of each place in the tokens of many words: does the pair that starts there fail?  The last of a word does not."""
        out = np.zeros(len(flat), bool)
        inner = np.ones(len(flat), bool)
        inner[np.cumsum(size)[size > 0] - 1] = False
        at = np.flatnonzero(inner)
        pairs, back = np.unique(flat[at] * self.shift + flat[at + 1], return_inverse=True)
        if len(pairs):
            out[at] = ~self.compatible(pairs // self.shift, pairs % self.shift)[back]
        return out

    def repair(self, flat: np.ndarray, size: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Replace each failing pair by what merging gives for its letters; of overlapping pairs every other one."""
        at = np.flatnonzero(bad)
        run = np.flatnonzero(np.diff(at, prepend=-2) != 1)
        chosen = at[(at - np.repeat(at[run], np.diff(np.append(run, len(at))))) % 2 == 0]
        pairs, back = np.unique(flat[chosen] * self.shift + flat[chosen + 1], return_inverse=True)
        joined = [self.join(c // self.shift, c % self.shift) for c in pairs.tolist()]
        lengths = np.array([len(x) for x in joined], np.int64)
        new = np.array([t for x in joined for t in x], np.int64)
        count = np.ones(len(flat), np.int64)
        count[chosen], count[chosen + 1] = lengths[back], 0
        begin = np.zeros(len(flat), np.int64)  # where the replacement of a place starts in new
        begin[chosen] = (np.cumsum(lengths) - lengths)[back]
        place = np.repeat(np.arange(len(flat)), count)
        within = np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count)
        replaced = np.zeros(len(flat), bool)
        replaced[chosen] = True
        hit = replaced[place]
        out = flat[place]
        out[hit] = new[begin[place[hit]] + within[hit]]
        return out, np.bincount(np.repeat(np.arange(len(size)), size), count, len(size)).astype(np.int64)

    def encode_flat(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of distinct words laid end to end, ids of each); words are given as letters."""
        flat, size, whole = self.propose(words)
        self.proposed += len(words)
        if self.unstable:
            shaky = np.isin(flat, np.array(sorted(self.unstable)))
            whole[np.repeat(np.arange(len(size)), size)[shaky]] = False
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        todo = np.arange(len(words))

        def part(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return todo[keep], size[keep], flat[np.repeat(keep, size)]

        todo, size, flat = part(whole)
        for again in range(ROUNDS + 1):
            bad = self.failing(flat, size)
            wrong = np.bincount(np.repeat(np.arange(len(size)), size)[bad], minlength=len(size)) > 0
            done.append(part(~wrong))
            inner = np.repeat(wrong, size)
            todo, size, flat = part(wrong)
            if not len(todo) or again == ROUNDS:
                break
            flat, size = self.repair(flat, size, bad[inner])
        rest = np.concatenate([np.flatnonzero(~whole), todo])
        merged = [self.merge(self.base(words[i])) for i in rest.tolist()]
        self.merged += len(merged)
        done.append((rest, np.array([len(m) for m in merged], np.int64), np.array([t for m in merged for t in m], np.int64)))
        which, size, flat = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(which)
        begin, n = (np.cumsum(size) - size)[order], size[order]
        return flat[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(len(flat))], n

    def encode_words(self, words: list[str]) -> list[list[int]]:
        flat, size = self.encode_flat(words)
        ends = np.cumsum(size).tolist()
        ids = flat.tolist()
        return [ids[b - n : b] for b, n in zip(ends, size.tolist())]

    # -- texts ----------------------------------------------------------------------------------------------------
    def _learn(self, chunks: list[str]) -> None:
        """Put normalized chunks without white space into the cache, and the words they are made of."""
        ids_of, names_of, table = self.ids_of, self.names_of, self.table
        new: dict[str, str] = {}  # spelling of each word
        made: list[tuple[str, list[str]]] = []
        for c in chunks:
            if c.isalpha():
                own = None
            elif c[:-1].isalpha() and c[-1] in ".,;:!?":
                own = [c[:-1], c[-1]]
            else:
                own = _WORD.findall(c)
                if own == [c]:
                    own = None
            if own is not None:
                made.append((c, own))
            for w in own if own is not None else (c,):
                if w not in ids_of and w not in new:
                    new[w] = w if w.isascii() and w.isprintable() else w.encode("utf-8", "surrogatepass").decode("latin-1").translate(table)
        if new:
            flat, size = self.encode_flat(list(new.values()))
            offsets, flat = pa.array(np.append(0, np.cumsum(size)), pa.int64()), pa.array(flat)
            for known, spelled in ((ids_of, self.digits), (names_of, self.spellings)):
                joined = pc.binary_join(pa.LargeListArray.from_arrays(offsets, spelled.take(flat)), pa.scalar(" ", pa.large_string()))
                known.update(zip(new, joined.to_pylist()))
        for c, own in made:
            ids_of[c] = " ".join([ids_of[w] for w in own])
            names_of[c] = " ".join([names_of[w] for w in own])

    def _normal(self, text: str) -> str:
        """Normalized, with every blank that the pattern knows as an ASCII one."""
        if not text.isascii():
            text = _BLANKS.sub(" ", unicodedata.normalize("NFC", text).replace("Σ", "σ"))
        return text.lower().strip(" \t\n\v\f\r")

    def _lookup(self, chunks: list[str]) -> None:
        """Have all of these distinct chunks in the younger generation of the cache."""
        if len(self.ids_of) > CACHED_CHUNKS:
            self.old_ids, self.old_names, self.ids_of, self.names_of = self.ids_of, self.names_of, {}, {}
        young, old, missing = self.ids_of, self.old_ids.get, []
        for c in chunks:
            if c not in young:
                got = old(c)
                if got is None:
                    missing.append(c)
                else:
                    young[c], self.names_of[c] = got, self.old_names[c]
        if missing:
            self._learn(missing)

    def encode_arrays(self, many: list[str]) -> tuple[pa.Array, pa.Array]:
        """For each text without special strings: ids and tokens, each joined by one space."""
        lists = pc.ascii_split_whitespace(pa.array([self._normal(t) for t in many], pa.large_string()))
        coded = pc.dictionary_encode(lists.flatten())
        chunks = coded.dictionary.to_pylist()
        self._lookup([c for c in chunks if c])
        out = []
        for known in (self.ids_of, self.names_of):
            words = pa.array([known[c] if c else "" for c in chunks], pa.large_string()).take(coded.indices)
            out.append(pc.binary_join(pa.ListArray.from_arrays(lists.offsets, words), pa.scalar(" ", pa.large_string())))
        return out[0], out[1]

    def encode_texts(self, many: list[str]) -> list[tuple[str, str]]:
        """For each text: ids and tokens, each joined by one space; special strings become their ids."""
        pieces, owner = [], []
        for i, t in enumerate(many):
            own = [t] if self.cut is None or "<|" not in t else [x for x in self.cut.split(t) if x]
            pieces += own
            owner += [i] * len(own)
        ids, names = (x.to_pylist() for x in self.encode_arrays([x if x not in self.special else "" for x in pieces]))
        out: list[tuple[list[str], list[str]]] = [([], []) for _ in many]
        for i, x, a, b in zip(owner, pieces, ids, names):
            if x in self.special:
                a, b = str(self.special[x]), x
            if a:
                out[i][0].append(a)
                out[i][1].append(b)
        return [(" ".join(a), " ".join(b)) for a, b in out]

    def encode(self, text: str) -> list[int]:
        got = self.encode_texts([text])[0][0]
        return [int(x) for x in got.split()] if got else []

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space: the file names no decoder."""
        return " ".join([self.names[i] for i in ids])


@lru_cache(maxsize=2)
def load(path: str) -> WordBpe:
    with open(path, encoding="utf-8") as f:
        return WordBpe(json.load(f))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _digests(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path or default_path())
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for ids, names in bpe.encode_texts(texts(batch.column("text"))):
                n.append(ids.count(" ") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(names.encode("utf-8", "surrogatepass")).hexdigest())
            pa.default_memory_pool().release_unused()  # workers stay alive between tasks
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_documents(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): token ids of each document, and the text they decode to."""
    small_batches(spark, ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path or default_path())
        for batch in batches:
            got = bpe.encode_texts(texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([[int(x) for x in a.split()] for a, _ in got], pa.list_(pa.int32())), pa.array([b for _, b in got], pa.string())], ["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def token_digests(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document; rows repeat as they do in docs."""
    small_batches(spark, ROWS)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(spark, table(spark, sf_dir, "documents"))
