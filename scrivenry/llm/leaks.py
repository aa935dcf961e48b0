"""Evaluation passages inside training text, found by spaced seeds.

A fixed mask picks some of the words of a window and ignores the others, so a window still hits
when an ignored word was changed. The seeds of all test passages are a table; the corpus is read
once, and the seeds that a bitmap of fixed size lets through are joined with it. Hits that lie
on one diagonal of a (document, passage) pair are counted, and pairs with enough of them are
verified by a banded local alignment that tolerates changed, missing and added words.

Defined results: null or empty texts and passages match nothing; a passage of under ``MIN_WORDS``
words is no passage (no mask fits, and whole texts of that length stand everywhere); items delivered twice count once; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivenry.sources import materialize

MASKS = ("11101111", "11011111", "11111101", "10110001111")
MIN_WORDS = 8
#: Parts of a divided passage are summed from this many words on: shorter ones are single stock phrases.
PART = 14
RUN = 5
_OFFSETS = [np.array([i for i, c in enumerate(m) if c == "1"]) for m in MASKS]
_SPAN = max(map(len, MASKS))
_BITS = 24
_WORD = re.compile(r"[^\W_]+")
_BREAK = re.compile(r"(?<=[^\W\d_])[-‐¬­][ \t]*\n\s*(?=[^\W\d_])")


def words(text: str | None) -> list[str]:
    """The words of a text: no case, no punctuation; words divided at a line end are joined."""
    if not text:
        return []
    low = text.lower()
    return _WORD.findall(_BREAK.sub("", low) if "\n" in low else low)


_TURN = np.random.default_rng(11).integers(1, 2**62, (len(MASKS), max(map(len, _OFFSETS))), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GAP = np.zeros(_SPAN, np.int64)


class _Codes(dict):
    """The code of each word (a hash, never 0), worked out once."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = (xxhash.xxh64_intdigest(word.encode()) >> 1) or 1
        return h

    def of(self, text: str | None) -> np.ndarray:
        return np.array([self[w] for w in words(text)], np.int64)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _BITS)).astype(np.int64)


def _in(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = _slot(hashes)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def _hashes(ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask, the hashes of all windows whose picked words aren't 0, and their places; the last ``_SPAN`` ids begin none."""
    known, code = ids > 0, ids.view(np.uint64)
    n = len(ids) - _SPAN
    for turn, offsets in zip(_TURN, _OFFSETS):
        ok = known[:n].copy()
        for o in offsets[1:]:
            ok &= known[o : n + o]
        at = np.flatnonzero(ok)
        h = np.zeros(len(at), np.uint64)
        for t, o in zip(turn, offsets):
            h += (code[at + o] ^ code[at + o] >> np.uint64(31)) * t
        h ^= h >> np.uint64(29)
        yield (h * np.uint64(0x9E3779B97F4A7C15)).view(np.int64), at


def _passages(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(item_id, codes, runs): the words of each passage that is long enough, and its runs of ``RUN`` words."""
    code = _Codes()
    for p in parts:
        rows = [(k, c) for k, c in ((k, code.of(x)) for k, x in zip(p["item_id"], p["passage"])) if len(c) >= MIN_WORDS]
        runs = [[xxhash.xxh64_intdigest(c[i : i + RUN].tobytes()) - 2**63 for i in range(len(c) - RUN + 1)] for _, c in rows]
        whole = [xxhash.xxh64_intdigest(c.tobytes()) - 2**63 for _, c in rows]
        yield pd.DataFrame({"item_id": pd.Series([k for k, _ in rows], dtype="int64"), "codes": [c for _, c in rows], "runs": runs, "whole": pd.Series(whole, dtype="int64")})


def _seeds(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        rows = []
        for k, c in zip(p["item_id"], p["codes"]):
            for h, at in _hashes(np.concatenate([np.asarray(c, np.int64), _GAP])):
                rows.append(pd.DataFrame({"item_id": k, "at": at, "seed": h}))
        yield pd.concat(rows) if rows else pd.DataFrame({"item_id": [], "at": [], "seed": []}).astype("int64")


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """A bitmap with a bit for the slot of each hash, made in the tasks: what goes to the driver and back has a fixed size."""

    def fill(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(1 << (_BITS - 3), np.uint8)
        for p in parts:
            slot = np.unique(_slot(p["h"].to_numpy(np.int64)))
            np.bitwise_or.at(own, slot >> 3, np.left_shift(1, slot & 7).astype(np.uint8))
        yield pd.DataFrame({"bits": [zlib.compress(own.tobytes(), 1)]})

    total = np.zeros(1 << (_BITS - 3), np.uint8)
    for r in hashes.toDF("h").coalesce(4).mapInPandas(fill, "bits binary").toLocalIterator():
        total |= np.frombuffer(zlib.decompress(bytes(r["bits"])), np.uint8)
    return total


def _hits(of_words: np.ndarray, of_seeds: np.ndarray):  # noqa: ANN202
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = _Codes()
        for p in parts:
            rows = [code.of(t) for t in p["text"]]
            if not rows:
                continue
            start = np.cumsum([0] + [len(r) + _SPAN for r in rows])
            ids = np.concatenate([x for r in rows for x in (r, _GAP)])
            ids[~_in(of_words, ids)] = 0
            found = [(h[s], at[s]) for h, at in _hashes(ids) for s in [_in(of_seeds, h)]]
            h, at = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            row = np.searchsorted(start, at, "right") - 1
            yield pd.DataFrame({"doc_id": p["doc_id"].to_numpy()[row], "pos": at - start[row], "seed": h})

    return run


def align(a: np.ndarray, b: np.ndarray, diagonal: int, band: int = 8) -> tuple[int, int, int, int]:
    """(first and last passage word, document word of the first, words matched) of the best local alignment of passage ``a`` and document ``b`` near a diagonal.

    A match counts 1, a change -1.5, a missing or added word -1; the path stays within ``band`` of the diagonal.
    """
    width = 2 * band + 1
    lo = diagonal - band
    zero = (0.0, (0, 0), 0)
    before = [zero] * (width + 1)
    best = (0.0, 0, -1, 0, 0)
    n = len(b)
    la, lb = a.tolist(), b.tolist()
    for p, x in enumerate(la):
        now, left = [], zero
        for j in range(width):
            q = p + lo + j
            s, first, m = before[j]
            if 0 <= q < n and x == lb[q]:
                cell = (s + 1, first if s > 0 else (p, q), m + 1)
            else:
                cell = (s - 1.5, first, m)
                up, le = before[j + 1], left
                if up[0] - 1 > cell[0]:
                    cell = (up[0] - 1, up[1], up[2])
                if le[0] - 1 > cell[0]:
                    cell = (le[0] - 1, le[1], le[2])
                if cell[0] <= 0:
                    cell = zero
            if cell[0] > best[0]:
                best = (cell[0], cell[1][0], p, cell[1][1], cell[2])
            now.append(cell)
            left = cell
        before = [*now, zero]
    return best[1:]


def damage(span: int) -> int:
    """The words of a stretch that may be changed: one in eight."""
    return -(-span // 8)


def stretch(a: np.ndarray, b: np.ndarray, aligned: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    """What ``align`` finds, and beyond its ends a few words more where only a changed word ended it or the passage ends."""
    first, last, at, matched = aligned
    for back in (True, False):
        for _ in range(3):
            left = first if back else len(a) - 1 - last
            if not left or not matched:
                break
            # The end of the document word is told by the diagonal of the first: gaps inside shift it by what lies within the band.
            for j in range(2, min(4, left) + 1):
                i = first - j if back else last + j
                near = range(at - j, at - j + 1) if back else range(i + at - first - 8, i + at - first + 9)
                if any(0 <= q < len(b) and a[i] == b[q] for q in near):
                    first, last, at, matched = (i, last, at - j, matched + 1) if back else (first, i, at, matched + 1)
                    break
            else:
                break
    if first <= 2:
        first, at = 0, at - first
    if len(a) - 1 - last <= 2:
        last = len(a) - 1
    return first, last, at, matched


def _dense(a: np.ndarray, b: np.ndarray, diagonal: int, need: int, window: int, band: int = 8) -> bool:
    """Whether some ``window`` words of the passage have ``need`` partners near the diagonal: holds for whatever ``align`` accepts."""
    hit = np.zeros(len(a), bool)
    for d in range(diagonal - band, diagonal + band + 1):
        lo, hi = max(0, -d), min(len(a), len(b) - d)
        if hi > lo:
            hit[lo:hi] |= a[lo:hi] == b[lo + d : hi + d]
    total = np.concatenate([[0], np.cumsum(hit)])
    w = min(window, len(a))
    return len(a) > 0 and (total[w:] - total[: len(total) - w]).max() >= need


def _together(found: set[tuple[int, int, int, int]], sure: set[tuple[int, int, int, int]], least: int, min_share: float) -> tuple[int, int] | None:
    """(span, matched) of the best stretch, or of two parts of a divided passage that do not overlap; None if damaged too much or too short.

    It must be one of ``sure`` (of two parts: either), or a single stretch that scores as much as ``least`` undamaged words.
    """
    own = [(x[1] - x[0] + 1, x[3], x in sure, x) for x in found if x[3]]
    good = [(m, s) for s, m, _, _ in own if s >= least and m >= min_share * s and m - 1.5 * (s - m) >= least]
    own += [(s + t, m + n, u or v, x) for s, m, u, x in own for t, n, v, y in own if y[0] > x[1] and min(s, t) >= PART]
    good += [(m, s) for s, m, u, _ in own if u and s >= least and m >= min_share * s and m >= s - damage(s)]
    return max(good)[::-1] if good else None


def _has_own(a: np.ndarray, b: np.ndarray, own: np.ndarray, part: tuple[int, int, int, int], band: int = 8) -> bool:
    """Whether a run of words that only this passage holds stands in the document's part of a stretch."""
    first, last, at, _ = part
    la, lb = a.tolist(), b.tolist()
    for i in range(first, last - RUN + 2):
        if own[i]:
            q = at + i - first
            if any(lb[p : p + RUN] == la[i : i + RUN] for p in range(max(0, q - band), q + band + 1)):
                return True
    return False


def _verify(min_words: int, min_share: float):  # noqa: ANN202
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = _Codes()
        for p in parts:
            out = []
            for doc_id, text, pairs in zip(p["doc_id"], p["text"], p["pairs"]):
                b = code.of(text)
                for pair in pairs:
                    a, own = np.asarray(pair["codes"], np.int64), np.asarray(pair["own"], bool)
                    least = min(min_words, len(a))
                    piece = min(PART, len(a))
                    aligned = {align(a, b, int(d)) for d in pair["diagonals"] if _dense(a, b, int(d), piece - 3, piece)}
                    parts_ = aligned | {stretch(a, b, x) for x in aligned}
                    best = _together(parts_, {x for x in parts_ if _has_own(a, b, own, x)}, least, min_share)
                    if best:
                        out.append((pair["item_id"], doc_id, *best))
            yield pd.DataFrame(out, columns=["item_id", "doc_id", "span", "matched"])

    return run


def leaks(docs: DataFrame, items: DataFrame, min_words: int = 20, min_share: float = 0.8, min_span: int = 16, most_sent: int = 2_000_000) -> DataFrame:
    """(item_id, doc_id, span, matched): a row per pair; the longest verified stretch of the passage and its matching words.

    Two hits at least, together ``min_span`` words long, must share a diagonal. A stretch, or two
    parts of one passage together, counts from ``min_words`` words on (a shorter passage: from all
    its words) if ``min_share`` of it and all but one word in eight match. Stock phrases that stand
    beside each other in both texts are told by what other passages hold: without a run of five
    words that no other has, a stretch must score as much as ``min_words`` undamaged words do.

    The corpus is read once for the seeds of all items and once to verify. Up to ``most_sent`` seeds
    (24 bytes each) are sent to the tasks, so that a document's hits are counted where they are
    found; more are joined by a shuffle. The result is the same.
    """
    spark = docs.sparkSession
    tests = items.select("item_id", "passage").filter("item_id is not null and length(passage) > 0").dropDuplicates(["item_id"])
    tests = materialize(tests.mapInPandas(_passages, "item_id long, codes array<long>, runs array<long>, whole long"), "passages")
    own = docs.select("doc_id", "text").filter("doc_id is not null and length(text) > 0")
    seeds = materialize(tests.select("item_id", "codes").mapInPandas(_seeds, "item_id long, at long, seed long"), "seeds")
    of_words = spark.sparkContext.broadcast(_bitmap(tests.select(F.explode("codes")).distinct()))
    of_seeds = spark.sparkContext.broadcast(_bitmap(seeds.select("seed").distinct()))
    # Runs that no other passage holds (copies of a passage are one).
    held = tests.select("whole", F.explode("runs").alias("run")).distinct().groupBy("run").agg(F.count("*").alias("n")).filter("n = 1").select("run", F.lit(True).alias("own"))
    runs = tests.select("item_id", F.posexplode("runs").alias("at", "run")).join(held, "run", "left")
    runs = runs.groupBy("item_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("own", F.lit(False)).alias("own")))), lambda x: x["own"]).alias("own"))
    passages = tests.select("item_id", "codes").join(runs, "item_id")
    hit = own.mapInPandas(lambda parts: _hits(of_words.value, of_seeds.value)(parts), "doc_id long, pos long, seed long")
    if seeds.count() <= most_sent:
        seeds = F.broadcast(seeds)
    diagonal = F.col("pos") - F.col("at")
    # Bins of 16 diagonals, each hit in two that overlap: hits up to 8 diagonals apart share one.
    bins = F.explode(F.array(F.floor(diagonal / 16) * 2, F.floor((diagonal + 8) / 16) * 2 + 1)).alias("bin")
    bands = (
        hit.join(seeds, "seed").select("doc_id", "item_id", "pos", "at", diagonal.alias("diagonal"), bins)
        .groupBy("doc_id", "item_id", "bin")
        .agg(F.count("*").alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.round(F.avg("diagonal")).cast("long").alias("diagonal"))
        .filter((F.col("n") >= 2) & (F.col("hi") - F.col("lo") + min(map(len, MASKS)) >= min_span))
    )
    pairs = bands.groupBy("doc_id", "item_id").agg(F.collect_set("diagonal").alias("diagonals")).join(passages, "item_id")
    pairs = pairs.groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "diagonals", "codes", "own")).alias("pairs"))
    pairs = materialize(pairs, "leak_pairs")
    checked = own.join(pairs, "doc_id").mapInPandas(_verify(min_words, min_share), "item_id long, doc_id long, span long, matched long")
    return checked.groupBy("item_id", "doc_id").agg(F.max_by("span", F.struct("matched", "span")).alias("span"), F.max("matched").alias("matched"))
