"""Noise of scanned pages: divided words, misread characters, running heads and page numbers.

Words are counted over the whole corpus. A symmetric-delete index over that lexicon (each word
under its spellings with one letter, or two adjacent letters, left out) leads from rare words to
frequent ones; a weighted edit distance over pairs of characters that scanners confuse decides
which of them are misreadings, and where several repairs fit, the words before and after pick one.
Divided words are joined if the lexicon knows the joined word rather than the compound. Running
heads and printed page numbers are told by their place at a page's edge.

Defined results: null and empty contents are clean; misreadings are looked for in documents with
page numbers; a head must have 8 letters and repeat on a neighbouring page or be the title; chunks
delivered twice count once; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from scrivenry.sources import materialize

#: Fixed values: (as read, as printed) and the cost of that confusion.
CONFUSIONS = {
    ("c", "e"): 1.0, ("f", "t"): 1.0, ("5", "s"): 0.3, ("0", "o"): 0.3, ("1", "l"): 0.3, ("1", "i"): 0.5, ("9", "g"): 0.3, ("6", "b"): 0.3, ("8", "b"): 0.5, ("!", "i"): 0.3, ("!", "l"): 0.5,
    ("b", "h"): 1.0, ("y", "v"): 1.0, ("rn", "m"): 0.7, ("m", "rn"): 1.0, ("cl", "d"): 0.7, ("d", "cl"): 1.0, ("ii", "u"): 0.7, ("u", "ii"): 1.0, ("ri", "n"): 0.8, ("n", "ri"): 1.0,
    ("li", "h"): 0.8, ("h", "li"): 1.0, ("vv", "w"): 0.5, ("w", "vv"): 1.0, ("l", "i"): 1.0, ("i", "l"): 1.0, ("e", "c"): 1.0, ("t", "f"): 1.0, ("h", "b"): 1.0, ("v", "y"): 1.0, ("in", "m"): 1.0, ("nn", "m"): 1.0,
}
#: The letters that a digit or mark is read for.
_STANDS: dict[str, str] = {}
for (_read, _printed), _cost in CONFUSIONS.items():
    if len(_read) == len(_printed) == 1 and not _read.isalpha():
        _STANDS[_read] = _STANDS.get(_read, "") + _printed
_WORD = re.compile(r"[^\W_]+(?:[-!][^\W_]+)*")
_APART = re.compile(r"(?<![^\s(“\"'‘])(?:[^\W\d_] ){3,}[^\W\d_](?!\w)")
_BREAK = re.compile(r"([^\W\d_]+)([-‐¬­])[ \t]*\n[ \t]*([^\W\d_]+)")
MARKS = "-‐¬­"
_BITS = 24
PAGE_NUMBER = r"^\s*(?:(?i:p\.|page|seite|s\.|uk\.|ukurasa)\s?)?[-–—\[(]?\s?(\d{1,4}|[ivxlc]{1,9})\s?[-–—\])]?(\s(?i:of|/|von|sur|de|kati ya)\s\d{1,4})?\s*$"
TABLE_CELL = r"^\s*(?:\p{Lu}\p{L}+ )?[0-9A-Z][0-9A-Z,/.]{0,6}\s*$"
SURE_PAGE_NUMBER = r"^\s*([-–—]\s?\d{1,4}\s?[-–—]|\[\d{1,4}\]|p\. ?\d{1,4}|Page \d{1,4} of \d{1,4})\s*$"


def _lexicon(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        seen: Counter[str] = Counter()
        for t in p["content"]:
            if t:
                seen.update(_WORD.findall(t.lower()))
        yield pd.DataFrame({"word": list(seen), "n": list(seen.values())}).astype({"n": "int64"})


def lexicon(chunks: DataFrame) -> DataFrame:
    """(word, n): how often each word occurs in all chunks; counted in each task before the shuffle."""
    return chunks.select("content").mapInPandas(_lexicon, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def deletes(word: Column) -> Column:
    """The spellings of a word with one letter or two adjacent letters left out, and the word."""
    at = F.sequence(F.lit(1), F.length(word))
    one = F.transform(at, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    two = F.transform(at, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 2, F.length(word))))
    return F.array_distinct(F.concat(one, two))


def confusion_cost(read: str, printed: str) -> float | None:
    """The least sum of confusion costs that turns ``printed`` into ``read`` (three at most); None if none does."""
    n, m = len(read), len(printed)
    cost = [[9.0] * (m + 1) for _ in range(n + 1)]
    cost[0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            c = cost[i][j]
            if c > 3:
                continue
            if i < n and j < m and read[i] == printed[j]:
                cost[i + 1][j + 1] = min(cost[i + 1][j + 1], c)
            for a in (1, 2):
                for b in (1, 2):
                    if i + a <= n and j + b <= m and (k := CONFUSIONS.get((read[i : i + a], printed[j : j + b]))):
                        cost[i + a][j + b] = min(cost[i + a][j + b], c + k)
    return cost[n][m] if 0 < cost[n][m] <= 3 else None


@F.pandas_udf(ArrayType(StringType()))
def _spelt(words: pd.Series) -> pd.Series:
    """What a word with digits or marks spells if each stands for one of its letters; words with more than six are none."""

    def of(word: str) -> list[str]:
        out = [""]
        if sum(c in _STANDS for c in word) > 6:
            return []
        for c in word:
            out = [x + y for x in out for y in _STANDS.get(c, c)]
        return [x for x in out if x.isalpha()]

    return words.map(of)


def _weigh(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        cost = [confusion_cost(a, b) for a, b in zip(p["word"], p["printed"])]
        p = p.assign(cost=cost)
        yield p[p["cost"].notna()].astype({"cost": "float64"})


def misreadings(words: DataFrame, min_ratio: float = 12.0) -> DataFrame:
    """(word, printed, cost, score): rare words and the frequent words they can be misreadings of.

    A misreading with a digit or mark amid letters needs a known word behind it; one that looks
    like a word must be ``min_ratio`` times rarer than it, a short one twenty times that.
    """
    plain = words.filter(F.length("word").between(3, 40) & ~F.contains("word", F.lit("-")) & F.col("word").rlike(r"\p{L}"))
    mixed = F.col("word").rlike(r"[0-9!]")
    frequent = plain.filter((F.col("n") >= min_ratio) & ~mixed)
    # Words that are themselves frequent in the language of the corpus can't be rare misreadings of anything: bounded by the most frequent word.
    top = words.agg(F.max("n").alias("top"))
    rare = plain.crossJoin(F.broadcast(top)).filter(mixed | (F.col("n") * min_ratio <= F.col("top"))).drop("top")
    left = rare.select("word", F.col("n").alias("n_word"), F.explode(deletes(F.col("word"))).alias("gone"))
    right = frequent.select(F.col("word").alias("printed"), F.col("n").alias("n_printed"), F.explode(deletes(F.col("word"))).alias("gone"))
    near = left.join(right, "gone").filter(F.col("word") != F.col("printed")).drop("gone").distinct()
    ratio = F.col("n_printed") / F.col("n_word")
    digits = F.col("word").rlike(r"[0-9!]")
    near = near.filter(F.when(digits, ratio >= 1).when(F.length("printed") <= 4, ratio >= 20 * min_ratio).otherwise(ratio >= min_ratio))
    # Digits and marks stand for single letters: the words they spell are looked up among all words seen twice, whatever their frequency.
    spelt = plain.filter(mixed).select("word", F.col("n").alias("n_word"), F.explode(_spelt(F.col("word"))).alias("printed"))
    known = plain.filter(~mixed & (F.col("n") >= 2)).select(F.col("word").alias("printed"), F.col("n").alias("n_printed"))
    near = near.unionByName(spelt.join(known, "printed").filter("n_printed >= n_word").select("word", "n_word", "printed", "n_printed")).distinct()
    weighed = near.select("word", "printed", "n_word", "n_printed").mapInPandas(_weigh, "word string, printed string, n_word long, n_printed long, cost double")
    return weighed.select("word", "printed", "cost", (F.log("n_printed") - 3 * F.col("cost")).alias("score"))


def _bitmap(words: DataFrame) -> np.ndarray:
    """A bitmap of fixed size with a bit for each word: what is sent to tasks doesn't grow with the words."""
    slots = words.select(F.pmod(F.crc32(F.encode("word", "utf-8")), F.lit(1 << _BITS)).alias("slot"))

    def fill(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = np.zeros(1 << (_BITS - 3), np.uint8)
        for p in parts:
            s = p["slot"].to_numpy(np.int64)
            np.bitwise_or.at(own, s >> 3, np.left_shift(1, s & 7).astype(np.uint8))
        yield pd.DataFrame({"bits": [zlib.compress(own.tobytes(), 1)]})

    total = np.zeros(1 << (_BITS - 3), np.uint8)
    for r in slots.coalesce(4).mapInPandas(fill, "bits binary").toLocalIterator():
        total |= np.frombuffer(zlib.decompress(bytes(r["bits"])), np.uint8)
    return total


class _Verdicts(dict):
    """For each word, worked out once: 1 if it may be misread, 2 if it may be a repair that its neighbours decide on."""

    def __init__(self, suspects: np.ndarray, repairs: np.ndarray) -> None:
        super().__init__()
        self.bits = suspects, repairs

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        s = zlib.crc32(word.encode()) & ((1 << _BITS) - 1)
        self[word] = v = sum((int(b[s >> 3]) >> (s & 7) & 1) << i for i, b in enumerate(self.bits))
        return v


def _features(suspects: np.ndarray, repairs: np.ndarray):  # noqa: ANN202
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        verdict = _Verdicts(suspects, repairs)
        for p in parts:
            rows = []
            seen: Counter[tuple[str, str]] = Counter()
            for chunk_id, doc_id, order, page, text in zip(p["chunk_id"], p["doc_id"], p["reading_order"], p["page_number"], p["content"]):
                low = text.lower()
                found = _WORD.findall(low)
                said = [verdict[w] for w in found]
                rare = list({(found[i], found[i - 1] if i else "", found[i + 1] if i + 1 < len(found) else "") for i, v in enumerate(said) if v & 1})
                at = {i for i, v in enumerate(said) if v & 2}
                seen.update((found[i], found[i + 1]) for i in {*at, *(i - 1 for i in at)} if 0 <= i < len(found) - 1)
                apart = [m.group().replace(" ", "") for m in _APART.finditer(text) if not m.group().isupper()] if "  " in text or " " in text else []
                breaks = [(a.lower(), m, b.lower()) for a, m, b in _BREAK.findall(text) if b[0].islower()] if "\n" in text else []
                lines = [x for x in text.split("\n") if x.strip()]
                rows.append((chunk_id, doc_id, order, None if pd.isna(page) else int(page), lines[:2], lines[-2:], rare, apart, breaks, []))
            if rows:  # The counts of a batch go with its first row.
                rows[0] = (*rows[0][:-1], [(a, b, n) for (a, b), n in seen.items()])
            out = pd.DataFrame(rows, columns=["chunk_id", "doc_id", "reading_order", "page_number", "top", "bottom", "rare", "apart", "breaks", "pairs"])
            yield out.astype({"reading_order": "float64", "page_number": "Int64"})

    return run


_FEATURES = (
    "chunk_id long, doc_id long, reading_order double, page_number long, top array<string>, bottom array<string>, "
    "rare array<struct<word: string, before: string, after: string>>, apart array<string>, breaks array<struct<a: string, mark: string, b: string>>, pairs array<struct<a: string, b: string, n: long>>"
)


def _head_key(line: Column) -> Column:
    """The letters of a line that may be a head: without case, numbers and the marks of a cut."""
    return F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")


def _repair(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunk texts without furniture lines, with misread words replaced and divided words joined."""
    for p in parts:
        out = []
        for text, head, foot, repairs, apart, joins in zip(p["content"], p["head"], p["foot"], p["repairs"], p["apart"], p["joins"]):
            lines = text.split("\n")
            full = [i for i, x in enumerate(lines) if x.strip()]
            gone = ({full[0]} if head and full else set()) | ({full[-1]} if foot and full else set())
            text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
            for letters in apart if apart is not None else ():
                text = text.replace(" ".join(letters), letters)
            if repairs is not None and len(repairs):
                new = dict(repairs)

                def put(m: re.Match[str], new: dict[str, str] = new) -> str:
                    w = new.get(m.group().lower())
                    return m.group() if w is None else w.capitalize() if m.group()[0].isupper() else w

                text = _WORD.sub(put, text)
            if joins is not None and len(joins):
                known = {(j["a"], j["b"]) for j in joins}
                text = _BREAK.sub(lambda m: m.group(1) + m.group(3) if (m.group(1).lower(), m.group(3).lower()) in known else m.group(), text)  # noqa: B023
            out.append(text)
        yield p[["chunk_id", "doc_id", "reading_order", "open_break"]].assign(text=out)


class Scan:
    """What was found in the chunks; each part is a table in the shared folder."""

    def __init__(self, chunks: DataFrame, documents: DataFrame) -> None:
        spark = chunks.sparkSession
        self.chunks = chunks
        self.words = materialize(lexicon(chunks), "word_counts")
        self.misread = materialize(misreadings(self.words), "misreadings")
        several = self.misread.join(self.misread.groupBy("word").count().filter("count > 1").select("word"), "word", "left_semi")
        shared = spark.sparkContext.broadcast((_bitmap(self.misread.select("word").distinct()), _bitmap(several.select(F.col("printed").alias("word")).distinct())))
        own = chunks.select("chunk_id", "doc_id", "reading_order", "page_number", "content").filter("chunk_id is not null and length(content) > 0")
        self.features = materialize(own.mapInPandas(lambda parts: _features(*shared.value)(parts), _FEATURES), "scan_features")
        self.edges = materialize(self._edges(documents), "page_edges")

    def _edges(self, documents: DataFrame) -> DataFrame:
        """(chunk_id, paged, head, foot, head_line, foot_line, last, next_first): which lines at a page's edges are furniture."""
        order = Window.partitionBy("doc_id").orderBy("reading_order", "chunk_id")
        pages = Window.partitionBy("doc_id")
        titles = documents.select("doc_id", "title").filter("doc_id is not null").dropDuplicates(["doc_id"])
        once = self.features.select("chunk_id", "doc_id", "reading_order", "page_number", "top", "bottom").dropDuplicates(["chunk_id"])
        rows = once.join(titles, "doc_id", "left").select(
            "*", _head_key(F.get("top", F.lit(0))).alias("key"), _head_key("title").alias("title_key"), F.get("top", F.lit(0)).alias("first_line"), F.element_at("bottom", -1).alias("last_line")
        )
        near = [f("key", i).over(order) for f in (F.lag, F.lead) for i in (1, 2)]
        same = near[0].eqNullSafe(F.col("key")) | near[1].eqNullSafe(F.col("key")) | near[2].eqNullSafe(F.col("key")) | near[3].eqNullSafe(F.col("key"))
        rows = rows.withColumns({"paged": F.max(F.col("page_number").isNotNull()).over(pages), "same": same & (F.length("key") >= 8)})
        by_title = (F.length("key") >= 8) & (F.length("title_key") >= 8) & (F.col("title_key").startswith(F.col("key")) | F.col("key").startswith(F.col("title_key")))
        # A bare number is a page number at a page's edge, unless the line beside it is a cell of a table.
        number = lambda line, beside: F.col(line).rlike(SURE_PAGE_NUMBER) | (F.col("paged") & F.col(line).rlike(PAGE_NUMBER) & ~F.coalesce(beside.rlike(TABLE_CELL), F.lit(False)))
        foot = number("last_line", F.when(F.size("bottom") > 1, F.get("bottom", F.lit(0))))
        rows = rows.withColumns({"head": (F.col("paged") & (F.col("same") | by_title) & (F.length("first_line") <= 160)) | number("first_line", F.get("top", F.lit(1))), "foot": foot})
        rows = rows.withColumns({
            "first": F.when(F.col("head"), F.get("top", F.lit(1))).otherwise(F.col("first_line")),
            "last": F.when(F.col("foot"), F.when(F.size("bottom") > 1, F.get("bottom", F.lit(0)))).otherwise(F.col("last_line")),
        })
        return rows.withColumn("next_first", F.lead("first").over(order)).select("chunk_id", "paged", "head", "foot", "first_line", "last_line", "last", "next_first")

    def furniture(self) -> DataFrame:
        return self.edges.filter("head or foot").select("chunk_id").distinct()

    def divided(self) -> DataFrame:
        """(chunk_id, a, mark, b): words divided at a line's or page's end, in the chunk where they begin."""
        inner = self.features.select("chunk_id", F.explode("breaks").alias("x")).select("chunk_id", "x.a", "x.mark", "x.b")
        tail = F.regexp_extract("last", rf"([\p{{L}}]+)([{MARKS}])[ \t]*$", 1)
        mark = F.regexp_extract("last", rf"([\p{{L}}]+)([{MARKS}])[ \t]*$", 2)
        outer = self.edges.select("chunk_id", F.lower(tail).alias("a"), mark.alias("mark"), F.regexp_extract("next_first", r"^\s*(\p{Ll}[\p{L}]*)", 1).alias("b")).filter("a <> '' and (b <> '' or mark <> '-')")
        both = inner.unionByName(outer).distinct()
        asked = both.select("a", "b").distinct()
        count = lambda name, word: self.words.select(F.col("word").alias(word), F.col("n").alias(name))
        asked = asked.withColumns({"joined": F.concat("a", "b"), "compound": F.concat("a", F.lit("-"), "b")})
        for word in ("joined", "compound", "a", "b"):
            asked = asked.join(count(f"n_{word}", word), word, "left").fillna(0, [f"n_{word}"])
        known = (F.col("n_joined") > 0) & (F.col("n_joined") >= F.col("n_compound"))
        unknown = (F.col("n_joined") == 0) & (F.col("n_compound") == 0) & ~((F.col("n_a") >= 20) & (F.col("n_b") >= 20))
        asked = asked.select("a", "b", (known | unknown).alias("one_word"))
        return both.join(asked, ["a", "b"]).filter(F.col("one_word") | (F.col("mark") != "-")).select("chunk_id", "a", "mark", "b")

    def misread_words(self) -> DataFrame:
        """(chunk_id, word, printed): the misread words of chunks with their repairs, and words whose letters are set apart."""
        paged = self.edges.filter("paged").select("chunk_id")
        apart = self.features.select("chunk_id", F.explode("apart").alias("word")).distinct()
        known = self.words.filter("n >= 5").select(F.col("word").alias("printed"))
        apart = apart.withColumn("printed", F.lower("word")).join(known, "printed", "left_semi").join(paged, "chunk_id", "left_semi")
        return self.repairs().unionByName(apart.select("chunk_id", "word", "printed"))

    def found(self) -> DataFrame:
        """(chunk_id, noise_kind): a row per chunk and kind."""
        kinds = ((self.divided(), "hyphenation"), (self.misread_words(), "misread"), (self.furniture(), "furniture"))
        parts = [df.select("chunk_id").distinct().select("chunk_id", F.lit(kind).alias("noise_kind")) for df, kind in kinds]
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    def repairs(self) -> DataFrame:
        """(chunk_id, word, printed): the repair of each misread word of a chunk; where several fit, its neighbours there decide.

        Pairs of words with a possible repair are counted over the whole corpus, in the pass that
        takes the features of the chunks. A repair is taken for what it and its neighbours say
        together: the frequency of the word, the cost of the confusion, and how often the repaired
        word stands beside these neighbours elsewhere.
        """
        several = self.misread.groupBy("word").agg(F.count("*").alias("n"), F.max_by("printed", F.struct("score", "printed")).alias("best"))
        places = self.features.select("chunk_id", F.explode("rare").alias("x")).select("chunk_id", "x.*").join(self.edges.filter("paged").select("chunk_id"), "chunk_id", "left_semi")
        sure = places.join(several.filter("n = 1"), "word").select("chunk_id", "word", F.col("best").alias("printed")).distinct()
        open_ = places.join(several.filter("n > 1").select("word"), "word", "left_semi").join(self.misread, "word")
        open_ = materialize(open_.select("chunk_id", "word", "before", "after", "printed", "score").distinct(), "open_repairs")
        pairs = self.features.select(F.explode("pairs").alias("x")).select("x.a", "x.b", "x.n")
        wanted = open_.select(F.col("before").alias("a"), F.col("printed").alias("b")).unionByName(open_.select(F.col("printed").alias("a"), F.col("after").alias("b"))).distinct()
        pairs = pairs.join(wanted, ["a", "b"], "left_semi").groupBy("a", "b").agg(F.sum("n").alias("n"))
        left = pairs.select(F.col("a").alias("before"), F.col("b").alias("printed"), F.col("n").alias("n_left"))
        right = pairs.select(F.col("b").alias("after"), F.col("a").alias("printed"), F.col("n").alias("n_right"))
        weighed = open_.join(left, ["before", "printed"], "left").join(right, ["after", "printed"], "left")
        total = F.col("score") + F.log1p(F.coalesce("n_left", F.lit(0))) + F.log1p(F.coalesce("n_right", F.lit(0)))
        picked = weighed.withColumn("total", total).groupBy("chunk_id", "word").agg(F.max_by("printed", F.struct("total", "printed")).alias("printed"))
        return sure.unionByName(picked)

    def paragraphs(self) -> DataFrame:
        """(doc_id, text): the scanned documents as continuous paragraphs without the noise.

        A line is continued by the next unless it ends a sentence, as the lines of a page do;
        a word divided at a page's end is joined with its rest on the next.
        """
        once = self.chunks.select("chunk_id", "doc_id", "reading_order", "content").filter("chunk_id is not null and length(content) > 0").dropDuplicates(["chunk_id"])
        edges = self.edges.filter("paged").select("chunk_id", "head", "foot")
        divided = materialize(self.divided(), "divided")
        repairs = self.repairs().groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("word", "printed"))).alias("repairs"))
        joins = divided.groupBy("chunk_id").agg(F.collect_set(F.struct("a", "b")).alias("joins"))
        ends = self.edges.select("chunk_id", F.lower(F.regexp_extract("last", rf"([\p{{L}}]+)[{MARKS}][ \t]*$", 1)).alias("a")).filter("a <> ''")
        ends = ends.join(divided.select("chunk_id", "a"), ["chunk_id", "a"], "left_semi").select("chunk_id", F.lit(True).alias("open_break"))
        apart = self.features.select("chunk_id", "apart").dropDuplicates(["chunk_id"])
        rows = once.join(edges, "chunk_id").join(repairs, "chunk_id", "left").join(joins, "chunk_id", "left").join(ends, "chunk_id", "left").join(apart, "chunk_id", "left")
        fixed = rows.mapInPandas(_repair, "chunk_id long, doc_id long, reading_order int, open_break boolean, text string")
        fixed = fixed.withColumn("text", F.when(F.col("open_break"), F.concat(F.regexp_replace("text", rf"[{MARKS}]\s*$", ""), F.lit("\x00"))).otherwise(F.concat("text", F.lit("\n"))))
        joined = fixed.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", "chunk_id", "text"))), lambda x: x["text"]), "").alias("text"))
        flowing = F.regexp_replace(F.regexp_replace("text", r"\x00\s*", ""), r"(?<![.!?:;»”\"\n])[ \t]*\n[ \t]*(?=[\p{Ll}\d(£€])", " ")
        return joined.select("doc_id", F.regexp_replace(F.regexp_replace(F.regexp_replace(flowing, r"[ \t]{2,}", " "), r"\s*\n\s*", "\n"), r"^\s+|\s+$", "").alias("text"))
