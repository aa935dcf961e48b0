"""Duplicates of each new batch among everything accepted before it.

Texts are landed once: their word codes (for verification) go to folders by batch and hash of the
id, their minwise keys to folders by batch. The keys of a text are the least hashes of its six-word
shingles, those of phrases that are frequent in the history last: one order for all texts, so near
texts have keys in common. Frequent is what falls into a slot of a counted sketch that 0.3 % of all
documents of the history fall into; sketch and share don't depend on their number. The index of what
is accepted holds the keys in folders by prefix and buckets by key. A batch reads the folders its own keys fall into, and keys of pairs and word codes only from the folders of the
candidates; it verifies the pairs that share enough keys, and appends the keys of what was
accepted. The history's texts are never processed again. Batches that are there together arrive together,
in order of (batch_no, doc_id): the index is read once for all of them.

Texts are compared without the lines of the site, page furniture, line breaks, case, punctuation,
typography and Unicode form. A pair is a repeat if the Jaccard similarity of its five-word shingles is
0.5 or more. One word in ten changed at random leaves 59 % of the shingles, but a similarity of 0.42,
and less in some texts, as does a text replaced by half; so pairs from 0.2 on are aligned word by word,
and are repeats if ``SAME_WORDS`` of the longer text's words are left in their order. A text of under
``SAME_LENGTH`` of the other's words repeats nothing of it.

Hot keys: a phrase in many unlike texts would pair them all, so a key with more than some documents
(``HOT``) is looked up only together with the next hot ones of its text: two texts that share many have
such rows in common. Candidates are the pairs with any row in common that share enough of their keys. Inside an arrival each document is held against a key's first ``PIVOTS``; those that this
shows to be repeats leave, and the others go on with the next ``PIVOTS``. Accepted documents most of
whose rows had ``PIVOTS`` documents before them (near copies within a history that is taken as it is)
stand in a second table, against which only those are held that the first didn't show to be
repeats. So a group of near copies costs its size, not its square, and no two unlike texts are left
unlinked. In such a group the original of a repeat is the first of those it was compared with.

Defined results: documents with null ids are left out; null or empty texts repeat nothing; exact
copies are decided once, through the first of them; ids delivered twice count once (the first
batch); extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from scrivenry.llm.site_lines import site_lines
from scrivenry.sources import materialize, shared_dir

#: Words of a shingle in comparisons and in keys; keys of a text, and how many of them a pair shares at least (an eighth of fewer keys).
SHINGLE, KEY_SHINGLE, KEYS, SHARED = 5, 6, 25, 3
#: A phrase is frequent from this share of the history's documents on, and from so many; slots of the sketch are the leading bits of a hash, counted in so many chunks.
FREQUENT_SHARE, FREQUENT, SLOT_BITS, CHUNKS = 0.003, 8, 22, 64
#: A key is hot if its slot has more than so many documents of the history and twice the mean; it is looked up together with each of the next so many hot keys of its text, and by itself where a text has fewer rows than the last.
HOT, NEXT_KEYS, FEW_ROWS = 16, 2, 6
#: The least similarity that is aligned, and the shares of words and length that then stay ("about one word in ten" differs).
ALIGNED, SAME_WORDS, SAME_LENGTH = 0.2, 0.87, 0.75
#: Documents of a key that a document is held against at a time.
PIVOTS = 256
_WORD = re.compile(r"[^\W_]+")
_OTHER = re.compile(r"[\W\d_]+")
_BREAK = re.compile(r"(?<=[^\W\d_])[-‐¬\u00ad][ \t]*\n\s*(?=[^\W\d_])")
_MARKS = re.compile("[\u0300-\u036f]+")
_HYPHENS = frozenset("-‐¬\u00ad")
_NUMBER_LINE = re.compile(r"[\W_]*(?:[^\W\d_]{1,6}[\W_]*)?(?:\d{1,4}|[ivxlc]{1,8})[\W_]*(?:(?:[^\W\d_]{1,4}|/)[\W_]*\d{1,4}[\W_]*)?")
_SIGNS = re.compile(r"[^\x00-\x7f\w]+")
_NO_LETTERS = bytes(b for b in range(128) if not chr(b).isalpha() and b != 10)
_LOWER_SPACED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()
_ASCII = bytes(range(128))
_rng = np.random.default_rng(5)
_MIX = _rng.integers(1, 2**62, KEY_SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def folded(text: str) -> str:
    """Lower case, without accents and other Unicode forms."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        if not text.isascii():
            text = _MARKS.sub("", text)
    return text


def plain_words(text: str, site: frozenset[int] = frozenset(), longest: int = 1 << 30) -> list[str]:
    """The words of a text that count in a comparison; ``site`` holds the hashes of the lines of its site, the longest of which has ``longest`` letters.

    A line is looked up in ``site`` by the letters it has before accents are taken off, as the lines were counted.
    """
    keep = []
    divided = False
    # The ASCII letters of all lines at once. A line of a page number has 18 of them at most.
    for line, letters in zip(text.split("\n"), text.encode("ascii", "ignore").translate(None, _NO_LETTERS).split(b"\n")):
        if len(letters) <= 18 and _NUMBER_LINE.fullmatch(line):
            continue
        if site and len(line) >= 20 and len(letters) <= longest and _line_hash(line, longest, letters) in site:
            continue
        keep.append(line)
        divided = divided or line.rstrip()[-1:] in _HYPHENS
    text = "\n".join(keep)
    plain = _plain_bytes(text)
    if plain is not None:
        if divided:
            plain = _BREAK.sub("", plain.decode()).encode()
        return plain.translate(_LOWER_SPACED).decode().split()
    text = folded(text)
    if divided:
        text = _BREAK.sub("", text)
    return _WORD.findall(_SIGNS.sub(" ", text))


class _Plain(dict):
    """What stands for a character beyond ASCII in a text that is taken by bytes: its folded form, with ``-`` for hyphens and ``|`` for other signs; None if the text has to be taken whole."""

    def __missing__(self, c: str) -> bytes | None:
        x = "".join("-" if y in _HYPHENS else "|" if _SIGNS.fullmatch(y) and not y.isspace() else y for y in folded(c))
        # A sigma's lower case depends on its place; capitals that a compatibility form has stay capitals.
        self[c] = y = x.encode() if x == x.lower() and c != "\u03a3" and not _SIGNS.search(x) else None
        return y


_PLAIN = _Plain()


def _plain_bytes(text: str) -> bytes | None:
    """``text`` with no signs but those of ASCII, so that its words are those of the folded text; None if that can't be said of each character by itself."""
    out = text.encode()
    if not text.isascii():
        for c in set(out.translate(None, _ASCII).decode()):
            x = _PLAIN[c]
            if x is None:
                return None
            out = out.replace(c.encode(), x)
    return out


def _line_hash(line: str, longest: int, letters: bytes | None = None) -> int | None:
    """The hash of the letters of a line, as lines of the site are counted; None of fewer than 20 or more than ``longest``. ``letters``: those within ASCII, where they are known."""
    if letters is None:
        letters = line.encode("ascii", "ignore").translate(None, _NO_LETTERS)
    if len(letters) > longest:
        return None
    own = letters.lower() if line.isascii() else _OTHER.sub("", line.lower())
    return xxhash.xxh64_intdigest(own, seed=42) if len(own) >= 20 else None


def shingles(codes: np.ndarray, words: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of so many words, each once; of a shorter text the one run it is."""
    n = len(codes) - words + 1
    if n < 1:
        codes = np.concatenate([codes, np.zeros(words - len(codes), codes.dtype)])
        n = 1
    codes = codes.astype(np.uint64) + np.uint64(1)
    h = np.zeros(n, np.uint64)
    for i in range(words):
        h += codes[i : n + i] * _MIX[i]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return np.unique(h ^ h >> np.uint64(29))


def slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _key_shingles(texts: list[np.ndarray], words: int = KEY_SHINGLE, at_once: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The hashes of the shingles of so many texts at once (with repeats), and of each hash the number of its text among them."""
    gap = np.zeros(words, np.uint16)
    for first in range(0, len(texts), at_once):
        some = texts[first : first + at_once]
        parts = [x for c in some for x in ((c, gap) if len(c) >= words else (c, gap[: words - len(c)], gap))]
        codes = np.concatenate(parts).astype(np.uint64) + np.uint64(1)
        n = len(codes) - words + 1
        h = np.zeros(n, np.uint64)
        for i in range(words):
            h += codes[i : n + i] * _MIX[i]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        own = np.maximum([len(c) for c in some], words) - words + 1
        # Between two texts stand the runs that hold words of the gap.
        inside = np.repeat(np.tile([True, False], len(some)), np.column_stack([own, np.full(len(some), 2 * words - 1)]).ravel())
        yield h[inside[:n]], np.repeat(np.arange(len(some), dtype=np.uint16), own)


def _by_text(x: np.ndarray, text: np.ndarray, n: int) -> list[np.ndarray]:
    """The values of each of ``n`` texts, in the order that they have."""
    return np.split(x[np.argsort(text, kind="stable")], np.cumsum(np.bincount(text, minlength=n))[:-1])


def least_keys(texts: list[np.ndarray], frequent: np.ndarray) -> list[np.ndarray]:
    """The keys of each text; ``frequent`` says of each slot whether it is."""
    out = []
    for h, text in _key_shingles(texts):
        late, n = frequent[slots(h)], int(text[-1]) + 1
        # The rare ones first. Of a text with many, those below a bound that leaves about 60: if they are enough, the least are among them.
        many = np.bincount(text[~late], minlength=n)
        bound = np.where(many > 80, 2.0**64 / np.maximum(many, 81) * 60, 2.0**63 * 1.99).astype(np.uint64)
        small = np.flatnonzero(~late & ((h < bound[text]) | (many <= 80)[text]))
        small = small[np.argsort(h[small])]
        small = small[np.argsort(text[small], kind="stable")]
        x, of = h[small], text[small]
        once = np.ones(len(x), bool)
        once[1:] = (x[1:] != x[:-1]) | (of[1:] != of[:-1])
        x, of = x[once], of[once]
        ends = np.cumsum(np.bincount(of, minlength=n))
        starts = np.cumsum(np.bincount(text, minlength=n))
        for i, (end, start) in enumerate(zip(ends, [0, *ends[:-1]])):
            if end - start < KEYS:
                own = slice(starts[i - 1] if i else 0, starts[i])
                rare = np.unique(h[own][~late[own]]) if many[i] > 80 else x[start:end]
                own_keys = rare if len(rare) >= KEYS else np.concatenate([rare, np.unique(h[own][late[own]])])
            else:
                own_keys = x[start:end]
            out.append(own_keys[:KEYS].view(np.int64))
    return out


def key_rows(keys: list[np.ndarray], hot: np.ndarray) -> list[np.ndarray]:
    """What each text is looked up by: its keys, the hot ones joined with the next hot ones; ``hot`` says of each slot whether it is."""
    if not keys:
        return []
    u = np.concatenate(keys).view(np.uint64)
    text = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    is_hot = hot[slots(u)]
    h, of = u[is_hot], text[is_hot]
    rows, owners = [u[~is_hot]], [text[~is_hot]]
    for d in range(1, NEXT_KEYS + 1):
        same = of[:-d] == of[d:]
        x = h[:-d][same] * _MIX[0] + h[d:][same] * _MIX[1]
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x9E3779B97F4A7C15)
        rows.append(x ^ x >> np.uint64(29))
        owners.append(of[:-d][same])
    few = (np.bincount(np.concatenate(owners), minlength=len(keys)) < FEW_ROWS)[of]
    return _by_text(np.concatenate([*rows, h[few]]).view(np.int64), np.concatenate([*owners, of[few]]), len(keys))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    x, y = shingles(a), shingles(b)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def words_in_order(a: np.ndarray, b: np.ndarray) -> int:
    """The length of the longest common subsequence of words, a row of it at a time as the bits of a number."""
    at: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b.tolist():
        u = v & at.get(y, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def nearness(a: np.ndarray, b: np.ndarray, bound: float) -> float | None:
    """The similarity of two texts that are near enough to be repeats; None of others."""
    s = similarity(a, b)
    if s >= bound:
        return s
    n, m = sorted((len(a), len(b)))
    return s if s >= ALIGNED and n >= SAME_WORDS * m and words_in_order(a, b) >= SAME_WORDS * m else None


class _Codes(dict):
    """The code of each word (16 bits), worked out once."""

    def __missing__(self, word: str) -> int:
        self[word] = c = zlib.crc32(word.encode()) & 0xFFFF
        return c


def _counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many documents of one task fall into each slot, in chunks."""
    n = np.zeros(1 << SLOT_BITS, np.uint32)
    for p in parts:
        seen = []
        for h, text in _key_shingles([np.frombuffer(c, np.uint16) for c in p["codes"]]):
            # Each slot once for a text: of equal numbers beside each other the first.
            x = np.sort(slots(h).astype(np.uint32) | text.astype(np.uint32) << np.uint32(SLOT_BITS))
            seen.append(x[np.concatenate([[True], x[1:] != x[:-1]])] & np.uint32(len(n) - 1))
        if seen:
            n += np.bincount(np.concatenate(seen), minlength=len(n)).astype(np.uint32)
    yield pd.DataFrame({"chunk": np.arange(CHUNKS), "n": [x.tobytes() for x in np.split(n, CHUNKS)]})


def _summed(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"chunk": [key[0]], "n": [sum(np.frombuffer(x, np.uint32).astype(np.uint64) for x in p["n"]).tobytes()]})


def _features(site: dict[str, tuple[frozenset[int], int]]):  # noqa: ANN202
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = _Codes()
        for p in parts:
            rows = []
            for source, text in zip(p["source_id"], p["text"]):
                if len(code) > 500_000:
                    code.clear()
                words = plain_words(text, *site.get(source, (frozenset(), 0)))
                codes = np.fromiter(map(code.__getitem__, words), np.uint16, len(words))
                rows.append((codes.tobytes(), xxhash.xxh64_intdigest(" ".join(words).encode()) - 2**63, len(words)))
            yield pd.concat([p[["doc_id", "batch_no", "part"]], pd.DataFrame(rows, columns=["codes", "exact", "n_words"], index=p.index)], axis=1)

    return run


_FEATURES = "doc_id long, batch_no int, part int, codes binary, exact long, n_words int"
_LANDED = "doc_id long, codes binary, exact long, n_words int, batch_no int, part int"


class Landed:
    """Texts made ready for comparison, each once: ``codes`` and, but for exact copies in one batch, ``keys``.

    ``docs`` may hold one batch or several. The lines of the site are those of the history (batch 0);
    their hashes are sent to the tasks, some tens per source, and over ``most_site_lines`` it is an error.
    """

    def __init__(self, docs: DataFrame, most_site_lines: int = 1_000_000, documents_a_part: int = 20_000) -> None:
        spark = self.spark = docs.sparkSession
        # An id delivered twice: its first batch counts; only ids are counted, and nothing more is done where all are unique.
        docs = docs.filter("doc_id is not null")
        rows, ids = docs.select("doc_id").groupBy("doc_id").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
        if rows > ids:
            at = Window.partitionBy("doc_id").orderBy(F.col("batch_no").asc_nulls_first(), F.xxhash64("text"))
            docs = docs.withColumn("_at", F.row_number().over(at)).filter("_at = 1").drop("_at")
        self.parts = max(1, ids // documents_a_part)
        own = docs.select("doc_id", F.coalesce("batch_no", F.lit(0)).cast("int").alias("batch_no"), "source_id", F.coalesce("text", F.lit("")).alias("text"))
        history = own.filter("batch_no = 0").select(F.col("doc_id").alias("chunk_id"), "doc_id", "source_id", F.lit(0).alias("reading_order"), F.col("text").alias("content"))
        found = site_lines(history).select("source_id", F.col("key.h").alias("h"), F.col("key.n").alias("n")).limit(most_site_lines + 1).collect()
        if len(found) > most_site_lines:
            raise ValueError("more lines of sites than may be sent to the tasks")
        site: dict[str, dict[int, int]] = {}
        for source, h, n in found:
            site.setdefault(source, {})[h % 2**64] = n
        shared = spark.sparkContext.broadcast({k: (frozenset(v), max(v.values())) for k, v in site.items()})
        path = f"{shared_dir(spark)}/scrivenry/landed-{uuid.uuid4().hex}"
        features = own.withColumn("part", self.part("doc_id")).mapInPandas(lambda parts: _features(shared.value)(parts), _FEATURES)
        features.repartition("batch_no", "part").write.partitionBy("batch_no", "part").parquet(path)
        self.codes = spark.read.schema(_LANDED).parquet(path)
        self._land_keys()

    def part(self, doc_id: str) -> Column:
        """The folder of a document's codes."""
        return F.pmod(F.xxhash64(doc_id), F.lit(self.parts)).cast("int")

    def _frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each slot, whether it is frequent in the history, and whether it is hot; all its documents are counted."""
        history = self.codes.filter("batch_no = 0 and n_words > 0").select("codes")
        counted = history.coalesce(CHUNKS).mapInPandas(_counted, "chunk long, n binary").groupBy("chunk").applyInPandas(_summed, "chunk long, n binary").orderBy("chunk").collect()
        n = np.concatenate([np.frombuffer(r[1], np.uint64) for r in counted]) if counted else np.zeros(1 << SLOT_BITS, np.uint64)
        return n >= max(FREQUENT, FREQUENT_SHARE * history.count()), n > HOT + 2 * n.mean()

    def _land_keys(self) -> None:
        bits = self.spark.sparkContext.broadcast([np.packbits(x) for x in self._frequent()])

        @F.pandas_udf("own array<int>, rows array<long>")
        def keys(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            frequent, hot = (np.unpackbits(x).view(bool) for x in bits.value)
            for codes in parts:
                own = least_keys([np.frombuffer(c, np.uint16) for c in codes], frequent)
                yield pd.DataFrame({"own": [k.astype(np.int32) for k in own], "rows": key_rows(own, hot)}, index=codes.index)

        read = self.codes.filter("n_words > 0")
        narrow = read.select("batch_no", "doc_id", "exact")
        firsts = narrow.groupBy("batch_no", "exact").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1")
        copies = narrow.join(firsts, ["batch_no", "exact"]).filter("doc_id <> first_id").select("batch_no", "doc_id", "first_id")
        self.copies = materialize(copies, "copies")
        own = read.join(self.copies.select("doc_id"), "doc_id", "left_anti").select("doc_id", "n_words", keys("codes").alias("k"), "batch_no", "part")
        path = f"{shared_dir(self.spark)}/scrivenry/keys-{uuid.uuid4().hex}"
        own.select("doc_id", "n_words", "k.own", "k.rows", "batch_no", "part").write.partitionBy("batch_no", "part").parquet(path)
        #: The keys of each text (``own``, 32 bits of each, are what a pair has to share) and the rows of the index that it is looked up by.
        self.texts = self.spark.read.schema("doc_id long, n_words int, own array<int>, rows array<long>, batch_no int, part int").parquet(path)
        self.keys = self.texts.select("doc_id", "n_words", F.explode("rows").alias("key"), "batch_no")


def _nearness(bound: float):  # noqa: ANN202
    least = min(bound, ALIGNED)

    @F.pandas_udf(DoubleType())
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        out, seen = [], np.zeros(1 << 16, bool)
        for first in range(0, len(a), 1024):
            x, y = a[first : first + 1024], b[first : first + 1024]
            # Most texts stand in several pairs: each is hashed once.
            codes = {c: np.frombuffer(c, np.uint16) for c in (*x, *y)}
            low = [p for h, text in _key_shingles(list(codes.values()), SHINGLE) for p in _by_text((h & np.uint64(0xFFFF)).astype(np.intp), text, int(text[-1]) + 1)]
            of = dict(zip(codes, low))
            for p, q in zip(x, y):
                # At least as many shingles in common as there are, of at most as many as there are: most pairs are far below the bound.
                seen[of[p]] = True
                both, own = np.count_nonzero(seen[of[q]]), np.count_nonzero(seen)
                seen[of[p]] = False
                out.append(nearness(codes[p], codes[q], bound) if both >= least * own else None)
        return pd.Series(out, dtype="float64")

    return near


class AcceptedIndex:
    """The keys of everything accepted so far; ``arrive`` takes the batches of ``landed`` in their order, one or several at a time.

    ``buckets`` and ``folders`` should fit the history that is expected: some hundred thousand keys a bucket, some buckets a folder.
    """

    def __init__(self, landed: Landed, min_similarity: float = 0.5, buckets: int = 12, folders: int = 1) -> None:
        self.landed, self.spark, self.min_similarity = landed, landed.spark, min_similarity
        self.buckets, self.folders = buckets, folders
        self.name = f"accepted_{uuid.uuid4().hex}"
        self.filled: set[str] = set()
        self.path = f"{shared_dir(self.spark)}/scrivenry/{self.name}"
        self._at = Window.partitionBy("key").orderBy("batch_no", "doc_id")

    def close(self) -> None:
        """Forget the names of the tables; their files stay."""
        for part in self.filled:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{part}")

    def _keys(self, *batches: int) -> DataFrame:
        folder = F.pmod(F.shiftrightunsigned("key", 40), F.lit(self.folders)).cast("int")
        # The number of the batch comes from the data, not as a literal: the code that Spark compiles for one batch serves the next.
        return self.landed.keys.filter(F.col("batch_no").isin(*batches)).select("key", "doc_id", "n_words", "batch_no", folder.alias("folder"))

    def _append(self, part: str, keys: DataFrame) -> None:
        rows = keys.select("key", F.col("doc_id").alias("old_id"), F.col("n_words").alias("old_words"), F.col("batch_no").alias("old_batch"), "folder")
        name = f"{self.name}_{part}"
        writer = rows.repartition(self.buckets, "key").write.partitionBy("folder").bucketBy(self.buckets, "key").option("path", f"{self.path}/{part}")
        writer.mode("append").saveAsTable(name)
        self.filled.add(part)

    @staticmethod
    def _crowded(keys: DataFrame) -> DataFrame | None:
        """The rows of keys that have more than ``PIVOTS`` documents."""
        crowded = materialize(keys.groupBy("key").count().filter(F.col("count") > PIVOTS).select("key"), "crowded")
        return None if crowded.isEmpty() else materialize(keys.join(crowded, "key", "left_semi"), "crowded_keys")

    def _accept(self, keys: DataFrame, crowded: DataFrame | None) -> None:
        """Append keys; documents that come after the first ``PIVOTS`` in at least half of their keys go to the second table."""
        if crowded is not None:
            beyond = crowded.withColumn("at", F.row_number().over(self._at)).filter(F.col("at") > PIVOTS).groupBy("doc_id").agg(F.count("*").alias("beyond"))
            near = materialize(beyond.filter(F.col("beyond") >= KEYS // 2).select("doc_id"), "near_copies")
            if not near.isEmpty():
                self._append("rest", keys.join(near, "doc_id", "left_semi"))
                keys = keys.join(near, "doc_id", "left_anti")
        self._append("first", keys)

    def accept_all(self, batch: int) -> None:
        """Take a batch as it is, unchecked (the history)."""
        keys = self._keys(batch)
        self._accept(keys, self._crowded(keys))

    def _known(self, part: str, folders: list[int]) -> DataFrame:
        """The index rows in the folders that a batch's keys fall into."""
        return self.spark.table(f"{self.name}_{part}").filter(F.col("folder").isin(folders)).select("key", "old_id", "old_words", "old_batch", F.lit(0).alias("inside"))

    def arrive(self, *batches: int) -> DataFrame:
        """(doc_id, original_id, similarity): the documents of the batches that repeat an accepted one; the others become accepted.

        Several batches arrive in order of (batch_no, doc_id): the result is that of one after the other, and the index is
        read once for all of them. Exact copies within a batch are left to ``of_copies``.
        """
        keys, batch = self._keys(*batches), max(batches)
        crowded = self._crowded(keys)
        folders = [r[0] for r in keys.select("folder").distinct().collect()] if self.folders > 1 else [0]
        shared = self._within(keys)
        if "first" in self.filled:
            shared = shared.unionByName(self._shared(self._known("first", folders), keys).drop("batch_no"))
        links = self._verified(self._enough(shared, batch), batch)
        if "rest" in self.filled:
            open_ = keys.join(links.filter("not inside").select("doc_id").distinct(), "doc_id", "left_anti")
            more = self._enough(self._shared(self._known("rest", folders), open_).drop("batch_no"), batch)
            links = materialize(links.unionByName(self._verified(more, batch)), "links")
        repeats = self._decide(links, crowded, batch)
        gone = repeats.select("doc_id")
        self._accept(keys.join(gone, "doc_id", "left_anti"), None if crowded is None else crowded.join(gone, "doc_id", "left_anti"))
        return repeats

    def _enough(self, shared: DataFrame, batch: int) -> DataFrame:
        """Pairs that share enough keys (an eighth of the document's), by the keys of both."""
        # The older batch and whether it is this arrival, in one number: they are the same in all rows of a pair.
        x = F.first(F.col("old_batch") * 2 + F.col("inside")).alias("x")
        pairs = materialize(shared.groupBy("doc_id", "old_id").agg(x), "near_keys")
        texts = self.landed.texts.filter(F.col("batch_no") <= batch)
        if self.landed.parts > 1:
            ends = pairs.select(F.explode(F.array(self.landed.part("doc_id"), self.landed.part("old_id"))).alias("part"))
            texts = texts.filter(F.col("part").isin([r[0] for r in ends.distinct().collect()]))
        a, b = texts.select("doc_id", F.col("own").alias("a")), texts.select(F.col("doc_id").alias("old_id"), F.col("own").alias("b"))
        least = F.least(F.lit(SHARED), F.ceil(F.size("a") * SHARED / KEYS))
        n = pairs.join(a, "doc_id").join(b, "old_id").filter(F.size(F.array_intersect("a", "b")) >= least)
        n = n.select("doc_id", "old_id", F.floor(F.col("x") / 2).cast("int").alias("old_batch"), (F.col("x") % 2 == 1).alias("inside"))
        return materialize(n, "pairs")

    @staticmethod
    def _shared(known: DataFrame, keys: DataFrame) -> DataFrame:
        """Keys shared with known documents of like length. The keys of the batch are hashed; the index is read bucket by bucket, unsorted and not shuffled."""
        like = F.least("n_words", "old_words") >= SAME_LENGTH * F.greatest("n_words", "old_words")
        return known.join(keys.hint("shuffle_hash"), "key").filter(like).select("doc_id", "batch_no", "old_id", "old_batch", "inside")

    def _within(self, keys: DataFrame) -> DataFrame:
        """Keys shared by two documents that arrive, the older one among the key's first ``PIVOTS``."""
        pivots = keys.withColumn("at", F.row_number().over(self._at)).filter(F.col("at") <= PIVOTS)
        pivots = pivots.select("key", F.col("doc_id").alias("old_id"), F.col("n_words").alias("old_words"), F.col("batch_no").alias("old_batch"), F.lit(1).alias("inside"))
        older = (F.col("old_batch") < F.col("batch_no")) | ((F.col("old_batch") == F.col("batch_no")) & (F.col("old_id") < F.col("doc_id")))
        return self._shared(pivots, keys).filter(older).drop("batch_no")

    def _verified(self, pairs: DataFrame, batch: int) -> DataFrame:
        """Those of the written ``pairs`` that are repeats, with their similarity. Codes are read from the folders of the pairs' documents."""
        side = lambda x: F.struct(F.col(x).alias("id"), self.landed.part(x).alias("part"), F.lit(x == "doc_id").alias("new"))
        pair = ["doc_id", "old_id", "old_batch", "inside"]
        ends = pairs.select(*pair, F.explode(F.array(side("doc_id"), side("old_id"))).alias("e"))
        ends = ends.select(*pair, F.col("e.id").alias("id"), F.col("e.part").alias("part"), F.col("e.new").alias("new"))
        parts = [r[0] for r in ends.select("part").distinct().collect()] if self.landed.parts > 1 else [0]
        codes = self.landed.codes.filter((F.col("batch_no") <= batch) & F.col("part").isin(parts)).select(F.col("doc_id").alias("id"), "codes")
        both = codes.join(ends, "id").groupBy(*pair).agg(F.max(F.when(F.col("new"), F.col("codes"))).alias("a"), F.max(F.when(~F.col("new"), F.col("codes"))).alias("b"))
        near = both.select(*pair, _nearness(self.min_similarity)("a", "b").alias("similarity"))
        return materialize(near.filter("similarity is not null"), "links")

    def _decide(self, links: DataFrame, rows: DataFrame | None, batch: int) -> DataFrame:
        """(doc_id, original_id, similarity): repeats of the accepted; a repeat is not accepted, so nothing repeats it in turn. ``rows``: those of crowded keys."""
        path = f"{self.path}/repeats-{batch}"

        def gone() -> DataFrame:
            return self.spark.read.schema("doc_id long").parquet(f"{path}-ids")

        links.filter("not inside").select("doc_id").distinct().write.parquet(f"{path}-ids")
        open_ = links.filter("inside").select("doc_id", "old_id")
        while True:
            # Links whose ends are both undecided; documents that still have to be held against later pivots can't be called accepted yet.
            open_ = open_.join(gone(), "doc_id", "left_anti").join(gone().toDF("old_id"), "old_id", "left_anti")
            open_ = materialize(open_, "open_links")
            if rows is not None:
                # Each key's first PIVOTS have been held against all its later documents.
                beyond = rows.withColumn("at", F.row_number().over(self._at)).filter(F.col("at") > PIVOTS).drop("at")
                rows = materialize(beyond.join(gone(), "doc_id", "left_anti"), "open_keys")
                if rows.isEmpty():
                    rows = None
            if open_.isEmpty() and rows is None:
                break
            accepted = open_.select("old_id").distinct().join(open_.select(F.col("doc_id").alias("old_id")).distinct(), "old_id", "left_anti")
            if rows is not None:
                accepted = accepted.join(rows.select(F.col("doc_id").alias("old_id")).distinct(), "old_id", "left_anti")
            open_.join(accepted, "old_id", "left_semi").select("doc_id").distinct().write.mode("append").parquet(f"{path}-ids")
            if rows is not None:
                rows = rows.join(gone(), "doc_id", "left_anti")
                more = self._verified(self._enough(self._within(rows), batch), batch)
                links = materialize(links.unionByName(more).dropDuplicates(["doc_id", "old_id"]), "links")
                open_ = open_.unionByName(more.select("doc_id", "old_id")).distinct()
        # Of all accepted documents that one repeats, the first is its original.
        accepted = links.join(gone().toDF("old_id"), "old_id", "left_anti")
        best = accepted.groupBy("doc_id").agg(F.min_by(F.struct("old_id", "similarity"), F.struct("old_batch", "old_id")).alias("o"))
        best.select("doc_id", F.col("o.old_id").alias("original_id"), F.col("o.similarity").alias("similarity")).write.parquet(path)
        return self.spark.read.schema("doc_id long, original_id long, similarity double").parquet(path)


def of_copies(repeats: DataFrame, copies: DataFrame) -> DataFrame:
    """``repeats`` and the exact copies inside one batch, which repeat what their first one repeats, or else that first one."""
    originals = repeats.select(F.col("doc_id").alias("first_id"), "original_id", "similarity")
    added = copies.join(originals, "first_id", "left").select(
        "doc_id", F.coalesce("original_id", "first_id").alias("original_id"), F.coalesce("similarity", F.lit(1.0)).alias("similarity")
    )
    return repeats.unionByName(added)


def duplicates(docs: DataFrame, min_similarity: float = 0.5, documents_a_bucket: int = 10_000, buckets_a_folder: int = 256) -> DataFrame:
    """(doc_id, original_id, similarity) over all batches after the history; those that are there arrive together, in their order."""
    landed = Landed(docs)
    sizes = {r[0]: r[1] for r in landed.codes.groupBy("batch_no").count().collect()}
    buckets = max(4, sum(sizes.values()) // documents_a_bucket)
    index = AcceptedIndex(landed, min_similarity, min(buckets, buckets_a_folder), -(-buckets // buckets_a_folder))
    if 0 in sizes:
        index.accept_all(0)
    later = [n for n in sorted(sizes) if n > 0]
    repeats = index.arrive(*later) if later else landed.spark.createDataFrame([], "doc_id long, original_id long, similarity double")
    index.close()
    return of_copies(repeats, landed.copies.filter("batch_no > 0").drop("batch_no"))
