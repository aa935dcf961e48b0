"""Text garbled by a wrong character decoding: finding it and putting it right.

A noisy channel: every word with a character outside ASCII is read as bytes under each of some
encodings, the bytes are decoded again in all ways a channel allows (lost bytes are wildcards), and
the readings are weighed by the frequencies of words and characters in the whole corpus. Over the
words of a record a Viterbi search chooses the channels, since damage comes in stretches.

Defined results: null and empty texts are clean; a replacement character or a C1 control is damage
whatever the words say; damage that no reading explains is reported and left as it is; rows
delivered twice count once; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scrivenry.sources import materialize

LOST = "�"
#: Encodings in which UTF-8 bytes were misread, and those in which Windows-1252 bytes were.
UTF8_READERS = ("cp1252", "cp1251", "cp1250", "cp437", "mac_roman", "cp850")
BYTE_READERS = ("mac_roman", "cp850", "cp437")
#: A word with a character outside ASCII, from white space to white space; the same in Java and Python.
TOKEN = r"(?<![^ \t\r\n])[\x00-\x08\x0b\x0c\x0e-\x1f\x21-\x7f]*+[^\x00-\x7f][^ \t\r\n]*+"
_TOKEN = re.compile(TOKEN)
#: The share of all words outside ASCII that a word within ASCII is taken to have.
COMMON = 0.0002
_EDGES = ".,;:!?()[]\"'"
SWITCH = {"clean": 0.0, **{f"u8:{r}": 1.0 for r in UTF8_READERS}, **{f"1b:{r}": 4.0 for r in BYTE_READERS}, "lost": 1.0}


def word_key(token: Column) -> Column:
    """A word without the punctuation around it, its digits made equal."""
    return F.regexp_replace(F.btrim(token, F.lit(_EDGES)), "[0-9]", "0")


def _key(token: str) -> str:
    return re.sub("[0-9]", "0", token.strip(_EDGES))


@lru_cache(maxsize=None)
def _bytes_of(reader: str) -> dict[str, int]:
    """The byte each character stands for; bytes without a character are read as controls, as browsers do."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(reader)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if reader == "cp1252":
        out.update({chr(b): b for b in range(128, 160)})
    return out


@lru_cache(maxsize=None)
def _sequences(reader: str) -> re.Pattern[str]:
    """UTF-8 sequences as they look under ``reader``; a continuation may be lost, at a word's end also a no-break space."""
    of = _bytes_of(reader)
    cls = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in of.items() if lo <= b <= hi) + "]"
    cont = "[" + LOST + "".join(re.escape(c) for c, b in of.items() if 128 <= b < 192) + "]"
    return re.compile(f"{cls(0xC2, 0xDF)}(?:{cont}|$)|{cls(0xE0, 0xEF)}{cont}{cont}|{cls(0xF0, 0xF4)}{cont}{{3}}")


def _fits(seq: str, reader: str, char: str) -> bool:
    """Whether ``char`` can have become ``seq``: its bytes are those of the sequence, wherever none was lost."""
    of, code = _bytes_of(reader), char.encode()
    codes = [of.get(c, -1) for c in seq]
    if len(codes) == 1 and codes[0] < 0xE0:
        codes.append(0xA0)
    return len(code) == len(codes) and all(x in (-1, y) for x, y in zip(codes, code))


def _decoded(seq: str, reader: str, known: dict[str, float]) -> str | None:
    """What a misread UTF-8 sequence stood for; with a lost byte the likeliest character of the corpus that fits."""
    of = _bytes_of(reader)
    codes = [of.get(c, -1) for c in seq]
    if codes[0] < 0xE0 and len(codes) == 1:
        codes.append(0xA0)
    if -1 in codes:
        return max((c for c in known if _fits(seq, reader, c)), key=lambda c: (known[c], c), default=None)
    try:
        return bytes(codes).decode("utf-8")
    except UnicodeDecodeError:
        return None


def readings(word: str, known: dict[str, float]) -> list[tuple[str, str]]:
    """(channel, what the word was) for each way in which it can have been garbled, as often as it was garbled.

    Where bytes were lost this is the likeliest path by characters alone (their costs add up, so
    each is chosen by itself); the words of the corpus that fit the lattice come by ``lattice``.
    """
    found: dict[tuple[str, str], None] = {}
    for reader in UTF8_READERS:
        w = word
        while _sequences(reader).search(w):
            new = _sequences(reader).sub(lambda m, r=reader: _decoded(m.group(), r, known) or m.group(), w).replace("\ufeff", "")
            if new == w or (f"u8:{reader}", new) in found:
                break
            w = new
            found[f"u8:{reader}", w] = None
    for reader in BYTE_READERS:
        of = _bytes_of(reader)
        try:
            x = "".join(bytes([of[c]]).decode("cp1252") if c in of else c for c in word)
        except UnicodeDecodeError:
            continue
        if x != word and not any(ord(c) > 127 and c not in of for c in word):
            found[f"1b:{reader}", x] = None
    return list(found)


def lattice(word: str) -> list[tuple[str, str]]:
    """(channel, mask) for each reader under which the word has a sequence with a lost byte: one wildcard for each of its characters outside ASCII."""
    out = []
    for reader in UTF8_READERS:
        if any(LOST in m.group() for m in _sequences(reader).finditer(word)):
            out.append((f"u8:{reader}", re.sub(r"[^\x00-\x7f]", LOST, _sequences(reader).sub(LOST, word))))
    return out


def fits(word: str, channel: str, was: str) -> bool:
    """Whether ``was`` is a path through the lattice of ``word``: its bytes are there wherever none was lost."""
    reader = channel.partition(":")[2]
    at = 0
    for m in _sequences(reader).finditer(word):
        plain, place = word[at : m.start()], m.start() - at
        if was[:place] != plain or place >= len(was) or not _fits(m.group(), reader, was[place]):
            return False
        was, at = was[place + 1 :], m.end()
    return was == word[at:]


def _generate(known: dict[str, float]):  # noqa: ANN202
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for key in p["key"]:
                if LOST in key:
                    rows.append((key, "lost", re.sub(r"[^\x00-\x7f]", LOST, key), True))
                    rows += [(key, channel, x, True) for channel, x in lattice(key)]
                rows += [(key, channel, x, False) for channel, x in readings(key, known)]
            yield pd.DataFrame(rows, columns=["key", "channel", "was", "masked"])

    return run


def _fitting(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        ok = [c == "lost" or w is None or fits(k, c, w) for k, c, w in zip(p["key"], p["channel"], p["word"])]
        yield p[ok]


def _char_cost(known: dict[str, float]):  # noqa: ANN202
    floor = min(known.values(), default=0.0) - 2.0  # a character alone is a word: its own frequency says it all

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            yield p.assign(chars=[0.0 if len(w) == len(k) == 1 else math.fsum(known.get(c, floor) for c in w if ord(c) > 127) for w, k in zip(p["was"], p["key"])])

    return run


def viterbi(words: list[list[tuple[str, float, str]]]) -> list[tuple[str, str]]:
    """The best (channel, reading) of each word; entering a channel costs, staying in it doesn't."""
    paths: dict[str, tuple[float, list[tuple[str, str]]]] = {"clean": (0.0, [])}
    for options in words:
        new: dict[str, tuple[float, list[tuple[str, str]]]] = {}
        for channel, score, was in options:
            total, path = max(((s - (0.0 if c == channel else SWITCH[channel]), p) for c, (s, p) in paths.items()), key=lambda x: x[0])
            if channel not in new or total + score > new[channel][0]:
                new[channel] = (total + score, [*path, (channel, was)])
        paths = new
    return max(paths.values(), key=lambda x: x[0])[1]


def _search(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        rows = []
        for kind, rid, suspects in zip(p["record_type"], p["record_id"], p["suspects"]):
            suspects = sorted(suspects, key=lambda s: s["at"])
            words = [[(o["channel"], o["score"], o["was"]) for o in s["options"]] for s in suspects]
            for s, (channel, was) in zip(suspects, viterbi(words)):
                sure = any(c == LOST or 128 <= ord(c) < 160 for c in s["token"])
                if channel != "clean" or sure:
                    token, key = s["token"], s["key"]
                    core = token.strip(_EDGES)
                    at = token.find(core)
                    # Digits were made equal in the key; they come back in their order, as no channel touches them.
                    digits = iter(re.findall("[0-9]", core))
                    fixed = re.sub("0", lambda m: next(digits, m.group()), was) if was.count("0") == key.count("0") else core
                    rows.append((kind, rid, s["at"], token, token[:at] + fixed + token[at + len(core) :]))
        yield pd.DataFrame(rows, columns=["record_type", "record_id", "at", "token", "restored"])


def text_records(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(record_type, record_id, text): contents of chunks and titles of documents."""
    return chunks.select(F.lit("chunk").alias("record_type"), F.col("chunk_id").alias("record_id"), F.col("content").alias("text")).unionByName(
        documents.select(F.lit("title").alias("record_type"), F.col("doc_id").alias("record_id"), F.col("title").alias("text"))
    ).filter("record_id is not null and text is not null")


def damaged_words(records: DataFrame) -> DataFrame:
    """(record_type, record_id, at, token, restored): ``at`` counts the words outside ASCII of the record from 0."""
    spark = records.sparkSession
    words = records.select("record_type", "record_id", F.posexplode(F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0))).alias("at", "token"))
    words = materialize(words.withColumn("key", word_key(F.col("token"))), "words_outside_ascii")
    lexicon = materialize(words.groupBy("key").agg(F.count("*").alias("n")), "lexicon")
    # Frequencies of the characters outside ASCII: at most as many rows as Unicode has characters.
    chars = lexicon.select(F.explode(F.regexp_extract_all("key", F.lit(r"[^\x00-\x7f]"), F.lit(0))).alias("c"), "n").groupBy("c").agg(F.sum("n").alias("n")).collect()
    total = sum(r["n"] for r in chars) or 1
    known = {r["c"]: math.log(r["n"] / total) for r in chars}
    shared = spark.sparkContext.broadcast(known)
    generated = lexicon.select("key").mapInPandas(lambda parts: _generate(shared.value)(parts), "key string, channel string, was string, masked boolean")
    # A word with lost bytes or characters: the corpus words that are a path through its lattice, all of them.
    generated = materialize(generated, "readings")
    asked = generated.filter("masked").select("key", "channel", F.col("was").alias("mask"))
    words_of = lexicon.filter(~F.contains("key", F.lit(LOST))).select(F.regexp_replace("key", r"[^\x00-\x7f]", LOST).alias("mask"), F.col("key").alias("word"), F.col("n").alias("n_word"))
    fitting = asked.join(words_of, "mask", "left").select("key", "channel", "word", "n_word").mapInPandas(_fitting, "key string, channel string, word string, n_word long")
    # Paths through one channel differ by the frequency of the word alone: the search would take the most frequent.
    fitting = fitting.groupBy("key", "channel").agg(F.max_by("word", F.struct("n_word", "word")).alias("word"))
    masked = fitting.filter("channel = 'lost' or word is not null").select("key", "channel", F.coalesce("word", "key").alias("was"))
    options = generated.filter("not masked").select("key", "channel", "was").unionByName(masked).distinct()
    options = options.unionByName(options.select("key").distinct().select("key", F.lit("clean").alias("channel"), F.col("key").alias("was")))
    counted = options.join(lexicon.select(F.col("key").alias("was"), "n"), "was", "left")
    # A reading within ASCII isn't in the lexicon (of words outside it); it is as likely as a common one: a share of all words, whatever their number.
    common = max(1, lexicon.agg(F.sum("n")).first()[0] or 0) * COMMON
    seen = F.when(~F.col("was").rlike(r"[^\x00-\x7f]"), F.lit(common)).otherwise(F.coalesce("n", F.lit(0)))
    scored = counted.withColumn("n", seen.cast("double")).mapInPandas(lambda parts: _char_cost(shared.value)(parts), "was string, key string, channel string, n double, chars double")
    scored = scored.withColumn("score", F.log(F.col("n") + 0.05) + F.col("chars"))
    sure = F.col("key").rlike(f"[{LOST}\\x80-\\x9f]")
    best = F.max(F.when(F.col("channel") != "clean", F.col("score"))) - F.max(F.when(F.col("channel") == "clean", F.col("score")))
    suspects = scored.groupBy("key").agg(F.collect_list(F.struct("channel", "score", "was")).alias("options"), best.alias("gain")).filter((F.col("gain") > 0) | sure).drop("gain")
    suspects = materialize(suspects, "suspect_words")
    unexplained = words.filter(sure).select("key").distinct().join(suspects.select("key"), "key", "left_anti")
    none = F.array(F.struct(F.lit("clean").alias("channel"), F.lit(0.0).alias("score"), F.col("key").alias("was")))
    suspects = suspects.unionByName(unexplained.select("key", none.alias("options")))
    by_record = words.join(suspects, "key").groupBy("record_type", "record_id").agg(F.collect_set(F.struct("at", "token", "key", "options")).alias("suspects"))
    return by_record.mapInPandas(_search, "record_type string, record_id long, at int, token string, restored string")


def restored_text(records: DataFrame, damaged: DataFrame) -> DataFrame:
    """(record_type, record_id, damaged_text, text): the damaged records with their words put right."""
    changes = damaged.groupBy("record_type", "record_id").agg(F.map_from_entries(F.collect_set(F.struct("at", "restored"))).alias("changes"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            fixed = []
            for text, changes in zip(p["text"], p["changes"]):
                new, n = dict(changes), iter(range(len(text) + 1))
                fixed.append(_TOKEN.sub(lambda m: new.get(next(n), m.group()), text))  # noqa: B023
            yield pd.DataFrame({"record_type": p["record_type"], "record_id": p["record_id"], "damaged_text": p["text"], "text": fixed})

    once = records.dropDuplicates(["record_type", "record_id"])
    return once.join(changes, ["record_type", "record_id"]).mapInPandas(run, "record_type string, record_id long, damaged_text string, text string")
