"""Mixing sources to target shares of tokens.

Tokens are summed per source, a repetition rate is derived for each, and every document comes out
floor(rate) times and once more with the probability of the fraction, drawn from a hash of its id.

Defined results: null or empty texts have no tokens and are still emitted; a source without tokens
or without a target is left out; documents delivered twice under one id count once.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivenry.sources import materialize


@lru_cache(maxsize=2)
def _encoding(path: str):  # noqa: ANN202
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(docs: DataFrame, tokenizer: str = "/opt/tokenizers/byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, source_id, n_tokens): tokens of each whole text under the byte-level vocabulary at ``tokenizer``."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoding(tokenizer).encode_ordinary
        # One word of a text is encoded at a time inside the library; a word of megabytes would be quadratic there.
        for p in parts:
            n = [0 if t is None else sum(len(encode(x)) for x in _pieces(t)) for t in p["text"]]
            yield pd.DataFrame({"doc_id": p["doc_id"], "source_id": p["source_id"], "n_tokens": n})

    own = docs.select("doc_id", "source_id", "text")
    return own.mapInPandas(count, "doc_id long, source_id string, n_tokens long")


def _pieces(text: str, run: int = 50_000) -> list[str]:
    """The text, cut inside unbroken runs of over ``run`` characters only (such a run is no word): whatever else it holds stays whole."""
    if len(text) <= run:
        return [text]
    cuts = [0, *(i for m in re.finditer(rf"\S{{{run + 1},}}", text) for i in range(m.start() + run, m.end(), run)), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def mix_rates(tokens: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """(source_id, target_share, max_repeats, n_docs, source_tokens, rate): how often each source's documents are to be used.

    Without ``total_tokens`` the mixture is as large as all caps allow: the least of
    max_repeats * tokens / share over the sources.
    """
    size = tokens.groupBy("source_id").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("source_tokens"))
    wish = targets.filter("target_share > 0 and max_repeats > 0").groupBy("source_id").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    both = size.filter("source_tokens > 0").join(wish, "source_id")
    most = both.agg(F.min(F.col("max_repeats") * F.col("source_tokens") / F.col("target_share")).alias("most"))
    total = F.col("most") if total_tokens is None else F.least(F.col("most"), F.lit(float(total_tokens)))
    # Rounded, so that the source that sets the size gets its whole cap and not one ulp less.
    rate = F.least(F.round(F.col("target_share") * total / F.col("source_tokens"), 9), F.col("max_repeats").cast("double"))
    return both.crossJoin(F.broadcast(most)).select("source_id", "target_share", "max_repeats", "n_docs", "source_tokens", rate.alias("rate"))


def mix(tokens: DataFrame, rates: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, source_id, n_tokens, copies): how often each document is used; the same for the same seed in any partitioning."""
    unit = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    copies = F.floor("rate") + (unit < F.col("rate") - F.floor("rate")).cast("long")
    # A row per target source: the caller's list, which doesn't grow with the documents.
    return tokens.join(F.broadcast(rates.select("source_id", "rate")), "source_id").select("doc_id", "source_id", "n_tokens", copies.alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """(doc_id, source_id, copy_no, n_tokens): a row for each use of a document."""
    return mixed.filter("copies > 0").select("doc_id", "source_id", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy_no"), "n_tokens")


def mix_report(mixed: DataFrame, rates: DataFrame) -> DataFrame:
    """(source_id, target_share, share, rate, max_repeats, most_repeats, docs, copies, tokens): what was reached."""
    got = mixed.groupBy("source_id").agg(F.sum("copies").alias("copies"), F.max("copies").alias("most_repeats"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    all_tokens = got.agg(F.sum("tokens").alias("all_tokens"))
    return got.join(rates, "source_id").crossJoin(F.broadcast(all_tokens)).select(
        "source_id", "target_share", (F.col("tokens") / F.col("all_tokens")).alias("share"), "rate", "max_repeats", "most_repeats", F.col("n_docs").alias("docs"), "copies", "tokens"
    )


def counted_once(docs: DataFrame, targets: DataFrame, **options: str) -> DataFrame:
    """Token counts of the documents of the targeted sources, kept in the shared folder (they are used twice)."""
    own = docs.join(F.broadcast(targets.select("source_id").distinct()), "source_id", "left_semi").filter("doc_id is not null")
    return materialize(count_tokens(own, **options).dropDuplicates(["doc_id"]), "tokens")
