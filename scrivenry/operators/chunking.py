"""Cutting texts into passages."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def packed(pieces: list[str], most: int, joiner: str, trim_cuts: bool = True) -> list[str]:
    """Pieces packed greedily up to ``most`` characters; a longer piece is cut hard and stands alone."""
    out: list[str] = []
    pack: list[str] = []
    used = 0
    for piece in pieces:
        n = len(piece)
        if pack and used + len(joiner) + n <= most:
            pack.append(piece)
            used += len(joiner) + n
            continue
        if pack:
            out.append(joiner.join(pack))
        pack, used = [], 0
        if n <= most:
            pack, used = [piece], n
        else:
            cuts = (piece[i : i + most] for i in range(0, n, most))
            out += [x for c in cuts if (x := c.strip())] if trim_cuts else list(cuts)
    return [*out, joiner.join(pack)] if pack else out


def _pieces(text: str, split: str) -> list[str]:
    if split == "blank":
        text = text.replace("\r\n", "\n")
        return [x for p in text.split("\n\n") if (x := p.strip())] or [x for p in text.split("\n") if (x := p.strip())]
    if split == "clause":
        return [x for p in " ".join(text.split()).replace("; ", ";\n").split("\n") if (x := p.strip())]
    return [x for p in text.split("\n") if (x := p.strip())]


def pack(docs: DataFrame, most: int = 2600, split: str = "line", joiner: str | None = None, trim_cuts: bool = True) -> DataFrame:
    """(doc_id, reading_order, content): trimmed non-empty pieces packed in order; a piece over ``most`` is cut hard.

    ``split``: ``line``, ``blank`` (paragraphs between blank lines, joined by one; lines where there
    is none) or ``clause`` (white space made single, cut behind each ``;``). Whether a piece still
    fits depends on all before it, so a document is packed in one pass of its task, linear in its length.
    """
    between = joiner if joiner is not None else "\n\n" if split == "blank" else "\n"

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else packed(_pieces(t, split), most, between, trim_cuts))

    return docs.select("doc_id", F.posexplode(cut("text")).alias("reading_order", "content"))


def structured_nodes(nodes: DataFrame) -> DataFrame:
    """(doc_id, reading_order, ref, content): texts, then tables, trimmed and not empty, numbered; a reference that came before gets ``:`` and the number.

    ``nodes``: (doc_id, kind, node_no, ref, content), kind ``text`` or ``table``.
    """
    rows = nodes.withColumn("content", F.trim("content")).filter("content <> ''")
    at = Window.partitionBy("doc_id").orderBy(F.when(F.col("kind") == "text", 0).otherwise(1), "node_no")
    rows = rows.withColumn("reading_order", F.row_number().over(at) - 1)
    again = F.row_number().over(Window.partitionBy("doc_id", "ref").orderBy("reading_order")) > 1
    return rows.select("doc_id", "reading_order", F.when(again, F.concat("ref", F.lit(":"), F.col("reading_order").cast("string"))).otherwise(F.col("ref")).alias("ref"), "content")


def windows(pages: DataFrame, size: int = 4000, stride: int = 3600) -> DataFrame:
    """(chunk_id, window_no, start, content): overlapping windows of each page; the last one reaches its end."""
    text = F.trim(F.replace("content", F.lit("\0"), F.lit("")))
    n = F.length("text")
    count = F.when(n <= size, 1).otherwise(1 + F.ceil((n - size) / stride)).cast("int")
    rows = pages.select("chunk_id", text.alias("text")).filter("text <> ''")
    rows = rows.select("chunk_id", "text", F.explode(F.sequence(F.lit(0), count - 1)).alias("window_no"))
    return rows.select("chunk_id", F.col("window_no").cast("long").alias("window_no"), (F.col("window_no") * stride).cast("long").alias("start"), F.substring("text", F.col("window_no") * stride + 1, F.lit(size)).alias("content"))
