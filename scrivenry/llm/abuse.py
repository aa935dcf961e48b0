"""Scores for abusive, hateful or sexually explicit language.

Each text is described by dense features around its densest passage: densities of the words of a
general lexicon by kind, their nearness to a second person, rates of capitals, punctuation and
disguised spellings. Gradient-boosted trees are fitted on the labelled rows, in two halves; each
half's scores are calibrated by isotonic regression on the other half, and the two are averaged.

The lexicon is a parameter. What each of its words weighs is learned from the labels, and words and
word pairs are added to it if they stand in texts labelled abusive that it doesn't explain. Words
that go along with abuse of every wording ("the sender wrote ...") are no abuse: a gram that is as
frequent beside abuse the lexicon does explain is left out.

Defined results: null and empty texts have features of zero; labels that are null or in a tie are
not used; without labels of both kinds the score comes from the lexicon alone; documents
delivered twice under one id are scored once; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivenry.sources import materialize

#: A general list by kind, without accents, in English, French, German and Swahili. Common words in it weigh little unless the labels say more.
LEXICON = {
    "insult": (
        "idiot idiots moron morons imbecile cretin bastard bastards asshole arsehole scumbag scum dickhead dumbass jerk loser bitch whore slut cunt wanker prick twat swine pig rat leech parasite coward filth trash "
        "worthless brainless stupid pathetic disgusting filthy stinking slimy gutless "
        "connard connasse salaud salope salopard putain pute enfoire abruti ordure dechet batard gueule bouffon "
        "arschloch wichser hurensohn hure schlampe drecksau drecksack schwein abschaum vollidiot trottel fresse miststuck missgeburt "
        "mjinga mpumbavu pumbavu mshenzi malaya kahaba mbwa takataka"
    ).split(),
    "threat": (
        "kill murder strangle choke drown drowned hang rope slap stab shoot burn smash break punch beat throat rot bleed starve die hell "
        "tuer crever egorger etrangler pendre bruler noyer umbringen verrecken verrecke abstechen erwurgen ersaufen totschlagen nitakuua nitakupiga nitakuvunja kufa"
    ).split(),
    "hate": (
        "vermin cockroach cockroaches subhuman savages plague disease exterminate eradicate deport sterilise sterilize inferior breed thief thieves liar liars whip dead "
        "vermine racaille cafards exterminer ungeziefer ausrotten ausgerottet untermenschen gesindel ratten kunguni wachafu nguruwe wafukuzwe wauawe wachomwe"
    ).split(),
    "sexual": (
        "naked nude sex sexy orgy porn fuck fucking cock pussy tits lick suck moan moaning orgasm strip undress horny herself legs "
        "nue baiser chatte sucer deshabiller nackt ficken titten lecken ausziehen stohnen uchi nguo kutomba mkundu"
    ).split(),
}
#: Words of the list that hardly have another use.
STRONG = frozenset(
    "idiot idiots moron morons imbecile cretin asshole arsehole scumbag dickhead dumbass wanker twat slut cunt whore brainless gutless connard connasse salaud salope salopard putain pute enfoire abruti "
    "arschloch wichser hurensohn schlampe drecksau drecksack abschaum vollidiot missgeburt mpumbavu pumbavu mshenzi malaya kahaba subhuman untermenschen gesindel orgy fuck fucking horny kutomba nitakuua".split()
)
#: Words that address somebody.
SECOND_PERSON = frozenset("you your yours yourself tu toi ton ta tes te vous votre du dich dir dein deine deinen ihr euch wewe wako yako lako mwako".split())
_TOKEN = re.compile(r"[^\W_]+(?:[*@$!][^\W_*@$!]*)*[^\W_]|[^\W_]+")
_BREAK = re.compile(r"(?<=[^\W\d_])[-‐¬­][ \t]*\n\s*(?=[^\W\d_])")
_MARKS = re.compile("[̀-ͯ]+")
_LEET = str.maketrans("013457@$!", "oieastasi")
_REPEAT = re.compile(r"([^\W\d_])\1{2,}")
#: Words of the passage that is described, and of the text beside a known word in which frame words are counted.
WINDOW, BESIDE = 14, 25
#: What a strong and another word of the list weighs before any label is seen, and from where a passage counts as explained.
STRONG_PRIOR, PRIOR, EXPLAINED = 3.0, 0.7, 3.0
FEATURES = (
    "weight_peak", "weight_wide", "weight_density", "insult_peak", "threat_peak", "hate_peak", "sexual_peak", "learned_peak", "strong_density", "list_density",
    "near_second_person", "capitals", "exclamations", "quotes", "disguised", "stretched",
)


def plain(text: str) -> str:
    text = text.lower()
    if "\n" in text:
        text = _BREAK.sub("", text)
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return text


def undisguised(token: str) -> str:
    """A word with digits and signs for letters, or letters drawn out, as it was meant; stars stay."""
    if len(token) < 4 and token.isalpha():
        return token
    if token.isdigit():
        return "0"
    return _REPEAT.sub(r"\1", token if token.isalpha() else token.translate(_LEET))


class Lexicon(dict):
    """Words by kind with their weights. As a dict: each token as it was meant, worked out once; stars are looked up by ends and length.

    ``counts`` holds (abusive, other) labelled texts of words of the list and of learned grams,
    ``sizes`` the labelled texts of either kind.
    """

    def __init__(self, kinds: Mapping[str, Sequence[str]] = LEXICON, counts: Mapping[str, tuple[float, float]] | None = None, sizes: tuple[float, float] = (0.0, 0.0)) -> None:
        super().__init__()
        self.kind = {w: k for k, words in enumerate(kinds.values()) for w in words}
        self.counts, self.sizes = dict(counts or {}), sizes
        grams = [*self.kind, *(g for g in self.counts if g not in self.kind)]
        self.weight = {g: self.weigh(g) for g in grams}
        #: Words that can begin an entry: all that a text is scanned for.
        self.heads = {g.split(" ")[0] for g in grams}
        self.masked: dict[tuple[str, str, int], str] = {}
        for w in grams:
            if " " not in w:
                self.masked.setdefault((w[0], w[-1], len(w)), w)

    def weigh(self, gram: str, label: int | None = None) -> float:
        """Log of how much more frequent a gram is in abusive texts, drawn to its prior while few texts hold it; ``label``: of a text whose part is taken out."""
        prior = STRONG_PRIOR if gram in STRONG else PRIOR if gram in self.kind else 0.0
        a, b = self.counts.get(gram, (0.0, 0.0))
        pos, neg = self.sizes
        a, b = max(0.0, a - (label == 1)), max(0.0, b - (label == 0))
        if min(pos, neg) < 2:
            return prior
        pseudo = 1.5
        return max(0.0, min(6.0, math.log((a / pos * neg + pseudo * math.exp(prior)) / (b + pseudo))))

    def __missing__(self, token: str) -> str:
        w = undisguised(token)
        if "*" in w:
            w = self.masked.get((w[0], w[-1], len(w)), w)
        self[token] = w
        return w

    def words(self, text: str) -> tuple[list[str], list[str]]:
        """(words as they were meant, tokens as they stand); letters set apart are one word."""
        if len(self) > 500_000:
            self.clear()
        tokens = _TOKEN.findall(plain(text))
        if sum(1 for t in tokens if len(t) == 1) > 2:
            tokens = _joined(tokens)
        return [self[t] for t in tokens], tokens

    def hits(self, words: list[str], label: int | None = None) -> list[tuple[int, str, float]]:
        """(place, gram, weight) of the entries in a text, in order of place."""
        out = []
        for i in [i for i, w in enumerate(words) if w in self.heads]:
            for g in (words[i], f"{words[i]} {words[i + 1]}" if i + 1 < len(words) else ""):
                if g in self.weight:
                    w = self.weight[g] if label is None or g not in self.counts else self.weigh(g, label)
                    if w > 0:
                        out.append((i, g, w))
        return out


def _joined(tokens: list[str]) -> list[str]:
    """Runs of three and more single letters made one token."""
    out: list[str] = []
    run: list[str] = []
    for t in [*tokens, ""]:
        if len(t) == 1 and t.isalpha():
            run.append(t)
            continue
        out += ["".join(run)] if len(run) > 2 else run
        run = []
        if t:
            out.append(t)
    return out


def grams(words: Sequence[str]) -> set[str]:
    return {w for w in words if len(w) > 2} | {f"{a} {b}" for a, b in zip(words, words[1:])}


def _densest(hits: list[tuple[int, str, float]], width: int) -> tuple[float, int, int]:
    """(sum, first, last + 1): the run of hits within ``width`` words that weighs most."""
    best, lo, total = (0.0, 0, 0), 0, 0.0
    for hi, (i, _, w) in enumerate(hits):
        total += w
        while hits[lo][0] <= i - width:
            total -= hits[lo][2]
            lo += 1
        if total > best[0]:
            best = (total, lo, hi + 1)
    return best


def describe(text: str, lexicon: Lexicon, label: int | None = None) -> list[float]:
    """The features of a text. With a label its own part in the weights is taken out, so that training sees what others taught."""
    words, tokens = lexicon.words(text)
    n = len(words)
    hits = lexicon.hits(words, label)
    if not hits:
        return [0.0] * len(FEATURES)
    peak, lo, hi = _densest(hits, WINDOW)
    passage = hits[lo:hi]
    first, last = passage[0][0], min(n, passage[-1][0] + 1)
    by_kind = [0.0] * 4
    for _, g, _w in passage:
        if g in lexicon.kind:
            by_kind[lexicon.kind[g] % 4] += 1.0 / WINDOW
    learned = sum(w for _, g, w in passage if g not in lexicon.kind)
    second = [i for i in range(max(0, first - 5), min(n, last + 5)) if words[i] in SECOND_PERSON]
    near = sum(1 for i, _, _ in passage if any(abs(i - j) <= 5 for j in second)) / len(passage)
    # The passage as it stands, found again by its share of the tokens.
    spelt = _TOKEN.findall(text[max(0, len(text) * first // n - 60) : len(text) * last // n + 60])
    span = text[max(0, len(text) * first // n - 40) : len(text) * last // n + 40]
    capitals = sum(x.isupper() and len(x) > 2 for x in spelt) / max(1, len(spelt))
    changed = [tokens[i] for i, g, _ in passage if tokens[i] != words[i] and not tokens[i].isdigit()]
    return [
        peak, _densest(hits, 3 * WINDOW)[0], 100.0 * sum(w for _, _, w in hits) / (n + 50), *by_kind, learned,
        100.0 * sum(g in STRONG for _, g, _ in hits) / (n + 50), 100.0 * sum(g in lexicon.kind for _, g, _ in hits) / (n + 50),
        near, capitals, span.count("!") / max(1, len(span)) * 100, sum(span.count(q) for q in "\"“”«»") / max(1, len(span)) * 100,
        len(changed) / len(passage), sum(1 for t in changed if _REPEAT.search(t)) / len(passage),
    ]


def labelled_sample(documents: DataFrame, labels: DataFrame, most_labels: int = 20_000) -> DataFrame:
    """(doc_id, text, y): documents whose labels agree by majority; at most about ``most_labels``, chosen by hash."""
    votes = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("toxic").alias("vote")).filter("vote <> 0.5")
    total = votes.count()
    if total > most_labels:
        votes = votes.filter(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(total)) < most_labels)
    texts = documents.select("doc_id", "text").join(votes, "doc_id").dropDuplicates(["doc_id"])
    return texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("vote") > 0.5).cast("int").alias("y"))


def learn_lexicon(sample: DataFrame, kinds: Mapping[str, Sequence[str]] = LEXICON, support: float = 0.006, excess: float = 12.0, frame: float = 2.0, ratio: float = 18.0) -> Lexicon:
    """The list with counts from the labels, and the grams that they add.

    A gram is added if it stands in at least 3 and a share of ``support`` of the abusive texts that
    the list doesn't explain, ``excess`` times as often as in other texts with a log-likelihood
    ratio of ``ratio`` or more (so that few of the many grams pass by chance), and ``frame`` times
    as often as beside abuse that the list explains. At most 1 / ``support`` times the grams of a text are added.
    """
    base = Lexicon(kinds)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = []
            for text, y in zip(p["text"], p["y"]):
                words, _ = base.words(text)
                hits = base.hits(words)
                rows += [(g, "list", y) for g in {g for _, g, _ in hits}]
                total, lo, hi = _densest(hits, WINDOW)
                if y and total >= EXPLAINED:
                    rows.append(("", "explained", y))
                    rows += [(g, "explained", y) for g in grams(words[max(0, hits[lo][0] - BESIDE) : hits[hi - 1][0] + BESIDE])]
                else:
                    rows.append(("", "other", y))
                    rows += [(g, "other", y) for g in grams(words) if g not in base.kind]
            yield pd.DataFrame(rows, columns=["gram", "part", "y"]).astype({"gram": "object", "part": "object", "y": "int64"})

    counts = sample.select("text", "y").mapInPandas(run, "gram string, part string, y long").groupBy("gram", "part").agg(F.sum("y").alias("a"), F.sum(1 - F.col("y")).alias("b"))
    counts = materialize(counts, "grams")
    sizes = {r["part"]: (float(r["a"]), float(r["b"])) for r in counts.filter("gram = ''").collect()}
    explained, (open_, neg) = sizes.get("explained", (0.0, 0.0))[0], sizes.get("other", (0.0, 0.0))
    listed = {r["gram"]: (float(r["a"]), float(r["b"])) for r in counts.filter("part = 'list'").collect()}
    other = counts.filter("part = 'other' and gram <> ''").filter((F.col("a") >= max(3.0, support * open_)) & (F.col("a") / max(1.0, open_) >= excess * (F.col("b") + 0.5) / max(1.0, neg)))
    total, share = F.col("a") + F.col("b"), max(1.0, open_) / max(1.0, open_ + neg)
    other = other.filter(2 * (F.col("a") * F.log(F.col("a") / (total * share)) + F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (total * (1 - share)))).otherwise(0.0)) >= ratio)
    beside = counts.filter("part = 'explained'").select("gram", F.col("a").alias("e"))
    added = other.join(beside, "gram", "left").filter(F.col("a") / max(1.0, open_) >= frame * F.coalesce("e", F.lit(0.0)) / max(1.0, explained))
    grown = {r["gram"]: (float(r["a"]), float(r["b"])) for r in added.select("gram", "a", "b").collect()}
    return Lexicon(kinds, {**grown, **listed}, (explained + open_, neg))


def _described(docs: DataFrame, lexicon: Lexicon, labelled: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            labels = p["y"] if labelled else [None] * len(p)
            rows = [describe(t, shared.value, y) for t, y in zip(p["text"], labels)]
            out = pd.DataFrame(rows, columns=list(FEATURES), dtype="float64")
            out.insert(0, "doc_id", p["doc_id"].to_numpy())
            if labelled:
                out.insert(1, "y", p["y"].to_numpy())
            yield out

    schema = "doc_id long, " + ("y int, " if labelled else "") + ", ".join(f"{f} double" for f in FEATURES)
    return docs.mapInPandas(run, schema)


def score(documents: DataFrame, labels: DataFrame, trees: int = 20, depth: int = 3, seed: int = 1, lexicon: Mapping[str, Sequence[str]] = LEXICON) -> DataFrame:
    """(doc_id, score): the calibrated probability that a text is abusive, for every document."""
    own = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter("doc_id is not null")
    sample = materialize(labelled_sample(documents, labels).repartition(4), "labelled")
    words = learn_lexicon(sample, lexicon)
    all_features = _described(own, words, False)
    if min(words.sizes) < 4:
        guess = 1 - F.exp(-F.greatest(F.col("weight_peak") - 2, F.lit(0.0)) * (0.5 + F.col("near_second_person")))
        return all_features.select("doc_id", guess.alias("score")).groupBy("doc_id").agg(F.max("score").alias("score"))
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    train = assemble.transform(materialize(_described(sample, words, True), "labelled_features"))
    # Halves of either label, and one order of rows: the same fit whatever the partitions were. The labelled rows are at most ``most_labels``.
    half = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2))
    train = train.select("doc_id", "features", F.col("y").cast("double").alias("label"), half.alias("half")).coalesce(1).sortWithinPartitions("doc_id")
    train = materialize(train, "training_rows").coalesce(1).cache()
    scored = assemble.transform(all_features).select("doc_id", "features")
    parts = []
    for h in (0, 1):
        fit, held = train.filter(F.col("half") == h), train.filter(F.col("half") != h)
        if fit.select("label").distinct().count() < 2 or held.filter("label > 0").isEmpty():
            fit = held = train
        model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, minInstancesPerNode=3, seed=seed).fit(fit)
        raw = lambda df, m=model: m.transform(df).withColumn("p", vector_to_array("probability")[1])
        calibrated = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="s").fit(raw(held).select("p", "label"))
        # The calibration is a step function; the score of the trees keeps an order within its steps.
        scored = calibrated.transform(raw(scored)).withColumn(f"part_{h}", F.least(F.lit(1.0), F.col("s") * 0.98 + F.col("p") * 0.02))
        scored = scored.select("doc_id", "features", *parts, f"part_{h}")
        parts.append(f"part_{h}")
    train.unpersist()
    return scored.groupBy("doc_id").agg(F.max((F.col("part_0") + F.col("part_1")) / 2).alias("score"))


def rates(scores: DataFrame, documents: DataFrame, bound: float = 0.5) -> DataFrame:
    """(source_id, n_docs, n_abusive, rate, mean_score) for each source."""
    sources = documents.select("doc_id", "source_id").dropDuplicates(["doc_id"])
    flagged = F.sum((F.col("score") >= bound).cast("long"))
    return sources.join(scores, "doc_id").groupBy("source_id").agg(F.count("*").alias("n_docs"), flagged.alias("n_abusive"), F.avg((F.col("score") >= bound).cast("double")).alias("rate"), F.avg("score").alias("mean_score"))
