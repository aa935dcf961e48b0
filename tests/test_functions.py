"""Functions on literals whose results are known."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from scrivenry.functions import numbers as N
from scrivenry.functions import sensitive
from scrivenry.functions import text as T


def one(spark, value, f):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_question_terms(spark):  # noqa: ANN001
    assert one(spark, "What makes an employment termination unfair?", T.question_terms) == ["employment", "termination", "unfair"]
    assert one(spark, "the dismissed employee, 2004", T.question_terms) == ["termination", "employment"]
    assert one(spark, None, T.question_terms) is None


def test_query_plans(spark):  # noqa: ANN001
    plans = one(spark, "employment termination misconduct hearing", T.query_plans)
    assert plans == ['"employment" "termination" "misconduct"', '"employment" "termination"', '"employment" OR "termination" OR "misconduct" OR "hearing"']
    assert one(spark, " what is it ", T.query_plans) == ["what is it"]


def test_gateway_terms(spark):  # noqa: ANN001
    assert one(spark, "What does the law say about employment?", T.gateway_terms) == ["say", "about", "employment"]


def test_strip_markup(spark):  # noqa: ANN001
    html = "<!DOCTYPE html><style>p{}</style><p>A &amp; B</p>\n  <p>C<br/>D</p><!-- x --><script>no()</script>"
    assert one(spark, html, T.strip_markup) == "A & B\nC D"


def test_labels_and_citations(spark):  # noqa: ANN001
    assert one(spark, "As [P1; P2] and (F1, page 3) say [see P1] (not P9)", T.evidence_labels) == ["P1", "P2", "F1"]
    assert one(spark, "see [2024] TZCA 123 and [2024] TZCA 123", T.neutral_citations) == ["[2024] TZCA 123"]
    assert one(spark, " [2024]  tzca 1", T.citation_key) == "[2024]tzca1"


def test_sensitive(spark):  # noqa: ANN001
    row = one(spark, "passport no: AB12345 and card 4111 1111 1111 1111", sensitive.inspect)
    assert row.decision == "redact" and row.kinds == ["financial_account", "government_id"] and "4111" not in row.sanitized
    assert one(spark, "key sk-" + "a" * 24, sensitive.inspect).decision == "block"
    assert one(spark, "nothing here", sensitive.inspect).decision == "allow"


def test_shard(spark):  # noqa: ANN001
    assert one(spark, "employment", N.shard) == "ec"


@pytest.mark.parametrize(("a", "b", "cosine"), [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([0.0, 0.0], [1.0, 0.0], None), ([1.0], [1.0, 0.0], None)])
def test_cosine(spark, a, b, cosine):  # noqa: ANN001
    assert spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(N.cosine(F.col("a"), F.col("b"))).first()[0] == cosine


def test_scores(spark):  # noqa: ANN001
    row = spark.range(1).select(N.fusion(F.lit(0), F.lit(1)), N.backoff_seconds(F.lit(3)), N.backoff_seconds(F.lit(20)), N.term_weight(F.lit(256)), N.clamp(F.lit(99), 1, 60)).first()
    assert row[0] == pytest.approx(0.45 / 20 + 0.55 / 21) and row[1:3] == (120, 3600) and row[3] == pytest.approx(max(1, math.log1p(1))) and row[4] == 60
