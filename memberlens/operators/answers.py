"""Answers rendered for display, over a table or a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memberlens.functions import text


def render_answers(answers: DataFrame, summary: str, actions: str) -> DataFrame:
    """``answers`` with its summary section, action section and plain fallback text.

    Each step is a projection of its own, so a text is rewritten once although the cap looks at the
    result several times.
    """
    return (
        answers.withColumn("_plain", text.real_newlines(F.col(summary)))
        .withColumn("summary_section", text.bullets(F.col("_plain")))
        .withColumn("summary_section", text.cap_summary(F.col("summary_section")))
        .withColumn("actions_section", text.actions_section(F.col(actions)))
        .withColumn("fallback_text", text.fallback_text(F.col("_plain"), F.col(actions)))
        .drop("_plain")
    )
