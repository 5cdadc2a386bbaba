"""Texts to hand to a language model, and its answers taken back as columns. No model is called here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: At most so many items of evidence of so many characters go into a prompt.
ITEMS, CHARS = 15, 280


def evidence(items: list[str]) -> str:
    return "\n".join(f"{i + 1}. {' '.join(str(x).split())[:CHARS]}" for i, x in enumerate(items[:ITEMS])) or "(none)"


def factor_reasoning(factor: str, market: str, items: list[str]) -> str:
    return f"Factor: {factor}\nMarket: {market}\nEvidence:\n{evidence(items)}\n\nSay whether the factor's premise holds now. Answer as JSON: {{\"activation\": true or false, \"relevance\": 0 to 1, \"why\": text}}"


def debate(question: str, items: list[str], rounds: int = 2) -> str:
    return f"Question: {question}\nEvidence:\n{evidence(items)}\n\nArgue for and against in {rounds} rounds, each side answering the other, then give a verdict. Answer as JSON: {{\"for\": [], \"against\": [], \"verdict\": -1 to 1}}"


def alignment(factor: str, formula: str, hypothesis: str) -> str:
    return f"Hypothesis: {hypothesis}\nFactor {factor} = {formula}\n\nSay how well the formula measures the hypothesis. Answer as JSON: {{\"alignment\": 0 to 1, \"why\": text}}"


def interpretability(factor: str) -> str:
    return f"Factor: {factor}\n\nRate from 0 to 1 how well it can be explained: the behaviour or premium that it measures, how simple it is, and what known family it belongs to."


def headlines(news: DataFrame, order: str = "time") -> DataFrame:
    """(id, text) of news items in order, for a reader to score: the title, or else the summary."""
    text = F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("summary"), F.lit(""))
    return news.select((F.row_number().over(Window.orderBy(order, "title", "url")) - 1).alias("id"), text.alias("text"))  # a batch for a reader


def with_scores(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """rows (id, ...) with the score given back for them, 0 without one."""
    return rows.join(scores.select("id", F.col("score").alias("sentiment_llm")), "id", "left").withColumn("sentiment_llm", F.coalesce("sentiment_llm", F.lit(0.0)))


def answer_field(answer: Column, field: str, kind: str = "double") -> Column:
    """A field of the JSON object in an answer with words around it; null if there is none."""
    return F.try_variant_get(F.try_parse_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0)), f"$.{field}", kind)
