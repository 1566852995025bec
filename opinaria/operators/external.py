"""Labels from an external classifier: prompts, answers, and a hook that calls a scorer per text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinaria.functions.labels import normalise_label, strict_label
from opinaria.functions.text import strip_tags

# The two prompt texts; {texto} marks where the text goes.
THREE_CLASS_PROMPT = """
Classifique o sentimento do texto a seguir. Responda com UMA PALAVRA:
"positivo", "negativo" ou "neutro". Não explique.

Texto: "{texto}"

Sentimento:
"""
TWO_CLASS_PROMPT = """
        Analisa o sentimento de um texto usando a API do Gemini.
        Retorna 'positivo' ou 'negativo'.
    
    Avaliação: "{texto}"

    Sentimento:
    """
PLACEHOLDER = "{texto}"

Scorer = Callable[[str], "str | None"]


def render_prompt(text: Column, template: str = THREE_CLASS_PROMPT) -> Column:
    """The template with the text put in literally, whatever characters it holds."""
    head, tail = template.split(PLACEHOLDER)
    return F.concat(F.lit(head), text, F.lit(tail))


def review_prompt(text: Column) -> Column:
    """Two-class prompt for a review, whose tags are deleted first."""
    return render_prompt(strip_tags(text), TWO_CLASS_PROMPT)


def with_answers(texts: DataFrame, responses: DataFrame, key: str = "id") -> DataFrame:
    """Texts with the columns ``answer`` and ``error`` of their response, null where there is none.

    Both sides hold one row per text, so this is a shuffle join on a key without repeats.
    """
    return texts.join(responses.select(key, "answer", "error"), key, "left")


def lenient_answer(answer: Column, error: Column) -> Column:
    """Three-class rule; a failed or missing call is unclassified."""
    return normalise_label(F.when(~F.coalesce(error, F.lit(False)), answer))


def strict_answer(answer: Column, error: Column) -> Column:
    """Two-class rule; a failed or missing call is an error."""
    return strict_label(answer, error)


def label_from_responses(
    texts: DataFrame, responses: DataFrame, column: str, key: str = "id", *, strict: bool = False
) -> DataFrame:
    """Add a label column from a table of responses."""
    rule = strict_answer if strict else lenient_answer
    joined = with_answers(texts, responses, key)
    label = rule(F.col("answer"), F.col("error"))
    return joined.withColumn(column, label).drop("answer", "error")


def ask(texts: DataFrame, prompt: str, factory: Callable[[], Scorer]) -> DataFrame:
    """Add ``answer`` and ``error`` by calling a scorer for every value of the ``prompt`` column.

    ``factory`` runs once per task and makes the scorer, so a client is set up where it is used. A
    call that raises marks its own row only. A task that is run again repeats its calls: write the
    answers to a table before several jobs read them.
    """
    schema = T.StructType(
        [*texts.schema.fields, T.StructField("answer", T.StringType()),
         T.StructField("error", T.BooleanType())]
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = factory()

        def one(text):
            try:
                return scorer(text), False
            except Exception:
                return None, True

        for batch in batches:
            pairs = [one(text) for text in batch[prompt]]
            yield batch.assign(
                answer=pd.Series([a for a, _ in pairs], index=batch.index, dtype="object"),
                error=pd.Series([e for _, e in pairs], index=batch.index, dtype="bool"),
            )

    return texts.mapInPandas(run, schema)


def score_with(
    texts: DataFrame, factory: Callable[[], Scorer], column: str, *, text: str = "texto",
    template: str | None = THREE_CLASS_PROMPT, strict: bool = False,
) -> DataFrame:
    """Add a label column from a scorer; works on batch and streaming tables.

    With ``template=None`` the scorer gets the plain text.
    """
    prompt = F.col(text) if template is None else render_prompt(F.col(text), template)
    asked = ask(texts.withColumn("_prompt", prompt), "_prompt", factory)
    rule = strict_answer if strict else lenient_answer
    label = rule(F.col("answer"), F.col("error"))
    return asked.withColumn(column, label).drop("_prompt", "answer", "error")
