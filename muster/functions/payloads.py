"""Chat requests, chat answers and model lists as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from muster import fixed_values as fv
from muster.functions.common import ColumnOrName, as_col, set_or_null

_MODELS = "struct<data:array<struct<id:string>>>"


def message(role: ColumnOrName, content: ColumnOrName) -> Column:
    return F.struct(as_col(role).alias("role"), as_col(content).alias("content"))


def chat_payload(prompt: ColumnOrName, model: str = fv.DEFAULT_MODEL, temperature: float = fv.DEFAULT_TEMPERATURE) -> Column:
    """Request with one user message."""
    return conversation_payload(F.array(message(F.lit("user"), prompt)), model, temperature)


def conversation_payload(messages: ColumnOrName, model: str = fv.DEFAULT_MODEL, temperature: float = fv.DEFAULT_TEMPERATURE) -> Column:
    return F.to_json(
        F.struct(
            F.lit(model).alias("model"),
            as_col(messages).alias("messages"),
            F.lit(temperature).alias("temperature"),
        )
    )


def chat_content(answer: ColumnOrName, missing: str | None = fv.NO_CONTENT) -> Column:
    """Text of the first choice."""
    found = F.get_json_object(as_col(answer), "$.choices[0].message.content")
    return found if missing is None else F.coalesce(found, F.lit(missing))


def model_ids(answer: ColumnOrName) -> Column:
    """Ids in the model list; empty ones are skipped, a broken answer gives no ids."""
    ids = F.from_json(as_col(answer), _MODELS)["data"]["id"]
    return F.coalesce(F.filter(ids, lambda i: i.isNotNull() & (i != "")), F.array().cast("array<string>"))


def first_model(answer: ColumnOrName, default: str = fv.DEFAULT_MODEL) -> Column:
    return F.coalesce(F.get(model_ids(answer), F.lit(0)), F.lit(default))


def models_found(answer: ColumnOrName) -> Column:
    """Summary text of a model list."""
    ids = model_ids(answer)
    names = F.coalesce(set_or_null(F.array_join(ids, ", ")), F.lit(fv.NONE_LISTED))
    return F.concat(F.lit("OK ("), F.size(ids).cast("string"), F.lit(" models found: "), names, F.lit(")"))
