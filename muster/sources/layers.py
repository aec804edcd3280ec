"""Configuration documents from YAML or JSON files, and writing merged ones back."""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from muster.operators.leaves import parse_doc, rebuild_documents

try:
    import yaml
except ImportError:  # JSON documents work without it
    yaml = None


#: Why a document could not be read.
BROKEN_JSON = "not a JSON document"


def _plain_value(value):
    """The same value in JSON types: keys are texts, numbers that are not finite are texts too."""
    if isinstance(value, dict):
        return {_key_text(k): _plain_value(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set)):
        return [_plain_value(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return str(value)
    return value if value is None or isinstance(value, (str, bool, int, float)) else str(value)


def _key_text(key) -> str:
    return key if isinstance(key, str) else json.dumps(key) if key is None or isinstance(key, (bool, int, float)) else str(key)


def _yaml_document(text: str | None, loader) -> tuple[str | None, str | None]:
    """JSON text and error of one document; only one of them is set."""
    try:
        loaded = yaml.load(text or "", loader)
        return json.dumps({} if loaded is None else _plain_value(loaded), allow_nan=False), None
    except (yaml.YAMLError, ValueError, TypeError, RecursionError) as e:
        # A date or a number that YAML reads but Python can't hold is an error of that document alone.
        return None, f"{type(e).__name__}: {' '.join(str(e).split())}"


def yaml_to_json(docs: DataFrame, text: str) -> DataFrame:
    """Turn a YAML column into ``json`` text and ``error``; empty text is ``{}``, broken text gives the reason.

    All other columns go through as Arrow columns, so their types and values stay as they are.
    """
    if yaml is None:
        raise ImportError("reading YAML needs the yaml package")
    keep = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*keep, T.StructField("json", T.StringType()), T.StructField("error", T.StringType())])
    at = docs.columns.index(text)

    def convert(batches):
        loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
        for batch in batches:
            read = [_yaml_document(t, loader) for t in batch.column(at).to_pylist()]
            columns = [c for i, c in enumerate(batch.columns) if i != at]
            columns += [pa.array([r[i] for r in read], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(convert, schema)


def parse_documents(docs: DataFrame, text: str, is_yaml: Column | None = None) -> DataFrame:
    """Replace the text column by a variant ``doc`` and an ``error``. YAML rows alone pass through Python.

    A document that can't be read stays as a row with a null ``doc`` and the reason in ``error``;
    a null text is an empty document.
    """
    keep = [c for c in docs.columns if c != text]
    plain = docs if is_yaml is None else docs.filter(~F.coalesce(is_yaml, F.lit(False)))
    out = plain.select(*keep, parse_doc(F.coalesce(F.col(text), F.lit(""))).alias("doc"))
    out = out.withColumn("error", F.when(F.col("doc").isNull(), F.lit(BROKEN_JSON)))
    if is_yaml is not None:
        read = yaml_to_json(docs.filter(is_yaml), text)
        out = out.unionByName(read.select(*keep, parse_doc("json").alias("doc"), "error"))
    return out


def valid_documents(docs: DataFrame, raising: bool = True) -> DataFrame:
    """Documents without ``error``. A broken one fails the query, or is left out if not ``raising``."""
    if raising:
        reason = F.raise_error(F.concat(F.lit("a configuration document can't be read: "), "error")).cast("variant")
        docs = docs.withColumn("doc", F.when(F.col("error").isNull(), F.col("doc")).otherwise(reason))
    else:
        docs = docs.filter(F.col("error").isNull())
    return docs.drop("error")


def rejected_documents(docs: DataFrame) -> DataFrame:
    """Every document that can't be read, with its other columns (path and layer) and the reason."""
    return docs.filter(F.col("error").isNotNull()).drop("doc")


def read_config_layers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``layer, source, doc, error`` of configuration files or folders; later paths are higher layers.

    Every file is one document. A path that does not exist is left out, except the first. An
    empty file gives no row, which merges like the empty document it stands for. Pass the rows
    through ``valid_documents`` before they are merged.
    """
    out = None
    for layer, path in enumerate(paths):
        files = _read_files(spark, path, optional=layer > 0)
        if files is not None:
            if yaml is None and any(f.lower().endswith((".yaml", ".yml")) for f in files.inputFiles()):
                raise ImportError(f"reading YAML below {path} needs the yaml package")
            files = files.select(F.lit(layer).alias("layer"), F.col("_metadata.file_path").alias("source"), "value")
            out = files if out is None else out.unionByName(files)
    return parse_documents(out, "value", F.lower("source").rlike(r"\.ya?ml$") if yaml else None)


def _read_files(spark: SparkSession, path: str, optional: bool) -> DataFrame | None:
    try:
        return spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if optional and e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def write_config(df: DataFrame, path: str, fmt: str = "json") -> None:
    """Overwrite the stored configuration."""
    df.write.mode("overwrite").format(fmt).save(path)


def write_documents(leaves: DataFrame, keys: list[str], path: str) -> None:
    """Overwrite ``path`` with the whole documents of merged leaves: one JSON line per document, with its keys.

    Without keys the folder holds one JSON document, which ``read_config_layers`` reads like any other file.
    """
    docs = rebuild_documents(leaves, keys)
    if keys:
        docs = docs.select(F.to_json(F.struct(*keys, "text"), {"ignoreNullFields": "false"}).alias("value"))
    docs.write.mode("overwrite").text(path)


def read_documents(spark: SparkSession, path: str, keys: str) -> DataFrame:
    """``keys, doc, error`` of stored documents; ``keys`` are their names and types, as in ``"id bigint, name string"``."""
    given = T.StructType.fromDDL(keys)
    lines = spark.read.text(path).select(F.from_json("value", T.StructType([*given, T.StructField("text", T.StringType())])).alias("d"))
    return parse_documents(lines.select("d.*"), "text")
