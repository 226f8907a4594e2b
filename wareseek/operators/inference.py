"""Running models over DataFrames: one model per Python worker, fed in fixed-size batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.ml.model_cache import ModelCache
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from wareseek.functions.text import LABEL_PROMPTS, Prompt, clean_label
from wareseek.schemas import FACETS, MAX_ATTEMPTS, MODEL_BATCH_SIZE

# A model takes a batch and returns its new columns.
Model = Callable[[pd.DataFrame], Mapping[str, Sequence[Any]]]
_RESIDENT = "the model of this worker"
#: Rows whose answers leave a worker together, in whole batches of the model.
_ROWS_OUT = 512


def infer(
    df: DataFrame,
    make_model: Callable[[], Model],
    outputs: T.StructType | str,
    batch_size: int = MODEL_BATCH_SIZE,
    drop: Sequence[str] = (),
    profile: ResourceProfile | None = None,
    model_name: str | None = None,
    prompts: Mapping[str, Prompt] | None = None,
) -> DataFrame:
    """Add the columns ``outputs`` computed by a model.

    ``make_model`` runs once per Python worker, which keeps the model for later tasks of this call
    and, with a ``model_name``, of later calls under that name. A worker holds one model: before
    another is made, it lets go of the one it has. Columns in
    ``drop`` (images, prompts) are read by the model but not passed on. Columns in ``prompts`` are
    not either; they are made in the worker for some ``_ROWS_OUT`` rows at a time, so that their long
    literals never travel there. ``profile`` requests GPUs or other resources for this stage only.

    Only the ``batch_size`` rows that the model works on, and the answers of some ``_ROWS_OUT`` rows, are Python
    objects at a time; the other rows wait as Arrow data, and columns that are passed on stay such.
    """
    added = T._parse_datatype_string(outputs) if isinstance(outputs, str) else outputs
    names = [f.name for f in added]
    prompts = dict(prompts or {})
    strings = {f.name for f in df.schema if isinstance(f.dataType, T.StringType)}
    made_here = {c: p for c, p in prompts.items() if p.parts[1::2] and strings.issuperset(p.parts[1::2])}
    df = df.withColumns({c: p.text() for c, p in prompts.items() if c not in made_here}).drop(*made_here)
    drop = (*drop, *prompts)
    schema = T.StructType(
        [f for f in df.schema if f.name not in names and f.name not in drop] + list(added)
    )
    wanted = model_name or str(uuid.uuid4())

    types = {f.name: to_arrow_type(f.dataType) for f in added}
    rows_out = batch_size * -(-_ROWS_OUT // batch_size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, model = ModelCache.get(_RESIDENT) or (None, None)
        if held != wanted:
            model = None
            ModelCache.add(_RESIDENT, None)
            model = make_model()
            ModelCache.add(_RESIDENT, (wanted, model))
        for batch in batches:
            for start in range(0, batch.num_rows, rows_out):
                rows = asked = batch.slice(start, rows_out)
                for name, prompt in made_here.items():
                    asked = asked.append_column(name, prompt.texts(rows))
                found: dict[str, list] = {name: [] for name in names}
                for at in range(0, rows.num_rows, batch_size):
                    made = model(_as_pandas(asked.slice(at, batch_size)))
                    for name in names:
                        found[name] += list(made[name])
                columns = {name: _as_arrow(found[name], kind) for name, kind in types.items()}
                arrays = [columns[c] if c in columns else rows.column(c) for c in schema.fieldNames()]
                yield pa.RecordBatch.from_arrays(arrays, schema.fieldNames())

    return df.mapInArrow(run, schema, profile=profile)


def _as_pandas(rows: pa.RecordBatch) -> pd.DataFrame:
    """What a model reads; times without their zone, as pandas functions of Spark get them."""
    # Few rows at a time: threads would cost more than they save.
    frame = rows.to_pandas(date_as_object=True, maps_as_pydicts="lossy", use_threads=False)
    for field in rows.schema:
        if pa.types.is_timestamp(field.type) and field.type.tz is not None:
            frame[field.name] = frame[field.name].dt.tz_localize(None)
    return frame


def _as_arrow(values: list, kind: pa.DataType) -> pa.Array:
    """A model's answers as a column; NaN stands for a missing one, as in pandas."""
    return pa.array(pd.Series(values, dtype=object), kind, from_pandas=True)


def with_retries(call: Callable[..., Any], attempts: int = MAX_ATTEMPTS) -> Callable[..., Any]:
    """Try a remote call up to ``attempts`` times at once; a call that keeps failing gives None."""

    def tried(*args: Any, **kwargs: Any) -> Any:
        for _ in range(attempts):
            try:
                return call(*args, **kwargs)
            except Exception:
                continue
        return None

    return tried


def embed_columns(
    df: DataFrame,
    columns: Sequence[str],
    make_encoder: Callable[[], Callable[[list[str]], Sequence[Sequence[float]]]],
    batch_size: int = MODEL_BATCH_SIZE,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """``{column}_embedding`` for several text columns in one pass over the data."""

    def make_model() -> Model:
        encode = make_encoder()
        return lambda batch: {f"{c}_embedding": list(encode(list(batch[c]))) for c in columns}

    outputs = T.StructType(
        [T.StructField(f"{c}_embedding", T.ArrayType(T.FloatType())) for c in columns]
    )
    return infer(df, make_model, outputs, batch_size, profile=profile)


def describe(
    df: DataFrame,
    make_model: Callable[[], Model],
    batch_size: int = MODEL_BATCH_SIZE,
    profile: ResourceProfile | None = None,
    model_name: str | None = None,
    prompt: Prompt | None = None,
) -> DataFrame:
    """Add ``description`` from the prompt and the picture, and let go of both.

    The model reads ``description_prompt``, a column of ``df`` or made from ``prompt`` within the task.
    """
    return infer(
        df,
        make_model,
        "description string",
        batch_size,
        drop=("img", "description_prompt"),
        profile=profile,
        model_name=model_name,
        prompts=None if prompt is None else {"description_prompt": prompt},
    )


def label_columns(responses: Mapping[str, Column]) -> dict[str, Column]:
    """Facet columns from raw classifier answers."""
    return {facet: clean_label(response, FACETS[facet]) for facet, response in responses.items()}


def classify(
    df: DataFrame,
    make_model: Callable[[], Model],
    batch_size: int = MODEL_BATCH_SIZE,
    profile: ResourceProfile | None = None,
    model_name: str | None = None,
) -> DataFrame:
    """Add every facet: prompts, one model pass that answers all of them, then label cleaning.

    The model reads ``{facet}_prompt`` and returns ``{facet}_response``.
    """
    prompts = {f"{facet}_prompt": prompt for facet, prompt in LABEL_PROMPTS.items()}
    answers = T.StructType([T.StructField(f"{facet}_response", T.StringType()) for facet in FACETS])
    answered = infer(
        df, make_model, answers, batch_size, profile=profile, model_name=model_name, prompts=prompts
    )
    labels = label_columns({facet: F.col(f"{facet}_response") for facet in FACETS})
    return answered.withColumns(labels).drop(*answers.fieldNames())
