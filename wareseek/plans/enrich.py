"""Enrichment of raw products: pictures, descriptions, labels, embeddings, then the table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any, Literal, Protocol

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, functions as F, types as T

from wareseek.functions.geometry import crop_center_square
from wareseek.functions.text import (
    DESCRIPTION_PROMPT,
    LABEL_PROMPTS,
    REMOTE_DESCRIPTION_PROMPT,
    label_output_tokens,
    primary_image,
    token_count,
    tokens,
)
from wareseek.functions.vectors import hashed_embedding
from wareseek.operators.filters import drop_incomplete, nan_to_null
from wareseek.operators.inference import Model, classify, describe, infer, label_columns, with_retries
from wareseek.operators.ranking import keep_last
from wareseek.operators.text_index import TextIndex
from wareseek.schemas import (
    DESCRIPTION_OUTPUT_TOKENS,
    EMBEDDING_DIMS,
    ENRICHED_CATALOG,
    FACETS,
    MAX_ATTEMPTS,
    MODEL_BATCH_SIZE,
)
from wareseek.sources.assets import has_asset
from wareseek.sources.table import CatalogTable, DuplicateKeyError, duplicated_keys
from wareseek.storage import materialise, scratch_scope


@dataclass(frozen=True)
class Budget:
    """Longest prompt and longest answer of a model stage, in tokens."""

    max_input: int
    max_output: int

    @property
    def max_total(self) -> int:
        return self.max_input + self.max_output


def token_budgets(df: DataFrame, stages: Sequence[str] = ("description", *FACETS)) -> DataFrame:
    """``(stage, max_input, max_output, max_total)`` from one aggregate over all prompts.

    Prompts are counted from the tokens of their columns; the texts themselves are never built.
    """
    prompts = {"description": DESCRIPTION_PROMPT, **LABEL_PROMPTS}
    output = {
        "description": DESCRIPTION_OUTPUT_TOKENS,
        **{facet: label_output_tokens(labels) for facet, labels in FACETS.items()},
    }
    used = sorted({c for stage in stages for c in prompts[stage].parts[1::2]})
    counted = df.select(*[token_count(tokens(F.col(c))).alias(c) for c in used])
    counts = {c: F.col(c) for c in used}
    longest = counted.agg(
        *[F.max(prompts[stage].count(counts)).cast("long").alias(stage) for stage in stages]
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(stage).alias("stage"),
                F.col(stage).alias("max_input"),
                F.lit(output[stage]).cast("long").alias("max_output"),
                (F.col(stage) + output[stage]).alias("max_total"),
            )
            for stage in stages
        ]
    )
    return longest.select(F.inline(rows))


def budgets_of(df: DataFrame, stages: Sequence[str]) -> dict[str, Budget]:
    """The same as values for configuring models; one row per stage comes back."""
    rows = token_budgets(df, stages).collect()
    return {r["stage"]: Budget(r["max_input"] or 0, r["max_output"]) for r in rows}


def hashed_embeddings(df: DataFrame, columns: Sequence[str], dims: int = EMBEDDING_DIMS) -> DataFrame:
    """``{column}_embedding`` by the built-in bag of words embedder."""
    return df.withColumns({f"{c}_embedding": hashed_embedding(F.col(c), dims) for c in columns})


@dataclass(frozen=True)
class OfflineModels:
    """What the offline run needs from outside.

    ``add_assets`` adds the bytes ``img`` behind ``url``. ``load_image`` decodes and scales one
    picture (None: pictures go to the describer as they are). The ``make_*`` functions receive the
    token budgets of their stages and return the model factory for :func:`infer`. ``profiles``
    requests resources for the stages ``describe`` and ``classify``. With a ``name`` workers keep a
    loaded model for later runs of the same name and budget, as for the batches of a stream.
    """

    add_assets: Callable[[DataFrame], DataFrame]
    make_describer: Callable[[Budget], Callable[[], Model]]
    make_classifier: Callable[[Mapping[str, Budget]], Callable[[], Model]]
    embed: Callable[[DataFrame, Sequence[str]], DataFrame] = hashed_embeddings
    load_image: Callable[[bytes, int], Any] | None = None
    batch_size: int = MODEL_BATCH_SIZE
    profiles: Mapping[str, ResourceProfile] = field(default_factory=dict)
    name: str | None = None

    def stage(self, kind: str, budget: object) -> dict[str, Any]:
        """What a model stage is run with: its resources, and the name it stays loaded under."""
        named = None if self.name is None else f"{self.name} {kind} {budget!r}"
        return {"profile": self.profiles.get(kind), "model_name": named}


def pictured(raw: DataFrame, models: OfflineModels) -> DataFrame:
    """Products that have a picture, with its bytes. ``images`` keeps the original list."""
    rows = raw.withColumnRenamed("img", "images")
    rows = models.add_assets(rows.withColumn("url", primary_image(F.col("images"))))
    rows = rows.filter(has_asset())
    if models.load_image is None:
        return rows
    # A picture that cannot be decoded is a missing one.
    return crop_center_square(rows, models.load_image).filter(F.col("img").isNotNull())


def _input_rows(raw: DataFrame, key: str) -> DataFrame:
    """The columns an enrichment reads."""
    carried = [c for c in ("id", key) if c in raw.columns and c != "name"]
    return nan_to_null(raw.select("name", "img", "price", "rating", *dict.fromkeys(carried)))


def _dealt_out(rows: DataFrame, partitions: int | None) -> DataFrame:
    return rows if partitions is None else rows.repartition(partitions)


def enrich_offline(
    raw: DataFrame, models: OfflineModels, key: str = "name", partitions: int | None = None
) -> DataFrame:
    """Enriched records, plus ``id`` to order rows that share a key.

    ``partitions`` sets the number of tasks for downloads and descriptions. Raw rows are tiny next
    to the work they cause, so choose it by the time one task should take; a lost executor costs
    no more than that.

    The budget of the describer is measured on the raw names, so pictures go from download to
    description within one task and are never stored. The raw rows are, without columns nobody reads,
    so that what made them runs once. So are the descriptions: the budgets of the
    classifier need a pass over them, and no product should be described twice.
    """
    rows = materialise(_input_rows(raw, key), "products")
    budget = budgets_of(rows, ["description"])["description"]
    rows = pictured(_dealt_out(rows, partitions), models)
    described = materialise(
        describe(
            rows,
            models.make_describer(budget),
            models.batch_size,
            prompt=DESCRIPTION_PROMPT,
            **models.stage("describe", budget),
        ),
        "descriptions",
    )
    budgets = budgets_of(described, list(FACETS))
    labelled = classify(
        described,
        models.make_classifier(budgets),
        models.batch_size,
        **models.stage("classify", budgets),
    )
    return project_record(models.embed(labelled, ["name", "description"]), key, "images")


def project_record(df: DataFrame, key: str = "name", images: str = "img") -> DataFrame:
    """The stored shape of a product, plus ``id`` where there is one."""
    source = {"_id": F.col(key).cast("string"), "img": F.col(images)}
    columns = [
        source.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in ENRICHED_CATALOG
    ]
    return df.select(*columns, *[c for c in ("id",) if c in df.columns])


class RemoteModels(Protocol):
    """Client of remote model services."""

    def describe(self, prompt: str, image_url: str) -> str: ...

    def classify(self, prompt: str) -> str: ...

    def embed(self, text: str) -> Sequence[float]: ...


def enrich_online(
    raw: DataFrame,
    make_client: Callable[[], RemoteModels],
    key: str = "name",
    require_complete: bool = True,
    attempts: int = MAX_ATTEMPTS,
    threads: int = 16,
    batch_size: int = MODEL_BATCH_SIZE,
    partitions: int | None = None,
) -> DataFrame:
    """Enriched records through remote calls, plus ``id`` to order rows that share a key.

    All calls of a row happen in one batch function and the rows of a batch overlap. A call that
    fails ``attempts`` times gives NULL. Without a description nothing that depends on it is asked.
    ``require_complete`` drops every row with a missing value. At most ``partitions`` x ``threads``
    calls are in flight.
    """
    rows = _dealt_out(_input_rows(raw, key), partitions)
    rows = rows.withColumn("url", primary_image(F.col("img")))
    outputs = T.StructType(
        [
            T.StructField("description", T.StringType()),
            *[T.StructField(f"{facet}_response", T.StringType()) for facet in FACETS],
            T.StructField("name_embedding", T.ArrayType(T.FloatType())),
            T.StructField("description_embedding", T.ArrayType(T.FloatType())),
        ]
    )

    def make_model() -> Model:
        client, pool = make_client(), ThreadPoolExecutor(threads)
        ask = {
            name: with_retries(getattr(client, name), attempts)
            for name in ("describe", "classify", "embed")
        }

        def one(name: str, url: str) -> dict[str, Any]:
            made: dict[str, Any] = dict.fromkeys(outputs.fieldNames())
            if name is None:  # nothing to ask about
                return made
            made["name_embedding"] = ask["embed"](name)
            text = ask["describe"](REMOTE_DESCRIPTION_PROMPT.fill(name=name), url)
            if text is not None:
                made["description"] = text
                for facet, prompt in LABEL_PROMPTS.items():
                    answer = ask["classify"](prompt.fill(name=name, description=text))
                    made[f"{facet}_response"] = answer
                made["description_embedding"] = ask["embed"](text)
            return made

        def model(batch: pd.DataFrame) -> Mapping[str, Sequence[Any]]:
            made = list(pool.map(one, batch["name"], batch["url"]))
            return {name: [m[name] for m in made] for name in outputs.fieldNames()}

        return model

    answered = infer(rows, make_model, outputs, batch_size, drop=("url",))
    labels = label_columns({facet: F.col(f"{facet}_response") for facet in FACETS})
    records = project_record(answered.withColumns(labels), key)
    # The helper column that orders rows of one key is no part of a document.
    return drop_incomplete(records, ENRICHED_CATALOG.fieldNames()) if require_complete else records


def load(
    table: CatalogTable,
    records: DataFrame,
    mode: Literal["first_run", "update"],
    order: Sequence[str] = ("id",),
    index: TextIndex | None = None,
) -> DataFrame:
    """Write records to the table and return its rows. A text index of a versioned table follows.

    A first run replaces what the table holds; keys must be unique, and a run that is refused for
    them leaves the table as it was. An update upserts, and of rows that share a key the last in
    ``order`` wins.
    """
    if mode == "first_run":
        table.replace(records.drop(*[c for c in order if c not in table.schema.fieldNames()]))
    elif mode == "update":
        present = [c for c in order if c in records.columns]
        table.upsert(records, present or None)
    else:
        raise ValueError("mode must be 'first_run' or 'update'")
    if index is not None:
        index.follow(table)
    return table.read()


def enrich_into(
    table: CatalogTable,
    raw: DataFrame,
    enrich: Callable[[DataFrame], DataFrame],
    mode: Literal["first_run", "update"],
    key: str = "name",
    order: Sequence[str] = ("id",),
    batch: tuple[str, int] | None = None,
    index: TextIndex | None = None,
) -> DataFrame:
    """Enrich raw rows, write them to the table and return its rows; no model runs for a row that cannot stay.

    A first run is refused for repeated keys before anything is enriched, even where enrichment would leave
    only one of the rows. An update enriches only the last raw row of each key in ``order``. Rows without a key are
    enriched, and refused by the table if they stay. ``batch`` goes to a table that keeps account of batches: one
    that was applied before is not enriched again. Copies staged on the way are removed when the table is
    written, also after a failure.
    """
    if batch is not None and batch[1] <= table.applied(batch[0]):
        return table.read()
    present = [c for c in order if c in raw.columns]
    if mode == "first_run":
        wrong = duplicated_keys(raw.filter(F.col(key).isNotNull()), key).select(key).limit(5).collect()
        if wrong:
            raise DuplicateKeyError(f"keys repeated: {[r[0] for r in wrong]}")
    elif mode == "update" and present:
        raw = keep_last(raw, [key], present)
    with scratch_scope(table.spark):
        records = enrich(raw)
        if batch is None:
            return load(table, records, mode, order, index)
        known = [c for c in order if c in records.columns]
        table.upsert(records, known or None, batch)
        if index is not None:
            index.follow(table)
    return table.read()
