"""JSON documents and result logs: observations, plates, results, docking output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pickwise.functions.states import ITEM_KINDS, WELL_STATES


# Field names and types of the exchanged documents.
PROTOCOL_VERSION = "v1"
OBSERVATION_JSON = (
    "smiles STRING, pool_idx BIGINT, values ARRAY<DOUBLE>, state STRING, qc_passed BOOLEAN, source STRING, "
    "compound_id STRING, item_id STRING, kind STRING, raw STRING, message STRING, timestamp DOUBLE"
)
RESULT_JSON = (
    "job_id STRING, campaign_id STRING, round INT, done BOOLEAN, n_pending INT, results ARRAY<STRUCT<"
    "well: STRING, item_id: STRING, kind: STRING, compound_id: STRING, smiles: STRING, pool_idx: BIGINT, "
    "replicate_of: STRING, state: STRING, values: ARRAY<DOUBLE>, qc_passed: BOOLEAN, message: STRING>>"
)
PLATE_CAPACITY = 1536  # wells of the largest common plate


def _default(name: str, value) -> Column:
    return F.coalesce(F.col(name), F.lit(value)).alias(name)


def _with_defaults() -> list[Column]:
    return [
        _default("smiles", ""), _default("pool_idx", -1), F.col("values"), F.col("state"), _default("qc_passed", False),
        _default("source", ""), _default("compound_id", ""), _default("item_id", ""), _default("kind", "experimental"),
        _default("raw", "{}"), _default("message", ""), F.timestamp_seconds(F.coalesce("timestamp", F.lit(0.0))).alias("ts"),
    ]


def observations_from_json(docs: DataFrame, column: str = "doc") -> DataFrame:
    """One observation per JSON record, missing fields filled; other columns of ``docs`` are kept."""
    keep = [c for c in docs.columns if c != column]
    return docs.select(*keep, F.from_json(column, OBSERVATION_JSON).alias("_o")).select(*keep, "_o.*").select(*keep, *_with_defaults())


def _problem(column: str, field: str | None = None) -> Column:
    """Why a document cannot be read: NULL for a JSON object, with the named list if one is asked for."""
    reason = F.when(F.json_object_keys(column).isNull(), F.lit("unreadable JSON"))
    if field is not None:
        rows = F.from_json(F.col(column), "map<string,variant>")[field]
        reason = reason.when(~F.coalesce(F.schema_of_variant(rows).startswith("ARRAY"), F.lit(False)), F.lit(f"no list of {field}"))
    return reason


def split_observations(docs: DataFrame, column: str = "doc") -> tuple[DataFrame, DataFrame]:
    """(observations, quarantined documents with ``reason``): unreadable JSON, and states and kinds that do not exist."""
    state, kind = F.get_json_object(column, "$.state"), F.coalesce(F.get_json_object(column, "$.kind"), F.lit("experimental"))
    reason = F.coalesce(
        _problem(column), F.when(~F.coalesce(state.isin(*WELL_STATES), F.lit(False)), F.lit("unknown state")), F.when(~kind.isin(*ITEM_KINDS), F.lit("unknown kind"))
    )
    checked = docs.withColumn("reason", reason)
    return observations_from_json(checked.filter("reason IS NULL").drop("reason"), column), checked.filter("reason IS NOT NULL")


def split_results(docs: DataFrame, column: str = "doc", source: str = "robot") -> tuple[DataFrame, DataFrame]:
    """(observations, quarantined documents with ``reason``) from result documents: unreadable JSON, or no list of results."""
    checked = docs.withColumn("reason", _problem(column, "results"))
    return results_to_observations(checked.filter("reason IS NULL"), column, source), checked.filter("reason IS NOT NULL")


def observations_to_json(obs: DataFrame, name: str = "doc") -> DataFrame:
    fields = ["smiles", "pool_idx", "values", "state", "qc_passed", "source", "compound_id", "item_id", "kind", "raw", "message"]
    seconds = (F.unix_micros("ts") / 1e6).alias("timestamp")
    return obs.withColumn(name, F.to_json(F.struct(*fields, seconds), {"ignoreNullFields": "false"}))


def _plate_item() -> Column:
    blank_to_null = lambda c: F.nullif(F.col(c), F.lit(""))
    return F.struct(
        F.coalesce(blank_to_null("well_id"), F.col("item_id")).alias("well"), "item_id", "kind",
        blank_to_null("compound_id").alias("compound_id"), blank_to_null("smiles").alias("smiles"),
        F.coalesce("pool_idx", F.lit(-1)).alias("pool_idx"), "replicate_of",
    )


def plate_documents(items: DataFrame, capacity: int = PLATE_CAPACITY) -> DataFrame:
    """One submit document per job, wells in order: job_id, n_items, payload, reason.

    A document is one plate. A job with more items than a plate has wells cannot be submitted: its payload is NULL, ``reason`` says why,
    and its items are never brought together.
    """
    keys = ["campaign_id", "round", "job_id"]
    sizes = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_items"))
    fits = items.join(sizes.filter(F.col("n_items") <= capacity).drop("n_items"), keys).withColumn("_item", _plate_item())
    plates = fits.groupBy(*keys).agg(F.array_sort(F.collect_list("_item")).alias("plate"))
    doc = F.struct(F.lit(PROTOCOL_VERSION).alias("protocol_version"), *keys, "plate")
    good = plates.select("job_id", F.size("plate").cast("long").alias("n_items"), F.to_json(doc, {"ignoreNullFields": "false"}).alias("payload"), F.lit(None).cast("string").alias("reason"))
    over = sizes.filter(F.col("n_items") > capacity)
    return good.unionByName(over.select("job_id", "n_items", F.lit(None).cast("string").alias("payload"), F.lit("more items than wells").alias("reason")))


def validate_plates(docs: DataFrame, column: str = "payload") -> DataFrame:
    """Adds ``reason``: NULL for a valid document, else the first rule it breaks."""
    keys = F.json_object_keys(column)

    def has(field: str) -> Column:
        """The field is there, with or without a value."""
        return F.coalesce(F.array_contains(keys, field), F.lit(False))

    # each top-level value as its JSON text, so that a string that looks like a list is told from one
    plate = F.from_json(F.col(column), "map<string,variant>")["plate"]
    kind, n = F.schema_of_variant(plate), F.size(F.try_variant_get(plate, "$", "array<variant>"))
    version = F.get_json_object(column, "$.protocol_version")
    reason = (
        F.when(F.coalesce(version != PROTOCOL_VERSION, F.lit(True)), F.concat(F.lit("unsupported protocol_version: "), F.coalesce(version, F.lit("none"))))
        .when(~has("campaign_id"), F.lit("missing field: campaign_id"))
        .when(~has("round"), F.lit("missing field: round"))
        .when(~has("plate"), F.lit("missing field: plate"))
        .when(~F.coalesce(kind.startswith("ARRAY") & (n > 0), F.lit(False)), F.lit("plate is not a list with items"))
    )
    return docs.withColumn("reason", reason)


def split_valid(docs: DataFrame, column: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(good, quarantined with reason)."""
    checked = validate_plates(docs, column)
    return checked.filter(F.col("reason").isNull()).drop("reason"), checked.filter(F.col("reason").isNotNull())


def results_to_observations(docs: DataFrame, column: str = "doc", source: str = "robot") -> DataFrame:
    """Result documents to observation rows; a missing item id falls back to the well."""
    parsed = docs.select(F.from_json(column, RESULT_JSON).alias("d"))
    rows = parsed.select("d.job_id", F.coalesce("d.round", F.lit(-1)).alias("round"), F.explode("d.results").alias("r"))
    item = F.coalesce(F.nullif(F.col("r.item_id"), F.lit("")), F.col("r.well"), F.lit(""))
    return rows.select(
        "job_id", "round",
        F.coalesce("r.smiles", F.lit("")).alias("smiles"), F.coalesce("r.pool_idx", F.lit(-1)).alias("pool_idx"),
        F.col("r.values").alias("values"), F.col("r.state").alias("state"),
        F.coalesce("r.qc_passed", F.lit(False)).alias("qc_passed"), F.lit(source).alias("source"),
        F.coalesce("r.compound_id", F.lit("")).alias("compound_id"), item.alias("item_id"),
        F.coalesce("r.kind", F.lit("experimental")).alias("kind"), F.coalesce("r.message", F.lit("")).alias("message"),
        F.to_json(F.struct(F.col("r.well").alias("well"), F.col("r.replicate_of").alias("replicate_of"))).alias("raw"),
    )


def best_mode_score(text: Column) -> Column:
    """Affinity from docking output: the second token of the first line that starts with ``1`` and
    whose second token is a number."""
    parts = F.transform(F.split(text, r"\r\n|\r|\n"), lambda line: F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " "))
    mode_one = F.filter(parts, lambda p: (F.size(p) >= 2) & (F.get(p, F.lit(0)) == "1"))
    numbers = F.filter(F.transform(mode_one, lambda p: F.get(p, F.lit(1)).try_cast("double")), lambda v: v.isNotNull())
    return F.get(numbers, F.lit(0))


def parse_logs(logs: DataFrame, text: str = "text") -> DataFrame:
    return logs.withColumn("score", best_mode_score(F.col(text)))
