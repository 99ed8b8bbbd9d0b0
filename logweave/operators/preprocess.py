"""Preprocessing stages: each is a function from DataFrame to DataFrame.

A record has (id, message, normalized, level, source, ts, raw, attrs); stages use
what columns they need. Dropping a record is a filter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.masking import Masker
from ..functions.parsing import ParserRegistry

Stage = Callable[[DataFrame], DataFrame]


@dataclass
class Pipeline:
    """Stages applied in order. A pipeline is a stage itself."""

    stages: list[Stage] = field(default_factory=list)

    def __call__(self, df: DataFrame) -> DataFrame:
        for stage in self.stages:
            df = stage(df)
        return df


def pipeline(stages: list[Stage]) -> Pipeline:
    return Pipeline(list(stages))


def add_stage(run: Pipeline, stage: Stage, position: int | None = None) -> Pipeline:
    """A new pipeline with the stage at a position (the end by default)."""
    stages = list(run.stages)
    stages.insert(len(stages) if position is None else position, stage)
    return Pipeline(stages)


def content_id(*columns: str) -> Column:
    """A deterministic id from the content: the same row gets the same id in every run."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def id_stage(id_col: str = "id", columns: tuple[str, ...] = ("source", "raw")) -> Stage:
    """Fills missing ids; one that is given stays."""
    return lambda df: df.withColumn(id_col, F.coalesce(F.nullif(F.col(id_col), F.lit("")), content_id(*columns)))


def parse_stage(registry: ParserRegistry | None = None) -> Stage:
    """Parses records whose message is empty or the raw line; fields already given win."""

    def run(df: DataFrame) -> DataFrame:
        todo = F.col("message").isNull() | (F.col("message") == "") | (F.col("message") == F.col("raw"))
        parsed = df.withColumn("__p", F.when(todo, (registry or ParserRegistry()).parse(F.col("raw"))))
        old, new = F.coalesce(F.col("attrs"), F.expr("cast(map() as map<string,string>)")), F.col("__p.attrs")
        merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.array_contains(F.map_keys(new), k)), new)
        return parsed.withColumns(
            {
                "message": F.when(todo, F.coalesce(F.nullif(F.col("__p.message"), F.lit("")), F.col("message"))).otherwise(F.col("message")),
                "level": F.coalesce("level", "__p.level"),
                "ts": F.coalesce("ts", "__p.ts"),
                "attrs": F.when(new.isNotNull(), merged).otherwise(old),
            }
        ).drop("__p")

    return run


def timestamp_stage(now: Column | None = None, ts_col: str = "ts") -> Stage:
    """Fills missing timestamps by a clock, the query's start unless one is given."""
    return lambda df: df.withColumn(ts_col, F.coalesce(F.col(ts_col), F.current_timestamp() if now is None else now))


def normalize_stage(masker: Masker | None = None) -> Stage:
    return lambda df: df.withColumn("normalized", (masker or Masker()).normalize(F.col("message")))


def filter_stage(keep: Column) -> Stage:
    """Rows for which the predicate is true; Catalyst moves it as near to the scan as it can."""
    return lambda df: df.where(keep)


ERRORS = "errors"
NO_ERRORS = "cast(array() as array<struct<stage:string,error:string>>)"


def _noted(df: DataFrame, name: str, failed: Column, changes: dict[str, Column], on_error: str) -> DataFrame:
    """``df`` with changes where nothing failed; ``failed`` is an error's text or null."""
    if on_error == "raise":
        text = F.concat(F.lit(f"{name}: "), failed)
        first = next(iter(changes))
        changes = {**changes, first: F.when(failed.isNull(), changes[first]).otherwise(F.raise_error(text).cast(df.schema[first].dataType if first in df.columns else "string"))}
        return df.withColumns(changes)
    if on_error == "skip":
        return df.where(failed.isNull()).withColumns(changes)
    have = F.col(ERRORS) if ERRORS in df.columns else F.expr(NO_ERRORS)
    note = F.when(failed.isNull(), have).otherwise(F.array_append(have, F.struct(F.lit(name).alias("stage"), failed.alias("error"))))
    old = lambda c: F.col(c) if c in df.columns else F.lit(None)
    return df.withColumns({**{c: F.when(failed.isNull(), v).otherwise(old(c)) for c, v in changes.items()}, ERRORS: note})


def _known(on_error: str) -> None:
    if on_error not in ("keep", "skip", "raise"):
        raise ValueError(f"on_error is keep, skip or raise, not {on_error}")


def checked_stage(name: str, changes: dict[str, Column], error: Column, on_error: str = "keep") -> Stage:
    """A stage of expressions that says itself where it fails: ``error`` is the error's text, or null. Write the expressions in ``try_`` forms.

    A record that fails keeps its fields, and the error is added to the array column ``errors`` ('keep'); is left out ('skip'); or fails the job ('raise').
    """
    _known(on_error)
    return lambda df: _noted(df, name, error, changes, on_error)


def record_stage(name: str, change: Callable[[dict], dict | None], columns: str, inputs: list[str], on_error: str = "keep") -> Stage:
    """A stage of one's own in Python: ``change`` takes a record's ``inputs`` as a dict and returns the new values of ``columns`` (as DDL); None drops the record.

    What it raises is that record's error and nobody else's, handled as in ``checked_stage``. Values that don't fit their types are errors too.
    Only the inputs become Python objects; all other columns pass by as Arrow arrays.
    """
    _known(on_error)
    out = T.StructType.fromDDL(columns)
    kinds = [to_arrow_type(f.dataType) for f in out.fields]

    def run(df: DataFrame) -> DataFrame:
        given, mark = len(df.columns), "__stage"
        own = df.select("*", *[F.col(c).alias(f"{mark}_{c}") for c in inputs])
        kept = df.schema.fields
        schema = T.StructType([*kept, *[T.StructField(f"{mark}_{f.name}", f.dataType) for f in out.fields], T.StructField(f"{mark}__error", T.StringType()), T.StructField(f"{mark}__drop", T.BooleanType())])

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                values: list[list] = [[] for _ in kinds]
                errors, dropped = [], []
                for row in zip(*[b.column(given + i).to_pylist() for i in range(len(inputs))]) if inputs else [()] * b.num_rows:
                    new, error = None, None
                    try:
                        new = change(dict(zip(inputs, row)))
                        if new is not None:
                            new = [pa.scalar(new.get(f.name), k).as_py() for f, k in zip(out.fields, kinds)]
                    except Exception as e:  # any failure of the function is a result of its record
                        new, error = None, f"{type(e).__name__}: {e}"
                    errors.append(error)
                    dropped.append(new is None and error is None)
                    for held, v in zip(values, new or [None] * len(kinds)):
                        held.append(v)
                made = [pa.array(v, k) for v, k in zip(values, kinds)]
                yield pa.RecordBatch.from_arrays([*b.columns[:given], *made, pa.array(errors, pa.string()), pa.array(dropped, pa.bool_())], names=schema.fieldNames())

        done = own.mapInArrow(of, schema).where(~F.col(f"{mark}__drop"))
        changed = _noted(done, name, F.col(f"{mark}__error"), {f.name: F.col(f"{mark}_{f.name}") for f in out.fields}, on_error)
        return changed.drop(*[c for c in changed.columns if c.startswith(mark)])

    return run


def split_errors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records without errors, those with any); the first without the column of errors."""
    failed = F.size(F.coalesce(F.col(ERRORS), F.expr(NO_ERRORS))) > 0
    return df.where(~failed).drop(ERRORS), df.where(failed)


def error_counts(df: DataFrame) -> DataFrame:
    """(stage, error, n): how often which stage failed in what way."""
    return df.select(F.explode(ERRORS).alias("e")).groupBy("e.stage", "e.error").agg(F.count("*").alias("n"))


def default_pipeline(registry: ParserRegistry | None = None, masker: Masker | None = None, now: Column | None = None) -> Pipeline:
    return Pipeline([id_stage(), parse_stage(registry), timestamp_stage(now), normalize_stage(masker)])


def adapt(df: DataFrame) -> DataFrame:
    """Records from loose rows: message and raw stand in for each other, the source is 'unknown' if missing."""
    have = set(df.columns)
    col = lambda c: F.col(c).cast("string") if c in have else F.lit(None).cast("string")
    some = lambda c: F.nullif(col(c), F.lit(""))
    return df.withColumns(
        {
            "message": F.coalesce(some("message"), some("raw"), F.lit("")),
            "raw": F.coalesce(some("raw"), some("message"), F.lit("")),
            "source": F.coalesce(some("source"), F.lit("unknown")),
        }
    )


def light_json(df: DataFrame, line_col: str = "line") -> DataFrame:
    """The source's own shallow parse: message, level and time of lines that are JSON objects."""
    line = F.col(line_col)
    doc = F.when(line.startswith("{"), F.try_parse_json(line))
    get = lambda k: F.try_variant_get(doc, f"$.{k}", "string")
    return df.withColumns(
        {
            "message": F.coalesce(get("message"), get("msg"), line),
            "level": get("level"),
            "ts": F.try_to_timestamp(get("timestamp"), F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX")),
        }
    )


def with_stats(df: DataFrame, name: str = "preprocess"):
    """``df`` with an Observation of rows out, and of those parsed, normalised and lacking a level."""
    from pyspark.sql import Observation

    seen = Observation(name)
    have = set(df.columns)
    count = lambda c: F.count(F.col(c) if c in have else F.lit(None))
    return df.observe(
        seen, F.count(F.lit(1)).alias("output"), count("message").alias("parsed"), count("normalized").alias("normalized"), count("level").alias("levelled")
    ), seen
