"""Batch prediction with a user's function."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from optrace.functions import prompts
from optrace.functions.cleaning import strip_stop

Predictor = Callable[[list[str]], list[str]]


def predict(
    df: DataFrame, fn: Predictor, batch_size: int = 64, retries: int = 1, contract: str | None = "eval",
    prompt: str = "prompt",
) -> DataFrame:
    """Adds predicted and error. fn maps a list of at most batch_size prompts to as many
    texts; it runs on the workers and may be called again up to `retries` times. A batch that
    keeps failing gives rows with the error and no prediction.

    contract puts the output contract before each prompt ('eval', 'train' or None); the
    prediction ends at the stop token. Set arrow.maxRecordsPerBatch for memory."""
    asked = F.col(prompt) if contract is None else prompts.with_contract(F.col(prompt), contract)
    ready = df.withColumn("_asked", asked)
    kept_names = df.columns
    names = [*kept_names, "predicted", "error"]
    schema = T.StructType(df.schema.fields).add("predicted", "string").add("error", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                texts, error = call(part.column("_asked").to_pylist())
                kept = [part.column(name) for name in kept_names]
                outcome = [pa.array(texts, pa.string()), pa.array([error] * part.num_rows, pa.string())]
                yield pa.RecordBatch.from_arrays(kept + outcome, names=names)

    def call(texts: list[str]):
        error = None
        for _ in range(retries + 1):
            try:
                answers = list(fn(texts))
                if len(answers) != len(texts):
                    raise ValueError(f"{len(answers)} answers to {len(texts)} prompts")
                return answers, None
            except Exception as raised:  # noqa: BLE001 - any failure of user code becomes a row
                error = str(raised) or type(raised).__name__
        return [None] * len(texts), error

    predicted = ready.mapInArrow(run, schema=schema)
    return predicted.withColumn("predicted", strip_stop(F.col("predicted"), "first"))
