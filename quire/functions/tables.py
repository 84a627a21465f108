"""Table functions: ``register(spark)`` makes them known to SQL."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quire.functions.text import extract_json, finite


@udtf
class ExtractChunks:
    """``extract_chunks(response)``: ord, chunk (its JSON), error: a row for each chunk of a response, by the strict rule of
    ``extract_json``; one row without ord for a response that does not parse, is no object, or whose ``chunks`` is no list of
    objects. None for a response without chunks."""

    @staticmethod
    def analyze(response: AnalyzeArgument) -> AnalyzeResult:
        if not isinstance(response.dataType, StringType):
            raise ValueError(f"extract_chunks takes a string, not {response.dataType.simpleString()}")
        return AnalyzeResult(schema=StructType().add("ord", IntegerType()).add("chunk", StringType()).add("error", StringType()))

    def eval(self, response: str | None) -> Iterator[tuple]:
        try:
            value = extract_json(response or "")
        except ValueError:
            yield None, None, "no JSON object in the response"
            return
        if not isinstance(value, dict):
            yield None, None, "the response is no JSON object"
            return
        chunks = value.get("chunks") or []
        if not isinstance(chunks, list) or not all(isinstance(c, dict) for c in chunks):
            yield None, None, "chunks is no list of objects"
            return
        for i, c in enumerate(chunks):
            yield i, json.dumps(finite(c), ensure_ascii=False), None


def register(spark: SparkSession) -> None:
    spark.udtf.register("extract_chunks", ExtractChunks)
