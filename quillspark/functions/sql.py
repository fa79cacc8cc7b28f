"""The library's functions by name, for SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quillspark.functions import analysis, cleaning, ir, normalizers
from quillspark.functions.dialect import SPARK


def register(spark: SparkSession) -> list[str]:
    """Makes functions of texts callable from SQL in this session: scalar ones as SQL functions, which Catalyst inlines, and a table
    function of markdown blocks. Returns their names."""
    metrics = {n: f"cast({e} as {'double' if n.endswith('ratio') else 'bigint'})" for n, e in analysis.measures(SPARK, "x").items()}
    derived = {n: f"cast({_with(e, metrics)} as bigint)" for n, e in analysis.derived(SPARK).items()}
    functions = {
        "normalize_arabic": ("x string", "string", normalizers.fold_index(SPARK, "x")),
        "normalize_search_query": ("x string", "string", normalizers.fold_query(SPARK, "x")),
        "text_similarity": ("a string, b string", "double", cleaning.similarity(SPARK, "a", "b")),
        "text_word_count": ("x string", "bigint", analysis.word_count(SPARK, "x")),
    }
    for name, (arguments, kind, body) in functions.items():
        spark.sql(f"create or replace temporary function {name}({arguments}) returns {kind} return {body}")
    body = f"named_struct({', '.join(f'{chr(39)}{n}{chr(39)}, {e}' for n, e in (metrics | derived).items())})"  # flat, so that Catalyst makes the fields alone that are asked for
    made = spark.sql(f"select {body} as m from values (cast(null as string)) as t(x)").schema["m"].dataType
    kinds = ", ".join(f"{f.name}: {f.dataType.simpleString()}{'' if f.nullable else ' not null'}" for f in made)  # as it is, nulls included: a cast to another type would hide the fields
    spark.sql(f"create or replace temporary function analyze_text(x string) returns struct<{kinds}> return {body}")
    spark.udtf.register("markdown_blocks", ir.ExplodeBlocks)
    return [*functions, "analyze_text", "markdown_blocks"]


def _with(expression: str, values: dict[str, str]) -> str:
    """An expression over names as one over what they stand for."""
    import re

    return re.sub(rf"\b({'|'.join(values)})\b", lambda m: values[m[0]], expression)
