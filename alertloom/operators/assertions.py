"""Assertions on model outputs, compiled from suite definitions to columns.

An assertion is a dict: suite, test, type, value. Outputs are rows (provider, suite, test, output).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from alertloom.functions.jsontext import is_json, json_objects
from alertloom.functions.once import evaluated_once
from alertloom.operators.feeds import blocks
from alertloom.session import package_on_workers

# JSON schema types and the variant types they cover.
JSON_TYPES = {
    "object": "^OBJECT", "array": "^ARRAY", "string": "^STRING", "boolean": "^BOOLEAN",
    "integer": "^BIGINT", "number": "^(BIGINT|DOUBLE|DECIMAL|FLOAT)", "null": "^VOID",
}
KEYWORDS = {"type", "required", "properties", "enum", "pattern", "title", "description", "$schema"}
RUBRIC = "llm-rubric"


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def fits_schema(value: Column, schema: dict, path: str = "$") -> Column:
    """Whether a variant fits a JSON schema of type, required, properties, enum and pattern. Other
    keywords that restrict values are an error, so that none is passed over."""
    if unknown := set(schema) - KEYWORDS:
        raise ValueError(f"unsupported schema keywords {sorted(unknown)}")
    kind = F.schema_of_variant(F.try_variant_get(value, path, "variant"))
    text = F.try_variant_get(value, path, "string")
    needs = [kind.isNotNull()]
    if "type" in schema:
        needs.append(kind.rlike(JSON_TYPES[schema["type"]]))
    if "enum" in schema:
        needs.append(text.isin(*[str(v) for v in schema["enum"]]))
    if "pattern" in schema:
        needs.append(text.rlike(schema["pattern"]))

    def child(key: str) -> str:
        return f'{path}["{key}"]'

    def present(key: str) -> Column:
        return F.schema_of_variant(F.try_variant_get(value, child(key), "variant")).isNotNull()

    needs += [present(key) for key in schema.get("required", [])]
    for key, inner in schema.get("properties", {}).items():
        needs.append(~present(key) | fits_schema(value, inner, child(key)))
    return F.coalesce(_all(needs), F.lit(False))


def documents(outputs: DataFrame, kinds: set[str]) -> DataFrame:
    """Add the JSON documents of an output: ``is-json`` itself if it is one, ``contains-json`` the objects found in
    it. An output that is one object holds just that; only the others are searched, each once."""
    none = F.array().cast("array<string>")
    whole = F.when(is_json(F.col("output")), F.array("output")).otherwise(none)
    outputs = evaluated_once(outputs, {"_is-json": whole})
    if "contains-json" in kinds:
        package_on_workers(outputs.sparkSession)
        alone = (F.size("`_is-json`") == 1) & F.col("output").rlike(r"^\s*\{")
        searched = F.when(~alone & F.col("output").contains("{"), F.col("output"))
        outputs = outputs.withColumn("_found", json_objects(searched))
        outputs = evaluated_once(outputs, {"_contains-json": F.when(alone, F.array(F.btrim("output", F.lit(" \t\r\n")))).otherwise(
            F.coalesce("_found", none))})
    return outputs


def holds(assertion: dict, output: Column, parsed: dict[str, Column]) -> Column:
    """One assertion as a condition on the output text and its parsed documents."""
    kind, value = assertion["type"], assertion.get("value")
    if kind == "contains":
        return output.contains(value)
    if kind == "icontains-all":
        return _all([F.lower(output).contains(v.lower()) for v in value])
    if kind == "regex":
        return output.rlike(value)
    if kind in ("is-json", "contains-json"):
        if not value:
            return F.size(parsed[kind]) > 0
        return F.exists(parsed[kind], lambda text: fits_schema(F.try_parse_json(text), value))
    raise ValueError(f"unknown assertion type {kind!r}")


def check_outputs(outputs: DataFrame, assertions: list[dict], rubric_col: str | None = None) -> DataFrame:
    """One row per output and assertion of its test, with ``passed``.

    Rubric assertions need a column with a judge's verdict (true or false); without it they are
    skipped.
    """
    usable = [(i, a) for i, a in enumerate(assertions) if a["type"] != RUBRIC or rubric_col]
    kinds = [k for k in ("is-json", "contains-json") if any(a["type"] == k for _, a in usable)]
    given = outputs.columns
    if kinds:
        outputs = documents(outputs, set(kinds))
    parsed = {k: F.col(f"`_{k}`") for k in kinds}

    def hit(numbered: tuple[int, dict]) -> Column:
        i, a = numbered
        verdict = F.col(rubric_col) if a["type"] == RUBRIC else holds(a, F.col("output"), parsed)
        found = F.struct(F.lit(i).alias("assertion"), F.lit(a["type"]).alias("type"),
                         F.coalesce(verdict, F.lit(False)).alias("passed"))
        return F.when((F.col("suite") == a["suite"]) & (F.col("test") == a["test"]), found)

    checked = blocks(outputs, usable, hit, "struct<assertion:int,type:string,passed:boolean>")
    return checked.select(*given, "assertion", "type", "passed")


def test_results(checked: DataFrame) -> DataFrame:
    """A test passes if all its assertions do."""
    return checked.groupBy("provider", "suite", "test").agg(F.every("passed").alias("passed"))


def suite_results(tests: DataFrame) -> DataFrame:
    """Passed and failed tests per provider and suite, ready for pass rates."""
    return tests.groupBy("provider", "suite").agg(
        F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def filled_prompt(template: Column, variables: Column) -> Column:
    """Put the values of a map into the ``{{name}}`` places of a template."""
    return F.aggregate(
        F.map_entries(variables), template,
        lambda text, e: F.replace(text, F.concat(F.lit("{{"), e["key"], F.lit("}}")), e["value"]),
    )


def provider_tests(tests: DataFrame, providers: list[str]) -> DataFrame:
    """Every test once for every provider."""
    return tests.withColumn("provider", F.explode(F.array(*[F.lit(p) for p in providers])))
