"""Keyed combinations, filters and roll-ups of record tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.numbering import number_rows

# Step names by the first text that occurs in a lower-cased context.
CONTEXT_LADDER = [
    ("operation_map", ["operation_map"]),
    ("function_documentation", ["function_documentation", "function_doc", "structured_doc"]),
    ("test_designer", ["test_designer"]),
    ("test_coder", ["test_coder"]),
    ("monolithic_test", ["monolithic_test"]),
    ("validation", ["validation", "c_code_validation"]),
]

# Kinds of failure that a repair is counted for.
FAILURE_TYPES = ["compilation", "assertion", "crash", "memory", "timeout"]


# -- classification ------------------------------------------------------
def classify_context(context: Column) -> Column:
    text = F.lower(context)
    step = None
    for name, marks in CONTEXT_LADDER:
        hit = F.lit(False)
        for mark in marks:
            hit = hit | text.contains(mark)
        step = F.when(hit, F.lit(name)) if step is None else step.when(hit, F.lit(name))
    return step.otherwise(F.lit("other"))


def classify_failure(compile_errors: Column, run_failed: Column, output: Column) -> Column:
    """Kind of failure of a run; the first rule that holds decides."""
    low = F.lower(output)
    asserted = (
        low.contains("assertion failed")
        | (low.contains("assert") & low.contains("failed"))
        | (low.contains("expected") & low.contains("but got"))
    )
    return (
        F.when(~compile_errors & ~run_failed, "none")
        .when(compile_errors, "compilation")
        .when(output.contains("Execution timed out"), "timeout")
        .when(output.contains("AddressSanitizer"), "memory")
        .when(asserted, "assertion")
        .otherwise("crash")
    )


# -- predicates and names ------------------------------------------------
def selected(column: Column, spec: str) -> Column:
    """``all``, ``N+``, ``N-M`` or a comma list of values."""
    if spec == "all":
        return F.lit(True)
    number = F.when(column.cast("string").rlike("^[0-9]+$"), column.cast("string")).cast("long")
    if match := re.fullmatch(r"(\d+)\+", spec):
        named = column.cast("string").isin("coverage", "info")
        return F.coalesce(number >= int(match[1]), F.lit(False)) | named
    if match := re.fullmatch(r"(\d+)-(\d+)", spec):
        return F.coalesce(number.between(int(match[1]), int(match[2])), F.lit(False))
    return column.cast("string").isin(*spec.split(","))


def wildcard(column: Column, pattern: str) -> Column:
    """``*`` stands for any text without a line break; the pattern covers the whole value."""
    parts = [re.sub(r"([^A-Za-z0-9_])", r"\\\1", part) for part in pattern.split("*")]
    return column.rlike("^" + ".*".join(parts) + "$")


def safe_name(column: Column) -> Column:
    """Other characters than letters, digits and _ become _; runs of _ are one; none at the ends."""
    squeezed = F.regexp_replace(F.regexp_replace(column, "[^a-zA-Z0-9_]", "_"), "_+", "_")
    return F.regexp_replace(squeezed, "^_|_$", "")


def with_suffix(df: DataFrame, name: str, order: str, grain: int, out: str) -> DataFrame:
    """``name``, ``name_1``, ``name_2``, ... for equal names in the order of ``order``."""
    numbered = number_rows(df, [name], [order], grain, "_k")
    suffixed = F.when(F.col("_k") == 1, F.col(name)).otherwise(F.concat_ws("_", name, F.col("_k") - 1))
    return numbered.withColumn(out, suffixed).drop("_k")


def non_empty_lines(*parts: Column) -> Column:
    """The parts that are neither NULL nor empty, one per line."""
    return F.concat_ws("\n", *[F.when(p != "", p) for p in parts])


# -- keyed filters -------------------------------------------------------
def only_known(df: DataFrame, names: DataFrame, key: str, all_if_empty: bool = False) -> DataFrame:
    """Rows whose key is in ``names``; with ``all_if_empty`` an empty ``names`` filters nothing."""
    if all_if_empty and names.isEmpty():
        return df
    return df.join(names.select(key).distinct(), key, "left_semi")


def unknown_references(df: DataFrame, catalog: DataFrame, key: str, library: Sequence[str] = ()) -> DataFrame:
    """Rows whose key is in neither the catalog nor the library list."""
    rest = df.join(catalog.select(key).distinct(), key, "left_anti")
    return rest.filter(~F.col(key).isin(*library)) if library else rest


def missing_required(required: Column, included: Column) -> Column:
    return F.array_except(required, included)


def fill_nulls(value: Column, kind: T.DataType) -> Column:
    """A record with its missing texts, arrays and maps empty, at every depth; missing structs stay NULL."""
    if isinstance(kind, T.StringType):
        return F.coalesce(value, F.lit(""))
    if isinstance(kind, T.ArrayType):
        nested = isinstance(kind.elementType, T.StructType)
        items = F.transform(value, lambda x: fill_nulls(x, kind.elementType)) if nested else value
        return F.coalesce(items, F.array().cast(kind))
    if isinstance(kind, T.MapType):
        return F.coalesce(value, F.create_map().cast(kind))
    if isinstance(kind, T.StructType):
        fields = [fill_nulls(value[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def unknown_keys(json: Column, allowed: Sequence[str]) -> Column:
    """Keys of a JSON object that a record with these fields forbids."""
    return F.array_except(F.json_object_keys(json), F.array(*[F.lit(a) for a in allowed]))


# -- keyed combinations --------------------------------------------------
def attach_inner_left(paths: DataFrame, deps: DataFrame, signatures: DataFrame, key: str) -> DataFrame:
    """Paths that have dependencies, with a signature where there is one."""
    return paths.join(deps, key).join(signatures, key, "left")


def attach_known(functions: DataFrame, notes: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Functions that are in ``names`` (all, if it is empty), each with its notes where there are some."""
    return only_known(functions, names, key, all_if_empty=True).join(notes, key, "left")


def upsert(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Take ``columns`` from ``new`` where the key is there, keep the rest, append new keys."""
    fresh = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = old.join(fresh, key, "full")
    others = [c for c in old.columns if c not in columns and c != key]
    taken = [F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in columns]
    return joined.select(key, *others, *taken)


def additive_upsert(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    both = a.select(key, *columns).unionByName(b.select(key, *columns))
    return both.groupBy(key).agg(*[F.sum(c).alias(c) for c in columns])


def latest_or_name(names: DataFrame, catalog: DataFrame, key: str, order: str, columns: Sequence[str]) -> DataFrame:
    """Each name with its catalog entry, the last one where there are several, or without one."""
    last = catalog.groupBy(key).agg(*[F.max_by(c, order).alias(c) for c in columns])
    return names.join(last, key, "left")


def left_update(df: DataFrame, extra: DataFrame, key: str, column: str) -> DataFrame:
    """Replace ``column`` where ``extra`` has a value for the key."""
    added = extra.select(key, F.col(column).alias("_new"))
    return df.join(added, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def merge_terms(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Add two lists of terms by key, as in adding polynomials."""
    return a.select(key, value).unionByName(b.select(key, value)).groupBy(key).agg(F.sum(value).alias(value))


def multiset_difference(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values whose counts differ, with both counts; no rows when the two hold the same elements."""
    sides = a.select(*columns, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*columns, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
    counted = sides.groupBy(*columns).agg(F.sum("_a").alias("n_left"), F.sum("_b").alias("n_right"))
    return counted.filter("n_left <> n_right")


def distinct_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that are not in ``b``."""
    return a.select(*b.columns).subtract(b)


def catalog_entries(catalog: DataFrame) -> DataFrame:
    """Entries of ``all_functions``, ``functions`` and the values of ``source_files``; duplicates stay."""
    present = set(catalog.columns)
    parts = [catalog.select(F.inline(c)) for c in ("all_functions", "functions") if c in present]
    if "source_files" in present:
        parts.append(catalog.select(F.explode(F.map_values("source_files")).alias("l")).select(F.inline("l")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


# -- roll-ups ------------------------------------------------------------
def token_rollup(calls: DataFrame) -> DataFrame:
    """Tokens, calls and mean per ``step``, and a row with NULL step for all."""
    return (
        calls.rollup("step")
        .agg(
            F.sum("tokens").cast("long").alias("input_tokens"),
            F.count(F.lit(1)).alias("api_calls"),
            F.round(F.avg("tokens"), 2).alias("avg_tokens_per_call"),
        )
    )


def message_cost(messages: DataFrame, key: str, tokens: Column) -> DataFrame:
    """Tokens of a call: its messages, 4 for each of them and 3 for the call."""
    return messages.groupBy(key).agg((F.sum(tokens) + F.count(F.lit(1)) * 4 + 3).cast("long").alias("tokens"))


def usage_by_model(calls: DataFrame) -> DataFrame:
    """Calls, prompt and completion tokens per model of a call log."""
    usage = F.col("response.usage")
    return calls.groupBy("model").agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum(usage["prompt_tokens"]).alias("prompt_tokens"),
        F.sum(usage["completion_tokens"]).alias("completion_tokens"),
    )


def validation_summary(info: DataFrame) -> DataFrame:
    """Counts over ``(initial_failure_type, total_iterations, final_status)``."""
    failed_first = F.col("initial_failure_type") != "none"
    passed = F.col("final_status") == "PASS"
    return info.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(passed).alias("passed"),
        F.count_if(~passed).alias("failed"),
        F.count_if(failed_first).alias("needed_repair"),
        F.count_if(failed_first & passed).alias("repaired"),
        F.count_if(passed & ~failed_first).alias("passed_initially"),
    )


def _repaired(info: DataFrame) -> DataFrame:
    return info.filter("initial_failure_type <> 'none' AND final_status = 'PASS'")


def repairs_by_iteration(info: DataFrame) -> DataFrame:
    return _repaired(info).groupBy("total_iterations").agg(F.count(F.lit(1)).alias("repaired"))


def repairs_by_failure(info: DataFrame) -> DataFrame:
    """Repaired tests per kind of failure, zero where there was none."""
    counts = _repaired(info).agg(
        *[F.count_if(F.col("initial_failure_type") == t).alias(t) for t in FAILURE_TYPES])
    pairs = [F.struct(F.lit(t).alias("failure_type"), F.col(t).alias("repaired")) for t in FAILURE_TYPES]
    return counts.select(F.inline(F.array(*pairs)))


def count_ratio(df: DataFrame, top: Column, bottom: Column, name: str) -> DataFrame:
    return df.agg(F.try_divide(F.count_if(top).cast("double"), F.count_if(bottom).cast("double")).alias(name))


def file_rollup(functions: DataFrame, file: str) -> DataFrame:
    """Functions per file, and a row with NULL file for the total and the number of files."""
    per_file = functions.groupBy(file).agg(F.count(F.lit(1)).alias("functions"))
    return per_file.rollup(file).agg(
        F.sum("functions").cast("long").alias("functions"), F.count(F.lit(1)).alias("files"))


def regroup(df: DataFrame, key: str, array: str, first: Sequence[str], order: str) -> DataFrame:
    """Arrays of a key joined in order, with the metadata of its first row."""
    parts = F.sort_array(F.collect_list(F.struct(order, array)))
    return df.groupBy(key).agg(
        F.flatten(F.transform(parts, lambda p: p[array])).alias(array),
        *[F.min_by(c, order).alias(c) for c in first],
    )


def sorted_set(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Distinct values per key, sorted; duplicates go before the shuffle on the key alone."""
    return df.select(key, value).distinct().groupBy(key).agg(F.sort_array(F.collect_list(value)).alias(out))
