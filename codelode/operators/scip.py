"""Compiler-grade call bindings: occurrences of symbols joined with their definitions, implementations of traits, alignment with parsed calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CALLABLE = ["Method", "StaticMethod", "TraitMethod", "Function", "Macro"]


def is_definition(roles: Column) -> Column:
    return roles.bitwiseAND(1) == 1


def unique_definitions(occurrences: DataFrame) -> DataFrame:
    """``symbol, def_file, def_line``: symbols with exactly one distinct place of definition; local symbols and short ranges are no occurrences."""
    rows = occurrences.where(is_definition(F.col("roles")) & ~F.startswith("symbol", F.lit("local ")) & (F.size("range") >= 3))
    place = F.struct(F.col("doc").alias("def_file"), (F.get("range", F.lit(0)) + 1).alias("def_line"))
    return rows.groupBy("symbol").agg(F.count_distinct(place).alias("n"), F.min(place).alias("d")).where("n = 1").select("symbol", "d.def_file", "d.def_line")


def display_name(symbol: Column) -> Column:
    """``Type::name`` (or ``name``) of a symbol's descriptors: the last method, function or macro descriptor behind the last type; for ``impl#[T]`` or ``impl#[T][Trait]`` the type T. Backticks are dropped."""
    tail = F.regexp_replace(F.regexp_extract(symbol, r"(?:^|\s)(\S+)$", 1), "`", "")
    name = F.regexp_extract(tail, r"([^/#.:\[\]()!]+)(?:\(\+?\d*\)|\(\))?[.!:]*$", 1)
    owner = F.coalesce(F.nullif(F.regexp_extract(tail, r"impl#\[([^\]]+)\]", 1), F.lit("")), F.nullif(F.regexp_extract(tail, r"([^/#.:\[\]()!]+)#[^#]*$", 1), F.lit("")))
    return F.when(owner.isNotNull(), F.concat(owner, F.lit("::"), name)).otherwise(name)


def trait_identity(symbol: Column) -> Column:
    """``trait, method, is_impl`` of ``impl#[T][Trait]name`` and ``Trait#name`` symbols; nulls for others."""
    tail = F.regexp_replace(F.regexp_extract(symbol, r"(?:^|\s)(\S+)$", 1), "`", "")
    implemented = F.nullif(F.regexp_extract(tail, r"impl#\[[^\]]+\]\[([^\]]+)\]", 1), F.lit(""))
    declared = F.nullif(F.regexp_extract(tail, r"([^/#.:\[\]()!]+)#[^#]*$", 1), F.lit(""))
    method = F.nullif(F.regexp_extract(tail, r"([^/#.:\[\]()!]+)\(\+?\d*\)\.$", 1), F.lit(""))
    is_impl = tail.contains("impl#[")
    return F.struct(F.when(is_impl, implemented).otherwise(declared).alias("trait"), method.alias("method"), is_impl.alias("is_impl"))


def bindings(occurrences: DataFrame, kinds: DataFrame) -> DataFrame:
    """``file, line, column, symbol, callee_file, callee_line, callee_qualified_name, dispatch, impl_candidates``: references to callable symbols with one definition, distinct.

    ``dispatch`` is ``trait`` if the callee is a trait's method that others implement; the candidates are then the implementations with one definition, by file and line.
    """
    defined = unique_definitions(occurrences)
    callable_ = kinds.where(F.col("kind").isin(CALLABLE)).select("symbol").distinct()
    refs = occurrences.where(~is_definition(F.col("roles")) & ~F.startswith("symbol", F.lit("local ")) & (F.size("range") >= 3))
    refs = refs.select(F.col("doc").alias("file"), (F.get("range", F.lit(0)) + 1).alias("line"), F.get("range", F.lit(1)).alias("column"), "symbol").distinct().join(callable_, "symbol", "left_semi").join(defined, "symbol")
    ident = defined.withColumn("i", trait_identity(F.col("symbol"))).where("i.trait IS NOT NULL AND i.method IS NOT NULL")
    impls = ident.where("i.is_impl").groupBy("i.trait", "i.method").agg(F.sort_array(F.collect_set(F.struct(F.col("def_file").alias("file"), F.col("def_line").alias("line"), display_name(F.col("symbol")).alias("qualified_name")))).alias("impl_candidates"))
    rows = refs.withColumn("i", trait_identity(F.col("symbol"))).withColumn("trait", F.when(~F.col("i.is_impl"), F.col("i.trait"))).withColumn("method", F.col("i.method"))
    rows = rows.join(impls, ["trait", "method"], "left")
    none = F.array().cast(impls.schema["impl_candidates"].dataType)
    return rows.select("file", F.col("line").cast("bigint").alias("line"), F.col("column").cast("bigint").alias("column"), "symbol", F.col("def_file").alias("callee_file"), F.col("def_line").cast("bigint").alias("callee_line"), display_name(F.col("symbol")).alias("callee_qualified_name"), F.when(F.col("impl_candidates").isNotNull(), "trait").otherwise("static").alias("dispatch"), F.coalesce("impl_candidates", none).alias("impl_candidates"))


def aligned(bindings_: DataFrame, symbols_: DataFrame) -> DataFrame:
    """Bindings whose callee line lies inside the span of a symbol of the callee's file; a hash join on the file with the span as residual condition."""
    b, s = bindings_.alias("b"), symbols_.alias("s")
    inside = (F.col("b.callee_file") == F.col("s.path")) & F.col("b.callee_line").between(F.col("s.start_line"), F.col("s.end_line"))
    return b.join(s, inside, "left_semi")
