"""Resolution of calls and imports: inside a file by language, across files by qualified name, imports by path and alias."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codelode.functions.text import directory, language_of_path, module_prefix, normalized_path
from codelode.operators.tables import calls, imports, symbols

#: What is tried after a path without extension.
PROBES = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]


def _first(symbols_: DataFrame, key: Column | str, alias: str, value: str) -> DataFrame:
    rows = symbols_.select("repo", "path", (F.col(key) if isinstance(key, str) else key).alias(alias), "sym_ord", "local_key").where(F.col(alias).isNotNull())
    return rows.groupBy("repo", "path", alias).agg(F.min_by("local_key", "sym_ord").alias(value))


def in_file(files: DataFrame) -> DataFrame:
    """``repo, path, call_ord, callee_name, local_key, external``: the symbol of the same file that each call means, by the rules of the file's language.

    Rust: a qualified name must match exactly, else the call is external; a bare name is looked for in the caller's module, else among the file's top-level symbols. Others: first symbol of that name, then of that
    qualified name; JavaScript also takes the part before the first dot; TypeScript marks names with ``::`` that match nothing as external.
    """
    s, c = symbols(files), calls(files)
    language = files.select("repo", "path", "language")
    rows = c.select("repo", "path", "call_ord", "caller_local_key", "callee_name").join(language, ["repo", "path"])
    caller = s.select("repo", "path", F.col("local_key").alias("caller_local_key"), F.col("qualified_name").alias("caller_name"), "sym_ord").groupBy("repo", "path", "caller_local_key").agg(F.min_by("caller_name", "sym_ord").alias("caller_name"))
    rows = rows.join(caller, ["repo", "path", "caller_local_key"], "left")
    scoped = F.when((F.col("language") == "Rust") & F.col("callee_name").isNotNull(), F.when(F.col("callee_name").contains("::"), F.col("callee_name")).otherwise(F.concat_ws("::", module_prefix(F.col("caller_name")), "callee_name")))
    rows = rows.withColumn("k_name", F.when(F.col("language") != "Rust", F.col("callee_name"))).withColumn("k_qualified", F.coalesce(scoped, "callee_name"))
    rows = rows.withColumn("k_root", F.when((F.col("language") == "Rust") & ~F.col("callee_name").contains("::"), F.col("callee_name"))).withColumn("k_first", F.when((F.col("language") == "JavaScript") & F.col("callee_name").contains("."), F.substring_index("callee_name", ".", 1)))
    root = F.when(~F.col("qualified_name").contains("::"), F.col("qualified_name"))
    for key, source, value in (("k_name", "name", "v_name"), ("k_qualified", "qualified_name", "v_qualified"), ("k_root", root, "v_root"), ("k_first", "name", "v_first")):
        rows = rows.join(_first(s, source, key, value), ["repo", "path", key], "left")
    local = F.when(F.col("language") == "Rust", F.coalesce("v_qualified", "v_root")).otherwise(F.coalesce("v_name", "v_qualified", "v_first"))
    external = local.isNull() & F.col("callee_name").contains("::") & F.col("language").isin("Rust", "TypeScript")
    return rows.select("repo", "path", "call_ord", "callee_name", local.alias("local_key"), F.coalesce(external, F.lit(False)).alias("external"))


def across_files(files: DataFrame) -> DataFrame:
    """The calls with ``callee_file`` and ``callee_external`` set: names with ``::`` that nothing has resolved are looked up among all qualified names of the repository (the first file that has it);
    a name of the same file stays as it is, an unknown one is external."""
    s, c = symbols(files), calls(files)
    index = s.where("qualified_name LIKE '%::%'").groupBy("repo", F.col("qualified_name").alias("callee_name")).agg(F.min("path").alias("found"))
    rows = c.join(index, ["repo", "callee_name"], "left")
    open_ = F.col("callee_local_key").isNull() & F.col("callee_file").isNull() & F.col("callee_name").contains("::")
    elsewhere = open_ & F.col("found").isNotNull() & (F.col("found") != F.col("path"))
    external = F.when(elsewhere, False).when(open_ & F.col("found").isNull(), True).otherwise(F.col("callee_external"))
    return rows.withColumn("callee_file", F.when(elsewhere, F.col("found")).otherwise(F.col("callee_file"))).withColumn("callee_external", external).drop("found").select(*c.columns)


def nearest_config(files: DataFrame, configs: DataFrame) -> DataFrame:
    """``repo, path, dir``: the configuration directory (``repo, dir``) that is the longest ancestor of each file's directory; null if none is.

    Every file is exploded into its few ancestors and equi-joined with the directories: no range comparison.
    """
    parts = F.split(directory(F.col("path")), "/")
    ancestors = F.concat(F.array(F.lit("")), F.when(directory(F.col("path")) == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))))
    rows = files.select("repo", "path", F.explode(ancestors).alias("dir"))
    governed = rows.join(configs.select("repo", "dir").distinct(), ["repo", "dir"]).groupBy("repo", "path").agg(F.max_by("dir", F.length("dir")).alias("dir"))
    return files.select("repo", "path").join(governed, ["repo", "path"], "left")


def alias_candidate(spec: Column, paths: Column, base_url: Column) -> Column:
    """The path that an alias map gives for a specifier: keys in byte order, the first that matches, its first target; null if none matches. Text after the star of a key is ignored."""
    keys = F.array_sort(F.map_keys(paths))
    fits = F.filter(keys, lambda k: F.when(k.contains("*"), F.startswith(spec, F.substring_index(k, "*", 1))).otherwise(spec == k))
    key = F.get(fits, F.lit(0))
    suffix = F.when(key.contains("*"), F.substring(spec, F.length(F.substring_index(key, "*", 1)) + 1, F.length(spec))).otherwise("")
    target = F.get(F.element_at(paths, key), F.lit(0))
    filled = F.when(target.contains("*"), F.concat(F.substring_index(target, "*", 1), suffix, F.substring(target, F.length(F.substring_index(target, "*", 1)) + 2, F.length(target)))).otherwise(target)
    base = F.rtrim(F.coalesce(base_url, F.lit(".")), F.lit("/"))
    return F.when(key.isNotNull(), F.when(base.isin("", "."), filled).otherwise(F.concat(base, F.lit("/"), filled)))


def import_candidates(imports_: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """Adds ``candidate`` to ``repo, path, target_module`` rows: relative specifiers against the file's directory, others through the nearest configuration's aliases (``repo, dir, base_url, paths``); null for packages."""
    spec = F.col("target_module")
    relative = spec.startswith("./") | spec.startswith("../")
    own = normalized_path(F.concat_ws("/", directory(F.col("path")), spec))
    if configs is None:
        return imports_.withColumn("candidate", F.when(relative, own))
    near = nearest_config(imports_.select("repo", "path").distinct(), configs).join(configs, ["repo", "dir"], "left")
    rows = imports_.join(near, ["repo", "path"], "left")
    return rows.withColumn("candidate", F.when(relative, own).when(F.col("paths").isNotNull(), alias_candidate(spec, F.col("paths"), F.col("base_url")))).drop("dir", "base_url", "paths")


def probed(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``resolved``: the first existing file among a candidate and its continuations (only tried where the last part has no dot). ``files``: the existing paths of each repository."""
    keyed = rows.select("repo", "candidate").where("candidate IS NOT NULL").distinct()
    dotted = F.element_at(F.split("candidate", "/"), -1).contains(".")
    tries = F.when(dotted, F.array(F.lit(""))).otherwise(F.array(*[F.lit(p) for p in PROBES]))
    variants = keyed.select("repo", "candidate", F.posexplode(tries).alias("priority", "tail")).withColumn("path", F.concat("candidate", "tail"))
    hits = variants.join(files.select("repo", "path").distinct(), ["repo", "path"], "left_semi").groupBy("repo", "candidate").agg(F.min_by("path", "priority").alias("resolved"))
    return rows.join(hits, ["repo", "candidate"], "left")


def linked_imports(files: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """The import rows of TypeScript and JavaScript files with ``resolved`` set anew: the file that the specifier leads to, directly or through the nearest configuration's aliases; the imports of other languages as they are."""
    rows = imports(files)
    script = language_of_path(F.col("path")).isin("TypeScript", "JavaScript")
    mine = rows.where(script).drop("resolved")
    found = probed(import_candidates(mine, configs), files.select("repo", "path"))
    return found.select(*rows.columns).unionByName(rows.where(~script | script.isNull()))
