"""Ignore rules: built-in lists, layered ignore files and a tool's own file, evaluated by joins on directories."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.paths import ancestors

# Patterns that always hold, in order; a later match wins.
SAFETY = [".git/", ".env", ".env.*", "!.env.example", "!.env.sample", "*.pem", "*.key", "*.p12", "*.pfx", "id_rsa", "id_rsa.*", "id_ed25519", "id_ed25519.*"]
GENERATED = ["node_modules/", "bower_components/", "vendor/", "dist/", "build/", "out/", "coverage/", ".next/", ".nuxt/", ".svelte-kit/", ".turbo/", ".cache/", "tmp/", "temp/"]


def pattern_parts(pattern: str) -> tuple[str | None, bool, bool]:
    """(regular expression for a path relative to the rule's directory, negated, directories only); None for blanks and comments."""
    text = re.sub(r"(?<!\\)\s+$", "", pattern)
    if not text or text.startswith("#"):
        return None, False, False
    negated = text.startswith("!")
    text = text[1:] if negated else text
    text = text[1:] if text.startswith(("\\#", "\\!")) else text
    only_dirs = text.endswith("/")
    text = text.rstrip("/") if only_dirs else text
    anchored = "/" in text
    text = text.lstrip("/")
    out, i = "", 0
    while i < len(text):
        if text.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif text.startswith("/**", i) and i + 3 == len(text):
            out, i = out + "/.+", i + 3
        elif text.startswith("**", i):
            out, i = out + ".*", i + 2
        elif text[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif text[i] == "?":
            out, i = out + "[^/]", i + 1
        elif text[i] == "[" and "]" in text[i + 2 :]:
            end = text.index("]", i + 2)
            inner = text[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "\\&&")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", end + 1
        elif text[i] == "\\" and i + 1 < len(text):
            out, i = out + re.escape(text[i + 1]), i + 2
        else:
            out, i = out + re.escape(text[i]), i + 1
    return ("^" if anchored else "^(?:[^/]+/)*") + out + "$", negated, only_dirs


def prepared_rules(rules: DataFrame) -> DataFrame:
    """``rules(project_id, base_path, rule_no, pattern)`` with regex, negated and only_dirs; each distinct pattern is translated once."""

    @F.pandas_udf("regex string, negated boolean, only_dirs boolean")
    def parts(patterns: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([pattern_parts(p or "") for p in patterns], columns=["regex", "negated", "only_dirs"])

    known = rules.select("pattern").distinct().withColumn("parts", parts("pattern")).select("pattern", "parts.*").where("regex IS NOT NULL")
    return rules.join(known, "pattern")


def candidates_of(files: DataFrame) -> DataFrame:
    """Each path and each directory above it, as (project_id, path, candidate, depth, is_dir)."""
    ups = F.filter(ancestors(F.col("path")), lambda a: a["depth"] > 0)
    every = F.concat(F.transform(ups, lambda a: F.struct(a["dir"].alias("candidate"), a["depth"].alias("depth"), F.lit(True).alias("is_dir"))), F.array(F.struct(F.col("path").alias("candidate"), F.size(F.split("path", "/")).alias("depth"), F.coalesce("is_dir", F.lit(False)).alias("is_dir"))))
    rows = files if "is_dir" in files.columns else files.withColumn("is_dir", F.lit(False))
    return rows.select("project_id", "path", F.explode(every).alias("c")).select("project_id", "path", "c.*")


def gitignore_decision(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``files(project_id, path[, is_dir])`` -> project_id, path, ignored, pattern, source_path.

    Rules apply below their directory; of those that match, the one in the deepest
    directory, and there the last, decides, and ``!`` includes again; but nothing below
    an ignored directory can be included. Distinct candidates meet the rules of the
    directories above them by one equi-join.
    """
    every = candidates_of(files)
    one = every.select("project_id", "candidate", "is_dir").distinct()
    up = one.withColumn("a", F.explode(ancestors(F.col("candidate")))).select("project_id", "candidate", "is_dir", F.col("a.dir").alias("base_path"), F.col("a.depth").alias("base_depth"))
    ready = prepared_rules(rules)
    inner = F.when(F.col("base_path") == ".", F.col("candidate")).otherwise(F.substring("candidate", F.length("base_path") + 2, F.length("candidate")))
    hits = up.join(ready, ["project_id", "base_path"]).where((~F.col("only_dirs") | F.col("is_dir")) & F.rlike(inner, F.col("regex")))
    last = hits.groupBy("project_id", "candidate", "is_dir").agg(F.max_by(F.struct("negated", "pattern", "base_path"), F.struct("base_depth", "rule_no")).alias("d"))
    bad = every.join(last, ["project_id", "candidate", "is_dir"]).where("NOT d.negated")
    top = bad.groupBy("project_id", "path").agg(F.min_by(F.struct("candidate", "d"), "depth").alias("t"))
    out = files.select("project_id", "path").join(top, ["project_id", "path"], "left")
    return out.select("project_id", "path", F.col("t").isNotNull().alias("ignored"), F.col("t.d.pattern").alias("pattern"), F.col("t.d.base_path").alias("source_path"), F.col("t.candidate").alias("topmost"))


def _listed(files: DataFrame, patterns: list[str]) -> DataFrame:
    every = F.array(*(F.struct(F.lit(".").alias("base_path"), F.lit(n).alias("rule_no"), F.lit(p).alias("pattern")) for n, p in enumerate(patterns)))
    return files.select("project_id").distinct().select("project_id", F.explode(every).alias("r")).select("project_id", "r.*")


def classify_ignored(files: DataFrame, rules: DataFrame, tool_rules: DataFrame | None = None) -> DataFrame:
    """project_id, path, ignored, source, pattern, source_path, topmost: the first of safety, generated, gitignore and tool that ignores a path."""
    layers = [("built_in_safety", _listed(files, SAFETY)), ("built_in_generated", _listed(files, GENERATED)), ("gitignore", rules)]
    layers += [("tool_ignore", tool_rules)] if tool_rules is not None else []
    found = None
    for place, (source, own) in enumerate(layers):
        part = gitignore_decision(files, own).where("ignored").withColumn("source", F.lit(source)).withColumn("place", F.lit(place))
        found = part if found is None else found.unionByName(part)
    first = found.groupBy("project_id", "path").agg(F.min_by(F.struct("source", "pattern", "source_path", "topmost"), "place").alias("d"))
    return files.select("project_id", "path").join(first, ["project_id", "path"], "left").select("project_id", "path", F.col("d").isNotNull().alias("ignored"), F.coalesce("d.source", F.lit("none")).alias("source"), "d.pattern", "d.source_path", "d.topmost")


def prune_ignored(files: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The listing without ignored paths, and by project how many were pruned: a hidden directory counts once."""
    kept = files.join(decisions.where("ignored").select("project_id", "path"), ["project_id", "path"], "left_anti")
    return kept, decisions.where("ignored").groupBy("project_id").agg(F.count_distinct("topmost").alias("ignored_paths"))
