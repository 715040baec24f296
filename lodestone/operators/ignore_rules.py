"""Which files of a tree are ignored, by the rule files of all folders above them.

Rules of one folder are one row, an array in their order. Every folder and file is judged once, by the rules of the folders above it: of the deepest
folder that has a matching rule, the last such rule counts. A file is ignored if it or any folder above it is, so nothing below an
ignored folder comes back.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What every tree ignores.
DEFAULT_RULES = (".git", "__pycache__", "*.pyc", ".DS_Store")
#: Folders with rules that are broadcast; beyond, Spark chooses.
BROADCAST_FOLDERS = 100_000


def rule_regex(pattern: str) -> str:
    """A rule's pattern as an expression of whole paths below its folder: with a slash within it holds from that folder, else at any depth."""
    body = pattern.strip("/")
    out, i = "", 0
    while i < len(body):
        if body[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif body[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i + 2 :]:
            end = body.index("]", i + 2)
            inner = body[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out, i = out + ("[^" + inner[1:] if inner[0] in "!^" else "[" + inner) + "]", end + 1
        else:
            i += body[i] == "\\" and i + 1 < len(body)
            out, i = out + re.escape(body[i]), i + 1
    anchored = "/" in pattern.rstrip("/")
    return "^" + ("" if anchored else "(?:.*/)?") + out + "$"


def _regex(pattern: Column) -> Column:
    def convert(batch: pd.Series) -> pd.Series:
        return batch.map(rule_regex)

    return F.pandas_udf(convert, "string")(pattern)


def read_rules(rule_files: DataFrame) -> DataFrame:
    """folder, rules (regex, folders_only, back: of each line, in order) of rule_files(folder, content). The top folder is ''. Blank lines and those
    that begin with # are none; ! before a pattern takes back; a slash behind it is for folders only."""
    lines = rule_files.where("folder is not null and content is not null").select("folder", F.posexplode(F.split("content", "\r?\n")).alias("seq", "line"))
    text = lines.select("folder", "seq", F.rtrim("line").alias("line")).where("line <> '' and not startswith(line, '#')")
    back = F.startswith("line", F.lit("!"))
    body = text.select("folder", "seq", back.alias("back"), F.when(back, F.expr("substr(line, 2)")).otherwise(F.col("line")).alias("pattern")).where("btrim(pattern, '/') <> ''")
    rules = body.select("folder", "seq", _regex(F.col("pattern")).alias("regex"), F.endswith("pattern", F.lit("/")).alias("folders_only"), "back")
    return rules.groupBy("folder").agg(F.array_sort(F.collect_list(F.struct("seq", "regex", "folders_only", "back"))).alias("rules"))


def _folders(path: str) -> Column:
    """The folders above a path, the top one first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def ignored_items(files: DataFrame, rules: DataFrame) -> DataFrame:
    """path, is_folder of the folders and files of files(path) that a rule ignores."""
    items = files.select(F.explode(F.filter(_folders("path"), lambda f: f != "")).alias("path"), F.lit(True).alias("is_folder")).unionByName(files.select("path", F.lit(False).alias("is_folder"))).distinct()
    above = items.select("path", "is_folder", F.posexplode(_folders("path")).alias("depth", "folder"))
    few = F.broadcast(rules) if rules.count() <= BROADCAST_FOLDERS else rules
    met = above.join(few, "folder").withColumn("below", F.when(F.col("folder") == "", F.col("path")).otherwise(F.expr("substr(path, char_length(folder) + 2)")))
    last = F.aggregate("rules", F.lit(None).cast("boolean"), lambda known, r: F.when(F.regexp_like(F.col("below"), r["regex"]) & (~r["folders_only"] | F.col("is_folder")), ~r["back"]).otherwise(known))
    judged = met.withColumn("ignored", last).where("ignored is not null").groupBy("path", "is_folder").agg(F.max_by("ignored", "depth").alias("ignored"))
    return judged.where("ignored").select("path", "is_folder")


def scan(files: DataFrame, rule_files: DataFrame, suffixes: Sequence[str], max_kb: float, defaults: Sequence[str] = DEFAULT_RULES) -> DataFrame:
    """files(path, length, ...) with reason: "ignored", "extension" (none of suffixes), "size" (over max_kb), or null for files to take."""
    spark = files.sparkSession
    # Defaults come before the top folder's own rules, which may take them back.
    own = rule_files.where("folder is not null and content is not null").groupBy("folder").agg(F.array_join(F.array_sort(F.collect_list("content")), "\n").alias("content"))
    top = spark.createDataFrame([("", "\n".join(defaults))], "folder string, first string")
    both = own.join(F.broadcast(top), "folder", "full_outer").select("folder", F.concat_ws("\n", "first", "content").alias("content"))
    paths = files.select("path").where("path is not null").distinct()
    gone = ignored_items(paths, read_rules(both)).withColumn("hit", F.lit(True))
    ways = paths.select("path", F.explode(F.concat(F.filter(_folders("path"), lambda f: f != ""), F.array("path"))).alias("item"), F.lit(True).alias("one"))
    ways = ways.withColumn("is_folder", F.col("item") != F.col("path"))
    bad = ways.join(gone.withColumnRenamed("path", "item"), ["item", "is_folder"], "left_semi").select("path").distinct().withColumn("hit", F.lit(True))
    known = F.lit(False)
    for s in suffixes:
        known = known | F.endswith("path", F.lit(s))
    reason = F.when(F.col("hit"), "ignored").when(~known, "extension").when(F.col("length") / 1024 > max_kb, "size")
    return files.join(bad, "path", "left").withColumn("reason", reason).drop("hit")
