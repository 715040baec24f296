"""Sources: folders of files, scanner reports, XML rules, and the unit store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SARIF = (
    "runs array<struct<tool: struct<driver: struct<name: string, rules: array<struct<id: string, properties: map<string, string>>>>>, "
    "results: array<struct<ruleId: string, level: string, message: struct<text: string>, "
    "locations: array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, region: struct<startLine: int, endLine: int>>>>, "
    "partialFingerprints: map<string, string>>>>>"
)


def scan_folder(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, length, modificationTime of the files below root; contents are read only if asked for."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)


def sarif_findings(reports: DataFrame, text: str = "report") -> DataFrame:
    """A row for each result of SARIF reports. Only the first location counts; a result without any is dropped."""
    runs = reports.select(F.explode(F.from_json(text, SARIF)["runs"]).alias("run"))
    results = runs.select(F.col("run.tool.driver.name").alias("tool"), F.col("run.tool.driver.rules").alias("rules"), F.explode("run.results").alias("r"))
    at = F.get("r.locations", F.lit(0))["physicalLocation"]
    rule = F.get(F.filter("rules", lambda x: x["id"] == F.col("r.ruleId")), F.lit(0))
    score = rule["properties"]["security-severity"].cast("double")
    return results.where(at.isNotNull()).select(
        "tool",
        F.col("r.ruleId").alias("rule_id"),
        at["artifactLocation"]["uri"].alias("file_path"),
        at["region"]["startLine"].alias("line_start"),
        severity(score, F.col("r.level")).alias("severity"),
        F.col("r.message.text").alias("message"),
        F.element_at("r.partialFingerprints", "primary").alias("fingerprint"),
    )


def severity(score: Column, level: Column) -> Column:
    """By security score if there is one, else by level."""
    by_score = F.when(score >= 9.0, "critical").when(score >= 7.0, "high").when(score >= 4.0, "medium").when(score >= 1.0, "low").when(score.isNotNull(), "info")
    return F.coalesce(by_score, F.when(level == "error", "high").when(level == "warning", "medium").when(level == "note", "low").otherwise("medium"))


def xml_rules(rules: DataFrame, text: str = "xml") -> DataFrame:
    """Rules of an XML pack: id, category, and the pattern of a function name, by kind of predicate."""
    r = F.from_xml(F.col(text), "RuleID string, Category string, Function string, Match string")
    pattern = F.when(r["Match"] == "starts", F.concat(F.lit("prefix:"), r["Function"])).when(r["Match"] == "ends", F.concat(F.lit("suffix:"), r["Function"])).otherwise(r["Function"])
    return rules.select(r["RuleID"].alias("rule_id"), F.lower(r["Category"]).alias("category"), pattern.alias("pattern"))


def write_units(units: DataFrame, path: str) -> None:
    """The unit store: Parquet by language; a later write replaces only the languages that it holds."""
    units.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("language").parquet(path)
