"""Source trees as DataFrames: scan, classification, ignore rules, and facts read from configuration and schema files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Endings of files that are read, folders left out by default, and other languages by ending.
READ = ("php", "json", "yaml", "yml", "xml", "proto")
SKIPPED = ("vendor", "node_modules", "var", ".git")
LANGUAGES = {"py": "Python", "js": "JavaScript", "ts": "TypeScript", "java": "Java", "go": "Go", "rb": "Ruby", "rs": "Rust", "cs": "C#", "kt": "Kotlin"}


def scan_tree(spark: SparkSession, root: str, excludes: tuple[str, ...] = SKIPPED) -> DataFrame:
    """(path, content, length, modified, hash) of the files below root that are read; path is relative to it. Empty files hold no facts and are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{" + ",".join(READ) + "}").load(root)
    base = re.escape(re.sub(r"^[a-z]+:/*", "/", root).rstrip("/"))
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), f"^{base}/", "")
    out = files.select(path.alias("path"), "content", "length", F.col("modificationTime").alias("modified"), F.sha2(F.col("content"), 256).alias("hash"))
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    return out.where(~F.arrays_overlap(folders, F.array(*(F.lit(x) for x in excludes))) & ~F.col("path").endswith(".blade.php"))


def ignore_rules(file: str, text: str) -> list[tuple[str, bool, bool, str]]:
    """(folder, negated, directories only, regular expression over a path) of the lines of an ignore file, in order."""
    folder = file.rpartition("/")[0]
    rules = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[negated:]
        anchored = "/" in line.rstrip("/")
        parts = re.findall(r"\\.|\*\*/|\*\*|\*|\?|\[[^\]]+\]|[^*?\\\[]+|\[", line.strip("/"))
        known = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
        made = "".join(known.get(p) or (re.escape(p[1]) if p[0] == "\\" else p.replace("[!", "[^") if len(p) > 1 and p[0] == "[" else re.escape(p)) for p in parts)
        lead = f"{re.escape(folder)}/" if folder else ""
        rules.append((folder, negated, line.endswith("/"), f"^{lead}{'' if anchored else '(?:.*/)?'}{made}$"))
    return rules


def without_ignored(files: DataFrame, rules: list[tuple[str, bool, bool, str]]) -> DataFrame:
    """files that the ignore rules leave: for a path and for each directory above it, the last rule that matches decides, those
    of deeper files after those above; nothing below an ignored directory comes back."""
    ordered = sorted(rules, key=lambda r: r[0].count("/") + bool(r[0]))

    def ignored(step: Column) -> Column:
        out: Column = F.lit(False)
        for _, negated, only, pattern in ordered:
            out = F.when(step["path"].rlike(pattern) & (step["folder"] | F.lit(not only)), not negated).otherwise(out)
        return out

    parts = F.split("path", "/")
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(F.array_join(F.slice(parts, 1, k), "/").alias("path"), (k < F.size(parts)).alias("folder")))
    return files.where(~F.exists(steps, ignored)) if rules else files


def classified(files: DataFrame) -> DataFrame:
    """files with what they are: code, composer, routing, configuration, openapi, proto or other."""
    path, head = F.lower("path"), F.decode(F.substring("content", 1, 4096), "UTF-8")
    is_data = path.rlike(r"\.(ya?ml|json)$")
    kind = (
        F.when(path.endswith(".php"), "code")
        .when(path.rlike(r"(^|/)composer\.(json|lock)$"), "composer")
        .when(path.endswith(".proto"), "proto")
        .when(is_data & head.rlike(r"(?m)^[\s{]*[\"']?(openapi|swagger)[\"']?\s*:"), "openapi")
        .when(path.rlike(r"\.ya?ml$") & path.rlike(r"(^|/)rout(es|ing)"), "routing")
        .when(path.rlike(r"(^|/)config/") | path.rlike(r"(^|/)services\.(ya?ml|xml)$"), "configuration")
        .otherwise("other")
    )
    return files.withColumn("kind", kind)


def other_languages(paths: DataFrame) -> DataFrame:
    """(language, files) of paths(path) in languages that are not read, most first: a report of a few rows."""
    names = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    found = paths.select(F.try_element_at(names, F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))).alias("language"))
    return found.where("language is not null").groupBy("language").agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "language")


def proto_rpcs(files: DataFrame) -> DataFrame:
    """(path, line, package, service, rpc) of protobuf files."""
    text = F.decode("content", "UTF-8")
    package = F.regexp_extract(text, r"(?m)^\s*package\s+([\w.]+)\s*;", 1)
    marked = F.transform(F.split(text, r"\R"), lambda x, i: F.struct((i + 1).alias("line"), F.regexp_extract(x, r"^\s*service\s+(\w+)", 1).alias("service"), F.regexp_extract(x, r"^\s*rpc\s+(\w+)", 1).alias("rpc")))
    rows = files.select("path", package.alias("package"), marked.alias("marked"))
    before = F.try_element_at(F.filter("marked", lambda y: (y["service"] != "") & (y["line"] <= F.col("x.line"))), F.lit(-1))
    rows = rows.select("path", "package", "marked", F.explode(F.filter("marked", lambda x: x["rpc"] != "")).alias("x"))
    return rows.select("path", "x.line", "package", before["service"].alias("service"), "x.rpc")


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """files whose (path, hash) the known ones lack."""
    return files.join(known.select("path", "hash"), ["path", "hash"], "left_anti")
