"""What the names of a group have in common, as one pattern: `a.{b,c}.d`.

The longest common beginning of any set of sequences is that of its least and its greatest, so it needs no list of the
set: minimum and maximum are merged by partial aggregation, and the same of the reversed sequences gives the end. What lies between is
made distinct by a shuffle before it is listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _common(a: Column, b: Column) -> Column:
    """How many first elements two arrays share."""
    both = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, both), F.slice(b, 1, both), lambda x, y: x == y)
    at = F.array_position(same, F.lit(False))
    return F.when(at > 0, at - 1).otherwise(both).cast("int")


def _listed(rows: DataFrame) -> DataFrame:
    """(group, middles) from rows(group, middle, name): the distinct middles in the order of their first names."""
    once = rows.groupBy("group", "middle").agg(F.min("name").alias("name"))
    return once.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("name", "middle"))).alias("_m")).select("group", F.array_join(F.transform("_m", lambda x: x["middle"]), ",").alias("middles"))


def common_patterns(names: DataFrame, by: str = ".") -> DataFrame:
    """(group, pattern) of names(group, name): the parts that all of a group share at the beginning and at the end, and in braces
    what differs. A group of one name has that name. Null names are none."""
    # the group as a struct, in which nulls are equal
    rows = names.where("name is not null").select(F.struct("group").alias("group"), "name").distinct().withColumn("parts", F.split("name", f"\\Q{by}\\E"))
    ends = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("parts").alias("a"), F.max("parts").alias("b"), F.min(F.reverse("parts")).alias("c"), F.max(F.reverse("parts")).alias("d"), F.min(F.size("parts")).alias("least"))
    ends = ends.select("group", "n", "a", _common(F.col("a"), F.col("b")).alias("first"), _common(F.col("c"), F.col("d")).alias("last"), "least")
    ends = ends.withColumn("last", F.least("last", F.col("least") - F.col("first")))
    middle = F.array_join(F.slice("parts", F.col("first") + 1, F.size("parts") - F.col("first") - F.col("last")), by)
    middles = _listed(rows.join(ends, "group").select("group", middle.alias("middle"), "name"))
    joined = ends.join(middles, "group")
    braces = F.concat(F.lit("{"), "middles", F.lit("}"))
    end = F.slice("a", F.size("a") - F.col("last") + 1, F.col("last"))
    pattern = F.array_join(F.concat(F.slice("a", 1, F.col("first")), F.array(braces), end), by)
    return joined.select("group.group", F.when(F.col("n") == 1, F.array_join("a", by)).otherwise(pattern).alias("pattern"))


def grouped_signatures(signatures: DataFrame) -> DataFrame:
    """(group, pattern) of signatures(group, signature), `name(parameters)`: those of a group with the same parameters as one, which names what
    differs, cut at words of the camel case: `add{Context,Policy}Violation(int $x)`."""
    at = F.locate("(", F.col("signature"))
    rows = signatures.where("signature is not null").distinct().select(
        F.struct("group", F.when(at > 0, F.substr("signature", at)).otherwise("").alias("rest")).alias("group"), F.when(at > 0, F.substr("signature", F.lit(1), at - 1)).otherwise(F.col("signature")).alias("name"),
    )
    chars = F.split("name", "")
    ends = rows.withColumn("chars", chars).groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("chars").alias("a"), F.max("chars").alias("b"), F.min("name").alias("some"))
    ends = ends.withColumn("shared", _common(F.col("a"), F.col("b"))).select("group", "n", "some", "shared")
    joined = rows.join(ends, "group")
    # within what all share, a word begins for all or for none; after it, for each name
    begins = F.substr("name", F.col("shared") + 1, F.lit(1)).rlike("^([A-Z]|$)")
    starts = joined.groupBy("group").agg(F.min(begins).alias("clean"))
    common = F.substr("some", F.lit(1), F.col("shared"))
    earlier = F.length(F.regexp_extract(common, "^(.*)[A-Z]", 1))
    ends = ends.join(starts, "group").withColumn("first", F.when(F.col("clean"), F.col("shared")).otherwise(earlier))
    tails = rows.join(ends, "group").withColumn("tail", F.substr("name", F.col("first") + 1)).withColumn("chars", F.reverse(F.split("tail", "")))
    last = tails.groupBy("group").agg(F.min("chars").alias("c"), F.max("chars").alias("d"), F.min(F.length("tail")).alias("least"), F.min("tail").alias("_tail"))
    last = last.withColumn("ending", F.least(_common(F.col("c"), F.col("d")), F.col("least")))
    # the longest shared ending that begins with a capital
    shared = F.substr("_tail", F.length("_tail") - F.col("ending") + 1)
    last = last.select("group", F.regexp_extract(shared, "([A-Z].*)$", 1).alias("suffix"))
    middles = tails.join(last, "group").select("group", F.substr("tail", F.lit(1), F.length("tail") - F.length("suffix")).alias("middle"), "name")
    listed = ends.join(last, "group").join(_listed(middles), "group")
    pattern = F.concat(F.substr("some", F.lit(1), F.col("first")), F.lit("{"), "middles", F.lit("}"), "suffix")
    name = F.when(F.col("n") == 1, F.col("some")).otherwise(pattern)
    return listed.select(F.col("group.group").alias("group"), F.concat(name, F.col("group.rest")).alias("pattern"))
