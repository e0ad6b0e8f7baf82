"""What a method runs, so deep: its cone, with the hubs it ends at and what only guesses lead to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from knotwork.functions.words import is_test_path
from knotwork.operators.graph import CLASS_LIKE
from knotwork.operators.impact import CONSTRUCTOR, class_of
from knotwork.session import materialize


def application_callers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, callers): the application classes that call a method, or build the class of a constructor."""
    classes = nodes.where(F.col("kind").isin(*CLASS_LIKE) & F.col("file").isNotNull() & ~is_test_path(F.col("file"))).select(F.col("id").alias("by")).distinct()
    calls = edges.where("relation = 'calls'").select(F.col("target").alias("id"), class_of("source").alias("by"))
    makers = edges.where((F.col("relation") == "has_method") & F.lower("target").endswith(CONSTRUCTOR)).select(F.col("source").alias("_class"), F.col("target").alias("id"))
    built = edges.where("relation = 'instantiates'").select(F.col("target").alias("_class"), class_of("source").alias("by")).join(makers, "_class").select("id", "by")
    return calls.union(built).join(classes, "by", "left_semi").groupBy("id").agg(F.count_distinct("by").alias("callers"))


def run_steps(nodes: DataFrame, edges: DataFrame, implementations: int = 4) -> DataFrame:
    """(at, to, guess): what a method runs in application code: what it calls, constructors of what it builds, and where it is
    abstract the methods that implement it, unless they are more than so many. guess: by ambiguous calls alone."""
    calls = edges.where((F.col("relation") == "calls") & ~F.coalesce(F.col("via"), F.lit("")).startswith("closure of "))
    calls = calls.select(F.col("source").alias("at"), F.col("target").alias("to"), (F.col("confidence") == "AMBIGUOUS").alias("guess"))
    makers = edges.where((F.col("relation") == "has_method") & F.lower("target").endswith(CONSTRUCTOR)).select(F.col("source").alias("_class"), F.col("target").alias("to"))
    built = edges.where("relation = 'instantiates'").select(F.col("source").alias("at"), F.col("target").alias("_class")).join(makers, "_class").select("at", "to", F.lit(False))
    over = edges.where("relation = 'overrides'").select(F.col("target").alias("at"), F.col("source").alias("to")).distinct()
    few = over.groupBy("at").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= implementations).select("at")
    acting = edges.where(F.col("relation").isin("calls", "instantiates")).select(F.col("source").alias("at")).distinct()
    faces = nodes.where("kind = 'interface'").select(F.col("id").alias("_class"))
    ways = over.join(few, "at", "left_semi")
    abstract = ways.join(acting, "at", "left_anti").union(ways.join(faces, class_of(F.col("at")) == F.col("_class"), "left_semi")).distinct()
    found = calls.union(built).union(abstract.select("at", "to", F.lit(False))).groupBy("at", "to").agg(F.min("guess").alias("guess"))
    classes = nodes.where(F.col("kind").isin(*CLASS_LIKE) & F.col("file").isNotNull() & ~is_test_path(F.col("file"))).select(F.col("id").alias("_class")).distinct()
    return found.join(nodes.select(F.col("id").alias("to")).distinct(), "to", "left_semi").join(classes, class_of(F.col("to")) == F.col("_class"), "left_semi").where("at <> to").select("at", "to", "guess")


def run_cone(nodes: DataFrame, edges: DataFrame, start: str, depth: int = 3, hub: int = 20, methods: int = 120, classes: int = 45, implementations: int = 4) -> DataFrame:
    """(id, depth, state, callers): what the method start runs within depth steps.

    state: sure (reached by calls that the code shows), guessed (in every way by a guess at least once), hub (called by many
    classes, or an accessor to an instance: listed and not followed). At most so many methods of so many classes: new classes come in
    the order of their first method, then methods by name.
    """
    steps = materialize(run_steps(nodes, edges, implementations).repartition("at"), "runs")
    callers = materialize(application_callers(nodes, edges), "callers")
    spark = edges.sparkSession
    busy = callers.where(F.col("callers") >= hub).select(F.col("id").alias("to"))
    accessor = F.lower("to").rlike("::(get)?instance$")
    cone = frontier = spark.createDataFrame([(start, 0)], "id string, depth int")
    ends = []
    for level in range(1, depth + 1):
        ahead = materialize(F.broadcast(frontier.select(F.col("id").alias("at"))).join(steps, "at").select("to").distinct(), "ahead")  # frontier: at most so many methods
        marked = ahead.join(busy.withColumn("_busy", F.lit(True)), "to", "left").withColumn("_hub", F.coalesce("_busy", accessor))
        ends.append(marked.where("_hub").select(F.col("to").alias("id"), F.lit(level).alias("depth")))
        new = marked.where(~F.col("_hub")).select(F.col("to").alias("id")).join(F.broadcast(cone.select("id")), "id", "left_anti").withColumn("_class", class_of("id"))
        known = cone.select(class_of("id").alias("_class")).distinct()
        room_methods, room_classes = methods - cone.count(), classes - known.count()
        fresh = new.join(F.broadcast(known), "_class", "left_anti").groupBy("_class").agg(F.min("id").alias("_first"))
        fresh = fresh.withColumn("_n", F.row_number().over(Window.orderBy("_first"))).where(F.col("_n") <= room_classes).select("_class")
        chosen = new.join(F.broadcast(known.union(fresh)), "_class", "left_semi").withColumn("_n", F.row_number().over(Window.orderBy("id"))).where(F.col("_n") <= room_methods)
        frontier = materialize(chosen.select("id", F.lit(level).alias("depth")), "cone")
        if not frontier.limit(1).count():
            break
        cone = materialize(cone.union(frontier), "cone")
    inside = F.broadcast(cone.select("id"))
    read = materialize(steps.where(~F.col("guess")).join(inside.withColumnRenamed("id", "at"), "at", "left_semi").join(inside.withColumnRenamed("id", "to"), "to", "left_semi"), "read")
    sure = level_sure = cone.where("depth = 0").select("id")
    while level_sure.limit(1).count():
        level_sure = materialize(level_sure.select(F.col("id").alias("at")).join(read, "at").select(F.col("to").alias("id")).distinct().join(sure, "id", "left_anti"), "sure")
        sure = sure.union(level_sure)
    found = cone.join(sure.withColumn("_sure", F.lit(True)), "id", "left").select("id", "depth", F.when(F.col("_sure"), "sure").otherwise("guessed").alias("state"))
    met = ends[0]
    for more in ends[1:]:
        met = met.union(more)
    found = found.union(met.groupBy("id").agg(F.min("depth").alias("depth")).select("id", "depth", F.lit("hub")).join(cone.select("id"), "id", "left_anti"))
    return found.join(callers, "id", "left").select("id", "depth", "state", F.coalesce("callers", F.lit(0)).alias("callers"))
