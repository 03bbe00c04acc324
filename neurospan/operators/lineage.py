"""Dependencies and version histories as graphs: resolution, closures, roots, depths, cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from neurospan.operators.paths import place
from neurospan.scratch import written

#: What a dependency on a stage needs to be found, as it is named in the folder's path; the dependency's own value is its variant.
STAGES = {
    "preprocessing": {"pipeline": "variant", "subject": "subject", "session": "session", "task": "task", "run": "run"},
    "epochs": {"preprocessing": "preprocessing", "task": "task", "subject": "subject", "session": "session"},
    "source": {"preprocessing": "preprocessing", "task": "task", "variant": "variant", "subject": "subject", "session": "session"},
    "features": {"preprocessing": "preprocessing", "task": "task", "variant": "source", "feature": "variant"},
}
#: In what order values that lack are told.
ORDER = ("subject", "session", "task", "run", "preprocessing", "source")
#: Fixed value: a dependency that names the task and is no output.
TASK = "task"
#: Levels of a closure between two looks for pairs reached before.
AT_ONCE = 3
#: Up to so many versions go by pointer doubling alone.
DOUBLED = 200_000


def resolve(configs: DataFrame, outputs: DataFrame) -> DataFrame:
    """One row per dependency: the columns of configs but depends_on, then dependency, variant, path, found, problem.

    configs: stage, name, depends_on (map of stage to variant), subject, session, task, run. outputs: path,
    the folders there are, relative to the outputs' root. The task is always found and has no path. problem
    is null where the output is there, else: unknown (no such stage), incomplete (a value that the path
    needs is null or empty, named in needs), itself (the configuration depends on itself), or missing. Paths are looked
    up by one join; nothing is listed or opened for each configuration.
    """
    rows = configs.select("*", F.explode("depends_on").alias("dependency", "variant"))
    path, needs = F.lit(None).cast("string"), F.array().cast("array<string>")
    for stage, named in STAGES.items():
        at = {name: F.col("depends_on")[name] if name in STAGES else F.col(name) for name in named.values()}
        lacking = F.filter(F.array(*[F.when(F.coalesce(at[w], F.lit("")) == "", F.lit(w)) for w in ORDER if w in at]), lambda x: x.isNotNull())
        path = F.when(F.col("dependency") == stage, place(stage, **{k: at[name] for k, name in named.items()})).otherwise(path)
        needs = F.when(F.col("dependency") == stage, lacking).otherwise(needs)
    rows = rows.withColumn("needs", needs).withColumn("path", F.when(F.size("needs") == 0, path))
    there = outputs.select("path", F.lit(True).alias("_there")).distinct()
    joined = rows.join(there, "path", "left")
    itself = (F.col("dependency") == F.col("stage")) & (F.col("variant") == F.col("name"))
    problem = (
        F.when(F.col("dependency") == TASK, None).when(~F.col("dependency").isin(*STAGES), "unknown").when(itself, "itself")
        .when(F.size("needs") > 0, "incomplete").when(F.col("_there").isNull(), "missing")
    )
    return joined.withColumn("found", F.coalesce("_there", F.col("dependency") == TASK)).withColumn("problem", problem).drop("_there", "depends_on")


def closure(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """source, target, steps of every pair that a path of one step or more joins; steps are the fewest.

    Level by level: the pairs first reached by the last step are joined with the edges. After every AT_ONCE levels
    what a shorter path reached is taken out, by one anti join with all pairs before; in between a level may hold
    pairs reached before, each once, which the fewest steps then decide. Levels end with the longest shortest path,
    at most AT_ONCE later, over rows written by the level before. Pairs that end at a node without edges aren't carried on.
    Cycles end by themselves: a node of one is its own target. Null ends are no edges; repeated edges count once.
    """
    steps = edges.select(F.col(source).alias("source"), F.col(target).alias("target")).dropna().distinct()
    edge = written(steps, "edges")
    on = edge.select(F.col("source").alias("target"), F.lit(True).alias("on")).distinct()
    edge = written(edge.join(on, "target", "left").select("source", "target", F.coalesce("on", F.lit(False)).alias("on")), "edges")
    last = all_pairs = written(edge.withColumn("steps", F.lit(1)), "reached")
    level = 1
    while last.filter("on").limit(1).count():
        found = None
        for _ in range(AT_ONCE):
            level += 1
            onward = last.filter("on").select("source", F.col("target").alias("_via")).join(edge.withColumnRenamed("source", "_via"), "_via")
            last = written(onward.select("source", "target", "on").distinct().withColumn("steps", F.lit(level)), "reached")
            found = last if found is None else found.unionByName(last)
        fewest = found.groupBy("source", "target").agg(F.first("on").alias("on"), F.min("steps").alias("steps"))
        fresh = written(fewest.join(all_pairs, ["source", "target"], "left_anti"), "reached")
        all_pairs, last = all_pairs.unionByName(fresh), fresh.filter(F.col("steps") == level)
    return all_pairs.select(F.col("source").alias(source), F.col("target").alias(target), "steps")


def cyclic(pairs: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Nodes of a closure that lie on a cycle, those with an edge to themselves too."""
    return pairs.filter(F.col(source) == F.col(target)).select(F.col(source).alias("node"))


def _jumps(versions: DataFrame, version: str, parent: str) -> DataFrame:
    rows = versions.select(F.col(version).alias("version"), F.col(parent).alias("parent"))
    known = rows.select(F.col("version").alias("parent")).distinct().withColumn("_known", F.lit(True))
    joined = rows.join(known, "parent", "left")
    return joined.select("version", F.when(F.col("_known"), F.col("parent")).alias("jump"))


def _coin(version: str, turn: int) -> Column:
    return F.xxhash64(F.col(version), F.lit(turn)) % 2 == 0


def lineage(versions: DataFrame, version: str = "version", parent: str = "parent") -> DataFrame:
    """version, root, depth, cyclic of a table of versions with one parent each, or null.

    Versions are taken out while there are more than DOUBLED of them: in a turn those whose coin shows tails and whose
    parent's shows heads, about a quarter. Their children are joined to their parents, which stay, and carry the distance on.
    What is left goes by pointer doubling, and turn by turn, last first, those taken out are looked up at their parents. As
    turns shrink by a quarter, all of them together shuffle and write a fixed number of rows for each version. Tables are
    never broadcast, however small their files look, so that the driver gets none of them.
    A parent that is no version ends a history. Versions whose history never ends, as it runs into a
    cycle, have cyclic true and neither root nor depth. Versions are distinct and not null.
    """
    state = written(_jumps(versions, version, parent).withColumn("far", F.lit(1).cast("long")), "lineage")
    turns, n = [], state.count()
    while n > DOUBLED:
        turn = len(turns)
        known = F.col("jump").isNotNull()  # hashes pass over nulls
        out = known & ~_coin("version", turn) & _coin("jump", turn)
        gone = state.filter(out)
        turns.append(gone)
        stay = state.filter(~out)
        beyond = known & ~_coin("jump", turn)
        skipped = gone.select(F.col("version").alias("jump"), F.col("jump").alias("_jump"), F.col("far").alias("_far"))
        moved = stay.filter(beyond).join(skipped.hint("merge"), "jump", "left").select("version", F.coalesce("_jump", "jump").alias("jump"), (F.col("far") + F.coalesce("_far", F.lit(0))).alias("far"))
        state = written(stay.filter(~beyond).unionByName(moved), "lineage")
        before, n = n, state.count()
        if before - n < before // 20:  # few have a parent that stays: they are roots or run into themselves at once
            break
    found = _doubled(state, n)
    for turn, gone in reversed(list(enumerate(turns))):
        at = found.filter(_coin("version", turn)).select(F.col("version").alias("jump"), "root", "depth")
        found = found.unionByName(written(gone.join(at.hint("merge"), "jump").select("version", "root", (F.col("far") + F.col("depth")).alias("depth")), "lineage"))
    return found.select(F.col("version").alias(version), "root", "depth", F.col("root").isNull().alias("cyclic"))


def _doubled(jumps: DataFrame, n: int) -> DataFrame:
    """version, root, depth of n versions, from jumps of far steps each, or null.

    Every version knows its ancestor 2^k jumps up, and two such steps make the next one, so there are
    as many joins as the longest history has binary digits.
    """
    end = F.col("jump").isNull()
    state = jumps.select("version", "jump", F.when(end, F.col("version")).alias("root"), F.when(end, 0).cast("long").alias("depth"), "far")
    left, reach = state.filter("root is null").count(), 1
    while left and reach <= n:
        up = state.select(F.col("version").alias("jump"), F.col("jump").alias("_jump"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("far").alias("_far"))
        done = state.filter("root is not null")
        moved = state.filter("root is null").join(up.hint("merge"), "jump", "left").select(
            "version", F.col("_jump").alias("jump"), F.col("_root").alias("root"), (F.col("far") + F.col("_depth")).alias("depth"), (F.col("far") + F.col("_far")).alias("far"))
        state = written(done.unionByName(moved), "lineage")
        left, reach = state.filter("root is null").count(), 2 * reach
    return state.select("version", "root", "depth")


def ancestors(versions: DataFrame, version: str = "version", parent: str = "parent") -> DataFrame:
    """version, ancestor, distance of every ancestor of every version, by doubling as lineage.

    Pairs within 2^k steps, carried on from the ancestor 2^k steps up, give those within 2^(k+1). A
    version on a cycle is an ancestor of itself; the nearest distance counts.
    """
    jump = written(_jumps(versions, version, parent).filter("jump is not null"), "jump")
    pairs = written(jump.select("version", F.col("jump").alias("ancestor"), F.lit(1).cast("long").alias("distance")), "ancestors")
    reach, n = 1, jump.count()
    while reach < n and jump.limit(1).count():
        beyond = jump.join(pairs.select(F.col("version").alias("jump"), "ancestor", (F.col("distance") + reach).alias("distance")), "jump").select("version", "ancestor", "distance")
        pairs = written(pairs.unionByName(beyond).groupBy("version", "ancestor").agg(F.min("distance").alias("distance")), "ancestors")
        jump = written(jump.join(jump.select(F.col("version").alias("jump"), F.col("jump").alias("_jump")), "jump").select("version", F.col("_jump").alias("jump")), "jump")
        reach *= 2
    return pairs.select(F.col("version").alias(version), "ancestor", "distance")


def version_name(config: Column, digits: int = 12) -> Column:
    """The first digits of a configuration's SHA-256, from its canonical JSON text."""
    return F.left(F.sha2(config, 256), F.lit(digits))
