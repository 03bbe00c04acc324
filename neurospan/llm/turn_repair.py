"""Repair of conversations: faults from windows, and a fold over a conversation's turns that finds the cheapest edits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from neurospan.llm.common import table

#: ASCII white space, for trimming.
BLANK = " \t\n\x0b\x0c\r"
#: What edits cost, and an undeleted truncated turn besides.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: More than any conversation of long turns can cost.
NEVER = 1 << 40


def stripped(text: Column) -> Column:
    """The text without white space at its end."""
    return F.rtrim(text, F.lit(BLANK))


def faults(turns: DataFrame, keys: list[str]) -> DataFrame:
    """turns with position, fault (0 none, 1 blank, 2 duplicate, 3 truncated) and illegal added.

    Turns are in the order of turn (nulls first), then role and text. A turn is blank without a character
    other than white space, a duplicate where an earlier one has its role and text, truncated where its
    last such character isn't one of . ! ?; the first that holds counts. illegal marks a turn whose
    initial may not follow the one before: su, ua and au may. All windows lie within keys, so one shuffle serves them.
    """
    whole, same = W.partitionBy(*keys).orderBy("position"), W.partitionBy(*keys, "role", "text").orderBy("position")
    turns = turns.withColumn("position", F.row_number().over(W.partitionBy(*keys).orderBy(F.asc_nulls_first("turn"), "role", "text")))
    end = stripped(F.col("text"))
    initial = F.substring("role", 1, 1)
    pair = F.concat(F.lag(initial).over(whole), initial)
    fault = F.when(end == "", 1).when(F.row_number().over(same) > 1, 2).when(~F.right(end, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    return turns.withColumns({"fault": fault, "illegal": F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False))})


def _after(path: Column, cost: int | Column, letter: str) -> Column:
    return F.struct((path["cost"] + cost).cast("long").alias("cost"), F.concat(path["audit"], F.lit(letter)).alias("audit"))


def _state(start: Column, system: Column, user: Column, assistant: Column) -> Column:
    return F.struct(start.alias("start"), system.alias("system"), user.alias("user"), assistant.alias("assistant"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _with_inserts(x: Column) -> Column:
    """The states with inserts allowed before whatever comes next.

    An inserted turn leads to user from any other state, and to assistant from user. One round is
    enough, as going round costs more than staying.
    """
    user = F.least(x["user"], *[_after(x[s], INSERT, "I") for s in ("start", "system", "assistant")])
    return _let(user, lambda u: _state(x["start"], x["system"], u, F.least(x["assistant"], _after(u, INSERT, "I"))))


def _take(x: Column, turn: Column) -> Column:
    """The states after one more turn: kept, given a role, or deleted.

    In start nothing was emitted, in system the system turn only, in user and assistant such a turn
    came last. Blank turns and duplicates can only be deleted.
    """
    fault, initial = turn["fault"], turn["initial"]
    never = F.struct(F.lit(NEVER).cast("long").alias("cost"), F.lit("").alias("audit"))
    stays = F.when(fault == 3, TRUNCATED).otherwise(0)
    may = ~fault.isin(1, 2)
    keep = lambda at, letter: F.when(may & (initial == letter), _after(x[at], stays, "K")).otherwise(never)
    rerole = lambda at: F.when(may, _after(x[at], stays + REROLE, "R")).otherwise(never)
    gone = lambda at: _after(x[at], DELETE, "D")
    before_user = ("start", "system", "assistant")
    user = F.least(gone("user"), *[keep(s, "u") for s in before_user], *[rerole(s) for s in before_user])
    assistant = F.least(gone("assistant"), keep("user", "a"), rerole("user"))
    return _state(gone("start"), F.least(gone("system"), keep("start", "s")), user, assistant)


def cheapest(turns: Column) -> Column:
    """struct(cost, audit) of the cheapest edits of an array of (initial, fault): K, R, D and I in order.

    The fold carries for each of four states the least cost and, of equal costs, the least audit. No audit of
    a state is the beginning of another one of equal cost (it would go on with inserts, which cost), so
    the least beginning also gives the least whole.
    """
    zero = F.struct(F.lit(0).cast("long").alias("cost"), F.lit("").alias("audit"))
    never = F.struct(F.lit(NEVER).cast("long").alias("cost"), F.lit("").alias("audit"))
    return F.aggregate(turns, _state(zero, never, never, never), lambda x, turn: _let(_with_inserts(x), lambda y: _take(y, turn)), lambda x: F.least(x["start"], _with_inserts(x)["assistant"]))


def repaired(turns: Column, audit: Column) -> Column:
    """The array of (role, text) that the edits leave; inserted turns have empty texts.

    Between two letters of turns lie the inserts. A kept turn has its role; the others alternate from user on.
    """
    gaps = F.split(audit, "[KRD]")
    letters = F.regexp_replace(audit, "I", "")
    new = F.struct(F.lit(None).cast("string").alias("role"), F.lit("").alias("text"))
    inserts = lambda k: F.array_repeat(new, F.length(F.get(gaps, k)))

    def emitted(turn: Column, i: Column) -> Column:
        letter = F.substring(letters, i + 1, F.lit(1))
        role = F.when(letter == "K", turn["role"])
        own = F.array_repeat(F.struct(role.alias("role"), turn["text"].alias("text")), F.when(letter == "D", 0).otherwise(1))
        return F.concat(own, inserts(i + 1))

    items = F.concat(inserts(F.lit(0)), F.flatten(F.transform(turns, emitted)))
    leads = F.when(F.startswith(F.get(items, F.lit(0))["role"], F.lit("s")), 1).otherwise(0)
    return F.transform(items, lambda x, i: F.struct(F.coalesce(x["role"], F.when((i - leads) % 2 == 0, "user").otherwise("assistant")).alias("role"), x["text"].alias("text")))


def repair(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired.

    turns has key, turn, role, text; a row with live = false keeps its conversation in the result, but
    is no turn of it (without that column all rows are turns). gaps is the number of turn numbers missing between the
    least and the greatest; null turns come first and don't count there. The counts are of first faults, see
    faults. cost and audit are those of the cheapest edits after which the roles' initials are s?(ua)+
    or nothing: K keeps a turn, R gives it the role user or assistant (2), D deletes it (3, and the
    only edit for blank turns and duplicates), I inserts an empty turn (2); an undeleted truncated turn costs 1 more.
    Of equal costs the least audit in ASCII counts. repaired is the array of (role, text) that remains.

    Null roles and texts count as one space. Repeated rows are turns of their own (the later ones duplicates); rows of
    one turn number go by role and text. A null key is a conversation. Other columns are ignored, whatever
    their names. An empty table gives no rows; a conversation without turns gives zeros, an empty audit and an empty array.

    One shuffle, by conversation; a conversation's turns are one row from there on, which the fold and
    what is made of the repaired turns as a whole need anyway.
    """
    live = F.col("live") if "live" in turns.columns else F.lit(True)
    rows = turns.select(F.col(key).alias("_key"), live.alias("_live"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    marked = faults(rows.repartition("_key"), ["_key", "_live"])
    one = F.struct("position", "turn", "fault", "illegal", F.substring("role", 1, 1).alias("initial"), "role", "text")
    by = marked.groupBy("_key").agg(F.array_sort(F.collect_list(F.when(F.col("_live"), one))).alias("turns"))
    by = by.withColumn("best", cheapest(F.col("turns")))
    numbers = F.array_compact(F.transform("turns", lambda t: t["turn"]))
    n = lambda fault: F.size(F.filter("turns", lambda t: t["fault"] == fault)).cast("long")
    return by.select(
        F.col("_key").alias(key),
        F.coalesce(F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(F.array_distinct(numbers)), F.lit(0)).cast("long").alias("gaps"),
        n(1).alias("blank"), n(2).alias("duplicate"), n(3).alias("truncated"),
        F.size(F.filter("turns", lambda t: t["illegal"])).cast("long").alias("illegal"),
        F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), repaired(F.col("turns"), F.col("best.audit")).alias("repaired"))


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of a conversations table with the faults that op13 plants, by checksum of conv_id:turn.

    Of its remainders by 20: 0 drops a row, 1 empties its text, 2 takes its . ! ? away, 3 repeats it, 4
    makes it the user's. Nulls are one space, in the checksum too. Dropped rows stay with live = false.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    role, text = part("role"), part("text")
    rows = turns.select(
        "conv_id", "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (kind != 0).alias("live"), F.when(kind == 3, 2).otherwise(1).alias("_n"))
    return rows.withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n", "_i")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and a digest of the repaired turns."""
    out = repair(damaged(table(spark, sf_dir, "conversations")))
    whole = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    return out.withColumn("repaired_sha256", F.sha2(whole, 256)).drop("repaired")


def _crc(key: str) -> str:
    """SQL of the CRC-32 of a string of ASCII characters."""
    byte = "list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    return f"xor(list_reduce(list_concat([4294967295], list_transform(string_split({key}, ''), lambda ch: unicode(ch)::BIGINT)), lambda c, b: {byte}), 4294967295)"


def _add(path: str, cost: str | int, letter: str) -> str:
    """SQL of a path with one more edit; paths are strings of nine digits of cost and the audit, so least() orders them."""
    return f"lpad((substr({path}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({path}, 10) || '{letter}'"


SQL = rf"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), kinds AS (SELECT *, {_crc("key")} % 20 AS kind FROM given
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, range(2) c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), ordered AS (
  SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, substr(role, 1, 1) AS initial,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM damaged
), turns AS MATERIALIZED (
  SELECT conv_id, turn, role, text, initial, pos, CASE WHEN body = '' THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal
  FROM ordered
), fold(conv_id, pos, s0, s1, su, sa) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '000000000', NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM conversations
  UNION ALL
  SELECT conv_id, pos, {_add("s0", DELETE, "D")},
         least({_add("s1", DELETE, "D")}, CASE WHEN may AND initial = 's' THEN {_add("s0", "extra", "K")} END),
         least({_add("su", DELETE, "D")}, {", ".join(f"CASE WHEN may AND initial = 'u' THEN {_add(x, 'extra', 'K')} END, CASE WHEN may THEN {_add(x, f'extra + {REROLE}', 'R')} END" for x in ("s0", "s1", "sa"))}),
         least({_add("sa", DELETE, "D")}, CASE WHEN may AND initial = 'a' THEN {_add("su", "extra", "K")} END, CASE WHEN may THEN {_add("su", f"extra + {REROLE}", "R")} END)
  FROM (SELECT t.conv_id, t.pos, t.initial, t.fault NOT IN (1, 2) AS may, CASE WHEN t.fault = 3 THEN {TRUNCATED} ELSE 0 END AS extra, s0, s1, su, least(sa, {_add("su", INSERT, "I")}) AS sa
        FROM (SELECT conv_id, pos, s0, s1, least(su, {", ".join(_add(x, INSERT, "I") for x in ("s0", "s1", "sa"))}) AS su, sa FROM fold) f
        JOIN turns t ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.pos = f.pos + 1)
), best AS (
  SELECT conv_id, substr(path, 1, 9)::BIGINT AS cost, substr(path, 10) AS audit
  FROM (SELECT conv_id, least(s0, sa, {_add(f"least(su, {', '.join(_add(x, INSERT, 'I') for x in ('s0', 's1', 'sa'))})", INSERT, "I")}) AS path
        FROM fold QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1)
), letters AS (
  SELECT conv_id, i, letter, sum((letter <> 'I')::INT) OVER (PARTITION BY conv_id ORDER BY i) AS pos
  FROM (SELECT conv_id, i, substr(audit, i, 1) AS letter FROM best, LATERAL unnest(range(1, length(audit) + 1)) u(i))
), emitted AS (
  SELECT l.conv_id, l.i, CASE WHEN letter = 'K' THEN t.role END AS role, CASE WHEN letter = 'I' THEN '' ELSE t.text END AS text, row_number() OVER (PARTITION BY l.conv_id ORDER BY l.i) - 1 AS n
  FROM letters l LEFT JOIN turns t ON t.conv_id IS NOT DISTINCT FROM l.conv_id AND t.pos = l.pos WHERE letter <> 'D'
), roles AS (
  SELECT *, coalesce(role, CASE WHEN (n - coalesce(max((n = 0 AND role LIKE 's%')::INT) OVER (PARTITION BY conv_id), 0)) % 2 = 0 THEN 'user' ELSE 'assistant' END) AS final FROM emitted
), whole AS (SELECT conv_id, string_agg(final || ':' || text, chr(10) ORDER BY n) AS repaired FROM roles GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
         count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM turns GROUP BY conv_id
)
SELECT b.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       cost, audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM best b LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM b.conv_id
"""
