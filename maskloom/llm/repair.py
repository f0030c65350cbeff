"""Operator 11: repair of the turn structure of conversations by a fold of Spark SQL.

A repaired conversation is empty, or a system turn, if any, and then pairs of a user and an assistant turn.
Windows flag the faults of each row, the rows of a conversation become one sorted array of structs, and
aggregate() folds it. The fold carries four structs (cost, audit), one for each place in the pattern that an
output can have reached (START, SYSTEM, USER, ASSISTANT); native least() picks the cheapest, and of equal
cost the audit that comes first. Edits and their costs: Keep 0, Rerole to user or assistant 2, Delete 3,
Insert a turn of empty text 2, one more for each truncated row that stays. Blank and repeated rows are deleted.

Inside of the fold an audit tells apart what a row becomes: R and I are user turns, S and J assistant ones. That
changes no order, since two audits of one cost differ first where both are at the same place, which leaves one
role only. At equal cost no audit begins with another one, so the best beginning stays best.

An array is folded in blocks, each from every place that is reached, and the blocks' results are then joined:
audits of a block are short, so the time is near linear in a conversation's turns. The texts are no part of
what is folded. A repaired conversation is one string, so all its turns meet in one row, of 2 GB at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Rows that are folded at a time.
BLOCK = 512
BLANKS = " \t\n\x0b\f\r"
#: Places in the pattern, and those where a conversation may end.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
_FAR = 1 << 60  # the cost of a place that no edits reach


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy of conversations after the damage that tests repair: by
    crc32("conv_id:turn") % 20 a row is dropped (0: it stays with copy null), loses its text (1) or its sentence
    ends (2), is there twice (3) or becomes a user's (4). Null ids and turns count as one space there; null roles and
    texts are one space."""
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn"))) % 20
    copies = F.when(kind == 0, F.array(F.lit(None).cast("int"))).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(or_space("text"), ".!?", "")).otherwise(or_space("text"))
    role = F.when(kind == 4, "user").otherwise(or_space("role"))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def flagged(rows: DataFrame) -> DataFrame:
    """rows with blank, duplicate and truncated, at most one of them true: nothing but white space; role and text of an
    earlier row of the conversation; a last character that ends no sentence. Rows are in the order of turn, nulls first,
    then role and text. Rows whose copy is null are not there."""
    rest = F.rtrim(F.col("text"), F.lit(BLANKS))
    same = W.partitionBy("conv_id", "role", "text", F.col("copy").isNull()).orderBy(F.col("turn").asc_nulls_first(), "copy")
    rows = rows.withColumn("blank", rest == "").withColumn("duplicate", ~F.col("blank") & (F.row_number().over(same) > 1))
    return rows.withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & ~F.substring(rest, -1, 1).isin(".", "!", "?"))


def _let(value: Column, use) -> Column:
    """use(value), where value is a name: else it would be written out, and computed, wherever it occurs."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _step(way: Column, cost: Column | int, letter: str) -> Column:
    return F.struct((way["cost"] + cost).cast("long").alias("cost"), F.concat(way["audit"], F.lit(letter)).alias("audit"))


def _four(ways: list[Column]) -> Column:
    return F.struct(*(w.alias(f"p{k}") for k, w in enumerate(ways)))


def _from(place: int) -> Column:
    """The four structs before the first row, where the output has reached a place."""
    return _four([F.struct(F.lit(0 if k == place else _FAR).cast("long").alias("cost"), F.lit("").alias("audit")) for k in range(4)])


def _ways(four: Column) -> list[Column]:
    return [four[f"p{k}"] for k in range(4)]


def _inserted(four: Column) -> Column:
    """The four structs after turns that are put in: a longer run than two comes back to where it began."""
    start, system, user, assistant = _ways(four)
    before = F.least(user, *(_step(w, INSERT, "I") for w in (start, system, assistant)))
    return _let(before, lambda user: _four([start, system, user, F.least(assistant, _step(user, INSERT, "J"))]))


def _edited(four: Column, row: Column) -> Column:
    """The four structs after a row is kept, given another role or deleted."""
    start, system, user, assistant = _ways(four)
    gone = row["blank"] | row["duplicate"]
    late = F.when(row["truncated"], F.lit(TRUNCATED)).otherwise(F.lit(0))
    initial = F.substring(row["role"], 1, 1)
    allowed = lambda test, cost: F.when(test & ~gone, late + cost).otherwise(F.lit(_FAR))
    keep = {c: allowed(initial == c, KEEP) for c in "sua"}
    rerole = allowed(F.lit(True), REROLE)
    before_user = (start, system, assistant)
    return _four(
        [
            _step(start, DELETE, "D"),
            F.least(_step(system, DELETE, "D"), _step(start, keep["s"], "K")),
            F.least(_step(user, DELETE, "D"), *(_step(w, keep["u"], "K") for w in before_user), *(_step(w, rerole, "R") for w in before_user)),
            F.least(_step(assistant, DELETE, "D"), _step(user, keep["a"], "K"), _step(user, rerole, "S")),
        ]
    )


def _capped(four: Column) -> Column:
    """Costs of places that are not reached stay what they are, so that they don't add up."""
    return _four([F.when(w["cost"] < _FAR, w).otherwise(F.struct(F.lit(_FAR).alias("cost"), F.lit("").alias("audit"))) for w in _ways(four)])


def _after(first: Column, four: Column) -> Column:
    """What a way to a place becomes by the block that begins there."""
    return _four([F.struct((first["cost"] + w["cost"]).alias("cost"), F.concat(first["audit"], w["audit"]).alias("audit")) for w in _ways(four)])


def folded(turns: Column) -> Column:
    """struct<cost, audit> of the cheapest repair of a sorted array of turns, with S and J for assistant turns."""
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(turns), F.lit(1)), F.lit(BLOCK)), lambda k: F.slice(turns, k, BLOCK))

    def through(place: int, way: Column, rows: Column) -> Column:
        four = F.aggregate(rows, _from(place), lambda acc, row: _let(_let(_inserted(acc), lambda x: _edited(x, row)), _capped))
        return F.when(way["cost"] < _FAR, _let(four, lambda x: _after(way, x)))

    def block(done: Column, rows: Column) -> Column:
        ends = [through(place, way, rows) for place, way in enumerate(_ways(done))]
        # least() passes over the null of a place that is not reached
        return _let(F.array(*ends), lambda e: _let(_four([F.least(*(F.get(e, F.lit(n))[f"p{k}"] for n in range(4))) for k in range(4)]), _capped))

    done = F.aggregate(blocks, _from(START), block, _inserted)
    return _let(done, lambda x: F.least(*(x[f"p{k}"] for k in ENDS)))


def _line(role: Column | str, text: Column | str) -> Column:
    return F.concat(role if isinstance(role, Column) else F.lit(role), F.lit(":"), text if isinstance(text, Column) else F.lit(text))


def _lines_put_in(letters: Column) -> Column:
    return F.transform(F.split(letters, ""), lambda c: F.when(c == "I", "user:").when(c == "J", "assistant:"))


def rendered(turns: Column, audit: Column) -> Column:
    """array<string>: a line role:text for each turn of the repaired conversation."""
    letters = F.regexp_extract_all(F.translate(audit, "IJ", ""), F.lit("."), F.lit(0))
    stay = F.filter(F.zip_with(turns, letters, lambda t, c: F.struct(t["role"].alias("role"), t["text"].alias("text"), c.alias("edit"))), lambda t: t["edit"] != "D")
    kept_letters = F.regexp_extract_all(F.translate(audit, "D", ""), F.lit("[IJ]*[KRS]"), F.lit(0))

    def told(turn: Column, letters: Column) -> Column:
        role = F.when(turn["edit"] == "R", "user").when(turn["edit"] == "S", "assistant").otherwise(turn["role"])
        return F.concat(_lines_put_in(F.rtrim(letters, F.lit("KRS"))), F.array(_line(role, turn["text"])))

    last = _lines_put_in(F.regexp_extract(audit, "[IJ]*$", 0))
    return F.array_compact(F.concat(F.flatten(F.zip_with(stay, kept_letters, told)), last))


def repaired(rows: DataFrame, conv: str = "conv_id") -> DataFrame:
    """conv, turns, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired for each conversation of
    rows(conv, turn, role, text, copy): turns are its sorted rows with their flags, repaired its lines.

    Rows whose copy is null count as gone; a conversation without any other has zeros, an empty audit and no line.
    A null conv is a conversation of its own; roles and texts are not null. Rows that are equal are repeats; a turn that
    occurs twice counts once for gaps. A role of no letter of s, u and a can't be kept. An empty table gives an empty one.
    """
    rows = flagged(rows.select(F.col(conv).alias("conv_id"), "turn", "role", "text", "copy"))
    turn = F.struct("turn", "role", "text", "copy", "blank", "duplicate", "truncated")
    out = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("copy").isNotNull(), turn))).alias("turns"))
    numbers = F.filter(F.transform("turns", lambda t: t["turn"]), lambda n: n.isNotNull())
    gaps = F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(F.array_distinct(numbers))
    initial = F.transform("turns", lambda t: F.when(t["role"].rlike("^[sua]"), F.substring(t["role"], 1, 1)).otherwise(F.lit("x")))
    # of n rows n - 1 pairs, less those that are in order
    illegal = F.greatest(F.size("turns") - 1, F.lit(0)) - F.regexp_count(F.array_join(initial, ""), F.lit("(?=su|ua|au)"))
    count = lambda c: F.size(F.filter("turns", lambda t: t[c]))
    out = out.withColumn("best", folded(F.col("turns")))
    numbers = {"gaps": F.coalesce(gaps, F.lit(0)), **{c: count(c) for c in ("blank", "duplicate", "truncated")}, "illegal": illegal, "cost": F.col("best.cost")}
    return out.select(
        F.col("conv_id").alias(conv),
        "turns",
        *(c.cast("long").alias(name) for name, c in numbers.items()),
        F.translate("best.audit", "JS", "IR").alias("audit"),
        rendered(F.col("turns"), F.col("best.audit")).alias("repaired"),
    )


def digest(turns: DataFrame) -> DataFrame:
    """The conversations of turns(conv_id, turn, role, text) after damaged(): counts, cost, audit, repaired_sha256."""
    out = repaired(damaged(turns))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.array_join("repaired", "\n"), 256).alias("repaired_sha256"))


def _oracle_sql() -> str:
    """The rows of digest() over the table conversations by a recursive query, which carries the lines too."""
    after = lambda s, cost, letter, line: f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{letter}', 'o': {s}.o || {line}}}"
    put = lambda s, role: after(s, INSERT, "I", f"chr(10) || '{role}:'")
    drop = lambda s: after(s, DELETE, "D", "''")
    keep = lambda s, initial: after(s, f"CASE WHEN initial = '{initial}' AND NOT gone THEN late ELSE {_FAR} END", "K", "chr(10) || role || ':' || text")
    turned = lambda s, role: after(s, f"CASE WHEN gone THEN {_FAR} ELSE late + {REROLE} END", "R", f"chr(10) || '{role}:' || text")
    far = f"{{'c': {_FAR}, 'a': '', 'o': ''}}"
    capped = lambda s: f"CASE WHEN ({s}).c < {_FAR} THEN {s} ELSE {far} END"
    user = f"least(s2, {put('s0', 'user')}, {put('s1', 'user')}, {put('s3', 'user')})"
    following = (
        drop("s0"),
        f"least({drop('s1')}, {keep('s0', 's')})",
        f"least({drop('s2')}, {', '.join(keep(s, 'u') for s in ('s0', 's1', 's3'))}, {', '.join(turned(s, 'user') for s in ('s0', 's1', 's3'))})",
        f"least({drop('s3')}, {keep('s2', 'a')}, {turned('s2', 'assistant')})",
    )
    return rf"""WITH RECURSIVE rounds AS (SELECT list(list_reduce(list_prepend(k, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS t FROM range(256) r(k)),
  named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
  kinds AS (SELECT n.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(name, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind FROM named n, rounds),
  hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM kinds WHERE kind <> 0),
  placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last_one FROM hurt),
  faults AS (SELECT *, last_one = '' AS blank, last_one <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate,
    CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS initial FROM placed),
  flags AS (SELECT *, blank OR duplicate AS gone, NOT blank AND NOT duplicate AND last_one NOT IN ('.', '!', '?') AS truncated,
    coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal FROM faults),
  steps AS (SELECT *, CASE WHEN truncated THEN {TRUNCATED} ELSE 0 END AS late FROM flags),
  convs AS (SELECT DISTINCT conv_id FROM conversations),
  fold AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 'o': ''}} AS s0, {{'c': CAST({_FAR} AS BIGINT), 'a': '', 'o': ''}} AS s1, {{'c': CAST({_FAR} AS BIGINT), 'a': '', 'o': ''}} AS s2, {{'c': CAST({_FAR} AS BIGINT), 'a': '', 'o': ''}} AS s3 FROM convs
    UNION ALL SELECT conv_id, i, {", ".join(capped(f"n{k}") for k in range(4))} FROM (
      SELECT conv_id, i, {", ".join(f"{w} AS n{k}" for k, w in enumerate(following))} FROM (
        SELECT conv_id, s.i, role, text, initial, gone, late, s0, s1, s2, least(s3, {put("s2", "assistant")}) AS s3 FROM (
          SELECT f.conv_id, r.i, role, text, initial, gone, late, s0, s1, {user} AS s2, s3 FROM fold f JOIN steps r ON r.conv_id IS NOT DISTINCT FROM f.conv_id AND r.i = f.i + 1) s))),
  ends AS (SELECT conv_id, least(s0, s3, {put("s2", "assistant")}) AS best FROM (SELECT conv_id, s0, s3, {user} AS s2, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS k FROM fold) WHERE k = 1),
  totals AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(duplicate) AS duplicate, count_if(truncated) AS truncated, count_if(illegal) AS illegal FROM flags GROUP BY conv_id)
  SELECT e.conv_id, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("gaps", "blank", "duplicate", "truncated", "illegal"))}, CAST(best.c AS BIGINT) AS cost, best.a AS audit, sha256(substr(best.o, 2)) AS repaired_sha256
  FROM ends e LEFT JOIN totals t ON t.conv_id IS NOT DISTINCT FROM e.conv_id"""


ORACLE_SQL = _oracle_sql()
