"""Repair of conversations whose turns are missing, empty, cut off, repeated or under a wrong role.

The roles of a well-formed conversation begin with ``(s?(ua)+)?``. Each row is kept, given the
other role, or deleted, and turns without text are inserted, at the least total cost.

1. Windows over a conversation's rows by turn give each row its place, its first fault and
   whether it follows its predecessor legally.
2. Rows are collected as sorted structs, ``block`` at a time, and a fold by ``aggregate`` carries four
   (cost, audit) structs, one for each state that the roles so far can be in: nothing, after the
   system's turn, after the user's, after the assistant's. ``least`` takes the cheapest way
   into each, of equally cheap ones the smallest audit. No audit of a state is a proper
   prefix of another that costs as much, so the smallest prefix stays smallest to the end.
3. A conversation of several blocks folds their results: each block is worked out for every state it
   may be entered in, so long conversations copy their audits once a block instead of once a row.

Audits carry the new role in the letter (I, J: inserted user, assistant; R, S: given the role
of the user, the assistant), which is determined by the letters before, so that the repaired
text follows from the audit in one pass.

All rows of one conversation come to one task, where windows spill to disk; its repaired text has to be
one value (2 GB), since the result is its hash. A null ``conv_id`` is a conversation of its own.
Rows of the same turn are taken by role and text (nulls are one space, as everywhere).
A conversation without rows left has zeros, no audit and the hash of an empty string. Rows that are
equal in all columns are damaged alike; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

SPACES = " \t\n\x0b\x0c\r"
#: Rows that are folded at once.
BLOCK = 1024
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
#: No way leads there.
NEVER = 1 << 40
STATES = ("none", "system", "user", "assistant")


def or_space(name: str) -> Column:
    """A column as text, null as one space."""
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy and gone of every row after damage; dropped rows stay as ``gone``."""
    kind = F.crc32(F.concat(or_space("conv_id"), F.lit(":"), or_space("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", or_space("role").alias("role"), or_space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (F.col("kind") == 0).alias("gone")
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` (as of :func:`damaged`) with place, blank, duplicate, truncated (the first that holds), illegal, new_turn
    and initial. Place and the rest of a ``gone`` row mean nothing."""
    in_turn = [F.col("turn").asc_nulls_first(), "role", "text", "copy"]
    own = Window.partitionBy("conv_id", "gone").orderBy(*in_turn)
    alike = Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first(), "copy")
    bare = F.rtrim(F.col("text"), F.lit(SPACES))
    marked = rows.select(
        "*", (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"), F.left("role", F.lit(1)).alias("initial"), F.row_number().over(alike).alias("nth")
    )
    before = F.lag("initial").over(own)
    turn_before = F.lag("turn").over(own)
    return marked.select(
        "conv_id", "gone", "turn", "role", "text", "initial", "blank",
        (F.row_number().over(own) - 1).alias("place"),
        (~F.col("blank") & (F.col("nth") > 1)).alias("duplicate"),
        (~F.col("blank") & (F.col("nth") == 1) & F.col("cut")).alias("truncated"),
        (before.isNotNull() & ~F.concat(before, "initial").isin("su", "ua", "au")).alias("illegal"),
        (F.col("turn").isNotNull() & (turn_before.isNull() | (turn_before != F.col("turn")))).alias("new_turn"),
    )


def turn_struct() -> Column:
    """What the fold needs of a row: its place, role, text, and the cost and letter of each role it can stay in."""
    dead = F.col("blank") | F.col("duplicate")
    extra = F.when(F.col("truncated"), CUT).otherwise(0)

    def cost(initial: str, otherwise: int) -> Column:
        return F.when(dead, NEVER).otherwise(F.when(F.col("initial") == initial, KEEP).otherwise(otherwise) + extra).cast("long")

    def letter(initial: str, otherwise: str) -> Column:
        return F.when(F.col("initial") == initial, "K").otherwise(otherwise)

    return F.struct(
        "place", "role", "text",
        cost("s", NEVER).alias("system_cost"),
        cost("u", REROLE).alias("user_cost"), letter("u", "R").alias("user_letter"),
        cost("a", REROLE).alias("assistant_cost"), letter("a", "S").alias("assistant_letter"),
    )


def _way(cost: Column | int, audit: Column | str = "") -> Column:
    return F.struct((F.lit(cost) if isinstance(cost, int) else cost).cast("long").alias("cost"), (F.lit(audit) if isinstance(audit, str) else audit).alias("audit"))


def _on(way: Column, cost: Column | int, letters: Column | str) -> Column:
    """A way with one more edit."""
    return _way(way["cost"] + cost, F.concat(way["audit"], F.lit(letters) if isinstance(letters, str) else letters))


def _ways(*ways: Column) -> Column:
    return F.struct(*(w.alias(s) for s, w in zip(STATES, ways, strict=True)))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def _with_inserts(w: Column) -> Column:
    """The ways into each state, when turns may be inserted as well."""
    none, system, user, assistant = (w[s] for s in STATES)
    return _ways(
        none, system,
        F.least(user, _on(none, INSERT, "I"), _on(system, INSERT, "I"), _on(assistant, INSERT, "I")),
        F.least(assistant, _on(user, INSERT, "J"), _on(none, 2 * INSERT, "IJ"), _on(system, 2 * INSERT, "IJ")),
    )


def _after(w: Column, t: Column) -> Column:
    """The ways into each state after one more row."""
    none, system, user, assistant = (w[s] for s in STATES)
    to_user = [_on(x, t["user_cost"], t["user_letter"]) for x in (none, system, assistant)]
    moved = _ways(
        _on(none, DELETE, "D"),
        F.least(_on(system, DELETE, "D"), _on(none, t["system_cost"], "K")),
        F.least(_on(user, DELETE, "D"), *to_user),
        F.least(_on(assistant, DELETE, "D"), _on(user, t["assistant_cost"], t["assistant_letter"])),
    )
    return _bound(moved, _with_inserts)


def _entered(state: str) -> Column:
    return _with_inserts(_ways(*(_way(0 if s == state else NEVER) for s in STATES)))


def _joined(w: Column, block: Column) -> Column:
    """The ways into each state after a block, given by its ways from each state."""
    return _ways(*(F.least(*(_way(w[a]["cost"] + block[i][b]["cost"], F.concat(w[a]["audit"], block[i][b]["audit"])) for i, a in enumerate(STATES))) for b in STATES))


def repaired_text(turns: Column, audit: Column) -> Column:
    """``role:text`` of the repaired conversation's turns, joined by newlines."""

    def inserted(letters: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(letters, "I", "\nuser:"), "J", "\nassistant:")

    def row(t: Column, edit: Column) -> Column:
        kept = F.right(edit, F.lit(1))
        role = F.when(kept == "K", t["role"]).when(kept == "R", "user").when(kept == "S", "assistant")
        return F.concat(inserted(F.regexp_replace(edit, "[DKRS]", "")), F.coalesce(F.concat(F.lit("\n"), role, F.lit(":"), t["text"]), F.lit("")))

    rows = F.zip_with(turns, F.regexp_extract_all(audit, F.lit("[IJ]*[DKRS]"), F.lit(0)), row)
    # every turn begins with a newline here; the first one's goes
    return F.substr(F.concat(F.array_join(rows, ""), inserted(F.regexp_extract(audit, "[IJ]*$", 0))), F.lit(2))


def repair(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired (the text) of every
    conversation of ``conversations`` (conv_id, turn, role, text) after damage."""
    # one shuffle for both windows and both groupings
    rows = with_faults(damaged(conversations).repartition("conv_id"))
    here = ~F.col("gone")

    def number(condition: Column) -> Column:
        return F.count(F.when(here & condition, 1))

    counts = [number(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "new_turn")]
    in_blocks = rows.groupBy("conv_id", F.when(here, F.floor(F.col("place") / block)).alias("block")).agg(
        F.array_sort(F.collect_list(F.when(here, turn_struct()))).alias("turns"), *counts, F.min(F.when(here, F.col("turn"))).alias("low"), F.max(F.when(here, F.col("turn"))).alias("high")
    )
    # only a conversation's first block is entered in one state alone
    states = F.when(F.col("block") == 0, F.array(_entered("none"))).otherwise(F.array(*(_entered(s) for s in STATES)))
    folded = in_blocks.withColumn("ways", F.transform(states, lambda start: F.aggregate("turns", start, _after)))
    parts = F.array_sort(F.collect_list(F.when(F.col("block").isNotNull(), F.struct("block", "ways", "turns"))))
    whole = folded.groupBy("conv_id").agg(
        parts.alias("parts"), *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "new_turn")), F.min("low").alias("low"), F.max("high").alias("high")
    )
    ends = F.when(F.size("parts") == 0, _entered("none")).otherwise(
        F.aggregate(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))), F.get("parts", F.lit(0))["ways"][0], lambda w, p: _joined(w, p["ways"]))
    )
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("new_turn"), F.lit(0)).cast("long")
    done = whole.withColumn("ends", ends).withColumn("best", F.least("ends.none", "ends.assistant"))
    turns = F.flatten(F.transform("parts", lambda p: p["turns"]))
    return done.select(
        "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"),
        F.translate("best.audit", "JS", "IR").alias("audit"), repaired_text(turns, F.col("best.audit")).alias("repaired"),
    )


def repair_report(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The result of :func:`repair` with repaired_sha256 in place of the text."""
    found = repair(conversations, block)
    return found.select(*(c for c in found.columns if c != "repaired"), F.sha2(F.col("repaired").cast("binary"), 256).alias("repaired_sha256"))


#: The letters' ways as in :func:`_after`, row by row in a recursive query.
ORACLE_SQL = r"""
WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(k) + 1), lambda i: ascii(k[i])::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS kind FROM t),
m AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE kind <> 0),
f AS (SELECT *, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, role[1:1] AS ini,
    row_number() OVER o AS place, lag(role[1:1]) OVER o || role[1:1] AS two,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
  FROM m WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
r AS (SELECT *, bare = '' AS blank, bare <> '' AND nth > 1 AS duplicate,
    bare <> '' AND nth = 1 AND bare[-1:] NOT IN ('.', '!', '?') AS truncated FROM f),
e AS (SELECT *, CASE WHEN blank OR duplicate THEN 1000000000 WHEN truncated THEN 5 ELSE 0 END AS extra FROM r),
p AS (SELECT DISTINCT conv_id, 0::BIGINT AS pos, {'c': 0::BIGINT, 'p': ''} AS n, {'c': 1000000000::BIGINT, 'p': ''} AS s,
    {'c': 5::BIGINT, 'p': 'I'} AS u, {'c': 10::BIGINT, 'p': 'IJ'} AS a FROM t
  UNION ALL
  SELECT conv_id, pos, n, s,
    list_min([u, {'c': n.c + 5, 'p': n.p || 'I'}, {'c': s.c + 5, 'p': s.p || 'I'}, {'c': a.c + 5, 'p': a.p || 'I'}]),
    list_min([a, {'c': u.c + 5, 'p': u.p || 'J'}, {'c': n.c + 10, 'p': n.p || 'IJ'}, {'c': s.c + 10, 'p': s.p || 'IJ'}])
  FROM (SELECT p.conv_id, p.pos + 1 AS pos, {'c': n.c + 2, 'p': n.p || 'D'} AS n,
      list_min([{'c': s.c + 2, 'p': s.p || 'D'}, {'c': n.c + extra + CASE WHEN ini = 's' THEN 0 ELSE 1000000000 END, 'p': n.p || 'K'}]) AS s,
      list_min([{'c': u.c + 2, 'p': u.p || 'D'}, {'c': n.c + extra + uc, 'p': n.p || ul}, {'c': s.c + extra + uc, 'p': s.p || ul}, {'c': a.c + extra + uc, 'p': a.p || ul}]) AS u,
      list_min([{'c': a.c + 2, 'p': a.p || 'D'}, {'c': u.c + extra + CASE WHEN ini = 'a' THEN 0 ELSE 1 END, 'p': u.p || CASE WHEN ini = 'a' THEN 'K' ELSE 'S' END}]) AS a
    FROM p JOIN (SELECT *, CASE WHEN ini = 'u' THEN 0 ELSE 1 END AS uc, CASE WHEN ini = 'u' THEN 'K' ELSE 'R' END AS ul FROM e) e
      ON e.conv_id IS NOT DISTINCT FROM p.conv_id AND e.place = p.pos + 1)),
b AS (SELECT conv_id, pos, list_min([n, a]) AS best FROM p QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1),
l AS (SELECT conv_id, unnest(regexp_extract_all(best.p, '[IJ]*[DKRS]|[IJ]+$')) AS edit, unnest(range(1, 1 + len(regexp_extract_all(best.p, '[IJ]*[DKRS]|[IJ]+$')))) AS place FROM b),
x AS (SELECT l.conv_id, string_agg(replace(replace(regexp_replace(edit, '[DKRS]', ''), 'I', chr(10) || 'user:'), 'J', chr(10) || 'assistant:')
    || CASE edit[-1:] WHEN 'K' THEN chr(10) || role || ':' || text WHEN 'R' THEN chr(10) || 'user:' || text WHEN 'S' THEN chr(10) || 'assistant:' || text ELSE '' END, '' ORDER BY l.place) AS repaired
  FROM l LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM l.conv_id AND e.place = l.place GROUP BY l.conv_id),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count_if(blank)::BIGINT AS blank, count_if(duplicate)::BIGINT AS duplicate,
    count_if(truncated)::BIGINT AS truncated, count_if(two NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal FROM e GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.c AS cost, translate(best.p, 'JS', 'IR') AS audit, sha256(coalesce(repaired[2:], '')) AS repaired_sha256
FROM b LEFT JOIN x ON x.conv_id IS NOT DISTINCT FROM b.conv_id LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM b.conv_id
"""


def oracle() -> str:
    """DuckDB SQL for the same rows."""
    return ORACLE_SQL
