"""Quotation linking of messages, with DataFrame functions only.

Lines that begin with ``>`` are quotes, one level a mark. Passages (neighbouring lines of one level) and their lines are
normalised and hashed; within a conversation a quoted passage is linked with the latest earlier message that says it
itself. A message answers the message its outermost quotes are linked with. Conversations come out in reply order, without
quotes, as chat text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelwright.llm.common import cut

_MARKS = r"^(?:[ \t]*>)+"
#: A line that announces a quote; it goes with the quote below it.
_ANNOUNCED = r"(?i)(?:wrote|writes|said|schrieb|écrit|escribió) ?:[ \t]*$"


def normalised(text: Column) -> Column:
    """Lower case, each run of white space one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\s\x{A0}]+", " "))


def _parsed(text: Column) -> Column:
    """array<struct<level, body>>: each line's quote level and what stands behind its marks."""

    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, _MARKS, 0)
        return F.struct((F.length(marks) - F.length(F.translate(marks, ">", ""))).alias("level"), F.regexp_replace(x, _MARKS + " ?", "").alias("body"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n", -1), line)


def _grouped(parsed: Column) -> Column:
    """array<struct<level, lines>>: neighbouring lines of one quote level as one passage, in order. Linear in the text."""
    places = F.sequence(F.lit(0), F.size(parsed) - 1)
    starts = F.filter(places, lambda i: (i == 0) | (parsed[i]["level"] != parsed[F.greatest(i - 1, F.lit(0))]["level"]))
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(parsed)))
    return F.zip_with(starts, ends, lambda s, e: F.struct(parsed[s]["level"].alias("level"), F.transform(F.slice(parsed, s + 1, e - s), lambda x: x["body"]).alias("lines")))


def parse(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (without quotes), quotes: array<struct<level, lines>>."""
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), _parsed(F.col("text").cast("string")).alias("parsed"))
    rows = rows.withColumn("grouped", _grouped(F.col("parsed")))
    g = F.col("grouped")

    def own(x: Column, i: Column) -> Column:
        quoted_next = F.coalesce(F.get(g, i + 1)["level"] > 0, F.lit(False))
        return F.when(quoted_next & F.element_at(x["lines"], -1).rlike(_ANNOUNCED), F.slice(x["lines"], 1, F.size(x["lines"]) - 1)).otherwise(x["lines"])

    said = F.flatten(F.filter(F.transform(g, lambda x, i: F.when(x["level"] == 0, own(x, i))), lambda x: x.isNotNull()))
    return rows.select("conv_id", "turn", "role", F.regexp_replace(F.regexp_replace(F.array_join(said, "\n"), r"\n(?:[ \t]*\n)+", "\n"), r"\A\s+|\s+\z", "").alias("text"), F.filter(g, lambda x: x["level"] > 0).alias("quotes"))


def _units(lines: Column) -> Column:
    """The passage and each of its lines, normalised, without empty ones."""
    return F.filter(F.array_distinct(F.concat(F.array(normalised(F.array_join(lines, "\n"))), F.transform(lines, normalised))), lambda x: x != "")


def links(parsed: DataFrame) -> DataFrame:
    """conv_id, turn, passage, level, linked_turn, matched: each quoted passage's original, null if none.

    The original is the earlier message with most of the passage's units, the later one on ties. For each unit only its latest
    earlier speaker counts, found by a running maximum over (conversation, unit): no pairs are made, and a line that a conversation repeats
    without end is many tasks'. Only quoted units travel.
    """
    quoted = parsed.select("conv_id", "turn", F.posexplode("quotes").alias("passage", "q")).select("conv_id", "turn", "passage", F.col("q.level").alias("level"), F.explode(_units(F.col("q.lines"))).alias("unit"))
    quoted = quoted.withColumn("hash", F.xxhash64("unit"))
    said = parsed.filter("text <> ''").select("conv_id", "turn", F.explode(_units(F.split("text", "\n"))).alias("unit")).withColumn("hash", F.xxhash64("unit"))
    wanted = quoted.select("conv_id", "hash").distinct()
    said = said.join(wanted, ["conv_id", "hash"], "left_semi").distinct()
    key = ["conv_id", "hash", "unit", "turn"]
    both = quoted.select(*key, F.lit(None).cast("long").alias("spoken")).unionByName(said.select(*key, F.col("turn").alias("spoken"))).groupBy(*key).agg(F.max("spoken").alias("spoken"))
    latest = running(both, key[:3], key[3:], "spoken", highest=True).select(*key, F.col("before").alias("original"))
    found = quoted.join(latest, key, "left")
    votes = found.groupBy("conv_id", "turn", "passage", "level", "original").agg(F.count("*").alias("n"))
    best = F.max_by(F.struct("original", "n"), F.struct(F.col("original").isNotNull(), "n", "original"))
    return votes.groupBy("conv_id", "turn", "passage", "level").agg(best.alias("best")).select("conv_id", "turn", "passage", "level", F.col("best.original").alias("linked_turn"), F.when(F.col("best.original").isNotNull(), F.col("best.n")).otherwise(0).alias("matched"))


def running(rows: DataFrame, keys: list[str], order: list[str], value: str, highest: bool = False) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over the earlier rows of equal keys, in ``order``, or its maximum, null without any (``highest``).

    Rows are dealt by ranges of keys and order, so equal keys may lie in many parts: a sum inside the part and one over the
    parts before. Only keys that go on from one part to the next have the latter, at most one a part.
    """
    dealt = cut(rows.repartitionByRange(*keys, *order).withColumn("part", F.spark_partition_id()), "dealt")
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    fold = F.max if highest else F.sum
    offsets = dealt.groupBy(*keys, "part").agg(fold(value).alias("whole")).withColumn("offset", fold("whole").over(earlier)).filter("offset IS NOT NULL")
    offsets = offsets.select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("part").alias("of_part"), "offset")
    own = Window.partitionBy(*keys, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("inside", fold(value).over(own))
    same = F.col("part") == F.col("of_part")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"of_{k}"))
    before = F.greatest("inside", "offset") if highest else F.coalesce("inside", F.lit(0)) + F.coalesce("offset", F.lit(0))
    return inside.join(F.broadcast(offsets), same, "left").select(*rows.columns, before.cast("long").alias("before"))


def _sizes(inside: DataFrame) -> DataFrame:
    """conv_id, turn, size: the rows of a message and of all that answer it, directly or not.

    By doubling: ``size`` covers answers nearer than the ancestor ``head``, and each round adds those of the messages below.
    """
    state = inside.select("conv_id", "turn", F.col("reply_to").alias("head"), F.col("weight").alias("size"))
    while True:
        state = cut(state, "sizes")
        below = state.filter("head IS NOT NULL")
        if below.isEmpty():
            return state.select("conv_id", "turn", "size")
        gains = below.groupBy("conv_id", F.col("head").alias("turn")).agg(F.sum("size").alias("gain"))
        up = below.select("conv_id", F.col("turn").alias("head"), F.col("head").alias("up"))
        state = state.join(gains, ["conv_id", "turn"], "left").join(up, ["conv_id", "head"], "left").select("conv_id", "turn", F.col("up").alias("head"), (F.col("size") + F.coalesce("gain", F.lit(0))).alias("size"))


def _firsts(steps: DataFrame) -> DataFrame:
    """conv_id, turn, first: the sum of ``step`` over a message and all above it, by doubling."""
    state = steps.select("conv_id", "turn", F.col("reply_to").alias("head"), F.col("step").alias("first"))
    while True:
        state = cut(state, "firsts")
        if state.filter("head IS NOT NULL").isEmpty():
            return state.select("conv_id", "turn", "first")
        up = state.select("conv_id", F.col("turn").alias("head"), F.col("head").alias("up"), F.col("first").alias("further"))
        state = state.join(up, ["conv_id", "head"], "left").select("conv_id", "turn", F.col("up").alias("head"), (F.col("first") + F.coalesce("further", F.lit(0))).alias("first"))


def _placed(parsed: DataFrame, outer: DataFrame) -> DataFrame:
    """conv_id, turn, reply_to, weight (rows of the turn), first: the place of its first row. State a message is a few numbers.

    A message stands behind the one it answers and the whole threads of that one's earlier answers.
    """
    nodes = cut(parsed.filter("conv_id IS NOT NULL").groupBy("conv_id", "turn").agg(F.count("*").alias("weight")).join(outer, ["conv_id", "turn"], "left"), "nodes")
    ends = outer.select("conv_id", "turn").union(outer.select("conv_id", F.col("reply_to").alias("turn"))).distinct()
    inside = cut(nodes.join(ends, ["conv_id", "turn"], "left_semi"), "inside")
    sized = nodes.join(_sizes(inside), ["conv_id", "turn"], "left").withColumn("size", F.coalesce("size", "weight"))
    beside = cut(running(sized, ["conv_id", "reply_to"], ["turn"], "size"), "beside")
    above = inside.select("conv_id", F.col("turn").alias("reply_to"), F.col("weight").alias("above"))
    steps = beside.join(ends, ["conv_id", "turn"], "left_semi").join(above, ["conv_id", "reply_to"], "left").withColumn("step", F.col("before") + F.coalesce("above", F.lit(0)))
    return beside.join(_firsts(steps), ["conv_id", "turn"], "left").select("conv_id", "turn", "reply_to", "weight", F.coalesce("first", "before").alias("first"))


def thread(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, n_quotes, n_linked, reply_to, position: every message, quotes taken out, placed in reply order.

    ``position`` counts from 0 in a conversation: a message comes after the one it answers and that one's earlier answers.
    Null texts are empty; rows that repeat a turn stay, next to each other; messages without conversation or turn link with none,
    and each message without conversation is one of its own.
    """
    parsed = cut(parse(messages).withColumn("row", F.monotonically_increasing_id()), "messages")
    found = cut(links(parsed), "quote-links")
    outer = cut(found.filter("linked_turn IS NOT NULL").groupBy("conv_id", "turn").agg(F.max_by("linked_turn", F.struct(-F.col("level"), "linked_turn")).alias("reply_to")), "replies")
    counts = found.groupBy("conv_id", "turn").agg(F.count("linked_turn").alias("n_linked"))
    placed = cut(_placed(parsed, outer).join(counts, ["conv_id", "turn"], "left").withColumn("n_linked", F.coalesce("n_linked", F.lit(0))), "placed")
    said = parsed.select("conv_id", "turn", "role", "text", F.size("quotes").alias("n_quotes"), "row")

    def of(some: str) -> DataFrame:
        p = placed.filter(some).withColumnsRenamed({"conv_id": "of_conv", "turn": "of_turn"})
        return said.join(p, (said.conv_id == p.of_conv) & said.turn.eqNullSafe(p.of_turn)).select(*said.columns, "n_linked", "reply_to", "first", F.lit(1).alias("one"))

    columns = ["conv_id", "turn", "role", "text", "n_quotes", "n_linked", "reply_to"]
    single = of("weight = 1").select(*columns, F.col("first").alias("position"))
    repeated = running(of("weight > 1"), ["conv_id", "turn"], ["role", "text", "row"], "one").select(*columns, (F.col("first") + F.col("before")).alias("position"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    alone = said.filter("conv_id IS NULL").select("conv_id", "turn", "role", "text", "n_quotes", zero.alias("n_linked"), none.alias("reply_to"), zero.alias("position"))
    return single.unionByName(repeated).unionByName(alone)


def chat_line(role: Column, text: Column) -> Column:
    """One message as chat text; null for a message without text of its own."""
    return F.when(text != "", F.concat(F.lit("<|"), F.coalesce(role, F.lit("")), F.lit("|>\n"), text, F.lit("\n<|end|>")))


def chats(threaded: DataFrame, segment: int | None = None) -> DataFrame:
    """conv_id, segment, turns, n_linked, chat: messages with text or quotes in reply order, one row a conversation.

    A message that only quotes has its turn and links here and no line in the chat. Messages without conversation are a row each.
    A row holds its whole conversation; where some are too long for that, ask for pieces of ``segment`` messages, or keep to the
    rows of ``thread`` with ``chat_line``, which have no such bound.
    """
    threaded = threaded.withColumn("alone", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()))
    part = (F.floor(F.col("position") / segment) if segment else F.lit(0).cast("long")).alias("segment")
    line = F.struct("position", chat_line(F.col("role"), F.col("text")).alias("line"), F.col("turn").alias("turn"))
    grouped = threaded.filter("text <> '' OR n_quotes > 0").groupBy("conv_id", "alone", part).agg(F.sort_array(F.collect_list(line)).alias("all"), F.sum("n_linked").alias("n_linked"))
    return grouped.select("conv_id", "segment", F.transform("all", lambda x: x["turn"]).alias("turns"), "n_linked", F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("chat"))


def quoting(messages: DataFrame) -> DataFrame:
    """The messages as replies that quote first lines: by turn % 4 none, the message before's, that one announced, or the two before's on two levels.

    For tables whose messages carry no quotes; every message keeps its own text below them.
    """
    rows = messages.select("conv_id", "turn", "role", "text")
    for n in (1, 2):
        past = messages.groupBy("conv_id", (F.col("turn") + n).alias("turn")).agg(F.coalesce(F.min(F.substring_index("text", "\n", 1)), F.lit("")).alias(f"past{n}"))
        rows = rows.join(past, ["conv_id", "turn"], "left")
    one, two = F.concat(F.lit("> "), "past1", F.lit("\n")), F.concat(F.lit(">> "), "past2", F.lit("\n"))
    kind = F.col("turn") % 4
    head = F.when(kind == 1, one).when(kind == 2, F.concat(F.lit("Someone wrote:\n"), one)).when(kind == 3, F.concat(two, one))
    return rows.select("conv_id", "turn", "role", F.concat(F.coalesce(head, F.lit("")), F.coalesce("text", F.lit(""))).alias("text"))


#: The same rows from lines, units and a recursion over replies, where no message repeats a turn or lacks a conversation.
ORACLE = r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations), m AS (
  SELECT c.conv_id, c.turn, c.role, coalesce(CASE c.turn % 4 WHEN 1 THEN '> ' || split_part(a.text, chr(10), 1) || chr(10)
    WHEN 2 THEN 'Someone wrote:' || chr(10) || '> ' || split_part(a.text, chr(10), 1) || chr(10)
    WHEN 3 THEN '>> ' || split_part(b.text, chr(10), 1) || chr(10) || '> ' || split_part(a.text, chr(10), 1) || chr(10) END, '') || c.text AS text
  FROM c LEFT JOIN c a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1 LEFT JOIN c b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2
), s AS (SELECT conv_id, turn, regexp_split_to_array(text, '\r?\n') AS ls FROM m), l AS (
  SELECT conv_id, turn, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM s
), k AS (SELECT *, regexp_extract(line, '^(?:[ \t]*>)+') AS marks, regexp_replace(line, '^(?:[ \t]*>)+ ?', '') AS body FROM l), v AS (
  SELECT conv_id, turn, i, body, len(marks) - len(replace(marks, '>', '')) AS level FROM k
), g AS (
  SELECT *, i - row_number() OVER (PARTITION BY conv_id, turn, level ORDER BY i) AS island, lead(level) OVER (PARTITION BY conv_id, turn ORDER BY i) AS next FROM v
), own AS (
  SELECT conv_id, turn, regexp_replace(regexp_replace(string_agg(body, chr(10) ORDER BY i), '\n(?:[ \t]*\n)+', chr(10), 'g'), '\A[\s\x0B]+|[\s\x0B]+\z', '', 'g') AS text
  FROM g WHERE level = 0 AND NOT (coalesce(next, 0) > 0 AND regexp_matches(body, '(?i)(?:wrote|writes|said|schrieb|écrit|escribió) ?:[ \t]*$')) GROUP BY conv_id, turn
), said AS (SELECT m.conv_id, m.turn, m.role, coalesce(own.text, '') AS text FROM m LEFT JOIN own USING (conv_id, turn)), q AS (
  SELECT conv_id, turn, level, min(i) AS passage, list(body ORDER BY i) AS ls FROM g WHERE level > 0 GROUP BY conv_id, turn, level, island
), qu AS (SELECT conv_id, turn, level, passage, unnest(list_append(ls, array_to_string(ls, chr(10)))) AS x FROM q), su AS (
  SELECT conv_id, turn, unnest(list_append(string_split(text, chr(10)), text)) AS x FROM said WHERE text <> ''
), qn AS (SELECT DISTINCT conv_id, turn, level, passage, trim(regexp_replace(lower(x), '[\s\x0B\x{A0}]+', ' ', 'g')) AS unit FROM qu), sn AS (
  SELECT DISTINCT conv_id, turn, trim(regexp_replace(lower(x), '[\s\x0B\x{A0}]+', ' ', 'g')) AS unit FROM su
), f AS (
  SELECT qn.conv_id, qn.turn, level, passage, qn.unit, max(sn.turn) AS original FROM qn LEFT JOIN sn ON sn.conv_id = qn.conv_id AND sn.unit = qn.unit AND sn.turn < qn.turn WHERE qn.unit <> '' GROUP BY ALL
), votes AS (SELECT conv_id, turn, level, passage, original, count(*) AS n FROM f GROUP BY ALL), best AS (
  SELECT * FROM votes WHERE original IS NOT NULL QUALIFY row_number() OVER (PARTITION BY conv_id, turn, passage ORDER BY n DESC, original DESC) = 1
), reply AS (
  SELECT conv_id, turn, original AS reply_to FROM best QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, original DESC) = 1
), counted AS (SELECT conv_id, turn, count(*) AS n_linked FROM best GROUP BY ALL), nq AS (SELECT conv_id, turn, count(*) AS n_quotes FROM q GROUP BY ALL), tree AS (
  SELECT said.conv_id, said.turn, [said.turn] AS path FROM said LEFT JOIN reply USING (conv_id, turn) WHERE reply_to IS NULL
  UNION ALL SELECT r.conv_id, r.turn, list_append(tree.path, r.turn) FROM reply r JOIN tree ON tree.conv_id = r.conv_id AND tree.turn = r.reply_to
)
SELECT said.conv_id, row_number() OVER (PARTITION BY said.conv_id ORDER BY path) - 1 AS position, said.turn, role, text, CAST(coalesce(n_quotes, 0) AS INTEGER) AS n_quotes,
  coalesce(n_linked, 0) AS n_linked, reply_to, CASE WHEN text <> '' THEN '<|' || coalesce(role, '') || '|>' || chr(10) || text || chr(10) || '<|end|>' END AS line
FROM said JOIN tree USING (conv_id, turn) LEFT JOIN reply USING (conv_id, turn) LEFT JOIN counted USING (conv_id, turn) LEFT JOIN nq USING (conv_id, turn)
"""
