"""Operator 7: quotation linking, in DataFrame functions only.

Lines that start with ">" marks are quotes of that nesting level.  Quoted passages (runs of
lines of one level) and their lines are normalised (lower case, letters and digits) and
hashed; so are every message's own text, its paragraphs and lines.  A quote links to the
earlier message of its conversation whose first occurrence of the hashed text it has the
most words of (then the earliest).  A quote without such a message, of at least
FAR_WORDS words, links to the first occurrence in any other conversation.  Level 1 names the message replied to,
level 2 what that one quoted, and so on; ``links`` has them all.  Where level 1 has no link, the least level that
has one gives the message's place (its ``reply_to`` is then the nearest message above that is known).

Messages come back without quotes and attribution lines, with ``reply_to``, ``depth`` (replies
above that are linked) and ``thread`` (the turn that starts the exchange, by pointer jumping):
ordered by (conversation, thread, turn), every message follows the one it replies to.
``conversations`` puts them together: one row a thread, its messages in order.  A thread of more than
PART_MESSAGES messages comes in numbered parts, so no task holds a thread whole.

``chat`` is a message's text under the mark of its role.  Text can't forge a mark: "<", any backslashes
and "|" get one backslash more (``unescape`` takes it back), and a role's characters other than letters, digits, "_" and "-" become "_".

Joins are by hash to one row a hash (the first occurrence, taken with partial sums; far ones: those of two conversations), so
a line that a third of all messages share stays one row, and no pairs of messages are made.

Null and empty texts: no lines, empty text.  Null conversation: a conversation of its
own; null turn: after all others, never replied to.  Repeated rows: counted once.  Other
columns of the input aren't read.  A message that only quotes has an empty text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import with_row_index
from . import common

FAR_WORDS = 8
PART_MESSAGES = 1024
LAST = (1 << 62)
MARKS = r"^((?:[ \t]*>)+)"
ATTRIBUTION = r"(?i)^\s*(on|am|le|el|il)\s.*(wrote|writes|schrieb|écrit|escribió|ha scritto)\s*:\s*$"


def normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def escape(c: Column) -> Column:
    """Text in which no mark of a role can be read."""
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def parse(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
          text_col: str = "text") -> DataFrame:
    """Distinct messages with c (conversation key), t (turn), m (message key), lines (i, level, body) and own text."""
    base = messages.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
                           F.col(text_col).alias("text")).distinct()
    lines = F.split(F.coalesce("text", F.lit("")), "\r?\n")
    base = base.select(F.when(F.col("conv").isNull(), F.lit("n")).otherwise(F.concat(F.lit("c"), F.col("conv").cast("string"))).alias("c"),
                       F.coalesce(F.col("turn").cast("bigint"), F.lit(LAST)).alias("t"), "conv", "turn", "role",
                       F.xxhash64("role", "text", F.isnull("text")).alias("m"), lines.alias("raw"))
    parsed = F.transform("raw", lambda x, i: F.struct(
        i.alias("i"), _level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("body"),
        (x.rlike(ATTRIBUTION) & F.coalesce(_level(F.get("raw", i + 1)) > _level(x), F.lit(False))).alias("said")))
    own = F.filter("lines", lambda x: (x["level"] == 0) & ~x["said"])
    return (base.withColumn("lines", parsed).drop("raw")
            .withColumn("own", F.trim(F.array_join(F.transform(own, lambda x: x["body"]), "\n"), F.lit(" \t\r\n"))))


def _origins(parsed: DataFrame) -> DataFrame:
    """(c, h, t): every hashed text, paragraph and line of messages' own words."""
    units = F.array_distinct(F.transform(F.concat(F.array("own"), F.split("own", r"\n\s*\n"), F.split("own", r"\n")), normal))
    return parsed.select("c", "t", F.explode(units).alias("u")).where("u <> ''").select("c", "t", F.xxhash64("u").alias("h"), F.md5("u").alias("d"))


def _quotes(parsed: DataFrame) -> DataFrame:
    """(c, t, m, level, h, d, words): quoted passages and lines."""
    line = (parsed.where(F.exists("lines", lambda x: x["level"] > 0)).select("c", "t", "m", F.inline("lines"))
            .where("level > 0 and not said").withColumn("body", normal(F.col("body"))).where("body <> ''"))
    # lines of one level without a gap are one passage: line number less rank is constant in it
    rank = F.row_number().over(Window.partitionBy("c", "t", "m", "level").orderBy("i"))     # within one message
    passage = (line.withColumn("run", F.col("i") - rank).groupBy("c", "t", "m", "level", "run")
               .agg(F.array_sort(F.collect_list(F.struct("i", "body"))).alias("x"))
               .select("c", "t", "m", "level", F.array_join(F.col("x.body"), " ").alias("u")))
    units = line.select("c", "t", "m", "level", F.col("body").alias("u")).union(passage)
    return units.select("c", "t", "m", "level", F.xxhash64("u").alias("h"), F.md5("u").alias("d"), F.size(F.split("u", " ")).alias("words"))


def links(messages: DataFrame, **names) -> DataFrame:
    """(c, t, level, to_c, to_t, words): the original message of each quote level of a message."""
    parsed = parse(messages, **names)
    quotes = common.save(_quotes(parsed), "quotes")
    asked = quotes.select("h", "d").distinct()
    origin = common.save(_origins(parsed).join(asked, ["h", "d"], "left_semi").groupBy("c", "h", "d").agg(F.min("t").alias("to_t")), "origins")
    near = quotes.join(origin, ["c", "h", "d"]).where("to_t < t").select("c", "t", "level", F.col("c").alias("to_c"), "to_t", "words")
    # the two first conversations of a hash (Spark limits each task's rows before the shuffle): one of them isn't the quote's own
    rank = F.row_number().over(Window.partitionBy("h", "d").orderBy("c"))
    anywhere = (origin.withColumn("k", rank).where("k <= 2").groupBy("h", "d")
                .agg(F.array_sort(F.collect_list(F.struct(F.col("c").alias("to_c"), "to_t"))).alias("o")))
    other = F.get(F.filter("o", lambda x: x["to_c"] != F.col("c")), F.lit(0))
    far = (quotes.join(near.select("c", "t", "level").distinct(), ["c", "t", "level"], "left_anti").where(F.col("words") >= FAR_WORDS)
           .join(anywhere, ["h", "d"]).withColumn("o", other).where("o is not null").select("c", "t", "level", "o.to_c", "o.to_t", "words"))
    return (near.union(far).groupBy("c", "t", "level", "to_c", "to_t").agg(F.sum("words").alias("words"))
            .groupBy("c", "t", "level").agg(F.min(F.struct((-F.col("words")).alias("w"), "to_c", "to_t")).alias("b"))
            .select("c", "t", "level", "b.to_c", "b.to_t", (-F.col("b.w")).alias("words")))


def roots(parents: DataFrame) -> DataFrame:
    """(c, t, root, depth) of (c, t, p) with p < t, by pointer jumping: the
    rounds are the logarithm of the depth, each written to the shared folder."""
    now = common.save(parents.select("c", "t", F.col("p").alias("root"), F.lit(1).alias("depth")), "parents")
    while True:
        up = now.select("c", F.col("t").alias("root"), F.col("root").alias("r2"), F.col("depth").alias("d2"))
        more = now.join(up, ["c", "root"], "left")
        if more.where("r2 is not null").isEmpty():
            return now
        now = common.save(more.select("c", "t", F.coalesce("r2", "root").alias("root"),
                                      (F.col("depth") + F.coalesce("d2", F.lit(0))).alias("depth")), "parents")


def threads(messages: DataFrame, **names) -> DataFrame:
    """One row a distinct message: conv_id, turn, role, text (without quotes), n_quoted (lines), reply_conv,
    reply_to (turn), thread, depth, chat (the text under its role), links (level, conv, turn of each linked level)."""
    parsed = parse(messages, **names)
    level = F.struct("level", "to_c", "to_t")
    found = common.save(links(messages, **names).groupBy("c", "t").agg(F.min(level).alias("b"), F.array_sort(F.collect_list(level)).alias("all"))
                        .select("c", "t", "b.to_c", "b.to_t", "all"), "links")
    inside = found.where("to_c = c").select("c", "t", F.col("to_t").alias("p"))
    placed = roots(inside)
    out = parsed.join(found, ["c", "t"], "left").join(placed, ["c", "t"], "left")
    turn = lambda c: F.when(F.col(c) != LAST, F.col(c))
    every = F.transform("all", lambda x: F.struct(
        x["level"].alias("level"), F.when(x["to_c"] != "n", F.substring(x["to_c"], 2, 1 << 30)).alias("conv"),
        F.when(x["to_t"] != LAST, x["to_t"]).alias("turn")))
    return out.select(
        F.col("conv").alias("conv_id"), "turn", "role", F.col("own").alias("text"),
        F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("bigint").alias("n_quoted"),
        F.when(F.col("to_c") != "n", F.expr("substring(to_c, 2)")).alias("reply_conv"), turn("to_t").alias("reply_to"),
        F.coalesce("root", turn("t")).alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"),
        F.concat(F.lit("<|"), F.coalesce(F.regexp_replace("role", "[^A-Za-z0-9_-]", "_"), F.lit("user")), F.lit("|>\n"),
                 escape(F.col("own"))).alias("chat"), every.alias("links"))


def conversations(messages: DataFrame, part_messages: int = PART_MESSAGES, **names) -> DataFrame:
    """One row a thread (and part): conv_id, thread, part (from 0), n_messages, messages (turn, role, text, reply_conv,
    reply_to) in the order of turns, and their chat texts, joined by line ends.  Messages of a conversation that have no
    turn are one thread, null.  Messages of one turn are ordered by role and text."""
    last = lambda *cs: [F.col(c).asc_nulls_last() for c in cs]
    found = threads(messages, **names).select("conv_id", "thread", "turn", "role", "text", "reply_conv", "reply_to", "chat")
    rows = with_row_index(found, last("conv_id", "thread", "turn", "role", "chat"), index_col="_hgl_i")
    first = rows.groupBy(F.col("conv_id").alias("c1"), F.col("thread").alias("t1")).agg(F.min("_hgl_i").alias("_hgl_first"))
    same = F.col("conv_id").eqNullSafe(F.col("c1")) & F.col("thread").eqNullSafe(F.col("t1"))
    part = F.floor((F.col("_hgl_i") - F.col("_hgl_first")) / part_messages).alias("part")
    message = F.struct("_hgl_i", "turn", "role", "text", "reply_conv", "reply_to", "chat")
    return (rows.join(first, same).groupBy("conv_id", "thread", part).agg(F.array_sort(F.collect_list(message)).alias("x"))
            .select("conv_id", "thread", "part", F.size("x").cast("bigint").alias("n_messages"),
                    F.transform("x", lambda m: m.dropFields("_hgl_i", "chat")).alias("messages"),
                    F.array_join(F.col("x.chat"), "\n").alias("chat")))


_NORMAL = r"trim(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
_WITH = rf"""
WITH RECURSIVE m AS (SELECT DISTINCT conv_id, turn, role, text FROM @messages),
b AS (SELECT row_number() OVER () AS id, conv_id, turn, role, coalesce('c' || CAST(conv_id AS VARCHAR), 'n') AS c,
        coalesce(turn, {LAST}) AS t, regexp_split_to_array(coalesce(text, ''), '\r?\n') AS raw FROM m),
x AS (SELECT id, c, t, i, raw[i] AS line, regexp_extract(raw[i], '{MARKS}', 1) AS marks
      FROM (SELECT *, unnest(range(1, len(raw) + 1)) AS i FROM b)),
y AS (SELECT *, length(regexp_replace(marks, '[^>]', '', 'g')) AS level, regexp_replace(line, '{MARKS}', '') AS body FROM x),
l AS (SELECT *, regexp_matches(line, '{ATTRIBUTION}') AND coalesce(lead(level) OVER (PARTITION BY id ORDER BY i) > level, false) AS said FROM y),
o AS (SELECT id, c, t, coalesce(trim(string_agg(body, chr(10) ORDER BY i) FILTER (level = 0 AND NOT said), ' ' || chr(9) || chr(13) || chr(10)), '') AS own,
        count(*) FILTER (level > 0) AS n_quoted FROM l GROUP BY id, c, t),
u AS (SELECT c, t, unnest(list_concat([own], regexp_split_to_array(own, '\n\s*\n'), string_split(own, chr(10)))) AS u FROM o),
origin AS (SELECT c, u, min(t) AS to_t FROM (SELECT c, t, {_NORMAL.format(x='u')} AS u FROM u) WHERE u <> '' GROUP BY c, u),
q AS (SELECT *, {_NORMAL.format(x='body')} AS u FROM l WHERE level > 0 AND NOT said),
r AS (SELECT *, i - row_number() OVER (PARTITION BY id, level ORDER BY i) AS run FROM q WHERE u <> ''),
quote AS (SELECT c, t, level, u FROM r UNION ALL
          SELECT c, t, level, string_agg(u, ' ' ORDER BY i) FROM r GROUP BY id, c, t, level, run),
near AS (SELECT q.c, q.t, level, q.c AS to_c, to_t, len(string_split(q.u, ' ')) AS words FROM quote q JOIN origin o ON o.c = q.c AND o.u = q.u WHERE to_t < q.t),
elsewhere AS (SELECT q.c, q.u, min(o.c) AS to_c FROM (SELECT DISTINCT c, u FROM quote) q JOIN origin o ON o.u = q.u AND o.c <> q.c GROUP BY q.c, q.u),
far AS (SELECT q.c, q.t, level, o.c AS to_c, to_t, len(string_split(q.u, ' ')) AS words
        FROM quote q JOIN elsewhere e ON e.c = q.c AND e.u = q.u JOIN origin o ON o.c = e.to_c AND o.u = q.u
        WHERE len(string_split(q.u, ' ')) >= {FAR_WORDS}
        AND NOT EXISTS (SELECT 1 FROM near n WHERE n.c = q.c AND n.t = q.t AND n.level = q.level)),
w AS (SELECT c, t, level, to_c, to_t, sum(words) AS words FROM (SELECT * FROM near UNION ALL SELECT * FROM far) GROUP BY ALL),
levels AS (SELECT c, t, level, to_c, to_t FROM w QUALIFY row_number() OVER (PARTITION BY c, t, level ORDER BY words DESC, to_c, to_t) = 1),
link AS (SELECT c, t, to_c, to_t FROM levels QUALIFY row_number() OVER (PARTITION BY c, t ORDER BY level) = 1),
up AS (SELECT c, t, to_t AS root, 1 AS depth FROM link WHERE to_c = c
       UNION ALL SELECT up.c, up.t, link.to_t, depth + 1 FROM up JOIN link ON link.c = up.c AND link.t = up.root AND link.to_c = link.c),
top AS (SELECT c, t, arg_max(root, depth) AS root, max(depth) AS depth FROM up GROUP BY c, t),
message AS (SELECT conv_id, turn, role, own AS text, n_quoted, CASE WHEN to_c <> 'n' THEN substr(to_c, 2) END AS reply_conv,
  CASE WHEN to_t <> {LAST} THEN to_t END AS reply_to, coalesce(root, turn) AS thread, CAST(coalesce(depth, 0) AS INTEGER) AS depth,
  '<|' || coalesce(regexp_replace(role, '[^A-Za-z0-9_-]', '_', 'g'), 'user') || '|>' || chr(10)
    || regexp_replace(own, '<(\\*)\|', '<\\\1|', 'g') AS chat
  FROM b JOIN o USING (id, c, t) LEFT JOIN link USING (c, t) LEFT JOIN top USING (c, t))
"""


def oracle(messages: str = "conversations") -> str:
    """SQL of ``threads`` (without its links) over a table or a query in brackets."""
    return _WITH.replace("@messages", messages) + "SELECT * FROM message"


def levels_oracle(messages: str = "conversations") -> str:
    """SQL of the links of all levels, a row each."""
    return _WITH.replace("@messages", messages) + f"""SELECT conv_id, turn, role, level, CASE WHEN to_c <> 'n' THEN substr(to_c, 2) END AS to_conv,
  CASE WHEN to_t <> {LAST} THEN to_t END AS to_turn FROM b JOIN levels USING (c, t)"""


def conversations_oracle(messages: str = "conversations", part_messages: int = PART_MESSAGES) -> str:
    """SQL of ``conversations``, without the array of messages."""
    return _WITH.replace("@messages", messages) + f"""SELECT conv_id, thread, place // {part_messages} AS part, count(*) AS n_messages,
  string_agg(chat, chr(10) ORDER BY place) AS chat
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, thread ORDER BY turn NULLS LAST, role NULLS LAST, chat) - 1 AS place FROM message)
GROUP BY conv_id, thread, place // {part_messages}"""


#: Messages that quote: each the one before it and, a level deeper, the one before that; a conversation's first the next one's first.
REPLIES = r"""(SELECT conv_id, turn, role, concat_ws(chr(10), '> ' || replace(q3.text, chr(10), chr(10) || '> '),
    '> > ' || replace(q2.text, chr(10), chr(10) || '> > '), '> ' || replace(q1.text, chr(10), chr(10) || '> '), m0.text) AS text
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations) m0
  LEFT JOIN (SELECT conv_id, turn + 1 AS turn, min(text) AS text FROM conversations GROUP BY ALL) q1 USING (conv_id, turn)
  LEFT JOIN (SELECT conv_id, turn + 2 AS turn, min(text) AS text FROM conversations GROUP BY ALL) q2 USING (conv_id, turn)
  LEFT JOIN (SELECT conv_id - 1 AS conv_id, turn, min(text) AS text FROM conversations WHERE turn = 0 GROUP BY ALL) q3 USING (conv_id, turn))"""


def replies(messages: DataFrame) -> DataFrame:
    """Messages that quote, made of messages that don't (see REPLIES, its SQL)."""
    said = messages.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    quoted = lambda marks: F.concat(F.lit(marks), F.replace(F.col("text"), F.lit("\n"), F.lit("\n" + marks)))
    one = said.select("conv_id", (F.col("turn") + 1).alias("turn"), quoted("> ").alias("q1"))
    two = said.select("conv_id", (F.col("turn") + 2).alias("turn"), quoted("> > ").alias("q2"))
    far = said.where("turn = 0").select((F.col("conv_id") - 1).alias("conv_id"), "turn", quoted("> ").alias("q3"))
    out = messages.select("conv_id", "turn", "role", "text").distinct()
    for side in (one, two, far):
        out = out.join(side, ["conv_id", "turn"], "left")
    return out.select("conv_id", "turn", "role", F.concat_ws("\n", "q3", "q2", "q1", "text").alias("text"))
