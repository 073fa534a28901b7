"""Chat formatting of typed content parts.

A message's content is an array of parts. A visitor, one branch for each type,
turns the parts into text: a text part is itself, an image, an audio clip or a
document becomes an ordered placeholder such as ``<|image_2|>``, numbered by
type through the conversation. For each placeholder an attachment is recorded
with its reference and the number of tokens that it will expand to. Messages
are rendered in the order of their turns into one training text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("image", "audio", "document")
PART_TYPE = "array<struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>"
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 512
IMAGE_LEAST, AUDIO_LEAST, PAGE_LEAST = 1, 1, 1


def expanded_tokens(part: Column) -> Column:
    """Tokens that a part's placeholder stands for; 0 for text.

    An image has one for each patch of ``PATCH`` pixels square, audio
    ``AUDIO_RATE`` a second, a document ``PAGE_TOKENS`` a page; sizes that are
    null or not positive count as the smallest attachment of the kind.
    """

    def side(c: Column) -> Column:
        return F.ceil(F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)) / PATCH)

    image = side(part["width"]) * side(part["height"])
    audio = F.greatest(F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE), F.lit(AUDIO_LEAST))
    document = F.greatest(F.coalesce(part["pages"], F.lit(PAGE_LEAST)), F.lit(PAGE_LEAST)) * PAGE_TOKENS
    return F.when(part["type"] == "image", image).when(part["type"] == "audio", audio).when(part["type"] == "document", document).otherwise(F.lit(0)).cast("long")


def _visit(parts: Column) -> Column:
    """What a visitor of the ordered parts returns: (text, attachments).

    Each part is visited once and gives its text or its placeholder; the
    numbers are positions among the parts of a kind, so nothing is rebuilt as
    the visit goes on.
    """
    known = lambda p: F.coalesce(p["type"].isin(*KINDS), F.lit(False))
    held = F.transform(parts, lambda p, i: F.struct(p.alias("part"), i.alias("at")))

    def places(k: str) -> Column:
        return F.transform(F.filter(held, lambda x: F.coalesce(x["part"]["type"] == k, F.lit(False))), lambda x: x["at"])

    def numbered(p: Column, at: Column, own: dict[str, Column]) -> Column:
        number = None
        for k in KINDS:
            here = F.array_position(own[k], at)
            number = F.when(p["type"] == k, here) if number is None else number.when(p["type"] == k, here)
        return F.concat(F.lit("<|"), p["type"], F.lit("_"), number.cast("string"), F.lit("|>"))

    def visited(v: Column) -> Column:
        own = {k: v[k] for k in KINDS}
        said = F.transform(v["held"], lambda x: F.when(known(x["part"]), numbered(x["part"], x["at"], own)).otherwise(F.coalesce(x["part"]["text"], F.lit(""))))
        met = F.filter(v["held"], lambda x: known(x["part"]))
        attached = F.transform(met, lambda x, place: F.struct(place.alias("place"), x["part"]["type"].alias("kind"), x["part"]["ref"].alias("ref"), expanded_tokens(x["part"]).alias("tokens")))
        return F.struct(F.array_join(said, "").alias("text"), attached.alias("attachments"))

    # Bound once for a row, as each of these is used by every part.
    return F.element_at(F.transform(F.array(F.struct(held.alias("held"), *(places(k).alias(k) for k in KINDS))), visited), 1)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \n\t\r]+")), F.lit(0)).cast("long")


def format_chats(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "content") -> DataFrame:
    """(conv_id, text, attachments, text_words, attachment_tokens), one row for each conversation.

    ``content`` is an array of parts (``PART_TYPE``). Messages are ordered by
    turn (null turns last; equal turns by role, then by content) and rendered as
    ``<|start|>role\\n...<|end|>``; a null role is ``unknown``. A null or empty
    content renders an empty message, a null part and a part of unknown or null
    type count as their text, if any. A placeholder's text is its number within
    the conversation, so repeated references stay apart. Repeated messages are
    each rendered. A null conversation id is a conversation of its own. A text
    that holds the letters of a mark or placeholder, such as ``<|end|>``, keeps
    them: text is never changed, and ``attachments`` alone says which
    placeholders stand for one. An empty table gives no rows, very long parts
    are kept whole, and other columns are not looked at.
    """
    src = messages.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("unknown")).alias("role"),
        F.filter(F.coalesce(F.col(content_col), F.array().cast(PART_TYPE)), lambda p: p.isNotNull()).alias("parts"),
    )

    def text(value: str | Column) -> Column:
        none = {n: F.lit(None) for n in ("ref", "width", "height", "seconds", "pages")}
        return F.array(F.struct(F.lit("text").alias("type"), (F.lit(value) if isinstance(value, str) else value).alias("text"), *(v.alias(k) for k, v in none.items()))).cast(PART_TYPE)

    framed = F.concat(text(F.concat(F.lit("<|start|>"), F.col("role"), F.lit("\n"))), F.col("parts"), text("<|end|>\n"))
    turns = src.select("conv_id", F.struct(F.col("turn").isNull().alias("last"), F.col("turn").alias("turn"), F.col("role").alias("role"), framed.alias("parts")).alias("m"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    seen = chats.select("conv_id", _visit(F.flatten(F.transform("ms", lambda m: m["parts"]))).alias("v"))
    tokens = F.aggregate(F.col("v.attachments"), F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    return seen.select("conv_id", "v.text", "v.attachments", words(F.col("v.text")).alias("text_words"), tokens.alias("attachment_tokens"))


def parts_of(conversations: DataFrame) -> DataFrame:
    """Typed parts for every row of ``conversations``: (conv_id, turn, role, content).

    The table has text alone. Each line, with the newline that ends it,
    becomes a text part, and after the text a turn refers to attachments by
    its own numbers, so that every type and every order of types occurs:
    turns whose ``conv_id + turn`` is 1, 2 or 3 modulo 4 carry an image, an
    audio clip or a document, and each fifth conversation a second image.
    """
    k = F.col("conv_id") + F.col("turn")
    name = F.concat_ws("/", F.col("conv_id"), F.col("turn"))

    def part(kind: str, **fields) -> Column:
        got = {"type": F.lit(kind), "text": F.lit(None), "ref": F.lit(None), "width": F.lit(None), "height": F.lit(None), "seconds": F.lit(None), "pages": F.lit(None)} | fields
        return F.struct(*(v.alias(n) for n, v in got.items()))

    image = part("image", ref=F.concat(F.lit("img/"), name), width=(F.lit(64) + k % 7 * 100).cast("int"), height=(F.lit(48) + k % 5 * 90).cast("int"))
    second = part("image", ref=F.concat(F.lit("img2/"), name), width=F.lit(56), height=F.lit(56))
    audio = part("audio", ref=F.concat(F.lit("audio/"), name), seconds=(k % 9).cast("double") / 2)
    document = part("document", ref=F.concat(F.lit("doc/"), name), pages=(k % 4 + 1).cast("int"))
    lines = F.transform(F.split(F.col("text"), r"(?<=\n)"), lambda line: part("text", text=line))
    none = F.array().cast(PART_TYPE)
    attached = F.when(k % 4 == 1, F.array(image).cast(PART_TYPE)).when(k % 4 == 2, F.array(audio).cast(PART_TYPE)).when(k % 4 == 3, F.array(document).cast(PART_TYPE)).otherwise(none)
    more = F.when(F.col("conv_id") % 5 == 0, F.array(second).cast(PART_TYPE)).otherwise(none)
    return conversations.select("conv_id", "turn", "role", F.concat(F.coalesce(lines.cast(PART_TYPE), none), attached, more).alias("content"))


CHAT_SQL = """
WITH t AS (
  SELECT conv_id, turn, role, text, conv_id + turn AS k, conv_id || '/' || turn AS name FROM conversations
), a AS (
  SELECT conv_id, turn, 0 AS o,
         CASE k % 4 WHEN 1 THEN 'image' WHEN 2 THEN 'audio' ELSE 'document' END AS kind,
         CASE k % 4 WHEN 1 THEN 'img/' WHEN 2 THEN 'audio/' ELSE 'doc/' END || name AS ref,
         CAST(CASE k % 4
           WHEN 1 THEN ceil((64 + k % 7 * 100) / 28.0) * ceil((48 + k % 5 * 90) / 28.0)
           WHEN 2 THEN greatest(ceil((k % 9) / 2.0 * 25), 1)
           ELSE (k % 4 + 1) * 512 END AS BIGINT) AS tokens
  FROM t WHERE k % 4 <> 0
  UNION ALL
  SELECT conv_id, turn, 1, 'image', 'img2/' || name, 4 FROM t WHERE conv_id % 5 = 0
), n AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, kind ORDER BY turn, o) AS number,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, o) - 1 AS place
  FROM a
), m AS (
  SELECT t.conv_id, t.turn, '<|start|>' || t.role || chr(10) || coalesce(t.text, '')
         || coalesce((SELECT string_agg('<|' || kind || '_' || number || '|>', '' ORDER BY place) FROM n WHERE n.conv_id = t.conv_id AND n.turn = t.turn), '')
         || '<|end|>' || chr(10) AS body
  FROM t
), c AS (SELECT conv_id, string_agg(body, '' ORDER BY turn) AS text FROM m GROUP BY conv_id)
SELECT c.conv_id, c.text,
       coalesce(x.refs, '') AS refs,
       CAST(len(regexp_extract_all(c.text, '[^ \\n\\t\\r]+')) AS BIGINT) AS text_words,
       coalesce(x.tokens, 0) AS attachment_tokens
FROM c LEFT JOIN (
  SELECT conv_id, string_agg(place || ':' || kind || ':' || ref || ':' || tokens, ' ' ORDER BY place) AS refs, CAST(sum(tokens) AS BIGINT) AS tokens
  FROM n GROUP BY conv_id
) x ON x.conv_id = c.conv_id
"""


def flat_refs(chats: DataFrame) -> DataFrame:
    """The attachments written as one string, ``place:kind:ref:tokens`` each, in order."""
    one = F.transform("attachments", lambda a: F.concat_ws(":", a["place"], a["kind"], a["ref"], a["tokens"]))
    return chats.select("conv_id", "text", F.concat_ws(" ", one).alias("refs"), "text_words", "attachment_tokens")
