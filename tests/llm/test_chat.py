import math

from glossator.llm import chat

KEYS = ("type", "text", "ref", "width", "height", "seconds", "pages")


def _part(**own):
    return {k: own.get(k) for k in KEYS}


def _brute(messages):
    """A plain visitor, one method for each type."""
    order = sorted(messages, key=lambda m: (m[1] is None, m[1] or 0, m[2] or "unknown"))
    text, attached, count = "", [], {}
    for _, _, role, content in order:
        text += f"<|start|>{role or 'unknown'}\n"
        for p in content or []:
            if p is None:
                continue
            if p["type"] in ("image", "audio", "document"):
                kind = p["type"]
                count[kind] = count.get(kind, 0) + 1
                if kind == "image":
                    tokens = math.ceil(max(p["width"] or 1, 1) / 28) * math.ceil(max(p["height"] or 1, 1) / 28)
                elif kind == "audio":
                    tokens = max(math.ceil((p["seconds"] or 0) * 25), 1)
                else:
                    tokens = max(p["pages"] or 1, 1) * 512
                attached.append((len(attached), kind, p["ref"], tokens))
                text += f"<|{kind}_{count[kind]}|>"
            else:
                text += p["text"] or ""
        text += "<|end|>\n"
    return text, attached


def test_against_a_plain_visitor(spark):
    rows = [
        (1, 2, "assistant", [_part(type="text", text="see "), _part(type="image", ref="b", width=57, height=28), None]),
        (1, 1, "user", [_part(type="image", ref="a", width=None, height=-4), _part(type="audio", ref="s", seconds=1.01), _part(type="text", text="x" * 50_000)]),
        (1, None, None, [_part(type="document", ref="d", pages=3), _part(type="document", ref=None, pages=0), _part(type="image", ref="a")]),
        (2, 1, "user", None), (2, 1, "user", None), (2, 3, "tool", []),
        (None, 1, "user", [_part(type="video", text="odd"), _part(text="none"), _part(type="audio", seconds=None)]),
    ]
    rows = [(*r, "extra", 5) for r in rows]
    table = spark.createDataFrame(rows, f"conv_id long, turn int, role string, content {chat.PART_TYPE}, text string, parts int").repartition(3)
    got = {r.conv_id: (r.text, [tuple(a) for a in r.attachments], r.text_words, r.attachment_tokens) for r in chat.format_chats(table).collect()}
    assert set(got) == {1, 2, None}
    for conv, (text, attached, words, tokens) in got.items():
        want = _brute([r[:4] for r in rows if r[0] == conv])
        assert (text, attached) == want
        assert words == len(text.split()) and tokens == sum(a[3] for a in attached)
    assert chat.format_chats(table.limit(0)).count() == 0


def test_line_breaks_of_a_turn_are_kept(spark):
    texts = ["in thor.\nTion hein", "\n\na\n", "", None, "one line", "a\r\n\n\nb", "\n"]
    turns = spark.createDataFrame([(4 * i, 4, "user", t) for i, t in enumerate(texts, 1)], "conv_id long, turn int, role string, text string").repartition(2)
    parts = {r.conv_id: [p.text for p in r.content if p.type == "text"] for r in chat.parts_of(turns).collect()}
    assert parts[4] == ["in thor.\n", "Tion hein"]
    got = {r.conv_id: (r.text, r.text_words) for r in chat.format_chats(chat.parts_of(turns)).collect()}
    for i, t in enumerate(texts, 1):
        second = "<|image_1|>" if 4 * i % 5 == 0 else ""
        want = f"<|start|>user\n{t or ''}{second}<|end|>\n"
        assert got[4 * i] == (want, len(want.split()))


def test_query_and_sql_agree_on_whole_turns(spark):
    import duckdb

    from glossator.llm.catalogue import QUERIES

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS FROM '{folder}/conversations.parquet'")
    names = ["conv_id", "text", "refs", "text_words", "attachment_tokens"]
    want = sorted(con.sql(f"SELECT {', '.join(names)} FROM ({chat.CHAT_SQL})").fetchall())
    got = sorted(tuple(r[n] for n in names) for r in QUERIES["op5_chat_formatting"](spark, folder).collect())
    assert got == want and any("\n" in t[1].split("\n", 1)[1].split("<|end|>")[0] for t in got)


def test_ties_and_literal_marks(spark):
    odd = "<|image_1|> and <|end|>"
    rows = [(1, 1, "user", [_part(type="text", text="b")]), (1, 1, "user", [_part(type="text", text="a")]), (1, 2, "user", [_part(type="text", text=odd), _part(type="image", ref="r", width=1, height=1)])]
    (r,) = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn int, role string, content {chat.PART_TYPE}").repartition(3)).collect()
    assert r.text == f"<|start|>user\na<|end|>\n<|start|>user\nb<|end|>\n<|start|>user\n{odd}<|image_1|><|end|>\n"
    assert [tuple(a) for a in r.attachments] == [(0, "image", "r", 1)]
