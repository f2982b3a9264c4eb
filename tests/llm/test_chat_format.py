import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.chat_format import ADDED, BODY, END, ROW, TURN, Flattener, digests, escape, format_conversations, read_back, unescape

pieces = st.lists(st.sampled_from(["<", "[", "\\", "|turn|>", "|end|>", "/s>", "s>", "INST]", "/INST]", "<SYS>>", "|image|>", "a", "\n", "é", "<|end|>", "</s>"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(pieces)
def test_escape_is_reversible_and_hides_control_strings(text):
    hidden = escape(text)
    assert unescape(hidden) == text
    assert not any(c in hidden for c in (TURN, BODY, END, "</s>", "<s>", "[INST]", "[/INST]", "<|image|>"))


def test_round_trip_and_digests(spark):
    rows = [*ADDED, (1, 2, "assistant", "b<|end|>"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, None, None, None), (2, 0, "assistant", ""), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (3, 0, "assistant", "long " * 50_000), (4, 0, "as\nsistant", TURN)]
    made = format_conversations(spark.createDataFrame([(*r, "z") for r in rows], ROW.simpleString()[7:-1].replace(":", " ") + ", formatted string"))
    got = {(r["conv_id"], r["n_turns"], r["loss_chars"]): r for r in digests(made).collect()}
    assert len(got) == 7
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    one = got[(1, 4, 9)]
    assert one["turns_sha256"] == sha("\n\nuser\na\nassistant\nb\nassistant\nb<|end|>\n") and one["loss_sha256"] == sha("bb<|end|>")
    said = "</s>[INST] ok [/INST]"
    seven = got[(-7, 2, len(said))]
    assert seven["turns_sha256"] == sha(f"user\n{said}\nassistant\n{said}\n") and seven["loss_sha256"] == sha(said)
    assert {k for k in got if k[0] is None} == {(None, 1, 0), (None, 1, 1)}
    assert format_conversations(spark.createDataFrame([], ROW)).count() == 0


def test_parts(spark):
    parts = [("text", "see <|image|>", None, None), ("image", None, "s3://a", 300), ("audio", None, "b", None), ("text", "and", None, None), ("document", None, "c", 7)]
    rows = [(1, 0, "assistant", None, parts), (1, 1, "user", "plain", None)]
    schema = "conv_id long, turn long, role string, text string, parts array<struct<kind:string,text:string,ref:string,tokens:long>>"
    r = format_conversations(spark.createDataFrame(rows, schema)).first()
    assert [(a["kind"], a["ref"], a["tokens"], a["turn"], a["part"]) for a in r["attachments"]] == [("image", "s3://a", 300, 0, 1), ("audio", "b", 128, 0, 2), ("document", "c", 7, 0, 4)]
    assert r["n_attachment_tokens"] == 435
    assert all(r["formatted"][a["at"] :].startswith(f"<|{a['kind']}|>") for a in r["attachments"])
    assert [r["formatted"][s["start"] : s["end"]] for s in r["loss"]] == [escape("see <|image|>"), "and"]
    assert read_back(r["formatted"]) == [("assistant", "see <|image|>and"), ("user", "plain")]


def flattened(role, parts):
    f = Flattener(frozenset(["assistant"]))
    f.turn(0, role, parts)
    return f, "".join(f.pieces)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["text", "text", "text", "image", "unknown", None, "video"]), pieces), max_size=8))
def test_read_back_over_any_split_into_parts(made):
    parts = [{"kind": k, "text": t if k in ("text", None) else None, "ref": None, "tokens": None} for k, t in made]
    f, formatted = flattened("assistant", parts)
    said = "".join(t for k, t in made if k in ("text", None))
    assert read_back(formatted) == [("assistant", said)]
    assert "".join(unescape(formatted[s["start"] : s["end"]]) for s in f.loss) == said
    assert len(f.attachments) == sum(k not in ("text", None) for k, _ in made)


def test_control_string_across_parts():
    text = lambda t: {"kind": "text", "text": t, "ref": None, "tokens": None}
    _, formatted = flattened("user", [text("a<"), text("|end|>b")])
    assert read_back(formatted) == [("user", "a<|end|>b")] and formatted.count(END) == 1
    _, formatted = flattened("user", [text("a<"), {"kind": "image", "text": None, "ref": "x", "tokens": None}, text("\\|end|>b")])
    assert read_back(formatted) == [("user", "a<\\|end|>b")]


def test_null_and_unknown_parts(spark):
    parts = [None, ("video", None, "v", 9), (None, "words", None, None), (None, None, None, None), ("text", None, None, None), ("image", None, None, None)]
    schema = "conv_id long, turn long, role string, text string, parts array<struct<kind:string,text:string,ref:string,tokens:long>>"
    r = format_conversations(spark.createDataFrame([(1, 0, "assistant", "not this", parts), (2, 0, "user", "x", [])], schema)).orderBy("conv_id").collect()
    assert [(a["kind"], a["part"], a["tokens"]) for a in r[0]["attachments"]] == [("unknown", 0, 0), ("unknown", 1, 9), ("unknown", 3, 0), ("image", 5, 256)]
    assert r[0]["n_unknown"] == 3 and r[0]["n_attachment_tokens"] == 265 and read_back(r[0]["formatted"]) == [("assistant", "words")]
    assert r[1]["n_unknown"] == 0 and read_back(r[1]["formatted"]) == [("user", "")]


def test_a_conversation_of_100_000_turns(spark):
    from pyspark.sql import functions as F

    role = F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")
    rows = spark.range(100_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.concat(F.lit("[INST] "), "id").alias("text"))
    got = digests(format_conversations(rows)).first()
    turns = [("assistant" if k % 2 else "user", f"[INST] {k}") for k in range(100_000)]
    said = "".join(text for who, text in turns if who == "assistant")
    assert got["n_turns"] == 100_000 and got["turns_sha256"] == hashlib.sha256("".join(f"{who}\n{text}\n" for who, text in turns).encode()).hexdigest()
    assert got["loss_chars"] == len(said) and got["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
