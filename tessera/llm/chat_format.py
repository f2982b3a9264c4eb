"""Chat formatting: a visitor flattens typed content parts; control strings inside texts are escaped reversibly."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import with_long_ids

#: Fixed values of the template: marks of a turn, and placeholders of the parts that aren't text.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>", "unknown": "<|unknown|>"}
#: Control strings of the template and of others: a first character and what follows it.
CONTROL = r"([<\[])(\\*)(\|(?:turn|body|end|image|audio|document|unknown|im_start|im_end|endoftext|startoftext)\|>|/?s>|/?INST\]|/?SYS\]|<SYS>>|</SYS>>)"
ESCAPED = CONTROL.replace(r"(\\*)", r"\\(\\*)")
#: Tokens that stand for a part which doesn't tell its own number.
DEFAULT_TOKENS = {"image": 256, "audio": 128, "document": 512, "unknown": 0}
_CONTROL, _ESCAPED = re.compile(CONTROL), re.compile(ESCAPED)
_PLACES = re.compile("|".join(re.escape(p) for p in PLACEHOLDERS.values()))

PART = "struct<kind:string,text:string,ref:string,tokens:long>"


def escape(text: str) -> str:
    """One more backslash after the first character of each control string, escaped or not."""
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


class Flattener:
    """Visits the parts of each turn in order and builds text, loss mask, attachments and expanded token counts."""

    def __init__(self, loss_roles: frozenset[str]):
        self.loss_roles, self.pieces, self.size = loss_roles, [], 0
        self.loss: list[dict] = []
        self.attachments: list[dict] = []

    def put(self, text: str) -> None:
        self.pieces.append(text)
        self.size += len(text)

    def turn(self, number, role: str, parts: list[dict | None]) -> None:
        """Neighbouring texts are one text, so that no control string can form across them."""
        self.put(TURN + escape(role) + BODY)
        for is_text, run in groupby(enumerate(parts), key=lambda x: kind_of(x[1]) == "text"):
            if is_text:
                self.visit_text(role, "".join(part["text"] or "" for _, part in run))
            else:
                for k, part in run:
                    getattr(self, f"visit_{kind_of(part)}")(number, k, part)
        self.put(END)

    def visit_text(self, role: str, text: str) -> None:
        text = escape(text)
        if role in self.loss_roles and text:
            self.loss.append({"start": self.size, "end": self.size + len(text)})
        self.put(text)

    def _attach(self, kind: str, number, k: int, part: dict | None) -> None:
        tokens, ref = (part["tokens"], part["ref"]) if part else (None, None)
        self.attachments.append({
            "turn": number, "part": k, "kind": kind, "ref": ref, "at": self.size,
            "tokens": DEFAULT_TOKENS[kind] if tokens is None or pd.isna(tokens) else int(tokens),
        })
        self.put(PLACEHOLDERS[kind])

    def visit_image(self, number, k: int, part: dict) -> None:
        self._attach("image", number, k, part)

    def visit_audio(self, number, k: int, part: dict) -> None:
        self._attach("audio", number, k, part)

    def visit_document(self, number, k: int, part: dict) -> None:
        self._attach("document", number, k, part)

    def visit_unknown(self, number, k: int, part: dict | None) -> None:
        self._attach("unknown", number, k, part)


def kind_of(part: dict | None) -> str:
    """A part's kind: text where only a text is told, unknown for null parts and all kinds that have no visitor."""
    kind = part["kind"] if part else None
    if kind is None and part and part["text"] is not None:
        return "text"
    return kind if kind == "text" or kind in PLACEHOLDERS else "unknown"


def format_conversations(rows: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss, attachments, n_attachment_tokens, n_unknown.

    ``rows`` (conv_id, turn, role, and text or parts: an array of kind, text,
    ref, tokens) are ordered by turn, then role, then text, nulls first;
    equal rows are turns each. Null role and text are empty; null parts mean
    the text; a part without kind that has a text is one; null parts in the array, and those of other kinds, are attachments of kind
    unknown with a placeholder of no tokens unless they tell some, and n_unknown counts them. Neighbouring text parts are one text. A turn is ``TURN role BODY content END``; control strings in
    role and text get a backslash, which reading back removes. ``loss`` are
    spans (code points, end exclusive) of the formatted text that hold the
    text of ``loss_roles``, ``attachments`` the parts that aren't text with
    the place of their placeholder and the tokens it expands to. A conversation
    is one training text, so its own turns are together in one row;
    rows without conv_id are conversations of one turn each. An empty table
    gives no row; other columns are ignored.
    """
    parts = F.col("parts").cast(f"array<{PART}>") if "parts" in rows.columns else F.lit(None).cast(f"array<{PART}>")
    text = F.col("text").cast("string") if "text" in rows.columns else F.lit(None).cast("string")
    turns = rows.select(
        F.col("conv_id").cast("long").cast("string").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"), parts.alias("parts")).alias("t"),
    )
    grouped = turns.filter("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    single = turns.filter("conv_id is null").select("conv_id", F.array("t").alias("turns"))
    roles = frozenset(loss_roles)

    def formatted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for turns in batch["turns"]:
                f = Flattener(roles)
                for t in turns:
                    own = t["parts"] if t["parts"] is not None else [{"kind": "text", "text": t["text"], "ref": None, "tokens": None}]
                    f.turn(None if pd.isna(t["turn"]) else int(t["turn"]), t["role"], list(own))
                unknown = sum(a["kind"] == "unknown" for a in f.attachments)
                out.append(("".join(f.pieces), f.loss, f.attachments, sum(a["tokens"] for a in f.attachments), unknown))
            names = ["formatted", "loss", "attachments", "n_attachment_tokens", "n_unknown"]
            yield pd.concat([batch[["conv_id"]].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    schema = "conv_id string, formatted string, loss array<struct<start:long,end:long>>, attachments array<struct<turn:long,part:long,kind:string,ref:string,at:long,tokens:long>>, n_attachment_tokens long, n_unknown long"
    return with_long_ids(grouped.unionByName(single).mapInPandas(formatted, schema), "conv_id")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation; placeholders are left out of the text."""
    turns = []
    for piece in formatted.split(TURN)[1:]:
        role, _, rest = piece.partition(BODY)
        body, _, _ = rest.partition(END)
        turns.append((unescape(role), "".join(map(unescape, _PLACES.split(body)))))
    return turns


def digests(conversations: DataFrame) -> DataFrame:
    """What the formatted texts say of themselves: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for conv_id, text, loss in zip(batch["conv_id"], batch["formatted"], batch["loss"]):
                turns = read_back(text)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                learned = "".join(unescape(text[s["start"] : s["end"]]) for s in loss)
                out.append((conv_id, len(turns), _sha(said), len(learned), _sha(learned), len(text)))
            yield pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    schema = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    rows = conversations.select(F.col("conv_id").cast("string").alias("conv_id"), "formatted", "loss")
    return with_long_ids(rows.mapInPandas(read, schema), "conv_id")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "replace")).hexdigest()


#: What both rows of the conversation that the query adds say.
ADDED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
ROW = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
