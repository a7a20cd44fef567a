r"""Chat formatting with typed content parts.

A message is an array of typed parts (text, image, audio, document). A visitor flattens the parts of each message in order:
text is escaped, every other part becomes a numbered placeholder, and its attachment reference and expanded token count
are recorded. The template marks turns as <|role|> text <|end|>; control strings inside texts are escaped reversibly, so that
no text can forge a turn, and the loss mask covers the assistants' texts.

format_messages() works row by row, without a shuffle. A conversation is the concatenation of its segments in order;
read_back() streams the segments of sorted conversations through an incremental reader, which holds one turn at a time, so a
conversation of any number of turns needs bounded memory.

Escaping: each backslash is doubled, and a backslash is put between < and | . Escaped texts hold no "<|".

Defined cases: null texts and null arrays of parts are empty texts, null parts are left out; sizes, seconds and pages that are null, not finite or less than
one token's count as one token, and no part counts as more than MOST_TOKENS; a null role is the empty role; null turns come first;
equal turns are ordered by role and text (as it was before escaping); rows that repeat are turns of their own; null conversation ids form one
conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,uri:string,width:int,height:int,seconds:double,pages:int>"
PARTS = f"array<{PART}>"
END = "<|end|>"
PATCH, AUDIO_RATE, PAGE_TOKENS, MOST_TOKENS = 28, 25, 256, 2**31 - 1
_TURN = re.compile(r"<\|((?:[^\\|]|\\.)*)\|>\n(.*?)<\|end\|>\n", re.S)
_ESCAPED = re.compile(r"\\([\\|])")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


class Visitor:
    """Flattens the parts of one message: what each type of part appends, and what it records."""

    def __init__(self) -> None:
        self.out: list[str] = []
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> None:
        getattr(self, f"visit_{part['type'] or 'text'}", self.visit_other)(part)

    def visit_text(self, part: dict) -> None:
        self.out.append(escape(part["text"] or ""))

    def visit_image(self, part: dict) -> None:
        across, down = (max(1, -(-int(part[k] or 1) // PATCH)) for k in ("width", "height"))
        self.attach("image", part, across * down)

    def visit_audio(self, part: dict) -> None:
        seconds = part["seconds"] or 0
        self.attach("audio", part, max(1, round(min(seconds * AUDIO_RATE, MOST_TOKENS))) if math.isfinite(seconds) else 1)

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, PAGE_TOKENS * max(1, int(part["pages"] or 1)))

    def visit_other(self, part: dict) -> None:
        self.attach("other", part, 1)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.out.append(f"<|{kind}:{len(self.attachments)}|>")
        self.attachments.append({"kind": kind, "uri": part["uri"], "tokens": min(tokens, MOST_TOKENS)})


SEGMENT = "segment string, loss_start int, loss_end int, attachments array<struct<kind:string,uri:string,tokens:int>>, expanded_tokens long"


def format_turn(role: str | None, parts: list[dict] | None, text_only: str | None = None) -> tuple[str, int, int, list[dict]]:
    """The segment of a turn, start and end of its loss mask in it (equal: none), and its attachments."""
    v = Visitor()
    if parts is None:
        v.out.append(escape(text_only or ""))
    else:
        for p in parts:
            if p is not None:
                v.visit(p)
    head, body = f"<|{(role or '').replace(chr(92), chr(92) * 2).replace('|', chr(92) + '|')}|>\n", "".join(v.out)
    end = len(head) + len(body) if role == "assistant" else len(head)
    return f"{head}{body}{END}\n", len(head), end, v.attachments


def format_messages(messages: DataFrame, conv: str, turn: str, role: str, content: str) -> DataFrame:
    """(conv, turn, role, segment, loss_start, loss_end, attachments, expanded_tokens), a row for each message. content: a text column, or an array of PART."""
    kinds = dict(messages.dtypes)
    typed = kinds[content] != "string"

    def fmt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [format_turn(r, list(c) if typed and c is not None else [] if typed else None, None if typed else c) for r, c in zip(b["role"], b["content"], strict=True)]
            yield pd.DataFrame({
                "conv": b["conv"], "turn": b["turn"], "role": b["role"], "segment": [r[0] for r in rows], "loss_start": [r[1] for r in rows], "loss_end": [r[2] for r in rows],
                "attachments": [r[3] for r in rows], "expanded_tokens": [sum(a["tokens"] for a in r[3]) for r in rows],
            })

    rows = messages.select(*(F.col(c).alias(n) for n, c in (("conv", conv), ("turn", turn), ("role", role), ("content", content))))
    return rows.mapInPandas(fmt, f"conv {kinds[conv]}, turn {kinds[turn]}, role string, {SEGMENT}")


class Reader:
    """Reads turns back from formatted text that comes in pieces; digests of the turns and of the text under the loss mask."""

    def __init__(self) -> None:
        self.held, self.turns, self.chars, self.loss_chars = "", 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, piece: str, mask: tuple[int, int]) -> None:
        masked = unescape(piece[mask[0] : mask[1]])
        self.loss_chars += len(masked)
        self.loss.update(masked.encode("utf-8", "surrogatepass"))
        self.chars += len(piece)
        self.held += piece
        at = 0
        while m := _TURN.match(self.held, at):
            self.turns, at = self.turns + 1, m.end()
            self.all.update(f"{re.sub(r'\\(.)', r'\1', m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
        self.held = self.held[at:]

    def row(self, conv) -> dict:
        return {"conv": conv, "n_turns": self.turns, "turns_sha256": self.all.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars}


def read_back(segments: DataFrame) -> DataFrame:
    """What the formatted conversations hold, a row for each: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars. Reads segment text and mask only."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, now, done = None, None, []
        for b in batches:
            for key, conv, segment, start, end in zip(b["_key"], b["conv"], b["segment"], b["loss_start"], b["loss_end"], strict=True):
                if reader is None or key != now[0]:
                    if reader is not None:
                        done.append(reader.row(now[1]))
                    reader, now = Reader(), (key, conv)
                reader.feed(segment, (start, end))
            if done:
                yield pd.DataFrame(done)
                done = []
        if reader is not None:
            yield pd.DataFrame([reader.row(now[1])])

    kind = dict(segments.dtypes)["conv"]
    rows = segments.select(F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("null")).alias("_key"), "conv", "turn", "role", "segment", "loss_start", "loss_end")
    # ties go by the text that was escaped; it is made out of the segment where turns are compared, not moved beside it
    body = F.substring("segment", F.col("loss_start") + 1, F.length("segment") - F.col("loss_start") - (len(END) + 1))
    ordered = rows.repartition("_key").sortWithinPartitions("_key", "turn", "role", F.regexp_replace(body, r"\\([\\|])", "$1"))
    return ordered.select("_key", "conv", "segment", "loss_start", "loss_end").mapInPandas(
        fold, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
