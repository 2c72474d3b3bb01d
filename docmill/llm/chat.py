"""Chat formatting with offset-aligned loss masks (operator 2).

A conversation is rendered as `<|turn|>role`, a newline, its text, `<|end|>` and a
newline per turn. Control strings inside roles and texts are escaped reversibly: every
backslash is doubled, then a backslash is put behind the first character of each control
string. The rendered text is encoded once, with offsets; token spans and turn spans are
both sorted, so the tokens of each assistant turn are found by binary search and clipped
to the turn.

Rows are brought together by conversation and sorted by turn in the shuffle; a task walks
through them one conversation at a time. Rendering goes block by block where a
conversation is very long: a block ends behind a turn's last newline, where no token of
this tokenizer can run on, so ids, offsets and masks are those of encoding it whole, and
memory stays bounded by BLOCK and the longest turn.

Cases: a null text or role is empty. Rows of one turn go by role and text; a null turn
comes first. A null conv_id is one conversation of its own. Repeated rows are repeated
turns. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.common import column, partitions
from docmill.session import table

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: Strings that must not appear in a rendered text: our own marks and those of other templates. Fixed values.
CONTROL = ("<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Characters of whole turns that are rendered and encoded at once.
BLOCK = 1 << 20
LOSS_ROLE = "assistant"

_MARK = re.compile("(?=" + "|".join(map(re.escape, CONTROL)) + ")(.)", re.DOTALL)


def escape(text: str) -> str:
    return _MARK.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: m[1], text, flags=re.DOTALL) if "\\" in text else text


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int, bool]]]:
    """The text and, per turn, the span of its escaped text and whether it carries loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{_role_out(role)}\n", escape(text)
        parts += [head, body, CLOSE]
        spans.append((at + len(head), at + len(head) + len(body), role == LOSS_ROLE))
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def _role_out(role: str) -> str:
    """A role on one line: backslash-n for a newline (a lone n never follows a single backslash otherwise)."""
    return escape(role).replace("\n", "\\n")


def _role_in(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)


_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE), re.DOTALL)


def parse(rendered: str) -> list[tuple[str, str]]:
    """The turns of a rendered text."""
    out, at = [], 0
    for m in _TURN.finditer(rendered):
        if m.start() != at:
            raise ValueError("text between turns")
        out.append((_role_in(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(rendered):
        raise ValueError("text behind the last turn")
    return out


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def mask(spans: list[tuple[int, int, bool]], starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Which tokens carry loss, and the character spans under the mask, clipped to the turns.

    starts and ends: the sorted offsets of the tokens.
    """
    on = np.zeros(len(starts), bool)
    under = []
    for a, b, loss in spans:
        if not loss or a == b:
            continue
        i, j = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(starts, b, "left"))
        if i < j:
            on[i:j] = True
            under.append((max(a, int(starts[i])), min(b, int(ends[j - 1]))))
    return on, under


FORMATTED = "conv_id {kind}, block int, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>, spans array<struct<a:int,b:int>>"


def format_chats(conversations: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Rows in order of blocks per conversation: text, ids, token offsets, loss mask and loss spans.

    A conversation of up to BLOCK characters is one block. Offsets count from the block.
    """
    path = tokenizer_path or default_tokenizer()
    spark = conversations.sparkSession
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def flush(todo: list[tuple], own) -> pa.RecordBatch:
        rendered = [render(turns) for _, _, turns in todo]
        out = {c: [] for c in ("ids", "starts", "ends", "loss", "spans")}
        for (text, spans), code in zip(rendered, own.encode_batch([x for x, _ in rendered], add_special_tokens=False), strict=True):
            at = np.array(code.offsets, np.int32).reshape(-1, 2)
            on, under = mask(spans, at[:, 0], at[:, 1])
            for c, v in zip(out, (code.ids, at[:, 0], at[:, 1], on, [{"a": a, "b": b} for a, b in under]), strict=True):
                out[c].append(v)
        i32 = pa.list_(pa.int32())
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in todo], pa.int64()), pa.array([x[1] for x in todo], pa.int32()), pa.array([x for x, _ in rendered]), pa.array(out["ids"], i32), pa.array(out["starts"], i32), pa.array(out["ends"], i32), pa.array(out["loss"], pa.list_(pa.bool_())), pa.array(out["spans"], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))],
            names=["conv_id", "block", "formatted", *out],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizer(path)
        todo: list[tuple] = []
        size, turns, length, block, now = 0, [], 0, 0, object()
        for batch in batches:
            for conv, role, text in zip(*(column(batch, c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if turns and (conv != now or length > BLOCK):
                    todo.append((now, block, turns))
                    size += length
                    turns, length, block = [], 0, block + 1
                if conv != now:
                    now, block = conv, 0
                turns.append((role, text))
                length += len(text) + len(role) + 20
                if size > BLOCK:
                    yield flush(todo, own)
                    todo, size = [], 0
        if turns:
            todo.append((now, block, turns))
        if todo:
            yield flush(todo, own)

    return dealt.select("conv_id", "role", "text").mapInArrow(run, FORMATTED.format(kind="long"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation: what its rendered text and its loss mask say, read back block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        done: list[tuple] = []

        def close() -> None:
            done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for batch in batches:
            cols = [column(batch, c) for c in ("conv_id", "block", "formatted", "starts", "ends", "loss", "spans")]
            for k in range(batch.num_rows):
                conv, block, text = (c[k].as_py() for c in cols[:3])
                if block == 0:
                    if state:
                        close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                # the characters under masked tokens, clipped to the turns that carry loss
                starts, ends, on = (c[k].values.to_numpy(zero_copy_only=False) for c in cols[3:6])
                for span in cols[6][k].as_py():
                    i, j = np.searchsorted(ends, span["a"], "right"), np.searchsorted(starts, span["b"], "left")
                    if not on[i:j].all():
                        raise ValueError("a loss span without its mask")
                    said = unescape(text[span["a"] : span["b"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            if len(done) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], kinds[i]) for i in range(6)], names=names)
                done = []
        if state:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], kinds[i]) for i in range(6)], names=names)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return digests(format_chats(own.unionByName(extra)))


OP2_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '<\|turn\|>|<\|end\|>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>', '\0\\', 'g')) AS n_text FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(8 + length(role) + 1 + n_text + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
