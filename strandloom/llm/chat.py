"""Chat formatting: incremental black-box rendering.

A template is any function from a list of (role, text) turns to a string. Turns are located without
knowing how it works: prefixes of the conversation are rendered turn by turn and consecutive outputs
compared. As long as each output continues the one before, turn k owns what output k adds. Inside its
span, the text is what stands where an unused string (private-use characters, more in a row than the output has) shows
up when the turn is rendered with that as its text; what is around it is the template's. A template that changes what it wrote for earlier turns (``rewrites``) breaks
the first condition; then no span is trusted from there on and the row says so.

``marked`` is the template used by default: ``<|im_start|>role\\ntext<|im_end|>\\n``. Control strings of this
and other common templates are escaped inside roles and texts by a backslash after their first character
(a backslash itself is doubled), so that none is left to a tokenizer, and escaping can be undone.

A conversation becomes one string, so its turns meet in one row; different conversations never do. A row
holds less than 2 GB; rendering its prefixes takes time by the square of its turns.

Defined results: null texts and roles count as empty; very long texts are formatted whole; rows are ordered by
turn, null first, equal ones by role and text; a repeated row is a turn of its own; null conversation
ids form one conversation; an empty table gives no conversation; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]
BATCH_CHARS = 1 << 22  # of formatted text in one Arrow batch
START, END = "<|im_start|>", "<|im_end|>"
# Control strings that no text may carry unescaped (fixed values).
CONTROL = [START, END, "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<bos>", "<eos>", "<start_of_turn>", "<end_of_turn>"]
_SPECIAL = re.compile("|".join([r"\\", *(re.escape(c[0]) + "(?=" + re.escape(c[1:]) + ")" for c in CONTROL)]))

PRIVATE = "\ue000"
_ROLE = re.compile(r"(?:[^\\\n]|\\[\s\S])*")


def escape(text: str) -> str:
    """Doubles backslashes and puts one behind the first character of every control string."""
    return _SPECIAL.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    out, i = [], 0
    while (j := text.find("\\", i)) >= 0:
        out.append(text[i:j])
        if text[j + 1 : j + 2] == "\\":  # a doubled backslash; any other follows a control string's first character
            out.append("\\")
            j += 1
        i = j + 1
    out.append(text[i:])
    return "".join(out)


def marked(turns: Turns, escaped: Callable[[str], str] = escape) -> str:
    """A line break in a role gets a backslash before it."""
    named = [(escaped(role).replace("\n", "\\\n"), text) for role, text in turns]
    return "".join(f"{START}{role}\n{escaped(text)}{END}\n" for role, text in named)


def marking() -> Callable[[Turns], str]:
    """``marked`` for one conversation: what it has escaped is kept from one prefix to the next, and let go with it."""
    escaped = lru_cache(None)(escape)
    return lambda turns: marked(turns, escaped)


@dataclass
class Rendered:
    output: str
    spans: list[tuple[int, int]]  # of each turn
    text_spans: list[tuple[int, int]]  # of each turn's text, inside
    rewrites: bool


def _absent(text: str) -> str:
    """A string of private-use characters that is not in text: one more of them than its longest run."""
    return PRIVATE * (1 + max((len(m[0]) for m in re.finditer(f"{PRIVATE}+", text)), default=0))


def render(template: Callable[[Turns], str], turns: Turns) -> Rendered:
    """Renders successive prefixes and compares consecutive outputs."""
    before = template([])
    lead = before
    spans, inner = [], []
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        if not now.startswith(before):
            return Rendered(template(turns), spans, inner, True)
        probe = _absent(now)
        other = template([*turns[: k - 1], (turns[k - 1][0], probe)])
        own, shown = now[len(before) :], other[len(before) :]
        head, found, tail = shown.partition(probe)
        if not (other.startswith(before) and found and own.startswith(head) and own.endswith(tail) and len(own) >= len(head) + len(tail)):
            return Rendered(template(turns), spans, inner, True)
        spans.append((len(before), len(now)))
        inner.append((len(before) + len(head), len(now) - len(tail)))
        before = now
    return Rendered(before if turns else lead, spans, inner, False)


def read_marked(output: str) -> Turns:
    """The turns, parsed back from the output of ``marked``."""
    turns, at = [], 0
    while at < len(output):
        if not output.startswith(START, at):
            raise ValueError(f"no turn starts at {at}")
        stop = output.index(END + "\n", at)
        role = _ROLE.match(output, at + len(START), stop)[0]
        turns.append((unescape(role), unescape(output[at + len(START) + len(role) + 1 : stop])))
        at = stop + len(END) + 1
    return turns


FORMATTED = "conv_id bigint, n_turns bigint, formatted string, starts array<int>, ends array<int>, text_starts array<int>, text_ends array<int>, loss array<boolean>, rewrites boolean"


def format_chats(rows: DataFrame, template: Callable[[Turns], str] = marked, learn_from: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Per conversation: the formatted text, spans of turns and their texts in it (code points), and which texts bear loss."""
    turns = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    gathered = rows.select("conv_id", turns.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    gathered = gathered.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.list_(pa.int32())] * 4, pa.list_(pa.bool_()), pa.bool_()]
    names = [c.split()[0] for c in FORMATTED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells: list[tuple] = []
            size = 0
            for i in range(batch.num_rows):
                roles, texts = batch.column(1)[i].as_py(), batch.column(2)[i].as_py()
                out = render(marking() if template is marked else template, list(zip(roles, texts, strict=True)))
                starts, ends = [a for a, _ in out.spans], [b for _, b in out.spans]
                cells.append((batch.column(0)[i].as_py(), len(roles), out.output, starts, ends, [a for a, _ in out.text_spans], [b for _, b in out.text_spans], [r in learn_from for r in roles[: len(out.spans)]], out.rewrites))
                size += len(out.output)
                if size >= BATCH_CHARS or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*cells, strict=True), kinds, strict=True)], names)
                    cells, size = [], 0

    return gathered.mapInArrow(run, FORMATTED)


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, rewrites boolean"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted text holds: all turns, and all text under the loss mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for r in batch.to_pylist():
                turns = read_marked(r["formatted"])
                all_turns = hashlib.sha256()
                for role, text in turns:
                    all_turns.update(f"{role}\n{text}\n".encode())
                learned = [unescape(r["formatted"][a:b]) for a, b, on in zip(r["text_starts"], r["text_ends"], r["loss"], strict=True) if on]
                loss = hashlib.sha256("".join(learned).encode()).hexdigest()
                cells.append((r["conv_id"], len(turns), all_turns.hexdigest(), sum(map(len, learned)), loss, len(r["formatted"]), r["rewrites"]))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            columns = list(zip(*cells, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in DIGESTS.split(", ")])

    return formatted.mapInArrow(run, DIGESTS)


PROBE = "</s>[INST] ok [/INST]"


def op9_incremental_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one whose texts are control strings, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(format_chats(rows.unionByName(probe)))
