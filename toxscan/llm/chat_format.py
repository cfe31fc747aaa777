"""Chat formatting: whole conversations by a compiled template, with the loss mask, and back.

Turns of a conversation are gathered by Spark (one group is one conversation, as one row is one
document) in the order of turn, then role, then text; each task compiles the template once and renders.
Control strings start with ``<|``. Inside a text, every ``<``, k backslashes, ``|`` gets one backslash
more, so no control string is left and the way back takes one off. A role is one line: backslashes
are doubled and a line break is written ``\\n``.

Edge cases: a null role or text is empty; a null turn comes first; rows that tie in turn are in order of
role and text; repeated rows are turns of their own; rows with a null conversation id form one
conversation with a null id; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from toxscan.llm.chat_template import compile_template
from toxscan.llm.common import python_ready

TEMPLATE = """{%- for m in messages -%}
<|im_start|>{{ m.role | line }}{{ '\\n' }}
{%- if m.role in trained %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif -%}
<|im_end|>{{ '\\n' }}
{%- endfor -%}"""

_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
_LINE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def line(text: str) -> str:
    return escape(text).replace("\\", "\\\\").replace("\n", "\\n")


def unline(text: str) -> str:
    return unescape(_LINE.sub(lambda m: "\n" if m[1] == "n" else m[1], text))


FILTERS = {"escape": escape, "line": line, "trim": str.strip}


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns (role, text) that a formatted conversation holds."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"not a turn at {at}: {formatted[at:at + 40]!r}")
        turns.append((unline(m[1]), unescape(m[2])))
        at = m.end()
    return turns


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def format_conversations(df: DataFrame, template: str = TEMPLATE, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation of ``conv_id``, ``turn``, ``role``, ``text``: ``conv_id``, ``formatted``,
    ``loss_spans`` (start and end in code points of ``formatted``, by place)."""
    python_ready(df.sparkSession)
    compile_template(template, FILTERS)  # an unsound template fails here, not in a task
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = df.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("messages"))
    schema = T.StructType([grouped.schema["conv_id"], T.StructField("formatted", T.StringType()),
                           T.StructField("loss_spans", SPANS)])

    def rendered(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        render, arrow = compile_template(template, FILTERS), to_arrow_schema(schema)
        for batch in batches:
            said = [render({"messages": m.as_py(), "trained": trained}) for m in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.text for x in said], pa.string()),
                 pa.array([[{"start": a, "end": b} for a, b in x.spans] for x in said], arrow.field(2).type)],
                names=arrow.names)

    return grouped.mapInArrow(rendered, schema)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say, read back from text and mask."""
    python_ready(formatted.sparkSession)
    schema = T.StructType([formatted.schema["conv_id"], T.StructField("n_turns", T.LongType()),
                           T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()),
                           T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())])

    def digests(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2)):
                text = text.as_py()
                turns = read_back(text)
                whole = hashlib.sha256()
                for role, said in turns:
                    whole.update(f"{role}\n{said}\n".encode())
                loss = "".join(unescape(text[s["start"]:s["end"]]) for s in spans.as_py())
                rows.append((len(turns), whole.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, t) for c, t in zip(columns, types)],
                                             names=schema.names)

    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(digests, schema)
