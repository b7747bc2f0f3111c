"""Chat formatting by schema fingerprint, built-in functions only.

The nested field paths that a record really has are hashed; the hash selects one
of the declarative mappings, which turn prompt, instruction and message layouts
into canonical turns (an array of role and text). Turns are then written with a
reversible template and a loss mask, and can be read back from the formatted text.

Template, a turn: ``### <role>: <text></turn>`` and a line break.
Inside texts ``\\`` becomes ``\\\\``, ``</turn>`` ``\\e`` and ``###`` ``\\h``; inside
roles also ``:`` becomes ``\\c``. No control string is left in a text.
"""

from __future__ import annotations

import hashlib
import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse.llm.common import table

OPEN, CLOSE = "### ", "</turn>\n"
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """One layout: the paths it must have, those it may have, and its turns in SQL."""

    name: str
    required: tuple[str, ...]
    turns: str
    optional: tuple[str, ...] = field(default=())

    def fingerprints(self) -> list[str]:
        chosen = itertools.chain.from_iterable(itertools.combinations(self.optional, n) for n in range(len(self.optional) + 1))
        return [fingerprint_of(self.required + extra) for extra in chosen]


def _turn(role: str, path: str) -> str:
    return f"named_struct('role', '{role}', 'text', {path})"


def _messages(array: str, role: str, text: str) -> str:
    return f"transform({array}, m -> named_struct('role', {role}, 'text', m.{text}))"


_SHARED_ROLES = "coalesce(map('human', 'user', 'gpt', 'assistant', 'bot', 'assistant')[m.from], m.from)"

#: Every layout that is understood. Add a row to support another one.
MAPPINGS = (
    Mapping("messages", ("messages[].content", "messages[].role"), _messages("messages", "m.role", "content")),
    Mapping("turn rows", ("rows[].role", "rows[].text", "rows[].turn"), _messages("rows", "m.role", "text")),
    Mapping("from and value", ("conversations[].from", "conversations[].value"), _messages("conversations", _SHARED_ROLES, "value")),
    Mapping("prompt and completion", ("prompt",), f"array({_turn('user', 'prompt')}, {_turn('assistant', 'completion')})", ("completion",)),
    Mapping("prompt and response", ("prompt", "response"), f"array({_turn('user', 'prompt')}, {_turn('assistant', 'response')})"),
    Mapping(
        "system prompt",
        ("prompt", "response", "system"),
        f"array({_turn('system', 'system')}, {_turn('user', 'prompt')}, {_turn('assistant', 'response')})",
    ),
    Mapping("instruction", ("instruction", "output"), f"array({_turn('user', 'instruction')}, {_turn('assistant', 'output')})"),
    Mapping(
        "instruction and input",
        ("input", "instruction", "output"),
        "array(named_struct('role', 'user', 'text', concat(instruction, '\\n\\n', input)), " + _turn("assistant", "output") + ")",
    ),
    Mapping("question and answer", ("answer", "question"), f"array({_turn('user', 'question')}, {_turn('assistant', 'answer')})"),
)


def fingerprint_of(paths: tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def _paths(kind: T.DataType, name: str) -> list[tuple[str, str]]:
    """(path, SQL that is true if a record has it) of all leaves below ``name``."""
    if isinstance(kind, T.StructType):
        return [(f"{name}.{f.name}", f"({name}.`{f.name}`) IS NOT NULL") for f in kind.fields]
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        # a list of objects has the fields its schema declares, even where single values are null
        return [(f"{name}[].{f.name}", f"`{name}` IS NOT NULL") for f in kind.elementType.fields]
    return [(name, f"`{name}` IS NOT NULL")]


def fingerprint(records: DataFrame, columns: list[str]) -> Column:
    """SHA-256 over the sorted nested field paths a record has."""
    leaves = sorted(p for c in columns for p in _paths(records.schema[c].dataType, c))
    present = F.array(*[F.when(F.expr(test), F.lit(path)) for path, test in leaves])
    return F.sha2(F.array_join(F.array_compact(present), "\n"), 256)


def canonical(records: DataFrame, columns: list[str], mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``records`` with ``layout`` (name of the mapping or null) and canonical ``turns`` (null if no mapping fits).

    ``columns`` are those that make up a record; others (keys, meta data) pass through.
    Null roles and texts become empty; an empty list of messages has no turns.
    """
    have = set(p for c in columns for p, _ in _paths(records.schema[c].dataType, c))
    usable = [m for m in mappings if set(m.required + m.optional) <= have]
    known = [x for m in usable for f in m.fingerprints() for x in (F.lit(f), F.lit(m.name))]
    layout = F.element_at(F.create_map(*known), F.col("_print")) if known else F.lit(None).cast("string")
    turns = F.lit(None).cast(TURNS)
    for m in usable:
        turns = F.when(F.col("layout") == m.name, F.expr(m.turns).cast(TURNS)).otherwise(turns)
    clean = F.transform(turns, lambda t: F.struct(F.coalesce(t.role, F.lit("")).alias("role"), F.coalesce(t.text, F.lit("")).alias("text")))
    return (
        records.withColumn("_print", fingerprint(records, columns)).withColumn("layout", layout).withColumn("turns", clean).drop("_print")
    )


def fold_rows(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Rows of single turns (key, turn, role, text) as records: key and ``rows``, ordered by turn, role, text.

    Rows with the same turn number all stay. A null key is a conversation of its own.
    """
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("rows"))


def _replaced(text: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


_TEXT = (("</turn>", "\\e"), ("###", "\\h"))
_ROLE = (*_TEXT, (":", "\\c"))


def escape(text: Column, pairs=_TEXT) -> Column:
    return _replaced(text, ("\\", "\\\\"), *pairs)


def unescape(text: Column, pairs=_TEXT) -> Column:
    """Undo ``escape``: pairs of backslashes are taken from the left, what lies between them has single codes."""
    pieces = F.transform(F.split(text, r"\\\\", -1), lambda p: _replaced(p, *[(new, old) for old, new in pairs]))
    return F.array_join(pieces, "\\")


def render(records: DataFrame) -> DataFrame:
    """``records`` with ``formatted`` and ``loss_spans``, (start, length) in code points of each assistant text."""
    lines = F.transform(
        "turns",
        lambda t: F.struct(
            (t.role == "assistant").alias("learn"),
            F.concat(F.lit(OPEN), escape(t.role, _ROLE), F.lit(": ")).alias("head"),
            escape(t.text).alias("body"),
        ),
    )
    spans = F.aggregate(
        "_lines",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["head"]) + F.length(x["body"]) + len(CLOSE)).alias("at"),
            F.when(
                x["learn"],
                F.concat(
                    acc["spans"],
                    F.array(F.struct((acc["at"] + F.length(x["head"])).alias("start"), F.length(x["body"]).cast("long").alias("length"))),
                ),
            )
            .otherwise(acc["spans"])
            .alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    formatted = F.array_join(F.transform("_lines", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "")
    return records.withColumn("_lines", lines).withColumn("formatted", formatted).withColumn("loss_spans", spans).drop("_lines")


def parse(records: DataFrame) -> DataFrame:
    """Turns and learnt text read back from ``formatted`` and ``loss_spans``: ``read_turns``, ``loss_text``."""
    blocks = F.expr(r"filter(split(formatted, '</turn>\n', -1), (b, i) -> i < size(split(formatted, '</turn>\n', -1)) - 1)")
    turns = F.transform(
        blocks,
        lambda b: F.struct(
            unescape(F.substring_index(F.substr(b, F.lit(len(OPEN) + 1)), ": ", 1), _ROLE).alias("role"),
            unescape(F.substr(b, F.instr(b, ": ") + 2)).alias("text"),
        ),
    )
    learnt = F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return records.withColumn("read_turns", turns).withColumn("loss_text", F.array_join(learnt, ""))


#: A conversation of control strings, added to the table by the query.
PROBE = "\\### Assistant: </turn> ok"


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the probe: formatted, read back, digested."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    done = parse(render(canonical(fold_rows(rows.unionByName(probe)), ["rows"])))
    digest = F.array_join(F.transform("read_turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("read_turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH c AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), d AS (
  SELECT conv_id, turn, role AS r, text AS x, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c
), e AS (
  SELECT *, 4 + length(replace(replace(replace(replace(role, '\', '\\'), '</turn>', '\e'), '###', '\h'), ':', '\c')) + 2
    + length(replace(replace(replace(text, '\', '\\'), '</turn>', '\e'), '###', '\h')) + 8 AS chars,
    CASE WHEN role = 'assistant' THEN text ELSE '' END AS learnt
  FROM d
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST)) AS turns_sha256,
  cast(sum(length(learnt)) AS bigint) AS loss_chars,
  sha256(string_agg(learnt, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, x NULLS FIRST)) AS loss_sha256,
  cast(sum(chars) AS bigint) AS formatted_chars
FROM e GROUP BY conv_id
"""
