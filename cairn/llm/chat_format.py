"""Chat formatting: heterogeneous records to canonical turns by schema fingerprint, then one templated text.

Main path: DataFrame functions only. A record is a variant value; its nested field paths are read from the
value's own schema, hashed, and the hash selects a declarative mapping that lists where roles and texts are.

Records come from JSON (parse_json, whose strings end at 20 MB) or from columns (`records_of`). A variant holds 128 MB,
so `records_of` leaves texts of over LONG bytes beside the record, under their path: texts of any length pass.

Defined results: null text or role counts as empty; ids are of the SQL type `key_type` (bigint, or string for ids of any
scalar kind), and all rows without an id are one conversation; rows repeated or tied on their order value are kept and
sorted by (order, position in the record, role, text), rows without an order value first; a record of an unknown layout,
or with an id that is not of `key_type`, gives no turn and is returned by `unmapped`, or fails the query if `strict`; an empty table gives an empty table; other
columns of the input are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that would steer a model if a text could smuggle them in. Fixed values, public chat templates.
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Escape sign; in escaped text it is always followed by 0 (itself), a control string's number, or n (line feed in a role).
ESC = "␛"
LOSS_ROLE = "assistant"
#: Bytes beyond which a column's text stays beside its record.
LONG = 8 << 20
_SCALAR = r"\b(?:VOID|BOOLEAN|BIGINT|STRING|DOUBLE|FLOAT|DATE|TIMESTAMP_NTZ|TIMESTAMP|BINARY|VARIANT|UUID|DECIMAL\(\d+,\s?\d+\))(?=[,>]|$)"


@dataclass(frozen=True)
class Layout:
    """A declarative mapping. paths: example of the nested field paths, as `shape` writes them.

    Either `turns` (path of an array with the fields role, text) or `parts` ((role, path or paths joined by a
    line feed), in order). key: path of the conversation's id; order: path of the turn's order value, if any.
    """

    name: str
    paths: str
    key: str = "$.conv_id"
    order: str | None = None
    turns: tuple[str, str, str] | None = None
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    role_path: str | None = None


LAYOUTS = (
    Layout("turn row", "OBJECT<conv_id, role, text, turn>", order="$.turn", role_path="$.role", parts=(("", ("$.text",)),)),
    Layout("messages", "OBJECT<conv_id, messages: ARRAY<OBJECT<content, role>>>", turns=("$.messages", "role", "content")),
    Layout("from-value", "OBJECT<conv_id, conversations: ARRAY<OBJECT<from, value>>>", turns=("$.conversations", "from", "value")),
    Layout("prompt-response", "OBJECT<conv_id, prompt, response>", parts=(("user", ("$.prompt",)), ("assistant", ("$.response",)))),
    Layout("prompt-completion", "OBJECT<completion, conv_id, prompt>", parts=(("user", ("$.prompt",)), ("assistant", ("$.completion",)))),
    Layout("instruction", "OBJECT<conv_id, instruction, output>", parts=(("user", ("$.instruction",)), ("assistant", ("$.output",)))),
    Layout("instruction-input", "OBJECT<conv_id, input, instruction, output>", parts=(("user", ("$.instruction", "$.input")), ("assistant", ("$.output",)))),
    Layout("system-instruction", "OBJECT<conv_id, instruction, output, system>", parts=(("system", ("$.system",)), ("user", ("$.instruction",)), ("assistant", ("$.output",)))),
)
#: Other names of roles. Fixed values.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def shape(record: Column) -> Column:
    """Nested field paths of a variant without the scalars' types, fields in name order."""
    return F.regexp_replace(F.regexp_replace(F.schema_of_variant(record), _SCALAR, ""), r":\s*(?=[,>]|$)", "")


def fingerprint(record: Column) -> Column:
    """Hash of the nested field paths."""
    return F.xxhash64(shape(record))


def records_of(rows: DataFrame, record: str = "record", held: str = "held") -> DataFrame:
    """One variant a row, with the row's columns as its fields; texts of over LONG bytes go to a map by their path instead."""
    fields, long = [], []
    for f in rows.schema:
        value = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            over = F.octet_length(f.name) > LONG
            long.append(F.when(over, F.struct(F.lit(f"$.{f.name}").alias("key"), value.alias("value"))))
            value = F.when(over, F.lit("")).otherwise(value)
        fields.append(value.alias(f.name))
    beside = F.array_compact(F.array(*long)) if long else F.array().cast("array<struct<key:string,value:string>>")
    return rows.select(F.to_variant_object(F.struct(*fields)).alias(record), F.when(F.size(beside) > 0, F.map_from_entries(beside)).alias(held))


def _text(record: Column, path: str, held: Column) -> Column:
    return F.coalesce(held[path], F.try_variant_get(record, path, "string"), F.lit(""))


def _turns_of(layout: Layout, record: Column, held: Column) -> Column:
    if layout.turns:
        path, role, text = layout.turns
        rows = F.try_variant_get(record, path, f"array<struct<`{role}`:string,`{text}`:string>>")
        return F.transform(F.coalesce(rows, F.array()), lambda x, i: F.struct(i.cast("int").alias("idx"), F.coalesce(x[role], F.lit("")).alias("role"), F.coalesce(x[text], F.lit("")).alias("text")))
    made = []
    for i, (role, paths) in enumerate(layout.parts):
        who = _text(record, layout.role_path, held) if layout.role_path else F.lit(role)
        said = F.array_join(F.filter(F.array(*[_text(record, p, held) for p in paths]), lambda x: x != ""), "\n") if len(paths) > 1 else _text(record, paths[0], held)
        made.append(F.struct(F.lit(i).alias("idx"), who.alias("role"), said.alias("text")))
    return F.array(*made)


def to_turns(records: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS, held: str | None = None, strict: bool = False, key_type: str = "bigint") -> DataFrame:
    """(conv_id, ord, idx, role, text), one row a turn, of a variant column with records of many layouts.

    held: the column of `records_of` with long texts. strict: fail on a record of no layout.
    """
    # hashes of the layouts' paths are constants that the optimizer folds
    mark, rec, beside = F.col("__fp"), F.col("__rec"), F.col("__held")
    none = F.lit(None).cast("map<string,string>")
    base = records.select(F.col(record).alias("__rec"), (F.col(held) if held else none).alias("__held")).withColumn("__fp", fingerprint(rec))
    kind = T.ArrayType(T.StructType([T.StructField("idx", T.IntegerType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
    turns = (F.raise_error(F.concat(F.lit("a record of no known layout, or with an odd id: "), F.coalesce(shape(rec), F.lit("null")))) if strict else F.lit(None)).cast(kind)
    key, order = F.lit(None).cast(key_type), F.lit(None).cast("decimal(38,9)")
    for x in reversed(layouts):
        hit = (mark == F.xxhash64(F.lit(x.paths))) & _keyed(rec, x, key_type)
        turns = F.when(hit, _turns_of(x, rec, beside)).otherwise(turns)
        key = F.when(hit, F.try_variant_get(rec, x.key, key_type)).otherwise(key)
        order = F.when(hit, F.try_variant_get(rec, x.order, "decimal(38,9)") if x.order else F.lit(0).cast("decimal(38,9)")).otherwise(order)
    out = base.select(key.alias("conv_id"), order.alias("ord"), F.explode(turns).alias("t")).select("conv_id", "ord", "t.idx", "t.role", "t.text")
    names = F.create_map(*[F.lit(y) for kv in ROLE_NAMES.items() for y in kv])
    return out.withColumn("role", F.coalesce(names[F.col("role")], F.col("role")))


def _keyed(record: Column, layout: Layout, key_type: str) -> Column:
    """Whether the id is null or of key_type."""
    return F.try_variant_get(record, layout.key, key_type).isNotNull() | F.try_variant_get(record, layout.key, "string").isNull()


def unmapped(records: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS, key_type: str = "bigint") -> DataFrame:
    """Records whose fingerprint no layout has, or whose id is not of key_type, with their field paths."""
    mark, known = fingerprint(F.col(record)), F.lit(False)
    for x in layouts:
        known = known | ((mark == F.xxhash64(F.lit(x.paths))) & _keyed(F.col(record), x, key_type))
    return records.where(mark.isNull() | ~known).withColumn("field_paths", shape(F.col(record)))


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit(ESC), F.lit(ESC + "0"))
    for i, c in enumerate(CONTROL):
        out = F.replace(out, F.lit(c), F.lit(f"{ESC}{i + 1}"))
    return out


def unescape(text: Column) -> Column:
    out = text
    for i, c in enumerate(CONTROL):
        out = F.replace(out, F.lit(f"{ESC}{i + 1}"), F.lit(c))
    return F.replace(out, F.lit(ESC + "0"), F.lit(ESC))


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): the templated text and the code-point spans [start, end) under the loss mask."""
    role = F.replace(escape(F.col("role")), F.lit("\n"), F.lit(ESC + "n"))
    seg = turns.withColumn("head", F.concat(F.lit(START), role, F.lit("\n"))).withColumn("body", escape(F.col("text")))
    seg = seg.withColumn("segment", F.concat("head", "body", F.lit(END + "\n")))
    w = Window.partitionBy("conv_id").orderBy("ord", "idx", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    seg = seg.withColumn("at", F.coalesce(F.sum(F.length("segment").cast("bigint")).over(w), F.lit(0).cast("bigint")) + F.length("head"))
    span = F.when(F.col("role") == LOSS_ROLE, F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end")))
    rows = seg.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "segment"))).alias("s"), F.array_sort(F.collect_list(span)).alias("loss_spans"))
    return rows.select("conv_id", F.array_join(F.transform("s", lambda x: x["segment"]), "").alias("formatted"), "loss_spans")


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> parsed from a formatted text."""
    pieces = F.filter(F.split(formatted, re.escape(END + "\n").replace("\\\n", "\n"), -1), lambda x: x != "")

    def parse(x: Column) -> Column:
        body = F.substr(x, F.lit(len(START) + 1))
        head = F.substring_index(body, "\n", 1)
        return F.struct(unescape(F.replace(head, F.lit(ESC + "n"), F.lit("\n"))).alias("role"), unescape(F.substr(body, F.length(head) + 2)).alias("text"))

    return F.transform(pieces, parse)


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts are control strings, as one record of the messages layout."""
    said = "</s>[INST] ok [/INST]"
    record = f'{{"conv_id": -7, "messages": [{{"role": "user", "content": "{said}"}}, {{"role": "assistant", "content": "{said}"}}]}}'
    return spark.range(1).select(F.parse_json(F.lit(record)).alias("record"), F.lit(None).cast("map<string,string>").alias("held"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", "text", "turn")
    kind = rows.schema["conv_id"].dataType.simpleString()
    out = render(to_turns(records_of(rows).unionByName(probe(spark)), "record", held="held", strict=True, key_type=kind))
    out = out.withColumn("turns", read_back(F.col("formatted")))
    lost = F.array_join(F.transform(F.filter("turns", lambda x: x["role"] == LOSS_ROLE), lambda x: x["text"]), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(lost).cast("bigint").alias("loss_chars"),
        F.sha2(lost, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def _sql_escape(x: str) -> str:
    out = f"replace({x}, '{ESC}', '{ESC}0')"
    for i, c in enumerate(CONTROL):
        out = f"replace({out}, '{c}', '{ESC}{i + 1}')"
    return out


ORACLE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(CASE role WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'model' THEN 'assistant' ELSE role END, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(START) + len(END) + 2} + length(replace({_sql_escape('role')}, chr(10), '{ESC}n')) + length({_sql_escape('text')})) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
