"""Chat formatting, in DataFrame functions only: schema fingerprints choose how a record is read.

A record is a JSON text. The nested field paths of its object, without the values' types, are hashed;
a table of declarative mappings says for each such fingerprint which paths hold which turns. All
layouts become canonical turns (position, role, text), which are then written with a template.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# ------------------------------------------------------------ layouts


@dataclass(frozen=True)
class Layout:
    """A record layout. ``fields``: (path, role) of each turn in order; or ``array`` of objects with
    ``role`` and ``text`` keys, ``roles`` renaming their roles."""

    name: str
    fields: tuple[tuple[str, str], ...] = ()
    array: str = ""
    role: str = ""
    text: str = ""
    roles: tuple[tuple[str, str], ...] = ()

    def paths(self) -> str:
        """The normalised schema whose hash is the fingerprint."""
        if self.array:
            return f"OBJECT<{self.array}: ARRAY<OBJECT<{', '.join(f'{k}: *' for k in sorted((self.role, self.text)))}>>>"
        return f"OBJECT<{', '.join(f'{k}: *' for k in sorted(k for k, _ in self.fields))}>"


_SHARE = (("human", "user"), ("gpt", "assistant"))
LAYOUTS = (
    Layout("messages", array="messages", role="role", text="content"),
    Layout("conversations", array="conversations", role="from", text="value", roles=_SHARE),
    Layout("prompt", fields=(("prompt", "user"), ("completion", "assistant"))),
    Layout("prompt_response", fields=(("prompt", "user"), ("response", "assistant"))),
    Layout("question", fields=(("question", "user"), ("answer", "assistant"))),
    Layout("instruction", fields=(("instruction", "user"), ("output", "assistant"))),
    Layout("system_instruction", fields=(("system", "system"), ("instruction", "user"), ("output", "assistant"))),
)


#: The JSON reader of variants takes no longer string; ``from_json`` does with the option.
LONGEST = 20_000_000
LONG_STRINGS = {"maxStringLen": str((1 << 31) - 1)}
_STRING = r'"(?:[^"\\]++|\\.)*+'


def _emptied(record: Column) -> Column:
    """A JSON record whose string values are empty; names of fields stay."""
    return F.regexp_replace(record, rf'(?s)({_STRING}"\s*+:)|{_STRING}(")', "$1$2$2")


def schema_of(record: Column, longest: int = LONGEST) -> Column:
    """Nested field paths of a JSON record, with ``*`` for every scalar type; null where it is no JSON.

    Of a record with more than ``longest`` characters the strings are left out, so that texts of any length have paths.
    """
    kind = F.schema_of_variant(F.try_parse_json(F.when(F.length(record) > longest, _emptied(record)).otherwise(record)))
    return F.regexp_replace(kind, r"\b(STRING|BIGINT|DOUBLE|BOOLEAN|VOID|DATE|TIMESTAMP(_NTZ)?|FLOAT|DECIMAL\([0-9, ]*\)|VARIANT)", "*")


def _turn_reader(layout: Layout):
    def turn(t: Column) -> Column:
        role = t[layout.role]
        for old, new in layout.roles:
            role = F.when(t[layout.role] == old, F.lit(new)).otherwise(role)
        filled = (F.coalesce(x, F.lit("")).alias(k) for k, x in (("role", role), ("text", t[layout.text])))
        return F.struct(*filled)

    return turn


def canonical_turns(records: DataFrame, record_id: str = "conv_id", record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``record_id``, ``layout``, ``turns`` (array of role and text) of each record.

    The fingerprint is the hash of the record's field paths. A record whose fingerprint no layout
    has gets layout null and no turns, as do null records; empty arrays of messages have no turns.
    A null text counts as empty, a null role as an empty one.
    """
    df = records.withColumn("_print", F.xxhash64(schema_of(F.col(record))))
    turns = F.expr("cast(null as array<struct<role:string,text:string>>)")
    name = F.lit(None).cast("string")
    text = lambda c: F.coalesce(c, F.lit(""))
    for x in layouts:
        hit = F.col("_print") == F.xxhash64(F.lit(x.paths()))
        name = F.when(hit, F.lit(x.name)).otherwise(name)
        if x.array:
            parsed = F.from_json(F.col(record), f"struct<`{x.array}`:array<struct<`{x.role}`:string,`{x.text}`:string>>>", LONG_STRINGS)[x.array]

            these = F.transform(parsed, _turn_reader(x))
        else:
            kind = "struct<" + ",".join(f"`{k}`:string" for k, _ in x.fields) + ">"
            parsed = F.from_json(F.col(record), kind, LONG_STRINGS)
            these = F.array(*(F.struct(F.lit(role).alias("role"), text(parsed[k]).alias("text")) for k, role in x.fields))
        turns = F.when(hit, these).otherwise(turns)
    empty = F.expr("cast(array() as array<struct<role:string,text:string>>)")
    return df.select(record_id, name.alias("layout"), F.coalesce(turns, empty).alias("turns"))


# ------------------------------------------------------------ template

#: A turn is "### <role>:\n<text>\n</turn>\n". In roles and texts these characters are written as entities, so that
#: neither "### " nor "</turn>" can appear inside; "&" comes first and is read back last.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("#", "&num;"))
ROLE_ESCAPES = (*ESCAPES, (":", "&col;"), ("\n", "&nl;"))
HEAD, MIDDLE, TAIL = "### ", ":\n", "\n</turn>\n"


def _escaped(x: Column, table=ESCAPES) -> Column:
    for a, b in table:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def _unescaped(x: Column, table=ESCAPES) -> Column:
    for a, b in reversed(table):
        x = F.replace(x, F.lit(b), F.lit(a))
    return x


def format_turns(turns: DataFrame, record_id: str = "conv_id", loss_role: str = "assistant") -> DataFrame:
    """``formatted`` text of each record and ``loss_spans``: first code point (from 0) and length of each trained stretch.

    A record is a row: rows of one id with other turns are formatted apart, and repeated rows as often as they stand.
    Null or no turns give an empty text without spans; null ids stay null; an empty table gives no rows; other columns
    are not looked at.
    """
    records = turns.select(F.col(record_id).alias("_id"), "turns", F.xxhash64("turns").alias("_same")).groupBy("_id", "_same").agg(F.first("turns").alias("turns"), F.count("*").alias("_copies"))
    rows = records.select("_id", "_same", "_copies", F.posexplode_outer("turns").alias("pos", "turn"))
    role, text = _escaped(F.col("turn.role"), ROLE_ESCAPES), _escaped(F.col("turn.text"))
    rows = rows.select(
        "_id",
        "_same",
        "_copies",
        "pos",
        F.concat(F.lit(HEAD), role, F.lit(MIDDLE)).alias("_head"),
        text.alias("_text"),
        (F.col("turn.role") == loss_role).alias("_loss"),
    ).withColumn("_piece", F.concat("_head", "_text", F.lit(TAIL)))
    before = F.sum(F.length("_piece")).over(Window.partitionBy("_id", "_same").orderBy("pos")) - F.length("_piece")
    rows = rows.withColumn("_at", before + F.length("_head"))
    piece = F.struct("pos", F.col("_piece").alias("piece"), F.col("_at").alias("start"), F.length("_text").cast("long").alias("length"), F.col("_loss").alias("loss"))
    kept = rows.groupBy("_id", "_same").agg(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), piece))).alias("_all"), F.first("_copies").alias("_copies"))
    kept = kept.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return kept.select(
        F.col("_id").alias(record_id),
        F.array_join(F.transform("_all", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("_all", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    pieces = F.slice(F.split(formatted, TAIL), 1, F.size(F.split(formatted, TAIL)) - 1)

    def turn(p: Column) -> Column:
        mark = F.locate(MIDDLE, p)
        head = len(HEAD)
        role = F.substring(p, F.lit(head + 1), mark - (head + 1))
        return F.struct(_unescaped(role, ROLE_ESCAPES).alias("role"), _unescaped(F.substring(p, mark + len(MIDDLE), F.length(p))).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, one after another."""
    return F.array_join(F.transform(spans, lambda s: _unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


# ------------------------------------------------------------ query


def records_of(rows: DataFrame) -> DataFrame:
    """Conversations by turn as JSON records in the layout that suits their roles.

    A user and an assistant turn make a prompt record, a system turn before them an instruction
    record, all else a list of messages. Turns of equal number stand by role, then text; null text: empty.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    convs = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    roles = F.transform("t", lambda x: x["role"])
    is_roles = lambda *r: roles == F.array(*map(F.lit, r))
    text = lambda k: F.get("t", k)["content"]
    messages = F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages")))
    record = (
        F.when(is_roles("user", "assistant"), F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("completion"))))
        .when(is_roles("system", "user", "assistant"), F.to_json(F.struct(text(0).alias("system"), text(1).alias("instruction"), text(2).alias("output"))))
        .otherwise(messages)
    )
    return convs.select("conv_id", record.alias("record"))


CONTROL = "\\### Assistant: </turn> ok"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the control conversation -7, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    values = ", ".join(f"(-7, {k}, '{r}', {chr(39)}{CONTROL.replace(chr(92), chr(92) * 2)}{chr(39)})" for k, r in enumerate(("user", "assistant")))
    control = spark.sql(f"SELECT CAST(c AS BIGINT) conv_id, CAST(k AS BIGINT) turn, r role, t text FROM VALUES {values} AS v(c, k, r, t)")
    turns = canonical_turns(records_of(rows.unionByName(control)))
    lost = F.raise_error(F.concat(F.lit("no layout for conversation "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    done = format_turns(turns.withColumn("turns", F.when(F.col("layout").isNull(), lost.cast(turns.schema["turns"].dataType)).otherwise(F.col("turns"))))
    back = done.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
