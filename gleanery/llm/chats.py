"""Chat formatting: fingerprints of nested field paths select declarative mappings to canonical turns.

A record's fingerprint is a hash of the nested field paths it has (``messages[].role``), as far as some layout knows
them; other fields are metadata. A layout lists the paths that make it up and says, as data, where roles and texts are;
its fingerprints are those of its required paths with any of its optional ones. A typed table has the fingerprint of
its schema, a column of JSON has one for each record: prompt, instruction and message layouts may be mixed in one
column. Mapping and marking are column functions.

The template marks turns with control strings. One that stands in a text gets a backslash behind its first character,
one more if it has some; taking one away restores the text. No control string ends as another begins, so that none can
arise between a text and a mark.

What is formatted leaves as pieces of a conversation of about ``PIECE`` characters, cut between turns, each with the
spans that bear loss; pieces are read back in order with running digests. So a conversation of any length streams
through its task in bounded memory (its longest turn's), as a digest of the whole has to be made in order. Sorting
spills.

Defined cases: turns are ordered by turn (null first), role and text; rows that repeat are turns of their own; a null
text is empty, a null role is the empty role, rows of a null conversation id form one conversation; a record of no
known layout gives no turns and is told by ``unmapped``; a record without turns gives none; an empty table gives no
rows; columns of other names are not read, but a typed table that has the columns of two layouts is of neither.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from functools import partial
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.llm.common import bound_batches

PIECE = 500_000


@dataclass(frozen=True)
class Layout:
    """One way to hold a conversation.

    turns: role and the paths whose texts make a turn, joined by an empty line, for layouts of fixed roles.
    listed: array, role field and text field. row: role field and text field of a row that is one turn, and its order.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    listed: tuple[str, str, str] | None = None
    row: tuple[str, str, str] | None = None
    roles: dict[str, str] = field(default_factory=dict)

    @property
    def paths(self) -> tuple[str, ...]:
        return (*self.required, *self.optional)

    def path_sets(self):
        for n in range(len(self.optional) + 1):
            for some in combinations(self.optional, n):
                yield (*self.required, *some)


_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
LAYOUTS = (
    Layout("turn rows", ("turn", "role", "text"), row=("role", "text", "turn")),
    Layout("messages", ("messages",), ("messages[].role", "messages[].content"), listed=("messages", "role", "content")),
    Layout("from and value", ("conversations",), ("conversations[].from", "conversations[].value"), listed=("conversations", "from", "value"), roles=_NAMES),
    Layout("prompt and completion", ("prompt", "completion"), ("system",), turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("prompt and response", ("prompt", "response"), ("system",), turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Layout("instruction", ("instruction", "output"), ("input", "system"), turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Layout("question and answer", ("question", "answer"), ("context",), turns=(("user", ("context", "question")), ("assistant", ("answer",)))),
)

#: The template: how a turn of a role begins and ends; other roles are named between OTHER's first two marks.
MARKS = {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("", "</s>")}
OTHER = ("[ROLE]", "[/ROLE]", "[/TURN]")
LOSS_ROLE = "assistant"
CONTROLS = tuple(x for x in (*(y for pair in MARKS.values() for y in pair), *OTHER) if x)
_HEADS, _RESTS = "".join(sorted({re.escape(x[0]) for x in CONTROLS})), "|".join(re.escape(x[1:]) for x in CONTROLS)
#: Head, backslashes and rest of what would be read as a control string. Java and Python read it alike.
ESCAPED = rf"([{_HEADS}])(\\*)({_RESTS})"
assert not any(b.startswith(a[k:]) for a in CONTROLS for b in CONTROLS for k in range(1, len(a))), "a control string begins as another ends"


def fingerprint(paths: Column, layouts=LAYOUTS) -> Column:
    """A hash of those of the paths that some layout knows, in order."""
    paths_of = lambda x: {*x.paths, f"{x.listed[0]}[]"} if x.listed else set(x.paths)
    known = F.array(*[F.lit(p) for p in sorted(set().union(*map(paths_of, layouts)))])
    return F.xxhash64(F.array_join(F.array_sort(F.array_intersect(paths, known)), "\n"))


def layout_of(mark: Column, layouts=LAYOUTS) -> Column:
    """The layout whose fingerprint this is, or null."""
    entries = []
    for x in layouts:
        for paths in x.path_sets():
            entries += [fingerprint(F.array(*[F.lit(p) for p in paths]), layouts), F.lit(x.name)]
    return F.try_element_at(F.create_map(*entries), mark)


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a type; what an array holds is marked by [], and nothing follows if these are no structs."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in [f"{at}{f.name}", *schema_paths(f.dataType, f"{at}{f.name}.")]]
    if isinstance(kind, T.ArrayType):
        inner = f"{at.rstrip('.')}[]"
        return schema_paths(kind.elementType, f"{inner}.") if isinstance(kind.elementType, T.StructType) else [inner]
    return []


def json_paths(record: Column, layouts=LAYOUTS) -> Column:
    """Field paths of a JSON object: its keys, and those of the first element of each array that a layout lists.

    An array whose first element is no object has the path of its name and [].
    """
    none = F.array().cast("array<string>")
    paths = [F.coalesce(F.json_object_keys(record), none)]
    for name in sorted({x.listed[0] for x in layouts if x.listed}):
        first = F.get_json_object(record, f"$.{name}[0]")
        other = F.when(first.isNotNull(), F.array(F.lit(f"{name}[]")))
        paths.append(F.coalesce(_prefixed(F.json_object_keys(first), f"{name}[]."), other, none))
    return F.array_distinct(F.concat(*paths))


def _prefixed(keys: Column, prefix: str) -> Column:
    return F.transform(keys, lambda key: F.concat(F.lit(prefix), key))


def _record_type(layouts) -> T.StructType:
    """The schema that all layouts' paths are read with."""
    fields: dict[str, T.DataType] = {}
    for x in layouts:
        for p in (p for p in x.paths if "[]" not in p):
            fields.setdefault(p, T.StringType())
        if x.listed:
            fields[x.listed[0]] = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in x.listed[1:]]))
    return T.StructType([T.StructField(n, t) for n, t in sorted(fields.items())])


_TURN = "struct<role:string,text:string>"


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _renamed(role: Column, roles: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in roles.items() for x in pair]), F.lower(role)), role) if roles else role


def _turns(x: Layout, at) -> Column:
    """The turns of a record of this layout; at gives the column of a path."""
    if x.row:
        return F.array(_turn(at(x.row[0]).cast("string"), at(x.row[1]).cast("string")))
    if x.listed:
        name, role, text = x.listed
        return F.transform(at(name), lambda y: _turn(_renamed(y[role].cast("string"), x.roles), y[text].cast("string")))
    made = []
    for role, paths in x.turns:
        texts = F.array_compact(F.array(*[F.when(at(p) != "", at(p)) if p in x.optional else F.coalesce(at(p), F.lit("")) for p in paths]))
        made.append(F.when(F.size(texts) > 0, _turn(F.lit(role), F.array_join(texts, "\n\n"))))
    return F.array_compact(F.array(*made))


def _marked(rows: DataFrame, json_col: str | None, layouts) -> DataFrame:
    """rows with _mark (the fingerprint) and _layout."""
    paths = json_paths(F.col(json_col), layouts) if json_col else F.array(*[F.lit(p) for p in sorted(set(schema_paths(rows.schema)))])
    return rows.withColumn("_mark", fingerprint(paths, layouts)).withColumn("_layout", layout_of(F.col("_mark"), layouts))


def unmapped(rows: DataFrame, json_col: str | None = None, layouts=LAYOUTS) -> DataFrame:
    """The rows of no known layout, with their fingerprints."""
    return _marked(rows, json_col, layouts).filter("_layout IS NULL").drop("_layout").withColumnRenamed("_mark", "fingerprint")


def canonical_turns(rows: DataFrame, id_col: str = "conv_id", json_col: str | None = None, layouts=LAYOUTS) -> DataFrame:
    """conv_id, turn, role, text and layout of all turns. json_col: a column of JSON objects; otherwise the columns are the fields."""
    marked = _marked(rows, json_col, layouts)
    if json_col:
        marked = marked.select(id_col, "_layout", F.from_json(json_col, _record_type(layouts)).alias("_r"))
        known, at = set(schema_paths(_record_type(layouts))), lambda p: F.col(f"_r.`{p}`")
    else:
        known, at = set(schema_paths(rows.schema)), F.col
    turns = F.array().cast(f"array<{_TURN}>")
    order = F.lit(0).cast("long")
    for x in layouts:
        needed = {*x.required, *[f"{x.listed[0]}[].{n}" for n in x.listed[1:]]} if x.listed else set(x.required)
        if needed <= known and (not x.row or not json_col):
            own = F.col("_layout") == x.name
            # an optional path that a table lacks is absent from every record
            lacking = lambda p: at(p) if p in known else F.lit(None).cast("string")
            turns = F.when(own, _turns(x, lacking)).otherwise(turns)
            order = F.when(own, at(x.row[2]).cast("long")).otherwise(order) if x.row else order
    listed = marked.filter("_layout IS NOT NULL").select(F.col(id_col).alias("conv_id"), F.col("_layout").alias("layout"), order.alias("_at"), F.posexplode(turns).alias("_k", "_t"))
    return listed.select("conv_id", (F.col("_at") + F.col("_k")).alias("turn"), F.col("_t.role").alias("role"), F.col("_t.text").alias("text"), "layout")


def escape(text: Column) -> Column:
    """No control string remains in it."""
    return F.regexp_replace(text, ESCAPED, r"$1\\$2$3")


_UNESCAPE = re.compile(ESCAPED.replace(r"(\\*)", r"\\(\\*)"))


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def marked_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, head, body and tail of every turn, as the template writes it."""
    role, head, tail = F.col("role"), F.concat(F.lit(OTHER[0]), escape(F.col("role")), F.lit(OTHER[1])), F.lit(OTHER[2])
    for name, (begin, end) in MARKS.items():
        head, tail = F.when(role == name, F.lit(begin)).otherwise(head), F.when(role == name, F.lit(end)).otherwise(tail)
    return turns.select("conv_id", "turn", "role", head.alias("head"), escape(F.col("text")).alias("body"), tail.alias("tail"))


def format_chats(turns: DataFrame, most_chars: int = PIECE) -> DataFrame:
    """conv_id, piece (from 0), text and loss (start and length of each span that bears loss, in the piece) of every conversation.

    Pieces of a conversation lie together and in order.
    """
    bound_batches(turns.sparkSession)
    dealt = marked_turns(turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    dealt = dealt.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "body")
    kind = turns.schema["conv_id"].dataType.simpleString()
    return dealt.select("conv_id", "role", "head", "body", "tail").mapInArrow(partial(_pieces, most_chars), f"conv_id {kind}, piece int, text string, loss array<struct<start: int, length: int>>")


def _pieces(most_chars, batches):
    import pyarrow as pa

    now, piece, held, size, spans = object(), 0, [], 0, []
    span = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
    kind = None

    def batch_of(done):
        ids, numbers, texts, loss = zip(*done, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(numbers, pa.int32()), pa.array(texts, pa.string()), pa.array(loss, span)], names=["conv_id", "piece", "text", "loss"])

    done, pending = [], 0
    for batch in batches:
        kind = batch.column("conv_id").type
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "head", "body", "tail")]
        for conv, role, head, body, tail in zip(*columns, strict=True):
            if conv != now or size >= most_chars:
                if held:
                    done.append((now, piece, "".join(held), spans))
                    pending += size
                piece, held, size, spans, now = (piece + 1 if conv == now else 0), [], 0, [], conv
                if pending >= most_chars:
                    yield batch_of(done)
                    done, pending = [], 0
            if role == LOSS_ROLE and body:
                spans.append({"start": size + len(head), "length": len(body)})
            held += [head, body, tail]
            size += len(head) + len(body) + len(tail)
    if held:
        done.append((now, piece, "".join(held), spans))
    if done:
        yield batch_of(done)


_OPEN = {begin: (role, end) for role, (begin, end) in MARKS.items() if begin}
_BARE = next(((role, end) for role, (begin, end) in MARKS.items() if not begin), None)


def read_turns(text: str):
    """Role and text of each turn of a formatted text that holds whole turns."""
    at = 0
    while at < len(text):
        begin = next((x for x in (*_OPEN, OTHER[0]) if text.startswith(x, at)), "")
        at += len(begin)
        if begin == OTHER[0]:
            over = text.index(OTHER[1], at)
            role, end, at = unescape(text[at:over]), OTHER[2], over + len(OTHER[1])
        else:
            role, end = _OPEN.get(begin, _BARE)
        over = text.index(end, at)
        yield role, unescape(text[at:over])
        at = over + len(end)


def read_back(pieces: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, from texts and spans alone.

    Takes what ``format_chats`` returns as it lies; written pieces have to be dealt by conv_id and sorted by piece.
    """
    kind = pieces.schema["conv_id"].dataType.simpleString()
    return pieces.select("conv_id", "text", "loss").mapInArrow(_digests, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(batches):
    import pyarrow as pa

    now, told, kind = object(), None, None
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def row(conv, told):
        n, turns, chars, loss, formatted = told
        return conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted

    def batch_of(rows):
        kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    for batch in batches:
        kind, done = batch.column("conv_id").type, []
        for conv, text, spans in zip(batch.column("conv_id").to_pylist(), batch.column("text").to_pylist(), batch.column("loss").to_pylist(), strict=True):
            if conv != now:
                if told:
                    done.append(row(now, told))
                now, told = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, said in read_turns(text):
                told[0] += 1
                told[1].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            for s in spans:
                said = unescape(text[s["start"] : s["start"] + s["length"]])
                told[2] += len(said)
                told[3].update(said.encode("utf-8", "surrogatepass"))
            told[4] += len(text)
        if done:
            yield batch_of(done)
    if told:
        yield batch_of([row(now, told)])


_SQL_RESTS = "/?(?:INST|SYS|ROLE)\\]|/TURN\\]|/s>"
SQL = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, length(regexp_replace(text, '([\\[<])(\\\\*)({_SQL_RESTS})', '\\1\\\\\\2\\3', 'g')) + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 4
ELSE 20 + length(regexp_replace(role, '([\\[<])(\\\\*)({_SQL_RESTS})', '\\1\\\\\\2\\3', 'g')) END AS chars FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
sum(chars)::BIGINT AS formatted_chars FROM s GROUP BY 1"""
