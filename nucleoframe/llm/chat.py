"""Chat formatting by schema fingerprints.

A record's fingerprint is a hash over its sorted nested field paths (list items as
`[]`, with `:object` or `:list` after a path that holds one without fields or items). It
selects a declarative mapping: that of the same paths, or else the one with most paths all
of which the record has, the first of several; what it has besides, also the fields of another
mapping, is left out. The mapping says which list to
walk or which fields to read, and how roles are named. The canonical turns are written
with a template whose control strings are escaped reversibly inside roles and texts; the
spans of assistant texts in the output are the loss mask.

Cases: a null or absent text or role counts as empty; a number or a truth value as its
JSON; a record that isn't JSON, is nested too deeply, has no mapping, has a list or an
object where the mapping wants a text, or half of a surrogate pair in a text, is kept with layout null, no turns and `error`; an
empty list gives an empty output; a null record has no error and no turns; repeated rows
give equal rows; very long texts are formatted whole; an empty table gives no rows; extra
columns are ignored. Turn rows without a conversation id can't be put together: each is a
conversation of its own, with a null id.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Sink, rows

OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
#: Characters that begin or end a control string; each gets a backslash inside texts.
SPECIAL = re.compile(r"[\\#<:]")
ESCAPED = re.compile(r"\\(.)", re.S)
#: A turn of the output: role and text hold no control character that isn't escaped.
TURN = re.compile(r"### ((?:[^\\#<:]|\\.)*): ((?:[^\\#<:]|\\.)*) </turn>\n", re.S)

#: Declarative mappings. `fields` lists the paths whose hash is the fingerprint; `walk`
#: names a list with its role and text fields, `take` lists (role, field) in order; texts in
#: `parts` are lists of objects with this field, which are joined.
MAPPINGS = (
    {"layout": "messages", "fields": ["messages[].content", "messages[].role"], "walk": ("messages", "role", "content")},
    {"layout": "conversations", "fields": ["conversations[].from", "conversations[].value"], "walk": ("conversations", "from", "value"), "roles": {"human": "user", "gpt": "assistant"}},
    {"layout": "parts", "fields": ["messages[].content[].text", "messages[].content[].type", "messages[].role"], "walk": ("messages", "role", "content"), "parts": "text"},
    {"layout": "prompt", "fields": ["completion", "prompt"], "take": (("user", "prompt"), ("assistant", "completion"))},
    {"layout": "instruction", "fields": ["input", "instruction", "output"], "take": (("system", "instruction"), ("user", "input"), ("assistant", "output"))},
    {"layout": "task", "fields": ["instruction", "output"], "take": (("user", "instruction"), ("assistant", "output"))},
    {"layout": "question", "fields": ["answer", "question"], "take": (("user", "question"), ("assistant", "answer"))},
    {"layout": "empty", "fields": ["messages[]"], "walk": ("messages", "role", "content")},
)


class Unmapped(ValueError):
    """A record that can't be turned into turns; says why."""


def paths(value) -> set[str]:
    """The nested field paths of a parsed record."""
    found, open_values = set(), [("", value)]
    while open_values:
        at, v = open_values.pop()
        if isinstance(v, dict) and v:
            open_values += [(f"{at}.{k}" if at else k, x) for k, x in v.items()]
        elif isinstance(v, list) and v:
            open_values += [(f"{at}[]", x) for x in v]
        else:
            found.add(f"{at}:object" if isinstance(v, dict) else f"{at}[]" if isinstance(v, list) else at)
    return found


def fingerprint(found) -> str:
    return hashlib.sha1("\n".join(sorted(found)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


BY_FINGERPRINT = {fingerprint(m["fields"]): m for m in MAPPINGS}


def mapping_of(mark: str, found: set[str]) -> dict:
    """The mapping of a fingerprint, or the one with most paths that the record has."""
    known = BY_FINGERPRINT.get(mark)
    if known is None:
        known = max((m for m in MAPPINGS if found.issuperset(m["fields"])), key=lambda m: len(m["fields"]), default=None)
    if known is None:
        raise Unmapped("no mapping has these fields")
    return known


def text_of(value, at: str, part: str | None = None) -> str:
    """A text; null and absent ones are empty, numbers and truth values their JSON."""
    if value is None or isinstance(value, str):
        return value or ""
    if part is not None and isinstance(value, list) and all(isinstance(x, dict) for x in value):
        return "".join(text_of(x.get(part), f"{at}[].{part}") for x in value)
    if isinstance(value, (list, dict)):
        raise Unmapped(f"{at} is no text")
    return json.dumps(value)


def turns_of(record: dict, mapping: dict) -> list[tuple[str, str]]:
    if "take" in mapping:
        return [(role, text_of(record.get(field), field)) for role, field in mapping["take"]]
    roles, (field, role, text) = mapping.get("roles", {}), mapping["walk"]
    out, items = [], record.get(field)
    if not isinstance(items, list):
        raise Unmapped(f"{field} is no list")
    for i, item in enumerate(items):
        if not isinstance(item, dict):
            raise Unmapped(f"{field}[{i}] is no object")
        named = text_of(item.get(role), f"{field}[{i}].{role}")
        out.append((roles.get(named, named), text_of(item.get(text), f"{field}[{i}].{text}", mapping.get("parts"))))
    return out


def read_record(raw: str) -> tuple[str | None, dict | None, list[tuple[str, str]], str | None]:
    """Fingerprint, mapping, turns and error of a JSON record."""
    try:
        record = json.loads(raw)
    except ValueError:
        return None, None, [], "not JSON"
    except RecursionError:
        return None, None, [], "nested too deeply"
    found = paths(record)
    mark = fingerprint(found)
    try:
        mapping = mapping_of(mark, found)
        turns = turns_of(record, mapping)
        "".join(x for turn in turns for x in turn).encode()
        return mark, mapping, turns, None
    except UnicodeEncodeError:
        return mark, None, [], "half of a surrogate pair"
    except Unmapped as e:
        return mark, None, [], str(e)


def escape(text: str) -> str:
    return SPECIAL.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def format_turns(turns, learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted text, and the loss mask as (start, end) in code points."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{OPEN}{escape(role)}{MIDDLE}", escape(text)
        if role == learn:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, CLOSE)
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), spans


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Reads the turns back; what isn't a sequence of whole turns raises."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


FORMATTED = "conv_id long, fingerprint string, layout string, formatted string, loss_spans array<struct<start:long,stop:long>>, error string"


def format_chats(df: DataFrame, id_col: str = "conv_id", record_col: str = "record") -> DataFrame:
    """Formats JSON records of any mapped layout: one row per input row, with columns of
    FORMATTED. A record that can't be mapped has layout null, and `error` says why."""

    def run(batches):
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        kinds = {"conv_id": pa.int64(), "fingerprint": pa.string(), "layout": pa.string(), "formatted": pa.string(), "loss_spans": span, "error": pa.string()}
        sink = Sink(pa.schema(list(kinds.items())))
        for key, raw in rows(batches):
            mark, mapping, turns, error = (None, None, [], None) if raw is None else read_record(raw)
            text, spans = format_turns(turns)
            sink.add(key, mark, mapping and mapping["layout"], text, [{"start": a, "stop": b} for a, b in spans], error, weight=len(text))
            if sink.full():
                yield sink.take()
        yield sink.take()

    return df.select(F.col(id_col).cast("long").alias("conv_id"), F.col(record_col).cast("string").alias("record")).mapInArrow(run, FORMATTED)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, layout string"


def read_chats(df: DataFrame) -> DataFrame:
    """Digests of formatted chats, read back from the output alone."""

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        sink = Sink(pa.schema([(f.split()[0], k) for f, k in zip(READ.split(", "), kinds)]))
        for key, layout, text, spans in rows(batches):
            turns = parse_turns(text)
            digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass"))
            learned = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
            loss = hashlib.sha256(learned.encode("utf-8", "surrogatepass"))
            sink.add(key, len(turns), digest.hexdigest(), len(learned), loss.hexdigest(), len(text), layout)
            if sink.full():
                yield sink.take()
        yield sink.take()

    return df.select("conv_id", "layout", "formatted", "loss_spans").mapInArrow(run, READ)


def records_of(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Gathers turn rows into one JSON record per conversation, in the layout that its
    sequence of roles suggests: a prompt pair, an instruction triple, a list with the
    names human and gpt, or messages. Turns are ordered by turn, then role and text; rows
    without an id are conversations of one turn."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    item = F.struct(F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    placed = turns.select(F.col(id_col).cast("long").alias("conv_id"), item.alias("item"))
    gathered = placed.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("item")).alias("turns"))
    gathered = gathered.union(placed.where("conv_id is null").select("conv_id", F.array("item")))
    roles = F.array_join("turns.role", "\n")
    at = lambda i: F.col("turns")[i]["text"]

    def listed(field: str, role_name: str, text_name: str, names: dict[str, str]) -> Column:
        def one(t):
            named = t["role"]
            for old, new in names.items():
                named = F.when(t["role"] == old, new).otherwise(named)
            return F.struct(named.alias(role_name), t["text"].alias(text_name))

        return F.to_json(F.struct(F.transform("turns", one).alias(field)))

    known = F.forall("turns.role", lambda r: r.isin("system", "user", "assistant"))
    record = (
        F.when(roles == "user\nassistant", F.to_json(F.struct(at(0).alias("prompt"), at(1).alias("completion"))))
        .when(roles == "system\nuser\nassistant", F.to_json(F.struct(at(0).alias("instruction"), at(1).alias("input"), at(2).alias("output"))))
        .when(known & (F.size("turns") > 4), listed("conversations", "from", "value", {"user": "human", "assistant": "gpt"}))
        .otherwise(listed("messages", "role", "content", {}))
    )
    return gathered.select("conv_id", record.alias("record"))
