"""Chat formatting: tool calls linked to their results and written as canonical JSON.

Calls and results are hash-joined on (conversation, call id).  Calls that need
other calls' results are put in topological order: a level is one more than the
highest level among the calls it needs.  Chains of calls with one need each
are shortened by pointer doubling (rounds: the logarithm of their length);
calls with several needs are then put in order, conversation by
conversation where one has at most ``MOST_ROWS`` calls and needs left, else by peeling off, round by round, those whose
needs are met.  The arguments are parsed and validated against the tool's schema, and each call is
written as one line of canonical JSON (sorted keys, no spaces, UTF-8).

Scale.  All steps are joins and aggregates on (conversation, call id); no
conversation is gathered in one place beyond ``MOST_ROWS`` rows, so one that holds a third of all calls
is spread like any other.  The lines of a conversation are in order by
(level, position, call_id).  The schemas (a table of tools) are the only thing
shipped to the tasks, checked against ``MOST_SCHEMA_BYTES``.

Defined cases: a call without a result has status "no_result", a result
without a call "orphan" (no level, no validation); repeated calls of one id
count once (the first position, then the smallest text, stays; ``copies``
tells how many there were), and so do results; a need that names no call of
the conversation is an error of that call and is otherwise ignored; calls on or behind a
circle of needs have status "circular" and no level; arguments that are no
JSON object (see ``_parse`` for what is refused), or an unknown tool, are invalid; a null conversation or call id
is a key like any other.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash

MOST_SCHEMA_BYTES = 8 << 20
MOST_DIGITS = 4000
DEEPEST = 200
MOST_ROWS = 1 << 17   # calls and needs of one conversation that are put in order in one task
_TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list}
KEY = ("conv_id", "call_id")


def canonical(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def _is(value: object, kind: str) -> bool:
    """Whether a JSON value is of a schema's type; a type that schemas don't have fits no value."""
    if kind == "null":
        return value is None
    if kind == "integer" and isinstance(value, float):
        return value.is_integer()
    return isinstance(value, _TYPES.get(kind, ())) and (kind == "boolean" or not isinstance(value, bool))


def _equal(a: object, b: object) -> bool:
    """Equality of JSON values: true is not 1, but 1.0 is."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(_equal, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(_equal(a[k], b[k]) for k in a)
    return a == b


def schema_errors(value: object, schema: dict, at: str = "$") -> list[str]:
    """What is wrong with a JSON value by a schema (type, enum, bounds, required, properties, items).

    A type may be a list of types.  A value nested deeper than Python recurses never gets here (see ``_parse``).
    """
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    found = []
    if "enum" in schema and not any(_equal(value, e) for e in schema["enum"]):
        found.append(f"{at}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        found += [f"{at}: below minimum"] * ("minimum" in schema and value < schema["minimum"])
        found += [f"{at}: above maximum"] * ("maximum" in schema and value > schema["maximum"])
    if isinstance(value, dict):
        own = schema.get("properties", {})
        found += [f"{at}: lacks {k}" for k in sorted(schema.get("required", ())) if k not in value]
        for k in sorted(value):
            if k in own:
                found += schema_errors(value[k], own[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{at}: unknown {k}")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += schema_errors(x, schema["items"], f"{at}[{i}]")
    return found


def _parse(text: str | None) -> object:
    """The JSON value of a text, None where it is none that can be written again.

    Refused: NaN and infinities (also as numbers too large for a double), whole numbers of
    over ``MOST_DIGITS`` digits, strings with half a surrogate pair, nesting over ``DEEPEST`` levels.
    """
    def refuse(name: str) -> None:
        raise ValueError(name)

    def finite(number: str) -> float:
        value = float(number)
        return value if math.isfinite(value) else refuse(number)

    def whole(number: str) -> int:
        return int(number) if len(number) <= MOST_DIGITS else refuse(number)

    try:
        value = json.loads(text or "", parse_constant=refuse, parse_float=finite, parse_int=whole)
        if _depth(value) > DEEPEST:
            return None
        canonical(value).encode()
        return value
    except (ValueError, RecursionError):   # UnicodeEncodeError is a ValueError
        return None


def _depth(value: object) -> int:
    """Levels of nesting, counted up to just over ``DEEPEST``."""
    level, depth = [value], 0
    while level and depth <= DEEPEST:
        level = [x for v in level if isinstance(v, (list, dict)) for x in (v.values() if isinstance(v, dict) else v)]
        depth += 1
    return depth


def call_line(call_id: str | None, name: str | None, arguments: str | None, result: str | None, needs: list[str],
              unknown: list[str], schemas: dict[str, dict]) -> tuple[bool, str, str]:
    """(valid, errors, canonical line) of a call."""
    value = _parse(arguments)
    if not isinstance(value, dict):
        errors = ["$: not a JSON object"]
    elif name not in schemas:
        errors = ["unknown tool"]
    else:
        errors = schema_errors(value, schemas[name])
    errors += [f"needs unknown {n}" for n in sorted(unknown)]
    line = {"id": call_id, "name": name, "arguments": value if isinstance(value, dict) else arguments,
            "needs": sorted(needs), "result": result}
    return not errors, "; ".join(errors), canonical(line)


def levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the calls that are on or behind no circle of needs.

    ``needs`` (conv_id, call_id, need) names calls in ``calls`` only.
    """
    needs = stash(needs.distinct())
    nodes = calls.select(*KEY).distinct()
    counted = needs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min("need").alias("need"))
    one = F.coalesce(F.col("n") == 1, F.lit(False))
    # Each call points along its chain; the ends of chains (no need, or several) point to themselves.
    paths = stash(_joined(nodes, counted, "left").select(
        *KEY, F.when(one, F.col("need")).otherwise(F.col("call_id")).alias("to"), one.cast("long").alias("steps"),
        (~one).alias("ends")))
    paths = paths.select(*KEY, "to", "steps", F.col("ends").alias("at_end"))
    open_, before = _open(paths), None
    while open_ and open_ != before:
        ahead = paths.select("conv_id", F.col("call_id").alias("via"), F.col("to").alias("far"),
                             F.col("steps").alias("more"), F.col("at_end").alias("far_end"))
        a, b = paths.alias("a"), ahead.alias("b")
        same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & F.col("a.to").eqNullSafe(F.col("b.via"))
        paths = stash(a.join(b, same).select(
            "a.conv_id", "a.call_id", F.when(F.col("a.at_end"), F.col("a.to")).otherwise(F.col("b.far")).alias("to"),
            (F.col("a.steps") + F.when(F.col("a.at_end"), 0).otherwise(F.col("b.more"))).alias("steps"),
            (F.col("a.at_end") | F.col("b.far_end")).alias("at_end")))
        before, open_ = open_, _open(paths)
    paths = paths.where("at_end")
    return _add_ends(paths, _end_levels(paths, needs, counted))


def _open(paths: DataFrame) -> int:
    return paths.where("NOT at_end").count()


def _add_ends(paths: DataFrame, ends: DataFrame) -> DataFrame:
    """Levels of all calls from the levels of the ends of their chains."""
    p, e = paths.alias("p"), ends.alias("e")
    same = F.col("p.conv_id").eqNullSafe(F.col("e.conv_id")) & F.col("p.to").eqNullSafe(F.col("e.call_id"))
    return p.join(e, same).select("p.conv_id", "p.call_id", (F.col("e.level") + F.col("p.steps")).cast("int").alias("level"))


def _end_levels(paths: DataFrame, needs: DataFrame, counted: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of the chain ends: 0 without needs, else by peeling off those with several."""
    several = counted.where("n > 1").select(*KEY)
    ends = paths.where("steps = 0").select(*KEY)
    done = stash(_without(ends, several).withColumn("level", F.lit(0).cast("long")))
    wanted = _joined(needs, several, "left_semi").alias("w")
    p = paths.alias("p")
    same = F.col("w.conv_id").eqNullSafe(F.col("p.conv_id")) & F.col("w.need").eqNullSafe(F.col("p.call_id"))
    # Needs on a circle have no path: the call that has them waits for ever.
    pending = stash(wanted.join(p, same, "left").select(
        "w.conv_id", "w.call_id", F.col("p.to").alias("to"), F.col("p.steps").alias("steps"),
        F.col("p.call_id").isNull().alias("lost")))
    # Conversations of bounded size are put in order in one go; larger ones are peeled off in rounds.
    rows = (done.withColumns({"to": F.lit(None).cast("string"), "steps": F.lit(None).cast("long"), "lost": F.lit(False)})
            .unionByName(pending.withColumn("level", F.lit(None).cast("long"))))
    size = (rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("level").isNull()).alias("open"))
            .where("open > 0"))
    small = (_among(rows, size.where(F.col("n") <= MOST_ROWS)).groupBy("conv_id")
             .applyInPandas(_ordered, "conv_id long, call_id string, level long"))
    pending = stash(_among(pending, size.where(F.col("n") > MOST_ROWS)))
    done = stash(done.union(small))
    while not pending.isEmpty():
        d, q = done.alias("d"), pending.alias("q")
        same = F.col("q.conv_id").eqNullSafe(F.col("d.conv_id")) & F.col("q.to").eqNullSafe(F.col("d.call_id"))
        known = q.join(d, same, "left").groupBy("q.conv_id", "q.call_id").agg(
            F.count(F.lit(1)).alias("n"), F.count(F.when(~F.col("q.lost"), F.col("d.level"))).alias("met"),
            (F.max(F.col("d.level") + F.col("q.steps")) + 1).alias("level"))
        new = stash(known.where("n = met").select(*KEY, "level"))
        if new.isEmpty():
            break
        done = stash(done.union(new))
        pending = stash(_without(pending, new))
    return done


def _among(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """The rows of the given conversations (nulls are equal)."""
    r, n = rows.alias("r"), conversations.alias("n")
    return r.join(n, F.col("r.conv_id").eqNullSafe(F.col("n.conv_id")), "left_semi")


def _ordered(rows: pd.DataFrame) -> pd.DataFrame:
    """Levels of one conversation's calls with several needs, by taking off those whose needs are met."""
    known = rows["level"].notna()
    level = dict(zip(rows.loc[known, "call_id"], rows.loc[known, "level"].astype(int)))
    start = set(level)
    open_: dict[str | None, int] = {}
    behind: dict[str | None, list[tuple[str | None, int]]] = {}
    for call, to, steps, lost in rows.loc[~known, ["call_id", "to", "steps", "lost"]].itertuples(index=False):
        open_[call] = open_.get(call, 0) + 1
        if not lost:
            behind.setdefault(to, []).append((call, int(steps)))
    most: dict[str | None, int] = {}
    ready = [c for c in behind if c in level]
    while ready:
        done = ready.pop()
        for call, steps in behind.get(done, ()):
            most[call] = max(most.get(call, 0), level[done] + steps + 1)
            open_[call] -= 1
            if not open_[call]:
                level[call] = most[call]
                ready.append(call)
    new = [(c, n) for c, n in level.items() if c not in start]
    # Typed, since an empty list would make a column of floats, which Spark does not take for text.
    return pd.DataFrame({"conv_id": rows["conv_id"].iloc[:1].repeat(len(new)).reset_index(drop=True),
                         "call_id": pd.Series([c for c, _ in new], dtype=object),
                         "level": pd.Series([n for _, n in new], dtype="int64")})


def _without(rows: DataFrame, other: DataFrame, name: str = "call_id") -> DataFrame:
    """Rows whose (conv_id, name) is not among ``other``'s (nulls are equal)."""
    a, b = rows.alias("a"), other.alias("b")
    same = F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & F.col(f"a.{name}").eqNullSafe(F.col(f"b.{name}"))
    return a.join(b, same, "left_anti")


def _joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """``left`` with the other columns of ``right`` on (conv_id, call_id), nulls equal."""
    r = right.withColumnsRenamed({k: f"__{k}" for k in KEY})
    same = F.col("conv_id").eqNullSafe(F.col("__conv_id")) & F.col("call_id").eqNullSafe(F.col("__call_id"))
    return left.join(r, same, how)


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row per call and per orphan result, with its place in the order and its canonical line.

    ``calls``: conv_id, call_id, position, name, arguments (JSON text), needs
    (array of call ids); ``results``: conv_id, call_id, position, content.
    """
    if len(canonical(schemas)) > MOST_SCHEMA_BYTES:
        raise ValueError("the schemas are too large to ship to every task")
    first = F.min(F.struct("position", "name", "arguments", "needs")).alias("first")
    calls = stash(calls.groupBy(*KEY).agg(first, F.count(F.lit(1)).alias("copies")).select(*KEY, "first.*", "copies"))
    results = (results.groupBy(*KEY).agg(F.min(F.struct("position", "content")).alias("first"))
               .select(*KEY, F.col("first.content").alias("content"), F.lit(True).alias("answered")))
    wanted = calls.select(*KEY, F.explode(F.array_distinct("needs")).alias("need"))
    ids = calls.select("conv_id", F.col("call_id").alias("need"))
    dangling = _without(wanted, ids, "need")
    missing = dangling.groupBy(*KEY).agg(F.array_sort(F.collect_set("need")).alias("unknown"))
    known = wanted.alias("w").join(ids.alias("i"), F.col("w.conv_id").eqNullSafe(F.col("i.conv_id"))
                                   & F.col("w.need").eqNullSafe(F.col("i.need")), "left_semi")
    order = stash(levels(calls, known))
    both = _joined(calls, results, "left").drop("__conv_id", "__call_id")
    both = _joined(both, order, "left").drop("__conv_id", "__call_id")
    both = _joined(both, missing, "left").drop("__conv_id", "__call_id")
    status = (F.when(F.col("level").isNull(), "circular").when(F.col("answered"), "linked").otherwise("no_result"))
    linked = both.withColumn("status", status)
    orphans = (_without(results, calls.select(*KEY))
               .select(*KEY, F.lit(None).cast("long").alias("position"), F.lit(None).cast("string").alias("name"),
                       F.lit(None).cast("string").alias("arguments"), F.array().cast("array<string>").alias("needs"),
                       F.lit(0).cast("long").alias("copies"), "content", F.lit(None).cast("int").alias("level"),
                       F.array().cast("array<string>").alias("unknown"), F.lit("orphan").alias("status")))
    rows = linked.select(*orphans.columns).union(orphans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for r in batch.to_pylist():
                if r["status"] == "orphan":
                    lines.append((None, "", canonical({"id": r["call_id"], "result": r["content"]})))
                else:
                    lines.append(call_line(r["call_id"], r["name"], r["arguments"], r["content"], r["needs"] or [],
                                           r["unknown"] or [], schemas))
            kept = ["conv_id", "call_id", "level", "position", "copies", "status"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array([x[0] for x in lines], pa.bool_()),
                 *(pa.array([x[i] for x in lines], pa.string()) for i in (1, 2))],
                names=[*kept, "valid", "errors", "line"])

    return rows.mapInArrow(run, "conv_id long, call_id string, level int, position long, copies long, status string, "
                                "valid boolean, errors string, line string")


# Tools of the registered query.
TOOLS = {
    name: {"type": "object", "required": ["query", "words"], "additionalProperties": False,
           "properties": {"query": {"type": "string"}, "words": {"type": "integer", "minimum": 4}}}
    for name in ("search", "summarise", "translate")
}


def from_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read off plain conversations.

    A user turn calls a tool with its whole text and needs the call two turns
    before; the assistant's next turn is the result of that call.  Every third
    text length names a tool.
    """
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                             "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    tool = F.element_at(F.array(*[F.lit(t) for t in TOOLS]), F.pmod(F.length("text"), F.lit(len(TOOLS))) + 1)
    needs = F.when(F.col("turn") >= 2, F.array(F.concat(F.lit("call-"), F.col("turn") - 2))).otherwise(
        F.array().cast("array<string>"))
    calls = c.where("role = 'user'").select(
        "conv_id", F.concat(F.lit("call-"), "turn").alias("call_id"), F.col("turn").alias("position"),
        tool.alias("name"), F.to_json(F.struct(F.col("text").alias("query"), words.alias("words"))).alias("arguments"),
        needs.alias("needs"))
    results = c.where("role = 'assistant'").select(
        "conv_id", F.concat(F.lit("call-"), F.col("turn") - 1).alias("call_id"), F.col("turn").alias("position"),
        F.col("text").alias("content"))
    return calls, results


def conversation_calls(conversations: DataFrame) -> DataFrame:
    """``link_calls`` over the calls and results of the conversations."""
    return link_calls(*from_conversations(conversations), TOOLS)
