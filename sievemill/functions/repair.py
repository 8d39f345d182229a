r"""Repair of model output: JSON objects out of nearly valid text, and keys held to a closed set.

Text that is JSON is parsed by Spark alone; only the rest meets the tolerant reader, on Arrow
batches. Keys are repaired once each, in a table of the distinct ones, however many rows have them;
payloads are maps of JSON texts that built-in functions rewrite, with a log of what was done.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut, spread

SPACE, CLOSERS, QUOTES = " \t\r\n", ",}]:", "\"'“”"
WORDS = {"true": True, "false": False, "null": None, "True": True, "False": False, "None": None}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def literal(w: str) -> object:
    """The constant or finite number that a word is, else the word itself."""
    if w in WORDS:
        return WORDS[w]
    try:
        number = json.loads(w)
    except ValueError:
        return w
    return number if isinstance(number, (int, float)) and number == number and abs(number) != float("inf") else w


class Reader:
    """One pass over nearly valid JSON with a stack of open containers; values that a text holds one after another are all returned.

    What it puts up with: code fences and words around the JSON, missing and surplus commas, single
    and curly quotes, bare keys and words, quotes and line breaks within strings, containers and
    strings that are never closed (a key without a value is null), closers that were never opened.
    """

    def __init__(self, text: str) -> None:
        self.s, self.i = "\n".join(x for x in text.splitlines() if not x.strip().startswith("```")), 0

    def peek(self) -> str:
        """The next character that is no space, or nothing at the end."""
        while self.i < len(self.s) and self.s[self.i] in SPACE:
            self.i += 1
        return self.s[self.i : self.i + 1]

    def string(self, key: bool, listed: bool = False) -> str:
        """A quoted string; its end is a quote that a closer, another string's quote or the end follows."""
        quote, out = self.s[self.i], []
        ends = "”" if quote == "“" else quote
        self.i += 1
        while self.i < len(self.s):
            c = self.s[self.i]
            self.i += 1
            if c == "\\" and self.i < len(self.s):
                c = self.s[self.i]
                self.i += 1
                if c == "u":
                    try:
                        out.append(chr(int(self.s[self.i : self.i + 4], 16)))
                        self.i += 4
                    except ValueError:
                        out.append("u")
                else:
                    out.append(ESCAPES.get(c, c))
            elif c in ends:
                back = self.i
                then = self.peek()
                ended = not then or then in (":,}" if key else CLOSERS) or (not key and then == quote and (listed or self.is_key()))
                self.i = back
                if ended:
                    break
                out.append(c)
            else:
                out.append(c)
        # two escapes may stand for one character beyond 16 bits
        return "".join(out).encode("utf-16", "surrogatepass").decode("utf-16", "replace")

    def is_key(self) -> bool:
        """Whether the quoted text that begins here is followed by a colon."""
        end = self.s.find(self.s[self.i], self.i + 1)
        return end > 0 and self.s[end + 1 :].lstrip(SPACE)[:1] == ":"

    def word(self, stops: str) -> object:
        start = self.i
        while self.i < len(self.s) and self.s[self.i] not in stops:
            self.i += 1
        first, _, rest = self.s[start : self.i].strip(SPACE).partition(" ")
        value = literal(first)
        if rest.lstrip(SPACE)[:1] in tuple(QUOTES) and value is not first:
            # a number or constant and, without a comma, a string
            self.i = start + len(first)
            return value
        return value if not rest else self.s[start : self.i].strip(SPACE)

    def values(self) -> list:
        """The objects and lists of the text, in order."""
        done: list = []
        stack: list = []  # open containers
        keys: list = []  # the pending key of each, or None

        def put(v: object) -> None:
            if not stack:
                done.append(v)
            elif isinstance(stack[-1], dict):
                stack[-1][keys[-1]], keys[-1] = v, None
            else:
                stack[-1].append(v)

        def close() -> None:
            v, k = stack.pop(), keys.pop()
            if k is not None:
                v[k] = None
            put(v)

        while c := self.peek():
            if not stack and c not in "{[":
                # words before, between and after the values
                self.i += 1
            elif c in "{[":
                if stack and isinstance(stack[-1], dict) and keys[-1] is None:
                    keys[-1] = ""
                stack.append({} if c == "{" else [])
                keys.append(None)
                self.i += 1
            elif c in "}]":
                # closers end the nearest container of their kind; one without is passed over
                kind = dict if c == "}" else list
                while any(isinstance(x, kind) for x in stack):
                    last = isinstance(stack[-1], kind)
                    close()
                    if last:
                        break
                self.i += 1
            elif c in ",:":
                if c == "," and isinstance(stack[-1], dict) and keys[-1] is not None:
                    put(None)
                self.i += 1
            elif isinstance(stack[-1], dict) and keys[-1] is None:
                if c in QUOTES:
                    keys[-1] = self.string(True)
                else:
                    start = self.i
                    self.word(":,}]\n")
                    keys[-1] = self.s[start : self.i].strip(SPACE)
                if self.peek() == ":":
                    self.i += 1
                elif self.peek() in ("}", ""):
                    keys[-1] = None if keys[-1] == "" else keys[-1]
            else:
                put(self.string(False, isinstance(stack[-1], list)) if c in QUOTES else self.word(",}]\n"))
        while stack:
            close()
        return [v for v in done if isinstance(v, (dict, list))]


def repaired(text: str) -> tuple[str | None, bool]:
    """The JSON text of the object in a nearly valid text (None: there is none), and whether several were merged into it."""
    found = Reader(text).values()
    if len(found) == 1 and isinstance(found[0], list):
        found = found[0]
        merged = True
    else:
        merged = len(found) > 1
    if not found or not all(isinstance(v, dict) for v in found):
        return None, False
    out: dict = {}
    for v in found:
        out.update(v)
    return json.dumps(out, ensure_ascii=False), merged


def with_object(df: DataFrame, text: str, name: str = "payload") -> DataFrame:
    """df with name (the JSON text of an object, null: there is none), name_repaired and name_merged.

    A text that is a JSON object stays as it is. A list of objects, or several, are merged from left to right.
    """

    @F.pandas_udf("struct<json:string,merged:boolean>")
    def tolerant(text: pd.Series) -> pd.DataFrame:
        rows = [repaired(t) if t is not None else (None, False) for t in text]
        return pd.DataFrame(rows, columns=["json", "merged"])

    t = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(SPACE))
    # the parser does not look at what follows a value; nothing that may follow one in a list may follow one in an object
    whole = [F.try_parse_json(F.concat(F.lit(a), t, F.lit(b))).isNotNull() for a, b in (("[", "]"), ('{"x":', "}"))]
    intact = t.startswith("{") & whole[0] & whole[1]
    # intact texts are not sent to Python
    rows = df.withColumn("_fixed", tolerant(F.when(intact, F.lit(None)).otherwise(t)))
    out = F.when(intact, t).otherwise(F.col("_fixed.json"))
    return rows.withColumns({name: out, f"{name}_repaired": ~intact & out.isNotNull(), f"{name}_merged": F.coalesce(F.col("_fixed.merged"), F.lit(False))}).drop("_fixed")


def ratio(a: str, b: str) -> float:
    """Twice the length of all matching blocks over the length of both."""
    return SequenceMatcher(None, b, a).ratio()


def closest_key(key: str, allowed: Sequence[str], prefixes: Sequence[tuple[str, str, str]] = (), cutoff: float = 0.86) -> str | None:
    """The allowed key that key stands for: itself without marks around it, else the first that it holds, else by
    prefixes (start, end, target), else the one with the highest ratio of at least cutoff."""
    bare = key.strip("[]`'\" .")
    if bare in allowed:
        return bare
    for k in allowed:
        if k in bare:
            return k
    for start, end, target in prefixes:
        if bare.startswith(start) and bare.endswith(end):
            return target
    best = max(((ratio(bare, k), k) for k in allowed), default=(0.0, None))
    return best[1] if best[0] >= cutoff else None


def key_table(df: DataFrame, keys: str, allowed: Sequence[str], prefixes: Sequence[tuple[str, str, str]] = (), cutoff: float = 0.86) -> DataFrame:
    """key, target of the distinct keys (of an array column) that are not allowed but stand for one that is."""
    names, ends = sorted(allowed), list(prefixes)

    @F.pandas_udf("string")
    def target(key: pd.Series) -> pd.Series:
        return key.map(lambda k: closest_key(k, names, ends, cutoff))

    distinct = df.select(F.explode(keys).alias("key")).distinct().where(~F.col("key").isin(names))
    return distinct.withColumn("target", target("key")).where("target is not null")


def entries_of(payload: Column) -> Column:
    """The members of a JSON object's text as an array of (key, value: JSON text), in order; a string's value keeps its quotes."""
    members = F.try_variant_get(F.try_parse_json(payload), F.lit("$"), "map<string,variant>")
    # the text is parsed once, not once for each key
    return F.element_at(F.transform(F.array(members), lambda m: F.transform(F.json_object_keys(payload), lambda k: F.struct(k.alias("key"), F.to_json(m[k]).alias("value")))), 1)


def repaired_keys(df: DataFrame, id: str, payload: str, allowed: Sequence[str], prefixes: Sequence[tuple[str, str, str]] = (), cutoff: float = 0.86) -> DataFrame:
    """df with entries (key, value) of its payload, keys repaired, and actions: a line a repaired key, in order.

    A key is repaired unless its target is there already: as a key of its own or from a key before it;
    of keys with one target the first counts. A repaired member goes to the end. id tells rows apart.
    The parsed rows are written once, since each of the ways they are read would parse them again.
    """
    rows = cut(df.withColumn("_entries", F.coalesce(entries_of(F.col(payload)), F.array().cast("array<struct<key:string,value:string>>"))))
    keys = F.transform("_entries", lambda e: e["key"])
    table = key_table(rows.select(keys.alias("_keys")), "_keys", allowed, prefixes, cutoff)
    wanted = rows.select(id, F.posexplode(keys).alias("at", "key")).join(table, "key")
    own = rows.select(id, keys.alias("_keys"))
    # of the keys that stand for one target, the first; a target that is a key already takes none
    first = wanted.groupBy(id, "target").agg(F.min(F.struct("at", "key")).alias("first")).join(own, id)
    moves = first.where(~F.array_contains("_keys", F.col("target"))).groupBy(id).agg(F.array_sort(F.collect_list(F.struct("first.at", "first.key", "target"))).alias("_moves"))
    out = rows.join(moves, id, "left").withColumn("_moves", F.coalesce("_moves", F.array().cast("array<struct<at:int,key:string,target:string>>")))
    stay = F.filter("_entries", lambda e: ~F.exists("_moves", lambda m: m["key"] == e["key"]))
    moved = F.transform("_moves", lambda m: F.struct(m["target"].alias("key"), F.element_at("_entries", m["at"] + 1)["value"].alias("value")))
    actions = F.transform("_moves", lambda m: F.concat(F.lit("schema_key_typo: "), m["key"], F.lit(" -> "), m["target"]))
    return out.withColumns({"entries": F.concat(stay, moved), "actions": actions}).drop("_entries", "_moves")


def dropped(rows: DataFrame, names: Sequence[str], action: str) -> DataFrame:
    """Members with these names leave entries; a line an absent-minded member in actions, in the order of names."""
    gone = F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.exists("entries", lambda e: e["key"] == n))
    lines = F.transform(gone, lambda n: F.concat(F.lit(action), n))
    return rows.withColumns({"actions": F.concat("actions", lines), "entries": F.filter("entries", lambda e: ~e["key"].isin(list(names)))})


def folded(rows: DataFrame, allowed: Sequence[str], into: str, prefix: str) -> DataFrame:
    """Members that are not allowed are folded into the text member ``into``: as a JSON object of the non-empty ones, sorted by key.

    Text that is there stays before it, after it follows "Additional structured notes: " on a line of its own.
    """
    extra = F.filter("entries", lambda e: ~e["key"].isin(list(allowed)))
    full = F.array_sort(F.filter(extra, lambda e: ~e["value"].isin("null", '""', "[]", "{}")))
    note = F.concat(F.lit("{"), F.array_join(F.transform(full, lambda e: F.concat(quoted(e["key"]), F.lit(": "), e["value"])), ", "), F.lit("}"))
    old = F.get(F.filter("entries", lambda e: e["key"] == into), 0)["value"]
    text = F.when(old.startswith('"'), F.try_variant_get(F.try_parse_json(old), F.lit("$"), "string"))
    new = F.when(F.btrim(text, F.lit(SPACE)) != "", F.concat(text, F.lit("\nAdditional structured notes: "), note)).otherwise(note)
    rows = rows.withColumns({"_extra": extra, "_full": full, "_new": new})
    line = F.when(F.size("_extra") == 0, F.array().cast("array<string>")).when(F.size("_full") == 0, F.array(F.lit(f"{prefix}_extra_fields_removed"))).otherwise(F.array(F.lit(f"{prefix}_extra_fields_folded_into_{into}")))
    member = F.array(F.struct(F.lit(into).alias("key"), quoted(F.col("_new")).alias("value")))
    kept = F.filter("entries", lambda e: e["key"].isin(list(allowed)))
    there = F.exists("entries", lambda e: e["key"] == into)
    placed = F.when(F.size("_full") == 0, kept).when(there, F.transform(kept, lambda e: F.when(e["key"] == into, F.element_at(member, 1)).otherwise(e))).otherwise(F.concat(kept, member))
    return rows.withColumns({"actions": F.concat("actions", line), "entries": placed}).drop("_extra", "_full", "_new")


def filled(rows: DataFrame, name: str, text: str, action: str, given: str) -> DataFrame:
    """A missing member becomes a text where the member ``given`` is there."""
    has = lambda n: F.exists("entries", lambda e: e["key"] == n)
    lacks = has(given) & ~has(name)
    one = F.array(F.struct(F.lit(name).alias("key"), quoted(F.lit(text)).alias("value")))
    return rows.withColumn("_lacks", lacks).withColumns({"entries": F.when(F.col("_lacks"), F.concat("entries", one)).otherwise(F.col("entries")), "actions": F.when(F.col("_lacks"), F.array_append("actions", action)).otherwise(F.col("actions"))}).drop("_lacks")


def quoted(c: Column) -> Column:
    """A string as JSON text."""
    return F.regexp_extract(F.to_json(F.struct(F.coalesce(c, F.lit("")).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


# fixed values: the members of a direct answer, schema words that models repeat, and the texts and log lines of repairs
ANSWER = ("final_decision", "final_rationale")
SCHEMA_WORDS = ("$schema", "title", "type", "additionalProperties", "required", "properties")
ID_PREFIXES = (("op", "_fact_ids", "opposing_fact_ids"), ("sup", "_fact_ids", "supporting_fact_ids"))
NO_RATIONALE = "No rationale supplied."


def normalised_answers(df: DataFrame, id: str, payload: str) -> DataFrame:
    """df with entries and actions of its direct answers: schema words dropped where an answer is there, keys repaired,
    the obsolete member task_answer dropped, a missing rationale filled, and what is left folded into the rationale."""
    rows = spread(df, id).withColumn("_object", F.when(F.btrim(F.col(payload), F.lit(SPACE)).startswith("{"), F.col(payload)))
    has_answer = lambda e: e["key"].isin(list(ANSWER))
    first = rows.withColumn("entries", entries_of(F.col("_object"))).withColumn("actions", F.array().cast("array<string>"))
    answered = F.exists("entries", has_answer)
    gone = F.filter(F.array(*[F.lit(n) for n in SCHEMA_WORDS]), lambda n: F.exists("entries", lambda e: e["key"] == n) & answered)
    first = first.withColumn("_gone", gone).withColumn("entries", F.filter("entries", lambda e: ~F.array_contains("_gone", e["key"])))
    first = first.withColumn("_before", F.transform("_gone", lambda n: F.concat(F.lit("schema_metadata_removed: "), n)))
    first = first.withColumn("_object", written(F.col("entries"))).drop("entries", "actions", "_gone")
    out = repaired_keys(first, id, "_object", ANSWER, ID_PREFIXES)
    out = out.withColumn("actions", F.concat("_before", "actions")).drop("_before", "_object")
    lines = F.when(F.exists("entries", lambda e: e["key"] == "task_answer"), F.array(F.lit("obsolete_task_answer_removed"))).otherwise(F.array().cast("array<string>"))
    out = out.withColumns({"actions": F.concat("actions", lines), "entries": F.filter("entries", lambda e: e["key"] != "task_answer")})
    out = filled(out, "final_rationale", NO_RATIONALE, "missing_final_rationale_filled", "final_decision")
    whole = out.withColumn("_decided", F.exists("entries", lambda e: e["key"] == "final_decision")).withColumns({"_entries": F.col("entries"), "_actions": F.col("actions")})
    done = folded(whole, ANSWER, "final_rationale", "direct")
    keep = lambda c: F.when(F.col("_decided"), F.col(c)).otherwise(F.col(f"_{c}")).alias(c)
    names = [c for c in done.columns if c not in ("entries", "actions", "_decided", "_entries", "_actions")]
    return done.select(*names, keep("entries"), keep("actions"))


def written(entries: Column) -> Column:
    """The JSON text of entries."""
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(": "), e["value"])), ", "), F.lit("}"))
