"""Conversation structure repair: the cheapest edits that make a conversation ``(s?(ua)+)?``, by a program over a trie.

A row becomes one sign of sixteen: its role's initial (s, u, a or another) and its first fault (none, blank, duplicate,
truncated). A conversation's signs in turn order are its signature, and the edits depend on nothing else. Different
signatures are sorted, so that neighbours share prefixes; the path of the current one in the prefix trie is a stack of
layers, a layer is computed once for each node of the trie, and a signature's answer is read off at its terminal node.

A layer has the least cost for each of four states (nothing yet, after system, after user, after assistant), and the order
of the states' cheapest edit strings. Inserted rows stand before the row that follows them, or at the end: two strings of
one layer then end with an edit of the same row, so neither begins the other, and their order holds whatever follows.
That is why the ASCII-least of equally cheap strings needs no strings in the layers. A layer without its least cost is one of
few, so the step from a layer by a sign is looked up once it has been made.

Rows take two ways: without texts (a digest in their place) for faults and signatures, and once with texts, sorted within
their conversation behind its edits, for what the edits make of them. Both read sorted rows one after the other. What a
task holds of a conversation is its edits, one character a row, as the contract's ``audit`` is one value; texts are hashed
as they pass. Duplicates are found by (conversation, role, digest), so a long conversation is spread there. Its
digest is one chain over all its rows in order, which nothing can split.

Defined results: a null role or text is one space; rows of a null conversation are one conversation; null turns come first
and count for no gap; rows of one turn stand in the order of role and then of their text's SHA-256, so repeated rows are
duplicates from the second on; an empty role or one of another initial fits nowhere; a conversation of no rows costs
nothing and has an empty audit; an empty table gives an empty one; texts are judged whole at any length; only the four
named columns and ``present`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, materialize, partitions

ROLES = "sua"  #: initials; any other is the fourth class
FAULTS = ("none", "blank", "duplicate", "truncated")
NONE, SYSTEM, USER, ASSISTANT = range(4)  #: what stands last
NEXT = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  #: what an inserted or recast row becomes
NAMES = {USER: "user", ASSISTANT: "assistant"}
BLANK = r"\A[\x20\x09-\x0D]*\z"
TRUNCATED = r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z"


@dataclass(frozen=True)
class Costs:
    recast: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3  #: of a truncated row that stays


def sign(role: int, fault: int) -> str:
    return chr(ord("A") + 4 * role + fault)


def moves(symbol: str, costs: Costs) -> dict[tuple[int, int], tuple[int, str]]:
    """The cheapest edits (cost, letters) by (state before, state after) of one row, rows inserted before it included."""
    role, fault = divmod(ord(symbol) - ord("A"), 4)
    best: dict[tuple[int, int], tuple[int, str]] = {}

    def offer(before: int, after: int, cost: int, letters: str) -> None:
        if (before, after) not in best or (cost, letters) < best[before, after]:
            best[before, after] = cost, letters

    for before in NEXT:
        state = before
        for n in range(3):  # a third inserted row leads where the first has led
            cost, letters = n * costs.insert, "I" * n
            offer(before, state, cost + costs.delete, letters + "D")
            if FAULTS[fault] not in ("blank", "duplicate"):
                stays = cost + costs.truncated * (FAULTS[fault] == "truncated")
                if role < 3 and (ROLES[role] == "s" and state == NONE or role + 1 == NEXT[state]):
                    offer(before, role + 1, stays, letters + "K")
                offer(before, NEXT[state], stays + costs.recast, letters + "R")
            state = NEXT[state]
    return best


Layer = tuple[tuple[int, int] | None, ...]  #: (cost over the layer's least, place in the order of strings) by state
FIRST: Layer = ((0, 0), None, None, None)
CLOSING = {NONE: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


class Trie:
    """The path of the current signature: layers from the root, each with its least cost and the steps that led to it."""

    def __init__(self, costs: Costs):
        self.costs = costs
        self.steps: dict[tuple[Layer, str], tuple[Layer, int, tuple]] = {}
        self.moves = {sign(r, f): moves(sign(r, f), costs) for r in range(4) for f in range(4)}
        self.path = ""
        self.layers: list[Layer] = [FIRST]
        self.least = [0]
        self.back: list[tuple] = [()]

    def step(self, layer: Layer, symbol: str) -> tuple[Layer, int, tuple]:
        """The next layer, what its least cost adds, and by state (state before, letters)."""
        found: dict[int, tuple[int, int, str, int]] = {}
        for (before, after), (cost, letters) in self.moves[symbol].items():
            if layer[before] is not None:
                offer = (layer[before][0] + cost, layer[before][1], letters, before)
                found[after] = min(found.get(after, offer), offer)
        least = min(f[0] for f in found.values())
        order = {s: i for i, s in enumerate(sorted(found, key=lambda s: found[s][1:3]))}
        made = tuple((found[s][0] - least, order[s]) if s in found else None for s in range(4))
        return made, least, tuple((found[s][3], found[s][2]) if s in found else None for s in range(4))

    def answer(self, signature: str) -> tuple[int, str]:
        """Cost and letters; signatures come in ascending order, else more layers are made again."""
        shared = 0
        for a, b in zip(self.path, signature, strict=False):
            if a != b:
                break
            shared += 1
        for kept in (self.layers, self.least, self.back):
            del kept[shared + 1 :]
        for symbol in signature[shared:]:
            key = (self.layers[-1], symbol)
            if key not in self.steps:
                self.steps[key] = self.step(*key)
            layer, plus, back = self.steps[key]
            self.layers.append(layer)
            self.least.append(self.least[-1] + plus)
            self.back.append(back)
        self.path = signature
        cost, _, closing, state = min((f[0] + self.costs.insert * len(CLOSING[s]), f[1], CLOSING[s], s) for s, f in enumerate(self.layers[-1]) if f is not None)
        letters = [closing]
        for back in reversed(self.back[1:]):
            state, own = back[state]
            letters.append(own)
        return self.least[-1] + cost, "".join(reversed(letters))


def figures(signature: str) -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows, and neighbours whose roles don't follow each other."""
    codes = [ord(c) - ord("A") for c in signature]
    faults = [c & 3 for c in codes]
    roles = [c >> 2 for c in codes]
    fit = {(0, 1), (1, 2), (2, 1)}
    return faults.count(1), faults.count(2), faults.count(3), sum(pair not in fit for pair in zip(roles, roles[1:], strict=False))


def batched(rows: Iterator[tuple], target: pa.Schema, most_rows: int = 4096, most_chars: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows, bounded by rows and by characters."""
    held: list[tuple] = []
    chars = 0
    for row in rows:
        held.append(row)
        chars += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= most_rows or chars >= most_chars:
            yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*held, strict=True), target, strict=True)], schema=target)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(zip(*held, strict=True), target, strict=True)], schema=target)


def mapped(df: DataFrame, fn: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """``fn`` from the rows of a partition, in order, to rows."""
    target = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (tuple(v.as_py() for v in row) for batch in batches for row in zip(*batch.columns, strict=True))
        return batched(fn(rows), target)

    return df.mapInArrow(run, schema)


def by_conversation(rows: Iterator[tuple]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """(id, its rows); ids stand first and together."""
    from itertools import groupby

    return groupby(rows, key=lambda r: r[0])


def signatures(rows: Iterator[tuple]) -> Iterator[tuple]:
    """From (id, turn, sign) in order, the sign empty for a row that only names its conversation: (id, gaps, signature)."""
    for key, own in by_conversation(rows):
        signs: list[str] = []
        first = last = None
        distinct = 0
        for _, turn, symbol in own:
            if not symbol:
                continue
            signs.append(symbol)
            if turn is not None and turn != last:
                first, last, distinct = (turn if first is None else first), turn, distinct + 1
        yield key, last - first + 1 - distinct if distinct else 0, "".join(signs)


def answers(rows: Iterator[tuple], costs: Costs) -> Iterator[tuple]:
    """From (signature,) in order: (signature, blank, duplicate, truncated, illegal, cost, audit)."""
    trie = Trie(costs)
    for (signature,) in rows:
        yield (signature, *figures(signature), *trie.answer(signature))


def edited(rows: Iterator[tuple]) -> Iterator[tuple]:
    """From (id, role, text) behind a row (id, null, audit): (id, edit, role, text) of each row that stays or comes in."""
    for key, own in by_conversation(rows):
        _, _, letters = next(own)
        state = NONE
        for letter in letters:
            if letter == "I":
                state = NEXT[state]
                yield key, letter, NAMES[state], ""
                continue
            _, role, text = next(own)
            if letter == "D":
                continue
            state = ROLES.index(role[0]) + 1 if letter == "K" else NEXT[state]
            yield key, letter, role if letter == "K" else NAMES[state], text


def digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(id, SHA-256 of ``role:text`` by line) of what :func:`edited` gives, hashed as it passes."""
    for key, own in by_conversation(rows):
        chain = hashlib.sha256()
        for i, (_, _, role, text) in enumerate(own):
            chain.update(f"{chr(10) if i else ''}{role}:{text}".encode())
        yield key, chain.hexdigest()


@dataclass(frozen=True)
class Repair:
    """What :func:`repair` gives: a row for each conversation, and the repaired rows, each conversation's in order in one
    partition."""

    conversations: DataFrame
    rows: DataFrame
    id_type: str


def ordered(df: DataFrame, *keys: str) -> DataFrame:
    """The rows of a conversation together and in order."""
    return df.repartition(partitions(df.sparkSession), "id").sortWithinPartitions("id", *(F.col(k).asc_nulls_first() for k in keys))


def repair(conversations: DataFrame, costs: Costs | None = None, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present_col: str | None = None) -> Repair:
    """Faults, cheapest edits and repaired rows.

    Where ``present_col`` is false, a row only tells that its conversation is there.
    """
    costs = costs or Costs()
    told = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    present = F.col(f"`{present_col}`") if present_col else F.lit(True)
    rows = conversations.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{turn_col}`").cast("bigint").alias("turn"), told(role_col).alias("role"), told(text_col).alias("text"), present.alias("present")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    kind = rows.schema["id"].dataType.simpleString()

    role = F.coalesce(*(F.when(F.substring("role", 1, 1) == c, i) for i, c in enumerate(ROLES)), F.lit(len(ROLES)))
    fault = F.when(F.col("text").rlike(BLANK), 1).when(F.col("text").rlike(TRUNCATED), 3).otherwise(0)
    light = rows.select("id", "turn", "role", "digest", "present", role.alias("class"), fault.alias("fault"))
    seen = F.row_number().over(Window.partitionBy("id", "role", "digest", "present").orderBy(F.col("turn").asc_nulls_first())) > 1
    symbol = F.char(F.lit(ord("A")) + 4 * F.col("class") + F.when((F.col("fault") != 1) & F.col("seen"), 2).otherwise(F.col("fault")))
    signed = light.withColumn("seen", seen).select("id", "turn", "role", "digest", F.when(F.col("present"), symbol).otherwise("").alias("sign"))
    summary = materialize(mapped(ordered(signed, "turn", "role", "digest").select("id", "turn", "sign"), signatures, f"id {kind}, gaps bigint, signature string"), "signatures")

    different = materialize(summary.select("signature").distinct(), "different")
    sorted_ones = different.repartitionByRange(partitions(different.sparkSession), "signature").sortWithinPartitions("signature")
    answered = mapped(sorted_ones, lambda some: answers(some, costs), "signature string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string")
    told_all = materialize(summary.join(answered, "signature").drop("signature"), "answers")

    front = told_all.select("id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("binary").alias("digest"))
    behind = rows.where("present").select("id", F.lit(1).alias("kind"), "turn", "role", "text", "digest")
    in_order = ordered(front.unionByName(behind), "kind", "turn", "role", "digest").select("id", "role", "text")
    return Repair(told_all, mapped(in_order, edited, f"id {kind}, edit string, role string, text string"), kind)


def with_digests(done: Repair, id_col: str = "conv_id") -> DataFrame:
    """``id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation."""
    sums = mapped(done.rows, digests, f"id {done.id_type}, repaired_sha256 string").withColumnRenamed("id", "own")
    joined = done.conversations.join(sums, F.col("id").eqNullSafe(F.col("own")), "left").drop("own")
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    return joined.select(F.col("id").alias(id_col), *columns, F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def damaged(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", kinds: int = 20) -> DataFrame:
    """The rows with the damage that the CRC-32 of ``id:turn`` says; a dropped row stays with ``present`` false.

    0 drops a row, 1 empties its text, 2 takes its ``.``, ``!`` and ``?`` away, 3 repeats it, 4 makes its role user.
    """
    told = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    way: Column = F.crc32(F.concat(told(id_col), F.lit(":"), told(turn_col))) % kinds
    rows = conversations.select(F.col(f"`{id_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), told(role_col).alias("role"), told(text_col).alias("text"), way.alias("way"))
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("way") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("way") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("way") != 0).alias("present"), copies.alias("again")).drop("again")
