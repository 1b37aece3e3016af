"""Conversation repair: the cheapest edits that give a legal order of roles, by a persistent audit DP.

A conversation's rows, ordered by turn (NULLs first; ties by role, the text's
first 100 characters, its hash), are read against the role order ``(s?(ua)+)?`` with four states: nothing yet,
after s, after u, after a. Each state keeps its cheapest edits and, among equally
cheap ones, the ASCII-least string of edit letters (K keep 0, R rerole 1, D
delete 2, I insert 5; a truncated row that stays adds 5; blank and repeated rows
must go). These strings are linked nodes that share their beginnings
(``Prefixes``): binary-lifting ancestors and rolling hashes find the longest
common prefix of two, letters of nodes that aren't shared verify it, so a tie
never copies or rescans whole strings.

Conversations of at most ``LONG`` rows are dealt by id, sorted in their
partition and streamed through the DP. Longer ones (also the rows without an
id, if many) are range-partitioned by row, and each block of ``BLOCK`` rows
gives the best edits from each state to each state; blocks are joined in order
per conversation, which holds edit letters only. Both ways give the same edits.
A conversation's edits and its repaired rows are one row of the result.

Defined results: rows with NULL conv_id are one conversation; NULL role or text
is one space, a NULL turn precedes all and counts for no gap; repeated rows stay
(the later ones are duplicates); the initial of an empty role is none, so it is
reroled or deleted; roles match case by case; a conversation without a row left
has zeros and nothing to repair; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabforge.llm.common import PIECE, cut, documents, mapped, ready

STRIP = " \t\n\x0b\x0c\r"  # fixed value: [\x20\x09-\x0D]
LONG, BLOCK = 10_000, 4096
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # fixed values: costs
ROLES = {"s": "system", "u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
#: state -> initial that may follow -> state; states: nothing yet, after s, after u, after a
FOLLOWS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FINAL = (0, 3)
MUST_GO, CUT_SHORT, FINE = 2, 1, 0
_BASE, _MOD = 0x2545F4914F6CDD1D, (1 << 61) - 1
RESULT = ("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
          "repaired array<struct<role:string,text:string,edit:string>>")


class Prefixes:
    """Strings as linked nodes; node 0 is the empty string."""

    def __init__(self):
        self.letter, self.up, self.hash, self.depth = [""], [()], [0], [0]

    def push(self, node: int, letter: str) -> int:
        """The string of ``node`` and one letter more."""
        me = len(self.letter)
        up, at, k = [node], node, 0
        while len(self.up[at]) > k:
            at = self.up[at][k]
            up.append(at)
            k += 1
        self.letter.append(letter)
        self.up.append(tuple(up))
        self.hash.append((self.hash[node] * _BASE + ord(letter)) % _MOD)
        self.depth.append(self.depth[node] + 1)
        return me

    def _lift(self, node: int, depth: int) -> int:
        while (far := self.depth[node] - depth) > 0:
            node = self.up[node][far.bit_length() - 1]
        return node

    def _same(self, a: int, b: int) -> bool:
        """Letters up to the first shared node; hashes alone could collide."""
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.up[a][0], self.up[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        """Whether the string of a precedes that of b."""
        depth = min(self.depth[a], self.depth[b])
        x, y = self._lift(a, depth), self._lift(b, depth)
        if x == y or self.hash[x] == self.hash[y] and self._same(x, y):
            return self.depth[a] < self.depth[b]
        for k in range(len(self.up[x]) - 1, -1, -1):
            if k < len(self.up[x]) and self.hash[self.up[x][k]] != self.hash[self.up[y][k]]:
                x, y = self.up[x][k], self.up[y][k]
        if self._same(self.up[x][0], self.up[y][0]):
            return self.letter[x] < self.letter[y]
        return self.text(a) < self.text(b)  # the hashes collided

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(reversed(out))


def cheapest(rows: list[tuple[str, int]], start: int) -> list[tuple[int, str] | None]:
    """The cheapest edits of (initial, kind) rows from a state to each state: (cost, letters)."""
    tree = Prefixes()
    best: list[tuple[int, int] | None] = [None] * 4
    best[start] = (0, 0)

    def offer(into, state, cost, node, letter):
        """Take the edits of ``node`` and a letter more where they are cheaper, or as cheap and less."""
        old = into[state]
        if old is None or cost < old[0]:
            into[state] = (cost, node, letter)
        elif cost == old[0]:
            new, was = tree.push(node, letter), old[1] if len(old) == 2 else tree.push(old[1], old[2])
            into[state] = (cost, new) if tree.less(new, was) else (cost, was)

    def settle(into):
        return [x if x is None or len(x) == 2 else (x[0], tree.push(x[1], x[2])) for x in into]

    def insert(now):
        """Empty rows in between: into u first, then from u into a; more of them only lead back."""
        for into, sources in ((2, (0, 1, 3)), (3, (2,))):
            step = list(now)
            for s in sources:
                if now[s] is not None:
                    offer(step, into, now[s][0] + INSERT, now[s][1], "I")
            now = settle(step)
        return now

    best = insert(best)
    for initial, kind in rows:
        step: list = [None] * 4
        for state, x in enumerate(best):
            if x is None:
                continue
            cost, node = x
            offer(step, state, cost + DELETE, node, "D")
            if kind == MUST_GO:
                continue
            cost += TRUNCATED if kind == CUT_SHORT else 0
            for role, after in FOLLOWS[state].items():
                if role == initial:
                    offer(step, after, cost + KEEP, node, "K")
                elif role != "s":
                    offer(step, after, cost + REROLE, node, "R")
        best = insert(settle(step))
    return [None if x is None else (x[0], tree.text(x[1])) for x in best]


def first_role(audit: str) -> int:
    """An odd number of rows starts with s; after that u and a take turns."""
    return (len(audit) - audit.count("D")) % 2


def apply(edits: str, rows, place: int, odd: int) -> list[dict]:
    """The repaired rows of (role, text) rows; ``place`` repaired rows precede them."""
    out, rows = [], iter(rows)
    for e in edits:
        if e == "D":
            next(rows)
            continue
        due = "s" if odd and place == 0 else "ua"[(place - odd) % 2]
        place += 1
        if e == "I":
            out.append({"role": ROLES[due], "text": "", "edit": e})
        else:
            role, text = next(rows)
            out.append({"role": role if e == "K" else ROLES[due], "text": text, "edit": e})
    return out


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def gaps(turns: list[int]) -> int:
    return max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0


def best_end(ends) -> tuple[int, str]:
    return min(x for i, x in enumerate(ends) if i in FINAL and x is not None)


def one(rows: list[tuple]) -> tuple:
    """The result of a conversation's sorted (turn, role, text, kind) rows."""
    seen, steps, n = set(), [], [0, 0, 0]  # blank, duplicate, truncated
    for _, role, text, kind in rows:
        fault = 0 if kind == MUST_GO else 1 if (role, text) in seen else 2 if kind == CUT_SHORT else None
        seen.add((role, text))
        if fault is not None:
            n[fault] += 1
        steps.append((role[:1], MUST_GO if fault in (0, 1) else kind))
    cost, audit = best_end(cheapest(steps, 0))
    repaired = apply(audit, ((r[1], r[2]) for r in rows), 0, first_role(audit))
    return (gaps([r[0] for r in rows if r[0] is not None]), *n, illegal_pairs([x for x, _ in steps]), cost, audit, repaired)


# ------------------------------------------------------------------ on Spark

def clean(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and gone (as it is, else false), NULLs as one space, with the kind of each row."""
    gone = F.col("gone") if "gone" in df.columns else F.lit(False)
    rows = df.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                     F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), gone.alias("gone"))
    end = F.rtrim("text", F.lit(STRIP))
    return rows.withColumn("x", F.xxhash64("text")).withColumn("kind", F.when(end == "", MUST_GO).when(F.right(end, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(CUT_SHORT))


def _order() -> list:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.left("text", F.lit(100)), F.col("x")]


def _short(rows: DataFrame) -> DataFrame:
    """Conversations that fit a task each: dealt by id, sorted, streamed."""
    kind = rows.schema["conv_id"].dataType
    dealt = ready(rows).repartition("conv_id").sortWithinPartitions(F.col("conv_id"), *_order()).drop("x")
    schema = T.StructType([T.StructField("conv_id", kind)])
    for f in T._parse_datatype_string(RESULT).fields:
        schema = schema.add(f)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow, out, size, now, held = to_arrow_schema(schema), [], 0, None, []

        def pack():
            return pa.RecordBatch.from_pylist(out, schema=arrow)

        for b in batches:
            for c, turn, role, text, gone, k in zip(*(col.to_pylist() for col in b.columns)):
                if now is None or c != now[0]:
                    if now is not None:
                        out.append(dict(zip(schema.names, (now[0], *one(held)))))
                        if size > PIECE:
                            yield pack()
                            out, size = [], 0
                    now, held = (c,), []
                if not gone:
                    held.append((turn, role, text, k))
                    size += len(text) + 64
        if now is not None:
            out.append(dict(zip(schema.names, (now[0], *one(held)))))
            yield pack()

    return dealt.mapInArrow(run, schema)


def _long(rows: DataFrame, block: int) -> DataFrame:
    """Conversations of any length, in blocks of rows."""
    kind = rows.schema["conv_id"].dataType
    named = rows.withColumn("g", F.concat_ws(":", F.lit("g"), F.col("conv_id").cast("string")))
    ids = named.select("g", "conv_id").distinct()
    held = named.where("not gone").drop("conv_id", "gone").withColumn("h", F.sha2(F.concat("role", F.lit("\0"), "text"), 256)) \
        .withColumn("tie", F.monotonically_increasing_id())  # equal rows needn't share a task
    order = [F.col("g"), *_order(), F.col("tie")]
    stored = cut(held.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie", "x")).withColumn("r", F.monotonically_increasing_id())
    first = stored.groupBy("g", "role", "h").agg(F.min("r").alias("first")).select("first")
    facts = stored.join(first, F.col("r") == F.col("first"), "left").withColumn("again", F.col("first").isNull()).drop("first", "h")
    facts = cut(facts.withColumn("b", F.floor(F.col("r") / block)))
    counts = facts.groupBy("g").agg(
        (F.coalesce(F.max("turn") - F.min("turn") + 1, F.lit(0)) - F.count_distinct("turn")).alias("gaps"),
        F.count_if(F.col("kind") == MUST_GO).alias("blank"), F.count_if((F.col("kind") != MUST_GO) & F.col("again")).alias("duplicate"),
        F.count_if((F.col("kind") == CUT_SHORT) & ~F.col("again")).alias("truncated"))

    def block_edits(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("r")
        initials = [x[:1] for x in part.role]
        steps = [(i, MUST_GO if again else k) for i, k, again in zip(initials, part.kind, part.again)]
        ways = [x for s in range(4) for x in cheapest(steps, s)]
        return pd.DataFrame({"g": part.g.iloc[:1], "b": part.b.iloc[:1], "first": initials[:1], "last": initials[-1:],
                             "illegal": [illegal_pairs(initials)], "costs": [[-1 if x is None else x[0] for x in ways]],
                             "edits": [["" if x is None else x[1] for x in ways]]})

    def joined(parts: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("b")
        best: list = [(0, ""), None, None, None]
        back, illegal, last = [], 0, None
        for x in parts.itertuples(index=False):
            step: list = [None] * 4
            came: list = [None] * 4
            for s, start in enumerate(best):
                for e in range(4):
                    if start is None or x.costs[4 * s + e] < 0:
                        continue
                    new = (start[0] + int(x.costs[4 * s + e]), start[1] + x.edits[4 * s + e])
                    if step[e] is None or new < step[e]:
                        step[e], came[e] = new, s
            best = step
            back.append(came)
            illegal += int(x.illegal) + (last is not None and last + x.first not in LEGAL)
            last = x.last
        cost, audit = best_end(best)
        state = next(i for i in FINAL if best[i] == (cost, audit))
        mine = []
        for came, edits in zip(reversed(back), reversed(list(parts.edits))):
            mine.append(edits[4 * came[state] + state])
            state = came[state]
        mine.reverse()
        placed, places = 0, []
        for e in mine:
            places.append(placed)
            placed += len(e) - e.count("D")
        return pd.DataFrame({"g": parts.g, "b": parts.b, "mine": mine, "place": places, "odd": first_role(audit), "cost": cost, "illegal": illegal})

    def mended(part: pd.DataFrame, plan: pd.DataFrame) -> pd.DataFrame:
        part, p = part.sort_values("r"), plan.iloc[0]
        repaired = apply(p.mine, zip(part.role, part.text), int(p.place), int(p.odd))
        return pd.DataFrame({"g": [p.g], "b": [p.b], "mine": [p.mine], "cost": [p.cost], "illegal": [p.illegal], "repaired": [repaired]})

    blocks = ready(facts).select("g", "b", "r", "role", "kind", "again").groupBy("g", "b").applyInPandas(
        block_edits, "g string, b long, first string, last string, illegal long, costs array<long>, edits array<string>")
    plan = blocks.groupBy("g").applyInPandas(joined, "g string, b long, mine string, place long, odd int, cost long, illegal long")
    done = facts.select("g", "b", "r", "role", "text").groupBy("g", "b").cogroup(plan.groupBy("g", "b")).applyInPandas(
        mended, "g string, b long, mine string, cost long, illegal long, repaired array<struct<role:string,text:string,edit:string>>")
    whole = done.groupBy("g").agg(F.first("cost").alias("cost"), F.first("illegal").alias("illegal"),
                                  F.sort_array(F.collect_list(F.struct("b", "mine", "repaired"))).alias("x"))
    out = ids.join(counts, "g", "left").join(whole, "g", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    empty = F.array().cast("array<struct<role:string,text:string,edit:string>>")
    return out.select(F.col("conv_id").cast(kind).alias("conv_id"), *(v.alias(c) for c, v in zero.items()),
                      F.coalesce(F.array_join("x.mine", ""), F.lit("")).alias("audit"),
                      F.coalesce(F.flatten("x.repaired"), empty).alias("repaired"))


def repair(df: DataFrame, long: int = LONG, block: int = BLOCK) -> DataFrame:
    """One row per conv_id of ``df`` (conv_id, turn, role, text): faults, cost, audit and the repaired rows.

    Rows marked in an optional boolean column ``gone`` are left out, but their conversations are reported.
    """
    rows = clean(df)
    big = rows.groupBy("conv_id").count().where(F.col("count") > long).select(F.col("conv_id").alias("_c"))
    if big.isEmpty():
        return _short(rows)
    big = cut(big)  # one in `long` rows at most
    same = F.col("conv_id").eqNullSafe(F.col("_c"))
    return _short(rows.join(big, same, "left_anti")).unionByName(_long(rows.join(big, same, "left_semi"), block))


def damage(df: DataFrame) -> DataFrame:
    """The contract's damage by crc32 of ``conv_id:turn``: dropped rows are marked ``gone``, repeated ones doubled."""
    def plain(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    rows = df.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), key.alias("d"))
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), (F.col("d") == 0).alias("gone"),
                       F.explode(F.when(F.col("d") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
    return rows.drop("_copy")


def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    out = repair(damage(documents(spark, sf, "conversations")))
    lines = F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                      F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))


QUERIES = {"op12_conversation_repair": op12_conversation_repair}
SQL: dict[str, str] = {}
