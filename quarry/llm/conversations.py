r"""Operator 12: conversation structure repair by weighted CYK interval parsing.

The rows of a conversation are taken by turn (nulls first, then role, then MD5
of the text). A row's first fault counts: blank (no `[^\x20\x09-\x0D]`),
duplicate (its role and text stand earlier), truncated (its last such character
is none of `.!?`). Edits: Keep costs 0, Rerole to user or assistant 1, Delete 2
(the only one for blank and duplicate rows), Insert an empty user or assistant
turn 5; a truncated row that stays adds 5. The cheapest edits whose role
initials form `(s?(ua)+)?` win, ties by the least audit (the edits' initials).

Method. With 0 (nothing yet), 1 (after s), 2 (after u) and 3 (after a) for what
the repaired turns end in, nonterminal N_pq stands for spans of rows whose
repair leads from p to q. The grammar is in Chomsky normal form: N_pq -> N_pr
N_rq for every r, N_pq -> a row under one edit, and every cell is closed under
insertions on both sides. A cell holds the minimum (cost, audit) of its span and
nonterminal; sums and concatenations keep that order, because two audits of one
cost and span are never prefixes of each other. As N_pq has a rule for every r,
all splits of a span give the same cell, so the table needs one split for each:
cells are combined bottom-up by span length over spans of 1, 2, 4, ... rows. A
conversation is the cheaper one of N_00 (nothing stays) and N_03.

Scale. Rows are range-partitioned by (conversation, turn, ...) and cut into
blocks of at most BLOCK_ROWS rows, so a conversation of any length is dealt to
many tasks; a block leaves its task as one row of 11 cells. Cells of a
conversation's blocks meet FAN at a time, round by round. Earlier occurrences of
a text are partial minima joined back for texts that repeat only. The repaired
turns of a conversation are read as a stream of blocks (a digest is sequential
by nature): a task holds one block, the audit and a running hash.

Defined cases: null roles and texts are one space, so a null text is blank and a
null role fits only after Rerole; rows with a null conv_id form one conversation
of their own; null turns come first and count for no gap; repeated rows are
duplicates; conversations without rows are not in the result (the query adds
them with zeros); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
BLOCK_ROWS, BLOCK_BYTES = 512, 1 << 20
FAN_BITS = 5  # blocks that meet in one round: 32
BLANKS = " \t\n\x0b\x0c\r"

NONTERMINALS = [(0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3)]
RULES = [[(NONTERMINALS.index((p, r)), NONTERMINALS.index((r, q))) for r in range(4)
          if (p, r) in NONTERMINALS and (r, q) in NONTERMINALS] for p, q in NONTERMINALS]
#: states that a kept or reroled turn of this initial leads from and to
MOVES = {"s": [(0, 1)], "u": [(0, 2), (1, 2), (3, 2)], "a": [(2, 3)]}

Cells = list  # per nonterminal: (cost, audit), or None where there is no parse


def combined(left: Cells, right: Cells) -> Cells:
    """The cells of two neighbouring spans taken together."""
    out = []
    for rules in RULES:
        best = None
        for i, j in rules:
            if left[i] is not None and right[j] is not None:
                got = (left[i][0] + right[j][0], left[i][1] + right[j][1])
                if best is None or got < best:
                    best = got
        out.append(best)
    return out


def _cells(options: list[tuple[tuple[int, int], int, str]]) -> Cells:
    out: Cells = [None] * len(NONTERMINALS)
    for pq, cost, audit in options:
        i = NONTERMINALS.index(pq)
        if out[i] is None or (cost, audit) < out[i]:
            out[i] = (cost, audit)
    return out


def _inserted() -> Cells:
    """Cells of the empty span: any number of insertions (more than two go round in a circle)."""
    one = _cells([((p, p), 0, "") for p in range(4)] + [(m, INSERT, "I") for c in "ua" for m in MOVES[c]])
    return combined(one, combined(one, one))


EMPTY = _inserted()


def _row_cells(initial: str, fault: str) -> Cells:
    options = [((p, p), DELETE, "D") for p in range(4)]
    if fault not in ("blank", "duplicate"):
        more = TRUNCATED if fault == "truncated" else 0
        options += [(m, KEEP + more, "K") for m in MOVES.get(initial, [])]
        options += [(m, REROLE + more, "R") for c in "ua" for m in MOVES[c]]
    return combined(combined(EMPTY, _cells(options)), EMPTY)


FAULTS = ["", "blank", "duplicate", "truncated"]
ROW = {(c, f): _row_cells(c, f) for c in ("s", "u", "a", "") for f in FAULTS}


def parse(rows: list[tuple[str, str]]) -> Cells:
    """Cells of a span of (role initial, fault) rows, bottom-up by span length."""
    level = [ROW[c if c in MOVES else "", f] for c, f in rows]
    while len(level) > 1:
        level = [combined(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else EMPTY


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def apply_edits(audit: str, rows: Iterator[tuple[str, str]], done: int = 0, system: bool = False) -> Iterator[tuple[str, str]]:
    """The turns (role, text) that the edits make of the rows, in order."""
    for edit in audit:
        role, text = next(rows) if edit in "KRD" else ("", "")
        if edit == "D":
            continue
        if edit == "K":
            system = system or (done == 0 and role[:1] == "s")
        else:
            role = "user" if (done - system) % 2 == 0 else "assistant"
        done += 1
        yield role, text


def damage(rows: DataFrame) -> DataFrame:
    """rows(conv_id, turn, role, text) after seeded damage: dropped, emptied, unpunctuated, repeated or reroled turns."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.pmod(F.crc32(F.encode(key, "UTF-8")), F.lit(20))
    text = F.coalesce("text", blank)
    return (rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), text.alias("text"), kind.alias("kind"))
            .where("kind <> 0")
            .select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
                    F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
                    .otherwise(F.col("text")).alias("text"),
                    F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
            .drop("copy"))


def _marked(rows: DataFrame) -> DataFrame:
    """(c, conv_id, turn, role, text, m, late, last): c names the conversation, m the text; late: role and text
    stand at an earlier turn; last: the last non-blank character."""
    narrow = rows.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("c"), F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text")).withColumn("m", F.md5(F.encode("text", "UTF-8")))
    at = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    seen = (narrow.groupBy("c", "role", "m").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n"))
            .where("n > 1").drop("n"))
    return narrow.join(seen, ["c", "role", "m"], "left").select(
        "c", "conv_id", "turn", "role", "text", "m", F.coalesce(at > F.col("first"), F.lit(False)).alias("late"),
        F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1)).alias("last"))


_SUMS = ("blank", "duplicate", "truncated", "illegal", "turns")
_CELLS = ("c string, conv_id long, blk long, cost array<long>, audit array<string>, blank long, duplicate long, truncated long, "
          "illegal long, turns long, first_role string, last_role string, first_turn long, last_turn long, low long")
_BLOCK = _CELLS + ", n_rows array<struct<role:string,text:string>>"


class _Block:
    """Consecutive rows of one conversation."""

    def __init__(self, c: str, conv_id: int | None, blk: int):
        self.c, self.conv_id, self.blk = c, conv_id, blk
        self.rows, self.faults, self.turns, self.size = [], [], [], 0

    def add(self, turn, role: str, text: str, fault: str) -> None:
        self.rows.append((role, text))
        self.faults.append(fault)
        self.turns.append(turn)
        self.size += len(text)

    def summary(self) -> dict:
        roles = [r[:1] for r, _ in self.rows]
        known = [t for t in self.turns if t is not None]
        cells = parse(list(zip(roles, self.faults)))
        return dict(
            c=self.c, conv_id=self.conv_id, blk=self.blk, cost=[x and x[0] for x in cells], audit=[x and x[1] for x in cells],
            **{f: self.faults.count(f) for f in FAULTS[1:]}, illegal=sum(not legal(a, b) for a, b in zip(roles, roles[1:])),
            turns=len(set(known)), first_role=roles[0], last_role=roles[-1], first_turn=self.turns[0], last_turn=self.turns[-1],
            low=min(known, default=None), n_rows=[{"role": r, "text": t} for r, t in self.rows])


def _schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))


def _blocks(marked: DataFrame) -> DataFrame:
    """One row for each block of rows of a conversation: its cells and counts, and the rows themselves (n_rows)."""
    out = _schema(_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 24  # blocks are numbered in the order of the rows
        block, before, done, size = None, None, [], 0
        for b in batches:
            for c, conv, turn, role, text, m, late, last in zip(*(b.column(x).to_pylist() for x in b.schema.names)):
                if block is None or block.c != c or len(block.rows) >= BLOCK_ROWS or block.size >= BLOCK_BYTES:
                    blk = base if block is None or block.c != c else block.blk + 1
                    if block is not None:
                        done.append(block.summary())
                        size += block.size
                    block = _Block(c, conv, blk)
                again = late or before == (c, turn, role, m)
                fault = "blank" if not last else "duplicate" if again else "truncated" if last not in ".!?" else ""
                block.add(turn, role, text, fault)
                before = (c, turn, role, m)
                if len(done) >= C.BATCH_ROWS or size >= BLOCK_BYTES:
                    yield pa.RecordBatch.from_pylist(done, out)
                    done, size = [], 0
        if block is not None:
            yield pa.RecordBatch.from_pylist(done + [block.summary()], out)

    order = ["c", F.col("turn").asc_nulls_first(), "role", "m"]
    return marked.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _BLOCK)


def joined(a: dict, b: dict) -> dict:
    """The summary of two neighbouring blocks of one conversation."""
    cells = combined([None if k is None else (k, s) for k, s in zip(a["cost"], a["audit"])],
                     [None if k is None else (k, s) for k, s in zip(b["cost"], b["audit"])])
    out = {k: a[k] + b[k] for k in _SUMS}
    out["illegal"] += not legal(a["last_role"], b["first_role"])
    out["turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    return dict(c=a["c"], conv_id=a["conv_id"], blk=a["blk"], cost=[x and x[0] for x in cells], audit=[x and x[1] for x in cells],
                **out, first_role=a["first_role"], last_role=b["last_role"], first_turn=a["first_turn"], last_turn=b["last_turn"],
                low=b["low"] if a["low"] is None else a["low"])


def _met(cells: DataFrame) -> DataFrame:
    """Neighbouring blocks (c, grp) of each conversation as one, bottom-up by span length."""
    schema = _schema(_CELLS)

    def meet(group: pa.Table) -> pa.Table:
        level = sorted(group.drop_columns(["grp"]).to_pylist(), key=lambda r: r["blk"])
        while len(level) > 1:
            level = [joined(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return pa.Table.from_pylist(level, schema)

    return cells.groupBy("c", "grp").applyInArrow(meet, _CELLS)


def _whole(blocks: DataFrame) -> DataFrame:
    """One row of cells and counts for each conversation."""
    cells = blocks.drop("n_rows")
    many = cells.groupBy("c").agg(F.min("blk").alias("b0"), F.max("blk").alias("b1")).where("b0 <> b1").select("c")
    out = cells.join(many, "c", "left_anti")
    level, bits = C.pin(cells.join(many, "c", "left_semi")), 0
    while not level.isEmpty():
        bits += FAN_BITS
        level = C.pin(_met(level.withColumn("grp", F.shiftright("blk", bits))))
        more = level.groupBy("c").agg(F.min("blk").alias("b0"), F.max("blk").alias("b1")).where("b0 <> b1").select("c")
        out = out.unionByName(level.join(more, "c", "left_anti"))
        level = C.pin(level.join(more, "c", "left_semi"))
    return out


def _verdicts(whole: DataFrame) -> DataFrame:
    nothing, turns = NONTERMINALS.index((0, 0)), NONTERMINALS.index((0, 3))
    options = F.array(*[F.struct(F.col("cost")[i].alias("cost"), F.col("audit")[i].alias("audit")) for i in (nothing, turns)])
    return (whole.withColumn("best", F.array_min(F.filter(options, lambda x: x["cost"].isNotNull())))
            .select("c", "conv_id", F.coalesce(F.col("last_turn") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps"),
                    "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit")))


def _stream(blocks: DataFrame, verdicts: DataFrame, make, schema: str) -> DataFrame:
    """make(c, conv_id, turns) -> batches, over the repaired turns of each conversation, read block by block."""
    rows = "array<struct<role:string,text:string>>"
    dealt = blocks.select("c", "conv_id", "blk", F.lit(None).cast("string").alias("audit"), "n_rows").unionByName(
        verdicts.select("c", "conv_id", F.lit(-1).cast("long").alias("blk"), "audit", F.lit(None).cast(rows).alias("n_rows")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flow = (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist())
        ahead = next(flow, None)
        while ahead is not None:
            head = ahead

            def rest():
                nonlocal ahead
                while (ahead := next(flow, None)) is not None and ahead["c"] == head["c"]:
                    for r in ahead["n_rows"]:
                        yield r["role"], r["text"]

            source = rest()
            yield from make(head["c"], head["conv_id"], apply_edits(head["audit"], source))
            for _ in source:  # an audit takes every row; this only moves on
                pass

    return (dealt.repartition("c").sortWithinPartitions("c", "blk")).mapInArrow(run, schema)


def _digests(c, conv_id, turns):
    sha, first = hashlib.sha256(), True
    for role, text in turns:
        sha.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
        first = False
    yield pa.RecordBatch.from_pydict({"c": [c], "repaired_sha256": [sha.hexdigest()]})


def _turns(c, conv_id, turns):
    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string())])
    done, size = [], 0
    for i, (role, text) in enumerate(turns):
        done.append(dict(conv_id=conv_id, position=i, role=role, text=text))
        size += len(text)
        if size > BLOCK_BYTES or len(done) > C.BATCH_ROWS:
            yield pa.RecordBatch.from_pylist(done, schema)
            done, size = [], 0
    if done:
        yield pa.RecordBatch.from_pylist(done, schema)


def _parsed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    blocks = C.pin(_blocks(_marked(rows)))
    return blocks, C.pin(_verdicts(_whole(blocks)))


def repaired(rows: DataFrame) -> DataFrame:
    """(conv_id, position, role, text): the turns of every conversation after its cheapest repair."""
    blocks, verdicts = _parsed(rows)
    return _stream(blocks, verdicts, _turns, "conv_id long, position long, role string, text string")


def report(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation."""
    blocks, verdicts = _parsed(rows)
    sha = _stream(blocks, verdicts, _digests, "c string, repaired_sha256 string")
    return verdicts.join(sha, "c").drop("c")


def _add(cell: str, cost, edit: str) -> str:
    """SQL: a cell (nine digits of cost, then the audit) with one more edit."""
    return f"lpad((left({cell}, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({cell}, 10) || '{edit}'"


def _closed_sql(source: str) -> str:
    """SQL: source with columns b0..b3 closed under insertions at the end."""
    two = f"least(b2, {_add('b0', 5, 'I')}, {_add('b1', 5, 'I')}, {_add('b3', 5, 'I')})"
    return f"SELECT * REPLACE (least(b3, {_add('b2', 5, 'I')}) AS b3) FROM (SELECT * REPLACE ({two} AS b2) FROM ({source}))"


SQL = rf"""
WITH RECURSIVE tab AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, _: xor(c >> 1, 3988292384 * (c & 1)), i)) AS t),
k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT) AS b
  FROM conversations),
d AS (
  SELECT conv_id, turn, role, text, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295) % 20 AS kind
  FROM k, tab),
e AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM d WHERE kind <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS i,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last FROM e),
f AS (
  SELECT *, left(role, 1) AS c, CASE WHEN last = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS c2 FROM o),
s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
    count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (c2 IS NOT NULL AND c || c2 NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
dp AS (
  {_closed_sql("SELECT conv_id, 0::BIGINT AS i, '000000000' AS b0, NULL::VARCHAR AS b1, NULL::VARCHAR AS b2, NULL::VARCHAR AS b3 FROM s")}
  UNION ALL
  {_closed_sql(f'''
    SELECT conv_id, i, {_add("b0", 2, "D")} AS b0,
      least({_add("b1", 2, "D")}, CASE WHEN stays AND c = 's' THEN {_add("b0", "t", "K")} END) AS b1,
      least({_add("b2", 2, "D")}, CASE WHEN stays AND c = 'u' THEN {_add("u", "t", "K")} END, CASE WHEN stays THEN {_add("u", "t + 1", "R")} END) AS b2,
      least({_add("b3", 2, "D")}, CASE WHEN stays AND c = 'a' THEN {_add("b2", "t", "K")} END, CASE WHEN stays THEN {_add("b2", "t + 1", "R")} END) AS b3
    FROM (SELECT dp.conv_id, f.i, b0, b1, b2, b3, least(b0, b1, b3) AS u, c, fault NOT IN ('blank', 'duplicate') AS stays,
            CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS t
          FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1)''')}),
best AS (
  SELECT s.*, left(least(b0, b3), 9)::BIGINT AS cost, substr(least(b0, b3), 10) AS audit
  FROM s JOIN dp ON s.conv_id IS NOT DISTINCT FROM dp.conv_id AND s.n = dp.i),
w AS (
  SELECT *, sum((edit IN ('K', 'R', 'D'))::INT) OVER (PARTITION BY conv_id ORDER BY p) AS src,
    sum((edit <> 'D')::INT) OVER (PARTITION BY conv_id ORDER BY p) AS dst
  FROM (SELECT conv_id, p, audit[p] AS edit FROM (SELECT conv_id, audit, unnest(range(1, length(audit) + 1)) AS p FROM best))),
v AS (
  SELECT w.conv_id, p, dst, edit, f.role, f.text, max((dst = 1 AND edit = 'K' AND c = 's')::INT) OVER (PARTITION BY w.conv_id) AS sys
  FROM w LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.src AND edit <> 'I' WHERE edit <> 'D'),
r AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (dst - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END
    || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p)) AS sha FROM v GROUP BY conv_id)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM a.conv_id
  LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM a.conv_id
"""


@C.query("op12_conversation_repair", SQL)
def op12(spark, sf_dir):
    """Every conversation after seeded damage: its faults, and the cheapest repair."""
    rows = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = report(damage(rows))
    every = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    j = every.withColumnRenamed("conv_id", "id").join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return j.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))
