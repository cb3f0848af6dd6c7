"""Repair of the turn structure of conversations by a grammar-compressed dynamic program.

Rows of a conversation stand by turn (nulls first; ties by role, then by the SHA-256 of the text). A row's fault is the
first of: blank (only white space), duplicate (role and text stood earlier), truncated (does not end in ``.!?``). Each row
is kept, given another role (R, 3), or deleted (D, 4; a must for blank and duplicate rows); rows with empty text may be
inserted (I, 3); a truncated row that stays costs 3 more. The cheapest edits are found after which the roles' initials are
``(s?(ua)+)?``; among equal costs the edits whose initials come first in ASCII.

Method: a row is a symbol of its role's initial and its fault, a conversation a string of them, cut into pieces of at most
``PIECE`` rows. Re-Pair finds the grammar of all distinct strings: in rounds the most frequent neighbours (chosen so
that no two overlap) become rules, as many as ``RULES``. A symbol has a transfer matrix over the four states of the automaton:
cost and audit of the cheapest edits from state to state. A rule's matrix is the min-plus product of its two parts', and
its audits are ropes that point into theirs; so a rule is evaluated once, bottom up, for all conversations. A piece is the
product of the few symbols that are left of it. No audit of a cell is a proper prefix of another of the same cost, so the
ASCII order holds through products.

How it spreads: faults, order and pieces are found on rows without their text; one global sort by range cuts even a
conversation with a third of all rows into pieces on many tasks. Only its pieces' matrices (one row for up to ``PIECE`` rows) meet
in one task, which runs over them in order and holds the audit, one letter for each edit. The grammar (at most ``RULES`` pairs)
is all that the driver holds. Texts move once, to be put behind their edits by a sort; nothing collects a conversation, and
its digest is a stream over its rows, since SHA-256 has no parallel form.

Cases: null role, text, id or turn are one space where they are written or hashed; a null id is a conversation of its own; a
role that begins with none of s, u, a (an empty one too) cannot stay as it is; repeated rows are duplicates of the first; very long
texts are streamed; a conversation that loses all rows has zeros, an empty audit and the hash of an empty string; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm.common import rows_of
from corpusloom.session import checkpointed

PIECE = 256
ROUNDS, PER_ROUND, RULES = 8, 256, 2048
#: Strings whose results a task remembers, pairs that it counts before it sends them.
REMEMBERED, HELD = 20_000, 200_000
BLANKS = " \t\n\x0b\x0c\r"
FAULTS = ("", "truncated", "blank", "duplicate")
#: One letter for each initial (s, u, a, other) and fault.
LETTERS = "ABCDEFGHIJKLMNOP"
FIRST_RULE = 0x100
#: States: nothing yet, behind s, behind u, behind a. What a role's initial does in each state.
STEPS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
#: Cheapest insertions from state to state, and those that end a conversation.
INSERTS = {(0, 0): 0, (1, 1): 0, (2, 2): 0, (3, 3): 0, (0, 2): 1, (0, 3): 2, (1, 2): 1, (1, 3): 2, (2, 3): 1, (3, 2): 1}
ENDS = {0: 0, 1: 2, 2: 1, 3: 0}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

Rope = str | tuple  # an audit, or two ropes one behind the other
Matrix = dict[tuple[int, int], tuple[int, Rope]]


def flat(rope: Rope) -> str:
    out, open_ = [], [rope]
    while open_:
        part = open_.pop()
        if isinstance(part, str):
            out.append(part)
        else:
            open_ += (part[1], part[0])
    return "".join(out)


def _keep_least(cells: Matrix, at: tuple[int, int], cost: int, rope: Rope) -> None:
    old = cells.get(at)
    if old is None or cost < old[0] or (cost == old[0] and flat(rope) < flat(old[1])):
        cells[at] = (cost, rope)


def of_letter(letter: str) -> Matrix:
    """Matrix of one row: insertions before it, then what is done with it."""
    kind, fault = divmod(LETTERS.index(letter), 4)
    cells: Matrix = {}
    for (i, k), inserted in INSERTS.items():
        edits = [(k, DELETE, "D")]
        if FAULTS[fault] in ("", "truncated"):
            stays = TRUNCATED if FAULTS[fault] else 0
            edits += [(STEPS[initial, k], REROLE + stays, "R") for initial in "ua" if (initial, k) in STEPS]
            if kind < 3 and ("sua"[kind], k) in STEPS:
                edits.append((STEPS["sua"[kind], k], stays, "K"))
        for j, cost, edit in edits:
            _keep_least(cells, (i, j), INSERT * inserted + cost, "I" * inserted + edit)
    return cells


def product(left: Matrix, right: Matrix) -> Matrix:
    cells: Matrix = {}
    for (i, k), (cost, rope) in left.items():
        for j in range(4):
            if (more := right.get((k, j))) is not None:
                _keep_least(cells, (i, j), cost + more[0], (rope, more[1]))
    return cells


class Grammar:
    """Rules by rounds, each round's pairs free of overlaps; matrices of all symbols."""

    def __init__(self, rounds: Sequence[Sequence[str]]):
        self.rounds, number = [], FIRST_RULE
        for pairs in rounds:
            self.rounds.append({pair: chr(number + i) for i, pair in enumerate(pairs)})
            number += len(pairs)
        self.size = number - FIRST_RULE

    def compressed(self, text: str) -> str:
        for rules in self.rounds:
            out, i, last = [], 0, len(text) - 1
            while i <= last:
                rule = rules.get(text[i:i + 2]) if i < last else None
                out.append(rule or text[i])
                i += 2 if rule else 1
            text = "".join(out)
        return text

    def matrices(self) -> dict[str, Matrix]:
        """Bottom up: letters, then the rules of each round."""
        found = {letter: of_letter(letter) for letter in LETTERS}
        for rules in self.rounds:
            for pair, symbol in rules.items():
                found[symbol] = product(found[pair[0]], found[pair[1]])
        return found


def grammar_of(strings: DataFrame, rounds: int = ROUNDS, per_round: int = PER_ROUND, limit: int = RULES) -> Grammar:
    """Re-Pair over the column ``symbols`` of all rows; ``limit`` bounds the grammar only, what no rule covers stays a letter."""
    chosen: list[list[str]] = []
    for _ in range(rounds):
        grammar = Grammar(chosen)

        def count(batches, grammar=grammar):
            held: Counter[str] = Counter()

            def sent():
                return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["pair", "n"])

            for (text,) in rows_of(batches, "symbols"):
                text = grammar.compressed(text)
                held.update(map("".join, zip(text, text[1:])))
                if len(held) > HELD:
                    yield sent()
                    held.clear()
            yield sent()

        counted = strings.select("symbols").mapInArrow(count, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        lefts, rights, pairs = set(), set(), []
        for row in counted.filter("n > 1").sort(F.desc("n"), "pair").limit(4 * per_round).collect():
            a, b = row["pair"]
            if a in rights or b in lefts or (a == b and a in lefts):
                continue
            lefts.add(a)
            rights.add(b)
            pairs.append(row["pair"])
        pairs = pairs[:min(per_round, limit - grammar.size)]
        if not pairs:
            break
        chosen.append(pairs)
    return Grammar(chosen)


def _rows(conversations: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(" "))
    return conversations.select(
        F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(" ")).alias("role"), F.sha2(text, 256).alias("hash"), text.alias("text"))


def _lettered(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, hash, letter) of each row in a global order; repeated rows are counted before they move."""
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    kinds = rows.select(
        "conv", "turn", "role", "hash", (body == "").alias("blank"),
        (~F.substring(body, -1, 1).isin(".", "!", "?")).alias("cut")).groupBy("conv", "turn", "role", "hash").agg(
        F.count(F.lit(1)).alias("copies"), F.max("blank").alias("blank"), F.max("cut").alias("cut"))
    firsts = kinds.groupBy("conv", "role", "hash").agg(F.min(F.struct(F.col("turn").isNotNull(), F.col("turn"))).alias("first")).select(
        "conv", "role", "hash", F.col("first.turn").alias("turn"), F.lit(True).alias("opens"))
    left, right = kinds.alias("k"), firsts.alias("f")
    met = left.join(
        right, F.expr("k.conv <=> f.conv AND k.turn <=> f.turn AND k.role = f.role AND k.hash = f.hash"), "left").select("k.*", "f.opens")
    copied = met.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    repeated = F.col("opens").isNull() | (F.col("copy") > 1)
    fault = F.when(F.col("blank"), FAULTS.index("blank")).when(repeated, FAULTS.index("duplicate")).when(
        F.col("cut"), FAULTS.index("truncated")).otherwise(0)
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return copied.select("conv", "turn", "role", "hash", "copy", F.substring(F.lit(LETTERS), kind * 4 + fault + 1, F.lit(1)).alias("letter")).sort(
        "conv", F.col("turn").asc_nulls_first(), "role", "hash", "copy")


def _pieces(lettered: DataFrame, size: int) -> DataFrame:
    """(conv, no, symbols, turns, roles, hashes): up to ``size`` rows of a conversation that stand together in a partition."""
    names = ("conv", "turn", "role", "hash", "letter")
    conv_type = dict(lettered.dtypes)["conv"]
    schema = lettered.schema["conv"].dataType

    def cut(batches):
        base, made, held, out = TaskContext.get().partitionId() << 33, 0, [], []

        def sent():
            columns = list(zip(*out))
            kinds = (to_arrow_type(schema), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()))
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["conv", "no", "symbols", "turns", "roles", "hashes"])
            out.clear()
            return batch

        def close():
            nonlocal made
            convs, turns, roles, hashes, letters = zip(*held)
            out.append((convs[0], base + made, "".join(letters), turns, roles, hashes))
            made += 1
            held.clear()

        for row in rows_of(batches, *names):
            if held and (held[0][0] != row[0] or len(held) >= size):
                close()
                if len(out) >= 2000:
                    yield sent()
            held.append(row)
        if held:
            close()
        if out:
            yield sent()

    return lettered.mapInArrow(cut, f"conv {conv_type}, no long, symbols string, turns array<long>, roles array<string>, hashes array<string>")


def _evaluated(pieces: DataFrame, grammar: Grammar) -> DataFrame:
    """(conv, no, cells): each piece's matrix as (i, j, cost, audit)."""
    matrices, conv_type = grammar.matrices(), dict(pieces.dtypes)["conv"]
    shared = pieces.sparkSession.sparkContext.broadcast((grammar, matrices))

    def evaluate(batches):
        rules, of = shared.value

        @lru_cache(REMEMBERED)
        def cells(symbols: str) -> list[dict]:
            whole = None
            for symbol in rules.compressed(symbols):
                whole = of[symbol] if whole is None else product(whole, of[symbol])
            return [{"i": i, "j": j, "cost": cost, "audit": flat(rope)} for (i, j), (cost, rope) in sorted(whole.items(), key=lambda c: c[0])]

        kind = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                found = [cells(s) for s in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, kind)], ["conv", "no", "cells"])

    return pieces.select("conv", "no", "symbols").mapInArrow(
        evaluate, f"conv {conv_type}, no long, cells array<struct<i:int,j:int,cost:long,audit:string>>")


class _Trail:
    """A way through the pieces so far: its last piece's audit, and the trail before. Trails share what they have in common."""

    __slots__ = ("before", "no", "start", "audit")

    def __init__(self, before, no, start, audit):
        self.before, self.no, self.start, self.audit = before, no, start, audit

    def __lt__(self, other: _Trail) -> bool:
        mine, theirs, a, b = [], [], self, other
        while a is not b:
            mine.append(a.audit)
            theirs.append(b.audit)
            a, b = a.before, b.before
        return "".join(reversed(mine)) < "".join(reversed(theirs))


def _conversations(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(conv, rows of it) of rows that stand together; the rows have to be used up before the next conversation."""
    row = next(rows, None)
    while row is not None:
        conv = row[0]

        def same():
            nonlocal row
            while row is not None and row[0] == conv:
                yield row
                row = next(rows, None)

        mine = same()
        yield conv, mine
        for _ in mine:
            pass


def _solved(evaluated: DataFrame) -> DataFrame:
    """(conv, no, start, audit, ends): the edits of each piece, the state before it and the insertions behind it."""
    conv_type, schema = dict(evaluated.dtypes)["conv"], evaluated.schema["conv"].dataType

    def solve(batches):
        kinds = (to_arrow_type(schema), pa.int64(), pa.int32(), pa.string(), pa.int32())
        out = []

        def sent():
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["conv", "no", "start", "audit", "ends"])
            out.clear()
            return batch

        for conv, pieces in _conversations(rows_of(batches, "conv", "no", "cells")):
            best: dict[int, tuple[int, _Trail | None]] = {0: (0, None)}
            for _, no, cells in pieces:
                now: dict[int, tuple[int, _Trail]] = {}
                for cell in cells:
                    if (reached := best.get(cell["i"])) is not None:
                        found = (reached[0] + cell["cost"], _Trail(reached[1], no, cell["i"], cell["audit"]))
                        if cell["j"] not in now or found < now[cell["j"]]:
                            now[cell["j"]] = found
                best = now
            ended = [(cost + INSERT * ENDS[j], _Trail(trail, None, j, "I" * ENDS[j])) for j, (cost, trail) in best.items()]
            _, last = min(ended)
            ends, trail = len(last.audit), last.before
            while trail is not None:
                out.append((conv, trail.no, trail.start, trail.audit, ends))
                ends, trail = 0, trail.before
                if len(out) >= 2000:
                    yield sent()
        if out:
            yield sent()

    return evaluated.repartition("conv").sortWithinPartitions("conv", "no").mapInArrow(
        solve, f"conv {conv_type}, no long, start int, audit string, ends int")


def _steps(pieces: DataFrame, solved: DataFrame) -> DataFrame:
    """One row for each row of the pieces: its fault, the roles inserted before and behind it, its new role (null: deleted)."""
    left, right = pieces.alias("p"), solved.alias("s")
    met = left.join(right, F.expr("p.no = s.no AND p.conv <=> s.conv")).select("p.*", "s.start", "s.audit", "s.ends")
    conv_type, columns = dict(pieces.dtypes)["conv"], met.columns
    names = ["conv", "turn", "role", "hash", "no", "place", "letter", "before", "edit", "new_role", "behind"]

    def split(batches):
        for batch in batches:
            out = []
            for conv, no, symbols, turns, roles, hashes, state, audit, ends in rows_of([batch], *columns):
                at, added, place = 0, [], 0
                for edit in audit:
                    if edit == "I" or edit == "R":
                        state, named = (3, "assistant") if state == 2 else (2, "user")
                        if edit == "I":
                            added.append(named)
                            continue
                    elif edit == "K":
                        named, state = roles[place], STEPS[roles[place][0], state]
                    else:
                        named = None
                    out.append((conv, turns[place], roles[place], hashes[place], no, place, symbols[place], added, edit, named, []))
                    place, added = place + 1, []
                for _ in range(ends):
                    state, named = (3, "assistant") if state == 2 else (2, "user")
                    out[-1][-1].append(named)
            if out:
                words = pa.list_(pa.string())
                kinds = (batch.schema.field(0).type, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), words, pa.string(), pa.string(), words)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return met.mapInArrow(
        split, f"conv {conv_type}, turn long, role string, hash string, no long, place long, letter string, before array<string>, "
        "edit string, new_role string, behind array<string>")


def repair(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           piece: int = PIECE, rules: int = RULES) -> DataFrame:
    """(conv, turn, edit, fault, old_role, role, text): the edits in order, each conversation's together in one partition.

    K and R rows hold the repaired rows, I rows what is inserted (turn and old role null), D rows what goes (role and
    text null). ``conv`` is the id under a name of its own.
    """
    rows = _rows(conversations, id_col, turn_col, role_col, text_col)
    pieces = checkpointed(_pieces(checkpointed(_lettered(rows)), piece))
    grammar = grammar_of(checkpointed(pieces.select("symbols").distinct()), limit=rules)
    steps = checkpointed(_steps(pieces, _solved(_evaluated(pieces, grammar))))
    texts = rows.select("conv", "turn", "role", "hash", F.lit(0).alias("kind"), "text")
    both = steps.withColumn("kind", F.lit(1)).unionByName(texts, allowMissingColumns=True)
    lined = both.repartition("conv").sortWithinPartitions(
        "conv", F.col("turn").asc_nulls_first(), "role", "hash", "kind", "no", "place")
    names = ["conv", "turn", "role", "kind", "letter", "before", "edit", "new_role", "behind", "text"]
    fields = lined.select(*names)
    conv_type, schema = dict(lined.dtypes)["conv"], lined.schema["conv"].dataType

    def apply(batches):
        kinds = (to_arrow_type(schema), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string())
        current = None
        for batch in batches:
            out = []
            for conv, turn, role, kind, letter, before, edit, new_role, behind, text in rows_of([batch], *names):
                if kind == 0:  # the text that the edits behind it are about
                    current = text
                    continue
                out += [(conv, None, "I", None, None, r, "") for r in before]
                fault = FAULTS[LETTERS.index(letter) % 4]
                out.append((conv, turn, edit, fault, role, new_role, None if new_role is None else current))
                out += [(conv, None, "I", None, None, r, "") for r in behind]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["conv", "turn", "edit", "fault", "old_role", "role", "text"])

    return fields.mapInArrow(apply, f"conv {conv_type}, turn long, edit string, fault string, old_role string, role string, text string")


def summed_up(edits: DataFrame) -> DataFrame:
    """Per conversation its gaps, faults, cost, audit and the hash of its repaired rows; ``edits`` as ``repair`` gives them."""
    conv_type, schema, columns = dict(edits.dtypes)["conv"], edits.schema["conv"].dataType, edits.columns
    names = ["conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]

    def add_up(batches):
        out = []
        kinds = (to_arrow_type(schema), *[pa.int64()] * 6, pa.string(), pa.string())

        def sent():
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
            out.clear()
            return batch

        for conv, rows in _conversations(rows_of(batches, *columns)):
            faults, audit, digest, begun = Counter(), [], hashlib.sha256(), False
            least = most = last = None
            turns = illegal = cost = 0
            for _, turn, edit, fault, old_role, role, text in rows:
                audit.append(edit)
                cost += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit]
                if edit != "I":
                    faults[fault] += 1
                    cost += TRUNCATED if fault == "truncated" and edit != "D" else 0
                    illegal += last is not None and last + old_role[:1] not in ("su", "ua", "au")
                    last = old_role[:1]
                    if turn is not None and turn != most:
                        least, most, turns = (turn if least is None else least), turn, turns + 1
                if edit != "D":
                    digest.update(("\n" * begun + f"{role}:{text}").encode("utf-8", "surrogatepass"))
                    begun = True
            gaps = most - least + 1 - turns if turns else 0
            out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, "".join(audit), digest.hexdigest()))
            if len(out) >= 2000:
                yield sent()
        if out:
            yield sent()

    longs = ", ".join(f"{n} long" for n in names[1:7])
    return edits.mapInArrow(add_up, f"conv {conv_type}, {longs}, audit string, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, by the CRC-32 of ``conv_id:turn``: dropped, emptied, without sentence ends, repeated, made user's."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    at = F.crc32(F.concat_ws(":", *named).cast("binary")) % 20
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))

    def copies(n: Column) -> Column:
        return F.explode(F.sequence(F.lit(1), n))

    return conversations.filter(at != 0).select(
        "conv_id", F.col("turn"), F.when(at == 4, "user").otherwise(role).alias("role"),
        F.when(at == 1, "").when(at == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        copies(F.when(at == 3, 2).otherwise(1)).alias("copy")).drop("copy")


def report(conversations: DataFrame) -> DataFrame:
    """One row for each original ``conv_id``: what damage was found and how it is repaired."""
    found = summed_up(repair(damaged(conversations)))
    ids = conversations.select("conv_id").distinct().alias("i")
    met = ids.join(found.alias("f"), F.expr("i.conv_id <=> f.conv"), "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return met.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
