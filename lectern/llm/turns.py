"""Repair of conversations whose turns are blank, repeated, cut off or out of turn.

A conversation is right if the initials of its roles read ``(s?(ua)+)?``: nothing, or an
optional system turn and then pairs of user and assistant.  Each row is kept (cost 0), given
the role user or assistant (3) or deleted (4; blank and repeated rows must be), empty turns may
be inserted anywhere (3 each), and a truncated row that stays costs 3 more.  The cheapest edits
win; of equally cheap ones those whose initials in order (D, I, K, R) are least.

The method is a dynamic program over the subsequence of rows that stay.  Prefix sums of
deletions price the rows left out between two that stay, the two roles determine the turns to
insert between them, and for each role the running minimum over all earlier rows that ended
with it is all that a later row needs.  Ties are broken by the edits' initials so far.

Conversations are cut into segments of at most SEGMENT rows of the sorted table.  A segment gives, for each role
it may be entered with, the cheapest way to each role it may be left with; segments of one
conversation are then chained, and the chosen ways are dealt back to their rows.  So a
conversation with very many rows is split over tasks like any other rows.

Defined results: a null role or text counts as one space; rows are ordered by turn, nulls first, rows that share
a turn by a digest of role and text, so that equal rows are adjacent; a null conv_id is a
conversation of its own; a role's initial is its first character (a role other than system,
user, assistant is judged by it, an empty role fits nowhere); an empty table gives an empty result; other columns are not
read.  A conversation's edits are one value of the result, so its rows bound what the task that chains its
segments holds (a letter or two for each row and role).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import held

#: Rows in a segment, as a power of two.
SEGMENT_BITS = 11
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: The six blanks that a text may be made of and still be blank.
BLANKS = " \t\n\x0b\x0c\r"
#: The role before the first row that stays.
START = "-"
#: How many turns stand between a role and the next that stays; pairs that are missing cannot follow each other.
BETWEEN = {START + "s": 0, START + "u": 0, START + "a": 1, "su": 0, "sa": 1, "uu": 1, "ua": 0, "au": 0, "aa": 1}
#: How many turns follow the last role that stays.
AFTER = {START: 0, "s": 2, "u": 1, "a": 0}
NEXT = {START: "u", "s": "u", "u": "a", "a": "u"}
NAME = {"u": "user", "a": "assistant"}
ENTRIES = START + "sua"


def cheapest(rows: list[tuple[str, bool, bool]], entry: str) -> dict[str, tuple[int, str]]:
    """For each last role: cost and initials of the cheapest edits of rows (initial, must go, truncated) after role entry."""
    gone = 0  # what it costs to delete all rows so far
    # role -> cost less the deletions up to its row, initials up to its row, rows up to its row
    best: dict[str, tuple[int, str, int]] = {entry: (0, "", 0)}
    for n, (initial, must_go, cut) in enumerate(rows):
        if not must_go:
            stay: dict[str, tuple[int, str]] = {}
            for role, letter in (("u", "R"), ("a", "R"), (initial, "K")):
                own = (KEEP if letter == "K" else REROLE) + CUT * cut
                for before, (cost, audit, at) in best.items():
                    if (between := BETWEEN.get(before + role)) is not None:
                        way = (cost + gone + INSERT * between + own, audit + "D" * (n - at) + "I" * between + letter)
                        if role not in stay or way < stay[role]:
                            stay[role] = way
            gone += DELETE
            for role, (cost, audit) in stay.items():
                held_ = best.get(role)
                if held_ is None or (cost - gone, audit) < (held_[0], held_[1] + "D" * (n + 1 - held_[2]) if held_[0] == cost - gone else ""):
                    best[role] = (cost - gone, audit, n + 1)
        else:
            gone += DELETE
    return {role: (cost + gone, audit + "D" * (len(rows) - at)) for role, (cost, audit, at) in best.items()}


def steps(audit: str, entry: str, initials: str) -> Iterator[tuple[str, str, str]]:
    """Edit, inserted roles before it and final role (of a kept row: its initial) of each row; the last has what follows all rows, if anything."""
    now, before, at = entry, "", 0
    for letter in audit:
        if letter == "D":
            yield "D", before, ""
            before, at = "", at + 1
        elif letter == "I":
            now = NEXT[now]
            before += now
        else:
            now = initials[at] if letter == "K" else NEXT[now]
            yield letter, before, now
            before, at = "", at + 1
    if before:
        yield "", before, ""


def placed(turns: DataFrame) -> DataFrame:
    """turns with their place in the order of conversations and turns, and what is wrong with each (but repeats); written once."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    rows = rows.withColumns({
        "digest": F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)),
        "initial": F.when(F.col("role") == "", " ").otherwise(F.substring("role", 1, 1)),
        "blank": bare == "",
        "truncated": (bare != "") & ~F.right(bare, F.lit(1)).isin(".", "!", "?"),
        "row": F.monotonically_increasing_id(),  # equal rows may part where one turn has very many
    })
    order = ["conv_id", "turn", "digest", "row"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("row")
    return held(ranged.withColumn("place", F.monotonically_increasing_id()))


def _segment() -> Column:
    return F.shiftright("place", SEGMENT_BITS)


def _repeats(rows: DataFrame) -> DataFrame:
    """place of each row that is not blank and whose role and text stand earlier in its conversation."""
    whole = rows.where("NOT blank").select("conv_id", "digest", "place")
    first = whole.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1")
    return whole.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d"))).where("place > first").select("conv_id", "place")


WAYS = "array<struct<entry:string,role:string,cost:bigint,audit:string>>"


def _summed(rows: DataFrame) -> DataFrame:
    """A row for each conversation and segment: its cheapest ways and counts."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    marked = rows.select("conv_id", "place", "initial", "blank", "truncated", F.lit(False).alias("repeat"))
    repeats = _repeats(rows).select("conv_id", "place", F.lit("").alias("initial"), F.lit(False).alias("blank"), F.lit(False).alias("truncated"), F.lit(True).alias("repeat"))
    both = marked.union(repeats).withColumn("segment", _segment())
    both = both.repartition("segment").sortWithinPartitions("segment", "place", F.desc("repeat"))
    schema = f"conv_id {kind}, segment bigint, place bigint, initials string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, ways {WAYS}"

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {k: [] for k in ("conv_id", "segment", "place", "initials", "blank", "duplicate", "truncated", "illegal", "ways")}
        run: list[tuple[str, bool, bool, bool]] = []  # initial, blank, repeated, truncated
        at: tuple = ()
        first, outer = 0, True  # outer: the conversation may go on in another segment

        def end(outer: bool) -> None:
            initials = "".join(r[0] for r in run)
            blank, repeated = sum(r[1] for r in run), sum(r[2] for r in run)
            cut = [r[3] and not r[2] for r in run]
            ways = []
            for entry in ENTRIES if outer else START:
                for role, (cost, audit) in cheapest([(r[0], r[1] or r[2], c) for r, c in zip(run, cut)], entry).items():
                    ways.append({"entry": entry, "role": role, "cost": cost, "audit": audit})
            illegal = sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))
            for k, v in zip(out, (at[1], at[0], first, initials, blank, repeated, sum(cut), illegal, ways)):
                out[k].append(v)

        def taken() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict(out, schema=arrow)
            for v in out.values():
                v.clear()
            return batch

        repeat = None
        for batch in batches:
            arrow = pa.schema([
                ("conv_id", batch.schema.field("conv_id").type), ("segment", pa.int64()), ("place", pa.int64()), ("initials", pa.string()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
                ("ways", pa.list_(pa.struct([("entry", pa.string()), ("role", pa.string()), ("cost", pa.int64()), ("audit", pa.string())]))),
            ])
            for conv, place, initial, blank, cut, repeats_, segment in zip(*(c.to_pylist() for c in batch.columns)):
                if repeats_:
                    repeat = place
                    continue
                if (segment, conv) != at:
                    new = not at or segment != at[0]
                    if run:
                        end(outer or new)
                    run, at, first, outer = [], (segment, conv), place, new
                run.append((initial, blank, place == repeat, cut))
            if len(out["place"]) >= 1000:
                yield taken()
        if run:
            end(True)
            yield taken()
        elif out["place"]:
            yield taken()

    return both.mapInArrow(found, schema)


def _chained(segments: DataFrame) -> DataFrame:
    """Segments of each conversation chained: a row for each segment with its entry role and edits, and one (segment null) for the conversation."""
    kind = segments.schema["conv_id"].dataType.simpleString()
    sorted_ = segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    names = ("conv_id", "segment", "place", "initials", "entry", "audit", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = f"conv_id {kind}, segment bigint, place bigint, initials string, entry string, audit string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {k: [] for k in names}
        parts: list[dict] = []

        def end() -> None:
            best: dict[str, tuple[int, str, tuple]] = {START: (0, "", ())}
            for part in parts:
                new: dict[str, tuple[int, str, tuple]] = {}
                for way in part["ways"]:
                    if way["entry"] in best:
                        cost, audit, path = best[way["entry"]]
                        step = (cost + way["cost"], audit + way["audit"], (path, way))
                        if way["role"] not in new or step[:2] < new[way["role"]][:2]:
                            new[way["role"]] = step
                best = new
            cost, audit, role = min((c + INSERT * AFTER[r], a + "I" * AFTER[r], r) for r, (c, a, _) in best.items())
            path, ways = best[role][2], []
            while path:
                path, way = path
                ways.append(way)
            ways.reverse()
            for i, (part, way) in enumerate(zip(parts, ways)):
                tail = "I" * AFTER[role] if i == len(parts) - 1 else ""
                row = (part["conv_id"], part["segment"], part["place"], part["initials"], way["entry"], way["audit"] + tail, None, None, None, None, None)
                for k, v in zip(names, row):
                    out[k].append(v)
            joins = sum((a["initials"][-1] + b["initials"][0]) not in ("su", "ua", "au") for a, b in zip(parts, parts[1:]))
            sums = [sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated", "illegal")]
            for k, v in zip(names, (parts[0]["conv_id"], None, None, None, None, audit, *sums[:3], sums[3] + joins, cost)):
                out[k].append(v)

        def taken() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_pydict(out, schema=arrow)
            for v in out.values():
                v.clear()
            return batch

        for batch in batches:
            arrow = pa.schema([("conv_id", batch.schema.field("conv_id").type)] + [(k, pa.string() if k in ("initials", "entry", "audit") else pa.int64()) for k in names[1:]])
            for row in batch.to_pylist():
                if parts and parts[0]["conv_id"] != row["conv_id"]:
                    end()
                    parts.clear()
                parts.append(row)
            if len(out["place"]) >= 1000:
                yield taken()
        if parts:
            end()
        if out["place"]:
            yield taken()

    return sorted_.mapInArrow(found, schema)


def _edits(ways: DataFrame) -> DataFrame:
    """place, edit, before (initials of the turns inserted before), after (those inserted after the last row), final (initial of the role it gets) of each row."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = []
            for place, initials, entry, audit in zip(*(c.to_pylist() for c in batch.columns)):
                for i, (edit, before, final) in enumerate(steps(audit, entry, initials)):
                    if edit:
                        rows.append([place + i, edit, before, "", final])
                    else:
                        rows[-1][3] = before
            columns = zip(*rows) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int64(), *[pa.string()] * 4))], ["place", "edit", "before", "after", "final"])

    return ways.select("place", "initials", "entry", "audit").mapInArrow(found, "place bigint, edit string, before string, after string, final string")


class Repair:
    """What repairs a table of turns: edits of its rows, the conversations' figures and the repaired turns."""

    def __init__(self, turns: DataFrame) -> None:
        self.rows = placed(turns)
        chained = held(_chained(_summed(self.rows)))
        self.ways = chained.where("segment IS NOT NULL")
        #: conv_id, blank, duplicate, truncated, illegal, cost, audit
        self.conversations = chained.where("segment IS NULL").select("conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def edits(self) -> DataFrame:
        """conv_id, place, turn, role, text of each row, its edit, and the turns that go before and after it."""
        return self.rows.select("conv_id", "place", "turn", "role", "text").join(_edits(self.ways), "place")

    def turns(self) -> DataFrame:
        """conv_id, place, step, turn, role, text of the repaired conversations, in the order place, step; inserted turns have no turn number."""

        def inserted(initials: Column) -> Column:
            some = F.filter(F.split(initials, ""), lambda c: c != "")
            return F.transform(some, lambda c: F.struct(F.lit(None).cast(turn).alias("turn"), F.when(c == "u", NAME["u"]).otherwise(NAME["a"]).alias("role"), F.lit("").alias("text")))

        turn = self.rows.schema["turn"].dataType
        role = F.when(F.col("edit") == "K", F.col("role")).when(F.col("final") == "u", NAME["u"]).otherwise(NAME["a"])
        own = F.when(F.col("edit") != "D", F.array(F.struct("turn", role.alias("role"), "text"))).otherwise(F.array().cast(f"array<struct<turn:{turn.simpleString()},role:string,text:string>>"))
        lines = F.concat(inserted(F.col("before")), own, inserted(F.col("after")))
        return self.edits().where("edit <> 'D' OR before <> '' OR after <> ''").select("conv_id", "place", F.posexplode(lines).alias("step", "line")).select("conv_id", "place", "step", "line.*")


def digests(turns: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of repaired turns: of their ``role:text``, joined by newlines.

    One hash goes over all of a conversation, so its turns pass one task in order, a batch at a time.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    lines = turns.select("conv_id", "place", "step", F.concat("role", F.lit(":"), "text").alias("line"))
    lines = lines.repartition("conv_id").sortWithinPartitions("conv_id", "place", "step")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, begun = None, None, False
        for batch in batches:
            done: list[tuple] = []
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if begun and conv == at:
                    state.update(b"\n")
                else:
                    if begun:
                        done.append((at, state.hexdigest()))
                    at, state, begun = conv, hashlib.sha256(), True
                state.update(line.encode())
            kind_ = batch.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind_), pa.array([d[1] for d in done], pa.string())], ["conv_id", "repaired_sha256"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([at], kind_), pa.array([state.hexdigest()])], ["conv_id", "repaired_sha256"])

    return lines.mapInArrow(found, f"conv_id {kind}, repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """Rows as the query damages them, by crc32 of ``conv_id:turn`` mod 20 (nulls: one space)."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("__way"))
    text = F.when(F.col("__way") == 1, "").when(F.col("__way") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("__way") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("__way") == 3, 2).otherwise(1)
    rows = rows.where("__way <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("__copy"))
    return rows.drop("__copy")


def repaired(original: DataFrame, rows: DataFrame) -> DataFrame:
    """A row for each conversation of original: its gaps and figures after rows, the (damaged) table, were repaired, and the hash of the repaired turns."""
    done = Repair(rows)
    turn = F.col("turn").cast("decimal(20,0)")
    span = F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn)
    gaps = done.rows.groupBy("conv_id").agg(F.coalesce(span.cast("long"), F.lit(0)).alias("gaps"))
    hashes = digests(done.turns())
    out = original.select(F.col("conv_id").alias("__id")).distinct()
    for part in (gaps, done.conversations, hashes):
        out = out.join(part, F.col("__id").eqNullSafe(part["conv_id"]), "left").drop("conv_id")
    zero = F.lit(0).cast("long")
    figures = [F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("__id").alias("conv_id"), *figures, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
