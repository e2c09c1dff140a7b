"""Cheapest repair of damaged conversations by a rank-convergence parallel Viterbi pass.

A repaired conversation has role initials ``(s?(ua)+)?``. Rows are kept, given another role or deleted, and empty rows
inserted, each at a price, which is a shortest path over four states. Backward costs of a row are a vector over the
states; a row maps the vector behind it to the one in front of it in the (min, +) semiring.

A conversation is cut into chunks of bounded length. All chunks start at once from a speculative vector behind them.
Vectors soon differ only by a constant whatever they started from, so a fix-up pass reruns a chunk from its true
vector only until it meets the earlier result up to a constant; passes go on while a chunk's first vector changes.
Choices depend on differences alone, so the stitched vectors lead each chunk's trace of the least audit, and the
constants add up to the cost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.operators.ordered import RUN, Ordered, arrange
from colloquy.runtime import materialize

CHUNK_ROWS = 20_000
OUT_ROWS = 50_000  # rows of edits given out at a time, or those of one chunk
ROLES = {"s": "system", "u": "user", "a": "assistant"}

# Prices of the edits and of a truncated row that stays; adjacent role initials that are legal.
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LEGAL = ("su", "ua", "au")

# States: 0 nothing yet, 1 behind s, 2 behind u, 3 behind a, where a conversation may end as in 0.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
SPOKEN = tuple(next(x for x in "ua" if x in moves) for moves in NEXT)  # what a renamed or inserted row must be
# a row's code: initial (0 s, 1 u, 2 a, 3 other) + 4 * fault (0 none, 1 must go, 2 truncated)
INITIALS = "sua"

Vector = tuple[int, int, int, int]

# results by argument; vectors with least entry 0 are few
_FRONTS: dict = {}
_CHOICES: dict = {}


def relaxed(costs: list[int]) -> list[int]:
    """Costs in front of a place where rows may be inserted."""
    for _ in range(2):  # two inserted rows lead from any state to any that an insertion reaches
        costs = [min(c, INSERT + costs[NEXT[q][SPOKEN[q]]]) for q, c in enumerate(costs)]
    return costs


def options(behind: Vector, code: int, q: int) -> list[tuple[str, int, str, int]]:
    """(letter, cost to the end, what becomes of the row, state behind it) for a row met in state ``q``."""
    initial, fault = code % 4, code // 4
    found = [("D", DELETE + behind[q], "", q)]
    if fault != 1:
        extra = TRUNCATED if fault == 2 else 0
        if initial < 3 and INITIALS[initial] in NEXT[q]:
            to = NEXT[q][INITIALS[initial]]
            found.append(("K", extra + behind[to], "k", to))
        to = NEXT[q][SPOKEN[q]]
        found.append(("R", RENAME + extra + behind[to], SPOKEN[q], to))
    return found


def in_front(behind: Vector, code: int) -> tuple[Vector, int]:
    """The vector in front of a row with least entry 0, and the constant taken off it."""
    known = _FRONTS.get((behind, code))
    if known is None:
        costs = relaxed([min(o[1] for o in options(behind, code, q)) for q in range(4)])
        least = min(costs)
        known = _FRONTS[behind, code] = tuple(c - least for c in costs), least
    return known


def end_vector() -> Vector:
    """Costs behind the last row: 0 where a conversation may end, else what must be inserted."""
    far = 10 * INSERT
    return tuple(relaxed([0, far, far, 0]))


def solve(codes: bytes, behind: Vector) -> tuple[Vector, int]:
    """The vector in front of a chunk, and the constant, from the one behind it."""
    total = 0
    for code in reversed(codes):
        behind, off = in_front(behind, code)
        total += off
    return behind, total


def fix_up(codes: bytes, before: Vector, now: Vector, front: Vector, total: int) -> tuple[Vector, int, int]:
    """As ``solve`` from ``now``, given the result from ``before``; stops where both differ by a constant. Also rows rerun."""
    gap = rerun = 0
    for code in reversed(codes):
        if before == now:
            return front, total + gap, rerun
        before, a = in_front(before, code)
        now, b = in_front(now, code)
        gap, rerun = gap + b - a, rerun + 1
    return now, total + gap, rerun


def choice(behind: Vector, code: int, q: int) -> tuple[str, str, str, int]:
    """The ASCII-least cheapest edits of a row met in state ``q``: letters, rows inserted before it, its fate, next state."""
    asked = behind, code, q
    if asked in _CHOICES:
        return _CHOICES[asked]
    front, least = in_front(behind, code)
    letters = inserted = ""
    while True:
        here = front[q] + least
        by_letter = {o[0]: o for o in options(behind, code, q) if o[1] == here}
        to = NEXT[q][SPOKEN[q]]
        if "D" not in by_letter and INSERT + front[to] == front[q]:
            letters, inserted, q = letters + "I", inserted + SPOKEN[q], to
            continue
        letter, _, fate, to = by_letter[min(by_letter)]
        _CHOICES[asked] = letters + letter, inserted, fate, to
        return _CHOICES[asked]


def trace(codes: bytes, behind: Vector, q: int) -> tuple[list[tuple[str, str, str]], int]:
    """(letters, inserted before, fate) of every row of a chunk entered in state ``q``, and the state behind it."""
    vectors = [behind]
    for code in reversed(codes):
        vectors.append(in_front(vectors[-1], code)[0])
    out = []
    for i, code in enumerate(codes):
        letters, inserted, fate, q = choice(vectors[len(codes) - 1 - i], code, q)
        out.append((letters, inserted, fate))
    return out, q


def closing(q: int) -> str:
    """Rows inserted behind the last one."""
    added = ""
    while q in (1, 2):
        added, q = added + SPOKEN[q], NEXT[q][SPOKEN[q]]
    return added


def classified(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """k, turn, role, text, blank, cut, repeated and a row number; null roles and texts count as one space.

    A row is blank without a character that is not ASCII white space, cut if its last such character is none of
    ``.!?``, repeated if a row that is not blank was seen earlier with its role and text. Written once, so that row
    numbers stay.
    """
    rows = turns.select(
        F.struct(F.col(key).alias("id")).alias("k"), F.col(order).alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))],
    )
    base = materialize(rows.select(
        "*", F.md5(F.col("text").cast("binary")).alias("digest"), (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        F.col("text").rlike(r"[^\x20\x09-\x0D.!?][\x20\x09-\x0D]*\z").alias("cut"), F.monotonically_increasing_id().alias("row"),
    ))
    # the first row of each repeated text; only rows of such texts meet it
    place = F.struct("turn", "row")
    firsts = base.where("not blank").groupBy("k", "role", "digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return base.join(firsts, ["k", "role", "digest"], "left").select(
        "k", "turn", "role", "digest", "blank", "cut", "row", (~F.col("blank") & (F.col("first") != place)).alias("repeated"), "text",
    )


def coded(rows: DataFrame) -> Column:
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return (kind + 4 * F.when(F.col("blank") | F.col("repeated"), 1).when(F.col("cut"), 2).otherwise(0)).cast("int")


def solved_chunks(rows: Ordered) -> tuple[DataFrame, DataFrame, int]:
    """(chunks: k, run, codes, rows; vectors: k, run, behind, front, total; fix-up passes)."""
    item = F.struct(*rows.order, "code")
    chunks = rows.df.groupBy(*rows.key, RUN).agg(F.sort_array(F.collect_list(item)).alias("c"))
    chunks = materialize(chunks.select("k", F.col(RUN).alias("run"), F.col("c.code").alias("codes"), F.col("c.row").alias("rows")))
    end, shape = end_vector(), "k {}, run long, behind array<int>, front array<int>, total long".format(chunks.schema["k"].dataType.simpleString())

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [solve(bytes(c), end) for c in batch.column("codes").to_pylist()]
            yield _vectors(batch, [end] * len(found), [f for f, _ in found], [t for _, t in found])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            now = [tuple(v) for v in batch.column("now").to_pylist()]
            before = zip(*(batch.column(c).to_pylist() for c in ("codes", "behind", "front", "total")), strict=True)
            found = [fix_up(bytes(c), tuple(b), n, tuple(f), t) for (c, b, f, t), n in zip(before, now, strict=True)]
            yield _vectors(batch, now, [f for f, _, _ in found], [t for _, t, _ in found])

    vectors, passes = chunks.select("k", "run", "codes").mapInArrow(start, shape), 0
    if not rows.split:
        return chunks, vectors, passes
    vectors = materialize(vectors)
    while True:
        behind = F.lead("front").over(Window.partitionBy("k").orderBy("run"))  # one row for each chunk
        wanted = vectors.withColumn("now", F.coalesce(behind, F.array(*map(F.lit, end))))
        stale = materialize(wanted.where("now <> behind"))
        if stale.isEmpty():
            return chunks, vectors, passes
        rerun = stale.join(chunks.select("k", "run", "codes"), ["k", "run"]).mapInArrow(again, shape)
        vectors = materialize(vectors.join(stale.select("k", "run"), ["k", "run"], "left_anti").unionByName(rerun))
        passes += 1


def _vectors(batch: pa.RecordBatch, behind: list, front: list, total: list) -> pa.RecordBatch:
    kind = pa.list_(pa.int32())
    arrays = [batch.column("k"), batch.column("run"), pa.array(behind, kind), pa.array(front, kind), pa.array(total, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, ["k", "run", "behind", "front", "total"])


def entered(chunks: DataFrame, vectors: DataFrame, split: bool) -> DataFrame:
    """k, run, codes, rows, behind, entry state, whether it is the conversation's last chunk."""
    both = chunks.join(vectors.select("k", "run", "behind"), ["k", "run"])
    if not split:
        return both.withColumn("entry", F.lit(0)).withColumn("last", F.lit(True))

    def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = []
            for c, b in zip(batch.column("codes").to_pylist(), batch.column("behind").to_pylist(), strict=True):
                ends.append([trace(bytes(c), tuple(b), q)[1] for q in range(4)])
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("run"), pa.array(ends, pa.list_(pa.int32()))], ["k", "run", "ends"])

    kind = chunks.schema["k"].dataType.simpleString()
    ends = both.select("k", "run", "codes", "behind").mapInArrow(leave, f"k {kind}, run long, ends array<int>")
    # a chunk is a map of states; a conversation's few chunks are one small array
    listed = ends.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("run", "ends"))).alias("c"))
    states = F.aggregate("c", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.get(x["ends"], F.element_at(acc, -1)))))
    place = listed.withColumn("s", states).select("k", F.posexplode("c").alias("i", "x"), "s", F.size("c").alias("n"))
    known = place.select("k", F.col("x.run").alias("run"), F.get("s", F.col("i")).alias("entry"), (F.col("i") == F.col("n") - 1).alias("last"))
    return both.join(known, ["k", "run"])


def edits(chunks: DataFrame) -> DataFrame:
    """row, k, run, i, letters, before, fate, behind: what happens at each row; the last also has the rows behind it."""
    kind = chunks.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {c: batch.column(c).to_pylist() for c in ("codes", "rows", "behind", "entry", "last")}
            at, row, place, found, after = [], [], [], [], []
            for i in range(batch.num_rows):
                each, q = trace(bytes(column["codes"][i]), tuple(column["behind"][i]), column["entry"][i])
                added, n = closing(q) if column["last"][i] else "", len(each)
                letters, inserted, fate = each[-1]
                each[-1] = letters + "I" * len(added), inserted, fate
                at += [i] * n
                row += column["rows"][i]
                place += range(n)
                found += each
                after += [""] * (n - 1) + [added]
                if len(at) >= OUT_ROWS or i == batch.num_rows - 1:
                    taken = pa.array(at, pa.int64())
                    yield pa.RecordBatch.from_arrays([
                        pa.array(row, pa.int64()), batch.column("k").take(taken), batch.column("run").take(taken), pa.array(place, pa.int32()),
                        *(pa.array([x[j] for x in found], pa.string()) for j in range(3)), pa.array(after, pa.string()),
                    ], ["row", "k", "run", "i", "letters", "before", "fate", "after"])
                    at, row, place, found, after = [], [], [], [], []

    source = chunks.select("k", "run", "codes", "rows", "behind", "entry", "last")
    return source.mapInArrow(run, f"row long, k {kind}, run long, i int, letters string, before string, fate string, after string")


def _inserted(initials: Column) -> Column:
    """Lines of inserted rows."""
    each = F.filter(F.split(initials, ""), lambda x: x != "")
    return F.transform(each, lambda x: F.struct(F.when(x == "u", ROLES["u"]).otherwise(ROLES["a"]).alias("role"), F.lit("").alias("text")))


def repaired_rows(rows: DataFrame, done: DataFrame) -> DataFrame:
    """k, run, i, letters, lines: the rows that stand where each row of ``classified`` stood, as array<struct<role, text>>."""
    named = F.when(F.col("fate") == "k", F.col("role")).when(F.col("fate") == "u", ROLES["u"]).otherwise(ROLES["a"])
    own = F.when(F.col("fate") == "", F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(F.struct(named.alias("role"), "text")))
    lines = F.concat(_inserted(F.col("before")), own, _inserted(F.col("after")))
    return done.join(rows.select("row", "role", "text"), "row").select("k", "run", "i", "letters", lines.alias("lines"))


def digests(repaired: DataFrame) -> DataFrame:
    """k, audit, repaired_sha256, from rows streamed in order: a conversation's text is never held as a whole.

    A digest is sequential, so one task reads a conversation's rows; it holds the audit and the hash's state.
    """
    kind = repaired.schema["k"].dataType.simpleString()
    said = F.transform("lines", lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    source = repaired.select("k", "run", "i", "letters", F.when(F.size("lines") > 0, F.array_join(said, "\n")).alias("said"))
    sorted_rows = source.repartition("k").sortWithinPartitions("k", "run", "i").select("k", "letters", "said")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, audit, state, lines = None, [], None, 0

        def result() -> pa.RecordBatch:
            values = [pa.array([key], typed), pa.array(["".join(audit)]), pa.array([state.hexdigest()])]
            return pa.RecordBatch.from_arrays(values, ["k", "audit", "repaired_sha256"])

        for batch in batches:
            typed = batch.schema.field("k").type
            for k, letters, text in zip(*(batch.column(c).to_pylist() for c in ("k", "letters", "said")), strict=True):
                if state is None or k != key:
                    if state is not None:
                        yield result()
                    key, audit, state, lines = k, [], hashlib.sha256(), 0
                audit.append(letters)
                if text is not None:
                    state.update((b"\n" if lines else b"") + text.encode())
                    lines += 1
        if state is not None:
            yield result()

    return sorted_rows.mapInArrow(run, f"k {kind}, audit string, repaired_sha256 string")


def repair_conversations(
    turns: DataFrame, conversations: DataFrame | None = None, key: str = "conv_id", order: str = "turn", role: str = "role",
    text: str = "text", chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256: one row per conversation.

    Rows go by ``order`` (nulls first, ties by role, then by a digest of the text). A row's first fault counts: blank,
    duplicate, truncated. Null roles and texts count as one space, a null key is a conversation of its own. Roles go by
    their first character; one that is not s, u or a must be renamed or deleted. Conversations of the table
    ``conversations`` that have no row are given with zeros, an empty audit and the digest of nothing; an empty table
    gives none. Repeated rows are duplicates. Other columns are left out.
    """
    rows = classified(turns, key, order, role, text)
    narrow = rows.drop("text").withColumn("code", coded(rows))
    placed = arrange(narrow, ["k"], ["turn", "role", "digest", "row"], chunk_rows)
    chunks, vectors, _ = solved_chunks(placed)
    done = edits(entered(chunks, vectors, placed.split))
    hashed = digests(repaired_rows(rows, done))

    initial = F.substring("role", 1, 1)
    pairs = placed.with_df(placed.df.withColumn("initial", initial)).lag("initial", "previous").result()
    first_fault = F.when(F.col("blank"), "blank").when(F.col("repeated"), "duplicate").when(F.col("cut"), "truncated")
    counted = pairs.withColumn("fault", first_fault).groupBy("k").agg(
        *[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")],
        F.count(F.when(~F.concat("previous", "initial").isin(*LEGAL), 1)).alias("illegal"),
    )
    # distinct turns before they are counted, so that rows of one turn collapse where they are
    spans = narrow.select("k", "turn").where("turn is not null").distinct().groupBy("k").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("*")).cast("long").alias("gaps"))
    costs = vectors.groupBy("k").agg((F.sum("total") + F.min_by(F.col("front")[0], "run")).cast("long").alias("cost"))
    every = narrow.select("k") if conversations is None else conversations.select(F.struct(F.col(key).alias("id")).alias("k"))
    out = every.distinct()
    for part in (counted, spans, costs, hashed):
        out = out.join(part, "k", "left")
    zeros = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select(
        F.col("k.id").alias(key), *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"),
    )
