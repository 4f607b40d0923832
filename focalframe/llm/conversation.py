"""Repair of the turn structure of conversations with the least cost, and an audit of the edits.

Edits: K keeps a turn (cost 0), R gives it the role user or assistant (2), D deletes it (3), I inserts an empty turn of user or assistant (2). A truncated
turn that is not deleted costs 1 more; blank and duplicate turns must be deleted. The roles' initials must then read ``(s?(ua)+)?``.

The grammar has four states. Wu-Manber-style layers, one for each cost, hold as bitsets the states from which the turns from here on can be brought
to an accepting end at that cost. They are worked out from the last turn to the first: the first layer that holds the start gives the cost, and a walk from
the first turn, which takes the least letter whose bit is set in the layer that its cost leaves, gives the least audit. States differ by at most 7 in cost,
since inserting and deleting lead from each to any other; so ``DEPTH`` layers above the least cost tell everything and fit one word. Few such words occur
at all: they and their steps are tabled, and a turn costs two look-ups.

Conversations are not gathered. Turns are range-partitioned and cut into pieces of bounded size. As a table takes each word of layers at a piece's end to
that at its beginning, pieces of one conversation are summed up apart, chained, walked apart from each of the four states, and chained again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, short_batches, written

#: Turns and characters of text in a piece at most (a longer turn is a piece of its own).
PIECE_TURNS = 4096
PIECE_CHARS = 1 << 22
#: Grammar states: nothing said yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that each one goes to when the next turn of user or assistant is added; costs of the edits; layers in a word.
NEXT = (USER, USER, ASSISTANT, USER)
KEEP, REROLE, DELETE, INSERT, CUT = 0, 2, 3, 2, 1
DEPTH = 16
FULL = (1 << 4 * DEPTH) - 1
#: Codes of turns: the initial (s, u, a or another), then flags.
KINDS = {"s": 0, "u": 1, "a": 2}
OTHER, DROP, SHORT = 3, 4, 8
ROLES = {USER: "user", ASSISTANT: "assistant"}


def _column(layers: int, state: int) -> int:
    """The bits of one state in all layers, moved to place 0 of each."""
    return layers >> state & (FULL // 15)


def _after(layers: int, cost: int) -> int:
    """What is reachable at ``cost`` more."""
    return layers << 4 * cost & FULL


def _with_inserts(layers: int) -> int:
    for _ in range(2):
        layers |= _after(sum(_column(layers, NEXT[s]) << s for s in range(4)), INSERT)
    return layers


def _settled(layers: int) -> tuple[int, int]:
    """Layers from the least cost on, and that cost; the layers that come in at the top hold all states, as do those below them."""
    least = 0
    while not layers & 15:
        layers, least = layers >> 4 | 15 << 4 * (DEPTH - 1), least + 1
    return layers, least


def _kept_to(code: int, state: int) -> int | None:
    """The state after keeping a turn, if the grammar lets it stand here."""
    kind = code & 3
    if kind == KINDS["s"]:
        return SYSTEM if state == START else None
    if kind == OTHER:
        return None
    goes = NEXT[state]
    return goes if (goes == USER) == (kind == KINDS["u"]) else None


def _before(layers: int, code: int) -> tuple[int, int]:
    """Layers before a turn, from those after it, and by how much the least cost has grown."""
    out = _after(layers, DELETE)
    if not code & DROP:
        more = CUT if code & SHORT else 0
        out |= _after(sum(_column(layers, NEXT[s]) << s for s in range(4)), REROLE + more)
        for s in range(4):
            if (goes := _kept_to(code, s)) is not None:
                out |= _after(_column(layers, goes) << s, KEEP + more)
    return _settled(_with_inserts(out))


def tables() -> tuple[list[list[int]], list[list[list[tuple[str, int]]]], list[str]]:
    """(step, walk, ending): ``step[word][code]`` is the word before a turn from the one after it, ``walk[word][code][state]`` the least letters up to
    and with that turn's and the state after it, ``ending[state]`` what is inserted after the last turn. Word 0 stands at a conversation's end."""
    accepted = sum((1 << START | 1 << ASSISTANT) << 4 * c for c in range(DEPTH))
    words, step, walk = [_with_inserts(accepted)], [], []
    level = lambda layers, state: next(c for c in range(DEPTH) if layers >> 4 * c + state & 1)
    ending = ["I" * (level(words[0], s) // INSERT) for s in range(4)]
    while len(step) < len(words):
        after = words[len(step)]
        step.append([])
        walk.append([])
        for code in range(16):
            before, grown = _before(after, code)
            if before not in words:
                words.append(before)
            step[-1].append(words.index(before))
            walk[-1].append([])
            for start in range(4):
                letters, state, left = "", start, level(before, start)
                while True:
                    more = CUT if code & SHORT else 0
                    # The letters in the order of their codes: the first whose bit is set in the layer that its cost leaves is taken.
                    moves = [("D", state, DELETE)]
                    moves += [("K", to, KEEP + more)] if not code & DROP and (to := _kept_to(code, state)) is not None else []
                    moves += [("R", NEXT[state], REROLE + more)] if not code & DROP else []
                    taken = {letter: to for letter, to, cost in moves if (at := left + grown - cost) >= 0 and after >> 4 * min(at, DEPTH - 1) + to & 1}
                    if "D" not in taken and left >= INSERT and before >> 4 * (left - INSERT) + NEXT[state] & 1:
                        letters, state, left = letters + "I", NEXT[state], left - INSERT
                        continue
                    letter = min(taken)
                    walk[-1][-1].append((letters + letter, taken[letter]))
                    break
    return step, walk, ending


PIECES = """conv_id long, part int, seq int, first_turn long, last_turn long, low long, high long, n_turns long, first_initial string, last_initial string,
illegal long, blank long, truncated long, codes binary, keys array<binary>, places array<int>, roles array<string>, texts array<string>"""


def _cut(max_turns: int, max_chars: int, kinds: dict[str, int]) -> Callable:
    """Sorted turns become pieces: of each turn its code and, of the first one of each role and text, the place and a digest."""
    spaces, names = " \t\n\v\f\r", [x.split()[0] for x in PIECES.replace("\n", " ").split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, conv, piece, chars, out = TaskContext.get().partitionId(), -1, None, [], 0, []

        def closed() -> dict:
            turns = [t for t, _, _ in piece if t is not None]
            codes, keys, places, seen, blank, short = bytearray(), [], [], set(), 0, 0
            for place, (_, role, text) in enumerate(piece):
                code, said = kinds.get(role[:1], 3), text.rstrip(spaces)
                key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
                if not said:
                    blank, code = blank + 1, code | 4
                elif key in seen:
                    code |= 4
                elif said[-1] not in ".!?":
                    code |= 8
                if said and key not in seen:
                    seen.add(key)
                    keys.append(key)
                    places.append(place)
                    short += code >> 3
                codes.append(code)
            initials = [role[:1] for _, role, _ in piece]
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
            return dict(zip(names, (
                conv, part, seq, piece[0][0], piece[-1][0], min(turns, default=None), max(turns, default=None), len(set(turns)), initials[0], initials[-1],
                illegal, blank, short, bytes(codes), keys, places, [r for _, r, _ in piece], [t for _, _, t in piece],
            )))

        def sent() -> pa.RecordBatch:
            kinds_of = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.string(), pa.string(), *[pa.int64()] * 3, pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], k) for n, k in zip(names, kinds_of)], names=names)

        weight = 0
        for batch in batches:
            for id_, turn, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if piece and (id_ != conv or len(piece) >= max_turns or chars + len(text) > max_chars):
                    out.append(closed())
                    weight += chars + 1000
                    piece, chars = [], 0
                    if weight > max_chars:
                        yield sent()
                        out.clear()
                        weight = 0
                if not piece:
                    conv, seq = id_, seq + 1
                piece.append((turn, role, text))
                chars += len(text)
        if piece:
            out.append(closed())
        if out:
            yield sent()

    return run


def pieces_of(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, max_turns: int, max_chars: int) -> DataFrame:
    """Conversations in pieces, numbered by (part, seq) in the order of their turns."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))
    # Equal turns go by a digest, so equal rows stand together; ``row`` only lets a range of equal rows be split.
    rows = rows.withColumns({"tie": F.md5(F.concat_ws(":", "role", "text")), "row": F.monotonically_increasing_id()})
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "tie", "row")]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(ordered.select("conv_id", "turn", "role", "text").mapInArrow(_cut(max_turns, max_chars, KINDS), PIECES), "pieces")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]
EDITED = "conv_id long, part int, seq int, cost long, audit string, edits array<struct<edit:string,role:string,text:string>>, " + ", ".join(f"{c} long" for c in COUNTS)


def _edit(step: list, walk: list, ending: list) -> Callable:
    """Edits of pieces, given the word of layers at their end, the state at their beginning and whether they are the last."""
    goes, roles, counts = NEXT, ROLES, COUNTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                codes = bytearray(row["codes"])
                for place in row["repeated"]:
                    codes[place] |= 4
                word, words = row["word"], []
                for code in reversed(codes):
                    words.append(word)
                    word = step[word][code]
                state, cost, audit, edits = row["state"], 0, [], []

                def insert(n: int) -> None:
                    nonlocal state, cost
                    for _ in range(n):
                        state, cost = goes[state], cost + 2
                        edits.append(("I", roles[state], ""))

                for code, role, text in zip(codes, row["roles"], row["texts"]):
                    letters, after = walk[words.pop()][code][state]
                    audit.append(letters)
                    insert(len(letters) - 1)
                    state, letter = after, letters[-1]
                    cost += 3 if letter == "D" else (2 if letter == "R" else 0) + (code >> 3)
                    edits.append((letter, roles[state] if letter == "R" else role, text))
                if row["last"]:
                    audit.append(ending[state])
                    insert(len(ending[state]))
                out.append((row["conv_id"], row["part"], row["seq"], cost, "".join(audit), [dict(zip(("edit", "role", "text"), e)) for e in edits]))
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))]
            made = [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 6, kinds)]
            yield pa.RecordBatch.from_arrays([*made, *(batch.column(c) for c in counts)], names=["conv_id", "part", "seq", "cost", "audit", "edits", *counts])

    return run


def _summed(step: list) -> Callable:
    """Of each piece, the word at its beginning for every word at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for codes in batch.column(3).to_pylist():
                words = list(range(len(step)))
                for code in reversed(codes):
                    words = [step[w][code] for w in words]
                maps.append(words)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(maps, pa.list_(pa.int32()))], names=["conv_id", "part", "seq", "map"])

    return run


def _walked(step: list, walk: list) -> Callable:
    """Of each piece, the state at its end for every state at its beginning, given the word at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for codes, word in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                words, states = [], [0, 1, 2, 3]
                for code in reversed(codes):
                    words.append(word)
                    word = step[word][code]
                for code in codes:
                    at = walk[words.pop()][code]
                    states = [at[s][1] for s in states]
                maps.append(states)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(maps, pa.list_(pa.int32()))], names=["conv_id", "part", "seq", "map"])

    return run


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, part, seq, map) in the order of the chain become (conv_id, part, seq, at, first): what holds before each map, 0 before the first."""
    started, conv, at = False, None, 0
    for batch in batches:
        out, firsts = [], []
        for id_, map_ in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
            first = not started or id_ != conv
            if first:
                started, conv, at = True, id_, 0
            out.append(at)
            firsts.append(first)
            at = map_[at]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(out, pa.int32()), pa.array(firsts, pa.bool_())], names=["conv_id", "part", "seq", "at", "first"])


def _chain(maps: DataFrame, backward: bool, at: str, first: str) -> DataFrame:
    """Maps applied one after another along each conversation; a few bytes a piece stream by in order, nothing is gathered."""
    order = [F.col(c).desc() if backward else F.col(c).asc() for c in ("part", "seq")]
    rows = maps.repartition("conv_id").sortWithinPartitions(F.col("conv_id"), *order)
    return rows.mapInArrow(_chained, "conv_id long, part int, seq int, at int, first boolean").withColumnsRenamed({"at": at, "first": first})


KEY = ["conv_id", "part", "seq"]


def _met(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """A null-safe equi-join; the right side is broadcast when it is small."""
    few = right.count() <= BROADCAST_IDS // 8
    named = right.select(*(F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns))
    same = None
    for c in keys:
        one = F.col(c).eqNullSafe(F.col(f"__{c}"))
        same = one if same is None else same & one
    return left.join(F.broadcast(named) if few else named, same, how).drop(*(f"__{c}" for c in keys))


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", max_turns: int = PIECE_TURNS, max_chars: int = PIECE_CHARS) -> tuple[DataFrame, DataFrame]:
    """(report, edited): one row per conversation, and the edited conversations in pieces (conv_id, part, seq, cost, audit, edits), ordered by (part, seq).

    ``edits`` holds (edit, role, text) of every turn, also of deleted ones (edit D) and inserted ones (edit I). The report has conv_id, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256.

    Null roles and texts are one space; a null id is a conversation of its own; null turns come first. Turns of equal number are ordered by the MD5 of their role:text, so that
    repeated rows stand together, and all but the first are duplicates. A role without an initial s, u or a, the empty one included, cannot be kept. Texts of any length are read whole.
    Extra columns are ignored. No turns give no rows.
    """
    short_batches(turns.sparkSession)
    step, walk, ending = tables()
    pieces = pieces_of(turns, conv_col, turn_col, role_col, text_col, max_turns, max_chars)
    many = written(pieces.groupBy("conv_id").agg(F.count("*").alias("n_pieces")).where("n_pieces > 1").select("conv_id"), "many")
    none = F.array().cast("array<int>")
    edit = _edit(step, walk, ending)
    lines = F.expr("array_join(transform(filter(edits, e -> e.edit <> 'D'), e -> concat(e.role, ':', e.text)), '\n')")

    def edited(rows: DataFrame) -> DataFrame:
        return rows.select(*KEY, "codes", "roles", "texts", "repeated", "word", "state", "last", *COUNTS).mapInArrow(edit, EDITED)

    # A conversation of one piece is one row: its counts ride along and its repaired text is hashed in place.
    known = {"repeated": none, "word": F.lit(0), "state": F.lit(0), "last": F.lit(True)}
    dropped = F.expr("cast(size(roles) - size(places) AS bigint)")
    counted = {"gaps": F.coalesce(F.expr("high - low + 1 - n_turns"), F.lit(0)).cast("long"), "duplicate": dropped - F.col("blank")}
    whole = edited(_met(pieces, many, ["conv_id"], "left_anti").withColumns(known | counted))
    report = whole.select("conv_id", *COUNTS, "cost", "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    whole = whole.drop(*COUNTS)
    if not many.head(1):
        return report, whole

    parted = _met(pieces, many, ["conv_id"], "left_semi")
    first = F.row_number().over(Window.partitionBy("conv_id", "key").orderBy("part", "seq"))
    said = parted.select(*KEY, F.explode(F.arrays_zip(F.col("keys").alias("key"), F.col("places").alias("place"))).alias("x")).select(*KEY, "x.key", "x.place")
    again = said.withColumn("nth", first).where("nth > 1").groupBy(*KEY).agg(F.collect_list("place").alias("repeated"))
    coded = _met(parted.select(*KEY, "codes"), written(again, "again"), KEY, "left").withColumn("repeated", F.coalesce("repeated", none))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, short = [], []
            for codes, places in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                codes = bytearray(codes)
                short.append(sum(codes[p] >> 3 for p in places))
                for p in places:
                    codes[p] |= 4
                out.append(bytes(codes))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(out, pa.binary()), batch.column(4), pa.array(short, pa.int64())], names=[*KEY, "codes", "repeated", "untold"])

    coded = written(coded.mapInArrow(marked, "conv_id long, part int, seq int, codes binary, repeated array<int>, untold long"), "coded")
    ends = written(_chain(coded.select(*KEY, "codes").mapInArrow(_summed(step), "conv_id long, part int, seq int, map array<int>"), True, "word", "last"), "ends")
    walks = _met(coded.select(*KEY, "codes"), ends, KEY, "inner").select(*KEY, "codes", "word").mapInArrow(_walked(step, walk), "conv_id long, part int, seq int, map array<int>")
    starts = written(_chain(walks, False, "state", "begins").drop("begins"), "starts")
    plan = written(_met(_met(coded.drop("codes"), ends, KEY, "inner"), starts, KEY, "inner"), "plan")
    unknown = {c: F.lit(None).cast("long") for c in COUNTS}
    rest = edited(_met(parted, plan, KEY, "inner").withColumns(unknown)).drop(*COUNTS)

    order = Window.partitionBy("conv_id").orderBy("part", "seq")
    heads = _met(parted.select(*KEY, "first_turn", "last_turn", "low", "high", "n_turns", "first_initial", "last_initial", "illegal", "blank", "truncated", dropped.alias("dropped")), plan.select(*KEY, F.size("repeated").alias("more"), "untold"), KEY, "inner")
    legal = F.concat(F.lag("last_initial").over(order), "first_initial").isin("su", "ua", "au")
    heads = heads.withColumns({"met": F.coalesce(F.lag("last_turn").over(order) == F.col("first_turn"), F.lit(False)).cast("int"), "clash": F.coalesce(~legal, F.lit(False)).cast("int")})
    heads = heads.groupBy("conv_id").agg(
        F.coalesce(F.max("high") - F.min("low") + 1 - F.sum(F.expr("n_turns - met")), F.lit(0)).cast("long").alias("gaps"), F.sum("blank").alias("blank"),
        F.sum(F.expr("dropped - blank + more")).cast("long").alias("duplicate"), F.sum(F.expr("truncated - untold")).cast("long").alias("truncated"), F.sum(F.expr("illegal + clash")).cast("long").alias("illegal"),
    )
    joined = F.expr("array_join(transform(array_sort(collect_list(struct(part, seq, audit))), x -> x.audit), '')")
    audits = rest.groupBy("conv_id").agg(F.sum("cost").alias("cost"), joined.alias("audit"))
    hashed = rest.select(*KEY, lines.alias("lines")).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq").mapInArrow(_hashed, "conv_id long, repaired_sha256 string")
    long = _met(_met(heads, written(audits, "audits"), ["conv_id"], "inner"), written(hashed, "hashed"), ["conv_id"], "inner")
    return report.unionByName(long.select(*report.columns)), whole.unionByName(rest)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, whose pieces stream by in order; a hash is sequential, but only its state is held."""
    started, conv, running, empty = False, None, hashlib.sha256(), True
    names = ["conv_id", "repaired_sha256"]

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([running.hexdigest()])], names=names)

    for batch in batches:
        for id_, lines in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
            if started and id_ != conv:
                yield told()
            if not started or id_ != conv:
                started, conv, running, empty = True, id_, hashlib.sha256(), True
            if lines:
                running.update(("" if empty else "\n").encode() + lines.encode())
                empty = False
    if started:
        yield told()


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults, by a checksum of ``conv_id:turn``: dropped, emptied, cut, repeated and misattributed turns. Nulls are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    rows = rows.withColumn("text", F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("copy", F.explode(F.expr("CASE WHEN fault = 3 THEN array(0, 1) ELSE array(0) END"))).select("conv_id", "turn", "role", "text")
