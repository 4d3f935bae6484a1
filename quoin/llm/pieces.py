"""SentencePiece encoding and decoding by a relational lattice.

Texts fall into units that no piece of the vocabulary crosses (``Vocabulary``
derives the cuts from the pieces). The distinct units of the corpus become a
lattice: their substrings of bounded length are exploded and equi-joined to the
table of pieces, and the edges grouped by unit. A higher-order aggregate folds
the edges of a unit to its pieces: for a unigram model by Viterbi, for a BPE
model by the merges in order of their scores, because the best path by score is
not what such a model means. Units keep their partitioning from the distinct
step on, so the lattice itself is never shuffled.

Texts are then read again and each unit replaced by its pieces. The most
frequent units, at most ``hot`` of them, are broadcast for that; the places of
all others are listed in one more reading and shuffled to their units and back, so
that what is sent to every executor doesn't grow with the corpus.

Semantics
  * The ids are those of the sentencepiece library: identity normalisation, a
    leading space marker, byte fallback; markers such as "<s>" in a text are
    plain text. Ties of merges go to the leftmost, ties of paths to the longest
    last piece.
  * One row per row of the input, repeated ones included, extra columns not
    looked at; a null text has null pieces and null ``exact``, an empty one an
    empty array. ``exact`` says that decoding the ids gives the text again;
    it doesn't for texts that hold the space marker itself.
  * An empty table gives no rows. Units of more than ``LONG`` characters are
    folded by the same rules in Python, with a heap.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .shared import CLEANUP, let, setting, written
from .tokens import BATCH_BYTES, bounded, plain

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK, HOT, LONG = "▁", 1_000_000, 60
#: Characters of text for each task of the lattice; so many units of a task have their edges held in memory, some 2 kB each.
TASK_CHARS, UNITS_HELD = 6_000_000, 80_000
#: Substrings of fewer characters are all looked up; longer ones if a piece begins with that many of theirs.
HEAD = 4
#: Bytes that end a letter of ASCII.
LETTER = np.array([chr(i).isalpha() and i < 128 for i in range(256)])


@dataclass
class Vocabulary:
    """The pieces of a model file, and where texts may be cut."""

    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    bpe: bool
    cuts: str = field(default="")
    longest: int = 1

    @staticmethod
    def load(path: str) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        n = proto.normalizer_spec
        if n.precompiled_charsmap or not n.add_dummy_prefix or n.remove_extra_whitespaces or not n.escape_whitespaces:
            raise ValueError("only models of identity normalisation are supported")
        if proto.trainer_spec.model_type not in (1, 2):
            raise ValueError("only unigram and BPE models are supported")
        p = proto.pieces
        return Vocabulary([x.piece for x in p], [x.score for x in p], [x.type for x in p], proto.trainer_spec.model_type == 2).prepared()

    def prepared(self) -> Vocabulary:
        if MARK not in self.pieces:
            raise ValueError("only models with a piece for the space marker are supported")
        normal = [p for p, k in zip(self.pieces, self.kinds) if k in (1, 4)]
        self.longest = max(map(len, normal), default=1)
        # characters before which no piece goes on from a letter
        after = {p[i] for p in normal for i in range(1, len(p)) if p[i - 1].isalpha()}
        marks = [c for c in ".,;:!?%&*#$()\"'" if c not in after]
        self.cuts = "".join(marks)
        # pieces that a merge of a worse score may make possible
        score = {p: s for p, s, k in zip(self.pieces, self.scores, self.kinds) if k in (1, 4)}

        def late(p: str) -> bool:
            splits = ((p[:i], p[i:]) for i in range(1, len(p)))
            return any(all(len(x) == 1 or x in score for x in ab) and any(len(x) > 1 and score[x] <= score[p] for x in ab) for ab in splits)

        self.late = {p for p in score if late(p)}
        inside = {p[i] for p in normal for i in range(len(p)) if len(p) > 1}
        self.alone_newline = "\n" not in inside
        self.marked = any(MARK in p.lstrip(MARK) for p in normal)
        return self

    def byte_ids(self) -> dict[int, int]:
        return {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == 6}

    def ascii_ids(self) -> list[int]:
        """The id of the piece of each character of ASCII, a space standing for the marker; -1 where there is none."""
        found = {p.replace(MARK, " "): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k in (1, 4)}
        return [found.get(chr(c), -1) for c in range(128)]

    @property
    def unknown(self) -> int:
        return next((i for i, k in enumerate(self.kinds) if k == 2), 0)

    def heads(self) -> dict[str, int]:
        """The length of the longest piece for each ``HEAD`` characters that pieces begin with."""
        out: dict[str, int] = {}
        for p in (p.replace(MARK, " ") for p, k in zip(self.pieces, self.kinds) if k in (1, 4) and len(p) >= HEAD):
            out[p[:HEAD]] = max(out.get(p[:HEAD], 0), len(p))
        return out

    def floor(self) -> float:
        """The score of a character without piece, 10 below the least, as the library has it."""
        return min((s for s, k in zip(self.scores, self.kinds) if k == 1), default=0.0) - 10.0

    def table(self, spark: SparkSession) -> DataFrame:
        """piece, id, score, its rank and late of the pieces that texts can hold, with spaces for the marker."""
        ranks = {s: r for r, s in enumerate(sorted(set(self.scores), reverse=True))}
        rows = {p: (p.replace(MARK, " "), i, s, ranks[s], p in self.late) for i, (p, s, k) in enumerate(zip(self.pieces, self.scores, self.kinds)) if k in (1, 4)}
        return spark.createDataFrame(list(rows.values()), "piece string, id int, score double, rank long, late boolean")


def units_of(column, cuts: str, newline: bool, marked: bool):
    """(index of each unit, offsets by text, distinct units) of a text column; the space marker is a space."""
    column = plain(column)
    text = pc.if_else(pc.equal(column, ""), "", pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), column, pa.scalar("", pa.large_string())))
    if pc.any(pc.match_substring(text, MARK)).as_py():
        text = pc.replace_substring(text, MARK, " ")
    offs = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
    offs = offs - offs[0]
    start = np.zeros(len(data) + 1, bool)
    start[offs] = True
    if not marked:
        space = data == 32
        start[1:-1] |= space[1:] & ~space[:-1]
    if newline:
        at = np.flatnonzero(data == 10)
        start[at] = start[at + 1] = True
    if cuts:
        # after letters of ASCII and of the Latin-1 supplement; fewer cuts only make longer units
        at = np.flatnonzero(np.isin(data, np.frombuffer(cuts.encode(), np.uint8)))
        at = at[at > 1]
        before = data[at - 1]
        start[at[LETTER[before] | ((data[at - 2] == 0xC3) & (before >= 0x80) & (before != 0x97) & (before != 0xB7))]] = True
    marks = np.flatnonzero(start[:-1])
    units = pa.LargeStringArray.from_buffers(len(marks), pa.py_buffer(np.append(marks, len(data))), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()
    return units.indices.to_numpy(zero_copy_only=False), np.searchsorted(marks, offs), units.dictionary


def lister(vocab: Vocabulary):
    """Documents to the distinct units of each batch with their counts; long ones with their pieces."""
    fold = long_folder(vocab)
    how = (vocab.cuts, vocab.alone_newline, vocab.marked)

    def run(batches):
        for batch in bounded(batches):
            at, _, units = units_of(batch.column("text"), *how)
            n = np.bincount(at, minlength=len(units)).astype(np.int64)
            folded = np.full(len(units), None, object)
            for k in np.flatnonzero(pc.greater(pc.utf8_length(units), LONG).to_numpy(zero_copy_only=False)):
                folded[k] = fold(units[k].as_py())
            out = pa.table({"unit": units.cast(pa.string()), "n": pa.array(n), "folded": pa.array(folded, pa.list_(pa.int32()))})
            yield from out.filter(pc.not_equal(out["unit"], "")).to_batches()

    return run


# --- the folds, as Spark columns -------------------------------------------------------------


class Packed:
    """An edge in one number: rank, place, end, late and id, in this order, which is that of the merges."""

    @staticmethod
    def of(rank: Column, s: Column, e: Column, late: Column, id: Column) -> Column:
        shift = lambda x, by: F.call_function("shiftleft", x.cast("long"), F.lit(by))
        return shift(rank, 33) + shift(s, 27) + shift(e, 21) + F.when(late, F.lit(1 << 20)).otherwise(F.lit(0)) + id

    @staticmethod
    def s(x: Column) -> Column:
        return F.shiftright(x, 27).bitwiseAND(F.lit(63)).cast("int")

    @staticmethod
    def e(x: Column) -> Column:
        return F.shiftright(x, 21).bitwiseAND(F.lit(63)).cast("int")

    @staticmethod
    def late(x: Column) -> Column:
        return x.bitwiseAND(F.lit(1 << 20)) != 0

    @staticmethod
    def id(x: Column) -> Column:
        return x.bitwiseAND(F.lit((1 << 20) - 1)).cast("int")

    @staticmethod
    def span(x: Column) -> Column:
        """Place and end as one number."""
        return F.shiftright(x, 21).bitwiseAND(F.lit(4095))


def bit(mask: Column, at: Column) -> Column:
    return F.call_function("shiftright", mask, at).bitwiseAND(F.lit(1)) == 1


def inner(s: Column, e: Column) -> Column:
    """The bits between two places."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), e) - F.call_function("shiftleft", F.lit(2).cast("long"), s)


def fits(mask: Column, x: Column) -> Column:
    """Whether an edge joins two neighbouring symbols: a boundary at either end and one between."""
    return bit(mask, Packed.s(x)) & bit(mask, Packed.e(x)) & (F.bit_count(mask.bitwiseAND(inner(Packed.s(x), Packed.e(x)))) == 1)


def merged_at_once(edges: Column, n: Column) -> Column:
    """Boundaries of the symbols after all BPE merges, as bits; for units of up to ``LONG`` characters.

    One pass over the edges, in order of score and place, merges what fits at its turn. That is the order of
    the merges unless one makes an edge before it fit, which only ``late`` edges can; then the slow way is taken.
    """
    start = F.struct((F.call_function("shiftleft", F.lit(2).cast("long"), n) - 1).alias("mask"), F.lit(False).alias("again"))

    def run(late: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            def earlier(mask: Column) -> Column:
                return F.struct(mask.alias("mask"), (s["again"] | F.exists(late, lambda y: (y < x) & fits(mask, y))).alias("again"))

            return F.when(fits(s["mask"], x), let(s["mask"].bitwiseAND(F.bitwise_not(inner(Packed.s(x), Packed.e(x)))), earlier)).otherwise(s)

        return F.aggregate(edges, start, step)

    return let(let(F.filter(edges, Packed.late), run), lambda s: F.when(s["again"], merged(edges, n)).otherwise(s["mask"]))


def merged(edges: Column, n: Column) -> Column:
    """The same, step by step: each takes of the edges that join two neighbouring symbols the one of the best score."""
    start = F.call_function("shiftleft", F.lit(2).cast("long"), n) - 1

    def step(mask: Column, _: Column) -> Column:
        # edges are in order of score and place: the first that fits is the one
        left = F.transform(F.slice(F.filter(edges, lambda x: fits(mask, x)), 1, 1), lambda x: mask.bitwiseAND(F.bitwise_not(inner(Packed.s(x), Packed.e(x)))))
        return F.coalesce(F.get(left, 0), mask)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), start, step)


def viterbi(edges: Column, n: Column, floor: float) -> Column:
    """Boundaries of the best path by the sum of scores, as bits.

    The state holds for each place the score and the boundaries of the best path to it.
    """
    state = "array<struct<v:double,m:bigint>>"
    start = F.array(F.struct(F.lit(0.0).alias("v"), F.lit(1).cast("long").alias("m"))).cast(state)

    def step(done: Column, e: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), e)
        here = F.transform(F.filter(edges, lambda x: x["e"] == e), lambda x: F.struct((F.get(done, x["s"])["v"] - x["loss"]).alias("v"), (-x["s"]).alias("o"), F.get(done, x["s"])["m"].alias("m")))
        alone = F.struct((F.get(done, e - 1)["v"] + F.lit(floor)).alias("v"), (1 - e).alias("o"), F.get(done, e - 1)["m"].alias("m"))
        # a character without an edge of its own may stand alone at the floor's score
        single = F.exists(edges, lambda x: (x["e"] == e) & (x["s"] == e - 1))
        best = F.array_max(F.when(single, here).otherwise(F.concat(here, F.array(alone))))
        return F.concat(done, F.array(F.struct(best["v"].alias("v"), best["m"].bitwiseOR(bit).alias("m"))))

    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: F.element_at(s, -1)["m"])


def long_folder(vocab: Vocabulary):
    """A function from a long unit to its pieces: the same rules in Python."""
    table = {p.replace(MARK, " "): (i, s) for i, (p, s, k) in enumerate(zip(vocab.pieces, vocab.scores, vocab.kinds)) if k in (1, 4)}
    bytes_, unknown, bpe, longest, floor = vocab.byte_ids(), vocab.unknown, vocab.bpe, vocab.longest, vocab.floor()

    def symbols_bpe(unit: str) -> list[str]:
        n = len(unit)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list = []

        def offer(a: int) -> None:
            b = end[a]
            if b < n and end[b] - a <= longest and (found := table.get(unit[a : end[b]])):
                heapq.heappush(heap, (-found[1], a, b, end[b]))

        for a in range(n):
            offer(a)
        alive = [True] * n
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if not (alive[a] and b < n and alive[b] and end[a] == b and end[b] == c):
                continue
            end[a], alive[b] = c, False
            if c < n:
                before[c] = a
            offer(a)
            if before[a] >= 0:
                offer(before[a])
        return [unit[a : end[a]] for a in range(n) if alive[a]]

    def symbols_unigram(unit: str) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for e in range(1, len(unit) + 1):
            options = [(best[s][0] + table[unit[s:e]][1], -s) for s in range(max(0, e - longest), e) if unit[s:e] in table]
            if unit[e - 1 : e] not in table:
                options.append((best[e - 1][0] + floor, 1 - e))
            best.append(max(options))
        out, e = [], len(unit)
        while e:
            s = -best[e][1]
            out.append(unit[s:e])
            e = s
        return out[::-1]

    def fold(unit: str) -> list[int]:
        ids = []
        for x in (symbols_bpe if bpe else symbols_unigram)(unit):
            if x in table:
                ids.append(table[x][0])
            elif bytes_:
                ids += [bytes_[b] for b in x.encode("utf-8", "replace")]
            elif not ids or ids[-1] != unknown:
                ids.append(unknown)
        return ids

    return fold


def substrings_of(units: DataFrame, vocab: Vocabulary, n: Column, small: bool) -> DataFrame:
    """The lattice: substrings of units of ``n`` characters, of up to the longest piece that begins as they do.

    For BPE, single characters of ASCII but for a unit's first are left out: no merge
    asks for them, and what isn't merged has its id from ``Vocabulary.ascii_ids``.
    """
    heads = units.sparkSession.createDataFrame(list(vocab.heads().items()), "head string, most int")
    starts = units.select("unit", "n", "folded", F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    starts = starts.join(F.broadcast(heads) if small else heads, F.col("unit").substr(F.col("s") + 1, F.lit(HEAD)) == F.col("head"), "left")
    most = F.least(n - F.col("s"), F.coalesce("most", F.lit(HEAD - 1)), F.lit(vocab.longest))
    plain = (F.col("s") > 0) & (F.octet_length(F.col("unit").substr(F.col("s") + 1, F.lit(1))) == 1) & F.lit(vocab.bpe)
    least = F.when(plain, 2).otherwise(1)
    sized = starts.select("unit", "n", "folded", "s", F.explode(F.when(least <= most, F.sequence(least, most))).alias("k"))
    return sized.select("unit", "n", "folded", "s", (F.col("s") + F.col("k")).alias("e"), F.col("unit").substr(F.col("s") + 1, F.col("k")).alias("piece"))


def encoded_units(units: DataFrame, vocab: Vocabulary) -> DataFrame:
    """unit, n, ids (array of int) of a table of distinct units, partitioned by unit.

    ``folded`` has the pieces of long units. They go through the lattice as one character, not
    as another branch of the plan, for which all documents would be read once more.
    """
    spark = units.sparkSession
    pieces, small = vocab.table(spark), len(vocab.pieces) <= 1_000_000
    n = F.when(F.col("folded").isNull(), F.length("unit")).otherwise(1)
    substrings = substrings_of(units, vocab, n, small)
    # the table of pieces is the model's, of bounded size whatever the corpus
    joined = substrings.join(F.broadcast(pieces) if small else pieces, "piece", "left")
    # the first character's row stays without a piece too, so that no unit is lost
    joined = joined.filter("id is not null or (s = 0 and e = 1)")
    if len(vocab.pieces) >= 1 << 20:
        raise ValueError("ids of more than 20 bits are not supported")
    some = F.col("id").isNotNull()
    if vocab.bpe:
        edge = Packed.of(F.col("rank"), F.col("s"), F.col("e"), F.col("late"), F.col("id"))
        edges = [F.array_sort(F.collect_list(F.when(some & (F.col("e") - F.col("s") > 1), edge))).alias("edges"), F.collect_list(F.when(some & (F.col("e") - F.col("s") == 1), edge)).alias("singles")]
    else:
        edges = [F.array_sort(F.collect_list(F.when(some, F.struct((-F.col("score")).alias("loss"), "s", "e", "id")))).alias("edges")]
    grouped = joined.groupBy("unit", "n", "folded").agg(*edges)
    bytes_ = vocab.byte_ids()
    if bytes_:
        first = bytes_[0]
        if any(bytes_[b] != first + b for b in range(256)):
            raise ValueError("the byte pieces are expected in order")

        def fallback(text: Column) -> Column:
            code = F.hex(F.encode(text, "UTF-8"))
            return F.transform(F.sequence(F.lit(0), (F.length(code) / 2).cast("int") - 1), lambda i: F.conv(code.substr(i * 2 + 1, F.lit(2)), 16, 10).cast("int") + first)
    else:

        def fallback(text: Column) -> Column:
            return F.array(F.lit(vocab.unknown))

    def ids_along(found, bits: Column) -> Column:
        """The ids of the symbols between boundaries; ``found`` gives the ids of the edges from a place to another."""

        def ids(s: Column, i: Column) -> Column:
            e = F.get(bits, i + 1)
            return let(found(s, e), lambda f: F.when(F.size(f) > 0, f).otherwise(fallback(F.col("unit").substr(s + 1, e - s))))

        return F.flatten(F.transform(F.slice(bits, 1, F.size(bits) - 1), ids))

    def bits_of(mask: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), n), lambda i: F.call_function("shiftrightunsigned", mask, i).bitwiseAND(F.lit(1).cast("long")) == 1)

    if vocab.bpe:

        def found(s: Column, e: Column) -> Column:
            among = lambda edges: F.transform(F.filter(edges, lambda x: Packed.span(x) == s * 64 + e), Packed.id)
            single = let(F.col("unit").substr(s + 1, F.lit(1)), lambda c: F.when(F.octet_length(c) == 1, F.filter(F.array(F.get(F.lit(vocab.ascii_ids()), F.ascii(c))), lambda x: x >= 0)).otherwise(among(F.col("singles"))))
            return F.when(e - s == 1, single).otherwise(among(F.col("edges")))

        mask = merged_at_once(F.col("edges"), n)
    else:

        def found(s: Column, e: Column) -> Column:
            return F.transform(F.filter("edges", lambda x: (x["s"] == s) & (x["e"] == e)), lambda x: x["id"])

        mask = viterbi(F.col("edges"), n, vocab.floor())
    whole = let(mask, lambda m: let(bits_of(m), lambda bits: ids_along(found, bits)))
    if not bytes_:
        # the library joins neighbouring unknown characters
        whole = let(whole, lambda w: F.filter(F.transform(w, lambda x, i: F.when((x == vocab.unknown) & (i > 0) & (F.get(w, i - 1) == vocab.unknown), -1).otherwise(x)), lambda x: x >= 0))
    return grouped.select("unit", "n", F.when(F.col("folded").isNull(), whole).otherwise(F.col("folded")).alias("ids"))


# --- applying the units to the texts ---------------------------------------------------------


def _joined_lists(at: np.ndarray, starts: np.ndarray, flat: np.ndarray):
    """The lists number ``at`` one after the other, and where each ends."""
    per = np.diff(starts)[at]
    ends = np.concatenate(([0], np.cumsum(per)))
    take = np.repeat(starts[:-1][at] - ends[:-1], per) + np.arange(ends[-1])
    return flat[take], ends


class Names:
    """Places of strings in a long array; unlike ``index_in`` its table is made once, not for each batch."""

    def __init__(self, names: pa.Array):
        self.names = names
        hashed = tokens.hashes(names)
        self.order = np.argsort(hashed, kind="stable")
        self.hashed = hashed[self.order]

    def places(self, wanted: pa.Array) -> np.ndarray:
        """The place of each, -1 where it isn't there."""
        if not len(self.names):
            return np.full(len(wanted), -1)
        hashed = tokens.hashes(wanted)
        at = np.minimum(np.searchsorted(self.hashed, hashed), len(self.order) - 1)
        there = self.hashed[at] == hashed
        at = self.order[at]
        same = pc.equal(self.names.take(pa.array(at)), wanted).to_numpy(zero_copy_only=False)
        out = np.where(there & same, at, -1)
        if len(odd := np.flatnonzero(there & ~same)):  # another string of the same hash
            out[odd] = pc.index_in(wanted.take(pa.array(odd)), value_set=self.names).fill_null(-1).to_numpy()
        return out


class Codes:
    """Numbers for ids, the smaller the more frequent, from 1 on; 0 is a hole. Packed, a number takes a byte for each 7 of its bits."""

    def __init__(self, counts: np.ndarray):
        self.ids = np.append(-1, np.argsort(-counts, kind="stable")).astype(np.int32)
        self.of = np.empty(len(counts), np.int32)
        self.of[self.ids[1:]] = np.arange(1, len(self.ids))

    @staticmethod
    def packed(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes, and where the code of each place begins, with the end."""
        size = (codes >= 1 << 7).astype(np.uint8) + (codes >= 1 << 14) + np.uint8(1)
        begin = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(size, out=begin[1:])
        data = np.empty(int(begin[-1]), np.uint8)
        data[begin[:-1]] = codes & 127 | np.where(size > 1, 128, 0)
        for k in (1, 2):
            at = np.flatnonzero(size > k)
            data[begin[at] + k] = codes[at] >> 7 * k & 127 | np.where(size[at] > k + 1, 128, 0)
        return data, begin

    @staticmethod
    def unpacked(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes, and how many end before each byte, with the end."""
        last = data < 128
        ends = np.zeros(len(data) + 1, np.int32)
        np.cumsum(last, out=ends[1:])
        stop = np.flatnonzero(last).astype(np.int32)
        at = np.concatenate((np.zeros(1, np.int32), stop[:-1] + np.int32(1))) if len(stop) else stop
        low = data & np.uint8(127)
        codes = low[at].astype(np.int32)
        for k in (1, 2):
            go = np.flatnonzero(stop - at >= k)
            codes[go] |= low[at[go] + k].astype(np.int32) << 7 * k
        return codes, ends


def replacer(shared, cuts: str, newline: bool, marked: bool, codes: Codes, only_rare: bool = False):
    """Documents to packed codes of ids with a hole for each unit that isn't among the hot ones; or to their keys and those units alone."""
    ready: list = []

    def run(batches):
        press = zstandard.ZstdCompressor(level=1)
        if not ready:
            with pa.ipc.open_stream(pa.py_buffer(shared.value)) as reader:
                hot = reader.read_all().combine_chunks()
            lists = hot.column("ids").combine_chunks()
            ready.append((Names(hot.column("unit").combine_chunks().cast(pa.large_string())), lists.offsets.to_numpy().astype(np.int64), np.append(codes.of[lists.flatten().to_numpy()], np.int32(0)).astype(np.uint16 if len(codes.ids) < 1 << 16 else np.int32)))
            del hot, lists
        names, starts, flat = ready[0]
        for batch in bounded(batches, limit=BATCH_BYTES // 2):
            text = batch.column("text")
            at, offsets, units = units_of(text, cuts, newline, marked)
            units = units.cast(pa.large_string())
            where = names.places(units)
            blank = pc.equal(units, "").to_numpy(zero_copy_only=False)
            texts = text.cast(pa.large_binary()).to_pylist()
            key = pa.array([None if t is None else xxhash.xxh3_128_digest(t) for t in texts], pa.binary())
            # two more lists: that of a hole and the empty one
            where[where < 0] = len(starts) - 1
            where[blank] = len(starts)
            if only_rare:
                rare = (where == len(starts) - 1)[at]
                holes = pc.take(units, pa.array(at[rare])).cast(pa.string())
                hole_ends = np.concatenate(([0], np.cumsum(rare)))[offsets]
                yield pa.RecordBatch.from_pydict({"key": key, "rare": pa.ListArray.from_arrays(pa.array(hole_ends.astype(np.int32)), holes)})
                continue
            found, ends = _joined_lists(where[at], np.concatenate((starts, [len(flat), len(flat)])), flat)
            bounds = ends[offsets]
            del at, where, ends, units, blank
            data, begin = Codes.packed(found)
            data, bounds = data.tobytes(), begin[bounds].tolist()
            del found, begin
            out = pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "key": key, "packed": pa.array([None if t is None else press.compress(data[a:b]) for t, a, b in zip(texts, bounds, bounds[1:])], pa.binary())})
            # nothing of the batch is held while the next step is at work
            del text, texts, key, data, bounds, offsets
            yield out

    return run


def decoder(pieces: list[bytes]):
    """ids and their offsets to texts: pieces joined, the first marker dropped."""
    table = pa.array(pieces, pa.large_binary())

    def run(ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        taken = pc.take(table, pa.array(ids, pa.int32()))
        # the bytes of successive pieces lie together
        ends = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
        data = memoryview(taken.buffers()[2]) if len(taken) else b""
        texts = [bytes(data[ends[a] : ends[b]]) if b > a else b"" for a, b in zip(offsets[:-1], offsets[1:])]
        return [x[1:] if x[:1] == b" " else x for x in texts]

    return run


def surface(vocab: Vocabulary) -> list[bytes]:
    """What each id stands for in a decoded text."""
    out = []
    for p, k in zip(vocab.pieces, vocab.kinds):
        out.append(bytes([int(p[3:5], 16)]) if k == 6 else " ⁇ ".encode() if k == 2 else b"" if k == 3 else p.replace(MARK, " ").encode())
    return out


def finisher(pieces: list[bytes], codes: Codes):
    """Fills the holes and decodes the result again."""
    decode = decoder(pieces)

    def run(batches):
        press = zstandard.ZstdDecompressor()
        for batch in bounded(batches, "packed", BATCH_BYTES // 4):
            parts = [press.decompress(b) if b else b"" for b in batch.column("packed").to_pylist()]
            found, ends = Codes.unpacked(np.frombuffer(b"".join(parts), np.uint8))
            offsets = ends[np.concatenate(([0], np.cumsum([len(x) for x in parts])))]
            flat = codes.ids[found]
            if "fill" in batch.schema.names:
                # holes and what fills them are in the same order: by document and place
                fills = batch.column("fill")
                each, size = fills.flatten(), pc.fill_null(pc.list_value_length(fills), 0).to_numpy(zero_copy_only=False)
                order = np.lexsort((each.field("pos").to_numpy(), np.repeat(np.arange(len(size)), size)))
                lists = each.field("ids").take(pa.array(order))
                per = np.ones(len(flat), np.int64)
                holes = np.flatnonzero(found == 0)
                per[holes] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
                hole = np.repeat(found == 0, per)
                grown = np.concatenate(([0], np.cumsum(per)))
                flat, offsets = np.repeat(flat, per), grown[offsets]
                flat[hole] = lists.flatten().to_numpy(zero_copy_only=False)
            sizes, offsets = np.diff(offsets).astype(np.int32), offsets.astype(np.int32)
            keys = batch.column("key").to_pylist()
            texts = decode(flat, offsets)
            null = pa.array([k is None for k in keys], pa.bool_())
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_pieces": pc.if_else(null, pa.scalar(None, pa.int32()), pa.array(sizes, pa.int32())),
                    "pieces": pc.if_else(null, pa.scalar(None, lists.type), lists),
                    "exact": pa.array([None if k is None else xxhash.xxh3_128_digest(t) == k for k, t in zip(keys, texts)], pa.bool_()),
                }
            )

    return run


def encode(docs: DataFrame, model: str = MODEL, hot: int = HOT) -> DataFrame:
    """doc_id, n_pieces, pieces, exact: see the module's docstring."""
    spark = docs.sparkSession
    vocab = Vocabulary.load(model)
    how = (vocab.cuts, vocab.alone_newline, vocab.marked)
    clean = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars = clean.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    units = clean.select("text").mapInArrow(lister(vocab), "unit string, n long, folded array<int>").repartition(max(8, chars // TASK_CHARS + 1), "unit").groupBy("unit", "folded").agg(F.sum("n").alias("n"))
    # lists of edges are kept by unit in memory up to a number of units; beyond, Spark sorts
    with setting(spark, "spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(UNITS_HELD)):
        lattice = written(encoded_units(units, vocab), "units")
    total = lattice.count()
    common = lattice.orderBy(F.desc("n"), "unit").limit(hot) if total > hot else lattice
    # at most ``hot`` units, packed, go to the driver and from there to all executors
    with setting(spark, CLEANUP, "true"):
        table = common.select("unit", "ids", "n").toArrow()
    counts = np.zeros(len(vocab.pieces))
    for batch in table.to_batches():
        lists = batch.column("ids")
        each = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        counts += np.bincount(lists.flatten().to_numpy(), np.repeat(batch.column("n").to_numpy(), each), len(counts))
    kept = {"unit": pa.string(), "ids": pa.list_(pa.int32())}
    table = table.select(list(kept)).cast(pa.schema(kept))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    del table
    shared = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())
    del sink
    tokens.release()  # else the driver keeps it for the stages after
    codes = Codes(counts)
    replace, finish = replacer(shared, *how, codes), finisher(surface(vocab), codes)
    done = "doc_id long, n_pieces int, pieces array<int>, exact boolean"
    if total <= hot:
        # no holes: both steps in one worker
        return clean.mapInArrow(lambda batches: finish(replace(batches)), done)
    rare = clean.select("text").mapInArrow(replacer(shared, *how, codes, True), "key binary, rare array<string>").filter("size(rare) > 0")
    places = rare.dropDuplicates(["key"]).select("key", F.posexplode("rare").alias("pos", "unit"))
    # written, so that the files of its shuffles are gone before those of the texts are made
    fills = written(places.join(lattice.select("unit", "ids"), "unit").groupBy("key").agg(F.collect_list(F.struct("pos", "ids")).alias("fill")), "fills")
    filled = clean.mapInArrow(replace, "doc_id long, key binary, packed binary").join(fills, "key", "left")
    return filled.select("doc_id", "key", "packed", F.coalesce("fill", F.array().cast("array<struct<pos:int,ids:array<int>>>")).alias("fill")).mapInArrow(finish, done)


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """The input's columns with ``text``, decoded from ``pieces``; null for null pieces, "" for none."""
    run = decoder(surface(Vocabulary.load(model)))
    names = [c for c in encoded.columns if c != "text"]
    schema = ", ".join(f"`{c}` {t}" for c, t in encoded.dtypes if c != "text") + ", text string"

    def texts(batches):
        for batch in batches:
            lists = batch.column("pieces")
            full = pc.fill_null(lists, pa.scalar([], lists.type))
            flat, offsets = full.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(pc.list_value_length(full).to_numpy(zero_copy_only=False))))
            out = [None if not ok else t.decode("utf-8", "replace") for ok, t in zip(lists.is_valid().to_pylist(), run(flat, offsets))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.string())], names=[*names, "text"])

    return encoded.select(*names).mapInArrow(texts, schema)


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
