"""Exact n-gram Jaccard self-join by partitioning the universe of n-grams.

A text is the set of hashes of its ``n``-grams of tokens. Sets are put into bands
by size. The universe is hashed into m segments, as many as the band needs: two
sets of Jaccard similarity t or more differ in at most
H = (1-t)/(1+t) (|x|+|y|) elements, so of segments with thresholds 0 (equal) or
1 (equal but for one element) that sum, each plus one, to more than H, at least
one pair of segments is within its threshold.

Every set is indexed under all its segments, and under the one-deletion
neighbourhoods of the few segments of a band set aside for threshold 1. The
larger set of a pair probes: it picks, by estimated list length, the cheapest
segments whose thresholds add up, so empty and common segments are skipped.
It probes its own band and the next lower one; no partner is further away.
Candidates are cut down without loss by parity sketches: the elements of a set are
hashed into about as many buckets as it has elements, and a bit tells whether a
bucket's count is odd; sets differ in at least as many elements as their sketches
in bits. The rest is verified exactly on the n-gram sets.

Keys travel packed, as one row for a batch and a part of the key space; they are
sorted and matched in numpy.

A key with more than ``HEAVY`` probing sets gives its sets and not their pairs, so that
rows grow with the sets of a large group of near copies and not with their square.
Each of these sets is compared with the sets of least hash of two of its heavy keys; those of
similarity ``ALIKE`` or more are connected to families. All pairs of a family are
counted from its n-grams, tile by tile, and leave a tile as links of each set; pairs
of a heavy key from different families are candidates as all others are.

Semantics
  * A token is a run of letters and digits, lower-cased. A text of fewer than n
    tokens has one n-gram, all of it; one without tokens takes no part, as do
    null texts and null ids.
  * Texts with equal sets are copies. The least doc_id of them stands for all.
    ``similar_pairs`` has rows (representative, copy, 1.0) for each copy, and
    (representative, representative, jaccard) for each pair of different sets
    with a similarity of t or more; doc_id < other_id.
  * ``links`` has one row for each document that is similar to another: class_id,
    the least doc_id of its connected documents, and n_links, the number of
    documents similar to it, copies included. Of several texts of an id the links
    add up, and the least class counts.
  * Repeated rows are one document; a doc_id is never paired with itself. Extra
    columns are not looked at; an empty table gives no rows.
  * Hashes have 64 bits; sets that collide on them are taken as equal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .shared import written

N, THRESHOLD = 2, 0.8
#: Rows of keys that one part of the key space is to have, about.
PART_KEYS = 2_000_000
#: Bytes of text whose keys are made at once: each element needs some dozen numbers.
SIGN_BYTES = 3 << 20
#: Needed (block pair, set, document) rows of 24 bytes up to which they are broadcast; beyond, a shuffled join does the same.
BROADCAST_ROWS = 1_000_000
#: Elements of the sets of a block of the verification, about.
BLOCK_GRAMS = 400_000
#: The share of the need that a set may leave out, and of the segments with one-deletion neighbourhoods.
SPARE, DELETIONS = 0.15, 0.05
#: Probing sets of a key above which its pairs aren't listed; similarity from which sets belong to a family; sets and elements of a tile of a family.
HEAVY, ALIKE, TILE_SETS, TILE_GRAMS = 64, 0.5, 3000, 1_000_000
PACKED = "part int, keys binary, ids binary, metas binary, sketches binary"
FOUND = "kind int, a long, b long, n int, sketch binary"


def band_edges(t: float, top: int = 1 << 28) -> np.ndarray:
    """Least sizes of bands: sets of similarity t lie in one band or in neighbours."""
    edges = [1]
    while edges[-1] < top:
        edges.append(int(math.floor(edges[-1] / t + 1e-9)) + 1)
    return np.array(edges, np.int64)


def difference_bound(x, y, t: float):
    """The most elements in which sets of these sizes may differ."""
    return np.floor((1 - t) / (1 + t) * (np.asarray(x, float) + y) + 1e-9).astype(np.int64)


def layout(edges: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(segments, how many of them have one-deletion neighbourhoods) by band.

    The cost of a segment more is a key for each set; that of a one-deletion
    segment, which counts twice, a key for each of its elements. The fewer the
    segments, the more elements each has, and the rarer are its keys. ``SPARE`` of
    the need may be skipped, so that empty and common segments needn't be probed.
    """
    top = np.append(edges[1:], edges[-1] * 2) - 1
    need = difference_bound(top, top / t, t) + 1
    gain = need + np.ceil(need * SPARE).astype(np.int64)
    segments = np.maximum(np.ceil(gain / (1 + DELETIONS)).astype(np.int64), 1)
    return segments, gain - segments


def sets_of(text, n: int):
    """(grams, offsets) of a text column: the distinct n-gram hashes of each text, sorted."""
    ids, offsets, words = tokens.encode(text)
    hashed = tokens.hashes(words)[ids] if len(words) else np.zeros(0, np.uint64)
    wide = tokens.grams(hashed, n)
    out, ends = [], [0]
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= n:
            g = np.unique(wide[a : b - n + 1])
        else:
            g = tokens.grams(hashed[a:b], int(b - a)) if b > a else wide[:0]
        out.append(g)
        ends.append(ends[-1] + len(g))
    return (np.concatenate(out) if out else wide[:0]), np.array(ends, np.int64)


def sketch_bits(size):
    """Bits of the parity sketch of sets of so many elements: a power of 2, 64 at least."""
    return np.maximum(64, 1 << np.ceil(np.log2(np.maximum(1, 0.75 * np.asarray(size, np.float64)))).astype(np.int64))


def sketches(g: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """The parity sketch of each set."""
    size = np.diff(offsets)
    bits = sketch_bits(size)
    ends = np.concatenate(([0], np.cumsum(bits)))
    owner = np.repeat(np.arange(len(size)), size)
    slot = (tokens.mixed(g + np.uint64(0x5851F42D4C957F2D)) & (bits[owner] - 1).astype(np.uint64)).astype(np.int64) + ends[owner]
    parity = np.packbits((np.bincount(slot, minlength=int(ends[-1])) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [parity[a // 8 : b // 8] for a, b in zip(ends[:-1], ends[1:])]


def odd_buckets(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """In how many bits the sketches of pairs differ; the larger one is folded."""
    la, lb = (np.array([len(x) for x in y], np.int64) for y in (a, b))
    out = np.zeros(len(a), np.int64)
    for m, n in set(zip(la.tolist(), lb.tolist())):
        at = np.flatnonzero((la == m) & (lb == n))
        x, y = (np.frombuffer(b"".join([z[i] for i in at]), np.uint8).reshape(len(at), -1, min(m, n)) for z in (a, b))
        out[at] = np.bitwise_count(np.bitwise_xor.reduce(x, 1) ^ np.bitwise_xor.reduce(y, 1)).sum(1)
    return out


def sifter(t: float):
    """Candidates (with sizes and sketches) to those that may be similar."""

    def run(batches):
        for batch in batches:
            size = [batch.column(c).to_numpy().astype(np.int64) for c in ("na", "nb")]
            ok = odd_buckets(batch.column("ka").to_pylist(), batch.column("kb").to_pylist()) <= difference_bound(*size, t)
            yield batch.select(["sa", "sb", "da", "db", "na", "nb"]).filter(pa.array(ok))

    return run


def set_ids(g: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(tokens.mixed(g + tokens.MIX), dtype=np.uint64)))
    return tokens.mixed(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64))


def _segments(g, owner, size_n, base, count, salt):
    """Segment slot of each element, and sum and count of each slot; slots of a set begin at ``base``."""
    where = ((tokens.mixed(g ^ salt[owner]) >> np.uint64(33)) * count[owner].astype(np.uint64)) >> np.uint64(31)
    slot = base[owner] + where.astype(np.int64)
    inner = tokens.mixed(g + salt[owner])
    order = np.argsort(slot, kind="stable")
    slot, inner = slot[order], inner[order]
    cuts = np.flatnonzero(np.diff(slot, prepend=-1))
    sums = np.zeros(size_n, np.uint64)
    held = np.zeros(size_n, np.int64)
    if len(cuts):
        sums[slot[cuts]] = np.add.reduceat(inner, cuts)
        held[slot[cuts]] = np.diff(np.append(cuts, len(slot)))
    return slot, inner, order, sums, held


def keys_of(g: np.ndarray, offsets: np.ndarray, t: float):
    """(key, set number, probes, is indexed) of all sets of a batch."""
    edges = band_edges(t)
    segments, deletions = layout(edges, t)
    size = np.diff(offsets)
    band = np.searchsorted(edges, size, "right") - 1
    # how common an element is, as far as this batch tells: it only steers the choice of segments
    bucket = (g & np.uint64((1 << 20) - 1)).astype(np.int64)
    common = np.bincount(bucket, minlength=1 << 20)[bucket]
    out = []
    for lower in (0, 1):
        at = band - lower
        bound_y = size if not lower else edges[band] - 1
        use = (size > 0) & (at >= 0)
        if lower:
            use &= np.ceil(t * size - 1e-9) <= bound_y
        docs = np.flatnonzero(use)
        if not len(docs):
            continue
        at, count, spare = at[docs], segments[at[docs]], deletions[at[docs]]
        need = difference_bound(size[docs], bound_y[docs], t) + 1
        number = np.full(len(size), -1)
        number[docs] = np.arange(len(docs))
        element = np.repeat(number, size)
        mine = element >= 0
        owner, elements, freq = element[mine], g[mine], common[mine]
        base = np.concatenate(([0], np.cumsum(count)))
        salt = tokens.mixed((at + 1).astype(np.uint64) * tokens.MIX)
        slot, inner, order, sums, held = _segments(elements, owner, int(base[-1]), base, count, salt)
        of = np.repeat(np.arange(len(docs)), count)
        place = np.arange(int(base[-1])) - base[of]
        full = tokens.mixed(sums + tokens.mixed(salt[of] + place.astype(np.uint64)))
        cuts = np.flatnonzero(np.diff(slot, prepend=-1))
        cost = np.full(int(base[-1]), 1e9)
        if len(cuts):
            cost[slot[cuts]] = np.minimum.reduceat(freq[order], cuts)
        # allocation: threshold 0 adds 1 and costs the list of the segment; threshold 1 adds 1 more and costs those of its neighbourhood
        double = np.flatnonzero(place < spare[of])
        more = np.full(int(base[-1]), 1e18)
        if len(cuts):
            # without its rarest element a segment is as rare as its second rarest
            two_rarest = np.lexsort((freq[order], slot))
            second = np.minimum(cuts + 1, len(slot) - 1)
            more[slot[cuts]] = np.where(held[slot[cuts]] > 1, freq[order][two_rarest][second] + held[slot[cuts]], 1e12)
        price, whose = np.concatenate((cost, np.maximum(more, cost)[double])), np.concatenate((of, of[double]))
        rank = np.lexsort((price, whose))
        before = np.arange(len(rank)) - np.searchsorted(whose[rank], whose[rank])
        taken = np.zeros(len(rank), bool)
        taken[rank] = before < need[whose[rank]]
        chosen = taken[: len(of)]
        real = docs[of]
        two = np.zeros(len(of), bool)
        two[double] = taken[len(of) :]
        double = place < spare[of]
        dele = double[slot]
        removed = tokens.mixed(sums[slot] - inner + tokens.mixed(salt[of[slot]] + place[slot].astype(np.uint64)))
        deletion = np.uint64(0xD1B54A32D192ED03)
        if not lower:
            out.append((full, real, chosen, np.ones(len(full), bool)))
            out.append((removed[dele] ^ deletion, real[slot[dele]], np.zeros(int(dele.sum()), bool), np.ones(int(dele.sum()), bool)))
        else:
            out.append((full[chosen], real[chosen], np.ones(int(chosen.sum()), bool), np.zeros(int(chosen.sum()), bool)))
        k = dele & two[slot]
        for keys, who in ((full[two] ^ deletion, real[two]), (removed[k], real[slot[k]])):
            out.append((keys, who, np.ones(len(keys), bool), np.zeros(len(keys), bool)))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool)
    return tuple(np.concatenate([x[i] for x in out]) for i in range(4))


def pack_keys(part: np.ndarray, keys: np.ndarray, who: np.ndarray, flags: np.ndarray, sids: np.ndarray, size: np.ndarray) -> pa.RecordBatch:
    """A row for each part: 40 bits of each key and its flags, and each set once with its size and the number of its keys."""
    order = np.lexsort((who, part))
    part, who = part[order], who[order]
    short = np.ascontiguousarray(keys[order]).view(np.uint8).reshape(-1, 8)[:, :5]
    flags = flags[order].astype(np.uint8)
    cuts = np.flatnonzero(np.diff(part, prepend=part[:1] - 1))
    ends = np.append(cuts[1:], len(part))
    run = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (who[1:] != who[:-1]))[: len(part)])
    count = np.diff(np.append(run, len(part))).astype(np.int32)
    a, b = np.searchsorted(run, cuts), np.searchsorted(run, ends)
    sets, sizes = sids[who[run]], np.minimum(size[who[run]], (1 << 29) - 1).astype(np.int32)
    columns = {
        "keys": [short[i:j].tobytes() for i, j in zip(cuts, ends)],
        "ids": [sets[i:j].tobytes() for i, j in zip(a, b)],
        "metas": [flags[i:j].tobytes() for i, j in zip(cuts, ends)],
        "sketches": [sizes[i:j].tobytes() + count[i:j].tobytes() for i, j in zip(a, b)],
    }
    return pa.RecordBatch.from_pydict({"part": pa.array(part[cuts].astype(np.int32)), **{n: pa.array(x, pa.binary()) for n, x in columns.items()}})


def unpack_keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, set ids, size << 2 | flags) of the rows of a part."""
    short = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.uint8).reshape(-1, 5)
    keys = np.zeros((len(short), 8), np.uint8)
    keys[:, :5] = short
    flags = np.frombuffer(b"".join(table.column("metas").to_pylist()), np.uint8).astype(np.int32)
    sets = np.frombuffer(b"".join(table.column("ids").to_pylist()), np.int64)
    halves = [np.frombuffer(b, np.int32).reshape(2, -1) for b in table.column("sketches").to_pylist()]
    sizes, count = np.concatenate(halves, 1) if halves else np.zeros((2, 0), np.int32)
    return keys.view(np.uint64).ravel(), np.repeat(sets, count), np.repeat(sizes << 2, count) | flags


def signer(n: int, t: float, parts: int, member_parts: int):
    """Documents to packed keys, and to (set, document) under negative parts."""

    def pack(part, keys, ids, metas, own=None):
        order = np.argsort(part, kind="stable")
        part, keys, ids, metas = part[order], keys[order], ids[order], metas[order]
        cuts = np.flatnonzero(np.diff(part, prepend=part[:1] - 1))
        ends = np.append(cuts[1:], len(part))
        return pa.RecordBatch.from_pydict(
            {
                "part": pa.array(part[cuts].astype(np.int32)),
                "keys": pa.array([keys[i:j].tobytes() for i, j in zip(cuts, ends)], pa.binary()),
                "ids": pa.array([ids[i:j].tobytes() for i, j in zip(cuts, ends)], pa.binary()),
                "metas": pa.array([metas[i:j].tobytes() for i, j in zip(cuts, ends)], pa.binary()),
                "sketches": pa.array([b"".join(own[k] for k in order[i:j]) if own else b"" for i, j in zip(cuts, ends)], pa.binary()),
            }
        )

    def run(batches):
        for batch in tokens.bounded(batches, limit=SIGN_BYTES):
            g, offsets = sets_of(batch.column("text"), n)
            docs = batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            sids = set_ids(g, offsets)
            size = np.diff(offsets)
            # copies in this batch need their keys only once
            some = np.flatnonzero(size > 0)
            if not len(some):
                continue
            yield pack(-1 - (sids[some] % np.uint64(member_parts)).astype(np.int32), sids[some], docs[some], size[some].astype(np.int32), sketches(g, np.append(offsets[some], offsets[-1])))
            first = some[np.unique(sids[some], return_index=True)[1]]
            first.sort()
            keep = np.zeros(len(size), bool)
            keep[first] = True
            lean = g[np.repeat(keep, size)]
            off = np.concatenate(([0], np.cumsum(size[first])))
            keys, who, probe, index = keys_of(lean, off, t)
            if len(keys):
                yield pack_keys((keys % np.uint64(parts)).astype(np.int32), keys // np.uint64(parts), who, probe << 1 | index, sids[first].view(np.int64), size[first])

    return run


def merged_keys(keys, ids, metas) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, sets and flags in order; the same set under the same key, from copies in other batches, is one of joined flags."""
    order = np.lexsort((ids, keys))
    keys, ids, metas = keys[order], ids[order], metas[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])
    cuts = np.flatnonzero(fresh)
    return keys[cuts], ids[cuts], np.bitwise_or.reduceat(metas, cuts) if len(cuts) else metas


def heavy_keys(keys: np.ndarray, metas: np.ndarray, heavy: int) -> np.ndarray:
    """Which of the sorted rows belong to a key with more than ``heavy`` probing sets."""
    if not len(keys):
        return np.zeros(0, bool)
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return np.repeat(np.add.reduceat(metas >> 1 & 1, starts) > heavy, np.diff(np.append(starts, len(keys))))


def allowed(ma: np.ndarray, mb: np.ndarray, t: float) -> np.ndarray:
    """Whether the larger set probes, the other one is indexed and the sizes may go together."""
    sa, sb = ma >> 2, mb >> 2
    ok = ((ma & 2) > 0) & ((mb & 1) > 0) & (sb <= sa) | ((mb & 2) > 0) & ((ma & 1) > 0) & (sa <= sb)
    return ok & (np.minimum(sa, sb) >= np.ceil(t * np.maximum(sa, sb) - 1e-9))


def candidate_pairs(keys, ids, metas, t: float, chunk: int = 2_000_000):
    """Arrays of (a, b), a < b, of sets that a probe joins; each array without repetitions. The rows are those of ``merged_keys``."""
    if not len(keys):
        return
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    length = np.diff(np.append(starts, len(keys)))
    left = np.repeat(starts + length, length) - np.arange(len(keys)) - 1  # rows of the run after this one
    rows = np.flatnonzero(left > 0)
    found, held, d = [], 0, 1
    while len(rows):
        a, b = rows, rows + d
        ok = allowed(metas[a], metas[b], t)
        if ok.any():
            found.append(np.stack([ids[a[ok]], ids[b[ok]]]))
            held += int(ok.sum())
        d += 1
        rows = rows[left[rows] >= d]
        if held > chunk or not len(rows):
            if found:
                both = np.concatenate(found, 1)
                both = both[:, np.lexsort(both)]
                new = np.append(True, (both[:, 1:] != both[:, :-1]).any(0))
                yield both[0, new], both[1, new]
            found, held = [], 0


def matcher(t: float, parts: int, heavy: int):
    """Rows of kind 0: candidates (a, b); 1: set, document, size and sketch; 2: heavy key, set, size << 2 | flags."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        join = lambda c, k: np.frombuffer(b"".join(table.column(c).to_pylist()), k)
        if part < 0:
            keys, ids, metas = join("keys", np.uint64), join("ids", np.int64), join("metas", np.int32)
            a, b, sizes, kind = [keys.view(np.int64)], [ids], metas, np.full(len(keys), 1, np.int32)
            own, ends = b"".join(table.column("sketches").to_pylist()), np.concatenate(([0], np.cumsum(sketch_bits(metas) // 8)))
            first = set(np.unique(keys, return_index=True)[1].tolist())
            sketch = [own[ends[i] : ends[i + 1]] if i in first else None for i in range(len(keys))]
        else:
            keys, ids, metas = merged_keys(*unpack_keys(table))
            many = heavy_keys(keys, metas, heavy)
            a, b, sketch = [(keys[many] * np.uint64(parts) + np.uint64(part)).view(np.int64)], [ids[many]], None
            for x, y in candidate_pairs(keys[~many], ids[~many], metas[~many], t):
                a.append(x)
                b.append(y)
            sizes = np.zeros(sum(map(len, a)), np.int32)
            kind = np.zeros(len(sizes), np.int32)
            sizes[: len(a[0])], kind[: len(a[0])] = metas[many], 2
        a, b = np.concatenate(a), np.concatenate(b)
        return pa.table({"kind": kind, "a": a, "b": b, "n": sizes, "sketch": pa.array(sketch or [None] * len(a), pa.binary())})

    return run


def crosser(t: float, chunk: int = 1_000_000):
    """Sets of heavy keys with their families to the candidates of different families."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        key, sid, meta, family = (table.column(c).to_numpy() for c in ("key", "sid", "meta", "family"))
        order = np.lexsort((family, key))
        key, sid, meta, family = key[order], sid[order], meta[order], family[order]
        new = np.append(True, key[1:] != key[:-1])
        ends = lambda first: np.repeat(np.append(np.flatnonzero(first)[1:], len(key)), np.diff(np.append(np.flatnonzero(first), len(key))))
        begin = ends(new | np.append(True, family[1:] != family[:-1]))
        count = ends(new) - begin
        total = np.concatenate(([0], np.cumsum(count)))
        for i, j in tokens.slices(total, chunk):
            n = count[i:j]
            a = np.repeat(np.arange(i, j), n)
            b = np.repeat(begin[i:j] - total[i:j], n) + np.arange(total[i], total[j])
            ok = allowed(meta[a], meta[b], t)
            if ok.any():
                x, y = sid[a[ok]], sid[b[ok]]
                yield pa.RecordBatch.from_pydict({"sa": np.minimum(x, y), "sb": np.maximum(x, y)})

    return run


def liker(least: float):
    """Pairs of sets with their n-grams to those of a similarity."""

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("grams").to_pylist(), batch.column("others").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= least * (len(x) + len(y) - both))
            a, b = (batch.column(c).to_numpy()[np.array(ok, bool)] for c in ("sid", "hub"))
            yield pa.RecordBatch.from_pydict({"doc_id": np.minimum(a, b), "other_id": np.maximum(a, b)})

    return run


def intersections(a: list[np.ndarray], b: list[np.ndarray], columns: int = 512, chunk: int = 2_000_000) -> np.ndarray:
    """How many elements each set of ``a`` shares with each of ``b``: frequent ones by products of matrices, the others one by one."""
    ra, rb = (np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in (a, b))
    found, at = np.unique(np.concatenate(a + b), return_inverse=True)
    ia, ib = at[: len(ra)], at[len(ra) :]
    fa, fb = (np.bincount(x, minlength=len(found)) for x in (ia, ib))
    out = np.zeros((len(a), len(b)), np.float32)
    dense = (fa > 0) & (fb > 0) & (100 * fa * fb >= len(a) * len(b))
    wanted = np.flatnonzero(dense)
    for k in range(0, len(wanted), columns):
        place = np.full(len(found), -1)
        place[wanted[k : k + columns]] = np.arange(len(wanted[k : k + columns]))
        sides = []
        for rows, i, n in ((ra, ia, len(a)), (rb, ib, len(b))):
            some = np.flatnonzero(place[i] >= 0)
            sides.append(np.zeros((n, len(wanted[k : k + columns])), np.float32))
            sides[-1][rows[some], place[i[some]]] = 1
        out += sides[0] @ sides[1].T
    by = np.argsort(ib, kind="stable")
    first = np.concatenate(([0], np.cumsum(fb)))
    some = np.flatnonzero(~dense[ia] & (fb[ia] > 0))
    total = np.concatenate(([0], np.cumsum(fb[ia[some]])))
    for i, j in tokens.slices(total, chunk):
        n = fb[ia[some[i:j]]]
        y = rb[by[np.repeat(first[ia[some[i:j]]] - total[i:j], n) + np.arange(total[i], total[j])]]
        np.add.at(out.reshape(-1), np.repeat(ra[some[i:j]], n) * len(b) + y, np.float32(1))
    return out


def tile_links(table: pa.Table, t: float, rows: int = 256):
    """Of the sets of two tiles (rep, size), or of one: both sides, the Jaccard similarity of each pair and which are linked, by blocks of rows."""
    tile = table.column("tile").to_numpy()
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    grams = [np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()]
    a, b = np.flatnonzero(tile == i), np.flatnonzero(tile == j)
    if not len(a) or not len(b):
        return
    both = intersections([grams[k] for k in a], [grams[k] for k in b])
    size = np.array([len(g) for g in grams], np.float64)
    for k in range(0, len(a), rows):
        shared = both[k : k + rows].astype(np.float64)
        score = shared / (size[a[k : k + rows], None] + size[b] - shared)
        yield a[k : k + rows], b, score, (score >= t - 1e-12) & (a[k : k + rows, None] != b)


def family_pairs(t: float):
    """The pairs of a tile."""

    def run(table: pa.Table) -> pa.Table:
        rep, out = table.column("rep").to_numpy(), []
        one = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        for a, b, score, ok in tile_links(table, t):
            x, y = np.nonzero(ok & (rep[a][:, None] < rep[b]) if one else ok)
            out.append((rep[a[x]], rep[b[y]], score[x, y]))
        x, y, score = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"doc_id": np.minimum(x, y), "other_id": np.maximum(x, y), "jaccard": score})

    return run


def family_links(t: float):
    """The links of each set in a tile, copies of the others included, and the least document that it is connected to."""

    def run(table: pa.Table) -> pa.Table:
        rep, size = table.column("rep").to_numpy(), table.column("size").to_numpy().astype(np.float64)
        one = table.column("i")[0].as_py() == table.column("j")[0].as_py()
        far, parts = np.zeros(len(rep)), []
        for a, b, _, ok in tile_links(table, t):
            far[a] += ok @ size[b]
            if not one:
                far[b] += size[a] @ ok
            parts.append((a, b, ok))
        root = rep.copy()
        while True:
            was = root.copy()
            for a, b, ok in parts:
                root[a] = np.minimum(root[a], np.where(ok, root[b], np.iinfo(np.int64).max).min(1))
                root[b] = np.minimum(root[b], np.where(ok, root[a][:, None], np.iinfo(np.int64).max).min(0))
            if (was == root).all():
                break
        some = far > 0
        return pa.table({"rep": rep[some], "far": far[some].astype(np.int64), "root": root[some]})

    return run


def gram_maker(n: int):
    def run(batches):
        for batch in tokens.bounded(batches):
            g, offsets = sets_of(batch.column("text"), n)
            sids = set_ids(g, offsets).view(np.int64)
            ok = np.flatnonzero(sids == batch.column("sid").to_numpy())
            yield pa.RecordBatch.from_pydict(
                {
                    "k": batch.column("k").take(pa.array(ok)),
                    "sid": pa.array(sids[ok]),
                    "grams": pa.array([g[offsets[i] : offsets[i + 1]].tobytes() for i in ok], pa.binary()),
                }
            )

    return run


def verifier(t: float):
    """Pairs and sets of a block pair to the pairs of similarity t or more."""

    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        number: dict[int, int] = {}
        arrays = []
        for sid, b in zip(sets.column("sid").to_pylist(), sets.column("grams").to_pylist()):
            if sid not in number:
                number[sid] = len(arrays)
                arrays.append(np.frombuffer(b, np.uint64))
        size = np.array([len(x) for x in arrays], np.int64)
        dense = np.unique(np.concatenate(arrays), return_inverse=True)[1] if arrays else np.zeros(0, np.int64)
        ends = np.concatenate(([0], np.cumsum(size)))
        a = np.array([number[x] for x in pairs.column("sa").to_pylist()], np.int64)
        b = np.array([number[x] for x in pairs.column("sb").to_pylist()], np.int64)
        order = np.argsort(a, kind="stable")
        score = np.zeros(len(a))
        mark = np.zeros(int(dense.max()) + 1 if len(dense) else 0, np.int64)
        cuts = np.append(np.flatnonzero(np.diff(a[order], prepend=-1)), len(a))
        for i, j in zip(cuts[:-1], cuts[1:]):
            mine = order[i:j]
            x = a[mine[0]]
            mark[dense[ends[x] : ends[x + 1]]] = 1
            for q in mine:
                y = b[q]
                both = int(mark[dense[ends[y] : ends[y + 1]]].sum())
                score[q] = both / (size[x] + size[y] - both)
            mark[dense[ends[x] : ends[x + 1]]] = 0
        ok = np.flatnonzero(score >= t - 1e-12)
        part = pairs.take(pa.array(ok))
        da, db = part.column("da").to_numpy(), part.column("db").to_numpy()
        return pa.table({"doc_id": np.minimum(da, db), "other_id": np.maximum(da, db), "jaccard": score[ok]})

    return run


def _families(clean: DataFrame, heavy: DataFrame, reps: DataFrame, members: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(set and family, tiles of families) of the sets of heavy keys."""
    # an id of several texts may stand for several sets, whose links become one: these stay pairs
    lone = reps.groupBy("rep").agg(F.min("sid").alias("sid"), F.count("*").alias("sets")).filter("sets = 1").select("rep", "sid")
    sizes = members.groupBy("sid").agg(F.count("*").alias("size"))
    wanted = written(heavy.select("sid").distinct().join(lone, "sid").join(sizes, "sid").select("sid", "rep", "size"), "wanted")
    few = wanted.count() <= BROADCAST_ROWS
    near = F.broadcast(wanted) if few else wanted
    texts = clean.join(near, clean["doc_id"] == near["rep"]).select(F.lit(0).cast("long").alias("k"), "sid", "text")
    grams = written(texts.mapInArrow(gram_maker(n), "k long, sid long, grams binary").dropDuplicates(["sid"]).select("sid", "grams"), "grams")
    held = heavy.join(near.select("sid"), "sid")
    hubs = held.groupBy("key").agg(F.min_by("sid", F.xxhash64("sid")).alias("hub"))
    two = F.slice(F.array_sort(F.collect_set(F.struct(F.xxhash64("hub").alias("h"), "hub"))), 1, 2)
    stars = held.join(hubs, "key").filter("sid <> hub").groupBy("sid").agg(two.alias("two")).select("sid", F.explode("two").alias("hub")).select("sid", "hub.hub")
    others = grams.select(F.col("sid").alias("hub"), F.col("grams").alias("others"))
    like = stars.join(grams, "sid").join(others, "hub").select("sid", "hub", "grams", "others").mapInArrow(liker(ALIKE), "doc_id long, other_id long")
    families = written(groups(like).select(F.col("doc_id").alias("sid"), F.col("group").alias("family")), "families")
    rows = families.join(wanted, "sid").join(grams, "sid")
    tiles = rows.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / TILE_SETS, F.sum(F.length("grams")) / 8 / TILE_GRAMS)).cast("int").alias("tiles"))
    rows = rows.join(tiles, "family").withColumn("tile", F.pmod(F.xxhash64("sid"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return families, rows.select("family", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "rep", "size", "grams")


def _joined(docs: DataFrame, n: int, t: float, heavy: int) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """(pairs of representatives with their similarity, tiles of families that have more pairs, members of each representative's set)."""
    clean = docs.select(F.col("doc_id").cast("long"), "text").filter("doc_id is not null and text is not null")
    chars = clean.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    # about one key for each dozen characters; the parts grow in number, not in size
    parts = max(8, int(chars / 12 / PART_KEYS) + 1)
    packed = clean.mapInArrow(signer(n, t, parts, max(4, parts // 8)), PACKED)
    found = written(packed.groupBy("part").applyInArrow(tokens.released(matcher(t, parts, heavy)), FOUND), "candidates")
    members = found.filter("kind = 1").select(F.col("a").alias("sid"), F.col("b").alias("doc_id")).distinct()
    reps = found.filter("kind = 1").groupBy(F.col("a").alias("sid")).agg(F.min("b").alias("rep"), F.max("n").alias("n"), F.max("sketch").alias("sketch"))
    candidates = found.filter("kind = 0").select(F.col("a").alias("sa"), F.col("b").alias("sb")).distinct()
    crowded = found.filter("kind = 2").select(F.col("a").alias("key"), F.col("b").alias("sid"), F.col("n").alias("meta"))
    tiles = None
    if (many := crowded.count()):
        families, tiles = _families(clean, crowded, reps.select("sid", "rep"), members, n)
        of = lambda x: families.select(F.col("sid").alias(f"s{x}"), F.col("family").alias(f"f{x}"))
        spread = F.pmod(F.xxhash64("key"), F.lit(max(8, many // 100_000)))
        crossed = crowded.join(families, "sid", "left").select("key", "sid", "meta", F.coalesce("family", "sid").alias("family"))
        crossed = crossed.groupBy(spread).applyInArrow(tokens.released(crosser(t)), "sa long, sb long")
        apart = candidates.join(of("a"), "sa", "left").join(of("b"), "sb", "left").filter("fa is null or fb is null or fa <> fb")
        candidates = apart.select("sa", "sb").union(crossed).distinct()
    side = lambda x: reps.select(F.col("sid").alias(f"s{x}"), F.col("rep").alias(f"d{x}"), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"k{x}"))
    sifted = candidates.join(side("a"), "sa").join(side("b"), "sb").filter("da <> db").mapInArrow(sifter(t), "sa long, sb long, da long, db long, na int, nb int")
    pairs = written(sifted, "pairs")
    # sets go to blocks by their least partner, so that most pairs lie within a block and a set is sent once
    both = pairs.select(F.col("sa").alias("sid"), F.col("sb").alias("other"), "na").union(pairs.select("sb", "sa", "nb"))
    roots = written(both.groupBy("sid").agg(F.min("other").alias("other"), F.max("na").alias("n")).select("sid", F.least("sid", "other").alias("root"), "n"), "roots")
    weights = roots.groupBy("root").agg(F.sum("n").alias("weight"))
    blocks = int((roots.agg(F.sum("n")).first()[0] or 0) // BLOCK_GRAMS) + 1
    # a root of many sets is spread over as many blocks as they need
    part = F.pmod(F.xxhash64("sid"), F.floor(F.col("weight") / BLOCK_GRAMS) + 1)
    placed = roots.join(weights, "root").select("sid", F.pmod(F.xxhash64("root", part), F.lit(blocks)).alias("block"))
    at = lambda x: placed.select(F.col("sid").alias(f"s{x}"), F.col("block").alias(f"b{x}"))
    keyed = pairs.join(at("a"), "sa").join(at("b"), "sb").withColumn("k", F.least("ba", "bb") * blocks + F.greatest("ba", "bb"))
    keyed = written(keyed.select("k", "sa", "sb", "da", "db"), "keyed")
    needed = keyed.select("k", F.col("sa").alias("sid"), F.col("da").alias("d")).union(keyed.select("k", "sb", "db")).distinct()
    needed = written(needed, "needed")
    if needed.count() <= BROADCAST_ROWS:
        needed = F.broadcast(needed)
    texts = clean.join(needed, clean["doc_id"] == needed["d"]).select("k", "sid", "text")
    sets = texts.mapInArrow(gram_maker(n), "k long, sid long, grams binary")
    verified = keyed.groupBy("k").cogroup(sets.groupBy("k")).applyInArrow(tokens.released(verifier(t)), "doc_id long, other_id long, jaccard double")
    return verified.groupBy("doc_id", "other_id").agg(F.max("jaccard").alias("jaccard")), tiles, members.join(reps.select("sid", "rep"), "sid").select("rep", "doc_id")


def similar_pairs(docs: DataFrame, n: int = N, t: float = THRESHOLD, heavy: int = HEAVY) -> DataFrame:
    """doc_id, other_id, jaccard: see the module's docstring."""
    verified, tiles, members = _joined(docs, n, t, heavy)
    if tiles is not None:
        verified = verified.unionByName(tiles.groupBy("family", "i", "j").applyInArrow(tokens.released(family_pairs(t)), "doc_id long, other_id long, jaccard double"))
    copies = members.filter("doc_id <> rep").select(F.col("rep").alias("doc_id"), F.col("doc_id").alias("other_id"), F.lit(1.0).alias("jaccard"))
    return verified.unionByName(copies).groupBy("doc_id", "other_id").agg(F.round(F.max("jaccard"), 6).alias("jaccard"))


def links(docs: DataFrame, n: int = N, t: float = THRESHOLD, heavy: int = HEAVY) -> DataFrame:
    """doc_id, class_id, n_links: see the module's docstring."""
    verified, tiles, members = _joined(docs, n, t, heavy)
    verified, members = written(verified, "verified"), written(members, "members")
    sizes = members.groupBy("rep").agg(F.count("*").alias("size"))
    both = verified.select(F.col("doc_id").alias("a"), F.col("other_id").alias("b")).union(verified.select("other_id", "doc_id"))
    far = both.join(sizes, F.col("b") == F.col("rep")).select(F.col("a").alias("rep"), F.col("size").alias("far"))
    edges = verified.select("doc_id", "other_id")
    if tiles is not None:
        within = written(tiles.groupBy("family", "i", "j").applyInArrow(tokens.released(family_links(t)), "rep long, far long, root long"), "within")
        far = far.union(within.select("rep", "far"))
        edges = edges.union(within.filter("root <> rep").select("root", "rep"))
    far = far.groupBy("rep").agg(F.sum("far").alias("far"))
    linked = sizes.join(far, "rep", "left").select("rep", (F.col("size") - 1 + F.coalesce("far", F.lit(0))).alias("n_links")).filter("n_links > 0")
    roots = groups(edges).select(F.col("doc_id").alias("rep"), "group")
    classes = linked.join(roots, "rep", "left").select("rep", "n_links", F.coalesce("group", "rep").alias("class_id"))
    return members.join(classes, "rep").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.sum("n_links").alias("n_links"))


def groups(pairs: DataFrame) -> DataFrame:
    """doc_id, group: the least doc_id of the connected component, for each document of a pair.

    Star contraction: edges are pointed at the least known member until every
    document points at its root directly; each round is written, which cuts its
    lineage, and the rounds grow with the logarithm of a component's diameter.
    """
    edges = written(pairs.select(F.col("other_id").alias("a"), F.col("doc_id").alias("b")).filter("a > b").distinct(), "edges")
    while True:
        # large star: neighbours above a document, pointed at its least neighbour
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: neighbours below a document and itself, pointed at the least of them
        large = large.filter("a <> b").distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(lower.select("a", "m")).filter("a <> b").distinct()
        new = written(small, "edges")
        was, now = (e.selectExpr("bit_xor(xxhash64(a, b)) as h", "count(*) as n").first() for e in (edges, new))
        edges = new
        if was == now:
            break
    roots = edges.select(F.col("a").alias("doc_id"), F.col("b").alias("group"))
    return roots.union(edges.select(F.col("b").alias("doc_id"), F.col("b").alias("group"))).distinct()


def op8_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """The class and the number of links of each document that has near copies."""
    return links(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
with recursive d as (select distinct doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') as t from documents where doc_id is not null and text is not null),
g as (
  select distinct doc_id, t, array_to_string(t[p : p + {N - 1}], ' ') as gram
  from (select doc_id, t, unnest(case when len(t) < {N} then [1] else range(1, len(t) - {N} + 2) end) as p from d where len(t) > 0)),
s as (select doc_id, t, list_sort(list(gram)) as grams from g group by doc_id, t),
r as (select min(doc_id) as rep, grams, len(grams) as n from s group by grams),
e as (select rep, n, unnest(grams) as gram from r),
p as (
  select a.rep as doc_id, b.rep as other_id, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) as jaccard
  from e a join e b on a.gram = b.gram and a.rep < b.rep and least(a.n, b.n) >= {THRESHOLD} * greatest(a.n, b.n) - 1e-9
  group by a.rep, b.rep, a.n, b.n),
v as (select doc_id, other_id from p where jaccard >= {THRESHOLD} - 1e-12),
w as (select doc_id as a, other_id as b from v union all select other_id, doc_id from v),
reach(rep, root) as (select rep, rep from r union select w.b, reach.root from reach join w on w.a = reach.rep),
roots as (select rep, min(root) as root from reach group by rep),
m as (select r.rep, s.doc_id from s join r using (grams)),
c as (select rep, count(*) as size from m group by rep),
n as (select c.rep, c.size - 1 + coalesce((select sum(o.size) from w join c o on o.rep = w.b where w.a = c.rep), 0) as n_links from c)
select m.doc_id, min(roots.root) as class_id, cast(sum(n.n_links) as bigint) as n_links
from m join n using (rep) join roots using (rep) where n.n_links > 0 group by m.doc_id
"""
