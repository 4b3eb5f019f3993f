"""Media columns: chroma audio fingerprints and the alignment of recordings by them.

A recording is a binary column of mono 8-bit PCM samples. Its frames' spectra are folded to
twelve pitch classes; sixteen filters, differences of rectangle sums that an integral image
of the frames gives, are each cut to two bits and packed into an integer for every frame.

Recordings with equal bytes are one node. Nodes meet on runs of equal codes: of neighbouring runs the one of least
hash is a landmark, so two recordings that have ``SURE_RUN`` codes in a row in common share one. A landmark, and besides
a landmark with the two after it and their distances, is a key. Holders of a key vote for each other.
A histogram of offsets picks
the best alignment of each two nodes that met; those with ``VOTES`` votes are graded by the bit errors over the
aligned codes. Nodes link at ``MAX_ERROR`` or less, and linked ones form classes.

Where ``CROWD`` or fewer hold a key, a join brings its holders together. Of a key that more hold (a jingle, silence, a group of very many altered copies)
the holders are dealt to packs, and every two packs are compared in arrays, all pairs of holders with all keys that they share; a pair that shares
several such keys is compared under the least of them. No pair is left out. What comes out are a node's number of links, its best one and a node that it
is connected with: a few rows for each node and two packs, and not its links. The work is still that of all pairs of such a key's holders.

Most keys have one holder. Of these only counts are shuffled: a Bloom filter of fixed size (``FILTER_BITS``) over the keys that several nodes hold is
applied where the nodes lie. What it lets through wrongly is counted once more and left out, so it decides nothing. Nodes are kept in buckets, and joins move the other side only.

A null or empty recording has no codes and is in a class with equal ones only; one that is shorter than a
filter is padded with silence. Nulls in other columns don't matter; a null id is a recording
with a null id. Equal rows share one result each. An empty table gives no rows. The registered
query takes the UTF-8 bytes of ``documents.text`` for the samples, for want of an audio table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexispan.llm.common import FEW_TEXTS, KEY, bucketed, by_text, documents, dropped, moved, settings, stored
from lexispan.llm.components import least_labels

RATE = 8_000
FRAME = 256
HOP = 64
#: Frames that a code covers.
SPAN = 8
#: Codes of a landmark, and neighbouring landmarks of which one is kept.
RUN = 2
WINNOW = 6
SURE_RUN = RUN + WINNOW - 1
#: Landmarks of the longer keys.
CHAIN = 3
#: Votes for an offset (all there are, of a recording with fewer landmarks), and share of differing bits, of a link: altered tones differ in 0.08 at
#: most, unlike ones that share two landmarks in 0.28 or more.
VOTES = 2
#: Holders of a key that a join brings together; of keys with more, packs of about so many nodes and bytes are compared.
CROWD = 64
PACK, PACK_BYTES = 256, 4 << 20
#: Bits of the filter of keys that several nodes hold.
FILTER_BITS = 1 << 26
#: Votes or codes that are handled at a time.
AT_ONCE = 1 << 22
#: Two packs each.
_FEW_PACKS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "4"}
MAX_ERROR = 0.2
#: Frames handled at a time.
PIECE = 1 << 15
CUTS = (-0.18, 0.0, 0.18)
LOWEST_HZ, HIGHEST_HZ = 90.0, 3_600.0

_SCHEMA = "doc_id long, t1 long, t2 long, n_marks int, codes array<int>, keys array<struct<at: int, mark: bigint>>"


def _pitch_classes() -> np.ndarray:
    """Which share of a spectrum line goes to which pitch class."""
    hertz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    fold = np.zeros((len(hertz), 12))
    for k, f in enumerate(hertz):
        if LOWEST_HZ <= f <= HIGHEST_HZ:
            fold[k, round(12 * np.log2(f / 440.0)) % 12] = 1.0
    return fold


def _filters() -> list[tuple[int, int, int, int]]:
    """kind, frames, first pitch class and pitch classes of the sixteen filters, by rule."""
    return [(k % 4, (8, 6, 4, 8)[k // 4], (5 * k) % 7, (4, 6, 4, 6)[(k // 2) % 4]) for k in range(16)]


_FOLD, _FILTERS, _WINDOW = _pitch_classes(), _filters(), np.hanning(FRAME)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames by pitch classes, each frame of sum one (a silent one is even)."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    power = np.abs(np.fft.rfft((frames - 128.0) * _WINDOW, axis=1)) ** 2
    classes = power @ _FOLD + 1e-6
    return classes / classes.sum(1, keepdims=True)


def codes_of_frames(frames: np.ndarray) -> np.ndarray:
    """A packed 32-bit code for each SPAN neighbouring frames."""
    image = np.zeros((len(frames) + 1, 13))
    image[1:, 1:] = frames.cumsum(0).cumsum(1)
    n = len(frames) - SPAN + 1

    def box(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return image[t1 : t1 + n, c1] - image[t0 : t0 + n, c1] - image[t1 : t1 + n, c0] + image[t0 : t0 + n, c0]

    out = np.zeros(n, np.uint32)
    for kind, width, low, height in _FILTERS:
        high, middle, centre = low + height, low + height // 2, width // 2
        if kind == 0:
            a, b = box(0, centre, low, high), box(centre, width, low, high)
        elif kind == 1:
            a, b = box(0, width, low, middle), box(0, width, middle, high)
        elif kind == 2:
            a = box(0, centre, low, middle) + box(centre, width, middle, high)
            b = box(0, centre, middle, high) + box(centre, width, low, middle)
        else:
            third = width // 4
            a, b = box(third, width - third, low, high), box(0, third, low, high) + box(width - third, width, low, high)
        level = np.digitize(np.log((1e-3 + a) / (1e-3 + b)), CUTS).astype(np.uint32)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))  # Gray code: neighbouring levels differ by a bit
    return out


def fingerprint(media: bytes | None) -> np.ndarray:
    """The codes of a recording."""
    if not media:
        return np.zeros(0, np.uint32)
    samples = np.frombuffer(media, np.uint8)
    least = FRAME + (SPAN - 1) * HOP
    if len(samples) < least:
        samples = np.concatenate((samples, np.full(least - len(samples), 128, np.uint8)))
    n = (len(samples) - FRAME) // HOP + 1 - SPAN + 1
    return np.concatenate(
        [codes_of_frames(chroma(samples[at * HOP : (min(at + PIECE, n) - 1 + SPAN - 1) * HOP + FRAME])) for at in range(0, n, PIECE)]
    )


def landmarks(codes: np.ndarray) -> list[tuple[int, int]]:
    """Places and hashes of the runs that are kept; a recording with fewer codes than a run has one of all its codes."""
    if not len(codes):
        return []
    data = memoryview(codes.astype("<u4").tobytes())
    runs = [xxhash.xxh64_intdigest(data[4 * i : 4 * (i + RUN)]) for i in range(max(1, len(codes) - RUN + 1))]
    kept = dict.fromkeys(min(range(i, min(i + WINNOW, len(runs))), key=lambda k: (runs[k], k)) for i in range(max(1, len(runs) - WINNOW + 1)))
    return [(k, runs[k] - (1 << 64) if runs[k] >> 63 else runs[k]) for k in kept]


def keys(marks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Landmarks, and the longer keys of ``CHAIN`` of them and their distances."""
    out = list(marks)
    for k in range(len(marks) - CHAIN + 1):
        part = marks[k : k + CHAIN]
        told = np.array([x for at, mark in part for x in (at - part[0][0], mark)], "<i8").tobytes()
        value = xxhash.xxh64_intdigest(told, CHAIN)
        out.append((part[0][0], value - (1 << 64) if value >> 63 else value))
    return out


def _printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys_type = pa.list_(pa.struct([("at", pa.int32()), ("mark", pa.int64())]))
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            codes = [fingerprint(m.as_py()) for m in part["media"]]
            marks = [landmarks(c) for c in codes]
            found = [[{"at": k, "mark": h} for k, h in keys(m)] for m in marks]
            own = [pa.array([len(m) for m in marks], pa.int32()), pa.array([c.view(np.int32) for c in codes], pa.list_(pa.int32())), pa.array(found, keys_type)]
            yield pa.RecordBatch.from_arrays([part["doc_id"], part["t1"], part["t2"], *own], names=["doc_id", "t1", "t2", "n_marks", "codes", "keys"])


def fingerprints(recordings: DataFrame) -> DataFrame:
    """doc_id, a 128-bit hash of the media (t1, t2), number of landmarks, codes and keys of every recording."""
    media = F.col("media")
    rows = recordings.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(media).alias("t1"), F.xxhash64(F.lit(7), media).alias("t2"), media)
    return rows.mapInArrow(_printed, _SCHEMA)


def _shared(nodes: DataFrame) -> np.ndarray:
    """The bits of a Bloom filter over the keys that several nodes hold: at most FILTER_BITS / 64 rows reach the driver."""
    size = FILTER_BITS.bit_length() - 1
    many = nodes.select(F.explode(F.array_distinct("keys.mark")).alias("mark")).groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    at = many.select(F.explode(F.array(*(F.shiftrightunsigned("mark", k * size).bitwiseAND(F.lit(FILTER_BITS - 1)) for k in range(2)))).alias("bit"))
    slots = at.groupBy(F.shiftright("bit", 6).alias("slot")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits"))
    out, rows = np.zeros(FILTER_BITS // 64, np.int64), slots.toArrow()
    out[rows["slot"].to_numpy()] = rows["bits"].to_numpy()
    return out.view(np.uint8)


def _let_through(shared):
    """A row for each place of a node's keys that the filter knows."""
    size, own = FILTER_BITS.bit_length() - 1, [*KEY, "least", "n_marks"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch["keys"]
            mark, at = (keys.flatten().field(name) for name in ("mark", "at"))
            bits, hit = mark.to_numpy().view(np.uint64), np.ones(len(mark), bool)
            for k in range(2):
                place = (bits >> np.uint64(k * size)) & np.uint64(FILTER_BITS - 1)
                hit &= (shared.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
            of, hit = pa.array(np.repeat(np.arange(len(keys)), keys.value_lengths().to_numpy())[hit]), pa.array(hit)
            yield pa.RecordBatch.from_arrays([*(batch[c].take(of) for c in own), at.filter(hit), mark.filter(hit)], names=[*own, "at", "mark"])

    return run


def holders(nodes: DataFrame) -> DataFrame:
    """t1, t2, least, n_marks, at, mark, n: the places of all keys that several nodes hold, and of how many places a key has."""
    shared = nodes.sparkSession.sparkContext.broadcast(_shared(nodes))
    with settings(nodes.sparkSession, FEW_TEXTS):
        schema = "t1 long, t2 long, least long, n_marks int, at int, mark long"
        through = stored(nodes.select(*KEY, "least", "n_marks", "keys").mapInArrow(_let_through(shared), schema), "chroma-through")
    # all places of a key are let through or none, so these counts are whole
    ends = [f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in KEY]
    counts = through.groupBy("mark").agg(F.count(F.lit(1)).alias("n"), *ends).where("min_t1 != max_t1 or min_t2 != max_t2").select("mark", "n")
    met = stored(through.join(counts, "mark"), "chroma-met")
    dropped(through)
    return met


def _graded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``pairs`` (a, b, code_offset, ...) with the share of differing bits over the codes that they align."""
    both = pairs
    for end, codes in (("a", "x"), ("b", "y")):
        both = both.withColumns({c: F.col(f"{end}.{c}") for c in KEY}).join(nodes.select(*KEY, F.col("codes").alias(codes)), KEY).drop(*KEY)
    late, early = F.greatest("code_offset", F.lit(0)), F.greatest(-F.col("code_offset"), F.lit(0))
    length = F.least(F.size("x") - late, F.size("y") - early)
    x, y = F.slice("x", late + 1, length), F.slice("y", early + 1, length)
    # bits are counted in 64: those that a negative int is widened by don't differ
    wrong = lambda p, q: F.bit_count(p.bitwiseXOR(q).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    errors = F.aggregate(F.zip_with(x, y, wrong), F.lit(0), lambda s, e: s + e)
    return both.select(*pairs.columns, F.round(errors / (32 * length), 6).alias("bit_error"))


class _Pack:
    """The nodes of one or two packs as arrays."""

    def __init__(self, packs: list[pa.StructArray]) -> None:
        one = lambda name: pa.concat_arrays([p.field(name) for p in packs])
        self.t1, self.t2 = one("t1").to_numpy(), one("t2").to_numpy()
        self.least, self.n_marks = one("least"), one("n_marks").to_numpy()
        none = self.least.is_null().to_numpy(zero_copy_only=False)
        rank = np.lexsort((self.t2, self.t1, self.least.fill_null(0).to_numpy(), none))
        self.rank = np.empty(len(rank), np.int64)
        self.rank[rank] = np.arange(len(rank))
        codes, keys, hot = one("codes"), one("keys"), one("hot")
        self.codes, self.n_codes = codes.flatten().to_numpy().view(np.uint32), codes.value_lengths().to_numpy().astype(np.int64)
        self.start = self.n_codes.cumsum() - self.n_codes
        self.holder = np.repeat(np.arange(len(keys)), keys.value_lengths().to_numpy())
        self.at, self.mark = keys.flatten().field("at").to_numpy().astype(np.int64), keys.flatten().field("mark").to_numpy()
        self.hot, self.hot_holder = hot.flatten().to_numpy(), np.repeat(np.arange(len(hot)), hot.value_lengths().to_numpy())

    def known(self, mark: int) -> np.ndarray:
        """Which nodes share a crowded key that is less than ``mark``: these meet there."""
        before = self.hot < mark
        marks, column = np.unique(self.hot[before], return_inverse=True)
        held = np.zeros((len(self.t1), len(marks)), np.float32)
        held[self.hot_holder[before], column] = 1
        return held @ held.T > 0


def _votes(pack: _Pack, i: int, keys: tuple[np.ndarray, ...], wanted: np.ndarray) -> tuple[np.ndarray, ...]:
    """Nodes that share keys with node i, the offset with most votes of each (of the later node against the earlier) and its votes."""
    mark, at, holder = keys
    own = slice(*np.searchsorted(pack.holder, [i, i + 1]))
    low, high = np.searchsorted(mark, pack.mark[own]), np.searchsorted(mark, pack.mark[own], "right")
    many, found, counts = (high - low).cumsum(), [], []
    begin = 0
    while begin < len(low):
        end = max(begin + 1, int(np.searchsorted(many, (many[begin - 1] if begin else 0) + AT_ONCE, "right")))
        n = (high - low)[begin:end]
        place = np.repeat(low[begin:end] - (n.cumsum() - n), n) + np.arange(n.sum())
        j, offset = holder[place], np.repeat(pack.at[own][begin:end], n) - at[place]
        ok = wanted[j]
        value, count = np.unique((j[ok] << 33) + (offset[ok] + (1 << 32)), return_counts=True)
        found.append(value), counts.append(count)
        begin = end
    if not found:
        return (np.empty(0, np.int64),) * 3
    value, which = np.unique(np.concatenate(found), return_inverse=True)
    votes = np.bincount(which, np.concatenate(counts), len(value)).astype(np.int64)
    j, offset = value >> 33, (value & ((1 << 33) - 1)) - (1 << 32)
    offset = np.where(pack.rank[j] < pack.rank[i], offset, -offset)
    order = np.lexsort((offset, -np.abs(offset), votes, j))
    last = order[np.flatnonzero(np.diff(j[order], append=-1))]
    return j[last], offset[last], votes[last]


def _bit_errors(pack: _Pack, a: np.ndarray, b: np.ndarray, offset: np.ndarray) -> np.ndarray:
    late, early = np.maximum(offset, 0), np.maximum(-offset, 0)
    n = np.minimum(pack.n_codes[a] - late, pack.n_codes[b] - early)
    x, y, total, out, begin = pack.start[a] + late, pack.start[b] + early, n.cumsum(), np.empty(len(a)), 0
    while begin < len(a):
        end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + AT_ONCE, "right")))
        part, first = n[begin:end], n[begin:end].cumsum() - n[begin:end]
        step = np.arange(part.sum()) - np.repeat(first, part)
        wrong = np.bitwise_count(pack.codes[np.repeat(x[begin:end], part) + step] ^ pack.codes[np.repeat(y[begin:end], part) + step])
        out[begin:end] = np.add.reduceat(wrong, first, dtype=np.int64) / (32 * part)
        begin = end
    return np.floor(out * 1e6 + 0.5) / 1e6


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while True:
        before = root.copy()
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if (root == before).all():
            return root


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each two packs: their nodes that have links between them, with the number of links, a connected node and the best link with an earlier node."""
    for batch in batches:
        for k in range(len(batch)):
            packs = [batch[c][k].values for c in ("x", "y")]
            alone = not len(packs[1])
            pack, half = _Pack(packs), len(packs[0])
            wanted = ~pack.known(batch["mark"][k].as_py())
            if alone:
                wanted &= pack.rank[:, None] > pack.rank[None, :]
            else:
                wanted[:, :half] = False
            order = np.argsort(pack.mark, kind="stable")
            order = order[wanted[:half].any(0)[pack.holder[order]]]
            keys = pack.mark[order], pack.at[order], pack.holder[order]
            met = [(i, *_votes(pack, i, keys, wanted[i])) for i in np.flatnonzero(wanted[:half].any(1))]
            i = np.concatenate([np.empty(0, np.int64), *(np.full(len(m[1]), m[0]) for m in met)])
            j, offset, votes = (np.concatenate([np.empty(0, np.int64), *(m[c] for m in met)]) for c in (1, 2, 3))
            later = pack.rank[i] > pack.rank[j]
            a, b = np.where(later, i, j), np.where(later, j, i)
            a, b, offset, votes = (v[votes >= np.minimum(VOTES, pack.n_marks[a])] for v in (a, b, offset, votes))
            error = _bit_errors(pack, a, b, offset)
            a, b, offset, votes, error = (v[error <= MAX_ERROR] for v in (a, b, offset, votes, error))
            size = len(pack.t1)
            links, root = np.bincount(a, minlength=size) + np.bincount(b, minlength=size), _roots(size, a, b)
            # ties go to the least id: ranks begin with it
            best = np.lexsort((offset, pack.rank[b], error, -votes, a))
            best = best[np.flatnonzero(np.diff(a[best], prepend=-1))]
            of = np.full(size, -1)
            of[a[best]] = best
            at = np.flatnonzero(links)
            of = pa.array(of[at], mask=of[at] < 0)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(v) for v in (pack.t1[at], pack.t2[at], links[at], pack.t1[root[at]], pack.t2[root[at]])), *(pa.array(v).take(of) for v in (votes, error)), pack.least.take(pa.array(b)).take(of), pa.array(offset).take(of)],
                names=["t1", "t2", "n_links", "r1", "r2", "votes", "bit_error", "ref_id", "code_offset"],
            )


def _crowds(nodes: DataFrame, hot: DataFrame) -> DataFrame:
    """Links of all pairs of nodes that share a crowded key, counted: node, n_links, root (a node connected with it) and best link with an earlier
    node (votes, bit_error, ref_id, code_offset). ``hot``: node and its crowded keys."""
    crowded = hot.select("node.*", "hot")
    members = stored(nodes.join(crowded, KEY).select("node", *KEY, "least", "n_marks", "codes", "keys", "hot"), "chroma-members")
    cells = members.select("node", F.explode("hot").alias("mark"), (4 * F.size("codes") + 12 * F.size("keys")).alias("bytes"))
    pieces = cells.groupBy("mark").agg(F.greatest(F.ceil(F.count(F.lit(1)) / PACK), F.ceil(F.sum("bytes") / PACK_BYTES)).alias("pieces"))
    dealt = cells.join(pieces, "mark").select("node", "mark", "pieces", F.pmod(F.xxhash64("node"), F.col("pieces")).alias("piece")).join(members, "node")
    packs = dealt.groupBy("mark", "pieces", "piece").agg(F.collect_list(F.struct("t1", "t2", "least", "n_marks", "codes", "keys", "hot")).alias("pack"))
    packs = stored(packs, "chroma-packs")
    other = packs.where("pieces > 1").withColumn("other", F.explode(F.expr("sequence(0L, pieces - 1)")))
    x = other.where("piece <= other").select("mark", F.col("piece").alias("low"), F.col("other").alias("high"), F.col("pack").alias("x"))
    y = other.where("piece > other").select("mark", F.col("other").alias("low"), F.col("piece").alias("high"), F.col("pack").alias("y"))
    # of packs that no node has been dealt to there is nothing to compare
    both = x.join(y, ["mark", "low", "high"], "left").where("low = high or y is not null").select("mark", "x", F.coalesce("y", F.slice("x", 1, 0)).alias("y"))
    both = both.unionByName(packs.where("pieces = 1").select("mark", F.col("pack").alias("x"), F.slice("pack", 1, 0).alias("y")))
    with settings(nodes.sparkSession, _FEW_PACKS):
        schema = "t1 long, t2 long, n_links long, r1 long, r2 long, votes long, bit_error double, ref_id long, code_offset long"
        found = stored(both.mapInArrow(_compared, schema), "chroma-crowds")
    dropped(members, packs)
    return found.select(F.struct(*KEY).alias("node"), "n_links", F.struct(F.col("r1").alias("t1"), F.col("r2").alias("t2")).alias("root"), "votes", "bit_error", "ref_id", "code_offset")


def _crowded_keys(met: DataFrame) -> DataFrame:
    """node, hot: the keys that have more than CROWD places, of each node that has any."""
    many = met.where(F.col("n") > CROWD).groupBy(F.struct(*KEY).alias("node"))
    return stored(many.agg(F.sort_array(F.collect_set("mark")).alias("hot")), "chroma-hot")


def alignments(nodes: DataFrame, met: DataFrame | None = None, hot: DataFrame | None = None) -> DataFrame:
    """a, b, code_offset, votes, bit_error: nodes that met and their best offset. ``nodes``: node, t1, t2, least, n_marks, codes, keys. ``met``: their ``holders``.
    Pairs that share one of the keys in ``hot`` (node, hot) are left to ``_crowds``."""
    own = holders(nodes) if met is None else None
    met = own if met is None else met
    node = F.struct(*KEY)
    met = met if hot is None else met.where(F.col("n") <= CROWD)
    met = met.select(node.alias("node"), "n_marks", F.struct(F.isnull("least").alias("none"), "least", node.alias("node")).alias("rank"), "at", "mark")
    # from a stored table, so that both sides of the join are plain exchanges, whose hot partitions Spark splits
    apart = F.col("rank") > F.col("b_rank")
    if hot is not None:
        met = met.join(hot, "node", "left")
        apart &= ~F.coalesce(F.arrays_overlap("hot", "b_hot"), F.lit(False))
    other = met.select("mark", F.col("rank").alias("b_rank"), F.col("at").alias("other_at"), *([] if hot is None else [F.col("hot").alias("b_hot")]))
    pairs = met.join(other, "mark").where(apart).select("node", F.col("b_rank.node").alias("b"), "at", F.col("other_at").alias("b_at"), "n_marks")
    offset = (F.col("at") - F.col("b_at")).alias("code_offset")
    votes = pairs.groupBy(F.col("node").alias("a"), "b", offset).agg(F.count(F.lit(1)).alias("votes"), F.max("n_marks").alias("n_marks"))
    votes = votes.where(F.col("votes") >= F.least(F.lit(VOTES), F.col("n_marks")))
    best = F.max(F.struct("votes", (-F.abs("code_offset")).alias("near"), "code_offset")).alias("best")
    pairs = votes.groupBy("a", "b").agg(best).select("a", "b", "best.code_offset", "best.votes")
    pairs = stored(pairs, "chroma-pairs")
    graded = stored(_graded(pairs, nodes), "chroma-graded")
    dropped(pairs, *([] if own is None else [own]))
    return graded


def _components(links: DataFrame) -> DataFrame:
    """node, component, as ``least_labels``. Both ends of a link first move to their least neighbours, so that little is left of dense groups."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("near")), "chroma-near")
    a, b = (near.select(F.col("node").alias(end), F.col("near").alias(f"near_{end}")) for end in ("a", "b"))
    left = links.join(a, "a").join(b, "b").where("near_a != near_b").select(F.col("near_a").alias("a"), F.col("near_b").alias("b"))
    labels = least_labels(left, "chroma").withColumnRenamed("node", "near")
    return near.join(labels, "near", "left").select("node", F.coalesce("component", "near").alias("component"))


def aligned(recordings: DataFrame) -> DataFrame:
    """One row for each recording: doc_id, n_codes, class_id (least id of its class), n_links (other nodes it is linked
    with), and the best alignment of its node with an earlier one, or of a copy with the first one (ref_id,
    code_offset, votes, bit_error; null if there is none)."""
    prints = stored(fingerprints(recordings), "chroma-prints")
    nodes = prints.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least"), F.first("n_marks").alias("n_marks"), F.first("codes").alias("codes"), F.first("keys").alias("keys")
    )
    nodes = bucketed(nodes, KEY, "chroma_nodes")
    nodes = moved(nodes, nodes.withColumn("node", F.struct(*KEY)))
    met = holders(nodes)
    hot = _crowded_keys(met)
    links = alignments(nodes, met, hot).where(F.col("bit_error") <= MAX_ERROR)
    dropped(met)
    crowds = _crowds(nodes, hot)
    labels = _components(links.select("a", "b").unionByName(crowds.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))))
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("n_links")).unionByName(links.select(F.col("b").alias("node"), F.lit(1).alias("n_links")))
    counts = ends.unionByName(crowds.select("node", "n_links")).groupBy("node").agg(F.sum("n_links").alias("n_links"))
    least = nodes.select(*KEY, "least")
    few = links.withColumns({c: F.col(f"b.{c}") for c in KEY}).join(least, KEY).select(F.col("a").alias("node"), "votes", "bit_error", F.col("least").alias("ref_id"), "code_offset")
    best = few.unionByName(crowds.where("votes is not null").select(*few.columns)).groupBy("node").agg(
        F.min(F.struct((-F.col("votes")).alias("most"), "bit_error", F.isnull("ref_id").alias("none"), "ref_id", "code_offset", "votes")).alias("best")
    )
    # nodes with links only: the others are their own class
    linked = labels.select("node.*", "component").join(least, KEY)
    classes = linked.groupBy("component").agg(F.min("least").alias("class_id"))
    linked = linked.select(F.struct(*KEY).alias("node"), "component").join(classes, "component").join(counts, "node", "left").join(best, "node", "left")
    results = (
        nodes.select(*KEY, "copies", "least", "n_marks", F.size("codes").alias("n_codes")).join(linked.select("node.*", "component", "class_id", "n_links", "best"), KEY, "left")
        .select(*KEY, "copies", "least", "n_marks", "n_codes", F.when(F.isnull("component"), F.col("least")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "best")
    )
    results = stored(results, "chroma-results")
    dropped(nodes)
    rows = by_text(prints.select("doc_id", *KEY), results)
    copy = F.col("least").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("least"))
    own = lambda value, name: F.when(copy, value).otherwise(F.col(f"best.{name}")).alias(name)
    return rows.select(
        "doc_id", "n_codes", "class_id", "n_links", own(F.col("least"), "ref_id"), own(F.lit(0), "code_offset"),
        own(F.col("n_marks").cast("long"), "votes"), own(F.lit(0.0), "bit_error"),
    )


def op7_chroma_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return aligned(docs.select("doc_id", F.encode("text", "UTF-8").alias("media")))
