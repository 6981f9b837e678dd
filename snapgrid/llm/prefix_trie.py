"""Conversation prefix tries: double arrays in prefix shards, upper nodes merged over all shards."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from snapgrid.llm.common import grouped, n_words
from snapgrid.session import stage_table

#: Turns of a band: what of a conversation stands in one row and in one shard.
BAND_TURNS = 128
#: Turns of a shard on average, and of the distinct sequences below a prefix that is not cut further.
SHARD_TURNS = 20_000
#: Ids that are joined to text at once.
IDS_AT_ONCE = 4_096
_NOBODY = hashlib.sha256(b"").hexdigest()


# Turns and their order


def numbered(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (from 0), key (16 bytes that stand for role and text) and words of every turn.

    Ordered by turn, null first, then by key. A null role or text is empty; rows without
    conv_id belong to no conversation and drop out. Rows are dealt by ranges of the whole
    order, so one conversation may lie in many tasks; how many of its turns stand in the
    tasks before is known from a row for each task.
    """
    said, words = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    slim = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.unhex(F.md5(F.concat(F.char_length(said).cast("string"), F.lit(":"), said, words))).alias("key"),
        n_words(text).alias("words"),
        # Equal rows can be dealt to several tasks.
        F.rand(7).alias("salt"),
    )
    order = ["conv_id", F.col("turn").asc_nulls_first(), "key", "salt"]
    dealt = stage_table(slim, "trie-slim").repartitionByRange(*order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0).to_numpy()
            new = np.append(True, conv[1:] != conv[:-1])
            at = np.arange(len(conv)) - np.flatnonzero(new)[np.cumsum(new) - 1]
            if conv[0] == last:
                at[: np.searchsorted(np.cumsum(new), 1, side="right")] += count
            last, count = conv[-1], int(at[-1]) + 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(conv), part, dtype=np.int32)), pa.array(at)], ["conv_id", "key", "words", "part", "at"]
            )

    placed = stage_table(
        dealt.select("conv_id", "key", "words").mapInArrow(number, "conv_id long, key binary, words long, part int, at long"), "trie-turns"
    )
    before = Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    # Only the first conversation of a task can have begun before: a row a task, so it can be broadcast.
    begun = (
        placed.groupBy(F.col("conv_id").alias("c"), F.col("part").alias("p")).agg(F.count("*").alias("n"))
        .withColumn("start", F.sum("n").over(before)).where("start > 0").select("c", "p", "start")
    )
    joined = placed.join(F.broadcast(begun), (F.col("conv_id") == F.col("c")) & (F.col("part") == F.col("p")), "left")
    return joined.select("conv_id", (F.col("at") + F.coalesce("start", F.lit(0))).alias("pos"), "key", "words")


def with_openings(turns: DataFrame, group: int = 20, openings: int = 4) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns and all conversation ids: each conversation opens like the first one of its group.

    Conversation c takes the first h turns of c - c % group, h = crc32 of its id as text
    modulo ``openings``, then its own turns after its first h. A conversation may end up
    without a turn; its id stands in the second table all the same.
    """
    h = (F.crc32(F.col("conv_id").cast("string")) % openings).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % group
    convs = turns.groupBy("conv_id").agg(F.lit(1).alias("one")).select("conv_id")
    heads = (
        turns.where((F.col("pos") < openings - 1) & (F.col("conv_id") % group == 0))
        .groupBy(F.col("conv_id").alias("b"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "key", "words"))).alias("head"))
    )
    heads = stage_table(heads, "trie-heads")
    sizes = heads.select("b", F.size("head").alias("held"))
    own = turns.where(F.col("pos") >= h).join(sizes, base == F.col("b"), "left")
    own = own.select("conv_id", (F.col("pos") - h + F.least(h, F.coalesce("held", F.lit(0)))).alias("pos"), "key", "words")
    opening = convs.join(heads, base == F.col("b")).select("conv_id", F.explode(F.slice("head", F.lit(1), h)).alias("t"))
    return own.unionByName(opening.select("conv_id", "t.pos", "t.key", "t.words")), convs


# Double arrays


class DoubleArray:
    """A trie in two arrays: from state s, symbol a leads to ``base[s] + a`` if ``check`` of that is s."""

    def __init__(self, symbols: int):
        self.base, self.check = np.zeros(64, np.int64), np.full(64, -1, np.int64)
        self.check[0], self.symbols, self.end = 0, symbols, 1

    def _reach(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base, self.check = np.pad(self.base, (0, more)), np.pad(self.check, (0, more), constant_values=-1)

    def insert(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The state behind each pair; pairs are distinct, sorted by state, of states that have no children yet."""
        new = np.append(True, states[1:] != states[:-1])
        starts, sizes = np.flatnonzero(new), np.diff(np.append(np.flatnonzero(new), len(states)))
        out = np.empty(len(states), np.int64)
        for k in np.flatnonzero(sizes > 1)[np.argsort(-sizes[sizes > 1], kind="stable")]:
            own = symbols[starts[k] : starts[k] + sizes[k]]
            first = self._first_fit(own - own[0])
            self.base[states[starts[k]]] = first - own[0]
            out[starts[k] : starts[k] + sizes[k]] = self._take(states[starts[k]], first + own - own[0])
        # One child fits anywhere: holes first, then the end.
        alone = starts[sizes == 1]
        slots = np.flatnonzero(self.check[: self.end] < 0)[: len(alone)]
        slots = np.concatenate([slots, np.arange(self.end, self.end + len(alone) - len(slots))])
        out[alone] = self._take(states[alone], slots)
        self.base[states[alone]] = slots - symbols[alone]
        return out

    def _first_fit(self, offsets: np.ndarray) -> int:
        free = np.flatnonzero(self.check[: self.end] < 0)[:512]
        self._reach(self.end + int(offsets[-1]) + 1)
        for at in range(0, len(free), 64):
            fits = (self.check[free[at : at + 64, None] + offsets] < 0).all(axis=1)
            if fits.any():
                return int(free[at + int(fits.argmax())])
        return self.end

    def _take(self, states: np.ndarray, slots: np.ndarray) -> np.ndarray:
        if len(slots):
            self._reach(int(slots.max()) + 1)
            self.check[slots] = states
            self.end = max(self.end, int(slots.max()) + 1)
        return slots

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """The state after each symbol, -1 where the trie has none."""
        to = self.base[states] + symbols
        inside = (states >= 0) & (to > 0) & (to < self.end)
        to = np.where(inside, to, 0)
        return np.where(inside & (self.check[to] == states), to, -1)


def pack(first: np.ndarray, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray, n_symbols: int) -> DoubleArray:
    """The trie of sequences: a ``first`` symbol each, then ``sizes`` symbols from ``starts``."""
    trie, state = DoubleArray(n_symbols), np.zeros(len(first), np.int64)
    for level in range(int(sizes.max(initial=0)) + 1):
        on = np.flatnonzero(sizes >= level)
        symbol = first[on] if level == 0 else symbols[starts[on] + level - 1]
        pairs, which = np.unique(state[on] * n_symbols + symbol, return_inverse=True)
        state[on] = trie.insert(pairs // n_symbols, pairs % n_symbols)[which]
    return trie


_SHARD = (
    "kind int, key binary, parent_key binary, anchor binary, conv_id long, parent_conv_id long, depth long, n_convs long, "
    "words long, n_children long, n_leaves long, saved long, end_key binary, next_root binary"
)
#: Kinds of rows of a shard: a whole node, its share of an upper node, a band that goes on below a whole node.
_WHOLE, _UPPER, _BELOW = 0, 1, 2


def shard_nodes(shard: pa.Table, band_turns: int) -> pa.RecordBatch | None:
    """Rows of one shard: pack its sequences, walk them, sum from the deepest level up."""
    shard = shard.combine_chunks()
    col = {c: shard.column(c).combine_chunks() if isinstance(shard.column(c), pa.ChunkedArray) else shard.column(c) for c in shard.column_names}
    lists = col["keys"]
    dense = lists.flatten().dictionary_encode()
    symbols, n_turns = dense.indices.to_numpy().astype(np.int64), len(dense.dictionary)
    named = col["root"].dictionary_encode()
    first = named.indices.to_numpy().astype(np.int64) + n_turns
    sizes = pa.compute.list_value_length(lists).to_numpy().astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    words_of = col["words"].flatten().to_numpy().astype(np.int64)
    weight, conv, band = (col[c].to_numpy().astype(np.int64) for c in ("n", "conv_id", "band"))
    cut = pa.compute.list_value_length(col["upper"]).to_numpy().astype(np.int64)
    upper_of, upper_at = col["upper"].flatten().to_pylist(), np.concatenate([[0], np.cumsum(cut)[:-1]])
    roots, digests, next_roots = col["root"].to_pylist(), col["digest"].to_pylist(), col["next_root"].to_pylist()

    trie = pack(first, symbols, starts, sizes, n_turns + len(named.dictionary))
    size = trie.end
    n, low = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max)
    words, depth, upper = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, bool)
    some, ends = np.full(size, -1), np.full(size, -1)
    levels, state = [], np.zeros(len(first), np.int64)
    for level in range(int(sizes.max()) + 1):
        on = np.flatnonzero(sizes >= level)
        at = trie.step(state[on], first[on] if level == 0 else symbols[starts[on] + level - 1])
        state[on] = at
        np.add.at(n, at, weight[on])
        np.minimum.at(low, at, conv[on])
        some[at], depth[at], upper[at] = on, band[on] * band_turns + level, level <= cut[on]
        if level:
            words[at] = words_of[starts[on] + level - 1]
        stop = sizes[on] == level
        ends[at[stop]] = on[stop]
        levels.append(np.unique(at))

    nodes = np.concatenate(levels)
    kids = np.zeros(size, np.int64)
    leaves, saved = np.zeros(size, np.int64), np.zeros(size, np.int64)
    whole = nodes[~upper[nodes]]
    np.add.at(kids, trie.check[whole], 1)
    saved[whole] = (n[whole] - 1) * words[whole]
    leaves[whole] = kids[whole] == 0
    for at in reversed(levels):
        at = at[~upper[at]]
        np.add.at(leaves, trie.check[at], leaves[at])
        np.add.at(saved, trie.check[at], saved[at])

    def key(state: int, level: int) -> bytes:
        record = some[state]
        return roots[record] + (upper_of[upper_at[record] + level - 1] if level else b"")

    out = {name: [] for name in ("kind", "key", "parent_key", "anchor", "parent_conv_id", "end_key", "next_root")}
    states = []
    for level, at in enumerate(levels):
        for s in at.tolist():
            parent, record, end = int(trie.check[s]), int(some[s]), int(ends[s])
            parent_upper = level > 0 and bool(upper[parent])
            goes_on = next_roots[end] if end >= 0 and level == band_turns else None
            states.append(s)
            out["kind"].append(_UPPER if upper[s] else _WHOLE)
            out["key"].append(key(s, level) if upper[s] else None)
            out["parent_key"].append(key(parent, level - 1) if parent_upper else None)
            out["anchor"].append(key_of_cut(roots[record], upper_of, upper_at[record], cut[record], level) if goes_on else None)
            out["parent_conv_id"].append(int(low[parent]) if level and not parent_upper else None)
            out["end_key"].append(roots[end] + digests[end] if end >= 0 else None)
            out["next_root"].append(goes_on)
    rows = np.array(states)
    lower_id, lower_depth, lower_root = [], [], []
    for record in np.flatnonzero(sizes == band_turns):
        if next_roots[record] is not None:
            s = int(state[record])
            while not upper[s]:
                lower_id.append(int(low[s]))
                lower_depth.append(int(depth[s]))
                lower_root.append(next_roots[record])
                s = int(trie.check[s])
    extra = len(lower_id)
    none = [None] * extra
    number = lambda v: pa.array([*v[rows].tolist(), *none], pa.int64())
    binary = lambda c: pa.array([*out[c], *none], pa.binary())
    return pa.RecordBatch.from_arrays(
        [
            pa.array([*out["kind"], *[_BELOW] * extra], pa.int32()), binary("key"), binary("parent_key"), binary("anchor"),
            pa.array([*low[rows].tolist(), *lower_id], pa.int64()), pa.array([*out["parent_conv_id"], *none], pa.int64()),
            pa.array([*depth[rows].tolist(), *lower_depth], pa.int64()),
            number(n), number(words), number(kids), number(leaves), number(saved), binary("end_key"),
            pa.array([*out["next_root"], *lower_root], pa.binary()),
        ],
        [f.split()[0] for f in _SHARD.split(", ")],
    )


def key_of_cut(root: bytes, upper: list[bytes], at: int, cut: int, level: int) -> bytes:
    """The deepest upper node on the way to ``level``."""
    deep = min(int(cut), level)
    return root + (upper[at + deep - 1] if deep else b"")


# The whole trie


def _bands(turns: DataFrame, convs: DataFrame, band_turns: int) -> DataFrame:
    """conv_id, band, keys, words, chain (a digest of each beginning), digest (of all) of each conversation's bands."""
    rows = turns.select("conv_id", F.floor(F.col("pos") / band_turns).cast("long").alias("band"), F.struct("pos", "key", "words").alias("t"))
    rows = rows.unionByName(convs.select("conv_id", F.lit(0).cast("long").alias("band"), F.lit(None).cast(rows.schema["t"].dataType).alias("t")))
    listed = rows.groupBy("conv_id", "band").agg(F.sort_array(F.collect_list("t")).alias("t"))

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chains = []
            for keys in batch.column(2).to_pylist():
                chain, last = [], b""
                for key in keys:
                    last = hashlib.md5(last + key).digest()
                    chain.append(last)
                chains.append(chain)
            last = pa.array([c[-1] if c else b"" for c in chains], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chains, pa.list_(pa.binary())), last], [*batch.schema.names, "chain", "digest"])

    return listed.select("conv_id", "band", F.col("t.key").alias("keys"), F.col("t.words").alias("words")).mapInArrow(
        chained, "conv_id long, band long, keys array<binary>, words array<long>, chain array<binary>, digest binary"
    )


def _rooted(bands: DataFrame, band_turns: int, several: bool) -> DataFrame:
    """``bands`` with root and next_root: what names the node above a band and the one that it ends at.

    Names are sums over the bands before, taken within stretches of bands and over the
    stretches, so no task orders all bands of a long conversation.
    """
    if not several:
        return bands.withColumns({"root": F.lit(b""), "next_root": F.lit(None).cast("binary")})
    wide = "decimal(38,0)"
    parts = {"a": F.xxhash64("band", "digest").cast(wide), "b": F.xxhash64("digest", "band", F.lit(1)).cast(wide)}
    slim = bands.select("conv_id", "band", F.floor(F.col("band") / 4_096).alias("far"), *[c.alias(n) for n, c in parts.items()])
    within = Window.partitionBy("conv_id", "far").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("conv_id").orderBy("far").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast(wide)
    far = slim.groupBy("conv_id", "far").agg(*[F.sum(n).cast(wide).alias(n) for n in parts])
    far = far.select("conv_id", "far", *[F.coalesce(F.sum(n).over(over).cast(wide), zero).alias(f"far_{n}") for n in parts])
    near = slim.select("*", *[F.coalesce(F.sum(n).over(within).cast(wide), zero).alias(f"near_{n}") for n in parts])
    summed = near.join(far, ["conv_id", "far"])

    def name(band: Column, a: Column, b: Column) -> Column:
        return F.unhex(F.md5(F.concat_ws(":", band.cast("string"), a.cast("string"), b.cast("string"))))

    before = {n: (F.col(f"near_{n}") + F.col(f"far_{n}")).cast(wide) for n in parts}
    named = summed.select(
        F.col("conv_id").alias("c"),
        F.col("band").alias("k"),
        F.when(F.col("band") == 0, F.lit(b"")).otherwise(name(F.col("band"), before["a"], before["b"])).alias("root"),
        name(F.col("band") + 1, (before["a"] + F.col("a")).cast(wide), (before["b"] + F.col("b")).cast(wide)).alias("next"),
    )
    joined = bands.join(named, (F.col("conv_id") == F.col("c")) & (F.col("band") == F.col("k")))
    return joined.withColumn("next_root", F.when(F.size("keys") == band_turns, F.col("next"))).drop("c", "k", "next")


def _member_hashes(ends: DataFrame) -> DataFrame:
    """ends_key, ends_sha256: of the ids that end at a node, ascending.

    Ids are sorted by ranges of (node, id), so those of one node may lie in many tasks;
    each task hands on stretches of text, and the hash runs over the stretches as a stream.
    """
    dealt = stage_table(ends, "trie-ends").repartitionByRange("end_key", "conv_id").sortWithinPartitions("end_key", "conv_id")

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = batch.column(0).dictionary_encode()
            codes, ids = code.indices.to_numpy(), batch.column(1).to_numpy()
            new = np.append(True, codes[1:] != codes[:-1])
            edges = np.flatnonzero(new)
            cuts = np.unique(np.concatenate([edges, np.arange(0, len(ids), IDS_AT_ONCE), [len(ids)]]))
            texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            at = pa.array(cuts[:-1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(texts)], ["end_key", "first", "ids"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, digest = None, None
        for batch in batches:
            keys, found = [], []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if key == last and digest is not None:
                    digest.update(b"," + ids.encode())
                    continue
                if digest is not None:
                    keys.append(last)
                    found.append(digest.hexdigest())
                last, digest = key, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], ["ends_key", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([digest.hexdigest()])], ["ends_key", "ends_sha256"])

    parts = dealt.mapInArrow(stretches, "end_key binary, first long, ids string")
    return parts.repartition("end_key").sortWithinPartitions("end_key", "first").mapInArrow(hashes, "ends_key binary, ends_sha256 string")


def subtree_sums(vertices: DataFrame, values: list[str]) -> DataFrame:
    """key and the sum of each of ``values`` over the subtree of every vertex (key, up, values; up null at a root).

    Each round doubles the depth that a sum reaches down, so there are as many rounds as
    the depth has binary digits.
    """
    state = stage_table(vertices.select("key", "up", *values), "trie-sums")
    while not state.where("up IS NOT NULL").isEmpty():
        below = state.where("up IS NOT NULL").groupBy(F.col("up").alias("k")).agg(*[F.sum(v).alias(f"more_{v}") for v in values])
        above = state.where("up IS NOT NULL").select(F.col("key").alias("a"), F.col("up").alias("next"))
        state = stage_table(
            state.join(below, F.col("key") == F.col("k"), "left")
            .join(above, F.col("up") == F.col("a"), "left")
            .select("key", F.col("next").alias("up"), *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values]),
            "trie-sums",
        )
    return state.select("key", *values)


def nodes(turns: DataFrame, convs: DataFrame, band_turns: int = BAND_TURNS, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row for each distinct beginning of a conversation: a node of the trie over all conversations.

    ``turns``: conv_id, pos (gapless from 0), key, words. ``convs``: every conv_id once,
    turnless ones too. Result: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256.

    Equal sequences are one with a weight. Conversations are cut in bands of
    ``band_turns``; the sequences of a band go to shards by their shortest beginning
    that at most ``shard_turns`` turns share. A shard packs a double array over dense
    numbers of its turns and walks it. Nodes above the cut, the only ones that several
    shards have, are merged by key, and sums flow up through them and from band to band.
    No conversations: no nodes, not even the root.
    """
    bands = stage_table(_bands(turns, convs, band_turns), "trie-bands")
    several = (bands.agg(F.max("band")).first()[0] or 0) > 0
    rooted = _rooted(bands, band_turns, several)
    if several:
        rooted = stage_table(rooted, "trie-rooted")
    records = stage_table(
        rooted.groupBy("band", "root", "digest").agg(
            F.count("*").alias("n"), F.min("conv_id").alias("conv_id"),
            *[F.any_value(c).alias(c) for c in ("keys", "words", "chain", "next_root")],
        ),
        "trie-records",
    )
    last = rooted.select("conv_id", "band", "root", "digest")
    if several:
        last = last.groupBy("conv_id").agg(F.max(F.struct("band", "root", "digest")).alias("x")).select("conv_id", "x.*")
    ends = stage_table(_member_hashes(last.select(F.concat("root", "digest").alias("end_key"), "conv_id")), "trie-members")

    # Beginnings that more turns share than a shard should hold.
    begun = records.select("root", "digest", F.size("keys").alias("size"), F.posexplode("chain").alias("j", "h"))
    hot = begun.groupBy(F.col("root").alias("r"), F.col("h").alias("x")).agg(F.sum("size").alias("turns")).where(F.col("turns") > shard_turns)
    hot = stage_table(hot.select("r", "x"), "trie-hot")
    cut = (
        begun.join(hot, (F.col("root") == F.col("r")) & (F.col("h") == F.col("x")), "left_semi")
        .groupBy(F.col("root").alias("r"), F.col("digest").alias("d"))
        .agg(F.sort_array(F.collect_list(F.struct("j", "h"))).alias("u"))
    )
    total = records.agg(F.coalesce(F.sum(F.size("keys") + 1), F.lit(0))).first()[0]
    shards = max(1, math.ceil(total / shard_turns))
    upper = F.coalesce(F.col("u.h"), F.array().cast("array<binary>"))
    dealt = records.join(cut, (F.col("root") == F.col("r")) & (F.col("digest") == F.col("d")), "left").withColumn("upper", upper)
    mine = F.coalesce(F.get("chain", F.size("upper")), F.col("digest"))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("root", mine), F.lit(shards)).cast("int")).drop("r", "d", "u", "chain")
    rows = stage_table(grouped(dealt, ["shard"], [], lambda t: shard_nodes(t, band_turns), _SHARD), "trie-shards")

    top = stage_table(
        rows.where(F.col("kind") == _UPPER).groupBy("key").agg(
            *[F.max(c).alias(c) for c in ("parent_key", "anchor", "depth", "words", "end_key", "next_root")],
            F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")],
        ),
        "trie-upper",
    )
    kids = top.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("p")).agg(F.count("*").alias("kids"))
    top = top.join(kids, F.col("key") == F.col("p"), "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0))).drop("p", "kids")
    # A band below the first hangs on the node that the band above ends at.
    hung = rows.where((F.col("kind") != _BELOW) & F.col("next_root").isNotNull()).groupBy(F.col("next_root").alias("below")).agg(
        F.min("conv_id").alias("hung_conv"), F.max("anchor").alias("hung_on")
    )
    top = stage_table(top.join(hung, F.col("key") == F.col("below"), "left").withColumn("lower", F.col("below").isNotNull()).drop("below"), "trie-top")
    lower = F.col("lower")
    vertices = top.select(
        "key",
        F.coalesce("parent_key", "hung_on").alias("up"),
        # The node that a lower band hangs on was counted as a leaf where it stands.
        (F.col("n_leaves") + F.when(lower, -1).when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaves"),
        (F.col("saved") + F.when(lower, 0).otherwise((F.col("n_convs") - 1) * F.col("words"))).alias("tokens"),
    )
    sums = stage_table(subtree_sums(vertices, ["leaves", "tokens"]).select(F.col("key").alias("k"), "leaves", "tokens"), "trie-totals")
    names = top.select(F.col("key").alias("name"), F.coalesce("hung_conv", "conv_id").alias("named"))
    below = top.where(lower).select(F.col("key").alias("below"), F.col("n_children").alias("more"))

    upper_nodes = top.where(~lower).join(sums, F.col("key") == F.col("k")).select(
        "conv_id", "depth", F.lit(None).cast("long").alias("parent_conv_id"), "parent_key", "n_convs", "n_children",
        F.col("leaves").alias("n_leaves"), F.col("tokens").alias("saved_tokens"), "end_key", "next_root",
    )
    whole = rows.where(F.col("kind") == _WHOLE)
    if several:
        deeper = rows.where(F.col("kind") == _BELOW).select(F.col("conv_id").alias("c"), F.col("depth").alias("d"), "next_root").join(
            sums, F.col("next_root") == F.col("k")
        )
        deeper = deeper.groupBy("c", "d").agg(F.sum("leaves").alias("leaves"), F.sum("tokens").alias("tokens"))
        whole = whole.join(deeper, (F.col("conv_id") == F.col("c")) & (F.col("depth") == F.col("d")), "left")
        whole = whole.withColumns({"n_leaves": F.col("n_leaves") + F.coalesce("leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("tokens", F.lit(0))})
    found = whole.select(
        "conv_id", "depth", "parent_conv_id", "parent_key", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "end_key", "next_root"
    ).unionByName(upper_nodes)
    # Rows without a partner get a key of their own, so that they do not meet in one task.
    own = F.encode(F.concat_ws("-", F.lit("none"), "conv_id", "depth"), "utf-8")
    if several:
        found = found.join(below, F.coalesce("next_root", own) == F.col("below"), "left")
        found = found.withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    return (
        found.join(names, F.coalesce("parent_key", own) == F.col("name"), "left")
        .join(ends, F.coalesce("end_key", own) == F.col("ends_key"), "left")
        .select(
            "conv_id", "depth", F.coalesce("parent_conv_id", "named").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
            "saved_tokens", F.coalesce("ends_sha256", F.lit(_NOBODY)).alias("ends_sha256"),
        )
    )
