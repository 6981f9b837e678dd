"""URL filters: rules on hosts and paths, held in a cascade of Bloom filters."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapgrid.session import stage_table

#: Bits of one level: the only thing that is broadcast (32 MB).
MAX_BITS = 1 << 28
#: False positives aimed at from the second level on.
LATER_RATE = 1 / 32
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


@dataclass(frozen=True)
class Level:
    salt: int
    bits: int
    probes: int
    words: np.ndarray

    def holds(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each key may be in the filter, by its two hashes."""
        found = np.ones(len(a), dtype=bool)
        for place in places(a, b, self.salt, self.probes, self.bits):
            found &= (self.words[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) != 0
        return found


def places(a: np.ndarray, b: np.ndarray, salt: int, probes: int, bits: int) -> Iterator[np.ndarray]:
    """The bits of each key in a level; every level mixes the two hashes anew."""
    a, b = a.astype(np.uint64), b.astype(np.uint64)
    mixed = (a ^ (b >> np.uint64(29))) * np.uint64((2 * salt + 1) * 0x9E3779B97F4A7C15 % 2**64)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    step = (b ^ (mixed >> np.uint64(31))) | np.uint64(1)
    for k in range(probes):
        at = mixed + np.uint64(k) * step
        yield ((at ^ (at >> np.uint64(32))) % np.uint64(bits)).astype(np.int64)


@dataclass(frozen=True)
class Cascade:
    """Level 0 holds the listed keys, level 1 the other keys that level 0 takes for listed, and so on in turn.

    For a key of the universe, the first level that does not hold it tells whether it is listed.
    """

    levels: tuple[Level, ...]

    def lists(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        listed = np.zeros(len(a), dtype=bool)
        open_ = np.arange(len(a))
        for k, level in enumerate(self.levels):
            held = level.holds(a[open_], b[open_])
            listed[open_[~held]] = k % 2 == 1
            open_ = open_[held]
        listed[open_] = len(self.levels) % 2 == 1
        return listed


def hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key, F.lit(1)), F.xxhash64(key, F.lit(2))


def build_cascade(universe: DataFrame, listed: str) -> Cascade:
    """Encode which rows of ``universe(a, b, ...)``, one for each key, have the condition ``listed``.

    Both halves are tested on the executors; what comes to the driver is the bits of each
    level, of which there are at most MAX_BITS. A key counts by its two 64-bit hashes.
    """
    inside, outside = (universe.where(f"{c}({listed})").select("a", "b") for c in ("", "NOT "))
    n, others = inside.count(), outside.count()
    levels: list[Level] = []
    while n:
        rate = min(0.5, max(n / max(others, 1), 2.0**-30)) if not levels else LATER_RATE
        bits = max(64, math.ceil(n * -math.log(rate) / math.log(2) ** 2))
        if bits > MAX_BITS:
            raise ValueError(f"a level of {bits} bits; at most {MAX_BITS} are broadcast")
        level = _filled(inside, len(levels), bits, max(1, round(-math.log2(rate))))
        levels.append(level)
        # What the level wrongly holds is listed in the next one.
        wrong = stage_table(_held(outside, level), "url-wrong")
        inside, outside, others, n = wrong, inside, n, wrong.count()
    return Cascade(tuple(levels))


def _filled(keys: DataFrame, salt: int, bits: int, probes: int) -> Level:
    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate([*places(*(_unsigned(batch, c) for c in "ab"), salt, probes, bits), np.zeros(0, np.int64)])
            one = np.uint64(1) << (at & 63).astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(one.view(np.int64))], ["word", "bit"])

    rows = keys.mapInArrow(put, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    words = np.zeros((bits + 63) // 64, dtype=np.uint64)
    words[rows.column("word").to_numpy()] = rows.column("bit").to_numpy().astype(np.int64).view(np.uint64)
    return Level(salt, bits, probes, words)


def _unsigned(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def _held(keys: DataFrame, level: Level) -> DataFrame:
    shared = keys.sparkSession.sparkContext.broadcast(level)

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(shared.value.holds(*(_unsigned(batch, c) for c in "ab"))))

    return keys.mapInArrow(test, "a long, b long")


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add host (A-Z lower-cased) and path; both empty where there is no ``://``."""
    part = lambda k: F.coalesce(F.regexp_extract(url, _PARTS, k), F.lit(""))
    return pages.withColumn("host", F.translate(part(1), _UPPER, _UPPER.lower())).withColumn("path", part(2))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep``, host, path, rule and verdict of every row.

    ``rules`` are (verdict, host, path). A rule fits its host and the hosts below it if
    the path begins with the rule's; the longest (host and path together, then host) wins.
    The keys of a url are all hosts above it, as far up as rules go, with all
    beginnings of its path as long as some rule's. The distinct keys of all pages are the
    universe over which a cascade for each verdict is exact. A url without a listed key
    has no rule and is allowed. Null urls have an empty host and path. No join is made.
    """
    depth = max((h.count(".") + 1 for _, h, _ in rules), default=0)
    reach = sorted({len(p) for _, _, p in rules})
    base = with_host_and_path(pages.select(*keep, F.col(url).alias("url")), "url").drop("url")
    if not rules:
        return base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    labels = F.split("host", r"\.")
    keys = F.array(
        *[
            F.when(
                (F.size(labels) >= d) & (F.char_length("path") >= n),
                F.struct(
                    F.concat(F.array_join(F.slice(labels, F.greatest(F.size(labels) - d + 1, F.lit(1)), d), "."), F.lit("|"), F.left("path", F.lit(n))).alias("key"),
                ),
            )
            for d in range(1, depth + 1)
            for n in reach
        ]
    )
    listed = pages.sparkSession.createDataFrame([(f"{h}|{p}", v) for v, h, p in rules], "key string, verdict string")
    seen = base.select(F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("k")).select("k.key")
    universe = (
        seen.withColumn("verdict", F.lit(None).cast("string"))
        .unionByName(listed)
        .groupBy("key")
        .agg(F.max("verdict").alias("verdict"))
    )
    universe = stage_table(
        universe.select(*[h.alias(c) for c, h in zip("ab", hashes(F.col("key")), strict=True)], "verdict"), "url-keys"
    )
    cascades = {v: build_cascade(universe, f"coalesce(verdict = '{v}', false)") for v in sorted({r[0] for r in rules})}
    shared = pages.sparkSession.sparkContext.broadcast(cascades)
    hashed = F.transform(
        F.filter(keys, lambda k: k.isNotNull()),
        lambda k: F.struct(k["key"].alias("key"), *[h.alias(c) for c, h in zip("ab", hashes(k["key"]), strict=True)]),
    )
    fields = base.schema.fields
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(fields))
            flat, at = lists.flatten(), np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            a, b = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for c in "ab")
            best: dict[int, tuple[tuple[int, int], str, str]] = {}
            for verdict, cascade in shared.value.items():
                for k in np.flatnonzero(cascade.lists(a, b)):
                    host, _, path = flat.field("key")[int(k)].as_py().partition("|")
                    found = ((len(host) + len(path), len(host)), host + path, verdict)
                    best[at[k]] = max(best.get(at[k], found), found)
            rules_, verdicts = zip(*[best.get(k, (None, None, "allow"))[1:] for k in range(batch.num_rows)], strict=True) if batch.num_rows else ((), ())
            made = [pa.array(rules_, pa.string()), pa.array(verdicts, pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], *made], [*[f.name for f in fields], "rule", "verdict"])

    return base.withColumn("_keys", hashed).mapInArrow(decide, f"{kept}, rule string, verdict string")
