"""Personal data: fixed patterns, and terms that give a person's data away by how they co-occur with it."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapgrid.llm.common import slices
from snapgrid.session import stage_table

#: The base kinds in the order in which spans are listed, and what their patterns are.
BASE = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits does.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IP_PART, CARD_DIGITS, PHONE_DIGITS = 255, (14, 19), (10, 15)

#: Kinds that the method adds: terms to be replaced by something more general, and terms to be taken out.
GENERALISE, REMOVE = "general", "remove"
KINDS = (*BASE, GENERALISE, REMOVE)
#: Share of what is to be known of an entity that a term gives away, from which it is generalised, and removed.
GENERAL_FROM, REMOVE_FROM = 0.9, 0.97
#: Different surroundings in which a term must stand near an entity.
LEAST_CONTEXTS = 3
#: Terms on either side of an entity that count as near it.
WINDOW = 24
#: Minimum hashes of a window; windows with one of them in common are the same surroundings, edited.
SKETCHES = 6
TERM = re.compile(r"[^\W_]{2,}")
#: Bytes of terms that are sent to all tasks at once.
BROADCAST_BYTES = 16 << 20
_ENTRY_BYTES = 80

Span = tuple[str, int, int]


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    low = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            low = m.end()
            yield start, low


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str | None) -> list[Span]:
    """(kind, start, end) of the base kinds by start, then kind; code points, end exclusive. Kinds may overlap."""
    if not text:
        return []
    spans: list[Span] = []
    if "@" in text:
        spans += [("email", *at) for at in _emails(text)]
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= IP_PART for part in m[0].split(".")):
            spans.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if CARD_DIGITS[0] <= len(m[0]) and CARD_DIGITS[0] <= len(digits := _digits(m[0])) <= CARD_DIGITS[1] and _luhn(digits):
            spans.append(("card", *m.span()))
    if "+" in text:
        spans += [("phone", *m.span()) for m in PHONE.finditer(text) if PHONE_DIGITS[0] <= len(_digits(m[0])) <= PHONE_DIGITS[1]]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def entity(kind: str, text: str) -> bytes:
    """What stands for an entity in the statistics: a digest, the same for all ways of writing it."""
    same = text.lower() if kind == "email" else text if kind == "ip" else _digits(text)
    return hashlib.md5(f"{kind}:{same}".encode()).digest()


def _blanked(text: str, spans: list[Span]) -> str:
    """``text`` with the spans blanked, of the same length."""
    out, done = [], 0
    for _, start, end in spans:
        if end > done:
            start = max(start, done)
            out += [text[done:start], " " * (end - start)]
            done = end
    return "".join([*out, text[done:]])


def windows(text: str | None, window: int = WINDOW) -> dict[bytes, tuple[list[int], list[str]]]:
    """For each entity in a text: minimum hashes of the pairs of terms near it, and the distinct terms near it.

    Terms are runs of two and more letters and digits, lower-cased, outside base spans.
    """
    spans = base_spans(text)
    if not spans:
        return {}
    found = [(m.start(), m[0].lower()) for m in TERM.finditer(_blanked(text, spans))]
    starts = [s for s, _ in found]
    near: dict[bytes, list[tuple[int, int]]] = {}
    for kind, start, end in spans:
        at = bisect_left(starts, start)
        near.setdefault(entity(kind, text[start:end]), []).append((max(0, at - window), at + window))
    out = {}
    for key, ranges in near.items():
        parts = [[t for _, t in found[a:b]] for a, b in ranges]
        pairs = {f"{x} {y}" for p in parts for x, y in zip(p[:-1], p[1:], strict=True)}
        sketch = [min((xxhash.xxh3_64_intdigest(p, seed) >> 1 for p in pairs), default=0) for seed in range(SKETCHES)]
        out[key] = (sketch, sorted({t for p in parts for t in p}))
    return out


def _windows_of(docs: DataFrame, text: str, window: int) -> DataFrame:
    """entity, s0.., terms: one row for each entity of each document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = [(k, *v) for t in batch.column(0).to_pylist() for k, v in windows(t, window).items()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.binary()),
                    *[pa.array([r[1][s] for r in rows], pa.int64()) for s in range(SKETCHES)],
                    pa.array([r[2] for r in rows], pa.list_(pa.string())),
                ],
                ["entity", *_SKETCH, "terms"],
            )

    return docs.select(F.col(text).alias("text")).mapInArrow(read, f"entity binary, {', '.join(f'{s} long' for s in _SKETCH)}, terms array<string>")


_SKETCH = [f"s{k}" for k in range(SKETCHES)]


def _supported(rows: DataFrame, least: int) -> DataFrame:
    """entity, term, n_both, n_entity: pairs that stand together in ``least`` different surroundings.

    The counts are of documents. Surroundings that share a minimum hash become one, hash
    by hash, so that copies and edited copies of a passage do not count as evidence.
    """
    known = rows.groupBy("entity").agg(F.count("*").alias("n_entity")).where(F.col("n_entity") >= least)
    known = stage_table(known, "pii-entities")
    often = stage_table(rows.join(known.select("entity"), "entity", "left_semi"), "pii-often")
    contexts = often
    for s in _SKETCH:
        others = [c for c in (*_SKETCH, "terms") if c != s]
        contexts = contexts.groupBy("entity", s).agg(F.min(F.struct(*others)).alias("first")).select("entity", s, *[f"first.{c}" for c in others])
    support = contexts.select("entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(F.count("*").alias("contexts"))
    support = stage_table(support.where(F.col("contexts") >= least).select("entity", "term"), "pii-support")
    both = often.select(F.col("entity").alias("e"), F.explode("terms").alias("t")).groupBy("e", "t").agg(F.count("*").alias("n_both"))
    pairs = support.join(both, (F.col("entity") == F.col("e")) & (F.col("term") == F.col("t"))).join(known, "entity")
    return stage_table(pairs.select("entity", "term", "n_both", "n_entity"), "pii-pairs")


def _blocks(terms: DataFrame, at_most: int) -> list[DataFrame]:
    """``terms`` (with a column term) in parts of about ``at_most`` bytes by a hash of the term."""
    held = terms.agg(F.coalesce(F.sum(F.octet_length("term") + _ENTRY_BYTES), F.lit(0))).first()[0]
    n = max(1, -(-held // at_most))
    return [terms.where(F.pmod(F.xxhash64("term"), F.lit(n)) == k) for k in range(n)] if held else []


def _documents_with(docs: DataFrame, terms: DataFrame, text: str, at_most: int) -> DataFrame:
    """term, n_term: documents that have each of ``terms`` outside base spans; a pass for each block of terms."""
    counted = docs.sparkSession.createDataFrame([], "term string, n long")
    slim = docs.select(F.col(text).alias("text"))
    for block in _blocks(terms, at_most):
        wanted = docs.sparkSession.sparkContext.broadcast(frozenset(r.term for r in block.select("term").collect()))

        def count(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            counts: Counter = Counter()
            for batch in slices(batches, "text"):
                for t in batch.column(0).to_pylist():
                    if t:
                        counts.update({x.lower() for x in TERM.findall(_blanked(t, base_spans(t)))} & wanted.value)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

        counted = counted.unionByName(slim.mapInArrow(count, "term string, n long"))
    return counted.groupBy("term").agg(F.sum("n").alias("n_term"))


def disclosing_terms(
    docs: DataFrame, text: str = "text", window: int = WINDOW, least: int = LEAST_CONTEXTS,
    general_from: float = GENERAL_FROM, at_most: int = BROADCAST_BYTES,
) -> DataFrame:
    """term, disclosure: terms that give away at least ``general_from`` of an entity.

    Entities are the base spans of all documents, alike however they are written. The
    pointwise mutual information of term and entity over the information of the entity,
    ``1 - ln(n_term / n_both) / ln(n / n_entity)``, is the share that the term gives
    away; of several entities the largest counts. n counts documents, copies included;
    ``n_both`` those where the term is near the entity. A term must stand near it in
    ``least`` different surroundings. An entity in all documents tells nothing.
    """
    n = docs.count()
    pairs = _supported(stage_table(_windows_of(docs, text, window), "pii-windows"), least)
    with_term = _documents_with(docs, stage_table(pairs.select("term").distinct(), "pii-candidates"), text, at_most)
    shared = 1 - F.log(F.col("n_term") / F.col("n_both")) / F.log(F.lit(float(max(n, 1))) / F.col("n_entity"))
    found = pairs.where(F.col("n_entity") < n).join(with_term, "term").groupBy("term").agg(F.round(F.max(shared), 9).alias("disclosure"))
    return stage_table(found.where(F.col("disclosure") >= general_from), "pii-terms")


_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"


def _term_spans(text: str, base: list[Span], actions: Mapping[str, str]) -> list[Span]:
    blank = _blanked(text, base)
    if not ({x.lower() for x in TERM.findall(blank)} & actions.keys()):
        return []
    return [(actions[t], *m.span()) for m in TERM.finditer(blank) if (t := m[0].lower()) in actions]


def find_private(
    docs: DataFrame, terms: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text",
    remove_from: float = REMOVE_FROM, at_most: int = BROADCAST_BYTES,
) -> DataFrame:
    """``keep`` and spans (array of kind, start, end, by start, then kind) of every row.

    ``terms``: term, disclosure. Term spans overlap no base span; base kinds may overlap
    one another. Null and empty texts have none; repeated rows and ids each keep their
    row, other columns play no part. Terms beyond ``at_most`` bytes take further passes.
    """
    action = F.when(F.col("disclosure") >= remove_from, REMOVE).otherwise(GENERALISE)
    blocks = _blocks(terms.select("term", action.alias("action")), at_most)
    kept = [f"_k{k}" for k in range(len(keep))]
    rows = docs.select(
        F.col(text).alias("text"), F.array().cast(_SPANS).alias("spans"), *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)]
    )
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for k in range(max(1, len(blocks))):
        held = {r.term: r.action for r in blocks[k].collect()} if blocks else {}
        shared, last = docs.sparkSession.sparkContext.broadcast(held), k + 1 >= len(blocks)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, first=k == 0) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                out = []
                for t, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    base = base_spans(t)
                    spans = list(base) if first else [(s["kind"], s["start"], s["end"]) for s in before]
                    if t and shared.value:
                        spans += _term_spans(t, base, shared.value)
                    out.append([{"kind": x, "start": a, "end": b} for x, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, arrow), *batch.columns[2:]], batch.schema.names)

        rows = rows.mapInArrow(scan, rows.schema)
        if not last:
            rows = stage_table(rows, "pii-spans")
    return rows.select(*[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)], "spans")


def generalised(term: str) -> str:
    """Something that many terms share: the leading digit of a number, else the kind of word."""
    if term.isdigit():
        return term[0] + "*" * (len(term) - 1)
    return "[CODE]" if any(c.isdigit() for c in term) else "[NAME]" if term[:1].isupper() else "[WORD]"


def sanitised(text: str | None, spans: list[Mapping]) -> str | None:
    """``text`` with base spans replaced by their kind, disclosing terms generalised or taken out."""
    out, done = [], 0
    for span in spans or ():
        kind, start, end = span["kind"], span["start"], span["end"]
        if start >= done:
            held = text[start:end]
            out += [text[done:start], "" if kind == REMOVE else generalised(held) if kind == GENERALISE else f"[{kind.upper()}]"]
        done = max(done, end)
    return text if not done else "".join([*out, text[done:]])


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs``, all rows and columns, with ``text`` sanitised by the statistics of all of ``docs``; an empty table stays empty."""
    at = docs.columns.index(text)
    found = find_private(docs, disclosing_terms(docs, text), tuple(f"`{c}`" for c in docs.columns), text)
    whole, column = found.toDF(*docs.columns, _unused(docs)), docs.columns[at]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            texts, spans = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            made = pa.array([sanitised(t, s) for t, s in zip(texts, spans, strict=True)], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], made, *batch.columns[at + 1 : -1]], batch.schema.names[:-1])

    return whole.mapInArrow(write, docs.schema)


def _unused(docs: DataFrame) -> str:
    taken, name = {c.lower() for c in docs.columns}, "spans"
    while name in taken:
        name += "_"
    return name


def joined(spans: Column) -> Column:
    """Spans as text: ``kind:start:end``, with commas between them."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
