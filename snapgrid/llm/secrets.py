"""Secret scans: fixed patterns, and strings that zstandard cannot compress where secrets stand."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapgrid.llm.common import slices

#: The base patterns and the kinds in the order in which spans are listed.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: Words near which an unusual string is suspect.
SENSITIVE = ("passw", "passphrase", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "private", "signature")
#: Identifiers and values that often stand in such places and give nothing away.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key secret_key private_key public_key client_id client_secret "
    "authorization bearer basic credential credentials username user_id session_id config settings environment variable "
    "example placeholder changeme default undefined null none true false localhost 127.0.0.1 http:// https:// www. .com "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ xxxxxxxxxxxxxxxx ................ ================ "
    "---------------- ________________ return import function class public static string self.request.response.headers"
).encode()
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
#: Code points before a candidate in which a sensitive word must stand, and around it that prime the compressor.
CONTEXT, SURROUNDING = 48, 1_024
#: Marginal compressed bytes for each character from which a candidate is reported; over a
#: small alphabet, this share of what its characters can carry.
NOVELTY, OF_ALPHABET = 0.6, 0.9
#: Characters between two lines of one value: a string there continues the one before.
BETWEEN = re.compile(r"[\s\"'\\,;|>#*+-]{0,32}(?:\\n)?[\s\"'\\,;|>#*+-]{0,32}")
#: The body of a key in armour, whole lines of it however short the last one is.
ARMOUR = re.compile(r"-----BEGIN [A-Z0-9 ]*KEY[A-Z ]*-----(.*?)(?:-----END|\Z)", re.DOTALL)
ARMOURED = re.compile(r"[A-Za-z0-9+/=]{2,}")
#: Letters of one part of a name on average; in random letters of mixed case parts are shorter.
PART_LETTERS = 3.2


def marginal_bytes(candidate: str, before: str, after: str) -> int:
    """Bytes that ``candidate`` adds to what the identifiers and its surroundings already hold."""
    primed = IDENTIFIERS + b"\n" + after.encode() + b"\n" + before.encode()
    known = zstandard.ZstdCompressionDict(primed, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    options = {"level": 3, "dict_data": known, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
    size = lambda data: len(zstandard.ZstdCompressor(**options).compress(data))
    return size(candidate.encode()) - size(b"")


def surroundings(text: str, start: int, end: int) -> tuple[str, str]:
    """SURROUNDING code points on either side, without what they share with the string itself.

    A secret that stands twice would otherwise be known from its own copy. Stretches of
    LEAST and more characters that also stand in the string are left out, also where the
    copy is part of a longer string or reaches over the edge of the surroundings.
    """
    own = {text[k : k + LEAST] for k in range(start, end - LEAST + 1)}

    def without(a: int, b: int) -> str:
        out, done = [], a
        low = max(0, a - LEAST + 1) if b <= start else end
        high = min(len(text), b + LEAST - 1) if a >= end else start
        for m in CANDIDATE.finditer(text, low, high):
            for k in range(m.start(), m.end() - LEAST + 1):
                if text[k : k + LEAST] in own:
                    out.append(text[done : max(done, min(k, b))])
                    done = max(done, min(k + LEAST, b))
        return " ".join([x for x in out if x] + [text[done:b]])

    return without(max(0, start - SURROUNDING), start), without(end, min(len(text), end + SURROUNDING))


def least_bytes(candidate: str) -> float:
    """Marginal bytes from which a candidate counts as incompressible: less over a small alphabet."""
    kinds = [(r"[0-9]", 10), (r"[A-F]", 6), (r"[G-Z]", 20), (r"[a-f]", 6), (r"[g-z]", 20), (r"[+/_=-]", 2)]
    bits = math.log2(max(2, sum(n for pattern, n in kinds if re.search(pattern, candidate))))
    return min(NOVELTY, OF_ALPHABET * bits / 8) * len(candidate)


def _looks_random(candidate: str) -> bool:
    """Letters and digits, or letters whose case changes more often than in names put together of words."""
    if re.search("[0-9]", candidate):
        return bool(re.search("[A-Za-z]", candidate))
    parts = re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", candidate)
    return bool(re.search("[a-z]", candidate) and re.search("[A-Z]", candidate)) and sum(map(len, parts)) < PART_LETTERS * len(parts)


def is_novel(text: str, start: int, end: int, known: bool = False) -> bool:
    """Whether the string at ``start`` stands where secrets do (``known``, or a sensitive word before it) and does not compress."""
    candidate = text[start:end]
    if not _looks_random(candidate):
        return False
    if not known:
        near = text[max(0, start - CONTEXT) : start].lower()
        if not any(word in near for word in SENSITIVE):
            return False
    return marginal_bytes(candidate, *surroundings(text, start, end)) >= least_bytes(candidate)


def _armoured(text: str) -> list[tuple[int, int]]:
    """Lines of the keys in armour whose bodies as a whole do not compress."""
    found = []
    for block in ARMOUR.finditer(text) if "-----BEGIN" in text else ():
        lines = [m.span() for m in ARMOURED.finditer(text, block.start(1), block.end(1))]
        # Headers of a key have a colon; its lines do not.
        lines = [(a, b) for a, b in lines if ":" not in text[text.rfind("\n", 0, a) + 1 : b + 1]]
        body = "".join(text[a:b] for a, b in lines)
        if len(body) >= LEAST and marginal_bytes(body, "", "") >= least_bytes(body):
            found += lines
    return found


def _pieces(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Candidates, and what is left of those that ``taken`` spans (sorted by start) touch, of LEAST characters and more."""
    at = 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while at and taken[at - 1][1] > start:
            at -= 1
        k = at
        while k < len(taken) and taken[k][0] < end:
            if taken[k][1] > start:
                if taken[k][0] - start >= LEAST:
                    yield start, taken[k][0]
                start = max(start, taken[k][1])
            k += 1
        at = k
        if end - start >= LEAST:
            yield start, end


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The stretches that spans cover, by start."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _outside(line: tuple[int, int], taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    a, b = line
    for low, high in taken[max(0, bisect_right(taken, line) - 1) :]:
        if low >= b:
            break
        if high > a:
            if low > a:
                yield a, low
            a = high
    if b > a:
        yield a, b


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each secret, by start and kind; code points, end exclusive.

    Base kinds may overlap one another. A novel span overlaps no base span.
    """
    if not text:
        return []
    spans = []
    lower = text.lower()
    if any(word in lower for word in _ASSIGN_WORDS):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    if any(word in lower for word in SENSITIVE):
        base = _merged([s[1:] for s in spans])
        for line in _armoured(text):
            spans += [("novel", a, b) for a, b in _outside(line, base)]
        last = -1
        for start, end in _pieces(text, _merged([s[1:] for s in spans])):
            # A value may go on over several lines.
            goes_on = last >= 0 and BETWEEN.fullmatch(text, last, start) is not None
            if is_novel(text, start, end, goes_on):
                spans.append(("novel", start, end))
                last = end
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_column`` and spans (array of kind, start, end) of every row; null and empty texts have none."""
    slim = docs.select(F.col(text).alias("text"), F.col(id_column).alias("id"))
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [
                [{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t)] for t in batch.column(0).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, spans)], ["id", "spans"])

    schema = f"id {slim.schema['id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return slim.mapInArrow(scan, schema).withColumnRenamed("id", id_column)


def joined(spans: Column) -> Column:
    """Spans as text: ``kind:start:end``, with commas between them."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: str | None, mark: str = "[SECRET]") -> str | None:
    """``text`` with each stretch covered by spans replaced by ``mark``."""
    out, done = [], 0
    for _, start, end in find_spans(text):
        if end <= done:
            continue
        if start >= done:
            out += [text[done:start], mark]
        done = end
    return text if not done else "".join([*out, text[done:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs``, all rows and columns, with secrets masked in ``text``; ``n_chars``, if there, is counted anew."""
    at = docs.columns.index("text")

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            made = pa.array([redacted(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], made, *batch.columns[at + 1 :]], batch.schema.names)

    out = docs.mapInArrow(mask, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
