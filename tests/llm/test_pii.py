"""Personal data: base patterns against plain regular expressions, disclosing terms against counts by hand."""

import hashlib
import math
import re

import numpy as np
import pytest

from snapgrid.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CARD = "4041894974608795"


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0


def plain_spans(text):
    spans = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 14 <= len(d) <= 19 and luhn(d or "0"), "phone": 10 <= len(d) <= 15,
            }[kind]
            if good:
                spans.append((m.start(), k, kind, m.end()))
    return [(kind, a, b) for a, _, kind, b in sorted(spans)]


def test_base_spans_are_those_of_the_plain_patterns():
    rng = np.random.default_rng(6)
    bits = ["a", "b.c", "@", "@x.org", "@-", ".", "1", "255", "256", "10.0.0.1", "1.2.3", "+", "+1 (555) 123-4567", "-", " ", "(", ")", CARD,
            "4041-8949 7460-8795", "é", "😀", "%", "_", "0", "007", "\n", ".."]
    for _ in range(6_000):
        text = "".join(rng.choice(bits, rng.integers(1, 14)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans(None) == pii.base_spans("") == []
    for text in ("a" * 300_000, "1" * 300_000, "+1" + "(" * 300_000, "a@" * 100_000, "1." * 200_000 + "1"):
        pii.base_spans(text)  # in a time that grows with the length


MAIL, OTHER, COMMON = "zed.q@mail.example.com", "+1 (202) 555-0143", "footer@corp.example"


def corpus():
    """A name stands by one address in five surroundings; another text comes in copies; an address stands everywhere."""
    rng = np.random.default_rng(9)
    words = [f"word{k}" for k in range(300)]

    def prose(n):
        return " ".join(rng.choice(words, n))

    docs = [f"{prose(30)} Quandle {MAIL} {prose(30)}" for _ in range(5)]
    docs += [f"{prose(60)} QUANDLE {prose(4)}"]  # the name alone
    copied = f"{prose(30)} Brimble {OTHER} {prose(30)}"
    docs += [copied] * 6 + [copied + " edited end"] * 3
    docs += [f"{prose(20)} {COMMON} write us {prose(10)}" for _ in range(40)] + [f"write us {prose(25)}" for _ in range(120)]
    docs += [prose(40) for _ in range(60)] + [None, "", "   ", f"{MAIL}", prose(30_000)]
    return docs


def plain_terms(docs, least=3, general=0.9):
    seen, with_term = {}, {}
    for k, t in enumerate(docs):
        for t_ in set(x.lower() for x in re.findall(r"[^\W_]{2,}", blank(t or ""))):
            with_term.setdefault(t_, set()).add(k)
        for e, (sketch, terms) in pii.windows(t).items():
            seen.setdefault(e, []).append((k, tuple(sketch), terms))
    out = {}
    for rows in seen.values():
        left = {(s, tuple(t)) for _, s, t in rows}
        for h in range(pii.SKETCHES):
            groups = {}
            for s, t in left:
                groups.setdefault(s[h], []).append(((*s[:h], *s[h + 1 :], t), s, t))
            left = {min(g)[1:] for g in groups.values()}
        if len(rows) < least or len(rows) == len(docs):
            continue
        for term in {t for _, _, ts in rows for t in ts}:
            if sum(term in t for _, t in left) >= least:
                both = sum(term in ts for *_, ts in rows)
                told = 1 - math.log(len(with_term[term]) / both) / math.log(len(docs) / len(rows))
                out[term] = max(out.get(term, 0), round(told, 9))
    return {t: x for t, x in out.items() if x >= general}


def blank(text):
    for _, a, b in plain_spans(text):
        text = text[:a] + " " * (b - a) + text[b:]
    return text


def frame(spark, docs):
    return spark.createDataFrame([(k, t, 1, "x", "e") for k, t in enumerate(docs)], "doc_id long, text string, spans int, term string, entity string").repartition(3)


@pytest.mark.parametrize("at_most", [16 << 20, 200])
def test_disclosing_terms(spark, at_most):
    docs = corpus()
    df = frame(spark, docs)
    terms = pii.disclosing_terms(df, at_most=at_most)
    got = {r.term: r.disclosure for r in terms.collect()}
    assert got == pytest.approx(plain_terms(docs))
    assert got["quandle"] > 0.9 and "brimble" not in got and "write" not in got
    for r in pii.find_private(df, terms, at_most=100 if at_most == 200 else at_most).collect():
        text = docs[r.doc_id] or ""
        spans = [(s.kind, s.start, s.end) for s in r.spans]
        assert [s for s in spans if s[0] in pii.BASE] == plain_spans(text)
        want = [(m.start(), m.end()) for m in re.finditer(r"[^\W_]{2,}", blank(text)) if m[0].lower() in got]
        assert [s[1:] for s in spans if s[0] not in pii.BASE] == want
        assert spans == sorted(spans, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_sanitised_documents(spark):
    docs = corpus()
    out = {r.doc_id: r for r in pii.sanitise(frame(spark, docs)).collect()}
    assert len(out) == len(docs) and out[0].term == "x" and out[0].spans == 1
    assert "[EMAIL]" in out[0].text and "Quandle" not in out[0].text and MAIL not in out[0].text
    assert "QUANDLE" not in out[5].text and out[6].text.count("[PHONE]") == 1 and "Brimble" in out[6].text
    nothing = [k for k, t in enumerate(docs) if not plain_spans(t) and "quandle" not in (t or "").lower()]
    assert all(out[k].text == docs[k] for k in nothing)
    assert pii.sanitise(frame(spark, docs).limit(0)).count() == 0
    assert [pii.generalised(t) for t in ("1987", "Zed", "zed", "a1")] == ["1***", "[NAME]", "[WORD]", "[CODE]"]


def test_query(spark, tmp_path):
    from snapgrid.llm.queries import QUERIES

    docs = [*corpus(), f"call +1 (202) 555-0143 or {CARD} at 10.0.0.1, x@y.org"]
    frame(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in QUERIES["op13_pii"](spark, str(tmp_path)).collect()}
    last = rows[len(docs) - 1]
    assert (last.n_email, last.n_ip, last.n_card, last.n_phone) == (1, 1, 1, 1)
    for k, r in rows.items():
        base = ",".join(f"{kind}:{a}:{b}" for kind, a, b in plain_spans(docs[k]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))
