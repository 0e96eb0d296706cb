import math
import random
import re
import time

import pytest
from llm_helpers import real_docs, rows_of

from tidewire.llm.sanitise import find_personal, sanitise


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base(text):
    text = text or ""
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0])):
            found.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(digits(m[0])) <= 15:
            found.append((m.start(), 3, m.end(), "phone"))
    return sorted(found)


TEXTS = [
    None,
    "",
    "é𝒳 a.b+c@mail-1.example.com, x@y z@w.v. @a.b c@.d a@b..c me@x.y@z.w %@a.b-c.d",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.02.3.0255 00000000000000000000001.1.1.1 9999999999999999999999.1.1.1 1.2.3",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 0000 00000000 5500 0000 0000 0004 12345678901",
    "+1 (743) 555-3824 +12 345 +1.2 +49 30 1234567890123456 + 1 555 +1-555-123-4567. ++15551234567",
    "a@" + "b." * 5_000 + "c",
    "1" * 40_000 + " " + "a" * 40_000 + " @ " + "2." * 3_000 + "+1" + "-2" * 3_000,
    "call +1 (743) 555-3824 or mail q@r.st from 10.0.0.1 with 4111111111111111",
]


def test_base_spans_equal_a_plain_scan(work):
    made = work.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for docs in (made, real_docs(work)):
        texts = dict(tuple(r) for r in docs.select("doc_id", "text").collect())
        rows = find_personal(docs).collect()
        assert len(rows) == len(texts)
        for r in rows:
            assert [(s["start"], s["kind_no"], s["end"], s["kind"]) for s in r["base"]] == base(texts[r["doc_id"]]), r["doc_id"]


def corpus(work):
    rows = [(i, f"Note {i}: Zorblax of the Guild wrote from zor@guild.example about the weather today") for i in range(6)]
    rows += [(100 + i, f"the weather about the Guild today was item{i} and nobody wrote") for i in range(300)]
    rows += [(500 + i, f"write to user{i}@single.example about Quux{i}") for i in range(20)]
    return work.createDataFrame(rows, "doc_id long, text string")


def test_terms_that_reveal_an_entity_are_found(work):
    docs = corpus(work)
    texts = dict(tuple(r) for r in docs.collect())
    for r in find_personal(docs).collect():
        terms = {texts[r["doc_id"]][s["start"] : s["end"]].lower() for s in r["spans"] if s["kind"] == "term"}
        # Zorblax stands with this address alone; the others also stand elsewhere, single addresses have no support.
        assert terms == ({"note", "zorblax", "from"} if r["doc_id"] < 6 else set())


def test_shares_are_counted_over_all_documents(work):
    docs = corpus(work)
    low = find_personal(docs, disclosure=0.01).where("doc_id < 6").selectExpr("sum(size(spans)) AS n").first()["n"]
    assert low > find_personal(docs).where("doc_id < 6").selectExpr("sum(size(spans)) AS n").first()["n"]


def test_sanitised_texts(work, odd_docs, no_docs):
    done = {r["doc_id"]: r["text"] for r in sanitise(corpus(work)).collect()}
    assert "[EMAIL]" in done[0] and "Zorblax" not in done[0] and "zor@" not in done[0]
    assert done[100] == "the weather about the Guild today was item0 and nobody wrote"
    softer = {r["doc_id"]: r["text"] for r in sanitise(corpus(work), remove_at=2.0).collect()}
    assert "[NAME] of the Guild" in softer[0]
    assert rows_of(sanitise(odd_docs)) == rows_of(odd_docs)
    assert rows_of(find_personal(no_docs)) == [] and rows_of(sanitise(no_docs)) == []
    assert find_personal(odd_docs).count() == odd_docs.count()


def test_telling_terms_are_reported_in_all_texts(work):
    gap = "filler " * 40
    texts = [f"Élan+zor@guild.example {gap} Zorblax{i % 2} met Quimby, QUIMBY" for i in range(20)]
    texts += ["Quimby alone, far from zorblax1@x.y"] + [f"nothing here {i}" for i in range(300)]
    texts += ["+1 555 123 4567 Pair pair a.b@c.de"] * 2
    docs = work.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def found(**settings):
        rows = find_personal(docs, **settings).collect()
        return {r["doc_id"]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "term"] for r in rows}

    terms = found()
    # Beyond any window, at every place, and in the text without the address; what overlaps an address is none.
    assert terms[0] == ["filler"] * 40 + ["Zorblax0", "met", "Quimby", "QUIMBY"]
    assert terms[20] == ["Quimby"] and terms[21] == []
    # Two documents are enough, and are judged like others where they weigh less.
    assert terms[321] == ["Pair", "pair"] and found(prior=0.3)[321] == []
    assert found(prior=0.3, disclosure=0.85)[321] == ["Pair", "pair"]
    cleaned = {r["doc_id"]: r["text"] for r in sanitise(docs, remove_at=2.0).collect()}
    assert cleaned[20] == "[NAME] alone, far from [EMAIL]"


def telling(rows, disclosure=0.9, prior=0.2):
    """Every pair of an address and a term, counted and judged one by one."""
    docs = [(set(re.findall(r"[a-z0-9]+@[a-z.]+", t)), {w.lower() for w in re.findall(r"[^\W_]{3,}", re.sub(r"[a-z0-9]+@[a-z.]+", " ", t))}) for t in rows]
    out = set()
    for e in set().union(*[d[0] for d in docs]):
        ne = sum(e in d[0] for d in docs)
        for t in set().union(*[d[1] for d in docs if e in d[0]]):
            nt, both = sum(t in d[1] for d in docs), sum(e in d[0] and t in d[1] for d in docs)
            share = math.log(both * len(docs) / (nt * ne)) / math.log(len(docs) / ne) * both / (both + prior)
            if share >= disclosure:
                out.add(t)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_telling_terms_equal_brute_force(work, seed):
    pick = random.Random(seed)
    words = [f"word{i}" for i in range(200)]
    rows = []
    for i in range(400):
        text = pick.choices(words, [1 / (k + 1) for k in range(200)], k=pick.randint(3, 12))
        if i % 4 == 0:
            who = pick.randint(0, 30)
            text += [f"user{who}@mail.example"] + ([f"Nick{who}"] if pick.random() < 0.9 else [])
        pick.shuffle(text)
        rows.append(" ".join(text))
    docs = work.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    expected = telling(rows)
    got = set()
    for r in find_personal(docs).collect():
        told = {rows[r["doc_id"]][s["start"] : s["end"]].lower() for s in r["spans"] if s["kind"] == "term"}
        assert told == expected & set(re.findall(r"[^\W_]{3,}", re.sub(r"[a-z0-9]+@[a-z.]+", " ", rows[r["doc_id"]]).lower()))
        got |= told
    assert got == expected and len(expected) > 5


def test_real_texts_have_telling_terms(work):
    docs = real_docs(work, "/root/testdata/sf0.1")
    found = find_personal(docs).selectExpr("size(filter(spans, s -> s.kind = 'term')) AS n", "size(base) AS base")
    terms, clean = found.selectExpr("sum(n)", "sum(if(base = 0, n, 0))").first()
    assert terms > 0 and clean == 0


def test_many_addresses_in_one_text_take_little_time(work):
    text = " ".join(f"to m{k}@x{k}.example" for k in range(16_000))
    begin = time.perf_counter()
    (row,) = find_personal(work.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert sum(s["kind"] == "email" for s in row["base"]) == 16_000 and time.perf_counter() - begin < 60


def test_plan_has_no_python(work):
    plan = find_personal(real_docs(work))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
