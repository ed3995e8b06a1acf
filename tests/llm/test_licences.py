import math
import struct
import textwrap

import pytest
import regex
import xxhash
from corpusloom.llm.licences import TEMPLATES, op3_licence_scan, scan, train

DOCS = "doc_id long, text string, paragraph string"


@pytest.fixture(scope="module")
def model(spark):
    return train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def wrapped(text):
    return "\n".join(f" * {line}" for line in textwrap.wrap(text, 50))


def test_templates_are_found_and_ordinary_text_is_not(spark, model):
    rows, want = [], {}
    for f, ts in TEMPLATES.items():
        for n, t in enumerate(ts):
            rows.append((len(rows), f"Some ordinary line here.\n\n{wrapped(t) if n % 2 else t}\n \nAnother line of the text.", "x"))
            want[len(rows) - 1] = f
    rows.append((len(rows), "word " * 300 + wrapped(TEMPLATES["mit"][2]) + "\nword" * 300, "x"))
    long = len(rows) - 1
    rows += [(900, None, "x"), (901, "", "x"), (902, "\n \n", None), (903, "the terms of the treaty under which the version of the story was told", "x"), (904, "word " * 50_000, "x")]
    rows += [(905, "Released under the MIT License.", "x")] * 2 + [(None, "Licensed under CC BY-NC 4.0.", "x")]
    out = scan(spark.createDataFrame(rows, DOCS), model).collect()
    got = {(r.doc_id, r.paragraph): r for r in out}
    right = sum((i, 1) in got and got[i, 1].family == f and got[i, 1].confirmed for i, f in want.items())
    assert right >= len(want) - 1
    assert got[long, 0].family == "mit" and got[long, 0].confirmed
    assert got[905, 0].family == "mit" and got[None, 0].family == "cc-by-nc" and got[None, 0].confirmed
    assert sum(r.doc_id == 905 for r in out) == 1
    assert {(i, p) for i, p in got if i is not None and i not in want} == {(905, 0), (long, 0)} and all(p == 1 for i, p in got if i in want)
    assert scan(spark.createDataFrame([], DOCS), model).collect() == []


def scored(docs, model):
    """What ``scan`` returns, from the model's numbers alone."""
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    bytes_ = lambda w, seed: xxhash.xxh64_intdigest(w.encode(), seed)
    weights = dict(model.weights)
    out = {}
    for doc_id, text in docs:
        words = lambda t: [w for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w]
        pairs = lambda ws: [bytes_(b, bytes_(a, 42)) for a, b in zip(ws, ws[1:])]
        if len({signed(p) for p in pairs(words(text or ""))} & set(model.pairs)) < 2:
            continue
        for n, part in enumerate(regex.split(r"(?:\r\n|\r|\n)[ \t]*(?:\r\n|\r|\n)\s*", text)):
            ws = words(part)
            for at in range(0, max(0, math.ceil((len(ws) - 160) / 80)) * 80 + 1, 80):
                own = ws[at : at + 160]
                ps = pairs(own)
                grams = {signed(p) for p in ps} | {signed(bytes_(w, xxhash.xxh64_intdigest(struct.pack("<Q", p), 42))) for p, w in zip(ps, own[2:])}
                hits = grams & set(weights)
                if not hits:
                    continue
                logits = [model.intercepts[i] + sum(weights[g][i] for g in hits) for i in range(len(model.families))]
                logit, family = max((logits[i], model.families[i]) for i in range(1, len(logits)))
                p = 1 / (1 + math.exp(-(model.slope * (logit - logits[0]) + model.offset)))
                if p >= 0.5:
                    share = max(len(hits & set(t)) / len(t) for _, f, t in model.templates if f == family)
                    before = out.get((doc_id, n, family), (0, 0))
                    out[doc_id, n, family] = (max(p, before[0]), max(share, before[1]))
    return out


def test_scores_equal_brute_force(spark, model):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows += [(1000 + n, f"a b c\n\n{wrapped(t)} {t}\n\nunder the terms of this License") for n, t in enumerate(sum(TEMPLATES.values(), []))]
    got = {(r.doc_id, r.paragraph, r.family): (r.probability, r.similarity) for r in scan(spark.createDataFrame([(*r, "") for r in rows], DOCS), model).collect()}
    want = scored(rows, model)
    assert got.keys() == want.keys() and len(want) >= 20
    assert all(abs(got[k][i] - want[k][i]) < 1e-5 for k in want for i in (0, 1))


def test_every_planted_notice_and_nothing_else(spark):
    out = {(r.doc_id, r.family) for r in op3_licence_scan(spark, "/root/testdata/sf0.01").where("confirmed").collect()}
    words = {"Apache License, Version 2.0": "apache-2.0", "MIT License": "mit", "GNU General Public License, version 3": "gpl-3.0", "CC BY-NC 4.0": "cc-by-nc"}
    texts = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    want = {(r.doc_id, f) for r in texts for w, f in words.items() if w in (r.text or "")}
    assert out == want and len(want) > 10
