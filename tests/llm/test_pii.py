import hashlib
import random
import re

from corpusloom.llm.pii import KINDS, detect, find_pii, luhn, op4_pii, redact, redacted, rewritten, spans_of, with_added


def brute(text):
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_plain_detectors_equal_the_expressions():
    rng = random.Random(2)
    for letters in ("ab.@-1", "12. -+()@a", "0123456789.", "a@b.c%+-_ é٣"):
        for _ in range(4000):
            text = "".join(rng.choice(letters) for _ in range(rng.randrange(0, 50)))
            assert detect(text) == brute(text), text


def test_disguises_map_back_to_the_source():
    for text, kind, source in [
        ("write john [at] example [dot] com now", 0, "john [at] example [dot] com"),
        ("write john at example dot com now", 0, "john at example dot com"),
        ("x jane.doe(at)mail.example.org y", 0, "jane.doe(at)mail.example.org"),
        ("m jоhn@exаmple.com.", 0, "jоhn@exаmple.com"),
        ("m jo​hn@example.com", 0, "jo​hn@example.com"),
        ("ip １９２.168.0.1 end", 1, "１９２.168.0.1"),
        ("ip one nine two dot one six eight dot zero dot one end", 1, "one nine two dot one six eight dot zero dot one"),
        ("card four one one one 1111 1111 one one one one.", 2, "four one one one 1111 1111 one one one one"),
        ("call plus one five five five zero one two three four five six seven now", 3, "plus one five five five zero one two three four five six seven"),
        ("call +1 (743) 555–3824 ok", 3, "+1 (743) 555–3824"),
    ]:
        base, spans = spans_of(text)
        added = [s for s in spans if s not in base]
        if source:
            assert [(k, text[a:b]) for k, a, b in added] == [(kind, source)], (text, added)


def test_gate_lets_every_disguise_through():
    for text, kind, source in [
        ("ip one.two.three.four.", 1, "one.two.three.four"),
        ("“10.zero.zero.1”", 1, "10.zero.zero.1"),
        ("call plus 49 30 1234567 now", 3, "plus 49 30 1234567"),
        ("call +1 (five) 5512345678", 3, "+1 (five) 5512345678"),
        ("write jane at mail.example dot org now", 0, "jane at mail.example dot org"),
        ("write jane at mail.example [dot] org now", 0, "jane at mail.example [dot] org"),
        ("write jane at mail.example.org.", 0, "jane at mail.example.org"),
        ("ip ſix.sİx.six.1", 1, "ſix.sİx.six.1"),
    ]:
        assert [(k, text[a:b]) for k, a, b in spans_of(text)[1]] == [(kind, source)], text
    for text in ("He looked at node.js", "at 9.30 they met at home. Com is short", "one. un (plus"):
        assert spans_of(text) == ([], [])


def test_gate_equals_the_ungated_tape():
    rng = random.Random(5)
    parts = "one two seven zéro fünf ſix sİx dot point (dot) [at] at chez plus más @ jane mail com org . . . , - ( ) + 1 49 192 5551234567 é “ _ x а".split() + [" "] * 6 + ["\n", "\t"]
    for _ in range(20_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 22)))
        assert spans_of(text)[1] == with_added(text, detect(text), rewritten(text)), text


def test_clean_text_gets_no_spans():
    for text in ("meet at noon dot the i", "un deux trois", "one two three four", "He was at home. A point of order at sea", "1990–2000, 12·5", "", "Привет мир"):
        assert spans_of(text) == ([], [])
    assert redacted("a b@c.de f +1 555 555 0100.", spans_of("a b@c.de f +1 555 555 0100.")[1]) == "a <EMAIL> f <PHONE>."


def test_long_texts_are_linear():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 100_000, "@" * 200_000, "one " * 50_000, " dot " * 40_000, "+" + "1 " * 100_000 + "(" * 50_000):
        spans_of(text)


def test_query_and_odd_rows(spark):
    got = op4_pii(spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    assert len(got) == len(docs)
    for r in got:
        base = brute(docs[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in base) for i in range(4)]
        plain = [f"{KINDS[k]}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(plain).encode()).hexdigest()
        assert set(plain) <= set(r.spans.split(",")) | {""}
    rows = [(1, None, "x"), (2, "", "x"), (3, "a@b.cd", None), (3, "a@b.cd", None), (None, "a@b.cd", "x")]
    out = sorted((r.doc_id or 0, r.spans, r.redacted) for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string, spans string"), with_text=True).collect())
    assert out == [(0, "email:0:6", "<EMAIL>"), (1, "", None), (2, "", ""), (3, "email:0:6", "<EMAIL>"), (3, "email:0:6", "<EMAIL>")]
    again = redact(spark.createDataFrame(rows, "doc_id long, text string, spans string"))
    assert again.columns == ["doc_id", "text", "spans"] and sorted((r.doc_id or 0, r.text or "") for r in again.collect()) == [(i, t or "") for i, _, t in out]
    assert find_pii(spark.createDataFrame([], "doc_id long, text string")).collect() == []
