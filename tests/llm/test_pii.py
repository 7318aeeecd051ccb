import hashlib
import random
import re

from encore.llm import pii


def brute(t):
    """The contract's patterns, as plain regular expressions."""
    out = [(0, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub(r"[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append((2, m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def test_base_spans_as_the_patterns():
    r = random.Random(3)
    parts = ["1", "2", "25", "255", "256", "007", ".", " ", "-", "+", "(", ")", "@", "a", "b.c", "%", "é", "٣", "4111 1111 1111 1111", "\n", "+1 555", "x@y.z", "10.0.0.1"]
    for _ in range(20_000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 30)))
        assert pii.base_spans(text) == brute(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000, "1." * 100_000, "a@" * 100_000, "+1" * 100_000, "1 " * 100_000):
        spans = pii.base_spans(text)
        pii.candidates(text, spans)


def test_patterns_discover_unseen_identifiers(documents):
    rows = [(i, f"Please call mobile number +1 (555) 01{i:02d}-{1000 + i} about order") for i in range(12)]
    rows += [(100, "Please call mobile number 555-0199-7777 about order"), (101, "Invoice total sum 555-0199-8888 of it")]
    rows += [(200 + i, f"Serial of the part {9000000 + i} in stock") for i in range(12)]
    got = {r.doc_id: r for r in pii.find(documents(rows)).collect()}
    assert [tuple(s) for s in got[100].spans] == [(3, 26, 39)] and not got[100].base
    assert not got[101].spans and not any(got[200 + i].spans for i in range(12))
    for i in range(12):
        assert [tuple(s) for s in got[i].base] == brute(rows[i][1]) == [tuple(s) for s in got[i].spans]
    left = {r.doc_id: r.text for r in pii.redact(documents(rows, extra=True)).collect()}
    assert left[100] == "Please call mobile number [PHONE] about order"
    assert left[0] == "Please call mobile number [PHONE] about order"
    assert left[101] == rows[13][1]


def readings(text):
    return {(k, text[a:b]) for k, a, b, _ in pii.candidates(text, pii.base_spans(text))}


def test_fused_runs_are_read_in_parts():
    text = "cards 7536784127813050 4845168114407329 of mine"
    assert not pii.base_spans(text)
    assert readings(text) == {(2, "7536784127813050"), (2, "4845168114407329")}
    text = "at +1 (826) 555-4081 190.137.223.204 today"
    assert [k for k, *_ in pii.base_spans(text)] == [1]
    assert (3, "+1 (826) 555-4081") in readings(text) and not any("190" in v for _, v in readings(text))
    assert {(3, "555-0199-7777"), (2, "555-0199-7777 12")} <= readings("call 555-0199-7777 12 times")
    assert {(2, "4111-1111-1111-1111"), (2, "5500-0000-0000-0005")} <= readings("4111-1111-1111-1111 5500-0000-0000-0005")
    # no border but the dashes: they separate
    assert {(2, "4111111111111111"), (2, "5500000000000005")} <= readings("4111111111111111-5500000000000005")
    assert (3, "555-0199-7777") in readings("555-0199-7777 12th") and not readings("x5550199777 12")


def test_fused_identifiers_are_added(documents):
    rows = [(i, f"Please call mobile number +1 (555) 01{i:02d}-{1000 + i} about order") for i in range(12)]
    rows += [(100, "Please call mobile number 555-0199-7777 12 times"), (101, "Please call mobile number +1 (826) 555-4081 190.137.223.204 now")]
    rows += [(102, "Please call mobile number 555 019 9777 about order")]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(documents(rows)).collect()}
    assert (3, 26, 39) in got[100] and (3, 26, 43) in got[101]
    assert (3, 26, 38) in got[102]


def test_seeds_in_another_spelling_are_added(documents):
    rows = [(1, "john@x.com"), (2, "+49 1512 345 67890"), (3, "4111 1111 1111 1111"), (4, "+1 (555) 010-1234")]
    other = [(11, "ask john (at) x (dot) com today"), (12, "or 4915 1234567890 today"), (13, "of 4111.1111.1111.1111 today"), (14, "or 1.555.010.1234 today")]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(documents(rows + other)).collect()}
    assert got[11] == [(0, 4, 25)] and got[13] == [(2, 3, 22)] and got[14] == [(3, 3, 17)]
    assert (3, 3, 18) in got[12] and len(got[12]) == 1
    left = {r.doc_id: r.text for r in pii.redact(documents(rows + other)).collect()}
    assert [left[i] for i in range(11, 15)] == ["ask [EMAIL] today", "or [PHONE] today", "of [CARD] today", "or [PHONE] today"]
    # without the seeds, nothing tells of them
    assert not any(r.spans for r in pii.find(documents(other)).collect())


def test_addresses_in_other_shapes(documents):
    shapes = ["10[.]20[.]30[.]40", "10 . 20 . 30 . 40", "10(dot)20(dot)30(dot)40", "2001:db8::8a2e:370:7334", "2001:DB8:0:0:0:8A2E:370:7334"]
    for shape in shapes:
        assert (1, shape) in readings(f"login from host {shape} at noon"), shape
    for text in ("at 12:30:45 today", "std::vector", "a :: b", "300[.]20[.]30[.]40"):
        assert not any(k == 1 for k, _ in readings(text)), text
    rows = [(i, f"login from host 10.20.30.{i} at noon") for i in range(12)]
    rows += [(100 + i, f"login from host {shape} at noon") for i, shape in enumerate(shapes)]
    rows += [(200, "seen 10[.]20[.]30[.]5 there"), (201, "seen 1[.]0[.]203[.]05 there")]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.find(documents(rows)).collect()}
    assert all((1, 16, 16 + len(shape)) in got[100 + i] for i, shape in enumerate(shapes))
    assert got[200] == [(1, 5, 21)] and not got[201]


def test_odd_rows(documents, odd_rows):
    rows = odd_rows + [(30, "mail é.a@b.co and a@b.co"), (31, "a@b.co; 10.0.0.1; 4111 1111 1111 1111; +1 (555) 010-1234")]
    got = pii.find(documents(rows, extra=True)).collect()
    assert sorted([(g.doc_id, [tuple(s) for s in g.base]) for g in got], key=repr) == sorted([(d, brute(t or "")) for d, t in rows], key=repr)
    masked = pii.redact(documents(rows, extra=True))
    assert masked.count() == len(rows) and masked.columns[:2] == ["doc_id", "text"]
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert texts[2] is None and texts[3] == "" and texts[31] == "[EMAIL]; [IP]; [CARD]; [PHONE]"


def test_mask_joins_overlapping_spans():
    assert pii.mask("abcdefgh", [(0, 1, 3), (3, 2, 5), (1, 6, 7)]) == "a[EMAIL]f[IP]h"


def test_query_against_the_patterns(spark):
    docs = {d.doc_id: d.text for d in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = pii.op5_pii(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    for r in rows:
        spans = brute(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == s[0] for s in spans) for k in range(4)]
        listed = [f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans]
        assert r.base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(r.spans.split(",")) | {""}


def test_empty(documents):
    assert pii.find(documents([])).count() == 0 and pii.redact(documents([])).count() == 0


def test_other_addresses_of_any_length_and_whole_context_words():
    """Long parts are not cut, and a long neighbour word is one word."""
    import time

    long = "a" * 5000 + " (at) " + ".".join(["b" * 100] * 30)
    text = f"mail {long} now"
    assert pii.candidates(text, []) == [(0, 5, 5 + len(long), 5)]

    def plain(text, a, b):
        def name(w, back=False):
            w = re.sub("[0-9]", "0", w.lower())
            return w if len(w) <= pii.NAMED else "#" + hashlib.blake2b((w[::-1] if back else w).encode(), digest_size=16).hexdigest()

        before, after = text[:a].split(), text[b:].split()
        out = [f"{name(before[-2])} {name(before[-1])} _"] if len(before) > 1 else []
        return out + ([f"{name(before[-1])} _ {name(after[0], True)}"] if before and after else [])

    glued = ",".join(f"X{i % 7}1234567" for i in range(40))
    for text in ("", "one", "a b 5551234567 c", f"{'w' * 90} {glued} {'z' * 200}", f"call{' ' * 200}5551234567{' ' * 200}now"):
        spans = [m.span() for m in re.finditer("[0-9]{7,}", text)]
        assert pii.contexts(text, spans) == [plain(text, a, b) for a, b in spans]
    text = "x" + ",".join(["1234567"] * 200_000)  # one word with very many candidates
    t = time.time()
    assert len(pii.contexts(text, [(1 + 8 * i, 8 + 8 * i) for i in range(200_000)])) == 200_000
    assert time.time() - t < 30
