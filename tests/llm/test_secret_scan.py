import base64
import hashlib
import random
import re
import string
import uuid

import pytest

from encore.llm import secret_scan as scan

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def plain_base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


@pytest.mark.parametrize("seed", range(40))
def test_base_spans_against_the_plain_expressions(seed):
    r = random.Random(seed)
    parts = ["password", "PassWd", "ſecret", "toKen", "secret", "api_key", "APIKEY", "=", ":", " ", "  ", '"', "'", "abc", "abcdef", "AKIA", "Z" * 15, "0" * 23, "f" * 24, "é", "\n", "AKIAAKIA", "x=y-z/", "İ"]
    text = "".join(r.choices(parts, k=60))
    assert scan.base_spans(text) == plain_base(text)


CODE = """import os
class Client{n}:
    def connect_to_service(self, endpoint_address, retry_interval): return open_connection(endpoint_address)
    def disconnect_from_service(self, connection_handle): close_connection(connection_handle, retry_interval)
"""


def secrets(seed):
    r = random.Random(seed)
    draw = lambda n: "".join(r.choices(string.ascii_letters + string.digits, k=n))
    return [draw(20), draw(32), draw(40), base64.b64encode(r.randbytes(24)).decode(), str(uuid.UUID(int=r.getrandbits(128))).upper(), "xoxb-" + draw(24)]


CONTEXTS = ["Authorization: Bearer {}", "client key is {} .", "set the signing key\n    {}\n", "db_pwd ({})", "credential file holds {} and", 'auth="{}"']


def spans(row):
    return [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in row["spans"].split(",") if s)]


def judged(docs):
    rows = scan.find(docs).select("doc_id", scan.listed("base").alias("base"), scan.listed("spans").alias("spans")).collect()
    return {r["doc_id"]: r for r in rows}


def test_planted_secrets_are_found_and_names_are_not(documents):
    rows, planted, names = [], {}, 0
    known = ["connect_to_service", "open_connection2connect", "endpoint_address", "retry_interval", "/usr/lib/client/Client7.py"]
    for n in range(60):
        code = CODE.replace("{n}", str(n))
        value = secrets(n)[n % 6]
        where = CONTEXTS[(n // 6) % 6]
        if n % 2:
            text = code + where.format(value) + "\n" + code
            planted[n] = (text.index(value), text.index(value) + len(value))
        else:
            text = code + where.format(known[n % 5]) + "\n" + value[:11] + "\n" + code
            names += 1
        rows.append((n, text))
    got = judged(documents(rows))
    hit = sum(("novel", *planted[n]) in spans(got[n]) for n in planted)
    wrong = sum(any(k == "novel" for k, _, _ in spans(got[n])) for n in range(60) if n not in planted)
    assert hit / len(planted) >= 0.95
    assert wrong / names <= 0.05


def test_a_random_string_without_a_sensitive_context_is_no_candidate(documents):
    value = secrets(1)[1]
    got = judged(documents([(1, f"the build {value} is done"), (2, f"a passage of text {value}"), (3, f"token of one two three four {value}")]))
    assert all(r["spans"] == "" for r in got.values())


def test_copies_do_not_make_a_secret_known(documents):
    value = secrets(2)[2]
    rows = [(n, f"{CODE}client key {value} end") for n in range(300)] + [(900, f"twice: client key {value} and {value}")]
    got = judged(documents(rows))
    assert all("novel" in r["spans"] for r in got.values())


def test_many_contexts_make_an_identifier_known(documents):
    name = "Zq8Xw3Kv7Lp2Rt"
    rows = [(n, f"word{n} {name} and w{n}x {name}") for n in range(200)] + [(900, f"client key {name} end")]
    assert judged(documents(rows))[900]["spans"] == ""
    assert "novel" in judged(documents(rows[-1:]))[900]["spans"]


def test_candidates_and_base_spans_do_not_overlap():
    value = secrets(3)[2]
    text = f'token = "{value}" and auth: {"a1" * 20} bearer {value}'
    base = scan.base_spans(text)
    found = scan.candidates(text, base)
    assert found and all(b <= s or e <= a for a, b in found for s, _, e in base)


def test_long_texts_are_linear():
    value = secrets(4)[1]
    for text in ("secret" * 100_000, "token " * 100_000, "key:" * 200_000, "0" * 2_000_000, "client key " + "a" * 1_000_000, "api key" + " " * 1_000_000 + value):
        base = scan.base_spans(text)
        scan.candidates(text, base)
    assert scan.candidates(text, base) == [(len(text) - len(value), len(text))]


def test_odd_rows(documents, odd_rows):
    rows = odd_rows + [(20, "client key " + secrets(5)[1])] * 2
    out = scan.find(documents(rows, extra=True)).select("doc_id", scan.listed("base").alias("base"), scan.listed("spans").alias("spans")).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in rows)
    want = {i: ",".join(f"{scan.KINDS[k]}:{a}:{b}" for a, k, b in plain_base(t or "")) for i, t in (r[:2] for r in rows)}
    assert all(r["base"] == want[r["doc_id"]] for r in out)
    assert sum("novel" in r["spans"] for r in out) == 2


def test_empty(documents):
    assert scan.find(documents([])).count() == 0


def test_query_counts_base_spans(spark, tmp_path, documents):
    text = 'x token = "abcdef123" AKIA' + "Q" * 16 + " " + "0a" * 12 + " password: 12345 tokens"
    documents([(1, text), (2, None)]).write.parquet(str(tmp_path / "documents.parquet"))
    a, b = scan.op11_secret_scan(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert (a["n_assign"], a["n_access"], a["n_hex"], b["n_assign"]) == (1, 1, 1, 0)
    base = ",".join(f"{scan.KINDS[k]}:{s}:{e}" for s, k, e in plain_base(text))
    assert a["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and a["spans"].startswith(base[:10])
    assert b["base_sha256"] == hashlib.sha256(b"").hexdigest() and b["spans"] == ""
