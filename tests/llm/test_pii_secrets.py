import base64
import bz2
import gzip
import math
import re
import urllib.parse
import zlib
from collections import Counter

import pytest
import regex
import zstandard
from pyspark.sql import functions as F

from tallyline.llm import common, pii, secrets

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch)
        total += (2 * d - 9 if d > 4 else 2 * d) if i % 2 else d
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    return 10 <= len(digits) <= 15 if kind == "phone" else True


def brute(text):
    return sorted((m.start(), i, m.end(), k) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if valid(k, m[0]))


TRICKY = [
    "a@b.c_d@e.f x@y..z .@a.b a@b",
    "1.2.3.4.5.6.7.8 999.1.1.1 0000000000000000000000001.2.3.255 1.2.3",
    "4111 1111 1111 1111-4111111111111111 4111-1111-1111-1112 5",
    "+1 (456) 555-2186 +12 +++420 123 456 789) +1-2-3-4-5-6-7-8-9-0-1-2-3-4-5-6",
    "é😀 x@y.zz 😀 10.0.0.1",
    "a" * 50_000 + "@" + "b." * 20_000 + "c",
    "1" * 50_000,
    "9.9" * 3000,
]


def spans(rows):
    return {r["doc_id"]: [(s["start"], s["rank"], s["stop"], s["kind"]) for s in r["base"]] for r in rows}


def test_base_spans_of_tricky_texts(spark):
    docs = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    assert spans(pii.find_pii(docs).collect()) == {i: brute(t) for i, t in enumerate(TRICKY)}


def test_base_spans_of_documents(spark, sf, plain):
    got = spans(pii.find_pii(spark.read.parquet(f"{sf}/documents.parquet")).collect())
    assert got == {d: brute(t) for d, t in plain}


def test_edges_and_nothing(edge_docs, no_docs):
    assert pii.find_pii(edge_docs).count() == edge_docs.count()
    assert pii.find_pii(no_docs).count() == 0


def test_terms_that_disclose_an_entity_are_found_and_sanitised(spark):
    secret = [(i, f"notice: Kryptonius writes from bob@corp.com about weather {i}") for i in range(5)]
    other = [(100 + i, f"notice: somebody writes about weather {i}") for i in range(60)]
    docs = spark.createDataFrame([*secret, *other, (500, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    text = dict(secret)[0]
    assert [text[t["start"] : t["stop"]] for t in got[0]["terms"]] == ["Kryptonius", "from"]
    assert got[0]["terms"][0]["share"] > 0.99 and got[100]["terms"] == []
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert clean[0] == "notice: [TERM] writes [TERM] [EMAIL] about weather 0"
    assert clean[100] == dict(other)[100] and clean[500] is None and len(clean) == docs.count()


def secrets_brute(text):
    kinds = {"assign": r"""(?ia:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]+"}
    out = []
    for i, (k, p) in enumerate(kinds.items()):
        for m in re.finditer(p, text or ""):
            size = len(m[2]) if k == "assign" else m.end() - m.start()
            if size >= {"assign": 12, "access": 18, "hex": 16}[k]:
                out.append((m.start(), i, m.end(), k))
    return sorted(out)


def test_base_secrets(plain):
    tricky = ["token:secret: \"abcdefghijklmnop\"", "PassWord = 'abcdefghijkl'", "ſecret=abcdefghijklmnop", "AKIAAKIA1 AKIA" + "Z" * 14, "0123456789abcdef0123456789ABCDEF", ""]
    for text in [*tricky, *(t for _, t in plain)]:
        assert [(a, secrets.KINDS.index(k), b, k) for k, a, b in secrets.base_spans(text or "")] == secrets_brute(text)


def test_nested_layers_map_to_their_runs():
    inner = b"api_key=ZZZZyyyyxxxx1111"
    runs = {
        "assign.base64.gzip": base64.b64encode(gzip.compress(inner, mtime=0)).decode(),
        "assign.url": urllib.parse.quote('token="QQQQwwwweeee"', safe=""),
        "assign.base64.base64": base64.b64encode(base64.b64encode(b"secret: qwertyuiopasdf")).decode(),
        "assign.unicode": "".join(f"\\u{ord(c):04x}" for c in "passwd=mnbvcxzlkjhgf"),
    }
    text = " é😀 ".join(runs.values())
    found = {k: text[a:b] for k, a, b in secrets.hidden_spans(text) if k in runs}
    assert set(found) == set(runs)
    for kind, part in found.items():
        assert part in runs[kind] and len(part) > 0.6 * len(runs[kind])


def test_cycles_and_bombs_end():
    bomb = base64.b64encode(gzip.compress(b"0" * 50_000_000)).decode()
    assert secrets.hidden_spans(bomb)[0][0].startswith("hex.base64.gzip")
    assert secrets.hidden_spans("%25" * 50 + "%2541") == []


def test_secret_edges(edge_docs, no_docs, spark):
    found = edge_docs.select(secrets.find_secrets(F.col("text")).alias("f"))
    assert found.count() == edge_docs.count() and found.where("size(f.base) + size(f.hidden) > 0").count() == 0
    assert no_docs.select(secrets.find_secrets(F.col("text"))).count() == 0


def opened(text):
    return {(k, text[a:b]) for k, a, b in secrets.hidden_spans(text)}


def test_partly_escaped_secrets_are_found():
    u = lambda c: f"\\u{ord(c):04x}"
    assert opened(f"é token{u('=')}abcdefghijkl!") == {("assign.unicode", f"token{u('=')}abcdefghijkl")}
    q = u('"')
    assert opened(f"{q}password{q}:{q}abcdefghijkl{q}") == {("assign.unicode", f"password{q}:{q}abcdefghijkl")}
    assert opened("x%FFtoken%3Dabcdefghijkl") == {("assign.url", "token%3Dabcdefghijkl")}
    broken = base64.b64encode(b"a>>>?secret: qwertyuiopasdf??>>").decode().replace("+", u("+")).replace("/", u("/"))
    assert ("assign.unicode.base64" in {k for k, _ in opened(broken)}) and "\\u" in broken
    assert opened(f"a{u(' ')}b token=abcdefghijkl %20") == set()  # it stands in the text as it is
    both = f"token{u('%')}3Dabcdefghijkl"
    assert opened(both) == {("assign.unicode.url", both)}


def test_compressed_layers_are_read_whole():
    name = lambda raw: {k for k, _, _ in secrets.hidden_spans(base64.b64encode(raw).decode())}
    inner, filler = b"token=abcdefghijkl", "é filler, ".encode() * 500_000
    for pack, kind in ((gzip.compress, "gzip"), (zlib.compress, "zlib"), (bz2.compress, "bzip2"), (zstandard.compress, "zstd")):
        assert f"assign.base64.{kind}" in name(pack(filler + inner))  # behind the first blocks
        assert f"assign.base64.{kind}" in name(pack(b"a, " + inner + b"! \xc3"))  # cut inside a character
        assert f"assign.base64.{kind}" in name(pack(b"first, ") + pack(inner))  # in the second member
    assert "assign.base64.gzip" in name(gzip.compress(inner + b", " + filler)[:-20])  # cut off


def test_content_that_unpacks_to_itself_ends(monkeypatch):
    quine = b"\x1f\x8bquine"
    monkeypatch.setattr(secrets, "_unpacked", lambda blocks: iter((b"".join(blocks),)))
    assert secrets.hidden_spans(base64.b64encode(quine * 3).decode()) == []


def test_terms_disclose_anywhere_at_any_count_and_length(spark):
    far = "weather is fine and mild " * 10
    docs = [(1, f"Zoë7 李 writes. {far} bob@corp.com"), (2, "who is zoë7 and 李"), (3, "İki 10.0.0.1"), *((10 + i, far) for i in range(60))]
    more = spark.createDataFrame([*docs, *((1000 + i, far) for i in range(3000))], "doc_id long, text string")
    got = {r["doc_id"]: [dict(docs).get(r["doc_id"], far)[t["start"] : t["stop"]] for t in r["terms"]] for r in pii.find_pii(more).collect()}
    assert got[1] == ["Zoë7", "李", "writes"] and got[2] == ["zoë7", "李"] and got[1000] == []


def term_spans_brute(texts):
    """[[(start, stop, share)]] of the terms of each text by counting every pair."""
    word = regex.compile("[\\p{L}\\p{M}\\p{N}]+")
    n, n_term, n_entity, n_pair, tokens = len(texts), Counter(), Counter(), Counter(), []
    for text in (t or "" for t in texts):
        base = brute(text)
        chars = list(text)
        for a, _, b, _ in base:
            chars[a:b] = "" * (b - a)
        tokens.append([(m.start(), m.end(), m[0].lower()) for m in word.finditer("".join(chars)) if "" not in m[0]])
        n_term.update({m[0].lower() for m in word.finditer(text)})
        entities = {(k, text[a:b].lower() if k in ("email", "ip") else re.sub("[^0-9]", "", text[a:b])) for a, _, b, k in base}
        n_entity.update(entities)
        n_pair.update((e, w) for e in entities for w in {w for _, _, w in tokens[-1]})
    share = {}
    for (e, w), k in n_pair.items():
        usual = n_entity[e] / n
        if usual < 1:
            known = (k + pii.PRIOR_ROWS * usual) / (n_term[w] + pii.PRIOR_ROWS)
            share[w] = max(share.get(w, -9), math.log2(known / usual) / -math.log2(usual))
    return [[(a, b, round(share[w], 9)) for a, b, w in found if share.get(w, 0) >= pii.GENERALISE] for found in tokens]


def test_terms_match_brute_force(spark, plain, monkeypatch):
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(plain)], "doc_id long, text string")
    want = term_spans_brute([t for _, t in plain])
    assert 100 < sum(map(len, want))
    for most in (None, 0):  # with small sides broadcast, and with every join shuffled
        if most is not None:
            monkeypatch.setattr(common, "MAX_BROADCAST_ROWS", most)
        got = {r["doc_id"]: [(t["start"], t["stop"], round(t["share"], 9)) for t in r["terms"]] for r in pii.find_pii(docs).collect()}
        assert [got[i] for i in range(len(want))] == want


def test_a_text_with_very_many_matches(spark):
    text = " ".join(f"user{i}@corp{i}.com name{i}" for i in range(20_000))
    docs = spark.createDataFrame([(1, text), (2, "name7 and others"), (3, "nothing")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    assert [(s["start"], s["rank"], s["stop"], s["kind"]) for s in got[1]["base"]] == brute(text)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs).collect()}
    assert clean[1].count("[EMAIL] ") == 20_000 and clean[3] == "nothing"


def test_sanitised_keeps_columns_with_clashing_names(spark):
    names = ["_base", "row", "span_key", "found", "text_key", "base", "terms", "a.b", "spans"]
    docs = spark.createDataFrame([(1, "a@b.cc, 1.2.3.4@x.y", *names), (2, None, *names)], ["doc_id", "text", *names])
    assert [tuple(r) for r in pii.sanitised(docs).orderBy("doc_id").collect()] == [(1, "[EMAIL], [IP]", *names), (2, None, *names)]


def test_possibly_in_passes_all_that_occur(spark):
    keys, rows = spark.range(0, 3000, 3).toDF("k"), spark.range(100_000).toDF("k")
    passed = {r["k"] for r in common.possibly_in(rows, "k", keys).collect()}
    assert passed >= set(range(0, 3000, 3)) and len(passed) < 10_000
    assert common.possibly_in(rows, "k", keys.limit(0)).count() == 0


def test_base64_out_of_step_wrapped_and_wide():
    inner = b"note: token=abcdefghijkl, and so on for a while"
    run = base64.b64encode(inner).decode()
    for before in ("", "id/", "x-", "a_b/", "user+"):
        assert "assign.base64" in {k for k, _ in opened(f"see {before}{run} there")}, before
        packed = base64.b64encode(gzip.compress(inner)).decode()
        assert "assign.base64.gzip" in {k for k, _ in opened(f"see {before}{packed} there")}, before
    wrapped = "\n".join(run[i : i + 20] for i in range(0, len(run), 20))
    text = f"begin:\n{wrapped}\n.end"
    (kind, start, stop), = secrets.hidden_spans(text)
    assert kind == "assign.base64" and text.index(wrapped) < start < stop < text.index(".end") and "\n" in text[start:stop]
    for wide in ("utf-16-le", "utf-16", "utf-32-be"):
        assert "assign.base64.utf16" in {k for k, _ in opened(base64.b64encode(inner.decode().encode(wide)).decode())}
    assert secrets._replaced("\\ud83d\\ude00!", secrets.ESCAPED, secrets._escaped_bytes)[0].decode() == "😀!"


@pytest.mark.parametrize("nested", ["%" + "25" * 50_000 + "41", "\\" + "u005c" * 20_000 + "u0041", "%78%9c" * 20_000, "%25" * 30_000])
def test_nested_escapes_take_memory_and_time_in_proportion(nested):
    import time
    import tracemalloc

    tracemalloc.start()
    began = time.time()
    assert secrets.hidden_spans(nested) == []
    assert time.time() - began < 30 and tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()


def test_nested_escape_signs_are_undone_in_one_step():
    assert opened("token%25253Dabcdefghijkl") == {("assign.url", "token%25253Dabcdefghijkl")}
    text = "\\u005cu0022password\\u005cu0022:\\u005cu0022abcdefghijkl\\u005cu0022"
    assert {k for k, _ in opened(text)} == {"assign.unicode"}
    assert opened("token%5Cu003dabcdefghijkl") == {("assign.url.unicode", "token%5Cu003dabcdefghijkl")}
