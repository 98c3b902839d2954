import hashlib
import re

from weftgraph.llm import secrets

PYTHON = {"assign": re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), "access": re.compile("AKIA[A-Z0-9]+"), "hex": re.compile("[0-9a-f]+")}


def base(text):
    found = []
    for rank, (kind, _, group, least) in enumerate(secrets.BASE):
        found += [(m.start(), rank, m.end(), kind) for m in PYTHON[kind].finditer(text) if len(m.group(group)) >= least]
    return sorted(found)


KEY, HEX, LIVE = "AKIA" + "Q7" * 9, "0a1b" * 8, "Zx9" * 12
TEXTS = [
    None, "", "no secrets", f"é😀 password = \"{HEX}\" and {KEY}", "token=token:abcdefg token: ab secret:abcdef", f"API_KEY: '{KEY}' apikey=abc.def", HEX + "g" + HEX[:23],
    "passwd==x PASSWORD=======", f"live {LIVE} here", "AKIAAKIA AKIA" + "B" * 15 + " AKIA" + "B" * 16, "secret = " + "k" * 500 + " \n token\t: abcdef", f"{LIVE}",
]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, base string")


def test_base_spans_match_the_pattern_reader(spark):
    rows = [(i, t, f"s{i % 4}") for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], None), (3, TEXTS[3], "s3"), (3, "other text", "s3"), (50, "word " * 30_000 + KEY, "s1")]
    got = secrets.secret_query(table(spark, rows)).collect()
    assert len(got) == len(rows)
    want = []
    for d, t, _ in rows:
        b = base(t or "")
        joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in b)
        want.append((str(d), *[sum(x[3] == k for x in b) for k in PYTHON], hashlib.sha256(joined.encode()).hexdigest()))
    assert sorted((str(r["doc_id"]), r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == sorted(want)
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] not in (3, 50):
            b = base(TEXTS[r["doc_id"]] or "")
            assert {f"{k}:{s}:{e}" for s, _, e, k in b} <= set(r["spans"].split(",")) | {""}


def test_ownership_separates_examples_from_live_ones(spark):
    rows = [(i, f"key {KEY} and {LIVE}", f"owner{i}") for i in range(10)] + [(100, f"password: hunter2hunter2 {'Ab1' * 15}", "me"), (101, "password: hunter2hunter2", "me")]
    got = {r["doc_id"]: r for r in secrets.secret_query(table(spark, rows)).collect()}
    assert got[0]["n_live"] == 0 and got[0]["spans"] == "access:4:26"  # copied everywhere: the opaque run is no secret
    assert got[100]["n_live"] == 2 and "opaque:25:70" in got[100]["spans"]


def test_redaction(spark):
    rows = [(1, f"é a password={HEX} z", "s"), (2, None, "s"), (3, "clean", None), (1, f"é a password={HEX} z", "s")]
    out = secrets.redact(table(spark, rows).withColumnRenamed("base", "n_chars").selectExpr("doc_id", "text", "source", "cast(length(text) as bigint) n_chars"))
    assert out.columns == ["doc_id", "text", "source", "n_chars"]
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted([(1, "é a [secret] z", "s", 14), (1, "é a [secret] z", "s", 14), (2, None, "s", None), (3, "clean", None, 5)], key=str)


def test_redaction_with_clashing_columns(spark):
    rows = spark.createDataFrame([(1, f"password={HEX}", "s", 1, "a", "b", "c")], "doc_id long, text string, source string, spans int, _own string, _id string, _doc string")
    out = secrets.redact(rows)
    assert out.columns == rows.columns and tuple(out.first()) == (1, "[secret]", "s", 1, "a", "b", "c")


def test_an_owner_may_repeat_its_secret(spark):
    """60 documents of one source, one document with 60 repeats, and 4 sources with another token."""
    many, own, shared = "Many1" * 8, "Own22" * 8, "Shared3" * 8
    rows = [(i, f"text {i} {many} {KEY}", "me") for i in range(60)] + [(60, f"{own} " * 60, "you")] + [(70 + i, f"word {shared} password={HEX}", f"s{i}") for i in range(4)]
    docs = table(spark, rows)
    got = {r["doc_id"]: r for r in secrets.secret_query(docs).collect()}
    assert all(got[i]["n_live"] == 2 and got[i]["spans"].startswith("opaque:") and ",access:" in got[i]["spans"] for i in range(60))
    assert got[60]["n_live"] == 60 and got[60]["spans"].count("opaque:") == 60
    assert all(got[70 + i]["n_live"] == 0 and "opaque" not in got[70 + i]["spans"] for i in range(4))
    texts = {r["doc_id"]: r["text"] for r in secrets.redact(docs).collect()}
    assert texts[5] == "text 5 [secret] [secret]" and texts[60] == "[secret] " * 60 and texts[70] == f"word {shared} [example secret]"


def test_empty(spark):
    assert secrets.secret_query(table(spark, [])).count() == 0


def test_very_many_spans_in_one_text(spark):
    """More spans than one run of the fold, of all kinds and overlapping, against a plain reading of the text."""
    import re

    parts = [f"password = hunter{k}x é {'0a' * 13}{k:x} token: {HEX}{k}" if k % 3 else f"AKIA{'B2' * 9} plain {'Zx9' * 12}{k}" for k in range(700)]
    text = " | ".join(parts)
    got = secrets.secret_query(table(spark, [(1, text, "s")])).first()
    plain = []
    for rank, (kind, pattern, group, least) in enumerate(secrets.BASE):
        plain += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    plain.sort()
    assert got["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in plain).encode()).hexdigest()
    assert got["n_assign"] > 2 * secrets.RUN and got["n_hex"] > 2 * secrets.RUN
    every = sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in got["spans"].split(",")))
    assert len(every) > len(plain)
    out, at = [], 0
    for start, end in every:
        if start >= at:
            out.append(text[at:start] + "[secret]")
        at = max(at, end)
    assert secrets.redact(table(spark, [(1, text, "s")])).first()["text"] == "".join(out) + text[at:]
