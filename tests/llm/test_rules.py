import base64
import hashlib
import itertools
import random
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest

from limnos.llm import chat, licenses, quality, warc
from tests.llm import cases


def test_measures(spark):
    docs = cases.documents(spark)
    got = quality.host_quality(docs)
    want = sorted(((i, *cases.measures(t)) for i, t in cases.pairs(docs)), key=repr)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert cases.rows(got, "doc_id", *names) == want
    assert quality.host_quality(docs.limit(0)).count() == 0


def hosts(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [(i, "no" if i % 4 else good, "bad") for i in range(400)] + [(1000 + i, good, f"good{i % 3}") for i in range(300)]
    rows += [(2000, "no", "small"), (2001, good, "small"), (None, good, None), (3, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_host_verdicts(spark):
    docs = hosts(spark)
    got = {(r["doc_id"], r["base_failed"]): r["kept"] for r in quality.host_quality(docs).collect()}
    assert not got[0, False] and got[1000, False] and got[2001, False] and not got[2000, True] and got[None, False]
    kept = quality.good_documents(docs.withColumn("__m", docs.doc_id))
    assert kept.columns == [*docs.columns, "__m"]
    assert kept.count() == sum(got[k] for k in got)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    same = lambda frame: sorted(map(repr, frame.itertuples(index=False, name=None)))
    assert same(con.execute(quality.ORACLE).fetchdf()) == same(quality.host_quality(docs).toPandas())


def test_quality_plan_has_no_python(spark):
    plan = quality.host_quality(cases.documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_align():
    for k in range(300):
        r = random.Random(k)
        a, b = ([r.choice("abcdefgh") for _ in range(r.randint(0, 14))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in itertools.pairwise(pairs))
    assert licenses.align(list("abc"), list("abc")) == [(0, 0), (1, 1), (2, 2)]


def common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        for j, (before, y) in enumerate(zip(row[:], b), 1):
            row[j] = before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute_force(words, template):
    """Greatest number of template words in order in any window of twice the template's words."""
    return max([common_length(words[i:i + 2 * len(template)], template) for i in range(len(words))], default=0)


def test_license_at_every_place(spark):
    text, size = "Licensed under the terms of the Apache License, Version 2.0", len(licenses.words_of(licenses.TEMPLATES["Apache-2.0"]))
    notice = licenses.words_of(licenses.TEMPLATES["GPL-3.0-notice"])
    marked = " ".join(w if k % 6 else f"dnl {w}" for k, w in enumerate(notice))
    rows = [(k, f"{'x ' * k}{t} {'y ' * 100}", n) for n, t, m in (("Apache-2.0", text, size), ("GPL-3.0-notice", marked, len(notice))) for k in range(m)]
    got = licenses.license_scan(spark.createDataFrame(rows, "k long, text string, name string").selectExpr("row_number() OVER (ORDER BY name, k) AS doc_id", "*")).collect()
    want = sorted((n, k, t) for k, t, n in rows)
    assert len(got) == len(want)
    for r in got:
        name, k, text = want[r["doc_id"] - 1]
        assert (r["license"], r["coverage"]) == (name, 1.0), (name, k)
        assert [x["first"] for x in r["found"] if x["license"] == name] == [k + ("dnl" in text)]


def test_license_coverage_is_exact(spark):
    r = random.Random(4)
    template = "a b c a d e b f g a".split()
    docs = [(k, " ".join(r.choice("abcdefgxy") for _ in range(r.randint(0, 60)))) for k in range(300)]
    one = spark.createDataFrame([("t", " ".join(template))], "license string, text string")
    got = {x["doc_id"]: x["coverage"] for x in licenses.license_scan(spark.createDataFrame(docs, "doc_id long, text string"), one, 0.6).collect()}
    best = {k: brute_force(t.split(), template) for k, t in docs}
    assert got == {k: n / 10 if n >= 6 else 0.0 for k, n in best.items()}
    assert len({*got.values()}) > 3


VARIANTS = [
    ("This work is licensed under the GNU General Public License, version 2", "GPL-2.0"),
    ("This work is licensed under the GNU General Public License, version 1", None),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-4.0-notice"),
    ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-4.0"),
    ("This work is licensed under a Creative Commons Attribution 2.0 International License", None),
    ("Released under the Foo License", None),
    (licenses.TEMPLATES["GPL-3.0-notice"].replace("General", "Lesser General"), "LGPL-3.0-notice"),
    (licenses.TEMPLATES["GPL-3.0-notice"].replace("3", "2"), "GPL-2.0-notice"),
    (licenses.TEMPLATES["Apache-2.0-notice"].replace("this file", "these files"), "Apache-2.0-notice"),
]


def test_license_variants(spark):
    whole = [(t, n) for n, t in licenses.TEMPLATES.items()]
    assert {"GPL-2.0", "LGPL-2.1", "CC-BY-SA-4.0", "BSD-3-Clause", "BSD-4-Clause", "MPL-2.0", "ISC", "CC0-1.0"} <= {n for _, n in whole}
    lesser = f"{VARIANTS[6][0]} {'x ' * 200} {licenses.TEMPLATES['GPL-3.0-notice'].replace('redistribute', 'share')}"
    rows = [(k, f"x x {t} y y") for k, (t, _) in enumerate(VARIANTS + whole)] + [(1000, lesser)]
    got = {r["doc_id"]: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (text, name) in enumerate(VARIANTS + whole):
        assert {x["license"] for x in got[k]["found"]} == ({name} if name else set()), (text, got[k]["found"])
        assert got[k]["license"] == name
    assert {x["license"] for x in got[1000]["found"]} == {"LGPL-3.0-notice", "GPL-3.0-notice"}


def test_license_scan(spark):
    filler = " ".join(f"x{i}" for i in range(500))
    full = {n: t for n, t in licenses.TEMPLATES.items()}
    rows = [(i, f"{filler} {t.upper()} {filler}", n) for i, (n, t) in enumerate(full.items())]
    rows += [(50, f"{full['MIT']}. {filler} {full['MIT']}. {filler} {full['GPL-3.0']}.", "GPL-3.0"), (51, filler, None), (52, None, None), (None, "", None),
             (53, "Released under the BSD License", None), (54, full["MIT-notice"].replace("free of charge", "free of any charge"), "MIT-notice")]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").selectExpr("*", "'e' AS found", "1 AS license")
    got = {r["doc_id"]: r for r in licenses.license_scan(docs).collect()}
    for i, text, name in rows:
        assert got[i]["license"] == name, (text, got[i])
        for hit in got[i]["found"]:
            part = licenses.words_of(text)[hit["first"]:hit["last"] + 1]
            assert hit["coverage"] >= 0.9 and len(part) >= hit["matched"]
    assert {x["license"] for x in got[50]["found"]} == {"MIT", "GPL-3.0"}
    assert licenses.license_scan(docs.limit(0)).count() == 0
    none = spark.createDataFrame([(None, None), ("void", " - ")], "license string, text string")
    assert licenses.license_scan(docs, none).where("n_licenses > 0").count() == 0


def test_too_many_templates_are_refused(spark, monkeypatch):
    monkeypatch.setattr(licenses, "TEMPLATE_BYTES", 10)
    with pytest.raises(ValueError, match="several calls"):
        licenses.license_scan(spark.createDataFrame([(1, "a")], "doc_id long, text string"))


PAGES = [(1, "http://a b\r\nWARC-Type: x", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n"), (2, None, None), (None, "u", "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n"),
         (4, None, ""), (3, "é", "日\n"), (3, "é", "日\n"), (7, "l", "long " * 60_000), (8, "m", "long " * 60_000), (None, None, None)]


@pytest.mark.parametrize("least", [0, 4])
def test_warc_round_trip(spark, least):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'e' AS record_id", "1 AS payload").repartition(3)
    got = warc.warc_revisits(pages, least).collect()
    assert len(got) == len(PAGES)
    sha = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    groups = defaultdict(list)
    for i, _, html in PAGES:
        groups[html or ""].append(i)
    for html, ids in groups.items():
        mine = [r for r in got if r["payload_digest"] == sha(html)]
        assert sorted(map(repr, (r["page_id"] for r in mine))) == sorted(map(repr, ids))
        assert {r["payload_bytes"] for r in mine} == {len(html.encode())}
        first = max((i for i in ids if i is not None), default=None)
        again = [r for r in mine if r["record_type"] == "revisit"]
        assert len(again) == (len(ids) - 1 if len(html.encode()) >= least else 0)
        assert all(r["refers_to"] == first for r in again) and all(r["refers_to"] is None for r in mine if r not in again)
    assert warc.warc_revisits(pages.limit(0), least).count() == 0


def test_archive_keeps_payloads_and_is_well_formed(spark, tmp_path):
    import gzip
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(2)
    path = str(tmp_path / "warc")
    records = warc.page_records(pages)
    back = warc.read_archive(spark, path, warc.write_archive(records, path)).collect()
    assert sorted((r["payload"] or "") for r in back) == sorted((h or "") for _, _, h in PAGES)
    kinds = Counter()
    for file in (tmp_path / "warc").glob("part-*"):
        raw = gzip.decompress(file.read_bytes())
        while raw:
            head, _, rest = raw.partition(b"\r\n\r\n")
            fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
            assert head.startswith(b"WARC/1.1\r\n")
            size = int(fields[b"Content-Length"])
            assert rest[size:size + 4] == b"\r\n\r\n"
            kinds[fields[b"WARC-Type"]] += 1
            raw = rest[size + 4:]
    assert kinds == {b"response": len(PAGES), b"warcinfo": 1}


def cheapest(roles):
    """Least cost over all plain choices, by the same automaton written out."""
    legal = {"start": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]}

    def add(state):
        ways, out = [(state, 0)], {}
        while ways:
            at, n = ways.pop(0)
            for q in legal[at]:
                if q not in out or out[q] > 2 * n:
                    out[q] = min(out.get(q, 99), 2 * n)
                    if n < 4:
                        ways.append((q, n + 1))
        return out
    costs = {"start": 0}
    for role in roles:
        now = {}
        for state, c in costs.items():
            for q in chat.ROLES:
                steps = [add(state).get(q, 10 ** 6)] + ([1] if q == state else [])
                total = c + min(steps) + (0 if q == role else 3)
                now[q] = min(now.get(q, 10 ** 9), total)
        costs = now
    return min(costs.values())


def legal_text(text):
    heads = [line[2:-2] for line in text.split("\n") if line in ("<|system|>", "<|user|>", "<|assistant|>")]
    state = "start"
    for h in heads:
        assert h in {"start": ["system", "user"], "system": ["user"], "user": ["assistant"], "assistant": ["user"]}[state], heads
        state = h
    assert text.count("<|end|>\n") == len(heads) and text.endswith("<|end|>\n")
    return heads


def test_chat_repair(spark):
    r = random.Random(2)
    rows = [(c, t, r.choice(["system", "user", "assistant", "Assistant ", "tool", None]), f"text {c} {t}") for c in range(60) for t in range(r.randint(1, 9))]
    rows += [(None, None, "user", None), (None, 2, "user", ""), (70, 1, "assistant", "a"), (70, 1, "assistant", "a"), (70, 1, "assistant", "a")]
    rows += [(80, t, r.choice(chat.ROLES), "x") for t in range(3000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS segment", "'e' AS place").repartition(4)
    got = chat.format_chats(turns).collect()
    assert len(got) == len(rows)
    convs = defaultdict(list)
    for row in got:
        convs[row["conv_id"]].append(row)
    assert set(convs) == {x[0] for x in rows}
    for conv, found in convs.items():
        found.sort(key=lambda x: x["place"])
        if conv is not None:
            assert [x["turn"] for x in found] == sorted(x[1] for x in rows if x[0] == conv)
        heads = legal_text("".join(x["rendered"] for x in found))
        assert len(heads) == sum(x["n_inserted"] for x in found) + sum("merge" not in x["action"] for x in found)
        assert sum(x["cost"] for x in found) == cheapest([chat._normal(x["role"]) for x in found]), conv
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_segments_do_not_change_the_cost():
    roles = [random.Random(5).choice(chat.ROLES) for _ in range(40)]
    batch = lambda rows: pa.RecordBatch.from_pylist(rows)
    turns = [{"conv_id": 1, "segment": i // 7, "place": i, "role": role, "turn": i, "text": "t"} for i, role in enumerate(roles)]
    sums = pa.Table.from_batches(list(chat._sums([batch(turns)])))
    borders = pa.Table.from_batches(list(chat._borders(sums.to_batches()))).to_pylist()
    assert len(borders) == 6 and borders and sum(b["is_last"] for b in borders) == 1
    by = {b["segment"]: b for b in borders}
    made = pa.Table.from_batches(list(chat._render([batch([t | {k: by[t["segment"]][k] for k in ("enter", "leave", "is_last")} for t in turns])]))).to_pylist()
    assert sum(r["cost"] for r in made) == cheapest(roles)
    legal_text("".join(r["rendered"] for r in made))


def test_reach_of_a_passage_is_a_parameter(spark):
    wide = " and so on ".join("licensed under the apache license version 2 0".split())
    docs = spark.createDataFrame([(1, f"see {wide} end")], "doc_id long, text string")
    templates = spark.createDataFrame([("A", "Licensed under the Apache License, Version 2.0")], "license string, text string")
    assert licenses.license_scan(docs, templates).first()["n_licenses"] == 0
    row = licenses.license_scan(docs, templates, reach=4.0).first()
    assert row["license"] == "A" and row["coverage"] == 1.0
