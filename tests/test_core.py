"""Core operators on small fixtures, and every query with an oracle on the small tables."""

import glob
import math
import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from bunko import plans
from bunko.functions import text as fn
from bunko.operators import inventory as inv
from bunko.operators import answers, documents, ordered, runs, search
from bunko.operators.inventory import excluded_reason
from bunko.sources import files, records

DATA = "/root/testdata/sf0.001"


def flat(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return str([flat(x) for x in v])
    return v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, DATA)
    got = sorted(str([flat(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    if name in plans.ORACLES:
        r = duck.execute(plans.ORACLES[name])
        names = [d[0] for d in r.description]
        assert sorted(names) == sorted(df.columns)
        assert got == sorted(str([flat(x[names.index(c)]) for c in sorted(names)]) for x in r.fetchall())


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v")).alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, " １,２３４ ％ＡＢ ", fn.normalize_answer) == "1234%ab"
    assert one(spark, "1, 234", fn.normalize_answer) == "1,234"
    assert one(spark, "1,2,3", fn.normalize_answer) == "1,2,3" and one(spark, "1,2,3", fn.numbers) == [1.0, 2.0, 3.0]
    assert one(spark, "１２ 1,234,567", fn.numbers) == [12.0, 1234567.0]
    assert one(spark, "1,234", fn.normalize_answer) == "1234"
    assert one(spark, "a 1,200 and -3.5", fn.numbers) == [1200.0, -3.5]
    assert one(spark, "x、 y,,z ", fn.elements) == ["x", "y", "z"]
    assert one(spark, "**b** ~~s~~ <u>u</u> [c:FF0000]r[/c]  ==h=={黄} {fill:#FF0000 赤}x {fml:=A1+2} *i*", fn.strip_markup) == "b s u r h x =A1+2 i"
    same = lambda a, b, f: spark.createDataFrame([(a, b)], "a string, b string").select(f(F.col("a"), F.col("b")).alias("x")).first().x
    assert same("５", "5ページ", fn.same_answer) and not same("5人", "5ページ", fn.same_answer) and same("1,200円", "1200円", fn.same_answer) and not same("", "5", fn.same_answer)
    assert same("b、a", "Ａ,b,b", fn.same_elements) and not same("a", "a,b", fn.same_elements) and not same("", "", fn.same_elements)
    assert one(spark, '<answer>```text "「a\n b」" ```</answer>', fn.one_line) == "a b"
    assert one(spark, "CON", fn.safe_name) == "_CON" and one(spark, "a/b?. ", fn.safe_name) == "a_b_" and one(spark, None, fn.safe_name) == "item"
    assert [one(spark, c, fn.colour_name) for c in ("FF0000", "FFFFFF", "000000", "FFD9B3", "00008B", "808080")] == ["赤", "", "黒", "薄オレンジ", "青", "グレー"]
    assert one(spark, "0.1,0,0.5,1", fn.region).x1 == 0.5 and one(spark, "0.5,0,0.1,1", fn.region) is None and one(spark, "a", fn.region) is None
    assert one(spark, "old/a/Plan_v2_final.DOCX", fn.version_key) == "a/Plan.docx"
    assert one(spark, "a/Plan.docx", fn.version_key) == "a/Plan.docx"
    assert one(spark, "abc  def", lambda c: fn.clip(c, 5)) == "abc …"
    assert one(spark, None, fn.normalize_answer) is None and one(spark, None, lambda c: fn.clip(c, 5)) is None


def stripped(text):
    out = re.sub(r"(?s)\[c:[0-9A-Fa-f]{6}\](.*?)\[/c\]", r"\1", text).replace("[/c]", "")
    out = re.sub(r"(?s)==(.*?)==\{[^}]*\}", r"\1", out)
    out = re.sub(r"(?s)\{fml:(.*?)\}", r"\1", re.sub(r"\{(?:shape-)?fill:[^}]*\}", "", out)).replace("<u>", "").replace("</u>", "")
    out = re.sub(r"(?s)~~(.+?)~~", r"\1", re.sub(r"(?s)\*\*(.+?)\*\*", r"\1", out))
    return re.sub(r"[ \t]{2,}", " ", re.sub(r"(?<!\*)\*(?!\*)([^*\n]+?)(?<!\*)\*(?!\*)", r"\1", out))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_markup_of_every_document(spark, sf):
    folder = f"/root/testdata/{sf}"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: (r.text, r.n_chars) for r in plans.QUERIES["markup_stripped"](spark, folder).collect()}
    want = {i: (None, None) if t is None else (stripped(t), len(stripped(t))) for i, t in docs.items()}
    assert got == want and any(t and "**" not in t and "<" not in t and stripped(t) != t for t in docs.values())


def test_delta_partitions_the_keys(spark):
    now = spark.createDataFrame([("a", "1", "x"), ("b", "2", "y"), ("c", None, "z")], "relpath string, md5 string, doc_id string")
    old = spark.createDataFrame([("a", "1", "x"), ("b", "3", "y"), ("c", None, "z"), ("d", "9", "w")], "relpath string, md5 string, doc_id string")
    assert {r.relpath: r.status for r in inv.delta(now, old).collect()} == {"a": "unchanged", "b": "changed", "c": "unchanged", "d": "removed"}
    assert inv.delta(now.limit(0), old.limit(0)).count() == 0


def test_fusion_is_symmetric_and_bounded(spark):
    a = spark.createDataFrame([(1, 10, 0), (1, 11, 1)], "qid bigint, id bigint, rank0 int")
    b = spark.createDataFrame([(1, 11, 0), (1, 12, 1)], "qid bigint, id bigint, rank0 int")
    x, y = ({r.id: r.score for r in search.fuse(*s, 10).collect()} for s in ((a, b), (b, a)))
    assert x == y and max(x.values()) <= 2 / 60 and set(x) == {10, 11, 12}


def test_bm25_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "  ")], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "a word")], "qid bigint, query string")
    assert search.bm25(search.build(docs, "doc_id", "text"), asked, 5).count() == 0
    assert search.bm25(search.build(docs.limit(0), "doc_id", "text"), asked, 5).count() == 0


def test_plan_of_a_search(spark):
    plan = plans.QUERIES["bm25_search"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.count("Exchange hashpartitioning") <= 4


def test_many_lexical_queries_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{int(x)}" for x in rng.zipf(1.4, 4000) % 300]
    rows = [(i, " ".join(words[i * 9 : i * 9 + 3 + i % 7]) + " 受領一覧" * (i % 3), i % 2 == 0) for i in range(200)]
    rows += [(300 + i, t, k) for i, (_, t, k) in enumerate(rows[:50])] + [(900, None, True), (901, "", False), (902, "w1", None)]  # ties
    docs = spark.createDataFrame(rows, "id bigint, text string, kept boolean")
    asked = docs.where("id % 3 = 0").select(F.col("id").alias("qid"), F.col("text").alias("query"))
    index = search.build(docs, "id", "text")
    for name, n in (("LEXICAL_QUERIES", 20), ("LEXICAL_GROUP", 30), ("PACKED", 7), ("SCORED", 14)):
        monkeypatch.setattr(search, name, n)
    for kept, keep in ((docs, docs.where("kept").select("id")), (docs.withColumn("kept", F.lit(True)), None)):
        got, want = ({(r.qid, r.rank0): (r.id, round(r.score, 6)) for r in x.collect()} for x in (search.bm25_many(kept, asked, 5), search.bm25(index, asked, 5, keep)))
        assert got == want and len(got) > 100
    assert search.bm25_many(docs.limit(0), asked, 5).count() == 0 and search.bm25_many(docs, asked.limit(0), 5).count() == 0


@pytest.mark.parametrize("query", ["bm25_search_all", "bm25_search_filtered_all", "rrf_fusion_all"])
def test_postings_of_many_queries_are_no_rows(spark, query):
    plan = plans.QUERIES[query](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroups" in plan and "tf#" not in plan and "dl#" not in plan


def test_signs_beyond_the_basic_plane_in_terms(spark):
    assert sorted(one(spark, "\U00020BB7野家A1 ー ⺀b \U00020BB7", fn.tokens)) == sorted(["a1", "ー", "⺀", "b", "\U00020BB7野", "野家", "\U00020BB7", "a1"]) and one(spark, "ÄÖ-٣ 々", fn.tokens) == ["äö", "٣", "々"]


def test_terms(spark):
    got = one(spark, "受領一覧 a_b.md Grazuの設定 漢 x", fn.tokens)
    assert sorted(got) == sorted(["a", "b", "md", "grazu", "x", "受領", "領一", "一覧", "の設", "設定", "漢", "a_b.md", "grazu"])


def test_dense_of_many_queries_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(size=(300, 8)), 1)
    v[200:] = v[:100]  # ties
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(900, None)], "id bigint, v array<double>")
    asked = vectors.where("id % 3 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    for name, n in (("QUERY_BLOCK", 30), ("VECTOR_GROUP", 70), ("CHUNK", 11)):
        monkeypatch.setattr(search, name, n)
    monkeypatch.setattr(type(asked), "collect", None)  # queries stay off the driver
    near = search.dense(vectors, asked, 10)
    monkeypatch.undo()
    got = {(r.qid, r.rank0): r.id for r in near.collect()}
    order = {i: sorted(range(300), key=lambda j: (-round(float(v[i] @ v[j]), 9), j)) for i in range(0, 300, 3)}
    assert got == {(i, n): order[i][n] for i in order for n in range(10)}


def test_every_hundredth_row_is_a_query(spark):
    near = plans.QUERIES["dense_topk_all"](spark, "/root/testdata/sf0.01")
    ids = [r.vec_id for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").where("vec_id % 100 = 0").collect()]
    assert {r.qid for r in near.collect()} == set(ids) and len(ids) > 0


def test_term_statistics_of_rare_terms_too(spark):
    got = plans.QUERIES["bm25_term_stats_all"](spark, DATA)
    assert got.where("df = 1").count() > 0
    assert got.count() == search.postings(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id", "text").where("term IS NOT NULL").select("term").distinct().count()


def test_lookup_prefers_exact_and_refuses_ambiguous(spark):
    files = spark.createDataFrame([("a/x.txt",), ("b/x.txt",), ("b/y.txt",), ("x.txt",), (None,)], "relpath string")
    asked = spark.createDataFrame([("x.txt",), ("y.txt",), ("a/x.txt",), ("q",)], "name string")
    assert {r.name: (r.relpath, r.how) for r in inv.resolve(asked, files).collect()} == {"x.txt": ("x.txt", "exact"), "y.txt": ("b/y.txt", "name"), "a/x.txt": ("a/x.txt", "exact"), "q": (None, None)}


def test_pairing_is_first_in_first_out(spark):
    rows = [("r", 1, i, float(i), k, "t") for i, k in enumerate(["tool_call", "tool_call", "tool_result", "tool_call"])]
    e = spark.createDataFrame(rows, "run_id string, q_index int, seq bigint, t double, type string, tool string")
    assert {r.call_seq: r.result_seq for r in runs.pairs(e).collect()} == {0: 2, 1: None, 3: None}


def test_chunks_hold_the_whole_text():
    rnd = np.random.default_rng(3)
    for _ in range(30):
        text = "\n\n".join("\n".join("w" * int(rnd.integers(0, 300)) for _ in range(int(rnd.integers(1, 12)))) for _ in range(int(rnd.integers(1, 9))))
        whole = [x for x in text.split("\n") if x.strip()]
        assert [x for c in documents.pack(text, 200, False) for x in c.split("\n") if x.strip()] == whole
        assert all(len(c) // 2 <= 320 for c in documents.pack(text, 200, False)) or len(documents.pack(text, 200, False)) == 1
    assert documents.pack("short", 10, True) == ["short"] and documents.pack("aaaa\n" * 300, 100, True)[1].startswith("aaaa\naaaa")


def test_tables_and_back(spark):
    text = "x\n| a | b |\n|---|---|\n| 1 | **2** |\n\n| no rule |\n| here |\ny"
    pages = spark.createDataFrame([(1, text), (2, None), (3, "")], "page_id bigint, text string")
    rows = documents.table_rows(pages, "page_id", "text")
    assert sorted((r.table_no, r.row_no, r.cells) for r in rows.collect()) == [(1, 0, ["a", "b"]), (1, 1, ["1", "2"])]
    assert documents.rendered_tables(rows, "page_id").first().markdown == "| a | b |\n|---|---|\n| 1 | 2 |"
    assert documents.table_rows(pages.limit(0), "page_id", "text").count() == 0


def test_styles(spark):
    on, off, none = F.lit(True), F.lit(False), F.lit(None).cast("string")
    assert one(spark, " a b\u3000", lambda c: fn.styled(c, on, on, on, on, F.lit("yellow"), F.lit("FF0000"))) == " [c:FF0000]==***<u>~~a b~~</u>***=={yellow}[/c]\u3000"
    assert one(spark, "a\nb", lambda c: fn.styled(c, off, F.lit(None).cast("boolean"), off, on, none, none)) == "**a\nb**"
    assert one(spark, " \n ", lambda c: fn.styled(c, on, on, on, on, none, none)) == " \n "
    assert one(spark, None, lambda c: fn.styled(c, on, on, on, on, none, none)) is None


def test_budget_skips_what_does_not_fit(spark):
    sizes = [3, 9, 4, None, 5, 2, 1, 0]
    rows = [(k, i, n, "x") for k in ("a", None) for i, n in enumerate(sizes)] + [("b", 0, 11, "x")]
    got = ordered.within_budget(spark.createDataFrame(rows, "k string, i int, n int, accepted string"), ["k"], "i", "n", 10, 8).collect()
    want = [True, False, True, False, False, True, True, True]
    for k in ("a", None):
        assert [r.accepted for r in sorted((r for r in got if r.k == k), key=lambda r: r.i)] == want
    assert len(got) == len(rows) and not any(r.accepted for r in got if r.k == "b")
    assert ordered.within_budget(spark.createDataFrame([], "k string, i int, n int"), ["k"], "i", "n", 10, 8).count() == 0


def test_page_ranges_and_json(spark):
    no = spark.range(1, 13).select(F.col("id").alias("no"))
    got = lambda r: [x.no for x in no.where(documents.in_ranges(F.col("no"), r)).orderBy("no").collect()]
    assert got("1-2, 4,11-") == [1, 2, 4, 11, 12] and got("-3") == [1, 2, 3] and got(None) == got("x") == list(range(1, 13))
    assert documents.first_json('a } {"x": "}{", "y": {"z": 1}} {') == '{"x": "}{", "y": {"z": 1}}' and documents.first_json("{ {") is None


def test_every_exclusion(spark, tmp_path):
    kept = ["a/x.txt", "a/venvx.md", "a/b.py"]
    left = {"a/~$x.docx": "office lock file", "a/.~lock.x#": "lock file", "a/x.pyc": "compiled file", "Thumbs.db": "system file", "a/node_modules/x.js": "pruned folder", ".git/x": "pruned folder"}
    for name in [*kept, *left]:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" if name == "a/b.py" else b"x")
    got = {r.path.split(str(tmp_path) + "/")[1]: r.reason for r in files.listed(spark, str(tmp_path)).collect()}
    assert got == dict.fromkeys(kept) | {k: v for k, v in left.items() if "/." not in f"/{k}"}
    reasons = {n: one(spark, n, excluded_reason) for n in left}
    assert reasons == left
    rows = {r.path.split(str(tmp_path) + "/")[1]: r for r in files.contents(spark, str(tmp_path)).collect()}
    assert sorted(rows) == sorted(kept) and rows["a/b.py"].encrypted and not rows["a/x.txt"].encrypted


def test_encodings(spark):
    raw = [("日本語".encode("cp932"), "cp932"), ("日本語".encode("utf-8-sig"), "utf-8-sig"), ("plain".encode(), "utf-8-sig"), (b"\x81", "latin-1"), (None, None), (b"", "utf-8-sig")]
    got = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(raw)], "i int, c binary").select("i", files.decoded("c").alias("d")).orderBy("i").collect()
    assert [r.d.encoding for r in got] == [e for _, e in raw] and got[0].d.text == got[1].d.text == "日本語"


def test_previews(spark):
    text = "a,b\n" + "\n".join(f"{i},\"x,{i}\"" for i in range(300)) + "\n,\n"
    got = spark.createDataFrame([(text,), (None,), ("a,b\n1,2",)], "t string").select(files.tabular_preview(",")("t").alias("p")).collect()
    assert [(r.p.n_rows, len(r.p.rows), r.p.truncated) for r in got] == [(300, 26, True), (0, 0, False), (1, 2, False)] and got[0].p.rows[1] == ["0", "x,0"]


def test_lines_still_being_written(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": 2, "b": null}\n{"a": 3, "b"')
    got = records.read_json_lines(spark, str(tmp_path), spark.createDataFrame([], "a int, b string").schema)
    assert sorted((r.a, r.b) for r in got.collect()) == [(1, "x"), (2, None)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "1.json").write_text('{"a": 1,\n "b": "x"}')
    (tmp_path / "d" / "2.json").write_text('{"a": 1,')
    assert [(r.a, r.b) for r in records.read_documents(spark, str(tmp_path / "d"), got.schema).collect()] == [(1, "x")]


def test_questions(spark):
    rows = spark.createDataFrame([("2", "b?"), ("1", "a?")], "Problem string, Index string").select(F.col("Index").alias("Problem"), F.col("Problem").alias("Index"))
    assert sorted((r["index"], r.question) for r in records.questions(rows).collect()) == [(1, "a?"), (2, "b?")]
    for bad in ([("x", "b?")], [("1", "a"), ("1", "b")], [("1", " ")]):
        with pytest.raises(Exception, match="index|question"):
            records.questions(spark.createDataFrame(bad, "no string, text string")).collect()


def test_store_keeps_the_latest(spark, tmp_path):
    store = records.LatestStore(str(tmp_path / "s"), ["k"], ["at"])
    for rows in ([("a", 1, "x"), ("b", 5, "y")], [("a", 2, None)]):
        store.put(spark.createDataFrame(rows, "k string, at int, v string"))
    assert sorted((r.k, r.at, r.v) for r in store.get(spark).collect()) == [("a", 2, None), ("b", 5, "y")]
    assert [r.k for r in store.missing(spark.createDataFrame([("a",), ("c",)], "k string")).collect()] == ["c"]


def test_as_of_and_within(spark):
    left = spark.createDataFrame([("k", 5, "p"), ("k", 1, "q"), ("k", 3, "r"), (None, 3, "s")], "k string, at int, id string")
    right = spark.createDataFrame([("k", 3, 7), ("k", 3, 9), ("k", 4, None), ("z", 1, 1)], "k string, at int, v int")
    assert {r.id: r.v for r in ordered.as_of(left, right, "k", "at", ["v"]).collect()} == {"p": None, "q": None, "r": 9, "s": None}
    spans = spark.createDataFrame([("k", 0, 3, 2), ("k", 3, 9, 1), ("k", 9, 3, 0)], "k string, lo int, hi int, ord int")
    met = ordered.within(left, spans, "k", "at", "lo", "hi", 2.0)
    assert sorted((r.id, r.ord) for r in met.collect()) == [("p", 1), ("q", 2), ("r", 1), ("r", 2)]
    assert {r.id: r.ord for r in ordered.within(left, spans, "k", "at", "lo", "hi", 2.0, ["ord"]).collect()} == {"p": 1, "q": 2, "r": 1}


def test_violations(spark):
    rows = spark.createDataFrame([("1", "ok"), ("1", "ok"), ("x", "a"), ("3", " "), ("4", "a\nb\tc" + "z" * 50), (None, "a")], "key string, answer string")
    expected = spark.createDataFrame([(1,), (2,), (3,)], "key int")
    got = {(r.rule, r.key) for r in answers.violations(rows, expected, "key", 20).collect()}
    assert got == {("repeated", "1"), ("key is no integer", "x"), ("key is no integer", None), ("blank", "3"), ("line break", "4"), ("tab", "4"), ("too long", "4"), ("missing", "2"), ("extra", "4")}
