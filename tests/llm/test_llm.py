"""Operators for training text against brute force, round trips and edge cases."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from bunko.llm import answer_defects as ad
from bunko.llm import byte_pairs, lookalike, mixing, near_duplicates, registry, splitting, text_quality, token_budget
from bunko.session import table

DATA = "/root/testdata/sf0.001"
PAGES = "page_id bigint, doc_id string, no int, filetype string, text string, key string, id string, value string"
ODD = [None, "", "   ", "　​", "a", "a\x00b", "が" * 3000, "x" * 20_000, "👩‍💻" * 500, "\r\n\r\n\n", "<|endoftext|> 's 漢字"]


def pages(spark, texts, kind="pdf"):
    return spark.createDataFrame([(i, f"d{i}", 1, kind, t, "k", "i", "v") for i, t in enumerate(texts)], PAGES)


# Problem 1


@pytest.mark.parametrize("limit,overlap", [(50, 0), (50, 10), (7, 3), (3, 9), (1, 0)])
def test_pieces_cover_the_text(limit, overlap):
    rnd = random.Random(limit)
    for _ in range(40):
        text = "".join(rnd.choice(["語。", "word ", "\n", "\n\n", "| a | b |\n", "、", "é", "👩‍💻", "x" * 30]) for _ in range(rnd.randrange(60)))
        got = splitting.split(text, limit, overlap)
        own = min(overlap, limit - 1)
        assert "".join(text[n:e] for _, n, e in got) == text
        assert all(e - s <= limit for s, _, e in got)
        assert all(s == max(0, n - own) for s, n, _ in got)
        assert len(text) > limit or len(got) == 1


def test_pieces_end_at_natural_boundaries():
    text = "\n\n".join("。".join("文" * 18 for _ in range(4)) + "。" for _ in range(4))
    assert all(text[:e].rstrip("\n").endswith("。") for _, _, e in splitting.split(text, 90, 5))
    flags = "🇯🇵" * 40
    assert all(e % 2 == 0 for _, _, e in splitting.split(flags, 9, 0))


def test_split_limits(spark):
    limits = spark.createDataFrame([("pdf", 10, 2), ("default", 5, 1)], "filetype string, max_chars int, overlap_chars int")
    rows = [(1, "d", 1, " .PDF", "x" * 11, "", "", ""), (2, "d", 1, None, "x" * 6, "", "", ""), (3, "d", 1, "pdf", "x" * 10, "", "", ""), (4, "d", 1, "pdf", None, "", "", ""), (1, "d", 1, " .PDF", "x" * 11, "", "", "")]
    got = splitting.pieces(spark.createDataFrame(rows, PAGES), limits).collect()
    assert Counter((r.page_id, r.piece_no) for r in got) == {(1, 1): 2, (1, 2): 2, (2, 1): 1, (2, 2): 1}
    assert splitting.pieces(spark.createDataFrame([], PAGES), limits).count() == 0


# Problems 2, 6 and 7


def test_ids_equal_the_tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    reference = tokenizers.Tokenizer.from_file(byte_pairs.vocabulary())
    reference.encode_special_tokens = True
    a = byte_pairs.automaton(byte_pairs.vocabulary())
    rnd = random.Random(1)
    texts = [t or "" for t in ODD] + ["".join(rnd.choice("ab é'sｶ語の。 \n\t09_-=👩") for _ in range(rnd.randrange(40))) for _ in range(500)]
    for text in texts:
        ids = np.frombuffer(a.encode(text), dtype=np.int32).tolist()
        assert ids == reference.encode(text, add_special_tokens=False).ids
        assert a.decode(ids).decode("utf-8", "surrogatepass") == text


def test_encoding_of_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, "e") for i, t in enumerate(ODD)] + [(0, None, "e")], "doc_id bigint, text string, ids string")
    got = byte_pairs.encode_documents(docs).collect()
    assert len(got) == len(ODD) + 1 and all(r.ids == [] for r in got if r.doc_id in (0, 1)) and all(len(r.ids) for r in got if r.doc_id > 1)
    assert byte_pairs.encode_documents(docs.limit(0)).count() == 0
    back = byte_pairs.decode_documents(byte_pairs.encode_documents(docs)).collect()
    assert sorted((r.doc_id, r.text) for r in back) == sorted((r.doc_id, r.text or "") for r in docs.collect())
    odd = spark.createDataFrame([(1, None, "x"), (2, [None], "x"), (3, [], None)], "doc_id bigint, ids array<int>, text string")
    assert {(r.doc_id, r.text) for r in byte_pairs.decode_documents(odd).collect()} == {(1, ""), (2, ""), (3, "")}


def test_arcs_are_what_the_gadgets_leave():
    """Gadget by gadget on sets of arcs, with merges that overlap, repeat a half and meet themselves."""
    rnd = random.Random(5)
    for turn in range(30):
        tokens = ["a", "b", "c"]
        merges: list[tuple[str, str]] = []
        while len(merges) < 14:
            u, v = rnd.choice(tokens), rnd.choice(tokens)
            if u + v not in tokens and len(u + v) < 9:
                merges.append((u, v))
                tokens.append(u + v)
        arcs = {(p, t) for p in "abc" for t in "abc"}
        for u, v in merges:
            behind = {t for p, t in arcs if p == v}
            arcs.discard((u, v))
            before = {p for p, t in arcs if t == u}
            arcs |= {(u + v, t) for t in behind} | {(p, u + v) for p in before}
            if u in behind:
                arcs.add((u + v, u + v))
        a = byte_pairs.MergeAutomaton.__new__(byte_pairs.MergeAutomaton)
        number = {t: i for i, t in enumerate(tokens)}
        a.label = {t.encode(): i for t, i in number.items()}
        a.rank = {(number[u], number[v]): k for k, (u, v) in enumerate(merges)}
        a.halves = {number[u + v]: (number[u], number[v], k) for k, (u, v) in enumerate(merges)}
        a.compile()
        assert {(p, t) for p in tokens for t in tokens if a.arc(number[p], number[t])} == arcs, turn


def odd_words():
    rnd = random.Random(4)
    letters = ["a", "ab", "in", "語", "が", "👩‍💻", "\ud800", "é", "1", "\n", "xx", "̈", "ﷺ"]
    return ["".join(rnd.choices(letters, k=rnd.randrange(1, 30))) for _ in range(400)] + ["x" * 20_000, "が" * 3000, "a" * 150, "\x00"]


@pytest.mark.parametrize("few", [2, 24, 1000])
def test_words_read_together_equal_words_read_alone(few, monkeypatch):
    monkeypatch.setattr(byte_pairs, "FEW_WORDS", few)
    a = byte_pairs.automaton(byte_pairs.vocabulary())
    words = [w.encode("utf-8", "surrogatepass") for w in odd_words()] + [b"", b"a"]
    assert a.paths(words) == [np.array(a.path(w), dtype=np.int32).tobytes() for w in words]
    assert a.paths([]) == []


@pytest.mark.parametrize("step", [byte_pairs.encoded, byte_pairs.counted])
def test_new_words_are_read_together(step, monkeypatch):
    path = byte_pairs.vocabulary()
    a = byte_pairs.automaton(path)
    texts = [None, "", *(f" Kob{i}reo triv{i}an" for i in range(3000))]
    want = [a.encode(t) for t in texts]
    a.clear(), a.parts.clear()
    alone, one = [], byte_pairs.MergeAutomaton.path
    monkeypatch.setattr(byte_pairs.MergeAutomaton, "path", lambda self, word: alone.append(word) or one(self, word))
    got = [x for b in step(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])]), path, 0) for x in b.column(0).to_pylist()]
    assert got == [len(x) // 4 if step is byte_pairs.counted else np.frombuffer(x, dtype=np.int32).tolist() for x in want]
    assert len(alone) < 500 < len(a)


def test_token_counts_equal_encoding(spark):
    texts = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, "a b a b", "a b a b"])], "text_key bigint, text string")
    a = byte_pairs.automaton(byte_pairs.vocabulary())
    want = {i: len(a.encode(t)) // 4 for i, t in enumerate([*ODD, "a b a b", "a b a b"]) if t}
    assert {r.text_key: r.n_tokens for r in token_budget.token_counts(texts).collect()} == want
    often = spark.createDataFrame([(i, "the same words in all texts" + f" {i}" * (i % 3)) for i in range(300)], "text_key bigint, text string").repartition(3)
    want = {r.text_key: len(a.encode(r.text)) // 4 for r in often.collect()}
    assert {r.text_key: r.n_tokens for r in token_budget.token_counts(often).collect()} == want
    totals = token_budget.p2_totals(spark, DATA).collect()
    assert sum(r.n_texts for r in totals) == table(spark, DATA, "documents").count() + table(spark, DATA, "extracted_pages").count()


def test_mix(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice(["a", "a", "a", "b", "c", None]), rnd.randrange(1, 100)) for i in range(4000)] + [(9001, "a", 0)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.15, 2), ("gone", 0.05, 2)], "source string, target_share double, max_repeats int")
    rate_of = mixing.rates(sized, targets)
    mixed = mixing.mix(sized, rate_of)
    assert mixed.exceptAll(mixing.mix(sized, rate_of)).count() == 0
    most = {"a": 1, "b": 4, "c": 2}
    assert all(n <= most[s] for (_, s), n in Counter((r.doc_id, r.source) for r in mixed.collect()).items())
    got = {r.source: r for r in mixing.report(mixed, rate_of).collect()}
    assert got[None].copies == got["gone"].copies == 0 and got[None].target_share is None
    for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert abs(got[s].actual_share - share / 0.95) < 0.03
    assert mixing.mix(sized.limit(0), mixing.rates(sized.limit(0), targets)).count() == 0


def test_a_scarce_source_does_not_shrink_the_mix(spark):
    rows = [(i, "big", 100) for i in range(2000)] + [(9000, "tiny", 10)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("big", 0.9, 1), ("tiny", 0.06, 3), ("gone", 0.04, 2)], "source string, target_share double, max_repeats int")
    rate_of = mixing.rates(sized, targets)
    got = {r.source: r for r in mixing.report(mixing.mix(sized, rate_of), rate_of).collect()}
    assert abs(got["big"].mix_tokens / 200_010 - 0.9) < 0.03 and not got["big"].short
    assert got["tiny"].copies == 3 and got["tiny"].short and got["tiny"].actual_share < 0.001
    assert got["gone"].short and got["gone"].actual_share == 0
    least = mixing.rates(sized, targets, reachable=True)
    assert {r.source: r.rate for r in least.where("tokens > 0").collect()} == {"big": round(0.9 * 500 / 200_000, 9), "tiny": 3.0}


# Problem 3


def test_clear_defects(spark):
    q = "Which file stores the settings of Grazu?"
    rows = [(1, q, "The settings of Grazu are stored in a_b.md.", None), (2, q, "​ ", "N/A"), (3, q, "I'm sorry, but I can't answer this.", "Step 2 names a_b.md."), (4, q, f"**{q}**", ""),
            (5, q, "グラズの設定はa_b.mdに保存されています。", None), (6, q, "The settings of Grazu are stored in the folder that", None), (7, q, f"{q} The settings of Grazu are stored in a_b.md.", None),
            (8, q, "a_b.md", None), (9, None, None, None), (10, q, 'The summary records that the vendor said "we can\'t answer questions" in the call.', None)]
    base = table(spark, DATA.replace("0.001", "0.01"), "ask_cache").select((F.col("ask_id") + 1000).alias("ask_id"), "question", "answer", "evidence")
    asks = spark.createDataFrame(rows, "ask_id bigint, question string, answer string, evidence string").unionByName(base)
    got = {(r.ask_id, r.field): r.defect for r in ad.defects(asks).where("ask_id <= 10").collect()}
    assert got == {(2, "answer"): "empty", (3, "answer"): "refusal", (4, "answer"): "copy", (5, "answer"): "other_language", (6, "answer"): "truncated", (9, "answer"): "empty"}


def test_the_field_on_held_out_rows():
    rows = pq.read_table(DATA.replace("0.001", "0.01") + "/ask_cache.parquet", columns=["question", "answer", "evidence"]).to_pylist()
    pairs = [(lookalike.consistent_form(r["question"]), form) for r in rows for x in ("answer", "evidence") if r["question"] and r[x] and not ad.is_empty(form := lookalike.consistent_form(r[x]))]
    features, field = ad.train(pairs[::2])
    wanted = {ad.REFUSAL: "refusal", ad.ECHO: "copy", ad.FOREIGN: "other_language", ad.UNFINISHED: "truncated"}
    seen, hit = Counter(), Counter()
    for parts, q, tags in ad.variants(pairs[1::2], 3):
        kinds = set(tags)
        if kinds <= {ad.ANSWER} or len(kinds - {ad.ANSWER}) > 1 or kinds == {ad.ANSWER, ad.ECHO}:
            continue
        want = wanted[(kinds - {ad.ANSWER}).pop()]
        got = ad.verdict(field.marginals(*features([parts], [q])), parts)
        seen[want] += 1
        hit[want] += got == want
    assert all(hit[k] >= 0.85 * seen[k] and seen[k] > 50 for k in wanted.values()), (seen, hit)


def test_defects_of_an_empty_table(spark):
    asks = spark.createDataFrame([], "ask_id bigint, question string, answer string, evidence string, field string, defect string")
    assert ad.defects(asks).count() == 0


# Problem 4


def test_forms():
    same = [("ガギ", "ｶﾞｷﾞ"), ("a　b", "a b"), ("é", "é"), ("сору", "copy"), ("⽇⽉", "日月"), ("a‐b", "a-b"), ("a​b", "ab"), ("Ａ（", "A("), ("a\r\nb", "a\nb")]
    differ = [("x²", "x2"), ("①", "1"), ("ハ", "バ"), ("e", "é"), ("a", "A"), ("a  b", "a b"), ("a\nb", "a b"), ("👩‍💻", "👩💻")]
    same += [("𝐀𝟏", "A1"), ("ℝ", "R"), ("Ꭰꓮ", "DA"), ("1∶2", "1:2"), ("a⁄b", "a/b"), ("µ", "μ"), ("αρ", "ap"), ("ロ", "口"), ("ベ", "べ"), ("〜", "～"), ("ﬁ", "fi"), ("Ⲣ", "P")]
    assert all(lookalike.skeleton(a) == lookalike.skeleton(b) for a, b in same)
    assert all(lookalike.skeleton(a) != lookalike.skeleton(b) for a, b in differ)
    assert lookalike.skeleton(None) is None


def test_only_texts_beyond_the_basic_plane_are_searched_for_its_letters(monkeypatch):
    assert lookalike.skeleton("\U0001d400é\U000e0041b") == lookalike.skeleton("Aéb")
    monkeypatch.setattr(lookalike, "_TAGS", None)
    assert lookalike.skeleton("Aéb\ud800") == "Ae\u0301b\ud800"


def test_same_look_pairs_against_brute_force(spark):
    values = ["a b", "a　b", "a b", "ab", "a​b", None, "", "​", " ", "ｶﾞ", "ガ", "か", "x" * 5000, "x" * 4999 + "ｘ"]
    df = spark.createDataFrame([(i, v, "f", "l") for i, v in enumerate(values)], "page_id bigint, text string, field string, look string")
    got = {(r.id_a, r.id_b) for r in lookalike.same_look_pairs(lookalike.look_keys(df, "text", "page_id", "text")).collect()}
    full = [(i, v) for i, v in enumerate(values) if lookalike.has_content(lookalike.skeleton(v))]
    assert got == {(i, j) for i, v in full for j, w in full if i < j and v != w and lookalike.skeleton(v) == lookalike.skeleton(w)}


def test_classes_of_looks(spark):
    values = ["a b", "a　b", "a b", "ab", None, "", "a\u00a0b"]
    df = spark.createDataFrame(list(enumerate(values)), "page_id bigint, text string")
    got = {r.id: (r["class"], r.n_values) for r in lookalike.look_classes(lookalike.look_keys(df, "text", "page_id", "text")).collect()}
    assert got == {0: (0, 3), 1: (0, 3), 2: (0, 3), 3: (3, 1), 6: (0, 3)}


# Problem 5


def brute(rows, length, threshold):
    sets = [(i, k, {v[j : j + length] for j in range(len(v) - length + 1)}) for i, k, v in rows]
    return {(a, b) for x, (a, k, s) in enumerate(sets) for b, m, t in sets[x + 1 :] if k != m and len(s & t) >= threshold * len(s | t)}


@pytest.mark.parametrize("shards", [None, 40])
def test_near_pages_against_brute_force(spark, shards, monkeypatch):
    rnd = random.Random(5)
    texts = []
    for _ in range(25):
        base = "".join(rnd.choice("abcdefghij ") for _ in range(rnd.choice([205, 400, 1300])))
        texts.append(base)
        for edits in (0, 3, 8, 15):
            t = list(base)
            for _ in range(edits):
                i = rnd.randrange(len(t))
                t[i : i + 1] = rnd.choice([[], ["z"], ["q", "r"]])
            texts.append("".join(t))
    texts += [None, "", "x" * 300, "x" * 300, "short"]
    if shards:
        monkeypatch.setattr(near_duplicates, "RECORDS_PER_SHARD", 3)
        monkeypatch.setattr(near_duplicates, "MOST_SHARDS", 4)
        monkeypatch.setattr(near_duplicates, "BROADCAST_ENDS", 0)
    got = {(r.id_a, r.id_b) for r in near_duplicates.near_pages(pages(spark, texts)).collect()}
    rows = [(i, i, lookalike.comparable(t)) for i, t in enumerate(texts) if t and len(lookalike.comparable(t)) >= 200]
    assert got == brute(rows, 5, 0.7)


def test_as_many_candidates_at_any_number_of_shards(spark):
    values = near_duplicates.page_rows(table(spark, DATA.replace("0.001", "0.01"), "extracted_pages"))
    found = [{(r.id_a, r.id_b) for r in near_duplicates.candidates(values, 5, 0.7, shards).collect()} for shards in (4, 30)]
    rows = [(r.id, r.id, r.value) for r in values.collect()]
    assert max(map(len, found)) <= 1.5 * min(map(len, found))
    least = {}
    for i, _, v in sorted(rows):
        least.setdefault(v, i)
    want = brute([(i, i, v) for v, i in least.items()], 5, 0.7)
    assert all({(min(p), max(p)) for p in want} <= f for f in found) and len(want) > 10


def shuffled(spark, f):
    """Bytes that the stages of f write to shuffles."""
    store, ends = spark.sparkContext._jsc.sc().statusStore(), []
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    for run in (lambda: None, f):
        run()
        spark.sparkContext.parallelize([0], 1).count()  # the id of its stage is the next one
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        ends.append(max(spark.sparkContext.statusTracker().getJobInfo(j).stageIds[0] for j in spark.sparkContext.statusTracker().getJobIdsForGroup(None)))
    total = 0
    for stage in range(ends[0] + 1, ends[1]):
        try:
            total += store.lastStageAttempt(stage).shuffleWriteBytes()
        except Exception:  # a stage that was skipped
            pass
    return total


def test_postings_travel_once_at_any_number_of_records(spark):
    values = near_duplicates.page_rows(table(spark, DATA.replace("0.001", "0.01"), "extracted_pages"))
    few, many = (shuffled(spark, lambda n=n: near_duplicates.candidates(values, 5, 0.7, n).count()) for n in (4, 171))
    assert 0 < many <= 2 * few


def test_blocks_of_postings_lose_no_pair(spark, monkeypatch):
    values = near_duplicates.page_rows(table(spark, DATA.replace("0.001", "0.01"), "extracted_pages"))
    found = []
    for most in (near_duplicates.MOST_POSTINGS, 3000):
        monkeypatch.setattr(near_duplicates, "MOST_POSTINGS", most)
        found.append({(r.id_a, r.id_b) for r in near_duplicates.candidates(values.repartition(12), 5, 0.7).collect()})
    assert found[0] == found[1] and len(found[0]) > 10


def test_runs_of_all_records_are_counted(spark):
    n, common = 20_000, "common "
    values = spark.range(n).select("id", F.concat(F.lit(common), F.md5(F.col("id").cast("string"))).alias("value"), F.lit(0).cast("bigint").alias("salt"))
    rarity = near_duplicates.rarity_table(values, n, 5)
    cells = lambda text: (near_duplicates.run_sets([text], [0], 5)[1] & np.uint64((1 << near_duplicates.COST_BITS) - 1)).astype(int)
    assert rarity[cells(common)].max() == 0
    seen = np.zeros(1 << near_duplicates.COST_BITS, dtype=bool)
    seen[np.concatenate([cells(r.value) for r in values.collect()])] = True
    assert (rarity[seen] < 255).all() and (rarity[~seen] == 255).all()


def test_few_shards_ask_for_more_meetings(tmp_path, monkeypatch):
    rnd, ones, looked, found = random.Random(3), np.bitwise_count, [], []
    parts = ["".join(rnd.choices("abcdefghij ", k=60)) for _ in range(40)]
    texts = ["".join(rnd.sample(parts, 8)) for _ in range(200)]
    texts += [t[:200] + "z" + t[200:] for t in texts[:20]]
    rarity = np.full(1 << near_duplicates.COST_BITS, 9, dtype=np.uint8)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array([0] * len(texts))], names=["id", "value", "salt"])
    monkeypatch.setattr(np, "bitwise_count", lambda x: looked.__setitem__(-1, looked[-1] + len(x)) or ones(x))
    for spare in (0, 12):
        monkeypatch.setattr(near_duplicates, "SPARE", spare, raising=False)
        looked.append(0)
        groups = {}
        for row in near_duplicates.postings(iter([batch]), 5, 0.7, rarity, 4, f"file://{tmp_path}"):
            groups.setdefault((row.column(0)[0].as_py(), row.column(1)[0].as_py()), []).append(row)
        met = [b for g in groups.values() for b in near_duplicates.meet(iter(g), 0.7, 4, f"file://{tmp_path}", 10**6)]
        found.append({p for b in met for p in zip(*(c.to_pylist() for c in b.columns))})
    assert 0 < 1.3 * looked[1] < looked[0]
    assert brute([(i, i, t) for i, t in enumerate(texts)], 5, 0.7) <= found[0] & found[1] and len(found[1]) >= 20


@pytest.mark.parametrize("at_once", [7, 30_000])
def test_runs_are_those_of_each_value(at_once, monkeypatch):
    monkeypatch.setattr(near_duplicates, "HASH_CHARS", at_once)
    rnd = random.Random(2)
    values = ["".join(rnd.choices("ab語👩", k=rnd.choice([0, 1, 4, 5, 6, 40]))) for _ in range(60)]
    rec, token, n = near_duplicates.run_sets(values, [0] * 60, 5)
    want = [{v[i : i + 5] for i in range(len(v) - 4)} for v in values]
    got = [set(token[rec == i].tolist()) for i in range(60)]
    assert n.tolist() == list(map(len, want))
    assert all(len(got[a] & got[b]) == len(want[a] & want[b]) for a in range(60) for b in range(60))


def test_classes_of_copies(spark):
    same = "copied text of some length " * 10
    texts = [same] * 50 + [same + "end", "other " * 60, "", None]
    got = {r.id: (r["class"], r.n_links) for r in near_duplicates.class_links(near_duplicates.page_rows(pages(spark, texts)), 5, 0.7).collect()}
    assert got == {**{i: (0, 1) for i in range(50)}, 50: (50, 1), 51: (51, 0)}


def test_marks_packed_and_back():
    marks = np.array([0, 3, 3, 250, 255, 0, 1, 7, 255, 0], dtype=np.uint8)
    assert near_duplicates._unpack_marks(near_duplicates._pack_marks(marks)).tolist() == marks.tolist()
    assert near_duplicates._unpack_marks(near_duplicates._pack_marks(marks[:0])).tolist() == []
    for keys in (np.array([], dtype=np.uint64), np.array([1 << 19], dtype=np.uint64), np.array([3, (1 << 20) - 1, 7], dtype=np.uint64)):
        assert near_duplicates._unpack_keys(near_duplicates._pack_keys(keys), len(keys)).tolist() == keys.tolist()


def test_least_sum_loses_no_agreeing_posting():
    rng = np.random.default_rng(1)
    a, b, limit = rng.integers(60, 4000, 20000), rng.integers(60, 4000, 20000), rng.integers(1, 2000, 20000)
    mark = rng.integers(0, near_duplicates.STEPS + 1, 20000).astype(np.uint8)
    agree = mark.astype(np.int64) * limit <= near_duplicates.STEPS * (near_duplicates.differences(a, b, 0.7) + 4)
    need = near_duplicates.least_sum(mark, limit, 0.7, 4)
    assert (need[agree] <= (a + b)[agree]).all()


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.7, 0.8, 0.95, 1.0])
def test_no_partner_is_beyond_the_next_band(threshold):
    plan = near_duplicates.bands(threshold)
    assert all(a[1] == b[0] for a, b in zip(plan, plan[1:]))
    assert all(np.floor((a[1] - 1) / threshold + 1e-9) < b[1] for a, b in zip(plan, plan[1:]))


def test_all_size_ratios_against_brute_force(spark):
    rnd = random.Random(8)
    rows = []
    for g in range(3):
        base = [chr(0x4E00 + c) for c in rnd.sample(range(20_000), 151)]
        rows += [(1000 * g + n, n, "".join(base[: n + 1])) for n in range(30, 151)]
    files = spark.createDataFrame([(i, f"{v}.txt", "P") for i, _, v in rows], "file_id bigint, relpath string, project string")
    got = {(r.id_a, r.id_b) for r in near_duplicates.near_names(files).collect()}
    want = brute([(i, i, lookalike.comparable(v)) for i, _, v in rows], 2, 0.7)
    assert got == want and any(a % 1000 <= 55 and b % 1000 >= 65 for a, b in want)


def test_near_names_against_brute_force(spark):
    rnd = random.Random(6)
    rows = []
    for i in range(150):
        name = rnd.choice(["monthly_report_of_sales", "inventory list final", "見積書一覧表の最新版と旧版と控え", "x"]) + rnd.choice(["", "2", "_v2", " old", "ab"])
        rows.append((i, rnd.choice(["P", "Ｐ", "Q", None]), f"d{rnd.randrange(3)}/{name}.txt"))
    files = spark.createDataFrame([(i, r, p) for i, p, r in rows] + [(900, None, "P")], "file_id bigint, relpath string, project string")
    got = [(r.id_a, r.id_b) for r in near_duplicates.near_names(files).collect()]
    want = set()
    for p in ("P", "Q"):
        own = [(i, r, lookalike.comparable(r).rpartition("/")[2].rpartition(".")[0].strip()) for i, q, r in rows if q and lookalike.consistent_form(q) == p]
        want |= brute([x for x in own if len(x[2]) >= 12], 2, 0.7)
    assert set(got) == want and len(got) == len(want)
    assert near_duplicates.near_names(files.limit(0)).count() == 0


# Problem 8


def test_kinds(spark):
    common = spark.createDataFrame([("en", w) for w in "the of and to in is was with for not".split()], "lang string, word string")
    prose = "The report of the team was sent to the office in May. It is not clear if the numbers of the list are right.\n" * 1 + "The work with the new system is going on and the team is content.\n"
    table_ = "\n".join(["id,name,size"] + [f"{i},n{i},{i * 7}" for i in range(12)])
    list_ = "\n".join(f"- item {i} of things" for i in range(12))
    code = "import os\n\ndef f(x):\n    return x + 1\n\nfor i in range(3):\n    print(f(i))\n"
    rnd = random.Random(2)
    junk = "".join(rnd.choice("ABCabcXYZxyz0123456789+/") for _ in range(300))
    rows = [(i, prose + str(i), "en", "x") for i in range(60)] + [(100, table_, "en", "x"), (101, list_, None, "x"), (102, code, "und", "x"), (103, junk, "en", "x"), (104, None, None, None), (105, " ​", "en", "x"), (106, "=" * 400, "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, kind string").drop("kind")
    out = {r.doc_id: r for r in text_quality.quality(docs, common).collect()}
    assert {i: out[i].kind for i in range(100, 107)} == {100: "table", 101: "list", 102: "code", 103: "junk", 104: None, 105: None, 106: "junk"}
    assert all(out[i].kind == "prose" for i in range(60))
    parts = [f"part_{c}" for c in text_quality.STATISTICS]
    assert all(abs(sum(out[i][p] for p in parts) - out[i].distance2) < 1e-6 * max(1, out[i].distance2) for i in (0, 100, 103))
    assert text_quality.quality(docs.limit(0), common).count() == 0


def test_language_is_told_from_the_whole_text():
    common = {"en": ["the", "of", "is"], "de": ["der", "und", "ist"], "ja": ["です"], "zh": ["的"]}
    lower = {k: frozenset(v) for k, v in common.items()}
    head = "The report of the team is here. " * 150
    assert len(head) > 4000
    assert text_quality.detect(head + "これは日本語の文章です。" * 1000, lower) == "ja"
    assert text_quality.detect(head + "这份报告是团队的。" * 2000, lower) == "zh"
    assert text_quality.detect(head + "Der Bericht und der Plan ist fertig. " * 400, lower) == "de"
    assert text_quality.detect(head, lower) == "en"
    got = text_quality.Meter(common).measure(head + "これは日本語の文章です。" * 1000, None)
    assert got["language"] == "ja" and got["common_share"] > 0


def test_agreement_with_raters(spark):
    got = {r.doc_id: r.kind for r in text_quality.p8_statistics(spark, "/root/testdata/sf0.01").select("doc_id", "kind").collect()}
    labels = table(spark, "/root/testdata/sf0.01", "quality_labels").collect()
    assert np.mean([got[r.doc_id] == r.kind for r in labels if got[r.doc_id]]) > 0.85


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_queries_run(spark, name):
    registry.QUERIES[name](spark, DATA).collect()
